"""Options and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Scale settings -----------------------------------------------------------------------------

# Largest side that may be broadcast; its size is measured or bounded before the hint is given.
BROADCAST_LIMIT_BYTES = 64 << 20
# Rows per block in blocked vector scoring: bounds the memory of one task.
BLOCK_ROWS = 4096
# Parts a term's posting list is split into when the query side is too large to broadcast.
TERM_SHARDS = 32
# Bound on (question term, node) pairs beyond which a search first narrows down its candidates.
PRUNE_PAIRS = 10_000_000_000
# Nodes and bytes of text of one shard of an index, and cells that its posting lists keep maxima of.
NODES_PER_SHARD = 16_384
BYTES_PER_SHARD = 8 << 20
CELLS = 64
# Turns in which the shards of an index are made, each with a part of the texts, and shards below which one turn does.
TURNS, SHARDS_IN_ONE_TURN = 4, 32
# Shards that one task sums up term counts of, rows that it sums at a time, and shards on whose account one part of the terms goes.
SHARDS_PER_SUM, TERMS_PER_SUM, SHARDS_PER_PART = 16, 1 << 18, 8
# Sources of one page, about, that go into one row when artefacts are looked up.
SOURCES_PER_ROW = 4_096
# Stored segments beyond which small ones are merged.
MAX_SEGMENTS = 8
# Digits kept in scores, before ranking, so that equal scores are ties.
SCORE_DIGITS = 6
# Digits kept in averages and shares.
RATIO_DIGITS = 10

# --- Fixed values: word lists -------------------------------------------------------------------

STOP_WORDS = (
    "what", "how", "why", "where", "when", "who", "is", "are", "the", "a", "an", "in", "on", "at",
    "to", "for", "of", "with", "by",
)
TYPOS = {
    "pritner": "printer",
    "printeer": "printer",
    "temprature": "temperature",
    "seperator": "separator",
}
ACRONYMS = {
    "ppu": "printhead power unit",
    "cli": "command line interface",
    "pdf": "portable document format",
    "api": "application programming interface",
    "gui": "graphical user interface",
    "cpu": "central processing unit",
    "ram": "random access memory",
    "usb": "universal serial bus",
    "ip": "internet protocol",
    "tcp": "transmission control protocol",
    "http": "hypertext transfer protocol",
    "dpi": "dots per inch",
    "rpm": "revolutions per minute",
    "psi": "pounds per square inch",
}
ACRONYM_STRIP = ".,!?;:"
CAPTION_KEYWORDS = ("figure", "fig.", "diagram", "chart", "graph")
CAPTION_MIN_CHARS = 10

# --- Fixed values: intents, in order of precedence -----------------------------------------------

INTENT_RULES = (
    (("what is", "define", "definition", "meaning of", "explain"), "definition", 0.9),
    (("error", "fix", "troubleshoot", "not working", "issue", "problem", "failed"),
     "troubleshooting", 0.85),
    (("compare", "difference", "vs", "versus", "better", "which"), "comparison", 0.8),
    (("how to", "steps", "procedure", "process", "install", "configure"), "reasoning", 0.85),
    (("how many", "how much", "temperature", "pressure", "voltage", "speed"), "lookup", 0.9),
)
DEFAULT_INTENT = ("lookup", 0.6)
INTENT_TYPES = ("definition", "lookup", "troubleshooting", "reasoning", "comparison")
PARSED_INTENT_CONFIDENCE = 0.85
INTENT_LABELS = {
    "definition": "Definition",
    "troubleshooting": "Troubleshooting",
    "comparison": "Comparison",
    "reasoning": "Procedural",
    "lookup": "Lookup",
}
DEFAULT_LABEL = "General"
INTENT_GUIDANCE = {
    "troubleshooting": "Focus on step-by-step troubleshooting procedures and solutions.",
    "definition": "Provide clear, technical definitions with examples.",
    "reasoning": "Explain the process or procedure in logical steps.",
    "comparison": "Compare features, benefits, and differences clearly.",
    "lookup": "Provide specific technical details and specifications.",
}
DEFAULT_GUIDANCE = "Provide a comprehensive technical answer."

# --- Fixed values: texts -------------------------------------------------------------------------

NO_CONTEXT_ANSWER = "The provided context does not include information to answer this query."
NO_CONTEXT_REASONING = "No relevant documents were retrieved for this query."
NO_CONTEXT_SHORT_ANSWER = "I couldn't find relevant information to answer your query."
NO_CITATION_NOTE = "\n\n*Based on retrieved technical documentation.*"
GLOSSARY_REASONING = "Answered from glossary entries."
VALIDATED_REASONING = "✅ Served from validated Q&A database (user-approved answer)"

# --- Fixed values: numbers -----------------------------------------------------------------------

BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_SIZE, CHUNK_OVERLAP = 350, 88
VALIDATED_CONFIDENCE, GLOSSARY_CONFIDENCE = 0.95, 0.9
METRIC_RANGES = (7, 30, 90)


@dataclass(frozen=True)
class AnswerOptions:
    """Options of one batch of questions."""

    top_k: int = 10
    alpha: float = 0.5
    metadata_filters: dict[str, str] = field(default_factory=dict)
    filter_mode: str = "pre"
    dynamic_windowing: bool = True
    max_variations: int = 3
    min_evaluation_confidence: float = 0.7
    max_evaluated: int = 3
