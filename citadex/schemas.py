"""Schemas of the tables that are read from files or streams, as DDL."""

DOCUMENTS = (
    "doc_id bigint, file_name string, page_label string, content_type string, text string"
)
GLOSSARY_CSV = ("term string, definition string, aliases string")
GLOSSARY = (
    "term string, definition string, aliases array<string>, file_name string, page_label string"
)
FLAT_FEEDBACK = (
    "id string, timestamp string, user string, query string, answer string, is_helpful boolean, "
    "confidence double, intent_type string, sources array<string>, feedback_type string"
)
QUERY_LOG = (
    "query_id string, user string, query_text string, answer_text string, intent_type string, "
    "intent_confidence double, sources array<string>, confidence double, "
    "response_time_ms bigint, session_id string, ts timestamp"
)
FEEDBACK = (
    "query_id string, user string, is_helpful boolean, feedback_text string, ts timestamp"
)
INTENT_JSON = (
    "intent_type string, confidence double, keywords array<string>, requires_subqueries boolean, "
    "temporal_context string"
)
EVALUATION_JSON = (
    "relevance_score string, confidence string, reasoning string, key_facts array<string>, "
    "limitations string"
)
