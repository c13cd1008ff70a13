"""Text expressions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from citadex.settings import (
    ACRONYM_STRIP, ACRONYMS, STOP_WORDS, TYPOS,
)

# (?U) makes white space follow Unicode: Java's plain \s covers ASCII only.
_TOKEN = r"(?U)\S+"
_EDGES = r"(?U)^\s+|\s+$"
_WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """Bind `value` to a name inside `body`, so that an expression used often is evaluated once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space; punctuation stays on the token."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Tokens between white space in their own case."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def clean(text: Column, typos: Mapping[str, str] = TYPOS) -> Column:
    out = F.array_join(words(text), " ")
    for wrong, right in typos.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def expand_acronyms(text: Column, acronyms: Mapping[str, str] = ACRONYMS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in acronyms.items() for x in pair])
    edge = f"^[{ACRONYM_STRIP}]+|[{ACRONYM_STRIP}]+$"

    def one(word: Column) -> Column:
        meaning = F.try_element_at(table, F.regexp_replace(F.lower(word), edge, ""))
        return F.when(meaning.isNotNull(), F.concat(word, F.lit(" ("), meaning, F.lit(")"))).otherwise(word)

    return F.array_join(F.transform(words(text), one), " ")


def keywords(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words) & (F.length(w) > 2))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def file_stem(name: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def cache_key(query: Column, top_k: Column, alpha: Column) -> Column:
    """Key of an exact repeat; a double renders as `0.5` or `1.0`."""
    return F.md5(F.concat_ws(":", strip(F.lower(query)), top_k.cast("string"), alpha.cast("string")))


def question_hash(query: Column) -> Column:
    return F.md5(strip(F.lower(query)))


def to_stored(number: Column) -> Column:
    return number.cast("decimal(10,6)")


def from_stored(number: Column) -> Column:
    """Stored decimals come back as text without a fraction when integral, else as a double."""
    plain = number.cast("double")
    return F.when(plain == F.floor(plain), F.floor(plain).cast("string")).otherwise(plain.cast("string"))


def search_mode(alpha: Column) -> Column:
    return F.when(alpha < 0.3, "keyword").when(alpha > 0.7, "semantic").otherwise("balanced")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
