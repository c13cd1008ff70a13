"""Responses as text reports and as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.functions import text as tx

_THICK, _THIN = "=" * 80, "-" * 80


def _section(rule: str, title: str, *body: Column) -> list[Column]:
    return [F.lit(rule), F.lit(title), F.lit(rule), *body, F.lit("")]


def display_text(responses: DataFrame) -> DataFrame:
    """Answer, reasoning, sources and a closing line with confidence and intent."""
    line = F.transform("sources", lambda s: F.concat(
        s["id"], F.lit(" "), s["name"],
        F.when(s["pages"] != "N/A", F.concat(F.lit(" (pages: "), s["pages"], F.lit(")"))).otherwise(""),
        F.when(s["content_type"] != "text", F.concat(F.lit(" ["), s["content_type"], F.lit("]"))).otherwise(""),
    ))
    closing = F.concat(F.lit("Confidence: "), tx.percent(F.col("confidence")), F.lit(" | Intent: "), F.col("intent_type"))
    return responses.withColumn("display", F.concat_ws(
        "\n",
        *_section(_THICK, "ANSWER:", F.col("answer")),
        *_section(_THICK, "REASONING SUMMARY:", F.col("reasoning")),
        *_section(_THICK, "SOURCE SUMMARY:", line),
        closing, F.lit(_THICK),
    ))


def report_text(responses: DataFrame, title: str = "QUERY REPORT", generated: str = "") -> DataFrame:
    """The longer report: question, answer, metadata, sources and reasoning."""
    line = F.transform("sources", lambda s: F.concat(s["id"], F.lit(" "), s["name"], F.lit(" (Pages: "), s["pages"], F.lit(")")))
    return responses.withColumn("report", F.concat_ws(
        "\n",
        F.lit(_THICK), F.lit(title), F.lit(_THICK), F.lit(f"Generated: {generated}"), F.lit(""),
        *_section(_THIN, "QUERY:", F.col("query")),
        *_section(_THIN, "ANSWER:", F.col("answer")),
        *_section(
            _THIN, "METADATA:", F.concat(F.lit("Confidence: "), tx.percent(F.col("confidence"), 0)),
            F.concat(F.lit("Intent Type: "), F.col("intent_type")),
            F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")),
        ),
        *_section(_THIN, "SOURCES:", line),
        *_section(_THIN, "REASONING:", F.col("reasoning")),
        F.lit(_THICK), F.lit("End of Report"), F.lit(_THICK),
    ))


def summary_table(responses: DataFrame) -> DataFrame:
    return responses.select("query_id", "query", "answer", tx.percent(F.col("confidence"), 0).alias("confidence"), "intent_type")


def sources_table(responses: DataFrame) -> DataFrame:
    return responses.select("query_id", F.inline("sources"))


def keywords_table(responses: DataFrame) -> DataFrame:
    return responses.select("query_id", F.posexplode("keywords").alias("position", "keyword"))


def export_tables(responses: DataFrame, path: str) -> None:
    """Summary, sources and keywords as three CSV tables."""
    for name, table in (("summary", summary_table), ("sources", sources_table), ("keywords", keywords_table)):
        table(responses).write.mode("overwrite").csv(f"{path}/{name}", header=True, quoteAll=True, escape='"')


def write_tables(tables: DataFrame, path: str) -> None:
    """Extracted tables as JSON lines, one folder per file."""
    tables.write.mode("overwrite").partitionBy("file_name").json(path)
