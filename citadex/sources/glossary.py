"""Glossary readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.schemas import GLOSSARY, GLOSSARY_CSV


def glossary_rows(raw: DataFrame) -> DataFrame:
    """Trimmed entries from term, definition and pipe-separated aliases; incomplete rows are left out."""
    alias = F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), tx.strip)
    return raw.withColumns({
        "term": tx.strip(F.col("term")), "definition": tx.strip(F.col("definition")),
        "aliases": F.filter(alias, lambda a: a != ""),
    }).where("term != '' AND definition != ''")


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema=GLOSSARY_CSV, header=True, multiLine=True, escape='"')
    return glossary_rows(raw).select(
        F.monotonically_increasing_id().alias("entry_id"), "term", "definition", "aliases",
        F.substring_index(F.lit(path), "/", -1).alias("file_name"), F.lit(None).cast("string").alias("page_label"),
    )


def glossary_from_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Entries from lines `term: definition` or `term - definition`, split once.

    A colon anywhere wins over the dash; both sides must be longer than one character.
    """
    keep = [c for c in df.columns if c != text]
    line = tx.strip(F.col("_line"))
    sep = F.when(F.contains("line", F.lit(":")), F.lit(":")).when(F.contains("line", F.lit(" - ")), F.lit(" - "))
    cut = F.locate(":", F.col("line"))
    dash = F.instr(F.col("line"), " - ")
    at = F.when(F.col("sep") == ":", cut).otherwise(dash)
    term = F.expr("substring(line, 1, at - 1)")
    definition = F.expr("substring(line, at + length(sep))")
    return (
        df.select(*keep, F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_ix", "_line"))
        .select(*keep, "line_ix", line.alias("line")).withColumn("sep", sep).where("sep IS NOT NULL").withColumn("at", at)
        .withColumns({"term": tx.strip(term), "definition": tx.strip(definition)})
        .where("length(term) > 1 AND length(definition) > 1")
        .select(*keep, "line_ix", "term", "definition", F.array().cast("array<string>").alias("aliases"))
    )


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension; `.txt` is parsed by line, anything unknown gives no rows."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        return read_glossary_csv(spark, path)
    if kind == ".txt":
        lines = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
        parsed = glossary_from_lines(lines)
        return parsed.select(
            F.monotonically_increasing_id().alias("entry_id"), "term", "definition", "aliases",
            F.substring_index(F.lit(path), "/", -1).alias("file_name"), F.lit(None).cast("string").alias("page_label"),
        )
    return spark.createDataFrame([], f"entry_id bigint, {GLOSSARY}")
