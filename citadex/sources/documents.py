"""Document scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.schemas import DOCUMENTS


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page-level text rows: doc_id, file_name, page_label, content_type, text.

    Parquet keeps its own columns where they exist. JSON is read with a fixed schema. Text files
    are one document each, named after the file.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.schema(DOCUMENTS).json(path)
    elif fmt == "text":
        name = F.substring_index("_metadata.file_path", "/", -1)
        df = spark.read.text(path, wholetext=True).select(
            F.xxhash64("_metadata.file_path").alias("doc_id"), name.alias("file_name"), F.col("value").alias("text")
        )
    else:
        raise ValueError(f"unknown document format: {fmt}")
    missing = {
        "file_name": F.lit("Unknown"), "page_label": F.lit("N/A"), "content_type": F.lit("text"),
    }
    df = df.withColumns({c: default for c, default in missing.items() if c not in df.columns})
    return df.select("doc_id", "file_name", "page_label", "content_type", "text")
