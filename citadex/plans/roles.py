"""The parts that the given tables play: corpus, questions, vectors, log, votes, glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators.lexical import LexicalIndex, build_lexical_index
from citadex.session import spread

PREFIXES = ("what is ", "how to ", "error ", "compare ", "voltage ", "")


def _prefix(n: Column) -> Column:
    out = F.lit(PREFIXES[5])
    for i, prefix in enumerate(PREFIXES[:5]):
        out = F.when(F.pmod(n, F.lit(6)) == i, F.lit(prefix)).otherwise(out)
    return out


class Roles:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df

    def nodes(self) -> DataFrame:
        """Documents as corpus nodes."""
        lang = F.col("lang")
        kind = F.when(lang == "de", "table").when(lang == "fr", "image").when(lang == "es", "figure_caption").otherwise("text")
        return self.table("documents").select(
            F.col("doc_id").alias("node_id"), F.col("source").alias("file_name"),
            F.pmod("doc_id", F.lit(50)).cast("string").alias("page_label"), kind.alias("content_type"), "text",
        )

    def index(self) -> LexicalIndex:
        return build_lexical_index(self.nodes())

    def queries(self) -> DataFrame:
        """Benchmark passages as questions, with a lead-in that sets the intent."""
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.concat(_prefix(F.col("item_id")), "text").alias("query")
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")

    def query_vectors(self) -> DataFrame:
        """The vector with the id of the question stands for the question; without one its embedding is null."""
        return self.queries().join(self.vectors().withColumnRenamed("node_id", "query_id"), "query_id", "left")

    def user_questions(self) -> DataFrame:
        """User turns with a lead-in."""
        n = F.col("conv_id") + F.col("turn")
        return self.table("conversations").where("role = 'user'").select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn",
            F.concat(_prefix(n), "text").alias("query"),
        )

    def log(self) -> DataFrame:
        """Events as the question log."""
        k = F.get_json_object("props", "$.k").cast("int")
        user = F.col("user_id").cast("string")
        return self.table("events").select(
            F.concat_ws("_", user, F.col("event_id").cast("string")).alias("query_id"), user.alias("user"),
            F.concat(F.lit("q"), k.cast("string")).alias("query_text"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("answer_text"),
            F.col("event_type").alias("intent_type"), ((100 - k) / 100).alias("intent_confidence"),
            F.array(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("sources"), (k / 100).alias("confidence"),
            F.floor(F.col("value") * 10).cast("long").alias("response_time_ms"),
            F.concat_ws("-", user, F.date_format("ts", "yyyyMMdd")).alias("session_id"), "ts", F.to_date("ts").alias("dt"),
        )

    def feedback(self) -> DataFrame:
        """Purchases as helpful votes, errors as unhelpful ones."""
        return self.log().where("intent_type IN ('purchase', 'error')").select(
            "query_id", "user", (F.col("intent_type") == "purchase").alias("is_helpful"), F.lit("").alias("feedback_text"), "ts"
        )

    def flat_feedback(self) -> DataFrame:
        """Labelled documents as rated answers in the flat layout."""
        d = F.col("doc_id")
        day = F.lpad((F.pmod(d, F.lit(28)) + 1).cast("string"), 2, "0")
        return self.table("labels").join(self.table("documents"), "doc_id").select(
            d.cast("string").alias("id"), F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00")).alias("timestamp"),
            F.when(F.col("toxic") == 0, F.col("source")).alias("user"),
            F.concat_ws(" ", F.lit("about"), "lang", F.pmod(d, F.lit(50)).cast("string")).alias("query"), F.col("text").alias("answer"),
            (F.col("quality") == 1).alias("is_helpful"), (F.pmod(d, F.lit(100)) / 100).alias("confidence"),
            F.concat(F.lit("intent"), F.pmod(d, F.lit(5)).cast("string")).alias("intent_type"),
            F.array("source", "lang").alias("sources"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("feedback_type"),
        )

    def corrections(self) -> DataFrame:
        """A second vote, a month later, on every toxic answer."""
        toxic = self.table("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
        return self.flat_feedback().join(toxic, "id").withColumns({
            "id": F.concat(F.lit("n"), "id"), "timestamp": F.replace("timestamp", F.lit("2024-01-"), F.lit("2024-02-")),
            "is_helpful": ~F.col("is_helpful"),
        }).select(*self.flat_feedback().columns)

    def glossary_raw(self) -> DataFrame:
        """Documents as glossary lines: first word, the rest, and pipe-separated aliases."""
        text = F.col("text")
        term = F.regexp_extract(text, r"^\s*([^\s.,]+)", 1)
        rest = F.regexp_replace(text, r"^\s*[^\s.,]+", "")
        alias = F.concat(F.lit(" "), "lang", F.lit(" | | "), "source", F.lit("|doc-"), F.col("doc_id").cast("string"))
        return self.table("documents").select(
            F.col("doc_id").alias("entry_id"), term.alias("term"), rest.alias("definition"), alias.alias("aliases")
        )

    def glossary_pages(self) -> DataFrame:
        """Documents whose lines read `word: rest`, or `word - rest` for every second one."""
        mark = F.when(F.pmod("doc_id", F.lit(2)) == 0, "$1$2: ").otherwise("$1$2 - ")
        return self.table("documents").select(
            "doc_id", F.regexp_replace("text", F.lit(r"(^|\n)(\S+) "), mark).alias("text")
        )

    def cache(self) -> DataFrame:
        """Documents as questions answered before; a repeated text keeps its last entry."""
        key = tx.cache_key(F.col("text"), F.lit(10), F.lit(0.5))
        last = self.table("documents").groupBy(key.alias("key")).agg(F.max("doc_id").alias("entry_id"))
        return last.select(
            "key", "entry_id", F.concat(F.lit("answer "), F.col("entry_id").cast("string")).alias("response"),
            F.col("entry_id").alias("inserted_at"),
        )

    def asked_again(self) -> DataFrame:
        """Plain benchmark passages after some blanks, with two settings of `top_k`."""
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.concat(F.lit("  "), "text").alias("query"),
            F.when(F.pmod("item_id", F.lit(4)) == 3, 5).otherwise(10).alias("top_k"), F.lit(0.5).alias("alpha"),
        )

    def document_log(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query_text"),
            F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer_text"), F.array("source", "lang").alias("sources"),
        )

    def document_votes(self) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
        return self.table("labels").select(
            F.col("doc_id").cast("string").alias("query_id"), (F.col("quality") == 1).alias("is_helpful"), at.alias("ts")
        )

    def raw_tables(self) -> DataFrame:
        """Lines of a document as rows of a table, under a header with a repeated name."""
        first = lambda line: F.regexp_extract(line, r"\S+", 0)
        row = lambda line: F.array(first(line), F.length(line).cast("string"), F.size(tx.words(line)).cast("string"))
        head = F.array(F.array(F.lit("word"), F.lit("size"), F.lit("size")))
        return self.table("documents").select(
            F.concat(F.lit("/data/"), "source", F.lit(".pdf")).alias("source_path"), F.pmod("doc_id", F.lit(50)).cast("int").alias("page_number"),
            F.col("doc_id").alias("table_index"), F.concat(head, F.transform(F.split("text", "\n"), row)).alias("rows"),
        )

    def raw_captions(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("/data/"), "source", F.lit(".pdf")).alias("source_path"),
            F.pmod("doc_id", F.lit(50)).cast("int").alias("page_number"), "doc_id", "text",
        )

    def raw_images(self) -> DataFrame:
        """Page titles as image captions."""
        title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
        return self.table("pages").select(
            F.col("url").alias("source_path"), F.pmod("page_id", F.lit(50)).cast("int").alias("page_number"),
            F.col("page_id").alias("image_index"), F.length("html").alias("width"), F.length("url").alias("height"),
            title.alias("caption"), F.lit(None).cast("string").alias("bbox"),
        )
