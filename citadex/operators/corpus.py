"""Corpus preparation: from documents, tables, captions and pages to nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.settings import CAPTION_KEYWORDS, CAPTION_MIN_CHARS, CHUNK_OVERLAP, CHUNK_SIZE


def unified_metadata(df: DataFrame) -> DataFrame:
    """Give every node `file_name` and `page_label`, whichever of the two key sets it came with."""
    has = set(df.columns)
    base = F.substring_index("source_path", "/", -1) if "source_path" in has else F.lit(None)
    page = F.col("page_number").cast("string") if "page_number" in has else F.lit(None)
    file_name = F.coalesce(F.col("file_name"), base) if "file_name" in has else base
    page_label = F.coalesce(F.col("page_label"), page) if "page_label" in has else page
    return df.withColumns({"file_name": file_name, "page_label": page_label})


def _deduplicated(header: Column) -> Column:
    """Repeated names get their 0-based position as a suffix; earlier results count as taken."""

    def add(done: Column, i: Column) -> Column:
        name = F.get(header, i)
        taken = F.concat(name, F.lit("_"), i.cast("string"))
        return F.concat(done, F.array(F.when(F.array_contains(done, name), taken).otherwise(name)))

    empty = F.array().cast("array<string>")
    return F.aggregate(F.sequence(F.lit(0), F.size(header) - 1), empty, add)


def normalise_tables(df: DataFrame, rows: str = "rows", min_rows: int = 1) -> DataFrame:
    """First row becomes the header; adds header, body, counts, JSON and markdown.

    Tables without at least `min_rows` rows under the header are left out. Short rows are filled
    with nulls, and columns without a name are called `column_i`.
    """
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.coalesce(F.get(F.col("_raw"), i), F.concat(F.lit("column_"), i.cast("string"))),
    )
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    out = (
        df.where(F.size(rows) > min_rows)
        .withColumn("_raw", F.element_at(rows, 1))
        .withColumn("_names", padded)
        .withColumn("header", _deduplicated(F.col("_names")))
        .withColumn(
            "body",
            F.transform(
                F.slice(rows, 2, F.size(rows)),
                lambda r: F.transform(F.sequence(F.lit(0), F.size("header") - 1), lambda i: F.get(r, i)),
            ),
        )
    )
    records = F.transform("body", lambda r: F.map_from_arrays(F.col("header"), r))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("header", lambda _: F.lit("---")), "|"), F.lit("|"))
    return out.withColumns({
        "row_count": F.size("body"),
        "column_count": F.size("header"),
        "table_json": F.to_json(records, {"ignoreNullFields": "false"}),
        "table_markdown": F.concat_ws(
            "\n", F.array(bar(F.col("header")), rule), F.transform("body", bar)
        ),
        "content_type": F.lit("table"),
    }).drop("_raw", "_names", rows)


def find_captions(
    df: DataFrame, keywords: Sequence[str] = CAPTION_KEYWORDS, text: str = "text"
) -> DataFrame:
    """Lines that hold a keyword and are longer than ten characters, numbered from 1."""
    keep = [c for c in df.columns if c not in (text, "content_type")]
    lines = df.select(*keep, F.posexplode_outer(F.split(text, "\n")).alias("_at", "_line"))
    caption = tx.strip(F.col("_line"))
    return (
        lines.where(tx.contains_any(F.lower("_line"), keywords))
        .select(*keep, (F.col("_at") + 1).alias("line_number"), caption.alias("caption_text"))
        .where(F.length("caption_text") > CAPTION_MIN_CHARS)
    )


def artefact_nodes(
    tables: DataFrame | None = None, captions: DataFrame | None = None, images: DataFrame | None = None
) -> DataFrame:
    """Table, caption and image records as nodes with a text and their own metadata columns."""
    name = F.substring_index("source_path", "/", -1)
    place = lambda kind: F.concat(
        F.lit(f"{kind} from "), name, F.lit(", page "), F.col("page_number").cast("string"), F.lit(":")
    )
    common = lambda kind: [F.lit(kind).alias("content_type"), "source_path", "page_number"]
    parts = []
    if tables is not None:
        parts.append(tables.select(
            *common("table"), "table_index", "row_count", "column_count", "table_json",
            F.concat(place("Table"), F.lit("\n"), F.col("table_markdown")).alias("text"),
        ))
    if captions is not None:
        parts.append(captions.select(
            *common("figure_caption"), "line_number", F.col("caption_text").alias("text")
        ))
    if images is not None:
        parts.append(images.select(
            *common("image"), "image_index", "width", "height", F.col("bbox").cast("string").alias("bbox"),
            F.concat(place("Image"), F.lit(" "), F.col("caption")).alias("text"),
        ))
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return unified_metadata(nodes)


def _exploded_chunks(df: DataFrame, chunks: Column, text: str, key: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    # Outer, so that no filter on the array is put below, which would cut every text twice.
    cut = df.select(*keep, F.posexplode_outer(chunks).alias("chunk_ix", text)).where(F.col(text).isNotNull())
    return cut.withColumn(
        "node_id", F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_ix").cast("string"))
    )


def chunk_window(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Windows of `size` words that share `overlap` words; other columns are inherited."""
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - overlap) / step), F.lit(1)).cast("int") - 1
        cut = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")
        )
        return F.when(F.size(w) > 0, cut)

    return _exploded_chunks(df, tx.let(tx.words(F.col(text)), windows), text, key)


def chunk_sentences(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Whole sentences packed up to `size` words; the next chunk repeats up to `overlap` words.

    Sentences end at a line, and at punctuation before white space; one of more than `size` words is cut into pieces. A
    fold over the pieces closes a chunk where the next piece would not fit, and goes back by as many pieces as `overlap`
    and that next piece allow. All of it is one expression over the words of a text.
    """

    def pieces(words: Column) -> Column:
        last = F.ceil(F.size(words) / size).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * size + 1, F.lit(size)))

    sentences = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])(?=\s)|\n", -1), tx.words), lambda w: F.size(w) > 0)

    def chunks(p: Column) -> Column:
        return tx.let(_running(F.transform(p, F.size)), lambda sums: tx.let(_cuts(sums, size, overlap), lambda cuts: F.transform(
            cuts, lambda c: F.array_join(F.flatten(F.slice(p, c["start"] + 1, c["stop"] - c["start"])), " ")
        )))

    return _exploded_chunks(df, tx.let(F.flatten(F.transform(sentences, pieces)), lambda p: F.when(F.size(p) > 0, chunks(p))), text, key)


def _running(sizes: Column, block: int = 256) -> Column:
    """0 and the running sums. In two levels, as every step of a fold copies the array that it extends."""

    def sums(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda done, v: F.array_append(done, F.element_at(done, -1) + v))

    last = F.greatest(F.ceil(F.size(sizes) / block).cast("int"), F.lit(1)) - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: sums(F.slice(sizes, b * block + 1, F.lit(block))))

    def joined(x: Column) -> Column:
        bases = sums(F.transform(x, lambda own: F.element_at(own, -1)))
        return tx.let(bases, lambda base: F.array_append(
            F.flatten(F.transform(x, lambda own, b: F.transform(F.slice(own, 1, F.size(own) - 1), lambda v: v + F.get(base, b)))), F.element_at(base, -1)
        ))

    return tx.let(blocks, joined)


def _cuts(sums: Column, size: int, overlap: int) -> Column:
    """First piece and end of every chunk; `sums` holds the words before each piece, and of all."""
    n = F.size(sums) - 1
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, i: Column) -> Column:
        here, after, first = F.get(sums, i), F.get(sums, i + 1), state["start"]
        floor = here - F.least(F.lit(overlap), size - (after - here))
        kept = F.size(F.filter(F.slice(sums, first + 1, i - first), lambda x: x >= floor))
        full = after - F.get(sums, first) > size
        return F.struct(
            F.when(full, i - kept).otherwise(first).alias("start"),
            F.when(full, F.array_append(state["cuts"], F.struct(first.alias("start"), i.alias("stop")))).otherwise(state["cuts"]).alias("cuts"),
        )

    start = F.struct(F.lit(0).alias("start"), none.alias("cuts"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.array_append(s["cuts"], F.struct(s["start"].alias("start"), n.alias("stop"))))


# What is no mark-up of the page: comments, scripts, styles.
UNSEEN = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
ATTRIBUTE_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Kind of block, the content type its node gets, and the pattern whose first group is its content.
BLOCK_PATTERNS = (
    ("heading", "text", r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>"),
    ("paragraph", "text", r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"),
    ("list_item", "text", r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"),
    ("link", "text", r"(?is)<a\s(?:[^>]*?\s)?href" + ATTRIBUTE_VALUE),
    ("table", "table", r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"),
    ("image", "image", r"(?is)<img\s(?:[^>]*?\s)?alt" + ATTRIBUTE_VALUE),
    ("caption", "figure_caption", r"(?is)<figcaption(?:\s[^>]*)?>(.*?)</figcaption>"),
)


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Typed blocks of raw pages, in one pass over the mark-up; tags inside a block are removed.

    Comments, scripts and styles hold no blocks. Attribute values may be quoted either way or bare.
    """
    keep = [c for c in pages.columns if c != html]
    seen = F.regexp_replace(F.col(html), UNSEEN, "")

    def found(kind: str, content_type: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(seen, F.lit(pattern), F.lit(1)),
            lambda body, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(content_type).alias("content_type"),
                i.alias("block_ix"), (F.regexp_replace(body, "^[\"']|[\"']$", "") if ATTRIBUTE_VALUE in pattern else body).alias("body"),
            ),
        )

    blocks = F.concat(*[found(*spec) for spec in BLOCK_PATTERNS])
    plain = tx.strip(F.regexp_replace("body", r"(?s)<[^>]*>", ""))
    return (
        pages.select(*keep, F.inline_outer(blocks))
        .select(*keep, "kind", "content_type", "block_ix", plain.alias("text"))
        .where(F.col("text") != "")
    )


def ingest_summary(nodes: DataFrame) -> DataFrame:
    """Node counts per file and content type."""
    return nodes.groupBy("file_name", "content_type").agg(F.count("*").alias("n_nodes"))
