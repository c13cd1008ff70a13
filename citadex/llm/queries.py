"""One query per operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from citadex.llm.alignment import cross_tokenizer
from citadex.llm.centroids import cluster_vectors
from citadex.llm.common import fold_of, table
from citadex.llm.decontaminate import contamination, find_items
from citadex.llm.html_text import main_text
from citadex.llm.language import guess_language, learn_profiles, training_rows
from citadex.llm.language_model import score_texts
from citadex.llm.near_duplicates import near_duplicates
from citadex.llm.nearest import nearest
from citadex.llm.ngram_join import ngram_components
from citadex.llm.packing import pack
from citadex.llm.repeated_text import repeated_spans
from citadex.llm.token_counts import count_tokens
from citadex.llm.url_filter import UrlRules, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = UrlRules(
    block=("com/en/", "example.net/de/8", "org/es/"), allow=("example.com/en/7", "net/de/"),
    labels=("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"),
)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and listed host labels over every page."""
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = """
WITH rules(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
best AS (SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS action
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, CASE WHEN list_has_any(string_split(p.host, '.'),
  ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON b.page_id = p.page_id
"""


@query
def op5_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes in 50-byte strings that a document with a smaller id shows."""
    return repeated_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("spans")


@query
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item against every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination(find_items(docs, table(spark, folder, "benchmark"))).drop("text")


ORACLES["op6_decontaminate"] = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS pattern FROM starts),
sizes AS (SELECT DISTINCT n FROM patterns),
grams AS (SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS i, w FROM words, sizes s WHERE len(w) >= s.n),
hits AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS pattern FROM grams) g JOIN patterns p ON p.n = g.n AND p.pattern = g.pattern),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN found f ON f.doc_id = w.doc_id
"""


@query
def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector against all others."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    counts = count_tokens(F.col("text"), tokenizer_path("byte_bpe_50k.tiktoken")).alias("counts")
    return table(spark, folder, "documents").select("doc_id", counts).select("doc_id", "counts.*")


@query
def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document into sequences of 2048 tokens, mixed by source."""
    return pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every document: five-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; profiles from four fifths of the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(training_rows(docs, 5, 0))
    guessed = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), guess_language(F.col("text"), profiles).alias("guess"))
    return guessed.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


@query
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document under a bigram model of six sevenths of them."""
    return score_texts(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose four-word shingles overlap by 0.85 or more."""
    return ngram_components(table(spark, folder, "documents"))


ORACLES["op11_ngram_join"] = """
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
found AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.both >= 85 * (x.n + y.n - s.both)),
links AS MATERIALIZED (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@query
def op12_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under two public tokenizers, aligned and linked."""
    return cross_tokenizer(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Five exact rounds over every vector of 64 components, then the last assignment."""
    return cluster_vectors(table(spark, folder, "embeddings"))


_ROUND = """
near{i} AS (SELECT vec_id, n, v, CAST(min(d * 64 + c) % 64 AS INT) AS cluster, CAST(min(d * 64 + c) // 64 AS BIGINT) AS distance
  FROM (SELECT x.vec_id, x.n, x.v, k.c, list_sum(list_transform(range(1, 65), lambda i: CAST((x.v[i] - k.v[i]) * (x.v[i] - k.v[i]) AS HUGEINT))) AS d FROM kept x, c{i} k) GROUP BY ALL),
"""
_MOVE = """
s{i} AS (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM near{i}, range(1, 65) r(j) GROUP BY cluster, j),
m{i} AS (SELECT cluster, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY cluster),
c{n} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN m{i} m ON m.cluster = k.c),
"""
ORACLES["op13_centroids"] = (
    """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT 40),"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, n=i + 1) for i in range(5)).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    + _ROUND.format(i=5)
    + """
per AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near5 GROUP BY cluster)
SELECT n.vec_id, n.cluster, n.distance, p.cluster_inertia, CAST((SELECT sum(distance) FROM near5) AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near5 n JOIN per p ON p.cluster = n.cluster JOIN c5 c ON c.c = n.cluster
"""
)
