"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citadex.settings import BM25_B, BM25_EPSILON, BM25_K1, SCORE_DIGITS


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def bm25_floored_idf(n: Column, df: Column, mean_idf: Column) -> Column:
    """Idf, where a negative value gives way to a share of the mean over all terms."""
    idf = bm25_idf(n, df)
    return F.when(idf < 0, mean_idf * BM25_EPSILON).otherwise(idf)


def bm25_term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
