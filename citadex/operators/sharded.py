"""BM25 over an index that is sharded by node: no posting is shuffled by a search.

A shard holds all postings of its nodes, so it scores them alone and gives away its `k` best rows per question. Inside a
shard nodes fall into cells; the largest term count and the shortest length bound what a term adds to any node of a cell. A
question adds these bounds up per cell, takes cells by falling bound, and stops at the first cell whose bound
is below its k-th score so far. The table is bucketed by shard, so the groups of a search are there when it is scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from citadex.functions import text as tx
from citadex.session import shuffles_freed
from citadex.settings import BM25_B, BM25_K1, BYTES_PER_SHARD, CELLS, NODES_PER_SHARD, SCORE_DIGITS, SHARDS_IN_ONE_TURN, SHARDS_PER_PART, SHARDS_PER_SUM, TERMS_PER_SUM, TURNS

COUNTS = ["df", "max_tf", "min_dl"]
LISTS = ["cells", "sizes", "nodes", "tfs", "dls"]


@dataclass(frozen=True)
class Shards:
    """A block table: per shard and term the postings by cell (`nodes`, `tfs`, `dls`; `sizes` of them in each of `cells`).
    `dead` holds the ids of nodes that no longer count, `only` those of all that count; or None."""

    blocks: DataFrame
    n_shards: int
    dead: DataFrame | None = None
    only: DataFrame | None = None

    def postings(self) -> DataFrame:
        """node_id, dl, term, tf: the postings as rows. No list is empty; the outer explode keeps a filter off the scan."""
        rows = self.blocks.select("term", F.explode_outer(F.arrays_zip("nodes", "tfs", "dls")).alias("p"))
        rows = rows.select(F.col("p.nodes").alias("node_id"), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").alias("tf"))
        rows = rows if self.dead is None else rows.join(self.dead, "node_id", "left_anti")
        return rows if self.only is None else rows.join(self.only, "node_id", "left_semi")

    def restricted(self, allowed: DataFrame) -> Shards:
        """The same shards, of which only the nodes in `allowed` (node_id) count."""
        ids = allowed.select("node_id")
        return replace(self, only=ids if self.only is None else self.only.join(ids, "node_id", "left_semi"))

    def counts_of(self, nodes: DataFrame) -> DataFrame:
        """term, n, dl: in how many of the given nodes (node_id) a term is, per shard; without a term their number and length."""
        place = F.pmod(F.xxhash64("node_id"), F.lit(self.n_shards)).cast("int").alias("shard")
        own = self.blocks.select("shard", "term", "nodes", "dls").groupBy("shard")
        return own.cogroup(nodes.select(place, "node_id").groupBy("shard")).applyInArrow(_counts, "term string, n long, dl long")


def _counts(own: pa.Table, nodes: pa.Table) -> pa.Table:
    own = own.combine_chunks()
    if not (own.num_rows and nodes.num_rows):
        return pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "dl": pa.array([], pa.int64())})
    ids, lengths = own["nodes"].chunk(0), np.diff(own["nodes"].chunk(0).offsets.to_numpy())
    hit = pc.is_in(ids.flatten(), value_set=nodes["node_id"].combine_chunks())
    code = ids.flatten().filter(hit).dictionary_encode().indices.to_numpy().astype(np.int64)
    dl = own["dls"].chunk(0).flatten().filter(hit).to_numpy()
    width = int(dl.max(initial=0)) + 1
    documents = np.unique(code * width + dl)
    n = np.bincount(np.repeat(np.arange(own.num_rows), lengths)[hit.to_numpy(zero_copy_only=False)], minlength=own.num_rows)
    some = np.flatnonzero(n)
    terms = own["term"].combine_chunks().take(pa.array(some))
    return pa.table({
        "term": pa.concat_arrays([terms, pa.nulls(1, terms.type)]), "n": pa.array(np.append(n[some], len(documents)), pa.int64()),
        "dl": pa.array(np.append(np.zeros(len(some), np.int64), (documents % width).sum()), pa.int64()),
    })


def shard_count(n_nodes: int, n_bytes: int = 0) -> int:
    """By nodes and bytes of text, so that no task grows with the corpus; an index of less than a million nodes has smaller
    shards, up to 64, so that tasks can share the work."""
    return max(1, min(100_000, max(-(-n_nodes // NODES_PER_SHARD), -(-n_bytes // BYTES_PER_SHARD), min(64, -(-n_nodes // 1024)))))


def text_size(nodes: DataFrame) -> tuple[int, int]:
    """Nodes, and bytes of their texts."""
    row = nodes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    return row[0], row[1]


def blocks_of(nodes: DataFrame, n_shards: int) -> DataFrame:
    """The block table of some nodes. Tokens are shuffled once, by shard, as compressed texts; postings are counted inside the shards."""
    spot = F.xxhash64("node_id")
    cell = F.pmod(F.floor(spot / n_shards), F.lit(CELLS)).cast("int")
    said = F.coalesce(F.array_join(tx.tokens(F.col("text")), " "), F.lit(""))
    placed = nodes.select(F.pmod(spot, F.lit(n_shards)).cast("int").alias("shard"), cell.alias("cell"), "node_id", said.alias("said"))
    kind = nodes.schema["node_id"].dataType
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    packs = StructType([StructField(n, k) for n, k in (
        ("shard", IntegerType()), ("cells", ints), ("node_ids", ArrayType(kind)), ("n_bytes", LongType()), ("texts", BinaryType()),
    )])
    out = StructType([StructField(n, k) for n, k in (
        ("shard", IntegerType()), ("term", StringType()), ("n", LongType()), ("n_opens", LongType()), ("opens_dl", LongType()), ("cells", ints),
        ("sizes", ints), ("nodes", ArrayType(kind)), ("tfs", longs), ("dls", longs),
    )])
    return placed.mapInArrow(pack_texts, packs).repartition(n_shards, "shard").groupBy("shard").applyInArrow(block_rows, out)


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch and shard. Tokens hold no white space, so blanks part those of a document, and line ends the documents."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        if not batch.num_rows:
            continue
        order = np.argsort(batch["shard"].to_numpy(), kind="stable")
        shard = batch["shard"].to_numpy()[order]
        at = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        ends, blobs, sizes = pa.array(at.astype(np.int32)), [], []
        for low, high in zip(at[:-1], at[1:], strict=True):  # one shard at a time: the batch is not copied as a whole
            texts = pa.ListArray.from_arrays([0, high - low], batch["said"].take(pa.array(order[low:high])))
            text = pc.binary_join(texts, "\n")[0].as_buffer()
            sizes.append(text.size)
            blobs.append(codec.compress(text, asbytes=True))
        lists = [pa.ListArray.from_arrays(ends, batch[c].take(pa.array(order))) for c in ("cell", "node_id")]
        columns = [pa.array(shard[at[:-1]]), *lists, pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "cells", "node_ids", "n_bytes", "texts"])


def block_rows(packs: pa.Table) -> pa.Table:
    """The rows of one shard. Rows of one id and length count as one document."""
    codec = pa.Codec("zstd")
    packed = zip(packs["texts"], packs["n_bytes"].to_pylist(), strict=True)
    texts = pa.array([t for blob, n in packed for t in codec.decompress(blob.as_buffer(), n, asbytes=True).split(b"\n")], pa.string())
    tokens = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts), " ")
    ids = packs["node_ids"].combine_chunks().flatten().dictionary_encode(null_encoding="encode")
    dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, code = tokens.flatten().dictionary_encode(), ids.indices.to_numpy().astype(np.int64)
    cells = packs["cells"].combine_chunks().flatten().to_numpy().astype(np.int64)
    width = int(dl.max(initial=0)) + 1
    _, first, own = np.unique((cells * len(ids.dictionary) + code) * width + dl, return_index=True, return_inverse=True)
    n_docs = max(1, len(first))
    held = words.indices.to_numpy().astype(np.int64) * n_docs + np.repeat(own, dl)
    key, tf = np.unique(held, return_counts=True)
    opening = np.searchsorted(key, np.unique(held[(np.cumsum(dl) - dl)[dl > 0]]))
    term, doc = np.divmod(key, n_docs)
    doc = first[doc]
    at_term = np.flatnonzero(np.diff(term, prepend=-1))
    at_cell = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(cells[doc], prepend=-1) != 0))
    run = np.cumsum(np.diff(term, prepend=-1) != 0)[opening] - 1
    n_opens = np.bincount(run, minlength=len(at_term))
    opens_dl = np.bincount(run, dl[doc[opening]], minlength=len(at_term))
    posting = np.append(at_term, len(key)).astype(np.int32)
    cell = np.append(np.searchsorted(at_cell, at_term), len(at_cell)).astype(np.int32)
    lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    return pa.table({
        "shard": pa.array(np.full(len(at_term), packs["shard"][0].as_py() if packs.num_rows else 0), pa.int32()),
        "term": words.dictionary.take(pa.array(term[at_term])),
        "n": pa.array(np.diff(posting), pa.int64()), "n_opens": pa.array(n_opens, pa.int64()), "opens_dl": pa.array(opens_dl.astype(np.int64)),
        "cells": lists(cell, cells[doc[at_cell]], pa.int32()), "sizes": lists(cell, np.diff(np.append(at_cell, len(key))), pa.int32()),
        "nodes": pa.ListArray.from_arrays(pa.array(posting), ids.dictionary.take(pa.array(code[doc]))),
        "tfs": lists(posting, tf, pa.int64()), "dls": lists(posting, dl[doc], pa.int64()),
    })


def terms_of(blocks: DataFrame, n_shards: int) -> DataFrame:
    """term, df, max_tf, min_dl of a block table. A task sums up its shards before anything is shuffled, and packs the sums."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, n_shards // SHARDS_PER_PART)
    peaks = COUNTS[1:] if "max_tf" in blocks.columns else [F.array_max("tfs").alias("max_tf"), F.array_min("dls").alias("min_dl")]
    rows = blocks.select(
        F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", F.col("n").alias("df"), *peaks
    ).coalesce(max(cores, n_shards // SHARDS_PER_SUM))
    packs = rows.mapInArrow(pack_terms, "part int, n_terms long, n_bytes long, terms binary, counts binary")
    return packs.repartition(parts, "part").groupBy("part").applyInArrow(sum_terms, "term string, df long, max_tf long, min_dl long")


def _summed(rows: pa.Table, keys: list[str]) -> pa.Table:
    sums = rows.group_by(keys, use_threads=False).aggregate([("df", "sum"), ("max_tf", "max"), ("min_dl", "min")])
    return sums.select([*keys, "df_sum", "max_tf_max", "min_dl_min"]).rename_columns([*keys, *COUNTS])


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered up to a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TERMS_PER_SUM:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def pack_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part: its terms in order, which share their beginnings, and the bytes of the counts by place, which are mostly zero."""
    codec = pa.Codec("zstd", compression_level=3)
    for rows in _some(batches):
        sums = _summed(rows, ["part", "term"]).sort_by([("part", "ascending"), ("term", "ascending")]).combine_chunks()
        part = sums["part"].to_numpy()
        at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        counts = np.stack([sums[c].to_numpy() for c in COUNTS])
        sizes, terms, blobs = [], [], []
        for low, high in zip(at[:-1], at[1:], strict=True):
            text = pc.binary_join(pa.ListArray.from_arrays([0, high - low], sums["term"].chunk(0)[low:high]), "\n")[0].as_buffer()
            sizes.append(text.size)
            terms.append(codec.compress(text, asbytes=True))
            blobs.append(codec.compress(np.ascontiguousarray(counts[:, low:high]).reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True))
        columns = [pa.array(part[at[:-1]], pa.int32()), pa.array(np.diff(at)), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n_terms", "n_bytes", "terms", "counts"])


def sum_terms(packs: pa.Table) -> pa.Table:
    """The terms of one part."""
    codec, tables = pa.Codec("zstd"), []
    for pack in packs.to_pylist():
        terms = codec.decompress(pack["terms"], pack["n_bytes"], asbytes=True).split(b"\n")
        planes = np.frombuffer(codec.decompress(pack["counts"], 24 * pack["n_terms"]), np.uint8).reshape(8, -1)
        counts = np.ascontiguousarray(planes.T).view(np.int64).reshape(3, -1)
        tables.append(pa.table([pa.array(terms, pa.binary()).cast(pa.string()), *map(pa.array, counts)], ["term", *COUNTS]))
    return _summed(pa.concat_tables(tables), ["term"])


def block_table(path: str) -> str:
    """Name of the table that is declared over block files."""
    return f"blocks_{hashlib.md5(path.encode()).hexdigest()}"


def only_asked(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """A block table whose postings are null but for the terms in `asked` (term; small, broadcast); the counts of all terms stay."""
    kept = blocks.withColumns({"max_tf": F.array_max("tfs"), "min_dl": F.array_min("dls")})
    kept = kept.join(F.broadcast(asked.select("term", F.lit(True).alias("_asked"))), "term", "left")
    return kept.withColumns({c: F.when(F.col("_asked"), F.col(c)) for c in LISTS}).drop("_asked")


def write_blocks(nodes: DataFrame, n_shards: int, path: str, asked: DataFrame | None = None) -> DataFrame:
    """Write the block table of some nodes, in one bucket per shard, and read it back with its buckets; with `asked` see `only_asked`.

    Shards are made in turns. A turn scans the nodes, but moves only the texts of its own shards, so that no more of them lie
    in a shuffle at once.
    """
    spark, table = nodes.sparkSession, block_table(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    turns = 1 if n_shards < SHARDS_IN_ONE_TURN else TURNS
    shard = F.pmod(F.xxhash64("node_id"), F.lit(n_shards))
    for turn in range(turns):
        blocks = blocks_of(nodes if turns == 1 else nodes.where(shard % turns == turn), n_shards)
        blocks = blocks if asked is None else only_asked(blocks, asked)
        with shuffles_freed(spark):
            to = blocks.write.mode("append" if turn else "overwrite").option("path", path).option("compression", "zstd")
            to.bucketBy(n_shards, "shard").saveAsTable(table)
    return spark.table(table)


def _term_weight(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, SCORE_DIGITS)


class Shard:
    """Posting lists of one shard as arrays, and the search over them."""

    def __init__(self, blocks: pa.Table, dead: np.ndarray, avgdl: float, only: np.ndarray | None = None):
        blocks = blocks.combine_chunks()
        self.row = {t: i for i, t in enumerate(blocks["term"].to_pylist())}
        self.ids, self.nodes = np.unique(self._flat(blocks, "nodes"), return_inverse=True)
        self.alive = ~np.isin(self.ids, dead)
        if only is not None:
            self.alive &= np.isin(self.ids, only)
        tfs, dls = (self._flat(blocks, c).astype(np.float64) for c in ("tfs", "dls"))
        self.weights = _term_weight(tfs, dls, avgdl)
        self.cells, self.sizes = self._flat(blocks, "cells"), self._flat(blocks, "sizes")
        lengths = np.diff(blocks["cells"].chunk(0).offsets.to_numpy()) if len(blocks) else np.empty(0, np.int64)
        self.first_cell = np.concatenate(([0], np.cumsum(lengths)))
        self.first_node = np.concatenate(([0], np.cumsum(self.sizes)))
        peak = lambda f, values: f.reduceat(values, self.first_node[:-1]) if len(values) else values
        self.peaks = _term_weight(peak(np.maximum, tfs), peak(np.minimum, dls), avgdl)
        self.looked_at = 0

    @staticmethod
    def _flat(blocks: pa.Table, name: str) -> np.ndarray:
        if not len(blocks):
            return np.empty(0, np.int64)
        values = blocks[name].chunk(0).flatten()
        return values.to_numpy(zero_copy_only=False)

    def best(self, terms: list[str], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the `k` best living nodes with a positive score, ties by id."""
        rows = [(self.row[t], w) for t, w in zip(terms, weights, strict=True) if t in self.row]
        if not rows:
            return self.ids[:0], np.empty(0)
        at = np.concatenate([np.arange(self.first_cell[r], self.first_cell[r + 1]) for r, _ in rows])
        weight = np.repeat([w for _, w in rows], [self.first_cell[r + 1] - self.first_cell[r] for r, _ in rows])
        bound = np.bincount(self.cells[at], np.maximum(weight, 0) * self.peaks[at], minlength=CELLS)
        turn = np.empty(CELLS, np.int64)
        turn[np.argsort(-bound, kind="stable")] = np.arange(CELLS)
        falling = np.sort(bound)[::-1]
        order = np.argsort(turn[self.cells[at]], kind="stable")
        at, weight = at[order], weight[order]
        turns = turn[self.cells[at]]
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        low, step, floor = 0, 4, 0.0
        while low < CELLS and falling[low] > 0 and falling[low] >= floor - 10.0**-SCORE_DIGITS:
            some = slice(*np.searchsorted(turns, (low, low + step)))
            size = self.sizes[at[some]]
            begin = self.first_node[at[some]]
            p = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self.looked_at += len(p)
            ids, where = np.unique(self.nodes[p], return_inverse=True)
            total = np.bincount(where, np.repeat(weight[some], size) * self.weights[p], minlength=len(ids))
            found.append(ids[self.alive[ids]])
            scores.append(_rounded(total[self.alive[ids]]))
            so_far = np.concatenate(scores)
            if len(so_far) >= k:
                floor = max(0.0, np.partition(so_far, -k)[-k])
            low, step = low + step, 2 * step
        ids, score = (np.concatenate(x) if x else np.empty(0) for x in (found, scores))
        good = np.flatnonzero(score > 0)
        ids, score = ids[good].astype(np.int64), score[good]
        top = np.lexsort((ids, -score))[:k]
        return self.ids[ids[top]], score[top]


def search_shards(asked: DataFrame, keys: Sequence[str], shards: Shards, avgdl: float, k: int, wanted: DataFrame | None) -> DataFrame:
    """keys, node_id, score: the `k` best of every shard for every question. `asked` has the keys, terms and weights.

    Only questions are shuffled, one copy per shard. `wanted` (small, broadcast) cuts the scan to the terms asked for.
    """
    kind = shards.blocks.schema["nodes"].dataType.elementType
    fields = [asked.schema[c] for c in keys]
    out = StructType([*fields, StructField("node_id", kind), StructField("score", DoubleType())])
    blocks = shards.blocks if wanted is None else shards.blocks.join(F.broadcast(wanted), "term", "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards.n_shards - 1))).alias("shard")
    right = asked.select(every, F.lit("asked").alias("part"), *keys, "terms", "weights", F.lit(None).cast(kind).alias("node_id"))
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in (*keys, "terms", "weights")]
    for part, nodes in (("dead", shards.dead), ("only", shards.only)):
        if nodes is not None:
            place = F.pmod(F.xxhash64("node_id"), F.lit(shards.n_shards)).cast("int").alias("shard")
            right = right.unionByName(nodes.select(place, F.lit(part).alias("part"), *none, "node_id"))
    limited = shards.only is not None

    def best(own: pa.Table, rows: pa.Table) -> pa.Table:
        part = rows["part"].to_numpy()
        dead, only = (rows["node_id"].filter(pa.array(part == p)).to_numpy() for p in ("dead", "only"))
        is_asked = part == "asked"
        shard = Shard(own, dead, avgdl, only if limited else None)
        rows = rows.filter(pa.array(is_asked))
        at, ids, scores = [], [], []
        for i, (terms, weights) in enumerate(zip(rows["terms"].to_pylist(), rows["weights"].to_pylist(), strict=True)):
            node, score = shard.best(terms, weights, k)
            at.append(np.full(len(node), i))
            ids.append(node)
            scores.append(score)
        found = rows.select(list(keys)).take(pa.array(np.concatenate(at or [np.empty(0, np.int64)])))
        nodes = pa.array([i for part in ids for i in part.tolist()], own.schema.field("nodes").type.value_type)
        return found.append_column("node_id", nodes).append_column("score", pa.array(np.concatenate(scores or [np.empty(0)]), pa.float64()))

    return blocks.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(best, out)
