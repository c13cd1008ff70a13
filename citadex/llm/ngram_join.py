"""Jaccard join of documents on their sets of word n-grams, by rare-first prefixes.

Two sets of sizes x >= y that reach p / q share at least ceil(p (x + y) / (p + q)) n-grams, so in any order that all sets
have in common they share one of the first x - ceil(p x / q) + 1 n-grams of each (the prefix). The order here is by
document frequency, rarest first. An n-gram that no other set holds finds nobody, so a set with more than
x - ceil(p x / q) of them has no link and leaves, and of the others only shared n-grams of the prefix are joined. Most
sets leave after one of four n-grams has been counted over the whole corpus: what they hold alone among those is too much
already. All n-grams of the sets that stay are then counted among these sets, which is an order like any other. N-grams that make up a noticeable share of the corpus are found beforehand by counter summaries of
fixed size; they come last in the order and are never counted by key.

Sets that are equal are one node. In a bucket (all nodes with one prefix n-gram) everything is compared with the best
connected member; members that end in another component than that one are compared, in blocks, with all members of other
components, so that no link between components is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from citadex.llm.common import LOWER, mix
from citadex.llm.components import connected
from citadex.llm.shingles import BASE, word_hashes
from citadex.session import broadcast_within, staged

#: A-Z folded, every white space of ASCII a space; all else belongs to words.
SPACED = bytes(0x20 if b in b" \t\n\v\f\r" else LOWER[b] for b in range(256))
#: Counters of a summary; n-grams with more than a few parts in so many of all occurrences are sure to be in it.
COUNTERS = 1 << 16
#: Places of the order that frequent n-grams share.
LAST = (1 << 31) - 1
#: N-grams of one block of a bucket.
BLOCK = 1 << 20
#: One n-gram in so many is counted first.
SCREEN = 4
MEMBERS = "doc_id long, key binary, n long, score double, ranked binary, grams array<struct<gram: long, place: int>>"


def ngrams(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; a text with fewer words is one n-gram, one without words has none."""
    words = word_hashes(text, SPACED) if text else np.empty(0, np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(BASE) + words[i : i + len(out)])
    return np.unique(out)


class Summary:
    """At most `size` counters for any number of keys (Misra and Gries): a count is too low by total / size at most."""

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.total += len(keys)
        new, seen = np.unique(keys, return_counts=True)
        self.keys, at = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, seen))).astype(np.int64)
        if len(self.keys) > self.size:
            self.counts = self.counts - np.partition(self.counts, -self.size - 1)[-self.size - 1]
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]


def screened(grams: np.ndarray) -> np.ndarray:
    return grams[grams % np.uint64(SCREEN) == 0]


def _sketches(docs: DataFrame, size: int, counters: int) -> DataFrame:
    """Rows of documents (doc_id, body, key of the set, n, n-grams of the screen) and of frequent n-grams (gram, seen)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        names = ["doc_id", "body", "key", "n", "screened", "gram", "seen"]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                sets = [ngrams(t.as_py(), size) for t in part.column(2)]
                summary.add(np.concatenate(sets))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                sizes, few = ([len(s) for s in x] for x in (sets, [screened(s) for s in sets]))
                columns = [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(few, pa.int64()), none, none]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        often = summary.counts >= max(2, summary.total // counters)
        none = pa.nulls(int(often.sum()), pa.int64())
        columns = [none, none, pa.nulls(len(none), pa.binary()), none, none, pa.array(summary.keys[often].view(np.int64)), pa.array(summary.counts[often])]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(sketch, "doc_id long, body long, key binary, n long, screened long, gram long, seen long")


def _occurrences(docs: DataFrame, size: int, frequent: np.ndarray, few: bool) -> DataFrame:
    """doc_id, gram, df of every n-gram that another document holds (`LAST` if it is frequent); with `few` of the screen.

    Frequent n-grams are salted, all others meet by key. 48 bits of a hash are counted: should two n-grams share them,
    their documents count together, which is as good an order.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [ngrams(t.as_py(), size) for t in part.column(1)]
                sets = [screened(s) for s in sets] if few else sets
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(s) for s in sets])
                grams = np.concatenate(sets) >> np.uint64(16)
                hot = np.isin(grams, frequent)
                salt = pa.array((ids % (1 << 20)).astype(np.int32), mask=~hot)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(grams.view(np.int64)), salt], names=["doc_id", "gram", "salt"])

    by_gram = Window.partitionBy("gram", "salt")
    counted = docs.mapInArrow(spread, "doc_id long, gram long, salt int").withColumn("df", F.count("*").over(by_gram).cast("int"))
    frequent_last = F.when(F.col("salt").isNotNull(), LAST).otherwise(F.col("df"))
    return counted.where("df > 1 OR salt IS NOT NULL").select("doc_id", "gram", frequent_last.alias("df"))


def _members(found: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """Sets in rare-first order, with the shared n-grams of their prefix. `found` has doc_id, text, shared (gram, df)."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32())]))
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            out: list[list] = [[] for _ in range(5)]
            for text, shared in zip(batch.column(1), batch.column(2), strict=True):
                grams = ngrams(text.as_py(), size)
                known = np.asarray(shared.values.field("gram")).astype(np.uint64)
                order = np.argsort(known)
                known, often = known[order], np.asarray(shared.values.field("df"))[order].astype(np.int64)
                short = grams >> np.uint64(16)
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                df = np.where(known[at] == short, often[at], 1)
                order = np.lexsort((grams, df))
                ranked, df = grams[order], df[order]
                n = len(ranked)
                prefix = n - -(-p * n // q) + 1
                places = np.flatnonzero(df[:prefix] > 1)
                out[0].append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                out[1].append(n)
                out[2].append(float(np.log2(df).mean()))
                out[3].append(ranked.tobytes())
                out[4].append([{"gram": g, "place": i} for g, i in zip(ranked[places].view(np.int64).tolist(), places.tolist(), strict=True)])
            kinds = (pa.binary(), pa.int64(), pa.float64(), pa.binary(), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "key", "n", "score", "ranked", "grams"])

    return found.mapInArrow(rank, MEMBERS)


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column, p: int, q: int) -> Column:
    """Length filter, and positional filter at an n-gram that both have at these places."""
    least = F.ceil((n_a + n_b) * p / F.lit(p + q))  # doubles are exact enough: sizes are far below 2^52 / p
    return (q * F.least(n_a, n_b) >= p * F.greatest(n_a, n_b)) & (F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b) >= least)


def cells(grams: np.ndarray, n: int) -> np.ndarray:
    """How many n-grams lie between fixed pivots of the hash space, up to 512 of them and about as many as n-grams."""
    bits = min(9, max(6, (n - 1).bit_length()))
    return np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """The same between fewer pivots."""
    return counts.reshape(*counts.shape[:-1], n, -1).sum(axis=-1)


def packed_cells(counts: np.ndarray) -> bytes:
    return struct.pack("<H", len(counts)) + pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked_cells(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<H", data)[0]
    return np.frombuffer(pa.decompress(data[2:], decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, p: int, q: int) -> bool:
    """Suffix filter behind a shared n-gram at these places, then the exact overlap. Sets in the common order."""
    least = -(-p * (len(a) + len(b)) // (p + q))
    n = min(len(a), len(b))
    bound = min(at_a, at_b) + 1 + int(np.minimum(cells(a[at_a + 1 :], n), cells(b[at_b + 1 :], n)).sum())
    return bound >= least and len(np.intersect1d(a, b, assume_unique=True)) >= least


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links among pairs (a, b, at_a, at_b)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(batch["at_a"].to_pylist(), batch["at_b"].to_pylist(), batch["set_a"], batch["set_b"], strict=True)
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), i, j, p, q) for i, j, x, y in at]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("ranked").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("ranked").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "at_a", "at_b", "set_a", "set_b").mapInArrow(verify, "a long, b long")


def _block_pairs(outside: pa.Table, members: pa.Table, p: int, q: int, best: int | None) -> pa.Table:
    """Pairs of `outside` and members of other components that pass the length, positional and suffix filters.

    A link is sure to pass in the bucket of the first n-gram that both prefixes hold, and before that they share nothing:
    so the filters count this n-gram and what lies behind it, and a pair hardly passes in later buckets again. With `best` only so many with the highest bounds per row and other component; `cut` says
    that some were left.
    """
    sizes, places = members["n"].to_numpy(), members["place"].to_numpy()
    ids, labels = members["node"].to_numpy(), members["label"].to_numpy()
    bodies = [unpacked_cells(x) for x in members["behind"].to_pylist()]
    widths = np.array([len(x) for x in bodies], np.int64)
    #: number of cells -> members that have so many, their cells
    held = {w: (np.flatnonzero(widths == w), np.stack([bodies[i] for i in np.flatnonzero(widths == w)])) for w in np.unique(widths).tolist()}
    fewer: dict[tuple[int, int], np.ndarray] = {}
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for node, label, n, place, own in zip(*(outside[c].to_pylist() for c in ("node", "label", "n", "place", "behind")), strict=True):
        mine = unpacked_cells(own)
        least = -(-p * (sizes + n) // (p + q))
        good = (labels != label) & (q * np.minimum(sizes, n) >= p * np.maximum(sizes, n))
        good &= np.minimum(sizes - places, n - place) >= least
        bound = np.zeros(len(sizes), np.int64)
        for width, (rows, counts) in held.items():
            if not good[rows].any():
                continue
            w = min(width, len(mine))
            if width > w:
                counts = fewer.setdefault((width, w), folded(counts, w))
            some = np.flatnonzero(good[rows])
            bound[rows[some]] = np.minimum(counts[some], folded(mine, w)).sum(axis=1)
        bound += 1
        some = np.flatnonzero(good & (bound >= least))
        passed = len(some)
        if best is not None and passed > best:
            order = some[np.lexsort((ids[some], least[some] - bound[some], labels[some]))]
            nth = np.arange(len(order)) - np.searchsorted(labels[order], labels[order])
            some = order[nth < best]
        # one order for both ways to meet a pair
        a, b = np.minimum(ids[some], node), np.maximum(ids[some], node)
        flip = ids[some] < node
        for column, value in zip(out, (a, b, np.where(flip, places[some], place), np.where(flip, place, places[some]), np.full(len(some), passed > len(some))), strict=True):
            column.append(value)
    kinds = {"a": pa.int64(), "b": pa.int64(), "at_a": pa.int64(), "at_b": pa.int64(), "cut": pa.bool_()}
    return pa.table({c: pa.array(np.concatenate(v) if v else [], kind) for (c, kind), v in zip(kinds.items(), out, strict=True)})


def _pairs_of(p: int, q: int, best: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda outside, members: _block_pairs(outside, members, p, q, best)


def _links(members: DataFrame, p: int, q: int) -> DataFrame:
    """node, label of every node with a link."""
    postings = members.select("node", "n", "score", F.explode("grams").alias("at")).select("node", "n", "score", "at.*")
    sizes = staged(postings.groupBy("gram").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).where("size > 1"), "buckets")
    shared = staged(postings.join(sizes.select("gram"), "gram"), "postings")
    hub = F.max(F.struct("score", (-F.col("node")).alias("minus"), "n", "place"))
    hubs = shared.groupBy("gram").agg(hub.alias("hub")).select("gram", (-F.col("hub.minus")).alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.place").alias("at_b"))
    hubs = staged(hubs, "hubs")
    near = shared.join(hubs, "gram").where(F.col("node") != F.col("b")).where(_possible(F.col("n"), F.col("place"), F.col("n_b"), F.col("at_b"), p, q))
    pairs = near.groupBy(F.col("node").alias("a"), "b").agg(F.min(F.struct("place", "at_b")).alias("at")).select("a", "b", F.col("at.place").alias("at_a"), "at.at_b")
    pairs = staged(pairs, "pairs")
    sets = members.select("node", "ranked")
    links = staged(_verified(pairs, sets, p, q), "links")
    labels = connected(links)

    # buckets in which members of several components are left: the likeliest pairs first, then all that are left
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    columns, keys = ["node", "label", "n", "place", "behind"], ["gram", "part", "turn"]
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for best in (2, None):
        open_ = staged(_open_buckets(shared, hubs, sizes, labels), "open")
        if open_.isEmpty():
            break
        open_ = staged(_with_cells(open_, sets), "open-cells")
        left = open_.where("label <> main").select("gram", every("grams").alias("part"), own("outside").alias("turn"), *columns)
        right = open_.select(F.col("gram").alias("gram"), own("grams").alias("part"), every("outside").alias("turn"), *(F.col(c).alias(c) for c in columns))
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pairs_of(p, q, best), "a long, b long, at_a long, at_b long, cut boolean")
        seen = met.groupBy("a", "b").agg(F.min(F.struct("at_a", "at_b")).alias("at"), F.max("cut").alias("cut")).select("a", "b", "at.*", "cut")
        seen = staged(seen, "more-pairs")
        more = staged(_verified(seen.drop("cut").join(done, ["a", "b"], "left_anti"), sets, p, q), "more")
        if not more.isEmpty():
            links = links.union(more)
            labels = connected(links)
        if seen.where("cut").isEmpty():
            break
        done = done.union(seen.select("a", "b"))
    return labels


def _with_cells(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """`rows` (node, place and others) with `behind`, the cells of what lies behind the place. A set moves once."""
    others = [c for c in rows.columns if c != "node"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, at, body in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ranked = np.frombuffer(body.as_buffer(), np.uint64)
                table = at.values
                for start in range(0, len(table), 1024):
                    part = table.slice(start, 1024)
                    behind = [packed_cells(cells(ranked[i + 1 :], len(ranked))) for i in part.field("place").to_pylist()]
                    columns = [pa.array([node.as_py()] * len(part), pa.int64()), *(part.field(c) for c in others), pa.array(behind, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", *others, "behind"])

    schema = StructType([rows.schema["node"], *(rows.schema[c] for c in others), StructField("behind", BinaryType())])
    lists = rows.groupBy("node").agg(F.collect_list(F.struct(*others)).alias("at")).join(sets, "node").select("node", "at", "ranked")
    return lists.mapInArrow(add, schema)


def _open_buckets(shared: DataFrame, hubs: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component: label, main (that of the hub), n-grams in all and outside it."""

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        found = labels.select(F.col("node").alias(node), F.col("label").alias(name))
        return df.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    main = labelled(hubs.select("gram", "b"), "b", "main").select("gram", "main")
    wide = labelled(shared.select("gram", "node", "n", "place"), "node", "label").join(main, "gram")
    outside = wide.where("label <> main").groupBy("gram").agg(F.sum("n").alias("outside"))
    return wide.join(outside, "gram").join(sizes.where("size > 2").select("gram", "grams"), "gram")


def ngram_components(
    docs: DataFrame, words: int = 4, threshold: tuple[int, int] = (85, 100), frequent: int = 1000, counters: int = COUNTERS, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`; the component id is its smallest doc_id.

    The set of a document is its distinct `words`-word n-grams (a text with fewer words is one n-gram); two documents
    are linked if the Jaccard similarity of their sets reaches p / q = `threshold`; components are the connected ones.
    Null texts and texts without words have no n-gram and are linked with nothing; a null doc_id takes no part and has
    a null component. Repeated rows get equal rows; rows of one id with other texts are documents of their own under
    that id; an empty table gives no rows; other columns are not looked at. Very long texts are one set each.

    N-grams estimated at `frequent` occurrences or more, and at one in `counters` of all, come last in the order and are
    dealt out by document; all others are counted by key. Counts, and at most `counters` n-grams, reach the driver.
    """
    p, q = threshold
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    rows = staged(_sketches(picked, words, counters), "sketches")
    sketches = rows.where("gram IS NULL").select("doc_id", "body", "key", "n", "screened")
    some = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
    total = sketches.agg(F.sum("n")).first()[0] or 0
    often = rows.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(frequent, total // counters))
    hot = np.array([r["gram"] for r in often.select("gram").collect()], np.int64).view(np.uint64)  # at most `counters`
    hot = np.unique(hot >> np.uint64(16))

    firsts = staged(some.groupBy("key").agg(F.min(F.struct("doc_id", "body")).alias("first"), F.first("n").alias("n"), F.first("screened").alias("screened")).select("key", "first.*", "n", "screened"), "firsts")
    others = some.join(firsts.select("key", F.col("doc_id").alias("first_id"), F.col("body").alias("first_body")), "key")
    copies = staged(others.where((F.col("doc_id") != F.col("first_id")) | (F.col("body") != F.col("first_body"))).select("doc_id", "body").distinct(), "copies")
    bodies = picked.where("doc_id IS NOT NULL").join(broadcast_within(copies, 64 * copies.count()), ["doc_id", "body"], "left_anti")

    alone = firsts.groupBy("doc_id").agg(F.min("screened").alias("screened"), F.max(F.col("n") - F.ceil(F.col("n") * p / F.lit(q))).alias("most"))
    met = _occurrences(bodies.select("doc_id", "text"), words, hot, few=True).groupBy("doc_id").agg(F.count("*").alias("met"))
    stay = alone.join(met, "doc_id", "left").where(F.col("screened") - F.coalesce("met", F.lit(0)) <= F.col("most")).select("doc_id")
    stay = staged(stay, "candidates")
    bodies = bodies.join(broadcast_within(stay, 64 * stay.count()), "doc_id", "left_semi")

    lists = _occurrences(bodies.select("doc_id", "text"), words, hot, few=False).groupBy("doc_id").agg(F.collect_list(F.struct("gram", "df")).alias("shared"))
    needed = firsts.groupBy("doc_id").agg(F.min("n").alias("n"))
    kept = staged(lists.join(needed, "doc_id").where(q * F.size("shared") >= p * F.col("n")).select("doc_id", "shared"), "shared")
    wanted = broadcast_within(kept, int(kept.agg(F.sum(F.size("shared") * 16 + 64)).first()[0] or 0))
    members = _members(bodies.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "shared"), words, p, q)
    members = staged(members.dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id()), "members")

    labels = _links(members, p, q)
    named = labels.join(members.select("node", "key", "doc_id"), "node")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = named.join(smallest, "label").select("key", "component_id")
    owner = staged(firsts.select("key", "doc_id").join(found, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id")), "owner")
    joined = sketches.join(owner, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
