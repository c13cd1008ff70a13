"""Near copies, repeated text, neighbours, language model, token counts, packing, pipeline: brute force and odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from operator import itemgetter

import corpus_pipeline
import numpy as np
import pytest
import regex
from citadex.llm import language_model as lm
from citadex.llm import packing as pk
from citadex.llm import repeated_text as rt
from citadex.llm import token_counts as tc
from citadex.llm.components import connected
from citadex.llm.near_duplicates import keep_one, near_duplicates
from citadex.llm.nearest import nearest
from citadex.llm.shingles import bag, overlap, signature
from citadex.llm.suffix_array import maximal_repeats
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BPE = tokenizer_path("byte_bpe_50k.json")


def noisy(text, share, rng):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(9999)}" for w in text.split())


# --- near copies --------------------------------------------------------------------------------


def classes_by_hand(texts):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_overlap_counts_repeats():
    def by_hand(a, b):
        x, y = (Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in (a, b))
        return sum((x & y).values()) / sum((x | y).values())

    a, b = "a b c d e " * 6 + "f g h i j k", "a b c d e " * 4 + "f g h i j l m"
    assert overlap(bag(a), bag(b)) == pytest.approx(by_hand(a, b)) and 0 < by_hand(a, b) < 1


def test_signature_is_unbiased():
    rng, error = np.random.default_rng(0), []
    for top in (1, 2, 40):
        for _ in range(40):
            keys = np.sort(rng.integers(0, 1 << 62, 60).astype(np.uint64))
            a = rng.integers(1, top + 1, 60)
            b = np.where(rng.random(60) < 0.7, a, rng.integers(0, top + 1, 60))
            x, y = (keys, a), (keys[b > 0], b[b > 0])
            error.append((signature(*x) == signature(*y)).mean() - overlap(x, y))
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.07


def test_classes_equal_brute_force(documents, prose):
    rng = random.Random(1)
    base, other = prose(120), prose(300)
    texts = [base, *(noisy(base, 0.012, rng) for _ in range(25)), base.upper(), f"{base}.", other, noisy(other, 0.01, rng), other + " " + prose(20), *(prose(80) for _ in range(10)), "a b", "a b", "a b c", prose(30_000)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(texts, 4)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_odd_copies(documents, prose):
    a = prose(40)
    texts, ids = [a, a, a, None, None, "", "...", "...", a], [3, 3, 7, 1, 2, 4, 5, 6, None]
    docs = documents(texts, ids=ids)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"]) for r in near_duplicates(docs).collect())
    assert got == [(-1, None), (1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5), (6, 6), (7, 3)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("SELECT 100L, 90L"))
    got = {r["node"]: r["label"] for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}


# --- repeated text ------------------------------------------------------------------------------


def spans_by_hand(rows, n):
    """rows: (id, bytes)."""
    first = {}
    for i, b in rows:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    out = []
    for i, b in rows:
        covered = np.zeros(len(b) + 1, int)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                covered[p : p + n] = 1
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        out.append((i, len(b), int(covered.sum()), int((np.diff(covered, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_texts(prose):
    passage, other = prose(30), "é" * 40 + prose(12)
    return [
        f"{prose(20)} {passage} {prose(8)}", f"{passage}", f"x{passage}{other}", f"{other}{prose(9)}{passage[:60]}", passage[5:120] + passage[40:], None, "", "short",
        "Wher. " * 900, "a Wher. " + "Wher. " * 90 + "tail", "Wher. " * 900, other[1:], prose(3000) + passage[10:80], passage, f"{prose(5)}{passage[:49]}", "aaaa" * 100, "aaaa" * 12 + "a", "aaaa" * 13,
    ]


def test_removed_bytes_equal_brute_force(documents, prose, monkeypatch):
    texts = repeated_texts(prose)
    ids = [50 - i if i % 3 else i for i in range(len(texts))]
    want = spans_by_hand([(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)], 50)
    for hot in (4096, 2):  # every passage, then the way that common marks go
        monkeypatch.setattr(rt, "HOT_DOCUMENTS", hot)
        for parts in (1, 5):
            got = rt.repeated_spans(documents(texts, parts, ids=ids)).collect()
            assert sorted(tuple(r)[:5] for r in got) == want, (hot, parts)


def test_cut_texts(documents, prose):
    texts = repeated_texts(prose)
    docs = documents(texts, 3)
    cut = rt.without_repeats(docs)
    assert cut.schema.names == docs.schema.names and cut.dtypes == docs.dtypes
    was = {r["doc_id"]: r for r in docs.collect()}
    for r in cut.collect():
        i = r["doc_id"]
        assert (r["text"] is None) == (texts[i] is None) and r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["rest"] == was[i]["rest"]
    assert rt.without_repeats(docs.limit(0)).count() == 0 and rt.repeated_spans(docs.limit(0)).count() == 0
    same = rt.repeated_spans(documents([texts[1]] * 3 + [texts[1]], ids=[4, 4, None, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in same) == [(-1, len(texts[1])), (4, 0), (4, 0), (9, len(texts[1]))]


def test_maximal_repeats_of_small_strings():
    rng = random.Random(5)
    for _ in range(60):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))).encode() for _ in range(4)]
        places = {}
        for o, s in enumerate(strings):
            for p in range(len(s)):
                for q in range(p + 3, len(s) + 1):
                    places.setdefault(s[p:q], []).append((o, p))
        want = set()
        for sub, at in places.items():
            right = {strings[o][p + len(sub) : p + len(sub) + 1] or (o, p) for o, p in at}
            left = {strings[o][p - 1 : p] if p else (o, p) for o, p in at}
            if len(at) > 1 and len(right) > 1 and len(left) > 1:
                want.add((sub, tuple(sorted(at))))
        found = maximal_repeats(strings, 3)
        got = set()
        for g in range(len(found.length)):
            at = sorted((int(found.array.owner[k]), int(found.array.offset[k])) for k in found.suffix[found.group == g])
            got.add((strings[at[0][0]][at[0][1] : at[0][1] + int(found.length[g])], tuple(at)))
        assert got == want


# --- neighbours ---------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    body = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    same = [(i, [1.0] * 16) for i in range(3000, 3700)]
    odd = [(4000, None), (4100, [0.0] * 16), (4200, [float("nan")] * 16), (4300, [1.0, None] * 8), (4400, [float("inf")] * 16), (4500, [1.0]), (4600, [])]
    df = spark.createDataFrame(body + same + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).repartition(4)
    got = nearest(df, df.where("vec_id % 100 = 0")).collect()
    ids = np.array([i for i, _ in body + same])
    rows = np.array([v for _, v in body + same])
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {i for i in range(0, 3700, 100)}
    right = 0
    for q, found in by.items():
        d = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        right += len({int(x) for x in ids[np.lexsort((ids, d))[:10]]} & {f[0] for f in found})
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0])) and all(abs(d[i] - s) < 1e-12 for i, s in found)
    assert right >= 0.9 * 10 * len(by)
    assert [i for i, _ in by[3000]] == list(range(3001, 3011))
    few = df.where("vec_id < 4 OR vec_id = 4000")
    assert nearest(few, few).count() == 4 * 3
    assert nearest(df.limit(0), df.limit(0)).count() == 0 and nearest(df.where("vec_id = 4000"), df).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    body = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(i, [2.0] * 8) for i in range(600, 660)]
    df = spark.createDataFrame(body, "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    want = sorted(map(tuple, nearest(df, asked).collect()))
    assert len(want) == 14 * 10
    many = df.where("vec_id IN (0, 50)").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("copy")
    twice = df.union(df).union(many)
    got = sorted(map(tuple, nearest(twice, twice.where("vec_id % 50 = 0")).collect()))
    for q in {r[0] for r in want}:
        assert len({r[2] for r in got if r[0] == q}) == len([r for r in got if r[0] == q]) == 10, q
    assert len(set(map(itemgetter(0, 2), got)) & set(map(itemgetter(0, 2), want))) >= 0.9 * len(want)
    # an id with two vectors is found at the nearer one, and asked by both
    two = spark.createDataFrame([(1, [0.0, 1.0]), (1, [9.0, 9.0]), (2, [0.0, 2.0]), (3, [9.0, 8.5])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(two, two.where("vec_id < 3")).collect()) == [
        (1, 1, 3, 0.5), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 3, pytest.approx(np.hypot(9, 6.5)))
    ]


# --- language model -----------------------------------------------------------------------------


def test_base_scores_equal_counting_by_hand(documents, prose):
    texts = [prose(40) for _ in range(30)] + [None, "", " \t\n", "É é E e", "a b c", prose(9000)]
    texts += texts[:5]
    docs = documents(texts, 4)
    table = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for i, t in enumerate(table) if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in lm.score_texts(docs).collect():
        t = table[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0
    assert lm.score_texts(docs.limit(0)).count() == 0
    alone = lm.score_texts(documents(["a b"], ids=[next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"], alone["score"]) == (0, 0, 0.0, 0.0)


def test_interpolation_by_hand(documents, prose, monkeypatch):
    weights = np.tile([0.5, 0.3, 0.2], (lm.N_CONTEXTS, 1))
    monkeypatch.setattr(lm, "learn_weights", lambda histogram, v: weights)
    texts = [prose(30) for _ in range(12)] + ["new words only here"]
    table = [t.split() + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    one, two = Counter(), Counter()
    for i, t in enumerate(table):
        if not held[i]:
            one.update(t)
            two.update(zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    for r in lm.score_texts(documents(texts, 3)).collect():
        t = table[r["doc_id"]]
        p = [0.5 * (two[a, b] / one[a] if one[a] else 0) + 0.3 * one[b] / n + 0.2 / (v + 1) for a, b in zip([None, *t], t, strict=False)]
        assert r["score"] == pytest.approx(sum(map(math.log10, p)))


def test_weights_are_the_most_likely():
    rng = np.random.default_rng(0)
    events = [(3, int(rng.integers(1, 50)), float(a), float(b)) for a, b in rng.random((40, 2)) * (0.3, 0.01)]
    best = lm.learn_weights(events, 999, 2000)[3]
    likelihood = lambda w: sum(n * math.log(w[0] * a + w[1] * b + w[2] / 1000) for _, n, a, b in events)
    assert best.sum() == pytest.approx(1) and all(likelihood(best) >= likelihood(w) - 1e-6 for w in rng.dirichlet([1, 1, 1], 300))


def test_held_out_texts_score_better_than_unigrams(spark):
    from citadex.llm.queries import QUERIES

    r = QUERIES["op8_language_model"](spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


# --- tokens and packing -------------------------------------------------------------------------


def test_token_counts_equal_a_plain_lattice(documents, prose):
    file = tokenizer_path("byte_bpe_50k.tiktoken")
    model = tc.unigram_model(file)
    assert math.fsum(map(math.exp, model.values())) == pytest.approx(1) and len(model) == sum(1 for _ in open(file, "rb"))
    assert base64.b64encode(b"a") in open(file, "rb").read()

    def plain(data):
        best = [(0.0, 0)]
        for i in range(1, len(data) + 1):
            best.append(max((best[j][0] + model[data[j:i]], best[j][1] - 1) for j in range(i) if data[j:i] in model))
        return best[-1]

    texts = [prose(60), prose(60), None, "", " \n\t ", "日本語 é́ 🙂🙂 it's 12,345", "ab" * 700, prose(20)]
    docs = documents(texts * 2)
    for limit in (600_000, 40):
        got = docs.select("text", tc.count_tokens(F.col("text"), file, limit).alias("c")).collect()
        for r in got:
            parts = [plain(p.encode()) for p in regex.findall(PATTERN, r["text"] or "")]
            assert (r["c"]["n_tokens"], r["c"]["n_pretokens"]) == (-sum(p[1] for p in parts), len(parts))
            assert r["c"]["score"] == pytest.approx(sum(p[0] for p in parts))


def unpack(pieces, texts, length):
    """Check that the pieces hold every text exactly once and fill sequences without gaps."""
    tok, by_doc, by_sequence = Tokenizer.from_file(BPE), {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for number, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or number == max(by_sequence)
    return by_sequence


def test_packing_round_trip(documents, prose):
    texts = {i: prose(random.Random(i).randint(1, 60)) for i in range(120)}
    texts |= {120: None, 121: "", 122: "a<|endoftext|>b  <|endoftext|>  c", 123: prose(6000), 124: "  \n é́ 🙂"}
    sources = ["big" if i % 3 else f"s{i % 9}" if i % 2 else None for i in range(len(texts))]
    docs = documents(list(texts.values()), 5, sources=sources)
    pieces = pk.pack(docs, BPE, length=64, round_sequences=16).collect()
    unpack(pieces, texts, 64)
    total, rounds = Counter(), {}
    for r in pieces:
        total[r["queue"]] += r["length"]
        rounds.setdefault(r["round"], Counter())[r["queue"]] += r["length"]
    everything, carried = sum(total.values()), Counter()
    for number in sorted(rounds)[:-1]:
        carried.update(rounds[number])
        for q in total:  # never a whole token away from the target
            assert abs(carried[q] - (number + 1) * 64 * 16 * total[q] / everything) <= 1
    weighted = pk.pack(docs, BPE, length=64, round_sequences=4, weights={"big": 1, "s3": 3}).collect()
    unpack(weighted, texts, 64)
    first = Counter()
    for r in weighted:
        if r["round"] == 0:
            first[r["queue"]] += r["length"]
    assert set(first) == {"big", "s3"} and abs(first["s3"] - 3 * first["big"]) <= 4
    assert pk.pack(docs.limit(0), BPE).count() == 0


def test_every_sequence_is_mixed(documents, prose):
    texts = {i: prose(random.Random(i).randint(1, 200)) for i in range(60)}
    docs = documents(list(texts.values()), 5, sources=["big" if i % 3 else f"s{i % 6}" for i in range(60)])
    sequences = unpack(pk.pack(docs, BPE, length=256).collect(), texts, 256)
    total = Counter()
    for r in (r for rows in sequences.values() for r in rows):
        total[r["queue"]] += r["length"]
    everything = sum(total.values())
    assert len(sequences) > 20 and len(total) == 3
    for number in sorted(sequences)[:-1]:
        held = Counter()
        for r in sequences[number]:
            held[r["queue"]] += r["length"]
        for q in total:  # the deficit carried in and the one carried on; a gapless stream shifts by less than a token a queue
            assert abs(held[q] - 256 * total[q] / everything) <= 1 + len(total)


def test_repeated_rows_are_packed_each(documents):
    pieces = pk.pack(documents(["one two"] * 3, ids=[1, 1, None]), BPE, length=4).collect()
    assert sum(r["length"] for r in pieces) == 3 * len([*Tokenizer.from_file(BPE).encode("one two").ids, 1])


# --- pipeline -----------------------------------------------------------------------------------


def test_stages_of_the_pipeline(spark, documents, prose, tmp_path):
    rng = random.Random(4)
    shared, item, copy = prose(60), prose(20), prose(200)
    texts = [prose(90), copy, noisy(copy, 0.005, rng), copy, f"{prose(40)} {shared}", f"{shared} {prose(40)}", f"{prose(30)} {item}", None, "12 34", "", prose(5000)]
    folder = str(tmp_path / "in")
    documents(texts * 1, 3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language"]) == {0, 1, 2, 3, 4, 5, 6, 10}
    assert set(kept["near_duplicates"]) == {0, 1, 4, 5, 6, 10}
    assert shared in kept["repeated_text"][4] and shared not in kept["repeated_text"][5] and kept["repeated_text"][0] == texts[0]
    assert set(kept["decontamination"]) == {0, 1, 4, 5, 10}
    packed = corpus_pipeline.run(spark, folder).collect()
    unpack(packed, kept["decontamination"], 2048)
    (tmp_path / "none").mkdir()
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
