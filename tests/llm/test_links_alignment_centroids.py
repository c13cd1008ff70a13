"""N-gram join, cross-tokenizer alignment, centroid rounds, components: brute force and odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from citadex.llm import alignment as al
from citadex.llm import centroids as ce
from citadex.llm import ngram_join as nj
from citadex.llm.components import connected
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

A_FILE, B_FILE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


# --- components ---------------------------------------------------------------------------------


def test_components_of_a_shuffled_chain_in_few_rounds(spark, monkeypatch):
    from citadex.llm import components

    rounds = []
    real = components._with_grandparents
    monkeypatch.setattr(components, "_with_grandparents", lambda df: rounds.append(1) or real(df))
    nodes = list(range(5000))
    random.Random(5).shuffle(nodes)
    links = spark.createDataFrame([*zip(nodes, nodes[1:], strict=False), (9001, 9000), (7777, 7777)], "a long, b long")
    got = connected(links)
    assert {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 5000, 9000: 2}
    assert len(rounds) <= 30


def test_components_without_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join --------------------------------------------------------------------------------


def ngrams_by_hand(text, size=4):
    words = [w for w in (text or "").translate({ord(c): " " for c in "\t\n\v\f\r"} | {i: i + 32 for i in range(65, 91)}).split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components_by_hand(docs, p=85, q=100):
    sets = [ngrams_by_hand(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = defaultdict(lambda: math.inf)
    for i, (doc, _) in enumerate(docs):
        smallest[root(i)] = min(smallest[root(i)], doc)
    return Counter((doc, len(sets[i]), smallest[root(i)]) for i, (doc, _) in enumerate(docs))


def edited(text, n, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def joined_texts(prose):
    """Groups of copies at all distances, a passage that many share, short texts, odd white space and case."""
    rng = random.Random(11)
    base, other, passage = prose(150), prose(400), prose(30)
    texts = [base, *(edited(base, rng.choice([1, 2, 3, 4]), rng) for _ in range(40)), other, *(edited(other, 9, rng) for _ in range(12))]
    texts += [base.upper(), base.replace(" ", "\n\t "), base + " tail", other + " " + prose(40), *(prose(30) + " " + passage for _ in range(30)), passage, passage + " end"]
    texts += ["", None, "   ", "one", "one two", "ONE two", "one two three four", "a b c d e", "e d c b a", "a a a a a a a", "a a a a", "naïve Ünder", "naïve ünder", prose(20_000)]
    return texts


@pytest.mark.parametrize("options", [{}, {"frequent": 20}, {"frequent": 2, "counters": 64}])
def test_components_equal_brute_force(documents, joined_texts, options, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 2_000)
    df = documents(joined_texts)
    got = Counter(tuple(r) for r in nj.ngram_components(df, **options).collect())
    want = components_by_hand(list(enumerate(joined_texts)))
    assert got == want
    assert len({c for _, _, c in want}) < len(joined_texts) - 25


def test_star_whose_centre_alone_links(documents, prose):
    """Copies that are near the original and far from each other, and pairs of copies far from it."""
    rng = random.Random(2)
    base = prose(120)
    far = [edited(base, 5, rng) for _ in range(8)]
    texts = [edited(base, 2, rng) for _ in range(60)] + [base, *far, *(edited(t, 1, rng) for t in far)]
    got = Counter(tuple(r) for r in nj.ngram_components(documents(texts)).collect())
    assert got == components_by_hand(list(enumerate(texts)))


def test_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:103]), " ".join(words[:88]), " ".join(words[:87])]  # 100, 85 and 84 n-grams
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_components(documents(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0}  # 84 of 85 links the last to the second
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_components(documents([texts[0], texts[2]])).collect()}
    assert got == {0: 0, 1: 1}


def test_join_repeated_rows_and_ids(documents, prose):
    a, b, c = prose(60), prose(60), prose(60)
    texts, ids = [a, a, a, b, b, c, None, a, c], [4, 4, 2, 2, 7, 7, 3, None, None]
    got = Counter(tuple(r) for r in nj.ngram_components(documents(texts, ids=ids)).collect())
    sets = [len(ngrams_by_hand(t)) for t in texts]
    assert got == Counter([(4, sets[0], 2), (4, sets[0], 2), (2, sets[0], 2), (2, sets[3], 2), (7, sets[3], 2), (7, sets[5], 7), (3, 0, 3), (None, sets[0], None), (None, sets[5], None)])


def test_join_empty_table(documents, spark):
    df = documents(["x"]).where("doc_id < 0")
    assert nj.ngram_components(df).count() == 0
    assert nj.ngram_components(documents([None, ""])).count() == 2


def test_summary_keeps_what_is_frequent():
    rng, summary = np.random.default_rng(0), nj.Summary(50)
    keys = np.concatenate((np.repeat(np.arange(10), 500), rng.integers(100, 5000, 5000))).astype(np.uint64)
    rng.shuffle(keys)
    for part in np.array_split(keys, 40):
        summary.add(part)
    found = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert len(found) <= 50 and all(500 - len(keys) / 50 <= found[k] <= 500 for k in range(10))


# --- alignment ----------------------------------------------------------------------------------


def test_ends_meet_where_both_sides_end():
    for seed in range(2000):
        rng = random.Random(seed)
        n = rng.randint(1, 60)
        share = rng.random()
        a, b = ([*sorted(i for i in range(1, n) if rng.random() < share), n] for _ in range(2))
        if rng.random() < 0.3:
            b = list(a)
        x, y = al.aligned_ends(np.array(a), np.array(b))
        assert [a[i] for i in x] == sorted({*a} & {*b}) == [b[j] for j in y]


def aligned_by_hand(texts):
    tok = Tokenizer.from_file(A_FILE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rows, linked = [], Counter()
    for text in texts:
        row = None
        if text:
            a, b = tok.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b), strict=True)]
            if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
                groups, links, i, j = [], [], 0, 0
                for end in sorted({*ends_a} & {*ends_b}):
                    x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                    links.append((a[x - 1], b[y - 1]))
                    i, j = x, y
                row = len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
                linked.update(links)
        rows.append(row)
    top = defaultdict(int)
    for (_, b), n in linked.items():
        top[b] = max(top[b], n)
    return [
        (i, 0, 0, 0, 0, 0, 0, "") if r is None
        else (i, *r[:3], r[2], sum(linked[x] == top[x[1]] for x in r[3]), sum(linked[x] for x in r[3]), r[4])
        for i, r in enumerate(rows)
    ]


ODD = [
    "", None, " ", "a", "Hello, world!", "naïve café — über 日本語 ▁ under", "under▁line", "日本語のテキスト", "😀 emoji 👩‍👩‍👧 row", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "tab\tand\nnew line\r\n\n  spaces   here ", "\x00\x01 control", "x" * 3000, "don't can't we'll I'm", "1234567890 3.14159", "á ë", "  leading", "trailing  ", "﻿mark",
]


def test_alignment_equals_brute_force(documents, prose, monkeypatch):
    monkeypatch.setattr(al, "CHUNK_PAIRS", 300)
    texts = [*ODD, *(prose(n) for n in (1, 5, 50, 200)), prose(3000), "Hello, world!", "Hello, world!"]
    got = sorted(tuple(r) for r in al.cross_tokenizer(documents(texts), A_FILE, B_FILE).collect())
    assert got == aligned_by_hand(texts)


def test_alignment_of_nothing_and_repeated_ids(documents):
    df = documents(["one two", "one two", None, "three"], ids=[5, 5, None, None])
    assert al.cross_tokenizer(df.where("doc_id < 0"), A_FILE, B_FILE).count() == 0
    got = sorted((tuple(r)[:7] for r in al.cross_tokenizer(df, A_FILE, B_FILE).collect()), key=str)
    assert [r[0] for r in got] == [5, 5, None, None] and got[0] == got[1] and got[0][6] == 2 * got[0][4]


# --- centroids ----------------------------------------------------------------------------------


def test_transform_is_exact_and_sorted_by_sign_changes():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 20), 1 << 20, (50, 64))
    h = ce.walsh(np.eye(64, dtype=np.int64))
    assert (np.abs(h) == 1).all() and ((np.diff(h, axis=0) != 0).sum(axis=0) == np.arange(64)).all()
    assert (ce.walsh(x) == x @ h).all() and (ce.unwalsh(ce.walsh(x)) == x).all()
    assert ((ce.walsh(x) ** 2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    assert (np.array(ce._unwalsh_exact(ce.walsh(x)[0].astype(object), 64)) == x[0]).all()


def test_search_finds_the_nearest_and_drops_the_rest():
    rng = np.random.default_rng(2)
    c = np.cumsum(rng.integers(-40, 41, (40, 64)), axis=1)
    c[9] = c[4]
    x = np.concatenate((c[rng.integers(0, 40, 300)] + rng.integers(-9, 10, (300, 64)), c, rng.integers(-500, 500, (20, 64))))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    who, distance, paid = ce.nearest_centroid(ce.walsh(x), ce.walsh(c))
    assert (who == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert paid < x.size * 40 / 3
    assert [len(v) for v in ce.nearest_centroid(np.empty((0, 64), np.int64), ce.walsh(c))[:2]] == [0, 0]


def rounds_by_hand(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    centroids = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    near = assign()
    per = Counter()
    for d, n in near:
        per[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, per[n], sum(per.values()), digest[n]) for (i, _), (d, n) in zip(kept, near, strict=True))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, "x", 1, 0.5) for i, x in rows], "vec_id long, embedding array<float>, cluster string, v int, distance double").repartition(3)


def single(x):
    return [float(np.float32(v)) for v in x]


@pytest.mark.parametrize("n", [150, 7, 1])
def test_rounds_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, single(rng.normal(i % 5, 0.4, 64))) for i in range(n)]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.5] * 63), (904, [float("nan")] + [0.5] * 63), (905, [float("inf")] + [0.5] * 63), (906, [0.5] * 65)]
    rows += [rows[0], rows[0]]
    got = Counter(tuple(r) for r in ce.cluster_vectors(vectors_of(spark, rows)).collect())
    assert got == rounds_by_hand(rows)


def test_vectors_that_are_out_of_range_or_missing(spark):
    assert ce.cluster_vectors(vectors_of(spark, [(1, None)])).count() == 0
    assert ce.cluster_vectors(vectors_of(spark, []).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = ce.cluster_vectors(vectors_of(spark, [(None, [0.0] * 64), (3, [0.0] * 64), (4, [-0.001] * 64)]), k=2).collect()
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got) in ([(0, 0, 0), (3, 0, 0), (4, 1, 0)], [(0, 1, 0), (3, 1, 0), (4, 0, 0)])
    with pytest.raises(Exception, match="beyond 64 bits"):
        ce.cluster_vectors(vectors_of(spark, [(1, [1e6] * 64)])).collect()
    with pytest.raises(ValueError, match="power of two"):
        ce.cluster_vectors(vectors_of(spark, [(1, [0.0] * 64)]), size=48)
