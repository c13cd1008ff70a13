"""Copies under repeated ids, names that once took exponential time, a plain second pass, suffix order."""

import random
import time

import numpy as np
import pytest
from citadex.llm import html_text as ht
from citadex.llm import packing as pk
from citadex.llm import repeated_text as rt
from citadex.llm.suffix_array import suffix_array


def test_copies_are_rows_not_ids(documents, prose):
    copy, other = prose(40), [prose(30) for _ in range(40)]
    texts, ids = [copy, copy, *other], [1, 2, *[2] * 40]
    got = rt.repeated_spans(documents(texts, 1, ids=ids)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted([(1, 0), (2, len(copy)), *[(2, 0)] * 40])
    kept = rt.without_repeats(documents(texts, 1, ids=ids)).collect()
    assert sorted(r["text"] for r in kept) == sorted([copy, "", *other])


def test_suffixes_are_in_order():
    rng = random.Random(3)
    for size, letters in ((400, "ab"), (300, "abcdefgh"), (50, "a")):
        strings = ["".join(rng.choices(letters, k=rng.randint(1, size))).encode() for _ in range(12)] + [b"ab" * 200, b"ab" * 200]
        got = suffix_array(strings, 5)
        want = sorted((s[p:], i, p) for i, s in enumerate(strings) for p in range(len(s) - 4))
        found = [strings[i][p:] for i, p in zip(got.owner, got.offset, strict=True)]
        assert found == [w[0] for w in want] and sorted(zip(got.owner, got.offset, strict=True)) == sorted((i, p) for _, i, p in want)
        for k in range(1, len(found)):
            shared = next((n for n, (x, y) in enumerate(zip(found[k - 1], found[k], strict=False)) if x != y), min(len(found[k - 1]), len(found[k])))
            assert got.lcp[k] == shared


@pytest.mark.parametrize("word", ["menu", "advert", "sponsor", "promo", "disqus", "nav", "comments", "site", "menu_nav", "related-ads", "header"])
@pytest.mark.parametrize("sep", ["_", "-", " "])
def test_long_names_take_no_time(word, sep):
    start = time.perf_counter()
    ht.extract(f'<div class="{(word + sep) * 26}!"><p>x</p></div>')
    for pattern in (ht.LAYOUT_NAME, ht.MATTER_NAME, ht.HEAD_NAME):
        pattern.search((word + sep) * 400 + "!")
    assert time.perf_counter() - start < 0.2


PROSE = "This is the text that we want to have in the end and it is long enough for what we have to do with it."


def test_copyright_links_and_formulas():
    long = f"{PROSE} It says © and goes on. " * 4
    assert ht.extract(f"<body><p>{long}</p><p>© 2020 Us and the others of it</p></body>") == long.strip()
    link = '<a href="/x">A line that is a link</a>'
    assert ht.extract(f"<article><p>{PROSE}</p><p>{link}</p><ul><li>{link}</li></ul><p>{PROSE}</p></article>") == f"{PROSE}\nA line that is a link\nA line that is a link\n{PROSE}"
    assert ht.extract(f"<article><p>{PROSE}</p><ul>{f'<li>{link}</li>' * 3}</ul><p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"
    assert ht.extract(f"<article><p>{PROSE} <math><mi>x</mi></math></p></article>") == f"{PROSE} x"


def both_passes_by_hand(blocks, rules):
    first = [ht._first_pass(b, rules) for b in blocks]
    if not any(b.inside and not b.bad for b in blocks):
        silent = True not in first
        first = [label or ht._by_length(b, rules, silent) or label for label, b in zip(first, blocks, strict=True)]
    out = []
    for i, b in enumerate(blocks):
        near = []
        for j, c in enumerate(blocks):
            part = blocks[min(i, j) : max(i, j) + 1]
            if j != i and all(x.inside == b.inside for x in part) and (first[j] or first[j] is False and not c.inside):
                near.append((abs(i - j), not first[j]))
        out.append(bool(first[i] if first[i] is not None else (not min(near)[1] if near else b.inside)))
    return out


def test_second_pass_equals_looking_at_all_blocks():
    rules = ht.Rules()
    for seed in range(300):
        rng = random.Random(seed)
        article = rng.random() < 0.6
        blocks = []
        for _ in range(rng.randint(0, 25)):
            text = rng.choice([PROSE, PROSE * 3, "Short one", "Zz yy xx ww vv uu tt ss rr qq pp oo nn mm ll kk jj ii hh gg ff ee", "© 2020", "x " * 200])
            linked = rng.choice([0, 0, len(text) // 2, len(text)])
            blocks.append(ht.Block(text, linked, rng.random() < 0.15, article and rng.random() < 0.7, rng.random() < 0.1, linked < len(text)))
        assert ht.main_blocks(blocks, rules) == both_passes_by_hand(blocks, rules), seed


def test_places_in_unbounded_integers():
    totals = {f"q{i}": n for i, n in enumerate((3 * 10**12, 10**12, 7, 10**6))}
    layout = pk.Layout(totals, None, 2048)
    for r in (0, 1, 977, 10**9, 1953125003):
        got = layout.taken(np.array([r]))[0].tolist()
        whole = sum(totals.values())
        assert got == [min(n, r * 2048 * n // whole) for n in totals.values()]
    token = np.array([0, 5, 10**11, 3 * 10**12 - 1])
    rounds = layout.round_of(np.zeros(4, np.int64), token)
    assert (layout.taken(rounds)[:, 0] <= token).all() and (layout.taken(rounds + 1)[:, 0] > token).all()
