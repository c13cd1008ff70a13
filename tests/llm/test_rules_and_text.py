"""URL rules, languages, HTML, benchmark items: small cases, brute force, odd rows."""

import hashlib
import re
from collections import Counter

import pytest
from citadex.llm import decontaminate as dc
from citadex.llm import html_text as ht
from citadex.llm import language as lg
from citadex.llm.queries import ORACLES, QUERIES, URL_RULES
from citadex.llm.url_filter import UrlRules, build_cascade, judge_urls
from oracle import compare, database
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    n, m, problems = compare(spark, database(FOLDER), name, FOLDER, QUERIES, ORACLES)
    assert n == m > 0 and not problems


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32("key") % 7 == 0).union(spark.sql("SELECT CAST(NULL AS string)"))
    cascade = build_cascade(listed, keys, per_key=3)
    assert len(cascade.levels) > 2
    wrong = keys.where(cascade.listed(F.col("key")) != (F.crc32("key") % 7 == 0))
    assert wrong.count() == 0
    assert keys.where(build_cascade(listed.limit(0), keys).listed(F.col("key"))).count() == 0


@pytest.mark.parametrize("n", [11, 1500])
def test_cascade_of_a_large_universe_or_list(spark, n):
    """Neither the corpus nor the list may need more bits than one filter holds."""
    keys = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    cascade = build_cascade(keys.where(F.col("id") < n).select("key"), keys.select("key"), max_bits=4096)
    got = keys.where(cascade.listed(F.col("key"))).agg(F.count("id"), F.max("id")).first()
    assert tuple(got) == (n, n - 1)
    assert all(m <= 4096 for part in getattr(cascade, "parts", (cascade,)) for m, _, _ in part.levels)


def test_url_rules(spark):
    cases = {
        "http://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "https://com/en/": ("com", "/en/", "com/en/", "block"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "ftp://b.net/de/9#t": ("b.net", "/de/9", "net/de/", "allow"),
        "x://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "x://www.free-bets.org/fr/": ("www.free-bets.org", "/fr/", None, "block"),
        "x://other.org/fr/": ("other.org", "/fr/", None, "allow"),
        "x://a?b://c": ("a", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    urls = [*cases, *cases]
    df = spark.createDataFrame([(u, "own", 1) for u in urls], "url string, host string, other int")
    got = judge_urls(df, URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r["url"]
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df, UrlRules()).collect()} == {"allow"}


def ranked_by_hand(text, size):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_profiles_equal_counting_by_hand(documents, prose):
    texts = [prose(50), "Ça va, l'été! 12_3 x", None, "", "1 2 3", prose(2000)]
    assert lg.learn_profiles(documents(texts)) == {"en": ranked_by_hand(" ".join(t for t in texts if t), 300)}
    assert lg.ranked(lg.grams("Ça va, l'été")).tolist() == ranked_by_hand("Ça va, l'été", 300)


def test_language_of_odd_rows(documents, spark):
    en, de = "the cat and the dog went over the bridge to the house", "der hund und die katze gehen über die brücke nach haus"
    docs = documents([en, de, None, "", "12 -- 34", "the house", "die katze", en * 3000], langs=["en", "de", "en", None, "en", "en", "de", "en"])
    profiles = lg.learn_profiles(docs)
    got = {r["doc_id"]: r["g"] for r in docs.select("doc_id", lg.guess_language(F.col("text"), profiles).alias("g")).collect()}
    assert [got[i]["lang"] for i in range(8)] == ["en", "de", "und", "und", "und", "en", "de", "en"]
    assert all(0 <= g["score"] <= 1 for g in got.values())
    kept = lg.keep_known(docs, profiles)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 5, 6, 7}
    assert lg.learn_profiles(docs.limit(0)) == {}
    assert {r["lang"] for r in docs.select(lg.guess_language(F.col("text"), {}).alias("g")).select("g.lang").collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style></head><body>
<header><a href="/">Home</a> The site of the house and of all that is in it and around it for you</header>
<nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div id="cookie-notice">We use cookies on this site and they are good for you and for all of us who are here.</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>The first   paragraph of the article is here&nbsp;and it is not short, so that it can be decided by the
rules of this pass.<p>Short one.</p><aside>See also the other article that is so much better than this one is.</aside>
<div class="ad">Buy this now, it is the best of all that you can get in the whole of the world.</div>
<p>The last <a href=z>paragraph</a> of the article is <b>here<br>and</b> it ends.</p><script>var a = "</p>";</script>
<section class="comments"><p>I think that this is the best of all the articles that I have read.</p></section>
<form><p>Name of the person that you are</p><textarea>x</textarea></form></article>
<footer>&copy; the owner of the site and of all of it</footer></body></html>"""


def test_main_text():
    want = (
        "A & B\nThe first paragraph of the article is here and it is not short, so that it can be decided by the rules of this pass.\nShort one.\n"
        "The last paragraph of the article is here and it ends."
    )
    assert ht.extract(PAGE) == want


def test_pages_without_article():
    good = "This is the text of the page, and it is long enough that the rules can tell what it is. It goes on and on, for it has to be more than a few words. " * 2
    links = "".join(f'<li><a href="/{i}">Link {i} to the page</a></li>' for i in range(9))
    page = f"<body><ul>{links}</ul><div>{good}</div><p>Short inside.</p><div>{good}</div><p>{'<a href=x>more and more of the links</a> ' * 5}</p></body>"
    one = " ".join(good.split())
    assert ht.extract(page) == f"{one}\nShort inside.\n{one}"
    # among boilerplate a short block goes with it
    assert ht.extract(f"<ul>{links}</ul><p>Short</p><ul>{links}</ul>") == ""


PROSE = "This is the text of the page, and it is long enough that the rules can tell what it is. It goes on and on, for it has to be more than a few words."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "layout with-comments", "sidebar", "right-sidebar", "site-header", "comments", "modal"])
@pytest.mark.parametrize("page", [
    '<div class="{n}"><article><p>{t}</p></article></div>', '<div id="{n}"><div><main><p>{t}</p></main></div></div>',
    '<form><main><div class="{n}"><article><p>{t}</p></article></div></main></form>',
])
def test_layout_names_keep_the_article(name, page):
    assert ht.extract(page.format(n=name, t=PROSE)) == PROSE


def test_names_of_other_matter():
    other = "I think that this is the best of all the articles that I have read in the whole of the year."
    for name in ("comments", "site-footer", "post-comments", "comments-area", "cookie-notice", "sidebar", "footer-nav"):
        assert ht.extract(f'<div class="content"><p>{PROSE}</p></div><div class="{name}"><p>{other}</p></div>') == PROSE, name
    for name in ("has-sidebar", "content-sidebar-wrap"):
        assert ht.extract(f'<div class="{name}"><p>{PROSE}</p></div>') == PROSE
    # comments are articles as well on many sites; what is hidden, or an article's own aside, stays bad
    comment = f'<div id="comments" class="comments-area"><article><p>{other}</p></article></div>'
    assert ht.extract(f"<main><article><p>{PROSE}</p></article>{comment}</main>") == PROSE
    assert ht.extract(f"<article><p>{PROSE}</p>{comment}</article>") == PROSE
    assert ht.extract(f"<div hidden><article><p>{PROSE}</p></article></div>") == ""


def test_short_paragraphs_with_links():
    short = '<p>See <a href="/g">the guide to the method</a>.</p><p>Read <a href="/h">the whole of the long report</a> for more.</p>'
    want = f"{PROSE}\nSee the guide to the method.\nRead the whole of the long report for more.\n{PROSE}"
    assert ht.extract(f'<article><p>{PROSE}</p>{short}<p><a href="/n">Next</a> | <a href="/p">Previous</a></p><p>{PROSE}</p></article>') == want


def test_languages_without_a_list():
    texts = [
        "Na początku roku mieszkańcy zauważyli, że rzeka podniosła się wyżej niż kiedykolwiek przedtem, więc wszyscy wyszli naprawiać wały przeciwpowodziowe.",
        "В начале года жители заметили, что река поднялась выше, чем когда-либо раньше, поэтому все вышли чинить плотину.",
        "今年の初めに住民は川の水位がこれまでになく高くなったことに気づき、みんなで堤防を直しに行きました。それから雨は三日続いた。",
    ]
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(9))
    for text in texts:
        page = f'<ul>{links}</ul><div class="content"><div>{text}</div><div>{text}</div></div><ul>{links}</ul>'
        assert ht.extract(page) == f"{text}\n{text}"
    # an English line beside a script that the lists do not hold
    assert texts[1] in ht.extract(f"<div>{texts[1]}</div><ul>{links}</ul><div>{PROSE}</div>")


def test_odd_pages(spark):
    pages = [None, "", "<", "<p", "<<<a>>", "<p class='x>broken", "text only", "<article>" + "<p>word and the rest</p>" * 40_000, "<!-- <article>x</article>", "<script>x"]
    df = spark.createDataFrame([(p,) for p in pages * 2], "html string").select(ht.main_text(F.col("html")).alias("text"))
    got = [r["text"] for r in df.collect()]
    assert None not in got and got[:10] == got[10:] and got[7].count("\n") == 39_999


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def found_by_hand(text, items, width=10):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(width, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_items_equal_brute_force(documents, spark, prose):
    item = prose(25)
    items = [(1, item), (2, "Zwölf Äpfel, 3"), (10, prose(11)), (3, None), (4, "--"), (5, item), (6, " ".join(item.split()[5:15]))]
    texts = [
        f"{prose(30)} {item.upper()} {prose(5)}", " ".join(item.split()[3:13]), " ".join(item.split()[3:12]), "an zwölf äpfel 3 ", "Zwölf ÄPFEL 3",
        None, "", "...", prose(20_000) + " " + item, item + " " + item, f"zwölf\näpfel\t3x {items[2][1]}",
    ]
    docs = documents(texts * 2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(dc.find_items(docs, bench, out="hits"), "hits").collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == found_by_hand(r["text"], items), r["text"]
    parts = dc.contamination(dc.find_items(docs, bench, out="hits", part_bytes=200), "hits").collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    clean = dc.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r["text"] for r in clean.collect()} == {t for t in texts if not found_by_hand(t, items)[4]}
    assert dc.clean_documents(docs.limit(0), bench).count() == 0 and dc.clean_documents(docs, bench.limit(0)).count() == len(texts) * 2


def test_spans_map_to_the_original_text():
    scanner = dc.Scanner(dc.windows([("a", "zwölf äpfel und drei birnen")], 10))
    text = "Ä: «zwölf» ÄPFEL und drei BIRNEN!"
    assert scanner.scan(text)["spans"] == []  # only A-Z is folded
    text = "Ä: «Zwölf» x, Zwölf -- äpfel; und drei BIRNEN!"
    (span,) = scanner.scan(text)["spans"]
    assert text[span["start"] : span["stop"]] == "Zwölf -- äpfel; und drei BIRNEN"
