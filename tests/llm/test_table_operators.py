"""HTML, language, mixing, nearest neighbours, sharding and quality against brute force, truth or targets."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import dimension_scan, html_tree, language_id, mixing, quality_pu, sharding
from lexigrid.llm.common import table
from tests.harness import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents")


# HTML extraction

PAGE = """<html><body><header><h1>Site</h1><nav>Home About</nav></header><div class="cookie-notice"><p>We use cookies.</p></div>
<div class="sidebar"><p>Popular stories that are long enough to look like an article's text, very long indeed.</p></div>
{open}<h1>Title &amp; more</h1><p>First paragraph of
   the article, long enough to be content.</p><p>Second <b>bold</b>, <i>it</i>&nbsp;text.</p><ul><li>one</li><li>two</li></ul>
<aside>Related</aside><form><label>Mail</label><input><button>Go</button></form><script>var p = "<p>no</p>";</script><!-- no -->
<section id="comments"><p>Great article, I really liked reading it, and I will come back for more.</p><p>Me too, thanks to all.</p></section>
{close}<footer>(c)</footer></body></html>"""
MAIN = "Title & more First paragraph of the article, long enough to be content. Second bold, it text. one two"


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="post-content">', "</div>")])
def test_article_without_its_surroundings(spark, open_, close):
    trained = html_tree.train(table(spark, FOLDER, "pages"))
    unseen = html_tree.Potentials.from_counts(np.zeros((len(html_tree.FEATURES), 2)), np.zeros((len(html_tree.EDGES), 2, 2)))
    for potentials in (trained, unseen):
        assert html_tree.extract_all([PAGE.format(open=open_, close=close)], potentials) == [MAIN]


def test_messages_give_the_marginals_of_the_joint_distribution(monkeypatch):
    monkeypatch.setattr(html_tree, "MOST_BELOW", np.inf)   # without the tempering of many children
    rng = np.random.default_rng(5)
    n = 7
    parent = np.array([-1, 0, 0, 1, 1, 2, 2])
    depth = np.array([0, 1, 1, 2, 2, 2, 2])
    seen = np.full((n, 3), -1)
    seen[:, 0] = rng.integers(3, len(html_tree.KINDS), n)
    named = np.array([0.0, -5.0, 0.5, 3.0, 0.0, -1.0, 2.5])
    edges = rng.dirichlet([1, 1], (len(html_tree.EDGES), 2))
    potentials = html_tree.Potentials(rng.normal(size=len(html_tree.FEATURES)), np.log(edges))
    at = html_tree.edges_of(np.maximum(parent, 0), seen[:, 0], named)
    total, ones = 0.0, np.zeros(n)
    for states in np.ndindex(*[2] * n):
        s = np.array(states)
        p = math.exp(sum((potentials.odds[seen[k, 0]] + named[k]) * s[k] for k in range(n)))
        for k in range(1, n):
            p *= edges[at[k], s[parent[k]], s[k]]
        total += p
        ones += p * s
    got = html_tree.marginals(np.maximum(parent, 0), depth, seen, named, potentials)
    assert np.allclose(got, ones / total)


LONG = [f"Paragraph {k} tells at some length what happened next, so that its text is that of an article and no menu." for k in range(10)]
WRAPPERS = [('<article class="post comment-open">', "</article>"), ('<article class="overflow-hidden">', "</article>"),
            ('<div class="content no-sidebar">', "</div>"), ('<div class="long-form">', "</div>"), ('<div class="elementor-widget">', "</div>"),
            ('<div id="story-share-wrapper"><article>', "</article></div>"), ('<main class="search-results">', "</main>"),
            ("<div>", "</div>"), ('<div id="page"><div class="x7"><section>', "</section></div></div>"),
            ('<div class="layout"><main><article class="has-comments">', "</article></main></div>")]
SITE = """<html><head><title>t</title></head><body><header class="site-header"><a href="/">Home</a><ul class="main-nav"><li><a href="/a">A</a></li></ul></header>
<div class="cookie-notice"><p>We use cookies on this site, and by reading on you agree to all of them and more besides.</p></div>
{open}{body}{close}<div class="sidebar"><p>Popular stories that are long enough to look like an article's text.</p></div>
<div class="related-posts"><p>Read also what others have written at length about the very same matter.</p></div>
<section id="comments">{comments}</section><footer><p>Imprint and all rights reserved by the owner of this site for ever.</p></footer></body></html>"""


@pytest.fixture(scope="module")
def both_potentials(spark):
    unseen = html_tree.Potentials.from_counts(np.zeros((len(html_tree.FEATURES), 2)), np.zeros((len(html_tree.EDGES), 2, 2)))
    return html_tree.train(table(spark, "/root/testdata/sf0.01", "pages")), unseen


@pytest.mark.parametrize("open_, close", WRAPPERS)
@pytest.mark.parametrize("n_comments", [1, 40])
def test_words_in_names_of_wrappers_do_not_decide(both_potentials, open_, close, n_comments):
    body = "".join(f"<p>{x}</p>" for x in LONG) + '<p class="label">A short label.</p><p id="share-of-market">The share of the market rose by a tenth.</p>'
    comments = "".join(f'<div class="comment"><p>Reader {k} liked reading this a lot, and will come back for more of it soon.</p></div>' for k in range(n_comments))
    page = SITE.format(open=open_, close=close, body=body, comments=comments)
    want = " ".join([*LONG, "A short label.", "The share of the market rose by a tenth."])
    for potentials in both_potentials:
        assert html_tree.extract_all([page], potentials) == [want]


FOUR, TALK = "".join(f"<p>{x}</p>" for x in LONG[:4]), "Reader {} liked reading this a lot, and will come back for more of it soon, as will all of the others."
THREAD = "".join(f"<p>{TALK.format(k)}</p>" for k in range(30))
BODIES = {
    "comments are articles": (f'<article>{FOUR}</article><section id="comments">' + "".join(f"<article><p>{TALK.format(k)}</p></article>" for k in range(12)) + "</section>", ""),
    "comments in the article": (f'<article>{FOUR}<section id="comments">' + "".join(f'<article class="comment">{TALK.format(k)}</article>' for k in range(12)) + "</section></article>", ""),
    "more comments than article": (f'<div class="post">{FOUR}</div><div class="comments">{THREAD}</div>', ""),
    "long thread in the article": (f'<article>{FOUR}<div class="comments">{THREAD}</div></article>', ""),
    "long aside in main": (f"<main><article>{FOUR}</article><aside>{THREAD}</aside></main>", ""),
    "notice and advert": (f'<article><div class="notice"><p>You have two free articles left, so subscribe now.</p></div>{FOUR}<div class="ad">Buy it now.</div></article>', ""),
    "divs for paragraphs": ("<article>" + "".join(f"<div>{x}</div>" for x in LONG[:4]) + "</article>", ""),
    "table": (f"<article>{FOUR}<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table></article>", " a b 1 2"),
    "links": (f'<article>{FOUR}<p>See <a href="x">this page</a>.</p><p><a href="z">Only a link</a></p></article>', " See this page. Only a link"),
    "wrapper without an article": (f'<div id="wrapper"><div class="nav"><a href="/">Home</a></div><div class="c1">{FOUR}</div><div class="c2"><a href="/a">A</a></div></div>', ""),
    "paragraphs in the body": (f'<nav><a href="/">Home</a></nav>{FOUR}<footer>Imprint</footer>', ""),
    "hidden": (f'<article>{FOUR}<p hidden>secret</p><p class="hidden-xs">shown text here</p></article>', " shown text here"),
}


@pytest.mark.parametrize("name", sorted(BODIES))
def test_kinds_of_pages(both_potentials, name):
    body, more = BODIES[name]
    for potentials in both_potentials:
        assert html_tree.extract_all([f"<html><body>{body}</body></html>"], potentials) == [" ".join(LONG[:4]) + more]


def test_short_articles(both_potentials):
    items = "".join(f"<li>Item {k}</li>" for k in range(30))
    for potentials in both_potentials:
        assert html_tree.extract_all([f"<article><h1>Title</h1><ul>{items}</ul></article>", '<nav><a href="/">H</a></nav><article><h1>A</h1></article>',
                                      '<nav><a href="/">Home</a></nav><footer>Imprint</footer>'], potentials) \
            == ["Title " + " ".join(f"Item {k}" for k in range(30)), "A", ""]


def test_names_are_learned_from_labelled_pages(spark):
    """A name that no list knows, and one that the lists know otherwise, are told by where labelled pages have them."""
    def page(k, marked):
        a, b = ("<article>", "</article>") if marked else ("", "")
        return (f'<body><div class="zork">Zork text {k} that is as long as the paragraphs of any other part of the page.</div>{a}<p>{LONG[k % 10]}</p>'
                f'<div class="widget"><p>{LONG[(k + 1) % 10]}</p><p>{LONG[(k + 2) % 10]}</p></div><div class="zork">more zork {k}</div>{b}</body>')

    def inside_zork(k):   # unmarked pages don't label anything
        return page(k, False)

    pages = spark.createDataFrame([(k, page(k, True).replace(f'<div class="zork">more zork {k}</div>', "")) for k in range(60)] + [(100, inside_zork(1))],
                                  "page_id long, html string")
    learned = html_tree.train(pages)
    assert learned.names["zork"] < -3 and learned.named(("zork",)) < -3
    got = html_tree.extract_all([f'<body><article><p>{LONG[0]}</p><div class="zork">Zork again.</div></article></body>'], learned)
    assert got == [LONG[0]]


def test_what_a_name_says_by_its_words():
    prior = html_tree.prior_of
    for name in ("sidebar", "main-nav", "siteFooter", "comments", "comment-list", "ad-slot-3", "cookie-notice", "article-comments", "related-posts"):
        assert prior(name) == html_tree.PRIOR_NAMED["around"], name
    for name in ("post-content", "main", "articleBody", "entry-content"):
        assert prior(name) == html_tree.PRIOR_NAMED["inside"], name
    for name in ("no-sidebar", "comment-open", "overflow-hidden", "label", "x7", "", "123"):
        assert prior(name) == 0, name
    for name in ("long-form", "elementor-widget", "search-results", "share-of-market"):
        assert prior(name) == html_tree.PRIOR_NAMED["hint"], name
    assert html_tree.names_of(' class="a hidden b" hidden') == ("a", "b", "hidden", html_tree.HIDDEN)
    assert html_tree.names_of(' class="a hidden" data-x="is hidden = no"') == ("a", "hidden")
    assert html_tree.names_of(" style='color:red; display: none'") == (html_tree.HIDDEN,)


def truth(page):
    from html import unescape
    found = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not found:
        return ""
    bare = re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", "\n", found[1]))
    return " ".join(" ".join(unescape(x).split()) for x in bare.split("\n") if unescape(x).split())


def test_pages_table(spark):
    pages = table(spark, FOLDER, "pages")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    rows = html_tree.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "b"), (None, "u", "<p>x", "c"), (2, "u", "", "b"),
                                   (3, "u", "<div>" * 3000 + "deep", "d"), (4, "u", "<article><p cl", "e"), (5, "u", "a < b & c &am", "f"),
                                   (6, "u", "<article>" + "<p>long text &lt;" * 20000, "g")], "page_id long, url string, html string, text string")
    rows = html_tree.extract(pages).collect()
    assert len(rows) == 8
    by = {r["page_id"]: r["text"] for r in rows}
    assert by[1] == by[2] == "" and by[4] == "" and by[6] == " ".join(["long text <"] * 20000)
    assert html_tree.extract(pages.limit(0)).count() == 0


# language identification


def test_languages(documents):
    rows = language_id.identify(documents).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == documents.count()
    told = [r for r in rows if len((r["text"] or "").split()) >= 20]
    assert sum(r["language"] == r["lang"] for r in told) >= 0.97 * len(told)
    assert all(r["kept"] for r in told if r["language"] == r["lang"])


def test_evidence_is_fused(docs_of):
    en, de = "the and that with this from have are was not for you all ", "der die und das nicht mit auf für ist ein eine dem "
    rows = [(k, (en if k % 2 else de) * 5, "en" if k % 2 else "de", "site.de" if k % 2 == 0 else "site.com") for k in range(60)]
    rows += [(100, de * 5, "en", "site.com"), (101, "xy", "de", "site.de"), (102, "xy", None, "site.de"), (103, "xy", "en", "site.com"),
             (104, "12 34 | 56", "en", "site.com"), (105, de, None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(rows)).collect()}
    assert all(got[k]["language"] == ("en" if k % 2 else "de") for k in range(60))
    assert got[100]["language"] == "de"                          # a clear text outweighs a wrong declaration
    assert [got[k]["language"] for k in (101, 102, 103)] == ["de", "de", "en"]  # no text to speak of: declaration and host decide
    assert got[104]["language"] is None and not got[104]["kept"]
    assert got[105]["language"] == "de" and got[105]["kept"]


def test_hosts_and_suffixes(spark):
    rows = spark.createDataFrame([("https://A.example.de:80/x?y",), ("blog.example.org",), ("src0",), (None,)], "u string")
    host = language_id.host_of(rows["u"])
    got = [tuple(r) for r in rows.select(host, language_id.suffix_of(host)).collect()]
    assert got == [("a.example.de", "de"), ("blog.example.org", "org"), ("src0", ""), ("", "")]


def test_pages_are_identified(spark):
    pages = table(spark, FOLDER, "pages")
    rows = language_id.identify_pages(pages).join(pages.select("page_id", "html"), "page_id").collect()
    right = sum(f'lang="{r["language"]}"' in r["html"] for r in rows)
    assert right >= 0.95 * len(rows)


def test_language_of_odd_rows(odd, docs_of):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert language_id.identify(odd.limit(0)).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {4, 5, 6, 7, None}
    undeclared = docs_of([(1, "no one declares", None, None), (2, " 12 ", None, None), (3, None, None, None)])
    assert [r["doc_id"] for r in language_id.keep_identified(undeclared).collect()] == [1]   # undecided, not lost
    assert [(r["doc_id"], r["language"], r["kept"]) for r in language_id.identify(undeclared).collect()] == [(1, None, True), (2, None, False), (3, None, False)]


IT = "Questa mattina il mercato della piazza era pieno di gente che comprava frutta e verdura fresca, mentre i bambini giocavano vicino. "
FI = "Tänä aamuna torilla oli paljon ihmisiä, jotka ostivat tuoreita hedelmiä ja vihanneksia, kun lapset leikkivät suihkulähteen lähellä. "
DA = "I morges var der mange mennesker på torvet, som købte frisk frugt og grøntsager, mens børnene legede ved springvandet og lo højt. "


def test_rare_languages_are_neither_relabelled_nor_lost(spark):
    big = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    rare = [(10**6 + k, IT * (1 + k % 3), "it", "src1") for k in range(7)] + [(10**6 + 10 + k, FI * (1 + k % 2), "fi", "src2") for k in range(5)]
    rare += [(10**6 + 20 + k, DA * 2, "da", "src3") for k in range(2)] + [(10**6 + 30, DA * 2, None, "src3"), (10**6 + 31, IT, None, "src4")]
    docs = big.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r for r in language_id.identify(docs).where("doc_id >= 1000000").collect()}
    # too few Danish texts for a model: they keep the language that they declare; without one they are of another language
    assert all(got[k]["language"] == said and got[k]["kept"] for k, _, said, _ in rare if said)
    assert got[10**6 + 30]["language"] == "other" and not got[10**6 + 30]["kept"] and got[10**6 + 31]["language"] == "it"
    kept = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(docs).where("doc_id >= 1000000").collect()}
    assert kept == {k: r["language"] for k, r in got.items() if r["kept"]}
    nameless = big.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(nameless).count() == big.where("text rlike '[A-Za-z]'").count()


def test_more_languages_than_models(docs_of):
    docs = docs_of([(100 * x + k, f"{chr(97 + x)}{chr(98 + x)} " * 30, f"l{x}", "s") for x in range(6) for k in range(3 + x)])
    assert language_id.languages_of(docs, "text", docs["lang"], most=2) == ["l4", "l5"]
    assert language_id.languages_of(docs, "text", docs["lang"], min_docs=5) == ["l2", "l3", "l4", "l5"]


def test_posterior_is_what_the_evidence_gives(docs_of):
    """The fused posterior, computed again from all rows at once."""
    en, de, fr = "the and that with this from have are was ", "der die und das nicht mit auf ein eine ", "le la les des une est dans pour que "
    rows = [(k, [en, de, fr][k % 3] * (1 + k % 4), [("en", "de", "fr")[k % 3], None, "en"][k % 7 % 3], ["a.com", "b.de", "c.de", "src1", None][k % 5]) for k in range(50)]
    docs = docs_of(rows)
    languages = language_id.languages_of(docs, "text", docs["lang"])
    assert languages == ["de", "en", "fr"]
    counts = np.zeros((3, language_id.BINS))
    for _, t, said, _ in rows:
        if said:
            np.add.at(counts[languages.index(said)], language_id.trigram_bins(t), 1)
    model = language_id.Model(counts)
    logs = np.array([model.score(t)[1:] for _, t, _, _ in rows])
    share = np.exp(logs - logs.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    said = [r[2] or "" for r in rows]
    host = [r[3] or "" for r in rows]
    suffix = [h.rpartition(".")[2] if "." in h else "" for h in host]
    n, c = 4, language_id.STRENGTH
    want = {}
    for k, (key, *_rest) in enumerate(rows):
        alike = lambda names: np.array([x == names[k] for x in names])  # noqa: B023, E731
        everywhere = (share.sum(axis=0) + 1) / (len(rows) + n)
        in_suffix = (share[alike(suffix)].sum(axis=0) + c * everywhere) / (alike(suffix).sum() + c)
        own = np.maximum(share[alike(host)].sum(axis=0) - share[k], 0)
        prior = (own + c * in_suffix) / (alike(host).sum() - 1 + c)
        witness = np.ones(n) if not said[k] else (share[alike(said)].sum(axis=0) + 1) / (share.sum(axis=0) + n + 1)
        post = np.exp(logs[k] - logs[k].max()) * prior * witness
        post /= post.sum()
        want[key] = ([*languages, "other"][int(post.argmax())], round(float(post.max()), 6))
    got = {r["doc_id"]: (r["language"], r["posterior"]) for r in language_id.identify(docs).collect()}
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


# mixing


def test_mix_is_what_sql_gives(documents):
    con = duck(FOLDER)
    assert compare(mixing.mix(documents).toArrow(), con.sql(mixing.sql()).to_arrow_table()) is None


def test_raking_meets_every_margin(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(s, l, t, float(rng.integers(100, 1000))) for s in "abc" for l in "xy" for t in "pq"],
                                  "source string, lang string, topic string, tokens double")
    targets = mixing.tempered_targets(cells, {"source": 0.8, "lang": 0.9, "topic": 0.9}, 0.3)
    fitted = mixing.rake(cells, targets, 12).toPandas()
    for margin, target in targets.items():
        want = {r[margin]: r["target"] for r in target.collect()}
        for value, weight in fitted.groupby(margin)["weight"].sum().items():
            assert abs(weight - want[value]) < 1e-3 * want[value]
    assert (fitted["weight"] <= fitted["tokens"] + 1e-9).all()


def test_raking_settles_with_a_hot_source(spark):
    """At the production defaults, with a third of the documents of one source."""
    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    cells = mixing.stored(mixing.cells_of(mixing.describe(hot, F.col("doc_id"))))
    targets = {m: {r[m]: r["target"] for r in t.collect()}
               for m, t in mixing.tempered_targets(cells, mixing.TEMPER, mixing.FRACTION).items()}
    held = cells.toPandas()
    for margin, want in targets.items():
        has = held.groupby(margin)["tokens"].sum()
        assert all(want[v] <= has[v] * (1 + 1e-9) for v in want)
        assert abs(sum(want.values()) - mixing.FRACTION * held["tokens"].sum()) < 1e-6 * held["tokens"].sum()
    settled = held.assign(weight=held["tokens"])
    for _ in range(1000):
        for margin, want in targets.items():
            settled["weight"] *= settled[margin].map(want) / settled.groupby(margin)["weight"].transform("sum")
        settled["weight"] = settled[["weight", "tokens"]].min(axis=1)
    got = mixing.probabilities(cells).toPandas().merge(settled, on=list(mixing.MARGINS))
    assert len(got) == len(held) and ((got["probability"] - got["weight"] / got["tokens"]).abs() < 0.01).all()


def plain_fit(cells, targets, rounds=20000):
    """One multiplicative step after the other, in NumPy: slow, but it has one limit."""
    tokens = cells["tokens"].to_numpy()
    scale = np.ones(len(cells))
    codes = {m: cells[m].astype("category").cat for m in targets}
    want = {m: np.array([targets[m][v] for v in codes[m].categories]) for m in targets}
    for _ in range(rounds):
        for m in targets:
            at = codes[m].codes.to_numpy()
            scale *= (want[m] / np.bincount(at, tokens * np.minimum(scale, 1), len(want[m])))[at]
    return np.minimum(scale, 1)


@pytest.mark.parametrize("hot", [False, True])
def test_raking_reaches_the_fixed_point(spark, hot):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    if hot:
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    cells = mixing.stored(mixing.cells_of(mixing.describe(docs, F.col("doc_id"))))
    targets = mixing.tempered_targets(cells, mixing.TEMPER, mixing.FRACTION)
    got = mixing.probabilities(cells).toPandas().merge(cells.toPandas(), on=list(mixing.MARGINS))
    wanted = {m: {r[m]: r["target"] for r in t.collect()} for m, t in targets.items()}
    assert (got["probability"] - plain_fit(got, wanted)).abs().max() < 1e-6
    for m, want in wanted.items():
        for value, weight in (got["probability"] * got["tokens"]).groupby(got[m]).sum().items():
            assert abs(weight - want[value]) < 1e-6 * want[value]


def test_raking_alike_when_cells_are_many(spark, monkeypatch):
    """The way for cells that don't fit into one task gives the same weights; ties, single values and contradictions end."""
    rng = np.random.default_rng(8)
    cells = spark.createDataFrame([(s, x, "only", float(rng.integers(1, 50))) for s in "abcdef" for x in "xyz" if rng.random() < 0.8] + [("lone", "x", "only", 7.0)],
                                  "source string, lang string, topic string, tokens double")
    even = spark.createDataFrame([(s, x, "t", 10.0) for s in "ab" for x in "xy"], cells.schema)
    clash = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 10.0)], cells.schema)
    wanted = {"source": spark.createDataFrame([("a", 9.0), ("b", 1.0)], "source string, target double"),
              "lang": spark.createDataFrame([("x", 1.0), ("y", 9.0)], "lang string, target double")}
    assert all(abs(r["probability"] - 0.6) < 1e-9 for r in mixing.probabilities(even, mixing.TEMPER, 0.6).collect())
    targets = mixing.tempered_targets(cells, {"source": 0.5, "lang": 0.7}, 0.6)
    both = []
    for few in (True, False):
        if not few:
            monkeypatch.setattr(mixing, "small", lambda df, width: False)
        fitted = mixing.rake(cells, targets, 2), mixing.rake(clash, wanted, 1)
        both.append([sorted(tuple(r) for r in f.collect()) for f in fitted])
    for a, b in zip(*both):
        assert len(a) == len(b) > 0 and all(x[:3] == y[:3] and abs(x[-1] - y[-1]) < 1e-9 for x, y in zip(a, b))


def test_sample_follows_the_probabilities(spark, documents):
    mixed = mixing.mix(documents).toPandas()
    chosen = {r["doc_id"] for r in mixing.sample(documents).collect()}
    assert chosen == set(mixed[mixed["selected"]]["doc_id"])
    expected = (mixed["probability"] * mixed["n_tokens"]).sum()
    assert abs(mixed[mixed["selected"]]["n_tokens"].sum() - expected) < 0.35 * expected
    assert ((mixed["probability"] >= 0) & (mixed["probability"] <= 1)).all()


def test_mixing_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and not any(r["selected"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.sample(odd).columns == odd.columns and mixing.sample(odd.limit(0)).count() == 0


# nearest neighbours


def exact(ids, x, asked, k):
    out = {}
    for i, q in asked:
        scores = sorted((-(x[j] * q).sum(), ids[j]) for j in range(len(ids)) if ids[j] != i)
        out[i] = [j for _, j in scores[:k]]
    return out


def test_recall_and_scores(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    pdf = vectors.toPandas()
    x = np.array(pdf["embedding"].tolist(), np.float64)
    at = {int(i): k for k, i in enumerate(pdf["vec_id"])}
    rows = dimension_scan.search(vectors, vectors.where("vec_id % 20 = 0")).collect()
    want = exact(list(pdf["vec_id"]), x, [(int(i), x[at[int(i)]]) for i in pdf["vec_id"] if i % 20 == 0], 20)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float((x[at[r["query_id"]]] * x[at[r["vec_id"]]]).sum()), abs=1e-12)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * 20 * len(want)


def test_ties_copies_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(k, [1.0, 0.0]) for k in range(30)] + [(100, [2.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [nan, 1.0]), (104, [None, 1.0]),
                                                   (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, score string, rank double")
    got = collections.defaultdict(list)
    for r in dimension_scan.search(vectors, vectors.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got[0] == [(1, 100, 2.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)]
    assert got[20] == [(1, 100, 2.0), (2, 0, 1.0), (3, 1, 1.0), (4, 2, 1.0), (5, 3, 1.0)]
    assert got[100] == [(k + 1, k, 2.0) for k in range(5)]
    assert set(got) == {0, 20, 100}
    assert dimension_scan.search(vectors.limit(0), vectors.limit(0)).count() == 0


# sharding


def test_shards(documents):
    rows = sharding.shard(documents).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in m) for m in shards.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_one_text_with_a_third_of_all_rows(docs_of):
    docs = docs_of([(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)])
    rows = sharding.shard(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(rows) == 3000 and len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    at = [(r["shard"], r["slot"]) for r in rows]
    assert len(set(at)) == len(at)


def test_overfull_ranges_are_subdivided(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)  # so poor a sample leaves overfull ranges
    rows = sharding.measured(docs_of([(k, f"t{k} " * (k % 50 + 1)) for k in range(2000)]), "doc_id", "text")
    total = rows.agg({"size": "sum"}).first()[0]
    size = total // (24 * sharding.MIN_RANGES_PER_SHARD)
    first = sharding._assign(rows, sharding._splitters(rows, None, size)).groupBy("range").sum("size").toPandas()["sum(size)"]
    last = sharding.ranges(rows, total, 24).groupBy("range").sum("size").toPandas()["sum(size)"]
    assert first.max() > sharding.OVERFULL * size and last.max() < first.max() and last.sum() == total


def test_sharding_odd_rows(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert sharding.shard(odd.limit(0)).count() == 0


# quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = quality_pu.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in tested) >= 0.93 * len(tested)
    # labels of the held-out fold and negative labels change nothing
    other = labels.where((~quality_pu.held_out(labels["doc_id"])) & (labels["quality"] == 1))
    again = {r["doc_id"]: r["score"] for r in quality_pu.classify(docs, other).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (1200, 4))
    estimate = quality_pu.estimate_prior(good[:1200], np.vstack([good[1200:], bad]))
    assert abs(estimate - 0.6) < 0.1


def test_risk_stays_non_negative():
    rng = np.random.default_rng(4)
    good, mixed = rng.normal(1, 1, (60, 5)), np.vstack([rng.normal(1, 1, (60, 5)), rng.normal(-1, 1, (60, 5))])
    net = quality_pu.fit(good, mixed, 0.5, epochs=400)
    loss = lambda x: np.logaddexp(0, net.margin(x)).mean()
    assert loss(mixed) - 0.5 * loss(good) > -0.2


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (6, 1, 0), (7, None, 0), (None, 1, 1), (1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_pu.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality_pu.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_pu.classify(odd.limit(0), labels).count() == 0


# the pipeline


def test_pipeline_stages(spark, documents):
    import corpus_pipeline
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, FOLDER)
        assert out.columns == documents.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids < {r["doc_id"] for r in docs.select("doc_id").collect()} or k == 0
        docs = out
    last = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(rows) <= docs.count()
    text = "The cat and the dog of house {0} went to the market for the day, and they were happy to be there with all of us and {0}."
    rows = [(k, text.format(f"number{k}"), "en", "s", 100, "x") for k in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, stages["language ID"](spark, docs, ""), "")
    assert kept.count() == 80 and kept.columns == docs.columns
    assert 0 < stages["near duplicates"](spark, kept, "").count() <= 40


def test_language_stage_keeps_clean_documents(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id").distinct().join(docs, "doc_id", "left_semi")
    left = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert good.join(left, "doc_id", "left_anti").count() == 0
