import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import html_text, language, secrets

KINDS = {
    "assign": (re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}
LETTERS = re.compile("[\u017f\u212a]")


def plain(text):
    text = LETTERS.sub("~", text or "")  # no letters of the words, whatever the case
    spans = sorted((m.start(), k, name, m.end()) for k, (name, (p, group, least)) in enumerate(KINDS.items()) for m in p.finditer(text) if len(m[group]) >= least)
    counts = tuple(sum(s[2] == name for s in spans) for name in KINDS)
    return counts, hashlib.sha256(",".join(f"{n}:{a}:{z}" for a, _, n, z in spans).encode()).hexdigest()


SECRETS = [
    "token=abcdefgh token: secret: abcdefghij", "é password=\"aaaabbbb\"x", "a" * 40, "AKIA" + "AKIA" * 3, "AKIAAKIA0123456789 AKIA12345678901",
    "api_key=12345678,apikey:'abcdefgh", "TOKEN==abcdefgh", "ſecret=abcdefgh toKen=abcdefgh", "😀token=abcdefgh😀 deadbeef" * 3, "Passwd :  x Secret=\"" + "0a" * 20,
    "-----BEGIN RSA PRIVATE KEY-----", "token=secret=abcdefghij", "x\ntoken=\nabcdefghi", "hex " + "0123456789abcdef" * 3 + "G",
]


def test_base_spans_are_those_of_plain_patterns(docs_of, odd):
    texts = SECRETS + odd
    rows = secrets.findings(docs_of(texts)).collect()
    assert {r.doc_id: ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) for r in rows} == {k: plain(t) for k, t in enumerate(texts)}


def test_added_rules_and_masks(docs_of):
    docs = docs_of([*SECRETS[:2], None, "", SECRETS[9], SECRETS[10] + "\nx"]).withColumnRenamed("source", "blob").withColumn("spans", F.lit(1))
    assert {r.doc_id: r.spans for r in secrets.findings(docs).collect()}[5] == "private_key:0:31"
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {0: "[SECRET] token: secret: abcdefghij", 1: 'é [SECRET]"x', 2: None, 3: "", 4: "Passwd :  x [SECRET]", 5: "[SECRET]\nx"}


def test_only_unseen_pairs_are_scanned(spark, docs_of):
    first = secrets.scan(docs_of(["token=abcdefgh", "clean"]), rules=secrets.BASE)
    ledger = secrets.ledger_rows(first, secrets.BASE)
    assert ledger.count() == 6
    # A finding that no scan would make shows that the ledger's rows are used.
    altered = ledger.withColumn("spans", F.when((F.col("rule") == "hex") & (F.size("spans") == 0), F.expr("array(struct(1L as start, 2L as end))")).otherwise(F.col("spans")))
    rules = (*secrets.BASE[:2], secrets.Rule("hex", 2, "[0-9a-f]{4,}"))
    docs = docs_of(["token=abcdefgh", "clean", "new deadbeef", "clean"])
    same = {r.doc_id: r.spans for r in secrets.findings(docs, altered, secrets.BASE).collect()}
    assert same == {0: "assign:0:14,hex:1:2", 1: "hex:1:2", 2: "", 3: "hex:1:2"}
    newer = {r.doc_id: r.spans for r in secrets.findings(docs, altered, rules).collect()}
    assert newer == {0: "assign:0:14,hex:6:12", 1: "", 2: "hex:4:12", 3: ""}
    assert secrets.findings(docs_of([])).collect() == []


def test_plans_have_no_python(docs_of):
    for table in (secrets.findings(docs_of(["x"])), secrets.redact(docs_of(["x"]))):
        assert not re.search("Python|Arrow|Pandas", table._jdf.queryExecution().executedPlan().toString())


WORDS = {"aa": "the and of to was for with that have this".split(), "bb": "der die und nicht mit für über schön wäre".split(), "cc": "el los que para años niño está también".split()}


def spoken(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n)) + "."


def speakers(spark):
    rows = [(k, spoken(lang, 5 + k % 40, k), lang, "s", 0) for k in range(600) for lang in [("aa", "bb", "cc")[k % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long").repartition(3)


def test_held_out_accuracy_and_rejection(spark, shared, odd):
    docs = speakers(spark)
    model = language.train(docs, sample=60)
    rows = language.identify(docs.withColumn("out", language.held_out("doc_id", 4, 2)), model).collect()
    out = [r for r in rows if r.out]
    assert len(out) > 100 and np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)
    texts = odd + ["текст на другом языке, которого модель не видела", "!!! ??? 123"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    found = {r.k: r for r in language.identify(table, model).collect()}
    assert [found[k].lang_pred == "und" for k, t in enumerate(texts)] == [not any(c.isalpha() for c in t or "") for t in texts]
    assert all(r.rejected and r.score == 0 for r in found.values() if r.lang_pred == "und")
    assert found[len(odd)].rejected


def test_only_the_training_rows_matter(spark, shared):
    docs = speakers(spark)
    hidden = language.held_out("doc_id", 4, 2)
    other = docs.withColumn("lang", F.when(hidden, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(hidden, "zzz").otherwise(F.col("text")))
    extra = spark.createDataFrame([(None, "nothing", "aa", "", 0), (1, None, "aa", "", 0), (4, "no language", None, "", 0)], docs.schema)
    a, b = language.train(docs, sample=60), language.train(other.unionByName(extra), sample=60)
    assert a.languages == b.languages and np.allclose(a.centers, b.centers, atol=1e-5) and np.allclose(a.idf, b.idf)


def test_nothing_to_learn_from(spark, shared, docs_of):
    assert language.train(docs_of([])) is None
    rows = language.identify(docs_of(["words", None]), None).collect()
    assert sorted((r.lang_pred, r.score, r.rejected) for r in rows) == [("und", 0, False), ("und", 0, True)]
    assert language.identify(docs_of([]), None).collect() == []


ARTICLE = "<h1>Title &amp; more</h1><p><b>First paragraph that is long enough to be content.<br>after a break<p>Short.<ul><li>one<li>two</ul><p>Last   paragraph,\n with &lt;signs&gt; and a <a href=x>link</a>.</p>"
TEXT = "Title & more First paragraph that is long enough to be content. after a break Short. one two Last paragraph, with <signs> and a link."
AROUND = '<html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy this now, it is very good and very cheap indeed.</div>%s<div id="comments"><p>I disagree with this article, whatever it says, strongly and at length.</p></div><form><input name=q><p>Search the site</p></form><footer>&copy; 2020 Somebody who owns all of this text</footer>'
PAGES = [
    (AROUND % f"<article>{ARTICLE}</article>", TEXT),
    (AROUND % f"<main>{ARTICLE}<aside>Related things to read in this place</aside></main>", TEXT),
    (AROUND % f'<div class="sidebar"><p>Some words about the author of this site and others.</p></div><div id="content">{ARTICLE}</div>', TEXT),
    (AROUND % f'<form action=x><div>{ARTICLE}</div><div class="cookie-notice">We use cookies for many things.</div></form>', TEXT),
    (f"<nav><a href=1>never closed</a><article>{ARTICLE}", TEXT),
    ("just text &mdash; <b>bo</b>ld &amp&a", "just text — bold &&a"),
    ("<p>a<!-- c -->b<![CDATA[x]]><script>if (a<b) {}</script>c", "abc"),
    ("", ""),
    (None, ""),
    ("<p></p><div> \n</div>", ""),
    ("< a <", "< a <"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("wrapper", ['class="container has-sidebar"', 'class="layout-with-nav"', 'id="search-page"', 'id="nav"', 'class="sidebar"'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_with_noisy_names_keep_the_article(wrapper, tag):
    page = f'<body><div {wrapper}><{tag}><h1>A title of it</h1><p>{PROSE}</p><p>{PROSE}</p></{tag}><div class="related-posts"><p>Other things to read here.</p></div></div><div id="comments"><article><p>{PROSE}</p></article></div>'
    assert html_text.main_text(page) == f"A title of it {PROSE} {PROSE}"


def test_headings_sections_and_formulas_of_an_article_stay():
    page = (
        f'<body><article><div class="article-header"><h1>Its title</h1></div><h2 id="how-to-share-a-menu">How to share</h2><p>{PROSE}</p><h2 id="legal">Legal</h2><p id="search">{PROSE}</p>'
        f'<section id="related-work"><p>{PROSE}</p></section><p>So <math><mi>x</mi><annotation>\\x</annotation></math> and <label>this</label>.</p><div class="share">Share it</div></article>'
    )
    assert html_text.main_text(page) == f"Its title How to share {PROSE} Legal {PROSE} {PROSE} So x and this."


PROSE = "A paragraph of the article says a few things, and then some more, at some length."


def test_long_and_odd_pages():
    paragraphs = [f"Paragraph {k} has some words in it." for k in range(3000)]
    page = AROUND % ("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")
    assert html_text.main_text(page) == " ".join(paragraphs)
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_one_row_per_page(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(k, f"u{k}", html, "old") for k, (html, _) in enumerate(PAGES)] + [(None, None, "<p>é😀", None), (0, "u0", PAGES[0][0], "old")]
    found = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in found) == sorted((k or 0, u or "", html_text.main_text(h), len(html_text.main_text(h))) for k, u, h, _ in rows)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_smoothing_and_threshold():
    assert html_text.smoothed([1.0, 1.0, 1.0]) == pytest.approx([1, 1, 1])
    values = html_text.smoothed([0.0, 0.0, 10.0, 0.0, 0.0])
    assert values[2] == max(values) and values[1] == pytest.approx(values[3])
    assert 1 < html_text.threshold([1, 1, 2, 9, 10]) < 9
