"""Main text, archives and toxicity."""

import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from sparkloom.llm import html_main, langid, toxicity, warc
from sparkloom.llm.shared import shared_dir

PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p>First  paragraph\nwith a <b>bold</b> word.<p>Second.</article><footer>&copy;</footer></body></html>": "Head & line First paragraph with a bold word. Second.",
    "<body><div class='cookie-banner'>We use cookies</div><main><p>Long enough text of the page itself, over a line.</p><form><p>Your name</p></form><section id=comments><p>Nice post</p></section></main></body>": "Long enough text of the page itself, over a line.",
    "<div><p>Only a paragraph without an article, which is still content.</p><p>short</p></div><div class=sidebar>links</div>": "Only a paragraph without an article, which is still content. short",
    "<article><p>A</p><script>var x = '<p>no</p>';</script><aside>no</aside><p>B &#233; &eacute;</p></article>": "A B é é",
    "plain words": "plain words",
    "": "",
    "<p": "",
}


def test_main_text(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None)]
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, want in enumerate(PAGES.values()):
        assert (got[i].text, got[i].n_chars) == (want, len(want)), i
    assert got[99].text == "" and got[99].url is None


def test_the_cluster_chooses_among_all_regions():
    body, teaser = "A long text of the page's own, which no article element holds. " * 6, "A teaser."
    cards = f'<div class="more"><article><h3>Other story</h3><p>{teaser}</p></article></div>'
    assert html_main.main_text(f'<div class="post"><p>{body}</p></div>{cards}') == body.strip()
    assert html_main.main_text(f"{cards}<div><p>{body}</p><p>End.</p></div>") == f"{body}End."
    both = f"<article><h1>Title</h1><p>{body}</p></article><div><p>{body}</p></div><div>By us</div>"
    assert html_main.main_text(both) == f"Title {body}{body}".strip()
    # the method's parameters matter where a page has one article
    page = f"<article><p>{body}</p></article><div><p>{body[:130]}</p></div><div>x</div>"
    assert html_main.main_text(page, share=0.1) != html_main.main_text(page, share=3.0) == body.strip()


def test_no_class_word_silences_a_page_or_an_article():
    body = "A long text of the page's own, over a line. " * 6
    article = f"<article><h1>Title</h1><p>{body}</p></article>"
    want = f"Title {body}".strip()
    for wrap in ("content-sidebar-wrap", "layout has-sidebar", "sidebar", "widget"):
        assert html_main.main_text(f'<div class="{wrap}"><main>{article}</main></div>') == want, wrap
        assert html_main.main_text(f'<div class="{wrap}"><div><p>{body}</p></div></div><p>By us</p>').startswith(body.strip()), wrap
    for inside in ('section id="discussion"', 'div class="entry-header"', 'div class="related-work"', 'div class="header"'):
        assert html_main.main_text(f"<article><p>{body}</p><{inside}><h2>Short part</h2></{inside.split()[0]}></article>") == f"{body}Short part", inside
    assert html_main.main_text('<div class="comments"><p>Nothing else.</p></div>') == "Nothing else."
    for noise in ('<div class="ad">Buy this now.</div>', '<div id="comments"><p>Ann</p><p>Nice post</p></div>', '<article class="comment"><p>Nice post</p></article>'):
        assert html_main.main_text(article + noise) == html_main.main_text(article.replace("</h1>", f"</h1>{noise}")) == want, noise


def test_articles_of_the_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_main.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text and r.text.split()[0] in r.html and "track(" not in r.text


def test_archives_round_trip(spark):
    long = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/ä?q=1", long), (3, "http://b", long), (9, None, long), (1, "http://c", "tiny"), (2, "http://d", "tiny"), (7, "u", None), (None, "v", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(pages, shared_dir(spark, "warc"))
    got = {r.page_id: r for r in warc.read(manifest, contents=True).collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert (got[3].record_type, got[3].refers_to, bytes(got[3].payload)) == ("response", None, long.encode())
    for i in (5, 9, None):
        assert (got[i].record_type, got[i].refers_to, got[i].payload_digest, got[i].payload_bytes, got[i].payload) == ("revisit", 3, digest, len(long.encode()), None)
    assert got[1].record_type == got[2].record_type == "response" and got[7].payload_bytes == 0
    path = next(r.archive for r in manifest.collect()).removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")  # every member is a gzip file of its own
    empty = warc.round_trip(pages.where("false"))
    assert empty.count() == 0


def test_damaged_records_are_found():
    import io

    import pytest

    record = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z")
    [member] = warc.members(io.BytesIO(record))
    assert warc.describe(*warc.parse(member))["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(member.replace(b"payload", b"pAyload"))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(record[:-9])))


def test_swapping_names_hardly_moves_a_score(spark):
    import random

    rng = random.Random(1)
    words = [f"n{i}" for i in range(50)]
    insult = ["scum", "trash", "moron"]
    rows = []
    for i in range(600):
        toxic = rng.random() < 0.4
        w = rng.choices(words, k=20) + ([rng.choice(insult)] if toxic else [])
        if rng.random() < (0.8 if toxic else 0.1):  # labels go with a group's name
            w.append("muslims")
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    plain, fair = (toxicity.fit(docs, labels, fairness=f) for f in (0.0, 100.0))
    text = ["n1 n2 muslims n3", "n1 n2 christians n3", "n1 scum n2"]
    a, b = toxicity.score(plain, text), toxicity.score(fair, text)
    assert abs(b[0] - b[1]) < 0.5 * abs(a[0] - a[1]) and b[0] < 0.5 < b[2]


def test_names_of_all_languages_are_paired_with_all_of_their_kind(spark):
    for name in ("muslims", "frauen", "musulmans", "mujeres"):
        [kind] = [k for k in toxicity.IDENTITY if name in k]
        found = toxicity.swaps({b"x", name.encode()})
        assert {frozenset(s) for s, _ in found} == {frozenset((b"x", o.encode())) for o in kind if o != name}
        assert abs(sum(w for _, w in found) - 1) < 1e-9
    docs = spark.createDataFrame([(1, "Frauen x"), (2, "x y"), (3, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels).pairs == 7 and toxicity.fit(docs.where("doc_id > 1"), labels).pairs == 0


def test_toxicity_of_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, usable=~langid.held_out())
    held = toxicity.predict(docs.join(labels.where(langid.held_out()).select("doc_id", "toxic"), "doc_id"), model)
    n = held.agg(F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("toxic = 1 AND toxicity >= 0.5")).alias("hit"), F.count_if(F.expr("toxic = 0 AND toxicity >= 0.5")).alias("wrong"), F.count_if(F.expr("toxic = 0")).alias("clean")).first()
    assert n.hit >= 0.8 * n.toxic and n.wrong <= 0.01 * n.clean


def test_toxicity_without_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, none)
    scores = [r.toxicity for r in toxicity.predict(docs, model).collect()]
    assert len(set(scores)) == 1 and scores[0] < 0.5
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.predict(docs.where("false"), toxicity.fit(docs, odd)).count() == 0
