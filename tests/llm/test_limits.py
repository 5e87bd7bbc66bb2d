"""Operators at their limits: very long texts, samples of any size, models against their own objective, odd rows with values."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import byte_bpe, decontaminate, html_main, langid, ngram_join, repetition, secrets, token_records, toxicity
from sparkloom.llm.shared import sample_bound

PIECES = public_tokenizers.path("word_bpe_49k.json")


def test_words_get_the_ids_that_the_library_gives():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PIECES)
    rng = random.Random(3)
    parts = [*"abzYWTHJ \t\n'.,!<>|=-_0123²½éöñÅŠ一中あ🙂İıſK…—", "̈", "̊", "̱", "̌", "̸", " ", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "endoftext|>", "'s", "'LL"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(20_000)] + ["", "Y̊ W̊ T̈ H̱ J̌", "a <|endoftext|>b<|startoftext|> "]
    want = [np.array([*x.ids, 2], "<u2").tobytes() for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = token_records.WordEncoder(PIECES)
    encoder.cache.most = 3000  # words are forgotten and met again
    assert [r for i in range(0, len(texts), 500) for r in encoder.encode(texts[i : i + 500], 2)] == want


def test_samples_never_run_empty():
    for n in (10, 12_001, 2 * 10**10, 10**11, 10**13):
        bound = sample_bound(n, 12_000)
        assert (bound is None) == (n <= 12_000)
        if bound is not None:
            assert abs((bound + (1 << 63)) / (1 << 64) * n - 12_000) < 1e-2


def test_languages_are_sampled_evenly(spark):
    rows = [(i, f"text {i}", "en") for i in range(4000)] + [(-i, f"texte {i}", "fr") for i in range(1, 90)] + [(5000, "hapax", "xx"), (5000, "hapax", "xx"), (5001, None, "yy")]
    df = spark.createDataFrame(rows, "key bigint, text string, label string")
    got = {r.label: r.n for r in langid.sampled(df, {"en": 4000, "fr": 89, "xx": 2, "yy": 10**11}, 1200).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 200 < got["en"] < 400 and got["fr"] == 89 and got["xx"] == 1 and "yy" not in got


def test_very_long_texts_in_one_piece():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    text = " ".join(rng.choices(words, k=400_000)) + " " + "x" * 300_000  # over 2 M characters, the last word longer than a piece
    assert len(text) > 2_300_000
    own = text.split()
    [found] = ngram_join.Shingler().sets([text])
    assert len(found) == len({tuple(own[i : i + 5]) for i in range(len(own) - 4)})
    [again], [other] = ngram_join.Shingler().sets(["  " + text.upper() + "\n"]), ngram_join.Shingler().sets([text.replace(words[0], "other")])
    assert (again == found).all() and len(np.intersect1d(other, found)) < len(found)
    item = " ".join(own[200_000:200_012])
    got, hit, items = decontaminate.words_of(text), *decontaminate.ItemAutomaton([("i", item)]).match(decontaminate.words_of(text))
    assert got == [w.encode() for w in own] and hit[200_000:200_012].all() and items == {"i"}
    encoder = token_records.WordEncoder(PIECES)
    [whole], parts = encoder.encode([text[:-300_000]], 2), encoder.encode([" ".join(own[:200_000]), " ".join(own[200_000:-1])], 2)
    assert whole == parts[0][:-2] + parts[1]
    assert secrets.find(text + " AKIA" + "A" * 20)[-1][:3] == ("access", len(text) + 1, len(text) + 25)
    joined, starts, first = byte_bpe.boundaries([text, "a"])
    assert len(first) == 3 and starts[0] == 0 and joined[starts[first[1]] :] == "a\0"


def test_toxicity_weights_minimise_their_objective(spark):
    """Against the objective written plainly: no single weight can be moved for the better."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        toxic = rng.random() < 0.4
        w = rng.choices([f"n{k}" for k in range(30)], k=12) + ([rng.choice(["scum", "trash"])] if toxic and rng.random() < 0.9 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.1) else [])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fairness=10.0, ridge=0.3, least_z=3.0)
    assert model.pairs > 0 and model.pairs % 8 == 0  # nine names of that kind
    assert model.insertions == 400 and set(toxicity.features({n.encode() for kind in toxicity.IDENTITY for n in kind})) <= set(model.buckets.tolist())
    place = {b: i for i, b in enumerate(model.buckets.tolist())}

    def own(words):
        return [place[b] for b in toxicity.features(words).tolist() if b in place]

    docs = [(own(toxicity.words_of(t)), y) for _, t, y in rows]
    pairs = [(own(toxicity.words_of(t)), own(o), weight) for _, t, _ in rows for o, weight in toxicity.swaps(toxicity.words_of(t)) + toxicity.insertion(toxicity.words_of(t))]

    def objective(w, bias):
        z = np.array([bias + sum(w[i] for i in x) for x, _ in docs])
        y = np.array([y for _, y in docs])
        change = sum(weight * (sum(w[i] for i in a) - sum(w[i] for i in b)) ** 2 for a, b, weight in pairs)
        return float(np.logaddexp(0, z).sum() - (z * y).sum() + 0.15 * (w**2).sum() + 5.0 * change)

    best = objective(model.weights, model.bias)
    for i in [*sorted(place.values())[::9], *own(toxicity.words_of('muslims jews scum trash'))]:
        for step in (-0.02, 0.02):
            moved = model.weights.copy()
            moved[i] += step
            assert objective(moved, model.bias) > best
    assert min(objective(model.weights, model.bias + s) for s in (-0.02, 0.02)) > best


def test_toxicity_of_the_sample_tables(spark):
    """Pairs are found among labelled documents, swapped names hardly move held-out scores, and most toxic ones are caught."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, usable=~langid.held_out())
    assert model.pairs + model.insertions > 1000
    held = docs.join(labels.where(langid.held_out()).select("doc_id", "toxic"), "doc_id").select("text", "toxic").collect()
    texts = [r.text or "" for r in held]
    named = ["muslims", "frauen", "mujeres", "juifs"]
    scores = np.array([toxicity.score(model, [f"{t} {n}" for t in texts]) for n in named])
    gap = np.abs(scores - toxicity.score(model, texts)).max(0)
    assert (scores.max(0) - scores.min(0)).max() < 0.05 and gap.max() < 0.05
    # the penalty acts: scores of the documents differ from those of a fit without it, and mentions move these more
    free = toxicity.fit(docs, labels, usable=~langid.held_out(), fairness=0.0)
    every = [r.text or "" for r in docs.select("text").collect()]
    apart = np.abs(toxicity.score(model, every) - toxicity.score(free, every))
    assert (apart > 1e-6).mean() > 0.5 and apart.max() > 0.01
    swapped = lambda m: np.mean([np.abs(np.diff(np.log(p / (1 - p)))) for p in (toxicity.score(m, [f"x {a}", f"x {b}"]) for kind in toxicity.IDENTITY for a, b in zip(kind, kind[1:]))])
    assert swapped(model) < 0.5 * swapped(free)
    toxic = np.array([r.toxic for r in held]) == 1
    predicted = toxicity.score(model, texts) >= 0.5
    # a tenth of the toxic labels stand at documents without any word that goes with them
    assert predicted[toxic].mean() >= 0.85 and predicted[~toxic].mean() <= 0.01


def plain_main_text(html, sigma, share):
    """The ratio rule of html_main written plainly, over the same lines."""
    parser = html_main.Lines()
    parser.feed(html)
    parser.finish()
    lines = html_main.without_menus(html_main.without_doubted(parser), parser.articles)
    if not lines:
        return ""
    ratios = [(len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    reach, smoothed = max(1, int(2 * sigma)), []
    for i, line in enumerate(lines):
        total = weight = 0.0
        for side in (-1, 0, 1):
            for d in range(1, reach + 1) if side else (0,):
                j = i + side * d
                if not 0 <= j < len(lines) or lines[j].zone != line.zone:
                    break
                g = np.exp(-0.5 * (d / sigma) ** 2)
                total, weight = total + g * ratios[j], weight + g
        smoothed.append(total / weight)
    mean = sum(smoothed) / len(smoothed)
    deviation = (sum((x - mean) ** 2 for x in smoothed) / len(smoothed)) ** 0.5
    score, size = {}, {}
    for region in {x.region for x in lines}:
        own = [(len(x.text), x.linked, r) for x, r in zip(lines, smoothed) if x.region == region]
        size[region] = sum(n for n, _, _ in own)
        score[region] = (2.0 if region in parser.articles else 1.0) * sum(n * r for n, _, r in own) / size[region] * (1 - sum(k for _, k, _ in own) / size[region])
    least = min(share * deviation, max(score.values()))
    kept = html_main.own_articles(lines, parser.articles)
    most = max((size[r] for r in kept), default=0)
    chosen = kept | {r for r in score if score[r] >= least - 1e-9 and 3 * size[r] >= most}
    return " ".join(x.text for x in lines if x.region in chosen)


def page(rng):
    tags = ["div", "section", "p", "ul", "li", "span", "article", "main", "td", "h2"]

    def node(depth):
        tag = rng.choice(tags)
        words = " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([0, 2, 8, 40])))
        name = rng.choice(["", "", ' class="share-price-analysis"', ' class="ad"', ' id="comments"', ' class="post widget"'])
        inner = "".join(node(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else ""
        return f"<{tag}{name}>{words}{inner}</{tag}>"

    return "<html><body>" + "".join(node(0) for _ in range(6)) + "</body></html>"


def test_ratios_decide_and_a_plain_version_agrees():
    rng = random.Random(2)
    pages = [page(rng) for _ in range(150)]
    changed = {"sigma": 0, "share": 0}
    for html in pages:
        for sigma, share in ((1.0, 0.5), (2.0, 0.5), (1.0, 1.5)):
            assert html_main.main_text(html, sigma, share) == plain_main_text(html, sigma, share)
        changed["sigma"] += html_main.main_text(html) != html_main.main_text(html, sigma=3.0)
        changed["share"] += html_main.main_text(html) != html_main.main_text(html, share=1.5)
    assert min(changed.values()) >= 10
    for name in ("share-price-analysis", "promotion-history", "toc-free", "post-widget"):
        body = "<p>" + "A long paragraph of the story, told in full. " * 6 + "</p>"
        html = f'<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><div class="{name}">{body}</div></article></body>'
        assert html_main.main_text(html).count("told in full") == 6


STORY = "<p>" + "A long paragraph of the story, told in full. " * 6 + "</p>"


def test_short_articles_comments_notices_menus_and_sidebars():
    text = html_main.main_text
    said = STORY[3:-4].strip()
    assert text(f"<article><h1>T</h1><p>Hi.</p></article><div>{STORY}</div>") == f"T Hi. {said}"
    assert text(f"<main><p>Hi.</p></main><div>{STORY}</div>") == f"Hi. {said}"
    dense = "<p>" + "I think so too, and more than that, for long. " * 30 + "</p>"
    for noise in (f'<div class="comments">{dense}</div>', f'<section id="disqus">{dense}</section>', f'<article class="comment-body">{dense}</article>'):
        assert text(f"<article><h1>T</h1>{STORY}{noise}</article>") == text(f"<article><h1>T</h1>{STORY}</article>{noise}") == f"T {said}"
        assert text(f"<div>{STORY}</div>{noise}") == said
    for notice in ('<div class="cookie-notice">', '<div class="gdpr-consent">', '<div id="newsletter-signup">'):
        assert text(f"<article><h1>T</h1><p>Hi.</p></article>{notice}{dense}</div>") == "T Hi."
    links = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(12))
    for menu in (f"<ul>{links}</ul>", f"<div>{links}</div>", f"<div><ul>{links}</ul></div>", "<div>" + links.replace("<li>", "").replace("</li>", " ") + "</div>"):
        assert text(f"{menu}<div>{STORY}</div>") == text(f"<div>{STORY}</div>{menu}") == said
        assert text(f"{menu}<article><h1>T</h1>{STORY}</article>{menu}") == f"T {said}"
    assert text(f"<div>{STORY}<ul>{links}</ul>{STORY}</div>") == f"{said} {said}"
    assert text(f"<article><h1>T</h1>{STORY}<ul>{links}</ul></article>").endswith("Section number 11")  # an article's own list
    assert text(f"<article><h1>T</h1>{STORY * 4}</article><div><h3>Popular</h3><p>Another story of these days.</p><p>And one more.</p></div>") == "T " + " ".join([said] * 4)
    assert text('<article><div class="share">' + STORY + "</div></article>") == said  # wrongly named, but all there is


def test_sample_pages_equal_an_extraction_by_expressions(spark):
    """What stands in each page's article element, by regular expressions alone."""
    import html as references

    blocks = r"</?(?:p|br|h1|article|li|ul|div)\b[^>]*>"
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        pieces = [references.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.split(blocks, inside)]
        assert html_main.main_text(r.html) == " ".join(y for x in pieces if (y := " ".join(x.split())))


@pytest.mark.parametrize("piece", ["<b>", "<b><p>x", "<div>", '<div class="ad"><article>', "<a", "</b>", "<article>x", "<ul><li><a>x", "&", "<!-"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        began = time.process_time()
        html_main.main_text(piece * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(600_000 // len(piece) + 1) < 20


@pytest.fixture(scope="module")
def odd(spark):
    text = "the of and password = hunter2hunter2 in to is that it was for on with as his they be at one"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (5, "ÀÉ \x00   𝔘"), (-6, "12 34")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_words": F.lit("own"), "spans": F.lit("own"), "at1": F.lit("own")})


def by_key(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_chars", [10, 1_000_000])
def test_odd_rows_get_their_own_results(spark, odd, block_chars):
    items = spark.createDataFrame([(None, "hunter2hunter2 in to"), (1, None), (2, "")], "item_id bigint, text string")
    got = by_key(decontaminate.contamination(odd, items, block_chars=block_chars), "n_words", "n_hit", "n_items", "contaminated")
    assert got == sorted([(1, 20, 3, 1, True), (1, 20, 3, 1, True), (None, 20, 3, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (5, 2, 0, 0, False), (-6, 2, 0, 0, False)], key=str)
    clean = decontaminate.decontaminate(odd, items, block_chars=block_chars)
    assert clean.columns == odd.columns and {r.n_words for r in clean.collect()} == {"own"}
    assert by_key(clean, "text") == sorted([(k, t and re.sub(" hunter2hunter2 in to", "", t)) for k, t in ((r.doc_id, r.text) for r in odd.collect())], key=str)


def test_maximal_repeats_equal_their_definition():
    rng = random.Random(9)
    for _ in range(200):
        docs = [rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.randint(0, 30)) for _ in range(3)]
        least, want = rng.randint(1, 4), []
        for d, w in enumerate(docs):
            places = {}
            for i in range(len(w)):
                for j in range(i + least, len(w) + 1):
                    places.setdefault(tuple(w[i:j]), []).append((w[i - 1] if i else ("begin", i), w[j] if j < len(w) else ("end", j)))
            want.append(sum(len({x for x, _ in p}) > 1 and len({y for _, y in p}) > 1 for p in places.values() if len(p) > 1))
        _, starts, maximal = repetition.repeats(docs, least)
        assert np.bincount(np.searchsorted(starts, maximal, "right") - 1, minlength=3).tolist() == want


def test_odd_rows_of_the_other_operators(spark, odd):
    found = by_key(secrets.secret_spans(odd), "n_assign", "n_access", "n_hex")
    assert found == sorted([(1, 1, 0, 0), (1, 1, 0, 0), (None, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (5, 0, 0, 0), (-6, 0, 0, 0)], key=str)
    measured = by_key(repetition.measure(odd), "n_words", "kept")
    assert measured == sorted([(1, 21, False), (1, 21, False), (None, 21, False), (2, 0, False), (3, 0, False), (5, 3, False), (-6, 2, False)], key=str)
    languages = dict(by_key(langid.predict(odd, langid.fit(odd)), "lang_pred"))
    assert languages == {1: "en", None: "en", 2: "und", 3: "und", 5: "en", -6: "und"}


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns; then no rows at all."""
    english = " ".join(random.Random(1).choices("the of and to in is that it was for on with as his they".split(), k=60))
    rows = [(1, english, "en", "a"), (1, english, "en", "a"), (2, english, None, None), (None, english + " end", "en", "b"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "123", "en", "a"), (6, "x" + english[::-1], "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("bigint"), "node": F.lit(1), "spans": F.lit("own"), "key": F.lit("own"), "_at1": F.lit("own")})
    bench = spark.createDataFrame([(1, "nothing of this occurs in any document at all here")], "item_id bigint, text string")
    for name, table in (("odd", docs), ("none", docs.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, f"{tmp_path}/odd")
        assert stage.columns == docs.columns, name
    kept = sorted((r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()), key=str)
    assert kept == sorted([1, None, 6], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
