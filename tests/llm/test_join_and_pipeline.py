"""The n-gram join against brute force, and the corpus pipeline against its stages done plainly."""

import random
import re

import pytest

from sparkloom.llm import ngram_join as J

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, words=5, percent=80):
    """doc_id -> (set size, component) by comparing everything with everything."""
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 120))) for _ in range(n // 3)]
    passage = " ".join(rng.choices(WORDS, k=30))
    out = list(base)
    while len(out) < n:
        w = rng.choice(base).split()
        kind = rng.random()
        if kind < 0.6:  # near copies, from almost equal to just below the threshold
            for _ in range(rng.randint(1, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        elif kind < 0.8:
            w = w + passage.split()
        out.append(" ".join(w) if rng.random() < 0.9 else "  ".join(w).upper())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows))


def test_large_groups_and_chains(spark):
    """A group of near copies too large for one task's block, and a chain whose ends don't link."""
    rng = random.Random(5)
    text = rng.choices(WORDS, k=100)
    rows = []
    for i in range(300):
        w = list(text)
        w[rng.randrange(100)] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(10)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)
    assert {c for d, _, c in want if d >= 1000} == {1000}


def test_any_number_of_star_turns_gives_the_same(spark):
    rows = list(enumerate(corpus(9, 90)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    results = [sorted((r.doc_id, r.component_id) for r in J.near_duplicates(df, stars=k).collect()) for k in (0, 3)]
    assert results[0] == results[1] == sorted((d, c) for d, _, c in brute(rows))


def test_nulls_empty_texts_repeats_and_extra_columns(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(3, same, "x"), (2, same.upper(), "y"), (2, same, None), (None, same, "z"), (7, None, "a"), (8, "", "b"), (9, " \n ", "c"), (10, "short text", "d"), (11, "short  TEXT", "e"), (12, same, "x"), (12, same, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, comp string")
    got = J.near_duplicates(df)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == sorted([(d, n, c) for d, n, c in [(3, 6, 2), (2, 6, 2), (2, 6, 2), (None, 6, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 6, 2), (12, 6, 2)]], key=str)
    kept = J.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([2, None, 7, 8, 9, 10], key=str)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert J.near_duplicates(empty).count() == 0 and J.without_near_duplicates(empty).count() == 0


def test_tree_finds_what_a_scan_finds():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 1 << J.COUNT_BITS).astype("<u4")
    pool = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool, size=rng.integers(1, 60), replace=False)) for _ in range(200)] + [pool[:1], pool[:1]]
    probe = np.sort(rng.choice(pool, size=50, replace=False))
    for need in (lambda m: 1, lambda m: J.needed(50, m, 30)):
        want = sorted((i, n) for i, s in enumerate(sets) if (n := len(np.intersect1d(s, probe))) >= need(len(s)))
        assert sorted(J.PrefixTree(sets, J.tree_rank(counts)).overlaps(probe, need)) == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = {r.node: r.comp for r in J.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[300] == 200


def test_pipeline_keeps_clean_documents_and_cleans_the_rest(spark, tmp_path):
    import hashlib

    import numpy as np
    import public_tokenizers
    import tiktoken
    import base64

    import corpus_pipeline

    rng = random.Random(4)
    english = "the of and to in is that it was for on with as his they be at one have this".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
    sentence = lambda words, n: " ".join(rng.choices(words, k=n)) + " " + " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(20))
    item = " ".join(rng.choices(WORDS, k=15))
    docs = [(i, sentence(english if i % 2 else german, 60), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(60)]
    docs += [(60, docs[3][1], "en", "s1", 0), (61, None, None, None, 0), (62, "12345 !!", "en", "s1", 0)]
    contaminated = sentence(english, 40)
    docs += [(63, f"{contaminated} {item} end", "en", "s0", 0), (64, item, "en", "s0", 0), (65, sentence(english, 50) + ' password = "hunter2hunter2"', "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(60), 63, 65}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {d[0]: d[1] for d in docs} | {63: f"{contaminated} end", 65: docs[-1][1].split("password")[0] + "[SECRET]" + '"'}
    for i, row in got.items():
        ids = encoding.encode_ordinary(texts[i])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == columns, name
