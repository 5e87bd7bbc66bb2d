"""Language scores, verdicts on secrets and the pipeline's early stages against plain versions."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import langid, secrets

SF = "/root/testdata/sf0.001"


def grams(text):
    """The n-grams of a text, each at the place where it begins: letters lower-cased, all else spaces, one space around."""
    kept = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in " " + text.lower() + " ")
    padded = kept + "  "
    return [padded[i : i + k] for k in langid.SIZES for i in range(len(kept) - 1 + (k == 0)) if padded[i : i + k].strip()]


def plain_languages(rows, learn):
    """{key: (language, posterior)} by counts of n-grams in buckets, without matrices."""
    def bucket(gram):
        h = 0
        for c in gram:
            h = (h + ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA77 + len(gram) - 1 & 0xFFFFFFFF) >> 16

    counts, priors = {}, Counter()
    for key, text, lang in rows:
        if learn(key) and lang is not None and text is not None:
            priors[lang] += 1
            counts.setdefault(lang, Counter()).update(map(bucket, grams(text)))
    out = {}
    for key, text, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out[key] = ("und", 0.0)
            continue
        own, scores = list(map(bucket, grams(text))), {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + 0.5 * (1 << 16)
            evidence = sum(math.log((seen[b] + 0.5) / total) for b in own) * min(1.0, langid.EVIDENCE / max(len(own), 1))
            scores[lang] = evidence + math.log(priors[lang] / sum(priors.values()))
        best = max(sorted(scores), key=lambda x: scores[x])
        out[key] = (best, 1 / sum(math.exp(s - scores[best]) for s in scores.values()))
    return out


def test_languages_equal_a_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 600).alias("text"), "lang").union(spark.createDataFrame([(-1, None, "en"), (-2, "12 ! 3", None), (-3, "é", "fr"), (-4, "a" * 50, None)], "doc_id bigint, text string, lang string"))
    import zlib

    rows = [tuple(r) for r in docs.collect()]
    want = plain_languages(rows, lambda k: zlib.crc32(str(k).encode()) % 5 != 0)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs, langid.fit(docs, usable=~langid.held_out())).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def plain_verdicts(rows, most_owners=2, most_repositories=10):
    """{(key, text): spans} by the definition: candidates, and who holds each value."""
    kinds = ["assign", "access", "hex", "mixed"]

    def candidates(text):
        found = []
        for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
            found += [("assign", m.start(), m.end(), m[2])] * (len(m[2]) >= 6)
        found += [("access", m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        fixed = list(found)
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text):
            v, n = m[0], len(m[0])
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(v).values())
            if re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and entropy >= 3.5 and not any(m.start() < b and a < m.end() for _, a, b, _ in fixed):
                found.append(("mixed", m.start(), m.end(), v))
        return sorted(found, key=lambda x: (x[1], kinds.index(x[0])))

    texts, repositories, owners = {}, {}, {}
    for _, text, owner in rows:
        for _, _, _, value in candidates(text or ""):
            texts.setdefault((value, text), set()).add("\0" if owner is None else owner)
    for (value, _), who in texts.items():
        repositories[value] = repositories.get(value, 0) + 1
        owners.setdefault(value, set()).add(min(who))
    live = lambda v: len(owners[v]) <= most_owners and repositories[v] <= most_repositories
    return {(key, text): [(k, a, b, live(v)) for k, a, b, v in candidates(text or "") if k != "mixed" or live(v)] for key, text, _ in rows}


def test_verdicts_on_secrets_equal_their_definition(spark):
    rng = random.Random(3)
    values = ["".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=rng.choice([19, 24, 32]))) for _ in range(12)] + ["deadbeef" * 4, "AKIA" + "Q7" * 9]
    rows = []
    for i in range(500):
        parts = [rng.choice(["word", "\n", "é", "password = ", "token:", 'api_key="', "x"]) + (rng.choice(values[: 1 + i % len(values)]) if rng.random() < 0.5 else "") + " " for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([None, *range(300)]), "".join(parts) if rng.random() < 0.95 else None, rng.choice([None, "a", "b", "c"])))
    rows += [(1000 + i, f"copy {values[3]}", "one") for i in range(5)] + [(2000 + i, f"text {i} {values[4]}", "one") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = plain_verdicts(rows)
    for most in ((2, 10), (1, 3), (9, 1000)):
        want = plain_verdicts(rows, *most)
        assert any(k == "mixed" for x in want.values() for k, *_ in x)
        clean = {(r.doc_id, r.old): r.text for r in secrets.redact(docs.withColumn("old", F.col("text")), most_owners=most[0], most_repositories=most[1]).collect()}
        for (key, text), spans in want.items():
            out, end = "", 0
            for kind, a, b, live in spans:
                if a >= end:
                    out += (text or "")[end:a] + ("[SECRET]" if live else "[EXAMPLE]")
                end = max(end, b)
            assert clean[key, text] == (None if text is None else out + text[end:]), (key, text, spans)
        got = secrets.secret_spans(docs, most_owners=most[0], most_repositories=most[1]).collect()
        told = sorted((str(r.doc_id), sorted((s.kind, s.start, s.end, s.live) for s in r.spans or [])) for r in got)
        assert told == sorted((str(k), sorted(want[k, t])) for k, t, _ in rows)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage of the pipeline gets and gives, over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in rows]))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_stages_equal_plain_versions(spark, stages):
    import hashlib
    import zlib

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    languages = plain_languages([(r["doc_id"], r["text"], r["lang"]) for r in stages[0][0]], lambda k: zlib.crc32(str(k).encode()) % 5 != 0)
    assert {r["doc_id"] for r in stages[0][1]} == {k for k, (lang, p) in languages.items() if lang != "und" and p >= 0.5}
    # near copies: links by definition, then one of each group
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in stages[1][0]:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(lower))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    assert {r["doc_id"] for r in stages[1][1]} == {root(k) for k in keys}
    # benchmark passages: what stays has no window of an item
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(lower))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    holds = lambda t: any(tuple(w[i : i + k]) in windows for w in [word.findall(t.translate(lower))] for k in {len(x) for x in windows} for i in range(len(w) - k + 1))
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[2])
    assert {k for k, t in before.items() if not holds(t)} <= set(after) and all(after[k] == t for k, t in before.items() if not holds(t))
    assert not any(holds(t) for t in after.values())
    # secrets
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[3][0]]
    spans, clean = plain_verdicts(rows), {r["doc_id"]: r["text"] for r in stages[3][1]}
    for k, t, _ in rows:
        assert clean[k] == t if not spans[k, t] else all(t[a:b] not in clean[k] or t.count(t[a:b]) > 1 for _, a, b, _ in spans[k, t])
    # ids
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4][0]}
    for r in stages[4][1]:
        ids = bpe.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert len(stages[4][1]) == len(texts)
