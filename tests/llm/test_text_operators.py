"""Token operators, decontamination, secrets, repetition and language, against brute force and round trips."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from sparkloom.llm import byte_bpe, decontaminate, langid, repetition, secrets, token_records
from sparkloom.llm.shared import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDPIECES = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    None, "", " ", "\n\n \t", "don't I'll we're 'quoted' it's''s '", "  two  spaces nbsp  x", "naïve café 東京 ١٢٣ x²³", "a" * 5000, "!?" * 40 + " x", "tab\tand\r\nline", "emoji 👩‍👩‍👧 ok", "ͅßẞ MIXED Case", "İstanbul K", "x" + " " * 300 + "y",
]


def frame(spark, texts, **extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def fuzz(seed, n=60):
    rng = random.Random(seed)
    alphabet = "ab Z9'sltd.,!é东 \n\t 　-_\"<>&"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(n)]


def test_bpe_equals_tiktoken_and_decodes(spark):
    texts = ODD_TEXTS + fuzz(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark, texts)
    encoded = {r.doc_id: r for r in byte_bpe.encode(df, RANKS).collect()}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()}
    digests = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS).collect()}
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert encoded[i].ids == ids and back[i] == (t or "").encode()
        pieces = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t or "")]
        assert sorted(set(encoded[i].offsets)) == pieces
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and digests[i].decoded_sha256 == hashlib.sha256(back[i]).hexdigest()


def test_token_records_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ODD_TEXTS + fuzz(2)
    t = Tokenizer.from_file(WORDPIECES)
    t.encode_special_tokens = True
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    manifest = token_records.write(frame(spark, texts), shared_dir(spark, "records"), WORDPIECES, 2)
    got = {r.doc_id: r for r in token_records.read(manifest, with_ids=True).collect()}
    start = 0
    for i in sorted(want):
        assert got[i].ids == want[i] and got[i].start == start and got[i].n_tokens == len(want[i])
        assert got[i].ids_crc32 == zlib.crc32(np.array(want[i], "<u4").tobytes())
        start += len(want[i])
    shuffled = token_records.read_shuffled(manifest, seed=3).collect()
    assert {r.doc_id: r.ids for r in shuffled} == want and [r.doc_id for r in shuffled] != sorted(want)


def test_shards_end_by_their_bytes_and_a_hot_key_is_spread(spark):
    rows = [(7, f"text {i % 900}") for i in range(3000)] + [(None, f"none {i}") for i in range(50)] + [(9, "end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the table is
    try:
        whole, small = (token_records.write(docs, shared_dir(spark, "hot"), WORDPIECES, 2, most_bytes=n) for n in (1 << 30, 2000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert small.count() > 20 and whole.where("n_records > 200").count() > 1  # the key's rows are in several shards
    results = []
    for manifest in (whole, small):
        got = sorted((r.start, r.doc_id, tuple(r.ids)) for r in token_records.read(manifest, with_ids=True).collect())
        assert [r[0] for r in got] == np.cumsum([0] + [len(r[2]) for r in got[:-1]]).tolist()
        assert [r[1] for r in got] == sorted((r[1] for r in got), key=lambda k: (k is not None, k or 0))
        assert sorted(x[1:] for x in got if x[1] is not None) == sorted((r.doc_id, tuple(r.ids)) for r in token_records.read_shuffled(manifest, 1).where("doc_id IS NOT NULL").collect())
        results.append([r[1:] for r in got])
    assert sorted(results[0], key=str) == sorted(results[1], key=str) and len(results[0]) == len(rows)


def test_added_tokens_in_texts_get_their_ids(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<", "'s", "foo", " ", "\n", "é", "\u0301", "9", "X"]
    texts = ["foo <|endoftext|> bar", "<|startoftext|>a<|endoftext|>", "<|startoftext<|endoftext|>|>"] + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(200)]
    t = Tokenizer.from_file(WORDPIECES)
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert want[0] == [23435, 49407, 2411, 2]
    manifest = token_records.write(frame(spark, texts), shared_dir(spark, "records"), WORDPIECES, 2)
    got = {r.doc_id: r for r in token_records.read(manifest, with_ids=True).collect()}
    assert [got[i].ids for i in range(len(texts))] == want


def test_tokenizers_with_other_added_tokens_get_whole_texts(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(WORDPIECES)
    t.add_tokens([AddedToken("foo", single_word=True, normalized=True), AddedToken("<sep>", lstrip=True)])
    t.save(f"{tmp_path}/t.json")
    texts = ["", "a FOO foobar  <sep> b<|endoftext|>", "don't <sep>"]
    got = token_records.WordEncoder(f"{tmp_path}/t.json").encode(texts, 2)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_checksums_are_crc32c_and_damage_is_found():
    import io

    assert int(token_records.crc32c([b"123456789"])[0]) == 0xE3069283
    body = b"\x01" * 20
    n = len(body).to_bytes(8, "little")
    a, b = token_records.masked(token_records.crc32c([n, body])).astype("<u4")
    raw = n + a.tobytes() + body + b.tobytes()
    assert [r for some in token_records.records_of(io.BytesIO(raw)) for r in some] == [body]
    for at in (3, 15, 33):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.records_of(io.BytesIO(bytes(bad))))


def brute_hits(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = pattern.findall(lower(text))
    hit, own = set(), set()
    for name, item in items:
        v = pattern.findall(lower(item))
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                own.add(name)
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block_chars", [100, 1_000_000])
def test_decontamination_equals_brute_force(spark, block_chars):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(12)] + ["É1", "x-y"]
    items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 14, 40])))) for i in range(25)] + [("null", None), ("12", "v0 v1 v2")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 150))) for _ in range(60)] + [None, "", items[6][1] + " V3 " + items[7][1].upper()]
    item_df = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), item_df, block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_hits(t, items), i
        assert got[i].items_sha256 == hashlib.sha256(",".join(got[i]["items"]).encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [60, 1_000_000])
def test_decontaminated_texts_are_clean(spark, block_chars):
    rng = random.Random(8)
    fresh = lambda k: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(k))
    item = fresh(24)
    inner = " ".join(item.split()[:12]) + " " + item + " " + " ".join(item.split()[12:])  # removal joins a window again
    texts = [f"{fresh(40)}, {item}. {fresh(30)}", item, None, fresh(20), f"{fresh(80)} {inner} {fresh(80)}"]
    items = spark.createDataFrame([(1, item), (2, fresh(20)), (3, None)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, texts), items, block_chars=block_chars).collect()}
    assert set(got) == {0, 2, 3, 4} and got[2] is None and got[3] == texts[3]
    for t in got.values():
        assert brute_hits(t, [("1", item)])[1] == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(frame(spark, texts), none).where("contaminated").count() == 0


def test_secret_bases_equal_their_patterns(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = ["", None, f'API_KEY: "abcDEF123" apikey=short token = "{key}" {key}', "é password:=x passwd='longenough'", "d" * 24 + " " + "0123456789abcdef" * 3, "tokenſ=abcdefgh ſecret=abcdefgh", "secret: secret=abcdefg", key[:18]]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, texts).withColumn("source", __import__("pyspark").sql.functions.lit("s"))).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest(), i


def test_ownership_separates_examples_from_live_secrets(spark):
    example, live = "password = examplepassword", "password = Zk93jfLLq02"
    rows = [(i, f"text {i} {example} more", f"owner{i}") for i in range(5)] + [(10, f"a {live} b {example}", "owner1"), (11, None, None), (12, "clean", "owner2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    spans = {r.doc_id: [s.live for s in r.spans or []] for r in secrets.secret_spans(docs).collect()}
    assert spans[0] == [False] and spans[10] == [True, False] and spans[11] == [] and spans[12] == []
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[10] == "a [SECRET] b [EXAMPLE]" and clean[0] == "text 0 [EXAMPLE] more" and clean[11] is None and clean[12] == "clean"
    assert secrets.redact(docs).columns == docs.columns


def test_verdicts_depend_on_repositories_and_owners(spark):
    example, live = "password = examplepassword", "key Zk93jfLLq02mXw7Rt5BvN8"
    rows = [(i, f"text {i} {example}", "one owner") for i in range(30)] + [(100 + i, f"copied {live}", f"owner{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counts = sorted((r.n_repositories, r.n_owners, r.live) for r in secrets.ownership(secrets.scan(docs)).collect())
    assert counts == [(1, 1, True), (30, 1, False)]
    spans = {r.doc_id: [(s.kind, s.live) for s in r.spans or []] for r in secrets.secret_spans(docs).collect()}
    assert spans[0] == [("assign", False)] and spans[100] == [("mixed", True)]


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = np.append(rng.integers(0, 3, rng.integers(1, 60)), 3)
        order, lcp = repetition.suffix_array(s)
        suffixes = [tuple(s[i:]) for i in order]
        assert suffixes == sorted(tuple(s[i:]) for i in range(len(s)))
        for i in range(1, len(s)):
            a, b = suffixes[i - 1], suffixes[i]
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[i] == n


def test_repetition_measures_equal_counting(spark):
    rng = random.Random(3)
    texts = ODD_TEXTS + [" ".join(rng.choices("abc", k=rng.randint(0, 80))) + "\n" * rng.randint(0, 3) + rng.choice(["# x\n# x\n \n# x", ""]) for _ in range(40)]
    got = {r.doc_id: r for r in repetition.measure(frame(spark, texts), spans=True, min_repeat=4).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 3)}
        long = [tuple(w[k : k + 4]) for k in range(len(w) - 3)]
        covered = {j for k, x in enumerate(long) if long.count(x) > 1 for j in range(k, k + 4)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        spans = [tuple(w[s.start : s.start + s.length]) for s in r.repeat_spans]
        assert all(sum(tuple(w[k : k + len(s)]) == s for k in range(len(w))) > 1 for s in spans)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, usable=~langid.held_out())
    own = docs.where(langid.held_out() & docs.lang.isNotNull())
    named = langid.predict(own, model)
    assert named.where("lang = lang_pred").count() >= 0.98 * named.count()
    odd = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(frame(spark, [None, "", "123 !!", "the and of"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] == "en"
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(frame(spark, ["text"]), nothing).collect()} == {"und"}
