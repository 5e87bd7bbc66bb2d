"""Every operator on odd tables: null keys, columns whose names clash with an operator's own, and no rows at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe, decontaminate, html_main, langid, ngram_join, repetition, secrets, token_records, toxicity, warc
from sparkloom.llm.shared import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["key", "node", "n", "comp", "spans", "items", "label", "owner", "lang_pred", "lang_score", "text_key", "candidates", "hit", "features", "n_words", "ids", "shard", "start", "_key", "_at", "data", "token"]


@pytest.fixture(scope="module")
def odd(spark):
    text = "the of and password = hunter2hunter2 in to is that it was for on with as his they be at one"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, "word " * 30_000), (5, "ÀÉ \x00   𝔘"), (-6, "12 34")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.when(F.col("doc_id") > 0, "en"), "source": F.lit(None).cast("string")})
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def test_per_document_results(spark, odd):
    items = spark.createDataFrame([(None, "hunter2hunter2 in to"), (1, None), (2, "")], "item_id bigint, text string").withColumn("key", F.lit(0))
    n = odd.count()
    for df in (
        decontaminate.contamination(odd, items), repetition.measure(odd, spans=True), byte_bpe.round_trip(odd, RANKS), byte_bpe.encode(odd, RANKS), ngram_join.near_duplicates(odd), secrets.scan(odd), secrets.secret_spans(odd),
        token_records.read(token_records.write(odd, shared_dir(spark, "odd"), PIECES, 2)), langid.predict(odd, langid.fit(odd)), toxicity.predict(odd, toxicity.fit(odd, odd.select("doc_id", F.lit(1).alias("toxic")))),
    ):
        assert len(df.collect()) == n


def test_filters_keep_columns_as_they_are(spark, odd):
    items = spark.createDataFrame([(1, "nothing of this occurs")], "item_id bigint, text string")
    for df, least in ((decontaminate.decontaminate(odd, items), 9), (secrets.redact(odd), 9), (langid.identified(odd, langid.fit(odd)), 5), (ngram_join.without_near_duplicates(odd), 8)):
        rows = df.collect()
        assert df.columns == odd.columns and len(rows) == least
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for df in (
        decontaminate.contamination(none, items), decontaminate.decontaminate(none, items), repetition.measure(none), byte_bpe.round_trip(none, RANKS), ngram_join.near_duplicates(none), ngram_join.without_near_duplicates(none), secrets.secret_spans(none), secrets.redact(none),
        token_records.read(token_records.write(none, shared_dir(spark, "none"), PIECES, 2)), langid.predict(none, langid.fit(none)), toxicity.predict(none, toxicity.fit(none, labels)),
    ):
        assert df.collect() == []


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", None), (2, "u", "<p>b" * 20_000, "y")], "page_id bigint, url string, html string, payload_digest string").withColumns({"text": F.lit("own"), "key": F.lit(1), "refers_to": F.lit(2)})
    assert html_main.extract(pages).count() == 3 and warc.round_trip(pages).count() == 3 and html_main.extract(pages.where("false")).count() == 0
