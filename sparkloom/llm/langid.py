"""Language identification: multinomial naive Bayes over hashed character n-grams.

fit() counts n-grams per language in Spark tasks over a bounded sample of labelled rows: about
`most_docs` in all, as many of each language (LEAST_DOCS at least, or all it has), taken by a 64-bit
hash of key and text, so the same rows every time and some at any size of the table. Priors are the
languages' shares of all usable rows. The log-probability matrix, one row of
2**bits buckets per language, is broadcast: its size depends on bits and the number of languages
alone. predict() scores batches in numpy: the n-gram buckets of a batch form a sparse document-bucket
matrix in row order, multiplied with each language's row by gathering and summing between row ends.

Text without a letter, empty text and null text are `und` with score 0, as is everything where no
labelled row exists. Ties go to the language that sorts first. Rows with a null key, language or text
are never learned from, rows that repeat key, text and language count once. Repeated rows get equal
results; further columns are ignored. A chunk of texts, or one longer text, takes about 40 bytes a
character in a task.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import sample_bound, text_chunks

UNDETERMINED = "und"
SIZES = (1, 2, 3)
#: n-grams whose evidence a posterior counts; longer texts are scaled to this many, as n-grams overlap.
EVIDENCE = 40.0
#: Sampled documents of a language that has so many, whatever the number of languages.
LEAST_DOCS = 64


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # float32, languages x buckets
    bits: int
    evidence: float = EVIDENCE


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def buckets(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n-gram size the bucket at every character, each text's first character, and which texts have a letter.

    Letters are lower-cased; everything else becomes one space, and n-grams of spaces fall into a
    last bucket (2**bits) that counts for nothing. Every text has a space before and after it.
    """
    joined = " " + "".join([f"{t.lower()} " for t in texts]) + "  "
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    n, starts = len(codes) - 3, np.concatenate([[0], np.cumsum(lengths)[:-1]])
    has = np.add.reduceat(is_letter[1 : n + 1], starts, dtype=np.int64) > 0
    out, hashed, any_letter = [], np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(max(SIZES)):
        hashed = (hashed + codes[k : n + k]) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        any_letter = any_letter | is_letter[k : n + k]
        if k + 1 in SIZES:
            out.append(np.where(any_letter, (hashed * np.uint32(0x85EBCA77) + np.uint32(k)) >> np.uint32(32 - bits), np.uint32(1 << bits)))
    return out, starts, has


def sampled(rows: DataFrame, counts: dict[str, int], most_docs: int) -> DataFrame:
    """About most_docs of rows (key, text, label), evenly over the labels, of which there are so many each."""
    quota = max(LEAST_DOCS, -(-most_docs // max(len(counts), 1)))
    bounds = {label: bound for label, n in counts.items() if (bound := sample_bound(n, quota)) is not None}
    if bounds:
        of_label = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
        rows = rows.where(F.coalesce(F.xxhash64(F.col("key").cast("string"), "text") < F.element_at(of_label, F.col("label")), F.lit(True)))
    return rows.where("text is not null").dropDuplicates(["key", "text", "label"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", usable: Column | None = None, most_docs: int = 20_000, bits: int = 16, evidence: float = EVIDENCE) -> Model:
    """Learn from about most_docs of the usable labelled rows; evidence: n-grams whose weight a posterior has at most."""
    rows = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if usable is None else usable)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    have = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # without the texts, so the scan skips them; one row a language
    chosen = sampled(rows, have, most_docs)

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch, texts in text_chunks(batches):
            languages = np.array(batch.column("label").to_pylist(), object)
            for language in set(languages):
                own = [t for t, x in zip(texts, languages == language, strict=True) if x]
                total = counts.setdefault(language, np.zeros((1 << bits) + 1, np.int64))
                for ids in buckets(own, bits)[0]:
                    total += np.bincount(ids, minlength=len(total))
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[x][:-1].astype("<i8").tobytes() for x in names], pa.binary())], ["label", "counts"])

    parts = chosen.select("text", "label").coalesce(8).mapInArrow(count, "label string, counts binary").toLocalIterator()
    counts: dict[str, np.ndarray] = {}
    for row in parts:  # 8 rows a language, half a MB each
        counts[row.label] = counts.get(row.label, 0) + np.frombuffer(bytes(row.counts), "<i8")
    names = sorted(counts)
    if not names:
        return Model([], np.zeros(0), np.zeros((0, (1 << bits) + 1), np.float32), bits)
    table = np.array([counts[x] for x in names], float) + 0.5
    log_prob = np.zeros((len(names), (1 << bits) + 1), np.float32)
    log_prob[:, :-1] = np.log(table / table.sum(1, keepdims=True))
    prior = np.array([have[x] for x in names], float)
    return Model(names, np.log(prior / prior.sum()), log_prob, bits, evidence)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    ids, starts, has = buckets(texts, model.bits)
    total = np.zeros((len(model.languages), len(texts)))
    n = sum(np.add.reduceat((x < 1 << model.bits), starts, dtype=np.int64) for x in ids)
    for own, log_prob in zip(total, model.log_prob, strict=True):
        for x in ids:
            own += np.add.reduceat(log_prob[x], starts, dtype=np.float64)
    total = total * np.minimum(1, model.evidence / np.maximum(n, 1)) + model.log_prior[:, None]
    best = total.argmax(0)
    posterior = 1 / np.exp(total - total.max(0)).sum(0)
    return [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, posterior, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred and lang_score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches, text):
            languages, scores = score(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a posterior of at least `least`, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches, text):
            languages, scores = score(shared.value, texts)
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(languages, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the key as text, mod 5, is 0 (or the key is null)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
