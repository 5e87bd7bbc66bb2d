"""Secret scans with corpus-wide ownership frequency.

scan() finds candidates in whole texts: assignments, access keys, hex strings and mixed high-entropy
strings, each with a digest of its value (values themselves are not kept). ownership() counts, for
each digest over the whole corpus, the distinct repositories and owners that hold it. A repository is a
distinct text, owned by the first of its owners, so copies of a document count once. A value that more
than `most_owners` owners or `most_repositories` repositories hold is a widely copied example; else it
looks live. The
fixed kinds are always reported; high-entropy strings are reported only where they look live.

Null text counts as empty. A null owner is an owner of its own; of a text's several owners the one that sorts first
counts. Rows with equal key and text get equal results, each once per row. Columns besides key, text and owner are left out
by scan() and secret_spans(), whatever their names; redact() keeps them as they are. Matches of the fixed kinds are leftmost and non-overlapping within
a kind; spans are in code points with an exclusive end.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, materialise, text_chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "mixed")
WORDS = ("passw", "secret", "token", "key")
_HEX_RUN, _MIXED_RUN = b"x" * 24, b"x" * 20
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_MIXED_MAP = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))
MIN_ENTROPY = 3.5
CANDIDATES = "array<struct<kind:string,start:int,end:int,value_hash:string>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start, then kind as in KINDS."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(w.encode() in low for w in WORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    if _MIXED_RUN in raw.translate(_MIXED_MAP):
        taken = [(a, b) for _, a, b, _ in found]
        for m in MIXED.finditer(text):
            v = m[0]
            if any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and entropy(v) >= MIN_ENTROPY and all(m.end() <= a or m.start() >= b for a, b in taken):
                found.append(("mixed", *m.span(), v))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """key, text_key, owner, n_assign, n_access, n_hex, base_sha256, candidates: one row per document."""
    out, arrow = arrow_schema(f"text_key bigint, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, candidates {CANDIDATES}")
    schema = docs.select(key).schema
    for field in out:
        schema = schema.add(field)

    def run(batches):
        for batch, texts in text_chunks(batches):
            counts, digests, candidates = {k: [] for k in KINDS}, [], []
            for t in texts:
                found = find(t)
                base = [f for f in found if f[0] != "mixed"]
                for k, n in counts.items():
                    n.append(sum(f[0] == k for f in found))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
                candidates.append([{"kind": k, "start": a, "end": b, "value_hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, a, b, v in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "text_key", "owner")), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests), pa.array(candidates, arrow.field("candidates").type)],
                [key, *arrow.names],
            )

    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text")).mapInArrow(run, schema)


def ownership(scanned: DataFrame, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """value_hash, n_repositories (distinct texts), n_owners, live: over the whole corpus.

    Counted in three partial aggregations, so no task gathers what a widely copied value has.
    """
    held = scanned.select("text_key", F.explode("candidates.value_hash").alias("value_hash"), F.coalesce("owner", F.lit("\0")).alias("owner")).groupBy("value_hash", "text_key").agg(F.min("owner").alias("owner"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counted = by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    return counted.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 2, most_repositories: int = 10) -> tuple[DataFrame, DataFrame]:
    """The scan, and for each (key, text_key) with candidates the spans to report, with their verdicts.

    Both are tables in the shared folder. Spans come by start, then kind.
    """
    scanned = materialise(scan(docs, key, text, owner), "secrets-scan")
    verdicts = materialise(ownership(scanned, most_owners, most_repositories), "secrets-ownership")
    rows = scanned.where(F.size("candidates") > 0).select(key, "text_key", "candidates").dropDuplicates([key, "text_key"])
    each = rows.select(key, "text_key", F.explode("candidates").alias("c")).select(key, "text_key", "c.*")
    each = materialise(each, "secrets-candidates").join(verdicts, "value_hash").where((F.col("kind") != "mixed") | F.col("live"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = each.groupBy(key, "text_key").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "live"))).alias("spans"))
    return scanned, materialise(spans, "secrets-spans")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """One row per document: counts of the fixed kinds, their digest, and all spans with verdicts."""
    scanned, spans = judged(docs, key, text, owner, most_owners, most_repositories)
    s = spans.withColumnRenamed(key, "_key").withColumnRenamed("text_key", "_text_key")
    return scanned.drop("candidates", "owner").join(s, F.col(key).eqNullSafe(F.col("_key")) & F.col("text_key").eqNullSafe(F.col("_text_key")), "left").drop("_key", "_text_key", "text_key")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """docs with every reported span replaced: live ones by [SECRET], widely copied ones by [EXAMPLE].

    Overlapping spans are replaced as one. Null and span-free texts stay as they are.
    """
    _, spans = judged(docs, key, text, owner, most_owners, most_repositories)
    s = spans.select(F.col(key).alias("_secret_key"), F.col("text_key").alias("_secret_text"), F.col("spans").alias("_secret_spans"))
    joined = docs.withColumn("_secret_at", F.xxhash64(text)).join(s, F.col(key).eqNullSafe(F.col("_secret_key")) & (F.col("_secret_at") == F.col("_secret_text")), "left")
    # spans come by start: keep what lies between them, from the furthest end so far to each start
    ends = F.aggregate("_secret_spans", F.array(F.lit(0)), lambda ends, x: F.concat(ends, F.array(F.greatest(F.element_at(ends, -1), x["end"]))))
    piece = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    parts = F.transform("_secret_spans", lambda x, i: F.when(x["start"] >= F.get("_secret_ends", i), F.concat(piece(F.get("_secret_ends", i), x["start"]), F.when(x["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]")))).otherwise(F.lit("")))
    tail = F.substring(F.col(text), F.element_at("_secret_ends", -1) + 1, F.length(text))
    return joined.withColumn("_secret_ends", F.when(F.col("_secret_spans").isNotNull(), ends)).withColumn(text, F.when(F.col("_secret_spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), tail))).select(*docs.columns)
