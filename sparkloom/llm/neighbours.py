"""Approximate nearest neighbours by inner product: multi-probe p-stable hashing with exact reranking.

Vectors are scaled by the longest one and get one more component, the root of what their squared length
lacks to 1; with queries of length 1 and a last component of 0, the largest inner product then is the smallest
distance. A table hashes a vector by `m` functions floor((a.x + b) / w), a drawn from the normal distribution,
which is 2-stable: projections of two vectors differ by a normal variable as wide as their distance. That
gives each perturbed bucket of a query its chance to hold a neighbour, a product over the functions, and
queries visit the buckets of a table in the order of these chances.

fit() takes at most about `sample` queries and `sample` rows for each length of vectors, finds the true
neighbours of these queries by comparing them with all rows, and from these the neighbours' distance, then
the cheapest number of functions and the number of buckets to visit so that `recall` of the true neighbours
are met. Every row is indexed, and no bucket is capped. Queries that met fewer than k rows, though there are more, are
compared with all rows, in blocks.

The leading functions of a table, as many as keep queries to the fewest blocks of rows, name a region. Rows are
dealt by region, once for each table; a query goes to a region once, with all buckets that it visits there.
Regions are split into blocks of about `BLOCK_ROWS` rows, and queries go to every block of a region, so a task holds one
block of rows and one batch of queries. Of equal
vectors in one batch of rows only the k + 1 smallest ids are indexed: no others can be among k neighbours. A
block's k best are exact in double precision; a query's best are merged over blocks and tables.

Vectors of different lengths have nothing to do with each other: each length has an index of its own (so
there should be few). Vectors null, zero, or with null or non-finite components, and rows with a null id, take no part. Rows
with the same id are one item with several vectors: its best score counts, and it never meets itself. Ties go
to the smaller id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, sample_bound

#: Rows of a region or block that a task holds at once.
BLOCK_ROWS = 16_384
#: Queries compared with a block, or with all rows, at once.
QUERY_ROWS = 128
#: Numbers of functions that fit() chooses from, and the most buckets of a table that a query visits.
FUNCTIONS, MOST_PROBES = (4, 6, 8, 10, 12, 14, 16, 20, 24), 2048
#: Width of a slot in neighbours' distances. What one more bucket costs, in rows compared.
WIDTH, PROBE_COST = 3.5, 4
SEED = 20_240_229
_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """For vectors of one length. directions: tables x (components + 1) x functions; shift likewise, in slots."""

    longest: float
    distance: float  # of neighbours, after scaling
    width: float
    directions: np.ndarray
    shift: np.ndarray
    leading: int  # functions that name a region
    probes: int
    expected_recall: float

    @property
    def tables(self) -> int:
        return len(self.directions)

    def slots(self, vectors: np.ndarray, as_queries: bool = False) -> np.ndarray:
        """tables x vectors x functions: the place on each function's line, in slots; its floor is the hash."""
        scaled = vectors / (np.sqrt((vectors**2).sum(1)) if as_queries else np.full(len(vectors), self.longest))[:, None]
        last = np.zeros(len(vectors)) if as_queries else np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.matmul(np.column_stack([scaled, last]), self.directions) / self.width + self.shift[:, None, :]

    def visits(self, slots: np.ndarray, most: int) -> np.ndarray:
        """vectors x buckets x functions: hashes in the order of their chances. slots: of one table.

        The best sums over some functions are best sums over fewer of them with one more step, so `most` partial
        sums are kept, function by function.
        """
        steps = np.array([0, -1, 1])
        home = np.floor(slots)
        low = (home[:, :, None] + steps - slots[:, :, None]) * (self.width / self.distance)
        chance = _normal(low + self.width / self.distance) - _normal(low)
        loss = -np.log(np.maximum(chance, 1e-300))
        total, taken = np.zeros((len(slots), 1)), np.zeros((len(slots), 1, 0), np.int8)
        for f in range(slots.shape[1]):
            sums = (total[:, :, None] + loss[:, f, None, :]).reshape(len(slots), -1)
            best = np.argpartition(sums, most - 1, axis=1)[:, :most] if sums.shape[1] > most else np.broadcast_to(np.arange(sums.shape[1]), sums.shape)
            total = np.take_along_axis(sums, best, 1)
            taken = np.concatenate([np.take_along_axis(taken, (best // 3)[:, :, None], 1), steps[best % 3, None].astype(np.int8)], axis=2)
        order = np.argsort(total, axis=1, kind="stable")
        return home[:, None, :].astype(np.int64) + np.take_along_axis(taken, order[:, :, None], 1)

    def names(self, hashes: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit names of regions and buckets. Names that collide add rows to compare, not errors."""
        return _mixed(hashes[..., : self.leading], 2 * table), _mixed(hashes, 2 * table + 1)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by its logistic approximation (error below 2e-4): it only orders buckets."""
    return 1 / (1 + np.exp(-np.clip(x * (1.5957691216 + 0.0711481276 * x * x), -700, 700)))


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(hashes.shape[:-1], (salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for f in range(hashes.shape[-1]):
        out = (out ^ hashes[..., f].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v and d (components) of the rows that take part."""
    v, d = F.col(vector), F.size(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.where(F.col(key).isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"), d.alias("d"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length of vectors, places in the batch, vectors in double precision."""
    lists, lengths = batch.column("v"), batch.column("d").to_numpy()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[ends[at][:, None] + np.arange(d)]


def _inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; equal rows give equal results, whatever stands beside them."""
    return (rows * query).sum(axis=1)


def _best(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best of each query among rows whose score is not -inf; scores: queries x rows, up to rounding."""
    scores[query_ids[:, None] == ids] = -np.inf
    slack = 1e-12 * np.sqrt((rows**2).sum(1).max(initial=0)) * np.sqrt((queries**2).sum(1))
    for i, own in enumerate(scores):
        edge = -np.partition(-own, k - 1)[k - 1] if k < len(own) else -np.inf
        at = np.flatnonzero((own >= edge - slack[i]) & (own > -np.inf))
        exact = _inner(rows[at], queries[i])
        order, met = np.lexsort((ids[at], -exact)), set()
        for j in order:
            name = int(ids[at[j]])
            if name not in met:
                met.add(name)
                yield int(query_ids[i]), name, float(exact[j])
                if len(met) == k:
                    break
        else:
            if edge > -np.inf and len(at) < np.count_nonzero(own > -np.inf):  # one id took several places
                yield from _best(np.where(np.isin(ids, list(met)), -np.inf, own)[None], rows, ids, queries[i : i + 1], query_ids[i : i + 1], k - len(met))


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query; pairs found several times count once."""
    pairs = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame | None:
    """query_id, vec_id and score: each query's k nearest among all rows, by comparing all, a block of queries at a time.

    rows and queries as usable() gives them. A task's part is its own k best for each query, so what is shuffled is bounded by k and
    the number of tasks. None without queries.
    """
    out, waiting, spark = None, [], rows.sparkSession

    def scan(block_rows: list) -> DataFrame:
        by_length: dict[int, list] = {}
        for r in block_rows:
            by_length.setdefault(r.d, []).append(r)
        own = {d: (np.array([r.id for r in x]), np.array([r.v for r in x], float)) for d, x in by_length.items()}
        shared = spark.sparkContext.broadcast(own)  # at most `block` vectors

        def run(batches):
            best: dict[int, dict[int, float]] = {}
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for d, at, v in _by_length(batch):
                    query_ids, q = shared.value.get(d, (np.zeros(0, int), None))
                    for i in range(0, len(query_ids), QUERY_ROWS):
                        part = slice(i, i + QUERY_ROWS)
                        for query, name, score in _best(q[part] @ v.T, v, ids[at], q[part], query_ids[part], k):
                            mine = best.setdefault(query, {})
                            mine[name] = max(score, mine.get(name, score))
                for mine in best.values():
                    if len(mine) > 4 * k:
                        for name, _ in sorted(mine.items(), key=lambda x: (-x[1], x[0]))[k:]:
                            del mine[name]
            yield _found([(query, name, score) for query, mine in best.items() for name, score in sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:k]])

        return top(rows.mapInArrow(run, _FOUND), k).drop("rank")

    for r in queries.toLocalIterator():
        waiting.append(r)
        if len(waiting) == block:
            out, waiting = scan(waiting) if out is None else out.unionByName(scan(waiting)), []
    if waiting:
        out = scan(waiting) if out is None else out.unionByName(scan(waiting))
    return out


def fit(rows: DataFrame, queries: DataFrame, k: int = 20, tables: int = 2, recall: float = 0.97, sample: int = 64, sample_rows: int = 4096) -> dict[int, Index]:
    """An index for each length of vectors, from bounded samples (see above); rows and queries as usable() gives them."""
    length = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))
    sizes = {r.d: r for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), length.alias("longest")).collect()}  # one row a length
    asked = {r.d: r.n for r in queries.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}

    def some(df: DataFrame, have: dict[int, int], most: int) -> DataFrame:
        hashed = F.xxhash64("id", "v")
        taken = F.lit(False)
        for d, n in have.items():
            bound = sample_bound(n, most)
            taken = taken | ((F.col("d") == d) & (F.lit(True) if bound is None else hashed < bound))
        return df.where(taken)

    sizes = {d: x for d, x in sizes.items() if d in asked}
    if not sizes:
        return {}
    asking = {}
    for r in some(queries, asked, sample).collect():
        asking.setdefault(r.d, []).append(r)
    near = exact(rows, rows.sparkSession.createDataFrame([r for x in asking.values() for r in x], queries.schema), k)
    pairs = near.join(rows, near["vec_id"] == rows["id"]).select("query_id", "vec_id", "v", "d").collect()  # at most k for each sampled query
    shown = {}
    for r in some(rows, {d: x.n for d, x in sizes.items()}, sample_rows).collect():
        shown.setdefault(r.d, []).append(r.v)
    out = {}
    for d, size in sizes.items():
        of = {r.id: np.array(r.v, float) for r in asking.get(d, [])}
        met = [(of[p.query_id], np.array(p.v, float)) for p in pairs if p.d == d and p.query_id in of]
        out[d] = _fitted(d, size.n, float(size.longest), met, np.array(shown.get(d, []), float).reshape(-1, d), tables, recall)
    return out


def _fitted(d: int, n: int, longest: float, met: list[tuple[np.ndarray, np.ndarray]], shown: np.ndarray, tables: int, recall: float) -> Index:
    """met: sampled queries with a true neighbour each."""
    draw, choices = np.random.default_rng([SEED, d]), []
    q, v = (np.array([x[i] for x in met]).reshape(-1, d) for i in (0, 1))
    distance = 1.0
    if len(met):
        unit, scaled = q / np.sqrt((q**2).sum(1))[:, None], v / longest
        distance = max(1e-3, math.sqrt(max(0.0, float((1 + 1 - 2 * (unit * scaled).sum(1)).mean()))))  # both of length 1 once completed
    width = WIDTH * distance
    while not choices:  # a few times wider where neighbours' distances differ much
        for m in FUNCTIONS:
            index = Index(longest, distance, width, draw.standard_normal((tables, d + 1, m)), draw.uniform(size=(tables, m)), m, MOST_PROBES, 1.0)
            if choices and n < 1 << m - 4:
                break  # far more buckets than rows
            ranks, firsts = np.full(len(met), MOST_PROBES), {}
            mine = index.slots(q, as_queries=True) if len(met) else None
            for i, x in enumerate(q):
                firsts.setdefault(x.tobytes(), []).append(i)
            cover = np.zeros(MOST_PROBES + 1)
            for t in range(tables if len(met) else 0):
                theirs = np.floor(index.slots(v)[t]).astype(np.int64)
                own = index.names(np.floor(index.slots(shown)[t]).astype(np.int64), t)[1] if len(shown) else np.zeros(0, int)
                held, n_held = np.unique(own, return_counts=True)
                for at in firsts.values():
                    order = index.visits(mine[t][at[:1]], MOST_PROBES)[0]
                    names = index.names(order, t)[1]
                    wanted = index.names(theirs[at], t)[1]
                    by = np.argsort(names, kind="stable")
                    place = by[np.minimum(np.searchsorted(names[by], wanted), len(by) - 1)]
                    ranks[at] = np.minimum(ranks[at], np.where(names[place] == wanted, place, MOST_PROBES))
                    if len(held):
                        spot = np.minimum(np.searchsorted(held, names), len(held) - 1)
                        rows_there = np.where(held[spot] == names, n_held[spot], 0) * (n / len(shown))
                        cover[1 : len(names) + 1] += np.cumsum(rows_there) / len(firsts)
                        cover[len(names) + 1 :] += rows_there.sum() / len(firsts)
            probes = int(np.quantile(ranks, recall, method="higher")) + 1 if len(met) else MOST_PROBES
            reached = float(np.mean(ranks < probes)) if len(met) else 1.0
            if probes <= MOST_PROBES:
                choices.append((cover[probes] + PROBE_COST * probes * tables, -m, index, probes, reached))
        width *= 2
    cost, _, index, probes, reached = min(choices, key=lambda x: x[:2])
    asked = [index.visits(index.slots(x[None], as_queries=True)[0], probes)[0] for x in q[:: max(1, len(q) // 16)]]
    there, visited = np.floor(index.slots(shown)[0]).astype(np.int64), []
    for few in range(index.directions.shape[2] + 1):  # leading functions with which queries go to the fewest blocks
        names, held = np.unique(_mixed(there[:, :few], 0), return_counts=True)
        blocks = dict(zip(names.tolist(), np.ceil(held * (n / max(1, len(shown))) / BLOCK_ROWS), strict=True))
        visited.append(sum(blocks.get(r, 0) for x in asked for r in np.unique(_mixed(x[:, :few], 0)).tolist()))
    leading = int(np.argmin(visited))
    return Index(index.longest, index.distance, index.width, index.directions, index.shift, leading, probes, reached)


def _regions(rows: DataFrame, indexes, k: int, whole: bool) -> DataFrame:
    """Every row of every table: d and region, and if whole also bucket, id and v."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for d, at, v in _by_length(batch):
                index = indexes.value.get(d)
                if index is None:
                    continue
                if len(at) > k + 1:  # of equal vectors the smallest ids are enough
                    order = np.argsort(ids[at], kind="stable")
                    _, same = np.unique(v[order], axis=0, return_inverse=True)
                    by = np.argsort(same.ravel(), kind="stable")
                    start = np.flatnonzero(np.diff(same.ravel()[by], prepend=-1))
                    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
                    keep = np.sort(order[by[nth <= k]])
                    at, v = at[keep], v[keep]
                for t, slots in enumerate(index.slots(v)):
                    region, bucket = index.names(np.floor(slots).astype(np.int64), t)
                    taken = pa.array(at)
                    columns = [batch.column("d").take(taken), pa.array(region)]
                    if whole:
                        columns += [pa.array(bucket), batch.column("id").take(taken), batch.column("v").take(taken)]
                    yield pa.RecordBatch.from_arrays(columns, ["d", "region", "bucket", "id", "v"][: len(columns)])

    return rows.mapInArrow(run, "d int, region long" + (f", bucket long, id long, v {kind}" if whole else ""))


def _probes(queries: DataFrame, indexes) -> DataFrame:
    """d, region, id, v and buckets: where each query goes, and what it visits there."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for d, at, v in _by_length(batch):
                index = indexes.value.get(d)
                if index is None:
                    continue
                for i in range(0, len(at), QUERY_ROWS):
                    mine = at[i : i + QUERY_ROWS]
                    for t, slots in enumerate(index.slots(v[i : i + QUERY_ROWS], as_queries=True)):
                        region, bucket = index.names(index.visits(slots, index.probes), t)
                        who = np.repeat(np.arange(len(mine)), region.shape[1])
                        order = np.lexsort((region.ravel(), who))
                        who, region, bucket = who[order], region.ravel()[order], bucket.ravel()[order]
                        start = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(region, prepend=region[0]) != 0))
                        taken = pa.array(mine[who[start]])
                        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(who)), pa.int32()), pa.array(bucket))
                        yield pa.RecordBatch.from_arrays([batch.column("d").take(taken), pa.array(region[start]), batch.column("id").take(taken), batch.column("v").take(taken), lists], ["d", "region", "id", "v", "buckets"])

    return queries.mapInArrow(run, f"d int, region long, id long, v {kind}, buckets array<long>")


def _compared(both: DataFrame, k: int) -> DataFrame:
    """Streams of (d, region, block, is_query, id, v, buckets): a block's rows, then the queries that go there."""

    def run(batches):
        place, held, waiting = None, [], []

        def answered() -> list[tuple[int, int, float]]:
            out = []
            if held and waiting:
                names = np.array([b for _, _, b in held])
                order = np.argsort(names, kind="stable")
                rows, ids, names = np.array([held[i][1] for i in order], float), np.array([held[i][0] for i in order]), names[order]
                start = np.flatnonzero(np.diff(names, prepend=names[0] ^ 1))
                there, length = names[start], np.diff(np.append(start, len(names)))
                for i in range(0, len(waiting), QUERY_ROWS):
                    part = waiting[i : i + QUERY_ROWS]
                    member = np.array([np.isin(there, b) for _, _, b in part])
                    some = np.flatnonzero(member.any(0))
                    if not len(some):
                        continue
                    at = np.concatenate([np.arange(start[s], start[s] + length[s]) for s in some])
                    q, query_ids = np.array([x for _, x, _ in part], float), np.array([x for x, _, _ in part])
                    scores = np.where(np.repeat(member[:, some], length[some], axis=1), q @ rows[at].T, -np.inf)
                    out += _best(scores, rows[at], ids[at], q, query_ids, k)
            waiting.clear()
            return out

        for batch in batches:
            for d, region, block, is_query, name, v, buckets in zip(*(c.to_numpy(zero_copy_only=False) if c.type != pa.bool_() else c.to_pylist() for c in batch.columns), strict=True):
                if (d, region, block) != place:
                    yield _found(answered())
                    place = (d, region, block)
                    held.clear()
                if is_query:
                    waiting.append((name, v, buckets))
                    if len(waiting) == 8 * QUERY_ROWS:
                        yield _found(answered())
                else:
                    held.append((name, v, buckets[0]))
        yield _found(answered())

    return both.mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = 2, recall: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found for each row that is_query holds of, among all other rows."""
    rows = usable(vectors, key, vector)
    queries = usable(vectors.where(is_query), key, vector)
    fitted = fit(rows, queries, k, tables, recall)
    if not fitted:
        return rows.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    indexes = rows.sparkSession.sparkContext.broadcast(fitted)  # a few numbers a component and function
    old: list[str] = []
    sizes = _regions(rows, indexes, k, whole=False).groupBy("d", "region").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = materialise(sizes, "neighbours-regions", old)  # a table of known size, so Spark joins it as fits
    block = F.pmod(F.xxhash64("id", "v"), F.coalesce("blocks", F.lit(1))).cast("int")
    held = _regions(rows, indexes, k, whole=True).join(sizes.where("blocks > 1"), ["d", "region"], "left").select("d", "region", block.alias("block"), F.lit(False).alias("is_query"), "id", "v", F.array("bucket").alias("buckets"))
    sent = _probes(queries, indexes).join(sizes, ["d", "region"]).select("d", "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"), "id", "v", "buckets")
    both = held.unionByName(sent).repartition("d", "region", "block").sortWithinPartitions("d", "region", "block", "is_query")
    best = materialise(top(_compared(both, k), k), "neighbours-found", old)
    have = {r.d: r.n for r in rows.groupBy("d").agg(F.count_distinct("id").alias("n")).collect()}  # one row a length
    needed = F.least(F.lit(k), F.create_map(*[F.lit(x) for pair in have.items() for x in pair])[F.col("d")] - 1)
    counted = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    short = queries.join(counted, queries["id"] == counted["query_id"], "left").where(F.coalesce("met", F.lit(0)) < needed).select("id", "v", "d")
    rest = exact(rows, short, k)
    if rest is not None:
        again = materialise(top(best.drop("rank").unionByName(rest), k), "neighbours-all", [])
        discard(rows.sparkSession, old)
        return again
    discard(rows.sparkSession, old[:1])
    return best
