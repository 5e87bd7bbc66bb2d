"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are the distinct words of a text and their beginnings, hashed. fit() joins a bounded sample
of labelled rows (about `most_docs`, chosen by a 64-bit hash of the key, at any size of the table) with
their texts. Spark counts the features of all of them; those that separate the classes with a z-score of `least_z` or more,
in three texts or more, get weights, however many (features are 2**BITS at most), and so do all group
names and what else an insertion of one brings, whether labels go with them or not. Every sampled text that names a group is
paired with copies in which the name is swapped for each other one of its kind and language, and every text with a copy into
which one name is inserted; the fit penalises the squared change of the logit between the two, so that a neutral
mention of a group doesn't raise a score even where labels happen to go with it. A mention's pairs
weigh one together, as does an insertion; Model.pairs and Model.insertions tell how many fit() used. Weights are found by
limited-memory quasi-Newton steps over sparse rows. predict() sums weights per text.

Null and empty texts have no features and get the base score. Where a key has several labels the
highest counts, where it has several texts one of them; null keys and labels are never learned from.
Without any labels the base score is low. Repeated rows get
equal scores; further columns are ignored. A text takes a few times its size in a task; the driver holds the chosen features
of the sample.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, sample_bound, text_chunks

#: Names of groups by kind and language (those of the corpus); any may stand for another of its kind. Fixed values.
IDENTITY = [
    "women men girls boys mothers fathers wives husbands".split(),
    "woman man girl boy mother father wife husband".split(),
    "female male transgender nonbinary".split(),
    "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "muslim christian jewish hindu buddhist sikh catholic protestant atheist".split(),
    "muslims christians jews hindus buddhists sikhs catholics protestants atheists".split(),
    "black white asian african european american latino hispanic arab indian chinese mexican".split(),
    "immigrants refugees citizens natives foreigners migrants".split(),
    "disabled blind deaf autistic elderly young old".split(),
    "frauen männer mädchen jungen mütter väter ehefrauen ehemänner".split(),
    "frau mann mädchen junge mutter vater ehefrau ehemann".split(),
    "weiblich männlich transgeschlechtlich nichtbinär".split(),
    "schwul lesbisch heterosexuell bisexuell queer homosexuell".split(),
    "muslimisch christlich jüdisch hinduistisch buddhistisch katholisch evangelisch atheistisch".split(),
    "muslime christen juden hindus buddhisten sikhs katholiken protestanten atheisten".split(),
    "schwarze weiße asiaten afrikaner europäer amerikaner araber inder chinesen mexikaner türken".split(),
    "einwanderer flüchtlinge bürger einheimische ausländer migranten".split(),
    "behinderte blinde gehörlose autisten senioren junge alte".split(),
    "femmes hommes filles garçons mères pères épouses maris".split(),
    "femme homme fille garçon mère père épouse mari".split(),
    "féminin masculin transgenre".split(),
    "gay lesbienne hétérosexuel bisexuel queer homosexuel".split(),
    "musulman chrétien juif hindou bouddhiste sikh catholique protestant athée".split(),
    "musulmans chrétiens juifs hindous bouddhistes sikhs catholiques protestants athées".split(),
    "noirs blancs asiatiques africains européens américains latinos arabes indiens chinois mexicains".split(),
    "immigrés réfugiés citoyens étrangers migrants".split(),
    "handicapés aveugles sourds autistes âgés jeunes vieux".split(),
    "mujeres hombres niñas niños madres padres esposas maridos".split(),
    "mujer hombre niña niño madre padre esposa marido".split(),
    "femenino masculino transgénero".split(),
    "gay lesbiana heterosexual bisexual queer homosexual".split(),
    "musulmán cristiano judío hindú budista sij católico protestante ateo".split(),
    "musulmanes cristianos judíos hindúes budistas sijs católicos protestantes ateos".split(),
    "negros blancos asiáticos africanos europeos americanos latinos árabes indios chinos mexicanos".split(),
    "inmigrantes refugiados ciudadanos nativos extranjeros migrantes".split(),
    "discapacitados ciegos sordos autistas ancianos jóvenes viejos".split(),
]
BITS = 20
STEM = 5
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    pairs: int = 0  # swapped copies that fit() found
    insertions: int = 0  # copies with an inserted name


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split())


def bucket(word: bytes, salt: int = 0) -> int:
    return zlib.crc32(word, salt) & (1 << BITS) - 1


def features(words: set[bytes]) -> np.ndarray:
    """Distinct hashed features: each word, and the first bytes of longer ones."""
    stems = {w[:STEM] for w in words if len(w) > STEM}
    return np.unique(np.fromiter(chain(map(bucket, words), (bucket(s, 1) for s in stems)), np.int64))


def swaps(words: set[bytes], identity: Sequence[Sequence[str]] = IDENTITY) -> list[tuple[set[bytes], float]]:
    """Counterfactual copies with weights: every group name swapped for each other one of its kind, one at a time."""
    out = []
    for kind in identity:
        names = [n.encode() for n in kind]
        for name in words.intersection(names):
            out += [(words - {name} | {other}, 1 / (len(names) - 1)) for other in names if other != name]
    return out


def insertion(words: set[bytes], identity: Sequence[Sequence[str]] = IDENTITY) -> list[tuple[set[bytes], float]]:
    """A counterfactual copy with one group name more, chosen by the words themselves."""
    names = sorted({n.encode() for kind in identity for n in kind} - words)
    return [(words | {names[zlib.crc32(b" ".join(sorted(words))) % len(names)]}, 1.0)] if names and words else []


def flat(lists: Sequence[Sequence[int]], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every listed feature among the chosen, and the number of the list it is in."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.searchsorted(chosen, np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)), np.repeat(np.arange(len(sizes)), sizes)


def solve(rows: list[np.ndarray], labels: np.ndarray, changes: dict[tuple[tuple[int, ...], tuple[int, ...]], float], chosen: np.ndarray, ridge: float, fairness: float) -> Model:
    """Weights of the chosen features (sorted): the least of the log loss, ridge / 2 times the squared weights, and
    fairness / 2 times the weighted squared changes of the logit. rows and changes hold chosen features only."""
    n, k = len(rows), len(chosen)
    positive = float(labels.sum())
    base = np.log((positive + 0.5) / (n - positive + 4.5))
    if not n or positive in (0, n):
        return Model(float(base), np.zeros(0, np.int64), np.zeros(0))
    at, of = flat(rows, chosen)
    (gone, gone_of), (came, came_of) = (flat([c[i] for c in changes], chosen) for i in (0, 1))
    weight = fairness * np.array(list(changes.values()))

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, w[at], minlength=n) + w[-1]
        moved = np.bincount(gone_of, w[gone], minlength=len(weight)) - np.bincount(came_of, w[came], minlength=len(weight))
        value = np.logaddexp(0, z).sum() - (z * labels).sum() + ridge / 2 * (w[:-1] @ w[:-1]) + (weight * moved) @ moved / 2
        rest, pull = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels, weight * moved
        gradient = np.append(np.bincount(at, rest[of], minlength=k) + np.bincount(gone, pull[gone_of], minlength=k) - np.bincount(came, pull[came_of], minlength=k) + ridge * w[:-1], rest.sum())
        return float(value), gradient

    start = np.zeros(k + 1)
    start[-1] = base
    w = least(objective, start)
    return Model(float(w[-1]), chosen, w[:-1])


def least(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 500, memory: int = 10, close: float = 1e-5) -> np.ndarray:
    """Where a convex function, given with its gradient, is least: limited-memory quasi-Newton steps with backtracking."""
    value, gradient = objective(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < close:
            break
        way, turns = -gradient, []
        for s, y, r in reversed(past):
            turns.append(r * (s @ way))
            way = way - turns[-1] * y
        if past:
            s, y, _ = past[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y, r), turn in zip(past, reversed(turns), strict=True):
            way = way + s * (turn - r * (y @ way))
        slope, size = gradient @ way, 1.0 if past else 1 / np.abs(gradient).sum()
        while (got := objective(w + size * way))[0] > value + 1e-4 * size * slope and size > 1e-12:
            size /= 2
        s, y = size * way, got[1] - gradient
        if s @ y > 1e-14:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        w, (value, gradient) = w + s, got
    return w


def separating(rows: DataFrame, least_z: float) -> np.ndarray:
    """The features, sorted, that go with label (boolean) or its absence, counted over all rows."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features(words_of(t)) for t in texts], pa.list_(pa.int64()))], ["label", "features"])

    each = rows.mapInArrow(run, "label boolean, features array<bigint>").select("label", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("label").cast("int")).alias("hits")).where("seen >= 3")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("int")).alias("rate")).first()
    if not total.n or total.rate in (0, 1):
        return np.zeros(0, np.int64)
    z = F.abs((F.col("hits") - F.col("seen") * total.rate) / F.sqrt(F.col("seen") * (total.rate * (1 - total.rate)) + 1e-9))
    best = counts.where(z >= least_z).select("feature").toArrow()  # 2**BITS rows at most
    return np.sort(best.column("feature").to_numpy())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, most_docs: int = 12_000, least_z: float = 4.0, ridge: float = 0.3, fairness: float = 10.0, identity: Sequence[Sequence[str]] = IDENTITY) -> Model:
    """Learn from about most_docs labelled rows; usable is a condition on the key; identity: group names by kind."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if usable is None else usable))
    bound = sample_bound(rows.count(), most_docs)
    rows = rows if bound is None else rows.where(F.xxhash64(F.col(key).cast("string")) < bound)
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label) > 0).alias("label"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(rows), "key")  # about most_docs rows
    sample = materialise(joined.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-sample").select("text", "label")
    chosen = separating(sample, least_z)
    if len(chosen):
        chosen = np.union1d(chosen, features({n.encode() for kind in identity for n in kind}))

    def run(batches):
        for batch, texts in text_chunks(batches):
            own, changes, pairs = [words_of(t) for t in texts], defaultdict(float), []
            rows = [features(w) for w in own]
            for w, before in zip(own, rows, strict=True):
                swapped, inserted = swaps(w, identity), insertion(w, identity)
                pairs.append((len(swapped), len(inserted)))
                for o, weight in swapped + inserted:  # what of the chosen a change takes away and what it brings
                    after = features(o)
                    gone, came = (np.intersect1d(np.setdiff1d(x, y), chosen) for x, y in ((before, after), (after, before)))
                    if len(gone) or len(came):
                        changes[tuple(gone.tolist()), tuple(came.tolist())] += weight
            # a batch's changes, equal ones summed, go with its first row
            first = [[{"gone": g, "came": c, "weight": w} for (g, c), w in changes.items()], *[[]] * (len(own) - 1)]
            kind = pa.list_(pa.struct([("gone", pa.list_(pa.int64())), ("came", pa.list_(pa.int64())), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([np.intersect1d(r, chosen) for r in rows], pa.list_(pa.int64())), *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)), pa.array(first, kind)], ["label", "features", "pairs", "insertions", "changes"])

    # about most_docs rows of chosen features
    got = sample.mapInArrow(run, "label boolean, features array<bigint>, pairs bigint, insertions bigint, changes array<struct<gone:array<bigint>,came:array<bigint>,weight:double>>").toArrow()
    own = [np.asarray(x.values if hasattr(x, "values") else x, np.int64) for x in got.column("features")] if got.num_rows else []
    changes: dict = defaultdict(float)
    for some in got.column("changes").to_pylist():
        for c in some:
            changes[tuple(c["gone"]), tuple(c["came"])] += c["weight"]
    model = solve(own, np.array(got.column("label").to_pylist(), float), changes, chosen, ridge, fairness)
    return replace(model, **{c: sum(got.column(c).to_pylist()) for c in ("pairs", "insertions")})


def score(model: Model, texts: list[str]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    if len(model.buckets):
        for i, text in enumerate(texts):
            own = features(words_of(text))
            at = np.searchsorted(model.buckets, own)
            at[at == len(model.buckets)] = 0
            out[i] += model.weights[at[model.buckets[at] == own]].sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, with toxicity, from 0 to 1 (a column of that name is replaced)."""
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(shared.value, texts))], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)
