"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items build one automaton. A document's words stream through it; after each
word the automaton knows the longest suffix of what was read that occurs in an item. Where that is at
least `window` words, the last `window` words are a window of some item; an item shorter than the
window counts only as a whole. Which items own a window is stored at the states of that length, so a
hit costs one look-up. Documents are matched whole, chunk by chunk of a batch.

Items of up to `block_chars` characters in all make one automaton, which every worker builds once:
one pass over the documents, without a shuffle. More items are dealt to blocks of about that size by a
hash (an item that is larger makes its block larger). Then one pass over the documents keeps those
with enough neighbouring words that are neighbours in some item (a bit array, 16 MB at most, which all
items fill in Spark tasks), and only their distinct texts meet the blocks, one block after the other,
so that no more than one block is ever broadcast or in the driver. A text's hits in all blocks are
united by two 64-bit hashes of the text.

Words are runs of digits, letters a-z after lower-casing A-Z, and everything beyond ASCII. Null and
empty texts, and texts without a word, have no words and are never hit; as items they hit nothing. A
null item_id counts as an empty string. Repeated items count once, repeated documents each time. Items
that tie are all owners. Further columns are ignored by contamination() and kept by decontaminate(),
whatever their names. A text of many MB takes about 100 bytes a word in one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import in_blocks, merged, word_hashes
from .shared import arrow_schema, materialise, shared_dir, text_chunks

WINDOW = 10
#: Characters of items in one automaton; about a fifth as many words.
BLOCK_CHARS = 1_000_000
WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NEVER = 1 << 60
PAIR_BITS = 1 << 22


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class ItemAutomaton:
    """Suffix automaton of many word sequences."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for name, text in items]
        for _, sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: the state of the last `window` words, for states that are at least so long
        self.at_window = [-1] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[self.link[v]] < window else self.at_window[self.link[v]]
        self.owners: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in sequences:
            v = 0
            for n, symbol in enumerate(sequence, 1):
                v = self.next[v][symbol]
                if n >= window:
                    self.owners.setdefault(self.at_window[v], set()).add(name)
            if 0 < len(sequence) < window:
                own.setdefault(v, []).append((len(sequence), name))
        #: short items that end where a state ends, its own and its suffixes'
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.link]
        #: matched length from which a state means a hit
        self.least = [NEVER] * len(self.link)
        for v in order:
            self.short[v] = own.get(v, []) + self.short[self.link[v]] if v in own else self.short[self.link[v]]
            self.least[v] = min([NEVER, *(n for n, _ in self.short[v]), *([window] if self.length[v] >= window else [])])
        self.shortest = min([NEVER, *(min(len(s), window) for _, s in sequences if s)])
        #: hashed neighbours in items: a quick test for which words the automaton need not read
        self.pairs = np.zeros(PAIR_BITS, bool)
        for _, sequence in sequences:
            self.pairs[self._pair_slots(np.array(sequence, np.int64))] = True

    @staticmethod
    def _pair_slots(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 0x9E3779B1 + ids[1:]) % PAIR_BITS

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the words that may hold a window: known words whose neighbours all occur in items."""
        known = ids >= 0
        if np.count_nonzero(known) < self.shortest:
            return []
        if self.shortest == 1:
            edge, more = np.diff(known.view(np.int8), prepend=0, append=0), 0
        else:
            near = self.pairs[self._pair_slots(ids)] & known[:-1] & known[1:]
            if np.count_nonzero(near) < self.shortest - 1:
                return []
            edge, more = np.diff(near.view(np.int8), prepend=0, append=0), 1
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + more
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def _extend(self, last: int, symbol: int) -> int:
        next_, link, length = self.next, self.link, self.length
        if symbol in next_[last]:
            q = next_[last][symbol]
            return q if length[q] == length[last] + 1 else self._split(last, symbol, q)
        v = len(link)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and symbol not in next_[p]:
            next_[p][symbol] = v
            p = link[p]
        if p != -1:
            q = next_[p][symbol]
            link[v] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
        return v

    def _split(self, p: int, symbol: int, q: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in a window's occurrence (None: none), and the items that own such windows."""
        get, n = self.vocabulary.get, len(words)
        ids = np.fromiter(map(get, words, [-1] * n), np.int64, n)
        hit: np.ndarray | None = None
        items: set[str] = set()
        next_, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        for start, end in self._runs(ids):
            state = matched = 0
            seen: set[int] = set()
            for at, symbol in enumerate(ids[start:end].tolist(), start + 1):
                to = next_[state].get(symbol)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = next_[state].get(symbol)
                if to is None:
                    continue
                state = to
                matched += 1
                if matched >= least[state]:
                    if hit is None:
                        hit = np.zeros(n, bool)
                    longest = 0
                    if matched >= window:
                        longest = window
                        if self.at_window[state] not in seen:
                            seen.add(self.at_window[state])
                            items |= self.owners[self.at_window[state]]
                    for size, name in self.short[state]:
                        if size <= matched:
                            longest = max(longest, size)
                            items.add(name)
                    hit[at - longest : at] = True
        return hit, items


_ready: dict[tuple, ItemAutomaton] = {}


def _automaton(shared, name: str, window: int) -> ItemAutomaton:
    """A block's automaton; a worker remembers the last one."""
    if (name, window) not in _ready:
        _ready.clear()
        _ready[name, window] = ItemAutomaton(shared.value, window)
    return _ready[name, window]


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's begin."""
    raws = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    starts, h = word_hashes(b" ".join(raws) + b" ")
    return h, np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))


class Items:
    """Test items in blocks of bounded size."""

    def __init__(self, items: DataFrame, key: str, text: str, window: int, block_chars: int):
        own = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where("length(text) > 0").distinct()
        self.window, self.spark = window, items.sparkSession
        self.blocks = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
        self.items = own if self.blocks == 1 else materialise(own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks))), "decontaminate-items")

    def matcher(self, block: int = 0) -> tuple[Callable, object]:
        """match(texts) for tasks: words, hit words (None: none) and items of each text, for one block; and its broadcast."""
        rows = self.items if self.blocks == 1 else self.items.where(F.col("block") == block)
        shared = self.spark.sparkContext.broadcast([(r.item, r.text) for r in rows.collect()])  # about block_chars
        name, window = uuid.uuid4().hex, self.window

        def match(texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray | None, set[str]]]:
            automaton = _automaton(shared, name, window)
            for text in texts:
                words = words_of(text)
                yield (words, *automaton.match(words))

        return match, shared

    def neighbours(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        """For tasks: how many words each text has, and whether it may hold a window of any item."""
        window = self.window
        words = int(self.items.agg(F.sum(F.length("text"))).first()[0]) // 2 + 1
        bits = min(max((8 * words).bit_length(), 16), 27)

        def slots(h: np.ndarray) -> np.ndarray:
            return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - bits)).astype(np.int64)

        def fill(batches):
            array, shortest = np.zeros(1 << bits, bool), window
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    h = hashes([text])[0]
                    if len(h):
                        shortest = min(shortest, len(h))
                        array[slots(h)] = True
            yield in_blocks(np.packbits(array))
            yield pa.RecordBatch.from_arrays([pa.array([-shortest], pa.int32()), pa.array([b""], pa.binary())], ["block", "data"])

        filled = materialise(self.items.select("text").coalesce(32).mapInArrow(fill, "block int, data binary"), "decontaminate-neighbours")
        shortest = -filled.where("block < 0").agg(F.max("block")).first()[0]
        shared = self.spark.sparkContext.broadcast(merged(filled.where("block >= 0"), 1 << bits - 3, "u1", np.bitwise_or))

        def likely(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            h, bounds = hashes(texts)
            n = np.diff(bounds)
            if shortest == 1:
                return n, n > 0
            if len(h) < shortest:
                return n, np.zeros(len(n), bool)
            at, run = slots(h), shortest - 1
            near = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.int64)
            ends = bounds[1:-1] - 1
            near[ends[(ends >= 0) & (ends < len(near))]] = 0  # neighbours of different texts
            sums = np.concatenate([[0], np.cumsum(near)])
            whole = np.concatenate([[0], np.cumsum(sums[run:] - sums[:-run] == run)])
            last = np.clip(bounds[1:] - run, 0, len(whole) - 1)
            return n, whole[np.maximum(last, np.minimum(bounds[:-1], len(whole) - 1))] > whole[np.minimum(bounds[:-1], len(whole) - 1)]

        return likely

    def hits(self, texts: DataFrame) -> DataFrame:
        """at1, at2, runs (of hit words, united), items (sorted) of the texts (at1, at2, text) that hold windows, over all blocks."""
        path = shared_dir(self.spark, "decontaminate-hits")
        schema = "at1 bigint, at2 bigint, runs array<struct<start:int,end:int>>, items array<string>"
        _, arrow = arrow_schema(schema)
        for block in range(self.blocks):
            match, shared = self.matcher(block)

            def run(batches, match=match):
                for batch, own in text_chunks(batches):
                    rows = []
                    for at1, at2, (_, hit, items) in zip(batch.column("at1").to_pylist(), batch.column("at2").to_pylist(), match(own), strict=True):
                        if hit is not None:
                            rows.append((at1, at2, [{"start": a, "end": b} for a, b in spans(hit)], sorted(items)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], arrow.names)

            texts.mapInArrow(run, schema).write.mode("append").parquet(path)
            shared.destroy()
        found = self.spark.read.schema(schema).parquet(path).groupBy("at1", "at2").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        start = F.array().cast("array<struct<start:int,end:int>>")
        last = lambda done: F.element_at(done, -1)
        united = F.aggregate("runs", start, lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))))
        return materialise(found.select("at1", "at2", united.alias("runs"), "items"), "decontaminate-united")


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _places(text: str) -> list:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("at1"), F.xxhash64(F.lit(1), text).alias("at2")]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated: one row per document."""
    held = Items(items, item_key, item_text, window, block_chars)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    if held.blocks > 1:
        likely = held.neighbours()

        def first(batches):
            for batch, texts in text_chunks(batches):
                n, maybe = likely(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at1", "at2")), pa.array(n, pa.int64()), pa.array([t if m else None for t, m in zip(texts, maybe.tolist(), strict=True)], pa.string())], ["key", "at1", "at2", "n_words", "text"])

        base = materialise(own.select("key", *_places("text"), "text").mapInArrow(first, f"key {kind}, at1 bigint, at2 bigint, n_words bigint, text string"), "decontaminate-likely")
        hits = held.hits(base.where("text IS NOT NULL").select("at1", "at2", "text").dropDuplicates(["at1", "at2"]))
        rows = base.drop("text").join(hits, ["at1", "at2"], "left")
        covered = F.aggregate("runs", F.lit(0), lambda n, x: n + x["end"] - x["start"])
        found = F.coalesce("items", F.array().cast("array<string>"))
        return rows.select(F.col("key").alias(key), "n_words", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), found.alias("items"), F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(covered > 0, F.lit(False)).alias("contaminated"))
    match, _ = held.matcher()
    out, arrow = arrow_schema("n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean")
    schema = docs.select(key).schema
    for field in out:
        schema = schema.add(field)

    def run(batches):
        for batch, texts in text_chunks(batches):
            rows = [(len(w), 0 if h is None else int(h.sum()), sorted(i)) for w, h, i in match(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, pa.int64()) for c in ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows])), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows]), pa.array([r[1] > 0 for r in rows])],
                [key, *arrow.names],
            )

    return own.mapInArrow(run, schema)


def without_spans(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without some runs of its words; what stood around a run is joined by one space."""
    raw = text.encode("utf-8", "surrogatepass")
    at = np.array([m.span() for m in WORD.finditer(raw)])
    kept, end = [], 0
    for a, b in runs:
        kept.append(raw[end : at[a][0]].rstrip())
        end = at[b - 1][1]
    kept.append(raw[end:].lstrip())
    return b" ".join(k for k in kept if k).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the spans that items own; documents covered beyond max_coverage of their words go.

    Documents that aren't hit stay as they are, null texts included.
    """
    held = Items(items, item_key, item_text, window, block_chars)
    if held.blocks > 1:
        return _cleaned(docs, held, text, max_coverage)
    match, _ = held.matcher()

    def run(batches):
        for batch, texts in text_chunks(batches, text):
            column, keep = batch.column(text).to_pylist(), np.ones(len(texts), bool)
            for i, (words, hit, _) in enumerate(match(texts)):
                if hit is not None:
                    keep[i] = hit.sum() <= max_coverage * len(words)
                    while keep[i] and hit is not None:  # what a removal joins may be a window again
                        column[i] = without_spans(column[i], spans(hit))
                        [(_, hit, _)] = match([column[i]])
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _cleaned(docs: DataFrame, held: Items, text: str, max_coverage: float) -> DataFrame:
    """decontaminate() with several blocks: the texts that are hit are cleaned in rounds and put in place of their originals."""
    likely = held.neighbours()

    def first(batches):
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array(likely(texts)[1]))

    def clean(batches):
        for batch in batches:
            out = []
            for own, runs, whole in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                gone = whole and sum(r["end"] - r["start"] for r in runs) > max_coverage * len(words_of(own))
                out.append(None if gone else without_spans(own, [(r["start"], r["end"]) for r in runs]))
            yield pa.RecordBatch.from_arrays([batch.column("at1"), batch.column("at2"), pa.array(out, pa.string())], ["at1", "at2", "text"])

    state = docs.select(*_places(text), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(first, "at1 bigint, at2 bigint, text string").dropDuplicates(["at1", "at2"])
    state, done, whole = materialise(state, "decontaminate-likely"), [], True
    while True:  # what a removal joins may be a window again
        hits = held.hits(state.where("text IS NOT NULL"))
        if hits.isEmpty():
            break
        rows = state.join(hits, ["at1", "at2"]).select("at1", "at2", "text", "runs", F.lit(whole).alias("whole"))
        state, whole = materialise(rows.mapInArrow(clean, "at1 bigint, at2 bigint, text string"), "decontaminate-cleaned"), False
        done.append(state.withColumn("round", F.lit(len(done))))
    if not done:
        return docs
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    last = materialise(every.groupBy("at1", "at2").agg(F.max_by(F.struct("text"), "round").alias("s")).select(F.col("at1").alias("_clean_at1"), F.col("at2").alias("_clean_at2"), F.col("s.text").alias("_clean_text"), F.lit(True).alias("_clean")), "decontaminate-texts")
    at1, at2 = _places(text)
    rows = docs.withColumns({"_at1": at1, "_at2": at2}).join(last, (F.col("_at1") == F.col("_clean_at1")) & (F.col("_at2") == F.col("_clean_at2")) & F.col(text).isNotNull(), "left")
    kept = rows.where("_clean IS NULL OR _clean_text IS NOT NULL")
    return kept.withColumn(text, F.when(F.col("_clean"), F.col("_clean_text")).otherwise(F.col(text))).select(*docs.columns)
