"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regular expression. Each code point gets a class, each class is a
transition function of a small automaton, and the automaton's state before every character comes
from an associative scan: all compositions of the class functions form a finite monoid whose
multiplication table is one array, so a block of text is scanned with table look-ups, blocks in
parallel, and the blocks' totals are joined afterwards. Token boundaries follow from (state, class).

The pieces between boundaries go through a bounded cache of merged pieces. Pieces that the cache
lacks are merged together: every step looks up all neighbouring pairs of all pieces in one hash
table and merges the leftmost lowest-ranked pair of each piece.

Null text counts as empty and gives no ids. Rows are handled one by one, so repeated rows repeat in
the result, empty tables give empty results, and further input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, text_chunks

# Classes of code points, as the automaton sees them.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, SPACE, MORE, RESET = range(9)
CLASSES = 9
# States: in letters, in numbers, in other characters, after a space that belongs to the next
# piece, at a boundary, inside a contraction with one or two characters to come.
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_GLUE, FREE, ONE_LEFT, TWO_LEFT = range(7)
STATES = 7
#: White space of the split pattern (Unicode White_Space), fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that one worker remembers; the cache starts anew beyond that.
CACHE_PIECES = 250_000
#: Bytes from which a piece is merged with a heap instead of in the common steps.
LONG_PIECE = 64
NO_RANK = np.int64(1) << 40


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if kind == LETTER:
        if state == ONE_LEFT:
            return FREE, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_GLUE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_GLUE)
    if kind == OTHER or kind in (SHORT, LONG) and state in (IN_OTHER, AFTER_GLUE):
        return IN_OTHER, state not in (IN_OTHER, AFTER_GLUE)
    if kind in (SHORT, LONG):
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    return (AFTER_GLUE if kind == GLUE else FREE), kind != MORE


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(class -> element, element x state -> state, product table scaled for look-up, state x class -> start, products)."""
    functions = [tuple(step(s, k)[0] for s in range(STATES)) for k in range(CLASSES)]
    elements = list(dict.fromkeys(functions))
    for a in elements:  # grows while it is walked
        for b in functions:
            c = tuple(b[s] for s in a)
            if c not in elements:
                elements.append(c)
    number = {e: i for i, e in enumerate(elements)}
    product = [[number[tuple(b[s] for s in a)] for b in elements] for a in elements]
    return (
        np.array([number[f] for f in functions], np.uint16),
        np.array(elements, np.uint8).ravel(),
        (np.array(product) * len(elements)).astype(np.uint16).ravel(),
        np.array([step(s, k)[1] for s in range(STATES) for k in range(CLASSES)], bool),
        product,
    )


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each position, by a blocked scan over the transition monoid."""
    element, apply, product, _, products = automaton()
    size, n = len(products), len(kinds)
    rows = max(1, int(n**0.5))
    columns = -(-n // rows)
    laid = np.full(rows * columns, element[RESET], np.uint16)
    laid[:n] = element[kinds]
    laid = np.ascontiguousarray(laid.reshape(columns, rows).T)  # one block to a column
    scan = np.empty((rows, columns), np.uint16)  # element * size
    scan[0] = laid[0] * np.uint16(size)
    for i in range(1, rows):
        np.take(product, scan[i - 1] + laid[i], out=scan[i], mode="clip")
    entry, whole = [], None
    for total in (scan[-1] // size).tolist():
        entry.append(FREE if whole is None else int(apply[whole * STATES + FREE]))
        whole = total if whole is None else products[whole][total]
    after = apply[(scan // np.uint16(size)) * np.uint16(STATES) + np.array(entry, np.uint16)]
    before = np.empty(n, np.uint8)
    before[0] = FREE
    before[1:] = after.T.ravel()[: n - 1]
    return before


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined (one separator after each), piece starts in it, and each text's first piece.

    The starts also hold every separator, so that start[i + 1] ends piece i.
    """
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = code_point_classes()[codes]
    kinds[ends] = RESET
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        wide = np.concatenate([codes, np.zeros(2, np.uint32)])
        one, two = wide[marks + 1], wide[marks + 2]
        mark = kinds[marks]
        mark[np.isin(one, [ord(c) for c in "stmd"])] = SHORT
        mark[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = LONG
        kinds[marks] = mark
    white = kinds == SPACE
    at = np.flatnonzero(white)
    if len(at):
        first = np.ones(len(at), bool)
        first[at > 0] = ~white[at[at > 0] - 1]
        last = ~white[at + 1] & (kinds[at + 1] != RESET)
        kinds[at] = np.where(last & (codes[at] == 32), GLUE, np.where(first | last, SPACE, MORE))
    starts = np.flatnonzero(automaton()[3][states_before(kinds) * np.uint8(CLASSES) + kinds])
    # a reset counts as a start, so starts holds every separator
    return joined, starts, np.concatenate([[0], np.searchsorted(starts, ends) + 1])


class Vocabulary:
    """Ranks, the table of mergeable pairs, and the cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.mask = (1 << max(12, int(len(keys) * 4).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NO_RANK, np.int64)
        slot = self.slots(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing; one key of those that meet takes the slot
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & self.mask
        self.cache: dict[str, bytes] = {}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """One long piece, with a heap over a linked list."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(ids) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            r, i, both = heapq.heappop(heap)
            j = after[i] if alive[i] else len(ids)
            if j >= len(ids) or parts[i] + parts[j] != both:
                continue
            parts[i], ids[i], alive[j], after[i] = both, r, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(ids) and (n := self.ranks.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (n, a, parts[a] + parts[after[a]]))
        return [x for x, here in zip(ids, alive, strict=True) if here]

    def learn(self, pieces: list[str]) -> None:
        """Merge pieces that the cache lacks and put them in."""
        common: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.cache[piece] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                common.append((piece, raw))
        for at in range(0, len(common), 20_000):
            self.merge_many(common[at : at + 20_000])

    def merge_many(self, some: list[tuple[str, bytes]]) -> None:
        symbols = self.of_byte[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)]
        word = np.repeat(np.arange(len(some)), [len(raw) for _, raw in some])
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            rank = np.full(len(symbols), NO_RANK, np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self.pair_ranks(symbols[same], symbols[same + 1])
            low = np.minimum.reduceat(rank << 21 | np.arange(len(symbols)), first)  # at most 20,000 pieces of 64 bytes
            best, at = low >> 21, low & (1 << 21) - 1
            done = best >= NO_RANK
            if done.any():
                counts = np.diff(np.append(first, len(symbols)))
                over = np.repeat(done, counts)
                ids = symbols[over].astype("<u4").tobytes()
                end = 0
                for w, c in zip(word[first[done]].tolist(), counts[done].tolist(), strict=True):
                    self.cache[some[w][0]] = ids[end : (end := end + 4 * c)]
            else:
                over = np.zeros(len(symbols), bool)
            symbols[at[~done]] = best[~done]
            over[at[~done] + 1] = True
            symbols, word = symbols[~over], word[~over]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text: ids as little-endian 32-bit integers, piece starts (code points), ids of each piece."""
        joined, starts, first = boundaries(texts)
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + ["\0"]
        cache = self.cache
        new = set(pieces).difference(cache)
        if new:
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
                new = set(pieces)
            self.learn(list(new))
        base = 0
        for k, text in enumerate(texts):
            own = pieces[first[k] : first[k + 1] - 1]  # without the separator
            parts = [cache[p] for p in own]
            yield b"".join(parts), starts[first[k] : first[k + 1] - 1] - base, parts
            base += len(text) + 1

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker, from a rank file (base64 token, space, rank) installed on every machine."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, offsets array<int>: the code point at which each id's piece starts.

    Ids of one piece share its offset. Null text gives two empty arrays.
    """
    out, arrow = arrow_schema("ids array<int>, offsets array<int>")
    schema = docs.select(key).schema.add(out[0]).add(out[1])

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch, texts in text_chunks(batches):
            ids, offsets = [], []
            for raw, starts, parts in vocab.encode(texts):
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                offsets.append(np.repeat(starts, [len(p) // 4 for p in parts]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], [key, "ids", "offsets"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes: the bytes that the ids stand for. Null ids count as none."""
    schema = encoded.select(key).schema.add("bytes", "binary")

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch in batches:
            raw = [b"".join(vocab.tokens[i] for i in row or ()) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(raw, pa.binary())], [key, "bytes"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes they decode to.

    The digests are taken beside the encoder so that ids needn't leave the worker.
    """
    out, _ = arrow_schema("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    schema = docs.select(key).schema
    for field in out:
        schema = schema.add(field)

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch, texts in text_chunks(batches):
            n, ids, back = [], [], []
            for raw, _, _ in vocab.encode(texts):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(vocab.decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
