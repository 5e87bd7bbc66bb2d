"""Quality rules on repetition, from suffix arrays.

The words of a batch of documents are laid end to end, each document with its own alphabet and a
closing symbol of its own, so one suffix array covers the batch and no match crosses documents. It is
built by prefix doubling on ranks: each round sorts only the suffixes whose ranks still tie. The
ranks of every round are kept, and the longest common prefix of neighbours in the suffix array
follows from them by descending through the rounds. The intervals of the prefix array are the repeated
substrings that can't be extended to the right; those before which different words stand are the
maximal ones. Their spans are united, by the longest that starts at each word, and a document is kept
unless too large a fraction of its words is covered or its longest repeat is too long.

Words are runs without white space (space, \\t, \\n, \\v, \\f, \\r). Null, empty and blank texts have no
words. Rows are judged one by one: repeated rows repeat, empty tables stay empty, further columns
are ignored. A chunk of texts, or one longer text, takes some 60 bytes a word in a task, and 4 more for
each doubling of its longest repeat.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, text_chunks

SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_WHITE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of symbols (integers from 0, the last one unique) and the LCP of each suffix with the one before it."""
    n = len(symbols)
    size = np.bincount(symbols)
    rank = (np.cumsum(size) - size)[symbols]  # of a group of ties: its first place
    width = size[symbols]
    rounds, active, k = [rank.astype(np.int32)], np.flatnonzero(width > 1), 1
    while len(active):
        after = rank[active + k]  # in range: a tie lasts k symbols, and the last symbol ties with none
        order = np.argsort(rank[active] * np.int64(n) + after, kind="stable")
        a, head, tail = active[order], rank[active[order]], after[order]
        new_group = np.ones(len(a), bool)
        new_group[1:] = head[1:] != head[:-1]
        start = np.flatnonzero(new_group)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        new = new_group.copy()
        new[1:] |= tail[1:] != tail[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(a)))
        rank = rank.copy()
        rank[a] = head + np.repeat(place[first], sizes)
        rounds.append(rank.astype(np.int32))
        active, k = a[np.repeat(sizes, sizes) > 1], 2 * k
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    x, y, at = order[:-1], order[1:], np.arange(1, n)
    tie = rounds[0][x] == rounds[0][y]
    x, y, at = x[tie], y[tie], at[tie]
    for level in range(len(rounds) - 1, -1, -1):
        # equal ranks of a round mean 2**level equal symbols, none of them a document's end
        same = rounds[level][np.minimum(x, n - 1)] == rounds[level][np.minimum(y, n - 1)]
        lcp[at[same]] += 1 << level
        x, y = x + (same << level), y + (same << level)
    return order, lcp


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (first, last, length) of the prefix array's intervals of at least `least` symbols with different symbols before their suffixes."""
    at = np.flatnonzero(lcp >= least)
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    found, stack, last = [], [], -2
    for k, n in zip([*at.tolist(), -2], [*lcp[at].tolist(), 0], strict=True):
        if k != last + 1:  # the run of neighbours that share so much has ended
            found += [(first, last, length) for length, first in stack]
            stack = []
        first = k - 1
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            found.append((first, k - 1, length))
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, first))
        last = k
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[changes[rows[:, 1]] > changes[rows[:, 0]]]


def repeats(words: list[list], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the documents, end to end: length of the longest substring starting there that its document has again.

    Also each document's first word (a closing word of length 0 follows each document), and a place of
    every maximal repeated substring of at least `least` words.
    """
    symbols, starts, base = [], [], 0
    for doc in words:
        ids: dict = defaultdict(count(base).__next__)
        symbols += map(ids.__getitem__, doc)
        base += len(ids)
        starts.append(len(symbols))
        symbols.append(base)
        base += 1
    symbols = np.array(symbols, np.int64)
    order, lcp = suffix_array(symbols)
    longest = np.empty(len(order), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest, np.array([0, *(x + 1 for x in starts)]), order[maximal_repeats(symbols, order, lcp, least)[:, 0]]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated substring of at least `least` words."""
    n = len(longest)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    change[at] += 1
    np.subtract.at(change, at + longest[at], 1)
    return np.cumsum(change[:-1]) > 0


def spans_of(longest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the repeats that are united: the longest at each word, unless a start one word earlier extends it."""
    earlier = np.concatenate([[0], longest[:-1]])
    at = np.flatnonzero((longest >= least) & (earlier != longest + 1))
    return at, longest[at]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = 10, max_covered: float = 0.45, max_repeat: int = 50, min_words: int = 50, spans: bool = False) -> DataFrame:
    """One row per document with counts, repetition measures and verdicts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 3-word windows that occur
    twice or more), base_failed, n_covered (words in repeats of at least min_repeat words),
    longest_repeat, n_maximal (distinct maximal repeated substrings of min_repeat words or more), kept. With spans=True also repeat_spans,
    an array of (start, length) in words.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal"]
    out, arrow = arrow_schema(", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean" + ", repeat_spans array<struct<start:int,length:int>>" * spans)
    schema = docs.select(key).schema
    for field in out:
        schema = schema.add(field)

    def run(batches):
        for batch, texts in text_chunks(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            words = [r.split() for r in raws]
            longest, starts, maximal = repeats(words, min_repeat)
            by_doc = lambda x: np.add.reduceat(x, starts[:-1], dtype=np.int64)
            in_windows = covered(np.where(longest >= 3, 3, 0), 3)
            at, lengths = spans_of(longest, min_repeat)
            owner = np.searchsorted(starts, at, "right") - 1
            got = {
                "n_words": np.diff(starts) - 1,
                "word_chars": np.array([len(r.translate(None, _WHITE + _CONTINUATION)) for r in raws]),
                "n_symbols": np.array([len(r.translate(None, _KEEP_SYMBOLS)) for r in raws]),
                "n_dup_lines": np.array([len(lines) - len(set(lines)) for lines in ([x for x in r.split(b"\n") if x.strip(_WHITE)] for r in raws)]),
                "n_repeat_words": by_doc(in_windows),
                "n_covered": by_doc(covered(longest, min_repeat)),
                "longest_repeat": np.maximum.reduceat(longest, starts[:-1]),
                "n_maximal": np.bincount(np.searchsorted(starts, maximal, "right") - 1, minlength=len(texts)),
            }
            failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            kept = ~failed & (got["n_covered"] <= max_covered * got["n_words"]) & (got["longest_repeat"] <= max_repeat)
            columns = [pa.array(got[n].astype(np.int64)) for n in names] + [pa.array(failed), pa.array(kept)]
            if spans:
                rows = [[] for _ in texts]
                for d, a, n in zip(owner.tolist(), at.tolist(), lengths.tolist(), strict=True):
                    rows[d].append({"start": a - int(starts[d]), "length": n})
                columns.append(pa.array(rows, arrow.field("repeat_spans").type))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], [key, *arrow.names])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
