"""N-gram Jaccard join with prefix trees: which documents are near copies of each other.

A document's set holds its distinct word shingles as 64-bit hashes; two documents link when the
Jaccard similarity of their sets reaches `percent` / 100. The result names, for each document, the
smallest key that links can reach.

1. Sets that are equal form a class (a node); only one of a class takes part in the join. Copies are
   met first inside the map tasks, so a text that fills a third of the table costs little.
2. Shingles get one global order: by how often their bucket occurs in all documents (an array of
   counts that grows with the corpus up to 2**COUNT_BITS, 16 MB), then by hash. Any order gives the
   same links; a sharper one gives fewer candidates. Linked sets share a shingle among their rarest,
   the first n - ceil(t * n) + 1 of that order, so only nodes that share one there are candidates.
   These postings are dealt to parts of about PART of them, sized by their measured number; a task
   holds one part at a time. A shingle whose bucket stands out by more than HOT from the usual bucket
   is dealt to several parts.
3. Shingles that one node has end in their part. Those of up to SMALL nodes give all their pairs at
   once. Those of more become postings, and their nodes meet in stars: of each shingle's nodes of
   similar size, all are held against one pivot, so pairs grow with the postings. What then shares a
   frequent shingle but is in different components is compared in blocks: the nodes outside of the shingle's
   largest component are dealt to an eighth each, at least SMALLEST and at most BLOCK of them and
   about BLOCK_SHINGLES; all nodes that share a shingle with one of a block pass by it. So rows are at most about 8
   times the postings while a group has up to 8 * BLOCK nodes in different components; beyond that
   they grow with the group times its blocks. Where that is much, further stars go before.
   Pairs whose sizes, positions or bucket histograms rule a link out are dropped unseen.
4. The rest is verified exactly. A block's sets (or a pivot's partners) are stored in a prefix tree,
   most frequent shingle first, so that near copies share a path almost to its end; a set walks down
   the tree with the overlap so far, which all sets below share, and leaves a subtree as soon as the
   shingles that remain can't lift any set below to the overlap it needs. What passes by a block is
   split over tasks, each with a copy of the block's content.
5. Components come from alternating large-star and small-star steps over tables of links.

Null texts and texts without words have an empty set and link with nothing; fewer words than a
shingle count as one shingle. Rows with equal texts share their component, rows that repeat a key are
judged by their own text. Null keys never name a component unless all its keys are null. An empty
table gives an empty result. Columns other than key and text are ignored. A text of many MB is hashed
in pieces; its set (8 bytes a shingle) and a few arrays of its size are held in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import discard, materialise, text_chunks

WORDS = 5
PERCENT = 80
#: Bits of the largest array of counts, and characters of text for which it has a bucket.
COUNT_BITS, COUNT_CHARS = 22, 1600
#: Bits of the largest filter that says which keys' texts a pass needs (16 MB).
FILTER_BITS = 27
#: Occurrences of a shingle from which its postings are dealt to several parts.
HOT = 20_000
#: Postings of one part.
PART = 400_000
#: Postings that a task collects before it deals them.
HELD = 200_000
#: Characters and bytes of text whose words are hashed at once; a longer word makes a longer piece.
CHUNK = PIECE = 250_000
#: Nodes of a shingle whose pairs are listed.
SMALL = 8
#: Sets of one block (least, most), and its shingles.
SMALLEST, BLOCK, BLOCK_SHINGLES = 64, 8192, 1_000_000
#: Shingles of the sets that one prefix tree holds.
TREE_SHINGLES = 2_000_000
#: Pieces in which tasks send arrays to be merged.
BLOCKS = 64
#: Bits of a hash that a histogram doesn't look at.
_ABOVE = 20
_BASE = 0x9E3779B97F4A7C15
_BYTE_KEYS = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_KEYS[32] = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def needed(n, m, percent: int = PERCENT):
    """Least overlap with which sets of n and m elements link."""
    return -(-(percent * (n + m)) // (100 + percent))


# --- sets ---


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; raw is lower-cased, its white space is spaces, and it ends with one.

    A word's hash is the sum of its bytes' keys times powers of a base, from running sums over all words.
    """
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE - 1) + 1
        own = np.frombuffer(raw, np.uint8, end - at, at)
        up, down = powers(1 << max(len(own), PIECE).bit_length())
        space = own == 32
        edge = np.diff(space.view(np.int8), prepend=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[own] * up[: len(own)], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        starts.append(first + at)
        hashes.append((h ^ h >> np.uint64(32)) * _MIX)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Shingler:
    """Sets of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.odd = np.array([int(_ODD[i % 5]) * (2 * (i // 5) + 1) & (1 << 64) - 1 for i in range(words)], np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        raws = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        starts, h = word_hashes(b" ".join(raws) + b" ")
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        k, out = self.words, []
        whole = sum(h[i : len(h) - k + 1 + i] * self.odd[i] for i in range(k)) + np.uint64(k) if len(h) >= k else h[:0]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            n = b - a
            total = whole[a : b - k + 1] if n >= k else (h[a:b] * self.odd[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n) if n else h[:0]
            total = (total ^ total >> np.uint64(32)) * _MIX
            out.append(np.unique(total ^ total >> np.uint64(29)))
        return out


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def by_rarity(own: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set (sorted by hash) in the global order, rarest first."""
    return own[np.argsort(ranks[bucket(own, ranks)], kind="stable")]


def histogram(own: np.ndarray) -> bytes:
    """How many shingles fall into each of 64 buckets or more (about one for two shingles), at most 255 each."""
    bits = min(max(6, int(len(own)).bit_length() - 1), 16)
    return np.minimum(np.bincount((own >> np.uint64(64 - _ABOVE - bits) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Histograms:
    """Upper bounds of the overlap with many sets at once, from histograms; those of one length are compared together."""

    def __init__(self, items: list[tuple[int, int, bytes]], percent: int):
        """items: (node, size, histogram)."""
        self.percent, self.by_length = percent, {}
        for length in {len(h) for _, _, h in items}:
            own = [x for x in items if len(x[2]) == length]
            table = np.frombuffer(b"".join(h for _, _, h in own), np.uint8).reshape(len(own), length)
            self.by_length[length] = (np.array([x[0] for x in own]), np.array([x[1] for x in own]), table.astype(np.uint16), (table == 255).any(1))

    def plausible(self, n: int, data: bytes) -> np.ndarray:
        """The nodes that a set of size n with this histogram may link with."""
        own, out = np.frombuffer(data, np.uint8), []
        full = bool((own == 255).any())
        for length, (nodes, sizes, table, cut) in self.by_length.items():
            # buckets of the longer histogram are parts of the shorter one's
            short = min(length, len(own))
            a = own.astype(np.uint16).reshape(short, -1).sum(1)
            b = table if length == short else table.reshape(len(nodes), short, -1).sum(2)
            most = np.minimum(b, a).sum(1, dtype=np.int64)
            need = needed(n, sizes, self.percent)
            out.append(nodes[((most >= need) | cut | full) & (np.minimum(sizes, n) >= need)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


# --- arrays that tasks merge and the driver reads: of a bounded size, whatever the input ---


def merged(parts: DataFrame, size: int, kind: str, add: Callable) -> np.ndarray:
    """Rows (block, data) from many tasks, added up block by block; the result has `size` elements."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = np.frombuffer(raw, kind)
                sums[b] = add(sums[b], own) if b in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "data"])

    out = np.zeros(size, kind)
    for row in parts.repartitionById(BLOCKS, "block").mapInArrow(total, "block int, data binary").collect():  # `size` elements
        own = np.frombuffer(bytes(row.data), kind)
        out[row.block * len(own) : (row.block + 1) * len(own)] = own
    return out


def in_blocks(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(array, BLOCKS)], pa.binary())], ["block", "data"])


def bucket(hashes: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Places of hashes in an array of counts whose length is a power of two."""
    return (hashes >> np.uint64(65 - len(array).bit_length())).astype(np.int64)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Counts on a fine logarithmic scale, in 16 bits."""
    return np.round(1024 * np.log2(1 + counts.astype(np.float64))).astype(np.uint16)


def filter_slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64) * _ODD[0]
    return [(h >> np.uint64(64 - bits)).astype(np.int64), ((h * _ODD[1]) >> np.uint64(64 - bits)).astype(np.int64)]


class KeyFilter:
    """A Bloom filter over 64-bit integers: some 16 bits a key, FILTER_BITS at most; what it lets through is joined exactly."""

    def __init__(self, keys: DataFrame):
        """keys: a table (not a plan that is costly to run twice) with a column `key`."""
        bits = self.bits = min(max(int(16 * keys.count()).bit_length(), 16), FILTER_BITS)

        def run(batches):
            array = np.zeros(1 << bits, bool)
            for batch in batches:
                for slot in filter_slots(np.array(batch.column("key").to_numpy(zero_copy_only=False), np.int64), bits):
                    array[slot] = True
            yield in_blocks(np.packbits(array))

        few = keys.select("key").coalesce(64)
        self.shared = keys.sparkSession.sparkContext.broadcast(merged(few.mapInArrow(run, "block int, data binary"), 1 << bits - 3, "u1", np.bitwise_or))

    def reader(self) -> Callable[[pa.Array], np.ndarray]:
        """In a task: which keys may be in the filter."""
        bits, raw = self.bits, self.shared.value

        def has(keys: pa.Array) -> np.ndarray:
            slots = filter_slots(np.array(keys.to_numpy(zero_copy_only=False), np.int64), bits)
            return np.logical_and.reduce([(raw[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool) for s in slots])

        return has


# --- the prefix tree ---


class PrefixTree:
    """A path-compressed trie of sets in one order; every node knows the sets that end there and how much may follow."""

    def __init__(self, sets: list[np.ndarray], rank: Callable[[np.ndarray], np.ndarray]):
        """rank: gives a set's (sorted) elements in the order of the tree, with unsigned sort keys in front of the hash."""
        paths = [rank(s) for s in sets]  # structured (key, hash), big-endian: bytes sort as the order does
        order = sorted(range(len(sets)), key=lambda i: paths[i].tobytes())
        self.sizes = [len(s) for s in sets]
        # node: [shingles, children, sets that end here, most shingles below, sizes below]
        self.root: list = [np.zeros(0, np.uint64), [], [], 0, set()]
        stack: list[tuple[list, int]] = [(self.root, 0)]  # the path of the last set: node, depth at its end
        last = np.zeros(0, np.uint64)
        for i in order:
            own = paths[i]["h"].astype(np.uint64)
            m = min(len(own), len(last))
            differ = np.flatnonzero(own[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while stack[-1][1] > common:
                node, end = stack.pop()
                above = stack[-1][1]
                if above < common:  # the set leaves the path inside this node
                    head = [node[0][: common - above], [node], [], 0, set()]
                    node[0] = node[0][common - above :]
                    stack[-1][0][1][-1] = head
                    stack.append((head, common))
            if common < len(own):
                leaf = [own[common:], [], [], 0, set()]
                stack[-1][0][1].append(leaf)
                stack.append((leaf, len(own)))
            stack[-1][0][2].append(i)
            last = own
        self._close(self.root)

    def _close(self, root: list) -> None:
        todo, seen = [root], []
        while todo:
            node = todo.pop()
            seen.append(node)
            todo += node[1]
        for node in reversed(seen):
            node[3] = max((len(c[0]) + c[3] for c in node[1]), default=0)
            node[4] = {self.sizes[i] for i in node[2]}.union(*(c[4] for c in node[1]))

    def overlaps(self, probe: np.ndarray, least: Callable[[int], int]) -> Iterator[tuple[int, int]]:
        """(set, overlap) of all sets whose overlap with the probe (sorted by hash) is least(size) or more."""
        n = len(probe)
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if len(node[0]):
                at = np.minimum(np.searchsorted(probe, node[0]), n - 1)
                overlap += int(np.count_nonzero(probe[at] == node[0]))
            for i in node[2]:
                if overlap >= least(self.sizes[i]):
                    yield i, overlap
            for child in node[1]:
                most = overlap + min(len(child[0]) + child[3], n - overlap)
                if any(most >= least(size) for size in child[4]):
                    todo.append((child, overlap))


def tree_rank(ranks: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The global order from its frequent end."""

    def rank(own: np.ndarray) -> np.ndarray:
        out = np.empty(len(own), [("k", ">u2"), ("h", ">u8")])
        out["k"] = 0xFFFF - ranks[bucket(own, ranks)]
        out["h"] = own
        out.sort(order=("k", "h"))
        return out

    return rank


# --- the join ---


class Join:
    """The steps of one join; tables between them lie in the shared folder."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, percent: int, stars: int):
        self.docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
        self.spark = docs.sparkSession
        self.words, self.percent, self.stars = words, percent, stars
        self.key_type = self.docs.schema["key"].dataType.simpleString()
        self.own: list[str] = []  # folders of tables that only this join reads
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self, df: DataFrame, label: str) -> DataFrame:
        return materialise(df, label, self.own)

    def profile(self) -> tuple[DataFrame, np.ndarray]:
        """key, text_key, node and n (size of its set) of each document; how often each bucket's shingles occur, over all documents.

        Texts that repeat within a task count once there.
        """
        words = self.words
        chars = self.docs.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(max(int(chars // COUNT_CHARS).bit_length(), 16), COUNT_BITS)

        def run(batches):
            shingler, counts, seen = Shingler(words), np.zeros(1 << bits, np.uint32), set()
            for batch, texts in text_chunks(batches, most=CHUNK):
                sets = shingler.sets(texts)
                nodes = [node_of(s) if len(s) else None for s in sets]
                new = [s for x, s in dict(zip(nodes, sets, strict=True)).items() if x is not None and x not in seen]
                seen.update(nodes)
                if new:
                    np.add.at(counts, bucket(np.concatenate(new), counts), np.uint32(1))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], names)
            blocks = in_blocks(counts)
            none = pa.nulls(blocks.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none.cast(key_type), none, none, none, *blocks.columns], names)

        names, key_type = ["key", "text_key", "node", "n", "block", "data"], to_arrow_type(self.docs.schema["key"].dataType)
        both = materialise(self.docs.mapInArrow(run, f"key {self.key_type}, text_key bigint, node bigint, n bigint, block int, data binary"), "jaccard-profile")
        add = lambda a, b: np.minimum(a.astype(np.int64) + b, 0xFFFFFFFF).astype("<u4")
        return both.where("block is null").select("key", "text_key", "node", "n"), merged(both.where("block is not null").select("block", "data"), 1 << bits, "<u4", add)

    def candidates(self, members: DataFrame, counts: np.ndarray, shared_ranks) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs (a, b) of nodes that share a shingle of few; (token, node, n, pos) of shingles that many have; node, n and histogram of all nodes."""
        words, percent = self.words, self.percent
        first = F.col("n") + 1 - F.ceil(F.lit(percent) * F.col("n") / 100)
        postings = members.where("n > 0").agg(F.sum(first)).first()[0] or 0
        parts = max(self.tasks, -(-int(postings) // PART))
        tasks = min(parts, 4 * self.tasks)
        usual = float(np.median(counts))

        def run(batches):
            shingler, ranks, seen, held, size = Shingler(words), shared_ranks.value, set(), [], 0
            for _, texts in text_chunks(batches, most=CHUNK):
                for own in shingler.sets(texts):
                    n, node = len(own), node_of(own)
                    if n == 0 or node in seen:
                        continue
                    seen.add(node)
                    held.append((node, n, by_rarity(own, ranks)[: n + 1 - -(-percent * n // 100)].copy(), histogram(own)))
                    size += len(held[-1][2])
                    if size > HELD:
                        yield from pack(held, ranks)
                        held, size = [], 0
            if held:
                yield from pack(held, ranks)

        def pack(held, ranks):
            lengths = np.array([len(first) for _, _, first, _ in held])
            token = np.concatenate([first for _, _, first, _ in held])
            node = np.repeat(np.array([x[0] for x in held], np.int64), lengths)
            n = np.repeat(np.array([x[1] for x in held], np.int32), lengths)
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            above = np.exp2(ranks[bucket(token, ranks)] / 1024) - 1 - usual  # about how often the shingle itself occurs
            splits = 1 + (np.maximum(above, 0) // HOT).astype(np.int64)
            salt = ((node & 0xFFFFFF) % splits).astype(np.uint64)
            part = ((token * _ODD[2] + salt * _ODD[3] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            columns = (token, node, n, pos, (splits > 1).astype(np.uint8))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = [b"".join([x[own].tobytes() for x in columns]) for own in np.split(order, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()), pa.array(rows, pa.binary())], ["part", "node", "n", "data"])
            for at in range(0, len(held), 5000):
                some = held[at : at + 5000]
                nodes = [x[0] for x in some]
                yield pa.RecordBatch.from_arrays([pa.array([x % parts for x in nodes], pa.int64()), pa.array(nodes, pa.int64()), pa.array([x[1] for x in some], pa.int32()), pa.array([x[3] for x in some], pa.binary())], ["part", "node", "n", "data"])

        def gather(batches):
            part, got, seen = None, [], set()
            for batch in batches:
                rows = []
                for p, node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "n", "data")), strict=True):
                    if p != part:
                        yield from groups(got)
                        part, got, seen = p, [], set()
                    if node is None:
                        got.append(raw)
                    elif node not in seen:
                        seen.add(node)
                        rows.append((node, n, raw))
                yield record(node=pa.array([x[0] for x in rows], pa.int64()), n=pa.array([x[1] for x in rows], pa.int32()), data=pa.array([x[2] for x in rows], pa.binary()))
            yield from groups(got)

        def groups(got):
            if not got:
                return
            split_at = [np.cumsum([0, 8, 8, 4, 4, 1]) * (len(raw) // 25) for raw in got]
            token, node, n, pos, split = (np.concatenate([np.frombuffer(raw[cut[i] : cut[i + 1]], kind) for raw, cut in zip(got, split_at, strict=True)]) for i, kind in enumerate(("<u8", "<i8", "<i4", "<i4", "u1")))
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, order = token[new], node[new], order[new]
            n, pos, split = n[order], pos[order], split[order] > 0
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            end, size = np.repeat(start + size, size), np.repeat(size, size)
            few, found = np.flatnonzero((size > 1) & (size <= SMALL) & ~split), []
            for d in range(1, SMALL):
                i = few[few + d < end[few]]
                j = i + d
                need = needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)
                ok = (np.minimum(n[i], n[j]) >= need) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
                found.append(np.stack([node[i[ok]], node[j[ok]]]))  # nodes ascend within a shingle
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            for at in range(0, pairs.shape[1], 50_000):
                yield record(node=pa.array(pairs[0, at : at + 50_000]), other=pa.array(pairs[1, at : at + 50_000]))
            many = (size > SMALL) | split
            token, node, n, pos = token[many].view(np.int64), node[many], n[many], pos[many]
            for at in range(0, len(token), 50_000):
                s = slice(at, at + 50_000)
                yield record(token=pa.array(token[s]), node=pa.array(node[s]), n=pa.array(n[s]), pos=pa.array(pos[s]))

        kinds = {"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "other": pa.int64(), "data": pa.binary()}

        def record(**columns) -> pa.RecordBatch:
            rows = len(columns["node"])
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kind) for c, kind in kinds.items()], list(kinds))

        dealt = self.docs.select("text").mapInArrow(run, "part bigint, node bigint, n int, data binary").repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
        every = self.table(dealt.mapInArrow(gather, "token bigint, node bigint, n int, pos int, other bigint, data binary"), "jaccard-candidates")
        return every.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), every.where("token is not null").select("token", "node", "n", "pos"), every.where("data is not null").select("node", "n", "data")

    def possible(self, n: Column, pos: Column, m: Column, pos2: Column) -> Column:
        """Whether sets of these sizes whose first common shingle stands at these positions can link."""
        need = F.ceil(F.lit(self.percent) * (n + m) / (100 + self.percent))
        return (F.least(n, m) >= need) & (F.least(n - pos, m - pos2) >= need)

    def star(self, shared: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b), a < b, of each shingle's nodes of similar size with one of them, for components that differ."""
        width = F.lit(float(np.log(100 / self.percent)))
        rows = shared.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / width + F.lit(0.5 * (turn % 2))))
        pivots = rows.groupBy("token", "class").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn // 2)), F.col("node").alias("p"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))).alias("s"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "class", "s.*")
        pivots = self.table(pivots, "jaccard-stars")  # so that Spark can split hot shingles in the join
        pairs = rows.join(pivots, ["token", "class"]).where((F.col("comp") != F.col("comp2")) & self.possible(F.col("n"), F.col("pos"), F.col("m"), F.col("pos2")))
        return pairs.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))

    @staticmethod
    def capacity(nodes: Column) -> Column:
        """Sets to a block, of so many."""
        return F.greatest(F.lit(SMALLEST), F.least(F.lit(BLOCK), F.ceil(nodes / 8)))

    def mixed(self, shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
        """Postings of shingles whose nodes are in several components, with the shingle's largest one and all its nodes
        (top, k); their number, and about that of the rows that rest() makes of them."""
        rows = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by_comp = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        groups = by_comp.groupBy("token").agg(F.max(F.struct("k", F.col("comp").alias("top"))).alias("x"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        groups = self.table(groups.select("token", "x.top", "k", (F.col("k") - F.col("x.k")).alias("outside")), "jaccard-groups")  # so that Spark can split hot shingles in the join
        kept = self.table(rows.join(groups, "token"), "jaccard-mixed")
        row = kept.agg(F.count(F.lit(1)).alias("postings"), F.sum(F.ceil(F.col("outside") / self.capacity(F.col("outside")))).alias("passing")).first()
        return kept.drop("outside"), row.postings, row.passing or 0

    def rest(self, mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks (block, node, n) of nodes outside of their shingles' largest components, and the nodes that pass by them."""
        outside = mixed.where("comp <> top").select("token", "node", "n", "k")
        home = outside.groupBy("node", "n").agg(F.max(F.struct("k", "token")).getField("token").alias("home"))
        total = home.groupBy("home").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
        tasks = total.select("home", F.greatest(F.ceil(F.col("nodes") / self.capacity(F.col("nodes"))), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("tasks"))
        blocks = self.table(home.join(tasks, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("tasks"))).alias("block")), "jaccard-blocks")
        reach = outside.join(blocks, "node").groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        near = (F.col("n") * 100 >= F.col("low") * self.percent) & (F.col("high") * 100 >= F.col("n") * self.percent)
        passing = mixed.join(reach, "token").where(near).select("block", "node").distinct()
        return blocks.select("block", "node"), self.table(passing, "jaccard-passing")

    def dealt(self, blocks: DataFrame, passing: DataFrame, payload: DataFrame) -> DataFrame:
        """block, salt, passes, node and payload: every block's content first, then some of the nodes that pass by it.

        As many pass by a copy of a block as it has sets, SMALLEST at least, so copies are no more than what passes.
        """
        sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("sets"))
        tasks = passing.groupBy("block").agg(F.count(F.lit(1)).alias("passing")).join(sizes, "block").select("block", F.ceil(F.col("passing") / F.greatest(F.lit(SMALLEST), "sets")).cast("int").alias("tasks"))
        tasks = self.table(tasks, "jaccard-tasks")  # so that Spark can split large blocks in the joins
        content = blocks.join(tasks, "block").join(payload, "node").select("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(False).alias("passes"), *payload.columns)
        rows = passing.join(tasks, "block").join(payload, "node").select("block", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("salt"), F.lit(True).alias("passes"), *payload.columns)
        return content.union(rows).repartition(self.tasks, "block", "salt").sortWithinPartitions("block", "salt", "passes")

    def histograms(self, sketches: DataFrame, nodes: DataFrame) -> DataFrame:
        """node, n, data of the nodes of a table."""
        every = self.table(nodes.distinct(), "jaccard-alive")
        known = KeyFilter(every.select(F.col("node").alias("key")))

        def run(batches):  # drops most of the others before they are shuffled
            has = known.reader()
            for batch in batches:
                yield batch.filter(pa.array(has(batch.column("node"))))

        return self.table(sketches.mapInArrow(run, "node bigint, n int, data binary").join(every, "node", "left_semi"), "jaccard-histograms")

    def plausible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs whose histograms don't rule a link out."""
        percent = self.percent

        def run(batches):
            for batch in batches:
                a, b, n, m = (batch.column(c).to_pylist() for c in ("a_data", "b_data", "n", "m"))
                keep = [len(Histograms([(0, q, y)], percent).plausible(p, x)) > 0 for x, y, p, q in zip(a, b, n, m, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        own = self.histograms(sketches, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        side = lambda c, n: own.select(F.col("node").alias(c), F.col("n").alias(n), F.col("data").alias(f"{c}_data"))
        return self.table(pairs.join(side("b", "m"), "b").join(side("a", "n"), "a").select("a", "b", "n", "m", "a_data", "b_data").mapInArrow(run, "a bigint, b bigint"), "jaccard-plausible")

    def plausible_passing(self, blocks: DataFrame, passing: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of blocks and of the nodes that pass by them, those that may have a partner on the other side."""
        percent = self.percent

        def run(batches):
            group, content, table, hit, out = None, [], None, set(), []

            def close():
                out.extend((group[0], node, False) for node in hit)
                hit.clear()

            for batch in batches:
                for block, salt, passes, node, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (block, salt) != group:
                        close()
                        group, content, table = (block, salt), [], None
                    if not passes:
                        content.append((node, n, data))
                        continue
                    table = table or Histograms(content, percent)
                    found = set(table.plausible(n, data).tolist()) - {node}
                    if found:
                        hit |= found
                        out.append((block, node, True))
                yield rows(out)
                out.clear()
            close()
            yield rows(out)

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["block", "node", "passes"])

        own = self.histograms(sketches, blocks.select("node").union(passing.select("node")))
        found = self.table(self.dealt(blocks, passing, own).mapInArrow(run, "block bigint, node bigint, passes boolean"), "jaccard-passing")
        return found.where("not passes").select("block", "node").distinct(), found.where("passes").select("block", "node")

    def sets_of(self, nodes: DataFrame, first_keys: DataFrame) -> DataFrame:
        """node, tokens (sorted 64-bit hashes) of some nodes, from the texts of their first keys."""
        wanted = self.table(nodes.distinct().join(first_keys, "node"), "jaccard-wanted")
        slot = F.xxhash64("key")  # null keys too
        known, words = KeyFilter(wanted.select(slot.alias("key"))), self.words

        def run(batches):
            shingler, seen, has = Shingler(words), set(), known.reader()
            for batch in batches:
                hit = has(batch.column("key"))
                if not hit.any():
                    continue
                for _, texts in text_chunks([batch.filter(pa.array(hit))], most=CHUNK):
                    rows = [(node_of(s), s) for s in shingler.sets(texts) if len(s)]
                    rows = [(x, s) for x, s in dict(rows).items() if x not in seen]
                    seen.update(x for x, _ in rows)
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["node", "tokens"])

        sets = self.docs.select(slot.alias("key"), "text").mapInArrow(run, "node bigint, tokens binary")
        return self.table(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")

    def verified(self, blocks: DataFrame, passing: DataFrame, first_keys: DataFrame, shared_ranks) -> DataFrame:
        """Links (a, b) between what passes by a block and the block's content, by prefix trees.

        Of the links in a block those are returned that connect what others of its links don't, so their
        number is linear too.
        """
        percent = self.percent

        def root(parent: dict[int, int], x: int) -> int:
            while (above := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[above] if above in parent else above
            return x

        def run(batches):
            rank = tree_rank(shared_ranks.value)
            group, content, size, trees, parent = None, [], 0, [], {}

            def close():
                nonlocal content, size
                if content:
                    trees.append((PrefixTree([own for _, own in content], rank), [node for node, _ in content]))
                content, size = [], 0

            for batch in batches:
                out = []
                for block, salt, passes, node, raw in zip(*batch.columns, strict=True):
                    own = np.frombuffer(raw.as_buffer(), np.uint64)
                    node, passes = node.as_py(), passes.as_py()
                    if (block.as_py(), salt.as_py()) != group:
                        group, content, size, trees, parent = (block.as_py(), salt.as_py()), [], 0, [], {}
                    if not passes:
                        content.append((node, own.copy()))
                        size += len(own)
                        if size > TREE_SHINGLES:
                            close()
                        continue
                    close()
                    for tree, nodes in trees:
                        for i, _ in tree.overlaps(own, lambda m, n=len(own): needed(n, m, percent)):
                            a, b = root(parent, node), root(parent, nodes[i])
                            if a != b:
                                parent[a] = b
                                out.append((node, nodes[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        before = len(self.own)
        sets = self.sets_of(blocks.select("node").union(passing.select("node")), first_keys)
        dealt = self.dealt(blocks, passing, sets).mapInArrow(run, "a bigint, b bigint")
        large = self.own[before:]  # the sets, the largest tables
        links = self.table(dealt, "jaccard-links")
        discard(self.spark, large)
        self.own = [x for x in self.own if x not in large]
        return links

    def around_pivots(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) as blocks of partners that a pivot passes by; of a pair, the node with more pairs is the pivot."""
        both = pairs.union(pairs.select("b", "a"))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        known = pairs.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("l")), "b")
        turned = known.select(F.when(F.col("k") >= F.col("l"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("k") >= F.col("l"), F.col("b")).otherwise(F.col("a")).alias("b"))
        tasks = turned.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SMALLEST).cast("int").alias("tasks"))
        rows = self.table(turned.join(tasks, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("tasks"))).alias("block")), "jaccard-pivots")
        return rows.select("block", F.col("b").alias("node")), rows.select("block", F.col("a").alias("node")).distinct()

    def pair_links(self, pairs: DataFrame, sketches: DataFrame, first_keys: DataFrame, shared_ranks) -> DataFrame | None:
        """The links among some pairs."""
        pairs = self.plausible(pairs, sketches)
        return None if pairs.isEmpty() else self.verified(*self.around_pivots(pairs), first_keys, shared_ranks)

    def linked(self, labels: DataFrame, links: DataFrame | None) -> DataFrame:
        """node, comp with further links (a, b)."""
        return labels if links is None else components(links.union(labels.select("node", "comp")), self.table)

    def run(self) -> DataFrame:
        members, counts = self.profile()
        first_keys = self.table(members.where("n > 0").groupBy("node").agg(F.min("key").alias("key")), "jaccard-classes")
        shared_ranks = self.spark.sparkContext.broadcast(ranks_of(counts))
        few, many, sketches = self.candidates(members, counts, shared_ranks)
        labels = self.spark.createDataFrame([], "node bigint, comp bigint")
        pairs = self.table(few.union(self.star(many.withColumn("comp", F.col("node")), 0)).distinct(), "jaccard-pairs")
        labels, tested = self.linked(labels, self.pair_links(pairs, sketches, first_keys, shared_ranks)), pairs
        for turn in range(1, max(self.stars, 1) + 1):
            mixed, postings, passing = self.mixed(many, labels)
            if turn >= self.stars or passing <= 16 * postings:
                break
            pairs = self.table(self.star(mixed.drop("top", "k"), turn).distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
            labels, tested = self.linked(labels, self.pair_links(pairs, sketches, first_keys, shared_ranks)), tested.union(pairs)
        if postings:
            blocks, passing = self.plausible_passing(*self.rest(mixed), sketches)
            if not passing.isEmpty():
                labels = self.linked(labels, self.verified(blocks, passing, first_keys, shared_ranks))
        named = first_keys.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("key").alias("component_id"))
        of_node = materialise(named.join(least, "comp").select("node", "component_id"), "jaccard-components")
        discard(self.spark, self.own)
        return members.join(of_node, "node", "left").select("key", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def components(links: DataFrame, table: Callable = materialise) -> DataFrame:
    """node, comp (the smallest node of its component) of all nodes with links (a, b).

    What joins with the links is written before, so that Spark can split nodes with very many links.
    """
    edges = table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "components")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large, "components")
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = table(small, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        state = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, stars: int = 8) -> DataFrame:
    """key, text_key (hash of the text), n_shingles (size of the set), component_id (smallest key reachable by links): one row per document."""
    return Join(docs, key, text, words, percent, stars).run().withColumnRenamed("key", key)


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest key.

    If several rows have this key, the text whose hash is smallest stays, once. Documents without
    words and those with a null key all stay.
    """
    found = near_duplicates(docs, key, text, words, percent).where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    found = materialise(found.select(F.col(key).alias("_jaccard_key"), F.col("text_key").alias("_jaccard_text_key"), "component_id"), "jaccard-found")
    kept = found.where("_jaccard_key = component_id").groupBy("_jaccard_key").agg(F.min("_jaccard_text_key").alias("_jaccard_text_key"), F.count(F.lit(1)).alias("_jaccard_rows"))
    kept = materialise(kept, "jaccard-kept")
    gone = found.join(kept, ["_jaccard_key", "_jaccard_text_key"], "left_anti").select("_jaccard_key", "_jaccard_text_key").distinct()
    left = docs.withColumn("_jaccard_at", F.xxhash64(text)).join(gone, (F.col(key) == F.col("_jaccard_key")) & (F.col("_jaccard_at") == F.col("_jaccard_text_key")), "left_anti")
    repeated = kept.where("_jaccard_rows > 1").select("_jaccard_key")
    if not repeated.isEmpty():  # rows that repeat
        again = F.col(key) == F.col("_jaccard_key")
        left = left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates([key, "_jaccard_at"]))
    return left.drop("_jaccard_at")
