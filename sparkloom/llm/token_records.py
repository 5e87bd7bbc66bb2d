"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard holds records framed as: length (unsigned 64-bit), masked CRC-32C of those 8 bytes, the
record, masked CRC-32C of the record; all little-endian, the mask being a rotation by 15 bits plus a
constant, as in the TFRecord files that many training loaders read. A record is the key (signed
64-bit), a flag byte (bit 0: the key is null; the rest: bytes per id, 2 or 4, shifted by one) and the
ids. Beside each shard stands an index of (key, offset, ids) triples of 64-bit integers.

write() range-partitions documents by key and a hash of the text, so a key with very many rows is spread too, and sorts
within partitions, so shards follow each other in ascending key order. A task begins another shard whenever one has come to
SHARD_BYTES, and writes the index along with the records; only a one-row manifest per shard leaves it. read() checks every checksum.
read_shuffled() visits records in a seeded random order: shards are dealt at random and, within
each, the index is permuted.

Null text is empty and gives the end id alone. A null key sorts first. Rows that repeat a key are all
written, ordered by a hash of their text; equal rows are written as often as they occur. An empty table gives no shards. Further columns are ignored, whatever their
names. A task holds CHUNK_CHARS characters of texts, or one longer text, with its words and ids (about
ten times the text); a reader holds one record, or 4 MB of them, and for shuffled reads a shard's index (24 bytes a record).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, new_file, store, text_chunks

POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8
LANE = 512
#: A shard ends with the record that takes it beyond so many bytes.
SHARD_BYTES = 256 << 20
#: Words that a worker remembers; beyond that those that were not met lately go.
CACHE_WORDS = 1_000_000
#: New words that the library gets at once: what it returns is large.
NEW_WORDS = 2048
#: Steps of a normaliser that lower-case plain words and do no more to them.
NORMAL_KINDS = {("NFC", "None", None), ("Lowercase", "None", None), ("Replace", "{'Regex': '\\\\s+'}", " ")}
#: Words of letters of ASCII and from U+00C0 to U+00FF.
PLAIN_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER = np.array([chr(b).isalnum() for b in range(128)] + [False] * 128)
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def cut_before_punctuation(raw: bytes) -> bytes:
    """UTF-8 with a space between a letter or number and ASCII punctuation other than an apostrophe.

    Letters are those of ASCII and those from U+00C0 to U+00FF; after others nothing is cut.
    """
    codes = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_PUNCTUATION[codes[1:]]) + 1
    last = codes[at - 1]
    wide = (at > 1) & (codes[at - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    at = at[_LETTER[last] | wide]
    if not len(at):
        return raw
    out = np.full(len(codes) + len(at), 32, np.uint8)
    space = np.zeros(len(out), bool)
    space[at + np.arange(len(at))] = True
    out[~space] = codes
    return out.tobytes()


@lru_cache(1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table, and four tables that move a state over LANE zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    move = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(LANE):
        move = table[move & 255] ^ move >> 8
    return table, move


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record (of 4 bytes or more), all records side by side.

    Leading zeros don't change a state of zero, so every record is padded in front to whole lanes;
    the usual starting value is folded into its first four bytes.
    """
    table, move = crc_tables()
    lanes = np.array([-(-len(r) // LANE) for r in records])
    ends = np.cumsum(lanes) * LANE
    space = np.zeros(int(ends[-1]), np.uint8)
    for r, end in zip(records, ends.tolist(), strict=True):
        space[end - len(r) : end] = np.frombuffer(r, np.uint8)
        space[end - len(r) : end - len(r) + 4] ^= 255
    columns = np.ascontiguousarray(space.reshape(-1, LANE).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = table[(state ^ column) & 255] ^ state >> np.uint32(8)
    first, out = np.cumsum(lanes) - lanes, np.zeros(len(records), np.uint32)
    for k in range(int(lanes.max())):
        at = np.flatnonzero(lanes > k)
        s = out[at]
        out[at] = move[0][s & 255] ^ move[1][s >> 8 & 255] ^ move[2][s >> 16 & 255] ^ move[3][s >> 24] ^ state[first[at] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


class Recent:
    """A cache in two generations: what is asked for moves to the younger one, and the older one goes as a whole."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that must be made; the others are in `young` afterwards."""
        if len(self.young) + len(keys) > self.most // 2:
            self.young, self.old = {}, self.young
        out = []
        for k in keys.difference(self.young):
            if k in self.old:
                self.young[k] = self.old[k]
            else:
                out.append(k)
        return out


def normal_kinds(path: str) -> set[tuple]:
    """What the normaliser of a tokenizer file does."""
    with open(path, encoding="utf-8") as f:
        normal = json.load(f)["normalizer"]
    return {(x["type"], str(x.get("pattern")), x.get("content")) for x in normal.get("normalizers", [normal])}


def word_ends(path: str, tokenizer) -> np.ndarray | None:
    """For each id whether it stands at the end of pre-tokens alone, if the file's model marks such ids."""
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    out[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return out


class WordEncoder:
    """A lower-casing tokenizer that drops white space, applied to each distinct word once.

    Its pre-tokens never reach across white space, nor from a letter into ASCII punctuation other than
    an apostrophe, so texts are cut there and the parts' ids remembered. Before that, texts are cut at
    the tokenizer's added tokens, as the library does. ASCII is lower-cased here, unless a text has
    combining marks, which the library composes with letters first. New words of plain letters skip the
    normaliser, which takes half of the library's time, where it would only lower-case them. A tokenizer whose added tokens are
    matched in any other way than literally, or could be made by lower-casing, gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
        self.added = [t.content.encode() for t in added]
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")")
        self.whole = any(t.single_word or t.lstrip or t.rstrip or t.normalized or len(t.content.split()) != 1 or cut_before_punctuation(t.content.encode()) == t.content.encode() for t in added)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cache = Recent(CACHE_WORDS)
        self.plain = None
        if self.tokenizer.normalizer is not None and normal_kinds(path) <= NORMAL_KINDS:
            self.plain = Tokenizer.from_file(path)  # for words on which the normaliser does nothing
            self.plain.normalizer = None
        self.last = word_ends(path, self.tokenizer)

    def words(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        parts = self.cut.split(raw) if self.added and any(a in raw for a in self.added) else [raw]
        # U+0300 to U+036F, the marks that compose with letters of ASCII, begin with these bytes
        plain = [p if b"\xcc" in p or b"\xcd" in p else p.lower() for p in parts[::2]]
        if len(parts) == 1:
            return cut_before_punctuation(plain[0]).split()
        own = [cut_before_punctuation(p).split() for p in plain]
        return own[0] + [w for added, after in zip(parts[1::2], own[1:], strict=True) for w in (added, *after)]

    def together(self, words: list[bytes], kind: str) -> list[bytes]:
        """Remember the ids of plain words, got as those of one text: each word ends with an id that only ends words. Returns the words if that doesn't hold."""
        ids = np.array(self.plain.encode(b" ".join(words).decode().lower(), add_special_tokens=False).ids, kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return words
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (ends * self.width).tolist(), strict=True):
            self.cache.young[word], at = raw[at:end], end
        return []

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of each text in `width` bytes each, with end_id appended."""
        kind = f"<u{self.width}"
        if self.whole:
            return [np.array([*got.ids, end_id], kind).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        pack = {2: lambda ids: struct.pack(f"<{len(ids)}H", *ids), 4: lambda ids: struct.pack(f"<{len(ids)}I", *ids)}[self.width]
        words = [self.words(t) for t in texts]
        new = self.cache.missing(set(chain.from_iterable(words)))
        normal = [w for w in new if PLAIN_WORD.fullmatch(w)] if self.plain else []
        other = list(set(new).difference(normal))
        if self.last is not None:
            for i in range(0, len(normal), NEW_WORDS):
                other += self.together(normal[i : i + NEW_WORDS], kind)
            normal = []
        for some, tokenizer, form in ((normal, self.plain, str.lower), (other, self.tokenizer, str)):
            for i in range(0, len(some), NEW_WORDS):
                part = some[i : i + NEW_WORDS]
                for word, got in zip(part, tokenizer.encode_batch_fast([form(w.decode("utf-8", "replace")) for w in part], add_special_tokens=False), strict=True):
                    self.cache.young[word] = pack(got.ids)
        end = np.array([end_id], kind).tobytes()
        return [b"".join(map(self.cache.young.__getitem__, w)) + end for w in words]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", most_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards and indexes under folder; their manifest: shard, path, n_records, n_ids, start (ids in earlier shards)."""
    ordered = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumn("at", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("key", "at").sortWithinPartitions("key", "at", "text").drop("at")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        """(key, number of ids, framed record) of every document."""
        words = encoder(tokenizer)
        for batch, texts in text_chunks(batches):
            keys = batch.column("key").to_pylist()
            ids = words.encode(texts, end_id)
            records = [(k or 0).to_bytes(8, "little", signed=True) + bytes([words.width << 1 | (k is None)]) + i for k, i in zip(keys, ids, strict=True)]
            lengths = [len(r).to_bytes(8, "little") for r in records]
            sums = masked(crc32c(lengths + records)).astype("<u4")
            for k, i, n, r, a, b in zip(keys, ids, lengths, records, sums[: len(records)], sums[len(records) :], strict=True):
                yield k or 0, len(i) // words.width, b"".join((n, a.tobytes(), r, b.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = framed(batches)
        row = next(rows, None)
        for nth in count():
            if row is None:
                return
            name, at, n_records, n_ids = f"{folder}/part-{TaskContext.get().partitionId():06d}-{nth:05d}", 0, 0, 0
            with new_file(f"{name}.records") as out, new_file(f"{name}.index") as index:
                while row is not None and at < most_bytes:
                    own, ids, record = row
                    out.write(record)
                    index.write(struct.pack("<3q", own, at, ids))
                    at, n_records, n_ids = at + len(record), n_records + 1, n_ids + ids
                    row = next(rows, None)
            shard = TaskContext.get().partitionId() << 24 | nth
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{name}.records"]), pa.array([n_records]), pa.array([n_ids])], ["shard", "path", "n_records", "n_ids"])

    shards = materialise(ordered.mapInArrow(run, "shard bigint, path string, n_records bigint, n_ids bigint"), "token-shards")
    # one row a shard: the only thing that is ordered in one place
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def records_of(stream, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The records of a shard in order, some at a time, with both checksums checked."""
    raw, at = b"", 0
    while True:
        more = stream.read(size)
        raw, at, found, sums = raw[at:] + more, 0, [], []
        while at + 12 <= len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            if at + 16 + n > len(raw):
                if masked(crc32c([raw[at : at + 8]]))[0] != int.from_bytes(raw[at + 8 : at + 12], "little"):
                    raise ValueError("a record's length is damaged")
                break
            found += [raw[at : at + 8], raw[at + 12 : at + 12 + n]]
            sums += [raw[at + 8 : at + 12], raw[at + 12 + n : at + 16 + n]]
            at += 16 + n
        if found:
            if (masked(crc32c(found)) != np.frombuffer(b"".join(sums), "<u4")).any():
                raise ValueError("a record's checksum differs")
            yield found[1::2]
        if not more:
            if at != len(raw):
                raise ValueError("the shard ends inside a record")
            return
        if not found:
            size = max(size, 2 * len(raw))


def unpack(record: bytes) -> tuple[int | None, np.ndarray]:
    flag = record[8]
    return None if flag & 1 else int.from_bytes(record[:8], "little", signed=True), np.frombuffer(record, f"<u{flag >> 1}", offset=9)


def read(manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as 32-bit integers), and ids if wanted."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, at = store(path)
                with files.open_input_stream(at, compression=None) as stream:
                    for some in records_of(stream):
                        rows = [unpack(r) for r in some]
                        n = np.array([len(i) for _, i in rows])
                        starts = start + np.cumsum(n) - n
                        start = int(starts[-1] + n[-1])
                        columns = [pa.array([k for k, _ in rows], pa.int64()), pa.array(starts), pa.array(n), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, i in rows], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([i.astype(np.int32) for _, i in rows], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    n = manifest.count()
    dealt = manifest.select("shard", "path", "start").repartitionByRange(max(n, 1), "shard")
    return dealt.mapInArrow(run, f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def read_shuffled(manifest: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, ids: every record once, shards dealt at random and each read in a random order by its index."""

    def run(batches):
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                files, at = store(path)
                with files.open_input_file(at.removesuffix(".records") + ".index") as f:
                    offsets = np.frombuffer(f.read(), "<i8").reshape(-1, 3)[:, 1]
                order = np.random.default_rng([seed, shard]).permutation(len(offsets))
                with files.open_input_file(at) as f:
                    for some in np.array_split(offsets[order], -(-len(order) // 256)):
                        rows = []
                        for offset in some.tolist():
                            f.seek(offset)
                            head = f.read(12)
                            body = f.read(int.from_bytes(head[:8], "little") + 4)
                            if masked(crc32c([head[:8], body[:-4]])).astype("<u4").tobytes() != head[8:] + body[-4:]:
                                raise ValueError("a record's checksum differs")
                            rows.append(unpack(body[:-4]))
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([i.astype(np.int32) for _, i in rows], pa.list_(pa.int32()))], [key, "ids"])

    dealt = manifest.select("shard", "path").withColumn("at", F.xxhash64("shard", F.lit(seed)))
    return dealt.repartitionByRange(max(manifest.count(), 1), "at").drop("at").mapInArrow(run, f"{key} bigint, ids array<int>")
