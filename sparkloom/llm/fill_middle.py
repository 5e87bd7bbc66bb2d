"""Fill-in-middle transformation: texts reordered so that a model learns to write what stands between two parts.

A text is a sequence of units, matches of a pattern (code points unless told otherwise). Two passes of a
lazy match iterator do the work: the first counts the units, the second advances to the two ranks where the
prefix and the middle end. No list of units is ever made, so a text of any length takes the memory of the
text and its result. Ranks, form and whether a text stays plain depend on a hash of its key alone, so the
result is the same on any number of executors and after any restart.

Null texts count as empty, and empty texts stay plain, as do texts that hold one of the marks. A null key
hashes like empty text. What lies between two units belongs to the part of the unit before. A unit's
pattern should not match nothing. Rows are handled one by one: repeated rows repeat, ties can't arise, empty
tables give empty results, columns besides key and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_chunks

CODE_POINT = r"(?s:.)"


@dataclass(frozen=True)
class Settings:
    """marks: of prefix, suffix and middle. reordered, suffix_first: of 100 texts those not plain, and of 100 of these those that begin with the suffix."""

    unit: str = CODE_POINT
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    reordered: int = 90
    suffix_first: int = 20
    seed: str = "1"


def n_units(unit: re.Pattern[str], text: str) -> int:
    """First pass: how many units there are."""
    seen = count()
    for _ in zip(unit.finditer(text), seen, strict=False):  # the matches come and go one by one
        pass
    return next(seen)


def ends(unit: re.Pattern[str], text: str, ranks: tuple[int, int]) -> Iterator[int]:
    """Second pass: where the units of two ascending ranks end (0: before the first unit)."""
    found, passed, at = unit.finditer(text), 0, 0
    for rank in ranks:
        if rank > passed:
            at, passed = next(islice(found, rank - passed - 1, None)).end(), rank
        yield at


def transform(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and output, the text to train on."""
    own = settings or Settings()
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])

    def cut(unit: re.Pattern[str], name: object, whole: str) -> tuple:
        n = n_units(unit, whole)
        digest = hashlib.sha256(f"{own.seed}:{'' if name is None else name}".encode()).hexdigest()
        first, second, fate, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not n or fate % 100 >= own.reordered or any(mark in whole for mark in own.marks):
            return n, "plain", None, None, whole
        low, high = ends(unit, whole, tuple(sorted((first % (n + 1), second % (n + 1)))))
        prefix, middle, suffix = (mark + part for mark, part in zip((own.marks[0], own.marks[2], own.marks[1]), (whole[:low], whole[low:high], whole[high:]), strict=True))
        if order % 100 < own.suffix_first:
            return n, "spm", low, high - low, suffix + prefix + middle
        return n, "psm", low, high - low, prefix + suffix + middle

    def run(batches):
        unit = re.compile(own.unit)
        for batch, texts in text_chunks(batches, "text"):
            rows = [cut(unit, name, whole) for name, whole in zip(batch.column("key").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = Settings.marks) -> Column:
    """The text that transform() got, from its output and form."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
