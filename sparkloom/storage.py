"""Cutting lineage in the folder that driver and executors share; this package's code for executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package for executors that don't have it, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom-core.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))


def shared_folder(spark: SparkSession, label: str) -> str:
    """The URI of a new folder in spark.checkpoint.dir, which driver and executors share; it goes when the driver ends in order.

    A temporary folder stands in for that setting only in local runs that don't have it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    base = base if "://" in base else f"file://{base}"
    own = f"{base.rstrip('/')}/sparkloom-core-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # the session may have ended before
        discard(spark, folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def parts_for(spark: SparkSession, units: int, each: int) -> int:
    """How many partitions `units` things go to, `each` in one; shuffles of the session get as many at least, and rows dealt by one key stay where they are for several.

    The settings hold for the session from then on, as plans read them when they run; Spark joins small partitions again.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return shuffles_for(spark, units, each)


def shuffles_for(spark: SparkSession, units: int, each: int) -> int:
    """The same number, and shuffles of the session get as many partitions at least."""
    parts = max(spark.sparkContext.defaultParallelism, -(-units // each))
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts and units > each:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return parts


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there, and later scans can leave columns out."""
    spark = df.sparkSession
    folder = shared_folder(spark, "cut")
    names = [f"_{i}" for i in range(len(df.columns))]  # columns may have any name
    df.toDF(*names).write.parquet(folder)
    stored = spark.read.schema(df.toDF(*names).schema).parquet(folder)
    return stored.toDF(*df.columns)


def opened(uri: str):
    """The file system and path of what Spark names a file by (scheme and path, nothing escaped); plain paths are local."""
    from pyarrow import fs

    scheme, colon, path = uri.partition(":/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    place = path[1:] if path.startswith("/") else f"/{path}"  # file:/a and file:///a, s3://bucket/a
    return fs.FileSystem.from_uri(f"{scheme}://{quote(place)}")


@contextmanager
def appearing(uri: str):
    """A stream to a file that appears under its name only when it is whole, in place of one of that name."""
    files, path = opened(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        yield out
    files.move(part, path)


def replaced(uri: str, raw: bytes) -> None:
    """Write such a file at once."""
    with appearing(uri) as out:
        out.write(raw)


#: Ways in which stored_archives() and packed_archives() spoil a zip file.
DAMAGES = ("whole", "empty", "cut short", "garbled", "locked", "not a zip")


def _spoilt(raw: bytes, damage: str) -> bytes:
    if damage == "locked":  # the flag of encryption in every local and central header
        raw = bytearray(raw)
        for mark, at in ((b"PK\3\4", 6), (b"PK\1\2", 8)):
            place = raw.find(mark)
            while place >= 0:
                raw[place + at] |= 1
                place = raw.find(mark, place + 4)
        return bytes(raw)
    if damage == "garbled":  # the first member's packed bytes
        start = 30 + int.from_bytes(raw[26:28], "little") + int.from_bytes(raw[28:30], "little")
        end = start + int.from_bytes(raw[18:22], "little")
        return raw[:start] + bytes(x ^ 0xFF for x in raw[start:end]) + raw[end:]
    return {"whole": raw, "empty": b"", "cut short": raw[: len(raw) // 2], "not a zip": b"no zip at all"}[damage]


def _zipped(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(model, its zip file) for rows of model, members and damage."""
    for model, members, damage in zip(*(batch.column(c).to_pylist() for c in ("model", "members", "damage")), strict=True):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for m in members:
                z.writestr(m["member"], m["text"] or "")
        yield model, _spoilt(packed.getvalue(), damage)


def _by_model(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("member", "text"))).alias("members"), F.max("damage").alias("damage"))


def stored_archives(rows: DataFrame, label: str, ending: str) -> str:
    """A new folder in the shared one with a zip file <model>.<ending> for each model.

    rows: model, member, text, and damage (one of DAMAGES). A model's members meet in one task.
    """
    folder = shared_folder(rows.sparkSession, label)

    def run(batches):
        for batch in batches:
            for model, raw in _zipped(batch):
                replaced(f"{folder}/{model}.{ending}", raw)
            yield pa.RecordBatch.from_arrays([batch.column("model")], ["model"])

    ship(rows.sparkSession)
    _by_model(rows).mapInArrow(run, "model string").count()
    return folder


def packed_archives(rows: DataFrame, ending: str) -> DataFrame:
    """path (<model>.<ending>), length, content: the same zip files as rows of a table in the shared folder.

    For archives by the million, of a few KB each: as files they take a block, a name and an entry of the driver's listing each.
    """

    def run(batches):
        for batch in batches:
            made = [(f"{model}.{ending}", len(raw), raw) for model, raw in _zipped(batch)]
            for i in range(0, len(made), 1000):
                names, lengths, raws = zip(*made[i : i + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(raws, pa.binary())], ["path", "length", "content"])

    ship(rows.sparkSession)
    return cut(_by_model(rows).mapInArrow(run, "path string, length long, content binary"))


def stored_zips(rows: DataFrame, label: str, ending: str) -> str:
    """The same for whole zip files: model, member, text."""
    return stored_archives(rows.select("model", "member", "text", F.lit("whole").alias("damage")), label, ending)


def packed_zips(rows: DataFrame, ending: str) -> DataFrame:
    return packed_archives(rows.select("model", "member", "text", F.lit("whole").alias("damage")), ending)
