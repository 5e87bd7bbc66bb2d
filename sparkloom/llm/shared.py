"""Helpers that the training-data operators share: shared storage, batching, output batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text that a Python worker holds at once (a longer document is a piece of its own).
CHUNK_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()
_folders: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Settings for operators on whole texts, and this package for executors that don't have it.

    Texts vary from nothing to megabytes: fewer rows and bytes to a batch keep workers small. The two
    settings hold for the session from then on, as plans read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share, for tables of this application.

    Only where that setting is absent (local tests) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete an application's tables when the driver ends in order; else they stay for whoever owns the shared folder."""
    with suppress(Exception):
        discard(spark, [folder])


def materialise(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    paths: gets the table's folder, for discard().
    """
    path = shared_dir(df.sparkSession, label)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def sample_bound(n: int, most: int) -> int | None:
    """Signed 64-bit bound below which about `most` of n evenly spread 64-bit hashes lie; None if all may be taken."""
    return None if n <= most else (most << 64) // n - (1 << 63)


def arrow_schema(spec: str) -> tuple[T.StructType, pa.Schema]:
    struct = T._parse_datatype_string(spec)
    return struct, to_arrow_schema(struct)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that each part holds about `most` characters; null texts become empty."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            if text is None:
                texts[i] = text = ""
            if size and size + len(text) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; plain paths are local."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A binary file that appears under its name only when it is whole, so a repeated task replaces it."""
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None, buffer_size=1 << 20) as out:
        yield out
    try:
        files.move(part, path)
    except OSError:  # stores that don't rename over a file
        files.delete_file(path)
        files.move(part, path)
