"""Rows of (model, path, content) as files, written by a data source with two-phase commit.

Each task writes a file under a name of its own and then renames it, so a file is whole or not there, and a task that
runs again puts the same file in its place. What a task has written it notes in a part of the manifest; the driver's commit
names the parts of the tasks that count, one line a task, and only then is the write there for readers. A write that
fails leaves no commit, and its parts go; whole files of it may stay, which no manifest names.

Small files by the million go into packs: compressed tar files that a task streams its rows' files to, as <model>/<path>.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import appearing, opened, replaced, ship

NAME = "model_files"
#: Bytes of files after which a task begins another pack.
PACK_BYTES = 256 << 20
MANIFEST = "model string, path string, bytes long, sha256 string"


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    packs: tuple[str, ...] = ()


def _file(row) -> tuple[bytes, str]:
    """A row's content, and its line in the manifest."""
    raw = (row["content"] or "").encode()
    if ".." in str(row["path"]).split("/") or not row["path"]:
        raise ValueError(f"a path that leaves its folder: {row['path']!r}")
    return raw, json.dumps({"model": str(row["model"]), "path": row["path"], "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})


class Writer(DataSourceWriter):
    def __init__(self, folder: str, packed: bool = False):
        self.folder, self.packed, self.job = folder.rstrip("/"), packed, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        name = f"{self.job}-{uuid.uuid4().hex}"  # another for each try of the task
        return self._packs(rows, name) if self.packed else self._files(rows, f"{name}.json")

    def _files(self, rows: Iterator, name: str) -> Part:
        lines = []
        for row in rows:
            raw, line = _file(row)
            replaced(f"{self.folder}/{row['model']}/{row['path']}", raw)
            lines.append(line)
        replaced(f"{self.folder}/_manifest/{name}", "\n".join(lines).encode())
        return Part(name, len(lines))

    def _packs(self, rows: Iterator, name: str) -> Part:
        packs, n, row = [], 0, next(rows, None)
        with appearing(f"{self.folder}/_manifest/{name}.json.gz") as out, gzip.open(out, "wb", compresslevel=3) as notes:
            while row is not None:
                packs.append(f"{name}-{len(packs)}.tar.gz")
                with appearing(f"{self.folder}/{packs[-1]}") as to, tarfile.open(fileobj=to, mode="w|gz", compresslevel=3) as tar:
                    held = 0
                    while row is not None and held < PACK_BYTES:
                        raw, line = _file(row)
                        info = tarfile.TarInfo(f"{row['model']}/{row['path']}")
                        info.size = len(raw)
                        if "/" in str(row["model"]):  # the name alone doesn't tell where the model's ends
                            info.pax_headers = {"SPARKLOOM.model": str(row["model"])}
                        tar.addfile(info, io.BytesIO(raw))
                        notes.write(f"{line}\n".encode())
                        n, held, row = n + 1, held + len(raw), next(rows, None)
        return Part(f"{name}.json.gz", n, tuple(packs))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        if self.packed:
            replaced(f"{self.folder}/_manifest/_packs-{self.job}", "\n".join(p for m in parts for p in m.packs).encode())
        replaced(f"{self.folder}/_manifest/_committed-{self.job}", "\n".join(m.name for m in parts).encode())

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            for name in (f"_manifest/{m.name}", *m.packs) if m is not None else ():
                files, path = opened(f"{self.folder}/{name}")
                files.delete_file(path)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("packed") == "true")


def write_files(rows: DataFrame, folder: str, packed: bool = False) -> None:
    """Write rows of (model, path, content) below a folder that driver and executors share; other columns are left out. packed: into packs."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Files)
    rows.select(F.col("model").cast("string").alias("model"), "path", "content").write.format(NAME).mode("append").option("path", folder).option("packed", str(packed).lower()).save()


def _committed(folder: str, what: str) -> list[str]:
    """What the commits of a folder name: their parts of the manifest, a line a task, or their packs."""
    from pyarrow import fs

    files, path = opened(folder)
    place = f"{path.rstrip('/')}/_manifest"
    if files.get_file_info(place).type == fs.FileType.NotFound:
        return []
    found = {x.base_name: x.path for x in files.get_file_info(fs.FileSelector(place))}
    lists = [p for n, p in found.items() if n.startswith(f"_{what}-") and n.replace(f"_{what}-", "_committed-", 1) in found]
    return [x for p in lists for x in files.open_input_stream(p).read().decode().split("\n") if x]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """model, path, bytes, sha256 of all that committed writes have put into a folder; the last line of each file counts."""
    parts = _committed(folder, "committed")
    if not parts:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json([f"{folder.rstrip('/')}/_manifest/{p}" for p in parts]).distinct()


def packed_files(spark: SparkSession, folder: str) -> DataFrame:
    """model, path, content (bytes) of the files in a folder's committed packs, read as streams, one pack at a time in a task."""
    packs = [f"{folder.rstrip('/')}/{p}" for p in _committed(folder, "packs")]

    def run(batches):
        for batch in batches:
            for pack in batch.column("pack").to_pylist():
                rows, held = [], 0
                files, place = opened(pack)
                with files.open_input_stream(place, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    for info in tar:
                        model = info.pax_headers.get("SPARKLOOM.model") or info.name.partition("/")[0]
                        rows.append((model, info.name[len(model) + 1 :], tar.extractfile(info).read()))
                        tar.members.clear()  # a stream that isn't read again
                        held += info.size + 100
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    ship(spark)
    named = spark.createDataFrame([(p,) for p in packs], "pack string")
    return named.repartition(max(len(packs), 1)).mapInArrow(run, "model string, path string, content binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["model", "path", "content"])
