"""Files written and archives read, with failures on the way; versions of models; security of all users."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.formulas.syntax import Refused
from sparkloom.operators.comparison import history
from sparkloom.plans.policies import for_all_users, policy_classes
from sparkloom.plans.sheets import Question, Sheet
from sparkloom.sinks.files import Writer, manifest, write_files
from sparkloom.sources import reports, workbooks
from sparkloom.sources.archives import listed_files, parts_of
from sparkloom.storage import cut, shared_folder, stored_archives, stored_zips


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_are_written_once_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([("m", "a/b.txt", "one"), ("m", "c.txt", "é\nline"), ("n", "c.txt", ""), ("n", "d e.txt", None)], "model string, path string, content string").withColumn("other", F.lit(1))
    folder = f"file://{tmp_path}/out"
    write_files(rows.repartition(3), folder)
    assert [x for x in tree(tmp_path / "out") if not x.startswith(("_manifest", "."))] == ["m/a/b.txt", "m/c.txt", "n/c.txt", "n/d e.txt"]
    assert (tmp_path / "out/m/c.txt").read_text() == "é\nline"
    assert {(r.model, r.path, r.bytes) for r in manifest(spark, folder).collect()} == {("m", "a/b.txt", 3), ("m", "c.txt", 7), ("n", "c.txt", 0), ("n", "d e.txt", 0)}
    write_files(rows.where("model = 'm'").withColumn("content", F.lit("new")), folder)
    assert (tmp_path / "out/m/c.txt").read_text() == "new" and manifest(spark, folder).where("model = 'm'").count() == 4
    assert manifest(spark, f"file://{tmp_path}/nothing").collect() == []


def test_a_task_that_fails_leaves_no_half_file_and_no_commit(spark, tmp_path):
    writer = Writer(f"file://{tmp_path}/out")

    def broken():
        yield {"model": "m", "path": "a.txt", "content": "whole"}
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    assert tree(tmp_path / "out") == ["m/a.txt"] and manifest(spark, writer.folder).collect() == []
    first, again = (writer.write(iter([{"model": "m", "path": "a.txt", "content": "whole"}])) for _ in range(2))
    writer.commit([again, None])  # the first try counts for nothing
    assert first.name != again.name and manifest(spark, writer.folder).count() == 1
    writer.abort([first, None])
    assert not any(first.name in x for x in tree(tmp_path / "out"))
    with pytest.raises(ValueError):
        writer.write(iter([{"model": "m", "path": "../x", "content": "no"}]))


def test_damaged_archives_are_problems(spark, tmp_path):
    damages = ["whole", "empty", "cut short", "garbled", "locked", "not a zip"]
    rows = spark.createDataFrame([(d.replace(" ", "_"), p, "text " * 50, d) for d in damages for p in ("a.json", "b.json")], "model string, member string, text string, damage string")
    folder = stored_archives(rows, "damaged", "zip")
    got = {}
    for r in parts_of(listed_files(spark, folder), ("a.json", "b.json")).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.problem or r.part)
    assert {k: sorted(v) for k, v in got.items()} == {
        "whole.zip": ["a.json", "b.json"], "empty.zip": ["empty file"], "cut_short.zip": ["not a zip file"], "garbled.zip": ["a.json can't be unpacked", "b.json"],
        "locked.zip": ["a.json is encrypted", "b.json is encrypted"], "not_a_zip.zip": ["not a zip file"],
    }
    _, _, problems = reports.read_reports(spark, folder)
    assert problems.count() == 5  # all but the empty one, which Spark's scan leaves out
    books = workbooks.read_workbooks(spark, stored_archives(rows.withColumn("member", F.lit("x.twb")).dropDuplicates(["model"]), "books", "zip"))
    assert books.where("kind = 'problem'").count() == 5


def test_only_the_wanted_members_are_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("huge.bin", os.urandom(30_000_000))
        z.writestr("deep/a.json", "﻿{}")
    raw = bytearray((tmp_path / "big.zip").read_bytes())
    raw[1000:2000] = bytes(1000)  # the large member is broken, which nobody sees
    (tmp_path / "big.zip").write_bytes(raw)
    assert [(r.part, r.text, r.problem) for r in parts_of(listed_files(spark, str(tmp_path)), ("a.json",)).collect()] == [("a.json", "{}", None)]


def test_shared_folders(spark, monkeypatch):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    odd = spark.createDataFrame([(1, "x")], ["a b", "c,d"])
    assert cut(odd).columns == ["a b", "c,d"] and [tuple(r) for r in cut(odd).collect()] == [(1, "x")]
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster, "x")
    one = stored_zips(spark.createDataFrame([("m", "a.txt", "t")], "model string, member string, text string"), "one", "zip")
    raw = spark.read.format("binaryFile").load(one).first().content
    assert zipfile.ZipFile(io.BytesIO(raw)).read("a.txt") == b"t"


def test_history_of_many_versions(spark):
    data = {1: {"a": 1, "b": 1, "c": 1}, 2: {"a": 1, "b": 2}, 5: {"a": 1, "b": 2, "c": 1}, 7: {}, 9: {"a": 3}}
    rows = [("m", v, "K", o, x) for v, own in data.items() for o, x in own.items()] + [("m", v, "K", "always", 0) for v in data] + [("one", 1, "K", "x", 1)]
    got = sorted(tuple(r) for r in history(spark.createDataFrame(rows, "model string, version int, kind string, object string, content long")).collect())
    want = []
    for (_, old), (v, new) in zip(list(data.items()), list(data.items())[1:]):
        want += [("m", v, "K", o, "added") for o in new.keys() - old.keys()] + [("m", v, "K", o, "removed") for o in old.keys() - new.keys()] + [("m", v, "K", o, "changed") for o in new.keys() & old.keys() if new[o] != old[o]]
    assert got == sorted(want)


def test_users_see_what_their_groups_may(spark):
    rows = Sheet(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 4.0), ("z", 8.0), (None, 16.0)], "s string, v double"))
    members = spark.createDataFrame([("ann", "g1"), ("ann", "g2"), ("bob", "g2"), ("bob", "g2"), ("cid", "g2"), ("cid", "g1"), ("dan", "none"), (None, "g1"), ("eve", None)], "user string, group string")
    allowed = spark.createDataFrame([("g1", "x"), ("g2", "x"), ("g2", "z"), ("g2", "z"), ("g1", None)], "group string, value string")
    asked = Question({}, {"t": rows.scope.tree("SUM([v])"), "n": rows.scope.tree("COUNT([v])"), "all": rows.scope.tree("{FIXED : MAX([v])}")})
    got = {r.user: (r.t, r.n) for r in for_all_users(rows, Question({}, {k: asked.measures[k] for k in ("t", "n")}), "s", members, allowed).collect()}
    assert got == {"ann": (11.0, 3), "bob": (11.0, 3), "cid": (11.0, 3)}
    assert policy_classes(members).select("policy").distinct().count() == 3
    assert {r.user: r["all"] for r in for_all_users(rows, asked, "s", members, allowed.where("value = 'x'")).collect()} == {"ann": 2.0, "bob": 2.0, "cid": 2.0}
    with pytest.raises(Refused):
        for_all_users(rows, asked, "w", members, allowed)
