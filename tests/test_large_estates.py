"""What lets an estate grow: how it is dealt out, packed and graded."""

import hashlib
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom import estate as estates
from sparkloom import exchange_queries, metadata_queries, queries, storage
from sparkloom.formulas import measures
from sparkloom.operators import audits, comparison, model_graph, references, reports
from sparkloom.plans.sheets import Sheet
from sparkloom.sinks import files
from sparkloom.sources import archives
from sparkloom.sources import reports as report_files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many(spark, monkeypatch):
    """The estate of 150 models, as if 10 were all that a part should hold."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(estates, "MODELS_A_PART", 10)
    yield estates.estate(spark, SF)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_an_estate_is_dealt_out_by_model_whatever_its_files(spark, many):
    for df in (many.columns, many.measures, many.relationships, many.bindings):
        assert df.rdd.getNumPartitions() == 15
    models = many.columns.rdd.mapPartitions(lambda rows: [len({r.model for r in rows})]).collect()
    assert sum(models) == 150 and max(models) < 40
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 15


def test_analyses_by_model_shuffle_nothing_more(many):
    for df in (audits.naming(many), audits.encoding_advice(many), audits.sizes(many, "cardinality"), references.unused_columns(many)):
        assert shuffles(df) == 0


def test_files_in_packs_are_whole_and_counted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PACK_BYTES", 4)  # for the writer below, in this process
    folder = f"file://{tmp_path}/out"
    rows = [("m", "a/b.txt", "one"), ("m", "c.txt", "é\nline"), ("n", "c.txt", ""), ("n", "d e.txt", None), ("x/y", "z.txt", "deep")]
    files.write_files(spark.createDataFrame(rows, "model string, path string, content string").repartition(2), folder, packed=True)
    made = [f for _, _, names in os.walk(tmp_path / "out") for f in names if not f.startswith(".")]
    assert sum(f.endswith(".tar.gz") for f in made) in (1, 2) and len(made) <= 6  # not one for each row
    want = {(m, p, (c or "").encode()) for m, p, c in rows}
    assert {tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in files.packed_files(spark, folder).collect()} == want
    assert {(r.model, r.path, r.bytes, r.sha256) for r in files.manifest(spark, folder).collect()} == {(m, p, len(c), hashlib.sha256(c).hexdigest()) for m, p, c in want}
    writer = files.Writer(folder, packed=True)
    each = [{"model": "q", "path": f"{i}.txt", "content": "four"} for i in range(3)]
    lost, again = writer.write(iter(each)), writer.write(iter(each))
    assert len(lost.packs) == 3 and files.packed_files(spark, folder).count() == 5  # nothing counts before the commit
    writer.commit([again, None])  # nor a try that was given up
    assert files.packed_files(spark, folder).where("model = 'q'").count() == 3
    writer.abort([lost])
    assert not any(p in os.listdir(tmp_path / "out") for p in lost.packs)
    with pytest.raises(ValueError):
        writer.write(iter([{"model": "m", "path": "../x", "content": "no"}]))
    assert files.packed_files(spark, f"file://{tmp_path}/nothing").count() == 0


def test_archives_by_the_million_are_rows_not_files(spark, monkeypatch):
    monkeypatch.setattr(storage, "replaced", None)  # no file for an archive
    damages = ["whole", "empty", "cut short", "garbled", "locked", "not a zip"]
    rows = spark.createDataFrame([(d.replace(" ", "_"), p, "text " * 50, d) for d in damages for p in ("a.json", "b.json")], "model string, member string, text string, damage string")
    packed = storage.packed_archives(rows, "zip")
    got = {}
    for r in archives.parts_of(packed, ("a.json", "b.json")).collect():
        got.setdefault(r.path, []).append(r.problem or r.part)
    assert {k: sorted(v) for k, v in got.items()} == {
        "whole.zip": ["a.json", "b.json"], "empty.zip": ["empty file"], "cut_short.zip": ["not a zip file"], "garbled.zip": ["a.json can't be unpacked", "b.json"],
        "locked.zip": ["a.json is encrypted", "b.json is encrypted"], "not_a_zip.zip": ["not a zip file"],
    }
    _, _, problems = report_files.reports_of(packed)
    assert problems.count() == 6


def test_a_scorecard_is_graded_section_by_section(many):
    graded = audits.scorecard({"naming": audits.naming(many), "unused": references.unused_columns(many)}, many.tables)
    plan = graded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3 and "rlike" not in plan.lower()  # the sections' counts, and the models
    assert graded.count() == 150


def holders(df) -> int:
    """The sorts and aggregations of a plan: each takes pages of a task's memory, all at once where nothing is shuffled between them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?:Sort \[|Aggregate\(key)", plan))


def test_unused_columns_are_told_in_one_order(many):
    assert holders(references.unused_columns(many)) <= 8 and shuffles(references.unused_columns(many)) == 0


def test_broken_bindings_are_told_in_two_orders(many):
    assert holders(reports.broken_bindings(many)) <= 4


def test_a_cleanup_plan_and_what_it_reclaims_hold_little(many):
    assert holders(reports.cleanup_plan(many)) <= 12
    assert holders(reports.reclaimed(many)) <= 15


def test_structures_are_compared_in_one_grouping(many):
    other = many.with_(relationships=many.relationships.withColumn("direction", F.lit("Single")))
    assert holders(comparison.structure_changes(many, other)) <= 8


def test_versions_of_an_estate_are_read_once(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(estates, "MODELS_A_PART", 10)
    df = exchange_queries.model_history(spark, SF)
    assert holders(df) <= 20
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_objects_of_one_name_count_with_all_that_is_told_of_them(spark):
    rows = lambda contents: [("m", "T", "X", e, "0") for e in contents]
    schema = "model string, table string, measure string, expression string, format string"
    old, new = (estates.Catalog.empty(spark, measures=spark.createDataFrame(rows(e), schema)) for e in (["A", "A"], ["B", "B"]))
    same = estates.Catalog.empty(spark, measures=spark.createDataFrame(rows(["B", "B"]), schema))
    objects = comparison.versions_of(old, 0).unionByName(comparison.versions_of(new, 1)).unionByName(comparison.versions_of(same, 2))
    assert [(r.version, r.object, r.change) for r in comparison.history(objects).collect()] == [(1, "T[X]", "changed")]


def test_costly_expressions_are_computed_once(many):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(references.expression_references(many)).count("regexp_extract_all") <= 2  # of measures, and of calculated columns
    assert plan(reports.usual_source_schema(many)).count("aggregate(") == 1
    assert len(re.findall(r"Filter .*length\(.*regexp_extract_all", plan(comparison.near_duplicate_measures(many)))) == 0


def test_a_text_is_compiled_once_a_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(measures, "to_sql", lambda t: seen.append(t) or (t, ""))
    assert measures.compiled(pd.Series(["a", None, "a", "b", None])).sql_text.tolist() == ["a", "", "a", "b", ""] and sorted(seen) == ["", "a", "b"]


def test_links_are_written_once_for_all_steps(many, monkeypatch):
    read = []
    real = model_graph.links
    monkeypatch.setattr(model_graph, "cut", lambda df: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or storage.cut(df))
    monkeypatch.setattr(model_graph, "links", lambda c: real(c))
    metadata_queries.meta_bridges_far(many)
    assert sum("customer" in p and "DateKey" in p for p in read) == 1


def test_bridges_of_an_estate_are_looked_for_in_one_model_of_each_kind(many, monkeypatch):
    searched = []
    real = model_graph.paths_from
    monkeypatch.setattr(model_graph, "paths_from", lambda starts, *rest: searched.append(starts.select("model").distinct().count()) or real(starts, *rest))
    assert metadata_queries.meta_bridges_far(many).select("model").distinct().count() == 150
    assert searched == [8]  # with stores and measures, countries, stores or none of these; with returns or without


def test_a_level_of_few_groups_never_deals_the_rows_out(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    rows = spark.range(50_000).select((F.col("id") % 2).alias("side"), (F.col("id") % 5).alias("kind"), F.col("id").alias("n"))
    out = Sheet(rows).query({"kind": "[kind]"}, {"x": "SUM(IF [n] > {FIXED [side]: AVG([n])} THEN 1 ELSE 0 END)"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert sorted(map(tuple, out.collect())) == [(k, 5000) for k in range(5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_sheet_of_many_rows_gets_more_partitions(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(queries, "ROWS_A_PART", 100)
    model = queries.star(spark, SF)
    n = -(-model.tables["lineitem"].count() // 100)
    queries.sheet(model, "supplier")  # ten rows
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    queries.sheet(model, "lineitem")
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == n
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_objects_are_made_once_for_their_history(spark, many):
    c = many.with_(tables=many.tables.withColumn("version", F.lit(0)))
    objects = comparison.versions_of(c, 0)
    known = many.tables.select("model").distinct().withColumn("version", F.lit(0))
    assert holders(comparison.history(objects, known)) < holders(comparison.history(objects))
    one = spark.createDataFrame([("m", 0, "Table", "T", 1), ("m", 2, "Table", "T", 1)], "model string, version int, kind string, object string, content long")
    versions = spark.createDataFrame([("m", 0), ("m", 1), ("m", 2)], "model string, version int")  # of which one has no objects
    assert sorted((r.version, r.change) for r in comparison.history(one, versions).collect()) == [(1, "removed"), (2, "added")]
    assert comparison.history(one).count() == 0


def test_near_duplicates_make_fingerprints_for_both_sides_and_copies_alone(many):
    plan = comparison.near_duplicate_measures(many)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode\(array\(", plan)) == 3


def test_a_pair_of_texts_is_compared_once_a_batch(monkeypatch):
    seen = []
    real = comparison.difflib.SequenceMatcher
    monkeypatch.setattr(comparison.difflib, "SequenceMatcher", lambda *a: seen.append(a) or real(*a))
    assert comparison.ratios(pd.Series(["ab", "ab", "x"]), pd.Series(["ab", "ab", "y"])).tolist() == [100.0, 100.0, 0.0] and len(seen) == 2
    assert comparison.ratios(pd.Series([], dtype=str), pd.Series([], dtype=str)).tolist() == []


def test_relations_of_stored_archives_are_never_gathered_on_the_driver(spark):
    damages = {"whole": "whole", "spoilt": "not a zip"}
    text = {"Model.bim": '{"model": {"tables": [{"name": "T", "columns": [{"name": "c", "dataType": "int64"}], "partitions": [{"name": "p", "source": {"type": "calculated", "expression": "1"}}]}], "relationships": [{"name": "r", "fromTable": "T", "fromColumn": "c", "toTable": "U", "toColumn": "c"}]}}'}
    text |= {"DaxVpaView.json": '{"Tables": [{"TableName": "T"}], "Columns": [{"TableName": "T", "ColumnName": "c"}], "Relationships": [{"RelationshipName": "r"}]}', "DaxModel.json": "{}"}
    rows = spark.createDataFrame([(m, p, t, d) for m, d in damages.items() for p, t in text.items()], "model string, member string, text string, damage string")
    read, problems = archives.models_of(storage.packed_archives(rows, "vpax"))  # small enough to be broadcast, as a large estate's files are by their size
    for df in (read.tables, read.columns, read.relationships, exchange_queries.src_model_archives(spark, SF)):
        assert len(df.collect()) in (1, 150)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert read.tables.first().expression == "1" and problems.first().problem == "not a zip file"
