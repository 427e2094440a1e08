"""The artifact data source: what is written is read again, a failed job leaves nothing, runs are replaced and pruned."""

from __future__ import annotations

import os
import pickle
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.sources import artifacts

ORIGIN = dict(zip("schema_version study_id round_id question_id generated_at model prompt_version code_version".split(), ["1.0", "s", "r", "q: 7", "2024-01-01T00:00:00Z", "m", "p", None], strict=True))
ODD = ["plain", "", "null", "~", "true", "1.50", "007", "- dash: x", "é 語 😀", "two\nlines\n", " spaces ", "# no comment", "'q' \"r\"", "a & <b>", "tab\there", "{x: 1}", "x" * 5000]


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(artifacts.ArtifactSource)
    return spark


def syntheses(spark, runs=("a/b", "ü 1", "007")):
    claim = lambda i, t: {"text": t, "agreement_level": [None, "divided"][i % 2], "sources": ODD[: i % 4], "counterarguments": [], "support_level": [None, "contested"][i % 2], "evidence_grade": None, "method": t, "year": "1999", "lineage": None, "quotes": [{"source": "s", "text": t, "status": [None, "verified"][i % 2], "snapped": i % 2 == 0, "inherited": False, "node_id": None}] * (i % 3), "node_refs": [], "citation": None}
    rows = [{"run_id": r, **ORIGIN, "claims": [claim(i, t) for i, t in enumerate(ODD)] if n else [], "areas_of_agreement": ODD, "areas_of_disagreement": [], "uncertainties": ["u"], "minority_reports": [{"source_ids": ["x"], "perspective": "p"}], "narrative": "n\n\nm", "narrative_statements": [{"text": "t", "claim_refs": ["1"], "expert_refs": []}], "gaps": [{"description": "d", "gap_type": None}] * n} for n, r in enumerate(runs)]
    return spark.createDataFrame(rows, artifacts.SCHEMAS["synthesis"])


def read(spark, path, kind="synthesis", form="yaml"):
    return spark.read.format("artifact").option("kind", kind).option("form", form).load(path)


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["run_id"])


def test_yaml_round_trip(source, tmp_path):
    path = str(tmp_path / "out")
    df = syntheses(source)
    df.repartition(3).write.format("artifact").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["%C3%BC%201.yaml", "007.yaml", "a%2Fb.yaml"]
    assert plain(read(source, f"file://{path}")) == plain(df)
    text = (tmp_path / "out" / "007.yaml").read_text()
    assert "support_level: contested" in text and "support_level: null" not in text and "agreement_level: null" in text and "snapped: false" not in text


@pytest.mark.parametrize("form", ["yaml", "xml"])
def test_graph_round_trip(source, tmp_path, form):
    texts = [t.strip() for t in ODD if t.strip()]
    nodes = [{"id": f"n\"{i}&<", "claim": t, "expert_id": t, "quote": t if i % 2 else None, "verification_status": None} for i, t in enumerate(texts)]
    rows = [{"run_id": "g", **(ORIGIN if form == "yaml" else dict.fromkeys(ORIGIN)), "nodes": nodes, "edges": [{"source": 'a"', "target": "b&", "relation": "<c>"}], "node_annotations": [{"node_id": "n", "annotation": "0.25"}] if form == "yaml" else []}]
    rows.append(rows[0] | {"run_id": "empty", "nodes": [], "edges": []})
    df = source.createDataFrame(rows, artifacts.SCHEMAS["graph"])
    df.write.format("artifact").option("kind", "graph").option("form", form).mode("append").save(str(tmp_path / form))
    assert plain(read(source, str(tmp_path / form), "graph", form)) == plain(df)


def test_a_failed_task_leaves_no_file(source, tmp_path):
    path = str(tmp_path / "out")
    df = syntheses(source).repartition(3)
    df.write.format("artifact").mode("append").save(path)
    before = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)}
    many = syntheses(source, [f"r{i}" for i in range(20)]).repartition(8)
    for bad in (many.withColumn("run_id", F.when(F.col("run_id") != "r13", F.col("run_id"))), many.unionByName(many.limit(1)), many.withColumn("narrative", F.when(F.col("run_id") == "r7", F.raise_error(F.lit("lost"))).otherwise(F.col("narrative")))):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("artifact").mode("append").save(path)
        assert {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if not n.startswith(artifacts.PENDING)} == before
        assert plain(read(source, path)) == plain(df)
    df.write.format("artifact").mode("append").save(path)
    assert sorted(os.listdir(path)) == sorted(before)


def test_append_replaces_runs_and_overwrite_all(source, tmp_path):
    path = str(tmp_path / "out")
    syntheses(source, ["a", "b"]).write.format("artifact").mode("append").save(path)
    syntheses(source, ["b", "c"]).withColumn("narrative", F.lit("new")).write.format("artifact").mode("append").save(path)
    assert {r["run_id"]: r["narrative"] for r in read(source, path).collect()} == {"a": "n\n\nm", "b": "new", "c": "new"}
    syntheses(source, ["d"]).write.format("artifact").mode("overwrite").save(path)
    assert os.listdir(path) == ["d.yaml"]
    syntheses(source).limit(0).write.format("artifact").mode("append").save(path)
    assert os.listdir(path) == ["d.yaml"]


def test_files_of_other_runs_are_not_opened(source, tmp_path):
    path = str(tmp_path / "out")
    syntheses(source, ["a", "b", "c"]).write.format("artifact").mode("append").save(path)
    (tmp_path / "out" / "b.yaml").write_text("{not yaml")
    some = source.read.format("artifact").option("runs", '["a", "c", "none"]').load(path)
    assert [r["run_id"] for r in some.orderBy("run_id").collect()] == ["a", "c"]
    with pytest.raises(Exception, match=r"b\.yaml"):
        read(source, path).collect()


@pytest.mark.parametrize("options", [{"kind": "other"}, {"form": "xml"}, {"kind": "graph", "form": "json"}])
def test_options(source, tmp_path, options):
    with pytest.raises(Exception, match="artifact needs"):
        source.read.format("artifact").options(**options).load(str(tmp_path)).collect()


def test_what_the_driver_is_sent_does_not_grow_with_the_files(tmp_path):
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("narrative", T.StringType())])
    sizes = []
    for n in (3, 300):
        writer = artifacts.ArtifactWriter(str(tmp_path / str(n)), "synthesis", "yaml", schema, False)
        sent = [writer.write(iter([(f"r{t}-{i}", "x") for i in range(n)])) for t in range(2)]
        sizes.append(len(pickle.dumps(sent[0])))
        writer.commit(sent)
        assert len(os.listdir(tmp_path / str(n))) == 2 * n
    assert sizes[1] < sizes[0] + 20


def dealt(df, path, folders, mode="append"):
    df.write.format("artifact").option("folders", folders).mode(mode).save(path)


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


def test_runs_in_folders(source, tmp_path):
    path, ids = str(tmp_path / "out"), [*(f"r{i}" for i in range(12)), "a/b", "ü 1"]
    df = syntheses(source, ids)
    dealt(df.repartition(5), path, 3)
    assert plain(read(source, path)) == plain(df)
    at = {r["run_id"]: r["n"] for r in df.select("run_id", artifacts.folder_of(F.col("run_id"), 3).alias("n")).collect()}
    assert tree(path) == sorted(f"{at[i]:05d}-of-00003/{quote(i, safe='')}.yaml" for i in ids)
    syntheses(source, ["r1", "new"]).withColumn("narrative", F.lit("new")).write.format("artifact").mode("append").save(path)
    assert {r["run_id"] for r in read(source, path).filter("narrative = 'new'").collect()} == {"r1", "new"} and read(source, path).count() == len(ids) + 1
    with pytest.raises(Exception, match="in 3 folders, not in 4"):
        dealt(df, path, 4)
    with pytest.raises(Exception, match="there twice"):
        dealt(df.unionByName(df.limit(1)).repartition(5), path, 3)
    assert read(source, path).count() == len(ids) + 1
    (tmp_path / "out" / "00000-of-00003" / "zz.yaml").write_text("{not yaml")
    some = source.read.format("artifact").option("runs", '["r1", "a/b", "none"]').load(path)
    assert [r["run_id"] for r in some.orderBy("run_id").collect()] == ["a/b", "r1"]


def test_overwrite_may_change_folders(source, tmp_path):
    path = str(tmp_path / "out")
    for folders, ids in ((None, ["a", "b", "c"]), (2, ["b", "d", "e"]), (2, ["d"]), (5, ["f"]), (None, ["g", "h"])):
        df = syntheses(source, ids)
        if folders is None and not os.path.exists(path):
            df.write.format("artifact").mode("append").save(path)
        elif folders is None:
            df.write.format("artifact").mode("overwrite").save(path)
        else:
            dealt(df, path, folders, "overwrite")
        assert plain(read(source, path)) == plain(df)
        assert len(tree(path)) == len(ids) and {("/" in n) for n in tree(path)} == {folders is not None}
    assert sorted(os.listdir(path)) == ["g.yaml", "h.yaml"]
    with pytest.raises(Exception, match="in no folders, not in 2"):
        dealt(df, path, 2)
    for bad in (0, -1, "x"):
        with pytest.raises(Exception, match="artifact needs a number of folders"):
            dealt(df, str(tmp_path / "other"), bad)


def test_what_plans_a_read_does_not_grow_with_the_files(tmp_path):
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("narrative", T.StringType())])
    sizes = []
    for n in (30, 3000):
        path = str(tmp_path / str(n))
        writer = artifacts.ArtifactWriter(path, "synthesis", "yaml", schema, False, 4)
        writer.commit([writer.write(iter([(f"r{i}", "x") for i in range(n)]))])
        reader = artifacts.ArtifactReader(path, "synthesis", "yaml", schema, None)
        parts = reader.partitions()
        assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(f"r{i}" for i in range(n))
        sizes.append(len(pickle.dumps(parts)))
    assert sizes[0] == sizes[1]


def test_the_query_has_a_task_a_folder(spark):
    from sheaf.plans.catalogue import QUERIES

    got = QUERIES["artifact_round_trip"](spark, "/root/testdata/sf0.01")
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.count() == 15000 and got.select("run_id").distinct().count() > 1400


def test_tasks_of_a_target_without_folders_are_limited(tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "TASKS", 5)
    for i in range(700):
        (tmp_path / f"r{i}.yaml").touch()
    parts = artifacts.ArtifactReader(str(tmp_path), "synthesis", "yaml", T.StructType(), None).partitions()
    assert len(parts) == 5 and sorted(n for p in parts for n in p.names) == sorted(os.listdir(tmp_path))
