"""Writers and the policies for outputs that exist."""

import json

import pytest

from trackweave.sources import sinks


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x", None), (1, None, 0.5)], "b int, c string, a double").coalesce(1)
    sinks.write_csv(rows, f"file://{tmp_path}/full", one_file=True)
    assert lines(tmp_path / "full") == ["a,b,c", ",2,x", "0.5,1,"]
    sinks.write_csv(rows.where("b > 9"), f"file://{tmp_path}/none", one_file=True)
    assert lines(tmp_path / "none") == []
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_csv(rows, f"file://{tmp_path}/full")


def test_manifests_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("person_002", 3, None), ("person_001", 1, 0.25)], "folder string, count int, best double").coalesce(1)
    sinks.write_manifests(rows, f"file://{tmp_path}/manifests")
    got = [json.loads(x) for x in lines(tmp_path / "manifests")]
    assert [list(x) for x in got] == [["best", "count", "folder"]] * 2 and got[0] == {"best": None, "count": 3, "folder": "person_002"}
    sinks.write_report(rows.selectExpr("folder", "concat(folder, ': ', count) as line"), f"file://{tmp_path}/report", ["folder"])
    assert lines(tmp_path / "report") == ["person_001: 1", "person_002: 3"]


def test_policies(spark, tmp_path):
    path, made = f"file://{tmp_path}/stage", []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    assert sinks.stage(spark, path, make(3)).count() == 3
    with pytest.raises(FileExistsError):
        sinks.stage(spark, path, make(4))
    assert sinks.stage(spark, path, make(5), "resume").count() == 3
    assert sinks.stage(spark, path, make(6), "overwrite").count() == 6
    assert made == [3, 6]
    with pytest.raises(ValueError, match="policy"):
        sinks.stage(spark, path, make(7), "other")
