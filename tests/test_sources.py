"""Delta tables by their log, and batches of sources with an outcome each."""

import json

import pytest

from govlens.sources import tables

SCHEMA = "k int, v string, p int"


def commit(folder, version, *actions):
    log = folder / "_delta_log"
    log.mkdir(parents=True, exist_ok=True)
    (log / f"{version:020}.json").write_text("\n".join(json.dumps(a) for a in actions))


def file(spark, folder, name, rows):
    spark.createDataFrame(rows, "k int, v string").coalesce(1).write.parquet(f"{folder}/{name}")
    path = spark.read.parquet(f"{folder}/{name}").inputFiles()[0]
    return f"{name}/{path.rsplit('/', 1)[-1]}"


def meta(spark, keys=("p",), **configuration):
    schema = spark.createDataFrame([], SCHEMA).schema.json()
    return {"metaData": {"schemaString": schema, "partitionColumns": list(keys), "configuration": configuration}}


def add(path, p, **more):
    return {"add": {"path": path, "partitionValues": {"p": p}, **more}}


@pytest.fixture
def delta(spark, tmp_path):
    folder = tmp_path / "t"
    a, b, c = (file(spark, folder, n, r) for n, r in (("one", [(1, "a")]), ("two", [(2, "b"), (3, None)]), ("three", [(4, "d")])))
    commit(folder, 0, {"protocol": {"minReaderVersion": 1}}, meta(spark), add(a, "7"))
    commit(folder, 1, {"commitInfo": {"operation": "WRITE"}}, add(b, None))
    commit(folder, 2, {"remove": {"path": a}}, add(c, "9"))
    commit(folder, 3, add(a, "7"))
    return folder, (a, b, c)


def rows(df):
    return sorted(map(tuple, df.collect()))


ONE, TWO, THREE = [(1, "a", 7)], [(2, "b", None), (3, None, None)], [(4, "d", 9)]


def test_versions_of_a_log(spark, delta):
    folder, _ = delta
    for version, want in ((0, ONE), (1, ONE + TWO), (2, TWO + THREE), (3, ONE + TWO + THREE), (None, ONE + TWO + THREE)):
        got = tables.read_delta(spark, str(folder), version)
        assert got.columns == ["k", "v", "p"] and sorted(map(str, rows_of(got))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        tables.read_delta(spark, str(folder), 9)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_a_checkpoint_stands_for_what_was_before(spark, delta):
    folder, (a, b, c) = delta
    log = folder / "_delta_log"
    m = meta(spark)["metaData"]
    entries = [(add(b, None)["add"], None, None), (add(c, "9")["add"], None, None), (None, {"path": a}, None), (None, None, m)]
    spark.createDataFrame(entries, tables._ACTIONS.replace("add struct<path:string,partitionValues:map<string,string>,deletionVector:struct<storageType:string>>", "add struct<path:string,partitionValues:map<string,string>>")).coalesce(1).write.parquet(str(folder / "cp"))
    part = next(p for p in (folder / "cp").iterdir() if p.suffix == ".parquet")
    part.rename(log / f"{2:020}.checkpoint.parquet")
    for v in (0, 1, 2):
        (log / f"{v:020}.json").unlink()
    (log / f"{3:020}.checkpoint.{1:010}.{2:010}.parquet").write_text("one of two parts: not whole")
    assert sorted(map(str, rows_of(tables.read_delta(spark, str(folder), 2)))) == sorted(map(str, TWO + THREE))
    assert sorted(map(str, rows_of(tables.read_delta(spark, str(folder))))) == sorted(map(str, ONE + TWO + THREE))
    with pytest.raises(ValueError):
        tables.read_delta(spark, str(folder), 1)


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    commit(tmp_path / "dv", 0, meta(spark), add("x.parquet", "1", deletionVector={"storageType": "u"}))
    commit(tmp_path / "names", 0, meta(spark, **{"delta.columnMapping.mode": "name"}))
    commit(tmp_path / "none", 0, meta(spark))
    for name in ("dv", "names"):
        with pytest.raises(ValueError):
            tables.read_delta(spark, str(tmp_path / name))
    assert tables.read_delta(spark, str(tmp_path / "none")).count() == 0


def test_one_source_that_fails_stops_no_other(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    opened = {"a": lambda: spark.read.parquet(str(tmp_path / "a")), "gone": lambda: spark.read.parquet(str(tmp_path / "gone")), "odd": lambda: spark.range(3), "column": lambda: spark.range(2)}

    def work(name, df):
        if name == "odd":
            raise KeyError(name)
        return df.select("x").count() if name == "column" else df.count()

    got = {r.source: (r.status, r["rows"], r.error) for r in tables.outcomes(spark, opened, work, threads=3).collect()}
    assert got == {"a": ("ok", 5, None), "gone": ("failed", None, "PATH_NOT_FOUND"), "odd": ("failed", None, "KeyError"), "column": ("failed", None, "UNRESOLVED_COLUMN.WITH_SUGGESTION")}
