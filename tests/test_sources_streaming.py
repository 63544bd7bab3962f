import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlattice.sources import layout, tiers
from runlattice.streaming import updates as su


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "schema"
    for code, x in (("discovery/000", 1.5), ("exp_001", 2.5)):
        d = root / code
        d.mkdir(parents=True)
        (d / "parameters.json").write_text(json.dumps({"x": x, "n": 2}))
        (d / "temp.csv").write_text("i,temp\n0,1.0\n1,\n")
        (d / "config.json").write_text(json.dumps({"source": "sobol_step"}))
    (root / "exp_001" / "parameter_updates.json").write_text(
        json.dumps([{"updates": {"x": 3.0, "c": "B"}, "iterator_code": "i", "step_index": 1}, {"updates": {"x": 4.0}, "iterator_code": None, "step_index": None}])
    )
    (root / "experiment_sets.json").write_text(json.dumps([{"code": "E1", "members": ["e1", "e2"], "ordered": True}]))
    return str(root)


def test_reading_folders(spark, tree):
    assert [r[0] for r in rows(layout.list_experiments(spark, tree), "exp_code")] == ["discovery/000", "exp_001"]
    params = layout.read_block(spark, tree, "parameters", "x double, n int")
    assert rows(params, "exp_code") == [("discovery/000", 1.5, 2), ("exp_001", 2.5, 2)]
    ups = layout.read_updates(spark, tree).select("seq", "iterator_code", "step_index", "param", "value")
    assert rows(ups, "seq", "param") == [(0, "i", 1, "c", "B"), (0, "i", 1, "x", "3.0"), (1, None, None, "x", "4.0")]
    cells = layout.read_features(spark, tree, "temp", ["i"])
    assert rows(cells.where("exp_code = 'exp_001'"), "i") == [("exp_001", 0, 1.0), ("exp_001", 1, None)]
    assert rows(layout.load_sets(spark, tree), "pos") == [("E1", True, 0, "e1"), ("E1", True, 1, "e2")]
    run = spark.createDataFrame([("S", True, i, f"m{i}") for i in range(10)], "set_code string, ordered boolean, pos long, exp_code string")
    again = layout.sets_from_json(layout.sets_to_json(run, chunk=4))
    assert rows(again, "pos") == rows(run, "pos")
    assert layout.read_snapshots(spark, tree).count() == 2


def test_sets_fall_back_to_external(spark, tmp_path):
    ext = spark.createDataFrame([('{"code":"D","members":["a"],"ordered":false}',)], "value string")
    assert rows(layout.load_sets(spark, str(tmp_path / "none"), ext)) == [("D", False, 0, "a")]


def test_write_only_if_absent(spark, tmp_path):
    path = str(tmp_path / "cells")
    df = spark.createDataFrame([("a", "f", 1.0), ("b", "g", 2.0)], "exp_code string, feature string, value double")
    assert layout.write_table(df, path, ["exp_code", "feature"], ["feature"])
    assert not layout.write_table(df.withColumn("value", F.lit(9.0)), path, ["exp_code", "feature"], ["feature"])
    more = spark.createDataFrame([("a", "f", 5.0), ("c", "f", 3.0)], "exp_code string, feature string, value double")
    assert layout.write_table(more, path, ["exp_code", "feature"], ["feature"])
    got = layout.read_table(spark, path).select("exp_code", "feature", "value")
    assert rows(got, "exp_code") == [("a", "f", 1.0), ("b", "g", 2.0), ("c", "f", 3.0)]
    assert layout.write_table(more.where("exp_code = 'a'"), path, ["exp_code", "feature"], ["feature"], recompute=True)
    got = layout.read_table(spark, path).select("exp_code", "feature", "value")
    assert rows(got, "exp_code") == [("a", "f", 5.0), ("b", "g", 2.0), ("c", "f", 3.0)]


def test_documents_and_feature_files(spark, tmp_path):
    root = str(tmp_path / "out")
    docs = spark.createDataFrame([("discovery/000", 1.0), ("e", 2.0)], "exp_code string, x double")
    assert layout.write_documents(docs, root, "parameters")
    assert not layout.write_documents(docs, root, "parameters")
    assert rows(spark.read.json(f"{root}/parameters").select("exp_code", "x"), "exp_code") == [("discovery/000", 1.0), ("e", 2.0)]
    cells = spark.createDataFrame([("e", 0, 1.5)], "exp_code string, i int, temp double")
    assert layout.write_feature_files(cells, root, "temp", ["i"])
    assert not layout.write_feature_files(cells, root, "temp", ["i"])


def test_tiers(spark):
    keys = spark.createDataFrame([(c,) for c in "abcd"], "exp_code string")

    def have(codes, v):
        return spark.createDataFrame([(c, v) for c in codes], "exp_code string, v int")

    asked = []

    def external(missing):
        asked.append(sorted(r[0] for r in missing.collect()))
        return have("bcz", 3)

    found, missing = tiers.tiered_load(keys, {"memory": have("a", 1), "local": have("ab", 2), "external": external})
    assert rows(found, "exp_code") == [("a", 1, "memory"), ("b", 2, "local"), ("c", 3, "external")]
    assert asked == [["c", "d"]] and rows(missing) == [("d",)]
    found, missing = tiers.tiered_load(keys, {"memory": have("a", 1), "local": have("ab", 2), "external": external}, recompute=True, debug=True)
    assert rows(found) == [("a", 1, "memory")] and missing.count() == 3


def test_saving_pushes_only_news(spark):
    df = spark.createDataFrame([("a", 1.0)], "exp_code string, value double")
    pushed = []
    out = tiers.tiered_save(
        {"new": df, "old": df, "none": df.limit(0)}, lambda name, _: name == "new", lambda name, _: pushed.append(name) or True
    )
    assert out == {"new": "pushed", "old": "present", "none": "empty"} and pushed == ["new"]


def test_numbers_of_any_length(spark):
    df = spark.createDataFrame([(7,), (1234,)], "n long").select(layout.experiment_code("s", F.col("n")).alias("c"))
    assert rows(df) == [("s_007",), ("s_1234",)]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(layout.experiment_code("s", F.lit(-1))).collect()


def test_streamed_log_equals_batch(spark, tmp_path):
    data = spark.createDataFrame(
        [("e", i, "i", i % 4, "p", float(i)) for i in range(40)], "exp_code string, seq long, iterator_code string, step_index int, param string, value double"
    )
    src = str(tmp_path / "src")
    data.repartition(5).write.parquet(src)
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(src)
    # Small files one by one: several micro-batches update the same keys.
    log = su.stream_updates(stream, str(tmp_path / "log"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "log")).select("batch").distinct().count() > 1
    assert rows(log.select("step_index", "seq", "value"), "step_index") == [(s, 36 + s, 36.0 + s) for s in range(4)]


def test_streamed_members_join_train_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "splits")
    spark.createDataFrame([("old", "test")], "exp_code string, split string").write.parquet(f"{out}/batch=-1")
    spark.createDataFrame([("old",), ("new",), ("new",)], "exp_code string").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("exp_code string").option("maxFilesPerTrigger", 1).parquet(src)
    su.grow_splits(spark, stream, out, str(tmp_path / "check"), "exp_code string, split string").awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(out).select("exp_code", "split")
    assert rows(got, "exp_code") == [("new", "train"), ("old", "test")]


def test_folders_are_written_by_all_tasks_one_file_each(spark, tmp_path, monkeypatch):
    """Folders of one task are dealt over all, those of several tasks are put together; only a big one is split."""
    docs = spark.range(40).coalesce(1).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("exp_code"), "id")
    layout.write_documents(docs, str(tmp_path), "parameters")
    files = [p.name for p in (tmp_path / "parameters").glob("*/*.json")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1
    cells = spark.range(600).repartition(6).select(
        F.when(F.col("id") < 300, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("exp_code"),
        F.col("id").cast("int").alias("layer"), (F.col("id") / 2).alias("f"),
    )
    monkeypatch.setattr(layout, "CHUNK", 100)
    layout.write_feature_files(cells, str(tmp_path), "f", ["layer"])
    counts = {p.name: len(list(p.glob("*.csv"))) for p in (tmp_path / "f").iterdir() if p.is_dir()}
    assert counts.pop("exp_code=big") > 1 and set(counts.values()) == {1}
    assert sorted(map(tuple, layout.read_feature_files(spark, str(tmp_path), "f", ["layer"]).select("exp_code", "layer", "f").collect())) == sorted(map(tuple, cells.collect()))
