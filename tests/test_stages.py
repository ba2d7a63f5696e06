"""The stage catalogue, release of staged tables, and the bucketed panel table."""

import io
import random
from contextlib import redirect_stdout

import pytest
from frames import SPEC, month, panel, row, table
from pyspark.sql import functions as F

from paneltide.operators.features import lag_features
from paneltide.plans.anomaly import prepare_panel
from paneltide.session import checkpoint_stage, folder_exists, list_folder, shared_dir, stage_path, staging
from paneltide.sources.bucketed import MONTH, open_bucketed, overwrite_months, sink_bucketed
from paneltide.sources.io import stage_via_parquet
from paneltide.sources.stages import StageCatalogue, input_files, stage_key


def rows(seed=3, entities=6, months=14):
    r = random.Random(seed)
    return [row(e, n, r.choice([None, float(r.randrange(50))]), r.randrange(9), district=e % 2)
            for e in range(entities) for n in range(months) if r.random() < 0.8]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, rows()).write.parquet(path)
    return path


class Crash(Exception):
    pass


def crash_after(stage, n):
    def go(df):
        if len(stage.computed) + len(stage.reused) == n:
            raise Crash
        return stage(df)

    return go


def test_a_crashed_chain_goes_on_behind_its_last_finished_stage(spark, source, tmp_path):
    plain = table(prepare_panel(spark.read.parquet(source), SPEC), *SPEC.cell, "a", "b")
    root = str(tmp_path / "stages")
    with pytest.raises(Crash):
        with StageCatalogue(spark, "chain", root) as stage:
            prepare_panel(spark.read.parquet(source), SPEC, stage=crash_after(stage, 1))
    assert len(stage.computed) == 1 and stage.finished().count() == 1
    with StageCatalogue(spark, "chain", root) as again:
        got = prepare_panel(spark.read.parquet(source), SPEC, stage=again)
        assert again.reused == stage.computed and again.computed
        assert table(got, *SPEC.cell, "a", "b") == plain
        assert again.finished().count() == len(again.reused) + len(again.computed)
    assert not folder_exists(spark, again.root) and list_folder(spark, again.root) == []


def test_a_half_written_stage_does_not_count(spark, source, tmp_path):
    df = spark.read.parquet(source).where("a > 5")
    stage = StageCatalogue(spark, "half", str(tmp_path))
    path = f"{stage.root}/tables/x-{stage_key(df)}"
    df.limit(1).write.parquet(path)                      # a table without an entry
    assert table(stage.stage(df, "x"), "id") == table(df, "id") and stage.computed == ["x"]
    assert stage.stage(df, "x").count() == df.count() and stage.reused == ["x"]


def test_keys_follow_plan_files_and_version(spark, source):
    read = lambda: spark.read.parquet(source)
    a = stage_key(read().where("a > 5").select("id"))
    assert a == stage_key(read().where("a > 5").select("id"))
    others = [read().where("a > 6").select("id"), read().where("a > 5").select("b"),
              read().where("a > 5").select(F.col("id").alias("k"))]
    keys = {a, stage_key(read().where("a > 5").select("id"), "2"), *map(stage_key, others)}
    assert len(keys) == 5
    assert stage_key(panel(spark, rows(1))) != stage_key(panel(spark, rows(2)))
    before = input_files(read())
    panel(spark, rows(5)).write.mode("overwrite").parquet(source)
    assert input_files(read()) != before
    assert stage_key(read().where("a > 5").select("id")) != a


def test_an_outdated_stage_is_dropped(spark, source, tmp_path):
    df = spark.read.parquet(source)
    stage = StageCatalogue(spark, "old", str(tmp_path))
    stage.stage(df.where("a > 5"), "x")
    stage.stage(df, "x-y")
    stage.stage(df.where("a > 6"), "x")
    assert {(r.name, r.n_rows) for r in stage.finished().collect()} == {
        ("x", df.where("a > 6").count()), ("x-y", df.count())}
    assert len(list_folder(spark, f"{stage.root}/tables")) == 2
    stage.release()
    assert stage.finished().collect() == [] and not folder_exists(spark, stage.root)


def test_staged_tables_and_checkpoints_go_at_the_end_of_a_block(spark):
    kept = stage_path(spark, "kept")
    with staging(spark):
        staged = stage_via_parquet(spark.range(5))
        with staging(spark):
            inner = stage_path(spark, "inner")
            spark.range(2).write.parquet(inner)
        assert not folder_exists(spark, inner) and staged.count() == 5
        files = set(list_folder(spark, spark.sparkContext.getCheckpointDir()))
        assert checkpoint_stage(spark.range(7)).count() == 7
        made = set(list_folder(spark, spark.sparkContext.getCheckpointDir())) - files
        assert made
        path = staged.inputFiles()[0].rpartition("/")[0]
    assert not folder_exists(spark, path) and not any(folder_exists(spark, p) for p, *_ in made)
    assert shared_dir(spark) in kept


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_windows_on_a_bucketed_panel_need_no_exchange(spark, tmp_path):
    data = panel(spark, rows(entities=9))
    bucketed = sink_bucketed(data, SPEC, "bucketed_panel", str(tmp_path / "b"), buckets=3)
    assert "Exchange" in plan_of(lag_features(data, SPEC, ["a"]))
    got = lag_features(bucketed, SPEC, ["a"])
    assert "Exchange" not in plan_of(got)
    assert table(got, *SPEC.cell, "a_lag1", "a_lag3") == table(
        lag_features(data, SPEC, ["a"]), *SPEC.cell, "a_lag1", "a_lag3")

    def files():
        return {f"{folder}/{p}": change for folder, *_ in list_folder(spark, str(tmp_path / "b"))
                for p, _, change in list_folder(spark, folder) if "part-" in p}

    before = files()
    new = data.where(F.col("date") == F.lit(month(4))).withColumn("a", F.lit(7.0))
    replaced = overwrite_months(new, SPEC, "bucketed_panel")
    after = files()
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all(f"{MONTH}={month(4)}" in p for p in changed)
    want = data.where(F.col("date") != F.lit(month(4))).unionByName(new)
    assert table(replaced, "id", "a") == table(want, "id", "a")
    assert "Exchange" not in plan_of(lag_features(replaced, SPEC, ["a"]))
    overwrite_months(new.limit(0), SPEC, "bucketed_panel")
    assert files() == after
    spark.sql("drop table bucketed_panel")               # the files stay: another session opens them
    opened = open_bucketed(spark, SPEC, "bucketed_panel", str(tmp_path / "b"), 3)
    assert "Exchange" not in plan_of(lag_features(opened, SPEC, ["a"]))
    assert table(opened, "id", "a") == table(want, "id", "a")
    spark.sql("drop table bucketed_panel")
