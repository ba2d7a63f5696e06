"""The block path for large entities gives what the window per entity gives."""

import random

import pytest
from pyspark.sql import functions as F

from frames import MEASURED, SPEC, panel, row, table
from paneltide import spec as spec_module
from paneltide.operators import features as X
from paneltide.operators import impute as I
from paneltide.operators import ordered as O
from paneltide.operators import sequences as S


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Keep small shuffles in all their partitions, so that rows lie in many parts."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def skewed(spark):
    """One entity holds most rows, others one to a few; a third of the values are null."""
    rng = random.Random(7)
    sizes = {1: 400, 2: 1, 3: 2, 4: 13, 5: 30, 6: 3}
    rows = [row(e, n, None if rng.random() < 0.33 else float(rng.randrange(1000)),
                rng.randrange(50), district=e % 2)
            for e, size in sizes.items() for n in range(size)]
    rng.shuffle(rows)
    return panel(spark, rows).repartition(5).cache()


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(spec_module, "MAX_ENTITY_ROWS", 50)
    monkeypatch.setattr(O, "BLOCK_ROWS", 17)
    for f in (O.into_blocks, O.with_frames, O.with_table_frames):
        monkeypatch.setattr(f, "__defaults__",
                            tuple(17 if d == 100_000 else d for d in f.__defaults__))


def compare(skewed, run, *cols):
    assert table(run(skewed, MEASURED), *cols) == table(run(skewed, SPEC), *cols)


def test_measured_limit(skewed, small_limits):
    assert MEASURED.has_hot_entity(skewed)
    assert not SPEC.has_hot_entity(skewed)


def test_not_hot_by_default(skewed):
    assert not MEASURED.has_hot_entity(skewed)


@pytest.mark.parametrize("run, cols", [
    (lambda d, s: X.lag_features(d, s, ["a", "b"]), ["a_lag1", "a_lag3", "b_lag1", "b_lag3"]),
    (lambda d, s: X.rolling_mean_features(d, s, ["a"]), ["a_roll_avg3"]),
    (lambda d, s: X.rolling_std_features(d, s, ["a"]).withColumn(
        "a_roll_std3", F.round("a_roll_std3", 6)), ["a_roll_std3"]),
    (lambda d, s: I.rolling_mean_impute(d, s, ["a"]), ["a"]),
    (lambda d, s: I.rolling_mean_smooth(d, s, ["a"]), ["a"]),
    (lambda d, s: I.forward_fill(d, s, ["a", "b"]), ["a", "b"]),
    (lambda d, s: I.backward_fill(d, s, ["a", "b"]), ["a", "b"]),
    (lambda d, s: I.fill_both(d, s, ["a", "b"]), ["a", "b"]),
])
def test_blocks_equal_entity_windows(skewed, small_limits, run, cols):
    compare(skewed, run, "subdistrict_code", "date", *cols)


@pytest.mark.parametrize("run", [
    lambda d, s: S.explode_window(S.sequence_window(d, s, ["a", "b"]), "window", ["subdistrict_code", "start"]),
    lambda d, s: S.explode_window(S.sequences_autoencode(d, s, ["a", "b"]), "window", ["subdistrict_code", "start"]),
    lambda d, s: S.explode_window(S.sequences_io(d, s, ["a", "b"]), "y", ["subdistrict_code", "start"]),
])
def test_block_sequences(skewed, small_limits, run):
    compare(skewed, run, "subdistrict_code", "start", "position", "date", "a", "b")


def test_large_entity_lies_in_many_parts(skewed):
    parts = O.sorted_parts(skewed, ["subdistrict_code", "date"])
    assert parts.where("subdistrict_code = 1").select(O.PART).distinct().count() > 4


def test_positions_follow_the_order(skewed):
    got = O.with_position(skewed, ["subdistrict_code", "date"]).orderBy(O.POS).collect()
    assert [r[O.POS] for r in got] == list(range(skewed.count()))
    keys = [(r.subdistrict_code, r.date) for r in got]
    assert keys == sorted(keys)


def test_fill_across_entities(skewed):
    rows = sorted(skewed.collect(), key=lambda r: (r.subdistrict_code, r.date))
    values, last = [r.a for r in rows], None
    filled = []
    for v in values:
        last = v if v is not None else last
        filled.append(last)
    nxt = next(v for v in values if v is not None)
    filled = [nxt if v is None else v for v in filled]
    got = table(I.fill_across_entities(skewed, SPEC, ["a"]), "subdistrict_code", "date", "a")
    assert [g[2] for g in got] == filled


def test_sequences_across_entities(skewed, small_limits):
    rows = sorted(skewed.collect(), key=lambda r: (r.subdistrict_code, r.date))
    got = S.sequences_across_entities(skewed, SPEC, ["a"]).orderBy("window_id").collect()
    assert [r.window_id for r in got] == list(range(len(rows) - 12))
    for r in got:
        i = r.window_id
        assert [m.row.a for m in r.x] == [q.a for q in rows[i:i + 12]]
        assert [m.row.a for m in r.y] == [q.a for q in rows[i + 1:i + 13]]


def test_copies_spread_over_parts(spark):
    rows = [row(1, 0, 1.0)] * 4000 + [row(2, n, 2.0) for n in range(40)]
    parts = O.sorted_parts(panel(spark, rows), ["subdistrict_code", "date"])
    sizes = [r["count"] for r in parts.groupBy(O.PART).count().collect()]
    assert sum(sizes) == 4040 and len(sizes) > 4 and max(sizes) < 1500
    filled = I.forward_fill(panel(spark, rows), MEASURED, ["a"])
    assert filled.count() == 4040


def test_null_entity_is_kept(spark, small_limits):
    rows = [row(1, n, 1.0 if n % 7 == 0 else None) for n in range(80)]
    rows += [(None, "S", 1, "D", 1, None, None, "Total", r[8], r[9], 1) for r in rows[:20]]
    df = panel(spark, rows)
    compare(df, lambda d, s: I.forward_fill(d, s, ["a"]), "subdistrict_code", "date", "a")
