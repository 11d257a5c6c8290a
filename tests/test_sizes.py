"""What one task holds stays the same as tables grow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import domain
from tessera.plans import registry
from tessera.sources import staging


def test_dealt_grows_with_rows(spark, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_A_TASK", 100)
    parts = lambda rows: staging.dealt(spark.range(rows), rows, "id").rdd.getNumPartitions()
    assert parts(10_000) == 100 and parts(20_050) == 201 and parts(500) <= 8


@pytest.mark.parametrize("name", ["argument_checks", "rebooking_delta", "rebooking_errors"])
def test_lines_are_dealt_by_order(spark, sf_dir, monkeypatch, capsys, name):
    """One exchange by order that grows with the lines serves all that goes by order."""
    monkeypatch.setattr(staging, "ROWS_A_TASK", 100)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    registry.QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert f"hashpartitioning(l_orderkey#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
    if name != "rebooking_errors":  # whose legs meet flights
        assert "ENSURE_REQUIREMENTS" not in plan, plan


def test_rebooking_keeps_prices_and_nulls(spark):
    shape = "k int, leg int, cabin string, price decimal(18,2)"
    old = spark.createDataFrame([(1, 1, "e", 100), (1, 2, "e", 50), (2, 1, None, 10), (3, 1, "e", 5), (None, 1, "e", 5), (5, 1, "e", None)], shape.replace("decimal(18,2)", "int"))
    new = spark.createDataFrame([(1, 1, "e", 130), (1, 1, "e", 140), (1, 2, "b", 80), (2, 1, None, 30), (4, 1, "e", 5), (None, 1, "e", 5), (5, 1, "e", 7)], shape.replace("decimal(18,2)", "int"))
    from pyspark.sql import functions as F

    got = {r.k: (r.now, r.was, r.delta) for r in domain.rebooking_delta(old, new, ["k"], ["leg", "cabin"], "price", F.lit(2)).collect()}
    assert got == {1: (280, 150, 260), 2: (30, 10, 40), 5: (7, None, None)}


@pytest.mark.parametrize("name", ["order_writes", "orders_after_writes", "cards_after_writes"])
def test_writes_are_dealt_by_their_rows(spark, sf_dir, monkeypatch, name):
    """Tables of rows on their way to a fold go to more tasks where they are larger; results stay."""
    from tessera.operators import retail

    asked = []
    monkeypatch.setattr(staging, "ROWS_A_TASK", 100)
    monkeypatch.setattr(retail, "dealt", lambda df, rows, *keys: asked.append((keys, rows)) or staging.dealt(df, rows, *keys))
    few = registry.QUERIES[name](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert dict(asked)[("user",)] > 3 * n and dict(asked)[("request",)] > 2 * n and dict(asked)[("item",)] > 4 * n
    monkeypatch.undo()
    assert sorted(map(repr, few.collect())) == sorted(map(repr, registry.QUERIES[name](spark, sf_dir).collect()))


def test_loose_lines_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    from tessera.plans import queries

    monkeypatch.setattr(staging, "ROWS_A_TASK", 100)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert queries._loose_tables(spark, sf_dir)["lines"].rdd.getNumPartitions() == -(-n // 100)


LEGS = "flight bigint, origin string, destination string, date string, departure string, arrival string"


def some_legs(rng, n, days, ends=("A", "B", "S")):
    """Legs between few ends at full hours, some of them landing after midnight."""
    out = []
    for _ in range(n):
        h = rng.randrange(24)
        out.append((rng.randrange(10**9), rng.choice(ends), rng.choice(ends), rng.choice(days), f"{h:02}:00", f"{(h + 5) % 24:02}:30" + "+1" * (h >= 19)))
    return out


def test_trips_take_a_fraction_of_a_byte_each(spark, tmp_path):
    rng = random.Random(4)
    legs = [(f, o, d, *rest) for o, d in (("A", "S"), ("S", "B")) for f, _, _, *rest in some_legs(rng, 2000, ["2024-05-12"])]
    domain.onestop_between(spark.createDataFrame(legs, LEGS), "A", "B").select("flight_1", "flight_2", "date_2").write.parquet(str(tmp_path / "trips"))
    rows = spark.read.parquet(str(tmp_path / "trips")).count()
    assert rows > 1_000_000 and sum(f.stat().st_size for f in (tmp_path / "trips").glob("*.parquet")) < rows / 2


@pytest.mark.parametrize("tile, pairs", [(128, 10**8), (3, 40), (1, 1)])
def test_trips_by_tiles_and_parts(spark, monkeypatch, tile, pairs):
    """Whatever tiles hold and however a stop's day is split, pairs are those of two plain loops, copies and nulls too."""
    rng = random.Random(tile)
    legs = some_legs(rng, 120, ["2024-05-08", "2024-05-09", "2024-05-9"])
    legs += legs[:20] + [(None, *x[1:]) for x in legs[:6]] + [(7, None, "S", "2024-05-08", "08:00", "09:00"), (8, "S", None, "2024-05-08", "08:00", "09:00"), (9, "A", "S", None, "08:00", "09:00"), (10, "A", "S", "2024-05-08", None, None)]
    next_day = {d: f"2024-05-{int(d[-2:].strip('-')) + 1}" for d in ("2024-05-08", "2024-05-09", "2024-05-9")}
    plain = Counter(
        a + b for a in legs for b in legs
        if None not in (a[2], a[3], a[5], b[4]) and a[2] == b[1] and b[3] == (next_day[a[3]] if "+1" in a[5] else a[3]) and b[4] >= a[5]
    )
    assert len(plain) > 100
    monkeypatch.setattr(domain, "TILE", tile)
    monkeypatch.setattr(domain, "PAIRS_A_TASK", pairs)
    df = spark.createDataFrame(legs, LEGS)
    assert Counter(map(tuple, domain.onestop_search(df).collect())) == plain
    assert Counter(map(tuple, domain.onestop_between(df, "A", "B").collect())) == Counter({x: n for x, n in plain.items() if x[1] == "A" and x[8] == "B"})
    _, seconds = domain.onestop_tiles(df, "A", "B")
    assert seconds.agg(F.max(F.size("flights"))).head()[0] <= tile


def test_trips_are_dealt_by_their_pairs(spark, monkeypatch):
    legs = [(k, o, d, "2024-05-12", "08:00", "07:30") for o, d in (("A", "S"), ("S", "B")) for k in range(60)]
    monkeypatch.setattr(domain, "TILE", 2)
    monkeypatch.setattr(domain, "PAIRS_A_TASK", 36)
    pairs = domain.onestop_between(spark.createDataFrame(legs, LEGS), "A", "B")
    held = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 3600 and pairs.rdd.getNumPartitions() == 100 and max(held) < 600, "one stop's day goes to many tasks"
