"""Configurations, batches, snapshots, merges, providers and seed statements on worked cases."""

import json
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions.values import merged_variant
from tessera.operators import provider, seeding
from tessera.operators.replay import merged
from tessera.sources import configs, readers, sinks
from tessera.sources.batchlog import BatchLog

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = [{"id": 1, "name": "a: \"b\" #c\nd", "tags": ["x", "y"], "at": {"lat": 1.5, "ok": True, "none": None}}, {"id": 2, "name": "é", "tags": [], "at": {"lat": -2.0, "ok": False, "none": "z"}}]
SHAPE = "id bigint, name string, tags array<string>, at struct<lat:double,ok:boolean,none:string>"


@pytest.mark.parametrize("kind", ["yaml", "yml", "toml"])
def test_configs_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(r["id"], r["name"], r["tags"], r["at"]) for r in ROWS], SHAPE)
    sinks.write_any(df, str(tmp_path / f"out.{kind}"))
    back = readers.read_any(spark, str(tmp_path / f"out.{kind}")).select(F.from_json(F.to_json("data"), SHAPE).alias("x")).select("x.*")
    assert sorted(back.collect()) == sorted(df.collect())


def test_configs_of_others(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- 1\n- {k: v}\n---\nname: x\nwhen: 2024-05-01\n---\n")
    (tmp_path / "b.toml").write_text('title = "t"\n[owner]\nat = 1979-05-27\nrows = [1, 2]\n')
    got = [(r.place, json.loads(r.d)) for r in readers.read_any(spark, str(tmp_path / "a.yaml")).select("place", F.to_json("data").alias("d")).orderBy("place").collect()]
    assert got == [(0, [1, {"k": "v"}]), (1, {"name": "x", "when": "2024-05-01"})]
    assert json.loads(readers.read_any(spark, str(tmp_path / "*.toml")).select(F.to_json("data").alias("d")).head().d) == {"title": "t", "owner": {"at": "1979-05-27", "rows": [1, 2]}}
    with pytest.raises(ValueError):
        configs.read_config(spark, "x.ini")


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_batches_count_once(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "id bigint, note string")
    log = BatchLog(spark, str(tmp_path / "log"), df.schema, kind)
    assert log.read().count() == 0
    assert log.append(df, "b1") and not log.append(df, "b1") and log.append(df.select("note", F.col("id") + 10).toDF("note", "id"), "b2")
    again = BatchLog(spark, str(tmp_path / "log"), df.schema, kind)
    assert not again.append(df, "b2") and sorted((r.id, r.note) for r in again.read().collect()) == [(1, "a,\"b\""), (2, None), (11, "a,\"b\""), (12, None)]
    # a writer that died before its commit left files that nobody reads
    df.write.format(kind).save(str(tmp_path / "log/b3/dead"))
    assert again.read().count() == 4 and again.append(df, "b3") and again.read().count() == 6
    with pytest.raises(ValueError):
        BatchLog(spark, str(tmp_path / "log"), df.select("id").schema, kind)
    with pytest.raises(ValueError):
        log.append(df, "../x")


def test_snapshots_tell_changes(spark, tmp_path):
    tables = {"a": spark.range(1000).withColumn("x", F.col("id") % 7), "b": spark.createDataFrame([(1, None), (1, None)], "k int, v string")}
    made = {r.table_name: r.n for r in sinks.snapshot(tables, str(tmp_path / "s")).collect()}
    assert made == {"a": 1000, "b": 2}
    flags = lambda t: {r.table_name: r.changed for r in sinks.changed_tables(t, str(tmp_path / "s")).collect()}
    back = sinks.restored(spark, str(tmp_path / "s"))
    assert flags({n: df.repartition(3) for n, df in back.items()}) == {"a": False, "b": False}
    assert flags(back | {"a": back["a"].withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x")))}) == {"a": True, "b": False}
    assert flags(back | {"b": back["b"].limit(1), "c": back["a"]}) == {"a": False, "b": True, "c": True}
    spark.range(3).write.parquet(str(tmp_path / "live"))
    live = {"l": spark.read.parquet(str(tmp_path / "live"))}
    assert sinks.guarded(live, str(tmp_path / "g1"), lambda t: t["l"].count()) == 3

    def breaks(t):
        spark.range(2).write.mode("append").parquet(str(tmp_path / "live"))
        t["l"] = spark.read.parquet(str(tmp_path / "live"))

    with pytest.raises(RuntimeError, match="l"):
        sinks.guarded(live, str(tmp_path / "g2"), breaks)


VALUES = st.recursive(st.one_of(st.none(), st.integers(0, 9), st.text("ab", max_size=2), st.booleans()), lambda x: st.one_of(st.lists(x, max_size=2), st.dictionaries(st.sampled_from("abc"), x, max_size=3)), max_leaves=8)
OBJECTS = st.dictionaries(st.sampled_from("abc"), VALUES, max_size=3)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(OBJECTS, OBJECTS), min_size=30, max_size=30))
def test_merges_equal_recursive_ones(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", F.to_json(merged_variant(F.parse_json("a"), F.parse_json("b"), 6)).alias("m")).collect()
    assert {r.i: json.loads(r.m) for r in got} == {i: merged(a, b) for i, (a, b) in enumerate(pairs)}


def test_merges_at_their_bounds(spark):
    deep = '{"a":{"a":{"a":1}}}'
    df = spark.createDataFrame([(deep, deep, None)], "a string, b string, c string")
    kept = df.select(F.to_json(merged_variant(F.parse_json("a"), F.parse_json("c"))).alias("x"), F.to_json(merged_variant(F.parse_json("a"), F.parse_json("b"), 3)).alias("y")).head()
    assert json.loads(kept.x) == json.loads(kept.y) == json.loads(deep)
    with pytest.raises(Exception, match="nested deeper"):
        df.select(F.to_json(merged_variant(F.parse_json("a"), F.parse_json("b"), 2))).collect()


class Stub:
    """Fails as the prompt says: "status:times"."""

    def __init__(self):
        self.seen = {}

    def __call__(self, payload):
        text = payload["messages"][-1]["content"]
        kind, times = text.split(":")[:2]
        self.seen[text] = self.seen.get(text, 0) + 1
        if self.seen[text] <= int(times):
            raise ValueError("broken") if kind == "x" else provider.ProviderError(int(kind), f"status {kind}")
        return f"{text} by {payload['model']} at {payload['temperature']}"


def test_provider_retries(spark):
    own = provider.Settings(model="m", temperature=0.5, tries=4)
    prompts = ["429:0", "429:2", "503:3", "429:9", "401:1", "503:9", "x:9", "x:1"]
    df = spark.createDataFrame([(i, p, 0.0 if i % 2 else None) for i, p in enumerate(prompts * 3)], "i int, prompt string, temperature double")
    got = {r.i: (r.status, r.error, r.tries, r.completion) for r in provider.completed(df, Stub, settings=own, sleep=lambda _: None).collect()}
    want = {"429:0": (200, None, 1), "429:2": (200, None, 3), "503:3": (200, None, 4), "429:9": (429, provider.GAVE_UP, 4), "401:1": (401, "status 401", 1), "503:9": (503, "status 503", 4), "x:9": (500, "Unexpected error: broken", 4), "x:1": (200, None, 2)}
    assert len(got) == len(df.collect())
    for r in df.collect():
        status, error, tries = want[r.prompt]
        assert got[r.i] == (status, error, tries, f"{r.prompt} by m at 0.5" if status == 200 else "")


def test_provider_waits():
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    def never(_):
        raise provider.ProviderError(503, "busy")

    assert provider.asked(never, {}, provider.Settings(), sleep, lambda: now[0])[3] == 9 and waits == [1, 2, 4, 8, 16, 32, 64, 128], "the next wait would pass 300 seconds"
    assert provider.Settings(model="d", max_tokens=7).payload("p", "s", max_tokens=0) == {"model": "d", "temperature": 0.0, "max_tokens": 7, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}]}


def test_seed_statements(spark):
    tried = []

    def propose(case, attempt, error):
        tried.append((case, attempt, error))
        scripts = {
            "good": ["```sql\nSELECT k, v FROM seeds WHERE k = 2;\n```"],
            "late": ["SELECT nothing FROM seeds", "SELECT * FROM nowhere", "WITH x AS (SELECT k FROM seeds) SELECT max(k) AS k FROM x"],
            "empty": ["SELECT * FROM seeds WHERE k > 99"] * 3,
            "bad": ["DROP TABLE seeds", "SELECT 1; SELECT 2", "SELEC k"],
            "mute": [None],
        }
        return scripts[case][attempt - 1]

    views = {"seeds": spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")}
    got = {(r["case"], r.attempt): (r.error, r.row) for r in seeding.seed_rows(spark, views, ["good", "late", "empty", "bad", "mute"], propose).collect()}
    assert got["good", 1] == (None, '{"k":2,"v":"b"}') and ("good", 2) not in got
    assert got["late", 1][0].startswith("UNRESOLVED_COLUMN") and got["late", 2][0] == "TABLE_OR_VIEW_NOT_FOUND" and got["late", 3] == (None, '{"k":2}')
    assert [got["empty", n] for n in (1, 2, 3)] == [(seeding.NO_ROWS, None)] * 3 and len([k for k in got if k[0] == "bad"]) == 3
    assert ("late", 3, "TABLE_OR_VIEW_NOT_FOUND") in tried and not [k for k in got if k[0] == "mute"]
    assert views["seeds"].count() == 2
