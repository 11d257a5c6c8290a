import json

import pytest

from tessera.sources import readers, sinks
from tessera.streaming import ingest


def test_tools_and_rules(spark, tmp_path):
    (tmp_path / "tools.json").write_text(json.dumps({"tools": [{"name": "get", "description": "d", "input": {"user_id": {"type": "string"}, "kind": {"type": "string", "enum": ["a"]}}, "output": {"type": "object", "description": "The User"}}, {"name": "none"}]}))
    r = {x.tool: x for x in readers.read_tools(spark, str(tmp_path / "tools.json")).collect()}
    assert r["get"].inputs == ["user"] and r["get"].outputs == ["the_user"] and r["get"].param_types == {"user_id": "string", "kind": "enum"}
    assert r["none"].outputs == []
    (tmp_path / "rules.json").write_text(json.dumps({"subgoals": [{"details": "x", "category": "odd"}, {"details": "y", "category": "output_rule"}]}))
    assert [x.category for x in readers.read_rules(spark, str(tmp_path / "rules.json")).orderBy("place").collect()] == ["compliance_rule", "output_rule"]


def test_select_tasks(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert readers.select_tasks(tasks, num_tasks=1).count() == 3
    assert [r.id for r in readers.select_tasks(tasks, ["c", "a"], 1).collect()] == ["c"]
    with pytest.raises(ValueError, match="z"):
        readers.select_tasks(tasks, ["a", "z"])


def test_results(spark, tmp_path):
    sim = {"id": "s", "task_id": "1", "trial": 0, "reward": 1.0, "messages": [{"role": "user", "content": "x"}]}
    doc = {"info": {"domain": "d", "num_trials": 1}, "tasks": [{"id": "1", "actions": [{"name": "transfer_to_human", "requestor": "assistant"}]}], "simulations": [sim]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    r = readers.read_results(spark, str(tmp_path / "r.json")).head()
    assert (r.simulation_id, r.num_messages, r.info_domain, r.task_num_actions, r.task_num_agent_actions) == ("s", 1, "d", -1, -1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "id string, v string")
    sinks.write_any(df, str(tmp_path / "old.json"))
    out = sinks.merge_test_cases(spark, str(tmp_path / "old.json"), spark.createDataFrame([("1", "y"), ("2", "z")], "id string, v string"), str(tmp_path / "new.json"))
    assert {(r.id, r.v) for r in out.collect()} == {("1", "x"), ("2", "z")}
    sinks.snapshot({"t": df}, str(tmp_path / "snap"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.snapshot({"t": df}, str(tmp_path / "snap"))
    assert sinks.unchanged({"t": df}, {"t": spark.read.parquet(str(tmp_path / "snap/t.parquet"))})


def test_accumulate(spark, tmp_path):
    spark.createDataFrame([("1",), ("2",), ("1",)], "id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string").parquet(str(tmp_path / "in"))
    ingest.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
