"""Worked cases of scoring, searches and lookups, and slow twins on random ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cases, domain, evaluate, metrics, toolgraph, walk
from tessera.sources import staging
from tessera.sources.catalog import declare

MESSAGES = "conv string, turn int, role string, calls array<struct<id:string,name:string>>, id string, content string"


def slow_pairs(messages):
    """(conv, turn, ordinal, call id, answer turn, error), message by message."""
    out = []
    for conv in sorted({m[0] for m in messages}):
        asked, turn, n = [], None, 0
        for m in sorted(x for x in messages if x[0] == conv):
            if m[2] != "tool":
                out += [(conv, turn, k, asked[k][0], None, "answer missing") for k in range(n, len(asked))]
                asked, turn, n = m[3] or [], m[1], 0
                continue
            call = asked[n] if n < len(asked) else None
            error = "call missing" if call is None else "id mismatch" if call[0] != m[4] else None
            out.append((conv, turn, n, call and call[0], m[1], error))
            n += 1
        out += [(conv, turn, k, asked[k][0], None, "answer missing") for k in range(n, len(asked))]
    return out


def test_calls_pair_with_answers_in_order(spark):
    rng = random.Random(6)
    messages = []
    for c in range(40):
        for k in range(rng.randrange(1, 12)):
            role = rng.choice(["tool", "tool", "tool", "assistant", "user"])
            ids = [f"{k}-{j}" for j in range(rng.randrange(4))]
            calls = None if role == "tool" or not ids and k % 2 else [(i, f"t{i}") for i in ids]
            messages.append((f"c{c:02}", k, role, calls, rng.choice(["0-0", "0-1", "1-0", "2-0", None]) if role == "tool" else None, "x"))
    got = evaluate.paired_calls(spark.createDataFrame(messages, MESSAGES), "conv", "turn", "role", "calls", "id", "content")
    rows = [(r.conv, r.turn, r.ordinal, r.call_id, r.answer_turn, r.error) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(slow_pairs(messages), key=str) and len({r[-1] for r in rows}) == 4


def test_information_by_task(spark):
    runs = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "none"), ("r4", "a")], "run string, task string")
    infos = spark.createDataFrame([("a", "1500"), ("a", "Gate B"), ("b", "yes"), ("b", "yes")], "task string, info string")
    said = spark.createDataFrame([("r1", "assistant", "It is 1,500 at gate b."), ("r2", "user", "Yes"), ("r2", "assistant", "  "), ("r4", "assistant", "1,500, yes")], "run string, role string, text string")
    checks = evaluate.communicate_checks(runs, infos, said, "run", "task", "text", "role")
    assert {(r.run, r.info): r.met for r in checks.collect()} == {("r1", "1500"): True, ("r1", "Gate B"): True, ("r2", "yes"): False, ("r4", "1500"): True, ("r4", "Gate B"): False}
    assert {r.run: r.reward for r in evaluate.communicate_rewards(runs, checks, "run").collect()} == {"r1": 1.0, "r2": 0.0, "r3": 1.0, "r4": 0.0}


def test_ends_of_runs(spark):
    rows = [("a", k, "agent", k == 2, False) for k in range(5)] + [("b", k, "user", False, True) for k in range(5)] + [("c", k, "user", k == 3, False) for k in range(5)] + [("d", 0, "user", False, True)]
    df = spark.createDataFrame(rows, "run string, turn int, speaker string, stop boolean, error boolean")
    ends = lambda **more: {r.run: (r.steps, r.reason) for r in cases.termination(df, "run", "turn", F.col("stop"), F.col("error"), 4, 2, **more).collect()}
    assert ends() == {"a": (3, "agent_stop"), "b": (4, "max_steps"), "c": (4, "max_steps"), "d": (1, None)}, "errors never count, and the limit goes before a stop"
    assert ends(compat=False)["b"] == (2, "too_many_errors")


def test_planned_trials_bound_k(spark):
    runs = spark.createDataFrame([(t, r, 3) for t, n in (("x", 5), ("y", 4)) for r in range(n)], "task string, run int, planned int")
    k = lambda r: metrics.overall(metrics.pass_hat_k(r, "task", F.col("run") == 0, trials="planned")).head().max_k
    assert k(runs) == 3 and k(runs.withColumn("planned", F.lit(9))) == 4


def test_trips_with_one_stop(spark):
    legs = spark.createDataFrame(
        [(1, "A", "S", "2024-05-08", "20:00", "23:30+1"), (2, "S", "B", "2024-05-09", "24:00", "x"), (3, "S", "B", "2024-05-9", "24:00", "x"), (4, "A", "S", "2024-05-31", "08:00", "10:00"), (5, "S", "B", "2024-05-31", "10:00", "x"), (6, "S", "C", "2024-05-31", "11:00", "x"), (7, "A", "S", "2024-05-31", "22:00", "01:00+1"), (8, "S", "B", "2024-06-01", "09:00", "x"), (9, "S", "B", "2024-05-32", "09:00", "x")],
        "flight int, origin string, destination string, date string, departure string, arrival string",
    )
    trips = lambda *a, **k: {(r.flight_1, r.flight_2) for r in domain.onestop_between(legs, *a, **k).collect()}
    assert trips("A", "B") == {(1, 3), (4, 5), (7, 9)} and trips("A", "B", compat=False) == {(1, 2), (4, 5), (7, 8)}
    assert trips("A", "B", "2024-05-31") == {(4, 5), (7, 9)} and trips("A", "C") == {(4, 6)} and trips("C", "B") == set()
    whole = {(r.flight_1, r.flight_2) for r in domain.onestop_search(legs).where("origin_1 = 'A' AND destination_2 = 'B'").collect()}
    assert whole == trips("A", "B")


def test_certificates_in_order(spark):
    asked = spark.createDataFrame([(1, "u", 5), (2, "u", 0), (3, "u", 7), (4, "u", 9), (5, "v", None), (6, "w", 1)], "request int, user string, amount int")
    used = spark.createDataFrame([("u", "c2"), ("w", "other")], "user string, id string")
    got = {r.request: (r.certificate, r.error) for r in domain.certificates(asked, used, "user", ["c1", "c2", "c3"], "request", "amount").collect()}
    assert got == {1: ("c1", None), 2: (None, "not eligible"), 3: ("c3", None), 4: (None, "too many certificates"), 5: (None, "not eligible"), 6: ("c1", None)}


def test_messages_by_contact(spark):
    contacts = spark.createDataFrame([(1, "Ann", "+1"), (2, "Bob", "+2"), (3, "Bo", "+2")], "person int, name string, phone string")
    messages = spark.createDataFrame([(1, "+1", "+2", "See you soon", 5), (2, "+2", "+1", "see you son", 6), (3, "+1", "+9", "other", 7)], "id int, sender_phone string, recipient_phone string, content string, at int")
    ids = lambda **k: sorted((r.id, r.recipient_name) for r in domain.search_messages(messages, contacts, **k).collect())
    assert ids(sender=1) == [(1, "Bo"), (1, "Bob"), (3, None)] and ids(recipient=3) == [(1, "Bo")]
    assert [i for i, _ in ids(near={"content": "SEE YOU SOON"}, between={"at": (6, None)})] == [2, 2]


def test_runs_by_id_trial_and_place(spark):
    runs = spark.createDataFrame([(10, "t", 0), (11, "t", 1), (12, "s", 0)], "run bigint, task string, trial bigint")
    asked = spark.createDataFrame([("11",), ("s-0",), ("#3",), ("#9",), ("t-7",), ("x-y-z",), (None,)], "asked string")
    assert {r.asked: r.run for r in cases.find_run(runs, asked, "run", "task", "trial").collect()} == {"11": 11, "s-0": 12, "#3": 12, "#9": None, "t-7": None, "x-y-z": None, None: None}


def test_keys_and_columns_of_rows(spark):
    c = declare({"p": ["pid INTEGER", "x TEXT"], "q": ["qid INTEGER", "qp INTEGER"]}, {"p": ["pid"], "q": ["qid"]}, [("q", "qp", "p", "pid")])
    tables = {"p": spark.createDataFrame([(1, "a"), (1, None), (2, None)], "pid int, x string"), "q": spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, None)], "qid int, qp int")}
    assert [tuple(r) for r in walk.key_matches(tables, c).collect()] == [("q", "qp", "p", "pid", 3, 2)]
    assert {(r.table_name, r.column_name): r.filled for r in walk.column_counts(tables, c).collect()} == {("p", "pid"): 3, ("p", "x"): 1, ("q", "qid"): 4, ("q", "qp"): 3}


def test_exported_nodes(spark):
    tools = spark.createDataFrame([("a", [], ["x"], [], "first"), ("b", ["x"], [], ["x_id"], "second"), ("c", [], [], [], None)], "tool string, inputs array<string>, outputs array<string>, params array<string>, description string")
    nodes = {r.tool: json.loads(r.node) for r in toolgraph.export_graph(tools, toolgraph.resource_edges(tools)).collect()}
    assert [(nodes[t]["next"], nodes[t]["entry"], nodes[t]["terminal"], nodes[t].get("description")) for t in "abc"] == [(["b"], True, False, "first"), ([], False, True, "second"), ([], True, True, None)]


def test_written_tables_can_be_cleared(spark):
    staging.clear(spark)
    df = staging.written(spark.range(5))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 5 and staging.clear(spark) == 1 and staging.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(path)


def test_shared_folder_of_clusters():
    class Context:
        applicationId = "none"

        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            @staticmethod
            def get(*_):
                return None

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("local-cluster[2,1,1024]", "spark://host:1", "yarn", None):
        with pytest.raises(ValueError, match="checkpoint"):
            staging.shared_dir(Session(master))
    assert "tessera" in staging.shared_dir(Session("local[2]")) and staging.shared_dir(Session("local"))
