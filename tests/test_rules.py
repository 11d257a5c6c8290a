"""Small worked cases of the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, values
from tessera.operators import combos, digest, domain, evaluate, metrics, replay, toolgraph, verify


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_pass_hat_k(spark):
    runs = spark.createDataFrame([("a", i < 3) for i in range(4)], "task string, ok boolean")
    r = metrics.pass_hat_k(runs, "task", F.col("ok"), (1, 2, 3, 4)).head()
    assert [r[f"pass_{k}"] for k in (1, 2, 3, 4)] == [0.75, 0.5, 0.25, 0.0]
    with pytest.raises(Exception, match="fewer than 5"):
        metrics.pass_hat_k(runs, "task", F.col("ok"), (5,), strict=True).collect()


def test_success_tolerance(spark):
    assert one(spark, metrics.is_success(F.lit(1.0000005))) and not one(spark, metrics.is_success(F.lit(0.99)))


def test_powerset(spark):
    rules = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "d string, o int")
    rows = {r.idx: r for r in combos.powerset(rules, "d", "o", 3).collect()}
    assert len(rows) == 8 and rows[3].mask == "011" and rows[3].members == ["b", "c"] and rows[4].members == ["a"] and rows[0].members == []


def test_types(spark):
    names = F.array(*map(F.lit, ("user_id", "flight_number", "id", "payment_id")))
    assert one(spark, toolgraph.input_types(names)) == ["flight", "payment", "user"]
    assert one(spark, toolgraph.field_name(F.lit("List of Codes"), F.lit("array"))) == "list_of_codes"
    assert one(spark, toolgraph.field_name(F.lit("x"), F.lit("string"))) == "result"


def test_text_has(spark):
    assert not one(spark, evaluate.text_has(F.lit("1,200 USD"), F.lit("1,200")))
    assert one(spark, evaluate.text_has(F.lit("1,200 USD"), F.lit("1200")))


@pytest.mark.parametrize(
    ("gold", "call", "want"),
    [({"a": "1", "b": "2"}, {"a": "1"}, True), ({"a": "1"}, {}, True), ({"a": "1"}, {"a": "1", "c": "3"}, False), ({"a": "1"}, {"a": '"1"'}, False)],
)
def test_arguments(spark, gold, call, want):
    df = spark.createDataFrame([(gold, call)], "g map<string,string>, c map<string,string>")
    assert df.select(evaluate.arguments_match(F.col("g"), F.col("c")).alias("x")).head().x is want


def test_recovery(spark):
    steps = spark.createDataFrame([(1, "A", 0, True), (1, "B", 1, True), (1, "A", 2, False), (1, "A", 3, False), (1, "B", 4, False)], "t int, tool string, pos int, e boolean")
    r = evaluate.recovery_metrics(steps, "t", "tool", ["pos"], F.col("e")).head()
    assert (r.error_count, r.recovery_count) == (2, 2)


def test_rewards(spark):
    both, db = F.array(F.lit("DB"), F.lit("COMMUNICATE")), F.array(F.lit("DB"))
    ch = {"DB": F.lit(1.0), "COMMUNICATE": F.lit(0.0), "ACTION": F.lit(0.0)}
    assert one(spark, evaluate.combine_rewards(both, ch)) == 0 and one(spark, evaluate.combine_rewards(db, ch)) == 1
    assert one(spark, evaluate.combine_rewards(db, ch, F.lit("max_steps"), F.lit(False))) == 0
    assert one(spark, evaluate.combine_rewards(both, ch, F.lit("done"), F.lit(False))) == 1


def test_cost_is_poisoned(spark):
    m = spark.createDataFrame([(1, "assistant", 0.2), (1, "user", None), (2, "assistant", 1.0), (2, "tool", None)], "c int, role string, cost double")
    r = {x.c: x for x in evaluate.conversation_cost(m, "c", "role", "cost").collect()}
    assert r[1].agent_cost is None and r[1].user_cost is None and r[2].agent_cost == 1.0 and r[2].user_cost == 0


def test_next_day(spark):
    assert one(spark, domain.next_day(F.lit("2024-05-08"), F.lit("06:00:00+1"))) == "2024-05-9"
    assert one(spark, domain.next_day(F.lit("2024-05-31"), F.lit("06:00:00+1"), compat=False)) == "2024-06-01"


def test_booking_price(spark):
    assert one(spark, domain.booking_price(F.lit(250), F.lit(2), F.lit(True), F.lit(1))) == 610


def test_device_state(spark):
    log = spark.createDataFrame([(1, 1, "wifi", True), (1, 2, "low_battery", True), (1, 3, "wifi", True)], "d int, o int, s string, v boolean")
    r = domain.device_state(log, "d", "o", "s", "v").head()
    assert (r.cellular, r.wifi, r.location, r.low_battery) == (False, False, False, True)


def test_ordering(spark):
    steps = spark.createDataFrame([(1, "b", 0), (1, "a", 1)], "c int, tool string, pos int")
    rules = spark.createDataFrame([("a", "must_be_first", None)], "tool string, kind string, depends_on string")
    assert verify.ordering_violations(steps, rules, "c", "tool", "pos").count() == 1


def test_entry_tools_fall_back_to_all(spark):
    tools = spark.createDataFrame([("a",), ("b",)], "tool string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert toolgraph.entry_tools(tools, edges).count() == 2


def test_grades(spark):
    assert one(spark, text.grade(F.lit("grade: c because"))) == 1 and one(spark, text.grade(F.lit("GRADE: P"))) is None


def test_majority_vote(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "b", 4)], "g int, c string, o int")
    assert metrics.majority_vote(v, "g", "c", "o").head().winner == "a"


def test_merge(spark):
    rows = combos.merge_new_only(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,), (2,), (2,)], "id int"), "id").collect()
    assert sorted(r.id for r in rows) == [1, 2, 2]


def test_table_digest(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (2, "x")], "k int, v string")
    same = [digest.table_digest(x, "t").head().digest for x in (a, b, a.distinct())]
    assert same[0] == same[1] != same[2]
    assert digest.table_digest(a.limit(0), "t").head().n == 0


@pytest.mark.parametrize(("e", "want"), [("2 + 2", "4.0"), ("2.675", "2.67"), ("1/0", None), ("__import__('os')", None), ("7 // 2", "3.0"), ("2 ** 3", "8.0"), ("2 ** 99999", None), ("", None)])
def test_calculate(e, want):
    assert values.calculate_text(e) == want


def test_guard():
    assert text.guard_select("```sql\nSELECT 1;\n```") == "SELECT 1"
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) DELETE FROM b"):
        with pytest.raises(ValueError):
            text.guard_select(bad)


def test_replay(spark):
    def add(state, a):
        state["n"] = state.get("n", 0) + a["k"]
        return state["n"]

    calls = spark.createDataFrame([("t", 0, "add", '{"k": 1}', "1"), ("t", 1, "nope", None, None), ("t", 2, "add", '{"k": 2}', "4")], "id string, o int, name string, arguments string, expected string")
    r = replay.replay(calls, {"add": add}, {}, ["id"], "o", check=True).head()
    assert (r.n_calls, r.n_errors, r.mismatch, r.digest) == (3, 1, 2, replay.state_digest({"n": 3}))
    assert replay.merged({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 3}, "l": []}) == {"a": {"b": 3, "c": 2}, "l": []}
    reg = replay.Registry()
    reg.register("x", 1)
    with pytest.raises(ValueError):
        reg.register("x", 2)
