"""Operators bound to the driver tables, each with DuckDB SQL for the same rows.

Doubles are rounded in both, and money is summed as decimals, so that the order
of additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import combos, digest, domain, evaluate, metrics, toolgraph, walk
from tessera.sources.catalog import DRIVER, declare
from tessera.sources.readers import driver_tables
from tessera.sources.staging import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


# -- metrics -----------------------------------------------------------------

_PASS = """
SELECT o_custkey, n, c,
  CASE WHEN n < 1 THEN NULL WHEN c < 1 THEN 0.0 ELSE CAST(c AS DOUBLE) / n END AS pass_1,
  CASE WHEN n < 2 THEN NULL WHEN c < 2 THEN 0.0 ELSE (CAST(c AS DOUBLE) * (CAST(c AS DOUBLE) - 1)) / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) - 1)) END AS pass_2,
  CASE WHEN n < 3 THEN NULL WHEN c < 3 THEN 0.0 ELSE (CAST(c AS DOUBLE) * (CAST(c AS DOUBLE) - 1) * (CAST(c AS DOUBLE) - 2)) / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) - 1) * (CAST(n AS DOUBLE) - 2)) END AS pass_3
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c FROM orders GROUP BY o_custkey)
"""


def _ok():
    return F.col("o_orderstatus") == "F"


@query(_PASS)
def pass_hat_k(spark, d):
    """Tasks are customers, their orders are runs, a finished order is a success."""
    return metrics.pass_hat_k(t(spark, d, "orders"), "o_custkey", _ok())


@query(f"SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS runs, min(n) AS max_k, round(avg(pass_1), 9) AS mean_pass_1, round(avg(pass_2), 9) AS mean_pass_2, round(avg(pass_3), 9) AS mean_pass_3 FROM ({_PASS})")
def overall_metrics(spark, d):
    return metrics.overall(pass_hat_k(spark, d))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def only_failed(spark, d):
    return metrics.only_failed(t(spark, d, "orders"), _ok()).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') = 0")
def all_failed_tasks(spark, d):
    return metrics.all_failed_tasks(t(spark, d, "orders"), "o_custkey", _ok())


@query("SELECT o_orderpriority, count(o_totalprice) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 6) AS mean_cost FROM orders GROUP BY o_orderpriority")
def cost_by_group(spark, d):
    return metrics.cost_by_group(t(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice"))


_MODES = ["O", "F", "P"]


@query("SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{m}' THEN CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END END), 6) AS rate_{m}" for m in _MODES) + ", round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS frequency FROM orders GROUP BY o_orderpriority")
def action_success_pivot(spark, d):
    """Priorities as actions, order states as modes, a large order as a success."""
    return metrics.success_pivot(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", _MODES, F.col("o_totalprice") > 150000)


@query("SELECT user_id, arg_max(event_type, (votes, -f)) AS winner, max(votes) AS votes FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def majority_vote(spark, d):
    return metrics.majority_vote(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS complete, count(*) FILTER (WHERE event_type = 'error') AS incomplete, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS invalid FROM events GROUP BY user_id")
def vote_tally(spark, d):
    grade = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0)
    return metrics.vote_tally(t(spark, d, "events"), "user_id", grade)


@query("SELECT l_orderkey, n AS calls, CASE WHEN n <= 2 THEN 'easy' WHEN n >= 4 OR p THEN 'hard' ELSE 'medium' END AS level FROM (SELECT l_orderkey, count(*) AS n, count(*) > count(DISTINCT l_linenumber) AS p FROM lineitem GROUP BY l_orderkey)")
def difficulty(spark, d):
    """Lines of an order as calls; lines of one number as parallel ones."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("l_linenumber").alias("k"))
    return g.select("l_orderkey", "calls", metrics.difficulty(F.col("calls"), F.col("calls") > F.col("k")).alias("level"))


@query("SELECT l_orderkey, CASE WHEN x THEN -1 ELSE n END AS num_actions, CASE WHEN x THEN -1 ELSE a END AS num_agent_actions, CASE WHEN x THEN -1 ELSE u END AS num_user_actions FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_linestatus <> 'O') AS u, count(*) = 1 AND max(l_returnflag) = 'R' AS x FROM lineitem GROUP BY l_orderkey)")
def task_metrics(spark, d):
    """Lines as actions, open ones of the agent; a single returned line as the transfer."""
    a = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "transfer_to_human").otherwise("act").alias("name"), F.when(F.col("l_linestatus") == "O", "assistant").otherwise("user").alias("requestor"))
    return metrics.task_metrics(a, "l_orderkey", "name", "requestor")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, CAST(arg_min(CASE WHEN value > 50 THEN event_id END, CASE WHEN value > 50 THEN event_id END) AS DOUBLE) AS large FROM events GROUP BY user_id")
def first_per_group(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") > 50, F.col("event_id")).cast("double").alias("large"))
    return metrics.first_per_group(e, "user_id", ["event_type", "large"], "event_id")


# -- trajectories ------------------------------------------------------------

@query("SELECT user_id, count(*) AS total_steps, count(*) FILTER (WHERE e) AS error_count, count(*) FILTER (WHERE NOT e AND coalesce(b, false)) AS recovery_count FROM (SELECT *, lag(e) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id) AS b FROM (SELECT user_id, ts, event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) % 10 AS tool, event_type = 'error' AS e FROM events)) GROUP BY user_id")
def recovery_metrics(spark, d):
    steps = t(spark, d, "events").withColumn("tool", F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10)
    return evaluate.recovery_metrics(steps, "user_id", "tool", ["ts", "event_id"], F.col("event_type") == "error")


@query("SELECT user_id, tool, arg_min(event_type, event_id) AS event_type FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) % 10 AS tool FROM events) WHERE event_type <> 'error' GROUP BY user_id, tool")
def first_success(spark, d):
    steps = t(spark, d, "events").withColumn("tool", F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10)
    return evaluate.first_success(steps, "user_id", "tool", "event_id", "event_type", F.col("event_type") == "error")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1 AS turn_idx FROM conversations")
def turn_index(spark, d):
    """Messages numbered by a time that has ties (their length stands for it)."""
    c = t(spark, d, "conversations").withColumn("time", F.length("text"))
    return evaluate.turn_index(c, "conv_id", "time", "turn").select("conv_id", "turn", "turn_idx")


@query("SELECT conv_id, turn AS call_turn, n AS response_turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS r, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def call_response_pairs(spark, d):
    return evaluate.call_response_pairs(t(spark, d, "conversations"), "conv_id", "turn", "role")


@query("WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, CASE WHEN role = 'user' THEN 1 END AS calls FROM conversations), b AS (SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m) SELECT conv_id, min(turn) AS turn, coalesce(max(calls), 0) AS calls, count(*) FILTER (WHERE role = 'tool') AS answers FROM b GROUP BY conv_id, k HAVING coalesce(max(calls), 0) <> count(*) FILTER (WHERE role = 'tool')")
def history_violations(spark, d):
    """Assistant turns stand for tool messages; a user turn makes one call."""
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", 1).alias("calls"))
    return evaluate.history_violations(c, "conv_id", "turn", "role", "calls")


#: What each of four tasks asks for; the last asks for nothing.
_INFOS = [(0, "The"), (0, "of,"), (1, "and"), (1, "10"), (2, "die"), (2, "The")]
_SAID = f"SELECT r.conv_id, info, coalesce(bool_or(contains(replace(lower(text), ',', ''), lower(info))), false) AS met FROM (SELECT DISTINCT conv_id, conv_id % 4 AS task FROM conversations) r JOIN {_values(_INFOS, 'task, info')} USING (task) LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant' AND length(trim(text)) > 0) c USING (conv_id) GROUP BY r.conv_id, info"


def _asked_for(spark, d):
    runs = t(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 4).alias("task")).distinct()
    infos = spark.createDataFrame(_INFOS, "task bigint, info string")
    return runs, evaluate.communicate_checks(runs, infos, t(spark, d, "conversations"), "conv_id", "task", "text", "role")


@query(_SAID)
def communicate_checks(spark, d):
    """Conversations as runs of four tasks, each with a list of its own."""
    return _asked_for(spark, d)[1]


@query(f"SELECT conv_id, CASE WHEN coalesce(bool_and(met), true) THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN ({_SAID}) USING (conv_id) GROUP BY conv_id")
def communicate_rewards(spark, d):
    runs, checks = _asked_for(spark, d)
    return evaluate.communicate_rewards(runs, checks, "conv_id")


# Messages as turns of a tool-using dialogue: turn % 4 calls each, and their answers, with a fault by the place.
_DIALOGUE = """
WITH c AS (SELECT conv_id, turn, CAST(turn % 4 AS BIGINT) AS n, (conv_id + turn) % 5 AS fault FROM conversations),
a AS (SELECT *, greatest(0, n + CASE fault WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END) AS m FROM c),
p AS (SELECT a.*, unnest(range(greatest(n, m))) AS j FROM a)
"""


@query(f"""{_DIALOGUE}
SELECT conv_id, turn * 10 AS turn, j AS ordinal, CASE WHEN j < n THEN turn || '-' || j END AS call_id, CASE WHEN j < n THEN 'tool' || j END AS name, CASE WHEN j < m THEN turn * 10 + 1 + j END AS answer_turn,
       CASE WHEN j < m THEN turn || '-' || CASE WHEN fault = 2 THEN 1 - j ELSE j END END AS answer_id, CASE WHEN j < m THEN 'answer' END AS content,
       CASE WHEN j >= n THEN 'call missing' WHEN j >= m THEN 'answer missing' WHEN fault = 2 THEN 'id mismatch' END AS error
FROM p
""")
def paired_calls(spark, d):
    """Up to three calls a message with the answers that follow; some answers are missing, too many, or of another call."""
    turn = F.col("turn")
    fault, n = (F.col("conv_id") + turn) % 5, (turn % 4).cast("int")
    m = F.greatest(F.lit(0), n + F.when(fault == 0, -1).when(fault == 1, 1).otherwise(0))
    numbers = lambda k: F.slice(F.array(*[F.lit(x) for x in range(4)]), 1, k)
    name = lambda j: F.concat_ws("-", turn.cast("string"), j.cast("string"))
    none = F.lit(None).cast("string")
    calls = F.transform(numbers(n), lambda j: F.struct(name(j).alias("id"), F.concat(F.lit("tool"), j.cast("string")).alias("name")))
    head = F.struct((turn * 10).alias("turn"), F.lit("assistant").alias("role"), F.when(n > 0, calls).alias("calls"), none.alias("id"), none.alias("content"))
    empty = F.lit(None).cast("array<struct<id:string,name:string>>")
    answers = F.transform(numbers(m), lambda j: F.struct((turn * 10 + 1 + j).alias("turn"), F.lit("tool").alias("role"), empty.alias("calls"), name(F.when(fault == 2, 1 - j).otherwise(j)).alias("id"), F.lit("answer").alias("content")))
    messages = t(spark, d, "conversations").select("conv_id", F.inline(F.concat(F.array(head), answers)))
    found = evaluate.paired_calls(messages, "conv_id", "turn", "role", "calls", "id", "content")
    return found.withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS runs, least(max(planned), min(n)) AS max_k FROM (SELECT c_nationkey, count(*) AS n, max(1 + o_orderkey % 4) AS planned FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)")
def max_k_of_trials(spark, d):
    """Nations as tasks, run far more often than the four runs that were planned at most."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("planned", 1 + F.col("o_orderkey") % 4)
    return metrics.overall(metrics.pass_hat_k(o, "c_nationkey", _ok(), trials="planned")).select("tasks", "runs", "max_k")


@query("SELECT c_custkey, o_orderstatus, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = s.o_orderstatus) AS matched FROM customer c CROSS JOIN (VALUES ('F'), ('P')) AS s(o_orderstatus)")
def action_checks(spark, d):
    """Each customer should have a finished and a pending order."""
    gold = t(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("P"))).alias("o_orderstatus"))
    calls = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return evaluate.action_checks(gold, calls, ["c_custkey", "o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = 'F' AND b.l_returnflag = a.l_returnflag) AS matched FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'O') a")
def argument_checks(spark, d):
    """Open lines as gold actions with two arguments, closed ones as calls that give the flag alone."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    lines = dealt(lines, lines.count(), "l_orderkey")  # all that follows goes by order
    gold = lines.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_returnflag").distinct().withColumn("gold", F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("line"), F.col("l_linenumber").cast("string")))
    calls = lines.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_returnflag").alias("f")).distinct().select("l_orderkey", F.create_map(F.lit("flag"), F.col("f")).alias("call"))
    return evaluate.action_checks(gold, calls, ["l_orderkey"], evaluate.arguments_match(F.col("gold"), F.col("call"))).select("l_orderkey", "l_linenumber", "l_returnflag", "matched")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN quality * (1.0 - toxic) WHEN doc_id % 3 = 1 THEN CAST(quality AS DOUBLE) ELSE 1.0 END AS reward FROM labels")
def reward_combine(spark, d):
    """Quality and absence of toxicity as channels; what a task counts differs, and some runs end early."""
    basis = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("DB"), F.lit("COMMUNICATE"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("DB"))).otherwise(F.array().cast("array<string>"))
    ended = F.when(F.col("doc_id") % 7 == 0, "max_steps").otherwise("agent_stop")
    r = evaluate.combine_rewards(basis, {"DB": F.col("quality"), "COMMUNICATE": 1 - F.col("toxic")}, ended)
    return t(spark, d, "labels").select("doc_id", r.alias("reward"))


@query("SELECT d.doc_id, CASE WHEN lang = 'en' THEN CASE WHEN coalesce(quality, 0) = 1 THEN 1.0::DOUBLE ELSE 0.0 END END AS db_success, CASE WHEN lang IN ('en', 'fr') THEN CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0 END END AS communicate_success FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def reward_breakdown(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    basis = F.when(F.col("lang") == "en", F.array(F.lit("DB"), F.lit("COMMUNICATE"))).when(F.col("lang") == "fr", F.array(F.lit("COMMUNICATE"))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", evaluate.channel_success(basis, "DB", F.col("quality")).cast("double").alias("db_success"), evaluate.channel_success(basis, "COMMUNICATE", F.col("toxic")).cast("double").alias("communicate_success"))


@query("SELECT conv_id, CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN cost END), 0) AS DOUBLE) END AS agent_cost, CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE CAST(coalesce(sum(CASE WHEN role = 'user' THEN cost END), 0) AS DOUBLE) END AS user_cost FROM (SELECT conv_id, role, CASE WHEN role <> 'system' THEN length(text) END AS cost FROM conversations) GROUP BY conv_id")
def conversation_cost(spark, d):
    """Text lengths as costs; system turns have none, which voids their conversation's."""
    c = t(spark, d, "conversations").withColumn("cost", F.when(F.col("role") != "system", F.length("text").cast("double")))
    return evaluate.conversation_cost(c, "conv_id", "role", "cost")


@query("SELECT conv_id, CAST(coalesce(sum(CASE WHEN role <> 'system' THEN length(text) END), 0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_usage(spark, d):
    c = t(spark, d, "conversations").withColumn("usage", F.when(F.col("role") != "system", F.length("text").cast("bigint")))
    return evaluate.token_usage(c, "conv_id", "usage")


@query("SELECT conv_id, sha256(string_agg(role || ': ' || coalesce(text, 'None'), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    return evaluate.transcript(t(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.sha2(F.col("transcript").cast("binary"), 256).alias("digest"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END AS role FROM conversations")
def flipped_roles(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", evaluate.flip_roles(F.col("role")).alias("role"))


# -- identity, merges --------------------------------------------------------

_DIGEST_T = ("region", "nation", "part")


def _digest_sql(name: str, cols: list[str]) -> str:
    row = " || '|' || ".join(f"'{c}=' || coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in sorted(cols))
    parts = ", ".join(f"CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)::HUGEINT AS p{i}" for i in range(4))
    sums = ", ".join(f"sum(p{i}) AS s{i}" for i in range(4))
    line = "b || ':' || CAST(k AS VARCHAR)" + "".join(f" || ':' || CAST(s{i} AS VARCHAR)" for i in range(4))
    return f"SELECT '{name}' AS table_name, CAST(sum(k) AS BIGINT) AS n, sha256(string_agg({line}, ',' ORDER BY {line})) AS digest FROM (SELECT b, count(*) AS k, {sums} FROM (SELECT substr(h, 1, 2) AS b, {parts} FROM (SELECT sha256({row}) AS h FROM {name})) GROUP BY b)"


_DIGEST_COLS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]}


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _DIGEST_COLS.items()))
def table_digest(spark, d):
    out = None
    for n, c in _DIGEST_COLS.items():
        one = digest.table_digest(t(spark, d, n).select(*c), n)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_mktsegment AS left_value, b.seg AS right_value FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 4 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_mktsegment IS DISTINCT FROM b.seg")
def table_differences(spark, d):
    """Two states of the customers' segments."""
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    a = c.where("c_custkey % 5 <> 0")
    b = c.where("c_custkey % 4 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "X").otherwise(F.col("c_mktsegment")))
    return digest.differences(a, b, "c_custkey", "c_mktsegment")


@query("SELECT c_custkey, left(sha256(CAST(c_custkey AS VARCHAR)), 8) AS id FROM customer")
def short_ids(spark, d):
    return t(spark, d, "customer").select("c_custkey", digest.short_id(F.col("c_custkey")).alias("id"))


@query("SELECT o_orderkey, o_custkey, 'old' AS batch FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def merge_new_only(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return combos.merge_new_only(o.where("o_orderkey % 2 = 0").withColumn("batch", F.lit("old")), o.where("o_orderkey % 3 = 0").withColumn("batch", F.lit("new")), "o_orderkey")


@query("SELECT c_custkey AS task, trial, seed FROM customer CROSS JOIN (VALUES (0, 17), (1, 23), (2, 42)) AS v(trial, seed) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = trial)")
def pending_runs(spark, d):
    """Every customer with three trials, less those that an order stands for."""
    wanted = combos.expand_trials(t(spark, d, "customer").select(F.col("c_custkey").alias("task")), spark.createDataFrame([(0, 17), (1, 23), (2, 42)], "trial int, seed int"))
    done = t(spark, d, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 3).cast("int").alias("trial"))
    return combos.pending_runs(wanted, done, ["task", "trial"])


# -- catalog and walks -------------------------------------------------------

_TABLES = list(DRIVER.tables)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _TABLES))
def table_counts(spark, d):
    return walk.table_counts(driver_tables(spark, d, _TABLES))


_FREE = [n for n in _TABLES if not DRIVER.tables[n].foreign_keys]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _FREE) + ") WHERE n <= 50")
def reference_tables(spark, d):
    return walk.reference_tables(table_counts(spark, d), DRIVER.key_frame(spark))


_COLUMNS = [(n, i, c.name, c.type, c.pk) for n, x in DRIVER.tables.items() for i, c in enumerate(x.columns)]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, " + " || '; ' || ".join(f"'{c.name} {c.type}{' (PK)' if c.pk else ''}: ' || count({c.name})" for c in x.columns) + f" AS summary FROM {n}" for n, x in DRIVER.tables.items()))
def schema_summary(spark, d):
    """Each table's columns with their types, keys and how many rows fill them."""
    filled = walk.column_counts(driver_tables(spark, d, _TABLES), DRIVER)
    c = DRIVER.column_frame(spark).join(filled, ["table_name", "column_name"])
    line = F.concat("column_name", F.lit(" "), "type", F.when(F.col("pk"), " (PK)").otherwise(""), F.lit(": "), F.col("filled").cast("string"))
    return c.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "; ").alias("summary"))


_KEYS = [(k.from_table, k.from_column, k.to_table, k.to_column) for k in DRIVER.foreign_keys]
_KEYS_SQL = _values(_KEYS, "from_table, from_column, to_table, to_column")
def _matches(spark, d) -> DataFrame:
    return walk.key_matches(driver_tables(spark, d, _TABLES), DRIVER)


_FOUND_SQL = "(" + " UNION ALL ".join(f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{k}' AS to_column, count({b}) AS n, count(p) AS matched FROM {a} LEFT JOIN (SELECT DISTINCT {k} AS p FROM {c}) ON {b} = p" for a, b, c, k in _KEYS) + ")"


@query(f"SELECT from_table, from_table || '.' || from_column || ' references ' || to_table || '.' || to_column AS sentence, n AS rows, matched FROM {_FOUND_SQL}")
def relationship_annotations(spark, d):
    """A sentence for each foreign key, with how many rows have a value and how many find their parent."""
    return _matches(spark, d).select("from_table", F.format_string("%s.%s references %s.%s", "from_table", "from_column", "to_table", "to_column").alias("sentence"), "rows", "matched")


@query(f"SELECT to_table AS table_name, count(*) AS incoming, CAST(sum(matched) AS BIGINT) AS rows FROM {_FOUND_SQL} GROUP BY to_table")
def fk_centrality(spark, d):
    """Keys that point to each table, and the rows that do."""
    return _matches(spark, d).groupBy(F.col("to_table").alias("table_name")).agg(F.count(F.lit(1)).alias("incoming"), F.sum("matched").alias("rows"))


_COUNTS_SQL = "(" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _TABLES) + ")"


@query("WITH RECURSIVE k AS (SELECT * FROM " + _FOUND_SQL + " WHERE matched > 0), e AS (SELECT from_table AS a, to_table AS b FROM k UNION SELECT to_table, from_table FROM k), n AS (SELECT * FROM " + _COUNTS_SQL + "), r AS (SELECT table_name AS a, table_name AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS table_name, min(b) AS component FROM r GROUP BY a) SELECT table_name, component, CAST(sum(n) OVER (PARTITION BY component) AS BIGINT) AS rows FROM c JOIN n USING (table_name)")
def fk_components(spark, d):
    """Tables that keys with matching rows tie together, and the rows of each such group."""
    edges = _matches(spark, d).where("matched > 0").select(F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    found = walk.components(edges, DRIVER.table_frame(spark).select(F.col("table_name").alias("node"))).withColumnRenamed("node", "table_name")
    counted = found.join(table_counts(spark, d), "table_name")
    return counted.join(counted.groupBy("component").agg(F.sum("n").alias("rows")), "component").select("table_name", "component", "rows")


@query("""
WITH x AS (SELECT 'c' || c_custkey AS node, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey
           UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)
SELECT node, min(node) OVER (PARTITION BY g) AS component FROM x
""")
def row_components(spark, d):
    """Customers, nations and regions as nodes that keys tie together: a component for each region."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = t(spark, d, "customer").select(name("c", "c_custkey").alias("a"), name("n", "c_nationkey").alias("b"))
    n = t(spark, d, "nation").select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b"))
    nodes = c.select(F.col("a").alias("node")).unionByName(n.select(F.col("a").alias("node"))).unionByName(t(spark, d, "region").select(name("r", "r_regionkey").alias("node")))
    return walk.components(c.unionByName(n), nodes)


@query(f"SELECT table_name, shared, n FROM (SELECT table_name, count(*) AS shared FROM {_values(_COLUMNS, 'table_name, ord, column_name, type, pk')} WHERE column_name IN ('doc_id', 'text', 'lang', 'quality') GROUP BY table_name ORDER BY count(*) DESC, min(CASE table_name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_TABLES)) + f" END) LIMIT 1) JOIN {_COUNTS_SQL} USING (table_name)")
def seed_table_of(spark, d):
    """The table that a query's result comes from, by its columns, with its rows."""
    result = t(spark, d, "documents").select("doc_id", "text", "lang").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    c = DRIVER.column_frame(spark).join(DRIVER.table_frame(spark).select("table_name", F.col("ord").alias("table_ord")), "table_name")
    return walk.seed_table_of(c, result.columns).join(table_counts(spark, d), "table_name")


def _walked(spark, d, mode="compat", seed=1):
    names = [n for n in _TABLES if n not in ("events", "pages", "conversations", "benchmark")]
    tables = driver_tables(spark, d, names)
    return walk.walk(tables, DRIVER, "customer", tables["customer"].where(F.col("c_custkey") == seed), mode), tables


def _keys_of(result):
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    out = None
    for n, k in keys.items():
        if n in result:
            one = result[n].groupBy(F.col(k).cast("bigint").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "key", "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH seed AS (SELECT * FROM customer WHERE c_custkey = 1),
n1 AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM seed)),
o AS (SELECT * FROM orders WHERE o_custkey = 1),
-- batch of the nation: its region, its customers, its suppliers
r1 AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n1)),
c1 AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n1) OR c_custkey = 1),
s1 AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n1)),
-- batch of the orders: their lines; those of the first order make the lines' batch
l1 AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
lb AS (SELECT * FROM lineitem WHERE l_orderkey = (SELECT min(o_orderkey) FROM o)),
-- batch of the region: all of its nations (added, not followed)
n2 AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r1)),
-- batch of the suppliers: their lines (added, not followed)
l2 AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM s1)),
-- batch of the lines: suppliers, parts and orders of those lines
s2 AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lb)),
p1 AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lb)),
-- batch of the parts (the first line's part): lines of that part
fl AS (SELECT * FROM lb ORDER BY l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax LIMIT 1),
l3 AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM fl)),
lines AS (SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3)
SELECT 'region' AS table_name, CAST(r_regionkey AS BIGINT) AS key, 1 AS n FROM r1
UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), 1 FROM (SELECT * FROM n1 UNION SELECT * FROM n2)
UNION ALL SELECT 'customer', c_custkey, 1 FROM c1
UNION ALL SELECT 'supplier', s_suppkey, 1 FROM (SELECT * FROM s1 UNION SELECT * FROM s2)
UNION ALL SELECT 'part', p_partkey, 1 FROM p1
UNION ALL SELECT 'orders', o_orderkey, 1 FROM o
UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lines GROUP BY l_orderkey
""")
def fk_walk_customer(spark, d):
    return _keys_of(_walked(spark, d)[0])


@query("""
SELECT 'c_custkey' AS column_name, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey IS NOT NULL
UNION SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey IS NOT NULL
UNION SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey IS NOT NULL
UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL
""")
def value_index(spark, d):
    """Key values of customers and orders."""
    return walk.value_index(driver_tables(spark, d, ["customer", "orders"]), DRIVER)


#: Orders and lines tied to nobody by declared keys, suppliers by columns of one name only.
_LOOSE = declare(
    {"nation": ["nationkey INTEGER"], "customer": ["custkey INTEGER", "nationkey INTEGER"], "supplier": ["suppkey INTEGER", "nationkey INTEGER"], "orders": ["orderkey INTEGER", "custkey INTEGER"], "lines": ["orderkey INTEGER", "linenumber INTEGER", "suppkey INTEGER"]},
    {"nation": ["nationkey"], "customer": ["custkey"], "supplier": ["suppkey"], "orders": ["orderkey"]},
    [("customer", "nationkey", "nation", "nationkey"), ("supplier", "nationkey", "nation", "nationkey"), ("lines", "suppkey", "supplier", "suppkey"), ("lines", "orderkey", "orders", "orderkey")],
)


def _loose_tables(spark, d):
    """The driver's tables under the names that _LOOSE gives their columns."""
    out = {}
    for name, own in _LOOSE.tables.items():
        df = t(spark, d, "lineitem" if name == "lines" else name)
        rows = df.select(*[F.col(c).cast("bigint").alias(c.split("_", 1)[1]) for c in df.columns if c.split("_", 1)[1] in {x.name for x in own.columns}])
        out[name] = dealt(rows, df.count(), *rows.columns).distinct()
    return out


@query("""
WITH s0 AS (SELECT * FROM supplier WHERE s_nationkey = 3),
l AS (SELECT DISTINCT l_linenumber, l_orderkey, l_suppkey FROM lineitem),
l1 AS (SELECT * FROM l WHERE l_suppkey IN (SELECT s_suppkey FROM s0)),
lb AS (SELECT * FROM l WHERE l_suppkey = (SELECT min(s_suppkey) FROM s0)),
o1 AS (SELECT l_orderkey FROM lb),
l2 AS (SELECT * FROM l WHERE l_orderkey = (SELECT l_orderkey FROM lb ORDER BY ALL LIMIT 1)),
o2 AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l1 UNION SELECT l_orderkey FROM l2 UNION SELECT l_orderkey FROM o1)),
l3 AS (SELECT * FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o2)),
s1 AS (SELECT s_suppkey FROM s0 UNION SELECT l_suppkey FROM l3)
SELECT 'nation' AS table_name, CAST(3 AS BIGINT) AS key, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'customer', c_custkey, 1 FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'supplier', s_suppkey, 1 FROM s1
UNION ALL SELECT 'orders', o_orderkey, 1 FROM o2
UNION ALL SELECT 'lines', l_orderkey, count(*) FROM l3 GROUP BY l_orderkey
""")
def resolve_disconnected(spark, d):
    """Suppliers and orders found by the names and values of keys. What they lead to in visited tables is added and not followed: no customers of other nations."""
    tables = _loose_tables(spark, d)
    first = walk.walk({n: tables[n] for n in ("nation", "customer")}, _LOOSE, "nation", tables["nation"].where("nationkey = 3"))
    found = walk.resolve_disconnected(first, tables, _LOOSE)
    keys = {"nation": "nationkey", "customer": "custkey", "supplier": "suppkey", "orders": "orderkey", "lines": "orderkey"}
    parts = [found[n].groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "key", "n") for n, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 25")
def seeded_sample(spark, d):
    return walk.seeded_sample(t(spark, d, "customer"), "c_custkey", 25, 42).select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS order_sum FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def nested_entity(spark, d):
    """Customers with an array of their orders, told by its size and sum."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    n = domain.nested(t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "orders", ["o_orderkey", "o_orderstatus"])
    return n.select("c_custkey", F.coalesce(F.array_size("orders"), F.lit(0)).cast("bigint").alias("orders"), F.coalesce(F.aggregate("orders", F.lit(0).cast("bigint"), lambda a, x: a + x["o_orderkey"]), F.lit(0)).alias("order_sum"))


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n in ("customer", "orders", "lineitem")))
def db_stats(spark, d):
    c = table_counts(spark, d).where(F.col("table_name").isin("customer", "orders", "lineitem"))
    return c.agg(*[F.max(F.when(F.col("table_name") == n, F.col("n"))).alias(n) for n in ("customer", "orders", "lineitem")])


# -- tool graphs -------------------------------------------------------------

def _tools(spark, d) -> DataFrame:
    """A tool for each brand of parts: it takes the kind of its first part, and gives the kind of its last one (every seventh gives nothing)."""
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    each = t(spark, d, "part").groupBy("p_brand").agg(F.min_by(word(1), "p_partkey").alias("a"), F.min_by(word(0), "p_partkey").alias("b"), F.max_by(word(1), "p_partkey").alias("c"))
    raw = each.select(F.concat(F.lit("brand_"), number.cast("string")).alias("tool"), F.array(F.concat("a", F.lit("_id")), F.concat("b", F.lit("_note"))).alias("params"), F.when(number % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.initcap("c"))).alias("outputs"))
    return raw.withColumn("inputs", toolgraph.input_types(F.col("params")))


_TOOL_SQL = """tools AS (
  SELECT 'brand_' || n AS tool, [a || '_id', b || '_note'] AS params, CASE WHEN n % 7 = 0 THEN []::VARCHAR[] ELSE [c] END AS outputs
  FROM (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS n, arg_min(split_part(p_name, ' ', 2), p_partkey) AS a, arg_min(split_part(p_name, ' ', 1), p_partkey) AS b, arg_max(split_part(p_name, ' ', 2), p_partkey) AS c FROM part GROUP BY p_brand))"""
_EDGE_SQL = f"{_TOOL_SQL}, o AS (SELECT DISTINCT tool AS src, lower(unnest(outputs)) AS t FROM tools), p AS (SELECT tool, unnest(params) AS p FROM tools), i AS (SELECT DISTINCT tool AS dst, lower(regexp_replace(p, '_(id|number)$', '')) AS t FROM p WHERE regexp_matches(p, '_(id|number)$')), edges AS (SELECT src, dst, string_agg(t, ',' ORDER BY t) AS matching FROM o JOIN i USING (t) WHERE src <> dst GROUP BY src, dst)"
#: Tools that no edge leads to, or from; all where there is none.
_ENDS_SQL = "firsts AS (SELECT tool FROM tools WHERE tool NOT IN (SELECT dst FROM edges) OR NOT EXISTS (SELECT 1 FROM tools t2 WHERE t2.tool NOT IN (SELECT dst FROM edges))), lasts AS (SELECT tool FROM tools WHERE tool NOT IN (SELECT src FROM edges) OR NOT EXISTS (SELECT 1 FROM tools t2 WHERE t2.tool NOT IN (SELECT src FROM edges)))"
_PROPOSED_SQL = "(SELECT 'brand_' || (s_suppkey % 26 + 1) AS src, 'brand_' || (s_suppkey * 7 % 25 + 1) AS dst FROM supplier) v"


def _brand(number) -> Column:
    return F.concat(F.lit("brand_"), number.cast("string"))


def _proposed(spark, d) -> DataFrame:
    """Edges that suppliers propose: repeated ones, loops and unknown tools among them."""
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select(_brand(k % 26 + 1).alias("src"), _brand(k * 7 % 25 + 1).alias("dst"))


@query(f"WITH {_EDGE_SQL} SELECT src, dst, matching FROM edges")
def resource_edges(spark, d):
    return toolgraph.resource_edges(_tools(spark, d)).withColumn("matching", F.array_join("matching", ","))


@query(f"WITH {_TOOL_SQL} SELECT a.tool AS src, b.tool AS dst FROM tools a, tools b WHERE a.tool <> b.tool")
def temporal_edges(spark, d):
    return toolgraph.temporal_edges(_tools(spark, d))


@query(f"WITH {_TOOL_SQL}, p AS (SELECT DISTINCT tool, unnest(params) AS p FROM tools) SELECT a.tool AS tool_a, b.tool AS tool_b, count(*) AS shared FROM p a JOIN p b USING (p) WHERE a.tool < b.tool GROUP BY 1, 2")
def parallel_candidates(spark, d):
    return toolgraph.parallel_candidates(_tools(spark, d))


@query(f"WITH {_EDGE_SQL} SELECT DISTINCT src, dst FROM {_PROPOSED_SQL} WHERE src <> dst AND src IN (SELECT tool FROM tools) AND dst IN (SELECT tool FROM tools) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = v.src AND e.dst = v.dst)")
def enrich_edges(spark, d):
    tools = _tools(spark, d)
    return toolgraph.enrich_edges(toolgraph.resource_edges(tools), _proposed(spark, d), tools).select("src", "dst")


@query(f"WITH {_EDGE_SQL}, {_ENDS_SQL} SELECT tool FROM firsts")
def entry_tools(spark, d):
    tools = _tools(spark, d)
    return toolgraph.entry_tools(tools, toolgraph.resource_edges(tools))


@query(f"WITH {_EDGE_SQL}, {_ENDS_SQL} SELECT tool FROM lasts")
def terminal_tools(spark, d):
    tools = _tools(spark, d)
    return toolgraph.terminal_tools(tools, toolgraph.resource_edges(tools))


_CHAIN_SQL = f"WITH RECURSIVE {_EDGE_SQL}, c AS (SELECT [tool] AS path FROM tools UNION ALL SELECT list_append(path, dst) FROM c JOIN edges ON src = path[len(path)] WHERE NOT list_contains(path, dst) AND len(path) < 4)"


@query(f"{_CHAIN_SQL} SELECT array_to_string(path, '>') AS chain FROM c WHERE len(path) > 1")
def enumerate_chains(spark, d):
    tools = _tools(spark, d)
    return toolgraph.enumerate_chains(tools, toolgraph.resource_edges(tools), 4).select(F.array_join("path", ">").alias("chain"))


@query(f"{_CHAIN_SQL}, chains AS (SELECT path FROM c WHERE len(path) > 1) SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM chains)) AS used_tools, (SELECT count(*) FROM tools) AS all_tools, (SELECT count(*) FROM chains) AS paths, (SELECT round(avg(len(path)), 6) FROM chains) AS avg_length, (SELECT max(len(path)) FROM chains) AS max_length, round((SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM chains)) / (SELECT CAST(count(*) AS DOUBLE) FROM tools) * 100, 6) AS coverage")
def coverage_stats(spark, d):
    tools = _tools(spark, d)
    return toolgraph.coverage_stats(toolgraph.enumerate_chains(tools, toolgraph.resource_edges(tools), 4), tools)


@query(f"{_CHAIN_SQL}, chains AS (SELECT path FROM c WHERE len(path) > 1) SELECT tool FROM tools WHERE tool NOT IN (SELECT unnest(path) FROM chains)")
def unused_tools(spark, d):
    tools = _tools(spark, d)
    return toolgraph.unused_tools(toolgraph.enumerate_chains(tools, toolgraph.resource_edges(tools), 4), tools)


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'read' ELSE 'write' END AS kind, count(DISTINCT event_type) AS tools FROM events GROUP BY 1")
def tool_type_counts(spark, d):
    e = t(spark, d, "events").withColumn("kind", F.when(F.col("user_id") % 2 == 0, "read").otherwise("write"))
    return e.groupBy("kind").agg(F.count_distinct("event_type").alias("tools"))


# -- combinations ------------------------------------------------------------

@query("WITH m AS (SELECT list(r_name ORDER BY r_regionkey) AS a FROM region) SELECT CAST(i AS BIGINT) AS idx, lpad(ltrim(bin(i), '0'), 5, '0') AS mask, coalesce(array_to_string(list_filter(a, lambda x, j: (i >> (5 - j)) & 1 = 1), ','), '') AS members FROM m, range(32) r(i)")
def powerset(spark, d):
    return combos.powerset(t(spark, d, "region"), "r_name", "r_regionkey", 5).withColumn("members", F.array_join("members", ","))


@query("WITH m AS (SELECT list(r_name ORDER BY r_regionkey) AS a FROM region), s AS (SELECT i, list_filter(a, lambda x, j: (i >> (5 - j)) & 1 = 1) AS x FROM m, range(32) r(i)) SELECT CAST(i AS BIGINT) AS idx FROM s WHERE len(x) <= 1 OR NOT (len(x) = 2 AND list_contains(x, 'ASIA') AND list_contains(x, 'EUROPE'))")
def conflict_filter(spark, d):
    verdicts = spark.createDataFrame([(["EUROPE", "ASIA"], False), (["AFRICA"], False), (["AFRICA", "ASIA"], True)], "members array<string>, valid boolean")
    return combos.drop_conflicts(combos.powerset(t(spark, d, "region"), "r_name", "r_regionkey", 5), verdicts).select("idx")


@query("SELECT 'SG' || CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS id, n_name FROM nation")
def numbered_ids(spark, d):
    return combos.numbered(t(spark, d, "nation"), "n_nationkey").select("id", "n_name")


@query("SELECT o_orderkey, coalesce(array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x))), ','), '') AS missing FROM (SELECT o_orderkey, coalesce(list(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL), []) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def missing_subgoals(spark, d):
    """Return flags that no line of an order covers."""
    got = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("f"))
    o = t(spark, d, "orders").select("o_orderkey").join(got, "o_orderkey", "left")
    return o.select("o_orderkey", F.array_join(combos.missing_subgoals(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.coalesce("f", F.array().cast("array<string>"))), ",").alias("missing"))


@query("SELECT p_partkey, coalesce(n, 'none') AS supplier_name FROM part LEFT JOIN (SELECT s_suppkey, s_name AS n FROM supplier) ON s_suppkey = p_partkey")
def enrichment_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.lit(None).cast("string").alias("supplier_name"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("supplier_name"))
    return combos.enrich(p, s, "p_partkey", {"supplier_name": F.lit("none")})
