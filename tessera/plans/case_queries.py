"""Building and checking of test cases on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cases, combos
from tessera.plans.queries import query, t


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN n > 2 WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN n > 4 ELSE o_custkey % 3 = 0 AND n > 2 END ELSE true END AS ok FROM (SELECT o_orderkey, o_orderstatus, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)")
def task_validity(spark, d):
    """Orders as tasks with their lines beyond two as actions; states as modes."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = t(spark, d, "orders").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mode = F.when(F.col("o_orderstatus") == "F", "gold").when(F.col("o_orderstatus") == "O", "solo").otherwise("user")
    return o.select("o_orderkey", cases.is_valid_task(mode, F.col("n") - 2, F.col("n") > 4, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0).alias("ok"))


@query("SELECT user_id, string_agg(CASE event_type WHEN 'purchase' THEN '1' ELSE '0' END, '' ORDER BY event_id) AS grades FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def grade_matrix(spark, d):
    g = t(spark, d, "events").withColumn("grade", F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0))
    return cases.grade_rows(g, "user_id", "event_id", "grade").select("user_id", F.array_join(F.transform("grades", lambda x: x.cast("string")), "").alias("grades"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pay:0:receipt' ELSE 'find:0:unknown,pay:1:receipt' END AS calls FROM orders")
def tool_call_building(spark, d):
    """Even orders have a proposed call, odd ones fall back to the sampled path."""
    one = F.array(F.struct(F.lit("pay").alias("name"), F.create_map(F.lit("k"), F.lit("v")).alias("parameters"), F.lit(None).cast("int").alias("order")))
    proposed = F.when(F.col("o_orderkey") % 2 == 0, one)
    calls = cases.tool_calls(proposed, F.array(F.lit("find"), F.lit("pay")), F.create_map(F.lit("pay"), F.lit("receipt")))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(calls, lambda c: F.concat_ws(":", c["name"], c["order"].cast("string"), c["returns"])), ",").alias("calls"))


@query("SELECT conv_id, turn, strftime(TIMESTAMP '2024-05-15 15:00:00' + INTERVAL 1 SECOND * (turn - count(*) OVER (PARTITION BY conv_id)), '%Y-%m-%d %H:%M:%S') AS ts FROM conversations")
def synthetic_timestamps(spark, d):
    m = cases.synthetic_times(t(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.lit("2024-05-15 15:00:00").cast("timestamp"))
    return m.select("conv_id", "turn", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT CAST(i AS BIGINT) AS idx FROM range(8) r(i)")
def first_batch(spark, d):
    return cases.first_batch(combos.powerset(t(spark, d, "region"), "r_name", "r_regionkey", 5), 8).select("idx")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base-' || lang ELSE lang END AS model FROM documents")
def model_names(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ft:base-"), "lang", F.lit(":org::id"))).otherwise(F.col("lang"))
    return t(spark, d, "documents").select("doc_id", cases.model_name(name).alias("model"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'zz') THEN NULL WHEN length(text) % 3 = 0 THEN 'environment' WHEN role = 'assistant' THEN 'user' ELSE 'agent' END AS next FROM conversations")
def next_speakers(spark, d):
    who = F.when(F.col("role") == "assistant", "agent").otherwise("user")
    return t(spark, d, "conversations").select("conv_id", "turn", cases.next_speaker(who, F.length("text") % 3 == 0, F.contains("text", F.lit("zz"))).alias("next"))


@query("SELECT event_id, ts, value FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-02-10')")
def time_range_search(spark, d):
    """Events between two times, as message and reminder searches ask for."""
    e = t(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts <= TIMESTAMP_NTZ '2024-02-10 00:00:00'")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "value")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0 AND contains(lower(replace(text, ',', '')), 'the')")
def text_search(spark, d):
    """Texts that are not blank and hold a word, case folded."""
    from tessera.operators.evaluate import text_has

    return t(spark, d, "documents").where(text.has_text(F.col("text")) & text_has(F.col("text"), F.lit("THE"))).select("doc_id")
