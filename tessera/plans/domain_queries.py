"""Verification, domain tools and functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, values
from tessera.operators import combos, domain, replay, toolgraph, verify
from tessera.plans.queries import _EDGE_SQL, _tools, _values, query, t
from tessera.sources.staging import dealt

# -- chains ------------------------------------------------------------------

_RULES = [("signup", "must_be_first", None), ("click", "must_follow", "view"), ("purchase", "requires_predecessor", "signup"), ("error", "conflicts_with", "purchase"), ("view", "must_be_last", None)]
_STEPS_SQL = "steps AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


def _steps(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "events").select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("pos"))


@query(f"""
WITH {_STEPS_SQL}, last AS (SELECT user_id, event_type, max(pos) AS place, count(*) AS n FROM steps GROUP BY 1, 2), ends AS (SELECT user_id, max(pos) AS e FROM steps GROUP BY 1)
SELECT l.user_id, l.event_type, kind, depends_on, n FROM last l JOIN {_values(_RULES, 'tool, kind, depends_on')} ON tool = l.event_type JOIN ends USING (user_id)
LEFT JOIN (SELECT user_id, event_type AS other, place AS o FROM last) x ON x.user_id = l.user_id AND x.other = depends_on
WHERE CASE kind WHEN 'must_be_first' THEN place <> 0 WHEN 'must_be_last' THEN place <> e WHEN 'conflicts_with' THEN o IS NOT NULL ELSE o IS NULL OR o >= place END
""")
def ordering_violations(spark, d):
    """Users' events as chains of tools."""
    rules = spark.createDataFrame(_RULES, "tool string, kind string, depends_on string")
    return verify.ordering_violations(_steps(spark, d), rules, "user_id", "event_type", "pos")


_EVENT_TOOLS = [("view", ["page"], ["item"]), ("click", ["item"], ["cart"]), ("purchase", ["cart"], ["receipt"]), ("signup", ["page"], ["user"]), ("error", [], ["log"])]


@query("WITH " + _STEPS_SQL + ", tools AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b or '[]::VARCHAR[]'}, {c})" for a, b, c in _EVENT_TOOLS) + ") AS v(tool, inputs, outputs)), pairs AS (SELECT user_id, pos, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS dst FROM steps) SELECT user_id, pos, src, dst FROM pairs JOIN tools a ON a.tool = src JOIN tools b ON b.tool = dst WHERE len(a.outputs) > 0 AND len(b.inputs) > 0 AND NOT list_has_any(a.outputs, b.inputs) AND NOT (src = 'signup' AND dst = 'view')")
def dataflow_warnings(spark, d):
    tools = spark.createDataFrame(_EVENT_TOOLS, "tool string, inputs array<string>, outputs array<string>")
    edges = spark.createDataFrame([("signup", "view")], "src string, dst string")
    return verify.dataflow_warnings(_steps(spark, d), tools, edges, "user_id", "event_type", "pos")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT CASE WHEN l_linenumber = 3 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey)")
def ungrounded_params(spark, d):
    """Order keys of lines, a third of them made up."""
    p = t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 3, F.col("l_orderkey") + 1000000000).otherwise(F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey")
    return verify.ungrounded_params(p, "l_orderkey", t(spark, d, "orders"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


_ERRORS = "CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Flight ' || event_id || ' not found' WHEN 1 THEN 'missing 2 required positional argument' WHEN 2 THEN 'not enough seats' ELSE 'FIELD REQUIRED here' END ELSE 'done' END"
_GROUND = r"(?i)not found|missing \d+ required positional argument|missing required positional argument|Field required|validation error|invalid literal|unexpected keyword argument|takes \d+ positional arguments? but \d+ (?:was|were) given|Invalid characters"


def _error_text():
    e, k = F.col("event_type"), F.col("event_id") % 4
    return F.when(e == "error", F.when(k == 0, F.concat(F.lit("Flight "), F.col("event_id").cast("string"), F.lit(" not found"))).when(k == 1, "missing 2 required positional argument").when(k == 2, "not enough seats").otherwise("FIELD REQUIRED here")).otherwise("done")


@query(f"SELECT event_id, regexp_matches({_ERRORS}, '{_GROUND}') AS grounding FROM events")
def grounding_errors(spark, d):
    return t(spark, d, "events").select("event_id", text.is_grounding_error(_error_text()).alias("grounding"))


@query(f"SELECT user_id, min(event_id) AS stopped_at FROM events WHERE regexp_matches({_ERRORS}, '{_GROUND}') GROUP BY user_id")
def first_grounding_error(spark, d):
    return verify.first_grounding_error(t(spark, d, "events"), "user_id", "event_id", text.is_grounding_error(_error_text()))


@query("SELECT user_id, bool_and(event_type <> 'error') AS is_valid FROM events GROUP BY user_id")
def validity_fold(spark, d):
    e = t(spark, d, "events").withColumn("severity", F.when(F.col("event_type") == "error", "error").otherwise("warning"))
    return verify.is_valid(e, "user_id", "severity")


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def fenced_json(spark, d):
    """Properties as a model would answer with them: fenced for even ids, bare for odd ones."""
    e = t(spark, d, "events").withColumn("answer", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone"))).otherwise(F.col("props")))
    return e.select("event_id", F.from_json(text.fenced(F.col("answer")), "k bigint")["k"].alias("k"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 END AS grade FROM documents")
def grade_extraction(spark, d):
    k = F.col("doc_id") % 5
    answer = F.when(k == 0, "reason\nGRADE: C because").when(k == 1, "grade : i").when(k == 2, "GRADE: P").when(k == 3, "no grade").otherwise("GRADE: X")
    return t(spark, d, "documents").select("doc_id", text.grade(answer).cast("double").alias("grade"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'fixed' WHEN 2 THEN 'rejected' ELSE 'fixed' END AS status, CASE doc_id % 4 WHEN 1 THEN 'c,a' ELSE 'a,b' END AS tools FROM documents")
def verdict_parsing(spark, d):
    """No answer counts as valid, a broken one as rejected, an empty fix keeps the chain."""
    k = F.col("doc_id") % 4
    answer = F.when(k == 1, '{"verdict":"fixed","tools":["c","a"]}').when(k == 2, "not json").when(k == 3, '{"verdict":"fixed","tools":[]}')
    p = verify.parse_verdict(answer, F.array(F.lit("a"), F.lit("b")))
    return t(spark, d, "documents").select("doc_id", p["status"].alias("status"), F.array_join(p["tools"], ",").alias("tools"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN false ELSE true END AS aligned, CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.8 ELSE 0.9 END AS confidence FROM documents")
def alignment_parsing(spark, d):
    k = F.col("doc_id") % 3
    answer = F.when(k == 1, '{"aligned":false,"confidence":0.8,"issues":[{"severity":"warning"}]}').when(k == 2, '{"aligned":false,"confidence":0.9,"issues":[{"severity":"ERROR"}]}').otherwise("oops")
    p = verify.parse_alignment(answer)
    return t(spark, d, "documents").select("doc_id", p["aligned"].alias("aligned"), p["confidence"].alias("confidence"))


# -- domain tools ------------------------------------------------------------

@query("SELECT o_orderkey, c_nationkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_nationkey = 3 AND o_orderpriority = (SELECT max(o_orderpriority) FROM orders)")
def direct_search(spark, d):
    """Customers as flights from their nation, open orders of one priority as available days."""
    last = t(spark, d, "orders").agg(F.max("o_orderpriority")).head()[0]
    flights = t(spark, d, "customer").select(F.col("c_custkey").alias("flight"), F.col("c_nationkey").alias("origin"), F.lit("X").alias("destination"))
    dates = t(spark, d, "orders").select(F.col("o_custkey").alias("flight"), "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("date"), F.when(F.col("o_orderstatus") == "O", "available").otherwise("landed").alias("status"))
    return domain.direct_search(flights, dates, "flight", origin=3, date=last).select("o_orderkey", F.col("origin").alias("c_nationkey"), "o_totalprice")


_LEG_SQL = "legs AS (SELECT l_orderkey * 100 + l_linenumber AS flight, c_nationkey AS origin, s_nationkey AS destination, strftime(l_shipdate, '%Y-%m') AS date, lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS departure, lpad(CAST((l_partkey % 24 + 3) % 24 AS VARCHAR), 2, '0') || ':30:00' AS arrival, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {_LEG_SQL} SELECT a.origin AS origin_1, a.destination AS destination_1, b.destination AS destination_2, a.date AS date_1, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM (SELECT origin, destination, date, arrival, count(*) AS n FROM legs GROUP BY ALL) a JOIN (SELECT origin, destination, date, departure, count(*) AS n FROM legs GROUP BY ALL) b ON a.destination = b.origin AND a.date = b.date AND b.departure >= a.arrival GROUP BY 1, 2, 3, 4")
def onestop_pairs(spark, d):
    """Lines as flights from the customer's to the supplier's nation in their month."""
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    clock = lambda c, tail: F.concat(F.lpad(c.cast("string"), 2, "0"), F.lit(tail))
    legs = j.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("flight"), F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.date_format("l_shipdate", "yyyy-MM").alias("date"), clock(F.col("l_partkey") % 24, ":00:00").alias("departure"), clock((F.col("l_partkey") % 24 + 3) % 24, ":30:00").alias("arrival"))
    return domain.onestop_counts(legs, compat=False).select("origin_1", "destination_1", "destination_2", "date_1", "pairs")


@query("SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 2 + CASE WHEN min(l_linenumber) = 1 THEN 60 ELSE 0 END + count(*) * 50 AS DOUBLE) AS price FROM lineitem GROUP BY l_orderkey")
def booking_price(spark, d):
    """Lines as legs for two passengers, insured where the first line is present, a bag a line."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("legs"), F.min("l_linenumber").alias("first"), F.count(F.lit(1)).cast("int").alias("bags"))
    return g.select("l_orderkey", domain.booking_price(F.col("legs"), F.lit(2), F.col("first") == 1, F.col("bags")).cast("double").alias("price"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'user not found' WHEN o_orderstatus = 'F' THEN 'not enough seats' WHEN c_mktsegment = 'BUILDING' THEN 'payment method not found' WHEN c_acctbal < 1000 THEN 'not enough balance' WHEN o_orderkey % 5 = 0 THEN 'payment does not add up' END AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON o_custkey = c_custkey")
def booking_validation(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 11 <> 0")
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    e = domain.booking_error(F.col("c_custkey").isNotNull(), F.col("o_orderstatus") != "F", F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") >= 1000, F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0), F.lit(0))
    return o.select("o_orderkey", e.alias("error"))


@query("SELECT o_orderkey, o_custkey, o_totalprice AS amount FROM orders UNION ALL SELECT o_orderkey, o_custkey, -o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def refund_ledger(spark, d):
    p = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("amount"))
    return domain.refund_ledger(p, "o_orderkey", "amount", t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"))


@query("SELECT o_orderkey, CAST(now - was AS DOUBLE) * 3 AS delta FROM (SELECT a.l_orderkey AS o_orderkey, sum(CASE WHEN a.l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) + 10 END) AS now, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS was FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) a GROUP BY 1)")
def rebooking_delta(spark, d):
    """Odd lines change their cabin and cost ten more, for three passengers."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    base = dealt(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("decimal(18,2)").alias("price"))
    old = base.select("l_orderkey", "l_linenumber", F.lit("economy").alias("cabin"), "price")
    new = base.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "economy").otherwise("business").alias("cabin"), (F.col("price") + 10).cast("decimal(18,2)").alias("price"))
    r = domain.rebooking_delta(old, new, ["l_orderkey"], ["l_linenumber", "cabin"], "price", F.lit(3))
    return r.select(F.col("l_orderkey").alias("o_orderkey"), ((F.col("now") - F.col("was")).cast("double") * 3).alias("delta"))


_BAGS = [(m, c, n) for (m, c), n in domain.FREE_BAGS.items()]


@query(f"SELECT c_custkey, greatest(0, (c_custkey % 13) - free * (1 + c_custkey % 3)) * 50 AS fee FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'silver' ELSE 'gold' END AS membership, CASE c_nationkey % 3 WHEN 0 THEN 'basic_economy' WHEN 1 THEN 'economy' ELSE 'business' END AS cabin FROM customer) JOIN {_values(_BAGS, 'm, c, free')} ON m = membership AND c = cabin")
def baggage_fee(spark, d):
    k = F.col("c_custkey")
    b = t(spark, d, "customer").select(k, F.when(k % 3 == 0, "regular").when(k % 3 == 1, "silver").otherwise("gold").alias("membership"), F.when(F.col("c_nationkey") % 3 == 0, "basic_economy").when(F.col("c_nationkey") % 3 == 1, "economy").otherwise("business").alias("cabin"), (k % 13).alias("bags"), (1 + k % 3).alias("pax"))
    return domain.baggage_fee(b, "bags", "pax").select("c_custkey", "fee")


@query("SELECT o_orderkey, NOT (o_orderstatus = 'F') AND (o_orderkey % 48 <= 24 OR o_orderpriority LIKE '1%' OR (o_custkey % 2 = 0 AND o_orderkey % 3 = 0)) AS may_cancel, CASE WHEN (o_custkey % 2 = 0 OR o_orderpriority LIKE '1%') AND o_orderstatus = 'P' THEN 200 WHEN (o_custkey % 2 = 0 OR o_orderpriority LIKE '1%') AND o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 100 ELSE 0 END AS compensation FROM orders")
def order_policies(spark, d):
    """Who may cancel, and what is paid out for two passengers."""
    o, k, c = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    business, insured, status = F.col("o_orderpriority").startswith("1"), c % 2 == 0, F.col("o_orderstatus")
    reason = F.when(k % 3 == 0, "health").otherwise("change of plan")
    return o.select("o_orderkey", domain.may_cancel(status == "F", k % 48, F.lit(False), business, insured, reason).alias("may_cancel"), domain.compensation(F.lit("regular"), insured, business, status == "P", status == "O", k % 2 == 0, F.lit(2)).alias("compensation"))


@query("SELECT o_custkey, count(*) > 5 OR count(*) FILTER (WHERE o_orderstatus = 'P') > 1 OR count(*) FILTER (WHERE o_orderstatus = 'F') > 1 OR count(*) FILTER (WHERE o_orderstatus = 'O') > 3 AS over FROM orders GROUP BY o_custkey")
def booking_limits(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t(spark, d, "orders").groupBy("o_custkey").agg(domain.over_limits(F.count(F.lit(1)), n("P"), n("F"), n("O")).alias("over"))


@query("SELECT name FROM (VALUES (0, 'EUROPE'), (1, 'ATLANTIS'), (2, 'MU')) AS v(o, name) WHERE name NOT IN (SELECT r_name FROM region) ORDER BY o LIMIT 1")
def first_free_id(spark, d):
    return domain.first_free(t(spark, d, "region").select(F.col("r_name").alias("name")), "name", ["EUROPE", "ATLANTIS", "MU"])


_SETTINGS = ("cellular", "wifi", "location")


@query(
    "WITH e AS (SELECT user_id, event_id, ['cellular', 'wifi', 'location', 'low_battery'][event_id % 4 + 1] AS setting, value > 50 AS v FROM events), "
    "l AS (SELECT *, coalesce(last_value(CASE WHEN setting = 'low_battery' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), false) AS low FROM e) "
    "SELECT user_id, "
    + ", ".join(f"coalesce(arg_max(CASE WHEN low THEN false ELSE v END, event_id) FILTER (WHERE low OR setting = '{n}'), true) AS {n}" for n in _SETTINGS)
    + ", arg_max(low, event_id) AS low_battery FROM l GROUP BY user_id"
)
def device_state(spark, d):
    """Events as changes of device settings."""
    e = t(spark, d, "events")
    name = F.element_at(F.array(*map(F.lit, ("cellular", "wifi", "location", "low_battery"))), (F.col("event_id") % 4 + 1).cast("int"))
    return domain.device_state(e.select("user_id", "event_id", name.alias("setting"), (F.col("value") > 50).alias("on")), "user_id", "event_id", "setting", "on")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(lower(a.n_name), lower(b.n_name)) <= 4")
def fuzzy_names(spark, d):
    n = t(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("ka")), n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("kb"))
    return a.join(b, "r").where((F.col("ka") < F.col("kb")) & domain.fuzzy(F.col("a"), F.col("b"), 4)).select("a", "b")


# -- functions ---------------------------------------------------------------

@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(second(ts) AS BIGINT) AS second, CAST(isodow(ts) AS BIGINT) AS isoweekday FROM events")
def ts_components(spark, d):
    return t(spark, d, "events").select("event_id", *[c.alias(k) for k, c in values.ts_components(F.col("ts")).items()])


@query("SELECT event_id, strftime(ts + INTERVAL 3 DAY - INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def ts_shift(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format(values.ts_shift(F.col("ts"), 3, -5, 30), "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("SELECT user_id, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds, CAST(CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS span FROM events GROUP BY user_id")
def ts_diff(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(values.seconds_between(F.min("ts"), F.max("ts")).alias("seconds"))
    return g.select("user_id", "seconds", values.hms(F.col("seconds")).alias("span"))


@query("SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(c_custkey % 90) - radians(s_suppkey % 90)) / 2), 2) + cos(radians(s_suppkey % 90)) * cos(radians(c_custkey % 90)) * pow(sin((radians(c_custkey % 180) - radians(s_suppkey % 180)) / 2), 2)))), 3) AS km FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey")
def distances(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    j = t(spark, d, "customer").join(t(spark, d, "supplier"), c % 50 == s)
    return j.select("c_custkey", F.round(values.distance_km((s % 90).cast("double"), (s % 180).cast("double"), (c % 90).cast("double"), (c % 180).cast("double")), 3).alias("km"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round(p_size * 1609.344 / 1000.0, 6) WHEN 1 THEN round((p_size * (5.0 / 9) + (-160.0 / 9)), 6) END AS converted FROM part")
def unit_conversion(spark, d):
    k = F.col("p_partkey") % 3
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.when(k == 0, "Mile").when(k == 1, "FAHRENHEIT").otherwise("gram").alias("a"), F.when(k == 0, "kilometer").when(k == 1, "Celsius").otherwise("hour").alias("b"))
    return values.convert_units(p, "v", "a", "b").select("p_partkey", F.round("converted", 6).alias("converted"))


@query("SELECT p_partkey, CAST(p_size * 3 + 1 AS VARCHAR) || '.0' AS result FROM part")
def calculate(spark, d):
    e = F.concat(F.col("p_size").cast("string"), F.lit(" * 3 + (4 - 3)"))
    return t(spark, d, "part").select("p_partkey", values.calculate(e).alias("result"))


@query("SELECT l_orderkey, l_linenumber, 'ship(part=' || CAST(max(l_partkey) AS VARCHAR) || ', flag=' || max(l_returnflag) || ')' AS call FROM lineitem GROUP BY l_orderkey, l_linenumber")
def func_format(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("p"), F.max("l_returnflag").alias("f"))
    return g.select("l_orderkey", "l_linenumber", text.func_format(F.lit("ship"), F.create_map(F.lit("part"), F.col("p"), F.lit("flag"), F.col("f"))).alias("call"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS task, CASE WHEN doc_id % 2 = 0 THEN '3' END AS trial FROM documents")
def key_parse(spark, d):
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("-3"))).otherwise(F.concat_ws("-", F.lit("a"), F.lit("b"), F.lit("c")))
    p = text.key_parts(key)
    return t(spark, d, "documents").select("doc_id", p["task"].alias("task"), p["trial"].alias("trial"))


@query("SELECT doc_id, left(text, 1500) AS head FROM documents")
def truncated_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 1500).alias("head"))


@query("SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 21)")
def guarded_select(spark, d):
    """A statement that a model wrote, run over views once it is known to be a single SELECT."""
    sql = "```sql\nSELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 21);\n```"
    return text.run_select(spark, sql, {"region": t(spark, d, "region"), "nation": t(spark, d, "nation")})


# -- sampling, replay --------------------------------------------------------

@query(f"WITH RECURSIVE {_EDGE_SQL}, c AS (SELECT tool AS walk_id, [tool] AS path, 0 AS hop FROM tools UNION ALL SELECT walk_id, list_append(path, arg_min(dst, md5('7:' || hop || ':' || walk_id || ':' || dst))), hop + 1 FROM c JOIN edges ON src = path[len(path)] WHERE NOT list_contains(path, dst) AND hop < 3 GROUP BY walk_id, path, hop) SELECT walk_id, arg_max(array_to_string(path, '>'), hop) AS chain, CASE WHEN max(hop) = 0 THEN 'NODE' ELSE 'CHAIN' END AS pattern FROM c GROUP BY walk_id")
def sampled_chains(spark, d):
    tools = _tools(spark, d)
    walks = tools.select(F.col("tool").alias("walk_id"), "tool")
    return toolgraph.sample_chains(walks, toolgraph.resource_edges(tools), 4, 7).select("walk_id", F.array_join("path", ">").alias("chain"), "pattern")


@query("SELECT c_custkey, CASE WHEN x < 0.1 THEN 'node' WHEN x < 0.55 THEN 'chain' ELSE 'dag' END AS pattern FROM (SELECT c_custkey, (CAST('0x' || left(md5('5:' || c_custkey), 8) AS BIGINT) % 1000000) / 1000000.0 AS x FROM customer)")
def weighted_patterns(spark, d):
    return t(spark, d, "customer").select("c_custkey", toolgraph.weighted_pattern(F.col("c_custkey"), 5, {"node": 0.1, "chain": 0.45, "dag": 0.45}).alias("pattern"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'answer ' || lang END AS completion FROM documents")
def replayed_completions(spark, d):
    """Requests (one for each document, by language and remainder) answered from recorded responses."""
    docs = t(spark, d, "documents").select("doc_id", F.concat_ws(":", "lang", (F.col("doc_id") % 5).cast("string")).alias("request"))
    recorded = t(spark, d, "documents").select("lang").distinct().select(F.concat("lang", F.lit(":0")).alias("request"), F.concat(F.lit("answer "), "lang").alias("completion"))
    return replay.completions(docs, recorded, "request").select("doc_id", "completion")


def _add(state, a):
    state["sum"] = state.get("sum", 0) + a["k"]
    return {"sum": state["sum"]}


@query("SELECT user_id, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY user_id")
def trajectory_replay(spark, d):
    """Events as tool calls on a running sum; calls of an unknown tool become errors."""
    calls = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "nothing").otherwise("add").alias("name"), F.to_json(F.struct(F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))).alias("arguments"))
    return replay.replay(calls, {"add": _add}, {}, ["user_id"], "event_id").select("user_id", "n_calls", "n_errors")


@query("SELECT o_custkey AS c_custkey, o_orderkey, 'abc'[n] AS label FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) JOIN customer ON c_custkey = o_custkey WHERE n <= 3")
def positional_zip(spark, d):
    """A customer's orders paired by place with three labels, as many as the shorter list has."""
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    j = t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    pairs = combos.zipped(F.coalesce("o", F.array().cast("array<bigint>")), F.array(*map(F.lit, "abc")))
    return j.select("c_custkey", F.inline(pairs)).select("c_custkey", F.col("left").alias("o_orderkey"), F.col("right").alias("label"))
