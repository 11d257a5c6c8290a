"""Scoring breakdowns, domain reads and writes, graph sampling and run control on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cases, digest, domain, evaluate, replay, toolgraph, verify, walk
from tessera.plans.queries import _EDGE_SQL, _ENDS_SQL, _PROPOSED_SQL, _TOOL_SQL, _brand, _proposed, _tools, _values, query, t
from tessera.sources import readers
from tessera.sources.catalog import DRIVER
from tessera.sources.staging import dealt

# -- scoring -----------------------------------------------------------------


def _judged(spark, d):
    """Labelled documents with what a judge would answer: two results, one, or an answer that is no JSON."""
    one = lambda name, met: F.concat(F.lit(f'{{"expectedOutcome":"{name}","reasoning":"r","metExpectation":'), F.when(met, "true").otherwise("false"), F.lit("}"))
    good, tame = one("good", F.col("quality") == 1), one("tame", F.col("toxic") == 0)
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.concat(F.lit('{"results":['), good, F.lit(","), tame, F.lit("]}"))).when(k == 1, F.concat(F.lit('{"results":['), good, F.lit("]}"))).otherwise("no answer")
    return t(spark, d, "labels").withColumn("results", evaluate.assertion_results(answer))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE WHEN CASE doc_id % 3 WHEN 0 THEN quality = 1 AND toxic = 0 WHEN 1 THEN quality = 1 ELSE true END THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM labels")
def nl_assertion_rewards(spark, d):
    """A dropped result is no failure: rewards are all-met over what came back."""
    return _judged(spark, d).select("doc_id", F.size("results").alias("n"), evaluate.assertion_reward(F.col("results")).alias("reward"))


@query("SELECT doc_id, 'good' AS assertion, quality = 1 AS met FROM labels WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 'tame', toxic = 0 FROM labels WHERE doc_id % 3 = 0")
def nl_assertion_rows(spark, d):
    return _judged(spark, d).select("doc_id", F.inline("results"))


_KINDS = [("agent", "view", "read"), ("agent", "click", "generic"), ("agent", "purchase", "write"), ("agent", "signup", "write"), ("user", "purchase", "read"), ("user", "error", "write")]
_CHECKS = f"SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'user' END AS requestor, event_type AS tool, value > 50 AS met FROM events"


def _checks(spark, d):
    """Users as simulations, their events as action checks."""
    e = t(spark, d, "events")
    one = F.struct("event_id", F.when(F.col("event_id") % 2 == 0, "agent").otherwise("user").alias("requestor"), F.col("event_type").alias("tool"), (F.col("value") > 50).alias("met"))
    return e.groupBy("user_id").agg(F.collect_list(one).alias("checks"))


@query(_CHECKS)
def action_rows(spark, d):
    return evaluate.action_rows(_checks(spark, d), "checks")


@query(f"SELECT user_id, count(*) FILTER (WHERE kind = 'write') AS write_checks, count(*) FILTER (WHERE kind = 'write' AND met) AS write_met FROM ({_CHECKS}) c LEFT JOIN (SELECT * FROM {_values(_KINDS, 'requestor, tool, kind')}) k USING (requestor, tool) GROUP BY user_id")
def write_action_accuracy(spark, d):
    kinds = spark.createDataFrame(_KINDS, "requestor string, tool string, kind string")
    rows = evaluate.with_tool_kind(evaluate.action_rows(_checks(spark, d), "checks"), kinds, "requestor", "tool")
    return evaluate.write_action_accuracy(rows, "user_id", "met")


@query("SELECT user_id, CASE WHEN bool_and(value > 5) THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM events GROUP BY user_id UNION ALL SELECT -1, 1.0")
def all_met_fold(spark, d):
    """A user without checks (-1) is met."""
    e = t(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value") > 5).alias("c"))
    none = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.array().cast("array<boolean>").alias("c"))
    return e.unionByName(none).select("user_id", evaluate.all_met(F.col("c")).alias("reward"))


_CHANNELS = "CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS db, CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END AS act, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS com"


@query(f"SELECT doc_id, db AS env, act AS action, com AS communicate, CASE WHEN doc_id % 5 = 0 THEN db * act ELSE db * com END AS combined FROM (SELECT doc_id, {_CHANNELS} FROM labels)")
def evaluation_kinds(spark, d):
    """Each kind of evaluation alone, and all by the task's basis."""
    flag = lambda c: c.cast("double")
    channels = {"DB": flag(F.col("quality") == 1), "ACTION": flag(F.col("toxic") == 0), "COMMUNICATE": flag(F.col("doc_id") % 2 == 0)}
    basis = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("DB"), F.lit("ACTION"))).otherwise(F.array(F.lit("DB"), F.lit("COMMUNICATE")))
    return t(spark, d, "labels").select("doc_id", *[evaluate.evaluate(k, basis, channels).alias("combined" if k == "all" else k) for k in ("env", "action", "communicate", "all")])


@query("SELECT o_orderkey, coalesce((o_totalprice > 100000) = (o_orderstatus = 'F'), false) AS met FROM orders")
def env_assertions(spark, d):
    """Is an order large exactly when it is asserted to be?"""
    return t(spark, d, "orders").select("o_orderkey", evaluate.env_assertion(F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F").alias("met"))


@query("SELECT conv_id, turn, role = 'assistant' AS is_call, role <> 'assistant' AND contains(text, '###STOP###') AS is_stop FROM (SELECT conv_id, turn, role, text || CASE WHEN turn % 3 = 0 THEN ' ###STOP###' ELSE '' END AS text FROM conversations)")
def message_predicates(spark, d):
    """Assistants' messages as tool calls (an empty list is one); every third message holds a stop token."""
    m = t(spark, d, "conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 3 == 0, " ###STOP###").otherwise("")))
    call = evaluate.is_tool_call(F.when(F.col("role") == "assistant", F.array().cast("array<string>")))
    return m.select("conv_id", "turn", call.alias("is_call"), evaluate.has_stop_token(F.col("text"), call).alias("is_stop"))


@query("SELECT a.conv_id, a.turn, a.role = 'tool' OR length(a.text) % 2 = 0 AS same FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, text FROM conversations) a")
def message_equality(spark, d):
    """Messages against copies with another time and cost (equal), another content (odd lengths), or, of tools, other calls (equal)."""
    m = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.array(F.lit("a")).alias("tool_calls"), F.lit("1").alias("call_id"), F.lit("agent").alias("requestor"), F.lit(False).alias("error"))
    mine = m.select("conv_id", "turn", "role", F.length("content").alias("n"), digest.message_digest().alias("x"))
    other = m.withColumn("cost", F.lit(3)).withColumn("content", F.when((F.col("role") == "tool") | (F.length("content") % 2 == 0), F.col("content")).otherwise(F.concat("content", F.lit("!")))).withColumn("tool_calls", F.when(F.col("role") == "tool", F.array(F.lit("b"))).otherwise(F.col("tool_calls")))
    return mine.join(other.select("conv_id", "turn", digest.message_digest().alias("y")), ["conv_id", "turn"]).select("conv_id", "turn", (F.col("x") == F.col("y")).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS why FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0")
def resume_compatibility(spark, d):
    """Orders as tasks of a run and of its resumption."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    now = o.where("o_orderkey % 5 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return digest.incompatible_tasks(o.where("o_orderkey % 7 <> 0"), now, "o_orderkey", ["o_custkey", "o_orderstatus"])


# -- replay ------------------------------------------------------------------

_FOLD = "SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 10 ELSE 0 END) AS BIGINT) AS spent, count(*) AS n_calls, count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase')) AS n_errors FROM events GROUP BY user_id"


def _replayed(spark, d):
    """Users' events as calls on an account; two tools are known."""
    def buy(state, arguments):
        state["spent"] += arguments["k"]
        return "ok"

    tools = {"view": lambda state, _: state["spent"], "purchase": buy}
    calls = t(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("name"), F.to_json(F.struct((F.col("event_id") % 10).alias("k"))).alias("arguments"), F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 9 == 4, "sold out").otherwise("ok")).alias("expected"))
    return replay.replay(calls, tools, {"spent": 0}, ["user_id"], "event_id", check=True)


@query(f"SELECT user_id, sha256('{{\"spent\": ' || spent || '}}') AS digest, n_calls, n_errors, mismatch FROM ({_FOLD}) LEFT JOIN (SELECT user_id, min(i) AS mismatch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE event_type = 'purchase' AND event_id % 9 = 4 GROUP BY user_id) USING (user_id)")
def replayed_states(spark, d):
    """The state each replay ends in, by its digest, and the first call whose recorded answer doesn't fit."""
    return _replayed(spark, d)


@query("SELECT true AS unchanged, false AS changed")
def database_equality(spark, d):
    """One digest of several tables: the same for rows in another order, another when a row is missing."""
    small = readers.driver_tables(spark, d, ["region", "nation", "supplier"])
    same = digest.database_digest({n: x.orderBy(F.rand(3)) for n, x in small.items()}).select(F.col("digest").alias("s"))
    less = digest.database_digest(small | {"supplier": small["supplier"].where("s_suppkey > 0")}).select(F.col("digest").alias("l"))
    return digest.database_digest(small).crossJoin(same).crossJoin(less).select((F.col("digest") == F.col("s")).alias("unchanged"), (F.col("digest") == F.col("l")).alias("changed"))


# -- domain reads and writes -------------------------------------------------


@query("SELECT o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 'customer ' || CAST(k AS VARCHAR) || ' not found' END AS error FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS k FROM orders) o LEFT JOIN customer ON c_custkey = k")
def point_lookup(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return domain.lookup(o, t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "customer").select("o_orderkey", "c_name", "error")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 <> 0) ON o_orderkey = l_orderkey")
def flight_status(spark, d):
    dates = t(spark, d, "orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return domain.flight_status(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), dates, ["l_orderkey"])


@query(f"SELECT code, city, count(o_orderkey) AS departures FROM {_values([(c, n, i) for i, (c, n) in enumerate(domain.AIRPORTS.items())], 'code, city, place')} LEFT JOIN orders ON o_orderkey % 22 = place GROUP BY code, city")
def list_all_airports(spark, d):
    """Airports served with their departures: orders stand for flights, two in twenty-two of which leave from elsewhere."""
    codes = F.array(*map(F.lit, domain.AIRPORTS))
    flights = t(spark, d, "orders").select(F.get(codes, (F.col("o_orderkey") % 22).cast("int")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("departures"))
    return domain.airports(spark).join(flights, "code", "left").select("code", "city", F.coalesce("departures", F.lit(0)).alias("departures"))


_BOOK = "SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey"


@query(f"SELECT p_partkey, 1000 - coalesce(n, 0) AS seats FROM part LEFT JOIN ({_BOOK}) ON l_partkey = p_partkey")
def booked_seats(spark, d):
    """Parts as flights of 1000 seats, lines as bookings of their quantity."""
    dates = t(spark, d, "part").select("p_partkey", F.lit(1000).cast("bigint").alias("seats"))
    booked = t(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("bigint").alias("n"))
    return domain.without_seats(dates, booked, ["p_partkey"], "n").select("p_partkey", "seats")


_METHOD = "CASE c_custkey % 3 WHEN 0 THEN 'gift_card' WHEN 1 THEN 'certificate' ELSE 'credit_card' END"


@query(f"SELECT c_custkey, kind, round(CASE WHEN kind = 'gift_card' AND paid IS NOT NULL THEN c_acctbal - paid ELSE c_acctbal END, 2) AS balance FROM (SELECT c_custkey, {_METHOD} AS kind, c_acctbal FROM customer) LEFT JOIN (SELECT o_custkey, CAST(sum(o_orderkey % 100 - 20) AS DOUBLE) AS paid FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey WHERE NOT (kind = 'certificate' AND paid IS NOT NULL)")
def payment_balances(spark, d):
    """Customers as payment methods after what their pending orders pay or get back."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "gift_card").when(F.col("c_custkey") % 3 == 1, "certificate").otherwise("credit_card")
    methods = t(spark, d, "customer").select("c_custkey", kind.alias("kind"), F.col("c_acctbal").alias("balance"))
    paid = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 100 - 20).cast("double").alias("amount"))
    return domain.after_payments(methods, paid, ["c_custkey"], "amount").select("c_custkey", "kind", F.round("balance", 2).alias("balance"))


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders")
def cancelled_status(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return domain.with_status(o, t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "cancelled")


@query("SELECT l_orderkey, arg_min(e, l_linenumber) FILTER (WHERE e IS NOT NULL) AS error FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN p_partkey IS NULL THEN 'flight not found' WHEN p_size % 4 = 0 THEN 'flight not available' WHEN p_size < l_quantity THEN 'not enough seats' END AS e FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 9 <> 0) ON p_partkey = l_partkey) GROUP BY l_orderkey")
def rebooking_errors(spark, d):
    """Lines as the legs of a rebooking, every fifth kept; parts as flights with their size as seats."""
    dates = t(spark, d, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("flight"), F.when(F.col("p_size") % 4 == 0, "landed").otherwise("available").alias("status"), F.col("p_size").alias("seats"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    legs = dealt(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("leg")).agg(F.max("l_partkey").alias("flight"), F.max("l_quantity").alias("n"))
    return domain.leg_error(legs, dates, "l_orderkey", ["flight"], "n", kept=F.col("leg") % 5 == 0)


_PAX = "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey, CASE WHEN a <> b THEN 'number of passengers does not match' END AS error FROM ({_PAX})")
def passenger_changes(spark, d):
    who = lambda s: F.collect_list(F.when(F.col("l_linestatus") == s, F.col("l_linenumber")))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(who("F").alias("old"), who("O").alias("new"))
    return g.select("l_orderkey", domain.passengers_error(F.col("old"), F.col("new")).alias("error"))


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders UNION ALL SELECT o_orderkey, CAST(50 * greatest(0, o_orderkey % 4 - 1) AS DOUBLE) FROM orders WHERE o_orderkey % 4 > 1")
def baggage_ledger(spark, d):
    """Orders' payments, and what more bags than one cost; changes without a price leave no row."""
    o = t(spark, d, "orders")
    more = o.select("o_orderkey", domain.baggage_delta(F.lit(1), F.col("o_orderkey") % 4).cast("double").alias("amount"))
    return domain.update_ledger(o.select("o_orderkey", F.col("o_totalprice").alias("amount")), more, "o_orderkey", "amount")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'payment method not found' WHEN kind = 'certificate' THEN 'certificate cannot be used to update' WHEN kind = 'gift_card' AND c_acctbal < 2000 THEN 'gift card balance is not enough' END AS error FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal, " + _METHOD + " AS kind FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = o_custkey")
def update_payment_errors(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 11 <> 0").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, "gift_card").when(F.col("c_custkey") % 3 == 1, "certificate").otherwise("credit_card").alias("kind"))
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", domain.update_payment_error(F.col("c_custkey").isNotNull(), F.col("kind"), F.col("c_acctbal"), F.lit(2000)).alias("error"))


@query("SELECT c_custkey, CASE WHEN NOT one THEN 'cert_1' WHEN NOT two THEN 'cert_2' END AS certificate, CASE WHEN one AND two THEN 'too many certificates' END AS error FROM (SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 1) AS one, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 2) AS two FROM customer)")
def sent_certificates(spark, d):
    used = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("cert_"), (F.col("o_orderkey") % 3).cast("string")).alias("id"))
    return domain.certificates(t(spark, d, "customer").select("c_custkey"), used, "c_custkey", ["cert_1", "cert_2"]).select("c_custkey", "certificate", "error")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey END AS found FROM customer")
def find_user(spark, d):
    """Customers asked for by email (another case), by name and zip, or by a name that nobody has."""
    c = t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    users = c.select(F.col("c_custkey").alias("user"), F.concat(F.lit("C"), key, F.lit("@mail.com")).alias("email"), F.concat(F.lit("First"), key).alias("first"), F.lit("Last").alias("last"), key.alias("zip"))
    k = F.col("c_custkey") % 3
    ask = c.select(F.col("c_custkey").alias("request"), F.when(k == 0, F.concat(F.lit("c"), key, F.lit("@MAIL.com"))).alias("email"), F.when(k == 1, F.concat(F.lit("FIRST"), key)).otherwise("nobody").alias("first"), F.lit("last").alias("last"), key.alias("zip"))
    return domain.find_user(users, ask).select(F.col("request").alias("c_custkey"), F.col("user").alias("found"))


@query("SELECT '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) || '}' AS products FROM nation")
def product_types(spark, d):
    return domain.product_types(t(spark, d, "nation"), "n_name", "n_nationkey")


_EXCHANGE = "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <= 2) AS olds, count(*) FILTER (WHERE l_linenumber > 2) AS news FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'order is not delivered' WHEN o_orderkey % 5 = 0 THEN 'already done' WHEN coalesce(olds, 0) <> coalesce(news, 0) THEN 'items do not pair' WHEN o_orderkey % 7 = 0 THEN 'not the same product' WHEN o_orderkey % 11 = 0 THEN 'not available' WHEN o_totalprice < 60000 THEN 'gift card balance is not enough' END AS error FROM orders LEFT JOIN ({_EXCHANGE}) ON l_orderkey = o_orderkey")
def exchange_errors(spark, d):
    """Orders' first two lines exchanged for the others."""
    part = lambda low: F.collect_list(F.when((F.col("l_linenumber") <= 2) == F.lit(low), F.col("l_linenumber")))
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(part(True).alias("old"), part(False).alias("new"))
    none = F.array().cast("array<int>")
    o = t(spark, d, "orders").join(g, "o_orderkey", "left")
    status, key = F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("pending"), F.col("o_orderkey")
    return o.select("o_orderkey", domain.exchange_error(status, key % 5 == 0, F.coalesce("old", none), F.coalesce("new", none), key % 7 != 0, key % 11 != 0, F.col("o_totalprice"), F.lit(60000)).alias("error"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'order is not P' WHEN o_orderkey % 2 = 0 THEN 'already done' END AS error FROM orders")
def order_write_errors(spark, d):
    return t(spark, d, "orders").select("o_orderkey", domain.order_write_error(F.col("o_orderstatus"), "P", F.col("o_orderkey") % 2 == 0).alias("error"))


_ITEMS = "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_linestatus = 'F') AS a, list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey, CASE WHEN len(coalesce(a, [])) = len(coalesce(b, [])) THEN coalesce(array_to_string(list_transform(list_zip(a, b), lambda x: x[1] || '>' || x[2]), ','), '') END AS pairs FROM ({_ITEMS})")
def paired_items(spark, d):
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == s, F.col("l_linenumber"))))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(side("F").alias("a"), side("O").alias("b"))
    return g.select("l_orderkey", F.array_join(F.transform(domain.paired_items(F.col("a"), F.col("b")), lambda p: F.concat_ws(">", p["item"].cast("string"), p["new_item"].cast("string"))), ",").alias("pairs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE c_name END AS c_name, coalesce(seg, CASE WHEN c_custkey % 4 = 1 THEN 'NEW' ELSE c_mktsegment END) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max_by(struct_pack(p := CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END), o_orderkey).p AS seg, max_by(o_orderstatus = 'P', o_orderkey) AS deleted FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE NOT coalesce(deleted, c_custkey % 4 = 1)")
def contact_changes(spark, d):
    """Customers as contacts, a quarter of them not there yet; their orders as changes, of which the last counts."""
    c = t(spark, d, "customer").where("c_custkey % 4 <> 1").select("c_custkey", "c_name", "c_mktsegment")
    o = t(spark, d, "orders")
    fresh = F.col("o_custkey") % 4 == 1
    segment = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).when(fresh, "NEW")
    changes = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("put").alias("op"), F.when(fresh, "new").cast("string").alias("c_name"), segment.alias("c_mktsegment"))
    known = t(spark, d, "customer").select("c_custkey")
    return domain.changed(c, changes.join(known, "c_custkey", "left_semi"), "c_custkey")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 10 AND value <= 90 AND (levenshtein(lower(props), lower('{\"k\": 12}')) <= 2 OR contains(lower(props), lower('{\"k\": 12}')))")
def reminder_search(spark, d):
    """Equal, range and fuzzy conditions at once."""
    return domain.search(t(spark, d, "events"), {"event_type": "click", "user_id": None}, {"value": (10, 90), "event_id": (None, None)}, {"props": '{"k": 12}'}).select("event_id")


# -- walks and graphs --------------------------------------------------------

@query("""
WITH rs AS (SELECT r_regionkey FROM region ORDER BY md5('7:' || CAST(r_regionkey AS VARCHAR)), r_regionkey LIMIT 2),
n1 AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM rs)),
nb AS (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM rs)),
c1 AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nb)),
cb AS (SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nb)),
o1 AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cb)),
ns AS (SELECT n_nationkey, n_regionkey FROM nation ORDER BY md5('7:' || CAST(n_nationkey AS VARCHAR)), n_nationkey LIMIT 2),
c2 AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM ns)),
cs AS (SELECT c_custkey, c_nationkey FROM customer ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 2),
o2 AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cs)),
os AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2)
SELECT 'region' AS table_name, CAST(r_regionkey AS BIGINT) AS key FROM (SELECT r_regionkey FROM rs UNION SELECT n_regionkey FROM ns)
UNION ALL SELECT 'nation', n_nationkey FROM (SELECT n_nationkey FROM n1 UNION SELECT n_nationkey FROM ns UNION SELECT c_nationkey FROM cs)
UNION ALL SELECT 'customer', c_custkey FROM (SELECT c_custkey FROM c1 UNION SELECT c_custkey FROM c2 UNION SELECT c_custkey FROM cs UNION SELECT o_custkey FROM os)
UNION ALL SELECT 'orders', o_orderkey FROM (SELECT o_orderkey FROM o1 UNION SELECT o_orderkey FROM o2 UNION SELECT o_orderkey FROM os)
""")
def unreached_sample(spark, d):
    """From parts, which reach nothing here: two rows of every other table, each sample followed as far as unvisited tables go."""
    tables = readers.driver_tables(spark, d, {"region", "nation", "customer", "orders", "part"})
    found = walk.sample_unreached({"part": tables["part"]}, tables, DRIVER, 2, 7)
    return _keyed(found, {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"})


def _keyed(found, keys):
    parts = [found[n].select(F.lit(n).alias("table_name"), F.col(k).cast("bigint").alias("key")) for n, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
SELECT 'nation' AS table_name, CAST(n_nationkey AS BIGINT) AS key FROM nation WHERE n_regionkey IN (1, 2)
UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT) FROM region WHERE r_regionkey IN (1, 2)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def extended_walk(spark, d):
    """A walk from one region, extended by another one: its nations are added, but as nations were visited before their customers are not."""
    tables = readers.driver_tables(spark, d, {"region", "nation", "customer"})
    region = tables["region"]
    first = walk.walk(tables, DRIVER, "region", region.where("r_regionkey = 1"))
    found = walk.extend(first, tables, DRIVER, "region", region.where("r_regionkey = 2"))
    return _keyed(found, {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey"})


def _edges(spark, d):
    return toolgraph.resource_edges(_tools(spark, d)).select("src", "dst")


@query(f"WITH {_EDGE_SQL} SELECT DISTINCT n_nationkey AS walk_id, dst FROM nation JOIN (SELECT src, dst FROM edges UNION SELECT src, dst FROM {_PROPOSED_SQL}) e ON src = 'brand_' || (n_nationkey % 25 + 1) WHERE dst <> 'brand_1' AND dst <> src")
def chain_successors(spark, d):
    """Next tools by edges (those that suppliers propose, beside those of the types) for a chain of each nation."""
    paths = t(spark, d, "nation").select(F.col("n_nationkey").alias("walk_id"), F.array(F.lit("brand_1"), _brand(F.col("n_nationkey") % 25 + 1)).alias("path"))
    return toolgraph.successors(paths, _proposed(spark, d), _tools(spark, d))


@query(f"WITH {_EDGE_SQL}, {_ENDS_SQL}, entry AS (SELECT list(tool ORDER BY tool) AS names FROM firsts) SELECT c_custkey AS walk_id, names[CAST(CAST('0x' || left(md5('5:' || CAST(c_custkey AS VARCHAR)), 8) AS BIGINT) % len(names) AS INT) + 1] AS tool FROM customer, entry")
def entry_samples(spark, d):
    """A seeded entry point for a walk of each customer."""
    walks = t(spark, d, "customer").select(F.col("c_custkey").alias("walk_id"))
    return toolgraph.entry_sample(walks, toolgraph.entry_tools(_tools(spark, d), _edges(spark, d)), 5)


@query("SELECT pattern, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('NODE'), ('CHAIN'), ('DAG')) AS v(pattern) LEFT JOIN (SELECT CASE WHEN l_quantity > 25 THEN 'CHAIN' ELSE 'NODE' END AS pattern, count(*) AS n FROM lineitem GROUP BY 1) USING (pattern)")
def pattern_distribution(spark, d):
    p = t(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 25, "CHAIN").otherwise("NODE").alias("pattern"))
    return toolgraph.pattern_distribution(p, ["NODE", "CHAIN", "DAG"])


_COMPLETE = f"WITH {_EDGE_SQL}, u AS (SELECT tool, row_number() OVER (ORDER BY tool) - 1 AS place, array_to_string(list_filter([(SELECT min(src) FROM edges WHERE dst = tool), tool, CASE WHEN (SELECT min(dst) FROM edges WHERE src = tool) IS DISTINCT FROM (SELECT min(src) FROM edges WHERE dst = tool) THEN (SELECT min(dst) FROM edges WHERE src = tool) END], lambda x: x IS NOT NULL), '>') AS chain FROM tools WHERE tool NOT IN (SELECT 'brand_' || (o_orderkey % 25 + 1) FROM orders WHERE (o_orderkey % 25 + 1) % 3 <> 0)) SELECT tool, chain FROM u"


def _order_paths(spark, d):
    """Orders as paths of one tool; every third tool has none."""
    n = F.col("o_orderkey") % 25 + 1
    return t(spark, d, "orders").where(n % 3 != 0).select(F.array(_brand(n)).alias("path"))


@query(_COMPLETE)
def coverage_completion(spark, d):
    """A chain through each tool that no path uses."""
    return toolgraph.coverage_completion(_order_paths(spark, d), _tools(spark, d), _edges(spark, d)).select("tool", F.array_join("path", ">").alias("chain"))


@query(_COMPLETE + " WHERE place < 3")
def coverage_to_target(spark, d):
    """As many of these chains as bring coverage from two thirds to four fifths."""
    return toolgraph.completed_to(_order_paths(spark, d), _tools(spark, d), _edges(spark, d), 0.8).select("tool", F.array_join("path", ">").alias("chain"))


@query(f"WITH {_TOOL_SQL}, q AS (SELECT DISTINCT tool, unnest(params) AS p FROM tools), c AS (SELECT DISTINCT x.tool AS a, y.tool AS b FROM q x JOIN q y USING (p) WHERE x.tool <> y.tool), w AS (SELECT c_custkey AS walk_id, 'brand_' || (c_custkey % 25 + 1) AS last FROM customer) SELECT walk_id, arg_min(b, md5('3:' || walk_id || ':' || b)) AS parallel, CASE WHEN max(b) IS NULL THEN 'CHAIN' ELSE 'DAG' END AS pattern FROM w LEFT JOIN c ON a = last GROUP BY walk_id")
def parallel_branches(spark, d):
    """Chains with one seeded parallel tool that shares a parameter with the last one."""
    chains = t(spark, d, "customer").select(F.col("c_custkey").alias("walk_id"), F.array(_brand(F.col("c_custkey") % 25 + 1)).alias("path"))
    return toolgraph.add_parallel(chains, toolgraph.parallel_candidates(_tools(spark, d)), 3).select("walk_id", "parallel", "pattern")


@query(f"WITH {_EDGE_SQL}, {_ENDS_SQL} SELECT tool, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = tool), '') AS next, 'about ' || tool AS description, tool IN (SELECT tool FROM firsts) AS entry, tool IN (SELECT tool FROM lasts) AS terminal FROM tools")
def exported_graph(spark, d):
    """Nodes as JSON, read back for their edges out, descriptions and whether they are ends."""
    tools = _tools(spark, d).withColumn("description", F.concat(F.lit("about "), "tool"))
    nodes = toolgraph.export_graph(tools, _edges(spark, d))
    x = nodes.select("tool", F.from_json("node", "next array<string>, description string, entry boolean, terminal boolean").alias("n"))
    return x.select("tool", F.array_join("n.next", ",").alias("next"), "n.description", "n.entry", "n.terminal")


# -- run control and texts ---------------------------------------------------

_ENDS = "SELECT *, CASE WHEN counted AND e >= 5 THEN 'too_many_errors' WHEN k >= 20 THEN 'max_steps' WHEN event_type = 'signup' AND event_id % 3 = 0 AND k > 10 THEN CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'user' END || '_stop' END AS why FROM (SELECT user_id, event_id, event_type, counted, row_number() OVER w AS k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS e FROM events, (VALUES (true), (false)) v(counted) WINDOW w AS (PARTITION BY user_id, counted ORDER BY event_id))"


@query(f"SELECT user_id, counted, coalesce(min(k) FILTER (WHERE why IS NOT NULL), count(*)) AS steps, arg_min(why, k) FILTER (WHERE why IS NOT NULL) AS reason FROM ({_ENDS}) GROUP BY user_id, counted")
def run_termination(spark, d):
    """Users' events as steps: a stop after ten steps, twenty steps, or (where errors are counted) five errors end a run."""
    e = t(spark, d, "events").withColumn("speaker", F.when(F.col("event_id") % 2 == 0, "agent").otherwise("user"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("late", F.row_number().over(w) > 10)
    stop = (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0) & F.col("late")
    ends = [cases.termination(e, "user_id", "event_id", stop, F.col("event_type") == "error", 20, 5, compat=not counted).withColumn("counted", F.lit(counted)) for counted in (True, False)]
    return ends[0].unionByName(ends[1])


@query("SELECT o_orderkey, condition, CASE condition WHEN 'large' THEN o_totalprice > 100000 ELSE o_orderstatus = 'F' END AS met FROM orders CROSS JOIN (VALUES ('large'), ('done')) AS v(condition)")
def intent_postconditions(spark, d):
    return cases.postconditions(t(spark, d, "orders"), "o_orderkey", {"large": F.col("o_totalprice") > 100000, "done": F.col("o_orderstatus") == "F"})


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 2")
def second_run(spark, d):
    """The second order of each customer, as a run is picked by its number."""
    return cases.pick_row(t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


def _judge(df):
    n = F.col("o_orderkey")
    status = F.when(F.size("tools") > 3, "valid").when((F.size("tools") == 1) & (n % 5 == 0), "rejected").when(n % 7 == 0, "rejected").otherwise("fixed")
    return df.select("o_orderkey", status.alias("status"), F.array_append("tools", F.lit("x")).alias("tools"))



@query("SELECT o_orderkey, size AS n, size > 3 AND k > 3 AS untouched FROM (SELECT o_orderkey, o_orderkey % 4 + 1 AS k, CASE WHEN o_orderkey % 4 = 3 THEN 4 WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 4 WHEN o_orderkey % 4 >= 1 THEN 4 END AS size FROM orders) WHERE size IS NOT NULL")
def refined_chains(spark, d):
    """Chains of one to four tools: a fix adds a tool and drops the parallel group, a rejected one is drawn anew with three tools."""
    o = t(spark, d, "orders")
    start = o.select("o_orderkey", F.array_repeat(F.lit("a"), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("tools"), F.lit("DAG").alias("pattern"), F.lit("p").alias("parallel"))
    again = lambda keys: keys.select("o_orderkey", F.array_repeat(F.lit("b"), 3).alias("tools"), F.lit("CHAIN").alias("pattern"), F.lit(None).cast("string").alias("parallel"))
    accepted, _ = verify.refine_chains(start, "o_orderkey", _judge, again, 2)
    return accepted.select("o_orderkey", F.size("tools").alias("n"), F.col("parallel").isNotNull().alias("untouched"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 8 THEN 0 WHEN o_orderkey % 10 >= 7 THEN 1 ELSE 2 END AS repairs FROM orders WHERE o_orderkey % 10 >= 6")
def repaired_cases(spark, d):
    """A case passes from eight on; each of two repairs adds one."""
    c = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("v"))
    accepted, _ = verify.bounded_repair(c, "o_orderkey", lambda df: df.where("v >= 8"), lambda df: df.withColumn("v", F.col("v") + 1), 2)
    return accepted.select("o_orderkey", (F.col("v") - F.col("o_orderkey") % 10).cast("int").alias("repairs"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'must_follow' ELSE '' END AS kinds, CASE WHEN doc_id % 2 = 0 THEN 'b,c' END AS tools FROM documents")
def parsed_rules(spark, d):
    """Rules of known kinds, and proposed tools that are known."""
    k = F.col("doc_id")
    answer = F.when(k % 3 == 0, '[{"type":"must_follow","depends_on":"a"},{"type":"someday"}]').when(k % 3 == 1, "none")
    names = F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("z"), F.lit("c"))).otherwise(F.array(F.lit("z")))
    return t(spark, d, "documents").select("doc_id", F.array_join(F.transform(verify.parse_constraints(answer), lambda c: c["type"]), ",").alias("kinds"), F.array_join(verify.refine_chain(names, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), ",").alias("tools"))


@query("SELECT n_nationkey, '1. ' || n_name || chr(10) || '2. x' AS listed, '## ' || n_name || chr(10) || 'N' || CAST(n_nationkey AS VARCHAR) || chr(10) || 'Parameters:' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '- a' || chr(10) || '- b' ELSE '- none' END || chr(10) || 'Returns: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'id (string)' ELSE 'id, name' END AS section FROM nation")
def rendered_prompts(spark, d):
    """Texts from rows: a numbered list, a tool's section with what it returns."""
    even = F.col("n_nationkey") % 2 == 0
    text_of = lambda *x: F.array(*map(F.lit, x))
    returns = text.returns_description(F.when(even, text_of("id")).otherwise(text_of("id", "name")), F.when(even, text_of("string")).otherwise(text_of("string", "string")))
    section = text.tool_section(F.col("n_name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.when(even, text_of("a", "b")).otherwise(F.array().cast("array<string>")), returns)
    return t(spark, d, "nation").select("n_nationkey", text.numbered(F.array("n_name", F.lit("x"))).alias("listed"), section.alias("section"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso FROM events")
def iso_times(spark, d):
    return t(spark, d, "events").select("event_id", text.iso_time(F.col("ts")).alias("iso"))


@query("SELECT o_orderkey, n FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS n FROM orders) WHERE n <= 20")
def sorted_runs(spark, d):
    """The first twenty runs by task and trial."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey").limit(20)
    from pyspark.sql import Window

    return o.select("o_orderkey", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o_custkey", "o_orderkey")).cast("bigint").alias("n"))
