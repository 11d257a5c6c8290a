"""Searches, retail writes, messages, certificates, prompts and intents on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cases, domain, environments, retail, toolgraph
from tessera.operators.cases import Intent
from tessera.operators.environments import Environment, Support
from tessera.plans.queries import _EDGE_SQL, _tools, query, t
from tessera.sources.staging import dealt

# -- flights -----------------------------------------------------------------

_LEGS = """
legs AS (SELECT l_orderkey * 100 + l_linenumber AS flight, c_nationkey AS origin, s_nationkey AS destination, '2024-05-' || lpad(CAST(1 + l_partkey % 28 AS VARCHAR), 2, '0') AS date,
         lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS departure, lpad(CAST((l_suppkey % 24 + 5) % 24 AS VARCHAR), 2, '0') || ':30:00' || CASE WHEN l_suppkey % 24 >= 19 THEN '+1' ELSE '' END AS arrival, l_suppkey % 24 >= 19 AS late, 1 + l_partkey % 28 AS day
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {_LEGS}
SELECT compat, a.flight AS flight_1, b.flight AS flight_2, b.date AS date_2
FROM legs a JOIN legs b ON a.destination = b.origin CROSS JOIN (VALUES (true), (false)) v(compat)
WHERE a.origin = 3 AND b.destination = 7 AND b.departure >= a.arrival
  AND b.date = CASE WHEN NOT a.late THEN a.date WHEN compat THEN '2024-05-' || (a.day + 1) ELSE '2024-05-' || lpad(CAST(a.day + 1 AS VARCHAR), 2, '0') END""")
def onestop_trips(spark, d):
    """Trips with one stop between two nations, by the rule with the unpadded day and by the calendar."""
    j = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hour = F.col("l_suppkey") % 24
    legs = j.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("flight"), F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.concat(F.lit("2024-05-"), two(1 + F.col("l_partkey") % 28)).alias("date"),
        F.concat(two(hour), F.lit(":00:00")).alias("departure"), F.concat(two((hour + 5) % 24), F.lit(":30:00"), F.when(hour >= 19, "+1").otherwise("")).alias("arrival"),
    )
    tiles = domain.onestop_tiles(legs, 3, 7)
    both = [domain.onestop_pairs(*tiles, compat=compat).select(F.lit(compat).alias("compat"), "flight_1", "flight_2", "date_2") for compat in (True, False)]
    return both[0].unionByName(both[1])


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 100 * (1 + o_orderkey % 3) WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 50 * (1 + o_orderkey % 3) ELSE 0 END AS amount FROM orders WHERE o_custkey % 2 = 0),
n AS (SELECT *, sum(CASE WHEN amount > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS k FROM r)
SELECT o_orderkey, CAST(amount AS INT) AS amount, CASE WHEN amount > 0 AND k <= 3 THEN 'certificate_' || (3221321 + k) END AS certificate, CASE WHEN amount = 0 THEN 'not eligible' WHEN k > 3 THEN 'too many certificates' END AS error FROM n""")
def certificates_in_order(spark, d):
    """Orders as requests for compensation: the customers' first three that are due one get a certificate, two where they have one."""
    o, k = t(spark, d, "orders").where("o_custkey % 2 = 0"), F.col("o_orderkey")
    due = domain.compensation(F.lit("gold"), F.lit(False), F.lit(False), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", k % 2 == 0, (1 + k % 3).cast("int"))
    ids = [f"certificate_{n}" for n in (3221322, 3221323, 3221324)]
    used = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(ids[0]).alias("id"))
    asked = o.select("o_orderkey", "o_custkey", due.cast("int").alias("amount"))
    return domain.certificates(asked, used, "o_custkey", ids, "o_orderkey", "amount").select("o_orderkey", "amount", "certificate", "error")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Transfer successful' WHEN 'view' THEN '' ELSE 'Error: Tool ''' || event_type || ''' not found.' END AS content, event_type NOT IN ('error', 'view') AS error FROM events")
def support_calls(spark, d):
    """Errors hand over to people, views are thoughts."""
    name = F.when(F.col("event_type") == "error", "transfer_to_human_agents").when(F.col("event_type") == "view", "think").otherwise(F.col("event_type"))
    args = F.when(F.col("event_type") == "error", '{"summary": "s"}').when(F.col("event_type") == "view", '{"thought": "t"}')
    calls = t(spark, d, "events").select("event_id", name.alias("name"), F.lit("assistant").alias("requestor"), args.alias("arguments"))
    return environments.responses(calls, Environment(Support), {}, "event_id")


# -- retail ------------------------------------------------------------------

# Every order gets a request by its number, and some a second one; gift cards always cover what is asked, so that sums say what is left.
_ASKED = """
o AS (SELECT o_orderkey AS ord, o_custkey AS usr, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'processed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'g' ELSE 'c' END AS method, CAST(10 + o_orderkey % 7 AS DECIMAL(18,2)) AS paid FROM orders),
r AS (SELECT *, CASE ord % 5 WHEN 0 THEN 'cancel' WHEN 1 THEN 'modify_payment' WHEN 2 THEN 'modify_items' WHEN 3 THEN 'exchange' ELSE 'return' END AS action FROM o),
w AS (SELECT *, CASE WHEN action IN ('cancel', 'modify_payment', 'modify_items') AND status <> 'pending' THEN 'order is not pending' WHEN action IN ('exchange', 'return') AND status <> 'delivered' THEN 'order is not delivered'
                     WHEN action = 'cancel' AND ord % 3 = 0 THEN 'unknown reason' WHEN action = 'modify_payment' AND method = 'g' THEN 'payment method is the same'
                     WHEN action IN ('modify_items', 'exchange') AND ord % 4 = 3 THEN 'not the same product' WHEN action IN ('modify_items', 'exchange') AND ord % 9 = 0 THEN 'not available' END AS error FROM r),
z AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN action = 'cancel' THEN -paid WHEN action IN ('modify_items', 'exchange') THEN 5 ELSE 0 END AS difference FROM w)"""


def _retail(spark, d) -> retail.Written:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "processed").otherwise("pending")
    orders = t(spark, d, "orders").select(k.alias("order"), F.col("o_custkey").alias("user"), status.alias("status"), F.lit("home").alias("address"), F.when(k % 2 == 0, "g").otherwise("c").alias("method"), (10 + k % 7).alias("paid"))
    items = orders.select("order", F.lit(0).alias("place"), (F.col("order") * 10).alias("item"))
    # four variants an order: its item, a dearer one, one that is out of stock, one of another product
    variant = lambda n, product, price, there: F.struct((F.col("order") * 10 + n).alias("item"), (F.col("order") * 2 + product).alias("product"), F.lit(price).alias("price"), F.lit(there).alias("available"))
    stock = orders.select(F.inline(F.array(variant(0, 0, 10, True), variant(1, 0, 15, True), variant(2, 0, 15, False), variant(3, 1, 15, True))))
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    cards = users.select("user", F.inline(F.array(F.struct(F.lit("g").alias("method"), F.lit("gift_card").alias("source"), F.lit(100_000).alias("balance")), F.struct(F.lit("c").alias("method"), F.lit("credit_card").alias("source"), F.lit(0).alias("balance")))))
    o = F.col("order")
    action = F.element_at(F.array(*map(F.lit, ("cancel", "modify_payment", "modify_items", "exchange", "return"))), (o % 5 + 1).cast("int"))
    new = o * 10 + F.when(o % 4 == 3, 3).when(o % 9 == 0, 2).otherwise(1)
    first = orders.select((o * 2).alias("request"), "order", action.alias("action"), F.array(o * 10).alias("items"), F.array(new).alias("new_items"), F.lit("g").alias("method"), F.lit(None).cast("string").alias("address"), F.when(o % 3 == 0, "bored").otherwise("ordered by mistake").alias("reason"))
    second = first.where("order % 2 = 1").withColumn("request", o * 2 + 1).withColumn("action", F.lit("modify_address")).withColumn("address", F.lit("moved"))
    return retail.written_orders(orders, items, stock, cards, first.unionByName(second))


@query(f"""WITH {_ASKED}
SELECT ord * 2 AS request, error, CAST(difference AS DOUBLE) AS difference FROM z
UNION ALL SELECT ord * 2 + 1, CASE WHEN CASE WHEN error IS NULL AND action = 'cancel' THEN 'cancelled' ELSE status END <> 'pending' THEN 'order is not pending' END,
  CASE WHEN CASE WHEN error IS NULL AND action = 'cancel' THEN 'cancelled' ELSE status END = 'pending' THEN 0 END FROM z WHERE ord % 2 = 1""")
def order_writes(spark, d):
    """Cancellations, changes, exchanges and returns, and moves that come after them: what came of each."""
    return _retail(spark, d).results.select("request", "error", F.col("difference").cast("double").alias("difference"))


@query(f"""WITH {_ASKED}
SELECT ord, CASE WHEN error IS NOT NULL OR action = 'modify_payment' THEN status WHEN action = 'cancel' THEN 'cancelled' WHEN action = 'modify_items' THEN 'pending (item modified)' WHEN action = 'exchange' THEN 'exchange requested' ELSE 'return requested' END AS status,
       CASE WHEN ord % 2 = 1 AND status = 'pending' AND NOT (error IS NULL AND action = 'cancel') THEN 'moved' ELSE 'home' END AS address,
       CASE WHEN error IS NULL AND action = 'modify_payment' THEN 'g' ELSE method END AS method, ord * 10 + CASE WHEN error IS NULL AND action = 'modify_items' THEN 1 ELSE 0 END AS item FROM z""")
def orders_after_writes(spark, d):
    """Status, address, method and item of every order afterwards."""
    w, rows = _retail(spark, d), 2 * t(spark, d, "orders").count()
    return dealt(w.orders, rows, "order").join(dealt(w.items, rows, "order"), "order").select(F.col("order").alias("ord"), "status", "address", "method", "item")


@query(f"""WITH {_ASKED}
SELECT c_custkey AS usr, CAST(100000 - coalesce(sum(CASE WHEN error IS NOT NULL THEN 0 WHEN action = 'cancel' AND method = 'g' THEN -paid WHEN action = 'modify_payment' THEN paid WHEN action = 'modify_items' THEN 5 ELSE 0 END), 0) AS DOUBLE) AS balance
FROM customer LEFT JOIN z ON usr = c_custkey GROUP BY c_custkey""")
def cards_after_writes(spark, d):
    """Gift cards after what was paid and refunded."""
    return _retail(spark, d).cards.where("method = 'g'").select(F.col("user").alias("usr"), F.col("balance").cast("double").alias("balance"))


@query("SELECT o_orderkey, o_orderstatus, coalesce(i.lines, '') AS lines, CASE WHEN o_orderkey % 3 = 0 THEN 'card:' || o_custkey ELSE '' END AS paid FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || 'x' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey")
def order_details(spark, d):
    """Orders with their lines and payments as nested rows."""
    o = t(spark, d, "orders")
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"))
    paid = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("card").alias("method"), F.col("o_custkey").alias("owner"))
    found = retail.order_details(o.select("o_orderkey", "o_orderstatus"), items, paid, "o_orderkey")
    line = F.transform("items", lambda i: F.concat_ws("x", i["l_partkey"].cast("string"), i["quantity"].cast("string")))
    return found.select("o_orderkey", "o_orderstatus", F.array_join(line, ",").alias("lines"), F.array_join(F.transform("payments", lambda p: F.concat_ws(":", p["method"], p["owner"].cast("string"))), ",").alias("paid"))


@query("SELECT p_brand, string_agg(p_partkey || '=' || p_name || '/' || (p_size > 10), ',' ORDER BY p_partkey) AS variants FROM part GROUP BY p_brand")
def product_details(spark, d):
    """Brands as products, with their parts as variants by item."""
    p = t(spark, d, "part")
    found = retail.product_details(p.select("p_brand").distinct(), p.select("p_brand", "p_partkey", "p_name", (F.col("p_size") > 10).alias("available")), "p_brand", "p_partkey")
    shown = F.transform(F.array_sort(F.map_entries("variants")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]["p_name"], F.lit("/"), e["value"]["available"].cast("string")))
    return found.select("p_brand", F.array_join(shown, ",").alias("variants"))


# -- messages ----------------------------------------------------------------


@query("""
SELECT event_id, r.c_name AS recipient_name FROM events JOIN customer s ON s.c_custkey = user_id LEFT JOIN customer r ON r.c_custkey = event_id % 200 AND r.c_custkey % 4 <> 0
WHERE s.c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 8) AND s.c_custkey = 8 AND event_id BETWEEN 10 AND 9000 AND (levenshtein(lower(props), '{"k": 12}') <= 2 OR contains(lower(props), '{"k": 12}'))""")
def message_search(spark, d):
    """Messages of one contact in a range of time with a text like the one given; some recipients are no contacts."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.concat(F.lit("+"), F.col("c_custkey").cast("string")).alias("phone"))
    m = t(spark, d, "events").select("event_id", "props", F.concat(F.lit("+"), F.col("user_id").cast("string")).alias("sender_phone"), F.when(F.col("event_id") % 200 % 4 != 0, F.concat(F.lit("+"), (F.col("event_id") % 200).cast("string"))).otherwise("+none").alias("recipient_phone"))
    return domain.search_messages(m, c, sender=8, between={"event_id": (10, 9000)}, near={"props": '{"k": 12}'}).select("event_id", "recipient_name")


# -- prompts, intents, runs --------------------------------------------------


@query(f"WITH {_EDGE_SQL}, e AS (SELECT src, string_agg('- ' || src || ' -> ' || dst || ' (via ' || matching || ')', chr(10) ORDER BY '- ' || src || ' -> ' || dst || ' (via ' || matching || ')') AS x FROM edges GROUP BY src) SELECT tool, coalesce(x, '(none)') AS existing FROM tools LEFT JOIN e ON src = tool")
def existing_edges_prompt(spark, d):
    """Each tool's edges as a prompt lists them."""
    tools = _tools(spark, d)
    edges = toolgraph.resource_edges(tools).groupBy(F.col("src").alias("tool")).agg(F.collect_list(F.struct("src", "dst", "matching")).alias("edges"))
    empty = F.array().cast("array<struct<src:string,dst:string,matching:array<string>>>")
    return tools.join(edges, "tool", "left").select("tool", text.edge_list(F.coalesce("edges", empty)).alias("existing"))


@query("SELECT c_custkey, '## Row' || chr(10) || '{' || chr(10) || '  \"name\" : \"' || c_name || '\",' || chr(10) || '  \"nation\" : ' || c_nationkey || chr(10) || '}' AS section FROM customer")
def json_sections(spark, d):
    """Sampled rows as prompts show them."""
    return t(spark, d, "customer").select("c_custkey", text.json_section("Row", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("section"))


_INTENTS = [
    Intent("cancel", lambda rows: rows.where("o_orderstatus = 'O'"), lambda: F.concat(F.lit("Cancel order "), F.col("o_orderkey").cast("string")), {"cancelled": lambda: F.col("now") == "cancelled", "same customer": lambda: F.col("o_custkey").isNotNull()}),
    Intent("complain", lambda rows: rows.where("o_totalprice > 1000"), lambda: F.concat(F.lit("Ask why order "), F.col("o_orderkey").cast("string"), F.lit(" is so dear")), {"untouched": lambda: F.col("now") == F.col("o_orderstatus")}),
]
_SAMPLED = """
s AS (SELECT * FROM (SELECT 'cancel' AS intent, o_orderkey, 'Cancel order ' || o_orderkey AS prompt FROM orders WHERE o_orderstatus = 'O' ORDER BY md5('4:cancel:' || o_orderkey), o_orderkey LIMIT 40)
      UNION ALL SELECT * FROM (SELECT 'complain', o_orderkey, 'Ask why order ' || o_orderkey || ' is so dear' FROM orders WHERE o_totalprice > 1000 ORDER BY md5('4:complain:' || o_orderkey), o_orderkey LIMIT 40))"""


@query(f"WITH {_SAMPLED} SELECT * FROM s")
def sampled_intents(spark, d):
    """Two intents, each with forty orders that it can be about."""
    return cases.sampled_intents(_INTENTS, t(spark, d, "orders"), "o_orderkey", 40, 4)


@query(f"WITH {_SAMPLED}, a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE o_orderstatus END AS now, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) SELECT intent, s.o_orderkey, condition, coalesce(CASE condition WHEN 'cancelled' THEN now = 'cancelled' WHEN 'untouched' THEN now = o_orderstatus ELSE now IS NOT NULL END, false) AS met FROM s LEFT JOIN a USING (o_orderkey) JOIN (VALUES ('cancel', 'cancelled'), ('cancel', 'same customer'), ('complain', 'untouched')) c(intent, condition) USING (intent)")
def intent_outcomes(spark, d):
    """The intents' conditions on orders afterwards: even ones were cancelled, every seventh is gone."""
    after = t(spark, d, "orders").where("o_orderkey % 7 <> 0").withColumn("now", F.when(F.col("o_orderkey") % 2 == 0, "cancelled").otherwise(F.col("o_orderstatus")))
    sampled = cases.sampled_intents(_INTENTS, t(spark, d, "orders"), "o_orderkey", 40, 4)
    return cases.intent_outcomes(_INTENTS, sampled, after, "o_orderkey")


@query("""
WITH runs AS (SELECT o_orderkey AS id, o_custkey AS task, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (SELECT id FROM runs WHERE id = c_custkey) WHEN 1 THEN (SELECT min(id) FROM runs WHERE task = c_custkey AND trial = 1) ELSE (SELECT id FROM runs WHERE n = c_custkey % 50) END AS run FROM customer""")
def found_runs(spark, d):
    """Orders as runs, asked for by id, by task and trial, and by place."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    runs = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w) - 1).alias("trial"))
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("-1"))).otherwise(F.concat(F.lit("#"), (k % 50).cast("string")))
    return cases.find_run(runs, t(spark, d, "customer").select("c_custkey", asked.alias("asked")), "o_orderkey", "o_custkey", "trial").select("c_custkey", "run")
