"""Ordered writes and replays on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import bookings, environments, evaluate
from tessera.operators.environments import Environment, Toolkit, tool
from tessera.plans.queries import query, t
from tessera.sources.staging import written

# -- bookings ----------------------------------------------------------------

# Each order asks for seats on flights of its customer's nation, which is the user that pays: by card, by a gift card
# that runs out, by a certificate that one request can use. Some ask for an unknown user, flight or card, some pay too much.
_REQUESTS = """
q AS (
  SELECT o_orderkey AS request, CASE WHEN o_orderkey % 19 = 0 THEN 99 ELSE c_nationkey END AS usr, c_nationkey AS nation,
         1 + o_orderkey % 3 AS people, o_orderkey % 4 = 0 AS insured, o_orderkey % 2 AS bags,
         o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 AS wants_a, o_orderkey % 5 = 0 OR o_orderkey % 2 = 1 AS wants_b, o_orderkey % 17 = 0 AS wants_x,
         CASE WHEN o_orderkey % 13 = 0 THEN 'x' WHEN o_orderkey % 7 = 0 THEN 't' WHEN o_orderkey % 7 <= 2 THEN 'g' ELSE 'c' END AS way
  FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (
  SELECT *, (CASE WHEN wants_a THEN 100 ELSE 0 END + CASE WHEN wants_b THEN 150 ELSE 0 END) * people + CASE WHEN insured THEN 30 * people ELSE 0 END + 50 * bags AS price FROM q)"""


def _booked(spark, d) -> bookings.Booked:
    key = F.col("o_orderkey")
    q = written(
        t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(key.alias("request"), F.when(key % 19 == 0, 99).otherwise(F.col("c_nationkey")).cast("bigint").alias("user"), F.col("c_nationkey").cast("bigint").alias("nation"), F.lit("economy").alias("cabin"), (1 + key % 3).cast("int").alias("passengers"), (key % 4 == 0).alias("insured"), (key % 2).cast("int").alias("nonfree_bags"))
    )
    r = F.col("request")
    flight = lambda letter, wanted: F.when(wanted, F.concat(F.lit(letter), F.col("nation").cast("string")))
    wanted = F.array_compact(F.array(flight("a", (r % 5 == 0) | (r % 2 == 0)), flight("b", (r % 5 == 0) | (r % 2 == 1)), flight("x", r % 17 == 0)))
    legs = q.select("request", F.posexplode(wanted).alias("leg", "flight"), F.lit("2024-05-01").alias("date"))
    fares = F.when((r % 5 == 0) | (r % 2 == 0), 100).otherwise(0) + F.when((r % 5 == 0) | (r % 2 == 1), 150).otherwise(0)
    price = fares * F.col("passengers") + F.when(F.col("insured"), 30 * F.col("passengers")).otherwise(0) + 50 * F.col("nonfree_bags")
    way = F.when(r % 13 == 0, "x").when(r % 7 == 0, "t").when(r % 7 <= 2, "g").otherwise("c")
    pay = lambda method, amount: F.struct(method.alias("method"), amount.cast("bigint").alias("amount"))
    one = F.array(pay(way, price + F.when(r % 11 == 0, 1).otherwise(0)))
    two = F.array(pay(F.lit("t"), F.least(price, F.lit(80))), pay(F.lit("c"), F.greatest(price - 80, F.lit(0)) + F.when(r % 11 == 0, 1).otherwise(0)))
    payments = q.select("request", F.posexplode(F.when(way == "t", two).otherwise(one)).alias("nth", "p")).select("request", "nth", "p.method", "p.amount")
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("user"))
    days = n.select(F.col("user"), F.inline(F.array(F.struct(F.lit("a").alias("l"), F.lit(60).alias("seats"), F.lit(100).alias("price")), F.struct(F.lit("b").alias("l"), F.lit(45).alias("seats"), F.lit(150).alias("price")))))
    flights = days.select(F.concat("l", F.col("user").cast("string")).alias("flight"), F.lit("2024-05-01").alias("date"), F.lit("economy").alias("cabin"), F.when((F.col("user") == 4) & (F.col("l") == "b"), "delayed").otherwise("available").alias("status"), "seats", "price")
    cards = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("source"), F.lit(b).cast("bigint").alias("balance")) for m, s, b in (("g", "gift_card", 2000), ("t", "certificate", 100), ("c", "credit_card", 0))])
    return bookings.book(q, legs, payments, n, flights, n.select("user", F.inline(cards)))


# One step of the recursion decides the next request of every nation.
_TURNS = f"""
WITH RECURSIVE {_REQUESTS},
n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY request) AS k FROM p),
steps AS (
  SELECT CAST(n_nationkey AS BIGINT) AS nation, 0::BIGINT AS k, NULL::BIGINT AS request, 0::BIGINT AS price, 'start' AS error, 60::BIGINT AS a, 45::BIGINT AS b, 2000::BIGINT AS g, 1::BIGINT AS cert FROM nation
  UNION ALL
  SELECT nation, k, request, price, error,
         a - CASE WHEN error IS NULL AND wants_a THEN people ELSE 0 END, b - CASE WHEN error IS NULL AND wants_b THEN people ELSE 0 END,
         g - CASE WHEN error IS NULL AND way = 'g' THEN price ELSE 0 END, cert - CASE WHEN error IS NULL AND way = 't' THEN 1 ELSE 0 END
  FROM (
    SELECT n.*, s.a, s.b, s.g, s.cert,
      CASE WHEN usr = 99 THEN 'user not found'
           WHEN wants_a AND s.a < people THEN 'not enough seats'
           WHEN wants_b AND s.nation = 4 THEN 'flight not available'
           WHEN wants_b AND s.b < people THEN 'not enough seats'
           WHEN wants_x THEN 'flight not found'
           WHEN way = 'x' OR way = 't' AND s.cert = 0 THEN 'payment method not found'
           WHEN way = 'g' AND s.g < n.price + CASE WHEN n.request % 11 = 0 THEN 1 ELSE 0 END THEN 'not enough balance'
           WHEN n.request % 11 = 0 THEN 'payment does not add up' END AS error
    FROM steps s JOIN n ON n.nation = s.nation AND n.k = s.k + 1) x)
"""


@query(f"{_TURNS} SELECT request, CASE WHEN NOT wants_x THEN s.price END::BIGINT AS price, error FROM steps s JOIN p USING (request) WHERE s.k > 0")
def bookings_in_order(spark, d):
    """Every order as a booking: the price asked (null where a flight is unknown), and why it failed."""
    flown = _booked(spark, d).decisions
    return flown.select("request", F.when(F.col("request") % 17 != 0, F.col("price")).cast("bigint").alias("price"), "error")


@query(f"""{_TURNS}
, last AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY nation ORDER BY k DESC) = 1)
SELECT 'a' || nation AS name, a AS amount FROM last UNION ALL SELECT 'b' || nation, b FROM last
UNION ALL SELECT 'g' || nation, g FROM last UNION ALL SELECT 'c' || nation, 0 FROM last UNION ALL SELECT 't' || nation, 100 FROM last WHERE cert = 1""")
def after_bookings(spark, d):
    """Seats, balances and certificates that bookings leave."""
    b = _booked(spark, d)
    seats = b.seats.select(F.col("flight").alias("name"), F.col("seats").cast("bigint").alias("amount"))
    return seats.unionByName(b.methods.select(F.concat("method", F.col("user").cast("string")).alias("name"), F.col("balance").cast("bigint").alias("amount")))


# -- environments ------------------------------------------------------------


class _Looking(Toolkit):
    @tool("read")
    def view(state):
        return state.get("clicks", 0)

    @tool("generic")
    def click(state):
        state["clicks"] = state.get("clicks", 0) + 1
        return "ok"


class _Shop(_Looking):
    @tool("write")
    def signup(state):
        state["signed"] = True
        return {"signed": True, "since": None}

    @tool("write")
    def purchase(state, k):
        if not state.get("signed"):
            raise ValueError("not signed up")
        state["spent"] = state.get("spent", 0) + k
        return [state["spent"]]


class _Phone(Toolkit):
    @tool("write")
    def report(state, k):
        if k < 10:
            raise ValueError("too small to report")
        state["reports"] = state.get("reports", 0) + 1
        return "ok"


_ENV, _SOLO = Environment(_Shop, _Phone), Environment(_Shop, _Phone, solo=True)
_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"


def _calls(spark, d):
    """Events as calls: errors are reports that the user's side makes, the largest go to a tool that nobody has."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    name = F.when((F.col("event_type") == "error") & (k >= 90), "vanish").when(F.col("event_type") == "error", "report").otherwise(F.col("event_type"))
    args = F.when(name.isin("purchase", "report"), F.to_json(F.struct(k.alias("k")))).otherwise("{}")
    return t(spark, d, "events").select("user_id", "event_id", "event_type", k.alias("k"), name.alias("name"), F.when(name == "report", "user").otherwise("assistant").alias("requestor"), args.alias("arguments"))


@query(f"""
SELECT event_id, mode,
  CASE WHEN event_type = 'error' AND k >= 90 THEN 'Error: Tool ''vanish'' not found.'
       WHEN event_type = 'error' AND event_id % 2 = 1 AND mode = 'both' THEN 'Error: Tool ''report'' not found.'
       WHEN event_type = 'error' AND event_id % 2 = 0 AND mode = 'solo' THEN 'Error: User tool calls are not allowed in solo mode'
       WHEN event_type = 'error' AND k < 10 THEN 'Error: too small to report'
       WHEN event_type IN ('error', 'click') THEN 'ok'
       WHEN event_type = 'signup' THEN '{{"signed": "True", "since": null}}'
       WHEN event_type = 'purchase' THEN 'Error: not signed up' ELSE '"0"' END AS content,
  event_type = 'purchase' OR event_type = 'error' AND (k >= 90 OR k < 10 OR event_id % 2 = CASE mode WHEN 'both' THEN 1 ELSE 0 END) AS error
FROM (SELECT *, {_K} AS k FROM events), (VALUES ('both'), ('solo')) m(mode)
""")
def dispatched_calls(spark, d):
    """Each event as a call on a fresh state; reports of odd events are asked for by the assistant, which alone has the user's tools in solo mode."""
    calls = _calls(spark, d).withColumn("requestor", F.when((F.col("name") == "report") & (F.col("event_id") % 2 == 0), "user").otherwise("assistant"))
    modes = [environments.responses(calls, env, {}, "event_id").withColumn("mode", F.lit(mode)) for mode, env in (("both", _ENV), ("solo", _SOLO))]
    return modes[0].unionByName(modes[1]).select("event_id", "mode", "content", "error")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'generic' ELSE 'write' END AS kind FROM events) GROUP BY kind")
def calls_by_kind(spark, d):
    """How many events call a tool of each kind; tools that a toolkit inherits count as its own."""
    rows = t(spark, d, "events").select(F.when(F.col("event_type") == "error", "user").otherwise("assistant").alias("requestor"), F.when(F.col("event_type") == "error", "report").otherwise(F.col("event_type")).alias("tool"))
    return evaluate.with_tool_kind(rows, _ENV.tool_rows(spark), "requestor", "tool").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Sums over a user's events in order: whether signed up before, clicks so far.
_RUN = f"""
e AS (SELECT *, {_K} AS k, row_number() OVER w - 1 AS i, count(*) FILTER (event_type = 'click') OVER w AS clicks,
             coalesce(bool_or(event_type = 'signup') OVER w, false) AS signed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, event_type = 'purchase' AND signed AS pays, event_type = 'error' AND k < 90 AND k >= 10 AS reports FROM e),
g AS (SELECT *, coalesce(bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id), false) AS signed2 FROM (SELECT *, {_K} AS k FROM events WHERE event_id % 40 <> 3))"""


@query(f"""
WITH {_RUN},
ran AS (SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'purchase' AND NOT signed OR event_type = 'error' AND NOT reports) AS n_errors,
               min(i) FILTER (event_type = 'view' AND event_id % 50 = 7) AS mismatch,
               count(*) FILTER (event_type = 'click') AS clicks, coalesce(sum(k) FILTER (pays), 0) AS spent, bool_or(signed) AS signed, count(*) FILTER (reports) AS reported, bool_or(pays) AS paid FROM r GROUP BY user_id),
gold AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, coalesce(sum(k) FILTER (event_type = 'purchase' AND signed2), 0) AS spent, bool_or(signed2) AS signed,
                count(*) FILTER (event_type = 'error' AND k < 90 AND k >= 10) AS reported, coalesce(bool_or(event_type = 'purchase' AND signed2), false) AS paid FROM g GROUP BY user_id)
SELECT user_id, n_calls, n_errors, mismatch, agent_match, user_match, agent_match AND user_match AS db_match
FROM (SELECT r.*, r.clicks = coalesce(g.clicks, 0) AND r.spent = coalesce(g.spent, 0) AND r.signed = coalesce(g.signed, false) AND r.paid = coalesce(g.paid, false) AS agent_match, r.reported = coalesce(g.reported, 0) AS user_match
      FROM ran r LEFT JOIN gold g USING (user_id))
""")
def db_match(spark, d):
    """Recorded calls and gold actions replayed from one start. Gold leaves out one event in forty; some views recorded a wrong number."""
    calls = _calls(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    seen = F.count_if(F.col("event_type") == "click").over(w) + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)
    calls = calls.withColumn("expected", F.when(F.col("name") == "view", F.concat(F.lit('"'), seen.cast("string"), F.lit('"'))))
    gold = calls.where("event_id % 40 <> 3")
    found = environments.gold_matches(calls.withColumn("run", F.lit(0)), gold, _ENV, {}, "user_id", "run", "event_id")
    return found.select("user_id", "n_calls", "n_errors", "mismatch", "agent_match", "user_match", "db_match")


@query(f"""
WITH {_RUN}, s AS (SELECT user_id, min(event_id) FILTER (event_type = 'error' AND k >= 90) AS stop FROM e GROUP BY user_id),
done AS (SELECT r.*, s.stop FROM r JOIN s USING (user_id) WHERE s.stop IS NULL OR event_id <= s.stop),
ended AS (
  SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'purchase' AND NOT signed OR event_type = 'error' AND k < 10) AS n_domain_errors, any_value(stop) AS stopped_at,
         count(*) FILTER (event_type = 'click') AS clicks, sum(k) FILTER (pays) AS spent, bool_or(signed) AS signed, count(*) FILTER (reports) AS reported FROM done GROUP BY user_id)
SELECT user_id, n_calls, n_domain_errors, stopped_at, CASE WHEN stopped_at IS NOT NULL THEN 'Error: Tool ''vanish'' not found.' END AS content, stopped_at IS NULL AS is_valid,
       sha256(sha256('{{' || concat_ws(', ', '"base": "d' || user_id % 3 || '"', CASE WHEN clicks > 0 THEN '"clicks": ' || clicks END, CASE WHEN signed THEN '"signed": true' END, CASE WHEN spent IS NOT NULL THEN '"spent": ' || spent END) || '}}')
              || sha256(CASE WHEN reported > 0 THEN '{{"reports": ' || reported || '}}' ELSE '{{}}' END)) AS reached,
       sha256(sha256('{{"base": "d' || user_id % 3 || '"}}') || sha256('{{}}')) AS restored
FROM ended
""")
def executed_chains(spark, d):
    """A chain for each user on one of three states: stopped at the first missing tool, errors of the domain passed over, rolled back after."""
    calls = _calls(spark, d).withColumn("shard", F.col("user_id") % 3)
    starts = calls.select("shard").distinct().withColumn("data", F.to_json(F.struct(F.struct(F.concat(F.lit("d"), F.col("shard").cast("string")).alias("base")).alias("assistant"))))
    return environments.executed_chains(calls, _ENV, {}, "shard", "user_id", "event_id", starts=starts).drop("shard")
