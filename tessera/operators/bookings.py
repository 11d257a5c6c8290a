"""Bookings as ordered writes: each request in its turn takes seats, balances and certificates, or nothing.

Requests are independent but for what they compete for, and they compete only for
what runs short: seats of a flight, day and cabin, or a gift card's balance, of
which all requests together ask more than there is, and certificates that several
name. Such contended resources tie requests into groups (connected components);
within a group requests are decided one after the other, in a stream sorted by
group and request that keeps no more than the group's contended resources. All
other checks are columns, and what is left of seats and balances is computed set
at a time from the requests that passed.

Checks come in this order, and the first that fails is the request's error: the
user; of each leg in turn that it flies that day, is available, has seats; of each
payment in turn that the user has it and that a gift card or certificate covers
it; that payments add up to the price. A failed request takes nothing. A flight
or card that one request names twice is checked each time against what was there
before the request; a certificate named twice is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.domain import booking_price
from tessera.operators.walk import components
from tessera.sources.staging import written

LEGS_AT, PAYMENTS_AT, SUM_AT = 10, 10_000, 1_000_000  # places of checks in their order
MONEY = "decimal(18,2)"


@dataclass
class Booked:
    decisions: DataFrame  #: request, price, error (null where booked)
    reservations: DataFrame  #: requests that were booked, with their price
    legs: DataFrame  #: request, leg, flight, date, price of booked legs
    payments: DataFrame  #: request, nth, method, amount of booked payments
    seats: DataFrame  #: flights with what is left of their seats
    methods: DataFrame  #: payment methods with what is left; used certificates are gone


def book(requests: DataFrame, legs: DataFrame, payments: DataFrame, users: DataFrame, flights: DataFrame, methods: DataFrame) -> Booked:
    """requests (request, user, cabin, passengers, insured, nonfree_bags), legs (request, leg, flight, date), payments
    (request, nth, method, amount), users (user), flights (flight, date, cabin, status, seats, price), methods (user, method, source, balance).

    Requests are served by ascending request; leg and nth count from 0, legs and payments of a request may be none."""
    requests = requests.select("request", "user", "cabin", "passengers", "insured", "nonfree_bags")
    flown = written(_flown(requests, legs, flights))
    paid = written(_paid(requests, payments, methods))
    asked = written(_asked(requests, users, flown, paid))
    needs = written(_contended(asked, flown, paid))
    decisions = written(_decided(asked, needs))
    ok = decisions.where("error IS NULL").select("request")
    taken = flown.join(ok, "request", "left_semi").groupBy("flight", "date", "cabin").agg(F.sum("passengers").alias("_taken"))
    seats = flights.join(taken, ["flight", "date", "cabin"], "left").withColumn("seats", F.col("seats") - F.coalesce("_taken", F.lit(0))).drop("_taken")
    spent = paid.join(ok, "request", "left_semi").groupBy("user", "method").agg(F.sum("amount").alias("_spent"))
    after = methods.join(spent, ["user", "method"], "left").where(~((F.col("source") == "certificate") & F.col("_spent").isNotNull()))
    left = F.when(F.col("source") == "gift_card", F.col("balance") - F.coalesce("_spent", F.lit(0))).otherwise(F.col("balance"))
    return Booked(
        decisions,
        requests.join(decisions.where("error IS NULL").select("request", "price"), "request"),
        flown.join(ok, "request", "left_semi").select("request", "leg", "flight", "date", "price"),
        paid.join(ok, "request", "left_semi").select("request", "nth", "method", "amount"),
        seats,
        after.withColumn("balance", left).drop("_spent"),
    )


def _flown(requests: DataFrame, legs: DataFrame, flights: DataFrame) -> DataFrame:
    """Legs with the day's status, seats and price; error and at: the check that fails whatever others book."""
    j = legs.join(requests.select("request", "cabin", "passengers"), "request").join(flights, ["flight", "date", "cabin"], "left")
    error = F.when(F.col("status").isNull(), "flight not found").when(F.col("status") != "available", "flight not available").when(F.col("seats") < F.col("passengers"), "not enough seats")
    return j.withColumn("error", error).withColumn("at", LEGS_AT + F.col("leg"))


def _paid(requests: DataFrame, payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Payments with their method; a certificate's second use in a request is an error of its own."""
    j = payments.join(requests.select("request", "user"), "request").join(methods, ["user", "method"], "left")
    twice = (F.col("source") == "certificate") & (F.col("nth") > F.min("nth").over(Window.partitionBy("request", "method")))
    error = F.when(F.col("source").isNull(), "payment method not found").when(F.col("source").isin("gift_card", "certificate") & (F.col("balance") < F.col("amount")), "not enough balance").when(twice, "certificate used twice")
    missing = F.col("source").isNull()
    return j.withColumn("error", error).withColumn("at", PAYMENTS_AT + 2 * F.col("nth") + F.when(missing, 0).otherwise(1))


def _asked(requests: DataFrame, users: DataFrame, flown: DataFrame, paid: DataFrame) -> DataFrame:
    """Requests with their price and the first check (error, at) that fails whatever others book."""
    first = F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("at")))
    at = F.min(F.when(F.col("error").isNotNull(), F.col("at")))
    by_leg = flown.groupBy("request").agg(F.sum("price").alias("_fares"), first.alias("_leg_error"), at.alias("_leg_at"))
    by_payment = paid.groupBy("request").agg(F.sum("amount").alias("_sum"), first.alias("_pay_error"), at.alias("_pay_at"))
    known = users.select("user").distinct().withColumn("_known", F.lit(True))
    j = requests.join(by_leg, "request", "left").join(by_payment, "request", "left").join(known, "user", "left")
    price = booking_price(F.coalesce("_fares", F.lit(0)), F.col("passengers"), F.col("insured"), F.col("nonfree_bags"))
    short = F.col("_sum").isNull() & (price != 0) | (F.col("_sum") != price)
    error = F.when(F.col("_known").isNull(), "user not found").otherwise(F.coalesce("_leg_error", "_pay_error", F.when(short, "payment does not add up")))
    place = F.when(F.col("_known").isNull(), 0).otherwise(F.coalesce("_leg_at", "_pay_at", F.when(short, SUM_AT)))
    return j.select("request", price.alias("price"), error.alias("error"), place.alias("at"))


def _contended(asked: DataFrame, flown: DataFrame, paid: DataFrame) -> DataFrame:
    """(request, at, resource, need, there, message): checks on what may run short, for all requests that look at it."""
    able = asked.where("error IS NULL").select("request")
    seat = flown.where("status = 'available'").select("request", "at", F.concat_ws("|", F.lit("seat"), "flight", "date", "cabin").alias("resource"), F.col("passengers").cast(MONEY).alias("need"), F.col("seats").cast(MONEY).alias("there"), F.lit("not enough seats").alias("message"))
    ticket = F.col("source") == "certificate"
    money = paid.where("source IN ('gift_card', 'certificate')").select(
        "request",
        # a used certificate is missed before its amount is looked at
        F.when(ticket, PAYMENTS_AT + 2 * F.col("nth")).otherwise(F.col("at")).alias("at"),
        F.concat_ws("|", F.lit("paid"), "user", "method").alias("resource"),
        F.when(ticket, 1).otherwise(F.col("amount")).cast(MONEY).alias("need"),
        F.when(ticket, 1).otherwise(F.col("balance")).cast(MONEY).alias("there"),
        F.when(ticket, "payment method not found").otherwise("not enough balance").alias("message"),
    )
    uses = seat.unionByName(money)
    # what may pass takes; what fails in any case only looks, and may find too little where the others leave enough for each other
    can = uses.join(able.withColumn("_can", F.lit(True)), "request", "left")
    takes, looks = F.coalesce(F.sum(F.when(F.col("_can"), F.col("need"))), F.lit(0)), F.coalesce(F.max(F.when(F.col("_can").isNull(), F.col("need"))), F.lit(0))
    short = can.groupBy("resource").agg(takes.alias("_takes"), looks.alias("_looks"), F.first("there").alias("_there")).where("_takes > 0 AND _takes + _looks > _there").select("resource")
    return uses.join(short, "resource", "left_semi")


def _decided(asked: DataFrame, needs: DataFrame) -> DataFrame:
    """(request, price, error): requests without contended checks as they are, the others in their turn."""
    checks = written(needs.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("at", "resource", "need", "there", "message"))).alias("checks")))
    # a request ties its resources to its first one; groups are found among resources, however many requests there are
    head = F.col("checks")[0]["resource"]
    edges = checks.select(head.alias("a"), F.explode("checks.resource").alias("b")).distinct()
    group = components(edges, edges.select(F.col("b").alias("node")))
    queue = asked.join(checks, "request").withColumn("node", head).join(group, "node").select("component", "request", "price", "error", "at", "checks")
    schema = f"request {asked.schema['request'].dataType.simpleString()}, price {asked.schema['price'].dataType.simpleString()}, error string"

    def run(frames):
        now, left = None, {}
        for frame in frames:
            errors = []
            for row in frame.itertuples():
                if row.component != now:
                    now, left = row.component, {}
                fixed = row.error if isinstance(row.error, str) else None
                limit = row.at if fixed else float("inf")
                late = next((c["message"] for c in row.checks if c["at"] < limit and left.get(c["resource"], c["there"]) < c["need"]), None)
                errors.append(late or fixed)
                if errors[-1] is None:
                    for c in row.checks:
                        left[c["resource"]] = left.get(c["resource"], c["there"]) - c["need"]
            yield pd.DataFrame({"request": frame["request"], "price": frame["price"], "error": errors})

    served = queue.repartition("component").sortWithinPartitions("component", "request").mapInPandas(run, schema)
    alone = asked.join(checks.select("request"), "request", "left_anti").select("request", "price", "error")
    return alone.unionByName(served)
