"""Retail orders: details as documents, and writes on orders in their turn.

Writes of one user touch that user's orders and gift cards alone, so users are
independent: Spark deals users to tasks and sorts each user's cards, orders, items
and requests, and a task folds the stream, one user's touched rows at a time. What
was not asked about is never sent there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import dealt, written

PENDING, DELIVERED, CHANGED = "pending", "delivered", "pending (item modified)"
#: Reasons that a cancellation takes: fixed values.
REASONS = ("no longer needed", "ordered by mistake")
MONEY = "decimal(18,2)"


def order_details(orders: DataFrame, items: DataFrame, payments: DataFrame, key: str) -> DataFrame:
    """orders with their items and payments as arrays of structs, sorted; empty arrays where there are none."""
    out = orders
    for name, rows in (("items", items), ("payments", payments)):
        own = [c for c in rows.columns if c != key]
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        kind = f"array<{grouped.schema[name].dataType.elementType.simpleString()}>"
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def product_details(products: DataFrame, variants: DataFrame, key: str, item: str) -> DataFrame:
    """products with a map from each variant's item to its other columns."""
    own = [c for c in variants.columns if c not in (key, item)]
    grouped = variants.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(item).alias("key"), F.struct(*own).alias("value"))))).alias("variants"))
    return products.join(grouped, key, "left")


@dataclass
class Written:
    results: DataFrame  #: request, error (null where written), difference (what was paid more, or less)
    orders: DataFrame  #: orders with status, address, method
    items: DataFrame  #: orders' items after changes
    cards: DataFrame  #: methods with balances
    ledger: DataFrame  #: order, request, method, amount: payments and (negative) refunds that were added


_OUT = "kind string, request bigint, order bigint, user bigint, place int, item bigint, method string, status string, address string, amount decimal(18,2), error string"


def written_orders(orders: DataFrame, items: DataFrame, stock: DataFrame, cards: DataFrame, requests: DataFrame) -> Written:
    """orders (order, user, status, address, method, paid), items (order, place, item), stock (item, product, price, available),
    cards (user, method, source, balance), requests (request, order, action, items, new_items, method, address, reason).

    Requests are served by ascending request. action and its checks, the first that fails is the error:

    * cancel: the order is pending, the reason is known. Refunds what was paid, to a gift card at once.
    * modify_address: pending. * modify_payment: pending, the user has the method, it is another one, a gift card covers what was paid.
    * modify_items: pending and never so modified; exchange: delivered; both: all items are in the order, lists pair, each new
      item is of the same product and available, the user has the method, a gift card covers the difference. modify_items puts the new items in.
    * return: delivered, all items are in the order, the method is a gift card or the one that paid; refunds come later.
    """
    # partitions by their rows, so that a task's memory does not grow with the tables
    n_requests, n_stock = requests.count(), stock.count()
    n_orders = orders.count() + n_requests
    requests, orders, items = (dealt(df, n_orders, "order") for df in (requests, orders, items))
    asked = requests.join(orders.select("order", F.col("user").alias("_user")), "order", "left")
    known = asked.where("_user IS NOT NULL")
    missing = asked.where("_user IS NULL").select("request", F.lit("order not found").alias("error"))
    touched = known.select("order", F.col("_user").alias("user")).distinct()
    # the products and prices of all items that requests name, beside the request
    named = known.select("request", F.posexplode(F.concat(F.coalesce("items", F.array().cast("array<bigint>")), F.coalesce("new_items", F.array().cast("array<bigint>")))).alias("at", "item"))
    n_named = 2 * n_requests + n_stock
    named = dealt(dealt(named, n_named, "item").join(dealt(stock, n_named, "item"), "item", "left"), 2 * n_requests, "request")
    facts = named.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("at", "item", "product", F.col("price").cast(MONEY).alias("price"), "available"))).alias("facts"))
    rows = [
        cards.join(touched.select("user").distinct(), "user", "left_semi").select(F.lit(0).alias("tag"), "user", "method", "source", F.col("balance").cast(MONEY).alias("amount")),
        orders.join(touched.select("order"), "order", "left_semi").select(F.lit(1).alias("tag"), "user", "order", "status", "address", "method", F.col("paid").cast(MONEY).alias("amount")),
        items.join(touched, "order").select(F.lit(2).alias("tag"), "user", "order", "place", "item"),
        dealt(known, 2 * n_requests, "request").join(facts, "request", "left").select(F.lit(3).alias("tag"), F.col("_user").alias("user"), "request", "order", "action", "items", "new_items", "method", "address", "reason", "facts"),
    ]
    stream = rows[0]
    for more in rows[1:]:
        stream = stream.unionByName(more, allowMissingColumns=True)
    # ids that a kind of row lacks are 0, so that none turns into a float on the way
    stream = stream.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("request", "order", "place", "item")})
    served = written(dealt(stream, n_requests + 2 * n_orders, "user").sortWithinPartitions("user", "tag", "request", "order", "place").mapInPandas(_serve, _OUT))
    part = lambda kind, *columns: served.where(F.col("kind") == kind).select(*columns)
    results = part("result", "request", "error", F.col("amount").alias("difference"))
    return Written(
        results.unionByName(missing, allowMissingColumns=True),
        orders.join(touched, "order", "left_anti").select("order", "user", "status", "address", "method").unionByName(part("order", "order", "user", "status", "address", "method")),
        items.join(touched, "order", "left_anti").select("order", "place", "item").unionByName(part("item", "order", F.col("place").cast(items.schema["place"].dataType).alias("place"), "item")),
        cards.join(touched.select("user").distinct(), "user", "left_anti").select("user", "method", F.col("balance").cast(MONEY).alias("balance")).unionByName(part("card", "user", "method", F.col("amount").alias("balance"))),
        part("paid", "order", "request", "method", "amount"),
    )


class _User:
    """One user's cards and touched orders while requests are served."""

    def __init__(self) -> None:
        self.cards: dict[str, list] = {}
        self.orders: dict[int, dict] = {}
        self.out: list[dict] = []

    def credit(self, method: str, amount: Decimal) -> None:
        if method in self.cards and self.cards[method][0] == "gift_card":
            self.cards[method][1] += amount

    def pay(self, r, method: str, amount: Decimal) -> None:
        self.out.append({"kind": "paid", "order": r.order, "request": r.request, "method": method, "amount": amount})
        self.credit(method, -amount)

    def short(self, method: str, amount: Decimal) -> bool:
        return self.cards[method][0] == "gift_card" and self.cards[method][1] < amount

    def lacks(self, order: dict, wanted: list[int]) -> bool:
        held = [i for _, i in order["items"]]
        return any(wanted.count(i) > held.count(i) for i in wanted)

    def serve(self, r) -> tuple[str | None, Decimal | None]:
        o, none = self.orders[r.order], Decimal(0)
        if r.action in ("cancel", "modify_address", "modify_payment", "modify_items") and not o["status"].startswith(PENDING) or r.action == "modify_items" and o["status"] != PENDING:
            return "order is not pending", None
        if r.action in ("exchange", "return") and o["status"] != DELIVERED:
            return "order is not delivered", None
        if r.action == "cancel":
            if r.reason not in REASONS:
                return "unknown reason", None
            o["status"] = "cancelled"
            self.pay(r, o["method"], -o["paid"])
            return None, -o["paid"]
        if r.action == "modify_address":
            o["address"] = r.address
            return None, none
        if r.action == "modify_payment":
            if r.method not in self.cards:
                return "payment method not found", None
            if r.method == o["method"]:
                return "payment method is the same", None
            if self.short(r.method, o["paid"]):
                return "gift card balance is not enough", None
            self.pay(r, r.method, o["paid"])
            self.pay(r, o["method"], -o["paid"])
            o["method"] = r.method
            return None, none
        if r.action not in ("modify_items", "exchange", "return"):
            return "unknown action", None
        old, new = [int(i) for i in r.items_], [int(i) for i in r.new_items_]
        if self.lacks(o, old):
            return "item not found", None
        if r.action == "return":
            if r.method not in self.cards:
                return "payment method not found", None
            if self.cards[r.method][0] != "gift_card" and r.method != o["method"]:
                return "payment method cannot take the refund", None
            o["status"] = "return requested"
            return None, none
        if len(old) != len(new):
            return "items do not pair", None
        facts = [{k: f[k] for k in ("product", "price", "available")} for f in r.facts_]
        before, after = facts[: len(old)], facts[len(old) :]
        if any(a["product"] != b["product"] for a, b in zip(before, after, strict=True)):
            return "not the same product", None
        if any(not b["available"] for b in after):
            return "not available", None
        if r.method not in self.cards:
            return "payment method not found", None
        difference = sum((b["price"] - a["price"] for a, b in zip(before, after, strict=True)), none)
        if self.short(r.method, difference):
            return "gift card balance is not enough", None
        if r.action == "exchange":
            o["status"] = "exchange requested"
            return None, difference
        for a, b in zip(old, new, strict=True):
            at = next(k for k, (_, i) in enumerate(o["items"]) if i == a)
            o["items"][at] = (o["items"][at][0], b)
        if difference:
            self.pay(r, r.method, difference)
        o["status"], o["paid"] = CHANGED, o["paid"] + difference
        return None, difference

    def rows(self, user: int) -> list[dict]:
        self.out += [{"kind": "card", "user": user, "method": m, "amount": b} for m, (_, b) in self.cards.items()]
        for key, o in self.orders.items():
            self.out.append({"kind": "order", "order": key, "user": user, "status": o["status"], "address": o["address"], "method": o["method"]})
            self.out += [{"kind": "item", "order": key, "place": p, "item": i} for p, i in o["items"]]
        return self.out


_COLUMNS = [f.split()[0] for f in _OUT.split(", ")]


def _serve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, user = None, _User()

    def made(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_COLUMNS)
        return out.astype(dict.fromkeys(("request", "order", "user", "place", "item"), "Int64"))

    for frame in frames:
        done: list[dict] = []
        as_list = lambda v: [] if v is None or v is pd.NA or isinstance(v, float) else list(v)
        frame = frame.rename(columns={"items": "items_", "new_items": "new_items_", "facts": "facts_"})
        for c in ("items_", "new_items_", "facts_"):
            frame[c] = frame[c].map(as_list)
        for r in frame.itertuples():
            if r.user != now:
                if now is not None:
                    done += user.rows(now)
                now, user = r.user, _User()
            if r.tag == 0:
                user.cards[r.method] = [r.source, r.amount]
            elif r.tag == 1:
                user.orders[r.order] = {"status": r.status, "address": r.address, "method": r.method, "paid": r.amount, "items": []}
            elif r.tag == 2:
                user.orders[r.order]["items"].append((r.place, r.item))
            else:
                error, difference = user.serve(r)
                user.out.append({"kind": "result", "request": r.request, "amount": difference, "error": error})
        if done:
            yield made(done)
    if now is not None:
        yield made(user.rows(now))
