"""Writes on retail orders, worked by hand."""

from decimal import Decimal as D

from tessera.operators import retail

ORDERS = [(1, 7, "pending", "here", "g", 30), (2, 7, "pending", "here", "c", 50), (3, 7, "delivered", "here", "c", 20), (4, 8, "pending", "there", "c", 10), (5, 8, "delivered", "there", "g", 5), (6, 9, "pending", "far", "c", 1)]
ITEMS = [(1, 0, 10), (1, 1, 10), (1, 2, 20), (2, 0, 20), (3, 0, 30), (3, 1, 31), (4, 0, 10), (5, 0, 31), (6, 0, 10)]
STOCK = [(10, 1, 10, True), (11, 1, 15, True), (12, 1, 500, True), (13, 1, 10, False), (20, 2, 10, True), (21, 2, 8, True), (30, 3, 10, True), (31, 3, 10, True), (32, 3, 12, True)]
CARDS = [(7, "g", "gift_card", 20), (7, "c", "credit_card", 0), (8, "g", "gift_card", 0), (8, "c", "credit_card", 0), (9, "c", "credit_card", 0)]
REQUESTS = [
    # (request, order, action, items, new_items, method, address, reason), error, difference
    ((1, 1, "modify_items", [10, 10], [11, 11], "g", None, None), None, 10),
    ((2, 1, "modify_items", [20], [21], "g", None, None), "order is not pending", None),
    ((3, 1, "modify_address", None, None, None, "new", None), None, 0),
    ((4, 2, "modify_payment", None, None, "g", None, None), "gift card balance is not enough", None),
    ((5, 2, "modify_payment", None, None, "c", None, None), "payment method is the same", None),
    ((6, 2, "modify_payment", None, None, "x", None, None), "payment method not found", None),
    ((7, 1, "cancel", None, None, None, None, "bored"), "unknown reason", None),
    ((8, 1, "cancel", None, None, None, None, "no longer needed"), None, -40),
    ((9, 2, "modify_payment", None, None, "g", None, None), None, 0),
    ((10, 3, "exchange", [30, 31], [32], "c", None, None), "items do not pair", None),
    ((11, 3, "exchange", [30], [20], "c", None, None), "not the same product", None),
    ((12, 3, "exchange", [20], [21], "c", None, None), "item not found", None),
    ((13, 3, "exchange", [30, 31], [32, 32], "c", None, None), None, 4),
    ((14, 3, "return", [30], None, "c", None, None), "order is not delivered", None),
    ((15, 4, "modify_items", [10], [13], "c", None, None), "not available", None),
    ((16, 4, "modify_items", [10], [11], "g", None, None), "gift card balance is not enough", None),
    ((17, 5, "return", [31], None, "c", None, None), "payment method cannot take the refund", None),
    ((18, 5, "return", [31, 31], None, "g", None, None), "item not found", None),
    ((19, 5, "return", [31], None, "g", None, None), None, 0),
    ((20, 99, "cancel", None, None, None, None, "no longer needed"), "order not found", None),
    ((21, 4, "paint", None, None, None, None, None), "unknown action", None),
    ((22, 5, "cancel", None, None, None, None, "no longer needed"), "order is not pending", None),
]


def run(spark, requests):
    return retail.written_orders(
        spark.createDataFrame(ORDERS, "order bigint, user bigint, status string, address string, method string, paid int"),
        spark.createDataFrame(ITEMS, "order bigint, place int, item bigint").repartition(3),
        spark.createDataFrame(STOCK, "item bigint, product int, price int, available boolean"),
        spark.createDataFrame(CARDS, "user bigint, method string, source string, balance int"),
        spark.createDataFrame(requests, "request bigint, order bigint, action string, items array<bigint>, new_items array<bigint>, method string, address string, reason string").repartition(4),
    )


def test_writes_in_their_turn(spark):
    got = run(spark, [r for r, _, _ in REQUESTS])
    assert {r.request: (r.error, r.difference) for r in got.results.collect()} == {r[0]: (e, None if d is None else D(d)) for r, e, d in REQUESTS}
    orders = {r.order: (r.status, r.address, r.method) for r in got.orders.collect()}
    assert orders == {1: ("cancelled", "new", "g"), 2: ("pending", "here", "g"), 3: ("exchange requested", "here", "c"), 4: ("pending", "there", "c"), 5: ("return requested", "there", "g"), 6: ("pending", "far", "c")}
    items = sorted((r.order, r.place, r.item) for r in got.items.collect())
    assert items == sorted([(1, 0, 11), (1, 1, 11), *ITEMS[2:]])
    # 20 - 10 for items, + 40 back, - 50 for the other order's payment
    assert {(r.user, r.method): r.balance for r in got.cards.collect()} == {(7, "g"): 0, (7, "c"): 0, (8, "g"): 0, (8, "c"): 0, (9, "c"): 0}
    ledger = sorted((r.request, r.order, r.method, r.amount) for r in got.ledger.collect())
    assert ledger == [(1, 1, "g", 10), (8, 1, "g", -40), (9, 2, "c", -50), (9, 2, "g", 50)]


def test_no_requests_change_nothing(spark):
    got = run(spark, [REQUESTS[19][0]])
    assert sorted(r.order for r in got.orders.collect()) == [1, 2, 3, 4, 5, 6] and got.items.count() == len(ITEMS) and got.ledger.count() == 0
    assert [(r.request, r.error) for r in got.results.collect()] == [(20, "order not found")]


def test_details(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "order bigint, status string")
    items = spark.createDataFrame([(1, 5, 2), (1, 4, 1)], "order bigint, item bigint, price int")
    paid = spark.createDataFrame([(2, "c", 3)], "order bigint, method string, amount int")
    got = {r.order: ([tuple(x) for x in r["items"]], [tuple(x) for x in r.payments]) for r in retail.order_details(orders, items, paid, "order").collect()}
    assert got == {1: ([(4, 1), (5, 2)], []), 2: ([], [("c", 3)])}
    products = retail.product_details(spark.createDataFrame([(1, "cup")], "product bigint, name string"), spark.createDataFrame([(1, 9, True)], "product bigint, item bigint, available boolean"), "product", "item").head()
    assert {k: tuple(v) for k, v in products.variants.items()} == {9: (True,)}
