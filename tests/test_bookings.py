"""Bookings set at a time and by groups, against one request after the other."""

import random

from tessera.operators import bookings


def slow_book(requests, legs, payments, users, flights, methods):
    seats = {(f, d, c): [status, n, price] for f, d, c, status, n, price in flights}
    cards = {(u, m): [source, balance] for u, m, source, balance in methods}
    out = {}
    for q, user, cabin, people, insured, bags in sorted(requests):
        own = sorted((n, f, d) for r, n, f, d in legs if r == q)
        paid = sorted((n, m, a) for r, n, m, a in payments if r == q)

        def error():
            if user not in users:
                return "user not found"
            for _, f, d in own:
                if (f, d, cabin) not in seats:
                    return "flight not found"
                status, n, _ = seats[f, d, cabin]
                if status != "available":
                    return "flight not available"
                if n < people:
                    return "not enough seats"
            named = set()
            for _, m, a in paid:
                if (user, m) not in cards:
                    return "payment method not found"
                source, balance = cards[user, m]
                if source in ("gift_card", "certificate") and balance < a:
                    return "not enough balance"
                if source == "certificate" and m in named:
                    return "certificate used twice"
                named.add(m)
            price = sum(seats[f, d, cabin][2] for _, f, d in own) * people + 30 * people * insured + 50 * bags
            return None if sum(a for _, _, a in paid) == price else "payment does not add up"

        out[q] = error()
        if out[q] is None:
            for _, f, d in own:
                seats[f, d, cabin][1] -= people
            for _, m, a in paid:
                if cards[user, m][0] == "gift_card":
                    cards[user, m][1] -= a
                elif cards[user, m][0] == "certificate":
                    del cards[user, m]
    return out, {k: v[1] for k, v in seats.items()}, {k: v[1] for k, v in cards.items()}


def made(seed, n):
    rng = random.Random(seed)
    flights = [(f, d, c, "available" if rng.random() < 0.9 else "delayed", rng.randrange(1, 14), rng.choice([100, 150])) for f in range(8) for d in ("d1", "d2") for c in ("economy", "business")]
    users = list(range(6))
    methods = [(u, m, s, b) for u in users for m, s, b in (("g", "gift_card", rng.choice([300, 900, 4000])), ("t", "certificate", 250), ("c", "credit_card", 0))]
    prices = {(f, d, c): p for f, d, c, _, _, p in flights}
    requests, legs, payments = [], [], []
    for q in range(n):
        user, cabin, people, insured, bags = rng.randrange(7), rng.choice(["economy", "business"]), rng.randrange(1, 4), rng.random() < 0.3, rng.randrange(2)
        own = [(q, k, rng.choice([rng.randrange(8), rng.randrange(3), 9 if rng.random() < 0.1 else 0]), rng.choice(["d1", "d2"])) for k in range(rng.choice([0, 1, 1, 2, 2, 3]))]
        price = sum(prices.get((f, d, cabin), 0) for _, _, f, d in own) * people + 30 * people * insured + 50 * bags
        kinds = rng.choice([["c"], ["g"], ["t", "c"], ["c", "t"], ["t", "t"], ["g", "g"], ["x"], ["g", "c"]])
        amounts = [min(price, 200), max(0, price - 200)][: len(kinds)] if len(kinds) > 1 else [price]
        if rng.random() < 0.1:
            amounts[0] += 1
        requests.append((q, user, cabin, people, insured, bags))
        legs += own
        payments += [(q, k, m, a) for k, (m, a) in enumerate(zip(kinds, amounts, strict=True))]
    return requests, legs, payments, users, flights, methods


def test_bookings_equal_slow_ones(spark):
    for seed, n in ((1, 120), (2, 60)):
        requests, legs, payments, users, flights, methods = made(seed, n)
        want, seats, cards = slow_book(requests, legs, payments, users, flights, methods)
        got = bookings.book(
            spark.createDataFrame(requests, "request bigint, user bigint, cabin string, passengers int, insured boolean, nonfree_bags int"),
            spark.createDataFrame(legs, "request bigint, leg int, flight bigint, date string"),
            spark.createDataFrame(payments, "request bigint, nth int, method string, amount bigint"),
            spark.createDataFrame([(u,) for u in users], "user bigint"),
            spark.createDataFrame(flights, "flight bigint, date string, cabin string, status string, seats int, price bigint"),
            spark.createDataFrame(methods, "user bigint, method string, source string, balance bigint"),
        )
        assert {r.request: r.error for r in got.decisions.collect()} == want
        assert len(set(want.values())) >= 7, set(want.values())
        assert {(r.flight, r.date, r.cabin): r.seats for r in got.seats.collect()} == seats
        assert {(r.user, r.method): r.balance for r in got.methods.collect()} == cards
        booked = {q for q, e in want.items() if e is None}
        assert {r.request for r in got.reservations.collect()} == booked
        assert got.legs.count() == sum(r in booked for r, *_ in legs) and got.payments.count() == sum(r in booked for r, *_ in payments)


def test_groups_are_found_among_resources(spark, monkeypatch):
    """Requests are no nodes of the graph whose components are groups: its size is that of what runs short."""
    nodes = []
    monkeypatch.setattr(bookings, "components", lambda edges, own, find=bookings.components: nodes.append(own.distinct().count()) or find(edges, own))
    n = 300
    got = bookings.book(
        spark.createDataFrame([(q, 0, "e", 1, False, 0) for q in range(n)], "request bigint, user bigint, cabin string, passengers int, insured boolean, nonfree_bags int"),
        spark.createDataFrame([(q, k, q % 2 + 2 * k, "d") for q in range(n) for k in range(2)], "request bigint, leg int, flight bigint, date string"),
        spark.createDataFrame([(q, 0, "c", 20) for q in range(n)], "request bigint, nth int, method string, amount bigint"),
        spark.createDataFrame([(0,)], "user bigint"),
        spark.createDataFrame([(f, "d", "e", "available", 40, 10) for f in range(4)], "flight bigint, date string, cabin string, status string, seats int, price bigint"),
        spark.createDataFrame([(0, "c", "credit_card", 0)], "user bigint, method string, source string, balance bigint"),
    )
    assert nodes == [4] and {r.request for r in got.reservations.collect()} == set(range(80))
