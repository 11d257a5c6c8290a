"""Domain query tools: search, prices, ledgers, policies, device state."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import written

INSURANCE, BAG = 30, 50
#: Free bags a passenger by membership and cabin: fixed values of the policy.
FREE_BAGS = {
    ("regular", "basic_economy"): 0, ("regular", "economy"): 1, ("regular", "business"): 2,
    ("silver", "basic_economy"): 1, ("silver", "economy"): 2, ("silver", "business"): 3,
    ("gold", "basic_economy"): 2, ("gold", "economy"): 3, ("gold", "business"): 4,
}


def optional_filter(df: DataFrame, **equal) -> DataFrame:
    """Keeps rows that equal each argument given; None asks nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def direct_search(flights: DataFrame, dates: DataFrame, key: str, origin=None, destination=None, date=None) -> DataFrame:
    """Available flights of a day with that day's seats and prices."""
    return optional_filter(flights, origin=origin, destination=destination).join(optional_filter(dates, date=date).where("status = 'available'"), key)


def next_day(date: Column, arrival: Column, compat: bool = True) -> Column:
    """The second leg's day: the next one where the arrival is marked +1.

    compat keeps the fixed month and the missing padding of the rule this follows
    ("2024-05-" and the day's number plus one); otherwise the calendar's next day."""
    late = F.contains(arrival, F.lit("+1"))
    day = F.concat(F.lit("2024-05-"), (F.element_at(F.split(date, "-"), 3).cast("int") + 1).cast("string")) if compat else F.date_add(date.cast("date"), 1).cast("string")
    return F.when(late, day).otherwise(date)


LEG = ("flight", "origin", "destination", "date", "departure", "arrival")
#: Flights of alike legs in one row at most; pairs that a task of onestop_pairs makes at most on average.
TILE, PAIRS_A_TASK = 128, 100_000_000


def onestop_search(legs: DataFrame, compat: bool = True) -> DataFrame:
    """Pairs of legs (flight, origin, destination, date, departure, arrival) where the second leaves from the first's end, on its day, not before it is in.

    Times compare as text, a "+1" included."""
    return onestop_between(legs, None, None, compat=compat)


def onestop_between(legs: DataFrame, origin, destination, date=None, compat: bool = True) -> DataFrame:
    """The pairs of onestop_search from one end to another, on one day of the first leg if given. Ends are asked of the legs before they meet."""
    return onestop_pairs(*onestop_tiles(legs, origin, destination, date), compat=compat)


def onestop_tiles(legs: DataFrame, origin=None, destination=None, date=None) -> tuple[DataFrame, DataFrame]:
    """First and second legs for onestop_pairs, written to the shared folder: those with the same ends, day and times in rows of at most TILE flights."""
    same = [c for c in LEG if c != "flight"]
    tile = F.floor((F.row_number().over(Window.partitionBy(*same).orderBy("flight")) - 1) / TILE)

    def tiles(asked: DataFrame) -> DataFrame:
        # structs, as a list leaves nulls out
        flights = F.transform(F.collect_list(F.struct("flight")), lambda x: x["flight"])
        return written(asked.select(*LEG).withColumn("tile", tile).groupBy(*same, "tile").agg(flights.alias("flights")))

    return tiles(optional_filter(legs, origin=origin, date=date)), tiles(optional_filter(legs, destination=destination))


def onestop_pairs(firsts: DataFrame, seconds: DataFrame, compat: bool = True) -> DataFrame:
    """The pairs of onestop_search from onestop_tiles: tiles meet, and each two give all their pairs in turn.

    There are as many pairs as the square of the legs, so their order says what they take where they are written: within two
    tiles the first flight stays and the same few second ones come again, which any columnar file keeps in a fraction of a byte a pair.
    Tasks grow in number with the pairs, and a stop's day with many is split."""
    a = firsts.select(*[F.col(c).alias(f"{c}_1") for c in firsts.columns]).withColumn("day", next_day(F.col("date_1"), F.col("arrival_1"), compat))
    b = seconds.select(*[F.col(c).alias(f"{c}_2") for c in seconds.columns])
    met = (F.col("destination_1") == F.col("origin_2")) & (F.col("day") == F.col("date_2"))
    n = a.groupBy("destination_1", "day").agg(F.sum(F.size("flights_1")).alias("n_1")).join(b.groupBy("origin_2", "date_2").agg(F.sum(F.size("flights_2")).alias("n_2")), met)
    most = n.agg(F.sum(F.col("n_1").cast("double") * F.col("n_2")).alias("all"), F.max(F.col("n_1").cast("double") * F.col("n_2")).alias("day")).head()
    tasks = max(math.ceil((most["all"] or 0) / PAIRS_A_TASK), firsts.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, math.ceil(math.sqrt((most["day"] or 0) / PAIRS_A_TASK)))
    # a part of the first legs meets each part of the second ones
    own = lambda k, names: F.pmod(F.xxhash64(*[f"{c}_{k}" for c in names]), F.lit(parts)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = a.withColumn("row_1", own(1, firsts.columns[:-1])).withColumn("column_1", each).repartition(tasks, "destination_1", "day", "row_1", "column_1")
    b = b.withColumn("column_2", own(2, seconds.columns[:-1])).withColumn("row_2", each).repartition(tasks, "origin_2", "date_2", "row_2", "column_2")
    tiles = a.join(b, met & (F.col("row_1") == F.col("row_2")) & (F.col("column_1") == F.col("column_2"))).where("departure_2 >= arrival_1")
    # a compiled stage gathers all that one input row gives: as stages of their own, the steps gather a tile's rows each, not a stop's day's pairs
    firsts_out = tiles.coalesce(tasks).withColumn("flight_1", F.explode("flights_1"))
    pairs = firsts_out.coalesce(tasks).withColumn("flight_2", F.explode("flights_2"))
    return pairs.select(*[f"{c}_{k}" for k in (1, 2) for c in LEG])


def onestop_counts(legs: DataFrame, compat: bool = True) -> DataFrame:
    """How many pairs of onestop_search there are for each origin, stop, destination and day.

    Legs meet as counts by their times, and the second legs' counts as running sums from the last departure
    back, so no pair is made: a stop's day costs its distinct arrival times times the destinations."""
    a = legs.withColumn("day", next_day(F.col("date"), F.col("arrival"), compat)).groupBy(F.col("origin").alias("origin_1"), F.col("destination").alias("destination_1"), F.col("date").alias("date_1"), "day", "arrival").agg(F.count(F.lit(1)).alias("n"))
    times = a.groupBy(F.col("destination_1").alias("origin"), F.col("day").alias("date")).agg(F.array_sort(F.collect_set("arrival")).alias("times"))
    b = legs.groupBy("origin", F.col("destination").alias("destination_2"), "date", "departure").agg(F.count(F.lit(1)).alias("m"))
    # a departure counts for the latest arrival time it is open to; sums from the latest time back give all later ones
    latest = F.array_max(F.filter("times", lambda x: x <= F.col("departure")))
    caught = b.join(times, ["origin", "date"]).withColumn("arrival", latest).where("arrival IS NOT NULL").groupBy("origin", "date", "destination_2", "arrival").agg(F.sum("m").alias("m"))
    by_stop = caught.groupBy("origin", "date", "destination_2").agg(F.map_from_entries(F.collect_list(F.struct("arrival", "m"))).alias("open"))
    firsts = a.groupBy("origin_1", "destination_1", "date_1", "day").agg(F.collect_list(F.struct("arrival", "n")).alias("ins"))
    pairs = F.aggregate("ins", F.lit(0).cast("bigint"), lambda s, i: s + i["n"] * F.aggregate(F.map_values(F.map_filter("open", lambda k, _: k >= i["arrival"])), F.lit(0).cast("bigint"), lambda x, y: x + y))
    return firsts.join(by_stop, (F.col("destination_1") == F.col("origin")) & (F.col("day") == F.col("date"))).select("origin_1", "destination_1", "destination_2", "date_1", pairs.alias("pairs")).where("pairs > 0")


def booking_price(legs_total: Column, passengers: Column, insured: Column, nonfree_bags: Column) -> Column:
    return legs_total * passengers + F.when(insured, passengers * INSURANCE).otherwise(0) + nonfree_bags * BAG


def booking_error(user_exists: Column, seats_ok: Column, payment_known: Column, balance_ok: Column, paid: Column, price: Column) -> Column:
    """The first check that a booking fails, in the order in which they are made; null where it passes."""
    return (
        F.when(~user_exists, "user not found").when(~seats_ok, "not enough seats").when(~payment_known, "payment method not found").when(~balance_ok, "not enough balance").when(paid != price, "payment does not add up")
    )


def refund_ledger(payments: DataFrame, key: str, amount: str, cancelled: DataFrame) -> DataFrame:
    """Payments, and for cancelled keys a negated copy of each."""
    back = payments.join(cancelled.select(key), key, "left_semi").withColumn(amount, -F.col(amount))
    return payments.unionByName(back.select(*payments.columns))


def baggage_delta(old_nonfree: Column, new_nonfree: Column) -> Column:
    return F.greatest(F.lit(0), new_nonfree - old_nonfree) * BAG


def free_bags(spark) -> DataFrame:
    return spark.createDataFrame([(m, c, n) for (m, c), n in FREE_BAGS.items()], "membership string, cabin string, free_bags int")


def baggage_fee(bookings: DataFrame, bags: str, passengers: str) -> DataFrame:
    """bookings (membership, cabin, bags, passengers) with free_bags and fee."""
    m = F.broadcast(free_bags(bookings.sparkSession))
    free = F.col("free_bags") * F.col(passengers)
    return bookings.join(m, ["membership", "cabin"]).withColumn("fee", F.greatest(F.lit(0), F.col(bags) - free) * BAG)


def rebooking_delta(old: DataFrame, new: DataFrame, key: list[str], same: list[str], price: str, passengers: Column) -> DataFrame:
    """New price less the old for each key. Legs that keep all of ``same`` keep their price.

    old, new: key, the columns of same, price."""
    # old and new legs meet in one grouping by what is kept, then in one by key; nulls are equal to nothing
    known = lambda names: reduce(Column.__and__, [F.col(c).isNotNull() for c in names], F.lit(True))
    none = F.lit(None).cast(old.schema[price].dataType)
    legs = old.select(*key, *same, F.col(price).alias("_old"), F.lit(None).cast(new.schema[price].dataType).alias("_new"), F.lit(True).alias("_was"))
    legs = legs.unionByName(new.select(*key, *same, none.alias("_old"), F.col(price).alias("_new"), F.lit(False).alias("_was"))).where(known(key))
    n_new = F.count_if(~F.col("_was"))
    each = legs.groupBy(*key, *same).agg(F.min("_old").alias("_kept"), F.sum("_old").alias("was"), F.sum("_new").alias("_sum"), n_new.alias("_n"), F.count_if("_was").alias("_m"))
    now = F.when(F.col("_n") > 0, F.when(known(same) & F.col("_kept").isNotNull(), (F.col("_kept") * F.col("_n")).cast(each.schema["_sum"].dataType)).otherwise(F.col("_sum")))
    out = each.groupBy(*key).agg(F.sum(now).alias("now"), F.sum("was").alias("was"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).where("_n > 0 AND _m > 0")
    return out.select(*key, "now", "was", ((F.col("now") - F.col("was")) * passengers).alias("delta"))


def update_payment_error(exists: Column, kind: Column, balance: Column, amount: Column) -> Column:
    return F.when(~exists, "payment method not found").when(kind == "certificate", "certificate cannot be used to update").when((kind == "gift_card") & (balance < amount), "gift card balance is not enough")


def may_cancel(any_flown: Column, hours: Column, airline_cancelled: Column, business: Column, insured: Column, reason: Column) -> Column:
    return ~any_flown & ((hours <= 24) | airline_cancelled | business | (insured & reason.isin("health", "weather")))


def compensation(membership: Column, insured: Column, business: Column, cancelled: Column, delayed: Column, changed: Column, passengers: Column) -> Column:
    able = membership.isin("silver", "gold") | insured | business
    return F.when(able & cancelled, passengers * 100).when(able & delayed & changed, passengers * 50).otherwise(0)


def over_limits(passengers: Column, certificates: Column, credit_cards: Column, gift_cards: Column) -> Column:
    return (passengers > 5) | (certificates > 1) | (credit_cards > 1) | (gift_cards > 3)


def first_free(used: DataFrame, key: str, candidates: list[str]) -> DataFrame:
    """The first candidate id not used yet; no row where all are."""
    c = used.sparkSession.createDataFrame(list(enumerate(candidates)), f"o int, {key} string")
    return c.join(used.select(key), key, "left_anti").orderBy("o").limit(1).select(key)


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Parents with an array of their children."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(grouped, key, "left")


def paired_items(old: Column, new: Column) -> Column:
    """Items to exchange with what replaces each, by place; null where the lists differ in length."""
    return F.when(F.size(old) == F.size(new), F.zip_with(old, new, lambda a, b: F.struct(a.alias("item"), b.alias("new_item"))))


def order_write_error(status: Column, wanted: str, done_before: Column) -> Column:
    """Writes on orders: the status must be the wanted one, and each write is made once."""
    return F.when(status != wanted, F.concat(F.lit("order is not "), F.lit(wanted))).when(done_before, "already done")


def device_state(log: DataFrame, device: str, order: str, setting: str, value: str) -> DataFrame:
    """State after a log of settings: low battery turns cellular, wifi and location off, and while it is on they stay off.

    A fold over each device's own log, in order."""
    start = F.struct(*[F.lit(x).alias(n) for n, x in (("cellular", True), ("wifi", True), ("location", True), ("low_battery", False))])

    def step(s: Column, e: Column) -> Column:
        low = F.when(e[setting] == "low_battery", e[value]).otherwise(s["low_battery"])
        keep = lambda n: ~low & F.when(e[setting] == n, e[value]).otherwise(s[n])
        return F.struct(keep("cellular").alias("cellular"), keep("wifi").alias("wifi"), keep("location").alias("location"), low.alias("low_battery"))

    events = F.array_sort(F.collect_list(F.struct(order, setting, value)))
    return log.groupBy(device).agg(events.alias("_log")).select(device, F.aggregate("_log", start, step).alias("s")).select(device, "s.*")


def fuzzy(a: Column, b: Column, most: int = 2) -> Column:
    """At most so many edits apart, case folded. The number is ours; nothing public fixes it."""
    return F.levenshtein(F.lower(a), F.lower(b)) <= most


def lookup(requests: DataFrame, rows: DataFrame, key: str, what: str, strict: bool = False) -> DataFrame:
    """Requests with the row of their key, and error: "<what> <key> not found" where there is none. strict: such a request fails the query."""
    error = F.when(F.col("_found").isNull(), F.concat(F.lit(f"{what} "), F.col(key).cast("string"), F.lit(" not found")))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    return requests.join(rows.withColumn("_found", F.lit(True)), key, "left").withColumn("error", error).drop("_found")


def flight_status(requests: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """The status of each asked flight and day; null where that flight has none that day."""
    return requests.join(dates.select(*keys, "status"), keys, "left")


#: Airports served: fixed values.
AIRPORTS = {
    "SFO": "San Francisco", "JFK": "New York", "LAX": "Los Angeles", "ORD": "Chicago", "DFW": "Dallas", "DEN": "Denver", "SEA": "Seattle", "ATL": "Atlanta", "MIA": "Miami", "BOS": "Boston",
    "PHX": "Phoenix", "IAH": "Houston", "LAS": "Las Vegas", "MCO": "Orlando", "EWR": "Newark", "CLT": "Charlotte", "MSP": "Minneapolis", "DTW": "Detroit", "PHL": "Philadelphia", "LGA": "LaGuardia",
}
TRANSFERRED = "Transfer successful"


def airports(spark) -> DataFrame:
    return spark.createDataFrame(list(AIRPORTS.items()), "code string, city string")


def without_seats(dates: DataFrame, bookings: DataFrame, keys: list[str], passengers: str) -> DataFrame:
    """dates with the seats that bookings take subtracted."""
    taken = bookings.groupBy(*keys).agg(F.sum(passengers).alias("_taken"))
    return dates.join(taken, keys, "left").withColumn("seats", F.col("seats") - F.coalesce("_taken", F.lit(0))).drop("_taken")


def after_payments(methods: DataFrame, payments: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Payment methods (keys, kind, balance) after payments: gift cards lose what is paid (a negative amount credits them), used certificates go."""
    paid = payments.groupBy(*keys).agg(F.sum(amount).alias("_paid"))
    j = methods.join(paid, keys, "left")
    gone = (F.col("kind") == "certificate") & F.col("_paid").isNotNull()
    rest = F.when((F.col("kind") == "gift_card") & F.col("_paid").isNotNull(), F.col("balance") - F.col("_paid")).otherwise(F.col("balance"))
    return j.where(~gone).withColumn("balance", rest).drop("_paid")


def with_status(rows: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    """rows with the status set for the keys given."""
    return rows.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def leg_error(legs: DataFrame, dates: DataFrame, booking: str, keys: list[str], passengers: str, kept: Column | None = None) -> DataFrame:
    """(booking, error): the first leg (by leg) that cannot be flown: not that day, not available, or too few seats. Legs that a rebooking keeps are not asked."""
    j = legs.join(dates.select(*keys, "status", "seats"), keys, "left")
    e = F.when(F.col("status").isNull(), "flight not found").when(F.col("status") != "available", "flight not available").when(F.col("seats") < F.col(passengers), "not enough seats")
    if kept is not None:
        e = F.when(~F.coalesce(kept, F.lit(False)), e)
    return j.groupBy(booking).agg(F.min_by(e, F.when(e.isNotNull(), F.col("leg"))).alias("error"))


def passengers_error(old: Column, new: Column) -> Column:
    """Passengers may be changed, not added or taken away."""
    return F.when(F.size(old) != F.size(new), "number of passengers does not match")


def update_ledger(payments: DataFrame, changes: DataFrame, key: str, amount: str) -> DataFrame:
    """Payments with a row for each change whose amount is not 0."""
    return payments.unionByName(changes.where(F.col(amount) != 0).select(*payments.columns))


def certificates(requests: DataFrame, used: DataFrame, user: str, ids: list[str], order: str | None = None, amount: str | None = None) -> DataFrame:
    """Requests with the certificate id that each gets, or an error: "not eligible" for an amount of 0, "too many certificates".

    A user's requests are served by order (one a user where it is not given); each takes the first of the ids that the
    user has no certificate of. Requests that are not eligible take none."""
    free = F.array_except(F.array(*map(F.lit, ids)), F.coalesce("_used", F.array().cast("array<string>")))
    taken = used.where(F.col("id").isin(ids)).groupBy(user).agg(F.collect_set("id").alias("_used"))
    able = F.lit(True) if amount is None else F.col(amount) > 0
    j = requests.join(taken, user, "left").withColumn("_able", F.coalesce(able, F.lit(False)))
    if order is None:
        j = j.withColumn("_n", F.lit(1))
    else:
        j = j.withColumn("_n", F.sum(F.col("_able").cast("int")).over(Window.partitionBy(user).orderBy(order)))
    j = j.withColumn("certificate", F.when(F.col("_able"), F.try_element_at(free, F.col("_n").cast("int"))))
    return j.withColumn("error", F.when(~F.col("_able"), "not eligible").when(F.col("certificate").isNull(), "too many certificates")).drop("_used", "_able", "_n")


def find_user(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, email | first, last, zip) with the user of that email, else of that name and zip, case folded; the first user where several match."""
    low = lambda c: F.lower(F.col(c))
    ask = requests.select("request", *[low(c).alias(f"_{c}") for c in ("email", "first", "last", "zip")])
    u = users.select("user", *[low(c).alias(c) for c in ("email", "first", "last", "zip")])
    by_email = ask.where("_email IS NOT NULL").join(u, F.col("_email") == F.col("email"))
    by_name = ask.where("_email IS NULL").join(u, (F.col("_first") == F.col("first")) & (F.col("_last") == F.col("last")) & (F.col("_zip") == F.col("zip")))
    found = by_email.select("request", "user").unionByName(by_name.select("request", "user")).groupBy("request").agg(F.min("user").alias("user"))
    return requests.join(found, "request", "left").select("request", "user", F.when(F.col("user").isNull(), "user not found").alias("error"))


def product_types(products: DataFrame, name: str, key: str) -> DataFrame:
    """All product names with their ids, as one sorted map in JSON."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(key).alias("v"))))
    return products.select(name, key).distinct().agg(F.to_json(F.map_from_entries(entries)).alias("products"))


def exchange_error(status: Column, done_before: Column, old: Column, new: Column, same_product: Column, available: Column, balance: Column, difference: Column) -> Column:
    """The first rule that an exchange or change of items breaks: a delivered order, once, lists of one length, same products, in stock, enough on the gift card."""
    return (
        F.when(status != "delivered", "order is not delivered").when(done_before, "already done").when(F.size(old) != F.size(new), "items do not pair")
        .when(~same_product, "not the same product").when(~available, "not available").when(balance < difference, "gift card balance is not enough")
    )


def changed(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Create, change and delete by one table: changes (key, op, the columns of rows); op is put or delete. The last change of a key, by seq, counts.

    put: columns that are null in the change keep their values."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in (key, "seq")]), "seq").alias("_c"))
    j = rows.withColumn("_there", F.lit(True)).join(last, key, "full_outer").where(F.col("_c").isNull() | (F.col("_c.op") == "put"))
    return j.select(key, *[F.coalesce(F.col("_c")[c], F.col(c)).alias(c) for c in rows.columns if c != key])


def search_messages(messages: DataFrame, contacts: DataFrame, sender=None, recipient=None, equal: dict | None = None, between: dict | None = None, near: dict | None = None) -> DataFrame:
    """messages (sender_phone, recipient_phone, …) with the contacts (person, name, phone) at both ends, where conditions of search hold.

    sender and recipient name persons; a phone that no contact has gives no person. Contacts of one phone each give a row."""
    out = messages
    for end, wanted in (("sender", sender), ("recipient", recipient)):
        who = contacts.select(F.col("phone").alias(f"{end}_phone"), F.col("person").alias(f"{end}_person"), F.col("name").alias(f"{end}_name"))
        out = out.join(who, f"{end}_phone", "left") if wanted is None else out.join(who.where(F.col(f"{end}_person") == F.lit(wanted)), f"{end}_phone")
    return search(out, equal, between, near)


def search(rows: DataFrame, equal: dict | None = None, between: dict | None = None, near: dict | None = None) -> DataFrame:
    """Rows that match all conditions given: equal values, ranges (low, high; either may be None), texts at most two edits away or holding the text."""
    rows = optional_filter(rows, **(equal or {}))
    for c, (low, high) in (between or {}).items():
        if low is not None:
            rows = rows.where(F.col(c) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(c) <= F.lit(high))
    for c, value in (near or {}).items():
        if value is not None:
            rows = rows.where(fuzzy(F.col(c), F.lit(value)) | F.contains(F.lower(c), F.lit(value.lower())))
    return rows
