"""The set-at-a-time walk against a row-at-a-time one."""

import hashlib
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import walk
from tessera.sources.catalog import declare, parse_ddl


class SlowWalk:
    """One row at a time, straight from the rules; visited tables and seen rows stay for what comes next."""

    def __init__(self, rows, catalog):
        self.rows, self.catalog = rows, catalog
        self.result, self.visited, self.seen = {}, set(), set()

    def key(self, t, r):
        return tuple(r[c] for c in (self.catalog.tables[t].primary_key or sorted(r)))

    def add(self, t, r):
        if (t, self.key(t, r)) in self.seen:
            return False
        self.seen.add((t, self.key(t, r)))
        self.result.setdefault(t, []).append(r)
        return True

    def start(self, table, rows):
        order = lambda t, rs: sorted(rs, key=lambda r: tuple((v is not None, v) for v in self.key(t, r)))
        for r in rows:
            self.add(table, r)
        self.visited.add(table)
        queue = deque((table, r) for r in order(table, rows))
        while queue:
            table, row = queue.popleft()
            for e in self.catalog.edges(table):
                v = row[e.from_column]
                if v is None:
                    continue
                first = e.to_table not in self.visited
                for r in order(e.to_table, [r for r in self.rows[e.to_table] if r[e.to_column] == v]):
                    if self.add(e.to_table, r) and first:
                        queue.append((e.to_table, r))
                self.visited.add(e.to_table)

    def resolve(self):
        progress = True
        while progress:
            progress = False
            for t in [t for t in self.catalog.tables if t not in self.visited]:
                for c in self.catalog.tables[t].columns:
                    held = {r[c.name] for rs in self.result.values() for r in rs if r.get(c.name) is not None}
                    rows = [r for r in self.rows[t] if r[c.name] in held] if c.name in self.catalog.key_columns() else []
                    if rows:
                        self.start(t, rows)
                        progress = True
                        break

    def sample(self, n, seed):
        for t in [t for t in self.catalog.tables if t not in self.visited]:
            chance = lambda r: (hashlib.md5(":".join([str(seed), *[str(v) for v in self.key(t, r) if v is not None]]).encode()).hexdigest(), self.key(t, r))  # noqa: B023, E731
            if rows := sorted(self.rows[t], key=chance)[:n]:
                self.start(t, rows)

    def keys(self):
        return {t: {self.key(t, r) for r in rs} for t, rs in self.result.items()}


def slow_walk(rows, catalog, seed_table, seed):
    slow = SlowWalk(rows, catalog)
    slow.start(seed_table, [seed])
    return slow.keys()


@st.composite
def databases(draw):
    n = draw(st.integers(2, 4))
    names = [f"t{i}" for i in range(n)]
    columns, foreign, rows = {}, [], {}
    for i, t in enumerate(names):
        links = draw(st.lists(st.integers(0, n - 1), max_size=2))
        columns[t] = [f"id{i} INTEGER", *[f"f{k} INTEGER" for k in range(len(links))]]
        foreign += [(t, f"f{k}", names[j], f"id{j}") for k, j in enumerate(links)]
        size = draw(st.integers(0 if i else 1, 4))
        rows[t] = [{f"id{i}": r, **{f"f{k}": draw(st.one_of(st.none(), st.integers(0, 3))) for k in range(len(links))}} for r in range(size)]
    return declare(columns, {t: [f"id{i}"] for i, t in enumerate(names)}, foreign), rows


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(databases())
def test_walk_equals_slow_walk(spark, database):
    catalog, rows = database
    tables = {t: spark.createDataFrame([tuple(r.values()) for r in rs], ", ".join(f"{c.name} int" for c in catalog.tables[t].columns)) for t, rs in rows.items()}
    want = slow_walk(rows, catalog, "t0", rows["t0"][0])
    got = walk.walk(tables, catalog, "t0", tables["t0"].where("id0 = 0"))
    for t in rows:
        keys = [tuple(r) for r in got[t].select(*catalog.tables[t].primary_key).collect()] if t in got else []
        assert len(keys) == len(set(keys))
        assert set(keys) == want.get(t, set()), t


def frames(spark, catalog, rows):
    return {t: spark.createDataFrame([tuple(r[c.name] for c in catalog.tables[t].columns) for r in rs], ", ".join(f"{c.name} int" for c in catalog.tables[t].columns)) for t, rs in rows.items()}


def same_rows(got, slow, catalog):
    for t in catalog.tables:
        keys = [tuple(r) for r in got[t].select(*catalog.tables[t].primary_key).collect()] if t in got else []
        assert len(keys) == len(set(keys))
        assert set(keys) == slow.keys().get(t, set()), t
    assert got.visited == slow.visited


@st.composite
def connected_by_name(draw):
    """Tables of which some are tied by keys, some by columns of one name, some by nothing."""
    n = draw(st.integers(3, 5))
    names, columns, foreign, rows = [f"t{i}" for i in range(n)], {}, [], {}
    for i, t in enumerate(names):
        own = [f"id{i}", *[f"id{j}" for j in draw(st.sets(st.integers(0, n - 1), max_size=2)) if j != i], "x"]
        columns[t] = [f"{c} INTEGER" for c in own]
        foreign += [(t, c, f"t{c[2:]}", c) for c in own[1:-1] if draw(st.booleans())]
        rows[t] = [{c: r if c == f"id{i}" else draw(st.one_of(st.none(), st.integers(0, 3))) for c in own} for r in range(draw(st.integers(0 if i else 2, 4)))]
    return declare(columns, {t: [f"id{i}"] for i, t in enumerate(names)}, foreign), rows


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(connected_by_name(), st.integers(0, 4))
def test_extensions_equal_slow_ones(spark, database, at):
    catalog, rows = database
    tables = frames(spark, catalog, rows)
    slow = SlowWalk(rows, catalog)
    slow.start("t0", rows["t0"][:1])
    got = walk.walk(tables, catalog, "t0", tables["t0"].where("id0 = 0"))
    same_rows(got, slow, catalog)
    name = f"t{at % len(rows)}"
    slow.start(name, [r for r in rows[name] if r[f"id{at % len(rows)}"] % 2])
    got = walk.extend(got, tables, catalog, name, tables[name].where(f"id{at % len(rows)} % 2 = 1"))
    same_rows(got, slow, catalog)
    slow.resolve()
    got = walk.resolve_disconnected(got, tables, catalog)
    same_rows(got, slow, catalog)
    slow.sample(2, 9)
    got = walk.sample_unreached(got, tables, catalog, 2, 9)
    same_rows(got, slow, catalog)


def test_extension_adds_rows_of_visited_tables_without_following(spark):
    rows = {"region": [{"r": 1}, {"r": 2}], "nation": [{"n": k, "nr": 1 + k % 2} for k in range(4)], "customer": [{"c": k, "cn": k % 4} for k in range(12)]}
    c = declare({"region": ["r INTEGER"], "nation": ["n INTEGER", "nr INTEGER"], "customer": ["c INTEGER", "cn INTEGER"]}, {"region": ["r"], "nation": ["n"], "customer": ["c"]}, [("nation", "nr", "region", "r"), ("customer", "cn", "nation", "n")])
    t = frames(spark, c, rows)
    first = walk.walk(t, c, "region", t["region"].where("r = 1"))
    more = walk.extend(first, t, c, "region", t["region"].where("r = 2"))
    assert more["nation"].count() == 4 and more["customer"].count() == first["customer"].count() == 6
    assert set(first) == set(more) and first["nation"].count() == 2, "the walk before is left as it was"
    whole = walk.sub_database(t, c, "region", t["region"].where("r = 1"))
    assert {k: v.count() for k, v in whole.items()} == {k: v.count() for k, v in first.items()}


def test_later_rows_are_not_followed(spark):
    c = declare({"users": ["u INTEGER"], "orders": ["o INTEGER", "ou INTEGER"], "items": ["i INTEGER", "io INTEGER"]}, {"users": ["u"], "orders": ["o"], "items": ["i"]}, [("orders", "ou", "users", "u"), ("items", "io", "orders", "o")])
    t = {"users": spark.createDataFrame([(1,)], "u int"), "orders": spark.createDataFrame([(1, 1), (2, 1)], "o int, ou int"), "items": spark.createDataFrame([(1, 1), (2, 2)], "i int, io int")}
    got = walk.walk(t, c, "orders", t["orders"].where("o = 1"))
    assert {r.o for r in got["orders"].collect()} == {1, 2}
    assert {r.i for r in got["items"].collect()} == {1}
    full = walk.walk(t, c, "orders", t["orders"].where("o = 1"), mode="closure")
    assert {r.i for r in full["items"].collect()} == {1, 2}
    with pytest.raises(ValueError):
        walk.walk(t, c, "orders", t["orders"], mode="other")


def test_ddl():
    c = parse_ddl(
        """-- a comment, with (brackets)
        CREATE TABLE a (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x', CHECK (name IN ('x','y')));
        CREATE TABLE b (id INTEGER, a1 INTEGER, a2 INTEGER REFERENCES a(id), PRIMARY KEY (id),
          FOREIGN KEY (a1) REFERENCES a(id));"""
    )
    assert c.tables["a"].primary_key == ["id"] and c.tables["a"].columns[1].default == "'x'"
    assert [k.from_column for k in c.foreign_keys] == ["a1", "a2"]
    assert c.seed_table() == "a" and c.components() == {"a": "a", "b": "a"}
    assert "a [PK: id]" in c.summary() and "CREATE TABLE b" in c.ddl()
