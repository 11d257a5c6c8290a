"""Foreign-key walks: a connected sub-database around seed rows.

``walk`` follows the step-by-step rule set at a time. Tables are reached in
batches: a batch is what the first lookup into a table found. Every row and
relationship of a batch looks up its targets; rows not seen before are added,
and of them only the first lookup's make the target's own batch (possibly none;
later rows of that table are added but not followed). Batches are worked off in
the order in which they came to be. A table has one batch at most, so the number
of Spark jobs depends on the schema alone. What a lookup adds is written to the
shared folder, so plans do not nest.

Row order within a lookup, which decides what comes first, is that of the
primary key (of all columns where there is none).

``mode="closure"`` follows every row instead, until nothing new is found.

What a walk leaves (``Walked``) holds its rows and which tables it has visited, so
that ``extend``, ``resolve_disconnected`` and ``sample_unreached`` go on from it:
rows of a table visited before are added where they are new, and not followed.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog
from tessera.sources.staging import written


def key_of(catalog: Catalog, table: str, df: DataFrame) -> list[str]:
    return catalog.tables[table].primary_key or sorted(df.columns)


def _new(found: DataFrame, seen: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows not seen yet. Keys may be null (whole-row identity), so nulls compare equal."""
    if seen is None:
        return found
    same = None
    s = seen.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        same = c if same is None else same & c
    return found.join(s, same, "left_anti")


class Walked(dict):
    """table -> its rows, with the tables that a walk has visited: looked into with a value, whether rows came or not."""

    def __init__(self, rows: dict[str, DataFrame], visited: set[str] | None = None) -> None:
        super().__init__(rows)
        self.visited = set(rows) if visited is None else set(visited)

    @classmethod
    def of(cls, rows: dict[str, DataFrame]) -> Walked:
        """A state of its own; of a plain dictionary all tables count as visited."""
        return cls(rows, rows.visited if isinstance(rows, Walked) else None)

    def add(self, catalog: Catalog, table: str, rows: DataFrame) -> None:
        """Adds the rows that are not held yet, each once; written, so that no later lookup holds this one's plan."""
        keys = key_of(catalog, table, rows)
        fresh = written(_new(rows, self.get(table), keys).dropDuplicates(keys))
        self[table] = fresh if table not in self else self[table].unionByName(fresh)

    def held(self, column: str) -> DataFrame | None:
        """The distinct values (_v) that rows have so far in columns of that name; None where no table has it."""
        found = [df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")) for df in self.values() if column in df.columns]
        return reduce(DataFrame.unionByName, found).distinct() if found else None


def walk(tables: dict[str, DataFrame], catalog: Catalog, seed_table: str, seed_rows: DataFrame, mode: str = "compat") -> Walked:
    """table -> its rows in the walked sub-database. tables may leave some of the catalog's tables out."""
    if mode not in ("compat", "closure"):
        raise ValueError(f"mode must be compat or closure, not {mode!r}")
    if mode == "closure":
        return _closure(tables, catalog, seed_table, seed_rows)
    return _follow(Walked({seed_table: seed_rows}), tables, catalog, seed_table, seed_rows)


def _follow(result: Walked, tables: dict[str, DataFrame], catalog: Catalog, table: str, rows: DataFrame) -> Walked:
    """Works off rows of a table and the batches they lead to; result grows."""
    queue: deque[tuple[str, DataFrame]] = deque([(table, rows)])
    while queue:
        table, batch = queue.popleft()
        order = key_of(catalog, table, batch)
        edges = [e for e in catalog.edges(table) if e.to_table in tables]
        fresh_edges = [(r, e) for r, e in enumerate(edges) if e.to_table not in result.visited]
        # of each relationship, the first row (by key) that has a value, and that value
        first: dict[str, tuple[tuple, object]] = {}
        if fresh_edges:
            place = F.struct(*order)
            has = lambda e: F.col(e.from_column).isNotNull()
            least = batch.agg(*[x for r, e in fresh_edges for x in (F.min(F.when(has(e), place)).alias(f"k{r}"), F.min_by(e.from_column, F.when(has(e), place)).alias(f"v{r}"))]).head()
            for r, e in fresh_edges:
                if least[f"k{r}"] is not None:
                    at = (tuple((x is not None, x) for x in least[f"k{r}"]), r)
                    if e.to_table not in first or at < first[e.to_table][0]:
                        first[e.to_table] = (at, least[f"v{r}"])
        started: list[tuple[tuple, str, DataFrame]] = []
        for r, e in enumerate(edges):
            target = tables[e.to_table]
            keys = key_of(catalog, e.to_table, target)
            if e.to_table in first and first[e.to_table][0][1] == r:  # the first lookup makes the target's batch
                at, value = first[e.to_table]
                started.append((at, e.to_table, written(target.where(F.col(e.to_column) == F.lit(value)).dropDuplicates(keys))))
            values = batch.where(F.col(e.from_column).isNotNull()).select(F.col(e.from_column).alias("_key")).distinct()
            found = target.join(values, target[e.to_column] == values["_key"], "left_semi")
            result.add(catalog, e.to_table, found)
        result.visited |= set(first)
        for _, name, own in sorted(started, key=lambda x: x[0]):
            queue.append((name, own))
    return result


def _closure(tables: dict[str, DataFrame], catalog: Catalog, seed_table: str, seed_rows: DataFrame) -> Walked:
    result, frontier = {seed_table: seed_rows}, {seed_table: seed_rows}
    while frontier:
        reached: dict[str, DataFrame] = {}
        for table, rows in frontier.items():
            for e in catalog.edges(table):
                if e.to_table not in tables:
                    continue
                target = tables[e.to_table]
                keys = key_of(catalog, e.to_table, target)
                values = rows.where(F.col(e.from_column).isNotNull()).select(F.col(e.from_column).alias("_key")).distinct()
                found = _new(target.join(values, target[e.to_column] == values["_key"], "left_semi"), result.get(e.to_table), keys)
                found = _new(found, reached.get(e.to_table), keys)
                reached[e.to_table] = found if e.to_table not in reached else reached[e.to_table].unionByName(found)
        # each round is cut off from the ones before
        frontier = {t: c for t, r in reached.items() if (c := written(r)).limit(1).count()}
        for t, r in frontier.items():
            result[t] = r if t not in result else result[t].unionByName(r)
    return Walked(result)


def extend(result: dict[str, DataFrame], tables: dict[str, DataFrame], catalog: Catalog, table: str, rows: DataFrame) -> Walked:
    """result with rows of a table and what following them reaches, each row once.

    The given rows are followed. Of what they reach, only tables that nothing visited before are followed further."""
    out = Walked.of(result)
    out.add(catalog, table, rows)
    out.visited.add(table)
    return _follow(out, tables, catalog, table, rows)


def sample_unreached(result: dict[str, DataFrame], tables: dict[str, DataFrame], catalog: Catalog, n: int = 1, seed: int = 0) -> Walked:
    """result with a seeded sample of n rows of each table that was not visited, in catalog order, and what following each sample reaches.

    Tables that an earlier sample's rows reach meanwhile are sampled all the same."""
    out = Walked.of(result)
    for name in [t for t in catalog.tables if t in tables and t not in out.visited]:
        keys = key_of(catalog, name, tables[name])
        chance = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
        rows = written(tables[name].orderBy(chance, *keys).limit(n))
        if rows.limit(1).count():
            out = extend(out, tables, catalog, name, rows)
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) and nodes (node): the least name that edges reach.

    Labels spread along edges until none changes; each round is written."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        after = written(labels.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("next")))
        if not after.where("next <> component").limit(1).count():
            return labels
        labels = after.select("node", F.col("next").alias("component"))


def value_index(rows: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """(column_name, value): the distinct values of key columns in a sub-database, as text."""
    eligible, parts = catalog.key_columns(), []
    for df in rows.values():
        for c in df.columns:
            if c in eligible:
                parts.append(df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def resolve_disconnected(result: dict[str, DataFrame], tables: dict[str, DataFrame], catalog: Catalog, exclude_columns: tuple[str, ...] = ()) -> Walked:
    """Adds tables that were not visited, by key columns of the same name that share values with rows held so far, and follows what they add.

    Tables in catalog order, columns in order of declaration; the first column with a match wins. Passes go on
    until one adds no table; a table that another one's rows reach within a pass is still matched in it."""
    out = Walked.of(result)
    eligible = catalog.key_columns() - set(exclude_columns)
    progress = True
    while progress:
        progress = False
        for t in [t for t in catalog.tables if t in tables and t not in out.visited]:
            for c in (c.name for c in catalog.tables[t].columns if c.name in eligible):
                values = out.held(c)
                if values is None:
                    continue
                rows = written(tables[t].join(values, F.col(c) == F.col("_v"), "left_semi"))
                if rows.limit(1).count():
                    out = extend(out, tables, catalog, t, rows)
                    progress = True
                    break
    return out


def sub_database(tables: dict[str, DataFrame], catalog: Catalog, seed_table: str, seed_rows: DataFrame, resolve: bool = True, sample: int = 3, seed: int = 0) -> Walked:
    """A walk, then what shared key values connect, then a sample of each table that is still unvisited."""
    out = walk(tables, catalog, seed_table, seed_rows)
    return sample_unreached(resolve_disconnected(out, tables, catalog), tables, catalog, sample, seed) if resolve else out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a hash of seed and key: random, and the same each time."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def column_counts(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """(table_name, column_name, filled): how many rows of each column have a value; one pass over a table, which reads no more than null marks."""
    parts = []
    for name, df in tables.items():
        own = [c.name for c in catalog.tables[name].columns if c.name in df.columns]
        one = df.agg(*[F.count(c).alias(c) for c in own])
        parts.append(one.select(F.lit(name).alias("table_name"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in own]))))
    return reduce(DataFrame.unionByName, parts)


def key_matches(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """(from_table, from_column, to_table, to_column, rows, matched) of each foreign key between the tables: rows with a value, and those whose value a parent has."""
    parts = []
    for k in catalog.foreign_keys:
        if k.from_table in tables and k.to_table in tables:
            values = tables[k.from_table].where(F.col(k.from_column).isNotNull()).groupBy(F.col(k.from_column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))  # values meet parents once, with their number
            parents = tables[k.to_table].select(F.col(k.to_column).alias("_v")).distinct().withColumn("_hit", F.lit(True))
            sums = values.join(parents, "_v", "left").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0)).alias("matched"))
            parts.append(sums.select(*[F.lit(x).alias(c) for c, x in (("from_table", k.from_table), ("from_column", k.from_column), ("to_table", k.to_table), ("to_column", k.to_column))], "rows", "matched"))
    return reduce(DataFrame.unionByName, parts)


def reference_tables(counts: DataFrame, keys: DataFrame, most: int = 50) -> DataFrame:
    """Tables without an outgoing foreign key and at most so many rows."""
    return counts.where(F.col("n") <= most).join(keys.select(F.col("from_table").alias("table_name")), "table_name", "left_anti")


def seed_table_of(columns: DataFrame, result_columns: list[str]) -> DataFrame:
    """The table whose column names overlap most with a result's; the first of equals; none without overlap."""
    hit = columns.where(F.col("column_name").isin(result_columns)).groupBy("table_name").agg(F.count(F.lit(1)).alias("shared"), F.min("table_ord").alias("o"))
    return hit.orderBy(F.desc("shared"), "o").limit(1).select("table_name", "shared")
