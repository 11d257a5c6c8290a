"""Rule combinations: powersets, conflicts, numbered ids, scenario frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 20


def powerset(rules: DataFrame, detail: str, order: str, n: int, max_size: int | None = None) -> DataFrame:
    """All 2**n subsets of n rules: index, binary mask (first rule leftmost), members; the empty set is index 0."""
    if not 0 < n <= MOST_RULES:
        raise ValueError(f"between 1 and {MOST_RULES} rules, not {n}")
    members = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, detail))), lambda r: r[detail]).alias("all"))
    rows = members.select("all", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("idx"))
    mask = F.lpad(F.conv(F.col("idx").cast("string"), 10, 2), n, "0")
    out = rows.withColumn("mask", mask)
    chosen = F.transform(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda j: F.substr("mask", j, F.lit(1)) == "1"), lambda j: F.element_at("all", j))
    out = out.select(F.col("idx").cast("bigint").alias("idx"), "mask", chosen.alias("members"))
    return out if max_size is None else out.where(F.size("members") <= max_size)


def drop_conflicts(combos: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Combinations of more than one rule that a verdict (members, valid) calls invalid go; without a verdict they stay."""
    v = verdicts.select(F.array_sort("members").alias("_key"), "valid").dropDuplicates(["_key"])
    joined = combos.withColumn("_key", F.array_sort("members")).join(v, "_key", "left")
    return joined.where((F.size("members") <= 1) | F.coalesce("valid", F.lit(True))).drop("_key", "valid")


def subgoal_map(mask: Column, details: Column) -> Column:
    """SG{j} -> detail for the rules that the mask has set."""
    ones = F.filter(F.sequence(F.lit(1), F.length(mask)), lambda j: F.substr(mask, j, F.lit(1)) == "1")
    return F.map_from_entries(F.transform(ones, lambda j: F.struct(F.concat(F.lit("SG"), j.cast("string")), F.element_at(details, j))))


def numbered(rules: DataFrame, order: str, prefix: str = "SG", most: int | None = None) -> DataFrame:
    """Rules with ids prefix1, prefix2 … by order; rule lists are small."""
    out = rules.withColumn("n", F.row_number().over(Window.orderBy(order)))
    out = out if most is None else out.where(F.col("n") <= most)
    return out.withColumn("id", F.concat(F.lit(prefix), F.col("n").cast("string"))).drop("n")


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("left"), y.alias("right")))


def enrich(rows: DataFrame, extra: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join by id; what has no match keeps its default."""
    joined = rows.join(extra.select(key, *[F.col(c).alias(f"_e_{c}") for c in defaults]), key, "left")
    return joined.select(*[c for c in rows.columns if c not in defaults], *[F.coalesce(F.col(f"_e_{c}"), d).alias(c) for c, d in defaults.items()])


def missing_subgoals(required: Column, covered: Column) -> Column:
    return F.array_sort(F.array_except(required, covered))


def expand_trials(tasks: DataFrame, trials: DataFrame) -> DataFrame:
    """Every task with every trial (trial, seed); trials are few."""
    return tasks.crossJoin(trials)


def pending_runs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that are not among the finished ones."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def merge_new_only(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All existing rows, and the new ones whose key none of them has; the new ones are not compared with each other."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))
