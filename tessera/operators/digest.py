"""Identity, digests and differences of rows and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """A row's values by column name, each as text, null marked apart from any text."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))) for c in sorted(columns)])


def row_digest(columns: list[str]) -> Column:
    return F.sha2(row_text(columns).cast("binary"), 256)


def table_digest(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, n, digest): equal for equal bags of rows, in any order.

    Rows' digests are summed by their first byte, in the tasks first, so one exchange
    of 256 rows a task is all that shuffles."""
    rows = df.select(row_digest(columns or df.columns).alias("h"))
    each = rows.select(F.substring("h", 1, 2).alias("b"), *[F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    # sums of the digests' parts: a repeated row counts as often as it occurs, and no list of rows is ever held
    part = each.groupBy("b").agg(F.count(F.lit(1)).alias("k"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(4)])
    line = F.concat_ws(":", "b", F.col("k").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return part.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ",").cast("binary"), 256).alias("digest")).select(F.lit(name).alias("table_name"), "n", "digest")


def database_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """One digest of all tables by name."""
    parts = reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in tables.items()])
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "table_name", "digest"))), ",").cast("binary"), 256).alias("digest"))


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks."""
    x, y = a.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_l")), b.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    j = x.join(y, key, "full_outer")
    return j.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(key, "left_value", "right_value")


def short_id(key: Column, n: int = 8) -> Column:
    """A short id that a key always gives."""
    return F.left(F.sha2(key.cast("string").cast("binary"), 256), F.lit(n))


def message_digest(role: str = "role") -> Column:
    """Equal for messages that count as the same: the fields of their role, never time, cost or usage.

    Columns: role, content, tool_calls (any comparable type), call_id, requestor, error."""
    said = F.struct("content", "tool_calls")
    answer = F.struct("call_id", "content", "requestor", "error")
    body = F.when(F.col(role) == "tool", F.to_json(answer, {"ignoreNullFields": "false"})).otherwise(F.to_json(said, {"ignoreNullFields": "false"}))
    return F.sha2(F.concat_ws("|", F.col(role), body).cast("binary"), 256)


def incompatible_tasks(before: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, why): tasks that a resumed run cannot take over. Lengths are compared too: a task that one side lacks is told."""
    x, y = before.select(key, row_digest(columns).alias("_x")), now.select(key, row_digest(columns).alias("_y"))
    why = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed")
    return x.join(y, key, "full_outer").select(key, why.alias("why")).where("why IS NOT NULL")
