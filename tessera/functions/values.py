"""Time, distance, unit and arithmetic functions. Times are UTC."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
#: unit -> (kind, factor, offset) to the kind's base unit: value * factor + offset. Fixed values.
UNITS = {
    "celsius": ("temperature", 1.0, 0.0), "fahrenheit": ("temperature", 5 / 9, -160 / 9), "kelvin": ("temperature", 1.0, -273.15),
    "meter": ("length", 1.0, 0.0), "kilometer": ("length", 1000.0, 0.0), "mile": ("length", 1609.344, 0.0), "foot": ("length", 0.3048, 0.0), "inch": ("length", 0.0254, 0.0),
    "gram": ("mass", 1.0, 0.0), "kilogram": ("mass", 1000.0, 0.0), "pound": ("mass", 453.59237, 0.0), "ounce": ("mass", 28.349523125, 0.0),
    "second": ("time", 1.0, 0.0), "minute": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
}


def ts_components(ts: Column) -> dict[str, Column]:
    return {k: F.extract(F.lit(k), ts).cast("bigint") for k in ("year", "month", "day", "hour", "minute")} | {"second": F.floor(F.extract(F.lit("second"), ts)).cast("bigint"), "isoweekday": (F.weekday(ts) + 1).cast("bigint")}


def ts_shift(ts: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(0))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def hms(seconds: Column) -> Column:
    """h:mm:ss of a number of seconds."""
    s = seconds.cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine; the earth's radius is 6371 km by our choice."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, k, f, o) for u, (k, f, o) in UNITS.items()], "unit string, kind string, factor double, offset double")


def convert_units(df: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """Converts between units of one kind, names case folded; null for other pairs."""
    u = unit_frame(df.sparkSession)
    a, b = (u.select(F.col("unit").alias(f"_u{i}"), F.col("kind").alias(f"_k{i}"), F.col("factor").alias(f"_f{i}"), F.col("offset").alias(f"_o{i}")) for i in "ab")
    j = df.join(a, F.lower(source) == F.col("_ua"), "left").join(b, F.lower(target) == F.col("_ub"), "left")
    result = F.when(F.col("_ka") == F.col("_kb"), (F.col(value) * F.col("_fa") + F.col("_oa") - F.col("_ob")) / F.col("_fb"))
    return j.withColumn(out, result).drop(*[f"_{x}{i}" for x in "ukfo" for i in "ab"])


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate_text(expression: str | None) -> str | None:
    """The value of an arithmetic expression, rounded to two digits as text; null for anything else."""
    if expression is None or not expression.strip() or set(expression) - set("0123456789+-*/(). "):
        return None

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.UnaryOp):
            return _OPS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            a, b = value(node.left), value(node.right)
            if abs(b) > 64 or abs(a) > 1e6:
                raise ValueError("power is too large")
            return a**b
        if isinstance(node, ast.BinOp):
            return _OPS[type(node.op)](value(node.left), value(node.right))
        raise ValueError("not arithmetic")

    try:
        return str(round(float(value(ast.parse(expression.strip(), mode="eval").body)), 2))
    except (ValueError, SyntaxError, ZeroDivisionError, KeyError, OverflowError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def calculate(expressions: pd.Series) -> pd.Series:
    return expressions.map(calculate_text, na_action="ignore")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def merged_variant(base: Column, update: Column, depth: int = 16) -> Column:
    """update laid over base, both VARIANT: objects merge key by key at every level, lists and scalars are replaced.

    A JSON null replaces; no update (null) leaves the base. Objects that both sides nest deeper than depth fail the
    query rather than merge half. All in columns: one expression of depth levels."""
    if not depth:
        return F.raise_error(F.lit("objects are nested deeper than the merge looks")).cast("variant")
    fields = lambda v: v.cast("map<string,variant>")
    both = F.to_variant_object(F.map_zip_with(fields(base), fields(update), lambda _, x, y: F.when(y.isNull(), x).when(_is_object(x) & _is_object(y), merged_variant(x, y, depth - 1)).otherwise(y)))
    return F.when(update.isNull(), base).when(_is_object(base) & _is_object(update), both).otherwise(update)
