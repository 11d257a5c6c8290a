"""Text and format functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error texts that mean missing or invented data rather than a domain rule: fixed values.
GROUNDING_PATTERNS = (
    r"not found",
    r"missing \d+ required positional argument",
    r"missing required positional argument",
    r"Field required",
    r"validation error",
    r"invalid literal",
    r"unexpected keyword argument",
    r"got an unexpected keyword argument",
    r"takes \d+ positional arguments? but \d+ (?:was|were) given",
    r"Invalid characters",
)


def is_grounding_error(content: Column) -> Column:
    return F.regexp_like(content, F.lit("(?i)" + "|".join(f"(?:{p})" for p in GROUNDING_PATTERNS)))


def fenced(content: Column) -> Column:
    """What stands between the first fence (with or without json) and the next one; the text itself without a fence."""
    inner = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(F.contains(content, F.lit("```")), inner).otherwise(content))


def clean_sql(content: Column) -> Column:
    """A statement without fence, final semicolons and blanks around it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(content, r"(?s)^\s*```(?:sql)?\s*|\s*```\s*$", "")), ";+$", ""))


def grade(completion: Column) -> Column:
    """1 for C, 0 for I, null for other grades and for none."""
    letter = F.upper(F.regexp_extract(completion, r"(?i)GRADE\s*:\s*([CPI])", 1))
    return F.when(letter == "C", 1).when(letter == "I", 0)


def func_format(name: Column, arguments: Column) -> Column:
    """name(k=v, k=v), in the map's order."""
    return F.concat(name, F.lit("("), F.array_join(F.transform(F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit(")"))


def key_parts(key: Column) -> Column:
    """task and trial of "task-trial"; null unless there are two parts."""
    p = F.split(key, "-")
    return F.when(F.size(p) == 2, F.struct(F.get(p, F.lit(0)).alias("task"), F.get(p, F.lit(1)).alias("trial")))


def truncate(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def has_text(content: Column) -> Column:
    return content.isNotNull() & (F.length(F.trim(content)) > 0)


def guard_select(sql: str) -> str:
    """The statement, if it is one SELECT (or WITH) and nothing else."""
    body = re.sub(r"(?s)^\s*```(?:sql)?\s*|\s*```\s*$", "", sql).strip().rstrip(";").strip()
    if ";" in body or not re.match(r"(?is)(?:select|with)\b", body) or re.search(r"(?i)\b(?:insert|update|delete|drop|create|alter|truncate|merge|set|cache)\b", body):
        raise ValueError("only a single SELECT is accepted")
    return body


def run_select(spark, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Runs a guarded SELECT over views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(guard_select(sql))


def numbered(items: Column) -> Column:
    """The items of a list as lines "1. item"."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def returns_description(names: Column, kinds: Column) -> Column:
    """"name (type)" of a single field, the names by commas of several, empty of none."""
    return F.when(F.size(names) == 1, F.concat(F.get(names, F.lit(0)), F.lit(" ("), F.get(kinds, F.lit(0)), F.lit(")"))).otherwise(F.array_join(names, ", "))


def tool_section(name: Column, description: Column, params: Column, returns: Column) -> Column:
    """A tool as a prompt shows it: heading, description, parameters as a list, what it returns."""
    listed = F.when(F.size(params) > 0, F.array_join(F.transform(params, lambda p: F.concat(F.lit("- "), p)), "\n")).otherwise(F.lit("- none"))
    return F.concat(F.lit("## "), name, F.lit("\n"), F.coalesce(description, F.lit("")), F.lit("\nParameters:\n"), listed, F.lit("\nReturns: "), returns)


def json_section(title: str, value: Column) -> Column:
    """A heading and a value as JSON, indented, as prompts show constraints and sampled rows."""
    return F.concat(F.lit(f"## {title}\n"), F.to_json(value, {"pretty": "true"}))


def edge_list(edges: Column) -> Column:
    """Edges (src, dst, matching) of a graph as prompts list those that exist: "- a -> b (via x, y)", sorted; a line that says none is there."""
    lines = F.array_sort(F.transform(edges, lambda e: F.concat(F.lit("- "), e["src"], F.lit(" -> "), e["dst"], F.when(F.size(e["matching"]) > 0, F.concat(F.lit(" (via "), F.array_join(e["matching"], ", "), F.lit(")"))).otherwise(""))))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(none)")


def iso_time(ts: Column) -> Column:
    """ISO 8601 to the second, with the fraction where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(ts, "SSSSSS")
    return F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))
