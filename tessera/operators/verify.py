"""Checks of tool chains and test cases, and parsing of what judges answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import written

FIRST, LAST, FOLLOW, NEEDS, CONFLICT = "must_be_first", "must_be_last", "must_follow", "requires_predecessor", "conflicts_with"


def ordering_violations(steps: DataFrame, rules: DataFrame, chain: str, tool: str, pos: str) -> DataFrame:
    """(chain, tool, kind, depends_on, n) of broken rules (tool, kind, depends_on); a repeated tool counts at its last place.

    n: how many steps of the chain state the broken rule."""
    last = steps.groupBy(chain, tool).agg(F.max(pos).alias("at"), F.count(F.lit(1)).alias("n"))
    size = steps.groupBy(chain).agg(F.max(pos).alias("end"))
    r = rules.select(F.col("tool").alias(tool), "kind", "depends_on")
    asked = last.join(r, tool).join(size, chain)
    other = last.select(chain, F.col(tool).alias("depends_on"), F.col("at").alias("other"))
    j = asked.join(other, [chain, "depends_on"], "left")
    broken = (
        F.when(F.col("kind") == FIRST, F.col("at") != 0)
        .when(F.col("kind") == LAST, F.col("at") != F.col("end"))
        .when(F.col("kind").isin(FOLLOW, NEEDS), F.col("depends_on").isNotNull() & (F.col("other").isNull() | (F.col("other") >= F.col("at"))))
        .when(F.col("kind") == CONFLICT, F.col("other").isNotNull())
        .otherwise(F.lit(False))
    )
    return j.where(broken).select(chain, tool, "kind", "depends_on", "n")


def dataflow_warnings(steps: DataFrame, tools: DataFrame, edges: DataFrame, chain: str, tool: str, pos: str) -> DataFrame:
    """Consecutive known tools, both with types, that share none and have no edge of their own."""
    w = Window.partitionBy(chain).orderBy(pos)
    pairs = steps.withColumn("dst", F.lead(tool).over(w)).where("dst IS NOT NULL").select(chain, pos, F.col(tool).alias("src"), "dst")
    t = tools.select("tool", "inputs", "outputs")
    typed = pairs.join(t.select(F.col("tool").alias("src"), "outputs"), "src").join(t.select(F.col("tool").alias("dst"), "inputs"), "dst")
    low = lambda c: F.transform(c, F.lower)
    apart = typed.where((F.size("outputs") > 0) & (F.size("inputs") > 0) & ~F.arrays_overlap(low(F.col("outputs")), low(F.col("inputs"))))
    return apart.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(chain, pos, "src", "dst")


def is_valid(issues: DataFrame, chain: str, severity: str) -> DataFrame:
    """Valid unless an issue is an error."""
    return issues.groupBy(chain).agg(F.bool_and(F.col(severity) != "error").alias("is_valid"))


def ungrounded_params(params: DataFrame, value: str, keys: DataFrame, key: str) -> DataFrame:
    """Parameters whose value no row has as its key."""
    return params.join(keys.select(F.col(key).alias(value)), value, "left_anti")


def first_grounding_error(steps: DataFrame, chain: str, pos: str, is_grounding_error: Column) -> DataFrame:
    """Where execution of a chain stops; domain errors do not stop it."""
    return steps.where(is_grounding_error).groupBy(chain).agg(F.min(pos).alias("stopped_at"))


VERDICT = "struct<verdict:string,reason:string,tools:array<string>>"
ALIGNMENT = "struct<aligned:boolean,confidence:double,issues:array<struct<severity:string,description:string>>>"


def parse_alignment(completion: Column) -> Column:
    """aligned, confidence, issues, source. Nothing that parses counts as aligned with confidence one half; without an error issue the answer is aligned."""
    p = F.from_json(completion, ALIGNMENT)
    bad = p.isNull() | (p["aligned"].isNull() & p["issues"].isNull() & p["confidence"].isNull())
    no_error = ~F.exists(F.coalesce(p["issues"], F.from_json(F.lit("[]"), "array<struct<severity:string,description:string>>")), lambda i: F.lower(i["severity"]) == "error")
    return F.when(bad, F.struct(F.lit(True).alias("aligned"), F.lit(0.5).alias("confidence"), F.lit("fallback").alias("source"))).otherwise(
        F.struct((no_error | F.coalesce(p["aligned"], F.lit(False))).alias("aligned"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence"), F.lit("answer").alias("source"))
    )


def parse_verdict(completion: Column, original: Column) -> Column:
    """status valid, fixed or rejected, and the tools. No answer is valid; a fix that does not parse is rejected; an empty one keeps the original."""
    p = F.from_json(completion, VERDICT)
    status = F.when(completion.isNull(), "valid").when(p.isNull() | p["verdict"].isNull(), "rejected").when(p["verdict"].isin("valid", "fixed", "rejected"), p["verdict"]).otherwise("rejected")
    tools = F.when((status == "fixed") & (F.size(F.coalesce(p["tools"], F.array().cast("array<string>"))) > 0), p["tools"]).otherwise(original)
    return F.struct(status.alias("status"), tools.alias("tools"))


def parse_constraints(completion: Column) -> Column:
    """Rules of known kinds from a JSON list; conflicts are read from depends_on."""
    p = F.from_json(completion, "array<struct<type:string,depends_on:string,reason:string>>")
    return F.filter(F.coalesce(p, F.from_json(F.lit("[]"), "array<struct<type:string,depends_on:string,reason:string>>")), lambda c: c["type"].isin(FIRST, LAST, FOLLOW, NEEDS, CONFLICT))


def refine_chain(names: Column, known: Column) -> Column:
    """The proposed tools that are known, in order; null where none is."""
    kept = F.filter(names, lambda n: F.array_contains(known, n))
    return F.when(F.size(kept) > 0, kept)


def bounded_repair(cases: DataFrame, key: str, check, repair, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Check, repair what failed, check again, at most ``most`` repairs. (accepted, rejected).

    check(df) gives the keys that pass; repair(df) gives new versions of what failed. Each round is written."""
    accepted, open_ = cases.limit(0), cases
    for attempt in range(most + 1):
        passed = written(open_.join(check(open_).select(key), key, "left_semi"))
        accepted = accepted.unionByName(passed)
        open_ = open_.join(passed.select(key), key, "left_anti")
        if attempt < most:
            open_ = written(repair(open_))
    return accepted, open_


def refine_chains(chains: DataFrame, key: str, judge, resample, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Verify, refine, verify again, then resample: (accepted, skipped).

    judge(df) gives (key, status, tools) of chains (key, tools, pattern, parallel).
    valid: accepted as it is; fixed: the tools are replaced, the pattern stays and
    parallel groups go, and the chain is judged again; rejected: resample(keys)
    gives a new chain, judged again. After ``most`` refinements what is still open
    is skipped, a fix of the last attempt too, as it is never judged. Each round is
    written."""
    accepted, open_ = chains.limit(0), chains
    for attempt in range(most + 1):
        judged = written(open_.join(judge(open_).select(key, "status", F.col("tools").alias("_tools")), key))
        accepted = accepted.unionByName(judged.where("status = 'valid'").select(*chains.columns))
        again = judged.where("status <> 'valid'")
        if attempt == most or not again.limit(1).count():
            return accepted, again.select(*chains.columns)
        none = F.lit(None).cast(chains.schema["parallel"].dataType)
        fixed = again.where("status = 'fixed'").withColumn("tools", F.col("_tools")).withColumn("parallel", none).select(*chains.columns)
        fresh = resample(again.where("status = 'rejected'").select(key)).select(*chains.columns)
        open_ = written(fixed.unionByName(fresh))
    return accepted, open_
