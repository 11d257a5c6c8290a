"""Tool graphs: edges by shared types, entry and end points, chains, coverage.

tools: (tool, inputs array<string>, outputs array<string>, params array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_types(params: Column) -> Column:
    """Names that end in _id or _number, without the ending, lower-cased, once each."""
    ends = F.filter(params, lambda p: F.regexp_like(p, F.lit("_(?:id|number)$")))
    return F.array_sort(F.array_distinct(F.transform(ends, lambda p: F.lower(F.regexp_replace(p, "_(?:id|number)$", "")))))


def output_types(fields: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(fields, F.lower)))


def field_name(description: Column, kind: Column) -> Column:
    """The field that a loader makes of an output: its description for objects and arrays, result for scalars."""
    return F.when(kind.isin("object", "array"), F.lower(F.replace(F.coalesce(description, F.lit("result")), F.lit(" "), F.lit("_")))).otherwise("result")


def resource_edges(tools: DataFrame) -> DataFrame:
    """(src, dst, matching): an edge for each pair where an output type of one is an input type of the other.

    A join on the type itself: work follows the edges, not the square of the tools."""
    out = tools.select(F.col("tool").alias("src"), F.explode("outputs").alias("t")).select("src", F.lower("t").alias("t")).distinct()
    into = tools.select(F.col("tool").alias("dst"), F.explode("inputs").alias("t")).select("dst", F.lower("t").alias("t")).distinct()
    return out.join(into, "t").where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("t")).alias("matching"))


def temporal_edges(tools: DataFrame) -> DataFrame:
    """All ordered pairs of different tools. The result is that square itself; a tool list is small."""
    a, b = tools.select(F.col("tool").alias("src")), tools.select(F.col("tool").alias("dst"))
    return a.crossJoin(b).where("src <> dst")


def parallel_candidates(tools: DataFrame) -> DataFrame:
    """Unordered pairs of tools that share a parameter name."""
    p = tools.select("tool", F.explode("params").alias("p")).distinct()
    a, b = p.select(F.col("tool").alias("tool_a"), "p"), p.select(F.col("tool").alias("tool_b"), "p")
    return a.join(b, "p").where("tool_a < tool_b").groupBy("tool_a", "tool_b").agg(F.count(F.lit(1)).alias("shared"))


def enrich_edges(existing: DataFrame, proposed: DataFrame, tools: DataFrame) -> DataFrame:
    """Proposed edges between known, different tools that do not exist yet, once each."""
    known = tools.select("tool")
    out = proposed.where("src <> dst").dropDuplicates(["src", "dst"])
    out = out.join(known.select(F.col("tool").alias("src")), "src", "left_semi").join(known.select(F.col("tool").alias("dst")), "dst", "left_semi")
    return out.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def _points(tools: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Tools that no edge has on that side; all tools where that leaves none."""
    free = tools.select("tool").join(edges.select(F.col(side).alias("tool")), "tool", "left_anti")
    none = free.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return free.unionByName(tools.select("tool").join(F.broadcast(none), F.lit(True)).select("tool"))


def entry_tools(tools: DataFrame, edges: DataFrame) -> DataFrame:
    return _points(tools, edges, "dst")


def terminal_tools(tools: DataFrame, edges: DataFrame) -> DataFrame:
    return _points(tools, edges, "src")


def enumerate_chains(starts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Every path without repeats of 2 to length tools from the starts; one join a hop."""
    step = starts.select(F.array("tool").alias("path"))
    e = edges.select("src", "dst").distinct()
    out = None
    for _ in range(length - 1):
        step = step.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        out = step if out is None else out.unionByName(step)
    return out


def sample_chains(walks: DataFrame, edges: DataFrame, length: int, seed: int) -> DataFrame:
    """One seeded random chain for each (walk_id, tool): the next tool is the unvisited successor with the least hash.

    All walks take a hop in one join."""
    step = walks.select("walk_id", F.array("tool").alias("path"), F.lit(True).alias("open"))
    e = edges.select("src", "dst").distinct()
    for hop in range(length - 1):
        chance = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(hop)), F.col("walk_id").cast("string"), F.col("dst")).cast("binary"))
        onward = step.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        took = onward.groupBy("walk_id").agg(F.min_by("dst", chance).alias("dst"))
        step = step.join(took, "walk_id", "left").select("walk_id", F.when(F.col("dst").isNotNull(), F.array_append("path", F.col("dst"))).otherwise(F.col("path")).alias("path"), F.col("dst").isNotNull().alias("open"))
    return step.select("walk_id", "path", F.when(F.size("path") == 1, "NODE").otherwise("CHAIN").alias("pattern"))


def add_parallel(chains: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """Chains with one parallel tool that shares a parameter with the last one; chains without a candidate stay chains."""
    both = candidates.select(F.col("tool_a").alias("a"), F.col("tool_b").alias("b")).unionByName(candidates.select(F.col("tool_b").alias("a"), F.col("tool_a").alias("b")))
    options = chains.join(both, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
    took = options.groupBy("walk_id").agg(F.min_by("b", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("walk_id").cast("string"), F.col("b")).cast("binary"))).alias("parallel"))
    return chains.join(took, "walk_id", "left").select("walk_id", "path", "parallel", F.when(F.col("parallel").isNotNull(), "DAG").otherwise("CHAIN").alias("pattern"))


def weighted_pattern(key: Column, seed: int, weights: dict[str, float]) -> Column:
    """A pattern by weight, from a hash of seed and key."""
    total, bound, out = sum(weights.values()), 0.0, None
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) / 1_000_000.0
    names = list(weights)
    for name in names[:-1]:
        bound += weights[name] / total
        out = F.when(draw < bound, name) if out is None else out.when(draw < bound, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def coverage_stats(paths: DataFrame, tools: DataFrame) -> DataFrame:
    """How many tools the paths use, in per cent of all, and the paths' lengths."""
    used = paths.select(F.explode("path").alias("tool")).distinct().join(tools.select("tool"), "tool", "left_semi").agg(F.count(F.lit(1)).alias("used_tools"))
    every = tools.agg(F.count(F.lit(1)).alias("all_tools"))
    lengths = paths.agg(F.count(F.lit(1)).alias("paths"), F.round(F.avg(F.size("path")), 6).alias("avg_length"), F.max(F.size("path")).cast("bigint").alias("max_length"))
    return used.crossJoin(every).crossJoin(lengths).withColumn("coverage", F.round(F.col("used_tools") / F.col("all_tools") * 100, 6))


def unused_tools(paths: DataFrame, tools: DataFrame) -> DataFrame:
    return tools.select("tool").join(paths.select(F.explode("path").alias("tool")).distinct(), "tool", "left_anti")


def coverage_completion(paths: DataFrame, tools: DataFrame, edges: DataFrame) -> DataFrame:
    """For each unused tool a chain with its first predecessor and successor, where it has them."""
    left = unused_tools(paths, tools)
    before = edges.groupBy(F.col("dst").alias("tool")).agg(F.min("src").alias("pred"))
    after = edges.groupBy(F.col("src").alias("tool")).agg(F.min("dst").alias("succ"))
    chain = F.array_compact(F.array("pred", "tool", F.when(~F.col("succ").eqNullSafe(F.col("pred")), F.col("succ"))))
    return left.join(before, "tool", "left").join(after, "tool", "left").select("tool", chain.alias("path"))


def export_graph(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """Each tool's node as JSON: what it takes and gives, its description if tools have one, its edges out, and whether chains may begin or end there."""
    out = edges.groupBy(F.col("src").alias("tool")).agg(F.array_sort(F.collect_list("dst")).alias("next"))
    first, last = (points(tools, edges).withColumn(name, F.lit(True)) for points, name in ((entry_tools, "entry"), (terminal_tools, "terminal")))
    j = tools.join(out, "tool", "left").join(first, "tool", "left").join(last, "tool", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("entry", "terminal")]
    own = [c for c in ("description",) if c in tools.columns]
    return j.select("tool", F.to_json(F.struct("tool", *own, "inputs", "outputs", "params", F.coalesce("next", F.array().cast("array<string>")).alias("next"), *flags)).alias("node"))


def successors(path: DataFrame, edges: DataFrame, tools: DataFrame) -> DataFrame:
    """Next tools for each (walk_id, path): those that an edge leads to, and those that take a type the last tool gives, unvisited, once each."""
    last = path.select("walk_id", "path", F.element_at("path", -1).alias("src"))
    by_type = resource_edges(tools).select("src", "dst")
    onward = edges.select("src", "dst").unionByName(by_type).distinct()
    return last.join(onward, "src").where(~F.array_contains("path", F.col("dst"))).select("walk_id", "dst")


def entry_sample(walks: DataFrame, entries: DataFrame, seed: int) -> DataFrame:
    """A seeded entry point for each walk. Entry points are few; they are numbered by one sort."""
    names = entries.agg(F.array_sort(F.collect_set("tool")).alias("names"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("walk_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return walks.crossJoin(names).select("walk_id", F.get("names", F.pmod(draw, F.size("names")).cast("int")).alias("tool"))


def pattern_distribution(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """How many paths each pattern has, those without any included."""
    known = paths.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return known.join(paths.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def completed_to(paths: DataFrame, tools: DataFrame, edges: DataFrame, target: float = 0.8) -> DataFrame:
    """coverage_completion's chains, in the tools' order, as many as bring coverage to the target; none where it is reached.

    A chain counts for the one unused tool it is made for."""
    left = coverage_completion(paths, tools, edges)
    n = tools.agg(F.count(F.lit(1)).alias("n")).crossJoin(left.agg(F.count(F.lit(1)).alias("unused")))
    most = F.greatest(F.lit(0), F.ceil(F.lit(target) * F.col("n")) - (F.col("n") - F.col("unused")))
    before = left.select(F.col("tool").alias("other"))
    place = left.join(before, F.col("other") < F.col("tool"), "left").groupBy("tool", "path").agg(F.count("other").alias("place"))
    return place.crossJoin(n).where(F.col("place") < most).select("tool", "path")
