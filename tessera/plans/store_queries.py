"""Files, batches, snapshots and requests: what is written to the shared folder is read again, over whole driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.values import merged_variant
from tessera.operators import cases, combos, metrics, provider, seeding, toolgraph, walk
from tessera.plans.queries import _EDGE_SQL, _TABLES, _tools, query, t
from tessera.sources import readers, sinks
from tessera.sources.batchlog import BatchLog
from tessera.sources.catalog import DRIVER, parse_ddl
from tessera.sources.staging import shared_dir


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


# -- files -------------------------------------------------------------------


@query("SELECT kind, s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal > 0 AS in_credit FROM supplier, (VALUES ('yaml'), ('toml')) v(kind)")
def config_round_trip(spark, d):
    """Suppliers as YAML and TOML documents, read back."""
    rows = t(spark, d, "supplier").select(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).alias("who"), "s_nationkey", F.array(F.col("s_acctbal") > 0).alias("flags"))
    shape, parts = "who struct<key:bigint,name:string>, s_nationkey bigint, flags array<boolean>", []
    for kind in ("yaml", "toml"):
        path = f"{_folder(spark)}.{kind}"
        sinks.write_any(rows, path)
        x = readers.read_any(spark, path).select(F.from_json(F.to_json("data"), shape).alias("x"))
        parts.append(x.select(F.lit(kind).alias("kind"), F.col("x.who.key").alias("s_suppkey"), F.col("x.who.name").alias("s_name"), F.col("x.s_nationkey").alias("s_nationkey"), F.get("x.flags", F.lit(0)).alias("in_credit")))
    return parts[0].unionByName(parts[1])


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def array_of_cases(spark, d):
    """Customers as test cases in one JSON array, read back."""
    path = _folder(spark)
    sinks.write_array(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), path)
    return spark.read.schema("id bigint, name string, segment string").json(path, multiLine=True)


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def loaded_texts(spark, d):
    """Nations' names as a text file for each region, read whole."""
    path = _folder(spark)
    lines = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    lines.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = readers.read_text(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("bigint").alias("region"), F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("names"))


@query("SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder FROM orders")
def listed_files(spark, d):
    """Files of orders dealt by status, listed without being read."""
    path = _folder(spark)
    t(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return readers.list_files(spark, f"{path}/*/*.parquet").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


@query(f"WITH {_EDGE_SQL} SELECT tool, array_to_string(list_transform(list_filter(params, lambda p: p LIKE '%_id'), lambda p: replace(p, '_id', '')), ',') AS inputs, lower(array_to_string(outputs, ',')) AS outputs FROM tools")
def loaded_tools(spark, d):
    """Tools of brands in a JSON tool file, read back with their types."""
    path = _folder(spark)
    parameter = F.struct(F.lit("string").alias("type"), F.lit("d").alias("description"))
    given = F.when(F.size("outputs") > 0, F.struct(F.lit("object").alias("type"), F.get("outputs", F.lit(0)).alias("description")))
    one = F.struct(F.col("tool").alias("name"), F.lit("about").alias("description"), F.map_from_entries(F.transform("params", lambda p: F.struct(p, parameter))).alias("input"), given.alias("output"))
    _tools(spark, d).agg(F.collect_list(one).alias("tools")).coalesce(1).write.json(path)
    return readers.read_tools(spark, path).select("tool", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"))


@query("SELECT 'rule ' || p_partkey AS details, CASE p_partkey % 4 WHEN 0 THEN 'output_rule' WHEN 1 THEN 'tool_call_rule' ELSE 'compliance_rule' END AS category FROM part")
def loaded_rules(spark, d):
    """Parts as rules, a file for each brand; unknown categories become compliance rules."""
    path = _folder(spark)
    kind = F.when(F.col("p_partkey") % 4 == 0, "output_rule").when(F.col("p_partkey") % 4 == 1, "tool_call_rule").otherwise("other")
    one = F.struct(F.concat(F.lit("rule "), F.col("p_partkey").cast("string")).alias("details"), kind.alias("category"))
    t(spark, d, "part").groupBy("p_brand").agg(F.collect_list(one).alias("subgoals")).drop("p_brand").write.json(path)
    lines = spark.read.text(path)  # a document a line: each becomes a file of its own kind by from_json
    rules = lines.select(F.inline(F.from_json("value", readers.RULE_FILE)["subgoals"]))
    return rules.select("details", F.when(F.col("category").isin(*readers.RULE_KINDS), F.col("category")).otherwise("compliance_rule").alias("category"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS simulation_id, CAST(o_custkey AS VARCHAR) AS task_id, CAST(o_orderkey % 3 AS BIGINT) AS trial, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS reward,
       CAST(CASE WHEN o_custkey % 3 = 1 THEN -1 ELSE o_custkey % 3 END AS INT) AS task_num_actions, 'shop' AS info_domain
FROM orders""")
def loaded_results(spark, d):
    """Orders as simulations in a results file for each customer, flattened with their tasks."""
    path = _folder(spark)
    name = F.when(F.col("o_custkey") % 3 == 1, "transfer_to_human").otherwise("look")
    action = F.struct(name.alias("name"), F.lit("assistant").alias("requestor"))
    key = F.col("o_custkey").cast("string")
    sims = F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("id"), key.alias("task_id"), (F.col("o_orderkey") % 3).cast("bigint").alias("trial"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward")))
    runs = t(spark, d, "orders").groupBy("o_custkey").agg(sims.alias("simulations"))
    tasks = F.array(F.struct(key.alias("id"), F.array_repeat(action, (F.col("o_custkey") % 3).cast("int")).alias("actions")))
    runs.select(F.struct(F.lit("shop").alias("domain"), F.lit(3).alias("num_trials")).alias("info"), tasks.alias("tasks"), "simulations").write.json(path)
    found = readers.flatten_results(spark.read.schema(readers.SIMULATIONS).json(path))
    return found.select("simulation_id", "task_id", "trial", "reward", "task_num_actions", "info_domain")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (3, 11, 7, 2)")
def selected_tasks(spark, d):
    """Customers as tasks, five named, four taken in the order of their names."""
    tasks = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name")
    return readers.select_tasks(tasks, ["11", "3", "7", "2", "5"], 4).select(F.col("id").cast("bigint").alias("id"), "c_name")


_FIRST = {n: x.primary_key[0] for n, x in DRIVER.tables.items() if len(x.primary_key) == 1}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(k AS BIGINT) AS key FROM (SELECT {k} AS k FROM {n} ORDER BY {k} LIMIT 2)" for n, k in _FIRST.items()))
def sample_rows(spark, d):
    """The first two rows of each table with a key."""
    parts = [readers.sample_rows(t(spark, d, n), k).select(F.lit(n).alias("table_name"), F.col(k).cast("bigint").alias("key")) for n, k in _FIRST.items()]
    return reduce(DataFrame.unionByName, parts)


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c.name}' AS column_name, {str(c.pk).lower()} AS pk, count({c.name}) AS filled FROM {n}" for n, x in DRIVER.tables.items() for c in x.columns))
def created_tables(spark, d):
    """Tables created from the DDL that the catalog dumps, with the given rows put in."""
    catalog = parse_ddl(DRIVER.ddl())
    empty = catalog.empty(spark)
    full = {}
    for n, df in readers.driver_tables(spark, d, _TABLES).items():
        full[n] = empty[n].unionByName(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty[n].schema]))
    return catalog.column_frame(spark).select("table_name", "column_name", "pk").join(walk.column_counts(full, catalog), ["table_name", "column_name"])


# -- batches and snapshots ---------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus || ',\"' || o_orderkey AS note FROM orders")
def appended_batches(spark, d):
    """Orders as notes in CSV, a batch a status; each batch is appended twice and counts once."""
    notes = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat("o_orderstatus", F.lit(',"'), F.col("o_orderkey").cast("string")).alias("note"))
    log = BatchLog(spark, _folder(spark), notes.select("o_orderkey", "note").schema, "csv")
    for status in ("F", "O", "P", "F", "P", "O"):
        log.append(notes.where(F.col("o_orderstatus") == status), f"status-{status}")
    return log.read()


def _states(spark, d) -> tuple[dict, dict]:
    before = readers.driver_tables(spark, d, ["customer", "orders", "nation", "part"])
    after = before | {
        "orders": before["orders"].withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 5, "X").otherwise(F.col("o_orderstatus"))),
        "nation": before["nation"].repartition(3, "n_name"),
        "part": before["part"].where("p_size > 1"),
    }
    return before, after


@query("""
SELECT 'customer' AS table_name, count(*) AS n, count(*) AS n_before, false AS changed FROM customer
UNION ALL SELECT 'orders', count(*), count(*), bool_or(o_orderkey = 5) FROM orders
UNION ALL SELECT 'nation', count(*), count(*), false FROM nation
UNION ALL SELECT 'part', count(*) FILTER (p_size > 1), count(*), count(*) FILTER (p_size > 1) <> count(*) FROM part""")
def snapshot_changes(spark, d):
    """Tables after a run against the manifest of a snapshot before it: one value changed, rows dealt anew, rows gone."""
    before, after = _states(spark, d)
    path = _folder(spark)
    sinks.snapshot(before, path)
    return sinks.changed_tables(after, path)


@query("SELECT p_partkey, p_name, p_size FROM part")
def restored_table(spark, d):
    """Parts from a snapshot, after the run took some away."""
    before, _ = _states(spark, d)
    path = _folder(spark)
    sinks.snapshot(before, path)
    return sinks.restored(spark, path)["part"].select("p_partkey", "p_name", "p_size")


_UPDATE = "CASE event_id % 4 WHEN 0 THEN '{\"user\":{\"level\":{\"k\":7}},\"tags\":[9]}' WHEN 1 THEN '{\"user\":{\"name\":\"x\",\"level\":3}}' WHEN 2 THEN '{\"extra\":{\"a\":{\"b\":1}},\"user\":{\"level\":{\"more\":true}}}' END"


@query(f"""
SELECT event_id, m ->> '$.user.name' AS name, CAST(m -> '$.user.level' ->> '$.k' AS BIGINT) AS k, m ->> '$.user.level.more' AS more, CASE WHEN json_type(m, '$.user.level') <> 'OBJECT' THEN m ->> '$.user.level' END AS level, CAST(json_array_length(m, '$.tags') AS INT) AS tags, CAST(m ->> '$.extra.a.b' AS BIGINT) AS b
FROM (SELECT event_id, json_merge_patch(json_object('user', json_object('name', event_type, 'level', props::JSON), 'tags', json_array(1, 2)), coalesce({_UPDATE}, '{{}}')::JSON) AS m FROM events)
""")
def merged_props(spark, d):
    """Nested updates laid over the events' properties."""
    base = F.to_variant_object(F.struct(F.struct(F.col("event_type").alias("name"), F.parse_json("props").alias("level")).alias("user"), F.array(F.lit(1), F.lit(2)).alias("tags")))
    m = t(spark, d, "events").select("event_id", merged_variant(base, F.parse_json(F.expr(_UPDATE)), 6).alias("m"))
    at = lambda path, kind: F.try_variant_get("m", path, kind)
    scalar = F.when(~F.schema_of_variant(at("$.user.level", "variant")).startswith("OBJECT"), at("$.user.level", "string"))
    return m.select("event_id", at("$.user.name", "string").alias("name"), at("$.user.level.k", "bigint").alias("k"), at("$.user.level.more", "string").alias("more"), scalar.alias("level"), F.size(at("$.tags", "array<bigint>")).alias("tags"), at("$.extra.a.b", "bigint").alias("b"))


# -- requests ----------------------------------------------------------------


class Flaky:
    """A stub of a model: fails as often as the prompt says."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, payload: dict) -> str:
        prompt = payload["messages"][-1]["content"]
        status, times, _ = prompt.split(":")
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        if self.seen[prompt] <= int(times):
            raise provider.ProviderError(int(status), f"no {status}")
        return f"answer to {prompt}"


def _no_wait(_: float) -> None:
    return None


@query("""
SELECT event_id, CASE WHEN times = 0 OR code IN (429, 503) AND times < 4 THEN 200 ELSE code END AS status, CASE WHEN times = 0 OR code IN (429, 503) AND times < 4 THEN 'answer to ' || code || ':' || times || ':' || user_id ELSE '' END AS completion,
       CASE WHEN times = 0 OR code IN (429, 503) AND times < 4 THEN NULL WHEN code = 429 THEN 'maximum number of retries exceeded' ELSE 'no ' || code END AS error,
       CAST(CASE WHEN times > 0 AND code = 401 THEN 1 ELSE least(times + 1, 4) END AS INT) AS tries
FROM (SELECT event_id, user_id, event_id % 6 AS times, CASE event_type WHEN 'view' THEN 401 WHEN 'click' THEN 503 ELSE 429 END AS code FROM events)""")
def provider_statuses(spark, d):
    """Each event asks a model that fails up to five times; four tries are made. Equal prompts are asked once."""
    code = F.when(F.col("event_type") == "view", "401").when(F.col("event_type") == "click", "503").otherwise("429")
    prompt = F.concat_ws(":", code, (F.col("event_id") % 6).cast("string"), F.col("user_id").cast("string"))
    asked = t(spark, d, "events").select("event_id", prompt.alias("prompt"))
    return provider.completed(asked, Flaky, settings=provider.Settings(tries=4), sleep=_no_wait).drop("prompt")


_CASES = "SELECT n_nationkey AS n, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS key FROM nation"


@query(f"""
SELECT CAST(n AS VARCHAR) AS "case", attempt, CASE WHEN attempt <= n % 4 THEN CASE attempt WHEN 1 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN 2 THEN 'TABLE_OR_VIEW_NOT_FOUND' ELSE 'only a single SELECT is accepted' END WHEN key IS NULL THEN 'Query returned no rows' END AS error,
       CASE WHEN attempt > n % 4 THEN key END AS key
FROM ({_CASES}), (VALUES (1), (2), (3)) v(attempt) WHERE attempt <= CASE WHEN key IS NULL THEN 3 ELSE n % 4 + 1 END
""")
def seed_attempts(spark, d):
    """A seed customer for each nation by proposed statements, up to three of which are broken, each told the error before it."""
    scripts = {1: "SELECT nothing FROM seed_customers", 2: "SELECT c_custkey FROM seed_nowhere", 3: "DELETE FROM seed_customers"}
    last = {2: "UNRESOLVED_COLUMN", 3: "TABLE_OR_VIEW_NOT_FOUND"}

    def propose(case: str, attempt: int, error: str | None) -> str | None:
        if attempt <= int(case) % 4:
            return scripts[attempt] if attempt == 1 or (error or "").startswith(last[attempt]) else None
        return f"```sql\nSELECT c_custkey FROM seed_customers WHERE c_nationkey = {case} ORDER BY c_custkey LIMIT 1;\n```"

    names = [str(r[0]) for r in t(spark, d, "nation").select("n_nationkey").collect()]  # one test case a nation
    found = seeding.seed_rows(spark, {"seed_customers": t(spark, d, "customer")}, names, propose)
    return found.select("case", "attempt", "error", F.get_json_object("row", "$.c_custkey").cast("bigint").alias("key"))


# -- single functions --------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, abs(l_tax - 0.04) * 30e-6 <= 1e-6 AS success, count(*) AS n FROM lineitem GROUP BY ALL")
def tolerant_success(spark, d):
    """Rewards close to one: what is off by less than a millionth counts."""
    reward = 1 + (F.col("l_tax") - 0.04) * 30e-6
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", metrics.is_success(reward).alias("success")).groupBy("l_orderkey", "l_linenumber", "success").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'prd is empty' WHEN o_orderkey % 7 = 0 THEN 'subgoals is empty' WHEN o_orderkey % 13 = 0 THEN 'tools is empty' WHEN o_custkey % 5 = 0 THEN 'weights must lie in [0, 1] and sum to 1'
       WHEN o_custkey % 6 = 0 THEN 'path length must be positive' WHEN o_orderkey % 5 NOT BETWEEN 1 AND 3 THEN 'subgoal limit must lie between 1 and 3' END AS error,
       CASE WHEN o_orderkey % 4 < 1 OR o_orderkey % 4 > o_custkey % 4 THEN 'k (' || o_orderkey % 4 || ') must lie between 1 and the number of trials (' || o_custkey % 4 || ')' END AS pass_k_error
FROM orders""")
def input_errors(spark, d):
    """Orders as requests, with the first fault of their inputs and of their k."""
    o, k, c = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    words = lambda n: F.when(k % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    weights = F.create_map(F.lit("node"), F.when(c % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.25)), F.lit("chain"), F.lit(0.75))
    error = cases.input_error(F.when(k % 11 == 0, "  ").otherwise("text"), words(7), words(13), weights, c % 6, k % 5)
    return o.select("o_orderkey", error.alias("error"), cases.pass_k_error(k % 4, c % 4).alias("pass_k_error"))


@query("SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey % 2 = 1 THEN 'SG1=' || n_name END, CASE WHEN n_nationkey % 3 = 1 THEN 'SG2=b' END, CASE WHEN n_regionkey > 2 THEN 'SG3=c' END) AS goals FROM nation")
def subgoal_maps(spark, d):
    """Subgoals that a nation's mask sets."""
    bit = lambda c: F.when(c, "1").otherwise("0")
    mask = F.concat(bit(F.col("n_nationkey") % 2 == 1), bit(F.col("n_nationkey") % 3 == 1), bit(F.col("n_regionkey") > 2))
    goals = combos.subgoal_map(mask, F.array("n_name", F.lit("b"), F.lit("c")))
    return t(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(F.map_entries(goals), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("goals"))


@query("SELECT p_type, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS outputs FROM part GROUP BY p_type")
def tool_output_types(spark, d):
    """Brands as a type's outputs, folded and once each."""
    return t(spark, d, "part").groupBy("p_type").agg(toolgraph.output_types(F.collect_set("p_brand")).alias("x")).select("p_type", F.array_join("x", ",").alias("outputs"))


@query("SELECT o_orderkey, 'SELECT ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' -- ``` inside' ELSE '' END AS statement FROM orders")
def cleaned_statements(spark, d):
    """Statements out of fences, without the final semicolon."""
    k = F.col("o_orderkey") % 4
    body = F.concat(F.lit("SELECT "), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, " -- ``` inside").otherwise(""))
    wrapped = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```sql\n"), body, F.lit(";\n```"))).when(k == 2, F.concat(F.lit("  "), body, F.lit(" ;  "))).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```\n")))
    return t(spark, d, "orders").select("o_orderkey", text.clean_sql(wrapped).alias("statement"))
