"""Table catalogs: columns, primary keys and foreign keys, parsed from DDL or declared.

Parquet carries no keys, so a catalog travels beside the DataFrames. Catalogs
are schema-sized and live on the driver; ``frame`` functions turn them into
relations for joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SQL_TYPES = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    notnull: bool = False
    default: str | None = None
    pk: bool = False


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class Edge:
    """A foreign key in one of its two directions: join from_table.from_column with to_table.to_column."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    direction: str


@dataclass
class Table:
    name: str
    columns: list[Column]
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.pk]


@dataclass
class Catalog:
    tables: dict[str, Table]

    @property
    def foreign_keys(self) -> list[ForeignKey]:
        return [k for t in self.tables.values() for k in t.foreign_keys]

    def edges(self, table: str) -> list[Edge]:
        """Navigable edges of a table, in the order in which keys were discovered, both directions."""
        out = []
        for k in self.foreign_keys:
            if k.from_table == table:
                out.append(Edge(k.from_table, k.from_column, k.to_table, k.to_column, "parent"))
            if k.to_table == table:
                out.append(Edge(k.to_table, k.to_column, k.from_table, k.from_column, "child"))
        return out

    def key_columns(self) -> set[str]:
        """Names that are a primary key or a foreign key's own column anywhere."""
        return {c for t in self.tables.values() for c in t.primary_key} | {k.from_column for k in self.foreign_keys}

    def centrality(self) -> dict[str, int]:
        """Incoming foreign keys of each table; two keys of one table count twice."""
        out = dict.fromkeys(self.tables, 0)
        for k in self.foreign_keys:
            out[k.to_table] = out.get(k.to_table, 0) + 1
        return out

    def seed_table(self) -> str:
        counts = self.centrality()
        return max(counts, key=lambda t: counts[t])

    def components(self) -> dict[str, str]:
        """The first table (by name) of each table's connected component."""
        group = {t: t for t in self.tables}

        def root(t: str) -> str:
            while group[t] != t:
                t = group[t]
            return t

        for k in self.foreign_keys:
            a, b = sorted((root(k.from_table), root(k.to_table)))
            group[b] = a
        return {t: root(t) for t in self.tables}

    def summary(self) -> str:
        """Tables, columns with flags, and foreign keys as indented text."""
        lines = []
        for t in self.tables.values():
            lines.append(f"{t.name} [PK: {', '.join(t.primary_key) or '(no PK)'}]")
            for c in t.columns:
                flags = [s for s, on in (("PK", c.pk), ("NOT NULL", c.notnull)) if on]
                lines.append(f"  {c.name} {c.type}" + (f" ({', '.join(flags)})" if flags else ""))
            lines += [f"  FK: {k.from_column} -> {k.to_table}.{k.to_column}" for k in t.foreign_keys]
            lines.append("")
        return "\n".join(lines)

    def annotations(self) -> list[str]:
        """A sentence for each foreign key."""
        return [f"{k.from_table}.{k.from_column} references {k.to_table}.{k.to_column}" for k in self.foreign_keys]

    def ddl(self) -> str:
        out = []
        for t in self.tables.values():
            parts = [f"  {c.name} {c.type}" + (" NOT NULL" if c.notnull else "") + (f" DEFAULT {c.default}" if c.default else "") for c in t.columns]
            if t.primary_key:
                parts.append(f"  PRIMARY KEY ({', '.join(t.primary_key)})")
            parts += [f"  FOREIGN KEY ({k.from_column}) REFERENCES {k.to_table}({k.to_column})" for k in t.foreign_keys]
            out.append(f"CREATE TABLE {t.name} (\n" + ",\n".join(parts) + "\n);")
        return "\n\n".join(out)

    def column_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, i, c.name, c.type, c.notnull, c.pk) for t in self.tables.values() for i, c in enumerate(t.columns)]
        return spark.createDataFrame(rows, "table_name string, ord int, column_name string, type string, not_null boolean, pk boolean")

    def key_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k.from_table, k.from_column, k.to_table, k.to_column, i) for i, k in enumerate(self.foreign_keys)]
        return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string, ord int")

    def table_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.tables)], "table_name string, ord int")

    def empty(self, spark: SparkSession) -> dict[str, DataFrame]:
        """An empty DataFrame for each table: what creating the schema gives."""
        return {t.name: spark.createDataFrame([], T.StructType([T.StructField(c.name, SQL_TYPES.get(c.type.upper(), T.StringType()), not c.notnull) for c in t.columns])) for t in self.tables.values()}


def parse_ddl(text: str) -> Catalog:
    """Reads CREATE TABLE statements (column and table level keys).

    Foreign keys of a table come in reverse order of declaration, the order in
    which an embedded database lists them and in which walks follow them."""
    text = re.sub(r"--[^\n]*", "", text)
    tables: dict[str, Table] = {}
    for m in re.finditer(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"\[`]?(\w+)[\"\]`]?\s*\(", text, re.I):
        depth, at = 1, m.end()
        while depth and at < len(text):
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        name, body = m.group(1), text[m.end() : at - 1]
        parts, level, start = [], 0, 0
        for i, ch in enumerate(body):
            level += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and not level:
                parts.append(body[start:i])
                start = i + 1
        parts.append(body[start:])
        columns, keys, primary = [], [], set()
        for part in (" ".join(p.split()) for p in parts):
            if k := re.match(r"(?:CONSTRAINT \w+ )?FOREIGN KEY ?\((\w+)\) REFERENCES (\w+) ?\((\w+)\)", part, re.I):
                keys.append(ForeignKey(name, *k.groups()))
            elif k := re.match(r"(?:CONSTRAINT \w+ )?PRIMARY KEY ?\(([^)]*)\)", part, re.I):
                primary |= {c.strip() for c in k.group(1).split(",")}
            elif part and not re.match(r"(?:UNIQUE|CHECK|CONSTRAINT)\b", part, re.I):
                column, _, rest = part.partition(" ")
                kind = re.match(r"\w*", rest).group() or "TEXT"
                default = re.search(r"\bDEFAULT ('[^']*'|\([^)]*\)|\S+)", rest, re.I)
                columns.append(Column(column.strip('"`[]'), kind.upper(), bool(re.search(r"\bNOT NULL\b", rest, re.I)), default.group(1) if default else None, bool(re.search(r"\bPRIMARY KEY\b", rest, re.I))))
                if k := re.search(r"\bREFERENCES (\w+) ?\((\w+)\)", rest, re.I):
                    keys.append(ForeignKey(name, columns[-1].name, *k.groups()))
        columns = [Column(c.name, c.type, c.notnull, c.default, c.pk or c.name in primary) for c in columns]
        tables[name] = Table(name, columns, keys[::-1])
    return Catalog(tables)


def declare(columns: dict[str, list[str]], primary: dict[str, list[str]], foreign: list[tuple[str, str, str, str]]) -> Catalog:
    """A catalog from "name type" columns, primary keys and foreign keys."""
    out = {}
    for t, cols in columns.items():
        keys = [ForeignKey(*f) for f in foreign if f[0] == t]
        out[t] = Table(t, [Column(*c.split(), pk=c.split()[0] in primary.get(t, [])) for c in cols], keys)
    return Catalog(out)


#: The driver tables. lineitem has no primary key: its rows are known by all their columns.
DRIVER = declare(
    {
        "region": ["r_regionkey INTEGER", "r_name TEXT"],
        "nation": ["n_nationkey INTEGER", "n_name TEXT", "n_regionkey INTEGER"],
        "customer": ["c_custkey INTEGER", "c_name TEXT", "c_nationkey INTEGER", "c_acctbal REAL", "c_mktsegment TEXT"],
        "supplier": ["s_suppkey INTEGER", "s_name TEXT", "s_nationkey INTEGER", "s_acctbal REAL"],
        "part": ["p_partkey INTEGER", "p_name TEXT", "p_brand TEXT", "p_type TEXT", "p_size INTEGER", "p_retailprice REAL"],
        "orders": ["o_orderkey INTEGER", "o_custkey INTEGER", "o_orderstatus TEXT", "o_totalprice REAL", "o_orderdate TIMESTAMP", "o_orderpriority TEXT"],
        "lineitem": ["l_orderkey INTEGER", "l_partkey INTEGER", "l_suppkey INTEGER", "l_linenumber INTEGER", "l_quantity REAL", "l_extendedprice REAL", "l_discount REAL", "l_tax REAL", "l_returnflag TEXT", "l_linestatus TEXT", "l_shipdate TIMESTAMP"],
        "events": ["event_id INTEGER", "ts TIMESTAMP", "user_id INTEGER", "event_type TEXT", "value REAL", "props TEXT"],
        "documents": ["doc_id INTEGER", "text TEXT", "lang TEXT", "source TEXT", "n_chars INTEGER"],
        "labels": ["doc_id INTEGER", "quality INTEGER", "toxic INTEGER"],
        "pages": ["page_id INTEGER", "url TEXT", "html TEXT"],
        "conversations": ["conv_id INTEGER", "turn INTEGER", "role TEXT", "text TEXT"],
        "benchmark": ["item_id INTEGER", "text TEXT"],
    },
    {
        "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
        "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"],
    },
    [
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    ],
)
