"""Conversation structure repair by a min-plus matrix scan.

A repaired conversation has the role initials ``(s?(ua)+)?``, which an automaton
of four states reads: nothing yet, after s, after u, after a. Each turn becomes a
4x4 matrix: its element from one state to another is the cheapest way (cost,
audit) to edit the turn so, with any insertions before it (the insert closure)
included. Elements add as (cost, audit) pairs, the least wins, equal costs by
the ASCII-least audit; audits of one stretch and one cost are never prefixes of
each other, so the product is associative and turns can be multiplied in any
grouping.

Turns are sorted into ranges by (conversation, turn, ...), so that a very long
conversation spans several partitions. Each stretch of a conversation within a
partition is multiplied there, block by block in a balanced tree (blocks recur,
and are remembered). Conversations at a partition's edges go on through a tree
of groupings, sixteen partitions at a time, each round written to the shared
folder. The audit is then dealt to the stretches again, and texts are edited
stretch by stretch (``repaired_turns``) or streamed in order for the digest of a
whole conversation (``repair_reports``). Nothing holds a conversation's texts
together; what a conversation needs is its audit, one letter for an edit (in the
tree sixteen of them).

Edits: Keep costs 0; Rerole, to user or assistant, 1; Delete 2 and required for
blank turns and for duplicates; Insert an empty user or assistant turn anywhere
5. A truncated turn that isn't deleted costs 5 more. A turn's first fault
counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen
earlier), truncated (last other character not one of ``.!?``).

Defined cases: null roles and texts count as one space; a null conversation is
one of its own; turns that are null come first, equal turns by role and then by
the text's md5; rows that repeat are duplicates but for one; roles with another
initial must be reroled or deleted; other columns are ignored; an empty table
gives no rows, and conversations named in ``every`` without turns zeros, an empty
audit and the digest of an empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bloom
from tessera.llm.common import Stage, table

BLANKS = " \t\n\x0b\f\r"
INITIALS = "sua"
FOLLOWS = frozenset(("su", "ua", "au"))
#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FINE, TRUNCATED, GONE = range(3)
#: Partitions that one step of the tree brings together.
FAN_IN = 16
BLOCK = 8

# -- matrices of (cost, audit) ------------------------------------------------

Matrix = tuple


def plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(min((e for e in pair if e is not None), default=None) for pair in zip(x, y, strict=True))


def times(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        row = [(k, e) for k, e in enumerate(x[i : i + 4]) if e is not None]
        for j in range(4):
            best = None
            for k, (cost, audit) in row:
                e = y[4 * k + j]
                if e is not None and (best is None or cost + e[0] <= best[0]):
                    new = (cost + e[0], audit + e[1])
                    best = new if best is None else min(best, new)
            out.append(best)
    return tuple(out)


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(steps.get((i, j)) for i in range(4) for j in range(4))


#: Where an element with this role leads from which states.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ONE = _matrix({(i, i): (0, "") for i in range(4)})
_ANY = [*STEPS["u"], *STEPS["a"]]
_INSERT = _matrix({step: (INSERT, "I") for step in _ANY})
#: Any number of insertions; going round in a circle is never the cheapest.
CLOSURE = plus(ONE, plus(_INSERT, times(_INSERT, _INSERT)))


def _turn(role: str, fault: int) -> Matrix:
    ways = _matrix({(i, i): (DELETE, "D") for i in range(4)})
    if fault != GONE:
        more = CUT if fault == TRUNCATED else 0
        ways = plus(ways, _matrix({step: (REROLE + more, "R") for step in _ANY}))
        ways = plus(ways, _matrix({step: (more, "K") for step in STEPS.get(role, ())}))
    return times(CLOSURE, ways)


TURNS = [_turn(role, fault) for role in (*INITIALS, "?") for fault in (FINE, TRUNCATED, GONE)]


@lru_cache(maxsize=50_000)
def _block(kinds: bytes) -> Matrix:
    if len(kinds) == 1:
        return TURNS[kinds[0]]
    half = len(kinds) // 2
    return times(_block(kinds[:half]), _block(kinds[half:]))


def product(parts: list[Matrix]) -> Matrix:
    """The matrices' product in their order, as a balanced tree."""
    while len(parts) > 1:
        parts = [times(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else ONE


def scan(kinds: bytes) -> Matrix:
    return product([_block(bytes(kinds[k : k + BLOCK])) for k in range(0, len(kinds), BLOCK)])


def cheapest(whole: Matrix) -> tuple[int, str]:
    end = times(whole, CLOSURE)
    return min(e for e in (end[0], end[3]) if e is not None)


class Editor:
    """Applies a stretch's audit to its turns as they come."""

    def __init__(self, audit: str, state: int = 0) -> None:
        self.audit, self.at, self.state = audit, 0, state

    def _new(self) -> str:
        assistant = self.state == 2
        self.state = 3 if assistant else 2
        return "assistant" if assistant else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new(), "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = 1 + INITIALS.index(role[0])
            yield role, text, edit
        elif edit == "R":
            yield self._new(), text, edit


# -- ordered turns and their stretches ---------------------------------------


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, stage: Stage) -> DataFrame:
    """(conv, turn, role, text, fault, kind, pos, part), sorted by range; pos rises through all partitions."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = stage.keep(rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct("turn", "uid"))["uid"].alias("first")
    again = stage.keep(rows.groupBy("conv", "role", "digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    key, bits = F.xxhash64("conv", "role", "digest"), bloom.size_for(again.count())
    marked = bloom.test(rows, key, bloom.bits_of(again, key, bits, stage), bits, "maybe")
    names = [F.col(c).alias(f"a_{c}") for c in ("conv", "role", "digest")]
    same = F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) & (F.col("digest") == F.col("a_digest"))
    sure = marked.where("NOT maybe").select(*rows.columns, F.lit(False).alias("repeated"))
    rest = marked.where("maybe").join(again.select(*names, "first"), same, "left").select(*rows.columns, F.coalesce(F.col("uid") != F.col("first"), F.lit(False)).alias("repeated"))
    ended = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(F.btrim("text", F.lit(BLANKS)) == "", "blank").when(F.col("repeated"), "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    worst = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(FINE)
    by = ("conv", "turn", "role", "digest", "uid")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sure.unionByName(rest).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return stage.keep(
        ranged.withColumn("fault", fault).select("conv", "turn", "role", "text", "fault", initial.alias("initial"), (3 * which + worst).cast("byte").alias("kind"), F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().cast("long").alias("part"))
    )


COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")
_STRETCH = [
    *[T.StructField(c, T.LongType()) for c in ("part", "pos", *COUNTS)],
    *[T.StructField(c, T.StringType()) for c in ("first_initial", "last_initial")],
    *[T.StructField(c, T.LongType()) for c in ("first_turn", "last_turn", "least_turn")],
    T.StructField("costs", T.ArrayType(T.LongType())),
    T.StructField("audits", T.ArrayType(T.StringType())),
    T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())),
    T.StructField("edge", T.BooleanType()),
]


def _schema(conv: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("conv", conv.dataType), *_STRETCH])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _packed(x: Matrix) -> dict:
    return {"costs": [e and e[0] for e in x], "audits": [e and e[1] for e in x]}


def _stretches(ordered: DataFrame) -> DataFrame:
    """A row for each run of a conversation's turns within a partition; edge: other partitions may hold more of it."""
    schema = _schema(ordered.schema["conv"])
    kind = _arrow(schema)

    def run(batches):
        now, kinds, out = None, bytearray(), []

        def close(edge: bool) -> None:
            out.append({**now, **_packed(scan(kinds)), "n_rows": len(kinds), "sizes": [len(kinds)], "edge": edge or now["edge"]})

        pos = None
        for batch in batches:
            for conv, turn, fault, initial, k, at, part in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                follows = pos is not None and at == pos + 1
                pos = at
                if now is None or not follows or conv != now["conv"]:
                    if now is not None:
                        close(edge=not follows)
                    now = dict.fromkeys(COUNTS, 0) | {"conv": conv, "part": part, "pos": at, "first_initial": initial, "last_initial": None, "first_turn": turn, "last_turn": None, "least_turn": None, "places": [at], "edge": not follows}
                    kinds = bytearray()
                if fault:
                    now[fault] += 1
                if kinds and now["last_initial"] + initial not in FOLLOWS:
                    now["illegal"] += 1
                if turn is not None:
                    if now["least_turn"] is None:
                        now["least_turn"] = turn
                    if turn != now["last_turn"]:
                        now["n_turns"] += 1
                    now["last_turn"] = turn
                now["last_initial"] = initial
                kinds.append(k)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out.clear()
        if now is not None:
            close(edge=True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return ordered.select("conv", "turn", "fault", "initial", "kind", "pos", "part").mapInArrow(run, schema)


def _merged(rows: list[dict]) -> dict:
    """Stretches of one conversation, by pos, as one."""
    rows = sorted(rows, key=lambda r: r["pos"])
    out = dict(rows[0])
    for r in rows[1:]:
        for c in COUNTS:
            out[c] += r[c]
        out["illegal"] += out["last_initial"] + r["first_initial"] not in FOLLOWS
        if out["last_turn"] is not None and out["last_turn"] == r["first_turn"]:
            out["n_turns"] -= 1
        out["last_initial"] = r["last_initial"]
        out["last_turn"] = r["last_turn"] if r["last_turn"] is not None else out["last_turn"]
        out["least_turn"] = out["least_turn"] if out["least_turn"] is not None else r["least_turn"]
    whole = product([tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows])
    return out | _packed(whole) | {"places": [p for r in rows for p in r["places"]], "sizes": [s for r in rows for s in r["sizes"]]}


def _reduced(found: DataFrame, stage: Stage) -> DataFrame:
    """One row for each conversation: those at edges are merged up the tree."""
    schema, kind = found.schema, _arrow(found.schema)
    edge = found.where("edge")
    top = edge.agg(F.max("part")).first()[0] or 0

    def merge(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_merged(rows.select(schema.names).to_pylist())], schema=kind)

    while True:
        top //= FAN_IN
        edge = edge.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        edge = stage.keep(edge.groupBy("conv", "part").applyInArrow(merge, schema))
        if not top:
            return found.where("NOT edge").unionByName(edge)


def _dealt(whole: dict) -> Iterator[tuple[int, str, int]]:
    """(pos, audit, state at its beginning) of each stretch."""
    audit = cheapest(tuple(None if c is None else (c, a) for c, a in zip(whole["costs"], whole["audits"], strict=True)))[1]
    at = made = 0  # made: turns that are there after the edits so far
    system = (len(audit) - audit.count("D")) % 2  # only with a system turn is their number odd
    for n, (pos, size) in enumerate(zip(whole["places"], whole["sizes"], strict=True)):
        begin, left = at, size
        while left:
            left -= audit[at] != "I"
            at += 1
        if n == len(whole["places"]) - 1:
            at = len(audit)
        yield pos, audit[begin:at], 0 if not made else 1 if made == system else 2 + (made - system + 1) % 2
        made += at - begin - audit.count("D", begin, at)


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _reports(whole: DataFrame) -> DataFrame:
    """(conv and REPORT) of each conversation."""
    schema = T.StructType([whole.schema["conv"], *T._parse_datatype_string(REPORT)])
    kind = _arrow(schema)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = cheapest(tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)))
                gaps = 0 if r["least_turn"] is None else r["last_turn"] - r["least_turn"] + 1 - r["n_turns"]
                out.append({"conv": r["conv"], "gaps": gaps, **{c: r[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return whole.mapInArrow(run, schema)


# -- results -----------------------------------------------------------------


def repair_reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and the digest of what they leave.

    every: a table of one column of conversations that get a row in any case. The digest
    takes a conversation's texts in their order, so one task streams them, whatever their length.
    """
    stage = Stage(turns.sparkSession)
    ordered = _ordered(turns, conv_col, turn_col, role_col, text_col, stage)
    reports = _reports(_reduced(stage.keep(_stretches(ordered)), stage))
    own = [f.split()[0] for f in REPORT.split(", ")]
    body = ordered.select("conv", F.lit(2).alias("tag"), "pos", "role", "text")
    heads = reports.select("conv", F.lit(1).alias("tag"), F.lit(-1).cast("long").alias("pos"), *own)
    stream = body.unionByName(heads, allowMissingColumns=True)
    if every is not None:
        stream = stream.unionByName(every.select(F.col(every.columns[0]).alias("conv")).distinct().withColumn("tag", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), *T._parse_datatype_string(REPORT), T.StructField("repaired_sha256", T.StringType())])
    kind = _arrow(schema)
    zeros = dict.fromkeys(own, 0) | {"audit": ""}

    def run(batches):
        now, out, editor, digest = None, [], Editor(""), hashlib.sha256()
        n = 0

        def put(lines):
            nonlocal n
            for role, text, _ in lines:
                digest.update(f"\n{role}:{text}".encode() if n else f"{role}:{text}".encode())
                n += 1

        def close():
            put(editor.inserted())
            out.append({**now, "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv"] != now[conv_col]:
                    if now is not None:
                        close()
                    now, editor, digest, n = {conv_col: r["conv"], **zeros}, Editor(""), hashlib.sha256(), 0
                if r["tag"] == 1:
                    now |= {c: r[c] for c in own}
                    editor = Editor(r["audit"])
                elif r["tag"] == 2:
                    put(editor.turn(r["role"], r["text"]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out.clear()
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return stream.repartition("conv").sortWithinPartitions("conv", "tag", "pos").mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations' turns: conversation, place (rises with the order), role, text and edit (K, R or I).

    Stretches are edited each for itself, so a very long conversation is the work of many tasks."""
    stage = Stage(turns.sparkSession)
    ordered = _ordered(turns, conv_col, turn_col, role_col, text_col, stage)
    whole = _reduced(stage.keep(_stretches(ordered)), stage)
    conv = ordered.schema["conv"]
    piece = T.StructType([conv, *T._parse_datatype_string("pos bigint, audit string, state int")])
    kind = _arrow(piece)

    def deal(batches):
        for batch in batches:
            out = [{"conv": r["conv"], "pos": pos, "audit": audit, "state": state} for r in batch.to_pylist() for pos, audit, state in _dealt(r)]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    heads = whole.mapInArrow(deal, piece).withColumn("tag", F.lit(0)).withColumn("part", F.shiftright("pos", 33))
    stream = ordered.select("conv", "part", "pos", F.lit(1).alias("tag"), "role", "text").unionByName(heads, allowMissingColumns=True)
    schema = T.StructType([T.StructField(conv_col, conv.dataType), *T._parse_datatype_string("place bigint, nth int, role string, text string, edit string")])
    shape = _arrow(schema)

    def run(batches):
        editor, at = Editor(""), (None, 0)  # at: the conversation and place of what the editor did last
        for batch in batches:
            out: list[dict] = []

            def put(lines) -> None:
                for nth, (role, text, edit) in enumerate(lines):
                    out.append({conv_col: at[0], "place": at[1], "nth": nth, "role": role, "text": text, "edit": edit})

            for r in batch.to_pylist():
                if r["tag"] == 0:
                    at = (at[0], at[1] + 1)
                    put(editor.inserted())
                    editor = Editor(r["audit"], r["state"])
                else:
                    at = (r["conv"], r["pos"])
                    put(editor.turn(r["role"], r["text"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
        out = []
        at = (at[0], at[1] + 1)
        for nth, (role, text, edit) in enumerate(editor.inserted()):
            out.append({conv_col: at[0], "place": at[1], "nth": nth, "role": role, "text": text, "edit": edit})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return stream.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos", "tag").mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with every fault, by a checksum of conversation and turn."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    times_ = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return turns.withColumn("code", code).select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times_)).alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_reports(damaged(turns), every=turns.select("conv_id"))


OP13_SQL = """
WITH RECURSIVE bits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(name)), lambda i: ascii(name[i + 1])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS code FROM bits),
hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair,
         CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
inserts(a, b, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
steps(role, a, b) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits(a, b, letter, role, cost) AS (
  SELECT a, b, 'K', role, 0 FROM steps UNION ALL SELECT a, b, 'R', NULL, 1 FROM steps WHERE role <> 's'
  UNION ALL SELECT k, k, 'D', NULL, 2 FROM range(4) r(k)),
paths AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, {'c': 0, 'a': ''} AS best FROM faults
  UNION ALL
  SELECT p.conv_id, j.n, e.b, min({'c': (p.best.c + i.cost + e.cost + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END)::INT, 'a': p.best.a || i.audit || e.letter})
  FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.n = p.n + 1 JOIN inserts i ON i.a = p.state JOIN edits e ON e.a = i.b
  WHERE CASE e.letter WHEN 'D' THEN true WHEN 'R' THEN j.fault IN ('', 'truncated') ELSE e.role = j.initial AND j.fault IN ('', 'truncated') END
  GROUP BY p.conv_id, j.n, e.b),
ended AS (
  SELECT p.conv_id, min({'c': p.best.c + i.cost, 'a': p.best.a || i.audit}) AS best
  FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n JOIN inserts i ON i.a = p.state AND i.b IN (0, 3) GROUP BY p.conv_id),
letters AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS idx FROM ended),
placed AS (
  SELECT conv_id, idx, audit[idx] AS letter, length(replace(audit[:idx], 'I', '')) AS n,
         length(replace(audit[:idx], 'D', '')) - length(replace(audit, 'D', '')) % 2 AS spot FROM letters),
lines AS (
  SELECT p.conv_id, p.idx, CASE WHEN letter = 'K' THEN j.role WHEN spot % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE j.text END AS line
  FROM placed p LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.n = p.n WHERE letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY idx) AS repaired FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
       coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit,
       sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
