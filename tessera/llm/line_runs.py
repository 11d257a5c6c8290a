"""Line dedup against levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table (h1, h2, docs, top) that is bucketed and sorted by its hashes:
how many documents hold a line, and the largest id of one. A new batch of lines
is grouped by hash (one exchange, with sums made before it) and then
merge-anti-joins the runs. Neither side is exchanged for that, as the grouped
batch lies in the runs' buckets already. The anti-join leaves out what a run has settled:
lines already found in ``min_docs`` documents under an id at least as large. The
rest becomes the batch's own run of level 0; common lines are thus stored a few
times, not once for each batch. As soon as a level holds ``fanout`` runs they are
compacted into one of the next level, again bucket by bucket, again without an exchange.
``LineRuns`` keeps an index over any number of batches in any order.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
folded; it is known by two 64-bit hashes of different seeds. Keys of fewer than
``min_chars`` code points take no part. ``drop_lines`` removes all lines of keys
that at least ``min_docs`` documents hold, but for those in the documents of the
largest id. Documents are split once into hashes (written to the shared folder,
one part a batch) and, where lines must go, once more into lines; only those
documents' texts shuffle, by the same plan at every size. A line of a third of all documents is one row for each
map task when grouped, and a hot key of a plain join when its places are looked
up, which adaptive execution splits.

Defined cases: null text counts as empty, which is one empty line; each row is a
document, rows may repeat an id (all rows of the largest id keep their lines);
a null id is smaller than any other; an empty table gives no rows; result
columns replace input columns of the same name, other columns are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import Stage, ascii_lower, free_name, table
from tessera.sources.staging import shared_dir

#: What the key rule strips at a line's ends.
BLANKS = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
RESULT = ("n_lines", "n_dropped", "kept_text")


class LineRuns:
    """An index of line hashes that grows by batches of (h1, h2, docs, top), one row a line."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.stage = Stage(spark)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, docs, top), grouped by the hashes and so dealt like the buckets. Rows that runs have settled are left out, the others are a run."""
        own = batch
        for run in self.runs():
            same = (F.col("o.h1") == F.col("r.h1")) & (F.col("o.h2") == F.col("r.h2")) & (F.col("r.top").eqNullSafe(F.col("o.top")) | F.col("o.top").isNull() | (F.col("r.top") >= F.col("o.top")))
            settled = self.spark.table(run).where(F.col("docs") >= self.min_docs)
            own = own.alias("o").join(settled.hint("merge").alias("r"), same, "left_anti")
        self._put(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(self._merged(runs), level + 1)
            self._delete(runs)
            level += 1

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def lines(self) -> DataFrame:
        """(h1, h2, docs, top), each line once. docs is exact below min_docs; a settled line may count fewer than it has."""
        return self._merged(self.runs())

    def drop(self) -> None:
        self._delete(self.runs())
        self.levels = []

    def _merged(self, runs: list[str]) -> DataFrame:
        """Full outer merge joins, run by run; two runs lie in the same buckets and meet without an exchange.

        (A grouped union of them would need none for any number, but Spark 4.1 then reads the runs without their buckets.)"""
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            a, b = out.alias("a"), self.spark.table(run).hint("merge").alias("b")
            counts = (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs")
            joined = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
            out = joined.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), counts, F.greatest("a.top", "b.top").alias("top"))
        return out

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"tessera_run_{uuid.uuid4().hex}"
        place = f"{shared_dir(self.spark)}/tessera-{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", place).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.levels[level].append(name)

    def _delete(self, runs: list[str]) -> None:
        for run in runs:
            files = self.spark.table(run)
            self.stage.drop(files)
            self.spark.sql(f"DROP TABLE {run}")


def _key_hashes(text: Column, min_chars: int) -> Column:
    """(h1, h2, pos) of a text's lines that are long enough, sorted."""
    lines = F.split(ascii_lower(text), "\n", -1)
    found = F.filter(F.transform(lines, lambda x, i: F.struct(F.when(F.length(x) >= min_chars, F.btrim(x, F.lit(BLANKS))).alias("key"), i.alias("pos"))), lambda x: F.length(x.key) >= min_chars)
    return F.sort_array(F.transform(found, lambda x: F.struct(F.xxhash64(x.key).alias("h1"), F.xxhash64(F.lit(1), x.key).alias("h2"), x.pos.alias("pos"))))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows of docs with n_lines, n_dropped and kept_text."""
    spark = docs.sparkSession
    stage = Stage(spark)
    own = [c for c in docs.columns if c not in RESULT]
    docs = docs.select(*own)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is known by its id and its text's hash; rows that agree in both lose the same lines
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))

    hashed = docs.select(row.alias("row"), _key_hashes(text, min_chars).alias("found")).where(F.size("found") > 0)
    before = F.get("found", F.col("at") - 1)
    first = (F.col("at") == 0) | (before["h1"] != F.col("x.h1")) | (before["h2"] != F.col("x.h2"))
    each = hashed.select("row", "found", F.posexplode("found").alias("at", "x")).select("row.id", "row.t", "x.h1", "x.h2", "x.pos", first.alias("first"), F.pmod(F.xxhash64("row.id"), F.lit(batches)).alias("batch"))
    path = f"{stage.base}/lines"
    each.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(each.schema).parquet(path)

    index = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        index.add(lines.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("id").alias("top")))
    common = stage.keep(index.lines().where(F.col("docs") >= min_docs).select("h1", "h2", "top"))
    index.drop()

    bits = bloom.size_for(common.count())
    maybe = bloom.test(lines, F.xxhash64("h1", "h2"), bloom.bits_of(common, F.xxhash64("h1", "h2"), bits, stage), bits, "maybe").where("maybe")
    lost = maybe.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("top")))
    gone = stage.keep(lost.groupBy("id", "t").agg(F.collect_set("pos").alias("gone")))

    names = {n: free_name([*own, *RESULT], f"_tess_{n}") for n in ("id", "t", "gone", "maybe", "lines")}
    bits = bloom.size_for(gone.count())
    key = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text))
    marked = bloom.test(docs, key, bloom.bits_of(gone, F.xxhash64(F.col("id").cast("string"), F.col("t")), bits, stage), bits, names["maybe"])
    whole = (F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept_text"))
    gone = gone.select(*[F.col(c).alias(names[c]) for c in ("id", "t", "gone")])
    same = F.col(id_col).eqNullSafe(F.col(names["id"])) & (F.xxhash64(text) == F.col(names["t"]))
    cut = marked.where(names["maybe"]).join(gone.hint("merge"), same, "left").select(*own, names["gone"], F.split(text, "\n", -1).alias(names["lines"]))
    # sets of numbers differ in one pass over both, however many lines go
    kept = F.array_except(F.sequence(F.lit(0), F.size(names["lines"]) - 1), F.coalesce(F.col(names["gone"]), F.array().cast("array<int>")))
    left = F.array_join(F.transform(kept, lambda p: F.get(F.col(names["lines"]), p)), "\n")
    cut = cut.select(*own, F.size(names["lines"]).cast("long").alias("n_lines"), F.coalesce(F.size(names["gone"]), F.lit(0)).cast("long").alias("n_dropped"), left.alias("kept_text"))
    return marked.where(~F.col(names["maybe"])).select(*own, *whole).unionByName(cut)


def op12_line_runs(spark, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.pos, k.line, c.top IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
