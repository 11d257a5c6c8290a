"""Exact dedup: two-pass Bloom filtering in DataFrame functions alone.

Pass one counts hash positions (a counting Bloom filter with one hash) and
turns the positions hit at least twice into a bitmap of ``bits`` bits. Pass two
tests every row against it: rows on a position hit once have no copy and pass
straight through; only the possibly repeated ones shuffle, by SHA-256 of the
normalised text, so false positives cost a shuffled row and never a result.

The bitmap has 16 bits a row and ``max_bits`` at most (2**28 bits, 32 MB: the
proven bound of what is broadcast). Beyond 16 million rows the share of
false positives grows, and with it only the rows that shuffle.

Groups are counted with map-side aggregation and written to the shared folder;
the join that brings a group's row back to its members is then a plain join of
two exchanges, whose hot keys adaptive execution splits.

Defined cases: null text counts as empty; texts are equal after folding A-Z;
of equal texts the largest (or, with keep="min", smallest) id stays; rows that
repeat an id and its text are all marked as that id is; a null id is smaller
than any other and stays only if its whole group has null ids; an empty table
gives an empty result; output columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import Stage, ascii_lower, free_name, table

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """All rows and columns of docs with keep_id, group_size, kept and text_sha256."""
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be max or min, not {keep!r}")
    own = [c for c in docs.columns if c not in RESULT]
    docs = docs.select(*own)
    maybe = free_name([*own, *RESULT], "_tess_maybe")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    bits = bloom.size_for(docs.count(), max_bits)
    stage = Stage(docs.sparkSession)
    repeated = bloom.bits_of(docs, norm, bits, stage, repeated=True)
    marked = bloom.test(docs, norm, repeated, bits, maybe).withColumn("text_sha256", F.sha2(norm.cast("binary"), 256))
    alone = marked.where(~F.col(maybe)).select(*own, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = marked.where(maybe)
    best = F.max(id_col) if keep == "max" else F.min(id_col)
    groups = stage.keep(rest.groupBy("text_sha256").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = rest.join(groups, "text_sha256").select(*own, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
