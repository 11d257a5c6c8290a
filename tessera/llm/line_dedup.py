"""Substring dedup by hashing lines and the sentences within them.

A text is cut into units: at every line end, and within a line after sentence
ends once a unit has ``least_words`` words (so short sentences join the next
one, and units fall into step again soon after any place where texts begin to
agree). Short lines in a row join into units of their own: one ends with a line
whose checksum is even once it has enough words, so these units too fall into
step wherever they begin. Scripts without spaces count two characters as a
word, and their full stops end sentences. A unit is normalised (A-Z folded, words one space apart) and known by a
128-bit digest. Digests are grouped over all documents, with sums made before
the shuffle; the earliest occurrence by (rank, offset) of each is kept and the
others are removed. Every removed unit is reported with its offsets in the
original text.

Units with fewer than ``least_words`` words are never removed: such lines repeat
by chance in clean documents. What is left of a row of short lines before a
longer one is such a unit.

The text is read twice: once to find the digests that occur more than once, once
to list their occurrences. A bit filter (32 MB at most) keeps other units from
the second shuffle, and the join of occurrences with kept places is one of two
plain exchanges, so that a unit of millions of documents is split by adaptive
execution.

Defined cases: null and empty texts have no units; ids, of any type that has an
order, rank documents (smallest first), ties of repeated ids by offset; rows that repeat an id are each read,
and their units are the same places; a null id ranks before all others; texts
of one unit work like any other; other columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bloom
from tessera.llm.common import Stage, free_name, table

LEAST_WORDS = 7
_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D])|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])+|\n+")
#: Characters of Chinese, Japanese, Thai and Lao.
_WIDE = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}")


def units(text: bytes | None, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units with enough words; offsets in UTF-8 bytes."""
    if not text:
        return []
    out, start = [], 0
    run, run_size = 0, 0  # where the short lines before this one begin, and their words

    def add(start: int, part: bytes, words: list[bytes]) -> None:
        out.append((start + len(part) - len(part.lstrip()), start + len(part.rstrip()), len(words), xxhash.xxh128_digest(b" ".join(words))))

    def add_run(end: int) -> None:
        part = text[run:end]
        add(run, part, part.lower().split())

    ends = [(m.end(), m.group()[:1] == b"\n") for m in _END.finditer(text)]
    ends.append((len(text), True))
    for end, line in ends:
        part = text[start:end]
        if not line and part.count(b" ") + 1 < least_words and part.isascii():
            continue
        words = part.lower().split()
        size = len(words)
        if size < least_words and not part.isascii():
            size += len(_WIDE.findall(part)) // 2
        if size >= least_words:
            if run_size >= least_words:
                add_run(start)
            run_size = 0
            add(start, part, words)
        elif not line:
            continue
        elif words:
            run = run if run_size else start
            run_size += size
            if run_size >= least_words and (run_size >= 4 * least_words or not xxhash.xxh64_intdigest(b" ".join(words)) & 1):
                add_run(end)
                run_size = 0
        start = end
    if run_size >= least_words:
        add_run(len(text))
    return out


UNIT = "start bigint, stop bigint, words bigint, digest binary"


def _units_of(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                found = [units(t, least_words) for t in batch.column(1).to_pylist()]
                n = [len(f) for f in found]
                flat = [u for f in found for u in f]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                cols = [pa.array([u[j] for u in flat], pa.int64() if j < 3 else pa.binary()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "start", "stop", "words", "digest"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(UNIT)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each unit to remove: where it lies, which occurrence stays, and how often it occurs.

    The id, byte_start, byte_length (in the original UTF-8 text), n_words, keep_id, keep_byte_start, copies.
    """
    stage = Stage(docs.sparkSession)
    all_units = _units_of(docs, id_col, text_col, least_words)
    groups = all_units.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = stage.keep(groups)
    bits = bloom.size_for(groups.count())
    again = bloom.test(all_units, F.col("digest"), bloom.bits_of(groups, F.col("digest"), bits, stage), bits, "maybe").where("maybe").drop("maybe")
    joined = again.join(groups, "digest").where(~F.struct("id", "start").eqNullSafe(F.col("first")))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("start").alias("byte_start"),
        (F.col("stop") - F.col("start")).alias("byte_length"),
        F.col("words").alias("n_words"),
        F.col("first.id").alias("keep_id"),
        F.col("first.start").alias("keep_byte_start"),
        "copies",
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated units cut out of the text; removed_spans has their byte offsets in the original."""
    spans, key = free_name(docs.columns, "removed_spans"), free_name(docs.columns, "_tess_id")
    found = repeated_units(docs, id_col, text_col, least_words).groupBy(F.col(id_col).alias(key)).agg(F.array_sort(F.collect_set(F.struct("byte_start", "byte_length"))).alias(spans))
    joined = docs.join(found, docs[id_col].eqNullSafe(found[key]), "left").drop(key)
    schema = T.StructType([*docs.schema, joined.schema[spans]])
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(place).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                if text is not None and cuts:
                    raw, at, kept = text.encode(), 0, []
                    for c in cuts:
                        kept.append(raw[at : c["byte_start"]])
                        at = c["byte_start"] + c["byte_length"]
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
                texts.append(text)
            yield batch.set_column(place, text_col, pa.array(texts, batch.column(place).type))

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))
