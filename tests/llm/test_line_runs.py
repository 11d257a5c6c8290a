"""Line dedup against runs of hashes: whole texts against a slow twin, the index against plain counts."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from test_operators import FOLD, LONG, ODD, frame
from tessera.llm import line_runs, registry
from tessera.llm.common import table


def slow_drop(docs, min_chars=40, min_docs=5):
    """(id, lines, dropped, kept text) of each row."""
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(FOLD)

    holders = defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    pool = [f"{'Line' if k % 2 else 'ligne'} numéro {k} " + "of some forty characters or more" * (1 + k % 2) for k in range(30)]
    ends = ["", " ", "\t", "\r", "\x0b ", "\xa0"]
    docs = []
    for i in range(n):
        lines = [rng.choice(ends) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(ends) for x in rng.choices(pool, weights=[40, *[1] * 29], k=rng.randrange(9))]
        docs.append((i, "\n".join([*lines, "short", *[f"own line of document {i} that is long enough" for _ in range(i % 3)], *lines[:1]])))
    return docs


@pytest.mark.parametrize(("batches", "fanout", "min_docs"), [(1, 2, 5), (4, 2, 5), (7, 3, 2), (5, 2, 1)])
def test_drop_lines(spark, batches, fanout, min_docs):
    docs = made(batches, 90)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = line_runs.drop_lines(df, batches=batches, fanout=fanout, min_docs=min_docs)
    want = slow_drop(docs, min_docs=min_docs)
    assert as_rows(got) == sorted(want, key=str) and (min_docs == 1 or sum(w[2] for w in want) > 50)


def test_drop_lines_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in registry.QUERIES["op12_line_runs"](spark, sf_dir).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in slow_drop(docs)}


def test_drop_lines_odd(spark):
    line = "the one line that everybody here holds, ever again"
    rows = [*ODD, *[(i, f"{line}\n\n {line.upper()}\n", "en") for i in (20, 20, 21, 21, None, None, 22)], (30, "\n" * 5000, "en"), (31, "x" * 39 + "\n" + "é" * 40, "fr"), (32, "é" * 40, "fr"), (33, LONG + "\n" + line, "de")]
    rows.append(rows[-1])
    want = slow_drop([r[:2] for r in rows], min_docs=2)
    df = frame(spark, rows).withColumn("kept_text", F.lit("clash")).withColumn("gone", F.lit(1)).withColumn("t", F.lit(2))
    got = line_runs.drop_lines(df, min_docs=2)
    assert as_rows(got) == sorted(want, key=str) and {"lang", "gone", "t", "_tess_text"} <= set(got.columns)
    assert line_runs.drop_lines(df.limit(0)).count() == 0
    text_ids = line_runs.drop_lines(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), min_docs=2)
    assert text_ids.count() == len(rows)


def test_lines_without_a_larger_id_all_stay(spark):
    line = "a line that only rows without an id hold, five times"
    got = line_runs.drop_lines(spark.createDataFrame([(None, line)] * 5, "doc_id bigint, text string"))
    assert {r.kept_text for r in got.collect()} == {line}


def test_runs_settle_and_are_compacted(spark):
    rng = random.Random(8)
    index, docs, tops, stored = line_runs.LineRuns(spark, min_docs=3, fanout=2, buckets=4), defaultdict(int), {}, 0
    for _ in range(6):
        batch = {k: (rng.randrange(1, 4), rng.randrange(1000)) for k in rng.sample(range(40), 25)}
        for k, (n, top) in batch.items():
            docs[k] += n
            tops[k] = max(tops.get(k, -1), top)
        stored += len(batch)
        index.add(spark.createDataFrame([(k, -k, n, top) for k, (n, top) in batch.items()], "h1 bigint, h2 bigint, docs bigint, top bigint").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")))
        got = {r.h1: (r.docs, r.top) for r in index.lines().collect()}
        assert {k: min(n, 3) for k, n in docs.items()} == {k: min(n, 3) for k, (n, _) in got.items()}
        assert {k: t for k, (_, t) in got.items()} == tops
    assert [len(x) for x in index.levels] == [0, 1, 1], "six runs: one of four batches, one of two"
    assert sum(spark.table(r).count() for r in index.runs()) < stored
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_run")]
