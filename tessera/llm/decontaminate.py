"""Benchmark decontamination with suffix arrays over the training text.

Every batch of documents is a shard: its word positions, sorted by the words
that follow, form a suffix array. Positions whose word no benchmark item holds
can start no match and are left out of it. Each suffix of each test item is
binary-searched in the shard's array for its first ``window`` words (an item
with fewer words is searched whole), and every hit is extended word by word to
its longest verbatim match. Documents never shuffle; the test items travel to
the shards in broadcast blocks of at most ``block_bytes`` of text, one pass each,
so the driver holds one block at a time; a task runs the passes of all blocks side
by side, which suits benchmarks of some blocks, not of thousands.

Words are runs of letters, digits and non-ASCII characters, A-Z folded.

Defined cases: null text has no words; items without words or with null text
match nothing; items with equal text are each reported; a null item id is left
out of lists of ids; ids of documents may repeat or be null, rows are never
merged; with no items every document is clean; added columns replace input
columns of the same name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD_BYTES, free_name, table

WINDOW = 10
#: Pairs of a test's window and a place in the texts that are looked at together.
PAIRS = 1 << 19
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("length", T.LongType())])
RESULT = ("n_words", "hit_spans", "matches")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


class Tests:
    """The test items' windows, each as the bytes of its word numbers, in order of the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.items: list[tuple[str, np.ndarray]] = []
        starts, owner, sizes = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)
            for s in range(max(1, len(ids) - window + 1)):
                starts.append(s)
                owner.append(len(self.items))
                sizes.append(min(window, len(ids)))
            self.items.append((item_id, ids))
        self.starts, self.owner, self.sizes = (np.array(x, np.int64) for x in (starts, owner, sizes))
        self.least = int(self.sizes.min(initial=window))
        # all items in a row, a 0 before each and after the last
        self.offset = np.cumsum([1, *(len(ids) + 1 for _, ids in self.items)])
        self.flat = np.concatenate([x for _, ids in self.items for x in (np.zeros(1, np.int64), ids)] + [np.zeros(1, np.int64)])
        padded = np.zeros((len(starts), window), ">u4")
        above = np.full((len(starts), window), 0xFFFFFFFF, ">u4")
        for i, (s, o, n) in enumerate(zip(starts, owner, sizes, strict=True)):
            padded[i, :n] = above[i, :n] = self.items[o][1][s : s + n]
        self.low, self.high = self.keys(padded), self.keys(above)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel()

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[tuple[str, int, int, int]]]]:
        """For each text: words, merged hit spans, and the longest match of each item."""
        counts, parts = [], []
        for text in texts:
            words = words_of(text) if text else []
            counts.append(len(words))
            parts.append(np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))  # no match runs on into the next document
        out = [(n, [], []) for n in counts]
        if not len(self.starts) or not parts:
            return out
        flat = np.concatenate([*parts, np.zeros(self.window, np.int64)])
        first = np.cumsum([0, *(n + 1 for n in counts)])
        # words in a row that tests know, from each position on
        stops = np.flatnonzero(flat == 0)
        run = stops[np.searchsorted(stops, np.arange(len(flat)))] - np.arange(len(flat))
        place = np.flatnonzero(run >= self.least)
        if not len(place):
            return out
        suffix = np.zeros((len(place), self.window), ">u4")
        for k in range(self.window):
            suffix[:, k] = np.where(run[place] > k, flat[np.minimum(place + k, len(flat) - 1)], 0)
        key = self.keys(suffix)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        left = np.searchsorted(key, self.low, "left")
        right = np.where(self.sizes == self.window, np.searchsorted(key, self.low, "right"), np.searchsorted(key, self.high, "right"))
        n = np.maximum(0, right - left)
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return out
        mark = np.zeros(len(flat) + 1, np.int64)
        heads = []
        for lo in range(0, int(ends[-1]), PAIRS):  # repetitive texts make many pairs: so many are held at a time
            pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
            test = np.searchsorted(ends, pair, "right")
            at = place[left[test] + pair - (ends[test] - n[test])]
            mark += np.bincount(at, minlength=len(mark)) - np.bincount(at + self.sizes[test], minlength=len(mark))
            # a match begins where the words before differ; the windows after its first one lie within it
            before = self.flat[self.offset[self.owner[test]] + self.starts[test] - 1]
            new = (before == 0) | (before != np.where(at > 0, flat[at - 1], 0))
            heads.append((test[new], at[new]))
        hit = np.cumsum(mark) > 0
        test, at = (np.concatenate(x) for x in zip(*heads, strict=True))
        doc, item, start = np.searchsorted(first, at, "right") - 1, self.owner[test], self.starts[test]
        length, on = self.sizes[test].copy(), np.arange(len(test))
        while len(on):  # word by word to the longest verbatim match
            ahead = self.flat[self.offset[item[on]] + start[on] + length[on]]
            on = on[(ahead != 0) & (ahead == flat[at[on] + length[on]])]
            length[on] += 1
        best = np.lexsort((at, start, -length, item, doc))
        one = np.ones(len(best), bool)
        one[1:] = (doc[best][1:] != doc[best][:-1]) | (item[best][1:] != item[best][:-1])
        for i in best[one]:
            d = doc[i]
            out[d][2].append((self.items[item[i]][0], int(start[i]), int(at[i] - first[d]), int(length[i])))
        for d in np.unique(doc):  # every hit lies in a match
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[first[d] : first[d + 1]], [False]])))
            out[d][1].extend((int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True))
        return out


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, n in sorted(a + b):
        if out and s <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), s + n) - out[-1][0])
        else:
            out.append((s, n))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k)
        yield [(r["id"], bytes(r["text"])) for r in part.orderBy("id", "text").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, shard_docs: int = 2000) -> DataFrame:
    """docs with n_words, hit_spans (merged, in words) and matches (the longest of each item)."""
    own = [c for c in docs.columns if c not in RESULT]
    raw = free_name(own, "_tess_text")
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField(raw, T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("matches", T.ArrayType(MATCH))])
    out = docs.select(*own, F.col(text_col).cast("binary").alias(raw)).select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(schema["hit_spans"].dataType).alias("hit_spans"), F.array().cast(schema["matches"].dataType).alias("matches"))
    spans_t = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    match_t = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Tests(items, window))  # goes to disk; the driver holds one block at a time

        def run(batches, shared=shared):
            tests = shared.value
            for whole in batches:
                for k in range(0, whole.num_rows, shard_docs):
                    batch = whole.slice(k, shard_docs)
                    found = tests.search(batch.column(raw).to_pylist())
                    spans = [[(x["start"], x["length"]) for x in old] for old in batch.column("hit_spans").to_pylist()]
                    spans = [_merged(a, f[1]) for a, f in zip(spans, found, strict=True)]
                    olds = [[tuple(x.values()) for x in old] for old in batch.column("matches").to_pylist()]
                    cols = [batch.column(i) for i in range(batch.num_columns - 3)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *cols,
                            pa.array([f[0] for f in found], pa.int64()),
                            pa.array([[dict(zip(("start", "length"), s, strict=True)) for s in x] for x in spans], spans_t),
                            pa.array([[dict(zip(("item_id", "item_start", "doc_start", "length"), m, strict=True)) for m in old + f[2]] for old, f in zip(olds, found, strict=True)], match_t),
                        ],
                        names=batch.schema.names,
                    )

        out = out.mapInArrow(run, schema)
    return out.select(*own, *RESULT)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their own columns."""
    return find_contamination(docs, benchmark, **options).where(F.size("hit_spans") == 0).select(*[c for c in docs.columns if c not in RESULT])


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_hit"),
        F.size(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM win)
  WHERE i + n - 1 <= len(w)
), hit AS (
  SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
