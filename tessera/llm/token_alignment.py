"""Alignment of two tokenizers' outputs over the same bytes.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).
Their tokens are walked side by side by the byte offsets at which they end; where
both end, a group closes, and its last tokens are linked. Both vocabularies cut a
text before every space that follows a character that is no white space, so a text
is a row of chunks, each distinct chunk is encoded and merged once (inside
mapInArrow), and a text's groups are its chunks' groups in a row.

Each text leaves its sums and its distinct linked pairs with their number. Spark
counts pairs over the corpus (with sums made before the shuffle), takes each B
token's largest count and joins both back to the texts' pairs. Of two linked
tokens one is a suffix of the other, so there are never more pairs than
``most_pairs`` finds in the vocabularies alone (324,297 for the two public ones);
the join is broadcast behind a check against ``MAX_PAIRS``, and a plain one beyond.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give
back (U+2581, which B writes for a space), have no tokens: zeros and an empty
string; special tokens' strings are plain text; rows may repeat an id, each is
read by itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Stage, free_name, table, worker_slot

#: Rows of counted pairs that are broadcast at most (17 bytes each).
MAX_PAIRS = 1 << 20
_LATE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
CACHE_WORDS, CACHE_LENGTH = 250_000, 64


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:  # a file of the installed package, on every machine
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def piece_bytes(model) -> list[bytes]:
    """The bytes that each piece stands for."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def merge_ends(a: Iterable[int], b: Iterable[int], a_sizes, b_sizes) -> list[tuple[list[int], list[int]]]:
    """Two pointers over cumulative ends: groups of tokens of both sides, cut wherever both end."""
    out, b_ids = [], iter(b)
    group_a, group_b, end_a, end_b = [], [], 0, 0
    for x in a:
        group_a.append(x)
        end_a += a_sizes[x]
        while end_b < end_a:
            y = next(b_ids)
            group_b.append(y)
            end_b += b_sizes[y]
        if end_a == end_b:
            out.append((group_a, group_b))
            group_a, group_b = [], []
    return out


class Aligner:
    """Texts to their groups and links, through a cache of chunks."""

    def __init__(self, path_a: str, path_b: str, cache_words: int = CACHE_WORDS) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(path_a)
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b_bytes = piece_bytes(self.b)
        self.a_sizes = {i: len(t) for i, t in self.a_bytes.items()}
        self.b_sizes = [len(t) for t in self.b_bytes]
        self.space = self.b.piece_to_id("▁")
        # a piece that went on after a space would span chunks
        self.chunked = not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.b_bytes)
        self.cache: dict[str, tuple] = {}
        self.limit = cache_words

    def entry(self, chunk: str, b_ids: list[int]) -> tuple | None:
        """(groups, links, tokens of A, of B, groups) of a space and the chunk; None where bytes are not given back."""
        raw = b" " + chunk.encode()
        a_ids = self.a.encode_ordinary(" " + chunk)
        if raw != b"".join([self.a_bytes[i] for i in a_ids]) or raw != b"".join([self.b_bytes[i] for i in b_ids]):
            return None
        groups = merge_ends(a_ids, b_ids, self.a_sizes, self.b_sizes)
        text = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups])
        return text.encode(), np.array([x[-1] << 16 | y[-1] for x, y in groups], "<u4").tobytes(), len(a_ids), len(b_ids), len(groups)

    def learn(self, chunks: set[str]) -> dict[str, tuple]:
        """Entries of new chunks; short ones go to the cache."""
        names = list(chunks)
        made = {c: self.entry(c, ids if c else [self.space]) for c, ids in zip(names, self.b.encode(names, num_threads=1) if names else [], strict=True)}
        self.cache.update((c, e) for c, e in made.items() if len(c) <= CACHE_LENGTH)
        return made

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, each without the space it begins with."""
        if not self.chunked:
            return [text]
        whole = " " + text
        return [c[1:] for c in _CUT.split(whole)] if _LATE.search(whole) else text.split(" ")

    def __call__(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The entries of each text in a row; None for a text without tokens."""
        docs = [self.chunks(t) if t else [] for t in texts]
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = self.learn(set().union(*docs).difference(self.cache))
        out: list[list[tuple] | None] = []
        for chunks in docs:
            found = [self.cache[c] if c in self.cache else new[c] for c in chunks]
            out.append(found if found and None not in found else None)
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_slot(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def most_pairs(path_a: str, path_b: str) -> int:
    """How many pairs can ever be linked: those of which one token's bytes end the other's."""
    import sentencepiece

    a = byte_ranks(path_a)
    b: dict[bytes, int] = {}
    for t in piece_bytes(sentencepiece.SentencePieceProcessor(model_file=path_b)):
        b[t] = b.get(t, 0) + 1
    return sum(b.get(t[k:], 0) for t in a for k in range(len(t))) + sum(n for t, n in b.items() for k in range(1, len(t)) if t[k:] in a)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """The id, n_a, n_b, n_groups, n_links, groups and pairs of each row.

    groups: ``a1,a2|b1;a3|b2,b3`` (with digest its SHA-256, empty without tokens); pairs: the
    distinct linked pairs (a * 65536 + b) with the number of links.
    """
    a, b = (given or own for given, own in zip((path_a, path_b), paths(), strict=True))
    pairs = T.ArrayType(T.StructType([T.StructField("pair", T.LongType(), False), T.StructField("n", T.LongType(), False)]), False)
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType()), T.StructField("pairs", pairs)])

    def run(batches):
        align = aligner(a, b)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sums, groups, links, sizes = [], [], [], []
                for found in align(batch.column(1).to_pylist()):
                    if not found:
                        sums.append((0, 0, 0, 0))
                        groups.append("")
                        sizes.append(0)
                        continue
                    texts, codes, n_a, n_b, n_groups = zip(*found, strict=True)
                    text, n = b";".join(texts), sum(n_groups)
                    sums.append((sum(n_a), sum(n_b), n, n))
                    groups.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                    links.append(b"".join(codes))
                    sizes.append(n)
                keys = np.frombuffer(b"".join(links), "<u4").astype(np.int64) | np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32
                keys, counts = np.unique(keys, return_counts=True)
                ends = np.searchsorted(keys >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(keys & 0xFFFFFFFF), pa.array(counts.astype(np.int64))], names=["pair", "n"])
                columns = [batch.column(0), *[pa.array([s[j] for s in sums], pa.int64()) for j in range(4)], pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends), each)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias(free_name([id_col], "text"))).mapInArrow(run, schema)


def pair_counts(groups: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair over the corpus; best: no pair of the same B token has more."""
    counts = groups.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("count")).withColumn("b", F.col("pair") % 65536)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Each row's id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    stage = Stage(docs.sparkSession)
    row, best, total = (free_name([id_col, *COUNTS], f"_tess_{x}") for x in ("row", "best", "sum"))
    found = stage.keep(token_groups(docs, id_col, text_col, path_a, path_b, digest=True).withColumn(row, F.monotonically_increasing_id()))
    counts = stage.keep(pair_counts(found))
    links = found.select(row, F.explode("pairs").alias("x")).select(row, "x.pair", "x.n")
    stats = F.broadcast(counts) if counts.count() <= max_pairs else counts
    sums = links.join(stats, "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias(best), F.sum(F.col("n") * F.col("count")).alias(total))
    zero = F.lit(0).cast("long")
    return found.join(sums, row, "left").select(id_col, *COUNTS, F.coalesce(best, zero).alias("n_best"), F.coalesce(total, zero).alias("count_sum"), F.col("groups").alias("groups_sha256"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_sums(table(spark, sf_dir, "documents"))
