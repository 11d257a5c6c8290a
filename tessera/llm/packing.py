"""Hierarchical multi-length packing.

Documents are routed to the smallest of several context sizes (tiers) that
holds them; longer ones give full windows of the largest size and route what
remains. Each tier is packed longest document first; the gap in a window is
filled with the longest shorter documents that fit, from that tier or any
shorter one, and only what no whole document fits is filled by cutting one.
Every window is thus full. At the end of a partition what is left fills windows
of the tiers too; fewer tokens than the smallest tier remain then, and go to
tail tiers, the powers of two below it, one window of each at most, so that
nothing is padded. Their share falls with the partition's size (511 tokens of a
partition at most); ``tier`` tells them from the others. Windows are dealt to step groups of about ``step_tokens``
tokens, the longest first and always to the lightest group, so that groups
carry equal loads and a like mix of tiers.

A partition packs its own documents, a buffer of ``buffer_tokens`` at a time:
no token is shuffled and a task's memory doesn't grow with the input. Ids of
sequences and groups hold the partition's number in their upper bits.

Token ids are made word by word (see ``subwords``), each distinct word once.

Defined cases: null text counts as empty and gives the end token alone; ids may
be null or repeat (each row is a document of its own, told apart by nothing but
its pieces); an empty table gives no pieces; other columns of docs are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, table
from tessera.llm.subwords import subwords, words_of

TIERS = (512, 1024, 2048, 4096)
END_ID = 2


class Packer:
    """Packs a stream of (document, length) into full windows."""

    def __init__(self, tiers: Iterable[int] = TIERS, step_tokens: int = 16 * 4096, buffer_tokens: int = 1 << 20) -> None:
        self.tiers = sorted(tiers)
        if not self.tiers or any(t & (t - 1) or t < 1 for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.tail = [1 << b for b in reversed(range(self.tiers[0].bit_length() - 1))]
        self.step, self.buffer = step_tokens, buffer_tokens
        self.pending: list[tuple[int, int, object, int]] = []  # ascending length
        self.held = self.seen = self.groups = self.sequences = 0  # held: tokens pending

    def add(self, doc: object, length: int) -> Iterator[tuple]:
        """Yields (sequence, tier, group, [(document, start, length)]) as windows come out."""
        self.held += length
        self.seen += 1
        self._route(doc, 0, length)
        if self.held >= self.buffer:
            yield from self._flush(last=False)

    def finish(self) -> Iterator[tuple]:
        yield from self._flush(last=True)

    def _route(self, doc: object, start: int, length: int) -> None:
        if length:
            insort(self.pending, (length, self.seen, start, doc), key=lambda p: p[:3])

    def _flush(self, last: bool) -> Iterator[tuple]:
        windows: list[tuple[int, list[tuple[object, int, int]]]] = []
        top = self.tiers[-1]
        while self.pending:
            length, order, start, doc = self.pending.pop()
            size = top if length >= top else next(t for t in self.tiers if t >= length)
            if self.held < size:
                self.pending.append((length, order, start, doc))
                break
            window, gap = [], size
            while gap:
                take = min(gap, length)
                window.append((doc, start, take))
                if take < length:
                    insort(self.pending, (length - take, order, start + take, doc), key=lambda p: p[:3])
                gap -= take
                if gap:
                    k = bisect_right(self.pending, gap, key=lambda p: p[0])
                    # the longest that fits whole, else the shortest of those to be cut
                    length, order, start, doc = self.pending.pop(k - 1 if k else 0)
            windows.append((size, window))
            self.held -= size
        if last:
            flat = [(doc, start, length) for length, _, start, doc in reversed(self.pending)]
            total = sum(p[2] for p in flat)
            self.pending, self.held = [], 0
            sizes = []
            for tier in (*reversed(self.tiers), *self.tail):
                sizes += [tier] * (total // tier)
                total %= tier
            for size in sizes:
                window, gap = [], size
                while gap:
                    doc, start, length = flat.pop(0)
                    take = min(gap, length)
                    window.append((doc, start, take))
                    if take < length:
                        flat.insert(0, (doc, start + take, length - take))
                    gap -= take
                windows.append((size, window))
        n = max(1, round(sum(size for size, _ in windows) / self.step))
        loads = [(0, g) for g in range(n)]
        for size, window in sorted(windows, key=lambda x: -x[0]):
            load, g = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, g))
            yield self.sequences, size, self.groups + g, window
            self.sequences += 1
        self.groups += n if windows else 0


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, tiers: Iterable[int] = TIERS, step_tokens: int = 16 * 4096, buffer_tokens: int = 1 << 20) -> DataFrame:
    """A row for each piece of a document: where it lies in which sequence, and its ids (binary, unsigned 32-bit)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    own = [id_col, *("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in own[1:])])
    end = np.array([end_id], "<u4").tobytes()
    tiers = tuple(tiers)

    def run(batches):
        packer, base = Packer(tiers, step_tokens, buffer_tokens), TaskContext.get().partitionId() << 33
        encode = subwords(tokenizer_path)
        kinds = None

        def rows(windows):
            cols: list[list] = [[] for _ in own]
            for sequence, tier, group, window in windows:
                offset = 0
                for (doc_id, ids), start, length in window:
                    for c, v in zip(cols, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + sequence, offset, tier, base + group), strict=True):
                        c.append(v)
                    offset += length
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=own)

        for batch in batches:
            kinds = [batch.schema.types[0], *(pa.binary() if c == "ids" else pa.int64() for c in own[1:])]
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([words_of(t) for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    out.extend(packer.add((doc_id, ids), len(ids) // 4))
                if out:
                    yield rows(out)
        if kinds:
            yield rows(packer.finish())

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias(free_name([id_col], "text"))).mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
