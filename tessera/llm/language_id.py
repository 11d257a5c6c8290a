"""Language ID: unigram pieces with the segmentation summed out.

A word's probability in a language is the sum, over every way to cut it into
pieces of a fixed public vocabulary, of the product of that language's piece
probabilities; a forward pass gives the sum. Piece probabilities are fitted by
expectation maximisation (forward-backward) on word counts.

Training reads a sample bounded by ``per_lang`` documents a language on average
(a hash of the id picks them, whole texts are used), which is the documented
bound of what reaches the driver. Prediction covers every whole text, one pass,
no shuffle; a worker scores each distinct word once and keeps at most
``cache_words`` of them.

Words are runs of letters, digits and non-ASCII characters, lower-cased; words
without a letter do not count. Words longer than 23 characters are scored in
stretches of 23 (cuts across a stretch's end are not summed). All pieces of the
vocabulary take part, whatever their length.

Defined cases: null text, or text without a letter: ``und`` with score 0; no
labelled row at all: ``und`` for every text; equal scores: the alphabetically
first language; null languages teach nothing; rows are never merged, so ids may
be null or repeat; added columns replace input columns of the same name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD_BYTES, WordIds, free_name, id_bucket, table, worker_slot

UND = "und"
STRETCH = 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the public sentencepiece model, a leading mark for the start of a word."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattice:
    """Looks up every substring of many words among the pieces at once."""

    def __init__(self, pieces: list[str]) -> None:
        pieces = sorted({p for p in pieces if 0 < len(p) <= STRETCH + 1})  # no stretch holds a longer one
        self.max_len = max(map(len, pieces), default=1)
        self.unknown, self.n = len(pieces), len(pieces) + 1
        self.hashes = np.zeros(len(pieces) + 1, np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for ch in p:
                h = (h * 1000003 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[i] = h
        self.tables, left = [], np.arange(len(pieces))
        while len(left):  # a piece whose place is taken goes to the next, smaller table
            bits = max(8, (16 * len(left)).bit_length())
            slot = ((self.hashes[left] * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
            t = np.full(1 << bits, len(pieces), np.int32)
            t[slot[::-1]] = left[::-1]
            self.tables.append((np.uint64(64 - bits), t))
            rest = left[t[slot] != left]
            if len(rest) == len(left):
                break
            left = rest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where none."""
        out = np.full(h.shape, -1, np.int32)
        for shift, t in self.tables:
            got = t[((h * _MIX) >> shift).astype(np.int64)]
            np.copyto(out, got, where=(self.hashes[got] == h) & (got < self.unknown))
        return out

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the stretches by falling length, their lengths, and the word of each."""
        parts, owner = [], []
        for i, w in enumerate(words):
            w = "▁" + w
            for k in range(0, len(w), STRETCH + 1):
                parts.append(w[k : k + STRETCH + 1])
                owner.append(i)
        size = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-size, kind="stable")
        width = int(size.max(initial=1))
        flat = np.frombuffer("".join(parts[i].ljust(width, "\0") for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        return flat.reshape(len(parts), width).astype(np.uint64), size[order], np.array(owner, np.int64)[order]

    def steps(self, codes: np.ndarray, size: np.ndarray):
        """(start, length, number of stretches long enough, their piece numbers) for each place."""
        width = codes.shape[1]
        for start in range(width):
            h = np.zeros(len(codes), np.uint64)
            for length in range(1, min(self.max_len, width - start) + 1):
                n = int(np.searchsorted(-size, -(start + length), side="right"))
                if not n:
                    break
                h = h[:n] * np.uint64(1000003) + codes[:n, start + length - 1] + np.uint64(1)
                ids = self.find(h)
                if length == 1:
                    ids = np.where(ids < 0, self.unknown, ids)
                yield start, length, n, ids


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # pieces and the unknown piece, then a row of zeros for "no piece"; a column a language
    prior: np.ndarray
    lattice: Lattice
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        codes, size, owner = self.lattice.cut(words)
        alpha = np.zeros((codes.shape[1] + 1, len(codes), len(self.langs)))
        alpha[0] = 1
        for start, length, n, ids in self.lattice.steps(codes, size):
            alpha[start + length, :n] += alpha[start, :n] * self.probs[ids]
        last = np.log(np.maximum(alpha[size, np.arange(len(codes))], 1e-300))
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, owner, last)
        return out


def fit(counts: dict[str, dict[str, float]], pieces: list[str], prior: dict[str, float] | None = None, rounds: int = 4) -> Model:
    """Piece probabilities by expectation maximisation. counts: language -> word -> count."""
    langs = sorted(counts)
    lattice = Lattice(pieces)
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[g].get(w, 0.0) for g in langs] for w in words]).reshape(len(words), len(langs))
    probs = np.full((lattice.n + 1, len(langs)), 1.0 / lattice.n)
    probs[-1] = 0
    if words and langs:
        codes, size, owner = lattice.cut(words)
        steps = list(lattice.steps(codes, size))
        rows = np.arange(len(codes))
        for _ in range(rounds):
            alpha = np.zeros((codes.shape[1] + 1, len(codes), len(langs)))
            alpha[0] = 1
            for start, length, n, ids in steps:
                alpha[start + length, :n] += alpha[start, :n] * probs[ids]
            total = np.maximum(alpha[size, rows], 1e-300)
            beta = np.zeros_like(alpha)
            beta[size, rows] = weight[owner] / total
            found = np.zeros((lattice.n + 1, len(langs)))
            for start, length, n, ids in reversed(steps):
                back = probs[ids] * beta[start + length, :n]
                for g in range(len(langs)):
                    found[:, g] += np.bincount(ids % (lattice.n + 1), alpha[start, :n, g] * back[:, g], lattice.n + 1)
                beta[start, :n] += back
            found[-1] = 0
            probs = (found + 0.01) / (found.sum(0) + 0.01 * lattice.n)
            probs[-1] = 0
    share = np.array([(prior or {}).get(g, 1.0) for g in langs], float)
    return Model(langs, probs, np.log(share / share.sum()) if len(langs) else share, lattice)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, pieces: list[str] | None = None) -> Model:
    """Fits on about per_lang whole documents of each language (all, where there are fewer)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    seen = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for g, n in seen.items() for x in (g, min(1.0, per_lang / n))]) if seen else None
    counts: dict[str, dict[str, float]] = {g: {} for g in seen}
    if seen:
        picked = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

        def count(batches):
            for batch in batches:
                got: dict[tuple[str, bytes], int] = {}
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for w in words_of(text):
                        got[lang, w] = got.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in got], "word": [k[1].decode("utf-8", "replace") for k in got], "n": list(got.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

        for r in picked.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
            w = r["word"].lower()
            if any(c.isalpha() for c in w):
                counts[r["lang"]][w] = counts[r["lang"]].get(w, 0) + r["n"]
    return fit(counts, pieces or vocabulary(), {g: float(n) for g, n in seen.items()})


class Scorer:
    """Scores whole texts; each distinct word once, until the cache is full and starts anew."""

    def __init__(self, model: Model, cache_words: int) -> None:
        self.model, self.limit = model, cache_words
        self.clear()

    def clear(self) -> None:
        self.ids = WordIds()
        self.rows = np.zeros((1 << 12, len(self.model.langs)), np.float64)
        self.alpha = np.zeros(1 << 12, bool)
        self.known = 0

    def learn(self) -> None:
        new = self.ids.words[self.known :]
        while len(self.rows) < len(self.ids.words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.alpha = np.concatenate([self.alpha, np.zeros_like(self.alpha)])
        text = [w.decode("utf-8", "replace").lower() for w in new]
        letters = np.array([any(map(str.isalpha, w)) for w in text], bool)
        at = self.known + np.flatnonzero(letters)
        for k in range(0, len(at), 1 << 14):
            part = at[k : k + (1 << 14)]
            self.rows[part] = self.model.log_probs([text[i - self.known] for i in part])
        self.alpha[at] = True
        self.known = len(self.ids.words)

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for k in range(0, len(texts), 512):
            if len(self.ids.words) > self.limit:
                self.clear()
            docs = [np.fromiter(map(self.ids.__getitem__, words_of(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts[k : k + 512]]
            self.learn()
            for ids in docs:
                if not self.model.langs or not self.alpha[ids].any():
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                v = self.rows[ids].sum(0) + self.model.prior
                best = int(v.argmax())
                langs.append(self.model.langs[best])
                scores.append(float(1 / np.exp(v - v[best]).sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", cache_words: int = 120_000) -> DataFrame:
    """docs with lang_pred and score added."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    raw = free_name(own, "_tess_text")
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = worker_slot(model.key, lambda: Scorer(model, cache_words))
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                langs, scores = scorer(batch.column(batch.num_columns - 1).to_pylist())
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    return docs.select(*own, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_bucket(F.col("doc_id"), 5) == 0)
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")), model).select("doc_id", "held_out", "lang_pred", "score")
