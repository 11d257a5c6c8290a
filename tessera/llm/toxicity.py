"""Toxicity: a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Two words are alike by the subsequences of ``ORDER`` characters they share,
each weighted by ``DECAY`` for every character it spans (then raised to
``POWER``), so gaps and inserted
characters cost a little and do not hide a word. Landmarks are words, and stems
of words, that tell the labelled texts apart best; a word's kernel values against them,
whitened by the landmarks' own kernel matrix, are its Nystroem features. A text
is the bag of its words and takes, for each landmark, the best value of any of
its words (a match kernel), so one insult in a long text counts as in a short
one, and the logarithm of the values' sum. A linear machine (squared hinge) is trained on that, and a logistic curve
on its margins gives the score.

Training: landmarks are chosen and the machine is fitted on at most about
``fit_rows`` labelled rows a label (a hash picks them, whole texts), the
documented bound of what reaches the driver. An insult too rare to occur in that
sample a few times gets no landmark of its own. Scoring is one pass over whole
texts without a shuffle; each distinct word is compared with the landmarks once
a worker.

Words are runs between white space and symbols with A-Z folded; single
characters in a row ("i d i o t") are also joined to one word; a run cut by
symbols inside ("id*iot") is one word without them.

Defined cases: null or wordless text has features 0; no labelled row, or one
label alone, gives score 0 to all; ids may be null or repeat; labels that
repeat an id count once, as 1 if any is; added columns replace columns of the
same name.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WordIds, free_name, id_bucket, table, worker_slot

ORDER, DECAY = 3, 0.7
#: A power of a kernel is a kernel; this one sets whole words apart from what chance shares with them.
POWER = 3
#: Stands before a word, so that a stem can be held to its beginning.
START = "^"
#: Longest stretch of a word that is compared; longer words go in overlapping stretches.
STRETCH = 20
_SYMBOLS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or b in b" \t\n\r\x0b\x0c" else 0 for b in range(256))
_DROP = bytes(b for b in range(128) if _SYMBOLS[b] == 0)
_SINGLES = re.compile(rb"(?:(?<=\s)|^)[a-z](?:\s+[a-z]){2,}(?=\s|$)")


def words_of(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    plain = text.lower().translate(None, _DROP)
    words = plain.split()
    words += [b"".join(m.split()) for m in _SINGLES.findall(plain)]
    return words


def _codes(words: list[str], width: int) -> np.ndarray:
    flat = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def kernel(words: list[str], landmark: str) -> np.ndarray:
    """Subsequence kernel of each word (of at most STRETCH characters, by falling length) with a landmark."""
    n = len(words)
    if not n:
        return np.zeros(0)
    size = np.array([len(w) for w in words])
    width = int(size.max(initial=1))
    codes = _codes(words, width)
    m = len(landmark)
    # prime[j]: weighted subsequences of the current order, up to the current place of the word and place j of the landmark
    match = [codes == ord(c) for c in landmark]
    prime = np.ones((width + 1, m + 1, n), np.float32)
    total = np.zeros(n, np.float32)
    for order in range(1, ORDER + 1):
        after = np.zeros((width + 1, m + 1, n), np.float32)
        for i in range(1, width + 1):
            live = int(np.searchsorted(-size, -i, side="right"))
            if not live:
                break
            run = np.zeros(live, np.float32)
            for j in range(1, m + 1):
                hit = match[j - 1][:live, i - 1]
                gain = np.where(hit, prime[i - 1, j - 1, :live], 0)
                if order == ORDER:
                    total[:live] += DECAY * DECAY * gain
                else:
                    run = DECAY * run + DECAY * DECAY * gain
                    after[i, j, :live] = DECAY * after[i - 1, j, :live] + run
            if order < ORDER and live < n:
                after[i, :, live:] = after[i - 1, :, live:]
        prime = after
    return total


def own_kernel(words: list[str]) -> np.ndarray:
    return np.array([kernel([w], w)[0] for w in words])


def pieces(word: str) -> list[str]:
    if len(word) <= STRETCH:
        return [word]
    half = STRETCH // 2
    return [word[k : k + STRETCH] for k in range(0, len(word) - half, half)]


def similarities(words: list[str], landmarks: list[str], self_kernel: np.ndarray) -> np.ndarray:
    """Share of the landmark's subsequences that a word holds (at most 1), for each word and landmark."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for p in pieces(START + w):
            if len(p) >= ORDER:
                parts.append(p)
                owner.append(i)
    out = np.zeros((len(words), len(landmarks)))
    order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
    parts, owner = [parts[k] for k in order], np.array([owner[k] for k in order], int)
    for s in range(0, len(parts), 4096):
        part, own = parts[s : s + 4096], owner[s : s + 4096]
        for j, landmark in enumerate(landmarks):
            np.maximum.at(out[:, j], own, kernel(part, landmark) / self_kernel[j])
    return np.minimum(out, 1.0) ** POWER


@dataclass
class Model:
    landmarks: list[str]
    self_kernel: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def map(self, found: np.ndarray) -> np.ndarray:
        """Nystroem features of the best and of the summed kernel values."""
        m = len(self.landmarks)
        return np.concatenate([found[:, :m] @ self.whiten, found[:, m:] @ self.whiten], 1)

    def probability(self, found: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(found))
        margin = self.map(found) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


EMPTY = Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, 0.0)


class Scorer:
    """Best and summed similarity of a text's words with each landmark; each distinct word once, until the cache starts anew."""

    def __init__(self, model: Model, cache_words: int = 250_000) -> None:
        self.model, self.limit = model, cache_words
        self.clear()

    def clear(self) -> None:
        self.ids, self.known = WordIds(), 0
        self.rows = np.zeros((1 << 12, len(self.model.landmarks)), np.float32)

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        if len(self.ids.words) > self.limit:
            self.clear()
        docs = [np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        new = self.ids.words[self.known :]
        while len(self.rows) < len(self.ids.words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.known : len(self.ids.words)] = similarities([w.decode("utf-8", "replace") for w in new], self.model.landmarks, self.model.self_kernel)
        self.known = len(self.ids.words)
        m = len(self.model.landmarks)
        out = np.zeros((len(texts), 2 * m))
        for i, ids in enumerate(docs):
            if len(ids):
                found = self.rows[ids]
                out[i, :m] = found.max(0)
                out[i, m:] = np.log1p(found.sum(0))
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps over the rows inside the margin; classes weigh the same."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    t = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = t * (z @ w) < 1
        zi = z[inside] * share[inside, None]
        new = np.linalg.solve(zi.T @ z[inside] + ridge, zi.T @ t[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic curve on margins, with the smoothed targets of Platt's method; Newton steps that never go uphill."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([margin, np.ones_like(margin)], 1)
    ridge = np.array([1e-3, 1e-6])

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float((np.logaddexp(0, m) - t * m).sum() + 0.5 * (ridge * v * v).sum())

    v = np.array([1.0, 0.0])
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - t) + ridge * v)
        size = 1.0
        while size > 1e-10 and loss(v - size * step) > now:
            size /= 2
        v = v - size * step
        before, now = now, loss(v)
        if before - now < 1e-9:
            break
    return float(v[0]), float(v[1])


def stems(word: str) -> set[str]:
    """The word and its beginnings of 4 to 9 characters, the mark of its start counted: what a family of words may share."""
    word = START + word
    return {word[:STRETCH], *(word[:n] for n in range(4, min(9, len(word)) + 1))}


def choose_landmarks(texts: list[tuple[bytes, int]], how_many: int, least_gain: float = 25.0, alike: float = 0.6) -> list[str]:
    """Stems that tell toxic texts (label 1) from clean ones best.

    Left out: stems like a chosen one, and such as share characters with one and
    stand almost only in texts that hold it. least_gain is the likelihood-ratio
    statistic that a stem must reach; chance finds none at 25 among 100,000."""

    def held_by(text: bytes) -> set[str]:
        return set().union(*(stems(w.decode("utf-8", "replace")) for w in set(words_of(text))))

    toxic = Counter(s for text, label in texts if label for s in held_by(text))
    toxic = {s: n for s, n in toxic.items() if n >= 3 and len(s) > ORDER}
    clean = Counter(s for text, label in texts if not label for s in held_by(text) if s in toxic)
    n_t = sum(label for _, label in texts)
    n_c = len(texts) - n_t

    def gain(s: str) -> float:
        t, c = toxic[s], clean[s]
        share = (t + c) / (n_t + n_c)
        if t / n_t <= share:
            return 0.0
        terms = ((t, n_t * share), (n_t - t, n_t * (1 - share)), (c, n_c * share), (n_c - c, n_c * (1 - share)))
        return 2 * sum(o * np.log(o / e) for o, e in terms if o > 0 and e > 0)

    # of stems in the same texts the longest says most
    gains = {s: gain(s) for s in toxic}
    pool = sorted((s for s in toxic if gains[s] >= least_gain), key=lambda s: (-round(gains[s], 6), -len(s), s))[: 60 * how_many]
    where: dict[str, set[int]] = {s: set() for s in pool}
    for i, (text, label) in enumerate(texts):
        if label:
            for s in held_by(text) & where.keys():
                where[s].add(i)
    own = dict(zip(pool, own_kernel(pool), strict=True))
    grams = lambda s: {p[i : i + 3] for p in [s.lstrip(START)] for i in range(len(p) - 2)}
    out: list[str] = []
    for s in pool:
        if len(out) >= how_many:
            break
        family = any(len(where[s] & where[o]) >= 0.9 * len(where[s]) and grams(s) & grams(o) for o in out)
        if not family and not any(kernel([s], o)[0] / min(own[s], own[o]) >= alike for o in out):
            out.append(s)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", landmarks: int = 32, fit_rows: int = 1500) -> Model:
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    totals = {int(r["y"]): r["n"] for r in label.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return EMPTY
    chance = F.when(F.col("y") == 1, min(1.0, fit_rows / totals[1])).otherwise(min(1.0, 2 * fit_rows / totals[0]))
    # the picked labels are bounded, so the texts need not shuffle to meet them
    few = label.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < chance * (1 << 20))
    picked = rows.join(F.broadcast(few), "id")
    # copies of a text would count its words as often
    sample = list({bytes(r["text"]): int(r["y"]) for r in picked.toLocalIterator()}.items())
    y = np.array([t for _, t in sample])
    if not (y > 0).any() or not (y <= 0).any():
        return EMPTY
    marks = choose_landmarks(sample, landmarks)
    if not marks:
        return EMPTY
    own = own_kernel(marks)
    gram = np.stack([kernel(sorted(marks, key=lambda w: -len(w)), m) for m in marks], 1)[np.argsort(sorted(range(len(marks)), key=lambda k: -len(marks[k])))]
    gram = (gram / np.sqrt(np.outer(own, own))) ** POWER
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    model = Model(marks, own, whiten, np.zeros(2 * len(marks)), 0.0, 1.0, 0.0)
    x = model.map(Scorer(model).features([t for t, _ in sample]))
    # margins for the curve come from machines that have not seen their rows
    fold = np.zeros(len(y), int)  # each label's rows fall into all folds alike
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % 3
    margin = np.zeros(len(y))
    for f in range(3):
        w, b = fit_svm(x[fold != f], y[fold != f])
        margin[fold == f] = x[fold == f] @ w + b
    model.weights, model.bias = fit_svm(x, y)
    model.slope, model.shift = fit_curve(margin, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1)."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    raw = free_name(own, "_tess_text")
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scorer = worker_slot(model.key, lambda: Scorer(model))
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                p = model.probability(scorer.features(batch.column(raw).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*own, "score", "predicted"])

    return docs.select(*own, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("held_out", id_bucket(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 4) != 2)
    model = train(docs.where(~F.col("held_out")), labels)
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
