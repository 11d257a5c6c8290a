"""A causal self-attention language model in numpy, on ids of a public subword vocabulary.

The ``HEAD - GROUPS`` most frequent subwords are output slots of their own, dealt
to ``GROUPS`` groups of like neighbours; the rest of the vocabulary shares one more
slot in each group, and a subword of these has its share of that slot's count. A
token's probability is that of its group times that of its slot in the group
(times its share). Both come from two sums of scores:

* the direct path from the token before: how often slots follow one another in
  all training text (absolute discounting), as logarithms;
* a causal self-attention layer over the subword ids of the last ``WINDOW`` tokens,
  whose output moves the groups' and the slots' scores.

Windows overlap: each gives the last ``STRIDE`` of its places a score and the
places before them context, so every token is scored once, by batches of
windows in one masked attention. In training, windows follow one another and
every place in them is a target.

Everything learned covers all training rows: word counts and slot pairs (sums made
in the tasks first), and one epoch of training that is data-parallel: rows are dealt by
hash to ``rounds`` rounds and, within one, to shards of about ``SHARD`` tokens; each
shard trains a copy of the weights on its rows, in the order of their hashes, and
the copies are averaged by their tokens. So neither the number of executors nor
the layout of the input changes what is learned. Only averages, counts bounded by the vocabulary (50 thousand
tokens, HEAD squared pairs) and the ``hot_words`` most frequent words (a fixed
bound) reach the driver.

The base score is an add-one word unigram. It takes no part in the model's score.
Words among the hot ones are looked up where the text is; the others join with
the table of counts. Texts are tokenised once; training and scoring read ids.

Defined cases: null text is empty and scores its end token; without training
rows all slots are even; ids may be null or repeat, each row has its own
score; an empty table gives an empty result; other columns are kept, those named
like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import sum_over_partitions
from tessera.llm.common import Stage, id_bucket, one_product_thread, table
from tessera.llm.subwords import byte_pairs

END_WORD = b""
GROUPS, SLOTS, DIM, WINDOW, STRIDE = 32, 32, 8, 16, 8
HEAD, LEAD = GROUPS * SLOTS, WINDOW - STRIDE
#: What stands before a text.
BEGIN = HEAD
DISCOUNT = 0.75
#: Tokens that one copy of the weights is trained on in a round.
SHARD = 1 << 20
_ROOT = np.float32(DIM**0.5)
_PLACES = np.arange(WINDOW)
_MASK = np.where(_PLACES[None, :] <= _PLACES[:, None], 0, -1e9).astype(np.float32)


def end_id(size: int) -> int:
    """The id after the vocabulary's own, which closes a text."""
    return size - 1


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


@dataclass
class Lm:
    slot: np.ndarray  # of each token
    share: np.ndarray  # natural log of its share in its slot
    group_after: np.ndarray  # natural log probability of each group after each slot
    slot_after: np.ndarray  # of each slot in its group, after each slot
    weights: dict[str, np.ndarray]

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        return {"E": (HEAD + 1, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "G": (DIM, GROUPS), "S": (GROUPS, DIM, SLOTS)}

    @staticmethod
    def views(x: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of one array of all weights, by name."""
        out, at = {}, 0
        for k, shape in Lm.shapes().items():
            n = int(np.prod(shape))
            out[k] = x[at : at + n].reshape(shape)
            at += n
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.shapes()])

    def with_weights(self, x: np.ndarray) -> Lm:
        return Lm(self.slot, self.share, self.group_after, self.slot_after, self.views(np.asarray(x, np.float32)))


def first_weights(seed: int = 7) -> dict[str, np.ndarray]:
    """The output starts at zero: the model begins as its direct path."""
    rng = np.random.default_rng(seed)
    return {k: (0 if k in "GS" else 0.1) * rng.standard_normal(shape).astype(np.float32) for k, shape in Lm.shapes().items()}


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of many texts in a row, each with room before it; where scoring windows begin; the targets of each (-1: none)."""
    flat, goal, first, at = [], [], [], 0
    for s in texts:
        n = -(-len(s) // STRIDE)
        spare = n * STRIDE - len(s)
        flat += [np.full(LEAD + 1, BEGIN, np.int16), s[:-1], np.zeros(spare, np.int16)]
        goal += [s, np.full(spare, -1, np.int16)]
        first.append(at + STRIDE * np.arange(n))
        at += LEAD + n * STRIDE
    if not flat:
        return np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros((0, STRIDE), np.int16)
    return np.concatenate(flat), np.concatenate(first), np.concatenate(goal).reshape(-1, STRIDE)


def training_windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows one after another: inputs, and a target for every place (-1: none)."""
    flat, goal = [], []
    for s in texts:
        spare = -len(s) % WINDOW
        flat += [np.full(1, BEGIN, np.int16), s[:-1], np.zeros(spare, np.int16)]
        goal += [s, np.full(spare, -1, np.int16)]
    if not flat:
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, WINDOW), np.int16)
    return np.concatenate(flat).reshape(-1, WINDOW), np.concatenate(goal).reshape(-1, WINDOW)


def _by_group(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of targets by group, and where each group begins in it."""
    g = (goal // SLOTS).astype(np.uint8)
    order = np.argsort(g, kind="stable")
    return order, np.searchsorted(g[order], np.arange(GROUPS + 1))


def log_probs(lm: Lm, flat: np.ndarray, first: np.ndarray, goals: np.ndarray, batch: int = 2048) -> np.ndarray:
    """The targets' natural log probabilities, by slot."""
    w, out = lm.weights, np.zeros(goals.shape, np.float32)
    # a place's vectors depend on its token and its number in the window only
    at = (w["E"][:, None] + w["P"][None]).reshape(-1, DIM)
    ones, after = np.ones(SLOTS, np.float32), lm.slot_after.reshape(-1, SLOTS)
    tq, tk, tv = at @ (w["Q"] / _ROOT), at @ w["K"], at @ w["V"]
    for b in range(0, len(first), batch):
        x = flat[first[b : b + batch, None] + _PLACES].astype(np.int64)
        i = x * WINDOW + _PLACES
        a = tq.take(i[:, LEAD:], 0) @ tk.take(i, 0).transpose(0, 2, 1)
        np.minimum(a, 60, out=a)  # exp stays finite; trained scores are far below
        a += _MASK[LEAD:]
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        h = (a @ tv.take(i, 0)).reshape(-1, DIM)
        before, goal = x[:, LEAD:].ravel(), np.maximum(goals[b : b + batch].ravel(), 0).astype(np.int64)
        row = np.arange(len(goal))
        z = h @ w["G"]
        z += lm.group_after.take(before, 0)
        got = z.ravel().take(row * GROUPS + goal // SLOTS)
        np.exp(z, out=z)
        found = got - np.log(z @ ones)
        order, cut = _by_group(goal)
        hs, z = h.take(order, 0), np.empty((len(goal), SLOTS), np.float32)
        for g in range(GROUPS):
            np.matmul(hs[cut[g] : cut[g + 1]], w["S"][g], out=z[cut[g] : cut[g + 1]])
        of = goal[order]
        z += after.take(before[order] * GROUPS + of // SLOTS, 0)
        got = z.ravel().take(row * SLOTS + of % SLOTS)
        np.exp(z, out=z)
        found[order] += got - np.log(z @ ones)
        out[b : b + batch] = found.reshape(-1, STRIDE)
    return out


def _shares(z: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """In place: the loss's gradient by the scores z, whose right ones stand at ``at``."""
    np.exp(z, out=z)
    z *= (weight / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z.ravel()[np.arange(len(z)) * z.shape[1] + at] -= weight
    return z


def gradient(lm: Lm, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the targets of training windows."""
    w, n, ids = lm.weights, len(x), x.ravel().astype(np.int64)
    at = (w["E"].take(x, 0) + w["P"]).reshape(-1, DIM)
    inward = np.concatenate([w["Q"] / _ROOT, w["K"], w["V"]], 1)
    q, k, v = ((at @ inward)[:, i * DIM : (i + 1) * DIM].reshape(n, WINDOW, DIM) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    np.minimum(a, 60, out=a)
    a += _MASK
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    h = (a @ v).reshape(-1, DIM)
    goal = y.ravel().astype(np.int64)
    weight = (goal >= 0) / np.maximum((goal >= 0).sum(), 1, dtype=at.dtype).astype(at.dtype)
    goal = np.maximum(goal, 0)
    z = h @ w["G"]
    z += lm.group_after.take(ids, 0)
    _shares(z, goal // SLOTS, weight)
    out = {"G": h.T @ z}
    dh = z @ w["G"].T
    order, cut = _by_group(goal)
    hs, of = h.take(order, 0), goal[order]
    t, back, out["S"] = np.empty((len(goal), SLOTS), at.dtype), np.empty_like(h), np.empty_like(w["S"])
    for g in range(GROUPS):
        np.matmul(hs[cut[g] : cut[g + 1]], w["S"][g], out=t[cut[g] : cut[g + 1]])
    t += lm.slot_after.reshape(-1, SLOTS).take(ids[order] * GROUPS + of // SLOTS, 0)
    _shares(t, of % SLOTS, weight[order])
    for g in range(GROUPS):
        part = slice(cut[g], cut[g + 1])
        np.matmul(hs[part].T, t[part], out=out["S"][g])
        np.matmul(t[part], w["S"][g].T, out=back[part])
    dh[order] += back
    do = dh.reshape(n, WINDOW, DIM)
    da = do @ v.transpose(0, 2, 1)
    da -= (da * a).sum(-1, keepdims=True)
    da *= a
    d = np.concatenate([(da @ k).reshape(-1, DIM), (da.transpose(0, 2, 1) @ q).reshape(-1, DIM), (a.transpose(0, 2, 1) @ do).reshape(-1, DIM)], 1)
    into = at.T @ d
    out["Q"], out["K"], out["V"] = into[:, :DIM] / _ROOT, into[:, DIM : 2 * DIM], into[:, 2 * DIM :]
    dx = d @ inward.T
    out["P"] = dx.reshape(n, WINDOW, DIM).sum(0)
    by_id = np.argsort(ids.astype(np.uint16), kind="stable")
    sorted_ids = ids[by_id]
    head = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    out["E"] = np.zeros_like(w["E"])
    out["E"][sorted_ids[head]] = np.add.reduceat(dx.take(by_id, 0), head, axis=0)
    return out


class Adam:
    """Training of one copy of the weights."""

    def __init__(self, lm: Lm, rate: float) -> None:
        self.x = lm.flat()
        self.lm, self.rate, self.steps = lm.with_weights(self.x), rate, 0
        self.m, self.s = np.zeros_like(self.x), np.zeros_like(self.x)

    def learn(self, x: np.ndarray, y: np.ndarray, batch: int = 384) -> None:
        order = np.random.default_rng(len(x)).permutation(len(x))
        for b in range(0, len(x), batch):
            pick = order[b : b + batch]
            found = gradient(self.lm, x[pick], y[pick])
            g = np.concatenate([found[k].ravel() for k in Lm.shapes()])
            self.steps += 1
            self.m += 0.1 * (g - self.m)
            g *= g
            self.s += 0.01 * (g - self.s)
            g = np.sqrt(self.s)
            g += 1e-7
            np.divide(self.m, g, out=g)
            g *= self.rate * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps)
            self.x -= g  # the model's weights are views of it


def grouped(pairs: np.ndarray) -> np.ndarray:
    """New numbers of the slots: those of frequent tokens are halved again and again along their main direction, until GROUPS groups are left.

    pairs: how often slots (rows, BEGIN last) are followed by slots. The last slot of a group stays the rest's."""
    n = HEAD - GROUPS
    f = np.sqrt(np.concatenate([pairs[:n], pairs[:HEAD, :n].T], 1))
    f /= np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)
    parts = [np.arange(n)]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            z = f[part] - f[part].mean(0)
            along = np.argsort(np.linalg.eigh(z @ z.T)[1][:, -1], kind="stable")
            halves += [part[along[: len(part) // 2]], part[along[len(part) // 2 :]]]
        parts = halves
    number = np.zeros(HEAD, np.int64)
    for g, part in enumerate(parts):
        number[np.sort(part)] = g * SLOTS + np.arange(len(part))
        number[n + g] = g * SLOTS + SLOTS - 1
    return number


def direct_path(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of groups, and of slots in their group, after each slot."""
    one = pairs.sum(0) + 0.5
    one /= one.sum()
    total, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
    after = np.where(total > 0, (np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds * one) / np.maximum(total, 1), one).reshape(HEAD + 1, GROUPS, SLOTS)
    group = after.sum(-1)
    return np.log(group).astype(np.float32), np.log(after / group[..., None]).astype(np.float32)


def _texts(batches, slot: np.ndarray, most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Texts as slots, many at a time."""
    held, n = [], 0
    for batch in batches:
        for raw in batch.column(batch.num_columns - 1).to_pylist():
            held.append(slot[np.frombuffer(raw, np.uint16)])
            n += len(held[-1])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _by_shard(batches) -> Iterator[Iterator[pa.RecordBatch]]:
    """For each shard of a sorted partition its batches, which must be used up before the next."""

    def pieces():
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in pairwise(cuts):
                if hi > lo:
                    yield int(shards[lo]), batch.slice(lo, hi - lo)

    for _, group in groupby(pieces(), key=lambda p: p[0]):
        yield (batch for _, batch in group)


def word_counts(docs: DataFrame, text_col: str, stage: Stage, flush: int = 200_000) -> DataFrame:
    """(word, c) over all rows; the end of a text counts as the word of no bytes."""

    def count(batches):
        held: Counter = Counter()
        kind = pa.schema([("word", pa.binary()), ("c", pa.int64())])

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=kind)
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                held[END_WORD] += 1
                if len(held) >= flush:
                    yield out()
        if held:
            yield out()

    return stage.keep(docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))


def _summed(ids: DataFrame, keys, size: int) -> np.ndarray:
    """How often each of ``size`` keys occurs. keys: texts' ids -> array of keys."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = keys(np.frombuffer(raw, np.uint16))
                if len(found) > size // 8:
                    total += np.bincount(found, minlength=size)
                else:
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["key", "n"])

    out = np.zeros(size)
    sums = ids.select("ids").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    for r in sums.toArrow().to_batches():  # at most size rows
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def train(ids: DataFrame, size: int, rounds: int = 2, learning_rate: float = 0.01, shard_tokens: int = SHARD) -> Lm:
    """One epoch over all rows of ids (key, ids): texts as ids of a vocabulary of ``size``, 16 bits each, known by a hash."""
    seen = _summed(ids, lambda t: t, size)
    order = np.argsort(-seen, kind="stable")
    slot = np.zeros(size, np.int64)
    n = HEAD - GROUPS
    slot[order[:n]] = np.arange(min(n, size))
    rest = order[n:]
    slot[rest] = n + np.arange(len(rest)) % GROUPS
    pairs = _summed(ids, lambda t: np.append(BEGIN, slot[t[:-1]]) * HEAD + slot[t], (HEAD + 1) * HEAD).reshape(HEAD + 1, HEAD)
    number = grouped(pairs)
    moved = np.zeros_like(pairs)
    moved[np.ix_(np.append(number, BEGIN), number)] = pairs
    slot = number[slot]
    share = np.log((seen + 1) / np.bincount(slot, seen + 1, HEAD)[slot])
    lm = Lm(slot.astype(np.int16), share, *direct_path(moved), first_weights())
    shards = max(1, round(float(seen.sum()) / rounds / shard_tokens))
    shard = F.pmod(F.floor(F.col("key") / rounds).cast("long"), F.lit(shards))
    for r in range(rounds):

        def local(batches, lm=lm, r=r):
            one_product_thread()
            total = None
            for rows in _by_shard(batches):
                copy, n = Adam(lm, learning_rate / (1 + r)), 0
                for texts in _texts(rows, lm.slot):
                    copy.learn(*training_windows(texts))
                    n += sum(map(len, texts))
                weighed = np.append(copy.x.astype(np.float64) * n, n)
                total = weighed if total is None else total + weighed
            return total

        rows = ids.where(F.pmod("key", F.lit(rounds)) == r).select(shard.alias("shard"), "key", "ids")
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "ids")
        total = sum_over_partitions(dealt, local, len(lm.flat()) + 1)
        if total[-1]:
            lm = lm.with_weights(total[:-1] / total[-1])
    return lm


def score(docs: DataFrame, learn: Column | None = None, text_col: str = "text", path: str | None = None, hot_words: int = 200_000, rounds: int = 2, learning_rate: float = 0.01) -> DataFrame:
    """Every row of docs (its columns but the text) with n_tokens, n_known, train_tokens, base_score and score.

    learn: which rows to learn from; all, if not given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    counts = word_counts(docs.where(learn), text_col, stage)
    all_tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    # the least count that at most hot_words words reach
    least, held = 1 << 62, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if held + r["count"] > hot_words:
            break
        least, held = r["c"], held + r["count"]
    hot = spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).toLocalIterator()})
    own = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    names = {f"o{i}": c for i, c in enumerate(own)}
    extra = "learn boolean, uid bigint, n_tokens bigint, known bigint, base double, rare array<binary>, ids binary"
    kept = docs.select(*[F.col(c).alias(o) for o, c in names.items()], learn.alias("learn"), F.col(text_col).cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(own)]) + (", " if own else "") + extra
    size = byte_pairs(path).size
    end = np.array([end_id(size)], "<u2").tobytes()

    def tokenise(batches):
        sub, known = byte_pairs(path), hot.value
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                texts = [words_of(t) for t in part.column(part.num_columns - 1).to_pylist()]
                n, ids = len(texts), [t + end for t in sub(texts)]
                flat = [w for words in texts for w in (*words, END_WORD)]
                seen = np.fromiter(map(known.get, flat, repeat(0)), np.int64, len(flat))
                owner = np.repeat(np.arange(n), [len(w) + 1 for w in texts])
                few = np.flatnonzero(seen == 0)
                few_of = np.searchsorted(owner[few], np.arange(n + 1))
                hits = np.bincount(owner, seen > 0, n).astype(np.int64)
                base = np.bincount(owner, np.where(seen > 0, np.log10(seen + 1), 0), n)
                rare = pa.ListArray.from_arrays(pa.array(few_of, pa.int32()), pa.array([flat[i] for i in few], pa.binary()))
                cols = [pa.array(range(uid, uid + n), pa.int64()), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(hits), pa.array(base), rare, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *cols], names=[*names, "learn", "uid", "n_tokens", "known", "base", "rare", "ids"])
                uid += n

    done = stage.keep(kept.mapInArrow(tokenise, schema))
    # copies of a text differ by the other columns, so that a large group of them is dealt out too
    known_by = [o for o in names if not any(k in done.schema[o].dataType.simpleString() for k in ("map<", "variant"))]
    model = spark.sparkContext.broadcast(train(done.where("learn").select(F.xxhash64(*known_by, "ids").alias("key"), "ids"), size, rounds, learning_rate))

    def run(batches):
        one_product_thread()
        lm = model.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                ids = [np.frombuffer(raw, np.uint16) for raw in part.column(part.num_columns - 1).to_pylist()]
                flat, first, goals = joined([lm.slot[t] for t in ids])
                lp = log_probs(lm, flat, first, goals)[goals >= 0] + lm.share[np.concatenate(ids)]
                total = np.bincount(np.repeat(np.arange(len(ids)), [len(t) for t in ids]), lp, len(ids)) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(total)], names=[*part.schema.names[:-1], "model"])

    plain = [*names, "uid", "n_tokens", "known", "base"]
    scored = done.select(*plain, "ids").mapInArrow(run, schema[: schema.index("learn boolean")] + "uid bigint, n_tokens bigint, known bigint, base double, model double")
    few = done.select("uid", F.explode("rare").alias("word"))
    found = few.join(counts, "word").groupBy("uid").agg(F.count("c").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("rare_base"))
    whole_count = float(all_tokens + distinct + 1)
    return scored.join(found, "uid", "left").select(
        *[F.col(o).alias(c) for o, c in names.items()],
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(all_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(whole_count)))).alias("base_score"),
        F.col("model").alias("score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), 7) == 2)
    return score(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
