"""MinHash near-dedup: a similarity join by chosen paths.

Every distinct shingle set gets ``HASHES`` minwise values. In each of
``trees`` independent trees a set walks down from the root: a node picks, from
a hash of its own path, one or two of the minwise positions, and the set goes
on to the child that its values there name. Similar sets share a path to a leaf
with a chance that the number of trees raises to the target recall (over 0.999
for a pair at similarity 0.85, ``recall`` gives the figure). Walking needs only
a set's own values, so all leaves of a set come out of one pass over the text.

Leaves that one set alone reaches are dropped by a bit filter (where the sets are
few enough for one); only numbers shuffle to find the others. A leaf is then
compared exhaustively by the minwise estimates (MARGIN standard deviations under
the threshold), and what they propose is confirmed on full shingle sets. Only
links between different components are looked for, so the work goes from cheap
to thorough:

1. in the leaves of the first ``early`` trees: in a small leaf, every set's best
   partner and the hub's; in a large one (more than SMALL sets, or very long
   ones) each set against four pivots;
2. in every leaf that still holds several components, the same; a large one is cut
   into blocks first: what is outside its main component meets every other
   member, every two blocks being a tile, compared exhaustively like a small leaf;
3. leaves and tiles that had more candidates than they gave: all of them, where
   they are at most four a member;
4. otherwise (many pairs close to the threshold) the intersections of all full
   sets of the tile, by matrix products; a tile gives a forest of its links.

Two sets often share many leaves; the first of them alone takes their pair
(leaves compare by 32 bits for that). Pivots only spare work: every pair of a leaf that they leave in different
components is compared in 2 to 4. Nothing is capped. A link of exactly the
threshold is missed where no tree brings it together (``recall``; 1.4 in 100,000
at 0.85, 4.4 in 10,000 at 0.8) or its estimate falls MARGIN deviations short.

Copies (equal shingle sets) are grouped first and walk once. No step lists all
pairs within a group, and no leaf, group or component meets in one task: tiles
have a bounded size and pivots join by leaf and slot.

Texts: A-Z folded, words ``[^\\x20\\x09-\\x0D]+``, distinct shingles of
``shingle`` words; with fewer words, the whole sequence. A shingle is known by
a 64-bit hash. Defined cases: null or wordless text has no shingles, is linked
with nothing and is its own component; equal sets are linked; component ids are
the smallest id that links reach; each row stands for its own text, so rows that
repeat an id each get a row and may lie in different components; rows with a null
id are linked by their texts too and kept only where no row of their component
has an id (component null); ids of any ordered type work; an empty table gives an
empty result; other columns of docs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bloom
from tessera.llm.common import Stage, one_product_thread, table, worker_slot
from tessera.llm.components import components

HASHES = 256
#: How many positions a node picks, level by level.
FANS = (1, 1, 2, 1, 1, 2)
TREES = 12
#: Leaves up to this size are one tile; larger ones are cut into blocks. A set counts as this many shingles on average.
SMALL, BLOCK, MEAN_SHINGLES = 128, 384, 8192
#: Standard deviations that an estimate may fall short of the threshold.
MARGIN = 4
_U = np.uint64
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def recall(similarity: float, trees: int = TREES) -> float:
    """The chance that two sets of this similarity meet in a leaf."""
    meet = 1.0
    for fan in reversed(FANS):
        meet = 1 - (1 - similarity * meet) ** fan
    return 1 - (1 - meet) ** trees


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > 200_000:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k if k < shingle else 0, np.uint64)
    for i in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minwise(s: np.ndarray) -> np.ndarray:
    """HASHES minwise values of a set, 32 bits each."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    h = (s >> _U(32)).astype(np.uint32)
    for k in range(0, len(h), 2048):
        part = h[k : k + 2048]
        x = np.multiply.outer(_MUL, part) + _ADD[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(1), out=low)
    return low


def paths(values: np.ndarray, trees: int) -> np.ndarray:
    """Leaf numbers of many sets: (sets, leaves), tree after tree. A column is one way through a tree, so two sets share a leaf in one column."""
    n = len(values)
    node = np.broadcast_to(_mix(np.arange(1, trees + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)), (n, trees))
    rows = np.arange(n)[:, None]
    for fan in FANS:
        children = []
        pick = _mix(node + _U(0x632BE59BD9B4E019))
        for f in range(fan):
            i = ((pick >> _U(8 * f)) % _U(HASHES)).astype(np.int64)
            children.append(_mix(node * _U(0xD6E8FEB86659FD93) + (i.astype(np.uint64) << _U(33)) + values[rows, i].astype(np.uint64) + _U(f + 1)))
        node = np.concatenate(children, axis=1)
    return node.reshape(n, -1, trees).transpose(0, 2, 1).reshape(n, -1)


FEATURES = T.StructType([T.StructField("uid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("ways", T.BinaryType()), T.StructField("leaves", T.ArrayType(T.LongType()))])


def _features(shingle: int, trees: int):
    def run(batches):
        hashes, uid = worker_slot("near_dedup", WordHashes), TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sizes, prints, values = [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    s = shingle_set(text, shingle, hashes)
                    sizes.append(len(s))
                    prints.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                    values.append(minwise(s))
                v = np.array(values, np.uint32).reshape(len(sizes), HASHES)
                found = paths(v, trees)
                leaves = [x.tolist() if n else [] for x, n in zip(found.view(np.int64), sizes, strict=True)]
                ways = [x.tobytes() for x in found.astype(np.uint32)]
                low = (v & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(range(uid, uid + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(ways, pa.binary()), pa.array(leaves, pa.list_(pa.int64()))], names=[*part.schema.names[:-1], *(f.name for f in FEATURES)])
                uid += len(sizes)

    return run


def _sets(shingle: int):
    def run(batches):
        hashes = worker_slot("near_dedup", WordHashes)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                sets = [shingle_set(t, shingle, hashes).tobytes() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["print", "set"])

    return run


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values agree, of every row of x with every row of y."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    total = np.zeros((x.shape[1], y.shape[1]), np.int16)
    for k in range(0, HASHES, 128):
        part = np.zeros(total.shape, np.uint8)
        for i in range(k, k + 128):
            part += (x[i][:, None] == y[i][None, :]).view(np.uint8)
        total += part
    return total


#: A candidate pair, or (tile set) a tile that holds more of them than were given.
PAIR = "a bigint, b bigint, tile bigint"


def _pair_batch(a, b, tiles=()) -> pa.RecordBatch:
    none, n = [None] * len(tiles), len(a)
    cols = [
        pa.concat_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(none, pa.int64())]),
        pa.concat_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(none, pa.int64())]),
        pa.concat_arrays([pa.array([None] * n, pa.int64()), pa.array(tiles, pa.int64())]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "tile"])


def _whole_tiles(batches):
    """Batches of rows sorted by tile (column 0) -> tables of whole tiles, and where each tile begins and ends in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield _bounds([*held, batch.slice(0, cut)])
            held = []
        elif held and held[0].column(0)[0].as_py() != tile[0]:
            yield _bounds(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _bounds(held)


def _bounds(parts):
    whole = pa.Table.from_batches(parts).combine_chunks()
    tile = whole.column(0).to_numpy()
    head = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    return whole, tile, list(zip(head.tolist(), np.append(head[1:], len(tile)).tolist(), strict=True))


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two sides of a tile, and whether it is one block against itself."""
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (one, two, False) if len(two) else (one, one, True)


def _tiles(least: int, best_only: bool):
    """Rows (tile, side, id, sig, comp, ways, col) sorted by tile -> candidate pairs between components.

    A pair counts in the first column that both sets share alone, so that no other leaf gives it again.
    best_only: each set's best partner and the hub's; else all of a tile that has
    few, and the tile's number where it has many."""

    def run(batches):
        for whole, tile, bounds in _whole_tiles(batches):
            side, ids, comps = (whole.column(i).to_numpy() for i in (1, 2, 4))
            sigs = np.frombuffer(b"".join(whole.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            ways = np.frombuffer(b"".join(whole.column(5).to_pylist()), np.uint32).reshape(len(ids), -1)
            cols = whole.column(6).to_numpy()

            def here(x, y, ways=ways, cols=cols):
                """Which of the pairs (by row) meet first in this column."""
                parts = [(ways[x[k : k + 8192]] == ways[y[k : k + 8192]]).argmax(1) == cols[x[k : k + 8192]] for k in range(0, len(x), 8192)]
                return np.concatenate(parts) if parts else np.zeros(0, bool)

            left, right, more = [], [], []
            two = np.array([h for h, t in bounds if t - h == 2], np.int64)
            if len(two):  # most tiles are pairs
                ok = ((sigs[two] == sigs[two + 1]).sum(1) >= least) & (comps[two] != comps[two + 1]) & here(two, two + 1)
                left.append(ids[two][ok])
                right.append(ids[two + 1][ok])
            for h, t in bounds:
                if t - h <= 2:
                    continue
                i, j, same = _sides(side[h:t])
                est = _matches(sigs[h:t][i], sigs[h:t][j])
                ok = (est >= least) & (comps[h:t][i][:, None] != comps[h:t][j][None, :])
                if same:
                    ok &= ids[h:t][i][:, None] > ids[h:t][j][None, :]
                x, y = np.nonzero(ok)
                first = here(h + i[x], h + j[y])
                ok[x[~first], y[~first]] = False
                n = int(np.count_nonzero(first))
                if not n:
                    continue
                if n <= 2 or not best_only and n <= 4 * (t - h):
                    x, y = np.nonzero(ok)
                elif best_only:
                    sure = np.where(ok, est, 0)
                    rows, cols = np.arange(len(i)), np.arange(len(j))
                    by_row, by_col = ok.sum(1), ok.sum(0)
                    hub_row, hub_col = (int((by_row + by_col).argmax()),) * 2 if same else (int(by_row.argmax()), int(by_col.argmax()))
                    x = np.concatenate([rows, np.full(len(j), hub_row), rows])
                    y = np.concatenate([sure.argmax(1), cols, np.full(len(i), hub_col)])
                    keep = ok[x, y]
                    x, y = np.unique(np.stack([x[keep], y[keep]]), axis=1)
                    if len(x) < n:
                        more.append(tile[h])
                else:
                    more.append(tile[h])
                    continue
                left.append(ids[h:t][i][x])
                right.append(ids[h:t][j][y])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
            if len(a):
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield _pair_batch(a, b, more)

    return run


def _exact_tiles(percent: int, columns: int = 4096):
    """Rows (tile, side, id, comp, set) sorted by tile -> links enough to join what the tile's true links join.

    Sizes of all intersections come from products of blocks of the 0-1 matrix of sets and shingles."""

    def run(batches):
        one_product_thread()
        for whole, _, bounds in _whole_tiles(batches):
            side, ids, comps = (whole.column(i).to_numpy() for i in (1, 2, 3))
            raw = whole.column(4)
            left, right = [], []
            for h, t in bounds:
                i, j, same = _sides(side[h:t])
                sets = [np.frombuffer(raw[k].as_py(), np.uint64) for k in range(h, t)]
                size = np.array([len(s) for s in sets], np.int64)
                flat, owner = np.concatenate(sets), np.repeat(np.arange(t - h), size)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                number = np.cumsum(np.append(False, flat[1:] != flat[:-1])) if len(flat) else flat.astype(np.int64)
                shared = np.bincount(number)[number] > 1
                number, owner = number[shared], owner[shared]
                number = np.cumsum(np.append(0, number[1:] != number[:-1])) if len(number) else number
                inter = np.zeros((len(i), len(j)), np.float64)
                for c in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
                    lo, hi = np.searchsorted(number, [c, c + columns])
                    held = np.zeros((t - h, columns), np.float32)
                    held[owner[lo:hi], number[lo:hi] - c] = 1
                    inter += held[i] @ (held if same else held[j]).T
                union = size[i][:, None] + size[j][None, :] - inter
                ok = (100 * inter >= percent * union) & (comps[h:t][i][:, None] != comps[h:t][j][None, :])
                x, y = np.nonzero(ok)
                a, b = _forest(i[x], j[y], t - h)
                left.append(ids[h:t][a])
                right.append(ids[h:t][b])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links, those of a forest that joins the same nodes."""
    kept_a, kept_b, root = [], [], np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        a, b, ra, rb = (v[ra != rb] for v in (a, b, ra, rb))
        if not len(a):
            return np.array(kept_a, np.int64), np.array(kept_b, np.int64)
        first = np.unique(np.maximum(ra, rb), return_index=True)[1]  # each root hangs below a smaller one, once
        kept_a += a[first].tolist()
        kept_b += b[first].tolist()
        root[np.maximum(ra, rb)[first]] = np.minimum(ra, rb)[first]
        while (root[root] != root).any():
            root = root[root]


def _pivot_pairs(least: int):
    """Rows (id, sig, comp, pivots) -> each member's best pivot of another component."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for me, sig, comp, pivots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                pivots = [p for p in pivots if p["comp"] != comp]
                if not pivots:
                    continue
                est = (np.frombuffer(sig, np.uint8) == np.frombuffer(b"".join(p["sig"] for p in pivots), np.uint8).reshape(-1, HASHES)).sum(1)
                if est[k := int(est.argmax())] >= least:
                    left.append(me)
                    right.append(pivots[k]["id"])
            yield _pair_batch(np.array(left, np.int64), np.array(right, np.int64))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = TREES, early: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: id, n_shingles, component_id, kept, and the columns named in carry."""
    spark = docs.sparkSession
    stage = Stage(spark)
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    texts = docs.select(F.col(id_col).alias("own"), *[F.col(c).alias(k) for k, c in carried.items()], F.col(text_col).cast("binary").alias("text"))
    own = texts.schema[:-1]
    every = stage.keep(texts.mapInArrow(_features(shingle, trees), T.StructType([*own, *FEATURES])))
    # a node for each distinct set, numbered by one of its rows
    copies = stage.keep(every.where("print IS NOT NULL").groupBy("print").agg(F.min("uid").alias("id"), F.min("own").alias("rep")))
    # further rows of a set: only what may be one of them shuffles, not every row with its leaves
    further = stage.keep(every.where("print IS NOT NULL").select("uid", "print").join(copies.select("print", "id"), "print").where("uid <> id").select(F.col("uid").alias("id")))
    sets = bloom.without(every.where("print IS NOT NULL").select(F.col("uid").alias("id"), "n", "leaves"), further, "id", stage)

    # leaves that one set alone reaches go first; numbers alone shuffle here, signatures follow where they are needed
    at = sets.select("id", "n", F.posexplode("leaves").alias("col", "leaf"))
    n_sets = copies.count()
    bits = bloom.size_for(n_sets * trees * int(np.prod(FANS)))
    if n_sets * trees * int(np.prod(FANS)) < bits:
        at = bloom.test(at, F.col("leaf"), bloom.bits_of(at, F.col("leaf"), bits, stage, repeated=True), bits, "maybe").where("maybe").drop("maybe")
    at = stage.keep(at)
    big = (F.col("size") > SMALL) | (F.col("shingles") > SMALL * MEAN_SHINGLES)
    leaves = stage.keep(at.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1").withColumn("big", big))
    members = stage.keep(at.join(leaves, "leaf").select("leaf", "id", "size", "shingles", "big", "col"))
    small = members.where("NOT big").select(F.col("leaf").alias("tile"), F.lit(0).alias("side"), "id", "col")
    large = members.where("big").select("leaf", "id", "size", "shingles", "col")
    any_large = leaves.where("big").limit(1).count() > 0

    involved = stage.keep(copies.join(members.select("id").distinct(), "id").select("print", "id", "rep"))
    rep_bits = bloom.size_for(n_sets)
    # most sets meet no other: signatures are taken along for those that do
    sigs = every.select(F.col("uid").alias("id"), "sig", "ways")
    sigs = stage.keep(bloom.among(sigs, involved, "id", stage).join(involved.select("id"), "id", "left_semi"))
    reps = bloom.bits_of(involved, F.xxhash64("rep"), rep_bits, stage)
    maybe = bloom.test(texts, F.xxhash64("own"), reps, rep_bits, "maybe").where("maybe").select("text")
    full = maybe.mapInArrow(_sets(shingle), "print binary, set binary").where("print IS NOT NULL").dropDuplicates(["print"])
    full = stage.keep(full.join(involved, "print").select("id", "set"))

    labels = None
    share = percent / 100
    least = int(np.floor(HASHES * (share - MARGIN * np.sqrt(share * (1 - share) / HASHES))))

    def with_component(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def compared(tiles: DataFrame, best_only: bool) -> DataFrame:
        rows = with_component(tiles).join(sigs, "id").select("tile", "side", "id", "sig", "comp", "ways", F.col("col").cast("bigint").alias("col"))
        return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(least, best_only), PAIR)

    def link(new: DataFrame) -> None:
        """Takes new links (a, b) in: what they join are the components so far."""
        nonlocal labels
        between = with_component(new.withColumnRenamed("a", "id")).select("b", F.col("comp").alias("a"))
        between = with_component(between.withColumnRenamed("b", "id")).select("a", F.col("comp").alias("b")).where("a <> b").distinct()
        between = stage.keep(between)
        if between.limit(1).count():
            joined = components(between, "a", "b", stage)
            if labels is not None:
                more = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
                moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
                joined = stage.keep(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(more))
            labels = joined

    def confirmed(found: DataFrame) -> DataFrame:
        pairs = stage.keep(found.where("tile IS NULL AND a <> b").select("a", "b").distinct())
        asked = bloom.among(full, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", stage)  # the others' sets don't shuffle
        left = pairs.join(asked.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        both = left.join(asked.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
        return stage.keep(both.mapInArrow(_confirm(percent), "a bigint, b bigint, ok boolean").where("ok").select("a", "b"))

    def against_pivots(rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """Members join their leaf's pivots by leaf and slot, so that no leaf is one key."""
        slots = F.ceil(F.col("size") / F.lit(1024))
        dealt = rows.withColumn("slot", F.pmod(F.xxhash64("id"), slots))
        held = pivots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1))).drop("size")
        return dealt.join(held, ["leaf", "slot"]).select("id", "sig", "comp", "pivots").mapInArrow(_pivot_pairs(least), PAIR)

    def pivots_of(rows: DataFrame, n: int = 4) -> DataFrame:
        one = rows.groupBy("leaf", F.pmod(F.xxhash64("id"), F.lit(n)).alias("k")).agg(F.first("size").alias("size"), F.min_by(F.struct("id", "sig", "comp"), F.xxhash64("id")).alias("one"))
        return one.groupBy("leaf").agg(F.first("size").alias("size"), F.collect_list("one").alias("pivots"))

    # the first trees join most of what is alike; later only leaves of several components are looked at
    is_early = F.col("col") < early * int(np.prod(FANS))
    found = compared(small.where(is_early), best_only=True)
    if any_large:
        now = large.where(is_early).withColumn("comp", F.col("id")).join(sigs, "id")
        found = found.unionByName(against_pivots(now, stage.keep(pivots_of(now))))
    found = stage.keep(found)
    left = stage.keep(found.where("tile IS NOT NULL").select("tile").distinct())
    link(confirmed(found))

    tiles = small.where(~is_early).unionByName(small.where(is_early).join(left, "tile", "left_semi"))
    if labels is not None:
        open_ = with_component(tiles).groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tile")
        tiles = tiles.join(open_, "tile", "left_semi")
    if any_large:
        now = with_component(large)
        held = now.groupBy("leaf", "comp").agg(F.count(F.lit(1)).alias("held"))
        main = stage.keep(held.groupBy("leaf").agg(F.max_by("comp", F.struct("held", "comp")).alias("main"), F.max("held").alias("in_main")))
        now = now.join(main, "leaf").where("in_main < size")
        # what is outside a leaf's main component meets every other member, block by block
        outside = F.col("size") - F.col("in_main")
        mean = F.col("shingles") / F.col("size") / MEAN_SHINGLES  # a block of long sets holds fewer
        outs, mains = (F.ceil(n / BLOCK * F.greatest(F.lit(1.0), mean)) for n in (outside, F.col("in_main")))
        h = F.xxhash64("id", F.lit(77))
        blocks = now.select("leaf", "id", "col", outs.alias("outs"), (outs + mains).alias("blocks"), F.when(F.col("comp") != F.col("main"), F.pmod(h, outs)).otherwise(outs + F.pmod(h, mains)).alias("mine"))
        # a block of outsiders meets itself and every later block
        as_first = blocks.where("mine < outs").select("leaf", "id", "col", F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("j")).withColumn("side", F.lit(0))
        as_second = blocks.where("mine > 0").select("leaf", "id", "col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("mine"), F.col("outs")) - 1)).alias("i"), F.col("mine").alias("j")).withColumn("side", F.lit(1))
        tiles = tiles.unionByName(as_first.unionByName(as_second).select(F.xxhash64("leaf", "i", "j").alias("tile"), "side", "id", "col"))
    tiles = stage.keep(tiles)
    found = stage.keep(compared(tiles, best_only=True))
    more = tiles.join(found.where("tile IS NOT NULL").select("tile").distinct(), "tile", "left_semi")
    link(confirmed(found))

    # tiles that hold more: all pairs between components where they are few, full sets where they are many
    more = stage.keep(more)
    if more.limit(1).count():
        found = stage.keep(compared(more, best_only=False))
        dense = stage.keep(more.join(found.where("tile IS NOT NULL").select("tile").distinct(), "tile", "left_semi"))
        link(confirmed(found))
        if dense.limit(1).count():
            rows = with_component(dense).join(bloom.among(full, dense, "id", stage), "id").select("tile", "side", "id", "comp", "set").repartition("tile").sortWithinPartitions("tile")
            link(stage.keep(rows.mapInArrow(_exact_tiles(percent), "a bigint, b bigint")))

    of_copy = copies.withColumn("component", F.col("id")) if labels is None else with_component(copies).withColumnRenamed("comp", "component")
    of_copy = stage.keep(of_copy.select("print", "rep", "component"))
    least_of = of_copy.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = every.select("own", *carried, "n", "print").join(of_copy.join(least_of, "component").select("print", "component_id"), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("own")).otherwise(F.col("component_id"))
    out = stage.keep(named.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *[F.col(k).alias(c) for k, c in carried.items()]))
    stage.drop_but(out)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


#: Every pair of documents that share a shingle, and reachability over the links.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
), c AS (
  SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
