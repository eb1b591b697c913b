"""Second-order histogram boosting of squared errors, level by level or leaf by leaf.

Features become at most ``max_bins`` bins each, once. A pass over the rows adds up
gradients and hessians per (node, feature, bin): each task fills dense arrays, these are
added up (through a tree of tasks if there are many), and the driver, which sees
node x feature x bin sums whatever the number of rows, picks the splits by the regularised gain

    (T(GL)^2 / (HL + l) + T(GR)^2 / (HR + l) - T(G)^2 / (H + l)) / 2 - gamma

with T the soft threshold of ``reg_alpha`` and l ``reg_lambda``. The hessian of a squared
error is 1, so hessian sums are row counts. Of two children only the one with fewer rows
is added up; the other is their parent less that one.

Both ways of growth are one: open leaves wait in a queue by gain, and the best is split
until there are ``num_leaves`` leaves or no leaf gains. Level-wise growth is that with a
depth limit and no leaf limit. All leaves which the queue would split are expanded in one
pass, so a tree takes about as many passes as it is deep, not as many as it has leaves;
leaves that a better child overtakes are left as they were. Nodes of at most ``NEAR`` rows
are finished in one more job: their rows are shuffled, a task grows what is below each by
itself, and the driver, which gets the nodes it found, lets them compete in the queue.

Rows lie in blocks of columns, persisted with the prediction of all trees so far; each
``REWRITE`` rounds they are written, which cuts their lineage. Rows are sampled per round
by a hash of their content, columns per tree by ``random_state``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.runtime import cut_lineage, remove_folder

BINS = 256
REWRITE = 25
#: Rows of a node at most that one task finishes.
NEAR = 65_536
#: Rows of a block at most, but for one batch; bytes of bins from which there is a further task, up to one per core;
#: tasks whose sums the driver adds up itself.
BLOCK, TASK_BYTES, DIRECT = 65_536, 4 << 20, 16
#: Error of a cut point's rank, as a share of the rows, is at most one in so many.
ACCURACY = 10_000
BLOCKS = "x BINARY, y BINARY, held_out BINARY, key BINARY, pred BINARY"


@dataclass
class Tree:
    """Nodes by number, 0 the root; a row goes left if its value is at most the threshold. Leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, rows: float, value: float) -> int:
        for column, v in zip((self.feature, self.cut, self.threshold, self.left, self.right, self.value, self.gain, self.rows), (-1, 0, 0.0, 0, 0, value, 0.0, rows)):
            column.append(v)
        return len(self.feature) - 1

    def leaves(self) -> list[int]:
        return [at for at, f in enumerate(self.feature) if f < 0]

    def rows_of(self, x: np.ndarray, at_most: Sequence, rows: np.ndarray, wanted: Sequence[int]) -> dict[int, np.ndarray]:
        """Which of the rows are in each wanted node; ``x`` has bins, or values, feature by feature, and ``at_most`` their limits."""
        up = {child: at for at, f in enumerate(self.feature) if f >= 0 for child in (self.left[at], self.right[at])}
        above = set()
        for at in wanted:
            while at in up and up[at] not in above:
                at = up[at]
                above.add(at)
        found, open_nodes = {}, [(0, rows)]
        while open_nodes:
            at, mine = open_nodes.pop()
            found[at] = mine
            if at in above:
                left = x[self.feature[at]][mine] <= at_most[at]
                open_nodes += [(self.left[at], mine[left]), (self.right[at], mine[~left])]
        return {at: found[at] for at in wanted}


@dataclass
class Booster:
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, by_feature, rows = np.full(len(x), self.base), np.ascontiguousarray(x.T), np.arange(len(x))
        for tree in self.trees:
            for at, mine in tree.rows_of(by_feature, tree.threshold, rows, tree.leaves()).items():
                out[mine] += tree.value[at]
        return out

    def column(self, values: Column) -> Column:
        """The prediction of an array column of features, evaluated batch by batch."""
        from pyspark.sql.functions import arrow_udf

        @arrow_udf("double")
        def predicted(rows: pa.Array) -> pa.Array:
            return pa.array(self.predict(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)))

        return predicted(values)

    def to_dict(self) -> dict:
        return {"base": self.base, "trees": [asdict(t) for t in self.trees]}

    @staticmethod
    def of_dict(found: Mapping) -> Booster:
        return Booster(found["base"], [Tree(**t) for t in found["trees"]])


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int = 0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_bins: int = BINS
    random_state: int = 1337
    early_stopping_rounds: int = 10


def cut_points(rows: DataFrame, values: Column, features: int, max_bins: int = BINS) -> list[np.ndarray]:
    """Ascending cut points of each feature; a value's bin is the number of cut points below it.

    A feature of few values has them all (but the largest, which splits nothing); others
    have quantiles of a mergeable sketch, one pass for all.
    """
    if not 2 <= max_bins <= BINS:
        raise ValueError(f"max_bins lies between 2 and {BINS}")
    table = rows.select(values.alias("_x"))
    probs = F.expr(f"array({', '.join(f'{i / max_bins!r}D' for i in range(1, max_bins))})")
    item = [F.col("_x")[i] for i in range(features)]
    first = table.agg(*[F.struct(F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, probs, ACCURACY).alias("q")).alias(f"f{i}") for i, c in enumerate(item)]).first()
    few = [i for i in range(features) if first[f"f{i}"]["n"] <= max_bins * 1.2]  # the count is within a few hundredths
    sets = table.agg(*[F.collect_set(item[i]).alias(f"f{i}") for i in few]).first() if few else {}
    out = []
    for i in range(features):
        found = np.unique(np.array(sets[f"f{i}"] if i in few else first[f"f{i}"]["q"] or [], float))
        if i in few:
            found = found[:-1] if len(found) <= max_bins else np.unique(np.array(first[f"f{i}"]["q"], float))
        out.append(found)
    return out


def _binned(cuts: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(cuts))
            bins = np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8) if len(batch) else np.zeros((0, len(cuts)), np.uint8)
            data = pa.Array.from_buffers(pa.binary(len(cuts)), len(batch), [None, pa.py_buffer(np.ascontiguousarray(bins))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([data, *batch.columns[1:]], names=["bins", "y", "held_out"])

    return run


def _mixed(key: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """Even numbers in [0, 1) from a row's hash and the round."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def _blocked(features: int) -> Callable:
    """Rows to blocks, one row each: bins feature by feature, and the other columns."""
    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        _, offsets, data = rows.column("bins").buffers()
        start = np.frombuffer(offsets, np.int32)[rows.column("bins").offset]
        x = np.frombuffer(data, np.uint8)[start : start + len(rows) * features].reshape(len(rows), features)
        columns = [x.T, *[rows.column(c).to_numpy(zero_copy_only=False) for c in ("y", "held_out", "key", "pred")]]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["x", "y", "held_out", "key", "pred"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held, n = [*held, batch], n + len(batch)
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return run


def _packed(block: tuple[np.ndarray, ...]) -> tuple[bytes, ...]:
    return tuple(a.tobytes() for a in block)


def _unpacked(features: int) -> Callable:
    kinds = (np.uint8, float, bool, np.int64, float)

    def run(row: Sequence) -> tuple[np.ndarray, ...]:
        x, *others = [np.frombuffer(bytes(data), kind) for data, kind in zip(row, kinds)]
        return (x.reshape(features, -1), *others)

    return run


def _dense(bins: list[int], columns: np.ndarray) -> Callable:
    """Sums in which the bins of the columns follow each other, as an array (2, bins, columns)."""
    place = np.concatenate([np.arange(bins[c]) * len(columns) + i for i, c in enumerate(columns)])
    most = max(bins[c] for c in columns)

    def run(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((2, most * len(columns)))
        out[0, place], out[1, place] = g, h
        return out.reshape(2, most, len(columns))

    return run


def _add_rows(g: np.ndarray, h: np.ndarray, x, rows: np.ndarray, gradient: np.ndarray, bins: list[int], columns: np.ndarray) -> None:
    """Add rows to a node's sums, in which the bins of the columns follow each other; ``x`` gives the bins of a column."""
    at, gradient = 0, gradient[rows]
    for c in columns:
        mine = x[c].take(rows)
        g[at : at + bins[c]] += np.bincount(mine, gradient, bins[c])
        h[at : at + bins[c]] += np.bincount(mine, minlength=bins[c])
        at += bins[c]


def _used(held_out: np.ndarray, key: np.ndarray, round_: int, s: Settings) -> np.ndarray:
    used = ~held_out
    if s.subsample < 1:
        used &= _mixed(key, round_, s.random_state) < s.subsample
    return np.flatnonzero(used)


def _sums(bins: list[int], growing: Tree, wanted: list[int], columns: np.ndarray, round_: int, s: Settings) -> Callable:
    """Gradient and hessian sums of the wanted nodes, and the squared error and number of the rows held out."""
    cells = sum(bins[c] for c in columns)

    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        g, h = np.zeros((len(wanted), cells)), np.zeros((len(wanted), cells), np.int64)
        error, seen = 0.0, 0
        for x, y, held_out, key, pred in blocks:
            gradient = pred - y
            error, seen = error + float((gradient[held_out] ** 2).sum()), seen + int(held_out.sum())
            found = growing.rows_of(x, growing.cut, _used(held_out, key, round_, s), wanted)
            for i, at in enumerate(wanted):
                if len(found[at]):
                    _add_rows(g[i], h[i], x, found[at], gradient, bins, columns)
        yield g, h.astype(np.int32), error, seen

    return run


def _added(one: tuple, other: tuple) -> tuple:
    return one[0] + other[0], np.add(one[1], other[1], dtype=np.int64), one[2] + other[2], one[3] + other[3]


def _rows(growing: Tree, near: list[int], columns: np.ndarray, round_: int, s: Settings) -> Callable:
    """The rows of some nodes, with their place in the table."""
    def run(part: int, blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        for i, (x, y, held_out, key, pred) in enumerate(blocks):
            gradient = pred - y
            for at, rows in growing.rows_of(x, growing.cut, _used(held_out, key, round_, s), near).items():
                if len(rows):
                    yield at, ((part, i), np.stack([x[c].take(rows) for c in columns]), gradient[rows])

    return run


def _finished(depths: dict[int, int], bins: list[int], columns: np.ndarray, s: Settings) -> Callable:
    """What is below the nodes whose rows have come to this task; each has at most ``NEAR``."""
    def run(found: Iterator[tuple]) -> Iterator[tuple[int, list[_Node]]]:
        chunks, dense = {}, _dense(bins, columns)
        for at, chunk in found:
            chunks.setdefault(at, []).append(chunk)
        for at, some in chunks.items():
            some.sort(key=lambda chunk: chunk[0])  # sums in the same order each time
            x = dict(zip(columns, np.concatenate([x for _, x, _ in some], 1)))
            gradient = np.concatenate([g for _, _, g in some])

            def look_up(shape: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
                out = {}
                for node, rows in shape.rows_of(x, shape.cut, np.arange(len(gradient)), wanted).items():
                    g, h = np.zeros(sum(bins[c] for c in columns)), np.zeros(sum(bins[c] for c in columns), np.int64)
                    _add_rows(g, h, x, rows, gradient, bins, columns)
                    out[node] = dense(g, h)
                return out

            nodes, _ = _best_first(look_up, None, columns, s, 0, len(gradient), depths[at])
            yield at, [replace(node, sums=None) for node in nodes]

    return run


@dataclass
class _Node:
    depth: int
    g: float
    h: float
    sums: np.ndarray | None = None  # (2, bins, features)
    best: tuple[float, int, int, float, float] | None = None  # gain, feature, bin, G and H of the left side
    children: tuple[int, int] | None = None


def _shrunk(g, s: Settings):
    return g if s.reg_alpha == 0 else np.sign(g) * np.maximum(np.abs(g) - s.reg_alpha, 0.0)


def _score(g, h, s: Settings):
    return _shrunk(g, s) ** 2 / np.maximum(h + s.reg_lambda, 1e-300)


def best_split(sums: np.ndarray, g: float, h: float, s: Settings) -> tuple[float, int, int, float, float] | None:
    """The split of the largest gain; of equals the first feature, then the lowest cut. None if nothing is gained."""
    gl, hl = np.cumsum(sums[:, :-1], axis=1)
    gr, hr = g - gl, h - hl
    gain = _score(gl, hl, s) + _score(gr, hr, s)
    least = max(s.min_child_weight, 1)  # hessians are counts
    gain[(hl < least) | (hr < least)] = -np.inf
    if not gain.size:
        return None
    cuts = np.argmax(gain, axis=0)
    feature = int(np.argmax(gain[cuts, np.arange(len(cuts))]))
    cut = int(cuts[feature])
    best = float((gain[cut, feature] - _score(g, h, s)) / 2 - s.gamma)
    return (best, feature, cut, float(gl[cut, feature]), float(hl[cut, feature])) if best > 1e-12 else None


def _best_first(look_up: Callable, finish: Callable | None, columns: np.ndarray, s: Settings, few: int, rows: int, depth: int = 0) -> tuple[list[_Node], list[int]]:
    """The nodes below one of at most so many ``rows`` at that depth, and which of them are split.

    ``look_up`` gives the sums of nodes, ``finish`` all that is below nodes of at most ``few`` rows."""
    least = 2 * max(s.min_child_weight, 1)  # rows of a node that can be split
    depth_limit = s.max_depth if s.max_depth > 0 else math.inf
    leaf_limit = s.num_leaves - depth if s.num_leaves > 0 else math.inf  # above it are as many splits as it is deep
    shape, nodes, near = Tree(), [], set()  # all nodes made so far, overtaken ones too; those to be finished

    def add(node: _Node) -> int:
        nodes.append(node)
        return shape.add(node.h, 0.0)

    def part(at: int, children: Sequence[int]) -> None:
        nodes[at].children = tuple(children)
        _, shape.feature[at], shape.cut[at], *_ = nodes[at].best
        shape.left[at], shape.right[at] = children

    def can_split(at: int) -> bool:
        return nodes[at].depth < depth_limit and nodes[at].h >= least

    def look(at: int, sums: np.ndarray) -> None:
        found = best_split(sums, nodes[at].g, nodes[at].h, s)
        nodes[at].sums, nodes[at].best = sums, found and (found[0], int(columns[found[1]]), *found[2:])

    add(_Node(depth, 0.0, 0.0))
    if rows <= few:
        near.add(0)
    else:
        sums = look_up(shape, [0])[0]
        nodes[0].g, nodes[0].h = float(sums[0, :, 0].sum()), float(sums[1, :, 0].sum())
        if can_split(0):
            look(0, sums)
    while True:
        queue = [(-nodes[0].best[0], 0)] if nodes[0].best else []
        chosen, unknown = [], []
        while queue and len(chosen) + 1 < leaf_limit:
            _, at = heapq.heappop(queue)
            chosen.append(at)
            if nodes[at].children is None:
                unknown.append(at)
                continue
            for child in nodes[at].children:
                if nodes[child].best:
                    heapq.heappush(queue, (-nodes[child].best[0], child))
        far = [at for at in unknown if nodes[at].sums is not None]
        if not far and not near and not unknown:
            return nodes, chosen
        if not far:
            found = finish(shape, {at: nodes[at] for at in near.union(unknown)})
            for at in near.union(unknown):
                below = found.get(at) or [_Node(depth, 0.0, 0.0)]  # no row at all
                numbers = [at, *[add(node) for node in below[1:]]]
                nodes[at] = replace(below[0], children=None)
                for number, node in zip(numbers, below):
                    if node.children:
                        part(number, [numbers[child] for child in node.children])
            near = set()
            continue
        asked = {}
        for at in far:
            node = nodes[at]
            _, _, _, gl, hl = node.best
            part(at, [add(_Node(node.depth + 1, g, h)) for g, h in ((gl, hl), (node.g - gl, node.h - hl))])
            small, large = sorted(node.children, key=lambda child: nodes[child].h)
            near.update(child for child in node.children if can_split(child) and nodes[child].h <= few)
            if can_split(large) and nodes[large].h > few:
                asked[small] = at, large
        sums = look_up(shape, sorted(asked)) if asked else {}
        for small, (at, large) in asked.items():
            look(large, nodes[at].sums - sums[small])
            if can_split(small) and small not in near:
                look(small, sums[small])
        for at in far:
            nodes[at].sums = None


def _grown(nodes: list[_Node], chosen: list[int], cuts: list[np.ndarray], s: Settings) -> Tree:
    tree = Tree()
    value = lambda n: float(-_shrunk(n.g, s) / max(n.h + s.reg_lambda, 1e-300) * s.learning_rate)
    split = set(chosen)
    queue = [(0, tree.add(nodes[0].h, value(nodes[0])))]
    for at, place in queue:  # grows while it is read
        if at in split:
            gain, feature, cut, _, _ = nodes[at].best
            left, right = [tree.add(nodes[c].h, value(nodes[c])) for c in nodes[at].children]
            tree.feature[place], tree.cut[place], tree.threshold[place], tree.gain[place] = feature, cut, float(cuts[feature][cut]), gain
            tree.left[place], tree.right[place] = left, right
            queue += zip(nodes[at].children, (left, right))
    return tree


def boost(rows: DataFrame, values: Column, label: Column, features: int, settings: Settings = Settings(), held_out: DataFrame | None = None) -> Booster:
    """Fit on the rows that have a label; ``values`` is an array of ``features`` numbers without NULL.

    With ``held_out`` rows the trees up to their least error are kept, and boosting stops
    once ``early_stopping_rounds`` trees have not lowered it.
    """
    s = settings
    named = lambda df, out: df.filter(label.isNotNull()).select(values.alias("x"), label.cast("double").alias("y"), F.lit(out).alias("held_out"))
    cuts = cut_points(rows.filter(label.isNotNull()), values, features, s.max_bins)
    both = named(rows, False) if held_out is None else named(rows, False).unionByName(named(held_out, True))
    binned = both.mapInArrow(_binned(cuts), "bins BINARY, y DOUBLE, held_out BOOLEAN")
    table = cut_lineage(binned.withColumn("key", F.xxhash64("bins", "y")))
    first = table.filter(~F.col("held_out")).agg(F.avg("y").alias("base"), F.count(F.lit(1)).alias("rows")).first()
    base, spark = first["base"], table.sparkSession
    if base is None:
        raise ValueError("no training row left")
    bins = [len(c) + 1 for c in cuts]
    tasks = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(table.count() * features / TASK_BYTES)))
    blocks = table.withColumn("pred", F.lit(float(base))).repartition(tasks).mapInArrow(_blocked(features), BLOCKS)
    state, before = blocks.rdd.map(_unpacked(features)).persist(StorageLevel.MEMORY_AND_DISK_DESER), []
    rng = np.random.default_rng(s.random_state)
    booster, moves, errors = Booster(float(base), []), 0, []

    def let_go() -> None:
        while before:
            before.pop().unpersist()

    for round_ in range(s.n_estimators):
        columns = np.sort(rng.choice(features, max(1, int(s.colsample_bytree * features)), replace=False)) if s.colsample_bytree < 1 else np.arange(features)
        dense = _dense(bins, columns)

        def look_up(shape: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
            parts = state.mapPartitions(_sums(bins, shape, wanted, columns, round_, s))
            g, h, error, seen = parts.treeReduce(_added, 1 if parts.getNumPartitions() <= DIRECT else 2)
            let_go()  # the pass has persisted what came after
            if seen and 0 in wanted:
                errors.append(error / seen)
            return {at: dense(g[i], h[i]) for i, at in enumerate(wanted)}

        def finish(shape: Tree, near: dict[int, _Node]) -> dict[int, list[_Node]]:
            n = min(len(near), spark.sparkContext.defaultParallelism)
            place = {at: i % n for i, at in enumerate(sorted(near, key=lambda at: (-near[at].h, at)))}
            rows = state.mapPartitionsWithIndex(_rows(shape, sorted(near), columns, round_, s)).partitionBy(n, place.get)
            done = rows.mapPartitions(_finished({at: node.depth for at, node in near.items()}, bins, columns, s))
            out = dict(done.collect())
            done._jrdd.rdd().cleanShuffleDependencies(False)  # else its files stay until the driver collects garbage
            let_go()
            return out

        # Errors of rows held out come with the root's sums.
        tree = _grown(*_best_first(look_up, finish, columns, s, NEAR, first["rows"] if held_out is None else math.inf), cuts, s)
        if errors and len(errors) - 1 - int(np.argmin(errors)) >= s.early_stopping_rounds:
            break
        if tree.feature[0] < 0 and s.subsample == 1 and s.colsample_bytree == 1:
            break  # nothing is gained any more
        booster.trees.append(tree)
        before.append(state)
        state, moves = _moved(state, tree), moves + 1
        if moves == REWRITE and round_ + 1 < s.n_estimators:  # nothing reads the rows after the last round
            spent, moves = unquote(table.inputFiles()[0].rsplit("/", 1)[0]), 0
            table = cut_lineage(spark.createDataFrame(state.map(_packed), BLOCKS))
            state = table.rdd.map(_unpacked(features))
            let_go()
            remove_folder(spark, spent)
        state = state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    if errors and len(errors) == len(booster.trees):  # the last tree's error is still to be taken
        stump = Tree()
        stump.add(0.0, 0.0)
        look_up(stump, [0])
    before.append(state)
    let_go()
    if errors:  # errors[i] is that of the first i trees
        booster.trees = booster.trees[: int(np.argmin(errors))]
    return booster


def _moved(state: RDD, tree: Tree) -> RDD:
    """Rows with the predictions of one more tree."""
    leaves = tree.leaves()

    def run(block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        x, *others, pred = block
        pred = pred.copy()
        for at, rows in tree.rows_of(x, tree.cut, np.arange(len(pred)), leaves).items():
            pred[rows] += tree.value[at]
        return (x, *others, pred)

    return state.map(run)
