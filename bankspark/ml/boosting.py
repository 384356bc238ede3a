"""Gradient boosted trees with logistic loss, second order, on histograms.

Each feature is cut once at its quantiles. A level of a tree needs, per open node, feature and bin, the sums
of first and second derivatives of the loss: one pass over the rows. Only these sums (nodes x features x bins,
once per task) reach the driver, which picks the splits; rows and their margins stay on the executors.

Rows that agree in all bins and the label have the same margin in every round: they are one row with a weight.
Features of few bins share a column, as digits of a number; their sums are read off the column's. Rows are kept
in blocks: a record holds the columns of many rows, one after the other, with their labels, weights and
margins, so that a pass hands arrays to numpy and nothing row by row. Each tree's leaf values are added to
the margins once, in the pass that starts the next tree. Rows that one task can hold (``_ONE_TASK``) are fitted
by one task, which then needs no job of its own for each level.

Derivatives are summed as integers, so a tree depends neither on row order nor on partitions, and a lost
executor's rows give the same sums again.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.session import fresh_path, remove_path

UNIT = 2.0**26  # derivatives are rounded to this part; 10^11 rows fit into a 64-bit sum
LEAST_GAIN = 1e-6
_ACCURACY = 10_000
_ROWS_PER_TASK = 100_000
_MOST_PER_TASK = 2_000_000  # where there are more tasks than a few per core
_BLOCK, _BLOCK_BYTES = 16_384, 1 << 21  # rows of a block at most, and bytes of its bins
_MOST_WEIGHT = 1 << 13  # of a row: the sums of a block stay below 2^53
_ONE_TASK = 1 << 23  # entries (rows x columns) that are fitted by one task
_SENT = 1 << 25  # bytes of sums that a pass sends to the driver, about
_ROWS = "n INT, x BINARY, y BINARY, w BINARY, margin BINARY"
_TREES_PER_WRITE = 10  # margins are written again after so many trees

NODE_SCHEMA = (
    "tree INT, node INT, feature INT, cut INT, threshold DOUBLE, missing_left BOOLEAN, left INT, right INT, "
    "value DOUBLE, cover DOUBLE, gain DOUBLE"
)


@dataclass
class Tree:
    """Nodes by number, the root first. A leaf has feature -1; ``value`` is already times the step."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add_leaf(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("cut", -1), ("threshold", math.nan), ("missing_left", True), ("left", -1), ("right", -1), ("gain", 0.0)):
            getattr(self, name).append(v)
        self.value.append(value)
        self.cover.append(cover)
        return len(self.feature) - 1

    def places(self, x: np.ndarray, missing: np.ndarray, bounds: Sequence) -> np.ndarray:
        """The leaf of every row of ``x``; ``bounds`` are the nodes' cuts (for bins) or thresholds (for values)."""
        feature, bounds = np.asarray(self.feature), np.asarray(bounds)
        left, right, default = np.asarray(self.left), np.asarray(self.right), np.asarray(self.missing_left)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x)) if feature[0] >= 0 else at[:0]  # those not yet in a leaf
        while len(rows):
            node = at[rows]
            f = feature[node]
            goes_left = np.where(missing[rows, f], default[node], x[rows, f] <= bounds[node])
            at[rows] = node = np.where(goes_left, left[node], right[node])
            rows = rows[feature[node] >= 0]
        return at

    def margins(self, x: np.ndarray, missing: np.ndarray, bounds: Sequence) -> np.ndarray:
        return np.asarray(self.value)[self.places(x, missing, bounds)]


@dataclass(frozen=True)
class Boosting:
    """A fitted model: its features in order, and its trees. The margin (log-odds) is the sum of leaf values."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def nodes(self) -> pd.DataFrame:
        """One row per node of every tree (columns of ``NODE_SCHEMA``)."""
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        rows = [
            (t, i, *[getattr(tree, n)[i] for n in names[2:]]) for t, tree in enumerate(self.trees) for i in range(len(tree.feature))
        ]
        return pd.DataFrame(rows, columns=names)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the node table."""
        spark.createDataFrame(list(self.nodes().itertuples(index=False, name=None)), NODE_SCHEMA).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, features: Sequence[str]) -> Boosting:
        """The model of a written node table, whose size is the model's."""
        trees: list[Tree] = []
        for r in spark.read.schema(NODE_SCHEMA).parquet(path).orderBy("tree", "node").collect():
            if r["node"] == 0:
                trees.append(Tree())
            for name in r.asDict().keys() - {"tree", "node"}:
                getattr(trees[-1], name).append(r[name])
        return Boosting(tuple(features), tuple(trees))

    def probability(self, spark: SparkSession) -> Column:
        """Probability of class 1 of every row, also where features are null or NaN: they go the learned side."""
        shared = spark.sparkContext.broadcast(self.trees)  # bounded by rounds and depth

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(dtype=float)
            missing = np.isnan(x)
            margin = np.zeros(len(x))
            for tree in shared.value:
                margin += tree.margins(x, missing, tree.threshold)
            return pd.Series(_sigmoid(margin))

        return score(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]))

    def importance(self) -> list[tuple[str, float]]:
        """Each feature's share of the total gain."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        return list(zip(self.features, (total / (total.sum() or 1.0)).tolist()))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss by the margin, in whole parts of ``UNIT``."""
    p = _sigmoid(margin)
    return np.rint((p - y) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 increasing cuts per feature, in one pass; nulls and NaN are left out."""
    grid = F.expr(f"array({', '.join(f'{i / bins!r}D' for i in range(1, bins + 1))})")
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    found = df.agg(*[F.percentile_approx(value[f], grid, _ACCURACY).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[f"c{i}"] or [], dtype=float))[:-1] for i in range(len(features))]  # all rows are up to the last


def _binned(df: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], missing: int) -> DataFrame:
    """Blocks (n, x, y, w, margin): the bins of each feature in turn as packed numbers of one or two bytes,
    ``missing`` for null and NaN; labels as doubles; weights 1; margins 0."""
    p, kind = len(features), _kind(missing)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _joined(batches, 2 * p):
            x = np.full((p, rows.num_rows), missing, dtype=kind)
            for j in range(p):
                v = rows.column(j).to_numpy().astype(float)
                there = ~np.isnan(v)
                x[j, there] = np.searchsorted(cuts[j], v[there], side="left")
            yield _block(x, rows.column(p).to_numpy().astype(float), np.ones(rows.num_rows), np.zeros(rows.num_rows))

    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))
    return rows.filter(F.col("y").isNotNull()).mapInArrow(bins, _ROWS)


def _joined(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The batches, as many at a time as make a block of rows of ``width`` bytes."""
    most = min(_BLOCK, _BLOCK_BYTES // (width + 1))
    held, n = [], 0
    for batch in batches:
        if n and n + batch.num_rows > most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _kind(missing: int) -> type:
    return np.uint8 if missing < 256 else np.int16


def _block(x: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    parts = [pa.array([v.tobytes()], pa.binary()) for v in (x, y, w, margin)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *parts], names=["n", "x", "y", "w", "margin"])


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], columns: int, missing: int) -> Iterator[Block]:
    """Columns (column, row), labels, weights and margins of each block."""
    for batch in batches:
        for n, x, y, w, margin in zip(*batch.columns):
            held = np.frombuffer(x.as_buffer(), _kind(missing)).reshape(columns, n.as_py())
            yield held, *[np.frombuffer(v.as_buffer()) for v in (y, w, margin)]


@dataclass(frozen=True)
class _Layout:
    """Where the bins of each feature are: a digit of ``radix`` values, times ``step``, of the numbers in
    ``column``; the last digit stands for a missing value. All numbers are at most ``missing``."""

    missing: int
    column: tuple[int, ...]
    step: tuple[int, ...]
    radix: tuple[int, ...]

    @staticmethod
    def of(cuts: list[np.ndarray], missing: int) -> _Layout:
        column, step, radix, free = [], [], [len(c) + 2 for c in cuts], []  # free: the numbers each column has so far
        for r in radix:
            at = next((i for i, used in enumerate(free) if used * r <= missing + 1), len(free))
            if at == len(free):
                free.append(1)
            column.append(at)
            step.append(free[at])
            free[at] *= r
        return _Layout(missing, tuple(column), tuple(step), tuple(radix))

    @property
    def columns(self) -> int:
        return max(self.column, default=-1) + 1

    def packed(self, bins: np.ndarray) -> np.ndarray:
        """Columns (column, row) of the bins (feature, row)."""
        x = np.zeros((self.columns, bins.shape[1]), _kind(self.missing))
        for f, (c, step, radix) in enumerate(zip(self.column, self.step, self.radix)):
            x[c] += np.minimum(bins[f], radix - 1) * x.dtype.type(step)
        return x

    def digits(self, x: np.ndarray, f: int, rows: np.ndarray | slice) -> np.ndarray:
        v = x[self.column[f]][rows]
        return v if self.column.count(self.column[f]) == 1 else v // self.step[f] % self.radix[f]

    def sums(self, of_columns: np.ndarray) -> np.ndarray:
        """(node, feature, bin, 2), missing values last, from sums (2, column, node, number)."""
        nodes = of_columns.shape[2]
        out = np.zeros((nodes, len(self.column), self.missing + 1, 2), dtype=np.int64)
        for f, (c, step, radix) in enumerate(zip(self.column, self.step, self.radix)):
            own = of_columns[:, c]
            whole = (self.missing + 1) // (step * radix) * step * radix  # numbers above are not used
            own = own[:, :, :whole].reshape(2, nodes, -1, radix, step).sum(axis=(2, 4))
            out[:, f, : radix - 1], out[:, f, -1] = np.moveaxis(own[..., :-1], 0, -1), own[..., -1].T
        return out


def _distinct(blocks: DataFrame, p: int, layout: _Layout) -> DataFrame:
    """Blocks of the different rows of ``blocks``, in columns as ``layout`` says, with their numbers as weights."""
    columns, kind = layout.columns, _kind(layout.missing)
    size = columns * np.dtype(kind).itemsize

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, w, _ in _blocks(batches, p, layout.missing):
            x = np.ascontiguousarray(layout.packed(bins).T)
            offsets = np.arange(len(y) + 1, dtype=np.int32) * size
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([packed, pa.array(y), pa.array(w.astype(np.int64))], names=["x", "y", "w"])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _joined(batches, size):
            x = np.frombuffer(b"".join(held.column("x").to_pylist()), kind).reshape(-1, columns)
            y, w = held.column("y").to_numpy(), held.column("w").to_numpy()
            copies = -(-w // _MOST_WEIGHT)  # rows of too much weight stay several
            last = np.cumsum(copies) - 1
            each = np.full(copies.sum(), float(_MOST_WEIGHT))
            each[last] = w - (copies - 1) * _MOST_WEIGHT
            x, y = np.repeat(x, copies, axis=0), np.repeat(y, copies)
            for lo in range(0, len(y), _BLOCK):
                part = slice(lo, lo + _BLOCK)
                yield _block(np.ascontiguousarray(x[part].T), y[part], each[part], np.zeros(len(y[part])))

    counted = blocks.mapInArrow(rows, "x BINARY, y DOUBLE, w BIGINT").groupBy("x", "y").agg(F.sum("w").alias("w"))
    return counted.mapInArrow(weighted, _ROWS)


def _members(tree: Tree, x: np.ndarray, layout: _Layout) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(node, its rows) for the nodes of ``tree`` without children; all rows are a slice."""
    waiting: list[tuple[int, np.ndarray | slice]] = [(0, slice(None))]
    while waiting:
        node, rows = waiting.pop()
        f = tree.feature[node]
        if f < 0:
            yield node, rows
            continue
        v = layout.digits(x, f, rows)
        left = v <= tree.cut[node]  # the digit of missing values is above every cut
        if tree.missing_left[node]:
            left |= v == layout.radix[f] - 1
        if isinstance(rows, slice):
            waiting += [(tree.left[node], np.flatnonzero(left)), (tree.right[node], np.flatnonzero(~left))]
        else:
            waiting += [(tree.left[node], rows[left]), (tree.right[node], rows[~left])]


def _sums(blocks: Iterator[Block], layout: _Layout, tree: Tree, nodes: list[int]) -> np.ndarray:
    """(2, column, node, number): sums of both derivatives over the rows of each open node."""
    width = layout.missing + 1
    number = {node: i for i, node in enumerate(nodes)}
    slots = len(nodes) * width
    total = np.zeros((2, layout.columns, slots), dtype=np.int64)
    for x, y, w, margin in blocks:
        found = [(number[node], rows) for node, rows in _members(tree, x, layout) if node in number]
        if any(isinstance(rows, slice) for _, rows in found):
            inside, first = slice(None), np.zeros(len(y), dtype=np.int64)
        else:
            inside = np.concatenate([rows for _, rows in found])
            first = np.repeat([i * width for i, _ in found], [len(rows) for _, rows in found])
        both = [d * w[inside] for d in derivatives(margin[inside], y[inside])]
        for j in range(layout.columns):
            slot = first + x[j][inside]
            for k, d in enumerate(both):
                total[k, j] += np.bincount(slot, d, slots).astype(np.int64)  # whole numbers below 2^53: exact
    return total.reshape(2, layout.columns, len(nodes), width)


def _moved(block: Block, layout: _Layout, tree: Tree) -> np.ndarray:
    """The margins of a block with the leaf values of ``tree`` added."""
    x, _, _, margin = block
    after = margin.copy()
    for node, inside in _members(tree, x, layout):
        after[inside] += tree.value[node]
    return after


class _Held:
    """Rows of one process."""

    def __init__(self, blocks: list[Block], layout: _Layout):
        self.blocks, self.layout = blocks, layout

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        return _sums(iter(self.blocks), self.layout, tree, nodes)

    def add(self, tree: Tree) -> None:
        self.blocks = [(*block[:3], _moved(block, self.layout, tree)) for block in self.blocks]


class _Spread:
    """Rows of many tasks; ``path`` has their blocks, which are kept in memory and written again every few trees."""

    def __init__(self, spark: SparkSession, path: str, tasks: int, layout: _Layout):
        self.spark, self.path, self.tasks, self.layout = spark, path, tasks, layout
        self.rows, self.old, self.added = self._read().persist(), None, 0

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(self.path).repartition(self.tasks)

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        layout = self.layout
        shape = (2, layout.columns, len(nodes), layout.missing + 1)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _sums(_blocks(batches, layout.columns, layout.missing), layout, tree, nodes)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _added((v for batch in batches for v in batch.column(0)), shape)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        found = self.rows.mapInArrow(own, "sums BINARY")
        most = max(1, _SENT // (8 * math.prod(shape)))
        if self.tasks > most:
            found = found.repartition(most).mapInArrow(merged, "sums BINARY")
        out = _added(found.toArrow().column(0), shape)
        if self.old is not None:  # the tree's first pass has read it
            self.old.unpersist()
            self.old = None
        return out

    def add(self, tree: Tree) -> None:
        layout = self.layout

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, layout.columns, layout.missing):
                yield _block(*block[:3], _moved(block, layout, tree))

        self.old, self.rows = self.rows, self.rows.mapInArrow(moved, _ROWS)
        self.added += 1
        if self.added % _TREES_PER_WRITE == 0:
            old_path, self.path = self.path, fresh_path(self.spark, "margins")
            self.rows.write.parquet(self.path)
            self.rows = self._read()
            self.old.unpersist()
            self.old = None
            remove_path(self.spark, old_path)
        self.rows = self.rows.persist()

    def close(self) -> None:
        for rows in (self.rows, self.old):
            if rows is not None:
                rows.unpersist()


def _added(sums: Iterable[pa.BinaryScalar], shape: tuple[int, ...]) -> np.ndarray:
    total = np.zeros(shape, dtype=np.int64)
    for v in sums:
        total += np.frombuffer(v.as_buffer(), np.int64).reshape(shape)
    return total


def best_split(sums: np.ndarray, cuts: list[np.ndarray], shrink: float, least_cover: float):
    """The split of one node with the greatest gain: (gain, feature, cut, missing left, sums of the left side).

    ``sums`` is (feature, bin, 2), missing values in the last bin. Ties go to the first feature, the smallest
    cut, missing values to the left. None where no split gains.
    """
    whole = sums[0].sum(axis=0)
    left = sums[:, :-1].cumsum(axis=1)  # without missing values
    left = np.stack([left + sums[:, -1:], left], axis=2)  # (feature, cut, missing left or right, 2)
    right = whole - left
    score = lambda v: (v[..., 0] / UNIT) * (v[..., 0] / UNIT) / (v[..., 1] / UNIT + shrink)
    gain = score(left) + score(right) - score(whole)
    real = np.arange(left.shape[1])[None, :] < np.array([len(c) for c in cuts])[:, None]
    fits = real[:, :, None] & (left[..., 1] >= least_cover * UNIT) & (right[..., 1] >= least_cover * UNIT)
    gain = np.where(fits, gain, -np.inf)
    f, c, side = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, c, side] > LEAST_GAIN:
        return None
    return float(gain[f, c, side]), int(f), int(c), side == 0, left[f, c, side]


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 6, step: float = 0.3,
    shrink: float = 1.0, least_cover: float = 1.0, bins: int = 256,
) -> Boosting:
    """Fit ``rounds`` trees of ``depth`` levels to labels 0 and 1.

    A leaf is worth -``step`` * G / (H + ``shrink``) of its sums of derivatives; both sides of a split need
    ``least_cover`` of H. Rows with a null label are left out; rows with null or NaN features are kept, each
    split learns a side for them. Without rows, or with one class alone, all trees are leaves or shallow.
    """
    features, spark, p = list(features), df.sparkSession, len(features)
    cuts = quantile_cuts(df, features, bins)
    layout = _Layout.of(cuts, bins)
    limits = (rounds, depth, step, shrink, least_cover)
    path = fresh_path(spark, "margins")
    spread = None
    try:
        _distinct(_binned(df, features, label, cuts, bins), p, layout).write.parquet(path)
        rows = spark.read.schema(_ROWS).parquet(path)
        n = rows.agg(F.sum("n")).first()[0] or 0
        if n == 0:
            trees = _boost(_Held([], layout), cuts, *limits)
        elif n * layout.columns <= _ONE_TASK:
            trees = _boost_in_one_task(rows, layout, cuts, limits)
        else:
            tasks = max(1, min(math.ceil(n / _ROWS_PER_TASK), max(3 * spark.sparkContext.defaultParallelism, math.ceil(n / _MOST_PER_TASK))))
            spread = _Spread(spark, path, tasks, layout)
            trees = _boost(spread, cuts, *limits)
    finally:
        if spread is not None:
            spread.close()
            path = spread.path
        remove_path(spark, path)
    return Boosting(tuple(features), tuple(trees))


def _boost_in_one_task(rows: DataFrame, layout: _Layout, cuts: list[np.ndarray], limits: tuple) -> list[Tree]:
    """The trees of rows that fit into a task's memory; the driver gets the trees."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _boost(_Held(list(_blocks(batches, layout.columns, layout.missing)), layout), cuts, *limits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])

    return pickle.loads(rows.repartition(1).mapInArrow(fit, "trees BINARY").first()[0])


def _boost(
    rows: _Held | _Spread, cuts: list[np.ndarray], rounds: int, depth: int, step: float, shrink: float, least_cover: float
) -> list[Tree]:
    trees: list[Tree] = []
    while len(trees) < rounds:
        if trees:
            rows.add(trees[-1])
        trees.append(_grow(rows, cuts, depth, step, shrink, least_cover))
    return trees


def _grow(
    rows: _Held | _Spread, cuts: list[np.ndarray], depth: int, step: float, shrink: float, least_cover: float
) -> Tree:
    """One tree, level by level; each level is one pass over the rows.

    A pass sums the lighter child of every split; the sums of its sibling are what the parent's leave.
    """
    tree = Tree()
    worth = lambda v: -step * (v[0] / UNIT) / (v[1] / UNIT + shrink)
    tree.add_leaf(0.0, 0.0)
    histogram = lambda nodes: rows.layout.sums(rows.sums(tree, nodes))
    sums = {0: histogram([0])[0]}
    whole = sums[0][0].sum(axis=0)
    tree.value[0], tree.cover[0] = float(worth(whole)) if whole.any() else 0.0, float(whole[1] / UNIT)
    for level in range(1, depth + 1):
        opened = []  # (parent, lighter child, heavier child)
        for node, here in sums.items():
            found = best_split(here, cuts, shrink, least_cover)
            if found is None:
                continue
            gain, f, c, missing_left, left = found
            right = here[0].sum(axis=0) - left
            tree.feature[node], tree.cut[node], tree.threshold[node] = f, c, float(cuts[f][c])
            tree.missing_left[node], tree.gain[node] = bool(missing_left), gain
            children = [tree.add_leaf(float(worth(v)), float(v[1] / UNIT)) for v in (left, right)]
            tree.left[node], tree.right[node] = children
            opened.append((node, *sorted(children, key=lambda child: (tree.cover[child], child))))
        if level == depth or not opened:
            break
        light = histogram([child for _, child, _ in opened])
        sums = {child: own for (_, child, _), own in zip(opened, light)} | {
            other: sums[parent] - own for (parent, _, other), own in zip(opened, light)
        }
    return tree
