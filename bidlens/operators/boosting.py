"""Boosted regression trees for many rows with many features that are mostly zero.

Spark's learner keeps a number per row and feature and reads all of them for every level of every tree. Here a row is
kept as the entries whose bin is not that of zero, in stored blocks, and the bin of zero is what a node has beyond
them. Bins, gains and stopping rules are those of Spark's learner, and the model is Spark's.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.session import fresh_path, stored

# A block of rows ends at so many rows or, read in pieces of so many rows, at about so many entries.
BLOCK_ROWS, PIECE_ROWS, BLOCK_ENTRIES = 4096, 512, 2**19
# Blocks that go to a worker at once.
BLOCKS_AT_ONCE = 16
# Thresholds are fitted by tasks of so many features each, about.
FEATURES_A_GROUP = 32
# Gains that differ by a smaller share differ by rounding only: the first feature counts.
SAME_GAIN = 1e-9


@dataclass
class Bins:
    """Thresholds of all features in a row, where those of each feature start, and the bin of zero of each."""

    thresholds: np.ndarray
    starts: np.ndarray
    zero: np.ndarray

    @staticmethod
    def of(found: dict[int, list[float]], size: int) -> Bins:
        each = [np.asarray(found.get(f, []), dtype=float) for f in range(size)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in each])]).astype(np.int64)
        return Bins(np.concatenate([*each, []]), starts, np.array([np.searchsorted(t, 0.0) for t in each], dtype=np.int64))

    def edges(self) -> np.ndarray:
        """Where the bins of each feature start; a feature has one more of them than thresholds."""
        return self.starts + np.arange(len(self.starts))

    def binned(self, feature: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bins of values that are ordered by feature: the number of smaller thresholds."""
        counts = np.diff(self.starts)
        first = self.thresholds[np.minimum(self.starts[:-1], len(self.thresholds) - 1)] if len(self.thresholds) else np.zeros(len(counts))
        bins = ((values > first[feature]) & (counts[feature] > 0)).astype(np.int64)
        cuts = np.searchsorted(feature, np.arange(len(counts) + 1))
        for f in np.flatnonzero((counts > 1) & (np.diff(cuts) > 0)):
            mine = slice(cuts[f], cuts[f + 1])
            bins[mine] = np.searchsorted(self.thresholds[self.starts[f] : self.starts[f + 1]], values[mine])
        return bins


@dataclass
class Tree:
    """Nodes by number, children after their parents.

    Split feature (-1 for a leaf) and bin, gain, child to the left (the other is the next), and (rows, sum, sum of squares).
    """

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)

    def add(self, stats: np.ndarray) -> int:
        for held, new in ((self.feature, -1), (self.bin, 0), (self.gain, 0.0), (self.left, 0), (self.stats, stats)):
            held.append(new)
        return len(self.feature) - 1

    def values(self) -> np.ndarray:
        return np.array([s[1] / s[0] for s in self.stats])


@dataclass
class Block:
    """Labels of some rows and, ordered by feature, entries (row, bin) whose bin is not that of zero."""

    labels: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    bins: np.ndarray

    NAMES = ["number", "labels", "starts", "rows", "bins"]
    KINDS = (np.float64, np.int32, np.uint16, np.uint16)
    SCHEMA = "number long, labels binary, starts binary, rows binary, bins binary"

    def packed(self, number: int) -> pa.RecordBatch:
        parts = [np.ascontiguousarray(a, dtype=t).tobytes() for a, t in zip((self.labels, self.starts, self.rows, self.bins), self.KINDS)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=self.NAMES)

    @staticmethod
    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
        """Numbers and blocks of a batch; the blocks are views of it."""
        views = []
        for column, kind in zip(batch.columns[1:], Block.KINDS):
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
            views.append([np.frombuffer(data, kind, (to - at) // np.dtype(kind).itemsize, at) if to > at else np.zeros(0, kind) for at, to in zip(ends.tolist(), ends[1:].tolist())])
        for number, *parts in zip(batch.column(0).to_pylist(), *views):
            yield number, Block(*parts)


def entries_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of what a batch of (features, label) holds, zeros left out, and the labels."""
    vectors, labels = batch.column(0), batch.column(1)
    if vectors.null_count or labels.null_count:
        raise ValueError("features and labels must not be null")
    kind, _, indices, values = vectors.flatten()
    counts = values.value_lengths().to_numpy(zero_copy_only=False)
    value, sparse = values.flatten().to_numpy(zero_copy_only=False), kind.to_numpy() == 0
    label = labels.to_numpy(zero_copy_only=False).astype(np.float64)
    if not (np.isfinite(value).all() and np.isfinite(label).all()):
        raise ValueError("features and labels must be finite")
    row = np.repeat(np.arange(len(counts)), counts)
    # A dense vector has a value for each feature in turn and no indices.
    feature = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    feature[sparse[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    some = value != 0
    return row[some], feature[some], value[some], label


def thresholds(values: np.ndarray, counts: np.ndarray, rows: int, most: int) -> list[float]:
    """At most about ``most`` thresholds between values that are not zero and come ``counts`` times in ``rows`` rows."""
    order = np.argsort(values)
    values, counts = values[order], counts[order].astype(float)
    zeros = rows - counts.sum()
    if zeros > 0:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between.tolist()
    # A threshold stands where the count so far is nearest to a multiple of the stride.
    found, stride, so_far = [], rows / (most + 1), counts[0]
    target = stride
    for i in range(1, len(values)):
        before, so_far = so_far, so_far + counts[i]
        if abs(before - target) < abs(so_far - target):
            found.append(float(between[i - 1]))
            target += stride
    return found


def fitted_bins(train: DataFrame, size: int, rows: int, pairs: set[int], bins: int, seed: int) -> Bins:
    """Bins from about as many rows as Spark's learner looks at, max(10,000, bins squared); features of ``pairs`` have two values."""
    most, wanted = min(bins, rows) - 1, max(bins * bins, 10_000)
    looked = train.sample(False, wanted / rows, seed) if wanted < rows else train

    def counted(batches):
        for batch in batches:
            _, feature, value, label = entries_of(batch)
            pair, n = np.unique(np.rec.fromarrays([feature, value], names="f,v"), return_counts=True)
            columns = [np.append(pair.f, -1), np.append(pair.v, 0.0), np.append(n, len(label))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["feature", "value", "n"])

    held = stored(looked.mapInArrow(counted, "feature long, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")), "tree-values")
    sampled = held.where("feature = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def fit(group):
        feature, value, n = (group.column(c).to_numpy() for c in ("feature", "value", "n"))
        each = {int(f): thresholds(value[feature == f], n[feature == f], sampled, most) for f in np.unique(feature)}
        return pa.table({"feature": pa.array(list(each), pa.int64()), "found": pa.array(list(each.values()), pa.list_(pa.float64()))})

    groups = F.pmod("feature", F.lit(-(-size // FEATURES_A_GROUP))).alias("group")
    found = held.where("feature >= 0").groupBy(groups).applyInArrow(fit, "feature long, found array<double>").collect()
    return Bins.of({r.feature: r.found for r in found} | {f: [0.5] for f in pairs}, size)


def stored_blocks(train: DataFrame, bins: Bins) -> DataFrame:
    """(features, label) as blocks of entries, each written once to the shared folder."""
    size = len(bins.zero)

    def block(pieces) -> Block:
        starts = np.cumsum([0, *(len(p[3]) for p in pieces)])
        row = np.concatenate([p[0] + s for p, s in zip(pieces, starts)])
        feature, value = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
        order = np.argsort(feature.astype(np.uint16) if size < 2**16 else feature, kind="stable")
        row, feature, value = row[order], feature[order], value[order]
        bin = bins.binned(feature, value)
        kept = bin != bins.zero[feature]
        return Block(np.concatenate([p[3] for p in pieces]), np.searchsorted(feature[kept], np.arange(size + 1)), row[kept], bin[kept])

    def pack(batches):
        number, pieces = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                pieces.append(entries_of(batch.slice(at, PIECE_ROWS)))
                if sum(len(p[3]) for p in pieces) > BLOCK_ROWS - PIECE_ROWS or sum(len(p[0]) for p in pieces) >= BLOCK_ENTRIES:
                    yield block(pieces).packed(number)
                    number, pieces = number + 1, []
        if pieces:
            yield block(pieces).packed(number)

    path = fresh_path(train.sparkSession, "tree-blocks")
    # Several files of a task, so that all cores read what few tasks wrote.
    train.mapInArrow(pack, Block.SCHEMA).write.option("maxRecordsPerFile", BLOCKS_AT_ONCE).parquet(path)
    return train.sparkSession.read.schema(Block.SCHEMA).parquet(path)


def router(trees: list[Tree], bins: Bins):
    """A function of a block that returns, for each of ``trees``, the leaf of each row, so far.

    What a split asks is answered once per block, however many nodes ask it. A row at a leaf asks a question that all
    answer with no, and stays.
    """
    asked = sorted({(f, b) for t in trees for f, b in zip(t.feature, t.bin) if f >= 0})
    number = {q: i + 1 for i, q in enumerate(asked)}
    ways = []
    for t in trees:
        question = np.array([number[f, b] if f >= 0 else 0 for f, b in zip(t.feature, t.bin)])
        after = np.array([n if f >= 0 else i for i, (f, n) in enumerate(zip(t.feature, t.left))])
        depth = [0] * len(t.left)
        for i, n in enumerate(t.left):
            if t.feature[i] >= 0:
                depth[n] = depth[n + 1] = depth[i] + 1
        ways.append((question, after, max(depth)))

    def reached(block: Block) -> list[np.ndarray]:
        rows = np.arange(len(block.labels))
        answers = np.zeros((len(asked) + 1, len(rows)), dtype=np.int8)
        for i, (f, b) in enumerate(asked, 1):
            entries = slice(block.starts[f], block.starts[f + 1])
            if bins.zero[f] > b:
                answers[i] = 1
            answers[i, block.rows[entries]] = block.bins[entries] > b
        flat, found = answers.ravel(), []
        for question, after, depth in ways:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                at = after[at] + flat[question[at] * len(rows) + rows]
            found.append(at)
        return found

    return reached


def histograms(blocks: DataFrame, bins: Bins, trees: list[Tree], weights: list[float], tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
    """For each of ``nodes`` of ``tree``: rows, sums and sums of squares of what the trees before leave, in all and by bin.

    A node's array is (3, 1 + bins of all features). The bin of zero is not counted. Each task adds up its blocks, and the
    sums of the tasks are added per node.
    """
    edges, reached, values = bins.edges(), router([*trees, tree], bins), [t.values() for t in trees]
    width = int(edges[-1]) + 1
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes)) * width

    def count(batches):
        total, first = np.zeros((3, len(nodes) * width)), -1
        for batch in batches:
            for number, block in Block.unpacked(batch):
                first = number if first < 0 else min(first, number)
                *leaves, node = reached(block)
                rest = block.labels
                if trees:
                    rest = 2 * (rest - sum(w * v[leaf] for w, v, leaf in zip(weights, values, leaves)))
                base = place[node]
                row, entry = block.rows.astype(np.int64), np.repeat((edges[:-1] + 1).astype(np.int32), np.diff(block.starts)) + block.bins
                counted = base >= 0
                if not counted.all():
                    some = np.flatnonzero(counted[row])
                    row, entry = row[some], entry[some]
                at, label = np.concatenate([base[counted], entry + base[row]]), np.concatenate([rest[counted], rest[row]])
                total[0] += np.bincount(at, minlength=total.shape[1])
                total[1] += np.bincount(at, label, total.shape[1])
                total[2] += np.bincount(at, label * label, total.shape[1])
        if first >= 0:
            each = total.reshape(3, -1, width)
            data = [each[:, i].tobytes() for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([first] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["node", "first", "data"])

    def add(key, group):
        # In a fixed order, as sums of floats depend on it.
        total = sum(np.frombuffer(d, np.float64) for _, d in sorted(zip(group["first"].to_pylist(), group["data"].to_pylist())))
        return pa.table({"node": key, "data": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.mapInArrow(count, "node long, first long, data binary").groupBy("node").applyInArrow(add, "node long, data binary")
    return {r.node: np.frombuffer(r.data, np.float64).reshape(3, width).copy() for r in sums.collect()}


def impurity(stats: np.ndarray) -> np.ndarray:
    """Variance of (rows, sum, sum of squares), 0 without rows."""
    n = np.maximum(stats[0], 1)
    return np.maximum((stats[2] - stats[1] ** 2 / n) / n, 0.0)


def parted(stats: np.ndarray) -> bool:
    """Whether labels of a node differ by more than rounding."""
    return stats[0] > 1 and bool(impurity(stats) > SAME_GAIN * stats[2] / stats[0])


def best_split(held: np.ndarray, bins: Bins, fewest: int, least: float):
    """(feature, bin, gain, stats of the left and of the right child) of the best split of a node, or None."""
    whole, counts = held[:, 0], np.diff(bins.edges())
    if counts.max(initial=1) < 2 or not parted(whole):
        return None
    inside = np.arange(counts.max()) < counts[:, None]
    each = np.zeros((3, *inside.shape))
    each[:, inside] = held[:, 1:]
    every = np.arange(len(counts))
    each[:, every, bins.zero] = whole[:, None] - each.sum(axis=2)
    left = each.cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    gain = impurity(whole) - (left[0] * impurity(left) + right[0] * impurity(right)) / whole[0]
    valid = inside[:, 1:] & (left[0] >= fewest) & (right[0] >= fewest) & (gain >= least)
    gain = np.where(valid, gain, -1.0)
    best = gain.max()
    if best <= SAME_GAIN * impurity(whole):
        return None
    f, b = np.unravel_index(np.argmax(gain >= best * (1 - SAME_GAIN)), gain.shape)
    return int(f), int(b), float(gain[f, b]), left[:, f, b], right[:, f, b]


@contextlib.contextmanager
def few_blocks_at_once(spark: SparkSession):
    """Workers get few blocks in one Arrow batch while this holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BLOCKS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class SparseGBT(GBTRegressor):
    """Spark's boosted trees, learnt from blocks of entries where the rows are more than ``part_bytes`` when binned.

    Fewer rows, and settings or features of kinds that blocks do not know, go to Spark's learner.
    """

    part_bytes = 0

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        train = dataset.select(features, F.col(label).cast("double"))
        first = train.select(features).first()
        rows = train.count()
        size = first[0].size if first and first[0] else 0
        kinds = train.schema[0].metadata.get("ml_attr", {}).get("attrs", {})
        usual = {"subsamplingRate": 1.0, "lossType": "squared", "featureSubsetStrategy": "all", "minWeightFractionPerNode": 0.0}
        plain = all(self.getOrDefault(p) == v for p, v in usual.items()) and not self.isSet("weightCol") and not self.isSet("validationIndicatorCol")
        if 4 * size * rows <= self.part_bytes or not plain or "nominal" in kinds or self.getMaxBins() > 2**16:
            return super()._fit(dataset)
        pairs = {a["idx"] for a in kinds.get("binary", [])}
        bins = fitted_bins(train, size, rows, pairs, self.getMaxBins(), self.getOrDefault("seed"))
        blocks = stored_blocks(train, bins)
        trees, weights = [], []
        with few_blocks_at_once(train.sparkSession):
            for _ in range(self.getMaxIter()):
                trees.append(self._grown(blocks, bins, trees, weights))
                weights.append(self.getStepSize() if weights else 1.0)
                # The jobs of a tree leave garbage by which the driver's heap would grow to its limit.
                train.sparkSession.sparkContext._jvm.System.gc()
        return self._copyValues(GBTRegressionModel(self._java_model(train.sparkSession, trees, weights, bins)))

    def _grown(self, blocks: DataFrame, bins: Bins, trees: list[Tree], weights: list[float]) -> Tree:
        """One more tree, level by level; a job counts as many nodes as the learner's memory holds.

        Of two children the smaller is counted, and the other has what is left of their parent.
        """
        tree, most = Tree(), max(1, self.getMaxMemoryInMB() * 2**20 // (24 * int(bins.edges()[-1])))

        def counted(nodes: list[int]):
            for at in range(0, len(nodes), most):
                yield from histograms(blocks, bins, trees, weights, tree, nodes[at : at + most]).items()

        root = tree.add(np.zeros(3))
        held = dict(counted([root]))
        tree.stats[root] = held[root][:, 0]
        for depth in range(self.getMaxDepth()):
            splits = {n: best_split(h, bins, self.getMinInstancesPerNode(), self.getMinInfoGain()) for n, h in held.items()}
            pairs = []
            for node, split in sorted(splits.items()):
                if split:
                    tree.feature[node], tree.bin[node], tree.gain[node], left, right = split
                    tree.left[node] = tree.add(left)
                    pairs.append((node, tree.left[node], tree.add(right)))
            pairs = [p for p in pairs if parted(tree.stats[p[1]]) or parted(tree.stats[p[2]])]
            if not pairs or depth + 1 == self.getMaxDepth():
                break
            smaller = {min(p[1:], key=lambda n: tree.stats[n][0]): p for p in pairs}
            below = {}
            for node, sums in counted(sorted(smaller)):
                parent, left, right = smaller[node]
                below[node], below[left + right - node] = sums, held[parent] - sums
            held = {n: h for n, h in below.items() if parted(tree.stats[n])}
        return tree

    def _java_model(self, spark: SparkSession, trees: list[Tree], weights: list[float], bins: Bins):
        """The trees as Spark's own model, by constructors that it does not document."""
        gateway = spark.sparkContext._gateway
        ml, mllib = gateway.jvm.org.apache.spark.ml, gateway.jvm.org.apache.spark.mllib
        learnt = ml.regression.DecisionTreeRegressionModel

        def array(kind, values):
            made = gateway.new_array(kind, len(values))
            for i, v in enumerate(values):
                made[i] = v
            return made

        def model(number: int, tree: Tree):
            nodes = {}
            for n in reversed(range(len(tree.feature))):
                stats, f = tree.stats[n], tree.feature[n]
                known = mllib.tree.impurity.VarianceCalculator(array(gateway.jvm.double, stats.tolist()), int(stats[0]))
                value, spread = float(stats[1] / stats[0]), float(impurity(stats))
                if f < 0:
                    nodes[n] = ml.tree.LeafNode(value, spread, known)
                else:
                    split = ml.tree.ContinuousSplit(f, float(bins.thresholds[bins.starts[f] + tree.bin[n]]))
                    nodes[n] = ml.tree.InternalNode(value, spread, tree.gain[n], nodes[tree.left[n]], nodes[tree.left[n] + 1], split, known)
            return learnt(f"{self.uid}_tree{number}", nodes[0], len(bins.zero))

        made = array(learnt, [model(i, t) for i, t in enumerate(trees)])
        return ml.regression.GBTRegressionModel(self.uid, made, array(gateway.jvm.double, weights), len(bins.zero))
