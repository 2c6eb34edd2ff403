"""Hard negatives by anchor-clustered shared lists: rows sorted once per cluster by an angular upper bound, walked until certified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from bidlens.llm.common import small_batches, stored, table
from bidlens.llm.vectors import matrix
from bidlens.session import broadcast_if_small

# Contract of the query: components are floor(SCALE * x); positives of an anchor, negatives of a pair, and the least
# and greatest score of a negative in percent of the positive's.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
# Rows of a block: at least LEAST_ROWS, at most MOST_ROWS, and between them as many as make BLOCKS blocks.
LEAST_ROWS, MOST_ROWS, BLOCKS = 2048, 65_536, 64
# Anchors of a cluster at most and, if a label has as many, on average at least; and anchors (by hash of the id) that
# centres are fitted on at most.
CLUSTER, LEAST_CLUSTER, SAMPLE = 256, 16, 4096
# Rows of a list that are scored at once.
STRETCH = 512
# Slack of a bound, in products of norms, above the rounding of angles.
SLACK = 1e-6


def finite(vector: Column) -> Column:
    """Whether a vector is not null and has finite components only."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def centres(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of ``k`` clusters by angle."""
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    found = units[np.random.default_rng(seed).permutation(len(units))[:k]]
    for _ in range(rounds):
        near = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-300), found)
    return found


def exact_type(left: np.ndarray, right: np.ndarray):
    """The smallest type in which no inner product of integer rows, nor a part of its sum, is rounded or overflows."""
    largest = [max(-float(x.min(initial=0)), float(x.max(initial=0))) for x in (left, right)]
    most = largest[0] * largest[1] * left.shape[1]
    return next((kind for kind, end in ((np.float32, 2**24), (np.float64, 2**53), (np.int64, 2**63)) if most < end), object)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows of one ``exact_type``; objects become 64-bit integers."""
    if left.dtype == object:
        return np.array(left @ right.T).clip(-(2**63), 2**63 - 1).astype(np.int64)
    return left @ right.T


def within(limit: np.ndarray, kind) -> np.ndarray:
    """64-bit limits in the type of the scores; one that no score can reach is cut to the least such number."""
    if kind not in (np.float32, np.float64):
        return limit
    end = 2**24 if kind is np.float32 else 2**53
    return limit.clip(-end, end).astype(kind)


def shared_list(rows: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of a cluster: numbers of ``rows`` by falling bound, and the bounds, for a member of norm 1.

    The angle of a row to a member is at least its angle to the cluster's centre less the widest angle of a
    member, so its inner product is at most norm times the cosine of that difference.
    """
    norms = np.linalg.norm(rows, axis=1)
    units = members / np.maximum(np.linalg.norm(members, axis=1, keepdims=True), 1e-300)
    centre = units.sum(axis=0)
    length = np.linalg.norm(centre)
    bounds = norms.copy()
    if length > 1e-9:
        centre = centre / length
        used = members.any(axis=1)
        widest = np.arccos(np.clip(units[used] @ centre, -1, 1)).max(initial=0.0)
        angles = np.arccos(np.clip(rows @ centre / np.maximum(norms, 1e-300), -1, 1))
        bounds = norms * np.cos(np.maximum(0.0, angles - widest))
    bounds = bounds + SLACK * norms
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


def walk(rows, ids, members, own, slot, low, high, k: int, stretch: int = STRETCH):
    """For each slot the k best rows with a score from ``low`` to ``high``, by (score, smaller id): (slot, id, score), and how many rows were scored.

    ``slot`` names the member of each slot, ``own`` the members' ids, which do not count. A slot ends when no further
    row of the list can reach its k-th best score or ``low``.
    """
    order, bounds = shared_list(rows.astype(np.float64), members.astype(np.float64))
    norms = np.linalg.norm(members.astype(np.float64), axis=1)
    kind = exact_type(rows, members)
    rows, members = rows.astype(kind), members.astype(kind)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    floor = low.copy()
    scored = 0
    for at in range(0, len(order), stretch):
        open_ = np.nonzero(norms[slot] * bounds[at] >= floor)[0]
        if not len(open_):
            break
        some = order[at : at + stretch]
        scored += len(some)
        # Open slots by member, and the widest limits of a member: few scores lie within them, and only those meet its slots.
        open_ = open_[np.argsort(slot[open_], kind="stable")]
        who, first, count = np.unique(slot[open_], return_index=True, return_counts=True)
        scores = products(rows[some], members[who])
        least, most = np.minimum.reduceat(floor[open_], first), np.maximum.reduceat(high[open_], first)
        i, m = np.nonzero((scores >= within(least, kind)) & (scores <= within(most, kind)))
        found = scores[i, m].astype(np.int64)
        times = count[m]
        i, found = np.repeat(i, times), np.repeat(found, times)
        j = open_[np.repeat(first[m] - np.cumsum(times) + times, times) + np.arange(len(i))]
        hit = (found >= floor[j]) & (found <= high[j]) & (ids[some][i] != own[slot[j]])
        if not hit.any():
            continue
        i, j, found = i[hit], j[hit], found[hit]
        s = np.concatenate([kept[0], j])
        v = np.concatenate([kept[1], ids[some][i]])
        x = np.concatenate([kept[2], found])
        by = np.lexsort([v, -x, s])
        s, v, x = s[by], v[by], x[by]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        kept = s[place < k], v[place < k], x[place < k]
        last = place == k - 1
        floor[s[last]] = np.maximum(floor[s[last]], x[last])
    return *kept, scored


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(sizes), "dim")


def _walked(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """Best rows of every slot of ``anchors`` in every block: (row_id, slot, vec_id, score).

    Blocks stay where they are dealt to; of the anchors every block gets a copy, in clusters, and takes one cluster at a
    time, so a task holds one block and one cluster.
    """
    far = 2**62
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    slots = F.col("slots") if not same else F.array(F.struct(F.lit(0).alias("slot"), F.lit(-far).alias("low"), F.lit(far).alias("high")))
    sent = anchors.select("dim", spread, F.lit(1).alias("kind"), "label", "cell", "part", "row_id", "vec_id", "vector", slots.alias("slots"))
    kind = sent.schema["slots"].dataType
    own = rows.select("dim", "block", F.lit(0).alias("kind"), "label", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("row_id"), "vec_id", "vector", F.lit(None).cast(kind).alias("slots"))
    small_batches(rows.sparkSession)
    ordered = own.unionByName(sent).repartition(max(1, blocks), "dim", "block").sortWithinPartitions("dim", "block", "kind", "label", "cell", "part", "row_id")
    names = ["row_id", "slot", "vec_id", "score"]

    def answers(block, cluster):
        labels, ids, vectors = block
        mine = labels == cluster["label"][0]
        mine = mine if same else ~mine
        if not mine.any():
            return
        members = np.concatenate(cluster["vectors"])
        lists = cluster["slots"]
        slot = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        low, high = (np.array([s[c] for x in lists for s in x], np.int64) for c in ("low", "high"))
        number = np.array([s["slot"] for x in lists for s in x], np.int64)
        own_ids = np.array(cluster["vec_id"], np.int64)
        s, v, x, _ = walk(vectors[mine], ids[mine], members, own_ids, slot, low, high, k)
        row_ids = np.array(cluster["row_id"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(row_ids[slot[s]]), pa.array(number[s].astype(np.int32)), pa.array(v), pa.array(x)], names=names)

    def run(batches):
        at, held, block, cluster, key = None, [], None, None, None
        for batch in batches:
            marks = list(zip(*[batch.column(c).to_pylist() for c in ("dim", "block", "kind", "label", "cell", "part")]))
            starts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for a, b in zip(starts, starts[1:]):
                run_, mark = batch.slice(a, b - a), marks[a]
                vectors = matrix_of(run_.column("vector"), mark[0])
                if mark != key and cluster:
                    yield from answers(block, cluster)
                    cluster = None
                if mark[:2] != at:
                    at, held, block = mark[:2], [], None
                if mark[2] == 0:
                    held.append((np.array([mark[3]] * (b - a), object), run_.column("vec_id").to_numpy(), vectors))
                else:
                    if block is None and held:
                        block = tuple(np.concatenate(c) for c in zip(*held))
                    if block is not None:
                        if cluster is None:
                            cluster = {"label": [], "vec_id": [], "row_id": [], "slots": [], "vectors": []}
                        cluster["vectors"].append(vectors)
                        for c, values in (("label", [mark[3]] * (b - a)), *((c, run_.column(c).to_pylist()) for c in ("vec_id", "row_id", "slots"))):
                            cluster[c].extend(values)
                key = mark
        if cluster:
            yield from answers(block, cluster)

    schema = StructType([StructField(n, IntegerType() if n == "slot" else LongType()) for n in names])
    return ordered.mapInArrow(run, schema)


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _clustered(anchors: DataFrame) -> DataFrame:
    """``anchors`` with ``cell``, the nearest centre, and ``part``, which splits large cells.

    A cluster is a cell of one label, so there are fewer centres where there are many labels: every block sorts its rows
    for every cluster, however small.
    """
    n = max(1, anchors.count())
    share = min(1.0, SAMPLE / n)
    draw = F.pmod(F.xxhash64("row_id"), F.lit(1_000_000)) < int(1_000_000 * share)
    found: dict[int, list] = {}
    labels: dict[int, set] = {}
    for r in anchors.where(draw).select("dim", "label", "vector").limit(2 * SAMPLE).collect():
        found.setdefault(r["dim"], []).append(r["vector"])
        labels.setdefault(r["dim"], set()).add(r["label"])
    cells = {}
    for d, v in found.items():
        k = min(len(v) / LEAST_CLUSTER, len(v) / share / (LEAST_CLUSTER * len(labels[d])))
        cells[d] = centres(np.array(v, np.float64).reshape(len(v), d), max(1, int(k)))
    shared = anchors.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                if d in shared.value:
                    vectors = matrix(batch.column("vector").take(pa.array(at))).reshape(len(at), d)
                    cell[at] = (vectors @ shared.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    near = stored(anchors.mapInArrow(run, StructType([*anchors.schema.fields, StructField("cell", IntegerType())])), "negatives-cells")
    sizes = near.groupBy("dim", "label", "cell").agg(F.ceil(F.count("*") / CLUSTER).cast("int").alias("parts"))
    return near.join(sizes, ["dim", "label", "cell"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).drop("parts")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, vector of integers).

    Rows where ``anchor`` holds are anchors. Scores are integer inner products and must fit 64 bits. An anchor's positives are
    its best other rows of the same label; the negatives of a pair are the best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's; ties go to the smaller vec_id. Rows with a null id, label, vector or component take no
    part, vectors of different lengths do not meet, and rows of the anchor's own id are never its partners. Repeated rows count
    one by one, as anchors too. A zero vector scores 0. An anchor without positives, and an empty table, give no rows.
    """
    valid = rows.where("vec_id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull()))
    valid = valid.select("vec_id", F.col("label").cast("string").alias("label"), "vector", F.size("vector").alias("dim"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    held = stored(valid.withColumn("row_id", F.monotonically_increasing_id()), "negatives-rows")
    fit = F.greatest(F.lit(1.0), F.least(F.ceil(F.col("n") / LEAST_ROWS), F.greatest(F.ceil(F.col("n") / MOST_ROWS), F.lit(BLOCKS))))
    sizes = stored(held.groupBy("dim").agg(F.count("*").alias("n")).select("dim", fit.cast("int").alias("blocks")), "negatives-sizes")
    blocks = sizes.agg(F.sum("blocks")).first()[0] or 1
    dealt = _dealt(held, sizes).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    anchors = stored(_dealt(_clustered(held.where("is_anchor").drop("is_anchor")), sizes), "negatives-anchors")

    near = _walked(dealt, anchors, blocks, True, positives)
    turn = Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id")
    best = stored(near.withColumn("slot", F.row_number().over(turn)).where(F.col("slot") <= positives), "negatives-positives")
    # In decimals, which hold any such product.
    least, most = (F.expr(f"cast({f}(cast(score as decimal(20, 0)) * {int(p)} / 100) as bigint)") for f, p in (("ceil", low), ("floor", high)))
    slots = best.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("slot", least.alias("low"), most.alias("high")))).alias("slots"))
    pairs = _walked(dealt, anchors.join(slots, "row_id"), blocks, False, negatives)
    turn = Window.partitionBy("row_id", "slot").orderBy(F.desc("score"), "vec_id")
    found = pairs.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= negatives)
    found = found.select("row_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pair = best.select("row_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pair, ["row_id", "slot"]).join(anchors.select("row_id", F.col("vec_id").alias("anchor_id")), "row_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding"))).select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
with rows_ as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
  from rows_ a join rows_ b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""
