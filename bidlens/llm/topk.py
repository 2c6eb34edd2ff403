"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Every vector component is a posting of its dimension; postings of a block of vectors are kept in segments of
equal quantised impact. A batch of queries takes the segments by descending impact, stops once bounds prove
that no other vector can enter its top k, and scores the possible members exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from bidlens.llm.common import small_batches, stored, table
from bidlens.llm.vectors import matrix, usable

# Vectors in a block of the index and queries in a batch, about.
BLOCK = 4096
BATCH = 256
# Width of a level of impact.
STEP = 8
# The proof is tried after each of so many parts of the levels.
PROOFS = 4
# Batches of queries that meet a block in one group, at most.
GROUP = 16


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


def build_block(rows: np.ndarray, step: int = STEP):
    """Segments of a block: origin and number of levels by dimension, members by ascending level, and where levels start."""
    low = rows.min(axis=0)
    level = (rows - low) // step
    span = level.max(axis=0)
    order = np.argsort(level, axis=0, kind="stable").astype(np.int32).T
    starts = np.arange(int(span.max()) + 2)
    cuts = np.stack([np.searchsorted(level[order[d], d], starts) for d in range(rows.shape[1])]).astype(np.int32)
    return low, span, order, cuts


def narrow(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest of three kinds that holds them, so that less is shuffled."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def widened(data: bytes, *shape: int) -> np.ndarray:
    """The array of this shape that ``narrow`` made small."""
    return np.frombuffer(data, f"i{len(data) // (shape[0] * shape[1])}").reshape(shape).astype(np.int64)


def search_block(rows, ids, index, queries, own, k: int, step: int = STEP):
    """For each query the k best of the block by (score, smaller id): arrays of query number, id and score.

    Rows with the query's own id take no part. Impacts are lower ends of levels, taken from the top for
    positive weights and from the bottom for negative ones, so that all contributions are non-negative.
    """
    low, span, order, cuts = index
    n, dims = rows.shape
    up, down = np.maximum(queries, 0).T, np.maximum(-queries, 0).T
    weight = (up + down).sum(axis=0)
    levels = int(span.max()) + 1
    # Sums of whole numbers stay exact in single precision up to 2 ** 24, in double up to 2 ** 53.
    kind = np.float32 if levels * step * int(weight.max(initial=0)) < 2**24 else np.float64
    up, down, weight = up.astype(kind), down.astype(kind), weight.astype(kind)
    level = (rows - low) // step
    done = np.zeros((n, len(queries)), dtype=kind)
    other = ids[:, None] != own[None, :]
    for at in range(levels - 1, -1, -1):
        for d in range(dims):
            if at <= span[d]:
                for w, of in ((up[d], at), (down[d], span[d] - at)):
                    members = order[d, cuts[d, of] : cuts[d, of + 1]]
                    if len(members):
                        done[members] += (at * step) * w
        if at == 0 or (levels - at) % max(1, levels // PROOFS) == 0:
            # A seen posting may hold step - 1 more; an unseen one lies below this level.
            seen = (level >= at).astype(kind) @ up + (span - level >= at).astype(kind) @ down
            upper = done + (step - 1) * seen + max(0, at * step - 1) * (weight - seen)
            lower = np.where(other, done, -1)
            floor = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(queries), -1, dtype=kind)
            possible = (upper >= floor) & other
            if at == 0 or possible.sum() <= 4 * k * len(queries):
                break
    who, row = np.nonzero(possible.T)
    exact = np.einsum("ij,ij->i", queries[who], rows[row])
    best = np.lexsort((ids[row], -exact, who))
    who, row, exact = who[best], row[best], exact[best]
    first = np.searchsorted(who, np.arange(len(queries)))
    kept = np.arange(len(who)) - first[who] < k
    return who[kept], ids[row[kept]], exact[kept]


INDEX = ["block", "ids", "vectors", "low", "span", "members", "cuts"]
QUERIES = ["batch", "asked_ids", "asked"]


def struct(names: list[str]) -> StructType:
    fields = [StructField(c, IntegerType() if i == 0 else BinaryType()) for i, c in enumerate(names)]
    return StructType([StructField("dims", IntegerType()), *fields])


def packed(names: list[str], key, *arrays: np.ndarray) -> pa.Table:
    """One row (dims, part, arrays as bytes)."""
    kinds = pa.schema([("dims", pa.int32()), (names[0], pa.int32()), *((c, pa.binary()) for c in names[1:])])
    values = [[key[0].as_py()], [key[1].as_py()], *([np.ascontiguousarray(a).tobytes()] for a in arrays)]
    return pa.table(values, schema=kinds)


def top_k(base: DataFrame, queries: DataFrame, k: int, scale: int = 256, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    ``base`` and ``queries`` have (vec_id, embedding); components become floor(scale * x). Ties go to the
    smaller vec_id; rows with the query's id are not its candidates. Vectors that are null, empty or hold
    null or non-finite components, rows without vec_id, and vectors of another length than the query take
    no part. A repeated candidate row counts each time (more than k copies cannot show); a query repeated with the same vector counts once,
    and of different vectors under one id each row is searched and the best k of all are kept.

    Blocks of the index and batches of queries are dealt by hash, so that no group grows with the input; each meets
    each once, as every query must see every vector. A block meets ``GROUP`` batches at a time and is sent once for
    them; both sides are shuffled, as the batches once per block are too much for the driver to broadcast. A block
    returns k rows per query at most.
    """
    small_batches(base.sparkSession)
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    counted = base.where(good).groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = copies.select("vec_id", "embedding", "copy", F.size("embedding").alias("dims"))
    asked = queries.where(good).select("vec_id", "embedding", F.lit(1).alias("copy"), F.size("embedding").alias("dims")).distinct()
    blocks, batches = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // batch))

    def parted(df: DataFrame, part: str, parts: int):
        return df.withColumn(part, F.pmod(F.xxhash64("vec_id", "embedding", "copy"), F.lit(parts)).cast("int")).groupBy("dims", part)

    def index_block(key, group):
        values, ids = quantised(matrix(group["embedding"]), scale), group["vec_id"].to_numpy().astype(np.int64)
        low, span, order, cuts = build_block(values)
        return packed(INDEX, key, ids, narrow(values), low, span, narrow(order), cuts)

    def batch_up(key, group):
        return packed(QUERIES, key, group["vec_id"].to_numpy().astype(np.int64), narrow(quantised(matrix(group["embedding"]), scale)))

    index = stored(parted(rows, "block", blocks).applyInArrow(index_block, struct(INDEX)), "impact-index")
    batched = stored(parted(asked, "batch", batches).applyInArrow(batch_up, struct(QUERIES)), "query-batches")
    out = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType())])

    def search(key, held, sought):
        found = [np.zeros((0, 3), np.int64)]
        for r in held.select(INDEX[1:]).to_pylist():
            dims = key[0].as_py()
            ids, low, span = (np.frombuffer(r[c], np.int64) for c in ("ids", "low", "span"))
            vectors, order = widened(r["vectors"], len(ids), dims), widened(r["members"], dims, len(ids))
            cuts = np.frombuffer(r["cuts"], np.int32).reshape(dims, -1)
            for q in sought.select(QUERIES[1:]).to_pylist():
                own = np.frombuffer(q["asked_ids"], np.int64)
                who, member, score = search_block(vectors, ids, (low, span, order, cuts), widened(q["asked"], len(own), dims), own, k)
                found.append(np.stack([own[who], member, score], axis=1))
        return pa.table(list(np.concatenate(found).T.copy()), names=out.names)

    every, groups = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit((batches - 1) // GROUP))
    held = index.withColumn("group", F.explode(groups))
    sought = batched.withColumn("group", F.expr(f"batch div {GROUP}").cast("int")).withColumn("block", F.explode(every))
    best = held.groupBy("dims", "block", "group").cogroup(sought.groupBy("dims", "block", "group")).applyInArrow(search, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP6_SQL = """
with v as (
    select vec_id, list_transform(embedding, x -> floor(256 * cast(x as double))) as e
    from embeddings
    where embedding is not null and vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
    where q.vec_id % 50 = 0
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
