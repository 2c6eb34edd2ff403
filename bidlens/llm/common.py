"""Helpers shared by the operators: tables, stored steps, Arrow columns and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bidlens.session import stored

# Rows of one Arrow batch at most.
BATCH_ROWS = 250
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of one Arrow batch, as texts may be long; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return the memory of a worker that it no longer needs; a worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the worker gives back memory."""

    @functools.wraps(run)
    def wrapped(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def settled(make: Callable, *args) -> pa.Table:
    """The result of ``make`` for one group, after which the worker gives back memory."""
    out = make(*args)
    give_back()
    return out


def set_aside(df: DataFrame, names: list[str], text: str) -> DataFrame:
    """(row, text): a struct of the columns ``names`` but ``text`` under numbers, whatever their names, and the text beside it."""
    parts = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    return df.select(F.struct(F.lit(1).alias("n"), *parts).alias("row"), F.col(f"`{text}`").alias("text"))


def put_back(names: list[str], text: str) -> list[Column]:
    """The columns ``names`` of a table made by ``set_aside``."""
    return [F.col("text").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]


def add_columns(df: DataFrame, inputs: list[str], outputs: list[StructField], make: Callable) -> DataFrame:
    """Append columns computed by ``make(*arrow arrays) -> arrow arrays``; columns of the same name are replaced.

    An input that stays in the result goes to the worker once.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in outputs}
    kept = [c for c in df.columns if c.lower() not in new]
    n = len(kept)
    place = {c: i for i, c in enumerate(kept)}
    extra = [c for c in dict.fromkeys(inputs) if c not in place]
    place |= {c: n + i for i, c in enumerate(extra)}
    mark = "__in_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    base = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"{mark}{i}") for i, c in enumerate(extra)])
    names = [*kept, *(f.name for f in outputs)]
    used = [place[c] for c in inputs]

    def run(batches):
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:n], *make(*(columns[i] for i in used))], names=names)

    return base.mapInArrow(trimmed(run), StructType([*base.schema.fields[:n], *outputs]))


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of undirected ``edges`` (a, b) as rows (node, root); the root is the smallest node.

    Alternates two star contractions until no edge changes; every round is a minimum per node (combined
    map-side) and joins against it, stored in the shared folder. No node's neighbours are gathered.
    Edges with a null end are ignored. Nodes without an edge to another node are not returned.
    """
    clean = edges.select("a", "b").where("a <> b")
    now = stored(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not now.isEmpty():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours of each node go to the smallest of its neighbourhood.
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(large.where("a <> b").distinct(), name)
        # Then each node and its smaller neighbours go to the smallest of them.
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(least, "a")
        small = rest.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct(), name)
        stars = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        once = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() if stars else False
        now = after
        if stars and once:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def text_of(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")

