"""Temperature mixing of sources to target weights, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidlens.llm.common import stored, table
from bidlens.session import broadcast_if_small

# Production parameters of the query: share of the greatest entropy, and passes over a source at most.
ENTROPY_SHARE = 0.95
REPEATS = 4.0
# Passes at most in the pipeline, where every source is seen once at least.
PIPELINE_REPEATS = 1.5
# Tokens of a block of documents, about.
BLOCK_TOKENS = 1_000_000
# Parts into which one job cuts the range of the exponent, and jobs.
PARTS, ROUNDS = 32, 6
# A source without name goes under this one.
UNNAMED = "\x00"


@dataclass
class Mixture:
    """Exponent, budget in tokens, and the sources' (name, tokens, share, weight, epochs)."""

    exponent: float
    budget: float
    sources: DataFrame


def word_count(text: Column) -> Column:
    """Words of the whole text: runs of other characters than spaces, tabs and a line's end characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _curves(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, natural logarithm; sum of powered shares) for each exponent, in one job."""
    power = [F.pow("share", F.lit(a)) for a in exponents]
    row = sources.agg(*[F.sum(p) for p in power], *[F.sum(p * F.log("share")) for p in power]).first()
    n = len(exponents)
    return [(math.log(z) - a * s / z, z) for a, z, s in zip(exponents, row[:n], row[n:])]


def least_exponent(sources: DataFrame, fits) -> float:
    """Smallest exponent from 0 to 1 with ``fits(exponent, entropy, powered sum)``; 1 if none smaller fits.

    The range is cut into ``PARTS`` per job; ``fits`` must hold from some exponent on.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        good = [fits(a, *c) for a, c in zip(grid, _curves(sources, grid))]
        first = good.index(True) if True in good else PARTS
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def mixture(docs: DataFrame, tokens: Column, entropy_share: float | None = None, repeats: float | None = None, budget: float | None = None) -> Mixture:
    """Weights of the sources: their token shares to the power of the smallest exponent that fits.

    With ``entropy_share`` the weights' entropy must not exceed that share of the greatest possible one;
    with ``repeats`` no source may be passed over more often. Without ``budget`` as many tokens are spent
    as it takes to see every source once. Sources without tokens have weight 0.
    """
    named = docs.select(F.coalesce("source", F.lit(UNNAMED)).alias("name"), tokens.alias("tokens"))
    sums = stored(named.groupBy("name").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    n, total, least, most = sums.where("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return Mixture(1.0, 0.0, sums.select("name", "tokens", *[F.lit(0.0).alias(c) for c in ("share", "weight", "epochs")]))
    shared = sums.withColumn("share", F.col("tokens") / F.lit(total))
    some = shared.where("tokens > 0")
    small, large = least / total, most / total

    def spent(a: float, z: float) -> float:
        return budget if budget is not None else total * z * large ** (1 - a)

    def fits(a: float, entropy: float, z: float) -> bool:
        calm = entropy_share is None or entropy <= entropy_share * math.log(n) + 1e-12
        return calm and (repeats is None or spent(a, z) * small ** (a - 1) / z / total <= repeats * (1 + 1e-12))

    exponent = least_exponent(some, fits)
    ((_, z),) = _curves(some, [exponent])
    spend = spent(exponent, z)
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    made = shared.withColumn("weight", weight).withColumn("epochs", F.when(F.col("tokens") > 0, F.col("weight") * spend / F.col("tokens")).otherwise(0.0))
    # Rounding must not make a whole number of passes one token short.
    whole = F.when(F.abs(F.col("epochs") - F.round("epochs")) < 1e-9, F.round("epochs")).otherwise(F.col("epochs"))
    return Mixture(exponent, spend, stored(made.withColumn("epochs", whole), "mix-weights"))


def _order(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mixed(docs: DataFrame, mix: Mixture, tokens: Column, block_tokens: int = BLOCK_TOKENS, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """``docs`` with ``copies``, how often each is used, ``block`` and ``epochs`` of its source, and ``weight``.

    A source's whole passes take every document. The last, partial pass takes blocks of documents in the
    order of a seeded hash, whole ones while the budget lasts, and of the next block documents in hash order
    while they fit, so that a source spends at most its budget and falls short by less than a document.
    Documents are dealt to blocks of about ``block_tokens`` by hash; a source is never one sort but a sort
    of its blocks. Documents of a source without tokens are used once. Rows that are equal in doc_id and
    text are taken together; ``draw``, a hash of both, may be given if it was computed before. Columns of these
    names are replaced, all others may have any name.
    """
    names = [c for c in docs.columns if c.lower() not in ("copies", "block", "epochs", "weight")]
    blocks = F.ceil(F.col("mix_total") / block_tokens).cast("long")
    draw = _order(seed, "doc_id", "text") if draw is None else draw
    table_ = mix.sources.select(F.col("name").alias("mix_name"), F.col("tokens").alias("mix_total"), "weight", "epochs")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("mix_row")
    held = docs.select(row, tokens.alias("mix_tokens"), F.coalesce("source", F.lit(UNNAMED)).alias("mix_name"), draw.alias("mix_draw"))
    dealt = held.join(broadcast_if_small(table_), "mix_name").withColumn("block", F.pmod("mix_draw", F.greatest(blocks, F.lit(1))))

    sizes = stored(dealt.groupBy("mix_name", "block").agg(F.sum("mix_tokens").alias("size"), F.first("mix_total").alias("mix_total"), F.first("epochs").alias("epochs")), "mix-blocks")
    whole = F.floor("epochs")
    room = F.floor((F.col("epochs") - whole) * F.col("mix_total") + F.lit(1e-6))
    turn = Window.partitionBy("mix_name").orderBy(_order(seed + 1, "mix_name", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("until", F.sum("size").over(turn)).withColumn("room", room)
    ranked = ranked.withColumn("left", F.col("room") - F.col("until") + F.col("size"))
    cut = stored(ranked.where("left > 0 and left < size").select("mix_name", "block", "left"), "mix-cut")
    inner = dealt.select("mix_name", "block", "mix_tokens", _order(seed + 2, "mix_draw").alias("turn")).join(broadcast_if_small(cut), ["mix_name", "block"])
    peers = Window.partitionBy("mix_name", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fit = inner.withColumn("until", F.sum("mix_tokens").over(peers)).where("until <= left").groupBy("mix_name", "block").agg(F.max("turn").alias("bound"))
    plan = ranked.join(fit, ["mix_name", "block"], "left").select("mix_name", "block", (F.col("until") <= F.col("room")).alias("all"), "bound")
    plan = stored(plan, "mix-plan")
    last = F.col("all") | F.coalesce(_order(seed + 2, "mix_draw") <= F.col("bound"), F.lit(False))
    copies = F.when(F.col("mix_total") > 0, whole + last.cast("int")).otherwise(1).cast("int")
    return dealt.join(broadcast_if_small(plan), ["mix_name", "block"]).select("mix_row.*", copies.alias("copies"), "block", "epochs", "weight")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The texts are read once; all else is about their numbers of tokens.
    docs = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("tokens"), _order(1, "doc_id", "text").alias("draw")), "mix-tokens")
    total = docs.agg(F.sum("tokens")).first()[0]
    mix = mixture(docs, F.col("tokens"), ENTROPY_SHARE, REPEATS, float(total or 0))
    return mixed(docs, mix, F.col("tokens"), draw=F.col("draw")).select("doc_id", "source", "tokens", "weight", "epochs", "copies")


def repeated_by_weight(docs: DataFrame, repeats: float = PIPELINE_REPEATS) -> DataFrame:
    """``docs`` with each row as often as the mixture uses it; every document stays at least once.

    A null text has no tokens, a null source goes under a name of its own, repeated rows are repeated alike, an
    empty table stays empty; all columns stay as they are.
    """
    row = F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc")
    held = stored(docs.select(row, "source", word_count(F.col("text")).alias("tokens"), _order(1, "doc_id", "text").alias("draw")), "mix-tokens")
    used = mixed(held, mixture(held, F.col("tokens"), repeats=repeats), F.col("tokens"), draw=F.col("draw"))
    return used.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
