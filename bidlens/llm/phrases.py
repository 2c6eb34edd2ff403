"""Phrase collocations: n-grams counted by bidirectional FM-indices over word ids, one per shard, and scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from bidlens.llm.common import UPPER, small_batches, stored, table, text_of, trimmed

# Contract of the query: words of a phrase, occurrences, share of a longer phrase that makes a part redundant, rows of a language.
DEPTH, LEAST, INSIDE, BEST = 3, 10, 50, 2000
UNNAMED = "und"
# Words of a shard, about; a shard is what one index covers and bounds the memory of a task.
SHARD_WORDS = 1_000_000
# Bytes of a text handed to a shard at once; a longer text is cut where a piece ends.
PART_BYTES = 1 << 20
# Bits of the map of frequent phrases that a longer phrase's parts are looked up in: two MB at any size of the table.
MAP_BITS = 24
# Rows of one batch that a shard returns.
OUT_ROWS = 100_000
# Parts of a language that are ranked on their own before the last ranking.
SALTS = 64
_SPLIT = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if chr(c) in UPPER else c for c in range(256))


class WordIndex:
    """A half of a bidirectional FM-index: suffixes of ``ids`` in the order of their first ``depth`` symbols.

    Symbol 0 ends a piece and sorts first. ``last`` is the transformed text (the symbol before each suffix),
    ``step`` where the suffix one symbol longer stands, ``starts`` where the suffixes of a symbol begin. An
    interval of a pattern shorter than ``depth`` is extended to the left exactly as in a full suffix order.
    """

    def __init__(self, ids: np.ndarray, symbols: int, depth: int):
        padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(np.int64)
        rank, size = padded[: len(ids)], symbols
        for i in range(1, depth):
            if size > 2**62 // symbols:
                names, rank = np.unique(rank, return_inverse=True)
                size = len(names)
            rank, size = rank * symbols + padded[i : i + len(ids)], size * symbols
        order = np.argsort(rank, kind="stable")
        self.last = ids[order - 1]
        self.step = np.empty(len(ids), np.int64)
        self.step[np.argsort(self.last, kind="stable")] = np.arange(len(ids))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=symbols))])
        self.inside = np.concatenate([[0], np.cumsum(self.last != 0)])

    def neighbours(self, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many suffixes of each interval have a word of their piece before them."""
        return self.inside[low + n] - self.inside[low]

    def extended(self, low: np.ndarray, n: np.ndarray, symbols: int):
        """All one-symbol extensions of the intervals: (interval, symbol, its low, its size, smaller ones of the interval before it)."""
        owner = np.repeat(np.arange(len(low)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        key = owner * symbols + self.last[at]
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(key)]]))
        owner, symbol = np.divmod(key[first], symbols)
        before = first - (np.cumsum(n) - n)[owner]
        return owner, symbol, self.step[at[by[first]]], size, before


def enumerated(ids: np.ndarray, symbols: int, depth: int = DEPTH, frequent: Mapping[int, Callable] | None = None):
    """Every phrase of 1 to ``depth`` words of ``ids`` (0 between pieces): (words as a matrix, occurrences, those with a word before, those with a word after).

    A phrase keeps its interval in the index of the text and of the reversed text. Extending it to the right is a
    step in the reversed index, and the extensions smaller than the new word move the other interval along.
    ``frequent`` has tests for phrases of a length (a matrix of words in, a mask out): a phrase that fails is not
    extended, and one whose last words fail is left out.
    """
    frequent = frequent or {}
    there, back = WordIndex(ids, symbols, depth), WordIndex(ids[::-1], symbols, depth)
    n = np.bincount(ids, minlength=symbols)
    found = np.nonzero(n)[0]
    found = found[found > 0]
    words, n, low, low_back = found[:, None], n[found], there.starts[found], back.starts[found]
    for length in range(1, depth + 1):
        yield words, n, there.neighbours(low, n), back.neighbours(low_back, n)
        if length == depth:
            break
        if length in frequent:
            fits = frequent[length](words)
            words, n, low, low_back = words[fits], n[fits], low[fits], low_back[fits]
        owner, symbol, step, size, before = back.extended(low_back, n, symbols)
        real = symbol > 0
        if length in frequent:
            real[real] = frequent[length](np.concatenate([words[owner[real], 1:], symbol[real][:, None]], axis=1))
        owner, symbol, low_back, n = owner[real], symbol[real], step[real], size[real]
        low = low[owner] + before[real]
        words = np.concatenate([words[owner], symbol[:, None]], axis=1)


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases, given those of their words (a column per word), which do not depend on the shard."""
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def frequent_map(totals: DataFrame, size: int, bits: int = MAP_BITS) -> np.ndarray:
    """The frequent phrases of ``size`` words as a map of 2 ** ``bits`` bits, put together from words of 64 bits."""

    def run(batches):
        for batch in batches:
            texts = [t.split(b" ") for t in (text_of(x.as_py()) for x in batch.column("phrase"))]
            hashes = np.array([[xxhash.xxh3_64_intdigest(w) for w in t] for t in texts], np.uint64).reshape(len(texts), size)
            at = (phrase_hashes(hashes) >> np.uint64(64 - bits)).astype(np.int64)
            bit = np.uint64(1) << (at % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(bit.view(np.int64))], names=["place", "bit"])

    schema = StructType([StructField("place", LongType()), StructField("bit", LongType())])
    cells = totals.where(F.col("size") == size).select("phrase").mapInArrow(run, schema).groupBy("place").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in cells.collect():
        out[r["place"]] = np.uint64(r["bit"] % 2**64)
    return out


def piece_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct words, and the words of all texts as numbers from 1 with a 0 before, between and after pieces."""
    lines = pa.array([t.translate(_SPLIT).replace(b"\n", b" \n ") for t in texts], pa.large_binary())
    # One piece never goes on in the next text.
    tokens = pc.list_flatten(pc.split_pattern(pc.binary_join_element_wise(pa.scalar(b"\n", pa.large_binary()), lines, pa.scalar(b" ", pa.large_binary())), b" "))
    coded = tokens.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    plain = pc.and_(pc.not_equal(names, pa.scalar(b"", pa.large_binary())), pc.not_equal(names, pa.scalar(b"\n", pa.large_binary()))).to_numpy(zero_copy_only=False)
    number = np.zeros(len(names), np.int64)
    order = order[plain[order]]
    number[order] = np.arange(1, len(order) + 1)
    empty = pc.equal(names, pa.scalar(b"", pa.large_binary())).to_numpy(zero_copy_only=False)
    number[empty] = -1
    ids = number[coded.indices.to_numpy()]
    ids = np.concatenate([[0], ids[ids >= 0], [0]])
    return names.take(pa.array(order)), ids[np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])]


def _parts(text: bytes, size: int):
    """A text in parts of about ``size`` bytes that end where a piece ends."""
    while len(text) > size:
        end = max(text.rfind(c, 0, size) for c in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
        if end < 0:
            # A piece of more than ``size`` bytes stays whole.
            ends = [i for c in b".,;:!?\n\x0b\x0c\r" if (i := text.find(bytes([c]), size)) >= 0]
            end = min(ends, default=len(text) - 1)
        yield text[: end + 1]
        text = text[end + 1 :]
    yield text


def counted_phrases(docs: DataFrame, first: int = 1, depth: int = DEPTH, shard_words: int = SHARD_WORDS, maps: Mapping[int, np.ndarray] | None = None) -> DataFrame:
    """Phrases of ``first`` to ``depth`` words of ``docs`` (lang, text) by shard: (lang, size, phrase, n, before, after).

    ``before`` and ``after`` count occurrences with a word of the same piece to the left and right; the row of ``size`` 0 is the
    number of words. A shard is a stretch of one partition's texts, so no text is shuffled and no language goes to one task.
    Sum over shards for totals. With ``maps`` of frequent phrases, longer ones with a part in none are left out.
    """
    small_batches(docs.sparkSession)
    names = ["lang", "size", "phrase", "n", "before", "after"]
    shared = docs.sparkSession.sparkContext.broadcast(dict(maps or {}))

    def rows(lang, texts):
        words, ids = piece_words(texts)
        total = int((ids > 0).sum())
        if first == 1:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int64()), pa.array([""]), *[pa.array([total], pa.int64())] * 3], names=names)
        if not total:
            return
        known = shared.value
        hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in words.to_pylist())], np.uint64) if known else None

        def test(bitmap):
            shift = np.uint64(64 - 6 - int(len(bitmap)).bit_length() + 1)

            def fits(found):
                at = phrase_hashes(hashes[found]) >> shift
                return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

            return fits

        tests = {size: test(bitmap) for size, bitmap in known.items()}
        for found, n, before, after in enumerated(ids, len(words) + 1, depth, tests):
            if found.shape[1] < first:
                continue
            for at in range(0, len(n), OUT_ROWS):
                cut = slice(at, at + OUT_ROWS)
                columns = [words.take(pa.array(found[cut, i] - 1)) for i in range(found.shape[1])]
                phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                k = len(phrase)
                counts = [pa.array(x[cut].astype(np.int64)) for x in (n, before, after)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(np.full(k, found.shape[1], np.int64)), phrase, *counts], names=names)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part in _parts(text_of(text.as_py()), PART_BYTES):
                    held.setdefault(lang.as_py(), []).append(part)
                    # A word is about six bytes.
                    size += len(part) // 6 + 1
                    if size >= shard_words:
                        for key, texts in held.items():
                            yield from rows(key, texts)
                        held, size = {}, 0
        for key, texts in held.items():
            yield from rows(key, texts)

    kinds = [StringType(), LongType(), StringType(), LongType(), LongType(), LongType()]
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])
    return docs.select(F.coalesce("lang", F.lit(UNNAMED)).alias("lang"), "text").mapInArrow(trimmed(run), schema)


def phrase_totals(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Phrases with at least ``least`` occurrences over all shards, and each language's number of words as the phrase of size 0.

    Words and pairs are counted in one pass over the texts, each longer size in a pass of its own. A phrase is at most as
    frequent as its parts, so a pass leaves out phrases with a part that is not in the map of those found frequent before; the
    map may hold others by chance, and what it lets through is counted, so no frequent phrase is lost and none is added.
    """

    def summed(first, last, maps):
        shards = counted_phrases(docs, first, last, shard_words, maps)
        # A shard has counted its phrases, so rows go straight to where they are summed.
        sums = shards.repartition("lang", "size", "phrase").groupBy("lang", "size", "phrase").agg(*[F.sum(c).alias(c) for c in ("n", "before", "after")])
        return stored(sums.where((F.col("n") >= least) | (F.col("size") == 0)), "phrase-totals")

    totals, maps = summed(1, min(2, depth), None), {}
    for size in range(3, depth + 1):
        maps[size - 1] = frequent_map(totals, size - 1)
        totals = totals.union(summed(size, size, maps))
    return totals


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, inside: int = INSIDE, best: int = BEST) -> DataFrame:
    """The best phrases of 2 to ``depth`` words per language: lang, rank, phrase, a, l, r, n, score, before, after.

    A phrase with ``a`` occurrences is cut after each of its words into parts with ``l`` and ``r`` occurrences; its score
    is that of the lowest cut, floor(1000000 * a * a / (l * r)), in exact decimals (the first such cut). A phrase that stands in a
    longer one with at least ``inside`` percent of its occurrences is left out. Null texts have no words, a null
    language is ``und``, repeated rows count again, texts without words and empty tables give no phrases; ties of score and
    occurrences go by the phrase's bytes. Other columns are not read.
    """
    totals = phrase_totals(docs, depth, least)
    all_words = totals.where("size = 0").select("lang", F.col("n").alias("all_words"))
    words = F.split("phrase", " ", -1)
    found = totals.where("size >= 2").withColumn("words", words)

    def part(start, length):
        return F.concat_ws(" ", F.slice("words", start, length))

    parts = totals.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "before", "after", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size").cast("int") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("times").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("times").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(19,0))"
    score = F.expr(f"cast(cast(1000000 as decimal(7,0)) * ({wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')}) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "before", "after").agg(lowest)

    longer = found.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size").cast("int") - 1)))
    longer = longer.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - F.col("length") + 1)))
    covers = longer.select("lang", part(F.col("start"), F.col("length")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(F.expr(f"longest is null or 100 * longest < {int(inside)} * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "before", "after", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(all_words.withColumnRenamed("all_words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text")).drop("before", "after")


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null),
words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, 1 as size, unnest(w) as phrase from words
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words),
totals as (select lang, count(*) as n from grams where size = 1 group by lang),
f as (select lang, size, phrase, count(*) as f from grams group by all having count(*) >= 10),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size >= 2),
cuts as (
  select lang, phrase, a, 1 as k, w[1] as first, array_to_string(w[2:], ' ') as rest from candidates
  union all select lang, phrase, a, 2, array_to_string(w[:2], ' '), w[3] from candidates where size = 3),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.first join f y on y.lang = c.lang and y.phrase = c.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, phrase, max(a) as longest from (
    select lang, array_to_string(w[1:2], ' ') as phrase, a from candidates where size = 3
    union all select lang, array_to_string(w[2:3], ' '), a from candidates where size = 3) group by all),
kept as (
  select l.* from lowest l left join longer g using (lang, phrase) where g.longest is null or 100 * g.longest < 50 * l.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000
"""
