"""Suffix-array deduplication of repeated byte strings, with hash-compared suffixes.

Every window of ``length`` bytes is told by the k-gram of least hash in it, its anchor: equal windows have
equal anchors at equal places. Windows that share an anchor occurrence form a segment. Anchors seen once
rule out their windows, segments seen twice are repeated as a whole; only the other segments of a repeated
anchor are compared, by sorting the suffixes at the anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from bidlens.llm.common import add_columns, put_back, set_aside, settled, small_batches, stored, table, text_of, trimmed

# Bytes of a repeated string, and of the k-gram that anchors it.
LENGTH = 200
GRAM = 32
# Bytes hashed at a time, and the stretch into which a longer text is cut.
CHUNK = 1 << 18
# Segments sorted by one task, about; anchors with more kinds of segments go by windows instead.
BUCKET = 20_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(11).integers(0, 2**64 - 1, size=256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, grown as needed."""
    if len(_powers.made[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = _U(pow(int(_BASE), -1, 2**64))
        one = np.ones(1, dtype=np.uint64)
        _powers.made = tuple(np.concatenate([one, np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, inverse))
    return _powers.made[0][:n], _powers.made[1][:n]


_powers.made = (np.ones(1, dtype=np.uint64),) * 2


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, with random values for the bytes."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up, out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of stretches, equal for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def anchored(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Segments of texts laid end to end: anchor hash, first window, last window, anchor place, as arrays.

    ``ends`` are the texts' ends; a window lies in one text. The anchor is the leftmost k-gram of least hash.
    """
    n, width = len(data), length - gram + 1
    if n < length:
        return [np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3]
    _, down = _powers(n)
    prefix = prefix_hashes(data)
    h = mixed((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    low, size = h, 1
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    valid = np.zeros(len(low) + 1, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    full = ends - starts >= length
    np.add.at(valid, starts[full], 1)
    np.add.at(valid, ends[full] - length + 1, -1)
    at = np.nonzero(np.cumsum(valid[:-1]) > 0)[0]
    if not len(at):
        return [np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3]
    values = low[at]
    # Texts of exactly one window stand next to another text's windows only if ends meet: cut there too.
    turn = np.nonzero((np.diff(at) != 1) | (values[1:] != values[:-1]))[0] + 1
    first, last = at[np.concatenate([[0], turn])], at[np.concatenate([turn - 1, [len(at) - 1]])]
    value = low[first]
    place = first + (h[first[:, None] + np.arange(width)] == value[:, None]).argmax(axis=1)
    tied = place < last
    if tied.any():
        out = [[value[~tied]], [first[~tied]], [last[~tied]], [place[~tied]]]
        for v, a, b in zip(value[tied], first[tied], last[tied]):
            where = np.nonzero(h[a : b + width] == v)[0] + a
            windows = np.arange(a, b + 1)
            owner = where[np.searchsorted(where, windows)]
            cut = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
            for x, y in zip(out, (np.full(len(cut), v), windows[cut], windows[np.concatenate([cut[1:], [len(windows)]]) - 1], owner[cut])):
                x.append(y)
        value, first, last, place = (np.concatenate(x) for x in out)
    return [value, first, last, place]


def stretches(texts: list[bytes], length: int, chunk: int = CHUNK):
    """Groups of (text number, offset, bytes) of about ``chunk`` bytes; long texts are cut with an overlap of length - 1."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), chunk):
            part = text[start : start + chunk + length - 1]
            if len(part) < length:
                continue
            group.append((i, start, part))
            size += len(part)
            if size >= chunk:
                yield group
                group, size = [], 0
    if group:
        yield group


ANCHOR = [("h", LongType(), pa.int64()), ("sd", LongType(), pa.int64()), ("key", LongType(), pa.int64()), ("start", LongType(), pa.int64()), ("windows", IntegerType(), pa.int32()), ("place", IntegerType(), pa.int32())]


def anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Segments of ``texts`` (key, text): anchor hash h, digest sd of its bytes, key, start, number of windows, place of the anchor in it."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for group in stretches([text_of(t.as_py()) for t in batch.column("text")], length):
                line = b"".join(part for _, _, part in group)
                ends = np.cumsum([len(part) for _, _, part in group])
                value, first, last, place = anchored(np.frombuffer(line, np.uint8), ends, length, gram)
                which = np.searchsorted(ends, first, side="right")
                digest, view = xxhash.xxh3_64_intdigest, memoryview(line)
                sd = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], dtype=np.uint64)
                begin = np.concatenate([[0], ends[:-1]])[which]
                number = np.array([i for i, _, _ in group])[which]
                offset = np.array([s for _, s, _ in group])[which]
                columns = [value.view(np.int64), sd.view(np.int64), keys[number], first - begin + offset, (last - first + 1).astype(np.int32), (place - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, ANCHOR)], names=[c for c, _, _ in ANCHOR])

    return texts.select("key", "text").mapInArrow(trimmed(run), StructType([StructField(c, t) for c, t, _ in ANCHOR]))


class Suffixes:
    """Suffixes at the anchors of segments, compared by prefix hashes; ``group`` parts segments of different anchors."""

    def __init__(self, segments: list[bytes], place: np.ndarray, group: np.ndarray):
        sizes = np.array([len(s) for s in segments])
        self.data = np.frombuffer(b"".join(segments), np.uint8)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.at = self.start + place
        self.group = group
        self.prefix = prefix_hashes(self.data)
        _, self.down = _powers(len(self.data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over prefix hashes."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = stretch_hash(self.prefix, a, a + middle, self.down) == stretch_hash(self.prefix, b, b + middle, self.down)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def below(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix x comes before y."""
        out = self.group[x] < self.group[y]
        same = np.nonzero(self.group[x] == self.group[y])[0]
        if len(same):
            p, q = x[same], y[same]
            n = self.common(p, q)
            p_end, q_end = self.at[p] + n >= self.end[p], self.at[q] + n >= self.end[q]
            p_byte = np.where(p_end, -1, self.data[np.minimum(self.at[p] + n, len(self.data) - 1)].astype(np.int64))
            q_byte = np.where(q_end, -1, self.data[np.minimum(self.at[q] + n, len(self.data) - 1)].astype(np.int64))
            out[same] = (p_byte <= q_byte) if or_equal else (p_byte < q_byte)
        return out

    def sorted(self) -> np.ndarray:
        """Bottom-up mergesort; all merges of a level go at once, each element finding its rank in the other run."""
        n = len(self.at)
        order, width = np.argsort(self.group, kind="stable"), 1
        while width < n:
            spot = np.arange(n)
            run = spot // (2 * width) * (2 * width)
            left = spot - run < width
            low = np.where(left, np.minimum(run + width, n), run)
            floor, high = low.copy(), np.where(left, np.minimum(run + 2 * width, n), np.minimum(run + width, n))
            while (todo := np.nonzero(low < high)[0]).size:
                middle = (low[todo] + high[todo]) // 2
                mine, other = order[todo], order[middle]
                # Elements of the left run come first among equals.
                before = np.empty(len(todo), dtype=bool)
                for side in (True, False):
                    part = left[todo] == side
                    before[part] = self.below(other[part], mine[part], or_equal=not side)
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
            rank = run + (spot - np.where(left, run, run + width)) + (low - floor)
            fresh = np.empty_like(order)
            fresh[rank] = order
            order, width = fresh, 2 * width
        return order


def repeated_windows(segments: list[bytes], place: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows (segment, number) also stand in another segment of the group, as a boolean matrix.

    A window with ``o`` bytes before the anchor is repeated if another suffix shares length - o bytes, and
    the o bytes before the anchors are equal. All hash matches are verified byte by byte.
    """
    n = len(segments)
    out = np.zeros((n, int(windows.max())), dtype=bool)
    s = Suffixes(segments, place, group)
    order = s.sorted()
    near = np.zeros(n, dtype=np.int64)
    near[1:] = np.where(group[order[1:]] == group[order[:-1]], s.common(order[1:], order[:-1]), 0)
    least, most = (place - windows + 1)[order], place[order]
    rows = np.lib.stride_tricks.sliding_window_view(s.data, length)
    for o in range(max(0, int(least.min())), int(most.max()) + 1):
        has = np.nonzero((least <= o) & (o <= most))[0]
        if len(has) < 2:
            continue
        run = np.cumsum(near < length - o).astype(np.uint64)[has]
        at = s.at[order[has]]
        mark = mixed(stretch_hash(s.prefix, at - o, at, s.down)) ^ mixed(run * _U(0x9E3779B97F4A7C15))
        _, first, back, count = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
        twice = np.nonzero(count[back] > 1)[0]
        if not len(twice):
            continue
        same = (rows[at[twice] - o] == rows[at[first[back[twice]]] - o]).all(axis=1)
        if not same.all():  # a collision of hashes: compare the bytes themselves
            held: dict = {}
            for i in twice:
                held.setdefault(rows[at[i] - o].tobytes(), []).append(i)
            twice = np.array([i for x in held.values() if len(x) > 1 for i in x], dtype=np.int64)
        who = order[has[twice]]
        out[who, place[who] - o] = True
    return out


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Starts of repeated strings in ``texts`` (key, text): (key, lo, hi), from ``lo`` to ``hi`` each."""
    small_batches(texts.sparkSession)
    every = stored(anchors(texts, length, gram), "suffix-anchors")
    # Stored, so that the join below has two exchanges of its own and a frequent anchor can be split.
    often = stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-often")
    found = stored(every.join(often, "h"), "suffix-repeated")
    kinds = stored(found.groupBy("h", "sd").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows", "place")).alias("at")), "suffix-kinds")
    whole = found.join(kinds.where("n > 1").select("h", "sd"), ["h", "sd"]).select("key", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1).alias("hi"))

    open_ = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("h", "kinds")
    need = kinds.join(open_, "h").select("h", "sd", "kinds", "at.*")
    listed = stored(need.groupBy("key").agg(F.collect_list(F.struct("h", "sd", "kinds", "start", "windows", "place")).alias("parts")), "suffix-needed")
    shape = StructType([StructField("h", LongType()), StructField("sd", LongType()), StructField("kinds", LongType()), StructField("windows", IntegerType()), StructField("place", IntegerType()), StructField("bytes", BinaryType())])

    def cut(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text"), batch.column("parts")):
                line = text_of(text.as_py())
                rows += [(p["h"], p["sd"], p["kinds"], p["windows"], p["place"], line[p["start"] : p["start"] + p["windows"] - 1 + length]) for p in parts.as_py()]
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_)], names=shape.names)

    copies = texts.join(listed, "key").select("text", "parts").mapInArrow(trimmed(cut), shape)
    segments = stored(copies.groupBy("h", "sd").agg(*[F.first(c).alias(c) for c in ("kinds", "windows", "place", "bytes")]), "suffix-segments")
    few, many = segments.where(F.col("kinds") <= BUCKET), segments.where(F.col("kinds") > BUCKET)
    buckets = max(1, -(-few.count() // BUCKET))
    result = StructType([StructField(c, LongType()) for c in ("h", "sd", "from", "to")])

    def compare(group):
        h = group["h"].to_numpy()
        place, windows = (group[c].to_numpy().astype(np.int64) for c in ("place", "windows"))
        flags = repeated_windows(group["bytes"].to_pylist(), place, windows, h, length)
        sd, rows = group["sd"].to_numpy(), []
        for i in np.nonzero(flags.any(axis=1))[0]:
            rows += [(int(h[i]), int(sd[i]), a, b) for a, b in _ranges(flags[i])]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=result.names)

    parts = few.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda group: settled(compare, group), result)

    # An anchor with very many kinds of segments would be one large group: its windows are counted one by one.
    def windows_of(batches):
        for batch in batches:
            rows = [
                (h.as_py(), sd.as_py(), i, xxhash.xxh3_128_digest(b.as_py()[i : i + length]))
                for h, sd, w, b in zip(*(batch.column(c) for c in ("h", "sd", "windows", "bytes")))
                for i in range(w.as_py())
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "sd", "from", "digest"])

    single = many.mapInArrow(trimmed(windows_of), StructType([*result.fields[:3], StructField("digest", BinaryType())]))
    common = single.groupBy("h", "digest").agg(F.count("*").alias("n")).where("n > 1").select("h", "digest")
    rest = single.join(common, ["h", "digest"]).select("h", "sd", "from", F.col("from").alias("to"))
    matched = stored(parts.union(rest), "suffix-matches")
    once = found.join(kinds.where("n = 1").select("h", "sd"), ["h", "sd"]).join(matched, ["h", "sd"])
    return whole.union(once.select("key", F.col("start") + F.col("from"), F.col("start") + F.col("to")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal ones."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (maximal spans of bytes) and ``kept`` (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere in the table, in the
    same text or another; all places of the string lose it. A null text is empty. A repeated row is
    another place of all its strings. Texts shorter than ``length`` stay whole. Columns of these names are
    replaced. Texts are told apart by a 64-bit hash together with their length.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "removed", "kept")]
    held = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(texts, lists):
        rows = [cut_text(t, s, length) for t, s in zip(texts, lists)]
        removed = [[{"start": a, "end": b} for a, b in gone] for _, gone, _ in rows]
        return [pa.array([n for n, _, _ in rows], pa.int64()), pa.array(removed, spot), pa.array([k for _, _, k in rows], pa.binary())]

    outputs = [StructField("n_bytes", LongType()), StructField("removed", SPANS), StructField("kept", BinaryType())]
    return add_columns(with_spans(held, length, gram), ["text", "spans"], outputs, apply).select("row.*", "n_bytes", "removed", "kept")


def cut_text(text: pa.Scalar, spans: pa.Scalar, length: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """Size of a text in bytes, its removed spans and the bytes that stay."""
    line = text_of(text.as_py())
    gone = merged([(x["lo"], x["hi"] + length) for x in spans.as_py() or ()])
    edge = [0, *(e for span in gone for e in span), len(line)]
    return len(line), gone, b"".join(line[a:b] for a, b in zip(edge[::2], edge[1::2]))


def with_spans(held: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``held`` (any columns and ``text``) with ``spans``, the starts of repeated strings (lo, hi), null where none is."""
    keyed = held.withColumn("key", F.xxhash64("text", F.octet_length("text")))
    starts = repeated_starts(keyed.where(F.octet_length("text") >= length).select("key", "text"), length, gram)
    spans = stored(starts.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    return keyed.join(spans, "key", "left").drop("key")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept bytes as text and their length; characters that lost a byte go.

    A null text stays null, an empty one empty. Repeated rows repeat all their strings, so they lose all that is long
    enough. No row goes, an empty table stays empty, and all other columns stay as they are.
    """

    def text(texts, lists):
        return [pa.array([cut_text(t, s, LENGTH)[2].decode("utf-8", "ignore") for t, s in zip(texts, lists)], pa.string())]

    names = docs.columns
    held = with_spans(set_aside(docs, names, "text"))
    made = add_columns(held, ["text", "spans"], [StructField("new_text", docs.schema["text"].dataType)], text)
    fresh = {"text": F.when(F.col("text").isNotNull(), F.col("new_text"))}
    if "n_chars" in names:
        old = put_back(names, "text")[names.index("n_chars")]
        fresh["n_chars"] = F.when(F.col("text").isNotNull(), F.length("new_text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return made.select(*[fresh[c].alias(c) if c in fresh else old for c, old in zip(names, put_back(names, "text"))])
