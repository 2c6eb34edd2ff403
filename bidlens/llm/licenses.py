"""License scans: exact base phrases, and short notices with bounded errors found from exact seeds."""

from __future__ import annotations

import bisect
import heapq

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from bidlens.llm.common import add_columns, table, text_of

# Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices as words, their label, and the edits (insert, delete, replace of a character) allowed.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under a creative commons attribution license", "cc-by", 5),
    ("licensed under the gnu general public license", "gpl", 4),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("all rights reserved", "reserved", 2),
]
# Everything in ASCII but letters and digits separates words; A-Z are lower-cased.
WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
NOTICE = ArrayType(
    StructType(
        [
            StructField("label", StringType()),
            StructField("first_word", LongType()),
            StructField("last_word", LongType()),
            StructField("edits", IntegerType()),
            StructField("similarity", IntegerType()),
        ]
    )
)
_SCANNERS: dict = {}


def seeds(phrase: str, edits: int) -> list[tuple[str, int]]:
    """The phrase cut into edits + 1 parts with their places: a match with so few edits keeps one part whole."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Seed automaton and bounded-error patterns of a list of notices."""

    def __init__(self, notices):
        self.notices = notices
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(p)}){{e<={k}}}") for p, _, k in notices]
        at: dict = {}
        for i, (phrase, _, edits) in enumerate(notices):
            for part, offset in seeds(phrase, edits):
                at.setdefault(part, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for part, where in at.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """Where a match around each seed may lie, by notice; a window is as long as its notice and the edits on both sides."""
        found: dict = {}
        for end, (n, where) in self.seeds.iter(text):
            for i, offset in where:
                phrase, _, k = self.notices[i]
                start = end + 1 - n - offset
                found.setdefault(i, set()).add((max(0, start - k), min(len(text), start + len(phrase) + k)))
        return found

    def matches(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, percent of characters kept), in order of place.

        Of the matches of a notice the one with the fewest edits, and of these the first, is taken; then the best of what
        lies on both sides of it, and so on. Only windows are searched, so the work is in proportion to the seeds.
        """
        out = []
        for i, windows in self.windows(text).items():
            phrase, label, _ = self.notices[i]
            found: list = []

            def look(low: int, high: int, i: int = i, found: list = found) -> None:
                if low < high and (m := self.fuzzy[i].search(text, low, high)) and m.end() > m.start():
                    heapq.heappush(found, (sum(m.fuzzy_counts), m.start(), m.end(), low, high))

            for window in sorted(windows):
                look(*window)
            starts: list[int] = []
            ends: list[int] = []
            while found:
                edits, start, end, low, high = heapq.heappop(found)
                first, last = bisect.bisect_right(ends, low), bisect.bisect_left(starts, high)
                taken = list(zip(starts[first:last], ends[first:last]))
                if not any(s < end and start < e for s, e in taken):
                    at = bisect.bisect_left(starts, start)
                    starts.insert(at, start)
                    ends.insert(at, end)
                    out.append((label, start, end, edits, 100 - 100 * edits // len(phrase)))
                    taken = sorted([*taken, (start, end)])
                # Others may lie in the gaps that are left of the window.
                edges = [low, *(x for span in taken for x in span), high]
                for a, b in zip(edges[::2], edges[1::2]):
                    look(max(a, low), min(b, high))
        return sorted(set(out), key=lambda m: m[1:])


def scanner(notices) -> Scanner:
    key = tuple(notices)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(notices)
    return _SCANNERS[key]


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands in words parted by single spaces, overlaps included."""
    if phrase not in words:
        return []
    padded, wanted, out, at, counted, number = b" " + words + b" ", b" " + phrase + b" ", [], -1, 0, 0
    while (at := padded.find(wanted, at + 1)) >= 0:
        number += padded.count(b" ", counted, at)
        counted = at
        out.append(number)
    return out


def scan_text(value: str | None, find: Scanner, base: dict[str, str]):
    words = text_of(value).translate(WORDS).split()
    line = b" ".join(words)
    hits = [(p, label) for phrase, label in base.items() for p in places(line, phrase.encode())]
    text = line.decode("utf-8", "surrogatepass")
    found = find.matches(text)
    spaces = [i for i, c in enumerate(text) if c == " "] if found else []

    def word(at: int) -> int:
        return bisect.bisect_left(spaces, at)

    notices = [
        {"label": label, "first_word": word(a + (text[a] == " ")), "last_word": word(b - (text[b - 1] == " ")), "edits": e, "similarity": s}
        for label, a, b, e, s in found
    ]
    return len(words), sorted(hits), notices


def license_scan(docs: DataFrame, notices=None, base=None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base_places`` (word, label) and ``notices`` (label, words, edits, similarity).

    Whole texts are scanned; a null text is empty and has no place. Every text is judged alone, so repeated
    rows get equal results. Columns of these names are replaced.
    """
    notices, base = list(NOTICES if notices is None else notices), dict(BASE if base is None else base)
    hit = StructType([StructField("word", LongType()), StructField("label", StringType())])

    def make(texts):
        find = scanner(notices)
        rows = [scan_text(t.as_py(), find, base) for t in texts]
        spots = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.int32())]))
        return [
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([[{"word": w, "label": x} for w, x in h] for _, h, _ in rows], spots),
            pa.array([m for _, _, m in rows], spans),
        ]

    outputs = [StructField("n_words", LongType()), StructField("base_places", ArrayType(hit)), StructField("notices", NOTICE)]
    return add_columns(docs, [text], outputs, make)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.array_distinct(F.col("base_places.label"))
    every = F.array_union(base, F.col("notices.label"))
    best = F.coalesce(F.array_max("notices.similarity"), F.lit(0)) / 100.0
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"),
        F.array_max("base_places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("base_places") > 0, 1.0).otherwise(best).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
