"""The path-template tree against a plain recursion, and on very deep paths."""

import math
import random

from pyspark.sql import functions as F

from bidlens.llm import urls


def plain_templates(paths):
    """Templates of (segments: [pages, labelled, bad]) of one host."""
    out = {}

    def grow(held, level, template):
        children = {}
        for segs, counts in held:
            if len(segs) == level:
                out[segs] = template
            else:
                children.setdefault(segs[level], []).append((segs, counts))
        names = {}
        for seg, rows in children.items():
            rare = len(children) >= urls.VARIETY and sum(c[0] for _, c in rows) < urls.SUPPORT
            names.setdefault("*" if rare else seg, []).extend(rows)
        sums = {k: (sum(c[1] for _, c in rows), sum(c[2] for _, c in rows)) for k, rows in names.items()}
        total, bad = sum(x for x, _ in sums.values()), sum(x for _, x in sums.values())
        steps = {}
        for k, rows in names.items():
            (x, b), rest, rest_bad = sums[k], total - sums[k][0], bad - sums[k][1]
            share = bad / max(total, 1)
            error = math.sqrt(share * (1 - share) * (1 / max(x, 1) + 1 / max(rest, 1)))
            alike = x == 0 or rest == 0 or abs(b / max(x, 1) - rest_bad / max(rest, 1)) <= urls.SIMILAR * error
            steps.setdefault("~" if alike and len(names) > 1 and k != "*" else k, []).extend(rows)
        for step, rows in steps.items():
            grow(rows, level + 1, f"{template}/{step}")

    grow(list(paths.items()), 0, "")
    return out


def test_tree_equals_a_plain_recursion(spark):
    rng = random.Random(5)
    paths = {}
    for _ in range(300):
        top = rng.choice(["a", "b", "c"])
        deep = ["k"] * rng.choice([0, 0, 1, 5, 9])
        tail = [f"{rng.choice('pqrstuvwxyz')}{rng.choice('pqrstuvwxyz')}" for _ in range(rng.randint(0, 2))]
        counts = paths.setdefault((top, *deep, *tail), [0, 0, 0])
        for _ in range(rng.randint(1, 12)):
            known = rng.random() < 0.6
            counts[0] += 1
            counts[1] += known
            counts[2] += known and rng.random() < (0.9 if top == "b" else 0.1)
    rows = []
    for segs, (n, labelled, bad) in paths.items():
        rows += [("h", list(segs), None if i >= labelled else int(i < bad)) for i in range(n)]
    pages = spark.createDataFrame(rows, "host string, segs array<string>, bad int")
    got = {tuple(r.segs): r.template for r in urls.template_tree(pages).collect()}
    want = plain_templates(paths)
    assert got == want and any("*" in t for t in want.values()) and any("~" in t for t in want.values())


def test_paths_of_two_thousand_segments_take_few_rounds(spark, monkeypatch):
    rounds = []
    stored = urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    long = ["x"] * 2000
    rows = [("h", long[:n] + tail, 0) for n, tail in [(2000, []), (1999, []), (500, []), (2000, ["y"]), (2000, ["z"]), (0, ["w"])]]
    got = urls.template_tree(spark.createDataFrame(rows, "host string, segs array<string>, bad int"))
    assert got.count() == 6 and got.where(F.size("segs") == 2001).count() == 2
    assert rounds.count("url-level") == 2
    assert {len(r.template.split("/")) - 1 for r in got.collect()} == {1, 500, 1999, 2000, 2001}
