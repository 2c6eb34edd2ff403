"""Hard negatives, archives and phrases against brute force, exact round trips and hand cases."""

import gzip
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.llm import negatives, phrases, warc

VECTORS = "vec_id long, label int, vector array<long>, score int, slot string"


def brute_negatives(rows, is_anchor, positives=5, count=3):
    out = []
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    for a, label, v, *_ in [r for r in rows if is_anchor(r[0])]:
        dot = [(sum(x * y for x, y in zip(v, w)), i, other) for i, other, w, *_ in rows if i != a and len(w) == len(v)]
        near = sorted(((-s, i) for s, i, other in dot if other == label))[:positives]
        for s, i in near:
            fit = sorted((-t, j) for t, j, other in dot if other != label and 50 * -s <= 100 * t <= 95 * -s)[:count]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


def vector_rows(n=900, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.integers(-200, 200, size=(n, dim))
    # Copies, near copies and a zero vector.
    v[n // 3 : n // 2] = v[0]
    v[n // 2 : n // 2 + 50] = v[1] + rng.integers(-2, 3, size=(50, dim))
    v[20] = 0
    return [(i, int(rng.integers(0, 4)), v[i].tolist(), 1, "x") for i in range(n)]


@pytest.mark.parametrize("most", [65_536, 64])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCKS", 3)
    monkeypatch.setattr(negatives, "MOST_ROWS", most)
    monkeypatch.setattr(negatives, "CLUSTER", 7)
    rows = vector_rows()
    rows += [(None, 1, [1] * 6, 1, "x"), (1000, None, [1] * 6, 1, "x"), (1010, 1, None, 1, "x"), (1020, 1, [1, None, 1, 1, 1, 1], 1, "x"), (1030, 2, [5, 5], 1, "x"), (1031, 3, [4, 4], 1, "x"), (1032, 2, [5, 6], 1, "x"), (1040, 1, [], 1, "x")]
    # A row twice, and one id under two vectors.
    rows += [rows[30], (40, 2, [100, -100, 50, 50, 0, 0], 1, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    found = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert found == brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(found) > 100


def test_hard_negatives_of_huge_scores_and_empty_tables(spark):
    rows = [(0, 1, [2**30, 3]), (1, 1, [2**30, 1]), (2, 0, [2**29 + 12345, 1]), (3, 0, [2**30 - 2**25, 7])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    found = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") == 0).collect()))
    assert found == brute_negatives(rows, lambda i: i == 0) and found
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0


def test_a_shared_list_ends_before_all_rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    members = np.floor(256 * (centre + 0.01 * rng.normal(size=(20, 16)))).astype(np.int64)
    rows = np.concatenate([np.floor(256 * (centre + 0.1 * rng.normal(size=(50, 16)))), np.floor(256 * rng.normal(size=(5000, 16)))]).astype(np.int64)
    ids = np.arange(len(rows))
    far = np.full(20, 2**62)
    s, v, x, scored = negatives.walk(rows, ids, members, np.full(20, -1), np.arange(20), -far, far, 5, stretch=64)
    assert scored < 1000
    scores = rows @ members.T
    for m in range(20):
        best = sorted(zip(-scores[:, m], ids))[:5]
        assert sorted(zip(-x[s == m], v[s == m])) == best


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(6)
    rows, members = rng.normal(size=(500, 5)), rng.normal(size=(30, 5)) + 2
    order, bounds = negatives.shared_list(rows, members)
    norms = np.linalg.norm(members, axis=1)
    assert ((rows[order] @ members.T) <= bounds[:, None] * norms + 1e-9).all()
    assert (np.diff(bounds) <= 0).all()


def test_clusters_hold_several_anchors_of_a_label(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"l{i % 10}", 4, rng.integers(-200, 200, size=4).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "row_id long, label string, dim int, vector array<long>")
    found = negatives._clustered(df)
    assert found.select("row_id").distinct().count() == found.count() == 800
    clusters = found.select("label", "cell", "part").distinct().count()
    # Every block sorts its rows once per cluster.
    assert 10 < clusters <= 800 / negatives.LEAST_CLUSTER


@pytest.mark.parametrize("most", [3, 300, 2**11, 2**25, 2**30])
def test_a_walk_keeps_each_slots_limits(most):
    rng = np.random.default_rng(most)
    rows, members = (rng.integers(-most, most + 1, size=(n, 4)) for n in (700, 9))
    rows[100:200] = rows[300]
    ids = rng.permutation(700) // 2
    slot = np.array([3, 0, 0, 5, 3, 8, 8, 8, 1])
    scores = (rows @ members.T)[:, slot]
    low, high = np.quantile(scores, 0.4, axis=0).astype(np.int64), np.quantile(scores, [0.9], axis=0)[0].astype(np.int64)
    low[1], high[1] = -(2**62), 2**62
    low[2] = high[2] = scores[300, 2]
    own = np.arange(9) * 10
    s, v, x, _ = negatives.walk(rows, ids, members, own, slot, low, high, 3, stretch=64)
    for j in range(len(slot)):
        fit = sorted((-t, i) for t, i in zip(scores[:, j].tolist(), ids.tolist()) if low[j] <= t <= high[j] and i != own[slot[j]])
        assert sorted(zip((-x[s == j]).tolist(), v[s == j].tolist())) == fit[:3] and fit


# --- archives


def archived(spark, tmp_path, records, **options):
    df = spark.createDataFrame(records, "record_id string, uri string, refers_to string, payload binary, digest int, chunk int")
    files = warc.write_warc(df.repartition(3), f"{tmp_path}/warc", **options)
    return files, warc.read_warc(files, options.get("chunk", warc.CHUNK))


def test_archives_give_back_all_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n", "é\0\n".encode(), rng.bytes(1000), rng.bytes(64), b"a" * 70_001, None]
    records = [(f"urn:a b:{i}%41", None if i == 1 else f"http://e.org/{i}\r\nX: y", None, p, 1, 1) for i, p in enumerate(payloads)]
    records += [("urn:r", "http://e.org/r", "urn:a b:4%41", payloads[4], 1, 1)]
    files, chunks = archived(spark, tmp_path, records, chunk=100, archive_bytes=1)
    # Every record has its own archive here, and all are whole gzip files.
    assert files.agg(F.sum("records")).first()[0] == len(records) == files.count()
    rows = sorted(chunks.collect(), key=lambda r: (r.record_id, r.chunk))
    for record_id, _, refers, payload, *_ in records:
        mine = [r for r in rows if r.record_id == record_id]
        stored = (payload or b"") if refers is None else b""
        assert b"".join(r.data for r in mine) == stored
        assert [r.chunk for r in mine] == list(range(len(mine))) and [r.last for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(len(r.data) == 100 for r in mine[:-1])
        for r in mine:
            assert r.digest == warc.base32(hashlib.sha1(stored[: r.end]).digest())
        assert mine[-1].declared_digest == warc.base32(hashlib.sha1(payload or b"").digest()) and mine[-1].declared_bytes == len(payload or b"")
        assert mine[0].refers_to == refers and mine[0].record_type == ("response" if refers is None else "revisit")
    assert rows[0].uri == "http://e.org/0%0D%0AX:%20y" and rows[1].uri is None
    assert all(r.verified for r in warc.records_of(chunks).where("record_type = 'response'").collect())
    path = warc.file_at(files.first().path)[1]
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")


def test_one_archive_holds_many_records_and_damage_is_seen(spark, tmp_path):
    records = [(f"urn:{i}", "u", None, b"%d" % i * 500, 1, 1) for i in range(300)]
    files, chunks = archived(spark, tmp_path, records)
    assert files.count() <= 3 and warc.records_of(chunks).where("verified").count() == 300
    path = warc.file_at(files.first().path)[1]
    plain = gzip.open(path).read()
    back = list(warc.record_chunks(io.BytesIO(plain), "plain"))
    assert [r[0] for r in back if r[1] != "warcinfo"] == [r.record_id for r in chunks.where(F.col("path") == files.first().path).collect()]
    with pytest.raises(ValueError):
        list(warc.record_chunks(io.BytesIO(plain[:-300]), "short"))
    with pytest.raises(ValueError):
        list(warc.record_chunks(io.BytesIO(b"no archive\n"), "other"))
    wrong = plain.replace(b"299" * 10, b"298" * 10)
    if wrong != plain:
        (bad,) = [r for r in warc.record_chunks(io.BytesIO(wrong), "wrong") if r[0] == "urn:299" and r[8]]
        assert bad[9] != bad[5]


def test_warc_query(spark, tmp_path):
    schema = "page_id long, url string, html string, digest int, payload string, first long, mark int"
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (7, "u7", "é" * 50_000), (1, "u1", None), (2, "u2", ""), (None, "u", "same"), (None, "u", "alone"), (4, "u4", "twice"), (4, "u4", "twice")]
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(str, warc.op12_warc(spark, str(tmp_path)).collect()))
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    wanted = []
    for i, _, html in rows:
        data, f = (html or "").encode(), first.get(html or "")
        own = f is None or f == i
        wanted.append((i, len(data), warc.base32(hashlib.sha1(data).digest()), "response" if own else "revisit", None if own else f))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert found == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, w)) + ")" for w in wanted)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op12_warc(spark, f"{tmp_path}/none").count() == 0


# --- phrases


def brute_counts(texts, depth):
    n, before, after = Counter(), Counter(), Counter()
    for text in texts:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    p = " ".join(words[i : i + k])
                    n[p] += 1
                    before[p] += i > 0
                    after[p] += i + k < len(words)
    return n, before, after


def brute_collocations(docs, depth, least, inside, best):
    out = []
    for lang in {d[0] or "und" for d in docs}:
        n, before, after = brute_counts([t for g, t in docs if (g or "und") == lang], depth)
        words = sum(v for p, v in n.items() if " " not in p)
        found = [p.split(" ") for p, v in n.items() if " " in p and v >= least]
        rows = []
        for w in found:
            a = n[" ".join(w)]
            longer = [n[" ".join(x)] for x in found if len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
            if any(100 * f >= inside * a for f in longer):
                continue
            cuts = [(1000000 * a * a // (n[" ".join(w[:k])] * n[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), n[" ".join(w[:k])], n[" ".join(w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words, -s, before[p.decode()], after[p.decode()]))
    return sorted(out)


def phrase_docs(seed=2):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(12)] + ["É", "é", "Ab", "aB", "x y", "\x1c"]
    docs = []
    for i in range(150):
        words = rng.choice(names, size=int(rng.integers(0, 60)), p=np.array([0.05] * 17 + [0.15]))
        marks = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "! ", "\x0b", "\r\n"], size=len(words), p=[0.6] + [0.05] * 8)
        docs.append((["en", None, "und", "fr"][i % 4], "".join(w + m for w, m in zip(words, marks))))
    return docs + [("en", None), (None, ""), ("xx", " .,; "), ("en", docs[0][1]), ("en", docs[0][1])]


@pytest.mark.parametrize("depth, shard, part", [(3, 500_000, 1 << 20), (3, 40, 50), (5, 200, 1 << 20)])
def test_phrases_equal_brute_force(spark, monkeypatch, depth, shard, part):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "PART_BYTES", part)
    docs = phrase_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n int, phrase string").repartition(3)
    totals = phrases.phrase_totals(df, depth, 3, shard)
    for lang in ("en", "und", "fr"):
        n, before, after = brute_counts([t for g, t in docs if (g or "und") == lang], depth)
        wanted = {p: (v, before[p], after[p]) for p, v in n.items() if v >= 3}
        assert {r.phrase: (r.n, r.before, r.after) for r in totals.where((F.col("lang") == lang) & (F.col("size") > 0)).collect()} == wanted
    found = sorted(map(tuple, phrases.collocations(df, depth, 3, 50, 40).collect()))
    assert found == brute_collocations(docs, depth, 3, 50, 40)
    assert any(r[1] == 40 for r in found)


def test_phrases_of_empty_and_long_texts(spark):
    schema = "lang string, text string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], schema)).count() == 0
    long = [("en", "a b " * 400_000 + "c")]
    (row,) = [r for r in phrases.collocations(spark.createDataFrame(long, schema)).collect() if r.phrase == "a b a"]
    assert (row.a, row.n) == (399_999, 800_001)


def test_an_interval_is_found_as_in_a_full_suffix_order():
    rng = np.random.default_rng(4)
    ids = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    index = phrases.WordIndex(ids, 4, 4)
    assert index.step[index.starts[1] :].size and sorted(index.step) == list(range(len(ids)))
    suffixes = sorted(ids[i:].tolist() for i in range(len(ids)))
    assert sorted(index.last) == sorted(ids) and len(suffixes) == len(ids)


def test_scores_past_64_bits(spark, monkeypatch):
    big = 3_000_000_000
    rows = [("en", 0, "", 9 * big, 0, 0), ("en", 1, "a", 2 * big, 0, 0), ("en", 1, "b", big + 1, 0, 0), ("en", 2, "a b", big, 0, 0)]
    made = spark.createDataFrame(rows, "lang string, size long, phrase string, n long, before long, after long")
    monkeypatch.setattr(phrases, "phrase_totals", lambda *a: made)
    (row,) = phrases.collocations(None).collect()
    assert row.score == 1000000 * big * big // (2 * big * (big + 1))
