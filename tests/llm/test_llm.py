"""Operators for training data against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import itertools
import re

import numpy as np
import pytest
import regex
import tiktoken

from bidlens.llm import bpe, common, forest, licenses, minhash, mixing, sharding, suffix, topk, toxicity, urls

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"
WORDS = [f"w{i}" for i in range(400)]


def sentence(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = sentence(1, 400)
NEAR = LONG.replace(LONG.split()[200], "changed", 1)
TEXTS = [
    (1, LONG), (2, NEAR), (3, LONG.upper()), (4, sentence(2, 60) + " ß " + LONG[:400]), (5, None), (6, ""), (7, "  \n\t "),
    (8, "one two"), (9, "One  two"), (10, "a" * 700), (10, "a" * 700), (11, "shared " + sentence(3, 80)), (11, sentence(4, 80)),
    (None, LONG), (12, sentence(5, 30000)), (13, "CC by, all RIGHTS reserved. cc by cc by"), (14, "Relased under teh MIT license."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in TEXTS]
    return common.stored(spark.createDataFrame(rows, DOC), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def lower(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash(docs, none):
    sets = [(i, shingles(t)) for i, t in TEXTS]
    root = {i: i for i, _ in sets if i is not None}
    for (i, a), (j, b) in itertools.product(sets, sets):
        if None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = root[i], root[j]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = sorted(minhash.near_duplicates(docs).collect(), key=str)
    want = [(i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]}, n_shingles={r[1]}, component_id={r[2]}, kept={r[3]})")
    assert minhash.near_duplicates(none).collect() == []
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i, _ in sets if i is None or root[i] == i}


def test_minhash_compares_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(120)]
    # Copies with changed words: some link in chains, some with none; all share buckets.
    texts = [" ".join(f"x{k % 7}" if i % 29 in range(k % 4) and i < 15 * (k % 9) else w for i, w in enumerate(base)) for k in range(60)]
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, side=20, hashes=2).collect()}
    assert 1 < len(set(root)) < len(root)
    assert got == dict(enumerate(root))


def test_minhash_with_more_blocks_than_nodes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 20)
    # Groups of three nodes, dealt to 8 blocks: the first two share 48 of 52 shingles, the third has 30 others.
    sets = {9 * g + k: np.arange(50 if k < 2 else 30, dtype=np.uint64) + np.uint64(1000 * g + (0, 2, 500)[k]) for g in range(1, 6) for k in range(3)}
    rows = spark.createDataFrame([(n - n % 9, n, len(s), n, len(s)) for n, s in sets.items()], "a long, b long, size long, root long, shared long")
    full = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, shingles binary")
    got = {tuple(sorted(r)) for r in minhash._linked_in_blocks(rows, full, 85).collect()}
    assert got == {(9 * g, 9 * g + 1) for g in range(1, 6)}


def test_minhash_joins_a_group_without_a_common_leader(spark):
    base = sentence(7, 200).split()
    rows = [(i, " ".join(base[i * 5 :] + base[: i * 5])) for i in range(0, 8)] + [(i, " ".join(base[: 200 - 4 * (i - 20)])) for i in range(20, 40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, j in itertools.combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            x, y = root[i], root[j]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == root


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    rows = []
    for k in range(20):
        words = sentence(100 + k, 204).split()
        # Four changed words leave 0.82 of the shingles in common, six leave 0.74.
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join("new" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)))]
        rows += [(10 * k + 2, " ".join("other" if i in range(20, 200, 30) else w for i, w in enumerate(words)))]
    sets = {i: shingles(t) for i, t in rows}
    share = {i: len(sets[i] & sets[i - i % 10]) / len(sets[i] | sets[i - i % 10]) for i in sets}
    assert all(0.8 <= share[i] < 0.85 if i % 10 == 1 else share[i] < 0.8 for i in sets if i % 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i in sets if i % 10 != 1}


def test_connected_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in common.connected(edges, "test").collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_bpe(docs, none):
    import public_tokenizers as public

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, *bpe.vocabulary(), chunk=1000), *bpe.vocabulary()).collect()
    assert len(got) == len(TEXTS) and got[0].score == "x"
    for r in got:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == plain.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(none, *bpe.vocabulary()), *bpe.vocabulary()).collect() == []


def repeats(texts, length):
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((i, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        for i, p in where if len(where) > 1 else ():
            gone[i][p : p + length] = True
    return gone


@pytest.mark.parametrize("bucket", [suffix.BUCKET, 1])
def test_suffix(docs, none, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    texts = [(t or "").encode() for _, t in TEXTS]
    want = sorted((t, bytes(np.frombuffer(t, np.uint8)[~g])) for t, g in zip(texts, repeats(texts, 200)))
    got = suffix.remove_repeats(docs).collect()
    assert sorted(((r.text or "").encode(), bytes(r.kept)) for r in got) == want
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.removed)
    assert suffix.remove_repeats(none).collect() == []


def test_suffix_sort_is_a_suffix_sort():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.choice([97, 98], rng.integers(210, 300)).astype(np.uint8)) for _ in range(60)]
    parts += [p[:205] + b"x" * 20 for p in parts[:20]]
    place = np.array([len(p) % 7 for p in parts])
    s = suffix.Suffixes(parts, place, np.zeros(len(parts), dtype=np.int64))
    assert [parts[i][place[i] :] for i in s.sorted()] == sorted(p[a:] for p, a in zip(parts, place))


def test_forest(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.vstack([base, base[:100] + 0.05 * rng.standard_normal((100, 16)), base[:3]]))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1])]
    got = {r.vec_id: r for r in forest.embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=40).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and (i < 900 or i > 904)]
    links = {i: {j for j, w in good if j != i and len(w) == len(v) and v @ w >= 0.9 * np.sqrt((v @ v) * (w @ w))} for i, v in good}
    found = sum(got[i].n_links for i in links)
    assert all(got[i].n_links <= len(links[i]) for i in links) and found >= 0.95 * sum(map(len, links.values()))
    assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept and got[902].n_links == 0 and got[None].kept
    assert forest.embedding_near_dups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_forest_links_a_large_group_of_near_vectors(spark):
    rng = np.random.default_rng(8)
    center = rng.standard_normal(64)
    # 5,000 distinct vectors about one center, of whose pairs most are linked, and 3,000 without a group.
    rows = np.vstack([center + 0.3 * rng.standard_normal((5000, 64)), rng.standard_normal((3000, 64))]).astype(np.float32)
    unit = forest.unit(rows.astype(float))
    near = unit @ unit.T >= 0.9
    want = near.sum(axis=1) - 1
    assert want.sum() > 0.5 * 5000**2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = np.array([r.n_links for r in sorted(forest.embedding_near_dups(df).select("vec_id", "n_links").collect())])
    print("share of links", got.sum() / want.sum())
    assert (got <= want + 1).all() and got.sum() >= 0.99 * want.sum()


def test_topk(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (401, None), (402, [float("inf")] * 8), (403, [1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {n: [int(np.floor(256 * x)) for x in v] for n, v in rows if n is not None and v and np.isfinite(v).all()}
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=64, batch=4).collect()
    candidates = [(n, whole[n]) for n, v in rows if n in whole]
    for q in range(0, 401, 50):
        if q in whole:
            want = sorted((-sum(a * b for a, b in zip(v, whole[q])), n) for n, v in candidates if n != q and len(v) == len(whole[q]))[:5]
            assert [(r.rank, r.vec_id, r.score) for r in sorted(got) if r.query_id == q] == [(k + 1, n, -s) for k, (s, n) in enumerate(want)]
    none = df.where("false")
    assert topk.top_k(none, none, 5).collect() == []


def test_topk_sends_no_batches_through_the_driver(spark, monkeypatch):
    # Each query is a batch and meets every block: the product was broadcast, as the batches alone are small.
    rng = np.random.default_rng(8)
    whole = rng.integers(-9, 10, (240, 4))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "GROUP", 3, raising=False)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 3, block=20, batch=1)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    assert len(found) == 24 * 3
    for q in range(0, 240, 10):
        want = sorted((-int(v @ whole[q]), n) for n, v in enumerate(whole) if n != q)[:3]
        assert [found[q, k + 1] for k in range(3)] == [(n, -s) for s, n in want]


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [(p.word, p.label) for p in got[13].base_places] == [(0, "cc-by"), (2, "reserved"), (5, "cc-by"), (7, "cc-by")] and got[13].n_words == 9
    assert [(n.label, n.first_word, n.last_word, n.edits) for n in got[14].notices] == [("mit", 0, 4, 3)]
    assert got[5].n_words == 0 and got[5].base_places == [] and licenses.license_scan(none).collect() == []


def test_license_notices_equal_a_scan_without_seeds():
    scan, rng = licenses.Scanner(licenses.NOTICES), np.random.default_rng(8)
    for phrase, label, k in licenses.NOTICES:
        for _ in range(20):
            text = list("some words before " + phrase + " and after")
            for _ in range(rng.integers(0, k + 3)):
                text[rng.integers(18, 18 + len(phrase))] = "q"
            text = "".join(text)
            plain = regex.search(f"(?b)(?:{regex.escape(phrase)}){{e<={k}}}", text)
            assert (label in {m[0] for m in scan.matches(text)}) >= (plain is not None)


def test_license_notices_close_together_are_all_found():
    scan, rng = licenses.Scanner(licenses.NOTICES), np.random.default_rng(9)
    assert [m[1:4] for m in scan.matches("all rightz reserved all rights reserved")] == [(0, 19, 1), (20, 39, 0)]

    def plain(pattern, text, low, high):
        m = pattern.search(text, low, high)
        return [] if not m else [*plain(pattern, text, low, m.start()), (*m.span(), sum(m.fuzzy_counts)), *plain(pattern, text, m.end(), high)]

    for phrase, label, k in licenses.NOTICES:
        alone = licenses.Scanner([(phrase, label, k)])
        for _ in range(5):
            copies = [list(phrase) for _ in range(4)]
            for c in copies:
                for _ in range(rng.integers(0, 2)):
                    c[rng.integers(2, len(phrase) - 2)] = "z"
            text = "before " + " ".join(map("".join, copies)) + " after"
            found = [m[1:4] for m in alone.matches(text)]
            assert found == plain(regex.compile(f"(?b)(?:{regex.escape(phrase)}){{e<={k}}}"), text, 0, len(text)) and len(found) == 4


def test_sharding(docs, none):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, less) if a != 6) < 0.25 * 1009
    got = sharding.place(docs, "doc_id", names, 1009, ["lang"]).collect()
    assert len(got) == len(TEXTS) and len({r.shard for r in got if r.doc_id == 10}) == 1
    for r in got:
        if r.doc_id is not None:
            assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 1009 and r.shard == names[table[r.slot]]
    assert sharding.place(none, "doc_id", names, 1009).collect() == []
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_mixing(spark, docs, none):
    tokens = mixing.word_count(F.col("text"))
    rows = [(i, sentence(i, 20), "en", "big" if i % 10 else f"small{i % 3}", 0, "x", "y") for i in range(600)]
    many = common.stored(spark.createDataFrame(rows, DOC), "test-mix")
    for entropy, repeats_ in ((0.9, None), (None, 2.0)):
        mix = mixing.mixture(many, tokens, entropy, repeats_, 600 * 20.0)
        shares = {r["name"]: (r.tokens / 12000, r.weight, r.epochs) for r in mix.sources.collect()}
        p, q, e = map(np.array, zip(*shares.values()))
        assert np.allclose(q, p**mix.exponent / (p**mix.exponent).sum())
        if entropy:
            assert -(q * np.log(q)).sum() <= 0.9 * np.log(len(p)) + 1e-6
        else:
            assert e.max() <= 2 + 1e-6
        used = mixing.mixed(many, mix, tokens, block_tokens=500).groupBy("source").agg(F.sum(F.col("copies") * 20).alias("n")).collect()
        for r in used:
            assert shares[r.source][1] * 12000 - 20 <= r.n <= shares[r.source][1] * 12000 + 1e-3
    kept = mixing.repeated_by_weight(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in TEXTS}
    assert mixing.repeated_by_weight(none).collect() == []


def test_mixing_counts_words(spark):
    rows = [(" " * 1000, 0), ("one  two", 2), ("\tone\n\n    two\r\nthree ", 3), ("a\x0bb\x0cc", 3), ("", 0), (None, 0), ("word", 1)]
    got = spark.createDataFrame(rows, "text string, want long").select("want", mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [r.want for r in got]


def test_toxicity(spark, docs, none, data):
    table = common.table(spark, data, "documents").select("doc_id", "text")
    model = toxicity.train(table, common.table(spark, data, "labels"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    only = toxicity.train(table, common.table(spark, data, "labels").where("toxic = 0"))
    assert only.trees is None and {r.predicted for r in toxicity.score(docs, only).collect()} == {0}
    assert toxicity.without_toxic(none, common.table(spark, data, "labels")).collect() == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, folder).where("held_out").join(common.table(spark, folder, "labels"), "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/1"), (2, "https://x.org/"), (3, "http://org?x"), (4, "no scheme"), (5, None), (6, "http://m.example.org/en/12.html#a"), (7, "ftp://b.com/de/x"), (8, "http://c.com/fr/?q=1"), (9, "http://notexample.net/en/1"), (9, "http://notexample.net/en/1"), (None, "http://org/a")]
    rows += [(100 + i, f"http://bad.net/{'spam' if i % 2 else 'ham'}/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (1, None)], "page_id long, bad int")
    got = [r for r in urls.url_filter(pages, labelled).collect()]
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    want = {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("x.org", "/", "org/", "allow"), 3: ("org", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("m.example.org", "/en/12.html", "example.org/en/1", "block"), 7: ("b.com", "/de/x", "com/de/", "block"), 8: ("c.com", "/fr/", "com/fr/", "allow")}
    assert {i: (by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in want} == want
    assert {by[100 + i].verdict for i in range(1, 40, 2)} == {"block"} and {by[100 + i].verdict for i in range(0, 40, 2)} == {"allow"}
    assert urls.url_filter(pages.where("false"), labelled).collect() == []


def test_urls_part_at_level_six(spark):
    rows = [(i, f"https://a.test/q/r/s/t/u/{'spam' if i % 2 else 'good'}/page") for i in range(40)] + [(40, "https://a.test/q/r/s/t/u/new/page")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(40)], "page_id long, bad int")
    got = {r.page_id: r for r in urls.url_filter(pages, labelled, rules=[]).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(40))
    assert got[0].template != got[1].template and got[40].verdict == "allow"
