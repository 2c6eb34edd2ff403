"""Columns with clashing names, long repeated notices, written shards, and the pipeline as a whole."""

import time

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from bidlens.llm import bpe, common, licenses, minhash, mixing, sharding, toxicity

WORDS = [f"w{i}" for i in range(3000)]


def sentence(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_mixing_takes_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", sentence(i, 5 + 40 * (i % 3 == 0)), "a", 1, 2, 3, "r") for i in range(60)] + [(None, None, None, "a", 1, 2, 3, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_name string, mix_total int, mix_tokens int, mix_draw int, mix_row string")
    out = mixing.repeated_by_weight(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {*range(60), None}
    tokens = mixing.word_count(F.col("text"))
    mix = mixing.mixture(docs, tokens, repeats=2.0, budget=3000.0)
    used = {r["name"]: r for r in mix.sources.collect()}
    made = mixing.mixed(docs, mix, tokens, block_tokens=50).withColumn("t", tokens).collect()
    for name, s in used.items():
        spent = sum(r.t * r.copies for r in made if (r.source or mixing.UNNAMED) == name)
        longest = max((r.t for r in made if (r.source or mixing.UNNAMED) == name), default=0)
        # A source spends at most its budget, and falls short by less than a document.
        assert s.tokens == 0 or s.epochs * s.tokens - longest < spent <= s.epochs * s.tokens + 1e-6


def test_weights_equal_plain_arithmetic(spark):
    rows = [(i, s, "x " * n) for i, (s, n) in enumerate([("a", 1000), ("b", 100), ("c", 10), ("d", 400)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = mixing.word_count(F.col("text"))
    share = np.array([1000, 100, 10, 400]) / 1510

    def weights(a):
        w = share**a
        return w / w.sum()

    def entropy(w):
        return -(w * np.log(w)).sum()

    mix = mixing.mixture(docs, tokens, entropy_share=0.9)
    found = np.array([r.weight for r in mix.sources.orderBy("name").collect()])
    assert np.allclose(found, weights(mix.exponent)) and abs(found.sum() - 1) < 1e-12
    assert entropy(found) <= 0.9 * np.log(4) + 1e-9 and entropy(weights(mix.exponent - 1e-6)) > 0.9 * np.log(4) - 1e-6


def test_added_columns_do_not_meet_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, __in_0 string, __in__0 string")
    (row,) = bpe.encode(docs, *bpe.vocabulary()).collect()
    assert (row["__in_0"], row["__in__0"]) == ("x", "y") and len(row.token_ids) == 8


def test_shards_are_written_and_read_back(spark, tmp_path):
    rows = spark.range(500).withColumn("x", F.lit("v"))
    placed = sharding.place(rows, "id", sharding.shard_names(4), slots=101)
    sharding.write_shards(placed, str(tmp_path / "shards"), files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == [f"shard=shard-{i:05d}" for i in range(4)]
    columns = ["id", "x", "slot", "shard"]
    assert back.count() == 500 and back.select(columns).exceptAll(placed.select(columns)).isEmpty()


def test_a_long_text_of_one_notice_is_scanned_in_proportion():
    scan = licenses.scanner(licenses.NOTICES)
    begin = time.time()
    _, _, notices = licenses.scan_text("released under teh mit license " * 20_000, scan, licenses.BASE)
    assert len(notices) == 20_000 and time.time() - begin < 30
    assert [n["first_word"] for n in notices[:3]] == [0, 5, 10] and notices[-1]["last_word"] == 99_999


def test_base_columns_on_several_texts(spark, tmp_path):
    texts = ["cc by x CC-BY", "all rights reserved", "nothing", None, "general public license cc by", "Released under the MIT license"]
    spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    assert got == {
        0: (5, 2, 0, 3, "cc-by", "cc-by", 1.0), 1: (3, 1, 0, 0, "reserved", "reserved", 1.0), 2: (1, 0, None, None, "", "", 0.0), 3: (0, 0, None, None, "", "", 0.0),
        4: (5, 2, 0, 3, "cc-by,gpl", "cc-by,gpl", 1.0), 5: (5, 0, None, None, "", "mit", 1.0),
    }


def test_table_keys_lose_no_shared_key(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 5, rng.integers(0, 6, 4).tolist(), rng.integers(0, 6, 4).tolist()) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, size long, left array<long>, right array<long>")
    keys: dict = {}
    for n, _, left, right in rows:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                keys.setdefault((i, x, j, y), []).append(n)
    wanted = sorted(tuple(v) for v in keys.values() if len(v) > 1)
    found: dict = {}
    for r in minhash.shared_keys(nodes).collect():
        found.setdefault(r.key, []).append(r.node)
    assert sorted(tuple(sorted(v)) for v in found.values()) == wanted


def test_a_rare_class_is_kept_in_the_sample(spark):
    bad = "you stupid idiot loser"
    rows = [(i, f"{sentence(i, 20)} {bad if i % 50 == 0 else 'fine words'}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0), 1) for i in range(4000)] + [(None, 1, 1), (7, None, 1), (0, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, sample_rows=800)
    found = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").where("toxic is not null")
    (share,) = found.where("toxic = 1").agg(F.avg("predicted")).first()
    (wrong,) = found.where("toxic = 0").agg(F.avg("predicted")).first()
    assert share == 1.0 and wrong < 0.01
    alone = toxicity.train(docs, labels.where("toxic = 0"))
    assert alone.trees is None and toxicity.score(docs.limit(3), alone).where("predicted = 1").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_name string, node long, score double, keep string"


def pipeline_folder(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "m", 7, 0.5, "k") for i, t, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_equals_plain_stages(spark, tmp_path):
    passage = sentence(99, 80)
    rows = [(i, sentence(i, 60), f"s{i % 2}") for i in range(12)]
    rows += [(20, rows[3][1], "s0"), (21, rows[4][1].replace(rows[4][1].split()[30], "changed", 1), "s1")]
    rows += [(30, f"{sentence(200, 30)} {passage} {sentence(201, 30)}", "s0"), (31, f"{sentence(202, 90)} {passage} {sentence(203, 30)}", "s1")]
    rows += [(40, None, None), (41, "", "s0"), (42, "a few words", "s1"), (None, "no id here", "s0")]
    pipeline_folder(spark, tmp_path, rows)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "token_ids"]
    found = out.collect()
    # Copies of 3 and 4 go; all others stay, once at least.
    texts = {i: t for i, t, _ in rows if i not in (20, 21)}
    assert {r.doc_id for r in found} == set(texts)
    data = {i: (t or "").encode() for i, t in texts.items()}
    places: dict = {}
    for i, line in data.items():
        for a in range(len(line) - 199):
            places.setdefault(line[a : a + 200], []).append((i, a))
    gone = {(i, a + k) for where in places.values() if len(where) > 1 for i, a in where for k in range(200)}
    assert gone
    ranks, pattern = bpe.vocabulary()
    enc = bpe.encoder(open(ranks, "rb").read(), pattern)
    assert isinstance(enc, tiktoken.Encoding)
    for r in found:
        kept = bytes(b for k, b in enumerate(data[r.doc_id]) if (r.doc_id, k) not in gone)
        assert (r.text or "").encode() == kept and (r.text is None) == (texts[r.doc_id] is None)
        assert enc.decode_bytes(np.frombuffer(r.token_ids, "<u4").tolist()) == kept
        assert (r.mix_name, r.node, r.score, r.keep) == ("m", 7, 0.5, "k")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline_folder(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "token_ids" in out.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "suffix", "mixing", "bpe"]
    assert common.table(spark, str(tmp_path), "documents").count() == 0
