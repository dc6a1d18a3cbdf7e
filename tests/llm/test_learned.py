"""The classifiers: accuracy on documents held out of training, calibration, awkward rows; and the pipeline as a whole."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, learn, toxicity
from quern.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = QUERIES["op5_language_id"](spark, SMALL).join(docs.select("doc_id", "text", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    told = [r for r in found if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    right = np.mean([r["lang"] == r["lang_pred"] for r in told])
    assert right >= 0.95, right
    assert abs(np.mean([r["score"] for r in told]) - right) < 0.1  # calibrated


def test_languages_of_awkward_texts(spark):
    texts = ["the cat and the dog", "le chat et le chien", "der Hund und die Katze"] * 20
    rows = [(i, t, ("en", "fr", "de")[i % 3]) for i, t in enumerate(texts)] + [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (None, "the cat", "en"), (104, "a", "en"), (104, "le chat " * 5000, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(7))
    got = langid.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == by[102]["lang_pred"] == "und" and by[None]["held_out"]
    none = langid.identify(df.where("lang is null"))
    assert [r["lang_pred"] for r in none.collect()] == ["und"]


def test_languages_learned_from_a_few_documents(spark):
    """Fewer than five training rows leave none to calibrate on."""
    data = [(i, t, x) for i, (t, x) in enumerate([("le chat et la souris", "fr"), ("the cat and the mouse", "en"), ("...", "en"), (None, "fr")] * 2)]
    for few in (data[:2], data[:4], data):
        df = spark.createDataFrame(few, "doc_id long, text string, lang string")
        got = {r["doc_id"]: r for r in langid.identify(df).collect()}
        assert sorted(got) == [i for i, _, _ in few]
        assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (i % 4 > 1) for i, r in got.items())


def test_weights_are_sparse(spark):
    import pickle

    model = pickle.loads(langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet")))
    weights = model[1]
    assert 0.02 < np.mean(weights == 0) < 1 and model[3] > 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op6_toxicity"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    told = found.join(labels, "doc_id").where("held_out").toPandas()
    assert told["score"].between(0, 1).all() and ((told["score"] >= 0.5) == (told["predicted"] == 1)).all()
    assert auc(told["score"].to_numpy(), told["toxic"].to_numpy()) >= 0.9


def test_toxicity_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "words", 0.5), (5, "x" * 100_000, 0.5), (5, "again", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, None), (9, 1, 1)], "doc_id long, toxic int, quality int")
    found = toxicity.toxicity(df, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)


def test_windows_of_long_runs():
    text = ("é" * 32 + "schlimm" * 20 + " kurz " + "Z" * 65).encode()
    raw, start, end, hash_, first = toxicity._words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = [raw[s:e] for s, e in zip(start, end)]
    assert first.tolist() == [0, len(got)] and got[-2:] == [b"z" * 64] * 2 and b"kurz" in got and max(map(len, got)) == 64
    assert {i for s, e in zip(start, end) for i in range(s, e)} == set(range(len(text))) - {i for i, c in enumerate(text) if c == 32}
    assert len(set(hash_)) == len(set(got)) and hash_[-1] == hash_[-2]


def test_toxic_passage_within_an_unbroken_run(spark):
    """Behind 64 bytes without a blank, in training and in scoring."""
    rng = np.random.default_rng(3)
    kana = [chr(c) for c in range(0x3042, 0x3090)]
    words = ["".join(rng.choice(kana, 7)) for _ in range(400)]
    bad = ["".join(rng.choice(kana, 7)) for _ in range(20)]
    run = lambda pool: "あ" * 25 + str(rng.choice(pool))
    rows = [(i, " ".join(run(bad if i % 2 and j % 3 == 0 else words) for j in range(30))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    found = toxicity.toxicity(df, labels).where("held_out").collect()
    assert auc(np.array([r["score"] for r in found]), np.array([r["doc_id"] % 2 for r in found])) >= 0.9


def test_bounds_of_windows_are_parameters(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, 8)) for _ in range(320)]
    rows = [(i, " ".join(rng.choice(words[300:] if i % 2 and j % 3 == 0 else words[:300]) for j in range(30))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    usual, few = toxicity.fit(df, labels), toxicity.fit(df, labels, ordinary_windows=200)
    assert len(usual) > 1000  # with dictionaries
    assert usual == toxicity.fit(df, labels, toxic_windows=30_000, ordinary_windows=100_000) and usual != few


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_against_brute_force(spark, sf, pipeline):
    """Each filtering stage on its own input, then the packed pieces."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    stages = dict(pipeline.STAGES)

    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.95 * docs.where("text is not null and length(text) > 20").count()
    data = sorted((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect())

    lines = stages["line_dedup"](spark, spark.createDataFrame(kept.collect(), docs.schema), sf)
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    want = {i: (n, removed, sha) for i, n, removed, sha in brute.op10(data)}
    import hashlib

    for i, text in got.items():
        assert hashlib.sha256((text or "").encode()).hexdigest() == want[i][2]
    assert all(want[i][1] > 0 for i in set(want) - set(got))

    near = stages["near_dedup"](spark, lines, sf)
    rows = sorted(got.items())
    assert {r["doc_id"] for r in near.collect()} == {i for i, _, _, keep in brute.op4(rows, 5) if keep}

    clean = stages["decontamination"](spark, near, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in brute.op2(left, items) if not x[5]}

    packed = stages["packing"](spark, clean, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}


def test_pipeline_runs(spark, sf, pipeline):
    found = pipeline.run(spark, sf)
    assert found.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)


def test_pipeline_of_awkward_rows(spark, sf, tmp_path, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("own")).withColumn("score", F.lit(1.5)).withColumn("n_hit", F.lit(9))
    more = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs.unionByName(more).unionByName(docs.limit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert df.select("kept").distinct().collect() == [("own",)] and pipeline.STAGES[-1][1](spark, df, sf).count() > 0


def test_regularised_leader_against_plain_python():
    """The published update, a coordinate at a time, over the same order of documents."""
    rng = np.random.default_rng(3)
    docs = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(30)]
    y, classes, alpha, beta, l1, l2 = rng.integers(0, 3, 30), 3, 0.5, 1.0, 0.05, 0.05
    found = langid.ftrl(docs, y, classes, alpha, beta, l1, l2, epochs=2, seed=5)
    z, n = {}, {}

    def weight(i, c):
        at = z.get((i, c), 0.0)
        return 0.0 if abs(at) <= l1 else -(at - (l1 if at > 0 else -l1)) / ((beta + n.get((i, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for d in order.permutation(len(docs)):
            pairs = list(zip(docs[d][0].tolist(), docs[d][1].tolist()))
            w = {(i, c): weight(i, c) for i, _ in pairs for c in range(classes)}
            s = [sum(x * w[i, c] for i, x in pairs) for c in range(classes)]
            e = [np.exp(v - max(s)) for v in s]
            for i, x in pairs:
                for c in range(classes):
                    g = (e[c] / sum(e) - (c == y[d])) * x
                    before = n.get((i, c), 0.0)
                    n[i, c] = before + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (n[i, c] ** 0.5 - before**0.5) / alpha * w[i, c]
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(len(found))])
    assert np.allclose(found, want, atol=1e-9) and (want != 0).any() and (want == 0).any()


def test_more_languages_than_a_model_has_room_for(spark):
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    assert learn.sample(rows, "lang", 5, ("doc_id", "text"), labels=40).count() == 40
    with pytest.raises(ValueError, match="40 values of lang"):
        learn.sample(rows, "lang", 5, ("doc_id", "text"), labels=39)
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 4, f"l{i % 1100}") for i in range(2000)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="values of lang"):
        langid.fit(many)


def test_copies_of_a_text_are_sampled_one_by_one(spark):
    rows = spark.createDataFrame([(i, "the same text", "xx") for i in range(1000)], "doc_id long, text string, lang string")
    assert 50 < learn.sample(rows, "lang", 100, ("doc_id", "text")).count() < 160


def test_scores_are_what_the_dictionaries_say(spark):
    """Each text anew: its windows by regular expressions, their lengths by two compressors, shares, the logistic function."""
    import pickle

    import regex
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    (dictionaries, weights), _ = pickle.loads(model)
    both = toxicity.compressors(dictionaries)
    assert all(isinstance(c, zstandard.ZstdCompressor) for c in both)
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(120).collect()] + [(10**6, "ab" * 90 + " x"), (10**6 + 1, "ü" * 200)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        raw = regex.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())
        windows = []
        for run in regex.findall(rb"[a-z\x80-\xff]+", raw):
            starts = [0] if len(run) <= toxicity.WORD else sorted({*range(0, len(run) - toxicity.WORD, toxicity.STEP), len(run) - toxicity.WORD})
            windows += [run[s : s + toxicity.WORD] for s in starts]
        less = [min(max(len(both[1].compress(toxicity._window(w))) - len(both[0].compress(toxicity._window(w))), toxicity.LOW), toxicity.HIGH) for w in windows]
        x = [np.log1p(200 * sum(v >= toxicity.HIGH - j for v in less) / max(len(less), 1)) for j in range(9)]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(np.dot(x, weights[:-1]) + weights[-1], -30, 30)))) < 1e-9, i
