from zlib import crc32

import numpy as np

from claimweave.llm import mil_quality as Q
from claimweave.llm.queries import op5_quality

SCHEMA = "doc_id long, text string, quality_score string, label int"


def test_held_out_accuracy_and_no_leak(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in op5_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    held = [r for r in scored.values() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = lab.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (Q.train(docs, x).weights["wo"] for x in (lab, flipped))
    assert np.array_equal(a, b)


def test_odd_rows_pass_through(spark):
    rows = [(1, None, "x", 1), (1, "", "x", 1), (None, "z" * 300_000, "x", 1), (2, "a b. " * 50, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = Q.train(docs, spark.createDataFrame([(2, 1), (3, None), (None, 0)], "doc_id long, quality int"))
    got = Q.score_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and all(0 < r.quality_score < 1 for r in got)
    assert Q.score_documents(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_passages_cover_the_text():
    for n in (0, 1, 1023, 5000, 1_000_000):
        data = bytes(i % 251 for i in range(n))
        own = list(Q.passages(data))
        assert b"".join(own) == data and len(own) == max(1, round(n / Q.PASSAGE))


def test_a_long_text_scores_as_its_parts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "bad", "word", "x|y", "End."], 1000)) for _ in range(40)]
    model = Q.fit([Q.training_bag(t) for t in texts], [i % 2 for i in range(40)])
    part = (texts[0] * 2)[: 5 * Q.PASSAGE]
    one, many = model.score([part, part * 1000])
    assert abs(one - many) < 1e-9
    whole = model.score([*texts, None, "", texts[3] * 30])
    bags = [Q.training_bag(t, 10**6) for t in [*texts, None, "", texts[3] * 30]]
    plain = model.forward(np.concatenate(bags).astype(float), np.cumsum([0, *(len(b) for b in bags[:-1])]))["y"]
    assert np.abs(whole - plain).max() < 1e-9
    monkeypatch.setattr(Q, "BLOCK", 3)
    assert np.abs(whole - model.score([*texts, None, "", texts[3] * 30])).max() < 1e-9
    assert len(Q.training_bag(texts[0] * 100)) == Q.TRAINING_PASSAGES


def test_texts_that_differ_in_words_only(spark):
    rng = np.random.default_rng(2)
    fine, poor = ([f"{w}{k:02d}" for k in range(40)] for w in ("ab", "cd"))
    both = [f"ef{k:02d}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choice(both, 300).tolist()
        for at in rng.integers(0, 300, 15):  # one word in twenty tells
            words[at] = rng.choice(fine if i % 2 else poor)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.score_documents(docs, Q.train(docs, marks)).withColumn("held", Q.held_out()).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 2) for r in got if r.held]) > 0.9


def test_repeated_and_disagreeing_labels(spark):
    docs = spark.createDataFrame([(2, "b b"), (2, "a a"), (3, "c c"), (5, "d d")], "doc_id long, text string")
    labels = [(2, 1), (2, 1), (3, 0), (3, 1), (5, 0)]
    once = spark.createDataFrame([(2, "a a"), (5, "d d")], "doc_id long, text string")
    a = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = Q.train(once, spark.createDataFrame([(2, 1), (5, 0)], "doc_id long, quality int"))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_without_labels_every_text_has_the_same_score(spark, tmp_path):
    spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [(r.score, r.predicted) for r in op5_quality(spark, str(tmp_path)).collect()] == [(0.5, 1), (0.5, 1)]


def test_gradient():
    rng = np.random.default_rng(0)
    bags, labels = [rng.random((k, Q.FEATURES)) for k in (1, 3, 2)], np.array([0.0, 1.0, 1.0])
    model = Q.fit(bags, [0, 1, 1])
    starts = np.array([0, 1, 4])
    x = np.concatenate(bags)

    def loss():
        y = model.forward(x, starts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    grads = model.gradient(model.forward(x, starts), labels, starts)
    for name, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6
