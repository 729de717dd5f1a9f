import zlib

import numpy as np

from tidegate.llm import quality


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have one bad document in the held-out fold
    rows = {r.doc_id: r for r in quality.op1_quality(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(rows[i].score, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9  # held-out AUC
    assert np.mean(np.array(good) >= 0.3) > 0.95


def test_gradient():
    net, r = quality.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) + r.normal(0, 0.01, v.shape) for k, v in net.p.items()}
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (10, 300, 700)]
    x, count = quality.symbols(texts)
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def windows(x):
        e = net.p["embed"][x].reshape(-1)
        n = (len(x) - quality.WIDTH) // quality.STEP
        return np.stack([e[i * quality.STEP * quality.EMBED:][: quality.WIDTH * quality.EMBED] for i in range(n)])

    net.windows = windows
    loss = lambda: float((np.log1p(np.exp(net.forward(x, count))) - y * net.forward(x, count)).sum())
    g = net.gradient(x, count, y, w)
    for name in ("top", "dense", "filters", "bias", "out"):
        flat, got = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in r.choice(len(flat), min(5, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-5 - got[k]) < 1e-3 + 0.02 * abs(got[k]), name


def plain_score(net, text):
    """The probability of one text by the description, position by position and chunk by chunk."""
    p, n = {k: v.astype(float) for k, v in net.p.items()}, max(1, -(-len(text) // quality.BLOCK))
    x = list(text) + [quality.PAD] * (n * quality.BLOCK - len(text) + quality.WIDTH)
    at = [np.concatenate([p["embed"][b] for b in x[k: k + quality.WIDTH]]) @ p["filters"] for k in range(0, n * quality.BLOCK, quality.STEP)]
    size = quality.PER_BLOCK
    del at[-1]  # it would end beyond the last block
    blocks = [np.maximum(np.max(at[k * size: (k + 1) * size], axis=0) + p["bias"], 0) for k in range(n)]
    units = [np.maximum(np.maximum(blocks[k], blocks[min(k + 1, n - 1)]) @ p["dense"] + p["unit"], 0) for k in range(n)]
    return 1 / (1 + np.exp(-(np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)]) @ p["top"] + p["out"][0])))


def test_scores_equal_the_description():
    net, r = quality.Network(5), np.random.default_rng(1)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 5, 127, 128, 129, 3000)]
    assert np.abs(net.score(texts) - [plain_score(net, t) for t in texts]).max() < 1e-4


def test_runs_of_blocks_change_nothing(monkeypatch):
    net, r = quality.Network(5), np.random.default_rng(1)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (10, 900, 5000)]
    x, count = quality.symbols(texts)
    whole = net.forward(x, count), net.gradient(x, count, np.array([1.0, 0, 1]), np.ones(3))
    monkeypatch.setattr(quality, "RUN", 3)
    assert np.abs(net.forward(x, count) - whole[0]).max() < 1e-4
    again = net.gradient(x, count, np.array([1.0, 0, 1]), np.ones(3))
    assert all(np.abs(again[k] - g).max() < 1e-3 for k, g in whole[1].items())


def test_sampled_rows_have_their_whole_texts(spark):
    texts = {i: f"{i} " * (40_000 if i % 3 == 0 else 20) for i in range(1, 60)}
    docs = spark.createDataFrame([(i, x) for i, x in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    usable = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    every, share = quality.labelled_sample(docs, labels)
    assert sorted(t.decode() for t, _ in every) == sorted(texts[i] for i in usable) and sum(share.values()) == len(usable)
    some, _ = quality.labelled_sample(docs, labels, limit=300_000)
    assert {t.decode() for t, _ in some} <= set(texts.values()) and 0 < sum(len(t) for t, _ in some) <= 300_000
    assert {t.decode() for t, _ in some} >= {texts[i] for i in usable if len(texts[i]) < 500}


def test_pipeline_stage_keeps_what_the_query_accepts(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = {r.doc_id: r.predicted for r in quality.op1_quality(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, y in scores.items() if y} and 0 in scores.values()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd_documents, labels)
    assert quality.score_documents(odd_documents, model).count() == odd_documents.count()
    assert quality.score_documents(no_documents, 0.5).count() == 0
    none = labels.where("false")
    assert quality.fit(odd_documents, none) == 0.5
    kept = quality.keep_good(odd_documents, none)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
