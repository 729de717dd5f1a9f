import math
import zlib
from collections import Counter

import numpy as np

from tidegate.llm import lm
from conftest_llm import plain_words


def expected(rows):
    count = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update([*plain_words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = [*plain_words(t), None]
        out.append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def test_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in lm.op9_pitman_yor(spark, sf_dir).collect()}
    rows = list(texts.items())
    assert set(got) == set(texts)
    for (i, _), (n, known, train, base) in zip(rows, expected(rows)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = lm.score_corpus(odd_documents).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=key)
    assert mine == sorted(((i, n, k, t, round(b, 4)) for (i, _), (n, k, t, b) in zip(rows, expected(rows))), key=key)
    assert lm.score_corpus(no_documents).count() == 0


def test_seating():
    r = np.random.default_rng(0)
    for c, mass, d in ((1, 0.3, 0.5), (2, 0.5, 0.5), (20, 1.0, 0.3), (500, 2.0, 0.4)):
        got = np.mean(lm.seat(np.full(4000, c), np.full(4000, mass), d, r))
        t, total = np.ones(4000), 0.0  # one customer at a time
        for n in range(1, c):
            t += r.random(4000) < mass / (mass + n - d * t)
        assert abs(got - t.mean()) < 0.05 * t.mean() + 0.05
    assert lm.seat(np.array([0, 1]), np.ones(2), 0.5, r).tolist() == [0, 1]


def test_predictive_is_a_distribution():
    """Over all words and the unknown one, each context's probabilities sum to one."""
    r = np.random.default_rng(0)
    words, contexts = 50, 3
    keys = np.array(sorted((w << 5) | k for w in range(1, words + 1) for k in range(contexts)), np.uint64)
    counts = r.integers(0, 6, len(keys))
    counts[:3] = 1
    kinds = (keys & lm.LOW).astype(int)
    b = lm.Block(keys, counts, {})
    sizes = {"c": np.bincount(kinds, counts, lm.CONTEXTS), "t": np.bincount(kinds, b.tables, lm.CONTEXTS), "words": float((b.total > 0).sum()),
             "t0": b.root_tables.sum(), "c0": b.served.sum(), "d0": 0.5, "d1": 0.6}
    b.sizes = sizes
    seen = (b.total > 0)[b.owner]
    p = np.bincount(kinds, b.predictive() * seen, lm.CONTEXTS)[:contexts]
    new = (lm.STRENGTH + 0.5 * sizes["t0"]) / (sizes["words"] + 1) / (lm.STRENGTH + sizes["c0"])
    unknown = (lm.STRENGTH + 0.6 * sizes["t"][:contexts]) * new / (lm.STRENGTH + sizes["c"][:contexts])
    assert np.allclose(p + unknown, 1)


def test_the_previous_word_itself_is_a_context(spark):
    """Words of one class of which each has followers of its own."""
    pairs = [("red", "apple"), ("big", "stone"), ("old", "house"), ("wet", "grass")]
    rows = [(i, " ".join(pairs[i % 4])) for i in range(400)]
    rows += [(1000 + i, f"{a} {b}") for i, (a, b) in enumerate((p[0], q[1]) for p in pairs for q in pairs)]
    got = {r.doc_id: r.score for r in lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = [got[1000 + 5 * i] for i in range(4)]
    other = [got[1000 + i] for i in range(16) if i % 5]
    assert min(same) > max(other) + 0.5


def test_predictive_of_previous_words_is_a_distribution():
    r = np.random.default_rng(1)
    pairs = np.array([(w, u) for w in range(1, 41) for u in range(6)], np.uint64)
    keys, before = (pairs[:, 0] << lm.SHIFT) | (pairs[:, 1] % np.uint64(2)), pairs[:, 1]
    keys, before, counts = lm.summed_pairs(keys, before, r.integers(0, 4, len(keys)))
    counts[:6] = 1
    u = before.astype(int)
    b = lm.Contexts(keys, before, counts, {}, np.bincount(u, counts)[u], np.bincount(u, counts > 0)[u])
    p = b.parent
    b.sizes = p.sizes = lm.class_sizes(lm.seated(b)) | {"words": float((p.total > 0).sum()), "d0": 0.4, "d1": 0.5, "d2": 0.6}
    s = b.sizes
    total = np.bincount(u, b.predictive() * (b.seen > 0))
    new = (lm.STRENGTH + s["d0"] * s["t0"]) / (s["words"] + 1) / (lm.STRENGTH + s["c0"])
    new = (lm.STRENGTH + s["d1"] * s["t"][:2]) * new / (lm.STRENGTH + s["c"][:2])
    c, t = np.bincount(u, counts), np.bincount(u, counts > 0)
    assert np.allclose(total + (lm.STRENGTH + s["d2"] * t) * new[np.arange(6) % 2] / (lm.STRENGTH + c), 1)


def test_rounds_shuffle_sizes_and_chunks_get_no_fingerprints(spark, tmp_path):
    """The blocks are read where they lie, and a chunk that two tasks read in parts is scored whole."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(300)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    cut = lm.chunked(docs).repartition(7, "doc_id")
    state = lm.stage_buckets(lm.gathered(lm.chunk_counts(cut, 2)), "restaurants", 4, "block")
    whole = lm.gathered(lm.chunk_counts(lm.chunked(docs).coalesce(1), 2))
    read = lambda df: sorted((r["block"], lm.unpacked(r["keys"], "<u8").tobytes(), bytes(r["before"]), lm.unpacked(r["counts"], "<i8").tobytes(),
                              [lm.unpacked(x, "<i4").tobytes() for x in r["held"]]) for r in df.collect())
    assert read(state) == read(whole)
    numbers = lm.numbered_contexts(state, 1)
    sizes, contexts = lm.corpus_sizes(state, numbers, 1)
    out = lm.dictionaries(state, contexts, sizes, 1)
    assert set(out.columns) == {"chunk", "block", "score", "seen"}
