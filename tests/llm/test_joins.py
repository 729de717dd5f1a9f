import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import plain_shingles, smallest

from tidegate.llm import decontamination, jaccard, neardup, substrings
from tidegate.llm.components import components
from tidegate.session import checkpoint_root


def jaccard_links(texts, size, percent):
    sets = [plain_shingles(t, size) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j)
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def test_jaccard_query(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in jaccard.op8_jaccard(spark, sf_dir).collect()}
    ids = list(texts)
    want = smallest(ids, jaccard_links([texts[i] for i in ids], 4, 85))
    assert {i: r.component_id for i, r in rows.items()} == dict(zip(ids, want))
    assert all(rows[i].n_shingles == len(plain_shingles(t, 4)) for i, t in texts.items())


def chain(n=40, size=120, step=6, seed=0):
    """Texts that each differ a little from the one before."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in r.integers(0, 1 << 40, size)]
    out = []
    for i in range(n):
        out.append(" ".join(words))
        for k in r.integers(0, size, step if i % 9 else 3 * step):
            words[k] = f"v{r.integers(0, 1 << 40)}"
    return out


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60), (1, 95)])
def test_jaccard_links_are_whole(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    texts = [t for k in range(4) for t in chain(step=1 + k, seed=k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == smallest(range(len(texts)), jaccard_links(texts, size, percent))


def test_jaccard_odd_rows(odd_documents, no_documents):
    got = jaccard.similar_documents(odd_documents, 4, 85).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].component_id == 3 and by_id[1].component_id == 1 and by_id[2].n_shingles == 0 and by_id[7].n_shingles == 1
    kept = jaccard.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert jaccard.similar_documents(no_documents, 4, 85).count() == 0 and jaccard.keep_one(no_documents).count() == 0


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                mark[p:p + length] = True
        mark = mark[:-1]
        starts = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(mark.sum()), starts, hashlib.sha256(bytes(b for b, m in zip(d, mark) if not m)).hexdigest()))
    return out


def test_substring_query(spark, sf_dir, texts):
    rows = {r.doc_id: tuple(r)[1:] for r in substrings.op6_substrings(spark, sf_dir).collect()}
    assert rows == dict(zip(texts, plain_removal(texts.values(), 200)))


def test_substrings_of_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    monkeypatch.setattr(substrings, "FLUSH_ROWS", 20)
    r = np.random.default_rng(3)
    base = "".join(r.choice(list("abé"), 400))
    texts = ["a" * 90, base, base[37:250], base[:100] + "x" + base[100:180], "ab" * 60, "", None, base[:19], base[10:31] * 3]
    texts += ["".join(r.choice(list("ab"), 60)) for _ in range(40)]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(-1 if x.doc_id is None else x.doc_id): tuple(x)[1:] for x in substrings.deduplicate(docs, 20, 9).collect()}
    want = plain_removal(texts, 20)
    assert got == {(-1 if i == 3 else i): w for i, w in enumerate(want)}


def test_substring_odd_rows(odd_documents, no_documents):
    rows = odd_documents.collect()
    got = sorted(tuple(x)[1:] for x in substrings.deduplicate(odd_documents).collect())
    short = [(r.text or "")[:1500] if r.doc_id == 7 else r.text for r in rows]
    for x, y in zip(got, sorted(plain_removal(short, 200))):
        assert x == y or x[0] == 100000 == x[1] and x[2] == 1
    assert substrings.deduplicate(no_documents).count() == 0


def cosine_links(vectors, least):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T >= least
    return [(i, j) for j in range(len(x)) for i in range(j) if c[i, j]]


def test_vector_query(spark, sf_dir):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check_vectors(neardup.op7_neardup(spark, sf_dir), list(table), list(table.values()), 0.95)


def check_vectors(frame, ids, vectors, least):
    links = cosine_links(vectors, least)
    n = Counter(k for pair in links for k in pair)
    want = {i: (n[k], c, i == c) for k, (i, c) in enumerate(zip(ids, smallest(ids, links)))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()} == want


@pytest.mark.parametrize("d,least", [(64, 0.95), (10, 0.9), (3, 0.99), (17, 0.8)])
def test_vectors_of_any_length(spark, d, least, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_ROWS", 20)
    r = np.random.default_rng(d)
    centres = r.normal(size=(12, d))
    x = np.concatenate([c + r.normal(size=(15, d)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 12))]).astype(np.float32)
    x = np.concatenate([x, x[:5], 2 * x[5:9]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    check_vectors(neardup.near_duplicates(frame, least), range(len(x)), x, least)


def test_vector_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]),
            (None, [5.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS node", "1 AS raw")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in neardup.near_duplicates(frame).collect()))
    assert got == sorted([(1, 2, 1), (1, 2, 1), (0, 2, 1), *[(k, 0, k) for k in range(2, 10)]])
    assert neardup.near_duplicates(frame.where("false")).count() == 0


def near_groups(d, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, d)) + 0.3
    return np.concatenate([c + r.normal(size=(k, d)) * s for c, s, k in zip(centres, np.linspace(0.02, 0.4, 40), [60, *[8] * 39])]).astype(np.float32)


def test_vectors_on_disk(spark, tmp_path):
    """What is shuffled and staged is in proportion to the input, not to the cells that a vector reaches."""
    x = np.random.default_rng(3).normal(size=(4000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings")
    blocks, root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), checkpoint_root(spark).removeprefix("file:")

    def held():
        files = blocks.getAllFiles()
        shuffled = {files.apply(k).getPath(): files.apply(k).length() for k in range(files.size())}
        return shuffled | {str(p): p.stat().st_size for p in Path(root).rglob("*") if p.is_file()}

    before = held()
    assert neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings")).count() == len(x)
    written = sum(n for p, n in held().items() if p not in before)
    assert 0 < written < 4 * sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet"))


@pytest.mark.parametrize("d", [64, 40])
def test_vectors_in_dealt_ranges(spark, d, monkeypatch):
    """Ranges of few targets, some of which are dealt over tasks."""
    for name, value in (("CELL_ROWS", 3), ("RANGES", 64), ("RANGE_ROWS", 10), ("RANGE_BYTES", 1)):
        monkeypatch.setattr(neardup, name, value)
    dealt = []
    monkeypatch.setattr(neardup, "ranges", lambda *a, f=neardup.ranges: dealt.extend(f(*a)) or dealt)
    x = near_groups(d)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    check_vectors(neardup.near_duplicates(frame), range(len(x)), x, 0.95)
    assert len(dealt) > 40 and max(parts for *_, parts in dealt) > 1


@pytest.mark.parametrize("near,small,dense", [(None, False, False), (10, False, False), (10, True, False), (None, True, False), (None, False, True), (10, True, True)])
def test_vectors_judged_by_given_numbers(tmp_path, near, small, dense, monkeypatch):
    """Every pair counts once over all ranges, whether it is near the limit or not and however little is held at once."""
    if near:
        monkeypatch.setattr(neardup, "NEAR", near)
    if dense:
        monkeypatch.setattr(neardup, "DENSE", 1)
    for name in ("PROBE_BYTES", "PENDING_BYTES", "MEET", "PAIRS") if small else ():
        monkeypatch.setattr(neardup, name, 1 << 9)
    x = near_groups(64)
    n = np.random.default_rng(0).integers(1, 4, len(x))
    units = neardup.unit(x)
    turned = units @ neardup.rotation(64)
    plan = neardup.Layout(64, len(x), turned.mean(0), turned.var(0), 0.95)
    laid = plan.place(units)
    files, ids = [], np.arange(len(x)) + ((np.arange(len(x)) % 3) << 33)
    for k in range(3):
        with pa.OSFile(f"{tmp_path}/{k}", "wb") as sink, pa.ipc.new_file(sink, neardup.LAID) as file:
            for part, at in enumerate(np.array_split(np.arange(k, len(x), 3), 4)):
                file.write_batch(pa.RecordBatch.from_arrays([
                    pa.array(ids[at]), pa.array(n[at]), *map(neardup.binary, (laid[at], plan.reach(laid[at]), x[at]))], schema=neardup.LAID))
                files.append((str(k), part, ids[at[0]], ids[at[-1]]))
    place = {int(i): k for k, i in enumerate(ids)}
    links, pairs = Counter(), []
    for k in range(4):
        for prefix in range(4):
            for batch in neardup.Range(plan, k, 2, prefix, 0, 1, f"file:{tmp_path}", files, "<f4", 5).found():
                for i, count, root in zip(*(c.to_pylist() for c in batch.columns)):
                    links[place[i]] += count
                    pairs.append((place[i], place[root]))
    want = cosine_links(x, 0.95)
    assert links == sum((Counter({i: int(n[j])}) + Counter({j: int(n[i])}) for i, j in want), Counter())
    assert smallest(range(len(x)), pairs) == smallest(range(len(x)), want)


def test_components(spark):
    r = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (150, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    ids = sorted({x for p in links for x in p})
    at = {x: k for k, x in enumerate(ids)}
    want = dict(zip(ids, smallest(ids, [(at[a], at[b]) for a, b in links])))
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: w for x, w in want.items() if x in got} and {a for a, b in links if a != b} <= set(got)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_distances():
    r = np.random.default_rng(0)
    item, windows = r.integers(0, 4, 9).astype(np.uint64), r.integers(0, 4, (200, 12)).astype(np.uint64)
    got, end = decontamination.distances(item, windows)
    for k, w in enumerate(windows):
        row = plain_distance(item.tolist(), w.tolist())
        assert got[k] == min(row) and row[end[k]] == min(row)


def test_decontamination_query(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.op2_decontamination(spark, sf_dir).collect()}
    exact = {(i, j) for i, t in texts.items() for j, x in items.items() if x in t}
    assert exact <= got
    for i, j in got - exact:  # whatever else is found is near by brute force
        a, b = (decontamination.sequences([t])[0].tolist() for t in (items[j], texts[i]))
        assert min(min(plain_distance(a, b[s:s + 2 * len(a)])) for s in range(len(b))) <= 0.2 * len(a)


def test_recall_at_the_largest_distance(spark, sf_dir):
    r = np.random.default_rng(5)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    other = " ".join(t for _, t in items).split()
    block, found, n = decontamination.Benchmark(items), 0, 0
    for j, t in items:
        for _ in range(4):
            w = t.split()
            for _ in range(decontamination.edits(len(decontamination.sequences([t])[0]))):
                p, kind = int(r.integers(0, len(w))), r.random()
                if kind < 0.5:
                    w[p] = str(r.choice(other))
                elif kind < 0.75:
                    w.insert(p, str(r.choice(other)))
                else:
                    del w[p]
            text = " ".join([*r.choice(other, 60), *w, *r.choice(other, 60)])
            found += any(x[1] == j for x in block.find([text]))
            n += 1
    assert found >= 0.95 * n


@pytest.mark.parametrize("size", [20, 30, 40, 59, 100, 200])
@pytest.mark.parametrize("kind", ["out", "in", "cut"])
def test_recall_of_one_kind_of_edit(size, kind):
    r = np.random.default_rng(size)
    word = lambda: f"w{r.integers(0, 1 << 40)}"
    items = [[word() for _ in range(n)] for n in (size, size * 4 // 5 + 1) for _ in range(30)]
    block, found = decontamination.Benchmark([(j, " ".join(t)) for j, t in enumerate(items)]), []
    for j, t in enumerate(items):
        for _ in range(5):
            k, w = decontamination.edits(len(t)), list(t)
            at = int(r.integers(0, len(w) - k + 1))
            if kind == "cut":
                del w[at: at + k]
            for _ in range(k if kind != "cut" else 0):
                if kind == "out":
                    del w[int(r.integers(0, len(w)))]
                else:
                    w.insert(int(r.integers(1, len(w))), word())
            text = " ".join([word() for _ in range(40)] + w + [word() for _ in range(40)])
            found.append(any(x[1] == j for x in block.find([text])))
    exact = all(c["plan"] is None for c in block.classes)
    assert exact == (size >= 30) and np.mean(found) >= (1 if exact else 0.97)


def test_shared_grams_find_all_that_brute_force_finds(monkeypatch):
    monkeypatch.setattr(decontamination, "plan", lambda *_: None)
    monkeypatch.setattr(decontamination, "POSTINGS", 50)
    r = np.random.default_rng(1)
    for _ in range(20):
        items = [r.integers(0, 4, int(n)).tolist() for n in r.integers(1, 14, 12)]
        text = r.integers(0, 4, 60).tolist()
        block = decontamination.Benchmark([(j, " ".join(map(str, t))) for j, t in enumerate(items)])
        got = {(x[1], x[4]) for x in block.find([" ".join(map(str, text))])}
        least = [min(min(plain_distance(t, text[s: s + 2 * len(t)])) for s in range(len(text))) for t in items]
        assert got == {(j, d) for j, d in enumerate(least) if d <= decontamination.edits(len(items[j]))}


def test_decontamination_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "No ID, here at all TODAY"), (2, None), (3, ""), (4, "..."), (None, "word")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_passages(odd_documents, items).collect()}
    assert found == {(None, 1), (3, None), (4, None)}
    kept = decontamination.clean(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 3
    assert decontamination.find_passages(no_documents, items).count() == 0
    assert decontamination.find_passages(odd_documents, items.where("false")).count() == 0
