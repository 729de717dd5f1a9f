import hashlib
import random
import zlib

import pytest

from tidegate.llm.common import prepare
from tidegate.llm.prefixtrie import Mail, as_they_are, ends_digest, rebuilt, running, trie, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, h1 int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)


def conversations(rows):
    """conv_id to its turns in order."""
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuild(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = own + sum(saved[k] for k in kids)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def some(seed, n=40, deep=None):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            # at most one turn without a number: those of equal number follow each other by a hash
            rows.append((c, t if t or rng.random() < 0.9 else None, rng.choice(["user", None, "assistant"]) if t else "user", rng.choice(["a", "b", "", None, "é" * 3])))
    if deep:
        rows += [(c, t, "user", "a") for c in (100, 101) for t in range(deep + (c == 100))]
    return rows


@pytest.mark.parametrize("shard,band,queue", [(4096, 4096, 1 << 20), (3, 2, 3)])
def test_totals_match_a_plain_trie(spark, many_tasks, shard, band, queue):
    rows = some(7, deep=40)
    got = trie(*rebuilt(turns_of(frame(spark, rows))), shard=shard, band=band, queue=queue)
    assert rows_of(got) == brute(rebuild(conversations(rows)))


def test_as_they_are(spark):
    rows = some(3)
    assert rows_of(trie(*as_they_are(turns_of(frame(spark, rows))), shard=5)) == brute(conversations(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, None, None), (7, 0, "user", "x" * 100_000), (7, 0, "user", "x" * 100_000),
            (5, 3, "user", "tie"), (5, 3, "assistant", "tie"), (11, 0, "user", "base is missing"), (-3, 0, "user", "negative"), (0, 1, "user", "")]
    # -3 belongs to the base 0 where % truncates
    own = conversations(rows)
    made = rebuild({c: t for c, t in own.items() if c >= 0})
    h = zlib.crc32(b"-3") % 9
    made[-3] = own[0][:h] + own[-3][h:]
    assert rows_of(trie(*rebuilt(turns_of(frame(spark, rows))))) == brute(made)
    assert rows_of(trie(*rebuilt(turns_of(frame(spark, rows).where("false"))))) == []


def test_running_values_go_on_from_task_to_task(spark, many_tasks):
    prepare(spark)
    df = spark.range(0, 4000, 1, 8).selectExpr("id % 3 * (id % 3) AS k", "id", "id * 7919 AS v").where("k < 4 OR id < 9")
    got = running(df, "k", ["id"], ("v",)).orderBy("k", "n").collect()
    seen = {}
    for r in got:
        n, x = seen.get(r.k, (0, 0))
        seen[r.k] = (n + 1, x ^ r.v)
        assert (r.n, r.run_v) == seen[r.k]
    assert len(got) == df.count()


def test_ends_of_a_node_over_many_tasks(spark, many_tasks, monkeypatch):
    import tidegate.llm.prefixtrie as module

    monkeypatch.setattr(module, "CHUNK", 64)
    prepare(spark)
    df = spark.range(0, 5000, 1, 8).selectExpr("id AS conv_id", "IF(id % 5 = 0, id, 0L) % 7 AS depth", "0L AS h1", "0L AS h2")
    want = {}
    for i in range(5000):
        want.setdefault((i if i % 5 == 0 else 0) % 7, []).append(str(i))
    got = {r.depth: r.digest for r in ends_digest(df).collect()}
    assert got == {d: hashlib.sha256(",".join(v).encode()).hexdigest() for d, v in want.items()}


def test_mail_spills_and_comes_back_in_order(tmp_path):
    rng, sent = random.Random(1), {}
    mail = Mail(str(tmp_path), 5)
    for _ in range(200):
        order = (rng.randrange(20),)
        old = sent.get(order, (0, 0, 0))
        value = (rng.randrange(5), rng.randrange(5))
        sent[order] = (old[0] + value[0], old[1] + value[1], old[2] + 1)
        mail.send(order, *value)
    assert mail.files and all(mail.take((k,)) == sent.get((k,), (0, 0, 0)) for k in range(20))
    mail.clear()
    assert not list(tmp_path.iterdir())
