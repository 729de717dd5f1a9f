import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegate.llm import tokenfile
from tidegate.llm.tokenfile import Hash, key_hashes, op12_token_index, read, write
from tidegate.llm.tokens import encoder

CORE = Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def plain(text):
    return CORE.encode(text or "", add_special_tokens=False).ids + [0]


def want(rows):
    """Documents of one id follow each other by the hash of their text, so only their set is compared."""
    return sorted((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for ids in (plain(t) for _, t in rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z.,\n\t 　'1é😀ß\x1c<|>")), max_size=40), max_size=6))
def test_ids_are_those_of_the_library(texts):
    texts = [*texts, "x <|endoftext|> y", "a b  c", " a", "a "]
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder().batch(texts)] == [plain(t)[:-1] for t in texts]


def test_documents_come_back_in_order(spark, documents, texts, sf_dir):
    got = sorted(op12_token_index(spark, sf_dir).collect())
    start = 0
    for row, doc_id in zip(got, sorted(texts), strict=True):
        ids = plain(texts[doc_id])
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_documents(spark, odd_documents, no_documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    files = write(odd_documents, str(tmp_path / "a"))
    got = read(odd_documents, files).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want(rows)
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])[:-1]]).tolist()
    assert files.get(1).tolist() == [0] and files.get(4).tolist() == plain("word") and files.get(None).tolist() == plain("no id here at all today")
    assert files.get(5, 1).tolist() == files.get(5).tolist() and files.get(5, 2) is None and files.get(12345) is None
    empty = write(no_documents, str(tmp_path / "b"))
    assert read(odd_documents, empty).count() == 0 and empty.get(1) is None


def test_a_hot_id_over_many_tasks(spark, tmp_path, monkeypatch, many_tasks):
    monkeypatch.setattr(tokenfile, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(tokenfile, "BUCKET", 500)
    monkeypatch.setattr(tokenfile, "READ_BYTES", 64)
    rows = [(7 if i % 3 else i, "copy" if i % 2 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = write(docs, str(tmp_path / "a"))
    got = read(docs, files).collect()
    assert len(list((tmp_path / "a").glob("shard-*.ids"))) > 1
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted(r[0] for r in rows)
    hot = [r.nth for r in order if r.doc_id == 7]
    assert hot == list(range(len(hot)))
    some = spark.createDataFrame([(9,), (9,), (10 ** 9,), (None,)], "doc_id long")
    assert [r.doc_id for r in read(some, files).collect()] == [9]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_the_hash_is_minimal_and_perfect(n):
    a, b = key_hashes(pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()))
    h = Hash.build(a, b)
    assert sorted(h.find(a, b).tolist()) == list(range(n))
    assert sum(h.sizes) <= max(64, 5 * n)
