import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegate.llm.packing import Packer, op5_packing, pack
from tidegate.llm.tokens import encoder


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, ids_of):
    """Every id of every document in exactly one piece, sequences gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by_doc, {k: sum(r.length for r in v) for k, v in by_sequence.items()}


def test_query_round_trip(spark, sf_dir, texts, reference):
    rows = op5_packing(spark, sf_dir).collect()
    by_doc, sizes = check(rows, {i: reference(t) for i, t in texts.items()})
    assert {i for i, _ in by_doc} == set(texts)
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == pieces[0].doc_tokens
    padding = sum(1024 - n for n in sizes.values() if n & (n - 1))
    assert padding < 1024 * 8 and set(sizes.values()) - {256, 512, 1024} == {n for n in sizes.values() if n not in (256, 512, 1024)}


def test_encoder_equals_the_tokenizer(reference):
    encode = encoder()
    for text in ["", " ", "a", " a  b", "a\n b", "x \n", "it's  we'll ' s", "1 2  33", "é ñ x y　z", "<|endoftext|> a", "a\tb c", "!! ?\r\n", "日本 語 a", "a <|endoftext|> b"]:
        assert np.frombuffer(encode.batch([text])[0], encode.kind).tolist() == reference(text)[:-1], text


def test_an_added_token_in_a_text_is_that_token(spark, reference):
    text = "a <|endoftext|> b"
    assert reference(text)[:-1] == [64, 220, 50256, 275]
    rows = pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    check(rows, {1: reference(text)})


def test_odd_rows(odd_documents, no_documents, reference):
    rows = pack(odd_documents).collect()
    assert sum(r.length for r in rows) == sum(len(reference(r.text)) for r in odd_documents.collect())
    assert pack(no_documents).count() == 0


def test_windows_are_full_and_groups_even():
    packer, r = Packer(0), np.random.default_rng(0)
    total = 0
    for i, n in enumerate(r.integers(1, 3000, 3000)):
        packer.add((i, int(n)), b"\0" * 4 * int(n))
        total += int(n)
    packer.pack(last=True)
    sizes = [(tier, sum(len(p[2]) // 4 for p in pieces)) for tier, pieces in packer.done]
    assert sum(n for _, n in sizes) == total and sum(n != tier for tier, n in sizes) <= 1
    rows = packer.rows().to_pandas()
    tokens = rows.groupby(["tier", "step_group"]).length.sum()
    assert tokens.groupby("tier").agg(lambda x: x.max() - x.min()).max() <= 2048


def test_complete_windows_hold_no_ids():
    packer = Packer(0)
    for d in range(2000):
        packer.add((d, 2500), bytes(10_000))
    packer.pack(last=True)
    windows = len(packer.done)
    assert packer.settle() == windows and not packer.done and not packer.pool
    assert not any(isinstance(x, bytes) for _, pieces in packer.settled for p in pieces for x in p)
    rows = packer.rows()
    assert sum(rows.column("length").to_pylist()) == 5_000_000 and not packer.settled
    assert packer.rows() is None


def test_the_library_tokenizer_is_loaded_where_it_is_needed():
    from tidegate.llm.tokens import Encoder

    e = Encoder()
    assert e.plain is not None and e.batch(["two words"]) and "core" not in vars(e)
    assert e.width == (2 if e.core.get_vocab_size() <= 1 << 16 else 4)
    assert e.added == tuple(t.content for t in e.core.get_added_tokens_decoder().values())
    assert e.batch(["a<|endoftext|>b"]) == [e.whole("a<|endoftext|>b")]
