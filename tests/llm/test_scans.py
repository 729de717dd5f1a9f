import base64
import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm import pii, secrets
from tidegate.llm.spans import ordered

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def count(s):
    return sum(c in "0123456789" for c in s)


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= count(m[0]) <= 19 and luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= count(m[0]) <= 15]


def plain_secrets(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def sha(spans, kinds):
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in ordered(spans, kinds)).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0@.1-+ (9%é", max_size=60))
def test_base_equals_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_pii(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "ſecret", "secret", "=", ": ", '"', "abc123", "abcdef0123456789abcdef01", "AKIA", "ABCDEFGH12345678", " ", "api_key", "é"]), max_size=12).map("".join))
def test_secret_base_equals_the_patterns(text):
    assert sorted(secrets.scan(text)[0]) == sorted(plain_secrets(text))


def test_queries(spark, sf_dir, texts):
    for fn, plain, kinds in ((pii, plain_pii, pii.KINDS), (secrets, plain_secrets, secrets.KINDS)):
        query = pii.op4_pii if fn is pii else secrets.op10_secrets
        rows = {r.doc_id: r for r in query(spark, sf_dir).collect()}
        assert set(rows) == set(texts)
        for i, t in texts.items():
            base = plain(t)
            assert rows[i].base_sha256 == sha(base, kinds)
            every = {tuple(x.split(":")) for x in rows[i].spans.split(",") if x}
            assert {(k, str(s), str(e)) for k, s, e in base} <= every
            for kind in {k for k, _, _ in base}:
                assert rows[i][f"n_{kind}"] == sum(k == kind for k, _, _ in base)


def b64(x, url=True):
    return (base64.urlsafe_b64encode(x) if url else base64.b64encode(x)).rstrip(b"=" if url else b"").decode()


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def rsa():
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 40) for k in range(8)))


def test_structures_are_confirmed():
    token = f"{b64(b'{\"alg\":\"HS256\"}')}.{b64(b'{\"sub\":\"x\"}')}.c2ln"
    field = lambda x: len(x).to_bytes(4) + x
    ssh = secrets.SSH_MAGIC + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 20) + field(b"s" * 40)
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(rsa()).decode() + "-----END RSA PRIVATE KEY-----"
    for text, kind in ((token, "token"), (b64(rsa(), False), "key"), (rsa().hex(), "key"), (b64(ssh, False), "key"), (pem, "key")):
        found = secrets.scan(f"é {text} end")[1]
        assert (kind, 2, 2 + len(text)) in found, text
    wrong = rsa()[:-1]
    for text in (f"{b64(b'{\"alg\":1}')}.{b64(b'{}')}.x", f"{b64(b'[1]')}.{b64(b'{}')}.x", b64(wrong, False), wrong.hex(), b64(ssh[:-1], False), "M" * 64):
        assert not secrets.scan(f"{text} end")[1], text


def test_hex_of_either_case_and_encrypted_keys_are_confirmed():
    encode = lambda x: base64.encodebytes(x).decode()
    key = der(0x30, der(2, b"\0") + der(2, b"\x1a\xbc\xde\xf5" * 10) * 8)
    mixed = "".join(c.upper() if k % 3 else c for k, c in enumerate(key.hex()))
    wrapped = der(0x30, der(0x30, der(6, b"*\x86H\x86\xf7\r\x01\x05\r") + der(0x30, b"")) + der(4, b"x" * 48))
    encrypted = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{encode(wrapped)}-----END ENCRYPTED PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    old = f"-----BEGIN RSA PRIVATE KEY-----\n{headers}{encode(bytes(range(64)))}-----END RSA PRIVATE KEY-----"
    noted = f"-----BEGIN RSA PRIVATE KEY-----\r\nComment: a\r\n  b\r\n\r\n{encode(rsa())}-----END RSA PRIVATE KEY-----"
    for text in (key.hex().upper(), mixed, encrypted, old, noted):
        assert ("key", 2, 2 + len(text)) in secrets.scan(f"é {text} end")[1], text
        assert secrets.mask(f"é {text} end") == "é [SECRET] end"
    assert not [x for x in secrets.scan(f"{mixed} end")[0] if x[2] - x[1] == len(mixed)]  # the plain pattern is as it was
    for text in (encrypted.replace("ENCRYPTED ", ""), old.replace(headers, ""), key[:-1].hex().upper(),
                 old.replace(encode(bytes(range(64))), encode(bytes(range(63))))):
        assert not secrets.scan(f"{text} end")[1], text


def test_redaction_keeps_rows_and_columns(odd_documents, no_documents, spark):
    text = "x token = abcdef0123456789abcdef01 y"
    docs = odd_documents.unionByName(odd_documents.limit(1).selectExpr("99L AS doc_id", f"'{text}' AS text", "source", "key", "node", "lo", "score"))
    out = secrets.redact(docs, length=None)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id = 99").collect()} == {"x [SECRET] y"}
    assert {r.text for r in out.where("doc_id IN (1, 2)").collect()} == {"", None}
    for find in (secrets.find_secrets, pii.find_personal_data):
        assert find(odd_documents).count() == odd_documents.count() and find(no_documents).count() == 0


def test_segments_are_decoded_jointly():
    sample = [f"call +1 (5{i:02d}) 555-12{i:02d} or write a{i}.b@mail{i}.example.com from 10.0.{i}.7 today {i * 7}" for i in range(60)]
    model = pii.fit(sample)
    text = "so +1 (777) 555-4242 and zed.q@mail3.example.com at 10.1.2.3 with 17 items"
    assert sorted(model.find(text)) == sorted(plain_pii(text))
    tokens = next(pii.regions(text))
    where, what = pii.segments(text, tokens)
    z, p, _ = model.expectations(len(tokens), where, model.scores(what))
    assert p.min() >= 0 and p.sum(1).max() <= 1 + 1e-9


def segmentations(n, where, at=0):
    """All ways to cut tokens at..n into segments of any kind and tokens outside."""
    if at == n:
        yield ()
        return
    for rest in segmentations(n, where, at + 1):
        yield ((at, at + 1, pii.OUTSIDE), *rest)
    for i, j in where:
        if i == at:
            for rest in segmentations(n, where, j):
                for y in range(pii.OUTSIDE):
                    yield ((i, j, y), *rest)


def test_decoding_and_probabilities_equal_all_segmentations():
    r = np.random.default_rng(4)
    for text in ("a@b.c 7", "+1 (2) 3", "1 2 3"):
        tokens = next(pii.regions(text))
        where, what = pii.segments(text, tokens)
        model = pii.Model(r.normal(0, 1, (pii.BUCKETS, pii.OUTSIDE)), r.normal(0, 1, (pii.OUTSIDE + 1, pii.OUTSIDE + 1)))
        scores, place = model.scores(what), {s: k for k, s in enumerate(where)}

        def total(cut):
            last, out = pii.OUTSIDE, 0.0
            for i, j, y in cut:
                out += model.follow[last, y] + (scores[place[i, j], y] if y != pii.OUTSIDE else 0)
                last = y
            return out

        cuts = list(segmentations(len(tokens), where))
        totals = np.array([total(c) for c in cuts])
        best = [x for x in cuts[int(totals.argmax())] if x[2] != pii.OUTSIDE]
        assert model.decode(len(tokens), where, scores) == best
        z, p, _ = model.expectations(len(tokens), where, scores)
        share = np.exp(totals - np.logaddexp.reduce(totals))
        assert abs(z - np.logaddexp.reduce(totals)) < 1e-9
        want = np.zeros_like(p)
        for c, w in zip(cuts, share):
            for i, j, y in c:
                if y != pii.OUTSIDE:
                    want[place[i, j], y] += w
        assert np.abs(p - want).max() < 1e-9


def test_the_model_alone_finds_the_base_spans_of_texts_it_was_not_fitted_on(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect()]
    regions = [t[max(0, k[0][0] - 1): k[-1][1] + 1] for t in docs if pii.CORE.search(t) for k in pii.regions(t)]
    model = pii.fit(regions[::3])
    pairs = [(set(pii.base_spans(t)), set(model.find(t))) for t in regions[1::3]]
    base, hit, more = (sum(map(len, x)) for x in ([b for b, _ in pairs], [b & f for b, f in pairs], [f - b for b, f in pairs]))
    assert hit >= 0.95 * base and hit >= 0.95 * (hit + more)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8), st.integers(0, 30), st.integers(1, 6))
def test_overlaps(spans, start, size):
    spans = [("ip", s, s + n) for s, n in spans]
    plain = any(s < start + size and start < e for _, s, e in spans)
    assert pii.overlaps(pii.merged(spans), start, start + size) == plain


def test_regions_hold_whole_addresses_and_long_logs_end():
    local, domain = "first.middle.last.name", "a.bc.de.example.com"
    text = f"some words go before {local}@{domain} and many more come after it"
    run = next(pii.regions(text))
    assert text[run[0][0]:run[-1][1]].count(f"{local}@{domain}") == 1
    log = "10.0.0.1 " * 20_000
    taken = pii.merged(pii.base_spans(log))
    assert len(taken[0]) == 20_000
    assert all(pii.overlaps(taken, k, k + 2) for k in range(0, len(log), 9))
