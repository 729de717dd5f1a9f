"""Token ids of whole texts by a tokenizer file.

The ids are those that the tokenizers library gives for the whole text.  It takes about a second
for a megabyte, so texts go through it where they hold an added token of the file; all others are
encoded by tiktoken from the vocabulary and merges of the same file, which gives the same ids four
times as fast.  Files of another kind than byte-level BPE with ids in the order of merges go
through the tokenizers library altogether.
"""

from __future__ import annotations

import array
import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from tidegate.llm.common import release

_encoders: dict = {}


def alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian ids, 2 bytes each where the vocabulary fits them, else 4."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers as public

        self.path, self.plain = path or public.path("byte_bpe_50k.json"), None
        with open(self.path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = tuple(t["content"] for t in file.get("added_tokens") or ())
        self._plain_encoder(file, public.PATTERN)
        size = self.core.get_vocab_size() if self.plain is None else len({*file["model"]["vocab"], *self.added})
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        del file
        release()

    @cached_property
    def core(self):
        """The library's tokenizer; it is loaded where a text needs it, as it takes more memory than the plain encoder."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain_encoder(self, file: dict, pattern: str) -> None:
        import tiktoken

        model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or file.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback")):
            return
        vocabulary, of = model["vocab"], alphabet()
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        if merged != sorted(merged) or len({*merged}) != len(merged) or len(merged) + 256 != len(ranks):
            return
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.core.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        if self.plain is None:
            return [self.whole(t) for t in texts]
        code, encode = "H" if self.width == 2 else "I", self.plain.encode_ordinary
        return [self.whole(t) if any(a in t for a in self.added) else array.array(code, encode(t)).tobytes() for t in texts]


def encoder(path: str | None = None) -> Encoder:
    """One encoder per file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs(texts: list[str], size: int = 1 << 20) -> Iterator[slice]:
    """Slices of about ``size`` characters; a longer text is one of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
