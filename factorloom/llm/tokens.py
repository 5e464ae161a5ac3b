"""Token ids of texts by a byte-level BPE rank file, fast enough for whole corpora.

Words come back often, so ids are kept by chunk (a run without spaces, with the space before it) in a bounded
dictionary, and unknown chunks of a batch are encoded together. A text is cut at single spaces only where the
tokenizer's own split must cut too; texts with runs of spaces, and chunks with white space, are encoded alone.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
_INNER_SPACE = re.compile(r".\s", re.S)


class Encoder:
    """Little-endian unsigned 32-bit ids of texts. `path` is a rank file, `tokenizer` the file of the tokenizer it belongs
    to; `keep` bounds the dictionary. A text that spells one of the tokenizer's added tokens is encoded by the tokenizer
    itself, which gives that token its own id."""

    def __init__(self, path: str | None = None, keep: int = 600_000, tokenizer: str | None = None):
        self._whole = Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER))
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._newline = ranks[b"\n"]
        self._keep = keep
        self._known: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Unknown chunks: those without white space but a leading space are joined by newlines, encoded at once, and
        cut at the newline's id, which the split never merges with them."""
        plain = []
        for c in chunks:
            if len(c) < 2 or _INNER_SPACE.search(c) or c[0].isspace() and c[0] != " ":
                self._known[c] = self._alone(c)
            else:
                plain.append(c)
        if plain:
            ids = np.array(self._bpe.encode_ordinary("\n".join(plain)), "<u4")
            ends = np.flatnonzero(ids == self._newline)
            raw, starts = ids.tobytes(), [0, *((ends + 1) * 4).tolist()]
            self._known.update(zip(plain, map(raw.__getitem__, map(slice, starts, [*(ends * 4).tolist(), len(raw)]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        chunks = [None if "  " in t or t[-1:] == " " or "\0" in t or any(a in t for a in self._added) else t.replace(" ", "\0 ").split("\0") for t in texts]
        if len(self._known) > self._keep:
            self._known = {}
        self._learn(list(set().union(*(c for c in chunks if c is not None)).difference(self._known)))
        known = self._known.__getitem__
        return [self._alone(t) if c is None else b"".join(map(known, c)) if t else b"" for t, c in zip(texts, chunks)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The Python worker's own encoder, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
