"""Token ids of public byte-level BPE files, with a bounded cache of word pieces."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import cached_property

import numpy as np
import public_tokenizers

from gleanery.llm.memory import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Beyond this many pieces the cache starts anew (about 50 MB).
CACHE_PIECES = 200_000


#: Letters beyond the Latin ones.
_OTHER = re.compile("[\u0250-\U0010ffff]")


def _plain(text: str) -> bool:
    return "<|" not in text and (text.isascii() or not _OTHER.search(text))


class _Pieces(dict):
    """Ids of pieces, found when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """The ids that ``tokenizers`` gives for ``vocabulary`` with ``add_special_tokens=False``.

    Plain Latin text is encoded whole by ``tiktoken`` with the same vocabulary; nothing of it is kept. In other
    texts, the pre-tokenizer always splits before a lone space that a non-space follows, and what is on
    one side does not change the ids of the other side. So such a text is cut there and the ids of its pieces are
    looked up. Pieces not yet known are encoded by ``tiktoken`` if they are plain Latin text, else
    by ``tokenizers`` itself, as are texts with runs of spaces.
    With ``plain`` the strings of special tokens are ordinary text.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS, plain: bool = False):
        import tiktoken

        self.vocabulary, self.plain = vocabulary, plain
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.width = np.dtype("<u2" if len(table) < 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.cache = _Pieces(self._piece)

    @cached_property
    def exact(self):
        """The full tokenizer, loaded with the first text that needs it."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.vocabulary)
        t.encode_special_tokens = self.plain
        return t

    def _exact(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _latin(self, text: str) -> bytes:
        return array(self.code, self.quick.encode_ordinary(text)).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._latin(piece) if _plain(piece) else self._exact(piece)

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of one text, ``width`` each; none for a null text."""
        if not text:
            return b""
        if "  " in text or "\x00" in text:
            return self._exact(text)
        if _plain(text):
            return self._latin(text)
        pieces = text.replace(" ", "\x00 ").split("\x00")
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, pieces))


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS, plain: bool = False) -> Encoder:
    """One encoder for each Python worker, until it is forgotten."""
    key = (vocabulary, ranks, plain)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def forget() -> None:
    """Drop all encoders, as other stages run in the same Python worker later."""
    _encoders.clear()


KEPT["encoder"] = forget
