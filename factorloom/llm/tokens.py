"""Encoding with a public tokenizer file, on executors."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import regex

#: Pieces whose ids a worker keeps at hand: so many that it met lately, and as many from before.
CACHE_PIECES = 300_000
#: Characters of a kept piece at most.
CACHED_CHARS = 64
# Fixed value: how a byte-level tokenizer cuts a text into pieces that never merge.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same in the standard library's faster terms, for texts of characters on which both agree.
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f\u2010-\u2027\u2030-\u205e]")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SIGNS = byte_signs()
_loaded: dict[str, Encoder] = {}


class Encoder:
    """A ``tokenizers`` file. Texts are encoded piece by piece, each distinct piece once.

    That gives the ids of ``encode(text, add_special_tokens=False)`` for byte-level
    tokenizers without a normalizer; other files, and texts that hold an added token's string,
    go through ``encode`` whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that isn't in the cache: the merges alone, since offsets and word numbers aren't needed."""
        ids = self.before.get(piece)
        if ids is None:
            found = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_SIGNS))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(piece) <= CACHED_CHARS:
            self.cache[piece] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        pieces = (PIECE if _NOT_PLAIN.search(text) else _PLAIN_PIECE).findall(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.cache.get(pieces[i]) or self._piece(pieces[i])
        return b"".join(found)

    def encode_batch(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """Ids of every text, as little-endian unsigned 32-bit arrays, with the bytes of ``end`` behind each."""
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.before = {}, self.cache
        whole = lambda t: not self.by_piece or any(a in t for a in self.added)
        return [np.frombuffer((self._whole(t) if whole(t) else self._ids(t)) + end, "<u4") for t in texts]

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(map(int, ids)), skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    """The process's encoder of a file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
