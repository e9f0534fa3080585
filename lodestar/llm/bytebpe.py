"""Byte-level BPE ids of whole texts, with the ids of space-led chunks remembered."""

from __future__ import annotations

import base64
import os
import re
from functools import cached_property
from pathlib import Path

import numpy as np

#: Chunks that are remembered, at most, and the characters of the longest of them.
CACHE_CHUNKS, CACHED_LENGTH = 150_000, 64
#: Two adjacent white-space characters, or the text of a special token: such a text is encoded as a whole.
WHOLE = re.compile(r"\s\s|<\|")
#: The published pre-tokenizing pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first character beyond the Latin blocks.
LATIN_END = "\u0250"


class ByteBpe:
    """Ids by a ``tokenizers`` file whose pre-tokenizer joins at most one leading space to a word.

    No token crosses a space that stands alone, so a text's ids are those of its chunks, each a
    space and what follows up to the next. Chunks repeat; the ids of short ones are remembered up to a
    fixed number. Texts with adjacent white space or special tokens are encoded as they are. Where the same
    vocabulary lies beside the file as ranks (``.tiktoken``), chunks of Latin letters are encoded by
    it, which gives the same ids in a third of the time; all others by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        self.path = path
        self.chunks: dict[str, bytes] = {}
        self.ranks = None
        beside = Path(path).with_suffix(".tiktoken")
        if beside.exists():
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, beside.read_bytes().splitlines())}
            self.ranks = tiktoken.Encoding(beside.stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks."""
        out, other = {}, chunks
        if self.ranks is not None:
            other = []
            for x in chunks:
                if x.isascii() or max(x) < LATIN_END:
                    out[x] = np.array(self.ranks.encode_ordinary(" " + x), dtype="<u4").tobytes()
                else:
                    other.append(x)
        if other:
            for x, found in zip(other, self.tokenizer.encode_batch_fast([" " + x for x in other], add_special_tokens=False), strict=True):
                out[x] = np.array(found.ids, dtype="<u4").tobytes()
        return out

    def first(self, chunk: str) -> bytes:
        """The ids of a chunk without a leading space."""
        if self.ranks is not None and (chunk.isascii() or max(chunk) < LATIN_END):
            return np.array(self.ranks.encode_ordinary(chunk), dtype="<u4").tobytes()
        return self.whole(chunk)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if WHOLE.search(text):
            return self.whole(text)
        parts = text.split(" ")
        first, rest = parts[0], parts[1:]
        chunks = self.chunks
        head = self.first(first) if first else b""
        try:
            return head + b"".join(map(chunks.__getitem__, rest))
        except KeyError:
            pass
        here = set(rest)
        if len(chunks) + len(here) > CACHE_CHUNKS:
            chunks.clear()
        found = self.fresh([x for x in here if x not in chunks])
        chunks.update((x, ids) for x, ids in found.items() if len(x) <= CACHED_LENGTH)
        return head + b"".join([found[x] if x in found else chunks[x] for x in rest])
