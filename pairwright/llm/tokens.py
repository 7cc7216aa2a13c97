"""Exact byte-BPE ids and character spans of whole texts.

Ids equal those of the ``tokenizers`` file.  The same vocabulary as ranks is
read by ``tiktoken``, with a splitting pattern that needs no lookahead: a text
is cut before the last character of each run of white space that is followed
by something else, which is all the lookahead decides.  A text that holds an
added token's string (``<|endoftext|>``) goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

# The vocabulary's splitting pattern, less its lookahead, and its white space.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACE}]{{2,}}")     # of one character nothing is cut off; found in one pass
_CLOSERS = b"\"')]"
_STOPS = tuple(x.encode() for x in ".!?…。！？")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> "Encoder":
    """The encoder of this process for a vocabulary file."""
    return Encoder(vocabulary)


class Encoder:
    """``vocabulary``: path of the ``tokenizers`` file; its ranks lie beside it as ``.tiktoken``."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark deals out the cores
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        with open(os.path.splitext(vocabulary)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = {b: a for a, b in ranks.items()} | {i: t.content.encode() for i, t in added.items()}
        n = max(pieces) + 1
        self.width = np.array([len(pieces.get(i, b"")) for i in range(n)], dtype=np.int64)
        self.stop = np.array([b"\n" in (p := pieces.get(i, b"")) or p.rstrip(_CLOSERS).endswith(_STOPS)
                              for i in range(n)])

    def ids(self, text: str) -> np.ndarray:
        """Token ids (uint32) of one text."""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts, at = [], 0
        for run in _RUN.finditer(text):
            if run.end() == len(text):
                break
            for end in (run.start(), run.end() - 1):
                if end > at:
                    parts.append(self.bpe.encode_to_numpy(text[at:end], disallowed_special=()))
                    at = end
        if at < len(text):
            parts.append(self.bpe.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a token that holds a
        part of a character spans the whole character."""
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1         # of each byte
        ends = np.cumsum(self.width[ids])
        if not len(ids):
            return ends, ends
        return char[ends - self.width[ids]], char[ends - 1] + 1
