"""Minimal acyclic transducers from sorted words to their ordinals.

Built word by word from a sorted list: after each word the states that no later
word can reach are frozen, and a state with the same arcs as a frozen one is
replaced by it.  A state knows how many words it accepts, and an arc's output is
the number of words that come before its own; the sum along a word's path is its
ordinal.  Lookups walk all words of a batch side by side, a byte at a time, as
long as any has a path.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """``keys``: rising (state * 256 + byte) of all arcs; ``target`` and ``output`` of each; whether a state is
    ``final``."""

    def __init__(self, keys, target, output, final, root: int):
        self.keys, self.target, self.output, self.final, self.root = keys, target, output, final, root

    @classmethod
    def build(cls, words: Iterable[bytes]) -> "Transducer":
        """From words in rising order of their bytes, each once."""
        frozen: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []        # of each frozen state: (byte, target)
        final: list[bool] = []
        path: list[list] = [[False, []]]              # open states: [final, arcs so far]; the last arc's target is open
        before = b""

        def freeze(state) -> int:
            sign = (state[0], *state[1])
            at = frozen.get(sign)
            if at is None:
                at = frozen[sign] = len(final)
                final.append(state[0])
                arcs.append(state[1])
            return at

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                done = freeze(path.pop())
                path[-1][1][-1] = (path[-1][1][-1][0], done)

        for word in words:
            if word <= before and (before or path[0][0]):
                raise ValueError("words must rise")
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            close(same)
            for byte in word[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        root = freeze(path[0])
        # targets are frozen before the states that point at them
        total = np.zeros(len(final), dtype=np.int64)
        keys, target, output = [], [], []
        for state, own in enumerate(arcs):
            n = int(final[state])
            for byte, to in own:
                keys.append(state * 256 + byte)
                target.append(to)
                output.append(n)
                n += int(total[to])
            total[state] = n
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int64), np.array(final, bool), root)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ordinal of each word ``data[starts: starts + sizes]``; -1 where it is not one of the words."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            if len(self.final) and self.final[self.root]:
                out[sizes == 0] = 0
            return out
        alive, state, total = np.arange(len(starts)), np.full(len(starts), self.root, dtype=np.int64), np.zeros(len(starts), np.int64)
        depth = 0
        while len(alive):
            ended = sizes[alive] == depth
            accepted = ended & self.final[state]
            out[alive[accepted]] = total[accepted]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            key = state * 256 + data[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            arc = arc[on]
            alive, state, total = alive[on], self.target[arc].astype(np.int64), total[on] + self.output[arc]
            depth += 1
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, keys=self.keys, target=self.target, output=self.output, final=self.final, root=self.root)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Transducer":
        with np.load(io.BytesIO(data)) as z:
            return cls(z["keys"], z["target"], z["output"], z["final"], int(z["root"]))
