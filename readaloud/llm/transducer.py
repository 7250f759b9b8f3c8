"""A minimal acyclic transducer from terms to their lexicographic ordinals.

Built from sorted terms in one pass: nodes off the common prefix with the next
term can't change any more, so they are frozen and shared with an equal node
if there is one. An arc carries the number of terms that sort before everything
behind it, so the ordinal of a term is the sum along its path and the
term of an ordinal is found by walking back down. Terms are bytes (UTF-8), whose
order is that of the code points.

Many terms are looked up at a time: one array step per byte position over all
terms that still have a path. Only numpy; nothing of Spark.
"""
from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import numpy as np

#: With so few paths left, walking one after another costs less than an array step per byte.
FEW = 16


class Transducer:
    """``keys`` holds node * 256 + byte of every arc in ascending order; targets, outputs and finals go with them."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, finals: np.ndarray):
        self.keys, self.targets, self.outputs, self.finals = keys, targets, outputs, finals

    @property
    def root(self) -> int:
        return len(self.finals) - 1

    @cached_property
    def _arcs(self) -> dict[int, int]:
        return {key: at for at, key in enumerate(self.keys.tolist())}

    def _ordinal(self, term: bytes, node: int, total: int) -> int:
        """The ordinal of a term whose rest, ``term``, starts at ``node``; -1 if it is none."""
        for byte in term:
            at = self._arcs.get(node * 256 + byte)
            if at is None:
                return -1
            node, total = int(self.targets[at]), total + int(self.outputs[at])
        return total if self.finals[node] else -1

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From ascending terms without repeats; anything else is an error."""
        frozen: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        before = None

        def freeze(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                node = frozen.setdefault((final, tuple(arcs)), len(frozen))
                path[-1][1].append((before[len(path) - 1], node))
        for term in terms:
            shared = 0
            if before is not None:
                if term <= before:
                    raise ValueError("terms must ascend without repeats")
                limit = min(len(term), len(before))
                while shared < limit and term[shared] == before[shared]:
                    shared += 1
            freeze(shared)
            path.extend([False, []] for _ in range(len(term) - shared))
            path[-1][0] = True
            before = term
        freeze(0)
        final, arcs = path.pop()
        # the root stands last and is not shared, so a table without terms has one too
        nodes = [*frozen, (final, tuple(arcs))]
        counts = np.zeros(len(nodes), np.int64)
        keys, targets, outputs = [], [], []
        for i, (final, arcs) in enumerate(nodes):  # targets are frozen before the nodes that lead to them
            passed = int(final)
            for label, target in arcs:
                keys.append(i * 256 + label)
                targets.append(target)
                outputs.append(passed)
                passed += int(counts[target])
            counts[i] = passed
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int64),
                   np.array([f for f, _ in nodes], np.bool_))

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.keys.tobytes(), self.targets.tobytes(), self.outputs.tobytes(), self.finals.tobytes()

    @classmethod
    def from_bytes(cls, keys: bytes, targets: bytes, outputs: bytes, finals: bytes) -> Transducer:
        return cls(np.frombuffer(keys, np.int64), np.frombuffer(targets, np.int32),
                   np.frombuffer(outputs, np.int64), np.frombuffer(finals, np.bool_))

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``data[offsets[i]:offsets[i + 1]]`` (uint8), -1 where it is none."""
        lengths = np.diff(offsets)
        out = np.full(len(lengths), -1, np.int64)
        rows = np.arange(len(lengths))
        state = np.full(len(lengths), self.root, np.int64)
        total = np.zeros(len(lengths), np.int64)
        step = 0
        while len(rows):
            ended = lengths[rows] == step
            done = ended & self.finals[state]
            out[rows[done]] = total[done]
            rows, state, total = rows[~ended], state[~ended], total[~ended]
            if not len(self.keys):
                break
            if len(rows) <= FEW:
                for i, node, passed in zip(rows.tolist(), state.tolist(), total.tolist(), strict=True):
                    out[i] = self._ordinal(data[offsets[i] + step:offsets[i + 1]].tobytes(), node, passed)
                break
            wanted = state * 256 + data[offsets[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            at, rows, total = at[found], rows[found], total[found]
            state, total = self.targets[at].astype(np.int64), total + self.outputs[at]
            step += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term with that ordinal."""
        node, left, out = self.root, int(ordinal), bytearray()
        while not (left == 0 and self.finals[node]):
            first, last = np.searchsorted(self.keys, [node * 256, node * 256 + 256])
            at = first + np.searchsorted(self.outputs[first:last], left, side="right") - 1
            if at < first:
                raise KeyError(ordinal)
            out.append(int(self.keys[at]) & 255)
            left -= int(self.outputs[at])
            node = int(self.targets[at])
        return bytes(out)
