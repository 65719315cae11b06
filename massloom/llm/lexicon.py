"""A minimal acyclic transducer from words to token ids, in a file that is memory-mapped.

Words share prefixes and suffixes. Every arc carries how many words of its state come before it, so the sum along a word's path is the word's
number, and the number gives its slice of the ids: outputs need no states of their own and suffixes with different outputs are shared.
Whole arrays of words are looked up at once, one byte of all of them a step.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

_PARTS = (("keys", np.int64), ("targets", np.int32), ("before", np.int32), ("final", np.uint8), ("starts", np.int64), ("ids", np.int32))


class _State:
    __slots__ = ("arcs", "count", "final", "number")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.count = 0


def _minimal(words: Iterable[bytes]) -> _State:
    """The minimal automaton of words in ascending order: what follows the common prefix with the next word is final and is merged."""
    root = _State()
    register: dict[tuple, _State] = {}
    path: list[tuple[_State, int, _State]] = []
    before = b""

    def merge(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            signature = (child.final, tuple((b, id(s)) for b, s in child.arcs.items()))
            parent.arcs[label] = register.setdefault(signature, child)

    for word in words:
        if word <= before and before:
            raise ValueError("words have to be distinct and ascending")
        common = 0
        for x, y in zip(word, before, strict=False):
            if x != y:
                break
            common += 1
        merge(common)
        state = path[-1][2] if path else root
        for label in word[common:]:
            child = _State()
            state.arcs[label] = child
            path.append((state, label, child))
            state = child
        state.final = True
        before = word
    merge(0)
    return root


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file of the transducer of `entries` (non-empty words and their ids)."""
    words = sorted(entries)
    root = _minimal(words)
    order: list[_State] = []
    stack = [root]
    while stack:  # children before parents, whatever the depth
        state = stack.pop()
        if state.number == -1:
            state.number = -2
            stack.append(state)
            stack.extend(s for s in state.arcs.values() if s.number == -1)
        elif state.number == -2:
            state.number = len(order)
            state.count = state.final + sum(s.count for s in state.arcs.values())
            order.append(state)
    keys, targets, before = [], [], []
    for state in order:
        passed = int(state.final)
        for label in sorted(state.arcs):
            child = state.arcs[label]
            keys.append(state.number * 256 + label)
            targets.append(child.number)
            before.append(passed)
            passed += child.count
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(entries[w]) for w in words], out=starts[1:])
    arrays = {"keys": keys, "targets": targets, "before": before, "final": [s.final for s in order], "starts": starts, "ids": [i for w in words for i in entries[w]]}
    cast = [np.asarray(arrays[n], t) for n, t in _PARTS]
    head = np.array([root.number, *map(len, cast)], np.int64).tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in cast)


class Lexicon:
    """A compiled transducer, mapped and not read."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        head = data[: 8 * (1 + len(_PARTS))].view(np.int64)
        self.root, at = int(head[0]), head.nbytes
        for (name, kind), n in zip(_PARTS, head[1:].tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, data[at : at + size].view(kind))
            at += size + -size % 8

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each word of a byte array cut at `offsets`, -1 for words that aren't held."""
        out = np.full(len(offsets) - 1, -1, np.int64)
        if not len(self.keys):
            return out
        begin, length = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        active = np.flatnonzero(length > 0)
        state, total = np.full(len(active), self.root, np.int64), np.zeros(len(active), np.int64)
        step = 0
        while len(active):
            key = state * 256 + data[begin[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[at] == key
            active, at = active[held], at[held]
            state, total = self.targets[at].astype(np.int64), total[held] + self.before[at]
            step += 1
            ends = length[active] == step
            done = ends & (self.final[state] == 1)
            out[active[done]] = total[done]
            active, state, total = active[~ends], state[~ends], total[~ends]
        return out
