"""A minimal acyclic transducer: words in, runs of integers out.

Built by the incremental algorithm for sorted input (each state is replaced by an equal registered one as soon as its word can
no longer change), so that words share their suffixes. Every arc carries the number of words that sort before the ones behind
it; the sum along a path is the word's rank, and the rank indexes the outputs. The whole is one flat byte string that can be
memory-mapped and read without being parsed.
"""

from __future__ import annotations

import mmap
import struct
from array import array

MAGIC = b"PMLX1\0\0\0"


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``entries`` as bytes. An empty key is not allowed; an empty dictionary gives an empty transducer."""
    words = sorted(entries)
    states: list[dict[int, int]] = [{}]  # state -> byte -> state, with the final flag kept apart
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            s = path.pop()
            key = (final[s], tuple(states[s].items()))
            same = register.get(key)
            if same is None:
                register[key] = s
            else:
                states[path[-1]][last[len(path) - 1]] = same

    for w in words:
        if not w:
            raise ValueError("an empty word can't be in a lexicon")
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        for c in w[k:]:
            states.append({})
            final.append(False)
            states[path[-1]][c] = len(states) - 1
            path.append(len(states) - 1)
        final[path[-1]] = True
        last = w
    close(0)

    live, order = {0: 0}, [0]
    for s in order:
        for t in states[s].values():
            if t not in live:
                live[t] = len(order)
                order.append(t)
    size: dict[int, int] = {}
    for s in _bottom_up(states):
        size[s] = final[s] + sum(size[t] for t in states[s].values())
    first, label, target, before = array("I", [0]), array("B"), array("I"), array("I")
    ends = array("B", (final[s] for s in order))
    for s in order:
        n = int(final[s])
        for c in sorted(states[s]):
            t = states[s][c]
            label.append(c)
            target.append(live[t])
            before.append(n)
            n += size[t]
        first.append(len(label))
    at, ids = array("I", [0]), array("I")
    for w in words:
        ids.extend(entries[w])
        at.append(len(ids))
    parts = [first, target, before, at, ids, label, ends]
    return b"".join([MAGIC, struct.pack("<7I", *map(len, parts)), b"\0" * 4, *(p.tobytes() for p in parts)])


def _bottom_up(states: list[dict[int, int]]) -> list[int]:
    seen, out, stack = {0}, [], [(0, iter(states[0].values()))]
    while stack:
        s, it = stack[-1]
        t = next((x for x in it if x not in seen), None)
        if t is None:
            out.append(s)
            stack.pop()
        else:
            seen.add(t)
            stack.append((t, iter(states[t].values())))
    return out


class Lexicon:
    """Read access to a compiled lexicon, from bytes or memory-mapped from a file."""

    def __init__(self, data: bytes | str):
        if isinstance(data, str):
            with open(data, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("this is no lexicon")
        counts = struct.unpack("<7I", view[8:36])
        at, parts = 40, []
        for n, kind in zip(counts, "IIIIIBB"):
            stop = at + n * (4 if kind == "I" else 1)
            parts.append(view[at:stop].cast(kind))
            at = stop
        self._first, self._target, self._before, self._at, self._ids, self._label, self._ends = parts

    def __len__(self) -> int:
        return len(self._at) - 1

    @property
    def states(self) -> int:
        return len(self._ends)

    def get(self, word: bytes) -> list[int] | None:
        """The output of a word, or None where it is not in the lexicon."""
        s, rank, first, label = 0, 0, self._first, self._label
        for c in word:
            lo, hi = first[s], first[s + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < c:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[s + 1] or label[lo] != c:
                return None
            rank += self._before[lo]
            s = self._target[lo]
        return list(self._ids[self._at[rank] : self._at[rank + 1]]) if word and self._ends[s] else None
