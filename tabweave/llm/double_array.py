"""A double-array trie over byte strings."""

from __future__ import annotations

from collections.abc import Mapping

#: Places tried for a state with several children before it is put behind all others.
TRIES = 16


class DoubleArray:
    """From state s, byte b leads to t = base[s] + b + 1 if check[t] == s; value[t] is the key's number or -1."""

    def __init__(self, keys: Mapping[bytes, int]) -> None:
        ordered = sorted(keys)
        used, base, check, value = bytearray([1]), [0], [0], [-1]
        free = 1  # no cell before it is free
        work = [(0, 0, len(ordered), 0)]  # state, keys[first:last] that start alike, so many bytes in
        while work:
            state, first, last, depth = work.pop()
            if first < last and len(ordered[first]) == depth:
                value[state] = keys[ordered[first]]
                first += 1
            if first >= last:
                continue
            labels, cuts = [], []
            for at in range(first, last):
                if not labels or ordered[at][depth] + 1 != labels[-1]:
                    labels.append(ordered[at][depth] + 1)
                    cuts.append(at)
            start, tries = max(0, free - labels[0]), 0
            while True:
                cells = [start + x for x in labels]
                if cells[-1] >= len(used):
                    more = cells[-1] + 512 - len(used)
                    used += bytes(more)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if not any(map(used.__getitem__, cells)):
                    break
                tries += 1
                after = used.find(0, cells[0] + 1)
                start = start + 1 if after < 0 else after - labels[0]
                if len(labels) > 1 and tries >= TRIES:
                    start = max(start, used.rfind(1) + 1 - labels[0])
            base[state] = start
            for cell in cells:
                used[cell], check[cell] = 1, state
            free = used.find(0, free)
            free = len(used) if free < 0 else free
            for cell, a, z in zip(cells, cuts, [*cuts[1:], last], strict=True):
                work.append((cell, a, z, depth + 1))
        more = max(base) + 258 - len(used)  # so that a look-up needs no bound
        self.base, self.check, self.value = base + [0] * more, check + [-1] * more, value + [-1] * more

    def prefixes(self, data: bytes, start: int = 0) -> list[tuple[int, int]]:
        """Number and end of each key that stands in data from start, shortest first."""
        base, check, value, state, out = self.base, self.check, self.value, 0, []
        for at in range(start, len(data)):
            following = base[state] + data[at] + 1
            if check[following] != state:
                break
            state = following
            if value[state] >= 0:
                out.append((value[state], at + 1))
        return out
