"""External induced sorting of suffixes, with their common prefixes.

The suffixes that begin a falling-to-rising turn (S*) are sorted by naming the
stretches between turns and, where names repeat, by sorting the string of names
in the same way. From them all falling suffixes are induced in ascending order and
from those all rising ones in descending order. An inducing suffix puts the suffix
one token longer into a priority queue, as a tuple of the rank of what induced it, its
place, and the least common prefix since the last suffix that was put in for the same first token: the two
neighbours that come out share that many tokens and one. The queue is monotone: its
ranges of first tokens are disk-backed, a range is read back when its turn comes, and a whole range is
sorted and induces at once.

Tokens, orders and common prefixes are arrays of a ``Scratch``: beyond its bound
they are files that are mapped, not held. What a sort holds in memory is a
range at a time, and ranges grow in number with the string. One token that makes up a large part of the string is
one range; only that can outgrow the bound.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

RANGES = 64


class Scratch:
    """Arrays of a sort: in memory up to ``memory`` bytes each, beyond that in files of a folder under ``place``; queues hold ``most`` entries in memory."""

    def __init__(self, place: str | None = None, memory: int = 16 << 20, most: int = 500_000):
        self.base, self.memory, self.most, self.folder, self.files, self.spilled = place, memory, most, None, 0, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="sort-", dir=self.base)
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, kind: type | str) -> np.ndarray:
        """Zeros."""
        if n * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def gathered(self, parts: Iterable[np.ndarray], kind: type | str) -> np.ndarray:
        """The parts one after the other, however many come."""
        held, size, file, n = [], 0, None, 0
        for x in parts:
            held.append(np.asarray(x, kind))
            size, n = size + held[-1].nbytes, n + len(x)
            if size > self.memory:
                file = file or open(self.path(), "wb")  # noqa: SIM115
                for h in held:
                    h.tofile(file)
                held, size = [], 0
        if file is None:
            return np.concatenate(held) if held else np.zeros(0, kind)
        with file:
            for h in held:
                h.tofile(file)
        return np.memmap(file.name, kind, "r", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class RangeQueue:
    """A monotone priority queue over ``ranges`` ranges; beyond the scratch's bound the fullest ranges go to files. Entries of a range come out as they went in."""

    def __init__(self, ranges: int, scratch: Scratch, width: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.sizes = np.zeros(ranges, np.int64)
        self.on_disk: list[list[tuple[str, int]]] = [[] for _ in range(ranges)]
        self.scratch, self.width = scratch, width

    def push(self, ranges: np.ndarray, entries: np.ndarray) -> None:
        if len(ranges) == 0:
            return
        order = np.argsort(ranges, kind="stable")
        owners, first = np.unique(ranges[order], return_index=True)
        for r, part in zip(owners, np.split(entries[order], first[1:]), strict=True):
            self.parts[r].append(part.copy())  # a view would hold the whole push
            self.sizes[r] += len(part)
        total = int(self.sizes.sum())
        while total > self.scratch.most:
            r = int(self.sizes.argmax())
            total -= int(self.sizes[r])
            self.spill(r)

    def spill(self, r: int) -> None:
        path, rows = self.scratch.path(), np.concatenate(self.parts[r])
        rows.tofile(path)
        self.on_disk[r].append((path, len(rows)))
        self.scratch.spilled += len(rows)
        self.parts[r], self.sizes[r] = [], 0

    def pop(self, r: int) -> np.ndarray:
        rows = [np.fromfile(p, np.int64).reshape(n, self.width) for p, n in self.on_disk[r]] + self.parts[r]
        for p, _ in self.on_disk[r]:
            os.remove(p)
        self.parts[r], self.on_disk[r], self.sizes[r] = [], [], 0
        return np.concatenate(rows) if rows else np.zeros((0, self.width), np.int64)


class Minima:
    """Range minima over an array of small numbers."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of [a, b], a <= b."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.zeros(len(a), np.int64)
        for level in np.unique(k):
            own = k == level
            row = self.levels[level]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << level) + 1])
        return out


def steps(n: int, scratch: Scratch) -> Iterator[tuple[int, int]]:
    """The pieces in which an array of n entries is passed through."""
    size = max(64, scratch.memory // 32)
    return ((a, min(n, a + size)) for a in range(0, n, size))


def ranged(sample: np.ndarray, n: int, scratch: Scratch) -> np.ndarray:
    """Limits that cut values like the sample's into ranges, more of them for a longer string."""
    ranges = int(np.clip(n * 64 // max(1, scratch.memory), RANGES, 1 << 14))
    values = np.unique(sample)
    return values[np.unique(np.linspace(0, len(values) - 1, min(len(values), ranges)).astype(np.int64))]


def sample_of(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    ranges = int(np.clip(len(t) * 64 // max(1, scratch.memory), RANGES, 1 << 14))
    return np.asarray(t[np.linspace(0, len(t) - 1, min(len(t), 16 * ranges)).astype(np.int64)])


def densified(t: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The ranks of the tokens, equal ones the same, and how many there are: a sort by distribution over ranges."""
    limits = ranged(sample_of(t, scratch), len(t), scratch)
    queue, out, base = RangeQueue(len(limits) + 1, scratch, 2), scratch.array(len(t), np.int64), 0
    for a, b in steps(len(t), scratch):
        part = np.asarray(t[a:b], np.int64)
        queue.push(np.searchsorted(limits, part, "right"), np.stack([part, np.arange(a, b)], 1))
    for r in range(len(limits) + 1):
        rows = queue.pop(r)
        if len(rows):
            values, inverse = np.unique(rows[:, 0], return_inverse=True)
            out[rows[:, 1]] = base + inverse
            base += len(values)
    return out, base


def falling(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is greater than the one after it; the last is."""
    out = scratch.array(len(t), bool)
    after = True
    for a, b in reversed(list(steps(len(t), scratch))):
        own = np.asarray(t[a : b + 1], np.int64)
        turn = np.append(np.sign(own[:-1] - own[1:]), np.full(int(b == len(t)), 1))
        # Equal neighbours share their type with the next that differ.
        differ = np.where(turn != 0, np.arange(b - a), b - a)
        nxt = np.minimum.accumulate(differ[::-1])[::-1]
        out[a:b] = np.append(turn > 0, after)[nxt]
        after = bool(out[a])
    return out


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, up to ``cap``, token by token."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        ok = (x < len(t)) & (y < len(t))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if len(live) == 0:
            break
        out[live] = k + 1
    return out


def run_length(t: np.ndarray, p: np.ndarray, cap: int) -> np.ndarray:
    """How often the token at p comes in a row from there, up to ``cap``."""
    out, live, first = np.ones(len(p), np.int64), np.arange(len(p)), t[p]
    for k in range(1, cap):
        ok = p[live] + k < len(t)
        live = live[ok]
        live = live[t[p[live] + k] == first[live]]
        if len(live) == 0:
            break
        out[live] = k + 1
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys, the first counts most; equal keys have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def small(cap: int) -> type:
    return np.uint8 if cap < 256 else np.int32


def induce(t: np.ndarray, letters: int, down: bool, target: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Scans suffixes in the order of their first tokens, falling with ``down``, beginning from sorted ``seeds``, and induces those whose ``target`` is the same as ``not down``.

    ``target`` says which suffixes fall. A seed may be len(t), the empty suffix. Returns places in scan order, whether
    each was induced, the common prefix of each with the one before it (None without ``seed_lcp``), and how many there are.
    """
    n, with_lcp = len(t), seed_lcp is not None

    def value(p: np.ndarray) -> np.ndarray:
        own = t[np.minimum(p, n - 1)]
        return np.where(p < n, letters - 1 - own if down else own, -1)

    def induces(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = p - 1
        return child, (child >= 0) & (target[np.maximum(child, 0)] != down)

    sample = sample_of(t, scratch)
    limits = ranged(letters - 1 - sample if down else sample, n, scratch)
    queue = RangeQueue(len(limits) + 1, scratch, 3)
    cut = np.zeros(len(limits) + 2, np.int64)
    for a, b in steps(len(seeds), scratch):
        cut[1:] += np.bincount(np.searchsorted(limits, value(np.asarray(seeds[a:b])), "right"), minlength=len(limits) + 1)
    cut = np.cumsum(cut)
    out_place, out_made, out_lcp = scratch.array(n + 1, np.int64), scratch.array(n + 1, bool), scratch.array(n + 1, small(cap)) if with_lcp else None
    scanned = 0
    for r in range(len(limits) + 1):
        waiting, own = queue.pop(r), np.asarray(seeds[cut[r] : cut[r + 1]])
        places = [np.concatenate([waiting[:, 1], own])]
        source = [np.full(len(places[0]), -1, np.int64)]
        front, base = np.arange(len(places[0])), 0
        # What the range induces within itself, layer by layer.
        while len(front):
            child, ok = induces(places[-1][front - base])
            ok[ok] = np.searchsorted(limits, value(child[ok]), "right") == r
            if not ok.any():
                break
            base += len(places[-1])
            places.append(child[ok])
            source.append(front[ok])
            front = base + np.arange(int(ok.sum()))
        place, src = np.concatenate(places), np.concatenate(source)
        if len(place) == 0:
            continue
        made = np.ones(len(place), bool)
        made[len(waiting) : len(waiting) + len(own)] = False
        known = np.full(len(place), np.iinfo(np.int64).max)
        known[: len(waiting)] = waiting[:, 0]
        known[len(waiting) : len(waiting) + len(own)] = np.arange(len(own))
        v = value(place)
        rank = dense(v, ~made, known)
        # A layer is in order once the layer that induced it is.
        inner = src >= 0
        for _ in range(len(places) - 1):
            again = dense(rank, np.where(inner, rank[np.maximum(src, 0)], -1))
            if (again == rank).all():
                break
            rank = again
        order = np.argsort(rank, kind="stable")
        p, m, va = place[order], made[order], v[order]
        lcp = None
        if with_lcp:
            lcp = np.zeros(len(order), np.int64)
            carried = np.zeros(len(place), np.int64)
            carried[: len(waiting)] = waiting[:, 2]
            early = m & ~inner[order]
            i = np.flatnonzero(va[1:] == va[:-1]) + 1
            both = early[i] & early[i - 1]
            # Both were put in for the same token, one right after the other.
            lcp[i[both]] = np.minimum(carried[order[i[both]]] + 1, cap)
            edge = i[m[i - 1] & ~m[i]]
            lcp[edge] = np.minimum(run_length(t, p[edge - 1], cap), run_length(t, p[edge], cap)) if len(edge) else 0
            late = i[m[i] & m[i - 1] & ~both]
            lcp[late] = common(t, p[late - 1], p[late], cap)
            seeded = i[~m[i] & ~m[i - 1]]
            lcp[seeded] = seed_lcp[cut[r] + known[order[seeded]]]
            out_lcp[scanned : scanned + len(p)] = lcp
        out_place[scanned : scanned + len(p)] = p
        out_made[scanned : scanned + len(p)] = m
        child, ok = induces(p)
        later = np.searchsorted(limits, value(child[ok]), "right")
        go = np.flatnonzero(ok)[later > r]
        since = np.zeros(len(go), np.int64)
        if with_lcp and len(go):
            # The least common prefix since the last one put in for the same token; ranges have nothing in common.
            token = value(child[go])
            by = np.lexsort((go, token))
            twice = np.flatnonzero(token[by[1:]] == token[by[:-1]])
            since[by[twice + 1]] = Minima(lcp).least(go[by[twice]] + 1, go[by[twice + 1]]) if len(twice) else 0
        queue.push(later[later > r], np.stack([scanned + go, child[go], since], 1))
        scanned += len(p)
    return out_place, out_made, out_lcp, scanned


def names(t: np.ndarray, down: np.ndarray, turns: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Ranks of the stretches between turns, equal stretches the same, and how many there are; a range of first tokens at a time."""
    n, count = len(t), len(turns)
    limits = ranged(sample_of(t, scratch), n, scratch)
    queue = RangeQueue(len(limits) + 1, scratch, 3)
    for a, b in steps(count, scratch):
        own = np.asarray(turns[a : min(count, b + 1)])
        ends = np.append(own[1:], np.full(int(b == count), n))[: b - a]
        queue.push(np.searchsorted(limits, t[own[: b - a]], "right"), np.stack([np.arange(a, b), own[: b - a], ends], 1))
    out, base = scratch.array(count, np.int64), 0
    for r in range(len(limits) + 1):
        rows = queue.pop(r)
        if len(rows) == 0:
            continue
        start, ends = rows[:, 1], rows[:, 2]
        rank = np.zeros(len(rows), np.int64)
        live, k = np.arange(len(rows)), 0
        while len(live):
            at = start[live] + k
            typed = 2 * t[np.minimum(at, n - 1)] + ~down[np.minimum(at, n - 1)]
            key = np.where(at > ends[live], -2, np.where(at >= n, -1, typed))
            # Refine only the stretches that share their rank: new ranks keep the room that the old ones left.
            sub = dense(rank[live], key)
            order = np.argsort(sub, kind="stable")
            old, new = rank[live][order], sub[order]
            spot = np.arange(len(order))
            group_first = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), spot, 0))
            new_first = np.maximum.accumulate(np.where(np.concatenate([[True], new[1:] != new[:-1]]), spot, 0))
            rank[live[order]] = old + new_first - group_first
            _, inverse, counts = np.unique(rank[live], return_inverse=True, return_counts=True)
            live = live[(counts[inverse] > 1) & (key > -1)]
            k += 1
        rank = dense(rank)
        out[rows[:, 0]] = base + rank
        base += int(rank.max()) + 1
    return out, base


def order_of(t: np.ndarray, scratch: Scratch | None = None, cap: int = 200, letters: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(places of all suffixes in order, common prefix of each with the one before it, up to ``cap``; None with ``cap`` 0). ``letters``: the tokens are 0 to ``letters`` - 1."""
    n = len(t)
    scratch = scratch or Scratch()
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, small(cap))
    if letters is None:
        t, letters = densified(t, scratch)
    down = falling(t, scratch)

    def turning() -> Iterator[np.ndarray]:
        for a, b in steps(n, scratch):
            own = np.asarray(down[max(0, a - 1) : b])
            yield np.flatnonzero(~own[1:] & own[:-1]) + 1 + max(0, a - 1)

    turns = scratch.gathered(turning(), np.int64)
    seeds = scratch.array(len(turns) + 1, np.int64)
    seeds[0] = n
    if len(turns):
        name, count = names(t, down, turns, scratch)
        if count < len(turns):
            ranks = order_of(name, scratch, 0, count)[0]
            for a, b in steps(len(turns), scratch):
                seeds[a + 1 : b + 1] = turns[ranks[a:b]]
        else:
            for a, b in steps(len(turns), scratch):
                seeds[1 + name[a:b]] = turns[a:b]
    seed_lcp = scratch.array(len(seeds), small(cap)) if cap else None
    if cap:
        for a, b in steps(max(0, len(turns) - 1), scratch):
            seed_lcp[a + 2 : b + 2] = common(t, np.asarray(seeds[a + 1 : b + 1]), np.asarray(seeds[a + 2 : b + 2]), cap)
    p, made, lcp, count = induce(t, letters, False, down, seeds, seed_lcp, cap, scratch)
    falls = scratch.gathered((a + np.flatnonzero(made[a:b]) for a, b in steps(count, scratch)), np.int64)[::-1]
    seeds = scratch.array(len(falls), np.int64)
    seed_lcp = scratch.array(len(falls), small(cap)) if cap else None
    for a, b in steps(len(falls), scratch):
        own = np.asarray(falls[a:b])
        seeds[a:b] = p[own]
        if cap:
            before = np.asarray(falls[max(0, a - 1) : b - 1])
            # A falling suffix after a turn has another first token: nothing in common.
            seed_lcp[max(1, a) : b] = np.where(before - own[len(own) - len(before) :] > 1, 0, lcp[before])
    p, _, lcp, count = induce(t, letters, True, down, seeds, seed_lcp, cap, scratch)
    order = p[:count][::-1]
    if not cap:
        return order, None
    out = scratch.array(n, small(cap))
    for a, b in steps(n - 1, scratch):
        out[a + 1 : b + 1] = lcp[n - b : n - a][::-1]
    return order, out
