"""Suffix sorting of a shard by external induced sorting.

What grows with the text lies in files that are mapped or appended to: symbols, LMS positions, names, L-type suffixes, output. In
memory are at most some multiples of `budget` tuples. The priority queue (`DiskQueue`) is monotone: keys are characters
or ranges of them (slabs), and within a key arrival order is rank order. A pass over ascending slabs induces the L-type suffixes from the
sorted LMS suffixes, a pass over descending ones the S-type suffixes. At the first level, where a slab is one character, tuples
carry their common prefix with the tuple before; a pushed tuple's is one more than the least one between its source
and the source pushed before. At deeper levels a slab is a range of names; suffixes induced within their own slab are
ranked by their chains of sources. LMS substrings are sorted over packed words, dealt to disk by the first word, and the
string of their names is sorted by the same induction, recursively, whatever its alphabet.

Cases: an empty text has no suffixes; a text of one character, runs and periods are sorted as any other; `cap` is below 255.
"""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a queue in memory; a slab and a block of tuples are half as large.
IN_MEMORY = 1 << 18


def scratch() -> str | None:
    """The folder that Spark gives this executor for spilled data (SPARK_LOCAL_DIRS); a task's files in it go with the task."""
    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return dirs[os.getpid() % len(dirs)] if dirs else None


class DiskQueue:
    """Integers by key, first in first out within a key; the fullest keys go to disk beyond `budget` integers."""

    def __init__(self, folder: str, name: str, budget: int):
        self.base, self.budget, self.held = os.path.join(folder, name), budget, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.disk: set[int] = set()
        self.spilled = 0

    def push(self, key: int, values: np.ndarray) -> None:
        if len(values):
            self.memory.setdefault(key, []).append(values)
            self.size[key] = self.size.get(key, 0) + len(values)
            self.held += len(values)
            while self.held > self.budget:
                self._spill(max(self.size, key=self.size.get))

    def push_sorted(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Values with ascending keys."""
        if len(keys):
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
            for a, b in itertools.pairwise(cuts):
                self.push(int(keys[a]), values[a:b])

    def _spill(self, key: int) -> None:
        with open(f"{self.base}-{key}", "ab") as f:
            for part in self.memory.pop(key):
                f.write(np.ascontiguousarray(part, np.int64).tobytes())
        n = self.size.pop(key)
        self.held -= n
        self.spilled += n
        self.disk.add(key)

    def drain(self, key: int) -> Iterator[np.ndarray]:
        """The key's integers in order, at most half a budget at once, until there are none, also of those pushed meanwhile."""
        block = max(1, self.budget // 2)
        while key in self.disk or key in self.memory:
            if key in self.disk:  # older than what is in memory
                self.disk.discard(key)
                path = f"{self.base}-{key}"
                os.rename(path, path + ".out")
                with open(path + ".out", "rb") as f:
                    while raw := f.read(8 * block):
                        yield np.frombuffer(raw, np.int64)
                os.remove(path + ".out")
                continue
            parts = self.memory.pop(key)
            self.held -= self.size.pop(key)
            whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
            for a in range(0, len(whole), block):
                yield whole[a : a + block]

    def all_of(self, key: int) -> np.ndarray:
        parts = list(self.drain(key))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class SuffixSorter:
    """Sorts suffixes of texts of non-negative integers; lcp values stop at `cap`. `spilled` and `levels` tell what a sort took."""

    def __init__(self, folder: str, cap: int, budget: int = IN_MEMORY):
        assert cap < 255
        self.folder, self.cap, self.budget, self.block = folder, cap, budget, max(1, budget // 2)
        self.spilled = self.levels = 0
        self.names = itertools.count()

    def file(self, dtype, n: int) -> np.ndarray:
        """An array of zeros in a file without a name, which goes with the array."""
        with tempfile.TemporaryFile(dir=self.folder) as f:
            return np.asarray(np.memmap(f, dtype, "w+", shape=max(1, n)))[:n]

    @staticmethod
    def places(n: int):
        return np.int32 if n < 1 << 31 else np.int64

    def queue(self) -> DiskQueue:
        return DiskQueue(self.folder, f"q{next(self.names)}", self.budget)

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        return ((a, min(n, a + self.block)) for a in range(0, n, self.block))

    def sort(self, text: np.ndarray, k: int, level: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """Suffix positions in order and, at the first level, each one's common prefix with the one before. Characters are below k."""
        self.levels = max(self.levels, level + 1)
        n = len(text)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        symbols, stars = self.symbols(text, k)
        if len(stars) > 1:
            stars = self.sorted_stars(symbols, stars, k, level)
        return self.with_prefixes(text, symbols, k, stars) if level == 0 else (self.by_slabs(symbols, k, stars), None)

    # Symbols are 1 + 2 * character + type, where S-type is 1.

    def symbols(self, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The text's symbols, and its LMS positions; both in files."""
        n = len(text)
        out = self.file(np.int16 if 2 * k + 2 < 1 << 15 else np.int32 if 2 * k + 2 < 1 << 31 else np.int64, n)
        carry, count = False, 0
        for b in range(n, 0, -self.block):
            a = max(0, b - self.block)
            t = np.asarray(text[a : min(n, b + 1)], np.int64)
            differs = np.flatnonzero(t[:-1] != t[1:])
            rising = t[differs] < t[differs + 1]
            kinds = np.repeat(np.append(rising, carry), np.diff(np.concatenate([[-1], differs, [b - a - 1]])))
            out[a:b] = 1 + 2 * t[: b - a] + kinds
            carry = bool(kinds[0])
        kind_of = self.places(n)
        with tempfile.TemporaryFile(dir=self.folder) as f:
            for a, b in self.blocks(n):
                kind = (np.asarray(out[max(0, a - 1) : b]) - 1) & 1
                found = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 0)) + max(0, a - 1) + 1
                f.write(found.astype(kind_of).tobytes())
                count += len(found)
            f.flush()
            return out, np.asarray(np.memmap(f, kind_of, "r", shape=count)) if count else np.zeros(0, kind_of)

    # LMS substrings

    def sorted_stars(self, symbols: np.ndarray, stars: np.ndarray, k: int, level: int) -> np.ndarray:
        """LMS positions in the order of their suffixes."""
        m, n = len(stars), len(symbols)
        bits = int(2 * k + 1).bit_length()
        width = 62 // bits

        def words(which: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
            """The depth-th packed word of LMS substrings, and whether more follows."""
            at = stars[which].astype(np.int64) + depth * width
            end = np.where(which + 1 < m, stars[np.minimum(which + 1, m - 1)], n - 1)
            out = np.zeros(len(which), np.int64)
            for j in range(width):
                ok = at + j <= end
                out = (out << bits) | np.where(ok, symbols[np.minimum(at + j, n - 1)], 0)
            return out, at + width <= end

        def refined(which: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
            """`which` in order, and whether each is the same substring as the one before."""
            which = which.copy()
            head = np.zeros(len(which), bool)
            head[:1] = True
            live = np.arange(len(which))
            while len(live):
                group = np.cumsum(head)[live]
                key, more = words(which[live], depth)
                o = np.lexsort((key, group))
                which[live] = which[live][o]
                key, more = key[o], more[o]
                head[live[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
                bounds = np.flatnonzero(np.append(head, True))
                alone = np.diff(bounds) == 1
                live = live[more & ~alone[np.cumsum(head)[live] - 1]]
                depth += 1
            return which, ~head

        def in_order(which: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Blocks of star numbers in order of their substrings; those in `which` (perhaps a file) agree before `depth`."""
            if len(which) <= 2 * self.block:
                yield refined(which.astype(np.int64), depth)
                return
            sample, _ = words(which[:: max(1, len(which) // 4096)].astype(np.int64), depth)
            sample.sort()
            bounds = np.unique(sample[np.linspace(0, len(sample) - 1, min(len(sample), 2 + 2 * len(which) // self.block)).astype(np.int64)])
            # A word of a bound has a slab for itself, as it may be very frequent.
            queue, sizes, unfinished = self.queue(), np.zeros(2 * len(bounds) + 1, np.int64), np.zeros(2 * len(bounds) + 1, bool)
            for a, b in self.blocks(len(which)):
                part = which[a:b].astype(np.int64)
                key, more = words(part, depth)
                slab = np.searchsorted(bounds, key) + np.searchsorted(bounds, key, "right")
                sizes += np.bincount(slab, minlength=len(sizes))
                unfinished[slab[more]] = True
                o = np.argsort(slab, kind="stable")
                queue.push_sorted(slab[o], part[o])
            for slab in np.flatnonzero(sizes).tolist():
                whole, at = self.file(self.places(m), int(sizes[slab])), 0
                for part in queue.drain(slab):
                    whole[at : at + len(part)] = part
                    at += len(part)
                if slab % 2 == 0:
                    yield from in_order(whole, depth)
                elif unfinished[slab]:
                    yield from in_order(whole, depth + 1)
                else:
                    for a, b in self.blocks(len(whole)):
                        yield whole[a:b].astype(np.int64), np.arange(a, b) > 0
            self.spilled += queue.spilled

        numbers, names = self.file(self.places(m), m), self.file(self.places(m), m)
        for a, b in self.blocks(m):
            numbers[a:b] = np.arange(a, b)
        order, at, name = self.file(self.places(m), m), 0, -1
        for which, same in in_order(numbers, 0):
            own = name + np.cumsum(~same)
            name = int(own[-1])
            names[which] = own
            order[at : at + len(which)] = which
            at += len(which)
        del numbers
        if name + 1 < m:
            del order
            order, _ = self.sort(names, name + 1, level + 1)
        del names
        out = self.file(self.places(n), m)
        for a, b in self.blocks(m):
            out[a:b] = stars[order[a:b]]
        return out

    # Induction of a string of names, by slabs

    def slabs(self, symbols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First names of the slabs (and k at the end), and the number of L-type suffixes before each."""
        counts = self.file(np.int64, 2 * k + 2)
        for a, b in self.blocks(len(symbols)):
            u, c = np.unique(np.asarray(symbols[a:b]), return_counts=True)
            counts[u] += c
        starts, before, total, l_total, last = [], [], 0, 0, False
        for a, b in self.blocks(k):
            part = np.asarray(counts[1 + 2 * a : 1 + 2 * b]).reshape(-1, 2)
            size = part.sum(1)
            ends = total + np.cumsum(size)
            heavy = size > self.block // 4
            new = np.append(False, (ends[:-1] // self.block) != (np.append(total, ends[:-2]) // self.block)) | heavy | np.append(last, heavy[:-1])
            new[0] |= a == 0
            l_before = l_total + np.cumsum(part[:, 0]) - part[:, 0]
            starts.append(np.flatnonzero(new) + a)
            before.append(l_before[new])
            total, l_total, last = int(ends[-1]), int(l_before[-1] + part[-1, 0]), bool(heavy[-1])
        return np.concatenate([*starts, [k]]), np.concatenate([*before, [l_total]])

    def by_slabs(self, symbols: np.ndarray, k: int, stars: np.ndarray) -> np.ndarray:
        """All suffixes in order, induced from LMS suffixes given in order."""
        n = len(symbols)
        starts, l_before = self.slabs(symbols, k)
        last = len(starts) - 1
        star_ends = np.zeros(last + 1, np.int64)
        slab_of = lambda char: np.searchsorted(starts, char, "right") - 1
        for a, b in self.blocks(len(stars)):
            star_ends[1:] += np.bincount(slab_of((symbols[stars[a:b]] - 1) >> 1), minlength=last)
        star_ends = np.cumsum(star_ends)
        l_type, out = self.file(self.places(n), int(l_before[-1])), self.file(self.places(n), n)

        def children(pos: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Numbers of those whose predecessor has the wanted type, the predecessors and their characters."""
            pos = pos.astype(np.int64)
            s = symbols[np.maximum(pos - 1, 0)].astype(np.int64) - 1
            at = np.flatnonzero((pos > 0) & ((s & 1) == kind))
            return at, pos[at] - 1, s[at] >> 1

        def send(queue: DiskQueue, pos: np.ndarray, kind: int, but: int = -1) -> None:
            _, before, char = children(pos, kind)
            slab = slab_of(char)
            if but >= 0:
                before, slab = before[slab != but], slab[slab != but]
            o = np.argsort(slab, kind="stable")
            queue.push_sorted(slab[o], before[o])

        queue = self.queue()
        send(queue, np.array([n], np.int64), 0)
        at = 0
        for s in range(last):
            mine = range(int(star_ends[s]), int(star_ends[s + 1]), self.block)
            if starts[s + 1] - starts[s] == 1:
                for pos in queue.drain(s):
                    l_type[at : at + len(pos)] = pos
                    at += len(pos)
                    send(queue, pos, 0)
                for a in mine:
                    send(queue, np.asarray(stars[a : min(star_ends[s + 1], a + self.block)]), 0)
            else:
                pos, final = self.within(symbols, queue.all_of(s), np.asarray(stars[star_ends[s] : star_ends[s + 1]]), int(starts[s]), int(starts[s + 1]), children, 0)
                own = pos[~final]
                l_type[at : at + len(own)] = own
                at += len(own)
                send(queue, pos, 0, s)
        self.spilled += queue.spilled
        queue, end = self.queue(), n
        for s in range(last - 1, -1, -1):
            a, b = int(l_before[s]), int(l_before[s + 1])
            if starts[s + 1] - starts[s] == 1:
                for pos in itertools.chain(queue.drain(s), (l_type[max(a, x - self.block) : x][::-1] for x in range(b, a, -self.block))):
                    out[end - len(pos) : end] = pos[::-1]
                    end -= len(pos)
                    send(queue, np.asarray(pos), 1)
            else:
                pos, _ = self.within(symbols, queue.all_of(s), np.asarray(l_type[a:b])[::-1], int(starts[s]), int(starts[s + 1]), children, 1)
                out[end - len(pos) : end] = pos[::-1]
                end -= len(pos)
                send(queue, pos, 1, s)
        self.spilled += queue.spilled
        return out

    @staticmethod
    def within(symbols: np.ndarray, first: np.ndarray, final: np.ndarray, lo: int, hi: int, children, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """A slab's suffixes in the order of the pass, and which of them are of `final`.

        `first` were induced from other slabs, in order; `final` come last among those of their character. What these induce
        within the slab stands between, in the order of its sources: a suffix compares by its character, then as its source
        does. Chains of sources end in a suffix whose place is known, and are compared in steps of doubled length."""
        edge = np.concatenate([first, final]).astype(np.int64)
        found, sources, chars = [edge], [np.arange(len(edge))], [(symbols[edge].astype(np.int64) - 1) >> 1]
        number, total = sources[0], len(edge)
        while True:
            at, before, c = children(edge, kind)
            own = (c >= lo) & (c < hi)
            if not own.any():
                break
            found.append(before[own])
            sources.append(number[at[own]])
            chars.append(c[own])
            edge = before[own]
            number = np.arange(total, total + len(edge))
            total += len(edge)
        pos, source, char = np.concatenate(found), np.concatenate(sources), np.concatenate(chars)
        side = hi - 1 - char if kind else char - lo
        known = len(first) + len(final)
        # By character, then: induced from elsewhere, induced here, final. Those induced here tie for now.
        place = np.ones(total, np.int64)
        place[: len(first)] = 0
        place[len(first) : known] = 2
        key = (3 * side + place) * (total + 1) + np.where(source == np.arange(total), np.arange(total), 0)
        while True:
            order = np.argsort(key, kind="stable")
            new = np.append(False, np.diff(key[order]) != 0)
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(new)
            if total < 2 or new[1:].all():
                return pos[order], place[order] == 2
            key = rank * total + rank[source]
            source = source[source]

    # Induction at the first level, where tuples (8 * position bits, lcp) carry common prefixes

    def with_prefixes(self, text: np.ndarray, symbols: np.ndarray, k: int, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, cap = len(text), self.cap
        # Characters are below 255, so a character and one fit into a byte; zeros lie beyond the end.
        shifted = self.file(np.uint8, n + cap + 8)
        for a, b in self.blocks(n):
            shifted[a:b] = text[a:b].astype(np.uint8) + np.uint8(1)
        words = np.ndarray((n + cap,), np.uint64, shifted, strides=(1,))

        def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.full(len(x), cap, np.int64)
            live = np.arange(len(x))
            for depth in range(0, cap, 8):
                differ = words[x[live] + depth] ^ words[y[live] + depth]
                ended = differ != 0
                low = differ[ended] & (~differ[ended] + np.uint64(1))
                out[live[ended]] = np.minimum(cap, depth + (np.log2(low.astype(float)).astype(np.int64) >> 3))
                live = live[~ended]
                if not len(live):
                    break
            return out

        pending, seen = np.zeros(k, np.int64), np.zeros(k, bool)

        def send(queue: DiskQueue, pos: np.ndarray, lcp: np.ndarray, kind: int) -> None:
            s = symbols[np.maximum(pos - 1, 0)] - 1
            at = np.flatnonzero((pos > 0) & ((s & 1) == kind))
            least = np.minimum.accumulate(lcp)
            if len(at):
                target = s[at] >> 1
                o = np.argsort(target, kind="stable")
                at, target = at[o], target[o]
                new = np.concatenate([[True], target[1:] != target[:-1]])
                own = np.empty(len(at), np.int64)
                pair = np.flatnonzero(~new)
                own[pair] = np.minimum(least_between(lcp, at[pair - 1] + 1, at[pair]) + 1, cap)
                heads = np.flatnonzero(new)
                keys = target[heads]
                own[heads] = np.where(seen[keys], np.minimum(np.minimum(pending[keys], least[at[heads]]) + 1, cap), 0)
                after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], cap)
                seen[keys] = True
                np.minimum(pending, int(least[-1]), out=pending)
                pending[keys] = after[at[np.append(heads[1:], len(at)) - 1] + 1]
                queue.push_sorted(target, (pos[at] - 1) << 8 | own)
            else:
                np.minimum(pending, int(least[-1]), out=pending)

        bounds = np.zeros(k + 1, np.int64)
        for a, b in self.blocks(len(stars)):
            bounds[1:] += np.bincount((symbols[stars[a:b]] - 1) >> 1, minlength=k)
        bounds = np.cumsum(bounds)
        l_count = np.zeros(k + 1, np.int64)
        for a, b in self.blocks(n):
            s = np.asarray(symbols[a:b]) - 1
            l_count[1:] += np.bincount(s[(s & 1) == 0] >> 1, minlength=k)
        l_count = np.cumsum(l_count)
        l_type, l_lcp = self.file(self.places(n), int(l_count[-1])), self.file(np.uint8, int(l_count[-1]))

        queue, at = self.queue(), 0
        first = int(text[n - 1])
        queue.push(first, np.array([(n - 1) << 8], np.int64))  # the last suffix follows the empty one
        seen[first] = True
        for c in range(k):
            pending[:] = 0
            last = -1
            for block in queue.drain(c):
                l_type[at : at + len(block)] = block >> 8
                l_lcp[at : at + len(block)] = block & 255
                at += len(block)
                last = int(block[-1]) >> 8
                send(queue, block >> 8, block & 255, 0)
            for a in range(int(bounds[c]), int(bounds[c + 1]), self.block):
                pos = stars[a : min(bounds[c + 1], a + self.block)].astype(np.int64)
                before = np.append(stars[a - 1] if a > bounds[c] else last, pos[:-1])
                lcp = common(np.maximum(before, 0), pos)
                if before[0] < 0:
                    lcp[0] = 0
                send(queue, pos, lcp, 0)
        self.spilled += queue.spilled

        queue, end = self.queue(), n
        seen[:] = False
        out_pos, out_lcp = self.file(self.places(n), n), self.file(np.uint8, n)
        for c in range(k - 1, -1, -1):
            pending[:] = 0
            last = -1

            def place(pos: np.ndarray, lcp: np.ndarray) -> None:
                # In descending order a tuple's lcp is that with the next larger suffix, which has it in the output.
                nonlocal end
                out_pos[end - len(pos) : end] = pos[::-1]
                if end < n:
                    out_lcp[end] = lcp[0]
                out_lcp[end - len(pos) + 1 : end] = lcp[:0:-1]
                end -= len(pos)

            for block in queue.drain(c):
                place(block >> 8, block & 255)
                last = int(block[-1]) >> 8
                send(queue, block >> 8, block & 255, 1)
            a, b = int(l_count[c]), int(l_count[c + 1])
            for y in range(b, a, -self.block):
                x = max(a, y - self.block)
                block = l_type[x:y][::-1].astype(np.int64)
                # Ascending tuples carry the lcp with the smaller neighbour; turned round, with the larger one.
                lcp = np.empty(len(block), np.int64)
                lcp[1:] = l_lcp[x + 1 : y][::-1]
                if y < b:
                    lcp[0] = l_lcp[y]
                else:
                    lcp[0] = common(block[:1], np.array([last]))[0] if last >= 0 else 0
                place(block, lcp)
                send(queue, block, lcp, 1)
        self.spilled += queue.spilled
        return out_pos, out_lcp


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a..b]) for each pair, both ends included; values are below 256."""
    if not len(a):
        return np.zeros(0, np.int64)
    length = b - a + 1
    level = np.log2(length).astype(np.int64)
    out = np.empty(len(a), np.int64)
    table = values.astype(np.uint8)
    for k in range(int(level.max()) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[a[mine]], table[b[mine] - (1 << k) + 1])
    return out


class sorted_suffixes:  # noqa: N801
    """Context of (positions, lcp, sorter) of a text whose characters are below 255; both arrays lie in files that go at its end."""

    def __init__(self, text: np.ndarray, cap: int, budget: int = IN_MEMORY, folder: str | None = None):
        self.args = text, cap, budget
        self.folder = tempfile.mkdtemp(prefix="suffixes-", dir=folder or scratch())

    def __enter__(self) -> tuple[np.ndarray, np.ndarray, SuffixSorter]:
        text, cap, budget = self.args
        sorter = SuffixSorter(self.folder, cap, budget)
        pos, lcp = sorter.sort(text, int(text.max()) + 1 if len(text) else 1)
        return pos, lcp, sorter

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
