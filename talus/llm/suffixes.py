"""External induced sorting of suffixes, with common-prefix values.

What is sorted are the first LENGTH bytes from the window starts of many byte strings (runs). Every run holds an anchor,
a core of bytes that is named by a 64-bit number, and its windows start 0, 1, 2, ... bytes (the level) before the anchor.
Equal windows have equal anchors at equal levels, so that each level is an order of its own, and is induced from the
one before:

1. The sample suffixes, one a run, are what follows the core. They are sorted over the reduced string, whose symbols are
   words of WORD bytes: from the last word to the first, the order of the suffixes that start at word j + 1 induces the
   order of those that start at word j. The end of a run is less than any byte.
2. The core goes in front of them (its name is one symbol): that is level 0.
3. Level d + 1 is induced from level d by the byte in front.

An induction step is a priority queue: in the order of the level, each suffix tuple is pushed with its new first
symbol, and tuples come out by symbol and, among equal ones, in the order they were pushed in. Tuples carry along where the
suffix stands, its run and levels; the common prefix of two that come out next to each other with one symbol is that symbol
more than the least common prefix between them in the level before, and of two symbols of one core the bytes they share.
Two neighbours that share LENGTH bytes are repeated windows. A tuple whose neighbours share so little that its last level
can't reach LENGTH any more is pushed no further; this loses nothing, as no other suffix shares more than a neighbour.

Runs that are one in bytes come as one tuple with a mark that it stands more than once: all its windows repeat.

Memory: queues, orders, common prefixes and the text stay in memory up to `memory` bytes each, and beyond it in scratch
files of the task that are worked on in blocks of about that size. Files end with the task; a lost task starts again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that each of a shard's queues and arrays may take in memory.
MEMORY = 1 << 20
WORD = 8
#: group: name of the core, from level 0 on its number in the order; size: bytes after the core; first, left: the levels of
#: the run's windows; open: the level where the repeats that are not yet given out begin, or -1.
TUPLE = np.dtype([("key", "u8"), ("group", "u8"), ("at", "i8"), ("rank", "u4"), ("run", "u4"), ("core", "u2"), ("size", "u2"), ("first", "i2"), ("left", "i2"), ("open", "i2"), ("many", "?")])
CAP = np.iinfo(np.int16).max


class Scratch:
    """Arrays of one task, in unlinked files where they exceed memory; written counts the bytes that went to files."""

    def __init__(self, memory: int):
        self.memory, self.written = memory, 0

    def rows(self, dtype: np.dtype) -> int:
        return max(256, self.memory // dtype.itemsize)

    def array(self, n: int, dtype, shares: int = 1) -> np.ndarray:
        """One of so many arrays that share memory."""
        dtype = np.dtype(dtype)
        if n * dtype.itemsize * shares <= self.memory:
            return np.empty(n, dtype)
        with tempfile.TemporaryFile() as file:
            file.truncate(n * dtype.itemsize)
            self.written += n * dtype.itemsize
            return np.memmap(file, dtype, "r+", shape=(n,))


class Spool:
    """An array that grows at its end."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.file, self.held, self.size, self.n = scratch, np.dtype(dtype), None, [], 0, 0

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.n += len(rows)
        self.size += rows.nbytes
        if self.size > self.scratch.memory:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.held:
                self.file.write(np.ascontiguousarray(x).tobytes())
            self.scratch.written += self.size
            self.held, self.size = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        for x in self.held:
            self.file.write(np.ascontiguousarray(x).tobytes())
        self.held = []
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


class Queue:
    """Tuples come out by key, equal keys in the order they were pushed in. Sorted runs go to a file beyond memory and are merged by blocks."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.n, self.count, self.file, self.runs = scratch, [], 0, 0, None, []

    def push(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.held.append(rows)
        self.n += len(rows)
        self.count += len(rows)
        if self.n > self.scratch.rows(TUPLE):
            rows = self._sorted()
            self.file = self.file or tempfile.TemporaryFile()
            self.runs.append([self.file.seek(0, 2), len(rows)])
            self.file.write(rows.tobytes())
            self.scratch.written += rows.nbytes

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held) if len(self.held) > 1 else self.held[0] if self.held else np.zeros(0, TUPLE)
        self.held, self.n = [], 0
        return rows[np.argsort(rows["key"], kind="stable")]

    def blocks(self) -> Iterator[np.ndarray]:
        """All tuples in order; the queue is empty after that."""
        last = self._sorted()
        if not self.runs:
            if len(last):
                yield last
            return
        take = max(64, self.scratch.rows(TUPLE) // (len(self.runs) + 1))
        buffers = [self._read(r, take) for r in range(len(self.runs))] + [last]
        while True:
            # what is read of a run that goes on in the file is a bound: keys up to its last, and after that later runs
            bounds = [(b["key"][-1], r) for r, b in enumerate(buffers) if r < len(self.runs) and self.runs[r][1]]
            if not bounds:
                break
            key, run = min(bounds)
            ready = []
            for r, b in enumerate(buffers):
                k = np.searchsorted(b["key"], key, "right" if r <= run else "left")
                ready.append(b[:k])
                buffers[r] = b[k:]
            rows = np.concatenate(ready)
            yield rows[np.argsort(rows["key"], kind="stable")]
            buffers[run] = np.concatenate([buffers[run], self._read(run, take)])
        rows = np.concatenate(buffers)
        if len(rows):
            yield rows[np.argsort(rows["key"], kind="stable")]

    def _read(self, run: int, take: int) -> np.ndarray:
        at, n = self.runs[run]
        take = min(take, n)
        self.file.seek(at)
        self.runs[run] = [at + take * TUPLE.itemsize, n - take]
        return np.frombuffer(self.file.read(take * TUPLE.itemsize), TUPLE)


class Ranges:
    """Least values of ranges of an array, from tables of the least of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray, scratch: Scratch):
        self.tables, n, block = [values], len(values), scratch.rows(np.dtype("i2"))
        while n >= 1 << len(self.tables):
            half, below = 1 << (len(self.tables) - 1), self.tables[-1]
            table = scratch.array(n - 2 * half + 1, np.int16, n.bit_length())
            for lo in range(0, len(table), block):
                hi = min(lo + block, len(table))
                np.minimum(below[lo:hi], below[lo + half : hi + half], out=table[lo:hi])
            self.tables.append(table)

    def least(self, after: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of values[after + 1 .. to], for after < to."""
        size = to - after
        power = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(size), np.int16)
        for p in np.unique(power).tolist():
            k = np.flatnonzero(power == p)
            out[k] = np.minimum(self.tables[p][after[k] + 1], self.tables[p][to[k] - (1 << p) + 1])
        return out


class Sorter:
    """The repeated windows of the runs that are added."""

    def __init__(self, length: int, memory: int | None = None):
        self.length, self.scratch = length, Scratch(MEMORY if memory is None else memory)
        self.text, self.queue, self.most = Spool(self.scratch, np.uint8), Queue(self.scratch), 0
        self.runs = 0

    def add(self, group, many, core, first, left, data: np.ndarray, at: np.ndarray) -> None:
        """Runs with bytes data[at[i] : at[i + 1]]: the core starts left bytes after the start and names the group; windows start at levels first to left."""
        n = len(group)
        data, at = data[at[0] : at[-1]], at - at[0]
        step = max(1, self.scratch.rows(TUPLE) // 2)
        for lo in range(0, n, step):
            k = slice(lo, min(n, lo + step))
            rows = np.zeros(len(group[k]), TUPLE)
            rows["group"], rows["many"], rows["core"], rows["first"], rows["left"], rows["open"] = group[k], many[k], core[k], first[k], left[k], -1
            rows["at"] = self.text.n + at[:-1][k] + left[k]
            rows["size"] = rows["key"] = at[1:][k] - at[:-1][k] - left[k] - core[k]
            rows["run"] = self.runs + lo + np.arange(len(rows))
            self.most = max(self.most, int(rows["size"].max()))
            self.queue.push(rows)
        self.runs += n
        self.text.add(data)

    def _words(self, text: np.ndarray, rows: np.ndarray, j: int) -> np.ndarray:
        """Word j after the core, as a number whose order is that of the bytes; zeros after the end."""
        begin = rows["at"] + rows["core"] + WORD * j
        left = np.maximum(rows["size"].astype(np.int64) - WORD * j, 0)
        out = np.zeros(len(rows), np.uint64)
        for k in range(WORD):
            has = np.flatnonzero(left > k)
            out[has] |= text[begin[has] + k].astype(np.uint64) << np.uint64(8 * (WORD - 1 - k))
        return out

    def _order(self, queue: Queue, ranges: Ranges | None, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The tuples of a queue in order, and what each shares with the one before (0 for the first, and one 0 more at the end)."""
        rows, shared = self.scratch.array(queue.count, TUPLE), self.scratch.array(queue.count + 1, np.int16)
        done, before, groups = 0, None, -1
        for block in queue.blocks():
            n = len(block)
            block = block.copy()
            pair = np.concatenate([block[:1] if before is None else before, block])
            same = pair["key"][1:] == pair["key"][:-1]
            if before is None:
                same[0] = False
            value = np.zeros(n, np.int16)
            k = np.flatnonzero(same)
            if ranges is not None:
                value[k] = ranges.least(pair["rank"][k].astype(np.int64), pair["rank"][k + 1].astype(np.int64))
            if kind == "word":
                value[k] = np.minimum(value[k] + WORD, CAP)
                k = np.flatnonzero(~same)
                differ = pair["key"][k] ^ pair["key"][k + 1]
                value[k] = sum((differ >> np.uint64(64 - 8 * b) == 0).astype(np.int16) for b in range(1, WORD))
                value = np.minimum(value, np.minimum(pair["size"][1:], pair["size"][:-1]).astype(np.int16)) if self.word == 0 else value
            elif kind == "core":
                value[k] = np.minimum(value[k].astype(np.int64) + block["core"][k], self.length)
                block["group"] = groups + np.cumsum(~same)
                groups = int(block["group"][-1])
            elif kind == "byte":
                value[k] = np.minimum(value[k] + 1, self.length)
            if before is None:
                value[0] = 0
            before = block[-1:].copy()
            block["rank"] = np.arange(done, done + n)
            before["rank"] = pair["rank"][-1]
            rows[done : done + n], shared[done : done + n] = block, value
            done += n
        shared[done] = 0
        return rows, shared

    def _push(self, rows: np.ndarray, keys) -> Queue:
        queue, step = Queue(self.scratch), max(1, self.scratch.rows(TUPLE) // 2)
        for lo in range(0, len(rows), step):
            block = np.array(rows[lo : lo + step])
            block["key"] = keys(block)
            queue.push(block)
        return queue

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(run, lowest level, highest level) of ranges of windows that stand anywhere else; a run's ranges don't meet."""
        text = self.text.array()
        rows, shared = self._order(self.queue, None, "size")
        for self.word in range(-(-self.most // WORD) - 1, -1, -1):
            rows, shared = self._order(self._push(rows, lambda b: self._words(text, b, self.word)), Ranges(shared, self.scratch), "word")
        rows, shared = self._order(self._push(rows, lambda b: b["group"]), Ranges(shared, self.scratch), "core")
        level, step = 0, max(1, self.scratch.rows(TUPLE) // 2)
        while len(rows):
            queue = Queue(self.scratch)
            for lo in range(0, len(rows), step):
                block = np.array(rows[lo : lo + step])
                n = len(block)
                near = np.maximum(shared[lo : lo + n], shared[lo + 1 : lo + n + 1])
                stays = (block["left"] > level) & (near + (block["left"] - level) >= self.length)
                hit = ~block["many"] & (block["first"] <= level) & (near >= self.length)
                opened = block["open"] >= 0
                ends = opened & ~hit
                yield block["run"][ends], block["open"][ends], np.full(ends.sum(), level - 1)
                block["open"] = np.where(hit, np.where(opened, block["open"], level), -1)
                ends = ~stays & hit
                yield block["run"][ends], block["open"][ends], np.full(ends.sum(), level)
                ends = ~stays & block["many"]
                yield block["run"][ends], block["first"][ends], block["left"][ends]
                block = block[stays]
                block["key"] = block["group"] << np.uint64(8) | text[block["at"] - level - 1].astype(np.uint64)
                queue.push(block)
            rows, shared = self._order(queue, Ranges(shared, self.scratch), "byte")
            level += 1
