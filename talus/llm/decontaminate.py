"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are compared as lower-case words (marks and white space aside). The CGK walk over a word sequence stands at
word p in step j and goes on to p + 1 where a random bit of (step, word) says so; the symbols it stands at are the
embedding, and sequences at a small edit distance get embeddings at a small Hamming distance. Items are put into
classes of similar word counts; for each class, WALKS independent walks are sampled SAMPLES times at BITS
coordinates, and a window that agrees with an item on one sample is a candidate. Windows start at every word; those
that can't be within EDITS of any item in words are left out of the walks first: each edit of a word destroys two word
pairs at most, so a window keeps all but two pairs an edit. That count is lossless for edited words only.

SIMILARITY counts characters, and a letter changed in each of many words leaves few words and pairs whole. So a second
source of candidates is blind to words: every GRAM bytes of the text are looked up among those of the items, and a part
of the text with HITS of them (one for HIT_BYTES bytes of a longer item), each about where the item has it, is a
candidate too. A candidate of either source is verified by the least edit distance between the item and any part of the
text around it, in characters, by Myers' bit vectors: it counts with SIMILARITY or more.

Recall: a window with at most EDITS of its words edited agrees in each coordinate at least every second time on
average, so all samples miss with probability (1 - 0.5 ** BITS) ** (WALKS * SAMPLES) = 2.7e-6 were they
independent. No bound holds for the seeds: edits less than GRAM bytes apart all over an item leave none. The tests
measure both on edited passages.

Defined cases: null and empty texts and items without a word match nothing; rows with a null doc_id are searched like
any other; repeated rows and repeated items give a row each; a document shorter than an item can still match it within
EDITS; extra columns are ignored by find() and kept by clean().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIMILARITY, EDITS = 0.8, 0.25
WALKS, SAMPLES, BITS = 6, 16, 3
#: Ratio of word counts in a class, and bytes of items that tasks get at a time (more items mean more passes).
CLASS_RATIO, PASS_BYTES = 1.25, 32 << 20
#: Bytes of a seed, hits that make a candidate (at least, and one for so many bytes of the item), and width in bytes of
#: a band of starts (indels move the later hits).
GRAM, HITS, HIT_BYTES, BAND = 8, 6, 28, 32
#: Bits of the table that seeds are looked up in first, and words of 64 bits in an item that is verified with others.
SEEN_BITS, BLOCKS = 20, 16
#: Candidates that are verified at once, and bytes of text whose candidates are collected for that.
VERIFY_ROWS, COLLECT_BYTES = 2048, 16 << 20
_PAIR, _PAD = C.U64(0x9E3779B97F4A7C15), C.U64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, at: np.ndarray):
    """Lower-case bytes, word starts, ends, first word of each row, hashes."""
    data = C.LOWER[data]
    s, e, first = C.spans(C.WORDY[data], at)
    return data, s, e, first, C.span_hashes(data, s, e)


def _pairs(h: np.ndarray) -> np.ndarray:
    return C.mix(h[:-1] * _PAIR + h[1:])


def edit_distance_within(pattern: bytes, text: bytes, table: dict[int, int] | None = None) -> int:
    """Least edit distance between pattern and any part of text (Myers' bit vectors)."""
    m = len(pattern)
    table = table if table is not None else match_table(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        eq = table.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & mask, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | ~((diagonal | minus) | up) & mask, up & (diagonal | minus)
    return best


def match_table(pattern: bytes) -> dict[int, int]:
    table: dict[int, int] = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    return table


class Items:
    """The LSH tables of a set of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, s, e, first, h = tokens(*C.buffer(pa.array(texts, pa.string())))
        size = np.diff(first)
        some = np.flatnonzero(size)
        self.ids = [ids[i] for i in some]
        self.size, start = size[some], first[:-1][some]
        self.text = [b" ".join(data[s[k] : e[k]].tobytes() for k in range(a, a + n)) for a, n in zip(start, self.size, strict=True)]
        self.words = [h[a : a + n].tolist() for a, n in zip(start, self.size, strict=True)]
        self.table = [match_table(t) for t in self.text]
        inner = np.ones(max(0, len(h) - 1), bool)
        inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))] - 1] = False
        self.pairs = C.HashIndex(np.unique(_pairs(h)[inner]))
        self._seeds()
        self.classes = []
        lo = 1
        while len(self.size) and lo <= self.size.max():
            hi = max(lo, int(lo * CLASS_RATIO))
            members = np.flatnonzero((self.size >= lo) & (self.size <= hi))
            if len(members):
                self.classes.append(self._class(lo, hi, members, start, h))
            lo = hi + 1

    def _class(self, lo, hi, members, start, h):
        steps = max(1, int(1.6 * lo))
        rng = np.random.default_rng(lo)
        places = rng.integers(0, steps, (WALKS, SAMPLES, BITS))
        keys = sample_keys(h, start[members], start[members] + self.size[members], places, lo)
        flat = keys.T.ravel()
        order = np.argsort(flat, kind="stable")
        unique, at = np.unique(flat[order], return_index=True)
        return {"lo": lo, "need": max(0, lo - 1 - 2 * math.floor(EDITS * hi)), "places": places, "index": C.HashIndex(unique), "at": np.r_[at, len(flat)], "item": np.repeat(members, len(keys))[order]}

    def _seeds(self):
        """The items' character n-grams with their places, and the edits that SIMILARITY allows each item."""
        length = np.array([len(t) for t in self.text], np.int64)
        self.edits = [int((1 - SIMILARITY) * n + 1e-9) for n in length]
        self.hits = np.maximum(HITS, length // HIT_BYTES)
        raw = np.frombuffer(b"".join(self.text), np.uint8)
        begin = np.r_[0, np.cumsum(length)].astype(np.int64)
        item = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(raw)) - begin[item]
        inside = np.flatnonzero(place + GRAM <= length[item])
        code = grams(raw, GRAM)[inside]
        order = np.argsort(code, kind="stable")
        unique, at = np.unique(code[order], return_index=True)
        self.seeds, self.seed_at = C.HashIndex(unique), np.r_[at, len(code)]
        self.seed_item, self.seed_place = item[inside][order], place[inside][order]
        self.seed_slots = np.zeros(1 << SEEN_BITS, bool)
        self.seed_slots[_slot(unique, SEEN_BITS)] = True

    def near(self, text: np.ndarray, row_at: np.ndarray):
        """(row, item, lo, hi, start) of parts of a plain() text with enough n-grams of an item, each about where the item has it."""
        none = [np.zeros(0, np.int64)] * 5
        code = grams(text, GRAM)
        at = np.flatnonzero(self.seed_slots[_slot(code, SEEN_BITS)])
        got = self.seeds.find(code[at])
        at, got = at[got >= 0], got[got >= 0]
        kept = []
        for a in range(0, len(at), 1 << 18):
            p, g = at[a : a + (1 << 18)], got[a : a + (1 << 18)]
            many = self.seed_at[g + 1] - self.seed_at[g]
            k = np.repeat(self.seed_at[g] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            p = np.repeat(p, many)
            kept.append((p, self.seed_item[k], p - self.seed_place[k] + (1 << 20)))
        if not kept:
            return none
        p, item, start = (np.concatenate(x) for x in zip(*kept, strict=True))
        # counters of (item, band of starts); two that share a slot only add up, so that none is lost
        band, bits = start // BAND, min(22, max(12, int(2 * len(start)).bit_length()))
        slot = _slot((item.astype(C.U64) << C.U64(40)) + (band >> 1).astype(C.U64), bits)
        other = _slot((item.astype(C.U64) << C.U64(40)) + ((band + 1) >> 1).astype(C.U64) + C.U64(1 << 39), bits)
        left, right = np.bincount(slot, minlength=1 << bits), np.bincount(other, minlength=1 << bits)
        enough = np.flatnonzero(np.maximum(left[slot], right[other]) >= self.hits[item])
        p, item, start = p[enough], item[enough], start[enough] - (1 << 20)
        row = np.searchsorted(row_at, p, "right") - 1
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        # runs of starts at most BAND apart; one that has enough of them inside two bands
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > BAND)
        run = np.cumsum(new) - 1
        far = np.arange(len(row)) + self.hits[item] - 1
        inside = far < len(row)
        far = np.minimum(far, len(row) - 1)
        dense = inside & (run[far] == run) & (start[far] - start < 2 * BAND)
        if not dense.any():
            return none
        run, row, item, first, last = (x[dense] for x in (run, row, item, start, start[far]))
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        row, item = row[begin], item[begin]
        first, last, middle = first[begin], np.maximum.reduceat(last, begin), start[dense][(begin + np.r_[begin[1:], len(run)] - 1) // 2]
        length = np.array([len(t) for t in self.text], np.int64)[item]
        edits = np.array(self.edits, np.int64)[item]
        return row, item, np.maximum(row_at[row], first - edits), np.minimum(row_at[row + 1], last + length + edits), middle

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """(start word, item) that agree on a sample; windows stay inside rows."""
        row_end = np.repeat(first[1:], np.diff(first))
        known = np.zeros(len(h) + 1, np.int32)
        if len(h) > 1:
            np.cumsum(self.pairs.find(_pairs(h)) >= 0, out=known[1:-1])
            known[-1] = known[-2]
        found = []
        for c in self.classes:
            lo = c["lo"]
            n = np.arange(len(h))
            last = np.minimum(n + lo, row_end)  # a window has its pairs up to last - 1
            enough = (last - n >= math.floor((1 - EDITS) * lo)) & (known[np.maximum(last - 1, n)] - known[n] >= c["need"])
            start = np.flatnonzero(enough)
            for a in range(0, len(start), 1 << 17):
                part = start[a : a + (1 << 17)]
                got = c["index"].find(sample_keys(h, part, row_end[part], c["places"], lo).ravel())
                hit = np.flatnonzero(got >= 0)
                where, got = part[hit % len(part)], got[hit]
                many = c["at"][got + 1] - c["at"][got]
                item = c["item"][np.repeat(c["at"][got] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
                found.append(np.unique(np.repeat(where, many).astype(np.int64) << 32 | item))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both >> 32, both & 0xFFFFFFFF

    def search(self, data: np.ndarray, at: np.ndarray):
        """Verified (row, item, similarity, first word of the window in its row)."""
        return self.search_all([(data, at)])[0]

    def search_all(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        """search() of each part; the candidates of all of them are verified together."""
        texts, found, begin = [], [], 0
        for n, (data, at) in enumerate(parts):
            text, rows = self.parts_of(data, at)
            texts.append(text)
            found += [(n, r, i, begin + lo, begin + hi, start) for r, i, lo, hi, start in rows]
            begin += len(text)
        out: list[dict[tuple[int, int], tuple[float, int]]] = [{} for _ in parts]
        text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        for (n, r, i, _, _, start), distance in zip(found, self.distances(text, [x[1:] for x in found]).tolist(), strict=True):
            likeness = 1 - distance / len(self.text[i])
            if likeness >= SIMILARITY and likeness > out[n].get((r, i), (0, 0))[0]:
                out[n][r, i] = (likeness, start)
        return [[(r, i, *v) for (r, i), v in sorted(x.items())] for x in out]

    def parts_of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The plain text, and the candidates of both sources as (row, item, lo, hi, first word of the window)."""
        data, s, e, first, h = tokens(data, at)
        found: list[tuple] = []
        if not len(h) or not self.ids:
            return np.zeros(0, np.uint8), found
        text, word_at = plain(data, s, e)
        row_at = word_at[first]
        where, item = self.candidates(h, first)
        if len(where):
            row = np.searchsorted(first, where, "right") - 1
            order = np.lexsort((where, item, row))
            where, item, row = where[order], item[order], row[order]
            new = np.ones(len(where), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (where[1:] - where[:-1] > self.size[item[1:]])
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(where)] - 1
            row, item, margin = row[begin], item[begin], np.ceil(EDITS * self.size[item[begin]]).astype(np.int64) + 1
            lo = np.maximum(first[row], where[begin] - margin)
            hi = np.minimum(first[row + 1], where[end] + self.size[item] + margin)
            found = list(zip(row.tolist(), item.tolist(), word_at[lo].tolist(), (word_at[hi] - 1).tolist(), (where[begin] - first[row]).tolist(), strict=True))
        for r, i, lo, hi, start in zip(*(x.tolist() for x in self.near(text, row_at)), strict=True):
            word = int(np.searchsorted(word_at, max(start, lo), "right")) - 1
            found.append((r, i, lo, hi, max(0, word - int(first[r]))))
        return text, found

    def distances(self, text: np.ndarray, found: list[tuple]) -> np.ndarray:
        """edit_distance_within() of each (row, item, lo, hi, start), for many at once: 64 rows of the bit vectors a word."""
        out = np.zeros(len(found), np.int64)
        if not found:
            return out
        _, item, lo, hi, _ = np.array(found, np.int64).T
        blocks = -(-np.array([len(self.text[i]) for i in item]) // 64)
        order = np.lexsort((hi - lo, blocks))
        for k in order[blocks[order] > BLOCKS].tolist():
            out[k] = edit_distance_within(self.text[item[k]], text[lo[k] : hi[k]].tobytes(), self.table[item[k]])
        order = order[blocks[order] <= BLOCKS]
        # a long part of a text becomes pieces that overlap by an item and its edits
        step = np.array([len(t) for t in self.text], np.int64)[item[order]]
        over = step + np.array(self.edits, np.int64)[item[order]]
        many = np.maximum(1, -(-(hi[order] - lo[order] - over) // step))
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        order, step, over = (np.repeat(x, many) for x in (order, step, over))
        lo, hi = lo[order] + part * step, np.minimum(hi[order], lo[order] + (part + 1) * step + over)
        owner, item, blocks = order, item[order], blocks[order]
        order = np.lexsort((hi - lo, blocks))
        out[owner] = np.iinfo(np.int64).max
        # candidates of one number of words and about one length share a batch
        edge = np.flatnonzero(np.diff(blocks[order])) + 1 if len(order) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([np.arange(0, len(order), VERIFY_ROWS), edge]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            k = order[a:b]
            used, at = np.unique(item[k], return_inverse=True)
            wide = int(blocks[k].max())
            match = np.zeros((wide, len(used), 256), C.U64)
            for n, i in enumerate(used.tolist()):
                raw, j = np.frombuffer(self.text[i], np.uint8), np.arange(len(self.text[i]))
                np.bitwise_or.at(match, (j // 64, n, raw), C.U64(1) << (j % 64).astype(C.U64))
            distance = _distances(match, at, np.array([len(self.text[i]) for i in item[k]]), text, lo[k], hi[k])
            np.minimum.at(out, owner[k], distance)
        return out


def _distances(match, at, length, text, lo, hi) -> np.ndarray:
    wide, n = len(match), len(at)
    one, top = C.U64(1), C.U64(63)
    plus, minus = np.full((wide, n), ~C.U64(0)), np.zeros((wide, n), C.U64)
    score, best = length.copy(), length.copy()
    bit, ends = ((length - 1) % 64).astype(C.U64), [np.flatnonzero((length - 1) // 64 == w) for w in range(wide)]
    base, longest = at * 256, int((hi - lo).max(initial=0))
    for t in range(longest):
        if t % 64 == 0:
            # past its end a text goes on with a byte of no item, which never makes a distance less
            place = lo + np.arange(t, min(t + 64, longest))[:, None]
            letters = np.where(place < hi, text[np.minimum(place, len(text) - 1)], 0)
        cell = base + letters[t % 64]
        up_in = down_in = np.zeros(n, C.U64)
        for w in range(wide):
            p, m, eq = plus[w], minus[w], match[w].take(cell)
            v = eq | m
            eq = eq | down_in
            h = (((eq & p) + p) ^ p) | eq
            up, down = m | ~(h | p), p & h
            if len(end := ends[w]):
                score[end] += ((up[end] >> bit[end]) & one).view(np.int64) - ((down[end] >> bit[end]) & one).view(np.int64)
            up_out, down_out = up >> top, down >> top
            up, down = (up << one) | up_in, (down << one) | down_in
            plus[w], minus[w] = down | ~(v | up), up & v
            up_in, down_in = up_out, down_out
        np.minimum(best, score, out=best)
    return best


def plain(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space after each, and where each starts (words + 1)."""
    size = e - s
    word_at = np.r_[0, np.cumsum(size + 1)].astype(np.int64)
    out = np.full(word_at[-1], 32, np.uint8)
    out[np.arange(size.sum()) + np.repeat(np.arange(len(s)), size)] = data[C.WORDY[data]]
    return out, word_at


def grams(text: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on (zeros after the end) as a number, n at most 8."""
    out = np.zeros(len(text), C.U64)
    for k in range(min(n, len(text))):
        out[: len(text) - k] |= text[k:].astype(C.U64) << C.U64(8 * k)
    return out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * C.U64(0x9E3779B97F4A7C15)) >> C.U64(64 - bits)).astype(np.int64)


def sample_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """(walks * samples, windows): a hash of the symbols at each sample's coordinates of each walk's embedding."""
    walks, samples, _ = places.shape
    out = np.zeros((walks, samples, len(start)), C.U64)
    rng = np.random.default_rng((salt, 7))
    for w in range(walks):
        at = start.astype(np.int64)
        uses: dict[int, list[tuple[int, int]]] = {}
        for k in range(samples):
            for b, j in enumerate(places[w, k]):
                uses.setdefault(int(j), []).append((k, b))
        steps = max(uses) + 1
        # the random bit of (step, word): the parity of the bits of the word's hash that the step picks
        masks = rng.integers(0, 1 << 64, steps, dtype=np.uint64)
        for j in range(steps):
            symbol = np.where(at < end, h[np.minimum(at, len(h) - 1)], _PAD)
            for k, b in uses.get(j, ()):
                out[w, k] += symbol * C.U64(2 * b + 3) + C.U64(b)
            at += np.bitwise_count(symbol & masks[j]) & np.uint8(1)
        out[w] = C.mix(out[w] ^ C.mix(np.arange(w * samples, (w + 1) * samples, dtype=np.uint64) + C.U64(salt << 32))[:, None])
    return out.reshape(walks * samples, -1)


def passes(benchmark: DataFrame) -> list[tuple[list[int], list[str]]]:
    """The items, in parts of about PASS_BYTES, each small enough for the driver and every task."""
    known = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // PASS_BYTES))
    out = []
    for k in range(n):
        part = C.fetch(known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k))
        out.append((list(part["item_id"]), list(part["text"])))
    return out


def _searched(items: Items, batches):
    """(rows, what search() finds in them) for slices of the batches."""
    held: list[tuple] = []

    def verified():
        for (rows, _, _), hits in zip(held, items.search_all([x[1:] for x in held]), strict=True):
            yield rows, hits

    for part in C.parts(batches):
        held.append(part)
        if sum(len(x[1]) for x in held) > COLLECT_BYTES:
            yield from verified()
            held = []
    yield from verified()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word of each item that a row holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64())])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ids, texts in passes(benchmark):

        def run(batches, ids=ids, texts=texts):
            items = Items(ids, texts)
            for rows, hits in _searched(items, batches):
                if hits:
                    r, i, likeness, start = zip(*hits, strict=True)
                    yield C.batch(schema, rows.column("doc_id").take(pa.array(r)), [items.ids[k] for k in i], list(likeness), list(start))

        part = source.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that hold an item."""
    for ids, texts in passes(benchmark):

        def run(batches, ids=ids, texts=texts):
            items = Items(ids, texts)
            for rows, hits in _searched(items, batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[r for r, *_ in hits]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
