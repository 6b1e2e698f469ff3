"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each character the automaton takes one step (goto, else failure links) and the output links list every piece
that ends there, longest first; each relaxes the best score of its end. The segmentation with the largest sum of
piece scores wins; of equal sums the one whose last piece is longest. A character that no piece of its own covers
costs the least score less 10 and becomes byte pieces (or the unknown piece). Many words advance together, one
character at a time, in numpy; no piece has a space after another character, so words are independent, and the
ids of words seen lately are kept in a cache of bounded size.

The model writes a space as U+2581, so that a text's own U+2581 goes into byte pieces and comes back as it was (a model without
byte pieces gives the unknown piece for it, and text_ok is false). A model that has a piece with a space after another
character is refused: its words would not be independent.

Defined cases: null text gives null ids, n_tokens 0 and null decoded text; empty text gives no ids; rows with a
null doc_id and repeated rows are encoded like any other; extra columns are ignored; very long texts and words
are encoded whole.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for the text's own SPACE; no valid text holds a lone surrogate.
OWN = "\ud800"
#: Words that the cache of a worker keeps; it starts again when full.
CACHE_WORDS = 400_000
#: Characters of words that numpy works on at once.
BLOCK = 1 << 20
_RUNS = re.compile(" +[^ ]*")


def load(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, as plain arrays that executors get with the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)], np.int8)
    return automaton([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), kinds, sp.unk_id())


def automaton(pieces: list[str], scores: np.ndarray, kinds: np.ndarray, unk: int) -> dict:
    """Trie edges by (node, character), failure and output links, and the piece that ends at each node."""
    if any(SPACE in x.lstrip(SPACE) for x, kind in zip(pieces, kinds, strict=True) if not kind):
        raise ValueError("a piece has a space after another character")
    edges: dict[tuple[int, int], int] = {}
    depth, piece = [0], [-1]
    for i, text in enumerate(pieces):
        if kinds[i]:
            continue
        node = 0
        for ch in text:
            nxt = edges.get((node, ord(ch)))
            if nxt is None:
                nxt = edges[node, ord(ch)] = len(depth)
                depth.append(depth[node] + 1)
                piece.append(-1)
            node = nxt
        piece[node] = i
    children: dict[int, list[tuple[int, int]]] = {}
    for (node, ch), nxt in edges.items():
        children.setdefault(node, []).append((ch, nxt))
    fail, out = [0] * len(depth), [0] * len(depth)
    queue = deque([0])
    while queue:
        node = queue.popleft()
        for ch, nxt in children.get(node, ()):
            back = fail[node]
            while node and back and (back, ch) not in edges:
                back = fail[back]
            fail[nxt] = edges.get((back, ch), 0) if node else 0
            out[nxt] = fail[nxt] if piece[fail[nxt]] >= 0 else out[fail[nxt]]
            queue.append(nxt)
    normal = scores[kinds == 0]
    byte = np.full(256, unk)
    for i in np.flatnonzero(kinds == 1):
        byte[int(pieces[i][3:5], 16)] = i
    keys = np.array([(node << 21) | ch for node, ch in edges], np.uint64)
    return {"keys": keys, "to": np.array(list(edges.values()), np.int32), "depth": np.array(depth, np.int32), "piece": np.array(piece, np.int32), "fail": np.array(fail, np.int32), "out": np.array(out, np.int32), "score": scores.astype(np.float64), "unk_score": float(normal.min() if len(normal) else 0) - 10, "unk": unk, "byte": byte, "pieces": pieces, "kinds": kinds}


class Codec:
    def __init__(self, model: dict):
        self.m = model
        self.index = C.HashIndex(model["keys"])
        self.wide = np.uint16 if len(model["pieces"]) <= 1 << 16 else np.uint32
        self.cache: dict[str, bytes] = {}
        self.out = [p.replace(SPACE, " ").encode() if k == 0 else bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else " ⁇ ".encode() for p, k in zip(model["pieces"], model["kinds"], strict=True)]
        self.is_piece = model["piece"] >= 0

    def step(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The automaton's next states: goto where there is one, else by failure links."""
        nxt, todo, now = np.zeros(len(state), np.int32), np.arange(len(state)), state
        while len(todo):
            found = self.index.find((now.astype(np.uint64) << np.uint64(21)) | ch[todo])
            hit = found >= 0
            nxt[todo[hit]] = self.m["to"][found[hit]]
            again = ~hit & (now > 0)
            todo, now = todo[again], self.m["fail"][now[again]]
        return nxt

    def viterbi(self, texts: list[str]) -> list[np.ndarray | bytes]:
        """Packed ids of each text; texts are of similar length."""
        m = self.m
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        start = np.r_[0, np.cumsum([len(t) for t in texts])][:-1][order]
        longest = int(size[0]) if len(size) else 0
        n = len(texts)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        last = np.full((longest + 1, n), -1, np.int32)  # piece that ends here on the best path, -1 for an unknown character
        state = np.zeros(n, np.int32)
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        for i in range(1, longest + 1):
            k = active[i - 1]
            state = self.step(state[:k], points[start[:k] + i - 1])
            top, took, single = np.full(k, -np.inf), np.full(k, -1, np.int32), np.zeros(k, bool)
            node = np.where(self.is_piece[state], state, m["out"][state])
            rows = np.flatnonzero(node)
            node = node[rows]
            while len(rows):
                piece, far = m["piece"][node], m["depth"][node]
                value = best[i - far, rows] + m["score"][piece]
                better = value > top[rows]
                top[rows[better]] = value[better]
                took[rows[better]] = piece[better]
                single[rows[far == 1]] = True
                node = m["out"][node]
                rows, node = rows[node > 0], node[node > 0]
            value = np.where(single, -np.inf, best[i - 1, :k] + m["unk_score"])
            took[value > top] = -1
            best[i, :k] = np.maximum(top, value)
            last[i, :k] = took
        # back along the best paths, all texts at once: the r-th piece from the end of each
        length = np.ones(len(m["pieces"]) + 1, np.int64)
        length[m["piece"][self.is_piece]] = m["depth"][self.is_piece]
        at, rows, found, owner, where = size.copy(), np.flatnonzero(size), [], [], []
        while len(rows):
            piece = last[at[rows], rows]
            found.append(piece)
            owner.append(rows)
            at[rows] -= np.where(piece < 0, 1, length[piece])
            where.append(start[rows] + at[rows])
            rows = rows[at[rows] > 0]
        if not found:
            return [b""] * n
        ids, owner, where = (np.concatenate(x) for x in (found, owner, where))
        back = np.lexsort((where, owner))
        ids, owner, where = ids[back], owner[back], where[back]
        if (ids < 0).any():
            many = np.ones(len(ids), np.int64)
            lost = np.flatnonzero(ids < 0)
            raw = [(SPACE if points[w] == ord(OWN) else chr(int(points[w]))).encode("utf-8", "replace") for w in where[lost]]
            many[lost] = [len(x) for x in raw]
            ends = np.cumsum(many)
            ids, owner = np.repeat(ids, many), np.repeat(owner, many)
            for k, x in zip(lost, raw, strict=True):
                ids[ends[k] - many[k] : ends[k]] = m["byte"][list(x)]
        packed = ids.astype(self.wide).tobytes()
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))] * self.wide().itemsize
        out: list = [b""] * n
        for k, place in enumerate(order.tolist()):
            out[place] = packed[ends[k] : ends[k + 1]]
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the cache."""
        todo = sorted((SPACE + w.replace(" ", SPACE) for w in words), key=len)
        lo = 0
        while lo < len(todo):
            hi, longest = lo, len(todo[lo])
            while hi < len(todo) and (hi == lo or len(todo[hi]) * (hi - lo + 1) <= BLOCK and len(todo[hi]) <= 2 * longest + 8):
                hi += 1
            for w, ids in zip(todo[lo:hi], self.viterbi(todo[lo:hi]), strict=True):
                self.cache[w[1:].replace(SPACE, " ")] = ids
            lo = hi

    def split(self, text: str) -> list[str]:
        """Words without the first of the spaces before each; a space is put before the text."""
        text = text.replace(SPACE, OWN)
        return text.split(" ") if "  " not in text and text[:1] != " " else [x[1:] for x in _RUNS.findall(" " + text)]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed little-endian ids of each text."""
        out = []
        for lo in range(0, len(texts), 500):
            some = [None if t is None else self.split(t) if t else [] for t in texts[lo : lo + 500]]
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            need = set().union(*(x for x in some if x)).difference(self.cache)
            if need:
                self.learn(need)
            get = self.cache.__getitem__
            out += [None if x is None else b"".join(map(get, x)) for x in some]
        return out

    def decode(self, packed: list[bytes | None]) -> list[str | None]:
        get = self.out.__getitem__
        return [None if x is None else b"".join(map(get, np.frombuffer(x, self.wide).tolist())).decode("utf-8", "replace")[1:] for x in packed]


_codecs: dict[bytes, Codec] = {}


def codec(model: dict) -> Codec:
    """One codec, with its cache, for each model and worker process."""
    key = model["score"].tobytes() + model["keys"].tobytes()[:64]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str = MODEL, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned integers, 2 bytes each up to 65,536 pieces), text_ok (decoding gives the text)."""
    model = load(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text_ok", pa.bool_())])

    def run(batches):
        c = codec(model)
        width = c.wide().itemsize
        for b in batches:
            _, at = C.buffer(b.column("text"))
            for lo, hi in C.slices(at, 4 << 20):
                rows = b.slice(lo, hi - lo)
                texts = rows.column("text").to_pylist()
                ids = c.encode(texts)
                ok = [x == t for x, t in zip(c.decode(ids), texts, strict=True)] if verify else [None] * len(ids)
                yield C.batch(schema, rows.column("doc_id"), [len(x or b"") // width for x in ids], pa.array(ids, pa.binary()), pa.array(ok, pa.bool_()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text_ok boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    model = load(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.slice(lo, 500)
                yield C.batch(schema, rows.column("doc_id"), pa.array(c.decode(rows.column("ids").to_pylist()), pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(C.read(spark, sf_dir, "documents"))
