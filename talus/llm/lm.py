"""Language-model scores: a gated recurrent network with a class-factored output softmax, in numpy.

Counts of all training tokens come first, as (64-bit hash, count) rows: the unigram base needs them, and they pick
the network's words, the most frequent of the corpus, in classes of neighbouring frequency: as many classes as words in
a class, and more of them the more distinct tokens the corpus has (classes_for). Every other token is the
class "rare", inside which a word has its smoothed unigram share, so that the model is a distribution over all words
and one unseen one. Training is truncated backpropagation over windows of WINDOW tokens, the state carried from
window to window, over every training document once: in each of ROUNDS rounds the tasks
start from the mean of the weights of the last round and go through their share of the documents. Scores are
log10 likelihoods of whole documents, with the state carried over all windows.

Only weights and the counts of at most HEAD frequent words reach the driver and go to tasks; the counts of the other
words stay in a table that scores are joined with. Which tasks see which rows decides the means, so that weights, and with them
scores, may differ a little between clusters; the base score doesn't.

Defined cases: null text counts as empty, which has one token, its end; rows with a null doc_id are trained on never
and scored like any other; repeated rows count and are returned as often as they stand; without training documents
every token has probability 1 in the base and in the model; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Frequent words whose counts go to every task (16 bytes each), least number of classes and of words in each, power of the
#: distinct tokens by which it grows, state of the network.
HEAD, CLASSES, GROWTH, STATE = 1 << 19, 45, 0.255, 16
WORDS = CLASSES**2
WINDOW, TRAIN_LANES, SCORE_LANES, ROUNDS, RATE = 16, 512, 1024, 3, 0.08
#: In training the state is carried over so many tokens of a document at most, in scoring to its end.
PIECE = 2048
#: Distinct words that a counting task holds before it passes them on; models, and bytes of them, that one task averages.
HELD, FAN_IN, FAN_BYTES = 1_500_000, 32, 128 << 20
SMOOTH = 0.1
END = C.U64(0xE0F1D2C3B4A59687)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, its end last, and the first of each row (n + 1)."""
    s, e, first = C.words(data, at)
    h = C.span_hashes(C.LOWER[data], s, e)
    out_first = first + np.arange(len(first))
    out = np.full(out_first[-1], END, C.U64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(h)) + row] = h
    return out, out_first


def counts(docs: DataFrame) -> DataFrame:
    """h (token hash), n (occurrences) over all texts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def merge(keys, n):
        key, code = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(code, np.concatenate(n)).astype(np.int64)

    def run(batches):
        keys, n, size = [], [], 0
        for _, data, at in C.parts(batches):
            k, c = np.unique(tokens(data, at)[0], return_counts=True)
            keys.append(k)
            n.append(c)
            size += len(k)
            if size > HELD:
                k, c = merge(keys, n)
                keys, n, size = [k], [c], len(k)
                if size > HELD // 2:
                    yield C.batch(schema, C.i64(k), c)
                    keys, n, size = [], [], 0
        if keys:
            k, c = merge(keys, n)
            yield C.batch(schema, C.i64(k), c)

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head_cutoff(table: DataFrame, size: int = HEAD) -> int:
    """The least count so that no more than size words have it or more; counts are looked at in eighths of a power of 2."""
    steps = C.fetch(table.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")))
    total, cutoff = 0, None
    for k in np.argsort(-steps["step"]):
        total += steps["words"][k]
        if total > size:
            break
        cutoff = int(steps["least"][k])
    return cutoff if cutoff is not None else 1 << 62


def classes_for(distinct: int) -> int:
    """Classes of the network, and words in each: it knows the square of that, at most HEAD words (a model of some 130 MB)."""
    return min(math.isqrt(HEAD), max(CLASSES, math.ceil(distinct**GROWTH)))


class Vocabulary:
    """Head words with counts; the first by count have ids below the network's number of words, every other token has that as id."""

    def __init__(self, h: np.ndarray, n: np.ndarray, total: int, distinct: int):
        order = np.lexsort((h, -n))
        self.index, self.n = C.HashIndex(h[order].view(np.uint64)), n[order]
        self.classes = classes_for(distinct)
        self.words = min(self.classes**2, len(h))
        self.total, self.distinct = total, distinct
        self.base = np.log10(total + SMOOTH * (distinct + 1))
        self.rare = np.log10(total - int(self.n[: self.words].sum()) + SMOOTH * (distinct - self.words + 1))
        self.end = C.i64(np.array([END]))[0]


class Network:
    """The weights, and what they do to lanes of tokens. Ids of classes ** 2 are rare."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3, classes: int = CLASSES):
        rng = np.random.default_rng(seed)
        per = self.classes = classes
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.w = weights or {"x": small(per * classes + 1, 3 * STATE), "u": small(STATE, 3 * STATE), "c": small(STATE, classes + 1), "cb": np.zeros(classes + 1, np.float32), "o": small(classes, STATE, per), "ob": np.zeros((classes, per), np.float32)}

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    @classmethod
    def unpack(cls, flat: np.ndarray, classes: int = CLASSES) -> Network:
        net, at = cls(classes=classes), 0
        for k, old in net.w.items():
            net.w[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32).copy()
            at += old.size
        return net

    def step(self, h: np.ndarray, ids: np.ndarray):
        a, u = self.w["x"][ids], h @ self.w["u"]
        gates = 1 / (1 + np.exp(-(a[:, : 2 * STATE] + u[:, : 2 * STATE])))
        z, r = gates[:, :STATE], gates[:, STATE:]
        n = np.tanh(a[:, 2 * STATE :] + r * u[:, 2 * STATE :])
        return n + z * (h - n), z, r, n, u[:, 2 * STATE :]

    def output(self, h: np.ndarray, ids: np.ndarray, gradient: dict | None = None):
        """Natural log probabilities of ids (rare: of the class alone) after states h; with gradient, also the loss's slope at h."""
        per, classes = self.w["ob"].shape[1], self.classes
        cls, m = np.minimum(ids // per, classes), np.arange(len(ids))
        # states are within 1, so this bounds all logits: none that small needs its row's largest taken off before exp
        calm = max(np.abs(self.w["c"]).sum(0).max() + np.abs(self.w["cb"]).max(), np.abs(self.w["o"]).sum(1).max() + np.abs(self.w["ob"]).max()) < 60
        logit = h @ self.w["c"]
        logit += self.w["cb"]
        if not calm:
            logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        total = p.sum(1, keepdims=True)
        logp = logit[m, cls] - np.log(total[:, 0])
        slope = None
        if gradient is not None:
            p /= total
            p[m, cls] -= 1
            gradient["c"], gradient["cb"] = h.T @ p, p.sum(0)
            gradient["o"], gradient["ob"] = np.zeros_like(self.w["o"]), np.zeros_like(self.w["ob"])
            slope = p @ self.w["c"].T
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(classes + 1))
        for c in range(classes):
            rows = order[edge[c] : edge[c + 1]]
            if not len(rows):
                continue
            hc, inside = h[rows], ids[rows] - c * per
            logit = hc @ self.w["o"][c]
            logit += self.w["ob"][c]
            if not calm:
                logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            total = p.sum(1, keepdims=True)
            k = np.arange(len(rows))
            logp[rows] += logit[k, inside] - np.log(total[:, 0])
            if gradient is not None:
                p /= total
                p[k, inside] -= 1
                gradient["o"][c], gradient["ob"][c] = hc.T @ p, p.sum(0)
                slope[rows] += p @ self.w["o"][c].T
        return logp, slope

    def windows(self, ids: np.ndarray, ends: np.ndarray, lanes: tuple[np.ndarray, np.ndarray], learn: Adagrad | None = None) -> np.ndarray:
        """log probabilities of ids; lanes (starts, lengths, longest first) go on side by side, the state is 0 again after each of ends."""
        start, length = lanes
        out = np.zeros(len(ids), np.float32)
        h = np.zeros((len(start), STATE), np.float32)
        for lo in range(0, int(length[0]) if len(length) else 0, WINDOW):
            live = int(np.searchsorted(-length, -lo, "left"))  # lanes with more than lo tokens
            h = h[:live]
            steps = []
            before, where = [], []
            for t in range(lo, min(lo + WINDOW, int(length[0]))):
                k = int(np.searchsorted(-length, -t, "left"))
                at = start[:k] + t
                h_in = h[:k]
                before.append(h_in)
                where.append(at)
                new, z, r, n, un = self.step(h_in, ids[at])
                on = ~ends[at]
                new *= on[:, None]
                if learn:
                    steps.append((h_in, ids[at], on, z, r, n, un))
                h = np.concatenate([new, h[k:]]) if k < len(h) else new
            gradient: dict | None = {} if learn else None
            where_all = np.concatenate(where)
            out[where_all], slope = self.output(np.concatenate(before), ids[where_all], gradient)
            if learn:
                self._back(steps, slope, gradient)
                learn.update(self.w, gradient, len(where_all))
        return out

    def _back(self, steps, slope, gradient):
        """Through time, inside the window."""
        edge = np.r_[0, np.cumsum([len(s[0]) for s in steps])]
        gu = np.zeros_like(self.w["u"])
        da_all, id_all = [], []
        dh = np.zeros((0, STATE), np.float32)  # slope at the state after the step
        for t in range(len(steps) - 1, -1, -1):
            h, ids, on, z, r, n, un = steps[t]
            if len(dh) < len(h):
                dh = np.concatenate([dh, np.zeros((len(h) - len(dh), STATE), np.float32)])
            dh = dh * on[:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            gu += h.T @ du
            da_all.append(np.concatenate([dz, dr, dn], 1))
            id_all.append(ids)
            dh = dh * z + du @ self.w["u"].T + slope[edge[t] : edge[t + 1]]
        ids, da = np.concatenate(id_all), np.concatenate(da_all)
        order = np.argsort(ids, kind="stable")
        ids, first = np.unique(ids[order], return_index=True)
        gradient["u"] = gu
        gradient["x"] = (ids, np.add.reduceat(da[order], first, axis=0))


class Adagrad:
    def __init__(self, rate: float = RATE):
        self.rate, self.seen = rate, None

    def update(self, weights, gradient, count):
        if self.seen is None:
            self.seen = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        for k, g in gradient.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * np.float32(WINDOW * 8 / count)
            self.seen[k][at] += g * g
            weights[k][at] -= self.rate * g / np.sqrt(self.seen[k][at])


def lanes(first: np.ndarray, many: int):
    """Whole documents dealt into lanes of about equal length: order of tokens, lane starts and lengths (longest first), order of documents."""
    size = np.diff(first)
    heap = [(0, k) for k in range(min(many, max(1, len(size))))]
    own: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-size, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (load + int(size[d]), k))
    own.sort(key=lambda x: -int(size[x].sum()))
    length = np.array([size[x].sum() for x in own], np.int64)
    docs = np.concatenate([np.array(x, np.int64) for x in own])
    place = np.r_[0, np.cumsum(size[docs])]
    order = np.repeat(first[docs] - place[:-1], size[docs]) + np.arange(place[-1])
    return order, (np.r_[0, np.cumsum(length)[:-1]], length), docs, place


def _batch_tokens(batch):
    hashes, firsts = [], [np.zeros(1, np.int64)]
    for _, data, at in C.parts([batch]):
        h, first = tokens(data, at)
        hashes.append(h)
        firsts.append(first[1:] + firsts[-1][-1])
    return np.concatenate(hashes) if hashes else np.zeros(0, C.U64), np.concatenate(firsts)


def _network_ids(voc: Vocabulary, place: np.ndarray) -> np.ndarray:
    return np.where((place < 0) | (place >= voc.words), voc.classes**2, place).astype(np.int64)


def train(docs: DataFrame, voc, rounds: int = ROUNDS) -> np.ndarray | None:
    """Weights from texts, by rounds of truncated backpropagation and means; voc is a broadcast Vocabulary."""
    weights = None
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        begin = weights

        def run(batches, begin=begin, r=r):
            net = Network.unpack(begin, voc.value.classes) if begin is not None else Network(classes=voc.value.classes)
            learn, seen = Adagrad(RATE / (1 + r)), 0
            for b in batches:
                h, first = _batch_tokens(b)
                if len(h):
                    many = -(-np.diff(first) // PIECE)
                    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    pieces = np.r_[np.repeat(first[:-1], many) + PIECE * inside, first[-1]]
                    stop = np.zeros(len(h), bool)
                    stop[pieces[1:] - 1] = True
                    order, streams, _, _ = lanes(pieces, TRAIN_LANES)
                    net.windows(_network_ids(voc.value, voc.value.index.find(h))[order], stop[order], streams, learn)
                    seen += len(h)
            if seen:
                yield pa.RecordBatch.from_pydict({"seen": pa.array([float(seen)]), "w": pa.array([(net.pack() * np.float64(1)).astype(np.float32).tobytes()], pa.binary())})

        models = part.mapInArrow(run, "seen double, w binary")
        models = C.cut(models.select("seen", "w", F.monotonically_increasing_id().alias("id")))
        n = models.count()
        many = max(2, min(FAN_IN, FAN_BYTES // (4 * (3 * STATE + STATE + 1) * voc.value.classes**2)))
        while n > many:
            groups = -(-n // many)
            models = C.cut(models.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("part")).applyInArrow(_mean, "seen double, w binary, id long"))
            n = models.count()
        if n:
            weights = np.frombuffer(_mean(models.toArrow()).column("w")[0].as_py(), np.float32)
    return weights


def _mean(rows: pa.Table) -> pa.Table:
    """One row: the mean of the models, by tokens seen."""
    seen = rows.column("seen").to_numpy()
    total = sum(s * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for s, w in zip(seen, rows.column("w"), strict=True)) / seen.sum()
    return pa.table({"seen": pa.array([float(seen.sum())]), "w": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "id": pa.array([int(rows.column("id")[0].as_py())], pa.int64())})


def score(docs: DataFrame, mod: int = 10, rest: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learns from the rows that aren't held out."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = source.where(~C.held_out("doc_id", mod, rest))
    table = C.cut(counts(learn))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cutoff = head_cutoff(table)
    head = C.fetch(table.where(F.col("n") >= cutoff))
    voc = spark.sparkContext.broadcast(Vocabulary(head["h"], head["n"], total, distinct))
    weights = train(learn, voc) if total else None
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.int64()))])

    def run(batches):
        v = voc.value
        net = Network.unpack(weights, v.classes) if weights is not None else None
        for b in batches:
            h, first = _batch_tokens(b)
            place = v.index.find(h)
            known = place >= 0
            log_count = np.zeros(len(h))
            log_count[known] = np.log10(v.n[place[known]] + SMOOTH)
            ids = _network_ids(v, place)
            model = np.zeros(len(h))
            if net:
                order, streams, _, _ = lanes(first, SCORE_LANES)
                model[order] = net.windows(ids[order], (h == END)[order], streams) / np.log(10)
            rare = ids == v.classes**2
            model[rare] += log_count[rare] - v.rare
            tail = np.flatnonzero(~known)
            at = np.searchsorted(tail, first).astype(np.int32)
            yield C.batch(schema, b.column("doc_id"), np.diff(first), C.sums(known, first).astype(np.int64), C.sums(log_count - v.base, first), C.sums(model, first), pa.ListArray.from_arrays(pa.array(at), pa.array(C.i64(h[tail]))))

    rows = source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, model double, tail array<long>")
    rows = C.cut(rows.withColumn("row", F.monotonically_increasing_id()))
    # words outside the head: their counts add the same to the base and to the model
    tail = rows.select("row", F.explode("tail").alias("h")).join(table.where(F.col("n") < cutoff), "h", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.count("n").alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    out = rows.drop("tail").join(tail, "row", "left")
    held = F.coalesce(C.held_out("doc_id", mod, rest), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(C.read(spark, sf_dir, "documents"))
