"""Near duplicates, repeats, decontamination, top-k, scores, shards, pipeline: brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import common as C
from talus.llm import components, hamming, jaccard, lm, repeats, sharding, suffixes
from talus.llm import decontaminate as D


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def roots(edges):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = text.encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def links_of(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    found = []
    ids = sorted(i for i, s in sets.items() if s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                found.append((a, b))
    return found


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_is_brute_force(spark, sf, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = texts(spark, sf)
    base = docs[1].split()[:200]
    for k in range(12):  # a group of near copies, some of them equal
        w = list(base)
        w[k * 7] = f"new{k // 2}"
        docs[10_000 + k] = " ".join(w)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    links = links_of(docs)
    degree, root = collections.Counter(x for e in links for x in e), roots(links)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(frame).collect()}
    assert got == {i: (root.get(i, i), degree[i]) for i in docs}
    kept = {r.doc_id for r in jaccard.deduplicate(frame).collect()}
    assert kept == {i for i in docs if root.get(i, i) == i}


def test_no_text_is_lost_where_ids_repeat(spark):
    one, two = (" ".join(f"{w}{k}" for k in range(30)) for w in ("one", "two"))
    rows = [(5, "alpha beta"), (5, one), (3, one), (7, "red"), (7, two), (8, two + " more"), (7, two), (9, two), (9, "red")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in jaccard.deduplicate(frame).collect())
    assert kept == [(3, one), (5, "alpha beta"), (7, "red"), (7, two)]
    got = sorted(tuple(r) for r in jaccard.join(frame).collect())
    assert got == [(3, 3, 1), (5, 3, 1), (5, 5, 0), (7, 7, 1), (7, 7, 3), (7, 7, 3), (8, 7, 3), (9, 7, 1), (9, 7, 3)]


def test_buckets_of_the_same_band_chain_only_verified_links(spark):
    """A chain of texts, each alike to the next only, and texts that share some bands but aren't alike."""
    rng, rows = random.Random(6), []
    words = [f"w{k}" for k in range(400)]
    for k in range(40):
        w = list(words)
        for j in rng.sample(range(400), 14):
            w[j] = f"x{k}{j}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    links = links_of(dict(rows))
    degree, root = collections.Counter(x for e in links for x in e), roots(links)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(frame).collect()} == {i: (root.get(i, i), degree[i]) for i, _ in rows}


def test_bands_reach_the_recall():
    b = jaccard.bands(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_jaccard_odd_rows(odd, none):
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.join(odd).collect()]
    assert len(got) == odd.count() and (2, 2, 0) in got and (None, None, 0) in got
    assert sorted(x for x in got if x[0] in (6, 7)) == [(6, 6, 2), (7, 6, 2), (7, 6, 2)]
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert jaccard.join(none).count() == 0 and jaccard.deduplicate(none).count() == 0


def some_runs(seed, length, core, many, letters, nul):
    """(group, first, left, bytes, stands more than once) of different runs, many of which share windows."""
    rng = np.random.default_rng(seed)
    word = lambda n: bytes((rng.integers(0, letters, n) + (0 if nul else 98)).astype(np.uint8))
    wide, out = length - core, {}
    for _ in range(many):
        left = int(rng.integers(0, wide + 1))
        first = int(rng.integers(0, left + 1))
        group, before, after = int(rng.integers(3)), word(left), word(wide - first)
        if out and rng.random() < 0.6:
            group, _, old, text, _ = list(out.values())[int(rng.integers(len(out)))]
            before, after = (word(wide) + text[:old])[wide + old - left :], (text[old + core :] + word(wide))[: wide - first]
        run = (group, first, left, before + bytes([97 + group]) * core + after)
        out.setdefault(run, (*run, bool(rng.random() < 0.1)))
    return list(out.values())


def sorted_runs(runs, length, core, memory, parts=2):
    s = suffixes.Sorter(length, memory)
    for part in np.array_split(np.arange(len(runs)), min(parts, len(runs))):
        group, first, left, text, many = zip(*(runs[k] for k in part), strict=True)
        s.add(np.array(group, np.uint64), np.array(many), np.full(len(part), core), np.array(first), np.array(left), np.frombuffer(b"".join(text), np.uint8), np.r_[0, np.cumsum([len(t) for t in text])])
    got = [(i, d) for run, lo, hi in s.repeats() for i, a, b in zip(run.tolist(), lo.tolist(), hi.tolist(), strict=True) for d in range(a, b + 1)]
    assert len(got) == len(set(got))
    return set(got), s.scratch.written


def repeated_windows(runs, length):
    seen = collections.Counter()
    for group, first, left, text, many in runs:
        for d in range(first, left + 1):
            seen[group, d, text[left - d : left - d + length]] += 1 + many
    return {(i, d) for i, (group, first, left, text, _) in enumerate(runs) for d in range(first, left + 1) if seen[group, d, text[left - d : left - d + length]] > 1}


@pytest.mark.parametrize("memory", [None, 600])
def test_induced_sort_is_brute_force(memory):
    for seed in range(60):
        length, core = (20, 6) if seed % 3 else (31, 1)
        runs = some_runs(seed, length, core, 80, 2 + seed % 2, seed % 4 == 0)
        assert sorted_runs(runs, length, core, memory)[0] == repeated_windows(runs, length)
    assert sorted_runs(some_runs(1, 20, 6, 1, 2, False), 20, 6, memory)[0] == set()


def test_a_shard_far_larger_than_memory_is_sorted_on_disk():
    runs, memory = some_runs(5, 60, 20, 12_000, 2, False), 1 << 15
    size = sum(len(r[3]) for r in runs)
    assert size > 20 * memory
    want, written = repeated_windows(runs, 60), sorted_runs(runs, 60, 20, 1 << 30)[1]
    assert written == 0
    text, at = np.frombuffer(b"".join(r[3] for r in runs), np.uint8), np.r_[0, np.cumsum([len(r[3]) for r in runs])]
    group, first, left, many = (np.array([r[k] for r in runs], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64), (4, bool)))
    s, got = suffixes.Sorter(60, memory), set()
    tracemalloc.start()
    for lo in range(0, len(runs), 100):
        k = slice(lo, lo + 100)
        s.add(group[k], many[k], np.full(len(group[k]), 20), first[k], left[k], text, at[lo : lo + 101])
    peak = 0
    for run, lo, hi in s.repeats():
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        got |= {(i, d) for i, a, b in zip(run.tolist(), lo.tolist(), hi.tolist(), strict=True) for d in range(a, b + 1)}
        tracemalloc.start()
    tracemalloc.stop()
    assert got == want
    assert s.scratch.written > size and peak < 10 * memory < size / 2


def removed(docs, length):
    seen = collections.Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    for i, t in docs:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mask[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        yield i, len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [8192, 2])
def test_repeats_are_brute_force(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = texts(spark, sf)
    passage = docs[3][:330]
    for k in range(9):
        docs[10_000 + k] = f"opening {k} {passage[k:]} closing {k}"
    docs[10_020] = "loop " * 100
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.spans(frame).collect())
    assert got == sorted(removed([(i, t.encode()) for i, t in docs.items()], 200))


def test_repeats_odd_rows(odd, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    assert sorted(map(str, map(tuple, repeats.spans(odd).collect()))) == sorted(map(str, removed(rows, 200)))
    assert repeats.spans(none).count() == 0


def distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_is_the_table_s():
    rng = random.Random(0)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 20)))
        assert D.edit_distance_within(p, t) == distance_within(p, t)


def test_decontamination_finds_whole_and_edited_items(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = texts(spark, sf)
    exact = {(i, k) for i, t in docs.items() for k, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.similarity for r in D.op1_decontamination(spark, sf).collect()}
    assert exact and all(got.get(x) == 1 for x in exact)
    for pair, likeness in got.items():  # verified, so each is brute-force right
        norm = lambda t: b" ".join(re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))))
        assert likeness >= 0.8 and distance_within(norm(dict(items)[pair[1]]), norm(docs[pair[0]])) <= 0.2 * len(norm(dict(items)[pair[1]]))
    rng, host = random.Random(4), [t for t in docs.values() if len(t) > 1500]
    found = 0
    index = D.Items([k for k, _ in items], [x for _, x in items])
    for n, (k, x) in enumerate(items):
        w = x.split()
        for _ in range(len(w) // 10):
            w[rng.randrange(len(w))] = "changed"
        text = f"{host[n % len(host)][:700]} {' '.join(w)} {host[n % len(host)][700:1400]}"
        from talus.llm import common as C

        found += any(index.ids[i] == k for _, i, *_ in index.search(*C.buffer(pa.array([text]))))
    assert found / len(items) >= 0.95


@pytest.mark.parametrize(("share", "recall"), [(0.3, 0.99), (0.5, 0.99), (1, 0.9)])
def test_decontamination_finds_items_with_a_letter_changed_in_many_words(spark, share, recall):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rng, index = random.Random(8), D.Items([k for k, _ in items], [x for _, x in items])
    host = [t for t in texts(spark, "/root/testdata/sf0.01").values() if len(t) > 1500]
    norm = lambda t: b" ".join(re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode()))
    alike, rows = [], []
    for n, (k, x) in enumerate(items):
        w = x.split()
        for j in rng.sample(range(len(w)), int(share * len(w))):
            at = rng.randrange(len(w[j]))
            w[j] = w[j][:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[j][at + 1 :]
        if D.edit_distance_within(norm(x), norm(" ".join(w))) <= 0.2 * len(norm(x)):
            alike.append(k)
            rows.append(f"{host[n % len(host)][:700]} {' '.join(w)} {host[n % len(host)][700:1400]}")
    got = {(r, index.ids[i]) for r, i, *_ in index.search(*C.buffer(pa.array(rows)))}
    assert len(alike) > 150 and sum((r, k) in got for r, k in enumerate(alike)) / len(alike) >= recall


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_decontamination_recall_over_random_edits(spark, share):
    """Letters changed, left out and put in at random places, up to the fifth that the definition admits."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rng, index = random.Random(11), D.Items([k for k, _ in items], [x for _, x in items])
    host = [t for t in texts(spark, "/root/testdata/sf0.01").values() if len(t) > 1500]
    alike, rows = [], []
    for n, (k, x) in enumerate(items):
        out = list(x)
        for at in rng.sample(range(len(out)), int(share * len(out))):
            out[at] = rng.choice([rng.choice("abcdefghijklmnopqrstuvwxyz"), "", out[at] + rng.choice("abcdefghijklmnopqrstuvwxyz")])
        text = f"{host[n % len(host)][:700]} {''.join(out)} {host[n % len(host)][700:1400]}"
        alike.append(k)
        rows.append(text)
    data = C.buffer(pa.array(rows))
    text, s, e, first, _ = D.tokens(*data)
    plain, word_at = D.plain(text, s, e)
    place = {k: n for n, k in enumerate(index.ids)}
    every = [(r, place[k], int(word_at[first[r]]), int(word_at[first[r + 1]]) - 1, 0) for r, k in enumerate(alike)]
    true = [x for x, d in zip(every, index.distances(plain, every).tolist(), strict=True) if d <= 0.2 * len(index.text[x[1]])]
    got = {(r, i) for r, i, *_ in index.search(*data)}
    assert len(true) >= 150 and sum(x[:2] in got for x in true) / len(true) >= 0.95


def test_decontamination_is_the_exhaustive_search(spark, sf):
    """Every item against the whole of every document."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index, docs = D.Items([k for k, _ in items], [x for _, x in items]), texts(spark, sf)
    text, s, e, first, _ = D.tokens(*C.buffer(pa.array(list(docs.values()))))
    plain, word_at = D.plain(text, s, e)
    every = [(r, i, int(word_at[first[r]]), int(word_at[first[r + 1]]) - 1, 0) for r in range(len(docs)) for i in range(len(index.ids)) if first[r + 1] > first[r]]
    near = {(list(docs)[r], index.ids[i]) for (r, i, *_), d in zip(every, index.distances(plain, every).tolist(), strict=True) if 1 - d / len(index.text[i]) >= 0.8}
    got = {(r.doc_id, r.item_id) for r in D.op1_decontamination(spark, sf).collect()}
    assert near and got == near


def test_decontamination_distances_are_the_single_ones(spark, sf, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = D.Items([k for k, _ in items], [x for _, x in items])
    data, s, e, first, _ = D.tokens(*C.buffer(pa.array(list(texts(spark, sf).values())[:20])))
    text, _ = D.plain(data, s, e)
    rng = random.Random(3)
    parts = [(0, rng.randrange(len(items)), lo, min(len(text), lo + rng.choice([0, 3, 200, 900, 4000])), 0) for lo in (rng.randrange(len(text)) for _ in range(60))]
    want = [D.edit_distance_within(index.text[i], text[lo:hi].tobytes()) for _, i, lo, hi, _ in parts]
    assert index.distances(text, parts).tolist() == want
    monkeypatch.setattr(D, "BLOCKS", 2)
    assert index.distances(text, parts).tolist() == want


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the same text that stands in several rows of this table and is long enough"), (2, None), (3, ""), (4, "?!")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in D.find(odd, items).collect()) == [(0, 1), (6, 1), (7, 1), (7, 1)]
    left = D.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert D.find(none, items).count() == 0 and D.find(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "batch"), [(500_000, 1 << 20), (90, 50)])
def test_topk_is_brute_force(spark, sf, monkeypatch, rows, batch):
    monkeypatch.setattr(hamming, "INDEX_ROWS", rows)
    monkeypatch.setattr(hamming, "BATCH", batch)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(hamming.ORACLE_SQL).fetchall())
    got = sorted((r.query_id, r.neighbor_id, r.distance, r.rank) for r in hamming.op5_exact_topk(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("size", [16, 100])
def test_topk_with_segments_that_hold_nothing(size):
    """Codes whose length is no multiple of 64, with one segment that nearly all codes share; ids and queries apart."""
    rng = np.random.default_rng(size)
    bits = rng.random((700, size)) < np.linspace(0.001, 0.6, size)
    code = np.zeros((700, -(-size // 64)), np.uint64)
    for b in range(size):
        code[:, b // 64] |= bits[:, b].astype(np.uint64) << np.uint64(b % 64)
    ids = np.arange(700)
    asked = code[::20].copy()
    asked[0, -1] ^= np.uint64(1) << np.uint64(63)  # differs from all codes where those agree
    q, i, f = hamming.MultiIndex(ids, code, 10).search(ids[::20], asked)
    far = np.bitwise_count(asked[:, None, :] ^ code[None]).sum(2)
    for n, own in enumerate(ids[::20].tolist()):
        want = sorted((int(d), k) for k, d in enumerate(far[n]) if k != own)[:10]
        assert [(int(d), int(x)) for d, x in zip(f[q == n], i[q == n], strict=True)] == want
    tables = hamming.MultiIndex(ids, code, 10)
    assert tables.parts.shape[1] == -(-size // 16) and len(tables.same) == 4 * code.shape[1]


def test_topk_takes_empty_vectors_and_extra_columns(spark):
    rows = [(20, [], "x"), (1, [1.0, 2.0], "x"), (2, [-1.0], "x"), (40, [1.0, 1.0], None)]
    code = hamming.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string"))
    got = sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in hamming.search(code, code.where("id % 20 = 0"), 2).collect())
    assert got == [(20, 1, 2, 0), (20, 2, 1, 2), (40, 1, 1, 0), (40, 2, 2, 2)]


def test_topk_odd_rows(spark):
    rows = [(20, [1.0, -1.0, 2.0]), (1, [1.0, -1.0, 2.0]), (2, [1.0, -1.0, 2.0]), (3, None), (None, [1.0]), (4, [1.0, None, 1.0]), (5, [1.0]), (5, [1.0]), (40, [-1.0, 1.0, -1.0]), *((k, [1.0, -1.0, 2.0]) for k in range(101, 130) if k != 120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    code = hamming.codes(v)
    got = hamming.search(code, code.where("id % 20 = 0"), 3).collect()
    assert sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in got if r.query_id == 20) == [(20, 1, 1, 0), (20, 2, 2, 0), (20, 3, 101, 0)]
    assert {r.query_id for r in got} == {20, 40}
    assert hamming.search(code.limit(0), code.limit(0)).count() == 0


def test_language_model_base_is_brute_force(spark, sf):
    docs = texts(spark, sf)
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tok = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(low)), None] for i, t in docs.items()}
    train = collections.Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, v = sum(train.values()), len(train)
    got = lm.op3_lm_scoring(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = tok[r.doc_id]
        assert r.n_tokens == len(ws) and r.n_known == sum(w in train for w in ws) and r.train_tokens == total and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    got = lm.op3_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.04


def test_network_knows_more_words_of_larger_corpora():
    assert [lm.classes_for(n) for n in (10, 10**6, 10**8, 10**10, 10**15)] == [45, 45, 110, 355, 724]
    net = lm.Network(classes=50)
    h = np.random.default_rng(0).normal(size=(1, lm.STATE)).astype(np.float32)
    logp, _ = net.output(np.repeat(h, 2501, 0), np.arange(2501))
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    again = lm.Network.unpack(net.pack(), 50)
    assert all((again.w[k] == v).all() for k, v in net.w.items())


@pytest.mark.parametrize("scale", [1, 40])
def test_network_is_a_plain_gated_one(scale):
    """Word by word, with lists and one softmax over classes and one inside; the state goes on to the end of a document."""
    net = lm.Network(classes=4)
    net.w = {k: v.astype(np.float64) * (3 if k in "xu" else scale) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    sizes = [70, 1, 33, 5]
    first = np.r_[0, np.cumsum(sizes)]
    ids, ends = rng.integers(0, 17, first[-1]), np.zeros(first[-1], bool)
    ends[first[1:] - 1] = True
    order, streams, _, _ = lm.lanes(first, 3)
    got = np.empty(len(ids))
    got[order] = net.windows(ids[order], ends[order], streams)
    sigmoid, s = lambda v: 1 / (1 + np.exp(-v)), lm.STATE
    share = lambda logits, k: logits[k] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    for a, b in zip(first[:-1], first[1:], strict=True):
        h = np.zeros(s)
        for t in range(a, b):
            i = int(ids[t])
            want = share(h @ net.w["c"] + net.w["cb"], min(i // 4, 4))
            if i < 16:
                want += share(h @ net.w["o"][i // 4] + net.w["ob"][i // 4], i % 4)
            assert got[t] == pytest.approx(want, rel=1e-4, abs=1e-4)
            x, u = net.w["x"][i], h @ net.w["u"]
            z, r = sigmoid(x[:s] + u[:s]), sigmoid(x[s : 2 * s] + u[s : 2 * s])
            h = (1 - z) * np.tanh(x[2 * s :] + r * u[2 * s :]) + z * h


def test_network_is_a_distribution_and_learns():
    net = lm.Network()
    h = np.random.default_rng(0).normal(size=(1, lm.STATE)).astype(np.float32)
    logp, _ = net.output(np.repeat(h, lm.WORDS + 1, 0), np.arange(lm.WORDS + 1))
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    ids = np.tile(np.array([3, 50, 700, lm.WORDS, 9]), 400)
    ends = np.zeros(2000, bool)
    ends[499::500] = True
    order, streams, _, _ = lm.lanes(np.arange(0, 2001, 500), 4)
    first = net.windows(ids[order], ends[order], streams).mean()
    learn = lm.Adagrad()
    for _ in range(15):
        net.windows(ids[order], ends[order], streams, learn)
    assert net.windows(ids[order], ends[order], streams).mean() > first + 3
    again = lm.Network.unpack(net.pack())
    assert np.allclose(again.windows(ids[order], ends[order], streams), net.windows(ids[order], ends[order], streams))


def test_network_gradient(monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 64)
    net = lm.Network()
    net.w = {k: v.astype(np.float64) * 3 for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, lm.WORDS + 1, 60), np.zeros(60, bool)
    ends[[7, 19, 33, 59]] = True
    order, streams, _, _ = lm.lanes(np.array([0, 8, 20, 34, 60]), 3)

    class Grab:
        def update(self, weights, gradient, count):
            self.g = gradient

    grab = Grab()
    net.windows(ids[order], ends[order], streams, grab)
    for k in net.w:
        g = grab.g[k]
        full = np.zeros_like(net.w[k])
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full = g
        i = np.unravel_index(np.abs(full).argmax(), full.shape)
        old, loss = net.w[k][i], []
        for e in (0.01, -0.01):
            net.w[k][i] = old + e
            loss.append(-net.windows(ids[order], ends[order], streams).sum(dtype=float))
        net.w[k][i] = old
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(full[i], rel=0.02)


def test_models_of_many_tasks_are_averaged_in_turns(spark, sf, monkeypatch):
    """More models than one mean takes: means of means, by tokens seen, are the mean of all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(9, "doc_id").cache()
    table = C.fetch(lm.counts(docs))
    voc = spark.sparkContext.broadcast(lm.Vocabulary(table["h"], table["n"], int(table["n"].sum()), len(table["h"])))
    flat = lm.train(docs, voc, 1)
    for many in (2, 4):
        monkeypatch.setattr(lm, "FAN_IN", many)
        assert np.allclose(lm.train(docs, voc, 1), flat, rtol=1e-4, atol=1e-6)
    got = lm.score(docs)
    assert got.count() == docs.count() and got.where("score < 0").count() == docs.count()
    docs.unpersist()


def test_language_model_odd_rows(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4)) and all(np.isfinite(r.score) for r in got)
    assert lm.score(none).count() == 0
    alone = lm.score(odd.where("doc_id is null")).first()
    assert alone.base_score == 0 and alone.score == 0 and alone.train_tokens == 0


def check_shards(got, docs, shards):
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values()) and all(0 <= s < shards for s in by)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    return {s: sum(r.size for r in rows) for s, rows in by.items()}


def test_shards_are_even_and_keep_copies(spark, sf):
    rng = random.Random(1)
    docs = [(k, "w" * rng.randrange(50, 150) + str(k // 2)) for k in range(4000)]
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 9}") for i, t in docs], "doc_id long, text string, lang string, source string")
    got = sharding.assign(frame).collect()
    size = check_shards(got, docs, 16)
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    where = {r.doc_id: r.shard for r in got}
    text = dict(docs)
    assert all(where[k] == where[k + 1] for k in range(0, 4000, 2) if text[k] == text[k + 1])
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(frame.repartition(3)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_shards_split_a_text_that_fills_them(spark):
    docs = [(k, "hot text") for k in range(3000)] + [(3000 + k, f"cold {k}") for k in range(3000)]
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=5).collect()
    size = check_shards(got, docs, 5)
    assert max(size.values()) < 1.1 * sum(size.values()) / 5


def test_tree_is_a_plain_one(spark, sf, monkeypatch):
    """The same points split by sorting them, node by node."""
    monkeypatch.setattr(sharding, "CUT_SHARE", 0)
    seen = []
    monkeypatch.setattr(sharding, "grow", lambda points, *a, grow=sharding.grow: seen.append((points, a)) or grow(points, *a))
    got = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), 7)
    points, (shards, _, n_dims) = seen[0]
    points = points.collect()
    want, shard = {}, 0

    def split(rows, many):
        nonlocal shard
        if many == 1:
            want.update({(r.same, r.sub): shard for r in rows})
            shard += 1
            return
        d = max(range(n_dims), key=lambda k: (max(r[f"k{k}"] for r in rows) - min(r[f"k{k}"] for r in rows), -k))
        goal, total = sum(r.w for r in rows) * (many // 2) / many, 0
        for r in sorted(rows, key=lambda r: r[f"k{d}"]):
            if total + r.w >= goal:
                cut = r[f"k{d}"] + (total + r.w - goal < goal - total)
                break
            total += r.w
        split([r for r in rows if r[f"k{d}"] < cut], many // 2)
        split([r for r in rows if r[f"k{d}"] >= cut], many - many // 2)

    split(points, shards)
    weight = collections.Counter()
    for r in points:
        weight[want[r.same, r.sub]] += r.w
    assert {r.shard: r.w for r in got.groupBy("shard").agg(F.sum("size").alias("w")).collect()} == dict(weight)


def test_shards_follow_from_the_bytes_they_are_to_hold(spark):
    docs = [(k, f"{k:05d}" * 20, float("nan") if k % 3 else float("inf")) for k in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, weight double")
    got = sharding.assign(frame, dimensions=("weight",), target_bytes=20_000).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    assert len(got) == 16 and sum(r.w for r in got) == 303_000 and max(r.w for r in got) <= 22_000


def test_shards_odd_rows(odd, none):
    got = sharding.assign(odd).collect()
    assert len(got) == odd.count() and {(r.size, r.text_crc32) for r in got if r.doc_id in (2, 3)} == {(1, 0)}
    assert sharding.assign(none).count() == 0


def test_pipeline_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
    by_hand = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    whole = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == by_hand
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not any(x in t for t in kept.values() for x in items) and not links_of(kept)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0")
    assert labels.where(F.col("doc_id").isin(list(kept))).count() <= 0.3 * labels.count()  # nine of them to learn from


def test_pipeline_odd_rows(spark, odd, none, sf):
    names = odd.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        assert got.count() <= odd.count() and (name == "sentencepiece" or got.columns == names)
        empty = stage(spark, none, sf)
        assert empty.count() == 0 and (name == "sentencepiece" or empty.columns == names)
    # of the copies that repeat an id one row stays, of the row without an id nothing is lost to it
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, sf)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10] and kept.where("doc_id is null").count() == 1
