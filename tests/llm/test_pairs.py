"""Near duplicates, repeated substrings, decontamination, neighbours and components against brute force."""

import hashlib
import itertools
import random
import tracemalloc
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import common, decontaminate, near_dedup, nearest, substring_dedup
from panelspark.llm.common import words_of
from panelspark.llm.components import components
from panelspark.llm.substring_dedup import equal_windows

ODD = [(901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "ONE  two"), (None, "no id at all here"), (906, "x" * 4000), (907, "x" * 4000)]
WORDS = [f"word{i}" for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, n string, chunk string, component string")


def copies(seed, n=40):
    """Documents, near copies of some and large groups of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, base = [], [[word() for _ in range(rng.randint(10, 80))] for _ in range(n)]
    for i in range(n * 4):
        words = list(base[rng.randrange(n) if i % 3 else 0])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


def groups(edges, nodes):
    par = {i: i for i in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            par[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_near_duplicates(spark):
    rows = copies(1) + ODD
    sets = {}
    for d, t in rows:
        if d is not None:
            w = words_of(t)
            sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = near_dedup.near_duplicates(frame(spark, rows), words=4).collect()
    assert len(got) == len(rows) and len(links) > 100
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert r.kept and r.component_id is None
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_shingling_takes_memory_of_bounded_size():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=500)).encode() for _ in range(2000)]
    alone = [near_dedup.shingle_sets([t], 5)[0] for t in texts[::100]]
    common._POW.clear()
    tracemalloc.start()
    sets = near_dedup.shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1] - sum(s.nbytes for s in sets)
    tracemalloc.stop()
    assert peak < 40e6  # all texts at once took ten times that
    assert all((s == t).all() for s, t in zip(sets[::100], alone, strict=True))
    assert [len(r) for r in common.runs([b"x" * 4, b"", b"y" * 9, b"z", b"z"], size=5)] == [2, 1, 2]


def test_tensored_keys_meet_as_often_as_they_should():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = np.unique(pool[:170]), np.unique(pool[10:])  # similarity 160 / 180
        k = near_dedup.sub_keys([a, b], 10, 2)
        same = k[0] == k[1]
        met += same[:10].any() and same[10:].any()
    assert met >= 298


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_by_hand(rows, least):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            if d is not None:
                first[b[s : s + least]] = min(d, first.get(b[s : s + least], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - least + 1):
            if d is not None and first[b[s : s + least]] < d:
                gone[s : s + least] = [True] * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeated_substrings(spark):
    rng = random.Random(6)
    rows = copies(2, 20) + [(d + 5000 if d else d, t) for d, t in ODD] + [(3, "x" * 4000), (3, "x" * 4000), (2000, "é" * 90), (2001, "é" * 60 + "ü" * 20)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(75))
    rows += [(3000 + i, "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 60))) + passage + "".join(rng.choice("qrstu ") for _ in range(40))) for i in range(30)]
    rng.shuffle(rows)
    for options in ({}, {"chunk_bytes": 3000, "hot_chunks": 2}):  # one chunk; many, with anchors that count as hot
        got = substring_dedup.drop_repeats(frame(spark, rows), least=50, with_text=True, **options).collect()
        assert sorted(str((*tuple(r)[:5], bytes(r.kept))) for r in got) == sorted(map(str, cut_by_hand(rows, 50)))
    assert substring_dedup.drop_repeats(frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=4, max_size=30), min_size=1, max_size=8), st.integers(2, 4))
def test_expansion_groups_equal_windows(texts, least):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(t) for t in raw])
    segment, offset, group = equal_windows(data, np.cumsum(size) - size, size, least)
    by = defaultdict(set)
    for s, o, g in zip(segment.tolist(), offset.tolist(), group.tolist(), strict=True):
        by[g].add(raw[s][o : o + least])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert len(segment) == sum(len(t) - least + 1 for t in raw)


# --- decontamination


def tiles_by_hand(p, t, least):
    """Greedy string tiling as first published: always the longest common run of unmarked tokens."""
    least, mp, mt = min(least, len(p)), [False] * len(p), [False] * len(t)
    while least:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            break
        mp[i : i + k] = [True] * k
        mt[j : j + k] = [True] * k
    return sum(mp)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25), st.data())
def test_tiling(p, data):
    cut = data.draw(st.integers(0, len(p)))
    t = p[cut:] + data.draw(st.lists(st.integers(61, 90), max_size=4)) + p[:cut]
    a, b = np.array(p, np.uint64), np.array(t, np.uint64)
    got = decontaminate.tiled(a, b, 3)
    want = tiles_by_hand(p, t, 3)
    assert abs(got - want) <= (0 if len(set(p)) == len(p) else len(p))
    if len(set(p)) == len(p):
        assert got == want


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [(i, [word() for _ in range(rng.choice([2, 12, 30]))]) for i in range(20)]
    rows, leaks = [], set()
    for d in range(80):
        words = [word() for _ in range(60)]
        if d % 4 == 0:
            i, w = items[d % 20]
            half = len(w) // 2
            shown = w if d % 8 else w[half:] + [word()] + w[:half]  # in another order
            if len(w) > 2 or d % 8:
                words[20:20] = [x.upper() + "," for x in shown]
                leaks.add((d, i))
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in items], (100, None), (101, ""), (None, "zz yy xx ww vv")], "item_id long, text string")
    docs = frame(spark, rows + ODD)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == leaks
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench, block_chars=200).collect()} == leaks
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.count() == len(rows) + len(ODD) - len({d for d, _ in leaks}) and clean.columns == docs.columns
    assert decontaminate.contaminated_pairs(frame(spark, []), bench).count() == 0 and decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    x[200:330] = x[200]  # one common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0], 1), (None, x[0].tolist(), 1), (2006, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k=20, sample_rows=500, leaves=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit, y = 0, x.astype(float)
    for q in range(0, 900, 20):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 10))) if i != q][:20]
        assert [g[0] for g in got[q]] == list(range(1, 21))
        assert all(abs(g[2] - s[g[1]]) < 1e-9 for g in got[q])
        assert [(-round(g[2], 10), g[1]) for g in got[q]] == sorted((-round(g[2], 10), g[1]) for g in got[q])
        hit += len({g[1] for g in got[q]} & set(order))
    assert hit >= 0.9 * 20 * 45 and len(got) == 45
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4


def test_tiling_of_long_repetitive_texts():
    one = np.ones(200_000, np.uint64)
    assert decontaminate.tiled(one[:3000], one, 4) == 3000
    assert decontaminate.tiled(np.tile(np.arange(1, 4, dtype=np.uint64), 200), np.tile(np.arange(1, 4, dtype=np.uint64), 60_000), 4) == 600
    assert decontaminate.tiled(one[:3000], np.zeros(200_000, np.uint64), 4) == 0


def test_decontamination_in_blocks_and_of_hot_seeds(spark):
    words = "the quick brown fox jumps over a lazy dog near some river bank at noon".split()
    items = [(i, " ".join(words[k % len(words)] for k in range(i, i + 8)) + f" item{i}") for i in range(30)] + [(33, None), (34, ""), (35, "hi"), (35, "hi")]
    docs = [(i, " ".join(words) + f" item{i}") for i in range(40)] + [(100, "a a a a " * 50_000), (101, None), (None, items[0][1]), (102, "say hi there")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contaminated_pairs(df, bench).collect()))
    assert whole == sorted(map(str, decontaminate.contaminated_pairs(df, bench, block_chars=400).collect()))
    assert sum("item_id=35," in r for r in whole) == 1 and not any("doc_id=100," in r for r in whole)
    want = {(d, i) for d, t in docs if d != 100 for i, u in dict(items).items() if u and t and tiles_by_hand(decontaminate.tokens(u), decontaminate.tokens(t), 4) >= 0.5 * len(decontaminate.tokens(u))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(df, bench).collect()} == want
    assert decontaminate.contaminated_pairs(df, bench.limit(0)).count() == 0


def test_blocks_leave_at_most_two_copies(spark, monkeypatch):
    import os

    from panelspark.llm.common import shared_folder

    at = shared_folder(spark).removeprefix("file:")
    folders = lambda: {f for f in os.listdir(at) if f.startswith("rdd-")}
    before, most = folders(), []
    keep = decontaminate.keep

    def spy(df):
        out = keep(df)
        most.append(len(folders() - before))
        return out

    monkeypatch.setattr(decontaminate, "keep", spy)
    df = spark.createDataFrame([(i, f"some words of text number{i} and more") for i in range(60)], "doc_id long, text string")
    bench = df.where("doc_id < 40").selectExpr("doc_id AS item_id", "text")
    left = decontaminate.drop_contaminated(df, bench, block_chars=200)
    want = {d for d in range(60) if not any(tiles_by_hand(decontaminate.tokens(f"some words of text number{i} and more"), decontaminate.tokens(f"some words of text number{d} and more"), 4) >= 3.5 for i in range(40))}
    assert {r.doc_id for r in left.collect()} == want
    assert len(most) > 3 and max(most) == 2 and len(folders() - before) == 1
