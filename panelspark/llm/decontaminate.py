"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet by seeds: runs of `least` tokens. For each pair that shares enough of them for the
wanted coverage, the longest non-overlapping common runs are marked again and again, found by running Karp-Rabin hashes
from long to short, until none of `least` tokens is left. The share of the item's tokens that are marked says whether the
document holds it, in whatever order its passages stand.

The join of seeds is a broadcast one: seeds and items go to every task in blocks of bounded size, one block at a time, and
documents are never shuffled. Runs are taken as equal by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, forget, keep, mix64, seeds64

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin style hashes of all runs of n ids."""
    place = seeds64(n, 21) | np.uint64(1)
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += ids[k : k + m] * place[k]
    return mix64(out)


class Runs:
    """Hashes of any run of ids, and of how many ids from a place on none is marked."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        up, self.down = _powers(len(ids) + 1)
        self.sum = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix64(ids + np.uint64(1)) * up[: len(ids)], out=self.sum[1:])

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.down[start]


def room(free: np.ndarray) -> np.ndarray:
    """How many unmarked tokens follow from each place on."""
    n = len(free)
    ends = np.where(free == 0, np.arange(n), n)
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def _scan(p: Runs, t: Runs, open_p: np.ndarray, open_t: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of at least s equal, unmarked tokens: lengths, places in p, places in t.

    Only pairs of places that the tokens before them set apart are formed, so that a text of one token has few.
    """
    none = np.zeros(0, np.int64)
    room_p, room_t = room(open_p), room(open_t)
    ip, it = np.flatnonzero(room_p >= s), np.flatnonzero(room_t >= s)
    if not len(ip) or not len(it):
        return none, none, none
    hp, ht = p.hashes(ip, s), t.hashes(it, s)
    known, up = np.unique(hp, return_inverse=True)
    ut = np.minimum(np.searchsorted(known, ht), len(known) - 1)
    hit = known[ut] == ht
    it, ut = it[hit], ut[hit]
    if not len(it):
        return none, none, none
    # what stands before: 0 is no token of p, and no place of p has t's mark for a beginning
    before_p = np.where((ip > 0) & (open_p[ip - 1] == 1), p.ids[ip - 1].astype(np.int64), -1)
    before_t = np.where((it > 0) & (open_t[it - 1] == 1), t.ids[it - 1].astype(np.int64), -2)
    values = np.unique(np.concatenate([before_p, before_t]))
    width = len(values)
    key_t = ut * width + np.searchsorted(values, before_t)
    order = np.argsort(key_t, kind="stable")
    key_t = key_t[order]
    key_p = up * width + np.searchsorted(values, before_p)
    edges = [np.searchsorted(key_t, k, side) for k, side in ((up * width, "left"), (key_p, "left"), (key_p, "right"), ((up + 1) * width, "left"))]
    starts, sizes = np.concatenate([edges[0], edges[2]]), np.concatenate([edges[1] - edges[0], edges[3] - edges[2]])
    i = np.repeat(np.concatenate([ip, ip]), sizes)
    at = np.cumsum(sizes) - sizes
    j = it[order[np.arange(len(i)) - np.repeat(at - starts, sizes)]]
    size = np.full(len(i), s, np.int64)
    most = np.minimum(room_p[i], room_t[j])
    for k in reversed(range(int(most.max(initial=0)).bit_length())):
        try_ = np.flatnonzero(size + (1 << k) <= most)
        longer = size[try_] + (1 << k)
        same = try_[p.hashes(i[try_], longer) == t.hashes(j[try_], longer)]
        size[same] += 1 << k
    return size, i, j


def tiled(p: np.ndarray, t: np.ndarray, least: int) -> int:
    """Tokens of p in tiles of at least `least` tokens (all of p if it is shorter) shared with t."""
    least = min(least, len(p))
    if not least or len(t) < least:
        return 0
    rp, rt = Runs(p), Runs(t)
    open_p, open_t = np.ones(len(p), np.int64), np.ones(len(t), np.int64)
    left = len(p)
    s = max(least, min(len(p), 20))
    while left:
        size, i, j = _scan(rp, rt, open_p, open_t, s)
        if len(size) and size.max() > 2 * s:
            s = int(size.max())
            continue
        for x in np.lexsort((j, i, -size)).tolist():
            n, a, b = int(size[x]), int(i[x]), int(j[x])
            # ends tell most marked runs: tiles are laid from long to short, so none lies inside a shorter run
            if open_p[a] and open_p[a + n - 1] and open_t[b] and open_t[b + n - 1] and open_p[a : a + n].all() and open_t[b : b + n].all():
                open_p[a : a + n] = open_t[b : b + n] = 0
                left -= n
                if not left:
                    break
        # a match cut by a longer one's tile is met again in the next scan, as s only falls when nothing is found
        if not len(size):
            if s == least:
                break
            s = max(least, s // 2) if s > 2 * least else least
    return len(p) - left


class Items:
    """Tokens and seeds of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, list[str]]], least: int):
        self.words: dict[str, int] = {}
        self.items = [(i, np.array([self.words.setdefault(w, len(self.words) + 1) for w in t], np.uint64)) for i, t in rows if t]
        self.least = least
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.array([min(least, len(t)) for _, t in self.items], np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            h = [grams(self.items[x][1], n) for x in at.tolist()]
            pairs, often = np.unique(np.stack([np.concatenate(h), np.repeat(at, [len(g) for g in h]).astype(np.uint64)]), axis=1, return_counts=True)
            self.seeds[n] = pairs[0], pairs[1].astype(np.int64), often

    def hits(self, texts: list[str], coverage: float = 0.0) -> list[tuple[int, int, float]]:
        """(row, item, covered share) of every text and item whose shared seeds allow for the coverage."""
        get, ids, lens = self.words.get, [], []
        for text in texts:
            words = tokens(text)
            lens.append(len(words) + 1)
            ids += [get(w, 0) for w in words]
            ids.append(0)
        flat = np.array(ids, np.uint64)
        start = np.cumsum([0, *lens])
        known = flat > 0
        out = []
        for n, (hashes, item, often) in self.seeds.items():
            if len(flat) < n:
                continue
            full = np.flatnonzero(np.convolve(known, np.ones(n, np.int64), "valid") == n)
            if not len(full):
                continue
            place = seeds64(n, 21) | np.uint64(1)
            h = mix64(sum((flat[full + k] * place[k] for k in range(n)), np.zeros(len(full), np.uint64)))
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            # each seed of a text once, however often it stands there
            row_lo = np.unique((np.searchsorted(start, full[hit], "right") - 1) * (len(hashes) + 1) + lo[hit])
            row, lo = row_lo // (len(hashes) + 1), row_lo % (len(hashes) + 1)
            m = np.searchsorted(hashes, hashes[lo], "right") - lo
            seed = np.repeat(lo, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            pair, which = np.unique(np.repeat(row, m) * len(self.items) + item[seed], return_inverse=True)
            places = np.bincount(which, weights=often[seed])
            for key, c in zip(pair.tolist(), places.tolist(), strict=True):
                r, x = divmod(key, len(self.items))
                i, p = self.items[x]
                if c * n >= coverage * len(p):  # tiles lie inside these seeds
                    out.append((r, i, tiled(p, flat[start[r] : start[r + 1] - 1], self.least) / len(p)))
        return sorted(out)


def blocks_of(benchmark: DataFrame, least: int, block_chars: int, item_col: str, item_text: str):
    """The benchmark's items in blocks of about block_chars characters."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    chars = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Items([(r["i"], tokens(r["t"])) for r in block.collect()], least)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5, block_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id and coverage of every document that holds at least `coverage` of an item's tokens.

    Tokens are runs of letters and digits, lower-cased. Null, empty and wordless texts and items match nothing. The
    benchmark is read in blocks of about block_chars characters (and one item), so what a task and the driver hold is
    bounded however long it grows; the documents are scanned once a block. Repeated rows of documents are reported each,
    repeated items once; ids may be null. An empty benchmark or table gives no rows; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, coverage double"
    found = None
    for b, items in enumerate(blocks_of(benchmark, least, block_chars, item_col, item_text)):

        def run(source, items=items):
            for batch in source:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    hits = [h for h in items.hits([t or "" for t in part.column(1).to_pylist()], coverage) if h[2] >= coverage]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([h[0] for h in hits], pa.int32())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())], names=[id_col, "item_id", "coverage"])

        got = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = got if found is None else (keep(found) if b == 1 else found).unionByName(keep(got))  # done with each block before the next
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5, block_chars: int = 16_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no benchmark item, with all their columns; each goes by its own text, whatever its id.

    Each block of the benchmark reads the rows that the one before left; their files go once the next ones stand, so there
    are at most two copies at any time.
    """
    at = docs.columns.index(text_col)
    left, last = docs, None
    for b, items in enumerate(blocks_of(benchmark, least, block_chars, item_col, item_text)):

        def run(source, items=items):
            for batch in source:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    clean = [True] * part.num_rows
                    for h in items.hits([t or "" for t in part.column(at).to_pylist()], coverage):
                        clean[h[0]] = clean[h[0]] and h[2] < coverage
                    yield part.filter(pa.array(clean, pa.bool_()))

        if b:  # one block of items at once in a task
            left = keep(left)
            if last is not None:
                forget(last)
            last = left
        left = left.mapInArrow(run, docs.schema)
    return left
