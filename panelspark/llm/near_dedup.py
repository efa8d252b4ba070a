"""MinHash near-dedup with tensored banding, exact verification and connected components.

A document's shingle set gives two small collections of sub-keys, `side` each, a sub-key being `width` minhashes. Every
pair of one sub-key from either collection is a table key, so side^2 tables cost 2 * side * width minhashes instead of
side^2 * 2 * width. Two sets of similarity s share a key with probability (1 - (1 - s^width)^side)^2: at s = 0.8 and the
defaults all but 7 in 100,000 pairs meet, and pairs above meet more surely. Every candidate is confirmed on full sets.

No group of a key is gathered or paired off: a key's documents are linked to one pivot of the group, found by an aggregate
with map-side combining. Where a key still spans several components after that, documents with too many shingles of their
own are set aside, as nothing can be near them, and the others form clusters, by the least document of their keys. In each
cluster the documents outside of the largest component known so far are held against all others in blocks of bounded
size, so that no link among candidates is lost; rows come of links between components alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, mix64, runs, seeds64, slices, word_hashes
from .components import components


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than a shingle's are one shingle, none give none.

    Hashing takes some 50 bytes for each byte of text, so texts are hashed in runs of bounded size.
    """
    return [s for run in runs(texts) for s in _shingle_sets(run, words)]


def _shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    place = seeds64(words, 3) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * place[k]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(rolled[at : at + c - words + 1]))
        elif c:
            out.append(mix64((hashes[at : at + c] * place[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def sub_keys(sets: list[np.ndarray], side: int, width: int) -> np.ndarray:
    """2 * side sub-keys of each set (no set may be empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    n = 2 * side * width
    times, plus = seeds64(n, 5) | np.uint64(1), seeds64(n, 7)
    out = np.zeros((2 * side, len(sets)), np.uint64)
    salt = seeds64(n, 9) | np.uint64(1)
    for f in range(n):
        out[f // width] += np.minimum.reduceat(flat * times[f] + plus[f], starts) * salt[f]
    return mix64(out + seeds64(2 * side, 13)[:, None]).T


def signatures(docs: DataFrame, words: int, side: int, width: int) -> DataFrame:
    def run(source):
        for batch in source:
            for part in slices(batch, 1, size=1_000_000):
                sets = shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2 * side), np.uint64)
                if full:
                    keys[full] = sub_keys([sets[i] for i in full], side, width)
                keys = keys.view(np.int64)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([mix64(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), side).cast(pa.list_(pa.int64())) for x in (keys[:, :side], keys[:, side:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), *lists], names=["doc_id", "n", "s1", "s2", "left", "right"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, left array<long>, right array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and its text, compressed."""

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                codec = pa.Codec("zstd", compression_level=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], names=["doc_id", "size", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, z binary")


def unpacked_sets(size: list[int], z: list[bytes], words: int) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    return shingle_sets([codec.decompress(b, decompressed_size=n, asbytes=True) if n else b"" for n, b in zip(size, z, strict=True)], words)


def near(s: np.ndarray, t: np.ndarray, both, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) and whether 100 * intersection >= percent * union holds on their full sets."""

    def run(source):
        known: dict[int, np.ndarray] = {}
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                if len(known) > 1000:
                    for d in known.keys() - set(a) - set(b):
                        del known[d]
                need = {}
                for ids, size, z in ((a, "na", "za"), (b, "nb", "zb")):
                    for i, d in enumerate(ids):
                        if d not in known and d not in need:
                            need[d] = part.column(size)[i].as_py(), part.column(z)[i].as_py()
                known.update(zip(need, unpacked_sets([x[0] for x in need.values()], [x[1] for x in need.values()], words), strict=True))
                ok = [near(known[x], known[y], len(np.intersect1d(known[x], known[y], assume_unique=True)), percent) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.col("z").alias("za"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("z").alias("zb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "za", "nb", "zb").mapInArrow(run, "a long, b long, ok boolean")


def unique_counts(texts: DataFrame, words: int) -> DataFrame:
    """doc_id and how many of its shingles no other of these documents has."""

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = unpacked_sets(part.column(1).to_pylist(), part.column(2).to_pylist(), words)
                ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)), pa.array(ids)], names=["shingle", "doc_id"])

    each = texts.select("doc_id", "size", "z").mapInArrow(run, "shingle long, doc_id long")
    alone = each.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")).where("c = 1")
    return alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))


def links_in_blocks(placed: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components of each cluster: one at least wherever two components have any.

    placed: doc_id, cluster, c (component). Documents outside of a cluster's largest component are held against all of
    its documents, block by block; no pair becomes a row unless it is a link that joins components.
    """
    by = placed.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("k"))
    top = by.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("m")).select("cluster", F.col("m.c").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("m.k")) / block).cast("int").alias("high")).where("high > 0")
    rows = placed.join(top, "cluster").join(texts, "doc_id")
    h = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    left = rows.where("c <> main").withColumn("i", h("high")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    right = rows.withColumn("j", h("wide")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))
    columns = [F.col(n).alias(n) for n in ("cluster", "i", "j", "doc_id", "c", "size", "z")]  # new names: both sides come of one table
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def against(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows or not rt.num_rows:
            return schema.empty_table()
        ls, rs = (unpacked_sets(t.column("size").to_pylist(), t.column("z").to_pylist(), words) for t in (lt, rt))
        lc, rc = lt.column("c").to_numpy(), rt.column("c").to_numpy()
        li, ri = lt.column("doc_id").to_numpy(), rt.column("doc_id").to_numpy()
        ln, rn = np.array([len(s) for s in ls]), np.array([len(s) for s in rs])
        flat, owner = np.concatenate(rs), np.repeat(np.arange(len(rs)), rn)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        at = 0
        while at < len(ls):
            to = at + 1
            while to < len(ls) and to < at + 64 and ln[at:to].sum() < 50_000:
                to += 1
            mine = np.concatenate(ls[at:to])
            vocabulary = np.intersect1d(mine, flat)
            for b0 in range(0, len(vocabulary), 8192):  # of bounded width, so is the memory
                part = vocabulary[b0 : b0 + 8192]
                x, y = np.zeros((to - at, len(part)), np.float32), np.zeros((len(rs), len(part)), np.float32)
                for m, values, who in ((x, mine, np.repeat(np.arange(to - at), ln[at:to])), (y, flat, owner)):
                    place = np.searchsorted(part, values)
                    hit = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == values)
                    m[who[hit], place[hit]] = 1
                both = x @ y.T if b0 == 0 else both + x @ y.T
            if len(vocabulary):
                union = ln[at:to, None] + rn[None, :] - both
                for i, j in np.argwhere((both > 0) & (100 * both >= percent * union) & (lc[at:to, None] != rc[None, :])).tolist():
                    key = (min(lc[at + i], rc[j]), max(lc[at + i], rc[j]))
                    found.setdefault(key, (li[at + i], ri[j]))
            at = to
        return pa.table([[int(v[0]) for v in found.values()], [int(v[1]) for v in found.values()]], schema=schema)

    return left.select(*columns).groupBy("cluster", "i", "j").cogroup(right.select(*columns).groupBy("cluster", "i", "j")).applyInArrow(against, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, side: int = 10, width: int = 2, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id).

    Words are runs of bytes that aren't ASCII white space, A-Z lower-cased; a set holds the distinct runs of `words` words.
    Null, empty and wordless texts have an empty set, link with nothing and are kept. Rows with a null id come back with a
    null component and kept true. Rows that share an id are one node: any of them makes it a candidate, and links are
    confirmed on the least of their texts. Other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sig = keep(signatures(base, words, side, width))
    # equal sets: one row each goes on
    linked = sig.where("n > 0 AND doc_id IS NOT NULL")
    least = linked.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("left").alias("left"), F.first("right").alias("right"))
    same = linked.join(least.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = least.select(F.col("rep").alias("doc_id"), "n", "left", "right")
    keyed = reps.select("doc_id", F.explode("left").alias("_l"), "right").select("doc_id", "_l", F.explode("right").alias("_r")).select("doc_id", F.xxhash64("_l", "_r").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = keep(keyed.join(shared, "key", "left_semi").select("key", "doc_id"))
    need = members.select("doc_id").distinct()
    # texts of candidates alone, once, compressed
    texts = keep(packed(base.join(need, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))))
    sizes = linked.groupBy("doc_id").agg(F.min("n").alias("n"))

    def by_pivot(rows: DataFrame) -> DataFrame:
        pivot = rows.groupBy("key").agg(F.min("doc_id").alias("p"))
        return rows.join(pivot, "key").where("doc_id <> p").select(F.col("p").alias("a"), F.col("doc_id").alias("b")).distinct()

    small, large = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = by_pivot(members).join(small, "a").join(large, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    links = keep(confirm(pairs, texts, words, percent).where("ok").select("a", "b"))
    # what is known to hang together: a document's least pivot, and that one's
    label = links.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("l"))
    label = label.join(label.select(F.col("doc_id").alias("l"), F.col("l").alias("ll")), "l", "left").select("doc_id", F.coalesce("ll", "l").alias("l"))

    # keys whose documents don't hang together yet: what of them can still be linked?
    placed = members.join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("l", "doc_id").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = keep(placed.join(split, "key", "left_semi"))
    who = open_.select("doc_id").distinct()
    # a document that has more shingles to itself than a link leaves room for has no link
    alone = unique_counts(texts.join(who, "doc_id"), words)
    able = who.join(sizes, "doc_id").join(alone, "doc_id", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * percent).select("doc_id")
    rows = open_.join(able, "doc_id")
    pivots = rows.groupBy("key").agg(F.min("doc_id").alias("cluster"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "cluster")
    rest = keep(rows.join(pivots, "key").select("doc_id", "cluster", "c").distinct())
    more = links_in_blocks(rest, texts, words, percent, block)

    comp = components(keep(links.unionByName(more).unionByName(same)))  # kept: the search reads its edges more than once
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(comp, sig.doc_id == comp.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
