"""Exact substring dedup over all documents by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes where a string of `least` bytes covers it that also starts in a document with a smaller id.

Suffixes that share their first `least` bytes have to meet. Each window of `least` bytes has an anchor, the k-gram of least
hash in it, which depends on its bytes alone; consecutive windows with one anchor are a run, whose text is one segment.

1. Equal texts are one text, of the smallest id. Distinct texts are dealt into chunks of some MB, compressed.
2. Each chunk sends the fingerprints of its anchors, once each, to buckets by value, which answer by a bit each: does it
   stand in two texts at least? Most text ends here, for some 3 bytes an anchor, as sorted values are sent as differences.
3. Runs whose anchor is shared go to shards by anchor, each distinct segment of a chunk once: fingerprint, hash and the
   least id, without its text. Where all segments of an anchor are one, all windows in them are equal, and that is the answer.
4. Of an anchor with several segments, one chunk each is asked for the text. A shard builds the transform of these
   segments and widens intervals breadth first, so that common prefixes are found by increasing length, and stops at
   `least`: boundaries not met by then separate nothing. The groups between boundaries are equal windows; the least id of
   each goes back to the chunks. An anchor that very many chunks share would be one shard's group however long: its
   windows are sent one by one, each as a segment to a shard by its own bytes.
5. Chunks mark what is covered and cut it.

Only compact binary rows are shuffled, the texts once; equal windows are one row a chunk, so that no group of copies meets
in one task. Segments are taken as equal by a fingerprint of 40 bits or more with a hash of 48 others, texts by their md5;
both hashes are polynomials modulo 2^64, so texts made to collide (Thue-Morse words of 2,048 bytes and more) can deceive
them. All else is exact; fingerprints that collide cost work only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, mix64, range_hashes, shuffle_parts

PIECE = 1 << 18  # bytes that are hashed at once: what a worker holds is some 20 words of 8 bytes for each
POSITION = np.uint64((1 << 24) - 1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def squeezed(x: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(x, asbytes=True)


def opened_up(x: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(x, decompressed_size=size, asbytes=True) if size else b""


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Integers as their least, and what each is above it in as few bytes as the largest needs."""
    low = int(x.min()) if len(x) else 0
    width = max(1, ((int(x.max()) - low).bit_length() + 7) // 8) if len(x) else 1
    return low.to_bytes(8, "little", signed=True) + bytes([width]) + _low_bytes(x.astype(np.int64) - low, width)


def unpack_ints(raw: bytes) -> np.ndarray:
    return _from_bytes(raw[9:], raw[8]).astype(np.int64) + int.from_bytes(raw[:8], "little", signed=True)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending words as differences of a fixed width, the few larger ones apart."""
    d = np.diff(x, prepend=np.uint64(0))
    width = min(range(1, 9), key=lambda w: len(d) * w + 8 * int((d >= np.uint64(256**w - 1)).sum()))
    far = d >= np.uint64(256**width - 1)
    return len(d).to_bytes(4, "little") + bytes([width]) + _low_bytes(np.where(far, np.uint64(256**width - 1), d), width) + d[far].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    d = _from_bytes(raw[5 : 5 + n * width], width)
    d[d == np.uint64(256**width - 1)] = np.frombuffer(raw[5 + n * width :], np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def part_of(value: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges a value of so many bits lies in."""
    return (((value >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def piecewise_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """range_hashes() for ascending starts, piece by piece."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, lo + PIECE)))
        hi = int(end[at:to].max())
        out[at:to] = range_hashes(data[lo:hi], start[at:to] - lo, end[at:to] - lo)
        at = to
    return out


class Chunk:
    """Texts of a chunk, one after the other, and the anchor runs of their windows."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, least: int, gram: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ids, self.least = ids, least
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        starts, ends, hashes = [], [], []
        mark = np.zeros(len(self.data) + 1, np.int32)  # windows that would leave their text
        np.add.at(mark, np.maximum(self.start, self.end - least + 1), 1)
        np.add.at(mark, self.end, -1)
        valid = np.cumsum(mark[:-1]) == 0
        for a in range(0, len(self.data) - least + 1, PIECE):
            b = min(a + PIECE, len(self.data) - least + 1)
            sub = self.data[a : b + least - 1]
            g = range_hashes(sub, np.arange(len(sub) - gram + 1), np.arange(gram, len(sub) + 1))
            low = sliding_min((g & ~POSITION) | np.arange(len(g), dtype=np.uint64), least - gram + 1)
            at = np.flatnonzero(valid[a:b])
            if not len(at):
                continue
            anchor = (low[at] & POSITION).astype(np.int64)
            new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(anchor, prepend=-1) != 0))
            last = np.append(new[1:], len(at)) - 1
            starts.append(a + at[new]), ends.append(a + at[last] + 1), hashes.append(g[anchor[new]])
        none = np.zeros(0, np.int64)
        self.run_start, self.run_end = (np.concatenate(x) if x else none for x in (starts, ends))
        self.anchor = np.concatenate(hashes) if hashes else none.view(np.uint64)
        self.run_text = np.searchsorted(self.start, self.run_start, "right") - 1
        # of empty texts that start at one place the last is found, which is the one with bytes

    def fingerprints(self, bits: int):
        """Distinct fingerprints of anchors in order, whether two texts here have them, and each run's own."""
        prints = mix64(self.anchor + _ODD) >> np.uint64(64 - bits)  # anchors are least hashes: mixed anew, to be even
        order = np.argsort(prints, kind="stable")
        h, t = prints[order], self.run_text[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(t, first) != np.minimum.reduceat(t, first) if len(first) else np.zeros(0, bool)
        own = np.empty(len(h), np.int64)
        own[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        return h[first], several, own

    def segments(self, prints: np.ndarray, shared: np.ndarray, hot: np.ndarray, own: np.ndarray, bits: int) -> dict:
        """Distinct segments by (fingerprint, hash) and, for each occurrence, its window range and which segment it is."""
        plain = np.flatnonzero(shared[own] & ~hot[own]) if len(own) else np.zeros(0, np.int64)
        very = np.flatnonzero(hot[own]) if len(own) else np.zeros(0, np.int64)
        single = spans(self.run_start[very], self.run_end[very] - self.run_start[very])
        s = np.concatenate([self.run_start[plain], single])
        e = np.concatenate([self.run_end[plain], single + 1])
        text = np.concatenate([self.run_text[plain], np.repeat(self.run_text[very], self.run_end[very] - self.run_start[very])])
        cut = len(plain)
        h = np.concatenate([piecewise_hashes(self.data, x, y + self.least - 1) for x, y in ((s[:cut], e[:cut]), (s[cut:], e[cut:]))])
        key = np.concatenate([prints[own[plain]], mix64(h[cut:] + _ODD) >> np.uint64(64 - bits)])
        h >>= np.uint64(16)
        order = np.lexsort((h, key))
        first = np.flatnonzero((np.diff(h[order], prepend=~h[order][:1]) != 0) | (np.diff(key[order], prepend=~key[order][:1]) != 0)) if len(h) else np.zeros(0, np.int64)
        lead = order[first]
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        least_id = np.minimum.reduceat(self.ids[text[order]], first) if len(first) else np.zeros(0, np.int64)
        return {"start": s, "end": e, "text": text, "which": which, "key": key[lead], "hash": h[lead], "from": s[lead], "bytes": (e - s)[lead] + self.least - 1, "id": least_id}


def equal_windows(segments: list[np.ndarray] | np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments in suffix order, and the group of each: (segment, offset, group), equal groups for equal bytes.

    segments: all bytes; a segment is starts[i] .. starts[i] + lengths[i]. Each is closed by a separator (0; bytes are 1 to
    256), and suffixes are sorted by their first 56 symbols or more, which settles all that the expansion asks.
    """
    n = int(lengths.sum()) + len(lengths)
    x = np.zeros(n, np.int64)
    base = np.cumsum(lengths + 1) - lengths - 1
    x[spans(base, lengths)] = segments[spans(starts, lengths)].astype(np.int64) + 1
    # suffix order by doubling: 7 symbols of 9 bits, then 14, 28, 56, ...
    pad = np.concatenate([x, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | pad[k : k + n]
    depth, rank = 7, None
    while True:
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if depth >= least + 1 or new.all():
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - depth)] = rank[depth:]
        key = rank * (n + 1) + after
        depth *= 2
    bwt = x[order - 1]  # of the first suffix it is the last separator
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    # breadth first from the empty string: intervals of all strings of one length, extended backward by each symbol
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(least):  # common prefixes of 0, 1, ..., least - 1 symbols
        at = spans(lo, hi - lo)
        if not len(at):
            break
        symbol = bwt[at]
        label = np.repeat(np.arange(len(lo)), hi - lo) * 512 + symbol
        by = np.argsort(label, kind="stable")
        label = label[by]
        first = np.flatnonzero(np.diff(label, prepend=-1) != 0)
        last = np.append(first[1:], len(label)) - 1
        a, b = lf[at[by[first]]], lf[at[by[last]]] + 1
        go = (label[first] % 512 != 0) & ~met[b]
        lo, hi = a[go], b[go]
        met[hi] = True
    group = np.cumsum(met[:-1])
    segment = np.repeat(np.arange(len(lengths)), lengths + 1)[order]
    offset = order - base[segment]
    whole = offset + least <= lengths[segment]
    return segment[whole], offset[whole], group[whole]


class Shard:
    """Segments that chunks sent, by (fingerprint, hash): which are equal, their least ids, and whose text is needed."""

    def __init__(self, keys: list[np.ndarray], hashes: list[np.ndarray], ids: list[np.ndarray]):
        self.size = np.array([len(k) for k in keys], np.int64)
        key, h = np.concatenate(keys), np.concatenate(hashes)
        order = np.lexsort((h, key))  # stable: of equal segments the first chunk's comes first
        new_key = np.diff(key[order], prepend=~key[order][:1]) != 0
        first = np.flatnonzero(new_key | (np.diff(h[order], prepend=~h[order][:1]) != 0))
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        self.low = np.minimum.reduceat(np.concatenate(ids)[order], first)
        self.group = np.cumsum(new_key)[first] - 1  # by fingerprint
        self.wanted = np.bincount(self.group)[self.group] > 1  # segments that aren't alone with theirs
        self.asked = np.zeros(len(key), bool)
        self.asked[order[first[self.wanted]]] = True

    def windows(self, data: np.ndarray, lengths: np.ndarray, least: int, slice_bytes: int = 1 << 19) -> dict[int, np.ndarray]:
        """Of segments whose windows have several least ids, those by window; low is put right for the others.

        data, lengths: the texts of the wanted segments, one after the other.
        """
        want = np.flatnonzero(self.wanted)
        starts = np.cumsum(lengths) - lengths
        out: dict[int, np.ndarray] = {}
        at, upto = 0, np.cumsum(lengths)
        while at < len(want):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + slice_bytes)))
            while to < len(want) and self.group[want[to]] == self.group[want[to - 1]]:  # an anchor's segments stay together
                to += 1
            part = want[at:to]
            segment, offset, group = equal_windows(data, starts[at:to], lengths[at:to], least)
            at = to
            if not len(group):
                continue
            edge = np.flatnonzero(np.diff(group, prepend=-1) != 0)
            found = np.repeat(np.minimum.reduceat(self.low[part[segment]], edge), np.diff(np.append(edge, len(group))))
            by = np.lexsort((offset, segment))
            segment, found = segment[by], found[by]
            edge = np.flatnonzero(np.diff(segment, prepend=-1) != 0)
            small, large = np.minimum.reduceat(found, edge), np.maximum.reduceat(found, edge)
            ends = np.append(edge[1:], len(segment))
            self.low[part[segment[edge]]] = small
            for e in np.flatnonzero(small != large).tolist():
                out[int(part[segment[edge[e]]])] = found[edge[e] : ends[e]]
        return out


def drop_repeats(docs: DataFrame, least: int = 50, gram: int = 26, chunk_bytes: int = 3 << 20, hot_chunks: int = 64, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept (binary).

    Texts are UTF-8 bytes, null ones empty; strings are judged on the input, not on what is left, and don't cross documents.
    Of rows with one id none is the other's source. Rows with a null id come before no other and after no other: they
    neither lose nor cause to lose. Texts of fewer than `least` bytes stay whole. Columns beside the two named are left out.
    """
    spark = docs.sparkSession
    schema_right = "chunk int, kind int, key long, a binary, b binary"
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    md5 = F.unhex(F.md5(text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), md5.alias("md5"), F.when((F.octet_length(text) < least) | F.col(id_col).isNull(), F.sha2(text, 256)).alias("whole"), *([F.when((F.octet_length(text) < least) | F.col(id_col).isNull(), text).alias("whole_text")] if with_text else []))
    long = rows.where(F.col("whole").isNull())
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    parts = shuffle_parts(spark)
    buckets, shards = max(parts, -(-total // (64 << 20))), max(parts, -(-total // (128 << 20)))
    width = min(56, max(40, int(total).bit_length() + 5))  # bits of a fingerprint: few of the anchors collide at any size
    chunk_of = lambda c: F.pmod(F.conv(F.substring(F.hex(c), 1, 12), 16, 10).cast("long"), F.lit(chunks)).cast("int")

    def once(source):
        """A task's first copy of each text; the table of what was seen is bounded by starting anew."""
        seen: set[bytes] = set()
        for batch in source:
            if len(seen) > 500_000:
                seen.clear()
            take = []
            for i, d in enumerate(batch.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    take.append(i)
            for a in range(0, len(take), 500):
                part = batch.take(pa.array(take[a : a + 500], pa.int32()))
                raw = part.column(2).to_pylist()
                codec = pa.Codec("zstd", compression_level=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in raw], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["chunk", "md5", "size", "z"])

    texts = docs.where((F.octet_length(text) >= least) & F.col(id_col).isNotNull()).select(chunk_of(md5).alias("chunk"), md5.alias("md5"), text.alias("text")).mapInArrow(once, "chunk int, md5 binary, size long, z binary")
    sources = long.groupBy("md5").agg(F.min("doc_id").alias("key"))
    right0 = sources.select(chunk_of(F.col("md5")).alias("chunk"), F.lit(0).alias("kind"), "key", F.col("md5").alias("a"), F.lit(None).cast("binary").alias("b"))

    def opened(left: pa.Table, right: pa.Table):
        ids, answers = {}, {1: {}, 2: {}, 3: {}}
        for kind, key, a, b in zip(*(right.column(c).to_pylist() for c in ("kind", "key", "a", "b")), strict=True):
            if kind:
                answers[kind][key] = a, b
            else:
                ids[a] = key
        first = {}
        for d, n, z in zip(*(left.column(c).to_pylist() for c in ("md5", "size", "z")), strict=True):
            if d not in first:
                first[d] = opened_up(z, n)
        names = sorted(first)
        return names, Chunk([first[d] for d in names], np.array([ids[d] for d in names], np.int64), least, gram), answers

    def bits(x: np.ndarray) -> bytes:
        return np.packbits(x).tobytes()

    def unbits(x: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)

    def cuts(of: np.ndarray):
        edge = np.flatnonzero(np.diff(of, prepend=-1) != 0)
        return zip(of[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True) if len(of) else ()

    sent1 = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("prints", pa.binary()), ("several", pa.binary())])

    def send_prints(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent1.empty_table()
        _, c, _ = opened(left, right)
        u, several, _ = c.fingerprints(width)
        out = [(k, pack_sorted(u[a:b]), bits(several[a:b])) for k, a, b in cuts(part_of(u, width, buckets))]
        n = left.column("chunk")[0].as_py()
        return pa.table([[x[0] for x in out], [n] * len(out), [x[1] for x in out], [x[2] for x in out]], schema=sent1)

    right_schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def answer_prints(table: pa.Table) -> pa.Table:
        prints = [unpack_sorted(x) for x in table.column("prints").to_pylist()]
        size = [len(p) for p in prints]
        _, which, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        several = np.concatenate([unbits(s, n) for s, n in zip(table.column("several").to_pylist(), size, strict=True)])
        shared = count > 1
        shared[which[several]] = True
        hot = count > hot_chunks
        ends = np.cumsum(size)
        answers = [(bits(shared[which[e - n : e]]), bits(hot[which[e - n : e]])) for e, n in zip(ends.tolist(), size, strict=True)]
        k = table.column("bucket").to_pylist()
        return pa.table([table.column("chunk").combine_chunks(), [1] * len(k), k, [x[0] for x in answers], [x[1] for x in answers]], schema=right_schema)

    def segments_of(c: Chunk, answers: dict) -> dict:
        u, _, own = c.fingerprints(width)
        shared, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
        for k, a, b in cuts(part_of(u, width, buckets)):
            x, y = answers[1][k]
            shared[a:b], hot[a:b] = unbits(x, b - a), unbits(y, b - a)
        return c.segments(u, shared, hot, own, width)

    sent2 = pa.schema([("shard", pa.int64()), ("chunk", pa.int32()), ("keys", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary())])

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent2.empty_table()
        _, c, answers = opened(left, right)
        s = segments_of(c, answers)
        out = [(k, pack_sorted(s["key"][a:b]), _low_bytes(s["hash"][a:b], 6), pack_ints(s["id"][a:b])) for k, a, b in cuts(part_of(s["key"], width, shards))]
        n = left.column("chunk")[0].as_py()
        return pa.table([[x[0] for x in out], [n] * len(out), *([x[i] for x in out] for i in range(1, 4))], schema=sent2)

    def shard_of(table: pa.Table) -> tuple[pa.Table, Shard]:
        table = table.sort_by("chunk")
        return table, Shard(*([read(x) for x in table.column(c).to_pylist()] for c, read in (("keys", unpack_sorted), ("hashes", lambda x: _from_bytes(x, 6)), ("ids", unpack_ints))))

    def ask(table: pa.Table) -> pa.Table:
        table, shard = shard_of(table)
        ends = np.cumsum(shard.size)
        wanted = [bits(shard.asked[e - n : e]) if shard.asked[e - n : e].any() else None for e, n in zip(ends.tolist(), shard.size.tolist(), strict=True)]
        k = table.column("shard").to_pylist()
        return pa.table([table.column("chunk").combine_chunks(), [2] * len(k), k, wanted, [None] * len(k)], schema=right_schema).filter(pa.array([w is not None for w in wanted], pa.bool_()))

    sent3 = pa.schema([("shard", pa.int64()), ("chunk", pa.int32()), ("lengths", pa.binary()), ("text", pa.binary())])

    def send_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent3.empty_table()
        _, c, answers = opened(left, right)
        s = segments_of(c, answers)
        out = []
        for k, a, b in cuts(part_of(s["key"], width, shards)):
            if k in answers[2]:
                at = a + np.flatnonzero(unbits(answers[2][k][0], b - a))
                out.append((k, pack_ints(s["bytes"][at]), squeezed(c.data[spans(s["from"][at], s["bytes"][at])].tobytes())))
        n = left.column("chunk")[0].as_py()
        return pa.table([[x[0] for x in out], [n] * len(out), [x[1] for x in out], [x[2] for x in out]], schema=sent3)

    def answer_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return right_schema.empty_table()
        table, shard = shard_of(left)
        right = right.sort_by("chunk")
        lengths = [unpack_ints(x) for x in right.column("lengths").to_pylist()]
        each: dict[int, np.ndarray] = {}
        if lengths:
            # texts come as the chunks were asked for them, and are put in the order of the shard's segments
            data = np.frombuffer(b"".join(opened_up(x, int(n.sum())) for x, n in zip(right.column("text").to_pylist(), lengths, strict=True)), np.uint8)
            size = np.concatenate(lengths)
            by = np.argsort(shard.which[shard.asked], kind="stable")
            starts = np.cumsum(size) - size
            each = shard.windows(data[spans(starts[by], size[by])], size[by], least)
        out, at = [], 0
        for n in shard.size.tolist():
            mine = shard.which[at : at + n]
            at += n
            more = [each[i] for i in mine.tolist() if i in each] if each else []
            low = pack_ints(shard.low[mine])
            if more:
                varied = bits(np.array([i in each for i in mine.tolist()]))
                flat = pack_ints(np.concatenate(more))
                out.append((low, len(flat).to_bytes(4, "little") + varied + squeezed(flat)))
            else:
                out.append((low, None))
        k = table.column("shard").to_pylist()
        return pa.table([table.column("chunk").combine_chunks(), [3] * len(k), k, [x[0] for x in out], [x[1] for x in out]], schema=right_schema)

    fields = [("md5", pa.binary()), ("rep", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text else [])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema(fields).empty_table()
        names, c, answers = opened(left, right)
        s = segments_of(c, answers)
        low, varied = np.zeros(len(s["key"]), np.int64), np.zeros(len(s["key"]), bool)
        more: dict[int, np.ndarray] = {}
        for k, a, b in cuts(part_of(s["key"], width, shards)):
            x, y = answers[3][k]
            low[a:b] = unpack_ints(x)
            if y is not None:
                head = 4 + -(-(b - a) // 8)
                varied[a:b] = unbits(y[4:head], b - a)
                extra, at = unpack_ints(opened_up(y[head:], int.from_bytes(y[:4], "little"))), 0
                for i in (a + np.flatnonzero(varied[a:b])).tolist():
                    n = int(s["bytes"][i]) - least + 1
                    more[i] = extra[at : at + n]
                    at += n
        mark = np.zeros(len(c.data) + 1, np.int32)
        mine, by_window = c.ids[s["text"]], varied[s["which"]]
        gone = (low[s["which"]] < mine) & ~by_window
        np.add.at(mark, s["start"][gone], 1)
        np.add.at(mark, s["end"][gone] + least - 1, -1)
        for o in np.flatnonzero(by_window).tolist():
            w = s["start"][o] + np.flatnonzero(more[int(s["which"][o])] < mine[o])
            np.add.at(mark, w, 1)
            np.add.at(mark, w + least, -1)
        covered = np.cumsum(mark[:-1]) > 0
        out = []
        for i, d in enumerate(names):
            part = covered[c.start[i] : c.end[i]]
            n = int(part.sum())
            kept = c.data[c.start[i] : c.end[i]][~part].tobytes() if n else c.data[c.start[i] : c.end[i]].tobytes()
            out.append((d, int(c.ids[i]), n, int((np.diff(part.view(np.int8), prepend=np.int8(0)) == 1).sum()) if n else 0, hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([[x[i] for x in out] for i in range(len(fields))], schema=pa.schema(fields))

    by_chunk = texts.groupBy("chunk")
    prints = by_chunk.cogroup(right0.groupBy("chunk")).applyInArrow(send_prints, "bucket long, chunk int, prints binary, several binary")
    right1 = prints.groupBy("bucket").applyInArrow(answer_prints, schema_right)
    right01 = right0.unionByName(right1)
    segs = by_chunk.cogroup(right01.groupBy("chunk")).applyInArrow(send_segments, "shard long, chunk int, keys binary, hashes binary, ids binary")
    right2 = segs.groupBy("shard").applyInArrow(ask, schema_right)
    asked = by_chunk.cogroup(right01.unionByName(right2).groupBy("chunk")).applyInArrow(send_texts, "shard long, chunk int, lengths binary, text binary")
    right3 = segs.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer_segments, schema_right)
    done = by_chunk.cogroup(right01.unionByName(right3).groupBy("chunk")).applyInArrow(cut, "md5 binary, rep long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

    joined = rows.join(done, (rows["md5"] == done["md5"]) & rows["whole"].isNull(), "left")
    own = F.col("rep") == F.col("doc_id")
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda whole, mine, copy: F.when(F.col("whole").isNotNull(), whole).when(own, mine).otherwise(copy)
    return joined.select(
        "doc_id", "n_bytes",
        pick(F.lit(0), F.col("n_removed"), F.col("n_bytes")).cast("long").alias("n_removed"),
        pick(F.lit(0), F.col("n_spans"), F.lit(1)).cast("long").alias("n_spans"),
        pick(F.col("whole"), F.col("kept_sha256"), F.lit(nothing)).alias("kept_sha256"),
        *([pick(F.col("whole_text"), F.col("kept"), F.lit(b"")).alias("kept")] if with_text else []),
    )
