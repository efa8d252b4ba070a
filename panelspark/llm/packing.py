"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces longer than half the capacity open a sequence each; what they leave is the first gaps. The other pieces follow by
falling classes of length, as best-fit decreasing has it, each class in rounds of three steps:

1. Range-sort: pieces are cut into ranges of neighbouring lengths with about as many pieces each (a length that fills
   several ranges is dealt over them), and each gap goes to the range of the largest lengths that it can take. Gaps that a
   range has no use for, as it has as many as pieces or room enough, serve the next ranges below. The driver decides this
   from how many pieces and gaps there are of each size, at most `capacity` numbers of either; rows find their range alone.
2. Sweep: each range goes through its pieces from long to short; a piece takes its successor, the smallest gap that holds
   it. Pieces that want the same gap are served by rank, and what is left of a gap is a gap again.
3. Update: gaps with their new sizes and pieces without a gap go into the next round, which deals them anew. In the second
   round of a class a piece that still finds no gap opens a sequence.

Every round is one shuffle of pieces of one class and of the gaps that serve them, cut by a checkpoint.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, mix64
from .token_counts import load
from .words import text_splitter


@lru_cache(maxsize=4)
def bare(path: str):
    """The tokenizer without its normaliser, and its special strings: words come normalised, and doing so twice would reorder marks."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return Tokenizer.from_str(json.dumps(data | {"normalizer": None})), load(path)[1]


_TABLES: dict[str, dict[str, bytes]] = {}  # of this worker process, by tokenizer file: what one task learns the next one has


def id_encoder(path: str, table_rows: int = 700_000):
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, without added special tokens.

    Words are encoded once, when a worker first meets them; its table starts anew at table_rows words.
    """
    tokenizer, added = bare(path)
    split = text_splitter(path)
    closes = np.zeros(tokenizer.get_vocab_size(), bool)
    closes[[i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
    fixed = {a: np.uint32(tokenizer.token_to_id(a)).tobytes() for a in added}
    known = _TABLES.setdefault(path, {})
    known |= fixed

    def learn(fresh: list[str]) -> None:
        """Ids of new words, encoded as one text: each word's last id, and no other, closes a word."""
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(closes[ids]) + 1
        if len(ends) == len(fresh) and ends[-1] == len(ids):
            raw = ids.tobytes()
            at = (4 * np.concatenate([[0], ends])).tolist()
            known.update(zip(fresh, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        else:  # a word that the joined text reads otherwise
            for word, e in zip(fresh, tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                known[word] = np.asarray(e.ids, "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > table_rows:
            known.clear()
            known.update(fixed)
        found, new = [], set()
        for text in texts:
            got = split(text)
            found.append(got)
            new.update(filterfalse(known.__contains__, got))
        fresh = list(new)
        for at in range(0, len(fresh), 5000):
            learn(fresh[at : at + 5000])
        return [b"".join(map(known.__getitem__, got)) for got in found]

    return encode


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.uint32(end_id).tobytes()

    def run(source):
        encode = id_encoder(tokenizer)
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, nth, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        rows.append(i), nth.append(p), start.append(a // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


WAITING, GAP, PLACED = 0, 1, 2


def ranges_of(pieces: dict[int, int], gaps: dict[int, int], range_pieces: int) -> tuple[dict[int, tuple[int, int]], dict[int, list[tuple[int, int, int]]], int]:
    """Where rows of each size meet: length -> (first range, ranges), gap -> shares (how many, first range, ranges), and how many ranges.

    Gaps in no share have no piece to meet in this round.
    """
    blocks: list[list[int]] = []  # least length, pieces, their sum, first range, ranges; from long to short
    of: dict[int, int] = {}
    at = 0
    for length in sorted(pieces, reverse=True):
        n = pieces[length]
        if not blocks or blocks[-1][1] + n > range_pieces:
            blocks.append([length, 0, 0, at, max(1, -(-n // range_pieces))])
            at += blocks[-1][4]
        b = blocks[-1]
        b[0], b[1], b[2] = length, b[1] + n, b[2] + n * length
        of[length] = len(blocks) - 1
    sizes = sorted(gaps)  # ascending
    shares: dict[int, list[tuple[int, int, int]]] = {}
    spare: list[list[int]] = []  # (size, how many) that ranges above didn't need, descending
    upper = len(sizes)
    for low, count, total, first, n in blocks:
        cut = bisect_left(sizes, low)
        spare += [[g, gaps[g]] for g in reversed(sizes[cut:upper])]
        upper = cut
        while count > 0 and total > 0 and spare:  # the smallest first
            g, have = spare[-1]
            take = min(have, count, -(-total // g))
            shares.setdefault(g, []).append((take, first, n))
            count, total = count - take, total - take * g
            spare[-1][1] -= take
            if not spare[-1][1]:
                spare.pop()
    return {length: (blocks[b][3], blocks[b][4]) for length, b in of.items()}, shares, at


def sweep(lengths: np.ndarray, gap_sizes: np.ndarray, capacity: int, may_open: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best fit of pieces (in falling order of length) into gaps: the sequence of each piece (-1: none), its offset, the sequences' gaps, and how many are new.

    Sequences are numbered by gap_sizes, new ones after them.
    """
    to, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    by_size: dict[int, list[int]] = {}
    for i, g in enumerate(gap_sizes.tolist()):
        by_size.setdefault(g, []).append(i)
    for held in by_size.values():
        held.reverse()
    sizes, opened, left = sorted(by_size), 0, dict(enumerate(gap_sizes.tolist()))

    def put(size: int, which: list[int]) -> None:
        left.update(dict.fromkeys(which, size))
        if size:
            if size not in by_size:
                insort(sizes, size)
                by_size[size] = []
            by_size[size].extend(which)

    edge = np.flatnonzero(np.diff(lengths, prepend=-1) != 0)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(lengths))[: len(edge)].tolist(), strict=True):
        length = int(lengths[a])
        while a < b:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                held = by_size[size]
                n = min(len(held), b - a)
                taken = held[-n:][::-1]
                del held[-n:]
                if not held:
                    del by_size[size]
                    sizes.pop(at)
            elif may_open:
                size, n = capacity, -(-(b - a) // (capacity // length))
                taken = list(range(len(gap_sizes) + opened, len(gap_sizes) + opened + n))
                opened += n
            else:
                break
            to[a : a + n], offset[a : a + n] = taken, capacity - size
            put(size - length, taken)
            a += n
    return to, offset, np.array([left[i] for i in range(len(gap_sizes) + opened)], np.int64), opened


def best_fit(pieces: DataFrame, capacity: int, id_col: str, kind: str, range_pieces: int) -> DataFrame:
    """Places all of pieces(id, piece, start, length, ids_crc32), which must not change when read again."""
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "state"]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, state int"

    def rows(cols: list[pa.Array], sequence, offset, state: int) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*cols, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(np.full(n, state, np.int32))], names=names)

    def no_piece(like: pa.DataType, sizes: np.ndarray) -> list[pa.Array]:
        n = len(sizes)
        return [pa.nulls(n, like), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int64())]

    def number(source):
        """Batches with the place of each row among all, which is the same at every reading."""
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in source:
            yield batch, np.arange(at, at + batch.num_rows)
            at += batch.num_rows

    def open_long(source):
        for batch, place in number(source):
            length = batch.column(3).to_numpy()
            sequence = -1 - place  # sequences that later rounds open have numbers from 0
            yield rows(batch.columns[:5], sequence, np.zeros(len(place), np.int64), PLACED)
            some = length < capacity
            yield rows(no_piece(batch.column(0).type, capacity - length[some]), sequence[some], length[some], GAP)

    long = 2 * F.col("length") > capacity
    state = keep(pieces.where(long).mapInArrow(open_long, schema))
    done = [state.where(F.col("state") == PLACED)]
    waiting_rows = pieces.where(~long)
    waiting = waiting_rows.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), F.lit(WAITING).alias("state"))
    counts = {r["length"]: r["count"] for r in waiting_rows.groupBy("length").count().collect()}  # at most capacity / 2 rows
    turn, upper = 0, capacity // 2 + 1
    for part in (4, 8, 16, 64, capacity + 1):
        lower = capacity // part + 1
        wanted = {n: c for n, c in counts.items() if lower <= n < upper}
        coming = waiting.where(F.col("length").between(lower, upper - 1))
        upper = lower
        for may_open in (False, True):
            if not wanted:
                break
            turn += 1
            gaps = {r["length"]: r["count"] for r in state.where(F.col("state") == GAP).groupBy("length").count().collect()}
            home, shares, n_ranges = ranges_of(wanted, gaps, range_pieces)
            idle = max(1, -(-sum(gaps.values()) // (4 * range_pieces)))  # gaps that meet no piece pass through groups of their own

            def route(source, turn=turn, gaps=gaps, home=home, shares=shares, n_ranges=n_ranges, idle=idle):
                first, width = np.zeros(capacity + 1, np.int64), np.ones(capacity + 1, np.int64)
                for length, (f, w) in home.items():
                    first[length], width[length] = f, w
                for batch, place in number(source):
                    size, gap = batch.column(3).to_numpy(), batch.column(7).to_numpy() == GAP
                    u = mix64(place.astype(np.uint64) + np.uint64(turn << 58))
                    to = first[size] + (u % width[size].astype(np.uint64)).astype(np.int64)
                    to[gap] = n_ranges + (u[gap] % np.uint64(idle)).astype(np.int64)
                    for g in np.unique(size[gap]).tolist():
                        if g in shares:
                            take, f, w = (np.array(x, np.int64) for x in zip(*shares[g], strict=True))
                            at = np.flatnonzero(gap & (size == g))
                            lot = ((u[at] >> np.uint64(32)).astype(np.float64) / 2.0**32 * gaps[g]).astype(np.int64)
                            k = np.searchsorted(np.cumsum(take), lot, side="right")
                            hit = k < len(take)
                            to[at[hit]] = f[k[hit]] + (u[at[hit]] % w[k[hit]].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=[*names, "range"])

            def match(table: pa.Table) -> pa.Table:
                table = table.sort_by([("state", "ascending"), ("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("sequence_id", "ascending")]).combine_chunks()
                n = int((table["state"].to_numpy() == WAITING).sum())
                mine, theirs = table.slice(0, n), table.slice(n)
                to, offset, left, opened = sweep(mine["length"].to_numpy(), theirs["length"].to_numpy(), capacity, may_open)
                new = (turn << 56) + (table["range"][0].as_py() << 32) + np.arange(opened)
                sequence = np.concatenate([theirs["sequence_id"].to_numpy().astype(np.int64), new])
                cols = [mine.column(i).combine_chunks() for i in range(5)]
                got, rest = np.flatnonzero(to >= 0), np.flatnonzero(to < 0)
                some = left > 0
                out = [rows([c.take(pa.array(got)) for c in cols], sequence[to[got]], offset[got], PLACED), rows([c.take(pa.array(rest)) for c in cols], [None] * len(rest), [None] * len(rest), WAITING), rows(no_piece(cols[0].type, left[some]), sequence[some], capacity - left[some], GAP)]
                return pa.Table.from_batches([b for b in out if b.num_rows], out[0].schema)

            routed = coming.unionByName(state.where(F.col("state") == GAP)).mapInArrow(route, f"{schema}, `range` long")
            state = keep(routed.groupBy("range").applyInArrow(match, schema))
            done.append(state.where(F.col("state") == PLACED))
            coming = state.where(F.col("state") == WAITING)
            wanted = {} if may_open else {r["length"]: r["count"] for r in coming.groupBy("length").count().collect()}
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("state")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, range_pieces: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id; a null or empty text is the end id alone. Only documents above the capacity
    are cut, into pieces of the capacity and one shorter last piece. Every piece is placed; a sequence is filled gaplessly
    from 0. Pieces of one length may take each other's places; repeated rows are packed once each, ids may be null, other
    columns are left out. An empty table gives no rows. range_pieces is about how many pieces one task of a sweep holds,
    with at most as many gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = keep(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col))  # encoded once
    return best_fit(pieces, capacity, id_col, kind, range_pieces)
