"""Alignment of two tokenizers' tokens by byte ranges, done once per distinct segment of the corpus.

1. Texts, with one space before them, are split before runs of white space where no token of either file can reach across:
   the byte-level file cuts there by rule, and the vocabulary of the piece file is searched for pieces that hold another
   character before the white space (some hold one before a carriage return, so nothing is split there).
2. Segments are counted, and each distinct one is tokenised by both libraries and aligned once. A group of p and q tokens
   that end together only at its end has p + q - 1 overlapping pairs.
3. Pairs of ids are counted over the corpus: a segment's pairs times how often it stands. Each segment gets the sums that
   its pairs' counts make. As long as there are at most `pair_rows` different pairs every task has them, else they are joined.
4. Documents are composed of their segments' alignments. The most frequent segments, of a bounded number and size, are
   given to every task; the others are joined by segment and gathered by document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, store
from .lexicon import byte_symbols

#: White space that texts may be split before, if the vocabularies allow it.
BREAKS = " \t\n\x0b\x0c\r"
SPACE = "▁"


@lru_cache(maxsize=2)
def load_bytes(path: str):
    """A byte-level tokenizer that takes special strings for plain text, and the bytes of each of its ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    cut = data["pre_tokenizer"] or {}
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or data["normalizer"]:
        raise ValueError(f"{path} isn't a plain byte-level file")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    raw = {c: b for b, c in enumerate(byte_symbols())}
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, i in data["model"]["vocab"].items():
        tokens[i] = bytes(raw[c] for c in token)
    return tokenizer, tokens


@lru_cache(maxsize=2)
def load_pieces(path: str):
    """A piece tokenizer with byte fallback, and the bytes of each of its ids."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace(SPACE, " ").encode())
    if sum(map(pieces.is_byte, range(len(tokens)))) != 256:
        raise ValueError(f"{path} has no byte fallback")
    return pieces, tokens


def breaks(path: str) -> str:
    """White space that no piece holds after another character."""
    pieces, _ = load_pieces(path)
    held = set()
    for i in range(pieces.get_piece_size()):
        if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i)):
            piece = pieces.id_to_piece(i).replace(SPACE, " ")
            held |= {y for x, y in zip(piece, piece[1:], strict=False) if y.isspace() and not x.isspace()}
    return "".join(c for c in BREAKS if c not in held)


@lru_cache(maxsize=2)
def segmenter(path: str):
    """A function from a text to its segments: each begins with white space, and all joined are a space and the text."""
    safe = "".join(f"\\x{ord(c):02x}" for c in breaks(path))
    if "\\x20" not in safe:
        return lambda text: [" " + text]
    find = re.compile(rf"[{safe}]\s*\S*(?:[^\S{safe}]\s*\S*)*").findall  # Python's white space includes all of Unicode's
    return lambda text: find(" " + text)


def readable(path: str):
    """Whether the piece file's tokens of a text are a space and the text, byte by byte."""
    pieces, _ = load_pieces(path)

    def check(text: str | None) -> bool:
        return bool(text) and SPACE not in text and pieces.Normalize(text) == SPACE + text.replace(" ", SPACE)

    return check


def column_aligner(a_path: str, b_path: str):
    """A function from segments to the ids of a and of b, end to end, and the columns n_a, n_b, n_groups, groups (as text), pairs (a << 32 | b) and times.

    The segments of a call are one run of bytes, and so are their tokens in either file: the stretches between all ends are
    the pairs of tokens that overlap, and the ends that both have are those of groups.
    """
    tokenizer, bytes_a = load_bytes(a_path)
    pieces, bytes_b = load_pieces(b_path)
    # what the piece file puts before a text is kept off by a control character that no piece holds
    guard = next(c for c in map(chr, range(1, 32)) if not any(c in pieces.id_to_piece(i) for i in range(pieces.get_piece_size())))
    before = np.array(pieces.encode(guard), np.int64)
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (bytes_a, bytes_b))
    # ids with what stands after them: "," inside a group's half, "|" between halves, ";" between groups
    shift_a, shift_b = len(bytes_a), len(bytes_b)
    written = pa.array([f"{i}{c}" for n, after in ((shift_a, (",", "|")), (shift_b, (",", ";", ""))) for c in after for i in range(n)])

    def spelt(ids: list[list[int]], tokens: list[bytes], raw: list[bytes]) -> None:
        for x, r in zip(ids, raw, strict=True):
            if b"".join([tokens[i] for i in x]) != r:
                raise ValueError(f"tokens of {r.decode()[:40]!r} don't spell it")

    def align(segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        n, guards, raw = len(segments), len(before), [s.encode() for s in segments]
        all_a = [e.ids for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        all_b = pieces.encode([guard + s for s in segments], num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (all_a, all_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, k.sum()) for x, k in ((all_a, n_a), (all_b, n_b)))
        own = np.arange(len(b)) - np.repeat(np.cumsum(n_b) - n_b, n_b) >= guards
        if n_b.min() < guards or (b[~own].reshape(n, guards) != before).any():
            raise ValueError("a piece reaches over the guard")
        b, n_b = b[own], n_b - guards
        end, end_a, end_b = np.cumsum([len(r) for r in raw]), np.cumsum(size_a[a]), np.cumsum(size_b[b])
        last_a, last_b, joined = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1, b"".join(raw)
        fits = min(n_a.min(), n_b.min(), size_a[a].min(initial=1), size_b[b].min(initial=1)) > 0 and (end_a[last_a] == end).all() and (end_b[last_b] == end).all()
        if not fits or b"".join([bytes_a[i] for i in a.tolist()]) != joined or b"".join([bytes_b[i] for i in b.tolist()]) != joined:
            spelt(all_a, bytes_a, raw)
            spelt([x[guards:] for x in all_b], bytes_b, raw)
            raise ValueError("a token without a byte")
        cuts = np.union1d(end_a, end_b)
        pair, of = a[np.searchsorted(end_a, cuts)] << 32 | b[np.searchsorted(end_b, cuts)], np.searchsorted(end, cuts)
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        at = pa.array(np.searchsorted(of[first], np.arange(n + 1)), pa.int32())
        times = np.diff(first, append=len(pair))
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        final = np.zeros(len(b), np.int64)
        final[last_b] = 1
        write_a = a + shift_a * (both[group_a] == end_a)
        write_b = 2 * shift_a + b + shift_b * ((both[group_b] == end_b) + final)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text = written.take(pa.array(np.concatenate([write_a, write_b])[order]))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(n_a + n_b)]), pa.int32()), text), "")
        counts = [pa.array(x, pa.int32()) for x in (n_a, n_b, np.bincount(np.searchsorted(end, both), minlength=n))]
        return a, b, [*counts, groups, pa.ListArray.from_arrays(at, pa.array(pair[first])), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))]

    return align


def aligner(a_path: str, b_path: str):
    """A function from segments to (ids of a, ids of b, groups, pairs with how often each is there) of each."""
    run = column_aligner(a_path, b_path)

    def align(segments: list[str]):
        if not segments:
            return
        a, b, columns = run(segments)
        at_a = at_b = 0
        for n_a, n_b, _, groups, pairs, times in zip(*(c.to_pylist() for c in columns), strict=True):
            yield a[at_a : at_a + n_a].tolist(), b[at_b : at_b + n_b].tolist(), groups.split(";"), dict(zip(pairs, times, strict=True))
            at_a, at_b = at_a + n_a, at_b + n_b

    return align


def aligned_segments(docs: DataFrame, a_path: str, b_path: str, text_col: str, table_rows: int) -> DataFrame:
    """segment, n (how often it stands in readable texts), its numbers of tokens and groups, its groups, and its pairs with how often each is in it."""

    def count(source):
        split, ok, seen, room = segmenter(b_path), readable(b_path), Counter(), table_rows

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["segment", "n"])

        for batch in source:
            for text in batch.column(0).to_pylist():
                if ok(text):
                    seen.update(split(text))
                    room -= len(text) >> 12  # long texts take more of the table
                if len(seen) > room:
                    yield out()
                    seen.clear()
                    room = table_rows
        yield out()

    def align(source):
        run = column_aligner(a_path, b_path)
        for batch in source:
            for part in slices(batch, 0, rows=4096, size=1_000_000):
                yield pa.RecordBatch.from_arrays([*part.columns, *run(part.column(0).to_pylist())[2]], names=["segment", "n", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    return store(each.mapInArrow(align, "segment string, n long, n_a int, n_b int, n_groups int, groups string, pairs array<long>, times array<int>"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, links (how many links of the corpus hold it) and best (no other pair of its second id has more)."""
    each = aligned.select("n", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = store(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("n") * F.col("p.times")).alias("links")))
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(second.alias("second")).agg(F.max("links").alias("most"))
    return counts.join(most, second == F.col("second")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


PLACES = 32


def place(column: str) -> Column:
    """In which of the places a row meets a key that very many rows hold."""
    return F.pmod(F.xxhash64(column), F.lit(PLACES)).cast("int")


def everywhere() -> Column:
    return F.sequence(F.lit(0), F.lit(PLACES - 1))


WEIGHED = ("segment", "n", "n_a", "n_b", "n_groups", "groups", "n_best", "count_sum")


def weigh(aligned: DataFrame, pair_rows: int) -> DataFrame:
    """Segments with n_best and count_sum, the sums over the links of one occurrence."""
    counts = store(pair_counts(aligned))
    schema = "segment string, n long, n_a int, n_b int, n_groups int, groups string, n_best long, count_sum long"
    if counts.count() > pair_rows:  # a pair may be in very many segments: its counts meet them in PLACES places
        each = aligned.select("segment", F.explode(F.arrays_zip("pairs", "times")).alias("p"), place("segment").alias("place"))
        each = each.select("segment", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        found = each.join(counts.withColumn("place", F.explode(everywhere())), ["pair", "place"])
        sums = found.groupBy("segment").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("links") * F.col("times")).alias("count_sum"))
        return aligned.join(sums, "segment").select(*WEIGHED)
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known, links, best = (table[c].to_numpy()[order] for c in ("pair", "links", "best"))

    def run(source):
        for batch in source:
            pairs, times = batch.column(6), batch.column(7).flatten().to_numpy()
            size = np.diff(pairs.offsets.to_numpy())
            at = np.searchsorted(known, pairs.flatten().to_numpy())
            begin = np.cumsum(size) - size
            sums = [np.add.reduceat(v, begin) if len(size) else v for v in (best[at] * times, links[at] * times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(s.astype(np.int64)) for s in sums)], names=list(WEIGHED))

    return aligned.mapInArrow(run, schema)


_HEADS: dict[str, dict[str, int]] = {}  # of this worker process, by the run it belongs to: one at a time


def head_of(run: str, segments: pa.StringArray) -> dict[str, int]:
    if run not in _HEADS:
        _HEADS.clear()
        _HEADS[run] = dict(zip(segments.to_pylist(), range(len(segments)), strict=True))
    return _HEADS[run]


NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_rows: int = 393_216, head_bytes: int = 64, pair_rows: int = 1_000_000, table_rows: int = 300_000) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text.

    Null and empty texts, and those that the piece file doesn't give back byte by byte (as it reads U+2581 as a space), have no
    tokens: zeros and ''. Special strings inside a text are plain text. One row out for each row in, repeated rows and null
    ids included; other columns are left out; an empty table gives no rows. head_rows, head_bytes (of a segment) and pair_rows
    bound what every task is given, table_rows what a task counts before it sends. Ids must be of an atomic type.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ready = weigh(aligned_segments(docs, a_path, b_path, "text", table_rows), pair_rows)
    # the head: short segments of the largest frequencies, by sixteenths of a power of two, while they are at most head_rows
    step, short = F.floor(F.log2("n") * 16).cast("int"), F.octet_length("segment") <= head_bytes
    cut, room = None, head_rows
    sizes = ready.groupBy(F.when(short, step).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()
    for b, c in sorted(((r.b, r.c) for r in sizes if r.b is not None), reverse=True):
        room -= c
        if room < 0:
            break
        cut = b
    in_head = short & (step >= cut) if cut is not None else F.lit(False)
    table = ready.where(in_head).toArrow()
    # what every task has goes there as a few buffers: groups are ASCII, one text that is cut by offsets
    run, n_head = uuid.uuid4().hex, table.num_rows
    head_segments = pa.concat_arrays([pa.array([], pa.string()), *table["segment"].chunks])
    head_groups = "".join(table["groups"].to_pylist())
    head_ends = np.cumsum([0, *pc.binary_length(table["groups"]).to_pylist()]).astype(np.int64)
    head_sums = np.stack([table[c].to_numpy().astype(np.int64) for c in NUMBERS], 1)
    # numbers and groups of the others travel as one short string
    tail = ready.where(~in_head).select("segment", F.concat_ws(" ", *(F.col(c).cast("string") for c in NUMBERS), "groups").alias("packed"))
    # a long segment of a ten-thousandth of all occurrences or more: there are 10,000 at most, which are met in 32 places
    total = sum(r.n for r in sizes)
    hot = [r.h for r in ready.where(~short & (F.col("n") * 10_000 >= total)).select(F.xxhash64("segment").alias("h")).collect()]

    # rows with the same id and text are one row here: a key of both tells them from others, however often it is computed
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.concat(F.lit("x"), "text"), F.lit("")))))
    rows = docs.groupBy(key.alias("key")).agg(F.max("id").alias("id"), F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def missing(source):
        split, held = segmenter(b_path), head_of(run, head_segments).keys()
        for batch in source:
            for part in slices(batch, 2):
                rest = [list(dict.fromkeys(s for s in split(t) if s not in held)) if t else [] for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rest, pa.list_(pa.string()))], names=["key", "rest"])

    asked = rows.mapInArrow(missing, "key binary, rest array<string>").select("key", F.posexplode("rest").alias("pos", "segment"))
    on = ["segment"]
    if hot:
        is_hot, on = F.xxhash64("segment").isin(hot), ["segment", "place"]
        asked = asked.withColumn("place", F.when(is_hot, place("key")).otherwise(0))
        tail = tail.withColumn("place", F.explode(F.when(is_hot, everywhere()).otherwise(F.array(F.lit(0)))))
    found = asked.join(tail, on).select("key", F.concat_ws(" ", F.col("pos").cast("string"), "packed").alias("one"))
    found = found.repartition("key").groupBy("key").agg(F.collect_list("one").alias("found"))  # strings are shuffled, not lists of one

    def compose(source):
        split, ok, get = segmenter(b_path), readable(b_path), head_of(run, head_segments).get
        ends = array("q", head_ends.tobytes())
        for batch in source:
            for part in slices(batch, 1):
                out = []
                for text, more in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if not ok(text):
                        out.append((0, 0, 0, 0, 0, 0, ""))
                        continue
                    segments = split(text)
                    at = list(map(get, segments))
                    rest, sums = {}, np.zeros(len(NUMBERS), np.int64)
                    if more:
                        for i, k in enumerate(at):
                            if k is None:
                                at[i] = n_head + rest.setdefault(segments[i], len(rest))
                        groups, numbers = [""] * len(more), [()] * len(more)
                        for m in more:
                            pos, *counts, its_groups = m.split(" ", 1 + len(NUMBERS))
                            groups[int(pos)], numbers[int(pos)] = its_groups, list(map(int, counts))
                        joined = ";".join([groups[k - n_head] if k >= n_head else head_groups[ends[k] : ends[k + 1]] for k in at])
                        at = np.array(at)
                        sums += np.bincount(at[at >= n_head] - n_head, minlength=len(more)) @ np.array(numbers, np.int64)
                        at = at[at < n_head]
                    else:
                        joined = ";".join([head_groups[ends[k] : ends[k + 1]] for k in at])
                    n_a, n_b, n_groups, n_best, count_sum = (sums + head_sums[np.array(at, np.int64)].sum(0)).tolist()
                    out.append((n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum, hashlib.sha256(joined.encode()).hexdigest()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], names=["id", "copies", *RESULT])

    schema = f"id {kind}, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    met = rows.join(found, "key", "left").select("id", "text", "copies", "found").mapInArrow(compose, schema)
    # as many rows as there were, through arrays of at most 65,536 entries
    last = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 65_536))
    some = F.sequence(F.lit(1).cast("long"), F.least(F.lit(65_536).cast("long"), F.col("copies") - F.col("copies_before") * 65_536))
    return met.withColumn("copies_before", F.explode(last)).withColumn("copy", F.explode(some)).select(F.col("id").alias(id_col), *RESULT)
