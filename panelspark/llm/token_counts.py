"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its distinct pre-tokens of
frequency times pieces; no document's ids are ever made.

1. Tasks send their distinct pre-tokens with frequencies, which an aggregate brings together: one row a pre-token.
2. The tokenizers library counts the pieces of each row, once.
3. Frequencies of each document meet the pieces. The most frequent pre-tokens, of a bounded number, are a table that every
   task has, so that no key of the join is hot; the others of a document are joined by pre-token and summed.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Byte-level pre-tokenisation as the vocabulary's library does it; white space is the Unicode property, which `\s` of this module isn't.
PRETOKEN = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PRETOKEN = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-z0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file and the strings that it takes out of a text before anything else."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f).get("added_tokens", [])]
    return Tokenizer.from_file(path), added


def splitter(path: str):
    """A function from a text to its pre-tokens and the special strings, one token each, that stand between them."""
    import re

    _, added = load(path)
    wide, narrow = regex.compile(PRETOKEN), re.compile(ASCII_PRETOKEN)
    special = re.compile("|".join(map(re.escape, added))) if added else None
    hint = os.path.commonprefix(added)  # of every special string; '' is in any text

    def split(text: str) -> tuple[list[str], int]:
        if special is None or hint not in text:
            return (narrow if text.isascii() else wide).findall(text), 0
        parts = special.split(text)
        return [x for part in parts for x in (narrow if part.isascii() else wide).findall(part)], len(parts) - 1

    return split


def pieces_of(pretokens: list[str], path: str) -> list[int]:
    """How many tokens each is."""
    tokenizer, out = load(path)[0], []
    for at in range(0, len(pretokens), 20_000):
        out += map(len, tokenizer.encode_batch_fast(pretokens[at : at + 20_000], add_special_tokens=False))
    return out


def distinct_pretokens(docs: DataFrame, text_col: str, tokenizer: str, table_rows: int) -> DataFrame:
    """pretoken, n (how often it stands in all texts) and pieces, one row each."""

    def count(source):
        split, seen = splitter(tokenizer), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])

        for batch in source:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text)[0])
                if len(seen) > table_rows:
                    yield out()
                    seen.clear()
        yield out()

    def price(source):
        for batch in source:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces_of(batch.column(0).to_pylist(), tokenizer), pa.int64())], names=["pretoken", "n", "pieces"])

    each = docs.select(text_col).mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return each.mapInArrow(price, "pretoken string, n long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, head_rows: int = 262_144, table_rows: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Null texts are empty: 0 bytes, 0 tokens. Special strings inside a text are one token each, as the library has them by
    default. One row out for each row in, repeated rows included; a null id stays null; other columns are left out. An
    empty table gives no rows. head_rows bounds what every task is given, table_rows what a task counts before it sends.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    priced = keep(distinct_pretokens(docs, text_col, tokenizer, table_rows))
    # the head: all pre-tokens of the largest frequencies, by sixteenths of a power of two, while they are at most head_rows
    step = F.floor(F.log2("n") * 16).cast("int")
    cut, room = None, head_rows
    for b, c in sorted(map(tuple, priced.groupBy(step.alias("b")).count().collect()), reverse=True):
        room -= c
        if room < 0:
            break
        cut = b
    head = {}
    if cut is not None:
        rows = priced.where(step >= cut).select("pretoken", "pieces").toArrow()
        head = dict(zip(rows["pretoken"].to_pylist(), rows["pieces"].to_pylist(), strict=True))

    def run(source):
        from pyspark import TaskContext

        split, get = splitter(tokenizer), head.get
        row = TaskContext.get().partitionId() << 40
        names = ["row", "pretoken", "k", "id", "n_bytes", "n_tokens"]
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_bytes, sums, rest, owner, times = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    n_bytes.append(len(text.encode()))
                    pretokens, total = split(text)
                    got = list(map(get, pretokens))
                    if None in got:
                        more = Counter(p for p, k in zip(pretokens, got, strict=True) if k is None)
                        rest += more
                        times += more.values()
                        owner += [row + i] * len(more)
                        got = [k for k in got if k is not None]
                    sums.append(total + sum(got))
                m, t = part.num_rows, len(rest)
                # a row's own key, "x " and a number, is no pre-token: spaces only begin them
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + m), pa.int64()), pa.array([f"x {r}" for r in range(row, row + m)], pa.string()), pa.nulls(m, pa.int64()), part.column(0), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64())], names=names)
                if t:
                    yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(rest, pa.string()), pa.array(times, pa.int64()), pa.nulls(t, part.column(0).type), pa.nulls(t, pa.int64()), pa.nulls(t, pa.int64())], names=names)
                row += m

    met = docs.select(id_col, text_col).mapInArrow(run, f"row long, pretoken string, k long, id {kind}, n_bytes long, n_tokens long")
    if room >= 0:  # all pre-tokens are in the head
        out = met
    else:
        tail = priced.where(step < cut) if cut is not None else priced
        found = met.join(tail.select("pretoken", "pieces"), "pretoken", "left")
        out = found.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.coalesce("n_tokens", F.col("k") * F.col("pieces"))).alias("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
