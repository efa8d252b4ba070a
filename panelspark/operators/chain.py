"""Artifacts that are made of each other, sealed level by level and checked again from the lowest one up.

A level's own digest is one of its rows as a bag: it doesn't depend on their order or partitioning, and repeated rows count.
Its seal joins the seal below to its kind and its own digest, so a recorded seal vouches for all levels up to it. Rows are
digested where they lie and summed before the shuffle; a chain has as many rows as kinds of artifacts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import first_code

STEPS = (1, 16, 31, 46)  # where the four parts of a row's hash begin, of fifteen hex digits each


def row_text(*fields: Column) -> Column:
    """A row as text: each field with its length before it, so that no two rows read alike; nulls are a mark of their own."""
    shown = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown])


def bag_digest(text: Column) -> Column:
    """An aggregate: the digest of a bag of texts, from their number and the sums of their hashes' parts."""
    digest = F.sha2(text, 256)
    sums = [F.coalesce(F.sum(F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in STEPS]
    return F.sha2(F.concat_ws("|", F.count(text).cast("string"), *sums), 256)


def level(kind: str, number: int, rows: DataFrame, **texts: Column) -> DataFrame:
    """One row: level, kind and a bag digest for each named text of the rows."""
    return rows.agg(*[bag_digest(text).alias(name) for name, text in texts.items()]).select(F.lit(number).alias("level"), F.lit(kind).alias("kind"), *texts)


def _link(below: Column | None, kind: str, own: Column) -> Column:
    return F.sha2(F.concat(below if below is not None else F.lit(""), F.lit(f"|{kind}|"), own), 256)


def _by_level(digests: DataFrame, kinds: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """One row a chain: columns c_i for each column c and level i."""
    return digests.groupBy(*keys).agg(*[F.max(F.when(F.col("level") == i, F.col(c))).alias(f"{c}_{i}") for c in columns for i in range(len(kinds))])


def _levels(chains: DataFrame, kinds: list[str], keys: list[str], *each: list[tuple[str, Column]]) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("level"), F.lit(kind).alias("kind"), *[c.alias(n) for n, c in row]) for i, (kind, row) in enumerate(zip(kinds, each, strict=True))]
    return chains.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def seal(digests: DataFrame, kinds: list[str], keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, level, kind, own, seal (and carried columns) of each chain: rows of (keys, level, own), levels from 0 on.

    A level without a row has a null seal, as have all above it.
    """
    chains = _by_level(digests, kinds, keys, ["own", *carry])
    seals: list[Column] = []
    for i, kind in enumerate(kinds):
        seals.append(_link(seals[-1] if seals else None, kind, F.col(f"own_{i}")))
    return _levels(chains, kinds, keys, *[[("own", F.col(f"own_{i}")), ("seal", seals[i]), *((c, F.col(f"{c}_{i}")) for c in carry)] for i in range(len(kinds))])


def revalidate(digests: DataFrame, kinds: list[str], keys: list[str]) -> DataFrame:
    """keys, level, kind, status, first_edited, seal: rows of (keys, level, seal as recorded, found: the digest of the rows as they are).

    'edited': the rows, or the record, don't give the recorded seal over the one below, or something of it is missing;
    'rests-on-edited': they do, but a level below doesn't; else 'whole'. first_edited is the lowest edited kind, null if
    all are whole.
    """
    chains = _by_level(digests, kinds, keys, ["seal", "found"])
    intact = [F.coalesce(_link(F.col(f"seal_{i - 1}") if i else None, kind, F.col(f"found_{i}")) == F.col(f"seal_{i}"), F.lit(False)) for i, kind in enumerate(kinds)]
    chains = chains.select("*", *[ok.alias(f"ok_{i}") for i, ok in enumerate(intact)])
    first = first_code(*[(kind, ~F.col(f"ok_{i}")) for i, kind in enumerate(kinds)])
    below = lambda i: reduce(lambda a, b: a & b, [F.col(f"ok_{j}") for j in range(i)], F.lit(True))
    status = lambda i: F.when(~F.col(f"ok_{i}"), "edited").when(~below(i), "rests-on-edited").otherwise("whole")
    return _levels(chains, kinds, keys, *[[("status", status(i)), ("first_edited", first), ("seal", F.col(f"seal_{i}"))] for i in range(len(kinds))])


def union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)
