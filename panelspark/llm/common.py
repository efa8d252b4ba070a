"""What the corpus operators share: table access, worker imports, working storage, hashing and Arrow output."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])

#: What counts as white space in the corpus contracts: space and the five ASCII controls of [\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it (a no-op where it is installed)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may go without, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hand_out(spark: SparkSession, content: bytes, kind: str) -> str:
    """A file of the shared folder that each executor gets a copy of, under the name that is returned (SparkFiles.get finds it)."""
    name = f"{kind}-{uuid.uuid4().hex}.bin"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(content), 1 << 20):
        out.write(bytearray(content[at : at + (1 << 20)]))
    out.close()
    sc.addFile(path.toString())
    return name


def slices(batch: pa.RecordBatch, text: int, rows: int = 1024, size: int = 4_000_000):
    """Parts of a batch with at most so many rows and, but for single rows, so many bytes in the column of texts."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = upto[at] - lengths[at]
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def runs(texts: list[bytes], size: int = 250_000):
    """Texts in order, in lists of at most so many bytes in all, but for single texts."""
    run, total = [], 0
    for t in texts:
        if run and total + len(t) > size:
            yield run
            run, total = [], 0
        run.append(t)
        total += len(t)
    if run:
        yield run


def store(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder, which is smaller than what keep() writes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(kept: DataFrame) -> None:
    """Delete the files of a table that keep() wrote, once nothing reads it any more."""
    sc = kept.sparkSession.sparkContext
    file = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def crc_of(column: Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(column.cast("string").cast("binary"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: pa.RecordBatch | pa.Table, schema: pa.Schema):
    """Arrow batches of a table in a declared schema."""
    yield from pa.Table.from_batches([rows] if isinstance(rows, pa.RecordBatch) else rows.to_batches(), schema).to_batches()


# --- 64-bit hashing of byte ranges, vectorised -----------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (wraps silently)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _ODD)


_BYTE = seeds64(256, 17)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POW:
        _POW.clear()
        base = 0x5851F42D4C957F2D | 1
        up = np.ones(size, np.uint64)
        up[1:] = np.uint64(base)
        down = np.ones(size, np.uint64)
        down[1:] = np.uint64(pow(base, -1, 1 << 64))
        _POW[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POW[size]
    return up[:n], down[:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that aren't ASCII white space, A-Z lower-cased) of the texts in order, and how many each has."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    word = _IS_WORD[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(start, ends)
    return range_hashes(data, start, end), np.diff(upto, prepend=0)


#: Lower-cased words of a text as the corpus contracts read them.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_AZ = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(_AZ))
