"""What several of these operators share: scratch tables, batches of texts and word hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all word rules here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


class Scratch:
    """Tables in the folder that driver and executors share.

    A saved table cuts lineage and survives lost executors.  The folder is
    ``spark.checkpoint.dir``.  Only a local master, as in tests, may leave that
    unset and gets a temporary one; on a cluster a machine-local folder would
    be unreadable to others, so there it is an error.  What was saved goes when
    the driver's process ends; tables that no later plan reads are dropped
    before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = _local_root()
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop, "")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove saved tables that no later plan reads; "" stands for all of them."""
        if self.spark.sparkContext._jsc is None:  # the session has ended
            return
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def free(columns: list[str], *names: str) -> list[str]:
    """The names with as many _ behind them as keep them apart from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, column: str = "text", chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than ``rows`` rows or, but for a single long text, ``chars`` bytes of ``column``."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or held + n > chars):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.

    Hashes of all words come from one running sum over the bytes, so the work
    is linear in the text whatever its length.
    """
    raw = text.encode("utf-8", "surrogatepass").lower()
    if not raw:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[data].astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out += words[j : n - k + 1 + j] * _ODD[j]
        return mix(out + np.uint64(k))
