"""What the corpus operators share: the shared work folder, written intermediates, vectorised byte hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.storage import discard, materialize, small, work_dir  # noqa: F401

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
POLY = 0x9E3779B97F4A7C15
POLY_INV = pow(POLY, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for a wide shuffle: the session's own number, which is sized to the input by whoever submits."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, mod: int):
    """crc32 of doc_id as text, modulo mod: the contract's held-out rule. A null doc_id counts as empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


#: Keys with more rows than this, and than a thousandth of all rows, are joined by broadcast: there are a thousand at most.
FREQUENT_ROWS = 2000


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """left joined with right, a row a key, on `key`; right's column _n says how many of about `rows` rows of left have the key.

    Frequent keys, of which there are few, are broadcast, so that no task gets all rows of one; the others are shuffled.
    """
    most = max(FREQUENT_ROWS, rows // 1000)
    frequent = F.broadcast(right.filter(F.col("_n") > most).drop("_n"))
    keys = [key] if isinstance(key, str) else key
    rest = left.join(F.broadcast(right.filter(F.col("_n") > most).select(*keys)), keys, "left_anti")
    return left.join(frequent, keys).unionByName(rest.join(right.filter(F.col("_n") <= most).drop("_n"), keys))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64: multiply and xor-shift, twice."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: A fixed random value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", POLY), ("i", POLY_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


class SpanHash:
    """64-bit hashes of any spans of a byte array, each in constant time."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUE):
        p, self.inv = _power_table(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(values[data] * p[: len(data)], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inv[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, end) + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def utf8_column(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa

    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        array = array.cast(pa.large_binary())
    elif not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Consecutive row ranges of at most `most` bytes each (one row at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
