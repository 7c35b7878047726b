"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over 7 bytes ends a chunk where it is congruent to -1 modulo the block size; each chunk gives one
signature character, at the block size and at twice it. Fingerprints are compared at equal or neighbouring block
sizes: twice the longest common subsequence over the lengths (an insert/delete edit distance turned into a
likeness), provided the signatures share a run of characters, else 0.

Defined cases: null text counts as empty, whose fingerprint is "3::"; two empty signatures are alike (1); equal texts
have equal fingerprints and likeness 1; very long texts use larger blocks, the whole text is always covered, and hashed in pieces.
`neighbours` orders by doc_id (null first), then by the text's xxhash64: ties and repeated rows follow one another, whatever the
partitions; an empty table gives no rows; a single row is its own neighbour. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import POLY, POLY_INV, U64, SpanHash, materialize, mix64, spread

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
LENGTH, WINDOW, LEAST, RUN = 64, 7, 3, 4
#: Bytes hashed at once.
PIECE = 1 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ENDS = [*_FIELDS, ("role", pa.string()), ("range", pa.int64()), ("text", pa.string())]


def _pieces(data: np.ndarray):
    """(start, sums, rolling hash) of each piece of the text."""
    n = len(data)
    for s in range(0, n, PIECE):
        local = SpanHash(data[s : s + PIECE + WINDOW - 1])
        at = np.arange(max(0, min(PIECE, n - s - WINDOW + 1)))
        yield s, local, mix64(local.raw(at, at + WINDOW)) >> U64(8)


class Chunks:
    """Where a text's chunks end at one block size: the first ends, all ends' number, and the sums that give chunk hashes."""

    def __init__(self, n: int, pieces, block: int, most: int):
        found, left, ends, sums, before = 0, most - 1, [], [], np.zeros(1, U64)
        for s, local, roll in pieces:
            cut = np.flatnonzero(roll % U64(block) == U64(block - 1)) + WINDOW
            found += len(cut)
            cut = cut[:left]
            left -= len(cut)
            power = np.array([pow(POLY, s, 1 << 64)], U64)
            ends.append(s + cut)
            sums.append(before + power * local.prefix[cut])
            before = before + power * local.prefix[min(PIECE, n - s)]
        ends, sums = np.concatenate(ends), np.concatenate(sums)
        if not len(ends) or ends[-1] != n:  # the last chunk takes all that is left
            ends, sums = np.append(ends, n), np.append(sums, before)
        self.found, self.ends, self.sums, self.inverse = found, ends, sums, local.inv if n <= PIECE else None

    def signature(self) -> str:
        """A character a chunk."""
        starts, before = np.append(0, self.ends[:-1]), np.append(U64(0), self.sums[:-1])
        inverse = self.inverse[starts] if self.inverse is not None else np.array([pow(POLY_INV, k, 1 << 64) for k in starts.tolist()], U64)
        hashes = mix64((self.sums - before) * inverse + (self.ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))
        return _LETTERS[(hashes >> U64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """block:signature:signature at twice the block."""
    n = len(data)
    if not n:
        return f"{LEAST}::"
    a = np.frombuffer(data, np.uint8)
    kept = list(_pieces(a)) if n <= PIECE else None
    chunks = lambda size, most: Chunks(n, kept or _pieces(a), size, most)
    block = LEAST
    while block * LENGTH < n:
        block *= 2
    while True:
        one = chunks(block, LENGTH)
        if one.found >= LENGTH // 2 or block == LEAST:
            break
        block //= 2
    return f"{block}:{one.signature()}:{chunks(2 * block, LENGTH // 2).signature()}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel row steps."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 at block sizes that cannot be compared."""
    if x == y:
        return 1.0
    (b, one, two), (c, three, four) = x.split(":"), y.split(":")
    b, c = int(b), int(c)
    if b == c:
        return max(_alike(one, three), _alike(two, four))
    if b == 2 * c:
        return _alike(one, four)
    return _alike(two, three) if c == 2 * b else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by as many first ones of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _result(doc_id, text: str, print_: str, next_text: str, next_print: str) -> tuple:
    new = edited(text, next_text).encode("utf-8", "surrogatepass")
    other = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), print_, other, likeness(print_, other), likeness(print_, next_print)


def _batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields, strict=True)], [n for n, _ in fields])


def _pairs(batches):
    """A range's rows in order: each with its successor; of the first and the last, the text is handed on for the ranges beside."""
    last, here = None, TaskContext.get().partitionId()
    for b in batches:
        out = []
        for doc_id, text in zip(b.column(0), b.column(1)):
            doc_id, text = doc_id.as_py(), text.as_py() or ""
            mark = fingerprint(text.encode("utf-8", "surrogatepass"))
            if last is None:
                out.append((doc_id, None, None, mark, None, None, None, "first", here, text))
            else:
                out.append((*_result(*last, text, mark), "done", here, None))
            last = (doc_id, text, mark)
        if out:
            yield _batch(out, _ENDS)
    if last is not None:
        yield _batch([(last[0], None, None, last[2], None, None, None, "last", here, last[1])], _ENDS)


def _close(batches):
    for b in batches:
        rows = [_result(*(x.as_py() for x in row)) for row in zip(*b.columns)]
        if rows:
            yield _batch(rows, _FIELDS)


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the tail replaced, and its likeness to that and to the next.

    One range shuffle of the texts, by doc_id and the text's hash. Rows that agree in both, which follow one another in any order, are
    told apart by their place in the input, so that a frequent one is split as well. The first row of each range joins the last one before.
    """
    n = spread(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("place"))
    dealt = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h", "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "place")
    found = materialize(dealt.select("doc_id", "text").mapInArrow(_pairs, f"{RESULT}, role string, range long, text string"), "fingerprint")
    ranges = found.filter("role = 'last'").select("range")  # a number a range
    after = ranges.select(F.col("range").alias("_range"), F.lead("range").over(Window.orderBy("range")).alias("_next"), F.min("range").over(Window.orderBy("range")).alias("_first"))
    tails = found.filter("role = 'last'").select("range", "doc_id", "text", "fingerprint").join(F.broadcast(after), F.col("range") == F.col("_range"))
    heads = found.filter("role = 'first'").select(F.col("range").alias("_head"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    joined = tails.join(heads, F.coalesce("_next", "_first") == F.col("_head")).select("doc_id", "text", "fingerprint", "next_text", "next_print")
    return found.filter("role = 'done'").drop("role", "range", "text").unionByName(joined.mapInArrow(_close, RESULT))


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
