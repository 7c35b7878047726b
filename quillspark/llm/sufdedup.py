"""Repeated-substring removal with two-stage suffix sorting.

A byte goes if it is covered by a `width`-byte string that also starts in a document with a smaller doc_id.

1. Packs: texts are written once in packs of about a megabyte; later steps move packs, not rows. A longer text is cut into
   segments that overlap by `width` - 1 bytes, so that every window lies in one of them.
2. Anchors: of the k-byte strings of every window the one with the smallest hash is its anchor (winnowing), so a window has
   the same anchor wherever it occurs. Every pack sends its anchors' codes, 4 bytes each, and learns which of them other packs
   hold too. This only rules out: an anchor that one document alone holds serves no repeated window.
3. The contexts of the other anchors (the bytes of the windows that each serves) go to blocks of anchors; bytes that a pack holds
   several times go once. Equal contexts are told by their bytes, never by a hash.
4. Suffix array of a block's distinct contexts: only suffixes smaller than their successors are sorted directly, the others are
   induced by one scan over the character buckets; adjacent common prefixes of `width` bytes or more tie equal windows together,
   and each learns the smallest document that holds it. This order decides every window that is removed.
5. Packs are met with the answers, and the bytes are removed.

A line that stands in many documents would send as many different contexts to one block: windows that hold a bit of what stands
around it. A sample of packs tells which k-byte strings are frequent; these rank behind all others as anchors, so such a window
is served by the rarer string at its edge. The sample only balances the load: any ranking gives the same result.

Defined cases: null text counts as empty; texts under `width` bytes keep everything; rows of one doc_id (repeated rows, ties) do
not remove each other; a null doc_id is smaller than all others; an empty table gives no rows; other columns are ignored. Memory
follows the pack (about 100 bytes a byte), not the text: a segmented text is put together one segment at a time.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import U64, SpanHash, materialize, mix64, slices, spread, utf8_column

WIDTH, K = 50, 20
#: Windows that an anchor can serve, and the longest context.
SERVED = WIDTH - K + 1
CONTEXT = WIDTH + SERVED - 1
#: Bytes of text in a pack, or of a segment's own.
PACK = 1 << 20
#: Bytes of text that one bucket of codes, and one block of contexts, answers for, about.
BUCKET_TEXT, BLOCK_TEXT = 16 << 20, 4 << 20
#: Packs in the sample for frequent strings, at least and at most; contexts in the whole corpus from which a string is frequent.
SAMPLE, FREQUENT = (16, 2048), 4096
MOST_FREQUENT = 1_000_000
NULL_ID = -(1 << 63)
PACKS = "pack long, home long, seg int, segs int, ids binary, lens binary, data binary"


def _pack(most: int):
    """Rows to packs of `most` bytes: whole rows share one (segs 0), or one long row has several, with one home."""

    def run(batches):
        import zstandard

        z, part, count = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = np.array([NULL_ID if v is None else v for v in b.column(0).to_pylist()], np.int64)
            data, offsets = utf8_column(b.column(1))
            for first, last in slices(offsets, most):
                lens = np.diff(offsets[first : last + 1])
                lo, hi = int(offsets[first]), int(offsets[last])
                segs = -(-(hi - lo) // most) if hi - lo > most else 0
                home = part << 32 | count
                for seg in range(max(1, segs)):
                    a = lo + seg * most
                    piece = data[a : min(hi, a + most + WIDTH - 1)] if segs else data[lo:hi]
                    sizes = np.array([len(piece)]) if segs else lens
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip((part << 32 | count, home, seg, segs, ids[first:last].tobytes(), sizes.astype(np.int64).tobytes(), z.compress(piece.tobytes())), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])],
                        ["pack", "home", "seg", "segs", "ids", "lens", "data"],
                    )
                    count += 1

    return run


class Texts:
    """A pack's texts."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes):
        import zstandard

        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])


class Anchors:
    """The anchors of a pack's windows: place, row, hash, and the bytes [low, high) of the windows that each serves."""

    def __init__(self, texts: Texts, frequent: np.ndarray):
        n = len(texts.text)
        self.texts = texts
        none = np.zeros(0, np.int64)
        self.pos, self.low, self.high, self.row, self.hash, self.every = none, none, none, none, np.zeros(0, U64), np.zeros(0, U64)
        if n < WIDTH:
            return
        row = np.repeat(np.arange(len(texts.lens), dtype=np.int32), texts.lens)
        span = SpanHash(texts.text)
        self.every = (span.prefix[K:] - span.prefix[:-K]) * span.inv[: n - K + 1]
        shift = U64(max(20, int(n).bit_length()))
        best = (_ranked(self.every, frequent) >> shift << shift) | np.arange(n - K + 1, dtype=U64)
        done = 1
        while done < SERVED:
            step = min(done, SERVED - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        window = np.flatnonzero(row[: n - WIDTH + 1] == row[WIDTH - 1 :])
        found = (best[window] & ((U64(1) << shift) - U64(1))).astype(np.int64)
        fresh = np.ones(len(found), bool)
        fresh[1:] = found[1:] != found[:-1]
        first = np.flatnonzero(fresh)
        self.pos, self.low = found[first], window[first]
        self.high = window[np.append(first[1:], len(found)) - 1] + WIDTH if len(first) else none
        self.row, self.hash = row[self.pos].astype(np.int64), self.every[self.pos]

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """The contexts of these anchors as byte strings of one length, their place and size at the end."""
        low, size = self.low[which], self.high[which] - self.low[which]
        out = np.zeros((len(which), CONTEXT + 2), np.uint8)
        for k in range(0, len(which), 1 << 14):
            a, s = low[k : k + (1 << 14), None], size[k : k + (1 << 14), None]
            at = np.arange(CONTEXT)
            out[k : k + (1 << 14), :CONTEXT] = np.where(at < s, self.texts.text[np.minimum(a + at, len(self.texts.text) - 1)], 0)
        out[:, CONTEXT] = self.pos[which] - low
        out[:, CONTEXT + 1] = size
        return out


def _ranked(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes in the order in which they become anchors: frequent strings last."""
    if not len(frequent):
        return hashes
    likely = np.zeros(1 << 16, bool)
    likely[frequent >> U64(48)] = True
    some = np.flatnonzero(likely[hashes >> U64(48)])
    out = hashes >> U64(1)
    at = np.minimum(np.searchsorted(frequent, hashes[some]), len(frequent) - 1)
    out[some[frequent[at] == hashes[some]]] |= U64(1 << 63)
    return out


class Codes:
    """The distinct codes of a pack's anchors in the order of their buckets, and which code each anchor has."""

    def __init__(self, anchors: Anchors, buckets: int):
        mixed = mix64(anchors.hash)
        bucket = ((mixed >> U64(32)) * U64(buckets)) >> U64(32)
        key = bucket << U64(32) | (mixed & U64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.code, self.bucket = key[first].astype(np.uint32), (key[first] >> U64(32)).astype(np.int64)
        #: Codes that two rows of the pack have: anchors are in the order of rows.
        row = anchors.row[order]
        self.shared = row[first] != row[np.append(first[1:], len(key)) - 1] if len(first) else np.zeros(0, bool)

    def parts(self):
        cut = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else []
        for lo, hi in zip(cut, [*cut[1:], len(self.bucket)]):
            yield int(self.bucket[lo]), slice(lo, hi)


def _texts(batches):
    for b in batches:
        for pack, ids, lens, data in zip(b.column(0), b.column(4), b.column(5), b.column(6)):
            yield pack.as_py(), Texts(ids.as_py(), lens.as_py(), data.as_py())


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)


def _tally(near):
    """(hash, n), n over 1: the different contexts of a pack's anchors; given `near`, the places of all strings around these."""

    def run(batches):
        for _, texts in _texts(batches):
            a = Anchors(texts, np.zeros(0, U64))
            if not len(a.pos):
                continue
            if near is None:
                wide = np.minimum(a.pos + K + SERVED, len(texts.text)) - np.maximum(a.pos - SERVED, 0)
                span = SpanHash(texts.text)
                around = span(np.maximum(a.pos - SERVED, 0), np.minimum(a.pos + K + SERVED, len(texts.text))) + wide.astype(U64)
                order = np.lexsort((around, a.hash))
                h, c = a.hash[order], around[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                found = h[fresh]
            else:
                at = a.pos[np.isin(a.hash, near)]
                at = np.unique((at[:, None] + np.arange(-SERVED, SERVED + 1)).ravel())
                found = a.every[at[(at >= 0) & (at < len(a.every))]]
            h, n = np.unique(found, return_counts=True)
            h, n = h[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def frequent_strings(packs: DataFrame, n_packs: int) -> np.ndarray:
    """Sorted hashes of the k-byte strings that a sample of packs shows in many contexts; at most MOST_FREQUENT, for balance alone."""
    wanted = min(SAMPLE[1], max(SAMPLE[0], n_packs // 1000))
    share = max(1, n_packs // wanted)
    sample = packs.filter(F.pmod(F.xxhash64("pack"), F.lit(share)) == 0)
    least = max(3, FREQUENT // share)

    def often(near):
        counts = sample.mapInArrow(_tally(near), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").collect()], np.int64).view(U64))

    first = often(None)
    return often(first) if len(first) else first


def _send(buckets: int, frequent):
    def run(batches):
        for pack, texts in _texts(batches):
            c = Codes(Anchors(texts, frequent.value), buckets)
            rows = [(bucket, pack, c.code[at].tobytes()) for bucket, at in c.parts()]
            if rows:
                yield _batch(rows, ["bucket", "pack", "codes"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _grouped(batches):
    """Rows sorted by their first column: (key, rows), one key at a time, over the bounds of batches."""
    key, rows = None, []
    for b in batches:
        for row in zip(*b.columns):
            row = tuple(x.as_py() for x in row)
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _meet_codes(batches):
    """A bucket's codes: for each pack a bit row of those that another pack has too."""
    for bucket, rows in _grouped(batches):
        codes = [np.frombuffer(r[2], np.uint32) for r in rows]
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        s = every[order]
        twin = np.zeros(len(s), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:]
        both = np.empty(len(s), bool)
        both[order] = twin
        at, out = 0, []
        for r, c in zip(rows, codes):
            mine = both[at : at + len(c)]
            at += len(c)
            if mine.any():
                out.append((r[1], bucket, np.packbits(mine).tobytes()))
        if out:
            yield _batch(out, ["pack", "bucket", "bits"], [pa.int64(), pa.int64(), pa.binary()])


def _contexts(buckets: int, blocks: int, frequent):
    """Packs with their buckets' answers: the distinct contexts of shared anchors, and every place where they stand, by block."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for pack, rows in _grouped(batches):
            if rows[0][1] != 1:
                raise RuntimeError("answers without their pack")
            texts = Texts(rows[0][3], rows[0][4], rows[0][5])
            a = Anchors(texts, frequent.value)
            c = Codes(a, buckets)
            asked, told = c.shared, {r[2]: r[3] for r in rows[1:]}
            for bucket, at in c.parts():
                if bucket in told:
                    asked[at] |= np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=at.stop - at.start).astype(bool)
            which = np.flatnonzero(asked[c.of]) if len(c.of) else np.zeros(0, np.int64)
            if not len(which):
                continue
            block = (((mix64(a.hash[which] + U64(1)) >> U64(32)) * U64(blocks)) >> U64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            which, block = which[order], block[order]
            whole = a.contexts(which)
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            out = []
            for lo, hi in zip(cut, [*cut[1:], len(which)]):
                distinct, of = _distinct(whole[lo:hi])
                ids = texts.ids[a.row[which[lo:hi]]]
                size = distinct[:, CONTEXT + 1]
                body = distinct[:, :CONTEXT][np.arange(CONTEXT) < size[:, None]]
                parts = (distinct[:, CONTEXT], size, of.astype(np.uint32), a.low[which[lo:hi]].astype(np.uint32), ids, body)
                out.append((int(block[lo]), pack, len(distinct), int(hi - lo), z.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))))
            yield _batch(out, ["block", "pack", "n", "places", "body"], [pa.int64()] * 4 + [pa.binary()])

    return run


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows by their bytes (the last of which is not 0), and which of them each row is."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    words = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    _, first, of = np.unique(words, return_index=True, return_inverse=True)
    return rows[first], of


def two_stage_suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text in the order of their first `depth` bytes at least; given `wanted`, these and what their order hangs on.

    Type B suffixes are smaller than their successors: only these are sorted directly. A scan of the order by character bucket
    then puts the predecessor of each suffix, if it is larger than it (type A), at the head of its bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    turn = np.where(differs, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = rises[turn]
    live = np.ones(n, bool)
    if wanted is not None:  # a larger suffix hangs on its successor, up to the next smaller one
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(wanted, at, -1))
        stop = np.concatenate([[-1], np.maximum.accumulate(np.where(small, at, -1))[:-1]])
        live = last > stop
    direct = np.flatnonzero(small & live)
    words = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))[direct]
    direct = direct[np.argsort(np.ascontiguousarray(words).view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    total = np.bincount(text[live], minlength=256)
    n_b = np.bincount(text[direct], minlength=256)
    start = np.concatenate([[0], np.cumsum(total)])[:256]
    head = start.copy()
    order = np.full(int(total.sum()), -1, np.int64)
    b_at = np.concatenate([[0], np.cumsum(n_b)])
    larger = live & ~small

    def induce(scanned):
        before = scanned[scanned > 0] - 1
        before = before[larger[before]]
        if len(before) == 0:
            return
        kinds = text[before]
        by = np.argsort(kinds, kind="stable")
        before, kinds = before[by], kinds[by]
        cut = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        for lo, hi in zip(cut, [*cut[1:], len(kinds)]):
            c = kinds[lo]
            order[head[c] : head[c] + hi - lo] = before[lo:hi]
            head[c] += hi - lo

    if live[n - 1]:
        order[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(total):
        at = start[c]
        while at < head[c]:
            upto = head[c]
            induce(order[at:upto])
            at = upto
        end = start[c] + total[c]
        order[end - n_b[c] : end] = direct[b_at[c] : b_at[c + 1]]
        induce(order[end - n_b[c] : end])
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, of the prefix that each suffix shares with the one before it in order (0 for the first)."""
    wide = -(-depth // 8) * 8
    rows = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(wide, np.uint8)]), (len(text) + 1, wide), (1, 1))
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 1 << 14):
        a = np.ascontiguousarray(rows[order[k - 1 : k + (1 << 14)]]).view("<u8")
        a, b = a[:-1], a[1:][: (1 << 14)]
        off = a[: len(b)] ^ b
        word = (off != 0).argmax(1)
        x = off[np.arange(len(b)), word]
        # the first differing byte of the first differing word; equal words tell no difference
        byte = np.bitwise_count((x & (~x + U64(1))) - U64(1)).astype(np.int64) // 8
        out[k : k + len(b)] = np.minimum(np.where(x == 0, depth, word * 8 + byte), depth)
    return out


def least_holders(contexts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window (column) of distinct contexts, each with its smallest document: the smallest document with that window."""
    size = contexts[:, CONTEXT + 1].astype(np.int64)
    text = contexts[:, :CONTEXT][np.arange(CONTEXT) < size[:, None]]
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    wanted = np.repeat(ends, size) - np.arange(len(text)) >= WIDTH
    order = two_stage_suffix_array(text, WIDTH, wanted)
    order = order[wanted[order]]
    least = np.full((len(size), SERVED), np.iinfo(np.int64).max)
    if len(order):
        cut = np.flatnonzero(common_prefixes(text, order, WIDTH) < WIDTH)
        who = of[order]
        least[who, order - (ends[who] - size[who])] = np.repeat(np.minimum.reduceat(doc[who], cut), np.diff(np.append(cut, len(order))))
    return least


def _sort_block(batches):
    """A block's contexts: for each place of each pack, which of its windows also start in a smaller document (bits)."""
    import zstandard

    z, out_z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for _, rows in _grouped(batches):
        packs, contexts, ids, of, done = [], [], [], [], 0
        for _, pack, n, places, body in rows:
            raw = z.decompress(body)
            left, size = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, np.uint8, n, n)
            at = 2 * n
            which, low = np.frombuffer(raw, np.uint32, places, at), np.frombuffer(raw, np.uint32, places, at + 4 * places)
            ids.append(np.frombuffer(raw, np.int64, places, at + 8 * places))
            whole = np.zeros((n, CONTEXT + 2), np.uint8)
            whole[:, :CONTEXT][np.arange(CONTEXT) < size[:, None]] = np.frombuffer(raw, np.uint8, offset=at + 16 * places)
            whole[:, CONTEXT], whole[:, CONTEXT + 1] = left, size
            contexts.append(whole)
            of.append(which.astype(np.int64) + done)
            done += n
            packs.append((pack, low))
        distinct, kind = _distinct(np.concatenate(contexts))
        of, ids = kind[np.concatenate(of)], np.concatenate(ids)
        doc = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(doc, of, ids)
        least = least_holders(distinct, doc)
        mask = np.zeros(len(of), np.uint32)
        bits = np.uint32(1) << np.arange(SERVED, dtype=np.uint32)
        for k in range(0, len(of), 1 << 14):
            mask[k : k + (1 << 14)] = ((least[of[k : k + (1 << 14)]] < ids[k : k + (1 << 14), None]) * bits).sum(1, dtype=np.uint32)
        at, out = 0, []
        for pack, low in packs:
            mine = mask[at : at + len(low)]
            at += len(low)
            hit = mine != 0
            if hit.any():
                out.append((pack, int(hit.sum()), out_z.compress(low[hit].tobytes() + mine[hit].tobytes())))
        if out:
            yield _batch(out, ["pack", "n", "mask"], [pa.int64(), pa.int64(), pa.binary()])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, end long>>"
_RESULT_KINDS = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_RESULT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


class Kept:
    """A document's result, put together from its bytes in order."""

    def __init__(self, doc: int):
        self.doc, self.n, self.spans, self.sha = doc, 0, [], hashlib.sha256()

    def add(self, text: np.ndarray, gone: np.ndarray) -> None:
        step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if self.spans and self.spans[-1][1] == self.n + a:
                self.spans[-1][1] = self.n + b
            else:
                self.spans.append([self.n + a, self.n + b])
        self.sha.update(text[~gone].tobytes())
        self.n += len(text)

    def row(self) -> tuple:
        return (None if self.doc == NULL_ID else self.doc, self.n, sum(b - a for a, b in self.spans), len(self.spans), self.sha.hexdigest(), [{"start": a, "end": b} for a, b in self.spans])


def _gone(texts: Texts, masks) -> np.ndarray:
    """Which bytes are covered by a window that goes."""
    import zstandard

    z, n = zstandard.ZstdDecompressor(), len(texts.text)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for count, body in masks:
        raw = z.decompress(body)
        low, mask = np.frombuffer(raw, np.uint32, count).astype(np.int64), np.frombuffer(raw, np.uint32, count, 4 * count)
        run = (mask & (mask + np.uint32(1))) == 0  # windows that follow one another from the first on
        starts.append(low[run])
        ends.append(low[run] + np.bitwise_count(mask[run]).astype(np.int64) + WIDTH - 1)
        low, mask = low[~run], mask[~run]
        for o in range(SERVED if len(low) else 0):
            at = low[(mask >> np.uint32(o) & np.uint32(1)).astype(bool)] + o
            starts.append(at)
            ends.append(at + WIDTH)
    change = np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def _remove(most: int):
    """Rows sorted by home, pack and role: each pack's own row, then its masks."""

    def run(batches):
        def packs():
            held = None
            for b in batches:
                for row in zip(*b.columns):
                    home, pack, role, seg, segs, n, one, two, three = (x.as_py() for x in row)
                    if role == 1:
                        if held:
                            yield held
                        held = (home, pack, seg, segs, Texts(one, two, three), [])
                    else:
                        if held is None or held[1] != pack:
                            raise RuntimeError("answers without their pack")
                        held[5].append((n, three))
            if held:
                yield held

        long, carry = None, np.zeros(0, bool)
        for _, _, seg, segs, texts, masks in packs():
            gone = _gone(texts, masks)
            if segs:
                if seg == 0:
                    long, carry = Kept(int(texts.ids[0])), np.zeros(0, bool)
                gone[: len(carry)] |= carry
                own = len(gone) if seg == segs - 1 else most
                long.add(texts.text[:own], gone[:own])
                carry = gone[own:]
                done = [long] if seg == segs - 1 else []
            else:
                done = []
                for k in range(len(texts.ids)):
                    a, b = texts.starts[k], texts.starts[k + 1]
                    done.append(Kept(int(texts.ids[k])))
                    done[-1].add(texts.text[a:b], gone[a:b])
            if done:
                yield _batch([d.row() for d in done], _RESULT_NAMES, _RESULT_KINDS)

    return run


def _release(spark) -> None:
    """Let go of plans whose results are written: Spark then removes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(spread(df.sparkSession), key).sortWithinPartitions(key, *order)


def _keys(spark, total: int, each: int) -> int:
    """Buckets or blocks for `total` bytes: of `each` bytes, but as many as there are partitions where the corpus is small."""
    return max(1, min(spread(spark), -(-total // PACK)), -(-total // each))


def repeated_spans(docs: DataFrame, pack: int = PACK) -> DataFrame:
    """docs(doc_id, text): per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed)."""
    spark = docs.sparkSession
    packs = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_pack(pack), PACKS), "packs")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frequent = spark.sparkContext.broadcast(frequent_strings(packs, packs.count()))  # 8 bytes each, MOST_FREQUENT at most
    buckets, blocks = _keys(spark, total, BUCKET_TEXT), _keys(spark, total, BLOCK_TEXT)
    codes = packs.mapInArrow(_send(buckets, frequent), "bucket long, pack long, codes binary")
    met = materialize(_dealt(codes, "bucket").mapInArrow(_meet_codes, "pack long, bucket long, bits binary"), "codes")
    _release(spark)
    none = F.lit(None).cast("binary")
    own = packs.select("pack", F.lit(1).alias("role"), F.lit(-1).cast("long").alias("bucket"), F.col("ids").alias("one"), F.col("lens").alias("two"), F.col("data").alias("three"))
    told = met.select("pack", F.lit(2).alias("role"), "bucket", F.col("bits").alias("one"), none.alias("two"), none.alias("three"))
    contexts = _dealt(own.unionByName(told), "pack", "role").mapInArrow(_contexts(buckets, blocks, frequent), "block long, pack long, n long, places long, body binary")
    masks = materialize(_dealt(contexts, "block").mapInArrow(_sort_block, "pack long, n long, mask binary"), "masks")
    _release(spark)
    home = packs.select("pack", "home").filter("pack <> home")
    masked = masks.join(home, "pack", "left").select(F.coalesce("home", "pack").alias("home"), "pack", F.lit(2).alias("role"), F.lit(-1).alias("seg"), F.lit(0).alias("segs"), "n", none.alias("one"), none.alias("two"), F.col("mask").alias("three"))
    whole = packs.select("home", "pack", F.lit(1).alias("role"), "seg", "segs", F.lit(0).cast("long").alias("n"), F.col("ids").alias("one"), F.col("lens").alias("two"), F.col("data").alias("three"))
    return _dealt(whole.unionByName(masked), "home", "pack", "role").mapInArrow(_remove(pack), RESULT)


def op1_sufdedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.drop("spans")
