"""Versions of paged documents: pages(doc_id, page_no, text), compared page by page."""

from __future__ import annotations

import bisect
import difflib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import no_space, strip

BLANK = 20
#: Runs of so many characters are looked for first; rectangles that have at most AREA together are left to difflib.
GRAM, AREA = 4, 1 << 11
#: Pairs of equal grams that a box may have, and pairs for each of its characters; characters of pages that are compared at a time.
RUNS, DENSE, CHARS = 1 << 20, 8, 1 << 17
#: Blocks that are taken one by one in a box, before or behind another; then all of a length are taken at once.
DEEP = 64


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages with fewer than 20 characters: likely scans."""
    return pages.filter(F.char_length(strip(F.col("text"))) < BLANK).select("doc_id", "page_no")


def _joined(x: np.ndarray, y: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers under 2^31 in place of those under `many`, equal for equal ones; how many."""
    if many < 1 << 31:
        return x, y, many
    every, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    return code[: len(x)], code[len(x) :], len(every)


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each low on, as many as its size."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


class _Texts:
    """Texts one after another, old (a) and new (b), with numbers for their grams: equal numbers are equal grams."""

    def __init__(self, xs: list[str], ys: list[str]):
        self.xs, self.ys = "".join(xs), "".join(ys)
        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (self.xs, self.ys))
        every = np.zeros(max(a.max(initial=0), b.max(initial=0)) + 1, np.int64)
        every[a] = every[b] = 1
        number = np.cumsum(every) - 1
        self.of = {1: (number[a], number[b], int(every.sum()))}

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For n a power of two, numbers under 2^31 of the grams of n characters that begin at each place, and a bound of them."""
        if n not in self.of:
            x, y, many = self.grams(n // 2)
            self.of[n] = _joined(*(t[: max(0, len(t) - n // 2)] * many + t[n // 2 :] for t in (x, y)), many * many)
        return self.of[n]

    def places(self, boxes: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where grams of n begin within the boxes, in a and in b: places, the boxes' numbers, and numbers that equal grams of a box share."""
        half = 1 << n.bit_length() - 1
        *numbers, many = self.grams(half)
        out = []
        for number, low, high in zip(numbers, boxes[:4:2], boxes[1:4:2]):
            size = np.maximum(high - low - n + 1, 0)
            at = _spread(low, size)
            out.append((at, np.repeat(np.arange(boxes.shape[1]), size), number[at] if n == half else number[at] * many + number[at + n - half]))
        x, y, many = _joined(out[0][2], out[1][2], many if n == half else many * many)
        return [(at, box, box * many + code) for (at, box, _), code in zip(out, (x, y))]


def _blocks(boxes: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray, gram: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Takes the longest block of each box, then of what is before and behind it, as long as it has `gram` characters.

    i, j: all pairs of equal grams in the boxes; owner: the box of each place of a; found: counts the blocks' characters by page. Gives the
    boxes left without a pair, those left after DEEP rounds, and the length of the longest block of each of the latter.
    """
    left, wide = [], len(owner) + 1
    key = np.sort((j - i + wide) * wide + i)
    i = key % wide
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1] + 1) | (owner[i[1:]] != owner[i[:-1]]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key))) + gram - 1
    j, i = key[first] // wide - wide + i[first], i[first]
    box = owner[i]
    for rounds in itertools.count():
        alo, ahi, blo, bhi, page = boxes
        skip = np.maximum(np.maximum(alo[box] - i, blo[box] - j), 0)
        i, j = i + skip, j + skip
        size = np.minimum(np.minimum(size - skip, ahi[box] - i), bhi[box] - j)
        kept = size >= gram
        i, j, size, box = i[kept], j[kept], size[kept], box[kept]
        longest = np.zeros(len(alo), np.int64)
        np.maximum.at(longest, box, size)
        some = longest > 0
        left.append(boxes[:, ~some])
        if not len(i) or rounds == DEEP:
            return np.concatenate(left, axis=1), boxes[:, some], longest[some]
        best = np.flatnonzero(size == longest[box])
        at = np.full(len(alo), np.iinfo(np.int64).max)
        np.minimum.at(at, box[best], i[best] - alo[box[best]] << 31 | j[best] - blo[box[best]])
        p, q = alo + (at >> 31), blo + (at & (1 << 31) - 1)
        end, stop = p + longest, q + longest
        np.add.at(found, page[some], longest[some])
        new = np.cumsum(some) - 1
        before, behind = (i < p[box]) & (j < q[box]), (i + size > end[box]) & (j + size > stop[box])  # no run is both: it would be longer
        boxes = np.concatenate([np.stack([alo, p, blo, q, page])[:, some], np.stack([end, ahi, stop, bhi, page])[:, some]], axis=1)
        box = new[box] + behind * some.sum()
        kept = before | behind
        i, j, size, box = i[kept], j[kept], size[kept], box[kept]


def _longest(texts: _Texts, box: np.ndarray, low: int, high: int) -> int:
    """The length of the longest block of one box that has runs of `low` but none of `high` characters."""
    while high - low > 1:
        middle = (low + high) // 2
        (_, _, x), (_, _, y) = texts.places(box, middle)
        low, high = (middle, high) if np.isin(x, y).any() else (low, middle)
    return low


def _sweep(texts: _Texts, box: np.ndarray, size: int, found: np.ndarray) -> np.ndarray:
    """Takes all blocks of one box that have the longest length, in one pass; gives the boxes left."""
    (at, _, x), (to, _, y) = texts.places(box, size)
    order = np.argsort(y, kind="stable")
    y, to = y[order], to[order].tolist()
    some = np.isin(x, y)
    at, x = at[some], x[some]
    begin, end = (np.searchsorted(y, x, side).tolist() for side in ("left", "right"))
    left, (a, ahi, b, bhi, page) = [], box[:, 0].tolist()
    for i, k, most in zip(at.tolist(), begin, end):
        if i < a or (k := bisect.bisect_left(to, b, k, most)) == most:
            continue
        left.append((a, i, b, to[k], page))
        a, b = i + size, to[k] + size
        found[page] += size
    return np.array([*left, (a, ahi, b, bhi, page)]).T


def matched(xs: list[str], ys: list[str]) -> np.ndarray:
    """How many characters difflib's longest matching blocks hold (without junk), for each pair of texts; all pairs are taken at once.

    A box is a part of an old and of a new text that is still to be compared. Runs of GRAM characters are found by joining grams, and what
    has none of them, by characters. Where the pairs of equal grams in a box are too many, longer grams are taken first; where those
    have no pair at all, or blocks follow one another in a long row, the box's longest length is settled by one pass over it.
    """
    found, texts = np.zeros(len(xs), np.int64), _Texts(xs, ys)
    ends = [np.append(0, np.cumsum([len(t) for t in side])) for side in (xs, ys)]
    owner = np.zeros(len(texts.xs), np.int64)
    todo = [(GRAM, 0, np.stack([ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:], np.arange(len(xs))]))]
    while todo:
        gram, low, boxes = todo.pop()  # low: the box has too many pairs of grams of this length
        boxes = boxes[:, (boxes[0] < boxes[1]) & (boxes[2] < boxes[3])]
        if ((boxes[1] - boxes[0]) * (boxes[3] - boxes[2])).sum() <= AREA:
            for alo, ahi, blo, bhi, page in boxes.T.tolist():
                found[page] += sum(m.size for m in difflib.SequenceMatcher(None, texts.xs[alo:ahi], texts.ys[blo:bhi], autojunk=False).get_matching_blocks())
            continue
        (at, box, x), (to, _, y) = texts.places(boxes, gram)
        order = np.argsort(y, kind="stable")
        y, to = y[order], to[order]
        begin = np.searchsorted(y, x, "left")
        size = np.searchsorted(y, x, "right") - begin
        pairs = np.bincount(box, size, boxes.shape[1]).astype(np.int64)
        if low and not pairs.any():
            todo.append((GRAM, 0, _sweep(texts, boxes, _longest(texts, boxes, low, gram), found)))
            continue
        fits = pairs <= np.minimum(RUNS, AREA + DENSE * (boxes[1] - boxes[0] + boxes[3] - boxes[2]))
        todo += [(4 * gram, gram, boxes[:, k : k + 1]) for k in np.flatnonzero(~fits)]
        part = np.where(fits, (np.cumsum(pairs * fits) - pairs * fits) // RUNS, -1)
        for k in np.unique(part[fits]):
            mine = np.flatnonzero(part == k)
            number = np.full(boxes.shape[1], -1)
            number[mine] = np.arange(len(mine))
            held = np.flatnonzero((number[box] >= 0) & (size > 0))
            owner[at[held]] = number[box[held]]
            left, deep, longest = _blocks(boxes[:, mine], owner, np.repeat(at[held], size[held]), to[_spread(begin[held], size[held])], gram, found)
            if gram > 1:
                todo.append((GRAM if gram > GRAM else 1, 0, left))
            if deep.size:
                todo.append((GRAM, 0, np.concatenate([_sweep(texts, deep[:, k : k + 1], size, found) for k, size in enumerate(longest.tolist())], axis=1)))
    return found


def matching(x: str, y: str) -> int:
    """How many characters difflib's longest matching blocks hold (without junk)."""
    return int(matched([x], [y])[0])


def _ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """of each pair of texts, by groups of about CHARS characters."""
    out, group = np.zeros(len(xs)), (np.cumsum([len(x) + len(y) for x, y in zip(xs, ys)]) // CHARS).tolist()
    begin = 0
    for end in range(1, len(xs) + 1):
        if end == len(xs) or group[end] != group[begin]:
            a, b = xs[begin:end], ys[begin:end]
            both = np.array([len(x) + len(y) for x, y in zip(a, b)])
            out[begin:end] = np.where(both, 2.0 * matched(a, b) / np.maximum(both, 1), 1.0)
            begin = end
    return out


def similarity_udf(junk: bool = False):
    """F6 (F7 with junk): longest-matching-block ratio; both empty 1, one empty 0."""

    def one(x, y):
        if not x or not y:
            return 1.0 if not x and not y else 0.0
        return difflib.SequenceMatcher(None, x, y, autojunk=True).ratio()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        if junk:
            return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)
        return pd.Series(_ratios([x or "" for x in a], [y or "" for y in b]), dtype=float)

    return ratio


def compare_pages(old: DataFrame, new: DataFrame, threshold: float = 0.95, exact: bool = False) -> DataFrame:
    """(doc_id, page_no, status, ratio): same, changed, added or deleted; white space does not count.

    exact: equal or not, without ratios. Else equal pages skip the comparison: the join is made once, and they are nulls to the function.
    """
    a = old.select("doc_id", "page_no", no_space(F.col("text")).alias("a"))
    b = new.select("doc_id", "page_no", no_space(F.col("text")).alias("b"))
    p = a.join(b, ["doc_id", "page_no"], "full_outer")
    one_sided = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted")
    if exact:
        return p.select("doc_id", "page_no", one_sided.when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))
    differ = F.col("a") != F.col("b")
    ratio = F.when(differ, similarity_udf()(F.when(differ, F.col("a")), F.when(differ, F.col("b")))).when(F.col("a") == F.col("b"), 1.0)
    status = one_sided.when(F.col("ratio") < threshold, "changed").otherwise("same")
    return p.withColumn("ratio", ratio).select("doc_id", "page_no", status.alias("status"), "ratio")


def blank_in_both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages without text in either version."""
    blank = lambda d: d.filter(F.char_length(no_space(F.col("text"))) < BLANK).select("doc_id", "page_no")
    return blank(old).intersect(blank(new))


def changed_lists(compared: DataFrame) -> DataFrame:
    """(doc_id, pages): changed and added or deleted pages, ascending."""
    c = compared.filter("status <> 'same'").groupBy("doc_id").agg(F.array_sort(F.collect_list("page_no")).alias("p"))
    return c.select("doc_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"))
