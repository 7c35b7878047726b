"""Comparison units, exact n-gram similarity joins, keyword coverage, and the duplicate check of drafts against notes.

The join never pairs all units: a pair at Jaccard similarity t or more shares ceil(t |A|) grams or more of the draft's unit A, so
of the |A| - ceil(t |A|) + k rarest (one global order) it shares k, and its sizes differ by a factor t at most. Units
meet by an equi-join on those grams, are counted, and the pairs with k hits are confirmed on the full gram sets.

Where the drafts' grams take few bytes (they are counted), they travel to the notes instead, as an inverted index: each
note unit's grams add up their postings, which gives the exact intersection with every draft unit at once, and no gram is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import GRAM_PUNCTUATION, STOP_WORDS, let, no_space, plain_md, shingles, strip_md, valid_keyword
from quillspark.operators.lines import body_of, headings, headings_of
from quillspark.operators.markup import fuzzy_stems
from quillspark.storage import materialize, small

MIN_LEN, WIN, STEP = 20, 70, 35
#: Grams of draft units that are sent to the notes as an index, about 40 bytes each; more are joined by shuffle.
INDEX_GRAMS = 1_000_000
#: Pairs of units, and shared grams of them, that one text's units are compared by at a time.
PAIRS = 1 << 20
_stop = frozenset(STOP_WORDS)
_punctuation = str.maketrans("", "", GRAM_PUNCTUATION)
_IS_PUNCTUATION = np.zeros(0x110000, bool)
_IS_PUNCTUATION[[ord(c) for c in GRAM_PUNCTUATION]] = True
_PARTS, _NO_WORD = re.compile("(?<=[。！？；])|\n{2,}"), re.compile("[^\u4e00-\u9fffA-Za-z0-9]+")
_NOISE = re.compile(r"(?:[0-9]+|[A-Za-z]{1,2}|[0-9]{2,4}[PpKk]|(?i:cc|bilibili|subtitle|clippings))\Z")


def unit_array(clean: Column) -> Column:
    """Comparison units of cleaned text; long parts in windows, the tail window always appended."""
    parts = F.filter(F.transform(F.split(clean, "(?<=[。！？；])|\n{2,}"), no_space), lambda p: F.char_length(p) >= MIN_LEN)

    def windows(x):  # of characters, so that a window is found without walking the part
        n = F.size(x)
        piece = lambda i: F.array_join(F.slice(x, i + 1, F.lit(WIN)), "")
        return F.concat(F.transform(F.sequence(F.lit(0), F.greatest(n - WIN, F.lit(0)), F.lit(STEP)), piece), F.array(piece(n - WIN)))

    return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= 105, F.array(p)).otherwise(let(F.split(p, ""), windows))))


def units_of(docs: DataFrame, key: str) -> DataFrame:
    """docs(key, text) -> (key, unit_no, u); units repeat as the windows do."""
    return docs.select(key, F.posexplode(unit_array(strip_md(F.col("text")))).alias("unit_no", "u"))


def similar_units(drafts: DataFrame, notes: DataFrame, threshold: float = 0.55, pairs: DataFrame | None = None) -> DataFrame:
    """Units (d, unit_no, u) against units (n, u): per draft unit and n the best match: both, either, matched unit.

    pairs(d, n): only these meet. For thresholds of 0 or less every unit counts as similar: see check_drafts.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: below it every unit is similar")
    a = materialize(drafts.select("d", "unit_no", "u").withColumn("g", shingles(F.col("u"))).withColumn("na", F.size("g")).filter("na > 0"), "units")
    if pairs is None and (a.agg(F.sum("na")).first()[0] or 0) <= INDEX_GRAMS:
        return _probe(a, notes, threshold)
    b = notes.select("n", "u").distinct()
    vocabulary = small(a.select(F.explode("g").alias("gram")).distinct())
    b = b.withColumn("g", shingles(F.col("u"))).withColumn("nb", F.size("g"))
    counts = b.select(F.explode("g").alias("gram")).join(vocabulary, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("c"))
    counts = materialize(counts, "grams")
    ranked = a.select("d", "unit_no", "na", F.explode("g").alias("gram")).join(small(counts), "gram", "left").na.fill(0, ["c"])
    rare = Window.partitionBy("d", "unit_no").orderBy("c", "gram")
    need = F.ceil(F.col("na") / 6)
    prefix = ranked.withColumn("r", F.row_number().over(rare)).filter(F.col("r") <= F.col("na") - F.ceil(F.col("na") * F.lit(threshold) - F.lit(1e-9)) + need)
    # a gram that no note unit holds needs no place in the join
    prefix = small(materialize(prefix.filter("c > 0").select("d", "unit_no", "na", "gram"), "prefix"))
    on = ["gram"] if pairs is None else ["n", "gram"]
    if pairs is not None:
        prefix = prefix.join(pairs, "d")
    full = small(a.select("d", "unit_no", F.col("g").alias("ga")))
    hits = b.select("n", "u", "nb", F.explode("g").alias("gram")).join(prefix, on)
    hits = hits.filter((F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("nb") * threshold <= F.col("na") + 1e-9)).groupBy("d", "unit_no", "n", "u", "na").agg(F.count("*").alias("hits"))
    hits = hits.filter(F.col("hits") >= need)
    found = hits.join(full, ["d", "unit_no"]).withColumn("gb", shingles(F.col("u")))
    found = found.withColumn("both", F.size(F.array_intersect("ga", "gb")).cast("long")).withColumn("either", F.col("na") + F.size("gb") - F.col("both"))
    found = found.filter(F.col("both") >= F.col("either") * threshold - 1e-12)
    best = found.groupBy("d", "unit_no", "n").agg(F.max(F.struct((F.col("both") / F.col("either")).alias("r"), "both", "either", "u")).alias("m"))
    return best.select("d", "unit_no", "n", F.col("m.both").alias("both"), F.col("m.either").alias("either"), F.col("m.u").alias("matched"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class GramIndex:
    """Draft units by their 4-grams: postings in one array, and how many grams each unit has."""

    def __init__(self, units: list[str]):
        sets = [self.grams(u) for u in units]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.units = of[order]
        self.keys, self.start = np.unique(every[order], return_index=True)
        self.stop = np.append(self.start[1:], len(every))

    @staticmethod
    def grams(u: str) -> np.ndarray:
        """Distinct 4-grams as numbers, 21 bits a character, two words mixed; a shorter text is its own."""
        c = _codes(u.translate(_punctuation))
        n = len(c)
        if n < 4:
            c = np.concatenate([c, np.full(4 - n, 0x1FFFFF, np.uint64)]) if n else c
            n = len(c)
        if not n:
            return np.zeros(0, np.uint64)
        low, high = c[: n - 3] << np.uint64(42) | c[1 : n - 2] << np.uint64(21) | c[2 : n - 1], c[3:]
        return np.unique(low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))

    def matches(self, u: str, threshold: float) -> list[tuple[int, int, int]]:
        """(unit, both, either) of the units whose similarity with u reaches the threshold."""
        g = self.grams(u)
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        at = at[self.keys[at] == g]
        if not len(at):
            return []
        begin, size = self.start[at], self.stop[at] - self.start[at]
        places = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(self.units[places], minlength=len(self.sizes))
        either = self.sizes + len(g) - both
        hit = np.flatnonzero((both > 0) & (both >= either * threshold - 1e-12))
        return [(int(k), int(both[k]), int(either[k])) for k in hit]


def _probe(a: DataFrame, notes: DataFrame, threshold: float) -> DataFrame:
    """similar_units with the draft units (d, unit_no, u), which are few, on every task."""
    rows = a.select("d", "unit_no", "u").toArrow()
    held = a.sparkSession.sparkContext.broadcast((GramIndex(rows.column(2).to_pylist()) if rows.num_rows else None, rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    d, n = (f.schema[c].dataType.simpleString() for f, c in ((a, "d"), (notes, "n")))
    d_kind = rows.schema.field(0).type

    def run(batches):
        index, ids, numbers = held.value
        for b in batches:
            out = [(ids[k], numbers[k], i, both, either, u) for i, u in enumerate(b.column(1).to_pylist()) if index for k, both, either in index.matches(u, threshold)]
            if out:
                di, no, i, both, either, u = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(di, d_kind), pa.array(no, pa.int32()), b.column(0).take(pa.array(i, pa.int64())), pa.array(both, pa.int64()), pa.array(either, pa.int64()), pa.array(u, pa.string())], ["d", "unit_no", "n", "both", "either", "u"])

    found = notes.select("n", "u").mapInArrow(run, f"d {d}, unit_no int, n {n}, both long, either long, u string")
    best = found.groupBy("d", "unit_no", "n").agg(F.max(F.struct((F.col("both") / F.col("either")).alias("r"), "both", "either", "u")).alias("m"))
    return best.select("d", "unit_no", "n", F.col("m.both").alias("both"), F.col("m.either").alias("either"), F.col("m.u").alias("matched"))


def _units(clean: str) -> dict[str, int]:
    """P8 for one text: its units, and how often each occurs."""
    out: dict[str, int] = {}
    for part in _PARTS.split(clean):
        p = "".join(part.split())
        n = len(p)
        if n >= MIN_LEN:
            for u in [p] if n <= 105 else [*(p[i : i + WIN] for i in range(0, n - WIN + 1, STEP)), p[n - WIN :]]:
                out[u] = out.get(u, 0) + 1
    return out


def _postings(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 4-grams of each unit: (gram, unit), sorted by gram, and how many each unit has. Grams as in GramIndex."""
    c, of = _codes("".join(units)), np.repeat(np.arange(len(units)), [len(u) for u in units])
    keep = ~_IS_PUNCTUATION[c]
    c, of = c[keep], of[keep]
    n = max(len(c) - 3, 0)
    low, high = c[:n] << np.uint64(42) | c[1 : n + 1] << np.uint64(21) | c[2 : n + 2], c[3:]
    grams = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = of[:n] == of[3:]
    grams, of_gram = grams[whole], of[:n][whole]
    length = np.bincount(of, minlength=len(units))
    for k in np.flatnonzero((length > 0) & (length < 4)):
        grams, of_gram = np.append(grams, GramIndex.grams(units[k])), np.append(of_gram, k)
    order = np.argsort(grams, kind="stable")  # by unit among equal grams
    grams, of_gram = grams[order], of_gram[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (of_gram[1:] != of_gram[:-1]))
        grams, of_gram = grams[new], of_gram[new]
    return grams, of_gram, np.bincount(of_gram, minlength=len(units))


def similar_count(ours: dict[str, int], theirs: dict[str, int], threshold: float) -> int:
    """How many of our units are similar to one of theirs; all units of a text meet at once, in blocks of bounded size.

    A unit needs ceil(threshold * its grams) or more of them in the other text to be similar to a unit there; few units do.
    """
    if not ours or not theirs:
        return 0
    times = np.fromiter(ours.values(), np.int64, len(ours))
    same = np.fromiter((u in theirs for u in ours), bool, len(ours))
    g, a, na = _postings(list(ours))
    same &= na > 0
    h, b, nb = _postings(list(theirs))
    first, last = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
    met = last > first
    met &= ~same[a]  # a unit that stands there itself is settled
    enough = np.bincount(a[met], minlength=len(na)) >= na * threshold - 1e-9
    met &= enough[a]
    a, first, size = a[met], first[met], (last - first)[met]
    hit = same.copy()
    if len(a):
        order = np.argsort(a, kind="stable")
        a, first, size = a[order], first[order], size[order]
        width = len(nb)
        # whole units a block: at most so many pairs of units, and of postings where one unit allows it
        unit, begin = np.unique(a, return_index=True)
        stop = np.append(begin[1:], len(a))
        load = np.maximum(np.add.reduceat(size, begin), width)
        block = np.cumsum(load) // PAIRS
        for k in np.unique(block):
            mine = np.flatnonzero(block == k)
            s = slice(begin[mine[0]], stop[mine[-1]])
            sizes = size[s]
            places = np.repeat(first[s] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.searchsorted(unit[mine], a[s]), sizes)
            both = np.bincount(row * width + b[places], minlength=len(mine) * width).reshape(len(mine), width)
            either = na[unit[mine]][:, None] + nb[None, :] - both
            hit[unit[mine]] = ((both > 0) & (both >= either * threshold - 1e-12)).any(1)
    return int(times[hit].sum())


def _keywords(clean: str, topk: int) -> list[str]:
    """A4 for one cleaned text."""
    grams = frequent_grams(_NO_WORD.sub("", clean), 8 * topk)[: 2 * topk]
    return [k for k in grams if len(k) >= 2 and not _NOISE.match(k) and k not in _stop][:topk]


def _draft(text: str | None, topk: int = 40) -> tuple[list[str], list[str], dict[str, int]]:
    """Keywords, titles of headings and units."""
    clean = plain_md(text or "")
    return _keywords(clean, topk), [title for _, _, title in headings_of((text or "").splitlines())], _units(clean)


def _note(text: str | None) -> tuple[str, str, set[str], dict[str, int]]:
    """Cleaned text, cleaned body, titles of headings and units."""
    lines, clean = (text or "").splitlines(), plain_md(text or "")
    return clean, plain_md("\n".join(body_of(lines))), {title for _, _, title in headings_of(lines)}, _units(clean)


def frequent_grams(text: str, most: int) -> list[str]:
    """Of the `most` most frequent 2- to 4-grams those seen twice or more, in order; ties by length, then by first appearance."""
    c = _codes(text)
    parts = []
    for n in (2, 3, 4):
        if len(c) >= n:
            key = np.zeros(len(c) - n + 1, np.uint64)
            for j in range(n):
                key = key << np.uint64(16) | c[j : len(c) - n + 1 + j]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            often = np.flatnonzero(count > 1)  # what is seen once ranks behind, and goes
            parts.append(np.stack([count[often], np.full(len(often), n), first[often]]))
    if not parts:
        return []
    count, n, first = np.concatenate(parts, 1)
    need = most + len(_stop)
    if len(count) > need:  # only these can be among the first `need`
        count, n, first = (x[count >= np.partition(count, -need)[-need]] for x in (count, n, first))
    ranked = (text[first[k] : first[k] + n[k]] for k in np.lexsort((first, n, -count)))
    return [gram for gram in ranked if gram not in _stop][:most]


def fallback_keywords(docs: DataFrame, key: str, topk: int = 40) -> DataFrame:
    """A4: (key, rank, kw): the most frequent 2- to 4-grams of a row's cleaned text, ties by first appearance. Row-local: no shuffle.

    The 8 * topk most frequent are cut before those seen once are dropped; then 2 * topk, validity, and topk.
    """

    @F.arrow_udf("array<string>")
    def grams(column: pa.Array) -> pa.Array:
        return pa.array([frequent_grams(x.as_py() or "", 8 * topk) for x in column], pa.list_(pa.string()))

    t = F.regexp_replace(strip_md(F.col("text")), "[^\\u4e00-\\u9fffA-Za-z0-9]", "")
    kws = F.slice(F.filter(F.slice(grams(t), 1, 2 * topk), valid_keyword), 1, topk)
    return docs.select(key, F.posexplode(kws).alias("_k", "kw")).select(key, (F.col("_k") + 1).alias("rank"), "kw")


def corpus_keywords(docs: DataFrame, key: str, topk: int = 40) -> DataFrame:
    """A5, as a named variant: words ranked by term frequency times the corpus's own inverse document frequency."""
    words = docs.select(key, F.explode(F.regexp_extract_all(strip_md(F.col("text")), F.lit(r"(?U)[\w]{2,}"), 0)).alias("kw"))
    tf = words.groupBy(key, "kw").agg(F.count("*").alias("tf"))
    n = docs.agg(F.countDistinct(key).alias("n_docs"))  # one row
    df = tf.groupBy("kw").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "kw")
    scored = tf.join(df, "kw").withColumn("score", F.round(F.col("tf") * F.log(F.col("n_docs") / F.col("df")), 6)).filter(valid_keyword(F.col("kw")))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topk).select(key, "rank", "kw", "tf", "df")


def check_drafts(drafts: DataFrame, notes: DataFrame, pairs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """drafts(draft_id, text) against notes(note_id, text), for pairs(draft_id, note_id).

    One row a pair: n_kw, n_covered, n_weak, n_dup_headings, n_units, n_similar, coverage, dup_ratio, verdict: 13 a revision, 10 covered, 11
    partly covered, 0 new (as is a pair whose note does not exist).
    """
    counts = "n_kw n_covered n_weak n_dup_headings n_units n_similar".split()
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("draft_id", "note_id")]

    def run(batches):
        last, draft, last_note, note = None, None, None, None
        for b in batches:
            out = []
            for d_id, n_id, d_there, n_there, d_text, n_text in zip(*(c.to_pylist() for c in b.columns)):
                if not n_there:
                    units = sum(_units(plain_md(d_text or "")).values())
                    out.append((None, 0, 0, 0, units, 0))
                    continue
                if draft is None or d_text != last:
                    last, draft = d_text, _draft(d_text)
                if note is None or n_text != last_note:
                    last_note, note = n_text, _note(n_text)
                (kws, titles, ours), (clean, body, known, theirs) = draft, note
                covered = [k for k in kws if k in clean]
                units = sum(ours.values())
                out.append((len(kws), len(covered), sum(k not in body for k in covered), sum(t in known for t in titles), units, similar_count(ours, theirs, threshold) if threshold > 0 else units))
            cols = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["draft_id", "note_id", *counts])

    # a pair's two texts meet in one row; whatever is made of them is made there, and dealt out no more
    d = drafts.select("draft_id", F.lit(True).alias("d_there"), F.col("text").alias("d_text"))
    n = notes.select("note_id", F.lit(True).alias("n_there"), F.col("text").alias("n_text"))
    rows = pairs.join(d, "draft_id", "left").join(n, "note_id", "left").select("draft_id", "note_id", "d_there", "n_there", "d_text", "n_text")
    out = rows.mapInArrow(run, f"draft_id {kinds[0]}, note_id {kinds[1]}, " + ", ".join(f"{c} long" for c in counts))
    out = out.withColumn("found", F.col("n_kw").isNotNull()).na.fill(0, ["n_kw", "n_covered", "n_weak", "n_dup_headings", "n_units", "n_similar"])
    out = out.withColumns({"coverage": F.col("n_covered") / F.greatest("n_kw", F.lit(1)), "dup_ratio": F.col("n_similar") / F.greatest("n_units", F.lit(1))})
    verdict = F.when(~F.col("found"), 0).when((F.col("coverage") >= 0.8) & (F.col("dup_ratio") >= 0.6), 13).when(F.col("coverage") >= 0.8, 10).when(F.col("coverage") >= 0.5, 11).otherwise(0)
    return out.withColumn("verdict", verdict).drop("found")


def top_pairs(similar: DataFrame, n: int = 5) -> DataFrame:
    """The n most similar units of a draft."""
    w = Window.partitionBy("d", "n").orderBy(F.desc(F.col("both") / F.col("either")), "unit_no")
    return similar.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def find_notes(notes: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """O1: notes(note_id, rel, stem, text) scored by stem (one that only resembles the query too), headings, tags and body; ties by rel."""
    q = query.strip().lower()
    low = F.lower("text")
    titles = headings(notes).filter(F.contains(F.lower("title"), F.lit(q))).select("note_id").distinct().withColumn("in_heading", F.lit(True))
    hits = F.char_length(low) + 1 if q == "" else ((F.char_length(low) - F.char_length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long")
    head = F.lower(F.substring("text", 1, 600))
    like = fuzzy_stems(notes.filter(~F.contains(F.lower("stem"), F.lit(q))), query).select("note_id", F.col("score").alias("_like"))
    s = notes.join(titles, "note_id", "left").join(like, "note_id", "left").withColumn("hits", hits)
    score = F.when(F.contains(F.lower("stem"), F.lit(q)), 10).otherwise(F.coalesce("_like", F.lit(0))) + F.when(F.col("in_heading"), 8).otherwise(0) + F.when(F.contains(head, F.lit(q)) & F.contains(head, F.lit("tags")), 5).otherwise(0) + F.least("hits", F.lit(6))
    return s.withColumn("score", score.cast("int")).filter("score > 0").select("note_id", "rel", "score", "hits").orderBy(F.desc("score"), "rel").limit(limit)
