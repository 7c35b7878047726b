"""Near-duplicate detection by min-max hashing, confirmed on full shingle sets.

Sketch: every permutation gives two signature values, the set's smallest and largest hash, so 60 hash evaluations a
shingle fill 120 values: 24 bands of 5. A pair at similarity 0.85 is in no common band with probability under 1e-6.

Links: texts with equal sets (one 128-bit digest) are one node of the graph, however many rows hold it. A bucket of at most BLOCK
nodes and WEIGHT shingles is resolved in one task, which compares full sets and returns a spanning forest of the links; buckets with
the same members are resolved once. In a larger bucket the member with the most bucket mates is the centre, and only (centre,
member) pairs are confirmed. That loses nothing: if x is not linked to the centre c, a document y can be linked to x only if x and y
share a shingle outside c, or y is smaller than c and no larger than |x & c| * (1 + t) / t - |x| (else |x & y| <= |x & c| is too
small). So what is not linked is dealt again by (c, shingle outside c), where more than one component meets, and compared by (c, size).
Large groups are taken by their centres. About SETTLED members outside a group's main component are met with all its members, block by
block: where that is all of them the group is settled, as a link that matters has an end among them. Groups get smaller with every level by these and by
their centre, and levels go on until none is large. Hot buckets are aggregated before they are shuffled, joins on them are split, and
a centre's members are confirmed in blocks of bounded size.

Rows are told apart by themselves, not by doc_id: a text links with others as its own words say, whatever other rows have its doc_id.

Defined cases: null or empty text, or text without words: an empty set, linked with nothing; fewer than five words: the whole sequence is the
one shingle; repeated rows are one node, each row comes back; rows of one doc_id with different texts are nodes of their own; a null
doc_id is linked like others, but is no component's id unless the component has no other; an empty table gives no rows; other
columns are ignored; whole texts are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import POLY, U64, SpanHash, discard, materialize, mix64, skew_join, slices, spread, utf8_column
from quillspark.llm.graph import components

SHINGLE, HASHES, ROWS = 5, 60, 5
BANDS = 2 * HASHES // ROWS
#: Nodes that are resolved, or members of a centre that are confirmed, in one block; and their shingles together.
BLOCK, WEIGHT = 256, 1 << 21
#: Members of a large group that are settled in one level, and how many of each side meet in a block.
SETTLED, HALF = 1024, 128
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = np.array([pow(POLY, 2 * j + 3, 1 << 64) for j in range(SHINGLE)], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct 64-bit shingle hashes of each text."""
    for first, last in slices(offsets, PIECE):
        base = offsets[first]
        part, cuts = LOWER[data[base : offsets[last]]], offsets[first : last + 1] - base
        n = len(part)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~SPACE[part]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        here, before = word[1:], word[:-1]
        starts = np.flatnonzero(here & (~before | edge))
        ends = np.flatnonzero(before & (~here | edge))
        words = SpanHash(part)(starts, ends)
        at = np.searchsorted(starts, cuts)
        many = max(0, len(words) - SHINGLE + 1)
        mixed = np.zeros(many, U64)
        for j in range(SHINGLE):
            mixed += words[j : j + many] * _STEP[j]
        mixed = mix64(mixed)
        for d in range(last - first):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= SHINGLE:
                yield np.unique(mixed[a : b - SHINGLE + 1])
            elif b > a:
                yield mix64(np.array([(words[a:b] * _STEP[: b - a]).sum() + U64(b - a)], U64))
            else:
                yield np.zeros(0, U64)


def min_max_signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima, then HASHES maxima."""
    low, high = np.full(HASHES, ~U64(0)), np.zeros(HASHES, U64)
    for k in range(0, len(hashes), 2048):
        m = _MUL[:, None] * hashes[None, k : k + 2048] + _ADD[:, None]
        np.minimum(low, m.min(1), out=low)
        np.maximum(high, m.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=U64) * U64(0xA24BAED4963EE407)
    for j in range(ROWS):
        total = mix64(total + rows[:, j])
    return total.view(np.int64)


SKETCH = "uid long, doc_id long, t long, n long, h1 long, h2 long, bands array<long>, z binary"


def _sketch(batches):
    """Rows (doc_id, t, text): a number of the row's own, the set's size, digest and bands, and the text as zstd bytes."""
    import zstandard

    z, uid = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 40
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
    for b in batches:
        out = []
        data, offsets = utf8_column(b.column(2))
        for doc_id, t, a, e, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), offsets[:-1], offsets[1:], shingle_sets(data, offsets)):
            if len(s):
                h = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                out.append((uid, doc_id, t, len(s), int(h[0]), int(h[1]), band_keys(min_max_signature(s)), z.compress(data[a:e].tobytes())))
            else:
                out.append((uid, doc_id, t, 0, 0, 0, None, None))
            uid += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], [x.split()[0] for x in SKETCH.split(", ")])


def _confirm(batches):
    """Rows sorted by (centre, block), the centre's own row first: |c & x| and what x holds outside c."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    key, centre = None, np.zeros(0, U64)
    for b in batches:
        raw = [z.decompress(x.as_py()) for x in b.column(4)]
        offsets = np.cumsum([0, *map(len, raw)])
        sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets)
        rows = []
        for c, block, role, x, s in zip(*(b.column(k).to_pylist() for k in range(4)), sets):
            if role == 0:
                key, centre = (c, block), s
                continue
            if key != (c, block):
                raise RuntimeError("a block lost its centre")
            inside = centre[np.minimum(np.searchsorted(centre, s), len(centre) - 1)] == s if len(centre) else np.zeros(len(s), bool)
            rows.append((c, x, len(centre), len(s), int(inside.sum()), s[~inside].view(np.int64)))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], ["c", "x", "n_c", "n_x", "both", "outside"])


def confirm_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(c, x) with texts(doc_id, z): c, x, n_c, n_x, both, outside. Blocks of a centre are tasks' units of work."""
    n = spread(pairs.sparkSession)
    counts = pairs.groupBy("c").agg(F.count("*").alias("_m")).select("c", F.ceil(F.col("_m") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(counts, "c").join(texts, F.col("x") == F.col("doc_id")).select("c", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "x", "z")
    centres = counts.join(texts, F.col("c") == F.col("doc_id")).select("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("c").alias("x"), "z")
    dealt = members.unionByName(centres).repartition(n, "c", "block").sortWithinPartitions("c", "block", "role")
    return dealt.mapInArrow(_confirm, "c long, x long, n_c long, n_x long, both long, outside array<long>")


def _resolve(batches, percent: int):
    """Groups of at most BLOCK members, sorted by key: links that span the groups' components, found on full sets."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    key, ids, raw = None, [], []
    for b in batches:
        out = []
        for k, x, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if ids and k != key:
                out += _forest(ids, raw, percent)
                ids, raw = [], []
            key = k
            ids.append(x)
            raw.append(z.decompress(body.as_py()))
        if out:
            yield _links(out)
    if ids:
        yield _links(_forest(ids, raw, percent))


def _links(rows):
    u, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _forest(ids: list[int], raw: list[bytes], percent: int) -> list[tuple[int, int]]:
    sets = list(shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    row = np.repeat(np.arange(m), sizes)
    row, place = row[often[place] > 1], shared[place[often[place] > 1]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for k in range(0, int(shared[-1]) + 1 if len(shared) else 0, 8192):
        lo, hi = np.searchsorted(place, [k, k + 8192])
        has = np.zeros((m, min(8192, int(shared[-1]) + 1 - k)), np.float32)
        has[row[lo:hi], place[lo:hi] - k] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    near = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    out, left = [], np.ones(m, bool)
    for i in range(m):
        if left[i]:
            left[i], reach = False, [i]
            while reach:
                j = reach.pop()
                for k in np.flatnonzero(near[j] & left):
                    left[k] = False
                    reach.append(int(k))
                    out.append((ids[j], ids[k]))
    return out


def resolve_groups(keyed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """keyed(key, x), groups of at most BLOCK: spanning links (u, v)."""
    dealt = keyed.join(texts, F.col("x") == F.col("doc_id")).select("key", "x", "z")
    return dealt.repartition(spread(keyed.sparkSession), "key").sortWithinPartitions("key").mapInArrow(lambda b: _resolve(b, percent), "u long, v long")


def _sort_out(keyed: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, x) of groups of 2 to BLOCK members, one of those with the same members; and (key, x, n) of larger ones.

    stats(key, n, w, sig, lo, hi): the members' number, their shingles, exclusive or, least and greatest of their hashes.
    """
    stats = materialize(stats.filter("n > 1"), "groups")
    fits = (F.col("n") <= BLOCK) & ((F.col("w") <= WEIGHT) | (F.col("n") == 2))
    small = stats.filter(fits).groupBy("n", "sig", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    large = stats.filter(~fits).select("key", "n")
    return keyed.join(small, "key", "left_semi").select("key", "x"), keyed.join(large, "key").select("key", "x", "n")


def _stats(keyed: DataFrame, *more) -> DataFrame:
    h = F.xxhash64("x")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.bit_xor(h).alias("sig"), F.min(h).alias("lo"), F.max(h).alias("hi"), *more)


def _stars(large: DataFrame) -> DataFrame:
    """large(key, x, n) -> distinct (c, x): of each group the member with the most mates is the centre."""
    rank = large.groupBy("x").agg(F.sum("n").alias("mates"))
    ranked = large.select("key", "x").join(rank, "x")
    top = ranked.groupBy("key").agg(F.max(F.struct("mates", (-F.col("x")).alias("_x"))).alias("_t")).select("key", (-F.col("_t._x")).alias("c"))
    return large.select("key", "x").join(top, "key").filter("c <> x").select("c", "x").distinct()


def _settle_some(stars: DataFrame, labels: DataFrame, weights: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """stars(c, x): groups by their centre -> (key, x), blocks that settle some members, and the stars that are left.

    Of groups with at most SETTLED members outside their main component these are met with all members, HALF of either side in a block. Of
    larger ones a share of the nodes is, the same nodes in every group, so that these need no further look: about SETTLED a group.
    """
    members = stars.union(stars.select("c", F.col("c").alias("x"))).distinct()
    near = members.join(labels.select(F.col("id").alias("x"), "comp"), "x", "left").select("c", "x", F.coalesce("comp", "x").alias("comp"))
    near = materialize(near, "near")
    sizes = near.groupBy("c", "comp").agg(F.count("*").alias("s")).groupBy("c").agg(F.max(F.struct("s", "comp")).alias("b"), F.sum("s").alias("n"))
    sizes = materialize(sizes.select("c", "n", F.col("b.comp").alias("main"), (F.col("n") - F.col("b.s")).alias("others")).filter("others > 0"), "sizes")
    most = sizes.agg(F.max("others")).first()[0] or 0
    chosen = F.pmod(F.xxhash64(F.lit(level), "x"), F.lit(max(1, -(-most // SETTLED)))) == 0
    picked = F.when(F.col("others") <= SETTLED, F.col("comp") != F.col("main")).otherwise(chosen)
    near = materialize(near.join(sizes, "c").join(weights, "x").select("c", "x", "w", "others", picked.alias("picked")), "near")
    need = lambda n, w: F.greatest(F.ceil(n / HALF), F.ceil(F.coalesce(w, F.lit(0)) / (WEIGHT // 2))).cast("int")
    counts = near.groupBy("c").agg(need(F.count_if("picked"), F.sum(F.when(F.col("picked"), F.col("w")))).alias("ours"), need(F.count("*"), F.sum("w")).alias("all"))
    cut = near.join(counts.filter("ours > 0"), "c").withColumns({"_i": F.pmod(F.xxhash64(F.lit("ours"), "x"), F.col("ours")).cast("int"), "_j": F.pmod(F.xxhash64(F.lit("all"), "x"), F.col("all")).cast("int")})
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = cut.filter("picked").select("c", "_i", blocks("all").alias("_j"), "x")
    every = cut.select("c", blocks("ours").alias("_i"), "_j", "x")
    keyed = ours.union(every).select(F.xxhash64("c", "_i", "_j").alias("key"), "x").distinct()
    return keyed, near.filter((F.col("others") > SETTLED) & ~F.col("picked") & (F.col("c") != F.col("x"))).select("c", "x")


def _none(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) -> per row: doc_id, n_shingles, component_id, kept; t (the text's xxhash64) and first (see below).

    A link: 100 * |a & b| >= percent * |a | b|. `first` marks the row of each component with the least (doc_id, t), null ids last:
    one row, and those equal to it, also where doc_id does not tell rows apart.
    """
    if percent < 85:
        raise ValueError("the bands are laid out for similarities of 0.85 and more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    sketch = materialize(docs.mapInArrow(_sketch, SKETCH), "sketch")
    low = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    nodes = sketch.filter("n > 0").groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("uid").alias("uid"), F.max("n").alias("n"), F.min(low).alias("low"))
    nodes = materialize(nodes.withColumn("x", F.monotonically_increasing_id()), "nodes")
    bands = sketch.select("uid", "bands").join(nodes.select("uid", "x", "n"), "uid")
    keyed = materialize(bands.select(F.explode("bands").alias("key"), "x", F.col("n").alias("w")), "keyed")
    small, large = _sort_out(keyed, _stats(keyed))
    small, large = materialize(small, "small"), materialize(large, "large")
    wanted = small.select("x").union(large.select("x")).distinct().join(nodes.select("x", "uid"), "x")
    texts = materialize(sketch.select("uid", "z").join(wanted, "uid").select(F.col("x").alias("doc_id"), "z"), "texts")
    discard(keyed)
    links = materialize(resolve_groups(small, texts, percent), "links")
    level = 0
    while not _none(large):
        level += 1
        some, rest = _settle_some(_stars(large), components(links), nodes.select("x", F.col("n").alias("w")), level)
        seen = materialize(confirm_pairs(rest, texts).withColumn("linked", _linked(percent)), "seen")
        stars = seen.filter("linked").select(F.col("c").alias("u"), F.col("x").alias("v"))
        more = materialize(links.union(stars).union(resolve_groups(some, texts, percent)), "links")
        discard(links)
        links, rest = more, large.limit(0)
        if not _none(seen):
            small, rest, sized = _residual(seen, components(more), percent)
            rest = materialize(rest, "large")
            sized = confirm_pairs(sized, texts).filter(_linked(percent)).select(F.col("c").alias("u"), F.col("x").alias("v"))
            links = materialize(more.union(resolve_groups(small, texts, percent)).union(sized), "links")
            discard(more)
        discard(seen)
        large = rest
    labels = components(links)
    n = nodes.count()
    linked = materialize(nodes.join(labels, F.col("x") == F.col("id")).select("x", "comp", "low"), "linked")
    lows = linked.groupBy("comp").agg(F.min("low").alias("least"), F.count("*").alias("_n"))
    least = skew_join(linked.select("x", "comp"), materialize(lows, "lows"), "comp", n).select("x", "least")
    info = nodes.join(least, "x", "left").select("h1", "h2", F.coalesce("least", "low").alias("least"), F.col("m").alias("_n"))
    rows = sketch.filter("n > 0").select("doc_id", "t", F.col("n").alias("n_shingles"), "h1", "h2")
    out = skew_join(rows, materialize(info, "info"), ["h1", "h2"], n).drop("h1", "h2")
    first = F.col("doc_id").eqNullSafe(F.col("least.id")) & F.col("t").eqNullSafe(F.col("least.t"))
    out = out.select("doc_id", "n_shingles", F.col("least.id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least.id")).alias("kept"), "t", first.alias("first"))
    alone = sketch.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "t", F.lit(True).alias("first"))
    return out.unionByName(alone)


def has_words(text: Column) -> Column:
    """Whether the text has a shingle at all."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _linked(percent: int) -> Column:
    return F.expr(f"100 * both >= {percent} * (n_c + n_x - both)")


def _residual(seen: DataFrame, comps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of (c, shingle outside c), small and large, and pairs by (c, size), where two components meet."""
    label = comps.select(F.col("id").alias("x"), F.col("comp"))
    with_comp = seen.join(label, "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    # a centre matters only while one of its members is neither linked with it nor in its component
    own = comps.select(F.col("id").alias("c"), F.col("comp").alias("comp_c"))
    with_comp = with_comp.join(own, "c", "left").withColumn("comp_c", F.coalesce("comp_c", "c"))
    open_c = with_comp.filter("not linked and comp <> comp_c").select("c").distinct()
    live = materialize(with_comp.join(open_c, "c", "left_semi").select("c", "x", "n_x", "both", "linked", "comp", "outside"), "live")
    parts = live.select("c", F.explode("outside").alias("a"), "x", "linked", "comp", "n_x").select(F.xxhash64("c", "a").alias("key"), "x", "linked", "comp", F.col("n_x").alias("w"))
    stats = _stats(parts, F.min("linked").alias("all"), F.min("comp").alias("one"), F.max("comp").alias("other")).filter("not all and one <> other")
    small, large = _sort_out(parts, stats.select("key", "n", "w", "sig", "lo", "hi"))
    t = percent / 100
    bound = F.floor(F.col("both") * F.lit((1 + t) / t) - F.col("n_x") + F.lit(1e-6)).cast("long")
    grey = live.filter("not linked").withColumn("_b", bound).withColumn("_a", F.ceil(F.col("n_x") * F.lit(t) - F.lit(1e-6)).cast("long")).filter("_b >= _a")
    grey = grey.select("c", F.col("x").alias("gx"), F.col("comp").alias("gcomp"), F.explode(F.sequence("_a", "_b")).alias("n_x"))
    sized = grey.join(live.select("c", "x", "n_x", "comp"), ["c", "n_x"]).filter("gx <> x and gcomp <> comp").select(F.least("gx", "x").alias("c"), F.greatest("gx", "x").alias("x")).distinct()
    return small, large, materialize(sized, "sized")


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
