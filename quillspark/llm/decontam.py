"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Items are cut into windows of `width` consecutive words (a shorter item is one window). The corpus frequency of every
item word is counted over all documents; each window is indexed by its `rarest` rarest words. One scan stores the
postings (term, document, position) of these words as a table; a posting and the same word in an item give the
diagonal (document position less item position), and intersecting the offset-adjusted lists is grouping by
(document, item, diagonal): windows whose rare words are all there are candidates, which are then confirmed word by word on
whole texts. `phrase_hits` returns exact matches, `proximity_hits` windows whose rare words are all there, each displaced
by less than `slop` words.

Only tables of the benchmark's size are broadcast, and only when their bytes, counted, are few; beyond that they are joined by
shuffle. Candidates grow with the corpus: they meet their texts by shuffle, to which only texts go whose key's bit is set in a
bit table of BITS bits (at most BITS / 64 rows, so broadcast). Frequencies pre-aggregate; a posting list is never gathered: a
passage in a third of all documents is as many rows.

Defined cases: null text has no words; items without words have no windows; a repeated item counts once; an item whose item_id is null
counts as one whose id is the empty string; repeated rows get equal results; of documents with one doc_id and different texts each is judged by its own text; empty tables give no rows or no hits; other
columns are ignored. Matching folds A-Z only; candidates are looked up under full case folding, which keeps word boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, small

#: What stands between words. Splitting at it and dropping empty pieces gives the words, at a quarter of the cost of matching them.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Closes a document's words, so that one scan counts both them and the vocabulary: it cannot be a word.
END = "\x01"
#: Bits of the table that says which rows may be candidates.
BITS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased, nothing else changed."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def folded_words(text: Column) -> Column:
    """Words under full case folding: as many, at the same places, and equal wherever exact words are."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def _keep_marked(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """rows (k, t, ...) whose key may be among marked (k, t): all that are, and few others while BITS is large beside them."""
    bit = F.pmod(F.xxhash64("k", "t"), F.lit(BITS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    table = marked.groupBy((bit / 64).cast("int").alias("_word")).agg(F.bit_or(flag).alias("_bits"))
    held = rows.join(F.broadcast(table), (bit / 64).cast("int") == F.col("_word"))
    return held.filter(F.col("_bits").bitwiseAND(flag) != 0).drop("_word", "_bits")


def row_key() -> tuple[Column, Column]:
    """What a row is judged by: its doc_id, a null one as the least number, and its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")


def _keyed(docs: DataFrame) -> DataFrame:
    k, t = row_key()
    return docs.select("doc_id", k.alias("k"), t.alias("t"), "text")


def _mark() -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("ipos") % 63)).alias("mark")


class PhraseIndex:
    """Postings of the items' rare words over a corpus, and what is needed to read them."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2):
        """docs(doc_id, text), items(item_id, text)."""
        self.docs, self.width, self.rarest = _keyed(docs), width, rarest
        listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct().withColumns({"words": exact_words(F.col("text")), "folded": folded_words(F.col("text"))})
        listed = listed.filter(F.size("words") > 0).withColumn("ik", F.xxhash64("item_id", "text")).drop("text")
        self.items = materialize(listed, "items")
        places = self.items.select("ik", F.size("words").alias("n"), F.posexplode("folded").alias("ipos", "term"))
        vocabulary = places.select("term").union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct()
        tokens = self.docs.select("k", "t", F.posexplode(F.array_append(folded_words(F.col("text")), F.lit(END))).alias("pos", "term"))
        closing = lambda c: F.when(F.col("term") == END, F.col(c))
        counts = tokens.join(small(vocabulary), "term", "left_semi").groupBy("term", closing("k").alias("k"), closing("t").alias("t"), closing("pos").alias("n_words")).agg(F.count("*").alias("freq"))
        counted = materialize(counts, "counts")
        self.frequency = counted.filter(F.col("term") != END).select("term", "freq")
        self.lengths = counted.filter(F.col("term") == END).select("k", "t", F.col("n_words").cast("long").alias("n_words"))
        # windows, each with its rarest places; a word that no document holds rules its windows out
        starts = self.items.select("ik", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("start"), F.least(F.size("words"), F.lit(width)).alias("len"))
        spots = starts.join(places.drop("n"), "ik").filter("ipos >= start and ipos < start + len").join(self.frequency, "term", "left")
        windows = spots.groupBy("ik", "start", "len").agg(F.sort_array(F.collect_list(F.struct("freq", "ipos"))).alias("s"))  # at most `width` entries
        windows = windows.filter(~F.exists("s", lambda x: x["freq"].isNull()))
        windows = windows.select("ik", F.struct("start", "len", F.transform(F.slice("s", 1, rarest), lambda x: x["ipos"]).alias("need")).alias("w"))
        self.windows = materialize(windows.groupBy("ik").agg(F.sort_array(F.collect_list("w")).alias("windows")), "windows")  # an item's own windows
        needed = self.windows.select("ik", F.explode("windows").alias("w")).select("ik", F.explode("w.need").alias("ipos")).distinct()
        self.places = materialize(needed.join(places.drop("n"), ["ik", "ipos"]), "places")
        terms = self.places.select("term").distinct()
        #: What postings are met with, marked for broadcast where that is small.
        self.near = {"places": small(self.places), "windows": small(self.windows), "items": small(self.items.select("ik", "item_id", "words"))}
        found = self.docs.select("k", "t", F.posexplode(folded_words(F.col("text"))).alias("pos", "term"))
        self.postings = materialize(found.join(small(terms), "term", "left_semi"), "postings")

    def _diagonals(self) -> DataFrame:
        return self.postings.join(self.near["places"], "term").select("k", "t", "ik", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos")

    def _holding(self, hits: DataFrame) -> DataFrame:
        """Groups whose mark (a bit a place, modulo 63) holds every rare place of some window: all true ones, and few others."""
        mark = lambda w: F.aggregate(w["need"], F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 63).cast("int"))))
        held = hits.join(self.near["windows"], "ik").withColumn("windows", F.filter("windows", lambda w: mark(w).bitwiseAND(F.col("mark")) == mark(w)))
        return held.filter(F.size("windows") > 0).drop("mark")

    def candidates(self) -> DataFrame:
        """(k, t, ik, diag, windows): windows whose rare words stand at their offsets."""
        return self._holding(self._diagonals().groupBy("k", "t", "ik", "diag").agg(_mark()))

    def proximity_hits(self, slop: int = 5) -> DataFrame:
        """(k, t, ik, start, windows): windows whose rare words all occur, any two of their diagonals less than `slop` apart.

        A span of `slop` diagonals starts at every diagonal that holds a rare word, so the smallest of a hit's diagonals starts one.
        """
        # at most `slop` rows a posting; the places of a span are at most the item's own
        spans = self._diagonals().withColumn("start", F.explode(F.sequence(F.col("diag") - (slop - 1), F.col("diag"))))
        held = spans.groupBy("k", "t", "ik", "start").agg(F.min("diag").alias("_low"), F.collect_set("ipos").alias("_has")).filter("_low = start")
        held = held.join(self.near["windows"], "ik").withColumn("windows", F.filter("windows", lambda w: F.forall(w["need"], lambda i: F.array_contains("_has", i))))
        return held.filter(F.size("windows") > 0).select("k", "t", "ik", "start", "windows")

    def phrase_hits(self) -> DataFrame:
        """(k, t, ik, item_id, places): document positions covered by exact occurrences of an item's windows."""
        at = self.candidates().groupBy("k", "t").agg(F.collect_list(F.struct("ik", "diag", "windows")).alias("c"))  # bounded by the document's own length
        at = materialize(at, "candidates")
        texts = _keep_marked(self.docs.select("k", "t", "text"), at).groupBy("k", "t").agg(F.min("text").alias("text")).join(at.hint("shuffle_merge"), ["k", "t"])  # a written table looks smaller than it is
        each = texts.select("k", "t", exact_words(F.col("text")).alias("dw"), "c").select("k", "t", "dw", F.explode("c").alias("c"))
        each = each.join(self.near["items"], F.col("c.ik") == F.col("ik"))
        same = lambda w: F.slice("dw", F.col("c.diag") + w["start"] + 1, w["len"]) == F.slice("words", w["start"] + 1, w["len"])
        inside = lambda w: (F.col("c.diag") + w["start"] >= 0) & (F.col("c.diag") + w["start"] + w["len"] <= F.size("dw"))
        fits = F.filter("c.windows", lambda w: F.when(inside(w), same(w)).otherwise(False))
        cover = lambda w: F.sequence(F.col("c.diag") + w["start"], F.col("c.diag") + w["start"] + w["len"] - 1)
        each = each.withColumn("fits", fits).filter(F.size("fits") > 0)
        return each.select("k", "t", "ik", "item_id", F.array_distinct(F.flatten(F.transform("fits", cover))).alias("places"))

    def report(self) -> DataFrame:
        """Every document: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
        hits = self.phrase_hits()
        per = hits.groupBy("k", "t").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("_p"), F.array_sort(F.collect_set("item_id")).alias("items"))
        per = per.select("k", "t", F.size("_p").cast("long").alias("n_hit"), "items")
        base = self.docs.select("doc_id", "k", "t").join(self.lengths, ["k", "t"])
        out = base.join(per, ["k", "t"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))})
        return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op8_decontam(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = PhraseIndex(docs, items).report()
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
