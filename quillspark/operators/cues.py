"""Time-stamped transcripts: parsing to cues, gap inference, segmentation into paragraphs, statistics.

cues: (doc_id, pos, t, text), in file order. Everything orders by pos, never by t: time may run backwards.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import clean_inline, despeak, fmt_ts, let, parse_ts, strip
from quillspark.operators.lines import split_lines

ARROW = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})"
STAMP = r"^`?\[?(\d{1,2}:\d{2}(?::\d{2})?(?:[,.]\d{1,3})?)\]?`?(?U:\s*)(.*)$"
SENTENCE = re.compile("[。！？；]")


def transcript_body(text: Column) -> Column:
    """The text after leading front matter, which blanks may precede."""
    cut = lambda b: F.when(b.startswith("---") & (F.locate("\n---", b, 4) > 0), F.substr(b, F.locate("\n---", b, 4) + 4))
    return F.coalesce(let(F.regexp_replace(text, r"(?U)\A[\s\x1C-\x1F]+", ""), cut), text)


def _order(*keys: str):
    return Window.partitionBy("doc_id", *keys).orderBy("pos")


def parse_cues(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to cues. Arrow blocks where there are any that hold text, else lines with a time stamp."""
    body = docs.repartition("doc_id").select("doc_id", transcript_body(F.col("text")).alias("b"))
    blocks = body.filter(F.col("b").rlike(ARROW)).select("doc_id", F.posexplode(F.split("b", r"\n(?U:\s*)\n")).alias("k", "blk")).filter(F.col("blk").rlike(ARROW))
    rest = F.regexp_replace("blk", rf"(?s)\A.*?{ARROW}", "")
    parts = F.filter(F.transform(split_lines(rest), strip), lambda x: x != "")
    text = F.regexp_replace(F.array_join(parts, " "), "<[^>]+>", "")
    srt = blocks.select("doc_id", "k", parse_ts(F.regexp_extract("blk", ARROW, 1)).alias("t"), text.alias("raw")).filter(strip(F.col("raw")) != "")
    srt = srt.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).alias("pos"), "t", clean_inline(F.col("raw")).alias("text"))

    plain = body.join(srt.select("doc_id").distinct(), "doc_id", "left_anti")
    lines = plain.select("doc_id", F.posexplode(split_lines(F.col("b"))).alias("pos", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    stamped = F.col("line").rlike(STAMP)
    lines = lines.withColumns({"said": F.when(stamped, clean_inline(F.regexp_extract("line", STAMP, 2))), "t": F.when(stamped, parse_ts(F.regexp_extract("line", STAMP, 1)))})
    lines = lines.withColumn("cue", F.sum(F.when(F.col("said") != "", 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    follows = F.col("said").isNull() & ~F.substring("line", 1, 1).isin("#", "!", "|", ">", "<")
    kept = lines.filter((F.col("cue") > 0) & ((F.col("said") != "") | follows)).withColumn("piece", F.coalesce("said", "line"))
    # a piece follows the one before it directly if that ends in CJK
    last = F.lag("piece").over(_order("cue"))
    seam = F.when(last.isNull(), "").when(F.substring(last, -1, 1).rlike("[一-鿿]"), "").otherwise(" ")
    kept = kept.withColumn("piece", F.concat(seam, "piece"))
    said = kept.groupBy("doc_id", "cue").agg(F.min_by("t", "pos").alias("t"), F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    said = said.select("doc_id", (F.col("cue") - 1).cast("int").alias("pos"), "t", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
    return srt.unionByName(said)


def lost_prefix(docs: DataFrame) -> DataFrame:
    """(doc_id, prefix): text before the first stamped line, which parsing drops; empty for arrow formats and plain texts."""
    body = docs.repartition("doc_id").select("doc_id", transcript_body(F.col("text")).alias("b")).filter(~F.col("b").rlike(ARROW))
    kept = F.filter(F.transform(split_lines(F.col("b")), strip), lambda x: x != "")
    return body.withColumn("l", kept).withColumn("first", F.array_position(F.transform("l", lambda x: x.rlike(STAMP)), True)).filter("first > 1").select("doc_id", F.array_join(F.slice("l", F.lit(1), (F.col("first") - 1).cast("int")), "\n").alias("prefix"))


def _steps(cues: DataFrame) -> DataFrame:
    """cues with _d: the step from the cue before where that is between 0 and 60 seconds."""
    step = F.col("t") - F.lag("t").over(_order())
    return cues.withColumn("_d", step).withColumn("_d", F.when((F.col("_d") > 0) & (F.col("_d") < 60), F.col("_d")))


def _gap(median: Column) -> Column:
    return F.greatest(F.coalesce(median * 1.8, F.lit(5.0)), F.lit(5.0))


def auto_gap(cues: DataFrame) -> DataFrame:
    """(doc_id, gap): 1.8 times the median step between 0 and 60 seconds, 5 at least, 5 without steps. Exact median."""
    return _steps(cues).groupBy("doc_id").agg(_gap(F.median("_d")).alias("gap"))


def segments(cues: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Cues with seg: a new one where the step from the cue before is the gap or more. Without gaps each document's own is taken on the way."""
    if gaps is None:
        own = _gap(F.median("_d").over(Window.partitionBy("doc_id")))
        c = _steps(cues.filter("doc_id IS NOT NULL")).select("doc_id", *(x for x in cues.columns if x != "doc_id"), own.alias("gap"))
    else:
        c = cues.join(gaps, "doc_id")
    new = F.coalesce((F.col("t") - F.lag("t").over(_order()) >= F.col("gap")).cast("int"), F.lit(0))
    return c.withColumn("_n", new).withColumn("seg", F.sum("_n").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def pauses(cues: DataFrame, gaps: DataFrame | None = None, most: int = 25) -> DataFrame:
    """The first pauses of 1.5 gaps or more of each document."""
    c = cues.join(auto_gap(cues) if gaps is None else gaps, "doc_id").withColumn("pause", F.col("t") - F.lag("t").over(_order()))
    hit = c.filter(F.col("pause") >= 1.5 * F.col("gap"))
    return hit.withColumn("k", F.row_number().over(_order())).filter(F.col("k") <= most).select("doc_id", "pos", "t", "pause", "k")


class Fold:
    """W9 for one segment: cues come in, finished paragraphs (doc_id, seg, k, t, text) go out."""

    def __init__(self, doc_id, seg: int, most: int, cut_from: float, t):
        self.key, self.most, self.cut_from, self.start, self.k = (doc_id, seg), most, cut_from, t, 0
        self.parts, self.size, self.last, self.stop = [], 0, "", 0

    def add(self, t, said: str) -> list[tuple]:
        if not said:
            pieces = []
        elif not self.size or "一" <= self.last <= "鿿" or "一" <= said[0] <= "鿿":
            pieces = [said]
        else:
            pieces = [" ", said]
        self.parts += pieces
        if pieces:
            found = [] if said.isascii() else [m.end() for m in SENTENCE.finditer(said)]
            self.size += len(pieces) - 1
            self.stop = self.size + found[-1] if found else self.stop
            self.size, self.last = self.size + len(said), said[-1]
        if self.size < self.most or not self.stop or self.stop < self.cut_from:
            return []
        text = "".join(self.parts)
        out = [(*self.key, self.k, self.start, text[: self.stop])]
        rest = text[self.stop :]
        self.parts, self.size, self.stop, self.start, self.k = [rest], len(rest), 0, t, self.k + 1
        return out

    def end(self) -> list[tuple]:
        text = "".join(self.parts)
        return [(*self.key, self.k, self.start, text)] if text.strip() else []


def _folded(cues: DataFrame, gaps: DataFrame | None, most: int) -> DataFrame:
    """Paragraphs (doc_id, seg, k, t, text) before cleaning, and a row for each document with its duration, n_cues and gap, without text.

    The cut carries text over to the next paragraph, so cues are folded in Python, in order, from one segment to the next; nothing carries over
    a gap. Only new text is searched for sentence ends: what is behind the last one holds none.
    """
    cut_from = 0.6 * most
    kind = cues.schema["doc_id"].dataType.simpleString()

    def run(batches):
        now, at, fold, types, seen = None, None, None, None, None
        for b in batches:
            types, done, ends = b.schema.field(0).type, [], []
            for doc_id, seg, t, said, gap in zip(*map(values, b.columns)):
                if seg != at or doc_id != now:
                    if fold:
                        done += fold.end()
                    if doc_id != now:
                        if fold:
                            ends.append(whole(now, *seen))
                        seen = [t, t, 0, gap]
                    now, at, fold = doc_id, seg, Fold(doc_id, seg, most, cut_from, t)
                seen[1] = t
                seen[2] += 1
                done += fold.add(t, said or "")
            yield from made(done, ends, types)
        if fold:
            yield from made(fold.end(), [whole(now, *seen)], types)

    def values(c):
        """What to_pylist gives, faster for the kinds that cues have."""
        plain = pa.types.is_string(c.type) or not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
        return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()

    def whole(doc_id, first, last, n, gap):
        return doc_id, None if first is None or last is None else last - first, n, gap

    def made(done, ends, kind):
        kinds = dict(doc_id=kind, seg=pa.int64(), k=pa.int32(), t=pa.float64(), text=pa.string(), duration=pa.float64(), n_cues=pa.int64(), gap=pa.float64())
        for rows, names in ((done, ("doc_id", "seg", "k", "t", "text")), (ends, ("doc_id", "duration", "n_cues", "gap"))):
            if rows:
                held = dict(zip(names, zip(*rows)))
                yield pa.RecordBatch.from_arrays([pa.array(held[n], k) if n in held else pa.nulls(len(rows), k) for n, k in kinds.items()], list(kinds))

    rows = segments(cues, gaps).sortWithinPartitions("doc_id", "pos")  # its windows leave documents whole
    rows = rows.select("doc_id", "seg", F.col("t").cast("double"), "text", F.col("gap").cast("double"))
    return rows.mapInArrow(run, f"doc_id {kind}, seg long, k int, t double, text string, duration double, n_cues long, gap double")


def _cleaned(folded: DataFrame, spoken: bool) -> DataFrame:
    """Each text cleaned once: what reads an exploded column is not moved below it, where it would clean again."""
    steps = (clean_inline, despeak) if spoken else (clean_inline,)
    for clean in steps:
        folded = folded.select(*(c for c in folded.columns if c != "text"), F.explode(F.array(clean(F.col("text")))).alias("text"))
    return folded


def paragraphs(cues: DataFrame, gaps: DataFrame | None = None, max_para: int = 320, keep_ts: bool = False, spoken: bool = True) -> DataFrame:
    """(doc_id, para_no, t, text): segments, cut after the last sentence end where they grow too long, cleaned."""
    folded = _cleaned(_folded(cues, gaps, max_para).filter("k IS NOT NULL").select("doc_id", "seg", "k", "t", "text"), spoken).filter("text <> ''")
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "k")) - 1
    said = F.concat(F.lit("["), fmt_ts(F.col("t")), F.lit("] "), F.col("text")) if keep_ts else F.col("text")
    return folded.select("doc_id", no.alias("para_no"), "t", said.alias("text"))


def transcript_stats(cues: DataFrame, paras: DataFrame | None = None, max_para: int = 320) -> DataFrame:
    """Duration, counts, average paragraph length (rounded down) and gap by document.

    Without paras the statistics are those of paragraphs(cues, max_para=max_para), which are made on the way: cues are read and dealt out once.
    """
    sums = (F.count(F.when(F.col("text") != "", 1)).alias("n_paras"), F.sum(F.when(F.col("text") != "", F.char_length("text"))).alias("_chars"))
    if paras is None:
        once = [F.max(c).alias(c) for c in ("duration", "n_cues", "gap")]
        out = _cleaned(_folded(cues, None, max_para).select("doc_id", "text", "duration", "n_cues", "gap"), True).groupBy("doc_id").agg(*once, *sums)
    else:
        whole = (F.max_by("t", "pos") - F.min_by("t", "pos")).alias("duration"), F.count("*").alias("n_cues"), _gap(F.median("_d")).alias("gap")
        c = _steps(cues.filter("doc_id IS NOT NULL")).groupBy("doc_id").agg(*whole)
        out = c.join(paras.groupBy("doc_id").agg(F.count("*").alias("n_paras"), sums[1]), "doc_id", "left")
    out = out.na.fill(0, ["n_paras", "_chars"]).withColumn("avg_len", F.floor(F.col("_chars") / F.greatest("n_paras", F.lit(1))))
    return out.select("doc_id", "duration", "n_cues", "n_paras", "gap", "avg_len")


def extract_text(docs: DataFrame, max_para: int = 320) -> DataFrame:
    """S21, S24 for texts: (doc_id, body): paragraphs of transcripts, the raw text where there are no cues or under 50 characters."""
    p = paragraphs(parse_cues(docs), max_para=max_para).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("para_no", "text"))).alias("p"))
    joined = docs.join(p.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("made")), "doc_id", "left")
    return joined.select("doc_id", F.when(F.char_length("made") >= 50, F.col("made")).otherwise(F.col("text")).alias("body"))
