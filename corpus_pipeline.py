"""A corpus pipeline of five stages; each works on what its predecessor wrote.

Language ID drops documents without a language, near-dedup keeps one document of each group, decontamination drops documents that
hold a benchmark window, PII replaces entities in the texts, mixing takes documents towards the sources' target weights.

Defined cases, for every stage: rows are decided one by one, never by a doc_id that several share or that is null; null and empty texts
have no language, so language ID drops them, and the later stages keep them as they are (mixing takes no row without words); rows equal in
every column are one document to near-dedup and documents of their own to the others; an empty table gives an empty one; further columns
pass through whatever their names, but where mixing's own columns (size, source_size, target, taken) replace those of such a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, mixing, neardup, pii
from quillspark.llm.common import materialize, table, unused
from quillspark.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language stay: neither `und` nor ambiguous. The model learns from the labelled rows among them."""
    ship(spark)
    names = [unused(docs, f"_{n}") for n in ("language", "score", "ambiguous")]
    found = langid.identify(docs, langid.train(docs), names=names)
    return found.filter((F.col(names[0]) != "und") & ~F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id stays (null last; of one doc_id that with the least text hash); of rows
    equal in id and text the first by a hash of all columns. Texts without words are in no group."""
    ship(spark)
    found = neardup.near_duplicates(docs).filter("first").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    id_, hash_, row = (unused(docs, f"_{n}") for n in ("id", "hash", "row"))
    keyed = docs.select(F.col("doc_id").cast("long").alias(id_), F.xxhash64("text").alias(hash_), F.struct(*docs.columns).alias(row))
    held = keyed.join(found, F.col(id_).eqNullSafe(F.col("_d")) & (F.col(hash_) == F.col("_t")), "left_semi")
    worded = neardup.has_words(F.col(row)["text"])
    one = held.filter(worded).groupBy(id_, hash_).agg(F.min_by(row, F.to_json(row)).alias(row))
    return one.select(f"{row}.*").unionByName(held.filter(~worded).select(f"{row}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go, each judged by its own text."""
    ship(spark)
    hits = decontam.PhraseIndex(docs, table(spark, sf_dir, "benchmark")).phrase_hits()
    names = [unused(docs, f"_{n}") for n in ("k", "t")]
    dirty = hits.select(F.col("k").alias(names[0]), F.col("t").alias(names[1])).distinct()
    return docs.withColumns(dict(zip(names, decontam.row_key()))).join(dirty, names, "left_anti").select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts become surrogates; n_chars follows."""
    ship(spark)
    new = pii.replace_pii(docs, pii.session_key(spark), entities=None)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast("long"))
    return new.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's target, and the words taken (repeats counted)."""
    ship(spark)
    taken = mixing.mix(docs, mixing.word_count(F.col("text")), carry=True).filter("taken > 0")
    made = ["size", "source_size", "target", "taken"]
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return taken.select(*own, *made)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", replace_private),
    ("mixing", mix_sources),
]
#: Language ID, PII and near-dedup have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
