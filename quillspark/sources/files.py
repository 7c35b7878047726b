"""Readers and writers of note files, and the vault registry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = r"(?i)\.(md|markdown)$"
LINT = r"(?i)\.md$"


def read_files(spark: SparkSession, root: str, pattern: str = NOTE) -> DataFrame:
    """(path, rel, content) of files below root whose names match, none in folders that start with a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    rel = F.regexp_replace("path", r"^.*?" + "(?:" + _quoted(root) + ")/*", "")
    return files.withColumn("rel", rel).filter(F.col("rel").rlike(pattern) & ~F.col("rel").rlike(r"(^|/)\.[^/]*/")).select("path", "rel", "content")


def _quoted(root: str) -> str:
    return r"\Q" + root.removeprefix("file://").rstrip("/") + r"\E"


def strict_text(files: DataFrame) -> DataFrame:
    """UTF-8 text without a leading mark; null where the bytes are no UTF-8."""
    return files.withColumn("text", F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\\x{FEFF}", ""))


def not_utf8(files: DataFrame) -> DataFrame:
    """One finding a file."""
    return strict_text(files).filter("text is null").select(F.col("rel").alias("note_id"), F.lit("error").alias("severity"), F.lit("not_utf8").alias("rule"), F.lit(1).alias("pos"), F.lit("").alias("detail"))


def lenient_text(files: DataFrame, replace: bool = False) -> DataFrame:
    """UTF-8, else GB 18030, else UTF-16; null if none fits, or replacement characters."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(data):
            for name in ("utf-8-sig", "gb18030", "utf-16"):
                try:
                    return bytes(data).decode(name)
                except UnicodeError:
                    pass
            return bytes(data).decode("utf-8", "replace") if replace else None

        return raw.map(one)

    return files.withColumn("text", decode("content"))


def notes_of(files: DataFrame) -> DataFrame:
    """(note_id, rel, stem, text) of decoded files."""
    stem = F.regexp_replace(F.regexp_extract("rel", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return files.filter("text is not null").select(F.col("rel").alias("note_id"), "rel", stem.alias("stem"), "text")


def vault_registry(df: DataFrame, column: str = "value") -> DataFrame:
    """The registry's JSON to (id, name, path, open, rank)."""
    vaults = F.from_json(F.get_json_object(column, "$.vaults"), "map<string, struct<path: string, open: boolean>>")
    v = df.select(F.explode(vaults).alias("id", "v")).select("id", F.coalesce(F.col("v.path"), F.lit("")).alias("path"), F.coalesce(F.col("v.open"), F.lit(False)).alias("open"))
    return v.withColumn("name", F.regexp_extract("path", r"([^/\\]*)[/\\]*$", 1))


def vault_order(vaults: DataFrame) -> DataFrame:
    """Existing ones first, then open ones, then by name (vaults with `exists`)."""
    return vaults.orderBy(F.col("exists").desc(), F.col("open").desc(), "name")


def resolve_vault(vaults: DataFrame, token: str) -> DataFrame:
    """The vault of that path or name, else the only one whose name holds it; no row if none or several do."""
    rank = F.when(F.col("path") == token, 0).when(F.col("name") == token, 1).when(F.contains("name", F.lit(token)), 2)
    hits = vaults.filter("exists").withColumn("_r", rank).filter("_r is not null")
    best = hits.agg(F.min("_r").alias("_b"), F.count_if(F.col("_r") == 2).alias("_n"))
    return hits.crossJoin(F.broadcast(best)).filter((F.col("_r") == F.col("_b")) & ((F.col("_b") < 2) | (F.col("_n") == 1))).orderBy("path").limit(1).drop("_r", "_b", "_n")


def owning_vault(paths: DataFrame, vaults: DataFrame) -> DataFrame:
    """(path, vault): the first vault, in order, that holds the path, else its parent folder. The registry is small."""
    from pyspark.sql import Window

    ranked = vaults.filter("exists").withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("open"), "name")))
    v = F.broadcast(ranked.select(F.col("path").alias("vault"), "_k"))
    held = paths.join(v, F.col("path").startswith(F.concat("vault", F.lit("/")))).groupBy("path").agg(F.min_by("vault", "_k").alias("vault"))
    return paths.join(held, "path", "left").withColumn("vault", F.coalesce("vault", F.regexp_replace("path", r"/[^/]*$", "")))


def with_provenance(results: DataFrame) -> DataFrame:
    """results(name, meta, body) as Markdown under its provenance comments."""
    meta = F.when(F.col("meta") != "", F.concat(F.lit("<!-- "), "meta", F.lit(" -->\n"))).otherwise("")
    return results.select("name", F.concat(F.lit("<!-- 来源: "), "name", F.lit(" -->\n"), meta, F.lit("\n"), "body", F.lit("\n")).alias("text"))


def write_notes(notes: DataFrame, path: str) -> None:
    """notes(note_id, text) as a table, with line feeds only."""
    notes.withColumn("text", F.regexp_replace("text", "\r\n?", "\n")).write.mode("overwrite").parquet(path)


def reader_of(name):
    """Which reader a file name calls for: subtitle, pptx, docx, pdf, image, legacy or unsupported."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    return (
        F.when(ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tif", ".tiff"), "image")
        .when(ext.isin(".ppt", ".doc"), "legacy")
        .when(ext.isin(".pptx", ".docx", ".pdf"), F.substring(ext, 2, 4))
        .when(ext.isin(".srt", ".vtt", ".txt", ".md", ".markdown"), "text")
        .otherwise("unsupported")
    )
