"""Slide decks and word-processor files by their XML parts, with the standard library only.

files: (path, content). Each file is one task's work, as a zip archive has to be read whole.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import clean_inline, is_decorative, table_markdown

# XML name spaces.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHAPE = "path string, slide int, idx int, depth int, kind string, top long, left long, is_title boolean, name string, text string, rows array<array<string>>, data binary"


def _parts(archive: zipfile.ZipFile, folder: str) -> list[tuple[int, str]]:
    """Numbered parts in the order of their numbers."""
    found = (re.fullmatch(rf"{folder}(\d+)\.xml", n) for n in archive.namelist())
    return sorted((int(m[1]), m[0]) for m in found if m)


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    at = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if at not in archive.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(posixpath.dirname(part), r.get("Target"))) for r in ET.fromstring(archive.read(at))}


def _text(body) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in body.iter(f"{A}p")) if body is not None else ""


def _rows(table) -> list[list[str]]:
    return [["".join(t.text or "" for t in c.iter(f"{A}t")).replace("\n", " ").strip() for c in r.findall(f"{A}tc")] for r in table.findall(f"{A}tr")]


def _walk(archive, part, tree, related, depth=0):
    """Shapes below tree, groups entered."""
    for el in tree:
        kind = el.tag.removeprefix(P)
        if kind == "grpSp":
            yield from _walk(archive, part, el, related, depth + 1)
            continue
        if kind not in ("sp", "pic", "graphicFrame", "cxnSp"):
            continue
        off = next(el.iter(f"{A}off"), None)
        place = next(el.iter(f"{P}ph"), None)
        name = next((c.get("name") for c in el.iter(f"{P}cNvPr")), None)
        row = {"depth": depth, "top": int(off.get("y")) if off is not None else None, "left": int(off.get("x")) if off is not None else None, "is_title": place is not None and place.get("type") in ("title", "ctrTitle"), "name": name, "text": None, "rows": None, "data": None}
        table = next(el.iter(f"{A}tbl"), None)
        if table is not None:
            yield row | {"kind": "TABLE", "rows": _rows(table)}
        elif kind == "pic":
            blip = next(el.iter(f"{A}blip"), None)
            target = related.get(blip.get(f"{R}embed")) if blip is not None else None
            yield row | {"kind": "PIC", "text": target, "data": archive.read(target) if target in archive.namelist() else None}
        elif (text := _text(el.find(f"{P}txBody"))).strip():
            yield row | {"kind": "TXT", "text": text}
        else:
            yield row | {"kind": "SHAPE"}


def shapes(files: DataFrame) -> DataFrame:
    """Every shape of every slide, pictures with their bytes."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for slide, part in _parts(z, "ppt/slides/slide"):
                        tree = ET.fromstring(z.read(part)).find(f"{P}cSld/{P}spTree")
                        for idx, row in enumerate(_walk(z, part, tree, _related(z, part)) if tree is not None else ()):
                            out.append(row | {"path": path, "slide": slide, "idx": idx})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHAPE.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(run, SHAPE)


def formulas(files: DataFrame) -> DataFrame:
    """(path, slide, k, tex): the linear text of each formula."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for slide, part in _parts(z, "ppt/slides/slide"):
                        found = ("".join(t.text or "" for t in m.iter(f"{M}t")).strip() for m in ET.fromstring(z.read(part)).iter(f"{M}oMath"))
                        out += [(path, slide, k, t) for k, t in enumerate(x for x in found if x)]
            yield pd.DataFrame(out, columns=["path", "slide", "k", "tex"])

    return files.select("path", "content").mapInPandas(run, "path string, slide int, k int, tex string")


def speaker_notes(files: DataFrame) -> DataFrame:
    """S10, notes: (path, slide, notes)."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for slide, part in _parts(z, "ppt/slides/slide"):
                        for target in _related(z, part).values():
                            if "notesSlide" in target and target in z.namelist():
                                bodies = [s for s in ET.fromstring(z.read(target)).iter(f"{P}sp") if any(p.get("type") == "body" for p in s.iter(f"{P}ph"))]
                                out.append((path, slide, "\n".join(_text(s.find(f"{P}txBody")) for s in bodies)))
            yield pd.DataFrame(out, columns=["path", "slide", "notes"])

    return files.select("path", "content").mapInPandas(run, "path string, slide int, notes string")


def slide_tables(files: DataFrame) -> DataFrame:
    """(path, slide, idx, markdown): padded Markdown tables."""
    return shapes(files).filter("kind = 'TABLE' and size(rows) > 0").select("path", "slide", "idx", table_markdown(F.col("rows"), pad=True).alias("markdown"))


def pictures(files: DataFrame, tag: str) -> DataFrame:
    """(path, slide, name, kb, data): pictures numbered by slide."""
    n = F.row_number().over(Window.partitionBy("path", "slide").orderBy("idx"))
    p = shapes(files).filter("kind = 'PIC' and data is not null").withColumn("n", n)
    name = F.format_string(f"{tag}_s%02d_%d.%s", "slide", "n", F.regexp_extract("text", r"\.([^.]*)$", 1))
    return p.select("path", "slide", name.alias("name"), F.format_string("%.0f KB", F.length("data") / 1024).alias("kb"), "data")


def slides(files: DataFrame) -> DataFrame:
    """(path, slide, title, body, tables, pics, notes): body lines in the order of top, left; repeats and numbers dropped."""
    s = shapes(files).filter("depth = 0")
    order = F.struct(F.coalesce("top", F.lit(0)).alias("a"), F.coalesce("left", F.lit(0)).alias("b"), F.col("idx").alias("c"))
    texts = s.filter("kind = 'TXT' and not is_title").withColumn("o", order).filter(~is_decorative(clean_inline(F.col("text"))))
    lines = texts.select("path", "slide", "o", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("line", clean_inline(F.col("line"))).filter("line <> ''")
    lines = lines.withColumn("prev", F.lag("line").over(Window.partitionBy("path", "slide").orderBy("o", "k"))).filter("prev is null or prev <> line")
    body = lines.groupBy("path", "slide").agg(F.sort_array(F.collect_list(F.struct("o", "k", "line"))).alias("l")).select("path", "slide", F.transform("l", lambda x: x["line"]).alias("body"))
    title = s.filter("is_title and kind = 'TXT'").groupBy("path", "slide").agg(clean_inline(F.min_by("text", "idx")).alias("title"))
    tables = s.filter("kind = 'TABLE'").groupBy("path", "slide").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), table_markdown(F.col("rows"), pad=False).alias("t")))).alias("l")).select("path", "slide", F.transform("l", lambda x: x["t"]).alias("tables"))
    pics = s.filter("kind = 'PIC'").groupBy("path", "slide").agg(F.sort_array(F.collect_list("name")).alias("pics"))
    notes = speaker_notes(files).withColumn("notes", clean_inline(F.col("notes")))
    out = s.select("path", "slide").distinct()
    for more in (title, body, tables, pics, notes):
        out = out.join(more, ["path", "slide"], "left")
    empty = F.array().cast("array<string>")
    return out.select("path", "slide", F.coalesce("title", F.lit("")).alias("title"), *[F.coalesce(c, empty).alias(c) for c in ("body", "tables", "pics")], F.coalesce("notes", F.lit("")).alias("notes"))


def docx(files: DataFrame) -> DataFrame:
    """(path, pos, text): paragraphs, headings one level down (at most 6), titles as level 1, then tables."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    styles = {}
                    if "word/styles.xml" in z.namelist():
                        for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                            name = s.find(f"{W}name")
                            styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else ""
                    body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
                    for el in body:
                        text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
                        if el.tag == f"{W}p":
                            style = el.find(f"{W}pPr/{W}pStyle")
                            key = style.get(f"{W}val") if style is not None else ""
                            out.append((path, len(out), "p", (styles.get(key, key) or "").lower(), text(el), None))
                        elif el.tag == f"{W}tbl":
                            out.append((path, len(out), "t", "", None, [[" ".join(text(p) for p in c.iter(f"{W}p")) for c in r.findall(f"{W}tc")] for r in el.findall(f"{W}tr")]))
            yield pd.DataFrame(out, columns=["path", "pos", "kind", "style", "raw", "rows"], dtype=object)

    p = files.select("path", "content").mapInPandas(run, "path string, pos int, kind string, style string, raw string, rows array<array<string>>")
    level = F.regexp_extract("style", r"heading\s*(\d)", 1).try_cast("int")
    text = clean_inline(F.col("raw"))
    mark = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(level + 1, F.lit(6))), F.lit(" "))).when(F.contains("style", F.lit("title")), "# ").otherwise("")
    made = F.when(F.col("kind") == "t", table_markdown(F.col("rows"), pad=False)).otherwise(F.when(text != "", F.concat(mark, text)))
    p = p.withColumn("text", made).filter("text is not null and text <> ''")
    no = F.row_number().over(Window.partitionBy("path").orderBy(F.col("kind"), "pos")) - 1
    return p.select("path", no.alias("pos"), "text")
