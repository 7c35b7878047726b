"""Edits to notes: validated inserts, replacements, appends, patches, tables of contents, callout flattening, snapshots.

Every operator returns one row a note with `reason` (null if it applies) and `new_text` (the old text if refused): nothing is
applied in part. Writing the result is the caller's single commit point.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import WS, insert_lines, let, strip, to_note
from quillspark.operators.lines import HEADING, MARK, by_note, heading_of, headings, headings_of, lines_of, sections, split_lines, upto

_NUMBERED = re.compile(r"\A\s*\d+(?:\.\d+)*\.?\s*\[\[#", re.ASCII)
_CONTENTS = ("目录", "Contents", "Table of Contents")
CALLOUT_HEAD = r"^> \[!([A-Za-z-]+)\]([+-]?)(?U:\s*)(.*)$"


def insert(notes: DataFrame, ops: DataFrame, allow_duplicate: bool = False) -> DataFrame:
    """M1: ops(note_id, anchor, at, content), at in (end-of-section, after-heading). Adds `rule_line`: it follows a --- line."""
    anchor = strip(F.col("anchor"))
    base = notes.join(ops, "note_id").withColumn("lines", split_lines(F.col("text")))
    base = base.withColumn("hits", F.size(F.filter("lines", lambda x: strip(x) == strip(F.col("anchor")))))
    found = sections(notes).join(ops.select("note_id", "anchor"), "note_id")
    exact = (strip(F.col("raw")) == anchor) | (F.col("title") == anchor)
    found = found.withColumn("rank", F.when(exact, 0).when((anchor != "") & F.contains("title", anchor), 1)).filter("rank is not null")
    spot = found.groupBy("note_id").agg(F.min(F.struct("rank", "pos", "end")).alias("s")).select("note_id", "s.pos", "s.end")
    fresh = headings(ops.select("note_id", F.col("content").alias("text"))).select("note_id", "title")
    dup = fresh.join(headings(notes).select("note_id", "title").distinct(), ["note_id", "title"], "left_semi").select("note_id").distinct().withColumn("dup", F.lit(True))
    b = base.join(spot, "note_id", "left").join(dup, "note_id", "left")
    section = F.slice("lines", F.col("pos") + 2, F.greatest(F.col("end") - F.col("pos") - 1, F.lit(0)))
    full = F.transform(section, lambda x, i: F.when(strip(x) != "", i + 1).otherwise(0))
    at = F.when(F.col("at") == "end-of-section", F.col("pos") + 1 + F.coalesce(F.array_max(full), F.lit(0))).otherwise(F.col("pos") + 1)
    reason = F.when(strip(F.col("content")) == "", "empty content").when(F.col("hits") > 1, "anchor is ambiguous").when(F.col("pos").isNull(), "anchor not found")
    if not allow_duplicate:
        reason = reason.when(F.col("dup"), "heading exists")
    b = b.withColumn("reason", reason).withColumn("_at", at)
    new = F.when(F.col("reason").isNull(), to_note(insert_lines(F.col("lines"), F.col("_at"), F.col("content")))).otherwise(F.col("text"))
    rule = F.coalesce(F.col("reason").isNull() & (strip(F.get("lines", F.col("_at") - 1)) == "---"), F.lit(False))
    return b.select("note_id", "reason", new.alias("new_text"), rule.alias("rule_line"))


def replace(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """M2: ops(note_id, anchor, until, content): from the anchor line to the first line holding `until`, or to the next peer heading.

    The peer heading is found without regard to code. Adds `split_callout` (M11): a callout is cut by a blank line afterwards.
    """
    b = notes.join(ops, "note_id").withColumn("lines", split_lines(F.col("text")))
    b = b.withColumn("mid", split_lines(F.regexp_replace("content", r"\A\n+|\n+\z", "")))
    same = F.transform("lines", lambda x: strip(x) == strip(F.col("anchor")))
    b = b.withColumns({"hits": F.size(F.filter(same, lambda x: x)), "start": F.when(F.col("anchor").isNull(), 0).otherwise(F.array_position(same, True) - 1).cast("int")})
    level = lambda x: F.char_length(F.regexp_extract(x, HEADING, 1))
    own = F.when(level(F.get("lines", "start")) > 0, level(F.get("lines", "start"))).otherwise(6)
    b = b.withColumn("own", own)
    tail = F.slice("lines", F.col("start") + 1, F.size("lines"))
    stop = F.array_position(F.transform(tail, lambda x: F.contains(x, strip(F.col("until")))), True)
    peer = F.array_position(F.transform(tail, lambda x, i: (i > 0) & (level(x) > 0) & (level(x) <= F.col("own"))), True)
    block = F.slice(tail, F.lit(1), F.when(peer > 0, peer - 1).otherwise(F.size(tail)).cast("int"))
    filled = F.array_max(F.transform(block, lambda x, i: F.when((strip(x) != "") | (i == 0), i).otherwise(0)))
    b = b.withColumn("stop", F.when(F.col("until").isNotNull(), F.when(stop > 0, F.col("start") + stop - 1)).otherwise(F.col("start") + filled).cast("int"))
    reason = F.when(F.size("mid") == 0, "empty content").when(F.array_join("mid", "") == "", "empty content").when(F.col("anchor").isNotNull() & (F.col("hits") == 0), "anchor not found").when(F.col("anchor").isNotNull() & (F.col("hits") > 1), "anchor is ambiguous").when(F.col("stop").isNull(), "end not found")
    none = F.array().cast("array<string>")
    prefix = F.when(F.col("start") > 0, F.slice("lines", F.lit(1), F.greatest(F.col("start"), F.lit(1)))).otherwise(none)
    rest = F.slice("lines", F.col("stop") + 2, F.size("lines"))
    first = F.array_position(F.transform(rest, lambda x: strip(x) != ""), True)
    suffix = F.when(first > 0, F.slice(rest, first.cast("int"), F.size(rest))).otherwise(none)
    b = b.withColumns({"reason": reason, "prefix": prefix, "suffix": suffix})
    quoted = lambda x: F.coalesce(F.ltrim(x).startswith(">"), F.lit(False))
    inside = quoted(F.try_element_at("prefix", F.lit(-1))) & quoted(F.try_element_at("suffix", F.lit(1)))
    gap = F.when((F.size("suffix") > 0) & ~inside, F.array(F.lit(""))).otherwise(none)
    new = F.when(F.col("reason").isNull(), F.concat(F.array_join(F.concat("prefix", "mid", gap, "suffix"), "\n"), F.lit("\n"))).otherwise(F.col("text"))
    return b.select("note_id", "reason", new.alias("new_text")).withColumn("split_callout", splits_callout(F.col("new_text")))


def splits_callout(text: Column) -> Column:
    """A blank line between quote lines, the second no callout head."""
    def cut(l):
        n = F.size(l)
        at = lambda i: F.get(l, i)
        return F.exists(F.sequence(F.lit(0), n), lambda i: (i > 0) & (i < n - 1) & (strip(at(i)) == "") & F.coalesce(at(i - 1).startswith(">"), F.lit(False)) & F.coalesce(at(i + 1).startswith(">") & ~at(i + 1).startswith("> [!"), F.lit(False)))

    return let(split_lines(text), cut)


def append(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """M3: ops(note_id, content), after one empty line; to an empty note the content itself."""
    trim = lambda c, p: F.regexp_replace(c, p, "")
    joined = F.concat(trim(F.col("text"), r"\n+\z"), F.lit("\n\n"), trim(F.col("content"), r"\A\n+|\n+\z"), F.lit("\n"))
    return notes.join(ops, "note_id").select("note_id", F.lit(None).cast("string").alias("reason"), F.when(F.col("text") == "", F.col("content")).otherwise(joined).alias("new_text"))


def new_notes(existing: DataFrame, wanted: DataFrame, today: str) -> DataFrame:
    """wanted(note_id, title, tags array) that do not exist yet, with front matter and heading."""
    text = F.concat(F.lit("---\ntags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), ""), F.lit(f"created: {today}\n---\n\n# "), F.col("title"), F.lit("\n"))
    return wanted.join(existing.select("note_id"), "note_id", "left_anti").select("note_id", text.alias("text"))


def parse_edits(docs: DataFrame) -> DataFrame:
    """M4: docs(note_id, text) in conflict-marker form to edits(note_id, edit_no, old, new); malformed texts give old = null."""
    block = r"(?m)^[ \t]*<<<<<<< OLD[ \t]*\n((?:(?!^[ \t]*=======[ \t]*$).*\n)*?)[ \t]*=======[ \t]*\n((?:(?!^[ \t]*>>>>>>> NEW[ \t]*$).*\n)*?)[ \t]*>>>>>>> NEW[ \t]*$"
    text = F.regexp_replace("text", "\r\n?", "\n")
    bad = strip(F.regexp_replace(text, block, "")) != ""
    made = docs.select("note_id", bad.alias("bad"), F.regexp_extract_all(text, F.lit(block), 1).alias("o"), F.regexp_extract_all(text, F.lit(block), 2).alias("n"))
    each = made.select("note_id", "bad", F.posexplode_outer(F.arrays_zip("o", "n")).alias("edit_no", "e"))
    cut = lambda c: F.regexp_replace(c, r"\n\z", "")
    return each.select("note_id", F.coalesce("edit_no", F.lit(0)).alias("edit_no"), F.when(~F.col("bad"), cut(F.col("e.o"))).alias("old"), F.when(~F.col("bad"), cut(F.col("e.n"))).alias("new"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; of the empty string one more than the characters."""
    return F.when(part == "", F.char_length(text) + 1).otherwise((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.greatest(F.char_length(part), F.lit(1))).cast("long")


def patch(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """M4: edits(note_id, edit_no, old, new), all or none: each old text once, none overlapping; adds `failed`, edit numbers."""
    e = notes.join(edits, "note_id").withColumn("hits", F.when(F.col("old").isNotNull(), occurrences(F.col("text"), F.col("old"))))
    e = e.withColumn("at", F.when(F.col("hits") == 1, F.position("old", "text")))
    w = Window.partitionBy("note_id").orderBy("at", "edit_no")
    end = F.col("at") + F.char_length("old")
    e = e.withColumn("before", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = e.groupBy("note_id").agg(
        F.first("text").alias("text"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(F.col("hits") == 1, F.lit(False)), F.col("edit_no")))).alias("failed"),
        F.max(F.coalesce(F.col("at") < F.col("before"), F.lit(False))).alias("overlap"),
        F.sort_array(F.collect_list(F.struct("at", end.alias("end"), "new"))).alias("spots"),
    )
    step = lambda s, x: F.struct(F.concat(s["out"], F.substr(F.col("text"), s["next"], F.greatest(x["at"] - s["next"], F.lit(0))), x["new"]).alias("out"), x["end"].alias("next"))
    made = F.aggregate("spots", F.struct(F.lit("").alias("out"), F.lit(1).alias("next")), step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["next"], F.char_length("text") + 1)))
    reason = F.when(F.size("failed") > 0, "not found once").when(F.col("overlap"), "edits overlap")
    return g.withColumn("reason", reason).select("note_id", "reason", F.when(F.col("reason").isNull(), made).otherwise(F.col("text")).alias("new_text"), "failed")


def first_bad_line(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """for old texts of several lines that do not occur: how many leading lines do once, and the first that breaks off."""
    e = notes.join(edits.select("note_id", "edit_no", "old"), "note_id").filter(F.contains("old", F.lit("\n")) & (occurrences(F.col("text"), F.col("old")) == 0))
    ok = lambda k: occurrences(F.col("text"), F.array_join(F.slice(F.split("old", "\n"), F.lit(1), k), "\n")) == 1
    bad = F.array_position(F.transform(F.sequence(F.lit(1), F.size(F.split("old", "\n"))), ok), False)
    return e.withColumn("good", (bad - 1).cast("int")).filter("good > 0").select("note_id", "edit_no", "good", F.get(F.split("old", "\n"), "good").alias("breaks_at"))


def closest_lines(notes: DataFrame, needles: DataFrame, top: int = 2, floor: float = 0.6) -> DataFrame:
    """needles(note_id, needle): the note's lines most like it by longest matching blocks, at `floor` or more.

    A needle that stands in the text once its lines' leading marks (quote, list, number) are gone gives that line alone, with ratio 1.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)

    asked = needles.withColumn("key", strip(F.col("needle"))).filter("key <> ''")
    bare = strip(F.array_join(F.transform(split_lines(F.col("needle")), lambda x: F.regexp_replace(x, r"(?U)^\s*(?:>\s?|[-*+]\s|\d+[.、]\s)", "")), "\n"))
    inside = notes.join(asked.withColumn("_bare", bare).filter("_bare <> '' and _bare <> key"), "note_id").withColumn("_at", F.position("_bare", "text")).filter("_at > 0")
    lead = F.substr("text", F.lit(1), F.col("_at") - 1)
    line_no = (F.char_length(lead) - F.char_length(F.replace(lead, F.lit("\n"), F.lit(""))) + 1).cast("int")
    inside = inside.withColumn("line_no", line_no).select("note_id", "needle", F.lit(1).alias("rank"), "line_no", strip(F.get(F.split("text", "\n"), F.col("line_no") - 1)).alias("s"), F.lit(1.0).alias("ratio"))
    rows = lines_of(notes).withColumn("s", strip(F.col("line"))).filter("s <> ''").join(asked.join(inside, ["note_id", "needle"], "left_anti"), "note_id")
    # the ratio is at most twice the shorter length over the sum: most lines need no comparison
    n, m = F.char_length("key"), F.char_length("s")
    scored = rows.filter(2 * F.least(n, m) >= floor * (n + m)).withColumn("ratio", ratio("key", "s")).filter(F.col("ratio") >= floor)
    w = Window.partitionBy("note_id", "needle").orderBy(F.desc("ratio"), "pos")
    scored = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return scored.select("note_id", "needle", "rank", (F.col("pos") + 1).alias("line_no"), "s", "ratio").unionByName(inside)


def flat_toc(notes: DataFrame, exclude: str | None = None) -> DataFrame:
    """Entries N. and N.M of level 2 and 3 headings, in order; a deeper counter restarts below each shallower heading."""
    h = headings(notes).filter(F.col("level").isin(2, 3) & ~F.col("title").isin(*_CONTENTS) & ~F.col("title").startswith("<!--"))
    if exclude:
        h = h.filter(~F.col("title").rlike(exclude))
    w = by_note().rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("major", F.count_if(F.col("level") == 2).over(w))
    h = h.withColumn("minor", F.count_if(F.col("level") == 3).over(Window.partitionBy("note_id", "major").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.when(F.col("level") == 2, F.concat("major", F.lit("."))).when(F.col("major") == 0, F.concat("minor", F.lit("."))).otherwise(F.concat("major", F.lit("."), "minor"))
    indent = F.when(F.col("level") == 3, "  ").otherwise("")
    return h.select("note_id", "pos", F.concat(indent, number, F.lit(" [[#"), "title", F.lit("]]")).alias("entry"))


def grouped_toc(notes: DataFrame, group_level: int | DataFrame, after_pos: DataFrame | None = None, exclude: str | None = None, section: str = "目录") -> DataFrame:
    """(note_id, pos, entry): group headings and items numbered through; groups without items are left out.

    group_level: one for all notes, or (note_id, group_level), which also picks the notes.
    after_pos(note_id, cut): only headings below line `cut` count; without it, those below a leading level 1 heading.
    """
    h = headings(notes)
    if after_pos is None:
        after_pos = h.groupBy("note_id").agg(F.min_by(F.struct("pos", "level"), "pos").alias("f")).select("note_id", F.when(F.col("f.level") == 1, F.col("f.pos")).otherwise(-1).alias("cut"))
    h = h.join(after_pos, "note_id").filter((F.col("pos") > F.col("cut")) & (F.col("title") != section) & ~F.col("title").startswith("<!--"))
    h = h.join(group_level, "note_id") if isinstance(group_level, DataFrame) else h.withColumn("group_level", F.lit(group_level))
    group = F.col("group_level")
    out = F.col("title").rlike(exclude) if exclude else F.lit(False)
    # what opens (its title) or closes (null) a group
    mark = F.when((F.col("level") == group) & ~out, F.struct(F.col("pos").alias("g"))).when((F.col("level") < group) | (out & (F.col("level") <= group)), F.struct(F.lit(None).cast("int").alias("g")))
    h = h.withColumn("g", F.last(mark, ignorenulls=True).over(upto()).getField("g"))
    items = h.filter((F.col("level") == group + 1) & ~out & F.col("g").isNotNull())
    items = items.withColumn("n", F.row_number().over(by_note()))
    heads = h.filter((F.col("level") == group) & (F.col("g") == F.col("pos"))).join(items.select("note_id", "g").distinct(), ["note_id", "g"], "left_semi")
    return heads.select("note_id", "pos", F.concat(F.lit("### "), "title").alias("entry")).unionByName(items.select("note_id", "pos", F.concat(F.col("n").cast("string"), F.lit(". [[#"), "title", F.lit("]]")).alias("entry")))


def toc_block(notes: DataFrame, section: str = "目录") -> DataFrame:
    """W4 for the contents section: (note_id, pos, level, end), the first heading of that title."""
    s = sections(notes).filter(F.col("title") == section)
    return s.withColumn("_k", F.row_number().over(by_note())).filter("_k = 1").select("note_id", "pos", "level", "end")


def toc_style(notes: DataFrame, section: str = "目录") -> DataFrame:
    """(note_id, style, group_level): absent, grouped, flat or unknown."""
    block = toc_block(notes, section).withColumnsRenamed({"pos": "toc", "level": "toc_level"})
    inside = lines_of(notes).join(block, "note_id").filter("pos > toc and pos < end").withColumn("s", strip(F.col("line")))
    titles = inside.filter(F.col("s").rlike(HEADING)).select("note_id", "pos", "end", strip(F.regexp_replace(F.regexp_extract("s", HEADING, 2), r"\s*#+\s*$", "")).alias("title"))
    later = headings(notes).join(block.select("note_id", "end"), "note_id").filter("pos >= end").groupBy("note_id", "title").agg(F.max_by("level", "pos").alias("level"))
    groups = titles.join(later, ["note_id", "title"], "left").groupBy("note_id").agg(F.min_by("level", F.when(F.col("level").isNotNull(), F.col("pos"))).alias("group_level"))
    item = F.contains("line", F.lit("[["))
    counts = inside.groupBy("note_id").agg(F.count_if(item).alias("items"), F.count_if(item & F.col("line").rlike(r"^\s*\d+(?:\.\d+)*\.?\s*\[\[#")).alias("numbered"))
    out = notes.select("note_id").join(block.select("note_id", "toc"), "note_id", "left").join(groups.withColumn("has", F.lit(True)), "note_id", "left").join(counts, "note_id", "left")
    style = F.when(F.col("toc").isNull(), "absent").when(F.col("has"), F.when(F.col("group_level").isNotNull(), "grouped").otherwise("unknown")).when((F.col("items") > 0) & (F.col("items") == F.col("numbered")), "flat").otherwise("unknown")
    return out.select("note_id", style.alias("style"), "group_level")


def _toc_style(lines: list[str], heads: list[tuple[int, int, str]], toc: int, end: int) -> tuple[str, int | None]:
    """W15 for the contents section from line toc to line end."""
    inside = lines[toc + 1 : end]
    titles = [h[1] for h in (heading_of(x.strip()) for x in inside) if h]
    if titles:
        later = {title: level for pos, level, title in heads if pos >= end}
        level = next((later[t] for t in titles if t in later), None)
        return ("unknown" if level is None else "grouped"), level
    items = [x for x in inside if "[[" in x]
    return ("flat" if items and all(map(_NUMBERED.search, items)) else "unknown"), None


def _flat_entries(heads: list[tuple[int, int, str]], skip: set[str]) -> list[str]:
    """W13 for one note."""
    out, major, minor = [], 0, 0
    for _, level, title in heads:
        if level not in (2, 3) or title in _CONTENTS or title.startswith("<!--") or title in skip:
            continue
        major, minor = (major + 1, 0) if level == 2 else (major, minor + 1)
        out.append(f"{major}. [[#{title}]]" if level == 2 else f"  {major}.{minor} [[#{title}]]" if major else f"  {minor}. [[#{title}]]")
    return out


def _grouped_entries(heads: list[tuple[int, int, str]], group: int, cut: int, section: str, skip: set[str]) -> list[str]:
    """W14 for one note, with an empty line before every group but the first."""
    out, title_of_group, open_group, n = [], None, False, 0
    for pos, level, title in heads:
        if pos <= cut or title == section or title.startswith("<!--"):
            continue
        if level <= group:
            open_group = level == group and title not in skip
            title_of_group = title if open_group else None
        elif level == group + 1 and title not in skip and open_group:
            if title_of_group is not None:
                out += ["", f"### {title_of_group}"] if out else [f"### {title_of_group}"]
                title_of_group = None
            n += 1
            out.append(f"{n}. [[#{title}]]")
    return out


def _new_toc(text: str | None, section: str, skip: set[str]) -> tuple[str | None, str | None]:
    """M5 for one note: reason and text."""
    lines = (text or "").splitlines()
    heads = headings_of(lines)
    found = next(((pos, level) for pos, level, title in heads if title == section), None)
    if not found:
        return "no contents section", text
    toc, own = found
    end = next((pos for pos, level, _ in heads if pos > toc and level <= own), len(lines))
    style, group = _toc_style(lines, heads, toc, end)
    if style == "unknown":
        return "unknown style", text
    made = _flat_entries(heads, skip) if style == "flat" else _grouped_entries(heads, group, toc, section, skip)
    if not made:
        return "no headings", text

    def owned(x):
        s = x.strip()
        return not s or "[[" in x or ((h := MARK.match(s)) and h.end(1) > own)

    after = next((k for k in range(toc + 1, end) if not owned(lines[k])), end)
    first = next((k for k in range(after, len(lines)) if lines[k].strip()), len(lines))
    return None, "\n".join([*lines[: toc + 1], "", *made, "", *lines[first:]]).rstrip("\n") + "\n"


def rebuild_toc(notes: DataFrame, section: str = "目录", exclude: str | None = None) -> DataFrame:
    """M5 (W16): the contents section rebuilt in its own style, or a refusal: (note_id, reason, new_text). Row-local: no shuffle without `exclude`."""
    kind = notes.schema["note_id"].dataType.simpleString()
    rows = notes.select("note_id", "text")
    if exclude:  # titles are matched where `exclude` is written for
        out = headings(notes).filter(F.col("title").rlike(exclude)).groupBy("note_id").agg(F.collect_set("title").alias("skip"))
        rows = rows.join(out, "note_id", "left")

    def run(batches):
        for b in batches:
            skips = b.column(2).to_pylist() if exclude else [None] * b.num_rows
            made = [_new_toc(x.as_py(), section, set(skip or ())) for x, skip in zip(b.column(1), skips)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], pa.string()) for k in (0, 1))], ["note_id", "reason", "new_text"])

    return rows.mapInArrow(run, f"note_id {kind}, reason string, new_text string")


def list_callouts(notes: DataFrame) -> DataFrame:
    """M7: (note_id, pos, kind, title, h2, h3): callout heads with their sections; lines are cut at line feeds only."""
    l = notes.repartition("note_id").select("note_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    level, title = F.char_length(F.regexp_extract("line", r"^(#{2,4})\s+(.*?)\s*$", 1)), F.regexp_extract("line", r"^(#{2,4})\s+(.*?)\s*$", 2)
    l = l.withColumns({"lv": level, "ti": title})
    h2 = F.last(F.when(F.col("lv") == 2, F.col("ti")), ignorenulls=True).over(upto())
    h3 = F.last(F.when(F.col("lv") == 2, F.lit("")).when(F.col("lv") > 2, F.col("ti")), ignorenulls=True).over(upto())
    l = l.withColumns({"h2": F.coalesce(h2, F.lit("")), "h3": F.coalesce(h3, F.lit(""))})
    return l.filter(F.col("line").rlike(CALLOUT_HEAD)).select("note_id", "pos", F.regexp_extract("line", CALLOUT_HEAD, 1).alias("kind"), strip(F.regexp_extract("line", CALLOUT_HEAD, 3)).alias("title"), "h2", "h3")


def flatten_callouts(notes: DataFrame, kinds: list[str], plain: bool = False, at: DataFrame | None = None) -> DataFrame:
    """M6: callouts of these kinds, and those whose heads stand at lines at(note_id, line_no), as plain text: (note_id, reason, new_text).

    Short titles become bold, blank ends go. A note asked for a line that is no callout's head is refused whole.
    """
    l = notes.repartition("note_id").select("note_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    is_head, quoted = F.col("line").rlike(CALLOUT_HEAD), F.col("line").startswith(">")
    target = is_head & F.lower(F.regexp_extract("line", CALLOUT_HEAD, 1)).isin(*[k.lower() for k in kinds])
    refused = notes.select("note_id").limit(0)
    if at is not None:
        asked = at.select("note_id", (F.col("line_no") - 1).alias("pos"), F.lit(True).alias("_asked")).distinct()
        l = l.join(asked, ["note_id", "pos"], "left")
        target = target | (is_head & F.coalesce("_asked", F.lit(False)))
        refused = asked.join(l.filter(is_head).select("note_id", "pos"), ["note_id", "pos"], "left_anti").select("note_id").distinct()
    # a target opens a block; a line without a quote mark ends it; other callouts inside stay part of its body
    l = l.withColumn("run", F.sum((~quoted).cast("int")).over(upto())).withColumn("target", target)
    l = l.withColumn("blk", F.when(quoted, F.max(F.when(F.col("target"), F.col("pos"))).over(upto(Window.partitionBy("note_id", "run").orderBy("pos")))))
    w = Window.partitionBy("note_id", "blk")
    body = F.regexp_replace("line", rf"^>{WS}?", "")
    l = l.withColumn("body", F.when(F.col("blk").isNotNull() & ~F.col("target"), body))
    full = F.when(strip(F.col("body")) != "", F.col("pos"))
    l = l.withColumns({"lo": F.min(full).over(w), "hi": F.max(full).over(w)})
    title = strip(F.regexp_extract("line", CALLOUT_HEAD, 3))
    shown = F.when((title != "") & F.lit(not plain), F.when((F.char_length(title) <= 30) & ~F.contains(title, F.lit("。")), F.concat(F.lit("**"), title, F.lit("**"))).otherwise(title))
    line = F.when(F.col("blk").isNull(), F.col("line")).when(F.col("target"), shown).when(F.col("pos").between(F.col("lo"), F.col("hi")), F.col("body"))
    rows = l.select("note_id", "pos", line.alias("line")).filter("line is not null")
    made = rows.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    made = made.select("note_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("_new"))
    out = notes.join(made, "note_id", "left").join(refused.withColumn("_no", F.lit(True)), "note_id", "left")
    return out.select("note_id", F.when(F.col("_no"), "no callout at that line").alias("reason"), F.when(F.col("_no"), F.col("text")).otherwise(F.coalesce("_new", F.lit(""))).alias("new_text"))


def take_snapshots(snapshots: DataFrame, notes: DataFrame, stamp: str) -> DataFrame:
    """M8: new rows (note_id, stamp, seq, text, sha) for notes whose newest snapshot differs; seq counts up within a stamp."""
    newest = latest_snapshots(snapshots).select("note_id", F.col("sha").alias("_sha"))
    used = snapshots.filter(F.col("stamp") == stamp).groupBy("note_id").agg(F.max("seq").alias("_seq"))
    now = notes.select("note_id", F.lit(stamp).alias("stamp"), "text", F.sha2("text", 256).alias("sha")).join(newest, "note_id", "left").join(used, "note_id", "left")
    return now.filter("_sha is null or _sha <> sha").select("note_id", "stamp", (F.coalesce("_seq", F.lit(0)) + 1).alias("seq"), "text", "sha")


def latest_snapshots(snapshots: DataFrame, stamp: str | None = None) -> DataFrame:
    """O7, M9 restore: the newest snapshot of each note, or the newest of one stamp."""
    s = snapshots.filter(F.col("stamp") == stamp) if stamp else snapshots
    return s.groupBy("note_id").agg(F.max(F.struct("stamp", "seq", "text", "sha")).alias("s")).select("note_id", "s.*")


def stale_snapshots(snapshots: DataFrame, keep: int) -> DataFrame:
    """U4, M9 prune: all but the newest `keep` of each note."""
    w = Window.partitionBy("note_id").orderBy(F.desc("stamp"), F.desc("seq"))
    return snapshots.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") > keep).drop("_k")


def diff_preview(old: DataFrame, new: DataFrame, context: int = 2, most: int = 120) -> DataFrame:
    """(note_id, diff): the first lines of a unified diff of old(note_id, text) and new(note_id, new_text)."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(list(difflib.unified_diff(x.splitlines(), y.splitlines(), "before", "after", lineterm="", n=context))[:most]) for x, y in zip(a, b)])

    return old.join(new, "note_id").filter(F.col("text") != F.col("new_text")).select("note_id", diff("text", "new_text").alias("diff"))
