"""Notes as lines: headings, fences, sections, front matter, body text.

notes: (note_id, text). lines: (note_id, pos, line), pos from 0. Notes are dealt out by note_id before they are cut into
lines, so that every window by note runs where its lines are: one shuffle, of whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import LINE_END, WS, strip, strip_md

FENCE = rf"(?U)^{WS}*(```|~~~)"
HEADING = rf"(?U)^(#{{1,6}}){WS}+(.*?){WS}*$"
QUOTE = rf"(?U)^{WS}*(?:>{WS}*)+"
MARK = re.compile(r"(#{1,6})\s")
_TODO, _CALL, _LINKS = re.compile(r"\s*>\s*\[!(?:todo|info)\]", re.I), re.compile(r"\s*>\s*\[!"), re.compile(r"#{1,6}\s*相关链接\s*\Z")
CALLOUT = rf"(?U)^{WS}*>{WS}*\[!([A-Za-z-]+)\][+-]?"


def split_lines(text: Column) -> Column:
    """As an array, without the empty piece after a final line end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines_of(notes: DataFrame) -> DataFrame:
    return notes.repartition("note_id").select("note_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def by_note(*partition: str) -> Window:
    return Window.partitionBy("note_id", *partition).orderBy("pos")


def before(w=None):
    return (w or by_note()).rowsBetween(Window.unboundedPreceding, -1)


def upto(w=None):
    return (w or by_note()).rowsBetween(Window.unboundedPreceding, 0)


def after(w=None):
    return (w or by_note()).rowsBetween(1, Window.unboundedFollowing)


def title_of(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, rf"(?U){WS}*#+{WS}*$", ""))


def toggled_code(lines: DataFrame) -> DataFrame:
    """Adds fence and in_code, where any fence line flips the state."""
    lines = lines.withColumn("fence", F.col("line").rlike(FENCE))
    return lines.withColumn("in_code", F.coalesce(F.sum(F.col("fence").cast("int")).over(before()), F.lit(0)) % 2 == 1)


def matched_code(lines: DataFrame) -> DataFrame:
    """Adds fence, in_code and open_at, where only a fence of the same kind closes; a fold over the fence lines.

    Between two fence lines nothing changes, so the fold runs on fences only, and lines look up the last one's state.
    """
    kind = F.regexp_extract("line", FENCE, 1)
    lines = lines.withColumn("kind", F.when(F.col("line").rlike(FENCE), kind))
    fences = lines.filter("kind is not null").groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("f"))
    step = lambda s, f: F.concat(
        s,
        F.array(
            F.when(
                (F.size(s) == 0) | F.element_at(s, -1)["open"].isNull(),
                F.struct(f["pos"].alias("pos"), f["kind"].alias("open"), f["pos"].alias("at")),
            )
            .when(F.element_at(s, -1)["open"] == f["kind"], F.struct(f["pos"].alias("pos"), F.lit(None).cast("string").alias("open"), F.lit(None).cast("int").alias("at")))
            .otherwise(F.struct(f["pos"].alias("pos"), F.element_at(s, -1)["open"].alias("open"), F.element_at(s, -1)["at"].alias("at")))
        ),
    )
    empty = F.array().cast("array<struct<pos:int,open:string,at:int>>")
    states = fences.select("note_id", F.explode(F.aggregate("f", empty, step)).alias("s")).select("note_id", F.col("s.pos").alias("pos"), F.struct("s.open", "s.at").alias("state"))
    joined = lines.join(states, ["note_id", "pos"], "left")
    state = F.last("state", ignorenulls=True).over(upto())
    joined = joined.withColumn("state", state)
    return joined.select("note_id", "pos", "line", F.col("kind").isNotNull().alias("fence"), F.col("state.open").isNotNull().alias("in_code"), F.col("state.at").alias("open_at"), F.col("state.open").alias("open_kind"))


def headings(notes: DataFrame) -> DataFrame:
    """(note_id, pos, level, title, raw) outside toggled code."""
    h = toggled_code(lines_of(notes)).filter(~F.col("fence") & ~F.col("in_code") & F.col("line").rlike(HEADING))
    return h.select("note_id", "pos", F.char_length(F.regexp_extract("line", HEADING, 1)).alias("level"), title_of(F.regexp_extract("line", HEADING, 2)).alias("title"), F.col("line").alias("raw"))


def outline(notes: DataFrame) -> DataFrame:
    """An indented list of headings."""
    return headings(notes).select("note_id", "pos", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("title")).alias("entry"))


def head(notes: DataFrame, n: int) -> DataFrame:
    """The first n lines."""
    return lines_of(notes).filter(F.col("pos") < n)


def frontmatter_end(notes: DataFrame) -> DataFrame:
    """(note_id, fm_end): lines of the leading --- block, 0 without one. Row-local."""
    trimmed = F.transform(split_lines(F.col("text")), strip)
    shut = F.array_position(F.slice(trimmed, 2, F.greatest(F.size(trimmed), F.lit(1))), "---")
    return notes.select("note_id", F.when((F.get(trimmed, F.lit(0)) == "---") & (shut > 0), shut + 1).otherwise(0).cast("int").alias("fm_end"))


def frontmatter_map(notes: DataFrame) -> DataFrame:
    """(note_id, key, value) of flat front matter; of repeated keys the last; empty values dropped."""
    body = F.regexp_replace("text", rf"(?U)\A{WS}+", "")
    shut = F.locate("\n---", body, 4)
    block = F.when(body.startswith("---") & (shut > 0), F.substr(body, F.lit(4), shut - 4))
    rows = notes.select("note_id", F.posexplode(split_lines(block)).alias("pos", "line"))
    pattern = rf"(?U)^([A-Za-z_][\w-]*){WS}*:{WS}*(.*)$"
    line = strip(F.col("line"))
    rows = rows.filter(line.rlike(pattern)).select("note_id", "pos", F.regexp_extract(line, pattern, 1).alias("key"), F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(line, pattern, 2)), '^"+|"+$', ""), "^'+|'+$", "").alias("value"))
    return rows.filter("value <> ''").groupBy("note_id", "key").agg(F.max_by("value", "pos").alias("value"))


def sections(notes: DataFrame) -> DataFrame:
    """Headings with `end`, the line of the next heading of the same level or above, else the number of lines."""
    n = notes.select("note_id", F.size(split_lines(F.col("text"))).alias("n_lines"))
    h = headings(notes)
    ends = [F.min(F.when(F.col("level") <= k, F.col("pos"))).over(after()) for k in range(1, 7)]
    end = F.coalesce(*[F.when(F.col("level") == k, e) for k, e in enumerate(ends, 1)])
    return h.withColumn("end", end).join(n, "note_id").withColumn("end", F.coalesce("end", "n_lines")).drop("n_lines")


def destutter(lines: DataFrame) -> DataFrame:
    """Lines without those equal, trimmed, to the line before; blank lines stay."""
    t = strip(F.col("line"))
    return lines.withColumn("_t", t).withColumn("_p", F.lag("_t").over(by_note())).filter((F.col("_t") == "") | F.col("_p").isNull() | (F.col("_t") != F.col("_p"))).drop("_t", "_p")


def body_lines(notes: DataFrame) -> DataFrame:
    """P6 (W2, W3): lines of real content: no headings, callout heads, placeholder callouts or related-links section."""
    rows = lines_of(notes).withColumns(
        {
            "is_head": F.col("line").rlike(HEADING),
            "is_todo": F.col("line").rlike(rf"(?iU)^{WS}*>{WS}*\[!(?:todo|info)\]"),
            "is_call": F.col("line").rlike(rf"(?U)^{WS}*>{WS}*\[!"),
            "quoted": F.col("line").rlike(rf"(?U)^{WS}*>"),
        }
    )
    link = F.when(F.col("is_head"), F.col("line").rlike(rf"(?U)^#{{1,6}}{WS}*相关链接{WS}*$"))
    rows = rows.withColumn("in_link", F.coalesce(F.last(link, ignorenulls=True).over(upto()), F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("quoted")).cast("int")).over(upto()))
    rows = rows.withColumn("in_todo", F.max(F.col("is_todo")).over(upto(Window.partitionBy("note_id", "run").orderBy("pos"))) & F.col("quoted"))
    return rows.filter("not is_head and not is_call and not in_link and not in_todo").select("note_id", "pos", "line")


def body_text(notes: DataFrame) -> DataFrame:
    """(note_id, body)."""
    kept = body_lines(notes).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    kept = kept.select("note_id", strip_md(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"))
    return notes.select("note_id").join(kept, "note_id", "left").select("note_id", F.coalesce("body", F.lit("")).alias("body"))


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    m = MARK.match(line)
    if not m:
        return None
    raw = line[m.end(1) :].strip()
    title = raw.rstrip("#")
    return m.end(1), (raw if title == raw else title).strip()


def headings_of(lines: list[str]) -> list[tuple[int, int, str]]:
    """P1 for one note: (pos, level, title) outside toggled code."""
    out, code = [], False
    for k, x in enumerate(lines):
        if ("```" in x or "~~~" in x) and x.lstrip()[:3] in ("```", "~~~"):
            code = not code
        elif not code and x[:1] == "#" and (h := heading_of(x)):
            out.append((k, *h))
    return out


def body_of(lines: list[str]) -> list[str]:
    """P6 (W2, W3) for one note: what body_lines keeps."""
    out, link, todo = [], False, False
    for x in lines:
        if x[:1] == "#" and heading_of(x):
            link, todo = bool(_LINKS.match(x)), False
            continue
        if x.lstrip()[:1] != ">":
            todo = False
            if not link:
                out.append(x)
        else:
            todo = todo or bool(_TODO.match(x))
            if not (link or todo or _CALL.match(x)):
                out.append(x)
    return out


def note_title(notes: DataFrame) -> DataFrame:
    """(note_id, title): the first heading if of level 1, else null (callers put the file's stem)."""
    first = headings(notes).groupBy("note_id").agg(F.min_by(F.struct("level", "title"), "pos").alias("h"))
    return first.select("note_id", F.when(F.col("h.level") == 1, F.col("h.title")).alias("title"))
