"""Quality rules over notes, each a DataFrame of findings (note_id, severity, rule, pos, detail); pos counts lines from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import WS, rstrip, squeeze, strip
from quillspark.operators.lines import CALLOUT, HEADING, QUOTE, after, by_note, frontmatter_end, lines_of, matched_code, split_lines, title_of, upto
from quillspark.operators.markup import emphasis, frontmatter_yaml
from quillspark.storage import materialize

# Callout kinds that are known.
KNOWN_CALLOUTS = (
    "note abstract summary tldr info todo tip hint important success check done question help faq warning caution attention "
    "failure fail missing danger error bug example quote cite definition theorem lemma corollary proposition axiom proof "
    "derivation formula idea insight seealso reference"
).split()
ANCHOR = r"\[\[#([^\]|]+)(?:\|[^\]]*)?\]\]"
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]*)?\]\]"


def _found(df: DataFrame, severity: str, rule: str, pos, detail) -> DataFrame:
    return df.select("note_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), pos.cast("int").alias("pos"), detail.cast("string").alias("detail"))


class Lint:
    """The shared views of a lint run: lines with code state, headings, callouts, table rows."""

    def __init__(self, notes: DataFrame, keep: bool = False):
        """keep: write the lines with their state once, for a run of many rules; else every rule reads the notes."""
        self.notes = notes
        self.code = matched_code(lines_of(notes)).withColumn("bare", F.regexp_replace("line", QUOTE, "")).withColumn("live", ~F.col("fence") & ~F.col("in_code"))
        self.n_lines = notes.select("note_id", F.size(split_lines(F.col("text"))).alias("n_lines"), F.char_length("text").alias("n_chars"))
        if keep:
            self.code = materialize(self.code, "lines")
        h = self.code.filter(F.col("live") & F.col("bare").rlike(HEADING))
        self.headings = h.select("note_id", "pos", F.char_length(F.regexp_extract("bare", HEADING, 1)).alias("level"), title_of(F.regexp_extract("bare", HEADING, 2)).alias("title"), (F.col("bare") != F.col("line")).alias("quoted"))
        c = self.code.filter(F.col("live") & F.col("line").rlike(CALLOUT))
        self.callouts = c.select("note_id", "pos", F.regexp_extract("line", CALLOUT, 1).alias("kind"))

    def fences(self) -> DataFrame:
        """L3: a fence that never closes."""
        last = self.code.groupBy("note_id").agg(F.max_by(F.struct("in_code", "open_at", "open_kind"), "pos").alias("s"))
        return _found(last.filter("s.open_kind is not null"), "error", "fence_open", F.col("s.open_at") + 1, F.col("s.open_kind"))

    def _links(self) -> DataFrame:
        rows = self.code.filter(F.contains("line", F.lit("[[#")))
        return rows.select("note_id", "pos", F.posexplode(F.regexp_extract_all("line", F.lit(ANCHOR), 1)).alias("k", "target")).withColumn("slug", squeeze(F.col("target")))

    def anchors(self) -> DataFrame:
        """L4, L5 (J5, U2): links to no heading; links to headings that stand only in a callout."""
        slugs = self.headings.select("note_id", squeeze(F.col("title")).alias("slug"), "quoted").groupBy("note_id", "slug").agg(F.min("quoted").alias("only_quoted"))
        links = self._links().join(slugs, ["note_id", "slug"], "left")
        dead = _found(links.filter("only_quoted is null"), "error", "dead_anchor", F.col("pos") + 1, F.col("target"))
        return dead.unionByName(_found(links.filter("only_quoted"), "info", "quoted_anchor", F.col("pos") + 1, F.col("target")))

    def duplicate_headings(self) -> DataFrame:
        """L6 (W10): later headings of one level and title."""
        h = self.headings.withColumn("slug", squeeze(F.col("title")))
        w = Window.partitionBy("note_id", "level", "slug").orderBy("pos")
        return _found(h.withColumn("first", F.min("pos").over(w)).filter("pos > first"), "warn", "duplicate_heading", F.col("pos") + 1, F.col("title"))

    def level_jumps(self) -> DataFrame:
        """L7 (W5)."""
        h = self.headings.withColumn("prev", F.lag("level").over(by_note()))
        return _found(h.filter("level > prev + 1"), "warn", "level_jump", F.col("pos") + 1, F.concat(F.lit("H"), F.col("prev"), F.lit(" H"), F.col("level")))

    def table_runs(self) -> DataFrame:
        """Table rows with their run; fences, code and headings neither end nor extend a run."""
        s = strip(F.col("bare"))
        rows = self.code.filter(F.col("live") & ~F.col("bare").rlike(HEADING)).withColumn("s", s)
        rows = rows.withColumn("is_row", F.col("s").startswith("|") & F.col("s").endswith("|"))
        rows = rows.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(upto())).filter("is_row")
        cells = F.split("s", r"(?<!\\)\|")
        edge = lambda k: F.when(strip(F.get(cells, k)) == "", 1).otherwise(0)
        width = F.size(cells) - edge(F.lit(0)) - F.when(F.size(cells) > edge(F.lit(0)), edge(F.size(cells) - 1)).otherwise(0)
        return rows.select("note_id", "pos", "line", "run", width.alias("width"))

    def tables(self) -> DataFrame:
        """L8 (P13): runs of two rows or more with different widths, and whether a formula there holds a pipe."""
        t = self.table_runs().withColumn("math", F.col("line").rlike(r"\$[^$\n]*\|[^$\n]*\$"))
        g = t.groupBy("note_id", "run").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.sort_array(F.collect_set("width")).alias("widths"), F.max("math").alias("math"))
        g = g.filter((F.col("n") > 1) & (F.size("widths") > 1))
        return _found(g, "warn", "table_width", F.col("pos") + 1, F.concat(F.array_join(F.col("widths").cast("array<string>"), ","), F.when(F.col("math"), " math").otherwise("")))

    def callout_kinds(self) -> DataFrame:
        """L9 (J7, P14)."""
        return _found(self.callouts.filter(~F.lower("kind").isin(*KNOWN_CALLOUTS)), "warn", "callout_kind", F.col("pos") + 1, F.col("kind"))

    def callout_density(self) -> DataFrame:
        """L10 (A9): lines a callout, one decimal, in notes of more than 60 lines; the bounds allow for binary rounding."""
        c = self.callouts.groupBy("note_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).join(self.n_lines.filter("n_lines > 60"), "note_id")
        c = c.withColumn("d", F.col("n_lines") / F.col("n"))
        rows = c.filter(F.col("d") <= 19.95)
        return rows.select("note_id", F.when(F.col("d") <= 14.95, "warn").otherwise("info").alias("severity"), F.lit("callout_density").alias("rule"), (F.col("pos") + 1).alias("pos"), F.concat_ws("/", F.col("n_lines"), F.col("n")).alias("detail"))

    def callouts_by_section(self) -> DataFrame:
        """L11 (A10, J14): smallest sections (H4, or H3 without H4) with more than five callouts, question and success paired."""
        h = self.headings.filter(F.col("level").between(2, 4)).withColumn("next", F.lead("level").over(by_note()))
        marks = h.select("note_id", "pos", F.struct("pos", "level", "title", "next").alias("h"), F.lit(None).cast("string").alias("kind"))
        both = marks.unionByName(self.callouts.select("note_id", "pos", F.lit(None).cast(marks.schema["h"].dataType).alias("h"), F.lower("kind").alias("kind")))
        held = both.withColumn("h", F.last("h", ignorenulls=True).over(upto())).filter("kind is not null and h is not null and pos > h.pos")
        held = held.filter("h.level = 4 or (h.level = 3 and not (h.next <=> 4))")
        g = held.groupBy("note_id", "h").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "question").alias("q"), F.count_if(F.col("kind") == "success").alias("s"))
        g = g.withColumn("eff", F.col("n") - F.least("q", "s")).filter("eff > 5")
        return _found(g, "warn", "callouts_by_section", F.col("h.pos") + 1, F.concat_ws(":", "h.title", "eff"))

    def empty_sections(self) -> DataFrame:
        """L14 (W11): headings below level 1 with nothing but blank lines before the next one, unless that is deeper."""
        title = F.when(F.col("live") & F.col("bare").rlike(HEADING), title_of(F.regexp_extract("bare", HEADING, 2)))
        level = F.when(title.isNotNull(), F.char_length(F.regexp_extract("bare", HEADING, 1)))
        # of all lines only headings and others that are not blank matter: a heading's successor says whether anything follows it
        rows = self.code.select("note_id", "pos", title.alias("title"), level.alias("level"), (strip(F.col("line")) != "").alias("full")).filter("full or title is not null")
        h = rows.withColumns({"nl": F.lead(F.struct("level")).over(by_note())}).filter("title is not null")
        h = h.filter((F.col("nl").isNull() | F.col("nl.level").isNotNull()) & (F.col("level") >= 2) & (F.col("title") != "目录") & ~F.coalesce(F.col("nl.level") > F.col("level"), F.lit(False)))
        return _found(h, "info", "empty_section", F.col("pos") + 1, F.col("title"))

    def trailing_space(self) -> DataFrame:
        """L15."""
        return _found(self.code.filter(F.col("live") & (rstrip(F.col("line")) != F.col("line"))), "info", "trailing_space", F.col("pos") + 1, F.lit(""))

    def open_frontmatter(self) -> DataFrame:
        """L1, the native part: front matter without its closing line."""
        first = self.notes.filter(strip(F.get(split_lines(F.col("text")), F.lit(0))) == "---")
        return _found(first.join(frontmatter_end(first).filter("fm_end = 0"), "note_id", "left_semi"), "error", "frontmatter_open", F.lit(1), F.lit(""))

    def math_spans(self) -> DataFrame:
        """(note_id, pos, k, tex): formulas outside code, found left to right on the joined text."""
        blank = self.code.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("fence") | F.col("in_code"), "").otherwise(F.col("line")).alias("l")))).alias("l"))
        text = blank.select("note_id", F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias("t"))
        token = r"\$\$([\s\S]*?)\$\$|\$\$|\$([^$]*)\$|\$"
        parts = F.regexp_extract_all("t", F.lit(rf"[^$]+|{token}"), 0)
        t = text.select("note_id", F.posexplode(parts).alias("k", "part"))
        w = Window.partitionBy("note_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        breaks = F.char_length("part") - F.char_length(F.replace("part", F.lit("\n"), F.lit("")))
        t = t.withColumn("pos", F.coalesce(F.sum(breaks).over(w), F.lit(0))).filter(F.col("part").startswith("$") & (F.char_length("part") > 1))
        shown = F.col("part").rlike(r"\A\$\$[\s\S]*\$\$\z") & (F.char_length("part") >= 4)
        tex = F.when(shown, F.substr("part", F.lit(3), F.char_length("part") - 4)).when(~F.col("part").startswith("$$"), F.substr("part", F.lit(2), F.char_length("part") - 2))
        t = t.withColumn("tex", tex).filter(F.col("tex").isNotNull() & (shown | ~F.contains("tex", F.lit("\n"))))
        return t.select("note_id", F.col("pos").cast("int").alias("pos"), "k", "tex")

    def math(self, commands: DataFrame, environments: DataFrame) -> DataFrame:
        """L12 (J6): macros and environments that are not allowed, by name with first line and count. Lookups: (name)."""
        spans = self.math_spans()
        out = []
        for rule, pattern, allowed in (("math_macro", r"\\([a-zA-Z@]+)", commands), ("math_environment", r"\\(?:begin|end)\s*\{\s*([A-Za-z*]+)\s*\}", environments)):
            names = spans.select("note_id", "pos", F.explode(F.regexp_extract_all("tex", F.lit(pattern), 1)).alias("name"))
            bad = names.join(allowed, "name", "left_anti").groupBy("note_id", "name").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
            out.append(_found(bad, "warn", rule, F.col("pos") + 1, F.concat_ws(":", "name", "n")))
        return out[0].unionByName(out[1])

    def stats(self) -> DataFrame:
        """Lines, characters, headings, tables, wikilinks by note."""
        h = self.headings.groupBy("note_id").agg(F.count("*").alias("n_headings"))
        t = self.table_runs().groupBy("note_id").agg(F.countDistinct("run").alias("n_tables"))
        links = self.notes.select("note_id", F.size(F.regexp_extract_all("text", F.lit(WIKILINK), 0)).cast("long").alias("n_wikilinks"))
        return self.n_lines.join(links, "note_id").join(h, "note_id", "left").join(t, "note_id", "left").na.fill(0, ["n_headings", "n_tables"])

    def plain_findings(self) -> DataFrame:
        """The eleven rules that the registered SQL of U6 unions: no L2, L12, L13 and no YAML."""
        rules = (self.fences, self.anchors, self.duplicate_headings, self.level_jumps, self.tables, self.callout_kinds, self.callout_density, self.callouts_by_section, self.empty_sections, self.trailing_space, self.open_frontmatter)
        return reduce(DataFrame.unionByName, (r() for r in rules))

    def findings(self, commands: DataFrame | None = None, environments: DataFrame | None = None) -> DataFrame:
        """Every rule's findings. L12 needs its lookups (name), and is left out without them, as in the reference."""
        found = self.plain_findings().unionByName(emphasis(self.notes)).unionByName(frontmatter_yaml(self.notes))
        return found if commands is None or environments is None else found.unionByName(self.math(commands, environments))


def compress(findings: DataFrame) -> DataFrame:
    """More than three trailing-space findings of a note become one; repeated headings one a title, with the count."""
    w = Window.partitionBy("note_id", "rule")
    marked = findings.withColumn("_n", F.count("*").over(w))
    rest = marked.filter((F.col("rule") != "duplicate_heading") & ~((F.col("rule") == "trailing_space") & (F.col("_n") > 3))).drop("_n")
    space = marked.filter((F.col("rule") == "trailing_space") & (F.col("_n") > 3)).groupBy("note_id", "severity", "rule").agg(F.min("pos").alias("pos"), F.count("*").cast("string").alias("detail"))
    dup = findings.filter(F.col("rule") == "duplicate_heading").groupBy("note_id", "severity", F.col("detail").alias("_t")).agg(F.min("pos").alias("pos"), F.count("*").alias("_c"))
    dup = dup.select("note_id", "severity", F.when(F.col("_c") + 1 >= 3, "template_heading").otherwise("duplicate_heading").alias("rule"), "pos", F.concat_ws(":", "_t", F.col("_c") + 1).alias("detail"))
    return rest.unionByName(space).unionByName(dup)


def shown(findings: DataFrame, most: int = 12) -> DataFrame:
    """The first findings of each severity of a note, with the number left out."""
    w = Window.partitionBy("note_id", "severity")
    r = findings.withColumn("rank", F.row_number().over(w.orderBy("pos", "rule", "detail"))).withColumn("left_out", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return r.filter(F.col("rank") <= most)


def summary(notes: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """Files, errors, warnings and the exit code, in one row."""
    f = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    bad = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return notes.agg(F.count("*").alias("files")).crossJoin(F.broadcast(f)).withColumn("code", F.when(bad, 1).otherwise(0))
