"""Queries over notes with the SQL that checks them: lines, headings, sections, text functions, lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.operators import lines as ln
from quillspark.operators import lint, markup, similarity
from quillspark.plans import bindings
from quillspark.plans.bindings import LINE, MATCH, NOTE, TOGGLE, read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


note_query = bindings.note_query(query)


def doc_query(name: str, sql: str | None = None, table: str = "documents"):
    return lambda f: query(name, sql)(lambda spark, d: f(read(spark, d, table)))


note_query("p1_headings", f"WITH {TOGGLE} SELECT note_id, pos, level, title, raw FROM head")(ln.headings)
note_query("m12_outline", f"WITH {TOGGLE} SELECT note_id, pos, repeat('  ', level - 1) || title AS entry FROM head")(ln.outline)
note_query("s29_head", f"WITH {LINE} SELECT note_id, pos, line FROM line WHERE pos < 5")(lambda n: ln.head(n, 5))
note_query(
    "p2_frontmatter",
    f"WITH {LINE} SELECT note_id, coalesce(CASE WHEN min(CASE WHEN pos = 0 THEN trim(line) END) = '---' THEN min(CASE WHEN pos > 0 AND trim(line) = '---' THEN pos + 1 END) END, 0)::INT AS fm_end FROM line GROUP BY note_id",
)(ln.frontmatter_end)
note_query(
    "p3_frontmatter_map",
    rf"""WITH {NOTE}, b AS (SELECT note_id, string_split(substr(text, 4, instr(substr(text, 4), chr(10) || '---') - 1), chr(10)) AS l FROM note WHERE starts_with(text, '---') AND instr(substr(text, 4), chr(10) || '---') > 0),
    r AS (SELECT note_id, unnest(range(len(l))) AS pos, trim(unnest(l)) AS line FROM b),
    kv AS (SELECT note_id, pos, regexp_extract(line, '^([A-Za-z_][\w-]*)\s*:\s*(.*)$', 1) AS key, trim(trim(trim(regexp_extract(line, '^([A-Za-z_][\w-]*)\s*:\s*(.*)$', 2)), '"'), '''') AS value FROM r WHERE regexp_matches(line, '^([A-Za-z_][\w-]*)\s*:\s*(.*)$'))
    SELECT note_id, key, arg_max(value, pos) AS value FROM kv WHERE value <> '' GROUP BY note_id, key""",
)(ln.frontmatter_map)
note_query(
    "w4_sections",
    f"""WITH {TOGGLE}, n AS (SELECT note_id, count(*)::INT AS n FROM line GROUP BY note_id)
    SELECT h.note_id, h.pos, h.level, h.title, h.raw, coalesce((SELECT min(x.pos) FROM head x WHERE x.note_id = h.note_id AND x.pos > h.pos AND x.level <= h.level), n.n)::INT AS "end" FROM head h JOIN n USING (note_id)""",
)(ln.sections)
note_query(
    "w1b_code_state",
    f"WITH {MATCH} SELECT note_id, count(*) AS n_lines, count_if(fence) AS n_fences, count_if(coalesce(o, '') <> '') AS n_code FROM cd GROUP BY note_id",
)(lambda n: ln.matched_code(ln.lines_of(n)).groupBy("note_id").agg(F.count("*").alias("n_lines"), F.count_if("fence").alias("n_fences"), F.count_if("in_code").alias("n_code")))
doc_query(
    "p4_clean_inline",
    r"SELECT doc_id, trim(regexp_replace(replace(replace(replace('  ' || text || ' ', chr(8203), ''), chr(65279), ''), chr(160), ' '), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM documents",
)(lambda d: d.select("doc_id", fx.clean_inline(F.concat(F.lit("  "), "text", F.lit(" "))).alias("cleaned")))
STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '(?s)<!--.*?-->', ' ', 'g'), '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$\n]*\$', ' ', 'g'), '(?s)```.*?```|`[^`]*`|!?\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '(?m)^\s{0,3}#{1,6}\s*', '', 'g')"""
FRONT = "CASE WHEN starts_with(text, '---') AND instr(substr(text, 4), chr(10) || '---') > 0 THEN substr(text, 3 + instr(substr(text, 4), chr(10) || '---') + 4) ELSE text END"
note_query("p5_strip_md", f"WITH {NOTE} SELECT note_id, {STRIP % FRONT} AS clean FROM note")(lambda n: n.select("note_id", fx.strip_md(F.col("text")).alias("clean")))
BODY = (
    LINE
    + rf""", bf AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\s+(.*?)\s*$') AS h, regexp_matches(line, '(?i)^\s*>\s*\[!(todo|info)\]') AS td, regexp_matches(line, '^\s*>\s*\[!') AS c, regexp_matches(line, '^\s*>') AS q FROM line),
    bg AS (SELECT *, coalesce(last_value(CASE WHEN h THEN regexp_matches(line, '^#{{1,6}}\s*相关链接\s*$') END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS lk, sum((NOT q)::INT) OVER (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM bf),
    bk AS (SELECT *, q AND bool_or(td) OVER (PARTITION BY note_id, run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS it FROM bg),
    bt AS (SELECT note_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM bk WHERE NOT h AND NOT c AND NOT lk AND NOT it GROUP BY note_id), body AS (SELECT note_id, {STRIP % FRONT} AS body FROM bt)"""
)
note_query("p6_body_text", f"WITH {BODY} SELECT note.note_id, coalesce(body, '') AS body FROM note LEFT JOIN body USING (note_id)")(ln.body_text)
doc_query(
    "w7_destutter",
    "WITH l AS (SELECT doc_id AS note_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS x FROM documents)), p AS (SELECT *, lag(trim(line)) OVER (PARTITION BY note_id ORDER BY pos) AS prev FROM l) SELECT note_id, count(*) AS kept, sum(pos)::BIGINT AS places FROM p WHERE trim(line) = '' OR prev IS NULL OR prev <> trim(line) GROUP BY note_id",
)(lambda d: ln.destutter(ln.lines_of(d.select(F.col("doc_id").alias("note_id"), F.replace("text", F.lit(". "), F.lit("\n")).alias("text")))).groupBy("note_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("places")))
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNITS = rf"""parts AS (SELECT k, unnest(range(len(p))) AS pn, regexp_replace(unnest(p), '{SPACE}+', '', 'g') AS p FROM (SELECT k, string_split(regexp_replace(regexp_replace(t, '([。！？；])', '\1' || chr(57344), 'g'), '\n{{2,}}', chr(57344), 'g'), chr(57344)) AS p FROM src)),
  cut AS (SELECT k, pn, CASE WHEN length(p) <= 105 THEN [p] ELSE list_append([p[i + 1 : i + 70] for i in range(0, length(p) - 69, 35)], p[length(p) - 69 :]) END AS u FROM parts WHERE length(p) >= 20),
  unit AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY pn, i) - 1)::INT AS unit_no, u FROM (SELECT k, pn, unnest(range(len(u))) AS i, unnest(u) AS u FROM cut))"""
doc_query("p8_units", f"WITH src AS (SELECT doc_id AS k, {STRIP % FRONT} AS t FROM documents), {UNITS} SELECT k AS doc_id, unit_no, u FROM unit")(lambda d: similarity.units_of(d, "doc_id"))
GRAMS = "regexp_replace(u, '[，。！？、；：\"''（）【】《》·—… \t\r\n#>*|_\\-\\[\\]()`]', '', 'g')"
doc_query(
    "p9_shingles",
    f"WITH src AS (SELECT item_id AS k, {STRIP % FRONT} AS t FROM benchmark), {UNITS}, g AS (SELECT k, unit_no, {GRAMS} AS u FROM unit) SELECT k AS item_id, unit_no, len(list_distinct([u[i : i + 3] for i in range(1, length(u) - 2)]))::INT AS n_grams FROM g",
    "benchmark",
)(lambda d: similarity.units_of(d, "item_id").select("item_id", "unit_no", F.size(fx.shingles(F.col("u"))).alias("n_grams")))


SIMILAR = f"""src AS (SELECT 'd' || item_id AS k, {STRIP % FRONT} AS t FROM benchmark UNION ALL SELECT 'n' || doc_id AS k, {STRIP % FRONT} AS t FROM documents), {UNITS},
  g AS (SELECT k, unit_no, u, list_distinct([x[i : i + 3] for i in range(1, length(x) - 2)]) AS g FROM (SELECT *, {GRAMS} AS x FROM unit)),
  a AS (SELECT k, unit_no, len(g) AS na, unnest(g) AS gram FROM g WHERE k[1] = 'd'),
  bu AS (SELECT DISTINCT k, u, g FROM g WHERE k[1] = 'n' AND len(g) > 0), b AS (SELECT k, u, len(g) AS nb, unnest(g) AS gram FROM bu WHERE true),
  i AS (SELECT a.k AS d, a.unit_no, b.k AS n, b.u, count(*) AS sh, any_value(na) + any_value(nb) - count(*) AS either FROM a JOIN b USING (gram) GROUP BY ALL HAVING count(*) >= 0.55 * (any_value(na) + any_value(nb) - count(*))),
  best AS (SELECT d, unit_no, n, max(sh / either) AS r FROM i GROUP BY ALL)"""


@query("j1_similar_units", f"WITH {SIMILAR} SELECT d[2:]::BIGINT AS item_id, n[2:]::BIGINT AS doc_id, count(*) AS n_similar, round(max(r), 6) AS best FROM best GROUP BY ALL")
def similar(spark, d):
    """The flagship: benchmark passages against all documents, near-duplicate units and the best ratio by pair."""
    drafts = similarity.units_of(read(spark, d, "benchmark"), "item_id").withColumnRenamed("item_id", "d")
    docs = similarity.units_of(read(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "n")
    s = similarity.similar_units(drafts, docs)
    return s.groupBy(F.col("d").alias("item_id"), F.col("n").alias("doc_id")).agg(F.count("*").alias("n_similar"), F.round(F.max(F.col("both") / F.col("either")), 6).alias("best"))


STOP = "(" + ", ".join(f"'{w}'" for w in sorted(set(fx.STOP_WORDS))) + ")"
KEYWORDS = f"""t AS (SELECT k, regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', '', 'g') AS t FROM ksrc),
  ch AS (SELECT k, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS a FROM t WHERE t <> ''), gl AS (SELECT *, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d FROM ch WINDOW w AS (PARTITION BY k ORDER BY i)),
  gs AS (SELECT k, 2 AS n, i, a || b AS kw FROM gl WHERE b IS NOT NULL UNION ALL SELECT k, 3, i, a || b || c FROM gl WHERE c IS NOT NULL UNION ALL SELECT k, 4, i, a || b || c || d FROM gl WHERE d IS NOT NULL),
  gc AS (SELECT k, kw, count(*) AS c, min(n) AS n, min(i) AS i FROM gs WHERE kw NOT IN {STOP} GROUP BY k, kw),
  gk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, n, i) AS r FROM gc), g2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS r2 FROM gk WHERE r <= 320 AND c > 1),
  g3 AS (SELECT k, kw, (row_number() OVER (PARTITION BY k ORDER BY r2))::INT AS rank FROM g2 WHERE r2 <= 80 AND length(kw) >= 2 AND NOT regexp_full_match(kw, '[\\d\\s.、%\\-]+') AND NOT regexp_full_match(kw, '[A-Za-z]{{1,2}}') AND NOT regexp_full_match(kw, '\\d{{2,4}}[PpKk]') AND NOT regexp_full_match(lower(kw), 'cc|bilibili|subtitle|clippings')),
  kw AS (SELECT * FROM g3 WHERE rank <= 40)"""
doc_query("a4_keywords", f"WITH ksrc AS (SELECT doc_id AS k, {STRIP % FRONT} AS t FROM documents), {KEYWORDS} SELECT k AS doc_id, rank, kw FROM kw")(lambda d: similarity.fallback_keywords(d, "doc_id"))
doc_query(
    "a5_corpus_keywords",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({STRIP % FRONT}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}')) AS kw FROM documents), tf AS (SELECT doc_id, kw, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT kw, count(*) AS df FROM tf GROUP BY kw),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), s AS (SELECT doc_id, kw, tf, df, round(tf * ln(n / df), 6) AS s FROM tf JOIN df USING (kw), n WHERE length(kw) >= 2 AND NOT regexp_full_match(kw, '[\\d\\s.、%\\-]+') AND NOT regexp_full_match(kw, '[A-Za-z]{{1,2}}') AND NOT regexp_full_match(kw, '\\d{{2,4}}[PpKk]') AND NOT regexp_full_match(lower(kw), 'cc|bilibili|subtitle|clippings') AND kw NOT IN {STOP})
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, kw))::INT AS rank, kw, tf, df FROM s QUALIFY rank <= 10""",
)(lambda d: similarity.corpus_keywords(d, "doc_id", 10))


@note_query(
    "a3_check_drafts",
    f"""WITH {BODY}, h0 AS (SELECT *, coalesce(sum(regexp_matches(line, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY note_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS code FROM line),
    hd AS (SELECT note_id, trim(regexp_replace(regexp_extract(line, '^(#{{1,6}})\\s+(.*?)\\s*$', 2), '\\s*#+\\s*$', '')) AS title FROM h0 WHERE code = 0 AND NOT regexp_matches(line, '^\\s*(```|~~~)') AND regexp_matches(line, '^(#{{1,6}})\\s+(.*?)\\s*$')),
    pair AS (SELECT note_id AS draft_id, note_id + 3 AS n_id FROM note), ksrc AS (SELECT note_id AS k, {STRIP % FRONT} AS t FROM note), {KEYWORDS}, clean AS (SELECT note_id, {STRIP % FRONT} AS t FROM note),
    kc AS (SELECT draft_id, n_id, count(kw) AS n_kw, count_if(contains(clean.t, kw)) AS n_covered, count_if(contains(clean.t, kw) AND NOT contains(coalesce(body, ''), kw)) AS n_weak FROM pair JOIN clean ON clean.note_id = n_id LEFT JOIN body ON body.note_id = n_id LEFT JOIN kw ON kw.k = draft_id GROUP BY ALL),
    dh AS (SELECT draft_id, n_id, count(*) AS n_dup_headings FROM pair JOIN hd a ON a.note_id = draft_id WHERE EXISTS (FROM hd b WHERE b.note_id = n_id AND b.title = a.title) GROUP BY ALL),
    src AS (SELECT note_id AS k, {STRIP % FRONT} AS t FROM note), {UNITS}, us AS (SELECT k, count(*) AS n_units FROM unit GROUP BY k),
    g AS (SELECT k, unit_no, u, list_distinct([x[i : i + 3] for i in range(1, length(x) - 2)]) AS g FROM (SELECT *, {GRAMS} AS x FROM unit)),
    ga AS (SELECT draft_id, n_id, unit_no, len(g) AS na, unnest(g) AS gram FROM pair JOIN g ON g.k = draft_id), gb AS (SELECT k, u, len(g) AS nb, unnest(g) AS gram FROM (SELECT DISTINCT k, u, g FROM g)),
    sh AS (SELECT draft_id, n_id, unit_no, u FROM ga JOIN gb ON gb.k = n_id AND gb.gram = ga.gram GROUP BY ALL HAVING count(*) >= 0.55 * (any_value(na) + any_value(nb) - count(*))),
    sm AS (SELECT draft_id, n_id, count(DISTINCT unit_no) AS n_similar FROM sh GROUP BY ALL),
    o AS (SELECT pair.draft_id, pair.n_id AS note_id, n_kw IS NOT NULL AS found, coalesce(n_kw, 0) AS n_kw, coalesce(n_covered, 0) AS n_covered, coalesce(n_weak, 0) AS n_weak, coalesce(n_dup_headings, 0) AS n_dup_headings, coalesce(n_units, 0) AS n_units, coalesce(n_similar, 0) AS n_similar
      FROM pair LEFT JOIN kc USING (draft_id, n_id) LEFT JOIN dh USING (draft_id, n_id) LEFT JOIN us ON us.k = pair.draft_id LEFT JOIN sm USING (draft_id, n_id))
    SELECT draft_id, note_id, n_kw, n_covered, n_weak, n_dup_headings, n_units, n_similar, CASE WHEN NOT found THEN 0 WHEN n_covered >= 0.8 * greatest(n_kw, 1) THEN CASE WHEN n_similar >= 0.6 * greatest(n_units, 1) THEN 13 ELSE 10 END WHEN n_covered >= 0.5 * greatest(n_kw, 1) THEN 11 ELSE 0 END AS verdict FROM o""",
)
def check(n):
    """Every note as a draft against the note three ids on."""
    pairs = n.select(F.col("note_id").alias("draft_id"), (F.col("note_id") + 3).alias("note_id"))
    return similarity.check_drafts(n.withColumnRenamed("note_id", "draft_id"), n, pairs).drop("coverage", "dup_ratio")


FIND = f"""WITH {TOGGLE}, s AS (SELECT note.note_id, 'n' || note.note_id AS stem, lower(text) AS t, EXISTS (FROM head WHERE head.note_id = note.note_id AND contains(lower(title), 'alpha')) AS h FROM note)
  SELECT note_id, 'dir/' || stem AS rel, (CASE WHEN h THEN 8 ELSE 0 END + CASE WHEN contains(t[1:600], 'alpha') AND contains(t[1:600], 'tags') THEN 5 ELSE 0 END + least(6, (length(t) - length(replace(t, 'alpha', ''))) // 5))::INT AS score, ((length(t) - length(replace(t, 'alpha', ''))) // 5)::BIGINT AS hits FROM s ORDER BY score DESC, rel LIMIT 12"""
note_query("o1_find_notes", FIND)(lambda n: similarity.find_notes(n.withColumn("stem", F.concat(F.lit("n"), "note_id")).withColumn("rel", F.concat(F.lit("dir/"), "stem")), "Alpha"))
note_query("o9_note_title", f"WITH {TOGGLE} SELECT note_id, CASE WHEN arg_min(level, pos) = 1 THEN arg_min(title, pos) END AS title FROM head GROUP BY note_id")(ln.note_title)

PICK = "note_id, '{s}' AS severity, '{r}' AS rule"
SLUG = r"trim(regexp_replace(%s, '\s+', ' ', 'g'))"
SLUGS = f"slugs AS (SELECT note_id, {SLUG % 'title'} AS slug, bool_and(quoted) AS oq FROM lh GROUP BY ALL), lk AS (SELECT note_id, pos, unnest(regexp_extract_all(line, '\\[\\[#([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS target FROM line WHERE contains(line, '[[#'))"
ROW = r"""rw AS (SELECT note_id, pos, line, starts_with(trim(bare), '|') AND ends_with(trim(bare), '|') AS r, string_split(replace(trim(bare), chr(92) || '|', chr(57344)), '|') AS c, regexp_matches(bare, '^(#{1,6})\s+(.*?)\s*$') AS h FROM live),
  rr AS (SELECT *, sum((NOT r)::INT) OVER (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM rw WHERE NOT h),
  tr AS (SELECT note_id, pos, line, run, (len(c) - (trim(c[1]) = '')::INT - (trim(c[len(c)]) = '')::INT)::INT AS width FROM rr WHERE r)"""
LINT_SQL = {
    "l3_fence_open": "SELECT note_id, 'error' AS severity, 'fence_open' AS rule, (arg_max(fa, k) + 1)::INT AS pos, arg_max(coalesce(o, ''), k) AS detail FROM st GROUP BY note_id HAVING arg_max(coalesce(o, ''), k) <> ''",
    "l4_anchors": f"SELECT lk.note_id, CASE WHEN oq IS NULL THEN 'error' ELSE 'info' END AS severity, CASE WHEN oq IS NULL THEN 'dead_anchor' ELSE 'quoted_anchor' END AS rule, pos + 1 AS pos, target AS detail FROM lk LEFT JOIN slugs ON slugs.note_id = lk.note_id AND slugs.slug = {SLUG % 'target'} WHERE oq IS NULL OR oq",
    "l6_duplicate_headings": f"SELECT note_id, 'warn' AS severity, 'duplicate_heading' AS rule, pos + 1 AS pos, title AS detail FROM lh QUALIFY row_number() OVER (PARTITION BY note_id, level, {SLUG % 'title'} ORDER BY pos) > 1",
    "l7_level_jumps": "SELECT note_id, 'warn' AS severity, 'level_jump' AS rule, pos + 1 AS pos, 'H' || prev || ' H' || level AS detail FROM (SELECT *, lag(level) OVER (PARTITION BY note_id ORDER BY pos) AS prev FROM lh) WHERE level > prev + 1",
    "l8_tables": "SELECT note_id, 'warn' AS severity, 'table_width' AS rule, (min(pos) + 1)::INT AS pos, array_to_string(list_sort(list(DISTINCT width)), ',') || CASE WHEN bool_or(regexp_matches(line, '\\$[^$\\n]*\\|[^$\\n]*\\$')) THEN ' math' ELSE '' END AS detail FROM tr GROUP BY note_id, run HAVING count(*) > 1 AND count(DISTINCT width) > 1",
    "l9_callout_kinds": f"SELECT note_id, 'warn' AS severity, 'callout_kind' AS rule, pos + 1 AS pos, kind AS detail FROM co WHERE lower(kind) NOT IN ({', '.join(repr(k) for k in lint.KNOWN_CALLOUTS)})",
    "l10_callout_density": "SELECT note_id, CASE WHEN n_lines <= 14.95::DOUBLE * n THEN 'warn' ELSE 'info' END AS severity, 'callout_density' AS rule, pos, n_lines || '/' || n AS detail FROM (SELECT note_id, count(*) AS n, min(pos) + 1 AS pos FROM co GROUP BY note_id) JOIN nl USING (note_id) WHERE n_lines > 60 AND n_lines <= 19.95::DOUBLE * n",
    "l11_callouts_by_section": "SELECT note_id, 'warn' AS severity, 'callouts_by_section' AS rule, hp + 1 AS pos, ht || ':' || (count(*) - least(count_if(lower(kind) = 'question'), count_if(lower(kind) = 'success'))) AS detail FROM (SELECT co.*, h.pos AS hp, h.title AS ht, h.level AS hl, (SELECT arg_min(level, pos) FROM lh z WHERE z.note_id = h.note_id AND z.pos > h.pos AND z.level BETWEEN 2 AND 4) AS nx FROM co ASOF JOIN (FROM lh WHERE level BETWEEN 2 AND 4) h ON h.note_id = co.note_id AND h.pos < co.pos) WHERE hl = 4 OR (hl = 3 AND nx IS DISTINCT FROM 4) GROUP BY note_id, hp, ht HAVING count(*) - least(count_if(lower(kind) = 'question'), count_if(lower(kind) = 'success')) > 5",
    "l14_empty_sections": "SELECT note_id, 'info' AS severity, 'empty_section' AS rule, pos + 1 AS pos, title AS detail FROM (SELECT *, coalesce(lead(pos) OVER w, n_lines) AS nxt, lead(level) OVER w AS nl2 FROM lh JOIN nl USING (note_id) WINDOW w AS (PARTITION BY note_id ORDER BY pos)) h WHERE level >= 2 AND title <> '目录' AND NOT coalesce(nl2 > level, false) AND NOT EXISTS (FROM line l WHERE l.note_id = h.note_id AND l.pos > h.pos AND l.pos < h.nxt AND trim(l.line) <> '')",
    "l15_trailing_space": "SELECT note_id, 'info' AS severity, 'trailing_space' AS rule, pos + 1 AS pos, '' AS detail FROM live WHERE rtrim(line) <> line",
    "l1_frontmatter_open": "SELECT note_id, 'error' AS severity, 'frontmatter_open' AS rule, 1 AS pos, '' AS detail FROM line GROUP BY note_id HAVING count_if(pos = 0 AND trim(line) = '---') = 1 AND count_if(pos > 0 AND trim(line) = '---') = 0",
}
LINT_CTE = f"{MATCH}, {SLUGS}, {ROW}"
METHODS = {"l3_fence_open": "fences", "l4_anchors": "anchors", "l6_duplicate_headings": "duplicate_headings", "l7_level_jumps": "level_jumps", "l8_tables": "tables", "l9_callout_kinds": "callout_kinds", "l10_callout_density": "callout_density", "l11_callouts_by_section": "callouts_by_section", "l14_empty_sections": "empty_sections", "l15_trailing_space": "trailing_space", "l1_frontmatter_open": "open_frontmatter"}
for _name, _sql in LINT_SQL.items():
    note_query(_name, f"WITH {LINT_CTE} {_sql}")(lambda n, m=METHODS[_name]: getattr(lint.Lint(n), m)())
ALL = " UNION ALL ".join(f"(SELECT note_id, severity, rule, pos::INT AS pos, detail FROM ({s}))" for s in LINT_SQL.values())
note_query("u6_lint_findings", f"WITH {LINT_CTE} {ALL}")(lambda n: lint.Lint(n, keep=True).plain_findings())
FOUND = f"{LINT_CTE}, fd AS ({ALL})"
note_query(
    "a8_compress",
    f"""WITH {FOUND}, m AS (SELECT *, count(*) OVER (PARTITION BY note_id, rule) AS n FROM fd)
    SELECT note_id, severity, rule, pos, detail FROM m WHERE rule <> 'duplicate_heading' AND NOT (rule = 'trailing_space' AND n > 3)
    UNION ALL SELECT note_id, severity, rule, min(pos)::INT, count(*)::VARCHAR FROM m WHERE rule = 'trailing_space' AND n > 3 GROUP BY ALL
    UNION ALL SELECT note_id, severity, CASE WHEN count(*) + 1 >= 3 THEN 'template_heading' ELSE 'duplicate_heading' END, min(pos)::INT, detail || ':' || (count(*) + 1) FROM fd WHERE rule = 'duplicate_heading' GROUP BY note_id, severity, detail""",
)(lambda n: lint.compress(lint.Lint(n, keep=True).plain_findings()))
note_query(
    "o8_shown",
    f"WITH {FOUND} SELECT *, (row_number() OVER (PARTITION BY note_id, severity ORDER BY pos, rule, detail))::INT AS rank, greatest(count(*) OVER (PARTITION BY note_id, severity) - 2, 0)::BIGINT AS left_out FROM fd QUALIFY rank <= 2",
)(lambda n: lint.shown(lint.Lint(n, keep=True).plain_findings(), 2))
note_query(
    "a11_stats",
    f"WITH {LINT_CTE} SELECT note_id, n_lines, length(text)::INT AS n_chars, len(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]*)?\\]\\]'))::BIGINT AS n_wikilinks, coalesce(nh, 0)::BIGINT AS n_headings, coalesce(nt, 0)::BIGINT AS n_tables FROM note JOIN nl USING (note_id) LEFT JOIN (SELECT note_id, count(*) AS nh FROM lh GROUP BY ALL) USING (note_id) LEFT JOIN (SELECT note_id, count(DISTINCT run) AS nt FROM tr GROUP BY ALL) USING (note_id)",
)(lambda n: lint.Lint(n).stats())
note_query("a12_summary", f"WITH {FOUND} SELECT (SELECT count(*) FROM note) AS files, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warn')::BIGINT AS warnings, CASE WHEN count_if(severity = 'error') > 0 THEN 1 ELSE 0 END AS code FROM fd")(
    lambda n: lint.summary(n, lint.Lint(n, keep=True).plain_findings())
)


@note_query(
    "l12_math",
    f"""WITH {MATCH}, bl AS (SELECT note_id, string_agg(CASE WHEN fence OR coalesce(o, '') <> '' THEN '' ELSE line END, chr(10) ORDER BY pos) AS t FROM cd GROUP BY note_id),
    sp AS (SELECT note_id, t, unnest(regexp_extract_all(t, '\\$\\$([\\s\\S]*?)\\$\\$|\\$\\$|\\$([^$]*)\\$|\\$', 0)) AS m FROM bl),
    mc AS (SELECT note_id, unnest(regexp_extract_all(m, '\\\\([a-zA-Z@]+)', 1)) AS name FROM sp WHERE length(m) > 2 AND (starts_with(m, '$$') OR NOT contains(m, chr(10))))
    SELECT note_id, 'math_macro' AS rule, name || ':' || count(*) AS detail FROM mc WHERE name NOT IN ('frac', 'alpha') GROUP BY note_id, name""",
)
def math(n):
    allowed = n.sparkSession.createDataFrame([("frac",), ("alpha",)], "name string")
    return lint.Lint(n).math(allowed, n.sparkSession.createDataFrame([("cases",)], "name string")).select("note_id", "rule", "detail")


def every_rule(n):
    names = lambda *x: n.sparkSession.createDataFrame([(v,) for v in x], "name string")
    return lint.Lint(n, keep=True).findings(names("frac", "alpha"), names("cases"))


note_query("u6_every_rule")(every_rule)
note_query("a8_every_rule")(lambda n: lint.compress(every_rule(n)))
note_query("o8_every_rule")(lambda n: lint.shown(every_rule(n), 2))
note_query("a12_every_rule")(lambda n: lint.summary(n, every_rule(n)))
note_query("p12_mask_markup")(markup.mask_markup)
note_query("l13_emphasis")(lambda n: markup.emphasis(n.withColumn("text", F.concat("text", F.lit("\nis**“so”**: it")))))
note_query(
    "l2_frontmatter_tags",
    f"WITH {LINE} SELECT note_id, 'info' AS severity, 'tags_string' AS rule, 2 AS pos, '' AS detail FROM line GROUP BY note_id HAVING count_if(pos = 0 AND trim(line) = '---') = 1 AND count_if(pos > 0 AND trim(line) = '---') > 0",
)(markup.frontmatter_yaml)
note_query("o1_fuzzy_stems")(lambda n: markup.fuzzy_stems(n.withColumn("stem", F.concat(F.lit("note-"), "note_id")).withColumn("rel", F.col("stem")), "note-7x"))
