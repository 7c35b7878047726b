"""Queries over transcripts, edits, pages and geometry with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.operators import cues, edits, layout, pages
from quillspark.plans import bindings
from quillspark.plans.bindings import LINE, NOTE, TOGGLE, read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


note_query = bindings.note_query(query)


# --- transcripts: events by user, seconds divided by 1000 so that steps fall between 0 and 60

CUE = "cue AS (SELECT user_id AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, epoch_us(ts) / 1e9 AS t, event_type AS text FROM events)"
STEP = f"{CUE}, st AS (SELECT *, t - lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM cue), gp AS (SELECT doc_id, greatest(coalesce(median(CASE WHEN d > 0 AND d < 60 THEN d END) * 1.8::DOUBLE, 5), 5) AS gap FROM st GROUP BY doc_id), sg AS (SELECT st.*, gap, sum(coalesce((d >= gap)::INT, 0)) OVER (PARTITION BY st.doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM st JOIN gp USING (doc_id))"


def event_cues(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "doc_id")  # dealt out by doc_id once, for all windows
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id")) - 1
    return e.select("doc_id", k.alias("pos"), (us / 1e9).alias("t"), F.col("event_type").alias("text"))


def cue_query(name, sql=None):
    return lambda f: query(name, sql)(lambda spark, d: f(event_cues(spark, d)))


cue_query("a7_auto_gap", f"WITH {STEP} SELECT doc_id, round(gap, 6) AS gap FROM gp")(lambda c: cues.auto_gap(c).select("doc_id", F.round("gap", 6).alias("gap")))
cue_query("w8_segments", f"WITH {STEP} SELECT doc_id, pos, seg FROM sg")(lambda c: cues.segments(c).select("doc_id", "pos", "seg"))
cue_query("w21_pauses", f"WITH {STEP} SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS k FROM sg WHERE d >= 1.5 * gap QUALIFY k <= 25")(lambda c: cues.pauses(c).select("doc_id", "pos", "k"))
cue_query("w9_paragraphs")(lambda c: cues.paragraphs(c, max_para=60))
cue_query("a6_transcript_stats")(lambda c: cues.transcript_stats(c, max_para=60))

#: Conversations as stamped lines: unstamped ones before some, a stamp on every second turn, the others continue it.
TALK = "CASE WHEN conv_id % 4 = 0 THEN '# Talk' || chr(10) || 'opening words that no stamp covers' || chr(10) ELSE '' END || string_agg(CASE WHEN turn % 2 = 0 THEN printf('%02d:%02d ', (turn * 7) // 60, (turn * 7) % 60) ELSE '' END || replace(text, chr(10), ' '), chr(10) ORDER BY turn)"


def talk(spark, d):
    c = read(spark, d, "conversations")
    stamp = F.when(F.col("turn") % 2 == 0, F.format_string("%02d:%02d ", F.floor(F.col("turn") * 7 / 60), F.col("turn") * 7 % 60)).otherwise("")
    rows = c.select("conv_id", "turn", F.concat(stamp, F.replace("text", F.lit("\n"), F.lit(" "))).alias("l")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "l"))).alias("l"))
    lead = F.when(F.col("conv_id") % 4 == 0, "# Talk\nopening words that no stamp covers\n").otherwise("")
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(lead, F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("text"))


TALK_CUES = f"""tk AS (SELECT conv_id AS doc_id, string_split({TALK}, chr(10)) AS l FROM conversations GROUP BY conv_id), tl AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, trim(unnest(l)) AS line FROM tk),
  tp AS (SELECT doc_id, pos, line, regexp_extract(line, '^`?\\[?(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?(?:[,.]\\d{{1,3}})?)\\]?`?\\s*(.*)$', 1) AS ts, trim(regexp_replace(regexp_extract(line, '^`?\\[?(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?(?:[,.]\\d{{1,3}})?)\\]?`?\\s*(.*)$', 2), '[ \\t]{{2,}}', ' ', 'g')) AS said FROM tl WHERE line <> ''),
  tc AS (SELECT *, sum((ts <> '' AND said <> '')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cue FROM tp)"""
query(
    "s18_parse_cues",
    f"WITH {TALK_CUES} SELECT doc_id, (cue - 1)::INT AS pos, (split_part(any_value(nullif(ts, '')), ':', 1)::DOUBLE * 60 + split_part(any_value(nullif(ts, '')), ':', 2)::DOUBLE) AS t, string_agg(CASE WHEN ts <> '' THEN said ELSE line END, ' ' ORDER BY pos) AS text FROM tc WHERE cue > 0 AND ((ts <> '' AND said <> '') OR (ts = '' AND line[1] NOT IN ('#', '!', '|', '>', '<'))) GROUP BY doc_id, cue",
)(lambda spark, d: cues.parse_cues(talk(spark, d)))
query("s19_lost_prefix", f"WITH {TALK_CUES}, ft AS (SELECT doc_id, min(pos) FILTER (ts <> '') AS f FROM tc GROUP BY doc_id) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS prefix FROM tc JOIN ft USING (doc_id) WHERE pos < f GROUP BY doc_id")(lambda spark, d: cues.lost_prefix(talk(spark, d)))
query("s21_extract_text")(lambda spark, d: cues.extract_text(talk(spark, d)))
query(
    "f1_parse_ts",
    "WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN printf('%02d:%02d:%02d,5', event_id % 24, event_id % 60, event_id % 50) WHEN 1 THEN printf('%02d:%02d', event_id % 60, event_id % 50) WHEN 2 THEN '7.25' ELSE 'x:1' END AS s FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 50 + 0.5 WHEN 1 THEN event_id % 60 * 60 + event_id % 50 WHEN 2 THEN 7.25 ELSE -1 END::DOUBLE AS t FROM x",
)(
    lambda spark, d: read(spark, d, "events").select(
        "event_id",
        fx.parse_ts(
            F.when(F.col("event_id") % 4 == 0, F.format_string("%02d:%02d:%02d,5", F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 50))
            .when(F.col("event_id") % 4 == 1, F.format_string("%02d:%02d", F.col("event_id") % 60, F.col("event_id") % 50))
            .when(F.col("event_id") % 4 == 2, "7.25")
            .otherwise("x:1")
        ).alias("t"),
    )
)
query("f2_fmt_ts", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS t FROM (SELECT event_id, greatest(0, trunc(value * 100))::BIGINT AS s FROM events)")(lambda spark, d: read(spark, d, "events").select("event_id", fx.fmt_ts(F.col("value") * 100).alias("t")))
query("p16_titles", "SELECT doc_id, length(text) <= 30 AND NOT contains(text, '。') AS is_title FROM documents")(lambda spark, d: read(spark, d, "documents").select("doc_id", fx.looks_like_title(F.col("text")).alias("is_title")))
query("p20_no_space", r"SELECT doc_id, md5(regexp_replace(text, '[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}]+', '', 'g')) AS h FROM documents")(lambda spark, d: read(spark, d, "documents").select("doc_id", F.md5(fx.no_space(F.col("text"))).alias("h")))
SPEC = "concat('[', CAST(doc_id % 9 + 1 AS STRING), ', ', CAST(doc_id % 7 + 4 AS STRING), '-', CAST(doc_id % 5 + 1 AS STRING), ',3]')"
query(
    "s22_page_spec",
    "WITH p AS (SELECT doc_id, list_concat([doc_id % 9 + 1], range(least(doc_id % 7 + 4, doc_id % 5 + 1), greatest(doc_id % 7 + 4, doc_id % 5 + 1) + 1), [3]) AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS p FROM p), f AS (SELECT doc_id, p, min(i) AS i FROM e WHERE p <= 8 GROUP BY ALL) SELECT doc_id, string_agg(p, ',' ORDER BY i) AS pages FROM f GROUP BY doc_id",
)(lambda spark, d: read(spark, d, "documents").select("doc_id", F.array_join(fx.page_spec(F.expr(SPEC), F.lit(8)).cast("array<string>"), ",").alias("pages")))
query("s22b_page_spec_loose", "SELECT doc_id, array_to_string(list_concat([doc_id % 9 + 1], range(2, doc_id % 7 + 1), [2]), ',') AS pages FROM documents")(
    lambda spark, d: read(spark, d, "documents").select("doc_id", F.array_join(fx.page_spec_loose(F.expr("concat(CAST(doc_id % 9 + 1 AS STRING), ', 2-', CAST(doc_id % 7 AS STRING), ',2')")).cast("array<string>"), ",").alias("pages"))
)
ROWS = "CASE WHEN doc_id % 3 = 0 THEN array(array('a', 'b|c'), array(text)) ELSE array(array('a', 'b|c'), array('x ', 'y')) END"
HEADROW = "'| a | b\\|c |' || chr(10) || '| --- | --- |' || chr(10) || "
CELL = r"replace(trim(regexp_replace(replace(replace(replace(text, chr(8203), ''), chr(65279), ''), chr(160), ' '), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '|', '\|')"
for _name, _pad in (("s25_table_padded", True), ("s26_table", False)):
    _tail = " |  |'" if _pad else " |'"
    query(_name, f"SELECT doc_id, {HEADROW} CASE WHEN doc_id % 3 = 0 THEN '| ' || {CELL} || '{_tail} ELSE '| x | y |' END AS md FROM documents")(lambda spark, d, p=_pad: read(spark, d, "documents").select("doc_id", fx.table_markdown(F.expr(ROWS), p).alias("md")))

# --- edits

note_query("m3_append", f"WITH {NOTE} SELECT note_id, NULL::VARCHAR AS reason, rtrim(text, chr(10)) || chr(10) || chr(10) || 'extra' || chr(10) AS new_text FROM note")(
    lambda n: edits.append(n, n.select("note_id", F.lit("\nextra\n").alias("content")))
)
note_query(
    "m4_patch",
    f"""WITH {NOTE}, c AS (SELECT *, (length(text) - length(replace(text, '## Beta part', ''))) // 12 AS c1, (length(text) - length(replace(text, '## Alpha part', ''))) // 13 AS c2 FROM note)
    SELECT note_id, CASE WHEN c1 = 1 AND c2 = 1 THEN NULL ELSE 'not found once' END AS reason, CASE WHEN c1 = 1 AND c2 = 1 THEN replace(replace(text, '## Beta part', '## B' || chr(10) || 'new'), '## Alpha part', '') ELSE text END AS new_text FROM c""",
)(lambda n: _patched(n))


def _patched(n):
    e = n.select("note_id", F.explode(F.array(F.struct(F.lit(1).alias("edit_no"), F.lit("## Beta part").alias("old"), F.lit("## B\nnew").alias("new")), F.struct(F.lit(2).alias("edit_no"), F.lit("## Alpha part").alias("old"), F.lit("").alias("new")))).alias("e")).select("note_id", "e.*")
    return edits.patch(n, e).select("note_id", "reason", "new_text")


note_query(
    "m1_insert",
    f"""WITH {TOGGLE}, s AS (SELECT head.*, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS k FROM head WHERE title = 'Beta part'), e AS (SELECT s.note_id, s.pos, coalesce((SELECT min(x.pos) FROM head x WHERE x.note_id = s.note_id AND x.pos > s.pos AND x.level <= s.level), (SELECT count(*) FROM line l WHERE l.note_id = s.note_id)) AS fin FROM s WHERE k = 1),
    a AS (SELECT e.note_id, coalesce((SELECT max(l.pos) + 1 FROM line l WHERE l.note_id = e.note_id AND l.pos > e.pos AND l.pos < e.fin AND trim(l.line) <> ''), e.pos + 1) AS p FROM e),
    r AS (SELECT line.note_id, line.pos AS p1, 0 AS p2, line.line FROM line UNION ALL
      SELECT a.note_id, a.p - 1, x.k, x.t FROM a, (VALUES (1, ''), (2, 'added'), (3, '')) x(k, t) WHERE x.k = 2 OR (x.k = 1 AND (SELECT trim(l.line) <> '' FROM line l WHERE l.note_id = a.note_id AND l.pos = a.p - 1)) OR (x.k = 3 AND coalesce((SELECT trim(l.line) <> '' FROM line l WHERE l.note_id = a.note_id AND l.pos = a.p), false)))
    SELECT r.note_id, CASE WHEN any_value(a.note_id) IS NULL THEN 'anchor not found' END AS reason, CASE WHEN any_value(a.note_id) IS NULL THEN any_value(note.text) ELSE rtrim(string_agg(line, chr(10) ORDER BY p1, p2), chr(10)) || chr(10) END AS new_text FROM r JOIN note USING (note_id) LEFT JOIN a USING (note_id) GROUP BY r.note_id""",
)(lambda n: edits.insert(n, n.select("note_id", F.lit("## Beta part").alias("anchor"), F.lit("end-of-section").alias("at"), F.lit("added\n").alias("content"))).drop("rule_line"))
note_query("m2_replace")(lambda n: edits.replace(n, n.select("note_id", F.lit("## Gamma").alias("anchor"), F.lit(None).cast("string").alias("until"), F.lit("## Gamma\nshort").alias("content"))))
note_query(
    "m7_list_callouts",
    rf"""WITH {LINE}, h AS (SELECT *, length(regexp_extract(line, '^(#{{2,4}})\s+(.*?)\s*$', 1)) AS lv, regexp_extract(line, '^(#{{2,4}})\s+(.*?)\s*$', 2) AS ti FROM line),
    s AS (SELECT *, coalesce(last_value(CASE WHEN lv = 2 THEN ti END IGNORE NULLS) OVER w, '') AS h2, coalesce(last_value(CASE WHEN lv = 2 THEN '' WHEN lv > 2 THEN ti END IGNORE NULLS) OVER w, '') AS h3 FROM h WINDOW w AS (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT note_id, pos, regexp_extract(line, '^> \[!([A-Za-z-]+)\]([+-]?)\s*(.*)$', 1) AS kind, trim(regexp_extract(line, '^> \[!([A-Za-z-]+)\]([+-]?)\s*(.*)$', 3)) AS title, h2, h3 FROM s WHERE regexp_matches(line, '^> \[!([A-Za-z-]+)\]')""",
)(lambda n: edits.list_callouts(n))
note_query("m6_flatten")(lambda n: edits.flatten_callouts(n, ["question", "tip"]))
note_query(
    "w13_flat_toc",
    f"""WITH {TOGGLE}, h AS (SELECT *, count_if(level = 2) OVER (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS a FROM head WHERE level IN (2, 3)), g AS (SELECT *, count_if(level = 3) OVER (PARTITION BY note_id, a ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b FROM h)
    SELECT note_id, pos, CASE WHEN level = 2 THEN a || '.' WHEN a = 0 THEN '  ' || b || '.' ELSE '  ' || a || '.' || b END || ' [[#' || title || ']]' AS entry FROM g""",
)(lambda n: edits.flat_toc(n))
note_query(
    "w14_grouped_toc",
    f"""WITH {TOGGLE}, h AS (SELECT *, last_value(CASE WHEN level <= 2 THEN CASE WHEN level = 2 THEN pos ELSE -1 END END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM head WHERE pos > (SELECT min(pos) FROM head x WHERE x.note_id = head.note_id)),
    i AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS n FROM h WHERE level = 3 AND g >= 0)
    SELECT note_id, pos, n || '. [[#' || title || ']]' AS entry FROM i UNION ALL SELECT note_id, pos, '### ' || title FROM h WHERE level = 2 AND EXISTS (FROM i WHERE i.note_id = h.note_id AND i.g = h.pos)""",
)(lambda n: edits.grouped_toc(n, 2))
note_query("m5_rebuild_toc")(lambda n: edits.rebuild_toc(_with_toc(n)))
note_query("w15_toc_style", f"WITH {NOTE} SELECT note_id, CASE note_id % 4 WHEN 0 THEN CASE WHEN note_id % 7 = 0 THEN 'unknown' ELSE 'grouped' END WHEN 1 THEN 'flat' WHEN 2 THEN 'unknown' ELSE 'absent' END AS style, CASE WHEN note_id % 4 = 0 AND note_id % 7 <> 0 THEN 2 ELSE 0 END AS group_level FROM note")(lambda n: edits.toc_style(_with_toc(n)).na.fill(0, ["group_level"]))


def _with_toc(n):
    """Notes under a contents section in each style."""
    toc = F.when(F.col("note_id") % 4 == 0, "### Beta part\n1. [[#Gone]]\n\n---\n").when(F.col("note_id") % 4 == 1, "1. [[#Alpha part]]\n  1.1 [[#Sub]]\n\n").when(F.col("note_id") % 4 == 2, "- [[#Alpha part]]\n\n")
    plain = F.regexp_replace("text", r"(?s)\A---\n.*?\n(?=# Note)", "")
    return n.select("note_id", F.when(toc.isNull(), plain).otherwise(F.concat(F.lit("# Top\n\n## 目录\n\n"), toc, F.lit("## Start\n"), plain)).alias("text"))


SNAP = "sn AS (SELECT conv_id AS note_id, printf('202601%02d-000000', turn // 2 + 1) AS stamp, (turn % 2 + 1)::INT AS seq, text, sha256(text) AS sha FROM conversations)"


def snapshots(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("note_id"), F.format_string("202601%02d-000000", F.floor(F.col("turn") / 2) + 1).alias("stamp"), (F.col("turn") % 2 + 1).cast("int").alias("seq"), "text", F.sha2("text", 256).alias("sha"))


query("o7_latest_snapshot", f"WITH {SNAP} SELECT note_id, stamp, seq, text, sha FROM sn QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY stamp DESC, seq DESC, text DESC) = 1")(lambda spark, d: edits.latest_snapshots(snapshots(spark, d)))
query("u4_stale_snapshots", f"WITH {SNAP} SELECT note_id, stamp, seq, text, sha FROM sn QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY stamp DESC, seq DESC) > 2")(lambda spark, d: edits.stale_snapshots(snapshots(spark, d), 2))
query(
    "m8_take_snapshots",
    f"WITH {SNAP}, l AS (SELECT note_id, sha, text FROM sn QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY stamp DESC, seq DESC, text DESC) = 1), n AS (SELECT note_id, CASE WHEN note_id % 2 = 0 THEN text ELSE text || '!' END AS text, sha FROM l), u AS (SELECT note_id, max(seq) AS s FROM sn WHERE stamp = '20260101-000000' GROUP BY ALL) SELECT n.note_id, '20260101-000000' AS stamp, (coalesce(s, 0) + 1)::INT AS seq, n.text, sha256(n.text) AS sha FROM n LEFT JOIN u USING (note_id) WHERE sha256(n.text) <> n.sha",
)(lambda spark, d: (lambda s: edits.take_snapshots(s, edits.latest_snapshots(s).select("note_id", F.when(F.col("note_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text")), "20260101-000000"))(snapshots(spark, d)))

# --- pages: a document's lines; the new version changes every third, drops the last of odd documents and adds one to every fifth

PAGE = """op AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS page_no, unnest(l) AS text, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  np AS (SELECT doc_id, page_no, CASE WHEN page_no % 3 = 0 THEN replace(text, 'e', 'E') ELSE replace(text, ' ', '  ') END AS text FROM op WHERE NOT (doc_id % 2 = 1 AND page_no = n) UNION ALL SELECT doc_id, (n + 1)::INT, 'added' FROM op WHERE doc_id % 5 = 0 AND doc_id % 2 = 0 AND page_no = n)"""
PLAIN = r"regexp_replace(%s, '\s+', '', 'g')"


def versions(spark, d):
    l = read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    old = l.select("doc_id", F.posexplode("l").alias("p", "text"), F.size("l").alias("n")).select("doc_id", (F.col("p") + 1).alias("page_no"), "text", "n")
    new = old.filter(~((F.col("doc_id") % 2 == 1) & (F.col("page_no") == F.col("n")))).withColumn("text", F.when(F.col("page_no") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.replace("text", F.lit(" "), F.lit("  "))))
    more = l.filter((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 2 == 0)).select("doc_id", (F.size("l") + 1).alias("page_no"), F.lit("added").alias("text"))
    return old.drop("n"), new.drop("n").unionByName(more)


JOINED = f"cp AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_no, b.page_no) AS page_no, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN {PLAIN % 'a.text'} = {PLAIN % 'b.text'} THEN 'same' ELSE 'changed' END AS status FROM op a FULL JOIN np b ON a.doc_id = b.doc_id AND a.page_no = b.page_no)"
query("j8_page_diff", f"WITH {PAGE}, {JOINED} SELECT * FROM cp")(lambda spark, d: pages.compare_pages(*versions(spark, d), exact=True))
query("j8_page_ratio")(lambda spark, d: pages.compare_pages(*versions(spark, d)))
query("a18_changed_pages", f"WITH {PAGE}, {JOINED} SELECT doc_id, string_agg(page_no, ',' ORDER BY page_no) AS pages FROM cp WHERE status <> 'same' GROUP BY doc_id")(lambda spark, d: pages.changed_lists(pages.compare_pages(*versions(spark, d), exact=True)))
query("u3_blank_in_both", f"WITH {PAGE} SELECT DISTINCT doc_id, page_no FROM op a JOIN np b USING (doc_id, page_no) WHERE length({PLAIN % 'a.text'}) < 20 AND length({PLAIN % 'b.text'}) < 20")(lambda spark, d: pages.blank_in_both(*versions(spark, d)))
query("s17_scan_pages", f"WITH {PAGE} SELECT doc_id, page_no FROM op WHERE length(trim(text)) < 20")(lambda spark, d: pages.scan_pages(versions(spark, d)[0]))

# --- geometry from line items: a document is 40 orders, a page a line number

STROKE = (
    "CAST(floor(l_orderkey / 40) AS INT) AS doc_id, l_linenumber AS page, CASE WHEN l_partkey % 2 = 0 THEN 'line' ELSE 'rect' END AS kind, CAST(CASE WHEN l_partkey % 5 = 0 THEN 10 ELSE l_partkey % 25 * 20 END AS DOUBLE) AS x0, CAST(CASE WHEN l_partkey % 5 = 0 THEN 10 ELSE l_suppkey % 10 * 60 END AS DOUBLE) AS y0, "
    "CAST(CASE WHEN l_partkey % 5 = 0 THEN 500 WHEN l_partkey % 7 = 0 THEN l_partkey % 25 * 20 - 4 ELSE l_partkey % 25 * 20 + l_quantity * 3 END AS DOUBLE) AS x1, CAST(CASE WHEN l_partkey % 5 = 0 THEN 30 ELSE l_suppkey % 10 * 60 + floor(l_discount * 40) END AS DOUBLE) AS y1"
)
SPAN = "CAST(floor(l_orderkey / 40) AS INT) AS doc_id, l_linenumber AS page, CAST(l_partkey % 23 * 22 AS DOUBLE) AS x0, CAST(l_suppkey % 97 * 6 AS DOUBLE) AS y0, CAST(l_partkey % 23 * 22 + 18 AS DOUBLE) AS x1, CAST(l_suppkey % 97 * 6 + 9 AS DOUBLE) AS y1, CAST(8 + l_suppkey % 3 * 2 AS DOUBLE) AS size, CASE WHEN l_orderkey % 6 = 0 THEN 'ϖ' ELSE concat('s', CAST(l_partkey AS STRING), '-', CAST(l_orderkey AS STRING)) END AS text"
PIXEL = "CAST(floor(l_orderkey / 400) AS INT) AS doc_id, 1 AS page, CAST(l_partkey % 60 AS INT) AS x, CAST(l_suppkey % 60 AS INT) AS y, CAST(CASE WHEN floor(l_orderkey / 400) % 5 = 0 AND l_partkey % 50 > 0 THEN 7 ELSE l_linenumber % 3 * 40 END AS INT) AS r, CAST(CASE WHEN floor(l_orderkey / 400) % 5 = 0 AND l_partkey % 50 > 0 THEN 7 ELSE l_linenumber % 2 * 30 END AS INT) AS g, CAST(CASE WHEN floor(l_orderkey / 400) % 5 = 0 AND l_partkey % 50 > 0 THEN 7 ELSE l_orderkey % 4 * 20 END AS INT) AS b"
STROKES, SPANS, PIXELS = (f"{n} AS (SELECT {e} FROM lineitem)" for n, e in (("sk", STROKE), ("sp", SPAN), ("px", PIXEL)))


def shape_query(name, sql=None, of=STROKE):
    return lambda f: query(name, sql)(lambda spark, d: f(read(spark, d, "lineitem").selectExpr(*_columns(of))))


def _columns(of):
    out, depth, part = [], 0, ""
    for c in of:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


BARS = f"{STROKES}, br AS (SELECT DISTINCT doc_id, page, least(y0, y1) AS y, x0, x1 FROM sk WHERE kind = 'line' AND abs(y1 - y0) < 1 AND x1 - x0 > 8 AND x1 - x0 < 170 UNION SELECT DISTINCT doc_id, page, (y0 + y1) / 2, x0, x1 FROM sk WHERE kind = 'rect' AND y1 - y0 < 2.4 AND x1 - x0 > 8 AND x1 - x0 < 170)"
shape_query("f13_bars", f"WITH {BARS} SELECT * FROM br")(layout.bars)
query(
    "j9_bar_candidates",
    f"WITH {BARS}, {SPANS}, j AS (SELECT sp.doc_id, sp.page, y, br.x0 AS bx0, br.x1 AS bx1, CASE WHEN sp.y1 - y > -30 AND sp.y1 - y < -0.3 THEN 'num' WHEN sp.y0 - y > 0.3 AND sp.y0 - y < 30 THEN 'den' END AS side, text FROM sp JOIN br ON sp.doc_id = br.doc_id AND sp.page = br.page AND least(sp.x1, br.x1) - greatest(sp.x0, br.x0) > 1) SELECT * FROM j WHERE side IS NOT NULL",
)(lambda spark, d: (lambda l: layout.bar_candidates(l.selectExpr(*_columns(SPAN)), layout.bars(l.selectExpr(*_columns(STROKE)))))(read(spark, d, "lineitem")))
shape_query(
    "j10_vector_targets",
    f"WITH {SPANS}, a AS (FROM sp WHERE text = 'ϖ'), j AS (SELECT a.doc_id, a.page, a.x0 AS ax0, a.y0 AS ay0, s.text, least(s.x1, a.x1) - greatest(s.x0, a.x0) AS over, s.y0, s.x0 FROM a JOIN sp s ON s.doc_id = a.doc_id AND s.page = a.page AND s.text <> 'ϖ' AND s.y0 - a.y0 > 4 AND s.y0 - a.y0 < 34) SELECT DISTINCT doc_id, page, ax0, ay0, over FROM j WHERE over > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, ax0, ay0 ORDER BY over DESC, y0, x0) = 1",
    SPAN,
)(lambda s: layout.vector_targets(s).select("doc_id", "page", "ax0", "ay0", "over"))
shape_query("o3_reading_order", f"WITH {SPANS} SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, text))::INT AS k FROM sp", SPAN)(layout.reading_order)
shape_query(
    "w19_span_lines",
    f"WITH {SPANS}, k AS (SELECT *, max(x1) OVER w AS reach, row_number() OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, text) AS k FROM sp WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY x0, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, page, y0, string_agg(CASE WHEN x0 - reach > greatest(1.6, 0.17 * size) THEN ' ' ELSE '' END || text, '' ORDER BY k) AS line FROM k GROUP BY ALL",
    SPAN,
)(lambda s: layout.span_line(s, ["doc_id", "page", "y0"]))
SIG = f"{STROKES}, nk AS (SELECT doc_id, page, kind, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM sk), sg AS (SELECT *, floor(x0 / 4)::INT AS s_x0, floor(y0 / 4)::INT AS s_y0, floor(x1 / 4)::INT AS s_x1, floor(y1 / 4)::INT AS s_y1 FROM nk), fr AS (SELECT doc_id, s_x0, s_y0, s_x1, s_y1, count(DISTINCT page) AS on_pages FROM sg GROUP BY ALL), np AS (SELECT doc_id, count(DISTINCT page) AS n FROM sk GROUP BY ALL), tp AS (SELECT fr.* FROM fr JOIN np USING (doc_id) WHERE on_pages >= greatest(6, n * 0.12))"
shape_query("a13_template_strokes", f"WITH {SIG} SELECT * FROM tp")(layout.template_strokes)
shape_query(
    "g3_figure_regions",
    f"""WITH {SIG}, lv AS (SELECT sg.*, (x0 + x1) / 2 AS xc, (y0 + y1) / 2 AS yc FROM sg WHERE NOT EXISTS (FROM tp WHERE tp.doc_id = sg.doc_id AND tp.s_x0 = sg.s_x0 AND tp.s_y0 = sg.s_y0 AND tp.s_x1 = sg.s_x1 AND tp.s_y1 = sg.s_y1) AND x0 BETWEEN 0 AND 560 AND x1 BETWEEN 0 AND 560 AND y0 BETWEEN 0 AND 800 AND y1 BETWEEN 0 AND 800 AND x1 - x0 + y1 - y0 > 3),
    m AS (SELECT doc_id, page, list_sort(list(xc))[count(*) // 2 + 1] AS mx, list_sort(list(yc))[count(*) // 2 + 1] AS my FROM lv GROUP BY ALL), d AS (SELECT doc_id, page, list_sort(list(abs(xc - mx)))[count(*) // 2 + 1] AS dx, list_sort(list(abs(yc - my)))[count(*) // 2 + 1] AS dy FROM lv JOIN m USING (doc_id, page) GROUP BY ALL),
    c AS (SELECT lv.*, abs(xc - mx) <= 4 * CASE WHEN dx = 0 THEN 40 ELSE dx END + 30 AND abs(yc - my) <= 4 * CASE WHEN dy = 0 THEN 40 ELSE dy END + 30 AS core FROM lv JOIN m USING (doc_id, page) JOIN d USING (doc_id, page))
    SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(min(x0) FILTER (core), min(x0)) AS core_x0, coalesce(min(y0) FILTER (core), min(y0)) AS core_y0, coalesce(max(x1) FILTER (core), max(x1)) AS core_x1, coalesce(max(y1) FILTER (core), max(y1)) AS core_y1, count(*) AS n, CASE WHEN count_if(core) > 0 THEN count_if(core) ELSE count(*) END AS n_core FROM c GROUP BY ALL""",
)(lambda s: layout.figure_regions(s, 560.0, 800.0))
shape_query("g7_large_images", f"WITH {STROKES} SELECT * FROM sk WHERE (x1 - x0) * (y1 - y0) > 1500")(lambda s: layout.large_images(s, 1500))
shape_query("a15_top_colours", f"WITH {PIXELS}, c AS (SELECT doc_id, page, r, g, b, count(*) AS n FROM px WHERE x % 3 = 0 AND y % 3 = 0 GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY doc_id, page))::BIGINT AS total, (row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, r, g, b))::INT AS rank FROM c QUALIFY rank <= 4", PIXEL)(layout.top_colours)
shape_query("a16_background", f"WITH {PIXELS} SELECT doc_id, page, floor(quantile_cont((r + g + b)::DOUBLE, 0.1))::BIGINT AS level FROM px GROUP BY ALL", PIXEL)(layout.background_level)
shape_query(
    "g6_trim_box",
    f"WITH {PIXELS}, m0 AS (SELECT doc_id, page, r, g, b, count(*) AS n FROM px WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY ALL), m AS (FROM m0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, r, g, b) = 1), s AS (SELECT doc_id, page, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY ALL) SELECT px.doc_id, px.page, greatest(0, min(x) - 3)::INT AS x0, greatest(0, min(y) - 3)::INT AS y0, least(any_value(w), max(x) + 4)::INT AS x1, least(any_value(h), max(y) + 4)::INT AS y1 FROM px JOIN m USING (doc_id, page) JOIN s USING (doc_id, page) WHERE abs(px.r - m.r) + abs(px.g - m.g) + abs(px.b - m.b) > 48 GROUP BY ALL",
    PIXEL,
)(lambda p: layout.trim_box(p, 48, 3))
shape_query("g8_blank_crops", f"WITH {PIXELS}, c AS (SELECT doc_id, page, r, g, b, count(*) AS n FROM px GROUP BY ALL) SELECT doc_id, page, count(*) AS colours FROM c GROUP BY ALL HAVING max(n) / sum(n) > 0.92 AND count(*) < 60", PIXEL)(layout.blank_crops)
shape_query("g4_panels", of=PIXEL)(lambda p: layout.panels(layout.panel_cells(p, (40, 30, 20), 90).distinct(), 2))
shape_query("g5_bright_blocks", of=PIXEL)(lambda p: layout.panels(layout.bright_cells(p, 20).distinct(), 2, 140))
query("g1_rebuild_pages")(lambda spark, d: (lambda l: layout.rebuild_pages(l.selectExpr(*_columns(SPAN)), l.selectExpr(*_columns(STROKE))))(read(spark, d, "lineitem")))
query("u5_orphan_images", "SELECT l_orderkey AS image FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")(
    lambda spark, d: read(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("image")).distinct().join(read(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("image")), "image", "left_anti")
)
