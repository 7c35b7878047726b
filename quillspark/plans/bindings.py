"""Reference entities bound to the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "documents benchmark pages conversations events labels lineitem".split()

#: Structured Markdown notes around the whole texts of documents: front matter, headings, callouts, tables, fences, links, formulas.
NOTE_TEXT = """concat(
  CASE WHEN doc_id % 4 = 0 THEN concat('---', chr(10), 'title: Note ', CAST(doc_id AS STRING), chr(10), 'tags: "alpha"', chr(10), 'empty:', chr(10), 'title: Last ', CAST(doc_id AS STRING), chr(10), CASE WHEN doc_id % 8 = 0 THEN concat('---', chr(10)) ELSE '' END) ELSE '' END,
  '# Note ', CAST(doc_id % 10 AS STRING), chr(10), chr(10),
  '## Alpha part', chr(10), text, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('> [!question] Why', chr(10), '> because of it', chr(10), '> ## Quoted part', chr(10), '> [!success] Done see [[#Quoted part]]', chr(10), '> [!tip] More', chr(10), '> [!odd] Kind', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('> [!todo] Later', chr(10), '> ', substr(text, 30, 40), chr(10), 'after the list', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 19 = 0 THEN concat('### Dense', chr(10), repeat(concat('> [!example] Case', chr(10), repeat(concat('> so', chr(10)), 9)), 7)) ELSE '' END,
  CASE WHEN doc_id % 23 = 0 THEN concat('#### Denser', chr(10), repeat(concat('> [!question] Q', chr(10), '> [!success] A', chr(10), '> [!note] N', chr(10), repeat(concat('so', chr(10)), 50)), 6)) ELSE '' END,
  '### Sub ##', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | ', CASE WHEN doc_id % 6 = 0 THEN '2 | 3 |' ELSE 'x' || chr(92) || '|y |' END, chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat('```py', chr(10), '# not a heading', chr(10), '~~~', chr(10), '```', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN concat('##### Deep', chr(10), 'trailing  ', chr(10), 'again ', chr(10), 'more ', chr(10), 'and ', chr(10)) ELSE '' END,
  '## Beta part', chr(10), CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('see [[#Alpha part]] and [[#Gone|x]] or [[Other#Sub]]', chr(10)) END,
  CASE WHEN doc_id % 13 = 0 THEN concat('## Alpha part', chr(10), 'second', chr(10)) ELSE '' END,
  '## Gamma', chr(10), 'mass $E = mc^2$ and $$', chr(92), 'frac{a}{b} ', chr(92), 'oddmacro x$$ end', chr(10), text, chr(10),
  CASE WHEN doc_id % 17 = 0 THEN concat('```', chr(10), 'never closed', chr(10)) ELSE '' END,
  '## 相关链接', chr(10), 'link ', substr(text, 1, 20))"""
NOTE_SQL = f"SELECT doc_id AS note_id, {NOTE_TEXT} AS text FROM documents"

#: Oracle side: notes and their lines (the text ends without a line feed, and holds no other line ends).
NOTE = f"note AS ({NOTE_SQL})"
LINE = NOTE + ", line AS (SELECT note_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM (SELECT note_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM note))"
TOGGLE = LINE + r""", fl AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM line),
  tg AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY note_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM fl),
  head AS (SELECT note_id, pos, length(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*$', 1))::INT AS level,
    trim(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*$', 2), '\s*#+\s*$', '')) AS title, line AS raw
    FROM tg WHERE NOT fence AND NOT in_code AND regexp_matches(line, '^(#{1,6})\s+(.*?)\s*$'))"""
#: Matching fences as a recursive walk over a note's fence lines.
MATCH = LINE + r""", fk AS (SELECT note_id, pos, regexp_extract(line, '^\s*(```|~~~)', 1) AS kind, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS k FROM line WHERE regexp_matches(line, '^\s*(```|~~~)')),
  st AS (WITH RECURSIVE w(note_id, k, pos, o, fa) AS (
    SELECT note_id, k, pos, kind, pos FROM fk WHERE k = 1
    UNION ALL SELECT fk.note_id, fk.k, fk.pos, CASE WHEN w.o IS NULL THEN fk.kind WHEN w.o = fk.kind THEN NULL ELSE w.o END,
      CASE WHEN w.o IS NULL THEN fk.pos WHEN w.o = fk.kind THEN NULL ELSE w.fa END FROM w JOIN fk ON fk.note_id = w.note_id AND fk.k = w.k + 1) SELECT * FROM w),
  cd AS (SELECT l.note_id, l.pos, l.line, fk.k IS NOT NULL AS fence,
    (SELECT arg_max(coalesce(o, ''), st.pos) FROM st WHERE st.note_id = l.note_id AND st.pos <= l.pos) AS o,
    regexp_replace(l.line, '^\s*(?:>\s*)+', '') AS bare FROM line l LEFT JOIN fk USING (note_id, pos)),
  live AS (SELECT note_id, pos, line, bare FROM cd WHERE NOT fence AND coalesce(o, '') = ''),
  lh AS (SELECT note_id, pos, length(regexp_extract(bare, '^(#{1,6})\s+(.*?)\s*$', 1))::INT AS level,
    trim(regexp_replace(regexp_extract(bare, '^(#{1,6})\s+(.*?)\s*$', 2), '\s*#+\s*$', '')) AS title, bare <> line AS quoted
    FROM live WHERE regexp_matches(bare, '^(#{1,6})\s+(.*?)\s*$')),
  co AS (SELECT note_id, pos, regexp_extract(line, '^\s*>\s*\[!([A-Za-z-]+)\]', 1) AS kind FROM live WHERE regexp_matches(line, '^\s*>\s*\[!([A-Za-z-]+)\]')),
  nl AS (SELECT note_id, count(*)::INT AS n_lines FROM line GROUP BY note_id)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id AS note_id", f"{NOTE_TEXT} AS text")


def note_query(query):
    """Registers a query over notes by `query`, with its SQL."""
    return lambda name, sql=None: lambda f: query(name, sql)(lambda spark, d: f(notes(spark, d)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
