"""The engine's own queries, each with the SQL that another engine answers it by.

Features that the tables lack (headings, numerals, runs of text) come from small inline
relations; their SQL gives the rows derived by hand from the operators' definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import html, numbers, punctuation, services, strings
from textloom.operators import joins, report, runs, sequence
from textloom.operators.glossary_replace import glossary_hits, glossary_replace, glossary_replace_runs
from textloom.operators.ranking import global_rank
from textloom.plans import crawl
from textloom.sources import glossary, images
from textloom.sources.lines import to_lines
from textloom.sources.shared import shared_path
from textloom.streaming import poll

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries over inline rows, whose SQL is the rows expected: (query, SQL). table_catalog.py has most of them over tables.
EXAMPLES: dict[str, tuple[Query, str]] = {}

#: A glossary of pieces that occur in the tables' text, one key being the start of another.
GLOSSARY = {"the": "THE", "then": "THEN", "tion": "TION", "and": "AND", "ing": "ING"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
            if sql.startswith("SELECT * FROM (VALUES"):
                EXAMPLES[f.__name__] = f, sql
        return f

    return register


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _lit(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return f"{v}::BIGINT"
    return "'" + str(v).replace("'", "''") + "'"


def _golden(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS t({columns})"


LINES_SQL = """lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents))"""
STRIP_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


# ---- pages and chapters


@query(f"SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS number, length({STRIP_SQL.format('html')}) AS char_count FROM pages")
def chapter_char_count(spark, sf_dir):
    return report.chapter_counts(table(spark, sf_dir, "pages"), "page_id").select("page_id", "url", F.col("number").cast("long").alias("number"), "char_count")


@query(f"""SELECT lang, count(*) AS n_chapters, sum(length({STRIP_SQL.format('html')}))::BIGINT AS total_chars
FROM (SELECT html, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages) GROUP BY ROLLUP (lang)""")
def chapter_report_totals(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.length(html.strip_html(F.col("html"))).cast("long").alias("char_count"))
    return report.totals(pages, "lang")


@query(f"""WITH c AS (SELECT url, row_number() OVER (ORDER BY page_id) AS number, length({STRIP_SQL.format('html')}) AS n FROM pages)
SELECT number, rpad(number::VARCHAR, 10, ' ') || ' | ' || rpad(left(url, 60), 60, ' ') || ' | ' || lpad(format('{{:,}}', n), 20, ' ') AS line FROM c""")
def chapter_report_rows(spark, sf_dir):
    rows = report.report_rows(report.chapter_counts(table(spark, sf_dir, "pages"), "page_id"), "url")
    return rows.select(F.col("number").cast("long").alias("number"), "line")


@query(f"""SELECT page_id, length(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'))::BIGINT AS without_script, md5({STRIP_SQL.format('html')}) AS text_md5 FROM pages""")
def strip_script_style(spark, sf_dir):
    no_script = F.regexp_replace("html", r"(?is)<script.*?</script>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.length(no_script).cast("long").alias("without_script"), F.md5(html.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''),
  nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), 'Chapter ' || row_number() OVER (ORDER BY page_id)) AS title FROM pages""")
def page_title_h1(spark, sf_dir):
    title = strings.strip(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    found = F.coalesce(F.nullif(html.first_h1(F.col("html")), F.lit("")), F.nullif(title, F.lit("")))
    pages = global_rank(table(spark, sf_dir, "pages").select("page_id", found.alias("found")), ["page_id"], "n")
    return pages.select("page_id", F.coalesce("found", F.concat(F.lit("Chapter "), "n")).alias("title"))


@query("""SELECT page_id, md5(regexp_replace(regexp_extract(html, '(?is)<article>(.*)</article>', 1), '(?is)<a\\b[^>]*>.*?</a>', '', 'g')) AS content_md5 FROM pages""")
def page_content_without_links(spark, sf_dir):
    article = F.regexp_extract("html", r"(?is)<article>(.*)</article>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.without_links(article).cast("binary")).alias("content_md5"))


@query("""SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"', 1) AS l FROM pages)""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT page_id, (length(url) - length(replace(url, '/', '')))::BIGINT AS slashes, split_part(url, '#', 1) AS plain,
  regexp_extract(url, '^(.*)/[^/]*$', 1) AS root,
  CASE WHEN regexp_extract(url, '/(\\d+)[^/]*$', 1) <> '' THEN regexp_extract(url, '^(.*)/[^/]*$', 1) || '/' || (regexp_extract(url, '/(\\d+)[^/]*$', 1)::BIGINT + 1) || '.html' END AS next_url FROM pages""")
def url_rules(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(url, F.lit("/")).cast("long").alias("slashes"), strings.strip_fragment(url).alias("plain"), strings.url_root(url).alias("root"), strings.next_numbered_url(url).alias("next_url"))


@query("SELECT page_id, instr(lower(url), 'blog') > 0 AS flagged, CASE WHEN instr(lower(url), 'blog') > 0 THEN 'kept' ELSE 'complement' END AS side FROM pages")
def complement_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("flagged", F.contains(F.lower("url"), F.lit("blog")))
    return pages.where("flagged").withColumn("side", F.lit("kept")).unionByName(pages.where("NOT flagged").withColumn("side", F.lit("complement"))).select("page_id", "flagged", "side")


@query("""SELECT p.page_id, p.url, i.lang FROM (SELECT page_id, url, split_part(url, '#', 1) AS plain FROM pages) p
LEFT JOIN (SELECT split_part(url, '#', 1) AS plain, min(regexp_extract(html, '<html lang="([a-z]*)"', 1)) AS lang FROM pages GROUP BY 1) i USING (plain)""")
def href_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    items = pages.groupBy(strings.strip_fragment(F.col("url")).alias("item_href")).agg(F.min(F.regexp_extract("html", '<html lang="([a-z]*)"', 1)).alias("lang"))
    return joins.href_lookup(pages.select("page_id", "url"), items, href="url").select("page_id", "url", "lang")


@query("""SELECT page_id, md5(regexp_replace(html, '(?is)(<h1[^>]*>).*?(</h1>)', '\\1New ' || page_id || '\\2')) AS html_md5 FROM pages""")
def replace_headers(spark, sf_dir):
    new = F.concat(F.lit("New "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.replace_first_h1(F.col("html"), new).cast("binary")).alias("html_md5"))


@query("""SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'absolute' WHEN contains(url, 'example.net') THEN 'root' ELSE 'invalid' END AS mode FROM pages""")
def site_rule_dispatch(spark, sf_dir):
    rules = _values(spark, [("example.com", "absolute"), ("example.net", "root")], "site string, mode string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(example\.\w+)", 1).alias("site"))
    return joins.lookup_or(pages, rules, "site", "mode", "invalid").select("page_id", "mode")


@query("""SELECT page_id, upper(left(l, 1)) || lower(l[2:]) AS label, 'Chapter ' || page_id || ' - ' || l AS nav, 'Chapter ' || page_id || ': ' || l AS ncx
FROM (SELECT page_id, replace(regexp_extract(url, '([^/]*)$', 1), '_', ' ') AS l FROM pages)""")
def page_labels(spark, sf_dir):
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", strings.filename_to_label(name).alias("label"), strings.nav_label(F.col("page_id"), F.replace(name, F.lit("_"), F.lit(" "))).alias("nav"), strings.ncx_label(F.col("page_id"), F.replace(name, F.lit("_"), F.lit(" "))).alias("ncx"))


_SITE_PAGES = [
    ("royalroad", "http://r/1", '<title> One </title><div class="chapter-inner chapter-content"><p>a</p><a href="q">ad</a><div>b</div></div><a class="btn btn-primary col-xs-12" href="/1">Previous</a><a class="btn btn-primary col-xs-12" href="/2">Next Chapter</a>'),
    ("readnovelfull", "http://r/1", '<a class="chr-title" title="T1">other</a><div id="chr-content">x</div><a id="next_chap" href="/n">n</a>'),
    ("biquge", "http://r/1", '<h1>site</h1><div class="book"><h1>B</h1></div><div id="chaptercontent">y</div><a id="next_url" href="/b/c/2">n</a>'),
    ("tongrenquan", "http://r/7.html", '<h1>C</h1><div class="read_chapterDetail">z</div>'),
    ("bixiange", "http://r/7.html", '<h1>C</h1><div class="content">z</div><a href="/1">下一页</a><div class="mPage"><a href="/9">下一页</a></div>'),
    ("tracan", "http://r/1", '<title>D</title><a href="/y">Next</a><div class="entry-content">e Partager f<a href="/z">Next</a></div>'),
    ("xszj", "http://r/1", '<title>X</title><h1 class="bookname">K</h1><div id="booktxt">t</div><a rel="prev" href="/b/0">p</a><a rel="prev" href="/b/2">q</a>'),
    ("shuhaige", "http://r/1", '<title>S</title><a id="pager_next" href="/shu_1">n</a>'),
    ("elsewhere", "http://r/1", "<title>X</title>"),
]


@query(_golden("site, title, content, next_url", [
    ("royalroad", "One", '<h1>One</h1><div class="chapter-inner chapter-content"><p>a</p><div>b</div></div>', "http://r/2"),
    ("readnovelfull", "T1", '<h1>T1</h1><div id="chr-content">x</div>', "http://r/n"),
    ("biquge", "B", '<h1>B</h1><div id="chaptercontent">y</div>', "http://r/b/c/2"),
    ("tongrenquan", "C", '<h1>C</h1><div class="read_chapterDetail">z</div>', "http://r/8.html"),
    ("bixiange", "C", '<h1>C</h1><div class="content">z</div>', "http://r/9"),
    ("tracan", "D", '<h1>D</h1><div class="entry-content">e ', "/z"),
    ("xszj", "K", '<h1>K</h1><div id="booktxt">t</div>', "http://r/b/2"),
    ("shuhaige", "S", None, None),
    ("elsewhere", None, None, None),
]))
def site_extraction(spark, sf_dir):
    pages = _values(spark, [(*r, "http://r") for r in _SITE_PAGES], "site string, url string, html string, root string")
    return crawl.extract(pages).select("site", "title", "content", "next_url")


# ---- documents and lines


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.html_escape(F.col("text")).cast("binary")).alias("escaped_md5"))


@query(f"""WITH {LINES_SQL},
k AS (SELECT *, rtrim(trim(line), '.,!?;:"''。，！？；：“”‘’') AS key FROM lines),
n AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS nth FROM r) WHERE nth % 2 = 1""")
def dedup_consecutive_lines(spark, sf_dir):
    lines = to_lines(table(spark, sf_dir, "documents"))
    return sequence.drop_alternate_repeats(lines).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


CONV_SECTIONS_SQL = "s AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations)"


@query(f"WITH {CONV_SECTIONS_SQL} SELECT conv_id, turn, section FROM s WHERE section > 0")
def heading_sections(spark, sf_dir):
    rows = sequence.sections(table(spark, sf_dir, "conversations"), F.col("role") == "user", "conv_id", "turn")
    return rows.select("conv_id", "turn", F.col("section").cast("long").alias("section"))


@query(f"WITH {CONV_SECTIONS_SQL} SELECT conv_id, section, count(*) AS n_rows, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM s WHERE section > 0 GROUP BY ALL")
def section_text(spark, sf_dir):
    rows = sequence.sections(table(spark, sf_dir, "conversations"), F.col("role") == "user", "conv_id", "turn")
    joined = sequence.section_texts(rows, doc="conv_id", pos="turn")
    return joined.select("conv_id", F.col("section").cast("long").alias("section"), "n_rows", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH m AS (SELECT *, role = 'user' AS head, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations)
SELECT b.conv_id, b.turn, b.section, coalesce(md5(h.text), 'front') AS title FROM m b LEFT JOIN m h ON b.conv_id = h.conv_id AND b.section = h.section AND h.head WHERE NOT b.head""")
def titled_chapters(spark, sf_dir):
    rows = sequence.titled_sections(table(spark, sf_dir, "conversations"), F.col("role") == "user", doc="conv_id", pos="turn", front="front")
    return rows.select("conv_id", "turn", F.col("section").cast("long").alias("section"), F.when(F.col("section") == 0, F.col("title")).otherwise(F.md5(F.col("title").cast("binary"))).alias("title"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, (floor((rn - 1) / ceil(n / 4.0)) + 1)::BIGINT AS part FROM o""")
def split_into_n_files(spark, sf_dir):
    rows = sequence.deal_sections(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 4, "o_custkey", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", F.col("part").cast("long").alias("part"))


@query(_golden("pos, text", [(0, "C1"), (1, "b1"), (3, "b2"), (4, "C2"), (5, "C1"), (6, "C1x")]))
def merge_adjacent_headings(spark, sf_dir):
    rows = [(1, 0, "Heading 1", "C1 (1/2)"), (1, 1, "Normal", "b1"), (1, 2, "Heading 1", "C1 [2/2]"), (1, 3, "Normal", "b2"), (1, 4, "Heading 1", "C2"), (1, 5, "Heading 1", "C1（1/2)"), (1, 6, "Heading 1", "C1x")]
    df = _values(spark, rows, "doc_id long, pos long, style string, text string")
    return sequence.merge_repeated_headings(df, sequence.heading_1(F.col("style"))).select("pos", "text")


@query(f"""WITH {LINES_SQL},
t AS (SELECT doc_id, pos, trim(line) AS t FROM lines WHERE trim(line) <> ''),
e AS (SELECT *, coalesce(lag(right(t, 1) IN ('。', '！', '？', '…', '”', '.', '!', '?', '"')) OVER (PARTITION BY doc_id ORDER BY pos)::INT, 0) AS starts FROM t),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM e)
SELECT doc_id, min(pos) AS pos, md5(string_agg(t, '' ORDER BY pos)) AS text_md5 FROM g GROUP BY doc_id, grp""")
def join_until_terminator(spark, sf_dir):
    rows = sequence.join_until_terminator(to_lines(table(spark, sf_dir, "documents")), F.lit(False), text="line")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_golden("removed, text", [(1, "Merge Report\n====================\nTotal redundant headers removed: 1\n\nMerged: 'C1 [2/2]' -> into -> 'C1'\n")]))
def merge_report(spark, sf_dir):
    rows = [(1, 0, "Heading 1", "C1 (1/2)"), (1, 1, "Normal", "b1"), (1, 2, "Heading 1", "C1 [2/2]"), (1, 3, "Heading 1", "C2")]
    df = _values(spark, rows, "doc_id long, pos long, style string, text string")
    return sequence.merge_report(df, sequence.heading_1(F.col("style"))).select("removed", "text")


@query(_golden("pos, is_heading, text", [(0, False, "abcd."), (2, True, "H"), (3, False, "ef")]))
def join_with_headings(spark, sf_dir):
    df = _values(spark, [(1, 0, "Normal", "ab"), (1, 1, "Normal", "cd."), (1, 2, "Heading 2", "H"), (1, 3, "Normal", " ef "), (1, 4, "Normal", " ")], "doc_id long, pos long, style string, text string")
    return sequence.join_until_terminator(df, sequence.heading_prefix(F.col("style"))).select("pos", "is_heading", "text")


@query(f"""WITH RECURSIVE {LINES_SQL},
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos,
  len(regexp_extract_all(regexp_replace(line, '\\b(Mt|Mrs|Mr|Ms|Dr|Prof)[.!?]', '', 'g'), '[.!?]')) AS n,
  right(trim(line), 1) IN ('"', '”', '''') AS quote,
  regexp_matches(trim(line), '^(\\(.*\\)|\\[.*\\]|（.*）|【.*】)$') AS alone FROM lines WHERE trim(line) <> ''),
f AS (
  SELECT doc_id, i, pos, 1 AS grp, CASE WHEN alone THEN 0 ELSE 0 END + n AS cnt, alone OR n >= 4 OR quote AS closed FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.pos, f.grp + (f.closed OR l.alone)::INT, CASE WHEN f.closed OR l.alone THEN 0 ELSE f.cnt END + l.n,
    l.alone OR l.quote OR CASE WHEN f.closed OR l.alone THEN 0 ELSE f.cnt END + l.n >= 4 FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, grp::BIGINT AS grp, count(*) AS n_lines, min(pos) AS first_pos FROM f GROUP BY ALL""")
def reflow_n_sentences(spark, sf_dir):
    groups = sequence.reflow_groups(to_lines(table(spark, sf_dir, "documents")), 4, text="line")
    return groups.groupBy("doc_id", F.col("group").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").cast("long").alias("first_pos"))


@query(_golden("grp, n_lines, text", [(1, 2, "He came. She saw, Mr. Fox"), (2, 1, "(note)"), (3, 1, 'She said "no"'), (4, 1, "One. Two..."), (5, 1, "Four! Five? Six.")]))
def reflow_golden(spark, sf_dir):
    texts = ["He came.", "She saw, Mr. Fox", "(note)", 'She said "no"', "", "One. Two...", "Four! Five? Six."]
    df = _values(spark, [(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos long, text string")
    return sequence.reflow(df).select(F.col("group").cast("long").alias("grp"), "n_lines", "text")


@query(_golden("id, text", [(1, "ab cd"), (2, "ab-cd"), (3, "ab, cd"), (4, "ab — cd"), (5, "ab cd"), (6, "cd")]))
def smart_spacing(spark, sf_dir):
    df = _values(spark, [(1, "ab", "cd"), (2, "ab-", "cd"), (3, "ab", ", cd"), (4, "ab — ", "cd"), (5, "ab ", "cd"), (6, "", "cd")], "id long, a string, b string")
    return df.select("id", strings.smart_join(F.col("a"), F.col("b")).alias("text"))


@query("""SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\\b(Mt|Mrs|Mr|Ms|Dr|Prof)[.!?]', '', 'g'), '[.!?]'))::BIGINT AS n_ends,
  md5(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '\\.{2,}|…+', '...', 'g'), ',{2,}', ',', 'g')) AS clean_md5 FROM documents""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.sentence_ends(F.col("text")).cast("long").alias("n_ends"), F.md5(strings.ellipsis_cleanup(F.col("text")).cast("binary")).alias("clean_md5"))


@query("""SELECT doc_id, generate_subscripts(c, 1)::BIGINT AS n, unnest(c) AS chunk FROM (
  SELECT doc_id, [array_to_string(w[i:i + 3], ' ') || chr(10) for i in range(1, len(w) + 1, 4)] AS c FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))""")
def chunk_words(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(strings.chunk_words(F.col("text"))).alias("n", "chunk"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "chunk")


@query("""WITH b AS (SELECT doc_id % 7 AS file_ord, doc_id AS pos, text FROM documents)
SELECT file_ord, pos, kind, md5(text) AS text_md5 FROM (SELECT file_ord, pos, 'row' AS kind, text FROM b
UNION ALL SELECT file_ord, max(pos) + 1, 'break', NULL FROM b WHERE file_ord < (SELECT max(file_ord) FROM b) GROUP BY file_ord)""")
def ordered_union_with_breaks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("file_ord"), F.col("doc_id").alias("pos"), "text")
    return sequence.union_with_breaks(rows).select("file_ord", "pos", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def language_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "lang")


@query(_golden("id, n, fragment", [(1, 0, "One"), (1, 1, "."), (1, 2, "Two"), (1, 3, "(three)"), (1, 4, "four"), (1, 5, "!?"), (2, 0, "She said"), (2, 1, '"no"'), (2, 2, "and left"), (3, 0, "it"), (3, 1, "'s Bob'"), (3, 2, "s")]))
def fragments(spark, sf_dir):
    df = _values(spark, [(1, "One. Two (three) four!?"), (2, 'She said "no" and left'), (3, "it's Bob's"), (4, "  ")], "id long, t string")
    return df.select("id", F.posexplode(html.fragments(F.col("t"))).alias("n", "fragment")).withColumn("n", F.col("n").cast("long"))


@query(_golden("part, html", [("inject", "<title>L: t</title><body><h1>L: x"), ("heading", "<body><h1>L</h1>x"), ("trailer", "<p>a</p></body>"), ("minify", "<p>a b</p><p>c</p>")]))
def page_edits(spark, sf_dir):
    df = _values(spark, [("inject", "<title>t</title><body>\n    <h1>x"), ("heading", "<body>x"), ("trailer", "<p>a</p><p>----- x\n y ----</p></body>"), ("minify", " <p>a  b</p>\n<!-- c -->\n<p>c</p> ")], "part string, h string")
    h, label = F.col("h"), F.lit("L")
    return df.select("part", F.when(F.col("part") == "inject", html.inject(h, label)).when(F.col("part") == "heading", html.inject_heading(h, label)).when(F.col("part") == "trailer", html.drop_trailer(h)).otherwise(html.minify(h)).alias("html"))


# ---- glossaries

_ALTERNATION = "then|tion|the|and|ing"
_PAD = "replace(replace(replace(replace(replace(t, 'then', ' THEN '), 'tion', ' TION '), 'the', ' THE '), 'and', ' AND '), 'ing', ' ING ')"


@query(f"""SELECT doc_id, md5(array_to_string([CASE WHEN t IN ('then', 'tion', 'the', 'and', 'ing') THEN ' ' || upper(t) || ' ' ELSE t END
  for t in regexp_extract_all(text, '(?s){_ALTERNATION}|[^tai]+|.')], '')) AS text_md5 FROM documents""")
def glossary_replaced(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(glossary_replace(F.col("text"), GLOSSARY).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_ALTERNATION}'))::BIGINT AS hits FROM documents")
def glossary_replace_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", glossary_hits(F.col("text"), GLOSSARY).alias("hits"))


@query(_golden("id, text, hits", [(1, "z Y  X ", 2), (2, "none", 0), (3, " X c", 1)]))
def glossary_golden(spark, sf_dir):
    g = {"ab": "X", "abc": "Y", "a.c": "Z"}
    df = _values(spark, [(1, "zabcab"), (2, "none"), (3, "abxc".replace("x", ""))], "id long, t string").withColumn("t", F.when(F.col("id") == 3, F.lit("ab" + "c")).otherwise(F.col("t")))
    return df.select("id", F.when(F.col("id") == 3, glossary_replace(F.lit("abc"), {"ab": "X"})).otherwise(glossary_replace(F.col("t"), g)).alias("text"), F.when(F.col("id") == 3, glossary_hits(F.lit("abc"), {"ab": "X"})).otherwise(glossary_hits(F.col("t"), g)).alias("hits"))


@query(_golden("id, runs", [(1, "x :i| X :b| Z:i"), (2, "none:b|!:b"), (3, "")]))
def glossary_in_runs(spark, sf_dir):
    rows = [(1, [("x ", "i"), ("a", "b"), ("b", "i"), (" Z", "i")]), (2, [("none", "b"), ("!", "b")]), (3, [])]
    df = _values(spark, rows, "id long, r array<struct<text:string,style:string>>")
    out = glossary_replace_runs(F.col("r"), {"ab": "X"})
    return df.select("id", F.array_join(F.transform(out, lambda s: F.concat(s["text"], F.lit(":"), s["style"])), "|").alias("runs"))


_GLOSSARY_LINES = [(0, "﻿k = 1"), (1, "# c=1"), (2, ""), (3, "k=2"), (4, "no pair"), (5, " a = b = c "), (6, " = x"), (7, "z=")]


@query(_golden("line_no, k, v", [(0, "k", "1"), (5, "a", "b = c"), (7, "z", "")]))
def glossary_load_rules(spark, sf_dir):
    return glossary.first_wins(_values(spark, _GLOSSARY_LINES, "line_no long, line string"))


@query(_golden("line_no, k, v", [(1, "# c", "1"), (3, "k", "3"), (5, "a ", " b = c"), (6, "", " x"), (7, "z", "")]))
def glossary_load_last_wins(spark, sf_dir):
    lines = [(n, x) for n, x in _GLOSSARY_LINES if n] + [(8, "k=3")]
    return glossary.last_wins(_values(spark, lines, "line_no long, line string"))


EVENT_GLOSSARY_SQL = """g AS (SELECT event_id % 5 AS file_ord, min(event_id) AS line_no, user_id::VARCHAR AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1, 3)"""


def _event_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("file_ord"), F.col("event_id").alias("line_no"), F.concat_ws("=", F.col("user_id").cast("string"), "event_type").alias("line"))
    return glossary.last_wins(events, "file_ord")


@query(f"""WITH {EVENT_GLOSSARY_SQL}, m AS (SELECT k, arg_min(v, (file_ord, line_no)) AS v, min((file_ord, line_no)) AS p FROM g GROUP BY k)
SELECT row_number() OVER (ORDER BY length(k) DESC, p) AS rank, k || '=' || v AS line FROM m""")
def glossary_merge(spark, sf_dir):
    return glossary.as_lines(glossary.merge(_event_glossary(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {EVENT_GLOSSARY_SQL}, w AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY file_ord, line_no) AS won FROM g)
SELECT k, file_ord, v FROM w WHERE v <> won UNION ALL SELECT DISTINCT k, (SELECT min(file_ord) FROM g), won FROM w WHERE v <> won""")
def glossary_conflicts(spark, sf_dir):
    return glossary.conflicts(_event_glossary(spark, sf_dir))


@query(_golden("k, text", [("k", "Key: k\n  -- 1: 1\n  -- 3: 2")]))
def glossary_conflict_report(spark, sf_dir):
    rows = [(1, 0, "x", "9"), (2, 0, "k", "1"), (3, 0, "k", "2"), (3, 1, "x", "9")]
    return glossary.conflict_report(_values(spark, rows, "file_ord long, line_no long, k string, v string"))


# ---- joins


@query("""SELECT rn, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) USING (rn)""")
def zip_titles(spark, sf_dir):
    left, right = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    return joins.zip_by_position(left, right, ["c_custkey"], ["s_suppkey"]).select(F.col("rn").cast("long").alias("rn"), "c_custkey", "s_suppkey")


@query("""SELECT c_custkey, regexp_extract(c_name, '(\\d+)$', 1)::BIGINT AS number, row_number() OVER (ORDER BY regexp_extract(c_name, '(\\d+)$', 1)::BIGINT, c_name) AS rank FROM customer""")
def natural_sort_files(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", "c_name", strings.last_number(F.col("c_name")).alias("number"))
    return global_rank(named, joins.natural_order(F.col("c_name"), F.col("number")), "rank").select("c_custkey", "number", "rank")


@query("""SELECT s.o_custkey AS book_id, s.o_orderkey AS item_id, row_number() OVER (PARTITION BY s.o_custkey ORDER BY s.o_orderkey) AS number
FROM orders s JOIN (SELECT DISTINCT l_orderkey FROM lineitem) i ON s.o_orderkey = i.l_orderkey""")
def spine_numbers(spark, sf_dir):
    spine = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("pos"))
    items = table(spark, sf_dir, "lineitem").join(spine.select("item_id", "book_id"), F.col("l_orderkey") == F.col("item_id")).select("book_id", "item_id").distinct()
    return joins.spine_items(spine, items).select("book_id", "item_id", F.col("number").cast("long").alias("number"))


@query("""SELECT d.doc_id, md5(CASE WHEN d.doc_id % 3 = 0 AND length(d.text) > 0 THEN replace(d.text, 'a', 'A') ELSE d.text END) AS content_md5 FROM documents d""")
def cleaned_or_original(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    cleaned = docs.where("doc_id % 3 < 2").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.replace("content", F.lit("a"), F.lit("A"))).otherwise(F.lit("")))
    return joins.merge_cleaned(docs, cleaned, ["doc_id"]).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


# ---- scalars on inline rows


@query(_golden("t, out", [("1. Foo", "1: Foo"), ("1 Foo", "1: Foo"), ("1.2.3 X", "1.2.3: X"), ("12: x", "12: x"), ("Foo 1", "Foo 1"), ("1.", "1:")]))
def number_heading_colon(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("1. Foo", "1 Foo", "1.2.3 X", "12: x", "Foo 1", "1.")], "t string")
    return df.select("t", numbers.number_heading_colon(F.col("t")).alias("out"))


@query(_golden("id, runs", [(1, "1:|. Foo"), (2, "1:| Foo"), (3, "1: Foo"), (4, "a|b"), (5, "12:|x")]))
def number_heading_runs(spark, sf_dir):
    df = _values(spark, [(1, ["1", ". Foo"]), (2, ["1.", " Foo"]), (3, ["1. Foo"]), (4, ["a", "b"]), (5, ["12", "x"])], "id long, r array<string>")
    return df.select("id", F.array_join(runs.number_heading_runs(F.col("r")), "|").alias("runs"))


@query(_golden("t, n", [("One Thousand Five Hundred and Thirty Six", 1536), ("hundred", 100), ("one two", 3), ("foo", None), ("and", None), ("Twenty-Five", 25), ("thousand one", 1001)]))
def words_to_number(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("One Thousand Five Hundred and Thirty Six", "hundred", "one two", "foo", "and", "Twenty-Five", "thousand one")], "t string")
    return df.select("t", numbers.words_to_number(F.col("t")).alias("n"))


@query(_golden("t, out", [("Chapter Twenty Five: X", "Chapter 20 Five: X"), ("Chapter Twenty-Five: X", "Chapter 25: X"), ("Chapter Five", "Chapter 5"), ("chapter two, and Chapter Foo.", "chapter 2, and Chapter Foo."), ("no", "no")]))
def chapter_words(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("Chapter Twenty Five: X", "Chapter Twenty-Five: X", "Chapter Five", "chapter two, and Chapter Foo.", "no")], "t string")
    return df.select("t", numbers.rewrite_chapter_words(F.col("t")).alias("out"))


@query(_golden("t, n", [("十二", 12.0), ("二百零三", 203.0), ("一万二千", 12000.0), ("一二三", 3.0), ("一万亿", 100010000.0), ("3万5", 30005.0), ("负三", -3.0), ("三点五", 3.5), ("120", 120.0)]))
def cjk_to_number(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("十二", "二百零三", "一万二千", "一二三", "一万亿", "3万5", "负三", "三点五", "120")], "t string")
    return df.select("t", numbers.cjk_to_number(F.col("t")).alias("n"))


@query(_golden("t, out", [("CHAPTER 十二: x", "CHAPTER 12: x"), ("Chapter 十二: x", "Chapter 十二: x"), ("CHAPTER三点五:", "CHAPTER3.5:"), ("a CHAPTER 一百: b CHAPTER 二:", "a CHAPTER 100: b CHAPTER 2:")]))
def chapter_numerals(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("CHAPTER 十二: x", "Chapter 十二: x", "CHAPTER三点五:", "a CHAPTER 一百: b CHAPTER 二:")], "t string")
    return df.select("t", numbers.rewrite_chapter_numerals(F.col("t")).alias("out"))


@query(_golden("t, out", [("a....b,,c", "a...b,c"), ("x…y", "x...y"), ("a\nb", "a b"), ("a.b", "a.b")]))
def ellipsis_cleanup(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("a....b,,c", "x…y", "a\nb", "a.b")], "t string")
    return df.select("t", strings.ellipsis_cleanup(F.col("t")).alias("out"))


@query(_golden("t, out", [("“a”、b。", '"a",b.'), ("【x】——y…", "[x]—y..."), ("‘q’「r」", "'q'\"r\"")]))
def punct_cjk_map(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("“a”、b。", "【x】——y…", "‘q’「r」")], "t string")
    return df.select("t", punctuation.map_marks(F.col("t")).alias("out"))


_PUNCT = [("3 . 5 and 1 , 000 %", "3.5 and 1,000%"), ("word.Next", "Word. Next"), ("don 't i know", "Don\\'t I know"), ("he said.\"Yes\"", "He said. \"Yes\""), ("what!!?? ok,,", "What!? Ok,"), ("( a ) b....c", "(a) b...c"), ("ｆｕｌｌ　ｗｉｄｔｈ，ｏｋ", "Full width, ok"), ("$ 5", "$5"), ("", "")]


@query(_golden("t, out", _PUNCT))
def punct_normalise_full(spark, sf_dir):
    return _values(spark, [(t,) for t, _ in _PUNCT], "t string").select("t", punctuation.normalise(F.col("t")).alias("out"))


@query(_golden("id, runs", [(1, "end.| Start"), (2, 'he said "|yes"'), (3, "a|, b"), (4, "(|x|)"), (5, "a||b"), (6, "one")]))
def run_stitch(spark, sf_dir):
    df = _values(spark, [(1, ["end.", "Start"]), (2, ['he said "', ' yes"']), (3, ["a ", ", b"]), (4, ["( ", "x", " )"]), (5, ["a", "", "b"]), (6, ["one"])], "id long, r array<string>")
    return df.select("id", F.array_join(runs.stitch(F.col("r")), "|").alias("runs"))


@query(_golden("id, runs", [(1, "a|b"), (2, "|a |b"), (3, "\ta|"), (4, "a")]))
def run_trim_ends(spark, sf_dir):
    df = _values(spark, [(1, [" a", "b "]), (2, ["", " a ", "b"]), (3, ["\ta", ""]), (4, ["  a  "])], "id long, r array<string>")
    return df.select("id", F.array_join(runs.trim_ends(F.col("r")), "|").alias("runs"))


@query(_golden("id, runs", [(1, "ab:x|c:y"), (2, "a:|b:x|c:"), (3, "")]))
def run_length_styles(spark, sf_dir):
    df = _values(spark, [(1, [("a", "x"), ("b", "x"), ("c", "y")]), (2, [("a", None), ("b", "x"), ("c", None)]), (3, [])], "id long, r array<struct<text:string,style:string>>")
    return df.select("id", F.array_join(F.transform(runs.merge_equal_styles(F.col("r")), lambda s: F.concat(s["text"], F.lit(":"), F.coalesce(s["style"], F.lit("")))), "|").alias("runs"))


@query(_golden("id, runs", [(1, "x|y"), (2, "x|yz"), (3, "x|"), (4, "xy")]))
def run_write_back(spark, sf_dir):
    df = _values(spark, [(1, ["a", "b"], ["x", "y"]), (2, ["a", "b"], ["x", "y", "z"]), (3, ["a", "b"], ["x"]), (4, [], ["x", "y"])], "id long, r array<string>, n array<string>")
    return df.select("id", F.array_join(runs.write_back(F.col("r"), F.col("n")), "|").alias("runs"))


@query(_golden("name, label, title", [("chapter_12.xhtml", "Chapter 12", "12"), ("001_The_End.xhtml", "001 the end", "The End"), ("COVER.xhtml", "Cover", None)]))
def filename_to_label(spark, sf_dir):
    df = _values(spark, [("chapter_12.xhtml",), ("001_The_End.xhtml",), ("COVER.xhtml",)], "name string")
    return df.select("name", strings.filename_to_label(F.col("name")).alias("label"), strings.filename_to_title(F.col("name")).alias("title"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(p_name[2:]) AS label FROM part")
def part_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.filename_to_label(F.col("p_name")).alias("label"))


@query(_golden("t, out", [("red widget", "RED WIDGET"), ("a very long walk home", "A VERY LONG\nWALK HOME"), ("extraordinarilylong x", "EXTRAORDINARILY\nLONG X"), ("", "")]))
def text_wrap(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("red widget", "a very long walk home", "extraordinarilylong x", "")], "t string")
    return df.select("t", strings.wrap_words(F.col("t")).alias("out"))


@query(_golden("id, html", [(1, "<u><i><b>t</b></i></u>"), (2, "&lt;a&amp;b&gt;"), (3, '<a href="#">x</a>'), (4, "<h1>T</h1>"), (5, "<li>q</li>"), (6, f"{html.TABLE_TAG}<tr>{html.CELL_TAG}a</td>{html.CELL_TAG}&lt;</td></tr></table>")]))
def html_builders(spark, sf_dir):
    yes, none = F.lit(True), F.lit(None).cast("boolean")
    out = (F.when(F.col("id") == 1, html.format_run(F.lit("t"), yes, yes, yes)).when(F.col("id") == 2, html.format_run(F.lit("<a&b>"), none, none, F.lit(False))).when(F.col("id") == 3, html.link(F.lit("x"), F.lit(None).cast("string")))
           .when(F.col("id") == 4, html.block(F.lit("Heading 1"), F.lit("T"))).when(F.col("id") == 5, html.block(F.lit("List Bullet"), F.lit("q"))).otherwise(html.table(F.array(F.array(F.lit("a"), F.lit("<"))))))
    return spark.range(1, 7).select("id", out.alias("html"))


@query(_golden("id, html", [(1, '<p class="a.b">HI <b>YOU</b></p><script>x.y</script>'), (2, "<!-- c -->A")]))
def text_nodes(spark, sf_dir):
    df = _values(spark, [(1, '<p class="a.b">hi <b>you</b></p><script>x.y</script>'), (2, "<!-- c -->a")], "id long, h string")
    return df.select("id", html.rewrite_text_nodes(F.col("h"), F.upper).alias("html"))


@query(_golden("c, r, g, b", [("RGBColor(0xff, 0x00)", None, None, None), ("0x0A10FF", 10, 16, 255), ("ff0000", 255, 0, 0), ("RGBColor(00FF7f)", 0, 255, 127), ("red", None, None, None)]))
def font_colours(spark, sf_dir):
    df = _values(spark, [(t,) for t in ("RGBColor(0xff, 0x00)", "0x0A10FF", "ff0000", "RGBColor(00FF7f)", "red")], "c string").withColumn("x", strings.rgb(F.col("c")))
    return df.select("c", *(F.col(f"x.{k}").cast("long").alias(k) for k in "rgb"))


@query(_golden("kind, base", [("hp", 115.0), ("stat", 120.0), ("even", 2.0)]))
def reverse_stats(spark, sf_dir):
    x = lambda v: F.lit(float(v))
    rows = [("hp", numbers.hp_base(x(371), x(31), x(0), x(100))), ("stat", numbers.stat_base(x(276), x(1), x(31), x(0), x(100))), ("even", F.bround(x(2.5)))]
    kinds = _values(spark, [(k,) for k, _ in rows], "kind string")
    return kinds.select("kind", F.when(F.col("kind") == "hp", rows[0][1]).when(F.col("kind") == "stat", rows[1][1]).otherwise(rows[2][1]).alias("base"))


@query("""SELECT p_partkey, round_even(((p_size * 8.0 / 1.1 - 5) * (100.0 / 50) - 31 - p_size / 4.0) / 2, 0)::DOUBLE AS base FROM part""")
def reverse_stats_parts(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.stat_base(size * 8.0, F.lit(1.1), F.lit(31.0), size, F.lit(50.0)).alias("base"))


@query("""SELECT vec_id, round(var_pop(x), 6) AS variance, var_pop(x) < 0.9 AS low FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def variance_threshold(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size("embedding")
    rows = table(spark, sf_dir, "embeddings").withColumn("_m", mean)
    variance = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("embedding")
    return rows.withColumn("_v", variance).select("vec_id", F.round("_v", 6).alias("variance"), (F.col("_v") < 0.9).alias("low"))


@query(_golden("id, bold, name, size, color", [(1, None, "B", 10.0, "red"), (2, True, "A", 12.0, "blue")]))
def copy_run_format(spark, sf_dir):
    fields = "bold:boolean,italic:boolean,underline:boolean,strike:boolean,superscript:boolean,subscript:boolean,name:string,size:double,color:string"
    flags = (None,) * 5
    df = _values(spark, [(1, (True, *flags, "A", 10.0, "red"), (None, *flags, "B", None, None)), (2, (None, *flags, "A", 10.0, None), (True, *flags, None, 12.0, "blue"))], f"id long, a struct<{fields}>, b struct<{fields}>")
    return df.withColumn("c", runs.copy_format(F.col("a"), F.col("b"))).select("id", "c.bold", "c.name", "c.size", "c.color")


@query(_golden("i, run, pos", [(0, 0, 0), (2, 0, 2), (3, 1, 1), (5, 2, 1), (6, None, None)]))
def locate_characters(spark, sf_dir):
    df = _values(spark, [(i, ["ab", "cd", "e"]) for i in (0, 2, 3, 5, 6)], "i int, r array<string>").withColumn("x", runs.locate(F.col("r"), F.col("i")))
    return df.select(F.col("i").cast("long").alias("i"), F.col("x.run").cast("long").alias("run"), F.col("x.offset").cast("long").alias("pos"))


@query(_golden("id, runs", [(1, "new||"), (2, "")]))
def collapse_heading_runs(spark, sf_dir):
    df = _values(spark, [(1, ["a", "b", "c"]), (2, [])], "id long, r array<string>")
    return df.select("id", F.array_join(runs.collapse_to_first(F.col("r"), F.lit("new")), "|").alias("runs"))


@query(_golden("name, chapter, not_cover, document", [("chapter_1.xhtml", True, True, False), ("Cover.xhtml", False, False, False), ("a.docx", False, True, True), ("~$a.docx", False, True, False)]))
def name_filters(spark, sf_dir):
    name = F.col("name")
    df = _values(spark, [("chapter_1.xhtml",), ("Cover.xhtml",), ("a.docx",), ("~$a.docx",)], "name string")
    return df.select("name", F.contains(name, F.lit("chapter")).alias("chapter"), (~F.contains(name, F.lit("Cover.xhtml"))).alias("not_cover"), (F.endswith(name, F.lit(".docx")) & ~F.startswith(name, F.lit("~"))).alias("document"))


@query(_golden("day", [("01-03-2024",)]))
def request_date(spark, sf_dir):
    return _values(spark, [("2024-02-29 23:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t")).select(poll.request_date("t").alias("day"))


@query(_golden("id, text", [(1, "The cat is on the roof ."), (2, ""), (3, "xyz")]))
def remove_language_fragments(spark, sf_dir):
    df = _values(spark, [(1, "The cat is on the roof. Le chat est dans la maison"), (2, ""), (3, "xyz")], "id long, t string")
    return df.select("id", services.remove_language(F.col("t"), "fr").alias("text"))


@query(_golden("id, variance, blurred", [(1, 0.0, True), (2, 1040400.0, False)]))
def image_blur(spark, sf_dir):
    board = [[255.0 * ((x + y) % 2) for x in range(4)] for y in range(4)]
    df = _values(spark, [(1, [[7.0] * 4] * 4), (2, board)], "id long, p array<array<double>>").withColumn("variance", images.laplacian_variance("p"))
    return df.select("id", F.round("variance", 6).alias("variance"), images.is_blurred(F.col("variance")).alias("blurred"))


@query("""SELECT o_orderkey, coalesce(nullif(o_orderkey % 3, 0), 1) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS number, (600 - length(o_orderpriority)) / 2 AS x FROM orders""")
def counter_numbers(spark, sf_dir):
    start = F.coalesce(F.nullif(F.col("o_orderkey") % 3, F.lit(0)), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (start + rank - 1).alias("number"), numbers.centred(F.lit(600), F.length("o_orderpriority")).alias("x"))


# ---- nested records, streams, walks

_CENTERS = '{"centers":[{"name":"A","address":"x","sessions":[{"available_capacity":3,"min_age_limit":18,"vaccine":"V"},{"available_capacity":0,"min_age_limit":18,"vaccine":"V"}]},{"name":"B","address":"y","sessions":[{"available_capacity":2,"min_age_limit":45,"vaccine":"W"}]}]}'


@query(_golden("center, address, slots, age, vaccine", [("A", "x", 3, 18, "V")]))
def nested_json_alerts(spark, sf_dir):
    snapshot = _values(spark, [(_CENTERS,)], "j string").select(F.from_json("j", poll.CENTERS).alias("d")).select("d.*")
    rows = poll.alerts(snapshot, 30)
    return rows.select("center", "address", F.col("slots").cast("long").alias("slots"), F.col("age").cast("long").alias("age"), "vaccine")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT BETWEEN 10 AND 40")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k BETWEEN 10 AND 40")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'")
def polling_stream(spark, sf_dir):
    out = shared_path(spark, "stream-out")
    poll.filtered_stream(spark, f"{sf_dir}/events.parquet", "event_type = 'error'", ["event_id", "user_id", "event_type"], out, shared_path(spark, "stream-state"))
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(out)


WALK_SQL = """RECURSIVE e AS (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY regexp_extract(html, '<html lang="([a-z]*)"', 1) ORDER BY page_id) AS dst FROM pages),
s AS (SELECT min(page_id) AS start FROM pages GROUP BY regexp_extract(html, '<html lang="([a-z]*)"', 1)),
w AS (SELECT start, 0 AS step, start AS node FROM s UNION ALL SELECT w.start, w.step + 1, e.dst FROM w JOIN e ON w.node = e.src WHERE e.dst IS NOT NULL)"""


@query(f"WITH {WALK_SQL} SELECT start, step::BIGINT AS step, node FROM w")
def linked_list_walk(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"))
    # the next page of a language is the next rank: no window over a language, which may hold most pages
    ranked = global_rank(pages, ["lang", "page_id"], "n")
    following = ranked.select(F.col("lang").alias("_lang"), (F.col("n") - 1).alias("_n"), F.col("page_id").alias("dst"))
    edges = ranked.join(following, (F.col("n") == F.col("_n")) & (F.col("lang") == F.col("_lang"))).select(F.col("page_id").alias("src"), "dst")
    return crawl.walk(edges, pages.groupBy("lang").agg(F.min("page_id").alias("start")))
