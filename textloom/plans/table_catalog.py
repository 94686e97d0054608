"""Queries of operators whose features the tables lack, over columns made from whole tables; SQL computes each answer.

They stand for the examples of the same names in catalog.py, which the tests keep running.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import html, numbers, punctuation, strings
from textloom.operators import runs, sequence
from textloom.plans.catalog import EVENT_GLOSSARY_SQL, ORACLE_SQL, QUERIES, _event_glossary, query, table
from textloom.sources import glossary, images
from textloom.streaming import poll

def _key() -> Column:
    return F.col("p_partkey")


def _pick(n: Column, *cases: Column | str | None) -> Column:
    """The case numbered n."""
    out = F.lit(None)
    for i, c in enumerate(cases):
        out = F.when(n == i, F.lit(c) if isinstance(c, (str, type(None))) else c).otherwise(out)
    return out


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


# ---- numerals


def _spelled(n: Column) -> Column:
    """English words of a number under ten million, millions as "ten hundred thousand" and on; odd numbers have an "and" after the hundreds."""
    units, tens = _lits(["", *numbers.UNITS]), _lits(["", "", *numbers.TENS])

    def small(x: Column) -> Column:
        return F.when(x < 20, F.get(units, x)).otherwise(F.concat_ws("-", F.get(tens, F.floor(x / 10).cast("int")), F.nullif(F.get(units, x % 10), F.lit(""))))

    def below(x: Column) -> Column:
        hundreds = F.when(x >= 100, F.concat(small(F.floor(x / 100).cast("int")), F.lit(" hundred"), F.when(x % 2 == 1, F.lit(" and")).otherwise(F.lit(""))))
        return F.concat_ws(" ", hundreds, F.nullif(small(x % 100), F.lit("")))

    n = n.cast("int")
    thousands = F.when(n >= 1000, F.concat(below(F.floor(n / 1000).cast("int")), F.lit(" thousand")))
    return F.concat_ws(" ", thousands, F.nullif(below(n % 1000), F.lit("")))


def _numeral(n: Column) -> Column:
    """CJK numeral of a number under 10^8, without placeholders for zero digits."""
    digits = _lits("零一二三四五六七八九")

    def section(x: Column) -> Column:
        parts = [F.when(F.floor(x / unit) % 10 > 0, F.concat(F.get(digits, (F.floor(x / unit) % 10).cast("int")), F.lit(name))) for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))]
        return F.concat_ws("", *parts)

    high = F.floor(n / 10_000)
    return F.when(n == 0, F.lit("零")).otherwise(F.concat(F.when(high > 0, F.concat(section(high), F.lit("万"))).otherwise(F.lit("")), section(n % 10_000)))


@query("SELECT p_partkey, nullif(p_partkey, 0) AS n FROM part")
def words_to_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.words_to_number(_spelled(_key())).alias("n"))


@query("SELECT p_partkey, 'Chapter ' || (p_partkey + 1) || ': ' || p_name AS out FROM part")
def chapter_words(spark, sf_dir):
    line = F.concat(F.lit("Chapter "), F.replace(_spelled(_key() + 1), F.lit(" "), F.lit("-")), F.lit(": "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.rewrite_chapter_words(line).alias("out"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN -p_partkey ELSE p_partkey END::DOUBLE AS n FROM part")
def cjk_to_number(spark, sf_dir):
    text = F.concat(F.when(_key() % 7 == 3, F.lit("负")).otherwise(F.lit("")), _numeral(_key()))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.cjk_to_number(text).alias("n"))


@query("SELECT p_partkey, p_name || ' CHAPTER ' || p_partkey || ': ' || p_type || ' CHAPTER' || p_size || ':' AS out FROM part")
def chapter_numerals(spark, sf_dir):
    line = F.concat("p_name", F.lit(" CHAPTER "), _numeral(_key()), F.lit(": "), "p_type", F.lit(" CHAPTER"), _numeral(F.col("p_size")), F.lit(":"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.rewrite_chapter_numerals(line).alias("out"))


@query(r"""SELECT p_partkey, regexp_replace(t, '^(\d+(?:\.\d+)*)[.:]?', '\1:') AS out FROM (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '. ' || p_name WHEN 1 THEN p_size || ' ' || p_name WHEN 2 THEN p_size || '.' || p_partkey || ' ' || p_name WHEN 3 THEN p_size || ': ' || p_name ELSE p_name || ' ' || p_size END AS t FROM part)""")
def number_heading_colon(spark, sf_dir):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    t = _pick(_key() % 5, F.concat(size, F.lit(". "), name), F.concat(size, F.lit(" "), name), F.concat(size, F.lit("."), _key().cast("string"), F.lit(" "), name), F.concat(size, F.lit(": "), name), F.concat(name, F.lit(" "), size))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.number_heading_colon(t).alias("out"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ':|. ' || p_name WHEN 1 THEN p_size || ':| ' || p_name WHEN 2 THEN p_size || ': ' || p_name ELSE p_name || '|' || p_size END AS runs FROM part""")
def number_heading_runs(spark, sf_dir):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    cases = [F.array(size, F.concat(F.lit(". "), name)), F.array(F.concat(size, F.lit(".")), F.concat(F.lit(" "), name)), F.array(F.concat(size, F.lit(". "), name)), F.array(name, size)]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs.number_heading_runs(_pick(_key() % 4, *cases)), "|").alias("runs"))


@query("SELECT p_partkey, round_even(((p_size * 8.0 - 10) * (100.0 / 50) - 100 - 31 - p_size / 4.0) / 2, 0)::DOUBLE AS base FROM part")
def reverse_stats(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.hp_base(size * 8.0, F.lit(31.0), size, F.lit(50.0)).alias("base"))


# ---- punctuation


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '.', '..…'), ', ', ',,, '), 'an', 'an…') , chr(10), ' '), '\.{2,}|…+', '...', 'g'), ',{2,}', ',', 'g')) AS out_md5 FROM documents""")
def ellipsis_cleanup(spark, sf_dir):
    t = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("..…")), F.lit(", "), F.lit(",,, ")), F.lit("an"), F.lit("an…"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.ellipsis_cleanup(t).cast("binary")).alias("out_md5"))


@query("""SELECT doc_id, md5(replace(replace(translate(replace(replace(translate(text, ',.!?', '，。！？'), ' of ', '……'), ' le ', ' “le”「la」——‘l’ '), '，。：；！？（）【】、“”‟「」『』‘’‛', ',.:;!?()[],\"\"\"\"\"\"\"'''''''), '…', '...'), '——', '—')) AS out_md5 FROM documents""")
def punct_cjk_map(spark, sf_dir):
    t = F.replace(F.replace(F.translate("text", ",.!?", "，。！？"), F.lit(" of "), F.lit("……")), F.lit(" le "), F.lit(" “le”「la」——‘l’ "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(punctuation.map_marks(t).cast("binary")).alias("out_md5"))


_MESSY = [(" and ", " 3 . 5 , i 'm and 1 , 000 %"), (", ", ",,"), (". ", "!!  "), (" de ", ' "De" don \'t '), (" by ", " ( by ) ")]


def _normal_sql(t: str) -> str:
    """The chain in expressions without lookaround; those that can overlap run twice."""

    def sub(x: str, pattern: str, to: str, times: int = 1) -> str:
        for _ in range(times):
            x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), to.replace("'", "''"))
        return x

    for pattern, to, times in (
        (r"(\d)\s*\.\s*(\d)", r"\1.\2", 1),
        (r"(\d)\s*,\s*(\d{3})", r"\1,\2", 1),
        (r"(\d)\s+%", r"\1%", 1),
        (r"([$€£¥])\s+(\d)", r"\1\2", 1),
        (r"([a-zA-Z])\s+'", r"\1\\'", 1),
        (r"(?i)'\s+(s|t|m|re|ll|ve|d)($|[^\p{L}\p{N}_])", r"'\1\2", 2),
        (r"(^|[^\p{L}\p{N}_])i($|[^\p{L}\p{N}_])", r"\1I\2", 2),
        (r'([a-zA-Z])"([A-Z])', r'\1 "\2', 2),
        (r"\s{2,}", " ", 1),
        (r'"\s+(\S)', r'"\1', 2),
        (r'([a-zA-Z0-9.,!?])\s+"', r'\1"', 1),
        (r"\(\s+", "(", 1),
        (r"\s+\)", ")", 1),
        (r"([.!?])([A-Z])", r"\1 \2", 1),
        (r"([,;:])([a-zA-Z])", r"\1 \2", 1),
        (r'([.,;:!?])"', r'\1 "', 1),
        (",{2,}", ",", 1),
        (":{2,}", ":", 1),
        (";{2,}", ";", 1),
        ("!{2,}", "!", 1),
        (r"\?{2,}", "?", 1),
        (r"\.{4,}", "...", 1),
    ):
        t = sub(t, pattern, to, times)
    return t


def _messy_sql(c: str) -> str:
    for a, b in _MESSY:
        c = "replace({}, '{}', '{}')".format(c, a.replace("'", "''"), b.replace("'", "''"))
    return c


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(upper(left(t, 1)) || t[2:], '(?s)[.!?]\s+[a-z]|[^.!?]+|.'), lambda x: CASE WHEN regexp_matches(x, '^[.!?]\s+[a-z]$') THEN x[:-2] || upper(x[-1:]) ELSE x END), '')) AS out_md5
FROM (SELECT doc_id, {_normal_sql(_messy_sql("text"))} AS t FROM documents)""")
def punct_normalise_full(spark, sf_dir):
    t = F.col("text")
    for a, b in _MESSY:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(punctuation.normalise(t, capitals="simple").cast("binary")).alias("out_md5"))


@query("""SELECT p_partkey, a || CASE WHEN a <> '' AND right(a, 1) NOT IN (' ', '-', '—') AND ltrim(b) <> '' AND left(ltrim(b), 1) NOT IN (',', '.', '!', '?', ':', ';') THEN ' ' ELSE '' END || b AS text
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '-' WHEN 2 THEN p_name || ' — ' WHEN 3 THEN p_name || ' ' ELSE '' END AS a,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN ', ' || p_type WHEN 2 THEN ' ' || p_type ELSE ' ' END AS b FROM part)""")
def smart_spacing(spark, sf_dir):
    a = _pick(_key() % 5, F.col("p_name"), F.concat("p_name", F.lit("-")), F.concat("p_name", F.lit(" — ")), F.concat("p_name", F.lit(" ")), "")
    b = _pick(_key() % 4, F.col("p_type"), F.concat(F.lit(", "), "p_type"), F.concat(F.lit(" "), "p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", strings.smart_join(a, b).alias("text"))


# ---- ordered text


_TITLE = "'C' || (turn // 6) || CASE turn % 4 WHEN 0 THEN ' (1/2)' WHEN 2 THEN ' [ 2 / 2 ]' ELSE '' END"
_HEADS = f"""h AS (SELECT conv_id, turn, {_TITLE} AS old, regexp_replace({_TITLE}, '\\s*[\\(\\[（]\\s*\\d+\\s*/\\s*\\d+\\s*[\\)\\]）]\\s*$', '') AS c FROM conversations WHERE role = 'user'),
m AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY turn) = c, FALSE) AS gone FROM h)"""


def _headed(spark, sf_dir):
    title = F.concat(F.lit("C"), F.floor(F.col("turn") / 6).cast("string"), _pick(F.col("turn") % 4, " (1/2)", "", " [ 2 / 2 ]", ""))
    rows = table(spark, sf_dir, "conversations").withColumn("style", F.when(F.col("role") == "user", "Heading 1").otherwise("Normal"))
    return rows.select("conv_id", "turn", "style", F.when(F.col("role") == "user", title).otherwise(F.col("text")).alias("text"))


@query(f"WITH {_HEADS} SELECT conv_id, turn, md5(c) AS text_md5 FROM m WHERE NOT gone UNION ALL SELECT conv_id, turn, md5(text) FROM conversations WHERE role <> 'user'")
def merge_adjacent_headings(spark, sf_dir):
    out = sequence.merge_repeated_headings(_headed(spark, sf_dir), sequence.heading_1(F.col("style")), doc="conv_id", pos="turn")
    return out.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_HEADS} SELECT conv_id, count(*) FILTER (gone) AS removed, 'Merge Report' || chr(10) || repeat('=', 20) || chr(10) || 'Total redundant headers removed: ' || count(*) FILTER (gone) || chr(10) || chr(10)
  || coalesce(string_agg('Merged: ''' || old || ''' -> into -> ''' || c || '''' || chr(10), '' ORDER BY turn) FILTER (gone), '') AS text FROM m GROUP BY conv_id""")
def merge_report(spark, sf_dir):
    return sequence.merge_report(_headed(spark, sf_dir), sequence.heading_1(F.col("style")), doc="conv_id", pos="turn").select("conv_id", "removed", "text")


@query("""WITH t AS (SELECT conv_id, turn, role = 'user' AS head, trim(text) AS t FROM conversations WHERE trim(text) <> ''),
e AS (SELECT *, head::INT + coalesce(lag((head OR right(t, 1) IN ('。', '！', '？', '…', '”', '.', '!', '?', '"'))::INT) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS starts FROM t),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM e)
SELECT conv_id, min(turn) AS turn, bool_or(head) AS is_heading, md5(string_agg(t, '' ORDER BY turn)) AS text_md5 FROM g GROUP BY conv_id, grp""")
def join_with_headings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("style", F.when(F.col("role") == "user", "Heading 2").otherwise("Normal"))
    out = sequence.join_until_terminator(rows, sequence.heading_prefix(F.col("style")), doc="conv_id", pos="turn")
    return out.select("conv_id", "turn", "is_heading", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey, string_split(upper(p_name || ' ' || p_type || ' ' || p_brand), ' ') AS w FROM part),
f AS (SELECT p_partkey, w, 1 AS i, w[1] AS out, length(w[1]) AS n FROM w
  UNION ALL SELECT p_partkey, w, i + 1, out || CASE WHEN n + 1 + length(w[i + 1]) <= 15 THEN ' ' ELSE chr(10) END || w[i + 1],
    CASE WHEN n + 1 + length(w[i + 1]) <= 15 THEN n + 1 ELSE 0 END + length(w[i + 1]) FROM f WHERE i < len(w))
SELECT p_partkey, out FROM f WHERE i = len(w)""")
def text_wrap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.wrap_words(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("out"))


# ---- runs


@query("""SELECT p_partkey, CASE WHEN r1 = '' THEN '' WHEN r2 = '' THEN trim(r1) ELSE ltrim(r1) END || '|' || CASE WHEN r2 = '' THEN '' WHEN r1 = '' THEN trim(r2) ELSE rtrim(r2) END AS runs
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_name || ' ' END AS r1, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE ' ' || p_type || ' ' END AS r2 FROM part)""")
def run_trim_ends(spark, sf_dir):
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    r = F.array(F.when(_key() % 3 == 0, "").otherwise(padded("p_name")), F.when(_key() % 3 == 1, "").otherwise(padded("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs.trim_ends(r), "|").alias("runs"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey::VARCHAR AS t, nullif(l_returnflag, 'N') AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
n AS (SELECT *, CASE WHEN i > 1 AND lag(s) OVER (PARTITION BY l_orderkey ORDER BY i) IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i) AS grp FROM n),
j AS (SELECT l_orderkey, grp, string_agg(t, '' ORDER BY i) || ':' || coalesce(any_value(s), '') AS x FROM g GROUP BY ALL)
SELECT l_orderkey, string_agg(x, '|' ORDER BY grp) AS runs FROM j GROUP BY l_orderkey""")
def run_length_styles(spark, sf_dir):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("r"))
    styled = F.transform("r", lambda x: F.struct(x["l_partkey"].cast("string").alias("text"), F.nullif(x["l_returnflag"], F.lit("N")).alias("style")))
    return orders.select("l_orderkey", F.array_join(F.transform(runs.merge_equal_styles(styled), lambda s: F.concat(s["text"], F.lit(":"), F.coalesce(s["style"], F.lit("")))), "|").alias("runs"))


@query("""SELECT p_partkey, CASE len(n) WHEN 0 THEN '|' WHEN 1 THEN n[1] || '|' ELSE n[1] || '|' || array_to_string(n[2:], '') END AS runs
FROM (SELECT p_partkey, [p_type, p_brand, p_name][:p_partkey % 4] AS n FROM part)""")
def run_write_back(spark, sf_dir):
    new = F.slice(F.array("p_type", "p_brand", "p_name"), F.lit(1), (_key() % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs.write_back(F.split("p_name", " "), new), "|").alias("runs"))


@query("""SELECT p_partkey, NULLIF(p_partkey % 2 = 0, FALSE) AS bold, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 10 END::DOUBLE AS size, p_type AS color FROM part""")
def copy_run_format(spark, sf_dir):
    none = lambda kind: F.lit(None).cast(kind)
    flags = [none("boolean").alias(f) for f in ("italic", "underline", "strike", "superscript", "subscript")]
    target = F.struct(F.lit(True).alias("bold"), *flags, F.col("p_brand").alias("name"), F.lit(10.0).alias("size"), F.col("p_type").alias("color"))
    source = F.struct(F.nullif(_key() % 2 == 0, F.lit(False)).alias("bold"), *flags, F.when(_key() % 3 == 0, F.col("p_type")).alias("name"), F.when(_key() % 5 == 0, F.col("p_size").cast("double")).alias("size"), none("string").alias("color"))
    return table(spark, sf_dir, "part").withColumn("c", runs.copy_format(target, source)).select("p_partkey", "c.bold", "c.name", "c.size", "c.color")


@query("""SELECT p_partkey, CASE WHEN i <= a THEN 0 WHEN i <= a + b THEN 1 WHEN i <= a + b + c THEN 2 END::BIGINT AS run, CASE WHEN i <= a THEN i WHEN i <= a + b THEN i - a WHEN i <= a + b + c THEN i - a - b END::BIGINT AS pos
FROM (SELECT p_partkey, p_partkey % 30 AS i, length(p_name) AS a, length(p_type) AS b, length(p_brand) AS c FROM part)""")
def locate_characters(spark, sf_dir):
    at = runs.locate(F.array("p_name", "p_type", "p_brand"), (_key() % 30).cast("int"))
    return table(spark, sf_dir, "part").withColumn("x", at).select("p_partkey", F.col("x.run").cast("long").alias("run"), F.col("x.offset").cast("long").alias("pos"))


@query("SELECT p_partkey, p_type || repeat('|', len(string_split(p_name, ' ')) - 1) AS runs FROM part")
def collapse_heading_runs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs.collapse_to_first(F.split("p_name", " "), F.col("p_type")), "|").alias("runs"))


# ---- names, markup, records


@query("""SELECT p_partkey, upper(left(t, 1)) || lower(t[2:]) AS label, CASE WHEN contains(n, '_') THEN replace(replace(n[instr(n, '_') + 1:], '.xhtml', ''), '_', ' ') END AS title
FROM (SELECT p_partkey, n, replace(replace(n, '.xhtml', ''), '_', ' ') AS t FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '_' || replace(upper(p_name), ' ', '_') || '.xhtml' WHEN 1 THEN 'chapter_' || p_partkey || '.xhtml' ELSE upper(p_type) || '.xhtml' END AS n FROM part))""")
def filename_to_label(spark, sf_dir):
    key = _key().cast("string")
    name = _pick(_key() % 3, F.concat(key, F.lit("_"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("_")), F.lit(".xhtml")), F.concat(F.lit("chapter_"), key, F.lit(".xhtml")), F.concat(F.upper("p_type"), F.lit(".xhtml")))
    return table(spark, sf_dir, "part").select("p_partkey", strings.filename_to_label(name).alias("label"), strings.filename_to_title(name).alias("title"))


@query("""SELECT p_partkey, contains(n, 'chapter') AS chapter, NOT contains(n, 'Cover.xhtml') AS not_cover, ends_with(n, '.docx') AND NOT starts_with(n, '~') AS document
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chapter_' || p_partkey || '.xhtml' WHEN 1 THEN 'Cover.xhtml' WHEN 2 THEN p_name || '.docx' ELSE '~$' || p_name || '.docx' END AS n FROM part)""")
def name_filters(spark, sf_dir):
    name = _pick(_key() % 4, F.concat(F.lit("chapter_"), _key().cast("string"), F.lit(".xhtml")), "Cover.xhtml", F.concat("p_name", F.lit(".docx")), F.concat(F.lit("~$"), "p_name", F.lit(".docx")))
    rows = table(spark, sf_dir, "part").withColumn("name", name)
    name = F.col("name")
    return rows.select("p_partkey", F.contains(name, F.lit("chapter")).alias("chapter"), (~F.contains(name, F.lit("Cover.xhtml"))).alias("not_cover"), (F.endswith(name, F.lit(".docx")) & ~F.startswith(name, F.lit("~"))).alias("document"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '<u>' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '<i>' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '<b>' ELSE '' END || p_name || '&lt;&amp;&gt;'
  || CASE WHEN p_partkey % 2 = 0 THEN '</b>' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '</i>' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '</u>' ELSE '' END AS run,
  '<a href="' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '#' END || '">' || p_name || '</a>' AS link,
  CASE p_partkey % 4 WHEN 0 THEN '<h1>' || p_name || '</h1>' WHEN 1 THEN '<h2>' || p_name || '</h2>' WHEN 2 THEN '<li>' || p_name || '</li>' ELSE '<p>' || p_name || '</p>' END AS block FROM part""")
def html_builders(spark, sf_dir):
    run = html.format_run(F.concat("p_name", F.lit("<&>")), _key() % 2 == 0, _key() % 3 == 0, F.when(_key() % 5 == 0, F.lit(True)))
    link = html.link(F.col("p_name"), F.when(_key() % 2 == 0, F.col("p_brand")))
    style = _pick(_key() % 4, "Heading 1", "heading 2", "List Bullet", "Normal")
    return table(spark, sf_dir, "part").select("p_partkey", run.alias("run"), link.alias("link"), html.block(style, F.col("p_name")).alias("block"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN n // 65536 END AS r, CASE WHEN p_partkey % 4 < 3 THEN n // 256 % 256 END AS g, CASE WHEN p_partkey % 4 < 3 THEN n % 256 END AS b
FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS n FROM part)""")
def font_colours(spark, sf_dir):
    h = F.lpad(F.hex(_key() * 7919 % 16777216), 6, "0")
    colour = _pick(_key() % 4, F.concat(F.lit("0x"), h), F.lower(h), F.concat(F.lit("RGBColor("), h, F.lit(")")), F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("x", strings.rgb(colour)).select("p_partkey", *(F.col(f"x.{k}").cast("long").alias(k) for k in "rgb"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%d-%m-%Y') AS day FROM orders")
def request_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", poll.request_date("o_orderdate").alias("day"))


@query("""SELECT o_orderkey::VARCHAR AS center, o_orderpriority AS address, (l_linenumber - 3)::BIGINT AS slots, l_quantity::BIGINT AS age, l_returnflag AS vaccine
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 3 AND l_quantity <= 30""")
def nested_json_alerts(spark, sf_dir):
    session = F.struct((F.col("l_linenumber") - 3).cast("int").alias("available_capacity"), F.col("l_quantity").cast("int").alias("min_age_limit"), F.col("l_returnflag").alias("vaccine"))
    sessions = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(session).alias("sessions"))
    orders = table(spark, sf_dir, "orders").join(sessions, F.col("o_orderkey") == F.col("l_orderkey"))
    center = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("address"), "sessions")
    snapshot = orders.select(F.to_json(F.struct(F.array(center).alias("centers"))).alias("j")).select(F.from_json("j", poll.CENTERS).alias("d")).select("d.*")
    return poll.alerts(snapshot, 30).select("center", "address", F.col("slots").cast("long").alias("slots"), F.col("age").cast("long").alias("age"), "vaccine")


# ---- glossaries

_LINES = """l AS (SELECT event_id AS line_no, CASE event_id % 6 WHEN 0 THEN '# ' || user_id || '=' || event_type WHEN 1 THEN ' ' WHEN 2 THEN 'no pair' WHEN 3 THEN ' = ' || event_type
  ELSE ' ' || user_id || ' = ' || event_type || ' = ' || event_id || ' ' END AS line FROM events)"""


def _glossary_lines(spark, sf_dir):
    user, kind, at = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id")
    pair = F.concat(F.lit(" "), user, F.lit(" = "), kind, F.lit(" = "), at.cast("string"), F.lit(" "))
    line = _pick(at % 6, F.concat(F.lit("# "), user, F.lit("="), kind), " ", "no pair", F.concat(F.lit(" = "), kind), pair, pair)
    return table(spark, sf_dir, "events").select(at.alias("line_no"), line.alias("line"))


@query(f"""WITH {_LINES}, p AS (SELECT line_no, trim(split_part(line, '=', 1)) AS k, trim(line[instr(line, '=') + 1:]) AS v FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, '='))
SELECT min(line_no) AS line_no, k, arg_min(v, line_no) AS v FROM p WHERE k <> '' GROUP BY k""")
def glossary_load_rules(spark, sf_dir):
    return glossary.first_wins(_glossary_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, p AS (SELECT line_no, split_part(trim(line), '=', 1) AS k, trim(line)[instr(trim(line), '=') + 1:] AS v FROM l WHERE contains(line, '='))
SELECT min(line_no) AS line_no, k, arg_max(v, line_no) AS v FROM p GROUP BY k""")
def glossary_load_last_wins(spark, sf_dir):
    return glossary.last_wins(_glossary_lines(spark, sf_dir))


@query(f"""WITH {EVENT_GLOSSARY_SQL}, w AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY file_ord, line_no) AS won FROM g),
c AS (SELECT k, file_ord, v FROM w WHERE v <> won UNION ALL SELECT DISTINCT k, (SELECT min(file_ord) FROM g), won FROM w WHERE v <> won)
SELECT k, 'Key: ' || k || chr(10) || string_agg('  -- ' || file_ord || ': ' || v, chr(10) ORDER BY file_ord, v) AS text FROM c GROUP BY k""")
def glossary_conflict_report(spark, sf_dir):
    return glossary.conflict_report(_event_glossary(spark, sf_dir))


@query("SELECT o_orderkey, 'part_' || part || '.docx' AS file FROM (SELECT o_orderkey, (floor((rn - 1) / ceil(n / 3.0)) + 1)::BIGINT AS part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))")
def part_files(spark, sf_dir):
    rows = sequence.deal_sections(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 3, "o_custkey", "o_orderkey")
    return rows.select("o_orderkey", strings.part_name(F.col("part")).alias("file"))


@query("SELECT p_partkey, replace(p_name, 'red', 'Red') AS text FROM part WHERE replace(p_name, 'red', 'Red') <> p_name")
def changed_rows(spark, sf_dir):
    new = F.replace("p_name", F.lit("red"), F.lit("Red"))
    return table(spark, sf_dir, "part").where(strings.changed(F.col("p_name"), new)).select("p_partkey", new.alias("text"))


@query("SELECT p_partkey, p_size + p_partkey + length(p_name) + length(p_brand) + length(p_type) + p_size // 2 AS total FROM part")
def row_sum(spark, sf_dir):
    six = [F.col("p_size"), _key(), F.length("p_name"), F.length("p_brand"), F.length("p_type"), F.floor(F.col("p_size") / 2)]
    return table(spark, sf_dir, "part").select("p_partkey", numbers.row_sum(*six).cast("long").alias("total"))


# ---- scans over pages, images and pairs of runs


@query(r"""SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '(?is)<(?:script)\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<code\b[^>]*>.*?</code\s*>|<pre\b[^>]*>.*?</pre\s*>|<!--.*?-->|<[^>]*>|[^<]+|<'),
  lambda x: CASE WHEN starts_with(x, '<') OR trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN x ELSE replace(x, 'e', 'E') END), '')) AS html_md5 FROM pages""")
def text_nodes(spark, sf_dir):
    out = html.rewrite_text_nodes(F.col("html"), lambda t: F.replace(t, F.lit("e"), F.lit("E")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(out.cast("binary")).alias("html_md5"))


@query("""SELECT vec_id, round(var_pop(v), 6) AS variance, var_pop(v) < 20 AS blurred FROM (
  SELECT vec_id, e[8 * abs(y - 1) + x + 1] + e[8 * (7 - abs(6 - y)) + x + 1] + e[8 * y + abs(x - 1) + 1] + e[8 * y + 8 - abs(6 - x)] - 4 * e[8 * y + x + 1] AS v
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)) GROUP BY vec_id""")
def image_blur(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("embedding", y * 8 + 1, F.lit(8)), lambda v: v.cast("double")))
    variance = images.laplacian_variance(rows)
    return table(spark, sf_dir, "embeddings").withColumn("_v", variance).select("vec_id", F.round("_v", 6).alias("variance"), images.is_blurred(F.col("_v"), 20.0).alias("blurred"))


@query("""WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN '.' WHEN 1 THEN ' "' WHEN 2 THEN ' ' WHEN 3 THEN ' ( ' WHEN 4 THEN '. ' ELSE '' END AS a,
  CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN ', ' WHEN 2 THEN ' )' WHEN 3 THEN '' ELSE ' ,' END || p_type AS b FROM part),
s AS (SELECT *, trim(a) AS sa, trim(b) AS sb, right(a, 1) IN ('"', '(') AS open, ['"', ')', '.', ',', '!', '?', ';', ':'] AS marks FROM p),
c AS (SELECT *, ends_with(a, ' ') AND (right(sa, 1) IN ('"', '(') OR list_contains(marks, left(b, 1))) AS cut_a FROM s)
SELECT p_partkey, CASE WHEN cut_a THEN rtrim(a) ELSE a END || '|' || CASE WHEN NOT cut_a AND starts_with(b, ' ') AND (open OR list_contains(marks, left(sb, 1))) THEN ltrim(b)
  WHEN ends_with(sa, '.') AND left(b, 1) BETWEEN 'A' AND 'Z' AND NOT ends_with(a, ' ') THEN ' ' || b ELSE b END AS runs FROM c""")
def run_stitch(spark, sf_dir):
    a = F.concat(F.col("p_name"), _pick(_key() % 6, ".", ' "', " ", " ( ", ". ", ""))
    b = F.concat(_pick(_key() % 5, " ", ", ", " )", "", " ,"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs.stitch(F.array(a, b)), "|").alias("runs"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '>\s+<', '><', 'g'), '\s{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS small_md5,
  md5(replace(replace(replace(html, '<h1>', '<body>' || chr(10) || '    <h1>'), '<title>', '<title>L: '), '<body>' || chr(10) || '    <h1>', '<body><h1>L: ')) AS named_md5 FROM pages""")
def page_edits(spark, sf_dir):
    page = F.col("html")
    laid_out = F.replace(page, F.lit("<h1>"), F.lit("<body>\n    <h1>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.minify(page).cast("binary")).alias("small_md5"), F.md5(html.inject(laid_out, F.lit("L")).cast("binary")).alias("named_md5"))


#: These two are examples of operators that queries over tables run already.
for _name in ("glossary_golden", "reflow_golden"):
    QUERIES.pop(_name), ORACLE_SQL.pop(_name)
