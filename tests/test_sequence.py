import math
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import numbers, strings
from textloom.operators import sequence
from textloom.operators.glossary_replace import glossary_hits, glossary_replace, token_pattern
from textloom.sources.lines import to_lines, to_text

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def lines(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos long, line string")


def kept(spark, texts, **options):
    return [r.line for r in sequence.drop_alternate_repeats(lines(spark, texts), **options).orderBy("pos").collect()]


def test_alternate_repeats(spark):
    assert kept(spark, ["a", "a.", "a!", "b"]) == ["a", "a!", "b"]
    assert kept(spark, ["x"] * 4) == ["x", "x"]
    assert kept(spark, ["", "  ", "...", "b"]) == ["", "...", "b"]
    assert kept(spark, ["a", "a", "a"], mode="fixed") == ["a"]
    assert kept(spark, []) == []


@few
@given(st.lists(st.sampled_from(["a", "a.", "b", ""]), max_size=20))
def test_alternate_repeats_keep_half_of_each_run(spark, texts):
    keys = [t.rstrip(".") for t in texts]
    runs = []
    for k in keys:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    assert len(kept(spark, texts)) == sum(math.ceil(n / 2) for _, n in runs)


def model_reflow(texts, sentences):
    out, buffer, count = [], 0, 0
    for t in texts:
        s = t.strip()
        if not s:
            continue
        if s[0] + s[-1] in ("()", "[]") and len(s) > 1:
            out += [buffer] * (buffer > 0) + [1]
            buffer = count = 0
            continue
        buffer += 1
        count += len(re.findall(r"[.!?]", t))
        if count >= sentences or s[-1] in "\"”'":
            out.append(buffer)
            buffer = count = 0
    return out + [buffer] * (buffer > 0)


def test_reflow_equals_a_plain_scan(spark):
    rng = random.Random(3)
    for _ in range(4):
        texts = [rng.choice(["a.", "b", "c! d?", "(n)", 'q"', "", "e..."]) for _ in range(40)]
        rows = lines(spark, texts)
        got = sequence.reflow_groups(rows, 3, text="line").groupBy("group").count().orderBy("group").collect()
        assert [r["count"] for r in got] == model_reflow(texts, 3)


def test_reflow_keeps_the_text(spark):
    texts = ["One.", " two", ", three.", "-", "x"]
    out = sequence.reflow(lines(spark, texts), 4, text="line").orderBy("group").collect()
    assert re.sub(r"\s", "", "".join(r.text for r in out)) == re.sub(r"\s", "", "".join(texts))


def test_deal_sections(spark):
    def sizes(n, files):
        rows = spark.createDataFrame([(1, i) for i in range(n)], "doc_id long, section long")
        return [r["count"] for r in sequence.deal_sections(rows, files).groupBy("part").count().orderBy("part").collect()]

    assert sizes(7, 4) == [2, 2, 2, 1]
    assert sizes(9, 4) == [3, 3, 3]
    assert sizes(3, None) == [1, 1, 1]
    assert sizes(2, 5) == [1, 1]


def test_rows_before_the_first_heading_go(spark):
    rows = lines(spark, ["front", "H", "a", "H", "b"])
    got = sequence.sections(rows, F.col("line") == "H").orderBy("pos").collect()
    assert [(r.line, r.section) for r in got] == [("H", 1), ("a", 1), ("H", 2), ("b", 2)]
    titled = sequence.titled_sections(rows, F.col("line") == "H", "line").orderBy("pos").collect()
    assert [(r.line, r.title) for r in titled] == [("front", "Front Matter"), ("a", "H"), ("b", "H")]


def test_lines_round_trip(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    rows = to_lines(docs)
    assert sorted((r.doc_id, r.pos, r.line) for r in rows.collect()) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "x"), (3, 0, "")]
    assert {r.doc_id: r.text for r in to_text(rows).collect()} == {1: "a\n\nb\n", 2: "x\n", 3: "\n"}


@few
@given(st.lists(st.text("abc.", min_size=1, max_size=3), min_size=1, max_size=4, unique=True), st.text("abc. ", max_size=25))
def test_glossary_equals_regular_expression(spark, keys, text):
    glossary = {k: k.upper() + "!" for k in keys}
    pattern = re.compile("|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True)))
    want = pattern.subn(lambda m: f" {glossary[m[0]]} ", text)
    row = spark.range(1).select(glossary_replace(F.lit(text), glossary).alias("t"), glossary_hits(F.lit(text), glossary).alias("n")).first()
    assert (row.t, row.n) == want


def test_glossary_needs_keys():
    for keys in ([], [""]):
        try:
            token_pattern(keys)
        except ValueError:
            continue
        raise AssertionError


def test_modes_and_names(spark):
    row = spark.range(1).select(
        strings.output_name(F.lit("/a/b.txt"), "edited").alias("edited"),
        strings.output_name(F.lit("b.txt"), "modified").alias("modified"),
        strings.output_name(F.lit("/a/b.docx"), "fixed").alias("fixed"),
        strings.output_name(F.lit("b.docx"), "cleaned").alias("cleaned"),
        strings.last_number(F.lit("p1v22.docx")).alias("number"),
        strings.last_number(F.lit("none")).alias("none"),
        numbers.clean_chapter_title(F.lit("C1 （1/2) ")).alias("title"),
        strings.is_bracketed(F.lit("(note]")).alias("mixed"),
    ).first()
    assert (row.edited, row.modified, row.fixed, row.cleaned) == ("/a/b_edited.txt", "b_modified.txt", "/a/Fixed_b.docx", "cleaned_b.docx")
    assert (row.number, row.none, row.title, row.mixed) == (22, None, "C1", False)
