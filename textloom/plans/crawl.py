"""Paged books: extraction rules by site, the next-page edge, and the walk along the pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.html import without_links
from textloom.functions.strings import next_numbered_url, strip
from textloom.sources.shared import drop_path, shared_path

#: Fixed values, one site a row: title (tag, attribute, value, what of it, class of the div it lies in), container
#: (tag, attribute, value), next link (attribute, value, class of the div it lies in), label it must hold, how its
#: address is read, what it must and must not hold.
SITES = [
    ("readnovelfull", "a", "class", "chr-title", "title", "", "div", "id", "chr-content", "id", "next_chap", "", "", "root", "", ""),
    ("royalroad", "title", "", "", "text", "", "div", "class", "chapter-inner chapter-content", "class", "btn btn-primary col-xs-12", "", "Next", "root", "", ""),
    ("scribblehub", "title", "", "", "text", "", "div", "class", "chp_raw", "class", "btn-wi btn-next", "", "Next", "absolute", "", ""),
    ("boxnovel", "title", "", "", "text", "", "div", "class", "entry-content", "class", "btn next_page", "", "Next", "absolute", "", ""),
    ("readwebnovels", "title", "", "", "text", "", "div", "class", "reading-content", "class", "btn next_page", "", "Next", "absolute", "", ""),
    ("instadoses", "h1", "id", "chapter-heading", "text", "", "div", "class", "reading-content", "class", "btn next_page", "", "Next", "absolute", "", ""),
    ("novelfun", "h1", "class", "css-1ch487y", "text", "", "div", "class", "fontSize-2 css-p8fe3q-Content e1ktwp231", "class", "css-122d1rp", "", "Next", "root", "", ""),
    ("ranobes", "title", "", "", "text", "", "div", "id", "arrticle", "id", "next", "", "", "absolute", "", "./"),
    ("tracan", "title", "", "", "text", "", "div", "class", "entry-content", "", "", "entry-content", "Next", "absolute", "", ""),
    ("shuhaige", "title", "", "", "text", "", "div", "id", "content", "id", "pager_next", "", "", "root", "", "shu_"),
    ("tomatomtl", "h1", "class", "chapter_title", "text", "", "article", "id", "chapter_content", "id", "next-chap2", "", "", "root", "", "undefined"),
    ("biquge", "h1", "", "", "text", "book", "div", "id", "chaptercontent", "id", "next_url", "", "", "slashes", "", ""),
    ("xszj", "h1", "class", "bookname", "text", "", "div", "id", "booktxt", "rel", "next", "", "", "root", "/b/", ""),
    ("dxs", "h1", "class", "chaptername", "text", "", "div", "id", "txt", "class", "url_next", "", "", "absolute", ".html", ""),
    ("tongrenquan", "h1", "", "", "text", "", "div", "class", "read_chapterDetail", "", "", "", "next", "number", "", ""),
    ("novel543", "title", "", "", "text", "", "div", "class", "content py-5", "", "", "warp my-5 foot-nav", "next", "root", "", ""),
    ("bixiange", "h1", "", "", "text", "", "div", "class", "content", "", "", "mPage", "next", "number", "", ""),
    ("quanben", "h1", "class", "headline", "text", "", "div", "class", "articlebody", "rel", "next", "", "", "root", "/n/", ""),
    ("69shubatw", "h1", "class", "nr_title", "text", "", "div", "id", "nr1", "id", "pb_next", "", "", "root", "read", ""),
]
FIELDS = ["site", "title_tag", "title_attr", "title_value", "title_take", "title_scope", "container_tag", "container_attr", "container_value", "next_attr", "next_value", "next_scope", "next_label", "url_mode", "must_contain", "must_not_contain"]

#: Link labels in other scripts that say the same as "next".
NEXT_LABELS = {"下一章": "next", "下一页": "next", "下一頁": "next", "下一章节": "next"}


def site_rules(spark: SparkSession) -> DataFrame:
    """The rule table; 19 rows, whatever the data."""
    return spark.createDataFrame(SITES, ", ".join(f"{f} string" for f in FIELDS))


class _Finder(HTMLParser):
    """Attributes, inner and outer HTML of the elements that fit (tag, attribute, value)."""

    def __init__(self, tag: str, attr: str, value: str):
        super().__init__(convert_charrefs=False)
        self.want, self.attr, self.value = tag, attr, value
        self.depth, self.outer, self.inner, self.found, self.attrs = 0, 0, 0, [], {}
        self.lines: list[int] = [0]

    def run(self, html: str) -> list[tuple[dict, str, str]]:
        at = 0
        while (at := html.find("\n", at)) >= 0:
            at += 1
            self.lines.append(at)
        self.html = html
        self.feed(html)
        return self.found

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag != self.want:
            return
        if self.depth:
            self.depth += 1
        elif not self.attr or dict(attrs).get(self.attr) == self.value:
            self.depth, self.attrs, self.outer = 1, dict(attrs), self._place()
            self.inner = self.outer + len(self.get_starttag_text())

    def handle_endtag(self, tag):
        if self.depth and tag == self.want:
            self.depth -= 1
            if not self.depth:
                at = self._place()
                end = self.html.find(">", at) + 1 or len(self.html)
                self.found.append((self.attrs, self.html[self.inner : at], self.html[self.outer : end]))


def _all(html: str | None, tag: str | None, attr: str | None, value: str | None) -> list[tuple[dict, str, str]]:
    try:
        return _Finder(tag, attr or "", value or "").run(html) if html and tag else []
    except Exception:  # a page that can't be parsed has no such element
        return []


@F.pandas_udf(T.StringType())
def first_element(html: pd.Series, tag: pd.Series, attr: pd.Series, value: pd.Series, take: pd.Series) -> pd.Series:
    """Of the first element whose attribute equals the value as a whole: its outer HTML, inner text, or the attribute named; null without one."""

    def one(h, t, a, v, what):
        found = _all(h, t, a, v)
        if not found:
            return None
        return {"outer": found[0][2], "text": found[0][1]}.get(what, found[0][0].get(what))

    return pd.Series([one(*row) for row in zip(html, tag, attr, value, take, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])))
def links_of(html: pd.Series, attr: pd.Series, value: pd.Series) -> pd.Series:
    """Address and inner HTML of every fitting link that has an address, in order; without a rel="next" link, the second rel="prev" one."""

    def one(h, a, v):
        found = _all(h, "a", a, v)
        if a == "rel" and v == "next" and not found:
            found = _all(h, "a", "rel", "prev")[1:2]
        return [{"href": x["href"], "label": inner} for x, inner, _ in found if x.get("href")]

    return pd.Series([one(*row) for row in zip(html, attr, value, strict=True)], dtype=object)


def _plain(html: Column) -> Column:
    return strip(F.regexp_replace(html, r"(?s)<[^>]*>", ""))


def extract(pages: DataFrame, html: str = "html", url: str = "url", site: str = "site", root: str = "root") -> DataFrame:
    """pages with title, content and next_url by their site's rules; all null for a site without rules.

    content is the container without links, below the title as h1. next_url is the first
    fitting link's address, after the root where the site's addresses are relative; two sites
    fall back on the page's number plus one and never point at themselves. The rules are 19
    rows and go to every task; pages stay where they are.
    """
    ruled = pages.join(F.broadcast(site_rules(pages.sparkSession)), site, "left")

    def scope(name: str) -> Column:
        return F.when(F.col(name) != "", first_element(F.col(html), F.lit("div"), F.lit("class"), F.col(name), F.lit("text"))).otherwise(F.col(html))

    found = ruled.withColumn("_title", _plain(first_element(scope("title_scope"), "title_tag", "title_attr", "title_value", "title_take")))
    found = found.withColumn("_page", _plain(first_element(F.col(html), F.lit("title"), F.lit(""), F.lit(""), F.lit("text"))))
    found = found.withColumn("_outer", first_element(html, "container_tag", "container_attr", "container_value", F.lit("outer"))).withColumn("_links", links_of(scope("next_scope"), "next_attr", "next_value"))
    known = F.col("container_tag").isNotNull()
    found = found.withColumn("title", F.when(known, F.coalesce(F.nullif("_title", F.lit("")), F.nullif("_page", F.lit("")))))
    body = without_links(F.col("_outer"))
    body = F.when(F.col(site) == "tracan", F.substring_index(body, "Partager", 1)).otherwise(body)
    found = found.withColumn("content", F.when(known & F.col("_outer").isNotNull(), F.concat(F.lit("<h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), body)))
    translated = F.create_map(*(F.lit(x) for kv in NEXT_LABELS.items() for x in kv))

    def fits(link: Column) -> Column:
        label = _plain(link["label"])
        foreign = F.lower(F.coalesce(F.try_element_at(translated, label), label))
        named = F.contains(F.when(F.col("next_label") == "next", foreign).otherwise(label), F.col("next_label"))
        right = F.contains(link["href"], F.col("must_contain")) & ((F.col("must_not_contain") == "") | ~F.contains(link["href"], F.col("must_not_contain")))
        return named & right & ((F.col("url_mode") != "slashes") | (F.regexp_count(link["href"], F.lit("/")) == 3))

    href = F.get(F.filter("_links", fits), F.lit(0))["href"]
    address = F.when(F.col("url_mode") == "absolute", href).otherwise(F.concat(F.col(root), href))
    numbered = F.coalesce(address, next_numbered_url(F.col(url)))
    found = found.withColumn("next_url", F.when(F.col("url_mode") != "number", address).when(known & (numbered != F.col(url)), numbered))
    return found.drop(*FIELDS[1:], "_title", "_page", "_outer", "_links")


def walk(edges: DataFrame, starts: DataFrame, max_steps: int | None = None, src: str = "src", dst: str = "dst", start: str = "start") -> DataFrame:
    """start, step, node: each start's chain of pages in order, to its end or for max_steps if given.

    Pointer doubling: round k knows 2^k steps of every chain, so a chain of n pages takes
    log2(n) joins. Each round is a table in the shared folder, and every join can be dealt to
    any number of machines. A page has one next page (the smallest, if the input has more); a
    cycle is followed up to the first page met again.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "walk")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    jump, jump_path = put(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src")).agg(F.min(dst).alias("dst")))
    seen, seen_path = put(starts.select(F.col(start).alias("start"), F.lit(0).cast("long").alias("step"), F.col(start).alias("node")).where("node IS NOT NULL").distinct())
    length, last = 1, 0
    while max_steps is None or length <= max_steps:
        further = seen.join(jump, seen["node"] == jump["src"]).select("start", (F.col("step") + length).alias("step"), F.col("dst").alias("node"))
        both = seen.unionByName(further if max_steps is None else further.where(F.col("step") <= max_steps))
        grown, grown_path = put(both.groupBy("start", "node").agg(F.min("step").alias("step")).select("start", "step", "node"))
        drop_path(spark, seen_path)
        seen, seen_path = grown, grown_path
        if (n := seen.count()) == last:
            break
        last, length = n, length * 2
        other = jump.select(F.col("src").alias("_mid"), F.col("dst").alias("_far"))
        longer, longer_path = put(jump.join(other, jump["dst"] == other["_mid"]).select("src", F.col("_far").alias("dst")))
        drop_path(spark, jump_path)
        jump, jump_path = longer, longer_path
    drop_path(spark, jump_path)
    return seen


def walk_recursive(edges: DataFrame, starts: DataFrame, max_steps: int = 20) -> DataFrame:
    """walk by a recursive query, for short chains."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_walk_edges")
    starts.createOrReplaceTempView("_walk_starts")
    return spark.sql(f"""
        WITH RECURSIVE w(start, step, node) MAX RECURSION LEVEL {max_steps + 2} AS (
          SELECT start, 0L, start FROM _walk_starts
          UNION ALL
          SELECT w.start, w.step + 1, e.dst FROM w JOIN _walk_edges e ON w.node = e.src WHERE w.step < {max_steps})
        SELECT start, step, node FROM w""")
