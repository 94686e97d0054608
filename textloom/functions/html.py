"""HTML as text: tag stripping, text-node rewriting, first-heading replacement, and small markup builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import html_escape, strip

#: Tags whose text is code or style, not prose.
CODE_TAGS = "script|style|code|pre"


def strip_html(c: Column) -> Column:
    """Text without script and style blocks and tags, white space collapsed; entities stay as they are."""
    text = F.coalesce(c, F.lit(""))
    for pattern, to in ((r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?s)<[^>]*>", ""), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def without_links(c: Column) -> Column:
    """Without a elements and their content."""
    return F.regexp_replace(c, r"(?is)<a\b[^>]*>.*?</a>", "")


def first_h1(c: Column) -> Column:
    """Text of the first h1, null without one."""
    return F.when(F.rlike(c, F.lit(r"(?is)<h1\b[^>]*>.*?</h1>")), strip(F.regexp_replace(F.regexp_extract(c, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", "")))


def replace_first_h1(html: Column, title: Column) -> Column:
    """The first h1's content replaced; unchanged without an h1."""
    parts = r"(?is)^(.*?<h1\b[^>]*>)(.*?)(</h1>.*)$"
    return F.when(F.rlike(html, F.lit(parts)), F.concat(F.regexp_extract(html, parts, 1), title, F.regexp_extract(html, parts, 3))).otherwise(html)


def hrefs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?is)<a\b[^>]*?\bhref=\"([^\"]*)\""), 1)


def inject(html: Column, label: Column) -> Column:
    """label before the title's and the first heading's text, where the tags stand literally."""
    titled = F.replace(html, F.lit("<title>"), F.concat(F.lit("<title>"), label, F.lit(": ")))
    return F.replace(titled, F.lit("<body>\n    <h1>"), F.concat(F.lit("<body><h1>"), label, F.lit(": ")))


def inject_heading(html: Column, title: Column) -> Column:
    """A first heading at the body's start, where the tag stands literally."""
    return F.replace(html, F.lit("<body>"), F.concat(F.lit("<body><h1>"), title, F.lit("</h1>")))


def drop_trailer(html: Column) -> Column:
    """Without the dashed trailer before the body's end."""
    return F.regexp_replace(html, r"(?s)(<p>-----).*?(----</p></body>)", "</body>")


def minify(html: Column) -> Column:
    """Comments and blanks between tags removed, runs of blanks made one."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)>\s+<", "><"), r"(?U)\s{2,}", " "))


def format_run(text: Column, bold: Column, italic: Column, underline: Column) -> Column:
    """Escaped text in b, then i, then u outermost; null flags count as off; empty text stays empty."""
    out = html_escape(text)
    for flag, tag in ((bold, "b"), (italic, "i"), (underline, "u")):
        out = F.when(F.coalesce(flag, F.lit(False)) & (out != ""), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return out


def link(text: Column, url: Column) -> Column:
    """An a element unless its text is empty; a missing address is #."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit('<a href="'), F.coalesce(url, F.lit("#")), F.lit('">'), text, F.lit("</a>"))).otherwise(F.lit(""))


#: How an image stands in a chapter, before and after its name.
IMAGE_START = '<img src="images/'
IMAGE_END = '" alt="image" style="max-width:100%; height:auto;" />'


def spans(c: Column) -> Column:
    """HTML of spans {href, runs}: runs formatted, an image in place of its run's text, links around their runs."""
    run = lambda r: F.when(r["image"].isNotNull(), F.concat(F.lit(IMAGE_START), r["image"], F.lit(IMAGE_END))).otherwise(format_run(r["text"], r["bold"], r["italic"], r["underline"]))
    inner = F.transform(c, lambda s: F.struct(s["href"].alias("href"), F.array_join(F.transform(s["runs"], run), "").alias("html")))
    return F.array_join(F.transform(inner, lambda s: F.when(s["href"].isNull(), s["html"]).otherwise(link(s["html"], s["href"]))), "")


def block(style: Column, html: Column, has_images: Column | None = None) -> Column:
    """h1, h2, li or p by the paragraph's style; blank content gives the empty text unless the chapter has had an image."""
    low = F.lower(F.coalesce(style, F.lit("")))
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), html, F.lit(f"</{tag}>"))
    blank = strip(html) == ""
    if has_images is not None:
        blank = blank & ~has_images
    return F.when(blank, F.lit("")).when(F.contains(low, F.lit("heading 1")), wrap("h1")).when(F.contains(low, F.lit("heading 2")), wrap("h2")).when(F.contains(low, F.lit("list")), wrap("li")).otherwise(wrap("p"))


#: How a table and its cells are opened.
TABLE_TAG = '<table border="1" style="border-collapse: collapse; width: 100%; margin: 10px 0;">'
CELL_TAG = "<td style='padding:5px; border:1px solid #ccc;'>"


def table(rows: Column, cell: Callable[[Column], Column] = html_escape) -> Column:
    """Rows of cells (array<array<...>>) as a table element; cell makes a cell's HTML."""
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(CELL_TAG), cell(x), F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit(TABLE_TAG), F.array_join(cells, ""), F.lit("</table>"))


def rewrite_text_nodes(html: Column, rewrite: Callable[[Column], Column], skip_code: bool = True) -> Column:
    """rewrite applied to every non-blank text between tags; comments and tags stay, code blocks too if asked."""
    opaque = rf"<({CODE_TAGS})\b[^>]*>.*?</\1\s*>|" if skip_code else ""
    tokens = F.regexp_extract_all(html, F.lit(rf"(?is){opaque}<!--.*?-->|<[^>]*>|[^<]+|<"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("<")) | (strip(t) == ""), t).otherwise(rewrite(t))), "")


def fragments(c: Column) -> Column:
    """Pieces of text: sentence marks, bracketed and quoted parts each by themselves, trimmed, none empty."""
    mark = r"[.!?]+|\(.*?\)|\".*?\"|'.*?'"
    tokens = F.regexp_extract_all(c, F.lit(rf"{mark}|(?s:(?:(?!{mark}).)+)"), 0)
    return F.filter(F.transform(tokens, strip), lambda t: t != "")
