"""Scalar string expressions. Patterns use (?U), so white space, word and digit classes are Unicode ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may trail a line without making it a different line.
LINE_END_PUNCTUATION = ".,!?;:\"'。，！？；：“”‘’"
#: A paragraph that ends with one of these is complete.
TERMINATORS = "。！？…”.!?\""
#: A line that ends with one of these closes a dialogue.
CLOSING_QUOTES = "\"”'"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda would compute an expression it mentions for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim drops only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def line_key(c: Column) -> Column:
    """What two adjacent lines are compared by: trimmed, without trailing punctuation."""
    return F.regexp_replace(strip(c), f"[{LINE_END_PUNCTUATION}]+$", "")


def last_char(c: Column) -> Column:
    return F.substring(c, -1, 1)


def ends_with_any(c: Column, characters: str) -> Column:
    return last_char(c).isin(*characters)


def is_bracketed(c: Column) -> Column:
    """() [] （） 【】 of the same kind at both ends of the trimmed text."""
    t = strip(c)
    return (t.startswith("(") & t.endswith(")")) | (t.startswith("[") & t.endswith("]")) | (t.startswith("（") & t.endswith("）")) | (t.startswith("【") & t.endswith("】"))


def ellipsis_cleanup(c: Column) -> Column:
    """Runs of dots and … become ..., runs of commas one comma, line feeds a space."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"\.{2,}|…+", "..."), ",{2,}", ",")


def sentence_ends(c: Column) -> Column:
    """Sentence ends in the text; dots of six titles don't count, every dot of an ellipsis does."""
    titles = "".join(rf"(?<!\b{t})" for t in ("Mt", "Mr", "Mrs", "Ms", "Dr", "Prof"))
    return F.regexp_count(c, F.lit(rf"(?U){titles}[.!?][\"']?"))


def smart_join(previous: Column, following: Column) -> Column:
    """previous + following with a space between them unless one side makes it needless."""
    after = lstrip(following)
    gap = (previous != "") & ~F.substring(previous, -1, 1).isin(" ", "-", "—") & (after != "") & ~F.substring(after, 1, 1).isin(",", ".", "!", "?", ":", ";")
    return F.concat(previous, F.when(gap, F.lit(" ")).otherwise(F.lit("")), following)


def html_escape(c: Column) -> Column:
    """& < > only; null becomes the empty text."""
    text = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def filename_to_label(name: Column) -> Column:
    """chapter_12.xhtml to Chapter 12: first letter upper, all others lower."""
    text = F.replace(F.replace(name, F.lit(".xhtml"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def filename_to_title(name: Column) -> Column:
    """What follows the first _ without the suffix, _ as spaces; null without a _."""
    return F.replace(F.replace(F.get(F.split(name, "_", 2), F.lit(1)), F.lit(".xhtml"), F.lit("")), F.lit("_"), F.lit(" "))


def nav_label(number: Column, text: Column) -> Column:
    return F.concat(F.lit("Chapter "), number.cast("string"), F.lit(" - "), text)


def ncx_label(number: Column, text: Column) -> Column:
    return F.concat(F.lit("Chapter "), number.cast("string"), F.lit(": "), text)


def output_name(path: Column, rule: str) -> Column:
    """The four naming rules: edited, modified, fixed, cleaned."""
    if rule == "edited":
        return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", "$1_edited$2")
    if rule == "modified":
        return F.replace(path, F.lit(".txt"), F.lit("_modified.txt"))
    if rule == "fixed":
        return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), F.lit("Fixed_"), F.regexp_extract(path, r"([^/]*)$", 1))
    if rule == "cleaned":
        return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), F.lit("cleaned_"), F.regexp_extract(path, r"([^/]*)$", 1))
    raise ValueError(f"unknown naming rule {rule!r}")


def part_name(part: Column) -> Column:
    """part_1.docx, part_2.docx, ...: the files of a document split into parts."""
    return F.concat(F.lit("part_"), part.cast("string"), F.lit(".docx"))


def chapter_name(number: Column) -> Column:
    """chap_0.xhtml, chap_1.xhtml, ...: the pages of a built book."""
    return F.concat(F.lit("chap_"), number.cast("string"), F.lit(".xhtml"))


def book_name(title: Column) -> Column:
    """The title with .epub; a slash, which would name a folder, becomes a blank."""
    return F.concat(F.replace(title, F.lit("/"), F.lit(" ")), F.lit(".epub"))


def changed(old: Column, new: Column) -> Column:
    """Whether a row is to be written again: a null is equal to a null."""
    return ~old.eqNullSafe(new)


def last_number(name: Column) -> Column:
    """The last run of digits as a number, null without one."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)), -1).cast("decimal(38,0)").cast("bigint")


def chunk_words(c: Column, n: int = 4) -> Column:
    """The words in lines of n, each line ended by a line feed."""

    def chunks(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.array_join(F.slice(w, i, n), " "), F.lit("\n")))

    return let(F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != ""), chunks)


def wrap_words(c: Column, width: int = 15) -> Column:
    """Greedy lines of at most width characters, upper case; a longer word is cut to fill the line; hyphens are no breaks."""
    parts = F.filter(F.split(strip(F.upper(c)), r"(?U)\s+"), lambda x: x != "")

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        head = F.slice(lines, 1, F.size(lines) - 1)
        room = width - F.length(last) - 1
        fits = F.concat(head, F.array(F.concat_ws(" ", F.when(last != "", last), word)))
        start = F.when(last == "", head).otherwise(lines)
        cut = F.when((last != "") & (F.length(word) > width) & (room > 0), room).otherwise(F.lit(0))
        first = F.when(cut > 0, F.concat(head, F.array(F.concat(last, F.lit(" "), F.substring(word, F.lit(1), cut))))).otherwise(start)
        rest = F.substring(word, cut + 1, F.length(word))
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(rest) - 1) / width).cast("int"))), lambda k: F.substring(rest, k * width + 1, F.lit(width)))
        return F.when(F.length(last) + F.length(word) + F.when(last != "", 1).otherwise(0) <= width, fits).otherwise(F.concat(first, pieces))

    lines = F.aggregate(parts, F.array(F.lit("")), add)
    return F.array_join(lines, "\n")


def url_root(url: Column) -> Column:
    """Everything before the last /."""
    return F.regexp_extract(url, r"^(.*)/[^/]*$", 1)


def next_numbered_url(url: Column) -> Column:
    """root/12.html to root/13.html; null where the last part is no number."""
    number = F.regexp_extract(url, r"/(\d+)[^/]*$", 1)
    return F.when(number != "", F.concat(url_root(url), F.lit("/"), (F.try_to_number(number, F.lit("9" * 18)).cast("bigint") + 1).cast("string"), F.lit(".html")))


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def rgb(c: Column) -> Column:
    """RGBColor(…), 0x or six hex digits to a struct r, g, b; null for anything else."""
    h = F.regexp_extract(c, r"(?i)(?:0x|^|[^0-9a-f])([0-9a-f]{6})\)?$", 1)
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
