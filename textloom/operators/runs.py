"""Operators over the runs of a paragraph: arrays of structs whose neighbours influence each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import let, lstrip, rstrip, strip

#: Marks that take no space before them.
CLOSING = ".,!?;:"


def _with_last(acc: Column, run: Column) -> Column:
    return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(run))


def stitch(texts: Column) -> Column:
    """Spacing errors across run boundaries repaired, pair by pair from the left; a pair with a blank side is left alone.

    texts: array<string>. At most one of four blank-removing rules applies to a pair, then a
    space is put before a capital that follows a full stop directly.
    """

    def step(acc: Column, b: Column) -> Column:
        a = F.element_at(acc, -1)
        sa, sb = strip(a), strip(b)
        opens = F.substring(sa, -1, 1).isin('"', "(")
        closes = lambda t: F.substring(t, 1, 1).isin('"', ")", *CLOSING)
        cut_a = (opens & F.endswith(a, F.lit(" "))) | (~(opens & F.endswith(a, F.lit(" "))) & ~(F.substring(a, -1, 1).isin('"', "(") & F.startswith(b, F.lit(" "))) & F.endswith(a, F.lit(" ")) & closes(b))
        cut_b = ~cut_a & F.startswith(b, F.lit(" ")) & (F.substring(a, -1, 1).isin('"', "(") | closes(sb))
        first = F.substring(b, 1, 1)
        capital = (F.upper(first) == first) & (F.lower(first) != first)
        lead = F.endswith(sa, F.lit(".")) & capital & ~F.endswith(a, F.lit(" "))
        new_a = F.when(cut_a, rstrip(a)).otherwise(a)
        new_b = F.when(cut_b, lstrip(b)).when(lead, F.concat(F.lit(" "), b)).otherwise(b)
        skip = (sa == "") | (sb == "")
        return F.when(skip, F.concat(acc, F.array(b))).otherwise(F.concat(_with_last(acc, new_a), F.array(new_b)))

    return F.when(F.size(texts) < 2, texts).otherwise(F.aggregate(F.slice(texts, 2, F.size(texts) - 1), F.slice(texts, 1, 1), step))


def trim_ends(texts: Column) -> Column:
    """The first non-empty run loses leading white space if it starts with a space; the last one likewise at its end."""
    some = F.filter(F.transform(texts, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
    first, last = F.get(some, F.lit(0)), F.element_at(F.concat(F.array(F.lit(None).cast("int")), some), -1)
    led = F.transform(texts, lambda t, i: F.when((i == first) & F.startswith(t, F.lit(" ")), lstrip(t)).otherwise(t))
    return F.transform(led, lambda t, i: F.when((i == last) & F.endswith(t, F.lit(" ")), rstrip(t)).otherwise(t))


def merge_equal_styles(runs: Column) -> Column:
    """Adjacent runs {text, style} of null-safe equal style made one."""

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit(None)), acc), -1)
        same = (F.size(acc) > 0) & last["style"].eqNullSafe(r["style"])
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(last["text"], r["text"]).alias("text"), r["style"].alias("style"))))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(runs, 1, 1), step)


def locate(texts: Column, index: Column) -> Column:
    """Struct (run, offset) of a character index; a boundary belongs to the earlier run. Null beyond the end."""
    ends = F.aggregate(texts, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t))))
    run = F.get(F.filter(F.transform(F.slice(ends, 2, F.size(texts)), lambda e, i: F.when(index <= e, i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(run.isNotNull(), F.struct(run.alias("run"), (index - F.get(ends, run)).alias("offset")))


def number_heading_runs(texts: Column) -> Column:
    """The colon of a numbered heading put into its runs.

    A full stop directly after the number becomes a colon if it lies in the run where the
    number ends; as the first character of the next run it stays, because a boundary belongs
    to the earlier run.
    """
    full = F.array_join(texts, "")
    head = F.regexp_extract(full, r"(?U)^\s*(\d++(?:\.\d++)*+)", 0)
    after = F.substring(full, F.length(head) + 1, F.lit(1))

    def put(t: Column, i: Column, at: Column) -> Column:
        tail = F.substring(t, at["offset"] + 1, F.length(t))
        return F.when(i == at["run"], F.concat(F.substring(t, F.lit(1), at["offset"]), F.lit(":"), F.when((after == ".") & F.startswith(tail, F.lit(".")), F.substring(tail, 2, 1 << 30)).otherwise(tail))).otherwise(t)

    return F.when((head == "") | (after == ":"), texts).otherwise(let(locate(texts, F.length(head)), lambda at: F.transform(texts, lambda t, i: put(t, i, at))))


def write_back(texts: Column, new: Column) -> Column:
    """New texts dealt to the runs one to one: extras join the last run, missing ones leave it empty, no runs get one."""
    n = F.size(texts)
    dealt = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.coalesce(F.get(new, i), F.lit("")))
    extra = F.array_join(F.slice(new, F.greatest(n, F.lit(1)) + 1, F.size(new) + 1), "")
    return F.concat(F.slice(dealt, 1, F.size(dealt) - 1), F.array(F.concat(F.element_at(dealt, -1), extra)))


def copy_format(target: Column, source: Column) -> Column:
    """Flags of source always, name, size and colour only where it sets them."""
    always = ("bold", "italic", "underline", "strike", "superscript", "subscript")
    return F.struct(*(source[f].alias(f) for f in always), *(F.coalesce(source[f], target[f]).alias(f) for f in ("name", "size", "color")))


def collapse_to_first(texts: Column, text: Column) -> Column:
    """All of a rewritten heading in its first run, the others empty."""
    return F.transform(texts, lambda t, i: F.when(i == 0, text).otherwise(F.lit("")))
