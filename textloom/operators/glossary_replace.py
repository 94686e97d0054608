"""Glossary replacement: leftmost, longest key first, without overlaps, as one pass of one pattern."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import let
from textloom.operators.runs import merge_equal_styles


#: Characters of keys and targets that a glossary may have as a constant of the plan.
MOST_CHARACTERS = 4 << 20


def _escaped(c: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c)


def _trie_pattern(keys: list[str]) -> str:
    """A pattern of the longest key at a place, whose branches share their beginnings."""
    root: dict = {}
    for k in keys:
        node = root
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        ends = "" in node
        parts = []
        for c, child in sorted((c, n) for c, n in node.items() if c):
            run = _escaped(c)
            while len(child) == 1 and "" not in child:  # one way on: no group
                (c, child), = child.items()
                run += _escaped(c)
            parts.append(run + of(child))
        if not parts:
            return ""
        one = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return one + "?" if ends else one

    return of(root)


def token_pattern(keys: list[str]) -> str:
    """The longest key, else a run without a key's first letter, else a character: the tokens cover any text."""
    if not keys or "" in keys:
        raise ValueError("a glossary needs keys, and no empty one")
    first = "".join(sorted({re.sub(r"([\\\]\[^\-&])", r"\\\1", k[0]) for k in keys}))
    return "(?s)" + _trie_pattern(keys) + f"|[^{first}]+|."


def _lookup(glossary: dict[str, str], pad: str):
    """A column function from a token to its padded target: a constant array of small maps, picked by the token's hash."""
    if sum(len(k) + len(v) for k, v in glossary.items()) > MOST_CHARACTERS:
        raise ValueError(f"a glossary of over {MOST_CHARACTERS} characters is too large for a constant of the plan; apply it in parts")
    n = 2 * len(glossary) + 1
    slots: list[dict] = [{} for _ in range(n)]
    for k, v in glossary.items():
        slots[zlib.crc32(k.encode()) % n][k] = f"{pad}{v}{pad}"
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")
    return lambda t: F.try_element_at(F.get(table, (F.crc32(t.cast("binary")) % n).cast("int")), t)


def _tokens(text: Column, glossary: dict[str, str]) -> Column:
    return F.regexp_extract_all(text, F.lit(token_pattern(list(glossary))), 0)


def glossary_replace(text: Column, glossary: dict[str, str], pad: str = " ") -> Column:
    """text with every hit replaced by its target between pads. Null stays null.

    The glossary is a driver-side dict, a constant of the plan of at most MOST_CHARACTERS; an
    empty one is an error.
    """
    known = _lookup(glossary, pad)
    return F.array_join(F.transform(_tokens(text, glossary), lambda t: F.coalesce(known(t), t)), "")


def glossary_replace_runs(runs: Column, glossary: dict[str, str], pad: str = " ") -> Column:
    """glossary_replace over the text of runs {text, style}: a hit takes the style where it starts.

    Text between hits keeps its styles, and adjacent pieces of equal style become one. Without
    a hit the runs stay exactly as they were.
    """
    known = _lookup(glossary, pad)
    full = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    bounds = F.transform(runs, lambda r, i: F.struct(F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda n, x: n + F.length(x["text"])).alias("s"), F.length(r["text"]).alias("n"), r["style"].alias("style")))

    def placed(tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.aggregate(F.slice(tokens, 1, i), F.lit(0), lambda n, x: n + F.length(x)).alias("s")))

    def pieces(x: Column, bounds: Column) -> Column:
        part = lambda b: F.substring(x["t"], F.greatest(b["s"] - x["s"], F.lit(0)) + 1, F.least(b["s"] + b["n"], x["s"] + F.length(x["t"])) - F.greatest(b["s"], x["s"]))
        over = F.filter(bounds, lambda b: (b["s"] < x["s"] + F.length(x["t"])) & (b["s"] + b["n"] > x["s"]))
        hit = F.array(F.struct(known(x["t"]).alias("text"), F.get(over, F.lit(0))["style"].alias("style")))
        return F.when(x["t"].isin(*glossary), hit).otherwise(F.transform(over, lambda b: F.struct(part(b).alias("text"), b["style"].alias("style"))))

    return F.when(glossary_hits(full, glossary) == 0, runs).otherwise(merge_equal_styles(let(bounds, lambda b: F.flatten(F.transform(let(_tokens(full, glossary), placed), lambda x: pieces(x, b))))))


def glossary_hits(text: Column, glossary: dict[str, str]) -> Column:
    """How many replacements the text takes; null text takes none."""
    return F.coalesce(F.size(F.filter(_tokens(text, glossary), lambda t: t.isin(*glossary))), F.lit(0)).cast("long")
