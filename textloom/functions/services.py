"""Places for outside services: language of a fragment, grammar, translation of link labels.

Each hook is a pandas function series -> series; the defaults are deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.html import fragments, rewrite_text_nodes
from textloom.functions.strings import strip

#: Frequent words by language, for the stand-in language scorer.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für im dem",
    "en": "the and of to in is that it was for with as his on be at by this",
    "es": "el la los las de que y en un una por con para su es del se no",
    "fr": "le la les de des et en un une que qui dans pour pas au est sur du",
}


def stop_word_language(text: Column, default: str = "en") -> Column:
    """The language with most stop words in the text, the first by name among equals; default for none."""
    words = F.split(F.lower(text), r"(?U)\W+")
    scores = F.array(*(F.struct(F.size(F.filter(words, _among(ws.split()))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(sorted(STOP_WORDS.items()))))
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit(default))


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def remove_language(text: Column, lang: str, classify: Callable[[Column], Column] = stop_word_language) -> Column:
    """The fragments of text in other languages, joined by a space."""
    return F.array_join(F.filter(fragments(text), lambda f: classify(f) != lang), " ")


def pages_without_language(pages: DataFrame, lang: str, html: str = "html", classify: Callable[[Column], Column] = stop_word_language) -> DataFrame:
    """pages with the fragments of one language taken out of every text node; tags, comments and code stay.

    A page without html stays so; all other columns stay.
    """
    return pages.withColumn(html, rewrite_text_nodes(F.col(html), lambda t: remove_language(t, lang, classify)))


def paragraph_edits(paragraphs: DataFrame, fix: Callable[[Column], Column]) -> DataFrame:
    """path, pos, texts: the changed paragraphs only, in the form that edit_docx takes.

    paragraphs is what docx_paragraphs gives and fix a column function, such as a grammar
    service. A changed text goes to its paragraph's first run; blank paragraphs aren't sent.
    """
    some = paragraphs.where(strip(F.col("text")) != "").withColumn("_new", fix(F.col("text")))
    return some.where(F.col("_new").isNotNull() & (F.col("_new") != F.col("text"))).select("path", "pos", F.array("_new").alias("texts"))


def external(function: Callable[[str], str], on_error: str = "keep") -> Callable[[Column], Column]:
    """A column function from any str -> str service. Blank text isn't sent; a failing call keeps the text (or gives null)."""

    @F.pandas_udf(T.StringType())
    def call(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or not t.strip():
                return t
            try:
                return function(t)
            except Exception:
                return t if on_error == "keep" else None

        return texts.map(one)

    return call


def with_error(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function from any str -> str service to struct(value, error): a failing call gives the text as it was and what went wrong."""

    @F.pandas_udf("value string, error string")
    def call(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str | None, str | None]:
            if t is None or not t.strip():
                return t, None
            try:
                return function(t), None
            except Exception as e:
                return t, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(t) for t in texts], columns=["value", "error"], dtype=object)

    return call
