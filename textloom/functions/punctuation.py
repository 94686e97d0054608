"""The punctuation normaliser: a fixed chain of rewrites inside one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import let
from textloom.functions.unicode import nfkc

#: Quotes and full-width marks with their ASCII forms.
DOUBLE_QUOTES = "“”‟「」『』"
SINGLE_QUOTES = "‘’‛"
CJK_MARKS = {"，": ",", "。": ".", "：": ":", "；": ";", "！": "!", "？": "?", "（": "(", "）": ")", "【": "[", "】": "]", "、": ","}
CONTRACTIONS = "s|t|m|re|ll|ve|d"
CURRENCIES = "$€£¥"
#: Small letters with a one-letter capital beside their full one of several letters (ß: ẞ beside SS).
SIMPLE_CAPITALS = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")

#: The rewrites, pattern and replacement, in the order in which they apply.
NUMBERS = (
    (r"(?U)(\d)\s*\.\s*(\d)", "$1.$2"),
    (r"(?U)(\d)\s*,\s*(\d{3})", "$1,$2"),
    (r"(?U)(\d)\s+%", "$1%"),
    (rf"(?U)([{CURRENCIES}])\s+(\d)", "$1$2"),
)
FAITHFUL_APOSTROPHE = (r"(?U)([a-zA-Z])\s+'", r"$1\\'")
FIXED_APOSTROPHE = (r"(?U)([a-zA-Z])\s+'", "$1'")
WORDS = (
    (rf"(?iU)'\s+({CONTRACTIONS})(?!\w)", "'$1"),
    (r"(?U)\bi\b", "I"),
)
QUOTES = (
    (r'(?<=[a-zA-Z])"(?=[A-Z])', ' "'),
    (r"(?U)\s{2,}", " "),
    (r'(?U)"\s+(?=\S)', '"'),
    (r'(?U)(?<=[a-zA-Z0-9.,!?])\s+"', '"'),
    (r"(?U)\(\s+", "("),
    (r"(?U)\s+\)", ")"),
)
MARKS = (
    (r"([.!?])(?=[A-Z])", "$1 "),
    (r"([,;:])(?=[a-zA-Z])", "$1 "),
)
FAITHFUL_MARKS = ((r'([.,;:!?])(?=")', "$1 "),)
REPEATS = (
    (r"([,:;])\1+", "$1"),
    (r"([!?])\1+", "$1"),
    (r"\.{4,}", "..."),
)


def _rewrite(c: Column, rules: tuple) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def map_marks(c: Column) -> Column:
    """Quotes, CJK marks, … and doubled dashes to their plain forms."""
    single = F.translate(c, DOUBLE_QUOTES + SINGLE_QUOTES + "".join(CJK_MARKS) + " ", '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "".join(CJK_MARKS.values()) + " ")
    return F.replace(F.replace(single, F.lit("…"), F.lit("...")), F.lit("——"), F.lit("—"))


def tighten_numbers(c: Column) -> Column:
    return _rewrite(c, NUMBERS)


def fix_contractions(c: Column, mode: str = "faithful") -> Column:
    """Faithful mode keeps a stray backslash before a quote that followed a letter and spaces; fixed mode drops it."""
    if mode not in ("faithful", "fixed"):
        raise ValueError(f"unknown mode {mode!r}")
    return _rewrite(c, (FAITHFUL_APOSTROPHE if mode == "faithful" else FIXED_APOSTROPHE, *WORDS))


def space_quotes(c: Column) -> Column:
    return _rewrite(c, QUOTES)


def space_punctuation(c: Column, mode: str = "faithful") -> Column:
    """A space after marks that stick to the next word; faithful mode also puts one before a quote after a mark."""
    return _rewrite(c, MARKS + (FAITHFUL_MARKS if mode == "faithful" else ()))


def single_punctuation(c: Column) -> Column:
    return _rewrite(c, REPEATS)


def capitalise_sentences(c: Column, capitals: str = "full") -> Column:
    """Capitals at the start of the text and of its sentences.

    Full capitals may have several letters (ß becomes SS); simple ones have one (ẞ), and a letter without such a one stays.
    """
    if capitals not in ("full", "simple"):
        raise ValueError(f"unknown capitals {capitals!r}")

    def started(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        raised = F.upper(first)
        if capitals == "simple":
            raised = F.when(F.length(raised) > 1, F.translate(first, *SIMPLE_CAPITALS)).otherwise(raised)
        return F.when((F.lower(first) == first) & (F.upper(first) != first), F.concat(raised, F.substring(t, 2, 1 << 30))).otherwise(t)

    tokens = F.regexp_extract_all(let(c, started), F.lit(r"(?sU)[.!?]\s+[a-z]|[^.!?]+|."), 0)
    raised = F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit(r"(?sU)^[.!?]\s+[a-z]$")), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.upper(F.substring(t, -1, 1)))).otherwise(t))
    return F.array_join(raised, "")


def normalise(c: Column, mode: str = "faithful", with_nfkc: bool = True, capitals: str = "full") -> Column:
    """The whole chain; null becomes the empty text. with_nfkc=False leaves out the one Arrow step, for text known to be normalised."""
    text = F.coalesce(c, F.lit(""))
    text = nfkc(text) if with_nfkc else text
    text = F.regexp_replace(text, "[  -​　]", " ")
    return capitalise_sentences(single_punctuation(space_punctuation(space_quotes(fix_contractions(tighten_numbers(map_marks(text)), mode)), mode)), capitals)
