"""Spelled numbers: English words, CJK numerals, numbered headings, and the base-value formulae."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import let, strip

#: Number words and numerals.
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i + 1 for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
CJK_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CJK_UNITS = {"十": 10, "百": 100, "千": 1000}
CJK_SCALES = {"万": 10**4, "亿": 10**8}


def _map(values: dict[str, int], value_type: str = "int") -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(value_type))))


def words_to_number(c: Column) -> Column:
    """Value of spelled English numbers up to thousands; null for an unknown word or nothing above 0.

    Words are added up: "one two" is 3. "hundred" multiplies what is built so far, "thousand"
    also closes it; both count as one of themselves when nothing precedes.
    """
    codes = _map(NUMBER_WORDS | {"and": 0, "a": 0, "hundred": -100, "thousand": -1000}, "long")
    words = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[^\s-]+"), 0), lambda w: F.try_element_at(codes, w))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(acc: Column, k: Column) -> Column:
        done, now = acc["done"], acc["now"]
        return (
            F.when(k >= 0, F.struct(done.alias("done"), (now + k).alias("now")))
            .when(k == -100, F.struct(done.alias("done"), (F.greatest(now, one) * 100).alias("now")))
            .when(k == -1000, F.struct((done + F.greatest(now, one) * 1000).alias("done"), zero.alias("now")))
        )

    start = F.struct(zero.alias("done"), zero.alias("now"))
    return F.aggregate(words, start, step, lambda a: F.nullif(a["done"] + a["now"], zero))


def rewrite_chapter_words(line: Column) -> Column:
    """Spelled numbers after "chapter" in digits; only the first word converts when a space ends it, as documented."""

    def put(t: Column, words: Column, end: int) -> Column:
        """t with the number for its words, which end characters follow."""
        return let(words, lambda w: let(words_to_number(w), lambda n: F.when(n.isNotNull(), F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(w) - end), n.cast("string"), F.substring(t, F.length(t) - end + 1, F.lit(end)))).otherwise(t)))

    def one(t: Column) -> Column:
        """t is a text that ends with its only chapter and the mark after it, or without one."""
        return put(t, F.regexp_extract(t, r"(?iU)Chapter\s+([\w\s-]+?)[.,:;!\s]\z", 1), 1)

    def rewritten(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(r"(?isU).*?Chapter\s+[\w\s-]+?[.,:;!\s]|.+"), 0)
        inner = F.array_join(F.transform(pieces, one), "")
        whole = let(inner, lambda l: put(l, F.regexp_extract(l, r"(?iU)Chapter\s+([\w\s-]+?)\z", 1), 0))
        return F.when(F.rlike(t, F.lit(r"(?iU)Chapter\s")), whole).otherwise(t)

    return let(line, rewritten)


def _cjk_integer(part: Column) -> Column:
    """A fold over Arabic runs and single characters, each looked up once: digits and runs are 0 or more, units and scales below 0."""
    codes = _map(CJK_DIGITS | {u: -v for u, v in (CJK_UNITS | CJK_SCALES).items()}, "long")
    tokens = F.transform(F.regexp_extract_all(part, F.lit("[0-9]+|[^0-9]"), 0), lambda x: F.when((x >= "0") & (x < ":"), x.cast("long")).otherwise(F.try_element_at(codes, x)))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(acc: Column, k: Column) -> Column:
        total, section, number = acc["total"], acc["section"], acc["number"]
        return (
            F.when(k <= -10_000, F.struct((total - F.greatest(section + number, one) * k).alias("total"), zero.alias("section"), zero.alias("number")))
            .when(k < 0, F.struct(total.alias("total"), (section - F.greatest(number, one) * k).alias("section"), zero.alias("number")))
            .when(k >= 0, F.struct(total.alias("total"), section.alias("section"), k.alias("number")))
            .otherwise(acc)
        )

    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("number"))
    return F.aggregate(tokens, start, step, lambda a: a["total"] + a["section"] + a["number"])


def _cjk_parts(text: Column, of) -> Column:
    """of(negative, whole part, digits after the point or the empty text)."""
    negative = F.startswith(text, F.lit("负")) | F.startswith(text, F.lit("-"))

    def unsigned(body: Column) -> Column:
        digits = F.regexp_extract(body, f"^[^点]*点([0-9{''.join(CJK_DIGITS)}]+)", 1)
        plain = F.translate(digits, "".join(CJK_DIGITS), "".join(map(str, CJK_DIGITS.values())))
        fraction = F.when(F.contains(body, F.lit("点")), plain).otherwise(F.lit(""))
        return let(_cjk_integer(F.substring_index(body, "点", 1)), lambda whole: let(fraction, lambda d: of(negative, whole, d)))

    return let(F.when(negative, F.substring(text, 2, 1 << 30)).otherwise(text), unsigned)


def _signed(negative: Column, value: Column) -> Column:
    return F.when(negative, -value).otherwise(value)


def cjk_to_number(c: Column) -> Column:
    """Value of CJK, Arabic or mixed numerals as a double; null for null or empty text.

    A digit replaces the one before it, so 一二三 is 3; 万 and 亿 multiply only what follows the
    last of them, so 一万亿 is 100010000.
    """
    def value(negative: Column, whole: Column, digits: Column) -> Column:
        return _signed(negative, F.when(digits != "", F.concat(whole.cast("string"), F.lit("."), digits)).otherwise(whole.cast("string")).cast("double"))

    return F.when(c != "", let(strip(c), lambda t: _cjk_parts(t, value)))


def rewrite_chapter_numerals(text: Column) -> Column:
    """CHAPTER <numerals>: with the numerals as a number; case-sensitive, integral values without a fraction."""
    numeral = f"[0-9{''.join(CJK_DIGITS)}{''.join(CJK_UNITS)}{''.join(CJK_SCALES)}点负-]+"

    def shown(negative: Column, whole: Column, digits: Column) -> Column:
        number = let(_signed(negative, F.concat(whole.cast("string"), F.lit("."), digits).cast("double")), lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string")))
        return F.when(digits != "", number).otherwise(_signed(negative, whole).cast("string"))

    def one(t: Column) -> Column:
        """t is a text that ends with its only chapter, or without one."""
        found = F.regexp_extract(t, rf"(?U)CHAPTER\s*({numeral}):$", 1)
        return let(found, lambda n: F.when(n != "", F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(n) - 1), _cjk_parts(n, shown), F.lit(":"))).otherwise(t))

    def rewritten(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"(?sU).*?CHAPTER\s*{numeral}:|.+"), 0)
        return F.when(F.contains(t, F.lit("CHAPTER")), F.array_join(F.transform(pieces, one), "")).otherwise(t)

    return let(text, rewritten)


def number_heading_colon(c: Column) -> Column:
    """1. Foo and 1 Foo to 1: Foo; a colon that is there stays, text without a leading number too."""
    head = F.regexp_extract(c, r"(?U)^\s*(\d++(?:\.\d++)*+)", 0)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    return F.when((head == "") | F.startswith(rest, F.lit(":")), c).when(F.startswith(rest, F.lit(".")), F.concat(head, F.lit(":"), F.substring(rest, 2, 1 << 30))).otherwise(F.concat(head, F.lit(":"), rest))


def clean_chapter_title(c: Column) -> Column:
    """Without a trailing part mark such as (1/3), [1/3] or （1/3）, whose brackets may differ."""
    return strip(F.regexp_replace(c, r"(?U)\s*[\(\[（]\s*\d+\s*/\s*\d+\s*[\)\]）]\s*$", ""))


def row_sum(*columns: Column) -> Column:
    """The sum of a row's values; null if one is."""
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def hp_base(stat: Column, iv: Column, ev: Column, level: Column) -> Column:
    """Rounded half to even."""
    return F.bround(((stat - 10) * (F.lit(100.0) / level) - 100 - iv - ev / 4) / 2)


def stat_base(stat: Column, nature: Column, iv: Column, ev: Column, level: Column) -> Column:
    return F.bround(((stat / nature - 5) * (F.lit(100.0) / level) - iv - ev / 4) / 2)


def centred(total: Column, size: Column) -> Column:
    return (total - size) / 2
