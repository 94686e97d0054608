"""Quality rules whose cutoffs come from labelled documents under exact binomial bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT = 5

#: Rules: a document is rejected where the value is over the stratum's cutoff. The grids are fixed values.
GRIDS = {
    "symbol_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_ratio": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2],
    "upper_ratio": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
    "bang_ratio": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5],
    "long_words": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0],
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None) -> DataFrame:
    """id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' values, for every row.

    Words are runs of other than ASCII white space. n_dup_lines counts \\n-split lines that
    hold a word and equal an earlier line; n_repeat_words counts the words inside five-word
    windows that occur twice or more in the text. Null text: all 0. One row at a time, no
    shuffle; repeats are found by sorting a text's own window hashes, and only in texts where
    a hash occurs twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")).alias("stratum"), text.alias("_t"))
    worded = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\v\f")) != "")
    out = out.withColumn("_hash", F.transform(F.filter(F.split("_t", _SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w)))
    out = out.withColumn("_lines", worded)
    out = out.select(
        "doc_id",
        "stratum",
        F.size("_hash").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("_upper"),
        F.regexp_count("_t", F.lit("[a-zA-Z]")).cast("long").alias("_letters"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("_bangs"),
        "_hash",
    )
    several = F.when(F.size("_hash") >= REPEAT, F.transform(F.sequence(F.lit(0), F.size("_hash") - REPEAT), lambda i: F.xxhash64(*(F.get("_hash", i + k) for k in range(REPEAT))))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_win", several).drop("_hash")
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_win")
    same = F.filter("_sorted", lambda e, k: (F.get("_sorted", k - 1)["h"] == e["h"]) | (F.get("_sorted", k + 1)["h"] == e["h"]))
    out = out.withColumn("_at", F.array_sort(F.transform(same, lambda e: e["i"]))).drop("_sorted")
    covered = F.aggregate("_at", F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(REPEAT), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("_n_lines", F.lit(1))
    return out.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("_upper") / F.greatest("_letters", F.lit(1))).alias("upper_ratio"),
        (F.col("_bangs") / words).alias("bang_ratio"),
        (F.col("word_chars") / words).alias("long_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of chance p: the regularised incomplete beta function I_{1-p}(n - k, k + 1), by continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1.0 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            f *= step
        if abs(step - 1.0) < 1e-14:
            break
    return front * f


@dataclass(frozen=True)
class Cutoff:
    """None as cutoff: no cutoff of the grid is safe, the rule rejects nothing there. None as stratum: documents without one."""

    stratum: str | None
    rule: str
    cutoff: float | None
    good: int
    good_rejected: int
    bad_rejected: int


def choose_cutoffs(measured: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", false_rejection: float = 0.05, error: float = 0.05) -> list[Cutoff]:
    """The most useful safe cutoff of every rule in every stratum.

    With probability 1 - error over the labelled holdout, no stratum loses more than
    false_rejection of its good documents: each rule may reject false_rejection / rules of
    them; a cutoff is safe if the exact binomial probability of so few rejections, were the
    true share above that, is at most error / (strata x rules). That is Bonferroni's correction
    over strata and rules; within a rule the cutoffs are tested from the highest down, up to
    the first that isn't safe, which needs no further correction (a fixed sequence of tests).
    Of the safe cutoffs the one with most bad less good documents rejected is taken, the highest
    of equals. Documents that the base rules reject anyway are no part of the holdout. A
    stratum without labels has no cutoff, as nothing is known of its good documents; those
    without a stratum are a stratum of their own.

    Good and bad labels are counted by stratum, rule and grid step over all labels; a count
    table of strata x 6 x 11 rows comes to the driver. A label row counts as often as it
    occurs; rows without a label value or id, and ids without a document, count for nothing.
    measured is to be a written table (materialize): each value is used in many steps, and an
    unwritten one would be computed again for each.
    """
    held = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).where("_label IS NOT NULL")
    rows = measured.where(~base_failed()).join(held, "doc_id")
    steps = [F.struct(F.lit(rule).alias("rule"), sum(((F.col(rule) > c).cast("int") for c in grid), F.lit(0)).alias("step")) for rule, grid in GRIDS.items()]
    counts = rows.select("stratum", "_label", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") == 0).alias("bad")).collect()
    table: dict[tuple[str | None, str], list[list[int]]] = {}
    for r in counts:
        cell = table.setdefault((r["stratum"], r["rule"]), [[0, 0] for _ in range(1 + max(map(len, GRIDS.values())))])
        cell[r["step"]][0] += r["good"]
        cell[r["step"]][1] += r["bad"]
    tests = max(1, len({s for s, _ in table})) * len(GRIDS)
    out = []
    for (stratum, rule), cell in sorted(table.items(), key=lambda x: (x[0][0] is not None, x[0])):
        n = sum(g for g, _ in cell)
        best = Cutoff(stratum, rule, None, n, 0, 0)
        for i in range(len(GRIDS[rule]) - 1, -1, -1):
            k, bad = sum(g for g, _ in cell[i + 1 :]), sum(b for _, b in cell[i + 1 :])
            if n == 0 or binomial_tail(k, n, false_rejection / len(GRIDS)) > error / tests:
                break
            if bad - k > best.bad_rejected - best.good_rejected:
                best = Cutoff(stratum, rule, GRIDS[rule][i], n, k, bad)
        out.append(best)
    return out


def apply_cutoffs(measured: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """measured with base_failed, failed_rules (array) and kept; the cutoffs are constants of the plan.

    Each stratum has its own cutoffs only; one that no cutoff names is judged by the base rules
    alone. Repeated rows are judged alike; other columns stay.
    """
    fails = []
    for rule in GRIDS:
        limit = F.lit(None).cast("double")
        for c in cutoffs:
            if c.rule == rule and c.cutoff is not None:
                limit = F.when(F.col("stratum").eqNullSafe(F.lit(c.stratum)), F.lit(c.cutoff)).otherwise(limit)
        fails.append(F.when(F.col(rule) > limit, F.lit(rule)))
    out = measured.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*fails)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
