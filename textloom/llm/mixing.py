"""Mixing sources to target weights: temperature by bisection, then budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import free_names, materialize

_ROUNDS, _WIDTH = 7, 32
_BY_BLOCK = {"taken": "boolean", "rank": "bigint", "place": "double"}


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """32 bits of an md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _exponent(sizes: DataFrame, total: int, target_entropy: float | None, max_repeats: float | None, budget: float) -> float:
    """Bisect the exponent in [0, 1] over sums of the sources; only those sums come to the driver.

    Each round reads the sources once and evaluates a whole grid, so seven rounds narrow the
    interval to under 1e-10. Entropy falls as the exponent grows: the largest exponent that
    meets the target is nearest to the natural mix. The highest repetition falls too: the
    smallest exponent within the limit is the flattest mix allowed.
    """
    log_p = F.log(F.col("tokens") / F.lit(float(total)))
    base = sizes.agg(F.count(F.lit(1)).alias("n"), F.min(log_p).alias("least")).first()
    n, least = base["n"], base["least"]
    if n < 2:
        return 1.0

    def good(alpha: float, z: float, s: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - alpha * s / z >= target_entropy * math.log(n) - 1e-12
        return budget / total * math.exp((alpha - 1) * least) / z <= max_repeats + 1e-12

    low, high = 0.0, 1.0
    for k in range(_ROUNDS):
        grid = [low + (high - low) * i / _WIDTH for i in range(_WIDTH + 1)]
        sums = sizes.agg(*(e.alias(f"{name}{i}") for i, a in enumerate(grid) for name, e in (("z", F.sum(F.exp(F.lit(a) * log_p))), ("s", F.sum(F.exp(F.lit(a) * log_p) * log_p))))).first()
        met = [good(a, sums[f"z{i}"], sums[f"s{i}"]) for i, a in enumerate(grid)]
        if target_entropy is not None:
            if k == 0 and (met[-1] or not met[0]):
                return 1.0 if met[-1] else 0.0  # natural is flat enough, or even uniform is not
            at = max(i for i, m in enumerate(met) if m)
            low, high = grid[at], grid[min(at + 1, _WIDTH)]
        else:
            if k == 0 and (met[0] or not met[-1]):
                return 0.0 if met[0] else 1.0
            at = min(i for i, m in enumerate(met) if m)
            low, high = grid[max(at - 1, 0)], grid[at]
    return low if target_entropy is not None else high


def plan(
    docs: DataFrame,
    tokens: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | str = "corpus",
    blocks: int = 1024,
    seed: int = 0,
) -> DataFrame:
    """One row a source: source, tokens, weight, quota, epochs, and by block arrays taken, rank, place.

    Exactly one of target_entropy (as a share of the log of the number of sources) and
    max_repeats is given. budget is in tokens: a number, "corpus" for as many as there are, or
    "cover" for the least that reads every source at least once. A source's documents lie in
    blocks by a hash of their id; whole passes over the source come first, and the rest of its
    quota is filled with blocks in the order of a hash of seed, source and block, a block
    being taken if at least half of it fits. The quota is met to half a block. rank is a block's
    number in that order, from 0, and place the share of the quota that has been read when
    half of the block is: sources that are read in order of their blocks' places have their
    weights in every stretch of the mix. A later pass adds tokens / quota to the place.

    Only sums by (source, block) are shuffled, after partial sums, so a source with a third of
    all rows costs no more than its 1,024 sums. Sources without tokens get weight 0 and are
    read once. A null source is a source of its own.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    cells = docs.select(F.col(source_col).cast("string").alias("source"), block_of(F.col(id_col), blocks, seed).alias("block"), tokens.cast("long").alias("tokens"))
    cells = materialize(cells.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    every = materialize(cells.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    sizes = every.where("tokens > 0")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return every.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"), F.lit(1).cast("long").alias("epochs"), *(F.lit(None).cast(f"array<{t}>").alias(c) for c, t in _BY_BLOCK.items()))
    amount = float(total if isinstance(budget, str) else budget)
    alpha = _exponent(sizes, total, target_entropy, max_repeats, amount)
    raw = F.exp(F.lit(alpha) * F.log(F.col("tokens") / F.lit(float(total))))
    norm = sizes.agg(F.sum(raw)).first()[0]
    weighted = every.withColumn("weight", F.when(F.col("tokens") > 0, raw / F.lit(norm)).otherwise(0.0))
    if budget == "cover":
        amount = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    elif isinstance(budget, str) and budget != "corpus":
        raise ValueError(f"unknown budget {budget!r}")
    passes = F.col("weight") * F.lit(amount) / F.col("tokens")
    weighted = weighted.withColumn("quota", F.col("weight") * F.lit(amount)).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(passes + 1e-9)).otherwise(1).cast("long"))
    weighted = weighted.withColumn("_rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("tokens")))
    order = Window.partitionBy("source").orderBy(_hash(F.lit(f"order{seed}"), F.coalesce("source", F.lit("")), F.col("block").cast("string")), "block")
    ranked = cells.withColumn("_rank", F.row_number().over(order).cast("long") - 1).withColumn("_upto", F.sum("tokens").over(order) - F.col("tokens") / 2)
    both = ranked.select(F.col("source").alias("_s"), "block", "_rank", "_upto").join(weighted, F.col("_s").eqNullSafe(F.col("source")))
    own = {"taken": (F.col("_rest") > 0) & (F.col("_upto") <= F.col("_rest")), "rank": F.col("_rank"), "place": F.when(F.col("quota") > 0, F.col("_upto") / F.col("quota")).otherwise(0.0)}
    entry = F.struct("block", *(c.alias(name) for name, c in own.items()))
    full = both.groupBy("source", "tokens", "weight", "quota", "epochs").agg(F.map_from_entries(F.collect_list(F.struct(F.col("block"), entry))).alias("_by"))
    by_block = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.try_element_at("_by", b))
    return full.withColumn("_all", by_block).select("source", "tokens", "weight", "quota", "epochs", *(F.col(f"_all.{c}").alias(c) for c in _BY_BLOCK))


def block_of(id_col: Column, blocks: int, seed: int) -> Column:
    return (_hash(F.lit(f"block{seed}"), F.coalesce(id_col.cast("string"), F.lit(""))) % blocks).cast("int")


def _placed(docs: DataFrame, mix: DataFrame, id_col: str, source_col: str, seed: int, blocks: int) -> tuple[DataFrame, dict[str, Column]]:
    """docs joined with the mix's small table, and the columns that it gives each row."""
    names = dict(zip(("source", "weight", "epochs", "tokens", "quota", *_BY_BLOCK), free_names(docs, "_source", "_weight", "_epochs", "_tokens", "_quota", "_taken", "_rank", "_place"), strict=True))
    small = materialize(mix.select(*(F.col(c).alias(n) for c, n in names.items())), "mix-plan")
    joined = docs.join(small, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(names["source"])))
    own = {c: F.get(names[c], block_of(F.col(f"`{id_col}`"), blocks, seed)) for c in _BY_BLOCK}
    return joined, {
        "weight": F.col(names["weight"]),
        "copies": F.col(names["epochs"]) + F.coalesce(own["taken"], F.lit(False)).cast("long"),
        "rank": F.coalesce(own["rank"], F.lit(0).cast("long")),
        "place": F.coalesce(own["place"], F.lit(0.0)),
        "step": F.when(F.col(names["quota"]) > 0, F.col(names["tokens"]) / F.col(names["quota"])).otherwise(0.0),
    }


def with_copies(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 0, blocks: int = 1024, copies_col: str = "copies", weight_col: str = "weight", rank_col: str = "block_rank", place_col: str = "first_place") -> DataFrame:
    """docs with weight, copies (how often the mix reads the row), block_rank and first_place (where it first does).

    Repeated rows get equal values; a source without tokens has weight, rank and place 0.
    Columns of docs of these four names are replaced; all others stay as they are.
    """
    joined, own = _placed(docs, mix, id_col, source_col, seed, blocks)
    out = {weight_col: own["weight"], copies_col: own["copies"], rank_col: own["rank"], place_col: own["place"]}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in out}]
    return joined.select(*kept, *(c.alias(n) for n, c in out.items()))


def mix_rows(docs: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", seed: int = 0, blocks: int = 1024, place_col: str | None = None, **options) -> DataFrame:
    """The mixed corpus: each row as many times as the mix reads it, with the columns of docs.

    place_col adds where in the mix the copy is read: repartitionByRange and a sort by it
    write the mix as one stream that has the target weights throughout.
    """
    mix = plan(docs, tokens, id_col, source_col, blocks=blocks, seed=seed, **options)
    joined, own = _placed(docs, mix, id_col, source_col, seed, blocks)
    copies, copy = free_names(joined, "_copies", "_copy")
    out = joined.withColumn(copies, own["copies"]).where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    place = [(own["place"] + F.col(copy) * own["step"]).alias(place_col)] if place_col else []
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != place_col), *place)
