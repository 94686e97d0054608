"""URL rules found by their rarest literal token, so that few regular expressions run on a URL."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules without a literal token are candidates for every URL, under this name.
EVERY = ""
_LITERAL = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression for host + path; tokens: words that each match holds whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(rule: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's; longer outranks."""
    host, slash, path = rule.partition("/")
    tokens = _LITERAL.findall(host.lower())
    # the last word of the path may go on in the URL: it is no whole token
    tokens += [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    pattern = rf"^(?:[^/]*\.)?\Q{host.lower()}\E\Q{slash}{path}\E"
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys(tokens)), 1_000_000 + len(rule))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: tuple[str, ...], rank: int | None = None) -> Rule:
    """A regular expression with the tokens that every match holds; it gives way to any host/path rule.

    Rules that are cases of one pattern have that pattern's length as rank.
    """
    return Rule(name, verdict, pattern, tokens, len(pattern) if rank is None else rank)


#: The method's own rules, which decide where no host/path rule fits: names of hosts that sell clicks or pills.
PATTERNS = (
    pattern_rule("spam farm", "block", r"^(?:[^/]*\.)?spam-farm\.", ("spam", "farm")),
    *(pattern_rule("pill shop", "block", rf"^(?:[^/]*[.-])?(?:cheap|buy|online)-{w}[.-]", (w,), 46) for w in ("pill", "pills")),
    pattern_rule("casino", "block", r"^(?:[^/]*[.-])?casino[.-]", ("casino",)),
    *(pattern_rule("adult", "block", rf"^(?:[^/]*[.-])?{w}[.-]", (w,), 31) for w in ("porn", "xxx")),
    *(pattern_rule("click bait", "block", rf"^(?:[^/]*[.-])?(?:free|win)-{w}[.-]", (w,), 49) for w in ("prize", "prizes", "money")),
    *(pattern_rule("tracker", "block", rf"/{w}\.{end}$", (w, end), 30) for w in ("click", "track") for end in ("php", "cgi")),
)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_tokens(host_col: Column, path_col: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(_ascii_lower(F.concat(host_col, path_col)), F.lit("[a-z0-9]+"), 0))


def token_counts(urls: DataFrame, tokens: list[str], url_col: str = "url") -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs: one pass over the column, counted before it is shuffled."""
    if not tokens:
        return {}
    known = F.array(*map(F.lit, tokens))
    held = F.array_intersect(url_tokens(host(F.col(url_col)), path(F.col(url_col))), known)
    counts = urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}  # at most one row for each token of the rules


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token, equal counts by the longer token, then by name."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=EVERY)
        index.setdefault(token, []).append(r)
    return index


_RULE_TYPE = "struct<pattern:string,rank:int,name:string,verdict:string>"


def _candidates(tokens: Column, index: dict[str, list[Rule]]) -> Column:
    """The rules filed under a URL's tokens, in time that doesn't grow with the index.

    The index is a constant: an array of small maps, picked by the token's hash.
    """
    n = max(1, 2 * len(index))
    slots: list[dict] = [{} for _ in range(n)]
    for token, rules in index.items():
        if token != EVERY:
            slots[zlib.crc32(token.encode()) % n][token] = [{"pattern": r.pattern, "rank": r.rank, "name": r.name, "verdict": r.verdict} for r in rules]
    table = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,array<{_RULE_TYPE}>>>")
    every = F.from_json(F.lit(json.dumps([{"pattern": r.pattern, "rank": r.rank, "name": r.name, "verdict": r.verdict} for r in index.get(EVERY, [])])), f"array<{_RULE_TYPE}>")
    empty = F.from_json(F.lit("[]"), f"array<{_RULE_TYPE}>")
    fetched = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.get(table, (F.crc32(t.cast("binary")) % n).cast("int")), t), empty))
    return F.concat(F.flatten(fetched), every)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    index_bytes: int = 1 << 20,
) -> DataFrame:
    """id, host, path, rule, pattern_rule, verdict, n_candidates for every row.

    rule is the longest host/path rule that fits, by name among equals; pattern_rule the
    strongest pattern that matches. The verdict is the rule's, else the pattern's, else
    default. n_candidates is how many regular expressions ran.

    A URL's tokens fetch the rules filed under them from a constant inside the plan, so there
    is neither a join nor a shuffle, and a host with a third of all rows costs what any other
    does. Rules of over index_bytes together go into several such constants. Rarity is counted
    over all rows first.

    A null url or one without :// has empty host and path, fits no host/path rule and gets
    default unless a pattern matches the empty text. Repeated rows give repeated results, an
    empty table none; other columns are never read; a null id stays null.
    """
    tokens = sorted({t for r in rules for t in r.tokens})
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    counts = token_counts(narrow, tokens)
    parts: list[list[Rule]] = [[]]
    held = 0
    for r in rules:
        size = len(r.pattern) + len(r.name) + 80
        if parts[-1] and held + size > index_bytes:
            parts.append([])
            held = 0
        parts[-1].append(r)
        held += size
    cut = narrow.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    cut = cut.withColumn("_tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("_subject", F.concat("host", "path"))
    fetched = F.concat(*(_candidates(F.col("_tokens"), rule_index(p, counts)) for p in parts))
    cut = cut.withColumn("_candidates", fetched)
    fits = F.filter(F.col("_candidates"), lambda r: F.rlike(F.col("_subject"), r["pattern"]))
    best = F.array_sort(F.transform(fits, lambda r: F.struct((-r["rank"]).alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    cut = cut.withColumn("_best", F.get(best, F.lit(0)))
    named = F.col("_best.rank") <= -1_000_000
    return cut.select(
        "page_id",
        "host",
        "path",
        F.when(named, F.col("_best.name")).alias("rule"),
        F.when(~named, F.col("_best.name")).alias("pattern_rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
        F.size("_candidates").cast("long").alias("n_candidates"),
    )
