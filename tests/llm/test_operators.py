"""Each operator against a plain version, and on odd input: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import decontaminate, golay, langid, license_scan, line_dedup, mixing, quality_rules, queries, simhash, token_count, token_output, url_filter
from textloom.llm.common import materialize
from textloom.llm.components import connected_components
from textloom.llm.word_encoder import WordEncoder, pieces

from compare import connection, rows_in_sql, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, copies int, w string, fp long, _t string"
VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that operators must stand, with columns named like theirs."""
    long = "the cat sat. " * 20_000
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "a"), (None, "the cat sat on the mat\nand\nso\non"), (None, None), (5, long), (6, "the cat sat on the mat\nand\nso\non"), (6, "the cat sat on the mat\nand\nso\non"), (7, "x\x1cy  \x85 z #"), (8, "日本語 テキスト"), (9, "All rights reserved.")]
    return spark.createDataFrame([(i, t, None if i in (1, 4) else "en", None if i == 2 else "s", 0, 1, 2, "w", 3, "t") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# ---- 1 line deduplication


def brute_lines(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        worded = [(n, s.strip(" \t\r\v\f")) for n, s in enumerate(lines) if s.strip(" \t\r\v\f")]
        gone = set()
        for a, b, c in zip(worded, worded[1:], worded[2:], strict=False):
            key = (a[1], b[1], c[1])
            if key in seen:
                gone |= {a[0], b[0], c[0]}
            seen.add(key)
        out[i] = "\n".join(s for n, s in enumerate(lines) if n not in gone)
    return out


def test_line_dedup(spark, docs, texts):
    got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(texts)
    block = "a\nb\nc\nd"
    rows = spark.createDataFrame([(2, f"x\n{block}\n\ny"), (1, block), (3, "b\nc\nd\nb\nc\nd")], "doc_id long, text string")
    out = {r.doc_id: (r.clean_text, r.removed_lines) for r in line_dedup.dedup_lines(rows).collect()}
    assert out == {1: (block, []), 2: ("x\n\ny", [1, 2, 3, 4]), 3: ("", [0, 1, 2, 3, 4, 5])}


def test_line_dedup_odd(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 12 and line_dedup.dedup_lines(empty).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].clean_text is None and by[1].n_lines == 0 and by[2].clean_text == "" and by[6].n_removed == 4
    assert {r.clean_text for r in rows if r.doc_id is None} == {None, "the cat sat on the mat\nand\nso\non"}


# ---- 2 near duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}


def test_near_duplicates_odd(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12 and simhash.near_duplicates(empty).count() == 0
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    same = [r for r in rows if r.doc_id == 6]
    assert len(same) == 2 and {r.component_id for r in same} == {6}


def test_golay_keys_share_up_to_distance_two():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 500, dtype=np.uint32)

    def keys(ws):
        at, k = golay.keys(ws)
        return set(zip(at.tolist(), k.tolist(), strict=True))

    assert set(np.bincount(golay.key_errors()[1]).nonzero()[0].tolist()) == {1, 6}
    for flips in range(3):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= np.uint32(1 << int(b))
        assert {i for i, _ in keys(words) & keys(other)} == set(range(500))


def test_large_bucket_is_split_and_loses_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    table = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in table.values()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=16)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = plain_components(table)
    groups = {}
    for i, f in table.items():
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(roots.get(s, s), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    pairs = [*chain, (100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# ---- 3 language


def test_language(spark, sf_dir, docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_equals_a_plain_version(docs, texts):
    """Every document's language and score by plain loops over grams and classifiers, from the same fit."""
    import math

    model = langid.train(docs)

    def plain(text):
        if not any(unicodedata.category(c).startswith("L") for c in text):
            return "und", 0.0
        low = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())) + b" "
        total, n = [0.0] * len(model.bias), 0
        for i in range(len(low)):
            places = [low[i]]
            if i + 1 < len(low):
                two = low[i] * 40503 + low[i + 1] * 34283 + 17
                places.append(two % 65536)
            if i + 2 < len(low):
                three = two * 31 + low[i + 2] * 49843 + 91
                three = (three + 2**31) % 2**32 - 2**31
                places.append((three ^ three >> 13) & 65535)
            for p in places:
                n += 1
                total = [t + float(w) for t, w in zip(total, model.weights[p], strict=True)]
        chance = [1 / (1 + math.exp(-(t / n + b) * s)) for t, b, s in zip(total, model.bias, model.steep, strict=True)]
        of = chance[: len(model.families)]
        family = model.families[of.index(max(of))]
        langs = model.languages[family]
        votes = dict.fromkeys(langs, 0.0)
        for (f, x, y), q in zip(model.pairs, chance[len(of) :], strict=True):
            if f == family:
                votes[x] += q
                votes[y] += 1 - q
        best = max(langs, key=votes.get)
        return best, max(of) / sum(of) * (votes[best] / (len(langs) - 1) if len(langs) > 1 else 1)

    short = {i: t for i, t in texts.items() if len(t) < 3000}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert len(short) > 100
    for i, t in short.items():
        lang, score = plain(t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-6)


def test_support_vectors_reach_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 12)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=200) > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda v: 0.5 * v @ v + 10 * (share * np.maximum(0, 1 - y * (np.c_[x, np.ones(200)] @ v)) ** 2).sum()
    w, bias, _ = langid._linear(x, y, rounds=1000)
    found = np.r_[w, bias].astype(float)
    assert all(loss(found) <= loss(found + rng.normal(size=13) * size) + 1e-6 for size in (0.3, 0.03, 0.003) for _ in range(200))


def test_language_odd(odd, empty):
    rows = langid.identify(odd).collect()
    assert langid.identify(empty).count() == 0
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id is not None}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[5][0] == "en"
    model = langid.Model(["x"], {"x": ["x"]}, [], np.zeros((langid.BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    assert [model.predict(t.encode())[0] for t in ("½ ²", "Ⅻ 12", "ª", "ß", "語")] == ["und", "und", "x", "x", "x"]
    whole = b"Some text, with words; and more of them. " * 9
    once, cut = np.concatenate(list(langid.gram_slabs(whole))), np.concatenate(list(langid.gram_slabs(whole, 7)))
    assert sorted(once.tolist()) == sorted(cut.tolist()) and langid.gram_counts(whole)[1].sum() == len(once)
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


# ---- 4 mixing


def test_mixing_meets_its_targets(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 6 else None, 10) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    sizes = Counter(s for _, s, _ in rows)
    n = {k: 10 * v for k, v in sizes.items()}
    mix = {r.source: r for r in mixing.plan(docs, F.col("n"), target_entropy=0.97).collect()}
    w = {k: mix[k].weight for k in n}
    assert abs(sum(w.values()) - 1) < 1e-9
    assert abs(-sum(x * np.log(x) for x in w.values()) / np.log(3) - 0.97) < 1e-6
    counted = mixing.with_copies(docs, mixing.plan(docs, F.col("n"), target_entropy=0.97)).groupBy("source").agg(F.sum(F.col("copies") * F.col("n")).alias("t")).collect()
    for r in counted:
        assert abs(r.t - w[r.source] * sum(n.values())) <= n[r.source] / 1024 * 4 + 10
    limited = {r.source: r for r in mixing.plan(docs, F.col("n"), max_repeats=1.5).collect()}
    assert max(r.weight * sum(n.values()) / n[k] for k, r in limited.items()) == pytest.approx(1.5, abs=1e-6)
    stream = mixing.mix_rows(docs, F.col("n"), target_entropy=0.97, place_col="place").toPandas().sort_values("place", kind="stable")
    for part in np.array_split(stream.fillna({"source": "none"}), 10):  # every tenth of the mix has the weights of the whole
        share = part.groupby("source")["n"].sum() / part["n"].sum()
        assert all(abs(share.get(k or "none", 0) - v) < 0.03 for k, v in w.items())
    for _, own in stream[stream.source == "small"].groupby("doc_id"):  # a later pass reads a block later
        assert own.place.is_unique
    cover = mixing.mix_rows(docs.withColumn("weight", F.lit(5)), F.col("n"), target_entropy=0.97, budget="cover")
    assert cover.columns == ["doc_id", "source", "n", "weight"] and cover.select("doc_id").distinct().count() == 6000


def test_mixing_odd(odd, empty):
    size = mixing.word_count(F.col("text"))
    assert mixing.mix_rows(empty, size, target_entropy=0.9).count() == 0
    out = mixing.with_copies(odd, mixing.plan(odd, size, target_entropy=0.9, budget="cover")).collect()
    assert len(out) == 12 and all(r.copies >= 1 for r in out)
    with pytest.raises(ValueError):
        mixing.plan(odd, size)


# ---- 5 URL filters


def test_url_filters(spark):
    rules = [*(url_filter.host_path_rule(*r) for r in queries.URL_RULES), *url_filter.PATTERNS]
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/en/148", "http://notexample.org/en/1", "http://x.com/fr/a#t", "http://com/de/", "http://x.com/fr", None, "no scheme", "", "http://cheap-pills.example.net/x", "http://x.org", "a://b://c/d", "http://spam-farm.x.com/de/1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/148", "example.org/en/1", "block"), ("notexample.org", "/en/1", "org/", "allow"), ("x.com", "/fr/a", "com/fr/", "allow"),
        ("com", "/de/", "com/de/", "block"), ("x.com", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("cheap-pills.example.net", "/x", None, "block"),
        ("x.org", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("spam-farm.x.com", "/de/1", "com/de/", "block"),
    ]
    assert url_filter.judge(df, rules, index_bytes=200).orderBy("page_id").select("verdict").collect() == url_filter.judge(df, rules).orderBy("page_id").select("verdict").collect()
    assert url_filter.judge(df.where("false"), rules).count() == 0
    every = len([r for r in rules if not r.tokens])
    assert url_filter.judge(df, rules).agg(F.max("n_candidates")).first()[0] <= every + 4


def test_url_patterns_find_every_match(spark):
    """Singular hosts too: each verdict is that of the patterns run on every URL."""
    hosts = [f"{a}-pill{s}{end}" for a in ("cheap", "buy", "online") for s in ("", "s", "sx") for end in (".example.com", "-x.net")]
    urls = [f"http://{h}/x" for h in hosts] + ["https://www.Buy-Pill.example.com/", "http://pill.example.com/buy-pill.x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.pattern_rule, r.verdict) for r in url_filter.judge(df, list(url_filter.PATTERNS)).collect()}
    matches = [re.search(r"^([^/]*[.-])?(cheap|buy|online)-pills?[.-]", u.lower().partition("://")[2]) for u in urls]
    assert got == {i: ("pill shop", "block") if m else (None, "allow") for i, m in enumerate(matches)}
    assert sum(map(bool, matches)) == 13


def test_url_patterns_are_fetched_by_tokens(spark):
    assert all(r.tokens for r in url_filter.PATTERNS)
    hit = [("http://a.xxx-b.com/", "adult"), ("http://porn.x/", "adult"), ("http://free-prize.x/", "click bait"), ("http://a.win-prizes-b.x/", "click bait"), ("http://win-money.x/", "click bait")]
    hit += [(f"http://x.org/a/{w}.{end}?q", "tracker") for w in ("click", "track") for end in ("php", "cgi")]
    miss = ["http://example.org/en/1", "http://x.org/aclick.php", "http://freeprize.x/", "http://pornx.org/"]
    df = spark.createDataFrame([*hit, *((u, None) for u in miss)], "url string, want string").withColumn("page_id", F.col("want"))
    rows = url_filter.judge(df, list(url_filter.PATTERNS)).collect()
    assert [(r.page_id, r.verdict) for r in rows] == [(r.pattern_rule, "block" if r.pattern_rule else "allow") for r in rows]
    assert sum(r.n_candidates for r in rows if r.path == "/en/1") == 0


# ---- 6 and 10 tokens


def test_token_counts(docs, texts, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = {r.doc_id: r for r in token_count.token_counts(docs, VOCABULARY).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in rows.items()} == {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}
    small = token_count.token_counts(odd, VOCABULARY, batch_bytes=64, piece_bytes=50).collect()
    assert [r.n_tokens for r in small] == [len(t.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    assert token_count.token_counts(empty, VOCABULARY).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    e = WordEncoder(VOCABULARY, list, max_words=40)
    chain = lambda values: list(itertools.chain.from_iterable(values))
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "É", "ß", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", ".", ",", "###", " ", "\n", "\x1c", "\xa0", "3", "İ", "Σ", "e\u0301", "漢", "ﬁ", "_", "|", "<"]
    for _ in range(300):
        x = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert e.texts([x.encode()], chain)[0] == t.encode(x, add_special_tokens=False).ids, repr(x)
    assert b"".join(pieces(b"ab cd  efg h", 3)) == b"ab cd  efg h" and len(pieces(b"abcdef", 2)) == 1


def encoded(texts, end_id=2, **sizes):
    """What the operator makes of (doc_id, text) rows, without Spark: n_tokens, before, ids."""

    class Docs:
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    out = [r for b in token_output.encode_ids(Docs, VOCABULARY, end_id, **sizes)(iter([rows])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    return [(r["n_tokens"], r["before"], r["ids"]) for r in out]


def in_library(texts, end_id=2):
    from tokenizers import Tokenizer

    t, out, before = Tokenizer.from_file(VOCABULARY), [], 0
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        out.append((len(ids), before, ids))
        before += len(ids)
    return out


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    """Capitals and marks make no new words for the library: the cache has the words and the runs of marks."""
    monkeypatch.setattr(token_output, "_ENCODERS", {})
    marks = ["", ",", ".", "!?", "###", "...", "(", ")"]
    forms = [a + w + b for a in marks for w in ("some", "Some", "SOME", "\u00e9t\u00e9", "other", "oTHER") for b in marks]
    texts = [" ".join(forms[i::7]) for i in range(7)]
    assert encoded(texts) == in_library(texts)
    assert set(token_output._ENCODERS[VOCABULARY].words) == {w.encode() for w in ["some", "other", "\u00e9t\u00e9", *marks[1:]]}


def test_token_ids_equal_the_library(monkeypatch):
    """Letters that compose only in lower case, special tokens, contractions, other white space; texts cut into pieces, a cache that overflows."""
    monkeypatch.setattr(token_output, "_ENCODERS", {})
    token_output._encoder(VOCABULARY).max_words = 40
    rng = random.Random(10)
    alphabet = ["a", "B", "H\u0331", "\u0331", "E\u0301", "\u00c9", "\u00df", "\u1e9e", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", ".", ",", "###", " ", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "3", "\u00b2", "\u0130", "\u03a3", "\u6f22", "\ufb01", "_", "|", "<", "\u00aa", "\u00b5", "\u01c5", "\u0149", "\u024f", "\u0250", "the", "The", "\x00", "\U0001f600", "\u00ad"]
    texts = [None, "", " ", *("".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000))]
    assert encoded(texts, batch_bytes=5000, piece_bytes=50) == in_library(texts)
    assert encoded(texts[:50], None, batch_bytes=64, piece_bytes=20) == in_library(texts[:50], None)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, texts, tmp_path, encoding):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    path = token_output.write_token_ids(docs.repartition(3), f"file://{tmp_path}/ids", VOCABULARY, 2, encoding=encoding)
    want, start = {}, 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    rows = token_output.read_token_ids(spark, path, "crc").collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == {i: w[:3] for i, w in want.items()}
    assert {r.doc_id: r.ids for r in token_output.read_token_ids(spark, path).collect()} == {i: w[3] for i, w in want.items()}
    plan = token_output.read_token_ids(spark, path, "none")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    import pyarrow.parquet as pq

    files = sorted(tmp_path.glob("ids/tokens/part-*"))
    order = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert order == sorted(texts)
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(3)
    assert column.has_offset_index and (("RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings) if encoding == "dictionary" else "DELTA_BINARY_PACKED" in column.encodings)


def test_one_document_opens_one_row_group(spark, tmp_path):
    """A filter on doc_id reaches the files: their statistics leave one row group of one file."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words "), F.col("id").cast("string"), F.lit(" ")), 20).alias("text"))
    path = token_output.write_token_ids(docs, f"file://{tmp_path}/ids", VOCABULARY, files=4, row_group_bytes=8 << 10, page_bytes=2 << 10)
    import pyarrow.parquet as pq

    meta = [pq.ParquetFile(f).metadata for f in tmp_path.glob("ids/tokens/part-*")]
    ids = [m.row_group(k).column(0).statistics for m in meta for k in range(m.num_row_groups)]
    assert len(meta) == 4 and len(ids) >= 12 and sum(c.min <= 4321 <= c.max for c in ids) == 1
    every = {r.doc_id: (r.start, r.ids) for r in token_output.read_token_ids(spark, path).collect()}
    one = token_output.read_token_ids(spark, path).where("doc_id = 4321")
    assert [(r.start, r.ids) for r in one.collect()] == [every[4321]]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,4321)" in plan and "Window" not in plan
    assert "EqualTo(doc_id,4321)" in token_output.read_token_ids(spark, path, "crc", F.col("doc_id") == 4321)._jdf.queryExecution().executedPlan().toString()


def test_vocabularies_that_do_not_fit_are_left_to_the_library(docs, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert not WordEncoder(path, len).by_words and WordEncoder(VOCABULARY, len).by_words
    for rows in (docs, odd):
        got = sorted((r.n_bytes, r.n_tokens) for r in token_count.token_counts(rows, path, batch_bytes=999, piece_bytes=50).collect())
        assert got == sorted((len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())


def test_token_files_odd(spark, odd, empty, tmp_path):
    rows = token_output.read_token_ids(spark, token_output.write_token_ids(odd, f"file://{tmp_path}/a", VOCABULARY), "crc").orderBy("start").collect()
    assert len(rows) == 12 and [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda i: (i is not None, i))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert token_output.read_token_ids(spark, token_output.write_token_ids(empty, f"file://{tmp_path}/b", VOCABULARY), "crc").count() == 0


# ---- 7 decontamination


def brute_matches(items, text, least=0.8):
    words = (text or "").encode().lower().split()
    out = set()
    for item, item_text in items:
        own = (item_text or "").encode().lower().split()
        w = min(5, len(own))
        if not own or len(words) < w:
            continue
        n = min(len(own), len(words))
        a = Counter(tuple(own[i : i + w]) for i in range(len(own) - w + 1))
        for s in range(len(words) - n + 1):
            b = Counter(tuple(words[i : i + w]) for i in range(s, s + n - w + 1))
            both = (a & b).total()
            if both / (a.total() + b.total() - both) >= least:
                out.add(item)
                break
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate((1, 3, 5, 8, 20, 40, 60))] + [(7, None), (8, ""), (None, "w1 w2"), (9, "W1 w1")]
    rows = []
    for d in range(60):
        words = []
        for _ in range(4):
            words += rng.choices(vocabulary, k=rng.randint(0, 25))
            part = items[rng.randrange(7)][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else "\n".join(words), "extra"))
    rows += [(60, None, ""), (61, "", ""), (None, items[4][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, _ in rows for i in brute_matches([x for x in items if x[0] is not None], t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, index_bytes=1000).collect()} == want
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    assert decontaminate.matches(docs.where("false"), bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0


def test_decontamination_by_a_large_benchmark():
    """20,000 items: every window as similar as asked is found, few others are verified."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 80)))) for i in range(20_000)]
    index = decontaminate.Index(items)
    assert sum(len(g.members) for g in index.widths[5][2].values()) == 20_000
    by_word = {}
    for i, t in items:
        for w in set(t.split()):
            by_word.setdefault(w, []).append(i)
    for d in range(40):
        words = rng.choices(vocabulary, k=60)
        own = items[rng.randrange(20_000)][1].split()
        for _ in range(d % 4):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        text = " ".join(words[:30] + own + words[30:])
        near = Counter(i for w in set(own) for i in by_word[w]).most_common(5)
        want = brute_matches([items[i] for i, _ in near], text)
        assert {j for i, *_ in index.search(text.encode(), 0.8) for j in index.ids[i]} == want
    prints = np.random.default_rng(0).integers(0, 1 << 64, (200, 2), np.uint64)
    assert sum(1 for g in index.widths[5][2].values() for _ in g.near(prints, index.radius)) <= 20  # of 4,000,000 pairs


# ---- 8 licences


def plain_notices(model, text):
    """Anchored lines and wrapped runs of them by the model's and the templates' own arithmetic."""
    if text is None:
        return []
    lines = text.split("\n")
    anchored = [i for i, x in enumerate(lines) if re.search(license_scan.ANCHOR_PATTERN, x)]
    runs = []
    for i in anchored:
        if runs and i - runs[-1][1] <= 3 and all(x.strip(" \t\r\v\f") for x in lines[runs[-1][1] + 1 : i + 1]):
            runs[-1][1] = i
        else:
            runs.append([i, i])

    def judge(first, last):
        x = " ".join(lines[first : last + 1])
        p = model.probabilities(x)
        best = int(p[:-1].argmax())
        family = model.families[best] if p[best] >= model.threshold else "unknown"
        alike = 0.0 if family == "unknown" else license_scan.template_similarity(x, family)
        return first, last - first + 1, family, round(p[best] if family != "unknown" else p[-1], 9), round(alike, 9), alike >= license_scan.SIMILARITY

    out = []
    for first, last in runs:
        own = [judge(i, i) for i in anchored if first <= i <= last]
        whole = judge(first, last)
        out += [whole] if last > first and whole[5] and not any(x[5] for x in own) else own
    return out


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}


def test_licences(spark, sf_dir, odd, empty, texts):
    model = license_scan.train()
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "He renewed his driving license in May.", "Der Hund kommt mit.", "", "Licensed under a private agreement of the two parties.", "", "GPLv3"]
    rows = [(1, "\n".join(lines)), (2, None), (3, "plain"), *((10 + k, f"first\n\n{t}\n\nlast words") for k, t in enumerate(WRAPPED.values()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    found = {n.paragraph: n for n in got[1].notices}
    assert [found[i].family for i in (0, 1, 2, 3, 4, 10)] == ["MIT", "CC-BY-NC", "GPL", "Apache-2.0", "proprietary", "GPL"] and all(found[i].confirmed for i in (0, 1, 2, 3, 4, 10))
    assert not any(n.confirmed for i, n in found.items() if 4 < i < 10) and 6 not in found
    assert got[2].notices == [] and got[2].n_paragraphs == 0 and got[3].notices == []
    assert [{n.family for n in got[10 + k].notices if n.confirmed} for k in range(4)] == [{f} for f in WRAPPED]
    plain = lambda notices: [(n.paragraph, n.n_lines, n.family, round(n.probability, 9), round(n.similarity, 9), n.confirmed) for n in notices]
    assert {i: plain(r.notices) for i, r in got.items()} == {i: plain_notices(model, t) for i, t in rows}
    table = {r.doc_id: plain(r.notices) for r in license_scan.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert table == {i: plain_notices(model, t) for i, t in texts.items()} and sum(map(bool, table.values())) > 5
    assert sorted(map(plain, (r.notices for r in license_scan.scan_licenses(odd).collect()))) == sorted(plain_notices(model, r.text) for r in odd.collect())
    assert license_scan.scan_licenses(empty).count() == 0


def test_licence_templates_are_held_out():
    """The templates, which the classifier doesn't learn from, are named rightly nine times in ten; other uses of the words are not."""
    model = license_scan.train()
    right = wrong = every = 0
    for family, notices in license_scan.TEMPLATES.items():
        for x in notices:
            p = model.probabilities(x)
            named = p[:-1].max() >= model.threshold
            every, right, wrong = every + 1, right + (named and model.families[p[:-1].argmax()] == family), wrong + (named and model.families[p[:-1].argmax()] != family)
    assert right >= 0.9 * every and wrong <= 0.02 * every


# ---- 9 quality


def plain_measures(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, win in enumerate(windows) if count[win] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered))


def test_measures(docs, texts, odd, empty):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in quality_rules.measures(docs).collect()}
    assert got == {i: plain_measures(t) for i, t in texts.items()}
    assert sorted(tuple(r[c] for c in columns) for r in quality_rules.measures(odd).collect()) == sorted(plain_measures(r.text) for r in odd.collect())
    assert quality_rules.measures(empty).count() == 0


def test_cutoffs_are_safe(spark):
    import math

    for k, n, p in ((0, 50, 0.05), (4, 80, 0.1), (30, 90, 0.3), (9, 10, 0.5), (10, 10, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)
    base = "doc_id long, stratum string, n_words long, n_repeat_words long, " + ", ".join(f"{r} double" for r in quality_rules.GRIDS)
    rows = [(i, "a" if i % 2 else None, 100, 0, 0.6 if i % 10 == 0 else 0.0, 0.0, 0.0, 0.0, 0.0, 5.0) for i in range(20_000)]
    measured = spark.createDataFrame(rows, base)
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(20_000)] + [(None, 1), (1, None), (99_999, 0)], "doc_id long, quality int")
    cutoffs = quality_rules.choose_cutoffs(measured, labels)
    chosen = {(c.stratum, c.rule): c for c in cutoffs}
    assert chosen[(None, "symbol_ratio")].cutoff == 0.5 and chosen[(None, "symbol_ratio")].bad_rejected == 2000
    assert chosen[(None, "upper_ratio")].cutoff is None and chosen[("a", "symbol_ratio")].cutoff is None
    kept = quality_rules.apply_cutoffs(measured, cutoffs)
    assert kept.where("NOT kept").count() == 2000 and quality_rules.apply_cutoffs(measured, []).where("NOT kept").count() == 0
    other = measured.withColumn("stratum", F.lit("no labels"))  # nothing is known of it, so nothing more is rejected
    assert quality_rules.apply_cutoffs(other, cutoffs).where("NOT kept").count() == 0
    few = quality_rules.choose_cutoffs(measured, labels.limit(100))
    assert all(c.cutoff is None for c in few)
    assert quality_rules.choose_cutoffs(measured.where("false"), labels) == []


def test_cutoffs_equal_their_sql(spark):
    """Limits so loose that cutoffs are chosen on the table: measures, choice and verdicts by SQL."""
    sf_dir = "/root/testdata/sf0.01"
    measured = materialize(quality_rules.measures(spark.read.parquet(f"{sf_dir}/documents.parquet"), stratum_col="lang"), "measures")
    cutoffs = quality_rules.choose_cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), false_rejection=0.9, error=0.9)
    assert len([c for c in cutoffs if c.cutoff is not None]) > 3
    rows = quality_rules.apply_cutoffs(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
    assert rows_of(rows) == rows_in_sql(connection(sf_dir), queries.op9_sql(0.9, 0.9))
    assert rows.where("NOT kept AND NOT base_failed").count() > 10


def test_quality_odd(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 1), (None, 0)], "doc_id long, quality int")
    measured = materialize(quality_rules.measures(odd, stratum_col="lang"), "measures")
    rows = quality_rules.apply_cutoffs(measured, quality_rules.choose_cutoffs(measured, labels)).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows if r.kept} == set()
    assert quality_rules.choose_cutoffs(measured.where("false"), labels) == [] and quality_rules.measures(empty).count() == 0
