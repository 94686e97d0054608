"""Near-duplicate texts against all pairs of shingle sets."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from textloom.llm import near_texts, simhash

from test_operators import odd  # noqa: F401


def brute(texts, least=0.8):
    """Smallest id of the component of each id."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode().lower().split(), 5).tolist()) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both >= least * either - 1e-9:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in texts}


def edited(seed, n_docs=60):
    """Texts with copies in which every few dozenth word differs: similarities on both sides of 0.8."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    out = []
    for _ in range(n_docs):
        base = rnd.choices(words, k=rnd.randrange(40, 400))
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            changed = list(base)
            for k in range(rnd.randrange(20), len(base), rnd.choice((30, 45, 50, 60, 90))):
                changed[k] = rnd.choice(words)
            out.append(" ".join(changed))
    rnd.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("options", [{}, {"block": 3, "unit_bytes": 4096}])
def test_links_equal_all_pairs(spark, options):
    texts = edited(1) | {1000 + k: t for k, t in enumerate(["", None, "a b", "a  B", "a b c"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_texts.near_texts(docs, **options).collect()} == brute(texts)


def test_keys_of_similar_texts_meet():
    """Pairs at similarity 0.8 share a key and are within the radius; unlike ones hardly ever."""
    rng = np.random.default_rng(3)
    met, near, unlike = 0, 0, 0
    for _ in range(400):
        both = rng.integers(0, 1 << 64, 320, np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 64, 40, np.uint64)]) for _ in range(2))
        margins = np.stack([near_texts.votes(a), near_texts.votes(b), near_texts.votes(rng.integers(0, 1 << 64, 400, np.uint64))])
        keys, n = near_texts.file_keys(margins)
        own = [set(x.tolist()) for x in np.split(keys, np.cumsum(n)[:-1])]
        met += bool(own[0] & own[1])
        unlike += bool(own[0] & own[2])
        near += ((margins[0, -128:] > 0) != (margins[1, -128:] > 0)).sum() <= near_texts.RADIUS
    assert met >= 398 and near >= 398 and unlike <= 4


def test_an_id_with_two_texts(spark, sf_dir):
    """A copy goes with its group although its id names the first text of another one."""
    texts = [" ".join(f"{w}{k}" for k in range(100)) for w in "ab"]
    docs = spark.createDataFrame([(1, texts[0]), (5, texts[1]), (5, texts[0]), (7, texts[1]), (5, texts[1])], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, sf_dir).collect())) == [(1, texts[0]), (5, texts[1])]


def test_pipeline_stage_drops_copies_at_eighty_percent(spark, sf_dir):
    base = [f"word{k}" for k in range(300)]
    near, far = list(base), list(base)
    near[10::50], far[10::15] = ["x"] * 6, ["y"] * 20
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate((base, near, far))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()) == [0, 2]


def test_odd(spark, odd):  # noqa: F811
    rows = near_texts.near_texts(odd).collect()
    assert len(rows) == odd.count() and near_texts.near_texts(odd.where("false")).count() == 0
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got[1] == got[2] == got[3] == 1 and got[6] == 6 and got[5] == 5


def test_pipeline_stage_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()} == set(groups.values())
