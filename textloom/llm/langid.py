"""Language identification in two levels: the family first, then one-versus-one linear SVMs inside it."""

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_names, tidy

UNDETERMINED = "und"

#: Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "austronesian": "id jv ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BUCKETS = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is in one of Unicode's letter categories; digits, fractions and number letters are not."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _LETTER.finditer(text))


def gram_slabs(text: bytes, slab: int = 1 << 16) -> Iterator[np.ndarray]:
    """Bucket of every 1-, 2- and 3-gram of the lower-cased text's bytes; runs of other than letters are one blank.

    A slab of positions at a time, so that the buckets of a long text are never held together.
    """
    low = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()) + b" "
    for i in range(0, len(low), slab):
        b = np.frombuffer(low, np.uint8, min(slab + 2, len(low) - i), i).astype(np.int32)
        one, two = b[:slab], (b[:-1] * 40503 + b[1:] * 34283 + 17)[:slab]
        three = two[: max(0, len(b) - 2)] * 31 + b[2:] * 49843 + 91
        yield np.concatenate((one, two & (BUCKETS - 1), (three ^ three >> 13) & (BUCKETS - 1)))


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in order, their counts) of a text."""
    total = np.zeros(BUCKETS, np.int64)
    for at in gram_slabs(text):
        total += np.bincount(at, minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


@dataclass
class Model:
    """weights: one column for each classifier, families first, then the pairs of languages within a family."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steep: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.families or not text or not has_letter(text.decode("utf-8", "replace")):
            return UNDETERMINED, 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in gram_slabs(text):
            total += self.weights[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        margin = (total / n + self.bias) * self.steep
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        share = p[: len(self.families)] / max(p[: len(self.families)].sum(), 1e-300) if len(self.families) > 1 else np.ones(1)
        best = int(share.argmax())
        family = self.families[best]
        langs = self.languages[family]
        votes = dict.fromkeys(langs, 0.0)
        for k, (_, x, y) in ((k, v) for k, v in enumerate(self.pairs) if v[0] == family):
            q = float(p[len(self.families) + k])
            votes[x] += q
            votes[y] += 1 - q
        pairs = len(langs) * (len(langs) - 1) / 2
        lang = max(langs, key=lambda v: votes[v])
        inside = votes[lang] / (len(langs) - 1) if pairs else 1.0
        return lang, float(min(1.0, max(0.0, share[best] * inside)))


def _linear(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> tuple[np.ndarray, float, float]:
    """L2-regularised squared-hinge SVM by accelerated gradient steps, classes weighted alike; then a slope for probabilities."""
    n = len(y)
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    xb = np.hstack((x, np.ones((n, 1), np.float32)))
    v = np.full(xb.shape[1], xb.shape[1] ** -0.5, np.float32)
    for _ in range(20):  # the largest curvature of the loss
        u = xb.T @ (share * (xb @ v))
        v = u / max(np.linalg.norm(u), 1e-12)
    step = np.float32(1 / (2 * c * float(v @ (xb.T @ (share * (xb @ v)))) + 1))
    w = z = np.zeros(xb.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ z))
        new = z - step * (z - np.float32(2 * c) * (xb.T @ (share * y * slack)))
        z, w = new + np.float32(k / (k + 3)) * (new - w), new
    m = y * (xb @ w)
    slopes = np.linspace(0.5, 20, 79)
    loss = [(share * np.logaddexp(0, -s * m)).sum() for s in slopes]
    return w[:-1], float(w[-1]), float(slopes[int(np.argmin(loss))])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], family_of: dict[str, str] | None = None, features: int = 2048) -> Model:
    """rows: (language, buckets, counts). Features are the buckets whose shares differ most between languages."""
    family_of = FAMILY_OF if family_of is None else family_of
    codes = sorted({r[0] for r in rows})
    languages: dict[str, list[str]] = {}
    for c in codes:
        languages.setdefault(family_of.get(c, c), []).append(c)
    families = sorted(languages)
    pairs = [(f, x, y) for f in families for i, x in enumerate(languages[f]) for y in languages[f][i + 1 :]]
    model = Model(families, languages, pairs)
    width = len(families) + len(pairs)
    model.weights, model.bias, model.steep = np.zeros((BUCKETS, width), np.float32), np.zeros(width), np.ones(width)
    if len(codes) < 2:
        return model
    mean = np.zeros((len(codes), BUCKETS))
    for lang, at, n in rows:
        mean[codes.index(lang), at] += n / n.sum()
    mean /= np.array([[sum(r[0] == c for r in rows)] for c in codes])
    scale = np.sqrt(mean.mean(axis=0) + 1e-6)
    chosen = np.argsort(-(mean.std(axis=0) / scale), kind="stable")[:features]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, at, n) in enumerate(rows):
        keep = place[at] >= 0
        x[i, place[at][keep]] = n[keep] / n.sum() / scale[at[keep]]
    norm = 1 / max(np.sqrt((x**2).sum(axis=1)).mean(), 1e-9)
    x *= norm
    lang = np.array([codes.index(r[0]) for r in rows])
    member = np.array([families.index(family_of.get(r[0], r[0])) for r in rows])
    for k in range(width):
        if k < len(families):
            if len(families) == 1:
                continue
            use, y = np.ones(len(rows), bool), np.where(member == k, 1.0, -1.0)
        else:
            _, a, b = pairs[k - len(families)]
            use = (lang == codes.index(a)) | (lang == codes.index(b))
            y = np.where(lang == codes.index(a), 1.0, -1.0)
        w, bias, steep = _linear(x[use], y[use])
        model.weights[chosen, k] = w * norm / scale[chosen]
        model.bias[k], model.steep[k] = bias, steep
    return model


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows_per_language: int = 1000, family_of: dict[str, str] | None = None) -> Model:
    """Fit on rows that aren't held out and have an id, a text and a language.

    The fit takes about max_rows_per_language rows of each language, picked by a hash of the
    id (all rows of a rarer language), and whole texts of those. Their gram counts, not
    their texts, come to the driver: at most BUCKETS numbers a row.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], {}, [])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1, max_rows_per_language / n)) + 1)).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for t in batch.column(0):
                u, c = gram_counts(t.as_py())
                at.append(u.astype(np.int32))
                n.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "at", "n"])

    sample = rows.where(draw < share).select("text", "lang").mapInArrow(run, "lang string, at array<int>, n array<int>").toArrow()
    found = [(lang, at.values.to_numpy(), n.values.to_numpy()) for lang, at, n in zip(sample.column(0).to_pylist(), sample.column(1), sample.column(2), strict=True)]
    return fit(sorted(found, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())), family_of)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns, without a shuffle; only the text is read by the prediction.

    und and 0 for a null text, a text without a letter (of a Unicode letter category), and
    where nothing was learned. Each text is read whole, its grams a slab at a time. Existing
    columns of the two names are replaced; all others stay.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    (both,) = free_names(docs, "_guess")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    guess = F.arrow_udf(tidy(run), "struct<lang: string, score: double>")
    out = docs.select(*kept, guess(F.col(text_col).cast("binary")).alias(both))
    return out.select(*kept, F.col(f"{both}.lang").alias(lang_out), F.col(f"{both}.score").alias(score_out))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: train on the rows not held out, then predict all.

    Repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return predict(narrow, model, "_text").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
