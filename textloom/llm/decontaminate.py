"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, then exact similarity.

A document's windows have the word counts of the benchmark's items. Of a window that is as
similar to an item as asked, a known number of shingles must be the item's; windows with fewer
shingles of the benchmark as a whole are passed over, which skips work, never a match. The
128-bit fingerprints of the others go through a multi-index by item length: the bits are cut
into blocks, and if two fingerprints differ in at most radius bits, one block differs in at
most radius // blocks. A block's table holds its distinct values (65,536 at most, however many
items there are) with the items of each; all values that near to the window's are fetched, so
every item within the radius is found. Those are verified by the weighted Jaccard similarity
of their shingles, a shingle's weight being the number of times it occurs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import tidy
from textloom.llm.simhash import shingle_hashes

#: Bytes of the index for each word and each item, with some to spare.
_WORD_BYTES, _ITEM_BYTES = 32, 256


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _halves(hashes: np.ndarray) -> np.ndarray:
    """128 bits for each hash: itself and a mix of it."""
    other = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack((hashes, other ^ other >> np.uint64(32)), axis=1)


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, span: int, slab: int = 2048) -> np.ndarray:
    """128-bit SimHash, two words a row, of hashes[s : s + span] for each start (ascending): a bit is 1 if set in over half."""
    out = np.zeros((len(starts), 2), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + slab, "left"))
        low = int(starts[i])
        octets = np.ascontiguousarray(_halves(hashes[low : int(starts[j - 1]) + span])).astype("<u8", copy=False).view(np.uint8)
        votes = np.zeros((len(octets) + 1, 128), np.int32)
        np.cumsum(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.int32, out=votes[1:])
        at = starts[i:j] - low
        out[i:j] = np.packbits((votes[at + span] - votes[at]) * 2 > span, axis=1, bitorder="little").view("<u8")
        i = j
    return out


class Group:
    """The items of one length: fingerprints, and for each block its distinct values and which of them an item has."""

    def __init__(self, members: list[int], prints: np.ndarray, blocks: int):
        self.members, self.prints = np.array(members), prints
        cut = np.ascontiguousarray(prints).astype("<u8", copy=False).view(f"<u{16 // blocks}")
        self.tables = [np.unique(cut[:, k], return_inverse=True) for k in range(blocks)]

    def near(self, prints: np.ndarray, radius: int, slab: int = 128) -> Iterator[tuple[int, int]]:
        """(row of prints, item) of every pair within the radius."""
        each = radius // len(self.tables)
        cut = np.ascontiguousarray(prints).astype("<u8", copy=False).view(self.tables[0][0].dtype)
        for i in range(0, len(prints), slab):
            hit = np.zeros((len(prints[i : i + slab]), len(self.members)), bool)
            for k, (values, of) in enumerate(self.tables):
                hit |= (np.bitwise_count(cut[i : i + slab, k, None] ^ values) <= each)[:, of]
            rows, items = np.nonzero(hit)
            apart = np.bitwise_count(prints[i + rows] ^ self.prints[items]).sum(axis=1, dtype=np.int64)
            keep = apart <= radius
            yield from zip((i + rows[keep]).tolist(), self.members[items[keep]].tolist(), strict=True)


class Index:
    """The benchmark's items in arrays: shingles with counts by item, and by shingle width the known shingles and groups."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = 5, radius: int = 36, blocks: int = 8):
        self.radius = radius
        by_text: dict[tuple[bytes, ...], list[int]] = {}
        for item_id, text in items:
            words = tuple(_words((text or "").encode()))
            if words and item_id is not None:
                by_text.setdefault(words, []).append(item_id)
        self.ids: list[list[int]] = []
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        grouped: dict[int, dict[int, list[int]]] = {}
        hashed: dict[int, list[np.ndarray]] = {}
        prints = []
        for words, ids in sorted(by_text.items()):
            w = min(width, len(words))
            hashes = shingle_hashes(list(words), w)
            grouped.setdefault(w, {}).setdefault(len(words), []).append(len(self.ids))
            hashed.setdefault(w, []).append(hashes)
            self.ids.append(sorted(ids))
            self.shingles.append(np.unique(hashes, return_counts=True))
            prints.append(window_fingerprints(hashes, np.zeros(1, np.int64), len(hashes))[0])
        #: shingle width -> (sorted known shingles, 16 bits or more of a bitmap for each, {length: group})
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, dict[int, Group]]] = {}
        for w, lengths in grouped.items():
            known = np.unique(np.concatenate(hashed[w]))
            bitmap = np.zeros(1 << max(10, (16 * len(known)).bit_length() - 3), np.uint8)
            np.bitwise_or.at(bitmap, *self._bit(known, bitmap))
            self.widths[w] = known, bitmap, {n: Group(m, np.stack([prints[i] for i in m]), blocks) for n, m in lengths.items()}

    @staticmethod
    def _bit(hashes: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(3) & np.uint64(len(bitmap) - 1)).astype(np.int64), np.uint8(1) << (hashes & np.uint64(7)).astype(np.uint8)

    def known(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Whether each shingle occurs in the benchmark."""
        known, bitmap, _ = self.widths[width]
        at, bit = self._bit(hashes, bitmap)
        maybe = np.flatnonzero(bitmap[at] & bit)
        out = np.zeros(len(hashes), bool)
        out[maybe] = known[np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)] == hashes[maybe]
        return out

    def similarity(self, window: tuple[np.ndarray, np.ndarray], item: int) -> float:
        """Weighted Jaccard similarity of (shingles in order, counts) to an item's."""
        (a, n), (b, m) = window, self.shingles[item]
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], m[j]).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)

    def search(self, text: bytes | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that reaches least."""
        words = _words(text)
        best: dict[int, tuple[float, int, int]] = {}
        for width, (_, _, groups) in self.widths.items():
            if len(words) < width:
                continue
            hashes = shingle_hashes(words, width)
            inside = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.known(hashes, width))))
            if not inside[-1]:
                continue
            for length, group in groups.items():
                span = min(length, len(words)) - width + 1  # shingles of a window; a shorter text is one window
                need = max(1, least * (span + length - width + 1) / (1 + least) - 1e-9)
                if inside[-1] < need:
                    continue
                starts = np.flatnonzero(inside[span:] - inside[:-span] >= need)
                if not len(starts):
                    continue
                windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for row, item in group.near(window_fingerprints(hashes, starts, span), self.radius):
                    start = int(starts[row])
                    if start not in windows:
                        windows = {start: np.unique(hashes[start : start + span], return_counts=True)}
                    value = self.similarity(windows[start], item)
                    if value >= least and (item not in best or (-value, start) < (-best[item][0], best[item][1])):
                        best[item] = (value, start, span + width - 1)
        return [(i, *best[i]) for i in sorted(best)]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    width: int = 5,
    radius: int = 36,
    blocks: int = 8,
    index_bytes: int = 128 << 20,
) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each item that some window of a document repeats.

    Words are parted by ASCII white space, A-Z lower-cased; an item of fewer than width words
    is one shingle. The window reported is the most similar, the first of equals; n_words is
    its length. Fingerprints of windows as similar as 0.8 differ in about 19 of 128 bits, 4
    bits more or less: radius 36 leaves out none but by a chance of about one in 30,000.

    The benchmark is a query set: its index goes to every task as one broadcast, and the
    documents are read once and never move. Its size is checked: items beyond index_bytes of
    index (about a third of a million words a 10 MB) make further indexes, each with a pass
    of its own. A document is searched in one piece, with memory in proportion to it. Null or
    wordless texts and items, and items without an id, match nothing; a null doc_id stays
    null; a repeated row repeats its matches, items of equal text all match; empty tables
    give no rows; other columns are never read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, index_bytes, width, radius, blocks):
        found = narrow.mapInArrow(tidy(_searcher(index, similarity)), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, index_bytes: int, *form: int) -> Iterator:
    """Broadcast indexes of bounded size, at least one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    part, held, some = [], 0, False
    for r in items.toLocalIterator():
        size = _WORD_BYTES * (r["text"].count(" ") + 1) + _ITEM_BYTES + len(r["text"].encode())
        if part and held + size > index_bytes:
            yield benchmark.sparkSession.sparkContext.broadcast(Index(part, *form))
            part, held, some = [], 0, True
        part.append((r["item"], r["text"]))
        held += size
    if part or not some:
        yield benchmark.sparkSession.sparkContext.broadcast(Index(part, *form))


def _searcher(index, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = index.value.ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, value, start, n in index.value.search(text.as_py(), similarity):
                    rows += [(doc_id, item, value, start, n) for item in ids[i]]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    width: int = 5,
    radius: int = 36,
    blocks: int = 8,
    index_bytes: int = 128 << 20,
) -> DataFrame:
    """docs without the documents that repeat a benchmark item (see matches); all columns stay as they are.

    The verdict is a function of the text, so rows are judged where they are and nothing is
    shuffled: a flag is computed and filtered on.
    """
    out = docs
    for index in _indexes(benchmark, item_col, item_text_col, index_bytes, width, radius, blocks):
        out = out.where(~_flag(index, similarity)(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    return out


def _flag(index, similarity: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([bool(index.value.search(t.as_py(), similarity)) for t in texts], pa.bool_())

    return F.arrow_udf(tidy(run), "boolean")
