"""SimHash near-duplicates: Golay-code keys propose pairs, the fingerprints decide, components group.

A fingerprint has four 16-bit segments. If two differ in at most three bits, one segment is
equal, and of the two 24-bit halves of the other 48 bits one differs in at most one bit. So
for each of the eight (segment, half) choices a fingerprint is filed under its exact segment
with each Golay key of the half: some bucket holds both. Every pair that meets in a bucket
is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import golay
from textloom.llm.common import materialize, unsigned_hex
from textloom.llm.components import connected_components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of width words, space-joined; of the whole sequence if it is shorter; none for none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((h(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(words) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """Each bit is 1 if set in over half the hashes; of none: 0."""
    if not len(hashes):
        return 0
    octets = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; texts are read whole, A-Z lower-cased, words are parted by ASCII white space.

    A null or wordless text has fingerprint 0. One text at a time is in memory. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = (simhash(shingle_hashes((t.as_py() or b"").lower().split(), width)) for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.fromiter(fps, np.uint64, batch.num_rows).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, bucket key) for every bucket of every fingerprint: 8 to 48 of them."""
    seg = [(fps >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    at, keys = [], []
    for a in range(4):
        rest = [seg[k] for k in range(4) if k != a]
        long48 = rest[0] | rest[1] << np.uint64(16) | rest[2] << np.uint64(32)
        for half in range(2):
            word = (long48 >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)
            i, code = golay.keys(word.astype(np.uint32))
            at.append(i)
            keys.append(np.uint64(2 * a + half) << np.uint64(28) | seg[a][i] << np.uint64(12) | code.astype(np.uint64))
    return np.concatenate(at), np.concatenate(keys).view(np.int64)


class _Forest:
    """Union-find over fingerprints; emits as many edges as it made unions."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> pa.RecordBatch:
        a = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([self.root(x) for x in a], pa.int64())], ["a", "b"])


def _link_group(fps: np.ndarray, distance: int, forest: _Forest) -> None:
    """Link all fingerprints of one bucket that are within distance, comparing only what isn't linked yet.

    Cheap passes over sorted masked values link most of a cluster; then each remaining small
    component is compared with everything else, so the work is (rows outside the largest
    component) x (rows), exact for any input.
    """
    fps = np.unique(fps)
    signed = fps.view(np.int64).tolist()
    n = len(fps)
    if n > 32:
        for block in range(16):
            masked = fps & ~(np.uint64(0xF) << np.uint64(4 * block))
            order = np.argsort(masked, kind="stable")
            x, y = order[:-1], order[1:]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= distance
            for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                forest.link(signed[i], signed[j])
    roots = np.array([forest.root(x) for x in signed], np.int64)
    values, inverse, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    if len(values) == 1:
        return
    done = np.zeros(n, bool)
    done[inverse == sizes.argmax()] = n > 2
    for c in np.argsort(sizes, kind="stable").tolist():
        for i in np.flatnonzero((inverse == c) & ~done).tolist():
            near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= distance) & (inverse != c))
            for j in near.tolist():
                forest.link(signed[i], signed[j])


def _links(distance: int, key_columns: int):
    """mapInArrow over rows sorted by their key columns, the fingerprint last: a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held = np.zeros((0, key_columns + 1), np.int64)

        def groups(rows: np.ndarray) -> None:
            change = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, change], np.r_[change, len(rows)]
            fps = np.ascontiguousarray(rows[:, -1]).view(np.uint64)
            size = ends - starts
            for lag in (1, 2, 3):  # groups of up to four, all at once
                same = np.flatnonzero(np.repeat(size <= 4, size)[lag:] & (np.repeat(np.arange(len(size)), size)[lag:] == np.repeat(np.arange(len(size)), size)[:-lag]))
                near = same[np.bitwise_count(fps[same] ^ fps[same + lag]) <= distance]
                for i, j in zip(rows[near, -1].tolist(), rows[near + lag, -1].tolist(), strict=True):
                    forest.link(i, j)
            for k in np.flatnonzero(size > 4).tolist():
                _link_group(fps[starts[k] : ends[k]], distance, forest)

        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            last = np.flatnonzero((rows[:, :-1] != rows[-1, :-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                groups(rows[:cut])
            held = rows[cut:]
            if len(forest.up) > 1_000_000:
                yield forest.edges()
                forest = _Forest()
        if len(held):
            groups(held)
        yield forest.edges()

    return run


def links(fps: DataFrame, distance: int = 3, block: int = 4096) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) linked by chains of near pairs.

    Buckets with over block rows are dealt to units of two salt blocks each, every two blocks
    meeting in one unit, so that no task gets a whole bucket and no pair is lost.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the segments guarantee distances up to 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, keys = bucket_keys(f)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[at].view(np.int64))], ["key", "fp"])

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long")
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")), "hot-buckets")
    salted = keyed.join(hot, "key", "left").withColumn("salt", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(0))
    units = salted.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    units = units.select("key", F.least("salt", "other").cast("long").alias("i"), F.greatest("salt", "other").cast("long").alias("j"), "fp")
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(_links(distance, 3), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    component_id is the smallest id among all documents reachable through fingerprints that
    differ in at most distance bits. Equal fingerprints are one node, so a group of copies
    costs one row from the first aggregation on. Null and wordless texts have fingerprint 0
    and are linked like any other; a null id stays null and never becomes a component_id
    unless the component has no other; repeated rows give repeated results; an empty table
    gives none; other columns are never read.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialize(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(links(nodes, distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    label = materialize(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return docs_fp.join(label, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
