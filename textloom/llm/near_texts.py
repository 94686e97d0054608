"""Near-duplicate texts at any similarity: SimHash fingerprints of 512 bits, Golay keys propose, the shingle sets decide.

Texts whose shingle sets have similarity 0.8 differ in about 15 % of the bits of any SimHash,
too many for a fixed number of errors in a short fingerprint. So the fingerprint is long and
the decoding soft. 368 bits make sixteen 23-bit segments; each is decoded to the Golay
codewords nearest to it, a bit counting for as much as its vote was won by, so the bits that
a few other shingles can turn cost little. Two segments make a table: a text is filed under
the KEYS nearest pairs of codewords of each of the TABLES tables. The errors of a similar pair
can't lie in all tables' sure bits: at similarity 0.8 a pair shares no key of a table with a
chance of about 0.37, and none of all eight with one of 0.0004 (0.00001 at 0.85).

Texts that share a key and differ in at most RADIUS of the other 128 bits are candidates;
chains of candidates make families. In a family every pair is decided on its whole shingle
sets, whichever way it came to be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import golay
from textloom.llm.common import by_bytes, materialize, tidy
from textloom.llm.components import connected_components
from textloom.llm.simhash import SEED, _Forest, shingle_hashes

TABLES, KEYS, SEGMENT = 8, 10, 23
#: Of 128 bits: 19 differ on average at similarity 0.8, 4 more or less; of unlike texts 64, 6 more or less.
RADIUS = 40
_WORDS = 8
_STEP = (np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def votes(hashes: np.ndarray, slab: int = 255) -> np.ndarray:
    """For each of 512 directions, how many of the hashes are set there less how many are not."""
    total = np.zeros(64 * _WORDS, np.int64)
    for i in range(0, len(hashes), slab):
        x = hashes[i : i + slab] + _STEP
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x = np.ascontiguousarray((x ^ x >> np.uint64(31)).T).astype("<u8", copy=False)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * total - len(hashes)


def file_keys(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order of texts, number of them by text) for rows of 512 margins."""
    n = len(margins)
    code, cost = golay.soft_keys(margins[:, : 2 * TABLES * SEGMENT].reshape(-1, SEGMENT).astype(np.float32))
    code, cost = code.reshape(n, TABLES, 2, code.shape[1]).astype(np.int32), cost.reshape(n, TABLES, 2, code.shape[1])
    both = (cost[:, :, 0, :, None] + cost[:, :, 1, None, :]).reshape(n, TABLES, code.shape[3] ** 2)
    key = (code[:, :, 0, :, None] << 12 | code[:, :, 1, None, :]).reshape(n, TABLES, code.shape[3] ** 2) | np.arange(TABLES, dtype=np.int32)[None, :, None] << 24
    order = np.argsort(both, axis=2, kind="stable")[:, :, :KEYS]
    key, found = np.take_along_axis(key, order, axis=2), np.isfinite(np.take_along_axis(both, order, axis=2))
    return key[found], found.sum(axis=(1, 2))


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, slab: int = 64) -> DataFrame:
    """doc_id, hash (of the text), node (a hash of its words), n (shingles), c1, c2 (128 bits), keys for every row. No shuffle.

    A wordless text has no shingles and no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, slab):
                part = batch.slice(i, slab)
                nodes, sizes = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.int32)
                margins = np.zeros((part.num_rows, 64 * _WORDS), np.int64)
                for k, text in enumerate(part.column(2)):
                    words = _words(text)
                    own = np.unique(shingle_hashes(words, width))
                    nodes[k], sizes[k], margins[k] = xxhash.xxh64_intdigest(b" ".join(words), SEED), len(own), votes(own)
                keys, found = file_keys(margins[sizes > 0])
                number = np.zeros(part.num_rows, np.int64)
                number[sizes > 0] = found
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(number)], pa.int32()), pa.array(keys, pa.int32()))
                check = np.packbits(margins[:, -128:] > 0, axis=1, bitorder="little").view("<u8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _longs(nodes), pa.array(sizes), _longs(check[:, 0]), _longs(check[:, 1]), lists], ["doc_id", "hash", "node", "n", "c1", "c2", "keys"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, hash long, node long, n int, c1 long, c2 long, keys array<int>")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def propose_group(nodes: list[int], checks: np.ndarray, radius: int, forest: _Forest, pivots: int = 16) -> None:
    """Link what chains of pairs within the radius join in one bucket: exact, comparing only what isn't linked yet.

    A few pivots link most of a cluster, each node once; then each node outside the largest
    component is compared with all others.
    """
    roots = np.array([forest.root(x) for x in nodes], np.int64)
    for _ in range(pivots):
        values, sizes = np.unique(roots, return_counts=True)
        if len(values) == 1:
            return
        alone = np.flatnonzero(roots != values[sizes.argmax()]) if sizes.max() > 1 else np.arange(len(nodes))
        near = _apart(checks, checks[alone[0]]) <= radius
        joined = np.unique(roots[near])
        for x in joined.tolist():
            forest.link(nodes[alone[0]], x)
        roots[np.isin(roots, joined)] = forest.root(nodes[alone[0]])
    values, inverse, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    if len(values) > 1:
        for i in np.flatnonzero(inverse != sizes.argmax()).tolist():
            for x in np.unique(roots[(_apart(checks, checks[i]) <= radius) & (inverse != inverse[i])]).tolist():
                forest.link(nodes[i], x)


def _proposer(radius: int, small: int = 48):
    """mapInArrow over rows (key, i, j, node, c1, c2) sorted by unit and node: a spanning forest of the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), np.zeros((0, 6), np.int64)

        def groups(rows: np.ndarray) -> None:
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts, ends = np.r_[0, change], np.r_[change, len(rows)]
            size, checks = ends - starts, np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
            left = np.repeat(np.where(size <= small, ends, starts), size) - np.arange(len(rows))  # rows of the bucket from here on
            for lag in range(1, int(min(small, size.max(initial=0)))):
                at = np.flatnonzero(left > lag)
                near = at[_apart(checks[at], checks[at + lag]) <= radius]
                for x, y in zip(rows[near, 3].tolist(), rows[near + lag, 3].tolist(), strict=True):
                    forest.link(x, y)
            for k in np.flatnonzero(size > small).tolist():
                propose_group(rows[starts[k] : ends[k], 3].tolist(), checks[starts[k] : ends[k]], radius, forest)

        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
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


def _units(rows: DataFrame, blocks: str, name: str) -> DataFrame:
    """Rows dealt to units i, j of two salt blocks, every two blocks meeting in one unit; one unit where blocks is 1."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(name), F.col(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return salted.withColumn("i", F.least("salt", "other").cast("long")).withColumn("j", F.greatest("salt", "other").cast("long")).drop("salt", "other", blocks)


def candidates(nodes: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes joined by chains of pairs that share a key and are within the radius.

    Buckets of over block nodes are dealt to units of two salt blocks each, so no task gets a whole bucket.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "c1", "c2")
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")), "hot-keys")
    units = _units(keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "blocks", "node")
    dealt = units.select(F.col("key").cast("long").alias("key"), "i", "j", "node", "c1", "c2").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(tidy(_proposer(radius)), "a long, b long").distinct()


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def link_group(nodes: list[int], sets: list[np.ndarray], least: float, forest: _Forest) -> None:
    """Link all similar texts of one unit, comparing only what isn't linked yet.

    A text is first compared with the first one and the one before, which links most of a
    cluster. Then each text outside the largest component is compared with those that hold one
    of its rarest shingles, as many as a similar text can't lack all of: exact for any input.
    """

    def compare(i: int, j: int) -> None:
        if forest.root(nodes[i]) != forest.root(nodes[j]) and _similar(sets[i], sets[j], least):
            forest.link(nodes[i], nodes[j])

    for i in range(1, len(nodes)):
        compare(0, i)
        compare(i - 1, i)
    if len(nodes) == 2:
        return
    values, inverse, sizes = np.unique([forest.root(x) for x in nodes], return_inverse=True, return_counts=True)
    if len(values) == 1:
        return
    lengths = [len(s) for s in sets]
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    for i in np.flatnonzero(inverse != sizes.argmax()).tolist():
        low, high = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], "right")
        rarest = np.argsort(high - low, kind="stable")[: lengths[i] - int(np.ceil(least * lengths[i] - 1e-9)) + 1]
        for j in np.unique(np.concatenate([owners[low[k] : high[k]] for k in rarest.tolist()])).tolist():
            compare(i, j)


def _linker(least: float):
    """mapInArrow over rows (family, i, j, node, shingles) sorted by all but the last: a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, unit, nodes, sets = _Forest(), None, [], []
        for batch in batches:
            *columns, shingles = batch.columns
            for family, i, j, node, own in zip(*(c.to_pylist() for c in columns), shingles, strict=True):
                if (family, i, j) != unit:
                    if len(nodes) > 1:
                        link_group(nodes, sets, least, forest)
                    unit, nodes, sets = (family, i, j), [], []
                if not nodes or nodes[-1] != node:  # repeated rows are one text
                    nodes.append(node)
                    sets.append(np.frombuffer(own.as_py(), "<u8"))
            if len(forest.up) > 1_000_000 and len(nodes) < 2:
                yield forest.edges()
                forest = _Forest()
        if len(nodes) > 1:
            link_group(nodes, sets, least, forest)
        yield forest.edges()

    return run


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = 4096, unit_bytes: int = 8 << 20) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes joined by chains of similar pairs within a family of candidates.

    nodes has node, rep_id and rep_hash (id and text hash of a row with that text), n, c1, c2
    and keys. Only texts of families are read again, each once. A family whose shingles
    take more than unit_bytes is dealt to units of two salt blocks each.
    """
    families = connected_components(candidates(nodes, block=block)).withColumnRenamed("root", "family")
    members = materialize(nodes.select("node", "rep_id", "rep_hash", "n").join(families, "node"), "family-members")
    large = members.groupBy("family").agg(F.ceil(F.sum(F.col("n").cast("long")) * 8 / F.lit(unit_bytes)).cast("int").alias("blocks"))
    wanted = members.join(large, "family").select("node", "family", "blocks", "rep_id", "rep_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    # a plain merge join at every size: the plan doesn't change as the families outgrow a broadcast
    picked = texts.join(wanted.hint("merge"), (F.col("hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("family", "blocks", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in by_bytes(batch.column(3), 4 << 20):
                part = batch.slice(i, j - i)
                sets = [np.unique(shingle_hashes(_words(t), width)).astype("<u8").tobytes() for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["family", "blocks", "node", "shingles"])

    sets = picked.mapInArrow(tidy(run), "family long, blocks int, node long, shingles binary")
    dealt = _units(sets, "blocks", "node").select("family", "i", "j", "node", "shingles").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return dealt.mapInArrow(tidy(_linker(similarity)), "a long, b long").distinct()


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """doc_id, hash, component_id, first_hash for every row.

    component_id is the smallest id among all documents reachable through pairs whose sets of
    width-word shingles have at least the Jaccard similarity. Words are parted by ASCII white
    space, A-Z lower-cased; a text of fewer words is one shingle. Texts of the same words are
    one node; null and wordless texts are one, in no pair. hash is Spark's xxhash64 of the
    text; first_hash is the smallest hash of the rows with the component's id, so that
    (component_id, first_hash) names one text even where an id has several. A null id stays
    null and never becomes a component_id unless the component has no other; repeated rows
    give repeated results; an empty table gives no rows; other columns are never read.
    """
    sketched = materialize(sketches(docs, id_col, text_col, width), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    same = [F.first(c).alias(c) for c in ("n", "c1", "c2", "keys")]
    nodes = materialize(sketched.groupBy("node").agg(F.min(first).alias("rep"), *same).select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.hash").alias("rep_hash"), "n", "c1", "c2", "keys"), "nodes")
    roots = connected_components(links(docs, nodes, id_col, text_col, width, similarity, **options))
    rooted = materialize(nodes.select("node", "rep_id", "rep_hash").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_hash")).alias("first"))
    label = materialize(rooted.join(materialize(least, "least"), "root").select("node", F.col("first.rep_id").alias("component_id"), F.col("first.rep_hash").alias("first_hash")), "labels")
    return sketched.select("doc_id", "hash", "node").join(label, "node").select("doc_id", "hash", "component_id", "first_hash")
