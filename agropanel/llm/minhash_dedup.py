"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``collection`` sub-hashes, each of ``width`` minhashes, are
computed per set; a table key joins one sub-hash of either collection, so
``collection ** 2`` tables cost only ``2 * collection * width`` minhashes. Two sets
of similarity s meet in some table with probability
``(1 - (1 - s ** width) ** collection) ** 2``: 0.9998 at 0.8, 0.99999 at 0.87.

Equal sets are one class with a smallest ``doc_id`` as representative. A bucket's
smallest representative is its centre, and all candidates of a bucket meet in the
group of that centre. Group members are first confirmed against the centre; those
it does not confirm (U) are then held against the whole group in blocks, as a
matrix product over shared shingles that gives exact intersections. A block emits
a spanning forest, never its pairs. Pairs whose minhashes agree in so few lanes that a
pair at the threshold does so with probability below ``MISS`` are left out of the product.

Null or empty texts, and texts without words, have an empty set and are linked
with nothing. A null ``doc_id`` cannot name a component: such rows are returned
unlinked, ``component_id`` null and ``kept`` true. Rows that repeat a ``doc_id``
are taken as texts of one document. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .tables import HOT_SHARE, SMALL_BATCHES, components, lookup, mark_place, marked, marks, settings
from .text_hash import batch_words, mix, shingles

BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 20
#: Probability of leaving out a pair whose similarity is the threshold, by the lanes it agrees in.
MISS = 1e-6


def least_lanes(lanes: int, percent: int) -> int:
    """The largest number such that a pair at ``percent`` agrees in fewer lanes with probability below ``MISS``."""
    s, below, k = percent / 100, 0.0, 0
    while k < lanes:
        below += math.comb(lanes, k) * s**k * (1 - s) ** (lanes - k)
        if below >= MISS:
            break
        k += 1
    return k


def _lanes(width: int, collection: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(101)
    n = 2 * width * collection
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(sets: list[np.ndarray], width: int, collection: int) -> np.ndarray:
    """A row of 32-bit minhashes per non-empty set."""
    offset, scale = _lanes(width, collection)
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), len(offset)), np.uint32)
    with np.errstate(over="ignore"):
        for lane in range(len(offset)):
            x = (flat ^ offset[lane]) * scale[lane]
            x ^= x >> np.uint64(29)
            out[:, lane] = np.minimum.reduceat(x * scale[lane - 1], begins) >> np.uint64(32)
    return out


def table_keys(lanes: np.ndarray, width: int, collection: int) -> np.ndarray:
    """``collection ** 2`` keys per row, each of one sub-hash of either collection."""
    with np.errstate(over="ignore"):
        parts = lanes.astype(np.uint64).reshape(len(lanes), 2 * collection, width)
        sub = np.zeros(parts.shape[:2], np.uint64)
        for k in range(width):
            sub = mix(sub * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
        sub = mix(sub + np.arange(2 * collection, dtype=np.uint64))
        keys = mix(sub[:, :collection, None] * np.uint64(0xC2B2AE3D27D4EB4F) + sub[:, None, collection:])
    return keys.reshape(len(lanes), -1).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xA0761D6478BD642F) + np.uint64(7)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(s))], np.uint64).tobytes()


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(doc_id, set)`` of the documents in ``wanted(doc_id)``: the sorted 64-bit shingle hashes as bytes.

    Texts are hashed where they are read; what the marks let through is then joined.
    """
    bits = docs.sparkSession.sparkContext.broadcast(marks(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(bits.value, np.asarray(batch.column(2)))))
            found = [b""] * len(batch)
            for row, w in batch_words(batch.column(1)):
                found[row] = shingles(w, words).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.withColumn("place", mark_place("doc_id")).mapInArrow(run, "doc_id long, set binary").join(wanted, "doc_id", "left_semi")


def _parts(sets: dict[int, np.ndarray], most: int = 1 << 17) -> Iterator[list[int]]:
    """The keys of ``sets`` in parts of about ``most`` shingles."""
    part, size = [], 0
    for row, s in sets.items():
        part.append(row)
        size += len(s)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, width: int, collection: int) -> DataFrame:
    """``(doc_id, n, digest, lanes)`` per row; ``digest`` and ``lanes`` are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for row, w in batch_words(batch.column(1)):
                if len(w):
                    sets[row] = shingles(w, words)
            lanes = [None] * len(batch)
            for part in _parts(sets):
                for row, x in zip(part, minhashes([sets[r] for r in part], width, collection)):
                    lanes[row] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(sets.get(r, ())) for r in range(len(batch))], pa.int64()),
                    pa.array([_digest(sets[r]) if r in sets else None for r in range(len(batch))], pa.binary()),
                    pa.array(lanes, pa.binary()),
                ],
                names=["doc_id", "n", "digest", "lanes"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, digest binary, lanes binary"
    )


def _emit_keys(width: int, collection: int):
    tables = collection**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                lanes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(len(part), -1)
                keys = table_keys(lanes, width, collection)
                nodes = np.repeat(np.asarray(part.column(0)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["key", "node"])

    return run


def _similar(na: np.ndarray, nb: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na + nb - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    common = int((b[at] == a).sum())
                    linked[i] = _similar(len(a), len(b), common, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["centre", "node", "linked"])

    return run


def forest(nodes: np.ndarray, sets: list[np.ndarray], is_u: np.ndarray, percent: int, width: int, collection: int) -> list[tuple[int, int]]:
    """Spanning edges of the links between members, of pairs with at least one in U."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    nodes, size, is_u = nodes[order], size[order], is_u[order]
    sets = [sets[i] for i in order]
    lanes = np.concatenate([minhashes(sets[i : i + 256], width, collection) for i in range(0, len(sets), 256)])
    least = least_lanes(lanes.shape[1], percent)
    near: list[tuple[int, np.ndarray]] = []
    for i in np.flatnonzero(is_u):
        a = np.searchsorted(size * 100, percent * size[i], "left")
        b = np.searchsorted(size * percent, 100 * size[i], "right")
        others = np.arange(a, b)
        others = others[(others > i) | ~is_u[others]]
        if len(others):
            others = others[(lanes[others] == lanes[i]).sum(1) >= least]
            if len(others):
                near.append((int(i), others))
    if not near:
        return []
    used = np.unique(np.concatenate([np.concatenate([o, [i]]) for i, o in near]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), size[used])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    by_owner = np.split(column, np.searchsorted(owner, np.arange(1, len(used))))
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    edges = []
    hold = np.zeros(int(column.max()) + 1 if len(column) else 1, bool)
    for i, others in near:
        hold[by_owner[place[i]]] = True
        lists = [by_owner[p] for p in place[others]]
        ends = np.cumsum([len(x) for x in lists])
        hits = np.concatenate([[0], np.cumsum(hold[np.concatenate(lists)])])
        common = hits[ends] - hits[ends - [len(x) for x in lists]]
        hold[by_owner[place[i]]] = False
        for j in others[_similar(size[i], size[others], common, percent)]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def _block_edges(percent: int, width: int, collection: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        found = forest(group["node"].to_numpy(), sets, group["u"].to_numpy(), percent, width, collection)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, width: int = 2, collection: int = 9,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        return _near_duplicates(docs, id_col, text_col, words, percent, width, collection)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, width: int, collection: int) -> DataFrame:
    sketch = cut_lineage(sketches(docs, id_col, text_col, words, width, collection))
    named = sketch.where("doc_id is not null and n > 0")
    classes = cut_lineage(
        named.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "lanes")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("digest", "copies", F.col("first.doc_id").alias("node"), F.col("first.n").alias("n"), F.col("first.lanes").alias("lanes"))
    )
    # Made again for each use: the lanes are a fraction of the size of the keys made from them.
    keys = classes.select("node", "lanes").mapInArrow(_emit_keys(width, collection), "key long, node long")
    buckets = cut_lineage(keys.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    rows = buckets.agg(F.sum("members")).first()[0] or 0
    pairs = cut_lineage(
        lookup(keys, buckets, "key", rows, "members", "inner").where("node <> centre").select("centre", "node").distinct()
    )
    edges = _links(docs, pairs, id_col, text_col, words, percent, width, collection)
    linked = components(edges)
    final = cut_lineage(
        classes.select("digest", "copies", "node").join(linked, "node", "left")
        .select("digest", "copies", F.coalesce("component", "node").alias("component_id"), (F.col("component") != F.col("node")).alias("moved"))
        .where("copies > 1 or moved").select("digest", "copies", "component_id")
    )
    out = lookup(sketch.select("doc_id", "n", "digest").where("digest is not null and doc_id is not null"), final, "digest", named.count(), "copies")
    rest = sketch.select("doc_id", "n", "digest").where("digest is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return out.drop("copies").unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, percent: int, width: int, collection: int) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what the links between members of each centre's group connect."""
    nodes = pairs.select("node").union(pairs.select("centre")).distinct()
    found = shingle_sets(docs, nodes.withColumnRenamed("node", "doc_id"), id_col, text_col, words)
    sets = cut_lineage(found.where("length(set) > 0").withColumn("n", (F.length("set") / 8).cast("long")))
    sizes = cut_lineage(
        pairs.join(sets.select(F.col("doc_id").alias("node"), "n"), "node")
        .groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    )
    total = sizes.agg(F.sum("members")).first()[0] or 0
    piece = max(1, int(total * HOT_SHARE))
    hot = sizes.where(F.col("members") > piece).select("centre", F.ceil(F.col("members") / piece).alias("salts"))  # fewer than 2000 rows
    salted = pairs.join(F.broadcast(hot), "centre", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1)))).drop("salts")
    centres = (
        sets.select(F.col("doc_id").alias("centre"), F.col("set").alias("centre_set")).join(sizes.select("centre"), "centre", "left_semi")
        .join(F.broadcast(hot), "centre", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    )
    with_sets = salted.join(sets.select(F.col("doc_id").alias("node"), "set"), "node")
    checked = cut_lineage(
        with_sets.join(centres, ["centre", "salt"]).select("centre", "node", "set", "centre_set")
        .mapInArrow(_confirm(percent), "centre long, node long, linked boolean")
    )
    left = checked.where("not linked")
    open_groups = cut_lineage(
        left.groupBy("centre").agg(F.count(F.lit(1)).alias("u_members")).join(sizes, "centre").where("members > 1")
        .select(
            "centre", "members",
            F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES)).alias("v_blocks"),
            F.ceil(F.greatest(F.col("u_members") / BLOCK_MEMBERS, F.col("shingles") * F.col("u_members") / F.col("members") / BLOCK_SHINGLES)).alias("u_blocks"),
        )
    )
    members = lookup(checked.withColumn("u", ~F.col("linked")), open_groups, "centre", total, "members", "inner")
    at = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks))
    cells = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    as_u = members.where("u").withColumn("ub", at("u_blocks")).withColumn("vb", cells("v_blocks"))
    as_v = members.where("not u").withColumn("vb", at("v_blocks")).withColumn("ub", cells("u_blocks"))
    # A pair within U is met where the one's block of rows meets the other's as a column.
    u_as_v = members.where("u").withColumn("vb", at("v_blocks")).withColumn("ub", cells("u_blocks")).where(F.col("ub") != at("u_blocks")).withColumn("u", F.lit(False))
    cols = ["centre", "ub", "vb", "node", "u"]
    cells_of = as_u.select(cols).unionByName(as_v.select(cols)).unionByName(u_as_v.select(cols))
    blocks = (
        cells_of.join(sets.select(F.col("doc_id").alias("node"), "set"), "node")
        .groupBy("centre", "ub", "vb").applyInPandas(_block_edges(percent, width, collection), "a long, b long")
    )
    return checked.where("linked").select(F.col("centre").alias("a"), F.col("node").alias("b")).unionByName(blocks)
