"""Shards against a plain heap."""

import heapq
import zlib
from hashlib import sha256

import numpy as np

from agropanel.llm import sharding


def brute(rows, shards):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    size = {t: len(t.encode()) + 8 for t in groups}
    digest = {t: sha256(t.encode()).digest() for t in groups}
    heap, taken, home = [(0, i) for i in range(shards)], {}, {}
    order = sorted(groups, key=lambda t: (-size[t] * len(groups[t]), digest[t]))
    for t in order:
        held, i = heap[0]
        heapq.heapreplace(heap, (held + size[t] * len(groups[t]), i))
        taken.setdefault(size[t] * len(groups[t]), []).append(i)
    for whole, got in taken.items():
        home.update(zip([t for t in order if size[t] * len(groups[t]) == whole], sorted(got)))
    out = []
    for shard in range(shards):
        mine = sorted(((d is not None, d or 0, digest[t or ""], t or "") for d, t in rows if home[t or ""] == shard), key=lambda r: r[:3])
        out += [(d if has else None, size[t], zlib.crc32(t.encode()), "bytes", shard, slot, None) for slot, (has, d, _, t) in enumerate(mine)]
    return out


def rows_of(df):
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[4], r[5]))


def test_a_level_is_what_the_heap_gives():
    rng = np.random.default_rng(3)
    for _ in range(200):
        loads, size, n = rng.integers(0, 900, rng.integers(1, 9)).tolist(), int(rng.integers(1, 90)), int(rng.integers(0, 400))
        heap, counts = [(held, i) for i, held in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(n):
            held, i = heap[0]
            counts[i] += 1
            heapq.heapreplace(heap, (held + size, i))
        assert sharding.deal(loads, size, n) == counts


def test_shards_are_the_heaps(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(5000 + i, "a copy") for i in range(900)] + [(7000 + i, f"{i:04d}") for i in range(700)]  # a hot group, a hot size
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(sharding.place(df.repartition(5), 24))
    assert found == brute(rows, 24)
    assert found == rows_of(sharding.place(df.repartition(3).orderBy("text"), 24))
    loads = np.bincount([r[4] for r in found], weights=[r[1] for r in found])
    largest = max(len(t.encode()) + 8 for _, t in rows)
    assert loads.max() - loads.min() <= max(largest, 900 * 14)


def test_shards_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(sharding.place(odd_docs, 4)) == brute(rows, 4)
    assert sharding.place(no_docs).count() == 0
    written = spark.read.parquet(sharding.write(odd_docs, str(tmp_path / "s"), 4))
    assert set(written.columns) == {*odd_docs.columns, "shard"}
    assert written.count() == len(rows)
    homes = {zlib.crc32((r.text or "").encode()): r.shard for r in written.collect()}
    assert homes == {r[2]: r[4] for r in brute(rows, 4)}
