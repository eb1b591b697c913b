"""Exact and near duplicates against brute force."""

import hashlib
import re

import numpy as np

from agropanel.llm import exact_dedup, minhash_dedup
from agropanel.llm.tables import components


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    """From ``(doc_id, text)``: the row that stays for each normalised text, and how many rows have it."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append(doc)
    return {t: (min((d for d in ids if d is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact_dedup_of_odd_rows(odd_docs):
    expected = brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])
    for digits in (64, 1):  # with one hex digit, different texts share a digest
        found = exact_dedup.decisions(odd_docs, digest_hex=digits).collect()
        assert len(found) == odd_docs.count()
        by_text = {}
        for r in found:
            by_text.setdefault(r.text_sha256, []).append(r)
        for text, (keep, size) in expected.items():
            rows = by_text[hashlib.sha256(text.encode()).hexdigest()]
            assert {(r.keep_id, r.group_size) for r in rows} == {(keep, size)}
            assert sum(r.kept for r in rows) == 1 and [r.doc_id for r in rows if r.kept] == [keep]
    kept = exact_dedup.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(expected)


def test_exact_dedup_over_several_batches(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    found = exact_dedup.decisions(docs, max_bytes_per_trigger=1).collect()
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(d, *expected[t]) for d, t in texts.items()}


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.decisions(no_docs).count() == 0


def brute_near(rows, size, percent=80):
    sets = {}
    for doc, text in rows:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_duplicates_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = brute_near([(r.doc_id, r.text) for r in docs.collect()], 4)
    found = minhash_dedup.near_duplicates(docs, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_group_of_near_copies_whose_centre_confirms_only_some(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 7)  # several blocks
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(60):  # similarity between members lies on both sides of the threshold
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            w[at] = f"n{d}x{at}"
        rows.append((d, " ".join(w)))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    expected = brute_near(rows, 4)
    assert len({c for _, c in expected.values()}) > 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    found = minhash_dedup.near_duplicates(odd_docs, words=4).collect()
    assert len(found) == odd_docs.count()
    of = {r.doc_id: r for r in found}
    assert of[5].component_id == 3 and of[12].component_id == 11 and not of[12].kept
    assert all(of[d].n_shingles == 0 and of[d].component_id == d for d in (7, 8, 9)) and of[10].n_shingles == 1
    assert of[None].component_id is None and of[None].kept
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(10, 31)} == {10} and {found[k] for k in range(100, 140)} == {100}


def test_the_least_agreement_follows_the_threshold():
    assert minhash_dedup.least_lanes(36, 80) == 16 and minhash_dedup.least_lanes(36, 50) < 6 and minhash_dedup.least_lanes(36, 100) == 36
    from math import comb

    for percent in (50, 60, 70, 80, 90):
        k, s = minhash_dedup.least_lanes(36, percent), percent / 100
        below = [sum(comb(36, i) * s**i * (1 - s) ** (36 - i) for i in range(n)) for n in (k, k + 1)]
        assert below[0] < minhash_dedup.MISS <= below[1]
