"""Decontamination, licences and archives against brute force."""

import gzip
import hashlib
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from agropanel.llm import decontam, licences, wacz
from agropanel.llm.sql import SQL


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_finds_every_passage_and_nothing_else(spark, data):
    where = data.replace("sf0.001", "sf0.01")
    docs, items = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    texts = {r.doc_id: f" {' '.join(plain_words(r.text))} " for r in docs.collect()}
    expected = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {' '.join(plain_words(r.text))} " in t}
    assert expected and found == expected
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, index_bytes=2000).collect()} == expected


def test_shards_change_no_score(spark):
    rng = np.random.default_rng(9)
    word = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(word, rng.integers(4, 30))) for _ in range(60)]
    items += items[:1] * 25 + items[3:5]  # copies of an item are items, too
    docs = [" ".join(rng.choice(word, 40)) + " " + items[i % 60][: len(items[i % 60]) * 2 // 3] + " end" for i in range(90)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    size = sum(map(len, set(items)))
    loose = {"threshold": 0.3, "question": 0.1, "answer": 0.0, "whole_share": 0.2}
    one, seven = (sorted(map(tuple, decontam.contaminated(rows, table, index_bytes=n, **loose).collect())) for n in (size, size // 7 + 1))
    assert len(one) > 90 and one == seven
    index = decontam.build(items, counts_of(items))
    scores = {}
    for text, item, score, _ in decontam.retrieve(index, decontam._words(docs), 0.3):
        scores[text, item] = max(scores.get((text, item), 0), score)
    assert {(r[0], r[1]) for r in one} <= scores.keys() and all(scores[r[0], r[1]] >= r[2] for r in one)


def counts_of(items):
    words = decontam._words(items)
    vocabulary, held = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    return decontam.Counts(len(items), max(1.0, np.mean([len(w) for w in words])), vocabulary, held)


def brute_scores(items, words, k1=1.2, b=0.75):
    """Plain BM25 of every window and item, as a share of the item's own score."""
    sets = [plain_words(t) for t in items]
    mean = np.mean([len(w) for w in sets])
    df = {w: sum(w in s for s in sets) for s in sets for w in s}
    out = {}
    for n, item in enumerate(sets):
        weight = {
            w: np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * item.count(w) * (k1 + 1) / (item.count(w) + k1 * (1 - b + b * len(item) / mean))
            for w in set(item)
        }
        width = 1 << int(np.ceil(np.log2(len(item))))
        for begin in range(0, max(1, len(words) - width), width):
            window = set(words[begin : begin + 2 * width])
            out[n] = max(out.get(n, 0), sum(x for w, x in weight.items() if w in window) / sum(weight.values()))
    return out


def test_skipping_loses_no_window_above_the_threshold():
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(80)]
    items = [" ".join(rng.choice(word, rng.integers(3, 40))) for _ in range(70)]
    index = decontam.build(items, counts_of(items))
    texts = ["", *(" ".join(rng.choice(word, rng.integers(1, 300))) + " " + items[rng.integers(70)] + " " + "z " * rng.integers(0, 60) for _ in range(25))]
    found = {}
    for text, item, score, _ in decontam.retrieve(index, decontam._words(texts), 0.5):
        found[text, item] = max(found.get((text, item), 0), score)
    expected = {(t, i): s for t, text in enumerate(texts) if text for i, s in brute_scores(items, plain_words(text)).items() if s >= 0.5}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(s) for k, s in expected.items())


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three four five six"), (2, None), (3, ""), (4, "?!"), (4, "nothing like it here")], "item_id long, text string")
    found = decontam.contaminated(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(5, 1), (3, 1), (None, 1)} and len(found) == 3
    assert decontam.contaminated(no_docs, items).count() == 0
    assert decontam.contaminated(odd_docs, items.where("item_id = 2")).count() == 0


def test_question_and_answer():
    assert decontam.split_item("What is it? A cat.") == ("What is it?", "A cat.")
    assert decontam.split_item("one line only") == ("one line only", "")
    words = lambda t: decontam._words([t])[0]
    item = "What is the name of the longest river that crosses the old town? It is the river Lethe of old"
    both = [item, "something else entirely that is long enough to count here"]
    index = decontam.build(both, counts_of(both))
    assert decontam.verified(index, [words("before " + item + " after")], 0.5, 0.6, 0.5, 0.8)
    assert not decontam.verified(index, [words("the name of the old river is It and the longest town crosses What that")], 0.1, 0.6, 0.5, 0.8)


def brute_canonical(text):
    lines = [x for x in (text or "").lower().split("\n") if not re.match(r"[ \t\r]*(copyright|\(c\)|©)", x)]
    out = re.sub(r"[\W_]+", " ", " ".join(lines)).strip()
    for a, b in licences.SPELLINGS:
        out = out.replace(a, b)
    return out


def test_licences_on_odd_rows(spark, odd_docs, no_docs):
    mit = dict(licences.KNOWN)["MIT"]
    table = licences.known(spark)
    rows = [(1, "Copyright (c) 2020 Me\n(C) You\n" + mit.upper()), (2, mit.replace(",", " ;")), (3, "Text.\nRELEASED under the MIT Licence!\nAll rights reserved"), (4, mit[:-9]), (5, "copyright me"), (5, "All   Rights-Reserved\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    digest = {brute_canonical(t): n for n, t in licences.KNOWN}
    found = sorted(licences.scan(docs, table).collect(), key=str)
    expected = []
    for r in docs.collect():
        notices = [digest[c] for c in map(brute_canonical, (r.text or "").split("\n")) if c in digest]
        expected.append((r.doc_id, digest.get(brute_canonical(r.text)), len(notices), ",".join(sorted(set(notices)))))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert {r.doc_id for r in found if r.licence == "MIT"} == {1, 2}
    assert licences.scan(no_docs, table).count() == 0


def test_licences_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Copyright 1999 Us\nDo as you like,\n  but say so.")
    table = licences.known(spark, str(tmp_path))
    texts = dict(licences.KNOWN)
    docs = spark.createDataFrame([
        (1, "do as you like BUT say so!\n(c) 2024 them"), (2, texts["BSD-3-Clause"].replace("copyright holder", "Copyright Holder")), (3, texts["BSD-2-Clause"]),
        (4, texts["notice:MPL-2.0"].replace("http:", "https:")), (5, texts["Zlib"][:-5]), (6, "...\n---\n"),
    ], "doc_id long, text string")
    found = {r.doc_id: (r.licence, r.n_notices) for r in licences.scan(docs, table).collect()}
    assert found == {1: ("Own-1.0", 1), 2: ("BSD-3-Clause", 0), 3: ("BSD-2-Clause", 0), 4: ("notice:MPL-2.0", 1), 5: (None, 0), 6: (None, 0)}


def pages_of(spark):
    same = "<p>" + "payload " * 30
    rows = [(9, "http://a", same), (4, "http://b c\n", same), (4, None, same), (6, "u", same), (None, "n", same), (1, None, None), (2, "e", ""), (3, "s", "short"), (8, "s", "short"), (7, "é", "é\r\n\r\n" * 40)]
    return spark.createDataFrame([(*r, b"x") for r in rows], "page_id long, url string, html string, payload binary")


def test_archives_round_trip(spark, tmp_path):
    pages = pages_of(spark)
    archives = wacz.write(wacz.marked(pages), f"file://{tmp_path}/a", archive_bytes=1)
    found = wacz.read(archives).collect()
    assert len(found) == pages.count() == archives.agg(F.sum("records")).first()[0]
    of = {}
    for r in pages.collect():
        of.setdefault(r.page_id, []).append((r.html or "").encode())
    for r in found:
        payload = of[r.page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == payload)
    assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {9: 4, 6: 4}
    assert wacz.read(wacz.write(wacz.marked(pages.limit(0)), f"file://{tmp_path}/b")).count() == 0


def test_members_of_plain_and_zip64_directories(tmp_path, monkeypatch):
    from pyarrow import fs

    for wide in (False, True):
        path = tmp_path / f"{wide}.zip"
        if wide:  # forces the ZIP64 records of the central directory
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            z.writestr("first", b"x" * 50)
            z.writestr(wacz.WARC_MEMBER, gzip.compress(b"record"))
            z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
            z.comment = b"a remark"
        with fs.LocalFileSystem().open_input_file(str(path)) as source:
            found = wacz.members(source, source.size())
            assert set(found) == {"first", wacz.WARC_MEMBER}
            at, length = found[wacz.WARC_MEMBER]
            assert gzip.decompress(source.read_at(length, at)) == b"record"
        if wide:
            assert b"PK\x06\x06" in path.read_bytes()


def test_damage_is_noticed(tmp_path):
    from pyarrow import fs

    (tmp_path / "x").write_bytes(b"no archive")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source, pytest.raises(ValueError):
        wacz.members(source, source.size())
    data = wacz.record(1, "u", b"body", 4, hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        wacz.parse_record(data)


def test_the_sql_twins_name_registered_queries():
    from agropanel.llm.queries import QUERIES

    assert set(SQL) <= set(QUERIES) and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
