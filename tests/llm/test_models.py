"""The trained operators: held-out accuracy, normalisation, and exact parts against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agropanel.llm import lm_nce, pii, quality_gam


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_quality_on_held_out_rows(spark, data):
    where = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = quality_gam.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([t == p for t, p in held]) >= 0.95
    assert np.mean([p for t, p in held if t == 1]) >= 0.97


def test_quality_learns_nothing_from_held_out_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_gam.scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.93


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (10, 0), (99, 1), (None, 0), (7, None)], "doc_id long, quality int")
    rows = quality_gam.scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_gam.scores(odd_docs, none).collect()} == {0.5}
    assert quality_gam.scores(no_docs, labels).count() == 0
    kept = quality_gam.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def brute_base(rows):
    """``doc_id -> (n_tokens, n_known, N, base score)``."""
    tokens = {d: [w for w in (t or "").encode().lower().split()] + [None] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if d is not None and crc(d) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    z = math.log10(n + 0.5 * (v + 1)) if n else 0
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10(counts[w] + 0.5) for w in ws) - len(ws) * z) for d, ws in tokens.items()}


@pytest.mark.parametrize("frequent", [lm_nce.FREQUENT, 200])  # with 200, most words go through the join
def test_language_model_against_brute_force(spark, data, frequent, monkeypatch):
    monkeypatch.setattr(lm_nce, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    rows = lm_nce.score(docs).collect()
    for r in rows:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, crc(r.doc_id) % 5 == 1)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (36, 5)).astype(np.float32)
    table = lm_nce.train(counts, rounds=20).log_probabilities()
    assert table.shape == (36, 5) and np.allclose((10.0**table).sum(1), 1, atol=1e-5)


def test_language_model_learns_from_the_words_before():
    size = 6  # each class follows the next but one
    counts = np.full(((size + 1) ** 2, size), 0.0, np.float32)
    for a in range(size):
        for b in range(size):
            counts[a * (size + 1) + b, (a + 2) % size] = 100
    p = 10.0 ** lm_nce.train(counts, rounds=200).log_probabilities()
    assert np.mean([p[a * (size + 1) + b].argmax() == (a + 2) % size for a in range(size) for b in range(size)]) == 1


def test_scores_of_all_texts_of_one_word_add_up(spark):
    """Over a closed vocabulary, P(word, end) over all known words and the unseen ones is at most one, and near it with the end's share."""
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(["a b c", "b c a", "c a b a", "a", "b b"] * 6)], "doc_id long, text string")
    found = lm_nce.score(docs).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_language_model_of_odd_rows(odd_docs, no_docs):
    expected = brute_base([(r.doc_id, r.text) for r in odd_docs.dropDuplicates(["doc_id"]).collect()])
    rows = lm_nce.score(odd_docs.dropDuplicates(["doc_id"])).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {d: x[:3] for d, x in expected.items()}
    assert next(r.held_out for r in rows if r.doc_id is None) and lm_nce.score(odd_docs).count() == odd_docs.count()
    assert lm_nce.score(no_docs).count() == 0


PII_TEXT = (
    "é mail a.b+c@x-1.example.org, x@y. ip 1.2.3.4 and 1.2.3.4.5 300.1.1.1 0001.2.3.4 card 4539 1488 0343 6467 bad 4539 1488 0343 6468 "
    "tel +1 (988) 555-2485 or +12 short +1 2 end a@b.c@d.e 😀 me@home.net"
)


def brute_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PATTERNS[kind].pattern, text or ""):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda: all(len(p) < 4000 and int(p) <= 255 for p in s.split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_the_patterns(spark, data):
    texts = [PII_TEXT, "", "@", "a@b", "a@b.c" * 40, "1" * 6000, "1.1.1." + "9" * 5000] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for text in texts:
        assert pii.base_spans(text)[0] == brute_spans(text)


def test_windows_hold_every_span_and_are_reconciled():
    text = "x" * 200 + "1" * 300 + "y" * 90 + "a@b.cd"
    wins = pii.windows(text)
    assert all(b - a <= pii.WINDOW for a, b in wins) and {i for a, b in wins for i in range(a, b)} >= {i for i, c in enumerate(text) if c in "1@"}
    spans = [(2, 200, 500), (0, len(text) - 6, len(text))]
    tags = np.stack([pii.tags_of(a, b, spans) for a, b in wins])
    assert pii.reconcile(wins, tags) == spans


def test_the_taggers_gradient():
    rng = np.random.default_rng(2)
    model = pii.Tagger(hidden=4, embed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, pii.CHAR_KINDS, (3, pii.WINDOW)), rng.integers(0, pii.TAGS, (3, pii.WINDOW))
    _, grads = model.step(x, y)
    for name, at in (("wf", (2, 5)), ("wb", (4, 1)), ("trans", (1, 2)), ("out", (3, 2)), ("embed", (4, 1)), ("vf", (6,))):
        value = model.p[name][at]
        ends = []
        for e in (1e-3, -1e-3):
            model.p[name][at] = value + e
            ends.append(model.step(x, y)[0])
        model.p[name][at] = value
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.05, abs=0.02)


def test_the_tagger_on_held_out_windows(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    table = pii.scanned(docs, "doc_id", "text")
    tagger = pii.train(table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    right = found = true = 0
    for r in table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).where("size(wins) > 0").collect():
        wins = [(w.start, w.stop) for w in r.wins]
        got = set(pii.reconcile(wins, tagger.decode(pii.char_kinds([w.text for w in r.wins]))))
        want = {tuple(s) for s in r.base}
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert true > 50 and 2 * right / (found + true) > 0.85


def test_personal_data_of_odd_rows(spark, odd_docs, no_docs):
    rows = pii.report(pii.find(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and {r.base_sha256 for r in rows if r.spans == ""} == {hashlib.sha256(b"").hexdigest()}
    assert pii.report(pii.find(no_docs)).count() == 0
    docs = spark.createDataFrame([(i, PII_TEXT + f" {i}") for i in range(30)] + [(99, None)], "doc_id long, text string")
    for r in pii.report(pii.find(docs)).collect():
        base = brute_spans(PII_TEXT + f" {r.doc_id}") if r.doc_id != 99 else []
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]


def test_the_model_finds_what_the_patterns_miss(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    said = []
    for k in range(40):
        for kind, span in (
            ("phone", [f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(2)}.{digits(3)}.{digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"][k % 3]),
            ("email", f"john.doe{k} " + ["@ mail.org", "@ uni.example.edu"][k % 2]), ("ip", ". ".join(map(str, rng.integers(1, 255, 4)))),
        ):
            text = ["please call ", "write to ", "see "][k % 3] + span + [" today", " before noon"][k % 2]
            if not pii.base_spans(text)[0]:
                said.append((kind, span, text))
    plain = ["in 2019 we sold 120 of 345 units for 12,500", "card 4539 1488 0343 6468 is wrong, 300.1.1.1 too"]
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate([x[2] for x in said] + plain)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.report(pii.find(docs.unionByName(more))).where("doc_id < 0").collect()}
    for kind in ("phone", "email", "ip"):
        mine = [(d, s, t) for d, (k, s, t) in enumerate(said) if k == kind]
        hits = sum(found[-1 - d] == f"{kind}:{t.index(s)}:{t.index(s) + len(s)}" for d, s, t in mine)
        assert len(mine) > 30 and hits >= len(mine) / 2, (kind, hits, len(mine))
    assert [found[-1 - len(said) - k] for k in range(2)] == ["", ""]


def test_a_span_gives_way_to_base_spans_and_its_own_failed_matches_only():
    text = "id 12 at (555) 123-4567 or 4539 1488 0343 6468"
    wins, (base, failed) = [(0, len(text))], pii.base_spans(text)
    tags = lambda *spans: pii.tags_of(0, len(text), list(spans))[None]
    add = lambda *spans, held=base: pii.add_spans(held, failed, wins, [text], tags(*spans))
    assert not base and add((3, 9, 23)) == [(3, 9, 23)] and add((2, 27, 46)) == [] and add((3, 9, 22)) == [] and add((3, 9, 23), held=[(1, 20, 30)]) == [(1, 20, 30)]


def test_features_see_whole_texts():
    a = quality_gam.text_features(pa.array(["word " * 50_000 + "!", None, "", "Aa1|\n"]))
    assert a.shape == (4, len(quality_gam.FEATURES)) and a[0, 2] < 0.01 and not a[1].any() and not a[2].any()


def test_spans_of_long_texts_take_time_in_proportion():
    import time

    took = []
    for size in (100_000, 400_000):
        text = "call 1234567890 or 12 34 56 now " * (size // 32)
        begun = time.process_time()
        base, failed = pii.base_spans(text)
        wins = pii.windows(text)
        texts = [text[a:b] for a, b in wins]
        tags = np.stack([pii.tags_of(a, b, [(3, a + 5, a + 15)]) for a, b in wins])
        pii.add_spans(base, failed, wins, texts, tags)
        took.append(time.process_time() - begun)
    assert took[1] < 10 * took[0] + 0.5
    text = "4111 1111 1111 1112 9 " * 3 + "a@b.cd " + "x" * 90 + "9"
    wins = pii.windows(text)
    held = pii.Stretches(wins, [text[a:b] for a, b in wins])
    for a, b in ((0, 5), (30, 70), (60, len(text)), (100, 120)):
        assert held.cover(a, b) == "".join(c for i, c in enumerate(text) if a <= i < b and any(x <= i < y for x, y in wins))
    spans = pii.Intervals.union([(1, 4), (3, 6), (9, 12)])
    for a in range(14):
        for b in range(a + 1, 15):
            assert spans.meet(a, b) == any(x < b and a < y for x, y in ((1, 6), (9, 12)))
            assert spans.hold(a, b) == any(x <= a and b <= y and b - a < y - x for x, y in ((1, 6), (9, 12)))


def test_the_same_rows_give_the_same_spans_in_any_layout(spark):
    docs = spark.createDataFrame([(i, PII_TEXT + f" {i} call (555) 123-45{i % 90 + 10} now") for i in range(60)], "doc_id long, text string")
    one, two = (sorted(tuple(r) for r in pii.report(pii.find(d, max_windows=60)).collect()) for d in (docs.repartition(1), docs.repartition(7).orderBy("text")))
    assert one == two
