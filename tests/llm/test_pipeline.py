"""The pipeline's stages and its whole run against plain Python."""

import hashlib
import re

import pytest
import tiktoken

import corpus_pipeline
from agropanel.llm import byte_bpe, quality_gam

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """Some hundred documents with copies, near copies and leaks, rows that share an id, and odd ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").collect()]
    first = [r for r in docs.orderBy("doc_id").limit(80).collect()]
    rows = [tuple(r) for r in first]
    long = next(r for r in first if len(r.text.split()) > 60)
    clean = "A quiet river runs past the old mill, and the miller counts his sacks before the rain comes down. " * 3
    rows += [
        (None, items[0] + " " + clean, "en", "a", 1), (None, long.text + " more", "en", "a", 1), (None, clean, "en", "a", 1), (None, None, "en", "a", 1),
        (5, items[1] + " and more text", None, None, None), (5, clean + "Five.", "en", "a", 1), (9001, long.text.replace(" ", "\n"), "en", "a", 1),
        (9002, "", "en", "a", 1), (9003, " ", "en", "a", 1), (9003, "word", "en", "a", 1),
    ]
    spark.createDataFrame([(*r, "z", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, file string, _key double").repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def table(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """A label per text: near copies, directly or by others, have the same."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def leaks(text, items):
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    return any(plain(i) in plain(text) for i in items)


def encoded(rows):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return sorted(repr((r.doc_id, enc.encode_ordinary(r.text or ""), len(enc.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest())) for r in rows)


def test_every_stage_is_the_plain_one(spark, folder):
    docs = table(spark, folder)
    rows = docs.collect()
    good = corpus_pipeline.keep_good_texts(spark, docs, folder)
    model = quality_gam.train(quality_gam.features(docs, "doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    import pyarrow as pa

    marks = model.score(quality_gam.text_features(pa.array([r.text for r in rows], pa.string())))
    assert good.columns == docs.columns and bag(good) == sorted(repr(tuple(r)) for r, m in zip(rows, marks) if m >= 0.5)

    single = corpus_pipeline.drop_exact_copies(spark, docs, folder)
    assert single.columns == docs.columns and sorted(norm(r.text) for r in single.collect()) == sorted({norm(r.text) for r in rows})
    assert set(bag(single)) <= set(bag(docs))

    apart = corpus_pipeline.drop_near_copies(spark, docs, folder)
    kept, label = bag(apart), dict(zip((repr(tuple(r)) for r in rows), groups([r.text for r in rows])))
    empty = [repr(tuple(r)) for r in rows if not words(r.text)]
    assert apart.columns == docs.columns and set(kept) <= label.keys() and set(empty) <= set(kept)
    full = [x for x in kept if x not in empty]
    assert sorted(label[x] for x in full) == sorted({v for x, v in label.items() if x not in empty})

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    pure = corpus_pipeline.drop_benchmark_leaks(spark, docs, folder)
    assert pure.columns == docs.columns and bag(pure) == sorted(repr(tuple(r)) for r in rows if not leaks(r.text, items))
    assert sum(r.doc_id is None for r in pure.collect()) == 3 and sum(r.doc_id == 5 for r in pure.collect()) == sum(r.doc_id == 5 for r in rows) - 1

    assert bag(corpus_pipeline.encode_texts(spark, docs, folder)) == encoded(rows)


def test_the_run_is_its_stages(spark, folder):
    docs = table(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
    assert bag(corpus_pipeline.run(spark, folder)) == encoded(docs.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "byte-level BPE"]


def test_stages_of_nothing_and_of_odd_rows(spark, folder, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, no_docs, folder).count() == 0, name
        assert stage(spark, odd_docs, folder).count() > 0, name
    assert corpus_pipeline.keep_good_texts(spark, odd_docs, folder).columns == odd_docs.columns
    assert corpus_pipeline.keep_good_texts(spark, no_docs, folder).count() == 0
