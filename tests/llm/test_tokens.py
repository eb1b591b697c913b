"""Token files and byte-level BPE against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from agropanel.llm import byte_bpe, token_files

P = pytest.importorskip("public_tokenizers")
BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "a  b\n\n c", "don't we'll 'S", "x" * 5000, " " * 3000, "\n" * 2500 + "é", "12 345 z", "aﬁ İSTANBUL ὈΔΥΣΣΕΎΣ", "日本語のテキスト" * 300, "<|endoftext|> a.b, c. .", "é. É, x\x1cy\x00z\u0085w"]


def reference():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(BPE), special_tokens={})


def brute_bpe(text, enc):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 60), (64, 8)])
def test_byte_bpe_is_the_librarys(spark, data, chunk, overlap):
    enc = reference()
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, BPE, P.PATTERN, chunk=chunk, overlap=overlap), BPE)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == {i: brute_bpe(t, enc) for i, t in enumerate(texts)}


def test_chunks_meet_where_boundaries_agree(spark):
    text = " ".join(f"word{i} don't  {'!' * (i % 7)}\n" for i in range(300))
    whole = {m.end() for m in byte_bpe.pre_tokens(P.PATTERN).finditer(text)} | {0}
    parts = byte_bpe.chunks(text, 150, 50)
    found = [byte_bpe.boundaries(t, 150, 50, i + 1 == len(parts), P.PATTERN) for i, t in enumerate(parts)]
    schema = "uid long, part long, head array<int>, tail array<int>"
    rows = byte_bpe.stitched(spark.createDataFrame([(7, i, *f) for i, f in enumerate(found)], schema), 150).orderBy("part").collect()
    assert all(r.sound for r in rows) and rows[0].start == 0
    for r, after in zip(rows, rows[1:]):
        assert r.stop == 150 + after.start and r.part * 150 + r.stop in whole
    run = "x" * 1000  # one pre-token over many chunks: neighbours never agree
    parts = byte_bpe.chunks(run, 150, 50)
    found = [byte_bpe.boundaries(t, 150, 50, i + 1 == len(parts), P.PATTERN) for i, t in enumerate(parts)]
    assert not any(r.sound for r in byte_bpe.stitched(spark.createDataFrame([(7, i, *f) for i, f in enumerate(found)], schema), 150).collect())


def test_bytes_of_tokens(monkeypatch):
    monkeypatch.setattr(byte_bpe, "IDS_AT_ONCE", 7)
    tokens, enc = byte_bpe.TokenBytes(BPE), reference()
    for text in ODD:
        ids = np.array(enc.encode_ordinary(text), np.int64)
        assert tokens.joined(ids, tokens.lengths(ids)) == text.encode()
    for bad in (-1, 10**6):
        with pytest.raises(KeyError):
            tokens.lengths(np.array([5, bad]))


def test_the_library_sees_single_pre_tokens_only(monkeypatch):
    enc = reference()
    pieces = byte_bpe.Pieces(BPE, P.PATTERN)
    seen, plain = [], pieces.encode_one
    pieces.encode_one = lambda p: (seen.append(p), plain(p))[1]
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 40)
    for some in (ODD, ODD[::-1], ODD[3:9]):
        ids, ends = pieces.encode([pieces.find.findall(t) for t in some])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [enc.encode_ordinary(t) for t in some]
    assert seen and all(pieces.find.fullmatch(p) and len(pieces.find.findall(p)) == 1 for p in seen)


def test_pre_tokens_of_all_characters_are_the_librarys():
    enc = reference()
    find = byte_bpe.pre_tokens(P.PATTERN)
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 64):
        text = "".join(f"a{c}b {c}1" for c in chars[at : at + 64])
        assert [i for p in find.findall(text) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text), hex(at)


def test_byte_bpe_of_odd_rows(odd_docs, no_docs):
    enc = reference()
    found = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs, BPE, P.PATTERN), BPE)).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r) for r in found], key=key) == sorted([(r.doc_id, *brute_bpe(r.text, enc)) for r in odd_docs.collect()], key=key)
    assert byte_bpe.encode(no_docs, BPE, P.PATTERN).count() == 0


def brute_starts(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_as_the_tokenizer_has_them():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    known = token_files.WordIds(WORDS, 2)
    rng = np.random.default_rng(8)
    chars = [chr(c) for c in [*range(0x21, 0x180), 0x300, 0x301, 0x307, 0x1E9E, 0x3A3, 0x4E00, 0x1F600, 0x200B, 0xFB01, 0x2028] if c not in (0x85, 0xA0)] + list("aeiou'.,s") * 12
    for _ in range(4000):
        word = "".join(rng.choice(chars, rng.integers(1, 9)))
        ids, many = known.gather(np.array([known[word.encode()], 0, known[word.encode()]]))
        assert ids.tolist() == [*ids[: many[0]], 2, *ids[: many[0]]]
        assert ids[: many[0]].tolist() == whole.encode(word, add_special_tokens=False).ids, word


def test_words_are_lowered_and_marks_set_apart():
    from tokenizers import Tokenizer

    whole, known = Tokenizer.from_file(WORDS), token_files.WordIds(WORDS, 2)
    texts = [*ODD, None, "Ab, cD. e!? F) . é, 3. 4,5 x.,  G:\tH;\nend.", "A<|endoftext|>B, <|ENDOFTEXT|> <|startoftext|>", "<|EndOfText|> Up. Down", "…. a…, b"]
    for some in (texts, texts[:-3], texts[-1:], [""], [None]):
        numbers = np.fromiter(map(known.__getitem__, token_files.words_of(pa.array(some, pa.string()))), np.int64)
        ids, many = known.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(many)[numbers == 0]])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


def test_token_files(spark, data, monkeypatch):
    monkeypatch.setattr(token_files, "ROWS_OUT", 7)
    monkeypatch.setattr(token_files, "CACHE_WORDS", 900)  # caches turn over
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:80] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    path = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), token_files.new_path(spark), WORDS, 2)
    found = sorted(tuple(r) for r in token_files.starts(spark, path).collect())
    assert found == brute_starts(rows)
    some = token_files.read(spark, path, 10_001, 10_003)
    assert sorted(r.doc_id for r in some.collect()) == [10_001, 10_002, 10_003]
    assert "doc_id" in some._jdf.queryExecution().toString() and token_files.read(spark, path, tokens=False).columns == ["doc_id", "n_tokens", "crc"]


def test_token_files_are_delta_encoded_with_page_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(3000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), i -> md5(cast(id * 41 + i AS string))), ' ') AS text").coalesce(1)
    token_files.write(docs, str(tmp_path / "t"), WORDS, 2, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    ids = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("ids"))
    assert any("DELTA_BINARY_PACKED" in e for e in ids.encodings) and ids.has_column_index and ids.has_offset_index
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)


def test_token_files_of_odd_rows(spark, odd_docs, no_docs):
    path = token_files.write(odd_docs, token_files.new_path(spark), WORDS, 2)
    found = sorted((tuple(r) for r in token_files.starts(spark, path).collect()), key=lambda r: r[1])
    assert found == brute_starts([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert token_files.starts(spark, token_files.write(no_docs, token_files.new_path(spark), WORDS, 2)).count() == 0
