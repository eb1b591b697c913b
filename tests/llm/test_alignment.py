"""Links and groups of two tokenizers' tokens against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import pytest

from agropanel.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a  b\n\n c", "don't we'll", "x" * 3000, " " * 700, "\n" * 300 + "é", "日本語のテキスト 12", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b",
    "é ﬁ　x", "\x00a\tb", "word " * 400, "tail ", "🙂🙂 naïve", None,
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def brute(rows):
    t, s = libraries()
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in chars)}
    docs, counts = [], Counter()
    for doc, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        bytes_a = [bytes(value[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(s.id_to_piece(i)[3:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc, [], [], [], []))
            continue
        at_a, at_b = spans(map(len, bytes_a)), spans(map(len, bytes_b))
        links, j = [], 0
        for i, (x, y) in enumerate(at_a):
            while at_b[j][1] <= x:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][0] < y:
                links.append((a[i], b[k]))
                k += 1
        ends = sorted({y for _, y in at_a} & {y for _, y in at_b})
        groups, low = [], 0
        for end in ends:
            groups.append((",".join(str(i) for i, (x, _) in zip(a, at_a) if low <= x < end), ",".join(str(i) for i, (x, _) in zip(b, at_b) if low <= x < end)))
            low = end
        counts.update(set(links))
        docs.append((doc, a, b, links, groups))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (doc, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if a else "")
        for doc, a, b, links, groups in docs
    ]


def rows_of(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("block,batch,cache,chunk", [(alignment.BLOCK_BYTES, alignment.BATCH_BYTES, alignment.CACHE_WORDS, alignment.CHUNK), (9000, 2000, 50, 90)])
def test_alignment_is_the_plain_loops(spark, data, monkeypatch, block, batch, cache, chunk):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)
    monkeypatch.setattr(alignment, "CACHE_WORDS", cache)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    texts = [r.text[:6000] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = list(enumerate(ODD + texts + texts[:3]))
    found = rows_of(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B))
    assert found == sorted(brute(rows), key=lambda r: (r[0] is None, r))
    assert found[9][1:] == (0, 0, 0, 0, 0, 0, "")  # U+2581 comes back as a space


@pytest.mark.parametrize("cuttable", [True, False])
def test_words_keep_the_tokens(spark, data, cuttable):
    t, s = libraries()
    texts = ["  two  spaces, one word's end.\nnext line a" + " mixed 12é words 🙂 and  more" * 300, *ODD[:9], *ODD[10:], "a ", "a  ", " a", "12 345 x1 \u00b2 3", "a\u00a0b c", ". ' s", "it 's _ x_ y"]
    texts += [r.text[:3000] for r in spark.read.parquet(f"{data}/documents.parquet").limit(50).collect()]
    tokens = alignment.Tokens(alignment.byte_side(A), alignment.piece_side(B)[0], alignment.piece_side(B)[1] and cuttable)
    for _ in range(2):  # new words, then known ones
        found = tokens.encode(texts)
        for i, text in enumerate(texts):
            assert found.a[found.doc_a == i].tolist() == (t.encode(" " + text, add_special_tokens=False).ids if text else []), text
            assert found.b[found.doc_b == i].tolist() == (s.encode(text) if text else []), text


def test_alignment_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (11, 12)]
    found = rows_of(alignment.align(odd_docs.where("doc_id IS NULL OR doc_id NOT IN (11, 12)"), A, B))
    assert found == sorted(brute(rows), key=lambda r: (r[0] is None, r))
    assert alignment.align(no_docs, A, B).count() == 0
    assert alignment.align(odd_docs, A, B).count() == odd_docs.count()
