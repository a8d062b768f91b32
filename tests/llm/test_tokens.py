import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm.arrow_sequences import END_ID, Shard, WordTokenizer, default_tokenizer, read_sequences, write_sequences
from graphloom.llm.merge_dropout import Decoder, Encoder, decode, default_model, encode, model

TEXTS = ["", "a", " ", "  x  y ", "▁", "a▁b ▁ c", "\0", "\0▁ x", "<s> <0x0A>\n\nfoo", "☃☃ 日本", "x" * 300, "\n", "\t \n ", "The of river, and stone\nwinter  ïé"]


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def segment(rate, texts, seed=1, variant=0):
    encoder = Encoder(default_model(), rate, seed, 4)
    raw = [t.encode() for t in texts]
    ids, first = encoder(raw, np.full(len(raw), variant, np.uint64))
    assert Decoder(default_model())(ids, first) == raw
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_without_dropout_the_ids_are_those_of_the_library(documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = documents + [t for t in TEXTS if "▁" not in t]
    assert segment(0.0, texts) == library.encode(texts, num_threads=1)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_is_lossless_and_keyed(documents, rate):
    texts = documents[:40] + TEXTS
    plain, one = segment(0.0, texts), segment(rate, texts)
    assert one == segment(rate, texts) and one != plain
    assert sum(map(len, one)) > sum(map(len, plain))
    if rate < 1:
        assert one != segment(rate, texts, seed=2) and one != segment(rate, texts, variant=1)
    else:
        assert all(len(model(default_model()).output[i].decode(errors="replace")) <= 1 for ids in one for i in ids)


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_both_agendas_agree(documents, rate):
    pieces = model(default_model())
    words = sorted({w for t in documents[:20] for w in t.split() if len(w) > 1})[:300]
    for w in words:
        symbols = pieces.symbol[[ord(c) for c in " " + w]]
        key = zlib.crc32(w.encode())
        merged, count = pieces.merge(symbols[None, :], np.array([key], np.uint64), rate)
        assert merged.tolist() == pieces.segment(symbols.tolist(), key, rate) and count[0] == len(merged)


def test_occurrences_and_documents_have_their_own_segmentation(spark):
    word = "internationalization"
    docs = spark.createDataFrame([(i, f"{word} {word} {word}") for i in range(100)], "doc_id long, text string")
    output = model(default_model()).output
    seen = set()
    for r in encode(docs).collect():
        cuts = []
        for piece in (output[i].decode() for i in r.ids):
            if piece.startswith(" "):
                cuts.append([])
            cuts[-1].append(piece)
        seen |= {tuple(map(str.strip, c)) for c in cuts}
        assert len(cuts) == 3 and r.lossless
    assert len(seen) > 4


def test_shared_merges_change_nothing(documents, monkeypatch):
    texts = documents[:40] + TEXTS
    shared = segment(0.1, texts)
    monkeypatch.setattr(Encoder, "_differ", lambda self, path, n, inverse, keys: np.ones(len(inverse), bool))
    assert shared == segment(0.1, texts)


def test_encode_and_decode_tables(odd_docs, odd_rows, no_docs):
    coded = encode(odd_docs)
    rows = coded.collect()
    assert len(rows) == len(odd_rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    assert sorted(r.text for r in decode(coded).collect()) == sorted(t or "" for _, t in odd_rows)
    assert encode(no_docs).count() == 0 and decode(encode(no_docs)).count() == 0


ODD = ["", "abΣς ΣΑΣ İI", "x<|endoftext|>y <|startoftext|> <|end", "'s it's ’s", "é ́e 한ㅎ", "1²Ⅷ \x1c \x85 a b", "A\nB\tC  d"]


def test_words_give_the_ids_of_the_whole_text(documents):
    tokenizer = WordTokenizer(default_tokenizer())
    texts = documents + ODD
    ids, first = tokenizer([t.encode() for t in texts])
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_files(docs, rows, folder, length):
    """Files against the tokenizer on each text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    shards = write_sequences(docs, folder, length=length)
    got = read_sequences(shards, folder).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    stream = [library.encode(t or "", add_special_tokens=False).ids + [END_ID] for _, t in ordered]
    starts = np.cumsum([0, *map(len, stream)])
    crc = [zlib.crc32(np.array(s, "<u4").tobytes()) for s in stream]
    want = sorted((str(i), len(s), c) for (i, _), s, c in zip(ordered, stream, crc))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    single = [r for r in got if r.doc_id is not None and [i for i, _ in rows].count(r.doc_id) == 1]
    assert single and all(r.start == starts[[i for i, _ in ordered].index(r.doc_id)] for r in single)
    flat = []
    for n in sorted(r.shard for r in shards.collect()):
        shard = Shard(folder, n)
        for i in range(len(shard)):
            ids, mask = shard[i]
            assert len(ids) == len(mask) == length and (mask.all() or i == len(shard) - 1)
            flat += ids[mask].tolist()
    assert len(flat) == starts[-1]


def test_files_of_odd_rows(odd_docs, odd_rows, tmp_path):
    check_files(odd_docs, odd_rows, f"file://{tmp_path}", 16)


def test_files_of_given_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_files(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], f"file://{tmp_path}", 512)


def test_sequences_are_mapped_not_copied(spark, odd_docs, tmp_path):
    shards = write_sequences(odd_docs, f"file://{tmp_path}", length=64)
    shard = Shard(f"file://{tmp_path}", max(r.shard for r in shards.collect()))
    before = pa.total_allocated_bytes()
    views = [shard[i][0] for i in range(len(shard))]
    assert len(views) > 0 and all(v.base is not None for v in views) and pa.total_allocated_bytes() - before < 1000


def test_no_documents(no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    assert read_sequences(write_sequences(no_docs, folder), folder).count() == 0
