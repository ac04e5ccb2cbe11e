"""Operators 1, 4 and 8 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from common import by_row, no_docs, odd_docs, odd_rows, texts
from tessella.llm import piece_codec, sst_shards, token_counts
from tessella.llm.pieces_memo import PieceMemo
from tessella.llm.sst_format import Reader

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_strings(n=400):
    rng = random.Random(4)
    alphabet = "abcZÉßñΣσİ'’.,!?*#$%&|<>0129 \n\t\r\x0b\x1c 　é́▁\x00🎵ﬁ"
    fixed = ["don't we'll I'M", "<|endoftext|>x<|startoftext|>", "a\x1cb", "İstanbul.", "é.", "x.,", "it's.", "###abc***", "가 x"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_memo_equals_library(library):
    memo = PieceMemo(WORDS, memo_bytes=50_000)
    strings = odd_strings() + [t or "" for t in texts()]
    for text, got, count in zip(strings, memo.batch(strings), memo.counts(strings)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), text
        assert count == len(ids_of(library, text)), text
    assert memo.held <= 26_000 and memo.old


def test_memo_equals_library_for_every_letter_before_a_mark(library):
    """Letters that the library takes apart or puts together before it splits, among them the dotted capital I and nukta letters."""
    memo = PieceMemo(WORDS)
    letters = [chr(i) for i in (*range(0x80, 0xD800), *range(0xE000, 0x20000))]
    for mark in ".,":
        strings = [c + mark for c in letters]
        expected = library.encode_batch_fast(strings, add_special_tokens=False)
        for part in range(0, len(strings), 20_000):
            some = strings[part : part + 20_000]
            assert [np.frombuffer(x, "<u4").tolist() for x in memo.batch(some)] == [e.ids for e in expected[part : part + 20_000]]
    for text in ("İ.", "ŞİRKETİ, KEDİ. GİTTİ!", "ज़.", "h\u0331 H\u0331.", "K. Å, ẞ."):
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.batch([text])] == [ids_of(library, text)], text


def test_long_words_are_not_remembered(library):
    memo = PieceMemo(WORDS)
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(1_000_000))
    assert list(memo.counts([text])) == [len(ids_of(library, text))]
    assert memo.held == 0


def test_memo_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        PieceMemo(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk,overlap", [(400, 80), (64, 8)])
def test_counts(spark, library, chunk, overlap):
    got = token_counts.count_tokens(odd_docs(spark), WORDS, huge_chars=500, chunk_chars=chunk, overlap_chars=overlap, limit=30).collect()
    expected = [(r[0], len((r[1] or "").encode()), len(ids_of(library, r[1]))) for r in odd_rows()]
    assert by_row(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == by_row([dict(zip("abcd", (*e, e[2] > 30))) for e in expected], *"abcd")


def test_overlap_widens_until_it_aligns(spark, library):
    """No boundary lies in any first overlap, so the text is cut again and again."""
    text = "z" * 900 + " " + "y" * 900 + " end"
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = token_counts.count_tokens(rows, WORDS, huge_chars=100, chunk_chars=64, overlap_chars=16).first()
    assert got.n_tokens == len(ids_of(library, text))


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(no_docs(spark), WORDS).count() == 0


def test_agenda_equals_library():
    codec = piece_codec.PieceCodec(PIECES, memo_bytes=20_000)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    strings = odd_strings() + [t or "" for t in texts()]
    for text, (ids, decoded) in zip(strings, codec.batch(strings)):
        expected = lib.encode(text)
        assert ids == ",".join(map(str, expected)), text
        assert decoded == lib.decode(expected), text
    assert codec.held <= 11_000 and codec.old


def test_rows_of_agendas_equal_heaps():
    codec, rng = piece_codec.PieceCodec(PIECES), random.Random(3)
    units = ["▁" * rng.randint(0, 3) + "".join(rng.choice("etaoinshrdluéß가🎵'.") for _ in range(rng.randint(1, 30))) for _ in range(5_000)]
    assert codec.encoded(units) == [codec.agenda(u) for u in units]


def test_long_units_are_not_remembered():
    codec, lib = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "".join(random.Random(2).choice("日本語のテキストabc") for _ in range(60_000))
    ((ids, decoded),) = codec.batch([text])
    assert ids == ",".join(map(str, lib.encode(text))) and decoded == text and codec.held == 0


def test_encode_decode(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in odd_rows():
        ids = lib.encode(r[1] or "")
        expected.append({"doc_id": r[0], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(lib.decode(ids))})
    got = piece_codec.encode_decode(odd_docs(spark), PIECES).collect()
    assert by_row(got, *expected[0]) == by_row(expected, *expected[0])
    whole = piece_codec.encode_decode(odd_docs(spark), PIECES, digests=False).collect()
    assert by_row([{"i": r.doc_id, "ids": tuple(r.ids)} for r in whole], "i", "ids") == by_row(
        [{"i": r[0], "ids": tuple(lib.encode(r[1] or ""))} for r in odd_rows()], "i", "ids"
    )
    assert piece_codec.encode_decode(no_docs(spark), PIECES).count() == 0


def test_shards_read_back(spark, library):
    got = sst_shards.tokens_to_shards(odd_docs(spark), WORDS).collect()
    rows = []
    for r in odd_rows():
        ids = ids_of(library, r[1]) + [2]
        rows.append({"doc_id": r[0], "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == by_row(rows, "doc_id", "n_tokens", "ids_crc32")
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert sst_shards.tokens_to_shards(no_docs(spark), WORDS).count() == 0


def test_files_are_bounded_and_read_by_ranges(spark, library, tmp_path):
    manifest = sst_shards.write_shards(odd_docs(spark), str(tmp_path), WORDS, 2, n_parts=2, file_bytes=20_000, file_rows=7)
    files = manifest.collect()
    assert len(files) >= 6 and max(f.n_docs for f in files) <= 7
    rows = odd_rows()
    whole = sst_shards.read_shards(manifest, run_blocks=1).collect()
    assert len(whole) == len(rows) and sum(f.n_tokens for f in files) == sum(r.n_tokens for r in whole)
    for doc_id in (None, 3, 10, 12):
        expected = sorted(ids_of(library, r[1]) + [2] for r in rows if r[0] == doc_id)
        assert sorted(sst_shards.find(manifest, doc_id)) == expected
    assert sst_shards.find(manifest, 10**9) == []


def test_shards_split_one_repeated_row(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    from tessella.llm.common import scratch

    parts = sst_shards.write_shards(docs, scratch(spark, "repeated"), WORDS, 2, n_parts=12).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) == 12 and max(p.n for p in parts) < 600


def test_table_file_lookup():
    rng = random.Random(8)
    keys = sorted([None, None, -5, -5, 0, 7, 7, 7, *rng.sample(range(10, 10**12), 500)], key=lambda k: (k is not None, k))
    rows = [(k, np.array([rng.randrange(60000) for _ in range(rng.randint(0, 40))], "<u4").tobytes()) for k in keys]
    for width in (2, 4):
        data = sst_shards.memory_table(rows, width, block_bytes=700)
        assert [(k, v) for k, _, v in Reader.of(data).scan()] == rows
        for k in {k for k in keys}:
            assert sorted(sst_shards.lookup(data, k)) == sorted(np.frombuffer(v, "<u4").tolist() for i, v in rows if i == k)
        assert all(sst_shards.lookup(data, k) == [] for k in range(1, 7) if k not in keys)
        assert len(Reader.of(data).index) > 5
    damaged = bytearray(data)
    damaged[20] ^= 1
    with pytest.raises(ValueError):
        list(Reader.of(bytes(damaged)).scan())
