"""Operator 13 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from common import by_row, no_docs, odd_docs, odd_rows
from tessella.llm import byte_codec
from tessella.llm.prefix_bpe import PrefixBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_prefixes_against_the_library(library):
    bpe, rng = PrefixBpe(PATH, memo_bytes=20_000), random.Random(1)
    pools = ["ab", "aA ", "a1 .'sé", "\x1c\x1d\x85\xa0\u2028\u3000 a", "thereinonatist ", "的一是中文é🎵éﬁ٣ⅷ１\u200b\xad", "0123456789", "\n\r\t  x", "<|endoftext|>"]
    for _ in range(1_500):
        pool = rng.choice(pools) + rng.choice(["", *pools])
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.2:
            text = text[:9] + "<|endoftext|>" + text[9:] + "<|endoftext|>" * rng.randint(0, 2)
        ids = bpe.encode(text)
        assert ids == ids_of(library, text), text
        assert bpe.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_every_prefix_has_one_last_token():
    """What the dynamic program rests on: of the tokens that end a prefix, only one is compatible with what stands before."""
    bpe, rng = PrefixBpe(PATH), random.Random(2)
    v = bpe.vocabulary
    token_of = {b: i for i, b in v.bytes_of.items() if i in v.reachable}
    for _ in range(60):
        raw = "".join(rng.choice("aehinrst") for _ in range(14)).encode()
        for end in range(1, len(raw) + 1):
            fits = []
            for at in range(end):
                t = token_of.get(raw[at:end])
                if t is not None and (at == 0 or v.compatible(bpe.piece(raw[:at])[-1], t)):
                    fits.append(t)
            assert fits == [bpe.piece(raw[:end])[-1]]


def test_bytes_that_are_no_text_decode_as_in_the_library(library):
    bpe, rng = PrefixBpe(PATH), random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(np.array(ids, dtype="<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_piece(library):
    bpe = PrefixBpe(PATH)
    for text in ("x" * 100_000, "".join(random.Random(3).choice("abcdeth") for _ in range(60_000))):
        assert bpe.encode(text) == ids_of(library, text)


def test_other_vocabularies_raise():
    with pytest.raises(ValueError):
        PrefixBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_query_against_the_library(spark, library):
    expected = by_row([], "doc_id")
    for r in odd_rows():
        ids = ids_of(library, r[1])
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        expected[(r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert by_row(byte_codec.encode_decode(odd_docs(spark), PATH).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert byte_codec.encode_decode(no_docs(spark), PATH).count() == 0
    back = byte_codec.decode(byte_codec.encode(odd_docs(spark), PATH), PATH)
    assert by_row(back.collect(), "doc_id", "text") == by_row([{"doc_id": r[0], "text": r[1] or ""} for r in odd_rows()], "doc_id", "text")
