import hashlib

import public_tokenizers as P
import tiktoken

from inkwell.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, "a" * 3000, "  a \n\n b\t c  ", "\n \nb", " ", " x", "don't 's  's é\x1c\x1d y  z", "ab" * 700, " \n b", "a\n b", "12 345  6!!! ?\r\n", "日本語 テキスト 🙂", "word " * 50, "<|endoftext|>"]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(PATH)), special_tokens={})


def test_ids_are_the_library_s(spark, sf):
    enc = library()
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.encode(df, PATH, P.PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    for r in bpe.decode(encoded, PATH, P.PATTERN).collect():
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_round_trip_digests(spark):
    enc = library()
    df = spark.createDataFrame(list(enumerate(ODD)) + [(None, "a b"), (1, "")], "doc_id long, text string")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda t: enc.encode_ordinary(t or "")
    want = sorted(((d, len(ids(t)), sha(",".join(map(str, ids(t))).encode()), sha((t or "").encode())) for d, t in [*enumerate(ODD), (None, "a b"), (1, "")]), key=str)
    assert got == want
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_unknown_ids_are_refused():
    import numpy as np
    import pytest

    with pytest.raises((ValueError, IndexError)):
        bpe.codec(bpe.read_ranks(PATH), P.PATTERN).decode([np.array([50_256], np.int32)])


def test_long_words():
    """Words of one kind of pair, of many, and of overlapping and lower-ranked ones, against the library."""
    import random

    import numpy as np

    r, enc = random.Random(1), library()
    kit = bpe.codec(bpe.read_ranks(PATH), P.PATTERN)
    words = ["-" * 100_000, "".join(r.choice("中文的人是在了有我们天地不上大来到时") for _ in range(33_000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500))]
    words += ["".join(r.choice(r.choice(["aab", "-=", "abcd", "thein", "ab", "é中"])) for _ in range(r.randint(2, 90))) for _ in range(1500)]
    bs = [w.encode() for w in words if w.encode() not in kit.ranks]
    got = kit.merge_by_sql(bs, long=True)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [enc._core_bpe.encode_single_piece(b) for b in bs]
    short = [b for b in bs if len(b) <= bpe.LONG_WORD]
    assert kit.merge_by_sql(short) == kit.merge_by_sql(short, long=True)
