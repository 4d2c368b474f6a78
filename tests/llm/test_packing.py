import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


LATIN = "aéßÿÀÞøİıſŉĄ'sdvm9²¼ªº× ,.-"
ODD = "\x01aZ é İIKſß'sT9٣ \t\n\x0b\x85 ,.!—́̇ͅ中ﷺΣσ<|>endoftext😀\x1c"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(ODD, max_size=30), st.text(LATIN, max_size=30), st.text(max_size=20)), min_size=1, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(P, "_t") else P._t
    P._t = t
    t.encode_special_tokens = True
    e = P._e = getattr(P, "_e", None) or P.Encoder(PATH)
    ids, bounds = e.encode(pa.array(texts, pa.string()), 1)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_few_words_kept_change_nothing(whole, monkeypatch):
    monkeypatch.setattr(P, "MOST_WORDS", 3)
    e = P.Encoder(PATH)
    for text in ("one two three four five", "two six", "", "one one"):
        ids, bounds = e.encode(pa.array(["", text, ""]), 1)
        assert ids.tolist() == [1, *whole(text), 1, 1] and bounds.tolist() == [0, 1, len(ids) - 1, len(ids)]


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(axes, bits):
    points = np.array(list(product(range(1 << bits), repeat=axes)))
    keys = P.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))  # every place once
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()  # each step to a neighbour


def checked(rows, got, whole, length):
    """All contract conditions, against whole texts encoded at once."""
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append([*whole(text or ""), 1])
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    total = 0
    for i, texts in want.items():
        for ids in texts:
            same = sum(len(x) == len(ids) for x in texts)
            pieces = docs[i, len(ids)]
            assert sum(p.length for p in pieces) == len(ids) * same
            if same == 1:
                flat = np.array(ids, "<u4")
                for p in pieces:
                    assert bytes(p.ids) == flat[p.start : p.start + p.length].tobytes()
                assert sorted(x for p in pieces for x in range(p.start, p.start + p.length)) == list(range(len(ids)))
            total += len(ids)
    assert sum(r.length for r in got) == total


def table():
    rng = np.random.default_rng(5)
    topics = [["river", "water", "boat", "fish"], ["engine", "motor", "wheel", "oil"], ["haus", "straße", "über", "nicht"]]
    rows = [(i, " ".join(rng.choice(topics[i % 3], rng.integers(5, 90)))) for i in range(150)]
    return rows + [(i, "the same copy again and again") for i in range(200, 290)] + [(7, "again"), (7, "again"), (None, "no id"), (None, None), (300, ""), (301, None), (302, "long text, " * 3000)]


def test_pieces(spark, whole):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.pack(df, PATH, 64, parts=5).collect()
    checked(rows, got, whole, 64)
    wide = df.selectExpr("*", *[f"1 AS {c}" for c in "n key ids tie number range part start length offset".split()])
    assert sorted(P.pack(wide.repartition(7), PATH, 64, parts=2).collect(), key=str) == sorted(got, key=str)
    seqs = P.sequences(P.pack(df, PATH, 64), 64).collect()
    assert all(s.padded == s.tokens and len(s.ids) == 4 * s.tokens for s in seqs) and sum(s.tokens for s in seqs) == sum(r.length for r in got)


def test_neighbours_are_alike(spark):
    rows = [r for r in table() if r[0] is not None and r[0] < 150][:150]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 64).where("start = 0").orderBy("sequence_id", "offset").collect()
    topics = [r.doc_id % 3 for r in got if r.doc_id != 7]
    assert sum(a == b for a, b in zip(topics, topics[1:], strict=False)) > 0.85 * len(topics)  # by chance: a third


def test_padding_of_other_lengths(spark):
    pieces = spark.createDataFrame([(0, 0, 3, b"\1\0\0\0" * 3), (1, 0, 4, b"\2\0\0\0" * 4)], "sequence_id long, offset long, length long, ids binary")
    found = {r.sequence_id: (r.padded, bytes(r.ids)) for r in P.sequences(pieces, 8, 9).collect()}
    assert found == {0: (8, b"\1\0\0\0" * 3 + b"\11\0\0\0" * 5), 1: (4, b"\2\0\0\0" * 4)}


def test_no_rows(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.op13_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {r.doc_id: np.array([*whole(r.text), 1], "<u4") for r in docs.collect()}
    rows = got.collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert got.agg(F.max("sequence_id")).first()[0] + 1 == len({r.sequence_id for r in rows})
