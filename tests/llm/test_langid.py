import zlib

import pyspark.sql.functions as F

from inkwell.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the house with the other dogs of the town\n"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er von dem haus mit den anderen hunden weg\n"


def rows():
    out = [(i, (EN if i % 2 else DE) * (1 + i % 3) + f"zeile {i} line", "en" if i % 2 else "de") for i in range(1, 60)]
    return out + [(60, None, "en"), (61, "", "de"), (62, "12 34 !!", "en"), (63, "the dogs of the house", None), (None, "der hund und das haus", "de"), (63, "the dogs of the house", None)]


def test_learns_only_from_training_rows_and_defines_odd_ones(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    d = L.fit(df.where(~L.held_out()))
    assert sorted(d) == ["de", "en"]
    got = L.identify(df, d).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in range(1, 60):
        assert by[i][0].lang_pred == ("en" if i % 2 else "de") and 0 <= by[i][0].score <= 1 and not by[i][0].rejected
    for i in (60, 61, 62):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].rejected) == ("und", 0.0, True)
    assert [r.lang_pred for r in by[63]] == ["en", "en"] and by[None][0].lang_pred == "de"


def test_narrow_margins_are_rejected(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    d = L.fit(df)
    assert all(r.rejected for r in L.identify(df, d, margin=0.9).collect())


def test_copies_of_an_id_take_one_place_of_the_sample(spark):
    own = {i: f"the line with {chr(96 + i) * 5} of its own" for i in range(1, 21)}
    df = spark.createDataFrame([(i, t, "en") for i, t in own.items() for _ in range(300)], "doc_id long, text string, lang string")
    assert sorted(L.fit(df)["en"].decode().split("\n")) == sorted(own.values())


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    assert L.fit(df.limit(0)) == {}
    assert {r.lang_pred for r in L.identify(df, {}).collect()} == {"und"}
    assert L.identify(df.limit(0), L.fit(df)).count() == 0


CLASHES = "chosen string, of_group string, place string, id string, rank int, of int, rest string, kept string, lang_pred string, score string, rejected string"


def test_clashing_columns_and_long_texts(spark):
    df = spark.createDataFrame(rows() + [(70, EN * 3000, None)], "doc_id long, text string, lang string")
    wide = df.selectExpr("*", *[f"CAST(1 AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASHES.split(", ")])
    d = L.fit(df)
    assert L.fit(wide) == d
    assert sorted(map(str, L.identify(wide, d).collect())) == sorted(map(str, L.identify(df, d).collect()))
    kept = L.identify(wide, d, keep=True).select(F.col("lang_pred").alias("found"), "kept.*")
    assert kept.columns[1:] == wide.columns and kept.where("doc_id = 70").first().found == "en"


def test_predictions_equal_plain_compression(spark):
    """Brute force: encode every block with every dictionary, and take the least sum."""
    import re

    import zstandard as z

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    d = L.fit(df)
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in L.identify(df, d).collect())
    want = []
    for i, text, _ in rows():
        flat = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
        sizes = {}
        for lang in sorted(d):
            coder = z.ZstdCompressor(level=9, dict_data=z.ZstdCompressionDict(d[lang], dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(flat[a : a + 8192])) for a in range(0, len(flat), 8192))
        best, second = sorted(sizes.items(), key=lambda x: x[1])[:2]
        lead = (second[1] - best[1]) / max(1, second[1])
        want.append((str(i), best[0], round(lead / (lead + 0.02), 9)) if flat else (str(i), "und", 0.0))
    assert got == sorted(want)


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in L.op3_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(docs) == len(got)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    test = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in test) >= 0.93 * len(test)


def test_lines_from_all_over_long_texts(spark):
    """A long text gives lines from its end too, and more classes than a model takes leave the rarest out."""
    text = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long english text about rivers" for i in range(5000))
    one = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} der deutschen sprache" for i in range(4000))
    df = spark.createDataFrame([(1, text, "en"), (2, one, "de")], "doc_id long, text string, lang string")
    found = L.fit(df)
    assert set(found) == {"en", "de"} and 10_000 < len(found["en"]) <= 21_000 and 10_000 < len(found["de"]) <= 21_000
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "concat('l', id % 1500) AS lang").unionByName(spark.range(5000, 5003).selectExpr("id AS doc_id", "'more text' AS text", "'z' AS lang"))
    assert len(L.fit(many)) == 1000 and "z" in L.fit(many)
