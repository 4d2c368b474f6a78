import hashlib
from collections import Counter

import public_tokenizers as P
import pyspark.sql.functions as F
import tiktoken

import corpus_pipeline as C
from inkwell.llm import bpe, langid, mixing, simhash, toxicity
from inkwell.llm.common import new_path

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src1", None), (None, "A text in plain words that has no id at all.", None, None, 1), (900_002, "12 %", "en", "src0", 4)], docs.schema)
    docs, columns = docs.unionByName(odd), docs.columns
    assert [n for n, _ in C.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE"]
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        got = rows(out)
        have = docs.collect()
        if i < 4:
            assert out.columns == columns, name
        if i == 0:
            fit = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").where(~langid.held_out()))
            judge = langid.Coder(tuple(sorted(fit.items())))
            assert got == Counter(tuple(r) for r in have if not judge.predict(r.text, langid.MARGIN)[2])
            assert not any(r[0] in (900_001, 900_002) for r in got)
        elif i == 1:
            model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ~toxicity.held_out())
            assert got == Counter(tuple(r) for r in have if toxicity.score_text(r.text, *model, {}) < 0.7)
        elif i == 2:
            found = simhash.near_duplicates(docs).collect()
            assert sum(got.values()) == len({r.root for r in found}) and set(got) <= {tuple(r) for r in have}
            assert {r[0] for r in got} == {r.component_id for r in found}
        elif i == 3:
            aims = {(r.doc_id, r.size): r for r in mixing.mix(docs, mixing.words(), mixing.quality_weight(F.coalesce("text", F.lit("")))).collect()}
            copies = Counter()
            for r in have:
                a = next(v for (d, _), v in aims.items() if d == r.doc_id)
                copies[tuple(r)] += int(a.taken / a.size + 0.5) if a.size else 0
            assert got == +copies
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(PATH)), special_tokens={})
            want = Counter()
            for r in have:
                ids = enc.encode_ordinary(r.text)
                want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
            assert got == want
        path = new_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_run_is_repeatable_and_handles_no_rows(spark, sf):
    assert rows(C.run(spark, sf)) == rows(C.run(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else None


def test_clashing_columns(spark, sf, tmp_path):
    """Tables with more columns, of names that the operators use inside, give the same rows."""
    names = "chosen of_group place id mark fp root print n least rank of score kept rest copy words copies size target ids label".split()
    folder = f"file://{tmp_path}"
    for table in ("documents", "labels"):
        df = spark.read.parquet(f"{sf}/{table}.parquet").limit(120)
        df.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(names)]).write.parquet(f"{folder}/wide/{table}.parquet")
        spark.read.parquet(f"{folder}/wide/{table}.parquet").select(df.columns).write.parquet(f"{folder}/slim/{table}.parquet")
    assert rows(C.run(spark, f"{folder}/wide")) == rows(C.run(spark, f"{folder}/slim"))
    assert rows(langid.op3_langid(spark, f"{folder}/wide")) == rows(langid.op3_langid(spark, f"{folder}/slim"))
