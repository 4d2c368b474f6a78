import hashlib
import io
import tarfile
import zlib

from inkwell.llm import media as M

ROWS = [(1, "abc"), (2, ""), (3, None), (4, "x" * 64), (5, "é" * 40), (6, "abc"), (6, "abc"), (None, "line\n" * 5000)]


def frame(spark):
    return spark.createDataFrame([(d, t, "s") for d, t in ROWS], "doc_id long, text string, digest string").repartition(3)


def test_padding_and_png():
    assert [len(M.padded(b"x" * n)) for n in (0, 1, 63, 64, 65, 128)] == [64, 64, 64, 64, 128, 128]
    for n in (0, 5, 64, 1000):
        p = M.padded(bytes(range(256)) * n)[: max(64, n * 64)]
        assert M.from_png(M.to_png(p)) == p


def test_rows_equal_brute_force(spark):
    got = M.media_columns(frame(spark)).collect()
    assert len(got) == len(ROWS)
    seen = {}
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), ROWS, strict=True):
        raw = (t or "").encode()
        p = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        png = M.to_png(p)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (d, len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest())
        shares = ",".join(str(sum(b // 32 == k for b in p) * 1000 // len(p)) for k in range(8))
        assert r.feature == f"64x{len(p) // 64};mean={sum(p) // len(p)};{shares}"
        assert (r.width, r.height, r.bits, r.length) == (64, len(p) // 64, 8, len(png)) and r.digest == r.media_sha256
        assert seen.setdefault(p, (r.feature, r.shard, r.offset)) == (r.feature, r.shard, r.offset)


def test_headers_alone_give_the_same_metadata(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    places = spark.createDataFrame(M.catalogue(spark.createDataFrame(M.store(frame(spark), folder).collect())).collect())
    by = {r.digest: (r.width, r.height, r.bits) for r in M.features(places, folder).collect()}
    assert by and {r.digest: (r.width, r.height, r.bits) for r in M.headers(places, folder).collect()} == by


def test_shards_are_tar_files(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = M.store(frame(spark), folder).collect()
    members = {}
    for f in (tmp_path / "store").iterdir():
        with tarfile.open(f) as t:
            names = t.getnames()
            assert len(names) == len(set(names))
            for m in t.getmembers():
                members[f.name, m.name] = t.extractfile(m).read()
    for r in rows:
        assert hashlib.sha256(members[r.shard, f"{r.digest}.png"]).hexdigest() == r.digest
        raw = (tmp_path / "store" / r.shard).read_bytes()
        assert raw[r.offset : r.offset + r.length] == members[r.shard, f"{r.digest}.png"]


def test_header_reads_only_the_header(spark):
    reads = []

    class File(io.BytesIO):
        def read_at(self, n, at):
            reads.append((n, at))
            return self.getvalue()[at : at + n]

    assert M.png_header(File(M.to_png(bytes(640))).read_at(M.HEADER, 0)) == (64, 10, 8) and reads == [(33, 0)]


def test_no_rows(spark):
    assert M.media_columns(frame(spark).limit(0)).count() == 0


def test_half_the_texts_are_null(spark):
    rows = [(i, None if i % 2 else f"text {i}", 1, "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int, digest string")
    got = {r.doc_id: (r.n_bytes, r.payload_sha256) for r in M.media_columns(df).collect()}
    assert len(got) == 3000
    for i, text, _, _ in rows:
        raw = (text or "").encode()
        assert got[i] == (len(raw), hashlib.sha256(M.padded(raw)).hexdigest())
