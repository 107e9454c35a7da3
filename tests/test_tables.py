import io
import tarfile

from pyspark.sql import functions as F

from marlstone.functions import codecs
from marlstone.operators import bench, frames as fr, tar
from marlstone.plans.compress import FrameOptions, compress_frames
from marlstone.sources import files
from marlstone.streaming.watch import watch_frames


def frames_table(spark, data: bytes, options=FrameOptions()):
    made = compress_frames(spark.createDataFrame([(1, data)], "k int, content binary"), "content", options)
    return made, fr.frames(made, "k", "frame")


def test_frame_tables(spark):
    made, parsed = frames_table(spark, b"abc" * 50_000, FrameOptions(block_checksum=True))
    f = parsed.first()
    assert (f.type, f.version, f.block_size_id, f.content_size, f.header_checksum_valid, f.error) == ("standard", 1, 4, 150_000, True, None)
    blocks = fr.blocks(parsed, "k").collect()
    assert len(blocks) == 3 and all(b.block_checksum_valid and b.original_size is None for b in blocks)
    assert sum(b.original_size for b in fr.sized_blocks(made, "k", "frame").collect()) == 150_000
    assert fr.sequences(made, "k", "frame").agg(F.sum(F.col("literal_length") + F.col("match_length"))).first()[0] == 150_000
    assert [x.name for x in fr.frame_fields(parsed, "k").orderBy("field_index").collect()] == ["magic", "flg", "bd", "content_size", "header_checksum"]
    assert fr.flag_bits(parsed, "k").count() == 10
    s = fr.statistics(parsed, "k").first()
    assert (s.n_frames, s.n_blocks, s.format) == (1, 3, "standard")


def test_unknown_data_is_one_frame(spark):
    r = fr.frames(spark.createDataFrame([(1, b"nothing of the kind")], "k int, c binary"), "k", "c").collect()
    assert [(x.type, x.total_bytes) for x in r] == [("unknown", 19)]


def test_concat_and_dump(spark):
    made = compress_frames(spark.createDataFrame([(1, b"a"), (2, b"b")], "k int, content binary")).withColumn("g", F.lit(1))
    both = fr.concat_frames(made, "g", "k", "frame").select(codecs.frame_decompress("frames").alias("d")).first().d
    assert both.data == b"ab"
    rows = fr.hex_dump(spark.createDataFrame([(1, b"hello \x00 world, and on")], "k int, c binary"), "k", "c").orderBy("offset").collect()
    assert [(r.offset, r.ascii) for r in rows] == [(0, "hello . world, a"), (16, "nd on")]


NAMES = ["a/b/one.txt", "a/two.txt", "root.txt", "x" * 60 + "/" + "y" * 80 + "/z.txt", "ü/name.txt", "p" * 170 + "/" + "q" * 140]


def test_tar_reads_elsewhere_and_back(spark):
    rows = [(1, i, n, f"data {i} ".encode() * (i * 90)) for i, n in enumerate(NAMES)]
    packed = tar.pack(spark.createDataFrame(rows, "g int, i int, name string, data binary"), "g", "i", "name", "data", 1234567890)
    raw = bytes(packed.first().archive)
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        got = {m.name: (m.mtime, t.extractfile(m).read()) for m in t if m.isfile()}
        assert {m.name for m in t if m.isdir()} >= {"a", "a/b"}
    assert got == {n: (1234567890, d) for _, _, n, d in rows}
    entries = tar.unpack(packed, "g", "archive").collect()
    assert {e.name: bytes(e.data) for e in entries if e.type == "0"} == {n: d for _, _, n, d in rows}
    assert all(e.checksum_valid for e in entries)
    s = tar.summary(tar.unpack(packed, "g", "archive"), "g").first()
    assert (s.n_files, s.total_bytes) == (6, sum(len(d) for *_, d in rows))


def test_foreign_archives_do_not_lose_their_place(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name in ("./" + "long/" * 60 + "a", "./sub/b"):
            info = tarfile.TarInfo(name)
            info.size = 700
            t.addfile(info, io.BytesIO(b"d" * 700))
    got = tar.unpack(spark.createDataFrame([(1, buf.getvalue())], "k int, a binary"), "k", "a").filter("type = '0'").collect()
    assert len(got) == 2 and got[0].name == "./" + "long/" * 60 + "a" and got[1].name == "./sub/b" and all(bytes(e.data) == b"d" * 700 for e in got)


def test_files_in_and_out(spark, tmp_path):
    docs = spark.createDataFrame([(1, b"first " * 100), (2, b"second " * 100)], "k int, content binary")
    made = compress_frames(docs).select(F.concat(F.lit("in/"), F.col("k").cast("string"), F.lit(".lz4")).alias("name"), F.col("frame").alias("data"))
    files.write_files(made, str(tmp_path))
    assert files.read_frames(spark, str(tmp_path)).filter("type = 'standard'").count() == 2
    found = files.read_files(spark, str(tmp_path), "*.lz4")
    assert sorted(r.relative for r in found.select("relative").collect()) == ["in/1.lz4", "in/2.lz4"]
    stream = watch_frames(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("watched").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ok, r.original_size) for r in spark.table("watched").collect()) == [(True, 600), (True, 700)]


def test_names_must_stay_in_the_folder(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="leaves the folder"):
        files.write_files(spark.createDataFrame([("../out", b"x")], "name string, data binary"), str(tmp_path / "in"))


def test_archives_are_extracted_by_base_name(spark, tmp_path):
    packed = tar.pack(spark.createDataFrame([(1, 0, "d/e/f.txt", b"hi"), (1, 1, "d/empty", b"")], "g int, i int, name string, data binary"), "g", "i", "name", "data")
    files.extract_tar(tar.unpack(packed, "g", "archive"), str(tmp_path))
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("f.txt", b"hi")]


def test_equal_base_names_stay_apart(spark, tmp_path):
    rows = [(1, 0, "d/f.txt", b"one"), (1, 1, "e/f.txt", b"two"), (1, 2, "g/bare", b"3"), (1, 3, "h/bare", b"4")]
    packed = tar.pack(spark.createDataFrame(rows, "g int, i int, name string, data binary"), "g", "i", "name", "data")
    made = compress_frames(packed, "archive").select(F.lit("a.tar.lz4").alias("name"), F.col("frame").alias("data"))
    files.write_files(made, str(tmp_path / "in"))
    files.write_files(packed.select(F.lit("b.tar").alias("name"), F.col("archive").alias("data")), str(tmp_path / "in2"))
    assert files.read_tar(spark, str(tmp_path / "in2")).filter("type = '0'").count() == 4
    files.extract_tar(files.read_tar(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"f.txt": b"one", "f (1).txt": b"two", "bare": b"3", "bare (1)": b"4"}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d").write_bytes(b"x" * 100 + b"y" * 65_535)
    assert files.read_dictionary(spark, str(tmp_path / "d")) == b"y" * 65_535


def test_bench_rows(spark):
    r = bench.results(spark, (1 << 10, 1 << 13)).collect()
    assert [x.input_size for x in r] == [(1 << 10) * bench.COPIES, (1 << 13) * bench.COPIES] and all(x.ratio > 1 for x in r)
