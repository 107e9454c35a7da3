"""Registered queries of the codec engine, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import codecs, columns as C
from .operators import bench, frames as fr, tar
from .plans.compress import FrameOptions, compress_frames, compress_legacy, decompress_blocks
from .sources.files import read_files

Q: dict = {}
SQL: dict[str, str] = {}
#: A dictionary of small JSON records, for the dictionary queries.
DICTIONARY = b'"type": "click", "type": "view", "type": "purchase", "type": "signup", {"event": 1, "user": 12, "type": "view", "props": {"k": 1}}' * 4
MD5 = "md5(coalesce(text, ''))"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Arrow batches of at most `rows` cells and about `size` bytes, unless the session asks for fewer: what a Python worker holds at a time.

    These are settings of the session, read when a job runs; queries set them, functions and plans leave sessions alone.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        found = spark.conf.get(name)
        if not (found.rstrip("bB").isdigit() and 0 < int(found.rstrip("bB")) <= most):
            spark.conf.set(name, str(most))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions (small files of one row group); larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), "lang", "source")


#: A shard of texts: those of one language with the same doc_id // 200, so a cell is bounded whatever the size of a language.
_SHARD = "coalesce(lang, '') || '-' || {}"


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    """One cell for each shard: its texts in order, so that frames have several blocks."""
    rows = _docs(spark, sf).withColumn("shard", F.expr(_SHARD.format("doc_id div 200")))
    return rows.groupBy("shard").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY doc_id)").alias("content"))


def _framed(spark, sf, options: FrameOptions = FrameOptions()) -> DataFrame:
    return compress_frames(_docs(spark, sf), "content", options)


def _md5_back(frames: DataFrame, dictionary: bytes = b"") -> DataFrame:
    d = frames.withColumn("d", codecs.frame_decompress("frame", dictionary))
    return d.select("doc_id", F.md5("d.data").alias("digest"), F.coalesce("d.error", F.lit("")).alias("error"))


@query("SELECT lang, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_errors FROM documents GROUP BY lang")
def roundtrip_totals(spark, sf):
    """Documents -> frames -> content -> totals of each language."""
    rows = _framed(spark, sf).select("lang", codecs.frame_decompress("frame").alias("d"))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("d.data")).cast("long").alias("n_bytes"), F.count_if(F.col("d.error").isNotNull()).alias("n_errors")
    )


def _levels(levels):
    def run(spark, sf):
        out = None
        for level in levels:
            one = _md5_back(_framed(spark, sf, FrameOptions(level=level))).withColumn("level", F.lit(level).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out

    return run


Q["roundtrip_levels"] = _levels((1, 3, 6, 9, 12))
SQL["roundtrip_levels"] = f"SELECT doc_id, {MD5} AS digest, '' AS error, CAST(level AS BIGINT) AS level FROM documents, (VALUES (1), (3), (6), (9), (12)) v(level)"
Q["roundtrip_acceleration"] = _levels((-5, -20))
SQL["roundtrip_acceleration"] = f"SELECT doc_id, {MD5} AS digest, '' AS error, CAST(level AS BIGINT) AS level FROM documents, (VALUES (-5), (-20)) v(level)"


@query(f"SELECT doc_id, {MD5} AS digest, '' AS error, i AS variant FROM documents, range(5) r(i)")
def roundtrip_options(spark, sf):
    """Frame options: checksums, sizes, block sizes, linked flag, dictionary id."""
    options = [
        FrameOptions(content_size=False, content_checksum=False),
        FrameOptions(block_checksum=True),
        FrameOptions(block_size_id=7, content_checksum=False),
        FrameOptions(independent=False),
        FrameOptions(block_size_id=5, dict_id=77, block_checksum=True, level=9),
    ]
    out = None
    for i, o in enumerate(options):
        one = _md5_back(_framed(spark, sf, o)).withColumn("variant", F.lit(i).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


_RECORD = """'{"event": ' || event_id || ', "user": ' || user_id || ', "type": "' || event_type || '", "props": ' || coalesce(props, '{}') || '}'"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as small JSON records."""
    return _t(spark, sf, "events").select("event_id", F.encode(F.expr(_RECORD), "utf-8").alias("content"))


@query(f"SELECT event_id, md5({_RECORD}) AS digest, '' AS error FROM events")
def roundtrip_dictionary(spark, sf):
    """Small records with a dictionary."""
    rows = _records(spark, sf)
    made = compress_frames(rows, "content", FrameOptions(dictionary=DICTIONARY, content_checksum=False))
    d = made.withColumn("d", codecs.frame_decompress("frame", DICTIONARY))
    return d.select("event_id", F.md5("d.data").alias("digest"), F.coalesce("d.error", F.lit("")).alias("error"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def block_roundtrip(spark, sf):
    """Plain blocks, fast and deep, decoded alike."""
    n = F.octet_length("content").alias("n")
    rows = _docs(spark, sf).select("doc_id", n, codecs.block_compress("content").alias("fast"), codecs.block_compress("content", 9).alias("deep"))
    d = rows.select("doc_id", codecs.block_decompress("fast", F.col("n")).alias("a"), codecs.block_decompress("deep", F.col("n")).alias("b"))
    right = F.col("a.error").isNull() & F.col("b.error").isNull() & (F.col("a.data") == F.col("b.data"))
    return d.select("doc_id", F.when(right, F.md5("a.data")).alias("digest"))


@query("SELECT doc_id, CAST(n + n // 255 + 16 AS BIGINT) AS bound, CAST(0 AS BIGINT) AS too_large FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def compress_bounds(spark, sf):
    """L4."""
    return _docs(spark, sf).select("doc_id", C.compress_bound(F.octet_length("content")).alias("bound"), C.compress_bound(F.lit(0x7E000001)).alias("too_large"))


_SHARD_SQL = _SHARD.format("doc_id // 200")


@query(f"""WITH l AS (SELECT {_SHARD_SQL} AS shard, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n FROM documents GROUP BY 1)
SELECT shard, CAST(i AS BIGINT) AS block_index, least(65536, n - 65536 * i) AS original_size FROM (SELECT shard, n, unnest(range((n + 65535) // 65536)) AS i FROM l)""")
def block_table(spark, sf):
    """Multi-block frames: parsed blocks with decoded sizes."""
    made = compress_frames(_shards(spark, sf), "content")
    return fr.sized_blocks(made, "shard", "frame").select("shard", F.col("block_index").cast("long").alias("block_index"), "original_size")


@query(f"SELECT {_SHARD_SQL} AS shard, md5(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS digest, CAST((sum(strlen(coalesce(text, ''))) + 65535) // 65536 AS BIGINT) AS n_blocks, '' AS error FROM documents GROUP BY 1")
def parallel_roundtrip(spark, sf):
    """Block-parallel compression and decompression."""
    made = compress_frames(_shards(spark, sf), "content", FrameOptions(block_checksum=True))
    d = decompress_blocks(made)
    return d.select("shard", F.md5("data").alias("digest"), "n_blocks", F.coalesce("error", F.lit("")).alias("error"))


@query("SELECT doc_id, strlen(coalesce(text, '')) > 4096 AS large, md5(coalesce(text, '')) AS digest FROM documents")
def size_routing(spark, sf):
    """Large cells go block by block over all tasks, small ones whole; one result."""
    made = compress_frames(_docs(spark, sf), "content", split_over=4096)
    return made.select("doc_id", (F.col("original_size") > 4096).alias("large"), F.md5(codecs.frame_decompress("frame")["data"]).alias("digest"))


def _xxh32_sql(source: str) -> str:
    """SQL for (id, h): XXH32 of the hexadecimal texts x of n bytes in source (id, x, n), by the algorithm's definition."""
    word = "('0x' || x[8*i+7:8*i+8] || x[8*i+5:8*i+6] || x[8*i+3:8*i+4] || x[8*i+1:8*i+2])::BIGINT::HUGEINT"
    m, p1, p2, p3, p4, p5 = 4294967296, 2654435761, 2246822519, 3266489917, 668265263, 374761393
    turned = lambda v, r: f"(({v}) % {m} * {1 << r} % {m} + ({v}) % {m} // {1 << 32 - r})"
    starts = ((p1 + p2) % m, p2, 0, (m - p1) % m)
    lanes = ", ".join(
        f"list_reduce(list_transform(range(n // 16), lambda k: w[4 * k + {j + 1}]), lambda a, x: {turned(f'a + x * {p2}', 13)} * {p1} % {m}, {s}::HUGEINT) AS v{j}" for j, s in enumerate(starts)
    )
    joined = " + ".join(turned(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18)))
    return f"""WITH b AS ({source}),
words AS (SELECT id, n, list_transform(range(n // 4), lambda i: {word}) AS w, list_transform(range(4 * (n // 4), n), lambda i: ('0x' || x[2*i+1:2*i+2])::BIGINT::HUGEINT) AS ts FROM b),
lanes AS (SELECT *, {lanes} FROM words),
h0 AS (SELECT id, ts, w[4 * (n // 16) + 1:] AS ws, ((CASE WHEN n < 16 THEN {p5} ELSE {joined} END + n) % {m})::HUGEINT AS h FROM lanes),
h1 AS (SELECT id, ts, list_reduce(ws, lambda a, x: {turned(f"a + x * {p3}", 17)} % {m} * {p4} % {m}, h) AS h FROM h0),
h2 AS (SELECT id, list_reduce(ts, lambda a, x: {turned(f"a + x * {p5}", 11)} % {m} * {p1} % {m}, h) AS h FROM h1),
h3 AS (SELECT id, (xor(h::BIGINT, h::BIGINT >> 15)::HUGEINT * {p2} % {m})::BIGINT AS h FROM h2),
h4 AS (SELECT id, (xor(h, h >> 13)::HUGEINT * {p3} % {m})::BIGINT AS h FROM h3)
SELECT id, xor(h, h >> 16) AS h FROM h4"""


@query(f"""SELECT id AS name, h AS native, h AS arrow FROM ({_xxh32_sql("SELECT n_name AS id, hex(encode(n_name)) AS x, strlen(n_name) AS n FROM nation WHERE strlen(n_name) < 16")})""")
def xxh32_names(spark, sf):
    """XXH32 in expressions and as an Arrow function (H1-H3)."""
    names = _t(spark, sf, "nation").filter(F.octet_length("n_name") < 16)
    data = F.encode("n_name", "utf-8")
    return names.select(F.col("n_name").alias("name"), C.xxh32_short(data).alias("native"), codecs.xxh32(data).alias("arrow"))


_HEX = "SELECT doc_id AS id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents"


@query(f"SELECT id AS doc_id, h AS xxh32 FROM ({_xxh32_sql(_HEX)})")
def xxh32_documents(spark, sf):
    """XXH32 of whole texts (H1, H6)."""
    return _docs(spark, sf).select("doc_id", codecs.xxh32("content").alias("xxh32"))


@query("""SELECT doc_id, '04224d18' || '6840' || n AS head, true AS valid FROM (SELECT doc_id, lower(
  list_reduce(list_transform(range(8), lambda i: printf('%02x', (s >> (8 * i)) & 255)), lambda a, b: a || b)) AS n FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS s FROM documents))""")
def frame_headers(spark, sf):
    """Header bytes in expressions, and the checksum verdict of the parser."""
    made = _framed(spark, sf, FrameOptions(content_checksum=False))
    native = C.frame_header(F.col("original_size"), content_checksum=False)  # expressions only, checksum byte included
    head = F.lower(F.hex(F.substring("frame", 1, 14)))
    valid = (F.substring("frame", 1, 15) == native) & codecs.walk_frames("frame")[0]["header_checksum_valid"]
    return made.select("doc_id", head.alias("head"), valid.alias("valid"))


@query("""SELECT doc_id, 0 AS frame_index, 'standard' AS type, CAST(0 AS BIGINT) AS "offset", CAST(407708164 AS BIGINT) AS magic, 1 AS version, true AS block_independent, true AS block_checksum,
 true AS content_size_flag, true AS content_checksum_flag, false AS has_dict_id, 5 AS block_size_id, CAST(262144 AS BIGINT) AS block_max_size,
 CAST(strlen(coalesce(text, '')) AS BIGINT) AS content_size, true AS header_checksum_valid, CAST((strlen(coalesce(text, '')) + 262143) // 262144 AS BIGINT) AS n_blocks FROM documents""")
def parsed_frames(spark, sf):
    """The frames table."""
    parsed = fr.frames(_framed(spark, sf, FrameOptions(block_size_id=5, block_checksum=True)), "doc_id", "frame")
    return parsed.select(
        "doc_id", "frame_index", "type", "offset", "magic", "version", "block_independent", "block_checksum", "content_size_flag", "content_checksum_flag",
        "has_dict_id", "block_size_id", "block_max_size", "content_size", "header_checksum_valid", F.size("blocks").cast("long").alias("n_blocks"),
    )


_SIZE_HEX = "array_to_string(list_transform(range(8), lambda i: printf('%02x', (CAST(strlen(coalesce(text, '')) AS BIGINT) >> (8 * i)) & 255)), '{}')"
_DESCRIPTOR = f"SELECT doc_id AS id, upper('6d40' || {_SIZE_HEX.format('')} || '02010000') AS x, 14 AS n FROM documents"


@query(f"""WITH f(field_index, name, "offset", size) AS (VALUES (0, 'magic', 0, 4), (1, 'flg', 4, 1), (2, 'bd', 5, 1), (3, 'content_size', 6, 8), (4, 'dict_id', 14, 4), (5, 'header_checksum', 18, 1)),
c AS (SELECT id AS doc_id, (h >> 8) & 255 AS sum FROM ({_xxh32_sql(_DESCRIPTOR)}))
SELECT doc_id, field_index, name, CAST("offset" AS BIGINT) AS "offset", size,
 CASE name WHEN 'magic' THEN 407708164 WHEN 'flg' THEN 109 WHEN 'bd' THEN 64 WHEN 'content_size' THEN CAST(strlen(coalesce(text, '')) AS BIGINT) WHEN 'dict_id' THEN 258 ELSE sum END AS value,
 CASE name WHEN 'magic' THEN '04 22 4d 18' WHEN 'flg' THEN '6d' WHEN 'bd' THEN '40' WHEN 'dict_id' THEN '02 01 00 00' WHEN 'content_size' THEN {_SIZE_HEX.format(' ')} ELSE printf('%02x', sum) END AS hex
FROM documents JOIN c USING (doc_id), f""")
def parsed_fields(spark, sf):
    """Header fields in file order."""
    made = _framed(spark, sf, FrameOptions(dict_id=258))
    rows = fr.frame_fields(fr.frames(made, "doc_id", "frame"), "doc_id")
    return rows.select("doc_id", "field_index", "name", "offset", "size", "value", "hex")


@query("""SELECT doc_id, byte, name, bits, value FROM documents, (VALUES ('FLG', 'version', '7-6', 1), ('FLG', 'block_independent', '5', 1), ('FLG', 'block_checksum', '4', 0), ('FLG', 'content_size', '3', 1),
 ('FLG', 'content_checksum', '2', 1), ('FLG', 'reserved', '1', 0), ('FLG', 'dict_id', '0', 0), ('BD', 'reserved', '7', 0), ('BD', 'block_max_size', '6-4', 4), ('BD', 'reserved_low', '3-0', 0)) v(byte, name, bits, value)""")
def parsed_flag_bits(spark, sf):
    """Flag bits as rows."""
    return fr.flag_bits(fr.frames(_framed(spark, sf), "doc_id", "frame"), "doc_id").drop("frame_index")


@query("""SELECT doc_id, CAST(2 AS BIGINT) AS n_frames, CAST((strlen(coalesce(text, '')) + 65535) // 65536 AS BIGINT) AS n_blocks, CAST(strlen(coalesce(text, '')) + 5 AS BIGINT) AS content_size, 'skippable' AS format FROM documents""")
def stream_statistics(spark, sf):
    """Statistics of concatenated frames."""
    made = _framed(spark, sf).select("doc_id", F.concat("frame", C.skippable_frame(F.lit("hello"), 3)).alias("frame"))
    rows = fr.statistics(fr.frames(made, "doc_id", "frame"), "doc_id")
    return rows.select("doc_id", "n_frames", "n_blocks", "content_size", "format")


@query("SELECT doc_id, md5(coalesce(text, '') || coalesce(text, '')) AS digest, 3 AS n_frames, true AS valid, '' AS error FROM documents")
def decompress_all(spark, sf):
    """standard || skippable || standard, all content and all checksums."""
    made = _framed(spark, sf).select("doc_id", F.concat("frame", C.skippable_frame(F.lit("meta"), 5), "frame").alias("f"))
    d = made.select("doc_id", codecs.frame_decompress("f").alias("d"))
    return d.select("doc_id", F.md5("d.data").alias("digest"), "d.n_frames", F.col("d.content_checksum_valid").alias("valid"), F.coalesce("d.error", F.lit("")).alias("error"))


@query("SELECT doc_id, 'skippable' AS type, md5('') AS digest FROM documents")
def first_frame_only(spark, sf):
    """The first frame decides: leading metadata decodes to nothing."""
    made = _framed(spark, sf).select("doc_id", F.concat(C.skippable_frame(F.lit("meta"), 5), "frame").alias("f"))
    d = made.select("doc_id", C.frame_type("f").alias("type"), codecs.frame_decompress("f", first_only=True).alias("d"))
    return d.select("doc_id", "type", F.md5("d.data").alias("digest"))


@query("""SELECT r_name, CAST(v AS INTEGER) AS variant, lower(printf('%02x', 80 + v) || '2a4d18' || printf('%02x', strlen(r_name)) || '000000' || hex(encode(r_name))) AS frame FROM region, range(16) t(v)""")
def skippable_frames(spark, sf):
    """All 16 variants."""
    out = None
    for v in range(16):
        one = _t(spark, sf, "region").select("r_name", F.lit(v).alias("variant"), F.lower(F.hex(C.skippable_frame("r_name", v))).alias("frame"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, 'legacy' AS type, CAST((strlen(coalesce(text, '')) + 8388607) // 8388608 AS BIGINT) AS n_blocks FROM documents")
def legacy_roundtrip(spark, sf):
    """Legacy frames."""
    made = compress_legacy(_docs(spark, sf), "content")
    d = made.select("doc_id", F.md5(codecs.frame_decompress("frame")["data"]).alias("digest"), codecs.walk_frames("frame")[0].alias("f"))
    return d.select("doc_id", "digest", "f.type", F.size("f.blocks").cast("long").alias("n_blocks"))


@query("""SELECT n_name, lower(printf('%02x', strlen(n_name) * 16) || hex(encode(n_name))) AS block, n_name AS back FROM nation WHERE strlen(n_name) <= 12""")
def literal_blocks(spark, sf):
    """Blocks of up to 12 bytes are literals only."""
    rows = _t(spark, sf, "nation").filter(F.octet_length("n_name") <= 12).select("n_name", C.literal_block(F.encode("n_name", "utf-8")).alias("b"))
    return rows.select("n_name", F.lower(F.hex("b")).alias("block"), codecs.block_decompress("b")["data"].cast("string").alias("back"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS covered FROM documents")
def sequence_cover(spark, sf):
    """The literals and matches of the sequences of a block cover its text (L3, sequences table)."""
    rows = _docs(spark, sf).select("doc_id", F.inline_outer(codecs.block_sequences(codecs.block_compress("content"))))
    return rows.groupBy("doc_id").agg(F.sum(F.coalesce(F.col("literal_length") + F.col("match_length"), F.lit(0))).alias("covered"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' ELSE 'FAIL' END AS status, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Truncated frame descriptor' WHEN 2 THEN 'Truncated content checksum' ELSE 'Content checksum mismatch' END AS error FROM documents""")
def integrity_test(spark, sf):
    """Sound, cut and damaged frames, each with its own verdict; nothing raises."""
    n = F.octet_length("frame")
    cut = F.when(F.col("doc_id") % 4 == 0, F.col("frame")).when(F.col("doc_id") % 4 == 1, F.substring(F.col("frame"), F.lit(1), F.lit(5)))
    cut = cut.when(F.col("doc_id") % 4 == 2, F.substring(F.col("frame"), F.lit(1), n - 2))
    last = C.le_bytes(255 - C.byte_at("frame", n - 1), 1)
    cut = cut.otherwise(F.concat(F.substring(F.col("frame"), F.lit(1), n - 1), last))
    rows = fr.integrity(_framed(spark, sf).select("doc_id", cut.alias("frame")), "doc_id", "frame")
    return rows.select("doc_id", "status", F.coalesce("error", F.lit("")).alias("error"))


@query(r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents WHERE coalesce(text, '') <> ''),
r AS (SELECT doc_id, o, x[2*o+1:least(2*o+32, 512)] AS h FROM (SELECT doc_id, x, unnest(range(0, least(length(x) // 2, 256), 16)) AS o FROM d))
SELECT doc_id, CAST(o AS INTEGER) AS "offset", lower(trim(regexp_replace(h, '(..)', '\1 ', 'g'))) AS hex,
 array_to_string(list_transform(range(length(h) // 2), lambda i: CASE WHEN ('0x' || h[2*i+1:2*i+2])::INT BETWEEN 32 AND 126 THEN chr(('0x' || h[2*i+1:2*i+2])::INT) ELSE '.' END), '') AS ascii FROM r""")
def hex_dumps(spark, sf):
    """16 bytes a row of the first 256, with what is printable."""
    return fr.hex_dump(_docs(spark, sf), "doc_id", "content")


@query("""SELECT doc_id, lower(trim(regexp_replace(x[1:256], '(..)', '\\1 ', 'g'))) || CASE WHEN length(x) > 256 THEN '...' ELSE '' END AS preview FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)""".replace("\\\\", "\\"))
def hex_previews(spark, sf):
    """K6, H11."""
    return _docs(spark, sf).select("doc_id", C.hex_preview("content").alias("preview"))


def _size_sql(b, k, u):
    tenth = lambda d: f"((20 * n + {d}) // (2 * {d})) // 10 || '.' || ((20 * n + {d}) // (2 * {d})) % 10"
    return (
        f"CASE WHEN n < 1024 THEN n || '{b}' WHEN n < 1048576 THEN {tenth(1024)} || '{k}K{u}' WHEN n < 1073741824 THEN {tenth(1048576)} || '{k}M{u}' "
        f"ELSE {tenth(1073741824)} || '{k}G{u}' END"
    )


@query(f"SELECT DISTINCT n, {_size_sql('', '', '')} AS parser_form, {_size_sql(' B', ' ', 'B')} AS ui_form FROM (SELECT CAST(l_orderkey * l_partkey AS BIGINT) AS n FROM lineitem)")
def human_sizes(spark, sf):
    """F8, F9, Q20."""
    n = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * F.col("l_partkey")).cast("long").alias("n")).distinct()
    return n.select("n", C.human_size("n").alias("parser_form"), C.human_size("n", spaced=True).alias("ui_form"))


@query("""SELECT page_id, url || '.lz4' AS packed, url AS unpacked, url || '.dec' AS other FROM pages""")
def output_names(spark, sf):
    """K3."""
    p = _t(spark, sf, "pages").select("page_id", "url")
    packed = C.output_name("url", True)
    return p.select("page_id", packed.alias("packed"), C.output_name(packed, False).alias("unpacked"), C.output_name("url", False).alias("other"))


@query("SELECT r_regionkey, r_name AS name FROM region")
def hex_literals(spark, sf):
    """Text and hexadecimal literals."""
    r = _t(spark, sf, "region").select("r_regionkey", C.hex_spaced(F.encode("r_name", "utf-8")).alias("h"))
    return r.select("r_regionkey", C.hex_literal("h").cast("string").alias("name"))


@query("SELECT level, searches, target_len FROM (VALUES (2, 2, 16), (3, 4, 16), (4, 8, 16), (5, 16, 16), (6, 32, 16), (7, 64, 16), (8, 128, 16), (9, 256, 16), (10, 96, 64), (11, 512, 128), (12, 16384, 4096)) v(level, searches, target_len)")
def level_table(spark, sf):
    """L8, R11."""
    return spark.createDataFrame([(k, *v) for k, v in C.LEVELS.items()], "level int, searches int, target_len int")


@query("""WITH RECURSIVE g(i, x) AS (SELECT 0, CAST(12345 AS BIGINT) UNION ALL SELECT i + 1, CAST(CAST(x AS DOUBLE) * 1103515245.0 + 12345.0 AS BIGINT) & 2147483647 FROM g WHERE i < 5000)
SELECT CAST(i - 1 AS BIGINT) AS i, CAST(CASE WHEN i <= 4096 THEN ascii(substr('Hello World! This is LZ4 benchmark data. ', CAST((i - 1) % 41 + 1 AS BIGINT), 1)) ELSE x & 255 END AS BIGINT) AS value FROM g WHERE i > 0""")
def generator_bytes(spark, sf):
    """The low bytes of the generator, products rounded as doubles, and the text over the first 4,096."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(4999))).alias("i"), codecs.generated(F.lit(5000)).alias("b"))
    return rows.select(F.col("i").cast("long").alias("i"), C.byte_at("b", F.col("i")).alias("value"))


def _tar_files(spark, sf) -> DataFrame:
    """Pages as files, names by the path of the url: archives of each host with up to 100 page ids, so that an archive is bounded."""
    p = _t(spark, sf, "pages").filter("url is not null and html is not null")
    host = F.expr("regexp_extract(url, '//([^/]+)/', 1) || '-' || (page_id div 100)")
    path = F.regexp_extract("url", "//[^/]+/([^?#]*)", 1)
    return p.select("page_id", host.alias("host"), F.concat(F.lit("site/"), path, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("data"))


_TAR_FILES = "SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) || '-' || (page_id // 100) AS host, 'site/' || regexp_extract(url, '//[^/]+/([^?#]*)', 1) || '/' || page_id || '.html' AS name, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"


@query(f"SELECT host, name, '0' AS type, CAST(strlen(html) AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, true AS checksum_valid, md5(html) AS digest FROM ({_TAR_FILES})")
def tar_roundtrip(spark, sf):
    """Archives of each host, packed, compressed, expanded and listed."""
    packed = tar.pack(_tar_files(spark, sf), "host", "page_id", "name", "data", 1700000000)
    made = compress_frames(packed, "archive").select("host", codecs.frame_decompress("frame")["data"].alias("archive"))
    entries = tar.unpack(made.filter(C.is_tar("archive")), "host", "archive").filter("type = '0'")
    return entries.select("host", "name", "type", "size", "mtime", "checksum_valid", F.md5("data").alias("digest"))


@query(f"SELECT host, CAST(count(*) AS BIGINT) AS n_files, CAST(any_value(nd) AS BIGINT) AS n_dirs, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes FROM ({_TAR_FILES}) JOIN (SELECT host, count(DISTINCT d) AS nd FROM (SELECT host, array_to_string(string_split(name, '/')[1:i], '/') || '/' AS d FROM (SELECT host, name, unnest(range(1, len(string_split(name, '/')))) AS i FROM ({_TAR_FILES}))) GROUP BY host) USING (host) GROUP BY host")
def tar_summary(spark, sf):
    """A8, R3, R6."""
    packed = tar.pack(_tar_files(spark, sf), "host", "page_id", "name", "data")
    return tar.summary(tar.unpack(packed, "host", "archive"), "host")


@query(f"SELECT DISTINCT host, array_to_string(string_split(name, '/')[1:i], '/') || '/' AS name FROM (SELECT host, name, unnest(range(1, len(string_split(name, '/')))) AS i FROM ({_TAR_FILES}))")
def tar_ancestors(spark, sf):
    """A4, R8."""
    return tar.ancestors(_tar_files(spark, sf), "host", "name")


@query("SELECT p_partkey, lpad(printf('%o', CAST(p_partkey AS BIGINT)), 11, '0') AS digits, CAST((p_size + 511) // 512 * 512 AS BIGINT) AS padded FROM part")
def tar_octal(spark, sf):
    """A5, and padding to whole records."""
    p = _t(spark, sf, "part")
    digits = F.substring(C.octal("p_partkey", 12), 1, 11).cast("string")
    return p.select("p_partkey", digits.alias("digits"), (F.ceil(F.col("p_size") / 512) * 512).cast("long").alias("padded"))


@query("SELECT regexp_extract(url, '//([^/]+)/', 1) AS dir, count(*) AS n_files, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes, bool_or(strlen(html) > 10000) AS any_large, bool_and(strlen(html) > 1000) AS all_over FROM pages GROUP BY 1")
def files_by_directory(spark, sf):
    """R2, R4, R5, R7."""
    p = _t(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]+)/", 1).alias("dir"), F.octet_length("html").alias("n"))
    return p.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n").cast("long").alias("n_bytes"), F.bool_or(F.col("n") > 10000).alias("any_large"), F.bool_and(F.col("n") > 1000).alias("all_over")
    )


@query(f"SELECT {_SHARD_SQL} AS shard, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS original_size, true AS smaller, true AS bounded FROM documents GROUP BY 1")
def compression_report(spark, sf):
    """Sizes and ratio by level (C17); ratios depend on match choices, so the row states what must hold of them."""
    docs = _shards(spark, sf)
    fast = compress_frames(docs, "content").select("shard", "original_size", F.octet_length("frame").alias("a"))
    deep = compress_frames(docs, "content", FrameOptions(level=9)).select("shard", F.octet_length("frame").alias("b"))
    j = fast.join(deep, "shard")
    return j.select("shard", "original_size", (F.col("b") <= F.col("a") * 1.05).alias("smaller"), (F.col("a") <= C.compress_bound("original_size") + 64).alias("bounded"))


@query()
def dictionary_savings(spark, sf):
    """Frames of small records with and without a dictionary, and the share of bytes saved."""
    rows = _records(spark, sf)
    o = FrameOptions(content_checksum=False, content_size=False)
    plain = compress_frames(rows, "content", o).agg(F.sum(F.octet_length("frame")).alias("plain"))
    small = compress_frames(rows, "content", FrameOptions(content_checksum=False, content_size=False, dictionary=DICTIONARY)).agg(F.sum(F.octet_length("frame")).alias("with_dictionary"))
    return plain.crossJoin(small)  # one row each


@query()
def scanned_files(spark, sf):
    """Folder scan with relative paths; content is not read."""
    return read_files(spark, sf, "*.parquet").select("relative", "length")


@query()
def bench_generated(spark, sf):
    """The benchmark on generated data: six sizes, means of three runs."""
    return bench.results(spark)


@query()
def bench_documents(spark, sf):
    """The benchmark on the caller's data: means of five runs after two."""
    return bench.results_of(_docs(spark, sf).select("content"))


@query()
def file_statistics(spark, sf):
    """Sizes, ratio, times and speed of each text as a file of its own (C17)."""
    return bench.file_statistics(_docs(spark, sf).select("doc_id", "content"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS block_index, NOT (doc_id % 2 = 1 AND i = 0) AS valid FROM (SELECT doc_id, unnest(range((strlen(coalesce(text, '')) + 65535) // 65536)) AS i FROM documents)")
def block_checksums(spark, sf):
    """Verdicts of block checksums; the first block of texts with an odd id has its first byte inverted (H5, F2)."""
    made = _framed(spark, sf, FrameOptions(block_checksum=True, content_checksum=False)).filter("original_size > 0").select("doc_id", "frame")
    turned = F.concat(F.substring("frame", 1, 19), C.le_bytes(255 - C.byte_at("frame", 19), 1), F.substring(F.col("frame"), F.lit(21), F.lit(2**31 - 1)))
    rows = fr.blocks(fr.frames(made.withColumn("frame", F.when(F.col("doc_id") % 2 == 1, turned).otherwise(F.col("frame"))), "doc_id", "frame"), "doc_id")
    return rows.select("doc_id", F.col("block_index").cast("long").alias("block_index"), F.col("block_checksum_valid").alias("valid"))


#: Names of 90 to 330 bytes: some fit one field, some are split, some need a pax record.
_LONG = "repeat('d' || p_partkey || '/', 1 + CAST(p_partkey % 40 AS INT)) || repeat('n', 60 + CAST(p_partkey % 90 AS INT))"


@query(f"SELECT p_partkey, {_LONG} AS name, CAST(strlen(p_name) AS BIGINT) AS size, true AS checksum_valid FROM part")
def tar_long_names(spark, sf):
    """Names over 100 and over 255 bytes come back whole (A2, A3)."""
    p = _t(spark, sf, "part").select("p_partkey", F.expr(_LONG).alias("name"), F.encode("p_name", "utf-8").alias("data"))
    entries = tar.unpack(tar.pack(p, "p_partkey", "p_partkey", "name", "data"), "p_partkey", "archive")
    return entries.filter("type = '0'").select("p_partkey", "name", "size", "checksum_valid")


@query(f"SELECT host, 'site.tar.lz4' AS archive_name FROM ({_TAR_FILES}) GROUP BY host")
def tar_archive_names(spark, sf):
    """Names of archives by the top folder of their first file (K5)."""
    return tar.archive_names(_tar_files(spark, sf), "host", "page_id", "name")


@query("SELECT r_regionkey, CASE r_regionkey WHEN 4 THEN '64 KB' WHEN 0 THEN 'Default(64KB)' ELSE NULL END AS label, CAST(CASE r_regionkey WHEN 4 THEN 65536 ELSE 65536 END AS BIGINT) AS size FROM region")
def block_size_labels(spark, sf):
    """Labels and sizes of block size ids; unknown ids count as 64 KB and have no label."""
    r = _t(spark, sf, "region").select(F.col("r_regionkey"), F.col("r_regionkey").cast("int").alias("i"))
    return r.select("r_regionkey", C.block_size_label("i").alias("label"), C.block_max_size(F.col("i")).alias("size"))


@query("SELECT CAST(size AS BIGINT) AS size FROM (VALUES (1024), (4096), (16384), (65536)) v(size)")
def sizes_up_to(spark, sf):
    """The benchmark sizes of at most 64 KiB (R2)."""
    return spark.createDataFrame([(n,) for n in bench.SIZES], "size long").filter("size <= 65536")


_LISTED = "CASE WHEN len(string_split(name, '/')) > 2 THEN array_to_string(string_split(name, '/')[2:len(string_split(name, '/')) - 1], '/') ELSE '(root)' END"


@query(f"SELECT host, {_LISTED} AS dir, string_agg(name, ',' ORDER BY page_id) AS files FROM ({_TAR_FILES}) WHERE strlen(html) > 0 GROUP BY ALL")
def files_listed(spark, sf):
    """Non-empty files of each archive by their folder below the top one."""
    rows = _tar_files(spark, sf).filter(F.octet_length("data") > 0)
    parts = F.split("name", "/")
    folder = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise("(root)")
    files = F.array_sort(F.collect_list(F.struct("page_id", "name")))
    return rows.groupBy("host", folder.alias("dir")).agg(F.array_join(F.transform(files, lambda f: f["name"]), ",").alias("files"))


@query(f"SELECT host, name, CAST(strlen(html) AS BIGINT) AS size FROM ({_TAR_FILES}) WHERE name LIKE '%/7.html'")
def entry_by_name(spark, sf):
    """An entry of an archive found by its name."""
    entries = tar.unpack(tar.pack(_tar_files(spark, sf), "host", "page_id", "name", "data"), "host", "archive")
    return entries.filter(F.col("name").endswith("/7.html")).select("host", "name", "size")


#: Cells on both sides of the block size, with null and repeated keys.
_ODD = "SELECT CASE WHEN r_regionkey < 2 THEN NULL ELSE 1 END AS k, repeat(r_name || ' ', CAST(1 + 15000 * (r_regionkey % 2) AS INT)) AS text FROM region"


@query(f"SELECT k, md5(text) AS digest, how, true AS sound FROM ({_ODD}), (VALUES ('blocks'), ('legacy'), ('whole')) v(how)")
def repeated_keys(spark, sf):
    """Rows with null and repeated keys are rows like any other, whatever their size."""
    bound_batches(spark)
    rows = spark.read.parquet(f"{sf}/region.parquet").select(F.expr("IF(r_regionkey < 2, NULL, 1)").alias("k"), F.expr("encode(repeat(r_name || ' ', CAST(1 + 15000 * (r_regionkey % 2) AS INT)), 'utf-8')").alias("content"))
    blocks = decompress_blocks(compress_frames(rows)).select("k", F.lit("blocks").alias("how"), "data", "content_checksum_valid", "error")
    whole = lambda made, how: made.select("k", F.lit(how).alias("how"), codecs.frame_decompress("frame").alias("d")).select("k", "how", "d.data", "d.content_checksum_valid", "d.error")
    out = blocks.unionByName(whole(compress_legacy(rows), "legacy")).unionByName(whole(compress_frames(rows), "whole"))
    sound = F.col("error").isNull() & F.coalesce("content_checksum_valid", F.lit(True))
    return out.select("k", F.md5("data").alias("digest"), "how", sound.alias("sound"))


@query(f"SELECT doc_id, {MD5} AS digest, '' AS error, CAST(level AS BIGINT) AS level FROM documents, (VALUES (10), (11), (12)) v(level)")
def roundtrip_favor_decode(spark, sf):
    """Deep levels in favour of decoding speed."""
    out = None
    for level in (10, 11, 12):
        one = _md5_back(_framed(spark, sf, FrameOptions(level=level, favor_decode_speed=True))).withColumn("level", F.lit(level).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out
