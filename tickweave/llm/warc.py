"""WARC archives with an index written first, and coalesced byte-range reads of chosen records.

``write`` lays records out before any archive exists: equal payloads are found by digest,
every record's length is known from its text, and a running sum per archive gives offsets.
Payloads are shuffled once, when records go to their archives, a share of the archives at a
time, so the disk holds the shuffle files of that share and not of the whole table.
That index is written as Parquet, then the archives are, by Spark's own text writer with the
record separator as line end, so its commit protocol covers lost executors and any file
system Spark can write. ``read_records`` takes index rows, sorts them by archive and offset,
merges neighbouring ranges into reads of at most ``READ_BYTES`` and parses the records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Smallest payload that is worth a revisit record.
LEAST_REVISIT = 100
#: Target size of an archive; longest coalesced read; widest gap that a read bridges.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 4 << 20, 64 << 10
#: Most repeated payloads whose table (about 100 bytes each) is broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Turns in which archives are written, each by a scan of the pages; and what makes Spark remove the shuffle files of a turn when it ends.
TURNS, REMOVE_SHUFFLES = 4, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _uri(url):
    """A url as a header value: line breaks and controls percent-encoded."""
    out = url
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), ("\0", "%00")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def _record_id(id_col):
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def repeated(pages: DataFrame) -> DataFrame:
    """``payload_digest, first_id`` of payloads that several records share; one row per digest and task is shuffled."""
    return (
        _payloads(pages).where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )


def layout(pages: DataFrame, first: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, record`` for a table from ``repeated``."""
    rows = _payloads(pages)
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("first_id"))
    )
    body = F.concat(F.lit(HTTP), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF), F.when(again, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", _uri(F.col("url"))), F.lit("")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(again, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))), _line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length("body").cast("string")), F.lit(CRLF),
    )
    return rows.withColumn("body", body).withColumn("record", F.concat(head, "body")).drop("body", "payload", "first_id")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``index`` and ``archives`` under ``folder``; returns the index.

    Index rows: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    archive, offset, length``. Of records with equal payloads of at least LEAST_REVISIT bytes
    the one with the least id is a response and the others revisit it; a null payload is
    empty, a null url leaves its header out, rows without id are records without one and
    revisit like others; where the least id repeats, each of its rows is a response. Other
    columns are ignored; an empty table gives an empty index and no archive.
    """
    spark = pages.sparkSession
    # rows go to archives by a hash of all that tells them apart, so one digest or site is no hot spot
    repeated(pages).write.parquet(f"{folder}/repeated")
    first = spark.read.parquet(f"{folder}/repeated")
    # a broadcast of checked size keeps payloads in place; all passes derive the same records from the same rows
    laid = layout(pages, F.broadcast(first) if first.count() <= BROADCAST_ROWS else first).withColumn("length", F.octet_length("record").cast("long"))
    total = laid.agg(F.sum("length")).first()[0] or 0
    archives = int(max(8, -(-total // ARCHIVE_BYTES)))
    key = F.xxhash64("page_id", "url", "payload_digest")
    laid = laid.withColumn("archive", F.pmod(key, F.lit(archives)).cast("int"))
    order = ["archive", "page_id", "url", "payload_digest"]
    before = Window.partitionBy("archive").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    index = laid.drop("record").withColumn("offset", F.coalesce(F.sum(F.col("length") + len(SEPARATOR)).over(before), F.lit(0)).cast("long"))
    index.write.parquet(f"{folder}/index")
    records = laid.select("archive", "page_id", "url", "payload_digest", "record")
    setting = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        for turn in range(TURNS):
            (
                records.where(F.col("archive") % TURNS == turn).repartition(-(-archives // TURNS), "archive").sortWithinPartitions(*order)
                .select("archive", "record").write.mode("append").partitionBy("archive").option("lineSep", SEPARATOR).text(f"{folder}/archives")
            )
    finally:
        spark.conf.set(REMOVE_SHUFFLES, setting)
    return spark.read.parquet(f"{folder}/index")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    return {k.lower(): v for k, v in fields.items()}, block


def file_system(path: str):
    """The Arrow file system of a path as Spark writes it, and the path in it.

    Names that Hadoop alone uses are put as Arrow knows them; for stores that Arrow cannot
    open, pass a function of this kind to ``read_records``.
    """
    from pyarrow import fs

    for own, known in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if path.startswith(own):
            path = known + path[len(own) :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _reader(opener):
    return lambda batches: _read(batches, opener)


def _read(batches, opener):
    import hashlib

    opened: dict[str, object] = {}

    def source(path: str):
        if path not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            system, inner = opener(path)
            opened[path] = system.open_input_file(inner)
        return opened[path]

    def ranges(rows):
        """Runs of rows of one archive that one read covers."""
        run: list = []
        for row in rows:
            if run and (row[0] != run[-1][0] or row[1] - run[-1][1] - run[-1][2] > GAP_BYTES or row[1] + row[2] - run[0][1] > READ_BYTES):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
        for run in ranges(rows):
            path, begin, _ = run[0]
            data = source(path).read_at(run[-1][1] + run[-1][2] - begin, begin)
            out = []
            for _, offset, length in run:
                fields, block = _parse(data[offset - begin : offset - begin + length])
                http, _, payload = block.partition(b"\r\n\r\n")
                own = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                response = fields["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if response else fields["warc-payload-digest"].removeprefix("sha256:")
                if response and len(payload) != size:
                    raise ValueError(f"record at {offset} of {path} is torn")
                out.append((int(own) if own else None, fields.get("warc-target-uri"), fields["warc-type"], int(refers) if refers else None, size, digest, payload if response else None))
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_records(index: DataFrame, folder: str, opener=file_system) -> DataFrame:
    """Records that the rows of ``index`` (any selection of it) point at, parsed.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``: for a
    response the digest is taken anew from the bytes read; a revisit has no payload of its
    own and gives size and digest as recorded. ``url`` is the header's percent-encoded form.
    ``opener`` turns an archive's path into an Arrow file system and the path in it.
    """
    spark = index.sparkSession
    if index.limit(1).count() == 0:
        found = spark.createDataFrame([], "path string, archive int")
    else:
        files = spark.read.format("binaryFile").load(f"{folder}/archives")  # names only; contents are not read
        found = files.select("path", F.col("archive").cast("int"))
    # neighbours stay together in stretches of a few reads, so that large archives are shared out
    stretch = F.floor(F.col("offset") / (4 * READ_BYTES))
    return (
        index.select("archive", "offset", "length").join(found, "archive").withColumn("stretch", stretch)
        .repartition("path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")
        .mapInArrow(_reader(opener), "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")
    )
