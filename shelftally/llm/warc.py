"""
A deterministic sharded WARC writer, and a reader.

Records are sorted by page over the whole table. Which file a record goes to follows from the
compressed size of all records before it, not from how Spark happened to divide them, so the
same pages make the same files on any cluster. Tasks write under temporary names; the driver
renames what finished tasks report and then publishes a manifest, so a lost task leaves
nothing that a reader would see.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A file is closed by the record that takes its compressed size to this many bytes.
ROLL_BYTES = 16 << 20
#: Shorter payloads are written each time; of longer ones that are equal the first is written.
LEAST_SHARED = 100
LEVEL = 6
#: Pages carry no time of capture.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"


# -- records ----------------------------------------------------------------------------


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, with no time in it."""
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), *fields]
    fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page_of(urn: str) -> int | None:
    page = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(page) if page else None


def page_record(page: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: tuple | None = None) -> bytes:
    """A response with its payload; or a revisit (``payload`` None) of the page in ``refers_to``."""
    fields = [("WARC-Record-ID", _urn(page))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to[0]))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record("response" if refers_to is None else "revisit", fields, block + (payload or b""))


def _members(data: memoryview) -> Iterator[bytes]:
    """The records of a file, one gzip member at a time."""
    at, step = 0, 1 << 16
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = data[at : at + step]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; its length and block digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length it states")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged block of {fields.get('WARC-Record-ID')}")
    return fields, block


# -- writing ----------------------------------------------------------------------------


def _file_system(spark: SparkSession, folder: str) -> str:
    """The folder as a full address that tasks can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _place() -> Column:
    """A text that sorts as page (null first), then url (null first), then digest."""
    page = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    page = F.when(F.col("page_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), page))
    url = F.when(F.col("url").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("url")))
    return F.concat_ws("\x00", page, url, F.col("digest"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compressed size of each page as a response; the payload goes no further."""
    for part in common.slices(batches, "html"):
        pages, urls, digests = (part.rows.column(i).to_pylist() for i in range(3))
        sizes = [len(page_record(p, u, d, len(t), t)) for i, (p, u, d) in enumerate(zip(pages, urls, digests, strict=True)) for t in [part.text(i)]]
        lengths = pa.array(part.offsets[1:] - part.offsets[:-1], pa.int64())
        yield pa.RecordBatch.from_arrays([*part.rows.columns[:4], lengths, pa.array(sizes, pa.int64())], ["page_id", "url", "digest", "place", "bytes", "packed"])


FACTS = "page_id long, url string, digest string, place string, bytes long, packed long"


def _revisits(facts: DataFrame) -> DataFrame:
    """``facts`` with ``refers_to``: null, or a struct with the page that holds the payload."""
    key = F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("page"), F.col("place").alias("at"))
    shared = facts.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    shared = shared.where("n > 1").select(F.col("digest").alias("d"), F.col("first.page").alias("page"), F.col("first.at").alias("at"))
    other = F.col("at").isNotNull() & (F.col("at") != F.col("place"))
    return facts.join(shared, F.col("digest") == F.col("d"), "left").select(
        *facts.columns, F.when(other, F.struct(F.col("page").alias("page"))).alias("refers_to")
    )


def _packed_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        sizes = [
            r["packed"] if r["refers_to"] is None else len(page_record(r["page_id"], r["url"], r["digest"], r["bytes"], None, (r["refers_to"]["page"],)))
            for r in rows
        ]
        yield batch.set_column(batch.schema.get_field_index("packed"), "packed", pa.array(sizes, pa.int64()))


def _file_numbers(offsets: dict[int, int], roll: int):
    """The file of each record, from the size of all before it: the rows of a partition come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if before is None:
                before = offsets[batch.column(2)[0].as_py()]
            files = []
            for size in batch.column(1).to_pylist():
                files.append(before // roll)
                before += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.int64())], ["place", "file"])

    return run


def _file_starts(sized: DataFrame, roll: int) -> list[str]:
    """The place of the first record of each file but the first: as many as there are files."""
    ordered = common.cut(sized.select("place", "packed").repartitionByRange("place").sortWithinPartitions("place"))
    ordered = ordered.withColumn("part", F.spark_partition_id())
    offsets, before = {}, 0
    for row in ordered.groupBy("part").agg(F.sum("packed").alias("packed")).orderBy("part").collect():
        offsets[row["part"]] = before
        before += row["packed"]
    files = ordered.mapInArrow(_file_numbers(offsets, roll), "place string, file long")
    starts = files.groupBy("file").agg(F.min("place").alias("place")).orderBy("file").collect()
    # records of one place are equal, and stay together
    return sorted({row["place"] for row in starts})[1:]


def _numbered(starts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [bisect_right(starts, place) for place in batch.column(batch.schema.get_field_index("place")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), *batch.columns], ["file", *batch.schema.names])

    return run


ROWS = "file int, place string, original int, page_id long, url string, digest string, bytes long, html string, refers_to struct<page: bigint>"
WRITTEN = "file int, temporary string, records long, bytes long, sha256 string"


def _write(folder: str, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        out = number = fact = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != number:
                    if out:
                        yield out.close()
                    number = r["file"]
                    out = _Archive(system, f"{path}/_temporary-{run_id}", number)
                if not r["original"]:
                    fact = r
                    continue
                payload = (r["html"] or "").encode()
                if fact is not None and fact["place"] == r["place"]:
                    out.add(page_record(r["page_id"], r["url"], r["digest"], len(payload), None, (fact["refers_to"]["page"],)))
                else:
                    out.add(page_record(r["page_id"], r["url"], r["digest"], len(payload), payload))
        if out:
            yield out.close()

    return run


class _Archive:
    """One file under a name that no other attempt uses."""

    def __init__(self, system: fs.FileSystem, folder: str, number: int):
        system.create_dir(folder, recursive=True)
        self.number, self.path = number, f"{folder}/{name_of(number)}.{uuid.uuid4().hex}"
        self.stream, self.hash, self.records, self.bytes = system.open_output_stream(self.path), hashlib.sha256(), 0, 0
        block = f"software: shelftally\r\nformat: WARC File Format 1.1\r\nfilename: {name_of(number)}\r\n".encode()
        self.add(_record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{number}>"), ("Content-Type", "application/warc-fields")], block))

    def add(self, record: bytes) -> None:
        self.stream.write(record)
        self.hash.update(record)
        self.records += 1
        self.bytes += len(record)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        row = [self.number, self.path, self.records - 1, self.bytes, self.hash.hexdigest()]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["file", "temporary", "records", "bytes", "sha256"])


def name_of(number: int) -> str:
    return f"part-{number:08d}.warc.gz"


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> list[dict]:
    """Write ``pages`` (``page_id``, ``url``, ``html``) to ``folder``, a new one; what the manifest lists.

    Null html is an empty payload; a null page or url is written without its number or
    address, and sorts first. Of equal payloads of at least ``LEAST_SHARED`` bytes the
    smallest page is a response (with a null id only if there is no other) and the rest are
    revisits; rows alike in all three columns are each the same record. No rows make no file
    but the manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    common.ship(spark)
    folder = _file_system(spark, folder)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("html"))
    rows = rows.select("page_id", "url", "digest", _place().alias("place"), "html")
    facts = _revisits(common.cut(rows.mapInArrow(_measured, FACTS)))
    facts = common.cut(facts.mapInArrow(_packed_sizes, facts.schema))
    starts = _file_starts(facts, roll)
    wanted = ["place", "original", "page_id", "url", "digest", "bytes", "html", "refers_to"]
    nothing = F.lit(None).cast("struct<page: bigint>").alias("refers_to")
    revisits = facts.where("refers_to IS NOT NULL").withColumns({"original": F.lit(0), "html": F.lit(None).cast("string")}).select(*wanted).distinct()
    originals = rows.withColumns({"original": F.lit(1), "bytes": F.lit(None).cast("long")}).select(*wanted[:-1], nothing)
    placed = revisits.unionAll(originals).mapInArrow(_numbered(starts), ROWS)
    run_id = uuid.uuid4().hex
    written = placed.repartition("file").sortWithinPartitions("file", "place", "original").mapInArrow(_write(folder, run_id), WRITTEN).collect()
    return _commit(folder, run_id, sorted(written))


def _commit(folder: str, run_id: str, written: list) -> list[dict]:
    """Give the files of finished tasks their names, then publish the manifest by one rename."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    manifest = []
    for row in written:
        system.move(row["temporary"], f"{path}/{name_of(row['file'])}")
        manifest.append({"file": name_of(row["file"]), "records": row["records"], "bytes": row["bytes"], "sha256": row["sha256"]})
    with system.open_output_stream(f"{path}/{MANIFEST}.{run_id}") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    system.move(f"{path}/{MANIFEST}.{run_id}", f"{path}/{MANIFEST}")
    if system.get_file_info(f"{path}/_temporary-{run_id}").type == fs.FileType.Directory:
        system.delete_dir(f"{path}/_temporary-{run_id}")
    return manifest


# -- reading ----------------------------------------------------------------------------

RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for record in _members(memoryview(content.as_buffer())):
                fields, block = parse_record(record)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                refers_to = _page_of(fields["WARC-Refers-To"]) if revisit else None
                rows.append((_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], length, digest, refers_to, None if revisit else payload.decode()))
                size += len(payload)
                if size > common.SLICE_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest lists, checked against their digests."""
    common.ship(spark)
    folder = _file_system(spark, folder)
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{MANIFEST}") as file:
        manifest = json.loads(file.read())
    if not manifest:
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load([f"{folder}/{row['file']}" for row in manifest])
    return files.select("content").mapInArrow(_read, RECORDS)


def archived(pages: DataFrame, roll: int = ROLL_BYTES) -> DataFrame:
    """What the archives of ``pages`` say of each record; they are made in the shared folder and deleted once read."""
    spark = pages.sparkSession
    folder = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, roll)
    found = common.cut(read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    system, path = fs.FileSystem.from_uri(_file_system(spark, folder))
    system.delete_dir(path)
    return found
