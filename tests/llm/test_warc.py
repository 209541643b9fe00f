"""Archives written and read back, their determinism, and the defined cases."""

import gzip
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelftally.llm import warc

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, place string, bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_all_pages(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.write_archives(rows, str(tmp_path / "a"), roll=100_000)
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == rows.count()
    for m in manifest[:-1]:
        assert 100_000 <= m["bytes"] + 2_000 and m["bytes"] < 140_000
    for m in manifest:
        data = (tmp_path / "a" / m["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == m["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    got = {r["page_id"]: (r["html"], r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {r["page_id"]: (r["html"], digest(r["html"])) for r in rows.collect()}
    assert not list((tmp_path / "a").glob("_temporary*"))


def test_same_files_however_divided(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/pages.parquet").unionAll(spark.range(30).select("id", F.lit("http://x"), F.lit("same " * 50)))
    a = warc.write_archives(rows, str(tmp_path / "a"), roll=60_000)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = warc.write_archives(rows.repartition(11), str(tmp_path / "b"), roll=60_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and json.loads((tmp_path / "b" / "manifest.json").read_text()) == b


def test_revisits_and_defined_cases(spark, tmp_path):
    long, short = "é" * 50, "x" * 99
    rows = [(5, "u5", long), (3, "u3", long), (None, "u0", long), (9, None, long), (4, "a b\r\nc", short), (2, "", short), (7, "u7", None), (8, "u8", ""), (1, "v", "y" * 300_000)]
    rows += [(6, "twice", "z" * 200)] * 2
    got = warc.archived(pages(spark, rows)).collect()
    found = {r["page_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(rows)
    assert found[3] == (100, digest(long), "response", None)
    assert found[5] == found[9] == found[None] == (100, digest(long), "revisit", 3)
    assert found[4] == found[2] == (99, digest(short), "response", None)
    assert found[7] == found[8] == (0, digest(""), "response", None)
    assert [r["record_type"] for r in got if r["page_id"] == 6] == ["response"] * 2
    folder = str(tmp_path / "c")
    warc.write_archives(pages(spark, rows), folder)
    urls = {r["page_id"]: r["url"] for r in warc.read_archives(spark, folder).collect()}
    assert urls[9] is None and urls[4] == "a%20b%0D%0Ac" and urls[5] == "u5"


def test_no_pages(spark, tmp_path):
    assert warc.write_archives(pages(spark, []), str(tmp_path / "d")) == []
    assert warc.read_archives(spark, str(tmp_path / "d")).count() == 0


def test_damage_is_found(spark, tmp_path):
    record = warc.page_record(1, "u", digest("payload"), 7, b"payload")
    fields, block = warc.parse_record(gzip.decompress(record))
    assert fields["WARC-Record-ID"] == "<urn:x-page:1>" and block.endswith(b"payload")
    with pytest.raises(ValueError):
        warc.parse_record(gzip.decompress(record).replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(ValueError):
        list(warc._members(memoryview(record[:-5])))
    assert len(list(warc._members(memoryview(record * 3)))) == 3
    assert not Path(tmp_path / "nothing").exists()
