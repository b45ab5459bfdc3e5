import gzip
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import warc
from tickloom.llm.queries import op4_warc

SCHEMA = "page_id bigint, url string, html string, payload string"


def expected(rows):
    best = defaultdict(lambda: None)
    for i, h in rows:
        if i is not None and (best[h or ""] is None or best[h or ""] < i):
            best[h or ""] = i
    out = []
    for i, h in rows:
        data = (h or "").encode()
        to = best[h or ""]
        revisit = len(data) >= 1000 and to is not None and (i is None or i < to)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert read(op4_warc(spark, sf)) == expected(rows)


def test_defined_cases_and_round_trip(spark, tmp_path):
    big, long = "é\r\n\r\nWARC/1.1 " * 200, "x" * 3_000_000
    rows = [(1, None), (2, ""), (3, big), (4, big), (4, big), (None, big), (6, "small"), (7, "small"), (8, long), (None, "y" * 2000), (None, "y" * 2000)]
    pages = spark.createDataFrame([(i, f"http://x/{n}\r\ninjected: 1" if n % 2 else None, h, "p") for n, (i, h) in enumerate(rows)], SCHEMA)
    at = f"file://{tmp_path}/a"
    warc.write_archive(pages, at, file_bytes=1000, stretch_bytes=100)
    back = warc.read_archive(spark, at)
    got = back.select(warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"))
    assert read(got) == expected(rows)
    payloads = [bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()]
    want = [(h or "").encode() for (i, h), e in zip(sorted(rows, key=str), sorted(rows, key=str))]
    assert set(payloads) == set(want)
    assert back.where("computed_digest <> payload_digest").count() == 0
    warc.write_archive(pages.where("false"), at)
    assert warc.read_archive(spark, at).count() == 0


def test_files_are_gzip_members_of_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "text" * i, "") for i in range(50)], SCHEMA).coalesce(1)
    warc.write_archive(pages, f"file://{tmp_path}/b")
    (name,) = [f for f in os.listdir(tmp_path / "b") if f.endswith(".warc.gz")]
    whole = gzip.open(tmp_path / "b" / name).read()
    assert whole.count(b"WARC/1.1\r\n") == 50 and b"WARC-Target-URI: http://x/3\r\n" in whole
    # one file, without our index, plain or packed
    os.remove(tmp_path / "b" / warc.MANIFEST)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc").write_bytes(whole)
    for at in ("b", "c", f"b/{name}"):
        assert warc.read_archive(spark, str(tmp_path / at)).select("payload_bytes").agg(F.sum("payload_bytes")).first()[0] == 4 * 49 * 25


def test_pushdown(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", ("same" if i % 2 else str(i)) * 500, "") for i in range(60)], SCHEMA)
    warc.write_archive(pages, f"file://{tmp_path}/d")
    back = warc.read_archive(spark, f"file://{tmp_path}/d", "record_type string, target_uri string, record_id string")
    assert back.where("record_type = 'revisit'").count() == 29
    assert back.where("record_type in ('revisit', 'other') and target_uri like 'http://h1/%'").count() == sum(i % 3 == 1 for i in range(1, 59, 2))
    reader = warc.WarcReader("x", back.schema, 1)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    rest = GreaterThan(("payload_bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), rest, In(("record_id",), ("a", "b")), StringStartsWith(("target_uri",), "http:")])) == [rest]
    assert reader.keeps({"warc-type": "revisit", "warc-record-id": "a", "warc-target-uri": "http://x"})
    assert not reader.keeps({"warc-type": "response", "warc-record-id": "a", "warc-target-uri": "http://x"})
    assert not reader.keeps({"warc-type": "revisit", "warc-target-uri": "http://x"})


@pytest.mark.parametrize("cut", [5, 100, 230])
def test_truncated(tmp_path, cut):
    data = warc.record({"record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "refers_to": None, "payload_digest": "0" * 40, "payload_bytes": 500, "payload": b"z" * 500})
    import io

    with pytest.raises(ValueError):
        list(warc.records(warc.Members(io.BytesIO(data[:-cut] if cut != 5 else data[:-5 - 4]), 0, None, False), lambda h: True, True))
