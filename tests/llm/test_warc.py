"""Files taken apart and put together again, byte by byte."""

import gzip
import io
import random

import pytest

from quillspark.llm import warc


def sample(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 10, 3000]))) + rng.choice([b"", b"\r\n\r\nWARC/1.0\r\n", b"\r\n"])
        out.append(([("WARC-Type", "response"), ("WARC-Target-URI", f"http://x/{i}"), ("X-Page-Id", str(i))], payload))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_round_trip(chunk):
    own = sample(20 if chunk == 1 else 60)
    whole = gzip.compress(b"".join(warc.record(f, p) for f, p in own))
    got = list(warc.records(warc.inflate(io.BytesIO(whole), chunk)))
    assert [(f["x-page-id"], p) for f, p, _ in got] == [(f[2][1], p) for f, p in own]


def test_members_can_be_read_alone():
    own = sample()
    raw = b"".join(warc.record(f, p) for f, p in own)
    sink = io.BytesIO()
    index = warc.rewrite(io.BytesIO(gzip.compress(raw)), sink).to_pylist()
    made = sink.getvalue()
    assert gzip.decompress(made) == raw and len(index) == len(own)
    at = 0
    for row, (f, p) in zip(index, own):
        assert row["offset"] == at
        piece = gzip.decompress(made[at : at + row["length"]])
        assert piece == warc.record(f, p) and row["payload_bytes"] == len(p) and row["page_id"] == int(f[2][1])
        at += row["length"]
    assert at == len(made)
    # a file of members is a file all the same
    again = io.BytesIO()
    warc.rewrite(io.BytesIO(made), again)
    assert again.getvalue() == made


@pytest.mark.parametrize("broken", [b"no gzip at all", gzip.compress(b"text without a record\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"), gzip.compress(b"WARC/1.0\r\nX: y\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nContent-Length: -33\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nContent-Length: -1\r\n\r\nx"), gzip.compress(warc.record([], b"x" * 9000))[:-20]])
def test_broken_files_say_so(broken):
    with pytest.raises(warc.Broken):
        list(warc.records(warc.inflate(io.BytesIO(broken))))


def test_empty_file():
    assert list(warc.records(warc.inflate(io.BytesIO(b"")))) == [] == list(warc.records(warc.inflate(io.BytesIO(gzip.compress(b"")))))


def test_pages(spark):
    rows = [(i, f"http://x/{i}?a=b", f"<p>{'é' * i}</p>", "a") for i in range(50)] + [(None, "http://none", "x", "b"), (60, None, "y", "c"), (61, "http://x/61", None, "d"), (61, "http://x/61", None, "d"), (62, "http://two\r\nlines", "", "e"), (63, "u", "long " * 400000, "f")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, offset string").repartition(3)
    got = warc.normalise_pages(pages).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"])) for r in got) == sorted(str((i, len((h or "").encode()))) for i, _, h, _ in rows)
    html = {i: h or "" for i, _, h, _ in rows}
    for r in got:
        fields, payload = warc.read_record(r["file"], r["offset"], r["length"])
        assert payload.decode() == html[r["page_id"]] and fields.get("warc-target-uri") == r["url"]
    index = spark.read.parquet(*{r["file"].replace(".members.warc.gz", ".index.parquet") for r in got})
    assert index.count() == len(rows)
    assert warc.normalise_pages(pages.limit(0)).count() == 0


def test_names(spark, tmp_path):
    path = f"file://{tmp_path}/a.warc.gz"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(warc.record(f, p) for f, p in sample(5))))
    (tmp_path / "none.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(path,), (path,), (None,), (f"file://{tmp_path}/none.warc.gz",)], "uri string")
    assert warc.normalise(files).count() == 5
    (tmp_path / "bad.warc.gz").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "uri string")).count()


def test_each_file_is_a_task(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.warc.gz").write_bytes(gzip.compress(b"".join(warc.record(f, p) for f, p in sample(3, i))))
    files = spark.createDataFrame([(f"file://{tmp_path}/{i}.warc.gz", "x") for i in range(6)] * 2, "uri string, file string")
    out = warc.normalise(files)
    assert out.rdd.getNumPartitions() == 6 and out.count() == 18


def test_schemes():
    fs, path = warc._open("file:///tmp/a b")
    assert fs.type_name == "local" and path == "/tmp/a b" and warc._open("/tmp/a b")[1] == path
