import gzip
import hashlib
import random

import pytest

from tactile.llm import queries, warc


def _pages(n=80):
    rng = random.Random(6)
    out = []
    for i in range(n):
        html = f"<html>{'é' * rng.randint(0, 90)}{rng.choice(['a', 'b']) * 60}\r\n\r\nWARC/1.1\r\n</html>"
        out.append((i, f"http://x/{i % 9}\r\n", rng.choice([html, out[-1][2] if out else html])))
    out += [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", "n" * 150), (None, "u", "n" * 150)]
    out += [(204, "u", "n" * 150), (205, "u", "n" * 150), (204, "u", "n" * 150), (206, "u", "long " * 40000), (207, "u", "x" * 99), (208, "u", "x" * 99)]
    return out


def _brute(data):
    first = {}
    for i, _, html in data:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in data:
        body = (html or "").encode()
        ref = first.get(html) if i is not None and len(body) >= 100 else None
        ref = None if ref == i else ref
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


SCHEMA = "page_id long, url string, html string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _same(found):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == _brute(_pages())


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(_pages(), SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    _same(queries.op9_warc(spark, str(tmp_path)))


def test_many_archives(spark):
    rows = warc.classified(spark.createDataFrame(_pages(), SCHEMA))
    archives = warc.write_archives(rows, archive_bytes=1000)
    assert archives.count() > 20
    _same(warc.read_back(warc.normalise(archives)))


def test_each_member_stands_alone(spark):
    pages = spark.createDataFrame(_pages(), SCHEMA)
    archives = warc.write_archives(warc.classified(pages))
    for path in [r["path"] for r in archives.collect()]:
        data = open(path, "rb").read()
        inflate = __import__("zlib").decompressobj(wbits=31)
        inflate.decompress(data)
        assert inflate.eof and not inflate.unused_data  # one stream for the whole file
    index = warc.normalise(archives).collect()
    assert len(index) == len(_pages())
    payloads = {}
    for row in index:
        with open(row["path"], "rb") as file:
            file.seek(row["offset"])
            fields, payload = warc.payload_of(gzip.decompress(file.read(row["length"])))
        assert fields["warc-type"] == row["type"]
        payloads.setdefault(row["page_id"], []).append(payload)
        lines = open(row["path"] + ".cdx").read().splitlines()
        assert f"{row['offset']} {row['length']} {row['type']} {'-' if row['page_id'] is None else row['page_id']}" in lines
    assert payloads[206] == [b"long " * 40000] and payloads[200] == [b""]


def test_normalised_files_normalise_again(spark):
    archives = warc.write_archives(warc.classified(spark.createDataFrame(_pages(), SCHEMA)))
    once = warc.normalise(archives)
    twice = warc.normalise(once.select("path").distinct())
    pick = [c for c in once.columns if c != "path"]
    assert sorted(map(tuple, once.select(*pick).collect()), key=str) == sorted(map(tuple, twice.select(*pick).collect()), key=str)


def test_cut_files_fail():
    data = warc.record(1, b"x" * 50, "d", None, "u")
    assert len(list(warc.records(iter([data[:40], data[40:], data])))) == 2
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-10]])))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op9_warc(spark, str(tmp_path)).count() == 0
