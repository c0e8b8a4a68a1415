"""WARC archives: round trip, revisits, pushed filters, file ranges."""

import hashlib
from collections import Counter

import pytest

from repalign.llm import warc


@pytest.fixture(scope="module")
def pages():
    same = "<html>" + "same é " * 40
    rows = [(k, f"http://a/{k}", f"<html>page {k}" + "x" * (k * 37 % 500)) for k in range(120)]
    rows += [(200 + k, "http://b/\r\nodd", same) for k in range(40)] + [(300, None, None), (301, "u", ""), (302, "u", "short"), (303, "u", "short"), (304, "u", "WARC/1.1\r\n\r\n" * 5000)]
    return rows + [(200, "again", same), (200, "again", same), (None, "u", same), (None, "u", None)]


def wanted(rows):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    again = lambda i, h: i is not None and h in first and i > first[h]
    return Counter((i, len((h or "").encode()), digest(h), "revisit" if again(i, h) else "response", first[h] if again(i, h) else None) for i, _, h in rows)


@pytest.fixture(scope="module")
def table(spark, pages):
    return spark.createDataFrame([(*r, "x", 1) for r in pages], "page_id long, url string, html string, payload string, record_type int").repartition(4)


def test_round_trip(table, pages):
    got = Counter(tuple(r) for r in warc.round_trip(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == wanted(pages)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_round_trip_pushes_both_record_types(table):
    plan = warc.round_trip(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "Filter (" not in plan and "Filter isnotnull" not in plan


def test_revisits_are_read_without_inflating_payloads(spark, table, tmp_path):
    path = str(tmp_path / "w")
    warc.write(table, path)
    reader = warc.WarcReader(path, warc.SPLIT_BYTES, False)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    seen = []
    rest = warc._Member.rest
    warc._Member.rest = lambda self: seen.append(self) or rest(self)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(rows) == 39 and {r["record_type"] for r in rows} == {"revisit"} and not seen
        whole = warc.WarcReader(path, warc.SPLIT_BYTES, True)
        list(whole.pushFilters([warc.EqualTo(("record_type",), "response")]))
        held = sum(b.num_rows for p in whole.partitions() for b in whole.read(p))
        assert held == len(seen) > 100
    finally:
        warc._Member.rest = rest


@pytest.mark.parametrize("split", [1 << 26, 1000, 77])
def test_ranges_and_filters(spark, table, pages, tmp_path, split):
    path = str(tmp_path / "w")
    warc.write(table, path)
    rows = warc.read(spark, path, split=split)
    assert Counter((r.page_id, r.payload_bytes) for r in rows.collect()) == Counter((i, n) for (i, n, *_), c in wanted(pages).items() for _ in range(c))
    some = rows.where("record_type = 'revisit' and page_id < 210")
    plan = some._jdf.queryExecution().toString()
    assert sorted(r.page_id for r in some.collect()) == list(range(201, 210)) and "Filter (" not in plan.split("== Physical Plan ==")[1]
    assert {r.payload for r in warc.read(spark, path, payload=False, split=split).collect()} == {None}
    assert {bytes(r.payload) for r in rows.where("page_id = 304").collect()} == {b"WARC/1.1\r\n\r\n" * 5000}


def test_headers_are_read_without_the_payload():
    row = {"record_type": "response", "page_id": 1, "url": "u", "refers_to": None, "payload_bytes": 3_000_000, "payload_digest": "d", "payload": bytes(range(256)) * 12_000}

    class File:
        def __init__(self, data):
            self.data, self.read = data, 0

        def read_at(self, n, at):
            self.read += n
            return self.data[at:at + n]

    file = File(warc.record(row))
    member = warc._Member(file, 0, warc._size_at(file, 0))
    cut = member.until(b"\r\n\r\n")
    assert warc._parsed(member.plain[:cut])["page_id"] == 1 and file.read < 10_000
