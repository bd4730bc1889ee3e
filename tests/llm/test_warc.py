from __future__ import annotations

import base64
import hashlib
import uuid

import pytest

from orderlens.llm import warc
from orderlens.llm.common import table

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (5, "u v", "x"), (3, None, "x"), (9, "", None), (None, "q", "x"), (9, "u", "y\r\n\r\nWARC/1.0\n"), (-4, "z", "é"),
    (9, "", None), (2**62, "big", "l" * 300_000), (-(2**63), "least", "\n\n"), (11, "p", "é"),
]


def brute(rows):
    first = {}
    for i, _, h in rows:
        known = first.get(h or "")
        first[h or ""] = i if known is None else known if i is None else min(i, known)
    out = []
    for i, _, h in rows:
        data, least = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = least is not None and i != least
        out.append((i, len(data), digest, "revisit" if again else "response", least if again else None))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=repr) == brute(ROWS)


def test_given_pages(spark):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_parse(version):
    blocks = [warc.http_block(7, "é".encode()), b"plain\nbytes\r\n", b""]
    data = warc.arc_version_block("n.arc", "20200102030405", version) + b"\n"
    data += b"\n".join(warc.arc_record(f"http://h/{i} x", "20200102030405", b, version) for i, b in enumerate(blocks)) + b"\n"
    records = list(warc.parse_arc(data))
    assert [r[1] for r in records[1:]] == blocks
    assert [r[0][0] for r in records[1:]] == [f"http://h/{i}%20x" for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3] + b"zz 0.0.0.0 1 t 99\n"))


def test_second_version_and_other_records_convert(spark, tmp_path):
    data = warc.arc_version_block("n.arc", "20200102030405", 2) + b"\n"
    data += warc.arc_record("http://h/", "20200102030405", warc.http_block(7, b"pay"), 2) + b"\n"
    data += warc.arc_record("dns:h", "20200102", b"h 1.2.3.4", 2) + b"\n"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "n.arc").write_bytes(data)
    warc.convert(spark, str(folder), str(tmp_path / "warc"))
    files = warc._read(spark, str(tmp_path / "warc")).collect()
    records = [r for f in files for r in warc.parse_warc(warc._unpacked(bytes(f.content)))]
    kinds = {fields[b"warc-type"]: (fields, block) for fields, block in records}
    assert set(kinds) == {b"warcinfo", b"response", b"resource"}
    assert kinds[b"resource"][1] == b"h 1.2.3.4" and kinds[b"resource"][0][b"warc-date"] == b"2020-01-02T00:00:00Z"
    fields, block = kinds[b"response"]
    assert block.endswith(b"\r\n\r\npay") and fields[b"warc-date"] == b"2020-01-02T03:04:05Z"
    assert fields[b"warc-payload-digest"].decode() == "sha1:" + warc.payload_digest(b"pay")


def test_identifiers_hold_their_number():
    for n in (0, 1, -1, 2**63 - 1, -(2**63)):
        identifier = warc.record_uuid(n)
        assert identifier.version == 8 and identifier.variant == uuid.RFC_4122
        assert warc.record_number(identifier) == n
    assert warc.record_number(warc.record_uuid(None, b"x")) is None


def test_a_page_of_the_version_scheme_is_a_page(spark):
    rows = [(1, "filedesc://x.arc", "one", "c"), (2, "filedesc://1 0 names", "two", "c"), (3, "http://h/", "one", "c")]
    found = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1)}
    assert found[2].payload_digest == warc.payload_digest(b"two")
