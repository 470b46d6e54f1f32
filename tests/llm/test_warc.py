import base64
import gzip
import hashlib
import os
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st

from crossfade.llm import queries, warc
from crossfade.sources.staging import shared_folder, stage_path

MARK = "\r\n\r\nWARC/1.1\r\n"
PAGES = "page_id bigint, url string, html string, type string, block int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@given(st.binary(max_size=300), st.integers(1, 40))
def test_framing_round_trip(payload, size):
    assert warc.unframed(warc.framed(payload, size)) == payload
    assert warc.decoded(warc._HTTP + warc.framed(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-3\r\nabc\r\n0\r\n\r\n"])
def test_broken_framing(body):
    assert warc.unframed(body) is None


def test_chunk_extensions_trailers_and_plain_bodies():
    assert warc.unframed(b"3;a=b\r\nabc\r\n0\r\nX-Y: z\r\n\r\n") == b"abc"
    assert warc.decoded(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc") == b"abc"
    assert warc.decoded(b"no head") is None


@given(st.lists(st.lists(st.sampled_from(["\r\n", "\r\n\r\n", "WARC/1.1\r\n", MARK, "x", "a: b"]), max_size=8).map("".join), max_size=6))
def test_records_come_back_from_a_cut_archive(blocks):
    records = [warc._record([(b"WARC-Type", b"response"), (b"A", b"b")], b.encode()) for b in blocks]
    archive = b"".join(r + b"\r\n\r\n" for r in records)
    found = list(warc._whole(iter(archive.split(warc._MARK)))) if archive else []
    assert found == [(r.removeprefix(b"WARC/1.1\r\n"), True) for r in records]


def test_no_record_is_missed_at_the_edges_of_read_buffers(spark):
    rows = [(i, f"http://h/{i}/WARC/1.1", "\r\n" * (i % 7) + "x" * (i * 31 % 251) + "\r\n" * (i % 5) + str(i), "", 0) for i in range(20_000)]
    found = warc.payloads(warc.records(spark, written(spark, rows))).filter("type = 'response'").collect()
    assert len(found) == len(rows) and all(r["intact"] for r in found)
    assert {bytes(r["payload"]).decode() for r in found} == {r[2] for r in rows}


def written(spark, rows, schema=PAGES, **how):
    path = stage_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, schema), path, **how)
    return path


def test_round_trip_of_nulls_long_texts_repeats_and_marks(spark):
    nasty = [MARK * 3, MARK + "WARC-Type: response\r\nContent-Length: 3" + "\r\n\r\nabc", "\r\n", "é" * 5000, "WARC/1.1\r\n", "0\r\n\r\n", "x" * 300_000, "a\0b"]
    rows = [(i, f"http://h/{i}", t, "t", 1) for i, t in enumerate(nasty)]
    rows += [(20, None, None, "t", 1), (21, "http://h/\r\nWARC-Type: x", "", "t", 1), (22, "u", "same", "t", 1), (25, "u", "same", "t", 1), (25, "u", "same", "t", 1)]
    rows += [(None, "u", "same", "t", 1), (None, "u", "no id", "t", 1), (None, "u", "no id", "t", 1), (30, "u", "own", "t", 1), (30, "u", "another", "t", 1)]
    for how in ({"segment_bytes": 97, "chunk_bytes": 13}, {}):
        path = written(spark, rows, **how)
        found = warc.payloads(warc.records(spark, path)).filter("type != 'warcinfo'").collect()
        assert len(found) == len(rows) and all(r["intact"] for r in found)
        key = lambda t: tuple(map(str, t))
        id_of = lambda n: None if n is None or not n.split(":")[2].split("#")[0] else int(n.split(":")[2].split("#")[0])
        got = sorted(((id_of(r["record_id"]), r["type"], id_of(r["refers_to"]), r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in found), key=key)
        revisits = {(20, ""): 21, (22, "same"): 25, (None, "same"): 25}
        want = []
        for i, _, t, _, _ in rows:
            t = t or ""
            of = revisits.get((i, t))
            want.append((i, "response" if of is None else "revisit", of, digest(t), t if of is None else None))
        assert got == sorted(want, key=key)
        sizes = warc.resolved(warc.payloads(warc.records(spark, path), keep=False)).filter("type = 'revisit'").collect()
        assert sorted(r["payload_bytes"] for r in sizes) == [0, 4, 4] and all(r["intact"] for r in sizes)


def test_least_bytes_and_empty_table(spark):
    rows = [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)]
    found = warc.payloads(warc.records(spark, written(spark, rows, least_bytes=3))).filter("type = 'revisit'").collect()
    assert [r["record_id"].split("#")[0] for r in found] == ["urn:page:3"]
    assert warc.payloads(warc.records(spark, written(spark, []))).count() == 0


def archive(spark, files):
    """Archives made elsewhere: lists of (fields, block)."""
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), f"foreign-{uuid.uuid4().hex}")
    os.makedirs(folder)
    for n, records in enumerate(files):
        with gzip.open(f"{folder}/{n}.warc.gz", "wb") as out:
            for fields, block in records:
                length = fields.pop("Content-Length", len(block))
                head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
                out.write(f"WARC/1.1\r\n{head}Content-Length: {length}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return folder


def test_segments_over_archives_gaps_and_wrong_lengths(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.framed(b"hello, world" * 9, 7)
    parts = [block[:50], block[50:90], block[90:]]

    def record(name, n, part=None, total=None, **more):
        kind = {"WARC-Type": "response", "WARC-Record-ID": f"<{name}>"} if n == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}{n}>", "WARC-Segment-Origin-ID": f"<{name}>"}
        last = {"WARC-Segment-Total-Length": total or len(block)} if n == 3 else {}
        return {**kind, "WARC-Segment-Number": n, **last, **more}, parts[n - 1] if part is None else part

    files = [
        [record("good", 3), record("gap", 3), record("long", 3, total=len(block) + 1), record("lost", 2)],
        [record("good", 1), record("gap", 1), record("long", 1), record("open", 1), record("cut", 1, **{"Content-Length": 10**6})],
        [record("good", 2), record("long", 2), record("open", 2), record("good", 2)],
        [({"WARC-Type": "continuation", "WARC-Record-ID": "<none>", "WARC-Segment-Number": 2}, b"abc"), ({"WARC-Type": "request", "WARC-Record-ID": "<req>"}, b"GET /")],
        [({"WARC-Type": "response", "WARC-Record-ID": "<sum>", "WARC-Payload-Digest": "sha1:AAAA"}, b"HTTP/1.1 200 OK\r\n\r\nabc")],
        [({"WARC-Type": "response", "WARC-Record-ID": "<one>"}, b"HTTP/1.1 200 OK\r\n\r\nabc")],
    ]
    found = {r["record_id"]: r for r in warc.payloads(warc.records(spark, archive(spark, files))).collect()}
    assert bytes(found["good"]["payload"]) == b"hello, world" * 9 and found["good"]["intact"] and found["good"]["segments"] == 3
    assert bytes(found["one"]["payload"]) == b"abc" and found["one"]["intact"]
    assert bytes(found["sum"]["payload"]) == b"abc" and not found["sum"]["intact"]
    for name in ("gap", "long", "lost", "open", "cut", None):
        assert not found[name]["intact"] and found[name]["payload"] is None, name
    assert found["req"]["intact"] and found["req"]["type"] == "request"


def test_revisit_without_its_response(spark):
    revisit = {"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:1#0.0>", "WARC-Refers-To": "<urn:page:9>", "WARC-Payload-Digest": "sha1:AAAA"}
    path = archive(spark, [[(revisit, b"HTTP/1.1 200 OK\r\n\r\n")]])
    (row,) = warc.resolved(warc.payloads(warc.records(spark, path))).collect()
    assert (row["type"], row["payload_bytes"], row["payload_digest"], row["intact"]) == ("revisit", None, "AAAA", False)


def test_query_reads_back_every_page(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "pages").collect()
    last = {}
    for r in rows:
        last[r["html"] or ""] = max(r["page_id"], last.get(r["html"] or "", r["page_id"]))
    want = set()
    for r in rows:
        t = r["html"] or ""
        again = r["page_id"] != last[t]
        want.add((r["page_id"], len(t.encode()), digest(t), "revisit" if again else "response", last[t] if again else None))
    got = queries.QUERIES["op13_warc"](spark, sf_dir).collect()
    assert len(got) == len(rows) and {tuple(r)[:5] for r in got} == want
    assert all(r["intact"] for r in got) and max(r["segments"] for r in got) > 1
