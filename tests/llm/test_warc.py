from __future__ import annotations

import gzip
import os
import zlib

import pytest

from parleystat.llm import warc
from parleystat.llm.common import scratch

PAGES = "page_id long, url string, html string, payload string, keeper long, _digest string"


def archive(n: int, compress: bool) -> tuple[bytes, list[bytes]]:
    payloads = [f"<p>page {i} {'x' * (i * 37 % 500)}</p>".encode() for i in range(n)]
    out = b""
    for i, p in enumerate(payloads):
        record = warc._record(i, f"http://h/{i}", p, None, False) + warc.END
        out += gzip.compress(record, mtime=0) + warc.EMPTY_MEMBER if compress else record
    return out, payloads


def bodies(found) -> list[bytes]:
    return [warc.payload_of(x.headers, x.block) for x in found if isinstance(x, warc.Record)]


@pytest.mark.parametrize("compress", [True, False])
def test_whole_archive(compress):
    data, payloads = archive(20, compress)
    found = list(warc.salvage(data))
    assert bodies(found) == payloads and len(found) == 20


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_the_records_it_hits(compress, seed):
    import random

    rng = random.Random(seed)
    data, payloads = archive(30, compress)
    whole = list(warc.salvage(data))
    at = rng.randrange(len(data) - 40)
    size = rng.randrange(1, 40)
    broken = bytearray(data)
    broken[at : at + size] = bytes(b ^ 0x55 for b in broken[at : at + size])
    found = list(warc.salvage(bytes(broken)))
    untouched = [warc.payload_of(r.headers, r.block) for r in whole if r.end <= at or r.start >= at + size]
    assert set(untouched) <= set(bodies(found))
    assert set(bodies(found)) <= set(payloads)
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert all(g.reason and g.start < g.end for g in gaps)
    order = [(x.start, x.end) for x in found]
    assert order == sorted(order) and all(a[1] <= b[0] for a, b in zip(order, order[1:]))


def test_truncation_noise_and_mixed_kinds():
    packed, first = archive(3, True)
    plain, second = archive(2, False)
    noise = b"\x1f\x8b\x08junk WARC/1.0 junk"
    found = list(warc.salvage(noise + packed + noise + plain + packed[:50]))
    assert bodies(found) == first + second
    assert len([x for x in found if isinstance(x, warc.Gap)]) == 3
    assert list(warc.salvage(b"")) == []
    assert list(warc.salvage(b"nothing here")) == [warc.Gap(0, 12, "no version line")]


def test_payload_that_quotes_a_record_is_not_split():
    inner = warc._record(9, "u", b"inner", None, False) + warc.END
    data = warc._record(1, "u", inner, None, False) + warc.END
    assert bodies(warc.salvage(data)) == [inner]


def results(spark, rows, least=0, compress=True):
    path = scratch(spark, "warc-test")
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_warc(warc.with_revisits(pages, least), path, compress)
    events = warc.read_warc(spark, path)
    assert events.where("kind = 'gap'").count() == 0
    return sorted((tuple(r) for r in warc.page_results(events).collect()), key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_nulls_ties_and_repeated_rows(spark, compress):
    page = lambda i, html, url="http://u/ x": (i, url, html, "p", 1, "d")
    rows = [page(1, "same"), page(5, "same"), page(5, "same"), page(None, "same"), page(2, None, None), page(3, ""),
            page(4, "WARC/1.1\r\n\r\n\r\nx"), page(None, "lone"), page(6, "日本語\x00é" * 5000)]
    found = results(spark, rows, compress=compress)
    digest = warc.sha1_base32
    expected = [
        (1, 4, digest(b"same"), "revisit", 5), (5, 4, digest(b"same"), "response", None), (5, 4, digest(b"same"), "response", None),
        (None, 4, digest(b"same"), "revisit", 5), (2, 0, digest(b""), "revisit", 3), (3, 0, digest(b""), "response", None),
        (4, 15, digest(b"WARC/1.1\r\n\r\n\r\nx"), "response", None), (None, 4, digest(b"lone"), "response", None),
        (6, 60000, digest(("日本語\x00é" * 5000).encode()), "response", None),
    ]
    assert found == sorted(expected, key=str)


def test_least_bytes_and_empty_table(spark):
    rows = [(1, "u", "ab", "", 1, ""), (2, "u", "ab", "", 1, ""), (3, "u", "abc", "", 1, ""), (4, "u", "abc", "", 1, "")]
    kinds = {r[0]: r[3] for r in results(spark, rows, least=3)}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert results(spark, []) == []


def test_gaps_are_rows(spark, tmp_path):
    data, payloads = archive(4, True)
    with open(os.path.join(tmp_path, "a.warc.gz"), "wb") as file:
        file.write(data[:30] + b"####" + data[34:])
    events = warc.read_warc(spark, str(tmp_path)).collect()
    gap = [r for r in events if r.kind == "gap"]
    assert len(gap) == 1 and gap[0].offset == 0 and gap[0].reason and gap[0].path.endswith("a.warc.gz")
    assert [bytes(r.payload) for r in events if r.kind == "record"] == payloads[1:]


@pytest.mark.parametrize("compress", [True, False])
def test_a_very_long_url_is_read_back(spark, compress):
    url = "http://h/" + "é /" * (2 << 18) + "x" * (2 << 20)
    rows = [(1, url, "long", "", 1, ""), (2, "u", "short", "", 1, "")]
    assert [r[:2] for r in results(spark, rows, compress=compress)] == [(1, 4), (2, 5)]


def test_damage_in_a_very_long_header_costs_its_record_only():
    records = [warc._record(i, f"http://h/{'x' * (2 << 20)}", b"%d" % i, None, False) + warc.END for i in range(3)]
    broken = records[0] + records[1].replace(b"xxx", b"x\0x", 1) + records[2]
    assert bodies(warc.salvage(broken)) == [b"0", b"2"]


def test_header_of_version_lines_is_walked_once():
    lines = b"WARC/1.1\r\n" + b"a: WARC/1.1\r\n" * 100_000
    whole = warc._record(1, "u", b"after", None, False) + warc.END
    assert bodies(warc.salvage(lines + b"\0\r\n" + whole)) == [b"after"]
    assert bodies(warc.salvage(lines)) == []


def records(n: int) -> list[bytes]:
    return [warc._record(i, f"http://h/{i}", b"%d " % i * (i * 37 % 500), None, False) + warc.END for i in range(n)]


def all_but(found, *lost, of=40):
    assert [int(x.headers["warc-record-id"][10:-1]) for x in found if isinstance(x, warc.Record)] == [
        i for i in range(of) if i not in lost
    ]
    return [x for x in found if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("per_member", [40, 7])
@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("field", [b"WARC-Block-Digest: sha1:", b"\r\nContent-Length: ", b"WARC/1."])
def test_a_wrong_field_inside_a_member_costs_one_record(per_member, level, field):
    parts = records(40)
    at = parts[20].index(field) + len(field)
    wrong = bytes([parts[20][at] ^ 1])
    parts[20] = parts[20][:at] + wrong + parts[20][at + 1 :] if field != b"WARC/1." else b"?" + parts[20][1:]
    members = [b"".join(parts[i : i + per_member]) for i in range(0, 40, per_member)]
    packed = [gzip.compress(m, level, mtime=0) for m in members]
    gaps = all_but(list(warc.salvage(b"".join(packed))), 20)
    mine = 20 // per_member
    start, inner = len(b"".join(packed[:mine])), len(b"".join(parts[mine * per_member : 20]))
    assert [(g.start, g.end, g.inner) for g in gaps] == [(start, start + len(packed[mine]), (inner, inner + len(parts[20])))]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("seed", range(8))
def test_a_cut_or_broken_stream_gives_what_comes_before(level, seed):
    import random

    parts = records(40)
    data = gzip.compress(b"".join(parts), level, mtime=0)
    at = random.Random(seed).randrange(20, len(data) - 8)
    before, ends = zlib.decompressobj(31).decompress(data[:at]), [len(b"".join(parts[: i + 1])) for i in range(40)]
    whole = [i for i in range(40) if ends[i] <= len(before)]
    after = gzip.compress(warc._record(99, "u", b"next", None, False) + warc.END, mtime=0)
    cut = list(warc.salvage(data[:at]))
    assert [x.block for x in cut if isinstance(x, warc.Record)] == [warc._parse(parts[i], 0).block for i in whole]
    assert cut[-1].reason == "truncated member" and cut[-1].end == at
    for broken in (data[:at] + after, data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :] + after):
        found = [x.headers["warc-record-id"] for x in warc.salvage(broken) if isinstance(x, warc.Record)]
        assert found[: len(whole)] == [f"<urn:page:{i}>" for i in whole] and found[-1] == "<urn:page:99>"
        assert len(set(found)) == len(found)


@pytest.mark.parametrize("damage", ["cut", "flip"])
@pytest.mark.parametrize("level", [0, 1, 6, 9])
def test_a_lost_decoder_invents_and_loses_nothing(level, damage):
    """Whatever the bytes of the member behind the damage are (its time stamp runs through 500 values)."""
    import random
    import struct

    parts = records(40)
    data = gzip.compress(b"".join(parts), level, mtime=0)
    given = {warc._parse(p, 0).block for p in parts}
    rng = random.Random(level)
    last = warc._record(99, "u", b"next", None, False) + warc.END
    packed = gzip.compress(last, mtime=0)
    for stamp in range(500):
        at = rng.randrange(20, len(data) - 8)
        after = packed[:4] + struct.pack("<I", rng.randrange(1 << 32)) + packed[8:]
        broken = data[:at] + after if damage == "cut" else data[:at] + bytes([data[at] ^ rng.randrange(1, 256)]) + data[at + 1 :] + after
        found = [x for x in warc.salvage(broken) if isinstance(x, warc.Record)]
        before = zlib.decompressobj(31).decompress(data[:at])
        whole = [i for i in range(40) if len(b"".join(parts[: i + 1])) <= len(before)]
        ids = [x.headers.get("warc-record-id") for x in found]
        assert ids[: len(whole)] == [f"<urn:page:{i}>" for i in whole] and ids[-1] == "<urn:page:99>"
        assert found[-1].verified and found[-1].block == warc._parse(last, 0).block
        assert all(x.block in given for x in found[:-1])
        harmless = warc._inflate(broken, 0)[2] is None  # the bit changed is one that nothing depends on
        assert all(x.verified == harmless for x in found[:-1])
        if damage == "cut":
            assert len(ids) == len(whole) + 1
        else:  # what lies behind a changed byte may come with changed header lines; it is marked and comes once
            assert len({(x.block, *x.headers.items()) for x in found}) == len(found)


def test_a_wrong_checksum_costs_only_records_without_a_block_digest():
    bare = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab" + warc.END
    data = gzip.compress(b"".join([*records(3), bare, *records(1)]), mtime=0)
    assert len(bodies(warc.salvage(data))) == 5
    found = list(warc.salvage(data[:-8] + b"\0" * 8 + data))
    assert [x.reason for x in found if isinstance(x, warc.Gap)] == ["no block digest to tell by", "broken compression"]
    assert len(bodies(found)) == 9


@pytest.mark.parametrize("compress", [True, False])
def test_records_quoted_in_a_record_with_a_wrong_digest(compress):
    inner = b"<pre>" + b"".join(records(2)) + b"</pre>"
    wrong = warc._record(7, "u", inner, None, False).replace(b"</pre>", b"</prE>") + warc.END
    data = b"".join([*records(2), wrong, *records(2)])
    found = list(warc.salvage(gzip.compress(data) if compress else data))
    assert len(bodies(found)) == 4 and [x.reason for x in found if isinstance(x, warc.Gap)] == ["block digest differs"]


def test_gaps_inside_members_are_rows(spark, tmp_path):
    parts = records(5)
    with open(os.path.join(tmp_path, "a.warc.gz"), "wb") as file:
        file.write(gzip.compress(b"".join([*parts[:2], b"?" + parts[2][1:], *parts[3:]])))
    events = warc.read_warc(spark, str(tmp_path)).collect()
    inner = [len(b"".join(parts[:i])) for i in range(5)]
    assert [(r.kind, r.offset, r.inner_offset, r.inner_length) for r in events] == [
        ("gap" if i == 2 else "record", 0, inner[i], len(parts[i])) for i in range(5)
    ]
