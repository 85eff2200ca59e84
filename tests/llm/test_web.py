import base64
import datetime as dt
import gzip
import hashlib
import random

import duckdb
import pytest

from tallywire.llm.queries import ORACLES, QUERIES
from tallywire.llm.url_filters import list_intervals, url_filter
from tallywire.llm.warc import encode_record, member, parse_record, read_warc, round_trip, salvage

D = dt.date.fromisoformat


def entries(spark, rows):
    return spark.createDataFrame([(k, v, a, None if d is None else D(d)) for k, v, a, d in rows], "kind string, value string, action string, listed_on date")


LIST = [
    ("domain", "bad.org", "block", "2024-01-10"), ("domain", "bad.org", "remove", "2024-02-10"), ("domain", "Bad.org", "block", "2024-03-10"), ("domain", "ok.bad.org", "allow", "2024-01-01"), ("prefix", "x.com/ads", "block", "2024-01-01"),
    ("url", "x.com/ads/fine", "allow", "2024-01-05"), ("domain", "tie.org", "allow", "2024-01-01"), ("domain", "tie.org", "block", "2024-01-01"), ("domain", "bad.org", "block", "2024-01-10"), ("domain", None, "block", "2024-01-01"), ("domain", "n.org", "block", None),
    ("prefix", "x.com/a/b/", "block", "2024-01-01"), ("prefix", "x.com/a", "allow", "2024-01-01"), ("prefix", "whole.net", "block", "2024-01-01"), ("url", "x.com/q?id=1", "block", "2024-01-01"), ("domain", "[::1]", "block", "2024-01-01"),
]


def brute(url, on):
    import re

    m = re.match(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?", (url or "").lower())
    if not m or on is None:
        return "none", 0
    host = m[1].rpartition("@")[2]
    host = host[: host.index("]") + 1] if host.startswith("[") else host.partition(":")[0].removesuffix(".")
    path, query = m[2], m[3] or ""
    steps = [x for x in path.split("/") if x]
    prefixes = ["/".join([host, *steps[:k]]) for k in range(len(steps) + 1)]
    if not host:
        return "none", 0
    found = []
    for kind, value in {(k, v.lower()) for k, v, _, d in LIST if v and d}:
        held = sorted((d, a) for k, v, a, d in LIST if d and v and (k, v.lower()) == (kind, value) and D(d) <= on)
        if not held or held[-1][1] == "remove":
            continue
        value = value.rstrip("/") if kind == "prefix" else value
        fits = {"domain": host == value or host.endswith("." + value), "prefix": value in prefixes, "url": value in (host + path, host + path + query)}[kind]
        if fits:
            found.append(({"url": 10**6 + len(value), "prefix": 9 * 10**5 + value.count("/")}.get(kind, value.count(".") + 1), held[-1][1]))
    return (max(found)[1] if found else "none"), len(found)


def test_filter_as_of_the_fetch(spark):
    urls = ["http://bad.org/", "https://u:p@www.BAD.org:8080/x?y", "http://ok.bad.org/z", "http://notbad.org/", "http://x.com/ads/foo", "http://x.com/ads/fine?q=1", "http://x.com/adsx", "http://tie.org", "mailto:x", "", None]
    urls += ["http://x.com/a", "http://x.com/a/b", "http://x.com/a//b/c.html", "http://x.com/a/bc", "http://whole.net", "http://sub.whole.net/", "http://x.com/q?id=1", "http://x.com/q?id=1#z", "http://x.com/q?id=12", "http://x.com/q", "http://[::1]:80/x", "http://bad.org./", "//bad.org/a", "http:///x", "http://u@/x"]
    rows = [(i, u, d, "h") for i, (u, d) in enumerate((u, d) for u in urls for d in (D("2024-01-09"), D("2024-01-10"), D("2024-02-09"), D("2024-02-10"), D("2024-05-01"), None))]
    rows.append(rows[0])
    caps = spark.createDataFrame(rows, "page_id bigint, url string, fetched_on date, decision string")
    got = url_filter(caps, entries(spark, LIST)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.decision, r.n_active) == brute(r.url, r.fetched_on), r
    assert url_filter(caps.limit(0), entries(spark, LIST)).count() == 0
    assert {r.decision for r in url_filter(caps, entries(spark, [])).collect()} == {"none"}


def test_intervals(spark):
    got = sorted((r.valid_from, r.valid_to) for r in list_intervals(entries(spark, LIST)).filter("value = 'bad.org'").collect())
    assert got == [(D("2024-01-10"), D("2024-02-10")), (D("2024-03-10"), None)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, record string, offset bigint")


def test_round_trip(spark):
    r = random.Random(1)
    big = "<p>é🙂</p>" * 50
    rows = [(i, f"http://a/{i}", r.choice([big, big + "x", "short", None, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "\0\r\n\r\n" * 40])) for i in range(80)]
    rows += [(None, None, big), (900, "http://a/ü b\r\nX: y", "".join(chr(r.randrange(32, 900)) for _ in range(200_000)))]
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, 10**9), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[b] != (-1 if i is None else i)
        want.append((str(i) if i is not None else "null", len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", ("null" if first[b] < 0 else str(first[b])) if revisit else None))
    got = round_trip(pages(spark, rows))
    assert got.filter("kind = 'gap'").count() == 0
    out = got.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert round_trip(pages(spark, [])).count() == 0


def records(n):
    out = []
    for i in range(n):
        p = (f"<html>{i}</html>" * (i + 1)).encode()
        out.append(encode_record("response", str(i), f"http://a/{i}", p, hashlib.sha256(p).hexdigest(), len(p)))
    return out


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_later_records(zipped):
    parts = [member(x) if zipped else x for x in records(12)]
    whole = b"".join(parts)
    assert [k for k, *_ in salvage(whole)] == ["record"] * 12
    r = random.Random(3)
    for _ in range(150):
        hit = r.randrange(12)
        at = sum(map(len, parts[:hit]))
        data = bytearray(whole)
        a = at + r.randrange(len(parts[hit]))
        how = r.randrange(3)
        if how == 0:
            data[a] ^= 1 << r.randrange(8)
        elif how == 1:
            del data[a : a + r.randrange(1, 9)]
        else:
            data[a:a] = bytes(r.randrange(256) for _ in range(5))
        got = list(salvage(bytes(data)))
        ids = {x[0]["warc-record-id"] for k, _, _, x, _ in got if k == "record"}
        assert {f"<urn:page:{i}>" for i in range(12) if abs(i - hit) > 1} <= ids and len(ids) >= 10
        at = 0
        for k, o, n, *_ in got:
            assert o == at or (k == "record" and n == 0 and o < at)
            at += n
        assert at == len(data)


def test_members_of_several_records():
    whole = records(5)
    bad = whole[2][:-30] + b"?" + whole[2][-29:]
    for parts, gaps in ((whole, 0), ([*whole[:2], bad, *whole[3:]], 1), ([b"junk", *whole], 1)):
        data = member(whole[0]) + gzip.compress(b"".join(parts)) + member(whole[4])
        got = list(salvage(data))
        assert sum(k == "gap" for k, *_ in got) == gaps
        want = [i for i, x in enumerate(whole) if x in parts]
        assert [x[0]["warc-record-id"] for k, _, _, x, _ in got if k == "record"] == [f"<urn:page:{i}>" for i in [0, *want, 4]]
        at = 0
        for _, _, n, x, inner in got[1:-1]:
            assert inner == at
            at += len(bad) if gaps and x == "block digest differs" else 4 if isinstance(x, str) else len(whole[int(x[0]["warc-record-id"][10:-1])])


@pytest.mark.parametrize("how", ["cut", "flipped"])
def test_records_before_the_damage_of_a_member(how):
    r = random.Random(1)
    whole = [encode_record("response", str(i), "http://a", p := r.randbytes(3000), hashlib.sha256(p).hexdigest(), 3000) for i in range(40)]
    one = bytearray(gzip.compress(b"".join(whole)))
    at = len(one) * 3 // 4
    if how == "cut":
        del one[at:]
    else:
        one[at : at + 40] = b"\xff" * 40
    got = list(salvage(member(whole[0]) + bytes(one) + member(whole[1])))
    ids = [int(x[0]["warc-record-id"][10:-1]) for k, _, _, x, _ in got if k == "record"]
    assert ids[0] == 0 and ids[-1] == 1 and ids[1:-1] == list(range(len(ids) - 2)) and len(ids) > 25
    assert sum(k == "gap" for k, *_ in got) == 1


def test_folded_headers():
    x = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nX-Long: one\r\n two\r\n\tthree\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    heads, block, end = parse_record(x)
    assert heads["x-long"] == "one two three" and block == b"ok" and end == len(x)


def foreign(kind, block, *heads):
    return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x:1>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Length: {len(block)}", *heads]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    body, http = b"<p>a\r\n\r\nb</p>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    of_http = "Content-Type: application/http; msgtype=response"
    parts = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("response", http + body, of_http, f"WARC-Payload-Digest: {sha1(body)}", f"WARC-Block-Digest: {sha1(http + body)}"),
        foreign("response", http[:-2] + b"Transfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", of_http, f"WARC-Payload-Digest: {sha1(b'abcde')}"),
        foreign("resource", body, "Content-Type: text/html", "WARC-Payload-Digest: blake3:00"),
        foreign("conversion", b"text", "Content-Type: text/plain", f"WARC-Payload-Digest: {sha1(b'text')}"),
        foreign("revisit", http, of_http, f"WARC-Payload-Digest: {sha1(body)}"),
        foreign("response", http + body, of_http, f"WARC-Payload-Digest: {sha1(b'other')}"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    got = read_warc(spark, str(tmp_path), payloads=True).orderBy("offset").collect()
    assert [(r.kind, r.record_type, r.payload_bytes) for r in got] == [("record", "warcinfo", 13), ("record", "response", len(body)), ("record", "response", 20), ("record", "resource", len(body)), ("record", "conversion", 4), ("record", "revisit", None), ("gap", None, None)]
    assert got[1].payload == body and got[3].payload_digest == hashlib.sha256(body).hexdigest() and got[5].payload_digest == sha1(body)[5:]


def test_members_are_gzip():
    x = records(1)[0]
    assert gzip.decompress(member(x)) == x and member(x)[-1] == 0
    big = encode_record("response", "1", "http://a", b"z" * (17 << 20), "", 17 << 20)
    assert member(big)[-1] == 0 and gzip.decompress(member(big)) == big
    assert parse_record(x)[2] == len(x)


def test_damaged_file_logs_a_gap(spark, tmp_path):
    parts = [member(x) for x in records(5)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"garbage" + parts[1] + parts[2][:-9] + parts[3] + parts[4])
    got = read_warc(spark, str(tmp_path), payloads=True).collect()
    assert [r.record_id for r in got if r.kind == "record" and r.length] == ["0", "1", "3", "4"] and sum(r.kind == "gap" for r in got) == 2
    assert next(r for r in got if r.record_id == "1").payload == b"<html>1</html>" * 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data), c.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(str(tuple(r[x] for x in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
