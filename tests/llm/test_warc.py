import gzip
import hashlib
import io
import random

from txscore.llm import warc

SCHEMA = "page_id long, url string, html string, path string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash", 1) for p, u, h in rows], SCHEMA)


def brute(rows, min_bytes=0):
    best = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= min_bytes:
            best[h or ""] = max(best.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        refers = best.get(h or "") if p is not None and len(b) >= min_bytes and best.get(h or "", p) != p else None
        out.append((p, len(b), warc.digest(b), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def back(spark, rows, min_bytes=0, **more):
    found = warc.read_warc(warc.write_warc(pages(spark, rows), min_bytes=min_bytes), **more)
    return found, sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()), key=repr)


def rows_of(seed):
    r = random.Random(seed)
    noise = "".join(chr(r.randrange(32, 0x2FF)) for _ in range(30_000))
    return [(k, r.choice([None, "http://a/ü\r\nX: y", "http://b/"]), r.choice([None, "", "x", "WARC/1.1\r\n\r\n", "\x1f\u008b\x08" * 50, noise, f"<p>{k}</p>" * 40])) for k in range(60)]


def test_round_trip_with_small_ranges(spark):
    rows = rows_of(1) + [(None, "u", "x"), (None, None, None), (7, "again", "x")]
    for range_bytes in (64, 1000, 1 << 20):
        found, got = back(spark, rows, range_bytes=range_bytes)
        assert got == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in found.where("warc_type = 'response' and page_id is not null").collect()}
    texts = {p: (h or "").encode() for p, _, h in rows if p != 7}
    assert all(payloads[p] == texts[p] for p in payloads if p != 7)


def test_least_size(spark):
    rows = [(1, "a", "xx"), (2, "a", "xx"), (3, "a", ""), (4, "b", None), (5, "b", "yyyy"), (6, "b", "yyyy")]
    assert back(spark, rows, min_bytes=3)[1] == brute(rows, 3)


def test_empty_table(spark):
    assert back(spark, [])[1] == []


def test_archives_are_gzip_and_listed(spark):
    rows = rows_of(2)
    files = warc.write_warc(pages(spark, rows)).collect()
    total = 0
    for f in files:
        raw = open(f.path.removeprefix("file://"), "rb").read()
        assert len(raw) == f.bytes
        total += gzip.decompress(raw).count(b"WARC-Record-ID")
    assert total >= len(rows) == sum(f.records for f in files)
    folder = files[0].path.rpartition("/")[0]
    listed = warc.list_warc(spark, folder)
    assert listed.count() == len(files) and warc.read_warc(listed).count() == len(rows)


def test_false_magic_and_torn_members():
    good = warc.record("response", 1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest())
    other = gzip.compress(b"no archive record at all")
    data = b"junk" + warc.MAGIC + b"\x00" * 9 + good + other + warc.MAGIC + good + good[:-9]
    ends = [(0, len(data))] + [(k, k + 7) for k in range(0, len(data), 7)]
    whole = [at for at, _, _ in warc.records_of(io.BytesIO(data), len(data), *ends[0])]
    parts = [at for a, b in ends[1:] for at, _, _ in warc.records_of(io.BytesIO(data), len(data), a, min(b, len(data)))]
    assert len(whole) == 2 and parts == whole


def test_hot_payloads_on_both_paths(spark):
    """A third of all pages share one payload, whether digests are broadcast or joined by a shuffle."""
    rows = [(k, "http://a/", "the copied page" if k % 3 == 0 else f"p{k % 50}") for k in range(400)] + [(7, "again", "the copied page"), (None, "u", "p1")] + [(11, "http://a/", "p11")] * 2
    for limit in (0, 10**6):
        archives = warc.write_warc(pages(spark, rows).repartition(6), broadcast_digests=limit)
        found = warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_drafts_of_failed_attempts_go(spark, tmp_path):
    (tmp_path / "part-000009.warc.gz.77").write_bytes(b"half a record")
    warc.write_warc(pages(spark, [(1, "u", "x")]), str(tmp_path))
    assert not list(tmp_path.glob("*.gz.*")) and list(tmp_path.glob("*.warc.gz"))
