import gzip
import hashlib
import io
import re
import tracemalloc
import zlib
from collections import defaultdict

import pytest

from auxoline.llm import warc as W

WIDE = "page_id long, url string, html string, `Row_ID` string, digest string, path int"


def pages():
    big = "<p>café 中文</p>" * 100
    texts = [big] * 40 + [f"{'x' * 2000}{i % 7}" for i in range(30)] + ["x" * 999] * 5 + ["x" * 1000] * 3 + ["é" * 499] * 2 + ["é" * 500] * 2 + ["", None, None, "\r\n\r\nWARC/1.1\r\n", "long " * 400_000, "nul\x00" * 300, "nul\x00" * 300]
    rows = [(i * 7 % 1009, f"https://h{i}.com/ä?q={i}", t, None, "d", i) for i, t in enumerate(texts)]
    urls = ["", " padded ", "two\r\nX-Page-Id: 9", "tab\there", None, "a%20b", "\x7f"]
    rows += [(2000 + i, u, big, "r", None, None) for i, u in enumerate(urls)]
    # Repeated rows, one id with two payloads, ids that are null, a group whose ids are all null.
    return [*rows, rows[0], rows[3], (rows[1][0], "u", "another payload", None, None, None), (None, None, big, None, None, None), (None, "n", "z" * 3000, None, None, None), (None, "n", "z" * 3000, None, None, None), (None, None, None, None, None, None)]


def expected(rows, least=1000):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append(r[0])
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        top = ids[-1]
        for k, i in enumerate(ids):
            copy = len(payload) >= least and k < len(ids) - 1
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if copy else "response", top if copy else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "roll"), [(1 / 1000, 1 << 30), (1 / 5, 3000), (2.0, 1)])
def test_round_trip(spark, share, roll):
    rows = pages()
    docs = spark.createDataFrame(rows, WIDE).repartition(3)
    archives = W.write_pages(docs, share=share, roll=roll)
    got = sorted((tuple(r) for r in W.read_pages(archives).collect()), key=str)
    assert got == expected(rows)
    assert sum(r.records for r in archives.collect()) == len(rows)
    read = W.read_records(archives, content=True).collect()
    payloads = {r.payload_digest: bytes(r.content) for r in read if r.record_type == "response"}
    ours = lambda p, u, c: (p, u, None if c is None else hashlib.sha1(c).hexdigest())
    back = sorted(((None if r.page_id is None else int(r.page_id), None if r.url is None else r.url.decode(), payloads[r.payload_digest]) for r in read), key=lambda x: str(ours(*x)))
    assert back == sorted(((r[0], r[1], (r[2] or "").encode()) for r in rows), key=lambda x: str(ours(*x)))


def test_archives_are_what_other_readers_expect(spark):
    archives = W.write_pages(spark.createDataFrame(pages(), WIDE)).collect()
    for a in archives:
        data = open(a.path.removeprefix("file:"), "rb").read()
        assert len(data) == a.bytes
        # A member per record.
        members, rest = [], data
        while rest:
            z = zlib.decompressobj(31)
            members.append(z.decompress(rest))
            rest = z.unused_data
        assert len(members) == a.records + 1 and b"".join(members) == gzip.decompress(data)
        for m in members:
            head, _, rest = m.partition(b"\r\n\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[length:] == b"\r\n\r\n"


def archive(*payloads, level=1):
    out = b""
    for p in payloads:
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(p)
        fields = [("WARC-Type", b"response"), ("WARC-Record-ID", b"<urn:x>"), ("Content-Type", b"application/http; msgtype=response"), ("WARC-Payload-Digest", W._sha1(hashlib.sha1(p).digest()))]
        out += b"".join(W.frame_record(fields, http, p, level=level))
    return out


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 16])
def test_any_size_of_pieces(piece):
    payloads = [b"", b"a", b"\r\n\r\n" * 9, bytes(range(256)) * 9, b"x" * 5000]
    got = [(r[7], r[9]) for r in W.records(io.BytesIO(archive(*payloads)), content=True, piece=piece)]
    assert got == [(len(p), p) for p in payloads]


def test_damage_is_found():
    good = archive(b"first payload", b"second payload")
    assert len(list(W.records(io.BytesIO(good)))) == 2
    for cut in range(1, len(good)):
        if cut != len(archive(b"first payload")):
            with pytest.raises(W.WarcError):
                list(W.records(io.BytesIO(good[:cut])))
    with pytest.raises(W.WarcError):
        list(W.records(io.BytesIO(good + b"garbage")))

    def member(text):
        return gzip.compress(text)

    plain = gzip.decompress(archive(b"some payload"))
    for old, new in ((b"some payload", b"same payload"), (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 12", b"Content-Length: 13"), (b"payload\r\n\r\n", b"payload\r\n\r\nx"), (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A"), (b"HTTP/1.1 200 OK\r\n", b"HTTP/1.1 200 OK\r\nno field\r\n")):
        assert old in plain
        with pytest.raises(W.WarcError):
            list(W.records(io.BytesIO(member(plain.replace(old, new)))))


def test_memory_stays_bounded():
    z, size = zlib.compressobj(1, zlib.DEFLATED, 31), 300 << 20
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % size
    data = z.compress(head) + b"".join(z.compress(bytes(1 << 20)) for _ in range(300)) + z.compress(b"\r\n\r\n") + z.flush()
    tracemalloc.start()
    (record,) = W.records(io.BytesIO(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert record[7] == size and peak < 4 << 20


def test_lost_records_and_references(spark):
    docs = spark.createDataFrame(pages(), WIDE)
    archives = W.write_pages(docs, roll=1)
    read = W.read_records(archives)
    assert W.dangling(read).count() == 0
    assert W.dangling(read.filter("record_type = 'revisit'")).count() == read.filter("record_type = 'revisit'").select("refers_id").distinct().count() > 0
    with pytest.raises(Exception, match="has 1 records, not 2"):
        W.read_records(archives.selectExpr("path", "records + 1 records")).count()


def test_empty(spark):
    archives = W.write_pages(spark.createDataFrame([], WIDE))
    assert archives.count() == 0 and W.read_pages(archives).count() == 0
