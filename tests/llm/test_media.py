"""Ogg and packaged WARC: round trips, damage, edge cases."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile
import zlib

import pytest

from binomia.llm import ogg, zipwarc


def _plain_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"\0", b"OggS" + bytes(range(256)), random.Random(1).randbytes(1000)):
        assert ogg.checksum(data) == _plain_crc(data)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1152, 576 * 85 * 2, 576 * 171 + 5, 200_000])
def test_ogg_round_trip(size):
    data = random.Random(size).randbytes(size)
    media = ogg.encode(data)
    d = ogg.decode(media)
    assert (d.payload, d.n_bytes) == (ogg.padded(data), size)
    assert d.seconds == len(d.payload) / ogg.RATE
    assert d.streams == 2
    assert media == ogg.encode(data)


def test_packets_over_pages():
    packets = [b"head", b"x" * 70_000, b"", b"y" * 255, b"z" * 65_025, b"w"]
    pages = ogg.write_stream(packets, [0, 10, 20, 30, 40, 50], 7)
    s = ogg.read(b"".join(p for _, p in pages))[7]
    assert s.packets == packets
    assert s.granules[-1] == 50
    other = ogg.write_stream([b"a", b"b"], [0, 1], 8)
    mixed = pages[0][1] + other[0][1] + pages[1][1] + other[1][1] + b"".join(p for _, p in pages[2:])
    assert {k: v.packets for k, v in ogg.read(mixed).items()} == {7: packets, 8: [b"a", b"b"]}


def test_ogg_damage():
    media = bytearray(ogg.encode(b"abc" * 1000))
    for at in (0, 30, 100, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.read(bytes(media[:-10]))


def test_ogg_frames(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "é" * 400, "c"), (3, "é" * 400, "c"), (None, "x", "c")], "doc_id long, text string, media string")
    rows = ogg.read_ogg(ogg.to_ogg(df, "doc_id", "text"), "doc_id").collect()
    assert sorted((r.doc_id or -1, r.n_bytes, len(r.payload)) for r in rows) == [(-1, 1, 576), (1, 0, 576), (2, 0, 576), (3, 800, 1152), (3, 800, 1152)]
    assert len({r.media_sha256 for r in rows}) == 3
    assert ogg.read_ogg(ogg.to_ogg(df.limit(0), "doc_id", "text"), "doc_id").count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(zip64):
    members = [("a/b.txt", b"hello"), ("empty", b""), ("é.bin", bytes(range(256)) * 10)]
    raw = zipwarc.write_zip(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        assert [(i.filename, z.read(i)) for i in z.infolist()] == members
    asked = []
    p = zipwarc.Package(lambda s, n: asked.append(n) or raw[s : s + n], len(raw))
    assert {n: p.whole(n) for n in p.members} == dict(members)
    assert p.range("é.bin", 5, 7) == members[2][1][5:12]


def test_zip_of_another_writer_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", "stored")
        z.writestr("d", "x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 a comment like an end record"
    p = zipwarc.Package.of_bytes(out.getvalue())
    assert p.whole("s") == b"stored"
    with pytest.raises(zipwarc.ZipError):
        p.whole("d")
    with pytest.raises(zipwarc.ZipError):
        zipwarc.Package.of_bytes(out.getvalue()[:40])
    raw = bytearray(zipwarc.write_zip([("s", b"stored")]))
    raw[raw.index(b"stored")] ^= 1
    with pytest.raises(zipwarc.ZipError):
        zipwarc.Package.of_bytes(bytes(raw)).whole("s")


def test_package_records():
    rows = [(1, "http://x/é ü\n", b"p" * 300, 300, hashlib.sha256(b"p" * 300).hexdigest(), None), (2, None, None, 300, hashlib.sha256(b"p" * 300).hexdigest(), 1), (None, "u", b"\r\n\r\n", 4, hashlib.sha256(b"\r\n\r\n").hexdigest(), None)]
    got = {r["page_id"]: r for r in zipwarc.read(zipwarc.Package.of_bytes(zipwarc.build(rows, zip64=True)))}
    assert got[1]["payload"] == b"p" * 300
    assert (got[2]["record_type"], got[2]["refers_to"], got[2]["payload_bytes"], got[2]["payload"]) == ("revisit", 1, 300, None)
    assert got[None]["payload"] == b"\r\n\r\n"
    bad = bytearray(zipwarc.record(*rows[0]))
    bad[-8] ^= 1
    with pytest.raises(zipwarc.ZipError):
        zipwarc.parse(bytes(bad))


def test_warc_pages(spark):
    long = "w" * 200
    rows = [(5, "u", long), (3, None, long), (9, "u", long), (3, None, long), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, body string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in zipwarc.round_trip(pages).collect())
    assert got == [(-1, "response", None, 200), (1, "response", None, 5), (2, "response", None, 5), (3, "response", None, 200), (3, "response", None, 200), (5, "revisit", 3, 200), (7, "response", None, 0), (8, "response", None, 0), (9, "revisit", 3, 200)]
    assert zipwarc.round_trip(pages.limit(0)).count() == 0


def test_payload_crc_is_of_the_last_bytes(spark):
    from binomia.llm.q_ogg import op10_ogg

    row = op10_ogg(spark, "/root/testdata/sf0.001").where("doc_id = 0").collect()[0]
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").collect()[0].text
    payload = ogg.padded(text.encode())
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_package_files(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 400) for i in range(300)]
    marked = zipwarc.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    files = zipwarc.write_packages(marked, f"file:{tmp_path}/w", package_bytes=100_000, zip64=True).collect()
    assert sum(r.records for r in files) == 300 and len(files) > 6
    back = zipwarc.read_packages(spark.createDataFrame(files)).collect()
    assert {r.page_id: r.payload.decode() for r in back} == {r[0]: r[2] for r in rows}
    asked = []
    raw = (tmp_path / "w" / files[0].path.rsplit("/", 1)[1]).read_bytes()
    assert len(list(zipwarc.read(zipwarc.Package(lambda s, n: asked.append(n) or raw[s : s + n], len(raw))))) == files[0].records
    assert max(asked[4:]) < len(raw)  # beyond the directories, an index and single records


def test_ogg_times():
    media = ogg.encode(random.Random(2).randbytes(576 * 171 + 5))
    d = ogg.decode(media)
    assert {c for c, _, _ in d.times} == {0, 1}
    assert all(s == ((n - 1) * 2 + c + 1) * ogg.FRAME / ogg.RATE for c, n, s in d.times)
    assert max(s for _, _, s in d.times) == d.seconds
    streams = ogg.read(media)
    s = next(iter(streams.values()))
    assert ogg.packet_times(s, 0, 2, ogg.FRAME, ogg.RATE) == [(2 * i + 1) * ogg.FRAME / ogg.RATE for i in range(len(s.packets) - 1)]
    s.granules[-1] -= 576
    with pytest.raises(ogg.OggError):
        ogg.packet_times(s, 0, 2, ogg.FRAME, ogg.RATE)
    with pytest.raises(ogg.OggError):  # a page that goes back in time
        ogg.read(b"".join(p for _, p in ogg.write_stream([b"a", b"x" * 66_000, b"y" * 66_000], [0, 20, 10], 1)))


def test_ogg_query(spark):
    """The whole query against texts, bytes and samples counted by hand."""
    from binomia.llm.q_ogg import op10_ogg

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op10_ogg(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, data = rows[d.doc_id], (d.text or "").encode()
        x = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = ogg.encode(data)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
        pages = media.count(b"OggS\0")
        feature = f"ms={round(len(x) / 8)};streams=2;pages={pages};sum={sum(x)};energy={sum(b * b for b in x)};peak={max(x)};crossings={crossings}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(data), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), feature)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
