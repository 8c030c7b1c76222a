"""WARC, TIFF and exact digests."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest

from causeway.llm import digest, tiff, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "<p>a</p>", "<p>a</p>", "CR\r\n\r\nLF", "é", "<p>a</p>"])]
    rows += [(6, "http://x/6", "<p>a</p>"), (None, "bad\r\nurl", "lone"), (40, None, "<p>b</p>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_revisits(spark, pages):
    rows = warc.archive_pages(pages).collect()
    assert len(rows) == pages.count()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    digest_of = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert by[0][0]["record_type"] == "revisit" and by[0][0]["refers_to"] == 1 and by[0][0]["payload_bytes"] == 0
    assert by[2][0]["refers_to"] == by[3][0]["refers_to"] == 6
    assert sorted(r["record_type"] for r in by[6]) == ["response", "revisit"]
    assert by[4][0]["payload_digest"] == digest_of(b"CR\r\n\r\nLF") and by[5][0]["payload_bytes"] == 2
    assert by[None][0]["record_type"] == "response"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_are_plain_warc_and_are_deduplicated(spark, pages):
    from causeway.plans.durable import fresh_path

    marked = warc.mark_revisits(pages.selectExpr("page_id", "url", "cast(coalesce(html, '') as binary) payload"))
    path = warc.write_archives(marked, fresh_path(spark, "warc"), warc.F.octet_length("payload"), warc.record_bytes())
    raw = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(path).collect())
    assert raw.count(b"WARC/1.1\r\n") == pages.count() and b"WARC-Profile: " in raw
    again = warc.resolve(warc.read_archives(spark, warc.deduplicate_archives(spark, path))).collect()
    assert len(again) == pages.count()
    assert {(r["page_id"], r["refers_to"]) for r in again} == {(r["page_id"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    for bad in (b"no archive", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx", gzip.compress(raw)[:-20]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def record(kind, number, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{number}>", "WARC-Date": f"2020-01-0{number}T00:00:00Z", "WARC-Target-URI": f"http://a/{number}", **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block


def test_foreign_archives_lose_nothing_but_repeated_payloads(spark, tmp_path):
    http = {"Content-Type": "application/http;msgtype=response"}
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    gone = base64.b32encode(hashlib.sha1(b"elsewhere").digest()).decode()
    own = {
        1: record("warcinfo", 1, b"software: x\r\n", **{"Content-Type": "application/warc-fields"}),
        2: record("request", 2, b"GET / HTTP/1.1\r\n\r\n", **{"Content-Type": "application/http;msgtype=request"}),
        3: record("response", 3, b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\nbody", **http),
        4: record("response", 4, b"HTTP/1.1 200 OK\r\n\r\nbody", **http),
        5: record("revisit", 5, b"HTTP/1.1 304 Not Modified\r\n\r\n", **http, **{"WARC-Payload-Digest": f"sha1:{sha}"}),
        6: record("revisit", 6, b"", **{"WARC-Refers-To": "<urn:x:3>"}),
        7: record("revisit", 7, b"", **{"WARC-Payload-Digest": f"sha1:{gone}", "WARC-Refers-To": "<urn:x:nowhere>"}),
        8: record("resource", 8, b"\xff\xfe\r\n\r\nplain", **{"Content-Type": "text/plain"}),
        9: record("response", 9, b"HTTP/1.1 200 OK\r\n\r\nbody", **http),
    }
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in own.values()))
    out = spark.read.format("binaryFile").load(warc.deduplicate_archives(spark, f"file://{tmp_path}")).collect()
    records = [r for f in out for r in warc.parse_archive(bytes(f["content"]))]
    by = {r["record_id"]: r for r in records}
    assert len(records) == len(by) == 9
    assert all(by[f"<urn:x:{i}>"]["raw"] == own[i] for i in (1, 2, 7, 8, 9))
    made = [r for r in records if r["record_id"] not in {f"<urn:x:{i}>" for i in own}]
    assert sorted((r["record_type"], r["target_uri"], r["date"], r["refers_to_record"], r["payload_digest"], r["http_head"]) for r in made) == [
        ("revisit", "http://a/3", "2020-01-03T00:00:00Z", "<urn:x:9>", sha, b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n"),
        ("revisit", "http://a/4", "2020-01-04T00:00:00Z", "<urn:x:9>", sha, b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    assert {by[f"<urn:x:{i}>"]["refers_to_record"] for i in (5, 6)} == {"<urn:x:9>"} and by["<urn:x:6>"]["payload_digest"] == sha
    again = {r["record_id"]: r for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert again["<urn:x:5>"]["payload_bytes"] == again["<urn:x:6>"]["payload_bytes"] == 4 and again["<urn:x:7>"]["payload_bytes"] is None


KINDS = [(c, p, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.ADOBE_DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (False, True)]


def test_tiff_round_trips():
    rnd = np.random.default_rng(0)
    for kind in KINDS:
        for order in "<>":
            pages = [rnd.integers(0, 5, (h, 100), dtype=np.uint8) for h in (1, 64, 130)]
            image = tiff.encode_image(pages, [kind] * 3, order)
            assert all((tiff.decode_page(image, t)[:, :, 0] == p).all() for p, t in zip(pages, tiff.walk(image), strict=True))
    for n in [*range(0, 9000, 37), 70_000]:
        for top in (98, 101, 256):
            raw = bytes(rnd.integers(97, top, n, dtype=np.uint8))
            packed = tiff.lzw_encode(raw)
            assert tiff.lzw_decode(packed, n) == plain_lzw(packed) == raw
            assert tiff.unpack_bits(tiff.pack_bits(raw), n) == raw


def plain_lzw(data):
    """A textbook decoder, bit by bit."""
    bits = "".join(f"{b:08b}" for b in data)
    at, width, table, before, out = 0, 9, [], None, b""
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, width, before = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if before is not None:
            table.append(before + word[:1])
        out, before = out + word, word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def test_pack_bits_packs_rows_apart():
    page = np.full((8, 64), 7, np.uint8)
    image = tiff.encode_image([page], [(tiff.PACKBITS, 1, False)])
    (tags,) = tiff.walk(image)
    at, n = tags[tiff.STRIP_OFFSETS][0], tags[tiff.STRIP_SIZES][0]
    assert image[at : at + n] == bytes((257 - 64, 7)) * 8


def test_every_codec_and_layout_sees_its_share():
    """Of the pages of texts of any size, a third goes to each codec and half to tiles."""
    rnd = np.random.default_rng(6)
    for size in (64, 640, 6400, 65536):
        kinds = [tiff.kind_of(bytes(rnd.integers(97, 123, size, dtype=np.uint8))) for _ in range(1500)]
        for codec in (tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE):
            assert 0.28 < sum(k[0] == codec for k in kinds) / 1500 < 0.39
            assert 0.4 < sum(k[2] for k in kinds if k[0] == codec) / sum(k[0] == codec for k in kinds) < 0.6


def test_document_media(spark, docs, empty):
    rows = tiff.document_media(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r for r in rows if texts[r["doc_id"]] == "Hello, world."]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert tiff.document_media(empty).count() == 0


def changed(image, tag, value):
    """The image with the first value of a tag of its first directory replaced."""
    raw = bytearray(image)
    at = int.from_bytes(raw[4:8], "little")
    for k in range(int.from_bytes(raw[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(raw[entry : entry + 2], "little") == tag:
            raw[entry + 8 : entry + 12] = value.to_bytes(4, "little")
    return bytes(raw)


def test_bad_images_give_an_error_row(spark):
    page = np.zeros((1, 64), np.uint8)
    loop = bytearray(tiff.encode_image([page], [(tiff.NONE, 1, False)]))
    loop[-4:] = loop[4:8]
    bad = [None, b"", b"none", b"II*\0\0\0\0\0"]
    for kind in KINDS:
        good = tiff.encode_image([page], [kind])
        for tag in (tiff.WIDTH, tiff.HEIGHT):
            bad += [changed(good, tag, 0), changed(good, tag, (1 << 32) - 1), changed(good, tag, 1 << 20)]
        if kind[2]:
            bad += [changed(good, tag, v) for tag in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT) for v in (0, (1 << 32) - 1, 1 << 20)]
        bad.append(changed(good, tiff.TILE_OFFSETS if kind[2] else tiff.STRIP_OFFSETS, 1 << 31))
    # A strip that inflates to a gigabyte is read up to the size of the page, a page that claims a gigabyte not at all.
    bomb = zlib.compress(bytes(1 << 26), 9)
    grown = bytearray(tiff.encode_image([page], [(tiff.ADOBE_DEFLATE, 1, False)]))
    grown = changed(changed(bytes(grown) + bomb, tiff.STRIP_OFFSETS, len(grown)), tiff.STRIP_SIZES, len(bomb))
    media = spark.createDataFrame(list(enumerate([*bad, grown])), "id int, media binary")
    rows = {r["id"]: r for r in tiff.read_pages(media).collect()}
    assert all(rows[i]["error"] for i in range(len(bad)))
    assert rows[len(bad)]["pixels"] == bytes(64)
    big = changed(changed(grown, tiff.HEIGHT, 1 << 20), tiff.ROWS_PER_STRIP, 1 << 20)
    assert all(r["error"] for r in tiff.read_pages(spark.createDataFrame([(1, big)], "id int, media binary"), page_bytes=1 << 24).collect())
    # What comes before a broken page or link stays.
    rows = tiff.read_pages(spark.createDataFrame([(3, bytes(loop))], "id int, media binary")).collect()
    assert [bool(r["error"]) for r in rows] == [False, True]


def test_digest_against_brute_force(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    wanted = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = digest.edited_text(text, following)
        own = digest.fingerprint(text)
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, digest.fingerprint(edited), float(own == digest.fingerprint(edited)), float(own == digest.fingerprint(following))))
    got = [tuple(r)[:7] for r in digest.fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert digest.fingerprints(empty).count() == 0


def test_groups_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "B"), (None, "lone"), (None, "A "), (3, "b")], "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["n_chars"], r["group_size"]) for r in digest.fingerprints(rows).collect()), key=str)
    assert found == sorted([(1, 1, 2), (1, 1, 3), (2, 1, 3), (None, 4, 1), (None, 2, 2), (3, 1, 3)], key=str)


def test_folding_and_groups(spark):
    assert digest.fingerprint("ＦＵＬＬ  Straße\n") == digest.fingerprint("full STRASSE")
    assert digest.fingerprint(None) == digest.fingerprint(" \n")
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None), (4, " "), (5, "c")], "doc_id bigint, text string")
    found = {r["id"]: (r["group_id"], r["group_size"]) for r in digest.group_exact(rows).collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}
