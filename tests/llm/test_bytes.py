import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from loomgraph.llm import fingerprints as fp
from loomgraph.llm import media, warc
from loomgraph.llm.queries import queries

SF = "/root/testdata/sf0.01"


def edited(a, b):
    k = len(a) // 4
    return a[: len(a) - k] + b[:k]


def slow_digests(raw):
    """Chunks found byte by byte: the gear hash of the last 32 bytes, and for the place where a chunk begins its sizes and masks."""
    gear, h, ends, begin, chunks = [int(x) for x in fp._gear], 0, [], 0, {}
    hashes = []
    for byte in raw:
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        hashes.append(h)

    def sizes(at):
        if len(raw) >= fp.SHORT:
            return 64, 256, 1024
        return next((least, average, most) for until, least, average, most in fp.FINE if at < until)

    while begin < len(raw):
        least, average, most = sizes(begin)
        bits = average.bit_length() - 1
        end = begin
        while end < len(raw):
            end += 1
            size = end - begin
            if size >= most:
                break
            mask = bits + 2 if size <= average else bits - 2
            if size >= least and hashes[end - 1] >> (32 - mask) == 0:
                break
        ends.append(end)
        chunks[fp.xxhash.xxh3_64_intdigest(raw[begin:end])] = end - begin
        begin = end
    return chunks


def test_chunks_against_a_loop_over_bytes(spark):
    draw = random.Random(6)
    texts = [r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()[:250]]
    texts += [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 5000, fp.SHORT - 1, fp.SHORT, fp.SHORT + 1)] + [b"a" * 5000, b"ab" * 40_000]
    for raw in texts:
        assert fp.chunk_digests(raw) == slow_digests(raw)


def test_fingerprints_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fp.fingerprint_neighbours(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    for k, r in enumerate(docs):
        after = docs[(k + 1) % len(docs)].text
        text = edited(r.text, after)
        own, other, next_ = (fp.chunk_digests(t.encode()) for t in (r.text, text, after))
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(r.text), hashlib.sha256(text.encode()).hexdigest(), fp.fingerprint(own), fp.fingerprint(other))
        assert (g.near_edited, g.near_next) == (fp.containment(own, other), fp.containment(own, next_))
    long = [g.near_edited for g in got.values() if g.n_chars > 4000]
    assert 0.6 < sum(long) / len(long) < 0.85


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_neighbours_across_ranges(spark, rows):
    table = [(k * 7 % 31, f"text {k * 7 % 31} " * 20) for k in range(31)] + [(None, "none"), (5, "again"), (5, "again")]
    df = fp.in_order(spark.createDataFrame(table, "doc_id long, text string"), rows)
    want = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen = {}
    for part in df.rdd.glom().collect():
        for a, b in zip(part, part[1:], strict=False):
            if a.own and a["range"] == b["range"]:
                seen.setdefault((a.doc_id, a.text), []).append((b.doc_id, b.text))
    flat = sorted((k, v) for k, vs in seen.items() for v in vs for k in [str(k)])
    assert flat == sorted((str(want[k]), want[(k + 1) % len(want)]) for k in range(len(want)))


def test_rows_without_ids_and_long_texts_spread_over_ranges(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, id % 2) as doc_id", "concat('t', id % 50) as text")
    placed = fp.in_order(rows, 100)
    assert placed.groupBy("range").count().agg({"count": "max"}).first()[0] <= 101 and placed.where("own").count() == 6000
    long = " ".join(f"word{k * 7919 % 10007}" for k in range(40_000))
    got = {r.doc_id: r for r in fp.fingerprint_neighbours(spark.createDataFrame([(1, long), (2, long + "x"), (3, "é" * 100_000)], "doc_id long, text string")).collect()}
    assert got[1].n_chars == len(long) and got[1].near_next > 0.9 and got[3].n_chars == 100_000
    assert got[1].edited_sha256 == hashlib.sha256(edited(long, long + "x").encode()).hexdigest()


def test_fingerprint_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 7)], "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as own")
    got = {r.doc_id: r for r in fp.fingerprint_neighbours(df).collect()}
    assert (got[1].n_chars, got[1].fingerprint, got[1].near_edited, got[1].near_next) == (0, "", 1.0, 1.0)
    assert (got[2].near_next, got[3].near_next) == (0.0, 0.0)
    assert got[3].edited_sha256 == hashlib.sha256(("é" * 6).encode()).hexdigest()
    assert fp.fingerprint_neighbours(df.limit(0)).count() == 0
    assert fp.fingerprint_neighbours(df.where("doc_id = 3")).first().near_next == 1.0


def test_chunks_resist_shifts_and_segment_borders():
    draw = random.Random(3)
    raw = bytes(draw.randrange(256) for _ in range(60_000))
    ends = fp.cuts(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes[:-1].min() >= fp.LEAST and sizes.max() <= fp.MOST and 150 < sizes.mean() < 450
    shifted = raw[:30_000] + b"inserted" + raw[30_000:]
    assert fp.containment(fp.chunk_digests(raw), fp.chunk_digests(shifted)) > 0.95
    whole = fp._marks(np.frombuffer(raw, np.uint8))
    fp.SEGMENT, before = 1000, fp.SEGMENT
    try:
        assert fp._marks(np.frombuffer(raw, np.uint8)) == whole
    finally:
        fp.SEGMENT = before


def slow_adpcm(block):
    value, index, _ = struct.unpack("<hBB", block[:4])
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
            value = max(-32768, min(32767, value - delta if n & 8 else value + delta))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            out.append(value)
    return out


def slow_resampled(pcm, rate, to):
    out = []
    for k in range(max(1, len(pcm) * to // rate)):
        at, part = divmod(k * rate, to)
        a, b = int(pcm[at]), int(pcm[min(at + 1, len(pcm) - 1)])
        out.append(a + (b - a) * part // to)
    return out


def test_expanding_and_resampling_against_plain_loops(spark):
    def mulaw(code):
        code = ~code & 0xFF
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return -size if code & 128 else size

    def alaw(code):
        code ^= 0x55
        e, m = code >> 4 & 7, (code & 15) << 4
        size = m + 8 if e == 0 else m + 0x108 << e - 1
        return size if code & 128 else -size

    assert media.MULAW_PCM.tolist() == [mulaw(k) for k in range(256)] and media.ALAW_PCM.tolist() == [alaw(k) for k in range(256)]
    for r in media.text_audio(spark.read.parquet(f"{SF}/documents.parquet").limit(25)).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        raw = r.text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want = slow_resampled([mulaw(b) for b in payload], 8000, 16000)
        assert bytes(r.pcm) == struct.pack(f"<{len(want)}h", *want)


def test_tables_and_adpcm():
    # corner values of G.711
    assert media.MULAW_PCM[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    raw = np.random.default_rng(2).integers(0, 256, 64 * 9).astype(np.uint8).tobytes()
    assert media.adpcm_decode(raw + b"rest").tolist() == [v for k in range(9) for v in slow_adpcm(raw[64 * k : 64 * k + 64])]
    for kind in (media.PCM, media.ALAW, media.MULAW, media.IMA_ADPCM):
        assert media.read_wav(media.wav(raw, kind)) == (kind, media.RATE, raw)
    with pytest.raises(ValueError):
        media.read_wav(media.wav(raw)[:-1])
    pcm = np.array([0, 100, -100, 7], np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -47, 7, 7]
    assert media.resample(pcm, 8000, 4000).tolist() == [0, -100]


def test_media_rows(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 300_000, "a"]
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)] + [(None, "z", "m")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.text_audio(df).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        kept = media.wav(payload)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(kept), hashlib.sha256(kept).hexdigest())
        pcm = media.MULAW_PCM[np.frombuffer(payload, np.uint8)]
        assert r.feature == f"{media.describe(pcm)};alaw={media.describe(media.expand(media.ALAW, payload))};adpcm={media.describe(media.adpcm_decode(payload))};pcm16000={zlib.crc32(media.resample(pcm, 8000, 16000).tobytes()):08x}"
    assert got[2].feature == got[7].feature and None in got
    assert media.text_audio(df.limit(0)).count() == 0
    pcm = media.decode_media(media.store_media(df.where("doc_id = 2"))).first().pcm
    assert len(pcm) == 256


def test_archives_round_trip(spark):
    big = "<p>" + "payload " * 300
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", big), (4, "http://c/", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "é", "ü" * 600), (9, "e", "ü" * 600), (None, "n", big), (2, None, big), (10, "v", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as refers_to", "'t' as record_type", "'d' as digest")
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for k, raw in html.items():
        last = {1: 3, 2: 3, 8: 9}.get(k)
        assert (by[k].payload_bytes, by[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (by[k].record_type, by[k].refers_to) == (("revisit", last) if last else ("response", None))
        assert by[k].payload == (None if last else raw)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_reader_rejects_damage():
    records = [warc.record(k, f"http://h/{k}", b"payload %d " % k * 50) for k in range(100)]
    whole = warc.archive(records)
    assert struct.unpack_from("<I", whole)[0] == warc.DICTIONARY_FRAME
    assert list(warc.frames(io.BytesIO(whole), 77)) == records
    assert list(warc.frames(io.BytesIO(warc.archive(records[:1])))) == records[:1]
    plain = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert list(warc.frames(io.BytesIO(whole + plain))) == records
    for bad in (whole[:-3], whole[:5], whole + b"rubbish!", whole[:9000] + b"\x00\x01" + whole[9002:]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))
    good = records[3]
    for bad in (good[:-2], good.replace(b"payload 3 ", b"payload 4 ", 1), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "b"), (1, "u", "b"), (2, None, "c" * 5000), (3, "v", "c" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "cast(null as long) as refers_to")
    files = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    ids = []
    for f in files:
        with open(f.path.removeprefix("file://"), "rb") as stream:
            ids += [warc.parse(raw)["fields"]["warc-record-id"] for raw in warc.frames(stream)]
    assert len(ids) == len(set(ids)) == len(rows)


def test_damaged_heads_and_lengths_are_warc_errors(monkeypatch):
    good = warc.record(3, "http://h/", b"payload")
    for bad in (good.replace(b"Content-Length: 7", b"Content-Length: x"), good.replace(b"Content-Length: ", b"Content-Length: -"), good.replace(b"WARC-Date", b"WARC-\xff\xfe"), good.replace(b"Content-Length: 8", b"Content-Length: \xc2\xb2")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    for bad in ("<urn:page:3>", "<urn:uuid:1>", "<urn:page:x:1>"):
        with pytest.raises(warc.WarcError):
            warc._page(bad)
    assert warc._page("<urn:page::1>") is None and warc._page("<urn:page:-5:1-2>") == -5
    whole = warc.archive([warc.record(k, None, b"z" * 5000) for k in range(3)])
    monkeypatch.setattr(warc, "MOST_RECORD", 1000)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(whole)))
    with pytest.raises(ValueError):
        warc._open("unheard-of://bucket/folder")


def test_registered_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 11)]
