"""WARC archives compressed with Zstandard: one frame per record, a dictionary in the leading skippable frame.

Writing and reading go straight between executors and the shared folder, one file per
``FILE_BYTES`` of payload. A file's name holds the attempt that wrote it, and only the files
that the written table of archives names are read, so a task that is run again, or
twice at the same time, does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.skew import hot_keys, join_on
from loomgraph.storage import stash, work_dir

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame. Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
FILE_BYTES, DICTIONARY_BYTES, SAMPLES = 32 << 20, 16 << 10, 200
#: Bytes of a record, at most, when it is read; a frame that inflates beyond is damage.
MOST_RECORD = 1 << 31
#: Schemes of Hadoop's file systems by the names pyarrow has for them. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: Tasks that read archives, at most.
READERS = 10_000
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut short, or whose headers, lengths or digests are wrong."""


def _sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _hex(digest: str) -> str:
    try:
        return base64.b32decode(digest.removeprefix("sha1:")).hex()
    except ValueError as e:
        raise WarcError(f"a digest that is none: {digest[:60]}") from e


def _clean(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, number: str = "0") -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the head alone.

    ``number`` makes the record's id its own where pages have no id or share one. A revisit
    names its page in an extension field; its payload digest is what makes it one.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{number}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _length(text: str | bytes) -> int:
    text = text.decode("ascii", "replace") if isinstance(text, bytes) else text
    if not text.strip().isascii() or not text.strip().isdigit():
        raise WarcError(f"a length that is no number: {text[:40]!r}")
    return int(text)


def parse(raw: bytes) -> dict:
    """The record's headers (lower-case names), block, HTTP payload and payload length; WarcError if anything does not fit."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8", "strict").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("a head that is not UTF-8") from e
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header without colon: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    length = _length(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"a block of {len(rest) - 4} bytes; its header says {length}")
    block = rest[:length]
    if fields.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise WarcError("block digest")
    out = {"fields": fields, "block": block, "payload": block, "payload_length": length}
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP head")
        sizes = [_length(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        out |= {"payload": payload, "payload_length": sizes[0] if sizes else len(payload)}
    if fields["warc-type"] == "response":
        if out["payload_length"] != len(out["payload"]):
            raise WarcError("payload length")
        if fields.get("warc-payload-digest", _sha1(out["payload"])) != _sha1(out["payload"]):
            raise WarcError("payload digest")
    return out


def archive(records: list[bytes]) -> bytes:
    """The records as frames behind a dictionary trained on the first of them; without one where they are too few to train on."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:4096] for r in records[:SAMPLES]])
    except zstandard.ZstdError:
        trained = None
    level = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    frames = [level.compress(r) for r in records]
    if trained:
        held = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        frames.insert(0, struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
    return b"".join(frames)


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one per frame, read in pieces of ``chunk`` bytes. stream has read(n).

    The dictionary frame may hold the dictionary plain or compressed. Other skippable
    frames are passed over. WarcError for what is no frame or ends early.
    """
    held, at_start, dictionary, ended = b"", True, None, False

    def more() -> bool:
        nonlocal held, ended
        got = stream.read(chunk)
        held, ended = held + got, not got
        return bool(got)

    while True:
        while len(held) < 8 and not ended:
            more()
        if not held:
            return
        if len(held) >= 8 and held[1:4] == b"\x2a\x4d\x18" and 0x50 <= held[0] <= 0x5F:
            size = 8 + struct.unpack_from("<I", held, 4)[0]
            while len(held) < size:
                if not more():
                    raise WarcError("a skippable frame is cut short")
            if at_start and struct.unpack_from("<I", held)[0] == DICTIONARY_FRAME:
                body = held[8:size]
                try:
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 28) if body[:4] == ZSTD_FRAME else body
                    dictionary = zstandard.ZstdCompressionDict(body)
                except zstandard.ZstdError as e:
                    raise WarcError(f"the dictionary is damaged: {e}") from e
            held, at_start = held[size:], False
            continue
        at_start = False
        if held[:4] != ZSTD_FRAME:
            raise WarcError("no Zstandard frame")
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, size = [], 0
        try:
            while not one.eof:
                parts.append(one.decompress(held))
                size += len(parts[-1])
                if size > MOST_RECORD:
                    raise WarcError(f"a record of more than {MOST_RECORD} bytes")
                held = one.unused_data if one.eof else b""
                if not one.eof and not more():
                    raise WarcError("a frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame is damaged: {e}") from e
        yield b"".join(parts)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and place of a URI in Hadoop's spelling; credentials come from the environment of the workers."""
    scheme, colon, rest = path.partition(":")
    try:
        return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives cannot be kept in {path}: no file system for {scheme}") from e


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) as archives below ``folder``; a written table (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, held, size, turn, made, count = _open(folder), [], 0, 0, [], 0
        files[0].create_dir(files[1], recursive=True)

        def close() -> None:
            nonlocal held, size, turn
            name = f"part-{context.partitionId():06d}-{turn:04d}-{context.taskAttemptId()}.warc.zst"
            with files[0].open_output_stream(f"{files[1]}/{name}", compression=None) as out:
                out.write(archive(held))
            made.append((f"{folder}/{name}", len(held)))
            held, size, turn = [], 0, turn + 1

        for batch in batches:
            ids, urls, refers, html = (batch.column(c) for c in ("page_id", "url", "refers_to", "html"))
            for k in range(len(batch)):
                payload = (html[k].as_py() or "").encode()
                one = record(ids[k].as_py(), urls[k].as_py(), payload, refers[k].as_py(), f"{context.partitionId():x}-{count:x}")
                count += 1
                held.append(one)
                size += len(one)
                if size >= FILE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return stash(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def _page(record_id: str) -> int | None:
    """The page's id in a record id of ours; null where the page has none."""
    name, _, number = record_id.removeprefix("<urn:page:").removesuffix(">").partition(":")
    if not number or (name and not name.lstrip("-").isdigit()):
        raise WarcError(f"a record id of another kind: {record_id[:80]}")
    return int(name) if name else None


def read_archives(paths: DataFrame) -> DataFrame:
    """Every record of the archives in column ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = _open(path)
                out: list[list] = [[] for _ in kinds]
                size = 0
                with files.open_input_stream(place, compression=None) as stream:
                    for raw in frames(stream):
                        found = parse(raw)
                        fields, revisit = found["fields"], found["fields"]["warc-type"] == "revisit"
                        if revisit and not fields.get("warc-refers-to-page", "").lstrip("-").isdigit():
                            raise WarcError("a revisit that refers to nothing")
                        digest = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else hashlib.sha1(found["payload"]).hexdigest()
                        row = (_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], int(fields["warc-refers-to-page"]) if revisit else None, found["payload_length"], digest, None if revisit else found["payload"])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                            out, size = [[] for _ in kinds], 0
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    # a task per archive: their names are a few bytes, which AQE would merge into one task if it were let
    return paths.select("path").repartition(max(1, min(READERS, paths.count()))).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload is that of a page with a larger id; other pages have no row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digests = stash(pages.where(F.col("page_id").isNotNull()).select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least), "digests")
    last = stash(digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("first < refers_to").drop("first"), "last")
    again = join_on(digests, last, "digest", hot_keys(digests, "digest"))
    return again.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html), then read the archives back: the columns of read_archives.

    The payload is the html in UTF-8, null counts as empty. Of the pages with equal payloads of at
    least ``least`` bytes the one with the largest page_id is stored, the others refer to it. Null
    ids are responses of their own. Rows that repeat a page_id with the same html are all
    responses, or all revisits of the same page. Null urls have no target URI; other columns
    are ignored; an empty table gives no archive and an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = stash(plan_revisits(rows, least), "revisits").withColumnRenamed("page_id", "__page")
    same = (F.col("page_id") == F.col("__page")) & (F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == F.col("digest"))
    told = rows.where("page_id is not null").join(again, same, "left").select("page_id", "url", "html", "refers_to")
    # pages without an id refer to nothing and need not meet in one task
    told = told.unionByName(rows.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))
    return read_archives(write_archives(told, work_dir(pages.sparkSession, "warc")))
