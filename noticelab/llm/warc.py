"""WARC archives in Zstandard: a dictionary in front, one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is a frame of its own with check sum and content
size.  The reader takes the dictionary from that frame, finds each frame's end
from its block headers, and decodes one frame at a time; it then validates the
version line, the mandatory fields, Content-Length against the block, the
closing blank lines, and the digest of the payload.

Of pages with equal payloads (by SHA-1) the one with the smallest page_id is
a response and the others revisit it: their records carry the digest and the
length of the payload, but not the payload.

Rows are dealt by page_id and payload, rows without a page_id stay where they
are.  A payload that more than one row in HOT_SHARE has is joined by broadcast
(there are HOT_SHARE such payloads at most), so that no task gets all its rows.

Cases: null html is an empty payload; a null url is an empty address; blanks
and control characters in an address are written as percent codes; a row that
repeats a page_id and its payload is a revisit of its twin; a page_id with two
payloads is two records, each compared by its own payload; rows without a
page_id are always responses and revisited by none; every record has an id of
its own; an empty table gives no archive and no row; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
HOT_SHARE = 4096  #: payloads of more than one row in so many are joined apart
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  #: pages carry no date of their own


class Damaged(ValueError):
    """An archive or record that is not well formed."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _address(url) -> str:
    """A url as one word."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) else ""


def _response_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload.  A response's
    id follows from its page and payload, so that revisits can name it."""
    number, sum_ = "" if page_id is None else str(page_id), digest(payload)
    response = refers_to is None
    own = _response_id(page_id, sum_) if response and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if response else b"")
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _address(url)),
        ("WARC-Payload-Digest", f"sha1:{sum_}"),
    ]
    if not response:
        fields += [("WARC-Refers-To", _response_id(refers_to, sum_)), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    fields += [
        ("X-Page-ID", number),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged("no version line or no end of the header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged(f"not a header field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Damaged(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("Content-Length differs from the block")
    return fields, rest[:-4]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own beginning where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


class Writer:
    """Builds one archive in memory; its first records make the dictionary."""

    def __init__(self, samples: list[bytes]):
        held = dictionary(samples)
        self.parts = [struct.pack("<II", SKIPPABLE, len(held)), held]
        self.size = 8 + len(held)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(held), write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> None:
        self.parts.append(self.packer.compress(data))
        self.size += len(self.parts[-1])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at this place ends, from its headers alone."""
    if struct.unpack_from("<I", data, at)[0] != FRAME:
        raise Damaged("no frame where one should begin")
    flags = data[at + 4]
    single, sum_, dict_size = flags >> 5 & 1, flags >> 2 & 1, (0, 1, 2, 4)[flags & 3]
    at += 5 + (not single) + dict_size + (1 if single and not flags >> 6 else (0, 2, 4, 8)[flags >> 6])
    last = False
    while not last:
        if at + 3 > len(data):
            raise Damaged("a frame is cut off")
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last = bool(block & 1)
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    at += 4 * sum_
    if at > len(data):
        raise Damaged("a frame is cut off")
    return at


def records(archive: bytes):
    """Fields and block of every record of an archive, frame by frame."""
    data = memoryview(archive)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise Damaged("no dictionary frame in front")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(data[8:at])))
    while at < len(data):
        end = frame_end(data, at)
        yield parse(opener.decompress(bytes(data[at:end])))
        at = end


def page(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), checked."""
    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 "):
        raise Damaged("no HTTP header in the block")
    if kind == "revisit" and (payload or fields["warc-refers-to"] != _response_id(int(fields["x-refers-to-page"]), named)):
        raise Damaged("a revisit that does not name a response of its payload")
    if kind == "response" and (digest(payload) != named or len(payload) != int(fields["x-payload-length"])):
        raise Damaged("the payload differs from its digest or length")
    number = lambda x: int(x) if x else None
    return number(fields["x-page-id"]), int(fields["x-payload-length"]), named, kind, number(fields.get("x-refers-to-page", ""))


def write(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Write archives of pages (page_id, url, html).  Payloads of fewer than
    `minimum` bytes are responses always.  Returns a row per archive."""
    spark = pages.sparkSession
    folder = _shared.new_path(spark, "warc")
    sha1 = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("sum", sha1)
    named = keyed.where("page_id is not null")
    sums = named.where(F.octet_length(F.coalesce("html", F.lit(""))) >= minimum).select("page_id", "sum")
    sums = _shared.written(sums, "sums")
    firsts = sums.groupBy("sum").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    firsts = _shared.written(firsts, "firsts")
    often = F.col("n") * HOT_SHARE > sums.count()
    hot, others = F.broadcast(firsts.where(often).drop("n")), firsts.where(~often).drop("n")
    revisits = sums.join(hot, "sum").unionByName(sums.join(hot.select("sum"), "sum", "left_anti").join(others, "sum"))
    revisits = revisits.select("page_id", "sum", "refers_to").distinct()
    rows = (
        named.repartition("page_id", "sum")
        .join(revisits.hint("merge"), ["page_id", "sum"], "left")
        .sortWithinPartitions("page_id", "sum")
    )
    rows = rows.unionByName(keyed.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))

    def archives(frames):
        held, writer, n, last = [], None, 0, None

        def begun():
            nonlocal writer, held
            writer = Writer(held)
            for x in held:
                writer.add(x)
            held = []

        def put():
            nonlocal writer, n
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            _shared.put_file(name, b"".join(writer.parts))
            out = pd.DataFrame({"path": [name], "n_records": [n], "n_bytes": [writer.size]})
            writer, n = None, 0
            return out

        waiting = 0
        for pdf in frames:
            for number, url, html, sum_, first in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["sum"], pdf["refers_to"]):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                number = None if number is pd.NA else int(number)
                twin, last = (number, sum_) == last and number is not None and len(payload) >= minimum, (number, sum_)
                refers = None if first is pd.NA or (first == number and not twin) else int(first)
                data = record(number, url, payload, refers)
                n += 1
                if writer is None:
                    held.append(data)
                    waiting += len(data)
                    if waiting >= 64 * DICTIONARY_BYTES:
                        begun()
                        waiting = 0
                else:
                    writer.add(data)
                if writer is not None and writer.size >= ARCHIVE_BYTES:
                    yield put()
        if held:
            begun()
        if writer is not None:
            yield put()

    rows = rows.select("page_id", "url", "html", "sum", "refers_to")
    return _shared.written(_shared.map_frames(rows, archives, "path string, n_records long, n_bytes long"), "warc-list")


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (path)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows(frames):
        for pdf in frames:
            for path in pdf["path"]:
                got = [page(*x) for x in records(_shared.get_file(path))]
                yield pd.DataFrame(got, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _shared.map_frames(
        archives.select("path"),
        rows,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(_shared.table(spark, sf_dir, "pages")))
