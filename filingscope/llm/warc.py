"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are written by Spark's text sink, so they commit as any other output and survive lost tasks on any file
system.  A row is an archive, a file has one row; its line separator is an empty skippable frame, which every reader of
the format steps over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm.store import narrow, save

#: Fixed values of the formats: frame magics (little-endian), the empty skippable frame, the revisit profile.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and record bytes of an archive, whichever comes first; a longer record is alone.
RECORDS, ARCHIVE_BYTES = 2000, 32 << 20
#: Bytes of a dictionary, records it is trained on, payload bytes from which copies are revisits.
DICTIONARY_BYTES, SAMPLES, REVISIT_BYTES = 16 << 10, 300, 100
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of another one, which carries no payload."""
    http = _HTTP % len(payload)
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> list[bytes]:
    """The dictionary's frame, which is empty if there is too little to train one on, and a frame for each record."""
    trained = None
    if len(records) >= 16:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records[:SAMPLES]])
        except zstandard.ZstdError:  # samples too small or too alike
            trained = None
    data = trained.as_bytes() if trained else b""
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    return [struct.pack("<II", DICTIONARY, len(data)) + data, *map(squeeze.compress, records)]


def _archives(records: int, size: int):
    def made(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(archive(held))], pa.binary())], ["archive"])

    def run(batches):
        held, taken = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # one row at a time, as payloads may be long
                own = record(*(batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to")))
                if held and (len(held) == records or taken + len(own) > size):
                    yield made(held)
                    held, taken = [], 0
                held.append(own)
                taken += len(own)
        if held:
            yield made(held)

    return run


def write_archives(pages: DataFrame, path: str, records: int = RECORDS, size: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives below ``path``.

    An archive has at most ``records`` records and, but for a single longer one, ``size`` bytes of them.  Of records with
    equal payloads of at least 100 bytes those beside the smallest page_id revisit it.  A null html is an empty payload; a
    null page_id is never the smallest; rows that repeat the smallest page_id are all responses; other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = rows.filter(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = save(copies.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(narrow(copies), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    made = rows.mapInArrow(_archives(records, size), "archive binary")
    # A row's bytes pass through the cast as they are.
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


class Broken(ValueError):
    """An archive or a record that doesn't hold what its headers say."""


def frames(data: bytes) -> Iterator[bytes]:
    """Records of an archive, one frame decoded at a time."""
    at, view, loaded = 0, memoryview(data), None
    while at < len(data):
        if len(data) - at < 8:
            raise Broken("cut off in a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                raise Broken("cut off in a skippable frame")
            if magic == DICTIONARY and at == 0 and size:
                own = bytes(view[8:8 + size])
                if struct.unpack_from("<I", own)[0] == FRAME:  # a dictionary may itself be compressed
                    own = zstandard.ZstdDecompressor().decompress(own, max_output_size=1 << 27)
                loaded = zstandard.ZstdCompressionDict(own)
            at += 8 + size
            continue
        if magic != FRAME:
            raise Broken(f"no frame at byte {at}")
        decoder, out, fed = zstandard.ZstdDecompressor(dict_data=loaded).decompressobj(), [], at
        try:
            while not decoder.eof and fed < len(data):
                step = view[fed:fed + 65536]
                out.append(decoder.decompress(step))
                fed += len(step)
        except zstandard.ZstdError as e:
            raise Broken(f"bad frame at byte {at}: {e}") from None
        if not decoder.eof:
            raise Broken("cut off in a frame")
        at = fed - len(decoder.unused_data)
        yield b"".join(out)


def _number(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse(data: bytes) -> dict:
    """Fields of a record; raises Broken unless version, headers, lengths and digest fit together."""
    head, mark, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise Broken("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Broken(f"bad header line {line[:50]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise Broken(f"without {sorted(missing)}")
    if not fields["content-length"].isdigit() or block[int(fields["content-length"]):] != b"\r\n\r\n":
        raise Broken("block and Content-Length differ")
    kind = fields["warc-type"]
    digest, length = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-payload-length")
    payload = None
    if kind == "response":
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if told and told != [b"%d" % len(payload)]:
            raise Broken("payload and its HTTP length differ")
        if hashlib.sha256(payload).hexdigest() != digest or length != str(len(payload)):
            raise Broken("payload and its digest or length differ")
    elif kind == "revisit" and (not digest or not (length or "").isdigit() or "warc-refers-to" not in fields):
        raise Broken("a revisit without what it refers to")
    return {
        "page_id": _number(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": int(length or 0),
        "payload_digest": digest, "refers_to": _number(fields.get("warc-refers-to")), "payload": payload, "error": None}


_SCHEMA = "archive string, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
_ARROW = pa.schema([
    ("archive", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _read(with_payload: bool):
    def rows(path: str, data: bytes) -> Iterator[dict]:
        try:
            for own in frames(data):
                try:
                    found = parse(own)
                except (Broken, UnicodeDecodeError) as e:
                    found = {"error": str(e)}
                if not with_payload:
                    found["payload"] = None
                yield found | {"archive": path}
        except Broken as e:
            yield {"archive": path, "error": str(e)}

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                held: list[dict] = []
                for row in rows(path.as_py(), data.as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``.

    A record that fails validation is a row with its ``error`` alone; so is the rest of an archive after a frame that
    can't be decoded.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(with_payload), _SCHEMA)
