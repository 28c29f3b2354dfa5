"""WARC archives with Zstandard dictionaries (operator 6).

Writing: every task packs its records into archives of about ``ARCHIVE_BYTES``.
An archive starts with a skippable frame that holds its dictionary (trained on
its first records, or their plain bytes where they are too few to train on);
then each record is one frame. Archives get a name of their own and are written
whole; the names in the task's result are the archive list, so files of a failed
or repeated attempt are never read.

Reading: the dictionary is loaded from the leading frame; frame ends are found by
their block headers, each frame is decoded alone, and version line, header lines,
lengths, record end and payload digest are validated (``ValueError`` names the
archive and offset).

Of records with equal payloads of ``REVISIT_BYTES`` or more the smallest page_id
is the response and the others revisit it; only digests and ids meet for that.

Defined cases: null html is an empty payload, null url has no target line. Rows
repeating the smallest page_id with its payload are responses too. Rows without
page_id are responses of their own and nobody's target. An empty table writes no
archive and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import stash, table
from mirage.session import checkpoint_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d+|null)>")


# --- records ------------------------------------------------------------------------

def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = _HTTP % len(payload) + payload if kind == "response" else b""
    name = "null" if page_id is None else page_id
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """Headers and payload of one record; ValueError where it is not well formed."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("record header does not end")
    version, *lines = data[:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC version line: {version[:40]!r}")
    head = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z-]+", key) or key.lower() in head:
            raise ValueError(f"bad header line {line[:80]!r}")
        head[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if key not in head:
            raise ValueError(f"no {key} header")
    body = data[end + 4:-4]
    if not head["content-length"].isdigit() or int(head["content-length"]) != len(body) or data[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {head['content-length']} but {len(body)} bytes of block")
    name = _ID.fullmatch(head["warc-record-id"])
    if not name or head["warc-type"] not in ("response", "revisit"):
        raise ValueError("unknown record id or type")
    out = {"page_id": None if name[1] == "null" else int(name[1]), "record_type": head["warc-type"],
           "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        to = _ID.fullmatch(head.get("warc-refers-to", ""))
        if not to or body:
            raise ValueError("a revisit needs a target and no block")
        out["refers_to"] = int(to[1])
        return out
    cut = body.find(b"\r\n\r\n")
    length = re.search(rb"^Content-Length: (\d+)\r?$", body[:max(cut, 0) + 2], re.M)
    payload = body[cut + 4:]
    if cut < 0 or not body.startswith(b"HTTP/1.1 ") or not length or int(length[1]) != len(payload):
        raise ValueError("bad HTTP header in the block")
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError("payload does not have its digest")
    out["payload"] = payload
    return out


# --- archives -----------------------------------------------------------------------

def encode_archive(records: list[bytes]) -> bytes:
    import zstandard as z
    sample, size = [], 0
    for r in records:
        if size > SAMPLE_BYTES:
            break
        sample.append(r[:64 << 10])
        size += len(sample[-1])
    try:
        dictionary = z.train_dictionary(DICTIONARY_BYTES, sample)
    except z.ZstdError:  # too few or too small records to train on
        dictionary = z.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)
    data = dictionary.as_bytes()
    c = z.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(data)) + data + b"".join(c.compress(r) for r in records)


def frame_end(data, at: int) -> int:
    """End of the frame at ``at``: its blocks are walked, not decoded."""
    import zstandard as z
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    checksum = z.get_frame_parameters(bytes(data[at:at + 18])).has_checksum
    at += z.frame_header_size(bytes(data[at:at + 18]))
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        head = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("archive ends inside a frame")
    return at


def decode_archive(data: bytes) -> Iterator[dict]:
    import zstandard as z
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise ValueError("archive does not start with a dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("archive ends inside its dictionary")
    d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(data[8:8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        try:
            end = frame_end(view, at)
            yield decode_record(d.decompress(view[at:end]))
        except (ValueError, z.ZstdError) as e:
            raise ValueError(f"byte {at}: {e}") from e
        at = end


# --- Spark --------------------------------------------------------------------------

def _payloads(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn(
                            "digest", F.sha2("payload", 256))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another."""
    some = _payloads(pages).filter((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = some.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).filter("refers_to < _last")
    return some.join(first.drop("_last"), "digest").filter("page_id <> refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of ``pages`` under ``folder``; the list (path, records)."""
    to = revisits(pages).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    p = _payloads(pages)
    rows = p.join(to, (p.page_id == F.col("_p")) & (p.digest == F.col("_d")), "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "refers_to")

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        def put(records):
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(encode_archive(records))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], names=["path", "records"])

        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in b.columns)
                held.append(encode_record(page_id, url, payload or b"", digest, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return stash(rows.mapInArrow(run, "path string, records long"))


def read_archives(spark: SparkSession, folder: str, listed: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """Records (page_id, record_type, payload_digest, payload_bytes, refers_to
    [, payload]) of the ``*.warc.zst`` archives under ``folder``; with ``listed``
    (a column path) only of those named there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if listed is not None:
        # One short row per archive: a semi join on the file name, before any
        # content is decoded.
        name = F.element_at(F.split("path", "/"), -1)
        files = files.withColumn("_name", name).join(listed.select(name.alias("_name")).hint("broadcast") if listed.count() <= 10_000
                                                     else listed.select(name.alias("_name")), "_name", "left_semi").select("path", "content")

    def run(batches) -> Iterator:
        import pyarrow as pa
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payload
        names = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * payload
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                try:
                    for r in decode_archive(content.as_py()):
                        rows.append([r["page_id"], r["record_type"], r["payload_digest"],
                                     None if r["payload"] is None else len(r["payload"]), r["refers_to"]] + [r["payload"]] * payload)
                except ValueError as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ddl = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long" + (", payload binary" if payload else "")
    return files.mapInArrow(run, ddl)


def page_records(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives and returns what reading them back gives;
    a revisit has the size of the payload it refers to."""
    spark = pages.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    written = write_archives(pages, folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # The folder may also hold archives of repeated attempts: only listed ones count.
    got = stash(read_archives(spark, folder, written))
    size = got.filter("record_type = 'response'").select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).distinct()
    again = got.filter("record_type = 'revisit'").join(size, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_d")), "left")
    again = again.withColumn("payload_bytes", F.coalesce("_n", F.raise_error(F.lit("a revisit refers to no response")).cast("long")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return got.filter("record_type = 'response'").select(*out).unionByName(again.select(*out))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(table(spark, sf_dir, "pages"))


SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= {REVISIT_BYTES} AND page_id IS NOT NULL GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d"""
