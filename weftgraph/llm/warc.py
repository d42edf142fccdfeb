"""WARC 1.1 archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import few, materialise, scratch_path, python_ready

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: A writer starts a new file beyond this many compressed bytes; a reader holds one file at a time.
FILE_BYTES = 16 << 20
#: Bytes of payloads that a reader hands on at once, beyond one record.
READ_BYTES = 8 << 20

log = logging.getLogger(__name__)

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


#: Digest algorithms that are checked; values of others are passed on unchecked.
_ALGORITHMS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512, "md5": hashlib.md5}


def _digest(label: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest in hex, base32 or base64, told apart by length; None if it can't be read."""
    name, _, value = label.strip().partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = _ALGORITHMS[name]().digest_size if name in _ALGORITHMS else None
    for decode in (bytes.fromhex, lambda v: base64.b32decode(v.upper() + "=" * (-len(v) % 8)), lambda v: base64.b64decode(v + "=" * (-len(v) % 4), validate=True)):
        try:
            got = decode(value)
        except ValueError:  # binascii's error too
            continue
        if got and (size is None or len(got) == size):
            return name, got
    return None


def _agrees(label: str | None, data: bytes) -> bool | None:
    """Whether data has the labelled digest; None if there is none, or none that can be checked."""
    found = _digest(label) if label else None
    return None if found is None or found[0] not in _ALGORITHMS else _ALGORITHMS[found[0]](data).digest() == found[1]


def _hex(label: str | None) -> str | None:
    """A header's digest in hex: bare for SHA-1, with the algorithm's name otherwise; null if it can't be read."""
    found = _digest(label) if label else None
    return None if found is None else found[1].hex() if found[0] == "sha1" else f"{found[0]}:{found[1].hex()}"


def _clean(value) -> str:
    """A header value: line breaks would end the header."""
    return re.sub(r"[\r\n]+", " ", str(value))


def _name(key: str | None) -> str:
    """A record's identifier from a row's id; rows without id have one of their own kind."""
    return "<urn:nopage:0>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def _key(name: str) -> str | None:
    """The id in a record's identifier: null for `_name` of null, foreign identifiers as they are."""
    m = re.fullmatch(r"<urn:page:(.*)>", name, re.S)
    return unquote(m[1]) if m else None if name == "<urn:nopage:0>" else name


def record_bytes(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed: a response with HTTP header and payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at `at` of uncompressed bytes and the position after it; None if any check fails.

    Folded header lines go on with the line before. Digests may be of any
    algorithm and in hex, base32 or base64; what can't be checked is no
    failure. A block that agrees with its own digest is whole, so a payload
    digest counts only beside a block digest that wasn't checked (archives
    differ in what they take for the payload of an encoded body). Blocks that
    are no HTTP message are payload as a whole.
    """
    m = _VERSION.match(data, at)
    if not m:
        return None
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return None
    head, last = {}, None
    for line in data[m.end() : end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last is not None:
            head[last] = f"{head[last]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().lower().decode("ascii", "replace")
        head[last] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "content-length"} <= head.keys() or not head["content-length"].isdecimal():
        return None
    start, length = end + 4, int(head["content-length"])
    block = data[start : start + length]
    if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        return None
    sound = _agrees(head.get("warc-block-digest"), block)
    if sound is False:
        return None
    http, payload = b"", block
    if head.get("content-type", "application/http").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t\r]*$", http)
    if sound is None and head["warc-type"] == "response" and _agrees(head.get("warc-payload-digest"), payload) is False:
        return None
    return {"head": head, "payload": payload, "payload_bytes": int(size[1]) if size else len(payload), "checked": sound is not None}, start + length + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, the position after it, and what is wrong with it: "", "cut" or "damaged".

    Of a damaged member the position is where the damage was noticed, and the
    bytes are those before it.
    """
    z = zlib.decompressobj(31)
    out, view, pos = [], memoryview(data), at
    while pos < len(data) and not z.eof:
        before, step = z.copy(), view[pos : pos + 65536]
        try:
            out.append(z.decompress(step))
            pos += len(step)
        except zlib.error:
            try:  # once more byte by byte, for what comes before the damage
                for i in range(len(step)):
                    out.append(before.decompress(step[i : i + 1]))
                    pos += 1
            except zlib.error:
                pass
            return b"".join(out), pos, "damaged"
    return b"".join(out), pos - len(z.unused_data), "" if z.eof else "cut"


def _records(data: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) of the valid records of uncompressed bytes, in order; record is null for the gaps between them."""
    at, gap = 0, None
    while at < len(data):
        r = _parse(data, at)
        if r is None:
            gap = at if gap is None else gap
            at = data.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield gap, at, None
            gap = None
        yield at, r[1], r[0]
        at = r[1]
    if gap is not None:
        yield gap, len(data), None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """Read an archive, compressed by member or as a whole or plain, and recover what is whole.

    Yields ("record", start, end, record) for each record that passes its
    checks (version line, lengths, digests) and ("gap", start, end, reason)
    for each quarantined range of bytes of the file. After a failed check the
    search goes on at the next byte that begins a member or version line, so
    later records survive, inside of members too: of a member with a bad
    record the others are kept (the gap is the member's range, its reason says
    which of the inflated bytes are lost), and of a cut or damaged member
    those inflated before the end or the damage (the gap begins there). From a
    damaged member only records with a block digest are trusted.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        found, reason, end = [], "no valid record", at
        if data[at : at + 3] == b"\x1f\x8b\x08":
            inner, end, wrong = _inflate(data, at)
            for start, stop, r in _records(inner):
                if r is not None and (wrong != "damaged" or r["checked"]):
                    found.append(("record", at, end, r))
                elif not wrong or found or stop < len(inner):
                    found.append(("gap", at, end, f"inflated bytes {start} to {stop} of {len(inner)} hold no valid record"))
            if wrong:
                reason = f"{wrong} member"
                if not any(f[0] == "record" for f in found):
                    found, end = [], at
        elif (r := _parse(data, at)) is not None:
            found, end, wrong = [("record", at, r[1], r[0])], r[1], ""
        else:
            wrong = "none"
        if found or (end > at and not wrong):
            if gap is not None:
                yield "gap", gap, at, why
                gap = None
            yield from found
            at = end
            if not wrong:
                continue
        if gap is None:
            gap, why = at, reason
        marks = [p for p in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if p >= 0]
        at = min(marks) if marks else len(data)
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data), why


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_revisits(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """df's rows as (id, url, body, refers_to): of equal bodies of at least REVISIT_BYTES the largest id is kept.

    Only digests, lengths and ids are grouped, with map-side maxima; bodies
    meet the groups with more than one row, which are broadcast if they are
    few and joined by digest, with skewed digests split, otherwise.
    """
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), "url", body.alias("body"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    groups = rows.where((F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest", "size").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("digest", "size", "keeper"), "warc-groups")
    joined = rows.join(few(groups), ["digest", "size"], "left")
    return joined.select("id", "url", "body", F.when(F.col("id") != F.col("keeper"), F.col("keeper")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (id, url, body, refers_to) as .warc.gz files in `folder`; returns the manifest, one row per file: file, records, bytes.

    Each attempt of a task writes files under names of its own, and the
    manifest, which only whole attempts enter, lists the ones that count. A
    task that is repeated after an executor is lost, however its rows are cut,
    leaves files that no manifest names.
    """
    python_ready(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, at = _filesystem(folder)
        files.create_dir(at, recursive=True)
        attempt, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", []
        buffer, size = [], 0

        def close():
            nonlocal buffer, size
            name = f"{at}/part-{attempt}-{len(done):04d}.warc.gz"
            with files.open_output_stream(name, compression=None) as out:  # the members are packed already
                for b in buffer:
                    out.write(b)
            done.append((name, len(buffer), size))
            buffer, size = [], 0

        for b in batches:
            for i in range(b.num_rows):  # row by row: bodies may be long
                key, url, body, refers = (c[i].as_py() for c in b.columns)
                buffer.append(gzip_member(record_bytes(key, url, body, refers)))
                size += len(buffer[-1])
                if size >= FILE_BYTES:
                    close()
        if buffer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    text = records.select(F.col("id").cast("string").alias("id"), "url", "body", F.col("refers_to").cast("string").alias("refers_to"))
    return materialise(text.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


_FIELDS = (("file", pa.string()), ("kind", pa.string()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("type", pa.string()), ("key", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string()))
_SCHEMA = "file string, kind string, first_byte long, last_byte long, type string, key string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"


def _rows(file: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """Records and gaps of one archive in batches of bounded size."""
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])

    for kind, start, end, r in salvage(data):
        if kind == "gap":
            rows.append((file, kind, start, end, None, None, None, None, None, None, None, r))
            continue
        head = r["head"]
        ref = head.get("warc-refers-to")
        rows.append((file, kind, start, end, head["warc-type"], _key(head["warc-record-id"]), head.get("warc-target-uri"), _key(ref) if ref else None, r["payload_bytes"], _hex(head.get("warc-payload-digest")), r["payload"] if head["warc-type"] == "response" else None, None))
        held += len(r["payload"])
        if held >= READ_BYTES or len(rows) >= 5000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def read_archives(spark: SparkSession, path: str, glob: str = "*.warc.gz") -> DataFrame:
    """All records and gaps of the archives under `path`: file, kind, first_byte, last_byte, type, key, url, refers_to, payload_bytes, payload_digest, payload, reason.

    Files come through Spark's own reader, so they may lie in any store it
    reads; each is one cell, so up to 2 GB. kind is record or gap; a gap has
    its reason and no other field. payload_digest is hex: bare for SHA-1, as
    `algorithm:hex` for others, null where the header has none that is legible.
    """
    python_ready(spark)

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from _rows(b.column(0)[i].as_py(), b.column(1)[i].as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(read, _SCHEMA)


def read_listed(manifest: DataFrame, folder: str) -> DataFrame:
    """`read_archives` of the files in a manifest of `write_archives`, and of no other: files of attempts that failed are not read."""
    spark = manifest.sparkSession
    python_ready(spark)

    def read(batches):
        files, _ = _filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with files.open_input_stream(name, compression=None) as f:
                    yield from _rows(name, f.read())

    return manifest.select("file").repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(read, _SCHEMA)


def quarantine(found: DataFrame) -> DataFrame:
    """The gaps among `found` as a table of their own (file, first_byte, last_byte, reason), with a warning that counts them."""
    gaps = materialise(found.where("kind = 'gap'").select("file", "first_byte", "last_byte", "reason"), "warc-gaps")
    n, size = gaps.agg(F.count("*"), F.coalesce(F.sum(F.col("last_byte") - F.col("first_byte")), F.lit(0))).first()
    if n:
        log.warning("%d gaps of %d bytes in archives, listed in %s", n, size, gaps._weftgraph_path)
    return gaps


def archive_round_trip(df: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """Write a record per row of df, read the archives back and report what they hold.

    A null body is an empty payload, a null url leaves out the target header,
    null ids are written as records of their own that never keep a group;
    repeated rows with one id are each written (those equal to the kept row
    are responses too). Ids of any text survive. Only files of the manifest
    are read. Damaged bytes go to `quarantine` and raise if records are
    missing. Very long bodies are one record in one task; other columns are
    not read. An empty table gives no rows.
    Returns id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "warc")
    kind = df.schema[id_col].dataType
    manifest = write_archives(with_revisits(df, id_col, body_col), folder)
    found = materialise(read_listed(manifest, folder).drop("payload"), "warc-read")
    gaps = quarantine(found)
    back = found.where("kind = 'record'")
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if back.count() != written:
        raise OSError(f"{written} records were written and {back.count()} read; gaps are listed in {gaps._weftgraph_path}")
    return back.select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM g
"""
