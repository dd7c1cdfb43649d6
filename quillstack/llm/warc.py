"""WARC archives in Zstandard: one frame for each record, the dictionary in the leading skippable frame.

Writing: records with equal payloads (length, SHA-256 and SHA-1) of at least `LEAST` bytes have
one response, that of the largest id; the others are revisits that name it.  Each task writes one
archive, whole and then moved in place, with a dictionary from its own first records.

Reading: the reader takes the leading skippable frame's content as the dictionary, decodes frame
by frame, and raises ValueError where a frame holds anything but one record, a length or a digest
doesn't hold, or a mandatory header is missing.  It holds one record at a time.

Defined results: a null payload is empty; rows with the same id and payload are all responses, or
all revisits; a null id is smaller than any other; an empty table writes no archive and gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, opened, put_whole, ship, stored, table

LEAST = 1000
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY_RECORDS, DICTIONARY_PIECE, DICTIONARY_BYTES = 128, 16 << 10, 64 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8d2f6a4e-52b5-4b7e-9e0c-0f6b1c1f7a55")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(key))}>"


def record(key, uri: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC/1.1 record of an HTTP response.  A revisit has the HTTP header, with the full
    payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {refers_to}"] if revisit else []),
        *([] if key is None else [f"X-Key: {key}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), payload, and what its HTTP header says; validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"bad header line {line[:60]!r}")
        headers[name.decode().strip().lower()] = value.decode("utf-8").strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    n = int(headers["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("the block isn't as long as Content-Length says")
    if (d := headers.get("warc-block-digest")) and d != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if headers["warc-type"] == "response":
        if length is not None and length != len(payload):
            raise ValueError("payload length")
        if (d := headers.get("warc-payload-digest")) and d != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise ValueError("payload digest")
    return {"headers": headers, "payload": payload, "payload_length": length}


class Writer:
    """One archive: a skippable frame with the dictionary, then one frame a record."""

    def __init__(self, out, samples: list[bytes]):
        import zstandard as z

        self.out = out
        raw = b"".join(samples)
        try:
            data = z.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 and len(raw) > 8 * DICTIONARY_BYTES else b""
        except z.ZstdError:
            data = b""
        data = data or raw[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
        out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.z = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(data), write_content_size=True)

    def add(self, raw: bytes) -> None:
        self.out.write(self.z.compress(raw))


def read_records(stream, piece: int = 1 << 20):
    """The records of an archive, one decoded frame at a time."""
    import zstandard as z

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("no leading skippable frame")
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary is cut off")
    if data[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        data = z.ZstdDecompressor().decompressobj().decompress(data)
    decoder = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(data))
    rest = b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(piece)):
                raise ValueError("a frame is cut off")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield parse(b"".join(parts))


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str | None = "url", least: int = LEAST) -> DataFrame:
    """(key, uri, body, digest, revisit, refers_to).  The digests' groups are counted with partial
    sums and joined back by digest and salt, so a third of all rows in one group is many tasks' work."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("k"), (F.col(uri) if uri else F.lit(None).cast("string")).alias("uri"), body.alias("body"))
    light = rows.select("k", F.sha1("body").alias("digest"), F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("n"))
    salts = 32
    groups = light.where(F.col("n") >= least).groupBy("sha", "digest").agg(F.max("k").alias("first"), F.count("*").alias("copies"))
    groups = stored(groups.where("copies > 1").select("sha", F.col("digest").alias("gd"), "first"), "warc-groups")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("sha", F.sha2("body", 256)).withColumn("salt", F.pmod(F.xxhash64("k", "uri"), F.lit(salts)).cast("int"))
    met = rows.join(groups, ["sha", "salt"], "left")
    revisit = F.coalesce((F.octet_length("body") >= least) & (F.col("gd") == F.col("digest")) & ~F.col("k").eqNullSafe(F.col("first")), F.lit(False))
    return met.select("k", "uri", "body", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("first"))


def write_archives(planned: DataFrame, to: str | None = None) -> DataFrame:
    """Write the planned records, one archive for each task: (path, n_records)."""
    spark = planned.sparkSession
    ship(spark)
    to = to or folder(spark, "warc")

    def work(batches):
        import pyarrow as pa

        rows = ((n, r) for b in batches for n, r in zip(b.column(6).to_pylist(), zip(*(b.column(i).to_pylist() for i in range(6)))))
        head = []
        for n, r in rows:
            head.append((n, r))
            if len(head) >= DICTIONARY_RECORDS:
                break
        if not head:
            return
        path = f"{to}/{head[0][0]:05d}.warc.zst"
        count = 0

        def fill(out):
            nonlocal count
            w = Writer(out, [r[2][:DICTIONARY_PIECE] for _, r in head if r[2]])
            for part in (head, rows):
                for _, (k, uri, body, digest, revisit, first) in part:
                    w.add(record(k, uri, body, digest, first, revisit))
                    count += 1

        put_whole(path, fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})

    numbered = planned.select("k", "uri", "body", "digest", "revisit", "first", F.spark_partition_id().alias("part"))
    return stored(numbered.mapInArrow(work, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, key_type: str = "long", key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    spark = manifest.sparkSession
    ship(spark)

    def work(batches):
        import pyarrow as pa

        names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for m in batches:
            for path, want in zip(m.column(0).to_pylist(), m.column(1).to_pylist()):
                store, at = opened(path)
                seen, rows = 0, []
                with store.open_input_stream(at, compression=None) as f:
                    for r in read_records(f):
                        h = r["headers"]
                        revisit = h["warc-type"] == "revisit"
                        rows.append((h.get("x-key"), r["payload_length"] if revisit else len(r["payload"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], h.get("x-refers-to-key")))
                        seen += 1
                        if len(rows) >= 5000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                if seen != want:
                    raise ValueError(f"{path}: {seen} records, {want} were written")

    read = manifest.repartition(max(1, manifest.count()), "path").mapInArrow(work, f"{key} string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumns({key: F.col(key).cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str | None = "url") -> DataFrame:
    """Write `pages` as archives and read them back."""
    return read_archives(write_archives(plan_records(pages, key, payload, uri)), pages.schema[key].dataType.simpleString(), key)


def op5_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM q
"""
