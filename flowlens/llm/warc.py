"""WARC archives as seekable Zstandard bundles.

A bundle file holds WARC/1.1 records grouped into independent Zstandard frames of about
``frame_bytes``, and ends with the footer of the seekable format: a skippable frame with
the compressed and plain size of each frame. An index table maps each record id to
(bundle, frame, offset in the plain frame), so one record is read by one range of the file.

Each task writes its own files under names that no other attempt uses, in the shared
folder, through the file system named by its URI; only files listed in the index (the
results of the attempts that Spark accepts) belong to the archive.

Records with equal payloads: the one of the smallest page id is the response, the others
are revisits. This is decided by joining SHA-1 digests natively; the smallest id is
aggregated map-side first, and the join splits skewed digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialize, shuffle_parts
from flowlens.session import scratch_path

# Fixed values of the seekable Zstandard format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, first_id, is_response): first_id is the id of the first
    record with this payload. Null payloads are empty; null ids come after all others; of
    repeated rows of the first id one is the response."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    src = src.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    last = F.lit((1 << 63) - 1)
    narrow = src.where(F.octet_length("payload") >= min_bytes).select("digest", F.coalesce("page_id", last).alias("id"))
    first = (narrow.groupBy("digest", "id").count().groupBy("digest")
             .agg(F.min(F.struct("id", "count")).alias("first"), F.sum("count").alias("n")).where("n > 1")
             .select("digest", F.col("first.id").alias("first_id"), F.col("first.count").alias("n_first")))
    first = materialize(first, "warc-first")
    out = src.join(first, "digest", "left")
    key = F.coalesce("page_id", last)
    mine = F.col("first_id").isNull() | (key == F.col("first_id"))
    if first.where("n_first > 1").limit(1).count():
        # repeated rows of a first id: number the rows of each (digest, id)
        turn = F.row_number().over(Window.partitionBy("digest", key).orderBy("url"))
        mine = F.col("first_id").isNull() | ((key == F.col("first_id")) & (turn == 1))
    out = out.withColumn("is_response", mine)
    return out.select("page_id", "url", "payload", "digest",
                      F.when(~F.col("is_response"), F.when(F.col("first_id") < last, F.col("first_id"))).alias("first_id"),
                      "is_response")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)


def record_of(page_id, url, payload: bytes, is_response: bool, first_id, record_id: str) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id}",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
            f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if not is_response:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if first_id is not None:
            head += [f"WARC-Refers-To: {_record_id('response', digest, first_id)}", f"X-Refers-To-Page-Id: {first_id}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, data[stop + 4:end], end + 4


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, stream, frame_bytes: int, level: int):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.records: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.sizes), self.held
        self.records.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.records))
            self.stream.write(frame)
            self.sizes.append((len(frame), self.held))
            self.written += len(frame)
            self.records, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table
                          + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.stream.close()


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("not a seekable bundle without checksums")
        file.seek(size - 9 - 8 * n)
        table = struct.unpack(f"<{2 * n}I", file.read(8 * n))
        self.sizes = list(zip(table[::2], table[1::2]))
        self.begins = [0]
        for c, _ in self.sizes:
            self.begins.append(self.begins[-1] + c)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.begins[k])
        return zstandard.decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])


def open_bundle(uri: str) -> BundleReader:
    files, path = fs.FileSystem.from_uri(uri)
    return BundleReader(files.open_input_file(path))


INDEX = "record_id string, page_id long, bundle string, frame int, offset long"
_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                    ("offset", pa.int64())])


def write_archive(judged: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20,
                  bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write what ``judge`` returned; the index table (written beside the bundles, one row per record).

    ``folder``: a URI of shared storage; by default a new folder below spark.checkpoint.dir.
    An empty table makes no bundle and an empty index."""
    spark = judged.sparkSession
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(it) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        writer, rows, k, seq = None, [], 0, 0
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]

        def batch():
            return pa.RecordBatch.from_pylist(rows, schema=_INDEX)

        for b in it:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for page_id, url, payload, first, response in zip(c["page_id"], c["url"], c["payload"], c["first_id"], c["is_response"]):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{attempt}-{k:04d}.warc.zst"
                    writer = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes, level)
                data = payload.encode("utf-8")
                rid = (_record_id("response", base64.b32encode(hashlib.sha1(data).digest()).decode(), page_id)
                       if response and page_id is not None else _record_id("record", attempt, seq))
                frame, offset = writer.add(record_of(page_id, url, data, response, first, rid))
                rows.append({"record_id": rid, "page_id": page_id, "bundle": f"{folder}/{name}", "frame": frame, "offset": offset})
                seq += 1
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer, k = None, k + 1
            if len(rows) >= 5000:
                yield batch()
                rows.clear()
        if writer is not None:
            writer.close()
        if rows:
            yield batch()

    return materialize(judged.select("page_id", "url", "payload", "first_id", "is_response").mapInArrow(run, INDEX), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload binary):
    every record of the index, read from its bundle. ``payload`` is null for revisits; of these
    the size and digest are those of the full payload. Digests of responses are verified."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def run(it):
        name, bundle = None, None
        for b in it:
            for uri, frame, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if uri != name:
                    name, bundle = uri, open_bundle(uri)
                data, rows = bundle.frame(frame), []
                for at in offsets:
                    head, block, _ = parse_record(data, at)
                    cut = block.index(b"\r\n\r\n") + 4
                    http = dict(x.split(": ", 1) for x in block[:cut - 4].decode("utf-8").split("\r\n")[1:])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode() != digest:
                        raise ValueError(f"digest mismatch in {uri}, frame {frame}, offset {at}")
                    ids = [int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                    rows.append({"record_id": head["WARC-Record-ID"], "page_id": ids[0], "url": head.get("WARC-Target-URI"),
                                 "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
                                 "record_type": head["WARC-Type"], "refers_to": ids[1],
                                 "payload": block[cut:] if response else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a frame's records are few: frames are of bounded size. The rows are tiny but the work is not, so the
    # number of partitions is given, which keeps adaptive execution from merging them
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    frames = frames.repartition(shuffle_parts(index.sparkSession), "bundle", "frame")
    return frames.mapInArrow(run, "record_id string, page_id long, url string, payload_bytes long, payload_digest string, "
                                  "record_type string, refers_to long, payload binary")
