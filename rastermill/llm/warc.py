"""WARC archives: a writer of whole-file gzip streams, a normaliser to one gzip member a record with an offset index, a reader."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, open_fs, prepare, scratch

#: Bytes inflated at a time.
CHUNK = 1 << 18
#: Tables of repeated payloads up to this many rows are broadcast (checked), larger ones joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The index: this mark and the number of records, then offset and length of each member (unsigned 64 bits).
MAGIC, HEADER = b"WARCIDX1", "<8sQ"
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, kind: str, refers_to, mark: str) -> bytes:
    """A response holds an HTTP header and the payload, a revisit the header alone; both state the full payload's digest and length."""
    target = "".join(c for c in (url or "") if c not in "\r\n")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{mark}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{mark}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http if kind == "revisit" else http + payload)


class Records:
    """Cuts a byte stream into raw records; holds one record at a time."""

    def __init__(self, read):
        self.read, self.buffer, self.over = read, bytearray(), False

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n and not self.over:
            got = self.read()
            self.over = not got
            self.buffer += got
        return len(self.buffer) >= n

    def __iter__(self):
        while self._fill(1):
            at = -1
            while at < 0:
                n = len(self.buffer)
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0 and not self._fill(n + 1):
                    raise ValueError("the archive ends within a record's header")
            length = next((int(x.partition(b":")[2]) for x in bytes(self.buffer[:at]).split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
            if not self.buffer.startswith(b"WARC/") or length is None:
                raise ValueError("no WARC record where one should begin")
            end = at + 4 + length + 4
            if not self._fill(end) or self.buffer[end - 4 : end] != b"\r\n\r\n":
                raise ValueError("the archive ends within a record")
            yield bytes(self.buffer[:end])
            del self.buffer[:end]


def inflated(source):
    """Next piece of the inflated stream of one or more gzip members; empty at the end."""
    state = {"z": zlib.decompressobj(31), "left": b""}

    def read() -> bytes:
        while True:
            data = state["left"] or source.read(CHUNK)
            if not data:
                if state["z"] is not None and not state["z"].eof and state.get("begun"):
                    raise ValueError("the gzip stream is cut short")
                return b""
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            state["begun"] = True
            out = state["z"].decompress(data, CHUNK)
            state["left"] = state["z"].unused_data if state["z"].eof else state["z"].unconsumed_tail
            if out:
                return out

    return read


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.partition(":")[::2] for x in head.decode().split("\r\n")[1:])
    return {k: v.strip() for k, v in fields.items()}, block[:-4]


def with_types(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, kind, refers_to.  Payloads are compared by digest; only digests that occur twice or more are joined back."""
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = kept.withColumn("mark", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("counts", F.octet_length("html") >= least)
    twice = cut_lineage(marked.filter("counts").groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest")).filter("n > 1").select("mark", "largest", F.lit(True).alias("repeated")))
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    same = F.col("repeated") & F.col("counts") & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return marked.join(twice, "mark", "left").select("page_id", "url", "html", F.when(same, "revisit").otherwise("response").alias("kind"), F.when(same, F.col("largest")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """One gzip stream over all records of a task; returns a row (path) for each file, materialised."""
    prepare(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        out, z, (fs, path), name = None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), open_fs(folder), f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(path)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode()
                out.write(z.compress(page_record(page_id, url, payload, kind, refers_to, digest(payload))))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return cut_lineage(with_types(pages, least).mapInArrow(run, "path string"))


def normalise_file(fs, source: str, target: str) -> int:
    """Inflates source once, rewrites each record as a gzip member of its own at target, and the index at target.idx."""
    at, places = 0, []
    with fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(target, compression=None) as out:
        for raw in Records(inflated(f)):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            places += [at, len(member)]
            at += len(member)
    with fs.open_output_stream(f"{target}.idx") as out:
        out.write(struct.pack(HEADER, MAGIC, len(places) // 2) + np.array(places, "<u8").tobytes())
    return len(places) // 2


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Normalises each file of a table (path), one task a file; returns path and n_records, materialised.  Attempts write under names of their own."""
    prepare(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                (fs, source), (_, path) = open_fs(uri), open_fs(folder)
                fs.create_dir(path)
                name = f"{uuid.uuid4().hex}.warc.gz"
                n = normalise_file(fs, source, f"{path}/{name}")
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    return cut_lineage(spread(files, "path").mapInArrow(run, "path string, n_records long"))


def spread(files: DataFrame, *columns: str) -> DataFrame:
    """A partition for each row of a table with a row for each file."""
    numbered = [(*r, i) for i, r in enumerate(files.select(*columns).collect())]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*columns).schema) + ", number int"
    return files.sparkSession.createDataFrame(numbered, schema).repartitionById(max(1, len(numbered)), F.col("number")).drop("number")


def read_records(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, found by the index and inflated member by member."""
    prepare(files.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(f"{path}.idx") as f:
                    magic, n = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
                    if magic != MAGIC:
                        raise ValueError(f"{uri}.idx is not an index")
                    places = np.frombuffer(f.read(16 * n), "<u8").reshape(-1, 2)
                rows = []
                with fs.open_input_file(path) as f:
                    for at, length in places.tolist():
                        f.seek(at)
                        fields, block = parse(zlib.decompress(f.read(length), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"))
                        mark, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != mark):
                            raise ValueError(f"a payload of {uri} differs from its digest")
                        whole = lambda x: int(x) if x else None
                        rows.append((whole(fields["X-Page-ID"]), size, mark, kind, whole(fields.get("X-Refers-To-Page-ID"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return spread(files, "path").mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html), normalises, reads back.

    Null html is an empty payload, null urls are empty.  Of records with equal payloads of at least `least` bytes that with the
    largest page_id is the response (rows that repeat that id too; null ids count as smallest), the others revisit it.  Other
    columns are ignored; no rows, no files.
    """
    folder = scratch(pages.sparkSession, "warc")
    return read_records(normalise(write_monolithic(pages, f"{folder}/whole", least), f"{folder}/members"))
