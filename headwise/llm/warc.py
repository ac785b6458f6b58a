"""WARC archives with a two-level capture index.

Every page becomes a WARC record of its own gzip member. Of equal payloads the one with the least page_id is a
response, the others are revisits that refer to it. Index lines, keyed by reversed host, path and page, are
sorted and written in compressed blocks; a sparse directory holds the first key and the place of every block.
A look-up finds the block by binary search in the directory, reads that range, finds the line by binary search
in the block, and reads the range of the record.

Files are written by the tasks through ``pyarrow.fs`` to the shared folder, under names of their own; only what
the finished tasks report is in the index, so a repeated task leaves at most an unused file behind.
"""
import base64
import bisect
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from headwise.llm.common import fields, work_path, write_and_read

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: The directory has at most this many blocks: beyond, blocks hold more lines. It is what every task loads.
MAX_BLOCKS = 50_000
#: Tasks that read records back; the keys are small but each stands for a range read, so Spark must not merge them by size.
READ_TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_NULL_ID = -(1 << 63)


def _open(path):
    """A file system and a path in it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def payload_digest(payload):
    """Base32 SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_key(url, page_id):
    """Reversed host, path and page: captures of a site and its subdomains stand together."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, _, path = rest.partition("/")
    turned = ",".join(reversed(host.lower().split(":")[0].split(".")))
    return f"{turned})/{path} {page_id + (1 << 63):020d}".encode("utf-8", "surrogatepass")


def record_bytes(url, page_id, payload, digest, refers_to=None):
    """One record: headers, and the HTTP response with the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}".encode()
    block = http if refers_to is not None else http + payload
    # A header is one line, so line breaks of a url are escaped; all else stands as it is.
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Page-ID: {page_id}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END.encode() + block + _END.encode()


def parse_record(data):
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(_END.encode())
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(_END.encode())
    http_headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return headers, http_headers, payload


def write_archives(pages, folder, archive_bytes=ARCHIVE_BYTES):
    """Write pages (page_id, url, html, refers_to) and return their captures: key, page_id, file, offset, length."""
    schema = pa.schema([("key", pa.binary()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        sink = name = None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if sink is None or sink.tell() >= archive_bytes:
                        if sink is not None:
                            sink.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink = files.open_output_stream(f"{root}/{name}", compression=None)
                        sink.write(gzip.compress(_info(name), 6, mtime=0))
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    member = gzip.compress(record_bytes(url, page_id, payload, payload_digest(payload), refers_to), 6, mtime=0)
                    rows.append((capture_key(url, page_id), page_id, name, sink.tell(), len(member)))
                    sink.write(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            if sink is not None:
                sink.close()

    return pages.mapInArrow(run, "key binary, page_id long, file string, offset long, length long")


def _info(name):
    body = b"software: headwise\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _END.encode() + body + _END.encode()


def write_index(captures, folder, block_lines=BLOCK_LINES):
    """Write the captures in key order as compressed blocks; returns the directory: first, file, offset, length."""
    lines = max(block_lines, -(-captures.count() // MAX_BLOCKS))
    schema = pa.schema([("first", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        held, sink = [], None

        def block():
            nonlocal sink
            if sink is None:
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
            body = zlib.compress(b"\n".join(
                k.replace(b"%", b"%25").replace(b"\n", b"%0A") + b"\t" + f"{f}\t{o}\t{n}".encode() for k, f, o, n in held), 6)
            row = (held[0][0], name, sink.tell(), len(body))
            sink.write(body)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                    held.append(row)
                    if len(held) >= lines:
                        yield block()
            if held:
                yield block()
        finally:
            if sink is not None:
                sink.close()

    ordered = captures.repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "first binary, file string, offset long, length long")


def _block(data):
    """Keys and places of the lines of one block."""
    keys, places = [], []
    for line in zlib.decompress(data).split(b"\n"):
        key, file, offset, length = line.rsplit(b"\t", 3)
        keys.append(key.replace(b"%0A", b"\n").replace(b"%25", b"%"))
        places.append((file.decode(), int(offset), int(length)))
    return keys, places


def read_captures(wanted, directory, folder):
    """Look up captures by key (url, page_id) and read them back.

    ``wanted`` has url and page_id. Look-ups are dealt to the blocks that hold them, so each block is read by
    one task and each record by a range read. Returns page_id, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for a revisit); what the index does not hold gives no row.
    """
    spark = wanted.sparkSession
    rows = sorted(directory.collect(), key=lambda r: (bytes(r["first"]), r["file"], r["offset"]))  # MAX_BLOCKS and a block per partition
    shared = spark.sparkContext.broadcast([(bytes(r["first"]), r["file"], r["offset"], r["length"]) for r in rows])

    def find(batches):
        firsts = [r[0] for r in shared.value]
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
            # Equal keys of repeated rows may begin in the block before.
            last = [bisect.bisect_right(firsts, k) - 1 for k in keys]
            first = [max(0, bisect.bisect_left(firsts, k) - 1) for k in keys]
            out = [(k, b) for k, f, t in zip(keys, first, last) for b in range(f, t + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64())], names=["key", "block"])

    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        files, root = _open(folder)
        block = keys = places = None
        opened = {}

        def part(name, offset, length):
            if name not in opened:
                if len(opened) >= 64:
                    opened.popitem()[1].close()
                opened[name] = files.open_input_file(f"{root}/{name}")
            opened[name].seek(offset)
            return opened[name].read(length)

        for batch in batches:
            found = []
            for key, number in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist()):
                if number != block:
                    _, name, offset, length = shared.value[number]
                    block, (keys, places) = number, _block(part(name, offset, length))
                at = bisect.bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    found.append(places[at])
                    at += 1
            for start in range(0, len(found), 256):
                rows = []
                for name, offset, length in sorted(found[start: start + 256]):
                    headers, http, payload = parse_record(gzip.decompress(part(name, offset, length)))
                    digest = headers["WARC-Payload-Digest"].partition(":")[2]
                    response = headers["WARC-Type"] == "response"
                    if response and payload_digest(payload) != digest:
                        raise ValueError(f"record at {name}:{offset} does not match its digest")
                    rows.append((
                        int(headers["WARC-Page-ID"]), int(http["Content-Length"]), digest, headers["WARC-Type"],
                        None if response else int(headers["WARC-Refers-To-Page"]), payload if response else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    dealt = wanted.mapInArrow(find, "key binary, block long").distinct().repartition(
        max(1, min(len(rows), READ_TASKS)), "block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages, folder=None):
    """Write pages to WARC archives with their index; returns (captures, directory, folder).

    Null html is an empty payload, a null url an empty one. A null page_id counts as the least of all. Rows that
    share a page_id are separate records; if their payloads are equal, too, each repeats the first in its role.
    """
    folder = folder or work_path(pages.sparkSession, "warc")
    slim = fields(pages, "page_id", "url", "html").withColumn(
        "page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL_ID))).withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    # Only payloads that occur more than once need a reference; the table is written, so Spark knows its size.
    first = write_and_read(
        slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payloads")
    roles = slim.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")))
    captures = write_and_read(write_archives(roles.select("page_id", "url", "html", "refers_to"), folder), "captures")
    directory = write_and_read(write_index(captures, folder), "directory")
    return captures, directory, folder


def round_trip(pages):
    """Archive all pages, then look each of them up in the index and read it back."""
    _, directory, folder = archive_pages(pages)
    wanted = fields(pages, "page_id", "url").withColumn("page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL_ID)))
    read = read_captures(wanted, directory, folder)
    return read.withColumns({c: F.when(F.col(c) != _NULL_ID, F.col(c)) for c in ("page_id",)})
