"""Web archives in WARC form with a two-level capture index.

Writing: every task writes gzip-member records to files of its own in the shared folder and returns where each stands; a retried task
writes new files and the places of the failed attempt are never seen. A payload of at least ``least`` bytes that several pages
share is stored once, with the largest page id; the others become revisit records. Payload digests are compared, so only ids, digests and
sizes are shuffled for that, and the pages once more if the list of revisits is too long to broadcast.

Index: lines of (reversed-host key, capture, file, offset, length) are range partitioned and sorted, and written as compressed blocks of
``lines`` lines; the directory has one row per block with its first and last line's key. A look-up sorts the wanted
captures, reads the part of the directory that spans them, finds each block by binary search, reads that byte range, and finds the
line by binary search again. Records are then read by byte ranges in file order.

Rows: a null payload is empty; a null URL has the empty key and no target in its record; a null page id is a capture of its own
that sorts first and may revisit others. Of rows that repeat a page id and its payload all are responses if the id is the largest, else all
are revisits. Empty tables give an empty index and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches
from ledgerlens.session import materialize, workspace

LEAST = 1000
ROLL = 1 << 30
_NO_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "key string, capture long, file string, at long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def reversed_host_key(url: Column) -> Column:
    """``com,example,blog)/path?query`` for ``https://user@www.blog.example.com:443/path?query#part``."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\x00-\x20\x7F]", "%20")
    rest = F.regexp_replace(F.regexp_replace(clean, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    authority = F.regexp_extract(rest, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^[^@]*@", ""), "(:80|:443|:)$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    path = F.substring(rest, F.length(authority) + 1, F.length(rest))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit(""))


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), its size and digest, ``record_type`` and ``refers_to`` of each page."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), data.alias("payload"),
                        F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("payload_digest"))
    slim = materialize(rows.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= least), "slim")
    shared = slim.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1").select("payload_digest", "refers_to"), "shared")
    again = slim.join(shared, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = materialize(again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to").distinct(),
                        "revisits")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select(*rows.columns, F.when(F.col("_digest").isNull(), "response").otherwise("revisit").alias("record_type"),
                         "refers_to")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None,
           date: str) -> bytes:
    """One record, not yet compressed. A revisit has the HTTP header of its page, with the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        head.insert(4, f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; checks the payload of a response against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    else:
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])

    def number(name: str) -> int | None:
        value = fields.get(name, "none>").rpartition(":")[2].rstrip(">")
        return None if value == "none" else int(value)

    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


class _Files:
    """Output files of one task in a shared folder."""

    def __init__(self, folder: str, ending: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.ending, self.out = folder, ending, None

    def write(self, data: bytes) -> tuple[str, int]:
        """File name and offset of what has been written."""
        if self.out is None or self.at >= ROLL:
            self.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.ending}"
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.file}", compression=None), 0
        place = self.file, self.at
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "capture", "file", "at", "length"])


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes the records of ``decide`` as archive files in ``folder``; the stored table of their places (``PLACES``)."""
    bounded_batches(records.sparkSession)
    keyed = records.withColumn("key", reversed_host_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = _member(record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"],
                                      r["record_type"], r["refers_to"], date), level)
                file, at = files.write(data)
                rows.append((r["key"], _NO_ID if r["page_id"] is None else r["page_id"], file, at, len(data)))
            yield _places(rows)
        files.close()

    return materialize(keyed.mapInArrow(run, PLACES), "places")


def build_index(places: DataFrame, folder: str, lines: int = 3000) -> None:
    """Writes the blocks and ``directory`` (Parquet) of the capture index into ``folder``."""
    spark = places.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "capture", "file", "at"]
    sorted_ = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = _Files(folder, ".idx.gz"), []

        def block(rows: list[dict]) -> tuple:
            text = "\n".join(f"{r['key']}\t{r['capture']}\t{r['file']}\t{r['at']}\t{r['length']}" for r in rows)
            data = _member(text.encode(), 6)
            file, at = files.write(data)
            return rows[0]["key"], rows[0]["capture"], rows[-1]["key"], rows[-1]["capture"], file, at, len(data)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 7, kinds)],
                                              ["first_key", "first_capture", "last_key", "last_capture", "file", "at", "length"])

        for batch in batches:
            held += batch.to_pylist()
            found = []
            while len(held) >= lines:
                found.append(block(held[:lines]))
                held = held[lines:]
            yield batch_of(found)
        if held:
            yield batch_of([block(held)])
        files.close()

    schema = "first_key string, first_capture long, last_key string, last_capture long, file string, at long, length long"
    sorted_.mapInArrow(run, schema).write.parquet(f"{folder}/directory")


def look_up(wanted: DataFrame, folder: str) -> DataFrame:
    """Index lines (``PLACES``) of the captures in ``wanted`` (``key``, ``capture``); a capture without a line gives none."""
    spark = wanted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = wanted.select("key", "capture").distinct().repartitionByRange(parts, "key", "capture").sortWithinPartitions("key", "capture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        opened: dict[str, pa.NativeFile] = {}
        directory = pa.dataset.dataset(f"{path}/directory", filesystem=fs, format="parquet")
        columns = ["first_key", "first_capture", "last_key", "last_capture", "file", "at", "length"]
        last, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("capture").to_pylist()))
            if not keys:
                continue
            field = pa.dataset.field
            span = directory.to_table(columns, filter=(field("last_key") >= keys[0][0]) & (field("first_key") <= keys[-1][0]))
            blocks = sorted(zip(*[span.column(c).to_pylist() for c in columns]))
            ends = [(b[2], b[3]) for b in blocks]
            rows = []
            for wanted_one in keys:
                i = bisect.bisect_left(ends, wanted_one)  # first block that ends at or after it
                while i < len(blocks) and blocks[i][:2] <= wanted_one:
                    file, at, length = blocks[i][4:]
                    if (file, at) != last:
                        if file not in opened:
                            opened.clear()
                            opened[file] = fs.open_input_file(f"{path}/{file}")
                        text = zlib.decompress(opened[file].read_at(length, at), 31).decode()
                        held = [(k, int(c), f, int(o), int(n)) for k, c, f, o, n in (x.split("\t") for x in text.split("\n"))]
                        last = (file, at)
                    j = bisect.bisect_left(held, wanted_one)
                    while j < len(held) and held[j][:2] == wanted_one:
                        rows.append(held[j])
                        j += 1
                    i += 1
            yield _places(rows)

    return sorted_.mapInArrow(run, PLACES)


def read(places: DataFrame, folder: str) -> DataFrame:
    """The records (``RECORDS``) at ``places``, by byte ranges in file order."""
    spark = places.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = places.select("file", "at", "length").repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, source = r["file"], fs.open_input_file(f"{path}/{r['file']}")
                rows.append(parse(zlib.decompress(source.read_at(r["length"], r["at"]), 31)))
                size += rows[-1]["payload_bytes"]
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)

    return sorted_.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html",
            least: int = LEAST) -> str:
    """Writes archives and index of ``pages``; the folder that holds them, by default a new one in the shared workspace."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{workspace(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        raise ValueError("give an absolute path or a URI")
    places = write(decide(pages, page_id, url, payload, least), f"{folder}/records")
    build_index(places, f"{folder}/index")
    return folder


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Index keys of pages."""
    return pages.select(reversed_host_key(F.col(url)).alias("key"), F.coalesce(F.col(page_id).cast("long"), F.lit(_NO_ID)).alias("capture"))


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """Records of the captures in ``wanted`` (``key``, ``capture``), through the index of ``folder``."""
    return read(look_up(wanted, f"{folder}/index"), f"{folder}/records")
