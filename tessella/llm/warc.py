"""WARC archives: a writer, and a Python data source that reads them back.

Reading: the driver lists the archive files and plans partitions of them by size. Predicates on
record_type, record_id, target_uri, refers_to and payload_digest are pushed down. A reader parses a record's headers first; if the
predicates refuse it, or it has no payload to give, the rest of the record is neither inflated nor
decoded: each gzip member says in its header how long it is (the ``sl`` extra field of the format's
annex on compression), so the reader moves on to the next. Files are opened through pyarrow's file systems, which know local, HDFS and
object-store addresses.

Writing: every task writes one archive, under a temporary name that is then changed to the final one,
so that a task that is run again replaces what it wrote. Of records with equal payloads the one with
the largest id carries it; the others are ``revisit`` records that refer to it.

Cases: a null payload is empty. A row without id is always written as a response, and rows that repeat
an id with the same payload don't refer to each other. A null address leaves out its header; control
characters in it are percent-encoded. An empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessella.llm.store import materialise, scratch_root, text_or_empty

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length bigint, http_length bigint, payload binary"
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEAD = 4096


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(content: bytes) -> bytes:
    """A gzip member whose header gives the lengths of itself and of its content."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(content) + body.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def clean_uri(uri: str | None) -> str | None:
    return None if uri is None else "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def page_record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", clean_uri(uri)), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, http if revisit else http + payload)


def file_system(address: str):
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return fs.FileSystem.from_uri(address)


def urn(id_: object) -> str:
    return f"<urn:tessella:page:{id_}>"


def write_archives(df: DataFrame, target: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, compress: bool = True) -> list[tuple[str, int]]:
    """Writes a record a row of df below the folder target; gives each archive's name and how many records it has.

    Payloads of at least least_bytes are written once: which is decided on digests alone.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("rank"), F.col(uri_col).cast("string").alias("uri"), text_or_empty(payload_col).alias("payload"))
    keyed = rows.select("rank", F.sha1(F.col("payload").cast("binary")).alias("sha"), F.octet_length("payload").alias("size"), F.spark_partition_id().alias("run"))
    small = materialise(keyed.where(F.col("rank").isNotNull() & (F.col("size") >= least_bytes)), "payloads")
    kept = small.groupBy("sha").agg(F.max("rank").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A frequent payload is looked up once a run, and its rows stay spread over their runs.
    looked_up = small.select("run", "sha").distinct().join(kept, "sha")
    refers = small.join(looked_up, ["run", "sha"]).where("rank <> keeper").select(F.col("rank").alias("r"), F.col("sha").alias("s"), F.col("keeper").cast("string").alias("keeper")).distinct()
    refers = materialise(refers, "revisits")
    marked = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).join(refers, (F.col("rank") == F.col("r")) & (F.col("sha") == F.col("s")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(target)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc" + (".gz" if compress else "")
        temporary, count, out = f"{folder}/.{name}-{uuid.uuid4().hex}", 0, None
        dress = member if compress else bytes
        for batch in batches:
            for id_, uri, payload, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(temporary, compression=None)
                    out.write(dress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn(f"info:{name}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: tessella\r\nformat: WARC File Format 1.1\r\n")))
                out.write(dress(page_record(urn(id_), uri, payload.encode("utf-8"), None if keeper is None else urn(keeper))))
                count += 1
        if out is not None:
            out.close()
            system.move(temporary, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([count], pa.int64())})

    done = marked.select("id", "uri", "payload", "keeper").mapInArrow(run, "name string, records long")
    return [(r["name"], r["records"]) for r in done.collect()]


class _File:
    """Bytes ahead of a reading position. What has been read lies in one buffer, of which a prefix is used up."""

    CHUNK = 1 << 20

    def __init__(self, stream):
        self.stream, self.held, self.at = stream, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (more := self.stream.read(max(n - len(self.held) + self.at, self.CHUNK))):
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def skip(self, n: int) -> None:
        ahead = len(self.held) - self.at
        if n <= ahead:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.stream.seek(self.stream.tell() + n - ahead)

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _member_size(file: _File) -> int | None:
    """The length that a gzip member's header gives; None if it has none."""
    head = file.peek(12)
    if len(head) < 12 or not head[3] & 4:
        return None
    extra, at = file.peek(12 + struct.unpack("<H", head[10:12])[0])[12:], 0
    while at + 4 <= len(extra):
        size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if extra[at : at + 2] == b"sl" and size == 8:
            return struct.unpack("<I", extra[at + 4 : at + 8])[0]
        at += 4 + size
    return None


def read_records(file: _File, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records that wanted(headers) accepts; block None if it wasn't asked for."""
    while start := file.peek(2):
        if start == b"\x1f\x8b":
            size, inflate, head, given = _member_size(file), zlib.decompressobj(31), b"", 0
            while b"\r\n\r\n" not in head:  # no more is read and inflated than the headers need
                ahead = inflate.unconsumed_tail
                if not ahead:
                    ahead = file.peek(min(size or 1 << 62, given + HEAD))[given:]
                    given += len(ahead)
                if not ahead or inflate.eof:
                    raise ValueError("a record's headers don't end")
                head += inflate.decompress(ahead, HEAD)
            raw, _, rest = head.partition(b"\r\n\r\n")
            headers = parse_headers(raw)
            take = wanted(headers)
            if size and not (take and payloads):
                file.skip(size)
                if take:
                    yield headers, None
                continue
            body, used = [rest], given
            body.append(inflate.decompress(inflate.unconsumed_tail))
            while not inflate.eof:
                file.skip(used)
                source = file.peek(1 << 16)
                used = len(source)
                if not source:
                    raise ValueError("an archive ends within a record")
                body.append(inflate.decompress(source))
            file.skip(used - len(inflate.unused_data))
            if take:
                yield headers, b"".join(body)[: int(headers["content-length"])] if payloads else None
        elif start in (b"\r\n", b"\n"):
            file.skip(len(start))
        else:
            span = HEAD
            while b"\r\n\r\n" not in (ahead := file.peek(span)):
                if len(ahead) < span:
                    raise ValueError("a record's headers don't end")
                span *= 2
            raw = ahead.partition(b"\r\n\r\n")[0]
            headers = parse_headers(raw)
            file.skip(len(raw) + 4)
            length, take = int(headers["content-length"]), wanted(headers)
            block = file.take(length) if take and payloads else file.skip(length)
            if take:
                yield headers, block


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.target = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 8 << 20)))
        self.filters: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and (header := PUSHED.get(f.attribute[0])):
                self.filters.append((header, frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        system, folder = file_system(self.target)
        found = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if i.is_file and (i.base_name.endswith((".warc", ".warc.gz")) and not i.base_name.startswith("."))]
        out, own, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if own and size + i.size > self.bytes:
                out.append(Archives(own))
                own, size = [], 0
            own.append(i.path)
            size += i.size
        return [*out, Archives(own)]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system = file_system(self.target)[0]
        wanted = lambda h: all(_value(h, k) in v for k, v in self.filters)
        for path in partition.files:
            with system.open_input_file(path) as stream:
                for h, block in read_records(_File(stream), wanted, self.payloads):
                    http, payload = None, None
                    if block is not None and h.get("content-type", "").startswith("application/http"):
                        head, found, payload = block.partition(b"\r\n\r\n")
                        for line in head.split(b"\r\n")[1:]:
                            k, _, v = line.partition(b":")
                            if k.strip().lower() == b"content-length":
                                http = int(v)
                        if not found or h.get("warc-type") == "revisit":
                            payload = None
                    elif block is not None:
                        payload = block
                    digest = _value(h, "warc-payload-digest")
                    if self.verify and payload is not None and digest and digest_of(payload) != digest:
                        raise ValueError(f"{path}: the payload of {h.get('warc-record-id')} isn't what its digest says")
                    yield (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), digest, int(h["content-length"]), http, payload)


def _value(headers: dict[str, str], name: str) -> str | None:
    """A header's value as the column has it: digests without the algorithm's name."""
    v = headers.get(name)
    return v.partition(":")[2] or v if v and name == "warc-payload-digest" else v


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder). Options: payload (false: headers alone), verify, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def page_of(urn_col: str):
    return F.regexp_extract(urn_col, r"^<urn:tessella:page:(.*)>$", 1)


def round_trip(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes df to archives in the shared folder and gives what is read back: id_col, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    target = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(df, target, id_col, uri_col, payload_col, least_bytes)
    kind = df.schema[id_col].dataType
    back = read_archives(spark, target, verify="true").where(F.col("record_type").isin("response", "revisit"))
    id_of = lambda c: F.when(page_of(c) != "None", page_of(c)).cast(kind)
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("http_length")).cast("long")
    return back.select(id_of("record_id").alias(id_col), size.alias("payload_bytes"), "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))
