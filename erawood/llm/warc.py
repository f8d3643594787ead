"""WARC archives: writing, reading, and resolution of repeated payloads to revisit records.

Archives are sequences of gzip members, one for each record, in files of bounded size under a
shared folder. Every task attempt writes files of its own names and reports them in a manifest;
only a manifest that has been stored is read, so what a lost or repeated task left behind is never
seen. Headers, not payloads, are shuffled by payload digest: the first record of a digest is found
with partial aggregation, joined back, and each archive is rewritten in place order with fresh
headers. Reading and rewriting have as many tasks as there are archives, or one for some of them
where there are very many; their number never follows the few bytes of a table of paths.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import discard, scratch_path, shuffle_width, slices, stored_at, table

#: An archive is closed when it has this many bytes.
FILE_BYTES = 32 << 20
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Archives that one task reads, where there are more of them than four tasks a shuffle partition.
ARCHIVES = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a URI that a page lacks, as the header field is mandatory.
_NO_URI = "urn:x-page:no-uri"
_END = b"\r\n\r\n"
_MANIFEST = "path string, offset long, length long"
_HEADER = (
    "path string, offset long, length long, record_id string, date string, page_id long, uri string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_urn(path: str, offset: int, made: str = "written") -> str:
    """The id of a record by the place where it first was; archives have names of their own, so it is unique."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{made}:{path}@{offset}')}>"


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def record(record_id: str, date: str, info: str, page_id: int | None, uri: str | None, payload: bytes | None, digest: str, size: int, original: dict | None = None) -> bytes:
    """A response with its payload, or, with ``original``, a revisit with the HTTP header alone.

    ``original`` has the page_id, path, offset, uri and date of the response that it refers to;
    ``info`` is the id of the archive's warcinfo record.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if original is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(uri or '') or _NO_URI}",
        f"WARC-Warcinfo-ID: {info}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if uri is not None and not _clean(uri):
        head.append("Page-URI: empty")
    if original is not None:
        head += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: {record_urn(original['path'], original['offset'], 'deduplicated')}",
            f"WARC-Refers-To-Target-URI: {_clean(original['uri'] or '') or _NO_URI}",
            f"WARC-Refers-To-Date: {original['date']}",
            f"Refers-To-Page: {original['page_id']}",
        ]
    return "\r\n".join(head).encode() + _END + block + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, by names in lower case, and its block."""
    head, _, rest = raw.partition(_END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def members(stream, block: int = 1 << 20):
    """Offset, length and content of each gzip member of a stream, one in memory at a time."""
    offset, data = 0, b""
    while True:
        if not data and not (data := stream.read(block)):
            return
        machine, out, used = zlib.decompressobj(31), [], 0
        while not machine.eof:
            if not data and not (data := stream.read(block)):
                raise ValueError("an archive is cut short")
            out.append(machine.decompress(data))
            used += len(data) - len(machine.unused_data)
            data = machine.unused_data
        yield offset, used, b"".join(out)
        offset += used


class _Writer:
    """Rolling archives of one task attempt."""

    def __init__(self, folder: str):
        self.folder, self.stream, self.path, self.at, self.info = folder, None, "", 0, ""

    def write(self, record_id: str | None = None, **about) -> tuple[str, int, int]:
        """Writes a record, with an id by its place if it has none; returns where it lies."""
        if self.stream is None or self.at >= FILE_BYTES:
            self.close()
            self._start()
        return self.path, *self._put(record(record_id or record_urn(self.path, self.at), info=self.info, **about))

    def _start(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
        system, name = _open(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = system.open_output_stream(name, compression=None), 0
        self.info = record_urn(self.path, 0)
        about = b"software: erawood\r\nformat: WARC File Format 1.1\r\n"
        head = [
            "WARC/1.1",
            "WARC-Type: warcinfo",
            f"WARC-Record-ID: {self.info}",
            f"WARC-Date: {now()}",
            f"WARC-Filename: {self.path.rsplit('/', 1)[1]}",
            "Content-Type: application/warc-fields",
            f"Content-Length: {len(about)}",
        ]
        self._put("\r\n".join(head).encode() + _END + about + _END)

    def _put(self, raw: bytes) -> tuple[int, int]:
        machine = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = machine.compress(raw) + machine.flush()
        self.stream.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(pages: DataFrame, folder: str, manifest: str, date: str | None = None) -> DataFrame:
    """Writes a response for each row ``(page_id, url, html)``; returns the manifest, stored at ``manifest``.

    ``date`` is the time of capture; now, if none is given. Null html is an empty payload. Line
    breaks in a url are left out of its header.
    """
    date = date or now()

    def run(batches):
        writer = _Writer(folder)
        try:
            for part in slices(batches, "html"):
                rows = []
                for page, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").fill_null("").cast(pa.binary()).to_pylist()):
                    rows.append(writer.write(date=date, page_id=page, uri=url, payload=html, digest=hashlib.sha256(html).hexdigest(), size=len(html)))
                yield _batch(rows, _MANIFEST)
        finally:
            writer.close()

    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored_at(texts.mapInArrow(run, _MANIFEST), manifest)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _number(text: str) -> int | None:
    return int(text) if text else None


def _tasks(spark: SparkSession, archives: int) -> int:
    return max(1, min(archives, max(4 * shuffle_width(spark), -(-archives // ARCHIVES))))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Headers of all records of a manifest's archives; sizes and digests are taken from the payloads.

    A revisit has the size and the digest that its header states.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _open(path)
                rows = []
                with system.open_input_stream(name, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        fields, block = parse(raw)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(_END)
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        else:
                            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        uri = fields["warc-target-uri"]
                        if uri == _NO_URI:
                            uri = "" if fields.get("page-uri") == "empty" else None
                        page, refers = _number(fields.get("page-id", "")), _number(fields.get("refers-to-page", ""))
                        rows.append((path, offset, length, fields["warc-record-id"], fields["warc-date"], page, uri, kind, size, digest, refers))
                        if len(rows) >= 4096:
                            yield _batch(rows, _HEADER)
                            rows = []
                yield _batch(rows, _HEADER)

    paths = manifest.select("path").distinct()
    return paths.repartition(_tasks(manifest.sparkSession, paths.count())).mapInArrow(run, _HEADER)


def resolve(headers: DataFrame) -> DataFrame:
    """``headers`` with ``record_type``, ``refers_to`` and ``original`` decided by payload digest.

    ``original`` is the record of the smallest page_id that has the payload; of rows that repeat
    this page_id, the first by archive and place.
    """
    about = F.struct("page_id", "path", "offset", "uri", "date")
    first = headers.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(about).alias("first"))
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False))
    return headers.drop("record_type", "refers_to").join(first, "payload_digest", "left").select(
        "path", "offset", "length", "date", "page_id", "uri",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "payload_bytes", "payload_digest", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first")).alias("original"),
    )


def write_deduplicated(decided: DataFrame, folder: str, manifest: str, archives: int) -> DataFrame:
    """Rewrites the ``archives`` that ``decided`` names with fresh headers; returns the stored manifest.

    A record keeps its time of capture and gets a new id, which follows from its place in the
    archive that is read, so that a revisit can name its original's.
    """

    def run(batches):
        writer, opened, stream = _Writer(folder), "", None
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload = None
                    if r["record_type"] == "response":
                        if r["path"] != opened:
                            if stream is not None:
                                stream.close()
                            system, name = _open(r["path"])
                            stream, opened = system.open_input_file(name), r["path"]
                        stream.seek(r["offset"])
                        _, block = parse(zlib.decompress(stream.read(r["length"]), 31))
                        payload = block.partition(_END)[2]
                    rows.append(writer.write(record_urn(r["path"], r["offset"], "deduplicated"), date=r["date"], page_id=r["page_id"], uri=r["uri"], payload=payload, digest=r["payload_digest"], size=r["payload_bytes"], original=r["original"]))
                yield _batch(rows, _MANIFEST)
        finally:
            writer.close()
            if stream is not None:
                stream.close()

    dealt = decided.repartition(2 * _tasks(decided.sparkSession, archives), "path").sortWithinPartitions("path", "offset")
    return stored_at(dealt.mapInArrow(run, _MANIFEST), manifest)


def deduplicate(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives ``pages``, resolves repeats, writes deduplicated archives and reads these back.

    ``folder`` must be a place that all executors share; if none is given, the session's scratch
    folder is used and the archives before deduplication are deleted in the end. A null html is an
    empty payload, of any length it is held one record at a time; a null or empty url comes back as
    it was. Rows that repeat a page_id with an equal payload are all responses if it is the
    smallest, else all revisits; a null page_id never is the original. Other columns of ``pages``
    are not read. An empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    base = folder or scratch_path(spark, "warc")
    held = [scratch_path(spark, x) for x in ("manifest", "headers", "manifest")]
    manifest = write_archives(pages, f"{base}/raw", held[0])
    headers = stored_at(read_archives(manifest), held[1])
    archives = manifest.select("path").distinct().count()
    out = read_archives(write_deduplicated(resolve(headers), f"{base}/deduplicated", held[2], archives))
    for path in held[:2] + ([] if folder else [f"{base}/raw"]):
        discard(spark, path)
    return out


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint payload_bytes,
                  sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) f from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when f is not null and f <> page_id then 'revisit' else 'response' end record_type,
       case when f <> page_id then f end refers_to
from p left join f using (payload_digest)
"""
