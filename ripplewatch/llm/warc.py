"""WARC archives of captured pages: writing with revisit records, reading, and assembly into captures.

A capture is three records: the request, the response (or a revisit, if the payload is already archived) and metadata.
Request and metadata name the response in ``WARC-Concurrent-To``; a revisit names the response that holds its payload
in ``WARC-Refers-To``. Reading parses records wherever they stand and brings those of a capture together by these
identifiers, so captures may be spread over files.

Which page is the response of a payload is decided on digests, never on the payloads themselves, so a payload that a
third of all pages share costs no more than any other.
"""

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.common import shared_folder, stored

LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "capture")


def with_first(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``first``: the page whose response holds the payload.

    ``first`` is null for a page that is itself a response: payloads under ``least`` bytes, and the smallest page_id
    of equal payloads (with all rows of that id).
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    firsts = keyed.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    later = keyed.join(firsts, "digest").filter("page_id > first or page_id is null and first is not null")
    later = later.select("page_id", "digest", "first").distinct()
    pages = pages.withColumn("digest", F.sha2("html", 256))
    same = pages["page_id"].eqNullSafe(later["page_id"]) & (pages["digest"] == later["digest"])
    return pages.join(later, same, "left").select(pages["page_id"], "url", "html", pages["digest"], "first")


def record_id(page_id, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{kind}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # one gzip member for each record
    return packer.compress(raw) + packer.flush()


def _header_safe(url: str | None) -> str | None:
    """A URL without characters that would end a header line; reading turns them back."""
    return None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header_back(url: str | None) -> str | None:
    return None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def capture_records(page_id, url, html: str, digest: str, first) -> bytes:
    """The three records of a page, each its own gzip member."""
    payload, uri = html.encode("utf-8", "surrogatepass"), _header_safe(url)
    own = record_id(page_id, digest, "response")
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    about = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id(page_id, digest, "request")), ("WARC-Concurrent-To", own)]
    out = _record([*request, *common, ("Content-Type", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    head = [("WARC-Record-ID", own), *common, *about]
    if first is None:
        out += _record([("WARC-Type", "response"), *head], status + payload)
    else:
        held = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(int(first), digest, "response"))]
        out += _record([("WARC-Type", "revisit"), *head, *held], status)
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(page_id, digest, "metadata")), ("WARC-Concurrent-To", own)]
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return out + _record([*meta, *common, ("Content-Type", "application/warc-fields")], fields)


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``.warc.gz`` files of about ``file_bytes`` to ``folder``; returns the stored list of them (uri, pages).

    A null html is an empty payload, a null url leaves the header out, a null page_id the metadata field. Repeated rows
    give repeated records; an empty table gives no files. Other columns are ignored.
    """
    spark = pages.sparkSession

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
        done, out, size, count = [], None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    file = f"{name}-{len(done):04d}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{root}/{file}", compression=None), 0, 0
                raw = capture_records(*row)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{file}", count)], None
        if out:
            out.close()
            done.append((f"{folder}/{file}", count))
        if done:
            uris, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uris), pa.array(counts, pa.int64())], names=["uri", "pages"])

    files = with_first(pages, least).mapInArrow(write, "uri string, pages long")
    files.write.parquet(f"{folder}/list")
    return spark.read.schema(files.schema).parquet(f"{folder}/list")


def parse(stream):
    """(headers, block) of every record in a stream of WARC bytes."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


_RECORD = (
    "capture string, type string, record_id string, refers_to string, url string, payload_bytes long, "
    "payload_digest string, page_id long, payload binary"
)


def read_records(files: DataFrame, *, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives that ``files`` (uri) lists; the payload only where it is asked for.

    ``capture`` is the response's identifier: a record's own, or the one it is concurrent to. Size and digest of a
    response are those of the payload as read; a revisit's size is what its HTTP header says.
    """
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(uri):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for h, block in parse(stream):
                kind, own, size, digest, page, payload = h["warc-type"], h["warc-record-id"], None, None, None, None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h.get("warc-payload-digest", "").partition(":")[2] or None
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        said = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size, payload = int(said[0].split(b":")[1]) if said else None, None
                elif kind == "metadata":
                    said = [x for x in block.split(b"\r\n") if x.startswith(b"page-id:")]
                    page = int(said[0].split(b":")[1]) if said else None
                url = _header_back(h.get("warc-target-uri"))
                yield (
                    h.get("warc-concurrent-to", own), kind, own, h.get("warc-refers-to"), url, size, digest, page,
                    payload if payloads else None,
                )

    def packed(held):
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held = []
                for row in rows(uri):
                    held.append(row)
                    if len(held) >= (64 if payloads else 4096):
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    # A fixed number of tasks: the rows are tiny, the files behind them are not.
    tasks = max(1, min(files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.select("uri").repartition(tasks, "uri").mapInArrow(run, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``response``, ``request`` and ``metadata`` structs, and ``refers_to`` as page.

    Records meet by the identifier they are concurrent to; a capture without request or metadata has null there. Of
    repeated records with one identifier, as repeated input rows leave, each response keeps its own row.
    """
    answer = records.filter(F.col("type").isin("response", "revisit"))
    answer = answer.select(
        "capture",
        F.struct("record_id", "type", "url", "payload_bytes", "payload_digest", "payload", "refers_to").alias("response"),
    )
    request = records.filter("type = 'request'").groupBy("capture").agg(F.first(F.struct("record_id", "url")).alias("request"))
    metadata = records.filter("type = 'metadata'").groupBy("capture").agg(F.first(F.struct("record_id", "page_id")).alias("metadata"))
    nested = answer.join(request, "capture", "left").join(metadata, "capture", "left")
    held = metadata.select(F.col("capture").alias("held"), F.col("metadata.page_id").alias("refers_to"))
    # Most captures refer to nothing: keys of their own, which no capture has, keep them from meeting under one null.
    nested = nested.withColumn("sought", F.coalesce("response.refers_to", F.concat(F.lit("alone:"), "capture")))
    return nested.join(held, nested["sought"] == held["held"], "left").drop("held", "sought")


def archived(pages: DataFrame, *, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble the captures."""
    folder = shared_folder(pages.sparkSession, "archives")
    records = stored(read_records(write_archives(pages, folder, least=least)), "records")  # headers and digests only
    return captures(records)
