"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is a row of ``headers`` (its named fields) and ``block`` (its bytes). Every response
gives a metadata record, with the HTTP status and headers of the source and its outlinks, and a
conversion record with the text of its page. Both refer to the response, name each other, and
carry its target, date, payload digest and their own block digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm.html_extraction import read_page

RECORD = "headers map<string,string>, block binary"
VERSION = b"WARC/1.1\r\n"
#: Stands in where a source has no date.
NO_DATE = "1970-01-01T00:00:00Z"
_BREAKS = re.compile(r"[\x00-\x20\x7f]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An identifier that reruns agree on."""
    name = "\x1f".join("" if p is None else str(p) for p in parts)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _field(value: object) -> str:
    """A header value on one line."""
    return _BREAKS.sub(" ", str(value)).strip()


# The named fields of the format. Names are told apart without regard to case, and
# stand in a record's map as they are spelled here; of these one may repeat.
FIELDS = (
    "WARC-Type WARC-Record-ID WARC-Date Content-Length Content-Type WARC-Concurrent-To WARC-Block-Digest "
    "WARC-Payload-Digest WARC-IP-Address WARC-Refers-To WARC-Refers-To-Target-URI WARC-Refers-To-Date "
    "WARC-Source-Payload-Digest WARC-Target-URI WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile "
    "WARC-Identified-Payload-Type WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length"
).split()
_FIELDS = {name.lower(): name for name in FIELDS}
REPEATS = "WARC-Concurrent-To"
_BETWEEN = ", "


def written(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a file."""
    fields = "".join(
        f"{k}: {one}\r\n"
        for k, v in headers.items()
        if k != "Content-Length"
        for one in (v.split(_BETWEEN) if k == REPEATS else [v])
    )
    return VERSION + f"{fields}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records_of(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file that is given line by line, with the line ends; one is held at a time.

    Names of fields have the case of ``FIELDS``, others stay as written. A repeated field keeps all its
    values, parted by a comma and a space. A record cut short, one without a length, or anything
    else where a record should begin, raises. No lines give no records.
    """
    rest = iter(lines)
    while (line := next(rest, None)) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := next(rest, b"")).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:  # a folded line
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = _FIELDS.get(name.strip().lower(), name.strip())
            headers[name] = _BETWEEN.join([*([headers[name]] if name in headers else []), value.strip()])
        if not headers.get("Content-Length", "").isdecimal():
            raise ValueError(f"record without a length: {headers.get('WARC-Record-ID')}")
        size, parts, found = int(headers["Content-Length"]), [], 0
        while found < size:
            if (line := next(rest, None)) is None:
                raise ValueError(f"record cut short: {headers.get('WARC-Record-ID')}")
            parts.append(line)
            found += len(line)
        block = b"".join(parts)
        if block[size:].strip():  # the next record on the line where this one ends
            rest = chain([block[size:]], rest)
        yield headers, block[:size]


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file's bytes, gzipped (by record or whole) or plain."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    return records_of(stream)


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    return lines[0], pairs, payload if gap else b""


def _body(headers: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content coding; what can't be read stays as it is."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, rest = [], payload
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(rest[:n])
            rest = rest[n + 2 :]
        payload = b"".join(out)
    coding = headers.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            return zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def _outlink(link: str, base: str) -> str:
    try:
        link = urljoin(base, link.strip())
    except ValueError:
        link = link.strip()
    return _BREAKS.sub("%20", link)


def derived(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response."""
    status, pairs, payload = _http(block)
    named = {k.lower(): v for k, v in pairs}
    charset = re.search(r"charset=[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    body = _body(named, payload)
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    source = headers.get("WARC-Record-ID", "")
    target = headers.get("WARC-Target-URI")
    its_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    lines, links = read_page(html, zones=False)
    text = "\n".join(t for t, _ in lines).encode("utf-8", "surrogatepass")
    fields = [("source-status", status), *((f"source-{k.lower()}", v) for k, v in pairs)]
    fields += [("source-block-digest", headers.get("WARC-Block-Digest") or digest(block)), ("conversion", text_id)]
    fields += [("outlink", f"{_outlink(link, target or '')} {how}") for how, link in links]
    meta = "".join(f"{k}: {_field(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")

    def record(kind: str, id_: str, beside: str, type_: str, data: bytes) -> tuple[dict[str, str], bytes]:
        own = {"WARC-Type": kind, "WARC-Record-ID": id_, "WARC-Refers-To": source, "WARC-Concurrent-To": beside}
        if target is not None:
            own["WARC-Target-URI"] = target
        own |= {
            "WARC-Date": headers.get("WARC-Date", NO_DATE), "WARC-Source-Payload-Digest": its_digest,
            "WARC-Block-Digest": digest(data), "Content-Type": type_, "Content-Length": str(len(data)),
        }
        return own, data

    return [
        record("metadata", meta_id, text_id, "application/warc-fields", meta),
        record("conversion", text_id, meta_id, "text/plain; charset=UTF-8", text),
    ]


def response(page_id: object, url: str | None, html: str | None, date: str = NO_DATE) -> tuple[dict[str, str], bytes]:
    """A response record of a page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    its_digest = digest(payload)
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", page_id, url, its_digest)}
    if url is not None:
        headers["WARC-Target-URI"] = _BREAKS.sub("%20", url)
    return headers | {
        "WARC-Date": date, "WARC-Payload-Digest": its_digest, "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }, block


def responses(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and a response record of every page; null pages have an empty payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [response(*row) for row in zip(batch["page_id"], batch["url"], batch["html"])]
            yield pd.DataFrame({"headers": [h for h, _ in rows], "block": [b for _, b in rows]})

    page = F.struct(*(F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")))
    return pages.select(*keep, F.pandas_udf(run, RECORD)(page).alias("_record")).select(*keep, "_record.*")


def derivatives(records: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the two records derived from every response among ``records``.

    Records of other types are passed over. A response without an identifier, target or date
    gives records with an empty refers-to, no target, the stand-in date. Repeated responses
    give repeated records with the same identifiers; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [
                    [{"headers": h, "block": b} for h, b in derived(dict(headers), block or b"")]
                    for headers, block in zip(batch["headers"], batch["block"])
                ]
            )

    found = records.where(F.lower(F.col("headers")["WARC-Type"]) == "response")
    pair = F.pandas_udf(run, f"array<struct<{RECORD.replace(' ', ':', 1).replace('block ', 'block:')}>>")
    return found.select(*keep, F.explode(pair(F.struct("headers", "block"))).alias("_record")).select(*keep, "_record.*")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """``page_id``, the headers and the digest of the record of both derivatives of every page.

    As ``derivatives`` of ``responses``, in one pass over the pages and without their bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                for headers, block in derived(*response(page_id, url, html)):
                    some.append((page_id, headers, hashlib.sha256(written(headers, block)).hexdigest()))
                if len(some) >= 1000:
                    yield pd.DataFrame(some, columns=names)
                    some = []
            yield pd.DataFrame(some, columns=names)

    names = ["page_id", "headers", "record_sha256"]
    rows = pages.select(*(F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")))
    made = rows.mapInPandas(run, "page_id string, headers map<string,string>, record_sha256 string")
    return made.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def as_bytes(records: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``record``, the bytes of every record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([written(dict(h), b or b"") for h, b in zip(batch["headers"], batch["block"])])

    return records.select(*keep, F.pandas_udf(run, "binary")(F.struct("headers", "block")).alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Writes plain WARC files of at most ``per_file`` records each; an empty table gives no records."""
    rows = as_bytes(records, []).select(F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``, plain, or gzipped if their names end in ``.gz``.

    A file is read by one task as a stream of lines, of which it holds one record at a time, so a file
    may be of any size. Files of no bytes have no records; damaged ones raise, as ``records_of``
    says. The session that reads is one of its own, as it must not cut files.
    """
    reader = spark.newSession()
    whole = str(1 << 60)
    for name in ("maxPartitionBytes", "openCostInBytes"):  # a file is a split, and a split a partition
        reader.conf.set(f"spark.sql.files.{name}", whole)
    lines = reader.read.option("lineSep", "\n").text(path)
    rows = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((file, line + b"\n") for b in batches for file, line in zip(*(b.column(c).to_pylist() for c in ("file", "line"))))
        for _, own in groupby(every, key=itemgetter(0)):
            some: list[tuple[list[tuple[str, str]], bytes]] = []
            held = 0
            for headers, block in records_of(line for _, line in own):
                some.append((list(headers.items()), block))
                held += len(block)
                if len(some) == 500 or held > 1 << 24:
                    yield _record_batch(some)
                    some, held = [], 0
            yield _record_batch(some)

    return rows.mapInArrow(run, RECORD)


def _record_batch(records: list[tuple[list[tuple[str, str]], bytes]]) -> pa.RecordBatch:
    headers = pa.array([h for h, _ in records], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([headers, pa.array([b for _, b in records], pa.binary())], names=["headers", "block"])
