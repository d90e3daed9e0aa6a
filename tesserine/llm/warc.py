"""WARC archives: written by Spark's own text writer, read back by a Python data source.

Writing: a record per page, as text with the record separator as line separator, so files are committed by tasks and lie wherever Spark can write. Pages with
equal payloads are found by digest and length, in sums that combine before the shuffle; the html itself is not shuffled where few payloads repeat.

Reading: whole files are planned into partitions of about ``PARTITION`` bytes. The header of a record is parsed first; equality predicates on its columns are taken over
from Spark, and a record that fails one, or whose payload nobody asked for, is skipped by its length without being decoded.

Defined cases: null html is an empty payload; a null url is left out; line breaks in a url are percent-encoded; rows with the same page_id and payload are all
responses if that id is the largest; an empty table writes no records; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tesserine.llm.tables import kept, need
from tesserine.session import scratch_path

PARTITION, READ = 64 << 20, 4 << 20
END = "\r\n\r\n"
#: Columns of a record that come from its header, with their types and fields.
HEADER = {"page_id": ("bigint", "Page-Id"), "record_type": ("string", "WARC-Type"), "record_id": ("string", "WARC-Record-ID"), "url": ("string", "WARC-Target-URI"),
          "payload_bytes": ("bigint", "Page-Payload-Length"), "payload_digest": ("string", "WARC-Payload-Digest"), "refers_to": ("bigint", "Page-Refers-To")}


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: each five digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One response record per page, or a revisit of the page with the largest id that has the same payload of at least ``least_bytes`` bytes."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = need(pages, id_col, url_col, html_col).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    repeated = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(kept(repeated, "payloads"), ["sha1", "size"], "left")  # its size is known when this join is planned
    revisit = F.coalesce(F.col("_first") != F.col("page_id"), F.col("_first").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    rows = rows.withColumns({"http": http, "body": F.when(revisit, "").otherwise(F.col("html")), "revisit": revisit})
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    profile = F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", url), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        field("WARC-Profile", profile), field("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("_first")))), field("Page-Id", F.col("page_id")),
        field("Page-Payload-Length", F.col("size")), field("Page-Refers-To", F.when(F.col("revisit"), F.col("_first"))),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", F.octet_length("http") + F.octet_length("body")), F.lit("\r\n"), F.col("http"), F.col("body"))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


class FilesPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in HEADER:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def files(self):
        from pyarrow import fs

        at = self.path if urlparse(self.path).scheme else f"file://{self.path}"
        store, root = fs.FileSystem.from_uri(at)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return store, [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def partitions(self):
        parts, size = [[]], 0
        for f in sorted(self.files()[1], key=lambda f: f.path):
            if parts[-1] and size + f.size > PARTITION:
                parts, size = [*parts, []], 0
            parts[-1].append(f.path)
            size += f.size
        return [FilesPartition(p) for p in parts]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if urlparse(self.path).scheme else f"file://{self.path}")
        names = [*HEADER, *(["payload"] if self.payload else []), "computed_digest"]
        types = [pa.int64() if HEADER.get(n, ("",))[0] == "bigint" else pa.binary() if n == "payload" else pa.string() for n in names]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, size = [], 0
        for path in partition.files:
            with store.open_input_file(path) as f:
                for row, n in self.records(f):
                    rows.append(row)
                    size += n
                    if size > READ or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    def records(self, f) -> Iterator[tuple[tuple, int]]:
        """(row, bytes held) of each wanted record of one file."""
        buffer, at, place, total = b"", 0, 0, f.size()  # buffer[at:] is what follows; place: where the file is read on

        def more() -> bool:
            nonlocal buffer, at, place
            got = f.read_at(min(READ, total - place), place)
            buffer, at, place = buffer[at:] + got, 0, place + len(got)
            return bool(got)

        while True:
            end = buffer.find(b"\r\n\r\n", at)
            while end < 0 and more():
                end = buffer.find(b"\r\n\r\n", at)
            if end < 0:
                return
            fields = dict(line.split(": ", 1) for line in buffer[at:end].decode().split("\r\n")[1:])
            at = end + 4
            length = int(fields["Content-Length"])
            head = {}
            for name, (kind, field) in HEADER.items():
                value = fields.get(field)
                head[name] = int(value) if value is not None and kind == "bigint" else value
            head["payload_digest"] = head["payload_digest"].removeprefix("sha1:")
            full = head["record_type"] == "response"
            if all(head[name] in values for name, values in self.wanted.items()):
                if full or self.payload:
                    while len(buffer) - at < length and more():
                        pass
                    block = buffer[at:at + length]
                    body = block[block.index(b"\r\n\r\n") + 4:] if full else None
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if full else None
                else:
                    body = digest = None
                yield (*head.values(), *([body] if self.payload else []), digest), len(body or b"")
            at += length + 4  # and the separator
            if at > len(buffer):  # skipped without being read
                buffer, at, place = b"", 0, place + at - len(buffer)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        columns = [f"{n} {t}" for n, (t, _) in HEADER.items()] + ["payload binary"] * self.with_payload + ["computed_digest string"]
        return ", ".join(columns)

    @property
    def with_payload(self) -> bool:
        return self.options.get("payload", "false").lower() == "true"

    def reader(self, schema):
        return WarcReader(self.options["path"], self.with_payload)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``. Each response's digest is computed anew from its payload, in ``computed_digest``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's planning process need not have this package on its path
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to). A payload that does not have its digest is an error."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    rows = read_warc(pages.sparkSession, path)
    digest = F.when((F.col("record_type") == "revisit") | (F.col("computed_digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
