"""WARC archives: a Spark text-sink writer and a Python data source that reads them.

Writing: every row becomes one WARC/1.1 record, built with column expressions and
written by Spark's own committer, so retried or lost tasks leave no partial archive.
Records with equal payloads of at least ``revisit_from`` bytes are stored once: the row
with the largest id keeps the payload (``response``), the others are ``revisit`` records
that refer to it.

Reading: ``spark.read.format("warc").load(path)``. One partition is planned for each
file, as a record's place is told by those before it alone; ``.gz`` files of one member a record are read too. Names of
header fields come in any case, and folded lines are joined. In each file only record headers are parsed; ``Content-Length`` leads to the next
record. Filters on ``warc_type``, ``target_uri``, ``record_id``, ``refers_to``,
``payload_digest`` and ``content_length`` are pushed down and decided from the headers, and
the block of a record that fails them is skipped with a seek. So is every payload when
the schema asked for has no ``payload`` column.

Defined cases: null text is an empty payload; a null url becomes an empty target; control
characters and blanks in a url are percent-encoded; a null id never keeps a payload that
another row with an id has; repeated rows with the largest id are all responses; an empty
table gives an archive without records, read back as an empty table.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .common import new_folder

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, content_length long, payload_length long, headers map<string,string>, payload binary"
)
#: Up to so many groups of equal payloads, their digests are broadcast (under 40 MB).
BROADCAST_GROUPS = 400_000


def write_warc(
    df: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    revisit_from: int = 1000,
) -> str:
    """Write one record per row of ``df`` under ``path`` (a new shared folder by default); return the path."""
    path = path or new_folder(df.sparkSession, "warc")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        text.alias("text"),
        F.sha1(text.cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("n"),
    )
    repeated = (
        rows.where(F.col("n") >= revisit_from)
        .groupBy("digest")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("c"))
        .where("c > 1 and keeper is not null")
        .select("digest", "keeper")
        .persist()
    )
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_GROUPS else repeated
    rows = rows.join(repeated, "digest", "left").withColumn("again", F.coalesce(~F.col("keeper").eqNullSafe(F.col("id")), F.lit(False)) & F.col("keeper").isNotNull())
    kept = F.when(F.col("again"), F.lit("")).otherwise(F.col("text"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.octet_length(http) + F.when(F.col("again"), F.lit(0)).otherwise(F.col("n"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("keeper")))),
        F.when(F.col("again"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http, kept)
    rows.select(record.alias("record")).write.option("lineSep", CRLF + CRLF).text(path)
    repeated.unpersist()
    return path


def _urn(page):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def read_warc(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    return (reader.schema(schema) if schema else reader).load(path)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: ``path``, a file or folder that pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(schema, self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, schema, path: str) -> None:
        self.schema, self.path, self.tests = schema, path, []

    def pushFilters(self, filters: list[Filter]):
        known = {"warc_type", "target_uri", "record_id", "refers_to", "payload_digest", "content_length"}
        for f in filters:
            column = getattr(f, "attribute", (None, None))
            if len(column) == 1 and column[0] in known and isinstance(f, EqualTo | In | StringStartsWith | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted(f.path for f in files if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._")
        return [InputPartition(f) for f in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.value:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        payload, rows, held = "payload" in names, [], 0
        with store.open_input_file(partition.value) as plain, (gzip.GzipFile(fileobj=plain) if partition.value.endswith(".gz") else plain) as f:
            for row in records(f, payload, lambda head: all(_holds(t, head) for t in self.tests)):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([_value(r, n) for r in rows], arrow.field(n).type) for n in names], schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([_value(r, n) for r in rows], arrow.field(n).type) for n in names], schema=arrow)


def _value(row: dict, name: str):
    return list(row[name].items()) if name == "headers" else row[name]


def _holds(test: Filter, head: dict) -> bool:
    value = head[test.attribute[0]]
    if value is None:
        return False
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    kinds = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
    return kinds[type(test)](value, test.value)


def header_fields(lines: list[str]) -> dict[str, str]:
    """Header lines by name in title case; a line that begins with a blank goes on with the one before it."""
    fields: list[list[str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            fields.append([TITLES.get(name.strip().lower(), name.strip()), value.strip()])
    return dict(fields)


#: The names of the format's header fields, which may come in any case.
TITLES = {
    x.lower(): x
    for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Profile", "WARC-Concurrent-To", "Content-Type", "Content-Length")
}


#: A record's header is shorter than this, or the file is no WARC file.
HEADER_BYTES = 1 << 20


def records(f, payload: bool, wanted, step: int = 1 << 16) -> Iterator[dict]:
    """The records of an open file whose header passes ``wanted``; other blocks are skipped by their length.

    A header without a length, an identifier or a type raises, and so does one of more than ``HEADER_BYTES``. Files of gzip members are read through, as
    they have no other order.
    """
    at, data = 0, b""  # what is read already begins at the record, and the file goes on after it
    while True:
        data = data or f.read(step)
        blank = len(data) - len(data.lstrip(b"\r\n"))  # more line ends than two may part records
        if blank == len(data):
            if not data:
                return
            at, data = at + blank, b""
            continue
        at, data = at + blank, data[blank:]
        seen = 0
        while (end := data.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(data) - 3)
            more = f.read(step) if seen < HEADER_BYTES else b""
            if not more:
                raise ValueError(f"a WARC header does not end, at byte {at}")
            data += more
        lines = data[:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        heads = header_fields(lines[1:])
        if missing := {"Content-Length", "WARC-Type", "WARC-Record-ID"} - heads.keys():
            raise ValueError(f"a WARC header without {', '.join(sorted(missing))}, at byte {at}")
        length, start = int(heads["Content-Length"]), end + 4
        row = {
            "warc_type": heads["WARC-Type"],
            "record_id": heads["WARC-Record-ID"],
            "target_uri": heads.get("WARC-Target-URI"),
            "warc_date": heads.get("WARC-Date"),
            "refers_to": heads.get("WARC-Refers-To"),
            "payload_digest": heads.get("WARC-Payload-Digest"),
            "content_length": length,
            "payload_length": length,
            "headers": heads,
            "payload": None,
        }
        if wanted(row):
            web = heads.get("Content-Type", "").lower().startswith("application/http")
            need = length if payload else min(length, step) * web
            if len(data) < start + need:
                data += f.read(start + need - len(data))
            block = data[start : start + length]
            if len(block) < need:
                raise ValueError(f"a WARC block is cut short, at byte {at}")
            if web and (split := block.find(b"\r\n\r\n")) >= 0:
                row["payload_length"] = length - split - 4
                if heads["WARC-Type"] == "revisit":  # the length of what it refers to
                    told = header_fields(block[:split].decode("latin-1").split(CRLF)[1:]).get("Content-Length")
                    row["payload_length"] = int(told) if told else row["payload_length"]
                block = block[split + 4 :]
            if payload:
                row["payload"] = block
            yield row
        at += start + length
        if start + length > len(data):
            f.seek(at)  # never back, which would read a file of gzip members again
        data = data[start + length :]
