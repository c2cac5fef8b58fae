"""WARC files: a deterministic sharded writer, and a reader.

Records are sorted by id into shards of about equal bytes, cut at ids that the data alone
decide. A task writes its shard into files that roll at a compressed size, each under a name of
its attempt, and renames a finished file to its final name. The manifest, a table
that Spark commits as a whole, lists what counts; a file outside it does not exist for the
reader. Equal input gives equal bytes, so a repeated attempt replaces a file by itself.
Every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.operators.grouping import Stretches
from lidarlake.session import stage

#: Payload bytes of a shard, and compressed bytes at which a file is rolled.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lidarlake:warc")
_MANIFEST = "file string, records long, bytes long, sha1 string"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, copy: int = 0) -> str:
    """The record id of a page; rows that repeat one page get ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{copy}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member, the same bytes at any time."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_record(page: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response with the same one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
        ]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    return _record(fields, head.encode() if revisit else head.encode() + payload)


class _Roller:
    """Files of one shard: written under the attempt's name, renamed when full."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.store, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number = shard, roll, 0
        self.attempt = uuid.uuid4().hex
        self.done: list[tuple] = []
        self.out = None

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:06d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary/{self.attempt}/{self.name}"
        self.store.create_dir(f"{self.folder}/_temporary/{self.attempt}", recursive=True)
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha1()
        note = b"software: lidarlake\r\nformat: WARC File Format 1.1\r\n"
        fields = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"),
            ("WARC-Date", DATE),
            ("WARC-Filename", self.name),
            ("Content-Type", "application/warc-fields"),
        ]
        self._put(_record(fields, note))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        if self.out is not None and self.size + len(data) > self.roll and self.records:
            self.close()
        if self.out is None:
            self._open()
        self._put(data)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        self.store.delete_dir(f"{self.folder}/_temporary/{self.attempt}")
        self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
        self.number += 1


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(roller: _Roller) -> pa.RecordBatch:
            roller.close()
            columns = list(zip(*roller.done)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file", "records", "bytes", "sha1"]
            )

        roller = None
        page, copy, keepers, answered = None, 0, {}, set()
        for batch in batches:
            for row in batch.to_pylist():
                if roller is None or roller.shard != row["shard"]:
                    if roller:
                        yield finished(roller)
                    roller = _Roller(folder, row["shard"], roll)
                    page, copy, keepers, answered = None, 0, {}, set()
                if row["page_id"] != page:
                    page, copy, keepers, answered = row["page_id"], 0, {}, set()
                if row["keeper_of"] is not None:  # sorted before the pages of this id
                    keepers[row["keeper_of"]] = row["keeper"]
                    continue
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                of = hashlib.sha1(payload).hexdigest()
                revisit = of in keepers and (keepers[of] != page or of in answered)
                answered.add(of)
                roller.add(page_record(page, copy, row["url"], payload, keepers.get(of), revisit))
                copy += 1
        if roller:
            yield finished(roller)

    return run


def _stretches(pages: DataFrame, shard_bytes: int) -> tuple[Stretches, Column]:
    """Stretches of the ids of about ``shard_bytes`` each, however the ids are spread, and the place of a row."""
    least = pages.agg(F.min("page_id")).first()[0] or 0
    place = F.coalesce("page_id", F.lit(least))
    weight = F.octet_length(F.coalesce("html", F.lit(""))) + 500
    # Looked at several times; the payloads are not.
    sizes = stage(pages.groupBy(place.alias("_at")).agg(F.sum(weight).alias("_n")), "warc-sizes")
    whole = sizes.agg(F.sum("_n")).first()[0] or 0
    return Stretches(sizes, max(1, math.ceil(whole / shard_bytes))), place


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as WARC files below ``folder`` and return the manifest.

    Of equal payloads of at least ``least_bytes`` bytes, the one of the largest page_id is the
    response and the others are revisits; shorter ones are all responses. A null html is an
    empty payload. Rows without page_id come first; among equal payloads they revisit,
    unless all lack an id: then each is a response. Rows that repeat the response's id are
    revisits of its first copy. An empty table gives an empty manifest. Other
    columns are ignored. ``folder`` is a URI that every executor reaches, in a store that
    Arrow can write to.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    narrow = pages.select("page_id", F.sha1(payload).alias("keeper_of"), F.octet_length(payload).alias("n")).where(
        F.col("n") >= least_bytes
    )
    groups = (
        narrow.groupBy("keeper_of")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and keeper is not null")
        .drop("copies")
    )
    keepers = narrow.select("page_id", "keeper_of").distinct().join(groups, "keeper_of")
    stretches, place = _stretches(pages, shard_bytes)
    both = pages.select(
        "page_id", "url", "html", F.lit(None).cast("string").alias("keeper_of"), F.lit(None).cast("long").alias("keeper")
    ).unionByName(
        keepers.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "keeper_of", "keeper")
    )
    # All rows of an id stay together: the first of them answers for the others.
    dealt = (
        stretches.send(both.withColumn("_at", place), F.lit(0))
        .withColumnRenamed("_part", "shard")
        .drop("_at")
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), F.col("keeper_of").isNull(), "url", "html")
    )
    listed = dealt.mapInArrow(_writer(folder, roll_bytes), _MANIFEST)
    listed.write.parquet(f"{folder}/manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if parts:
                raise ValueError("the file ends inside a record")
            return
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            data = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


_READ = (
    "file string, record_id string, record_type string, page_id long, url string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, intact boolean"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest, warcinfo left out.

    ``payload_bytes`` and ``payload_digest`` describe the full payload, for revisits too;
    ``payload`` is null for these, and for all if ``payloads`` is false. ``intact`` says
    that block and payload have the digests of their headers.
    """
    manifest = read_manifest(spark, folder)
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _READ.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        kinds = [kinds[c.split(" ")[1]] for c in _READ.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x[15:]) for x in head.decode().split("\r\n") if x.startswith("Content-Length:"))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        intact = fields["WARC-Block-Digest"] == f"sha1:{_digest(block)}"
                        if kind == "response":
                            intact = intact and len(payload) == size and digest == _digest(payload)
                        number = lambda key: int(fields[key]) if key in fields else None
                        rows.append((
                            file, fields["WARC-Record-ID"], kind, number("X-Page-ID"), fields["WARC-Target-URI"], size,
                            digest, number("X-Refers-To-Page-ID"),
                            payload if payloads and kind == "response" else None, intact,
                        ))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
        yield packed(rows)

    return manifest.select("file").repartition(files, "file").mapInArrow(run, _READ)
