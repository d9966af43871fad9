"""WARC archives (ISO 28500, version 1.1) of pages, written by shards in a fixed order, and read back.

Every record has a place among 40-digit hashes: the SHA-1 of its payload, so that equal payloads stand
together, or a hash of payload, page and address for what needs no neighbours: payloads too short to
be worth a reference, and payloads with very many copies. The first digits of the place choose the shard, so
shards are ranges of nearly equal sizes without sampling, and the same pages give the same shards in
any session. A task sorts one shard and writes it; of equal payloads the first, which has the largest
page_id, is a response and the others are revisits that refer to it. Of a payload with very many
copies (HOT) the pages' numbers are aggregated first: only its response carries the payload, and its
revisits spread over all shards.

Each record is a gzip member of its own. A file ends once its compressed size reaches a limit. Headers,
record ids, block and payload digests are made anew; nothing depends on the time of writing. A file is
written under a name of its attempt, synced, and then renamed to its final name, which a repeated attempt gives
again with the same bytes; the manifest that Spark commits at the end names all files with their
sizes and digests, and reading goes by it, so that an interrupted run leaves nothing that is read.

The folder has to be one that all executors share and pyarrow can open (file://, hdfs://, s3:// ...).

Defined results: a null html is an empty payload; null page_ids come last among equal payloads, so they
refer to a page with a number if there is one (and to none otherwise); pages that repeat are records of
their own, of which one is the response; a null url has no target; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.llm.slices import by_bytes
from forgelens.llm.tables import cut

#: Bytes of a payload from which copies are revisits; compressed bytes at which a file ends; bytes of payloads of a shard, and shards at least.
LEAST_BYTES, ROLL_BYTES, SHARD_BYTES, SHARDS = 1000, 64 << 20, 128 << 20, 32
#: A payload's copies are many if they are more than this part of all pages, or so many bytes together; so few payloads are.
HOT_PART, HOT_BYTES = 500, 256 << 20
READ_BYTES = 1 << 20

MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = ("shard", "place", "digest", "page_id", "url", "html", "payload_bytes", "copies", "kind", "owner", "owner_url")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The same in every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((page_id, url, digest, copy)).encode()).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A gzip member with one record; fields without a value are left out."""
    whole = [("WARC-Block-Digest", _sha1(block)), *fields, ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in whole if v is not None)
    made = zlib.compressobj(6, wbits=31)
    return made.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + made.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, which has to be whole and to have its digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or _sha1(rest[:n]) != fields["WARC-Block-Digest"]:
        raise ValueError(f"a broken record {fields.get('WARC-Record-ID')}")
    return fields, rest[:n]


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    made, out, left = zlib.decompressobj(31), [], b""
    while left or (left := stream.read(READ_BYTES)):
        out.append(made.decompress(left))
        left = made.unused_data if made.eof else b""
        if made.eof:
            yield b"".join(out)
            made, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("a file ends inside a record")


@dataclass
class Files:
    """The files of one shard, one after another."""

    folder: str
    shard: int
    date: str
    roll_bytes: int

    def __post_init__(self):
        self.fs, self.root = fs.FileSystem.from_uri(self.folder)
        self.out, self.number, self.done = None, 0, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.size, self.digest = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz", 0, 0, hashlib.sha256()
            self.temporary = f"{self.root}/_{uuid.uuid4().hex}-{self.name}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            about = f"software: forgelens\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "", 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(record(fields, about))
        self._write(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.end()

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def end(self) -> None:
        """Commits the open file."""
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.digest.hexdigest()))
            self.out, self.number = None, self.number + 1

    def drop(self) -> None:
        """Of a failed attempt."""
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.temporary)
            self.out = None


def _rows(pages: DataFrame, least: int, shards: int) -> DataFrame:
    """What is to be written, with shard and place; a row may stand for several copies of a revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    n, total = given.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    shards = shards or max(SHARDS, -(-total // SHARD_BYTES))
    slim = given.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1("html").alias("digest"))
    many = slim.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.count("*").alias("c"), F.max("page_id").alias("owner"), F.sum("payload_bytes").alias("s"))
    hot = cut(many.filter((F.col("c") > max(1, n // HOT_PART)) | ((F.col("s") > HOT_BYTES) & (F.col("c") > 1))).select("digest", "owner", F.lit(True).alias("hot")))
    marked = slim.join(F.broadcast(hot), "digest", "left")  # HOT_PART rows, and one for each HOT_BYTES of input, at most
    spread = F.sha1(F.concat_ws("/", "digest", F.col("page_id").cast("string"), "url"))
    short = F.col("payload_bytes") < least
    none = F.lit(None)
    cold = marked.filter("hot is null").select(
        F.when(short, spread).otherwise(F.col("digest")).alias("place"), "digest", "page_id", "url", "html", "payload_bytes", F.lit(1).cast("long").alias("copies"),
        F.when(short, "response").alias("kind"), none.cast("long").alias("owner"), none.cast("string").alias("owner_url"),
    )
    warm = marked.filter("hot")
    first = warm.filter(F.col("page_id").eqNullSafe(F.col("owner"))).groupBy("digest", "payload_bytes", "owner").agg(F.max(F.struct("url", "html")).alias("x"))
    first = cut(first.select("digest", "payload_bytes", "owner", "x.url", "x.html"))
    response = first.select(F.col("digest").alias("place"), "digest", F.col("owner").alias("page_id"), "url", "html", "payload_bytes", F.lit(1).cast("long").alias("copies"), F.lit("response").alias("kind"), "owner", F.col("url").alias("owner_url"))
    others = warm.groupBy("digest", "page_id", "url", "payload_bytes", "owner").agg(F.count("*").alias("c")).join(F.broadcast(first.select("digest", F.col("url").alias("owner_url"))), "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("owner")) & F.col("url").eqNullSafe(F.col("owner_url"))
    others = others.withColumn("copies", F.col("c") - is_first.cast("long")).filter("copies > 0")
    revisits = others.select(spread.alias("place"), "digest", "page_id", "url", none.cast("string").alias("html"), "payload_bytes", "copies", F.lit("revisit").alias("kind"), "owner", "owner_url")
    shard = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * shards / F.lit(1 << 32)).cast("int")
    rows = cold.unionByName(response).unionByName(revisits).select(shard.alias("shard"), *_FIELDS[1:])
    return rows.repartitionById(shards, "shard").sortWithinPartitions("place", F.desc_nulls_last("page_id"), F.desc_nulls_last("url"))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES, shards: int = 0) -> None:
    """Archives of all pages and a manifest below path, a folder of their own. date: of all records, since pages have none. shards: 0 for as many as the bytes ask for."""
    folder = f"{path}/archive"
    at, root = fs.FileSystem.from_uri(folder)
    at.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: Files | None = None
        group, last, copy = (None, None, None), None, 0  # digest, page_id and record id of the response; the page before, and how many like it came
        try:
            for b in by_bytes(batches, _FIELDS.index("html")):
                for shard, _, digest, page_id, url, html, size, copies, kind, owner, owner_url in zip(*(c.to_pylist() for c in b.columns)):
                    files = files or Files(folder, shard, date, roll_bytes)
                    # a response of many copies is the first of those like it; its revisits are counted from behind it
                    begin = int(kind == "revisit" and (page_id, url) == (owner, owner_url))
                    copy = copy + 1 if (page_id, url, digest) == last else begin
                    last = page_id, url, digest
                    for i in range(copy, copy + copies):
                        name = record_id(page_id, url, digest, i)
                        if kind:
                            revisit, refers, to = kind == "revisit", owner, record_id(owner, owner_url, digest, 0)
                        else:
                            revisit = group[0] == digest
                            group = group if revisit else (digest, page_id, name)
                            refers, to = group[1:]
                        files.add(_page(page_id, url, digest, size, html, name, date, (refers, to) if revisit else None))
                    copy += copies - 1
            if files:
                files.end()
        except BaseException:
            if files:
                files.drop()
            raise
        columns = list(zip(*files.done)) if files and files.done else [[]] * 5
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "shard", "records", "bytes", "sha256"])

    _rows(pages, least, shards).mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")


def _page(page_id: int | None, url: str | None, digest: str, size: int, html: str | None, name: str, date: str, refers: tuple[int | None, str] | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-Id", page_id),
    ]
    if refers:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", refers[1]), ("X-Refers-To-Page-Id", refers[0])]
    return record(fields, head if refers else head + html.encode())


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each page record of the files that the manifest names; with payload, the html too (null for a revisit).

    Every block and payload is held against its digest, and every file against its size and records.
    """
    folder, schema = f"{path}/archive", RECORDS + (", html string" if payload else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: len(names)]

    def page(fields: dict[str, str], block: bytes) -> tuple:
        head, _, body = block.partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"]
        size = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        if kind == "response" and (len(body) != size or _sha1(body) != digest):
            raise ValueError(f"a broken payload in {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if k in fields else None
        row = number("X-Page-Id"), fields.get("WARC-Target-URI"), size, base64.b32decode(digest.removeprefix("sha1:")).hex(), kind, number("X-Refers-To-Page-Id")
        return (*row, body.decode() if kind == "response" else None)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, records, size in zip(*(c.to_pylist() for c in b.columns)):
                if at.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} isn't as the manifest has it")
                rows, held, seen = [], 0, 0
                with at.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in members(stream):
                        fields, block = parsed(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(page(fields, block))
                        seen, held = seen + 1, held + 500 + len(block) * payload
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} of {records} records")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return files.select("file", "records", "bytes").repartition(max(1, files.count())).mapInArrow(run, schema)
