"""Web archives (WARC 1.1) compressed with Zstandard: one frame per record, a dictionary in a leading skippable frame.

``write`` gives each task its own archives, closed at a bounded size, in a folder that all executors reach, and
returns a table of the archives that finished tasks have written. A retried task writes new files; only listed
archives are read, so nothing counts twice. ``read`` opens every listed archive as a stream: it loads the
dictionary from the leading skippable frame, decodes one frame after the other into one record each, and validates
version line, header fields, lengths and digests. Payloads that come again are written as revisits.

Defined cases: a null payload is empty; a null key is the smallest; rows that repeat key and payload are each
written, all of the group's largest key as responses; line breaks and other control characters in a URL are escaped
in its header; an empty table gives no archives and no records; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import slices, stored
from tabloom.session import scratch_path

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: An archive is closed after this many bytes of records.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on at most this many bytes of an archive's first records.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
CHUNK = 128 << 10

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()), T.StructField("number", T.IntegerType()),
        T.StructField("record_key", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()), T.StructField("refers_to_key", T.StringType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def marked(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """key, url, payload (binary) and the key of the response that holds the payload (null: this is a response)."""
    whole = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), "url", whole.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1").select(F.col("sha").alias("group_sha"), "first")
    joined = rows.join(groups, rows["sha"] == groups["group_sha"], "left")
    other = F.col("group_sha").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select(
        F.col("key").cast("string").alias("key"), "url", "payload", other.alias("revisit"),
        F.when(other, F.col("first").cast("string")).alias("first"),
    )


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One record as bytes; a revisit carries the digest of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(key)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_name(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def _name(key: str | None) -> str:
    return "urn:x-none:" if key is None else "urn:x-key:" + quote(key, safe="")


def _key(name: str) -> str | None:
    bare = name.strip("<>")
    return unquote(bare.removeprefix("urn:x-key:")) if bare.startswith("urn:x-key:") else None


class Archive:
    """One archive being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        self.held, self.size, self.records, self.out, self.packer = [], 0, 0, None, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.out is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.packer.compress(data))

    def _open(self) -> None:
        import zstandard

        system, path = _file(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [h[:8192] for h in self.held])
        except zstandard.ZstdError:  # too little to train on: an archive without dictionary is valid
            trained = None
        if trained:
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for data in self.held:
            self.out.write(self.packer.compress(data))
        self.held = []

    def close(self) -> dict:
        if self.out is None:
            self._open()
        self.out.close()
        return {"archive": self.uri, "records": self.records, "bytes": self.size}


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``rows`` (from ``marked``); the stored table of them: archive, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for part in slices(iter([batch]), "payload"):
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("key", "url", "payload", "first", "revisit")]
                for key, url, payload, first, revisit in zip(*columns, strict=True):
                    archive = archive or Archive(folder)
                    archive.add(record(key, url, payload, first, revisit, date))
                    if archive.size >= archive_bytes:
                        yield pa.RecordBatch.from_pylist([archive.close()])
                        archive = None
        if archive:
            yield pa.RecordBatch.from_pylist([archive.close()])

    return stored(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


# --- reading ----------------------------------------------------------------------------------------------------------


def frames(stream, where: str) -> Iterator[bytes]:
    """The content of each frame; the dictionary of a leading skippable frame is used for all that follow."""
    import zstandard

    data, dictionary, first = b"", None, True

    def need(n: int) -> bool:
        nonlocal data
        while len(data) < n:
            more = stream.read(max(CHUNK, n - len(data)))
            if not more:
                return False
            data += more
        return True

    while need(1):
        if not need(4):
            raise ValueError(f"{where}: the archive ends inside a frame's magic number")
        magic = int.from_bytes(data[:4], "little")
        if magic in SKIPPABLE:
            if not need(8):
                raise ValueError(f"{where}: the archive ends inside a skippable frame")
            size = int.from_bytes(data[4:8], "little")
            if not need(8 + size):
                raise ValueError(f"{where}: the archive ends inside a skippable frame")
            content, data = data[8 : 8 + size], data[8 + size :]
            if first and magic == SKIPPABLE_DICTIONARY:
                if content[:4] == FRAME.to_bytes(4, "little"):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
        elif magic == FRAME:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            out = []
            while True:
                try:
                    out.append(decoder.decompress(data))
                except zstandard.ZstdError as error:
                    raise ValueError(f"{where}: a frame cannot be decoded: {error}") from error
                data = decoder.unused_data if decoder.eof else b""
                if decoder.eof:
                    break
                if not need(1):
                    raise ValueError(f"{where}: the archive ends inside a frame")
            yield b"".join(out)
        else:
            raise ValueError(f"{where}: {magic:#x} is no frame")
        first = False


def parsed(data: bytes, where: str) -> dict:
    """A record's fields, after its version line, header fields, lengths and digests have been validated."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"{where}: no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{where}: bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if not fields.get(name.lower()):
            raise ValueError(f"{where}: {name} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError(f"{where}: bad Content-Length {fields['content-length']!r}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block, kind = rest[:size], fields["warc-type"]
    stated = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if stated and stated != digest_of(block):
        raise ValueError(f"{where}: the block digest differs")
    payload, stated = None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise ValueError(f"{where}: the block holds no HTTP response")
        if stated and stated != digest_of(payload):
            raise ValueError(f"{where}: the payload digest differs")
        stated = stated or digest_of(payload)
    refers = fields.get("warc-refers-to")
    return {
        "record_key": _key(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to_key": _key(refers) if refers else None, "payload_digest": stated,
        "payload_bytes": None if payload is None else len(payload), "payload": payload,
    }


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in column ``archive``. A damaged archive fails with its name and place."""
    fields = [f for f in RECORD.fields if payloads or f.name != "payload"]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _file(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for number, data in enumerate(frames(stream, uri)):
                        rows.append(parsed(data, f"{uri}, record {number}") | {"archive": uri, "number": number})
                        held += len(data) if payloads else 500
                        if held > 4 << 20:
                            yield _rows(rows, fields)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, fields)

    count = archives.count()
    width = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select("archive").repartition(max(1, min(count, width * 4)), "archive")
    return spread.mapInArrow(run, schema)


def _rows(rows: list[dict], fields: list[T.StructField]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrays = [pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])


def resolved(records: DataFrame) -> DataFrame:
    """Stored records with ``payload_bytes`` of each revisit taken from the response that it refers to."""
    full = records.filter("record_type = 'response'").groupBy(
        F.col("record_key").alias("full_key"), F.col("payload_digest").alias("full_digest")
    ).agg(F.max("payload_bytes").alias("full_bytes"))
    same = records["refers_to_key"].eqNullSafe(full["full_key"]) & (records["payload_digest"] == full["full_digest"])
    revisits = records.filter("record_type = 'revisit'").join(full, same, "left")
    revisits = revisits.withColumn("payload_bytes", F.col("full_bytes")).select(*records.columns)
    return records.filter("record_type <> 'revisit'").unionByName(revisits)


def archived(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Every page written to archives and read back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write(marked(pages, key, payload, least_bytes), folder)
    return resolved(stored(read(archives, payloads=False), "warc-records"))
