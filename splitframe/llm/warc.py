"""WARC archives of Zstandard frames that share an embedded dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir

# Frame magics, little-endian. The dictionary frame is the one that readers of
# .warc.zst files know; an empty frame of another skippable magic stands between records.
DICTIONARY_MAGIC = 0x184D2A5D
GAP = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(id, payload, revisit, refers_to): which records only refer to an equal payload.

    Of payloads of at least ``least`` bytes that are equal, that with the largest id is the
    response. A null payload is empty; a null id is smaller than any; rows that share payload
    and largest id are all responses. Payloads are compared by length and SHA-256.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), payload.alias("payload"))
    keys = rows.where(F.octet_length("payload") >= least).select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    keys = materialise(keys, "payload-keys")
    groups = materialise(
        keys.groupBy("digest", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies"
    )
    # Only copies that are not the response itself; ids may repeat with different payloads.
    revisits = keys.join(groups, ["digest", "size"]).where(~F.col("id").eqNullSafe(F.col("response"))).select("id", "digest", "response").distinct()
    revisits = materialise(revisits, "revisits")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).alias("a")
    b = revisits.alias("b")
    joined = rows.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    return joined.select("a.id", "a.payload", F.col("b.digest").isNotNull().alias("revisit"), F.col("b.response").alias("refers_to"))


def _record(page_id, payload: bytes, revisit: bool, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> zstd.ZstdCompressionDict:
    """Trained on the samples; with too few of them for training their text is the dictionary."""
    if len(samples) >= 32 and sum(map(len, samples)) >= 8 * size:
        try:
            return zstd.train_dictionary(size, samples, k=256, d=8)
        except zstd.ZstdError:
            pass
    return zstd.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def _writer(dictionary_bytes: int, sample_bytes: int, level: int):
    def frames(batches):
        """One archive for each task: the dictionary first, then a frame for each record."""

        def records():
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(4))):
                    yield _record(*(x.as_py() for x in row))

        held, size, source = [], 0, records()
        for record in source:
            held.append(record)
            size += len(record)
            if size >= sample_bytes:
                break
        if not held:
            return
        words = _dictionary([r[:16384] for r in held], dictionary_bytes)
        raw = words.as_bytes()
        press = zstd.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
        out, out_size = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], 0
        for part in (held, source):
            for record in part:
                out.append(press.compress(record))
                out_size += len(out[-1])
                if out_size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, out_size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return frames


def write_archives(records: DataFrame, path: str, dictionary_bytes: int = 32_768, sample_bytes: int = 2_000_000, level: int = 6) -> None:
    """Write (id, payload, revisit, refers_to) as WARC files under ``path``, one for each partition.

    Each file starts with a skippable frame that holds the dictionary, built from the file's
    first ``sample_bytes`` of records; each record is a frame of its own. Files go through
    Spark's writer, so retried tasks leave no halves and any file system will do. That writer
    puts a separator after each value: here an empty skippable frame, which decoders pass over.
    The names end in .txt, as the writer's do.
    """
    framed = records.select("id", "payload", "revisit", "refers_to").mapInArrow(_writer(dictionary_bytes, sample_bytes, level), "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def _page(name: str):
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            rows, held, at, press = [], 0, 0, None
            while at < len(data):
                magic, size = struct.unpack_from("<II", data, at)
                if magic == DICTIONARY_MAGIC:
                    press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size])))
                if magic & 0xFFFFFFF0 == 0x184D2A50:
                    at += 8 + size
                    continue
                # A frame's compressed size is not in its header: decompress and see what is left.
                one = press.decompressobj()
                step, parts = 1 << 16, []
                while not one.eof and at < len(data):
                    parts.append(one.decompress(data[at : at + step]))
                    at += step
                at = min(at, len(data)) - len(one.unused_data)
                record = b"".join(parts)
                head, _, rest = record.partition(b"\r\n\r\n")
                field = _fields(head)
                http, _, payload = rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")
                full = int(_fields(http)["Content-Length"])
                digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = field["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {field['WARC-Record-ID']} differs from its digest")
                rows.append(
                    (_page(field["WARC-Record-ID"]), full, digest, kind, _page(field["WARC-Refers-To"]) if kind == "revisit" else None, None if kind == "revisit" else payload)
                )
                held += len(payload)
                if held > 4_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: (page_id, payload_bytes, payload_digest, record_type, refers_to, payload).

    Size and digest are of the full payload also where the record is a revisit, whose payload
    is null. A response whose payload differs from its digest is an error.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(
        _read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    )


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back; see :func:`decide` for revisits.

    An empty table gives an empty folder and no rows. Columns other than id and payload are not
    read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(decide(pages, id_col, payload_col, least), path)
    return read_archives(spark, path)
