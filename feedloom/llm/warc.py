"""Operator 9: WARC archives, index first.

``write_archives`` writes one gzip member per record into files of the shared
folder and returns the index: path, offset, length, URL, digest of every
record.  The index is the commit record: a task that is run again writes a new
file, and only the file named by the rows that were kept is read.
``read_records`` reads selected records back: the selection is sorted by
(path, offset), neighbouring byte ranges are coalesced into one read of
bounded size, and the members are cut out by the index.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one
with the smallest page_id is a response; the others are revisits that refer to
it and hold no payload.  Equality is decided by the payload's SHA-256 (the
SHA-1 that WARC headers carry can be made to collide).

Defined cases: a null page counts as an empty payload; a null URL gives an
empty WARC-Target-URI; a null page_id is never chosen to be referred to unless
the whole group has none, and then every record of the group is a response;
rows repeated with the chosen page_id are responses too; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices, stage, utf8_list
from feedloom.session import file_system as open_store
from feedloom.session import work_dir

#: Texts handled at once in a task, and the largest single read.
SLICE_BYTES = 8 << 20
READ_BYTES = 8 << 20
#: Byte ranges closer than this are read together.
GAP_BYTES = 64 << 10
#: An archive is read in splits of about this many bytes.
SPLIT_BYTES = 4 << 20

INDEX = ("path string, offset long, length long, page_id long, url string, payload_digest string, "
         "record_type string, refers_to long, split long")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_bytes(page_id, url: str, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One uncompressed WARC/1.1 record.  A revisit keeps the HTTP header
    (with the payload's length) and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {record_type}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Target-URI: " + "".join(url.split()),
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_record(record: bytes) -> dict:
    """Headers and payload of one uncompressed record.  For a response the
    payload's length and digest are those of the bytes in the archive."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "")
                  for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    out = {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"],
           "record_type": fields["WARC-Type"], "payload": payload, "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["WARC-Refers-To"][len("<urn:page:"):-1])
        out["payload_bytes"] = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        out["payload_digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        out["payload_bytes"], out["payload_digest"] = len(payload), base32_sha1(payload)
    return out


def decide_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Add ``payload_hash`` and ``keeper`` (page_id of the response of a group
    of equal payloads; null where the payload occurs once) to the pages.

    Only hashes are grouped; the pages meet the few groups of two or more."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("payload_hash", F.sha2(payload, 256))
    groups = (rows.where(F.octet_length(payload) >= min_revisit_bytes)
              .groupBy("payload_hash").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("keeper"))
              .where("n > 1").select("payload_hash", "keeper"))
    # written first: a join of two plain inputs is one that Spark splits where a
    # group is large (a join with an aggregate in the same stage is not)
    return rows.join(stage(groups, "warc-groups"), "payload_hash", "left")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every row (page_id, url, html) as a WARC record below ``folder``
    and return the index, itself a written table."""
    rows = decide_revisits(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                                        F.col("html").cast("string")), min_revisit_bytes)

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        path, out, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for whole in batches:
            for b in slices(whole, 2, SLICE_BYTES):
                index = []
                for page, url, payload, keeper in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                      utf8_list(b.column(2)), b.column(3).to_pylist()):
                    kind = "revisit" if keeper is not None and keeper != page else "response"
                    digest = base32_sha1(payload)
                    data = member(record_bytes(page, url or "", payload, digest, kind, keeper))
                    out = out or store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                    out.write(data)
                    index.append((path, at, len(data), page, url, digest, kind,
                                  keeper if kind == "revisit" else None, at // SPLIT_BYTES))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                                      pa.string(), pa.int64(), pa.int64()))],
                    names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stage(rows.select("page_id", "url", "html", "keeper").mapInArrow(write, INDEX), "warc-index")


def coalesce_ranges(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP_BYTES, most: int = READ_BYTES):
    """Split sorted ranges into runs to be read at once: (first, last+1) pairs.
    A run holds ranges no more than ``gap`` apart and about ``most`` bytes."""
    start = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap \
                or offsets[i] + lengths[i] - offsets[start] > most:
            yield start, i
            start = i


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` (a selection of its rows) names.

    A read task gets whole splits of archive files in (path, offset) order."""
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, payload binary")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        path, source = None, None
        for b in batches:
            paths = b.column(0).to_pylist()
            offsets, lengths = b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if paths[lo] != path:
                    if source is not None:
                        source.close()
                    path = paths[lo]
                    store, where = open_store(path)
                    source = store.open_input_file(where)
                for i, j in coalesce_ranges(offsets[lo:hi], lengths[lo:hi]):
                    i, j = lo + i, lo + j
                    base = int(offsets[i])
                    data = source.read_at(int(offsets[j - 1] + lengths[j - 1]) - base, base)
                    found = [parse_record(zlib.decompress(data[o - base:o - base + n], 31))
                             for o, n in zip(offsets[i:j].tolist(), lengths[i:j].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in found], t) for c, t in zip(names, types)], names=names)
        if source is not None:
            source.close()

    # as many read tasks as the selected bytes ask for: the index rows themselves are small
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // (8 * SPLIT_BYTES)))
    return (index.select("path", "offset", "length", "split").repartition(tasks, "path", "split")
            .sortWithinPartitions("path", "offset").mapInArrow(read, schema))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder, read every record
    back and return what the archives say of it."""
    folder = work_dir(pages.sparkSession, "llm-warc")
    return read_records(write_archives(pages, folder, min_revisit_bytes))
