"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, payload digest and url.  The ranges, called shards, are cut at exact running sums of the
payload bytes in that order, so they depend on the rows alone and not on how Spark dealt them; ids that many rows share
are cut like all others.  A task writes a shard as gzip members, one per record, and opens the next file when the
compressed size reaches the limit.  Headers, record ids and digests are made anew from the payload, so the same
rows give the same files, byte for byte.  Tasks write under names of their own attempt; the manifest, which Spark commits, lists
the files of the attempts that count, and only those get their final names.  A reader follows the manifest alone.

Files are opened through Arrow's file systems, so the folder may be any store that they and Spark both know.
"""

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.materialize import materialize

ROLL_BYTES = 16 << 20  # compressed
SHARD_BYTES = 24 << 20  # of payload
MOST_SHARDS = 1 << 15  # beyond, shards grow; bounds the list of cuts
RECORD_BYTES = 512  # added to a payload for its headers, so that empty ones are dealt too
ROWS_PER_RANGE = 200_000  # narrow rows
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
_CHUNK, _HELD = 1 << 16, 8 << 20
MANIFEST = "file string, attempt string, records long, bytes long"
RECORDS = "page_id {}, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to {}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def _one_line(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, first=None) -> bytes:
    """One record; a revisit of page ``first`` carries the payload's length and digest but not the payload."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without a time
    return packer.compress(data) + packer.flush()


_KEY = ("page_id", "sha1", "place")


def _ordered(values) -> tuple:
    """A key as Python orders it the way Spark does, nulls first."""
    return tuple((v is not None, v) for v in values)


def _place(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``(page_id, sha1, place, bytes, n, shard, copies)`` and the number of shards, for rows with a key and ``bytes``.

    ``n`` rows share a key and are therefore the same record; ``copies`` of them start in the shard.
    """
    slim = materialize(rows.groupBy(*_KEY, "bytes").agg(F.count("*").alias("n")))
    weight = F.col("bytes") + RECORD_BYTES
    keys, total = slim.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * weight), F.lit(0))).first()
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    ranges = max(1, min(MOST_SHARDS, -(-keys // ROWS_PER_RANGE)))
    dealt = materialize(slim.repartitionByRange(ranges, *_KEY).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum(F.col("n") * weight).alias("sum"))  # at most MOST_SHARDS rows
    before = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * weight).over(inside), F.lit(0))
    upto = lambda edge: F.least(F.greatest(F.expr(f"({edge} - start + weight - 1) div weight"), F.lit(0)), F.col("n"))
    placed = (
        dealt.join(F.broadcast(before), "range").withColumn("start", start).withColumn("weight", weight)
        .withColumn("shard", F.explode(F.expr(f"sequence(start div {size}, (start + (n - 1) * weight) div {size})")))
        .withColumn("copies", upto(f"(shard + 1) * {size}") - upto(f"shard * {size}"))
    )
    return materialize(placed.where("copies > 0").select(*_KEY, "bytes", "n", "shard", "copies")), total // size + 1


def write(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``page_id``, ``url`` and ``html`` as archives below ``path``; returns the committed manifest.

    A payload is the html in UTF-8, empty for null.  Of records with equal payloads of at least ``min_bytes`` the one
    with the smallest page_id is the response and the others are revisits.  Rows that share that id are all
    responses; rows without id too, and nothing refers to them.  A null url leaves its header out; control
    characters in it are percent-encoded.  Rows equal in all three are written once each.  Other columns are left out.
    """
    spark = pages.sparkSession
    id_type = pages.schema["page_id"].dataType
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", F.sha1(body).alias("sha1"), F.coalesce(F.sha1(F.encode("url", "utf-8")), F.lit("")).alias("place"),
                         "url", "html")
    size = F.octet_length(F.encode(F.coalesce("html", F.lit("")), "utf-8")).cast("long")
    placed, shards = _place(keyed.select(*_KEY, size.alias("bytes")), shard_bytes)
    copied = placed.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.sum("copies").alias("all")
    ).where("all > 1").select("sha1", "first")
    notes = placed.where(F.col("bytes") >= min_bytes).join(copied, "sha1").where("page_id > first")

    # a cut is the first key of a shard; keys whose rows start in several shards are at most as many as the shards
    cuts = sorted((_ordered(r["key"]), r["shard"]) for r in placed.groupBy("shard").agg(F.min(F.struct(*_KEY)).alias("key")).collect())
    split = placed.where("copies < n").select(*_KEY, "shard", "copies")
    wide = {_ordered(r) for r in split.select(*_KEY).distinct().collect()}
    edges, numbers = [key for key, _ in cuts], [shard for _, shard in cuts]

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array, sha1: pa.Array, place: pa.Array) -> pa.Array:
        keys = (_ordered(k) for k in zip(page_id.to_pylist(), sha1.to_pylist(), place.to_pylist()))
        return pa.array([-1 if k in wide else numbers[bisect_right(edges, k) - 1] for k in keys], pa.int32())

    columns = ["shard", "copies", *_KEY, "kind", "url", "html", "first"]
    text, none = (lambda name: F.lit(None).cast("string").alias(name)), F.lit(None).cast(id_type).alias("first")
    own = keyed.withColumn("shard", shard_of(*_KEY)).where("shard >= 0").withColumn("copies", F.lit(1).cast("long"))
    merged = own.select(*columns[:5], F.lit(1).alias("kind"), "url", "html", none)
    if wide:
        # one row per key that is split, then one per shard with the copies to write there
        cut = split.select(*[F.col(c).alias(f"_{c}") for c in split.columns])
        same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("sha1") == F.col("_sha1")) & (F.col("place") == F.col("_place"))
        once = keyed.join(F.broadcast(cut.select("_page_id", "_sha1", "_place").distinct()), same, "left_semi").groupBy(*_KEY).agg(
            F.first("url").alias("url"), F.first("html").alias("html"))
        spread = once.join(F.broadcast(cut), same).select(
            F.col("_shard").cast("int").alias("shard"), F.col("_copies").alias("copies"), *_KEY, F.lit(1).alias("kind"), "url", "html", none)
        merged = merged.unionByName(spread)
    # a note stands before the records of its key
    noted = notes.select(F.col("shard").cast("int").alias("shard"), "copies", *_KEY, F.lit(0).alias("kind"), text("url"), text("html"), "first")
    dealt = merged.unionByName(noted).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *_KEY, "kind")

    def put(batches):
        store, root = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        attempt = f"_attempts/{context.partitionId():06d}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{attempt}", recursive=True)
        out, manifest, current, note = None, [], None, None

        def close():
            if out is not None:
                out.close()

        for batch in batches:
            for shard, copies, page_id, sha1, place, kind, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    note = (page_id, sha1, place), first
                    continue
                revisited = note[1] if note and note[0] == (page_id, sha1, place) else None
                member = _member(record(page_id, url, (html or "").encode(), revisited))
                for _ in range(copies):
                    if shard != current or manifest[-1]["bytes"] + len(member) > roll_bytes:
                        close()
                        rolled = rolled + 1 if shard == current else 0
                        name, current = f"part-{shard:06d}-{rolled:06d}.warc.gz", shard
                        out = store.open_output_stream(f"{root}/{attempt}/{name}", compression=None)
                        manifest.append({"file": name, "attempt": attempt, "records": 0, "bytes": 0})
                    out.write(member)
                    manifest[-1]["records"] += 1
                    manifest[-1]["bytes"] += len(member)
        close()
        if manifest:
            yield pa.RecordBatch.from_pylist(manifest)

    def name_finally(batches):
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, attempt in zip(batch["file"], batch["attempt"]):
                # a task that runs again finds the work done
                if store.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    store.move(f"{root}/{attempt}/{name}", f"{root}/{name}")
            yield batch

    written = materialize(dealt.mapInArrow(put, MANIFEST))
    written.mapInPandas(name_finally, MANIFEST).write.parquet(f"{path}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def parse(stream):
    """Yield ``(headers, block)`` of each record of a gzip stream, holding one record at a time."""
    unpacker, data, rest = zlib.decompressobj(31), bytearray(), b""
    while chunk := rest or stream.read(_CHUNK):
        data += unpacker.decompress(chunk)
        rest = unpacker.unused_data
        if unpacker.eof:
            head, _, block = bytes(data).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])]
            unpacker, data = zlib.decompressobj(31), bytearray()


def read(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Records of all files in the manifest; digests are checked, a record that fails stops the job."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("file")
    convert = int if id_type in ("long", "bigint", "int") else str

    def get(batches):
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for headers, block in parse(stream):
                        if headers["WARC-Block-Digest"] != "sha1:" + payload_digest(block):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {name}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and digest != payload_digest(payload):
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} in {name}")
                        ids = [headers.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        page, first = [None if i is None else convert(i) for i in ids]
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page, headers.get("WARC-Target-URI"), kind,
                                     payload if with_payload and kind == "response" else None, size, digest, first))
                        held += len(payload)
                        if held > _HELD or len(rows) >= 5000:
                            yield _frame(rows)
                            rows, held = [], 0
                    yield _frame(rows)

    names = [c.split()[0] for c in RECORDS.split(", ")]

    def _frame(rows):
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"page_id": "object", "refers_to": "object"})

    return manifest.repartition(max(1, manifest.count())).mapInPandas(get, RECORDS.format(id_type, id_type))
