"""Deterministic sharded WARC writer and reader.

Writing: records are dealt to shards by ranges of their key, cut where the
running sum of payload bytes passes ``SHARD_BYTES``; the cuts come from the data
alone, not from partitions or samples: a histogram of ``RANGES`` key ranges, of which a
heavy one is cut again between its own least and largest key, and a range that is
heavy even then (or the records without a key) is dealt by digest. So a shard is
bounded for every distribution of keys but that of one repeated record. Within a
shard, records are sorted by key and appended to a gzip-per-record file, which
is closed when its compressed size passes ``FILE_BYTES``. Names, record ids,
dates and headers follow from the record, so a task that runs twice writes the
same bytes. A task writes to a temporary name and renames; files count only once
the manifest, written by Spark's own commit, names them with their digest.

Of records with equal payloads of at least ``REVISIT_BYTES`` that with the
largest key is the response, the others are ``revisit`` records without payload
that refer to it; smaller payloads are always responses.

Reading takes the files a manifest names, verifies their digests, regenerates
every record's payload digest, and fails on a difference.

Defined cases: null payload is empty; null url is an empty header; repeated rows
(same key and payload) are repeated records of one type; a null key is an empty
key header, never referred to and never a revisit;
extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
RANGES = 1 << 14  # key ranges in the histogram that the shards are cut from
MOST_TASKS = 100_000  # beyond this number of shards a task writes several, one after the other
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace

MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"
RECORD = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long, file string")


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'record:{key}:{digest}')}>"


def build_record(key: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, header lines and block; a revisit has an empty block."""
    clean = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {'' if key is None else key}", f"X-Payload-Length: {size}",
            "Content-Type: text/html;charset=utf-8"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Key: {refers_to}"]
    block = payload if refers_to is None else b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _ShardFiles:
    """The files of one shard: temporary names until closed, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.limit = limit
        self.fs, self.root = _filesystem(folder)
        self.shard, self.seq, self.out = shard, 0, None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.sha = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256()
            self.records = self.bytes = 0
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        row = {"file": self.name, "shard": self.shard, "seq": self.seq, "records": self.records,
               "bytes": self.bytes, "sha256": self.sha.hexdigest()}
        self.out, self.seq = None, self.seq + 1
        return row


def _write_shards(folder: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, done = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if files is None or files.shard != r.shard:
                    done.append(files.close() if files else None)
                    files = _ShardFiles(folder, r.shard, limit)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                key = None if r.key is None else int(r.key)
                done.append(files.add(build_record(key, r.url, r.payload, r.digest, int(r.size), refers)))
            if done := [x for x in done if x]:
                yield pd.DataFrame(done)
                done = []
        if files and (last := files.close()):
            yield pd.DataFrame([last])
    return run


class Shards:
    """The shard of every record from ``sizes`` (key, digest, size)."""

    def __init__(self, sizes: DataFrame, shard_bytes: int):
        low, high = sizes.agg(F.min("key"), F.max("key")).first()
        self.low, self.width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
        cells = sizes.groupBy(self._cell().alias("cell")).agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        rows, shard, held = [], 0, 0
        for r in cells.orderBy("cell").collect():  # at most RANGES + 1 rows
            n = -(-r["bytes"] // shard_bytes) if r["bytes"] > shard_bytes else 1
            if held and held + r["bytes"] > shard_bytes or n > 1 and held:
                shard, held = shard + 1, 0
            rows.append((r["cell"], shard, n, r["lo"], r["hi"]))
            shard, held = (shard + n, 0) if n > 1 else (shard, held + r["bytes"])
        spark, first = sizes.sparkSession, shard + 1
        self.cells = spark.createDataFrame(rows, "cell long, base int, n int, lo long, hi long")
        over = self._first(sizes).groupBy("shard").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * shard_bytes) \
            .withColumn("parts", F.ceil(F.col("bytes") / shard_bytes).cast("int"))
        before = F.sum("parts").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per overfull shard
        self.over = stored(over.select("shard", "parts", (F.lit(first) + F.coalesce(before, F.lit(0))).cast("int").alias("start")), "warc-over")
        self.number = first + (self.over.agg(F.sum("parts")).first()[0] or 0)

    def _cell(self):
        """The key's range; beyond all others for records without a key."""
        at = ((F.col("key").cast("decimal(20,0)") - F.lit(self.low).cast("decimal(20,0)")) / F.lit(self.width).cast("decimal(20,0)"))
        return F.coalesce(F.floor(at).cast("long"), F.lit(RANGES + 1).cast("long"))

    def _first(self, rows: DataFrame) -> DataFrame:
        # doubles keep the order of keys, and equal keys together
        inside = F.floor((F.col("key").cast("double") - F.col("lo")) / (F.col("hi").cast("double") - F.col("lo") + 1) * F.col("n")).cast("int")
        part = F.when(F.col("lo").isNull(), F.pmod(F.xxhash64("digest"), F.col("n")).cast("int")) \
            .otherwise(F.least(F.greatest(inside, F.lit(0)), F.col("n") - 1))
        return rows.withColumn("cell", self._cell()).join(F.broadcast(self.cells), "cell") \
            .withColumn("shard", F.col("base") + part).drop("cell", "base", "n", "lo", "hi")  # at most RANGES + 1 rows

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, digest, ..) with ``shard``; records of one key and digest stay together."""
        dealt = self._first(rows).join(self.over, "shard", "left")
        split = F.col("start") + F.pmod(F.xxhash64("digest", "key"), F.col("parts")).cast("int")
        return dealt.withColumn("shard", F.coalesce(split, F.col("shard"))).drop("parts", "start")


def write(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html",
          shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archive to ``folder`` (a URI all executors reach) and returns its manifest."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{ident}`").cast("long").alias("key"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    small = stored(rows.select("key", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")),
                   "warc-sizes")
    same = small.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = small.join(same, "digest").where("key < refers_to").select("key", "digest", "refers_to").distinct()
    shards = Shards(small.withColumn("size", F.col("size").cast("long")), shard_bytes)

    # Pages and the few facts about revisits meet in the one exchange that the shards need anyway.
    full = rows.select("key", "url", "payload", F.sha1("payload").alias("digest"),
                       F.octet_length("payload").alias("size"), F.lit(None).cast("long").alias("refers_to"))
    facts = revisits.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                            "digest", F.lit(0).alias("size"), "refers_to")
    dealt = shards.of(full.unionByName(facts)).repartition(min(shards.number, MOST_TASKS), "shard")
    mine = Window.partitionBy("shard", "key", "digest")
    ready = dealt.withColumn("refers_to", F.max("refers_to").over(mine)).where("payload is not null") \
        .select("shard", F.col("key").cast("string").alias("key"), "url", "digest", "size", "refers_to",
                F.col("key").alias("number"),
                F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload")) \
        .sortWithinPartitions("shard", "number", "digest", "url").drop("number")
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    ready.mapInPandas(_write_shards(folder, file_bytes), MANIFEST).write.json(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of ``data``, fed in steps, so that what follows a member is
    never copied as a whole."""
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = data[at:at + step]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes, name: str) -> Iterator[dict]:
    """The records of a gzip-per-record file; wrong lengths or digests fail."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        payload = rest[:int(f["Content-Length"])]
        revisit = f["WARC-Type"] == "revisit"
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if rest[len(payload):] != b"\r\n\r\n" or not revisit and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{name}: damaged record {f.get('WARC-Record-ID')}")
        yield {"page_id": int(f["X-Record-Key"]) if f["X-Record-Key"] else None, "url": f["WARC-Target-URI"], "record_type": f["WARC-Type"],
               "payload": payload, "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": digest,
               "refers_to": int(f["X-Refers-To-Key"]) if revisit else None, "file": name}


def _read_files(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        for pdf in batches:
            for name, sha in zip(pdf["file"], pdf["sha256"], strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name}: not the file of the manifest")
                held, size = [], 0
                for r in parse(data, name):
                    held.append(r)
                    size += len(r["payload"])
                    if size > 8 << 20:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)
    return run


def _records(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[c] for r in rows], "Int64")
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files of the manifest (payload empty for revisits)."""
    files = manifest(spark, folder).select("file", "sha256")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "file").mapInPandas(_read_files(folder), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` below the shared folder and reads the archive back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write(pages, folder)
    return read(spark, folder)
