"""Deterministic sharded WARC archives of web pages.

``write_warc`` sorts records by id range into shards whose bounds depend on the rows
alone, writes each shard's records as separate gzip members, rolls to a new file when
the compressed size is reached, regenerates headers, record ids and digests, writes
under a temporary name, renames, and commits a manifest of all files last. A rerun or a
retried task writes the same bytes under the same names. ``read_warc`` reads the files
that the manifest names.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest id
is a ``response``; the others are ``revisit`` records that refer to it.

Defined results: a null html is an empty payload; a null url is written as
``urn:page:<id>``; a null id sorts last and is written as ``-``; rows that repeat an id
are all written (within an id by digest, then url), and of such rows with one payload
the first is the response; ids may be far apart or negative; payloads of any length are
written whole; an empty table gives no files and an empty manifest; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_dir, remove, staged

#: Ids are summed in this many equal ranges at a time to find the shards' bounds.
GRAINS = 4096
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
CLASH = re.compile(r"[\r\n]+")


def identity(kind: str, page_id: int | None, url: str | None, digest: str) -> tuple[str, str, str]:
    """A page's name, its URI and the id of its record."""
    name = "-" if page_id is None else str(page_id)
    uri = CLASH.sub(" ", url) if url else f"urn:page:{name}"
    return name, uri, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{name}|{uri}|{digest}')}>"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n_bytes: int, refers_to: int | None, first_url: str | None = None) -> bytes:
    """One uncompressed WARC 1.1 record; a revisit names the response with its payload (page ``refers_to``, at ``first_url``)."""
    kind = "revisit" if refers_to is not None else "response"
    name, uri, record_id = identity(kind, page_id, url, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(n_bytes).encode() + b"\r\n\r\n"
    payload = (html or "").encode("utf-8", "replace")
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {name}: the payload doesn't have the digest that was planned")
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {name}",
        f"X-Payload-Bytes: {n_bytes}",
    ]
    if refers_to is not None:
        _, first_uri, first_record = identity("response", refers_to, first_url, digest)
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {first_record}",
            f"WARC-Refers-To-Target-URI: {first_uri}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(id, url, html, digest, n_bytes, refers_to); only ids and digests meet in the shuffle that finds copies."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    return rows.withColumn("copies", F.col("n_bytes") >= min_bytes)


def shard_bounds(rows: DataFrame, shard_bytes: int) -> list[int]:
    """Lower id bounds of the shards after the first, so that a shard has about ``shard_bytes``.

    Ids are summed in GRAINS equal ranges; ranges with more than a shard's bytes are cut
    into GRAINS ranges again, until none is too large or it is one id. So neither outlying
    ids nor gaps decide on a shard's size, and the bounds depend on the rows alone.
    """
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    left = rows.where("id IS NOT NULL").select("id", (F.col("n_bytes") + 600).alias("bytes"))
    ranges, sums = {low: high + 1}, []
    while ranges:
        starts = sorted(ranges)
        widths = {a: -(-(ranges[a] - a) // GRAINS) for a in starts}
        at = find(starts)(F.col("id"))
        table = left.sparkSession.createDataFrame([(i, a, widths[a]) for i, a in enumerate(starts)], "place int, start long, width long")
        met = left.withColumn("place", at).join(table, "place")
        # as decimals, whose difference has no overflow
        grain = F.expr("start + (cast(id as decimal(20, 0)) - start) div width * width").alias("grain")
        met = met.select("id", "bytes", grain, "width")
        found = met.groupBy("grain", "width").agg(F.sum("bytes").alias("bytes")).collect()
        sums += [(r.grain, r.bytes) for r in found if r.bytes <= shard_bytes or r.width == 1]
        ranges = {r.grain: min(r.grain + r.width, high + 1) for r in found if r.bytes > shard_bytes and r.width > 1}
        if ranges:
            heavy = left.sparkSession.createDataFrame([(g,) for g in ranges], "heavy long")
            left = met.join(heavy, F.col("grain") == F.col("heavy")).select("id", "bytes")
    bounds, held = [], 0
    for grain, size in sorted(sums):
        if held and held + size > shard_bytes:
            bounds.append(grain)
            held = 0
        held += size
    return bounds


def find(starts: list[int]):
    """The place of the last start that isn't above an id, before the first 0; null ids go last. By binary search, as there may be many."""
    bounds = np.array(starts, np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        return pa.array(np.maximum(np.searchsorted(bounds, known, "right") - 1, 0).astype(np.int32))

    return place


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20) -> DataFrame:
    """Write the archives under ``out``; returns the committed manifest."""
    spark = pages.sparkSession
    rows = plan_records(pages, id_col, url_col, html_col, min_bytes)
    digests = staged(rows.select("id", "url", "digest", "n_bytes", "copies"), "warc-digests")
    bounds = shard_bounds(digests, shard_bytes)
    # of rows with the smallest id, that with the first url
    least = F.min(F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("first_id"), F.col("url").alias("first_url"))))
    first = digests.where("copies").groupBy("digest").agg(least.alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "f.*")
    # a record that repeats another is told so by (id, digest); the html isn't joined, it meets this row in its shard
    notes = digests.where("copies").join(first, "digest").groupBy("id", "digest").agg(F.first("first_id").alias("first_id"), F.first("first_url").alias("first_url"))
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("id", "url", "html", "digest", "n_bytes", none("long").alias("first_id"), none("string").alias("first_url"), F.lit(1).alias("kind"))
    both = both.unionByName(notes.select("id", none("string").alias("url"), none("string").alias("html"), "digest", F.lit(0).cast("long").alias("n_bytes"), "first_id", "first_url", F.lit(0).alias("kind")))
    # the first shard begins below all bounds
    both = both.withColumn("shard", find([-(1 << 63), *bounds])(F.col("id")) if bounds else F.lit(0))
    both = both.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{base}/_temporary-warc", recursive=True)
        shard, n, held, sink, temp, sha, size, records = None, 0, None, None, "", None, 0, 0
        seen: set[tuple[int | None, str]] = set()
        done: list[dict] = []

        def close() -> None:
            nonlocal sink, n
            if sink is not None:
                sink.close()
                name = f"shard-{shard:06d}-{n:05d}.warc.gz"
                if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:  # of a task that was lost; the same bytes
                    fs.delete_file(f"{base}/{name}")
                fs.move(temp, f"{base}/{name}")
                done.append({"file": name, "shard": shard, "records": records, "bytes": size, "sha256": sha.hexdigest()})
                n, sink = n + 1, None

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    close()
                    shard, n = r["shard"], 0
                if r["kind"] == 0:
                    held = (r["id"], r["digest"], r["first_id"], r["first_url"])
                    continue
                refers_to = first_url = None
                if held and held[:2] == (r["id"], r["digest"]):
                    if r["id"] != held[2] or held[:2] in seen:
                        refers_to, first_url = held[2:]
                    seen = {held[:2]}
                if sink is not None and size >= roll_bytes:
                    close()
                if sink is None:
                    temp, sha, size, records = f"{base}/_temporary-warc/{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
                    sink = fs.open_output_stream(temp)
                data = gzip.compress(record(r["id"], r["url"], r["html"], r["digest"], r["n_bytes"], refers_to, first_url), 6, mtime=0)
                sink.write(data)
                sha.update(data)
                size, records = size + len(data), records + 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    listed = staged(both.mapInArrow(write, MANIFEST), "warc-files").orderBy("file")
    listed.coalesce(1).write.mode("overwrite").json(f"{out}/manifest.json")
    remove(spark, f"{out}/_temporary-warc")
    discard(digests)
    return spark.read.schema(MANIFEST).json(f"{out}/manifest.json")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream, read in pieces."""
    data, unzip, raw = b"", zlib.decompressobj(31), b""

    def more() -> bool:
        nonlocal data, unzip, raw
        while True:
            if not raw:
                raw = stream.read(1 << 20)
                if not raw:
                    return False
            piece = unzip.decompress(raw)
            raw = b""
            if unzip.eof:
                raw, unzip = unzip.unused_data, zlib.decompressobj(31)
            if piece:
                data += piece
                return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = data[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        need = end + 4 + int(head["content-length"]) + 4
        while len(data) < need:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield head, data[end + 4 : need - 4]
        data = data[need:]


def read_warc(manifest: DataFrame, out: str, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url) of every record; digests are checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        fs, base = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        payload, n = block.partition(b"\r\n\r\n")[2], int(head["x-payload-bytes"])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: a block doesn't have its digest")
                        if head["warc-type"] == "response":
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        page = head["x-page-id"]
                        rows.append({"id": None if page == "-" else int(page), "payload_bytes": n, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": int(r) if (r := head.get("x-refers-to-page")) else None, "url": head["warc-target-uri"]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    # a task for each file: they are of one size, and the optimiser would join them by the size of their names
    files = manifest.select("file")
    files = files.repartition(max(1, files.count()))
    back = files.mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return back.withColumnRenamed("id", id_col)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **params) -> DataFrame:
    out = new_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, out, id_col, url_col, html_col, **params), out, id_col)
