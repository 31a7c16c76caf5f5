"""Removal of long repeated byte strings (suffix-array dedup).

Every byte that lies in a ``length``-byte string which also starts anywhere else in the
corpus goes. Beside that, bytes that lie in a shorter repeated string (``passage`` bytes,
which 50 words may have) are counted. Work is linear in the corpus and no group meets in
one task:

1. Every window of ``passage`` bytes owns a content-defined anchor (see ``anchors``);
   windows with one anchor form a run of a text, its context, which reaches on to the end
   of its last ``length``-byte string. Equal windows have equal anchor contents, so copies
   can only be among contexts with one anchor hash.
2. Contexts are counted by (anchor hash, content hash), with two places of each. A context
   that is alone with its anchor hash repeats nothing. One that occurs in copies of one
   text only, at one place, is repeated with its text.
3. All other contexts go to shards by anchor hash, those that occur at two places twice,
   so that it is the arrays that find them equal; an anchor hash with many contexts is
   dealt over several shards. A shard leaves out window starts that no other of its contexts
   can repeat (see ``kept_windows``; over half of them), builds suffix arrays of the rest by
   Larsson-Sadakane refinement and common prefixes by Kasai, and finds the windows of both
   lengths that another suffix of the shard shares.
4. Windows of hashes that were dealt over several shards are merged across shards: each
   shard's windows go, as sorted 128-bit digests, to ranges of digests, where the runs of
   equal digests are found by binary search.
5. Window runs go back to their texts, whose remaining bytes are digested.

Content hashes (64 bits each for anchor and context) only gather what may be equal and
carry the result back to equal contexts; an error needs both to collide.

Defined results: null and empty texts have no bytes and none removed; repeated rows and
equal texts repeat each other, so if they have ``length`` bytes they lose all; an empty
table gives an empty one; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import INDEX_BITS, Buffer, U, mix
from .common import discard, staged
from .suffixes import repeated_flags

#: Bytes of a string that goes, and of one that is counted.
LENGTH, PASSAGE = 400, 280
#: An anchor is among the first bytes of a window, and this many bytes from there on are its content.
CONTENT = 80
#: Bytes of text a hashing pass, the contexts of several suffix arrays and one array hold at once.
PASS_BYTES, HELD_BYTES, SHARD_BYTES = 1 << 18, 1 << 18, 60_000
#: Window starts that are looked at together before the arrays: those no other context can repeat are left out.
CELL = 25
#: Whole texts that are compressed, cut or finished at once.
FEW_ROWS = 1000
#: Distinct contexts of one anchor hash in one shard; each window of an anchor with more is sent to the merge.
SHARD_CONTEXTS = 5000
#: The table of mixed anchor hashes is broadcast if it has at most this many rows; a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000
#: A text longer than this is hashed in pieces that share ``length - 1`` bytes.
TEXT_BYTES = 4 << 20


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``FEW_ROWS`` at a time: whole texts of a batch of 10,000 would be held at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, FEW_ROWS):
            yield batch.slice(lo, FEW_ROWS)


def compressed(docs: DataFrame, id_col: str, text_col: str, least: int = 0) -> DataFrame:
    """(id, key, blob) of each row: texts are shuffled in a third of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in few(batches):
            blobs = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "key", "blob"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.where(F.octet_length("text") >= least) if least else rows
    return rows.mapInArrow(run, "id long, key long, blob binary")


def pieces(data: bytes, length: int, most: int) -> list[tuple[int, bytes]]:
    return [(lo, data[lo : lo + most + length - 1]) for lo in range(0, len(data), most)]


def contexts(docs: DataFrame, id_col: str, text_col: str, length: int, passage: int, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(id, key, at, windows, h, c) arrays of each row: where a run begins, its windows, anchor hash and content hash."""
    content = min(CONTENT, passage // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[int | None, int, int, bytes]]) -> pa.RecordBatch:
            buffer = Buffer([x[3] for x in held])
            text, first, last, anchor = buffer.runs(passage, passage - content, text_bytes)
            h = buffer.hashes(anchor, anchor + content, 0)
            end = np.minimum(last + length, buffer.ends[text])
            c = buffer.hashes(first, end, 1) ^ mix((anchor - first).astype(U) << U(32) | (last - first).astype(U))
            offsets = pa.array(np.searchsorted(text, np.arange(len(held) + 1)), pa.int32())
            at = first - buffer.starts[text] + np.array([x[2] for x in held], np.int64)[text]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((at, pa.int32()), (last - first + 1, pa.int32()), (h.view(np.int64), pa.int64()), (c.view(np.int64), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), *lists], ["id", "key", "at", "windows", "h", "c"])

        held, size = [], 0
        for batch in batches:
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for lo, data in pieces(text.encode("utf-8", "surrogatepass"), length, text_bytes):
                    held.append((i, key, lo, data))
                    size += len(data)
                    if size > PASS_BYTES:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.where(F.octet_length("text") >= passage).mapInArrow(run, "id long, key long, at array<int>, windows array<int>, h array<long>, c array<long>")


def cut_out(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, length: int, passage: int) -> DataFrame:
    """(h, c, place, salt, windows, data): the bytes of each wanted context. ``wanted``: (key, places of (at, windows, h, c, place, salt))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in few(batches):
            places = batch.column(1)
            # read column by column: a dict for each place would take longer than all the rest
            flat = places.flatten()
            at, windows = (flat.field(k).to_pylist() for k in ("at", "windows"))
            rows, cut, k = [], [], 0

            def out() -> pa.RecordBatch:
                own = flat.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([own.field(n) for n in CUT.names[:-1]] + [pa.array(cut, pa.binary())], CUT.names)

            for blob, end in zip(batch.column(0).to_pylist(), np.cumsum(pc.list_value_length(places).to_numpy()).tolist()):
                data = unpack(blob)
                for k in range(k, end):
                    piece = data[at[k] : at[k] + windows[k] + length - 1]
                    # two texts under one key would be cut at places of one
                    if len(piece) >= windows[k] + passage - 1:
                        rows.append(k)
                        cut.append(piece)
                k = end
                if len(rows) > 2000:
                    yield out()
                    rows, cut = [], []
            if rows:
                yield out()

    # equal texts bring equal bytes, so one of them will do
    met = compressed(docs, id_col, text_col, passage).dropDuplicates(["key"]).join(wanted, "key").select("blob", "places")
    return met.mapInArrow(run, "h long, c long, place int, salt int, windows int, data binary")


CUT = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("place", pa.int32()), ("salt", pa.int32()), ("windows", pa.int32()), ("data", pa.binary())])
#: ``size`` is a window's length; digests only where shards must be merged.
WINDOWS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("size", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def kept_windows(texts: list[bytes], windows: list[int], lengths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last + 1, end) for each context: its window starts that another may repeat, and where their bytes end; first = last + 1: none.

    Window starts go by their distance from the anchor in cells of ``CELL``. The windows of a cell share all bytes from its
    nearest start to the end of its farthest window; equal windows are in one cell, so a cell whose shared bytes no other
    context has repeats nothing. This only leaves out; what is repeated is told by the arrays.
    """
    passage = min(lengths)
    content = min(CONTENT, passage // 2)
    cell = min(CELL, passage // 2)
    reach = passage - content
    buffer = Buffer(texts)
    starts = buffer.starts[:, None]
    anchor = np.argmin(buffer.grams[starts + np.arange(reach)] >> INDEX_BITS, axis=1)[:, None]
    count = np.array(windows, np.int64)[:, None]
    near = np.arange(0, reach, cell)
    # window starts of each cell, from the farthest on
    lo, hi = np.maximum(anchor - near - cell + 1, 0), np.minimum(anchor - near + 1, count)
    first, last, end = np.full(len(texts), 1 << 40), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for length in lengths:
        stop = anchor - near - cell + 1 + length
        held = np.nonzero((lo < hi) & (stop <= buffer.sizes[:, None]))
        at = starts[held[0], 0]
        tells = buffer.hashes(at + (anchor - near)[held], at + stop[held], 0) ^ mix(held[1].astype(U))
        order = np.argsort(tells)
        same = np.diff(tells[order]) == 0
        shared = np.zeros(len(order), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        text, at = held[0][shared], tuple(x[shared] for x in held)
        np.minimum.at(first, text, lo[at])
        np.maximum.at(last, text, hi[at])
        np.maximum.at(end, text, hi[at] + length - 1)
    return np.minimum(first, last), last, np.minimum(end, buffer.sizes)


def shard_windows(batches: Iterator[pa.RecordBatch], lengths: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Runs [lo, hi) of each context's windows that the shard repeats, and each window's digests where shards must be merged."""
    held: dict[tuple[int, int, int], tuple[int, int, bytes]] = {}
    size, last = 0, None

    def rows(*arrays: np.ndarray) -> pa.RecordBatch:
        empty = [pa.nulls(len(arrays[0]), pa.int64())] * (len(WINDOWS) - len(arrays))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, WINDOWS.types)] + empty, WINDOWS.names)

    def array(part: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        # contexts of a text overlap, so only the windows of each one's own run count
        starts, found = repeated_flags([x[5] for x in part], [x[4] for x in part], *lengths)
        # the first of two equal ones tells
        hs, cs, places, skipped = np.array([x[:4] for x in part], np.int64).T
        for length, flags in zip(lengths, found):
            edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
            text = np.searchsorted(starts, edge[::2], "right") - 1
            tells = places[text] == 0
            text, lo, hi = text[tells], edge[::2][tells], edge[1::2][tells]
            before = skipped[text] - starts[text]
            yield rows(hs[text], cs[text], np.full(len(text), length), lo + before, hi + before)

    def out() -> Iterator[pa.RecordBatch]:
        part: list[tuple[int, int, int, int, int, bytes]] = []
        filled = 0
        first, stop, end = (x.tolist() for x in kept_windows([x[2] for x in held.values()], [x[1] for x in held.values()], lengths))
        kept = [(h, c, place, lo, hi - lo, x[2][lo:e]) for ((h, c, place), x), lo, hi, e in zip(held.items(), first, stop, end) if lo < hi]
        for _, group in groupby(kept, lambda x: x[0]):
            group = list(group)
            more = sum(len(x[5]) + 1 for x in group)
            if part and filled + more > SHARD_BYTES:
                yield from array(part)
                part, filled = [], 0
            part += group
            filled += more
        if part:
            yield from array(part)
        dealt = [(h, c, x) for (h, c, place), x in held.items() if not place and x[0] >= 0]
        buffer = Buffer([x[2] for *_, x in dealt]) if dealt else None
        for length in lengths:
            fit = [max(0, min(x[2][1], len(x[2][2]) - length + 1)) for x in dealt]
            if any(fit):
                lo = np.concatenate([np.arange(n) for n in fit])
                at = np.repeat(buffer.starts, fit) + lo
                d1, d2 = (buffer.hashes(at, at + length, lane).view(np.int64) for lane in (0, 1))
                ends = [np.repeat(np.array([x[i] for x in dealt], np.int64), fit) for i in (0, 1)]
                yield rows(*ends, np.full(len(lo), length), lo, lo + 1, d1, d2)
        held.clear()

    for batch in batches:
        for h, c, place, salt, windows, data in zip(*(x.to_pylist() for x in batch.columns)):
            if size > HELD_BYTES and (h, salt) != last:
                yield from out()
                size = 0
            last = (h, salt)
            held[h, c, place] = (salt, windows, data)
            size += len(data)
    if held:
        yield from out()


def merge_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose digest occurs twice or more in rows sorted by digest; equal rows may lie in several batches."""
    rest: pa.Table | None = None

    def repeated(t: pa.Table) -> pa.RecordBatch:
        a, b = t["d1"].to_numpy(), t["d2"].to_numpy()
        left, right = np.searchsorted(a, a, "left"), np.searchsorted(a, a, "right")
        out = np.zeros(len(a), bool)
        for i in np.flatnonzero(right - left > 1).tolist():
            out[i] = (b[left[i] : right[i]] == b[i]).sum() > 1
        # one that repeats in its own shard was found there; it takes part, and is told again
        return t.filter(pa.array(out)).select(["h", "c", "size", "lo", "hi"]).combine_chunks()

    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        a = t["d1"].to_numpy()
        cut = int(np.searchsorted(a, a[-1], "left")) if len(a) else 0
        rest = t.slice(cut)
        yield from repeated(t.slice(0, cut)).to_batches()
    if rest is not None:
        yield from repeated(rest).to_batches()


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(id, key, long, short): window runs (lo, hi) of each row's text that are repeated, of ``length`` bytes and of ``passage`` bytes."""
    found = staged(contexts(docs, id_col, text_col, length, passage, text_bytes), "contexts")
    each = found.select("id", "key", F.explode(F.arrays_zip("at", "windows", "h", "c")).alias("x")).select("id", "key", "x.*")
    # one table row for each distinct context, with its first and last place
    place = F.struct("key", "at", "windows")
    kinds = each.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("p"), F.max(place).alias("q"))
    kinds = staged(kinds.withColumn("q", F.when(F.col("p") != F.col("q"), F.col("q"))), "kinds")
    apart = F.col("q").isNotNull()
    anchors = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max(apart).alias("apart")).where("kinds > 1 OR apart")
    anchors = staged(anchors.select(F.col("h").alias("g"), "kinds"), "anchors")
    shards = F.ceil(F.col("kinds") / SHARD_CONTEXTS)
    salt = F.when(shards > 1, F.pmod(F.col("c"), shards)).otherwise(-1).cast("int")
    few = F.broadcast(anchors) if anchors.count() <= BROADCAST_ROWS else anchors
    wanted = kinds.join(few, F.col("h") == F.col("g")).select("h", "c", salt.alias("salt"), F.posexplode(F.when(apart, F.array("p", "q")).otherwise(F.array("p"))).alias("place", "p"))
    wanted = wanted.groupBy("p.key").agg(F.collect_list(F.struct("p.at", "p.windows", "h", "c", "place", "salt")).alias("places"))
    cut = cut_out(docs, wanted, id_col, text_col, length, passage).repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "place")
    windows = staged(cut.mapInArrow(lambda b: shard_windows(b, (length, passage)), "h long, c long, size int, lo int, hi int, d1 long, d2 long"), "windows")
    local = windows.where("d1 IS NULL").select("h", "c", "size", "lo", "hi")
    dealt = windows.where("d1 IS NOT NULL")
    merged = dealt.repartition("d1").sortWithinPartitions("d1", "d2").mapInArrow(merge_digests, "h long, c long, size int, lo int, hi int")
    # both lengths; what is past a text's end is cut off there
    copied = kinds.where((F.col("n") > 1) & ~apart).select("h", "c", F.explode(F.array(F.lit(length), F.lit(passage))).alias("size"), F.lit(0).alias("lo"), F.col("p.windows").alias("hi"))
    runs = staged(copied.unionByName(local).unionByName(merged).select(F.col("h").alias("g"), F.col("c").alias("d"), "size", "lo", "hi"), "runs")
    discard(kinds, anchors, windows)
    placed = each.join(runs, (F.col("h") == F.col("g")) & (F.col("c") == F.col("d")))
    run = F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    of = lambda n: F.collect_set(F.when(F.col("size") == n, run))
    out = staged(placed.groupBy("id", "key").agg(of(length).alias("long"), of(passage).alias("short")), "repeats")
    discard(found, runs)
    return out


def spans(runs: pa.ListArray, length: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the spans of each row's repeated windows, in order, merged where they touch; windows that don't fit before a text's end are none."""
    row, flat = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy()), runs.flatten()
    lo = flat.field("lo").to_numpy().astype(np.int64)
    hi = np.minimum(flat.field("hi").to_numpy() + (length - 1), sizes[row])
    fit = hi - lo >= length
    # rows stand one after another with a free place between
    base = np.cumsum(sizes + 1) - sizes
    row, lo, hi = row[fit], (lo + base[row])[fit], (hi + base[row])[fit]
    order = np.argsort(lo)
    row, lo, hi = row[order], lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, np.int64)
    row, lo, hi = row[first], lo[first], hi[np.append(first[1:], len(hi)) - 1] if len(lo) else hi
    return row, lo - base[row], hi - base[row]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, with_data: bool = False, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, spans[, kept]) of every row; ``kept``: the bytes that stay."""
    runs = repeated_runs(docs, id_col, text_col, length, passage, text_bytes)
    runs = runs.select(F.col("id").alias("i"), F.col("key").alias("k"), "long", "short")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in few(batches):
            texts = [unpack(blob) for blob in batch.column(1).to_pylist()]
            n = len(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            row, lo, hi = spans(batch.column(2), length, sizes)
            counts = np.bincount(row, minlength=n)
            offsets = np.append(0, np.cumsum(counts))
            los, his, at = lo.tolist(), hi.tolist(), offsets.tolist()
            kept = []
            for i, data in enumerate(texts):
                parts, done = [], 0
                for k in range(at[i], at[i + 1]):
                    parts.append(data[done : los[k]])
                    done = his[k]
                kept.append(b"".join([*parts, data[done:]]))
            removed = sizes - np.array([len(x) for x in kept], np.int64)
            short, a, b = spans(batch.column(3), passage, sizes)
            told = np.zeros(n, np.int64)
            np.add.at(told, short, b - a)
            gone = pa.ListArray.from_arrays(pa.array(2 * offsets, pa.int32()), pa.array(np.stack([lo, hi], 1).ravel(), pa.int32()))
            arrays = [batch.column(0), pa.array(sizes), pa.array(removed), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(told), gone]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "spans"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if with_data else arrays, names + ["kept"] * with_data)

    rows = compressed(docs, id_col, text_col)
    rows = rows.join(runs, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "blob", "long", "short")
    return rows.mapInArrow(finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, spans array<int>" + ", kept binary" * with_data)
