"""Removal of repeated byte strings by a sampled suffix sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier. The plan is that of a difference-cover suffix sort cut off at ``LENGTH``
bytes: a sample of places that meets every such string at the same offset is
sorted and named first, the remaining suffixes are merged in by their names,
and neighbours in sorted order are compared.

* Sample. A fixed residue sample (two of three places) would sort most of all
  bytes. Here the cover is chosen by content: each string's place is that of
  the least hash among its grams of ``GRAM`` bytes, so equal strings have equal
  places, and about one byte in forty is a place.
* Sorting and naming. A place owns a stretch of strings; its triple (gram,
  bytes of the stretch, offset) is its name. All places are sorted by (gram,
  name, document, place). A place whose name came earlier is settled: its whole
  stretch is repeated. Places alone with their gram have no repeats.
* Remaining suffixes. Where one gram has several names, strings may agree
  although their stretches differ. Digests of a few prefixes and suffixes
  around the place rule out most of them; the strings left are sorted by
  (digest of their ``LENGTH`` bytes, document, start).
* Adjacent prefixes. In that order a string equal to its neighbour before it
  is repeated.

Both sorts are range partitionings whose keys end in document and place, so a
passage that a third of all documents share spreads over many tasks. A task
keeps one row between batches; where a run crosses tasks is decided from one
row per task. A name has 64 bits beside the 64 of its gram, the digest of a
string 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import tasks_for, text_of, write_once

LENGTH = 100
GRAM = 24
# Extents around a place at which strings are told apart before they are sorted.
LEFT = (12, 30)
RIGHT = (50, 75)
CHUNK = 1 << 16
PLACE_MASK = np.uint64((1 << 20) - 1)
NUMBERS = np.arange(2 * CHUNK + 4 * LENGTH, dtype=np.uint64)
LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of fresh values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Digest:
    """64-bit digests of any substrings of a chunk from running sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 61, 1 << 62)) | 1
        size = 2 * CHUNK + 4 * LENGTH
        self.power, self.inverse = (self._powers(x, size) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        terms = self.table[data]
        terms *= self.inverse[:len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = sums[end]
        out -= sums[start]
        out *= self.power[start]
        return _mixed(out)

    def rolling(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The digests of all substrings of ``width`` bytes."""
        out = sums[width:] - sums[:-width]
        out *= self.power[:len(out)]
        return _mixed(out)


_digests: list[Digest] = []


def digests() -> tuple[Digest, Digest]:
    if not _digests:
        _digests.extend((Digest(11), Digest(23)))
    return _digests[0], _digests[1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[:len(x) - (width - size)], x[width - size:])


def _joint(texts: list[np.ndarray], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in arrays of bounded size, long ones in pieces that
    overlap: (bytes, ends of the pieces, text of each piece, what to add to a
    position in the array for its place in the text)."""
    held, size = [], 0

    def out():
        lengths = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(lengths)
        return (np.concatenate([x for _, _, x in held]), ends, np.array([k for k, _, _ in held]),
                np.array([at for _, at, _ in held]) - (ends - lengths))

    for k, data in enumerate(texts):
        for at in range(0, max(1, len(data) - overlap), CHUNK):
            held.append((k, at, data[at:at + CHUNK + overlap]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def places_of(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> Iterator[list[np.ndarray]]:
    """Columns text, gram hash, name, extents (16 bits each), place, first and
    last start of the owned strings: one row per place of the texts."""
    digest = digests()[0]
    for part, ends, of, shift in _joint(texts, length - 1):
        if len(part) < length:
            continue
        # Strings that do not reach into the next piece.
        until = np.repeat(ends, np.diff(ends, prepend=0))[:len(part) - length + 1]
        whole = until >= np.arange(length, len(part) + 1)
        strings = np.flatnonzero(whole)
        if not len(strings):
            continue
        sums = digest.sums(part)
        hashes = digest.rolling(sums, gram)
        ranked = hashes & ~PLACE_MASK
        ranked |= NUMBERS[:len(ranked)]
        owner = (_least(ranked, length - gram + 1) & PLACE_MASK).astype(np.int64)[strings]
        new = np.flatnonzero((owner[1:] != owner[:-1]) | (strings[1:] != strings[:-1] + 1)) + 1
        first = np.concatenate([[0], new])
        lo, hi, place = strings[first], strings[np.append(new, len(strings)) - 1], owner[first]
        name = _mixed(digest.of(sums, lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ext = np.zeros(len(lo), np.uint64)
        for k, reach in enumerate(LEFT):
            some = np.flatnonzero(place - reach >= lo)
            ext[some] |= (digest.of(sums, place[some] - reach, place[some]) >> np.uint64(48)) << np.uint64(16 * k)
        for k, reach in enumerate(RIGHT, len(LEFT)):
            some = np.flatnonzero(place + reach <= hi + length)
            ext[some] |= (digest.of(sums, place[some], place[some] + reach) >> np.uint64(48)) << np.uint64(16 * k)
        piece = np.searchsorted(ends, lo, side="right")
        yield [of[piece], hashes[place].view(np.int64), name.view(np.int64), ext.view(np.int64),
               *((x + shift[piece]).astype(np.int32) for x in (place, lo, hi))]


PLACES = "h long, e long, ext long, p int, lo int, hi int, doc long, rid long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PLACES.split(", ")]
    for batch in batches:
        rid, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [np.frombuffer(t.as_buffer(), np.uint8) for t in batch.column(2).cast(pa.binary())]
        for of, *columns in places_of(texts):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, doc[of], rid[of])], names)


def _joined_batches(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Kinds of rows that the sort of the places leaves.
SETTLED, SEVERAL, SINGLE, ENDS = 0, 1, 2, 3


def _sorted_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, e, doc, rid, p): settled ones, heads (the first row of
    a name) of grams with several names, single heads of the partition's first
    and last gram, and a row of ends: the first and last (h, e), the heads of
    the first and of the last gram."""
    slot = TaskContext.get().partitionId()
    first = last = None  # keys
    held = None  # the only head so far of the open gram
    heads_open, heads_first, grams = 0, 0, 0

    def emit(batch, kind, chosen):
        return batch.take(pa.array(chosen)).append_column("kind", pa.array(np.full(len(chosen), kind, np.int32))).append_column(
            "slot", pa.array(np.full(len(chosen), slot, np.int32)))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, e = batch.column("h").to_numpy(), batch.column("e").to_numpy()
        new_h, new_e = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_e[1:] = new_h[1:] | (e[1:] != e[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            new_e[0] = new_h[0] or e[0] != last[1]
        else:
            first = (h[0], e[0])
        settled = np.flatnonzero(~new_e)
        if len(settled):
            yield emit(batch, SETTLED, settled)
        # Group 0 is the gram left open by the batch before, even if nothing follows of it.
        group = np.cumsum(new_h)
        if last is None:
            group -= 1  # the first gram of the partition is group 0
        heads = np.flatnonzero(new_e)
        count = np.bincount(group[heads], minlength=group[-1] + 1)
        count[0] += heads_open
        if held is not None and count[0] > 1:
            yield emit(held, SEVERAL, [0])
            held = None
        several = heads[count[group[heads]] > 1]
        if len(several):
            yield emit(batch, SEVERAL, several)
        if grams == 0:
            heads_first = int(count[0])
        if group[-1] > 0 and held is not None:  # the open gram ended with one head
            if grams == 0:
                yield emit(held, SINGLE, [0])
            held = None
        alone = heads[count[group[heads]] == 1]
        for i in alone[(group[alone] == 0) | (group[alone] == group[-1])]:
            if group[i] == group[-1]:
                held = batch.slice(int(i), 1)
            elif grams == 0:
                yield emit(batch, SINGLE, [i])
        grams += int(group[-1])
        heads_open = int(count[-1])
        last = (h[-1], e[-1])
    if held is not None:
        yield emit(held, SINGLE, [0])
    if first is not None:
        row = {"h": first[0], "e": first[1], "ext": last[0], "doc": last[1], "rid": heads_open, "p": heads_first,
               "lo": int(grams > 0), "hi": 0, "kind": ENDS, "slot": slot}
        shape = batch.schema.append(pa.field("kind", pa.int32())).append(pa.field("slot", pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in shape], schema=shape)


def _crossing(ends: list) -> tuple[list[int], list[int]]:
    """From the rows of ends: slots whose first head only continues the name of
    the slot before, and grams over several slots that have several names."""
    continued, several = [], []
    open_h = open_e = None
    total = spans = 0

    def close():
        if spans > 1 and total > 1:
            several.append(open_h)

    for r in sorted(ends, key=lambda r: r["slot"]):
        same = open_h is not None and r["h"] == open_h
        goes_on = same and r["e"] == open_e
        if goes_on:
            continued.append(r["slot"])
        heads = r["p"] - goes_on
        if same:
            total, spans = total + heads, spans + 1
        else:
            close()
            open_h, total, spans = r["h"], heads, 1
        if r["lo"]:  # a later gram is open at the end of the slot
            close()
            total, spans = r["rid"], 1
        open_h, open_e = r["ext"], r["doc"]
    close()
    return continued, several


def _named_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, start, end) of settled stretches and the heads of grams with
    several names."""
    spark = docs.sparkSession
    order = ["h", "e", "doc", "rid", "p"]
    rows = docs.mapInArrow(lambda b: _joined_batches(_places(b)), PLACES)
    table = write_once(rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order).mapInArrow(
        _sorted_places, PLACES + ", kind int, slot int"), "places")
    ends = table.where(F.col("kind") == ENDS).collect()  # one row per task
    continued, several = _crossing(ends)
    # Both lists are at most as long as there are tasks.
    crossing = F.broadcast(spark.createDataFrame([(int(h),) for h in several], "h long").withColumn("crosses", F.lit(True)))
    firsts = {r["slot"]: (r["h"], r["e"]) for r in ends}
    keys = F.broadcast(spark.createDataFrame([(s, *map(int, firsts[s])) for s in continued], "slot int, h long, e long").withColumn("goes_on", F.lit(True)))
    heads = (table.where(F.col("kind").isin(SEVERAL, SINGLE)).join(keys, ["slot", "h", "e"], "left")
             .join(crossing, "h", "left"))
    settled = table.where(F.col("kind") == SETTLED).select("rid", "lo", "hi").unionByName(
        heads.where("goes_on").select("rid", "lo", "hi"))
    several_rows = heads.where(F.col("goes_on").isNull() & ((F.col("kind") == SEVERAL) | F.col("crosses")))
    return settled.select("rid", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end")), several_rows.select(
        "h", "ext", "p", "lo", "hi", "rid")


def _wanted_starts(of: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the strings that may agree with those of another name.
    The rows are heads, once for each extent that another head shares."""
    order = np.lexsort((lo, p, of))
    of, p, lo, hi, bit = of[order], p[order], lo[order], hi[order], 1 << slot[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (p[1:] != p[:-1]) | (lo[1:] != lo[:-1])]))
    found = np.bitwise_or.reduceat(bit, new)
    of, p, lo, hi = of[new], p[new], lo[new], hi[new]
    count = hi - lo + 1
    at = np.repeat(np.arange(len(p)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[at]
    before = p[at] - start  # bytes of the string before the place
    keep = np.ones(len(at), bool)
    for k, reach in enumerate(LEFT):
        keep &= (found[at] >> k & 1 > 0) | (before < reach)
    for k, reach in enumerate(RIGHT, len(LEFT)):
        keep &= (found[at] >> k & 1 > 0) | (LENGTH - before < reach)
    return of[at[keep]], start[keep]


WINDOWS = "d1 long, d2 long, doc long, rid long, j int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = digests()
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rid, doc, heads = batch.column("rid").to_numpy(), batch.column("doc").to_numpy(), batch.column("heads")
        rows = heads.flatten()
        lengths = np.diff(heads.offsets.to_numpy())
        fields = [rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("p", "lo", "hi", "slot")]
        text, start = _wanted_starts(np.repeat(np.arange(len(lengths)), lengths), *fields)
        key = text << 32 | start  # in order of text and start
        key.sort()
        texts = [np.frombuffer(unpack.decompress(x.as_py()), np.uint8) for x in batch.column("packed")]
        for part, ends, of, shift in _joint(texts, LENGTH - 1):
            begin = np.concatenate([[0], ends[:-1]])
            # The wanted starts of each piece: it owns ``CHUNK`` places of its text.
            low = np.searchsorted(key, of << 32 | (begin + shift))
            high = np.searchsorted(key, of << 32 | np.minimum(begin + shift + CHUNK, (1 << 32) - 1))
            count = high - low
            if not count.sum():
                continue
            piece = np.repeat(np.arange(len(of)), count)
            pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[piece]
            j = key[pick] & 0xFFFFFFFF
            here = j - shift[piece]
            d = [x.of(x.sums(part), here, here + LENGTH).view(np.int64) for x in (one, two)]
            arrays = [*d, doc[of[piece]], rid[of[piece]], j.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (d1, d2, doc, rid, j): those equal to their neighbour
    before them, the partition's first row and its last key."""
    slot, last, first = TaskContext.get().partitionId(), None, None

    def emit(rid, j, kind, key=(0, 0)):
        n = len(rid)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(j, pa.int32()), pa.array([kind] * n, pa.string()), pa.array([slot] * n, pa.int32()),
             pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64())], ["rid", "j", "kind", "slot", "d1", "d2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        if last is not None:
            same[0] = (a[0], b[0]) == last
        else:
            yield emit(batch.column("rid").to_numpy()[:1], batch.column("j").to_numpy()[:1], "first", (a[0], b[0]))
        found = np.flatnonzero(same)
        if len(found):
            yield emit(batch.column("rid").to_numpy()[found], batch.column("j").to_numpy()[found], "repeat")
        last = (a[-1], b[-1])
    if last is not None:
        yield emit([0], [0], "last", last)


def _repeated_windows(packed: DataFrame, heads: DataFrame) -> DataFrame:
    """(rid, start, end) of strings equal to an earlier one among the heads' strings."""
    spark = packed.sparkSession
    mask = F.lit(0xFFFF).cast("long")
    told = heads.select("h", "p", "lo", "hi", "rid", F.posexplode(F.array(
        *[F.shiftrightunsigned("ext", 16 * k).bitwiseAND(mask) for k in range(len(LEFT) + len(RIGHT))])).alias("slot", "part"))
    key = ["h", "slot", "part"]
    shared = told.groupBy(*key).count().where("count > 1").select(*key)
    by_doc = told.join(shared, key).groupBy("rid").agg(F.collect_list(F.struct("p", "lo", "hi", "slot")).alias("heads"))
    rows = packed.join(by_doc, "rid").select("rid", "doc", "packed", "heads").mapInArrow(
        lambda b: _joined_batches(_windows(b)), WINDOWS)
    order = ["d1", "d2", "doc", "rid", "j"]
    table = write_once(rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order).mapInArrow(
        _sorted_windows, "rid long, j int, kind string, slot int, d1 long, d2 long"), "windows")
    ends: dict[int, dict] = {}
    for r in table.where("kind <> 'repeat'").select("slot", "kind", "d1", "d2").collect():  # two rows per task
        ends.setdefault(r["slot"], {})[r["kind"]] = (r["d1"], r["d2"])
    slots = sorted(ends)
    crossing = [(b,) for a, b in zip(slots, slots[1:]) if ends[a]["last"] == ends[b]["first"]]
    goes_on = F.broadcast(spark.createDataFrame(crossing, "slot int"))  # at most a row per task
    repeats = table.where("kind = 'repeat'").unionByName(
        table.where("kind = 'first'").join(goes_on, "slot", "left_semi").select(*table.columns))
    return repeats.select("rid", F.col("j").alias("start"), (F.col("j") + LENGTH).alias("end"))


def _cut(text: bytes, stretches: list[int]) -> tuple[bytes, int]:
    """What is left of a text without the stretches, and how many maximal runs
    they form."""
    spans = np.sort(np.array(stretches, np.int64))
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    begin, stop = start[first], end[np.append(first[1:], len(end)) - 1]
    edges = np.concatenate([[0], np.stack([begin, stop], axis=1).ravel(), [len(text)]])
    view = memoryview(text)
    return b"".join(view[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())), len(first)


def suffix_dedup(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, with ``with_kept``, kept (the bytes that stay).

    Texts are UTF-8 bytes, a null one is empty; strings never cross documents
    and are judged on the input. Earlier means smaller doc_id (null ones last),
    then earlier row, then earlier start; overlaps count. Rows that repeat a
    doc_id are documents of their own. An empty table gives an empty result;
    further columns are ignored. ``docs`` is read more than once and must give
    its rows in the same order each time, as a stored table does."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_of().alias("text"),
                       F.col("doc_id").cast("long").alias("doc_id"))
    settled, heads = _named_places(rows.select("rid", "doc", "text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([pack.compress(t.as_py()) for t in batch.column("text").cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc"), batch.column("doc_id"), texts],
                                             ["rid", "doc", "doc_id", "packed"])

    small = rows.mapInArrow(packed, "rid long, doc long, doc_id long, packed binary")
    repeats = _repeated_windows(small, heads)
    stretches = settled.unionByName(repeats).groupBy("rid").agg(F.collect_list(
        F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, data, gone in zip(*(batch.column(c) for c in ("doc_id", "packed", "gone"))):
                text = unpack.decompress(data.as_py())
                kept, spans = _cut(text, gone.values.to_numpy()) if gone.is_valid else (text, 0)
                row = (doc_id.as_py(), len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
            if out:
                types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return small.join(stretches, "rid", "left").select("doc_id", "packed", "gone").mapInArrow(cut, shape)
