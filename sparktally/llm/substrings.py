"""Exact removal of repeated byte strings by a sparse, distributed suffix array; repeated passages of words beside it.

Any string of ``length`` tokens (400 bytes, or 50 words) holds an anchor: the position whose next ``lead`` tokens have the
least hash of all in it. Equal strings have it at the same place, so only suffixes at anchors need be sorted. Leads that
occur once are dropped. Where everything around equal leads (the context of every string that holds the anchor) is equal
too, by a hash of 128 bits, all of those strings repeat. The rest are edges of repeats: their suffixes are
range-partitioned by their leading tokens (Spark samples the splitters), each bucket sorts them by multikey quicksort,
and the common prefixes of neighbours in suffix order, with those of the reversed text before the anchors, decide which
strings are equal, token by token. Equal leads never straddle a splitter, so neighbours across a boundary share less
than a lead and no string; a lead with very many contexts is first split by longer ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

PIECE = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What strings are made of. across: only strings of another text count, not those of the same one."""

    name: str
    length: int
    lead: int
    width: int  # bytes of a token in a context
    least_bytes: int  # shorter texts hold no string
    across: bool

    @property
    def back(self) -> int:
        """How far before its anchor a string may begin."""
        return self.length - self.lead


BYTE = Unit("byte", 400, 200, 1, 400, False)
WORD = Unit("word", 50, 10, 8, 99, True)

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(400)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: The contracts' white space. Words longer than LONG bytes are hashed one by one.
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
INK = np.ones(256, bool)
INK[[x[0] for x in SPACES]] = False
LONG = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, made once in each worker."""
    if not _POWERS:
        n = PIECE + 4 * BYTE.length
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least or greatest of each w neighbours, in two running passes."""
    f, pad = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    if n < w:
        return x[:0]
    full = np.concatenate([x, np.full(-n % w, pad, np.uint64)]).reshape(-1, w)
    left, right = f.accumulate(full, axis=1).ravel(), f.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def words_of(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of a piece of at most PIECE bytes, the same for equal words anywhere, and where it begins."""
    up, down = powers()
    buffer = np.frombuffer(piece, np.uint8)
    edges = np.flatnonzero(np.diff(INK[buffer], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTES[buffer] * up[: len(buffer)], out=sums[1:])
    values = mixed((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        values[i] = xxhash.xxh64_intdigest(piece[starts[i] : ends[i]])
    return values, starts


def token_values(text: bytes, unit: Unit) -> np.ndarray:
    """A number for each token of a text of any length."""
    if unit.width == 1:
        return BYTES[np.frombuffer(text, np.uint8)]
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            end = max(text.rfind(x, at, at + PIECE) for x in SPACES) + 1
            if not end:  # one word up to the next white space
                end = min((x for x in (text.find(x, at) for x in SPACES) if x >= 0), default=len(text))
                out.append(np.array([xxhash.xxh64_intdigest(text[at:end])], np.uint64))
                at = end
                continue
        out.append(words_of(text[at:end])[0])
        at = end
    return np.concatenate(out)


def anchors(values: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: Unit = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings inside [begin, end) stretches of tokens: positions and hashes of leads.

    begin, end: for every token, where its stretch begins and ends.
    """
    n, lead = len(values), unit.lead
    if n < unit.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    h = mixed((sums[lead:] - sums[: n - lead + 1]) * down[: n - lead + 1])
    w = unit.back + 1
    least = sliding(h, w, True)
    least[np.arange(len(least)) + unit.length > end[: len(least)]] = 0
    ahead = np.zeros(w - 1, np.uint64)
    top = sliding(np.concatenate([ahead, least, ahead]), w, False)
    at = np.nonzero((top == h) & (top > 0))[0]
    return at, h[at]


def around(data: bytes, at: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: Unit) -> np.ndarray:
    """A hash of each anchor's context and of where the anchor is in it."""
    a, b, w = np.maximum(at - unit.back, begin), np.minimum(at + unit.length, end), unit.width
    digest = xxhash.xxh3_64_intdigest
    places = zip((a * w).tolist(), (b * w).tolist(), ((at - a) * 65536 + b - at).tolist(), strict=True)
    return np.fromiter((digest(data[x:y], s) for x, y, s in places), np.uint64, len(at))


def text_anchors(texts: list[bytes], unit: Unit = BYTE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, position, lead, context's hash) arrays; short texts share a buffer, long ones are read in pieces."""
    part: list[int] = []
    size = 0
    for i in [*range(len(texts)), -1]:
        n = len(texts[i]) if i >= 0 else 0
        if part and (i < 0 or size + n + 1 > PIECE):
            lens = np.array([len(texts[j]) for j in part])
            if unit.width == 1:
                data = b"".join(texts[j] for j in part)
                values = BYTES[np.frombuffer(data, np.uint8)]
            else:
                values, starts = words_of(b" ".join(texts[j] for j in part))
                data = values.tobytes()
                lens = np.diff(np.searchsorted(starts, np.cumsum(lens + 1)), prepend=0)
            ends = np.cumsum(lens)
            of = np.repeat(np.arange(len(part)), lens)
            at, lead = anchors(values, (ends - lens)[of], ends[of], unit)
            yield np.array(part)[of[at]], at - (ends - lens)[of[at]], lead, around(data, at, (ends - lens)[of[at]], ends[of[at]], unit)
            part, size = [], 0
        if unit.least_bytes <= n < PIECE:
            part.append(i)
            size += n + 1
        elif n >= PIECE:
            values = token_values(texts[i], unit) if unit.width > 1 else None
            m = n if values is None else len(values)
            seen: list[tuple[np.ndarray, ...]] = []
            for s in range(0, m - unit.length + 1, PIECE):
                # the strings that begin in [s, s + PIECE), with the context of their anchors
                a, b = max(0, s - unit.back), min(m, s + PIECE + 2 * unit.length)
                data = texts[i][a:b] if values is None else values[a:b].tobytes()
                own = BYTES[np.frombuffer(data, np.uint8)] if values is None else values[a:b]
                at, lead = anchors(own, np.zeros(b - a, np.int64), np.full(b - a, b - a), unit)
                # beyond these the piece, not the text, ends the context; the neighbouring piece has those anchors
                here = (at + a >= s) & ((at + a < s + PIECE) | (s + PIECE > m - unit.length))
                at, lead = at[here], lead[here]
                seen.append((at + a, lead, around(data, at, np.zeros(len(at), np.int64), np.full(len(at), b - a), unit)))
            if seen:
                at, lead, kind = (np.concatenate(x) for x in zip(*seen, strict=True))
                yield np.full(len(at), i), at, lead, kind


ANCHOR = pa.schema([("tid", pa.binary()), ("pos", pa.int64()), ("lead", pa.int64()), ("around", pa.int64())])


def find_anchors(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tids = batch.column("text").to_pylist(), batch.column("tid")
            for which, at, lead, kind in text_anchors(texts, unit):
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(which)), pa.array(at), pa.array(lead.view(np.int64)), pa.array(kind.view(np.int64))], schema=ANCHOR)

    return run


def sort_suffixes(m: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix: multikey quicksort by tokens of eight bytes, ties refined token by token."""
    tokens = np.ascontiguousarray(m[:, : m.shape[1] // 8 * 8]).view(">u8")
    order, run = np.arange(len(m)), np.zeros(len(m), np.int64)
    tied = np.arange(len(m))
    for k in range(tokens.shape[1]):
        if not len(tied):
            break
        rows = order[tied]
        by = np.lexsort((tokens[rows, k], run[tied]))
        order[tied] = rows[by]
        value, own = tokens[order[tied], k], run[tied]
        new = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))
        first = tied[new][np.cumsum(new) - 1]
        run[tied] = first
        many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        tied = tied[many]
    return order


def shared(rows: np.ndarray) -> np.ndarray:
    """How many leading tokens each row of a sorted token matrix has in common with the row before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 8192):
        b = min(len(rows), a + 8192)
        other = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def as_bytes(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(np.uint8).reshape(len(m), -1)


def reach(m: np.ndarray, ahead: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray, done: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """For each row of contexts the nearest and the farthest offset before the anchor at which a string repeats; -1: none.

    The rows are in suffix order and ``ahead`` is what each has in common with the one before. Row r's strings begin
    low[r] to high[r] tokens before its anchor. The string that begins ``offset`` tokens before it is equal in two rows
    if their suffixes agree on the rest of it and their reversed prefixes on ``offset`` tokens: in each of the two sorted
    orders such rows are a run that no shorter common prefix interrupts. text: a number for each row's text; done: the
    row stands for equal contexts that are settled.
    """
    n = len(m)
    near, far = np.full(n, -1), np.full(n, -1)
    before = np.ascontiguousarray(m[:, : unit.back][:, ::-1])
    order = sort_suffixes(as_bytes(before))
    behind = shared(before[order])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for offset in range(unit.back, -1, -1):
        rows = np.nonzero((low <= offset) & (offset <= high))[0]
        if len(rows) < 2:
            continue
        run = np.cumsum(ahead < unit.length - offset)[rows] * n + np.cumsum(behind < offset)[place[rows]]
        by = np.lexsort((text[rows], run)) if unit.across else np.argsort(run, kind="stable")
        first = np.nonzero(np.append(True, run[by][1:] != run[by][:-1]))[0]
        size = np.diff(np.append(first, len(rows)))
        again = size > 1
        if unit.across:
            again &= (text[rows][by][first] != text[rows][by][first + size - 1]) | (np.add.reduceat(done[rows][by].astype(int), first) > 0)
        hit = rows[by[np.repeat(again, size)]]
        near[hit] = offset
        far[hit] = np.maximum(far[hit], offset)
    return near, far


SPAN = pa.schema([("tid", pa.binary()), ("from", pa.int64()), ("to", pa.int64())])


def compare(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One bucket: sorts its suffixes, then compares those of equal lead, in groups that bound the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        m = np.frombuffer(b"".join(rows.column("context").to_pylist()), np.uint8 if unit.width == 1 else np.uint64).reshape(rows.num_rows, -1)
        order = sort_suffixes(as_bytes(m[:, unit.back :]))
        ahead = shared(m[order, unit.back :])
        fresh = [*np.nonzero(ahead < unit.lead)[0].tolist(), len(order)]
        tid = rows.column("tid").to_numpy()
        text = np.unique(tid, return_inverse=True)[1]
        pos, low, high = (rows.column(c).to_numpy() for c in ("pos", "low", "high"))
        done, a = rows.column("done").to_numpy(zero_copy_only=False), 0
        for b, after in zip(fresh[1:], [*fresh[2:], None], strict=True):
            if after is None or after - a > 20_000:
                own = order[a:b]
                near, far = reach(m[own], ahead[a:b], low[own], high[own], text[own], done[own], unit)
                hit = (far >= 0) & ~done[own]
                yield pa.RecordBatch.from_arrays([pa.array(tid[own][hit], pa.binary()), pa.array(pos[own][hit] - far[hit]), pa.array(pos[own][hit] - near[hit] + unit.length)], schema=SPAN)
                a = b

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text as bytes): tid is 128 bits of the text's hash, so that all copies share their spans."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tid"), text.alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """numbered() with the text compressed: what shuffles must carry is a third of it."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array([pack(x) for x in batch.column("text").to_pylist()], pa.binary())], schema=schema)

    return numbered(docs).mapInArrow(run, "doc_id long, tid binary, packed binary")


CONTEXT = pa.schema([("unit", pa.string()), ("tid", pa.binary()), ("pos", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("done", pa.bool_()), ("context", pa.binary())])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the contexts out of packed texts, filled up with zeros where the text ends; low, high: its whole strings."""
    for batch in batches:
        out: list[tuple] = []
        for tid, places, blob in zip(*(batch.column(c).to_pylist() for c in ("tid", "places", "packed")), strict=True):
            text = zstandard.decompress(blob)
            data = {BYTE: text}
            for p in places:
                unit, pos = WORD if p["unit"] == WORD.name else BYTE, p["pos"]
                if unit not in data:
                    data[unit] = token_values(text, unit).tobytes()
                w = unit.width
                a, b = min(unit.back, pos), min(unit.length, len(data[unit]) // w - pos)
                context = b"\0" * ((unit.back - a) * w) + data[unit][(pos - a) * w : (pos + b) * w] + b"\0" * ((unit.length - b) * w)
                out.append((unit.name, tid, pos, max(0, unit.length - b), a, p["done"], context))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)


def several(unit: Unit, tid: Column) -> Column:
    """Whether a group's rows make its string a repeat: two of them, or two of different texts."""
    return F.min(tid) != F.max(tid) if unit.across else F.count("*") > 1


def several_contexts(unit: Unit, tid: Column) -> Column:
    """The same where a row that is ``done`` stands for several texts."""
    return several(unit, tid) | F.max("done") if unit.across else several(unit, tid)


def refine(rows: DataFrame, most: int, unit: Unit = BYTE) -> tuple[DataFrame, DataFrame | None]:
    """Splits the contexts of leads that have more than ``most`` of them: (contexts to compare, spans settled on the way).

    The strings that begin ``first`` to ``last`` tokens before the anchor all hold the tokens between; contexts that
    don't share those have no string in common. Each round halves the range, so there are at most eight.
    """
    w, at, size = unit.width, unit.back, unit.length
    common = F.substring("context", (at - F.col("first")) * w + 1, (size - F.col("last") + F.col("first")) * w)
    whole = F.substring("context", (at - F.col("last")) * w + 1, (size - F.col("first") + F.col("last")) * w)
    spans, ready, now = None, [], rows.withColumns({"first": F.lit(0), "last": F.lit(at)})
    for _ in range(9):
        now = now.withColumn("common", common)
        crowded = now.groupBy("common").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("common", F.lit(True).alias("crowded"))
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            break
        split = now.join(crowded, "common", "left")
        ready.append(split.where("crowded is null").drop("crowded"))
        middle = ((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("first").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("last").alias("b"))))
        part = split.where("crowded").withColumn("half", halves).withColumns({"first": F.col("half.a"), "last": F.col("half.b")}).where("first <= last and low <= last and high >= first").drop("half", "crowded", "common")
        cut_off = (F.col("low") > F.col("first")) | (F.col("high") < F.col("last"))
        alone = F.concat(F.lit("1").cast("binary"), "tid", F.col("pos").cast("string").cast("binary"))
        part = written(part.withColumns({"kind": F.when(cut_off, alone).otherwise(F.concat(F.lit("0").cast("binary"), whole)), "common": common}), "half")
        keys = ["common", "first", "last", "kind"]
        counts = part.groupBy(*keys).agg(several_contexts(unit, F.col("tid")).alias("repeats"), F.min(F.struct("tid", "pos")).alias("one"))
        told = part.join(counts, keys)
        settled = told.where("repeats and not done").select("tid", (F.col("pos") - F.col("last")).alias("from"), (F.col("pos") - F.col("first") + size).alias("to"))
        spans = settled if spans is None else spans.unionByName(settled)
        mixed_keys = counts.groupBy(*keys[:3]).agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
        now = told.where("one.tid = tid and one.pos = pos").withColumn("done", F.col("done") | F.col("repeats")).join(mixed_keys, keys[:3], "left_semi").select(*rows.columns, "first", "last")
    # with no round left each row has one string, and equal ones are one row
    out = ready[0] if ready else now
    for x in [*ready[1:], now] if ready else ():
        out = out.unionByName(x.withColumn("common", common))
    return out, spans


def settled(docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """(tid, from, to) of strings whose whole context repeats, and (tid, unit, pos, done) of the contexts left to compare.

    Contexts are equal if the 64-bit hashes of their leads and of the whole are: two hash functions, so that unrelated
    contexts have 128 bits to differ in, and those of one lead 64.
    """
    found = numbered(docs).where(F.octet_length("text") >= unit.least_bytes).mapInArrow(find_anchors(unit), "tid binary, pos long, lead long, around long")
    found = written(found, "anchors")
    # partial counts first: a lead that a third of all texts hold is one row from each task
    leads = found.groupBy("lead").agg(F.count("*").alias("many"), (F.min("around") == F.max("around")).alias("alike")).where("many > 1")
    # a table of its own: between two plain shuffles Spark can split what a frequent lead brings to the join
    leads = written(leads.drop("many"), "leads")
    again = written(found.join(leads, "lead"), "again")
    discard(found, leads)
    alike, mixed_leads, kind = again.where("alike"), again.where("not alike"), ["lead", "around"]
    if unit.across:  # equal contexts may all be in one text
        alike, mixed_leads = alike.limit(0), again
    kinds = mixed_leads.groupBy(*kind).agg(several(unit, F.xxhash64("tid")).alias("done"), F.count("*").alias("same"), F.min(F.struct("tid", "pos")).alias("one"))
    kinds = written(kinds, "kinds")
    repeats = kinds.where("done")
    # at most 4,096 kinds have a 4,096th of the rows; the others can't make a partition hot
    hot = F.broadcast(repeats.where(F.col("same") * 4096 > max(1, again.count())).select(*kind))
    rest = mixed_leads.join(hot, kind, "left_anti").join(repeats.select(*kind), kind, "left_semi")
    span = ["tid", (F.col("pos") - unit.back).alias("from"), (F.col("pos") + unit.length).alias("to")]
    spans = alike.select(*span).unionByName(mixed_leads.join(hot, kind, "left_semi").select(*span)).unionByName(rest.select(*span))
    # one text of each kind of context; a lead with one kind only has nothing left to compare
    if unit.across:
        kinds = kinds.join(kinds.groupBy("lead").agg(several_contexts(unit, F.xxhash64("one.tid")).alias("mixed"), F.count("*").alias("n")).where("mixed and n > 1").select("lead"), "lead", "left_semi")
    return spans, kinds.select("one.tid", F.lit(unit.name).alias("unit"), "one.pos", "done")


def repeated_spans(docs: DataFrame, crowd: int = 50_000, bucket_rows: int = 40_000) -> DataFrame:
    """(tid, unit, from, to): stretches of texts that strings occurring elsewhere cover; they may overlap, and exceed the text.

    unit ``byte``: strings of 400 bytes that start anywhere else. unit ``word``: passages of 50 words that another text holds.
    """
    units = (BYTE, WORD)
    first = [settled(docs, unit) for unit in units]
    places = first[0][1].unionByName(first[1][1])
    counts = {r.unit: r.n for r in places.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    places = places.groupBy("tid").agg(F.collect_list(F.struct("unit", "pos", "done")).alias("places"))
    texts = packed(docs.where(F.octet_length("text") >= min(unit.least_bytes for unit in units))).select("tid", "packed").dropDuplicates(["tid"])
    there = places.join(texts, "tid").select("tid", "places", "packed")
    edges = there.mapInArrow(contexts, "unit string, tid binary, pos long, low int, high int, done boolean, context binary")
    edges = written(edges, "contexts")
    out = None
    for unit, (spans, _) in zip(units, first, strict=True):
        own, more = refine(edges.where(F.col("unit") == unit.name).drop("unit"), crowd, unit)
        bounds = {"low": F.greatest("low", "first"), "high": F.least("high", "last")}
        buckets = max(1, math.ceil(counts.get(unit.name, 0) / bucket_rows))
        own = own.withColumns(bounds).where("low <= high").repartitionByRange(buckets, "common").select("tid", "pos", "low", "high", "done", "context")
        spans = spans.unionByName(own.mapInArrow(compare(unit), "tid binary, from long, to long"))
        spans = (spans if more is None else spans.unionByName(more)).select("tid", F.lit(unit.name).alias("unit"), "from", "to")
        out = spans if out is None else out.unionByName(spans)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_passage_words, kept) for each row of ``docs``; kept: the bytes that are left.

    Each byte goes that a string of 400 bytes covers which starts anywhere else too, also in the same text; judged on
    the input. n_passage_words: how many words lie in passages of 50 words or more that another row holds too (these may
    be shorter than 400 bytes and then stay). Null text: no bytes. Texts below 400 bytes keep all. Repeated rows are
    copies of each other. Texts of any length are read whole, in pieces. Other columns, whatever their names, are
    ignored. No rows: none.
    """
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs)
    # copies of a text hold all of each other's passages
    copied = numbered(docs).where(F.octet_length("text") >= WORD.least_bytes).groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")
    spans = spans.unionByName(copied.select("tid", F.lit(WORD.name).alias("unit"), F.lit(0).cast("long").alias("from"), F.lit(1 << 60).alias("to"))).distinct()
    by_text = written(spans.groupBy("tid").agg(F.collect_list(F.struct("unit", "from", "to")).alias("spans")), "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_passage_words", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, blob, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "spans")), strict=True):
                text = zstandard.decompress(blob)
                gone = merged([(max(0, s["from"]), min(len(text), s["to"])) for s in own or () if s["unit"] == BYTE.name])
                edges = [0, *(x for s in gone for x in s), len(text)]
                words, passages = 0, [(s["from"], s["to"]) for s in own or () if s["unit"] == WORD.name]
                if passages and (n := len(text.split())) >= WORD.length:
                    words = sum(b - a for a, b in merged([(max(0, a), min(n, b)) for a, b in passages]))
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(text), sum(b - a for a, b in gone), len(gone), words, kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    joined = packed(docs).join(by_text, "tid", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: the words in passages of over 50 words that other documents hold."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
