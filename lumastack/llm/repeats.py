"""Finding repeated windows: anchors that occur in several documents, and the segments around them.

Both passage operators look for windows of ``k`` units (words or bytes) that
also start in a document with a smaller id. Nearly all windows occur once, so
the exact work is done on few of them:

1. Every window is stood for by its anchor, the least hash among its m-grams.
   Equal windows have equal anchors, so a window whose anchor occurs in one
   row only can't be repeated. ``shared_anchors`` finds per row the anchors
   that other rows have too; it shuffles packed anchors, no text.
2. ``segments`` cuts documents into runs of windows with shared anchors, named
   by their content: ``skey``, ``doc_id``, ``start`` and ``windows``.
3. The operator decides for each distinct segment which windows start in which
   smallest document (de Bruijn graph, suffix arrays).
4. ``removed_spans`` joins that back to the occurrences.

Rows are told apart by ``rid``, a hash of doc_id and text, so two texts under
one doc_id keep their own spans. No step drops or caps anything; hashes only
choose anchors and name rows and segments (128 bits of their content). Texts are
hashed in blocks of ``BLOCK`` bytes, so memory does not grow with their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, integral

#: Bytes of text that are hashed together: short texts are joined to blocks, long ones are cut.
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Anchors that a task gathers before it hands them on.
FLUSH = 400_000
#: Anchor groups get about this many anchors each.
GROUP = 200_000
#: A segment has at most this many runs of windows.
LONGEST = 64
_LOW = np.uint64(0xFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, up to a few blocks."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK + 4096)
            if size > 4 * BLOCK:  # one giant word: not kept
                return _powers(_BASE, n), _powers(_INVERSE, n)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= up[: len(data)]
    np.cumsum(x, out=sums[1:])
    return sums, down


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[starts:ends], alike for equal runs wherever they stand."""
    sums, down = _prefix_sums(data)
    return mix64((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """64-bit hash of each m consecutive bytes; ``run_hashes`` of them all."""
    sums, down = _prefix_sums(data)
    out = sums[m:] - sums[:-m]
    out *= down[: len(out)]
    return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in time linear in len(x)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words."""
    edge = np.empty(len(data) + 2, dtype=bool)
    edge[0] = edge[-1] = False
    np.not_equal(data, 0x20, out=edge[1:-1])
    edge[1:-1] &= (data - np.uint8(9)) > 4
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[0::2], at[1::2]


@dataclass(frozen=True)
class Anchors:
    """Of a block of texts: the anchor of each window, where the texts' windows begin, and for bytes where each window stands among ``grams``."""

    value: np.ndarray
    bounds: np.ndarray
    place: np.ndarray
    grams: np.ndarray


@dataclass(frozen=True)
class Units:
    """What a window counts: ``k`` units, anchored by m-grams of ``m`` units."""

    kind: str
    k: int
    m: int
    #: A run of candidate windows is cut at anchors whose hash is a multiple of this, so about every so many anchors; 1: at each.
    cut: int = 1

    def pieces(self, raw: bytes) -> list[tuple[int, bytes]]:
        """(first window, bytes): a text cut so that a piece has about a block's bytes and each window lies in one piece."""
        if len(raw) <= BLOCK:
            return [(0, raw)]
        if self.kind == "byte":
            return [(at, raw[at : at + BLOCK + self.k - 1]) for at in range(0, max(1, len(raw) - self.k + 1), BLOCK)]
        starts, ends = words_of(np.frombuffer(raw, dtype=np.uint8))
        step = max(1, BLOCK // 8)
        return [(at, raw[starts[at] : ends[min(at + step + self.k - 1, len(ends)) - 1]]) for at in range(0, max(1, len(starts) - self.k + 1), step) if len(starts)]

    def anchors(self, texts: list[bytes]) -> Anchors:
        """The anchor of each window of each text, in order: the least hash among its m-grams."""
        joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        if self.kind == "word":
            starts, stops = words_of(joined)
            grams = run_hashes(joined, starts, stops)
            words, n = grams, len(starts) - self.m + 1
            if n > 0:
                grams = words[:n].copy()
                for i in range(1, self.m):
                    grams *= np.uint64(_BASE)
                    grams += words[i : n + i]
                grams = mix64(grams)
            last = np.searchsorted(starts, ends)
            first = np.concatenate([[0], last[:-1]])
        else:
            last, first = ends, np.concatenate([[0], ends[:-1] + 1])
            grams = gram_hashes(joined, self.m) if len(joined) >= self.m else joined[:0].astype(np.uint64)
        counts = np.maximum(last - first - self.k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], counts)
        least = sliding_min(grams, self.k - self.m + 1) if bounds[-1] else grams[:0]
        return Anchors(least[place], bounds, place, grams)

    def content(self, raw: bytes) -> Callable[[int, int], bytes]:
        """How to get the content of ``units`` units from unit ``start``: words joined by a blank, or bytes."""
        if self.kind == "byte":
            return lambda start, units: raw[start : start + units]
        words = raw.split()
        return lambda start, units: b" ".join(words[start : start + units])


def blocks(units: Units, texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(owners, first windows, pieces) of about a block's bytes at a time, from (owner, text)."""
    held: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for owner, raw in texts:
        for at, piece in units.pieces(raw):
            for column, value in zip(held, (owner, at, piece), strict=True):
                column.append(value)
            size += len(piece) + 1
            if size >= BLOCK:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def anchor_runs(anchors: np.ndarray, bounds: np.ndarray, longest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of equal anchors within each text, of at most ``longest`` windows if given."""
    if not len(anchors):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.empty(len(anchors), dtype=bool)
    np.not_equal(anchors[1:], anchors[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(anchors)]] = True
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(anchors))
    if longest and (end - first).max() > longest:
        parts = -(-(end - first) // longest)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = np.repeat(first, parts) + nth * longest, np.repeat(end, parts)
        end = np.minimum(first + longest, end)
    return first, end


def among(owner: np.ndarray, value: np.ndarray, marks: np.ndarray, mark_owner: np.ndarray) -> np.ndarray:
    """Which (owner, low 32 bits of value) are among the marks."""
    have = np.sort((mark_owner.astype(np.uint64) << np.uint64(32)) | (marks.view(np.uint64) & _LOW))
    ask = (owner.astype(np.uint64) << np.uint64(32)) | (value & _LOW)
    if not len(have):
        return np.zeros(len(ask), dtype=bool)
    return have[np.minimum(np.searchsorted(have, ask), len(have) - 1)] == ask


def row_id(doc_id: str, text: str) -> Column:
    """A row's name: null where the doc_id is null, alike for repeated rows."""
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id), F.col(text)))


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id long, rid long, z binary``: whole texts as zstandard frames (null: null), so that shuffles move less. With ``carry`` also ``row struct`` of all columns but the text, by position."""
    rest = [carried(docs, text).alias("row")] * carry
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_id(doc_id, text).alias("rid"), F.col(text).cast("binary").alias("z"), *rest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            frames = [press(v.as_py()) if v.is_valid else None for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(frames, pa.binary()), *batch.columns[3:]], ["doc_id", "rid", "z", "row"][: 3 + carry])

    return rows.mapInArrow(pack, rows.schema)


def _groups(docs: DataFrame, units: Units, text: str) -> int:
    density = 2 / (units.k - units.m + 2) / (6 if units.kind == "word" else 1)
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("double"))).first()[0] or 0
    return max(8, int(size * density / GROUP))


def shared_anchors(rows: DataFrame, units: Units, rid: str = "rid", text: str = "text") -> DataFrame:
    """``rid, anchor``: each row's anchors that another row has too, several times perhaps.

    Tasks gather the (anchor, row) pairs of some texts. An anchor that several
    of these have is known to be shared: its rows are told at once, and one pair
    goes on to the anchor's group, so that an anchor of a third of all texts
    sends one pair a batch. Groups number in proportion to the text. A pair in a
    group is two 32-bit words besides the group's number, so unlike anchors may
    be taken for equal at times; that only adds candidates. Rows with a null rid
    or text take no part.
    """
    groups = _groups(rows, units, text)

    def emit(kind: int, group: np.ndarray, anchor: np.ndarray, doc: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(group, kind="stable")
        group, anchor, doc, known = group[order], anchor[order], doc[order], known[order]
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        lo, hi = [0, *cuts.tolist()], [*cuts.tolist(), len(group)]
        cut = lambda a: [a[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(group[lo].astype(np.int64)),
                pa.array([kind] * len(lo), pa.int32()),
                pa.array(cut((anchor & _LOW).astype(np.uint32)), pa.binary()),
                pa.array(cut(doc), pa.binary()),
                pa.array(cut(known), pa.binary()),
            ],
            ["g", "kind", "low", "doc", "known"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            keep = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            anchor, doc = anchor[keep], doc[keep]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            run = np.cumsum(first) - 1
            many = np.diff(np.append(np.flatnonzero(first), len(doc))) > 1
            told = many[run]
            if told.any():
                yield emit(1, (mix64(doc[told].view(np.uint64)) % np.uint64(groups)).astype(np.int64), anchor[told], doc[told], np.ones(int(told.sum()), dtype=np.uint8))
            part = mix64(anchor[first] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(groups)
            yield emit(0, part.astype(np.int64), anchor[first], doc[first], many.astype(np.uint8))

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for owner, _, pieces in blocks(units, ((i, v.as_py()) for i, v in enumerate(batch.column(1)))):
                found = units.anchors(pieces)
                first, _ = anchor_runs(found.value, found.bounds)
                if len(first):
                    of = np.searchsorted(found.bounds, first, side="right") - 1
                    held.append((found.value[first], names[np.asarray(owner)[of]].astype(np.int64)))
                    size += len(first)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        get = lambda name, dtype, kind: np.frombuffer(b"".join(v for v, k in zip(table.column(name).to_pylist(), kinds, strict=True) if k == kind), dtype=dtype)
        docs_, marks = [get("doc", np.int64, 1)], [get("low", np.uint32, 1)]
        low, doc, known = get("low", np.uint32, 0), get("doc", np.int64, 0), get("known", np.uint8, 0)
        if len(low):
            order = np.argsort(low, kind="stable")
            low, doc, known = low[order], doc[order], known[order]
            first = np.concatenate([[True], low[1:] != low[:-1]])
            run = np.cumsum(first) - 1
            least, most = np.minimum.reduceat(doc, np.flatnonzero(first)), np.maximum.reduceat(doc, np.flatnonzero(first))
            more = ((least != most) | (np.maximum.reduceat(known, np.flatnonzero(first)) > 0))[run]
            docs_.append(doc[more])
            marks.append(low[more])
        return pa.table({"rid": pa.array(np.concatenate(docs_)), "anchor": pa.array(np.concatenate(marks).astype(np.int64))})

    named = rows.select(F.col(rid), F.col(text).cast("binary")).where(F.col(rid).isNotNull() & F.col(text).isNotNull())
    pairs = named.mapInArrow(gather, "g long, kind int, low binary, doc binary, known binary")
    return pairs.groupBy("g").applyInArrow(settle, "rid long, anchor long")


def marked(shared: DataFrame) -> DataFrame:
    """One row per rid; its anchors are bounded by its own text."""
    return shared.groupBy("rid").agg(F.collect_list("anchor").alias("anchors"))


SEGMENTS = "skey binary, anchor long, doc_id long, rid long, start int, windows int, content binary"
_SEGMENT_KINDS = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def record_batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def segments(packed: DataFrame, shared: DataFrame, units: Units) -> DataFrame:
    """Runs of windows with shared anchors: ``skey, anchor, doc_id, rid, start, windows, content``; ``anchor`` is the first window's.

    A run ends where a window's anchor is not shared, is cut at anchors that
    their own hash picks, so that a passage gives the same segments wherever it
    stands, and after ``LONGEST`` anchors. ``start`` is the first window's first
    unit; ``skey`` names the content (128 bits). Of equal segments in one batch
    of a task only the first brings its content; the others' is null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_128_digest

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[tuple] = []
            seen: set[bytes] = set()
            docs, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(3)
            marks, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            mark_owner = np.repeat(np.arange(len(sizes)), sizes)
            mark_at = np.concatenate([[0], np.cumsum(sizes)])
            for owner, offset, pieces in blocks(units, ((i, unpack(z.as_py())) for i, z in enumerate(batch.column(2)) if z.is_valid)):
                found = units.anchors(pieces)
                first, end = anchor_runs(found.value, found.bounds)
                of = np.searchsorted(found.bounds, first, side="right") - 1
                owners = np.asarray(owner)[of] if len(of) else of
                span = slice(mark_at[owner[0]], mark_at[owner[-1] + 1])
                kept = np.flatnonzero(among(owners, found.value[first], marks[span], mark_owner[span]))
                if not len(kept):
                    continue
                heads_value = found.value[first[kept]]
                fresh = np.concatenate([[True], (kept[1:] != kept[:-1] + 1) | (of[kept[1:]] != of[kept[:-1]])]) | ((heads_value >> np.uint64(40)) % np.uint64(units.cut) == 0)
                nth = np.arange(len(kept)) - np.maximum.accumulate(np.where(fresh, np.arange(len(kept)), 0))
                heads = np.flatnonzero(fresh | (nth % LONGEST == 0))
                tails = np.append(heads[1:], len(kept)) - 1
                base = found.bounds[of[kept[heads]]]
                columns = (heads_value[heads].view(np.int64), of[kept[heads]], first[kept[heads]] - base, end[kept[tails]] - base)
                text, of_text = None, -1
                for anchor, piece, lo, hi in zip(*[c.tolist() for c in columns], strict=True):
                    if piece != of_text:
                        text, of_text = units.content(pieces[piece]), piece
                    value = text(lo, hi - lo + units.k - 1)
                    key = xxh3_128_digest(value)
                    i = owner[piece]
                    rows.append((key, anchor, docs[i], rids[i], offset[piece] + lo, hi - lo, None if key in seen else value))
                    seen.add(key)
                if len(rows) >= 10_000:
                    yield record_batch(rows, _SEGMENT_KINDS, SEGMENTS)
                    rows = []
            yield record_batch(rows, _SEGMENT_KINDS, SEGMENTS)

    return packed.join(marked(shared), "rid").select("doc_id", "rid", "z", "anchors").mapInArrow(cut, SEGMENTS)


def distinct_segments(found: DataFrame) -> DataFrame:
    """One row per distinct segment: ``skey, anchor, origin struct<doc_id, rid, start>, last, windows, content``.

    ``origin`` is where it starts in the smallest document that has it, ``last``
    the largest such document. Grouped minima are combined before the shuffle,
    whatever number of documents share a segment.
    """
    return found.groupBy("skey").agg(
        F.first("anchor").alias("anchor"),
        F.min(F.struct("doc_id", "rid", "start")).alias("origin"),
        F.max("doc_id").alias("last"),
        F.first("windows").alias("windows"),
        F.max("content").alias("content"),
    )


def removed_spans(found: DataFrame, origins: DataFrame, k: int) -> DataFrame:
    """``rid, spans array<struct<lo, hi>>``: the units of each row that repeated windows cover (spans may overlap).

    ``origins`` has, per distinct segment, ``skey`` and ``runs
    array<struct<at, n, first>>``: n windows from window ``at`` on start in
    document ``first`` and no smaller one.
    """
    hits = found.select("skey", "doc_id", "rid", "start").join(origins, "skey")
    mine = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    spans = F.transform(mine, lambda r: F.struct((F.col("start") + r["at"]).alias("lo"), (F.col("start") + r["at"] + r["n"] + k - 1).alias("hi")))
    spans = hits.select("rid", spans.alias("spans")).where(F.size("spans") > 0)
    # copies of a row have the same spans, which count once
    return spans.groupBy("rid").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps)[:n] > 0


def cleaned_documents(packed: DataFrame, spans: DataFrame, units: Units) -> DataFrame:
    """Remove the spans: ``doc_id, units, n_removed, n_spans, kept_sha256``.

    If ``packed`` carries rows, also ``kept string`` and ``row``: what is left
    (words joined by one blank, or bytes without torn characters), or the text
    as it was if nothing is removed.
    """
    carry = "row" in packed.columns
    joined = packed.join(spans, "rid", "left").select("doc_id", "z", "spans", *["row"] * carry)
    numbers = {c: F.lit(0).cast("long") for c in ("units", "n_removed", "n_spans")}
    schema = joined.drop("z", "spans", "row").withColumns({**numbers, "kept_sha256": F.lit(""), **({"kept": F.lit(None).cast("string")} if carry else {})}).schema
    if carry:
        schema = schema.add(joined.schema["row"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                raw = unpack.decompress(z.as_py()) if z.is_valid else b""
                words = raw.split() if units.kind == "word" else None
                n, cut, runs = len(raw if words is None else words), 0, 0
                kept = raw if words is None else b" ".join(words)
                if spans_.is_valid:
                    ends = spans_.values
                    gone = covered(ends.field("lo").to_numpy(), ends.field("hi").to_numpy(), n)
                    cut, runs = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(n and gone[0]))
                    if words is None:
                        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    else:
                        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                text = (kept if cut else raw).decode(errors="ignore") if carry and z.is_valid else None
                rows.append((n, cut, runs, hashlib.sha256(kept).hexdigest(), text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + carry]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            names = ["doc_id", "units", "n_removed", "n_spans", "kept_sha256", "kept", "row"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], names[: 5 + 2 * carry])

    return joined.mapInArrow(clean, schema)


def checked(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs``, if its ids can be compared as whole numbers; else an error rather than ids that become null."""
    integral(docs, doc_id)
    return docs
