"""Packing token pieces into fixed windows by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, integral, materialise, spread

CAPACITY = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of distinct units and their ids that a task keeps; beyond it those go that weren't met again since they were learned.
KEPT_BYTES = 24 << 20
#: Characters of the texts that are encoded together.
BATCH_CHARS = 1 << 20
#: Units, other than words, that are encoded as one text: the tokenizer keeps some hundred bytes for each of its tokens.
LINES = 2_000

#: A blank between blanks (or at the end): only there a cut before a single blank could part a token.
_UNSAFE = re.compile(r"\s \s|\s $")
#: What ends a word for the tokenizer, whatever follows.
_CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_VISIBLE = np.array([32 < i < 127 for i in range(256)])
#: Units that are one word to the tokenizer, so that its model can be asked without the steps before it.
_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [i for i in range(256) if i not in plain]
    return {**{i: chr(i) for i in plain}, **{i: chr(256 + at) for at, i in enumerate(others)}}


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where texts, which stand between blanks, can be cut without parting a token: before a blank, around a single line feed between
    visible characters, and between a letter and a closing mark. C3 leads the letters from U+00C0, which are not blank."""
    cut = raw == 0x20
    lines = np.flatnonzero(raw == 0x0A)
    lines = lines[(_VISIBLE[raw[lines - 1]] | (raw[lines - 2] == 0xC3)) & (_VISIBLE[raw[lines + 1]] | (raw[lines + 1] == 0xC3))]
    cut[lines] = cut[lines + 1] = True
    marks = np.flatnonzero(_CLOSING[raw])
    before = raw[marks - 1]
    cut[marks[_LETTER[before] | ((raw[marks - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))]] = True
    return cut


class UnitEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by the given tokenizer.

    The byte-level pre-tokenizer never joins what stands before a blank with
    the blank, if not both sides are blank; nor a letter with a closing mark
    after it. Texts are cut there (``_cuts``), each distinct unit is encoded
    once while it is kept, and ids are dealt to the places by index; other texts
    are encoded whole. ``KEPT_BYTES`` bounds the memory; the encoder ends with its task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: the vocabulary writes every byte as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        #: Units, where their ids begin in ``ids`` and how many they are, and whether they were met again.
        self.units = pa.array([], pa.binary())
        self.sizes, self.ids, self.again = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encoded(self, units: pa.BinaryArray) -> list[list[int]]:
        """The ids of each unit: words by the model, others as lines of one text, whose ids are dealt out again by their bytes."""
        out: list = [None] * len(units)
        word = pc.match_substring_regex(units.cast(pa.string()), _WORD).to_numpy(zero_copy_only=False)
        lines, tokenize = [], self.model.tokenize
        for i, (u, alone) in enumerate(zip(units.to_pylist(), word.tolist(), strict=True)):
            if alone:
                out[i] = [t.id for t in tokenize(u.decode("latin-1").translate(self.characters))]
                continue
            p = u.decode()
            if not p[-1].isspace() and (not p[0].isspace() or p[0] == " " and not p[1].isspace()):
                lines.append((i, p, len(u)))
            else:
                out[i] = self._ids(p).tolist()
        for at in range(0, len(lines), LINES):
            part = lines[at : at + LINES]
            ids = self._ids("\n".join([p for _, p, _ in part]))
            ends = np.cumsum(np.array([n for *_, n in part], dtype=np.int64) + 1) - 1
            stops = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            starts = np.concatenate([[0], stops[:-1] + 1])
            for (i, *_), lo, hi in zip(part, starts.tolist(), stops.tolist(), strict=True):
                out[i] = ids[lo:hi].tolist()
        return out

    def _places(self, units: pa.BinaryArray) -> np.ndarray:
        """Where distinct units are kept; those that aren't yet are encoded."""
        found = pc.index_in(units, value_set=self.units)
        places, new = pc.fill_null(found, -1).to_numpy().astype(np.int64), found.is_null()
        self.again[places[places >= 0]] = True
        missing = units.filter(new)
        ids = self._encoded(missing)
        places[places < 0] = np.arange(len(ids)) + len(self.units)
        self.units = pa.concat_arrays([self.units, missing])
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in ids], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), dtype="<u4")])
        self.again = np.concatenate([self.again, np.zeros(len(ids), dtype=bool)])
        return places

    def _trim(self) -> None:
        """Drop units over the bound: those not met again; all, if that isn't half."""
        if self.units.nbytes + self.ids.nbytes <= KEPT_BYTES:
            return
        keep = self.again
        units, ids = self.units.filter(pa.array(keep)), self.ids[np.repeat(keep, self.sizes)]
        if units.nbytes + ids.nbytes > KEPT_BYTES // 2:
            keep = np.zeros(len(keep), dtype=bool)
            units, ids = units[:0], ids[:0]
        self.units, self.ids, self.sizes = pa.concat_arrays([units]), ids, self.sizes[keep]
        self.again = np.zeros(len(self.sizes), dtype=bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, parts = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if "<|" in text or _UNSAFE.search(text):
                out[i] = self._ids(text).tobytes()
            elif text:
                parts[i] = text.encode()
        if not parts:
            return out
        data = b"  " + b" ".join(parts.values()) + b"  "
        raw = np.frombuffer(data, dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts.values()]) + 1
        begins = np.concatenate([[2], ends[:-1] + 1])
        cut = _cuts(raw)
        cut[begins] = cut[ends] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.sizes[places]
        lo, hi = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        # the blanks between texts are no text's
        sizes[:2] = sizes[hi] = sizes[-1] = 0
        reached = np.concatenate([[0], np.cumsum(sizes)])
        first = (np.cumsum(self.sizes) - self.sizes)[places]
        ids = self.ids[np.repeat(first - reached[:-1], sizes) + np.arange(reached[-1])]
        for i, a, b in zip(parts, reached[lo].tolist(), reached[hi].tolist(), strict=True):
            out[i] = ids[a:b].tobytes()
        self._trim()
        return out

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts and cut them every ``capacity`` ids: ``doc_id, row, start, length, ids_crc32, doc_tokens``; row tells repeated doc_ids apart."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pa.default_memory_pool().release_unused()  # what the worker holds of earlier tasks
        encoder, end = UnitEncoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names, texts = (batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                out: list[tuple] = []
                for doc, row, ids in zip(names[0][lo:hi], names[1][lo:hi], encoder.encode([v or "" for v in texts[lo:hi].to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    out += [(doc, row, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    integral(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def fill_closest(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of at most ``counts`` of ``lengths`` whose sum comes closest to ``capacity`` from below.

    Bit s of the set says that sum s can be reached. Counts are split into
    powers of two; each part shifts the set once. Backtracking over the kept
    sets gives how many of each length the best sum takes.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts, strict=True):
        count, part = min(count, capacity // length), 1
        while count:
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            count -= part
            part *= 2
        if reach >> capacity:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            best -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (windows, [(length, pieces of it in each window)]) that use up the histogram.

    Every step seeds a window with the longest remaining length and fills it
    closest to capacity. The pattern is repeated as long as the counts allow it,
    so steps are bounded by the distinct lengths (each empties one, or takes
    the rest of one), whatever the rows.
    """
    left, patterns = {k: v for k, v in histogram.items() if v}, []
    while left:
        seed = max(left)
        order = sorted(left, reverse=True)
        counts = [left[k] - (k == seed) for k in order]
        taken = fill_closest(order, counts, capacity - seed) if seed < capacity else {}
        taken[seed] = taken.get(seed, 0) + 1
        windows = min(left[k] // c for k, c in taken.items())
        for k, c in taken.items():
            left[k] -= windows * c
            if not left[k]:
                del left[k]
        patterns.append((windows, sorted(taken.items(), reverse=True)))
    return patterns


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece ``sequence_id, offset``: windows of at most ``capacity`` ids, filled from 0 without gaps.

    Only the histogram of lengths (at most ``capacity`` entries) reaches the
    driver; the broadcast patterns have at most a few entries per length. Pieces
    are ranked within their length by (length, bucket) counts, their running
    sum and a row number within the bucket, so a length that a third of all
    documents share is dealt over buckets that grow in number with the rows.
    An empty table gives no rows.
    """
    spark = pieces.sparkSession
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = bucket_count(sum(lengths.values()))
    runs, base = [], 0
    cursor: dict[int, int] = {}
    for windows, items in minimum_bin_slack(lengths, capacity):
        at = 0
        for length, each in items:
            lo = cursor.get(length, 0)
            runs.append((length, lo, lo + windows * each, each, base, at))
            cursor[length] = lo + windows * each
            at += length * each
        base += windows
    table = F.broadcast(spark.createDataFrame(runs, "run_length long, lo long, hi long, each long, base long, at long"))
    keyed = pieces.withColumn("bucket", spread(F.concat_ws("/", "doc_id", "row", "start"), buckets))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "start")
    ranked = keyed.withColumn("k", F.row_number().over(inner) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k"))
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    placed = ranked.join(table, fits).withColumn("sequence_id", F.col("base") + F.expr("(rank - lo) div each"))
    return placed.withColumn("offset", F.col("at") + nth % F.col("each") * F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, **columns) -> DataFrame:
    """Tokenise, cut and pack whole documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. Long texts are cut every
    ``capacity`` ids: such a piece fills a window by itself. Repeated rows are
    packed each. Pieces are written to the shared folder once, as they are read
    for the histogram and for the placement.
    """
    pieces = materialise(token_pieces(docs, path, capacity=capacity, end_id=end_id, **columns), "pack-pieces")
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
