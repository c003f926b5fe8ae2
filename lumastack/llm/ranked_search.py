"""Ranked lexical search: best-first intervals of documents under range-maximum sparse tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, integral, materialise

#: Items of one pass over the documents, and bytes of their texts (a single longer item has a pass of its own).
ITEMS = 1_000
ITEM_BYTES = 8 << 20
#: Documents and postings of one index: what a task holds at a time.
INDEX_DOCS = 16_384
INDEX_POSTINGS = 1 << 20
#: An interval with at most this many postings is scored whole instead of being split.
LEAF = 256
#: Intervals taken from the frontier at a time, best bounds first.
TAKE = 64
#: Bytes of text that are split into terms at a time.
CHUNK = 1 << 20

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Separators to spaces, A-Z to a-z; all else, so every byte of a longer character, stays.
_FOLD = bytes.maketrans(bytes(_SEPARATORS) + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in a UTF-8 text, cut at separators a chunk at a time."""
    counts: Counter = Counter()
    at, end = 0, len(text or b"")
    while at < end:
        stop = min(end, at + CHUNK)
        while stop < end and _FOLD[text[stop]] != 0x20:
            stop += 1
        counts.update(text[at:stop].translate(_FOLD).split())
        at = stop
    return counts


class Statistics(NamedTuple):
    """What all documents together say: how many have a term, how many terms, and each term's weight."""

    documents: int
    terms: int
    weights: np.ndarray


def weights(documents: int, frequencies: dict[int, int], vocabulary: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(vocabulary)], dtype=np.int64)


class Index:
    """Posting lists of up to some thousand documents, with a sparse table over each.

    Postings stand in order of term, then document (``key``). ``table[j][i]``
    is the place of the greatest impact among the 2^j postings from ``i`` on,
    so two look-ups give the greatest impact of any range of a list.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, about: Statistics):
        """``ids`` ascending; ``term`` and ``tf`` hold ``sizes[i]`` postings of document i after those of document i - 1."""
        self.ids, self.n = ids, len(ids)
        doc = np.repeat(np.arange(self.n), sizes)
        m = 100 - 75 + (75 * lengths * about.documents) // about.terms
        impact = about.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        key = term * self.n + doc
        order = np.argsort(key)
        self.key, self.doc, self.impact = key[order], doc[order], impact[order]
        self.first = np.searchsorted(self.key, np.arange(len(about.weights) + 1) * self.n)
        levels = int(np.diff(self.first).max(initial=1)).bit_length()
        self.table = np.zeros((levels, len(key)), dtype=np.int32)
        if len(key):
            self.table[0] = np.arange(len(key))
        for j in range(1, levels):
            half, wide = 1 << (j - 1), len(key) - (1 << j) + 1
            if wide > 0:
                a, b = self.table[j - 1, :wide], self.table[j - 1, half : half + wide]
                self.table[j, :wide] = np.where(self.impact[a] >= self.impact[b], a, b)

    def highest(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impact among postings ``left`` to ``right`` (excluded) and its place; 0 and 0 where there are none."""
        some = right > left
        level = np.where(some, np.frexp(np.maximum(right - left, 1).astype(np.float64))[1] - 1, 0)
        a = self.table[level, np.where(some, left, 0)]
        b = self.table[level, np.where(some, right - (1 << level), 0)]
        place = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(some, self.impact[place], 0), place

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Put this index's best documents for a query (``terms``, each ``times`` repeated) into ``best``.

        A frontier of intervals starts as all documents. An interval's bound
        is the sum of its terms' range maxima. The intervals of the highest
        bounds are split at the document of their greatest single impact,
        which is scored exactly; short ones are scored whole. Intervals that
        can't reach the kth place any more are left; none left ends the search.
        """
        held = (self.first[terms + 1] > self.first[terms]) if len(terms) else np.zeros(0, dtype=bool)
        terms, times = terms[held], times[held]
        if not len(terms):
            return
        scores = np.zeros(self.n, dtype=np.int64)
        spans = np.array([[0, self.n]])
        left, right = self.first[terms][None, :], self.first[terms + 1][None, :]
        bound, split = self._bounds(left, right, times)
        while len(bound):
            open_ = best.can_hold(bound, self.ids[spans[:, 0]])
            spans, left, right, bound, split = spans[open_], left[open_], right[open_], bound[open_], split[open_]
            if not len(bound):
                return
            take = np.zeros(len(bound), dtype=bool)
            take[np.argpartition(-bound, TAKE)[:TAKE] if len(bound) > TAKE else slice(None)] = True
            small = take & ((right - left).sum(axis=1) <= LEAF)
            large = take & ~small
            found = [self._score_whole(left[small], right[small], times, scores)] if small.any() else []
            children = []
            if large.any():
                at, lo, hi = split[large], spans[large, 0], spans[large, 1]
                middle = np.searchsorted(self.key, terms[None, :] * self.n + at[:, None])
                there = (middle < right[large]) & (self.doc[np.minimum(middle, len(self.doc) - 1)] == at[:, None])
                found.append((at, (np.where(there, self.impact[np.minimum(middle, len(self.doc) - 1)], 0) * times).sum(axis=1)))
                for a, b, l, r in ((lo, at, left[large], middle), (at + 1, hi, middle + there, right[large])):
                    full = (r > l).any(axis=1)
                    if full.any():
                        children.append((np.stack([a, b], axis=1)[full], l[full], r[full], *self._bounds(l[full], r[full], times)))
            for docs, score in found:
                best.add(self.ids[docs], score)
            parts = list(zip((spans[~take], left[~take], right[~take], bound[~take], split[~take]), *children, strict=True))
            spans, left, right, bound, split = (np.concatenate(p) for p in parts)

    def _bounds(self, left: np.ndarray, right: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most, place = self.highest(left, right)
        most = most * times
        row = np.arange(len(most))
        return most.sum(axis=1), self.doc[place[row, most.argmax(axis=1)]] if len(most) else np.zeros(0, dtype=np.int64)

    def _score_whole(self, left: np.ndarray, right: np.ndarray, times: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (right - left).ravel()
        start = np.cumsum(size) - size
        place = np.repeat(left.ravel() - start, size) + np.arange(size.sum())
        np.add.at(scores, self.doc[place], self.impact[place] * np.repeat(np.tile(times, len(left)), size))
        docs = np.unique(self.doc[place])
        out = scores[docs].copy()
        scores[docs] = 0
        return docs, out


class Best:
    """The k best of a query so far: highest score first, ties to the smaller id. Only scores above 0 count."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def can_hold(self, score: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        if len(self.scores) < self.k:
            return score > 0
        return (score > self.scores[-1]) | ((score == self.scores[-1]) & (least_id < self.ids[-1]))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = self.can_hold(scores, ids)
        if fit.any():
            ids, scores = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.scores, scores[fit]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]


#: What stands for a null document id within a task: behind all others.
_NO_ID = np.iinfo(np.int64).max


def _counted(docs: DataFrame, text: str, doc_id: str, vocabulary) -> DataFrame:
    """``doc_id, n, term, tf`` of each document with a term: its length and its counts of the terms asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, n, terms, tfs = [], [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(raw.as_py())
                if counts:
                    asked = [(known[t], c) for t, c in counts.items() if t in known]
                    ids.append(doc)
                    n.append(counts.total())
                    terms.append([t for t, _ in asked])
                    tfs.append([c for _, c in asked])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("binary")).mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def _indexes(batches: Iterator[pa.RecordBatch], about: Statistics) -> Iterator[Index]:
    held, docs, postings = [], 0, 0

    def build() -> Index:
        table = pa.Table.from_batches(held)
        ids = table["doc_id"].fill_null(_NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order))
        sizes = table["term"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return Index(ids[order], table["n"].to_numpy(), sizes, flat("term"), flat("tf"), about)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column("term").flatten())
            if docs >= INDEX_DOCS or postings >= INDEX_POSTINGS:
                yield build()
                held, docs, postings = [], 0, 0
    if docs:
        yield build()


def _blocks(items: DataFrame) -> int:
    """Into how many blocks of at most about ITEMS items and ITEM_BYTES bytes the items are to be hashed."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = items.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    blocks = max(1, -(-total.n // ITEMS), -(-(total.b or 0) // ITEM_BYTES))
    while blocks > 1:
        by = items.groupBy(_block(blocks).alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        if not by.where((F.col("n") > 1) & ((F.col("n") > 2 * ITEMS) | (F.col("bytes") > 2 * ITEM_BYTES))).head(1):
            break
        blocks *= 2
    return blocks


def _block(blocks: int):
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: ``item_id, rank, doc_id, score``.

    Terms, weights and scores are those of ``Statistics`` and ``Index``: a
    document's score sums, over the item's terms with repeats, weight x
    impact in whole numbers; equal scores go by ascending doc_id, and only
    scores above 0 count. Items are taken in blocks of bounded size, each
    block's terms are sent to the tasks; a pass over all documents keeps
    their lengths and their counts of these terms, from which the corpus
    counts are taken. Then every task builds indexes of a bounded number of
    postings over its own documents, searches them for all items of the block
    and passes on k rows an item; nothing else is shuffled.

    Null texts have no terms. Each row is a document of its own, repeated
    ones too; null ids count and come last among equals. Equal rows of
    ``items`` are asked once. An item without terms, or without a document
    above 0, has no row. No documents, or no items: no rows.
    """
    integral(docs, doc_id)
    integral(items, item_id)
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    blocks = _blocks(asked)
    out = None
    for number in range(blocks):
        rows = asked.where(_block(blocks) == number).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        part = _search_block(docs, text, doc_id, [(r.item_id, term_counts(r.text)) for r in rows], k)
        out = part if out is None else out.unionAll(part)
    return out


def _search_block(docs: DataFrame, text: str, doc_id: str, items: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, counts in items for t in counts))}
    sent = context.broadcast(vocabulary)
    counted = materialise(_counted(docs, text, doc_id, sent), "search-counts")
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    frequencies = counted.select(F.explode("term").alias("term")).groupBy("term").count()
    about = Statistics(total.n, total.terms or 1, weights(total.n, {r[0]: r[1] for r in frequencies.collect()}, len(vocabulary)))
    queries = [(np.array([vocabulary[t] for t in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)) for _, counts in items]
    queries = [(t[about.weights[t] > 0], n[about.weights[t] > 0]) for t, n in queries]
    plan = context.broadcast((about, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, queries = plan.value
        best = [Best(k) for _ in queries]
        for index in _indexes(batches, about):
            for (terms, times), top in zip(queries, best, strict=True):
                index.search(terms, times, top)
        for number, top in enumerate(best):
            if len(top.ids):
                ids = pa.array(top.ids, mask=top.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), number, dtype=np.int32)), ids, pa.array(top.scores)], ["item", "doc_id", "score"])

    found = counted.where(F.size("term") > 0).mapInArrow(search, "item int, doc_id long, score long")
    found = materialise(found, "search-found")
    discard(counted)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = F.array(*[F.lit(i).cast("long") for i, _ in items]) if items else F.array(F.lit(None).cast("long"))
    return ranked.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")
