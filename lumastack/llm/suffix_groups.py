"""Substring dedup over bytes: suffix arrays by grouping suffixes under their Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .repeats import Units, among, anchor_runs, blocks, checked, cleaned_documents, distinct_segments, marked, packed_documents, record_batch, removed_spans, row_id, segments, shared_anchors

#: Bytes of a window, and of the m-gram that anchors it.
WINDOW = 50
ANCHOR = 32
#: Segments end about every so many anchors.
CUT = 16
#: A task sorts at most about this many bytes of one group's strings; a larger group is halved by where the anchor stands in the window.
GROUP_BYTES = 1 << 20
#: Small groups are sorted together up to about this many bytes.
CHUNK_BYTES = 1 << 13


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """The suffix array of ``symbols``, whose last is the only smallest.

    First pass: suffixes start grouped by their first symbol, a group named by
    its first place in the order. Groups are taken from the highest down. For
    each suffix i of the group, prev[i] is the nearest suffix before it in a
    lower group; its known prefix is continued by the group's, so the suffixes
    pointed at leave their own group for a new one right above it, the more
    often they are pointed at the higher. At the end a group holds the suffixes
    with one Lyndon prefix. Second pass: from the smallest suffix up, the
    suffix before the one just placed, and what its prev pointers lead to, get
    the next place of their groups. Both are linear; nothing is renamed.
    """
    symbols = np.asarray(symbols)
    n = len(symbols)
    by = np.argsort(symbols, kind="stable")
    opens = np.flatnonzero(np.diff(symbols[by], prepend=-1))
    sizes = np.diff(opens, append=n)
    group = np.empty(n, dtype=np.int64)
    group[by] = np.repeat(opens, sizes)
    group, by = group.tolist(), by.tolist()
    members, size, ending = [None] * n, [0] * n, [0] * (n + 1)
    for g, c in zip(opens.tolist(), sizes.tolist(), strict=True):
        members[g], size[g], ending[g + c] = by[g : g + c], c, g
    prev = [-1] * n
    top = n
    while top:
        g = ending[top]
        mine = members[g]
        if len(mine) > top - g:
            mine = [i for i in mine if group[i] == g]
        members[g] = None
        top = g
        if len(mine) == 1:
            # a group of one points at one suffix at most
            i = mine[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                of = group[j]
                c = size[of] - 1
                if c:
                    name = of + c
                    size[of] = c
                    size[name] = 1
                    ending[name + 1], ending[name] = name, of
                    members[name] = [j]
                    group[j] = name
            continue
        mine.sort()
        ahead = []
        for i in mine:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                ahead.append(j)
        parts: dict = {}
        if len(set(ahead)) == len(ahead):
            # each is pointed at once
            for j in ahead:
                of = group[j]
                if of in parts:
                    parts[of].append(j)
                else:
                    parts[of] = [j]
            moves = parts.items()
        else:
            pointed = {}
            for j in ahead:
                pointed[j] = pointed.get(j, 0) + 1
            for j, times in pointed.items():
                key = times, group[j]
                if key in parts:
                    parts[key].append(j)
                else:
                    parts[key] = [j]
            moves = [(part[1], parts[part]) for part in sorted(parts, reverse=True)]
        for of, leaving in moves:
            c = size[of] - len(leaving)
            if c:
                end = of + size[of]
                name = of + c
                size[of] = c
                size[name] = end - name
                ending[end], ending[name] = name, of
                members[name] = leaving
                for j in leaving:
                    group[j] = name
    order, place, done = [n - 1] * n, list(range(n)), bytearray(n)
    done[n - 1] = 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            done[j] = 1
            j = prev[j]
    return order


def window_origins(strings: list[tuple[bytes, int, int]], firsts: np.ndarray, lasts: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
    """For each string, runs (at, n, first): windows of k symbols whose smallest document over all strings is ``first``, if a larger document has them too.

    A string is (bytes, place, mark): the byte at ``place`` stands for symbol
    ``mark``, unless place is negative. The strings are joined with separators
    and their suffixes sorted; equal windows are neighbours in the order.
    """
    lengths = np.array([len(c) for c, _, _ in strings])
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    symbols = np.frombuffer(b"\0".join([c for c, _, _ in strings]), dtype=np.uint8).astype(np.int64) + 2
    symbols[starts[1:] - 1] = 1
    place, mark = np.array([p for _, p, _ in strings]), np.array([m for _, _, m in strings])
    symbols[(starts + place)[place >= 0]] = mark[place >= 0] + 258
    order = np.array(suffix_order([*symbols.tolist(), 0]))[1:]
    owner = np.searchsorted(starts, order, side="right") - 1
    whole = order - starts[owner] + k <= lengths[owner]
    order, owner = order[whole], owner[whole]
    views = np.lib.stride_tricks.sliding_window_view(symbols, k)
    new = np.ones(len(order), dtype=bool)
    for at in range(1, len(order), 65_536):
        part = views[order[at - 1 : at + 65_536]]
        new[at : at + len(part) - 1] = (part[1:] != part[:-1]).any(axis=1)
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least, most = np.minimum.reduceat(firsts[owner], heads)[run], np.maximum.reduceat(lasts[owner], heads)[run]
    text = np.lexsort((order, owner))
    order, owner, least, most = order[text], owner[text], least[text], most[text]
    keep = least < most
    order, owner, least = order[keep], owner[keep], least[keep]
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    if len(order):
        edge = np.flatnonzero((order[1:] != order[:-1] + 1) | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])) + 1
        lo, hi = np.append(0, edge), np.append(edge, len(order))
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            out[owner[a]].append((int(order[a] - starts[owner[a]]), b - a, int(least[a])))
    return out


RUNS = "skey binary, at int, n int, first long, last long, anchor long, place int, content binary"
_RUN_KINDS = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
GROUP = ["anchor", "lo", "hi", "context"]
SORTED = "anchor long, lo int, hi int, context binary, content binary, runs array<struct<at int, n int, first long>>"


def segment_runs(pieces: DataFrame, shared: DataFrame, units: Units) -> DataFrame:
    """Distinct segments that share an anchor with another one, cut into runs of windows: ``RUNS``.

    A run whose anchor no other segment has stands for itself: ``content`` is
    null, and all its windows start in the segment's own smallest document.
    Neighbouring ones are one run. A run with a shared anchor brings its content;
    ``place`` is where the anchor's m-gram stands in it, -1 if it occurs there
    twice. It has at most k - m + 1 windows, so at most 2k - m bytes.
    """
    w, k = units.k - units.m + 1, units.k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys, firsts, lasts = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(4)
            marks, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            mark_owner, mark_at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
            for owner, offset, texts in blocks(units, enumerate(batch.column(3).to_pylist())):
                found = units.anchors(texts)
                lo, hi = anchor_runs(found.value, found.bounds, w)
                of = np.searchsorted(found.bounds, lo, side="right") - 1
                span = slice(mark_at[owner[0]], mark_at[owner[-1] + 1])
                meets = among(np.asarray(owner)[of], found.value[lo], marks[span], mark_owner[span])
                # runs for themselves: one per stretch
                opens = np.flatnonzero(meets | np.concatenate([[True], meets[:-1] | (of[1:] != of[:-1])]))
                closes = np.append(opens[1:], len(lo)) - 1
                lo, hi, of, meets = lo[opens], hi[closes], of[opens], meets[opens]
                base = found.bounds[of]
                anchors = found.value[lo]
                at_ = found.place[lo][:, None] + np.arange(2 * w - 1)
                same = (found.grams[np.minimum(at_, len(found.grams) - 1)] == anchors[:, None]) & (at_ < (found.place[hi - 1] + w)[:, None])
                place = np.where(same.sum(axis=1) == 1, same.argmax(axis=1), -1)
                columns = (of, lo - base, hi - base, meets, anchors.view(np.int64), place)
                for p, a, b, meet, anchor, stands in zip(*[c.tolist() for c in columns], strict=True):
                    i = owner[p]
                    if meet:
                        rows.append((keys[i], offset[p] + a, b - a, firsts[i], lasts[i], anchor, stands, texts[p][a : b + k - 1]))
                    elif firsts[i] < lasts[i]:
                        rows.append((keys[i], offset[p] + a, b - a, firsts[i], lasts[i], None, None, None))
                if len(rows) >= 10_000:
                    yield record_batch(rows, _RUN_KINDS, RUNS)
                    rows = []
            yield record_batch(rows, _RUN_KINDS, RUNS)

    rows = pieces.join(marked(shared), "rid").select("skey", "first", "last", "content", "anchors")
    return rows.mapInArrow(cut, RUNS)


def sorted_origins(strings: DataFrame, units: Units) -> DataFrame:
    """``SORTED`` of distinct strings in groups: the suffixes of a chunk of groups are sorted together.

    ``strings`` has ``GROUP``, ``place, content, first, last``. All strings of a
    group hold the anchor's m-gram once, and so does each of their windows: it
    becomes one symbol of the group's own, which halves what is to be sorted.
    Groups in which it occurs twice in a string are sorted as they are. A group
    of one string has nothing to sort: all its windows have that string's documents.
    """
    k, m = units.k, units.m
    names = [x.split()[0] for x in SORTED.split(", ")[:6]]
    run = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", pa.int64())]))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), run)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per kind of string (short: the anchor as one symbol): its rows and strings
        held: dict[bool, tuple[list[tuple], list[tuple[bytes, int, int]]]] = {True: ([], []), False: ([], [])}
        group: list[tuple] = []
        whole: list[tuple] = []
        size = number = 0

        def close() -> None:
            nonlocal size, number
            if len(group) == 1:
                r = group.pop()
                if r[6] < r[7]:
                    whole.append((*r[:4], r[5], [{"at": 0, "n": len(r[5]) - k + 1, "first": r[6]}]))
                return
            short = all(r[4] >= 0 for r in group)
            rows, strings_ = held[short]
            for r in group:
                c, p = r[5], r[4]
                strings_.append((c[:p] + b"\0" + c[p + m :], p, number) if short else (c, -1, 0))
                size += len(strings_[-1][0])
            rows += group
            number += 1
            group.clear()

        def settle() -> pa.RecordBatch:
            nonlocal size, number
            out = whole.copy()
            whole.clear()
            for short, (rows, strings_) in held.items():
                if rows:
                    firsts, lasts = np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
                    found = window_origins(strings_, firsts, lasts, k - m + 1 if short else k)
                    out += [(*r[:4], r[5], [{"at": a, "n": n, "first": f} for a, n, f in runs]) for r, runs in zip(rows, found, strict=True) if runs]
                strings_.clear()
                rows.clear()
            size = number = 0
            columns = zip(*out, strict=True) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[:4] != group[0][:4]:
                    close()
                    if size >= CHUNK_BYTES or len(whole) >= 10_000:
                        yield settle()
                group.append(row)
        if group:
            close()
        yield settle()

    rows = strings.select(*GROUP, "place", "content", "first", "last")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(sort, SORTED)


def halves(runs: DataFrame, units: Units) -> DataFrame:
    """Runs of groups that are too large, each in the halves of its group.

    In a group's windows the anchor stands at lo to hi. Those where it stands in
    the upper half share the bytes before it, those in the lower half the bytes
    after it; these bytes name the new group, and strings are trimmed to its
    windows. After five halvings a group is one window's content. A run that
    holds its anchor twice is cut into its windows.
    """
    k, m = units.k, units.m
    rest = k - m
    n = F.octet_length("content")
    after = n - F.col("place") - m

    def half(lo: Column, hi: Column) -> DataFrame:
        left, right = F.least("place", hi), F.least(after, F.lit(rest) - lo)
        begin = F.col("place") - left
        bytes_ = lambda start, length: F.substring("content", start + 1, length)
        fits = (F.col("place") >= lo) & (after >= F.lit(rest) - hi) & (left + right >= rest)
        parts = runs.where(F.col("place") >= 0).where(fits).select(
            "skey",
            (F.col("at") + begin).alias("at"),
            "first",
            "last",
            "anchor",
            lo.cast("int").alias("lo"),
            hi.cast("int").alias("hi"),
            F.concat(bytes_(F.col("place") - lo, lo), bytes_(F.col("place") + m, F.lit(rest) - hi)).alias("context"),
            left.cast("int").alias("place"),
            bytes_(begin, left + m + right).alias("content"),
        )
        return parts

    middle = F.expr("(lo + hi + 1) div 2").cast("int")
    twice = runs.where("place < 0").withColumn("o", F.explode(F.sequence(F.lit(0), n - k)))
    window = F.substring("content", F.col("o") + 1, F.lit(k))
    single = twice.select("skey", (F.col("at") + F.col("o")).alias("at"), "first", "last", "anchor", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), window.alias("context"), "place", window.alias("content"))
    return half(F.col("lo"), middle - 1).unionByName(half(middle, F.col("hi"))).unionByName(single)


def run_origins(runs: DataFrame, units: Units, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``skey, at, n, first`` of runs with shared anchors: which smallest document their windows start in.

    Equal strings of a group are merged (smallest and largest document) before
    they meet in a task; a group whose distinct strings exceed ``group_bytes``
    (the edge of a phrase of very many documents) is halved, and its halves go
    the same way.
    """
    level = runs.select("skey", "at", "first", "last", "anchor", F.lit(0).alias("lo"), F.lit(units.k - units.m).alias("hi"), F.lit(b"").alias("context"), "place", "content")
    found = None
    while True:
        merged = materialise(level.groupBy(*GROUP, "content").agg(F.first("place").alias("place"), F.min("first").alias("first"), F.max("last").alias("last")), "suffix-strings")
        sizes = merged.groupBy(*GROUP).agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"))
        large = materialise(sizes.where((F.col("bytes") > group_bytes) & (F.col("lo") < F.col("hi"))).select(*GROUP), "suffix-large")
        more = large.limit(1).count()
        fit = merged.join(large, GROUP, "left_anti") if more else merged
        settled = materialise(sorted_origins(fit, units), "suffix-sorted")
        hits = level.join(settled, [*GROUP, "content"]).select("skey", "at", F.explode("runs").alias("r"))
        part = materialise(hits.select("skey", (F.col("at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"), F.col("r.first").alias("first")), "suffix-found")
        found = part if found is None else found.union(part)
        discard(merged, settled)
        if not more:
            return found
        level = materialise(halves(level.join(large, GROUP, "left_semi"), units), "suffix-halves")


def segment_origins(pieces: DataFrame, units: Units, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per distinct segment ``skey, runs``: which smallest documents its windows start in; ``pieces`` is dropped.

    Windows of two segments can only be equal under an anchor of both. Segments
    without such an anchor, and runs under an anchor of one segment only, have
    their own smallest document; all else is sorted.
    """
    flat = pieces.select("skey", F.col("origin.doc_id").alias("first"), "last", "windows", "content", F.xxhash64("skey").alias("rid"))
    shared = materialise(shared_anchors(flat, units, text="content"), "suffix-shared")
    runs = materialise(segment_runs(flat, shared, units), "suffix-runs")
    whole = flat.where("first < last").join(shared.select("rid").distinct(), "rid", "left_anti").select("skey", F.lit(0).alias("at"), F.col("windows").alias("n"), "first")
    lone = runs.where("content IS NULL").select("skey", "at", "n", "first")
    found = whole.union(lone).union(run_origins(runs.where("content IS NOT NULL"), units, group_bytes))
    out = materialise(found.groupBy("skey").agg(F.collect_list(F.struct("at", "n", "first")).alias("runs")), "suffix-origins")
    discard(pieces, shared, runs)
    return out


def remove_repeated_bytes(
    docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """Remove each byte that a string of ``k`` bytes covers that also starts in a document with a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and with
    ``carry`` also ``kept`` (the text left, without torn characters) and ``row``
    (the other columns by position). Strings are judged on the input and never
    cross documents. Null texts are empty; texts shorter than k keep all; rows
    with a null doc_id are neither judged nor judge; repeated rows, and different
    texts that share a doc_id, don't remove each other and keep their own spans;
    ids that are no whole numbers are an error; an empty table gives no rows.
    """
    units = Units("byte", k, anchor, CUT)
    packed = packed_documents(checked(docs, doc_id), doc_id, text, carry)
    shared = shared_anchors(docs.select(row_id(doc_id, text).alias("rid"), F.col(text).alias("text")), units)
    found = materialise(segments(packed, shared, units), "suffix-segments")
    pieces = materialise(distinct_segments(found), "suffix-pieces")
    origins = segment_origins(pieces, units)
    spans = materialise(removed_spans(found, origins, k), "suffix-spans")
    discard(found, origins)
    return cleaned_documents(packed, spans, units).withColumnRenamed("units", "n_bytes")
