"""Rows that share an id, columns with awkward names, movement on the ring, long texts."""

import bisect
import hashlib

import numpy as np
from pyspark.sql import functions as F

from lumastack.llm import debruijn, near_copies, repeats, sharding, stages, suffix_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(30))
B = " ".join(f"gamma{i} delta{i * 5 % 37}" for i in range(9))


def test_two_texts_under_one_id_keep_their_own_spans(spark):
    df = spark.createDataFrame([(1, A, "en", "a", 0), (2, A + " tail", "en", "a", 0), (2, B, "en", "a", 0), (2, None, "en", "a", 0)], DOCS)
    words = {(r.doc_id, r.n_words): r.n_removed for r in debruijn.remove_repeated_windows(df).collect()}
    assert words == {(1, 60): 0, (2, 61): 60, (2, 18): 0, (2, 0): 0}
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_groups.remove_repeated_bytes(df).collect()}
    assert cut == {(1, len(A)): 0, (2, len(A) + 5): len(A), (2, len(B)): 0, (2, 0): 0}


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, A, "en", "a", 0), (2, B, "en", "a", 0), (2, A, "en", "b", 0), (3, B + " " + B, "en", "b", 0), (4, B, "en", None, 0), (4, B, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    names = ("score", "rejected", "id_", "size_", "takes_", "a.b", "row", "rid", "kept", "lost_id")
    docs = docs.select("*", *[F.lit(777.0).alias(n) for n in names])
    for _, stage in stages.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert all(r[n] == 777.0 for r in got.collect() for n in names)
    left = sorted((r.doc_id, r.text) for r in stages.near_duplicate_stage(spark, docs, "").collect())
    assert left == sorted([(1, A), (2, B), (3, B + " " + B)])


def plain_ring(keys, points, shards):
    """Bounded-load ring over integer places in plain Python: capacities, then clockwise."""
    total, spots = len(keys), [p for p, _ in points]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    waiting = [[] for _ in points]
    for k, place in keys:
        waiting[bisect.bisect_left(spots, place) % len(points)].append(k)
    home = {}
    while any(waiting):
        onward = [[] for _ in points]
        for a, queue in enumerate(waiting):
            shard = points[a][1]
            take = queue[: room[shard]]
            room[shard] -= len(take)
            home |= dict.fromkeys(take, shard)
            onward[(a + 1) % len(points)] += queue[len(take) :]
        waiting = onward
    return home


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, n).collect()} for n in (24, 25))
    assert sum(before[k] != after[k] for k in before) < 0.12 * len(before)
    points = sharding.ring_points(spark, 24)
    assert set(points) < set(sharding.ring_points(spark, 25))
    places = [(r.doc_id, r.place) for r in docs.select("doc_id", sharding._place(F.col("doc_id")).alias("place")).collect()]
    ring = plain_ring(places, points, 24)
    counts = lambda home: np.bincount(list(home.values()), minlength=24).tolist()
    assert counts(ring) == counts(before)
    # which of an arc's rows spill is free; all that don't spill are where the plain ring puts them
    assert sum(ring[k] == before[k] for k in before) > 0.9 * len(before)


def test_blocks_do_not_change_anchors(monkeypatch):
    rng = np.random.default_rng(4)
    raw = bytes(rng.choice(np.frombuffer(b"abcde \n", dtype=np.uint8), 5000))
    for units in (repeats.Units("byte", 50, 32), repeats.Units("word", 13, 7)):
        whole = units.anchors([raw]).value
        monkeypatch.setattr(repeats, "BLOCK", 300)
        pieces = units.pieces(raw)
        assert len(pieces) > 1
        assert np.array_equal(np.concatenate([units.anchors([p]).value for _, p in pieces]), whole)
        assert [at for at, _ in pieces] == np.cumsum([0, *[len(units.anchors([p]).value) for _, p in pieces]])[:-1].tolist()
        monkeypatch.setattr(repeats, "BLOCK", 1 << 17)
        many = units.anchors([raw, b"", b"short", raw])
        assert np.array_equal(many.value, np.concatenate([whole, whole]))


def test_parity_maps_never_refute_similar_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(10, 900))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2))).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        odd = int(np.bitwise_count(near_copies.parity_map(a).view(np.uint64) ^ near_copies.parity_map(b).view(np.uint64)).sum())
        if 9 * common >= 4 * (len(a) + len(b)):
            assert 9 * odd <= len(a) + len(b)
        assert odd <= len(a) + len(b) - 2 * common


def test_kept_hash_of_an_untouched_text(spark):
    df = spark.createDataFrame([(5, B, None, None, None)], DOCS)
    assert suffix_groups.remove_repeated_bytes(df).first().kept_sha256 == hashlib.sha256(B.encode()).hexdigest()


def test_spans_of_copies_are_gathered_once(spark):
    first = [(1, A, "en", "a", 0), (2, B, "en", "a", 0)]
    copy = (3, A + " between " + B, "en", "a", 0)
    units = repeats.Units("word", debruijn.WINDOW, debruijn.ANCHOR)

    def longest(copies):
        docs = spark.createDataFrame([*first, *[copy] * copies], DOCS)
        packed = repeats.packed_documents(docs, "doc_id", "text", False)
        shared = repeats.shared_anchors(docs.select(repeats.row_id("doc_id", "text").alias("rid"), "text"), units)
        return debruijn.repeated_spans(packed, shared, units).agg(F.max(F.size("spans"))).first()[0]

    assert longest(40) == longest(1)
    docs = spark.createDataFrame([*first, *[copy] * 40], DOCS)
    assert {r.n_removed for r in debruijn.remove_repeated_windows(docs).collect() if r.doc_id == 3} == {60 + 18}


def test_near_copies_without_an_id_go_too(spark):
    """A row without an id is a copy like any other; of copies none of which has an id one stays."""
    near_a, near_b, c = A + " tail", B.upper() + " tail", " ".join(f"only{i}" for i in range(30))
    rows = [(7, A), (3, near_a), (None, A), (None, A), (None, A + " more"), (None, B + " " + A), (None, B), (None, B), (None, near_b), (None, c), (None, c), (None, None), (None, ""), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(3)
    left = [(r.doc_id, r.text) for r in stages.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(left, key=str) in [sorted([(3, near_a), (9, " "), (None, B + " " + A), (None, c), (None, b)], key=str) for b in (B, near_b)]
    again = [(r.doc_id, r.text) for r in stages.near_duplicate_stage(spark, docs.repartition(1), "").collect()]
    assert sorted(again, key=str) == sorted(left, key=str)


def test_groups_without_an_id_are_told_apart(spark):
    rows = [(None, A), (None, A + " tail"), (None, B), (5, B + " tail"), (6, "one two")]
    found = near_copies.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in found) == ["5", "5", "6", "None", "None"]
    assert len({r.linked for r in found}) == 3 and len({r.linked for r in found if r.component_id is None}) == 1
