"""Ranked search, prefix trie and collision counting against brute force: nulls, ties, repeats, empty tables, long inputs, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.llm import collision_counting, prefix_trie, ranked_search

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def best_documents(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = Counter(terms(text)), []
        for i, c in held:
            m = 25 + (75 * c.total() * n_docs) // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "日本", "the", "THE"]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=p / p.sum())) for _ in range(700)]
    texts += [None, "", " \n!?", "the " * 30_000, texts[3], texts[3], "w299-w298_w297/w299", "W299 w298\x00w297", "x" * 5000]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, texts[3]), (5, texts[3]), (None, texts[3])]
    items = [(i, " ".join(rng.choice(words, 12, p=p / p.sum()))) for i in range(20)]
    items += [(50, "w299 w299 w298"), (50, "w299 w299 w298"), (50, "the"), (51, None), (52, ""), (53, "nowhere"), (54, texts[3]), (None, "w10 w20"), (55, texts[3].upper())]
    return docs, items


@pytest.mark.parametrize(("docs_held", "postings", "leaf", "take"), [(16_384, 1 << 20, 256, 64), (50, 300, 3, 2), (100_000, 1 << 20, 0, 1)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, docs_held, postings, leaf, take):
    for name, value in (("INDEX_DOCS", docs_held), ("INDEX_POSTINGS", postings), ("LEAF", leaf), ("TAKE", take)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("item", "score", "rank", "n", "term", "a.b")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = sorted(map(tuple, ranked_search.ranked_search(d, i).collect()), key=str)
    assert got == best_documents(docs, items, 10)


def test_intervals_find_the_best_at_every_leaf_and_batch_size():
    rng = np.random.default_rng(9)
    n, vocabulary = 400, 25
    counts = rng.poisson(rng.uniform(0, 0.6, vocabulary), (n, vocabulary))
    sizes = (counts > 0).sum(axis=1)
    term = np.concatenate([np.flatnonzero(c) for c in counts])
    tf = np.concatenate([c[c > 0] for c in counts])
    about = ranked_search.Statistics(n, int(counts.sum()), rng.integers(0, 9000, vocabulary))
    index = ranked_search.Index(np.arange(n), counts.sum(axis=1), sizes, term, tf, about)
    dense = np.zeros((n, vocabulary), dtype=np.int64)
    dense[index.doc, index.key // n] = index.impact
    for _ in range(30):
        asked = rng.choice(vocabulary, int(rng.integers(1, 9)), replace=False)
        times = rng.integers(1, 4, len(asked))
        best = ranked_search.Best(10)
        index.search(asked, times, best)
        want = dense[:, asked] @ times
        order = np.lexsort((np.arange(n), -want))[:10]
        order = order[want[order] > 0]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == want[order].tolist()


def test_search_skips_intervals(monkeypatch):
    """Documents that can't reach the kth place aren't scored."""
    n = 20_000
    tf = np.ones(n, dtype=np.int64)
    tf[:10] = 50
    about = ranked_search.Statistics(n, int(tf.sum()), np.array([1000]))
    index = ranked_search.Index(np.arange(n), tf, np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64), tf, about)
    seen = []
    add = ranked_search.Best.add
    monkeypatch.setattr(ranked_search.Best, "add", lambda self, ids, scores: seen.append(len(ids)) or add(self, ids, scores))
    best = ranked_search.Best(10)
    index.search(np.array([0]), np.array([1]), best)
    assert best.ids.tolist() == list(range(10)) and sum(seen) < 600


def test_items_in_blocks_and_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 6)
    monkeypatch.setattr(ranked_search, "CHUNK", 16)
    docs, items = corpus()
    docs = docs[:150] + docs[-12:]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ranked_search.ranked_search(d, i, k=3).collect()), key=str)
    assert got == best_documents(docs, items, 3)


def test_ranked_search_on_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(docs.where("false"), items).count() == 0
    assert ranked_search.ranked_search(docs, items.where("false")).count() == 0
    assert ranked_search.ranked_search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
    assert [tuple(r) for r in ranked_search.ranked_search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]


# 12


def rebuilt(rows, group=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    if not group:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:]
    return out


def nodes(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * words
    ends = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(conversations[c]) == len(n))))
    return sorted((min(w), len(n), min(members[n[:-1]]) if n else None, len(w), children[n], leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, w in members.items())


TURNS = "conv_id long, turn long, role string, text string"


def talk():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(240):
        said = rng.integers(0, 4, int(rng.integers(1, 7)))
        rows += [(c, int(t), ["user", "assistant", None][t % 3], [None, "", "hello there", f"lone {c} {t}", "a b c"][int(s)]) for t, s in enumerate(said)]
    rows += [(1000 + i, t, "user", "one and the same") for i in range(300) for t in range(3)]
    rows += [(5000, t, "user", f"line {t % 5}") for t in range(700)] + [(5001, t, "user", f"line {t % 5}") for t in range(650)]
    rows += [(-7, None, "b", "x"), (-7, None, "a", "z"), (-7, 0, "user", "y"), (-7, 0, "user", "y"), (None, 1, "user", "no one")]
    rows += [(41, 0, "user", "short"), (2**40 + 1, 3, None, None)]
    return rows


def as_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("cells", "piece"), [(1 << 26, 4096), (16, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, cells, piece):
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "HEAVY", 20)
    rows = talk()
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("seq", "digest", "words", "depth", "a")}).repartition(5)
    assert as_rows(prefix_trie.rebuilt_trie(table)) == nodes(rebuilt(rows))
    assert as_rows(prefix_trie.conversation_trie(table)) == nodes(rebuilt(rows, group=None))


@pytest.mark.parametrize("cells", [256, 1024])
def test_full_cells_below_a_proven_prefix_change_nothing(spark, monkeypatch, cells):
    """A tail's longer prefixes that the sketch takes for shared stay nodes of their conversation."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rows = [(c, t, "user", f"turn {t} of {c if t else c % 3}") for c in range(60) for t in range(9)]
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    assert as_rows(prefix_trie.conversation_trie(table)) == nodes(rebuilt(rows, group=None))


def test_screening_keeps_tails_out_of_the_shuffle(spark):
    """A proven singleton has one member; most single prefixes are proven so, no shared one is."""
    conversations = rebuilt(talk(), group=None)
    turns = prefix_trie.turn_rows(spark.createDataFrame(talk(), TURNS))
    prefixes = prefix_trie._prefixes(turns)
    screened = prefix_trie._screened(prefixes, 1 << 13).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("single").alias("single")).collect()
    assert sum(r.n for r in screened) == sum(len(t) + 1 for t in conversations.values())
    assert not any(r.single for r in screened if r.n > 1)
    lone = [r.single for r in screened if r.n == 1]
    assert sum(lone) > 0.9 * len(lone)


def test_trie_of_empty_and_single_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(none).count() == prefix_trie.conversation_trie(none).count() == 0
    for rows in ([(7, 0, "user", "a b")], [(8, 0, "user", None), (8, 1, None, "x")], [(20, 0, "u", "a"), (23, 0, "u", "b")], [(None, 0, "u", "a")]):
        table = spark.createDataFrame(rows, TURNS)
        assert as_rows(prefix_trie.rebuilt_trie(table)) == nodes(rebuilt(rows))


# 13


def exact_nearest(rows, asked, k):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in {i: v for i, v in reversed(usable) if asked(i)}.items():
        out[q] = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in usable if i != q)[:k]
    return out


def clusters(n=3000, width=32):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, width))
    v = centres[rng.integers(0, 20, n)] + 0.5 * rng.standard_normal((n, width))
    v[1500:2500] = v[1499]  # a third are copies
    return [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("index", [16_384, 700])
def test_neighbours_against_brute_force(spark, index):
    rows = clusters()
    rows += [(9000, None), (9100, [0.0] * 32), (9200, [None] * 32), (9300, [float("nan")] * 32), (9400, [float("inf")] * 32), (None, rows[5][1]), rows[100], rows[100]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(2) for c in ("v", "block", "kind", "score")}).repartition(3)
    got = defaultdict(list)
    for r in sorted(collision_counting.nearest(table, F.col("vec_id") % 100 == 0, index=index).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
        assert len(got[r.query_id]) == r["rank"]
    want = exact_nearest(rows, lambda i: i % 100 == 0, 10)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert all(x == sorted(x) for x in got.values())
    assert got[1500] == want[1500]  # ties among copies


def test_windows_leave_far_vectors_unverified():
    rng = np.random.default_rng(1)
    near, far = rng.standard_normal((50, 16)) * 0.1, rng.standard_normal((3000, 16)) * 0.1 + 5
    index = collision_counting.Index(np.arange(3050), np.concatenate([near, far]), collision_counting.directions(16))
    ids, distances = index.search(-1, near[0], 10)
    assert ids[0] == 0 and distances[0] == 0 and set(ids) <= set(range(50))


def test_neighbours_on_small_tables(spark):
    form = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], form)
    assert collision_counting.nearest(none, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (200, [0.0, 0.0])], form)
    got = [tuple(r) for r in collision_counting.nearest(few, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(100, 1, 1, 0.0), (100, 2, 3, 0.0), (100, 3, 2, math.sqrt(2))]
    assert collision_counting.nearest(few, F.col("vec_id") > 900).count() == 0
    assert collision_counting.nearest(few.where("vec_id = 100"), F.col("vec_id") == 100).count() == 0
