"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import compare

from lumastack.llm import common, components, debruijn, language_id, mixing, packing, queries, sharding, simhash, stages, suffix_groups, telephony, url_filter, vector_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over one lazy dog while seven bright owls watch from a tall old tree near that river bend"


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [BASE, BASE, BASE.upper(), "x " + BASE + " y", None, "", " \n ", "one", "One", "12 34 !!", "a a a a a a a a a a a a a a a a a a a a", "ümlaut ß 日本 語 " * 9]
    out += [" ".join(rng.choice(vocabulary, int(rng.integers(1, 80)))) for _ in range(30)]
    out += [out[20] + " tail " + BASE, BASE + "\n" + out[21], " ".join(rng.choice(vocabulary, 6000))]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    langs, sources = ["en", "de", None], ["a", "b", None, "ü"]
    out = [(i, x, langs[i % 3], sources[i % 4], None) for i, x in enumerate(t)]
    return [*out, out[0], (None, BASE, "en", "a", 1), (10_000, BASE, "en", None, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names the operators use themselves
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("size", "bucket", "row", "z", "fp", "label", "spans", "units", "place", "sid", "rank", "lang_pred")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def test_every_operator_takes_an_empty_table(spark, empty):
    assert sharding.shard_rows(empty).count() == 0
    assert language_id.identify_languages(empty).count() == 0
    assert telephony.telephony_columns(empty).count() == 0
    assert debruijn.remove_repeated_windows(empty).count() == 0
    assert suffix_groups.remove_repeated_bytes(empty).count() == 0
    assert mixing.mixed_words(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty, queries.public_tokenizer()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_files.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 1


def test_url_rules_and_parts(spark):
    urls = ["http://X.Example.NET/en/1", "https://a.net/", "http://example.com/de/x?q#f", "http://example.com/fr", "http://b.org/fr/", "http://b.org?x/fr/", "nothing", None, "http://notexample.net/en/", "ftp://net", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(pages).collect()}
    assert got[0] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("a.net", "/", "net/", "block")
    assert got[2] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[3] == ("example.com", "/fr", None, "allow")
    assert got[4] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("b.org", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("notexample.net", "/en/", "net/", "block")
    assert got[9] == ("net", "", None, "allow")
    assert got[10][:2] == ("b:", "//c/d")


def test_blocks_spread_over_links_and_allow_wins(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://plain.example.com/a", link.format("http://evil.net/a")),
        (2, "http://evil.net/a", None),
        (3, "http://other.example.com/b", '<meta http-equiv="refresh" content="0; url=http://plain.example.com/a">'),
        (4, "http://both.example.com/c", link.format("http://evil.net/c") + link.format("x")),
        (5, "http://evil.net/c", link.format("http://www.example.net/en/c")),
        (6, "http://www.example.net/en/c", ""),
        (7, "http://alone.example.com/", "<p>"),
        (7, "http://alone.example.com/", "<p>"),
    ]
    got = [(r.page_id, r.verdict) for r in url_filter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block"), (6, "allow"), (7, "allow"), (7, "allow")]


def test_urls_without_address_stay_alone_and_relative_links_resolve(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "foo", link.format("http://evil.net/x")),
        (2, "bar", None),
        (3, "bar/../baz", link.format("../x")),
        (4, "http://a.example.com/d/e/p.html", link.format("../../t?q=1")),
        (5, "http://a.example.com/t?q=1", link.format("http://evil.net/y")),
        (6, "http://a.example.com/d/e/s", link.format("./u")),
        (7, "http://a.example.com/d/e/u", link.format("http://evil.net/z")),
        (8, "http://a.example.com/v?k=2", link.format("?k=3")),
        (9, "http://a.example.com", link.format("../../../w")),
        (10, "http://a.example.com/w", link.format("http://evil.net/w")),
        (11, "http://b.example.com/", link.format("mailto:x@evil.net")),
        (12, "http://b.example.com/q/", link.format("#top")),
        (13, "://evil", link.format("http://evil.net/v")),
        *[(20 + i, f"http://evil.net/{k}", None) for i, k in enumerate("xyzwv")],
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(table).collect()}
    assert sorted(i for i, v in got.items() if v == "block") == [1, 4, 5, 6, 7, 9, 10, 13, *range(20, 25)]
    con = duckdb.connect()
    con.register("pages", table.toPandas())
    assert compare(url_filter.judge_pages(table), con, queries.ORACLE_SQL["op1_redirect_equivalence"]) is None


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


# 2


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_even_and_gapless(docs, rows, shards):
    got = sharding.shard_rows(docs, shards).collect()
    assert len(got) == len(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all(v == list(range(len(v))) for v in by.values())
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.shard, r.slot)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_rows(docs.repartition(5), shards).collect()), key=str)
    assert key


def test_spilling_goes_on_clockwise():
    placed = sharding.spill_clockwise([5, 0, 1], [0, 1, 2], [2, 2, 2])
    assert sorted(placed) == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1), (2, 0, 1, 2, 0)]


# 3


def test_language_by_compression(spark):
    rng = np.random.default_rng(4)
    syllables = {"xx": "ka ro mi tu".split(), "yy": "schl ung ach eit".split()}
    make = lambda k: " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(60))
    rows_ = [(i, make(k), k, None, None) for i, k in enumerate(["xx", "yy"] * 40)] + [(900, None, "xx", None, None), (901, "12 !! 日", None, None, None), (902, "12 34", "yy", None, None), (903, "", None, None, None)]
    got = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows_, DOCS)).collect()}
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows_[:80])
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 902, 903)) and got[901].lang_pred in ("xx", "yy")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())


def test_language_without_labels(spark, docs):
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 4


def g711(code, law):
    """Textbook expansion of one byte."""
    if law == "mulaw":
        c = ~code & 255
        size = (((c & 15) * 2 + 33) << (c >> 4 & 7)) - 33
        return -size * 4 if c & 128 else size * 4
    c = code ^ 0x55
    e, m = c >> 4 & 7, c & 15
    size = (m * 2 + 1 if e == 0 else (m * 2 + 33) << (e - 1)) * 8
    return size if c & 128 else -size


@pytest.mark.parametrize("law", ["mulaw", "alaw"])
def test_g711_tables(law):
    assert telephony.TABLES[law].tolist() == [g711(i, law) for i in range(256)]


def plain_ima(data):
    out = []
    for at in range(0, len(data), 64):
        b = list(data[at : at + 64])
        value, index = int.from_bytes(bytes(b[:2]), "little", signed=True), min(b[2], 88)
        line = [value]
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEPS[index])
                delta = step >> 3
                delta += step if code & 4 else 0
                delta += step >> 1 if code & 2 else 0
                delta += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + int(telephony.IMA_MOVES[code & 7])))
                line.append(value)
        out.append(line)
    return out


def test_adpcm_blocks_equal_a_plain_decoder():
    data = np.random.default_rng(0).integers(0, 256, 64 * 7, dtype=np.uint8)
    assert telephony.ima_decode(data).tolist() == plain_ima(data.tolist())


def test_features_equal_a_plain_decoder(docs):
    for r in telephony.telephony_columns(docs, with_media=True).limit(25).collect():
        _, back = telephony.wav_payload(bytes(r.media))
        told = dict(x.rsplit("=", 1) for x in r.feature.split(";")[:-1])
        for law in ("mulaw", "alaw"):
            samples = [g711(b, law) for b in back]
            assert int(told[f"{law}:energy"]) == sum(v * v for v in samples)
            assert int(told[f"{law}:crossings"]) == sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        ima = [v for line in plain_ima(back) for v in line]
        assert (int(told["ima:energy"]), int(told["ima:peak"])) == (sum(v * v for v in ima), max(map(abs, ima)))
        assert r.feature.split(";")[-1] == f"pcm16000:{hashlib.sha256(r.pcm).hexdigest()[:16]}"


def test_pcm_is_packed_without_loss():
    """Any samples come back, those that no interpolation made too."""
    rng = np.random.default_rng(1)
    for pcm in (rng.integers(-32768, 32768, 640).astype(np.int16), np.array([-32768, 32767] * 64, dtype=np.int16), telephony.resample_double(telephony.TABLES["mulaw"][rng.integers(0, 256, 128)])):
        assert telephony.unpack_pcm(telephony.pack_pcm(pcm)).tolist() == pcm.tolist()


def test_the_feature_tells_the_stored_pcm(docs):
    """The table holds the PCM, and the feature changes with what the table holds."""
    stored = telephony.stored_media(docs.limit(3))
    assert {r.doc_id: len(r.pcm) for r in stored.collect()} == {r.doc_id: 4 * len(telephony.wav_payload(bytes(r.media))[1]) for r in stored.collect()}
    louder = stored.withColumn("pcm", F.unhex(F.regexp_replace(F.hex("pcm"), "^....", "0100")))
    one, other = ({r.doc_id: r.feature.split(";")[-1] for r in telephony.measured_media(d).collect()} for d in (stored, louder))
    assert all(one[k] != other[k] for k in one)


def test_audio_is_lossless(docs, rows):
    got = telephony.telephony_columns(docs, with_media=True).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        code, back = telephony.wav_payload(bytes(r.media))
        raw = back[: r.n_bytes]
        assert code == 7 and r.payload_bytes == len(back) > 0 and len(back) % 64 == 0 and not back[r.n_bytes :].strip(b"\0")
        assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and zlib.crc32(back[-64:]) == r.tail_crc32
        assert len(r.pcm) == 4 * len(back)
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert set(by_text) == {(t or "").encode() for _, t, *_ in rows}


# 5, 6


def removed(rows_, k, split, join):
    out = {}
    first = {}
    units = {}
    for d, t, *_ in rows_:
        units[d] = split(t or "")
        if d is not None:
            for i in range(len(units[d]) - k + 1):
                w = tuple(units[d][i : i + k])
                first[w] = min(first.get(w, d), d)
    for d, u in units.items():
        gone = [False] * len(u)
        if d is not None:
            for i in range(len(u) - k + 1):
                if first[tuple(u[i : i + k])] < d:
                    gone[i : i + k] = [True] * k
        kept = join([x for x, g in zip(u, gone) if not g])
        spans = len(re.findall("1+", "".join("1" if g else "0" for g in gone)))
        out[d] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_word_windows_equal_brute_force(docs, rows):
    want = removed(rows, 13, WORDS.findall, lambda w: " ".join(w).encode())
    got = debruijn.remove_repeated_windows(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 100


def test_byte_strings_equal_brute_force(docs, rows, monkeypatch):
    want = removed(rows, 50, lambda t: list(t.encode()), bytes)
    for limit in (suffix_groups.GROUP_BYTES, 100):
        monkeypatch.setattr(suffix_groups.segment_origins, "__defaults__", (limit,))
        got = suffix_groups.remove_repeated_bytes(docs).collect()
        assert len(got) == len(rows)
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


def test_texts_that_repeat_themselves(spark):
    rows_ = [(i, "ab " * n, None, None, None) for i, n in enumerate((5, 30, 400, 400, 90))] + [(9, "ab " * 50 + BASE, None, None, None), (10, BASE + " " + "ab " * 50, None, None, None)]
    df = spark.createDataFrame(rows_, DOCS)
    want = removed(rows_, 13, WORDS.findall, lambda w: " ".join(w).encode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in debruijn.remove_repeated_windows(df).collect()} == want
    want = removed(rows_, 50, lambda t: list(t.encode()), bytes)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_groups.remove_repeated_bytes(df).collect()} == want


def test_ids_do_not_follow_the_number_of_lines_encoded_together(monkeypatch):
    texts = ["one two, three. four\nfive " * 3 + f"word{i} more{i}x." for i in range(40)]
    encoder = packing.UnitEncoder(queries.public_tokenizer())
    want = [encoder._ids(t).tobytes() for t in texts]
    for lines in (1, 3, 2_000):
        monkeypatch.setattr(packing, "LINES", lines)
        assert packing.UnitEncoder(queries.public_tokenizer()).encode(texts) == want


def test_units_are_encoded_once_while_they_fit_and_ids_do_not_follow_what_is_kept(monkeypatch):
    encoder, asked = packing.UnitEncoder(queries.public_tokenizer()), []
    learn = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda units: asked.append(len(units)) or learn(units))
    letters = np.array(list("abcdefghij"))
    texts = [" ".join("".join(letters[list(map(int, f"{i:06}"))]) for i in range(at, at + 160_000)) for at in (0, 160_000, 320_000)]
    first = [encoder(t) for t in texts]
    assert [encoder(t) for t in texts] == first and sum(asked) <= 480_001 and asked[3:] == [0, 0, 0]
    texts = ["one two, three. four\nfive: " * 3 + f"more\u00e9. x{i % 7} word{i}!\n" for i in range(40)]
    want = [encoder._ids(t).tobytes() for t in texts]
    for kept in (0, 300, 1 << 20):
        monkeypatch.setattr(packing, "KEPT_BYTES", kept)
        small = packing.UnitEncoder(queries.public_tokenizer())
        assert [small(t) for t in texts + texts] == want + want
        assert small.units.nbytes + small.ids.nbytes <= kept


def test_suffix_order_equals_sorting():
    rng = np.random.default_rng(8)
    for _ in range(300):
        s = [int(x) + 1 for x in rng.integers(0, rng.integers(1, 6), rng.integers(1, 40))] * int(rng.integers(1, 4)) + [0]
        assert suffix_groups.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


# 7


def test_targets_stop_at_three_times():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.fill_targets([10, 1000, 0], [5, 2, 1])
    assert got == [30.0, 980.0, 0.0]


def test_schedule_is_even_and_exact(spark):
    plan = spark.createDataFrame([(0, "a", 1, 1.0, 1, 50, 0), (1, "b", 1, 1.0, 1, 13, 50), (2, "c", 1, 1.0, 1, 0, 63)], mixing.PLAN_SCHEMA)
    got = mixing.schedule(plan, 63).orderBy("slot").collect()
    for sid, n in ((0, 50), (1, 13)):
        mine = [r for r in got if r.sid == sid]
        assert [r["rank"] for r in mine] == list(range(n))
        assert all(abs((i + 1) - n * (r.slot + 1) / 64) <= 3 for i, r in enumerate(mine))


def test_mixture_meets_its_targets(docs, rows):
    for block in (16, 1024):
        got = mixing.mixed_words(docs, block=block).collect()
        assert len(got) == len(rows)
        assert sorted(r.size for r in got) == sorted(len(WORDS.findall(t or "")) for _, t, *_ in rows)
        sums = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            s = sums.setdefault((r.target, r.source_size), [0, 0])
            s[0] += r.taken
            s[1] += r.size
        assert all(abs(taken - target) <= 1 and size == total for (target, total), (taken, size) in sums.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_words(docs.repartition(1), block=1024).collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    rows_ = [(i, f"t{i} " * (i + 1), None, "ab"[i % 2], None) for i in range(12)]
    df = spark.createDataFrame(rows_, DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mixed_words(df).collect()}
    sums = {}
    for r in mixing.mixed_documents(df).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + len(r.text.split())
    assert sums == {k: v for k, v in taken.items() if v}


# 8


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (7, 3)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(6)
    rows_ = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in rng.permutation(70)]
    rows_ += [(i, rows_[0][1]) for i in range(100, 130)] + [(140, None), (160, [1.0, None]), (180, [float("nan")]), (None, [1.0]), (200, [2.0]), (201, [])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    fine = {i: np.pad(np.floor(64 * np.array(v, dtype=float)), (0, 8 - len(v))) for i, v in rows_ if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:20]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    got = vector_files.top_k(df, F.col("vec_id") % 20 == 0, candidates=blocks[0], queries_per_block=blocks[1])
    assert {tuple(r) for r in got.collect()} == want


# 9


def plain_fingerprint(text, shingle):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {t: plain_fingerprint(t, 3) for _, t, *_ in rows}
    of = [(d, fps[t]) for d, t, *_ in rows]
    group = {f: f for f in fps.values()}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for d, f in of:
        if d is not None:
            least[group[f]] = min(least.get(group[f], d), d)
    want = sorted((str(d), f"{f:016x}", least[group[f]]) for d, f in of)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_split_shards_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    keys = sorted({b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    df = spark.createDataFrame([(k,) for k in keys], "fp long")

    def parts(links):
        root = {k: k for k in keys}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {k: find(k) for k in keys}

    want = parts([(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 3])
    for tree in (2_048, 3):
        assert parts([(r.a, r.b) for r in simhash.radius_links(df, 3, tree).collect()]) == want


def test_bk_tree_finds_all_within():
    rng = np.random.default_rng(1)
    keys = [int(x) for x in rng.integers(0, 2**16, 200)]
    tree = simhash.BKTree()
    for k in keys:
        tree.add(k)
    for q in keys[:30]:
        assert set(tree.within(q, 3)) == {k for k in keys if (k ^ q).bit_count() <= 3}


# 10


def test_subset_sums_come_closest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(1, 30, 4)}, reverse=True)
        counts = [int(x) for x in rng.integers(1, 4, len(lengths))]
        taken = packing.fill_closest(lengths, counts, 50)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * i for s in sums for i in range(c + 1)}
        assert sum(k * c for k, c in taken.items()) == max(s for s in sums if s <= 50)
        assert all(c <= counts[lengths.index(k)] for k, c in taken.items())


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    encode, plain = packing.UnitEncoder(queries.public_tokenizer()), Tokenizer.from_file(queries.public_tokenizer())
    rng = np.random.default_rng(7)
    bits = ["a", "B", "foo", " ", "  ", "\n", "\n\n", "\t", "é", ".", ",", "'s", "12", "##", "\xa0", "日本", "\0", "<|endoftext|>"]
    for _ in range(400):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_loses_nothing(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.public_tokenizer())
    got = packing.pack_documents(docs, queries.public_tokenizer(), capacity=256).collect()
    want = []
    for d, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(d), at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()), len(ids)) for at in range(0, len(ids), 256)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(windows) <= -(-total // 256) + 1


# pipeline


def test_stages_keep_columns_and_take_effect(spark, docs, rows):
    docs = common.materialise(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "stage-docs")
    left = {r.doc_id for r in stages.near_duplicate_stage(spark, docs, "").collect()}
    assert 0 in left and not {1, 2, 10_000} & left
    texts_ = {r.doc_id: r.text for r in stages.passage_stage(spark, docs, "").collect()}
    assert texts_[0] == BASE and 1 not in texts_ and texts_[3] == "x y"
    assert not {4, 5, 6, 9} & {r.doc_id for r in stages.language_stage(spark, docs, "").collect()}
    for _, stage in stages.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, ""), "stage")
        assert out.columns == docs.columns
        docs = out
    final = stages.STAGES[-1][1](spark, docs, "")
    assert final.count() >= docs.count() > 0


def test_near_duplicate_stage_finds_edited_copies(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(5000)]

    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    passage = " ".join(rng.choice(vocabulary, 20))
    made = []
    for _ in range(60):
        base = list(rng.choice(vocabulary, int(rng.choice([9, 30, 70, 248, 600]))))
        made.append(" ".join(base))
        for share in (0.004, 0.01, 0.02, 0.03, 0.1):
            edited = base.copy()
            at = int(rng.integers(0, len(base)))
            edits = range(at, min(at + 1 + int(share * len(base)), len(base)))
            for i in edits if share == 0.1 else rng.choice(len(base), 1 + int(share * len(base)), replace=False):
                edited[i] = "edit"
            made.append(" ".join(edited))
        made.append(" ".join(rng.choice(vocabulary, 60)) + " " + passage)
    sets = [grams(t) for t in made]
    links = [(i, j) for j in range(len(made)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(links) > 200
    root = list(range(len(made)))
    for _ in range(len(made)):
        before = root.copy()
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    rows_ = [(i, t, "en", "a", len(t)) for i, t in enumerate(made)]
    left = {r.doc_id for r in stages.near_duplicate_stage(spark, spark.createDataFrame(rows_, DOCS).repartition(3), "").collect()}
    assert left == set(root)


def test_discard_removes_a_table(spark):
    table = common.materialise(spark.range(5), "gone")
    assert table.count() == 5
    common.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.scratch_path).count()
