"""Language ID by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the fitted sample: per language this many documents and this many characters of each, of which the last
#: ``DICTIONARY_BYTES`` bytes (in hash order of the documents) are the dictionary. At most ``MAX_LANGUAGES`` times
#: ``SAMPLE_DOCS`` times ``SAMPLE_CHARS`` characters (134 million) reach the driver, one language's rows at a time being usual.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 96 * 1024
MAX_LANGUAGES = 512
#: Texts are compressed in blocks of this many bytes, so that the dictionary, not the text before, is what helps.
BLOCK = 2048
LEVEL = 6
#: Rejected when the second language's size is within this share of the best.
MARGIN = 0.004
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compared: lower-cased words of letters, all else a blank."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit_dictionaries(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A raw-content dictionary per non-null language from labelled rows.

    The sample is bounded: ``SAMPLE_DOCS`` hash buckets per language, of each
    the document with the least hash, of that ``SAMPLE_CHARS`` characters. It is
    a grouped minimum, combined before the shuffle; nulls take no part.
    """
    h = F.xxhash64(F.col(key), F.col(text))
    sample = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang"), F.pmod(h, F.lit(SAMPLE_DOCS)).alias("b"))
    picked = sample.agg(F.min(F.struct(h.alias("h"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"))).alias("s")).select("lang", "s.*")
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.limit(MAX_LANGUAGES * SAMPLE_DOCS + 1).toLocalIterator():
        texts.setdefault(r.lang, []).append((r.h, r.text))
        if len(texts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {k: b"\n".join(letters(t) for _, t in sorted(v))[-DICTIONARY_BYTES:] for k, v in sorted(texts.items())}


class CompressionClassifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); score is how much larger the second size is, on a scale where 0.2 and more is 1."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = letters(text)
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sizes = sorted((sum([len(c.compress(b)) for b in blocks]), i) for i, c in enumerate(self.compressors))
        if len(sizes) == 1:
            return self.names[sizes[0][1]], 1.0, False
        best, second = sizes[0][0], sizes[1][0]
        margin = (second - best) / second
        return self.names[sizes[0][1]], min(1.0, margin / 0.2), margin < MARGIN


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred string, score double, rejected boolean`` from the whole text.

    ``und`` (score 0, rejected) if the text is null or has no letter; otherwise
    the language whose dictionary compresses it smallest, ties to the first
    name. ``rejected`` says that the margin is narrow. Without any labelled row
    everything is ``und``. Input columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*keep)
    at = keep.index(text)
    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(dictionaries)
        for batch in batches:
            said = [model(v.as_py()) for v in batch.column(at)]
            extra = [pa.array([s[i] for s in said], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(classify, schema)


def held_out(key: str = "doc_id", of: int = 4, fold: int = 2):
    """The fold of a row: crc32 of its id as text, modulo ``of``."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == fold, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and predict every row."""
    named = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    dictionaries = fit_dictionaries(named.where("NOT held_out"))
    return predict_languages(named.select("doc_id", "held_out", "text"), dictionaries).drop("text")
