"""Op 9: language identification by compression.

Each language has a raw-content zstandard dictionary: lower-cased words of a bounded sample of its different texts, in
which long texts stand as blocks. Every language of a training text with a letter has a dictionary, however rare. A text is cut
into blocks of its words, every block is compressed with every language's dictionary, and the language with the fewest
bytes over the whole text wins. Where the second language comes within a narrow margin the decision is marked as rejected.

A text that is null or has no letter (digits, fractions and number signs aren't letters) gets `und` and score 0. Ties go to the language first in the alphabet. Without any
labelled text every prediction is `und`. Repeated rows get the same result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import arrow, small_batches, texts

#: The sample that dictionaries are made from: texts of each language, longest text in bytes (longer ones are cut into
#: blocks of a quarter as many characters), bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_LONGEST, DICT_BYTES = 300, 16_384, 110_000
#: Bytes of text that are compressed at once, the level, and the margin (of the smaller size) under which a decision is rejected.
BLOCK, LEVEL, MARGIN = 4096, 12, 0.01
#: Bytes of difference that change the odds of two languages by a factor of e.
SCALE = 8.0

_other = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """Letters and the marks on them, in lower case."""
    return _other.sub(" ", text.lower()).strip().encode()


def learn(docs: DataFrame, train: Column, lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from the rows where train holds.

    The sample goes by a hash of the text, at a rate by the number of a language's different texts; the text with the
    smallest hash is always in it.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select(F.col(lang_col).alias("lang"), "text")
    size = SAMPLE_LONGEST // 4  # a character has four bytes at most
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda i: F.substr("text", i * size + 1, F.lit(size)))
    rows = rows.select("lang", F.explode(F.when(F.octet_length("text") <= SAMPLE_LONGEST, F.array("text")).otherwise(blocks)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    rates = rows.select("lang", "h").distinct().groupBy("lang").agg(F.min("h").alias("first"), (F.lit(float(SAMPLE_TEXTS)) / F.count("*")).alias("rate"))
    kept = rows.join(F.broadcast(rates), "lang").where((F.col("h") == F.col("first")) | (F.col("h").cast("double") / (1 << 62) < F.col("rate")))
    found: dict[str, list[str]] = {}
    for r in kept.select("lang", "text").dropDuplicates().collect():  # about SAMPLE_TEXTS a language
        found.setdefault(r["lang"], []).append(r["text"])
    made = {lang: _dictionary(own) for lang, own in sorted(found.items())}
    return {lang: d for lang, d in made.items() if d}


def _dictionary(own: list[str]) -> bytes:
    size, out = 0, []
    for t in sorted(own, key=lambda t: (len(t) > 200, zlib.crc32(t.encode()))):
        t = plain(t)
        if not 0 < len(t) <= DICT_BYTES - size:
            continue
        out.append(t)
        size += len(t) + 1
    return b" ".join(out)


class Sizes:
    """Compressed sizes of texts by language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.with_ = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.with_.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def of(self, text: bytes) -> np.ndarray:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return np.array([sum([len(c.compress(b)) for b in blocks]) for c in self.with_], np.int64)


_made: dict[int, Sizes] = {}


def _sizes_of(dictionaries: dict[str, bytes]) -> Sizes:
    """The compressors in this worker process; only the last ones are kept."""
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _made:
        _made.clear()
        _made[key] = Sizes(dictionaries)
    return _made[key]


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes = _sizes_of(dictionaries)
        pred, score, margin = [], [], []
        for t in b.column("text").to_pylist():
            t = plain(t) if any(map(str.isalpha, t)) else b""
            if not t or not sizes.langs:
                pred.append("und")
                score.append(0.0)
                margin.append(0.0)
                continue
            n = sizes.of(t)
            best = int(n.argmin())
            rest = np.delete(n, best)
            pred.append(sizes.langs[best])
            score.append(float(1 / (1 + np.exp(np.maximum(-50, -(rest - n[best]) / SCALE)).sum())))
            margin.append(float((rest.min() - n[best]) / max(1, n[best])) if len(rest) else 1.0)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < MARGIN for m in margin])], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow(batches, work)

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
