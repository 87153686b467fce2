"""Language of texts by compression: the language whose dictionary shortens a text most.

fit() gathers, per language, a raw-content zstandard dictionary of sample texts. Texts are put in lower case with one
space for whatever isn't a letter. A text is cut into blocks, so that long ones don't merely learn from themselves, and
every block is compressed with each dictionary; the language with the fewest bytes over all blocks wins. confident
tells whether the runner-up needs at least margin more; a caller rejects the others.

Null texts and texts without a letter are "und" with score 0; so is every text when nothing was learnt. Ties go to
the language that comes first in alphabetical order and have a score near 1 / (number of languages). Texts are read
whole. The sample per language is bounded by texts_per_language and dictionary_bytes, and languages by most_languages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "struct<lang: string, score: double, confident: boolean>"

#: Bytes compressed at once; small enough that the dictionary, not the text itself, is what helps.
BLOCK = 4096

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", texts_per_language: int = 400, dictionary_bytes: int = 65_536, most_languages: int = 200
) -> dict[str, bytes]:
    """Sample texts of each language as one byte string. docs are the rows that may be learnt from.

    Texts are dealt into texts_per_language groups by the hash of what they say, and the smallest hash of each group
    is taken; that takes copies once, doesn't depend on how rows are stored, and sums up before anything is shuffled. Of a
    long text an even share of the dictionary is taken from its middle.
    """
    share = dictionary_bytes * 4 // texts_per_language
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - share) / 2)).cast("int")
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", middle, F.lit(share)).alias("text"))
    group = F.pmod("h", F.lit(texts_per_language)).alias("n")
    chosen = rows.groupBy("lang", group).agg(F.min(F.struct("h", "text")).alias("t")).select("lang", "n", "t.text")
    # at most texts_per_language short texts a language
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "n").toLocalIterator():
        out.setdefault(row["lang"], []).append(letters(row["text"]))
        if len(out) > most_languages:
            raise ValueError(f"more than {most_languages} languages")
    return {name: " ".join(texts).encode()[:dictionary_bytes] for name, texts in out.items()}


class Classifier:
    def __init__(self, samples: dict[str, bytes], margin: float = 0.01):
        self.langs = sorted(samples)
        self.margin = margin
        self.sizes = []
        for name in self.langs:
            words = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # short matches count, as in short texts; no frame extras, so that sizes differ by content alone
            how = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=BLOCK, dict_size=max(1, len(samples[name])), min_match=3, strategy=zstandard.STRATEGY_BTOPT,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            self.sizes.append(zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        data = letters(text).encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        bits = [8 * sum(len(size(b)) for b in blocks) for size in self.sizes]
        best = min(bits)
        # a probability per language from the code lengths, tempered by the length so that long texts don't all reach 1
        weights = [math.exp((best - b) / (1 + len(data) ** 0.5)) for b in bits]
        others = sorted(bits)[1:]
        confident = not others or others[0] - best >= self.margin * best
        return self.langs[bits.index(best)], 1 / sum(weights), confident


def predict(spark: SparkSession, text: Column, samples: dict[str, bytes], margin: float = 0.01) -> Column:
    """struct<lang, score, confident> of each whole text."""
    shared = spark.sparkContext.broadcast(samples)

    @F.arrow_udf(RESULT)
    def languages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value, margin=margin)
        for batch in batches:
            rows = [model.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))],
                names=["lang", "score", "confident"],
            )

    return languages(text)
