"""Language identification by compression.

For each language a zstandard dictionary of raw content is made from a bounded
sample of labelled texts (at most `samples` texts per language, chosen by a hash
of the text, so copies count once; of a text over `sample_chars` characters PIECES
pieces of that length in all, from its beginning to its end), for the `languages`
most frequent languages.  A text is
encoded whole, in chunks, with every dictionary; the language whose dictionary
gives the fewest bytes wins, and a text is rejected where the runner-up takes
less than a twentieth more (`margin`; the README has the margins of clean,
foreign and mixed texts).

Defined cases: null text and text without a letter give `und`, score 0, rejected;
with no labelled rows every text does; ties go to the language with more labelled
rows, and are rejected; null labels are not learned; repeated rows are judged
alike; all columns of the input stay, except that columns named as the new ones
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from . import textops as T

UNKNOWN = "und"
LEVEL, CHUNK = 9, 1 << 12
PIECES = 5
NEW = ("lang_pred", "score", "rejected")
#: ASCII bytes that are no letters become spaces; the texts are lowered before.
_ASCII_LETTER = re.compile(rb"[a-z]")
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """The letters of a text in lower case; empty if it has none."""
    out = b" ".join(text.lower().encode("utf-8", "ignore").translate(_LETTERS).split())
    if not out or (not _ASCII_LETTER.search(out) and not any(c.isalpha() for c in text)):
        return b""
    return out


def learn(labelled: DataFrame, samples: int = 64, sample_chars: int = 1500, languages: int = 256) -> dict[str, bytes]:
    """Raw dictionaries by language, from the rows (text, lang) given; the most frequent language first."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text").withColumn("h", F.xxhash64("text"))
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    rows = rows.where(F.col("lang").isin([r["lang"] for r in often]))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(samples)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    texts = rows.join(F.broadcast(chosen.select(F.col("lang").alias("l"), F.col("h").alias("k"))), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")))
    piece = sample_chars // PIECES
    spread = f"concat_ws(' ', transform(sequence(0, {PIECES - 1}), i -> substring(text, cast(1 + i * (length(text) - {piece}) div {PIECES - 1} as int), {piece})))"
    texts = texts.select("lang", "h", F.when(F.length("text") > sample_chars, F.expr(spread)).otherwise(F.col("text")).alias("text")).dropDuplicates(["lang", "h"])
    out: dict[str, list[bytes]] = {row["lang"]: [] for row in often}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        out[row["lang"]].append(normal(row["text"]))
    return {lang: b" ".join(x for x in parts if x) for lang, parts in out.items() if any(parts)}


class Encoders:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = list(dictionaries)
        self.compress = []
        for name in self.names:
            # eight bytes at least, and none that reads as the mark of a trained dictionary
            d = zstandard.ZstdCompressionDict(b" " * 8 + dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return [sum(len(f(c)) for c in chunks) for f in self.compress]


def judge(sizes: list[int], names: list[str], margin: float) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected: the runner-up needs at least 1 + margin times the bytes."""
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    score = float(1 / np.sum(np.exp2(-np.minimum(np.array(sizes, float) - best, 100) / 2)))
    narrow = len(sizes) > 1 and (sizes[order[1]] <= best or sizes[order[1]] < best * (1 + margin))
    return names[order[0]], score, bool(narrow)


def _predict(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            found = []
            for text in T.column(batch, "text"):
                letters = normal(text.as_py()) if text.is_valid else b""
                found.append(judge(encoders.sizes(letters), encoders.names, margin) if letters and encoders.names else (UNKNOWN, 0.0, True))
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *NEW])

    return run


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.05) -> DataFrame:
    """All rows and columns of `docs` with lang_pred, score and rejected."""
    docs = docs.drop(*NEW)
    schema = St.StructType([*docs.schema.fields, St.StructField("lang_pred", St.StringType()), St.StructField("score", St.DoubleType()), St.StructField("rejected", St.BooleanType())])
    return docs.mapInArrow(_predict(dictionaries, margin), schema)


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds
