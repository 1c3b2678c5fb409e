"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters of lower-cased words, a word
padded by one mark on each side) in order of frequency, ties by the n-gram. A document gets a profile of its own; its
distance to a language is the sum over the document's n-grams of how far they are out of place in the language's
list, an n-gram not in the list counting as far as the list is long. The least distance wins, ties go to the first
language in code point order.

Counts cover all n-grams of all training documents. Tasks add them up in arrays before the shuffle, so a language or
a document with most of the text is not gathered anywhere. Profiles (``size`` n-grams for each of the learned
languages) are the only thing that reaches the driver. Without training documents every prediction is ``und``, as it
is for null texts and those without a letter. Null doc_id: its decimal text is empty for the fold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
PROFILE = 400
ORDERS = (1, 2, 3)
#: Fixed value: stands for the edge of a word; below every letter.
EDGE = 32
BATCH_CHARS = 4_000_000


def letter_table() -> np.ndarray:
    """True at every code point that is a letter; made on the driver and sent along as bits."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), dtype=bool, count=0x110000)


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def letters_of(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters as one EDGE, EDGE at both ends; empty without letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[points]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    cut = np.where(is_letter, points, EDGE).astype(np.uint64)
    keep = np.empty(len(cut), bool)
    keep[0] = is_letter[0]
    keep[1:] = is_letter[1:] | is_letter[:-1]
    cut = cut[keep]
    edge = np.array([EDGE], np.uint64)
    return np.concatenate((edge, cut, edge if cut[-1] != EDGE else edge[:0]))


def grams(points: np.ndarray) -> np.ndarray:
    """All n-grams as numbers of 21 bits per code point; the single EDGE is not one, nor is a gram across words."""
    out = [points[points != EDGE]]
    two = (points[:-1] << np.uint64(21)) | points[1:]
    out.append(two)
    inner = points[1:-1] != EDGE
    out.append(((two[:-1] << np.uint64(21)) | points[2:])[inner])
    return np.concatenate(out)


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


def ranked(numbers: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, by count and then by number."""
    values, counts = counted(numbers)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:size]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (lang, text)."""

    letters = np.packbits(letter_table()).tobytes()

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = unpacked(letters)
        for frame in frames:
            for lang, texts in frame.groupby("lang", sort=True)["text"]:
                parts, chars = [], 0
                for text in texts:
                    points = letters_of(text, table)
                    if len(points):
                        parts.append(grams(points))
                        chars += len(points)
                    if chars > BATCH_CHARS:
                        yield frame_of(lang, parts)
                        parts, chars = [], 0
                if parts:
                    yield frame_of(lang, parts)

    def frame_of(lang: str, parts: list[np.ndarray]) -> pd.DataFrame:
        values, counts = counted(np.concatenate(parts))
        return pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": counts.astype(np.int64)})

    return docs.select("lang", "text").mapInPandas(common.releasing(add_up), "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages of ``docs`` (lang, text), null languages left out: size n-grams each."""
    common.bounded_batches(docs.sparkSession)
    counts = count_grams(docs.filter(F.col("lang").isNotNull()))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    found: dict[str, list] = {}
    for row in top.orderBy("lang", "place").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return {k: np.array(v, dtype=np.uint64) for k, v in found.items()}


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.names])) if profiles else np.empty(0, np.uint64)
        self.places = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for i, k in enumerate(self.names):
            self.places[i, np.searchsorted(self.grams, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        points = letters_of(text, letters)
        if not len(points) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(grams(points), self.size)
        at = np.searchsorted(self.grams, own)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        places = self.places[:, at]
        away = np.where(places >= 0, np.minimum(np.abs(places - np.arange(len(own))), self.size), self.size).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], float(1.0 - away[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with lang_pred and score; nothing but the text is looked at."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    letters = np.packbits(letter_table()).tobytes()

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(letters)
        ranker = Ranker(profiles, size)
        for batch in batches:
            found = [ranker.predict(t, table) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(common.releasing(guess), f"{fields}lang_pred string, score double")


def held_out(mod: int, rest: int = 2):
    """Fold of a document: crc32 of its id as text."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(digits, "utf-8")) % mod == rest


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three of four folds."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~held_out(4)).select("lang", "text"))
    rows = docs.select("doc_id", held_out(4).alias("held_out"), "text")
    return predict(rows, profiles, keep=["doc_id", "held_out"])
