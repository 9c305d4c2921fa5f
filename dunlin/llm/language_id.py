"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent letter n-grams (one to three letters, a word's edges
included).  A document's own profile is compared with that of every language by the out-of-place
distance: the sum over its n-grams of the difference of ranks, a missing n-gram counting as the worst.

Defined results: null text, and text without a letter, is `und` with score 0; equal distances go to the
alphabetically first language; rows without a language, or outside the learning set, teach nothing; if
nothing was learned every document is `und`; other columns are ignored; repeated rows count each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dunlin.llm.common import crc_fold, pieces, read

#: Lengths of n-grams, n-grams in a language's profile and in a document's.
GRAMS, PROFILE, DOCUMENT = (1, 2, 3), 400, 300
#: Bits of a character; n-grams of three make one number below 2^63.
_BITS = 21
_SPAN = 1 << _BITS


def _letters() -> np.ndarray:
    """Code point of the lower-case letter for every letter, a blank for everything else."""
    table = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low[0])
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, one for each place.  A run of non-letters is one blank."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]])
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    codes = codes[keep]
    if len(codes) < 2:
        return np.zeros(0, np.int64)
    out = [codes[codes != 32]]
    two = codes[:-1] * _SPAN + codes[1:]
    out.append(two)
    if len(codes) > 2:
        three = two[:-1] * _SPAN + codes[2:]
        out.append(three[codes[1:-1] != 32])       # an n-gram spans no gap between words
    return np.concatenate(out)


def top_grams(text: str, n: int) -> np.ndarray:
    """The n most frequent n-grams of a text, most frequent first, ties by the smaller number."""
    values, counts = np.unique(grams(text), return_counts=True)
    if len(values) > n:
        least = np.partition(counts, -n)[-n]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")[:n]]


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n: how often each n-gram stands in the texts of a language; summed in each task first."""
    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return values, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                by: dict[str, list] = {}
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    held.setdefault(lang, []).append(np.unique(np.concatenate([grams(x) for x in texts]), return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            values, counts = merged(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": counts})
    part = (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
            .mapInArrow(count, "lang string, gram long, n long"))
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The ranked n-grams of every language: `size` numbers each, whatever the number of documents."""
    ranked = (gram_counts(docs, text_col, lang_col)
              .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
              .where(F.col("rank") <= size))
    rows = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("top")).collect()
    return {r["lang"]: np.array([t["gram"] for t in r["top"]], np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


class Profiles:
    """All profiles as one sorted table, so that a document is looked up once."""

    def __init__(self, learned: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(learned), size
        self.grams = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, learned[name]), k] = np.arange(len(learned[name]))

    def judge(self, text: str | None, n: int = DOCUMENT) -> tuple[str, float, list[int]]:
        """Language, score (1 less the distance as a share of the worst), distance to every language."""
        top = top_grams(text, n) if text else np.zeros(0, np.int64)
        if not len(top) or not self.names:
            return "und", 0.0, []
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        rank = self.ranks[at]
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (len(top) * self.size)), distance.tolist()


def identify(docs: DataFrame, learned: dict[str, np.ndarray], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, distances (in the order of the languages' names) of every text."""
    def judge(batches):
        profiles = Profiles(learned, size)
        for batch in batches:
            found = [profiles.judge(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column("id"), "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64()), "distances": pa.array([f[2] for f in found], pa.list_(pa.int64()))})
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, f"`{id_col}` {kind}, lang_pred string, score double, distances array<long>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; profiles come from the two thirds whose checksum modulo 3 is not 1."""
    docs = read(spark, sf_dir, "documents")
    learned = learn_profiles(docs.where(crc_fold("doc_id", 3) != 1))
    return identify(docs, learned).select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
