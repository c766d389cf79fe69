"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter is one array of slots whose words hold a bit for each language. An n-gram's
bit patterns at its hash slots, and-ed together, are the languages that contain it. For a text the bits
of all its n-grams are counted per language and corrected for the filter's false positives (the share
of slots with the language's bit, to the power of the number of hashes); the largest share decides.

N-grams are three code points of the lower-cased text, with everything but letters as one blank.
The filter is fitted on labelled rows: at most about `sample` of them, chosen by a hash of the id (all
where there are fewer). An n-gram enters for a language if it was seen there `min_count` times and its
share there is at least `share` of its largest share in any language. The filter has `LOAD` slots for
each distinct n-gram that enters, so its size follows from the sample, which is bounded (a text of the
sample adds at most its own length), and predictions cover every whole text.

Defined cases: null text or no letter: `und`, score 0. No labelled rows, or a language without an n-gram
that is frequent enough: never predicted, all `und` if there is none. Ties: the first language by name.
Very long texts are read whole, a block of n-grams at a time. Repeated rows stay. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE, MIN_COUNT, SHARE = 8_000, 3, 0.3
HASHES, LOAD = 3, 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_alpha: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _alpha


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of the text's n-grams, repeats included; empty where it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(c):
        return np.zeros(0, np.uint64)
    c = np.where(letters()[c], c, 0)
    c = np.r_[np.uint32(0), c, np.uint32(0)]
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]].astype(np.uint64)  # one blank for each run
    if len(c) < 3:
        return np.zeros(0, np.uint64)
    h = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    h = h[c[1:-1] != 0] * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


class Filter:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table  # table: slots x words of 64 languages
        bits = np.unpackbits(table.view(np.uint8).reshape(len(table), -1), axis=1, bitorder="little")[:, : len(langs)]
        self.false = bits.mean(axis=0) ** HASHES

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], load: int = LOAD) -> Filter:
        langs = sorted(grams)
        slots = max(1024, load * len(np.unique(np.concatenate(list(grams.values()))))) if grams else 1024
        table = np.zeros((slots, max(1, -(-len(langs) // 64))), "<u8")
        for i, lang in enumerate(langs):
            for at in slots_of(grams[lang].astype(np.uint64), slots):
                np.bitwise_or.at(table[:, i // 64], at, np.uint64(1 << (i % 64)))
        return cls(langs, table)

    def shares(self, text: str | None) -> np.ndarray | None:
        """Per language the corrected share of the text's n-grams, or None without letters."""
        h = ngrams(text)
        if not len(h) or not self.langs:
            return None
        count = np.zeros(len(self.langs), np.int64)
        for lo in range(0, len(h), 1 << 16):
            mask = np.bitwise_and.reduce([self.table[at] for at in slots_of(h[lo : lo + (1 << 16)], len(self.table))])
            for i in range(len(self.langs)):
                count[i] += int(((mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
        return np.clip((count / len(h) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.shares(text)
        return ("und", 0.0) if s is None else (self.langs[int(s.argmax())], float(s.max()))


def slots_of(h: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (h * _MIX[2]) | np.uint64(1)
    return [((h + np.uint64(k) * step) >> np.uint64(8)) % np.uint64(slots) for k in range(HASHES)]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, min_count: int = MIN_COUNT, share: float = SHARE) -> Filter:
    """labelled: rows to learn from; those without text or language are left out."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)))

    def run(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                h, c = np.unique(np.concatenate([ngrams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "c": c})

    seen = rows.filter(part | F.lit(n <= sample)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(run, "lang string, h long, c long")
    seen = seen.groupBy("lang", "h").agg(F.sum("c").alias("c"))
    total = seen.groupBy("lang").agg(F.sum("c").alias("total"))
    seen = seen.filter(F.col("c") >= min_count).join(total, "lang").withColumn("f", F.col("c") / F.col("total"))
    seen = seen.withColumn("most", F.max("f").over(Window.partitionBy("h"))).filter(F.col("f") >= F.col("most") * share)
    kept = seen.select("lang", "h").toPandas()
    return Filter.build({lang: h["h"].to_numpy(np.int64).view(np.uint64) for lang, h in kept.groupby("lang")})


def predict(docs: DataFrame, model: Filter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))

    def run(batches):
        own = Filter(*shared.value)
        for b in batches:
            got = [own.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    done = narrow.mapInPandas(run, "doc_id string, lang_pred string, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
