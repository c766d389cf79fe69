"""License scans: fuzzy search for short notices.

A notice that occurs with at most k edits, cut into k + m seeds, leaves m seeds untouched (pigeonhole);
m is one for short notices and grows with their length. Each seed is looked up exactly in the normalised text; around its hits the
`regex` library's bounded-error matching, `(?:notice){e<=k}` with the best match asked for, verifies the
notice and gives its span and edits. Exact occurrences of the base phrases are counted apart.

Text is normalised to its words (A-Z lower-cased, anything but digits, letters and non-ASCII parts
words) joined by single spaces; spans are in words.

A notice counts where it stands with whole words on both sides and at most its number of edits (insertions,
deletions, substitutions of bytes); of overlapping matches of one notice the first best one is reported.
More notices can be passed as (phrase, label, edits).

Defined cases: null text has no words. Overlapping exact places all count. Ties: labels are sorted; of
matches with equal edits the first. Repeated rows stay, each with its result. Very long texts are scanned
whole, around seed hits only. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices found with edits, and how many.
NOTICES = {
    "gnu general public license": ("gpl", 3), "gnu lesser general public license": ("lgpl", 3), "licensed under the apache license version 2 0": ("apache", 4),
    "released under the mit license": ("mit", 3), "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "licensed under cc by": ("cc-by", 2), "creative commons attribution": ("cc-by", 3), "mozilla public license": ("mpl", 2),
    "redistribution and use in source and binary forms": ("bsd", 4), "all rights reserved": ("all-rights-reserved", 2),
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": ("isc", 8),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": ("gpl", 8),
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": ("apache", 8),
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": ("mit", 9),
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": ("bsd", 9),
    "this work is licensed under a creative commons attribution 4 0 international license": ("cc-by", 6),
    "this source code form is subject to the terms of the mozilla public license v 2 0": ("mpl", 6),
}
#: Bytes that are no part of a word become spaces; A-Z become a-z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Notice:
    def __init__(self, phrase: str, label: str, edits: int):
        self.phrase, self.label, self.edits = phrase.encode(), label, edits
        self.least = 1 + len(self.phrase) // 50  # seeds that must be whole; more are cut as the notice is longer
        cut = np.linspace(0, len(self.phrase), edits + self.least + 1).astype(int)
        self.seeds = [(int(a), self.phrase[a:b]) for a, b in zip(cut, cut[1:])]
        self.fuzzy = regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(self.phrase), edits))


_NOTICES = [Notice(p, *v) for p, v in NOTICES.items()]


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split())


def _places(norm: bytes, phrase: bytes) -> list[int]:
    out, padded, at = [], b" " + norm + b" ", 0
    while (at := padded.find(b" " + phrase + b" ", at)) >= 0:
        out.append(at)
        at += 1
    return out


def _stretches(hits: list[tuple[int, int]], n: Notice, reach: int, size: int):
    """Parts of the text around hits, those that overlap as one; each has all of the notices that its hits can belong to."""
    lo = hi = None
    seen: set[int] = set()
    for start, offset in hits:
        a, b = max(0, start - 2 * n.edits), min(size, start + reach + 2 * n.edits)
        if hi is not None and a <= hi:
            hi = max(hi, b)
        else:
            if len(seen) >= n.least:
                yield lo, hi
            lo, hi, seen = a, b, set()
        seen.add(offset)
    if len(seen) >= n.least:
        yield lo, hi


def spans(norm: bytes, notices: list[Notice] = _NOTICES) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice) in bytes of the normalised text; the best match near each group of seed hits."""
    out = []
    for n in notices:
        reach, hits = len(n.phrase) + n.edits, []
        for offset, seed in n.seeds:
            at = -1
            while (at := norm.find(seed, at + 1)) >= 0:
                hits.append((max(0, at - offset), offset))
        for lo, hi in _stretches(sorted(hits), n, reach, len(norm)):
            parts = [(lo, hi)]
            while parts:  # the best match, then what is left on both sides of it
                at, end = parts.pop()
                m = n.fuzzy.search(norm, at, end) if end - at >= len(n.phrase) - n.edits else None
                if m:
                    out.append((n.label, m.start(), m.end(), sum(m.fuzzy_counts), len(n.phrase)))
                    parts += [(at, m.start()), (m.end(), end)]
    return out


def scan_text(text: str | None, notices: list[Notice] = _NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans [(label, first word, last word, edits)]."""
    norm = normal(text)
    n_words = norm.count(b" ") + 1 if norm else 0
    starts, base = [], set()
    for phrase, label in BASE.items():
        if got := _places(norm, phrase.encode()):
            base.add(label)
            starts += [norm.count(b" ", 0, at) for at in got]
    found = spans(norm, notices)
    labels = base | {s[0] for s in found}
    score = 1.0 if base else max([0.0, *(1 - s[3] / s[4] for s in found)])
    words = [(s[0], norm.count(b" ", 0, s[1]), norm.count(b" ", 0, s[2]), s[3]) for s in found]
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, words


SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:bigint>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        own = _NOTICES if notices is None else [Notice(p, *v) for p, v in notices.items()]
        for b in batches:
            out = pd.DataFrame([scan_text(t, own) for t in b["text"]], columns=cols, index=b.index)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out["spans"] = [[{"label": a, "first_word": x, "last_word": y, "edits": e} for a, x, y, e in s] for s in out["spans"]]
            yield out.assign(doc_id=b["doc_id"])

    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    done = narrow.mapInPandas(run, f"doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)
