"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

An overlap is accepted if `window` words in a row (the whole item where it is shorter) agree in at least `agree` of the places. A mask such as 111000111
hashes the words at its ones and ignores those at its zeros, so a substituted word at an ignored place doesn't hide a passage. Every place of every document
is hashed under each mask and joined with the hashes of the benchmark's places; around a hit the document and the item are laid side by side on the hit's
diagonal and the overlap is verified.

The masks follow from what is accepted, so none is missed: n words with at most e substitutions are cut into e + 2 parts, of which two stay whole; each pair of
parts is a mask (of 13 words with 2 substitutions three remain, as a mask that holds another one adds nothing). Items shorter than the window have their own e
and masks in the same way, which are only joined with items of that length.

Hashing is one generated-code pass: words -> array of 64-bit hashes -> explode(places) -> xxhash64 -> hash join. If the benchmark's seeds, counted first, are
at most `broadcast_seeds`, they are broadcast and each hit carries the slice of hashes beside the item. Beyond that both sides are shuffled by seed (AQE splits
frequent ones) as (document, place, key) only, and the few documents with a hit are hashed once more to be verified; no place carries its document.

Defined cases: null or wordless texts never match. Rows with one doc_id (null is an id too) are reported together, by the row with most words equal. Items
without an id are left out. Repeated items report once. Very long texts are hashed whole. Columns other than id and text are ignored, whatever their names.
Empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, AGREE = 13, 0.8


def needed(n: int, agree: float = AGREE) -> int:
    """Equal words asked for in n."""
    return math.ceil(round(n * agree, 9))


def masks_for(n: int, errors: int) -> list[str]:
    """Masks of which one fits any n words with at most `errors` substituted, without those that hold a shorter one."""
    parts = errors + 2
    if errors == 0 or n < parts:
        return ["1" * n] if errors == 0 else ["1"]
    edge = [n * k // parts for k in range(parts + 1)]
    found = []
    for a, b in combinations(range(parts), 2):
        found.append("".join("1" if edge[a] <= i < edge[a + 1] or edge[b] <= i < edge[b + 1] else "0" for i in range(n)).strip("0"))
    found = sorted(set(found), key=lambda m: (m.count("1"), len(m), m))
    held = lambda small, big: any(all(s == "0" or b == "1" for s, b in zip(small, big[k:])) for k in range(len(big) - len(small) + 1))
    return [m for i, m in enumerate(found) if not any(held(x, m) for x in found[:i])]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, id_col: str, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    i, h, n = names
    return df.select(F.col(id_col).alias(i), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias(h)).withColumn(n, F.size(h))


def _places(df: DataFrame, h: str, n: str, masks: list[tuple[str, int]], at: str) -> DataFrame:
    """A row per place and mask with the seed's hash `key`. masks: (mask, length of the items it is for or 0)."""
    m = len(masks)
    df = df.filter(F.col(n) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(n) * m - 1)))
    df = df.withColumn(at, F.expr(f"k div {m}").cast("int")).withColumn("mask", F.col("k") % m)
    keys = [F.xxhash64(F.lit(f"{only} {mask}"), *[F.get(h, F.col(at) + o) for o, bit in enumerate(mask) if bit == "1"]) for mask, only in masks]
    spans = [F.lit(len(mask)) for mask, _ in masks]
    pick = lambda xs: reduce(lambda rest, ix: F.when(F.col("mask") == ix[0], ix[1]).otherwise(rest), list(enumerate(xs))[1:], xs[0])
    return df.filter(F.col(at) + pick(spans) <= F.col(n)).withColumn("key", pick(keys)).drop("k").withColumn("only", pick([F.lit(only) for _, only in masks]))


def overlaps(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, agree: float = AGREE, broadcast_seeds: int = 200_000,
) -> DataFrame:
    """One row per document, item and diagonal accepted: id, item id, start_word (of the overlap in the document), compared, matched."""
    items = _hashed(bench.filter(F.col(item_col).isNotNull()), item_col, item_text, ("item", "ih", "len"))
    size = items.agg(F.sum("len").alias("n"), F.collect_set(F.when((F.col("len") > 0) & (F.col("len") < window), F.col("len"))).alias("short")).first()
    masks = [(m, 0) for m in masks_for(window, window - needed(window, agree))]
    masks += [(m, n) for n in sorted(size["short"] or []) for m in masks_for(n, n - needed(n, agree))]
    small = (size["n"] or 0) * len(masks) <= broadcast_seeds
    seen = F.broadcast if small else (lambda df: df)
    seeds = _places(items, "ih", "len", masks, "j").filter((F.col("only") == F.col("len")) | ((F.col("only") == 0) & (F.col("len") >= window)))
    seeds = seeds.select("key", "item", "len", "j").distinct()
    hashed = _hashed(docs, id_col, text_col, ("doc", "dh", "n"))
    places = _places(hashed, "dh", "n", masks, "i")
    diag = (F.col("i") - F.col("j")).alias("diag")
    if small:
        hits = places.join(seen(seeds), "key").select("doc", "item", diag, "len", "n", "dh")
    else:
        hits = places.select("doc", "i", "key").join(seeds, "key").select("doc", "item", diag, "len").distinct()
        hits = hits.withColumnRenamed("doc", "_doc").join(hashed, F.col("_doc").eqNullSafe(F.col("doc")))
    first = F.greatest(F.col("diag"), F.lit(0))
    hits = hits.select("doc", "item", "diag", F.slice("dh", first + 1, F.greatest(F.least(F.col("n"), F.col("diag") + F.col("len")) - first, F.lit(0))).alias("dh")).distinct()
    both = hits.join(seen(items.distinct()), "item")
    both = both.withColumn("eq", F.zip_with("dh", F.expr("slice(ih, greatest(-diag, 0) + 1, size(dh))"), lambda a, b: F.when(a == b, 1).otherwise(0)))
    w = F.least(F.lit(window), F.col("len"))
    least = F.ceil(F.round(w * F.lit(agree), 9))
    wins = F.exists(F.sequence(F.lit(1), F.size("eq") - w + 1), lambda s: F.aggregate(F.slice("eq", s, w), F.lit(0), lambda a, x: a + x) >= least)
    found = both.filter(F.expr("size(eq)") >= w).filter(wins)
    found = found.select("doc", "item", "diag", F.struct(F.aggregate("eq", F.lit(0), lambda a, x: a + x).alias("matched"), F.size("eq").alias("compared")).alias("best"))
    return found.groupBy("doc", "item", "diag").agg(F.max("best").alias("best")).select(
        F.col("doc").alias(id_col), F.col("item").alias("item_id"), F.greatest("diag", F.lit(0)).cast("long").alias("start_word"),
        F.col("best.compared").cast("long").alias("compared"), F.col("best.matched").cast("long").alias("matched"),
    )


def clean(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents without an accepted overlap, all their columns kept."""
    bad = overlaps(docs, bench, id_col=id_col, **kw).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad")), "left_anti")
