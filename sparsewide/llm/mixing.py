"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame functions only).

Sizes are counted in words. The sources' targets share the total of all sizes by weight; none exceeds
`epochs` times its source's size, and what a capped source leaves is shared again by weight. The mix
is a sequence of slots of `block` words. Slot n stands at the golden-ratio point n * phi mod 1 and
belongs to the source whose stretch of the cumulative targets holds that point, so each prefix of the
schedule has the sources in their proportions to within a few slots. Slots are ranked per source. A
source's documents, shuffled by a seeded hash, lie end to end and are cut into equal blocks of
`block` words; slot r of the source takes its block r mod (number of blocks), so the blocks repeat
only after all have been taken.

Only ids, sources and sizes are kept of the documents, written once. Scale: prefix sums and ranks are two-level (counts per hash bucket or slot chunk, then inside one), so
a source with a third of all rows is spread over `BUCKETS` tasks. Points find their source by an
equi-join on one of 65,536 cells. Only one row per source (at most `max_sources`, checked) reaches
the driver.

Defined cases: null text has size 0. Null source is a source, last in order. Documents of size 0 and
sources of size 0 take nothing. Repeated rows each count as documents of their own; they share their
place by a tie order that doesn't change results per row. Very long texts count whole. Other columns are ignored, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, removed, written

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK = 64
BUCKETS = 4096
CHUNK = 1 << 16
#: Points are integers below RING; STEP / RING is the golden ratio's fraction.
RING, STEP = 1 << 31, 1327217885
CELL = 1 << 15


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> list[float]:
    """Targets of the sources in their order: weighted shares of the total, capped, the excess shared again until none is above."""
    cap = [epochs * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        per = rest / sum(w[i] for i in free)
        over = {i for i in free if w[i] * per > cap[i]}
        if not over:
            for i in free:
                out[i] = w[i] * per
            break
        for i in over:
            out[i] = float(cap[i])
            rest -= cap[i]
        free -= over
    return out


def _sources(sized: DataFrame, weights, epochs, max_sources: int) -> list[tuple]:
    """(source, size, target), by code point, null last."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    return [(r["source"], r["size"], t) for r, t in zip(found, targets([r["size"] for r in found], weights, epochs))]


def schedule(spark, sources: list[tuple], block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """(slot, src, rank): which source each slot draws from and the slot's rank among that source's slots."""
    total = sum(t for *_, t in sources)
    slots = int(-(-total // block)) if total else 0
    ends, edge, acc = [], 0, 0.0
    for i, (_, _, t) in enumerate(sources):
        acc += t
        end = RING if i == len(sources) - 1 else int(RING * acc / total) if total else 0
        ends.append((i, edge, max(edge, end)))
        edge = max(edge, end)
    stretches = spark.createDataFrame([e for e in ends if e[2] > e[1]], "src int, lo long, hi long")
    stretches = stretches.withColumn("cell", F.explode(F.expr(f"sequence(lo div {CELL}, (hi - 1) div {CELL})")))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % RING) * STEP % RING).alias("point")).withColumn("cell", F.expr(f"point div {CELL}"))
    # at most 65,536 cells and max_sources stretches: a size bound that doesn't depend on the data
    drawn = points.join(F.broadcast(stretches), "cell").filter("point >= lo and point < hi").select("slot", "src", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("src").orderBy("chunk")) - F.col("c")).drop("c")
    inside = drawn.withColumn("r", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
    return inside.join(before, ["src", "chunk"]).select("slot", "src", (F.col("before") + F.col("r")).alias("rank"))


def laid_out(sized: DataFrame, seed: str) -> DataFrame:
    """Adds `start`: the words before a document in its source's shuffled order."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = sized.filter("size > 0").withColumn("digest", digest).withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("src").orderBy("bucket")) - F.col("s")).drop("s")
    order = Window.partitionBy("src", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumn("within", F.sum("size").over(order) - F.col("size"))
    return inside.join(before, ["src", "bucket"]).select("doc_id", "src", "size", (F.col("before") + F.col("within")).alias("start"))


def _sized(docs: DataFrame, id_col, text_col, source_col) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))


def _numbered(sized: DataFrame, sources: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's number, and the table of sources."""
    schema = T.StructType([T.StructField("src", T.IntegerType()), sized.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = sized.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(sources)], schema)
    named = known.withColumnRenamed("source", "_source")
    return sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), known


def plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK,
    seed: str = "", max_sources: int = 100_000, sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents). pieces: slot, doc_id, src, from_word, n_words, the mix in slot order. documents: doc_id, source, size, src, source_size, target.

    `sizes` are (doc_id, source, size) where they are known already.
    """
    spark = docs.sparkSession
    sized = _sized(docs, id_col, text_col, source_col) if sizes is None else sizes
    sources = _sources(sized, weights, epochs, max_sources)
    sized, _ = _numbered(sized, sources)
    laid = laid_out(sized, seed)
    cut = laid.withColumn("b", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low, high = F.greatest(F.col("start"), F.col("b") * block), F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block)
    cut = cut.select("src", "b", "doc_id", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))
    blocks = spark.createDataFrame([(i, -(-s // block)) for i, (_, s, _) in enumerate(sources) if s], "src int, n_blocks long")
    slots = schedule(spark, sources, block, epochs).join(F.broadcast(blocks), "src").filter(F.col("rank") < F.col("n_blocks") * epochs)
    slots = slots.select("slot", "src", (F.col("rank") % F.col("n_blocks")).alias("b"))
    return slots.join(cut, ["src", "b"]).select("slot", "doc_id", "src", "from_word", "n_words"), sized


def taken(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Rows that share a doc_id and source get the mean of what their rows take, rounded down and held to `epochs` times their size.
    """
    epochs = kw.get("epochs", EPOCHS)
    own = {k: kw[k] for k in ("id_col", "text_col", "source_col") if k in kw}
    read = written(_sized(docs, **{"id_col": "doc_id", "text_col": "text", "source_col": "source"} | own), "sizes")  # each text is read once
    pieces, sized = plan(docs, sizes=read, **kw)
    got = pieces.groupBy("src", "doc_id").agg(F.sum("n_words").alias("got")).withColumnsRenamed({"src": "_s", "doc_id": "_d"})
    rows = sized.groupBy("src", "doc_id", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("rows"))
    alike = rows.groupBy("src", "doc_id").agg(F.sum(F.col("size") * F.col("rows")).alias("all"))
    alike = alike.withColumnsRenamed({"src": "_s2", "doc_id": "_d2"})
    out = rows.join(got, (F.col("src") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").join(alike, (F.col("src") == F.col("_s2")) & F.col("doc_id").eqNullSafe(F.col("_d2")))
    share = F.expr("coalesce(got, 0) * size div greatest(all, 1)")
    out = out.withColumn("taken", F.least(share, F.col("size") * epochs)).withColumn("i", F.explode(F.expr("sequence(1L, rows)")))
    out = written(out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")), "mix")
    removed(docs.sparkSession, read)
    return out
