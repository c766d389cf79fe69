"""Quality rules: base counts and modified Kneser-Ney perplexity bands by language.

The model is of word bigrams (words: runs of non-white-space, A-Z lower-cased), one for each language, counted in Spark over all whole documents; it grows with
the corpus and is never gathered in one place. Each document is scored by the model of all other documents: its own counts (and those of its exact copies,
which count once) are taken out of every count, so no text is judged by itself.

Tables are sorted arrays of hashes, delta coded, cut into hash ranges of about `RANGE` entries, each in a task of its own. Hashes are as wide as the corpus asks
for: `SPARE_BITS` more than the logarithm of its size, up to 64. Documents are packed into blocks
that are written once. Two rounds of questions follow, in which a block sends each range the sorted distinct hashes it needs, with its own counts, and gets the
sums over all blocks back; the ranges' arrays are the model.

1. Bigrams: how often a bigram occurs in all, and which block counts it as a type (the first that holds it).
2. Words: occurrences as a context, types that follow it once, twice and more often, and types that precede it (the continuation counts of the lower order).

An answer is looked up by its place in the sorted array. With n(bc), n(b), types N1(b), N2(b), N3+(b), continuation counts m(c), their sum M, and V words, all less
the document's own,

    p(c | b) = max(n(bc) - D(n(bc)), 0) / n(b) + (D1 N1 + D2 N2 + D3 N3+)(b) / n(b) * p(c)
    p(c)     = max(m(c) - D'(m(c)), 0) / M + (sum of D') / M / V

with Chen and Goodman's discounts from the counts of counts of all documents. A document's log perplexity is the mean of -log p over its words; each starts
in a context of its own. Per language, the median q2 and upper quartile q3 of the documents that pass the base rules give the band
[lower * q2, q3 + above * (q3 - q2)]; documents outside are rejected. The upper limit shuts out text that reads like none of the language's. The lower one is set
for text that the others predict word by word; it has its own scale because near copies, which are another operator's work, fill the lower half of the
distribution. Quartiles come from a histogram of thousandths, so they are the same on every run.

Scale: a row between tasks holds at least one hash, so rows never exceed bigrams, and a frequent word or bigram enters once a block. Answers go to blocks by hash
joins. One row a language (totals and discounts) reaches the driver.

Defined cases: null text has no words and fails the base rules. Null language is a language of its own. A language without a document that passes the base rules
has no band. Repeated rows each get their row and count once. Very long texts make a block of their own and are taken whole. Different
words of equal hash share their counts; no probability becomes zero by that. Other columns are ignored, whatever their names. Empty tables: no rows.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucketed, removed, shuffles_removed, written
from .hash_arrays import answers_of, cuts, deltas, mixed, powers, small, split, told_of, unsmall, values

SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))
BLOCK, RANGE = 4 << 20, 1 << 20
#: Bits of a hash beyond the logarithm of the corpus' bytes. As there are fewer words and bigrams than bytes, well below one in 256 meets another.
SPARE_BITS = 8
ABOVE, LOWER = 5.0, 0.35
_BYTES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_START = np.uint64(0x51AB7E5C3D9F2B17)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat = 0
    if len(w) > 2:
        tri = list(zip(w, w[1:], w[2:]))
        if len(set(tri)) < len(tri):
            count = Counter(tri)
            again = np.fromiter((count[t] > 1 for t in tri), bool, len(tri))
            inside = np.zeros(len(w), bool)
            for k in range(3):
                inside[k : k + len(tri)] |= again
            repeat = int(inside.sum())
    return len(w), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, the place of each value among them)."""
    of, kinds = pd.factorize(a)
    order = np.argsort(kinds)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return kinds[order], place[of]


def _hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Hashes of the words between lo and hi, a bounded number of words at a time."""
    out = np.zeros(len(lo), np.uint64)
    power = powers(int((hi - lo).max(initial=0)) + 1)[0]
    for k in range(0, len(lo), step):
        a, b = lo[k : k + step], hi[k : k + step]
        length = b - a
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        out[k : k + step] = np.add.reduceat(_BYTES[raw[np.repeat(a, length) + place]] * power[place], first)
    return out


class Words:
    """The words of a block's documents and their bigrams, as numbers of sorted distinct hashes."""

    def __init__(self, row: dict, bits: int = 64):
        raw = np.frombuffer(row["data"].translate(LOWERED), np.uint8)
        ends = np.cumsum(np.array(row["lens"], np.int64))  # each document ends on a line feed
        salt = np.array([xxhash.xxh64_intdigest(repr(x)) for x in row["langs"]], np.uint64)
        word = ~BLANK[raw]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes = _hashes(raw, lo, hi)
        self.doc = np.searchsorted(ends, lo, "right")
        self.n_docs = len(ends)
        self.n_words = np.bincount(self.doc, minlength=len(ends))
        shift = np.uint64(64 - bits)
        hashed = mixed(mixed(hashes) ^ salt[self.doc]) >> shift
        starts = mixed(salt ^ _START) >> shift
        self.words, of = numbered(np.concatenate([hashed, starts]))
        self.c, start = of[: len(lo)], of[len(lo) :]
        first = np.diff(self.doc, prepend=-1) > 0
        self.b = np.where(first, start[self.doc], np.roll(self.c, 1)) if len(lo) else self.c
        langs = sorted(set(row["langs"]), key=repr)
        self.langs = langs
        self.doc_lang = np.array([langs.index(x) for x in row["langs"]], np.int64)
        self.word_lang = np.zeros(len(self.words), np.int64)
        self.word_lang[self.c] = self.doc_lang[self.doc]
        self.word_lang[start] = self.doc_lang
        pair, kinds = pd.factorize(self.b.astype(np.int64) * len(self.words) + self.c)
        b, c = np.divmod(kinds, max(len(self.words), 1))
        self.keys, of = numbered(mixed(self.words[b] * np.uint64(0x9E3779B97F4A7C15) ^ self.words[c]) >> shift)
        self.pair, self.pair_b, self.pair_c = of[pair], np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        self.pair_b[of], self.pair_c[of] = b, c
        counted = np.array(row["counted"], bool)[self.doc] if len(lo) else np.zeros(0, bool)
        self.n = np.bincount(self.pair[counted], minlength=len(self.keys))
        self.context = np.bincount(self.b[counted], minlength=len(self.words))


def pack(docs: DataFrame, id_col: str, text_col: str, lang_col: str, block: int) -> DataFrame:
    """Blocks of documents: block, ids, langs, lens, data, and digests of (language, text)."""
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.string())), ("langs", pa.list_(pa.string())), ("lens", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            digest = lambda lang, text: xxhash.xxh3_128_digest(repr(lang).encode() + b"\0" + text)
            return pa.RecordBatch.from_pydict({
                "block": [(part << 24) + seq], "n_bytes": [size], "ids": [[h[0] for h in held]], "langs": [[h[1] for h in held]], "lens": [[len(h[2]) + 1 for h in held]],
                "digests": [[digest(h[1], h[2]) for h in held]], "data": [b"".join(h[2] + b"\n" for h in held)],
            }, schema=schema)

        for b in batches:
            for key, lang, text in zip(b.column("id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.append((key, lang, text or b""))
                size += len(held[-1][2])
                if size >= block:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "block long, n_bytes long, ids array<string>, langs array<string>, lens array<bigint>, digests array<binary>, data binary")


def discounts(c: list[int]) -> list[float]:
    """D of 0, 1, 2, 3 and more, from the counts of counts 1 to 4; 0.5, 1, 1.5 where those say nothing."""
    if not all(c[:3]):
        return [0.0, 0.5, 1.0, 1.5]
    y = c[0] / (c[0] + 2 * c[1])
    return [0.0, *(min(max(k + 1 - (k + 2) * y * (c[k + 1] / c[k]), 0.05), k + 0.95) for k in range(3))]


def _total(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of a range's hashes over the blocks, and which block holds each first.

    Where blocks send their languages, the first number of a hash is its language; then counts of counts (of the last number) by language are told too, with what
    the blocks tell about their bigrams.
    """
    group = group.sort_values("block")
    told = [json.loads(x) if x else None for x in group["langs"]]
    keys = [values(k) for k in group["keys"]]
    every, of = numbered(np.concatenate(keys))
    counts = [unsmall(c).reshape(-1, len(k)) for c, k in zip(group["counts"], keys)]
    edge = np.cumsum([0, *map(len, keys)])
    skip = int(told[0] is not None)
    sums = np.zeros((len(counts[0]) - skip, len(every)), np.int64)
    for lo, hi, c in zip(edge, edge[1:], counts):
        sums[:, of[lo:hi]] += c[skip:]  # a block holds a hash once
    where = np.full(len(every), len(of))
    np.minimum.at(where, of, np.arange(len(of)))
    first = np.zeros(len(of), bool)
    first[where] = True
    out, stats = [], []
    for lo, hi, c, own in zip(edge, edge[1:], counts, told):
        out.append(small(np.concatenate([first[lo:hi], *sums[:, of[lo:hi]]])))
        if own:
            stats += [["bigrams", lang, n] for lang, n in own["bigrams"]]
            mine = first[lo:hi] & (sums[-1][of[lo:hi]] > 0)
            stats += [["words", lang, _of_counts(sums[-1][of[lo:hi]][mine & (c[0] == k)])] for k, lang in enumerate(own["langs"])]
    return pd.DataFrame({"r": group["r"], "block": group["block"], "answer": out, "stats": [json.dumps(stats) if stats else None, *[None] * (len(group) - 1)]})


def _of_counts(n: np.ndarray) -> list[int]:
    """How many, their sum, how many are 1, 2, 3, 4 and how many over 2."""
    return [len(n), int(n.sum()), *(int((n == k).sum()) for k in range(1, 5)), int((n > 2).sum())]


def _looked_up(answers: list | None, cut: list[int], rows: int) -> np.ndarray:
    """The ranges' answers, by the place of the block's hashes; first row: whether this block holds it first."""
    out = np.zeros((rows, cut[-1]), np.int64)
    for r, data in answers_of(answers):
        out[:, cut[r] : cut[r + 1]] = unsmall(data).reshape(rows, -1)
    return out


def _of_words(own: Words, pairs: np.ndarray) -> list[np.ndarray]:
    """Per word of the block: occurrences as a context, and over the types that this block counts those after it seen once, twice, more often, and those before it."""
    first, n = pairs[0].astype(bool) & (pairs[1] > 0), pairs[1]
    after = [np.bincount(own.pair_b[first & kind], minlength=len(own.words)) for kind in (n == 1, n == 2, n > 2)]
    return [own.context, *after, np.bincount(own.pair_c[first], minlength=len(own.words))]


def _log_p(own: Words, pairs: np.ndarray, words: np.ndarray, laws: dict) -> np.ndarray:
    """log p of each word of the block by the model without its document."""
    law = [laws[x] for x in own.langs]
    d2, d1 = (np.array([x[k] for x in law]) for k in ("bigram", "unigram"))
    every, size, back = (np.array([x[k] for x in law], float) for k in ("types", "words", "discounted"))
    lang = own.doc_lang[own.doc]
    # what each document itself adds: per (document, bigram), (document, context), (document, word), document
    dp, of_dp, own_n = np.unique(own.doc.astype(np.int64) * len(own.keys) + own.pair, return_inverse=True, return_counts=True)
    doc, pair = np.divmod(dp, max(len(own.keys), 1))
    n_all = pairs[1][pair]
    n = n_all - own_n
    b, c, l2 = own.pair_b[pair], own.pair_c[pair], own.doc_lang[doc]
    cut3 = lambda x: np.minimum(x, 3)
    db, of_db = np.unique(doc * len(own.words) + b, return_inverse=True)
    own_t = np.bincount(of_db, own_n)
    less = np.bincount(of_db, d2[l2, cut3(n_all)] - d2[l2, cut3(n)])
    dc, of_dc = np.unique(doc * len(own.words) + c, return_inverse=True)
    gone = np.bincount(of_dc, n == 0).astype(np.int64)
    dcw, dcl = dc % max(len(own.words), 1), own.doc_lang[dc // max(len(own.words), 1)] if len(dc) else dc
    m_all = words[5][dcw]
    m = np.maximum(m_all - gone, 0)
    dcd = dc // max(len(own.words), 1)
    m_total = every[own.doc_lang] - np.bincount(dcd, gone, own.n_docs)
    m_back = back[own.doc_lang] - np.bincount(dcd, d1[dcl, cut3(m_all)] - d1[dcl, cut3(m)], own.n_docs)
    # where hashes of different words met, one may miss types: what is left to the lower order is at least one type's discount
    least2, least1 = d2[:, 1:].min(axis=1), d1[:, 1:].min(axis=1)
    m_back = np.maximum(m_back, least1[own.doc_lang])
    # the lower order, per (document, word)
    with np.errstate(divide="ignore", invalid="ignore"):
        p1 = np.where(m_total[dcd] > 0, np.maximum(m - d1[dcl, cut3(m)], 0) / m_total[dcd] + m_back[dcd] / m_total[dcd] / size[dcl], 1 / size[dcl])
        t = words[1][b] - own_t[of_db]
        left = np.maximum((words[2:5][:, b] * d2[l2, 1:].T).sum(axis=0) - less[of_db], least2[l2])
        p2 = np.where(t > 0, np.maximum(n - d2[l2, cut3(n)], 0) / t + left / t * p1[of_dc], p1[of_dc])
    return np.log(p2)[of_dp] if len(lang) else np.zeros(0)


def _opened(row: dict, bits: int) -> Words:
    counted = np.zeros(len(row["lens"]), bool)
    counted[row["firsts"] or []] = True
    return Words(row | {"counted": counted}, bits)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, entries: int = RANGE) -> DataFrame:
    """doc_id, lang, the base counts and log_ppl (null for a text without words)."""
    spark = docs.sparkSession
    rows = pack(docs, id_col, text_col, lang_col, block)
    buckets = max(1, rows.rdd.getNumPartitions())
    with bucketed(rows, "block", "word-blocks", buckets) as packed:
        total = packed.agg(F.sum("n_bytes")).first()[0] or 0
        ranges, bits = 1 + total // 6 // entries, min(64, SPARE_BITS + max(1, total).bit_length())
        each_doc = packed.select("block", F.posexplode("digests").alias("i", "digest"))
        first = each_doc.groupBy("digest").agg(F.min(F.struct("block", "i")).alias("first"))
        firsts = written(first.groupBy(F.col("first.block").alias("block")).agg(F.collect_list("first.i").alias("firsts")), "firsts")
        blocks = packed.drop("digests", "n_bytes").join(firsts.hint("shuffle_hash"), "block", "left")
        out = _scored(spark, blocks, buckets, ranges, bits, docs.schema[id_col].dataType)
        removed(spark, firsts)
        return out


def _by_block(told: DataFrame, name: str) -> DataFrame:
    return told.groupBy("block").agg(F.collect_list(F.struct("r", "answer")).alias(name))


def _scored(spark, blocks: DataFrame, buckets: int, ranges: int, bits: int, id_type) -> DataFrame:
    def ask_bigrams(row):
        own = _opened(row, bits)
        return None, *split(own.keys, [own.n], ranges, bits)

    # each step's shuffle files go before the next one writes, and bigrams' answers lie as the blocks do, so that neither later step moves them
    with ExitStack() as held:
        with shuffles_removed(spark):
            told = written(told_of(blocks, ask_bigrams, _total), "bigrams", "zstd")
            known = held.enter_context(bucketed(told.select("block", "r", "answer").repartition(buckets, "block"), "block", "bigram-answers", buckets))
        removed(spark, told)
        both = blocks.join(_by_block(known, "pairs").hint("shuffle_hash"), "block", "left")
        return _judged(spark, both, buckets, ranges, bits, id_type)


def _judged(spark, both: DataFrame, buckets: int, ranges: int, bits: int, id_type) -> DataFrame:
    def of_pairs(row):
        own = _opened(row, bits)
        return own, _looked_up(row["pairs"], cuts(own.keys, ranges, bits), 2)

    def ask_words(row):
        own, pairs = of_pairs(row)
        mine, lang = pairs[0].astype(bool) & (pairs[1] > 0), own.word_lang[own.pair_c]
        tells = {"langs": own.langs, "bigrams": [[x, _of_counts(pairs[1][mine & (lang == k)])] for k, x in enumerate(own.langs)]}
        return tells, *split(own.words, [own.word_lang, *_of_words(own, pairs)], ranges, bits)

    with shuffles_removed(spark):
        told = written(told_of(both, ask_words, _total), "words", "zstd")
    last = both.join(_by_block(told.repartition(buckets, "block"), "of_words").hint("shuffle_hash"), "block", "left")
    sums, laws = _summed(told.select("stats").filter("stats is not null")), {}
    for lang in {lang for _, lang in sums}:
        (_, _, *n, _), (words, types, *m, more) = sums["bigrams", lang], sums["words", lang]
        d1 = discounts(m)
        laws[lang] = {"words": max(words, 1), "types": types, "bigram": discounts(n), "unigram": d1, "discounted": d1[1] * m[0] + d1[2] * m[1] + d1[3] * more}

    def judge_block(batches):
        for row in each(batches):
            own, pairs = of_pairs(row)
            words = _looked_up(row["of_words"], cuts(own.words, ranges, bits), 6)
            total = np.bincount(own.doc, _log_p(own, pairs, words, laws), own.n_docs)
            ends = np.cumsum(row["lens"]).tolist()
            base = [base_counts(row["data"][e - n : e - 1].decode("utf-8", "surrogatepass")) for e, n in zip(ends, row["lens"])]
            ppl = [-t / n if n else None for t, n in zip(total.tolist(), own.n_words.tolist())]
            cols = [pa.array(row["ids"], pa.string()), pa.array(row["langs"], pa.string()), *(pa.array(x, pa.int64()) for x in zip(*base)), pa.array(ppl, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", *COUNTS, "log_ppl"])

    done = last.mapInArrow(judge_block, "doc_id string, lang string, " + ", ".join(f"{x} long" for x in COUNTS) + ", log_ppl double")
    with shuffles_removed(spark):
        out = written(done.withColumn("doc_id", F.col("doc_id").cast(id_type)), "quality")
    removed(spark, told)
    return out


def _summed(stats: DataFrame) -> dict:
    """Sums by kind and language of what the ranges tell; a row for each language reaches the driver."""
    parsed = stats.select(F.explode(F.from_json("stats", "array<array<string>>")).alias("s"))
    parsed = parsed.select(F.col("s")[0].alias("kind"), F.col("s")[1].alias("lang"), *[F.get_json_object(F.col("s")[2], f"$[{k}]").cast("long").alias(f"c{k}") for k in range(7)])
    return {(r["kind"], r["lang"]): [r[f"c{k}"] for k in range(7)] for r in parsed.groupBy("kind", "lang").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(7)]).collect()}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def each(batches):
    """Rows as dicts, one copied at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def bands(scored: DataFrame, above: float = ABOVE, lower: float = LOWER) -> DataFrame:
    """(lang, low, high) in log perplexity."""
    bins = scored.filter("not base_failed").groupBy("lang", F.floor(F.col("log_ppl") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    run = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    q = run.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("bin"))).alias(c) for p, c in ((0.5, "q2"), (0.75, "q3"))])
    return q.select("lang", (F.col("q2") / 1000 * lower).alias("low"), ((F.col("q3") + above * (F.col("q3") - F.col("q2") + 1)) / 1000).alias("high"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", above: float = ABOVE, lower: float = LOWER, **kw) -> DataFrame:
    """Per row: doc_id, n_words, the base counts, base_failed, kept, perplexity."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = score(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **kw).withColumn("base_failed", failed)
    limits = bands(scored, above, lower).withColumnRenamed("lang", "_l")
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_l")), "left")  # a row for each language
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(F.col("doc_id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"))
