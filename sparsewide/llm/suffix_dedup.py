"""Suffix dedup of exact repeats: difference-cover samples, then sorted suffix buckets one at a time.

Every byte that a string of `length` bytes covers which also starts earlier (smaller doc_id, or earlier in the same document) is removed. Documents are packed
into blocks of about `block` bytes, sorted by doc_id inside, which are written once as a bucketed table, so later joins by block don't move the text.

1. Samples. The residues DIFFERENCE_COVER modulo PERIOD have every difference modulo PERIOD, so two equal strings of `length` bytes, wherever they start, have a
   place below PERIOD at which both are sampled, and the window of length - PERIOD + 1 bytes from there on is the same. Blocks send the hashes of their sample
   windows (sorted, distinct, delta coded); each hash range tells each block which of its windows stand elsewhere too. Only suffixes with such a sample ahead can
   be repeats; all others leave the game, whatever the size of the corpus.
2. Buckets. A shared sample goes with its bytes to the bucket of its window: PERIOD - 1 bytes before it and `length` from it on. One bucket at a time is sorted in
   a task, lexicographically: the sample suffixes by what follows, and what stands before them read backwards; both orders give ranks for prefixes of any length
   by their common prefixes with the neighbour. A suffix that starts l bytes before a sample is compared by those l bytes and, the tie being long, by the rank of
   the sample suffix cut to length - l bytes. Equal pairs of ranks are equal strings, byte for byte, and all but the earliest are repeats. So the suffixes between
   samples are never sorted themselves, and a task holds `bucket` samples.
3. Each block marks the bytes of repeated suffixes.

Documents that are copies of an earlier one as a whole (by 128-bit digests) lose all their bytes and take no further part. A window and its surroundings enter once
a block, so repeated passages do not enlarge a bucket. A window that stands at more than `hot` places (a common line, with other text around it each time) is dealt
out instead: its suffixes go by the 128-bit hash of their whole string, once a block, to an aggregation that combines before it
shuffles. Only there and for whole documents equality is of hashes; two different strings among n meet with a chance of n * n / 2**129.

Scale: a row between tasks holds at least one sample, so rows never exceed samples; take larger blocks and buckets for larger machines. Nothing but three totals
reaches the driver.

Defined cases: null text is empty. Rows with one doc_id count in the order of their blocks. Null doc_ids come before all others. Texts shorter than `length` lose
nothing. Texts longer than a block make a larger one. Other columns are ignored, whatever their names. Empty tables: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, removed, written
from .hash_arrays import cuts, deltas, mixed, opened, powers, small, squeeze, unsmall, values

LENGTH, BLOCK, BUCKET, HOT = 100, 4 << 20, 1 << 17, 1 << 17
#: A perfect difference cover: each residue but 0 is one difference.
PERIOD, DIFFERENCE_COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BITS = 48
_T = [np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240229, 20240701)]
_NONE = np.iinfo(np.int64).min


class Block:
    """The bytes of a block's documents, one after the other, its samples and what surrounds them."""

    def __init__(self, row: dict, length: int):
        self.data, self.length, self.window = np.frombuffer(row["data"], np.uint8), length, length - PERIOD + 1
        self.lens = np.array(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.copy = np.ones(len(self.lens), bool)
        self.copy[row["firsts"] or []] = False
        self.ids = np.array([_NONE if d is None else d for d in row["doc_ids"]], np.int64)
        self.at = self._samples()
        self.sample_prints = self.prints(self.at, self.window) >> np.uint64(64 - BITS)
        self.keys, self.of, self.counts = np.unique(self.sample_prints, return_inverse=True, return_counts=True)

    def prints(self, at: np.ndarray, n: int, table: int = 0) -> np.ndarray:
        """Hashes of the strings of n bytes from each place on."""
        out, step = np.zeros(len(at), np.uint64), 1 << 19
        up, down = powers(step + n + 1)
        edge = np.searchsorted(at, np.arange(0, len(self.data) + step, step)).tolist()  # places ascend; a stretch of the text at a time
        for k, (lo, hi) in enumerate(zip(edge, edge[1:])):
            if lo < hi:
                part = self.data[k * step : (k + 1) * step + n]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_T[table][part] * up[: len(part)], out=sums[1:])
                here = at[lo:hi] - k * step
                out[lo:hi] = mixed((sums[here + n] - sums[here]) * down[here])
        return out

    def _samples(self) -> np.ndarray:
        """Sampled places of which the window lies in a document that is long enough to hold a repeat."""
        long = (self.lens >= self.length) & ~self.copy
        if not long.any():
            return np.zeros(0, np.int64)
        all_at = (np.arange(0, int(self.lens.max()), PERIOD)[:, None] + np.array(DIFFERENCE_COVER)).ravel()
        upto = np.searchsorted(all_at, self.lens[long] - self.window, "right")
        return np.concatenate([all_at[:k] + s for k, s in zip(upto.tolist(), self.starts[long].tolist())])

    def contexts(self, shared: np.ndarray) -> Contexts:
        """Of the shared samples (a flag for each key) what surrounds them."""
        return Contexts(self, np.flatnonzero(shared[self.of]) if len(self.at) else np.zeros(0, np.int64))


class Contexts:
    """Samples with the bytes around them: rows of PERIOD - 1 + length bytes and how many of them are the document's before and from the sample on."""

    def __init__(self, own: Block, which: np.ndarray):
        self.at = own.at[which]
        self.doc = np.searchsorted(own.ends, self.at, "right")
        self.left = np.minimum(self.at - own.starts[self.doc], PERIOD - 1)
        self.right = np.minimum(own.ends[self.doc] - self.at, own.length)
        width = PERIOD - 1 + own.length
        rows = np.zeros((len(self.at), width + 2), np.uint8)
        for k in range(width):  # column by column: no array of places for all rows
            place = self.at + (k - PERIOD + 1)
            inside = (k >= PERIOD - 1 - self.left) & (k < PERIOD - 1 + self.right)
            rows[inside, k] = own.data[place[inside]]
        rows[:, -2], rows[:, -1] = self.left, self.right
        order = np.lexsort((self.at, own.sample_prints[which])) if len(which) else which
        # distinct rows, the first in the block for each; within a hash range they lie together
        flat = np.ascontiguousarray(rows[order]).view(f"V{width + 2}").ravel()
        self.of = np.zeros(len(order), np.int64)
        of, kinds = pd.factorize(pd.Series([x.tobytes() for x in flat]))
        self.of[order] = of
        first = np.full(len(kinds), len(order))
        np.minimum.at(first, of, np.arange(len(order)))
        self.first = order[first]
        self.rows, self.keys = rows[self.first], own.sample_prints[which][self.first]

    def valid(self, length: int) -> np.ndarray:
        """For each sample and l below PERIOD whether the string of `length` bytes from l bytes before it on lies in its document."""
        back = np.arange(PERIOD)
        return (back <= self.left[:, None]) & (length - back <= self.right[:, None])


def ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lexicographic order of the rows, common prefix of each with the one before it)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 14):
        same = rows[order[lo : lo + (1 << 14)]] == rows[order[lo - 1 : lo - 1 + (1 << 14)][: len(order[lo : lo + (1 << 14)])]]
        common[lo : lo + (1 << 14)] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, common


def repeated(rows: np.ndarray, when: np.ndarray, length: int) -> np.ndarray:
    """For each context and l below PERIOD whether the suffix l bytes before the sample has the same `length` bytes as one of a context that comes earlier by `when`."""
    gone = np.zeros((len(rows), PERIOD), bool)
    width = PERIOD - 1
    order, common = ranks(rows[:, width : width + length])
    group = np.cumsum(common < length - PERIOD + 1)  # of one window
    many = np.zeros(len(rows), bool)
    many[order] = np.bincount(group)[group] > 1
    some = np.flatnonzero(many)
    if not len(some):
        return gone
    some = some[np.argsort(when[some], kind="stable")]  # earliest first
    rows = rows[some]
    after, common = ranks(rows[:, width : width + length])
    before, alike = ranks(rows[:, width - 1 :: -1] if width else rows[:, :0])
    left, right = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    rank_after, rank_before = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for back in range(PERIOD):
        rank_after[after] = np.cumsum(common < length - back)
        rank_before[before] = np.cumsum(alike < back)
        ok = np.flatnonzero((back <= left) & (length - back <= right))
        gone[some[ok], back] = pd.Series(rank_after[ok] * (len(rows) + 1) + rank_before[ok]).duplicated().to_numpy()
    return gone


def pack(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """Blocks of documents: block, n_bytes, doc_ids, lens, digests, data."""
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            held.sort(key=lambda d: (d[0] is not None, d[0] or 0))
            cols = {"block": [(part << 24) + seq], "n_bytes": [size], "doc_ids": [[d[0] for d in held]], "lens": [[len(d[1]) for d in held]], "digests": [[xxhash.xxh3_128_digest(d[1]) for d in held]], "data": [b"".join(d[1] for d in held)]}
            return pa.RecordBatch.from_pydict(cols, schema=schema)

        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append((key, text or b""))
                size += len(held[-1][1])
                if size >= block:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "block long, n_bytes long, doc_ids array<bigint>, lens array<bigint>, digests array<binary>, data binary")


def _each(batches):
    """Rows as dicts, one copied at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _flags(answers: list[dict] | None, cut: list[int], rows: int) -> np.ndarray:
    """The ranges' answers, by the place of the block's keys."""
    out = np.zeros((rows, cut[-1]), bool)
    for a in answers or ():
        lo, hi = cut[a["r"]], cut[a["r"] + 1]
        out[:, lo:hi] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(a["bits"]), np.uint8), count=rows * (hi - lo)).reshape(rows, -1)
    return out


def _packed(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.packbits(flags).tobytes())


def _by_block(told: DataFrame, tag: str) -> DataFrame:
    return written(told.groupBy("block").agg(F.collect_list(F.struct("r", "bits")).alias("answers"), F.sum("n").alias("n"), F.sum("n_hot").alias("n_hot")), tag, "zstd")


_TOLD = "r int, block long, bits binary, n long, n_hot long"


def _elsewhere(hot: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Which keys of a block stand in another block too, and at more than `hot` places."""
        keys = [values(k) for k in group["keys"]]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        n, places = np.bincount(of)[of], np.bincount(of, np.concatenate([unsmall(c) for c in group["counts"]]))[of]
        edge = np.cumsum([0, *map(len, keys)])
        parts = [np.stack([n[a:b] > 1, places[a:b] > hot]) for a, b in zip(edge, edge[1:])]
        return pd.DataFrame({"r": group["r"], "block": group["block"], "bits": [_packed(x) for x in parts], "n": [int(x[0].sum()) for x in parts], "n_hot": [int(x[1].sum()) for x in parts]})

    return run


def _bucket(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Sorts a bucket; which suffixes around the contexts of a block are repeats."""
        group = group.sort_values("block")
        width = PERIOD - 1 + length + 2
        rows = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(-1, width) for x in group["rows"]]
        at, doc = (np.concatenate([opened(x).view(np.int64) for x in group[c]]) for c in ("at", "doc"))
        edge = np.cumsum([0, *map(len, rows)])
        when = np.empty(len(at), np.int64)
        when[np.lexsort((at, np.repeat(np.arange(len(rows)), np.diff(edge)), doc))] = np.arange(len(at))
        gone = repeated(np.concatenate(rows), when, length)
        return pd.DataFrame({"r": group["r"], "block": group["block"], "bits": [_packed(gone[a:b].T) for a, b in zip(edge, edge[1:])], "n": 0, "n_hot": 0})

    return run


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans [(start, stop) in bytes]."""
    if not PERIOD < length < 256:
        raise ValueError(f"length must be over {PERIOD} and below 256")
    with bucketed(pack(docs, id_col, text_col, block), "block", "suffix-blocks") as blocks:
        whole = blocks.select("block", F.posexplode(F.arrays_zip("digests", "doc_ids")).alias("i", "d"))
        first = whole.groupBy("d.digests").agg(F.min(F.struct("d.doc_ids", "block", "i")).alias("first"))  # nulls come first
        firsts = written(first.groupBy(F.col("first.block").alias("block")).agg(F.collect_list("first.i").alias("firsts")), "firsts")
        total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
        known = blocks.drop("digests", "n_bytes").join(firsts.hint("shuffle_hash"), "block", "left")
        out = _repeats(known, total, length, bucket, hot).withColumnRenamed("doc_id", id_col)
        removed(docs.sparkSession, firsts)
        return out


def _repeats(blocks: DataFrame, total: int, length: int, bucket: int, hot: int) -> DataFrame:
    ranges = 1 + total * len(DIFFERENCE_COVER) // PERIOD // (8 * bucket)

    def ask_samples(batches):
        for row in _each(batches):
            own = Block(row, length)
            cut = cuts(own.keys, ranges, BITS)
            some = [k for k in range(ranges) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([deltas(own.keys[cut[k] : cut[k + 1]]) for k in some], pa.binary()), pa.array([small(own.counts[cut[k] : cut[k + 1]]) for k in some], pa.binary())], ["r", "block", "keys", "counts"])

    asked = blocks.mapInArrow(ask_samples, "r int, block long, keys binary, counts binary")
    samples = _by_block(asked.groupBy("r").applyInPandas(_elsewhere(hot), _TOLD), "samples")
    n, n_hot = samples.agg(F.sum("n"), F.sum("n_hot")).first()
    buckets = 1 + (n or 0) // bucket

    def opened_block(row):
        """The block, its contexts that go to buckets and those of hot windows."""
        own = Block(row, length)
        shared, common = _flags(row["shared"], cuts(own.keys, ranges, BITS), 2)
        return own, own.contexts((shared | (own.counts > 1)) & ~common), own.contexts(common)

    def ask_buckets(batches):
        for row in _each(batches):
            own, near, _ = opened_block(row)
            cut = cuts(near.keys, buckets, BITS)
            some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            part = lambda a: [a[cut[k] : cut[k + 1]] for k in some]  # noqa: B023, E731
            at, doc = near.at[near.first], own.ids[near.doc[near.first]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([zstandard.ZstdCompressor(3).compress(x.tobytes()) for x in part(near.rows)], pa.binary()),
                    pa.array([squeeze(x.view(np.uint64)) for x in part(at)], pa.binary()), pa.array([squeeze(x.view(np.uint64)) for x in part(doc)], pa.binary()),
                ],
                ["r", "block", "rows", "at", "doc"],
            )

    left = blocks.join(samples.select("block", F.col("answers").alias("shared")).hint("shuffle_hash"), "block", "left").select("block", "doc_ids", "lens", "data", "firsts", "shared")
    asked = left.mapInArrow(ask_buckets, "r int, block long, rows binary, at binary, doc binary")
    earlier = _by_block(asked.groupBy("r").applyInPandas(_bucket(length), _TOLD), "suffixes")
    both = left.join(earlier.select("block", F.col("answers").alias("earlier")).hint("shuffle_hash"), "block", "left")
    dealt = _hot_repeats(left, opened_block, length) if n_hot else None
    both = both.join(dealt.hint("shuffle_hash"), "block", "left") if n_hot else both.withColumn("dealt", F.lit(None).cast("array<struct<high:bigint,low:bigint>>"))

    def mark(batches):
        for row in _each(batches):
            own, near, common = opened_block(row)
            gone = np.zeros(len(own.data) + 1, bool)
            told = _flags(row["earlier"], cuts(near.keys, buckets, BITS), PERIOD).T
            for back, valid in enumerate(near.valid(length).T):
                later = np.ones(len(near.at), bool)
                later[near.first] = False  # the same surroundings stand earlier in this block
                gone[near.at[valid & (later | told[near.of, back] if len(near.at) else later)] - back] = True
            at, high, low, first = _strings(own, common, length)
            found = {(a["high"], a["low"]) for a in row["dealt"] or ()}
            gone[at[~first]] = True
            gone[at[[x in found for x in zip(high.tolist(), low.tolist())]]] = True
            step = gone.astype(np.int32)
            step[length:] -= gone[:-length] if len(gone) > length else gone[:0]
            cut = np.cumsum(step[:-1]) > 0
            cut |= np.repeat(own.copy & (own.lens >= length), own.lens)
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for key, lo, hi in zip(row["doc_ids"], own.starts.tolist(), own.ends.tolist()):
                c = cut[lo:hi]
                edge = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0)).tolist() if c.any() else []
                spans = [{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2])]
                for k, v in zip(out, (key, hi - lo, int(c.sum()), len(spans), hashlib.sha256(own.data[lo:hi][~c].tobytes()).hexdigest(), spans)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    out = written(both.select("block", "doc_ids", "lens", "data", "firsts", "shared", "earlier", "dealt").mapInArrow(mark, _OUT_SQL), "repeats")
    for used in (samples, earlier, *([dealt] if n_hot else [])):
        removed(out.sparkSession, used)
    return out


def _strings(own: Block, common: Contexts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes around hot windows: places, two hashes of the string, and whether it is the first of its string in the block."""
    sample, back = np.nonzero(common.valid(length))
    at = np.unique(common.at[sample] - back)
    high, low = (own.prints(at, length, t).view(np.int64) for t in (0, 1))
    first = ~pd.MultiIndex.from_arrays([high, low]).duplicated() if len(at) else np.zeros(0, bool)
    return at, high, low, first


def _hot_repeats(left: DataFrame, opened_block, length: int) -> DataFrame:
    """(block, dealt): the strings of each block that stand earlier in another one."""

    def run(batches):
        for row in _each(batches):
            own, _, common = opened_block(row)
            at, high, low, first = _strings(own, common, length)
            doc = own.ids[np.searchsorted(own.ends, at[first], "right")]
            cols = [pa.array([row["block"]] * int(first.sum()), pa.int64()), *(pa.array(x, pa.int64()) for x in (high[first], low[first], doc))]
            yield pa.RecordBatch.from_arrays(cols, ["block", "high", "low", "doc"])

    rows = written(left.mapInArrow(run, "block long, high long, low long, doc long"), "strings", "zstd")
    first = rows.groupBy("high", "low").agg(F.min(F.struct("doc", "block")).alias("first"))
    gone = rows.join(first, ["high", "low"]).filter(F.struct("doc", "block") != F.col("first"))
    out = written(gone.groupBy("block").agg(F.collect_list(F.struct("high", "low")).alias("dealt")), "dealt", "zstd")
    removed(left.sparkSession, rows)
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
