"""Sorted arrays of 64-bit hashes: rolling hashes, compact bytes, and questions of blocks to hash ranges."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_P = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P ** i and _P ** -i modulo 2**64 for i < n."""
    size = -(-n // (1 << 20)) << 20
    if max(_powers, default=0) < size:
        _powers.clear()
        both = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            a = np.ones(size, np.uint64)
            k = 1
            while k < size:
                a[k : 2 * k] = a[: min(k, size - k)] * np.uint64(pow(p, k, 1 << 64))
                k *= 2
            both.append(a)
        _powers[size] = tuple(both)
    return next(iter(_powers.values()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def squeeze(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of 64-bit numbers, plane by plane."""
    return zstandard.ZstdCompressor(level).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def deltas(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def values(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data), dtype=np.uint64)


def small(a: np.ndarray) -> bytes:
    """Numbers most of which are small."""
    return squeeze(a.astype(np.int64).view(np.uint64), 6)


def unsmall(data: bytes) -> np.ndarray:
    return opened(data).view(np.int64)


def cuts(keys: np.ndarray, n: int, bits: int = 64) -> list[int]:
    """Where each of n equal hash ranges starts in the sorted keys."""
    return np.searchsorted(keys, np.array([-(-(k << bits) // n) for k in range(n)], np.uint64)).tolist() + [len(keys)]


def split(keys: np.ndarray, counts: list[np.ndarray], n: int, bits: int = 64) -> tuple[list[int], list[bytes], list[bytes]]:
    """The ranges that have keys, and for each its keys and their counts (one row after the other)."""
    cut = cuts(keys, n, bits)
    some = [k for k in range(n) if cut[k] < cut[k + 1]]
    return some, [deltas(keys[cut[k] : cut[k + 1]]) for k in some], [small(np.concatenate([c[cut[k] : cut[k + 1]] for c in counts])) for k in some]


class Told(NamedTuple):
    answers: DataFrame  # block, answers [(r, answer, stats)]; written, to be removed in the end
    stats: DataFrame  # stats


def told_of(blocks: DataFrame, question, decide) -> DataFrame:
    """r, block, answer, stats. question(block's row) -> (what it tells of languages or None, ranges, keys, counts); decide(a range's rows: r, block, langs, keys, counts) -> (r, block, answer, stats)."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                tells, r, keys, counts = question(row)
                n = len(r)
                langs = [json.dumps({**tells, "bigrams": [] if k else tells["bigrams"]}) for k in range(n)] if tells else [None] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(langs, pa.string()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    ["r", "block", "langs", "keys", "counts"],
                )

    asked = blocks.mapInArrow(run, "r int, block long, langs string, keys binary, counts binary")
    return asked.groupBy("r").applyInPandas(decide, "r int, block long, answer binary, stats string")


def ask(blocks: DataFrame, question, decide, tag: str) -> Told:
    told = told_of(blocks, question, decide)
    # written by block, so that a join with bucketed blocks moves the answers and not the blocks
    answers = written(told.groupBy("block").agg(F.collect_list(F.struct("r", "answer", "stats")).alias("answers")), tag, "zstd")
    return Told(answers, answers.select(F.explode("answers.stats").alias("stats")).filter("stats is not null"))


def answers_of(answers: list | None):
    for a in answers or ():
        yield a["r"], a["answer"]
