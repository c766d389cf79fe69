"""SimHash near-dedup: binary trie self-join of 64-bit fingerprints.

Fingerprints: A-Z lower-cased, words are runs of non-white-space, shingles of three words joined by a
space (repeats count; fewer words: the whole sequence; none: fingerprint zero), XXH64 seed 42; a bit
is one if more than half of the hashes have it.

Linking works on distinct fingerprints, so exact copies never meet each other. The trie is held in
three rotations, each with another third of the bits on top. Two fingerprints at most two bits apart
agree in one third, so in that rotation the traversal may spend nothing on the top third: only pairs
of a node with itself survive there, which is a hash partitioning of the fingerprints by those bits.
Below, node pairs are traversed together, level by level: each pair has the children (0,0), (1,1),
(0,1), (1,0), differing bits add up, and a pair over the budget is cut off. A node with over `node`
fingerprints (a large group of near copies) is descended `STEP_BITS` levels more in Spark, as node
pairs that are tasks of their own, until every pair is small; no task gets an unbounded node. A link
found in several rotations counts in the first. A fingerprint has at most 2,080 neighbours, so links
never grow with the square of a group of copies.

Defined cases: null and empty texts have fingerprint zero and link like any other. Rows that repeat a
doc_id each get their row. Null doc_ids take part and never are the smallest. Ties: equal fingerprints
are one node. Very long texts are read whole. Other columns are ignored, whatever their names. Empty
tables: no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, removed, written
from .components import components
from .hash_arrays import mixed

BUDGET = 2
NODE = 1 << 18
STEP_BITS = 6
#: First bit and number of bits of the three thirds.
THIRDS = ((0, 21), (21, 21), (42, 22))
#: Candidates for each row above which a bucket is verified by blocks of rows, and rows of a block.
DENSE, DENSE_BLOCK = 3, 1024
#: Of one_of_each: words a shingle, least Jaccard similarity in hundredths, bits up to which pairs are compared, and those of two fingerprints together.
STAGE_SHINGLE, SIMILARITY, STAGE_BITS, BOTH_BITS = 5, 80, 14, 28
_HASH = xxhash.xxh64_intdigest


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= shingle:
        hashes = [_HASH(b" ".join(words), seed)]
    elif shingle == 3:
        hashes = [_HASH(a + b" " + b + b" " + c, seed) for a, b, c in zip(words, words[1:], words[2:])]
    else:
        hashes = [_HASH(b" ".join(words[i : i + shingle]), seed) for i in range(n - shingle + 1)]
    return _majority(hashes)


def _majority(hashes) -> int:
    ones, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, 1 << 14):  # a bounded block of bits at a time
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 14)], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    # ids as text: a null must not turn a column of longs into floats
    return narrow.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def trie_pairs(groups: np.ndarray, rotated: np.ndarray, top: int, budget: int = BUDGET, start=None, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the budget, by traversing node pairs of the sorted, rotated fingerprints from bit `top` on.

    `groups` numbers the nodes that `rotated` (sorted within a group) is split into; the first pairs are each group with itself, or `start`, an
    array of rows (a_lo, a_hi, b_lo, b_hi, differing bits so far).
    """
    n = len(rotated)
    if start is None:
        edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
        hi = np.r_[edge[1:], n]
        start = np.stack([edge, hi, edge, hi, np.zeros_like(edge)], 1)
    stack, left, right = [(top, start)], [], []
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > block:  # depth first over blocks, so memory stays bounded
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi, d = pairs.T
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if leaf.any():
            i, j = a_lo[leaf], b_lo[leaf]
            near = (np.bitwise_count(rotated[i] ^ rotated[j]) <= budget) & (i != j)
            left.append(i[near])
            right.append(j[near])
        if bit == 64:
            continue
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi, d = pairs.T
        ones = np.r_[0, np.cumsum((rotated >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)]
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        kids = np.concatenate([
            np.stack([a_lo, a_mid, b_lo, b_mid, d], 1), np.stack([a_mid, a_hi, b_mid, b_hi, d], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, d + 1], 1), np.stack([a_mid, a_hi, b_lo, b_mid, d + 1], 1)[~same],
        ])
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
        kids = kids[(kids[:, 0] != kids[:, 2]) | (kids[:, 1] - kids[:, 0] > 1)]  # one fingerprint with itself
        stack.append((bit + 1, kids))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _first_third(x: np.ndarray, rotation: int) -> np.ndarray:
    """Whether no earlier third of the differing bits x is empty: the link belongs to this rotation."""
    ok = np.ones(len(x), bool)
    for lo, n in THIRDS[:rotation]:
        ok &= (x >> np.uint64(64 - lo - n)) & np.uint64((1 << n) - 1) != 0
    return ok


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among whole nodes; rows are sorted by rotation and node pair."""
    out = []
    for rotation, part in rows.groupby("rot", sort=False):
        lo, n = THIRDS[rotation]
        fp = part["fp"].to_numpy().view(np.uint64)
        rot = _rotate(fp, lo)
        codes = part.groupby(["top", "depth", "p", "q"], sort=False).ngroup().to_numpy()
        order = np.lexsort((rot, codes))
        codes, rot, fp = codes[order], rot[order], fp[order]
        pq = part[["p", "q", "depth"]].to_numpy()[order]
        edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        hi = np.r_[edge[1:], len(codes)]
        p, q, depth = pq[edge].T
        # in a pair of two nodes, the first holds the smaller path, so its fingerprints come first
        shift = np.uint64(64) - (n + depth).astype(np.uint64)
        mid = hi.copy()
        for g in np.flatnonzero(p != q):
            path = (rot[edge[g] : hi[g]] >> shift[g]) & np.uint64((1 << int(depth[g])) - 1)
            mid[g] = edge[g] + int(np.searchsorted(path, np.uint64(q[g])))
        two = p != q
        start = np.stack([edge, mid, np.where(two, mid, edge), hi, np.where(two, np.bitwise_count((p ^ q).astype(np.uint64)), 0)], 1)
        start = start[(start[:, 0] < start[:, 1]) & (start[:, 2] < start[:, 3])]
        for d in np.unique(depth) if len(depth) else ():
            i, j = trie_pairs(codes, rot, n + int(d), start=start[np.isin(start[:, 0], edge[depth == d])])
            keep = _first_third(fp[i] ^ fp[j], rotation)
            out.append(pd.DataFrame({"a": fp[i][keep].view(np.int64), "b": fp[j][keep].view(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _join_partition(batches):
    """Feeds _joined whole nodes from batches sorted by node; what is held back is one node, at most `node` rows."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        last = b.iloc[-1] if len(b) else None
        if last is None:
            continue
        tail = (b["rot"] == last["rot"]) & (b["top"] == last["top"]) & (b["depth"] == last["depth"]) & (b["p"] == last["p"]) & (b["q"] == last["q"])
        held, whole = b[tail], b[~tail]
        if len(whole):
            yield _joined(whole)
    if held is not None and len(held):
        yield _joined(held)


def links(distinct: DataFrame, *, node: int = NODE) -> DataFrame:
    """distinct (fp) -> (a, b): all pairs of different fingerprints at most two bits apart, once each."""
    # a node pair: rotation, top third, paths p <= q of `depth` bits below it
    parts = F.array(*[
        F.struct(F.lit(r).alias("rot"), F.expr(f"shiftrightunsigned(fp, {64 - lo - n}) & {(1 << n) - 1}L").alias("top")) for r, (lo, n) in enumerate(THIRDS)
    ])
    todo = distinct.select("fp", F.inline(parts)).withColumns({"p": F.lit(0).cast("long"), "q": F.lit(0).cast("long"), "depth": F.lit(0)})
    key = ["rot", "top", "depth", "p", "q"]  # paths of different depths can be the same number
    todo, done = written(todo, "trie"), None
    for depth in range(0, 42, STEP_BITS):
        large = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > node).select(*key)
        if not large.limit(1).count():
            break
        small = todo.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        # children: the path's next bits and all paths that the budget left can reach; each pair is kept where a fingerprint of either side goes
        flips = [sum(1 << b for b in bits) for k in range(BUDGET + 1) for bits in combinations(range(STEP_BITS), k)]
        rotated = F.expr("case rot when 0 then fp when 1 then shiftleft(fp, 21) | shiftrightunsigned(fp, 43) else shiftleft(fp, 42) | shiftrightunsigned(fp, 22) end")
        bits = F.expr(f"shiftrightunsigned(r64, 64 - (case rot when 2 then 22 else 21 end) - {depth + STEP_BITS}) & {(1 << (depth + STEP_BITS)) - 1}L")
        deep = todo.join(large, key).withColumn("r64", rotated).withColumn("own", bits).withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
        mine = F.expr(f"shiftright(own, {STEP_BITS})")
        other = F.when(mine == F.col("p"), F.col("q")).otherwise(F.col("p"))
        deep = deep.withColumn("mate", F.shiftleft(other, STEP_BITS).bitwiseOR(F.col("own").bitwiseAND((1 << STEP_BITS) - 1).bitwiseXOR(F.col("flip"))))
        deep = deep.filter(F.bit_count(F.col("own").bitwiseXOR(F.col("mate"))) <= BUDGET)
        todo = written(deep.select("fp", "rot", "top", F.least("own", "mate").alias("p"), F.greatest("own", "mate").alias("q"), F.lit(depth + STEP_BITS).alias("depth")).distinct(), "trie")
    todo = todo if done is None else done.unionByName(todo)
    lanes = partitions(distinct.sparkSession)
    return todo.repartition(lanes, *key).sortWithinPartitions(*key).mapInPandas(_join_partition, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", node: int = NODE) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id, n_links (fingerprints linked to its own)."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    heads = written(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    pairs = written(links(heads.select("fp"), node=node), "links")
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n_links"))
    of = heads.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("head").alias("component_id"))
    of = of.join(least, "root").join(degree, F.col("fp") == F.col("v"), "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = fps.join(of, "fp").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
    out = written(out, "duplicates")
    for used in (fps, heads, pairs, roots):
        removed(docs.sparkSession, used)
    return out


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([_HASH(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))] if words else [], np.uint64))


def _signed(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(_row, key, fp, fp2, n): digest of the shingle set, SimHash over it and over other hashes of it, its size."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            fps = np.array([_majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            again = np.array([_majority(mixed(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"_row": b["_row"], "key": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "fp": fps, "fp2": again, "n": [len(s) for s in sets]})

    return docs.select("_row", F.col(text_col).alias("text")).mapInPandas(run, "_row long, key string, fp long, fp2 long, n long")


def _node_pairs(fp: np.ndarray, root: np.ndarray, bits: int, leaf: int = 512):
    """Pairs of nodes of at most `leaf` rows or equal fingerprints in the trie over sorted fingerprints, as (a from, a to, b from, b to).

    Both nodes go down together; a pair is cut off beyond `bits` differing bits, or if all its rows are of one component already.
    """
    changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
    one = lambda lo, hi: changes[hi - 1] == changes[lo]

    def middle(lo, hi, bit):
        split = int(fp[lo]) >> (64 - bit) << (64 - bit) | 1 << (63 - bit)
        return lo + int(np.searchsorted(fp[lo:hi], np.uint64(split)))

    stack = [(0, len(fp), 0, len(fp), 0, 0)]
    while stack:
        a, a_to, b, b_to, bit, apart = stack.pop()
        if a == a_to or b == b_to or apart > bits or (one(a, a_to) and one(b, b_to) and root[a] == root[b]):
            continue
        if bit == 64 or (a_to - a <= leaf and b_to - b <= leaf):
            for lo in range(a, a_to, 1024):  # blocks of bounded size, also where equal fingerprints are many
                for at in range(b, b_to, 1024):
                    yield lo, min(lo + 1024, a_to), at, min(at + 1024, b_to)
            continue
        p, q = middle(a, a_to, bit), middle(b, b_to, bit)
        stack += [(a, p, b, q, bit + 1, apart), (p, a_to, q, b_to, bit + 1, apart), (a, p, q, b_to, bit + 1, apart + 1)]
        if a != b:
            stack.append((p, a_to, b, q, bit + 1, apart + 1))


class _Rows:
    """Rows of whole buckets, sorted by bucket and fingerprint."""

    def __init__(self, b: pd.DataFrame):
        code, r64 = b["bucket"].to_numpy(), b["r64"].to_numpy().view(np.uint64)
        order = np.lexsort((r64, code))
        self.code, self.r64, self.n, self.head, self.root = code[order], r64[order], b["n"].to_numpy()[order], b["head"].to_numpy()[order], b["root"].to_numpy()[order]
        self.edge = np.flatnonzero(np.r_[True, self.code[1:] != self.code[:-1]])
        self.size = np.diff(np.r_[self.edge, len(code)])

    def alike(self, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of places those that can be links and aren't joined yet, with their differing bits."""
        d = np.bitwise_count(self.r64[i] ^ self.r64[j])
        ok = np.flatnonzero(d <= bits)
        i, j, d = i[ok], j[ok], d[ok]
        few, many = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (100 * few >= SIMILARITY * many) & (self.root[i] != self.root[j])
        return i[ok], j[ok], d[ok].astype(np.int32)

    def owned(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair belongs to this bucket, of all in which it meets: the first quarter that brings it together, and one path of that."""
        x, path, quarter = self.r64[i] ^ self.r64[j], self.code[i] & 0xFFFF, self.code[i] >> 16
        own = (x >> np.uint64(48)).astype(np.int64)
        least = np.minimum(self.r64[i] >> np.uint64(48), self.r64[j] >> np.uint64(48)).astype(np.int64)
        apart = np.bitwise_count(own)
        ok = (apart <= 2) & (np.where(apart < 2, least, least ^ (own & -own)) == path)
        for back in range(1, 4):  # quarter q stands 16 * (4 - back) bits up if it comes `back` before the one on top
            near = np.bitwise_count((x >> np.uint64(48 - 16 * (4 - back))) & np.uint64(0xFFFF)) <= 2
            ok &= ~(near & (quarter >= back))
        return ok

    def found(self, i, j, d) -> pd.DataFrame:
        return pd.DataFrame({"a": np.minimum(self.head[i], self.head[j]), "b": np.maximum(self.head[i], self.head[j]), "d": d, "bucket": np.int32(-1)})

    def pairs(self, bits: int, enough: int, small: int = 256, step: int = 1 << 18):
        """(places of the pairs, differing bits), in blocks of bounded size: small buckets whole, in large ones by the trie, until there are more than `enough` a row."""
        rest = np.repeat(np.where(self.size <= small, self.size, 0), self.size)
        rest = np.maximum(np.repeat(self.edge, self.size) + rest - np.arange(len(rest)) - 1, 0)  # partners after each row
        upto = np.cumsum(rest)
        at = 0
        while at < len(rest):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)))
            n = rest[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j, d = self.alike(i, j, bits)
            ok = self.owned(i, j)
            yield i[ok], j[ok], d[ok]
            at = to
        for lo, n in zip(self.edge[self.size > small].tolist(), self.size[self.size > small].tolist()):
            total = 0
            for a, a_to, b, b_to in _node_pairs(self.r64[lo : lo + n], self.root[lo : lo + n], bits):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(a, a_to), np.arange(b, b_to), indexing="ij"))
                i, j = i[i < j] + lo, j[i < j] + lo
                i, j, d = self.alike(i, j, bits)
                ok = self.owned(i, j)
                yield i[ok], j[ok], d[ok]
                total += int(ok.sum())
                if total > enough * n:
                    break


def _neighbours(rows: _Rows, bits: int):
    """Each row with the next one in the order of fingerprints."""
    i = np.flatnonzero(rows.code[1:] == rows.code[:-1])
    yield rows.found(*rows.alike(i, i + 1, bits))


def _all_of(rows: _Rows, bits: int, dense: int = DENSE, block: int = DENSE_BLOCK):
    """All candidates; of buckets where they are more than `dense` for each row the rows instead, by blocks (b null, d the block, bucket set)."""
    bucket = np.repeat(np.arange(len(rows.edge)), rows.size)
    count, held = np.zeros(len(rows.edge), np.int64), []
    for i, j, d in rows.pairs(bits, dense):
        count += np.bincount(bucket[i], minlength=len(count))
        few = count[bucket[i]] <= dense * rows.size[bucket[i]]
        held.append((i[few], j[few], d[few]))
    many = count > dense * rows.size
    for i, j, d in held:
        few = ~many[bucket[i]]
        yield rows.found(i[few], j[few], d[few])
    at = np.flatnonzero(many[bucket])
    place = (at - rows.edge[bucket[at]]) // block
    yield pd.DataFrame({"a": rows.head[at], "b": pd.array([None] * len(at), "Int64"), "d": place.astype(np.int32), "bucket": rows.code[at].astype(np.int32)})


def candidates(heads: DataFrame, which=_all_of, bits: int = STAGE_BITS) -> DataFrame:
    """heads (head, fp, n, root) -> (a, b, d, bucket): pairs of like size, in different components and at most `bits` bits apart, of which a 16-bit quarter differs in two.

    The trie is held in four rotations, cut at 16 bits into buckets, which are tasks' units. Each fingerprint goes to the buckets at most one bit from each of its
    quarters, so quarters two bits apart meet. All pairs up to 11 bits apart have such a quarter; of those 12 to 14 bits apart most do, but not all. Neighbours in
    the order of fingerprints need no flipped buckets.
    """
    flips = 1 if which is _neighbours else 17
    to = heads.select("head", "fp", "n", "root", F.explode(F.sequence(F.lit(0), F.lit(4 * flips - 1))).alias("k"))
    to = to.withColumn("q", F.expr(f"cast(k div {flips} as int)")).withColumn("r64", F.expr("if(q = 0, fp, shiftleft(fp, 16 * q) | shiftrightunsigned(fp, 64 - 16 * q))"))
    flip = f"if(k % {flips} = 0, 0, shiftleft(1, cast(k % {flips} - 1 as int)))"
    to = to.select("head", "r64", "n", "root", F.expr(f"cast(q * 65536 + ((shiftrightunsigned(r64, 48) & 65535) ^ {flip}) as int)").alias("bucket"))

    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(b):
                last = int(np.searchsorted(b["bucket"].to_numpy(), b["bucket"].iloc[-1]))
                held = b.iloc[last:]
                if last:
                    yield from which(_Rows(b.iloc[:last]), bits)
        if held is not None and len(held):
            yield from which(_Rows(held), bits)

    lanes = partitions(heads.sparkSession)
    return to.repartition(lanes, "bucket").sortWithinPartitions("bucket", "head").mapInPandas(run, "a long, b long, d int, bucket int")


def _near(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Rows (place in a, place in b) of the pairs of shingle sets that have the similarity asked for, by an index of a's shingles."""
    if not a or not b:
        return np.zeros((0, 2), np.int64)
    size = np.array([len(x) for x in a])
    every = np.concatenate(a)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(a)), size)[order]
    out = []
    for j, x in enumerate(b):
        lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(owner[at], minlength=len(a))
        i = np.flatnonzero(100 * both >= SIMILARITY * (size + len(x) - both))
        out.append(np.stack([i, np.full(len(i), j)], 1))
    return np.concatenate(out)


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Some of the pairs that connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(k)
    return pairs[keep]


def _dense_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a dense bucket (or within one), as many as connect its rows."""
    left, right = (group[group["side"] == side].sort_values("v") for side in (0, 1))
    found = _near([np.sort(np.asarray(x, np.int64)) for x in left["s"]], [np.sort(np.asarray(x, np.int64)) for x in (right if len(right) else left)["s"]])
    head, other = left["v"].to_numpy(), (right if len(right) else left)["v"].to_numpy()
    pairs = np.stack([head[found[:, 0]], other[found[:, 1]]], 1)
    pairs = _spanning(pairs[pairs[:, 0] != pairs[:, 1]])
    return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _verified(pairs: DataFrame, keyed: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Of the candidates those whose shingle sets have the similarity asked for, counted exactly.

    Single pairs are joined with both sets. Of a dense bucket each pair of blocks is a task that gets its rows' sets once and gives no more links than connect them.
    """

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"v": b["_row"], "s": [shingle_set(t, shingle).view(np.int64) for t in b["text"]]})

    pairs = written(pairs, "candidates")
    single = pairs.filter("b is not null").select("a", "b").distinct()
    dense = pairs.filter("b is null").select("bucket", F.col("a").alias("v"), F.col("d").alias("block"))
    seen = pairs.select(F.explode(F.array("a", "b")).alias("_row")).filter("_row is not null").distinct()
    sets = written(keyed.select("_row", F.col(text_col).alias("text")).join(seen, "_row", "left_semi").mapInPandas(run, "v long, s array<long>"), "sets")
    both = single.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    found = both.filter(100 * F.col("both") >= SIMILARITY * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")
    # a block meets itself and each other block of its bucket: side 0 in the pairs where it comes first
    last = dense.groupBy("bucket").agg(F.max("block").alias("last"))
    meets = dense.join(last, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    meets = meets.select("v", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    close = meets.join(sets, "v").groupBy("bucket", "x", "y").applyInPandas(_dense_links, "a long, b long")
    found = written(found.union(close).distinct(), "links")
    for used in (pairs, sets):
        removed(pairs.sparkSession, used)
    return found


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, bits: int = STAGE_BITS, dense: int = DENSE, block: int = DENSE_BLOCK) -> DataFrame:
    """Keeps one row of each group of near copies, with all its columns: that of smallest id (null ids last). Rows are told apart by a key of their own, not by id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and what such pairs connect. SimHash over the set only
    proposes pairs; each link is verified on the sets. So that a group of near copies doesn't bring all its pairs, components grow in rounds: first each text
    with its neighbours in the order of fingerprints, then all candidates that are still in different components; node pairs of one component are cut off in the
    trie. Where candidates stay many (over `dense` a row), as among texts that are alike but not enough, no pairs are made: blocks of the bucket meet in tasks of their
    own, which hold 2 * `block` sets and give only as many links as connect them.

    Candidates must agree in a second fingerprint too, which keeps chance pairs of a large corpus from verification.

    Rows with null or empty text have an empty set and are copies of each other. Rows that repeat an id are told apart by their other columns; of rows that agree in
    all, one is kept. (Rows are known by 64-bit hashes: among n, a pair meets with a chance of n * n / 2**65.) Very long texts are read whole. Columns keep their
    names, but for `_row`, which the input must not have. Empty tables: no rows.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_row", F.xxhash64(*docs.columns))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))
    known = keyed.select("_row", F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    signed = written(_signed(known, "text", shingle), "signed")
    repeats = written(signed.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row"), "repeats")
    ids = known.select("_row", "_id").distinct()
    heads = signed.distinct().join(ids, "_row")
    heads = heads.groupBy("key").agg(F.min_by("_row", order).alias("head"), F.min(order).alias("o"), *[F.min(c).alias(c) for c in ("fp", "fp2", "n")]).drop("key")
    heads = written(heads, "heads")
    removed(spark, signed)
    links, roots, other = None, None, heads.select("head", "fp2")
    for which in (_neighbours, partial(_all_of, dense=dense, block=block)):
        now = heads.filter("n > 0").select("head", "fp", "n")
        now = now.withColumn("root", F.col("head")) if roots is None else now.join(roots, F.col("head") == F.col("v"), "left").select("head", "fp", "n", F.coalesce("root", "head").alias("root"))
        pairs = candidates(now, which, bits).join(other.toDF("a", "fa"), "a").join(other.toDF("b", "fb"), "b", "left")
        pairs = pairs.filter(F.col("b").isNull() | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) + F.col("d") <= BOTH_BITS)).select("a", "b", "d", "bucket")
        found = _verified(pairs, keyed, text_col, shingle)
        links = found if links is None else links.union(found)
        roots = components(links)
    of = heads.join(roots, F.col("head") == F.col("v"), "left")
    first = written(of.groupBy(F.coalesce("root", "head").alias("root")).agg(F.min_by("head", "o").alias("_row")).select("_row"), "kept")
    kept = keyed.join(first, "_row", "left_semi")
    if repeats.limit(1).count():  # only these rows are sorted
        again = kept.join(repeats, "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.join(repeats, "_row", "left_anti").unionByName(again)
    return kept.drop("_row")
