"""Token-ID / binary output with Re-Pair grammar compression.

Documents are dealt by ranges of doc_id, encoded, closed with the end id, and packed in order into
shards of about `shard_ids` ids. In each shard frequent pairs of neighbouring symbols are replaced by
new symbols, round after round, until no pair occurs twice; rules and their expansion lengths are stored
with the shard, so any document or span of ids is decoded without the rest. The end id takes part in no rule, so every
document ends on a symbol.

A shard is one self-described binary value (below) in a row of a Parquet table: Spark's writer commits
it atomically and retries are safe, on any file system; decoders need only the value.

    "RPG1", then little-endian int64: ids, documents, rules, symbols, bytes per symbol (2 or 4), base
    (first new symbol); int64 symbols of each document; symbol pairs of the rules; int64 expansion
    lengths of the rules; symbols.

Defined cases: null text is empty (only the end id). Rows that repeat a doc_id are written next to each
other, ordered by text; null doc_ids come first. An empty table gives an empty file. A document longer
than a shard makes a larger shard. Ids of any size below 2**31 are compressed; new symbols start above
the largest. Other columns are ignored, whatever their names.

Pieces are split as the byte-level tokenizers' own pattern does, over arrays of characters, and only if the tokenizer's file
says that it works so; any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, partitions

_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))
MAGIC = b"RPG1"
HEAD = struct.Struct("<4s6q")
BASE = 50257
SHARD_IDS = 1 << 20
#: Letters, numbers and blanks below U+0250, as the byte-level tokenizers' own pattern splits them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LETTER, _NUMBER, _BLANK, _OTHER = range(1, 5)
_KIND = np.array([0, *(next(k for k, x in ((_LETTER, _L), (_NUMBER, _N), (_BLANK, _S), (_OTHER, "\0-ɏ")) if re.match(f"[{x}]", chr(c))) for c in range(1, 0x250))], np.uint8)
_CHARS = np.random.default_rng(20240517).integers(1, 1 << 63, 0x250, np.uint64) * np.uint64(2) + np.uint64(1)
#: Byte-level symbols: printable bytes stand for themselves, the others for the characters from U+0100 on; NUL parts pieces.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SYMBOLS = {chr(b): chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN) if b}
_WIDE = re.compile("[^\x01-ɏ]")


def _whole(t: str) -> bool:
    """Whether pieces as split here may not do for a text."""
    if "<|" in t or "\0" in t:
        return True
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.search(t) is not None
    return False


def splits_as_here(spec: dict) -> bool:
    """Whether a tokenizer is byte-level BPE over the pattern of `piece_starts`, with nothing before it, and special tokens that `_whole` sees."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    same = not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
    return bool(plain and same and all("<|" in t["content"] for t in spec.get("added_tokens") or []))


def piece_starts(c: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start, each text closed with NUL (a piece of its own), as the tokenizers' pattern splits them:

    '(?:[sdmt]|ll|ve|re)| ?letters| ?numbers| ?others|blanks(?!not blank)|blanks
    """
    kind = _KIND[c]
    starts = np.r_[True, kind[1:] != kind[:-1]] | (kind == 0)
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & (kind[1:] != 0))  # goes with what follows if it is a space, else alone
    starts[last] = True
    starts[last[c[last] == 0x20] + 1] = False
    q = np.flatnonzero(c == 0x27)
    q = q[starts[q]]
    a, b = c[q + 1], c[np.minimum(q + 2, len(c) - 1)]
    one = q[np.isin(a, [ord(x) for x in "sdmt"])]
    two = q[((a == ord("l")) & (b == ord("l"))) | (((a == ord("v")) | (a == ord("r"))) & (b == ord("e")))]
    starts[one + 1] = starts[two + 1] = False
    starts[one + 2] = starts[two + 3] = True
    return np.flatnonzero(starts)


def _stretches(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each place in `at` on, one stretch after the other."""
    ends = np.cumsum(n)
    return np.repeat(at - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of texts, as the tokenizer gives them; pieces that the tokenizer treats by themselves are remembered.

    What is known lies in arrays, some 70 bytes a piece: hashes in order with the piece of each, and all pieces' characters and ids end to end. The distinct pieces of a step are
    found by their hashes and compared by their characters; where different ones meet in a hash, the texts go through the tokenizer whole, and so do texts with characters
    from U+0250 on or what may be a special token.
    """

    def __init__(self, path: str, keep: int = 600_000, step: int = 1 << 18, batch: int = 1 << 20):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.keep, self.step, self.batch = keep, step, batch
        self.split = splits_as_here(json.loads(self.whole.to_str()))
        self.hashes, self.piece, self.again = _CHARS[:1], np.zeros(1, np.int32), np.ones(1, bool)  # NUL, without an id
        self.chars, self.char_at, self.n_chars = np.zeros(1, np.uint16), np.zeros(1, np.int64), np.ones(1, np.int32)
        self.ids, self.id_at, self.n_ids = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int32)

    def forget(self) -> None:
        """Pieces that only one step met since the last time go, or all but NUL where those that stay would be over half of `keep`."""
        stay = np.flatnonzero(self.again)
        stay = stay if 2 * len(stay) <= self.keep else stay[:1]
        number = np.full(len(self.piece), -1, np.int32)
        number[stay] = np.arange(len(stay))
        number, self.again = number[self.piece], np.arange(len(stay)) == 0
        self.hashes, self.piece = self.hashes[number >= 0], number[number >= 0]
        self.n_chars, n_chars = self.n_chars[stay], self.n_chars[stay].astype(np.int64)
        self.n_ids, n_ids = self.n_ids[stay], self.n_ids[stay].astype(np.int64)
        self.chars, self.char_at = self.chars[_stretches(self.char_at[stay], n_chars)], np.cumsum(n_chars) - n_chars
        self.ids, self.id_at = self.ids[_stretches(self.id_at[stay], n_ids)], np.cumsum(n_ids) - n_ids

    def _learn(self, hashes: np.ndarray, chars: np.ndarray, n_chars: np.ndarray) -> None:
        """The tokenizer's model takes each piece as one symbol a byte."""
        closed = np.zeros(len(chars) + len(n_chars), np.uint16)
        closed[np.arange(len(chars)) + np.repeat(np.arange(len(n_chars)), n_chars)] = chars
        symbols = closed[:-1].tobytes().decode("utf-16-le").encode().decode("latin-1")
        for b in set(symbols) & _SYMBOLS.keys():
            symbols = symbols.replace(b, _SYMBOLS[b])
        ids, at = [], [0]
        for tokens in map(self.whole.model.tokenize, symbols.split("\0")):
            ids += [t.id for t in tokens]
            at.append(len(ids))
        n_ids, order = np.diff(at).astype(np.int32), np.argsort(hashes)
        before = np.searchsorted(self.hashes, hashes[order])  # only what is new is sorted
        self.hashes, self.piece = np.insert(self.hashes, before, hashes[order]), np.insert(self.piece, before, len(self.n_ids) + order)
        self.char_at, self.id_at = np.r_[self.char_at, len(self.chars) + np.cumsum(n_chars) - n_chars], np.r_[self.id_at, len(self.ids) + np.array(at[:-1])]
        self.chars, self.n_chars = np.r_[self.chars, chars], np.r_[self.n_chars, n_chars.astype(np.int32)]
        self.ids, self.n_ids = np.r_[self.ids, np.array(ids, np.uint32)], np.r_[self.n_ids, n_ids]
        self.again = np.r_[self.again, np.zeros(len(n_ids), bool)]

    def _pieces(self, c: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        """The number of each piece of known ones, what is new learned before; None where different pieces have the same hash."""
        size = 2 * np.r_[at, at[-1] + n[-1]]
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(size), pa.py_buffer(c)]).dictionary_encode()
        _, size, c = each.dictionary.buffers()
        of, size = each.indices.to_numpy(), np.frombuffer(size, np.int64, len(each.dictionary) + 1) // 2
        c, at, n = np.frombuffer(c, "<u2", size[-1]), size[:-1], np.diff(size)
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(c) - 1, x)]) for x in (_MIX, _UNMIX))
        hashes = np.add.reduceat(_CHARS[c] * power, at) * back[at]
        by_hash = np.argsort(hashes)
        found = np.zeros(len(hashes), np.int64)
        found[by_hash] = np.minimum(np.searchsorted(self.hashes, hashes[by_hash]), len(self.hashes) - 1)
        pieces, known = self.piece[found], self.hashes[found] == hashes
        self.again[pieces[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            pieces[new] = len(self.piece) + np.arange(len(new))
            self._learn(hashes[new], c[_stretches(at[new], n[new])], n[new])
        if (self.n_chars[pieces] != n).any() or (self.chars[_stretches(self.char_at[pieces], n)] != c).any():
            return None
        return pieces[of]

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.hashes) > self.keep:
            self.forget()
        c = np.frombuffer(("\0".join(texts) + "\0").encode("utf-16-le"), "<u2")
        at = piece_starts(c)
        n, ids, closed = np.diff(at, append=len(c)), [], []
        for k in range(0, len(at), self.step):
            pieces = self._pieces(c, at[k : k + self.step], n[k : k + self.step])
            if pieces is None:
                return list(map(self._as_whole, texts))
            n_ids = self.n_ids[pieces].astype(np.int64)
            ids.append(self.ids[_stretches(self.id_at[pieces], n_ids)])
            closed.append(n_ids)
        ends = np.cumsum(np.concatenate(closed))[c[at] == 0]
        return np.split(np.concatenate(ids), ends[:-1])

    def _as_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out, held, size = [None] * len(texts), [], 0

        def done():
            for k, ids in zip(held, self._split([texts[k] or "" for k in held]) if held else ()):
                out[k] = ids
            held.clear()

        for k, t in enumerate(texts):
            if t and (not self.split or _whole(t)):
                out[k] = self._as_whole(t)
                continue
            held.append(k)
            size += len(t or "")
            if size >= self.batch:
                done()
                size = 0
        done()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task with the pieces it knows."""
    return Encoder(path)


def _picked(at: np.ndarray) -> np.ndarray:
    """Of places in order those that are taken from left to right when each takes its right neighbour too: every other one of a run."""
    picked, follows = np.ones(len(at), bool), np.flatnonzero(at[1:] == at[:-1] + 1) + 1
    if len(follows):
        place = np.arange(len(follows))
        run = np.maximum.accumulate(np.where(np.r_[True, follows[1:] != follows[:-1] + 1], place, 0))
        picked[follows] = (place - run) & 1 == 1
    return picked


def _by_pair(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Pairs of neighbours at the places in `at`, sorted, the place of each, and the bits of a symbol."""
    wide, place = int(s.max()).bit_length(), len(s).bit_length()
    key = (s[at].astype(np.uint64) << np.uint64(wide)) | s[at + 1]
    if 2 * wide + place > 64:
        order = np.argsort(key, kind="stable")
        return key[order], at[order], np.uint64(wide)
    both = np.sort((key << np.uint64(place)) | at.view(np.uint64))
    return both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).view(np.int64), np.uint64(wide)


def repair(ids: np.ndarray, *, end_id: int = 0, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): symbols from `base` on stand for the pairs in rules.

    Each round replaces all pairs that occur at least `least` times, left to right, and `least` falls to a 32nd from round to round, down to two; it ends when
    no pair occurs twice without overlap. A pair that others leave only one place makes no rule.

    Once pairs that occur twice were replaced, only those of new symbols, and those that made no rule, can occur twice: from then on only such places are sorted.
    """
    rules, s, n_rules, least = [np.zeros((0, 2), np.uint64)], ids.astype(np.uint32), 0, None
    look = np.ones(len(s), bool)  # places whose pair may occur twice
    while len(s) > 1:
        inner = s != end_id
        ordered, at, wide = _by_pair(s, np.flatnonzero(look[:-1] & inner[:-1] & inner[1:]))
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.r_[edge, len(ordered)])
        top = int(count.max(initial=0))
        if top < 2:
            break
        least = max(2, min(top, least or top) // 32)
        often = np.flatnonzero(count >= least)
        edge, count = edge[often], count[often]
        pair, hits = ordered[edge], at[_stretches(edge, count)]
        found, number = np.zeros(len(s), bool), np.empty(len(s), np.int32)
        found[hits], number[hits] = True, np.repeat(np.arange(len(pair), dtype=np.int32), count)
        hits = np.flatnonzero(found)  # in order
        number, every = number[hits], hits
        while True:  # until each rule that is left has two places
            taken = np.flatnonzero(_picked(hits))
            at, of = hits[taken], number[taken]
            uses = np.bincount(of, minlength=len(pair))
            stays = (uses != 1)[number]
            if stays.all():
                break
            stays = np.flatnonzero(stays)
            hits, number = hits[stays], number[stays]
        look = np.zeros(len(s), bool) if least == 2 else np.ones(len(s), bool)
        look[every] = True
        if not len(at):
            if least == 2:
                break
            continue
        used = np.flatnonzero(uses > 1)
        new = np.zeros(len(pair), np.uint32)
        new[used] = base + n_rules + np.arange(len(used))
        s[at] = new[of]
        look[at] = True
        look[np.maximum(at, 1) - 1] = True
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        s, look = s[keep], look[keep]
        rules.append(np.stack([pair[used] >> wide, pair[used] & np.uint64((1 << int(wide)) - 1)], 1))
        n_rules += len(used)
    return s, np.concatenate(rules).astype(np.uint32)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to (rules only use earlier ones)."""
    out = np.r_[np.zeros(len(rules), np.int64), 1]  # an id's at the end
    todo, sides = np.arange(len(rules)), np.maximum(rules.astype(np.int64) - base, -1)
    while len(todo):
        left, right = out[sides[todo, 0]], out[sides[todo, 1]]
        ready = (left > 0) & (right > 0)
        out[todo[ready]] = (left + right)[ready]
        todo = todo[~ready]
    return out[:-1]


def pack(docs: list[np.ndarray], *, end_id: int = 0, base: int = BASE) -> bytes:
    """Ids of documents, each with its end id, to a shard."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    base = max(base, int(ids.max(initial=0)) + 1)
    s, rules = repair(ids, end_id=end_id, base=base)
    n = lengths(rules, base)
    size = np.where(s < base, 1, n[np.maximum(s.astype(np.int64) - base, 0)] if len(n) else 1)
    ends = np.cumsum([len(d) for d in docs]) if docs else np.zeros(0, np.int64)
    symbols = np.diff(np.r_[0, np.searchsorted(np.cumsum(size), ends) + 1]) if docs else np.zeros(0, np.int64)
    wide = 2 if not len(s) or max(int(s.max()), int(rules.max()) if len(rules) else 0) < 1 << 16 else 4
    kind = f"<u{wide}"
    return HEAD.pack(MAGIC, len(ids), len(docs), len(rules), len(s), wide, base) + symbols.astype("<i8").tobytes() + rules.astype(kind).tobytes() + n.astype("<i8").tobytes() + s.astype(kind).tobytes()


class Shard:
    """Reads a shard; ids of the whole, of a document or of a span."""

    def __init__(self, data: bytes):
        magic, self.n_ids, docs, rules, symbols, wide, self.base = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, kind = HEAD.size, f"<u{wide}"
        self.doc_symbols = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.rules = np.frombuffer(data, kind, 2 * rules, at).reshape(-1, 2)
        at += 2 * wide * rules
        self.lengths = np.frombuffer(data, "<i8", rules, at)
        self.symbols = np.frombuffer(data, kind, symbols, at + 8 * rules)

    def _expand(self, s: np.ndarray) -> np.ndarray:
        """As lengths are known, an id goes to its place at once and only rules are carried on."""
        size = self._sizes(s)
        ends = np.cumsum(size)
        out, at = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32), ends - size
        left = self._sizes(self.rules[:, 0])
        while len(s):
            rule = s >= self.base
            done, rest = np.flatnonzero(~rule), np.flatnonzero(rule)
            out[at[done]] = s[done]
            of, at = s[rest].astype(np.int64) - self.base, at[rest]
            s, at = self.rules[of].T.ravel(), np.r_[at, at + left[of]]
        return out

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        first = int(self.doc_symbols[:k].sum())
        return self._expand(self.symbols[first : first + int(self.doc_symbols[k])])

    def _sizes(self, s: np.ndarray) -> np.ndarray:
        return np.r_[self.lengths, 1][np.maximum(s.astype(np.int64) - self.base, -1)]

    def sizes(self) -> np.ndarray:
        """Ids of each symbol."""
        return self._sizes(self.symbols)

    def span(self, start: int, stop: int) -> np.ndarray:
        """ids()[start:stop], expanding only the symbols that reach into it."""
        ends = np.cumsum(self.sizes())
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop)) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self._expand(self.symbols[a:b])[skip : skip + max(0, stop - start)]


ROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])


def write(docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encodes all documents and writes the shards under `path`, in ascending doc_id order by (part, seq)."""
    lanes = partitions(docs.sparkSession)
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(lanes, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encode, part, seq, held, ids, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)
        row = lambda: pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [size], "doc_ids": [ids], "data": [pack(held, end_id=end_id)]}, schema=ROW)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(texts), 2048):
                for key, got in zip(keys[at : at + 2048], encode(texts[at : at + 2048])):
                    held.append(np.concatenate([got, end]))
                    ids.append(key)
                    size += len(got) + 1
                    if size >= shard_ids:
                        yield row()
                        seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield row()

    ranged.mapInArrow(run, "part long, seq long, n_ids long, doc_ids array<bigint>, data binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema("part long, seq long, n_ids long, doc_ids array<bigint>, data binary").parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("s"))
    before = parts.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("b"))  # a row for each range
    inner = Window.partitionBy("part").orderBy("seq")
    first = shards.select("part", "seq", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("w")).join(before, "part").select("part", "seq", (F.col("b") + F.col("w")).alias("first"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard, out = Shard(r["data"]), []
                ends = np.cumsum(shard.sizes())[np.cumsum(shard.doc_symbols) - 1] if r["doc_ids"] else np.zeros(0, np.int64)
                ids, lo = shard.ids().astype("<u4"), 0
                for key, hi in zip(r["doc_ids"], ends.tolist()):
                    out.append((key, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    lo = hi
                key, at, n, crc = zip(*out) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[k]] * len(out), pa.int64()) for k in ("part", "seq")] + [pa.array(x, pa.int64()) for x in (key, at, n, crc)], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Writes the shards to the shared folder and returns what the files hold per document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-shards")
    write(docs, tokenizer, path, **kw)
    return read(spark, path)
