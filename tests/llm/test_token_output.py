"""The encoder of the token output: its pieces, its memory, hashes that meet."""

import itertools
import random
import tracemalloc

import numpy as np
from tokenizers import Tokenizer

from sparsewide.llm import token_output
from sparsewide.llm.queries import tokenizer_path


def odd_texts(n):
    rng = random.Random(1)
    say = lambda: "".join(rng.choice("ab'sdmtlvre  \n\t019.,!?-\xa0\x85é½ɏ\x1cZ\"'") for _ in range(rng.randrange(60)))
    return [say() for _ in range(n)] + [None, "", "'", "'s", "'l", "'ll", "x's's''s", " ", "  ", "\n\n", "a \n b", "日本 it's", "x\0y", "a" * 3000]


def test_what_an_encoder_remembers_takes_less_than_100_bytes_a_piece():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(500)) for _ in range(100)]
    encode = token_output.Encoder(tokenizer_path())
    tracemalloc.start()
    encode(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len({w for t in texts for w in t.split()})


def test_ids_are_the_tokenizers_in_small_steps_and_where_hashes_meet(monkeypatch):
    tok, texts = Tokenizer.from_file(tokenizer_path()), odd_texts(2000)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kw in ({"step": 50, "batch": 200}, {"keep": 100, "batch": 1000}, {}):
        encode = token_output.Encoder(tokenizer_path(), **kw)
        assert [x.tolist() for x in encode(texts)] == want and [x.tolist() for x in encode(texts)] == want
    monkeypatch.setattr(token_output, "_CHARS", np.repeat(token_output._CHARS[::2], 2))  # characters share their numbers by twos
    assert [x.tolist() for x in token_output.Encoder(tokenizer_path(), batch=200)(texts)] == want


def test_late_rounds_of_repair_sort_only_what_can_occur_twice(monkeypatch):
    rng = np.random.default_rng(6)
    words = [rng.integers(1, 5000, n) for n in rng.integers(2, 30, 400)]
    ids = np.concatenate([np.r_[words[k], 0] if k % 9 == 0 else words[k] for k in (400 * rng.random(4000) ** 2).astype(int)])
    sizes, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *x, **kw: sizes.append(len(a)) or sort(a, *x, **kw))
    s, rules = token_output.repair(ids, base=5000)
    seen, last = set(), {}
    for k, pair in enumerate(zip(s.tolist(), s[1:].tolist())):
        if 0 not in pair and last.get(pair, -2) != k - 1:
            assert pair not in seen
            seen.add(pair)
            last[pair] = k
    assert len(sizes) > 5 and sizes[-1] < len(s) / 10


def test_decoding_lays_out_each_id_once_however_deep_the_rules(monkeypatch):
    rng = np.random.default_rng(7)
    word = rng.integers(1, 5000, 3000)
    docs = [np.r_[x, 0] for x in [rng.integers(1, 5000, 3000), *[word] * 40, np.full(4096, 7)]]
    shard = token_output.Shard(token_output.pack(docs))
    laid, repeat = [0], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a, **kw: (out := repeat(*a, **kw), laid.append(len(out)))[0])
    ids = shard.ids()
    assert ids.tolist() == np.concatenate(docs).tolist() and sum(laid) <= len(ids)
    assert shard.document(41).tolist() == docs[41].tolist()


def test_a_new_piece_sorts_none_of_the_known_ones(monkeypatch):
    encode = token_output.Encoder(tokenizer_path())
    encode([" ".join("".join(x) for x in itertools.product("abcdefghi", repeat=4))])
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **kw: sizes.append(len(a)) or sort(a, *x, **kw))
    assert encode([" not yet"])[0].tolist() == Tokenizer.from_file(tokenizer_path()).encode(" not yet", add_special_tokens=False).ids
    assert max(sizes) < 100 and len(encode.hashes) > 5000


def test_pieces_met_again_outlive_what_is_forgotten():
    encode, word = token_output.Encoder(tokenizer_path(), keep=200), map("".join, itertools.product("bcdfg", "aeiou", "klmnp", "aeiou"))
    common, learned, learn = [next(word) for _ in range(40)], [], encode._learn
    encode._learn = lambda hashes, *x: learned.append(len(hashes)) or learn(hashes, *x)
    tok = Tokenizer.from_file(tokenizer_path())
    for _ in range(25):
        text = " " + " ".join([*common, *(next(word) for _ in range(20))])
        assert encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(encode.hashes) <= 200 + 60 and sum(learned) == 40 + 25 * 20
