"""Benchmark decontamination against every diagonal, laid out by brute force."""

import random
from itertools import combinations

from sparsewide.llm import decontaminate as D


def fits(mask, same):
    return any(all(bit == "0" or same[k + o] for o, bit in enumerate(mask)) for k in range(len(same) - len(mask) + 1))


def test_a_mask_fits_every_window_that_is_accepted():
    for n in range(1, D.WINDOW + 1):
        errors = n - D.needed(n)
        masks = D.masks_for(n, errors)
        for changed in combinations(range(n), errors):
            assert any(fits(m, [i not in changed for i in range(n)]) for m in masks), (n, changed, masks)
    assert len(D.masks_for(13, 2)) == 3


def brute(docs, items):
    out = {}
    for doc, text in docs:
        d = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
        for item, t in dict(items).items():
            b = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
            if item is None or not b:
                continue
            w = min(D.WINDOW, len(b))
            for diag in range(-len(b) + 1, len(d)):
                e = [d[k] == b[k - diag] for k in range(max(diag, 0), min(len(d), diag + len(b)))]
                if len(e) >= w and any(sum(e[s : s + w]) >= D.needed(w) for s in range(len(e) - w + 1)):
                    key = (doc, item, max(diag, 0), len(e))
                    out[key] = max(out.get(key, 0), sum(e))
    return {(*k, v) for k, v in out.items()}


def test_overlaps_equal_all_diagonals(spark):
    rng = random.Random(3)
    say = lambda n, v=60: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(k, say(n, 4000)) for k, n in enumerate([13, 13, 14, 16, 16, 20, 30, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 1])] + [(90, None), (91, ""), (None, "left out")]
    docs = []
    for k, t in items[:18]:
        for _ in range(12):
            w = [x if rng.random() > rng.choice([0, 0.1, 0.2, 0.3]) else "sub" for x in t.split()]
            docs.append((len(docs), f"{say(rng.randrange(30))} {' '.join(w)} {say(rng.randrange(30))}"))
    docs += [(None, docs[5][1]), (7, docs[20][1]), (7, docs[20][1]), (500, None), (501, ""), (502, "..."), (503, say(20_000, 3000) + " " + items[6][1])]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, item string, dh string").repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute(docs, items)
    for limit in (200_000, 0):
        got = [tuple(r) for r in D.overlaps(frame, bench, broadcast_seeds=limit).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(d, i, s, c, m) for d, i, s, c, m in want}
    assert len(want) > 100
