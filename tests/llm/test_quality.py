"""The language model of the quality rules against a plain modified Kneser-Ney model of all other documents."""

import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from sparsewide.llm import hash_arrays, quality


def discount(c):
    n = [sum(1 for x in c.values() if x == k) for k in range(1, 5)]
    return quality.discounts(n)


def brute(rows):
    """log perplexity of (lang, text) by the model of the other texts of the language."""
    out = {}
    for lang in {r[0] for r in rows}:
        texts = {t: t.translate({c: c + 32 for c in range(65, 91)}).split() for g, t in rows if g == lang}
        pairs = lambda w: Counter(zip(["<s>", *w], w))
        whole = sum((pairs(w) for w in texts.values()), Counter())
        d2 = discount(whole)
        d1 = discount(Counter(c for _, c in whole))
        size = len({c for _, c in whole})
        for text, words in texts.items():
            n = whole - pairs(words)
            before = Counter(c for _, c in n)
            total, after = Counter(), defaultdict(list)
            for (b, c), k in n.items():
                total[b] += k
                after[b].append(k)
            types, back = sum(before.values()), sum(d1[min(k, 3)] for k in before.values())

            def p(b, c):
                low = (max(before[c] - d1[min(before[c], 3)], 0) + back / size) / types if types else 1 / size
                return (max(n[b, c] - d2[min(n[b, c], 3)], 0) + sum(d2[min(k, 3)] for k in after[b]) * low) / total[b] if total[b] else low

            for b in ["<s>", *words[:3]]:  # a distribution over the words
                assert sum(p(b, c) for c in {c for _, c in whole}) == pytest.approx(1)
            out[lang, text] = -sum(math.log(p(b, c)) for b, c in zip(["<s>", *words], words)) / len(words) if words else None
    return out


def corpus():
    rng = random.Random(4)
    say = lambda n, v: " ".join(f"w{int(v * rng.random() ** 3)}" for _ in range(n))
    rows = [("en" if k % 3 else "de", say(rng.randrange(1, 90), 40)) for k in range(40)] + [(None, say(60, 9)), (None, "w1 w2 w1"), ("fr", "alone it stands"), ("en", "WORD w1\n\tw2"), ("de", ""), ("de", " ")]
    return rows + [rows[1], rows[1], ("de", rows[1][1])]


@pytest.mark.parametrize("block,entries", [(1 << 20, 1 << 20), (400, 50)])
def test_log_perplexity_equals_a_model_of_the_other_texts(spark, block, entries):
    rows = corpus()
    want = brute(rows)
    frame = spark.createDataFrame([(k, t, g, "clash") for k, (g, t) in enumerate(rows)] + [(900, None, "en", "")], "doc_id long, text string, lang string, block string").repartition(3)
    got = {r["doc_id"]: r for r in quality.score(frame, block=block, entries=entries).collect()}
    assert len(got) == len(rows) + 1 and got[900]["log_ppl"] is None
    for k, (g, t) in enumerate(rows):
        assert got[k]["lang"] == g
        assert got[k]["log_ppl"] == (pytest.approx(want[g, t], abs=1e-9) if t.split() else None), (k, g, t)


def test_bands_reject_noise_and_leave_copies(spark):
    rng = random.Random(8)
    follow = {k: [rng.randrange(300) for _ in range(6)] for k in range(300)}

    def prose(n):
        w = [rng.randrange(300)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(f"word{x}" for x in w)

    clean = [prose(rng.randrange(60, 200)) for _ in range(300)]
    salad = [" ".join(rng.sample(t.split(), len(t.split()))) for t in (prose(150) for _ in range(10))]
    noise = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(80)) for _ in range(10)]
    rows = clean + salad + noise + [clean[0]] * 5
    frame = spark.createDataFrame([(k, t, "en") for k, t in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    kept = [r["kept"] for r in sorted(quality.judge(frame).collect(), key=lambda r: r["doc_id"])]
    assert sum(kept[:300]) >= 294 and not any(kept[300:320]) and len(set([kept[0], *kept[320:]])) == 1
    assert quality.judge(frame.limit(0)).collect() == []
    assert quality.bands(spark.createDataFrame([("en", False, x / 100) for x in range(700, 901)], "lang string, base_failed boolean, log_ppl double")).first()["low"] == pytest.approx(2.8)


def test_shuffle_files_go_before_the_next_step(spark, monkeypatch):
    """What was shuffled for one step of the model must not lie on disk during the next."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(400)), "en") for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    ids = lambda: {str(b).split("_")[1] for b in _shuffle_files(spark)}
    before, left, write = ids(), {}, quality.written

    def counted(df, tag, *more):
        out = write(df, tag, *more)
        time.sleep(1)  # files go in the background
        left[tag] = len(ids() - before)
        return out

    for module in (quality, hash_arrays):
        monkeypatch.setattr(module, "written", counted)
    assert quality.score(frame, block=20_000, entries=5_000).count() == 120
    assert left["bigrams"] <= left["firsts"] and left["words"] <= left["firsts"]


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return [f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")]
