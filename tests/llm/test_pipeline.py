"""The pipeline's stages against a plain chain, on a table with null and repeated ids."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline as P
from sparsewide.llm import decontaminate, mixing
from sparsewide.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAY = {"en": "the of and that with was this have from they house river stone".split(), "de": "und nicht für über schön wir haben das größe ich wald stein".split()}


def corpus():
    rng = random.Random(12)
    say = lambda lang, n: " ".join(rng.choice(SAY[lang]) + rng.choice(["", "ing", "er", "s", "en", "lich"]) for _ in range(n))
    rows = [(k, say(lang, rng.randrange(30, 120)), lang, f"s{k % 4}") for k, lang in enumerate(["en", "de"] * 40)]
    bench = [(0, say("en", 30)), (1, say("de", 20))]
    w = rows[3][1].split()
    rows += [
        (None, say("en", 50), "en", "s0"), (None, say("en", 60), "en", None), (4, say("de", 70), "de", "s1"), (4, say("de", 80), "de", "s1"),  # four different texts
        (90, rows[5][1], "de", "s2"), (91, " ".join(w[:40] + ["changed"] + w[41:]), "de", "s1"), (92, "12 ### 34", "en", "s1"), (93, None, "en", "s1"), (94, "", None, None),
        (95, say("en", 20) + " " + bench[0][1] + " " + say("en", 9), "en", "s3"), (96, bench[1][1], "de", "s3"), (4, rows[0][1], "en", "s0"),
    ]
    return [(*r, len(r[1] or "")) for r in rows], bench


def test_stages_equal_a_plain_chain(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r[0]), str(r[1]), str(r[3]))
    kept, want = [], []
    for _, stage in P.STAGES[:3]:
        docs = P.written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(key(tuple(r)) for r in docs.collect()))
    language = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    want.append(sorted(map(key, language)))
    sets = [set(zip(*(r[1].split()[i:] for i in range(5)))) for r in language]
    root = list(range(len(language)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(language)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, r in enumerate(language):
        groups.setdefault(find(i), []).append(r)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    want.append(sorted(map(key, first)))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def dirty(text):
        d = words(text)
        for _, t in bench:
            b = words(t)
            w = min(decontaminate.WINDOW, len(b))
            for diag in range(-len(b) + 1, len(d)):
                e = [d[k] == b[k - diag] for k in range(max(diag, 0), min(len(d), diag + len(b)))]
                if any(sum(e[s : s + w]) >= decontaminate.needed(w) for s in range(len(e) - w + 1)):
                    return True
        return False

    clean = [r for r in first if not dirty(r[1])]
    want.append(sorted(map(key, clean)))
    assert kept == want and len(want[2]) < len(want[1]) < len(want[0]) < len(rows)
    assert {"None", "4"} <= {k[0] for k in kept[2]} and sum(k[0] == "None" for k in kept[2]) == 2 and sum(k[0] == "4" for k in kept[2]) >= 3

    mixed = P.written(P.mix_sources(spark, docs, str(tmp_path)), "test")
    took: dict = {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        took[str(r["source"])] = took.get(str(r["source"]), 0) + len(r["text"].split())
    size: dict = {}
    for r in clean:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for name, target in zip(names, mixing.targets([size[s] for s in names])):
        assert abs(took.get(str(name), 0) - target) <= 3 * mixing.BLOCK and target <= 3 * size[name] + 1e-6
    texts = {r[1] for r in clean}
    assert sum(r["text"] not in texts for r in mixed.collect()) <= len(names)  # parts of the last document of a source

    from tokenizers import Tokenizer

    tok, start, made = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(mixed.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [0]
        made.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in P.encode(spark, mixed, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(made, key=str)
    whole = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in P.run(spark, str(tmp_path)).collect()]
    assert sorted(whole, key=str) == sorted(made, key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
