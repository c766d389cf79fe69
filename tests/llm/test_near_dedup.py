"""One row of each group of near copies: row identity and recall."""

import random

import pytest

from sparsewide.llm import simhash


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000):x}" for _ in range(n))


def test_rows_without_or_with_shared_ids_are_kept_by_text(spark):
    a, b, c, d, e = (text(k) for k in range(5))
    docs = spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (7, c), (9, a), (None, e), (None, e), (3, b)], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(docs).collect())
    assert got == sorted([("9", a), ("3", b), ("7", c), ("7", d), ("None", e)])
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_links_of_nodes_whose_paths_are_the_same_number_at_two_depths(spark):
    near = {0} | {1 << i for i in range(64)} | {1 << i | 1 << j for i in range(64) for j in range(i)}
    fps = sorted(set(random.Random(5).sample(sorted(near), 700)) | {0})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= simhash.BUDGET}
    for node in (6, 60):
        got = [frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), node=node).collect()]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("kw", [{}, {"dense": 0, "block": 3}])
def test_stage_finds_pairs_of_similarity_080_by_brute_force(spark, kw):
    rng, texts = random.Random(9), []
    for k in range(60):
        w = text(k, rng.choice([40, 150, 600])).split()
        texts.append(" ".join(w))
        for share in (0.003, 0.01, 0.02, 0.03, 0.06):
            texts.append(" ".join(f"changed{rng.randrange(99)}" if rng.random() < share else x for x in w))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.one_of_each(docs, **kw).collect()}
    print("texts", len(texts), "components", len(want), "kept", len(got))
    assert want <= got  # nothing that isn't a near copy goes
    assert len(got) - len(want) <= (len(texts) - len(want)) // 50 and len(want) < len(texts) - 100
