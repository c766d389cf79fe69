"""License scans against edit distances of all stretches of words."""

import random

from sparsewide.llm import licenses


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(norm, phrase, edits):
    """Whether a stretch of whole words is within the edits of the phrase."""
    words = norm.split(b" ") if norm else []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            part = b" ".join(words[i:j])
            if len(part) > len(phrase) + edits:
                break
            if len(part) >= len(phrase) - edits and distance(part, phrase) <= edits:
                return True
    return False


def test_labels_and_spans_equal_brute_force():
    rng = random.Random(6)
    notices = dict(list(licenses.NOTICES.items()))
    seen = {True: 0, False: 0}
    for phrase, (label, edits) in notices.items():
        own = [licenses.Notice(phrase, label, edits)]
        for _ in range(12):
            text = list(phrase)
            for _ in range(rng.choice([0, 1, edits // 2, edits, edits + 1, edits + 3])):
                k = rng.randrange(len(text))
                text[k : k + rng.choice([0, 1, 1])] = rng.choice([["x"], ["q"], [], [" "]])
            norm = licenses.normal(" ".join(rng.choice(["some", "words", phrase[:9]]) for _ in range(rng.randrange(4))) + " " + "".join(text) + " and more")
            found = licenses.spans(norm, own)
            assert bool(found) == brute(norm, own[0].phrase, edits), (norm, phrase)
            seen[bool(found)] += 1
            for _, a, b, e, _ in found:
                assert distance(norm[a:b], own[0].phrase) <= e <= edits
                assert (a == 0 or norm[a - 1 : a] == b" ") and norm[b : b + 1] in (b"", b" ")
    assert min(seen.values()) > 20


def test_two_notices_side_by_side_and_far_apart():
    text = "mozilla public license mozila public license " + "x " * 500 + "mozilla publik license"
    found = licenses.spans(licenses.normal(text), [licenses.Notice("mozilla public license", "mpl", 2)])
    assert [(s[3]) for s in sorted(found, key=lambda s: s[1])] == [0, 1, 1]


def test_odd_tables(spark):
    schema = "doc_id long, text string, spans string, score string"
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
    long = "word " * 200_000 + "released under the mit licence"
    got = licenses.scan(spark.createDataFrame([(1, long, "a", "b"), (1, "MIT License", None, None), (1, "MIT License", None, None), (None, None, None, None)], schema)).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in got) == [("1", "mit"), ("1", "mit"), ("1", "mit"), ("None", "")]
    assert max(r["spans"][0]["first_word"] for r in got if r["spans"]) == 200_000
    own = licenses.scan(spark.createDataFrame([(1, "the house licence", "", "")], schema), notices={"house license": ("house", 2)}).first()
    assert own["labels"] == "house" and own["score"] < 1
