"""Every operator on nulls in all columns, empty and very long texts, repeated rows, clashing column names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparsewide.llm import decontaminate, html_extract, language_id, licenses, mixing, quality, simhash, suffix_dedup, token_output, url_filters
from sparsewide.llm.queries import URL_RULES, tokenizer_path

CLASH = "fp string, block string, key string, n string, item string, src string, size string, host string, digests string, head string"


def language(docs):
    return language_id.predict(docs, language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id")))))


OPERATORS = {
    "op1": simhash.near_duplicates,
    "op1 stage": simhash.one_of_each,
    "op2": lambda docs: decontaminate.overlaps(docs, docs.filter("doc_id < 100 or text is null").select(F.col("doc_id").alias("item_id"), "text")),
    "op3": mixing.taken,
    "op4": lambda docs: token_output.encode_documents(docs, tokenizer_path()),
    "op5": quality.judge,
    "op7": licenses.scan,
    "op8": language,
    "op10": suffix_dedup.repeats,
}


def rows():
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    out = [(k, say(60 + k), "en", "a") for k in range(20)]
    out += [out[3], out[3], (None, None, None, None), (None, None, None, None), (None, say(30), None, "b"), (5, None, "en", None), (6, "", "de", "a"), (7, " \n\t ", "de", "a"), (8, "\x00 ퟿ é \U0001f600", "fr", "b")]
    return out + [(900, say(60_000), "en", "a"), (901, "x" * 300_000, "en", "a"), (902, "a " * 100_000, "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in rows()], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, docs, name):
    run = OPERATORS[name]
    found = run(docs).collect()
    ids = sorted(str(r["doc_id"]) for r in found)
    every = sorted(str(r[0]) for r in rows())
    if name == "op2":
        assert {str(r[0]) for r in rows()[:20]} <= set(ids)
    elif name == "op1 stage":
        assert set(every) - set(ids) <= {"6", "7", "None"} and len(ids) < len(every) and "w" in found[0]["text"]
        assert run(docs).columns == docs.columns
    else:
        assert ids == every  # a row for each row
        same = [r for r in found if r["doc_id"] == 3]
        assert len(same) == 3 and (name in ("op4", "op10") or len(set(map(str, same))) == 1)
    assert run(docs.limit(0)).collect() == []
    assert len(run(docs.filter("text IS NULL")).collect()) == (0 if name == "op2" else 1 if name == "op1 stage" else 3) or name == "op1 stage"


def test_pages(spark):
    page = "<html><body><nav>menu</nav><article><p>text</p></article></body></html>"
    pages = [(1, "http://a.example/en/7", page), (1, "http://a.example/en/7", page), (None, None, None), (2, None, page), (3, "http://b.example/" + "x" * 100_000, "<p>" * 50_000 + "deep"), (4, "", ""), (5, "no scheme", "a < b")]
    frame = spark.createDataFrame([(*p, *["clash"] * 10) for p in pages], f"page_id long, url string, html string, {CLASH}").repartition(3)
    texts = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(frame).collect())
    assert texts == sorted([("1", "text", 4), ("1", "text", 4), ("None", "", 0), ("2", "text", 4), ("3", "deep", 4), ("4", "", 0), ("5", "a < b", 5)])
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("a", None, "block")], url_filters.RULE_SCHEMA)
    judged = sorted((str(r["page_id"]), r["verdict"]) for r in url_filters.judge(frame, rules).collect())
    assert judged == sorted((str(p[0]), "allow") for p in pages)
    assert html_extract.extract(frame.limit(0)).collect() == [] and url_filters.judge(frame.limit(0), rules).collect() == []
    assert len(url_filters.judge(frame, rules.limit(0)).collect()) == len(pages)
