"""The ten operators against brute-force versions on small and awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparsewide.llm import decontaminate, html_extract, language_id, licenses, mixing, quality, simhash, suffix_dedup, token_output, url_filters
from sparsewide.llm.components import components
from sparsewide.llm.queries import SQL, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, a string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab):x}" for _ in range(n))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(0, 120)) for _ in range(n)]
    base += [base[3], base[3], base[3] + " x", base[7].upper(), None, "", " \n ", "one", "two words", "Ünï çödé \n\n ünï", "a" * 5000, words(rng, 9000)]
    near = base[10].split()
    for k in range(8):
        base.append(" ".join(w if i != k * 3 else "changed" for i, w in enumerate(near)))
    passage = words(rng, 40)
    base += [base[20] + " " + passage + " " + base[21], passage, passage + passage, "x" + passage[5:], "!!! ### | $$ \n a \n a \n\n a"]
    return [(i, t, None if i % 9 == 0 else "en" if i % 2 else "de", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    w = [x.encode() for x in WORD.findall(text or "")]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# 1


def test_simhash_matches_all_pairs(docs):
    got = rows(simhash.near_duplicates(docs))
    fps = {r[0]: brute_fingerprint(r[1]) for r in corpus()}
    ids = sorted(fps)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids)


@pytest.mark.parametrize("node", [4096, 6])
def test_trie_links_every_pair_once_also_in_large_nodes(spark, node):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:6]:
        for _ in range(40):
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    c = next(iter(fps))
    fps |= {c ^ (1 << k) for k in range(64)} | {0, 3, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = Counter(frozenset((r["a"], r["b"])) for r in rows(simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), node=node)))
    fps = sorted(fps)
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    assert set(got) == want and set(got.values()) == {1}


def test_simhash_empty_nulls_and_repeated_rows(spark, empty):
    assert rows(simhash.near_duplicates(empty)) == []
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in rows(simhash.near_duplicates(odd)))
    assert got == [("2", 2), ("4", 4), ("4", 4), ("None", 2), ("None", 4)]


def test_components_of_long_paths(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 50 != 49]
    got = {r["v"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == brute_components(order, edges)


# 2


def test_decontamination_finds_passages_with_substitutions(spark, docs):
    rng = random.Random(8)
    items = [(0, words(rng, 30, 5000)), (1, words(rng, 14, 5000)), (2, "only four words here"), (3, None), (4, "")]
    w = items[0][1].split()
    dirty = {
        100: "pre fix " + items[0][1] + " after", 101: " ".join(x if i % 9 else "sub" for i, x in enumerate(w)), 102: items[1][1].upper().replace(" ", ",  "),
        103: "so: Only four; words here.", 104: words(rng, 100, 5000) + " " + " ".join(w[5:25]),
    }
    plain = {105: " ".join(x if i % 3 else "sub" for i, x in enumerate(w)), 106: None, 107: "", 108: " ".join(w[:8])}
    frame = spark.createDataFrame([(k, v, "clash") for k, v in (dirty | plain).items()], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"] for r in rows(decontaminate.overlaps(frame, bench))} == set(dirty)
    assert {r["doc_id"] for r in rows(decontaminate.overlaps(frame, bench, broadcast_seeds=0))} == set(dirty)
    assert {r["doc_id"] for r in rows(decontaminate.clean(frame, bench))} == set(plain)
    assert rows(decontaminate.overlaps(frame, bench.limit(0))) == [] and rows(decontaminate.overlaps(frame.limit(0), bench)) == []
    assert {r["doc_id"]: r["start_word"] for r in rows(decontaminate.overlaps(frame, bench))}[100] == 2


# 3


def test_mixing_meets_targets_and_cap(docs, empty, spark):
    got = rows(mixing.taken(docs, block=8))
    want = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    source = {r[0]: r[3] for r in corpus()}
    assert {r["doc_id"]: r["size"] for r in got} == want
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        x = by[source[r["doc_id"]]]
        x[0], x[1], x[2] = x[0] + r["taken"], x[1] + r["size"], r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(want.values()))
    for taken, size, target in by.values():
        assert abs(taken - target) <= 8 * 6 and target <= 3 * size + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.taken(docs.repartition(5), block=8))))
    assert rows(mixing.taken(empty)) == []
    odd = spark.createDataFrame([(1, None, None), (1, "a b c", "x"), (1, "a b c", "x"), (None, "d", "x")], "doc_id long, text string, source string")
    assert len(rows(mixing.taken(odd, block=1))) == 4


@pytest.mark.parametrize("n", [0, 1, 90])
def test_mixing_equals_sql(spark, n):
    table = spark.createDataFrame(corpus()[-n:] if n else [], DOCS)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in table.collect()], table.toArrow().schema))
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({SQL['op3_source_mixing']})").fetchall()
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows(mixing.taken(table))]
    assert sorted(got) == sorted(want) and len(got) == min(n, len(corpus()))


def test_targets_share_the_excess():
    assert mixing.targets([100, 1, 50]) == pytest.approx([37.0, 3.0, 111.0])
    assert mixing.targets([10]) == [10.0] and mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


# 4


def test_tokens_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    odd = [(900, "It's   we'll\t\n\n x²½ <|endoftext|> ünï\xa0 é", "", "", 1, "", ""), (901, "日本語 \x1c x\x00y 😀", "", "", 1, "", ""), (902, "!" * 50, "", "", 1, "", "")]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_output.encode_documents(docs.union(spark.createDataFrame(odd, DOCS)), tokenizer_path(), shard_ids=5000))}
    start, want = 0, {}
    for r in sorted(corpus() + odd):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want[r[0]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert rows(token_output.encode_documents(empty, tokenizer_path())) == []


def test_shards_decode_documents_and_spans():
    rng = np.random.default_rng(1)
    docs = [np.r_[rng.choice([5, 6, 7, 50000], n), 0].astype(np.uint32) for n in (0, 1, 400, 3000, 2)] + [np.r_[np.full(1001, 9), 0].astype(np.uint32)]
    shard = token_output.Shard(token_output.pack(docs))
    every = np.concatenate(docs)
    assert (shard.ids() == every).all() and len(shard.symbols) < len(every) / 2
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 1), (3, 1500), (4000, len(every)), (7, 7)):
        assert (shard.span(a, b) == every[a:b]).all()


def test_repair_goes_on_until_no_pair_occurs_twice():
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 90_000, n) for n in rng.integers(1, 9, 300)]
    docs = [np.r_[np.concatenate([words[k] for k in (300 * rng.random(200) ** 2).astype(int)]), 0].astype(np.uint32) for _ in range(60)] + [np.r_[np.full(999, 7), 0].astype(np.uint32)]
    ids = np.concatenate(docs)
    s, rules = token_output.repair(ids, base=90_000)
    seen, last = Counter(), {}
    for k, pair in enumerate(zip(s.tolist(), s[1:].tolist())):
        if 0 not in pair and last.get(pair, -2) != k - 1:  # without overlap
            seen[pair] += 1
            last[pair] = k
    assert max(seen.values()) == 1
    uses = Counter(s.tolist()) + Counter(rules.ravel().tolist())
    assert all(uses[90_000 + k] for k in range(len(rules))) and len(s) < len(ids) / 3
    shard = token_output.Shard(token_output.pack(docs))
    assert shard.base == ids.max() + 1 and (shard.ids() == ids).all() and all((shard.document(k) == d).all() for k, d in enumerate(docs))
    assert (shard.span(5000, 5100) == ids[5000:5100]).all()


def test_other_tokenizers_get_whole_texts():
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    assert token_output.splits_as_here(spec)
    assert not token_output.splits_as_here(spec | {"normalizer": {"type": "Lowercase"}}) and not token_output.splits_as_here(spec | {"pre_tokenizer": {"type": "Whitespace"}})
    assert not token_output.splits_as_here(spec | {"added_tokens": [{"content": "[END]"}]})


# 5


def test_quality_base_counts_and_bands(docs, empty):
    got = {r["doc_id"]: r for r in rows(quality.judge(docs))}
    for i, text, *_ in corpus():
        t, r = text or "", got[i]
        w = WORD.findall(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rows(quality.judge(empty)) == []


# 6


def test_url_rules(spark):
    urls = [
        "http://EXAMPLE.com/en/7x?q", "https://a.example.com/en/8", "x://com/en/", "http://notexample.com/en/7", "http://example.net/de/8/1#f", "http://b.c.net/de/8", "ftp://org/es", "http://a.org/es/",
        None, "", "no scheme/com/en/", "http://example.com", "http://a-b.example.com/en/7", "http://host:80/en/?", "a://b://c/d", "http://exam/ple\n.com/en/",
    ]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "", "")], "page_id long, url string, key string, stack string")
    got = rows(url_filters.judge(pages, spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)))

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    assert sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted((i, h, p, str(r), v) for i, u in [*enumerate(urls), (0, urls[0])] for h, p, r, v in [brute(u)])
    assert {r["verdict"] for r in rows(url_filters.judge(pages, spark.createDataFrame([], url_filters.RULE_SCHEMA)))} == {"allow"}
    assert rows(url_filters.judge(pages.limit(0), spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA))) == []


# 7


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "GNU General\nPublic-License and MIT license; CC BY", "Released under the M1T Licence today", "Gnu generel public licens", None, "", "smit license",
        "apache apache license", "All rights reserved", "nothing of this kind", "é apache license é",
    ]
    got = rows(licenses.scan(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")))
    for r in got:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[2]["labels"] == "mit" and by[3]["labels"] == "gpl" and by[9]["labels"] == "" and by[9]["score"] == 0
    assert [(s["first_word"], s["edits"]) for s in by[3]["spans"]] == [(0, 2)]


# 8


def test_language_id(spark):
    rng = random.Random(4)
    say = {"en": "the of and that with was this have from they".split(), "fr": "les des une dans qui pour été où très être".split(), "de": "und nicht für über schön wir haben das größe ich".split()}
    made = [(i, " ".join(rng.choice(say[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(say) * 40)]
    odd = [(900, None, "en"), (901, "12 ### 34", "en"), (902, "", "en"), (903, "the", None)]
    frame = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = language_id.held_out(F.col("doc_id"))
    got = {r["doc_id"]: r for r in rows(language_id.predict(frame, language_id.fit(frame.filter(~out))).withColumn("out", out))}
    assert all(r["out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i]["lang_pred"] == lang for i, _, lang in made) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[903]["lang_pred"] == "en"
    none = language_id.fit(frame.limit(0))
    assert {r["lang_pred"] for r in rows(language_id.predict(frame, none))} == {"und"}


# 9

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div><article><h1>Head &amp;  line</h1>'
    '<p><b>First\n para.<br><p>Second <a href="x">li&eacute;n</a>.</p><aside>no</aside><form>no</form><section id="comments"><p>Reader</p></section></article><footer>&copy; x</footer></body></html>'
)


def test_html_extraction(spark):
    assert html_extract.main_text(PAGE) == "Head & line\nFirst para.\nSecond lién."
    assert html_extract.main_text(None) == "" and html_extract.main_text("<p>a &lt; b") == "a < b"
    bare = [f"<body><div class=top>Site name</div><div class=body><p>text {i} one</p><p>two {i * 7}</p>{'<p>three</p>' * (i % 3)}</div><div>All pages say this</div></body>" for i in range(12)]
    pages = [(i, f"http://h.example/{i}", h) for i, h in enumerate(bare)] + [(50, None, None), (51, "http://h2.example/", PAGE), (51, "http://h2.example/", PAGE)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = defaultdict(list)
    for r in rows(html_extract.extract(frame)):
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[4] == ["text 4 one\ntwo 28\nthree"] and got[50] == [""] and len(got[51]) == 2
    assert rows(html_extract.extract(frame.limit(0))) == []


def test_wrappers_are_optional_and_repeated():
    e = html_extract.expression
    w = html_extract.align(e("<div><h1>A</h1><p>x</p><p>y</p><h2>same</h2></div>"), e("<div><h1>B</h1><p>z</p><h2>same</h2><table><tr><td>1</table></div>"))
    assert [x[1:] for x in w] == [[None, 2, False], [None, 2, True], ["same", 2, False], ["1", 1, False]]
    groups = html_extract.fold(e("<dl>" + "".join(f"<dt>k{i}<dd>v{i}" for i in range(5)) + "</dl>"))
    assert [x[1:] for x in groups] == [[None, 1, True], [None, 1, True]]


def test_the_wrapper_decides_in_marked_and_unmarked_pages(spark):
    say = lambda i: "".join(f"<p>own {i} {k}</p>" for k in range(2 + i % 3))
    mark = [f"<article><h1>T{i}</h1><div>Read more on our site</div>{say(i)}{'<table><tr><td>only here</table>' if i == 3 else ''}<p>Follow us now</p></article>" for i in range(12)]
    bare = [h.replace("article", "section") for h in mark]
    copies = ["<article><h1>One</h1><p>same text on each page</p></article>"] * 9
    pages = [(k, f"http://{host}/{k}", h) for k, (host, h) in enumerate([("m.example", h) for h in mark] + [("b.example", h) for h in bare] + [("c.example", h) for h in copies])]
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, fixed string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    own = lambda i: "\n".join([f"T{i}", *(f"own {i} {k}" for k in range(2 + i % 3)), *(["only here"] if i == 3 else [])])
    assert got == {k: own(k % 12) if k < 24 else "One\nsame text on each page" for k in range(33)}
    few = {r["page_id"]: r["text"] for r in html_extract.extract(frame.filter("page_id < 4")).collect()}
    assert "Read more on our site" in few[0]
    thin = {r["page_id"]: r["text"] for r in html_extract.extract(frame, broadcast_bytes=0).collect()}
    assert thin == got


def test_deep_long_and_broken_pages():
    import time

    began = time.time()
    deep = "<div>" * 100_000 + "in" + "</div>" * 100_000 + "<p>after"
    assert html_extract.main_text(deep) == "in\nafter"
    assert html_extract.main_text("</div>" * 100_000 + "x") == "x"
    assert html_extract.main_text("<p>" + "<a '" * 50_000).count("'") == 50_000
    assert html_extract.main_text("<p title='it>one<p>two") == "one\ntwo"
    long = "".join(f"<p>block {i}</p><h2>h</h2>" for i in range(200_000))
    assert html_extract.main_text(long, [(1, "no")]).count("\n") == 399_999
    a, b = html_extract.expression(long), html_extract.expression(long.replace("block 7", "other 7"))
    assert len(html_extract.align(a, b)) <= len(a)
    assert time.time() - began < 60


# 10


def brute_repeats(texts, n):
    seen, out = set(), []
    for b in texts:
        cut = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                cut[i : i + n] = b"\1" * n
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "hot"), [(300, 99999), (1 << 20, 99999), (300, 1), (300, 3), (2000, 0)])
def test_suffix_repeats_match_brute_force(spark, docs, block, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.repeats(docs, block=block, bucket=300, hot=hot))}
    want = dict(zip((r[0] for r in corpus()), brute_repeats([(r[1] or "").encode() for r in corpus()], 100)))
    assert got == want and sum(w[1] for w in want.values()) > 5000


def test_buckets_compare_bytes_whatever_the_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, (3, 156), np.uint8)
    rows = np.concatenate([base[rng.integers(0, 3, 400)], np.zeros((400, 2), np.uint8)], axis=1)
    for row in rows:
        for k in rng.integers(0, 156, rng.integers(0, 3)):
            row[k] = 99
    rows[:, -2], rows[:, -1] = 56 - rng.integers(0, 2, 400) * rng.integers(0, 57, 400), 100 - rng.integers(0, 2, 400) * rng.integers(0, 57, 400)
    when = rng.permutation(400)  # one bucket holds any windows at all, as if all hashes were the same
    got = suffix_dedup.repeated(rows, when, 100)
    seen = [set() for _ in range(57)]
    for k in np.argsort(when):
        for back in range(57):
            if back <= rows[k, -2] and 100 - back <= rows[k, -1]:
                string = rows[k, 56 - back : 156 - back].tobytes()
                assert got[k, back] == (string in seen[back])
                seen[back].add(string)
            else:
                assert not got[k, back]
    assert 1000 < got.sum() < 400 * 57


def test_suffix_repeats_of_odd_tables(spark, empty):
    assert rows(suffix_dedup.repeats(empty)) == []
    odd = spark.createDataFrame([(None, None), (3, "z" * 150), (3, "z" * 150), (None, "z" * 99)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in rows(suffix_dedup.repeats(odd))) == [0, 0, 149, 150]
