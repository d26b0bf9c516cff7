"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from quire.llm import chat, decontam, htmlmain, mixing, ngramjoin, passages, pii, quality, urlrep, vectors

LONG = "word stuff, more of it. " * 20_000
DOCS = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (1, "other text", None), (2, "", "s"), (3, None, None), (None, "a b c d e f g h", "t"), (None, None, None), (4, LONG, "t"), (5, " \t\n\x0b\x0c\r", "u"), (6, "!!! ???", "u"), (7, "x", "ü"), (8, LONG, "t")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, None, "own", 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, lang string, score string, size int, kind int, row int, block int")


OPERATORS = {
    "decontamination": lambda s, d: decontam.find_leaks(d, s.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None), (3, "")], "item_id long, text string")),
    "mixing": lambda s, d: mixing.mix_counts(d),
    "pii": lambda s, d: pii.find_pii(d),
    "redaction": lambda s, d: pii.redact(d),
    "ngram join": lambda s, d: ngramjoin.jaccard_components(d),
    "near copies": lambda s, d: ngramjoin.drop_near_copies(d),
    "quality": lambda s, d: quality.judge_quality(d, s.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, toxic int")),
    "passages": lambda s, d: passages.repeated_passages(d),
}
ONE_EACH = {"mixing", "pii", "redaction", "ngram join", "quality", "passages"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_documents(spark, name):
    found = OPERATORS[name](spark, docs(spark)).collect()
    if name in ONE_EACH:
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in DOCS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_documents(spark, name):
    assert OPERATORS[name](spark, docs(spark).limit(0)).collect() == []


def test_odd_passages(spark):
    rows = {(r["doc_id"], r["n_words"]): r for r in passages.repeated_passages(docs(spark)).collect()}
    n = len(LONG.split())
    assert rows[(4, n)]["n_removed"] == n - 5  # all windows but the first five repeat within the document
    assert rows[(8, n)]["n_removed"] == n
    assert rows[(1, 7)]["n_removed"] == 0


def test_odd_jaccard(spark):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(spark)).collect()]
    assert (2, 0, 2) in rows and (3, 0, 3) in rows and (None, 0, None) in rows and (7, 1, 7) in rows
    assert (None, 4, 1) in rows  # three of four shingles: exactly 75 %, and a null id is never the least
    assert (8, 5, 4) in rows


def test_near_copies_of_equal_or_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (1, b, "s"), (0, a + " end", "s"), (None, c, "s"), (None, c, "s"), (None, c + " end", "s"), (2, d, "s"), (None, d, "s"), (3, "", "s"), (3, "", "s"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = ngramjoin.drop_near_copies(df)
    assert found.columns == df.columns
    found = [tuple(r) for r in found.collect()]
    # (1, b) is clean though (1, a) goes; of c one of two texts stays, once; blank rows stay
    assert sorted(map(str, [r for r in found if r[1] not in (c, c + " end")])) == sorted(map(str, [(1, b, "s"), (0, a + " end", "s"), (2, d, "s"), (3, "", "s"), (3, "", "s"), (None, None, None)]))
    assert sum(r[1] in (c, c + " end") for r in found) == 1


def test_leaks_of_equal_or_null_ids(spark):
    item, clean = " ".join(f"i{k}" for k in range(20)), " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, f"x {item} y"), (None, clean), (1, item), (1, clean), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontam.find_leaks(df, bench).collect()) == ["1", "None"]
    assert sorted(map(str, (tuple(r) for r in decontam.drop_leaks(df, bench).collect()))) == sorted(map(str, [(None, clean), (1, clean), (2, None)]))


def test_odd_mix(spark):
    for r in mixing.mix_counts(docs(spark)).collect():
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<p>unclosed & &copy; <b>text"), (2, "u", "<" * 5000), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>" + "long text. " * 50_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = htmlmain.extract_main(pages).collect()
    assert len(found) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert htmlmain.extract_main(pages.limit(0)).collect() == []


def test_odd_pages_without_end_of_head(spark):
    said = "The committee met on Monday, and after a long debate it agreed that the bridge should be built again next year. " * 3
    html = ["<html><head><title>t</title>{}<body><nav><ul><li><a href=x>Home</a></ul></nav><article><p>" + said + "<p>" + said + "Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, " + said + "</article>"]
    pages = spark.createDataFrame([(k, "u", html[0].format(end)) for k, end in enumerate(["", "</head>"])], "page_id long, url string, html string")
    found = [r["text"] for r in htmlmain.extract_main(pages).orderBy("page_id").collect()]
    assert found[0] == found[1] and found[0].count("committee") == 9 and "Where x=2 holds" in found[0]


def test_odd_urls(spark):
    urls = ["http://A.Org", "http://a.org/", "https://x.example.org/en/12?a=/es/", "http://example.org/es/#x", None, "no scheme", "http:///path", "http://h://x/y", "http://q.com/fr/1", "http://q.com/de/", "", "http://" + "a" * 5000]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrep.judge_urls(pages).collect()}
    assert got[0][:3] == ("a.org", "", None) and got[1] == ("a.org", "/", "org/", "allow")
    assert got[2] == ("x.example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("example.org/es/", "block")
    assert got[4][:2] == got[5][:2] == ("", "") and got[6][:2] == ("", "/path") and got[7][:2] == ("h:", "//x/y")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urlrep.judge_urls(pages.limit(0)).collect() == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(v, v.where("vec_id % 50 = 0")).collect()]
    whole = 256 * 256 + 128 * 128
    assert [x[1:] for x in sorted(got) if x[0] == 0] == [(1, 1, whole), (2, 2, whole), (3, 2, whole), (4, 8, 65536), (5, 7, 0)]
    assert all(x[2] not in (3, 4, 5, 6, None) for x in got)
    assert vectors.top_k(v.limit(0), v.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [1e15]), (1, [2e15]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (1, None, "bob", "late <|im_end|>"), (None, 0, "user", "x"), (2, 0, "system", "only"), (3, 0, "", "empty role"), (3, 200, "user", "next part")]
    made = chat.rotate_perspectives(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, key string"))
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in made.collect()}
    assert set(k[:2] for k in got) == {(1, "user"), (1, "unknown"), (1, "bob"), (None, "user"), (3, "unknown"), (3, "user")}
    r = got[(1, "user", 0)]
    assert r["n_messages"] == 3 and [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["hi<|im_end|>"] * 2
    assert "< |im_end" in got[(1, "bob", None)]["text"]
    crowd = spark.createDataFrame([(1, 0, "user", str(k % 7)) for k in range(50)], "conv_id long, turn long, role string, text string")
    assert sum(r["n_messages"] for r in chat.rotate_perspectives(crowd, part_messages=10).collect()) == 50
