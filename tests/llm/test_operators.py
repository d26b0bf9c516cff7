"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, decontam, htmlblocks, htmlmain, lanes, mixing, ngramjoin, passages, pii, quality, vectors
from quire.llm.common import join_wide

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def corpus(seed, n=120):
    """Documents with copies, near copies, shared passages and runs of one word."""
    r = random.Random(seed)
    word = lambda: r.choice("ab") + r.choice("aeiou") + r.choice("klmnrst") * r.randint(1, 2) + str(r.randint(0, 60))
    shared = [[word() for _ in range(r.randint(15, 60))] for _ in range(4)]
    made = []
    for k in range(n):
        kind = r.random()
        if kind < 0.2 and made:
            w = list(r.choice(made))
        elif kind < 0.5 and made:
            w = list(r.choice(made))
            for _ in range(r.randint(1, 6)):
                if w:
                    w[r.randrange(len(w))] = word()
        elif kind < 0.6:
            w = [word()] * r.randint(1, 70)
        else:
            w = [word() for _ in range(r.choice([0, 1, 3, 5, 19, 20, 40, 150]))]
        if r.random() < 0.3:
            at = r.randint(0, len(w))
            w = w[:at] + r.choice(shared) + w[at:]
        made.append(w)
    return [(k * 7 % n, r.choice([" ", "\n", "  "]).join(w)) for k, w in enumerate(made)]


def removed(rows):
    """By trying all windows; rows may repeat, and ids may repeat or be missing."""
    found = [((d is None, d or 0), WORDS(t or "")) for d, t in rows]
    first, out = {}, []
    for d, w in found:
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), (d, i)), (d, i))
    for (doc_id, _), (d, w) in zip(rows, found):
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone[i : i + 20] = [True] * 20
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(map(str, out))


def with_odd_ids(rows, seed):
    r = random.Random(seed)
    return [(r.choice([None, 1, 2, 3, d]), t) for d, t in rows] + rows[:10] + [(None, rows[3][1])] * 5 + [(7, None), (None, None)]


@pytest.mark.parametrize("seed, odd, repeats", [(1, False, 1000), (2, True, 1000), (3, True, 1)])
def test_passages(spark, seed, odd, repeats):
    rows = with_odd_ids(corpus(seed), seed) if odd else corpus(seed)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), repeats).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == removed(rows)


def test_passages_of_one_id(spark):
    x, y = " ".join(f"x{k}" for k in range(25)), " ".join(f"y{k}" for k in range(25))
    for five in (5, None):
        rows = [(2, y), (five, x), (five, y), (9, x) if five else (None, x)]
        got = {(r["doc_id"], r["kept_sha256"] == hashlib.sha256(b"").hexdigest()): r["n_removed"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[(five, True)] == 25  # (five, y) repeats (2, y), whatever else stands under the same id


@pytest.mark.parametrize("n", range(0, 45, 3))
def test_anchors_of_short_lines(n):
    ids = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    h, w = lanes.rolled(ids, passages.PHRASE, 2), passages.WINDOW - passages.PHRASE + 1
    assert passages.anchors(ids, np.array([n])).tolist() == sorted({i + int(np.argmin(h[i : i + w])) for i in range(max(0, n - passages.WINDOW + 1))})


def test_phrases_become_strings_and_back():
    ids = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    at = np.arange(43)
    strings = passages.phrase_strings(*passages.phrase_codes(ids, at))
    line = "".join(chr(int(s) + 1) for s in passages.symbols(ids))
    assert strings == [line[k : k + passages.PHRASE] for k in at]


def test_lanes_against_words(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(lanes, "STEP", 50)
    parts = ["a", "A", "é", "😀", "word", "x" * 40, "x" * 41, "Y" * 300, " ", "\t", "\x0b", "\n ", "\xa0", ""]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200)]
    ids: dict = {}
    for fold in (False, True):
        data, offsets = lanes.text_bytes(pa.array(["skipped", *texts]).slice(1))
        k = 0
        for line in lanes.lines(data, offsets, fold, chunk=300):
            for a, b in zip(line.cuts[:-1], line.cuts[1:]):
                words = WORDS("".join(c.lower() if fold and "A" <= c <= "Z" else c for c in texts[k]))
                assert len(words) == b - a
                for w, i in zip(words, line.ids[a:b].tolist()):
                    assert ids.setdefault(w, i) == i
                k += 1
        assert k == len(texts)
    assert len(set(ids.values())) == len(ids)


def linked(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORDS("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(s), label[d]) for d, s in sets.items()}


@pytest.mark.parametrize("seed, crowd, hot", [(3, 40, 4000), (4, 2, 4000), (5, 2, 3)])
def test_jaccard(spark, seed, crowd, hot, monkeypatch):
    monkeypatch.setattr(ngramjoin, "PAIRS", crowd)  # 2: nearly all prefix shingles are crowded
    monkeypatch.setattr(ngramjoin, "CELL_SETS", 3 if crowd == 2 else 200)
    rows = corpus(seed)
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows)


def test_jaccard_of_odd_ids(spark):
    rows = corpus(6, 80)
    odd = with_odd_ids(rows, 6)
    want = linked([(k, t or "") for k, (_, t) in enumerate(odd)])
    least: dict = {}
    for k, (n, label) in want.items():
        if odd[k][0] is not None:
            least[label] = min(least.get(label, odd[k][0]), odd[k][0])
    got = ngramjoin.jaccard_components(spark.createDataFrame(odd, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(str((odd[k][0], n, least.get(label))) for k, (n, label) in want.items())


def test_a_crowd_of_near_copies_is_linear(spark, monkeypatch):
    staged, sizes = ngramjoin.staged, {}

    def counted(df, name):
        made = staged(df, name)
        sizes[name] = sizes.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(ngramjoin, "staged", counted)
    r, whole = random.Random(3), [f"w{k}" for k in range(150)]
    rows = []
    for k in range(3000):
        w = list(whole)
        w[r.randrange(150)] = f"v{k}"
        rows.append((k, " ".join(w)))
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["component_id"] for x in got} == {0}
    assert sizes["links"] <= 5 * 3000 and sizes.get("needed", 0) <= 2 * 3000


def test_a_crowd_that_cannot_link_makes_no_work(spark, monkeypatch):
    staged, sizes = ngramjoin.staged, {}

    def counted(df, name):
        made = staged(df, name)
        sizes[name] = sizes.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(ngramjoin, "staged", counted)
    form = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(form[:15] + [f"own{k}"] + form[16:])) for k in range(2000)]
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(k, k) for k in range(2000)}
    assert sizes["live"] == sizes["members"] == sizes.get("needed", 0) == 0


def test_phrases_that_many_texts_share_make_no_work(spark, monkeypatch):
    staged, sizes = ngramjoin.staged, {}

    def counted(df, name):
        out = staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngramjoin, "staged", counted)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 0)  # as where more shingles are frequent than are ranked
    monkeypatch.setattr(ngramjoin, "PAIRS", 10)
    monkeypatch.setattr(ngramjoin, "CELL_SETS", 10)
    r = random.Random(7)
    phrases = [" ".join(f"p{k}x{j}" for j in range(5)) for k in range(20)]
    rows = [(k, " ".join([f"u{k}x{j}" for j in range(r.randrange(50, 400))] + r.sample(phrases, 3))) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(10)]
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: k % 1000 for k, _ in rows}
    assert sizes["members"] <= 60 and sizes.get("needed", 0) <= 60


def test_wide_rows_join_past_a_bitmap(spark):
    big = spark.range(3000).select((F.col("id") % 2000).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("b"), F.lit("x").alias("text"))
    small = spark.range(0, 3000, 3).select(F.col("id").alias("a"), F.when(F.col("id") % 2 > 0, F.col("id") % 5).alias("b"), F.col("id").alias("c"))
    for on in (["a"], ["a", "b"]):
        for how, other in (("inner", small.select(*on, "c")), ("left_anti", small.select(*on))):
            got, right = join_wide(big, other, on, how, rows=10), big.join(other, on, how)
            assert got.columns == right.columns and sorted(map(str, got.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("seed, crowd, cell", [(1, 40, 20), (2, 3, 5), (3, 2, 200)])
def test_crowds_in_which_some_link(spark, monkeypatch, seed, crowd, cell):
    monkeypatch.setattr(ngramjoin, "PAIRS", crowd)
    monkeypatch.setattr(ngramjoin, "CELL_SETS", cell)
    r, rows = random.Random(seed), []
    form = [f"w{k}" for k in range(30)]
    for k in range(160):  # own words inside, before and after: sizes and places differ, some reach others by chains
        w = form[: r.choice([22, 26, 30, 30])] + [f"tail{r.randrange(4)}x{x}" for x in range(r.choice([0, 0, 3, 6, 9]))]
        if r.random() < 0.6:
            w[r.randrange(len(w))] = f"own{k}"
        rows.append((k, " ".join([f"head{r.randrange(3)}x{x}" for x in range(r.choice([0, 0, 2, 5]))] + w)))
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = linked(rows)
    assert 10 < len({label for _, label in want.values()}) < 150
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "u long, v long")
    for most in (1000, 5):  # at once, and by contraction
        got = {r["v"]: r["label"] for r in ngramjoin.components(links, most).collect()}
        assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}


def test_leaks(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)]
    docs, planted = [], set()
    for k in range(200):
        w = [word() for _ in range(r.randint(0, 200))]
        if k % 4 == 0:
            item, text = r.choice(items)
            leak = text.split()
            for at in range(5, 30, 9):
                if k % 8 == 0:
                    leak[at] = word()  # a substitution every nine words
            leak = [x.upper() + "," for x in leak] if k % 12 == 0 else leak
            w[len(w) // 2 : len(w) // 2] = leak
            planted.add((k, item))
        elif k % 4 == 1:
            w += r.choice(items)[1].split()[:8]  # too little to tell
        docs.append((k, " ".join(w)))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == planted
    text = dict(docs)
    for x in found:
        mine = [w.strip(",").lower() for w in text[x["doc_id"]].split()][x["start"] : x["start"] + x["n_tokens"]]
        assert x["n_equal"] >= 0.8 * x["n_tokens"] and len(mine) == x["n_tokens"]
    assert {r["doc_id"] for r in decontam.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()} == {d for d, _ in docs} - {d for d, _ in planted}


def best_run(equal, need):
    """(score in fifths, equal, length) of the best run of at least need tokens with at most 20 % different; by trying all."""
    runs = [(sum(equal[a:b]) * 5 - (b - a) * 4, a, b) for a in range(len(equal)) for b in range(a + need, len(equal) + 1)]
    return max((s for s, _, _ in runs if s >= 0), default=None)


def test_leaks_with_substitutions(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (4, 9, 10, 12, 13, *range(15, 21))]
    docs, names = [], []
    for n, text in items:
        for at in [None, *range(n)]:
            w = text.split()
            if at is not None:
                w[at] = "other"
            names.append((n, at))
            docs.append((len(docs), " ".join([f"b{k}" for k in range(7)] + w + [f"a{k}" for k in range(7)])))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    # one difference in ten tokens or more is within the rule at every place; shorter items stand exactly or not at all
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(d, n) for d, (n, at) in enumerate(names) if at is None or n >= 10}
    assert all(x["n_tokens"] >= min(13, x["n_item"]) and 5 * x["n_equal"] >= 4 * x["n_tokens"] for x in found)


def test_best_run_against_all_runs(spark):
    r = random.Random(9)
    rows = [(k, [None] * r.randint(0, 2) + [int(r.random() < r.choice((0.7, 0.85, 0.95))) for _ in range(r.randint(0, 40))] + [None] * r.randint(0, 2), r.choice((4, 10, 13))) for k in range(300)]
    sql = decontam._BEST_RUN.format(slack=200_000, one=decontam._ONE)
    got = spark.createDataFrame(rows, "k int, equal array<int>, need int").selectExpr("k", f"{sql} as run").collect()
    for x in got:
        _, equal, need = rows[x["k"]]
        run, best = x["run"], best_run([e for e in equal if e is not None], need)
        assert (run["n"] == 0) == (best is None)
        if best is not None:
            part = equal[run["at"] : run["at"] + run["n"]]
            assert len(part) == run["n"] >= need and sum(part) == run["equal"] and run["equal"] * 5 - run["n"] * 4 == best


def test_every_two_substitutions_leave_a_mask():
    assert all(any(m[a] == m[b] == "0" for m in decontam.MASKS) for a in range(decontam.SPAN) for b in range(decontam.SPAN))


def test_leaks_at_the_whole_tolerance_for_every_length(spark):
    """Items of 10 to 30 tokens with as many substitutions as one in five allows, against all placements tried one by one."""
    r = random.Random(12)
    items = [(n, " ".join(f"i{n}x{k % 7 if n % 5 == 0 else k}" for k in range(n))) for n in range(10, 31)]
    docs = []
    for n, text in items:
        for _ in range(12):
            w = text.split()
            for at in r.sample(range(n), n // 5 + r.choice([0, 0, 0, 2])):
                w[at] = f"other{r.randint(0, 3)}"
            docs.append((len(docs), " ".join([f"b{k}" for k in range(r.randint(0, 9))] + w + [f"a{k}" for k in range(r.randint(0, 9))])))

    def leaks(doc, item):
        need = min(13, len(item))
        for shift in range(1 - len(item), len(doc)):
            equal = [int(doc[k + shift] == item[k]) for k in range(len(item)) if 0 <= k + shift < len(doc)]
            if len(equal) >= need and best_run(equal, need) is not None:
                return True
        return False

    want = {(d, n) for d, text in docs for n, item in items if leaks(text.split(), item.split())}
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    assert found <= want and len(want) > 150
    for n, _ in items:
        own = {x for x in want if x[1] == n}
        assert len(own & found) >= 0.9 * len(own)
    assert len(found) >= 0.99 * len(want)


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "spam " * 20_000), (2, "spam " * 12)], "doc_id long, text string")
    found = decontam.find_leaks(docs, spark.createDataFrame([(1, "spam " * 30)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["start"], x["n_tokens"], x["n_equal"]) for x in found] == [(1, 0, 30, 30)]


def test_mix_tree(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 50), "ab"[k % 3 == 0]) for k in range(300)], "doc_id long, text string, source string")
    documents, pieces = mixing.mix_sources(docs, n_blocks=64, n_shards=8)
    again = mixing.mix_sources(docs, n_blocks=64, n_shards=8)[1]
    rows = sorted(map(tuple, pieces.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    size = {r["doc_id"]: r["size"] for r in documents.collect()}
    taken, spans = {}, set()
    for p in pieces.collect():
        assert 0 <= p["start"] and p["start"] + p["n_words"] <= size[p["doc_id"]] and 0 <= p["shard"] < 8
        for k in range(p["start"], p["start"] + p["n_words"]):
            assert (p["doc_id"], p["copy"], k) not in spans  # shards are disjoint within a pass
            spans.add((p["doc_id"], p["copy"], k))
        taken[p["rank"]] = taken.get(p["rank"], 0) + p["n_words"]
    for t in documents.select("rank", "target").distinct().collect():
        assert abs(taken[t["rank"]] - t["target"]) <= 0.5
    assert {p["shard"] for p in pieces.collect()} == set(range(8))
    texts = mixing.mixed_texts(docs, pieces).collect()
    assert sum(len(x["text"].split()) for x in texts) == sum(taken.values())


def test_quotas_are_split_without_remainder(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 0)], "rank int, n long")
    got = mixing.shard_quotas(quotas, 5).collect()
    for rank, n in ((1, 100), (2, 7), (3, 0)):
        assert sum(r["n"] for r in got if r["rank"] == rank) == n
    assert sorted(sum(r["n"] for r in got if r["shard"] == s) for s in range(5))[0] >= 20


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    found = []
    for nth, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), nth, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_pii_against_brute_force(spark):
    r = random.Random(9)
    parts = ["a.b@c.d", "x@y", "a@b.c_d@e.f.g", "@", "+1 (569) 555-9473", "+12", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111111111", "4111111111111112", "5 4111111111111111", "é😀", "-", ".", " ", "+", "49927398716", "9" * 30, "\n", "1", "0.0.0.0"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "", "x"]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_pii(df).select("doc_id", pii.listed(pii.F.col("spans"), pii.BASE).alias("s")).collect()
    assert {x["doc_id"]: x["s"] for x in got} == {k: base_spans(t) for k, t in enumerate(texts)}


def test_pii_adds_by_checksum_and_context(spark):
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32.", "code GB82WEST12345698765433.", "my ssn 123-45-6789 is", "part 123-45-6789 is", "call 555-123-4567 now", "see 555-123-4567 now", "call +1 555-123-4567 now"]
    got = [[s["kind"] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["iban"], [], ["ssn"], [], ["tel"], [], ["phone"]]


def test_ibans_among_words_in_capitals(spark):
    gb, no, be = "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "BE68 5390 0754 7034"
    cases = [(f"IBAN {gb} BIC NWBKGB2L", [gb]), (f"{gb} EUR 100", [gb]), (f"{gb} 250.00", [gb]), (f"IBAN {gb}", [gb]), (f"{no} {be} EUR", [no, be]), (f"REF AB12 {gb} PAY", [gb]), (f"{gb}9 BIC", []), (f"{gb.replace('82', '83')} BIC NWBKGB2L", []), (f"é {be} I {no}", [be, no])]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text, ibans = cases[r["doc_id"]]
        assert [s["value"] for s in r["spans"] if s["kind"] == "iban"] == ibans
        assert all(text[s["start"] : s["end"]] == s["value"] for s in r["spans"])
    assert pii.redact(df).where("doc_id = 0").first()["text"] == "IBAN <IBAN> BIC NWBKGB2L"


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.c, 1.2.3.4!", 17), (2, None, None), (3, "none", 4)], "doc_id long, text string, n_chars long")
    assert [(r["text"], r["n_chars"]) for r in pii.redact(df).orderBy("doc_id").collect()] == [("é <EMAIL>, <IP>!", 16), (None, None), ("none", 4)]


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.1, (700, 24)) + r.normal(0, 0.3, (700, 1))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(q["query_id"], q["rank"]): (q["vec_id"], q["score"]) for q in vectors.top_k(df, df.where("vec_id % 50 = 0"), wave=6).collect()}
    whole = np.floor(x * 256).astype(int)
    for q in range(0, 700, 50):
        best = sorted((-int(whole[q] @ whole[k]), k) for k in range(700) if k != q)[:5]
        assert [got[(q, n)] for n in range(1, 6)] == [(k, -s) for s, k in best]


def test_bounds_hold_and_prune():
    r = np.random.default_rng(4)
    x = np.floor(r.normal(0, 30, (300, 64)) + r.normal(0, 60, (300, 1)))
    exact = x @ x.T
    for level in vectors.LEVELS:
        s = vectors.statistics(x, level)
        assert (s @ s.T >= exact - 1e-6 * np.abs(exact) - 1e-6).all()
    best = vectors.Best(np.arange(10), x[:10], 5)
    best.offer(np.arange(300), x)
    best.offer(np.arange(300, 600), x * 0.1)
    assert best.exact < 10 * 300 * 1.5


def test_blocks():
    page = "<nav><li><a href=x>m</a></nav><article><h1>T &amp; U</h1><p><b>one<br><p>two  three<script>x</p></script> four</article><!-- <p>no</p> --><p>end"
    assert [b.text for b in htmlblocks.leaf_blocks(page)] == ["m", "T & U", "one", "two three four", "end"]
    assert htmlblocks.leaf_blocks("<p>a<p>b")[1].names == {"p"}


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<a title=it's href=x>Bob's book</a> See now.", ["Bob's book See now."]),
        ("<p data-x=5' >Hello", ["Hello"]),
        ('<p title="a>b">t', ["t"]),
        ('x <a href="never closed>text</a> more', ["x text more"]),
        ("a < b <3 <p>x<!--> y <!-- z --> w</p>", ["a < b <3", "x y w"]),
        ("cut <a href='x", ["cut"]),
        ("<?php x ?>a</ b>c<!DOCTYPE x>d", ["acd"]),
        ("<p a=1/>one<br/>two<p =x=y>three", ["one two", "three"]),
    ],
)
def test_tags_as_the_standard_reads_them(page, texts):
    assert [b.text for b in htmlblocks.leaf_blocks(page)] == texts


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="' * 160_000, "<!--" * 250_000, "<div class=c>" * 60_000 + "x", "<b>" * 100_000 + "<p>z" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    htmlblocks.leaf_blocks(page, lambda mark: False)
    assert time.process_time() - began < 5


def test_page_ids_stay_exact(spark):
    pages = spark.createDataFrame([(9007199254740993, "u", "<p>x"), (None, "u", "<p>y")], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in htmlmain.extract_main(pages).collect()} == {9007199254740993, None}


def test_crowded_parts_go_on_in_order(spark):
    rows = [(1, 0, "ab"[k % 2], f"m{k:02d}") for k in range(20)] + [(1, 0, "a", "m04")] * 3 + [(2, 0, "a b", "x"), (2, 0, "a_b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = [r for r in chat.rotate_perspectives(df, part_messages=10).collect() if r["perspective"] == "a"]
    made = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["sub"])
    assert [r["n_messages"] for r in made] == [10, 10, 3]
    assert re.findall(r"m\d\d", "".join(r["text"] for r in made)) == [t for _, _, _, t in sorted(rows[:23], key=lambda x: (x[2], x[3]))]
    both = "".join(r["text"] for r in chat.rotate_perspectives(df.where("conv_id = 2")).collect())
    assert "user name=a%20b\n" in both and "user name=a_b\n" in both


@pytest.mark.parametrize("wrong", [3, 4, 6])
def test_leaks_within_the_tolerance_are_found(spark, wrong):
    """Items of 30 tokens with 10, 13 and 20 % substitutions at random places."""
    r = random.Random(wrong)
    items = [(k, " ".join(f"i{k}x{n}" for n in range(30))) for k in range(100)]
    docs = []
    for k, text in items:
        w = text.split()
        for at in r.sample(range(30), wrong):
            w[at] = "other"
        docs.append((k, " ".join([f"b{n}" for n in range(9)] + w + [f"a{n}" for n in range(9)])))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(x["doc_id"] == x["item_id"] for x in found) >= 90

@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>t</title><body><p>one<p>two", ["one", "two"]),
        ("<head><meta charset=x><link href=y><style>p{}</style><script>a</script><p>one", ["one"]),
        ("<head><noscript><link href=y><img src=z></noscript><title>t</title><h1>one</h1>", ["one"]),
        ("<head><noscript><p>hid<body><p>one", ["one"]),
        ("<head><title>t</title>\n bare text<p>one", ["bare text", "one"]),
        ("<head><title>t</title></head><body><p>one", ["one"]),
        ("<head><title>t</title><img src=x>after", ["after"]),
        ("<p>where <math display=block><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds<p>end", ["where x=2 holds", "end"]),
    ],
)
def test_blocks_of_open_heads_and_formulae(page, texts):
    assert [b.text for b in htmlblocks.leaf_blocks(page)] == texts


def test_field_on_held_out_pages():
    field = htmlmain.model()
    wrong = total = 0
    for blocks, labels in htmlmain.labelled_pages(200, 77):
        if blocks:
            made = field.decode(htmlmain.features(blocks))
            wrong += sum(a != b for a, b in zip(made, labels))
            total += len(labels)
    assert wrong < 0.01 * total


def test_decoding_is_the_best_path():
    r = np.random.default_rng(1)
    index = {f"f{k}": k for k in range(6)}
    field = htmlmain.Field(index, r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for _ in range(20):
        fs = [[f"f{k}" for k in r.integers(0, 6, 2)] for _ in range(6)]
        e = field.scores(fs)
        value = lambda y: field.s[y[0]] + sum(e[i, y[i]] for i in range(6)) + sum(field.t[y[i], y[i + 1]] for i in range(5))
        best = max(([(k >> i) & 1 for i in range(6)] for k in range(64)), key=value)
        assert value(field.decode(fs)) == pytest.approx(value(best))


def test_accuracies_are_recovered():
    r = np.random.default_rng(2)
    bad = r.random(20_000) < 0.25
    which = r.integers(0, 3, 20_000)
    votes = np.stack([-(bad & (which == j) & (r.random(20_000) < 0.9)).astype(int) for j in range(3)] + [np.where(bad, r.random(20_000) < 0.4, r.random(20_000) < 0.95).astype(int)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, good, chance = quality.accuracies(patterns, counts.astype(float))
    assert abs(good - 0.75) < 0.2
    said = {tuple(p): q for p, q in zip(patterns.tolist(), post)}
    assert all(q < 0.5 for p, q in said.items() if -1 in p[:3])


def test_quality_on_held_out_documents(spark):
    r = random.Random(6)
    clean = lambda n: " ".join("".join(r.choice("abcdeghijkmnp") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.1 else "") for _ in range(n)) + "."
    rows, good = [], {}
    for k in range(600):
        text, kind = clean(r.randint(20, 120)), k % 10
        if kind == 0:
            text = text.upper()
        elif kind == 1:
            text = text.replace(" ", " | ")
        elif kind == 2:
            text = "blah " * 60
        elif kind == 3:
            text = text.replace(" ", r.choice([" idiot ", " krzz "]), 2)
        rows.append((k, text))
        good[k] = kind > 3
    labels = spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(0, 600) if k < 400], "doc_id long, toxic int")
    got = {x["doc_id"]: x["keep"] for x in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    late = [k for k in range(400, 600)]
    assert sum(got[k] for k in late if good[k]) >= 0.98 * sum(good[k] for k in late)
    assert sum(not got[k] for k in late if not good[k]) >= 0.9 * sum(not good[k] for k in late)


SAID = "The committee met on Monday and after a long debate it agreed that the old bridge should be built again next year."
TWO = f"{SAID} {SAID}"
#: Pages of other hands than the writer of training pages, and their main text.
LAYOUTS = {
    "text with br in an article": (f"<article>{TWO} {SAID}<br><br>{SAID}</article>", f"{TWO} {TWO}"),
    "text in main": (f"<main>{TWO} {SAID}</main>", f"{TWO} {SAID}"),
    "text in a div": (f"<div class=content>{TWO} {TWO} {TWO}</div>", f"{TWO} {TWO} {TWO}"),
    "text in the body": (f"<body>{TWO}</body>", TWO),
    "no tags": (TWO, TWO),
    "one sentence": (f"<div class=content><p>{SAID}</p></div>", SAID),
    "one short sentence": ("<article><p>Bridge built.</p></article>", "Bridge built."),
    "a paragraph alone": (f"<p>{SAID}</p>", SAID),
    "divs for paragraphs": (f"<div class=content><h1>Bridge</h1><div>{TWO}</div></div>", f"Bridge\n{TWO}"),
    "divs without marks": (f"<div><div><div>{SAID}</div><div>{SAID}</div></div></div>", f"{SAID}\n{SAID}"),
    "linked sources": (f"<article><h1>Bridge</h1><p>{TWO}</p><h2>Sources</h2><ul><li><a href=/a>City records of the bridge</a></li><li><a href=/b>The Daily News</a></li></ul></article>", f"Bridge\n{TWO}\nSources\nCity records of the bridge\nThe Daily News"),
    "comments in main": (f"<main><h1>Bridge</h1><p>{TWO}</p><h2>2 comments</h2><div class=comments><div class=comment><p>Nice one.</p></div><div class=comment><p>I do not agree with this at all.</p></div></div></main>", f"Bridge\n{TWO}"),
    "a comment in a list": (f"<main><h1>Bridge</h1><p>{TWO}</p><p>2 comments</p><ul class=comments><li>Nice one.</li></ul></main>", f"Bridge\n{TWO}"),
    "menu and footer": (f"<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class=content>{TWO}</div><footer>&copy; 2024 x</footer>", TWO),
    "text between marked divs": (f"<div class=nav><a href=/>Home</a> <a href=/n>News</a></div>{TWO}<div class=footer>Contact us</div>", TWO),
    "advert inside": (f"<article><p>{SAID}</p><div class=ad>Buy now the best things.</div><p>{SAID}</p></article><aside><h4>More</h4><ul><li><a href=/a>Another story of the town</a></ul></aside>", f"{SAID}\n{SAID}"),
    "advert in a line of its own": (f"<article><p>{SAID}</p><ins class=adsbox>Buy now the best things.</ins><p>{SAID}</p></article>", f"{SAID}\n{SAID}"),
    "a reference around a tag": ("<article><p>AT&am<b>p;</b>T is a phone company, and AT&amp;T is old.</p></article>", "AT&amp;T is a phone company, and AT&T is old."),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_main_text_of_layouts(name):
    page, want = LAYOUTS[name]
    assert htmlmain.main_text(htmlmain.model(), page) == want


def test_main_text_of_given_pages(spark):
    """All blocks of the article of each given page, and nothing else, by a search for the element itself."""
    import re

    sf = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in htmlmain.op10_extract_main(spark, sf).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", html[r["page_id"]])
        assert r["text"] == ("\n".join(b.text for b in htmlblocks.leaf_blocks(article[1])) if article else "")
