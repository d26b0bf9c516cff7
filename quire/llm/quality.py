"""Quality classifier: a weak-label model over overlapping heuristic labellers, then a hashed linear scorer.

1. Labellers vote on each whole text: 1 good, -1 bad, 0 no opinion.
2. Expectation-maximisation over the counts of vote patterns (all documents; at most 3^labellers patterns, however many
   documents) estimates the share of good documents and each labeller's accuracy and propensity in either class.
3. The posterior of each pattern labels a bounded sample of documents (SAMPLE rows by digest, the documented bound); a
   logistic regression over hashed features is trained on it, weighted by the posterior.
4. The scorer runs over every whole text, batch by batch, without a shuffle. A document is kept when its score reaches
   KEEP.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words that abuse; a labeller counts them, the scorer learns more.
ABUSE = """loser idiot pathetic scum worthless moron trash clown disgusting stupid dumb imbecile filthy vermin garbage bastard
jerk fool freak creep coward ugly retard bitch whore slut fuck fucking shit asshole crap dickhead cunt nazi""".split()
SAMPLE = 8_000
#: Bound of the labelled rows from which terms are mined, and of the terms; least share of toxic documents that a term is in.
LABELLED, TERMS, SUPPORT, PRECISION = 8_000, 400, 0.01, 0.95
BITS = 16
KEEP = 0.35
#: Lengths of the beginnings of words that are mined.
BEGINNINGS = (4, 5)
EM_ROUNDS = 60
EPOCHS = 5
#: Most of the good documents that a labeller speaks against, least of the cases of its own reason that it
#: finds, least of the bad documents that one speaks for, share of good documents to begin with.
FALSE_ALARM, HIT, SLIP, GOOD = 0.0005, 0.95, 0.3, 0.8


def _longer(n: int):
    return lambda w: F.length(w) > n


def _beginning(n: int):
    return lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*"))


def _share(share: float) -> int:
    """The digests of 63 bits up to this one are a share of all."""
    return 2**63 - 1 if share >= 1 else int(share * 2**62) * 2


def mined_terms(docs: DataFrame, labels: DataFrame | None, sample: int = LABELLED, most: int = TERMS) -> list[str]:
    """Words and beginnings of words (4 or 5 letters and *) that mark documents labelled toxic.

    Counted over the texts (of toxic ones the distinct) of about `sample` labelled rows (doc_id, toxic), the documented bound. A term must
    stand in SUPPORT of the toxic ones and four of them at least, and in PRECISION times as many toxic ones as all.
    """
    if labels is None:
        return []
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    share = min(1.0, sample / max(1, known.count()))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    known = known.where(drawn <= _share(share)).orderBy(drawn, "doc_id", "toxic").limit(2 * sample)
    texts = docs.join(F.broadcast(known), "doc_id").select("text", F.col("toxic") > 0).toDF("text", "toxic")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
    begins = [F.transform(F.filter(words, _longer(n + 1)), _beginning(n)) for n in BEGINNINGS]
    terms_of = F.explode(F.array_distinct(F.concat(words, *begins))).alias("term")
    toxic = texts.where("toxic").dropDuplicates(["text"])
    n_toxic = toxic.count()
    often = toxic.select(terms_of).groupBy("term").agg(F.count("*").alias("toxic")).where(F.col("toxic") >= max(4, SUPPORT * n_toxic))
    often = often.orderBy(F.desc("toxic"), "term").limit(100 * most)  # those that can be among the best
    clean = texts.where("not toxic").select(terms_of).join(F.broadcast(often.select("term")), "term").groupBy("term").agg(F.count("*").alias("clean"))
    counted = often.join(clean, "term", "left").where(F.col("toxic") >= PRECISION * (F.col("toxic") + F.coalesce("clean", F.lit(0))))
    best = counted.orderBy(F.desc("toxic"), F.length("term"), "term").limit(most).collect()
    terms: list[str] = []
    for r in best:
        if not any(t.endswith("*") and r["term"].startswith(t[:-1]) for t in terms):
            terms.append(r["term"])
    return terms


SIGNALS = ["n_words", "abuse", "bars", "marks", "capitals", "letters", "stops", "again"]
_ENDS = re.compile(r"[!?#$%&*@^~=]{2,}(?!\S)").findall
_LETTERS = re.compile(r"[^\W\d_]+").findall


class Reader:
    """Signals and hashed words of texts; keeps nothing from one text to the next."""

    def __init__(self, terms: list[str], bits: int):
        import xxhash

        self.hash, self.mask = xxhash.xxh32_intdigest, (1 << bits) - 1
        self.whole = {*ABUSE, *(t for t in terms if not t.endswith("*"))}
        self.begins = {n: {t[:n] for t in terms if t.endswith("*") and len(t) == n + 1} for n in BEGINNINGS}

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(signals, distinct slots of the words) of a whole text. Shares are of the words between white space; abuse counts
        different words. Words are runs of letters, in lower case."""
        text = text or ""
        parts = text.split()
        bare = _LETTERS(text.lower())
        found, mask, digest = set(bare), self.mask, self.hash
        abuse = len(found & self.whole) + sum(w[:n] in b for n, b in self.begins.items() if b for w in found if len(w) > n + 1)
        share = 1 / max(1, len(parts))
        stops = sum(text.count(m + gap) for m in ".!?" for gap in " \n") + text.endswith((".", "!", "?"))
        shares = [text.count("|"), len(_ENDS(text)), sum(map(str.isupper, parts)), len(bare), stops, sum(map(eq, parts, parts[1:]))]
        return np.array([len(parts), abuse, *(min(1.0, x * share) for x in shares)]), np.unique(np.array([digest(w) & mask for w in found], dtype=np.int64))


#: What the labellers look at; each says bad (-1), good (1) or nothing (0). A document is bad for one reason and fine in all
#: other respects, so a labeller that finds nothing has no opinion; only whole sentences speak for a document.
LABELLERS = {
    "abuse": lambda s: -(s["abuse"] >= 1),
    "repeats": lambda s: -(s["again"] > 0.2),
    "bars": lambda s: -(s["bars"] > 0.2),
    "marks": lambda s: -(s["marks"] > 0.2),
    "capitals": lambda s: -(s["capitals"] > 0.4),
    "letters": lambda s: -(s["letters"] < 0.5 and s["n_words"] > 0),
    "unbroken": lambda s: -(s["stops"] == 0 and s["n_words"] > 200),
    "sentences": lambda s: int(s["stops"] > 0.02),
}


def votes(signals: np.ndarray) -> tuple[int, ...]:
    row = dict(zip(SIGNALS, signals.tolist(), strict=True))
    return tuple(int(f(row)) for f in LABELLERS.values())


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good for each pattern, share of good, chance[labeller, class, vote + 1]) by expectation-maximisation.

    Class 0 is good; class 1 + j is bad for the reason that labeller j looks for. Votes are independent given the class, so
    overlaps of labellers tell their accuracies apart. Without constraints silent documents could be called bad at will:
    a labeller finds its own reason in at least HIT of the cases, speaks against at most FALSE_ALARM of the good documents,
    and one that speaks for documents does so for at least SLIP of the bad ones. All else is estimated.
    """
    n, k = patterns.shape
    speaks_for = [j for j in range(k) if n and patterns[:, j].max() > 0]
    reasons = [j for j in range(k) if j not in speaks_for]
    chance = np.tile(np.array([0.05, 0.95, 1e-6]), (k, 1 + len(reasons), 1))
    chance[speaks_for] = [1e-6, 1 - SLIP, SLIP]
    chance[speaks_for, 0] = [1e-6, 0.2, 0.8]
    for c, j in enumerate(reasons, 1):
        chance[j, 0] = [FALSE_ALARM, 1 - FALSE_ALARM, 1e-6]
        chance[j, c] = [HIT, 1 - HIT, 1e-6]
    share = np.array([GOOD, *[(1 - GOOD) / max(1, len(reasons))] * len(reasons)])
    votes, total = patterns + 1, max(counts.sum(), 1e-9)
    post = np.full((n, len(share)), GOOD)
    for _ in range(rounds):
        like = np.log(share)[None, :] + sum(np.log(chance[j][:, votes[:, j]] + 1e-9).T for j in range(k))
        post = np.exp(like - like.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = counts[:, None] * post
        for j in range(k):
            for c in range(len(share)):
                made = np.bincount(votes[:, j], weights=weight[:, c], minlength=3) + 1e-3
                made /= made.sum()
                if j in speaks_for and c:
                    made[2] = max(made[2], SLIP)
                elif j not in speaks_for and c == 0:
                    made[0] = min(made[0], FALSE_ALARM)
                elif c and reasons[c - 1] == j:
                    made[0] = max(made[0], HIT)
                    made[1] = min(made[1], 1 - HIT)
                chance[j, c] = made / made.sum()
        share = np.maximum(weight.sum(axis=0) / total, 1e-6)
        share /= share.sum()
    return post[:, 0], float(share[0]), chance


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression with soft targets, by Adagrad; the classes weigh the same. rows: (slots, values)."""
    w, b = np.zeros(1 << bits), 0.0
    g, gb = np.full(1 << bits, 0.1), 0.1
    share = float(np.clip(target.mean(), 0.02, 0.98)) if len(target) else 0.5
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ value + b, -30, 30)))
            d = (target[k] - p) * (0.5 / share if target[k] > 0.5 else 0.5 / (1 - share))
            step = d * value - decay * w[at]
            g[at] += step**2
            w[at] += rate / np.sqrt(g[at]) * step
            gb += d * d
            b += rate / np.sqrt(gb) * d
    return w.astype(np.float32), float(b)


def features(signals: np.ndarray, slots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document: its signals in steps (value 1) and its words (together a vector of length 1)."""
    import xxhash

    steps = [f"{k} {min(6, int(np.log2(v + 1))) if k in ('n_words', 'abuse') else int(min(1.0, v) * 10 + 0.5)}" for k, v in zip(SIGNALS, signals.tolist(), strict=True)]
    own = [xxhash.xxh3_64_intdigest(x) & ((1 << bits) - 1) for x in steps]
    at = np.concatenate([np.array(own, dtype=np.int64), slots])
    return at, _values(at)


def _values(at: np.ndarray) -> np.ndarray:
    n = len(SIGNALS)
    return np.concatenate([np.ones(n), np.full(len(at) - n, 1 / np.sqrt(max(1, len(at) - n)))])


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, bits: int = BITS) -> dict:
    """The model: share of good documents, accuracies of the labellers, weights of the scorer.

    Vote patterns are counted over all of docs (doc_id, text). About `sample` documents, the least by a digest
    of doc_id and text, train the scorer; only their hashed features reach the driver. labels (doc_id, toxic) add terms of abuse to one labeller.
    An empty table gives a model that keeps everything.
    """
    terms, names = mined_terms(docs, labels), list(LABELLERS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(terms, bits), Counter()
        for pdf in batches:
            seen.update(votes(reader.read(t)[0]) for t in pdf["text"])
        if seen:
            yield pd.DataFrame({"votes": [",".join(map(str, v)) for v in seen], "n": list(seen.values())})

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(terms, bits)
        for pdf in batches:
            read = [reader.read(t) for t in pdf["text"]]
            packed = [features(*r, bits)[0].astype(np.int32).tobytes() for r in read]
            yield pd.DataFrame({"drawn": pdf["drawn"], "votes": [",".join(map(str, votes(s))) for s, _ in read], "at": packed})

    counted = docs.select("text").mapInPandas(count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in counted], dtype=np.int64).reshape(-1, len(names))
    counts = np.array([r["n"] for r in counted], dtype=float)
    post, good, chance = accuracies(patterns, counts)
    share = min(1.0, sample / max(1.0, counts.sum()))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    chosen = docs.select(drawn.alias("drawn"), "text").where(F.col("drawn") <= _share(share))
    rows = chosen.mapInPandas(sampled, "drawn long, votes string, at binary").orderBy("drawn", "at").limit(2 * sample).collect()
    if counted and not rows:
        raise ValueError("no document was drawn to train on")
    by_pattern = dict(zip((r["votes"] for r in counted), post.tolist(), strict=True))
    target = np.array([by_pattern[r["votes"]] for r in rows])
    slots = [np.frombuffer(r["at"], np.int32) for r in rows]
    w, b = train([(at, _values(at)) for at in slots], target, bits)
    return {"terms": terms, "w": w, "b": b, "bits": bits, "good": good, "chance": dict(zip(names, chance.tolist(), strict=True))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score`: the scorer's chance that the document is good, over its whole text."""
    terms, b, bits = model["terms"], model["b"], model["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(model["w"])

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, reader = sent.value, Reader(terms, bits)
        for texts in batches:
            z = []
            for t in texts:
                at, value = features(*reader.read(t), bits)
                z.append(w[at] @ value + b)
            yield pd.Series(np.round(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))), 6))

    return docs.withColumn("score", scorer("text"))


def judge_quality(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None, keep: float = KEEP) -> DataFrame:
    """docs with score and keep (score >= `keep`).

    Null texts count as empty; a document without words is judged by its signals like any other. Repeated rows get equal
    scores. Columns of docs named score or keep are replaced, all others stay. Empty in, empty out.
    """
    return score(docs, model or fit(docs, labels)).withColumn("keep", F.col("score") >= keep)


def op6_judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "score", "keep")
