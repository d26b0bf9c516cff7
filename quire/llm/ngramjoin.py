"""N-gram Jaccard join by grouped prefixes, down to connected components.

A document's set holds its distinct shingles of N words. Two sets link when 100 * intersection >= T * union. All sets are
ordered alike: rare shingles by hash, then frequent ones from less to more frequent. Linked sets share a shingle within
their prefixes of n - ceil(T n / 100) + 1 shingles, so

1. documents with equal prefix and size become one group, and only groups are joined on prefix shingles, by shards of
   the shingle's hash;
2. a pair of groups survives if one of its shared prefix shingles may be its first: what lies from its place on in both
   sets must reach the overlap that a link needs. So must all shared prefix shingles with what may follow the prefixes. A
   prefix shingle with more than PAIRS groups makes no pairs: its groups are a crowd. A member of a crowd stays only if some
   member has a size that its place still allows, and that the prefix shingles which it shares with anyone allow, and the
   other way round, so a crowd that can't link makes no work;
3. surviving groups and crowds expand to their distinct sets (equal sets are one class). Classes get a label, that of
   their largest crowd or of their least relative, and a cell of at most CELL_SETS sets of that label. Within its cell each
   set is verified against all others, and against a few pivots of its label, which join most of a crowd;
4. only where a pair or a crowd still lies in several cells and in several components, a crowd that fits into a cell is
   verified there; else the sets outside its largest component are verified against all of it, block by block, where sizes
   and places of the blocks allow a link. So near
   copies of one text cost work in proportion to their number, and no link between different components is left out;
5. links become components by contraction.

Which shingles count as frequent changes the order only, never the result: each task reports its most frequent ones, and
the sums rank them. Any shingle may be treated as a crowd, so the hottest ones never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, join_counted, join_wide, staged, table
from .lanes import Line, by_shard, lines, rolled, text_bytes

N = 5
T = 75
PAIRS = 40
#: Documents from which on a shingle is a crowd at once.
HOT = 4_000
CELL_SETS = 200
CELL_SHINGLES = 500_000
#: Bands of size for each factor of e, in which blocks are dealt, and in which the members of a crowd are compared.
BANDS, CROWD_BANDS = 10, 40
#: Random pivots of a label, besides its most typical set.
PIVOTS = 5
SHARD_ROWS = 500_000
LEAST_SHARDS = 48
#: Frequent shingles that a task reports and that are ranked in all (16 bytes each); shingles that a task counts at a time.
TASK_FREQUENT, FREQUENT, COUNTED = 60_000, 400_000, 2_000_000
#: Links that one task solves at once; beyond that they are contracted first.
SOLVED = 500_000
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max


def prefix_size(n, t: int = T):
    return n + (-t * n) // 100 + 1


def furthest(n, at, t: int = T):
    """The largest set with which one of n shingles can link if its first shared one lies at place `at` of its order."""
    return (100 + t) * (n - at) // t - n


def sets_of(words: Line, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingles of each document; fewer than n words make one."""
    every, out = rolled(words.ids, n, 0), []
    for a, b in zip(words.cuts[:-1].tolist(), words.cuts[1:].tolist(), strict=True):
        if b - a < n:
            out.append(rolled(words.ids[a:b], b - a, 0) + np.uint64(b - a) if b > a else every[:0])
            continue
        own = np.sort(every[a : b - n + 1])
        new = own[1:] != own[:-1]
        out.append(own if new.all() else own[np.concatenate([[True], new])])
    return out


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, t: int = T) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles of a set in the common order, place in `frequent` of each, -1 for rare ones). frequent: sorted;
    rank: of each of them."""
    p = prefix_size(len(own), t)
    if not len(frequent):
        return own[:p], np.full(min(p, len(own)), -1)
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    often = frequent[at] == own
    rare = own[~often][:p]
    late = at[often]
    late = late[np.argsort(rank[late])][: p - len(rare)]
    return np.concatenate([rare, frequent[late]]), np.concatenate([np.full(len(rare), -1), late])


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent shingles of a task, and in how many documents; equal sets that come close together count once."""
    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    seen: set[int] = set()

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, count = np.unique(np.concatenate(waiting), return_counts=True)
        both, back = np.unique(np.concatenate([h, new[count > 1]]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([n, count[count > 1]]), len(both)).astype(np.int64)
        best = np.sort(np.argsort(-sums, kind="stable")[:TASK_FREQUENT])
        return both[best], sums[best]

    size = 0
    for batch in batches:
        for words in lines(*text_bytes(batch.column(0)), fold=True):
            for own in sets_of(words):
                digest = xxhash.xxh3_64_intdigest(own)
                if len(own) and digest not in seen:
                    seen.add(digest)
                    waiting.append(own)
                    size += len(own)
            if size > COUNTED:
                h, n = merged()
                waiting.clear()
                seen.clear()
                size = 0
    if waiting:
        h, n = merged()
    yield _batch(["h", "n"], h.view(np.int64), n)


_DOCS, _TOKENS, _CROWD = 2, 1, 0
_PACKED = "kind int, shard long, n long, data binary"


def _prefixes(sent, shards: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents, and the prefix shingles of their groups, packed by shard; a group goes out once for each of the parts
        in which a task packs. Shingles of `hot` documents are dealt by group."""
        frequent, rank, count = sent.value
        docs, tokens, crowd, sizes, seen = [], [], [], 0, set()

        def packed() -> pa.RecordBatch:
            rows = []
            d = np.array(docs, dtype=np.int64)
            for shard, i in by_shard(np.arange(len(d), dtype=np.uint64) << np.uint64(20), shards):
                rows.append((_DOCS, shard, len(i), d[i].tobytes()))
            for kind, found in ((_TOKENS, tokens), (_CROWD, crowd)):
                if found:
                    t = np.concatenate([x[0] for x in found])
                    g = np.repeat(np.array([x[1] for x in found], np.int64), [len(x[0]) for x in found])
                    n = np.repeat(np.array([x[2] for x in found], np.uint32), [len(x[0]) for x in found])
                    p = np.concatenate([x[3] for x in found]).astype(np.uint32)
                    m = np.concatenate([x[4] for x in found]) if kind == _CROWD else None
                    for shard, i in by_shard(t if kind == _TOKENS else g.view(np.uint64), shards):
                        rows.append((kind, shard, len(i), t[i].tobytes() + g[i].tobytes() + n[i].tobytes() + p[i].tobytes() + (m[i].tobytes() if kind == _CROWD else b"")))
            for x in (docs, tokens, crowd, seen):
                x.clear()
            kinds, dealt, n, data = zip(*rows, strict=True)
            return _batch(["kind", "shard", "n", "data"], np.array(kinds, np.int32), np.array(dealt, np.int64), np.array(n, np.int64), pa.array(data, pa.binary()))

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for words in lines(*text_bytes(batch.column(2)), fold=True):
                for k, own in enumerate(sets_of(words), words.first):
                    if not len(own):
                        docs.append((ids[k], keys[k], 0, 0, 0, 0))
                        continue
                    first, at = prefix(own, frequent, rank)
                    group = xxhash.xxh3_64_intdigest(first, seed=len(own))
                    digest = xxhash.xxh3_128_intdigest(own)
                    docs.append((ids[k], keys[k], len(own), *np.array([digest >> 64, digest & (2**64 - 1), group], np.uint64).view(np.int64).tolist()))
                    if group not in seen:
                        seen.add(group)
                        signed = docs[-1][-1]
                        many = np.zeros(len(first), bool) if not len(count) else (at >= 0) & (count[at] >= hot)
                        place = np.arange(len(first))
                        tokens.append((first[~many], signed, len(own), place[~many]))
                        if many.any():
                            crowd.append((first[many], signed, len(own), place[many], count[at[many]]))
                        sizes += len(first)
                if sizes > SHARD_ROWS or len(docs) > SHARD_ROWS:
                    yield packed()
                    sizes = 0
        if docs:
            yield packed()

    return run


_JOINED = ["kind", "a", "b", "c", "d", "e", "f"]


def _rows(kind: int, *columns) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_JOINED, (kind, *columns), strict=False))).reindex(columns=_JOINED, fill_value=0)


def _unpacked(pdf: pd.DataFrame, *kinds) -> list[np.ndarray]:
    """Columns that were packed one after the other, each row's k values of each kind."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for k, data in zip(pdf["n"].tolist(), pdf["data"], strict=True):
        at = 0
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(data, kind, k, at))
            at += k * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal keys, in the order of the keys (the last key counts most)."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order[new]


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: groups of shingles that too many share (kind 0: shingle, number of its groups, group, size, furthest
    size), pairs of groups with the number of prefix shingles that they share (kind 1: a, b, sizes of both, shared, whether
    one of them may be the first), and its documents (kind 2: doc_id, key, size, both halves of the digest, group)."""
    docs = np.frombuffer(b"".join(pdf["data"][pdf["kind"] == _DOCS]), np.int64).reshape(-1, 6)
    rows = [_rows(_DOCS, *docs.T)]
    t, g, n, p, m = _unpacked(pdf[pdf["kind"] == _CROWD], np.int64, np.int64, np.uint32, np.uint32, np.int64)
    one = _distinct(t, g)
    n, p = n[one].astype(np.int64), p[one].astype(np.int64)
    rows.append(_rows(_CROWD, t[one], m[one], g[one], n, furthest(n, p)))
    t, g, n, p = _unpacked(pdf[pdf["kind"] == _TOKENS], np.int64, np.int64, np.uint32, np.uint32)
    one = _distinct(g, t)
    t, g, n, p = t[one], g[one], n[one].astype(np.int64), p[one].astype(np.int64)
    far = furthest(n, p)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
    size = np.diff(begin, append=len(t))
    crowded = np.repeat(size > PAIRS, size)
    rows.append(_rows(_CROWD, t[crowded], np.repeat(size, size)[crowded], g[crowded], n[crowded], far[crowded]))
    left, right = [], []
    for k in range(2, PAIRS + 1):
        at = begin[size == k]
        if len(at):
            i, j = np.triu_indices(k, 1)
            left.append((at[:, None] + i[None, :]).ravel())
            right.append((at[:, None] + j[None, :]).ravel())
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        fits = (100 * n[x] >= T * n[y]) & (100 * n[y] >= T * n[x])
        x, y = x[fits], y[fits]
        order = np.lexsort((g[y], g[x]))
        x, y = x[order], y[order]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (g[x][1:] != g[x][:-1]) | (g[y][1:] != g[y][:-1])]))
        if len(at):
            first = np.logical_or.reduceat((n[y] <= far[x]) & (n[x] <= far[y]), at).astype(np.int64)
            rows.append(_rows(_TOKENS, g[x[at]], g[y[at]], n[x[at]], n[y[at]], np.diff(at, append=len(x)), first))
    return pd.concat(rows)


def _overlaps(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first `cut` sets with the others (with all, if there are no others), by sums over
    the shingles that two or more sets hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    column, owner = column[many], owner[many]
    same = cut == len(sets)
    out = np.zeros((cut, cut if same else len(sets) - cut), dtype=np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.diff(column, prepend=column[0]) > 0)
    step = 2048
    for a in range(0, int(column[-1]) + 1, step):
        lo, hi = np.searchsorted(column, a), np.searchsorted(column, a + step)
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x[:cut] @ (x if same else x[cut:]).T
    return out


def solved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices of the links (u, v), least vertex of the component of each), by hooking and shortcutting."""
    ids, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return ids, ids[label]


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of whole cells, or meetings of two blocks (side 0 and 1): links that join all their sets which link, as stars."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for _, cell in pdf.groupby("cell", sort=False):
        cell = cell.drop_duplicates(["side", "v"]).sort_values("side", kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in cell["own"]]
        ids, cut = cell["v"].to_numpy(np.int64), int((cell["side"] == 0).sum())
        if len(sets) < 2 or not cut:
            continue
        n = np.array([len(x) for x in sets])
        both = _overlaps(sets, cut).astype(np.int64)
        others = slice(None) if cut == len(sets) else slice(cut, None)
        x, y = np.nonzero(100 * both >= T * (n[:cut, None] + n[None, others] - both))
        v, top = solved(ids[:cut][x], ids[others][y])
        found.append((top[top != v], v[top != v]))
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"u": u, "v": v})


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)) for pdf in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        v, label = solved(u, v)
        yield pd.DataFrame({"v": v, "label": label})


def components(links: DataFrame, most: int = SOLVED) -> DataFrame:
    """(v, label): for each vertex of links (u, v), the least vertex of its component.

    While there are more than `most` links, every vertex is merged with the neighbour of least digest, if that is less than
    its own, and links are drawn between what remains; digests are random, so each round removes a constant share of the
    vertices, whatever the shape of the components. One task solves the rest.
    """
    links, merged = staged(links.where("u <> v").distinct(), "links"), []
    while not at_most(links, most):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        near = staged(near.select("u", F.when(F.xxhash64("v") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("to")), "merged")
        merged.append(near)
        to = links.join(near, "u").select(F.col("to").alias("u"), "v").join(near.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
        links = staged(to.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    labels = staged(links.repartition(1).mapInPandas(_solve, "v long, label long"), "labels")
    for near in reversed(merged):
        up = labels.select(F.col("v").alias("to"), "label")
        labels = staged(near.join(up, "to", "left").select(F.col("u").alias("v"), F.coalesce("label", "to").alias("label")), "labels")
    if merged:
        least = labels.groupBy("label").agg(F.min("v").alias("least"))
        labels = staged(labels.join(least, "label").select("v", F.col("least").alias("label")), "labels")
    return labels


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the classes that a document stands for; a task gives each class once."""
    seen: set[int] = set()
    for batch in batches:
        ids, text = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)
        s1, s2 = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        keep, own = [], []
        for words in lines(*text_bytes(text), fold=True):
            for k, x in enumerate(sets_of(words), words.first):
                if ids[k] not in seen and xxhash.xxh3_128_intdigest(x) == ((s1[k] & (2**64 - 1)) << 64 | (s2[k] & (2**64 - 1))):
                    seen.add(ids[k])
                    keep.append(k)
                    own.append(x.tobytes())
        rest = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rest.column(k) for k in (0, 3, 4, 5)] + [pa.array(own, pa.binary())], ["v", "label", "cell", "pivot", "own"])


def _dealt(key: str, n: Column) -> Column:
    """A block of `key`: its rows are dealt to n blocks by the digest of v."""
    return F.xxhash64(F.lit(key), key, F.pmod(F.xxhash64("v"), n))


def _verified(sets: DataFrame, shingles: int) -> DataFrame:
    """Links of sets (cell, side, v, own); cells go to Python in bundles of bounded size."""
    bundles = max(LEAST_SHARDS, -(-shingles // CELL_SHINGLES))
    return sets.withColumn("bundle", F.pmod(F.xxhash64("cell"), F.lit(bundles))).groupBy("bundle").applyInPandas(_linked, "u long, v long")


def _band(bands: int) -> Column:
    return F.floor(F.log("n") * bands)


#: Sizes of the sets with which a set of n shingles can link if it shares at most `most` prefix shingles with any other set:
#: up to `small`, or from `large` on. Beyond what the prefixes share, all that follows one of the two prefixes may be shared.
_SMALL = f"({100 + T} * (most + ceil({T} * n / 100) - 1)) div {T} - n as small"
_LARGE = f"({100 * T} * n - {100 + T} * (100 * most - 1)) div {T * T} as large"


def live(crowds: DataFrame) -> DataFrame:
    """Of crowds (shingle, m, group, n, far, small, large), the rows that some row of their shingle may meet: its size is
    within reach of the row, and the row's size within its own. Rows are held against bands of size, whose number no count of
    rows raises."""
    ends = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("far").alias("far"), F.max("small").alias("small"), F.min("large").alias("large")]
    bands = crowds.groupBy("shingle", _band(CROWD_BANDS).alias("band")).agg(*ends)
    reach = staged(bands.groupBy("shingle").agg(F.collect_list(F.struct("low", "high", "far", "small", "large")).alias("reach")), "reach")
    met = join_counted(crowds, reach, ["shingle"], values=F.size("reach"))
    placed = lambda r: (r["low"] <= F.col("far")) & (r["far"] >= F.col("n"))
    shared = lambda r: ((r["low"] <= F.col("small")) | (r["high"] >= F.col("large"))) & ((F.col("n") <= r["small"]) | (F.col("n") >= r["large"]))
    return met.where(F.exists("reach", lambda r: placed(r) & shared(r))).drop("reach")


def open_keys(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """Of keys (key, group, far, small, large), groups that may link, those that lie in several cells and in several components of
    placed (v, group, label, cell, comp, n)."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("cell", "comp") for name, f in (("low", F.min), ("high", F.max))]
    by_group = placed.groupBy("group").agg(*ends)
    ends = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in ("cell", "comp") for name, f in (("low", F.min), ("high", F.max))]
    apart = keys.join(by_group, "group").groupBy("key").agg(*ends).where("low_cell <> high_cell and low_comp <> high_comp").select("key")
    return staged(join_counted(keys, staged(apart, "apart"), ["key"], "left_semi"), "open")


def meetings(open_: DataFrame, placed: DataFrame) -> DataFrame:
    """cell, side, v, n: what must still be verified, side 0 of a cell against its side 1 (or against itself without one).

    Classes of open keys lie in blocks of at most CELL_SETS, of one component where that is large, else of a label and, where
    it has several, of a band of size. Of each key, the blocks outside its largest component meet all its blocks but those of
    their own component, those whose sizes, places in the key (far) or shared shingles (small, large) allow no link and those
    of their own cell. Large crowds share many classes, so their blocks meet as a whole, once for all crowds; of a pair of
    groups only its own classes meet. A crowd whose classes fit into one cell meets there instead, and crowds of equal classes
    meet once, so a class goes out once a crowd, whatever its block.
    """
    of_key = open_.join(placed.select("v", "group"), "group").select("key", "crowd", "v", "far", "small", "large")
    here = staged(placed.join(of_key.select("v").distinct(), "v", "left_semi"), "here")
    blocks = F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_SHINGLES))
    large = here.groupBy("comp").agg(F.count("*").alias("k"), blocks.alias("of_comp")).where(F.col("k") >= CELL_SETS // 2).drop("k")
    here = here.join(large, "comp", "left")
    rest = here.where("of_comp is null").groupBy("label").agg(blocks.alias("of_label"))
    here = here.join(rest, "label", "left").withColumn("band", F.when((F.col("of_label") > 1) & F.col("of_comp").isNull(), _band(BANDS)).otherwise(-1))
    here = staged(here, "banded")
    banded = here.where("of_comp is null").groupBy("label", "band").agg(blocks.alias("of_band"))
    here = here.join(banded, ["label", "band"], "left").withColumn("in_label", F.xxhash64("label", "band"))
    pure = F.when(F.col("of_comp").isNotNull(), F.col("comp"))
    block = F.when(pure.isNotNull(), _dealt("comp", F.col("of_comp"))).otherwise(_dealt("in_label", F.col("of_band")))
    here = staged(here.select("v", "n", "cell", block.alias("block"), pure.alias("pure")), "blocks")
    of_key = staged(of_key.join(here, "v"), "of-key")

    few = of_key.where("crowd").groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.array_sort(F.collect_set("v")).alias("all"))
    few = staged(few.where((F.col("k") <= CELL_SETS) & (F.col("n") <= CELL_SHINGLES)).select("key", F.xxhash64(F.lit("few"), "all").alias("at"), "all"), "few")
    in_few = few.select("at", "all").distinct().select("at", F.lit(0).alias("side"), F.explode("all").alias("v")).join(here.select("v", "n"), "v")
    of_key = of_key.join(few.select("key"), "key", "left_anti")

    ends = [f(c).alias(f"{name}_{c}") for c in ("cell", "n") for name, f in (("low", F.min), ("high", F.max))]
    ends += [F.max("far").alias("far"), F.max("small").alias("small"), F.min("large").alias("large")]
    by_block = staged(of_key.groupBy("key", "crowd", "block", "pure").agg(F.count("*").alias("k"), *ends), "by-block")
    home = by_block.where("pure is not null").groupBy("key", "pure").agg(F.sum("k").alias("k")).groupBy("key").agg(F.max_by("pure", "k").alias("home"))
    outside = by_block.join(home, "key", "left").where("pure is null or pure <> home").drop("home", "k")
    x, y = (d.select("key", *(["crowd"] if side == "x" else []), *(F.col(c).alias(f"{c}_{side}") for c in ("block", "pure", "low_cell", "high_cell", "low_n", "high_n", "far", "small", "large"))) for d, side in ((outside, "x"), (by_block, "y")))
    meet = x.join(y, "key").where("pure_x is null or pure_y is null or pure_x <> pure_y").where("low_cell_x <> high_cell_x or low_cell_y <> high_cell_y or low_cell_x <> low_cell_y")
    meet = meet.where(f"100 * high_n_x >= {T} * low_n_y and 100 * high_n_y >= {T} * low_n_x and low_n_y <= far_x and low_n_x <= far_y")
    meet = meet.where("(low_n_y <= small_x or high_n_y >= large_x) and (low_n_x <= small_y or high_n_x >= large_y)")
    meet = meet.select("key", "crowd", F.least("block_x", "block_y").alias("x"), F.greatest("block_x", "block_y").alias("y")).withColumn("meet", F.xxhash64("x", "y"))
    meet = staged(meet.distinct(), "meet")

    def sides(meet: DataFrame, *keep: str) -> DataFrame:
        first = meet.select(*keep, F.col("meet").alias("at"), F.lit(0).alias("side"), F.col("x").alias("block"))
        return first.unionByName(meet.where("x <> y").select(*keep, F.col("meet").alias("at"), F.lit(1).alias("side"), F.col("y").alias("block"))).distinct()

    in_crowds = here.join(sides(meet.where("crowd")), "block")
    in_pairs = of_key.where("not crowd").join(sides(meet.where("not crowd"), "key"), ["key", "block"])
    needed = in_few.select("at", "side", "v", "n").unionByName(in_crowds.select("at", "side", "v", "n")).unionByName(in_pairs.select("at", "side", "v", "n"))
    return staged(needed.withColumnRenamed("at", "cell").distinct(), "needed")


def jaccard_components(docs: DataFrame, key: Column | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, label, key, one row for each row of docs (doc_id, text).

    component_id is the least doc_id that links reach from the document. Fewer than N words make one shingle, the whole
    sequence; null and blank texts have an empty set, link with nothing and keep their own id (their label is null). Rows of
    equal sets link, so repeated rows share a component; rows of equal doc_id and other text are vertices of their own.
    A null doc_id is never the least one unless it is alone. label tells components apart also where doc_ids repeat. key
    (bigint, by default a digest of the text) comes with each row. Empty in, empty out; other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.xxhash64("text") if key is None else key
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // (24 * SHARD_ROWS)))

    often = read.select("text").mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > PAIRS // 2)
    ranked = often.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, count = ranked["h"].to_numpy().view(np.uint64), ranked["n"].to_numpy()
    order = np.argsort(h)
    sent = spark.sparkContext.broadcast((h[order], (len(h) - np.arange(len(h)))[order], count[order]))  # the most frequent last

    packed = read.mapInArrow(_prefixes(sent, shards, hot), _PACKED)
    joined = staged(packed.groupBy("shard").applyInPandas(_joined, "kind int, a long, b long, c long, d long, e long, f long"), "joined")
    doc_rows = joined.where(f"kind = {_DOCS}").selectExpr("a as doc_id", "b as key", "c as n", "d as s1", "e as s2", "f as group")
    classes = doc_rows.where("n > 0").groupBy("s1", "s2", "group", "n").agg(F.min("doc_id").alias("rep"), F.min_by("key", "doc_id").alias("key"), F.count("*").alias("rows"))
    classes = staged(classes.withColumn("v", F.monotonically_increasing_id()), "classes")

    crowds = joined.where(f"kind = {_CROWD}").selectExpr("a as shingle", "b as m", "c as group", "d as n", "e as far")
    # what two groups can still share after what their prefixes share; shingles of crowds that both hold are not counted
    pairs = joined.where(f"kind = {_TOKENS}").selectExpr("a", "b", "c as na", "d as nb", "e as c", "f as first")
    p_a, p_b = (F.expr(f"{x} - cast(ceil({T} * {x} / 100) as bigint) + 1") for x in ("na", "nb"))
    pairs = staged(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("first").alias("first")), "counted")
    shared = pairs.selectExpr("a as group", "c").unionByName(pairs.selectExpr("b as group", "c")).groupBy("group").agg(F.max("c").alias("c"))
    largest = F.shiftleft("m", 20) + F.pmod("shingle", F.lit(1 << 20))
    in_crowds = crowds.groupBy("group").agg(F.max_by("shingle", largest).alias("crowd"), F.count("*").alias("heat")).join(shared, "group", "left")
    in_crowds = staged(in_crowds.select("group", "crowd", "heat", (F.col("heat") + F.coalesce("c", F.lit(0))).alias("most")), "in-crowds")
    pairs = pairs.where("first = 1").withColumn("reach", F.col("c") + F.greatest(F.col("na") - p_a, F.col("nb") - p_b))
    enough = f"reach * {100 + T} >= {T} * (na + nb)"
    short = pairs.where(f"not ({enough})")
    for side in "ab":
        short = join_counted(short, in_crowds.select(F.col("group").alias(side), F.col("heat").alias(f"heat_{side}")), [side])
    short = short.withColumn("reach", F.col("reach") + F.least("heat_a", "heat_b")).where(enough)
    pairs = staged(pairs.where(enough).select("a", "b").unionByName(short.select("a", "b")), "pairs")
    crowds = staged(live(join_counted(crowds, in_crowds.select("group", "most"), ["group"]).selectExpr("*", _SMALL, _LARGE)), "live")
    alone = classes.groupBy("group").agg(F.count("*").alias("k")).where("k > 1").select("group")

    # a label for each group that may link: the shingle of its largest crowd, else its least neighbour
    near = pairs.selectExpr("a as group", "b as other").unionByName(pairs.selectExpr("b as group", "a as other")).unionByName(alone.selectExpr("group", "group as other"))
    by_near = near.groupBy("group").agg(F.least(F.min("other"), F.col("group")).alias("near"))
    by_crowd = in_crowds.join(crowds.select("group").distinct(), "group", "left_semi")
    label = F.when(F.col("crowd").isNotNull(), F.xxhash64(F.lit("crowd"), "crowd")).otherwise(F.xxhash64(F.lit("near"), "near"))
    labelled = by_near.join(by_crowd, "group", "full").select("group", label.alias("label"), F.coalesce("heat", F.lit(0)).alias("heat"))
    members = staged(classes.join(labelled, "group").selectExpr("v", "s1", "s2", "rep as doc_id", "key", "group", "n", "label", f"heat / (n - ceil({T} * n / 100) + 1) as typical"), "members")

    blocks = F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_SHINGLES)).alias("cells")
    pivots = F.array(F.max_by("v", "typical"), *(F.min_by("v", F.xxhash64("v", F.lit(k))) for k in range(PIVOTS))).alias("pivots")
    sizes = staged(members.groupBy("label").agg(blocks, pivots, F.sum("n").alias("n")), "sizes")
    in_cell = join_counted(members.drop("typical"), sizes.select("label", "cells", "pivots"), ["label"], rows=100_000)
    in_cell = in_cell.select("v", "s1", "s2", "doc_id", "key", "label", _dealt("label", F.col("cells")).alias("cell"), ((F.col("cells") > 1) & F.array_contains("pivots", F.col("v"))).alias("pivot"), "group", "n")
    in_cell = staged(in_cell, "cells")

    with_text = join_wide(read, in_cell.drop("group", "n"), ["doc_id", "key"], rows=300_000)
    held = staged(with_text.select("v", "s1", "s2", "label", "cell", "pivot", "text").mapInArrow(_read_sets, "v long, label long, cell long, pivot boolean, own binary"), "sets")
    several = in_cell.select("label", "cell").join(sizes.where("cells > 1").select("label"), "label", "left_semi").distinct()
    to_pivots = several.join(held.where("pivot").select("label", "v", "own"), "label")
    shingles = sizes.agg(F.sum("n")).first()[0] or 0
    links = _verified(held.select("cell", F.lit(0).alias("side"), "v", "own").unionByName(to_pivots.select("cell", F.lit(0).alias("side"), "v", "own")), shingles)
    found = components(links)

    any_size = [F.lit(int(LAST)).alias("far"), F.lit(int(LAST)).alias("small"), F.lit(0).cast("long").alias("large")]
    keys = crowds.select(F.xxhash64(F.lit("crowd"), "shingle").alias("key"), "group", "far", "small", "large").unionByName(alone.select(F.xxhash64(F.lit("group"), "group").alias("key"), "group", *any_size))
    keys = keys.withColumn("crowd", F.lit(True)).unionByName(pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("group"), *any_size, F.lit(False).alias("crowd")))
    placed = staged(in_cell.select("v", "group", "label", "cell", "n").join(found.withColumnRenamed("label", "comp"), "v", "left").withColumn("comp", F.coalesce("comp", "v")), "placed")
    open_ = open_keys(keys, placed)
    if not at_most(open_, 0):
        needed = meetings(open_, placed)
        again = join_wide(held.select("v", "own"), needed.drop("n"), ["v"], rows=300_000)
        late = _verified(again.select("cell", "side", "v", "own"), needed.agg(F.sum("n")).first()[0] or 0)
        found = components(found.select(F.col("label").alias("u"), "v").unionByName(late))

    # classes of several rows or with links; all other rows are alone
    reps = classes.select("v", "s1", "s2", "rep", "rows").join(found, "v", "left").where("rows > 1 or label is not null").withColumn("label", F.coalesce("label", "v"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = staged(reps.join(least, "label").select("s1", "s2", "label", "component_id"), "named")
    # equal sets may hold a third of all rows: adaptive execution splits them, or the other side is small
    out = join_counted(doc_rows, named, ["s1", "s2"], "left")
    null = lambda c: F.nullif(c, F.lit(int(LAST)))
    alone_label = F.when(F.col("n") > 0, F.coalesce("label", F.xxhash64("s1", "s2")))
    return out.select(null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("component_id", "doc_id")).alias("component_id"), alone_label.alias("label"), "key")


def _row_key(docs: DataFrame) -> Column:
    """bigint: a hash of all columns and of which are null; equal for rows that are equal throughout (maps take no part)."""
    names = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*names, *(F.col(c).isNull() for c in names))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id (null is the greatest), then the least key.

    Rows are told apart by a hash of all their columns, not by doc_id; of rows equal throughout one stays. Documents without
    words stay.
    """
    keyed = docs.withColumn("__row", _row_key(docs))
    found = jaccard_components(docs, _row_key(docs)).where("n_shingles > 0")
    found = staged(found.select("doc_id", F.col("key").alias("__row"), "label"), "rows")
    crowded = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    members = staged(join_counted(found, crowded, ["label"], "left_semi").distinct(), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("first")
    best = members.groupBy("label").agg(first).select("first.__row")
    dropped = staged(members.select("__row").join(best, "__row", "left_anti").distinct(), "dropped")
    kept = join_wide(keyed, dropped, ["__row"], "left_anti", rows=500_000)
    repeated = staged(found.groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row"), "repeated")
    if at_most(repeated, 0):
        return kept.select(*docs.columns)
    once = join_wide(kept, repeated, ["__row"], rows=500_000).dropDuplicates(["__row"])
    return join_wide(kept, repeated, ["__row"], "left_anti", rows=500_000).unionByName(once).select(*docs.columns)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + {N - 1}], ' ') g FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - {N - 2}))) i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) n FROM s GROUP BY rid),
pairs AS (SELECT a.rid x, b.rid y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= {T} * (nx.n + ny.n - c)),
reach AS (SELECT rid v, rid r FROM d UNION SELECT v, y FROM reach JOIN links ON r = x)
SELECT any_value(a.doc_id) doc_id, coalesce(any_value(n), 0)::BIGINT n_shingles, min(b.doc_id) component_id
FROM reach JOIN d a ON a.rid = v JOIN d b ON b.rid = r LEFT JOIN n ON n.rid = v GROUP BY v
"""
