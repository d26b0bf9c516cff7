"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words of one document. Every window names its anchor, the phrase of PHRASE words in it with
the least hash (the first, if equal); equal windows have equal anchors, and neighbours mostly share theirs, so a seventh of
the positions stand for all. A word goes as a symbol of 12 bits, so a phrase is 96 bits.

1. Documents are dealt by digest to blocks of about BLOCK_BYTES. Anchors of all documents are counted by shards of their
   phrase; those that occur twice are the repeated phrases, and each block is told which of them it holds.
2. For each block an Aho-Corasick automaton is compiled (pyahocorasick) from the phrases it was told, and all documents of
   the block stream through it. Only windows around a located phrase can repeat; there is no other source of candidates.
3. A block keeps the first place of each such window and sends it, by 96 bits of the window's hash, to a shard; there the
   first of all blocks is found and told back. Every located window that is not first is covered.

Nothing is dropped or sampled. What goes over the network per window is one row for each block, so a passage that stands
in a third of all documents, or a phrase repeated without end, weighs no more than others. No step holds more than a
block or a shard, both of bounded size. Texts go over the network once, packed and compressed, to their block; the last
step reads that exchange again, runs the automaton again and numbers the windows alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, join_counted, staged, table
from .lanes import Line, by_shard, lines, mixed, rolled, text_bytes

WINDOW = 20
PHRASE = 8
BLOCK_BYTES, SHARD_BYTES = 4_000_000, 6_000_000
LEAST_BLOCKS = 48
#: Rows equal in id and text from which on they are handled as one row with a count.
REPEATS = 1_000
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max
#: Symbols stand for words in the automaton's strings; this one ends a document.
_SYMBOL_BITS, _END = 12, 0x2000


def anchors(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all windows, each once, of documents that stand one after the other; ends: where each
    ends. Windows across two documents do not count."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int32)
    value = rolled(ids, PHRASE, 2)
    at, width = np.arange(len(value), dtype=np.int32), 1
    need = WINDOW - PHRASE + 1
    while width < need:
        step = min(width, need - width)
        left, right = value[: len(value) - step], value[step:]
        less = right < left
        at, value = np.where(less, at[step:], at[: len(at) - step]), np.where(less, right, left)
        width += step
    # the document of each window, by the number of documents that end at or before its start
    starts = np.arange(len(at))
    left_of = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(left_of, ends, 1)
    of = np.cumsum(left_of)[starts]
    at = at[starts + WINDOW <= ends[np.minimum(of, len(ends) - 1)]]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def symbols(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - _SYMBOL_BITS)).astype(np.uint64)


def phrase_codes(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper 64 bits, lower 32 bits) of the symbols of the phrases at these positions."""
    s = symbols(ids)
    high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(PHRASE):
        high = (high << np.uint64(_SYMBOL_BITS)) | (low >> np.uint64(32 - _SYMBOL_BITS))
        low = ((low << np.uint64(_SYMBOL_BITS)) | s[at + k]) & np.uint64(0xFFFFFFFF)
    return high, low.astype(np.uint32)


def phrase_strings(high: np.ndarray, low: np.ndarray) -> list[str]:
    """What the automaton looks for: one character for each word."""
    out = np.empty((len(high), PHRASE), np.uint32)
    low = low.astype(np.uint64)
    for k in range(PHRASE - 1, -1, -1):
        out[:, k] = (low & np.uint64((1 << _SYMBOL_BITS) - 1)) + np.uint64(1)
        low = (low >> np.uint64(_SYMBOL_BITS)) | ((high << np.uint64(32 - _SYMBOL_BITS)) & np.uint64(0xFFFFFFFF))
        high = high >> np.uint64(_SYMBOL_BITS)
    whole = out.tobytes().decode("utf-32-le")
    return [whole[k : k + PHRASE] for k in range(0, len(whole), PHRASE)]


def _zip(*columns: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unzip(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, -1, at)]


class Documents(NamedTuple):
    """Rows of one block: ids (null as LAST), whether the id is null, how many rows each stands for, texts."""

    ids: np.ndarray
    null: np.ndarray
    copies: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def packed(self) -> bytes:
        return _zip(self.ids, self.copies, np.diff(self.offsets), self.null, self.data)

    def of(self, rows: np.ndarray) -> Documents:
        size = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = np.concatenate([self.data[self.offsets[k] : self.offsets[k + 1]] for k in rows.tolist()] or [self.data[:0]])
        return Documents(self.ids[rows], self.null[rows], self.copies[rows], data, offsets)


def _documents(n: pd.Series, data: pd.Series) -> Documents:
    parts = [_unzip(x, k, np.int64, np.int64, np.int64, np.bool_) for k, x in zip(n.tolist(), data, strict=True)]
    ids, copies, size, null, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Documents(ids, null, copies, texts, np.concatenate([[0], np.cumsum(size)]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, null, copies, text) packed by block."""
    for batch in batches:
        block, ids, null, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        every = Documents(ids, null, copies, *text_bytes(batch.column(4)))
        order = np.argsort(block, kind="stable")
        parts = [x for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[[x[0] for x in parts]]), pa.array([len(x) for x in parts], pa.int64()), pa.array([every.of(x).packed() for x in parts], pa.binary())], ["block", "n", "data"]
        )


def _phrases_of(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of rows (block, text), packed by shard of the phrase."""
        for batch in batches:
            blocks, found = batch.column(0).to_numpy().astype(np.int32), []
            for words in lines(*text_bytes(batch.column(1))):
                at = anchors(words.ids, words.cuts[1:])
                found.append((*phrase_codes(words.ids, at), blocks[words.first + np.searchsorted(words.cuts[1:], at, side="right")]))
            if not found:
                continue
            high, low, block = (np.concatenate(x) for x in zip(*found, strict=True))
            # a phrase that a block holds twice goes on as two rows of it, not more
            order = np.lexsort((block, low, high))
            high, low, block = high[order], low[order], block[order]
            third = np.zeros(len(high), bool)
            third[2:] = (high[2:] == high[:-2]) & (low[2:] == low[:-2]) & (block[2:] == block[:-2])
            high, low, block = high[~third], low[~third], block[~third]
            rows = [(s, len(i), high[i].tobytes() + low[i].tobytes() + block[i].tobytes()) for s, i in by_shard(mixed(high ^ low), shards)]
            shard, n, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["shard", "n", "data"])

    return run


def _columns(n: pd.Series, data: pd.Series, *kinds) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for k, x in zip(n.tolist(), data, strict=True):
        at = 0
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(x, kind, k, at))
            at += k * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


def _starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each place differs from the one before it in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the phrases that occur twice, by block."""
    high, low, block = _columns(pdf["n"], pdf["data"], np.uint64, np.uint32, np.int32)
    order = np.lexsort((block, low, high))
    high, low, block = high[order], low[order], block[order]
    phrase = np.cumsum(_starts_of(high, low)) - 1
    keep = (np.bincount(phrase)[phrase] > 1) & _starts_of(phrase, block)
    order = np.flatnonzero(keep)[np.argsort(block[keep], kind="stable")]
    parts = [x for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(x)]
    return pd.DataFrame([(int(block[x[0]]), len(x), high[x].tobytes() + low[x].tobytes()) for x in parts], columns=["block", "n", "data"])


def automaton(phrases: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        made.add_word(p)
    made.make_automaton()
    return made


def located(words: Line, made) -> np.ndarray:
    """Positions of the windows that hold a phrase of the automaton; all documents of the line stream through it."""
    n, cuts = len(words.ids), words.cuts
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    place = np.arange(n) + owner
    text = np.full(n + len(cuts) - 1, _END, np.uint32)
    text[place] = symbols(words.ids) + np.uint64(1)
    back = np.zeros(len(text), np.int64)
    back[place] = np.arange(n)
    hits = back[np.fromiter((e for e, _ in made.iter(text.tobytes().decode("utf-32-le"))), dtype=np.int64)]
    of = owner[hits]
    low, high = np.maximum(cuts[of], hits - WINDOW + 1), np.minimum(hits - PHRASE + 1, cuts[of + 1] - WINDOW)
    low, high = low[high >= low], high[high >= low]
    open_ = np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)
    return np.flatnonzero(np.cumsum(open_[:n]) > 0)


def kept(words: Line, gone: np.ndarray) -> list[tuple[int, int, str]]:
    """(words, words that are gone, digest of the others joined by a space) of each document of the line."""
    left = np.flatnonzero(~gone)
    size = words.ends[left] - words.starts[left] + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(words.starts[left] - upto[:-1], size) + np.arange(upto[-1])
    out = words.data[np.minimum(source, max(0, len(words.data) - 1))]
    out[upto[1:] - 1] = 0x20
    out, bounds = memoryview(out), upto[np.searchsorted(left, words.cuts)]
    n = np.diff(words.cuts)
    away = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.cuts])
    return [(k, g, hashlib.sha256(out[a : max(a, b - 1)]).hexdigest()) for k, g, a, b in zip(n.tolist(), away.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Candidates(NamedTuple):
    """Located windows of a block in the order of its documents and their starts."""

    row: np.ndarray  # the document
    start: np.ndarray  # the first word in it
    number: np.ndarray  # of the window, at its first places in the block; -1 elsewhere
    first: np.ndarray  # by number: the place (in this order) of the window's first one
    a: np.ndarray  # 96 bits of the window's hash
    b: np.ndarray


def _read(docs: pd.DataFrame, phrases: pd.DataFrame) -> tuple[Documents, list[Line], Candidates]:
    """Step 2 of one block. Whatever order its rows come in, the same numbers name the same windows."""
    import xxhash

    every = _documents(docs["n"], docs["data"])
    raw = memoryview(every.data)
    digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(every.offsets[:-1].tolist(), every.offsets[1:].tolist(), strict=True)], np.uint64)
    every = every.of(np.lexsort((digest, every.null, every.ids)))
    strings = phrase_strings(*_columns(phrases["n"], phrases["data"], np.uint64, np.uint32))
    made = automaton(strings) if strings else None
    read, found = list(lines(every.data, every.offsets)), []
    for words in read:
        at = located(words, made) if made else np.zeros(0, np.int64)
        of = np.searchsorted(words.cuts, at, side="right") - 1
        a, b = (rolled(words.ids, WINDOW, k)[at] if len(at) else np.zeros(0, np.uint64) for k in (0, 1))
        found.append((words.first + of, (at - words.cuts[of]).astype(np.int32), a, (b >> np.uint64(32)).astype(np.uint32)))
    row, start, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = every.ids[row]
    order = np.lexsort((start, doc, b, a))
    new = _starts_of(a[order], b[order])
    which, first = np.cumsum(new) - 1, order[new]
    number = np.empty(len(first), np.int32)
    number[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    numbers = np.empty(len(a), np.int32)
    numbers[order] = np.where((doc[order] == doc[first][which]) & (start[order] == start[first][which]), number[which], -1)
    return every, read, Candidates(row, start, numbers, np.sort(first), a, b)


_PACKED = "block long, n long, data binary"


def _windows(shards: int):
    """For cogroup: the first places of the located windows of one block, packed by shard."""

    def run(docs: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(phrases):
            every, _, found = _read(docs, phrases)
            first = found.first
            for shard, i in by_shard(found.a[first], shards):
                j = first[i]
                places = _zip(every.ids[found.row[j]], found.start[j], np.diff(i, prepend=0).astype(np.int32))
                rows.append((shard, int(docs["block"].iloc[0]), len(j), found.a[j].tobytes() + found.b[j].tobytes() + places))
        return pd.DataFrame(rows, columns=["shard", "block", "n", "data"])

    return run


def _first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the numbers of the windows that are first of all, by block."""
    a, b, doc, start, number = [], [], [], [], []
    for n, data in zip(pdf["n"].tolist(), pdf["data"], strict=True):
        a.append(np.frombuffer(data, np.uint64, n))
        b.append(np.frombuffer(data, np.uint32, n, 8 * n))
        d, s, k, _ = _unzip(data[12 * n :], n, np.int64, np.int32, np.int32)
        doc.append(d)
        start.append(s)
        number.append(np.cumsum(k, dtype=np.int32))
    block = np.repeat(pdf["block"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
    a, b, doc, start, number = (np.concatenate(x) for x in (a, b, doc, start, number))
    order = np.lexsort((start, doc, b, a))
    new = _starts_of(a[order], b[order])
    first = order[new][np.cumsum(new) - 1]
    order = order[(doc[order] == doc[first]) & (start[order] == start[first])]
    order = order[np.lexsort((number[order], block[order]))]
    parts = [x for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(x)]
    return pd.DataFrame([(int(block[x[0]]), len(x), _zip(np.diff(number[x], prepend=0).astype(np.int32))) for x in parts], columns=["block", "n", "data"])


_DONE = "doc_id long, copies long, n_words long, n_removed long, kept_sha256 string, removed binary"


def _finish(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Of one block, told its phrases and which of its windows are first of all: all other located windows cover."""
    names, rows = [x.split()[0] for x in _DONE.split(", ")], []
    if len(docs):
        every, read, found = _read(docs, told[~told["is_first"]])
        firsts = told[told["is_first"]]
        is_first = np.zeros(len(found.first) + 1, bool)  # the last place stands for number -1
        for n, data in zip(firsts["n"].tolist(), firsts["data"], strict=True):
            is_first[np.cumsum(_unzip(data, n, np.int32)[0])] = True
        covers = ~is_first[found.number]
        row, start = found.row[covers], found.start[covers]
        upto = np.searchsorted(row, np.arange(len(every.ids) + 1))
        for words in read:
            n, lo, hi = len(words.ids), upto[words.first], upto[words.first + len(words.cuts) - 1]
            at = words.cuts[row[lo:hi] - words.first] + start[lo:hi]
            gone = np.cumsum(np.bincount(at, minlength=n + 1)[:n] - np.bincount(at + WINDOW, minlength=n + 1)[:n]) > 0
            for k, (m, g, sha) in enumerate(kept(words, gone), words.first):
                mine = start[upto[k] : upto[k + 1]].tobytes()
                rows.append((None if every.null[k] else int(every.ids[k]), int(every.copies[k]), m, g, sha, mine or None))
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "copies": "Int64", "n_words": "Int64", "n_removed": "Int64"})


def _counted(docs: DataFrame, repeats: int) -> DataFrame:
    """docs (doc_id, text, digest) with copies; rows that are equal in all of it and more than `repeats` become one."""
    many = staged(docs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > repeats).select("digest"), "many")
    one = F.lit(1).cast("long").alias("copies")
    if at_most(many, 0):
        return docs.select("*", one)
    same = join_counted(docs, many, ["digest"], "left_semi").groupBy("doc_id", "text", "digest").agg(F.count("*").alias("copies"))
    return join_counted(docs, many, ["digest"], "left_anti").select("*", one).unionByName(staged(same, "same"))


def repeated_passages(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed, one row for each row of docs (doc_id, text).

    A word is removed when a window covers it whose words also start earlier: in a document of smaller doc_id, or earlier in
    the same one. kept_sha256 is the digest of the kept words, joined by a space; removed holds the starts of the windows
    that cover (int32, little end first; null if none). Null and blank texts have no words. Rows of equal doc_id count as
    one document: a window is earlier in one of them if it starts at a smaller place, and at equal starts neither is
    earlier. A null doc_id comes after all others. Empty in, empty out; other columns are ignored.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = (max(LEAST_BLOCKS, -(-total // size)) for size in (BLOCK_BYTES, SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _counted(rows.withColumn("digest", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")), repeats)
    dealt = rows.withColumn("block", F.pmod("digest", F.lit(blocks)))

    phrases = dealt.select("block", "text").mapInArrow(_phrases_of(shards), "shard long, n long, data binary")
    repeated = phrases.groupBy("shard").applyInPandas(_repeated, _PACKED)
    # ids with nulls would become doubles on the way to Python
    packed = dealt.select("block", F.coalesce("doc_id", F.lit(int(LAST))).alias("doc_id"), F.col("doc_id").isNull().alias("null"), "copies", "text").mapInArrow(_packed, _PACKED)
    windows = packed.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(_windows(shards), "shard long, block long, n long, data binary")
    firsts = windows.groupBy("shard").applyInPandas(_first, _PACKED)
    # blocks are read again with what they are told: cheaper than to send their texts and windows a second time
    told = repeated.withColumn("is_first", F.lit(False)).unionByName(firsts.withColumn("is_first", F.lit(True)))
    every = packed.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_finish, _DONE)
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("removed")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], chr(10)) win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) i FROM d)),
late AS (SELECT rid, i FROM (SELECT rid, i, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i) nth FROM win) WHERE nth > 1),
words AS (SELECT rid, doc_id, unnest(w) word, generate_subscripts(w, 1) p FROM d),
marked AS (
  SELECT w.*, coalesce(max(l.i) OVER (PARTITION BY w.rid ORDER BY p) > p - {WINDOW}, false) gone FROM words w LEFT JOIN late l ON w.rid = l.rid AND w.p = l.i),
kept AS (
  SELECT rid, count(*) n_words, count(*) FILTER (gone) n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) txt
  FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed, sha256(coalesce(txt, '')) kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
