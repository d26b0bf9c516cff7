"""Token counts of a byte-level merge tokenizer, by finite-state transducers.

Two deterministic transducers are compiled from the vocabulary. The first reads characters and marks where words begin, as
the tokenizer splits a text before its merges. It has few states, so a text is cut into chunks, every chunk becomes the map
from states to states that it stands for, and a parallel prefix scan composes the maps: each chunk then knows the state it
starts in, and all chunks are read side by side. The second reads the bytes of a word. Its transitions carry the number of
tokens by which the count of the word so far changes, so the count of a text is the sum of the transitions it takes.

The second transducer rests on a property of merges: a sequence of tokens is what a text becomes if each two neighbours
are what their own text becomes. The last token of a prefix is therefore the one that ends there and may follow the last
token of the prefix before it. A state holds, for every place from which a longer token can still come, the place in the
tree of tokens, the last token before it and how far its count lies from the present one. States and transitions are made
when a text first takes them, and kept in a table of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lanes import text_bytes

LIMIT = 1024
#: Bytes of text that are read side by side, words that are read side by side, and states of the table of words.
CHUNK, LANES, STATES = 1 << 20, 1 << 13, 1 << 18
#: With fewer words left than this, they are read one by one.
FEW = 48

# Classes of characters: letters by their part in 's 't 'm 'd, 'r 'v, e, l; a separator ends a text; a pad changes nothing.
LETTER, SHORT, PENDING, E, L, NUMBER, OTHER, QUOTE, SPACE, BLANK, SEPARATOR, PAD = range(12)
# States: a word has just ended; in a word of letters, numbers or other characters; after a quote that begins a word; after
# 'r or 'v, after 'l; after one space, one other blank; after more blanks of which the last is a space, another blank.
END, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, AT_R, AT_L, ONE_SPACE, ONE_BLANK, SPACES, BLANKS = range(11)
HERE, BEFORE = 1, 2
#: A place in a state is a node, the token before it plus one, and a count plus ZERO, in one number; LOW: all but the node.
ZERO, LOW = 1 << 15, (1 << 40) - 1


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next, marks) by class and state; HERE: a word begins with this character, BEFORE: with the one before it."""
    letters = (LETTER, SHORT, PENDING, E, L)
    inside = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AT_QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK, SEPARATOR: END, PAD: END}
    after, marks = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    for c in range(11):
        for s in range(11):
            after[c, s], marks[c, s] = inside[c], HERE
            if s in (SPACES, BLANKS):
                marks[c, s] = BEFORE if s == SPACES else HERE | BEFORE
            if s in (AT_R, AT_L):
                marks[c, s] = HERE | BEFORE
            if s in (ONE_SPACE, SPACES) and c == QUOTE:
                after[c, s] = IN_OTHER
            if s == ONE_SPACE:
                marks[c, s] = 0
            if s in (ONE_SPACE, ONE_BLANK, SPACES, BLANKS) and c in (SPACE, BLANK):
                after[c, s], marks[c, s] = SPACES if c == SPACE else BLANKS, 0
        for s, own in ((IN_LETTERS, letters), (IN_NUMBERS, (NUMBER,)), (IN_OTHER, (OTHER, QUOTE)), (AT_QUOTE, (OTHER, QUOTE))):
            if c in own:
                after[c, s], marks[c, s] = IN_OTHER if s == AT_QUOTE else s, 0
    for c, to in ((SHORT, END), (PENDING, AT_R), (L, AT_L)):
        after[c, AT_QUOTE], marks[c, AT_QUOTE] = to, 0
    for s, end in ((AT_R, E), (AT_L, L)):
        for c in letters:
            after[c, s], marks[c, s] = IN_LETTERS, BEFORE
        after[end, s], marks[end, s] = END, 0
    marks[SEPARATOR] = [BEFORE if s in (AT_R, AT_L) else 0 for s in range(11)]
    after[PAD], marks[PAD] = np.arange(11), 0
    return after, marks


NEXT, MARKS = _splitter()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every character."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, name in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            shift = 0x800 if a >= 0xD800 else 0
            out[a + shift : b + shift if b <= 0xD800 or shift else b + 0x800] = name
    for chars, name in (("stmd", SHORT), ("rv", PENDING), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
        out[[ord(c) for c in chars]] = name
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """Row k: the composition of the maps 0 to k, by a prefix scan in log2(rows) rounds."""
    d = 1
    while d < len(maps):
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], axis=1)])
        d *= 2
    return maps


def word_marks(symbols: np.ndarray) -> np.ndarray:
    """For each symbol whether a word begins with it; the symbols begin in state END."""
    n = len(symbols)
    width = max(16, min(512, int(n**0.5)))
    rows = -(-n // width)
    grid = np.full(rows * width, PAD, np.uint8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp) * NEXT.shape[1]
    after, marks = NEXT.ravel(), MARKS.ravel()
    maps = np.tile(np.arange(NEXT.shape[1], dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = after[column[:, None] + maps]
    state = np.concatenate([[END], composed(maps)[:-1, END]]).astype(np.uint8)
    made = np.empty((width, rows), np.uint8)
    for k, column in enumerate(columns):
        at = column + state
        made[k], state = marks[at], after[at]
    made = made.T.ravel()
    found = (made & HERE).astype(bool)
    found[:-1] |= (made[1:] & BEFORE).astype(bool)
    return found[:n]


def _byte_letters() -> dict[str, int]:
    """The letter by which vocabularies of this kind write each byte: itself if it prints, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Counts tokens with the transducers of one vocabulary."""

    def __init__(self, source: str, states: int = STATES):
        made = json.loads(source)
        model, split = made["model"], made.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        added = made.get("added_tokens") or []
        plain_added = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if model["type"] != "BPE" or not plain or made.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain_added:
            raise ValueError("a byte-level vocabulary with merges is needed, without normalizer and prefix space")
        letters = _byte_letters()
        special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.margin = 16 + max(map(len, special), default=0)
        self.token = {v: bytes(letters[c] for c in k) for k, v in model["vocab"].items() if k.encode() not in special}
        ids = {v: k for k, v in self.token.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            x, y = (bytes(letters[c] for c in s) for s in (a, b))
            self.merge[ids[x], ids[y]] = (rank, ids[x + y])
            self.parts.setdefault(ids[x + y], (rank, ids[x], ids[y]))
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, word in self.token.items():
            node = 0
            for b in word:
                node = self.child.setdefault(node << 8 | b, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[float, int]]] = {}
        self.most = states
        self._clear()

    def _clear(self) -> None:
        slots = 1 << (2 * self.most - 1).bit_length() + 1
        self.slot, self.goes, self.shift = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.uint64(65 - slots.bit_length())
        self.made = 0
        self.states: dict[tuple[int, ...], int] = {}
        self.keys: list[tuple[int, ...]] = []
        self._state((ZERO,))

    def _state(self, key: tuple[int, ...]) -> int:
        found = self.states.setdefault(key, len(self.keys))
        if found == len(self.keys):
            self.keys.append(key)
        return found

    def merged(self, ids: list[int]) -> list[int]:
        """Tokens after all merges, the least rank first, the leftmost of equal ones; for short texts."""
        ids = list(ids)
        while len(ids) > 1:
            found = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if found is None:
                break
            k = found[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[float, int]]:
        """(rank of the merge that ends it, token): the tokens that stand at the left (1) or right (2) edge while it is merged,
        the whole token, which nothing ends, first."""
        found = self.edges.get((token, side))
        if found is None:
            found, rank = [], float("inf")
            while True:
                found.append((rank, token))
                if token not in self.parts:
                    break
                rank, token = self.parts[token][0], self.parts[token][side]
            self.edges[found[0][1], side] = found
        return found

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge goes across the border: at every time, the two tokens beside it have none, or only one that comes
        after the merge that ends one of them. Of equal ranks the left one comes first."""
        key = (last + 1) << 32 | token
        found = self.fits.get(key)
        if found is None:
            if last < 0:
                found = self.merged([self.byte_id[b] for b in self.token[token]]) == [token]
            else:
                left, right = self._edge(last, 2), self._edge(token, 1)
                i, j, found = len(left) - 1, len(right) - 1, True
                while True:
                    (ends_left, x), (ends_right, y) = left[i], right[j]
                    across = self.merge.get((x, y))
                    if across and across[0] < ends_left and across[0] <= ends_right:
                        found = False
                        break
                    if not i and not j:
                        break
                    if ends_left <= ends_right:
                        i -= 1
                    else:
                        j -= 1
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _transition(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """(key of the next state, change of the count). A key holds a number for each open place: its node, the token before
        it, and its count, less the present one."""
        open_, token, change, child = [], -1, 0, self.child
        for place in self.keys[state]:
            node = child.get((place >> 40) << 8 | byte)
            if node is not None:
                open_.append(node << 40 | place & LOW)
                if token < 0 <= self.ends[node] and self._may_follow((place >> 16 & 0xFFFFFF) - 1, self.ends[node]):
                    token, change = self.ends[node], (place & 0xFFFF) - ZERO + 1
        return (*[place - change for place in open_], (token + 1) << 16 | ZERO), change

    def _compile(self, keys: np.ndarray, live: np.ndarray) -> np.ndarray | None:
        """Makes transitions, by state and byte. If the table is full, it is begun anew with the live states, whose new numbers
        are returned."""
        if self.made + len(keys) > 2 * self.most or len(self.keys) + len(keys) > self.most:
            kept, back = np.unique(live, return_inverse=True)
            old = [self.keys[k] for k in kept.tolist()]
            self._clear()
            return np.array([self._state(k) for k in old], np.int64)[back]
        mask = len(self.slot) - 1
        for key, h in zip(keys.tolist(), self._place(keys).tolist(), strict=True):
            while self.slot[h] >= 0:
                h = (h + 1) & mask
            to, change = self._transition(key >> 8, key & 255)
            self.goes[h] = self._state(to) << 16 | change + ZERO
            self.slot[h] = key
        self.made += len(keys)
        return None

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states and changes as they are stored, positions of keys without a transition)."""
        at = self._place(keys)
        there = self.slot[at]
        odd = np.flatnonzero(there != keys)
        lost, mask = [odd[:0]], len(self.slot) - 1
        while len(odd):
            free = there[odd] < 0
            lost.append(odd[free])
            odd = odd[~free]
            at[odd] = (at[odd] + 1) & mask
            there[odd] = self.slot[at[odd]]
            odd = odd[there[odd] != keys[odd]]
        return self.goes[at], np.concatenate(lost)

    def _step(self, state: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes of the counts)."""
        while True:
            keys = state << 8 | read
            goes, lost = self._look(keys)
            if not len(lost):
                return goes >> 16, (goes & 0xFFFF) - ZERO
            renamed = self._compile(np.unique(keys[lost]), state)
            if renamed is not None:
                state = renamed

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            at, length = starts[own], (ends - starts)[own]
            state, count, j = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), 0
            while (active := int(np.searchsorted(-length, -j, side="left"))) >= FEW:
                state[:active], change = self._step(state[:active], data[at[:active] + j])
                count[:active] += change
                j += 1
            for k in range(active):
                count[k] += self._rest(data[at[k] + j : at[k] + length[k]].tolist(), state[k:active])
            out[own] = count
        return out

    def _rest(self, read: list[int], states: np.ndarray) -> int:
        """What the rest of one word adds to its count. states: its own and those of words that come later, kept valid."""
        count, known = 0, {}
        state = int(states[0])
        for b in read:
            key = state << 8 | b
            goes = known.get(key)
            if goes is None:
                found, lost = self._look(np.array([key]))
                if len(lost):
                    states[0] = state
                    renamed = self._compile(np.array([key]), states)
                    if renamed is not None:
                        states[:], known = renamed, {}
                        key = int(states[0]) << 8 | b
                        self._compile(np.array([key]), states)
                    found = self._look(np.array([key]))[0]
                goes = known[key] = int(found[0])
            count += (goes & 0xFFFF) - ZERO
            state = goes >> 16
        return count

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, special) of the words of texts data[offsets[k]:offsets[k + 1]]; special: the places of special tokens."""
        wide = bool((data > 127).any())
        chars = np.flatnonzero((data & 0xC0) != 0x80) if wide else np.arange(len(data))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4") if wide else data
        symbols = classes()[points]
        spans = [m.span() for m in self.special.finditer(data.tobytes())] if self.special else []
        text = np.searchsorted(offsets, [a for a, _ in spans], side="right")
        spans = [(a, b) for (a, b), k in zip(spans, text.tolist(), strict=True) if b <= offsets[k]]
        cuts = np.unique(np.concatenate([offsets, np.array(spans, np.int64).ravel()]))
        at = np.searchsorted(chars, cuts)
        for a, b in spans:
            symbols[slice(*np.searchsorted(chars, (a, b)))] = PAD
        mark = word_marks(np.insert(symbols, at, SEPARATOR))
        mark = np.delete(mark, at + np.arange(len(at)))
        starts = chars[mark]
        ends = np.minimum(np.append(starts[1:], len(data)), cuts[np.minimum(np.searchsorted(cuts, starts, side="right"), len(cuts) - 1)])
        return starts, ends, np.array([a for a, _ in spans], np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text data[offsets[k]:offsets[k + 1]]."""
        out, a, n = np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if len(part) > 2 * CHUNK:
                out[a] = self._long(part)
            elif len(part):
                starts, ends, special = self.words(part, own)
                sums = np.concatenate([[0], np.cumsum(self.of_words(part, starts, ends))])
                out[a:b] = np.diff(sums[np.searchsorted(starts, own)]) + np.diff(np.searchsorted(special, own))
            a = b
        return out

    def _long(self, data: np.ndarray) -> int:
        """Tokens of one long text, window by window; each begins where a word surely begins, as if a text began there."""
        total, at, width = 0, 0, CHUNK
        while at < len(data):
            end = min(len(data), at + width)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            part = data[at:end]
            starts, ends, special = self.words(part, np.array([0, len(part)]))
            stop = len(part)
            if end < len(data):
                sure = int(np.searchsorted(starts, len(part) - self.margin))
                stop = int(starts[sure - 1]) if sure else 0
                if not stop:
                    width *= 2
                    continue
            own = starts < stop
            total += int(self.of_words(part, starts[own], ends[own]).sum()) + int((special < stop).sum())
            at, width = at + stop, CHUNK
        return total


@lru_cache(maxsize=2)
def compiled(source: str) -> Counter:
    return Counter(source)


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of docs: bytes of the whole text in UTF-8, its tokens, and whether
    there are more than `limit`.

    vocabulary: path of a byte-level vocabulary with merges (.json), read by the driver and sent to the tasks; its size does
    not depend on the data. Special tokens are not added, but the strings of special tokens count as one. A null text counts
    as empty: 0 bytes, 0 tokens. Rows are counted each on its own, so repeated rows give equal rows and ties cannot arise; a
    null key stays null; other columns are dropped, whatever their names; an empty table gives an empty one. Texts of any
    length are read in windows of bounded size. Narrow: no shuffle, and a lost task is only done again.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counter.counts(data, offsets))], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    bare = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return bare.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
