"""Decoding of captured bytes: byte order mark, declared charset, then strict UTF-8, then the charset whose model of byte pairs
gives the bytes the highest likelihood; what it can't decode is replaced, and costs likelihood.

A model deals its mass to classes of characters, evenly within a class, and to steps between ASCII and other characters; those of
two bytes a character lose likelihood where one stands amid Latin letters.
Classes are regions of the charset's own code chart (which order characters by use), so no trained table is needed.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.memo import memo
from ..functions.rowwise import by_row

MOST_BYTES = 10 * 1024 * 1024
BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]

_HIGH, _ASCII = range(0xA1, 0xFF), 1 / 64


@dataclass(frozen=True)
class Model:
    """prior: of the charset; classes: (mass, leads, trails; no trails for single bytes); steps: probability that a character
    beyond ASCII follows an ASCII one, and one beyond ASCII. Without classes all code points are alike."""

    prior: float
    classes: tuple[tuple[float, Iterable[int], Iterable[int]], ...]
    steps: tuple[float, float] = (0.3, 0.9)


_SJIS_TRAILS = [*range(0x40, 0x7F), *range(0x80, 0xFD)]
MODELS = {
    "utf-8": Model(0.5, ()),  # with broken bytes; its form alone tells it apart
    "gb18030": Model(0.5, ((0.9, range(0xB0, 0xD8), _HIGH), (0.08, range(0xA1, 0xA4), _HIGH), (0.015, range(0xD8, 0xF8), _HIGH))),
    "big5": Model(0.2, ((0.9, range(0xA4, 0xC7), [*range(0x40, 0x7F), *_HIGH]), (0.08, range(0xA1, 0xA4), [*range(0x40, 0x7F), *_HIGH]), (0.015, range(0xC9, 0xFA), [*range(0x40, 0x7F), *_HIGH]))),
    "cp932": Model(0.1, ((0.48, [0x82], range(0x9F, 0xF2)), (0.1, [0x83], range(0x40, 0x97)), (0.1, [0x81], range(0x40, 0xAD)), (0.3, range(0x88, 0x99), _SJIS_TRAILS), (0.01, range(0x99, 0xEB), _SJIS_TRAILS), (0.005, range(0xA1, 0xE0), ()))),
    "euc_jp": Model(0.1, ((0.48, [0xA4], range(0xA1, 0xF4)), (0.1, [0xA5], range(0xA1, 0xF7)), (0.1, [0xA1], _HIGH), (0.3, range(0xB0, 0xD0), _HIGH), (0.01, range(0xD0, 0xF5), _HIGH))),
    "cp949": Model(0.1, ((0.95, range(0xB0, 0xC9), _HIGH), (0.03, range(0xA1, 0xA4), _HIGH), (0.01, range(0xCA, 0xFE), _HIGH), (0.005, range(0x81, 0xC7), range(0x41, 0xA1))), (0.5, 0.7)),
    "cp1252": Model(0.1, ((0.9, range(0xC0, 0x100), ()), (0.1, range(0x80, 0xC0), ())), (0.05, 0.03)),
}
#: In charsets of two bytes a character seldom stands alone between Latin letters, blanks and their marks, and seldom touches
#: a small letter; bytes of accented letters do both. Each such place costs this much.
_ALONE, _INTO_LETTER = float(np.log(1 / 100)), float(np.log(1 / 16))
_MARKS = np.frombuffer(b" \t\n\r,.!?;:|", np.uint8)
#: Ends of Korean syllables that most have in running text: none, n, l, ng. They get this share of the syllables' mass.
_OPEN, _OPEN_SHARE = (0, 4, 8, 21), 0.75


@memo(16)
def _table(codec: str) -> np.ndarray:
    """Log likelihood of each code point up to U+FFFF."""
    out = np.full(1 << 16, np.log(1e-7), np.float32)
    if not MODELS[codec].classes:
        out[:0xFFFD] = np.log(1 / (1 << 16))
    for mass, leads, trails in MODELS[codec].classes:
        found = set()
        for raw in [bytes([a, b]) for a in leads for b in trails] or [bytes([a]) for a in leads]:
            try:
                c = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and "\x7f" < c <= "\uffff" and not "\ue000" <= c < "\uf900":  # private use is no text
                found.add(ord(c))
        points = np.array(sorted(found))
        points = points[out[points] < np.log(1e-6)]
        often = np.isin((points - 0xAC00) % 28, _OPEN) & (points >= 0xAC00) & (points <= 0xD7A3)
        if often.any():
            out[points[often]] = np.log(mass * _OPEN_SHARE / often.sum())
            out[points[~often]] = np.log(mass * (1 - _OPEN_SHARE) / (~often).sum())
        else:
            out[points] = np.log(mass / len(points))
    out[:128] = np.log(_ASCII)
    return out


def likelihood(text: str, codec: str) -> float:
    """Log likelihood of the bytes that were decoded to `text` under the model of their charset."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    model, high = MODELS[codec], points > 127
    into, onwards = model.steps
    before = np.concatenate([[False], high[:-1]])
    n = np.bincount(2 * before + high, minlength=4)
    steps = n @ np.log([1 - into, into, 1 - onwards, onwards])
    if any(len(trails) for _, _, trails in model.classes):
        edge = np.concatenate([[0x20], points, [0x20]])
        high, small = edge > 127, (edge >= 0x61) & (edge <= 0x7A)
        words = small | (edge >= 0x41) & (edge <= 0x5A) | np.isin(edge, _MARKS)
        steps += (words[:-2] & high[1:-1] & words[2:]).sum() * _ALONE + ((high[1:-1] & small[2:]).sum() + (small[:-2] & high[1:-1]).sum()) * _INTO_LETTER
    return float(np.log(model.prior) + _table(codec)[np.minimum(points, 0xFFFF)].sum(dtype=np.float64) + steps)


def detect(data: bytes) -> str:
    """The charset of bytes: UTF-8 where they are that, else the likeliest one; of equal ones the first in MODELS."""
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return max(MODELS, key=lambda codec: likelihood(data.decode(codec, "replace"), codec))


def decode_bytes(data: bytes | None, content_type: str | None = None) -> str | None:
    if data is None:
        return None
    for mark, codec in BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    declared = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", content_type or "")
    if declared:
        try:
            codec = codecs.lookup(declared[1]).name
            return data.decode("gb18030" if codec in ("gbk", "gb2312") else codec, "replace")
        except LookupError:
            pass
    return data.decode(detect(data), "replace")


def decode_column(data: Column, content_type: Column) -> Column:
    return by_row(decode_bytes)(data, content_type)


def captured(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files with html and reason in the place of data: the decoded text of each captured file (data binary, content_type),
    or null and the reason why it is none: "no body", "too large" (more than `most` bytes) or "challenge page".

    No row vanishes; bytes that are too large never leave the JVM. Other columns stay as they are.
    """
    size = F.octet_length("data")
    read = files.withColumn("html", decode_column(F.when(size <= most, F.col("data")), F.col("content_type")))
    reason = F.when(size.isNull(), "no body").when(size > most, "too large").when(T.is_challenge(F.col("html")), "challenge page")
    judged = read.withColumn("reason", reason)
    return judged.withColumn("html", F.when(F.col("reason").isNull(), F.col("html"))).drop("data", "content_type")
