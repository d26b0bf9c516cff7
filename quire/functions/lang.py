"""Conversion between Chinese scripts.

No dictionary is available offline, so coverage is partial: a table of frequent characters, and phrases that differ by
region. Directions: zh-TW and zh-Hant to zh-CN, zh-CN to zh-TW and to zh-Hant, zh-Hant to zh-TW; all others leave the
text as it is.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Simplified characters and the traditional ones in their places.
SIMPLIFIED = "国书说这来时会后么为学发开长门见东车马鸟鱼龙风飞气电话语读写问间闻听华万与义乐习乡买乱争亚产亲从众优传伤体儿关兴养军农动务劳势区医协单卖卫历压双变"
TRADITIONAL = "國書說這來時會後麼為學發開長門見東車馬鳥魚龍風飛氣電話語讀寫問間聞聽華萬與義樂習鄉買亂爭亞產親從眾優傳傷體兒關興養軍農動務勞勢區醫協單賣衛歷壓雙變"
#: Phrases of the mainland and of Taiwan (in traditional characters).
PHRASES = [("軟件", "軟體"), ("硬件", "硬體"), ("網絡", "網路"), ("信息", "資訊"), ("程序", "程式"), ("視頻", "影片"), ("打印", "列印"), ("鼠標", "滑鼠"), ("內存", "記憶體"), ("出租車", "計程車")]
#: Fields of a book and of a chapter that are converted.
BOOK_FIELDS = ["book_name", "author", "intro", "category", "latest_chapter", "last_update_time", "status"]
CHAPTER_FIELDS = ["title", "content"]


def canonical(language: str) -> str:
    """A language tag in one spelling: zh_TW, zh-tw and ZH-TW are zh-TW."""
    parts = language.replace("_", "-").split("-")
    return "-".join([parts[0].lower(), *({"hant": "Hant", "hans": "Hans"}.get(p.lower(), p.upper()) for p in parts[1:])])


def direction(source: str, target: str) -> str | None:
    """Name of the conversion, or None."""
    s, t = canonical(source), canonical(target)
    return {("zh-TW", "zh-CN"): "t2s", ("zh-Hant", "zh-CN"): "t2s", ("zh-CN", "zh-TW"): "s2tw", ("zh-CN", "zh-Hant"): "s2t", ("zh-Hant", "zh-TW"): "t2tw"}.get((s, t))


def direction_column(source: Column, target: str) -> Column:
    """direction() for tags in a column (in one spelling)."""
    out = F.lit(None).cast("string")
    for s in ("zh-TW", "zh-Hant", "zh-CN"):
        if found := direction(s, target):
            out = F.when(source == s, found).otherwise(out)
    return out


class Phrases:
    """Longest matches of phrases, then characters, in one pass: a tree of the phrases, walked from each place that no match
    before it covers."""

    def __init__(self, pairs: Iterable[tuple[str, str]], characters: tuple[str, str] = ("", "")):
        self.characters = str.maketrans(*characters)
        self.tree: dict = {}
        for a, b in pairs:
            node = self.tree
            for c in a:
                node = node.setdefault(c, {})
            if a:
                node.setdefault("", b)  # of equal phrases the first counts

    def convert(self, text: str) -> str:
        out, at, tree = [], 0, self.tree
        while at < len(text):
            node, k, best, end = tree.get(text[at]), at + 1, None, at + 1
            while node is not None:
                if "" in node:
                    best, end = node[""], k
                node = node.get(text[k]) if k < len(text) else None
                k += 1
            out.append(text[at].translate(self.characters) if best is None else best)
            at = end
        return "".join(out)


def phrases_of(how: str) -> Phrases:
    """The table of a conversion. To Taiwan's usage from simplified characters, phrases are matched as they stand there."""
    if how == "s2tw":
        back = str.maketrans(TRADITIONAL, SIMPLIFIED)
        return Phrases([*((a.translate(back), b) for a, b in PHRASES), *PHRASES], (SIMPLIFIED, TRADITIONAL))
    if how == "t2tw":
        return Phrases(PHRASES)
    forth = str.maketrans(TRADITIONAL, SIMPLIFIED)
    return Phrases([(b, a.translate(forth)) for a, b in PHRASES], (TRADITIONAL, SIMPLIFIED))


def convert(col: Column, how: str | None) -> Column:
    """A text in the other script; punctuation stays. Characters alone are native; with phrases, each place of a text is converted
    once, by the longest phrase that begins there, so what one phrase gives never becomes part of another."""
    if how == "s2t":
        return F.translate(col, SIMPLIFIED, TRADITIONAL)
    if how not in ("s2tw", "t2tw", "t2s"):
        return col
    table = phrases_of(how)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else table.convert(t))

    return run(col)


def convert_fields(df: DataFrame, fields: list[str], how: str | None) -> DataFrame:
    return df.withColumns({f: convert(F.col(f), how) for f in fields if f in df.columns}) if how else df
