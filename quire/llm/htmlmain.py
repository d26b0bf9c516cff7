"""Main text of pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

A page becomes its leaf blocks in order; features are the tags around a block, the words of their ids and classes, and
traits of its text. The field has two labels (article, other) and is trained on labelled pages by maximum likelihood
(forward-backward, Adagrad). Pages are labelled by construction: a seeded writer builds pages of many layouts from parts
whose label it knows. The model is a few hundred weights, so it is trained on the driver and goes out with the tasks.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .htmlblocks import leaf_blocks

TRAIN_PAGES = 700
EPOCHS = 5
SEED = 11


#: Words of headings over comments.
SAYS_COMMENTS = set("comment comments reply replies response responses discussion kommentare kommentar commentaires commentaire comentarios comentario".split())
_WORD = re.compile(r"[a-z]+")


def features(blocks) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for text, own, names, marks, linked in blocks:
        words = text.count(" ") + 1
        end = text[-1]
        fs = ["bias", f"own={own}", f"links={int(linked * 4 + 0.5)}", f"words={min(words, 4) if words < 5 else 5 + min(4, words // 12)}"]
        fs += [f"in={x}" for x in sorted(names)]
        fs += [f"mark={x}" for x in sorted(marks)]
        fs += [f"part={part}" for part in sorted({_PART_OF[x] for x in marks if x in _PART_OF})]
        fs.append("stop" if end in ".!?…\"'”»)" else "nostop")
        if "©" in text[:3] or "(c) " in text[:6].lower():
            fs.append("copyright")
        if words < 5 and any(x in SAYS_COMMENTS for x in _WORD.findall(text.lower())):
            fs.append("says=comments")
        elif names.isdisjoint(_PARTS) and marks.isdisjoint(_PART_MARKS):
            fs.append("plain")
        out.append(fs)
    return out


class Field:
    """Weights of the chain: one vector per feature, and the transitions with start."""

    def __init__(self, index: dict[str, int], w: np.ndarray, t: np.ndarray, s: np.ndarray):
        self.index, self.w, self.t, self.s = index, w, t, s

    def scores(self, fs: list[list[str]]) -> np.ndarray:
        index = self.index
        return np.array([self.w[[index[f] for f in one if f in index]].sum(axis=0) for one in fs])

    def decode(self, fs: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi); ties to label 0."""
        e = self.scores(fs).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a0, a1 = self.s[0] + e[0][0], self.s[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            from0, from1 = (0 if a0 + t00 >= a1 + t10 else 1), (0 if a0 + t01 >= a1 + t11 else 1)
            back.append((from0, from1))
            a0, a1 = e0 + (a1 + t10 if from0 else a0 + t00), e1 + (a1 + t11 if from1 else a0 + t01)
        label = int(a1 > a0)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """pages: (blocks, labels). Stochastic gradient of the conditional likelihood, one page at a time."""
    rows = [(features(blocks), labels) for blocks, labels in pages if blocks]
    index: dict[str, int] = {}
    for fs, _ in rows:
        for one in fs:
            for f in one:
                index.setdefault(f, len(index))
    coded = [([np.array([index[f] for f in one]) for one in fs], np.array(labels)) for fs, labels in rows]
    w, t, s = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    gw, gt, gs = np.full_like(w, 1e-2), np.full_like(t, 1e-2), np.full_like(s, 1e-2)
    order = random.Random(SEED)
    for _ in range(epochs):
        for k in order.sample(range(len(coded)), len(coded)):
            ids, y = coded[k]
            e = np.array([w[i].sum(axis=0) for i in ids])
            n = len(y)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = s + e[0]
            for i in range(1, n):
                alpha[i] = e[i] + np.logaddexp(alpha[i - 1][0] + t[0], alpha[i - 1][1] + t[1])
            for i in range(n - 2, -1, -1):
                x = e[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - z)
            gold = np.eye(2)[y]
            dt = np.zeros((2, 2))
            for i in range(1, n):
                dt -= np.exp(alpha[i - 1][:, None] + t + (e[i] + beta[i])[None, :] - z)
                dt[y[i - 1], y[i]] += 1
            d = gold - p
            flat = np.concatenate(ids)
            dw = np.repeat(d, [len(i) for i in ids], axis=0)
            g = np.zeros_like(w)
            np.add.at(g, flat, dw)
            touched = np.unique(flat)
            g[touched] -= decay * w[touched]
            gw[touched] += g[touched] ** 2
            w[touched] += rate * g[touched] / np.sqrt(gw[touched])
            gt += dt**2
            t += rate * dt / np.sqrt(gt)
            gs += d[0] ** 2
            s += rate * d[0] / np.sqrt(gs)
    return Field(index, w, t, s)


#: Marks that the writer of training pages gives to parts, by part.
MARKS = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs topbar tabs links pagination pager skip toc",
    "header": "header masthead banner branding logo site top hero tagline",
    "footer": "footer bottom copyright colophon legal imprint foot",
    "sidebar": "sidebar aside related widget rail secondary complementary recommended popular trending teaser archive",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay toast warning message privacy",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsbox banner adslot partner",
    "form": "form search newsletter subscribe signup login contact",
    "comments": "comment comments reply replies discussion respond responses disqus thread reader readers feedback",
    "share": "share social sharing follow buttons tools meta byline tags",
    "article": "article content post entry main story body text prose article-body markdown copy chapter lead",
}
_PARTS = set("nav header footer aside form".split())
_PART_OF = {m: part for part, names in MARKS.items() for m in names.split()}
_PART_MARKS = {m for m, part in _PART_OF.items() if part != "article"}
_TAGS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section aside", "advert": "div aside section ins", "form": "form", "comments": "section div aside article ul", "share": "div ul"}


def written_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks, in order."""
    syllables = [r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéó") + r.choice(["", "n", "r", "s", "t"]) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    labels: list[int] = []
    odd = r.choice(["", "", "", "", " |", "!!", "***", ","])  # some articles are of poor quality, and are articles still

    def phrase(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize()

    def sentences(n: int) -> str:
        return " ".join(phrase(r.randint(2, 16)) + r.choice([".", ".", ".", "?", "!"]) for _ in range(n))

    def attrs(part: str) -> str:
        if r.random() < 0.3:
            return ""
        names = " ".join(r.sample(MARKS[part].split(), r.choice([1, 1, 2])))
        names = names.replace(" ", r.choice([" ", "-", "_"]))
        return f' {r.choice(["class", "class", "id", "role"])}="{names}{r.choice(["", "", "-box", " wide"])}"'

    def leaf(tag: str, text: str, label: int) -> str:
        labels.append(label)
        if odd and label:
            text = text.replace(" ", odd + " ") + odd
        if r.random() < 0.15:
            text = f"<b>{text}</b>" if r.random() < 0.6 else f"<b>{text}"
        if r.random() < 0.1 and label:
            text = text.replace(" ", " <a href='/x'>link</a> ", 1)
        return f"<{tag}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.85 else "")

    def other(part: str) -> str:
        tag = r.choice(_TAGS[part].split())
        inside = ""
        if part == "menu":
            inside = "".join(leaf("li", f"<a href='/{word()}'>{r.choice([phrase(r.randint(1, 3)), word(), word() + '.'])}</a>", 0) for _ in range(r.randint(1, 8)))
            inside = inside if tag == "ul" else f"<ul>{inside}</ul>"
        elif part == "footer":
            for _ in range(r.randint(1, 3)):
                inside += leaf(r.choice(["p", "div", "span"]), r.choice(["&copy; ", "© 2024 ", "", ""]) + phrase(r.randint(1, 4)) + r.choice(["", " &middot; ", " | "]) + sentences(1), 0) if r.random() < 0.6 else leaf("p", f"<a href='/'>{phrase(2)}</a>", 0)
                if "<span>" in inside:
                    break
        elif part == "comments":
            inside = leaf("h3", r.choice(["Comments", phrase(1), "3 comments"]), 0) if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 4)):
                body = leaf("p", sentences(r.randint(1, 4)), 0)
                inside += r.choice([body, f"<div class='comment'>{body}</div>", f"<div>{leaf('cite', phrase(1), 0).replace('cite', 'h5')}{body}</div>", f"<article class='comment'>{body}</article>"])
            inside = f"<li>{inside}</li>" if tag == "ul" else inside
        elif part == "form":
            inside = leaf("p", sentences(r.randint(1, 2)), 0) if r.random() < 0.6 else leaf("div", f"<label>{phrase(1)}</label>", 0)
            inside += "<input name='q'><textarea>" + phrase(3) + "</textarea><select><option>" + word() + "</select>"
        elif part == "share":
            inside = "".join(leaf("li", f"<a href='#'>{word()}</a>", 0) for _ in range(r.randint(1, 4)))
        elif part == "sidebar" and r.random() < 0.6:
            inside = leaf("h4", phrase(2), 0) + "<ul>" + "".join(leaf("li", f"<a href='/a'>{phrase(r.randint(2, 8))}</a>", 0) for _ in range(r.randint(1, 6))) + "</ul>"
        else:
            for _ in range(r.randint(1, 3)):
                inside += leaf(r.choice(["p", "p", "div", "h2" if part == "header" else "p"]), sentences(r.randint(1, 3)), 0)
        if part in ("advert", "notice", "header", "footer") and r.random() < 0.5:
            del labels[len(labels) - sum(1 for _ in leaf_blocks(inside)) :]
            labels.append(0)
            inside = sentences(r.randint(1, 3)) if part != "footer" else "&copy; www." + word() + ".example &middot; " + sentences(1)
        marked = attrs(part)
        if part in ("menu", "share") and r.random() < 0.25:
            marked = ""  # a list of links needs no mark to be known
        elif not marked and tag in ("div", "ul", "section", "article", "ins"):
            marked = f' class="{r.choice(MARKS[part].split())}"'
        return f"<{tag}{marked}>{inside}</{tag}>"

    alone = r.random() < 0.25  # nothing before the article
    top = [] if alone else [other(x) for x in ("menu", "header", "notice", "advert", "menu", "form") if r.random() < (0.6 if x == "menu" else 0.35)]
    body: list[str] = []
    style = r.choice(["usual"] * 6 + ["bare", "bare", "bare", "divs", "divs", "short", "links"])

    def bare() -> str:
        """Text that stands in the element itself, its lines parted by br."""
        labels.append(1)
        return r.choice(["<br>", "<br><br>", "<br/>"]).join(sentences(r.randint(1, 5)) for _ in range(r.randint(1, 5)))

    if r.random() < (0.4 if style in ("bare", "short", "divs") else 0.85):
        body.append(leaf("h1", phrase(r.randint(1, 9)), 1))
    if r.random() < 0.15:
        body.append(other("share"))
    if style == "bare":
        body.append(bare())
    elif style == "short":
        body.append(leaf(r.choice(["p", "p", "div"]), phrase(r.randint(4, 25)) + ".", 1))
    for _ in range(0 if style == "short" else r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
        x = r.random()
        if style == "divs" and x > 0.3:
            body.append(leaf("div", sentences(r.randint(1, 6)), 1))
        elif style == "bare" and x > 0.5 and not body[-1].endswith((".", "?", "!", odd or ".")):
            body.append(bare())
        elif x < 0.08:
            body.append(leaf(r.choice(["h2", "h3"]), phrase(r.randint(1, 6)), 1))
        elif x < 0.13:
            body.append("<ul>" + "".join(leaf("li", sentences(1), 1) for _ in range(r.randint(1, 4))) + "</ul>")
        elif x < 0.17:
            body.append("<blockquote>" + leaf("p", sentences(2), 1) + "</blockquote>")
        elif x < 0.20:
            body.append("<table><tr>" + "".join(leaf("td", word(), 1) for _ in range(r.randint(1, 4))) + "</tr></table>")
        elif x < 0.27:
            body.append(other(r.choice(["advert", "sidebar", "notice", "form", "share"])))
        elif x < 0.35:
            body.append(leaf("p", phrase(r.randint(1, 4)) + ".", 1))
        else:
            body.append(leaf("p", sentences(r.randint(1, 8)), 1))
    if style == "links":
        body.append(leaf("h2", phrase(r.randint(1, 2)), 1) if r.random() < 0.6 else leaf("p", sentences(1), 1))
        body.append("<ul>" + "".join(leaf("li", f"<a href='/s'>{phrase(r.randint(1, 9))}</a>", 1) for _ in range(r.randint(1, 6))) + "</ul>")
    if r.random() < 0.3:
        if r.random() < 0.6:  # a heading of the comments that stands before them
            body.append(leaf(r.choice(["h2", "h3", "p", "div"]), r.choice([f"{r.randint(1, 90)} comments", "Comments", "1 comment", "Replies", "Kommentare", "Comentarios", "Commentaires"]), 0))
        body.append(other("comments"))
    kind = r.choice(["article", "article", "article", "main", "div", "div", "section", "", "", "td"])
    marked = attrs("article") if kind in ("article", "main") or r.random() < 0.2 else "" if r.random() < 0.4 else f' class="{r.choice(MARKS["article"].split())}"'
    if r.random() < 0.08:  # a mark of other parts can stand on an article
        marked = f' class="{r.choice("top site header meta wide message warning partner legal toc".split())} {r.choice(MARKS["article"].split())}"'
    body_html = f"<{kind}{marked}>{''.join(body)}</{kind}>" if kind else "".join(body)
    if kind == "td":
        body_html = f"<table><tr>{body_html}</tr></table>"
    if kind and r.random() < 0.3:
        body_html = f"<main>{body_html}</main>" if kind != "main" else f"<div id='page'>{body_html}</div>"
    tail = [other(x) for x in ("sidebar", "comments", "advert", "form", "notice", "footer") if r.random() < (0.7 if x == "footer" else 0.3)]
    head = f"<!DOCTYPE html><html><head><title>{phrase(4)}</title><script>var t='</p>';</script></head><body>"
    return head + "".join(top) + "<!-- x -->" + body_html + "".join(tail) + r.choice(["</body></html>", ""]), labels


def labelled_pages(n: int, seed: int) -> list[tuple[list, list[int]]]:
    """(blocks, labels) of n written pages; a page whose blocks do not line up with its labels is written anew."""
    r, out = random.Random(seed), []
    while len(out) < n:
        page, labels = written_page(r)
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def model() -> Field:
    return train(labelled_pages(TRAIN_PAGES, SEED))


def main_text(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page or "", lambda mark: f"mark={mark}" in field.index)
    if not blocks:
        return ""
    return "\n".join(b[0] for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract_main(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars instead of html.

    Null and empty html, and pages without an article block, have the empty text. Each row is extracted on its own, so
    repeated rows give equal rows; other columns are dropped. Works batch by batch, without a shuffle.
    """
    field = field or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(field, x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op10_extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
