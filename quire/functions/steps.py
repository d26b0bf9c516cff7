"""Extractor expressions `css [@attr] {(@js:|@java:) code [;]}` and their closed set of named steps.

There is no script engine: snippets of rules are mapped to named steps, which run as native Column expressions or, inside a
batch over element trees, as plain functions of the same meaning. Unknown steps pass their input through.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Step:
    """kind: js or java; name and args of the named step (name "" : pass through)."""

    kind: str
    name: str
    args: tuple[str, ...] = ()
    code: str = field(default="", compare=False)


@dataclass(frozen=True)
class Extractor:
    css: str
    attr: str | None
    steps: tuple[Step, ...]


def split_steps(expr: str) -> tuple[str, list[tuple[str, str]]]:
    """(what stands before the first step, [(kind, code)])."""
    parts = re.split(r"@(js|java):", expr)
    codes = [code.strip().rstrip(";").strip() for code in parts[2::2]]
    return parts[0].strip(), list(zip(parts[1::2], codes, strict=True))


_STRING = r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')"""
_NAMED = re.compile(r"^(\w+)\((.*)\)$", re.S)
_PREFIX = re.compile(rf"^r\s*=\s*{_STRING}\s*\+\s*r$")
_REPLACE = re.compile(r"^r\s*=\s*r\.replace(?:All)?\(\s*(?:/((?:[^/\\]|\\.)*)/([gimsu]*)|" + _STRING + rf")\s*,\s*{_STRING}\s*\)$", re.S)


def _strings(text: str) -> tuple[str, ...]:
    return tuple(a or b for a, b in re.findall(_STRING, text))


def named_step(kind: str, code: str) -> Step:
    """The named step that a snippet stands for."""
    if kind == "java":
        if re.match(r"^base64\.decode\(\)$", code):
            return Step(kind, "base64", code=code)
        if code.startswith("string.replace(") and len(args := _strings(code)) == 2:
            return Step(kind, "regex_replace", args, code)
        return Step(kind, "", code=code)
    if m := _PREFIX.match(code):
        return Step(kind, "prefix", (m[1] or m[2] or "",), code)
    if m := _REPLACE.match(code):
        new = m[5] or m[6] or ""
        if m[1] is not None:
            flags = "".join(f for f in m[2] if f in "ims")
            return Step(kind, "regex_replace" if "g" in m[2] else "regex_replace_first", ((f"(?{flags})" if flags else "") + m[1], new), code)
        return Step(kind, "replace", (m[3] or m[4] or "", new), code)
    if (m := _NAMED.match(code)) and m[1] in ("prefix", "remove", "regex_remove", "unwrap_script_b64", "inline_b64", "visible_li_slice", "sort_by_data_id", "match1", "jsonp_field"):
        return Step(kind, m[1], _strings(m[2]), code)
    return Step(kind, "", code=code)


def parse(expr: str) -> Extractor:
    """Steps are split off first, then the last @ whose suffix is letters, digits or a dash."""
    head, codes = split_steps(expr)
    css, attr = head, None
    before, at, after = head.rpartition("@")
    if at and re.fullmatch(r"[A-Za-z0-9-]+", after.strip()):
        css, attr = before.strip(), after.strip()
    if attr is None and css.startswith("meta["):
        attr = "content"
    return Extractor(css, attr, tuple(named_step(*c) for c in codes))


SCRIPT_B64 = r"""(?is)<script[^>]*>[^<]*?\(\s*["']([A-Za-z0-9+/=]+)["']\s*\)[^<]*</script>"""


def decode_b64(text: str) -> str:
    out = []
    for token in re.findall(r"[A-Za-z0-9+/]+={0,2}", text):
        if len(token) % 4 == 0:
            try:
                out.append(base64.b64decode(token, validate=True).decode("utf-8", "replace"))
            except (binascii.Error, ValueError):
                continue
    return "".join(out)


def _java_groups(new: str) -> str:
    return re.sub(r"\$(\d)", r"\\g<\1>", new.replace("\\", "\\\\"))


def run(step: Step, r: str) -> str:
    """One step over a string, inside a batch."""
    a = step.args
    try:
        match step.name:
            case "prefix":
                return a[0] + r
            case "remove":
                return r.replace(a[0], "")
            case "replace":
                return r.replace(a[0], a[1], 1)
            case "regex_remove":
                return re.sub(a[0], "", r)
            case "regex_replace":
                return re.sub(a[0], _java_groups(a[1]), r)
            case "regex_replace_first":
                return re.sub(a[0], _java_groups(a[1]), r, count=1)
            case "base64":
                return decode_b64(r)
            case "unwrap_script_b64":
                return re.sub(SCRIPT_B64, r"\1", r)
            case "inline_b64":
                return re.sub(SCRIPT_B64, lambda m: decode_b64(m[1]), r)
            case "match1":
                m = re.search(a[0], r)
                return m[1] if m and m.re.groups else ""
            case "sort_by_data_id":
                found = re.findall(r"""(?is)<(\w+)[^>]*\bdata-id=["']?(\d+)["']?[^>]*>(.*?)</\1>""", r)
                return "".join(f"<p>{body}</p>" for _, _, body in sorted(found, key=lambda x: int(x[1])))
            case "visible_li_slice":
                items = re.findall(r"(?is)<li[^>]*>.*?</li>", r)
                head, tail = (int(x) for x in a)
                return "".join(items[head : len(items) - tail])
            case "jsonp_field":
                import json

                m = re.search(r"(?s)^[^(]*\((.*)\)[;\s]*$", r)
                return str(json.loads(m[1]).get(a[0], "")) if m else ""
    except (re.error, ValueError, IndexError):
        return r
    return r


def column(step: Step, r: Column) -> Column:
    """One step as a native expression; raises for steps that need a callback per match."""
    a = step.args
    match step.name:
        case "prefix":
            return F.concat(F.lit(a[0]), r)
        case "remove":
            return F.replace(r, F.lit(a[0]), F.lit(""))
        case "replace":  # the first occurrence only, as it stands
            at = F.instr(r, F.lit(a[0]))
            rest = F.substring(r, at + len(a[0]), F.char_length(r))
            return F.when(at > 0, F.concat(F.left(r, at - 1), F.lit(a[1]), rest)).otherwise(r)
        case "regex_remove":
            return T.filter_text(r, a[0])
        case "regex_replace":
            return F.regexp_replace(r, a[0], a[1])
        case "base64":
            return T.decode_base64_lines(r)
        case "unwrap_script_b64":
            return F.regexp_replace(r, SCRIPT_B64, "$1")
        case "match1":
            return F.regexp_extract(r, a[0], 1)
        case "jsonp_field":
            return F.coalesce(F.get_json_object(F.regexp_extract(r, r"(?s)^[^(]*\((.*)\)[;\s]*$", 1), f"$.{a[0]}"), F.lit(""))
        case "visible_li_slice":
            items = F.regexp_extract_all(r, F.lit(r"(?is)(<li[^>]*>.*?</li>)"), 1)
            head, tail = (int(x) for x in a)
            return F.concat_ws("", F.slice(items, F.lit(head + 1), F.greatest(F.size(items) - head - tail, F.lit(0))))
        case "sort_by_data_id":
            pattern = r"""(?is)<(\w+)[^>]*\bdata-id=["']?(\d+)["']?[^>]*>(.*?)</\1>"""
            pairs = F.arrays_zip(F.regexp_extract_all(r, F.lit(pattern), 2).alias("id"), F.regexp_extract_all(r, F.lit(pattern), 3).alias("body"))
            ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p["id"].cast("long").alias("id"), p["body"].alias("body"))))
            return F.concat_ws("", F.transform(ordered, lambda p: F.concat(F.lit("<p>"), p["body"], F.lit("</p>"))))
        case "":
            return r
    raise ValueError(f"{step.name} has no native form")
