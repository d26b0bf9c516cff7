"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are found leftmost and without overlap within their kind, and stay whatever their
score. Added kinds need a score of at least LEAST_SCORE: iban (mod-97 gives it), ssn and national phone numbers (context
words before them give it), and give way to a base span that they overlap. Everything is DataFrame code over whole texts; positions come from the lengths of matches and
of the gaps between them, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Patterns match the same spans as the stated ones but cannot backtrack far or recurse deeply on very long runs.
#: card: only runs of digits with 14 to 19 of them, as no other run can pass. iban: the first four characters; _RUN follows.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
}
#: The longest run of words in capitals and digits that an IBAN may take, from its start; other words may have run into it.
_RUN = "^[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
_RUN_CHARS = 68
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: Score of a confirmed span, words that raise it, words that lower it.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "tel": 0.4}
FOR = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security",
    "tel": "phone|call|tel|mobile|fax",
}
AGAINST = {
    "email": "example|noreply",
    "ip": "version|release|chapter|section",
    "card": "order|serial|isbn|tracking",
    "phone": "order|serial|isbn",
    "iban": "serial|isbn",
    "ssn": "serial|part number",
    "tel": "serial|isbn|part number",
}
NEAR = 40
RAISE, LOWER = 0.3, 0.3
LEAST_SCORE = 0.6
#: What must be in a text for a kind to be looked for at all.
HINT = {"email": "contains(__text, '@')", "phone": "contains(__text, '+')", "ip": "__text rlike '[0-9][.][0-9]'", "card": "__text rlike '[0-9](?:[ -]?[0-9]){13}'", "ssn": "__text rlike '[0-9]{3}-[0-9]{2}-'", "tel": "__text rlike '[0-9]{3}[. -][0-9]{4}'", "iban": "__text rlike '[A-Z]{2}[0-9]{2}'"}
_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _passes(kind: str, v: str) -> str:
    """SQL that confirms a match: its checksum or form."""
    if kind == "ip":
        return f"forall(split({v}, '[.]'), p -> p rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$' or p rlike '^0+$')"
    if kind == "card":
        n = _digits(v)
        one = f"cast(substr({n}, length({n}) - i + 1, 1) as int)"
        return f"aggregate(sequence(1, length({n})), 0, (luhn, i) -> luhn + if(i % 2 = 1, {one}, if({one} > 4, 2 * {one} - 9, 2 * {one}))) % 10 = 0"
    if kind == "phone":
        return f"length({_digits(v)}) between 10 and 15"
    if kind == "iban":
        c = f"replace({v}, ' ', '')"
        moved = f"concat(substr({c}, 5), left({c}, 4))"
        return f"length({c}) between 15 and 34 and aggregate(split({moved}, ''), 0, (rest, c) -> if(c = '', rest, if(c between '0' and '9', (rest * 10 + ascii(c) - 48) % 97, (rest * 100 + ascii(c) - 55) % 97))) = 1"
    return "true"


def _proposed(kind: str) -> str:
    """SQL: array of confirmed spans of one kind in column __text."""
    literal = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    none = f"cast(array() as array<{_SPAN}>)"
    found, gaps = f"regexp_extract_all(__text, '{literal}', 0)", f"split(__text, '{literal}', -1)"
    spans = f"""transform(array(named_struct('m', {found}, 'g', transform({gaps}, x -> length(x)))), z ->
      aggregate(if(size(z.m) = 0, cast(array() as array<int>), sequence(1, size(z.m))), named_struct('at', 0L, 'out', {none}),
        (a, i) -> named_struct('at', a.at + z.g[i - 1] + length(z.m[i - 1]), 'out', concat(a.out, array(
          named_struct('kind', '{kind}', 'start', a.at + z.g[i - 1], 'end', a.at + z.g[i - 1] + length(z.m[i - 1]), 'value', z.m[i - 1])))),
        a -> a.out))[0]"""
    confirmed = _cut_ibans(spans, none) if kind == "iban" else f"filter({spans}, s -> {_passes(kind, 's.value')})"
    return f"if({HINT[kind]}, {confirmed}, {none})"


def _cut_ibans(spans: str, none: str) -> str:
    """SQL: from each start, the longest run of whole words that passes; leftmost first and without overlap."""
    run = f"split(regexp_extract(substr(__text, cast(s.start + 1 as int), {_RUN_CHARS}), '{_RUN}', 0), ' ')"
    ends = f"filter(transform(sequence(size(w), 1, -1), k -> concat_ws(' ', slice(w, 1, k))), v -> {_passes('iban', 'v')})"
    cut = f"""flatten(transform({spans}, s -> flatten(transform(array({run}), w -> transform(slice({ends}, 1, 1),
      v -> named_struct('kind', 'iban', 'start', s.start, 'end', s.start + length(v), 'value', v))))))"""
    return f"aggregate({cut}, {none}, (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).end, a, concat(a, array(s))))"


def _scored(kind: str, spans: str) -> str:
    before = f"lower(substr(__text, cast(greatest(s.start - {NEAR}, 0) + 1 as int), cast(least(s.start, {NEAR}) as int)))"
    score = f"{SCORE[kind]}D + if({before} rlike '\\\\b(?:{FOR[kind]})\\\\b', {RAISE}D, 0D) - if({before} rlike '\\\\b(?:{AGAINST[kind]})\\\\b', {LOWER}D, 0D)"
    scored = f"transform({spans}, s -> named_struct('start', s.start, 'nth', {KINDS.index(kind)}, 'kind', '{kind}', 'end', s.end, 'value', s.value, 'score', round(greatest(0D, least(1D, {score})), 2)))"
    return scored if kind in BASE else f"filter({scored}, s -> s.score >= {LEAST_SCORE}D)"


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with `spans`: array<struct<start, nth, kind, end, value, score>>, sorted by start, then kind.

    Start counts code points from 0, end is exclusive. Null texts count as empty and have no span. Spans of different kinds
    may overlap. A column of docs called spans is replaced; all others stay.
    """
    text = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    each = [F.expr(_scored(kind, f"__{kind}")) for kind in KINDS]
    proposed = text.withColumns({f"__{kind}": F.expr(_proposed(kind)) for kind in KINDS})
    proposed = proposed.withColumn("__base", F.concat(*each[: len(BASE)]))
    added = F.expr("filter(__added, s -> not exists(__base, b -> b.start < s.end and s.start < b.end))")
    proposed = proposed.withColumn("__added", F.concat(*each[len(BASE) :]))
    spans = F.array_sort(F.concat("__base", added))
    return proposed.withColumn("spans", spans).drop("__text", "__base", "__added", *(f"__{kind}" for kind in KINDS))


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; n_chars follows where there is such a column.

    Of overlapping spans, what an earlier one left uncovered is cut away as well, under the earlier one's mark. Null texts
    stay null.
    """
    found = find_pii(docs)
    # spans that begin within an earlier one widen it
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint,kind:string>>), (a, s) ->
      if(size(a) > 0 and s.start < element_at(a, -1).end,
         concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))),
         concat(a, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))))""")
    pieces = F.expr("""concat_ws('', transform(__merged, (s, i) -> concat(
      substr(text, cast(if(i = 0, 0, __merged[i - 1].end) + 1 as int), cast(s.start - if(i = 0, 0, __merged[i - 1].end) as int)), '<', upper(s.kind), '>')),
      substr(text, cast(element_at(__merged, -1).end + 1 as int)))""")
    masked = found.withColumn("__merged", merged).withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(pieces))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return masked.select(*docs.columns)


def op3_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("spans"), BASE), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """DuckDB: doc_rid, kind, nth, start, end and value of the confirmed matches of one kind."""
    return f"""
  SELECT rid, '{kind}' kind, {KINDS.index(kind)} nth, beg AS start_, beg + length(v) AS end_, v, t FROM (
    SELECT rid, t, v, g + coalesce(sum(g + length(v)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT beg FROM (
      SELECT rid, t, unnest(m) v, unnest(range(1, len(m) + 1)) i, unnest([length(x) FOR x IN gaps[1:len(m)]]) g
      FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') m, regexp_split_to_array(t, '{pattern}') gaps FROM docs) WHERE len(m) > 0))
  WHERE {keep}"""


_SQL_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_BARE = "replace(v, ' ', '')"
_SQL_KEEP = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len([p FOR p IN string_split(v, '.') IF length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 0) > 255]) = 0"),
    "card": (
        "[0-9]([ -]?[0-9])+",
        f"length({_SQL_DIGITS}) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END FOR d, i IN [x::INT FOR x IN string_split(reverse({_SQL_DIGITS}), '')]]) % 10 = 0",
    ),
    "phone": ("\\+[0-9][ ().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 10 AND 15"),
}


def _sql_before() -> str:
    return f"lower(substring(t, greatest(start_ - {NEAR}, 0) + 1, least(start_, {NEAR})))"


OP3_SQL = f"""
WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(k, *_SQL_KEEP[k]) for k in BASE)}),
per AS (
  SELECT rid, count(*) FILTER (kind = 'email') n_email, count(*) FILTER (kind = 'ip') n_ip, count(*) FILTER (kind = 'card') n_card,
         count(*) FILTER (kind = 'phone') n_phone, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, nth) base FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
       sha256(coalesce(base, '')) base_sha256, coalesce(base, '') spans
FROM docs LEFT JOIN per USING (rid)
"""
