"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built from Spark's own string and array functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, quoted, unused

# The four base kinds of the contract and three kinds that the method adds. The patterns
# accept the contract's language; look-behinds and possessive quantifiers only keep them linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:[Pp]assword|[Ss]ecret|[Tt]oken|[Aa]pi_key)\x20?[=:]\x20?\x22?[A-Za-z0-9_-]{12,}",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Texts without this character can't hold the kind.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Score of a confirmed span, what a context word near it adds, and those words.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write|address"),
    "ip": (0.6, 0.3, r"\bip\b|server|host|address|login"),
    "card": (0.7, 0.3, "card|visa|master|amex|credit|payment"),
    "phone": (0.6, 0.3, "phone|call|tel|mobile|fax|whatsapp"),
    "iban": (0.8, 0.2, "iban|bank|account|konto|cuenta|compte"),
    "ssn": (0.3, 0.5, r"\bssn\b|social security|tax id"),
    "secret": (0.7, 0.2, "key|token|login|secret|password"),
}
ADDED_AT_LEAST = 0.5
CONTEXT_CHARS = 40
#: Texts are cut into blocks of this many characters where places in them are looked up.
BLOCK_CHARS = 1024
# Lengths of IBANs by country, as registered.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _running(values: Column, zero: int, op) -> Column:
    """For each place of an int array, ``op`` over all that stands before it; square-root blocks keep it near linear."""
    total = lambda x: F.aggregate(x, F.lit(zero), op)

    def of(v: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: total(F.slice(v, b * width + 1, width)))
        return let(blocks, lambda made: F.transform(v, lambda _, i: before(v, made, width, i)))

    def before(v: Column, made: Column, width: Column, i: Column) -> Column:
        whole = F.floor(i / width).cast("int")
        return op(total(F.slice(made, F.lit(1), whole)), total(F.slice(v, whole * width + 1, i % width)))

    some = let(values, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: of(v, width)))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    return _running(values, 0, lambda a, b: a + b)


def in_blocks(text: Column) -> Column:
    """A text in pieces of BLOCK_CHARS, so that a place far into it is reached without walking through it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def part_of(blocks: Column, begin: Column, end: Column) -> Column:
    """The characters ``[begin, end)`` of a text in blocks; nothing behind its end."""
    width = F.lit(BLOCK_CHARS)
    at = lambda place: F.floor(place / width).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    same = F.substring(block(at(begin)), begin % width + 1, end - begin)
    first, last = F.substring(block(at(begin)), begin % width + 1, width), F.substring(block(at(end)), F.lit(1), end % width)
    between = F.slice(blocks, at(begin) + 2, F.greatest(at(end) - at(begin) - 1, F.lit(0)))
    return F.when(at(begin) == at(end), same).otherwise(F.concat(first, F.array_join(between, ""), last))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    def add(d: Column, acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return let(_digits(value), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: add(d, acc, i)) % 10 == 0)


def mod97_ok(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(t: Column, acc: Column, i: Column) -> Column:
        place = F.instr(F.lit(_ALNUM), F.substring(t, i, F.lit(1))) - 1
        return ((acc * F.when(place > 9, 100).otherwise(10) + place) % 97).cast("int")

    rest = let(turned, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda acc, i: add(t, acc, i)))
    return F.length(plain).between(15, 34) & (rest == 1)


def _own_length(iban: Column) -> Column:
    """A proposed IBAN up to the blank at which its country's length is reached; as it is where none is or the country isn't listed."""
    at = F.instr(F.lit(IBAN_LENGTHS), F.substring(iban, 1, 2))
    length = F.when(at > 0, F.substring(F.lit(IBAN_LENGTHS), at + 2, F.lit(2)).cast("int"))
    ends = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))
    fits = let(F.split(iban, " "), lambda parts: F.filter(ends(parts), lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))) == length))
    return F.coalesce(F.get(fits, F.lit(0)), iban)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & luhn_ok(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97_ok(value)
    if kind == "secret":
        return value.rlike("[0-9]")
    return F.lit(True)


def _proposed(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<value, start>>``; starts in code points."""

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: g + F.length(v))
        starts = F.zip_with(running_sums(steps), F.slice(gaps, F.lit(1), F.size(found)), lambda s, g: s + g)
        return F.zip_with(found, starts, lambda v, s: F.struct(v.alias("value"), s.alias("start")))

    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.length(x))
    may = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    return F.when(may & text.rlike(PATTERNS[kind]), let(found, lambda f: let(gaps, lambda g: placed(f, g))))


def _scored(blocks: Column, kind: str, spans: Column) -> Column:
    base, more, words = SCORES[kind]

    def one(s: Column) -> Column:
        start, end = s["start"], s["start"] + F.length(s["value"])
        near = F.concat_ws(" ", part_of(blocks, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start), part_of(blocks, end, end + CONTEXT_CHARS))
        score = F.when(F.lower(near).rlike(words), F.lit(base + more)).otherwise(F.lit(base))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), s["value"].alias("value"), score.alias("score"))

    if kind == "iban":
        spans = F.transform(spans, lambda s: F.struct(_own_length(s["value"]).alias("value"), s["start"].alias("start")))
    kept = F.filter(spans, lambda s: confirmed(kind, s["value"]))
    out = F.transform(kept, one)
    return out if kind in BASE_KINDS else F.filter(out, lambda s: s["score"] >= ADDED_AT_LEAST)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: ``array<struct<kind, start, end, value, score>>`` by kind (base kinds first), then start.

    Null and empty texts have an empty array. Starts and ends are code points, ends exclusive.
    Base kinds stay whatever their score; the added kinds need ``ADDED_AT_LEAST``. Whole texts are searched.
    Repeated rows are kept as they are, an empty table stays empty; other columns of any name pass through;
    ``out`` replaces a column of that name.
    """
    t = F.coalesce(quoted(text), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    wide, own = docs, dict(zip(PATTERNS, unused(docs, *PATTERNS), strict=True))
    for kind, name in own.items():
        wide = wide.withColumn(name, _proposed(t, kind))
    some = F.coalesce(*[F.col(name) for name in own.values()]).isNotNull()
    parts = lambda blocks: F.concat(*[F.when(F.col(name).isNotNull(), _scored(blocks, kind, F.col(name))).otherwise(none) for kind, name in own.items()])
    return wide.withColumn(out, F.when(some, let(in_blocks(t), parts)).otherwise(none)).drop(*own.values())


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each found span by ``<KIND>``; overlapping spans become one replacement named after the first.

    Texts without spans, null and empty ones among them, stay as they are, as do all other columns, repeated
    rows and empty tables; very long texts are rewritten whole.
    """
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    one = lambda s, covered: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), covered.alias("covered"))

    def rewritten(blocks: Column, found: Column) -> Column:
        ends = F.transform(found, lambda s: s["end"])
        placed = F.zip_with(found, _running(ends, 0, lambda a, b: F.greatest(a, b)), one)
        # a span that begins before an earlier one has ended is part of that one's replacement
        kept = F.filter(placed, lambda s: s["start"] >= s["covered"])
        pieces = F.transform(kept, lambda s: F.concat(part_of(blocks, s["covered"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        end = F.array_max(ends)
        rest = part_of(blocks, end, F.greatest(end, F.size(blocks) * BLOCK_CHARS))
        return F.concat(F.array_join(pieces, ""), rest)

    new = let(in_blocks(quoted(text)), lambda blocks: let(F.array_sort(F.col(spans), order), lambda found: rewritten(blocks, found)))
    return docs.withColumn(text, F.when(F.size(F.col(spans)) > 0, new).otherwise(quoted(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the op10 contract, one row per document; null and empty texts have none of any kind, an empty table has no row."""
    found = find_pii(docs).select("doc_id", "pii")
    base = F.filter(F.col("pii"), lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter(F.col("pii"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _oracle() -> str:
    """DuckDB SQL for the report: gaps and matches of each pattern alternate, hence starts are sums of lengths."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": PATTERNS["iban"].replace(r"\x20", " "),
        "ssn": PATTERNS["ssn"],
        "secret": PATTERNS["secret"],
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = f"cast(substr({digits}, len({digits}) - cast(i as int), 1) as int)"
    luhn = f"list_sum(list_transform(range(len({digits})), lambda i: case when i % 2 = 0 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0"
    bare = "replace(v, ' ', '')"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    places = f"list_transform(range(1, len({turned}) + 1), lambda i: strpos('{_ALNUM}', substr({turned}, cast(i as int), 1)) - 1)"
    mod97 = f"list_reduce(list_prepend(0, {places}), lambda a, b: (a * case when b > 9 then 100 else 10 end + b) % 97) = 1"
    near = f"lower(substr(t, greatest(pos - {CONTEXT_CHARS}, 0) + 1, pos - greatest(pos - {CONTEXT_CHARS}, 0)) || ' ' || substr(t, pos + len(v) + 1, {CONTEXT_CHARS}))"
    valid = {
        "email": "true",
        "ip": f"regexp_full_match(v, '(?:{_BYTE}\\.){{3}}{_BYTE}')",
        "card": f"len({digits}) between 13 and 19 and {luhn}",
        "phone": f"len({digits}) between 9 and 15",
        "iban": f"len({bare}) between 15 and 34 and {mod97}",
        "ssn": f"regexp_matches({near}, '{SCORES['ssn'][2]}')",
        "secret": "regexp_matches(v, '[0-9]')",
    }
    length = f"case when strpos('{IBAN_LENGTHS}', substr(m[i], 1, 2)) > 0 then cast(substr('{IBAN_LENGTHS}', strpos('{IBAN_LENGTHS}', substr(m[i], 1, 2)) + 2, 2) as int) end"
    ends = "list_transform(range(1, len(string_split(m[i], ' ')) + 1), lambda j: array_to_string(string_split(m[i], ' ')[1:j], ' '))"
    own = {"iban": f"coalesce(list_filter({ends}, lambda x: len(replace(x, ' ', '')) = {length})[1], m[i])"}
    parts = []
    for n, (kind, pattern) in enumerate(plain.items()):
        parts.append(
            f"""select r, {n} as k, '{kind}' as kind, pos, v from (
    select r, t, {own.get(kind, "m[i]")} as v, cast(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as int) as pos from (
        select r, t, m, g, unnest(range(1, len(m) + 1)) as i from (
            select r, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d))) where {valid[kind]}"""
        )
    listed = "string_agg(kind || ':' || pos || ':' || (pos + len(v)), ',' order by k, pos)"
    return f"""with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
s as ({" union all ".join(parts)}),
a as (select r, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_KINDS)}, {listed} filter (where k < {len(BASE_KINDS)}) as base, {listed} as spans from s group by 1)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (r)"""


ORACLE_SQL = _oracle()
