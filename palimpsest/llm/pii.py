"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Patterns of the kinds email, ip, card and phone give base spans where their own rule holds (parts of an address, digits, Luhn); these
are always reported. Further proposals are scored: the weight of their pattern, raised by a checksum that holds (Luhn, mod 97) and by
words nearby that name such data, lowered by words that name other numbers. Those of `least` or more that touch no base span
and no better proposal that starts before them are added:

- card: 12 to 19 digits without gaps inside a longer run of numbers, by Luhn and an issuer's first digit
- iban: an account number, by mod 97 and its country's length
- ip: an address of version 6, written in full
- phone: a number without a plus sign, by words nearby
- tax: numbers grouped 3-2-4 as of social insurance, by words nearby

Every pattern is written so that no position is tried twice at length: a match starts where its run starts, or where the match before
ended, and repeats never give back. That finds what the plain patterns find, in time linear in the text.

Positions are code points, the end exclusive. Defined cases: null counts as empty and has no spans; rows that repeat an id, a null
one included, each get a row; an empty table gives an empty result; other columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import cut

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "tax")

# The patterns. An e-mail's is that of its domain; its local part is the run before the at sign, back to the match before at most.
LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?!\G)@(?<=[{LOCAL}]@)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "card": r"[0-9](?<![0-9][0-9])[0-9]{11,18}+(?![0-9])",
    "iban": r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}+){2,7}+(?:\x20[A-Z0-9]{1,3}+)?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"[(0-9](?<![0-9+(.-].)(?:(?<=\()[0-9]{2,4}\)\x20?|(?<=[0-9])[0-9]{1,3}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}+(?![0-9-])",
    "tax": r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried on it, where that is far quicker to see.
SIGNS = {"base_email": "@", "base_ip": r"[0-9]\.[0-9]", "more_iban": "[A-Z][A-Z][0-9][0-9]", "more_ip": ":[0-9A-Fa-f]{1,4}:", "more_card": "[0-9]{12}"}
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: What a pattern alone is worth, and what its checksum adds.
WEIGHTS = {"email": (0.8, 0.0), "ip": (0.6, 0.0), "card": (0.3, 0.3), "phone": (0.4, 0.0), "iban": (0.2, 0.6), "tax": (0.3, 0.0)}
PLUS, MINUS, NEAR = 0.3, 0.4, 48
#: Words that name a kind, and words that name other numbers.
NAMING = {
    "email": "mail|email|e-mail|contact|correo|courriel",
    "ip": "ip|host|server|client|addr|address|login",
    "card": "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|telephone|mobile|cell|call|fax|fon|telefon|handy|téléphone|teléfono|móvil|appelez|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "tax": "ssn|social|security|insurance|tax|taxpayer",
}
OTHER = "version|release|isbn|issn|order|invoice|tracking|serial|article|patent|build"
#: Matches that are taken at once where a text has many.
CHUNK = 1024
PROPOSALS = "array<struct<start: int, end: int, token: string, near: string>>"
SPAN = "struct<start: int, ord: int, end: int, score: double>"


def digits_of(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, the last one a check digit, pass Luhn's test."""
    back = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when its first four characters stand last and letters count from 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    values = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1)
    return F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def proposed(found: Column, between: Column, lead: str = "") -> Column:
    """(start, end, token, near) of matches, from these and the pieces of text between them; near is the text beside a match.
    With lead, a class of characters, the run of these before a match belongs to it.

    Places are summed in chunks, so that no long array grows by one.
    """
    n = F.size(found)
    rows = F.arrays_zip(F.slice(between, 1, n).alias("gap"), F.slice(between, 2, n).alias("next"), found.alias("token"))
    near = lambda x: F.lower(F.concat_ws(" ", F.right(x["gap"], F.lit(NEAR)), F.left(x["next"], F.lit(NEAR))))
    if lead:
        own = lambda x: F.reverse(F.regexp_extract(F.reverse(x["gap"]), f"^[{lead}]+", 0))
        rows = F.transform(rows, lambda x: F.struct(x["gap"].alias("all"), x["next"].alias("next"), own(x).alias("own"), x["token"].alias("token")))
        rows = F.transform(rows, lambda x: F.struct(F.left(x["all"], F.length(x["all"]) - F.length(x["own"])).alias("gap"), x["next"].alias("next"), F.concat(x["own"], x["token"]).alias("token")))
    rows = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("skip"), F.length(x["token"]).alias("size"), x["token"].alias("token"), near(x).alias("near")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["token"].alias("token"), x["near"].alias("near"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def add_chunk(state: Column, chunk: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(PROPOSALS).alias("out"))
        inner = F.transform(F.array(F.aggregate(chunk, start, add)), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))
        return F.element_at(inner, 1)

    chunks = F.transform(F.array(rows), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, CHUNK)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PROPOSALS}>").alias("out"))
    placed = F.aggregate(F.element_at(chunks, 1), none, add_chunk, lambda s: F.flatten(s["out"]))
    return F.when(n > 0, placed).otherwise(F.array().cast(PROPOSALS))


def holds(kind: str, token: Column) -> Column:
    """The rule that a base span's match must keep; a match that fails gives no span."""
    size = F.length(digits_of(token))
    if kind == "ip":
        return F.forall(F.split(token, r"\."), lambda part: part.rlike(PART))
    if kind == "card":
        return size.between(12, 19) & luhn(digits_of(token))
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def scored(kind: str, x: Column, checked: Column) -> Column:
    """The proposal's score: its pattern's weight, its checksum's where that holds, and what words nearby add and take."""
    pattern, checksum = WEIGHTS[kind]
    word = lambda words: x["near"].rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})")
    score = pattern + F.when(checked, checksum).otherwise(0.0) + F.when(word(NAMING[kind]), PLUS).otherwise(0.0) - F.when(word(OTHER), MINUS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def _span(kind: str, x: Column, end: Column, score: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), score.alias("score")).cast(SPAN)


def confirmed(kind: str, found: Column) -> Column:
    """Base spans: the matches that keep their kind's rule."""
    return F.transform(F.filter(found, lambda x: holds(kind, x["token"])), lambda x: _span(kind, x, x["end"], scored(kind, x, F.lit(True))))


def further(kind: str, found: Column) -> Column:
    """Scored spans of further proposals."""
    if kind == "iban":
        known = F.expr(f"map({', '.join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())})")

        def cut_to_length(x: Column) -> Column:
            size = F.element_at(known, F.substring(x["token"], 1, 2))
            token = F.call_function("regexp_extract", x["token"], F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), F.coalesce(size, F.lit(34)).cast("string"), F.lit("}")), F.lit(0))
            return F.struct(x["start"].alias("start"), token.alias("token"), F.regexp_replace(token, " ", "").alias("account"), x["near"].alias("near"))

        spans = F.transform(F.transform(found, cut_to_length), lambda x: F.when(F.length(x["account"]) > 0, _span(kind, x, x["start"] + F.length(x["token"]), scored(kind, x, mod97(x["account"])))))
        return F.array_compact(spans)
    checked = {"card": lambda x: luhn(x["token"]) & x["token"].rlike("^[3-6]")}.get(kind, lambda x: F.lit(False))
    return F.transform(found, lambda x: _span(kind, x, x["end"], scored(kind, x, checked(x))))


def before(spans: Column, value: Column) -> Column:
    """How many of the spans, sorted by start, start before a value: a binary search."""

    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        below = F.get(spans, middle)["start"] < value
        going = state["low"] < state["high"]
        return F.struct(F.when(going & below, middle + 1).otherwise(state["low"]).alias("low"), F.when(going & ~below, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda s: s["low"])


def taken(spans: Column) -> Column:
    """Of spans sorted by start, those that start at or after the end of the one taken before them."""
    kind = f"array<{SPAN}>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda k: F.slice(spans, k * CHUNK + 1, CHUNK))

    def add(s: Column, x: Column) -> Column:
        free = x["start"] >= s["at"]
        return F.struct(F.when(free, x["end"]).otherwise(s["at"]).alias("at"), F.when(free, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    def add_chunk(s: Column, chunk: Column) -> Column:
        inner = F.transform(F.array(F.aggregate(chunk, F.struct(s["at"].alias("at"), F.array().cast(kind).alias("out")), add)), lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out")))
        return F.element_at(inner, 1)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(chunks, start, add_chunk, lambda s: F.flatten(s["out"]))).otherwise(spans)


def spotted(rows: DataFrame, text: Column, least: float, keep: list[str]) -> DataFrame:
    """rows' columns `keep`, base: the base spans by kind, and more: further spans. Each step is a projection of its own, so that none is computed twice."""
    patterns = {f"base_{k}": p for k, p in BASE.items()} | {f"more_{k}": p for k, p in FURTHER.items()}
    found = rows.select(*keep, text.alias("__text"))
    tried = lambda k, hits: F.when(F.col("__text").rlike(SIGNS[k]), hits).otherwise(F.array().cast("array<string>")) if k in SIGNS else hits
    found = found.select("*", *(tried(k, F.regexp_extract_all("__text", F.lit(p), F.lit(0))).alias(f"__hit_{k}") for k, p in patterns.items()))
    found = found.select("*", *(F.when(F.size(f"__hit_{k}") > 0, F.split("__text", p, -1)).alias(f"__gap_{k}") for k, p in patterns.items()))
    found = found.select(*keep, *(proposed(F.col(f"__hit_{k}"), F.col(f"__gap_{k}"), LOCAL if k == "base_email" else "").alias(f"__{k}") for k in patterns))
    base = {k: confirmed(k, F.col(f"__base_{k}")) for k in BASE}
    more = reduce(F.concat, (further(k, F.col(f"__more_{k}")) for k in FURTHER))
    found = found.select(*keep, *(v.alias(f"__base_{k}") for k, v in base.items()), F.array_sort(F.filter(more, lambda s: s["score"] >= least)).alias("__more"))
    # A base span that starts before another of its kind ends before it too, so one look per kind finds an overlap.
    clear = lambda s: reduce(lambda a, b: a & b, (~F.coalesce(F.get(F.col(f"__base_{k}"), before(F.col(f"__base_{k}"), s["end"]) - 1)["end"] > s["start"], F.lit(False)) for k in BASE))
    found = found.withColumn("__more", F.when(F.size("__more") > 0, F.filter("__more", clear)).otherwise(F.col("__more")))
    return found.select(*keep, F.array_sort(F.concat(*(f"__base_{k}" for k in BASE))).alias("base"), taken(F.col("__more")).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, ord, end, score), sorted; ord is the kind's place in KINDS. spans holds the base spans and those added."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spotted(rows, F.col("text"), least, ["doc_id"])
    return found.select("doc_id", "base", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", by: str = "[PERSONAL]", least: float = 0.6) -> DataFrame:
    """docs with all personal data in the text replaced; texts without any, and all other columns, stay as they are."""
    row, text = F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("whole")
    rows = docs.select(row, text)
    found = spotted(rows, F.col("whole"), least, ["row", "whole"])
    plain = F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    found = found.select("row", "whole", F.array_sort(plain).alias("spans"))
    clean = F.when(F.size("spans") > 0, cut(F.col("whole"), F.col("spans"), by)).otherwise(F.col("row")[text_col])
    return found.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["ord"] == KINDS.index(kind))).cast("long")
