"""Secret scans: patterns, and a battery of randomness tests on long tokens. DataFrame functions only.

Patterns give spans of the kinds assign, access and hex. The battery looks at the other tokens of 20 or more characters of the base64
alphabets that have a digit, as a random one of this length all but surely has; one may follow an equals sign. The encoding is inferred from
a token's characters as the smallest alphabet that holds them: hex, base32 or base36 in upper or lower case, base62 or
base64 (also the URL form). Nothing else is asked of a token before it is tested. Under the hypothesis that a token is drawn evenly from its
alphabet there are five p-values: a chi-squared test of the characters (by its exact mean and variance), one of the shares of
digits, upper and lower case, a runs test about the middle of the alphabet, a lag-one serial correlation, and the excess of vowels that words have. They are
combined by their mean Cauchy transform, which holds for dependent tests.

False discoveries of order are controlled for all tokens of the corpus, by length: tokens are in strata of encoding and
length (powers of two), and in each the Benjamini-Hochberg rule at `q` gives the p-value below which tokens count as
ordered; only counts of p-values on a fixed grid leave the tasks. Tokens at or below that or below `least_p` are ordinary
text; what remains is random, a span of the kind `random`, unless it overlaps a pattern's span. Tokens that carry under
`least_bits` bits are too short to tell and are left out.

Positions are code points, the end exclusive. Defined cases: null counts as empty and has no spans; rows that repeat an id,
a null one included, each get a row; an empty table gives an empty result; other columns are kept by redact() and ignored by find().
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .common import fresh

# The patterns, and the kinds in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", string.digits + "abcdef"),
    "HEX": (r"^[0-9A-F]+$", string.digits + "ABCDEF"),
    "b32": (r"^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    "b32l": (r"^[a-z2-7]+$", string.ascii_lowercase + "234567"),
    "B36": (r"^[A-Z0-9]+$", string.ascii_uppercase + string.digits),
    "b36": (r"^[a-z0-9]+$", string.ascii_lowercase + string.digits),
    "b62": (r"^[A-Za-z0-9]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits),
    "b64": (r"^[A-Za-z0-9+/]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
}
#: Characters of a case: their pattern's negation, and which of an alphabet they are.
CASES = {"digits": ("[^0-9]", str.isdigit), "upper": ("[^A-Z]", str.isupper), "lower": ("[^a-z]", str.islower)}
#: p-values are counted on a grid of halves of powers of two.
STEPS = 80
SPANS = "array<struct<start: int, ord: int, end: int, token: string>>"
#: Matches, or characters, that are taken at once where a text has many.
CHUNK = 1024


def located(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """Spans of a pattern's matches: the text between matches gives the places. Matches are taken in chunks, so that no long array grows by one."""
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("token"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda k: k * CHUNK + 1)
    chunks = F.transform(chunks, lambda at: F.slice(pairs, at, CHUNK))

    def after(state: Column, chunk: Column) -> Column:
        last = F.element_at(state, -1)
        return F.concat(state, F.array(F.aggregate(chunk, last, lambda n, x: n + F.length(x["gap"]) + F.length(x["token"]))))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["token"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), pair["token"].alias("token"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    empty = F.array().cast(SPANS)
    starts = F.aggregate(chunks, F.array(F.lit(0)), after)
    spans = F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(F.coalesce(chunk, F.slice(pairs, 1, 0)), F.struct(at.alias("at"), empty.alias("out")), add, lambda s: s["out"]))
    return F.when(F.size(found) > 0, F.flatten(spans)).otherwise(empty)


def before(spans: Column, value: Column) -> Column:
    """How many of the spans, sorted by start, start before a value: a binary search."""

    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        below = F.get(spans, middle)["start"] < value
        open_ = state["low"] < state["high"]
        low = F.when(open_ & below, middle + 1).otherwise(state["low"])
        return F.struct(low.alias("low"), F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda s: s["low"])


def tail(z: Column) -> Column:
    """Both tails of the normal distribution beyond |z| (a rational approximation, good to 1e-7)."""
    z = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / 2.5066282746310002 * series)


def inferred(token: Column) -> Column:
    """The smallest alphabet that holds the token: ENCODINGS are in order of size."""
    return reduce(lambda out, e: F.when(token.rlike(ENCODINGS[e][0]), F.lit(e)).otherwise(out), reversed(ENCODINGS), F.lit("b64"))


def alphabet_of(encoding: Column) -> Column:
    """What the battery needs of an encoding's alphabet: its characters, and how many there are of each case."""

    def entry(alphabet: str) -> Column:
        sizes = {case: sum(map(test, alphabet)) for case, (_, test) in CASES.items()}
        free = max(1, sum(map(bool, sizes.values())) - 1)
        values = {"chars": alphabet, "k": float(len(alphabet)), "free": float(free), "vowels": float(sum(c in "aeiouAEIOU" for c in alphabet))} | {c: float(n) for c, n in sizes.items()}
        return F.struct(*(F.lit(v).alias(name) for name, v in values.items()))

    return F.element_at(F.create_map(*(x for e, (_, a) in ENCODINGS.items() for x in (F.lit(e), entry(a)))), encoding)


def counted(token: Column, of: Column) -> Column:
    """What the battery counts in one token: its characters' places in the alphabet, and those of each case."""
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(of["chars"], c).cast("double") - 1)
    cases = {case: F.length(F.regexp_replace(token, others, "")).cast("double") for case, (others, _) in CASES.items()}
    cases["vowels"] = F.length(F.regexp_replace(token, "[^aeiouAEIOU]", "")).cast("double")
    return F.struct(F.length(token).cast("double").alias("n"), places.alias("x"), *(v.alias(k) for k, v in cases.items()))


def summed(seen: Column, k: Column) -> Column:
    """(squares, runs, serial): the sum of squared character counts, changes of side about the alphabet's middle, and products of neighbours."""
    zero = F.lit(0.0)
    none = F.lit(-1.0)

    def equal(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1.0)
        return F.struct(x.alias("last"), run.alias("run"), (s["sum"] + 2 * run - 1).alias("sum"))

    def beside(s: Column, x: Column) -> Column:
        off = x - (k - 1) / 2
        first = s["last"].isNull()
        runs = s["runs"] + F.when(first | ((off > 0) == (s["last"] > 0)), 0.0).otherwise(1.0)
        return F.struct(off.alias("last"), runs.alias("runs"), (s["serial"] + F.when(first, 0.0).otherwise(off * s["last"])).alias("serial"))

    squares = F.aggregate(F.array_sort(seen["x"]), F.struct(none.alias("last"), zero.alias("run"), zero.alias("sum")), equal, lambda s: s["sum"])
    start = F.struct(F.lit(None).cast("double").alias("last"), zero.alias("runs"), zero.alias("serial"))
    pair = F.aggregate(seen["x"], start, beside)
    return F.struct(squares.alias("squares"), pair["runs"].alias("runs"), pair["serial"].alias("serial"))


def p_value(n: Column, of: Column, seen: Column, sums: Column) -> Column:
    """The battery's five tests as normal deviates, and their combined p-value."""
    k = of["k"]
    chi = (k / n * sums["squares"] - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
    share = reduce(lambda a, b: a + b, (F.when(of[c] > 0, F.pow(seen[c] - n * of[c] / k, 2) / (n * of[c] / k)).otherwise(0.0) for c in CASES))
    rate = of["vowels"] / k
    deviates = F.array(
        F.greatest(F.lit(0.0), (seen["vowels"] - n * rate) / F.sqrt(n * rate * (1 - rate))),
        F.greatest(F.lit(0.0), chi),
        F.greatest(F.lit(0.0), F.sqrt(2 * share) - F.sqrt(2 * of["free"] - 1)),
        (sums["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4),
        sums["serial"] / ((k * k - 1) / 12) / F.sqrt(n - 1),
    )
    turned = F.transform(deviates, lambda z: F.tan((0.5 - F.greatest(F.lit(1e-14), F.least(tail(z), F.lit(0.999)))) * F.pi()))
    return 0.5 - F.atan(F.aggregate(turned, F.lit(0.0), lambda a, c: a + c) / 5) / F.pi()


def tested(token: Column, encoding: Column) -> Column:
    """The combined p-value of one token under its encoding's alphabet. Steps are lambdas over one value, so that none is written out twice."""
    only = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return only(alphabet_of(encoding), lambda of: only(counted(token, of), lambda seen: only(summed(seen, of["k"]), lambda sums: p_value(seen["n"], of, seen, sums))))


def spotted(docs: DataFrame, text: Column, least_bits: float, row: str) -> DataFrame:
    """docs with one more column `row`: base, the patterns' spans, and tokens: candidates with their stratum, p-value and whether a pattern's span overlaps them."""
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    spans = {k: located(text, p, F.regexp_extract_all(text, F.lit(p), F.lit(0)), k) for k, p in kinds.items()}
    spans["assign"] = F.filter(spans["assign"], lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 6)
    spans["access"] = F.filter(spans["access"], lambda s: F.length(s["token"]) >= 20)
    found = located(text, TOKEN, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), "random")
    bits = F.create_map(*(F.lit(x) for e, (_, a) in ENCODINGS.items() for x in (e, math.log2(len(a)))))

    def judged(s: Column) -> Column:
        token = F.translate(s["token"], "-_", "+/")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), token.alias("token"), inferred(token).alias("encoding"))

    def weighed(s: Column) -> Column:
        stratum = F.concat(s["encoding"], F.lit(":"), F.floor(F.log2(F.length(s["token"]))).cast("string"))
        known = reduce(lambda a, b: a | b, (F.coalesce(F.get(F.col(row)[k], before(F.col(row)[k], s["end"]) - 1)["end"] > s["start"], F.lit(False)) for k in kinds))
        values = {"start": s["start"], "ord": F.lit(KINDS.index("random")), "end": s["end"], "stratum": stratum, "hash": F.xxhash64(s["token"]), "p": tested(s["token"], s["encoding"]), "known": known}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    enough = lambda s: F.length(s["token"]) * F.element_at(bits, s["encoding"]) >= least_bits
    tokens = F.filter(F.transform(found, judged), enough)
    out = docs.withColumn(row, F.struct(*(_plain(v).alias(k) for k, v in spans.items()), tokens.alias("tokens")))
    base = F.array_sort(F.concat(*(F.col(row)[k] for k in kinds)))
    return out.withColumn(row, F.struct(base.alias("base"), F.transform(F.col(row)["tokens"], weighed).alias("tokens")))


def thresholds(tokens: DataFrame, q: float, least_p: float) -> dict[str, float]:
    """(stratum, hash, p) of tokens to the p-value of each stratum above which tokens count as random; 1 where none does.

    It is least_p, or above it where control of false discoveries asks for more. By the Benjami-Hochberg rule, tokens below t are reported as
    ordered at a false rate of q: t is the largest grid value with n * t <= q * #(p <= t). And of the tokens above t no more than a share of q may be
    ordinary: those above one half, with two standard errors more, say how many random ones there can be, of which a share of 1 - t is above t.
    Equal tokens count once. Strata and grid are bounded (encodings times powers of two of a length, STEPS), and so is what the driver sees.
    """
    step = F.least(F.lit(STEPS), F.ceil(-2 * F.log2(F.greatest(F.col("p"), F.lit(1e-18)))).cast("int"))
    counts = tokens.select("stratum", "hash", step.alias("step")).distinct().groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    value = lambda s: 2.0 ** (-(s - 1) / 2)  # noqa: E731  p of a step is in (2 ** -(s / 2), value(s)]
    out: dict[str, float] = {}
    for stratum in {r["stratum"] for r in counts}:
        by_step = {r["step"]: r["n"] for r in counts if r["stratum"] == stratum}
        total, below, t = sum(by_step.values()), 0, least_p
        for s in range(STEPS, 0, -1):
            below += by_step.get(s, 0)
            if below and total * value(s) <= q * below:
                t = max(t, value(s))
        half = sum(n for s, n in by_step.items() if s <= 2)
        random = 2 * (half + 1 + 2 * math.sqrt(half + 1))
        for level in [t, *(value(s) for s in range(STEPS, 0, -1) if value(s) > t)]:
            above = sum(n for s, n in by_step.items() if value(s) > level)
            out[stratum] = level
            if random * (1 - level) >= (1 - q) * above:
                break
    return out


def _random(tokens: Column, limits: dict[str, float], least_p: float) -> Column:
    """Spans of the tokens that pass as random and that no pattern has found."""
    limit = F.create_map(*(F.lit(x) for kv in ({"": 0.0} | limits).items() for x in kv))
    return _plain(F.filter(tokens, lambda s: ~s["known"] & (s["p"] > F.coalesce(F.element_at(limit, s["stratum"]), F.lit(least_p)))))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))


def _limits(found: DataFrame, q: float, least_p: float) -> dict[str, float]:
    return thresholds(found.select(F.explode("found.tokens").alias("t")).select("t.stratum", "t.hash", "t.p"), q, least_p)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, least_p: float = 0.01, least_bits: float = 96.0) -> DataFrame:
    """(doc_id, base, spans, tests): arrays of (start, ord, end), sorted; ord is the kind's place in KINDS. tests are the tokens that were tested: (start, end, stratum, p)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = scratch.save(spotted(rows, F.col("text"), least_bits, "found").select("doc_id", "found"), "spans")
    limits = _limits(found, q, least_p)
    spans = F.array_sort(F.concat("found.base", _random(F.col("found.tokens"), limits, least_p)))
    tests = F.transform("found.tokens", lambda s: F.struct(*(s[k].alias(k) for k in ("start", "end", "stratum", "p"))))
    return found.select("doc_id", F.col("found.base").alias("base"), spans.alias("spans"), tests.alias("tests"))


def disjoint(spans: Column) -> Column:
    """Of each of the sorted spans what no span before it covers, and whether it starts outside all of them."""
    kind = "array<struct<start: int, end: int, mark: boolean>>"
    none = F.array().cast(kind)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda k: F.slice(spans, k * CHUNK + 1, CHUNK))

    def add(s: Column, x: Column) -> Column:
        end = F.greatest(s["at"], x["end"])
        left = F.struct(F.greatest(s["at"], x["start"]).alias("start"), end.alias("end"), (x["start"] >= s["at"]).alias("mark"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(left)).alias("out"))

    def add_chunk(s: Column, chunk: Column) -> Column:
        inner = F.transform(F.array(F.aggregate(chunk, F.struct(s["at"].alias("at"), none.alias("out")), add)), lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out")))
        return F.element_at(inner, 1)

    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), add_chunk, lambda s: F.flatten(s["out"]))


def cut(text: Column, spans: Column, by: str) -> Column:
    """The text with spans replaced; chunks of the text are cut on their own, each with the spans that reach into it."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut_chunk(chunk: Column, k: Column, own: Column) -> Column:
        low, high = k * CHUNK, k * CHUNK + F.length(chunk)

        def add(s: Column, x: Column) -> Column:
            gap = F.substring(chunk, s["at"] - low + 1, F.greatest(x["start"], s["at"]) - s["at"])
            mark = F.when(x["mark"] & (x["start"] >= low) & (x["start"] < high), F.lit(by)).otherwise("")
            end = F.least(high, F.greatest(s["at"], x["end"]))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(gap, mark)).alias("out"))

        first = F.greatest(F.lit(1), before(own, low))
        near = F.slice(own, first, F.greatest(F.lit(0), before(own, high) - first + 1))
        state = F.struct(low.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(near, state, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(chunk, s["at"] - low + 1, CHUNK)))

    pieces = F.transform(F.array(disjoint(spans)), lambda own: F.array_join(F.transform(chunks, lambda chunk, k: cut_chunk(chunk, k, own)), ""))
    return F.element_at(pieces, 1)


def redact(docs: DataFrame, text_col: str = "text", by: str = "[SECRET]", q: float = 0.05, least_p: float = 0.01, least_bits: float = 96.0) -> DataFrame:
    """docs with every secret in the text replaced; texts without one, and all other columns, stay as they are. Rows and spans are written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = fresh(docs, "found")
    found = scratch.save(spotted(docs, text, least_bits, name), "spans")
    limits = _limits(found.select(F.col(name).alias("found")), q, least_p)
    spans = F.array_sort(F.concat(F.col(name)["base"], _random(F.col(name)["tokens"], limits, least_p)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut(text, spans, by)).otherwise(F.col(text_col))).select(*docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["ord"] == KINDS.index(kind))).cast("long")
