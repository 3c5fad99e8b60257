"""Personal data in texts: patterns propose, checksums confirm, words nearby decide. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the four base kinds, with boundaries and possessive
# repeats that find the same spans without going back over long runs, and a quick test
# that every text with a match passes.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Kinds the method adds: account numbers (mod 97), US social security numbers, access keys
# and assigned secrets. Of an account number the pattern has the first four characters;
# ACCOUNT is the longest run that can be one, and the number is a prefix of it.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20-]?[A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)[\x20]?[=:][\x20]?[\"']?[^\s\"']{6,}+",
}
ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}+"
# Characters of account numbers by country; other countries' have 15 to 34.
ACCOUNT_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
KINDS = [*BASE, *ADDED]
# Score of a confirmed span, and what a word nearby adds; added kinds need THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "key": 0.8, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|\bsocial\b",
    "key": "aws|key|access",
    "secret": "pass|secret|token|login|user",
}
AGAINST = r"\bexample\b|\bsample\b|\bversion\b|\border\b|\bisbn\b|\bdummy\b"
NEARBY = 40
BONUS, MALUS, THRESHOLD = 0.3, 0.2, 0.6


# Characters of a piece of a text, and hits that are put in a row at a time.
_PIECE_BITS, _RUN = 8, 128
_PIECE = 1 << _PIECE_BITS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column) -> Column:
    """A text as pieces of equal length, so that a part of it is found without a walk over all of it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` up to ``end``, in code points; ``end`` may lie beyond it."""
    first = F.shiftright(start, _PIECE_BITS).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.shiftright(end, _PIECE_BITS).cast("int") - first + 1), "")
    return F.substr(held, (start.bitwiseAND(_PIECE - 1) + 1).cast("int"), (end - start).cast("int"))


def _in_row(items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` of a number and each item adds to an array of ``kind``; it gives the next number and an array.

    Items are taken in runs and the runs put together at the end: adding to one array
    each time would copy it each time.
    """
    none, number = F.array().cast(f"array<{kind}>"), begin.cast("long")

    def one(state: Column, x: Column) -> Column:
        at, added = step(state["at"], x)
        return F.struct(at.cast("long").alias("at"), F.concat(state["list"], added).cast(f"array<{kind}>").alias("list"))

    def run(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("list")), one)
        return _let(done, lambda r: F.struct(r["at"].alias("at"), F.concat(state["lists"], F.array(r["list"])).alias("lists")))

    def all_runs(bound: Column) -> Column:
        places = F.when(F.size(bound) > 0, F.sequence(F.lit(1), F.size(bound), F.lit(_RUN))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(places, lambda i: F.slice(bound, i, _RUN))
        zero = F.struct(number.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("lists"))
        return F.flatten(F.aggregate(parts, zero, run)["lists"])

    return _let(items, all_runs)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        number = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, span: Column) -> Column:
    digits = _digits(span)
    if kind == "ip":
        bare = F.transform(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~span.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _accounts(pieces: Column, heads: Column) -> Column:
    """Account numbers ``m, start`` from places of their first four characters.

    A number is a prefix of the run that begins there, ends before a character that is no
    letter or digit, and passes mod 97: the one of its country's size, or else the longest.
    A place inside a number found before is none.
    """
    sizes = F.create_map(*[F.lit(x) for n, codes in ACCOUNT_SIZES.items() for code in codes.split() for x in (code, n)])

    def number(x: Column) -> Column:
        return _let(_part(pieces, x["start"], x["start"] + 2 * 34), lambda ahead: longest(x, ahead))

    def longest(x: Column, ahead: Column) -> Column:
        run = F.regexp_extract(ahead, ACCOUNT, 0)
        ends = F.filter(F.sequence(F.lit(1), F.length(ahead)), lambda k: (k <= F.length(run)) & F.substr(ahead, k, F.lit(2)).rlike("(?s)^[A-Z0-9](?![A-Za-z0-9])"))
        made = F.transform(ends, lambda k: F.struct(k.alias("k"), F.regexp_replace(F.substr(ahead, F.lit(1), k), "[ -]", "").alias("bare")))
        made = F.filter(made, lambda e: F.length(e["bare"]).between(15, 34) & mod97(e["bare"]))
        best = F.array_max(F.transform(made, lambda e: F.struct(F.coalesce(F.length(e["bare"]) == sizes[F.left(ahead, F.lit(2))], F.lit(False)).alias("own"), e["k"].alias("k"))))
        return F.struct(F.substr(ahead, F.lit(1), best["k"]).alias("m"), x["start"].alias("start"))

    def later(at: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= at
        return (
            F.when(free, x["start"] + F.length(x["m"])).otherwise(at),
            F.when(free, F.array(F.struct(x["m"].alias("m"), x["start"].alias("start")))).otherwise(F.array().cast(f"array<{_HIT}>")),
        )

    return _in_row(F.filter(F.transform(heads, number), lambda x: x["m"].isNotNull()), F.lit(0), later, _HIT)


_QUICK = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "key": lambda t: t.contains("AKIA") | t.contains("ASIA"),
    "secret": lambda t: t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\x20]?[=:]"),
}
_HIT = "struct<m:string,start:long>"
_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _spans(kind: str, text: Column, pieces: Column) -> Column:
    """Confirmed spans of a kind in code points, end exclusive, with scores."""
    pattern = BASE.get(kind) or ADDED[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def located(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + F.length(x["m"]), F.array(F.struct(x["m"].alias("m"), start.cast("long").alias("start")))

    # each match adds the gap before it and itself
    matches = _let(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("gap")))
    hits = _in_row(matches, F.lit(0), located, _HIT)
    confirmed = _accounts(pieces, hits) if kind == "iban" else F.filter(hits, lambda x: _valid(kind, x["m"]))

    def scored(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        before = _part(pieces, F.greatest(x["start"] - NEARBY, F.lit(0)), x["start"])
        return _let(F.lower(F.concat_ws(" ", before, _part(pieces, end, end + NEARBY))), lambda near: span(x, near))

    def span(x: Column, near: Column) -> Column:
        speaks = near.rlike(CONTEXT[kind]) | F.lower(x["m"]).rlike(CONTEXT[kind]) if kind == "secret" else near.rlike(CONTEXT[kind])
        score = F.lit(PRIOR[kind]) + F.when(speaks, BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), MALUS).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            (x["start"] + F.length(x["m"])).cast("long").alias("end"),
            F.least(F.greatest(F.round(score, 4), F.lit(0.0)), F.lit(1.0)).alias("score"),
        )

    spans = F.transform(confirmed, scored)
    if kind in ADDED:
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    return F.when(_QUICK[kind](text), spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` with the column ``out``: spans ``kind, start, end, score``.

    Ordered by kind as in :data:`KINDS`, then start. Base kinds keep every span that
    passes its check, whatever its score. Null and empty texts have an empty list. Rows
    are taken one by one, without shuffle; a column named ``out`` is replaced.
    """
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(out, _let(_pieces(column), lambda pieces: F.concat(*[_spans(kind, column, pieces) for kind in KINDS])))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by ``[KIND]``; same columns.

    Overlapping spans are replaced as one, named after the one that begins first (ties:
    the longer). Texts without any stay as they are; null stays null; ``n_chars``, where
    there is one, follows the text.
    """
    mark = "_spans" + "_" * max(map(len, docs.columns))
    found = find(docs, out=mark)
    ordered = F.array_sort(F.transform(mark, lambda s: F.struct(s["start"], (-s["end"]).alias("far"), F.upper(s["kind"]).alias("kind"))))
    text = F.col("text")

    def replaced(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            free = s["start"] >= at
            before = F.array(_part(pieces, at, s["start"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
            return F.greatest(at, -s["far"]), F.when(free, before).otherwise(F.array().cast("array<string>"))

        rest = _part(pieces, F.array_max(F.transform(ordered, lambda s: -s["far"])), F.size(pieces).cast("long") * _PIECE)
        return F.concat(F.array_join(_in_row(ordered, F.lit(0), step, "string"), ""), rest)

    done = _let(_pieces(text), replaced)
    new = F.when(F.size(mark) > 0, done).otherwise(text)
    out = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(mark) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, out: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter(out, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(out, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col(out)).alias("spans"))
