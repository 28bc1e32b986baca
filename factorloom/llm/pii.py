"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.text import body, fresh, let, prefix_sums, without

#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 40
#: Spans that score less are dropped.
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    The pattern never gives back what it took (possessive) and starts only where a run starts,
    so matching is linear in the text whatever the text holds.
    """

    name: str
    pattern: str
    base: float
    raises: str = ""  # context words that raise the score by 0.3
    lowers: str = ""  # context words that lower it by 0.3
    needs: str = ""   # a plain string without which the pattern can't match


#: Length of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Groups of four and a last one, as many as the country has; other letters take any number."""
    def groups(n: int) -> str:
        return rf"(?:[\x20]?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"[\x20]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}{groups(n - 4)}" for n, c in IBAN_LENGTHS.items()]
    every = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
    other = rf"(?!{every})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]{{4}}){{2,7}}(?:[\x20]?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


# Patterns of the kinds, their scores without context, and their context words.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 1.0, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1.0, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 1.0, needs="+"),
    Kind("iban", iban_pattern(), 0.8,
         "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5, "ssn|social security|tax id", "order|invoice|ref|part|version"),
)
#: Kinds whose confirmed spans stay whatever their context.
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN moved and read as a number; 1 confirms it."""
    compact = F.upper(F.regexp_replace(iban, " ", ""))
    moved = F.concat(F.substring(compact, 5, 1 << 20), F.substring(compact, 1, 4))
    code = lambda c: F.conv(c, 36, 10).cast("int")  # noqa: E731  A is 10
    step = lambda a, c: F.pmod(a * F.when(code(c) > 9, 100).otherwise(10) + code(c), F.lit(97))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def confirmed(kind: str, m: Column) -> Column:
    """Whether the match passes its kind's validator."""
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m) == 1
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9..)|-00-|0000$")
    return F.lit(True)


def spans_of(kind: Kind, text: Column, min_score: float = MIN_SCORE) -> Column:
    """Array of (start, rank, kind, end, score) of one kind, offsets in code points.

    Splitting by the pattern gives the gaps between matches: offsets are running sums of
    lengths, and a match's context is the end of the gap before it and the start of the next.
    """
    names = [k.name for k in KINDS]

    def score(before: Column, after: Column) -> Column:
        around = F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS))))
        up = F.when(around.rlike(rf"\b(?:{kind.raises})\b"), 0.3).otherwise(0.0) if kind.raises else F.lit(0.0)
        down = F.when(around.rlike(rf"\b(?:{kind.lowers})\b"), -0.3).otherwise(0.0) if kind.lowers else F.lit(0.0)
        return F.least(F.lit(1.0), F.lit(kind.base) + up + down)

    def located(parts: Column) -> Column:
        steps = F.transform(parts["hits"], lambda m, i: F.length(m) + F.length(F.get(parts["gaps"], i)))

        def place(totals):
            def one(m, i):
                start = F.get(totals, i) + F.length(F.get(parts["gaps"], i))
                near = score(F.get(parts["gaps"], i), F.get(parts["gaps"], i + 1))
                return F.struct(
                    start.alias("start"), F.lit(names.index(kind.name)).alias("rank"), F.lit(kind.name).alias("kind"),
                    (start + F.length(m)).alias("end"), F.when(confirmed(kind.name, m), near).alias("score"))

            return F.filter(F.transform(parts["hits"], one), lambda s: F.coalesce(s["score"] >= min_score, F.lit(False)))

        return let(prefix_sums(steps), place)

    parts = F.struct(
        F.split(text, kind.pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))
    possible = text.rlike(kind.pattern)
    if kind.needs:
        possible = F.contains(text, F.lit(kind.needs)) & possible
    return F.when(possible, let(parts, located)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def find_personal_data(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """All rows of ``docs`` with ``spans``: (start, rank, kind, end, score), by start, then kind.

    Every kind's matches are leftmost and non-overlapping; a match that its validator or its
    score turns down is dropped without another try. Offsets count code points, the end is
    exclusive. The base kinds (email, ip, card, phone) stay whatever their context; the others
    need ``min_score``. Spans of different kinds may overlap.

    Each row is worked out alone, in expressions on the JVM and in time linear in its text.
    Null and empty texts have no spans, a column named ``spans`` is replaced, an empty table
    gives an empty one.
    """
    docs = without(docs, "spans")
    (raw,) = fresh(docs, "raw_")
    docs = docs.withColumn(raw, body(f"`{text}`"))
    every = F.concat(*[spans_of(kind, F.col(raw), min_score) for kind in KINDS])
    return docs.withColumn("spans", F.array_sort(every)).drop(raw)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``find_personal_data`` by its kind in brackets; overlapping spans give one mark."""
    raw = body(f"`{text}`")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        mark = F.concat(a["out"], F.substring(raw, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        inside = s["start"] < a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(mark).alias("out"))

    whole = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substring(raw, a["at"] + 1, F.length(raw))))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
