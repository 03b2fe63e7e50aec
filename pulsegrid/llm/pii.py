"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Column expressions only. A kind is a pattern, a test that a match must pass, a score to
begin with, and words that raise the score when they stand shortly before the match.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a match in which context words are looked for.
CONTEXT = 48
#: What a context word, a passed checksum and a word that speaks against add to the score.
CONTEXT_GAIN, CHECKSUM_GAIN, AGAINST = 0.3, 0.4, -0.2
#: Additional kinds are reported from this score on; base kinds always.
REPORTED = 0.7


class Kind(NamedTuple):
    name: str
    pattern: str
    #: Quick test of the whole text; where it is false the pattern is not tried.
    worth: str
    passes: Callable[[Column], Column]
    score: float
    checked: bool
    words: tuple[str, ...]
    base: bool = True


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda x: x.cast("int"))

    def weighed(x: Column, i: Column) -> Column:
        twice = 2 * x
        return F.when(i % 2 == 0, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(figures, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """True for an account number (IBAN) whose rearranged value leaves 1 modulo 97."""
    plain = F.regexp_replace(code, " ", "")
    letters = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(rest: Column, x: Column) -> Column:
        value = F.ascii(x)
        return F.when(value < 58, rest * 10 + value - 48).otherwise(rest * 100 + value - 55) % 97

    return F.aggregate(letters, F.lit(0), step) == 1


def _length(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

# Java's matcher recurses for groups that may give back what they took; the possessive
# forms here match the same strings in a loop. A match of email or ip can only begin
# where its first run of characters begins or where the last match ended (\G), which
# spares long runs a try at every character.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
        "@",
        lambda v: F.lit(True),
        0.8,
        False,
        ("mail", "contact", "write to", "@"),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        0.6,
        False,
        ("ip", "address", "host", "server"),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9][\x20-]?[0-9]",
        lambda v: _length(digits(v), 13, 19) & luhn(digits(v)),
        0.4,
        True,
        ("card", "visa", "credit", "debit"),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda v: _length(digits(v), 9, 15),
        0.6,
        False,
        ("phone", "tel", "call", "mobile", "fax"),
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
        mod97,
        0.3,
        True,
        ("iban", "account", "bank", "konto"),
        base=False,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "[0-9]-[0-9]{2}-[0-9]",
        lambda v: ~v.rlike("^(?:000|666|9..)|-00-|0000$"),
        0.4,
        False,
        ("ssn", "social security"),
        base=False,
    ),
    Kind(
        "local_phone",
        r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]",
        lambda v: F.lit(True),
        0.4,
        False,
        ("phone", "tel", "call", "mobile", "fax"),
        base=False,
    ),
)

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _score(text: Column, kind: Kind, start: Column) -> Column:
    """The score of a span: its kind's, the checksum's gain, and that of the words before it."""
    begin = F.greatest(start - CONTEXT, F.lit(0))
    before = F.lower(F.substr(text, begin + 1, start - begin))
    near = "|".join(kind.words)
    return (
        F.lit(kind.score + CHECKSUM_GAIN * kind.checked)
        + F.when(before.rlike(rf"(?:^|[^a-z])(?:{near})"), CONTEXT_GAIN).otherwise(0.0)
        + F.when(before.rlike("(?:order|invoice|version|serial|test)[^a-z]*$"), AGAINST).otherwise(0.0)
    )


def _stands_alone(text: Column, start: Column, end: Column) -> Column:
    """Neither a letter, a figure nor a joining mark on either side."""
    joined = "^[A-Za-z0-9_+-]"
    return ~(
        ((start > 0) & F.substr(text, F.greatest(start, F.lit(1)), F.lit(1)).rlike(joined))
        | F.substr(text, end + 1, F.lit(1)).rlike(joined)
    )


def spans_of(text: Column, kind: Kind) -> Column:
    """Leftmost non-overlapping matches of one kind that pass its test, in order.

    The pieces between the matches and the matches themselves add up to the offsets,
    which count code points; ends are exclusive.
    """
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("value"),
        F.split(text, kind.pattern, -1).alias("gap"),
    )

    def found(seen: Column, x: Column) -> Column:
        value = x["value"]
        start = seen["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(value), F.lit(0))
        good = value.isNotNull() & kind.passes(value)
        if not kind.base:
            good = good & _stands_alone(text, start, end) & (_score(text, kind, start) >= REPORTED)
        span = F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            _score(text, kind, start).alias("score"),
        ).cast(SPAN)
        return F.struct(
            end.alias("at"),
            F.when(good, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"),
        )

    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    worth = text.contains(kind.worth) if kind.worth == "@" else text.rlike(kind.worth)
    return F.when(worth, F.aggregate(pieces, begin, found, lambda seen: seen["spans"])).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, the columns of ``keep`` and, for each kind, an
    array of its spans in order (``spans_email`` and so on).

    No shuffle. A null or empty text has no spans; null ids and repeated rows are kept as
    they come. Other columns of ``docs`` are not looked at. A span of an additional kind
    that overlaps a base span is left out.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep
    )
    base = {f"spans_{k.name}": spans_of(F.col("text"), k) for k in KINDS if k.base}
    added = {f"spans_{k.name}": spans_of(F.col("text"), k) for k in KINDS if not k.base}
    found = source.select("doc_id", "text", *keep, *(c.alias(n) for n, c in (base | added).items()))
    known = F.concat(*map(F.col, base))

    def apart(span: Column) -> Column:
        return ~F.exists(known, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    return found.withColumns(
        {n: F.when(F.size(n) > 0, F.filter(F.col(n), apart)).otherwise(F.col(n)) for n in added}
    )


def all_spans() -> Column:
    """All spans of a row of ``find_pii``, by kind as listed, then start."""
    return F.concat(*(F.col(f"spans_{k.name}") for k in KINDS))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each stretch of spans replaced by its first kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(seen: Column, s: Column) -> Column:
        fresh = s["start"] >= seen["at"]
        return F.struct(
            F.greatest(seen["at"], s["end"]).alias("at"),
            F.when(
                fresh,
                F.concat(
                    seen["out"],
                    F.substr(text, seen["at"] + 1, s["start"] - seen["at"]),
                    F.lit("["), F.upper(s["kind"]), F.lit("]"),
                ),
            ).otherwise(seen["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        ordered, begin, step, lambda seen: F.concat(seen["out"], F.substr(text, seen["at"] + 1))
    )
