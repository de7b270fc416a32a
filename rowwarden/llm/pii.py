"""Personal data by patterns, checksums and context, in Spark functions only.

A pattern proposes spans: its matches and the pieces between them give every position by running sums of
lengths, in code points. Validators confirm spans: ranges of address parts, the Luhn sum of card numbers,
mod 97 of account numbers. A score starts at the kind's base and moves with words found just before the span.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name


@dataclass(frozen=True)
class Kind:
    """A pattern, what must be in a text for it to match at all, a check of each match, and its context.

    Patterns use possessive repeats where they can, and begin where a run of their characters does or where the
    last match ended: the matches are those of the plain pattern, in time linear in the text.
    """

    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    base: float = 0.6
    words: Sequence[str] = ()
    #: Whether a span counts whatever its score.
    certain: bool = True


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _codes(text: Column) -> Column:
    """Character codes of an ASCII text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.ascii(F.substring(text, k, F.lit(1))))


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn sum."""
    d = F.reverse(_codes(digits(number)))
    doubled = F.transform(d, lambda c, k: F.when(k % 2 == 0, c - 48).otherwise(2 * (c - 48) - F.when(c - 48 > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, c: a + c) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of letters and digits passes mod 97: first four characters last, letters as 10 to 35."""
    plain = F.upper(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.aggregate(_codes(turned), F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


def _card(match: Column) -> Column:
    return F.when(_between(16, 19)(match), luhn(match)).otherwise(False)


def _iban(match: Column) -> Column:
    return F.when(F.length(F.regexp_replace(match, "[^A-Za-z0-9]", "")).between(15, 34), mod97(match)).otherwise(False)


_LOCAL = "A-Za-z0-9._%+-"
# The kinds in order, and the words that raise the score of a span they stand before.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, ("mail", "email", "contact")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", _ip, 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "", _card, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _between(8, 15), 0.6, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _iban, 0.8, ("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(000|666|9[0-9]{2})") & ~m.rlike("-00-") & ~m.rlike("0000$"), 0.3, ("ssn", "social", "security"), False),
)
BASE_KINDS = KINDS[:4]
#: Characters before a span that are searched for context words, what one adds to the score, and the score that uncertain kinds need.
CONTEXT = 40
LIFT = 0.25
THRESHOLD = 0.5


_SPAN = "array<struct<start:int,end:int,text:string,before:string>>"


def _spans(text: Column, kind: Kind) -> Column:
    """Array of structs of start, end, matched text and what stands before it; the text has at least one match.

    Positions are running sums over blocks of some square root of the matches, so that no array grows one by one
    through a whole text, and the characters before a span come along instead of being looked up in the text.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    width = lambda p: F.ceil(F.sqrt(F.size(p))).cast("int")
    blocks = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), width(p)), lambda k: F.slice(p, k, width(p)))
    state = lambda at, tail, out: F.struct(at.alias("at"), tail.alias("tail"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        before = F.right(F.concat(a["tail"], x["gap"]), F.lit(CONTEXT))
        span = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), before.alias("before"))
        return state(start + F.length(x["hit"]), F.right(F.concat(before, x["hit"]), F.lit(CONTEXT)), F.concat(a["out"], F.array(span)))

    def block(a: Column, xs: Column) -> Column:
        return F.aggregate(xs, state(a["at"], a["tail"], F.array().cast(_SPAN)), step, lambda s: state(s["at"], s["tail"], F.concat(a["out"], F.array(s["out"]))))

    # The pairs are bound by a lambda, so that each use reads them instead of matching anew.
    begin = state(F.lit(0), F.lit(""), F.array().cast(f"array<{_SPAN}>"))
    return F.flatten(F.get(F.transform(F.array(pairs), lambda p: F.aggregate(blocks(p), begin, block, lambda s: s["out"])), F.lit(0)))


def find(text: Column, kinds: Sequence[Kind] = KINDS) -> Column:
    """Array of ``(kind, start, end, score)`` in order of kind, then start."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.concat(*[F.when(_maybe(text, k), _scored(text, k)).otherwise(empty) for k in kinds]) if kinds else empty


def _maybe(text: Column, kind: Kind) -> Column:
    matches = text.rlike(kind.pattern)
    return F.contains(text, F.lit(kind.hint)) & matches if kind.hint else matches


def _scored(text: Column, kind: Kind) -> Column:
    def score(s: Column) -> Column:
        near = s["before"].rlike("(?i)\\b(" + "|".join(kind.words) + ")\\b") if kind.words else F.lit(False)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), kind.base + F.when(near, LIFT).otherwise(0.0)).alias("score"))

    found = F.transform(F.filter(_spans(text, kind), lambda s: kind.check(s["text"])), score)
    return found if kind.certain else F.filter(found, lambda s: s["score"] >= THRESHOLD)


def annotate(docs: DataFrame, *, text: str = "text", kinds: Sequence[Kind] = KINDS, into: str = "pii") -> DataFrame:
    """Add ``into``: an array of ``(kind, start, end, score)`` structs in order of kind, then of start.

    Positions are code points, ends exclusive. A null or empty text has none. Rows are independent: nothing is
    shuffled, repeated rows get equal results.
    """
    own = free_name(docs, "_pii_text")
    return docs.withColumn(own, F.coalesce(F.col(text), F.lit(""))).withColumn(into, find(F.col(own), kinds)).drop(own)


def redact(docs: DataFrame, *, text: str = "text", kinds: Sequence[Kind] = BASE_KINDS, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask`` with its kind; overlapping spans merge under the first."""
    found = free_name(docs, "_pii")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        shown = F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.replace(F.lit(mask), F.lit("{}"), s["kind"]))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), shown.alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.aggregate(ordered, begin, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return annotate(docs, text=text, kinds=kinds, into=found).withColumn(text, F.when(F.col(text).isNotNull(), whole)).drop(found)
