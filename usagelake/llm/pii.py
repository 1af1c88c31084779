"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score. DataFrame functions only.

A text is split at a pattern's matches; the lengths of pieces and matches, added up, give each match's place in code
points. The base kinds stand whenever their check passes. The kinds of the method itself need a score: a start value,
more if one of the kind's words stands within `window` characters before the span (and after the kind's match before it),
less if a word there says that the value isn't meant. Weak kinds, as numbers without a checksum, stand only by their words.

No pattern can recurse or take quadratic time, however long a run of its characters is: a group of varying length is
repeated possessively, where giving back could never help, and a match may start inside a run of one class only where the
last match ended, since a start further on can only succeed where the start of the run does. Matches are placed, and spans
cut out, in blocks, so that no array is copied once for each match.

Defined cases: a null text is empty and has no spans; spans of different kinds may overlap and all count; repeated rows
are scanned one by one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, whole_text


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nines cast out; the sum is a multiple of ten."""
    value = lambda c, i: let(c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """ISO 7064 as in account numbers: the first four characters go to the end, letters count from 10, the rest is 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    worth = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: let(worth(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def _ip(m: Column) -> Column:
    small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    return F.forall(F.split(m, r"\."), small)


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(F.lit(False)))


@dataclass(frozen=True)
class Kind:
    """gate: must be in any text that the pattern can match in, and is cheaper to look for. score: without context."""

    name: str
    pattern: str
    gate: str
    check: Callable[[Column], Column] = field(default=lambda m: F.lit(True))
    base: bool = True
    score: float = 0.5
    context: str = ""


#: The patterns of the base kinds, with guards against quadratic time in front.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", context="mail|contact|write|reply"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", _ip, context="ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", _card, context="card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), context="phone|tel|call|mobile"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}", _iban, False, 0.7, "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), False, 0.3, "ssn|social|security"),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[ .-][0-9]{4}", base=False, score=0.3, context="phone|tel|call|mobile|fax"),
    Kind("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "AKIA|ASIA", base=False, score=0.8, context="aws|key|secret"),
    Kind("secret", r"""\b(?:password|passwd|api_key|apikey|secret|token)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_+/=-]{8,}+""", r"[=:]", base=False, score=0.6, context="login|auth|config|curl|export"),
]
SCORE, WINDOW, BLOCK = 0.5, 40, 256
NEARBY, DOUBT, DOUBTFUL = 0.3, -0.2, "placeholder|dummy|fake|redacted"
_SPANS = "array<struct<start:bigint,kind_order:int,kind:string,end:bigint,score:double>>"


def _blocks(n: Column, state: str, step: Callable[[Column, Column], Column]) -> Column:
    """Folds over the starts of blocks of BLOCK of n (1 at least) items. step: (state so far, block's first item) -> a struct
    at and out, whose out is joined to the one so far."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(state).alias("out"))
    both = lambda acc, i: let(step(acc, i), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))
    return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), zero, both)


def _placed(pieces: Column, found: Column, kind: Kind, window: int) -> Column:
    """Of each match whose check passes: start, the match, what stands before it."""
    state = "array<struct<start:bigint,m:string,near:string>>"

    def one(acc: Column, i: Column) -> Column:
        piece, m = F.get(pieces, i), F.get(found, i)
        start = (acc["at"] + F.length(piece)).cast("bigint")
        row = F.struct(start.alias("start"), m.alias("m"), F.substring(piece, -window, window).alias("near"))
        return F.struct((start + F.length(m)).cast("bigint").alias("at"), F.when(kind.check(m), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.array().cast(state).alias("out"))
        return F.aggregate(F.sequence(first, F.least(first + BLOCK, F.size(found)) - 1), zero, one)

    return _blocks(F.size(found), state, block)["out"]


def spans_of(text: Column, kind: Kind, order: int, min_score: float = SCORE, window: int = WINDOW) -> Column:
    """array<struct<start, kind_order, kind, end, score>> of the kind's confirmed spans."""
    none = F.array().cast(_SPANS)

    def row(x: Column) -> Column:
        near = F.lower(x["near"])
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), NEARBY).otherwise(0.0) + F.when(near.rlike(DOUBTFUL), DOUBT).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("kind_order"), F.lit(kind.name).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.round(score, 3)).alias("score"))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, kind.pattern), lambda p: F.transform(_placed(p, f, kind, window), row)).cast(_SPANS)))
    confirmed = found if kind.base else F.filter(found, lambda x: x["score"] >= min_score)
    return F.when(text.rlike(kind.gate), confirmed).otherwise(none)


def all_spans(text: Column, kinds: list[Kind] | None = None) -> Column:
    """All confirmed spans by start, then kind as listed."""
    return F.array_sort(F.concat(*(spans_of(text, k, i) for i, k in enumerate(KINDS if kinds is None else kinds))))


def find(df: DataFrame, text_col: str = "text", kinds: list[Kind] | None = None, as_col: str = "spans") -> DataFrame:
    """df with all spans in as_col; a column of that name is replaced."""
    return df.withColumn(as_col, all_spans(whole_text(text_col), kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut_out(text: Column, spans: Column) -> Column:
    """The text with each span (one at least) replaced by its kind's mark."""
    state = "array<string>"

    def block(acc: Column, first: Column) -> Column:
        def cut(own: Column) -> Column:
            end = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
            near = F.substr(text, (acc["at"] + 1).cast("int"), (end - acc["at"]).cast("int"))  # only this block's part of the text is looked through
            return let(near, lambda part: F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast(state).alias("out")), lambda a, s: one(part, acc["at"], a, s)))

        return let(F.slice(spans, first + 1, BLOCK), cut)

    def one(part: Column, offset: Column, a: Column, s: Column) -> Column:
        piece = F.concat(F.substr(part, (a["at"] - offset + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"))

    return let(_blocks(F.size(spans), state, block), lambda r: F.concat(F.array_join(r["out"], ""), F.substr(text, (r["at"] + 1).cast("int"))))


def redact(df: DataFrame, text_col: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """df with every span replaced by <KIND> (a span that begins inside another is covered by that one's mark); a null text stays null."""
    text = whole_text(text_col)
    return df.withColumn(text_col, let(all_spans(text, kinds), lambda s: F.when(F.size(s) == 0, F.col(text_col)).otherwise(_cut_out(text, s))))
