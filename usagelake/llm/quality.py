"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule says from a text's features whether the text is rejected. On a bounded sample each rule's running time, that of
its own features included, and its share of rejections are measured; the rules then stand in one CASE in order of
rejections per second, so that a cheap rule that rejects much spares the dear ones. A rule's features are computed inside
its own branch: a text that is rejected never pays for those of later rules. The order changes the time, never the
verdict: a text is kept if no rule rejects it.

Defined cases: a null or blank text has no words and is rejected by the shortest-length rule; repeated rows are judged
one by one; an empty table gives an empty result and the rules keep their stated order; other columns play no part.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACES, WORD, let, whole_text, words_of
from .store import cut

#: Gives a feature of the text by its name.
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Get], Column]


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text.

    Windows are sorted with their places, equal neighbours give the places of repeated ones, and a fold adds up how
    many new words each covers: n log n in the text's words, whatever they are."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def places(s: Column) -> Column:
        as_other = lambda x, i: F.coalesce(x["g"] == F.get(s, i)["g"], F.lit(False))
        same = lambda x, i: as_other(x, i - 1) | as_other(x, i + 1)
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    grams = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.cast("long").alias("p")))
    count = let(grams, lambda g: F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["g"]))) == F.size(g), F.lit(0).cast("long")).otherwise(let(F.sort_array(g), lambda s: covered(places(s)))))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(count)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


#: Each feature by itself; all over the whole text.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.regexp_count(t, F.lit(WORD)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
    "n_symbols": lambda t: F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_repeat_words": lambda t: let(words_of(t), _repeated_words),
    "n_letters": lambda t: F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
}
#: What a full report holds besides the verdict.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def rules(min_words: int = 50, max_words: int = 1_000_000, max_repeat_pct: int = 50, min_mean_chars: float = 2.0, max_mean_chars: float = 20.0, max_symbols_per_word: float = 0.3, max_dup_lines: float = 0.5, min_letter_share: float = 0.5) -> list[Rule]:
    """The rules in their stated order."""
    return [
        Rule("too_short", lambda f: f("n_words") < min_words),
        Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > max_repeat_pct * f("n_words")),
        Rule("too_long", lambda f: f("n_words") > max_words),
        Rule("mean_word_length", lambda f: let(f("word_chars"), lambda c: (c < min_mean_chars * f("n_words")) | (c > max_mean_chars * f("n_words")))),
        Rule("symbols", lambda f: f("n_symbols") > max_symbols_per_word * f("n_words")),
        Rule("repeated_lines", lambda f: f("n_dup_lines") > max_dup_lines * f("n_lines")),
        Rule("few_letters", lambda f: f("n_letters") < min_letter_share * f("word_chars")),
    ]


def order_rules(df: DataFrame, text_col: str, ordered: list[Rule], sample_rows: int = 256, repeats: int = 16, tries: int = 2, counted: bool = False) -> list[Rule]:
    """The rules by rejections per second on at most sample_rows rows. Each task that reads the table gives sample_rows rows at most,
    and the first that come are the sample, whose choice changes the order only. It is written once; each rule judges every row of it `repeats` times, so that its own work outweighs a job's, and
    the best of `tries` counts, less what reading and counting words takes by themselves. Ties keep the given order.
    counted: the rules find all COUNTS made, as in a report, so that only what they need besides is timed."""
    text = whole_text(text_col).alias("t")
    sample = df.select(text).limit(sample_rows)
    if counted:
        sample = sample.select("t", _counts(F.col("t")).alias("c"))
    sample = cut(sample, "quality-sample").coalesce(1)
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("i"))
    took = []
    for rule in [Rule("nothing", lambda f: f("n_words") < 0), *ordered]:
        rejects = _by_counts(F.col("c"), F.col("t"), rule.rejects) if counted else _by_text(F.col("t"), rule.rejects)
        judged = many.agg(F.count_if(rejects).alias("hits"), F.count("*").alias("n"))
        best = float("inf")
        for _ in range(tries):
            began = time.perf_counter()
            hits, n = judged.first()
            best = min(best, time.perf_counter() - began)
        took.append((best, hits, n))
    gain = {r.name: (hits / max(1, n)) / max(s - took[0][0], 1e-3) for r, (s, hits, n) in zip(ordered, took[1:], strict=True)}
    return sorted(ordered, key=lambda r: -gain[r.name])


def _by_text(text: Column, body: Callable[[Get], Column]) -> Column:
    """body with features that are computed where they are asked for; the number of words, which nearly all rules need, once."""
    return let(FEATURES["n_words"](text), lambda n: body(lambda name: n if name == "n_words" else FEATURES[name](text)))


def cascade(ordered: list[Rule], f: Get) -> Column:
    """Name of the first rule that rejects, null if none does; later ones aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(rule.rejects(f), F.lit(rule.name)).otherwise(out)
    return out


def _counts(text: Column) -> Column:
    """A struct of all COUNTS."""
    lines, words = _lines(text), words_of(text)
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            FEATURES["n_symbols"](text).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )


def _by_counts(counts: Column, text: Column, body: Callable[[Get], Column]) -> Column:
    """body with the features that are counted, and others computed where they are asked for."""
    return body(lambda name: counts[name] if name in COUNTS else FEATURES[name](text))


def report(text: Column, ordered: list[Rule]) -> Column:
    """A struct of all COUNTS and rejected_by (null: kept). As every count is wanted, rules only spare what isn't among them."""
    return let(_counts(text), lambda f: F.struct(*(f[c].alias(c) for c in COUNTS), _by_counts(f, text, lambda g: cascade(ordered, g)).alias("rejected_by")))


def judge(df: DataFrame, text_col: str = "text", measure: bool = True, as_col: str = "quality") -> DataFrame:
    """df with its rows' reports in as_col; a column of that name is replaced."""
    found = rules()
    return df.withColumn(as_col, report(whole_text(text_col), order_rules(df, text_col, found, counted=True) if measure else found))


def quality_filter(df: DataFrame, text_col: str = "text", measure: bool = True) -> DataFrame:
    """df's rows that no rule rejects, with df's columns."""
    found = rules()
    ordered = order_rules(df, text_col, found) if measure else found
    return df.where(_by_text(whole_text(text_col), lambda f: cascade(ordered, f)).isNull())
