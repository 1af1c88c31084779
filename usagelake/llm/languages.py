"""Language identification by compression.

For each language a sample of its texts is a raw-content dictionary of zstandard. A text is compressed in pieces with each
dictionary, and the language whose dictionary makes it smallest wins: its words and endings are already there. Pieces are
compressed apart, so that a long text doesn't teach the compressor its own words before the dictionary has had its say.

The dictionaries are the only thing learned from a sample: `slots` stretches of at most `stretch` characters for each
language, one for each residue of their hashes, the one of the smallest hash there, from whole texts wherever in them it
stands. Which they are depends on the texts only, not on their order or on how they are dealt out. At most `most_languages`
languages are learned, those of the most labelled rows (of equally many, by name). So what the driver holds and sends with
the tasks' code is at most slots x stretch x most_languages characters (64 KB for each language).

Defined cases: a null text or one without a letter is UNKNOWN with score 0; with nothing to learn from, every text is; of
languages that are equally small the one with more labelled rows wins, then the first by name; repeated rows are answered
one by one and count as often for that order, their stretches once; an empty table gives an empty result; a null id is not held out; ids
may be of any type; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidy

UNKNOWN = "und"
#: Bytes of a text that are compressed at once.
PIECE = 8192
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Languages:
    """names, in the order that decides ties, and a dictionary for each."""

    names: tuple[str, ...]
    samples: tuple[bytes, ...]
    level: int = 6


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = 128, stretch: int = 512, most_languages: int = 200, level: int = 6) -> Languages:
    """Dictionaries from the rows that have a language and a text."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    names = [r["lang"] for r in sizes]
    if not names:
        return Languages((), (), level)
    pieces = rows.where(F.col("lang").isin(names)).select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stretch}}}"), F.lit(0))).alias("piece"))
    hashed = pieces.select("lang", "piece", F.xxhash64("piece").alias("h")).withColumn("slot", F.pmod("h", F.lit(slots)))
    least = hashed.groupBy("lang", "slot").agg(F.min("h").alias("h"))  # at most slots x most_languages rows
    chosen = hashed.join(F.broadcast(least), ["lang", "slot", "h"]).groupBy("lang", "slot").agg(F.min("piece").alias("piece")).collect()
    by_name: dict[str, list[tuple[int, str]]] = {n: [] for n in names}
    for r in chosen:
        by_name[r["lang"]].append((r["slot"], r["piece"]))
    return Languages(tuple(names), tuple(" ".join(p for _, p in sorted(by_name[n])).lower().encode() for n in names), level)


class Judge:
    """Compressors of a task, one for each language."""

    def __init__(self, known: Languages):
        self.known, self._by = known, []
        for sample in known.samples:
            own = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=known.level)
            self._by.append(zstandard.ZstdCompressor(level=known.level, dict_data=own, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Bytes that the text takes with each dictionary."""
        raw = text.lower().encode(errors="replace")
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return np.array([sum(len(by.compress(p)) for p in pieces) for by in self._by], np.int64)

    def __call__(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, whether the margin to the next one is wide enough)."""
        if text is None or not self._by or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        score = 1 / float(np.exp2(-(sizes - sizes[best]).clip(0, 1000).astype(np.float64)).sum())
        others = np.delete(sizes, best)
        return self.known.names[best], score, bool(len(others) == 0 or others.min() - sizes[best] > margin * sizes[best])


def identify(docs: DataFrame, known: Languages, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.005) -> DataFrame:
    """id, lang (the best, UNKNOWN without letters), score (the share of the best when a byte less is twice as likely), accepted
    (false where the next best isn't larger by more than `margin`: such a text's language is a guess)."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(known)
        for batch in batches:
            found = [judge(t, margin) for t in batch.column(1).to_pylist()]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["id", "lang", "score", "accepted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, lang string, score double, accepted boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str | Column) -> Column:
    """A quarter of all ids, by their checksum; a null id isn't."""
    return F.coalesce(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
