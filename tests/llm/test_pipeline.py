"""The pipeline against plain Python."""

import re
from collections import Counter
from fractions import Fraction

from .test_operators import ROWS, WORD, _components, _shingles

import corpus_pipeline
from usagelake.llm import mixing


def _kept(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    chars, letters = sum(map(len, w)), sum(c.isalpha() for c in text or "")
    return len(w) >= 50 and 2 * len(covered) <= len(w) and 2 * len(w) <= chars <= 20 * len(w) and len(re.findall(r"[#*$%&|<>]", text)) <= 0.3 * len(w) and len(lines) - len(set(lines)) <= 0.5 * len(lines) and letters >= 0.5 * chars


def test_run(spark, tmp_path):
    rows = [r[:5] for r in ROWS if r[0] != 7] + [(100 + i, f"mail x{i}@y.example " + r[1], "en", "s1", 0) for i, r in enumerate(ROWS) if r[1] and len(r[1]) == len(ROWS[6][1])][:1]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    good = [r for r in rows if _kept(r[1])]
    sets = [_shingles(r[1], 5) for r in good]
    top = _components(range(len(good)), [(i, j) for i in range(len(good)) for j in range(i) if len(sets[i] & sets[j]) >= Fraction(4, 5) * len(sets[i] | sets[j])])
    first = {}
    for i, c in top.items():
        first[c] = min(first.get(c, good[i]), good[i], key=lambda r: r[0])
    distinct = spark.createDataFrame(list(first.values()), "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in good)
    docs = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in first.values())
    clean = stages["personal_data"](spark, distinct, str(tmp_path))
    assert clean.columns == distinct.columns and all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean.collect() if r["doc_id"] >= 100)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.measure(clean).collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ends = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert ends == +Counter(taken)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and {p["offset"] for p in pieces} == {0}


def test_stages_on_an_empty_table_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string"
    for rows in ([], [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (1, "", "en", None, 0, "x")]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "pack" or out.columns == docs.columns
            assert out.count() == {"quality": 0, "near_duplicates": len(rows), "personal_data": len(rows), "mix": 0, "pack": len(rows)}[name]
