"""Whitening, language identification and alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from usagelake.llm import alignment, languages, queries, whitening
from usagelake.llm.tokens import Encoder, PieceEncoder

VECTORS = "vec_id long, embedding array<float>, label int, n long, component int"


def _vectors(n=300, d=12):
    rng = np.random.default_rng(8)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.1
    rows = [(i, [float(np.float32(x)) for x in v], i % 3, 1, 2) for i, v in enumerate(mixed)]
    odd = [(1000, None, 0, 1, 2), (1001, [0.1] * (d - 1) + [None], 0, 1, 2), (1002, [float("nan")] + [0.0] * (d - 1), 0, 1, 2), (1003, [float("inf")] * d, 0, 1, 2), (1004, [], 0, 1, 2), (1005, [0.5] * (d + 1), 0, 1, 2)]
    return [*rows, rows[0], *odd]


def test_whitening(spark):
    rows = _vectors()
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(7)).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows if r[1] and len(r[1]) == 12 and all(c is not None and math.isfinite(c) for c in r[1])], np.int64)
    ids = [r[0] for r in rows if r[0] < 1000]
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 8 * n and {r["n"] for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(8):
        wanted = centred @ vectors[:, k] / math.sqrt(values[k])
        got = np.array([by[i, k + 1][0]["whitened"] for i in ids])
        assert min(np.abs(got - wanted).max(), np.abs(got + wanted).max()) < 1e-8
        assert abs(by[0, k + 1][0]["explained"] - values[k] / values.sum()) < 1e-12 and len(by[0, k + 1]) == 2
    assert all(by[i, 1][0]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in zip(ids, x, strict=True))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, 0), (2, [], 0, 0, 0)], VECTORS)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [0.5, float(i)], 0, 0, 0) for i in range(4)], VECTORS)).collect()
    assert {r["component"] for r in flat} == {1, 2} and all(r["whitened"] == 0 and r["explained"] == 0 for r in flat if r["component"] == 2) and flat[0]["identity_error"] < 1e-12
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<double>")).collect()
    assert [(r["vec_id"], r["whitened"], r["deviation"]) for r in one] == [("a", 0.0, 0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(i, [1e30 * i, 1.0], 0, 0, 0) for i in range(3)], VECTORS)).collect()
    assert {r["deviation"] for r in huge} == {None}


def test_eigen():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 17, 64):
        a = rng.normal(size=(d, d))
        a = a @ a.T
        for m in (a, np.eye(d), np.zeros((d, d)), np.outer(a[0], a[0])):
            values, q = whitening.symmetric_eigen(m)
            scale = max(1.0, np.abs(m).max())
            assert np.abs(q @ np.diag(values) @ q.T - m).max() < 1e-12 * d * scale and np.abs(q.T @ q - np.eye(d)).max() < 1e-12 * d and (np.diff(values) <= 1e-12 * scale).all()


def test_moments_merge():
    rng = np.random.default_rng(3)
    x = rng.integers(90_000, 110_000, (200, 5))
    whole, parts = whitening.Moments(5), [whitening.Moments(5) for _ in range(4)]
    whole.add(x)
    for p, own in zip(parts, np.split(x, [0, 7, 120]), strict=True):
        p.add(own)
    for p in parts[1:]:
        parts[0].merge(p)
    assert parts[0].n == 200 and parts[0].sums == x.sum(axis=0).tolist() and np.allclose(parts[0].products, np.cov(x.T, bias=True) * 200, rtol=1e-12) and np.allclose(whole.products, parts[0].products, rtol=1e-12)


DOCS = "doc_id long, text string, lang string, source string, score double"


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op12_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.where("crc32(cast(doc_id as string)) % 4 = 2").collect()}
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in found) and all(r["lang_pred"] == r["lang"] for r in out if r["accepted"] and len(r["text"]) > 300)


def test_languages_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 9, "en", "s", 0.0), (2, "der Hund und die Katze " * 9, "de", "s", 0.0), (3, None, "en", "s", 0.0), (4, "12 + 3!", "de", "s", 0.0), (5, "the dog and the cat", None, "s", 0.0), (6, "", "en", "s", 0.0), (None, "die Katze und der Hund", "de", "s", 0.0), (5, "the dog and the cat", None, "s", 0.0), (7, "und der " * 50_000, "de", "s", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    known = languages.learn(docs)
    found = languages.identify(docs, known).collect()
    assert len(found) == len(rows) and known.names == ("de", "en")
    assert Counter((r["doc_id"], r["lang"]) for r in found) == Counter([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (6, "und"), (None, "de"), (5, "en"), (7, "de")])
    assert languages.learn(docs.repartition(5)) == known
    none = languages.learn(docs.where("lang is null"))
    assert {r["lang"] for r in languages.identify(docs, none).collect()} == {"und"} and languages.identify(docs.limit(0), known).count() == 0
    assert len(languages.learn(docs, slots=2, stretch=5).samples[0]) <= 2 * 6


def _byte_of():
    seen = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD and not 0x7F <= b <= 0xA0]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}


def _aligned(texts):
    """(n_a, n_b, links, digest) of each text, token by token."""
    a, b = Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries._tokenizer("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte_of, out = _byte_of(), []
    for t in texts:
        if not t:
            out.append((0, 0, 0, [], ""))
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        sides = []
        for tokens in ([(i, bytes(byte_of[c] for c in p)) for i, p in zip(e.ids, e.tokens, strict=True)], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]):
            at, spans = 0, []
            for i, raw in tokens:
                spans.append((at, at + len(raw), i))
                at += len(raw)
            sides.append((spans, b"".join(raw for _, raw in tokens)))
        (x, joined_a), (y, joined_b) = sides
        if joined_a != (" " + t).encode() or joined_b != joined_a:
            out.append((0, 0, 0, [], ""))
            continue
        links = [(i, j) for p, q, i in x for r, s, j in y if p < s and r < q] if len(x) < 3000 else None
        groups, begin = [], 0
        for end in sorted({s[1] for s in x} & {s[1] for s in y}):
            groups.append("|".join(",".join(str(i) for p, q, i in side if begin < q <= end) for side in (x, y)))
            begin = end
        out.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


TEXTS = [None, "", " ", "a", "A b  c   d", "two words", "two words", "<|endoftext|> </s> <s> <0x41>", "naïve café – Straße, é.", "x▁y", "tab\there\r\nnew\n\n line ", "　wide\xa0space", "😀😀 emoji", "antidisestablishmentarianism " * 20, "word " * 400, "0123456789" * 30, "\x00\x01"]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 300)
    rng = random.Random(6)
    texts = [*TEXTS, *("".join(rng.choice(["a", "the", " ", " ", "\n", "é", "ing", ".", ",", "  ", "Über", "'s", "\r"]) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    rows = [(i, t, "en", "s", 0.5) for i, t in enumerate(texts)] + [(None, "two words", "en", "s", 0.5), (5, "two words", "en", "s", 0.5)]
    wanted, count = _aligned([r[1] for r in rows]), Counter()
    for w in wanted:
        count.update(w[3])
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    found = alignment.align(spark.createDataFrame(rows, DOCS).repartition(4), queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model")).collect()
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found)
    assert got == Counter((r[0], *w[:3], len(w[3]), sum(count[x] == most[x[1]] for x in w[3]), sum(count[x] for x in w[3]), w[4]) for r, w in zip(rows, wanted, strict=True))


def test_alignment_in_parts(spark, monkeypatch):
    """A block of several parts and batches gives the same, and no row gathers a block's texts or counts."""
    monkeypatch.setattr(alignment, "AT_ONCE", 300, raising=False)
    monkeypatch.setattr(alignment, "ROWS", 7, raising=False)
    a, b = queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model")
    texts = [*TEXTS, *(f"word{i % 7} of text {i % 11}, line {i}.\n" * (i % 5) for i in range(60))]
    rows = [(i, t, "en", "s", 0.5) for i, t in enumerate(texts)]
    wanted, count = _aligned(texts), Counter()
    for w in wanted:
        count.update(w[3])
    found = alignment.align(spark.createDataFrame(rows, DOCS).repartition(2), a, b)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "codes" in plan
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["count_sum"], r["groups"]) for r in found.collect()}
    assert got == {i: (*w[:3], len(w[3]), sum(count[x] for x in w[3]), w[4]) for i, w in enumerate(wanted)}


def test_alignment_of_nothing(spark):
    a, b = queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model")
    assert alignment.align(spark.createDataFrame([], DOCS), a, b).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([("x", None)], "doc_id string, text string"), a, b).collect()] == [("x", 0, 0, 0, 0, "", 0, 0)]


@pytest.mark.parametrize("side", ["a", "b"])
def test_plain_encoders(side):
    """Pieces that are put together give the library's ids, for odd texts as well."""
    rng = random.Random(9)
    parts = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "\r", "\x0b", "\xa0", "　", "é", "ﬁ", ".", ",", "'s", "<|endoftext|>", "</s>", "<0x41>", "😀", "12", "\x00", "ß.", "{", "s."]
    texts = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    if side == "a":
        own, library = Encoder(queries._tokenizer("byte_bpe_50k.json"), "gaps", plain=True), Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json"))
        library.encode_special_tokens = True
        wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    else:
        texts = [t for t in texts if "▁" not in t]  # such a text isn't covered by this side's tokens
        own, library = PieceEncoder(queries._tokenizer("piece_bpe_32k.model"), "gaps"), sentencepiece.SentencePieceProcessor(model_file=queries._tokenizer("piece_bpe_32k.model"))
        wanted = library.encode([t[1:] for t in texts])
    ids, count = own.encode([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == wanted
