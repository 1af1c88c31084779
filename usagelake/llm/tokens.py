"""Token ids by the tokenizers library, with a memo of the pieces that a text falls into.

A piece ends where no token can go across, so a text's ids are those of its pieces in order; most pieces have been seen
before. `words`: for tokenizers that drop white space and lower-case, pieces are words. `gaps`: for byte-level ones, whose
patterns join a space to the word after it, pieces are words with such a space, and of other white space the last character
and what stands before it. A full stop or comma after a letter is a token of its own in both, and a piece too. All pieces of a block of texts are found, hashed and looked up at once in numpy; only new ones
go through the library, many in one string with a separator whose id no piece can have. A piece is known by a 64-bit hash of its bytes, so a wrong id needs a collision of a new piece with
one of max_pieces (about 1 in 10^13 for each new piece). When the memo is full it begins anew.

Texts in which special tokens could be meant, or where white space beyond ASCII's touches ASCII's, go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordhash import Words, bounded, mix

#: The characters beyond ASCII that the tokenizers' patterns take for white space.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOUCHING = re.compile(rb"[\t-\r ](?:%(wide)s)|(?:%(wide)s)[\t-\r ]" % {b"wide": b"|".join(c.encode() for c in _WIDE)})
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # one of these is in every text with such characters
_WIDE_BYTES = re.compile(b"|".join(c.encode() for c in _WIDE))
#: White space that a separator could join; a space before a word can't.
_OTHER = (b"\t", b"\r", b"\x0b", b"\x0c", b"  ")
_ALONE = re.compile(rb"[\t-\r]|\x20\Z|" + _WIDE_BYTES.pattern)
_MARK, _LETTER, _LATIN = (np.isin(np.arange(256), list(x)) for x in (b".,", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", set(range(0x80, 0xC0)) - {0x97, 0xB7}))
#: How the special tokens of all these tokenizers begin.
_SPECIAL = b"<|"
BLOCK_BYTES = 1_000_000


class Memo:
    """Hash -> number, in two arrays with open addressing; a hash is never 0."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self._mask = (1 << max(10, (2 * most).bit_length())) - 1
        self._keys, self._at = np.zeros(self._mask + 1, np.uint64), np.zeros(self._mask + 1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 where unknown."""
        slot = (h & np.uint64(self._mask)).astype(np.int64)
        key = self._keys[slot]
        out = np.where(key == h, self._at[slot], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self._mask
            key = self._keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self._at[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """New distinct hashes get the numbers from first on."""
        slot, left = (h & np.uint64(self._mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self._keys[slot[left]] == 0]
            self._keys[slot[free]] = h[free]  # of several for one slot, the last stays
            done = self._keys[slot[left]] == h[left]
            self._at[slot[left[done]]] = first + left[done]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self._mask
        self.n += len(h)


class Encoder:
    def __init__(self, path: str, cut: str, max_pieces: int = 1_000_000, plain: bool = False):
        """plain: special tokens' strings in a text are ordinary text."""
        if cut not in ("words", "gaps"):
            raise ValueError(f"texts can be cut into words or gaps, not {cut!r}")
        self._max, self._words, self._plain = max_pieces, cut == "words", plain
        self._open(path)
        self._between = b" ~ " if self._words else b"\n"
        (self._between_id,) = self._ask([self._between.decode()])[0]
        self._begin_anew(max_pieces)

    def _open(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = self._plain

    def token_bytes(self) -> list[bytes]:
        """What each id of a byte-level vocabulary stands for."""
        byte_of = _bytes_of_characters()
        out = [b""] * self._tokenizer.get_vocab_size()
        for piece, i in self._tokenizer.get_vocab().items():
            out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        return out

    def _begin_anew(self, most: int) -> None:
        self._memo = Memo(most)
        self._ids, self._n_ids = np.empty(1 << 16, np.uint32), 0
        self._start, self._count = np.empty(most, np.int64), np.empty(most, np.int32)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 10_000):
            out += [e.ids for e in self._tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
        return out

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, how many each piece has)."""
        out, odd = [np.empty(0, np.uint32)] * len(pieces), []
        sep = self._between.strip(b" ")
        for i in range(0, len(pieces), 2000):
            own = list(range(i, min(i + 2000, len(pieces))))
            text = self._between.join(pieces[i : i + 2000])
            if text.count(sep) >= len(own) or not text.isascii() and _WIDE_BYTES.search(text) or any(x in text for x in _OTHER):
                odd += [j for j in own if _ALONE.search(pieces[j]) or sep in pieces[j]]
                own = [j for j in own if not (_ALONE.search(pieces[j]) or sep in pieces[j])]
                text = self._between.join(pieces[j] for j in own)
            if own:
                ids = np.array(self._ask([text.decode(errors="replace")])[0], np.uint32)
                at = np.flatnonzero(ids == self._between_id)
                for j, a, b in zip(own, [-1, *at.tolist()], [*at.tolist(), len(ids)], strict=True):
                    out[j] = ids[a + 1 : b]
        for j, ids in zip(odd, self._ask([pieces[j].decode(errors="replace") for j in odd]), strict=True):
            out[j] = np.array(ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        flat, count = self._ids_of(pieces)
        while self._n_ids + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        self._ids[self._n_ids : self._n_ids + len(flat)] = flat
        span = slice(self._memo.n, self._memo.n + len(pieces))
        self._start[span], self._count[span] = self._n_ids + np.cumsum(count) - count, count
        self._n_ids += len(flat)
        self._memo.add(hashes, self._memo.n)

    def _pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, begin, end) of all pieces, in order."""
        raw = np.frombuffer(w.buffer, np.uint8)
        hashes, begin, end = w.hashes, w.begin, w.end.copy()
        # Words that end in a full stop or comma after a letter of ASCII or Latin-1 give these up.
        mark = np.flatnonzero(_MARK[raw[end - 1]] & (end - begin > 2))
        mark = mark[_LETTER[raw[end[mark] - 2]] | (raw[end[mark] - 3] == 0xC3) & _LATIN[raw[end[mark] - 2]]]
        end[mark] -= 1
        hashes[mark] = w.hash_of(begin[mark], end[mark])
        more = [(end[mark], end[mark] + 1)]
        if not self._words:
            text_of = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.first))
            before = np.maximum(np.concatenate([[0], w.end[:-1]])[: len(begin)], w.starts[text_of])  # where the white space before a word begins
            gap = begin - before
            joined = (gap > 0) & (raw[begin - 1] == 0x20)
            hashes = np.where(joined, mix(hashes + np.uint64(0x9E6C63D0876A9A47)), hashes)
            # Runs of white space: before a word all but the last character, the last one unless it is joined, and what ends a text.
            long, alone = np.flatnonzero(gap > 1), np.flatnonzero((gap > 0) & ~joined)
            full = np.flatnonzero(np.diff(w.first) > 0)
            tail = w.starts[:-1].copy()
            tail[full] = w.end[w.first[full + 1] - 1]
            open_ = np.flatnonzero(w.starts[1:] - 1 > tail)
            more += [(before[long], begin[long] - 1), (begin[alone] - 1, begin[alone]), (tail[open_], w.starts[1:][open_] - 1)]
            begin = begin - joined
        a, b = (np.concatenate(x) for x in zip(*more, strict=True))
        begins = np.concatenate([begin, a])
        order = np.argsort(begins, kind="stable")
        return np.concatenate([hashes, w.hash_of(a, b)])[order], begins[order], np.concatenate([end, b])[order]

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts, lower=self._words)
        hashes, begin, end = self._pieces(w)
        hashes = np.maximum(hashes, np.uint64(1))
        at = self._memo.get(hashes)
        if (at < 0).any():
            new, where = np.unique(hashes[at < 0], return_index=True)
            if self._memo.n + len(new) > self._memo.most:
                new, where = np.unique(hashes, return_index=True)
                self._begin_anew(max(self._max, len(new)))
            else:
                where = np.flatnonzero(at < 0)[where]
            self._learn(new, [w.buffer[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            at = self._memo.get(hashes)
        count = self._count[at].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(self._start[at] - (ends - count), count) + np.arange(total)]
        so_far = np.concatenate([[0], ends])[np.searchsorted(begin, w.starts)]
        return ids, np.diff(so_far)

    def _needs_whole(self, text: bytes) -> bool:
        return not self._plain and _SPECIAL in text or not text.isascii() and any(x in text for x in _LEADS) and bool(_TOUCHING.search(text))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row as unsigned 32-bit integers, how many each text has)."""
        whole = [i for i, t in enumerate(texts) if self._needs_whole(t)]
        if not whole:
            return self._encode(texts)
        ids, count = self._encode(_without(texts, whole))
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i, own in zip(whole, self._ask([texts[i].decode(errors="replace") for i in whole]), strict=True):
            parts[i] = np.array(own, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _without(texts: list[bytes], gone: list[int]) -> list[bytes]:
    out = list(texts)
    for i in gone:
        out[i] = b""
    return out


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of its number where that is visible, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class PieceEncoder(Encoder):
    """A sentencepiece BPE model. No piece goes on after a space in it, so a space and the word after it are cut off as in byte-level
    tokenizers; runs of spaces and carriage returns join with other characters in such vocabularies, and texts with them go whole.
    Texts are to begin with the space that the model would add."""

    def _open(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self._model.id_to_piece(list(range(self._model.get_piece_size())))
        joined = [p for p in pieces if "\u2581" in p.lstrip("\u2581") or re.search(r"[\t\n]", p) or re.fullmatch(r".*[A-Za-z\u00c0-\u00ff][.,]+", p)]
        if joined:
            raise ValueError(f"the model has pieces that reach beyond a word: {joined[:3]}")

    def token_bytes(self) -> list[bytes]:
        model = self._model
        one = lambda i: bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode()
        return [one(i) for i in range(model.get_piece_size())]

    def _ask(self, texts: list[str]) -> list[list[int]]:
        """Ids without the space that the model puts first: a line feed after it keeps it apart."""
        if not hasattr(self, "_before"):
            self._before = len(self._model.encode("\n"))
        return [ids[self._before :] for ids in self._model.encode(["\n" + t for t in texts], num_threads=1)]

    def _needs_whole(self, text: bytes) -> bool:
        return b"  " in text or b"\r" in text or b"\xe2\x96\x81" in text

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if any(not t.startswith(b" ") for t in texts):
            raise ValueError("texts must begin with a space")
        return super().encode(texts)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, cut: str, plain: bool = False, max_pieces: int = 1_000_000) -> Encoder:
    """One encoder for each tokenizer in a Python worker, kept from task to task."""
    key = path, cut, plain, max_pieces
    if key not in _encoders:
        _encoders[key] = (PieceEncoder if path.endswith(".model") else Encoder)(path, cut, max_pieces, plain)
    return _encoders[key]


def encoded(batch: pa.RecordBatch, own: Encoder, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of an Arrow batch of (id, text), block by block: (ids of documents, all their token ids in a row with the end id after
    each document, how many each has). A null text is empty."""
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    for block in bounded(texts, BLOCK_BYTES):
        ids, count = own.encode(texts[block])
        yield batch.column(0).slice(block.start, block.stop - block.start), np.insert(ids, np.cumsum(count), np.uint32(end_id)), count + 1


def binaries(data: np.ndarray, count: np.ndarray) -> pa.Array:
    """Little-endian ids in a row as one binary value for each count of them."""
    offsets = np.zeros(len(count) + 1, np.int64)
    np.cumsum(4 * count, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data.astype("<u4", copy=False))]).cast(pa.binary())
