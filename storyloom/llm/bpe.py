"""Encoding a corpus with a public byte-level BPE tokenizer: a backtracking encoder with exact merges in linear time.

A greedy walk takes the longest token that matches at each place (one Aho-Corasick pass finds them) and keeps it only if the pair
with the token before it is compatible, that is, if merging would not have joined across their border; otherwise it takes the next
shorter token, or steps back. The sequence that survives is the one that the merges give."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files of this kind write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact encoder of one vocabulary file. Byte strings are held as latin-1 text, which the automaton takes."""

    #: Pieces kept with their ids; when full, the memory is cleared (results don't depend on it).
    MEMORY = 200_000

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet = _byte_alphabet()
        plain = lambda s: "".join(chr(alphabet[c]) for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        made = {a + b for a, b in merges}
        words = {s: i for s, i in vocab.items() if s in made or (len(s) == 1 and s in alphabet)}
        self.text = {i: plain(s) for s, i in words.items()}
        self.size = {i: len(s) for i, s in self.text.items()}
        #: Order of the merges: single bytes come before all of them.
        self.rank = {i: -1 for i in self.text}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            if whole not in self.halves:
                self.rank[whole], self.halves[whole] = r, (vocab[a], vocab[b])
            self.joined.setdefault((vocab[a], vocab[b]), whole)
        ids = {s: i for i, s in self.text.items()}
        self.single = [ids[chr(b)] for b in range(256)]
        self.find = ahocorasick.Automaton()
        for s, i in ids.items():
            self.find.add_word(s, (len(s), i))
        self.find.make_automaton()
        self.shorter = {i: next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), None) for i, s in self.text.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)
        blob = "".join(self.text[i] for i in sorted(self.text)).encode("latin-1")
        top = max(self.text) + 1
        lengths = np.array([self.size.get(i, 0) for i in range(top)])
        self.blob, self.offset = np.frombuffer(blob, "uint8"), np.concatenate([[0], np.cumsum(lengths)])

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undo the later of the two, again and again, and look whether the
        tokens that then meet at the border would have been merged before that."""
        kept = self.fits.get((a, b))
        if kept is not None:
            return kept
        x, y, before = a, b, 1 << 60
        while True:
            whole = self.joined.get((x, y))
            if whole is not None and self.rank[whole] < before:
                good = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                good = True
                break
            # the left one of two equal tokens is merged first, so a pair at the border ties with the right one's merge in its favour
            if rx > ry:
                before, x = rx, self.halves[x][1]
            else:
                before, y = ry + 1, self.halves[y][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[(a, b)] = good
        return good

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (latin-1 text of its bytes)."""
        n = len(piece)
        if n == 1:
            return (self.single[ord(piece)],)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, found in self.find.iter(piece):
            at = end - found[0] + 1
            if found[0] > longest[at][0]:
                longest[at] = found
        open_, out, pos = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0][1]
        size, shorter = self.size, self.shorter
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos][1]
                    break
                less = shorter[token]
                if less is None:
                    open_[pos] = 0
                    token = out.pop()
                    pos -= size[token]
                    break
                token = less
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and for an empty text. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= 64:
                    if len(known) >= self.MEMORY:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by slices of one byte table; bytes that are no UTF-8 become U+FFFD."""
        start, stop = self.offset[ids], self.offset[np.asarray(ids, "int64") + 1] if len(ids) else np.empty(0, "int64")
        return b"".join(self.blob[a:b].tobytes() for a, b in zip(start, stop)).decode("utf-8", "replace") if len(ids) else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ``counts_only``: whole texts, null and empty ones included (no ids).

    Repeated rows stay. ``path`` is the vocabulary file, which every worker reads once."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [enc.encode(t.as_py()) for t in part.column(1)]
                n = np.array([len(x) for x in ids], "int64")
                if counts_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], [key, "n_tokens"])
                else:
                    flat = np.fromiter((i for x in ids for i in x), "int32", int(n.sum()))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, " + ("n_tokens long" if counts_only else "ids array<int>"))
