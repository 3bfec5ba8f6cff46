"""Language of documents and of the lines inside them: string-kernel classification.

A line is the set of its character n-grams of 1 to 4 characters (a blended-spectrum presence kernel, normalised). Kernel ridge
regression, one language against the rest, is fitted on a bounded sample of labelled lines through Nyström landmarks. As the kernel
is linear in presence, the landmark expansion folds into one weight matrix (n-gram x language), so a batch of lines is scored by
one product of its sparse presence matrix with that matrix."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages and the written forms of their labels (codes, English and own names).
LABELS = {
    "en": ["en", "eng", "english"],
    "it": ["it", "ita", "italian", "italiano"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "ru": ["ru", "rus", "russian", "русский"],
}
LANGS = list(LABELS)
BITS, GRAMS = 15, (1, 2, 3, 4)
#: Labelled documents a language in the training sample (documented bound), lines of them that are used, and landmarks.
SAMPLE, LINES, LANDMARKS = 300, 300, 48
#: Longest document that may enter the training sample (all documents are classified, whole).
SAMPLE_CHARS = 20_000

_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+")
_OTHER = re.compile(r"[\W\d_]+")


def canonical_label(label: Column | str) -> Column:
    """The language that a label names, whatever its written form; null if it names none of the eight. A region (en_GB) is ignored."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([^\s_-]+)", 1)
    form = F.when(plain.rlike(r"^[a-z]{2,3}[_-]"), head).otherwise(plain)
    found = F.lit(None).cast("string")
    for lang, forms in LABELS.items():
        found = F.when(form.isin(forms), lang).otherwise(found)
    return found


def plain(line: str) -> str:
    """Letters of a line in one form: lower case, composed accents, links left out, anything else one space."""
    return _OTHER.sub(" ", unicodedata.normalize("NFC", _LINK.sub(" ", line)).lower()).strip()


#: Lines whose n-grams are told apart at a time.
ROWS = 32


def presence(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sparse presence matrix of plain lines, row by row: the hashed n-grams of all lines, each once a line, and where each line's begin.
    Hashes are made for all lines at once, one rolling pass an n; an n-gram is kept where it occurs last in its line."""
    code = np.frombuffer("".join(f" {x} " for x in lines).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    ends = np.cumsum([len(x) + 2 for x in lines])
    hashes, h = [], np.zeros(len(code), "uint64")
    for n in range(1, max(GRAMS) + 1):
        h = h[: max(0, len(code) - n + 1)] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        hashes.append((((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype("int32"))
    last = np.zeros(ROWS << BITS, "int32")
    grams, counts = [], []
    for k in range(0, len(lines), ROWS):
        stop = ends[k : k + ROWS]
        start = np.concatenate([[ends[k - 1] if k else 0], stop[:-1]])
        row = np.repeat(np.arange(len(stop), dtype="int32"), stop - start)
        left = np.repeat(stop, stop - start) - np.arange(start[0], stop[-1])  # characters from here to the line's end
        g = [h[start[0] : stop[-1]] for h in hashes]
        fits = [left[: len(x)] > n for n, x in enumerate(g)]
        rows = np.concatenate([row[: len(x)][ok] for x, ok in zip(g, fits)])
        g = np.concatenate([x[ok] for x, ok in zip(g, fits)])
        cell, at = (rows << BITS) | g, np.arange(len(g), dtype="int32")
        last[cell] = at
        kept = last[cell] == at
        g, rows = g[kept], rows[kept]
        grams.append(g[np.argsort(rows, kind="stable")])
        counts.append(np.bincount(rows, minlength=len(stop)))
    counts = np.concatenate(counts) if counts else np.zeros(0, "int64")
    return np.concatenate(grams) if grams else np.zeros(0, "int32"), np.concatenate([[0], np.cumsum(counts)])


def line_grams(lines: list[str]) -> list[np.ndarray]:
    grams, at = presence(lines)
    return np.split(grams, at[1:-1]) if lines else []


@dataclass
class Model:
    weights: np.ndarray  # n-gram x language
    sharpness: float

    def scores(self, lines: list[str]) -> np.ndarray:
        """The product of the lines' normalised sparse presence matrix with the weights, in blocks of lines."""
        grams, at = presence(lines)
        out = np.zeros((len(lines), len(LANGS)), "float32")
        for k in range(0, len(lines), 256):
            e = min(len(lines), k + 256)
            own = self.weights[grams[at[k] : at[e]]]
            out[k:e] = np.add.reduceat(own, at[k:e] - at[k], axis=0) / np.sqrt(np.diff(at[k : e + 1]))[:, None]
        return out

    def chances(self, scores: np.ndarray) -> np.ndarray:
        z = self.sharpness * (scores - scores.max(axis=1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def fit(lines: list[str], labels: list[str], seed: int = 5, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression on Nyström features; lines that the first fit clearly gives to another language (wrong labels, lines
    in another language) are left out of a second fit. The sharpness of the confidence is the likeliest on the sample."""
    model = _fit_once(lines, labels, seed, ridge)
    y = np.array([LANGS.index(x) for x in labels])
    for _ in range(2):
        s = model.scores(lines)
        keep = s.argmax(axis=1) == y
        if keep.all() or len(np.unique(y[keep])) < len(np.unique(y)):
            break
        model = _fit_once([x for x, k in zip(lines, keep) if k], [x for x, k in zip(labels, keep) if k], seed, ridge)
    s = model.scores(lines)
    keep = s.argmax(axis=1) == y
    likely = []
    for beta in (2.0, 4.0, 8.0, 12.0, 16.0):
        model.sharpness = beta
        likely.append((-np.log(model.chances(s)[np.arange(len(y)), y][keep] + 1e-9).sum() + 0.01 * beta * keep.sum(), beta))
    model.sharpness = min(likely)[1]
    return model


def _fit_once(lines: list[str], labels: list[str], seed: int, ridge: float) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array([LANGS.index(x) for x in labels])
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:LANDMARKS] for k in range(len(LANGS))])
    grams = line_grams(lines)
    land = np.zeros((1 << BITS, len(marks)), "float32")
    for i, k in enumerate(marks):
        land[grams[k], i] = 1 / max(1, len(grams[k])) ** 0.5
    kernel = np.stack([land[g].sum(axis=0) / max(1, len(g)) ** 0.5 for g in grams])
    value, vector = np.linalg.eigh(kernel[marks].astype("float64"))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = kernel @ root
    target = np.where(y[:, None] == np.arange(len(LANGS)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(LANGS))[y]
    gramian = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
    a = root @ np.linalg.solve(gramian, phi.T @ (target * weight[:, None]))
    return Model((land @ a).astype("float32"), 8.0)


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Plain lines with the label of their document, from at most about ``per_language`` labelled documents a language, chosen by a
    hash of the id at a rate that follows from counts over all documents. Only this bounded sample comes to the driver."""
    known = docs.select(F.xxhash64("doc_id").alias("h"), canonical_label("lang").alias("label"), "text").filter(F.col("label").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 20))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("label") == lang, min(1.0, per_language / n)).otherwise(rate)
    rows = known.filter(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000).orderBy("h").limit(2 * per_language * len(LANGS)).collect()
    lines, labels, have = [], [], dict.fromkeys(LANGS, 0)
    for r in rows:
        for line in r.text.split("\n"):
            p = plain(line)
            if len(p) >= 20 and have[r.label] < LINES:
                have[r.label] += 1
                lines.append(p)
                labels.append(r.label)
    return lines, labels


def _classified(model: Model, sure: float):
    def flush(docs: list[tuple], lines: list[str]) -> Iterator[pa.RecordBatch]:
        chance = model.chances(model.scores(lines)) if lines else np.empty((0, len(LANGS)))
        letters = np.array([len(x.replace(" ", "")) for x in lines])
        out: list[tuple] = []
        at = 0
        for key, numbers in docs:
            p, w = chance[at : at + len(numbers)], letters[at : at + len(numbers)]
            at += len(numbers)
            if not len(numbers):
                out.append((key, 0, None, 0.0, 0))
                continue
            mean = (p * w[:, None]).sum(axis=0) / w.sum()
            main = int(mean.argmax())
            own = p[:, main]
            best = p.argmax(axis=1)
            other = (best != main) & (p.max(axis=1) >= sure)
            kept = ~other
            confidence = float((own[kept] * w[kept]).sum() / w[kept].sum()) if kept.any() else float(mean[main])
            out.append((key, 0, LANGS[main], confidence, int(w.sum())))
            for i in np.flatnonzero(other):
                out.append((key, int(numbers[i]), LANGS[best[i]], float(p[i, best[i]]), int(w[i])))
        cols = list(zip(*out)) or [[], [], [], [], []]
        cols = [*zip(*cols[0])] + cols[1:] if out else [[], *cols]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "label", "seg_no", "lang", "confidence", "letters"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lines, held = [], [], 0
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                numbers = []
                for n, line in enumerate((text.as_py() or "").split("\n"), 1):
                    p = plain(line)
                    if p:
                        numbers.append(n)
                        lines.append(p)
                        held += len(p)
                docs.append((key, numbers))
                if held > 400_000:
                    yield from flush(docs, lines)
                    docs, lines, held = [], [], 0
            if docs:
                yield from flush(docs, lines)

    return run


def classify(documents: DataFrame, model: Model | None = None, sure: float = 0.4) -> DataFrame:
    """(doc_id, label, seg_no, lang, confidence, letters): label is the language that the document's label names (null: none); seg_no 0 is the document with the language of most of its text (by letters);
    seg_no n >= 1 is its n-th line, if that is in another language with a chance of at least ``sure``. Lines are split at the newline
    character; links, digits and signs are no words. A text without words (null and empty ones too) has a null language and confidence
    0. Repeated rows give repeated results. With no labelled document to fit on, every language is null."""
    docs = documents.select("doc_id", "lang", "text")
    labelled = docs.select("doc_id", canonical_label("lang").alias("label"), "text")
    if model is None:
        lines, labels = training_sample(docs)
        if not lines:
            return labelled.select("doc_id", "label", F.lit(0).alias("seg_no"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("letters"))
        model = fit(lines, labels)
    return labelled.mapInArrow(_classified(model, sure), "doc_id long, label string, seg_no int, lang string, confidence double, letters long")


def wrong_labels(documents: DataFrame, sure: float = 0.4) -> DataFrame:
    """(doc_id, seg_no, lang): documents whose label is null, names no language or another than that of most of the text, and the
    lines in another language. A right language in another written form is no case. Repeated rows are listed once."""
    found = classify(documents, sure=sure).filter("lang is not null")
    return found.filter((F.col("seg_no") > 0) | ~F.col("label").eqNullSafe(F.col("lang"))).select("doc_id", "seg_no", "lang").distinct()
