"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it splits the languages in two, and a
binary classifier over hashed character n-grams predicts that bit. A text's
margins are compared with every codeword by a logistic loss, weighted by how
well each bit separates its languages; the nearest codeword wins, and a small
lead over the next one is flagged as ambiguous.

Fitting counts n-grams of a bounded sample (``per_language`` rows of each
language, chosen by a hash of the id) and keeps ``bits x BUCKETS`` weights,
whatever the size of the table. Predicting is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfade.llm.text import byte_texts, pieces

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Characters turned into n-grams at once.
_CHUNK = 1 << 19
_SPACE = 32


def _letters() -> np.ndarray:
    """For each code point below U+10000: its lower-case letter, or a space."""
    table = np.full(1 << 16, _SPACE, dtype=np.uint32)
    for code in range(1 << 16):
        low = chr(code).lower()
        if chr(code).isalpha():
            table[code] = ord(low[0])
    return table


_tables: list[np.ndarray] = []


def _fold(text: bytes) -> np.ndarray:
    """Lower-case letters with single spaces between words and at both ends."""
    if not _tables:
        _tables.append(_letters())
    codes = np.frombuffer((b" " + text + b" ").decode().encode("utf-32-le"), dtype=np.uint32)
    folded = np.where(codes < 1 << 16, _tables[0][codes & 0xFFFF], codes)
    return folded[np.append(True, (folded[1:] != _SPACE) | (folded[:-1] != _SPACE))]


def _grams(folded: np.ndarray) -> np.ndarray:
    """Buckets of all bigrams and of the trigrams within words (their ends included)."""
    a, b = folded[:-1], folded[1:]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    inner = b[:-1] != _SPACE
    three = (two[:-1] + folded[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))[inner]
    mixed = np.concatenate([two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(17)


def _chunks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """``(grams, rows, starts)``: n-grams of several texts, or of a piece of one, with whose they are."""
    grams, rows, starts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text, _CHUNK):
            found = _grams(_fold(piece))
            if len(found):
                rows.append(row)
                starts.append(size)
                grams.append(found)
                size += len(found)
            if size >= _CHUNK:
                yield np.concatenate(grams), rows, starts
                grams, rows, starts, size = [], [], [], 0
    if grams:
        yield np.concatenate(grams), rows, starts


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``(n, bits)`` of -1 and 1: all splits of up to five languages, else the best of some random codes."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 5:
        sides = range(1, 1 << (n - 1))  # the last language is always on the same side
        return np.array([[1 if side >> i & 1 else -1 for side in sides] for i in range(n)], dtype=np.int8)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit that splits nothing
        distance = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if distance > least:
            best, least = code, distance
    return best


@dataclass(frozen=True)
class Model:
    """Weights of the bit classifiers, and how to read their margins."""

    languages: list[str]
    code: np.ndarray  # (languages, bits) of -1 and 1
    weights: np.ndarray  # (buckets, bits): log odds of an n-gram
    scale: np.ndarray  # (bits,): mean size of a margin on the languages it was learned from

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """``(texts, languages)``: weighted logistic loss of each codeword."""
        z = 4.0 * margins / self.scale
        share = self.scale / self.scale.sum()
        return np.stack([np.logaddexp(0, -z * word) @ share for word in self.code], axis=1)

    def margins(self, texts: Iterator[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds of each text's n-grams per bit, and the number of n-grams."""
        total, count = np.zeros((n, len(self.scale))), np.zeros(n)
        for grams, rows, starts in _chunks(texts):
            np.add.at(total, rows, np.add.reduceat(self.weights[grams], starts, axis=0))
            np.add.at(count, rows, np.diff([*starts, len(grams)]))
        return total / np.maximum(count, 1)[:, None], count


def fit(
    docs: DataFrame,
    per_language: int = 3000,
    smoothing: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from rows with a text and a language: about ``per_language`` of each.

    The rows are those whose id hashes lowest, so a table of any size gives a
    sample of bounded size; below the bound every row counts. Equal texts of a
    language count once. Without any such row the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k])))), F.col("lang"))
    sample = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)) | F.col("id").isNull())
    sample = sample.select("text", "lang").distinct()
    at = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), BUCKETS), dtype=np.int64)
        for batch in batches:
            of = [at[x] for x in batch.column(1).to_pylist()]
            for grams, rows, starts in _chunks(byte_texts(batch.column(0))):
                for row, start, end in zip(rows, starts, [*starts[1:], len(grams)]):
                    total[of[row]] += np.bincount(grams[start:end], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang bigint, bucket bigint, n bigint")
    grouped = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), BUCKETS), smoothing)
    counts[grouped["lang"], grouped["bucket"]] += grouped["n"]
    chance = counts / counts.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    sides = [(chance[code[:, b] > 0].mean(axis=0), chance[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    weights = np.stack([np.log(p / q) for p, q in sides], axis=1) if sides else np.zeros((BUCKETS, 0))
    scale = np.maximum(np.abs(chance @ weights).mean(axis=0), 1e-9)
    return Model(languages, code, weights.astype(np.float32), scale)


def identify(
    docs: DataFrame,
    model: Model,
    lead: float = 0.1,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``; columns of these names are replaced.

    ``score`` is the share of the winning language (0 to 1) and ``ambiguous``
    says that it leads the next one by less than ``lead``. A text that is NULL
    or has no letter is ``und`` with score 0, and so is every text if the model
    knows no language. A model of one language gives that, with score 1. Whole
    texts count; every row is kept, repeats included.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(columns.index(text_col))
            margins, count = model.margins(byte_texts(text), len(text))
            if len(model.languages) > 1:
                loss = model.losses(margins) * np.minimum(np.sqrt(count), 30)[:, None]
                share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share /= share.sum(axis=1, keepdims=True)
            else:
                share = np.ones((len(text), len(model.languages)))
            ordered = np.sort(share, axis=1)
            best = share.argmax(axis=1) if model.languages else np.zeros(len(text), dtype=int)
            known = np.array([any(map(str.isalpha, t.as_py() or "")) for t in text]) & bool(model.languages) if len(text) else np.zeros(0, bool)
            second = ordered[:, -2] if len(model.languages) > 1 else np.zeros(len(text))
            first = ordered[:, -1] if model.languages else np.zeros(len(text))
            names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            added = [
                pa.array(names, pa.string()),
                pa.array(np.where(known, first, 0.0), pa.float64()),
                pa.array(np.where(known, first - second < lead, True), pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*columns).schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*columns).mapInArrow(predict, schema)
