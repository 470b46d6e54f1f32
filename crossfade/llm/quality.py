"""Quality by hierarchical empirical Bayes: the document, its path, its host, everything.

A logistic classifier over a text's shape gives the evidence of the document
alone, as a log likelihood ratio. Labelled documents are counted by host and by
path (grouped sums, so a host with a third of all rows costs no more); a host's
rate of good documents is shrunk towards the global one and a path's towards
its host's, the more so the fewer labels it has. How strongly is estimated from
how much hosts (and paths of one host) differ beyond chance. Prior odds of the
path and evidence of the document give the posterior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfade.llm.text import byte_texts, pieces
from crossfade.sources.staging import stage

FEATURES = (
    "upper", "log_upper", "digit", "mark", "log_mark", "shout", "log_shout", "symbol", "log_symbol",
    "repeat", "log_repeat", "variety", "word_length", "same_lines", "log_words",
)
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_MARKS, _SYMBOLS = b".,;:?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def shape(text: bytes) -> list[float]:
    """:data:`FEATURES` of one whole text; all zero but the logarithms if it is empty."""
    bytes_, words, letters, repeats, seen = np.zeros(256, dtype=np.int64), 0, 0, 0, set()
    lines, line_set, last = 0, set(), None
    for piece in pieces(text):
        bytes_ += np.bincount(np.frombuffer(piece, dtype=np.uint8), minlength=256)
        found = piece.split()
        if not found:
            continue
        repeats += sum(map(eq, found, found[1:])) + (found[0] == last)
        last = found[-1]
        words += len(found)
        letters += sum(map(len, found))
        seen.update(found)
        for line in piece.split(b"\n"):
            if line.strip():
                lines += 1
                line_set.add(hash(line))
    chars = int(bytes_.sum())
    latin = int(bytes_[_UPPER].sum() + bytes_[_LOWER].sum())
    upper = _share(int(bytes_[_UPPER].sum()), latin)
    mark, shout = _share(int(bytes_[list(_MARKS)].sum()), chars), _share(int(bytes_[33]), chars)
    symbol, repeat = _share(int(bytes_[list(_SYMBOLS)].sum()), chars), _share(repeats, words)
    log = lambda x: math.log(x + 1e-3)
    variety = math.log(len(seen) + 1) / math.log(words + 2)
    digit = _share(int(bytes_[_DIGIT].sum()), chars)
    return [
        upper, log(upper), digit, mark, log(mark), shout, log(shout), symbol, log(symbol),
        repeat, log(repeat), variety, _share(letters, words), 1 - _share(len(line_set), lines) if lines else 0.0, math.log(words + 1),
    ]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``features``, an array of :data:`FEATURES`; a column of this name is replaced."""
    columns = [c for c in docs.columns if c != "features"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shape(t) for t in byte_texts(batch.column(columns.index(text_col)))]
            features = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, features], [*columns, "features"])

    chosen = docs.select(*columns)
    schema = T.StructType([*chosen.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    return chosen.mapInArrow(compute, schema)


@dataclass(frozen=True)
class Classifier:
    """A logistic model of standardised features; ``prior`` is the log odds of its sample."""

    mean: np.ndarray
    deviation: np.ndarray
    slope: np.ndarray
    intercept: float
    prior: float

    def evidence(self, features: str = "features", most: float = 12.0) -> Column:
        """Log likelihood ratio of a document, within ``most`` either way."""
        total = F.lit(float(self.intercept - self.prior))
        for i, (m, d, s) in enumerate(zip(self.mean, self.deviation, self.slope)):
            total = total + (F.col(features)[i] - float(m)) * float(s / d)
        return F.greatest(F.least(total, F.lit(most)), F.lit(-most))


def fit_classifier(labelled: DataFrame, fit_rows: int = 20_000, ridge: float = 1.0, steps: int = 30) -> Classifier:
    """From about ``fit_rows`` rows of ``good`` and ``features``, those whose id hashes lowest.

    Without rows of both kinds the evidence of every document is zero.
    """
    n = labelled.count()
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, fit_rows / max(n, 1)) * (1 << 20)
    rows = labelled.filter(low).select("good", "features").toPandas()
    y = rows["good"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        zero = np.zeros(len(FEATURES))
        return Classifier(zero, zero + 1, zero, 0.0, 0.0)
    x = np.array(rows["features"].tolist())
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    penalty = np.diag([1e-9] + [ridge] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (p - y) + penalty @ beta
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, slope)
        size = float(np.abs(change).max())
        beta -= change * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return Classifier(mean, deviation, beta[1:], float(beta[0]), math.log(y.mean() / (1 - y.mean())))


def _strength(groups: DataFrame, n: str, good: str, rate: Column, parents: int) -> float:
    """Pseudo-counts of the prior of groups around ``rate``, by the method of moments.

    The excess of the groups' scatter over that of chance gives the correlation
    ``rho`` within a group, and the prior weighs ``(1 - rho) / rho`` documents.
    """
    spread = F.greatest(rate * (1 - rate), F.lit(1e-6))
    row = groups.filter(F.col(n) > 0).agg(
        F.count("*").alias("k"),
        F.sum(n).alias("n"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"),
        F.sum(F.col(n) * (F.col(good) / F.col(n) - rate) ** 2 / spread).alias("q"),
    ).first()
    if not row["k"]:
        return 1.0
    free = row["k"] - parents
    rho = (row["q"] - free) / max(row["n"] - row["nn"] / row["n"] - free, 1.0) if free > 0 else 0.0
    rho = min(max(rho, 1e-3), 0.9)
    return (1 - rho) / rho


def site_rates(labelled: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """``(global rate, (host, host_rate), (host, path, path_rate))`` of rows ``host, path, good``.

    Rates are posterior means. NULL hosts and paths are sites of their own. The
    global rate of no rows is a half.
    """
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    paths = stage(paths, "quality-paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("k")).first()
    overall = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    m = _strength(hosts, "n", "good", F.lit(overall), 1)
    host_rate = (F.col("good") + m * overall) / (F.col("n") + m)
    hosts = hosts.select("host", host_rate.alias("host_rate"))
    of_host = hosts.withColumnRenamed("host", "h")
    paths = stage(paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-paths")
    m = _strength(paths, "n", "good", F.col("host_rate"), total["k"] or 0)
    path_rate = (F.col("good") + m * F.col("host_rate")) / (F.col("n") + m)
    return overall, stage(hosts, "quality-hosts"), stage(paths.select("host", "path", path_rate.alias("path_rate")), "quality-paths")


@dataclass(frozen=True)
class Model:
    classifier: Classifier
    overall: float
    hosts: DataFrame
    paths: DataFrame


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
) -> tuple[Model, DataFrame]:
    """The model, and the measured ``(doc_id, host, path, features)`` of all ``docs``.

    A document is good if its labels (NULL ones don't count) are 1 on average
    at least half. Labels of unknown documents and NULL ids don't count.
    """
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")
    )
    measured = stage(measure(chosen).drop("text"), "quality-measured")
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg((F.avg(label_col) >= 0.5).cast("int").alias("good"))
    labelled = measured.join(marks, F.col("doc_id") == F.col("id")).select("doc_id", "host", "path", "good", "features")
    labelled = stage(labelled, "quality-labelled")
    return Model(fit_classifier(labelled, fit_rows), *site_rates(labelled)), measured


def score(measured: DataFrame, model: Model, keep_above: float = 0.5, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``measured`` with ``evidence``, ``site_rate``, ``quality_score`` and ``keep`` in place of ``features``.

    A path without labels has its host's rate, and a host without any the
    global one. ``keep`` holds from ``keep_above`` on. Every row is kept,
    repeats included; columns of these names are replaced.
    """
    added = ("evidence", "site_rate", "quality_score", "keep")
    columns = [c for c in measured.columns if c not in (*added, "features")]
    rows = measured.select(*columns, model.classifier.evidence().alias("__evidence"))
    hosts = model.hosts.select(F.col("host").alias("__host"), F.col("host_rate").alias("__host_rate"))
    paths = model.paths.select(F.col("host").alias("__on"), F.col("path").alias("__path"), F.col("path_rate").alias("__path_rate"))
    host, path = F.col(host_col).cast("string"), F.col(path_col).cast("string")
    rows = rows.join(hosts, host.eqNullSafe(F.col("__host")), "left")
    rows = rows.join(paths, host.eqNullSafe(F.col("__on")) & path.eqNullSafe(F.col("__path")), "left")
    rate = F.coalesce("__path_rate", "__host_rate", F.lit(model.overall))
    posterior = 1 / (1 + F.exp(-(F.col("__evidence") + F.log(rate / (1 - rate)))))
    return rows.select(
        *columns, F.col("__evidence").alias("evidence"), rate.alias("site_rate"), posterior.alias("quality_score"), (posterior >= keep_above).alias("keep")
    )
