"""Operator 1: quality classifier by compression.

A text is seen twice: as it is, and as its shape, in which a run of lower-case letters, capitals, digits or one
sign is a single byte and a word that repeats the one before is an equals sign. For either view two zstandard
dictionaries hold labelled text, one of good and one of bad documents. A view is cut into pieces of PIECE bytes,
each piece is compressed with either dictionary, and the difference of the two sums of sizes, divided by their sum,
is a feature of a logistic calibration. Pieces of shapes are short: within a longer piece, a repeated pattern is
compressed by its own start, and either dictionary would do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch, texts

#: Bytes of a piece of either view: long enough for phrases, short enough that a dictionary keeps its weight.
PIECE = (1024, 64)
#: Labelled rows of each class that are read for fitting, at most, and their longest text in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Bytes of text that fill a dictionary, at most: what a compressor of this level looks back on. A bound on the sample, as SAMPLE_ROWS is:
#: texts go in whole and in the hash's order, until the next one would exceed it.
DICTIONARY_BYTES = 2 << 20
LEVEL = 3
#: Added to the sum of sizes, in bytes: a very short text says little either way.
SMOOTH = 32
THRESHOLD = 0.3
RIDGE = 2.0


#: Classes of bytes in a shape; bytes of longer UTF-8 sequences count as letters, white space as a space.
_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in range(256)
)


def _shape(raw: bytes) -> bytes:
    words = raw.split()
    marked = b" ".join([b"=" if w == before else w for w, before in zip(words, [b"", *words])])
    codes = np.frombuffer(marked.translate(_SHAPE), np.uint8)
    # Equals signs stay apart: their number is what counts.
    return codes[np.r_[True, (codes[1:] != codes[:-1])] if len(codes) else slice(0)].tobytes().replace(b" =", b"=")


@dataclass(frozen=True)
class Model:
    """good, bad: raw dictionary content for each view. weights: the calibration of the two features, and its offset."""

    good: tuple[bytes, bytes]
    bad: tuple[bytes, bytes]
    weights: tuple[float, float, float]


class Scorer:
    """Compressors of one task; a compressor can't be sent to executors."""

    def __init__(self, good: tuple[bytes, bytes], bad: tuple[bytes, bytes]):
        made = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=self._loaded(raw), write_content_size=False, write_dict_id=False)
        self.pairs = [(made(g), made(b)) for g, b in zip(good, bad)]

    @staticmethod
    def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return made

    def features(self, texts: list[str]) -> list[tuple[float, ...]]:
        """Of each text; above 0: the good dictionary serves better. One compressor after the other goes through all texts, for a dictionary and its tables are all
        that a processor's cache holds."""
        raw, out = [t.encode("utf-8", "surrogatepass") for t in texts], []
        for views, (for_good, for_bad), size in zip((raw, list(map(_shape, raw))), self.pairs, PIECE):
            good, bad = ([sum(len(c.compress(v[at : at + size])) for at in range(0, max(1, len(v)), size)) for v in views] for c in (for_good, for_bad))
            out.append([(b - g) / (b + g + SMOOTH) for g, b in zip(good, bad)])
        return list(zip(*out))


def _sample(documents: DataFrame, known: DataFrame) -> list[tuple[str, int]]:
    """Texts of at most SAMPLE_ROWS ids of either class, by a hash of the id. Only ids are sorted; texts are read for
    the chosen ones alone. Of rows that repeat an id, the least text counts."""
    at = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == c).orderBy(at, "doc_id").limit(SAMPLE_ROWS) for c in (0, 1)]
    short = texts(documents).where(F.length("text").between(1, SAMPLE_CHARS))
    # Broadcast: two times SAMPLE_ROWS rows of an id and a label.
    rows = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r.text, r.label) for r in sorted(rows.select("text", "label", at.alias("at")).collect(), key=lambda r: (r.at, r.text))]


def _within(texts: list[bytes], size: int) -> list[bytes]:
    """The first texts, whole, that together have at most so many bytes with a byte between; the first one in any case, for its start is
    as good as a dictionary gets."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    return texts[: max(1, int(np.searchsorted(ends, size, "right")))]


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with Platt's smoothed targets. The ridge on the slopes holds back what a few
    rows seem to say; on hundreds it hardly shows."""
    n1, n0 = float(y.sum()), float((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.diag([RIDGE] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (target - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    slopes = w[:-1] / scale
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


def fit(documents: DataFrame, known: DataFrame) -> Model:
    """documents: doc_id, text. known: doc_id (once each), label (0 or 1). Null texts, null labels and empty texts teach nothing. Without rows of both
    classes there is nothing to tell apart: every score is then the smoothed share of label 1."""
    rows = _sample(documents, known)
    # Every other row of a class, in the hash's order: one part for the dictionaries, one for the calibration.
    taught, rest = [{c: [t for t, y in rows if y == c][part::2] for c in (0, 1)} for part in (0, 1)]
    raw = {c: _within([t.encode("utf-8", "surrogatepass") for t in taught[c]], DICTIONARY_BYTES) for c in (0, 1)}
    content = {c: tuple(b"\n".join(view) for view in (raw[c], map(_shape, raw[c]))) for c in (0, 1)}
    if min(map(len, content[0] + content[1])) < 8 or not (rest[0] and rest[1]):
        good, n = sum(y for _, y in rows), len(rows)
        return Model((), (), (0.0, 0.0, math.log((good + 1) / (n - good + 1))))
    scorer = Scorer(content[1], content[0])
    x = np.array(scorer.features([t for c in (0, 1) for t in rest[c]]))
    y = np.array([float(c) for c in (0, 1) for _ in rest[c]])
    return Model(content[1], content[0], _calibrated(x, y))


def _scores(model: Model, texts: list[str | None]) -> list[float]:
    scorer, (*slopes, offset) = _scorer(model), model.weights
    seen = scorer.features([t or "" for t in texts]) if scorer else [()] * len(texts)
    logits = [offset + sum(w * f for w, f in zip(slopes, x)) for x in seen]
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in logits]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row of docs, in any order. A null text is scored as an empty one."""

    def run(batch: pa.RecordBatch):
        values = _scores(model, batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = texts(docs, id_col, text_col)
    return by_batch(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is at least threshold, with all their columns, repeated rows and null ids included. A null
    text is scored as an empty one."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array([s >= threshold for s in _scores(model, batch.column(at).to_pylist())], pa.bool_()))

    return by_batch(docs, run, docs.schema)


_HELD: dict = {}


def _scorer(model: Model) -> Scorer | None:
    """One Scorer for each worker and model."""
    if not model.good:
        return None
    if model not in _HELD:
        _HELD.clear()
        _HELD[model] = Scorer(model.good, model.bad)
    return _HELD[model]


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit_on_tables(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out. Labels of a repeated doc_id count once; differing ones, not at all."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    known = known.where(F.col("label") == F.col("most")).select("doc_id", "label")
    return fit(documents, known)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_tables(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
