"""Operator 5: packing by non-negative least squares.

Documents become pieces of at most one window: full windows, and a rest. Rests are counted by length, in units of
UNIT tokens. Combinations of two or three lengths that fill a window are the columns of a non-negative least squares
problem against that histogram; the rounded solution says how often each combination is used, and what is left is
packed greedily, largest first. The plan has a few rows per length, whatever the number of documents; pieces find
their place in it by their number among those of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from dwellspark.llm.common import by_batch, stored, texts
from dwellspark.llm.sharding import slots

WINDOW = 2048
#: Tokens to which lengths are rounded up for planning: the most that a piece can waste is one less.
UNIT = 8
#: The id after each document.
END = 1


def ranks_of_json(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE file of the tokenizers library, without special tokens. Its vocabulary writes
    each byte as a printable character: those that are printable as themselves, the others from 256 on."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["id"] for x in told["added_tokens"]}
    return {bytes(shown[c] for c in token): i for token, i in told["model"]["vocab"].items() if i not in special}


class Encoder:
    """Ids of a text by a byte-level BPE file, the same as the tokenizers library gives with special tokens taken as
    ordinary text; merges run in tiktoken. Its pattern needs a look ahead only for runs of white space, and is
    several times slower with it: texts without such runs go without."""

    _RUNS = re.compile(r"\s\s|[\x1c-\x1f]")

    def __init__(self, path: str):
        ranks = ranks_of_json(path)
        whole = public_tokenizers.PATTERN
        made = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._any, self._single = made("any", whole), made("single", whole.replace(r"\s+(?!\S)|", ""))

    def __call__(self, text: str) -> list[int]:
        return (self._any if self._RUNS.search(text) else self._single).encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of each document, full windows first. A null text is as
    an empty one, which has the closing id alone. Repeated rows have pieces of their own."""
    rows = texts(docs, id_col, text_col)

    def run(batch: pa.RecordBatch):
        encode, of, start, length, crc, total = encoder(path), [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = encode(text) if text else []
            ids.append(END)
            raw, n = np.array(ids, dtype="<u4").data.cast("B"), len(ids)
            for s in range(0, n, window):
                k = min(window, n - s)
                of.append(i)
                start.append(s)
                length.append(k)
                crc.append(zlib.crc32(raw[4 * s : 4 * (s + k)]))
                total.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return by_batch(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(units: int) -> list[tuple[int, ...]]:
    """Two or three lengths, largest first, that sum to units exactly."""
    pairs = [(units - b, b) for b in range(1, units // 2 + 1)]
    triples = [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return pairs + triples


def nnls(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """min |ax - b| over x >= 0 by active sets (Lawson and Hanson), for at most `steps` changes of the set."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            m = a[:, at]
            s = np.linalg.solve(m.T @ m + 1e-10 * np.eye(len(at)), m.T @ b)
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            ratio = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += ratio * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            passive[at[bad & (x[at] <= 1e-12)]] = False
            x[~passive] = 0
    return x


def plan(counts: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): combinations that together use each length, in units, exactly as often as it is there."""
    left = Counter({k: n for k, n in counts.items() if n > 0})
    found: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        need = Counter(lengths)
        times = min([times, *(left[k] // n for k, n in need.items())])
        if times > 0:
            found.append((lengths, times))
            for k, n in need.items():
                left[k] -= n * times

    there = set(left)
    columns = [c for c in combinations(units) if there.issuperset(c)]
    if columns:
        a = np.zeros((units + 1, len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                a[k, j] += 1
        b = np.array([left[k] for k in range(units + 1)], float)
        scale = max(1.0, b.max())
        x = nnls(a, b / scale, 3 * units) * scale
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            use(columns[j], int(x[j]))
    while +left:  # each pass uses up a length at least
        room, lengths, spare = units, [], Counter(left)
        while fits := [k for k, n in spare.items() if n > 0 and k <= room]:
            k = max(fits)
            lengths.append(k)
            spare[k] -= 1
            room -= k
        use(tuple(lengths), max(left.values()))
    return found


def pack(cut: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, and others), which are read several times: give
    a stored table. Each sequence has at most window tokens and its offsets are gapless from 0. Repeated pieces are
    pieces of their own; null ids are ids like others. Columns of any other name go along; sequence_id and offset are replaced."""
    spark, units = cut.sparkSession, window // unit
    # The piece's own columns go along as one, so that their names don't meet those made here.
    own = F.struct(*(c for c in cut.columns if c not in ("sequence_id", "offset"))).alias("_piece")
    cut = cut.select("doc_id", "start", "length", "ids_crc32", own)
    rests = cut.where(F.col("length") < window).withColumn("_bin", F.ceil(F.col("length") / unit).cast("int"))
    # One row for each length at most, whatever the number of pieces.
    counts = {r["_bin"]: r["n"] for r in rests.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, first, ranges = Counter(), 0, []
    for lengths, times in plan(counts, units):
        for position, k in enumerate(lengths):
            ranges.append((k, used[k], used[k] + times, first, position))
            used[k] += times
        first += times
    spread = ["doc_id", "start", "ids_crc32"]
    table = spark.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "_k int, _lo long, _hi long, _first long, _position int")
    found = slots(rests, "_bin", spread).join(F.broadcast(table), (F.col("_bin") == F.col("_k")) & (F.col("slot") >= F.col("_lo")) & (F.col("slot") < F.col("_hi")))
    found = found.withColumn("sequence_id", F.col("_first") + F.col("slot") - F.col("_lo"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_position").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).select("_piece.*", "sequence_id", "offset")
    whole = slots(cut.where(F.col("length") == window).withColumn("_bin", F.lit(0)), "_bin", spread)
    whole = whole.withColumn("sequence_id", F.col("slot") + first).withColumn("offset", F.lit(0).cast("long")).select("_piece.*", "sequence_id", "offset")
    return found.unionByName(whole)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    return pack(stored(pieces(docs, path)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
