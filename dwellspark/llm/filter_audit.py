"""Operator 11: filter interaction audit.

What each of a chain of filters removes depends on what stands before it. Each document is tested once against all
filters; documents are counted by part and by the mask of the filters that they fail. For five filters a part has 32
such cells, and all that is asked of any order follows from how many documents survive each of the 32 subsets. The
subsets are walked in Gray code: one filter is switched on or off in a step, each cell's number of failing active filters
goes up or down with it, and the survivors change by the cells whose number leaves or comes back to nought. A step of an order
is the difference of two of the 32 states.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import stored

FILTERS = "ABCDE"
#: Parts whose steps are made at once.
PARTS = 256
_MEASURES = ("n", "good", "toxic")
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> dict[str, Column]:
    """The conditions of all filters that read the text alone (not null). Each is true where the text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def tested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask for each row; bit k of mask is set where the row fails FILTERS[k].

    A null text counts as empty, a null part as the empty string. E is failed by a row whose text a row of a smaller id has too; rows of
    one id aren't smaller than each other, so repeated rows fail together or not at all, and null ids neither fail nor make others fail.
    Texts are compared by their SHA-256: the least id of each digest is counted before it is shuffled, and joined on id and
    digest, so a text that a third of all rows share is no hot key. Other columns go."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << FILTERS.index(k))).otherwise(0) for k, fails in failures(text).items()), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    rows = stored(rows)  # read twice; texts are tested once
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("first"), F.col("digest").alias("of"))
    joined = rows.join(first, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    return joined.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, and for each measure (n, good, toxic) its 2^filters counts by mask, as an array. A document is good or toxic if any row of
    labels for its id says so; rows of labels without an id say nothing. Parts and masks are counted before they are shuffled."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(
        F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic")
    )
    joined = rows.join(known, F.col("doc_id") == F.col("of"), "left")
    counts = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _MEASURES[1:]))

    def by_mask(c: str) -> Column:
        held = F.map_from_entries(F.collect_list(F.struct("mask", c)))  # at most one entry for each mask
        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda m: F.coalesce(F.get(F.map_values(F.map_filter(held, lambda k, _: k == m)), F.lit(0)), F.lit(0)))

    return counts.groupBy("part").agg(*(by_mask(c).alias(c) for c in _MEASURES))


def survivors(counts: np.ndarray, filters: int) -> np.ndarray:
    """counts: (..., 2^filters) numbers by mask of failed filters. The same shape: how many survive each subset of
    filters, by one walk through the subsets in Gray code."""
    states = np.zeros_like(counts)
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, np.int64)  # active filters that a cell fails
    running = counts.sum(-1)
    subset = 0
    states[..., 0] = running
    for i in range(1, 1 << filters):
        bit = i & -i  # the only one in which two neighbours of the code differ
        subset ^= bit
        fails = (masks & bit) != 0
        if subset & bit:
            gone = fails & (failing == 0)
            failing += fails
            running = running - counts[..., gone].sum(-1)
        else:
            failing -= fails
            running = running + counts[..., fails & (failing == 0)].sum(-1)
        states[..., subset] = running
    return states


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step, the subset before it and the bit of its filter."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def steps(counts: DataFrame) -> DataFrame:
    """One row for each part of cells(), order of the filters and step; an empty table gives an empty one."""
    filters, plan = len(FILTERS), _steps()

    def run(batches):
        orders, numbers = [p[0] for p in plan], [p[1] for p in plan]
        before, bits = np.array([p[2] for p in plan]), np.array([p[3] for p in plan])
        after, every = before | bits, (1 << filters) - 1
        weights = [math.factorial(k) * math.factorial(filters - 1 - k) for k in range(filters)]
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                part = batch.slice(start, PARTS)
                held = np.stack([part.column(1 + k).flatten().to_numpy().reshape(part.num_rows, 1 << filters) for k in range(len(_MEASURES))], 1)
                left = survivors(held, filters)
                n, lost = left[:, 0], left[:, :, before] - left[:, :, after]
                shapley = np.zeros((part.num_rows, every + 1), np.int64)  # by the bit of a filter
                for bit in (1 << k for k in range(filters)):
                    for subset in (s for s in range(every + 1) if not s & bit):
                        shapley[:, bit] += weights[subset.bit_count()] * (n[:, subset] - n[:, subset | bit])
                fails, alone = n[:, [0]] - n[:, bits], n[:, every ^ bits] - n[:, [every]]
                made = [n[:, after], lost[:, 0], fails - lost[:, 0], alone, lost[:, 1], lost[:, 2], shapley[:, bits]]
                names = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(plan))))
                columns = [names, pa.array(orders * part.num_rows), pa.array(numbers * part.num_rows, pa.int32()), *(pa.array(np.ascontiguousarray(x).ravel(), pa.int64()) for x in made)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])

    return counts.select("part", *_MEASURES).mapInArrow(run, _SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, each order of the filters and each step: what the step keeps and removes. See tested() and cells() for odd rows."""
    return steps(cells(tested(docs, id_col, text_col, part_col), labels))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS INT)
      + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, mask & own > 0 AS failed, mask & before > 0 AS gone, mask = own AS alone FROM c, s),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
