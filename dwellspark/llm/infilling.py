"""Operator 12: fill-in-the-middle transformation.

A text is cut into lines. Two draws from a hash of its id cut the lines into prefix, middle and suffix, and the three
are written in another order, with a sentinel before each, so that a model that reads from left to right learns to
fill the middle in. All of it is Arrow's compute functions on whole batches: texts are split into lists of lines,
flattened with the rows that they come from, numbered, filtered by role, put back into lists and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch

#: Bytes of text that are worked on at once, about: a batch of long texts is cut into such parts (a longer text is one by itself).
PART_BYTES = 8 << 20


@dataclass(frozen=True)
class Form:
    """rate: how many texts of a hundred are transformed; spm: how many of these hundred have their suffix first.
    The three sentinels must differ, and none may overlap another or itself, as tags in brackets don't."""

    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        tags = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(tags):
            for j, b in enumerate(tags):
                if not a or i != j and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"{a!r} and {b!r} overlap")


def draws(key: Column, seed: str = "7") -> list[Column]:
    """Four numbers below 2^32 from a record's key: the first groups of eight hexadecimal digits of its SHA-256. A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _rest(x: pa.Array, n: pa.Array) -> pa.Array:
    """x modulo n, of numbers that aren't negative."""
    return pc.subtract(x, pc.multiply(pc.divide(x, n), n))


def _joined(units: pa.Array, parent: pa.Array, keep: pa.Array, rows: int) -> pa.Array:
    """One text for each row: its units that are kept, in order."""
    counts = pc.value_counts(pc.filter(parent, keep))
    held, many = counts.field("values"), counts.field("counts")
    of = pc.index_in(pa.array(np.arange(rows)), held)
    sizes = pc.fill_null(pc.take(many, of), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(units, keep)), pa.scalar("", pa.large_string()))


def transform(text: pa.Array, h: list[pa.Array], form: Form) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text (large strings without nulls); h: four draws of each."""
    rows = len(text)
    lists = pc.split_pattern(text, "\n")
    units, parent = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    # Where a list starts, to number its units from 0.
    sizes = pc.cast(pc.list_value_length(lists), pa.int64())
    starts = pc.subtract(pc.cumulative_sum(sizes), sizes) if rows else sizes
    at = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent))
    last = pc.equal(at, pc.subtract(pc.take(sizes, parent), 1))
    newline, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    units = pc.binary_join_element_wise(units, pc.if_else(last, none, newline), none)
    # What stands behind the last newline is a unit, unless it is empty.
    n = pc.subtract(sizes, pc.cast(pc.or_(pc.ends_with(text, "\n"), pc.equal(pc.binary_length(text), 0)), pa.int64()))
    cuts = [_rest(x, pc.add(n, 1)) for x in h[:2]]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, inside = pc.less(at, pc.take(first, parent)), pc.less(at, pc.take(second, parent))
    prefix = _joined(units, parent, before, rows)
    middle = _joined(units, parent, pc.and_not(inside, before), rows)
    suffix = _joined(units, parent, pc.invert(inside), rows)
    plain = pc.or_(pc.equal(pc.binary_length(text), 0), pc.greater_equal(_rest(h[2], pa.scalar(100, pa.int64())), form.rate))
    for tag in (form.prefix, form.suffix, form.middle):
        plain = pc.or_(plain, pc.match_substring(text, tag))
    swapped = pc.less(_rest(h[3], pa.scalar(100, pa.int64())), form.spm)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in (form.prefix, form.suffix, form.middle))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    absent = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(swapped, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, absent, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, absent, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.if_else(plain, text, pc.if_else(swapped, spm, psm)),
    }


def _split(text: pa.Array, tag: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind the first tag; each text has one."""
    lists = pc.split_pattern(text, tag, max_splits=1)
    return pc.list_element(lists, 0), pc.list_element(lists, 1)


def restore(output: pa.Array, kind: pa.Array, form: Form) -> pa.Array:
    """The texts that outputs (large strings) of a form were made of."""
    none, rows = pa.scalar("", pa.large_string()), pa.array(np.arange(len(output)))
    parts, places = [], []
    for name, tags in (("plain", None), ("psm", (form.prefix, form.suffix)), ("spm", (form.suffix, form.prefix))):
        own = pc.equal(kind, name)
        texts = pc.filter(output, own)
        if tags:
            one, rest = _split(_split(texts, tags[0])[1], tags[1])
            two, middle = _split(rest, form.middle)
            prefix, suffix = (one, two) if name == "psm" else (two, one)
            texts = pc.binary_join_element_wise(prefix, middle, suffix, none)
        parts.append(texts)
        places.append(pc.filter(rows, own))
    return pc.take(pa.concat_arrays(parts), pc.sort_indices(pa.concat_arrays(places)))


def _parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch by the bytes of a column of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > PART_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _large(x: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(x, pa.large_string()), "")


def fill_in_middle(docs: DataFrame, form: Form = Form(), id_col: str = "doc_id", text_col: str = "text", seed: str = "7") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row.

    n is the number of lines. A null text counts as empty, and an empty text stays as it is (plain, no lines), as
    does one that holds a sentinel. Rows of one id, repeated ones too, and null ids are cut by the same draws (a null id draws as the
    empty one). A very long text is a batch of its own. Other columns go, so none can clash; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))))

    def run(batch: pa.RecordBatch):
        for part in _parts(batch, 1):
            made = transform(_large(part.column(1)), [part.column(2 + k) for k in range(4)], form)
            made["form"], made["output"] = pc.cast(made["form"], pa.string()), pc.cast(made["output"], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], ["doc_id", *made])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, form: Form = Form(), form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """The columns of what fill_in_middle made, and the texts rebuilt from output and form as another one; a column that
    has its name is replaced. A null output is an empty text, a null form is plain."""
    kept = made.drop(name)
    output, kind = kept.columns.index(output_col), kept.columns.index(form_col)

    def run(batch: pa.RecordBatch):
        for part in _parts(batch, output):
            texts = restore(_large(part.column(output)), pc.fill_null(part.column(kind), "plain"), form)
            yield pa.RecordBatch.from_arrays([*part.columns, pc.cast(texts, pa.string())], [*part.schema.names, name])

    return by_batch(kept, run, kept.withColumn(name, F.lit("")).schema)


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: restored_sha256 is the text's own digest: this is what rebuilding must give.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CAST('0x' || h[25:32] AS BIGINT) % 100 AS swap FROM lines
), parts AS (
  SELECT doc_id, n, text, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN swap < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""
