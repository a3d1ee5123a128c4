"""Operator 2: substring dedup by prefix-partitioned suffix trees.

Words that lie in a run of WINDOW words which also starts earlier in the corpus are removed. Suffixes are taken at
anchors: in each window, the run of PREFIX words with the least hash. Equal windows have equal anchors at equal
places, so a suffix that starts at an anchor, with the few words left of it, stands for all windows around it.

1. Anchors are counted by prefix. Those whose prefix occurs once can't lie in a repeat and go.
2. The remaining suffixes are dealt out by prefix: PREFIX words long, or a whole window where so many suffixes share
   the short prefix that they would fill a task. There are as many groups of prefixes as the corpus is a multiple of
   GROUP_CHARS, so a group fits in memory at any size. Each builds the tree of its suffixes, as their order and the words
   that neighbours have in common, and one of the words to their left; windows below one deep internal node of both are
   equal. All but the first go. Tasks first do the same to their own suffixes before they send what is left, so a passage that a third
   of all documents share is sent once by each task.
3. The starts of repeated windows return to their documents, whose covered words are removed.

Documents of equal texts are found first by their hash; only the first of them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import WORD, partitions, short_batches, stored
from dwellspark.llm.wordhash import grams, hashes, mixed, packed, unpacked, words

WINDOW = 20
#: Words of a short prefix.
PREFIX = 8
#: Words to the left of an anchor that a window can have.
LEFT = WINDOW - PREFIX
#: Suffixes with one short prefix from which it is extended to a whole window.
CROWDED = 20_000
#: Characters of the corpus for which there is one group of prefixes.
GROUP_CHARS = 16_000_000
#: Rows that a task gathers before it looks for repeats among them and sends the rest.
GATHERED_WORDS, GATHERED_SUFFIXES = 8_000_000, 100_000
_ANCHOR = (("<u8", 1), ("<i8", 1), ("<i4", 1), ("<i4", 1), ("<u4", 1))
_SUFFIX = (("<i8", 1), ("<i4", 1), ("<i4", 1), ("<u2", 1), ("<u8", LEFT + WINDOW))
_NONE = np.iinfo(np.int64).min


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: places of its anchors, their prefixes' hashes, and the first and last start of
    the windows that have each as theirs. In a tie the leftmost counts."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 1 + (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    g = grams(h, PREFIX)
    at, span = np.arange(len(g)), 1
    while span < LEFT + 1:
        step = min(span, LEFT + 1 - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        span += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    return at[first], g[at[first]], first, last


def tree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of suffixes, one a row: their order by words, and for each place of this order how many words it has in
    common with the place before. A node of depth d is a run of places, all but the first of which have d words or more."""
    order = np.lexsort(words.T[::-1])
    rows = words[order]
    same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, np.r_[0, same][: len(order)]


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of this depth that each suffix hangs from, numbered from the left; one that hangs from none alone has its own."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) - 1
    return out


def deepest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Depth of the deepest internal node above each suffix."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.r_[common[1:], 0][: len(order)])
    return out


def repeats(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, mask: np.ndarray, context: np.ndarray) -> np.ndarray:
    """mask of the windows (bit d: the one that starts d words before the anchor) that occur earlier among the rows.
    context: words from LEFT before the anchor to WINDOW after its start. Rows need no order; rows of one place, of a
    document that is there several times, are one.

    A window d words before its anchor repeats where its suffix hangs from an internal node of depth WINDOW - d and, in
    the tree of the words to the left, nearest first, from one of depth d, together with another suffix. Over all d,
    the repeats of a pair of suffixes are the windows of the one maximal repeat around their anchors."""
    order = np.lexsort((at, sub, doc))
    new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (doc, sub, at)], axis=0)][: len(at)]
    if not new.all():
        starts = np.flatnonzero(new)
        one, out = order[starts], np.zeros(len(at), np.uint16)
        found = repeats(doc[one], sub[one], at[one], np.bitwise_or.reduceat(mask[order], starts), context[one])
        out[order] = found[np.cumsum(new) - 1]
        return out & mask
    out = np.zeros(len(at), np.uint16)
    known, n = np.unique(grams_at(context, LEFT, PREFIX), return_inverse=True, return_counts=True)[1:]
    rows = order[n[known[order]] > 1]  # equal prefixes have equal hashes: others hang from the root alone
    if not len(rows):
        return out
    mask, context = mask[rows], context[rows]
    right, left = tree(context[:, LEFT:]), tree(context[:, LEFT - 1 :: -1])
    right_depth, left_depth = deepest(*right), deepest(*left)
    found = np.zeros(len(rows), np.uint16)
    for d in range(LEFT + 1):
        there = np.flatnonzero((mask & np.uint16(1 << d) > 0) & (right_depth >= WINDOW - d) & (left_depth >= d))
        if len(there):
            both = nodes(*right, WINDOW - d)[there] * len(rows) + nodes(*left, d)[there]
            first = np.unique(both, return_index=True)[1]
            later = np.ones(len(there), bool)
            later[first] = False
            found[there[later]] |= np.uint16(1 << d)
    out[rows] = found
    return out


def _rows(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


_SENT = (["bucket", "kind", "payload"], [pa.int64(), pa.int32(), pa.binary()])


def _by_bucket(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> tuple[list[int], list[int], list[bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    ends = [*cuts[1:], len(bucket)]
    return [int(bucket[s]) for s in cuts], [kind] * len(cuts), [packed(*(c[s:e] for c in columns)) for s, e in zip(cuts, ends)]


def _counted(buckets: int, gathered_words: int):
    """First pass: anchors to the bucket of their prefix. A prefix that the task holds more than once is sent once,
    as an anchor of no place, with its count; its anchors are repeated anyway and go along as such."""

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        g, doc, sub, at = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.argsort(g, kind="stable")
        g, doc, sub, at = g[order], doc[order], sub[order], at[order]
        _, first, counts = np.unique(g, return_index=True, return_counts=True)
        n = np.repeat(counts, counts)
        one, several = n == 1, first[counts > 1]
        places = [np.r_[a[one], np.full(len(several), none, a.dtype)] for a, none in ((doc, _NONE), (sub, -1), (at, -1))]
        asked = np.r_[g[one], g[several]]
        out = _by_bucket((asked % np.uint64(buckets)).astype(np.int64), 0, [asked, *places, np.r_[n[one], n[several]].astype("<u4")])
        known = ~one
        told = _by_bucket((g[known] % np.uint64(buckets)).astype(np.int64), 1, [g[known], doc[known], sub[known], at[known], n[known].astype("<u4")])
        yield _rows([a + b for a, b in zip(out, told)], *_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for batch in batches:
            for doc, sub, text in zip(*(c.to_pylist() for c in batch.columns[:3])):
                h = hashes(words(text))
                at, g, _, _ = anchors(h)
                if len(at):
                    held.append((g, np.full(len(at), doc, "<i8"), np.full(len(at), sub, "<i4"), at.astype("<i4")))
                gathered += len(h)
            if gathered >= gathered_words:
                if held:
                    yield from send(held)
                held, gathered = [], 0
        if held:
            yield from send(held)

    return run


def _flagged(crowded: int):
    """Anchors whose prefix occurs twice or more, as doc, sub, and places; crowded ones are marked in the last bit."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(kind, unpacked(raw, *_ANCHOR)) for kind, raw in zip(table["kind"].to_pylist(), table["payload"].to_pylist())]
        asked = [p for kind, p in parts if kind == 0]
        g = np.concatenate([p[0] for p in asked]) if asked else np.empty(0, np.uint64)
        counts = np.concatenate([p[4] for p in asked]) if asked else np.empty(0, "<u4")
        unique, inverse = np.unique(g, return_inverse=True)
        total = np.bincount(inverse, counts, len(unique)) if len(unique) else np.empty(0)
        rows = []
        for _, (own, doc, sub, at, _) in parts:
            n = total[np.searchsorted(unique, own)]
            keep = (n > 1) & (at >= 0)
            rows.append((doc[keep], sub[keep], at[keep] * 2 + (n[keep] > crowded)))
        doc, sub, at = (np.concatenate([r[i] for r in rows]) for i in range(3))
        return pa.table([pa.array(doc, pa.int64()), pa.array(sub, pa.int32()), pa.array(at.astype("<i4"), pa.int32())], ["of", "of_sub", "at"])

    return run


def _grown(buckets: int, gathered_suffixes: int):
    """Second pass: suffixes of the flagged anchors to the bucket of their prefix; starts that repeat within the task,
    as such."""

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, sub, at, mask, context, crowded = (np.concatenate([x[i] for x in held]) for i in range(6))
        again = repeats(doc, sub, at, mask, context)
        out = [[], [], []]

        def add(found: tuple) -> None:
            for have, new in zip(out, found):
                have.extend(new)

        add(_starts(doc, sub, at, again, lambda d: mixed(d.astype(np.uint64)) % np.uint64(buckets)))
        mask = mask & ~again
        short = np.flatnonzero((mask > 0) & ~crowded)
        prefix = grams_at(context[short], LEFT, PREFIX)
        add(_by_bucket((prefix % np.uint64(buckets)).astype(np.int64), 0, [x[short] for x in (doc, sub, at, mask, context)]))
        for d in range(LEFT + 1):  # a crowded prefix is a whole window long: one suffix for each
            whole = np.flatnonzero((mask & np.uint16(1 << d) > 0) & crowded)
            if len(whole):
                prefix = grams_at(context[whole], LEFT - d, WINDOW)
                single = np.full(len(whole), 1 << d, "<u2")
                add(_by_bucket((prefix % np.uint64(buckets)).astype(np.int64), 0, [doc[whole], sub[whole], at[whole], single, context[whole]]))
        yield _rows(out, *_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for batch in batches:
            for doc, sub, text, places in zip(*(c.to_pylist() for c in batch.columns[:4])):
                h = hashes(words(text))
                at, _, first, last = anchors(h)
                told = np.unique(np.array(places, np.int64))
                rows = np.flatnonzero(np.isin(at, told >> 1))
                at, first, last = at[rows], first[rows], last[rows]
                padded = np.r_[np.zeros(LEFT, np.uint64), h, np.zeros(WINDOW, np.uint64)]
                context = padded[at[:, None] + np.arange(LEFT + WINDOW)]
                mask = (np.left_shift(1, at - first + 1) - np.left_shift(1, at - last)).astype("<u2")
                held.append((np.full(len(at), doc, "<i8"), np.full(len(at), sub, "<i4"), at.astype("<i4"), mask, context, np.isin(at * 2 + 1, told)))
                gathered += len(at)
                if gathered >= gathered_suffixes:
                    yield from send(held)
                    held, gathered = [], 0
        if gathered:
            yield from send(held)

    return run


def grams_at(context: np.ndarray, start: int, size: int) -> np.ndarray:
    out = context[:, start].copy()
    for j in range(1, size):
        out = mixed(out) + context[:, start + j]
    return mixed(out)


_START = (("<i8", 1), ("<i4", 1), ("<i4", 1))


def _starts(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, mask: np.ndarray, bucket) -> tuple[list, list, list]:
    """Starts of the windows of a mask, packed by bucket."""
    own, starts = [], []
    for d in range(LEFT + 1):
        there = np.flatnonzero(mask & np.uint16(1 << d))
        own.append(there)
        starts.append(at[there] - d)
    own, starts = np.concatenate(own), np.concatenate(starts).astype("<i4")
    return _by_bucket(bucket(doc[own]).astype(np.int64), 1, [doc[own], sub[own], starts])


def _repeated(table: pa.Table) -> pa.Table:
    """Starts of repeated windows by document: those of the bucket's suffixes, and those that tasks found before."""
    suffixes, told = [], []
    for kind, raw in zip(table["kind"].to_pylist(), table["payload"].to_pylist()):
        (told if kind else suffixes).append(unpacked(raw, *(_START if kind else _SUFFIX)))
    if suffixes:
        doc, sub, at, mask, context = (np.concatenate([s[i] for s in suffixes]) for i in range(5))
        again = repeats(doc, sub, at, mask, context)
        for raw in _starts(doc, sub, at, again, lambda d: np.zeros(len(d)))[2]:
            told.append(unpacked(raw, *_START))
    schema = pa.schema([("of", pa.int64()), ("of_sub", pa.int32()), ("starts", pa.binary())])
    if not told:
        return schema.empty_table()
    doc, sub, start = (np.concatenate([t[i] for t in told]) for i in range(3))
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order].astype("<i4")
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]) if len(doc) else np.empty(0, np.int64)
    ends = [*cuts[1:], len(doc)]
    return pa.table([pa.array(doc[cuts]), pa.array(sub[cuts]), pa.array([start[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary())], schema=schema)


def _cut(digests: bool):
    """Third pass: documents without their covered words."""
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def one(text: str | None, starts: list[bytes] | None, copy: bool) -> tuple[int, int, str | None]:
        found = words(text)
        n = len(found)
        covered = np.zeros(n + 1, np.int64)
        if copy and n >= WINDOW:
            covered[0] += 1
        for raw in starts or ():
            s = np.frombuffer(raw, "<i4")
            np.add.at(covered, s, 1)
            np.add.at(covered, s + WINDOW, -1)
        gone = np.cumsum(covered)[:n] > 0
        removed = int(gone.sum())
        if digests:
            kept = " ".join([w for w, g in zip(found, gone.tolist()) if not g] if removed else found)
            return n, removed, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
        if not removed:
            return n, 0, text
        out, at = [], 0  # a removed word goes with the white space before it, or after it at the start
        for m, g in zip(WORD.finditer(text), gone.tolist()):
            if not g:
                out.append(text[at : m.end()] if out else m[0])
            at = m.end()
        return n, removed, "".join([*out, text[at:]]) if out else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:4]))]
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], names + batch.schema.names[4:])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, carry: Sequence[str] = (), crowded: int = CROWDED, gathered: tuple[int, int] = (GATHERED_WORDS, GATHERED_SUFFIXES)) -> DataFrame:
    """doc_id, n_words, n_removed, kept, and a struct carried of the columns to carry, for each row: kept is the text without its repeated words (null stays null), or
    with digests the SHA-256 of its kept words joined by one space. id_col is a whole number; a null id comes before
    all others. Rows that repeat an id with another text are documents of their own, in the order of a hash; rows
    that repeat both are one document, seen several times."""
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("sub"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    rest = ["carried"] if carry else []
    # Copies: all but the first id of each text. Hashes and ids alone are shuffled.
    known = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("of"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("of_sub"), F.md5(text.cast("binary")).alias("md5"), F.length(text).cast("long").alias("chars"))
    known = stored(known.groupBy("md5", "of", "of_sub").agg(F.lit(True).alias("copy"), F.max("chars").alias("chars")))
    buckets = max(partitions(spark), (known.agg(F.sum("chars")).first()[0] or 0) // GROUP_CHARS)
    first = known.groupBy("md5").agg(F.min("of").alias("first"))
    copies = known.join(first, "md5").where(F.col("of") > F.col("first")).select("of", "of_sub", "copy")

    def meet(small: DataFrame, how: str) -> DataFrame:
        """Documents keep their side of the shuffle, which is written once: each pass reads the same columns of it."""
        return rows.join(small.hint("shuffle_hash"), (F.col("key") == F.col("of")) & (F.col("sub") == F.col("of_sub")), how)

    sent = meet(copies, "left").where(F.col("copy").isNull()).select("key", "sub", "text", *rest).mapInArrow(_counted(buckets, gathered[0]), "bucket long, kind int, payload binary")
    flagged = sent.groupBy("bucket").applyInArrow(_flagged(crowded), "of long, of_sub int, at int").groupBy("of", "of_sub").agg(F.collect_list("at").alias("places"))
    grown = meet(flagged, "inner").select("key", "sub", "text", "places", *rest).mapInArrow(_grown(buckets, gathered[1]), "bucket long, kind int, payload binary")
    starts = grown.groupBy("bucket").applyInArrow(_repeated, "of long, of_sub int, starts binary")
    told = starts.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("starts", F.lit(None).cast("binary")))
    told = told.groupBy("of", "of_sub").agg(F.collect_list("starts").alias("starts"), F.max("copy").alias("copy"))
    last = meet(told, "left").select(F.nullif("key", F.lit(_NONE)).alias("doc_id"), "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"), *rest)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return last.mapInArrow(_cut(digests), f"{schema}, carried {rows.schema['carried'].dataType.simpleString()}" if carry else schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS run FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE again),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""
