"""Operator 13: benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of ten words, and a window the set of its shingles (of four words; of two or
one in shorter items). A document holds a window if it holds all its shingles, in place, so any one of them is necessary: the
prefix of a set that must be contained whole is its rarest token. Documents are read once. Of each, only runs of consecutive
shingles that benchmark shingles look like (by a bitmap of their hashes) and that are as long as a window needs are kept; equal runs, as copies
and passages that many documents share have, are one. Shingles are counted over all runs, each window is joined by its
rarest one, bounded by its place and length in the run, and verified word by word. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import stored

WINDOW = 10
#: Words of a shingle, by the least length of a window that is cut into such ones.
SHINGLES = {4: 4, 2: 2, 1: 1}
#: Bits of a bitmap for each distinct shingle of the benchmark, about, and the most it may have: 2 MB, which go with each task. A fuller bitmap lets more
#: runs through, and the join sorts them out.
BITS, MOST_BITS = 16, 1 << 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: runs of ASCII letters, digits and all that isn't ASCII. A null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hashes of two neighbours that lie so far apart, by the place of the first."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def _with_grams(df: DataFrame, column: str = "w") -> DataFrame:
    """df and columns g1, g2, g4: hashes of the runs of so many words, by their start."""
    return df.withColumn("g1", F.transform(column, lambda x: F.xxhash64(x))).withColumn("g2", _pairs(F.col("g1"), 1)).withColumn("g4", _pairs(F.col("g2"), 2))


def _shingle(length: Column) -> Column:
    return F.when(length >= 4, 4).when(length >= 2, 2).otherwise(1)


def _grams_of(k: Column) -> Column:
    return F.when(k == 4, F.col("g4")).when(k == 2, F.col("g2")).otherwise(F.col("g1"))


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, wid, text for each distinct window of an item. wid: a digest of text, its words joined by a space. Items without
    words have none; a null id counts as the empty one, and rows of one id are one item."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(window)), " "))).alias("text"))
    return cut.distinct().select("item", _digest(F.col("text")).alias("wid"), "text")


def tokens(found: DataFrame) -> DataFrame:
    """wid, text, length, k, o, h: the shingles of each distinct window, with their places in it."""
    each = _with_grams(found.groupBy("wid").agg(F.first("text").alias("text")).withColumn("w", F.split("text", " ")))
    each = each.withColumn("length", F.size("w")).withColumn("k", _shingle(F.col("length")))
    return each.select("wid", "text", "length", "k", F.posexplode(_grams_of(F.col("k"))).alias("o", "h"))


class Seen:
    """For each length of shingles that a benchmark has: a bitmap of their hashes, of a bounded size, and how many
    of them in a row the shortest window has."""

    def __init__(self, each: DataFrame):
        found = each.groupBy("k").agg(F.approx_count_distinct("h").alias("n"), F.min("length").alias("least")).collect()  # three rows at most
        self.need = {r.k: r.least - r.k + 1 for r in found}
        bits = {r.k: min(MOST_BITS, max(1 << 12, 1 << math.ceil(math.log2(BITS * r.n)))) for r in found}
        self._shift = {k: 64 - int(math.log2(b)) for k, b in bits.items()}
        self._words = {}
        for k, shift in self._shift.items():
            own = each.where(F.col("k") == k).select(F.shiftrightunsigned("h", shift).alias("at"))
            rows = own.groupBy(F.shiftright("at", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).collect()
            held = [0] * (bits[k] >> 6)  # MOST_BITS / 64 numbers at most
            for r in rows:
                held[r.at] = r.bits
            # One literal once the optimizer has folded it.
            self._words[k] = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def places(self, k: int, hashes: Column) -> Column:
        """Where in an array of hashes those of shingles of the benchmark are, and some others."""

        def place(h: Column, i: Column) -> Column:
            at = F.shiftrightunsigned(h, self._shift[k])
            return F.when(F.getbit(F.get(self._words[k], F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1, i)

        return F.array_compact(F.transform(hashes, place))


def _runs(k: int, need: int) -> Column:
    """array<struct<k, start, text>> of the runs of at least so many consecutive places in p{k}."""
    p = F.col(f"p{k}")
    starts = F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1) < x - 1))
    ends = F.filter(p, lambda x, j: (j == F.size(p) - 1) | (F.get(p, j + 1) > x + 1))
    long = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: r["e"] - r["s"] + 1 >= need)
    return F.transform(long, lambda r: F.struct(F.lit(k).alias("k"), r["s"].alias("start"), F.array_join(F.slice("w", r["s"] + 1, r["e"] - r["s"] + k), " ").alias("text")))


def candidates(docs: DataFrame, seen: Seen, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, runs for each row. key: a digest of id and text, equal for repeated rows only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(F.concat(name, F.lit(":"), text)).alias("key"), words(text).alias("w"))
    rows = _with_grams(rows)
    for k in seen.need:
        rows = rows.withColumn(f"p{k}", seen.places(k, F.col(f"g{k}")))
    runs = F.concat(*(_runs(k, need) for k, need in seen.need.items()))
    return rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), runs.alias("runs"))


def _rid(run: str) -> Column:
    return _digest(F.concat(F.col(f"{run}k").cast("string"), F.lit(":"), F.col(f"{run}text")))


def occurrences(runs: DataFrame, each: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid, s, e, wid: each window in each run, from word s to before word e. runs: rid, k, text, n (documents that hold it)."""
    cut = _with_grams(runs.withColumn("w", F.split("text", " ")))
    left = window - 1
    at = lambda i: F.struct(F.get("g", i).alias("h"), i.alias("i"), F.slice("w", F.greatest(i - left, F.lit(0)) + 1, F.lit(left + window)).alias("around"))
    cut = cut.select("rid", "k", "n", "w", F.size("w").alias("size"), _grams_of(F.col("k")).alias("g"))
    places = F.sequence(F.lit(0), F.size("g") - 1)
    rarity = cut.select("k", "n", F.explode("g").alias("h")).groupBy("k", "h").agg(F.sum("n").alias("n"))
    rarity = rarity.select(F.col("k").alias("of"), F.col("h").alias("shingle"), "n")
    # Merged, not broadcast: Spark takes an exploded table to be as small as its file.
    known = each.join(rarity.hint("merge"), (F.col("k") == F.col("of")) & (F.col("h") == F.col("shingle")), "left")
    prefix = known.groupBy("wid", "text", "length", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("first"))
    prefix = prefix.where("first.n > 0").select("wid", F.col("text").alias("window"), "length", F.col("k").alias("of"), F.col("first.h").alias("shingle"), F.col("first.o").alias("o"))
    tokens = cut.select("rid", "k", "size", F.explode(F.transform(places, at)).alias("t")).select("rid", "k", "size", "t.*")
    met = tokens.join(prefix.hint("merge"), (F.col("k") == F.col("of")) & (F.col("h") == F.col("shingle")))
    met = met.withColumn("s", F.col("i") - F.col("o")).where("s >= 0 AND s + length <= size")
    begins = F.col("s") - F.greatest(F.col("i") - left, F.lit(0))
    verified = met.where(F.array_join(F.slice("around", begins + 1, F.col("length")), " ") == F.col("window"))
    return verified.select("rid", "s", (F.col("s") + F.col("length")).alias("e"), "wid")


def _covered(spans: Column) -> Column:
    """How many places lie in any of the spans, an array of (s, e)."""
    add = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"].cast("long")


def _result(rows: DataFrame, hit: Column, items: Column) -> DataFrame:
    listed = F.array_join(F.array_sort(items), ",")
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), items.alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ids: Sequence[str] = ("doc_id", "item_id"), text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for each row of docs.

    A document without words, empty or null, has no hits. Rows of one id are judged each by its own text; repeated rows, and rows with null ids, get the results of
    their texts too. An empty benchmark, or one without words, hits nothing; an empty table of documents gives an empty one. Very long texts are
    cut into runs where they lie. Other columns of both tables go, so none can clash."""
    found = stored(windows(benchmark, window, ids[1], text_col))
    each = tokens(found)
    seen = Seen(each)
    nothing = F.array().cast("array<string>")
    if not seen.need:
        clean = docs.select(F.col(ids[0]).alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
        return _result(clean, F.lit(0).cast("long"), nothing)
    rows = stored(candidates(docs, seen, ids[0], text_col))
    of_docs = rows.where("size(runs) > 0").select("key", F.explode("runs").alias("run")).select("key", "run.*").withColumn("rid", _rid(""))
    runs = stored(of_docs.groupBy("rid", "k", "text").agg(F.count(F.lit(1)).alias("n")))
    met = occurrences(runs, each, window).join(found.select("wid", "item").hint("merge"), "wid")
    known = met.groupBy(F.col("rid").alias("of")).agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("item").alias("items"))
    shifted = F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e")))
    hits = of_docs.select("key", "start", "rid").join(known.hint("merge"), F.col("rid") == F.col("of")).select("key", shifted.alias("spans"), "items")
    hits = hits.groupBy(F.col("key").alias("hit")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    checked = rows.where("size(runs) > 0").select("doc_id", "key", "n_words").join(hits.hint("merge"), F.col("key") == F.col("hit"), "left")
    checked = _result(checked, F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")), F.coalesce("items", nothing))
    return checked.unionByName(_result(rows.where("size(runs) = 0"), F.lit(0).cast("long"), nothing))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
q AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
o AS (SELECT q.r, q.s, q.n, p.item FROM q JOIN p ON q.win = p.win AND q.n = p.n),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT r, s, n FROM o)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
