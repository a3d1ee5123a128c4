"""Operator 3: byte-level BPE encoding and decoding.

Texts are cut at spaces into chunks, each block of documents keeps its distinct chunks once, and only these are split into
words by the tokenizer's pattern. The distinct words of all blocks are encoded by Spark higher-order functions: a fold
over the word's bytes that merges, step by step, the first pair of lowest rank; ranks come from a literal map that is
laid out as two arrays, so that a look-up takes an addition. A long word is folded in overlapping windows, which are put
together where two of them have the same token: neighbours in either window are then neighbours in the whole, and a
sequence of tokens is the encoding of a text if each two neighbours are that of theirs. A word whose windows have no token in
common is folded whole. Decoding concatenates the tokens' binary pieces, again once for each distinct chunk. The results
then meet the blocks they came from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import partitions, short_batches, texts

#: Text of a block in characters, at most, but for a single longer document.
BLOCK_CHARS = 12_000_000
#: Characters of the corpus to a bucket of words, at most.
BUCKET_CHARS = 32_000_000
#: Bytes of a window of a long word, and from the start of one to that of the next. Longer windows than the longest token.
WINDOW, STRIDE = 192, 64
#: A pair of ids is one number: PAIR * left + right. An entry of the table is PAIR * pair + rank.
PAIR = 1 << 17


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each token under each pair of tokens that makes it up."""
    found = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                found[left * PAIR + right] = rank
    return found


def laid_out(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and bases: the entry of a pair is at bases[left] + right, if the pair is there. Each left token's row of
    rights is laid over the rows before where no two entries meet, longest rows first."""
    width = 1 + max((k % PAIR for k in found), default=0)
    bases = np.zeros(1 + max((max(k // PAIR, k % PAIR) for k in found), default=0), np.int64)
    used, entries, top = np.zeros(2 * width + 4 * len(found) + 65_536, bool), {}, width
    rows: dict[int, list[int]] = {}
    for key in sorted(found):
        rows.setdefault(key // PAIR, []).append(key % PAIR)
    length, start = 0, 0
    for left, rights in sorted(rows.items(), key=lambda x: -len(x[1])):
        if len(rights) != length:
            length, start = len(rights), max(0, start - 4 * width)
        at = start
        while True:
            if at + 4096 + width > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            taken = np.zeros(4096, bool)
            for r in rights:
                taken |= used[at + r : at + r + 4096]
            free = int(taken.argmin())
            if not taken[free]:
                break
            at += 4096
        start = at = at + free
        bases[left] = at
        for r in rights:
            used[at + r] = True
            entries[at + r] = left * PAIR + found[left * PAIR + r]
        top = max(top, at + width)
    out = np.full(top, -1, np.int64)
    out[list(entries)] = list(entries.values())
    return out, bases


def _literal(values: list, kind: str = "bigint") -> Column:
    """An array that the optimizer folds into one literal; an array of that many literals would take it minutes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Coder:
    """Columns that encode a word, from literals of one rank file, which take megabytes of plan."""

    def __init__(self, ranks: dict[bytes, int]):
        entries, bases = laid_out(pair_ranks(ranks))
        self._entries, self._bases = _literal(entries.tolist()), _literal(bases.tolist())

    def _rank(self, left: Column, right: Column) -> Column:
        """The rank of a pair; PAIR or above if it is none, null if right is."""
        entry = F.get(self._entries, (F.get(self._bases, left.cast("int")) + right).cast("int"))
        return (entry - left * F.lit(PAIR)).bitwiseAND(F.lit((1 << 62) - 1))

    def ids(self, start: Column) -> Column:
        """array<bigint> of a word given as the ids of its bytes, by folding merges over them."""

        def step(state: Column, _: Column) -> Column:
            ids = state["ids"]
            ranks = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), self._rank)
            # A one-element array binds a value to a name, so that it is computed once.
            merged = F.transform(F.array(ranks), lambda r: _first_lowest(ids, r))
            return F.when(state["done"], state).otherwise(F.get(merged, F.lit(0)))

        state = F.struct(start.alias("ids"), (F.size(start) < 2).alias("done"))
        return F.aggregate(start, state, step)["ids"]


def _first_lowest(ids: Column, ranks: Column) -> Column:
    """ids with the first pair of the lowest rank merged, or as they are and done if no pair has a rank."""

    def merged(low: Column) -> Column:
        at = F.array_position(ranks, low).cast("int")
        joined = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, F.size(ids)))
        return F.when(low < PAIR, F.struct(joined.alias("ids"), (F.size(ids) < 3).alias("done"))).otherwise(F.struct(ids.alias("ids"), F.lit(True).alias("done")))

    return F.get(F.transform(F.array(F.array_min(ranks)), merged), F.lit(0))


def windows(word: bytes) -> list[tuple[int, int]]:
    """Starts and ends of the windows that a word is folded in: one, if it is no longer than a window. Within a run of one
    byte, windows start a whole number of strides from its start, where the run's tokens start too."""
    if len(word) <= WINDOW:
        return [(0, len(word))]
    raw, starts = np.frombuffer(word, np.uint8), [0]
    run = np.maximum.accumulate(np.where(np.r_[True, raw[1:] != raw[:-1]], np.arange(len(raw)), 0))
    for s in range(STRIDE, len(word) - WINDOW + STRIDE, STRIDE):
        if s - run[s] >= STRIDE:
            s -= int(s - run[s]) % STRIDE
        if s > starts[-1]:
            starts.append(s)
    return [(s, min(s + WINDOW, len(word))) for s in starts[:-1]] + [(starts[-1], len(word))]


def stitched(spans: list[tuple[int, int]], parts: list[list[int]], lengths: list[int]) -> list[int] | None:
    """The ids of a word from those of its windows, or none if two neighbours have no token in common. lengths: bytes of a token."""
    out, place = list(parts[0]), spans[0][0]
    at = {}  # where the tokens so far start, in the last window
    for i in out:
        at[place] = len(at)
        place += lengths[i]
    for (s, _), ids in zip(spans[1:], parts[1:]):
        place, own, meets = s, {}, None
        for k, i in enumerate(ids):
            own[place] = k
            # The first token of a window is cut off at its left, so its neighbour is not known.
            if meets is None and k and (n := at.get(place)) is not None and out[n] == i:
                meets = (n, k)
            place += lengths[i]
        if meets is None:
            return None
        del out[meets[0] :]
        out += ids[meets[1] :]
        at = {p: meets[0] + k - meets[1] for p, k in own.items() if k >= meets[1]}
    return out


class Splitter:
    """Words of a text by the pattern of the rank files. White space and letters are Unicode's; texts of ASCII and
    Western European letters alone take an equal pattern that the faster standard library runs."""

    _LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    _KNOWN = re.compile(rf"[\n\t\x20-\x7e{_LETTERS}]*")
    _FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        # The standard and the regex library count control characters 28 to 31 as white space, the pattern's own doesn't.
        self._any = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self._own = pattern == public_tokenizers.PATTERN

    def __call__(self, text: str) -> list[str]:
        return (self._FAST if self._own and self._KNOWN.fullmatch(text) else self._any).findall(text)


#: A space after what isn't white space by anyone's count, where a word always starts.
_SAFE = re.compile(r"(?<=\S) ")


def chunks(texts_in: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the texts' chunks as codes of them, and each text's number of chunks. A chunk that starts with a space
    stands for what follows it, any other for itself with a space before it: so all of a text but its beginning is cut at
    its spaces, since the pattern starts a word there whatever comes before. Only where white space stands on both sides of
    a space it doesn't, and these texts are cut into words at once."""
    listed = pc.split_pattern(texts_in.cast(pa.large_string()), " ")
    values = listed.values
    starts = listed.offsets.to_numpy()
    sizes = np.diff(starts)
    known = values.dictionary_encode()
    codes = known.indices.to_numpy().astype(np.int64)
    known = known.dictionary
    first, last = (_white(known, k) for k in (0, -1))
    wide = last[codes[:-1]] & first[codes[1:]]
    wide[starts[1:-1] - 1] = False  # from one text to the next
    odd = np.flatnonzero(np.add.reduceat(np.r_[wide, False], starts[:-1])) if len(codes) else np.empty(0, np.int64)
    more: dict[str, int] = {}
    heads = [" " + c for c in known.take(pa.array(codes[starts[:-1]])).to_pylist()]
    codes[starts[:-1]] = [more.setdefault(h, len(known) + len(more)) for h in heads]
    if not len(odd):
        return pa.concat_arrays([known, pa.array(list(more), pa.large_string())]), codes, sizes
    cut, parts = Splitter(), np.split(codes, starts[1:-1])
    for k, text in zip(odd.tolist(), texts_in.take(pa.array(odd)).to_pylist()):
        parts[k] = np.array([more.setdefault(" " + w, len(known) + len(more)) for part in _pieces_of(text) for w in cut(part)], np.int64)
        sizes[k] = len(parts[k])
    return pa.concat_arrays([known, pa.array(list(more), pa.large_string())]), np.concatenate(parts), sizes


def _white(values: pa.Array, at: int) -> np.ndarray:
    """Whether a value is empty or has white space at a place."""
    there = pc.utf8_slice_codeunits(values, at, at + 1 or None).dictionary_encode()
    return np.array([not c or c.isspace() for c in there.dictionary.to_pylist()], bool)[there.indices.to_numpy()]


class _Numbers(dict):
    """Numbers for keys in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


def _pieces_of(text: str) -> list[str]:
    """A text in parts of some length, each of which starts a word."""
    out, at = [], 0
    for m in _SAFE.finditer(text):
        if m.start() - at >= 10_000:
            out.append(text[at : m.start()])
            at = m.start()
    return [*out, text[at:]]


_SPLIT = "at string, doc_ids array<{id}>, sizes binary, codes binary, chunk_sizes binary, chunk_codes binary, block string, words binary, word_codes binary"


def _squeezed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _loose(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by the significance of their bytes: high ones are mostly zero."""
    return _squeezed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbered(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_loose(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _listed(words: list[bytes]) -> bytes:
    """Words of any bytes: their number, their lengths, and they themselves."""
    return _squeezed(np.array([len(words), *map(len, words)], "<u4").tobytes(), *words)


def _words(raw: bytes) -> list[bytes]:
    data = _loose(raw)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.r_[4 * n + 4, np.frombuffer(data, "<u4", n, 4)]).tolist()
    return [data[s:e] for s, e in zip(ends, ends[1:])]


def split(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of three kinds. At a block: some of its documents as codes of chunks, frequent ones having low codes; and its distinct
    chunks as codes of words. At a bucket: a block's distinct words of that bucket of their hash, with their codes. A null
    text is as an empty one."""
    rows = texts(docs, id_col, text_col)
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, number, id_type = Splitter(), TaskContext.get().partitionId(), 0, None
        names = ["at", "doc_ids", "sizes", "codes", "chunk_sizes", "chunk_codes", "block", "words", "word_codes"]

        def row(**have) -> pa.RecordBatch:
            kinds = (pa.string(), pa.list_(id_type), *[pa.binary()] * 4, pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([have.get(n)], k) for n, k in zip(names, kinds)], names)

        def block(held: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
            name = f"{part}-{number}"
            found, codes, sizes = chunks(pa.concat_arrays([t for _, t in held]))
            count = np.bincount(codes, minlength=len(found))
            order = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
            place = np.empty(len(found), np.int64)
            place[order] = np.arange(len(order))
            codes = place[codes]
            doc_ids, ends = pa.concat_arrays([d for d, _ in held]).to_pylist(), np.cumsum(np.r_[0, sizes])
            for s in range(0, len(doc_ids), 256):
                e = min(s + 256, len(doc_ids))
                yield row(at=name, doc_ids=doc_ids[s:e], sizes=_numbers(sizes[s:e]), codes=_numbers(codes[ends[s] : ends[e]]))
            known, flat, counts = _Numbers(), array("I"), array("I")
            for s in range(0, len(order), 20_000):
                for c in found.take(pa.array(order[s : s + 20_000])).to_pylist():
                    own = cut(c[1:] if c[:1] == " " else " " + c)
                    counts.append(len(own))
                    flat.extend(map(known.__getitem__, own))
            yield row(at=name, chunk_sizes=_numbers(np.array(counts)), chunk_codes=_numbers(np.array(flat)))
            dealt: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
            for word, c in known.items():
                raw = word.encode("utf-8", "surrogatepass")
                dealt[zlib.crc32(raw) % buckets].append((raw, c))
            for b, own in sorted(dealt.items()):
                own.sort()
                yield row(at=str(b), block=name, words=_listed([w for w, _ in own]), word_codes=_numbers(np.array([c for _, c in own])))
            pa.default_memory_pool().release_unused()

        held, chars = [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            text = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            lengths = pc.utf8_length(text).to_pylist()
            start = 0
            for k, n in enumerate(lengths):
                if chars and chars + n > block_chars:
                    held.append((batch.column(0).slice(start, k - start), text.slice(start, k - start)))
                    yield from block(held)
                    held, chars, number, start = [], 0, number + 1, k
                chars += n
            if len(lengths) > start:
                held.append((batch.column(0).slice(start), text.slice(start)))
        if held:
            yield from block(held)

    return rows.mapInArrow(run, _SPLIT.format(id=rows.schema["doc_id"].dataType.simpleString()))


_KNOWN = "bucket string, known binary, counts binary, ids binary"


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """rows: at, words (packed lists; null in other rows), by at. The distinct words of each place and their ids, packed in turn,
    in some rows: bucket, known, counts, ids. A word that had to be folded whole has a row of its own and its ids there."""
    ranks = ranks_of(path)
    coder = Coder(ranks)
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def distinct(table: pa.Table) -> pa.Table:
        found = sorted({w for raw in table["words"].to_pylist() if raw is not None for w in _words(raw)})
        spans = [windows(w) if len(w) > WINDOW else None for w in found]
        parts = [p for w, own in zip(found, spans) for p in ([w] if own is None else [w[s:e] for s, e in own])]
        inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(first[np.frombuffer(b"".join(parts), np.uint8)]))
        outer = pa.array(np.cumsum([0, *(1 if own is None else len(own) for own in spans)]), pa.int32())
        bucket = pa.array([table["at"][0].as_py()] * len(found), pa.string())
        return pa.table([bucket, pa.array(found, pa.binary()), pa.ListArray.from_arrays(outer, inner)], ["bucket", "word", "parts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = list(map(len, _pieces(path)))

        def row(bucket: str, known: list[bytes], counts: np.ndarray | None, ids: np.ndarray | None, whole: bytes | None = None) -> pa.RecordBatch:
            columns = (bucket, _listed(known), *(None if c is None else _numbers(c) for c in (counts, ids)), None if whole is None else first[np.frombuffer(whole, np.uint8)])
            kinds = (pa.string(), *[pa.binary()] * 3, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], ["bucket", "known", "counts", "ids", "whole"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for b in pc.unique(batch.column(0)).to_pylist():
                own = table.filter(pc.equal(table["bucket"], b)).combine_chunks()
                one = pc.equal(pc.list_value_length(own["ids"]), 1)
                short, long = own.filter(one), own.filter(pc.invert(one))
                ids = pc.list_flatten(short["ids"])
                yield row(b, short["word"].to_pylist(), pc.list_value_length(ids).to_numpy(), pc.list_flatten(ids).to_numpy())
                for w, parts in zip(long["word"].to_pylist(), long["ids"].to_pylist()):
                    found = stitched(windows(w), parts, lengths)
                    yield row(b, [w], None, None, w) if found is None else row(b, [w], np.array([len(found)]), np.array(found))

    dealt = rows.groupBy("at").applyInArrow(distinct, "bucket string, word binary, parts array<array<bigint>>")
    folded = dealt.select("bucket", "word", F.transform("parts", coder.ids).alias("ids")).mapInArrow(pack, _KNOWN + ", whole array<bigint>")
    return folded.withColumn("whole", F.when(F.col("whole").isNotNull(), coder.ids(F.col("whole"))))


def _gathered(values: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """The values (large_binary) of the codes, those of each run of so many joined."""
    taken = values.take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
    ends = offsets[np.cumsum(np.r_[0, sizes])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, so many of each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded (the ids' bytes) for each row, repeated rows
    included. digests: the SHA-256 of the latter two instead, as lower-case hexadecimal digits."""
    # All kinds of rows go to their places in one exchange, which is written once and read three times. It has as many
    # tasks as partitions, however few the bytes: the fold is long in work. Words have a bucket for each BUCKET_CHARS of the corpus, if
    # that is more: what one holds doesn't grow with the corpus.
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    buckets = max(n, -(-total // BUCKET_CHARS))
    rows = split(docs, buckets, id_col, text_col, block_chars).repartition(n, "at")
    known = encode_words(rows, path)

    def tell(asked: pa.Table, told: pa.Table) -> pa.Table:
        """Ids of a bucket's words to the blocks that have them."""
        have, counts, flat = [], [], []
        for raw, n, ids, whole in zip(*(told[c].to_pylist() for c in ("known", "counts", "ids", "whole"))):
            have += _words(raw)
            counts.append(np.array([len(whole)], "<u4") if whole is not None else _numbered(n))
            flat.append(np.array(whole, "<u4") if whole is not None else _numbered(ids))
        counts, flat, have = (np.concatenate([*x, np.empty(0, "<u4")]) if x is not have else pa.array(x, pa.binary()) for x in (counts, flat, have))
        counts = counts.astype(np.int64)
        starts = np.cumsum(counts) - counts
        out, asked = [], asked.filter(pc.is_valid(asked["words"]))
        for block, raw, codes in zip(*(asked[c].to_pylist() for c in ("block", "words", "word_codes"))):
            own = pc.index_in(pa.array(_words(raw), pa.binary()), have).to_numpy()
            out.append((block, codes, _numbers(counts[own]), _numbers(flat[_ranges(starts[own], counts[own])])))
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), *[pa.binary()] * 3))], ["of", "word_codes", "counts", "ids"])

    def meet(rows_in: pa.Table, told: pa.Table) -> pa.Table:
        """Ids and their bytes for a block's documents: each chunk's once, as text and as pieces."""
        if not told.num_rows and rows_in["chunk_sizes"].null_count == rows_in.num_rows:
            rows_in = rows_in.slice(0, 0)  # a bucket's rows
        pieces = _pieces(path)
        codes, counts, flat = (np.concatenate([*map(_numbered, told[c].to_pylist()), np.empty(0, "<u4")]).astype(np.int64) for c in ("word_codes", "counts", "ids"))
        order = np.argsort(codes)
        flat, counts = flat[_ranges((np.cumsum(counts) - counts)[order], counts[order])], counts[order]
        of = rows_in.filter(pc.is_valid(rows_in["chunk_sizes"]))
        words_in, words_of_chunk = (np.concatenate([*map(_numbered, of[c].to_pylist()), np.empty(0, "<u4")]).astype(np.int64) for c in ("chunk_codes", "chunk_sizes"))
        n = np.add.reduceat(np.r_[counts[words_in], 0], np.minimum(np.cumsum(words_of_chunk) - words_of_chunk, len(words_in))) * (words_of_chunk > 0)
        by_id = [pa.array([b"%d " % i for i in range(len(pieces))], pa.large_binary()), pa.array(pieces, pa.large_binary())]
        by_chunk = [_gathered(_gathered(v, flat, counts), words_in, words_of_chunk) for v in by_id]
        documents, totals, joined, decoded = rows_in.filter(pc.is_valid(rows_in["codes"])), [], [], []
        for sizes, codes_in in zip(documents["sizes"].to_pylist(), documents["codes"].to_pylist()):
            sizes, own = _numbered(sizes).astype(np.int64), _numbered(codes_in).astype(np.int64)
            ends = np.cumsum(np.r_[0, sizes])
            upto = np.cumsum(np.r_[0, n[own]])
            totals.append(upto[ends[1:]] - upto[ends[:-1]])
            for value, out, cut in zip(by_chunk, (joined, decoded), (1, 0)):
                _, cuts, data = _gathered(value, own, sizes).buffers()
                cuts, data = np.frombuffer(cuts, np.int64).tolist(), memoryview(data)
                made = [data[s : max(s, e - cut)] for s, e in zip(cuts, cuts[1:])]
                out += [hashlib.sha256(v).hexdigest() for v in made] if digests else [v.tobytes() for v in made]
        pa.default_memory_pool().release_unused()
        joined = pa.array(joined if digests else [j.decode() for j in joined], pa.string())
        ids_in = pc.list_flatten(documents["doc_ids"])
        return pa.table([ids_in, pa.array(np.concatenate([*totals, np.empty(0, np.int64)])), joined, pa.array(decoded, pa.string() if digests else pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    answers = rows.groupBy("at").cogroup(known.groupBy("bucket")).applyInArrow(tell, "of string, word_codes binary, counts binary, ids binary")
    id_type = rows.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids string, decoded {'string' if digests else 'binary'}"
    return rows.groupBy("at").cogroup(answers.groupBy("of")).applyInArrow(meet, schema)


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
