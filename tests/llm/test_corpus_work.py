"""Operators 11, 12 and 13 against plain code."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dwellspark.llm import decontamination, filter_audit, infilling

from . import edge

LINE = re.compile(r"[^\n]*\n|[^\n]+")


@pytest.fixture(scope="module")
def docs(spark):
    return edge.documents(spark).cache()


# 11


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text)]
    return sum(1 << k for k, f in enumerate(fails) if f)


def plain_audit(rows, labels):
    """rows: (doc_id, part, text). Each order is applied to the documents themselves."""
    ids = defaultdict(list)
    for i, _, text in rows:
        if i is not None:
            ids[text or ""].append(i)
    parts = defaultdict(list)
    for i, part, text in rows:
        copy = i is not None and min(ids[text or ""]) < i
        parts[part or ""].append((plain_mask(text or "") | 16 * copy, any(x == 1 for j, x, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out = {}
    for part, found in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = found, []
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                out_now, left = [d for d in left if d[0] & bit], [d for d in left if not d[0] & bit]
                total[name] += len(out_now)
                alone = sum(d[0] == bit for d in found)
                out[part, "".join(order), step] = [len(left), len(out_now), sum(bool(d[0] & bit) for d in gone), alone, sum(d[1] for d in out_now), sum(d[2] for d in out_now), name]
                gone = gone + out_now
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = total[out[key][-1]]
    return out


def audited(found):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}


def test_audit_of_odd_rows(spark, docs):
    rng = random.Random(5)
    given = [(i, rng.choice(["a", "b", "", None]), t) for i, t in edge.rows()]
    given += [(500 + i, "a", "Some #words And More " * rng.choice([3, 60])) for i in range(40)] + [(500, "b", "Some #words And More " * 3)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, None, *range(0, 540, 3), *range(0, 540, 7)]]
    table = spark.createDataFrame([(i, t, s, None, 1) for i, s, t in given], "doc_id long, text string, source string, mask string, part int").repartition(3)
    known = spark.createDataFrame([(*r, None) for r in labels], "doc_id long, quality int, toxic int, source string")
    found = filter_audit.audit(table, known)
    assert audited(found) == plain_audit(given, labels)
    assert filter_audit.audit(table.limit(0), known).collect() == []
    none = audited(filter_audit.audit(table, known.limit(0)))
    assert len(none) == 3 * 600 and not any(v[4] or v[5] for v in none.values())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_survivors_of_each_subset(filters, seed):
    counts = np.random.default_rng(seed).integers(0, 9, (3, 2, 1 << filters))
    found = filter_audit.survivors(counts, filters)
    for subset in range(1 << filters):
        assert (found[..., subset] == counts[..., [m for m in range(1 << filters) if not m & subset]].sum(-1)).all()


def test_many_parts(spark):
    counts = spark.range(700).selectExpr("CAST(id AS STRING) AS part", *(f"transform(sequence(0, 31), m -> CAST(pmod(hash(id, m, {k}), 5) AS LONG)) AS {c}" for k, c in enumerate(["n", "good", "toxic"])))
    found = filter_audit.steps(counts)
    assert found.count() == 700 * 600 and found.where("kept + removed + redundant < 0 OR unique_fails > removed + redundant").count() == 0


# 12


def plain_middle(key, text, rate=100, spm=50):
    units = LINE.findall(text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_of_odd_rows(spark, docs):
    more = [(600 + i, t) for i, t in enumerate(["\n", "\n\n", "a\nb", "a\nb\n", "x<P>y\n", "<S", "ends with <\nP>\n", "é\n" * 3000, "<\n<\n>P>\n" * 9, "\r\n a\r\n"])]
    extra = spark.createDataFrame([(*r, None, None) for r in more], "doc_id long, text string, output string, form string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    for form in (infilling.Form(), infilling.Form(rate=40, spm=100), infilling.Form(rate=0), infilling.Form(spm=0)):
        found = infilling.restored(infilling.fill_in_middle(rows, form), form).collect()
        got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found)
        assert got == Counter((i, *plain_middle(i, t or "", form.rate, form.spm), t or "") for i, t in edge.rows() + more)
    assert infilling.fill_in_middle(rows.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="a\n<>PSMé", max_size=30), max_size=12), st.integers(0, 10**6))
def test_infilling_of_any_text(texts, first):
    h = [pa.array([int(hashlib.sha256(f"7:{first + i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i in range(len(texts))], pa.int64()) for k in range(4)]
    made = infilling.transform(pa.array(texts, pa.large_string()), h, infilling.Form())
    assert list(zip(*(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")))) == [plain_middle(first + i, t) for i, t in enumerate(texts)]
    assert infilling.restore(made["output"], made["form"], infilling.Form()).to_pylist() == texts


def test_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(infilling, "PART_BYTES", 10)
    texts = ["a" * n for n in (3, 3, 30, 0, 9, 2, 8)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(infilling._parts(batch, 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts and [p.num_rows for p in parts] == [2, 1, 2, 3]


@pytest.mark.parametrize("tags", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("<P>", "a<P>", "<M>")])
def test_sentinels_that_overlap(tags):
    with pytest.raises(ValueError):
        infilling.Form(prefix=tags[0], suffix=tags[1], middle=tags[2])


# 13


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items, window=10):
    held = defaultdict(set)
    for name, text in items:
        w = plain_words(text)
        for s in range(max(len(w) - window, 0) + 1):
            if w:
                held[tuple(w[s : s + window])].add(str("" if name is None else name))
    out = []
    for i, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in {len(x) for x in held}:
            for s in range(len(w) - n + 1):
                if own := held.get(tuple(w[s : s + n])):
                    names |= own
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def contaminated(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())


ITEMS = [("q1", edge.PASSAGE), ("q2", "Shared3 shared4, shared5 shared6 SHARED7-shared8 shared9 shared10 shared11 shared12"), ("q3", None), ("q4", " ... "), (None, edge.PASSAGE[:200]), ("q1", "Brand new words that occur in no document of this table at all")]


@pytest.mark.parametrize("short", [[], ["One two three", "a a"], ["tabs", "eight of these words stand in one document", "shared1 shared2 shared3 shared4"], ["a a a a a a a a a a a a"]])
def test_contamination_of_odd_rows(spark, docs, short):
    items = ITEMS + [(f"s{k}", t) for k, t in enumerate(short)]
    long = [(700 + k, edge.PASSAGE[k * 7 :] + " and some " + edge.PASSAGE[: 300 - k]) for k in range(9)] + [(700, edge.PASSAGE)] * 3 + [(710, "Eight of these, words; STAND in one document!")]
    extra = spark.createDataFrame([(*r, None, None) for r in long], "doc_id long, text string, key string, shard string")
    table = spark.createDataFrame([(*r, 0, None) for r in items], "item_id string, text string, n int, wid string")
    found = decontamination.contamination(docs.unionByName(extra, allowMissingColumns=True), table)
    assert contaminated(found) == plain_contamination(edge.rows() + long, items)


def test_contamination_of_empty_tables(spark, docs):
    table = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contaminated(decontamination.contamination(docs, table.limit(0))) == plain_contamination(edge.rows(), [])
    assert contaminated(decontamination.contamination(docs, table.where("item_id IN ('q3', 'q4')"))) == plain_contamination(edge.rows(), [])
    assert decontamination.contamination(docs.limit(0), table).count() == 0


def test_contamination_by_a_full_bitmap(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 6)  # most hashes pass, and runs are long
    rng = random.Random(1)
    items = ITEMS + [(f"r{k}", " ".join(rng.choice("abc") for _ in range(rng.randint(4, 14)))) for k in range(60)]
    rows = [(800 + k, " ".join(rng.choice("abc") for _ in range(400))) for k in range(6)] + edge.rows()
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=7)
    assert contaminated(found) == plain_contamination(rows, items, 7)
