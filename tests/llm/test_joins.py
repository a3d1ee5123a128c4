"""Operators 2, 7 and 9, components and the pipeline against plain code."""

import hashlib
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from dwellspark.llm import jaccard, pii, quality, substrings, vectors
from dwellspark.llm.common import shared_dir
from dwellspark.llm.components import components, roots

from . import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def least(links, vertices):
    """Least vertex reached by each."""
    label = {v: v for v in vertices}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def order(doc):
    return -(1 << 63) if doc is None else doc


# 2


def kept_words(rows, window=20):
    """Of rows whose ids differ: the words of each that stay."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: order(r[0])):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        out[doc] = (words, gone)
    return out


@pytest.mark.parametrize("crowded,gathered", [(substrings.CROWDED, (substrings.GATHERED_WORDS, substrings.GATHERED_SUFFIXES)), (2, (500, 20))])
def test_substrings(spark, crowded, gathered):
    rows = [r for i, r in enumerate(edge.rows()) if r not in edge.rows()[:i] and (r[0] is not None or r[1]) and (r[0], r[1]) != (1, edge.rows()[-3][1])]
    rows = list({r[0]: r for r in rows}.values())  # one row for each id
    df = spark.createDataFrame([(*r, *[None] * 12) for r in rows], edge.SCHEMA).repartition(4)
    found = {r.doc_id: r for r in substrings.remove_repeats(df, digests=True, crowded=crowded, gathered=gathered).collect()}
    want = kept_words(rows)
    assert set(found) == set(want) and sum(r.n_removed for r in found.values()) > 500
    for doc, (words, gone) in want.items():
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (found[doc].n_words, found[doc].n_removed) == (len(words), sum(gone)), doc
        assert found[doc].kept == hashlib.sha256(kept.encode()).hexdigest()


def test_tree_of_suffixes():
    """Nodes and repeats of suffixes over few words, which have many prefixes in common, against each pair of windows."""
    rng = np.random.default_rng(5)
    n, width = 300, substrings.LEFT + substrings.WINDOW
    context = rng.integers(0, 2, (12, width)).astype(np.uint64)[rng.integers(0, 12, n)]
    context[np.arange(n), rng.integers(0, width, n)] = 2
    order, common = substrings.tree(context)
    ranked = [tuple(r) for r in context[order].tolist()]
    assert ranked == sorted(ranked)
    assert common.tolist() == [0] + [next((i for i in range(width) if a[i] != b[i]), width) for a, b in zip(ranked, ranked[1:])]
    for depth in (1, 8, width):
        found = substrings.nodes(order, common, depth)
        assert len(set(found)) == len({r[:depth] for r in ranked}) == len(set(zip(found, map(tuple, context[:, :depth].tolist()))))
    doc, at = rng.integers(0, 40, n), rng.integers(0, 10**6, n).astype("<i4")
    mask = rng.integers(1, 1 << substrings.LEFT + 1, n).astype(np.uint16)
    got = substrings.repeats(doc, np.zeros(n, "<i4"), at, mask, context)
    seen, want = set(), np.zeros(n, np.uint16)
    for i in np.lexsort((at, doc)):
        for d in range(substrings.LEFT + 1):
            if mask[i] >> d & 1:
                window = (d, *context[i, substrings.LEFT - d : substrings.LEFT - d + substrings.WINDOW].tolist())
                want[i] |= np.uint16((window in seen) << d)
                seen.add(window)
    assert want.any() and (got == want).all()


def test_substrings_of_odd_rows(spark):
    docs = edge.documents(spark)
    found = substrings.remove_repeats(docs, carry=["key", "slot"]).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in edge.rows()) and found[0].carried.asDict() == {"key": None, "slot": None}
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert by[201][0].kept == by[202][0].kept == "" and by[201][0].n_removed == 300
    assert {r.kept for r in by[None]} >= {None} and by[402][0].kept == "   \n"
    first = edge.rows()[0][1]  # one row repeated is one document
    assert [r.kept for r in by[0]] == [first, first]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


# 9


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def family(seed, n):
    """A swarm of copies of one text, each with some words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"n{rng.randint(0, 99)}"
        out.append((1000 * seed + i, " ".join(words)))
    return out


@pytest.mark.parametrize("k,percent,largest", [(4, 85, 4000), (4, 85, 6), (5, 80, 3)])
def test_jaccard(spark, k, percent, largest):
    rows = edge.rows() + family(5, 40) + family(6, 25)
    df = spark.createDataFrame([(*r, *[None] * 12) for r in rows], edge.SCHEMA).repartition(4)
    rounds = []
    found = jaccard.join(df, size=k, percent=percent, largest=largest, gathered=2000, log=rounds).collect()
    assert rounds[0][0] > 60 and (largest > 6) == (len(rounds) == 2)
    sets = [(order(d), shingle_set(t, k)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    label = least(links, {a for a, _ in sets})
    back = lambda v: None if v == order(None) else v
    want = Counter((back(d), len(s), back(label[d])) for d, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    assert len({r.component_id for r in found}) < len(found) - 30


def test_jaccard_of_nothing(spark):
    empty = edge.documents(spark).limit(0)
    assert jaccard.join(empty).count() == 0
    one = spark.createDataFrame([(1, ""), (2, None), (3, "alone")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(one).collect())) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_regions_of_given_tables(spark):
    """Each family of near copies is cut by pivots; small regions give the same as large ones."""
    docs, rounds = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), []
    found = sorted(map(tuple, jaccard.join(docs, log=rounds).collect()))
    assert rounds[0][1] > 100
    assert found == sorted(map(tuple, jaccard.join(docs, largest=3).collect()))


def test_swarm_takes_few_rows(spark):
    """Thousands of near copies of one text: stars take most of them, what is left costs a few times its rows."""
    rows = family(7, 6000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rounds = []
    found = {r.doc_id: r.component_id for r in jaccard.join(df, largest=500, log=rounds).collect()}
    assert all(sets <= 3 * len(rows) for sets, _ in rounds)
    name, members = zip(*((d, jaccard.shingles(t)) for d, t in rows))
    a, b = jaccard.Region(np.array(name), np.array(list(map(len, members))), list(members)).links(np.arange(len(rows)))
    assert found == {int(d): c for d, c in least(zip(a.tolist(), b.tolist()), name).items()}


def test_region_is_exact():
    """Each split of a family between components, whatever pivots come first."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        members = []
        for _ in range(25):
            own = base[rng.random(60) > rng.uniform(0, 0.15)]
            members.append(np.unique(np.r_[own, rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)]))
        n = np.array([len(m) for m in members])
        a, b = jaccard.Region(np.arange(25), n, members).links(np.arange(25))
        links = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(members[i], members[j])) >= 85 * len(np.union1d(members[i], members[j]))]
        assert least(zip(a.tolist(), b.tolist()), range(25)) == least(links, range(25))


# components


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7)] + [(2000, 2001 + i) for i in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    want = least(links, {v for x in links for v in x})
    linked = {v for a, b in links if a != b for v in (a, b)}
    assert {r.vertex: r.component for r in components(df).collect()} == {v: want[v] for v in linked}
    vertex, root = roots(*map(np.array, zip(*links)))
    assert dict(zip(vertex.tolist(), root.tolist())) == want
    assert components(df.limit(0)).count() == 0


# 7


def swarm(n, seed, spread):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(24)
    return centre / np.linalg.norm(centre) + spread * rng.standard_normal((n, 24)) / np.sqrt(24)


@pytest.mark.parametrize("largest", [2000, 9])
def test_vectors(spark, largest):
    rng = np.random.default_rng(4)
    x = np.r_[rng.standard_normal((60, 24)), swarm(40, 1, 0.1), swarm(30, 2, 0.2), np.repeat(swarm(1, 3, 0), 6, 0), 1e200 * swarm(2, 3, 0), 1e-200 * swarm(1, 3, 0)]
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    rows += [(900, None, None), (901, [], None), (902, [0.0] * 24, None), (903, [1.0, None] * 12, None), (904, [float("nan")] * 24, None), (905, [float("inf")] * 24, None), (906, [1.0] * 5, None), (907, [1.0] * 5, None), (None, [3.0] * 24, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place int")
    found = {r.vec_id: r for r in vectors.near_duplicates(df, largest=largest).collect()}
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(found[i].n_links for i in range(len(x))) >= 0.97 * near.sum()
    assert all(found[i].n_links <= near[i].sum() for i in range(len(x)))
    label = least(zip(*np.nonzero(near)), range(len(x)))
    assert np.mean([found[i].component_id == label[i] for i in range(len(x))]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values() if r.vec_id is not None)
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in range(900, 906)) and found[907].component_id == 906
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_at_the_threshold(spark):
    """Pairs just above 0.95, the hardest to meet: at least nine in ten do."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((600, 64))
    off -= (off * a).sum(1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.952, (600, 1))
    x = np.r_[a, c * a + np.sqrt(1 - c * c) * off]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert vectors.near_duplicates(df).where("n_links > 0").count() >= 0.9 * len(x)


@pytest.mark.parametrize("rows", [10**4, 10**7])
def test_vectors_meet_at_the_threshold_however_many(rows):
    """As many filters as that many rows have, without the rows."""
    size = int((rows // vectors.PER_FILTER) ** 0.5) + 1
    ranks = vectors._ranks(64, size, 0.95, 3000, 77)
    assert np.mean(ranks <= vectors.lists(64, size, 0.95, vectors.RECALL, vectors.DECODED)) >= 0.998
    x = np.random.default_rng(5).standard_normal((3, 64))
    left, right = vectors._halves(64, 30)
    scores = (x[:, :32] @ left.T)[:, :, None] + (x[:, 32:] @ right.T)[:, None, :]
    assert (vectors.decode(x, 30, 100) == np.argsort(-scores.reshape(3, -1), axis=1)[:, :100]).all()


def test_vectors_of_a_crowded_filter(spark):
    """No block holds all of its filter, and each home meets each other point once."""
    rows = [(7, i, 1, 7 if i % 4 else 8, None, None) for i in range(1000)] + [(8, i, 1, 7, None, None) for i in range(500)] + [(9, i, 1, 9, None, None) for i in range(50)]
    found = vectors.deal(spark.createDataFrame(rows, vectors._PLACED), 100).collect()
    blocks = {}
    for r in found:
        blocks.setdefault((r.place, r.block), []).append(r)
    assert max(map(len, blocks.values())) < 200 and {p for p, _ in blocks} == {7, 9}
    pairs = Counter((p, a.name, b.name) for (p, _), own in blocks.items() for a in own if a.here for b in own if b.seen)
    assert set(pairs.values()) == {1} and len(pairs) == 750 * 1000 + 50 * 50


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_sent_in_rounds(spark, monkeypatch, tmp_path, kind):
    """No round sends much more rows than there are vectors, what is written to the shared folder is not much larger
    than the table either, and nothing is lost between rounds."""
    monkeypatch.setattr(vectors, "PER_FILTER", 50)
    monkeypatch.setattr(vectors, "ROUND", 1000, raising=False)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2400, 64))
    x = np.r_[x, np.repeat(x[:60], 10, 0) + 0.1 * rng.standard_normal((600, 64))]
    x = x.astype(np.float32) if kind == "float" else x
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").write.parquet(f"{tmp_path}/in")
    sent, deal = [], vectors.deal

    def spied(*args):
        sent.append((dealt := deal(*args)).count())
        return dealt

    monkeypatch.setattr(vectors, "deal", spied)
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    found = {r.vec_id: r for r in vectors.near_duplicates(spark.read.parquet(f"{tmp_path}/in")).collect()}
    size = lambda *tables: sum(f.stat().st_size for t in tables for f in t.rglob("*.parquet"))
    assert max(sent) < 3 * len(x) and size(*(set(shared.iterdir()) - before)) < 4 * size(tmp_path / "in")
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = least(zip(*np.nonzero(near)), range(len(x)))
    assert near.sum() > 5000 and all(found[i].n_links <= near[i].sum() for i in range(len(x)))
    assert sum(found[i].n_links for i in range(len(x))) >= 0.999 * near.sum()
    assert np.mean([found[i].component_id == label[i] for i in range(len(x))]) > 0.999


def test_vectors_of_a_crowd_over_several_rounds(spark, monkeypatch):
    """Blocks of a crowded filter that are dealt to rounds of their own: each pair is counted once."""
    monkeypatch.setattr(vectors, "ROUND", 500, raising=False)
    x = swarm(300, 6, 0.25)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, largest=60).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [found[i] for i in range(len(x))] == ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()


# pipeline


def test_pipeline(spark):
    """Each stage against plain code on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.stored(stages["quality"](spark, docs, SF))
    model = quality.fit_on_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in good.collect()}
    assert good.schema == docs.schema and kept == {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) > 0.9

    apart = corpus_pipeline.stored(stages["near_duplicates"](spark, good, SF))
    sets = [(r.doc_id, shingle_set(r.text, 5)) for r in good.collect()]
    label = least([(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)], {a for a, _ in sets})
    assert {r.doc_id for r in apart.collect()} == {d for d in label if label[d] == d} and apart.schema == docs.schema

    fresh = corpus_pipeline.stored(stages["substrings"](spark, apart, SF))
    want = kept_words([(r.doc_id, r.text) for r in apart.collect()])
    assert {r.doc_id: WORD.findall(r.text) for r in fresh.collect()} == {d: [w for w, g in zip(*x) if not g] for d, x in want.items()}
    assert fresh.columns == docs.columns and fresh.where("n_chars <> length(text)").count() == 0

    private = corpus_pipeline.stored(stages["pii"](spark, fresh, SF))
    assert {(r.doc_id, r.text) for r in private.collect()} == {(r.doc_id, pii.replace(r.text, pii.EXAMPLE_KEY)[0]) for r in fresh.collect()}
    assert private.columns == docs.columns
    packed = stages["packing"](spark, private, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in private.collect()}


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables through every stage, each on all that the one before kept."""
    from pyspark.sql import functions as F

    odd = edge.documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), "bucket", "score", "key")
    docs = full = corpus_pipeline.stored(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.stored(stage(spark, docs, SF))
        assert new.schema == full.schema, name
        if name != "near_duplicates":  # rows of one id go together there
            assert name == "quality" or Counter(r.doc_id for r in new.collect()) == Counter(r.doc_id for r in docs.collect()), name
        assert stage(spark, full.limit(0), SF).count() == 0, name
        docs = new
    assert None in {r.doc_id for r in docs.collect()} and docs.count() > 20
    stage = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}
    assert stage(spark, full.limit(0), SF).count() == 0
