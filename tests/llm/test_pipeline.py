"""The pipeline: each stage's decisions against its operator and brute force."""

import numpy as np

import corpus_pipeline
from tessera.llm.common import write_shared

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = write_shared(stage(spark, docs, SF), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "n-gram Jaccard join":
            assert set(after) == near_copies(list(before.items()))
            assert all(after[i] == before[i] for i in after)
        if name == "suffix-array dedup":
            assert set(after) == set(before) and all(len(after[i]) <= len(before[i]) for i in after)
        ids.append(set(after))
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert packed == ids[-1]
    assert packed == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(ids[0]) > 0.6 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def near_copies(docs, width=5, percent=80):
    """The smallest id of each component of linked documents, by brute force over shingles of `width` words."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    of = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = {x: low if c == high else c for x, c in of.items()}
    return set(of.values())


def near_rows():
    """A text of 1,000 words and its copy with 150 more (5-word Jaccard 0.87), and copies of shorter texts with changes on both sides of 0.8."""
    rng = np.random.default_rng(5)
    text = [f"w{k}" for k in rng.integers(5000, size=1150)]
    rows = [(1, " ".join(text[:1000])), (2, " ".join(text))]
    base = [[f"v{k}" for k in rng.integers(400, size=rng.integers(3, 200))] for _ in range(20)]
    for i in range(160):
        w = list(base[i % 20])
        for _ in range(rng.integers(0, 7)):
            w[rng.integers(len(w))] = f"x{rng.integers(50)}"
        rows.append((3 + i, " ".join(w)))
    return rows


def test_near_copies(spark):
    docs = [(i, t, "en", "a", len(t)) for i, t in near_rows()]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, SCHEMA), SF)
    kept = {r.doc_id for r in out.collect()}
    assert kept == near_copies(near_rows())
    assert 1 in kept and 2 not in kept


def test_awkward_ids(spark):
    """Rows without an id, rows that repeat one, and a corpus without languages."""
    rng = np.random.default_rng(8)
    text = [" ".join("".join(chr(97 + c) for c in rng.integers(26, size=6)) for _ in range(60)) for _ in range(8)]
    rows = [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[2]), (5, text[2]), (6, text[2]), (7, text[3]), (8, text[4]), (9, "12 34 56 " * 4), (10, text[5])]
    for lang in ("en", None):
        docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t in rows], SCHEMA)
        held = {name: [tuple(r) for r in stage(spark, docs, SF).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
        named = sorted((i or 0, t) for i, t in rows)
        seen = {name: sorted((r[0] or 0, r[1]) for r in out) for name, out in held.items()}
        assert seen["quality rules"] == [x for x in named if x[0] != 9]
        assert seen["language ID"] == [x for x in named if x[0] != 9]
        once = [(0, text[0]), (0, text[1]), (5, text[2]), (7, text[3]), (8, text[4]), (9, rows[8][1]), (10, text[5])]
        assert seen["n-gram Jaccard join"] == sorted(once)
        cut = sorted(held["suffix-array dedup"], key=lambda r: r[0] or 0)
        assert [r[0] or 0 for r in cut] == [i for i, _ in named]
        assert all(r[2:4] == (lang, "a") and r[4] == len(r[1]) for r in cut)
