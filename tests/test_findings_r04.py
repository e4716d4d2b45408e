"""What the fourth round's findings asked for."""

import numpy as np
import pandas as pd

from tessera.llm import jaccard_join as J
from tessera.operators import regimes as RG


def test_unlike_sets_of_a_full_sketch_are_no_group(spark, monkeypatch):
    """Where every shingle seems as rare as any other, a chain of texts that overlap by half is not dealt with as one group."""
    words = [f"w{i}" for i in range(4100)]
    texts = [" ".join(words[10 * i : 10 * i + 40]) for i in range(400)]
    texts += [texts[7] + " more", "first " + texts[7], texts[200][:-6], texts[300], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(J, "rare_first", lambda docs, total, width: J.RareFirst(np.zeros(1 << 16, np.uint8), 16))
    sent, join = [], J.with_texts
    monkeypatch.setattr(J, "with_texts", lambda named, chosen: sent.append(chosen.count()) or join(named, chosen))
    for paired in (64, 2):
        monkeypatch.setattr(J, "PAIRED", paired)
        got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, 80, 5).collect()}
        assert got == {i: {400: 7, 401: 7, 402: 200, 403: 300}.get(i, i) for i in range(len(texts))}
    assert sent[0] < 100


def test_pairs_that_hold_shingles_in_common_are_all_met(spark, monkeypatch):
    """Small lots of rows and pairs, long lists and folded ones give the components of brute force."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 60, rng.integers(3, 60)).tolist() for _ in range(25)]
    sets = [x[: len(x) - int(rng.integers(0, 4))] + rng.integers(0, 60, rng.integers(0, 3)).tolist() for x in base for _ in range(5)]
    texts = [" ".join(f"v{w}" for w in x) for x in sets]
    shingles = [{tuple(x[i : i + 2]) for i in range(len(x) - 1)} or {tuple(x)} for x in sets]
    want = list(range(len(sets)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if 100 * len(a & b) >= 70 * len(a | b) and a:
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for fold, paired, pairs in ((400_000, 64, 8_000_000), (50, 3, 30), (400_000, 1, 1)):
        for name, value in (("FOLD", fold), ("PAIRED", paired), ("PAIRS", pairs)):
            monkeypatch.setattr(J, name, value)
        got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, 70, 2).collect()}
        assert [got[i] for i in range(len(sets))] == want


def test_parities_differ_in_no_more_places_than_sets_do():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[: 2 * n], n)) for n in (1, 2, 60, 64, 65, 130, 500, 2500) for _ in range(4)] + [np.zeros(0, np.uint64)]
    left, right = zip(*[(a, b) for a in sets for b in sets], strict=True)
    found = J.apart([J.parity(a) for a in left], [J.parity(b) for b in right])
    truth = np.array([len(np.setxor1d(a, b)) for a, b in zip(left, right, strict=True)])
    assert (found <= truth).all() and ((found - truth) % 2 == 0).all() and (found[truth > 1000] > 300).any()
    assert not len(J.apart([], []))


def test_fits_of_stability_go_on_until_they_converge(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0.02, 1 + 2 * (i % 2), 60) for i in range(6)])
    whole, cut = RG.fit_hmm(v, 3), RG.fit_hmm(v, 3, 10)
    assert whole["ll"] > cut["ll"] + 1e-3 and RG.fit_hmm(v, 3, 1_000_000)["ll"] == whole["ll"]
    assert abs(RG.fit_hmm(v, 3, None, 1e-9)["ll"] - whole["ll"]) < 1e-3
    mu, sd, trans, start = whole["mu"], whole["sd"], whole["trans"], whole["start"]  # a textbook likelihood of the fit
    like = [np.exp(-0.5 * ((y - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi)) for y in v]
    p, ll = start * like[0], 0.0
    for b in like[1:]:
        ll += np.log(p.sum())
        p = (p / p.sum()) @ trans * b
    assert abs(ll + np.log(p.sum()) - whole["ll"]) < 1e-6
    log, fit = tmp_path / "fits", RG.fit_hmm

    def kept(x, k, rounds=None):
        m = fit(x, k, rounds)
        with open(log, "a") as f:
            f.write(f"{m['ll'] - fit(x, k)['ll']}\n")
        return m

    monkeypatch.setattr(RG, "fit_hmm", kept)
    assert RG.hmm_stability(spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": np.arange(len(v)), "x": v})), resamples=2).count() == 1
    assert [float(x) for x in log.read_text().split()] == [0.0] * 3


def test_a_fit_over_what_is_no_number_ends():
    with np.errstate(all="ignore"):
        assert np.isnan(RG.fit_hmm(np.array([0.1, np.nan, 0.3]), 2)["ll"])
