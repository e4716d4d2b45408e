"""What the third round's findings asked for: steps that failed or grew too long at size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe as BPE
from tessera.llm import jaccard_join as J
from tessera.operators import montecarlo as MC
from tessera.operators import regimes as RG
from tessera.plans import queries
from tessera.sources import panel as P

SF = "/root/testdata/sf0.001"


def test_candidates_reach_their_texts_by_lots_or_by_one_stored_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i // 2, 1 + i % 3) for i in range(0, 60, 2)], "doc_id long, grp long, slices int")
    want = sorted((i, i // 2, 1 + i % 3, f"text {i}") for i in range(0, 60, 2))
    stored, write = [], J.write_shared
    monkeypatch.setattr(J, "write_shared", lambda df, name: stored.append(name) or write(df, name))
    for rows, lots in ((100, 8), (7, 8), (7, 2)):
        monkeypatch.setattr(J, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(J, "LOTS", lots)
        found = J.with_texts(docs, chosen)
        assert sorted((r.doc_id, r.grp, r.slices, r.text) for r in found.collect()) == want
        assert stored == (["candidate-texts"] if (rows, lots) == (7, 2) else [])
    assert J.with_texts(docs, chosen.where("false")).count() == 0


def test_places_of_the_sketch_survive_their_gaps():
    for places in ([], [0], [0, 0, 255, 255, 256, 766, 65535], [65535], [254], [510]):
        assert J.from_gaps(J.gaps(np.array(places, np.int64))).tolist() == places
    some = np.sort(np.random.default_rng(1).integers(0, 1 << 16, 5000))
    assert J.from_gaps(J.gaps(some)).tolist() == some.tolist() and len(J.gaps(some)) < 5300


def test_packing_merges_words_by_the_library(monkeypatch):
    words = [w.encode() for w in ("tessera", "naïve", "straße", "x", "日本語", "a" * 300)]
    want = [BPE.bpe(BPE.default_tokenizer()).merge(w) for w in words]
    monkeypatch.setattr(BPE.Bpe, "merge", lambda self, word: pytest.fail("merged in Python"))
    enc = BPE.Encoder(BPE.default_tokenizer(), None)
    assert [np.frombuffer(enc[w], "<u4").tolist() for w in words] == want


@pytest.mark.parametrize(("n", "k"), [(1, 2), (2, 3), (10, 3), (333, 4)])
def test_blocks_of_a_series_recur_as_the_whole(n, k):
    rng = np.random.default_rng(n)
    trans, start, b = rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k)), rng.random((n, k)) ** 40
    alpha, beta, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        alpha[t] = (alpha[t - 1] @ trans if t else start) * b[t]
        c[t] = alpha[t].sum() + 1e-300
        alpha[t] /= c[t]
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1]) / c[t + 1]
    for got, want in zip(RG.forward_backward(start, trans, b), (alpha, beta, c), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_a_path_of_stability_is_fitted_once(spark, tmp_path, monkeypatch):
    x = pd.DataFrame({"symbol": "A", "i": np.arange(60), "x": np.random.default_rng(2).normal(size=60)})
    log, fit = tmp_path / "fits", RG.fit_hmm

    def counted(v, k, rounds=80):
        with open(log, "a") as f:
            f.write("fit\n")
        return fit(v, k, rounds)

    monkeypatch.setattr(RG, "fit_hmm", counted)
    made = RG.hmm_stability(spark.createDataFrame(x), resamples=3).collect()
    assert len(made) == 1 and made[0].least_share > 0
    assert log.read_text().count("fit") == 1 + 3


def test_run_lengths_follow_the_textbook_step():
    import math

    runs, hazard = RG.RunLengths(1 / 50, 20, 1.0, 1e-9), 1 / 50
    held = [(0, 1.0, 0.0, 1.0)]  # run length, mass, mu, beta
    for x in np.random.default_rng(3).exponential(5, 200):
        like = []
        for r, _, mu, beta in held:
            kappa, alpha = r + 1.0, 1 + r / 2
            nu, var = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            like.append(math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi * var) * (1 + (x - mu) ** 2 / (nu * var)) ** (-(nu + 1) / 2))
        grown = [(r + 1, p * f * (1 - hazard), ((r + 1) * mu + x) / (r + 2), beta + (r + 1) * (x - mu) ** 2 / (2 * (r + 2))) for (r, p, mu, beta), f in zip(held, like, strict=True)]
        held = [(0, hazard * sum(p * f for (_, p, _, _), f in zip(held, like, strict=True)), 0.0, 1.0), *grown]
        total = sum(h[1] for h in held)
        held = [(r, p / total, mu, beta) for r, p, mu, beta in held if r == 0 or (r < 20 and p / total >= 1e-9)]
        total = sum(h[1] for h in held)
        held = [(r, p / total, mu, beta) for r, p, mu, beta in held]
        p, r = runs.steps(np.array([x]))
        assert p[0] == pytest.approx(held[0][1], rel=1e-9) and r[0] == max(held, key=lambda h: h[1])[0]
    assert [b[0] for b in runs.beliefs()] == [h[0] for h in held]


def test_bars_need_no_sort_of_the_lines_and_keep_the_first_and_last_line(spark, tmp_path):
    lines = P.read(spark, SF, "lineitem")
    missing = lines.where("l_orderkey < 40").selectExpr("null l_orderkey", *(c for c in lines.columns if c != "l_orderkey"))
    again = lines.where("l_orderkey < 60").withColumn("l_extendedprice", lines.l_extendedprice * 1.5)
    dateless = lines.where("l_orderkey < 20").withColumn("l_shipdate", F.lit(None).cast("timestamp"))
    lines.unionByName(missing.select(*lines.columns)).unionByName(again).unionByName(dateless).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("supplier", "nation", "region"):
        P.read(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
        P.read(spark, str(tmp_path), name).createOrReplaceTempView(f"bars_{name}")
    P.read(spark, str(tmp_path), "lineitem").createOrReplaceTempView("bars_lineitem")
    key = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
    px = "l_extendedprice / l_quantity"
    want = spark.sql(f"""select n_name symbol, r_name sector, to_date(l_shipdate) date, min_by({px}, {key}) open, max({px}) high, min({px}) low, max_by({px}, {key}) close
        from bars_lineitem join bars_supplier on l_suppkey = s_suppkey join bars_nation on s_nationkey = n_nationkey join bars_region on n_regionkey = r_regionkey group by all""")
    got = P.bars(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortAggregate" in x and "sum(l_quantity" in x]
    rows = lambda df: sorted(map(str, df.select("symbol", "sector", "date", "open", "high", "low", "close").collect()))
    assert rows(got) == rows(want)


def test_scores_and_fingerprints_are_computed_once(spark, monkeypatch):
    seen: list[str] = []
    for module in (RG, queries):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: seen.append(name) or write(df, name))
    x = pd.DataFrame({"symbol": "A", "date": pd.date_range("2020-01-01", periods=80).date, "x": np.random.default_rng(4).normal(size=80)})
    RG.silhouette(RG.rolling_regimes(spark.createDataFrame(x)), RG.FINGERPRINT).collect()
    assert seen == ["fingerprints", "silhouette"]
    monkeypatch.setattr(MC, "rolling_backtest", lambda x: spark.createDataFrame([("A", 1, 5, 0.5, 0, 0.1, 0.0)] * 3, "symbol string, origin int, horizon int, pit double, breach int, crps double, bias double"))
    queries.rolling_backtest(spark, SF).collect()
    assert seen[2:] == ["returns", "backtest"]
