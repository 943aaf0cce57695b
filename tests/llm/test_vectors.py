"""Nearest neighbours and whitening against brute force, on whole tables and on awkward rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.llm import nearest, queries, whitening

SF = "/root/testdata/sf0.001"
FLOATS = "vec_id long, embedding array<float>, key string, ids long"


def table_of(path):
    pdf = pd.read_parquet(f"{path}/embeddings.parquet")
    return pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), float)


def brute(ids, x, asked, k=10):
    out = {}
    for i in np.flatnonzero(asked):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[ids == ids[i]] = np.inf
        order = np.lexsort((ids, far))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order if np.isfinite(far[j])]
    return out


def answers(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_over_the_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    ids, x = table_of(path)
    want, got = brute(ids, x, ids % 100 == 0), answers(queries.op11_nearest(spark, path).collect())
    assert set(got) == set(want)
    met = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(met) >= 0.9
    place = {int(v): k for k, v in enumerate(ids)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda r: (r[1], r[0])) and len(found) == len(want[q])
        for v, score in found:
            assert score == pytest.approx(np.sqrt(((x[place[v]] - x[place[q]]) ** 2).sum()), rel=1e-12)


def test_neighbours_among_copies_are_exact(spark):
    """A third of the rows are one vector, another third near copies of it; copies are told by the smaller id."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    x = np.vstack([np.tile(base, (40, 1)), base + 0.01 * rng.normal(size=(40, 8)), rng.normal(size=(40, 8))]).astype(np.float32)
    ids = rng.permutation(120)
    rows = [(int(i), v.tolist(), "k", 1) for i, v in zip(ids, x, strict=True)]
    got = answers(nearest.nearest(spark.createDataFrame(rows + rows[:5], FLOATS), F.col("vec_id") % 10 == 0, 5, reach=1.0).collect())
    want = brute(ids, x.astype(float), ids % 10 == 0, 5)
    assert set(got) == set(want)
    for q in want:
        if np.flatnonzero(ids == q)[0] < 40:  # a copy: the other copies with the smallest ids
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and all(s == 0 for _, s in got[q])
    met = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]
    assert np.mean(met) >= 0.9


def test_large_buckets_are_cut_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "MOST_HELD", 50)
    rng = np.random.default_rng(4)
    x = (1 + 0.001 * rng.normal(size=(300, 6))).astype(np.float32)
    rows = [(i, v.tolist(), None, None) for i, v in enumerate(x)]
    got = answers(nearest.nearest(spark.createDataFrame(rows, FLOATS), F.col("vec_id") % 50 == 0, 4, reach=1.0).collect())
    want = brute(np.arange(300), x.astype(float), np.arange(300) % 50 == 0, 4)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 4 for q in want]) >= 0.9


AWKWARD = [(0, [1.0, 0.0], "a", 1), (100, [1.0, 0.1], "a", 1), (1, None, "a", 1), (2, [0.0, 0.0], "a", 1), (3, [1.0, None], "a", 1), (4, [float("nan"), 1.0], "a", 1), (5, [float("inf"), 1.0], "a", 1), (6, [1.0, 2.0, 3.0], "a", 1), (7, [], "a", 1), (None, [0.5, 0.5], "a", 1), (8, [1.0, 0.0], "b", 2), (8, [1.0, 0.0], "b", 2), (9, [-0.0, 1.0], None, None)]


def test_awkward_vectors_and_empty_tables(spark):
    df = spark.createDataFrame(AWKWARD, FLOATS)
    got = answers(nearest.nearest(df, F.col("vec_id") % 100 == 0, reach=1.0).collect())
    assert {q: [v for v, _ in r] for q, r in got.items()} == {0: [8, 100, 9], 100: [0, 8, 9]}
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.nearest(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.nearest(df.where("vec_id = 9"), F.col("vec_id") % 100 == 0).count() == 0


def test_success_model_visits_what_it_should():
    """Every bucket above the cutoff and the query's own are visited, no others, each with its success."""
    rng = np.random.default_rng(5)
    cells = nearest.Cells(rng.normal(size=(500, 6)), 2000)
    cells.slope, cells.noise, cells.cutoff = 0.5, 0.8, np.log(0.01)
    places = cells.places(rng.normal(size=(3, 6)))
    for t in range(nearest.TABLES):
        columns = [t * cells.k + i for i in range(cells.k)]
        chances = [cells.log_success(places[:, c], c) for c in columns]
        grids = np.stack(np.meshgrid(*(np.arange(p.shape[1]) for _, p in chances), indexing="ij"), -1).reshape(-1, cells.k)
        query, bucket, success = cells.visits(places, t)
        for q in range(3):
            total = sum(p[q][grids[:, i]] for i, (_, p) in enumerate(chances))
            want = {int(b): s for b, s in zip(cells.bucket(grids + [f for f, _ in chances], t), total, strict=True) if s >= cells.cutoff}
            want[int(cells.bucket(cells.cells(places[q : q + 1])[:, columns], t)[0])] = 0.0
            got = dict(zip(bucket[query == q].tolist(), success[query == q].tolist(), strict=True))
            assert set(got) == set(want) and all(abs(got[b] - want[b]) < 1e-9 for b in want)


def plain_whitening(x, components=4):
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    lift = vectors[:, :components] / np.sqrt(values[:components])
    return fit, values, (x - fit.mean(0)) @ lift


def test_whitening_over_the_whole_table(spark):
    ids, x = table_of(SF)
    x = np.floor(256 * x).astype(int)
    fit, values, want = plain_whitening(x)
    out = queries.op13_whitening(spark, SF).toPandas().set_index(["component", "vec_id"]).sort_index()
    assert len(out) == 4 * len(ids)
    for k in range(4):
        got = out.loc[k + 1].reindex(ids)
        gap = np.minimum(np.abs(got["whitened"] - want[:, k]).max(), np.abs(got["whitened"] + want[:, k]).max())
        assert gap < 1e-10 and (got["n"] == len(fit)).all()
        assert (got["deviation"].to_numpy() == ((len(fit) * x - fit.sum(0)) ** 2).sum(1)).all()
        assert np.allclose(got["explained"], values[k] / values.sum(), rtol=1e-10) and (got["identity_error"] < 1e-10).all()


def test_states_merge_as_one_stream():
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**40), 2**40, (1000, 5))
    whole, parts = whitening.State.empty(5), whitening.State.empty(5)
    for row in x:  # one rank-one update at a time
        whole.add(row[None])
    for cut in np.array_split(x, 7):
        one = whitening.State.empty(5)
        one.add(cut)
        parts.merge(one)
    exact = np.cov(x.T.astype(float), bias=True)
    for s in (whole, parts):
        assert s.n == 1000 and s.sums == [sum(c) for c in x.T.tolist()]
        assert np.allclose(s.covariance(), exact, rtol=1e-12, atol=1e-12 * np.abs(exact).max())


def test_many_states_are_merged_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    ids, x = table_of(SF)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(9)
    got = whitening.whiten(df).where("component = 1").toPandas().set_index("vec_id")["whitened"].reindex(ids)
    want = plain_whitening(np.floor(256 * x).astype(int))[2][:, 0]
    assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-10


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a @ a.T, np.diag(rng.normal(size=n)), np.ones((n, n)), np.zeros((n, n)), a + a.T):
        values, vectors = whitening.symmetric_qr(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-10 * max(1, np.abs(m).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(m @ vectors, vectors * values, atol=1e-9 * max(1, np.abs(m).max()))


def test_whitening_of_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, FLOATS)
    out = whitening.whiten(df).collect()
    x = np.array([[256, 0], [256, 25], [0, 0], [128, 128], [256, 0], [256, 0], [0, 256]])
    fit, values, want = plain_whitening(x, 2)
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in out) == sorted((i is None, i, c) for i in (0, 100, 2, None, 8, 8, 9) for c in (1, 2))
    assert {r["n"] for r in out} == {len(fit)} and {r["deviation"] for r in out} == set(((len(fit) * x - fit.sum(0)) ** 2).sum(1).tolist())
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id in (0, 8)")).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        whitening.whiten(spark.createDataFrame([(0, [1e30, 1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_packed_rows_and_exact_deviations():
    x = np.array([[1, -2], [40_000, 5], [2**40, -(2**40)], [-(2**15), 0], [-(2**15) - 1, 0]])
    assert [len(b) for b in whitening.packed(x).to_pylist()] == [4, 8, 16, 4, 8]
    assert (whitening.unpacked(whitening.packed(x), 2) == x).all()
    with pytest.raises(OverflowError):
        whitening.deviations(x, 1000, [0, 0])
    assert whitening.deviations(x[:2] * 10**4, 3, [7, 9]) == [sum((3 * a - s) ** 2 for a, s in zip(r, (7, 9), strict=True)) for r in (x[:2] * 10**4).tolist()]
