"""Exact forests against plain trees, out-of-bag averages and permutation importance by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow import operators as op
from gaugeflow.operators import forest as module
from gaugeflow.session import cut_lineage

NAMES = ["x", "step", "noise", "tied", "flat", "more"]
SCHEMA = "site_no string, water_year int, q5_norm double, " + ", ".join(f"{n} double" for n in NAMES)


def rows_of(n, seed=2):
    rng = np.random.default_rng(seed)
    u = rng.uniform(size=(n, 6))
    u[:, 3], u[:, 4] = np.round(u[:, 3] * 3), 7.0
    y = 10 * u[:, 0] + 5 * (u[:, 1] > 0.5) + u[:, 3] + 0.5 * rng.normal(size=n)
    return [(f"s{i % 20:02d}", 1990 + i // 20, float(y[i]), *map(float, u[i])) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return cut_lineage(spark.createDataFrame(rows_of(500), SCHEMA))


@pytest.fixture(scope="module")
def forest(frame):
    return op.exact_forest(frame, trees=30)


def weights(forest, trees, seed=123):
    """(row number, tree) -> draws, and the numbered rows."""
    rows = forest.rows.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).select("row", "tree", "x", "y", module.draws("row", "tree", seed).alias("w"))
    return rows.collect()


def plain_tree(x, y, w, tree, min_node=5, seed=123, code=1, path=""):
    """Nested (driver, cut, below, above) or a leaf mean, searched gap by gap."""
    n, mean = w.sum(), (w * y).sum() / w.sum()
    h = [(int(module.mixed(tree, code, j, seed)), j) for j in range(x.shape[1])]
    best = None
    if n > min_node:
        for _, j in sorted(h)[: max(1, x.shape[1] // 3)]:
            values = sorted(set(x[:, j]))
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                below = x[:, j] <= cut
                sse = sum((w[s] * (y[s] - (w[s] * y[s]).sum() / w[s].sum()) ** 2).sum() for s in (below, ~below))
                gain = np.float32((w * (y - mean) ** 2).sum() - sse)
                if best is None or (gain, -j, -cut) > best[:3]:
                    best = (gain, -j, -cut, below)
    if best is None or best[0] < 1e-9:
        return mean
    j, cut, below = -best[1], -best[2], best[3]
    sides = [plain_tree(x[s], y[s], w[s], tree, min_node, seed, module.child(code, k), path + str(k)) for k, s in enumerate((below, ~below))]
    return (j, cut, *sides)


def flat(tree, path=""):
    if isinstance(tree, tuple):
        return {path: (NAMES[tree[0]], tree[1]), **flat(tree[2], path + "0"), **flat(tree[3], path + "1")}
    return {path: tree}


def ask(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_plain_trees(forest):
    drawn = weights(forest, 3)
    nodes = forest.nodes().where("tree <= 3").collect()
    for tree in (1, 2, 3):
        own = [r for r in drawn if r.tree == tree and r.w > 0]
        x, y, w = np.array([r.x for r in own]), np.array([r.y for r in own]), np.array([r.w for r in own])
        want = flat(plain_tree(x, y, w, tree))
        found = {r.path: (r.feature, r.cut) if r.feature else r.prediction for r in nodes if r.tree == tree}
        assert found.keys() == want.keys()
        for path, value in want.items():
            assert found[path] == (value if isinstance(value, tuple) else pytest.approx(value)), path
    assert len({r.path for r in nodes if r.tree == 1}) > 60


def test_ties_constants_and_small_nodes():
    one = lambda x, y, w=None, p=3: module.grow(np.array(x, float), np.array(y, float), np.array(w or [1] * len(y)), 1, "", 1, 1, 5)[0]
    assert one([[1, 1, 1]] * 4, [1, 2, 3, 4]).path == [""]  # nothing to cut
    assert one([[1, 2, 3], [2, 4, 6]], [5, 5]).path == [""]  # nothing to gain
    two = one([[1, 1, 1], [2, 2, 2]], [0, 1])
    assert two.path == ["", "0", "1"] and two.cut[0] == 1.5 and two.value[1:] == [0, 1]
    tied = one([[1, 1, 1], [1, 1, 1], [2, 2, 2]], [0, 1, 5], [2, 1, 1])
    assert tied.value[1:] == [pytest.approx(1 / 3), 5] and tied.n == [4, 3, 1]


def test_out_of_bag_means_and_importance_equal_brute_force(forest):
    trees = 30
    drawn = weights(forest, trees)
    rows = {r.row: (np.array(r.x), r.y) for r in drawn}
    size = len(rows)
    grown = {}
    for t in range(1, trees + 1):
        own = [r for r in drawn if r.tree == t and r.w > 0]
        grown[t] = plain_tree(np.array([r.x for r in own]), np.array([r.y for r in own]), np.array([r.w for r in own]), t)
    out = {(r.row, r.tree) for r in drawn if r.w == 0}
    assert 0.3 < len(out) / len(drawn) < 0.43
    keyed = {(r.site_no, r.water_year): r.row for r in forest.rows.collect()}
    for r in forest.predictions().collect():
        row = keyed[r.site_no, r.water_year]
        votes = {t: ask(grown[t], rows[row][0]) for t in grown}
        unseen = [v for t, v in votes.items() if (row, t) in out]
        assert r.n_trees == len(unseen) and r.pred == pytest.approx(np.mean(unseen)) and r.pred_all == pytest.approx(np.mean(list(votes.values())))
    source = {}
    for j in range(len(NAMES)):
        factor, shift = module.permutation(j, size, 123)
        source[j] = {(factor * i + shift) % size: i for i in range(size)}
        assert len(source[j]) == size
    for r in forest.importance().collect():
        j, rises = NAMES.index(r.feature), []
        for t, tree in grown.items():
            errors = []
            for row, (x, y) in rows.items():
                if (row, t) in out:
                    moved = x.copy()
                    moved[j] = rows[source[j][row]][0][j]
                    errors.append((y - ask(tree, moved)) ** 2 - (y - ask(tree, x)) ** 2)
            rises.append(np.mean(errors))
        assert r.mse_increase == pytest.approx(np.mean(rises), abs=1e-9) and r.mse_increase_sd == pytest.approx(np.std(rises), abs=1e-9)
    ranked = [r.feature for r in forest.importance().orderBy(F.desc("mse_increase")).collect()]
    assert ranked[0] == "x" and ranked[1] == "step"
    found = {r.feature: r for r in forest.importance().collect()}
    assert abs(found["noise"].mse_increase) < 0.05 * found["x"].mse_increase
    assert found["flat"].mse_increase == 0 and found["flat"].node_purity == 0


def test_large_nodes_take_the_same_splits(frame, monkeypatch):
    whole = op.exact_forest(frame, trees=4, seed=9, train=F.col("water_year") < 2010)
    monkeypatch.setattr(module, "LOCAL_ROWS", 60)
    parts = op.exact_forest(frame, trees=4, seed=9, train=F.col("water_year") < 2010)
    order = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    for get, by in ((lambda f: f.nodes(), ("tree", "path")), (lambda f: f.predictions(), ("site_no", "water_year")), (lambda f: f.importance(), ("feature",))):
        a, b = order(get(whole), *by), order(get(parts), *by)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
            assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])


def test_large_nodes_that_nothing_splits(spark, monkeypatch):
    same = [(f"s{i}", 2000, float(i % 3), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(90)]
    monkeypatch.setattr(module, "LOCAL_ROWS", 20)
    forest = op.exact_forest(cut_lineage(spark.createDataFrame(same, SCHEMA)), trees=3)
    assert {r.path for r in forest.nodes().collect()} == {""}
    assert {round(r.mse_increase, 9) for r in forest.importance().collect()} == {0.0}
    assert forest.predictions().where("pred_all between 0.6 and 1.4").count() == 90


def test_residuals_and_held_out_rows(spark, frame, forest):
    found = op.out_of_bag_residuals(forest)
    assert found.count() == 500 and found.where("abs(residual - (q5_norm - pred)) > 1e-9").count() == 0
    assert found.agg(F.corr("pred", "q5_norm")).first()[0] > 0.9
    parts = {r.part: r for r in op.train_test_errors(frame, trees=20).collect()}
    assert parts["train"].n + parts["test"].n == 500 and parts["train"].rmse < min(parts["test"].rmse, parts["out_of_bag"].rmse)
    assert 0.7 < parts["out_of_bag"].rmse / parts["test"].rmse < 1.4
    again = {r.part: r for r in op.train_test_errors(frame.repartition(7), trees=20).collect()}
    assert {k: v.rmse for k, v in again.items()} == pytest.approx({k: v.rmse for k, v in parts.items()})
    odd = spark.createDataFrame([*rows_of(30), ("n", 1, None, *[1.0] * 6), ("n", 2, 1.0, None, *[1.0] * 5), ("n", 3, float("nan"), *[1.0] * 6)], SCHEMA)
    assert op.exact_forest(odd, trees=3).predictions().count() == 30
    assert op.exact_forest(odd.limit(0), trees=3).predictions().count() == 0
