"""Regression forests with exact splits, out-of-bag predictions and permutation importance.

Breiman's forest (2001) as ``randomForest`` fits it: trees grown on bootstrap samples until a node holds
``min_node`` draws, a third of the drivers tried at each node, cuts half-way between neighbouring distinct
values, no bins and no depth limit. A row's draws in a tree are a Poisson count hashed from its number and
the tree, so that rows need not meet to be drawn.

Rows a tree did not draw travel through it as it grows. Each ends in a leaf, which gives the out-of-bag
predictions without a second pass, and so does its version with one driver permuted. Such a version
stays with its row until a split on that driver sends the two to different sides.

A node of more than ``LOCAL_ROWS`` rows is split by the cluster: values of its drivers are sorted by range,
running sums are put together from those of the ranges, and every gap between distinct values is a candidate.
Smaller nodes are finished whole in one task each; both ways take the same splits.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import error_summary
from ..session import cut_lineage, task_count
from .model import KEYS, drivers_of, hash_fraction

LOCAL_ROWS = 50_000  # rows of a node that one task finishes
PRIME = 2**31 - 1
TINY = 1e-12  # gain, relative to the node's sum of squares, that is taken for rounding
WITHOUT = -1  # stands for no permuted driver
TABLE = "kind string, tree int, path string, driver int, cut double, value double, n double, row long"
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mixed(tree, code, driver, seed: int):
    """Number below ``PRIME`` from tree, node and driver; of numbers, arrays or columns alike."""
    h = (tree * 7919 + (seed % PRIME)) % PRIME
    h = (h * h + code) % PRIME
    h = (h * h + driver + 1) % PRIME
    return (h * h) % PRIME


def child(code, side):
    """Number of a node's child; nodes are told apart by their path, this only feeds ``mixed``."""
    return (2 * code + side + 1) % PRIME


def tried(p: int) -> int:
    """Drivers tried at a node."""
    return max(1, p // 3)


def numbered(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """The rows with numbers from 0 in the order of a key hash, in two levels, and how many there are."""
    size = rows.count()
    hashed = rows.withColumn("_h", F.xxhash64(*KEYS, "y", "x", F.lit(seed))).withColumn("_part", F.pmod("_h", F.lit(max(1, math.isqrt(size)))))
    counts = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *KEYS)) - 1
    placed = hashed.withColumn("_place", place).join(counts, "_part")
    return placed.withColumn("row", F.col("_before") + F.col("_place")).drop("_h", "_part", "_before", "_place"), size


def permutation(driver: int, size: int, seed: int) -> tuple[int, int]:
    """Factor and shift of the permutation of a driver's column: row i takes its value to factor * i + shift."""
    factor = int(mixed(17, driver, 1, seed)) % max(size, 1)
    while math.gcd(factor, size) != 1:
        factor += 1
    return factor, int(mixed(23, driver, 2, seed)) % max(size, 1)


def with_permuted(rows: DataFrame, p: int, size: int, seed: int) -> DataFrame:
    """Adds ``xp``, every driver's value of another row; rows meet by number."""
    moves = [permutation(j, size, seed) for j in range(p)]
    factor, shift = (F.array(*[F.lit(m[k]).cast("long") for m in moves]) for k in (0, 1))
    sent = rows.select("row", F.posexplode("x").alias("j", "v"))
    target = (F.get(factor, F.col("j")) * F.col("row") + F.get(shift, F.col("j"))) % size
    got = sent.groupBy(target.alias("row")).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("_got"))
    return rows.join(got.select("row", F.transform("_got", lambda g: g["v"]).alias("xp")), "row")


def draws(row: str, tree: str, seed: int) -> Column:
    """How often a tree draws a row: Poisson with mean 1."""
    u = F.pmod(F.xxhash64(row, tree, F.lit(seed)), F.lit(PRIME)) / PRIME
    return reduce(Column.__add__, [(u >= F.lit(c)).cast("int") for c in POISSON])


# --- trees in one task


class Tree:
    """A tree below one node: driver -1 marks a leaf."""

    def __init__(self) -> None:
        self.driver, self.cut, self.left, self.right, self.value, self.n, self.path = [], [], [], [], [], [], []

    def add(self, path: str) -> int:
        for column, value in ((self.driver, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.n, 0.0), (self.path, path)):
            column.append(value)
        return len(self.path) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        driver, cut, left, right, value = (np.asarray(c) for c in (self.driver, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(driver[at] >= 0)
        while len(going):
            node = at[going]
            below = x[going, driver[node]] <= cut[node]
            at[going] = np.where(below, left[node], right[node])
            going = going[driver[at[going]] >= 0]
        return value[at]


def best_split(x: np.ndarray, w: np.ndarray, wy: np.ndarray, picks: np.ndarray) -> tuple[float, int, float]:
    """Gain, driver and cut of the best split over all gaps between distinct values.

    Gains are compared in single precision, so that splits into the same rows are ties whatever the
    order of summation; of ties the first driver and the lowest cut win.
    """
    v = x[:, picks]
    order = np.argsort(v, axis=0, kind="stable")
    v = np.take_along_axis(v, order, 0)
    n, s = w.sum(), wy.sum()
    ln, ls = np.cumsum(w[order], axis=0)[:-1], np.cumsum(wy[order], axis=0)[:-1]
    gain = np.where(v[1:] > v[:-1], ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n, -np.inf).astype(np.float32)
    at = gain.argmax(axis=0)
    value, j, k = max((gain[i, c], -int(picks[c]), c) for c, i in enumerate(at))
    low, high = v[at[k], k], v[at[k] + 1, k]
    cut = low + (high - low) / 2
    return value, -j, cut if cut < high else low


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: str, code: int, min_node: int, seed: int) -> tuple[Tree, list[float]]:
    """The tree on rows drawn ``w`` times, and the gain of each of its nodes."""
    made, gains, drivers = Tree(), [], np.arange(x.shape[1])
    wy, wyy = w * y, w * y * y
    todo = [(made.add(path), np.flatnonzero(w > 0), code)]
    while todo:
        at, rows, code = todo.pop()
        gains.extend([0.0] * (len(made.path) - len(gains)))
        n = w[rows].sum()
        made.n[at], made.value[at] = float(n), float(wy[rows].sum() / n)
        if n <= min_node or len(rows) < 2:
            continue
        order = mixed(tree, code, drivers, seed)
        picks = np.lexsort((drivers, order))[: tried(len(drivers))]
        gain, driver, cut = best_split(x[rows], w[rows], wy[rows], picks)
        if not gain > TINY * wyy[rows].sum():
            continue
        below = x[rows, driver] <= cut
        made.driver[at], made.cut[at], gains[at] = driver, cut, float(gain)
        made.left[at], made.right[at] = made.add(made.path[at] + "0"), made.add(made.path[at] + "1")
        todo += [(made.right[at], rows[~below], child(code, 1)), (made.left[at], rows[below], child(code, 0))]
    gains.extend([0.0] * (len(made.path) - len(gains)))
    return made, gains


def _matrix(column: pa.ChunkedArray, p: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, p)


def _finish(p: int, min_node: int, seed: int):
    """Grows what is left of a tree below a node and sends all rows of the node through it."""

    def finish(group: pa.Table) -> pa.Table:
        number = lambda c: group.column(c).to_numpy()
        tree, path, code = (group.column(c)[0].as_py() for c in ("tree", "path", "code"))
        x, y, w, variant = _matrix(group.column("x"), p), number("y"), number("w"), number("variant")
        out: list[tuple] = []
        if (w > 0).any():
            made, gains = grow(x, y, w, tree, path, code, min_node, seed)
            for at, node in enumerate(made.path):
                if made.driver[at] >= 0:
                    out.append(("split", tree, node, made.driver[at], made.cut[at], gains[at], made.n[at], None))
                else:
                    out.append(("leaf", tree, node, None, None, made.value[at], made.n[at], None))
            found = made.predict(x)
            whole = variant == WITHOUT
            out += [("drawn" if k else "row", tree, None, None, None, v, None, r) for r, v, k in zip(number("row")[whole].tolist(), found[whole].tolist(), (w[whole] > 0).tolist())]
            held = number("held")
            judged = np.flatnonzero(whole & ~held & (w == 0))
            error = (y - found) ** 2
            sums = {WITHOUT: [error[judged].sum(), len(judged)]}
            closed = [set(c or ()) for c in group.column("closed").take(pa.array(judged)).to_pylist()]
            xp = _matrix(group.column("xp").take(pa.array(judged)), p) if len(judged) else np.zeros((0, p))
            used = set(made.driver)
            for j in range(p):
                open_ = np.array([j not in c for c in closed], bool)
                other = error[judged]
                if j in used and open_.any():
                    moved = x[judged].copy()
                    moved[:, j] = xp[:, j]
                    other = (y[judged] - made.predict(moved)) ** 2
                alone = variant == j
                sums[j] = [other[open_].sum() + error[alone].sum(), int(open_.sum() + alone.sum())]
            out += [("error", tree, None, j, None, float(total), float(n), None) for j, (total, n) in sums.items() if n]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=[c.split(" ")[0] for c in TABLE.split(", ")])

    return finish


# --- large nodes


def _candidates(drawn: DataFrame, nodes: DataFrame, rows: int, p: int, seed: int) -> DataFrame:
    """tree, path, j, v with draws and sums of every distinct value, and the range that holds it."""
    ordered = F.array_sort(F.array(*[F.struct(mixed(F.col("tree").cast("long"), F.col("code"), j, seed).alias("h"), F.lit(j).alias("j")) for j in range(p)]))
    picks = nodes.withColumn("j", F.explode(F.transform(F.slice(ordered, 1, tried(p)), lambda o: o["j"]))).select("tree", "path", "j")
    values = drawn.join(picks, ["tree", "path"]).select("tree", "path", "j", F.get("x", F.col("j")).alias("v"), "w", "y")
    values = values.groupBy("tree", "path", "j", "v").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    parts = max(task_count(drawn.sparkSession), math.ceil(rows * tried(p) / LOCAL_ROWS))
    return cut_lineage(values.repartitionByRange(parts, "tree", "path", "j", "v").withColumn("part", F.spark_partition_id()))


def _best_splits(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, path, driver, cut, gain of the nodes that a split improves."""
    node = ["tree", "path", "j"]
    inside = Window.partitionBy(*node, "part").orderBy("v")
    across = Window.partitionBy(*node).orderBy("part")
    sums = values.groupBy(*node, "part").agg(F.sum("n").alias("pn"), F.sum("s").alias("ps"), F.min("v").alias("low"))
    before = lambda c: F.coalesce(F.sum(c).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*node, "part", before("pn").alias("bn"), before("ps").alias("bs"), F.lead("low").over(across).alias("following"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cuts = values.withColumns({"ln": F.sum("n").over(upto), "ls": F.sum("s").over(upto), "high": F.lead("v").over(inside)})
    cuts = cuts.join(sums, [*node, "part"]).join(nodes, ["tree", "path"])
    cuts = cuts.withColumns({"ln": F.col("ln") + F.col("bn"), "ls": F.col("ls") + F.col("bs"), "high": F.coalesce("high", "following")}).where(F.col("high").isNotNull())
    n, s, ln, ls = (F.col(c) for c in ("node_n", "node_s", "ln", "ls"))
    gain = ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n
    middle = F.col("v") + (F.col("high") - F.col("v")) / 2
    cuts = cuts.select("tree", "path", "node_q", "node_n", "code", F.struct(gain.cast("float").alias("gain"), (-F.col("j")).alias("j"), (-F.when(middle < F.col("high"), middle).otherwise(F.col("v"))).alias("cut")).alias("best"))
    best = cuts.groupBy("tree", "path").agg(F.max("best").alias("best"), F.first("node_q").alias("node_q"), F.first("node_n").alias("n"))
    best = best.where(F.col("best.gain") > TINY * F.col("node_q"))
    return best.select("tree", "path", (-F.col("best.j")).cast("int").alias("driver"), (-F.col("best.cut")).alias("cut"), F.col("best.gain").cast("double").alias("gain"), "n")


def _descend(state: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows one level down; a permuted version that goes another way than its row leaves it there."""
    met = state.join(splits.select("tree", "path", "driver", "cut"), ["tree", "path"])
    j = F.col("driver")
    side = (F.get("x", j) > F.col("cut")).cast("int")
    other = (F.get("xp", j) > F.col("cut")).cast("int")
    parts = (F.col("variant") == WITHOUT) & F.col("xp").isNotNull() & ~F.array_contains(F.col("closed"), j) & (side != other)
    rest = [c for c in state.columns if c not in ("path", "code", "x", "xp", "closed", "variant")]

    def down(to: Column) -> list[Column]:
        return [F.concat("path", to.cast("string")).alias("path"), child(F.col("code"), to).cast("long").alias("code")]

    none = F.array().cast("array<int>")
    stay = F.struct(*down(side), F.col("x").alias("x"), F.col("xp").alias("xp"), F.when(parts, F.array_append("closed", j)).otherwise(F.col("closed")).alias("closed"), F.col("variant").alias("variant"))
    moved = F.transform("x", lambda v, i: F.when(i == j, F.get("xp", j)).otherwise(v))
    leave = F.struct(*down(other), moved.alias("x"), F.lit(None).cast("array<double>").alias("xp"), none.alias("closed"), j.cast("int").alias("variant"))
    went = F.when(parts, F.array(stay, leave)).otherwise(F.array(stay))
    return met.select(*rest, F.inline(went)).select(*state.columns)


def _leaves(state: DataFrame, nodes: DataFrame, p: int) -> DataFrame:
    """Large nodes that nothing splits: what ``_finish`` returns, from joins and sums."""
    met = state.join(nodes.select("tree", "path", (F.col("node_s") / F.col("node_n")).alias("value")), ["tree", "path"])
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shape = lambda df, **given: df.select(*[given[c].cast(k).alias(c) if c in given else null(k, c) for c, k in (x.split(" ") for x in TABLE.split(", "))])
    leaf = shape(nodes, kind=F.lit("leaf"), tree=F.col("tree"), path=F.col("path"), value=F.col("node_s") / F.col("node_n"), n=F.col("node_n"))
    rows = shape(met.where(F.col("variant") == WITHOUT), kind=F.when(F.col("w") > 0, "drawn").otherwise("row"), tree=F.col("tree"), value=F.col("value"), row=F.col("row"))
    every = F.array(*[F.lit(j) for j in range(WITHOUT, p)])
    told = F.when(F.col("variant") == WITHOUT, F.array_except(every, "closed")).otherwise(F.array("variant"))
    errors = met.where((F.col("w") == 0) & ~F.col("held")).select("tree", F.explode(told).alias("driver"), ((F.col("y") - F.col("value")) ** 2).alias("e"))
    errors = errors.groupBy("tree", "driver").agg(F.sum("e").alias("value"), F.count(F.lit(1)).alias("n"))
    errors = shape(errors, kind=F.lit("error"), tree=F.col("tree"), driver=F.col("driver"), value=F.col("value"), n=F.col("n"))
    return leaf.unionByName(rows).unionByName(errors)


def _split_large(state: DataFrame, p: int, min_node: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """Splits nodes until all hold at most ``LOCAL_ROWS`` rows; the rows by node, and the table so far."""
    done, table = [], []
    while True:
        state = cut_lineage(state)
        w, y = F.col("w"), F.col("y")
        nodes = state.groupBy("tree", "path").agg(
            F.count(F.lit(1)).alias("rows"), F.first("code").alias("code"), F.sum("w").alias("node_n"), F.sum(w * y).alias("node_s"), F.sum(w * y * y).alias("node_q")
        )
        large = cut_lineage(nodes.where((F.col("rows") > LOCAL_ROWS) & (F.col("node_n") > min_node)))
        rows = large.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        done.append(state.join(large.select("tree", "path"), ["tree", "path"], "left_anti"))
        if not rows:
            return reduce(DataFrame.unionByName, done), table
        big = state.join(large.select("tree", "path"), ["tree", "path"], "left_semi")
        values = _candidates(big.where("w > 0"), large, rows, p, seed)
        splits = cut_lineage(_best_splits(values, large))
        table.append(splits.selectExpr("'split' as kind", "tree", "path", "driver", "cut", "gain as value", "cast(n as double) as n", "cast(null as long) as row"))
        whole = large.join(splits.select("tree", "path"), ["tree", "path"], "left_anti")
        table.append(_leaves(big, whole, p))
        state = _descend(big, splits)


# --- the forest


@dataclass
class ExactForest:
    """A fitted forest: ``table`` holds splits, leaves, predictions and errors, ``rows`` the numbered input."""

    table: DataFrame
    rows: DataFrame
    drivers: list[str]
    trees: int
    label: str
    centre: float

    def nodes(self) -> DataFrame:
        """tree, path (sides from the root, 0 below the cut), feature, cut, prediction of leaves, n (draws), gain."""
        names = F.array(*[F.lit(d) for d in self.drivers])
        split = F.col("kind") == "split"
        return self.table.where(F.col("kind").isin("split", "leaf")).select(
            "tree", "path", F.get(names, F.col("driver")).alias("feature"), "cut",
            F.when(~split, F.col("value") + self.centre).alias("prediction"), "n", F.when(split, F.col("value")).alias("gain"),
        )

    def predictions(self) -> DataFrame:
        """Keys, response, mean prediction of all trees, and out of bag: of the trees that did not draw the row.

        Rows that were held out of the fit are drawn by no tree.
        """
        undrawn = F.col("kind") == "row"
        votes = self.table.where(F.col("kind").isin("row", "drawn")).groupBy("row").agg(
            F.avg("value").alias("pred_all"), F.avg(F.when(undrawn, F.col("value"))).alias("pred"), F.count_if(undrawn).alias("n_trees")
        )
        scored = self.rows.join(votes, "row", "left")
        return scored.select(
            *KEYS, F.col("y").alias(self.label), "held", (F.col("pred") + self.centre).alias("pred"),
            (F.col("pred_all") + self.centre).alias("pred_all"), F.coalesce("n_trees", F.lit(0)).alias("n_trees"),
        )

    def importance(self) -> DataFrame:
        """feature, mse_increase (mean over trees of the out-of-bag error with the driver permuted less that
        without), its standard deviation and their ratio scaled as a mean, and node_purity (mean gain per tree)."""
        errors = self.table.where("kind = 'error'").groupBy("tree", "driver").agg((F.sum("value") / F.sum("n")).alias("mse"))
        plain = errors.where(F.col("driver") == WITHOUT).select("tree", F.col("mse").alias("plain"))
        rise = F.col("mse") - F.col("plain")
        rises = errors.where(F.col("driver") != WITHOUT).join(plain, "tree").groupBy("driver").agg(
            F.avg(rise).alias("mse_increase"), F.stddev_pop(rise).alias("mse_increase_sd"), F.count(F.lit(1)).alias("_trees")
        )
        purity = self.table.where("kind = 'split'").groupBy("driver").agg((F.sum("value") / self.trees).alias("node_purity"))
        names = self.table.sparkSession.createDataFrame(list(enumerate(self.drivers)), "driver int, feature string")
        found = names.join(rises, "driver", "left").join(purity, "driver", "left")
        scaled = F.try_divide(F.col("mse_increase"), F.col("mse_increase_sd") / F.sqrt("_trees"))
        return found.select("feature", "mse_increase", "mse_increase_sd", scaled.alias("mse_increase_scaled"), F.coalesce("node_purity", F.lit(0.0)).alias("node_purity"))


def exact_forest(
    frame: DataFrame,
    trees: int = 400,
    seed: int = 123,
    min_node: int = 5,
    label: str = "q5_norm",
    train: Column | None = None,
    drivers: Sequence[str] | None = None,
) -> ExactForest:
    """Fits a forest; rows with a null or NaN take no part.

    Only rows for which ``train`` holds are drawn; the others are predicted by all trees. The frame is
    read several times: hand in a stored table. The fitted table is stored in the shared folder.
    """
    names = list(drivers) if drivers is not None else drivers_of(frame, label)
    p = len(names)
    rows = frame.select(*KEYS, F.col(label).cast("double").alias("y"), F.array(*[F.col(d).cast("double") for d in names]).alias("x"), (~F.coalesce(train, F.lit(False)) if train is not None else F.lit(False)).alias("held"))
    usable = F.col("y").isNotNull() & ~F.isnan("y") & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = rows.where(usable)
    learned, size = numbered(rows.where("not held"), seed)
    learned = with_permuted(learned, p, size, seed) if size else learned.withColumn("xp", F.lit(None).cast("array<double>"))
    others, more = numbered(rows.where("held"), seed)
    others = others.withColumn("row", F.col("row") + size).withColumn("xp", F.lit(None).cast("array<double>"))
    whole = cut_lineage(learned.unionByName(others))
    centre = whole.where("not held").agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    state = whole.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("w", F.when(F.col("held"), 0).otherwise(draws("row", "tree", seed)))
    state = state.select(
        "tree", F.lit("").alias("path"), F.lit(1).cast("long").alias("code"), "row", (F.col("y") - centre).alias("y"), "w", "held", "x",
        F.when(F.col("w") == 0, F.col("xp")).alias("xp"), F.array().cast("array<int>").alias("closed"), F.lit(WITHOUT).alias("variant"),
    )
    table: list[DataFrame] = []
    if size + more > LOCAL_ROWS:
        state, table = _split_large(state, p, min_node, seed)
    state = state.repartition(max(task_count(frame.sparkSession), min(trees, 200)), "tree", "path")
    table.append(state.groupBy("tree", "path").applyInArrow(_finish(p, min_node, seed), TABLE))
    return ExactForest(cut_lineage(reduce(DataFrame.unionByName, table)), whole.drop("xp"), names, trees, label, centre)


def out_of_bag_residuals(forest: ExactForest) -> DataFrame:
    """Keys, response, out-of-bag prediction, residual and the number of trees behind it; null where all trees drew the row."""
    found = forest.predictions().where("not held")
    return found.select(*KEYS, forest.label, "pred", (F.col(forest.label) - F.col("pred")).alias("residual"), "n_trees")


def train_test_errors(frame: DataFrame, frac: float = 0.7, seed: int = 123, trees: int = 400, label: str = "q5_norm", **settings) -> DataFrame:
    """Error summary of one exact forest on the rows it was fitted on, out of bag on them, and on rows held out by hash."""
    found = exact_forest(frame, trees, seed, label=label, train=hash_fraction(seed) < frac, **settings).predictions()
    parts = [
        found.where("not held").select(F.lit("train").alias("part"), label, F.col("pred_all").alias("pred")),
        found.where("not held and pred is not null").select(F.lit("out_of_bag").alias("part"), label, "pred"),
        found.where("held").select(F.lit("test").alias("part"), label, "pred"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("part").agg(*error_summary(label, "pred"))
