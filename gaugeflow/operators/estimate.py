"""Daily concentration from sparse samples by locally weighted regression.

Weighted regressions on time, discharge and season (Hirsch, Moyer & Archfield 2010): around each
node of a (time, ln Q) grid, ln C is regressed on time, ln Q and the season with tricube weights.
Spark folds samples per day, lays out the grids and places (site, block of years) groups; inside a
group, bounded by the calendar, the weighted sums of all nodes are matrix products.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import decimal_year
from ..functions.series import SITE, by_site
from ..session import task_count

# Fixed values of the method: grid of 16 steps a year by 14 levels reaching 0.05 beyond the range of
# ln Q, zero flows shifted by 0.001 of the mean, windows growing by a tenth.
STEPS_PER_YEAR = 16
LEVELS = 14
LN_Q_MARGIN = 0.05
ZERO_SHIFT = 0.001
GROWTH = 1.1
UPPER = np.triu_indices(5)

# Tasks get the functions themselves, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SURFACE = f"{SITE} string, ti int, li int, y_hat double, se double, n_obs double, growth int"
HELD_OUT = f"{SITE} string, date date, q double, y_hat double, se double, conc double, n_obs double, growth int, leverage double"
BLOCK_YEARS = 4  # nodes of so many years are fitted in one group
NODES_AT_ONCE = 128
CERTAIN = 1e-9  # what a day leaves of its own leverage at least for the closed form


def _with_ln_q(daily: DataFrame) -> DataFrame:
    """Daily rows with decimal year and ln Q; a site with zero flow is shifted by 0.1 % of its mean."""
    sites = daily.groupBy(SITE).agg(
        F.when(F.min("q") <= 0, ZERO_SHIFT * F.avg(F.greatest("q", F.lit(0.0)))).otherwise(F.lit(0.0)).alias("_shift")
    )
    shifted = F.greatest("q", F.lit(0.0)) + F.col("_shift")
    return daily.join(sites, SITE).select(
        SITE, "date", "q", decimal_year("date").alias("t"), F.when(shifted > 0, F.ln(shifted)).alias("ln_q")
    )


def _grid(days: DataFrame) -> DataFrame:
    """Grid of each site: whole years around the record, 14 levels of ln Q."""
    g = days.groupBy(SITE).agg(
        F.min("date").alias("d_lo"),
        F.max("date").alias("d_hi"),
        F.min("t").alias("t_lo"),
        F.max("t").alias("t_hi"),
        F.floor(F.min("t")).alias("t0"),
        F.ceil(F.max("t")).alias("t1"),
        (F.min("ln_q") - LN_Q_MARGIN).alias("l0"),
        (F.max("ln_q") + LN_Q_MARGIN).alias("l1"),
    )
    return g.select(
        "*",
        ((F.col("t1") - F.col("t0")) * STEPS_PER_YEAR + 1).cast("int").alias("nt"),
        ((F.col("l1") - F.col("l0")) / (LEVELS - 1)).alias("step"),
    )


def _sample_days(samples: DataFrame, days: DataFrame, grid: DataFrame) -> DataFrame:
    """Samples folded per day, with the day's ln Q.

    All samples of a day share the regressors and weights, so their count, sum and sum of squares
    say everything. This bounds a site by its calendar however many samples it has. Where samples
    stick out of the discharge record, only those strictly inside stay.
    """
    logs = samples.where(F.col("result_va") > 0).select(SITE, F.col("sample_dt").alias("date"), F.ln("result_va").alias("y"))
    folded = logs.groupBy(SITE, "date").agg(
        F.count(F.lit(1)).alias("m"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("sy2")
    )
    ends = folded.groupBy(SITE).agg(F.min("date").alias("_s_lo"), F.max("date").alias("_s_hi"))
    bounds = ends.join(grid, SITE)
    day = F.col("date")
    inside = ((F.col("d_lo") <= F.col("_s_lo")) | (day > F.col("d_lo"))) & (
        (F.col("d_hi") >= F.col("_s_hi")) | (day < F.col("d_hi"))
    )
    kept = folded.join(bounds, SITE).where(inside).drop("_s_lo", "_s_hi")
    return kept.join(days.select(SITE, "date", "q", "t", "ln_q"), [SITE, "date"]).where(F.col("ln_q").isNotNull())


def _tricube(u: np.ndarray) -> np.ndarray:
    v = 1 - u * u * u
    return np.where(u < 1, v * v * v, 0.0)


def _growth_steps(entry: np.ndarray, m: np.ndarray, min_obs: float) -> np.ndarray:
    """Window growth per level: the least step at which ``min_obs`` samples have entered.

    ``entry`` (levels x points) is the window size, relative to the base, a point needs; infinite
    if it can never enter. A level that never gets there takes all points that can.
    """
    steps = np.zeros(len(entry), dtype=int)
    for level in np.flatnonzero((entry < 1) @ m < min_obs):
        order = np.argsort(entry[level])
        order = order[np.isfinite(entry[level][order])]
        at = min(np.searchsorted(np.cumsum(m[order]), min_obs), len(order) - 1)
        need = entry[level][order][at] if len(order) else 0
        if need >= 1:
            steps[level] = int(np.floor(np.log(need) / np.log(GROWTH))) + 1
    return steps


def _block_fitter(half_s: float, half_y: float, half_q: float, min_obs: int, edge_adjust: bool, block_years: int):
    """Regression at the nodes of one (site, block of years) from all sample days of the site."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.iloc[0]
        group = group.sort_values("t")
        t, lq, m, sy, sy2 = (group[c].to_numpy(dtype=float) for c in ("t", "ln_q", "m", "sy", "sy2"))
        level = g["l0"] + g["step"] * np.arange(LEVELS)
        mid = (g["l0"] + g["l1"]) / 2
        dl = np.abs(level[:, None] - lq[None, :])
        sin, cos = np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)
        first = int(g["block"]) * block_years * STEPS_PER_YEAR
        out = []
        for ti in range(first, min(first + block_years * STEPS_PER_YEAR, int(g["nt"]))):
            node = g["t0"] + ti / STEPS_PER_YEAR
            edge = min(node - g["t_lo"], g["t_hi"] - node)
            hy = 2 * half_y - edge if edge_adjust and edge <= half_y else half_y
            dt = t - node
            season = np.abs(dt - np.round(dt))
            near = np.maximum(np.abs(dt) / hy, season / half_s)
            near = np.where(season < max(half_s, 0.5), near, np.inf)
            steps = _growth_steps(np.maximum(near[None, :], dl / half_q), m, min_obs)
            w = np.empty_like(dl)
            for step in np.unique(steps):
                grow, at = GROWTH**step, steps == step
                half_season = min(half_s * grow, 0.5) if half_s <= 0.5 else half_s
                in_time = _tricube(np.abs(dt) / (hy * grow)) * _tricube(season / half_season)
                w[at] = in_time * _tricube(dl[at] / (half_q * grow))
            x = np.stack([np.ones_like(t), dt, lq - mid, sin, cos], axis=1)
            products = x[:, UPPER[0]] * x[:, UPPER[1]] * m[:, None]
            a = np.zeros((LEVELS, 5, 5))
            a[:, UPPER[0], UPPER[1]] = w @ products
            a[:, UPPER[1], UPPER[0]] = a[:, UPPER[0], UPPER[1]]
            r = w @ (x * sy[:, None])
            b = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), r)
            angle = 2 * np.pi * node
            at_node = np.stack([np.ones(LEVELS), np.zeros(LEVELS), level - mid, np.full(LEVELS, np.sin(angle)), np.full(LEVELS, np.cos(angle))], axis=1)
            rss = np.maximum(w @ sy2 - np.einsum("ni,ni->n", b, r), 0.0)
            total = a[:, 0, 0]
            out.append(pd.DataFrame({
                SITE: g[SITE],
                "ti": ti,
                "li": np.arange(LEVELS),
                "y_hat": np.einsum("ni,ni->n", b, at_node),
                "se": np.sqrt(rss / np.where(total > 0, total, np.nan)),
                "n_obs": (w > 0) @ m,
                "growth": steps,
            }))
        return pd.concat(out, ignore_index=True)

    return fit


def _reach(half_s: float, half_y: float, half_q: float, min_obs: int, edge_adjust: bool, block_years: int):
    """Range of sample blocks that the nodes of each block of years may use, from the counts of a site.

    A cell is a block of sample days and a level of ln Q. All of a cell has entered a node's windows
    once they have grown to the largest distance between the two, so running counts over cells bound
    the growth of every node of a block from above, and with it the time span its windows can reach.
    """

    def reach(cells: pd.DataFrame) -> pd.DataFrame:
        g = cells.iloc[0]
        block, level, m = (cells[c].to_numpy(dtype=float) for c in ("sample_block", "level", "m"))
        apart = (np.abs(level[None, :] - np.arange(LEVELS)[:, None]) + 1) * g["step"] / half_q
        need = min_obs + cells["m_day"].max()  # the day of a node itself may be taken out
        rows = []
        for b in range(int((g["nt"] - 1) // (STEPS_PER_YEAR * block_years)) + 1):
            time = (np.abs(block - b) + 1) * block_years / half_y
            entry = np.maximum(np.maximum(time, 0.5 / half_s)[None, :], apart)
            order = np.argsort(entry, axis=1)
            enough = np.cumsum(m[order], axis=1) >= need
            at = np.take_along_axis(entry, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0]
            grow = max(1.0, np.where(enough.any(axis=1), at, np.inf).max()) * GROWTH
            start = g["t0"] + b * block_years
            at_edge = edge_adjust and min(start - g["t_lo"], g["t_hi"] - start - block_years) <= half_y
            span = (2 * half_y + 1 if at_edge else half_y) * grow / block_years
            near = block[np.abs(block - b) - 1 <= span]
            if len(near):
                rows.append((g[SITE], b, int(near.min()), int(near.max())))
        return pd.DataFrame(rows, columns=[SITE, "block", "lo", "hi"])

    return reach


def _placed(points: DataFrame, half_s: float, half_y: float, half_q: float, min_obs: int, edge_adjust: bool, block_years: int) -> DataFrame:
    """Sample days laid out by the blocks of years whose nodes may use them.

    A day goes to the blocks that windows can reach from, however long the record is.
    """
    points = points.withColumn("sample_block", F.floor((F.col("t") - F.col("t0")) / block_years).cast("int"))
    level = F.least(F.coalesce(F.floor(F.try_divide(F.col("ln_q") - F.col("l0"), F.col("step"))), F.lit(0)), F.lit(LEVELS - 2))
    # A node half a year away from a date never takes it: the fullest date of a cell is not counted on.
    dates = points.groupBy(SITE, "sample_block", level.cast("int").alias("level"), (F.col("t") - F.floor("t")).alias("_date")).agg(
        F.sum("m").alias("_m"), F.max("m").alias("_day"), *[F.first(c).alias(c) for c in ("t0", "t_lo", "t_hi", "step", "nt")]
    )
    cells = dates.groupBy(SITE, "sample_block", "level").agg(
        (F.sum("_m") - F.max("_m")).alias("m"), F.max("_day").alias("m_day"), *[F.first(c).alias(c) for c in ("t0", "t_lo", "t_hi", "step", "nt")]
    )
    ranges = cells.groupBy(SITE).applyInPandas(
        _reach(half_s, half_y, half_q, min_obs, edge_adjust, block_years), f"{SITE} string, block int, lo int, hi int"
    )
    wanted = ranges.select(SITE, "block", F.explode(F.sequence("lo", "hi")).alias("sample_block"))
    placed = points.join(wanted, [SITE, "sample_block"])
    return placed.repartition(task_count(points.sparkSession), SITE, "block")


def fit_surface(
    samples: DataFrame,
    daily: DataFrame,
    half_s: float = 0.5,
    half_y: float = 7,
    half_q: float = 2,
    min_obs: int = 45,
    edge_adjust: bool = True,
    block_years: int = BLOCK_YEARS,
) -> DataFrame:
    """Regression at every grid node: y_hat, se, number of samples and window growth.

    A node with fewer than ``min_obs`` samples in its base windows widens all three by steps of
    1.1 until it has enough. A group is the nodes of a block of years with the sample days that
    their windows can reach, as far as they may have to grow. A site without samples in its
    discharge record has no surface.
    """
    days = _with_ln_q(daily)
    points = _sample_days(samples, days, _grid(days))
    settings = (half_s, half_y, half_q, min_obs, edge_adjust, block_years)
    return _placed(points, *settings).groupBy(SITE, "block").applyInPandas(_block_fitter(*settings), SURFACE)


def _held_out_fitter(half_s: float, half_y: float, half_q: float, min_obs: int, edge_adjust: bool, block_years: int):
    """Estimates at the sample days of one (site, block of years), each without its own day."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        g = group.iloc[0]
        t, lq, m, sy, sy2 = (group[c].to_numpy(dtype=float) for c in ("t", "ln_q", "m", "sy", "sy2"))
        x = np.stack([np.ones_like(t), t - t.mean(), lq - lq.mean(), np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)], axis=1)
        products = x[:, UPPER[0]] * x[:, UPPER[1]] * m[:, None]
        nodes = np.flatnonzero(group["sample_block"].to_numpy() == g["block"])
        out = []
        for chunk in np.split(nodes, range(NODES_AT_ONCE, len(nodes), NODES_AT_ONCE)):
            here = np.arange(len(chunk))
            edge = np.minimum(t[chunk] - g["t_lo"], g["t_hi"] - t[chunk])
            hy = np.where((edge <= half_y) & edge_adjust, 2 * half_y - edge, half_y)[:, None]
            dt, dl = np.abs(t[None, :] - t[chunk][:, None]), np.abs(lq[None, :] - lq[chunk][:, None])
            season = np.abs(dt - np.round(dt))
            entry = np.maximum(np.maximum(dt / hy, season / half_s), dl / half_q)
            entry[season >= max(half_s, 0.5)] = np.inf
            entry[here, chunk] = np.inf  # the day itself is no sample of its node
            steps = _growth_steps(entry, m, min_obs)
            grow = (GROWTH**steps)[:, None]
            half_season = np.minimum(half_s * grow, 0.5) if half_s <= 0.5 else half_s
            w = _tricube(dt / (hy * grow)) * _tricube(season / half_season) * _tricube(dl / (half_q * grow))
            a = np.zeros((len(chunk), 5, 5))
            a[:, UPPER[0], UPPER[1]] = w @ products
            a[:, UPPER[1], UPPER[0]] = a[:, UPPER[0], UPPER[1]]
            r = w @ (x * sy[:, None])
            own, m_own, mean_own = x[chunk], m[chunk], sy[chunk] / m[chunk]
            # The day has weight 1 at its own node; its leverage says what the fit owes to it.
            inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
            b = np.einsum("nij,nj->ni", inverse, r)
            pull = np.einsum("nij,nj->ni", inverse, own)
            leverage = m_own * np.einsum("ni,ni->n", own, pull)
            left = 1 - leverage
            error = mean_own - np.einsum("ni,ni->n", own, b)
            without = b - pull * (m_own * error / np.where(left > CERTAIN, left, 1.0))[:, None]
            r_without = r - own * sy[chunk][:, None]
            for k in np.flatnonzero(left <= CERTAIN):  # only this day speaks for some direction: refit
                rest = a[k] - m_own[k] * np.outer(own[k], own[k])
                without[k] = np.linalg.pinv(rest, rcond=1e-9, hermitian=True) @ r_without[k]
            total = a[:, 0, 0] - m_own
            n_obs = (w > 0) @ m - m_own
            rss = np.maximum(w @ sy2 - sy2[chunk] - np.einsum("ni,ni->n", without, r_without), 0.0)
            se = np.sqrt(rss / np.where(n_obs > 0, total, np.nan))
            y_hat = np.where(n_obs > 0, np.einsum("ni,ni->n", without, own), np.nan)
            out.append(pd.DataFrame({
                SITE: g[SITE], "date": group["date"].to_numpy()[chunk], "q": group["q"].to_numpy()[chunk], "y_hat": y_hat, "se": se,
                "conc": np.exp(y_hat + se * se / 2), "n_obs": n_obs, "growth": steps, "leverage": leverage,
            }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split(" ")[0] for c in HELD_OUT.split(", ")])

    return fit


def held_out_estimates(
    samples: DataFrame,
    daily: DataFrame,
    half_s: float = 0.5,
    half_y: float = 7,
    half_q: float = 2,
    min_obs: int = 45,
    edge_adjust: bool = True,
    block_years: int = BLOCK_YEARS,
) -> DataFrame:
    """Estimate at every sample day from the samples of all other days.

    The regression is fitted at the day's own time and ln Q with windows that hold ``min_obs`` samples
    besides its own. Its normal matrix is inverted once with the day inside; the day's weight is then
    taken out in closed form: with leverage h the estimate without it is (fit - h * observed) / (1 - h).
    Returns site_no, date, q, y_hat, se, conc, n_obs, growth and leverage; ``estimate_errors`` judges
    ``conc``. A day that no other sample reaches has null estimates.
    """
    days = _with_ln_q(daily)
    points = _sample_days(samples, days, _grid(days))
    settings = (half_s, half_y, half_q, min_obs, edge_adjust, block_years)
    found = _placed(points, *settings).groupBy(SITE, "block").applyInPandas(_held_out_fitter(*settings), HELD_OUT)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(SITE, "date", "q", number("y_hat"), number("se"), number("conc"), "n_obs", "growth", "leverage")


def daily_from_surface(daily: DataFrame, surface: DataFrame) -> DataFrame:
    """Daily estimates by bilinear interpolation of the surface in time and ln Q.

    A slab holds one time step and the next for all levels (at most 28 values), so a day needs
    one equi-join on (site, step).
    """
    days = _with_ln_q(daily)
    grid = _grid(days)
    value = F.struct("y_hat", "se")
    both = surface.select(SITE, "li", value.alias("v"), F.explode(F.array(
        F.struct(F.col("ti").alias("ti"), F.lit(0).alias("side")), F.struct((F.col("ti") - 1).alias("ti"), F.lit(1).alias("side"))
    )).alias("s"))
    side = F.col("s.side")
    slabs = both.groupBy(SITE, F.col("s.ti").alias("ti")).agg(*[
        F.map_from_entries(F.collect_list(F.when(side == s, F.struct("li", "v")))).alias(f"now{s}") for s in (0, 1)
    ])
    pos_t = (F.col("t") - F.col("t0")) * STEPS_PER_YEAR
    pos_l = (F.col("ln_q") - F.col("l0")) / F.col("step")
    placed = days.join(grid.select(SITE, "t0", "l0", "step"), SITE).withColumns({"pt": pos_t, "pl": pos_l})
    placed = placed.withColumns({"ti": F.floor("pt").cast("int"), "li": F.floor("pl").cast("int")})
    met = placed.join(slabs, [SITE, "ti"], "left")
    ft, fl = F.col("pt") - F.col("ti"), F.col("pl") - F.col("li")

    def blend(field: str) -> Column:
        def at(s: int, up: int) -> Column:
            return F.try_element_at(F.col(f"now{s}"), F.col("li") + up)[field]

        low = at(0, 0) * (1 - fl) + at(0, 1) * fl
        high = at(1, 0) * (1 - fl) + at(1, 1) * fl
        return low * (1 - ft) + high * ft

    out = met.select(SITE, "date", "q", blend("y_hat").alias("y_hat"), blend("se").alias("se"))
    return out.withColumn("conc", F.exp(F.col("y_hat") + F.col("se") * F.col("se") / 2))


def concentration_surface(
    samples: DataFrame,
    daily: DataFrame,
    half_s: float = 0.5,
    half_y: float = 7,
    half_q: float = 2,
    min_obs: int = 45,
    edge_adjust: bool = True,
) -> DataFrame:
    """Daily concentration estimate per site: site_no, date, q, y_hat, se, conc."""
    surface = fit_surface(samples, daily, half_s, half_y, half_q, min_obs, edge_adjust)
    return daily_from_surface(daily, surface)


def residual_bridge(daily_est: DataFrame, samples: DataFrame, rho: float = 0.9) -> DataFrame:
    """Daily estimate conditioned on the samples, as ``gen_conc``.

    Standardised residuals follow a first-order autoregression (Zhang & Hirsch 2019). In place of
    averaging random paths this takes the conditional mean and variance between the neighbouring
    sample days in closed form; on a sample day the estimate is the sample. Several samples of
    one day enter with their mean log.
    """
    logs = samples.where(F.col("result_va") > 0).groupBy(SITE, F.col("sample_dt").alias("date")).agg(
        F.avg(F.ln("result_va")).alias("_y")
    )
    days = daily_est.join(logs, [SITE, "date"], "left")
    z = F.coalesce(F.try_divide(F.col("_y") - F.col("y_hat"), F.col("se")), F.when(F.col("_y").isNotNull(), F.lit(0.0)))
    days = days.withColumn("_s", F.when(z.isNotNull(), F.struct(F.col("date").alias("d"), z.alias("z"))))
    forward = by_site().rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(SITE).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_a", F.last("_s", ignorenulls=True).over(forward))
    days = days.withColumn("_b", F.last("_s", ignorenulls=True).over(backward))
    s, u = F.datediff("date", "_a.d"), F.datediff("_b.d", "date")
    za, zb = F.col("_a.z"), F.col("_b.z")

    def power(n: Column) -> Column:
        return F.pow(F.lit(float(rho)), n)

    full = 1 - power(2 * (s + u))
    between = F.try_divide(power(s) * (1 - power(2 * u)) * za + power(u) * (1 - power(2 * s)) * zb, full)
    spread = F.try_divide((1 - power(2 * s)) * (1 - power(2 * u)), full)
    on_day = F.col("_s").isNotNull()
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    m = F.when(on_day, F.col("_s.z")).when(a & b, between).when(a, power(s) * za).when(b, power(u) * zb).otherwise(F.lit(0.0))
    v = F.when(on_day, F.lit(0.0)).when(a & b, spread).when(a, 1 - power(2 * s)).when(b, 1 - power(2 * u)).otherwise(F.lit(1.0))
    est = F.exp(F.col("y_hat") + F.col("se") * m + F.col("se") * F.col("se") * v / 2)
    return days.select(*daily_est.columns, F.when(on_day, F.exp("_y")).otherwise(est).alias("gen_conc"))


def estimate_errors(daily_est: DataFrame, samples: DataFrame, estimate: str) -> DataFrame:
    """Error and flux-bias statistics per site on the sample days.

    Log-space R squared of concentration and of flux, RMSE of the log residuals and its percent
    form, and the flux bias relative to the observed and to the estimated sum. ``estimate`` names the
    column that is judged; one that already holds the samples, as after ``residual_bridge``, has no error.
    """
    met = daily_est.join(samples.withColumnRenamed("sample_dt", "date"), [SITE, "date"]).where(
        (F.col("result_va") > 0) & (F.col(estimate) > 0)
    )
    obs, res = F.ln("result_va"), F.ln("result_va") - F.ln(estimate)
    flux = F.when(F.col("q") > 0, obs + F.ln("q"))
    est_flux, obs_flux = F.sum(F.col(estimate) * F.col("q")), F.sum(F.col("result_va") * F.col("q"))
    rmse = F.sqrt(F.avg(res * res))
    stats = met.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.avg(res * res), F.var_pop(obs))).alias("r2_log_conc"),
        (1 - F.try_divide(F.avg(F.when(F.col("q") > 0, res * res)), F.var_pop(flux))).alias("r2_log_flux"),
        rmse.alias("rmse_log"),
        (100 * F.sqrt(F.exp(F.avg(res * res)) - 1)).alias("sep_percent"),
        F.try_divide(est_flux - obs_flux, obs_flux).alias("flux_bias"),
        F.try_divide(est_flux - obs_flux, est_flux).alias("flux_bias_of_estimate"),
    )
    return stats
