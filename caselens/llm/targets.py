"""Sampling to given category proportions (problem 1).

Inclusion probabilities are calibrated: weights start at the plan's fraction and are tilted by exp(x'lambda),
x the categories an item holds, until the expected counts equal the targets. The dual is solved by damped Newton
steps; each step's category moments are aggregated by Spark over the cells of items that hold the same
categories. A plan may name several fields: an item is one unit with the categories of all of them, and each field
has targets of its own. The sample is drawn with these probabilities by the pivotal method, first within blocks of a cell,
then among what the blocks leave over, then among cells, so every cell's count is its expectation rounded up or down.

What can't be met is found by a second calibration of the same kind, which asks for at least what each category
needs: categories whose expected count stays below it are the gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import checkpointed, local_frame

#: Plan rows are sent to the driver and broadcast; a larger table is refused.
MAX_PLAN_ROWS = 100_000
#: Categories of one plan: the moments of a step are a matrix of so many rows and columns on the driver.
MAX_CATEGORIES = 2_000
#: Items of a cell that one task takes in a row.
BLOCK_ROWS = 50_000
#: Newton steps at most, and the error of an expected count, of the greatest target, at which a plan is done.
STEPS, CLOSE = 60, 1e-9


def letters_only(col):
    """A category label as compared: letters only, lower case."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}]", ""))


def held_categories(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """item, field_name, label of every label that any row of the item holds, blank and null ones left out."""
    pairs = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), letters_only(F.col(f)).alias("label")) for f in fields])).alias("x"),
    )
    return pairs.select("item", "x.*").where(F.col("label") != "")


def read_plans(plans: DataFrame) -> pd.DataFrame:
    """The plan rows with the category's index ``c`` within its plan; of repeated rows one counts."""
    cols = ["plan_id", "field_name", "category", "target_share", "min_rows", "sample_fraction"]
    whole = F.col("plan_id").isNotNull() & F.col("field_name").isNotNull() & F.col("category").isNotNull()
    out = plans.select(*cols, letters_only(F.col("category")).alias("label")).where(whole).distinct().limit(MAX_PLAN_ROWS + 1).toPandas()
    if len(out) > MAX_PLAN_ROWS:
        raise ValueError(f"a table of plans has at most {MAX_PLAN_ROWS} rows")
    key = ["plan_id", "field_name", "label"]
    out = out.sort_values([*key, "category", "target_share", "min_rows"], kind="stable").drop_duplicates(key).reset_index(drop=True)
    out["c"] = out.groupby("plan_id").cumcount()
    if len(out) and out["c"].max() >= MAX_CATEGORIES:
        raise ValueError(f"a plan has at most {MAX_CATEGORIES} categories")
    return out.fillna({"target_share": 0.0, "min_rows": 0, "sample_fraction": 0.0})


class Problem:
    """The calibration of one plan: goals by category, and the multipliers so far. ``least``: the goals are lower bounds."""

    def __init__(self, goal: np.ndarray, n: np.ndarray, start: float, least: bool):
        self.goal, self.start, self.least = goal, start, least
        self.every, self.none = (goal >= n) & (n > 0), (goal <= 0) & (not least)
        self.free = ~self.every & ~self.none & (n > 0) & (goal > 0)
        self.at, self.step, self.error, self.done = np.zeros(len(goal)), np.zeros(len(goal)), np.inf, False

    def update(self, first: np.ndarray, second: np.ndarray) -> None:
        """The next multipliers after the moments of the present ones; a step that made things worse is halved."""
        gap = np.where(self.free, self.goal - first, 0.0)
        if self.least:
            gap = np.where((gap < 0) & (self.at <= 0), 0.0, gap)  # more than asked for is no error
        error = float(np.abs(gap).max(initial=0.0))
        if error <= CLOSE * max(1.0, float(self.goal.max(initial=0.0))):
            self.error, self.done = error, True
            return
        if error > 2 * self.error and np.abs(self.step).max() > 1e-3:
            self.step = self.step / 2
            self.at = self.at - self.step
            return
        use = np.flatnonzero(self.free & (gap != 0) if self.least else self.free)
        h = second[np.ix_(use, use)]
        move = np.linalg.lstsq(h + 1e-9 * max(1e-12, np.trace(h) / max(1, len(use))) * np.eye(len(use)), gap[use], rcond=None)[0]
        step = np.zeros(len(gap))
        step[use] = np.clip(move, -2.0, 2.0)
        if self.least:
            step = np.maximum(step, -self.at)
        self.error, self.step, self.at = error, step, self.at + step


class Sampler:
    """Holds the cells of a table under the plans; ``gaps``, ``sample`` and ``report`` are the results.

    Null ids are no items. An item with labels of two of a field's categories counts for both. With ``redistribute`` the rows
    that a short category can't give are given by the others of its field in proportion; without it the sample is smaller by the
    gap. A plan without items, an empty plan table and an empty input give empty results. Extra columns are not read.
    """

    def __init__(self, df: DataFrame, plans: DataFrame, id_col: str, seed: int = 42, redistribute: bool = False):
        self.spark, self.seed, self.redistribute = df.sparkSession, seed, redistribute
        self.plans = read_plans(plans)
        fields = sorted(set(self.plans["field_name"]))
        self.total = df.where(F.col(id_col).isNotNull()).select(F.col(id_col)).distinct().count()
        schema = "plan_id long, field_name string, label string, c int"
        rows = [(int(r.plan_id), r.field_name, r.label, int(r.c)) for r in self.plans.itertuples()]
        index = local_frame(self.spark, rows, schema).groupBy("field_name", "label").agg(F.collect_list(F.struct("plan_id", "c")).alias("as"))
        held = held_categories(df, id_col, fields) if fields else local_frame(self.spark, [], "item string, field_name string, label string")
        # an item is one unit of a plan, whatever the number of its fields; the index is at most as long as the plans
        found = held.join(F.broadcast(index), ["field_name", "label"]).select("item", F.explode("as").alias("a")).select("a.plan_id", "item", "a.c")
        self.units = checkpointed(found.groupBy("plan_id", "item").agg(F.array_sort(F.collect_set("c")).alias("cell")))
        self.cells = checkpointed(self.units.groupBy("plan_id", "cell").agg(F.count("*").alias("n")))
        self._have: pd.DataFrame | None = None
        self._sample: DataFrame | None = None
        self._solved: dict[bool, dict[int, Problem]] = {}

    def available(self) -> pd.DataFrame:
        """The plan rows with ``available`` items of the category, wanted and needed counts."""
        if self._have is None:
            n = self.cells.select("plan_id", "n", F.explode("cell").alias("c")).groupBy("plan_id", "c").agg(F.sum("n").alias("available")).toPandas()
            out = self.plans.merge(n, on=["plan_id", "c"], how="left").fillna({"available": 0})
            out["available"] = out["available"].astype("int64")
            out["wanted"] = out["target_share"] * out["sample_fraction"] * self.total
            out["needed"] = np.maximum(out["wanted"], out["min_rows"])
            self._have = out
        return self._have

    def targets(self, rows: pd.DataFrame, size: float) -> np.ndarray:
        """Expected counts of a field's categories: the share of the sample, raised to the floor, at most what there is.

        Where floors push the sum over the sample's size, the other categories give way in proportion. Where a
        category falls short, the others keep their targets, or share the gap in proportion (``redistribute``).
        """
        n, floor = rows["available"].to_numpy(float), rows["min_rows"].to_numpy(float)
        want = rows["wanted"].to_numpy(float)
        fixed = want < floor
        goal = np.minimum(np.where(fixed, floor, want), n)
        for _ in range(len(goal)):
            over = goal.sum() - size
            free = ~fixed & (goal > 0)
            if over <= 1e-9 or not free.any():
                break
            goal[free] *= max(0.0, 1 - over / goal[free].sum())
            below = free & (goal < floor)
            goal[below] = np.minimum(floor, n)[below]
            fixed |= below
            if not below.any():
                break
        for _ in range(len(goal) if self.redistribute else 0):
            short = min(size, want.sum()) - goal.sum()
            free = (goal > 0) & (goal < n)
            if short <= 1e-9 or not free.any():
                break
            goal[free] = np.minimum(goal[free] * (1 + short / goal[free].sum()), n[free])
        return goal

    def solved(self, least: bool = False) -> dict[int, Problem]:
        """The calibrated problem of each plan: to the targets, or with ``least`` to at least what each category needs."""
        if least in self._solved:
            return self._solved[least]
        state: dict[int, Problem] = {}
        for plan_id, plan in self.available().groupby("plan_id"):
            d, n = max(float(plan["sample_fraction"].iloc[0]), 1e-6), plan["available"].to_numpy(float)  # nothing can be tilted from 0
            goal = np.minimum(plan["needed"].to_numpy(float), n)
            if not least:
                for _, rows in plan.reset_index(drop=True).groupby("field_name"):
                    goal[rows.index] = self.targets(rows, float(rows["sample_fraction"].iloc[0]) * self.total)
            state[int(plan_id)] = Problem(goal, n, d, least)
        for _ in range(STEPS):
            w = self._weighted(state).where(~F.col("done"))
            pairs = w.select("plan_id", F.col("n") * F.col("p"), F.col("n") * F.col("tilted"), F.explode("cell"), "cell").toDF("plan_id", "m", "h", "a", "cell")
            moments = pairs.select("plan_id", "m", "h", "a", F.explode("cell").alias("b")).groupBy("plan_id", "a", "b").agg(F.sum("m").alias("m"), F.sum("h").alias("h")).toPandas()
            got = dict(iter(moments.groupby("plan_id")))
            for plan_id, s in state.items():
                if not s.done:
                    first, second = np.zeros(len(s.goal)), np.zeros((len(s.goal), len(s.goal)))
                    if plan_id in got:
                        a, b, m, h = (got[plan_id][x].to_numpy() for x in ("a", "b", "m", "h"))
                        second[a, b] = h
                        first[a[a == b]] = m[a == b]
                    s.update(first, second)
            if all(s.done for s in state.values()):
                break
        self._solved[least] = state
        return state

    def weights(self, least: bool = False) -> DataFrame:
        """plan_id, cell, n, p: the calibrated inclusion probability of each cell."""
        return self._weighted(self.solved(least)).select("plan_id", "cell", "n", "p")

    def _weighted(self, state: dict[int, Problem]) -> DataFrame:
        rows = [(k, s.at.tolist(), [bool(x) for x in s.every], [bool(x) for x in s.none], s.start, s.done) for k, s in state.items()]
        at = local_frame(self.spark, rows, "plan_id long, at array<double>, every array<boolean>, no array<boolean>, d double, done boolean")
        tilt = F.aggregate("cell", F.lit(0.0), lambda x, c: x + F.col("at")[c])
        tilted = F.col("d") * F.exp(tilt)  # its slope also where the probability is held at 1, so that a step leads back
        p = F.when(F.exists("cell", lambda c: F.col("every")[c]), 1.0).when(F.exists("cell", lambda c: F.col("no")[c]), 0.0).otherwise(F.least(F.lit(1.0), tilted))
        return self.cells.join(F.broadcast(at), "plan_id").withColumn("tilted", tilted).withColumn("p", p)

    def _moments(self, least: bool) -> DataFrame:
        """plan_id, c, and the expected count of the category."""
        return self.weights(least).select("plan_id", F.explode("cell").alias("c"), (F.col("n") * F.col("p")).alias("e")).groupBy("plan_id", "c").agg(F.sum("e").alias("e"))

    def _plan_rows(self) -> DataFrame:
        done = self.solved()
        have = self.available().assign(converged=[done[int(p)].done for p in self.available()["plan_id"]])
        cols = ["plan_id", "field_name", "category", "c", "target_share", "min_rows", "available", "wanted", "needed", "converged"]
        rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in have[cols].itertuples(index=False)]
        return local_frame(self.spark, rows, "plan_id long, field_name string, category string, c int, target_share double, min_rows int, available long, wanted double, needed double, converged boolean")

    def _reached(self) -> DataFrame:
        """The plan rows with ``reached``, the count the second calibration expects, and whether that is what is needed."""
        out = self._plan_rows().join(self._moments(least=True).withColumnRenamed("e", "reached"), ["plan_id", "c"], "left").fillna({"reached": 0.0})
        return out.withColumn("met", F.col("reached") >= F.col("needed") - 1e-6 * F.greatest(F.lit(1.0), "needed"))

    def gaps(self) -> DataFrame:
        """plan_id, field_name, category, available, wanted, gap: what can't be met from the items there are."""
        short = self._reached().where(~F.col("met"))
        return short.select(F.col("plan_id").cast("int").alias("plan_id"), "field_name", "category", "available", F.round("wanted", 6).alias("wanted"), F.round(F.col("needed") - F.col("reached"), 6).alias("gap"))

    def sample(self) -> DataFrame:
        """plan_id, item: the drawn items, each once a plan. The same seed draws the same items whatever the partitioning."""
        return self._drawn().select(F.col("plan_id").cast("int").alias("plan_id"), "item")

    def _drawn(self) -> DataFrame:
        if self._sample is not None:
            return self._sample
        w = self.weights().withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int"))
        units = self.units.join(F.broadcast(w) if self._few_cells() else w, ["plan_id", "cell"]).where("p > 0")
        u = F.xxhash64("item", "plan_id", F.lit(self.seed))
        sure = units.where("p >= 1").select("plan_id", "item", "cell")
        level = units.where("p < 1").select("plan_id", "cell", F.pmod(u, "blocks").alias("block"), "item", "p", u.alias("u"))
        shape = "plan_id long, cell array<int>, item string, p double, u long"
        drawn = sure
        # within blocks of a cell, within cells, among the cells that share their first category, among what these leave over
        for keys in (["plan_id", "cell", "block"], ["plan_id", "cell"], ["plan_id", F.col("cell")[0].alias("of")], ["plan_id"]):
            level = level.groupBy(*keys).applyInPandas(_pivot if len(keys) > 1 else _pivot_last, shape)
            if len(keys) > 1:
                level = checkpointed(level)
            drawn = drawn.unionByName(level.where("p >= 1").select("plan_id", "item", "cell"))
            level = level.where("p < 1")
        self._sample = drawn
        return drawn

    def _few_cells(self) -> bool:
        return self.cells.limit(MAX_PLAN_ROWS + 1).count() <= MAX_PLAN_ROWS

    def report(self) -> DataFrame:
        """A row a plan row: what was wanted, what there is, the expected and the drawn count, its share of all drawn, the gap, and
        whether the plan's calibration came to its end."""
        drawn = self._drawn().select("plan_id", "item", F.explode("cell").alias("c")).groupBy("plan_id", "c").agg(F.count("*").alias("drawn"))
        size = self._drawn().groupBy("plan_id").agg(F.count("*").alias("size"))
        out = self._reached().join(self._moments(least=False).withColumnRenamed("e", "expected"), ["plan_id", "c"], "left").join(drawn, ["plan_id", "c"], "left").join(size, "plan_id", "left").fillna({"expected": 0.0, "drawn": 0})
        gap = F.when(F.col("met"), 0.0).otherwise(F.col("needed") - F.col("reached"))
        rounded = [F.round(x, 6).alias(y) for x, y in (("wanted", "wanted"), ("expected", "expected"))]
        share = F.round(F.try_divide(F.col("drawn"), F.col("size")), 6).alias("share")
        return out.select(F.col("plan_id").cast("int").alias("plan_id"), "field_name", "category", "target_share", "min_rows", "available", *rounded, "drawn", share, F.round(gap, 6).alias("gap"), "met", "converged")


def pivotal(p: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int, float]:
    """One pass of the pivotal method in the given order: who is in, who is left undecided (-1: none), with what chance."""
    taken, held, q = np.zeros(len(p), bool), -1, 0.0
    for i, x in enumerate(p.tolist()):
        if held < 0:
            held, q = i, x
        else:
            s = q + x
            if s < 1:  # one of the two drops out, the other carries the sum
                held, q = (held if coin[i] < q / s else i), s
            else:  # one of the two is in, the other carries what is over
                if coin[i] < (1 - x) / (2 - s):
                    taken[held], held = True, i
                else:
                    taken[i] = True
                q = s - 1
        if q >= 1 - 1e-9:
            taken[held], held, q = True, -1, 0.0
        elif q <= 1e-9:
            held, q = -1, 0.0
    return taken, held, q


def _coins(u: pd.Series) -> np.ndarray:
    x = u.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(__cell=[tuple(c) for c in pdf["cell"]]).sort_values(["__cell", "u", "item"], kind="stable").reset_index(drop=True)


def _pivot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Taken items with p 1, and the one left over with its chance."""
    pdf = _in_order(pdf)
    taken, held, q = pivotal(pdf["p"].to_numpy(float), _coins(pdf["u"]))
    pdf["p"] = np.where(taken, 1.0, 0.0)
    if held >= 0:
        pdf.loc[held, "p"] = q
    return pdf.loc[pdf["p"] > 0, ["plan_id", "cell", "item", "p", "u"]]


def _pivot_last(pdf: pd.DataFrame) -> pd.DataFrame:
    """Like ``_pivot``; the last one left over is decided by its own coin."""
    pdf = _in_order(pdf)
    taken, held, q = pivotal(pdf["p"].to_numpy(float), _coins(pdf["u"]))
    if held >= 0 and _coins(pdf["u"] + 1)[held] < q:
        taken[held] = True
    pdf["p"] = 1.0
    return pdf.loc[taken, ["plan_id", "cell", "item", "p", "u"]]


def sample_to_targets(df: DataFrame, plans: DataFrame, id_col: str = "id", seed: int = 42, redistribute: bool = False) -> Sampler:
    """``plans`` has plan_id, field_name, category, target_share, min_rows, sample_fraction; see ``Sampler``."""
    return Sampler(df, plans, id_col, seed, redistribute)
