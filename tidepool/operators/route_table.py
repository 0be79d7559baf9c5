"""Route optimisation over tables: how an amount is best split over pools, in three layers of swaps.

A market's layout gives every directional pool (token_in to token_out) a slot among the parallel
ones of its pair.  A layer's column is a token that enters; its rows are the slots of all tokens
that leave, as many for a token as its pair with the most pools needs.  A cell without a pool
returns nothing, unless it passes its share on: where both tokens are the same, or joined by a
bridge.  Each layer splits what it has of a token over the column's cells by the softmax of
their logits.  The first layer starts from the source, the middle one swaps everything again,
the last has the rows of the output alone.

A model's parameters are a table keyed by session, stage and cell, with the optimiser's moments
as columns.  Cells of a column that are empty, or pass on to one token, and are of one age begin
alike and get the same gradients, so they are one row that counts them: nothing of the size slots
x tokens is ever made.  Forward and reverse pass are joins of parameters with the one market
that all sessions share, and sums by (session, token); sums are partial before each exchange.

The layout only grows: a pool keeps its slot for good and takes a free one of its pair when it
is new.  A snapshot without new pools refreshes values; pools that it lacks, and disabled
ones, are masked and their logits frozen.  New pools grow the tables: a cell that was there
before keeps its logit, appended ones start at ``COLD``, and the moments start anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut, drop

#: Added to a denominator, logits at the start and of appended cells, and the optimiser's.
EPSILON, WARM, COLD = 2.0**-23, 1.0, -8.0
RATE, BETA1, BETA2, TINY = 0.1, 0.9, 0.999, 1e-8
STAGES = 3
PAIR = ["market", "token_in", "token_out"]
CELL = ["session_id", "stage", "kind", "token_in", "token_out", "slot", "born"]
NONE = -1
#: A step moves a logit by less than a third, so exponentials stay within doubles for so many.
MOST_STEPS = 2000


def grown_layout(layout: DataFrame | None, reserves: DataFrame, epoch: int) -> DataFrame:
    """market, token_in, token_out, slot, pool_id and epoch: old cells as they were, new pools in the next free slots of their pairs.

    ``reserves``: market, token_in, token_out and pool_id.  New pools of a pair come in the order of pool_id.
    """
    new = reserves.select(*PAIR, "pool_id").distinct()
    first = Window.partitionBy(*PAIR).orderBy("pool_id")
    if layout is None:
        return new.select(*PAIR, (F.row_number().over(first) - 1).cast("long").alias("slot"), "pool_id", F.lit(epoch).cast("long").alias("epoch"))
    new = new.join(layout, [*PAIR, "pool_id"], "left_anti").withColumn("place", F.row_number().over(first) - 1)
    taken = layout.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("taken"))
    placed = new.join(taken, PAIR, "left").select(*PAIR, (F.coalesce("taken", F.lit(0)) + F.col("place")).cast("long").alias("slot"), "pool_id", F.lit(epoch).cast("long").alias("epoch"))
    return layout.unionByName(placed)


def _ages(layout: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns with their age; rows with theirs; pools with the age of their cell, the younger of row and column)."""
    columns = layout.select("market", F.explode(F.array("token_in", "token_out")).alias("token_in"), "epoch").groupBy("market", "token_in").agg(F.min("epoch").alias("column_age"))
    rows = layout.groupBy("market", "token_out", "slot").agg(F.min("epoch").alias("row_age"))
    pools = layout.join(rows, ["market", "token_out", "slot"]).join(columns, ["market", "token_in"])
    return columns, rows, pools.withColumn("born", F.greatest("row_age", "column_age")).drop("row_age", "column_age")


def _counted(cells: DataFrame, keys: list[str], minus: list[DataFrame]) -> DataFrame:
    """``keys`` and n: sums of ``cells`` less those of ``minus``, where something is left."""
    parts = [cells.select(*keys, "n"), *(m.select(*keys, (-F.col("n")).alias("n")) for m in minus)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def skeleton(sessions: DataFrame, layout: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """The parameter rows of every session: ``CELL``, market, pool_id, epoch, passes and n (cells that a row stands for).

    Kinds: pool; pass, the cells without a pool that pass on from token_in to token_out; void, a column's
    other empty cells, of any token_out (``NONE``) in the first two layers.  Slots of groups are ``NONE``.
    """
    columns, rows, pools = _ages(layout)
    n = F.count(F.lit(1)).alias("n")
    rows = rows.groupBy("market", "token_out", "row_age").agg(n)
    itself = columns.select("market", "token_in", F.col("token_in").alias("token_out"))
    ways = itself if bridges is None else itself.union(bridges.select(*PAIR)).distinct()
    passes = ways.withColumn("passes", F.lit(True))
    pools = pools.join(passes, PAIR, "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    age = F.greatest("row_age", "column_age").alias("born")
    filled = pools.groupBy(*PAIR, "born").agg(n)
    passing = ways.join(columns, ["market", "token_in"]).join(rows, ["market", "token_out"]).select(*PAIR, age, "n")
    passing = _counted(passing, [*PAIR, "born"], [filled.join(ways, PAIR, "left_semi")])
    whole = columns.join(rows.groupBy("market", "row_age").agg(F.sum("n").alias("n")), "market").select("market", "token_in", age, "n")
    void = _counted(whole, ["market", "token_in", "born"], [filled, passing]).withColumn("token_out", F.lit(NONE).cast("long"))
    ends = sessions.select("market", F.col("output").alias("token_out")).distinct()
    last = rows.join(ends, ["market", "token_out"]).join(columns, "market").select(*PAIR, age, "n")
    last = _counted(last, [*PAIR, "born"], [filled.join(ends, ["market", "token_out"], "left_semi"), passing.join(ends, ["market", "token_out"], "left_semi")])

    none, no = F.lit(NONE).cast("long"), F.lit(False)
    group = lambda df, kind, passes: df.select("market", F.lit(kind).alias("kind"), "token_in", "token_out", none.alias("slot"), "born", none.alias("pool_id"), none.alias("epoch"), passes.alias("passes"), "n")
    own = pools.select("market", F.lit("pool").alias("kind"), "token_in", "token_out", "slot", "born", "pool_id", "epoch", "passes", F.lit(1).cast("long").alias("n"))
    shared = own.unionByName(group(passing, "pass", ~no))
    asked = sessions.select("session_id", "market", "source", "output")
    front = asked.join(shared.unionByName(group(void, "void", no)), "market")
    back = asked.join(shared, "market").where("token_out = output").unionByName(asked.join(group(last, "void", no), "market").where("token_out = output").withColumn("token_out", none))
    staged = front.where("token_in = source").withColumn("stage", F.lit(0)).unionByName(front.withColumn("stage", F.lit(1))).unionByName(back.withColumn("stage", F.lit(2)))
    return staged.select(*CELL, "market", "pool_id", "epoch", "passes", "n")


def _fresh(cells: DataFrame, logit: Column) -> DataFrame:
    zero = F.lit(0.0)
    return cells.withColumns({"logit": logit, "first": zero, "second": zero})


def grown_parameters(cells: DataFrame, old: DataFrame) -> DataFrame:
    """Parameters of a grown model: known cells keep their logit, a pool in a cell that was empty takes the cell's, others are ``COLD``."""
    kept = old.select(*CELL, F.col("logit").alias("kept"))
    empty = lambda kind, name: old.where(F.col("kind") == kind).select("session_id", "stage", "token_in", "token_out", "born", F.col("logit").alias(name))
    at = ["session_id", "stage", "token_in", "born"]
    rows = cells.join(kept, CELL, "left").join(empty("pass", "passed"), [*at, "token_out"], "left").join(empty("void", "void").drop("token_out"), at, "left")
    before = F.when((F.col("kind") == "pool") & F.col("passes"), F.coalesce("passed", "void")).when(F.col("kind") != "void", F.col("void"))
    return _fresh(rows, F.coalesce("kept", before, F.lit(COLD))).drop("kept", "passed", "void")


def market_values(layout: DataFrame, reserves: DataFrame) -> DataFrame:
    """x, y, fee, cap and masked of every slot: pools that the snapshot lacks have no reserves and are masked, as disabled ones are."""
    now = reserves.select(*PAIR, "pool_id", "r_in", "r_out", "fee", "cap", F.coalesce("disabled", F.lit(False)).alias("disabled"))
    zero = F.lit(0.0)
    rows = layout.join(now, [*PAIR, "pool_id"], "left")
    return rows.select(*PAIR, "slot", *(F.coalesce(a, zero).alias(b) for a, b in (("r_in", "x"), ("r_out", "y"), ("fee", "fee"), ("cap", "cap"))), F.coalesce("disabled", F.lit(True)).alias("masked"))


class RouteModel:
    """Sessions (session_id, market, source, output, amount) over one market table; parameters and optimiser state are tables.

    ``reserves``: market, token_in, token_out, pool_id, r_in, r_out, fee (what is left of an amount),
    cap and disabled.  Bridges (market, token_in, token_out) stay the same for a model's life.
    Sessions whose market has no pools at all are left out; ``failures`` names the others that can't be served.
    """

    def __init__(self, sessions: DataFrame, reserves: DataFrame, bridges: DataFrame | None = None):
        self.asked, self.bridges, self.step, self.epoch = sessions, bridges, 0, 0
        self.layout = cut(grown_layout(None, reserves, 0))
        columns = self.layout.select("market", F.explode(F.array("token_in", "token_out")).alias("source")).distinct().withColumn("has_source", F.lit(True))
        rows = self.layout.select("market", F.col("token_out").alias("output")).distinct().withColumn("has_output", F.lit(True))
        checked = sessions.join(self.layout.select("market").distinct(), "market", "left_semi").join(columns, ["market", "source"], "left").join(rows, ["market", "output"], "left")
        checked = cut(checked.withColumn("failure", F.when(F.col("has_source").isNull(), "no source column").when(F.col("has_output").isNull(), "no output row")))
        self.failures = checked.where("failure is not null").select("session_id", "failure")
        self.sessions = checked.where("failure is null").select("session_id", "market", "source", "output", "amount")
        self.values = cut(market_values(self.layout, reserves))
        self.parameters = cut(_fresh(skeleton(self.sessions, self.layout, bridges), F.lit(WARM)))

    def reconcile(self, reserves: DataFrame) -> bool:
        """Takes a new snapshot in; whether it grew the model.  Moments start anew only then."""
        layout = cut(grown_layout(self.layout, reserves, self.epoch + 1))
        old = self.values
        grew = not layout.where(F.col("epoch") > self.epoch).isEmpty()
        if grew:
            self.epoch, self.step, before = self.epoch + 1, 0, self.parameters
            self.parameters = cut(grown_parameters(skeleton(self.sessions, layout, self.bridges), before))
            drop(before, self.layout)
            self.layout = layout
        else:
            drop(layout)
        self.values = cut(market_values(self.layout, reserves))
        drop(old)
        return grew

    def slots(self) -> DataFrame:
        """market and n_slots: rows of the layout, masked ones included."""
        return self.layout.select("market", "token_out", "slot").distinct().groupBy("market").agg(F.count(F.lit(1)).alias("n_slots"))

    def _shares(self) -> DataFrame:
        """Parameters with the values of their pools and their share of the column."""
        rows = self.parameters.join(self.values, [*PAIR, "slot"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
        mass = F.when(~F.col("masked"), F.exp("logit"))
        column = ["session_id", "stage", "token_in"]
        total = rows.groupBy(*column).agg(F.sum(F.col("n") * mass).alias("mass"), F.sum("n").alias("cells"))
        share = F.when(F.col("mass").isNull(), 1 / F.col("cells")).otherwise(F.coalesce(mass / F.col("mass"), F.lit(0.0)))  # a column that is masked whole splits evenly
        return rows.join(total, column).withColumn("share", share).drop("mass", "cells")

    @staticmethod
    def _swapped(rows: DataFrame) -> DataFrame:
        """Adds amount, used and leaves of one of the cells that a row stands for; ``entering`` is what its column has."""
        amount = F.col("share") * F.col("entering")
        rows = rows.withColumn("amount", amount).withColumn("used", F.least(F.col("amount") * F.col("fee"), F.col("cap")))
        out = F.greatest(F.col("y") * (F.col("used") / (F.col("x") + F.col("used") + EPSILON)), F.lit(0.0))
        return rows.withColumn("leaves", F.when(F.col("passes"), F.col("amount")).when(F.col("kind") == "pool", out).otherwise(0.0))

    def _entering(self, shares: DataFrame) -> list[DataFrame]:
        """(session_id, token, entering) of each layer, and of what leaves the last."""
        out = [self.sessions.select("session_id", F.col("source").alias("token"), F.col("amount").alias("entering"))]
        for stage in range(STAGES):
            rows = shares.where((F.col("stage") == stage) & (F.col("kind") != "void")).join(out[-1].withColumnRenamed("token", "token_in"), ["session_id", "token_in"])
            left = self._swapped(rows).groupBy("session_id", F.col("token_out").alias("token")).agg(F.sum(F.col("n") * F.col("leaves")).alias("entering"))
            out.append(cut(left))
        return out

    def evaluate(self) -> DataFrame:
        """session_id and output: what reaches each session's output token."""
        shares = cut(self._shares())
        entering = self._entering(shares)
        out = cut(self.sessions.select("session_id").join(entering[-1].select("session_id", "entering"), "session_id", "left").select("session_id", F.coalesce("entering", F.lit(0.0)).alias("output")))
        drop(shares, *entering)
        return out

    def _trained_once(self) -> DataFrame:
        shares = cut(self._shares())
        entering = self._entering(shares)
        gain = self.sessions.select("session_id", F.col("output").alias("token"), F.lit(1.0).alias("gain"))
        after, passed = [], []
        for stage in reversed(range(STAGES)):
            rows = shares.where(F.col("stage") == stage).join(entering[stage].withColumnRenamed("token", "token_in"), ["session_id", "token_in"], "left").withColumn("entering", F.coalesce("entering", F.lit(0.0)))
            rows = rows.join(gain.withColumnRenamed("token", "token_out"), ["session_id", "token_out"], "left")
            rows = self._swapped(rows).withColumn("gain", F.coalesce("gain", F.lit(0.0)))
            below = F.col("x") + F.col("used") + EPSILON
            slope = F.when(F.col("passes"), 1.0).when((F.col("kind") == "pool") & (F.col("amount") * F.col("fee") < F.col("cap")), F.col("fee") * F.col("y") * (F.col("x") + EPSILON) / (below * below)).otherwise(0.0)
            rows = rows.withColumn("by_amount", F.col("gain") * slope)
            column = rows.groupBy("session_id", F.col("token_in").alias("token")).agg(F.sum(F.col("n") * F.col("by_amount") * F.col("share")).alias("gain"))
            gain = cut(column)
            passed.append(gain)
            rows = rows.join(gain.select("session_id", F.col("token").alias("token_in"), F.col("gain").alias("whole")), ["session_id", "token_in"])
            up = F.when(F.col("masked"), 0.0).otherwise(F.col("share") * F.col("entering") * (F.col("by_amount") - F.col("whole")))
            after.append(rows.withColumn("down", -up))
        rows = reduce(DataFrame.unionByName, after)
        step = self.step + 1
        rows = rows.withColumn("first", BETA1 * F.col("first") + (1 - BETA1) * F.col("down")).withColumn("second", BETA2 * F.col("second") + (1 - BETA2) * F.col("down") * F.col("down"))
        move = RATE * (F.col("first") / (1 - BETA1**step)) / (F.sqrt(F.col("second") / (1 - BETA2**step)) + TINY)
        out = cut(rows.withColumn("logit", F.col("logit") - move).select(*self.parameters.columns))
        drop(shares, *entering, *passed)
        return out

    def train(self, iterations: int) -> RouteModel:
        """Adam on the loss, amount less output."""
        if self.step + iterations > MOST_STEPS:
            raise ValueError(f"more than {MOST_STEPS} steps since the model grew")
        for _ in range(iterations):
            old, self.parameters = self.parameters, self._trained_once()
            self.step += 1
            drop(old)
        return self

    def flows(self) -> DataFrame:
        """session_id, stage, token_in, token_out, pool_id, amount_in, amount_out, weight, cells: every row's cells together.

        ``pool_id`` is null where cells have no pool; ``token_out`` too where they are of several tokens.  Weights
        add up to 1 at every (session, stage, token_in).
        """
        shares = cut(self._shares())
        entering = self._entering(shares)
        parts = []
        for stage in range(STAGES):
            rows = shares.where(F.col("stage") == stage).join(entering[stage].withColumnRenamed("token", "token_in"), ["session_id", "token_in"], "left")
            parts.append(self._swapped(rows.withColumn("entering", F.coalesce("entering", F.lit(0.0)))))
        rows = reduce(DataFrame.unionByName, parts)
        known = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
        times = lambda c, name: (F.col("n") * F.col(c)).alias(name)
        out = cut(rows.select("session_id", "stage", "token_in", known("token_out"), known("pool_id"), times("amount", "amount_in"), times("leaves", "amount_out"), times("share", "weight"), F.col("n").alias("cells")))
        drop(shares, *entering)
        return out


def evaluate(sessions: DataFrame, reserves: DataFrame, iterations: int, bridges: DataFrame | None = None) -> DataFrame:
    """session_id, start, trained and failure: the output at equal shares and after ``iterations``."""
    model = RouteModel(sessions, reserves, bridges)
    start = model.evaluate().withColumnRenamed("output", "start")
    trained = model.train(iterations).evaluate().withColumnRenamed("output", "trained") if iterations else start.withColumnRenamed("start", "trained")
    served = start.join(trained, "session_id").withColumn("failure", F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    return served.unionByName(model.failures.select("session_id", none.alias("start"), none.alias("trained"), "failure"))
