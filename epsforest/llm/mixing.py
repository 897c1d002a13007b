"""Mixing sources to target weights by entropy balancing.

Every document has a size (words) and a source. Targets per source follow weights, capped at a multiple of the source's
size, the excess reshared. Among all rates between 0 and ``most`` that meet the token constraints, entropy balancing takes
those that stay closest to one copy of each token in relative entropy. The constraints are the tokens of every source, and
coupled across sources the tokens' mean of each covariate: by default the mean and the mean square of the logarithm of
the document's size, so that weighting sources does not shift how long the documents are that tokens come from. Sources
are met exactly; covariates with a small penalty (``RIDGE``), so that there is a solution whatever the targets.

The convex dual has a multiplier a source and one a covariate and gives the rates as capped exponential tilts
``rate = min(most, exp(source's multiplier + covariates' multipliers * covariates))``. Newton steps solve it: each is one
aggregation over all documents to a row a source (moments and curvature), the covariates' few multipliers are solved
on the driver from sums over those rows, the sources' multipliers in a table. A step is halved while the dual does not
fall. It is an error if the steps do not converge.

Rates are rounded to whole copies: every document gets the whole part; one copy more goes by the rest of the rate, in the
order of a document's hash divided by that rest (sequential Poisson sampling), as long as the source's target is
not passed. What is still missing is filled with later documents that fit, round by round, until less than
``LEFT`` of the target is missing or nothing fits. Last, a source takes one copy more of the document that leaves it
nearest to its target, if that is nearer than without; so a target may be passed by less than was missing. The order is dealt by ranges, and prefix sums over the ranges join
them: no task orders a whole source.

Defined results: a null text has size 0 and is taken 0 times. A null source is a source of its own, last. An empty
table gives an empty result; if all sizes are 0, so are all targets. A covariate that is null counts as the mean. Rows that
repeat a doc_id are documents of their own, told apart by nothing: they share the hash and are ordered by size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsforest.operators.ranking import global_rank
from epsforest.runtime import cut

WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
RIDGE, STEPS, HALVINGS, CLOSE, LEFT = 1e-3, 60, 30, 1e-10, 1e-3
#: Decimals of multipliers and rates: far above the noise of sums in another order, so that reruns agree.
DECIMALS = 7


def words_of(text: str = "text") -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, size): water-filling with a cap of ``most`` times a source's size.

    Weights repeat in code point order of the sources. Each round reads three sums on the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(by_source.withColumn("none", F.col("source").isNull()), ["none", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, held = total * share[0] / share[1], 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        x = table.agg(F.sum(F.when(full, most * F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if x["n"] == held or not x["open"]:
            break
        held, level = x["n"], (wanted - (x["full"] or 0)) / x["open"]
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def log_sizes() -> list[Column]:
    """The default covariates: the logarithm of the size and its square."""
    x = F.log1p(F.col("size").cast("double"))
    return [x, x * x]


def standardised(sized: DataFrame, covariates: list[Column]) -> DataFrame:
    """sized with x0, x1, ..: each covariate with mean 0 and deviation 1 over the tokens; 0 if it does not vary."""
    at = sized.select("*", *(c.cast("double").alias(f"x{k}") for k, c in enumerate(covariates)))
    names = [f"x{k}" for k in range(len(covariates))]
    sums = [F.sum(F.when(F.col(n).isNotNull(), F.col("size"))).alias(f"n{n}") for n in names]
    sums += [f.alias(k + n) for n in names for k, f in (("s", F.sum(F.col("size") * F.col(n))), ("q", F.sum(F.col("size") * F.col(n) * F.col(n))))]
    r = at.agg(*sums).first() if names else None
    for n in names:
        mass = r[f"n{n}"] or 0
        mean = round(r["s" + n] / mass, DECIMALS) if mass else 0.0
        spread = round(max(0.0, r["q" + n] / mass - (r["s" + n] / mass) ** 2) ** 0.5, DECIMALS) if mass else 0.0
        at = at.withColumn(n, F.coalesce((F.col(n) - mean) / spread, F.lit(0.0)) if spread > 1e-6 else F.lit(0.0))
    return at


def _tilt(b: np.ndarray) -> Column:
    tilt = F.col("multiplier")
    for k, v in enumerate(b):
        tilt = tilt + F.col(f"x{k}") * float(v)
    return tilt


def balance(docs: DataFrame, wanted: DataFrame, k: int, most: int = MOST) -> tuple[DataFrame, np.ndarray]:
    """(source, full, multiplier) and the covariates' multipliers. docs: (source, size, x0 .. x[k-1]); wanted: (source, source_size, target).

    ``full`` sources are at their cap: all their documents have the rate ``most``, whatever the multipliers.
    """
    names, top = [f"x{i}" for i in range(k)], float(np.log(most))
    full = F.col("target") >= most * F.col("source_size")
    table = wanted.where("target > 0").select(
        "source", "target", full.alias("full"), F.when(full, 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("multiplier"), F.lit(0.0).alias("step")
    )
    table = cut(table, "dual")
    b = move = np.zeros(k)
    total = float(table.agg(F.sum("target")).first()[0] or 0)
    if not total:
        return table.select("source", "full", "multiplier"), b

    def at(part: float) -> tuple[DataFrame, dict]:
        """A row a source at ``part`` of the step: the dual, the gradient and the curvature; and their sums."""
        now = table.select(F.col("source").alias("_s"), "target", "full", (F.col("multiplier") + part * F.col("step")).alias("multiplier"))
        x = docs.join(now, docs["source"].eqNullSafe(F.col("_s"))).withColumn("tilt", _tilt(b + part * move))
        capped = F.col("full") | (F.col("tilt") >= top)
        mass = F.col("size") * F.when(capped, float(most)).otherwise(F.exp("tilt"))
        value = F.when(F.col("full"), F.col("size") * most * (F.col("tilt") - F.col("multiplier"))).when(capped, F.col("size") * most * (1 + F.col("tilt") - top)).otherwise(mass)
        x = x.withColumns({"mass": mass, "value": value, "bend": F.when(capped, 0.0).otherwise(mass)})
        sums = [F.sum("mass").alias("mass"), F.sum("value").alias("value"), F.sum("bend").alias("bend"), *(F.sum(F.col("mass") * F.col(n)).alias(f"m{n}") for n in names)]
        sums += [F.sum(F.col("bend") * F.col(n)).alias(f"b{n}") for n in names] + [F.sum(F.col("bend") * F.col(p) * F.col(q)).alias(f"c{p}{q}") for p in names for q in names]
        rows = x.groupBy("_s", "target", "full", "multiplier").agg(*sums)
        rows = cut(rows.withColumn("off", F.when(F.col("full"), 0.0).otherwise(F.col("mass") - F.col("target"))), "moments")
        own = ~F.col("full")
        bent = F.when(own & (F.col("bend") > 0), 1 / F.col("bend")).otherwise(0.0)
        take = [F.sum(F.when(own, F.col("value") - F.col("multiplier") * F.col("target")).otherwise(F.col("value"))).alias("value"), F.max(F.abs(F.col("off")) / F.col("target")).alias("worst")]
        take += [F.sum(f"m{n}").alias(f"m{n}") for n in names] + [F.sum(F.col(f"b{n}") * F.col("off") * bent).alias(f"r{n}") for n in names]
        take += [(F.sum(f"c{p}{q}") - F.sum(F.col(f"b{p}") * F.col(f"b{q}") * bent)).alias(f"c{p}{q}") for p in names for q in names]
        return rows, rows.agg(*take).first().asDict()

    rows, sums = at(0.0)
    ridge = RIDGE * total
    dual = sums["value"]
    for _ in range(STEPS):
        slope = np.array([sums[f"m{n}"] for n in names]) + ridge * b
        if sums["worst"] <= CLOSE and np.abs(slope).max(initial=0) <= CLOSE * total:
            return table.select("source", "full", "multiplier"), b
        bend = np.array([[sums[f"c{p}{q}"] for q in names] for p in names]).reshape(k, k) + ridge * np.eye(k)
        move = np.linalg.solve(bend, np.array([sums[f"r{n}"] for n in names]) - slope) if k else move
        own = F.col("off")
        for n, v in zip(names, move, strict=True):
            own = own + F.col(f"b{n}") * float(v)
        # a source whose documents are all at the cap has no curvature: one step down
        step = F.when(F.col("full"), 0.0).when(F.col("bend") > 0, -own / F.col("bend")).otherwise(-1.0)
        table = cut(rows.select(F.col("_s").alias("source"), "target", "full", "multiplier", step.alias("step")), "dual")
        part = 1.0
        for _ in range(HALVINGS):
            rows, sums = at(part)
            now = sums["value"] + ridge / 2 * float((b + part * move) @ (b + part * move))
            if now <= dual + 1e-12 * abs(dual):
                break
            part /= 2
        else:
            raise RuntimeError("entropy balancing: no step lets the dual fall")
        dual, b = now, b + part * move
        table = rows.select(F.col("_s").alias("source"), "target", "full", "multiplier", F.lit(0.0).alias("step"))
        move = np.zeros(k)
    raise RuntimeError(f"entropy balancing did not converge in {STEPS} Newton steps")


def hash_order(column: str = "doc_id") -> Column:
    """52 bits of a hash that every engine has."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")


def _prefix_fits(rows: DataFrame) -> DataFrame:
    """Adds ``fits``: rows in their order within their source up to a sum of ``room``; no task has more than a range of the order."""
    order = ["key", "doc_id", "size"]
    at = rows.repartitionByRange("source", *order).sortWithinPartitions("source", *order).withColumn("at", F.monotonically_increasing_id())
    at = cut(at.withColumn("part", F.shiftright("at", 33)), "ordered")
    sums = at.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_s"), F.col("part").alias("_b"), before.alias("before"))
    joined = at.join(sums, at["source"].eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_b")))
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("fits", F.col("before") + inside <= F.col("room"))


def _nearer(rows: DataFrame, most: int) -> DataFrame:
    """One copy more, in each source at most, of the document that comes nearest to what is missing, if it is less than twice that."""
    used = rows.groupBy("source", "target").agg(F.sum((F.col("whole") + F.col("more")) * F.col("size")).alias("used"))
    missing = used.where("target > used").select(F.col("source").alias("_p"), (F.col("target") - F.col("used")).alias("missing"))
    may = (F.col("more") == 0) & (F.col("whole") < most) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("missing"))
    last = rows.join(missing, rows["source"].eqNullSafe(F.col("_p"))).where(may)
    order = F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "key", "doc_id", "row")
    last = last.groupBy("source").agg(F.min(order).alias("m")).select(F.col("m.row").alias("_r"), F.lit(1).cast("long").alias("_more"))
    return rows.join(last, F.col("row") == F.col("_r"), "left").withColumn("more", F.coalesce("_more", "more")).drop("_r", "_more")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, covariates: list[Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of ``docs`` (doc_id, source, text).

    covariates: expressions over the columns of ``docs`` and its ``size`` in words; the default is ``log_sizes()``.
    """
    given = log_sizes() if covariates is None else covariates
    at = docs.withColumn("size", words_of()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size", *(c.alias(f"c{k}") for k, c in enumerate(given)))
    sized = cut(standardised(at, [F.col(f"c{k}") for k in range(len(given))]).drop(*(f"c{k}" for k in range(len(given)))), "sizes")
    wanted = cut(targets(sized.select("source", "size"), weights, share, most), "targets")
    multipliers, b = balance(sized.drop("doc_id"), wanted, len(given), most)
    multipliers = multipliers.select(F.col("source").alias("_m"), "full", F.round("multiplier", DECIMALS).alias("multiplier"))
    plan = wanted.join(multipliers, F.col("source").eqNullSafe(F.col("_m")), "left").drop("_m").withColumnRenamed("source", "_p")
    rate = F.when(F.col("multiplier").isNull(), 0.0).when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.round(F.exp(_tilt(np.round(b, DECIMALS))), DECIMALS)))
    rows = sized.join(plan, sized["source"].eqNullSafe(F.col("_p"))).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("rest", F.col("rate") - F.col("whole")).withColumn("more", F.lit(0).cast("long"))
    # whole-number rates come last: they are only used to fill up
    rows = rows.withColumn("key", hash_order() / F.greatest("rest", F.lit(10.0**-DECIMALS)))
    rows = cut(rows.select("doc_id", "source", "size", "source_size", "target", "rate", "whole", "more", "key", F.monotonically_increasing_id().alias("row")), "rates")
    while True:
        used = rows.groupBy("source", "target").agg(F.sum((F.col("whole") + F.col("more")) * F.col("size")).alias("used"))
        room = F.floor(F.col("target") - F.col("used") + 1e-6).cast("long")
        room = F.when(room > LEFT * F.col("target"), room).otherwise(0)
        used = cut(used.select(F.col("source").alias("_p"), room.alias("room")), "room")
        left = rows.join(used, rows["source"].eqNullSafe(F.col("_p"))).drop("_p")
        may = (F.col("more") == 0) & (F.col("whole") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("room"))
        tried = left.where(may)
        if tried.isEmpty():
            break
        tried = _prefix_fits(tried).withColumn("more", F.col("fits").cast("long")).select(*rows.columns)
        rows = cut(tried.unionByName(left.where(~may).select(*rows.columns)), "round")
    rows = _nearer(rows, most)
    copies = F.col("whole") + F.col("more")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
