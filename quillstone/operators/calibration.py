"""Metrics, calibration and selective thresholds over scored rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions import numbers as N

DISABLED = 1.01


def predictions(rows: DataFrame, probabilities: str = "probs") -> DataFrame:
    """``rows`` with ``pred`` (first greatest class), ``confidence`` and ``margin``."""
    p = F.col(probabilities)
    return rows.withColumns({"pred": N.argmax(p), "confidence": F.array_max(p), "margin": N.margin(p)})


def confusion(rows: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """Counts for every pair of target and predicted class, zeros too."""
    by = by or []
    grid = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    groups = (rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()).select(*by, grid.alias("target")).select(*by, "target", grid.alias("pred"))
    counts = rows.groupBy(*by, "target", "pred").agg(F.count("*").alias("n"))
    return groups.join(counts, [*by, "target", "pred"], "left").select(*by, "target", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_metrics(rows: DataFrame, classes: int, eps: float = 1e-9, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each class from one aggregation of the confusion matrix."""
    by = by or []
    cells = confusion(rows, classes, by)
    one = cells.select(*by, F.col("target").alias("class"), (F.col("n") * (F.col("target") == F.col("pred")).cast("int")).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    two = cells.select(*by, F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    sums = one.unionByName(two).groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    precision, recall = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return sums.select(*by, "class", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(eps))).alias("f1"), "support")


def expected_calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """One row ``ece``: bins are open to the left and closed to the right; a confidence of zero is in none."""
    right = (F.col("pred") == F.col("target")).cast("double")
    binned = rows.withColumn("bin", F.ceil(F.col("confidence") * bins)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg("confidence").alias("conf"))
    return binned.agg((F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def selective(rows: DataFrame, thresholds: dict[int, float], minimum_margin: float) -> DataFrame:
    """Per class: accepted, correct, precision of a policy."""
    limit = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    ok = (F.col("confidence") >= F.try_element_at(limit, F.col("pred"))) & (F.col("margin") >= minimum_margin)
    taken = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    right = F.col("ok") & (F.col("pred") == F.col("target"))
    sums = taken.groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("total"), F.count_if("ok").alias("accepted"), F.count_if(right).alias("correct"))
    return sums.withColumn("precision", F.when(F.col("accepted") > 0, F.col("correct") / F.col("accepted")))


def threshold_candidates(rows: DataFrame, margins: list[float], z: float = 1.96) -> DataFrame:
    """For each margin, class and distinct confidence: how many rows a threshold there accepts and gets right.

    Rows of one class and confidence are summed first; sums over greater
    confidences follow from one ordered pass.
    """
    kept = rows.withColumn("min_margin", F.explode(F.array(*[F.lit(float(m)) for m in margins]))).where(F.col("margin") >= F.col("min_margin"))
    steps = kept.groupBy("min_margin", "pred", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("target")).alias("c"))
    down = Window.partitionBy("min_margin", "pred").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select("min_margin", "pred", F.col("confidence").alias("threshold"), F.sum("n").over(down).alias("accepted"), F.sum("c").over(down).alias("correct"))
    return summed.withColumns({"precision": F.col("correct") / F.col("accepted"), "bound": N.wilson_lower_bound(F.col("correct"), F.col("accepted"), z)})


def fail_closed_thresholds(rows: DataFrame, classes: int, target: float, least: int = 30, margins: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2), wilson: bool = True, slack: float = 0.0) -> DataFrame:
    """Per class the lowest threshold that meets every constraint, at the margin that accepts most; a class without one is disabled with its reason."""
    found = threshold_candidates(rows, list(margins))
    enough = F.col("accepted") >= least
    good = enough & (F.col("precision") >= target) & ((F.col("bound") >= target - slack) if wilson else F.lit(True))
    best = F.max_by(F.struct("accepted", "correct", "precision", "bound"), F.when(enough, F.struct("precision", -F.col("threshold"))))
    per = found.groupBy("min_margin", "pred").agg(F.min(F.when(good, F.struct("threshold", "accepted", "correct", "precision", "bound"))).alias("hit"), best.alias("seen"), F.max(F.when(enough, F.col("precision"))).alias("top"))
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(m)) for m in sorted(set(margins))])).alias("min_margin")).select("min_margin", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("pred"))
    every = grid.join(per.withColumn("any", F.lit(True)), ["min_margin", "pred"], "left")
    reason = F.when(F.col("hit").isNotNull(), F.lit(None)).when(F.col("any").isNull(), "no_predictions_at_margin").when(F.col("top").isNull(), "insufficient_accepted_examples").when(F.col("top") < target, "precision_target_unmet").otherwise("wilson_bound_unmet")
    total = F.sum(F.coalesce("hit.accepted", F.lit(0))).over(Window.partitionBy("min_margin"))
    ranked = every.select("min_margin", F.col("pred").alias("class"), F.coalesce("hit.threshold", F.lit(DISABLED)).alias("threshold"), F.coalesce("hit.accepted", "seen.accepted", F.lit(0)).alias("accepted"), F.coalesce("hit.correct", "seen.correct", F.lit(0)).alias("correct"), reason.alias("reason"), total.alias("total"))
    n = F.dense_rank().over(Window.orderBy(F.desc("total"), "min_margin"))  # margins x classes rows
    return ranked.withColumn("n", n).where("n = 1").drop("n", "total")


def negative_log_likelihood(rows: DataFrame, temperatures: list[float]) -> list[float]:
    """Mean loss at each temperature from ``logits, target``, in one pass."""
    costs = [F.avg(-F.log(F.element_at(N.softmax(F.col("logits"), t), F.col("target") + 1) + 1e-12)).alias(f"t{i}") for i, t in enumerate(temperatures)]
    return list(rows.agg(*costs).first())


def fit_temperature(rows: DataFrame, low: float = 0.1, high: float = 10.0, rounds: int = 6, points: int = 12) -> float:
    """The temperature of least loss: a log-spaced grid, narrowed around its best point each round."""
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        loss = negative_log_likelihood(rows, grid)
        k = loss.index(min(loss))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    return math.sqrt(low * high)


def pool_chunks(chunks: DataFrame, key: list[str], classes: list[str]) -> DataFrame:
    """Chunk probabilities to one distribution: the least for the second class, else the greatest, made to add up to one; and the deciding chunk of each class.

    Of equal chunks the first by ``index`` decides.
    """
    aggs = []
    for i, c in enumerate(classes):
        p = F.col("probs")[i]
        aggs.append((F.min(p) if i == 1 else F.max(p)).alias(f"raw_{c}"))
        aggs.append((F.min(F.struct(p.alias("p"), F.col("index").alias("i"))) if i == 1 else F.max(F.struct(p.alias("p"), (-F.col("index")).alias("i")))).alias(f"at_{c}"))
    got = chunks.groupBy(*key).agg(*aggs)
    total = sum((F.col(f"raw_{c}") for c in classes[1:]), F.col(f"raw_{classes[0]}"))
    return got.select(*key, *[(F.col(f"raw_{c}") / total).alias(c) for c in classes], *[F.abs(F.col(f"at_{c}")["i"]).cast("int").alias(f"chunk_{c}") for c in classes])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights ``n / (k * count)``."""
    counts = rows.groupBy(label).agg(F.count("*").alias("c"))
    every = Window.partitionBy(F.lit(1))  # a row for each class
    return counts.select(label, (F.sum("c").over(every) / (F.count("*").over(every) * F.col("c"))).alias("weight"))


def agreement_class(teacher: Column, label: Column, top: Column, least: float = 0.8) -> Column:
    return F.when(top < least, "unsure").when(teacher == label, "confirmed").otherwise("rejected")
