"""Verdict policies over stored scores; nothing is scored again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds of the two three-label policies.
SERVER = {"supported": 0.9, "contradiction": 0.9, "conflict": 0.7, "neutral": 0.8}
BROWSER = {"supported": 0.9, "contradiction": 0.9, "conflict": 0.5, "neutral": 0.8}
# The order in which a status wins over others.
SEVERITY = ["invalid", "error", "pending", "unconfirmed", "found"]


def four_label(pred: Column, confidence: Column, margin: Column, thresholds: dict[int, float], minimum_margin: float, unresolved: Column | None = None, unsupported: int = 1) -> Column:
    """``struct(label, reason)``: class_disabled, low_confidence, low_margin in this order; missing sources forbid "unsupported"."""
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))]), pred)
    reason = F.when(limit > 1, "class_disabled").when(confidence < limit, "low_confidence").when(margin < minimum_margin, "low_margin")
    if unresolved is not None:
        reason = F.when((pred == unsupported) & unresolved, "partial_sources").otherwise(reason)
    return F.struct(F.when(reason.isNull(), pred).alias("label"), reason.alias("reason"))


def three_label(scores: DataFrame, key: list[str], t: dict[str, float] = SERVER, server: bool = True) -> DataFrame:
    """``key, status, evidence`` from passage scores ``index, entailment, neutral, contradiction``.

    The first best passage is the evidence.  Strong signals that another
    passage contradicts abstain; the server calls weak ones missing, the
    browser only where every passage is neutral.
    """
    def best(c: str) -> Column:
        return F.max(F.struct(F.col(c).alias("p"), (-F.col("index")).alias("i")))

    g = scores.groupBy(*key).agg(best("entailment").alias("e"), best("contradiction").alias("c"), best("neutral").alias("n"), F.bool_and(F.col("neutral") >= t["neutral"]).alias("neutral"))
    e, c = F.col("e.p"), F.col("c.p")
    strong, against = e >= t["supported"], c >= t["contradiction"]
    clash = (strong & (c >= t["conflict"])) | (against & (e >= t["conflict"]))
    weak = F.col("neutral") | ((e < t["conflict"]) & (c < t["conflict"])) if server else F.col("neutral")
    status = F.when(clash, "abstain").when(strong, "correct").when(against, "incorrect").when(weak, "missing").otherwise("abstain")
    place = F.when(clash | strong, -F.col("e.i")).when(against, -F.col("c.i")).when(weak, -F.col("n.i")).otherwise(F.when(e >= c, -F.col("e.i")).otherwise(-F.col("c.i")))
    return g.select(*key, status.alias("status"), place.alias("evidence"))


def certainty_levels(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Stored candidates decided anew at each certainty level."""
    every = rows.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return every.withColumn("decision", F.when(F.col("confidence") >= F.col("level"), F.col("pred").cast("string")).otherwise("abstain"))


def severity(rows: DataFrame, key: list[str], status: str = "status", order: list[str] = SEVERITY) -> DataFrame:
    """The most severe status of each key; unknown ones come last."""
    places = F.array(*map(F.lit, order))
    rank = F.coalesce(F.nullif(F.array_position(places, F.col(status)), F.lit(0)), F.lit(len(order) + 1))
    return rows.groupBy(*key).agg(F.min_by(F.col(status), rank).alias("status"))


def existence(recognised_invalid: Column, found: Column) -> Column:
    """invalid only where said so; a lookup without result is unconfirmed, never invalid."""
    return F.when(recognised_invalid, "invalid").when(found, "found").otherwise("unconfirmed")


# Names of one verdict in the four-way, three-way, status and API vocabularies.
LABEL_MAP = [
    ("supported", "entailment", "correct", "correct"),
    ("unsupported", "neutral", "missing", "unsupported"),
    ("incorrect", "contradiction", "incorrect", "incorrect"),
    ("misleading", "contradiction", "misleading", "misleading"),
]


def label_map(spark) -> DataFrame:
    return spark.createDataFrame(LABEL_MAP, "four string, three string, status string, api string")
