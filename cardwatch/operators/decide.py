"""Decision tiers, the model-free rule score, and response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.schema import (
    DISPLAY_FRAUD, DISPLAY_UNCERTAIN, ENSEMBLE, RULE_AMOUNT, RULE_HIGH, RULE_LOW, RULE_MODEL_NAME,
    RULE_THRESHOLD, TIERS_ENSEMBLE, TIERS_SINGLE,
)

STATUSES = ["Safe", "Uncertain", "Fraud"]
REJECTED = "Rejected"


def rule_score(amt: Column) -> Column:
    return F.when(amt > RULE_AMOUNT, RULE_HIGH).otherwise(RULE_LOW)


def rule_response(df: DataFrame) -> DataFrame:
    """The answer when no model is at hand."""
    return df.withColumn("fraud_probability", rule_score(F.col("amt"))).withColumns({
        "is_fraud_predicted": F.col("fraud_probability") > RULE_THRESHOLD,
        "status": F.when(F.col("fraud_probability") > RULE_THRESHOLD, "Fraud").otherwise("Safe"),
        "threshold": F.lit(RULE_THRESHOLD),
        "model_used": F.lit(RULE_MODEL_NAME),
    })


def add_tiers(df: DataFrame, compat: bool = False) -> DataFrame:
    """status, is_fraud_predicted and threshold from ``fraud_probability`` and ``model_used``.

    With ``compat`` the ensemble's fraud limit lies below its uncertain limit, so "Uncertain"
    cannot occur, and the reported threshold is the nominal one. Otherwise an ensemble score
    between the two limits is uncertain and the reported threshold is the one applied.
    """
    p, is_ensemble = F.col("fraud_probability"), F.col("model_used") == ENSEMBLE
    limit = lambda e, s: F.when(is_ensemble, e).otherwise(s)
    if compat:
        fraud = limit(TIERS_ENSEMBLE[0], TIERS_SINGLE[0])
        unsure = limit(TIERS_ENSEMBLE[1], TIERS_SINGLE[1])
        shown = limit(TIERS_ENSEMBLE[2], TIERS_SINGLE[2])
    else:
        fraud = limit(max(TIERS_ENSEMBLE[:2]), max(TIERS_SINGLE[:2]))
        unsure = limit(min(TIERS_ENSEMBLE[:2]), min(TIERS_SINGLE[:2]))
        shown = fraud
    return df.withColumns({
        "status": F.when(p >= fraud, "Fraud").when(p >= unsure, "Uncertain").otherwise("Safe"),
        "is_fraud_predicted": p >= fraud,
        "threshold": shown,
    })


def refuse(df: DataFrame) -> DataFrame:
    """The answer to rows that break the contract: no score, visibly rejected."""
    return df.withColumns({
        "fraud_probability": F.lit(None).cast("double"), "is_fraud_predicted": F.lit(None).cast("boolean"),
        "status": F.lit(REJECTED), "threshold": F.lit(None).cast("double"), "model_used": F.lit(None).cast("string"),
    })


def normalised(p: Column) -> Column:
    """A score given as a percentage becomes a share."""
    return F.when(p > 1, p / 100).otherwise(p)


def percent(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), p * 100)))


def display_status(status: Column, predicted: Column, p: Column) -> Column:
    """A known status stands; otherwise the flag, otherwise the score decides."""
    share = normalised(p)
    return (
        F.when(status.isin(STATUSES), status)
        .when(predicted, F.lit("Fraud"))
        .when(share >= DISPLAY_FRAUD, F.lit("Fraud"))
        .when(share >= DISPLAY_UNCERTAIN, F.lit("Uncertain"))
        .otherwise(F.lit("Safe"))
    )


def status_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    is_status = lambda s: F.count_if(F.col("status") == s)
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n_transactions"),
        *[is_status(s).alias(f"n_{s.lower()}") for s in STATUSES],
        F.count_if("is_fraud_predicted").alias("n_flagged"),
    )


def nested_response(scored: DataFrame, members: list[str] = ()) -> DataFrame:
    """Rows back into one response per request, in the order of the request.

    ``n_transactions`` is the number sent where rows carry it (``n_sent``); a row without a place makes an empty answer.
    """
    fields = ["fraud_probability", "is_fraud_predicted", "status", "threshold", "model_used",
              *[f"{m}_score" for m in members]]
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", *fields))
    sent = F.max("n_sent") if "n_sent" in scored.columns else F.count("*")
    return scored.groupBy("request_id").agg(
        F.sort_array(F.collect_list(entry)).alias("rows"), sent.alias("n_transactions"),
    ).select(
        "request_id", "n_transactions",
        F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("predictions"),
    )
