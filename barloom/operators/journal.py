"""Decision journal on append-only tables: versions, outcomes, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .outcomes import simulate


class JournalError(ValueError):
    """An amendment without a reason, or an outcome with an unknown exit."""


def digest(*cols) -> Column:
    """Sixteen hex characters over the named fields as JSON in name order, so no text can pass for two fields."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256), 1, 16)


def latest_versions(decisions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Newest amendment of every decision, one partial aggregation."""
    rest = [c for c in decisions.columns if c != key]
    return (decisions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"),
                                       F.count(F.lit(1)).alias("versions")).select(key, "r.*", "versions"))


def amend(decisions: DataFrame, changes: DataFrame, key: str, reason: str = "reason") -> DataFrame:
    """Append a next version for each change, linked to what it replaces.

    Existing rows are never touched. A change without a reason fails the write.
    """
    head = latest_versions(decisions, key).select(key, F.col("version").alias("__v"), F.col("digest").alias("replaces"))
    ok = F.assert_true(F.length(F.trim(F.coalesce(F.col(reason), F.lit("")))) > 0, F.lit("an amendment needs a reason"))
    new = (changes.join(head, key).withColumn("__ok", ok).where(F.col("__ok").isNull())
           .withColumn("version", F.col("__v") + 1).drop("__v", "__ok"))
    return decisions.unionByName(new, allowMissingColumns=True)


def outcome_values(price="exit_price", entry="entry", stop="stop", qty="qty") -> dict[str, Column]:
    """P&L and R of a close, R from the levels originally planned."""
    move = F.col(price) - F.col(entry)
    risk = F.abs(F.col(entry) - F.col(stop))
    return {"pnl": F.when(F.col(qty) != 0, move * F.col(qty)), "r_multiple": move / F.when(risk != 0, risk)}


def upsert(outcomes: DataFrame, fresh: DataFrame, keys) -> DataFrame:
    """Replace the outcomes of the fresh keys, keep the rest."""
    return outcomes.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def unrecorded(decision_trades: DataFrame, outcomes: DataFrame, keys=("decision_date", "symbol")) -> DataFrame:
    """Days having a traded symbol with no outcome row."""
    return (decision_trades.join(outcomes.select(*keys), list(keys), "left_anti")
            .groupBy(keys[0]).agg(F.count(F.lit(1)).alias("missing")))


def open_positions(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") != "closed")


def settle(decision_trades: DataFrame, outcomes: DataFrame, bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Barrier outcome of each recorded trade that has none yet."""
    due = decision_trades.join(outcomes.where("status = 'closed'").select("sid"), "sid", "left_anti")
    return simulate(due, bars, horizon)


def reconstruction_lag(as_of="as_of", recorded="recorded_at") -> Column:
    """Days between the decision date and the local date it was written."""
    return F.datediff(F.to_date(F.from_utc_timestamp(F.col(recorded), "Asia/Kolkata")), F.col(as_of))
