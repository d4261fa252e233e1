"""Two versions of keyed content: what is new, changed, gone or ambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.operators import sizing


def compare(current: DataFrame, prior: DataFrame, keys: Sequence[str], content: str, id_col: str) -> DataFrame:
    """keys, current_id, prior_id, change and reason. Keys are counted on both sides first: of a key that is unique on both
    (or gone from one) there is one row, unless the contents are equal; of any other key every row of either side is
    ambiguous, by itself, so copies of a key never multiply."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.first(id_col).alias(f"id_{name}"), F.first(content).alias(f"c_{name}"))

    both = counted(current, "now").join(counted(prior, "before"), list(keys), "full_outer")
    n_now, n_before = F.coalesce("n_now", F.lit(0)), F.coalesce("n_before", F.lit(0))
    several = (n_now > 1) | (n_before > 1)
    change = F.when(n_before == 0, "new").when(n_now == 0, "removed_candidate").when(~F.col("c_now").eqNullSafe(F.col("c_before")), "modified")
    reason = F.when(n_before == 0, "target_new_in_current_version").when(n_now == 0, "target_missing_from_current_version").otherwise("target_content_changed")
    single = both.filter(~several).select(*keys, F.col("id_now").alias("current_id"), F.col("id_before").alias("prior_id"), change.alias("change"), reason.alias("reason")).filter("change is not null")
    unclear = both.filter(several).select(*keys)
    none = F.lit(None).cast(current.schema[id_col].dataType)
    rest = [F.lit("ambiguous").alias("change"), F.lit("comparison_key_not_unique").alias("reason")]
    return sizing.together(
        single,
        current.join(unclear, list(keys), "left_semi").select(*keys, F.col(id_col).alias("current_id"), none.alias("prior_id"), *rest),
        prior.join(unclear, list(keys), "left_semi").select(*keys, none.alias("current_id"), F.col(id_col).alias("prior_id"), *rest),
    )


def versions_verdict(current: DataFrame, prior: DataFrame, company: str, year: str) -> DataFrame:
    """One row per current version (company, year): may it be compared with a prior one? completed, or not_run with the
    reason; several prior versions of a company count by their latest year."""
    before = prior.groupBy(company).agg(F.max(year).alias("_before"))
    reason = F.when(F.col("_before").isNull(), "prior_document_version_missing").when(F.col(year) != F.col("_before") + 1, "prior_document_version_not_previous_year")
    out = current.join(before, company, "left").withColumn("reason", reason)
    return out.withColumn("state", F.when(F.col("reason").isNull(), "completed").otherwise("not_run")).select(company, year, "state", "reason")
