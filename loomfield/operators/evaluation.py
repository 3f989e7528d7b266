"""Precision and recall of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(rows: DataFrame, split: str, measures: dict[str, tuple[str, str]], floor: float, least: int) -> DataFrame:
    """One row per split and measure. ``measures``: name to (predicted, gold) columns. ``below_floor``: the precision of at
    least ``least`` predictions is under the floor. One pass: the measures are exploded, then aggregated."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(p).alias("p"), F.col(g).alias("g")) for k, (p, g) in measures.items()]))
    flat = rows.select(split, each.alias("m")).select(split, "m.*")
    sums = flat.groupBy(split, "metric").agg(F.count_if("p").alias("predicted"), F.count_if(F.col("p") & F.col("g")).alias("hits"), F.count_if("g").alias("gold"))
    share = lambda whole: F.col("hits") / F.nullif(F.col(whole), F.lit(0))
    return sums.select(split, "metric", "predicted", "hits", "gold", F.round(share("predicted"), 6).alias("precision"), F.round(share("gold"), 6).alias("recall"), ((F.col("predicted") >= least) & (share("predicted") < floor)).alias("below_floor"))


def load_gold(labels: DataFrame, postings: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels joined with their postings, labels without a posting, postings without a label). A gold set is whole only if the
    second is empty: ``assert_whole`` says so."""
    return labels.join(postings, key), labels.join(postings.select(key).distinct(), key, "left_anti"), postings.join(labels.select(key).distinct(), key, "left_anti")


def assert_whole(orphans: DataFrame, key: str) -> None:
    """An error that names the first orphans, if there are any."""
    if found := [r[0] for r in orphans.select(key).orderBy(key).limit(10).collect()]:
        raise ValueError(f"labels without a posting: {found}")


def contested_terms(dictionary: DataFrame) -> DataFrame:
    """(term, n_ids, first_id) of the terms of a dictionary (term, id) that more than one id claims."""
    return dictionary.groupBy("term").agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id")).where("n_ids > 1")


def bad_ids(dictionary: DataFrame) -> DataFrame:
    """Ids of a dictionary that are not lower-case words joined by dashes, dots, plus or number signs."""
    return dictionary.select("id").distinct().where(~F.col("id").rlike(r"^[a-z0-9][a-z0-9.+#-]*$"))
