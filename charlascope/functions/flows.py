"""Topic ("flow") and no-match expressions over intent names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from charlascope.functions.text import strip


def is_no_match(intent: Column) -> Column:
    return F.upper(F.coalesce(intent, F.lit(""))).startswith("NO_MATCH")


def flow_from_intent(intent: Column) -> Column:
    """Topic of a detected intent: the no-match and chit-chat families, else the part before the first underscore."""
    name = strip(F.coalesce(intent, F.lit("")))
    upper = F.upper(name)
    return (
        F.when(upper.startswith("NO_MATCH"), "NO_MATCH")
        .when(upper.startswith("CHIT_"), "CHIT")
        .otherwise(F.split_part(name, F.lit("_"), F.lit(1)))
    )


def training_flow(intent: Column) -> Column:
    """Topic of a training intent: the part before the first underscore, nothing else."""
    return F.split_part(intent, F.lit("_"), F.lit(1))
