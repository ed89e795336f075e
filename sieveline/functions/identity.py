"""What makes two postings the same posting, or the same opening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize


def job_id(exact: bool = False) -> Column:
    """By source and external id; without one, by company, title, place and address. The company is not folded here."""
    c = F.col
    own = F.concat(c("source"), F.lit(":"), c("external_id"))
    made = F.concat(c("company"), F.lit(":"), normalize(c("title"), exact), F.lit(":"), normalize(c("location"), exact), F.lit(":"), c("url"))
    return F.sha2(F.when(F.coalesce(c("external_id"), F.lit("")) != "", own).otherwise(made), 256)


def fingerprint(exact: bool = False) -> Column:
    """By folded company, title, place and the first 600 characters of the description, cut before folding."""
    parts = [F.col("company"), F.col("title"), F.col("location"), F.substring("description", 1, 600)]
    folded = [normalize(F.coalesce(p, F.lit("")), exact) for p in parts]
    return F.sha2(F.concat(folded[0], F.lit(":"), folded[1], F.lit(":"), folded[2], F.lit(":"), folded[3]), 256)
