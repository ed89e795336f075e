"""Choosing posting pages among a site's addresses, in layers with fallbacks, as window flags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize
from .filters import folded

#: Path markers of posting pages, of pages that are none, and slug words of early careers.
JOB_PATHS = ("/job/", "/jobs/", "/offre/", "/offres/", "/emploi/", "/poste/", "/career/", "/vacancy/")
OTHER_PATHS = ("/blog/", "/blogs/", "/news/", "/press/")
SLUG_WORDS = (
    "stage", "stagiaire", "alternance", "alternant", "apprenti", "apprentissage", "intern", "internship", "trainee",
    "graduate", "apprentice", "apprenticeship", "vie", "student", "etudiant", "werkstudent",
)


#: A path segment that is a number, and a number at a path's end.
NUMBER_IN_PATH, NUMBER_AT_END = r"/\d{3,}(?:[/?#-]|$)", r"/(\d{3,})/?$"
CUTS = 256


def global_rank(df: DataFrame, order: str, name: str = "__n") -> DataFrame:
    """Row numbers from 0 over all rows, without a window over all: numbers fall between cuts, whose counts are summed first.

    Rows of equal order are numbered among themselves in any way. Orders that are no numbers take a plain window.
    """
    if not isinstance(df.schema[order].dataType, T.NumericType):
        return df.withColumn(name, F.row_number().over(W.orderBy(order)) - 1)
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / CUTS for i in range(1, CUTS)], 1 / (4 * CUTS))))
    spot = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order).cast("double"))) if cuts else F.lit(0)
    d = df.withColumn("__spot", F.when(F.col(order).isNull(), -1).otherwise(spot))
    before, firsts = 0, []
    for r in sorted(d.groupBy("__spot").count().collect()):  # at most CUTS + 2 rows
        firsts.append(F.when(F.col("__spot") == r["__spot"], F.lit(before).cast("long")))
        before += r["count"]
    first = F.coalesce(*firsts) if firsts else F.lit(0)
    return d.withColumn(name, F.row_number().over(W.partitionBy("__spot").orderBy(order)) - 1 + first).drop("__spot")


def contains_any(x: Column, terms: list[str] | tuple[str, ...]) -> Column:
    return reduce(or_, (x.contains(t) for t in terms), F.lit(False))


def is_job_url(url: Column, allow=JOB_PATHS, deny=OTHER_PATHS) -> Column:
    low = F.lower(url)
    return ~contains_any(low, deny) & (contains_any(low, allow) | url.rlike(NUMBER_IN_PATH))


def first_of_each(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in an explicit order; rows with a null key go."""
    for i, k in enumerate(key):
        df = df.withColumn(f"__k{i}", k if isinstance(k, Column) else F.col(k))
    names = [f"__k{i}" for i in range(len(key))]
    return df.dropna(subset=names).withColumn("__n", F.row_number().over(W.partitionBy(*names).orderBy(*order))).where("__n = 1").drop("__n", *names)


def one_per_trailing_id(df: DataFrame, url: str = "url", order: str = "pos", group: list[str] | None = None) -> DataFrame:
    """Addresses that end in the same number are one posting in several languages; those without a number all stay."""
    number = F.regexp_extract(url, NUMBER_AT_END, 1)
    key = F.when(number != "", number).otherwise(F.concat(F.lit("u:"), F.col(order).cast("string")))
    return first_of_each(df, [*(group or []), key], [order])


def even_sample(df: DataFrame, k: int, order: str = "pos", group: list[str] | None = None) -> DataFrame:
    """k rows spread evenly over the order: places floor(i n / k); all rows if there are no more than k, or k is none."""
    if k <= 0:
        return df
    if group:
        ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1).withColumn("__all", F.count("*").over(W.partitionBy(*group)))
    else:
        ranked = global_rank(df, order).withColumn("__all", F.lit(df.count()).cast("long"))
    # place p is taken if some i has floor(i * (n / k)) = p
    i = F.ceil(F.col("__n") * F.lit(float(k)) / F.col("__all"))
    hit = (i < k) & (F.floor(i * F.col("__all") / F.lit(float(k))) == F.col("__n"))
    return ranked.where((F.col("__all") <= k) | hit).drop("__n", "__all")


def capped(df: DataFrame, cap: int, order: list, group: list[str]) -> DataFrame:
    """The first rows of each group, with overflow where the group had more."""
    d = df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).withColumn("overflow", F.count("*").over(W.partitionBy(*group)) > cap)
    return d.where(F.col("__n") <= cap).drop("__n")


def select_urls(df: DataFrame, group: list[str], terms: list[str], vocabulary=SLUG_WORDS, locations: list[str] | None = None, sample: int = 40, cap: int = 150) -> DataFrame:
    """df (group, url, pos) -> with path: which layer chose it. Terms, else vocabulary, else an even sample; then places, if any fit; then the cap."""
    d = one_per_trailing_id(df.where(is_job_url(F.col("url"))), group=group)
    fold = normalize(F.col("url"))
    g = W.partitionBy(*group)
    d = d.withColumn("__t", contains_any(fold, [folded(t) for t in terms])).withColumn("__v", contains_any(F.lower("url"), vocabulary))
    d = d.withColumn("__t_any", F.max("__t").over(g)).withColumn("__v_any", F.max("__v").over(g))
    d = d.withColumn("path", F.when(F.col("__t_any"), "search_terms").when(F.col("__v_any"), "slug_vocabulary").otherwise("sample"))
    named = d.where((F.col("path") == "search_terms") & F.col("__t") | (F.col("path") == "slug_vocabulary") & F.col("__v"))
    if locations:
        named = named.withColumn("__l", contains_any(normalize(F.col("url")), [folded(x) for x in locations])).withColumn("__l_any", F.max("__l").over(g))
        named = named.where(F.col("__l") | ~F.col("__l_any")).withColumn("path", F.when(F.col("__l_any"), F.concat("path", F.lit("+location"))).otherwise(F.col("path"))).drop("__l", "__l_any")
    spread = even_sample(d.where("path = 'sample'"), sample, group=group)
    return capped(named.unionByName(spread), cap, ["pos"], group).select(*df.columns, "path", "overflow")


def ordered_and_capped(df: DataFrame, is_slow: Column, order: str, cap: int = 10) -> DataFrame:
    """Slow entries last and at most `cap` of them; run_order counts from 1, skipped ones have none."""
    d = df.withColumn("__slow", is_slow)
    fast = d.where("NOT __slow")
    n = fast.count()
    fast = global_rank(fast, order).select(*df.columns, F.lit(False).alias("skipped"), (F.col("__n") + 1).alias("run_order"))
    slow = global_rank(d.where("__slow"), order).withColumn("skipped", F.col("__n") >= cap)
    return fast.unionByName(slow.select(*df.columns, "skipped", F.when(~F.col("skipped"), F.col("__n") + 1 + n).alias("run_order")))


def page_plan(df: DataFrame, total: str, size: int, cap: int) -> DataFrame:
    """A row per page: ceil(total / size), at most cap."""
    pages = F.least(F.lit(cap), F.ceil(F.col(total) / size)).cast("int")
    return df.where(F.col(total) > 0).withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1))).withColumn("offset", F.col("page") * size)
