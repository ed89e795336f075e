"""Catalogs, settings and seeds. Small configuration that the driver reads; nothing here touches data."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_from_host, site_url


@dataclass(frozen=True)
class Settings:
    poll_interval_minutes: int = 20
    repost_window_days: int = 180
    resurrection_window_days: int = 7
    stale_after_days: int = 90
    search_terms: list[str] = field(default_factory=list)
    poll_concurrency: int = 6
    state_dir: str = "state"

    @classmethod
    def load(cls, given: dict | None = None, env: dict[str, str] | None = None, prefix: str = "SIEVELINE_") -> Settings:
        """Given values, overlaid by environment values that are read as JSON where they can be."""
        import json

        values = dict(given or {})
        for f in fields(cls):
            if (raw := (os.environ if env is None else env).get(prefix + f.name.upper())) is not None:
                try:
                    values[f.name] = json.loads(raw)
                except ValueError:
                    values[f.name] = raw
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**values)


def read_yaml(path: str):
    """What a YAML or JSON file holds. JSON needs nothing more; YAML needs PyYAML."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and PyYAML is not installed") from e
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"malformed YAML in {path}: {e}") from e


def load_settings(path: str, env: dict[str, str] | None = None) -> Settings:
    """Settings of a file, overlaid by the environment."""
    if not os.path.exists(path):
        raise ValueError(f"no settings file {path}")
    given = read_yaml(path)
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path} must hold a mapping")
    return Settings.load(given or {}, env)


def load_catalog(spark: SparkSession, path: str, known: set[str]) -> DataFrame:
    """The catalog of a file, or of all *.yaml files of a folder in the order of their names. Each must hold a list of mappings."""
    if not os.path.exists(path):
        raise ValueError(f"no catalog {path}")
    files = [path] if os.path.isfile(path) else [os.path.join(path, n) for n in sorted(os.listdir(path)) if n.endswith(".yaml")]
    if not files:
        raise ValueError(f"no *.yaml files in {path}")
    entries: list[dict] = []
    for f in files:
        held = read_yaml(f)
        if held is not None and not (isinstance(held, list) and all(isinstance(e, dict) for e in held)):
            raise ValueError(f"{f} must hold a list of mappings")
        for e in held or []:
            if missing := {"name", "ats", "identifier"} - set(e):
                raise ValueError(f"{f}: {e} lacks {sorted(missing)}")
        entries += held or []
    return catalog(spark, entries, known)


#: The vendors whose searches take terms, and those whose addresses are narrowed by place.
SEARCHED = ("workday", "smartrecruiters", "jibe", "talentsoft", "sitemap_jsonld", "successfactors", "eightfold", "rendered")
PLACED = ("sitemap_jsonld", "rendered")


def requests(companies: DataFrame, search_terms: list[str] | None = None, locations: list[str] | None = None) -> DataFrame:
    """companies with what each source is asked for: search_terms and locations, null where its vendor takes none."""
    given = lambda xs: F.array(*map(F.lit, xs)) if xs else F.lit(None).cast("array<string>")
    return companies.withColumn("search_terms", F.when(F.col("ats").isin(*SEARCHED), given(search_terms))).withColumn("locations", F.when(F.col("ats").isin(*PLACED), given(locations)))


def catalog(spark: SparkSession, entries: list[dict], known: set[str]) -> DataFrame:
    """Company sources in their order, company_idx from 0. Unknown vendors and repeated (name, ats, identifier) are errors, disabled ones too."""
    if bad := sorted({e["ats"] for e in entries} - known):
        raise ValueError(f"unknown ats {bad}")
    seen: set[tuple] = set()
    for e in entries:
        key = (e["name"], e["ats"], e["identifier"])
        if key in seen:
            raise ValueError(f"repeated {key}")
        seen.add(key)
    rows = [(i, e["name"], e["ats"], e["identifier"], e.get("tier", "warm"), e.get("tags", [])) for i, e in enumerate(e for e in entries if e.get("enabled", True))]
    return spark.createDataFrame(rows, "company_idx int, name string, ats string, identifier string, tier string, tags array<string>")


def repeated_triples(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def seeds(lines: DataFrame) -> DataFrame:
    """Lines (value) `url` or `name,url`; # begins a comment -> (name, url)."""
    d = lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    both = F.split("v", ",", 2)
    url = site_url(F.trim(F.when(F.size(both) > 1, both[1]).otherwise(both[0])))
    return d.select(F.when(F.size(both) > 1, F.trim(both[0])).otherwise(name_from_host(url)).alias("name"), url.alias("url"))
