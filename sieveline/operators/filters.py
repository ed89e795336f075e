"""Configured predicates: contract type, then place, then keywords; the first that fails gives the reason."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, normalize, phrase
from . import automaton

CONTRACT_TYPES = ("internship", "apprenticeship", "other")
FIELDS = ("company", "title", "location", "description", "contract_type")


#: Terms from which on a list is looked up by an automaton and not by a pattern or an expression for each.
MANY = 64


def folded(term: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    return " ".join(t.lower().split())


def has_term(hay: Column, term: str, mode: str) -> Column:
    """hay is folded already. `substring` is loose on purpose; `word` wants word boundaries."""
    return hay.contains(folded(term)) if mode == "substring" else hay.rlike(rf"\b{phrase(folded(term))}\b")


def has_any(hay: Column, terms: list[str], mode: str) -> Column:
    if not terms:
        return F.lit(False)
    if len(terms) >= MANY:
        return F.size(terms_in(hay, terms, mode)) > 0
    if mode == "word":
        return hay.rlike(rf"\b(?:{'|'.join(phrase(folded(t)) for t in terms)})\b")
    return reduce(or_, (has_term(hay, t, mode) for t in terms))


def terms_in(hay: Column, terms: list[str], mode: str) -> Column:
    """The terms that folded text has, as they are written in the list and in its order."""
    if len(terms) >= MANY:
        return automaton.terms_in(hay, terms, [folded(t) for t in terms], mode)
    return F.array_compact(F.array(*[F.when(has_term(hay, t, mode), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


@dataclass(frozen=True)
class Locations:
    include: list[str]
    exclude: list[str] = field(default_factory=list)
    match_mode: str = "substring"
    unknown_location: str = "keep"
    by_contract_type: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        if not self.include or self.match_mode not in ("substring", "word") or self.unknown_location not in ("keep", "drop"):
            raise ValueError("locations need include terms and known modes")
        for kind, over in self.by_contract_type.items():
            if kind not in CONTRACT_TYPES or set(over) - {"include", "exclude", "match_mode", "unknown_location"}:
                raise ValueError(f"unknown override {kind}: {over}")

    def effective(self, kind: str) -> Locations:
        over = {k: v for k, v in self.by_contract_type.get(kind, {}).items() if v is not None}
        return replace(self, by_contract_type={}, **over)


@dataclass(frozen=True)
class Keywords:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    match_mode: str = "word"
    fields: list[str] = field(default_factory=lambda: ["title", "description"])
    require: str = "any"

    def __post_init__(self):
        if not self.fields or set(self.fields) - set(FIELDS) or self.require not in ("any", "all") or self.match_mode not in ("substring", "word"):
            raise ValueError("keywords need known fields and modes")


@dataclass(frozen=True)
class Filters:
    locations: Locations
    keywords: Keywords = field(default_factory=Keywords)
    contract_types: list[str] = field(default_factory=lambda: ["internship", "apprenticeship"])

    def __post_init__(self):
        if not self.contract_types or set(self.contract_types) - set(CONTRACT_TYPES):
            raise ValueError("contract types must be known, and one at least")


def location_reason(f: Locations, hay: Column) -> Column:
    """Null where the place passes."""
    inside = F.when(has_any(hay, f.exclude, f.match_mode), "location_excluded").when(~has_any(hay, f.include, f.match_mode), "location_not_included")
    unknown = F.lit(None).cast("string") if f.unknown_location == "keep" else F.lit("location_not_included")
    return F.when(hay == "", unknown).otherwise(inside)


def apply(f: Filters, exact: bool = False) -> Column:
    """struct(passed, reason, matched_keywords) of a posting. Matched keywords come in the order of the configuration."""
    place = normalize(F.coalesce(F.col("location"), F.lit("")), exact)
    k = f.keywords
    hay = normalize(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in k.fields]), exact)
    places = [f.locations, *map(f.locations.effective, f.locations.by_contract_type)]
    if max(len(t) for t in (k.include, k.exclude, *(t for p in places for t in (p.include, p.exclude)))) >= MANY:
        return _judged(f, place, hay)  # the automaton works on columns, not within functions of them
    return bind(F.struct(place.alias("place"), hay.alias("hay")), lambda x: _judged(f, x["place"], x["hay"]))


def _judged(f: Filters, place: Column, hay: Column) -> Column:
    where = location_reason(f.locations.effective(""), place)
    for kind in f.locations.by_contract_type:
        where = F.when(F.col("contract_type") == kind, location_reason(f.locations.effective(kind), place)).otherwise(where)
    k = f.keywords
    hits = terms_in(hay, k.include, k.match_mode)
    want = {"any": 1, "all": len(k.include)}[k.require] if k.include else 0
    type_bad = ~F.coalesce(F.col("contract_type").isin(f.contract_types), F.lit(False))
    shut = has_any(hay, k.exclude, k.match_mode)
    reason = F.when(type_bad, "contract_type").when(where.isNotNull(), where).when(shut, "keyword_excluded").when(F.size(hits) < want, "keyword_not_matched")
    none = F.array().cast("array<string>")
    seen = F.when(type_bad | where.isNotNull() | shut, none).otherwise(hits)
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), seen.alias("matched_keywords"))
