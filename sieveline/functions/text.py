"""Text functions. Built-in expressions wherever Spark has them; a vectorised UDF only for what it lacks."""

from __future__ import annotations

import functools
import html
import html.entities
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


HANGUL = (0xAC00, 19, 21, 28)  # the first syllable; how many leads, vowels and tails there are


@functools.cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """What a compatibility decomposition without marks makes of each character: letters to letters and marks to nothing (as translate takes them), and the rest to strings."""
    one, to, none, more = [], [], [], {}
    for n in [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(n)
        if HANGUL[0] <= n < HANGUL[0] + HANGUL[1] * HANGUL[2] * HANGUL[3]:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare == c:
            continue
        if len(bare) == 1:
            one.append(c)
            to.append(bare)
        elif bare:
            more[c] = bare
        else:
            none.append(c)
    return "".join(one + none), "".join(to), more


def _jamo(c: Column) -> Column:
    """A Korean syllable as its letters, by the rule that orders them."""
    first, leads, vowels, tails = HANGUL
    at = F.ascii(c) - first
    row = lambda start, n, gap: F.split(F.lit(",".join([*([""] * gap), *(chr(start + i) for i in range(n - gap))])), ",")
    pick = lambda letters, i: F.element_at(letters, i.cast("int") + 1)
    return F.concat(pick(row(0x1100, leads, 0), F.floor(at / (vowels * tails))), pick(row(0x1161, vowels, 0), F.floor(at % (vowels * tails) / tails)), pick(row(0x11A8, tails, 1), at % tails))


def _expanded(x: Column) -> Column:
    """Characters that become several: looked up one by one, in texts that have any."""
    more = fold_tables()[2]
    syllable = (F.lit(chr(HANGUL[0])), F.lit(chr(HANGUL[0] + HANGUL[1] * HANGUL[2] * HANGUL[3] - 1)))
    table = F.from_json(F.lit(json.dumps(more)), "map<string,string>")
    # one look-up for each character tells whether there are any; a class of hundreds of ranges is much slower, so a class of
    # the few in the first blocks, and of all the rest, only spares most texts that
    first = "".join(sorted(c for c in more if c < "\u0250"))
    many = "".join([*more, *map(chr, range(HANGUL[0], HANGUL[0] + HANGUL[1] * HANGUL[2] * HANGUL[3]))])
    one = lambda c: F.when(F.octet_length(c) < 2, c).when(c.between(*syllable), _jamo(c)).otherwise(F.coalesce(F.try_element_at(table, c), c))
    return F.when(x.rlike(f"[{first}\u0250-\U0010ffff]") & (F.length(F.translate(x, many, "")) != F.length(x)), F.array_join(F.transform(F.split(x, ""), one), "")).otherwise(x)


def bind(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


@F.pandas_udf(T.StringType())
def fold_udf(s: pd.Series) -> pd.Series:
    def fold(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return " ".join(t.lower().split())

    return s.map(fold, na_action="ignore")


def normalize(x: Column, exact: bool = False) -> Column:
    """Fold accents, compatibility forms and case of any script, collapse white space. exact: the same through Python, as a check."""
    if exact:
        return fold_udf(x)
    pairs = fold_tables()
    return squeeze(F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(_expanded(x), pairs[0], pairs[1]))))


def no_apostrophes(x: Column) -> Column:
    return F.regexp_replace(x, "[’']", " ")


def phrase(words: str) -> str:
    """A pattern for a phrase, whatever white space stands between its words."""
    return r"\s+".join(re.escape(w) for w in words.split())


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: What entities may look like, and the longest name.
ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@functools.cache
def entity_tables() -> tuple[str, str, str, str]:
    """Names with a semicolon, and those that may lack it, with their characters, and numbers that stand for others, as JSON; a pattern of the second, longest first."""
    closed = {n: c for n, c in html.entities.html5.items() if n.endswith(";")}
    open_ = {n: c for n, c in html.entities.html5.items() if not n.endswith(";")}
    odd = {n: html.unescape(f"&#{n};") for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))]}
    odd = {str(n): c for n, c in odd.items() if c != chr(n)}
    return json.dumps(closed), json.dumps(open_), json.dumps(odd), "^(" + "|".join(sorted(open_, key=lambda n: (-len(n), n))) + ")"


def unescape_in_jvm(x: Column) -> Column:
    """As html.unescape: all named and numeric entities, also without their semicolon. Texts without & stay as they are."""
    closed, opened, odd, beginnings = entity_tables()
    look = lambda table, k: F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), k)

    def after(part: Column) -> Column:
        m = F.regexp_extract(part, ENTITY, 1)
        rest = F.substring(part, F.length(m) + 1, F.length(part))
        digits = F.regexp_replace(m, "^#[xX]?|;$", "")
        is_hex = F.lower(F.substring(m, 2, 1)) == "x"
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        n = F.when(F.length(short) > 9, F.lit(1 << 40)).when(is_hex, F.conv(short, 16, 10).cast("long")).otherwise(short.try_cast("long"))
        bad = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        number = F.coalesce(look(odd, n.cast("string")), F.when(bad, F.lit("\ufffd")).otherwise(made))
        begin = F.regexp_extract(m, beginnings, 1)
        named = F.coalesce(look(closed, m), F.when(begin != "", F.concat(look(opened, begin), F.substring(m, F.length(begin) + 1, F.length(m)))), F.concat(F.lit("&"), m))
        return F.when(m == "", F.concat(F.lit("&"), part)).when(m.startswith("#"), F.concat(number, rest)).otherwise(F.concat(named, rest))

    parts = F.split(x, "&")
    done = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), after), ""))
    return F.when(x.contains("&"), done).otherwise(x)


#: Tags that break lines, and tags.
BLOCK_TAG, ANY_TAG = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6])\b[^>]*>", r"<[^>]+>"


def unescape_known(x: Column, known: dict[str, str]) -> Column:
    """The entities of a table alone, written as they are there; what one gives is not read again."""
    last = "&amp;"
    for entity in sorted(known, key=lambda k: k == last):
        x = F.replace(x, F.lit(entity), F.lit(known[entity]))
    return x


def strip_html(x: Column, exact: bool = False, known: dict[str, str] | None = None) -> Column:
    """Block tags break lines, other tags go, then entities are unescaped; lines are squeezed and empty ones go.

    exact: entities through Python, as a check. known: the only entities that count, with their characters; by default all of
    HTML do, also those that it allows without their semicolon.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), BLOCK_TAG, "\n"), ANY_TAG, "")
    t = unescape_known(t, known) if known is not None else unescape(t) if exact else unescape_in_jvm(t)
    lines = F.transform(F.split(t, r"\R|[\x1c-\x1e]"), lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def truncate(x: Column, limit: int) -> Column:
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x)


def clean_description(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"\n{2,}", "\n")


def when_reported(x: Column) -> Column:
    """ISO-8601 or mail-style dates as a timestamp; null where neither fits."""
    bare = F.regexp_replace(x, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(x)] + [F.try_to_timestamp(bare, F.lit(f"d MMM yyyy HH:mm:ss {z}")) for z in ("X", "Z", "z")]
    return F.coalesce(*tries)


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bare_host(x: Column) -> Column:
    return F.regexp_replace(url_host(x), r"^www\.", "")


def url_path(x: Column) -> Column:
    return F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from a page."""
    from urllib.parse import urljoin

    def one(b, u):
        try:
            return urljoin(b or "", u or "")
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link, strict=True)], dtype=object)


def city_from_slug(url: Column) -> Column:
    parts = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    return F.when(F.size(parts) >= 2, F.split(F.try_url_decode(F.try_element_at(parts, F.lit(-2))), "-")[0]).otherwise("")


def drop_location_suffix(title: Column, location: Column) -> Column:
    suffix = F.concat(F.lit(" ("), location, F.lit(")"))
    cut = F.substring(title, F.lit(1), F.length(title) - F.length(suffix))
    return F.when((F.length(location) > 0) & title.endswith(suffix), cut).otherwise(title)


def page_title(page: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?i)\s*Job Details\s*\|.*$", ""))


def slug_variants(name: Column, extra: Column | None = None) -> Column:
    """Likely board names: extras first, then without spaces, with hyphens, letters and digits only; distinct, in this order."""
    folded = F.regexp_replace(normalize(name), r"[^\x00-\x7F]", "")
    made = F.array(F.replace(folded, F.lit(" "), F.lit("")), F.replace(folded, F.lit(" "), F.lit("-")), F.regexp_replace(folded, "[^a-z0-9]", ""))
    return F.filter(F.array_distinct(F.concat(extra, made) if extra is not None else made), lambda s: s != "")


def site_url(x: Column) -> Column:
    return F.when(x.rlike("(?i)^https?://"), x).otherwise(F.concat(F.lit("https://"), x))


def name_from_host(x: Column) -> Column:
    return F.initcap(F.regexp_replace(F.split(bare_host(site_url(x)), r"\.")[0], "[-_]", " "))


def vendor_domain(host: Column) -> Column:
    return F.regexp_replace(host, r"^(careers|jobs|talents?)\.", "")


def retry_after(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.retry_after").try_cast("double"), F.lit(1.0))
