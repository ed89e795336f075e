"""Contract type from title, hint and description, by a lexicon."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, no_apostrophes, normalize, phrase


@dataclass(frozen=True)
class Lexicon:
    """Patterns over folded text. `ambiguous` counts only where `markers` occur somewhere in the posting."""

    #: The default vocabulary, its ambiguous term, its markers and the words of an offer.
    apprenticeship: tuple[str, ...] = (
        r"alternances?", r"alternante?s?", r"apprentie?s?", r"apprentissages?", r"apprentice(?:ships?|s)?",
        phrase("contrat de professionnalisation"), phrase("contrat de pro"), phrase("contrat pro"),
    )
    internship: tuple[str, ...] = (r"stagiaires?", r"intern(?:ships?|s)?", r"pfe", r"projets?\s+de\s+fin\s+d\s+etudes", phrase("annee de cesure"), r"cesure")
    ambiguous: tuple[str, ...] = (r"stages?",)
    markers: tuple[str, ...] = ("de", "du", "des", "le", "la", "les", "en", "pour", "mois", phrase("au sein"))
    offer: tuple[str, ...] = (
        "contrat", "duree", "poste", "offre", "recherchons", "recrutons", "cherchons", "mission", "debut", "rentree",
        phrase("looking for"), "seeking", "position", "hiring", phrase("we are"),
    )
    window: int = 60


def pattern(alternatives: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(alternatives)})\b" if alternatives else r"(?!)"


def near_offer(lex: Lexicon, terms: tuple[str, ...], text: Column) -> Column:
    """Whether a match of the terms has a word of an offer in the characters around it. The window is cut by characters, whatever words it cuts.

    One pattern gives each match's window: behind the match it looks back by the window's width, and from there ahead over what
    stands before the match, the match and what follows. The text has so many characters more in front, which are in no word.
    """
    hit, w = pattern(terms), lex.window
    window = rf"(?s)(?={hit})(?<=(?=(.{{{w}}}{hit}.{{0,{w}}})).{{{w}}}){hit}"
    # looking back counts halves of characters beyond the first plane, so these are one of a kind here
    far = r"[\x{10000}-\x{10FFFF}]"
    plain = F.when(text.rlike(far), F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}&&[\p{L}\p{N}]]", "\u4e00"), far, "\ufffd")).otherwise(text)
    around = F.regexp_extract_all(F.concat(F.lit("\0" * w), plain), F.lit(window), 1 + re.compile(hit).groups)
    return text.rlike(hit) & F.exists(around, lambda x: x.rlike(pattern(lex.offer)))


def contract_type(lex: Lexicon = Lexicon(), exact: bool = False, windows: bool = True) -> Column:
    """Title first, then hint, then the description within the window. windows: False leaves the description out."""
    fold = lambda c: no_apostrophes(normalize(F.coalesce(F.col(c), F.lit("")), exact))
    appr = pattern(lex.apprenticeship)

    def of(p: Column) -> Column:
        title, hint, text = p["title"], p["hint"], p["text"]
        marked = F.concat_ws(" ", title, text, hint).rlike(pattern(lex.markers))

        def intern(x: Column) -> Column:
            return x.rlike(pattern(lex.internship)) | (x.rlike(pattern(lex.ambiguous)) & marked)

        out = F.when(title.rlike(appr), "apprenticeship").when(intern(title), "internship").when(hint.rlike(appr), "apprenticeship").when(intern(hint), "internship")
        if windows:
            near = lambda terms: near_offer(lex, terms, text)
            out = out.when(near(lex.apprenticeship), "apprenticeship").when(near(lex.internship) | (marked & near(lex.ambiguous)), "internship")
        return out.otherwise("other")

    # each text is folded once, whichever of the steps look at it
    return bind(F.struct(fold("title").alias("title"), fold("hint").alias("hint"), fold("description").alias("text")), of)
