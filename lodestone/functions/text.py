"""Scalar functions over text and arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salt words of drug names; ordered disease rules (words looked for, keywords they stand for).
SALTS = ("HYDROCHLORIDE", "SULFATE", "TARTRATE", "CITRATE", "MALEATE", "PHOSPHATE")
ANY_TUMOUR = ("cancer", "solid", "all")
DISEASE_RULES = (
    (("lung", "nsclc", "bronchial"), ("lung", "nsclc", "bronchial")),
    (("colorectal", "crc", "colon", "rectal", "anus"), ("colorectal", "colon", "rectal", "anus")),
    (("breast",), ("breast",)),
    (("ovarian", "ovary"), ("ovarian", "ovary")),
    (("cml", "chronic myeloid"), ("myeloid", "leukemia", "cml")),
    (("aml", "acute myeloid"), ("myeloid", "leukemia", "aml")),
    (("gist", "gastrointestinal"), ("gist", "gastrointestinal stromal")),
    (("gastric", "stomach"), ("gastric", "stomach", "gastroesophageal")),
    (("melanoma",), ("melanoma",)),
    (("cholangiocarcinoma", "biliary"), ("cholangiocarcinoma", "biliary")),
    (("thyroid",), ("thyroid",)),
    (("prostate",), ("prostate",)),
)
DRIVER_WORDS = ("deletion", "insertion", "fusion", "amplification", "skipping", "exon", "duplication", "itd", "del", "ins", "mutation", "rearrangement")


def drug_key(name: Column) -> Column:
    """Upper case, salt words dropped, only A-Z and 0-9 left; null gives the empty text."""
    bare = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), rf"\b({'|'.join(SALTS)})\b", "")
    return F.regexp_replace(bare, "[^A-Z0-9]", "")


def entity_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits with more than one character."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def listed(text: Column, separator: str) -> Column:
    """A delimited text as its trimmed, non-empty parts; null and empty give the empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def disease_keywords(tumour: Column) -> Column:
    """Search words of a tumour type: the first rule that matches, else its words longer than two characters."""
    t = F.lower(tumour)
    words = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2)
    out = F.when(F.contains(t, F.lit("solid tumor")) | t.isin(*ANY_TUMOUR), F.array(F.lit("")))
    for looked_for, keywords in DISEASE_RULES:
        hit = F.lit(False)
        for w in looked_for:
            hit = hit | F.contains(t, F.lit(w))
        out = out.when(hit, F.array(*map(F.lit, keywords)))
    return out.when(F.size(words) > 0, words).otherwise(F.array(t))


def profile_keyword(kind: Column, variant: Column) -> Column:
    """The word that a molecular profile's name is searched for, by kind of alteration."""
    low = F.lower(variant)
    exon = F.regexp_extract(low, r"(?:^|\s)exon\s+(\S+)", 1)
    return (
        F.when(kind == "fusion", "fusion")
        .when(kind == "cna", F.when(F.contains(low, F.lit("amplif")), "amplif").otherwise("deletion"))
        .when(kind == "itd", "itd")
        .when(kind == "biomarker", F.trim(F.split_part(variant, F.lit("-"), F.lit(1))))
        .when(kind == "atypical", F.when(exon != "", F.concat(F.lit("exon "), exon)).otherwise(F.split_part(F.trim(variant), F.lit(" "), F.lit(1))))
        .otherwise(variant)
    )


def biomarker(name: Column) -> Column:
    return F.when(F.startswith(F.upper(name), F.lit("MSI")), "MSI High").when(F.startswith(F.upper(name), F.lit("TMB")), "TMB High").otherwise(name)


def acquired_resistance(variant: Column) -> Column:
    """A point mutation such as T790M, and no alteration of another kind."""
    v = F.trim(variant)
    return v.rlike(r"^[A-Za-z]\d{1,4}[A-Za-z*]+$") & ~F.lower(v).rlike("|".join(DRIVER_WORDS))


def generic_alteration(variant: Column, terms: Sequence[str]) -> Column:
    low = F.lower(F.trim(variant))
    return low.isin(*terms) | F.startswith(low, F.lit("exon ")) | F.trim(variant).rlike(r"^[A-Z]\d+$")


def pmids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{7,8})\b"), F.lit(1)))


def year_of(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int")


def masked_pmids(text: Column, verified: Column, mask: str = "[unverified]") -> Column:
    """Each cited id that is not verified gives way to the mask."""
    bad = F.array_except(pmids(text), verified)
    return F.aggregate(bad, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"\b"), p, F.lit(r"\b")), F.lit(mask)))


def linked_pmids(text: Column) -> Column:
    """PMID mentions as links, unless a bracket follows already."""
    return F.regexp_replace(text, r"PMID:?\s?(\d{7,8})\b(?!\s{0,4}\()", "[PMID $1](https://pubmed.ncbi.nlm.nih.gov/$1/)")


def drug_parts(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Components of a combination, in lower case, brands as the substances they name."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+and\s+|[,/&+]"), lambda x: F.trim(x)), lambda x: x != "")
    if not aliases:
        return F.array_distinct(parts)
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.element_at(known, x), x)))


def similar_names(a: Column, b: Column) -> Column:
    """Either list has a name that is part of one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def coverage(options: Column, found: Column) -> Column:
    """options: alternatives of components ('A+B/C'); COVERED if one is found whole, PARTIAL if some component is, else GAP."""
    alternatives = F.transform(F.split(F.lower(options), "/"), lambda x: F.transform(F.split(x, r"\+"), lambda y: F.trim(y)))
    has = lambda part: F.exists(found, lambda f: F.contains(f, part) | F.contains(part, f))
    return F.when(F.exists(alternatives, lambda a: F.forall(a, has)), "COVERED").when(F.exists(alternatives, lambda a: F.exists(a, has)), "PARTIAL").otherwise("GAP")


def anchors(text: Column, stop: Sequence[str]) -> Column:
    """Words that a source must name for a claim to stand on it."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9-]+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def any_anchor(found: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.exists(found, lambda a: F.contains(low, a))


def normalised(vector: Column) -> Column:
    """The vector at length 1; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def plain_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def fenced_json(text: Column) -> Column:
    """The outermost braces of a text that wraps a JSON object."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
