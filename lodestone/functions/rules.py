"""Deterministic rules about evidence: applicability, regimens, support, dossier sections, matches and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and verdicts.
LINES = ("first_line", "later_line", "post_progression", "adjuvant", "unknown")
SETTINGS = ("resected", "locally_advanced", "metastatic", "recurrent", "adjuvant", "unknown")
PRIORS = ("treatment_naive", "previously_treated", "specific_therapy", "unknown")
ADVANCED = ("metastatic", "locally_advanced", "recurrent")
SAME_TUMOUR_TIER = {"A": "I-A", "B": "I-B", "C": "II-A", "D": "II-B"}
OTHER_TUMOUR_TIER = {"A": "II-A", "B": "II-B"}
NO_TIER = "undetermined"


def category(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value trimmed and in lower case if it is allowed, else 'unknown'."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin(*allowed), text).otherwise("unknown")


def declared(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def patient_line(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text == "first-line", "first_line").when(text.isin("second-line", "later-line", "post-progression"), "later_line").otherwise("unknown")


def patient_setting(value: Column) -> Column:
    return F.when(declared(value), F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_"))).otherwise("unknown")


def conflicts(line: Column, setting: Column, prior: Column, case_line: Column, case_setting: Column) -> tuple[Column, Column]:
    """(line conflict, setting conflict) between a source's categories and what the case declares."""
    mine, where = patient_line(case_line), patient_setting(case_setting)
    by_line = ((mine == "first_line") & line.isin("later_line", "post_progression")) | ((mine == "later_line") & (line == "first_line") & (prior == "treatment_naive"))
    by_setting = ((where == "resected") & setting.isin(*ADVANCED)) | ((setting == "resected") & where.isin(*ADVANCED))
    return by_line, by_setting


def missing(line: Column, setting: Column, prior: Column, case_setting: Column, case_stage: Column, case_prior: Column) -> Column:
    """What keeps a source from being judged, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(line == "unknown", "source line"), F.when(setting == "unknown", "source setting"), F.when(prior == "unknown", "source prior therapy"),
            F.when((setting != "unknown") & ~declared(case_setting), "case setting"), F.when(setting.isin("metastatic", "locally_advanced") & ~declared(case_stage), "case stage"),
            F.when((prior != "unknown") & ~declared(case_prior), "case prior therapies"),
        )
    )


def applicability(conflict: tuple[Column, Column], lacking: Column) -> Column:
    return F.when(conflict[0] | conflict[1], "not_compatible").when(F.size(lacking) > 0, "indeterminate").otherwise("compatible")


def validated(verdict: Column, forced: Column) -> Column:
    """An outside verdict under the rules: a conflict or gap decides; an exclusion without a conflict is only open."""
    own = F.when(verdict.isin("compatible", "indeterminate", "not_compatible"), verdict).otherwise("indeterminate")
    return F.when(forced != "compatible", forced).when(own == "not_compatible", "indeterminate").otherwise(own)


def arm_match(claim: Column, arms: Column) -> Column:
    """How a claim's components meet the arms (array of arrays of names), each arm by itself."""
    known = F.filter(arms, lambda a: F.size(a) > 0)
    same = lambda a: (F.size(F.array_except(a, claim)) == 0) & (F.size(F.array_except(claim, a)) == 0)
    return (
        F.when(arms.isNull() | (F.size(known) == 0), "unknown")
        .when((F.size(claim) > 0) & F.exists(known, same), "exact")
        .when(F.exists(known, lambda a: F.size(F.array_intersect(a, claim)) > 0), "partial")
        .otherwise("no_match")
    )


def support_of_check(status: Column) -> Column:
    return F.when(status == "supported", "supported_as_written").when(status == "blocked", "contradicted").otherwise("uncertain")


def documentary_support(status: Column, derived: Column) -> Column:
    """supported splits by whether a contextualised claim was derived."""
    return F.when(status == "supported", F.when(derived, "supported_after_contextualization").otherwise("supported_as_written")).when(status == "contradicted", "contradicted").otherwise("uncertain")


def section(support: Column, fits: Column) -> Column:
    """The one dossier section of an item."""
    return (
        F.when(support == "contradicted", "excluded").when(support == "uncertain", "review")
        .when(fits == "not_compatible", "supported_not_compatible").when(fits == "indeterminate", "supported_indeterminate").otherwise("supported_compatible")
    )


def review_flags(support: Column, fits: Column) -> tuple[Column, Column]:
    return support.isin("uncertain", "contradicted"), fits.isin("indeterminate", "not_compatible")


def gate(pmid: Column, statement: Column, citation: Column, level: Column, abstract: Column, named: Column, levels: tuple[str, ...]) -> Column:
    """The first structural check that fails, or 'passed'."""
    return (
        F.when(~F.coalesce(pmid, F.lit("")).rlike(r"^\d{7,8}$"), "invalid_pmid").when(~declared(statement) | ~declared(citation), "missing_statement")
        .when(~F.coalesce(level, F.lit("")).isin(*levels), "level_not_allowed").when(~declared(abstract), "missing_abstract").when(~named, "no_anchor").otherwise("passed")
    )


def derived_claim(claim: Column, population: Column, line: Column, setting: Column, prerequisites: Column) -> Column:
    """The claim with its source's context, or null if the source adds none."""
    part = lambda label, c: F.when(declared(c), F.concat(F.lit(f"{label}: "), F.trim(c)))
    more = F.concat_ws("; ", part("population", population), part("line", line), part("setting", setting), part("prerequisites", prerequisites))
    return F.when(more != "", F.concat(claim, F.lit(" ("), more, F.lit(")")))


def therapeutic_match(recommended: Column, expected: Column, parts_of) -> Column:
    """1 if every expected drug is recommended, 0.5 if some are, else 0; a report of over 200 characters is searched as text."""
    want, have, text = parts_of(expected), parts_of(recommended), F.lower(recommended)
    hits = F.when(F.length(recommended) > 200, F.size(F.filter(want, lambda d: F.contains(text, d)))).otherwise(F.size(F.array_intersect(want, have)))
    return F.when(F.size(want) == 0, 0.0).when(hits == F.size(want), 1.0).when(hits > 0, 0.5).otherwise(0.0)


def tier(level: Column, significance: Column, same_tumour: Column) -> Column:
    """Tier by evidence level, lowered for another tumour; none for resistance."""
    of = lambda table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), level), F.lit(NO_TIER))
    return F.when(F.contains(F.lower(F.coalesce(significance, F.lit(""))), F.lit("resistance")), NO_TIER).when(same_tumour, of(SAME_TUMOUR_TIER)).otherwise(of(OTHER_TUMOUR_TIER))


def least_complexity(complexity: Column, kind: Column, line: Column, gene: Column) -> Column:
    low = complexity == "low"
    return F.when(low & (kind == "biomarker"), "high").when(low & (line.isin("second-line", "later-line") | (gene == "EGFR")), "moderate").otherwise(complexity)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and null where the whole is zero."""
    return F.when(whole != 0, part / whole)


def scores(hit: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1), each 0 where it has no denominator."""
    p, r = F.coalesce(ratio(hit, predicted), F.lit(0.0)), F.coalesce(ratio(hit, gold), F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
