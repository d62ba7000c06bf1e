"""Case-level functions: routing of questions, sentences of paths, tool policy, tumour fit, checks, report metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes (start label, relationships with their directions), ordered keyword rules, and synonyms.
ROUTES = {
    "GENE_TO_DRUG": ("Gene", (("HAS_VARIANT", ">"), ("IN_MOLECULAR_PROFILE", ">"), ("HAS_EVIDENCE", ">"), ("TARGETS_DRUG", ">"))),
    "GENE_TO_DISEASE": ("Gene", (("HAS_VARIANT", ">"), ("IN_MOLECULAR_PROFILE", ">"), ("HAS_EVIDENCE", ">"), ("HAS_DISEASE", ">"))),
    "GENE_TO_CDX": ("Gene", (("HAS_VARIANT", ">"), ("IN_MOLECULAR_PROFILE", ">"), ("HAS_EVIDENCE", ">"), ("TARGETS_DRUG", ">"), ("HAS_COMPANION_DIAGNOSTIC", ">"))),
    "GENE_TO_TRIALDRUG": ("Gene", (("ASSOCIATED_GENE", "<"), ("TESTS_DRUG", ">"))),
    "VARIANT_TO_DRUG": ("Variant", (("IN_MOLECULAR_PROFILE", ">"), ("HAS_EVIDENCE", ">"), ("TARGETS_DRUG", ">"))),
    "DRUG_TO_GENE_CDX": ("Drug", (("HAS_COMPANION_DIAGNOSTIC", ">"), ("DIAGNOSES_GENE", ">"))),
    "GENE_EVIDENCE_TRIAL_BRIDGE": ("Gene", ()),
}
DEFAULT_ROUTE = "GENE_TO_DRUG"
# Words by which a question speaks of variants; words of the keyword routes, in either language; formats of
# facts by start, leaf and last relationship.
VARIANT_WORDS = ("variante", "mutazione", "mutation", "variant")
COMPANION_WORDS, DETECT_WORDS, TRIAL_WORDS, EVIDENCE_WORDS, DISEASE_WORDS = ("companion", "accompagnamento"), ("rilev", "quale gene"), ("trial",), ("evidenza",), ("malatti",)
FACTS = {
    ("Variant", "Drug", "TARGETS_DRUG"): "La variante %s è collegata, tramite evidenza clinica documentata, al farmaco %s.",
    ("Gene", "Drug", "TARGETS_DRUG"): "Il gene %s è collegato, tramite evidenza clinica documentata, al farmaco %s.",
    ("Gene", "Disease", "HAS_DISEASE"): "Il gene %s presenta evidenza clinica nella malattia %s.",
    ("Gene", "Device", "HAS_COMPANION_DIAGNOSTIC"): "Il gene %s è collegato, tramite farmaco con evidenza clinica, al test diagnostico %s.",
    ("Gene", "Drug", "TESTS_DRUG"): "Il gene %s è associato a un trial clinico che testa il farmaco %s.",
    ("Drug", "Gene", "DIAGNOSES_GENE"): "Il farmaco %s ha un test diagnostico di accompagnamento che rileva il gene %s.",
}
BRIDGE_FACT = "Il farmaco %s è supportato da evidenza clinica ED è testato in un trial clinico per il gene %s."
TOOLS = ("assess_complexity", "interpret_variant", "identify_targets", "check_resistance", "match_trials", "enrich_oncokb", "finish")


def route_label(answer: Column) -> Column:
    """A router's answer as a route: its capitals and underscores, if they name one, else the default."""
    label = F.regexp_replace(F.upper(F.coalesce(answer, F.lit(""))), "[^A-Z_]", "")
    return F.when(label.isin(*ROUTES), label).otherwise(DEFAULT_ROUTE)


def routed(question: Column, rules: Sequence[tuple[Sequence[str], str]], default: str = DEFAULT_ROUTE) -> Column:
    """The route of the first rule one of whose words stands in the question."""
    low, out = F.lower(question), None
    for words, route in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, route) if out is None else out.when(hit, route)
    return out.otherwise(default)


def keyword_route(question: Column) -> Column:
    """The route that a question's words name."""
    low = F.lower(question)
    has = lambda words: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(has(COMPANION_WORDS) & F.contains(low, F.lit("gene")) & has(DETECT_WORDS), "DRUG_TO_GENE_CDX")
        .when(has(COMPANION_WORDS), "GENE_TO_CDX")
        .when(has(TRIAL_WORDS) & has(EVIDENCE_WORDS), "GENE_EVIDENCE_TRIAL_BRIDGE")
        .when(has(TRIAL_WORDS), "GENE_TO_TRIALDRUG")
        .when(has(DISEASE_WORDS), "GENE_TO_DISEASE")
        .when(has(VARIANT_WORDS), "VARIANT_TO_DRUG")
        .otherwise(DEFAULT_ROUTE)
    )


def sentence(start: Column, leaf: Column, names: Column, templates: Mapping[tuple[str, str], tuple[str, str]]) -> Column:
    """A path as a sentence: first name, infix, last name, ending by its end labels; other paths as names with arrows."""
    first, final = F.get(names, F.lit(0)), F.element_at(names, -1)
    out = None
    for (a, b), (infix, ending) in templates.items():
        text = F.concat(first, F.lit(infix), final, F.lit(ending))
        here = (start == a) & (leaf == b)
        out = F.when(here, text) if out is None else out.when(here, text)
    return out.otherwise(F.array_join(names, " -> "))


def allowed_tools(done: Column, enrich: Column, mandatory: Sequence[str]) -> Column:
    """Which tools may run next: targets and resistance after interpretation, trials after targets, the end after all mandatory ones."""
    has = lambda tool: F.array_contains(done, tool)
    read = has("interpret_variant")
    finish = read
    for tool in mandatory:
        finish = finish & has(tool)
    may = {"assess_complexity": ~has("assess_complexity"), "interpret_variant": ~read, "identify_targets": read & ~has("identify_targets"), "check_resistance": read & ~has("check_resistance"),
           "match_trials": read & has("identify_targets") & ~has("match_trials"), "enrich_oncokb": read & enrich & ~has("enrich_oncokb"), "finish": finish}
    return F.array_compact(F.array(*[F.when(may[t], F.lit(t)) for t in TOOLS]))


def tumour_fits(case: Column, known: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """One label holds the other, or a synonym of the case's label does; a generic label such as 'cancer' fits most."""
    a, b = F.lower(F.trim(case)), F.lower(F.trim(known))
    fits = F.contains(b, a) | F.contains(a, b) | (a == "solid tumor") | (b == "solid tumor")
    for label, names in synonyms.items():
        words = F.array(*map(F.lit, names))
        fits = fits | ((a == label) & F.exists(words, lambda w: F.contains(b, w) | F.contains(w, b))) | (F.contains(a, F.lit(label)) & F.exists(words, lambda w: F.contains(b, w)))
    return F.when((a == "") | (b == ""), F.lit(False)).otherwise(F.coalesce(fits, F.lit(False)))


def check_status(support: Column) -> Column:
    return F.when(support.isin("supported_as_written", "supported_after_contextualization"), "supported").when(support == "contradicted", "blocked").otherwise("insufficient")


def hallucination_rate(cited: Column, known: Column) -> Column:
    """Share of cited ids that are not known; null if none is cited."""
    return F.when(F.size(cited) > 0, F.size(F.array_except(cited, known)) / F.size(cited))


def new_treatments(level: Column, drugs: Column, present: Column) -> Column:
    """A treatment of the two strongest levels that names a drug which is not there yet."""
    return level.isin("LEVEL_1", "LEVEL_2") & ~F.forall(drugs, lambda d: F.array_contains(present, d))


def annotation(kind: Column, gene: Column, variant: Column) -> Column:
    """(endpoint and parameters) of an outside annotation by kind of alteration, as a map."""
    pair = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    return (
        F.when(kind == "fusion", pair(endpoint=F.lit("structuralVariants"), hugoSymbolA=gene, functionalType=F.lit("FUSION")))
        .when(kind == "cna", pair(endpoint=F.lit("copyNumberAlterations"), hugoSymbol=gene, copyNameAlterationType=F.when(F.contains(F.lower(variant), F.lit("amplif")), "AMPLIFICATION").otherwise("DELETION")))
        .otherwise(pair(endpoint=F.lit("mutations/byProteinChange"), hugoSymbol=gene, alteration=variant))
    )


def answer_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column, Column]:
    """(precision, recall, F1, exact) of name lists, where a name matches one that holds it or that it holds."""
    meets = lambda x, many: F.exists(many, lambda y: F.contains(x, y) | F.contains(y, x))
    hit = F.size(F.filter(predicted, lambda x: meets(x, gold)))
    found = F.size(F.filter(gold, lambda y: meets(y, predicted)))
    p, r = F.when(F.size(predicted) > 0, hit / F.size(predicted)).otherwise(0.0), F.when(F.size(gold) > 0, found / F.size(gold)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), (F.size(predicted) > 0) & (hit == F.size(predicted)) & (found == F.size(gold))


def evidence_source(pmid: Column) -> Column:
    return F.when(pmid.isNotNull(), F.concat(F.lit("PMID:"), pmid.cast("string")))


def report_metrics(report: Column, drug: Column, pmid: Column, known: Column, tier: Column) -> list[Column]:
    """drug_found, anchor_cited, n_cited, n_unknown, rate, tier_match of a report's text.

    The expected drug's parts stand between + / and commas; cited ids after "PMID"; the tier after "ESCAT".
    """
    parts = F.filter(F.transform(F.split(drug, "[+/,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    cited = F.array_distinct(F.transform(F.regexp_extract_all(report, F.lit(r"PMID:?\s*(\d+)"), F.lit(1)), lambda x: x.cast("long")))
    unknown = F.size(F.array_except(cited, known)).cast("long")
    return [
        F.forall(parts, lambda x: F.contains(F.lower(report), x)).alias("drug_found"), F.array_contains(cited, pmid).alias("anchor_cited"), F.size(cited).cast("long").alias("n_cited"),
        unknown.alias("n_unknown"), F.when(F.size(cited) > 0, unknown / F.size(cited)).otherwise(0.0).alias("rate"), (F.regexp_extract(report, r"ESCAT\s+([IVX]+[ABC]?)", 1) == tier).alias("tier_match"),
    ]
