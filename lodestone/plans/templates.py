"""The named query templates, as path patterns with parameters. NULLs sort last; every ordered limit has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import acquired_resistance
from lodestone.plans.graph import Graph, Path, top

# The strong levels, and the strongest.
LEVELS = ("1-URGENT", "2-HIGH")
STRONGEST = ("1-URGENT",)
SENSITIVE, RESISTANT = "A", "R"


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Some keyword occurs in the text, case put aside; the empty keyword occurs in every text that is not null."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))


def any_condition(lists: Sequence[Column], keywords: Sequence[str]) -> Column:
    """Some keyword occurs in an element of one of the lists."""
    found = [F.exists(values, lambda v: any_keyword(v, keywords)) for values in lists]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def dashless(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("-"), F.lit(" ")))


def joined(column: str) -> Column:
    """Distinct non-null values, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def levels(names: Sequence[str]) -> str:
    return "level IN ({})".format(", ".join(f"'{x}'" for x in names))


def point(g: Graph, gene: str, variant: str | None, keywords: Sequence[str], names: Sequence[str] = LEVELS) -> Path:
    """Gene -> Variant -> MolecularProfile -> Evidence of strong level whose disease has a keyword."""
    path = g.match("g", "Gene", F.col("symbol") == gene).hop("g", "HAS_VARIANT", "v", where=None if variant is None else F.col("name") == variant)
    path = path.hop("v", "IN_MOLECULAR_PROFILE", "mp", where=any_keyword(F.col("disease"), keywords))
    return path.hop("mp", "HAS_EVIDENCE", "e", where=levels(names))


def profile(g: Graph, name: Column, keywords: Sequence[str], names: Sequence[str] = LEVELS) -> Path:
    """MolecularProfile by a predicate on its name -> Evidence."""
    return g.match("mp", "MolecularProfile", name & any_keyword(F.col("disease"), keywords)).hop("mp", "HAS_EVIDENCE", "e", where=levels(names))


def both_in_name(a: str, b: str) -> Column:
    name = F.lower("name")
    return F.contains(name, F.lit(a.lower())) & F.contains(name, F.lit(b.lower()))


def biomarker_name(name: str) -> Column:
    return dashless(F.col("name")) == dashless(F.lit(name))


# -- pre-queries: one row each ------------------------------------------------------------------------------------


def pre_point(g: Graph, gene: str, variant: str, keywords: Sequence[str]) -> DataFrame:
    drugs = point(g, gene, variant, keywords).hop("e", "TARGETS_DRUG", "d", optional=True)
    counts = drugs.df.agg(F.count_distinct("e__id").alias("n_evidence"), joined("d__rel__significance").alias("significances"))
    trials = g.match("t", "ClinicalTrial", any_condition([F.col("conditions")], keywords)).hop("t", "ASSOCIATED_GENE", "g", where=F.col("symbol") == gene)
    return counts.crossJoin(trials.df.agg(F.count_distinct("t__nct_id").alias("n_trials")))  # one row by one row


def pre_profile(path: Path) -> DataFrame:
    drugs = path.hop("e", "TARGETS_DRUG", "d", optional=True)
    return drugs.df.agg(F.count_distinct("e__id").alias("n_evidence"), joined("d__rel__significance").alias("significances"), F.lit(0).cast("long").alias("n_trials"))


# -- evidence of a variant ----------------------------------------------------------------------------------------


def variant_evidence(path: Path, limit: int = 15, by_length: bool = True) -> DataFrame:
    """Cited evidence with the therapies that it names."""
    cited = path.hop("e", "CITED_IN", "p").hop("e", "TARGETS_DRUG", "d", optional=True)
    keys = {"evidence_level": "e__level", "disease": "mp__disease", "evidence_statement": "e__statement", "pmid": "p__pmid", "citation_text": "p__citation", "molecular_profile": "mp__name", "evidence_id": "e__id"}
    rows = cited.df.groupBy(*[F.col(v).alias(k) for k, v in keys.items()]).agg(joined("d__name").alias("therapies"))
    order = [F.col("evidence_level").asc_nulls_last()] + ([F.length("molecular_profile").asc_nulls_last()] if by_length else [])
    return top(rows, limit, *order)


# -- targets ------------------------------------------------------------------------------------------------------


def targets(path: Path, by_length: bool = False) -> DataFrame:
    """Drugs with sensitivity evidence and their companion diagnostics, a row for each path."""
    found = path.hop("e", "TARGETS_DRUG", "d", rel_where=f"significance = '{SENSITIVE}'").hop("d", "HAS_COMPANION_DIAGNOSTIC", "cd", optional=True)
    return found.select(drug_name="d__name", approved="d__approved", companion_diagnostic="cd__id", cd_platform="cd__platform", evidence_level="e__level")


def trials_for(g: Graph, gene: str, keywords: Sequence[str], drugs: Sequence[str] | None, lists: Sequence[str] = ("conditions", "keywords"), limit: int = 5) -> DataFrame:
    """Trials of a gene for a condition; the tested drug is optional and, if drugs are named, one of them."""
    path = g.match("t", "ClinicalTrial", any_condition([F.col(x) for x in lists], keywords)).hop("t", "ASSOCIATED_GENE", "g", where=F.col("symbol") == gene)
    path = path.hop("t", "TESTS_DRUG", "d", optional=True, where=None if drugs is None else F.col("name").isin(*drugs))
    rows = path.select(nct_id="t__nct_id", title="t__title", phase="t__phase", status="t__status", drug_tested="d__name")
    return top(rows, limit, F.col("phase").desc_nulls_first())


def trials_once(rows: DataFrame) -> DataFrame:
    """One row for each trial, its tested drugs joined in order; rows without a trial id pass."""
    merged = rows.where("nct_id is not null").groupBy("nct_id").agg(*[F.min(c).alias(c) for c in ("title", "phase", "status")], joined("drug_tested").alias("drug_tested"))
    return merged.unionByName(rows.where("nct_id is null"))


# -- resistance ---------------------------------------------------------------------------------------------------


def resistance(path: Path, variant: str, limit: int = 5, once: bool = False) -> DataFrame:
    """Resistance evidence with publication and drug."""
    found = path.hop("e", "TARGETS_DRUG", "d", rel_where=f"significance = '{RESISTANT}'").hop("e", "CITED_IN", "p", optional=True)
    rows = found.select(variant=variant, evidence_level="e__level", disease="mp__disease", statement="e__statement", pmid="p__pmid", citation_text="p__citation", drug_name="d__name")
    rows = rows.distinct() if once else rows
    return top(rows, limit, F.col("evidence_level").asc_nulls_last(), *([F.col("variant").asc_nulls_last()] if once else []))


def exclude_drugs(g: Graph, gene: str, driver: str, variant: str, keywords: Sequence[str]) -> DataFrame:
    """One row: drugs to which the driver variant is sensitive and the given variant is not."""
    sensitive = f"significance = '{SENSITIVE}'"
    of = lambda name: point(g, gene, name, keywords).hop("e", "TARGETS_DRUG", "d", rel_where=sensitive).df.select("d__name").where("d__name is not null").distinct()
    return of(driver).join(of(variant), "d__name", "left_anti").agg(joined("d__name").alias("exclude_drugs"))


def verified_pmids(g: Graph, pmids: Sequence[int], names: Sequence[str] = LEVELS) -> DataFrame:
    """Which cited ids stand in the graph with strong evidence."""
    cited = g.match("p", "Publication", F.col("pmid").isin(*pmids)).hop("p", "CITED_IN", "e", back=True, where=levels(names))
    return cited.select(pmid="p__pmid", citation_text="p__citation").distinct()


# -- sub-graphs ---------------------------------------------------------------------------------------------------


def subgraph(path: Path, gene: str | None, variant: str | None, limit: int = 40) -> DataFrame:
    """Records for a drawing: everything optional but the evidence."""
    full = path.hop("e", "TARGETS_DRUG", "d", optional=True).hop("d", "HAS_COMPANION_DIAGNOSTIC", "cd", optional=True).hop("e", "CITED_IN", "p", optional=True)
    none = F.lit(None).cast("string")
    rows = full.select(
        gene="g__symbol" if gene else none, variant="v__name" if variant else none, mp_id="mp__id", mp_name="mp__name", evidence_id="e__id", evidence_level="e__level", significance="d__rel__significance",
        disease="mp__disease", pmid="p__pmid", citation="p__citation", drug_name="d__name", approved="d__approved", device="cd__id",
    )
    return top(rows, limit, F.col("evidence_level").asc_nulls_last())


def subgraph_nodes(records: DataFrame) -> DataFrame:
    """Typed nodes of the records, each id once; of several metadata the first in order stays."""
    kinds = [("Gene", "gene", "gene"), ("Variant", "variant", "variant"), ("MolecularProfile", "mp_name", "disease"), ("Evidence", "cast(evidence_id as string)", "evidence_level"), ("Drug", "drug_name", "cast(approved as string)"), ("Device", "device", "device"), ("Publication", "cast(pmid as string)", "citation")]
    rows = None
    for kind, label, meta in kinds:
        one = records.select(F.concat_ws(":", F.lit(kind), F.expr(label)).alias("id"), F.expr(label).alias("label"), F.lit(kind).alias("type"), F.expr(meta).alias("metadata")).where("label is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id", "label", "type").agg(F.min("metadata").alias("metadata"))


def subgraph_links(records: DataFrame) -> DataFrame:
    """Links between the nodes of the records, each once."""
    steps = [
        ("Gene", "gene", "Variant", "variant", "HAS_VARIANT"), ("Variant", "variant", "MolecularProfile", "mp_name", "IN_MOLECULAR_PROFILE"), ("MolecularProfile", "mp_name", "Evidence", "cast(evidence_id as string)", "HAS_EVIDENCE"),
        ("Evidence", "cast(evidence_id as string)", "Drug", "drug_name", "TARGETS_DRUG"), ("Evidence", "cast(evidence_id as string)", "Publication", "cast(pmid as string)", "CITED_IN"), ("Drug", "drug_name", "Device", "device", "HAS_COMPANION_DIAGNOSTIC"),
    ]
    rows = None
    for a, x, b, y, kind in steps:
        one = records.where(f"{x} is not null and {y} is not null").select(F.concat_ws(":", F.lit(a), F.expr(x)).alias("source"), F.concat_ws(":", F.lit(b), F.expr(y)).alias("target"), F.lit(kind).alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct()


def with_gene_fallback(cases: DataFrame, primary: DataFrame, by_gene: DataFrame) -> DataFrame:
    """Rows of cases (case_id, gene, variant) from primary (case_id, found, ...), and for cases that have none there from
    by_gene (gene, found, ...): acquired-resistance variants other than the case's own. `fallback` tells them apart."""
    bare = cases.join(primary, "case_id", "left_anti")
    other = ~F.lower("found").eqNullSafe(F.lower("variant")) & acquired_resistance(F.col("found"))
    rest = bare.join(by_gene, "gene").where(other).select(*primary.columns)
    return primary.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))
