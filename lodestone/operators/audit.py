"""Coverage audit: do the drugs expected of a case have evidence in the graph, by which source, and for its tumour?

All cases go through each step together. Which profiles speak for a case depends on the kind of its alteration; drugs
are compared with the expected components by containment of distinct names, so that no list of a case's drugs is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.containment import contained, fitting
from lodestone.sources.tables import durable

# Fixed value: how a word of a variant begins that tells the alteration.
TELLING = r"^(?:[A-Z]\d+[A-Z]?|EX|ITD|DEL|INS|R\d+)"


def case_profiles(cases: DataFrame, variants: DataFrame, profiles: DataFrame, fusion_words: Sequence[str]) -> DataFrame:
    """(case_id, profile) of cases (case_id, kind, gene, variant, key).

    variants: (gene, variant_id, name); profiles: (variant_id, profile, name). kind "biomarker": profiles of variants whose
    name holds the key, or else profiles whose own name does. "fusion": profiles whose name holds the key and a word of
    fusions, or else all of the gene. Others: of the gene's variants those whose name holds the variant's first telling
    word, or else its first number; all if none does, or if the variant only says mutation or amplification.
    """
    upper = lambda c: F.upper(F.col(c))
    key = cases.select("case_id", "kind", upper("gene").alias("gene"), upper("variant").alias("variant"), upper("key").alias("key"))
    names = variants.select(upper("gene").alias("gene"), "variant_id", upper("name").alias("name"))
    own = profiles.select("variant_id", "profile", upper("name").alias("profile_name"))
    # By gene: the better of two words decides, for each case, which of the gene's variants stay.
    words = F.split("variant", r"\s+")
    telling = F.coalesce(F.get(F.filter(words, lambda w: w.rlike(TELLING)), F.lit(0)), F.get(words, F.lit(0)))
    number = F.when(F.size(words) > 1, F.get(F.filter(words, lambda w: w.rlike(r"^\d+$")), F.lit(0)))
    whole = F.col("variant").isin("MUTATION", "AMPLIFICATION")
    by_gene = key.where(~F.col("kind").isin("biomarker", "fusion")).withColumns({"_t": F.when(~whole, telling), "_n": F.when(~whole, number)}).join(names, "gene")
    level = F.when(F.contains("name", F.col("_t")), 2).when(F.contains("name", F.col("_n")), 1).otherwise(0)
    by_gene = durable(by_gene.select("case_id", "variant_id", level.alias("level")))
    best = by_gene.groupBy("case_id").agg(F.max("level").alias("level"))
    chosen = by_gene.join(best, ["case_id", "level"]).select("case_id", "variant_id")
    # By keyword.
    marked = key.where("kind = 'biomarker'").select("case_id", F.col("key").alias("needle"))
    in_variants = marked.join(contained(marked, names.select(F.col("name").alias("text"))), "needle").join(names.withColumnRenamed("name", "text"), "text").select("case_id", "variant_id")
    chosen = durable(chosen.union(in_variants).distinct())
    found = chosen.join(own, "variant_id").select("case_id", "profile")
    keyed = key.where("kind = 'fusion'").union(key.where("kind = 'biomarker'").join(chosen, "case_id", "left_anti")).select("case_id", "kind", F.col("key").alias("needle"))
    in_profiles = keyed.join(contained(keyed, own.select(F.col("profile_name").alias("text"))), "needle").join(own.withColumnRenamed("profile_name", "text"), "text")
    fused = F.exists(F.array(*[F.lit(w.upper()) for w in fusion_words]), lambda w: F.contains("text", w))
    in_profiles = durable(in_profiles.where((F.col("kind") == "biomarker") | fused).select("case_id", "profile"))
    rest = key.where("kind = 'fusion'").join(in_profiles, "case_id", "left_anti").join(names, "gene").join(own, "variant_id").select("case_id", "profile")
    return found.union(in_profiles).union(rest).distinct()


def audited(cases: DataFrame, evidence: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """(case_id, status, matched, sources, levels, downgraded) of cases (case_id, tumour, expected).

    evidence: (case_id, source, level, disease, drug) of what speaks for a response. Of a source's rows those of a fitting
    tumour count if there are any, else all, and the source is off the tumour. expected: alternatives of components
    ('A+B/C'). COVERED if all components of an alternative are found, lowered to PARTIAL if no source on the tumour
    has all of the first such alternative; PARTIAL if some component is found, else GAP.
    """
    labels = cases.select(F.col("tumour").alias("x"))
    fits = fitting(labels, evidence.select(F.col("disease").alias("y")), synonyms).withColumn("fits", F.lit(True))
    rows = evidence.join(cases.select("case_id", F.lower(F.trim("tumour")).alias("x")), "case_id").withColumn("y", F.lower(F.trim("disease")))
    rows = durable(rows.join(fits, ["x", "y"], "left").select("case_id", "source", "level", "drug", F.coalesce("fits", F.lit(False)).alias("fits")).distinct())
    on = rows.groupBy("case_id", "source").agg(F.bool_or("fits").alias("on_tumour"))
    kept = durable(rows.join(on, ["case_id", "source"]).where("fits or not on_tumour").select("case_id", "source", "on_tumour", "level", "drug"))
    parts = F.transform(F.split("expected", "/"), lambda a: F.filter(F.transform(F.split(a, r"\+"), lambda c: F.upper(F.trim(c))), lambda c: c != ""))
    wanted = cases.select("case_id", F.posexplode(parts).alias("alternative", "_p")).select("case_id", "alternative", F.size("_p").alias("size"), F.explode(F.array_distinct("_p")).alias("part"))
    drugs = kept.select(F.upper("drug").alias("text")).distinct()
    needles = wanted.select(F.col("part").alias("needle"))
    # A component and a drug match if either name holds the other.
    alike = contained(needles, drugs).union(contained(drugs.withColumnRenamed("text", "needle"), needles.withColumnRenamed("needle", "text")).select(F.col("text"), F.col("needle"))).toDF("part", "name").distinct()
    hits = wanted.join(alike, "part").join(kept.select("case_id", "source", "on_tumour", F.upper("drug").alias("name")).distinct(), ["case_id", "name"])
    hits = durable(hits.select("case_id", "alternative", "part", "source", "on_tumour").distinct())
    whole = hits.groupBy("case_id", "alternative").agg(F.count_distinct("part").alias("n")).join(wanted.groupBy("case_id", "alternative").agg(F.count_distinct("part").alias("size")), ["case_id", "alternative"]).where("n = size")
    first = whole.groupBy("case_id").agg(F.min("alternative").alias("alternative")).join(wanted.groupBy("case_id", "alternative").agg(F.count_distinct("part").alias("size")), ["case_id", "alternative"])
    by_source = hits.where("on_tumour").join(first, ["case_id", "alternative"]).groupBy("case_id", "source", "size").agg(F.count_distinct("part").alias("n")).where("n = size")
    sound = by_source.select("case_id").distinct().withColumn("_sound", F.lit(True))
    matched = hits.join(first.withColumnRenamed("alternative", "_first").select("case_id", "_first"), "case_id", "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("alternative")))
    matched = matched.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("matched"))
    shown = kept.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.array_join(F.array_sort(F.collect_set("level")), "/").alias("levels"))
    out = cases.select("case_id").join(matched, "case_id", "left").join(first.select("case_id", F.lit(True).alias("_whole")), "case_id", "left").join(sound, "case_id", "left").join(shown, "case_id", "left")
    low = F.col("_whole").isNotNull() & F.col("_sound").isNull()
    status = F.when(F.col("matched").isNull(), "GAP").when(F.col("_whole").isNull() | low, "PARTIAL").otherwise("COVERED")
    return out.select("case_id", status.alias("status"), F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("levels", F.lit("")).alias("levels"), low.alias("downgraded"))
