"""Questions answered from the graph: all chains of the table of routes are walked together, once for all questions.

A chain is walked from both ends. Its head leads from the nodes that the questions link to, each once, up to its first
relationship of which both ends have many; heads that end alike are one walk, which keeps distinct (start, node) pairs.
Its tail is walked backwards from the names of its leaves; tails that begin alike share their relationships. Where the
two meet, only distinct (start, name) pairs stay, as a fact names no more than the two ends of a path. Facts become
sentences, each once for a question, and are packed in the order of the linked starts and then of the text.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.cases import BRIDGE_FACT, FACTS, ROUTES
from lodestone.operators.retrieval import packed
from lodestone.plans.graph import Graph
from lodestone.sources.tables import stored

Steps = tuple[tuple[str, str], ...]
Chain = tuple[str, Steps]

#: The name of a node by its label; others go by their key.
NAMES = {"Gene": "symbol", "Variant": "name", "MolecularProfile": "name", "Drug": "name", "Disease": "name", "ClinicalTrial": "nct_id"}
BRIDGE = "GENE_EVIDENCE_TRIAL_BRIDGE"
#: Relationships of which both ends have many; what lies behind them is walked from the other end.
MANY = ("TARGETS_DRUG", "TESTS_DRUG", "HAS_DISEASE")


def names_of(graph: Graph, labels: list[str]) -> DataFrame:
    """(node, label, alias): keys as text, after their label, and names."""
    out = []
    for label in labels:
        nodes = graph.nodes[label]
        out.append(nodes.table.select(F.concat(F.lit(f"{label}:"), F.col(nodes.key).cast("string")).alias("node"), F.lit(label).alias("label"), F.col(NAMES.get(label, nodes.key)).cast("string").alias("alias")))
    return reduce(DataFrame.union, out)


def leaf_of(graph: Graph, start: str, steps: Steps) -> str:
    """The label that a chain ends at; an error if a relationship does not leave where the chain has come to."""
    at = start
    for rel, way in steps:
        edge = graph.edges[rel]
        here, there = (edge.source, edge.target) if way == ">" else (edge.target, edge.source)
        if here != at:
            raise ValueError(f"{rel} does not leave {at}")
        at = there
    return at


def split(graph: Graph, chain: Chain) -> tuple[Steps, str, Steps]:
    """(head, label where it ends, tail) of a chain."""
    start, steps = chain
    n = next((i for i, (rel, _) in enumerate(steps) if rel in MANY), len(steps))
    return steps[:n], leaf_of(graph, start, steps[:n]), steps[n:]


def numbered(graph: Graph, chains: Iterable[Chain]) -> dict[Chain, int]:
    """A number for each chain; those of one number have the same tail and different start labels."""
    tails: dict[tuple[str, Steps], int] = {}
    heads: dict[tuple[str, str], Steps] = {}
    out = {}
    for chain in chains:
        leaf_of(graph, *chain)
        head, at, tail = split(graph, chain)
        if heads.setdefault((chain[0], at), head) != head:
            raise ValueError(f"two ways from {chain[0]} to {at}")
        out[chain] = tails.setdefault((at, tail), len(tails))
    return out


def _hop(graph: Graph, step: tuple[str, str], near: str, far: str) -> DataFrame:
    rel, way = step
    ends = ("src", "dst") if way == ">" else ("dst", "src")
    return graph.edges[rel].rows.select(*[F.col(c).alias(name) for c, name in zip(ends, (near, far), strict=True)])


def _front(graph: Graph, starts: DataFrame, heads: set[Chain]) -> DataFrame:
    """(start, _at): what heads that end at one label reach from starts (start, label)."""
    parts = [starts.where(F.col("label") == label).select("start", F.substring_index("start", ":", -1).alias("_at")) for label, steps in sorted(heads) if not steps]
    for step in sorted({steps[-1] for _, steps in heads if steps}):
        before = _front(graph, starts, {(label, steps[:-1]) for label, steps in heads if steps and steps[-1] == step})
        edges = _hop(graph, step, "_near", "_next")
        before = before.withColumn("_near", F.col("_at").cast(edges.schema["_near"].dataType))
        # Dealt by node, so that neither making them distinct nor the next join shuffles them again.
        parts.append(before.join(edges, "_near").select("start", F.col("_next").alias("_at")).repartition("_at").distinct())
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, [p.withColumn("_at", F.col("_at").cast("string")) for p in parts])


def _leaves(graph: Graph, label: str, tails: dict[int, Steps]) -> DataFrame:
    """(_at, tail, name): names that tails reach from the nodes of a label, by the tail's number; some more than once."""
    node = graph.nodes[label]
    parts = [node.table.select(F.col(node.key).alias("_at"), F.lit(n).alias("tail"), F.col(NAMES.get(label, node.key)).cast("string").alias("name")) for n, steps in tails.items() if not steps]
    for step in sorted({steps[0] for steps in tails.values() if steps}):
        behind = _leaves(graph, leaf_of(graph, label, (step,)), {n: steps[1:] for n, steps in tails.items() if steps and steps[0] == step})
        parts.append(_hop(graph, step, "_from", "_at").join(behind, "_at").select(F.col("_from").alias("_at"), "tail", "name"))
    return reduce(DataFrame.union, parts)


def answers(graph: Graph, starts: DataFrame, chains: Iterable[Chain]) -> DataFrame:
    """(start, tail, name), each once: names that chains reach from starts (start, as label:key), by the chain's number. A start has
    the tails of all chains that leave its label, and of those that share their walk."""
    numbers = numbered(graph, chains)
    begun = starts.select("start", F.substring_index("start", ":", 1).alias("label")).distinct()
    out = []
    for at in sorted({split(graph, chain)[1] for chain in numbers}):
        here = {chain: n for chain, n in numbers.items() if split(graph, chain)[1] == at}
        front = _front(graph, begun, {(chain[0], split(graph, chain)[0]) for chain in here})
        leaves = _leaves(graph, at, {n: split(graph, chain)[2] for chain, n in here.items()})
        front = front.withColumn("_at", F.col("_at").cast(leaves.schema["_at"].dataType))
        out.append(front.join(leaves, "_at").select("start", "tail", "name").distinct())
    return reduce(DataFrame.union, out)


def chains(route: str) -> list[tuple[str, Steps, bool]]:
    """(start label, steps, only where no node of the route's own label is linked) of a route."""
    start, steps = ROUTES[route]
    return [(start, steps, False), ("Gene", (("HAS_VARIANT", ">"), *steps), True)] if start == "Variant" else [(start, steps, False)]


def graph_facts(graph: Graph, asked: DataFrame, links: DataFrame, budget: int = 900) -> DataFrame:
    """(qid, rank, text, words, upto): the facts that routed questions (qid, route) with links (qid, node, label, place) read
    from the graph, under a word budget."""
    routed = stored(links.join(asked, "qid"))
    ways = {(label, steps): None for route in ROUTES if route != BRIDGE for label, steps, _ in chains(route)}
    number = numbered(graph, ways)
    gene = routed.where((F.col("route") == BRIDGE) & (F.col("label") == "Gene")).groupBy("qid").agg(F.min_by("node", "place").alias("start"))
    own = []
    for route in ROUTES:
        for label, steps, fallback in chains(route) if route != BRIDGE else ():
            mine = routed.where((F.col("route") == route) & (F.col("label") == label))
            if fallback:
                mine = mine.join(routed.where((F.col("route") == route) & (F.col("label") == ROUTES[route][0])).select("qid"), "qid", "left_anti")
            own.append(mine.select("qid", "place", F.col("node").alias("start"), "label", F.lit(number[label, steps]).alias("tail")))
    asks = reduce(DataFrame.union, own)
    # A variant goes by its gene's name and its own.
    called = names_of(graph, sorted({label for label, _ in ways})).select(F.col("node").alias("start"), F.col("alias").alias("start_name"))
    variants = graph.edges["HAS_VARIANT"].table.select(F.concat(F.lit("Gene:"), F.col("src").cast("string")).alias("gene"), F.concat(F.lit("Variant:"), F.col("dst").cast("string")).alias("start"))
    genes = variants.join(names_of(graph, ["Gene"]).select(F.col("node").alias("gene"), F.col("alias").alias("gene_name")), "gene").groupBy("start").agg(F.max("gene_name").alias("gene_name"))
    called = called.join(genes, "start", "left").select("start", F.concat_ws(" ", "gene_name", "start_name").alias("start_name"))
    ends = stored(answers(graph, asks.select("start").union(gene.select("start")), ways).join(called, "start"))
    text = None
    for (label, steps), n in number.items():
        here = (F.col("label") == label) & (F.col("tail") == n)
        fact = F.format_string(FACTS[label, leaf_of(graph, label, steps), steps[-1][0]], "start_name", "name")
        text = F.when(here, fact) if text is None else text.when(here, fact)
    facts = asks.join(ends, ["start", "tail"]).select("qid", "place", text.alias("key"), text.alias("text"))
    drugs, tested = (ends.where(F.col("tail") == number[ROUTES[r]]) for r in ("GENE_TO_DRUG", "GENE_TO_TRIALDRUG"))
    both = gene.join(drugs.join(tested.select("start", "name"), ["start", "name"], "left_semi"), "start")
    facts = facts.union(both.select("qid", F.lit(1).alias("place"), F.col("name").alias("key"), F.format_string(BRIDGE_FACT, "name", "start_name").alias("text")))
    once = facts.groupBy("qid", "text").agg(F.min(F.struct("place", "key")).alias("_o"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_o"))).drop("_o")
    return packed(ranked, budget, stop_when_full=False)
