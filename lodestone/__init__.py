"""Lodestone: evidence-graph queries, retrieval, rules and audits as Spark DataFrame programs."""

__version__ = "0.1.0"
