"""Every registered query of the graph engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axiograph.operators import rules
from axiograph.plans import derived_queries, file_queries, graph_queries, oracles  # noqa: F401  two of them register themselves
from axiograph.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _rule(name: str) -> Query:
    return lambda spark, sf_dir: rules.RULES[name](rules.Graph(store.testbed(spark, sf_dir)))


for _i, _name in enumerate(["annotation_whitespace", "deprecated_boolean_datatype", "deprecated_class_reference", "deprecated_property_reference", "duplicate_definition", "duplicate_exact_synonym", "duplicate_label_synonym", "duplicate_label", "duplicate_scoped_synonym", "equivalent_pair", "equivalent_class_axiom_no_genus", "illegal_use_of_built_in_vocabulary", "invalid_xref", "label_formatting", "label_whitespace", "lowercase_definition", "missing_definition", "missing_label", "missing_obsolete_label", "missing_ontology_description", "missing_ontology_license", "missing_ontology_title", "missing_subset_declaration", "missing_superclass", "missing_synonymtype_declaration", "misused_obsolete_label", "misused_replaced_by", "multiple_definitions", "multiple_equivalent_classes", "multiple_equivalent_class_definitions", "multiple_labels", "invalid_entity_uri", "multiple_asserted_superclasses"], 1):
    register(f"rul_{_i:02}_{_name}", _rule(_name), oracles.rule_sql(_name))

for _name, (_query, _sql) in graph_queries.FOUND.items():
    register(_name, _query, _sql)
