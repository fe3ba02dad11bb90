"""Queries of selectors, axiom filters, hierarchies, set operations, repair, metrics and reports over the mapped tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiograph import expressions
from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import AXIOM_TYPES, CHARACTERISTICS, DECLARED, GROUPS, Ontology
from axiograph.operators import axfilter, graph, metrics, repair, report, rules, select, setops
from axiograph.plans import oracles
from axiograph.sources import store

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
EX = V.EX


_ontologies: dict[tuple[str, str], Ontology] = {}


def _testbed(spark: SparkSession, sf_dir: str) -> Ontology:
    """The test bed's ontology, whose written views serve all queries of a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ontologies:
        _ontologies[key] = Ontology(store.testbed(spark, sf_dir))
    return _ontologies[key]


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Callable[[Ontology], DataFrame]], Query]:
    """Register a function of the test bed's ontology; sql follows the common tables of PRELUDE."""

    def add(f: Callable[[Ontology], DataFrame]) -> Query:
        run = lambda spark, sf_dir: f(_testbed(spark, sf_dir))
        text = None
        if sql is not None:
            text = (PRELUDE + sql).replace("WITH ", "WITH RECURSIVE ", 1)
        FOUND[name] = (run, text)
        return run

    return add


def _case(column: str, table: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _in(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def _level(name: str, below: str | None) -> str:
    """expr, op, label: texts of expressions whose parts have the texts of the level below."""
    text = f"coalesce(b.label, xpart.part) AS text FROM xpart LEFT JOIN {below} b ON b.expr = xpart.part" if below else "xpart.part AS text FROM xpart"
    return f"""{name} AS (SELECT spec.expr, spec.op, spec.op || '(' || concat_ws(' ', spec.n, spec.prop, q.inside) || ')' AS label
    FROM spec LEFT JOIN (SELECT expr, string_agg(text, ' ' ORDER BY text) AS inside FROM (SELECT DISTINCT xpart.expr, {text}) z GROUP BY expr) q ON q.expr = spec.expr)"""


_NOT_DECLARED = f"AND o NOT IN {_in([*DECLARED, *CHARACTERISTICS])}"
PRELUDE = (
    oracles.BASE.rstrip()
    + f""",
decl AS (SELECT DISTINCT s AS iri, {_case("o", DECLARED, "NULL")} AS kind FROM t WHERE p = '{V.TYPE}' AND s_kind = 'iri' AND o IN {_in(DECLARED)}),
e AS (SELECT DISTINCT s AS child, o AS parent, o_kind, CASE WHEN p = '{V.SUBCLASS}' THEN 'class' ELSE 'property' END AS kind FROM t WHERE p IN {_in([V.SUBCLASS, V.SUBPROPERTY])} AND s_kind = 'iri' AND s <> o),
ce AS (SELECT child, parent FROM e WHERE kind = 'class'),
ind AS (SELECT iri FROM decl WHERE kind = 'individual'),
lc AS (SELECT s AS owner, p, o AS node, 0 AS pos FROM t WHERE p IN {_in(expressions.LISTS)} UNION SELECT lc.owner, lc.p, r.o, lc.pos + 1 FROM lc JOIN t r ON r.s = lc.node AND r.p = '{V.REST}' WHERE r.o <> '{V.NIL}'),
li AS (SELECT lc.owner, lc.p, lc.pos, f.o AS member, f.o_kind AS kind FROM lc JOIN t f ON f.s = lc.node AND f.p = '{V.FIRST}'),
rs AS (SELECT r.s AS expr, {_case("f.p", expressions.FILLED, "NULL")} AS op, CASE WHEN f.p IN {_in(V.CARDINALITIES)} THEN f.o END AS n, r.o AS prop, r.o_kind AS prop_kind,
       CASE WHEN f.p IN {_in(V.CARDINALITIES)} THEN coalesce(q.o, '{V.THING}') WHEN f.p <> '{V.SELF}' THEN f.o END AS filler, CASE WHEN f.p IN {_in(V.CARDINALITIES)} THEN coalesce(q.o_kind, 'iri') ELSE f.o_kind END AS kind
       FROM t r JOIN t f ON r.s = f.s LEFT JOIN t q ON q.s = r.s AND q.p IN {_in([V.ON_CLASS, V.ON_RANGE])} WHERE r.p = '{V.ON_PROPERTY}' AND r.s_kind = 'bnode' AND f.p IN {_in(expressions.FILLED)}),
spec AS (SELECT expr, op, n, prop FROM rs UNION SELECT s, {_case("p", expressions.ALONE, "NULL")}, NULL, NULL FROM t WHERE s_kind = 'bnode' AND p IN {_in(expressions.ALONE)}
         UNION SELECT s, {_case("p", expressions.LISTS, "NULL")}, NULL, NULL FROM t WHERE p IN {_in([p for p in expressions.LISTS if p not in expressions.AXIOM_LISTS])}),
xpart AS (SELECT expr, filler AS part, kind FROM rs WHERE filler IS NOT NULL UNION SELECT s, o, o_kind FROM t WHERE s_kind = 'bnode' AND p IN {_in(expressions.ALONE)}
       UNION SELECT owner, member, kind FROM li WHERE p NOT IN {_in(expressions.AXIOM_LISTS)}),
inn AS (SELECT expr, part AS node, kind FROM xpart UNION SELECT expr, prop, prop_kind FROM rs UNION SELECT inn.expr, z.part, z.kind FROM inn JOIN (SELECT * FROM xpart UNION SELECT expr, prop, prop_kind FROM rs) z ON z.expr = inn.node),
{_level("x0", None)}, {_level("x1", "x0")}, {_level("x2", "x1")},
ex AS (SELECT * FROM x2),
note AS (SELECT DISTINCT a.o AS s, b.o AS p, c.o AS o, n.p || '=' || n.o AS note FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s JOIN t n ON a.s = n.s
         WHERE a.p = '{V.ANN_SOURCE}' AND b.p = '{V.ANN_PROPERTY}' AND c.p = '{V.ANN_TARGET}' AND n.s_kind = 'bnode' AND n.p NOT IN {_in([V.TYPE, V.ANN_SOURCE, V.ANN_PROPERTY, V.ANN_TARGET])}),
notes AS (SELECT s, p, o, string_agg(note, '|' ORDER BY note) AS notes FROM note GROUP BY s, p, o),
ax0 AS (SELECT CASE WHEN t.p = '{V.TYPE}' THEN CASE WHEN t.o IN {_in(DECLARED)} THEN 'Declaration' WHEN t.o IN {_in(CHARACTERISTICS)} THEN {_case("t.o", CHARACTERISTICS, "NULL")} WHEN t.o = '{V.ONTOLOGY}' THEN 'Ontology' ELSE 'ClassAssertion' END
        WHEN t.p IN {_in([V.IMPORTS, V.VERSION])} THEN 'Ontology'
        ELSE {_case("t.p", AXIOM_TYPES, "CASE WHEN t.p IN (SELECT iri FROM decl WHERE kind = 'object-property') THEN 'ObjectPropertyAssertion' WHEN t.p IN (SELECT iri FROM decl WHERE kind = 'data-property') THEN 'DataPropertyAssertion' ELSE 'AnnotationAssertion' END")} END AS ax_type,
        coalesce(es.label, t.s) AS subject, t.p AS property, coalesce(ex.label, t.o) AS object, t.o_kind AS object_kind, t.o_dt AS dt, t.o_lang AS lang, coalesce(n.notes, '') AS notes, t.s AS raw_s, t.o AS raw_o, t.s_kind
        FROM t LEFT JOIN ex ON t.o = ex.expr AND t.o_kind = 'bnode' LEFT JOIN ex es ON t.s = es.expr AND t.s_kind = 'bnode' LEFT JOIN notes n ON n.s = t.s AND n.p = t.p AND n.o = t.o
        WHERE (t.s_kind = 'iri' OR (es.label IS NOT NULL AND t.p IN {_in([V.SUBCLASS, V.EQUIVALENT, V.DISJOINT])})) AND t.p NOT IN {_in(expressions.AXIOM_LISTS)}),
mt AS (SELECT li.*, coalesce(ex.label, li.member) AS text FROM li LEFT JOIN ex ON ex.expr = li.member),
op AS (SELECT {_case("k.o", {V.ALL_DISJOINT: "DisjointClasses", V.ALL_DISJOINT_PROPERTIES: "DisjointProperties", V.ALL_DIFFERENT: "DifferentIndividuals"}, "NULL")} AS ax_type, min(text) AS subject, mt.p AS property, 'list(' || string_agg(DISTINCT text, ' ' ORDER BY text) || ')' AS object, owner
       FROM mt JOIN t k ON k.s = mt.owner AND k.p = '{V.TYPE}' WHERE mt.p IN {_in([V.MEMBERS, V.DISTINCT_MEMBERS])} GROUP BY k.o, mt.p, owner
       UNION ALL SELECT 'SubPropertyChainOf', owner, p, 'chain(' || string_agg(text, ' ' ORDER BY pos) || ')', owner FROM mt WHERE p = '{V.CHAIN}' GROUP BY owner, p
       UNION ALL SELECT CASE WHEN p = '{V.KEY}' THEN 'HasKey' ELSE 'DisjointUnion' END, owner, p, 'list(' || string_agg(DISTINCT text, ' ' ORDER BY text) || ')', owner FROM mt WHERE p IN {_in([V.KEY, V.DISJOINT_UNION])} GROUP BY owner, p),
ax AS MATERIALIZED (SELECT DISTINCT ax_type, subject, property, object, object_kind, dt, lang, notes FROM ax0 WHERE ax_type <> 'Ontology' UNION SELECT ax_type, subject, property, object, 'list', '', '', '' FROM op),
axr AS (SELECT * FROM ax0 WHERE ax_type <> 'Ontology'),
sig AS (SELECT * FROM (SELECT ax_type, subject, property, object, object_kind, dt, lang, notes, raw_s AS node FROM axr WHERE s_kind = 'iri'
        UNION SELECT ax_type, subject, property, object, object_kind, dt, lang, notes, property FROM axr WHERE ax_type LIKE '%Assertion' AND property <> '{V.TYPE}'
        UNION SELECT ax_type, subject, property, object, object_kind, dt, lang, notes, raw_o FROM axr WHERE object_kind = 'iri' AND ax_type NOT IN {_in(["Declaration", "AnnotationAssertion", *CHARACTERISTICS.values()])}
        UNION SELECT ax_type, subject, property, object, object_kind, dt, lang, notes, inn.node FROM axr JOIN inn ON inn.expr IN (axr.raw_s, axr.raw_o) AND inn.kind = 'iri'
        UNION SELECT ax_type, subject, property, object, 'list', '', '', '', coalesce(inn.node, mt.member) FROM op JOIN mt ON mt.owner = op.owner AND mt.p = op.property LEFT JOIN inn ON inn.expr = mt.member AND inn.kind = 'iri' WHERE mt.kind = 'iri' OR inn.node IS NOT NULL
        UNION SELECT ax_type, subject, property, object, 'list', '', '', '', owner FROM op WHERE NOT starts_with(owner, '_:')) z),
obj AS (SELECT iri AS node FROM decl UNION SELECT expr FROM ex UNION SELECT s FROM t WHERE s_kind = 'bnode')
"""
)
_AX = ["ax_type", "subject", "property", "object"]


def like(kind: str) -> str:
    return f"<{EX}{kind}/*>"


def starts(kind: str, column: str = "node") -> str:
    return f"starts_with({column}, '{EX}{kind}/')"


def _nodes(ont: Ontology, kind: str) -> DataFrame:
    return select.select_one(ont, select.all_objects(ont), like(kind))


# Scalars ------------------------------------------------------------------------------------------------------------
_CURIES = {p: n for p, n in V.PREFIXES.items()}


@query("scl_01_iri_of_curie", f"SELECT iri AS name, iri FROM decl WHERE iri LIKE '{EX}%'")
def _(ont):
    named = ont.declared.where(F.col("iri").startswith(EX)).select("iri")
    return named.withColumn("curie", terms.to_curie("iri", _CURIES)).select(F.col("iri").alias("name"), terms.to_iri("curie", _CURIES).alias("iri")).join(ont.declared.select(F.col("iri").alias("name")), "name")


_CURIE_SQL = "CASE " + " ".join(f"WHEN starts_with(iri, '{n}') THEN '{p}:' || substr(iri, {len(n) + 1})" for p, n in sorted(V.PREFIXES.items(), key=lambda x: -len(x[1]))) + " ELSE iri END"


@query("scl_02_curie_of_iri", f"SELECT DISTINCT iri, {_CURIE_SQL} AS curie FROM decl")
def _(ont):
    return ont.declared.select("iri").distinct().withColumn("curie", terms.to_curie("iri", V.PREFIXES))


@query("scl_03_valid_curie", f"SELECT DISTINCT o AS name, regexp_matches(o, '^[A-Za-z_][A-Za-z0-9_.-]*:[^\\s]+$') AS valid FROM t WHERE p = '{V.XREF}'")
def _(ont):
    return ont.with_p(V.XREF).select(F.col("o").alias("name"), terms.is_curie("o").alias("valid")).distinct()


@query("scl_05_label_to_iri", f"SELECT o AS label, max(s) AS iri, CAST(count(DISTINCT s) AS BIGINT) AS n_iris FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY o")
def _(ont):
    return terms.label_to_iri(ont.rows)


@query("scl_06_iri_to_label", f"SELECT s AS iri, arg_min(o, (o_lang, o)) AS label FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY s")
def _(ont):
    return terms.labels(ont.rows)


@query("scl_07_literal_values", "SELECT DISTINCT s, p, o AS value, o_dt AS datatype, o_lang AS lang FROM t WHERE o_kind = 'lit'")
def _(ont):
    return ont.rows.where("o_kind = 'lit'").select("s", "p", F.col("o").alias("value"), F.coalesce("o_dt", F.lit("")).alias("datatype"), F.coalesce("o_lang", F.lit("")).alias("lang")).distinct()


@query("scl_08_expression_text", "SELECT DISTINCT expr, op, label FROM ex")
def _(ont):
    return ont.expressions.select("expr", "op", "label").distinct()


@query("scl_09_short_forms", f"SELECT d.iri, {_CURIE_SQL.replace('iri,', 'd.iri,').replace('ELSE iri', 'ELSE d.iri')} AS id, l.label, coalesce(CASE WHEN contains(l.label, ' ') THEN '''' || l.label || '''' ELSE l.label END, {_CURIE_SQL.replace('iri,', 'd.iri,').replace('ELSE iri', 'ELSE d.iri')}) AS name FROM (SELECT DISTINCT iri FROM decl) d LEFT JOIN (SELECT s AS iri, arg_min(o, (o_lang, o)) AS label FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY s) l ON d.iri = l.iri")
def _(ont):
    named = ont.declared.select("iri").distinct().join(terms.labels(ont.rows), "iri", "left")
    return named.select("iri", terms.short_form("iri", "ID", V.PREFIXES).alias("id"), "label", terms.short_form("iri", "NAME", V.PREFIXES).alias("name"))


# Selectors ----------------------------------------------------------------------------------------------------------
def selector(name: str, kind: str | None, groups: list[str], sql: str, recursive: bool = False) -> None:
    """kind: the objects that the groups start from (all of one kind, or every object)."""
    query(name, sql, recursive)(lambda ont: select.select(ont, _nodes(ont, kind) if kind else select.all_objects(ont), groups))


_UP = "up AS (SELECT parent AS node FROM e WHERE {start} UNION SELECT e.parent FROM e JOIN up ON e.child = up.node)"
selector("sel_01_union_and_composition", "nation", ["parents children", "children"], f"SELECT DISTINCT z.child AS node FROM (SELECT parent AS node FROM e WHERE {starts('nation', 'child')} UNION SELECT child FROM e WHERE {starts('nation', 'parent')}) y JOIN e z ON z.parent = y.node")
selector("sel_02_self", "supplier", ["self"], f"SELECT node FROM obj WHERE {starts('supplier')}")
selector("sel_03_parents", "part", ["parents"], f"SELECT DISTINCT parent AS node FROM e WHERE {starts('part', 'child')}")
selector("sel_04_children", "nation", ["children"], f"SELECT DISTINCT child AS node FROM e WHERE {starts('nation', 'parent')}")
selector("sel_05_ancestors", "supplier", ["ancestors"], ", " + _UP.format(start=starts("supplier", "child")) + " SELECT node FROM up", True)
selector("sel_06_descendants", "region", ["descendants"], f", dn AS (SELECT child AS node FROM e WHERE {starts('region', 'parent')} UNION SELECT e.child FROM e JOIN dn ON e.parent = dn.node) SELECT node FROM dn", True)
_EQ = "(SELECT s, o FROM t WHERE p IN " + _in([V.EQUIVALENT, V.EQUIVALENT_PROPERTY]) + " UNION SELECT o, s FROM t WHERE p IN " + _in([V.EQUIVALENT, V.EQUIVALENT_PROPERTY]) + ")"
selector("sel_07_equivalents", "part", ["equivalents"], f"SELECT DISTINCT q.o AS node FROM {_EQ} q WHERE {starts('part', 'q.s')} AND q.s IN (SELECT node FROM obj)")
_MADE = f"(SELECT s, o FROM t WHERE p = '{V.TYPE}' AND s IN (SELECT iri FROM ind) AND o <> '{V.INDIVIDUAL}')"
selector("sel_08_instances", "customer", ["instances"], f"SELECT DISTINCT m.s AS node FROM {_MADE} m WHERE {starts('customer', 'm.o')}")
selector("sel_09_types", "order", ["types"], f"SELECT DISTINCT m.o AS node FROM {_MADE} m WHERE {starts('order', 'm.s')}")
selector("sel_10_domains", None, ["object-properties", "domains"], f"SELECT DISTINCT o AS node FROM t WHERE p = '{V.DOMAIN}' AND s IN (SELECT iri FROM decl WHERE kind = 'object-property')")
selector("sel_11_ranges", None, ["object-properties", "ranges"], f"SELECT DISTINCT o AS node FROM t WHERE p = '{V.RANGE}' AND s IN (SELECT iri FROM decl WHERE kind = 'object-property')")
selector("sel_12_complement", "order", ["complement"], f"SELECT node FROM obj WHERE NOT {starts('order')}")
for _n, (_sel, _kinds) in enumerate(select.KIND_SELECTORS.items(), 13):
    selector(f"sel_{_n}_{_sel.replace('-', '_')}", None, [_sel], f"SELECT DISTINCT iri AS node FROM decl WHERE kind IN {_in(_kinds)}")
selector("sel_19_named", None, ["named"], "SELECT node FROM obj WHERE NOT starts_with(node, '_:')")
selector("sel_20_anonymous", None, ["anonymous"], "SELECT node FROM obj WHERE starts_with(node, '_:')")
selector("sel_21_iri_pattern", None, [f"<{EX}part/1?7*> <~.*supplier/[0-9]5>"], f"SELECT node FROM obj WHERE NOT starts_with(node, '_:') AND (regexp_full_match(node, '{EX.replace('.', '[.]')}part/1.?7.*') OR regexp_full_match(node, '.*supplier/[0-9]5'))")
selector("sel_22_prefix_pattern", None, ["ex:nation/*"], f"SELECT node FROM obj WHERE {starts('nation')}")
selector("sel_23_iri_value", None, ["rdfs:subClassOf=ex:region/1"], f"SELECT DISTINCT s AS node FROM t WHERE p = '{V.SUBCLASS}' AND o = '{EX}region/1'")
selector("sel_24_literal_value", None, ["rdfs:comment='BUILDING'"], f"SELECT DISTINCT s AS node FROM t WHERE p = '{V.COMMENT}' AND o = 'BUILDING'")
selector("sel_25_datatype_value", None, ["owl:deprecated=^^xsd:boolean"], f"SELECT DISTINCT s AS node FROM t WHERE p = '{V.DEPRECATED}' AND o_dt = '{V.XSD_BOOLEAN}' AND s IN (SELECT node FROM obj)")
selector("sel_26_language_value", None, ["obo:IAO_0000115=@fr"], f"SELECT DISTINCT s AS node FROM t WHERE p = '{V.DEFINITION}' AND lower(o_lang) = 'fr'")
selector("sel_27_regex_value", None, ["rdfs:label=~'.*[0-9]7'"], f"SELECT DISTINCT s AS node FROM t WHERE p = '{V.LABEL}' AND regexp_full_match(o, '.*[0-9]7') AND s IN (SELECT node FROM obj)")
selector("sel_28_axiom_annotation_value", None, ["oboInOwl:is_inferred='true'"], f"SELECT DISTINCT b.o AS node FROM t a JOIN t b ON a.s = b.s WHERE a.p = '{V.IS_INFERRED}' AND a.o = 'true' AND b.p = '{V.ANN_SOURCE}'")


@query("sel_29_terms_without_punning", "SELECT iri AS node FROM decl GROUP BY iri HAVING count(*) = 1")
def _(ont):
    counts = ont.declared.groupBy("iri").agg(F.count("*").alias("n")).where("n = 1")
    return counts.select(F.col("iri").alias("node"))


@query("sel_30_object_set", f"SELECT node FROM obj WHERE {starts('nation')} UNION SELECT child FROM e WHERE {starts('nation', 'parent')} AND NOT {starts('supplier', 'child')}")
def _(ont):
    return select.object_set(ont, _nodes(ont, "nation"), _nodes(ont, "supplier"), ["self children"])


@query("sel_31_ontology_header", f"SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT s FROM t WHERE p = '{V.TYPE}' AND o = '{V.ONTOLOGY}')")
def _(ont):
    heads = ont.with_p(V.TYPE).where(F.col("o") == V.ONTOLOGY).select("s")
    return ont.rows.join(heads, "s", "left_semi").select("s", "p", "o").distinct()


# Axiom filters ------------------------------------------------------------------------------------------------------
def axioms_of(name: str, f, sql: str, recursive: bool = False) -> None:
    query(name, sql, recursive)(lambda ont: f(ont).select(*_AX).distinct())


_OUT = "SELECT DISTINCT ax_type, subject, property, object FROM ax"
axioms_of("axf_01_logical", lambda o: axfilter.of_type(o.axioms, ["logical"]), f"{_OUT} WHERE ax_type IN {_in(GROUPS['logical'])}")
axioms_of("axf_02_union_of_types", lambda o: axfilter.of_type(o.axioms, ["subproperty", "type", "PropertyDomain"]), f"{_OUT} WHERE ax_type IN ('SubPropertyOf', 'SubPropertyChainOf', 'ClassAssertion', 'PropertyDomain')")
axioms_of("axf_03_internal", lambda o: axfilter.of_type(o.axioms, ["internal"], [EX + "supplier", EX + "part"]), f"{_OUT} WHERE starts_with(subject, '{EX}supplier') OR starts_with(subject, '{EX}part')")
axioms_of("axf_04_external", lambda o: axfilter.of_type(o.axioms, ["external"], [EX]), f"{_OUT} WHERE NOT starts_with(subject, '{EX}')")
query("axf_05_subjects", "SELECT ax_type, CAST(count(DISTINCT subject) AS BIGINT) AS n_subjects FROM ax GROUP BY ax_type")(lambda o: o.axioms.groupBy("ax_type").agg(F.countDistinct("subject").alias("n_subjects")))
axioms_of("axf_07_structural_tautologies", lambda o: axfilter.of_type(o.axioms, ["structural-tautologies"]), f"{_OUT} WHERE (ax_type IN ('SubClassOf', 'EquivalentClasses', 'SubPropertyOf', 'EquivalentProperties') AND subject = object) OR (ax_type IN ('SubClassOf', 'ClassAssertion', 'PropertyDomain', 'PropertyRange') AND object = '{V.THING}')")
axioms_of("axf_08_partial", lambda o: axfilter.partial(o.axioms, _nodes(o, "nation")), f"SELECT DISTINCT ax_type, subject, property, object FROM sig WHERE {starts('nation')}")
axioms_of("axf_09_partial_with_anonymous", lambda o: axfilter.partial(o.axioms, o.axioms.where("object LIKE 'some(%'").select(F.col("object").alias("node")), named_only=False), "SELECT DISTINCT ax_type, subject, property, object FROM axr JOIN (SELECT expr, expr AS node FROM ex UNION SELECT expr, node FROM inn WHERE kind = 'bnode') z ON z.expr IN (raw_s, raw_o) JOIN ex ON ex.expr = z.node WHERE ex.label IN (SELECT object FROM ax WHERE starts_with(object, 'some('))")
_COMPLETE = "SELECT DISTINCT ax_type, subject, property, object FROM ax x WHERE NOT EXISTS (SELECT 1 FROM sig g WHERE g.ax_type = x.ax_type AND g.subject = x.subject AND g.property = x.property AND g.object = x.object AND NOT ({}))"
axioms_of("axf_10_complete", lambda o: axfilter.complete(axfilter.of_type(o.axioms, ["tbox", "declaration"]), _nodes(o, "nation").unionByName(_nodes(o, "region"))), _COMPLETE.format(f"{starts('nation', 'g.node')} OR {starts('region', 'g.node')}") + f" AND ax_type IN {_in([*GROUPS['tbox'], 'Declaration'])}")
axioms_of("axf_11_complete_with_anonymous", lambda o: axfilter.complete(axfilter.of_type(o.axioms, ["equivalent"]), _nodes(o, "part"), named_only=False), _COMPLETE.format(starts("part", "g.node")) + " AND ax_type IN ('EquivalentClasses', 'EquivalentProperties') AND object_kind = 'iri'")
query("axf_12_signature", "SELECT ax_type, CAST(count(DISTINCT node) AS BIGINT) AS n_names FROM sig GROUP BY ax_type")(lambda o: o.axioms.select("ax_type", F.explode("sig").alias("node")).groupBy("ax_type").agg(F.countDistinct("node").alias("n_names")))


@query("axf_13_drop_annotations", f"SELECT DISTINCT ax_type, subject, property, object, CASE WHEN contains(notes, '{V.SYNONYM_TYPE}=') THEN '' ELSE notes END AS notes FROM ax WHERE notes <> ''")
def _(ont):
    return axfilter.without_notes(ont.axioms.where(F.size("notes") > 0), V.SYNONYM_TYPE).select(*_AX, F.array_join("notes", "|").alias("notes"))


axioms_of("axf_14_annotations_of_objects", lambda o: axfilter.about(o.axioms, _nodes(o, "supplier")), f"{_OUT} WHERE ax_type = 'AnnotationAssertion' AND {starts('supplier', 'subject')}")
axioms_of("axf_15_object_property_whitelist", lambda o: axfilter.by_properties(o.axioms, [EX + "part_of"], o.declared.where("kind = 'object-property'").select(F.col("iri").alias("node"))), f"{_OUT} x WHERE NOT EXISTS (SELECT 1 FROM sig g JOIN decl ON decl.iri = g.node WHERE decl.kind = 'object-property' AND g.node <> '{EX}part_of' AND g.ax_type = x.ax_type AND g.subject = x.subject AND g.property = x.property AND g.object = x.object) AND NOT (object_kind = 'bnode' AND starts_with(object, 'some({EX}old_relation '))")

# Hierarchies --------------------------------------------------------------------------------------------------------
_CLOSURE = "cl AS (SELECT child, parent FROM {e} UNION SELECT cl.child, x.parent FROM cl JOIN {e} x ON cl.parent = x.child)"
query("core_01_closure", ", " + _CLOSURE.format(e="ce") + " SELECT child, parent FROM cl", True)(lambda o: graph.closure(o.edges.where("kind = 'class'")))
_GAPS = ", w AS (SELECT k.node AS child, ce.parent FROM kept k JOIN ce ON ce.child = k.node UNION SELECT w.child, ce.parent FROM w JOIN ce ON ce.child = w.parent WHERE w.parent NOT IN (SELECT node FROM kept))"
_KEPT = f", kept AS (SELECT iri AS node FROM decl WHERE kind = 'class' AND NOT {starts('nation', 'iri')} AND NOT starts_with(iri, '{EX}type/') AND NOT starts_with(iri, '{EX}brand/'))"
_SPAN = "SELECT DISTINCT child, parent FROM w WHERE parent IN (SELECT node FROM kept) AND child <> parent"


def _most_classes(ont: Ontology) -> DataFrame:
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("node"))
    return classes.where(~F.col("node").rlike(f"^{EX}(nation|type|brand)/"))


query("grf_01_span_gaps", _KEPT + _GAPS + _SPAN, True)(lambda o: graph.span_gaps(o.edges.where("kind = 'class'"), _most_classes(o)))
query("grf_02_superclasses", f"SELECT DISTINCT child, parent FROM ce WHERE NOT EXISTS (SELECT 1 FROM t q WHERE q.p = '{V.EQUIVALENT}' AND ((q.s = ce.child AND q.o = ce.parent) OR (q.o = ce.child AND q.s = ce.parent)))")(lambda o: o.edges.where("kind = 'class'").select("child", "parent").join(o.with_p(V.EQUIVALENT).select(F.col("s").alias("child"), F.col("o").alias("parent")).unionByName(o.with_p(V.EQUIVALENT).select(F.col("o").alias("child"), F.col("s").alias("parent"))), ["child", "parent"], "left_anti").distinct())
_LINKS = f"SELECT 'SubClassOf' AS ax_type, child AS subject, '{V.SUBCLASS}' AS property, parent AS object FROM w WHERE parent IN (SELECT node FROM kept) AND child <> parent"
_CLASS_KEPT = ", kept AS (SELECT iri AS node FROM decl WHERE kind = 'class' AND {c})"
query("grf_03_remove", _CLASS_KEPT.format(c=f"NOT {starts('nation', 'iri')}") + _GAPS + f"{_OUT} x WHERE NOT EXISTS (SELECT 1 FROM sig g WHERE g.ax_type = x.ax_type AND g.subject = x.subject AND g.property = x.property AND g.object = x.object AND {starts('nation', 'g.node')}) UNION {_LINKS}", True)(lambda o: axfilter.remove(o, _nodes(o, "nation"), signature=True))
query("grf_04_filter", _CLASS_KEPT.format(c=f"({starts('supplier', 'iri')} OR {starts('region', 'iri')})") + _GAPS + _COMPLETE.format(f"{starts('supplier', 'g.node')} OR {starts('region', 'g.node')}") + f" UNION {_LINKS}", True)(lambda o: axfilter.keep(o, _nodes(o, "supplier").unionByName(_nodes(o, "region"))))
query("grf_05_collapse", ", gone AS (SELECT parent AS node FROM ce WHERE parent IN (SELECT child FROM ce) GROUP BY parent HAVING count(*) < 150), kept AS (SELECT child AS node FROM ce WHERE child NOT IN (SELECT node FROM gone) UNION SELECT parent FROM ce WHERE parent NOT IN (SELECT node FROM gone))" + _GAPS + _SPAN, True)(lambda o: graph.collapse(o.edges.where("kind = 'class'"), 150, repeat=False))
_MIREOT = f", up AS (SELECT child, parent FROM ce WHERE {starts('supplier', 'child')} UNION SELECT ce.child, ce.parent FROM up JOIN ce ON ce.child = up.parent WHERE NOT {starts('nation', 'up.parent')}) , up2 AS (SELECT * FROM up WHERE NOT starts_with(parent, '_:'))"
query("grf_06_ancestors_to_upper_terms", _MIREOT + " SELECT child, parent FROM up2", True)(lambda o: graph.bounded_ancestors(o.edges.where("kind = 'class'"), _nodes(o, "supplier"), _nodes(o, "nation")))
query("grf_07_ancestors_without_intermediates", f", kept AS (SELECT iri AS node FROM decl WHERE {starts('supplier', 'iri')} OR {starts('region', 'iri')})" + _GAPS + _SPAN, True)(lambda o: graph.bounded_ancestors(o.edges.where("kind = 'class'"), _nodes(o, "supplier"), _nodes(o, "region"), "none"))
query("grf_08_descendants_of_branch", f", dn AS (SELECT child, parent FROM ce WHERE {starts('region', 'parent')} UNION SELECT ce.child, ce.parent FROM dn JOIN ce ON ce.parent = dn.child) SELECT child, parent FROM dn", True)(lambda o: graph.branch(o.edges.where("kind = 'class'"), _nodes(o, "region")))
for _kind, _name in (("BOT", "bottom"), ("TOP", "top"), ("STAR", "star")):
    query(f"grf_09_{_name}_module")(lambda o, k=_kind: graph.module(o, _nodes(o, "supplier"), k, "exclude").select(*_AX).distinct())
query("grf_12_source_annotations", f"SELECT DISTINCT iri AS s, '{V.DEFINED_BY}' AS p, regexp_extract(iri, '^(.*[/#])[^/#]*$', 1) AS o FROM decl")(lambda o: o.declared.select(F.col("iri").alias("s"), F.lit(V.DEFINED_BY).alias("p"), F.regexp_extract("iri", "^(.*[/#])[^/#]*$", 1).alias("o")).distinct())
_EQ_EDGES = f"ee AS (SELECT DISTINCT s AS child, o AS parent FROM t WHERE p IN {_in([V.EQUIVALENT, V.SUBCLASS])} AND s_kind = 'iri' AND o_kind = 'iri' AND s <> o)"
query("grf_13_cycles", f", {_EQ_EDGES}, cl AS (SELECT child, parent FROM ee UNION SELECT cl.child, x.parent FROM cl JOIN ee x ON cl.parent = x.child) SELECT child AS node FROM cl WHERE child = parent", True)(lambda o: graph.cycles(o.with_p(V.EQUIVALENT, V.SUBCLASS).where("s_kind = 'iri' AND o_kind = 'iri' AND s <> o").select(F.col("s").alias("child"), F.col("o").alias("parent"))))
query("grf_14_anonymous_equivalents", "SELECT DISTINCT subject AS entity, object AS expression FROM ax WHERE object_kind = 'bnode' AND ax_type IN ('EquivalentClasses', 'SubClassOf')")(lambda o: o.axioms.where("object_kind = 'bnode' AND ax_type IN ('EquivalentClasses', 'SubClassOf')").select(F.col("subject").alias("entity"), F.col("object").alias("expression")).distinct())
_DANGLING = f"dangle AS (SELECT child AS iri FROM e UNION SELECT parent FROM e WHERE o_kind = 'iri' EXCEPT SELECT iri FROM decl EXCEPT SELECT o FROM t WHERE starts_with(o, '{V.OWL}') OR starts_with(o, '{V.RDFS}'))"
query("grf_15_trim_dangling", f", {_DANGLING} SELECT DISTINCT child, parent FROM e WHERE child NOT IN (SELECT iri FROM dangle) AND parent NOT IN (SELECT iri FROM dangle)")(lambda o: o.edges.select("child", "parent").distinct().join(graph.dangling(o).select(F.col("iri").alias("child")), "child", "left_anti").join(graph.dangling(o).select(F.col("iri").alias("parent")), "parent", "left_anti"))

# Sets ---------------------------------------------------------------------------------------------------------------
_T = "SELECT s, p, o, o_dt, o_lang FROM t"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("s", "p", "o", F.coalesce("o_dt", F.lit("")).alias("o_dt"), F.coalesce("o_lang", F.lit("")).alias("o_lang"))


def _half(ont: Ontology, kind: str) -> DataFrame:
    return ont.rows.where(F.col("s").startswith(EX + kind))


_A, _B = (f"starts_with(s, '{EX}{k}')" for k in ("supplier", "customer"))
query("set_01_merge", _T)(lambda o: _shown(setops.merge(o.rows.where(~F.col("s").startswith(EX + "supplier")), o.rows.where(~F.col("s").startswith(EX + "customer")), _half(o, "supplier"), shared=True)))
query("set_02_defined_by", f"SELECT DISTINCT iri AS s, '{V.DEFINED_BY}' AS p, '{EX}onto' AS o FROM decl")(lambda o: setops.defined_by(o, EX + "onto").select("s", "p", "o"))
query("set_03_derived_from", f"SELECT DISTINCT ax_type, subject, property, object, dt, lang, CASE WHEN notes = '' THEN '' ELSE notes || '|' END || '{V.PROV}wasDerivedFrom={EX}onto/1' AS notes FROM ax WHERE ax_type = 'SubClassOf'")(lambda o: setops.derived_from(o.axioms.where("ax_type = 'SubClassOf'"), EX + "onto/1").select(*_AX, "dt", "lang", F.array_join("notes", "|").alias("notes")))
query("set_04_unmerge", f"{_T} WHERE NOT ({_A}) AND NOT ({_B})")(lambda o: _shown(setops.unmerge(o.rows, _half(o, "supplier"), _half(o, "customer"), shared=True)))
query("set_05_diff", f"SELECT CASE WHEN {_A} THEN 'left' ELSE 'right' END AS side, s, p, o, o_dt, o_lang FROM t WHERE {_A} OR {_B}")(lambda o: (lambda d: d.select("side", *[F.coalesce(c, F.lit("")).alias(c) for c in ("s", "p", "o", "o_dt", "o_lang")]))(setops.diff(o.rows.where(~F.col("s").startswith(EX + "customer")), o.rows.where(~F.col("s").startswith(EX + "supplier")), shared=True)))


def _other_load(ont: Ontology) -> Ontology:
    """The same ontology with other names of blank nodes, without what is said of suppliers."""
    renamed = [F.when(F.col(f"{c}_kind") == "bnode", F.concat(F.lit("_:other"), F.substring(c, 3, 1000))).otherwise(F.col(c)).alias(c) for c in "so"]
    return Ontology(ont.rows.where(~F.col("s").startswith(EX + "supplier/")).select(renamed[0], "s_kind", "p", renamed[1], "o_kind", "o_dt", "o_lang"))


query("set_05_axiom_diff", f"SELECT DISTINCT 'left' AS side, ax_type, subject, property, object, dt, lang FROM ax WHERE {starts('supplier', 'subject')}")(lambda o: setops.axiom_diff(o, _other_load(o)).select("side", *_AX, "dt", "lang").distinct())
query("set_01_merged_axioms", "SELECT ax_type, count(*) AS n FROM (SELECT DISTINCT ax_type, subject, property, object, object_kind, dt, lang, notes FROM ax) x GROUP BY ax_type")(lambda o: setops.merged_axioms(o, _other_load(o)).groupBy("ax_type").agg(F.count("*").alias("n")))
query("src_09_unconsumed", "SELECT s, p, o FROM t WHERE s_kind = 'bnode' AND s NOT IN (SELECT expr FROM ex) AND s NOT IN (SELECT node FROM lc) AND s NOT IN (SELECT owner FROM op) AND s NOT IN (SELECT a.s FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s WHERE a.p = '" + V.ANN_SOURCE + "' AND b.p = '" + V.ANN_PROPERTY + "' AND c.p = '" + V.ANN_TARGET + "')")(lambda o: o.unconsumed())
_LABELS = f"(SELECT s AS iri, arg_min(o, (o_lang, o)) AS label FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY s)"
query("set_07_labelled_diff", f"SELECT CASE WHEN a.label IS NULL THEN child ELSE '<' || child || '>[' || a.label || ']' END AS child, CASE WHEN b.label IS NULL THEN parent ELSE '<' || parent || '>[' || b.label || ']' END AS parent FROM (SELECT DISTINCT child, parent FROM ce) x LEFT JOIN {_LABELS} a ON a.iri = child LEFT JOIN {_LABELS} b ON b.iri = parent")(lambda o: setops.labelled(o.edges.where("kind = 'class'").select("child", "parent").distinct(), terms.labels(o.rows), ["child", "parent"]))


@query("set_08_rename", f"SELECT DISTINCT CASE WHEN {starts('nation', 's')} THEN replace(s, '/nation/', '/country/') ELSE s END AS s, p, CASE WHEN o_kind = 'iri' AND {starts('nation', 'o')} THEN replace(o, '/nation/', '/country/') ELSE o END AS o FROM t")
def _(ont):
    mapping = _nodes(ont, "nation").select(F.col("node").alias("old"), F.replace(F.col("node"), F.lit("/nation/"), F.lit("/country/")).alias("new"))
    setops.check_mapping(mapping)
    return setops.rename(ont.rows, mapping).select("s", "p", "o").distinct()


query("set_09_rename_prefixes", f"SELECT DISTINCT CASE WHEN starts_with(s, '{EX}') THEN 'urn:x:' || substr(s, {len(EX) + 1}) ELSE s END AS s, CASE WHEN starts_with(p, '{EX}') THEN 'urn:x:' || substr(p, {len(EX) + 1}) ELSE p END AS p, CASE WHEN o_kind = 'iri' AND starts_with(o, '{EX}') THEN 'urn:x:' || substr(o, {len(EX) + 1}) ELSE o END AS o FROM t")(lambda o: setops.rename_prefixes(o.rows, {EX: "urn:x:"}).select("s", "p", "o").distinct())
query("set_10_annotate", f"SELECT s, p, o FROM t WHERE s = '{EX}onto' UNION ALL SELECT '{EX}onto', '{V.COMMENT}', 'A comment' UNION ALL SELECT '{EX}onto', '{V.DCTERMS}license', '{EX}license'")(lambda o: setops.annotate(o, EX + "onto", {V.COMMENT: "A comment"}, {V.DCTERMS + "license": EX + "license"}).where(F.col("s") == EX + "onto").select("s", "p", "o"))
query("set_12_copy_entities", f"SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT iri FROM decl) AND ((p = '{V.TYPE}' AND o IN {_in(V.KINDS.values())}) OR p = '{V.LABEL}')")(lambda o: setops.copied(o, o.declared.select(F.col("iri").alias("node")).distinct(), [V.LABEL]).select("s", "p", "o").distinct())

# Checks and repair --------------------------------------------------------------------------------------------------
query("chk_01_dangling", f", {_DANGLING} SELECT iri FROM dangle")(lambda o: graph.dangling(o))
query("chk_02_deprecated", "SELECT s AS iri FROM d")(lambda o: repair.deprecated(o))
query("chk_03_invalid_references", f", {_DANGLING} SELECT DISTINCT ax_type, subject, object, node AS entity, 'DANGLING' AS category FROM sig WHERE ax_type IN {_in(GROUPS['logical'])} AND node IN (SELECT iri FROM dangle) UNION SELECT ax_type, subject, object, node, 'DEPRECATED' FROM sig WHERE ax_type IN {_in(GROUPS['logical'])} AND node IN (SELECT s FROM d) AND node <> subject")(lambda o: repair.invalid_references(o))
_RB = f"rb AS (SELECT s AS old, min(o) AS new FROM t WHERE p = '{V.REPLACED_BY}' AND o_kind <> 'bnode' AND s IN (SELECT s FROM d) GROUP BY s)"
query("rep_01_repair_references", f", {_RB} SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT old FROM rb) UNION SELECT s, p, CASE WHEN o_kind = 'iri' THEN coalesce(rb.new, o) ELSE o END FROM t LEFT JOIN rb ON rb.old = t.o WHERE s NOT IN (SELECT old FROM rb)")(lambda o: repair.repair_references(o).select("s", "p", "o").distinct())
query("rep_02_migrate_annotations", f", {_RB} SELECT DISTINCT coalesce(rb.new, t.s) AS s, p, o FROM t LEFT JOIN rb ON rb.old = t.s WHERE p = '{V.EXACT}'")(lambda o: repair.repair_references(o, [V.EXACT]).where(F.col("p") == V.EXACT).select("s", "p", "o").distinct())
query("rep_03_merge_axiom_annotations", "SELECT ax_type, subject, property, object, dt, lang, max(notes) AS notes FROM ax WHERE ax_type IN ('SubClassOf', 'AnnotationAssertion') GROUP BY ALL".replace("max(notes) AS notes", "string_agg(DISTINCT notes, '|') AS notes").replace(" GROUP BY ALL", " GROUP BY ax_type, subject, property, object, dt, lang"))(lambda o: repair.merged_notes(o.axioms.where("ax_type IN ('SubClassOf', 'AnnotationAssertion')").withColumn("object", F.concat_ws("\u0001", "object", "dt", "lang"))).select("ax_type", "subject", "property", F.split_part("object", F.lit("\u0001"), F.lit(1)).alias("object"), F.split_part("object", F.lit("\u0001"), F.lit(2)).alias("dt"), F.split_part("object", F.lit("\u0001"), F.lit(3)).alias("lang"), F.array_join("notes", "|").alias("notes")))
_LIT = f"s_kind = 'iri' AND o_kind = 'lit'"
query("rep_05_keep_one_annotation", f"SELECT s, p, CASE WHEN count(*) FILTER (o_lang = '') = 1 THEN min(o) FILTER (o_lang = '') ELSE min(o) END AS o FROM t WHERE p IN {_in([V.LABEL, V.DEFINITION])} AND {_LIT} GROUP BY s, p")(lambda o: repair.one_annotation(o, [V.LABEL, V.DEFINITION]))
query("rep_06_join_annotations", f"SELECT s, p, string_agg(o, ' ' ORDER BY o) AS o FROM (SELECT DISTINCT s, p, o FROM t WHERE p IN {_in([V.LABEL, V.DEFINITION, V.EXACT])} AND {_LIT}) x GROUP BY s, p")(lambda o: repair.joined_annotations(o, [V.LABEL, V.DEFINITION, V.EXACT]))

# Metrics ------------------------------------------------------------------------------------------------------------
_KIND_NAMES = {"class": "class_count", "object-property": "obj_property_count", "data-property": "data_property_count", "annotation-property": "annotation_property_count", "individual": "individual_count", "datatype": "datatype_count"}


def _metric(name: str, value: str, kind: str = "single_value") -> str:
    return f"SELECT '{name}' AS metric, CAST(({value}) AS VARCHAR) AS metric_value, '{kind}' AS metric_type"


query("agg_01_entity_counts", " UNION ALL ".join([_metric(v, f"SELECT count(*) FROM decl WHERE kind = '{k}'") for k, v in _KIND_NAMES.items()] + [_metric("signature_entity_count", "SELECT count(*) FROM decl")]))(metrics.entity_counts)
_GROUP = lambda *g: _in(sorted({t for x in g for t in GROUPS[x]}))
query("agg_02_axiom_counts", " UNION ALL ".join([_metric("axiom_count", "SELECT count(*) FROM ax"), *[_metric(n, f"SELECT count(*) FROM ax WHERE ax_type IN {_GROUP(*g)}") for n, g in (("logical_axiom_count", ["logical"]), ("tbox_axiom_count", ["tbox"]), ("rbox_axiom_count", ["rbox"]), ("tboxrbox_axiom_count", ["tbox", "rbox"]), ("abox_axiom_count", ["abox"]))], _metric("rule_count", "0")]))(metrics.axiom_counts)
query("agg_06_rdfs", _metric("rdfs", f"SELECT coalesce(min(CASE WHEN ax_type IN ('SubClassOf', 'SubPropertyOf', 'PropertyDomain', 'PropertyRange', 'ClassAssertion', 'ObjectPropertyAssertion', 'DataPropertyAssertion') AND object_kind <> 'bnode' THEN 1 ELSE 0 END), 1) = 1 FROM ax WHERE ax_type IN {_GROUP('logical')}"))(metrics.rdfs_only)
query("agg_08_header", f"{_metric('ontology_iri', 'SELECT min(s) FROM t WHERE p = ' + repr(V.TYPE) + ' AND o = ' + repr(V.ONTOLOGY) + ' AND s NOT IN (SELECT o FROM t WHERE p = ' + repr(V.IMPORTS) + ')')} UNION ALL {_metric('ontology_version_iri', 'SELECT min(o) FROM t WHERE p = ' + repr(V.VERSION))} UNION ALL SELECT 'valid_imports', o, 'list_value' FROM t WHERE p = '{V.IMPORTS}'")(metrics.header)
_BUILTIN = f"(starts_with(o_dt, '{V.XSD}') OR starts_with(o_dt, '{V.RDF}') OR starts_with(o_dt, '{V.RDFS}'))"
query("agg_09_datatypes", f"{_metric('datatypes_builtin_count', f'SELECT count(DISTINCT o_dt) FROM t WHERE o_kind = {chr(39)}lit{chr(39)} AND {_BUILTIN}')} UNION ALL {_metric('datatypes_notbuiltin_count', f'SELECT count(DISTINCT o_dt) FROM t WHERE o_kind = {chr(39)}lit{chr(39)} AND NOT {_BUILTIN}')} UNION ALL SELECT 'dt_axiom_count', o_dt || ' ' || count(*), 'map_value' FROM t WHERE o_kind = 'lit' GROUP BY o_dt")(metrics.datatypes)
query("agg_11_axiom_types", "SELECT 'axiom_type_count' AS metric, ax_type || ' ' || count(*) AS metric_value, 'map_value' AS metric_type FROM ax GROUP BY ax_type")(metrics.axiom_types)
query("agg_12_expression_types", "SELECT 'class_expression_count' AS metric, op || ' ' || count(*) AS metric_value, 'map_value' AS metric_type FROM ex GROUP BY op")(metrics.expression_types)
_NS = "split_part(" + _CURIE_SQL + ", ':', 1)"
query("agg_13_namespaces", f"SELECT 'namespace_entity_count' AS metric, ns || ' ' || count(*) AS metric_value, 'map_value' AS metric_type FROM (SELECT {_NS} AS ns FROM (SELECT DISTINCT iri FROM decl)) x GROUP BY ns UNION ALL SELECT 'namespace_axiom_count', ns || ' ' || count(*), 'map_value' FROM (SELECT {_NS} AS ns FROM (SELECT node AS iri FROM sig) y) x GROUP BY ns")(lambda o: metrics.namespaces(o, V.PREFIXES))
_EACH = f"""each AS (SELECT c.iri AS node, (SELECT count(*) FROM ce WHERE ce.child = c.iri) AS parents, (SELECT count(*) FROM e WHERE e.kind = 'class' AND e.o_kind = 'iri' AND e.child = c.iri) AS named,
    (SELECT count(*) FROM ce WHERE ce.parent = c.iri) AS children, (SELECT count(*) FROM t WHERE t.p = '{V.TYPE}' AND NOT starts_with(t.o, '{V.OWL}') AND t.o = c.iri) AS instances FROM decl c WHERE c.kind = 'class')"""
_RATIO = lambda c: f"SELECT CAST(round(sum({c})::DOUBLE / count(*), 6) AS DECIMAL(20,6)) FROM each"
query("agg_16_hierarchy", f", {_EACH} " + " UNION ALL ".join([_metric("avg_asserted_subclass_axioms_per_class", _RATIO("children")), _metric("avg_asserted_superclass_axioms_per_class", _RATIO("parents")), _metric("avg_instance_per_class", _RATIO("instances")), _metric("class_sgl_subcl_count", "SELECT count(*) FROM each WHERE children = 1"), _metric("max_num_named_superclasses", "SELECT max(named) FROM each"), _metric("multi_inheritance_count", "SELECT count(*) FROM each WHERE named > 1")]))(metrics.hierarchy)
query("agg_18_structure", ", cl AS (SELECT child, parent FROM ce UNION SELECT cl.child, x.parent FROM cl JOIN ce x ON cl.parent = x.child) " + " UNION ALL ".join([_metric("axiom_complexrhs_count", "SELECT count(*) FROM ax WHERE object_kind = 'bnode' AND ax_type IN ('SubClassOf', 'EquivalentClasses')"), _metric("gci_hidden_count", "SELECT count(DISTINCT subject) FROM ax WHERE ax_type = 'EquivalentClasses' AND subject IN (SELECT subject FROM ax WHERE ax_type = 'SubClassOf')"), _metric("undeclared_entity_count", "SELECT count(DISTINCT node) FROM sig WHERE node NOT IN (SELECT iri FROM decl)"), _metric("tautology_count", "SELECT count(*) FROM ax WHERE ax_type IN ('SubClassOf', 'EquivalentClasses', 'SubPropertyOf', 'EquivalentProperties') AND subject = object OR ax_type IN ('SubClassOf', 'ClassAssertion', 'PropertyDomain', 'PropertyRange') AND object = '" + V.THING + "'"), _metric("longest_axiom_length", "SELECT max(n) FROM (SELECT count(DISTINCT node) AS n FROM sig GROUP BY ax_type, subject, property, object, dt, lang, notes)"), _metric("cyclic_class_count", "SELECT count(*) FROM cl WHERE child = parent")]), True)(metrics.structure)
query("agg_10_constructs", f"SELECT 'constructs' AS metric, op AS metric_value, 'list_value' AS metric_type FROM (SELECT DISTINCT op FROM ex UNION SELECT DISTINCT ax_type FROM ax WHERE ax_type IN {_in(['SubPropertyOf', 'InverseProperties', *CHARACTERISTICS.values()])}) x")(metrics.constructs)
query("agg_23_most_frequent_class", _metric("most_freq_concept", "SELECT arg_max(node, (n, node)) FROM (SELECT node, count(*) AS n FROM sig WHERE node IN (SELECT iri FROM decl WHERE kind = 'class') GROUP BY node)"))(metrics.most_frequent_class)

# Reports ------------------------------------------------------------------------------------------------------------
_PROFILE = {r: rules.DEFAULT_PROFILE[r] for r in ("duplicate_label", "label_whitespace", "missing_superclass", "deprecated_boolean_datatype", "lowercase_definition", "illegal_use_of_built_in_vocabulary")}


def _report_sql() -> str:
    parts = [f"SELECT '{level}' AS level, '{rule}' AS rule, entity, property, value FROM ({oracles.RULES[rule]}) q" for rule, level in _PROFILE.items()]
    return "rep AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") r WHERE NOT contains(entity, '/rdf-schema#') AND NOT contains(entity, '/owl#'))"


query("rpt_01_report", f", {_report_sql()} SELECT * FROM rep")(lambda o: report.report(o.triples, _PROFILE))
query("rpt_02_base_and_limit", f", {_report_sql()} SELECT level, rule, entity, property, value FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY entity, property NULLS FIRST, value NULLS FIRST) AS n FROM rep WHERE starts_with(entity, '{EX}part/') OR starts_with(entity, '{EX}doc/')) z WHERE n <= 20")(lambda o: report.report(o.triples, _PROFILE, [EX + "part/", EX + "doc/"], 20))
query("rpt_04_totals", f", {_report_sql()} SELECT level, CAST(count(*) AS BIGINT) AS violations FROM rep GROUP BY level")(lambda o: report.totals(report.report(o.triples, _PROFILE)))
query("rpt_05_labels", f", {_report_sql()}, lb AS (SELECT s AS iri, arg_min(o, (o_lang, o)) AS label FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY s) SELECT level, rule, CASE WHEN lb.label IS NOT NULL THEN lb.label || ' [' || {_CURIE_SQL.replace('iri,', 'entity,').replace('ELSE iri', 'ELSE entity')} || ']' ELSE {_CURIE_SQL.replace('iri,', 'entity,').replace('ELSE iri', 'ELSE entity')} END AS entity, {_CURIE_SQL.replace('iri,', 'property,').replace('ELSE iri', 'ELSE property')} AS property, value FROM rep LEFT JOIN lb ON lb.iri = entity")(lambda o: report.labelled(report.report(o.triples, _PROFILE), o.rows, V.PREFIXES))
