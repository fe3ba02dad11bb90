"""Queries of export, reasoning, graph patterns, templates and files over the mapped tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import explain, export, graph, patterns, reason, template
from axiograph.plans.graph_queries import _CURIE_SQL, EX, _in, query, starts
from axiograph.sources import files, store

# Export -------------------------------------------------------------------------------------------------------------
_LB = f"lb AS (SELECT s AS iri, arg_min(o, (o_lang, o)) AS label FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY s)"


def _named(iri: str, label: str) -> str:
    return f"coalesce(CASE WHEN contains({label}, ' ') THEN '''' || {label} || '''' ELSE {label} END, {_CURIE_SQL.replace('iri,', iri + ',').replace('ELSE iri', 'ELSE ' + iri)})"


def _cell(rows: str) -> str:
    """iri, cell of rows (iri, value): sorted, joined, the bar escaped where there are several."""
    return f"(SELECT iri, CASE WHEN count(DISTINCT value) > 1 THEN array_to_string(list_transform(list_sort(list(DISTINCT value)), lambda v: replace(v, '|', '\\|')), '|') ELSE min(value) END AS cell FROM ({rows}) z GROUP BY iri)"


_PARENTS = _cell(f"SELECT e.child AS iri, {_named('e.parent', 'lb.label')} AS value FROM e LEFT JOIN lb ON lb.iri = e.parent WHERE e.kind = 'class' AND e.o_kind = 'iri'")
_SYN = _cell("SELECT s AS iri, o AS value FROM t WHERE p IN " + _in([V.EDITOR_SYNONYM, V.EXACT, V.BROAD, V.RELATED, V.NARROW]))
_COMMENTS = _cell(f"SELECT s AS iri, o AS value FROM t WHERE p = '{V.COMMENT}'")


def _table(ont: Ontology, columns: list[str], include: list[str]) -> DataFrame:
    out = export.flat(export.export(ont, columns, include))
    return out.toDF(*[c.lower().replace(" ", "_").replace(":", "_").split("_[")[0] for c in columns])


query("prj_01_export_classes", f""", {_LB} SELECT c.iri AS iri, {_CURIE_SQL.replace('iri,', 'c.iri,').replace('ELSE iri', 'ELSE c.iri')} AS id, coalesce(lb.label, '') AS label, coalesce(a.cell, '') AS subclass_of, coalesce(b.cell, '') AS synonyms, coalesce(k.cell, '') AS rdfs_comment
    FROM (SELECT iri FROM decl WHERE kind = 'class') c LEFT JOIN lb ON lb.iri = c.iri LEFT JOIN {_PARENTS} a ON a.iri = c.iri LEFT JOIN {_SYN} b ON b.iri = c.iri LEFT JOIN {_COMMENTS} k ON k.iri = c.iri""")(lambda o: _table(o, ["IRI", "ID", "LABEL", "SubClass Of [NAMED]", "SYNONYMS", "rdfs:comment"], ["classes"]))
query("prj_02_export_properties", f", {_LB} SELECT c.iri AS iri, c.kind AS entity_type, coalesce(lb.label, '') AS label FROM (SELECT iri, kind FROM decl WHERE kind IN ('object-property', 'data-property', 'annotation-property')) c LEFT JOIN lb ON lb.iri = c.iri")(lambda o: _table(o, ["IRI", "Entity Type", "LABEL"], ["properties"]))
_CHILDREN = _cell("SELECT parent AS iri, child AS value FROM e WHERE kind = 'class'")
query("prj_03_subclasses", f"SELECT c.iri AS iri, coalesce(a.cell, '') AS subclasses FROM (SELECT iri FROM decl WHERE kind = 'class') c LEFT JOIN {_CHILDREN} a ON a.iri = c.iri")(lambda o: _table(o, ["IRI", "SUBCLASSES [IRI NAMED]"], ["classes"]))
_TYPES = _cell(f"SELECT s AS iri, o AS value FROM t WHERE p = '{V.TYPE}' AND o NOT IN {_in(V.KINDS.values())}")
query("prj_04_individual_types", f"SELECT c.iri AS iri, coalesce(a.cell, '') AS type FROM (SELECT iri FROM decl WHERE kind = 'individual') c LEFT JOIN {_TYPES} a ON a.iri = c.iri")(lambda o: _table(o, ["IRI", "Type [IRI]"], ["individuals"]))
_SOMES = _cell(f"SELECT x.s AS iri, f.o AS value FROM t x JOIN t r ON x.o = r.s JOIN t f ON f.s = x.o WHERE x.p IN {_in([V.SUBCLASS, V.EQUIVALENT])} AND x.o_kind = 'bnode' AND r.p = '{V.ON_PROPERTY}' AND r.o = '{EX}part_of' AND f.p = '{V.SOME}'")
query("prj_05_restriction_fillers", f"SELECT c.iri AS iri, coalesce(a.cell, '') AS ex_part_of FROM (SELECT iri FROM decl WHERE kind = 'class') c LEFT JOIN {_SOMES} a ON a.iri = c.iri")(lambda o: _table(o, ["IRI", "ex:part_of [IRI]"], ["classes"]))


# Reasoning ----------------------------------------------------------------------------------------------------------
_TOLD = f"told AS (SELECT child, parent FROM e WHERE kind = 'class' AND o_kind = 'iri' UNION SELECT s, o FROM t WHERE p = '{V.EQUIVALENT}' AND s_kind = 'iri' AND o_kind = 'iri' AND s <> o UNION SELECT o, s FROM t WHERE p = '{V.EQUIVALENT}' AND s_kind = 'iri' AND o_kind = 'iri' AND s <> o)"
_ABOVE = f"{_TOLD}, up AS (SELECT child, parent FROM told UNION SELECT up.child, x.parent FROM up JOIN told x ON x.child = up.parent)"
_SOME = f"sm AS (SELECT DISTINCT x.s AS cls, r.o AS prop, f.o AS filler FROM t x JOIN t r ON x.o = r.s JOIN t f ON f.s = x.o WHERE x.p IN {_in([V.SUBCLASS, V.EQUIVALENT])} AND x.s_kind = 'iri' AND x.o_kind = 'bnode' AND r.p = '{V.ON_PROPERTY}' AND f.p = '{V.SOME}')"
query("rsn_05_told_hierarchy", f", {_ABOVE} SELECT child, parent FROM up WHERE child <> parent", True)(lambda o: graph.closure(reason.told(o)).where("child <> parent"))
query("rsn_10_relax", f""", rl AS (SELECT s AS subject, o AS node, o_kind AS kind FROM t WHERE p = '{V.EQUIVALENT}' AND s_kind = 'iri' UNION SELECT o, s, s_kind FROM t WHERE p = '{V.EQUIVALENT}' AND o_kind = 'iri'
        UNION SELECT rl.subject, li.member, li.kind FROM rl JOIN li ON li.owner = rl.node AND li.p = '{V.INTERSECTION}'),
    rel AS (SELECT subject, node AS object FROM rl WHERE kind = 'iri' UNION SELECT subject, 'some(' || rs.prop || ' ' || coalesce(ex.label, rs.filler) || ')' FROM rl JOIN rs ON rs.expr = rl.node LEFT JOIN ex ON ex.expr = rs.filler WHERE rs.op = 'some' OR (rs.op IN ('min', 'max', 'exact') AND CAST(rs.n AS BIGINT) > 0))
    SELECT subject, object FROM rel WHERE subject <> object AND NOT EXISTS (SELECT 1 FROM ax WHERE ax_type = 'SubClassOf' AND ax.subject = rel.subject AND ax.object = rel.object)""", True)(reason.relaxed)
query("rsn_12_unsatisfiable_properties")(reason.unsatisfiable_properties)
query("rsn_04_realized")(reason.realized)
query("rsn_11_materialize", f""", {_ABOVE}, {_SOME}, pr AS (SELECT child, parent FROM e WHERE kind = 'property' UNION SELECT pr.child, x.parent FROM pr JOIN e x ON x.kind = 'property' AND x.child = pr.parent),
    own AS (SELECT up.child AS cls, prop, filler FROM up JOIN sm ON sm.cls = up.parent WHERE up.child <> up.parent UNION SELECT cls, prop, filler FROM sm), wide AS (SELECT * FROM own UNION SELECT cls, pr.parent, filler FROM own JOIN pr ON pr.child = own.prop)
    SELECT cls, prop, filler FROM wide WHERE filler <> cls AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.cls = wide.cls AND sm.prop = wide.prop AND sm.filler = wide.filler)""", True)(reason.materialized)
query("rsn_08_reduce_expressions")(reason.reduced_expressions)
_CE_NAMED = "cn AS (SELECT DISTINCT child, parent FROM e WHERE kind = 'class' AND o_kind = 'iri')"
query("rsn_09_reduce_named", f""", {_CE_NAMED}, cl AS (SELECT child, parent FROM cn UNION SELECT cl.child, x.parent FROM cl JOIN cn x ON x.child = cl.parent)
    SELECT child, parent FROM cn WHERE NOT EXISTS (SELECT 1 FROM cn v JOIN cl ON cl.child = v.parent AND cl.parent = cn.parent WHERE v.child = cn.child AND v.parent <> cn.parent
      AND NOT EXISTS (SELECT 1 FROM cl z WHERE z.child = cn.parent AND z.parent = v.parent) AND NOT EXISTS (SELECT 1 FROM cl z WHERE z.child = v.parent AND z.parent = cn.child))""", True)(reason.reduced)
query("rsn_04_instances", f", {_TOLD}, up AS (SELECT child, parent FROM told UNION SELECT up.child, x.parent FROM up JOIN told x ON x.child = up.parent), own AS (SELECT DISTINCT s AS individual, o AS cls FROM t WHERE p = '{V.TYPE}' AND s IN (SELECT iri FROM ind) AND NOT starts_with(o, '{V.OWL}')) SELECT individual, cls FROM own UNION SELECT individual, parent FROM own JOIN up ON up.child = own.cls AND up.parent <> up.child", True)(lambda o: reason.instances(o, reasoner="structural"))
query("rsn_15_explain", f""", {_TOLD}, pt AS (SELECT [child, parent] AS path, parent AS node FROM told WHERE child = '{EX}part/1' UNION ALL SELECT list_append(path, x.parent), x.parent FROM pt JOIN told x ON x.child = pt.node WHERE pt.node <> '{EX}product' AND NOT list_contains(path, x.parent)),
    best AS (SELECT path, CAST(row_number() OVER (ORDER BY len(path), path) AS INTEGER) AS rank FROM pt WHERE node = '{EX}product' ORDER BY len(path), path LIMIT 3), link AS (SELECT path, rank, unnest(range(1, len(path))) AS i FROM best)
    SELECT rank, CAST(i - 1 AS INTEGER) AS step, path[i] AS subject, path[i + 1] AS object FROM link""", True)(lambda o: reason.explanations(o, f"{EX}part/1", f"{EX}product", 3))
query("axf_06_tautologies")(lambda o: o.axioms.join(explain.tautologies(o), "ax_id", "left_semi").select("ax_type", "subject", "property", "object").distinct())
_RSN = {"rsn_01_classify": reason.classify, "rsn_07_inferred": reason.inferred, "rsn_12_unsatisfiable": reason.unsatisfiable, "rsn_14_equivalence_policy": lambda o: reason.equivalences(o, "asserted-only")}
for _name, _f in _RSN.items():
    query(_name)(_f)

# Graph patterns -----------------------------------------------------------------------------------------------------
_I = lambda c: f"'<' || {c} || '>'"
_TERM = f"CASE WHEN {{a}}.o_kind = 'iri' THEN '<' || {{a}}.o || '>' WHEN {{a}}.o_kind = 'bnode' THEN {{a}}.o ELSE '\"' || {{a}}.o || CASE WHEN {{a}}.o_lang <> '' THEN '\"@' || lower({{a}}.o_lang) WHEN {{a}}.o_dt IN ('', '{V.XSD_STRING}') THEN '\"' ELSE '\"^^<' || {{a}}.o_dt || '>' END END"
_VAL = _TERM.format(a="v")


def _g(ont: Ontology, name: str | None = None) -> patterns.Graph:
    return patterns.Graph(ont.triples, name)


query("spq_01_select_join", f"SELECT DISTINCT {_I('x.s')} AS supplier, {_I('x.o')} AS nation, {_VAL} AS name FROM t x JOIN t v ON v.s = x.o WHERE x.p = '{V.SUBCLASS}' AND v.p = '{V.LABEL}' AND {starts('supplier', 'x.s')}")(lambda o: _g(o).match(("?supplier", "rdfs:subClassOf", "?nation"), ("?nation", "rdfs:label", "?name")).filter(F.col("supplier").startswith(f"<{EX}supplier/")).select("?supplier", "?nation", "?name", distinct=True))
query("spq_02_ask", f"SELECT count(*) > 0 AS answer FROM t WHERE p = '{V.LABEL}' AND o = 'EUROPE'")(lambda o: o.spark.createDataFrame([(_g(o).match(("?x", "rdfs:label", "'EUROPE'")).ask(),)], "answer boolean"))
query("spq_03_construct", f"SELECT DISTINCT CASE WHEN x.o_kind = 'bnode' THEN x.o ELSE {_I('x.o')} END AS s, '<{EX}has_child>' AS p, CASE WHEN x.s_kind = 'bnode' THEN x.s ELSE {_I('x.s')} END AS o FROM t x WHERE x.p = '{V.SUBCLASS}'")(lambda o: _g(o).match(("?c", "rdfs:subClassOf", "?p")).construct(("?p", "ex:has_child", "?c")))
query("spq_04_describe", f"SELECT DISTINCT {_I('v.s')} AS s, {_I('v.p')} AS p, {_VAL} AS o FROM t v WHERE v.s = '{EX}nation/1'")(lambda o: patterns.describe(o.triples, "ex:nation/1"))
query("spq_05_update", f"SELECT DISTINCT {_I('v.s')} AS s, {_I('v.p')} AS p, {_VAL} AS o FROM t v WHERE v.s_kind = 'iri' AND v.p = '{V.LABEL}' AND NOT {starts('nation', 'v.s')} UNION SELECT {_I('v.s')}, '<{V.COMMENT}>', {_VAL} FROM t v WHERE v.p = '{V.LABEL}' AND {starts('nation', 'v.s')}")(lambda o: (lambda w: patterns.update(o.with_p(V.LABEL), w, [("?s", "rdfs:label", "?v")], [("?s", "rdfs:comment", "?v")]))(_g(o).match(("?s", "rdfs:label", "?v")).filter(F.col("s").startswith(f"<{EX}nation/"))))
query("spq_06_named_graph", f"SELECT DISTINCT '<' || s || '>' AS who, '<' || p || '>' AS what FROM triples WHERE graph = '{EX}graph/click'")(lambda o: _g(o, f"{EX}graph/click").match(("?who", "?what", "?n")).select("?who", "?what", distinct=True))
query("spq_07_verify", f"SELECT 'labels' AS rule, CAST(count(*) AS BIGINT) AS violations FROM (SELECT DISTINCT s FROM t WHERE p = '{V.LABEL}' AND contains(o, chr(10))) q UNION ALL SELECT 'regions', 0")(lambda o: patterns.verify({"labels": _g(o).match(("?s", "rdfs:label", "?v")).filter(F.contains(patterns.text_of("v"), F.lit("\n"))).select("?s", distinct=True), "regions": _g(o).match(("?s", "rdfs:label", "'ATLANTIS'")).select("?s")}))
query("spq_12_optional_and_bound", f"SELECT DISTINCT {_I('x.s')} AS s, {_VAL} AS comment FROM t x LEFT JOIN t v ON v.s = x.s AND v.p = '{V.COMMENT}' WHERE x.p = '{V.SUBCLASS}' AND x.s_kind = 'iri'")(lambda o: _g(o).match(("?s", "rdfs:subClassOf", "?p")).filter(patterns.is_iri("s")).optional(_g(o).match(("?s", "rdfs:comment", "?comment"))).select("?s", "?comment", distinct=True))
query("spq_13_exists_and_not_exists", f"SELECT DISTINCT {_I('x.s')} AS s FROM t x WHERE x.p = '{V.TYPE}' AND x.o = '{V.CLASS}' AND EXISTS (SELECT 1 FROM t y WHERE y.s = x.s AND y.p = '{V.DEFINITION}') AND NOT EXISTS (SELECT 1 FROM t y WHERE y.s = x.s AND y.p = '{V.EXACT}')")(lambda o: _g(o).match(("?s", "rdf:type", "owl:Class")).exists(_g(o).match(("?s", "obo:IAO_0000115", "?d"))).not_exists(_g(o).match(("?s", "oboInOwl:hasExactSynonym", "?e"))).select("?s", distinct=True))
query("spq_14_union_and_values", f"SELECT DISTINCT {_I('v.s')} AS s, {_I('v.p')} AS kind FROM t v WHERE v.p IN {_in([V.EXACT, V.RELATED])}")(lambda o: _g(o).match(("?s", "oboInOwl:hasExactSynonym", "?v")).bind("?kind", F.lit(f"<{V.EXACT}>")).union(_g(o).match(("?s", "oboInOwl:hasRelatedSynonym", "?v")).bind("?kind", F.lit(f"<{V.RELATED}>"))).values("?kind", ["oboInOwl:hasExactSynonym", "oboInOwl:hasRelatedSynonym"]).select("?s", "?kind", distinct=True))
query("spq_15_group_having", f"SELECT {_VAL} AS label, CAST(count(DISTINCT v.s) AS BIGINT) AS n FROM t v WHERE v.p = '{V.LABEL}' GROUP BY 1 HAVING count(DISTINCT v.s) > 1")(lambda o: _g(o).match(("?s", "rdfs:label", "?label")).group(["?label"], n=F.countDistinct("s")).filter(F.col("n") > 1).select())
query("spq_16_path", f", cl AS (SELECT s AS child, o AS parent FROM t WHERE p = '{V.SUBCLASS}' UNION SELECT cl.child, x.o FROM cl JOIN t x ON x.s = cl.parent AND x.p = '{V.SUBCLASS}') SELECT {_I('child')} AS s, {_I('parent')} AS top FROM cl WHERE {starts('region', 'parent')}", True)(lambda o: _g(o).reachable("?s", "rdfs:subClassOf", "?top").filter(F.col("top").startswith(f"<{EX}region/")).select("?s", "?top"))
query("spq_17_term_functions", f"SELECT DISTINCT {_I('v.s')} AS s, v.o AS text, CASE WHEN v.o_lang <> '' THEN '{V.LANG_STRING}' ELSE v.o_dt END AS dt, lower(v.o_lang) AS lang FROM t v WHERE v.o_kind = 'lit' AND v.p IN {_in([V.DEFINITION, EX + 'size'])}")(lambda o: _g(o).match(("?s", "obo:IAO_0000115", "?v")).union(_g(o).match(("?s", "ex:size", "?v"))).filter(patterns.is_literal("v")).bind("?text", patterns.lexical("v")).bind("?dt", patterns.datatype("v")).bind("?lang", patterns.language("v")).select("?s", "?text", "?dt", "?lang", distinct=True))
query("spq_18_minus", f"SELECT DISTINCT {_I('x.s')} AS s FROM t x WHERE x.p = '{V.DISJOINT}' EXCEPT SELECT {_I('y.s')} FROM t y WHERE y.p = '{V.DEPRECATED}'")(lambda o: _g(o).match(("?s", "owl:disjointWith", "?d")).minus(_g(o).match(("?s", "owl:deprecated", "?v"))).select("?s", distinct=True))


# Templates and files ------------------------------------------------------------------------------------------------
def _parts(ont: Ontology) -> DataFrame:
    """The parts' labels and parents as a template table."""
    labels = ont.with_p(V.LABEL).where(F.col("s").startswith(f"{EX}part/")).select("s", F.col("o").alias("Label"))
    parents = ont.with_p(V.SUBCLASS).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), "|").alias("Parents"))
    return labels.join(parents, "s").select(F.col("s").alias("ID"), F.concat(F.col("Label"), F.lit(" copy")).alias("Label"), "Parents", F.col("Label").alias("Note"))


_MADE = f"SELECT s, '{V.TYPE}' AS p, '{V.CLASS}' AS o FROM pt UNION SELECT s, '{V.LABEL}', l || ' copy' FROM pt UNION SELECT s, '{V.SUBCLASS}', parent FROM pt JOIN e ON e.child = pt.s UNION SELECT s, '{V.COMMENT}', l FROM pt"
query("tpl_04_class_rows", f", pt AS (SELECT s, o AS l FROM t WHERE p = '{V.LABEL}' AND {starts('part', 's')}) {_MADE}")(lambda o: template.template(_parts(o), ["ID", "LABEL", "SC % SPLIT=|", "A rdfs:comment"])[0].select("s", "p", "o"))
query("tpl_12_errors", f"SELECT DISTINCT 'Parent' AS column, l AS value, 'names no entity' AS message FROM (SELECT o AS l FROM t WHERE p = '{V.LABEL}' AND {starts('part', 's')}) q")(lambda o: template.template(_parts(o).select("ID", "Label", F.col("Note").alias("Parent")), ["ID", "LABEL", "SC %"])[1])
query("tpl_04_restrictions", f"SELECT DISTINCT '{EX}part_of' AS prop, e.parent AS filler FROM e WHERE e.kind = 'class' AND e.o_kind = 'iri'")(lambda o: (lambda made: Ontology(made).expressions.select("prop", "filler").distinct())(template.template(o.edges.where("kind = 'class' AND o_kind = 'iri'").select(F.col("child").alias("ID"), F.col("parent").alias("Whole")), ["ID", "SC ex:part_of some %"])[0]))


def _round_trip(ont: Ontology) -> DataFrame:
    path = store.new_path(ont.spark, "nt")
    files.write_ntriples(ont.triples, path, compressed=True)
    rows = files.read_ntriples(ont.spark, path, strict=True)
    return rows.select("graph", "s", "p", "o", F.coalesce("o_dt", F.lit("")).alias("o_dt"), F.coalesce("o_lang", F.lit("")).alias("o_lang")).distinct()


query("src_02_ntriples_round_trip", "SELECT DISTINCT graph, s, p, o, coalesce(o_dt, '') AS o_dt, coalesce(o_lang, '') AS o_lang FROM triples")(_round_trip)
query("src_10_store", "SELECT p, CAST(count(*) AS BIGINT) AS n FROM triples GROUP BY p")(lambda o: o.triples.groupBy("p").agg(F.count("*").alias("n")))
query("src_14_default_graph", "SELECT CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(DISTINCT graph) FROM triples) AS BIGINT) AS graphs FROM t")(lambda o: o.rows.distinct().agg(F.count("*").alias("n")).crossJoin(o.triples.agg(F.countDistinct("graph").alias("graphs"))))


def _mirrored(ont: Ontology) -> DataFrame:
    path = store.new_path(ont.spark, "mirror")
    files.mirror(ont.triples, path)
    return ont.spark.read.parquet(path).groupBy(F.col("graph").cast("string").alias("graph")).agg(F.count("*").alias("n"))


query("snk_12_mirror", "SELECT graph, CAST(count(*) AS BIGINT) AS n FROM triples GROUP BY graph")(_mirrored)
query("snk_03_statement_documents", "SELECT DISTINCT CAST(to_json({'id': s, 'p': p, 'value': o}) AS VARCHAR) AS value FROM t WHERE s_kind = 'iri'")(lambda o: files.statement_documents(o.rows))
query("snk_07_html_rows", f", {_LB} SELECT '<tr><td>' || n.iri || '</td><td>' || replace(replace(replace(coalesce(lb.label, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS value FROM (SELECT iri FROM decl WHERE kind = 'class') n LEFT JOIN lb ON lb.iri = n.iri")(lambda o: files.html_rows(_table(o, ["IRI", "LABEL"], ["classes"])))
