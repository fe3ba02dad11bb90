"""Queries of file formats, templates, profiles, subsets, expansion and chains of steps over the mapped tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph import pipeline
from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import axfilter, export, graph, metrics, patterns, reason, report, rules, setops, template
from axiograph.plans.derived_queries import _ABOVE, _LB, _SOME, _g, _table
from axiograph.plans.graph_queries import _GAPS, _OUT, _PROFILE, _T, EX, _half, _in, _metric, _nodes, _report_sql, _shown, query, starts
from axiograph.sources import files, store
from axiograph.sources.shared import settle

# Files --------------------------------------------------------------------------------------------------------------


def _written(ont: Ontology, triples: DataFrame, ending: str) -> str:
    path = f"{store.new_path(ont.spark, 'files')}.{ending}"
    files.save(triples, path)
    return path


def _halves(ont: Ontology) -> DataFrame:
    """Two files of different formats, read as one ontology."""
    return _shown(files.load(ont.spark, _written(ont, _half(ont, "supplier").distinct(), "nt.gz"), _written(ont, ont.rows.where(~F.col("s").startswith(EX + "supplier")).distinct(), "jsonl")))


def _term_list(ont: Ontology) -> DataFrame:
    path = store.new_path(ont.spark, "terms")
    ont.declared.select("iri").distinct().select(F.concat(terms.to_curie("iri", V.PREFIXES), F.lit(" # a name"))).write.text(path)
    return files.read_terms(ont.spark, path)


def _mapping_file(ont: Ontology) -> DataFrame:
    path = f"{store.new_path(ont.spark, 'mapping')}.tsv"
    files.write_rows(ont.declared.select("iri").distinct().select(F.col("iri").alias("Old IRI"), F.replace(F.col("iri"), F.lit("/nation/"), F.lit("/country/")).alias("New IRI")), path, "tsv")
    return files.read_mapping(ont.spark, path)


def _csv_round_trip(ont: Ontology) -> DataFrame:
    path = store.new_path(ont.spark, "csv")
    files.write_rows(ont.with_p(V.LABEL, V.COMMENT).select("s", "p", "o").distinct(), path)
    return files.read_rows(ont.spark, path)


_OBO_KEPT = [V.TYPE, V.LABEL, V.DEFINITION, V.SUBCLASS, V.SUBPROPERTY]
query("src_04_jsonld_round_trip", _T)(lambda o: _shown(files.load(o.spark, _written(o, o.rows.distinct(), "jsonl.gz"))))
query("src_13_many_inputs", _T)(_halves)
query("src_12_term_list", "SELECT DISTINCT iri AS node FROM decl")(_term_list)
query("src_16_mapping_table", "SELECT DISTINCT iri AS old, replace(iri, '/nation/', '/country/') AS new FROM decl")(_mapping_file)
query(
    "snk_01_obo_round_trip",
    f""", h AS (SELECT iri, min(kind) AS kind FROM decl WHERE kind IN ('class', 'object-property', 'individual') GROUP BY iri)
    SELECT iri AS s, '{V.TYPE}' AS p, CASE kind WHEN 'class' THEN '{V.CLASS}' WHEN 'individual' THEN '{V.INDIVIDUAL}' ELSE '{V.OBJECT_PROPERTY}' END AS o FROM h
    UNION SELECT s, p, regexp_replace(o, '^\\s+|\\s+$', '', 'g') FROM t WHERE p IN {_in([V.LABEL, V.DEFINITION])} AND o_kind = 'lit' AND s IN (SELECT iri FROM h)
    UNION SELECT s, p, o FROM t WHERE p IN {_in([V.SUBCLASS, V.SUBPROPERTY])} AND o_kind = 'iri' AND s IN (SELECT iri FROM h)""",
)(lambda o: files.load(o.spark, _written(o, o.triples, "obo")).where(F.col("p").isin(_OBO_KEPT) & (F.col("s_kind") == "iri") & (F.col("o_kind") != "bnode")).select("s", "p", "o").distinct())
query("snk_04_csv_round_trip", f"SELECT DISTINCT s, p, o FROM t WHERE p IN {_in([V.LABEL, V.COMMENT])}")(_csv_round_trip)
query("snk_05_write_if_any", "SELECT true AS some, false AS none")(
    lambda o: o.spark.createDataFrame([(files.write_if_any(o.declared, store.new_path(o.spark, "some")), files.write_if_any(o.declared.limit(0), store.new_path(o.spark, "none")))], "some boolean, none boolean")
)
_NAMED_PARENTS = "(SELECT child AS iri, list_sort(list(DISTINCT parent)) AS cell FROM e WHERE kind = 'class' AND o_kind = 'iri' GROUP BY child)"
query(
    "snk_09_json_cells",
    f", {_LB} SELECT CAST(to_json({{'IRI': c.iri, 'LABEL': CASE WHEN lb.label IS NULL THEN [] ELSE [lb.label] END, 'SubClass Of [IRI NAMED]': coalesce(a.cell, [])}}) AS VARCHAR) AS value FROM (SELECT iri FROM decl WHERE kind = 'class') c LEFT JOIN lb ON lb.iri = c.iri LEFT JOIN {_NAMED_PARENTS} a ON a.iri = c.iri",
)(lambda o: export.json_rows(export.export(o, ["IRI", "LABEL", "SubClass Of [IRI NAMED]"], ["classes"])))
_KIND_METRICS = " UNION ALL ".join(f"SELECT '{n}' AS m, count(*) AS v FROM decl WHERE kind = '{k}'" for k, n in [("class", "class_count"), ("object-property", "obj_property_count"), ("data-property", "data_property_count"), ("annotation-property", "annotation_property_count"), ("individual", "individual_count"), ("datatype", "datatype_count")])
query("snk_10_metrics_yaml", f"SELECT '- metric: ''' || m || '''' || chr(10) || '  metric_value: ''' || v || '''' || chr(10) || '  metric_type: ''single_value''' AS value FROM ({_KIND_METRICS} UNION ALL SELECT 'signature_entity_count', count(*) FROM decl) q")(
    lambda o: files.yaml_rows(metrics.entity_counts(o))
)
query("set_11_convert", _T)(lambda o: _shown(files.load(o.spark, _written(o, files.load(o.spark, _written(o, o.rows.distinct(), "nt")), "parquet"))))

# Names, filters, sets -----------------------------------------------------------------------------------------------
query("scl_10_resolved_names", f"SELECT o AS name, max(s) AS iri FROM t WHERE p = '{V.LABEL}' AND s_kind = 'iri' GROUP BY o")(
    lambda o: (lambda names: template.resolve(names.select(F.col("label").alias("name")).distinct(), names, "name", V.PREFIXES))(o.with_p(V.LABEL).select(F.col("s").alias("iri"), F.col("o").alias("label")))
)
query("scl_12_interpolated", f"SELECT DISTINCT s, o || ' of {EX}onto ({EX}onto/1)' AS value FROM t WHERE p = '{V.LABEL}'")(
    lambda o: o.with_p(V.LABEL).select("s", F.concat("o", F.lit(" of %{ontology_iri} (%{version_iri})")).alias("value")).distinct().withColumn("value", terms.interpolated("value", f"{EX}onto", f"{EX}onto/1"))
)
_SAME_AXIOM = "g.ax_type = x.ax_type AND g.subject = x.subject AND g.property = x.property AND g.object = x.object"
query("axf_16_complete_removal", f"{_OUT} x WHERE EXISTS (SELECT 1 FROM sig g WHERE {_SAME_AXIOM} AND NOT ({starts('nation', 'g.node')} OR {starts('region', 'g.node')}))")(
    lambda o: axfilter.remove(o, _nodes(o, "nation").unionByName(_nodes(o, "region")), trim=False, signature=True, preserve_structure=False)
)
query("set_06_equal", "SELECT true AS same, false AS other")(
    lambda o: o.spark.createDataFrame([(setops.equal(_half(o, "supplier"), setops.merge(_half(o, "supplier"), _half(o, "supplier"))), setops.equal(_half(o, "supplier"), _half(o, "customer")))], "same boolean, other boolean")
)

# Hierarchies and reasoning --------------------------------------------------------------------------------------------
query("grf_10_leaves_to_roots", f", dn AS (SELECT child, parent AS root FROM ce WHERE {starts('region', 'parent')} UNION SELECT ce.child, dn.root FROM dn JOIN ce ON ce.parent = dn.child) SELECT child, root AS parent FROM dn WHERE child NOT IN (SELECT parent FROM ce)", True)(
    lambda o: graph.branch(o.edges.where("kind = 'class'"), _nodes(o, "region"), "none")
)
_ENDS = f"({starts('supplier', '{c}')} OR {starts('region', '{c}')} OR {starts('part', '{c}')})"
query(
    "grf_11_subset",
    f""", kept AS (SELECT node FROM obj WHERE {_ENDS.format(c='node')}){_GAPS}, {_ABOVE}, {_SOME}, pr AS (SELECT child, parent FROM e WHERE kind = 'property' UNION SELECT pr.child, x.parent FROM pr JOIN e x ON x.kind = 'property' AND x.child = pr.parent),
    own AS (SELECT up.child AS cls, prop, filler FROM up JOIN sm ON sm.cls = up.parent WHERE up.child <> up.parent UNION SELECT cls, prop, filler FROM sm), wide AS (SELECT * FROM own UNION SELECT cls, pr.parent, filler FROM own JOIN pr ON pr.child = own.prop)
    SELECT child AS subject, '{V.SUBCLASS}' AS prop, parent AS object FROM w WHERE parent IN (SELECT node FROM kept) AND child <> parent
    UNION SELECT cls, prop, filler FROM wide WHERE {_ENDS.format(c='cls')} AND filler IN (SELECT node FROM kept) AND (filler <> cls OR EXISTS (SELECT 1 FROM sm WHERE sm.cls = wide.cls AND sm.prop = wide.prop AND sm.filler = wide.filler))""",
    True,
)(lambda o: reason.subset(o, _nodes(o, "supplier").unionByName(_nodes(o, "region")).unionByName(_nodes(o, "part"))))
query("rsn_06_new_ontology", f", {_ABOVE} SELECT child AS s, '{V.SUBCLASS}' AS p, parent AS o FROM up WHERE child <> parent AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.child = up.child AND ce.parent = up.parent)", True)(
    lambda o: reason.reasoned(o, "structural", new_ontology=True, indirect=True).select("s", "p", "o")
)
_PROPS = f"pe AS (SELECT DISTINCT child, parent FROM e WHERE kind = 'property' AND o_kind = 'iri'), pc AS (SELECT child, parent FROM pe UNION SELECT pc.child, pe.parent FROM pc JOIN pe ON pe.child = pc.parent), ab AS (SELECT child AS prop, parent AS over FROM pc UNION SELECT iri, iri FROM decl WHERE kind IN ('object-property', 'data-property'))"
_INVERSE = f"iv AS (SELECT s AS prop, o AS back FROM t WHERE p = '{V.INVERSE}' UNION SELECT o, s FROM t WHERE p = '{V.INVERSE}')"
query(
    "rsn_03_property_axioms",
    f""", {_PROPS}, {_INVERSE} SELECT 'SubPropertyOf' AS ax_type, prop AS subject, over AS object FROM ab WHERE prop <> over UNION SELECT 'InverseProperties', prop, back FROM iv
    UNION SELECT CASE WHEN t.p = '{V.DOMAIN}' THEN 'PropertyDomain' ELSE 'PropertyRange' END, ab.prop, t.o FROM t JOIN ab ON ab.over = t.s WHERE t.p IN {_in([V.DOMAIN, V.RANGE])} AND t.o_kind = 'iri'""",
    True,
)(reason.inferred_property_axioms)
query(
    "rsn_05_generated",
    f""", {_PROPS}, {_INVERSE}, op2 AS (SELECT iri FROM decl WHERE kind = 'object-property'), g AS (SELECT 'SubPropertyOf' AS ax_type, prop AS subject, '{V.SUBPROPERTY}' AS property, over AS object FROM ab WHERE prop <> over UNION SELECT 'InverseProperties', prop, '{V.INVERSE}', back FROM iv
    UNION SELECT CASE WHEN t.p = '{V.DOMAIN}' THEN 'PropertyDomain' ELSE 'PropertyRange' END, ab.prop, t.p, t.o FROM t JOIN ab ON ab.over = t.s WHERE t.p IN {_in([V.DOMAIN, V.RANGE])} AND t.o_kind = 'iri')
    SELECT *, '{V.IS_INFERRED}=true' AS notes FROM g WHERE subject IN (SELECT iri FROM op2) AND NOT EXISTS (SELECT 1 FROM ax WHERE ax.ax_type = g.ax_type AND ((ax.subject = g.subject AND ax.object = g.object) OR (ax.ax_type = 'InverseProperties' AND ax.subject = g.object AND ax.object = g.subject)))""",
    True,
)(lambda o: reason.inferred_axioms(o, ["subobjectproperty", "objectpropertydomain", "objectpropertyrange", "inverseobjectproperties"], exclude_duplicates=True, annotate=True).withColumn("notes", F.array_join("notes", "|")))
query(
    "rsn_03_property_assertions",
    f""", {_PROPS}, {_INVERSE}, step AS (SELECT prop, over AS next, false AS flip FROM ab UNION SELECT prop, back, true FROM iv),
    k AS (SELECT s AS subject, p AS prop, o AS object FROM t WHERE s_kind = 'iri' AND o_kind = 'iri' AND p IN (SELECT iri FROM decl WHERE kind = 'object-property')
    UNION SELECT CASE WHEN flip THEN k.object ELSE k.subject END, step.next, CASE WHEN flip THEN k.subject ELSE k.object END FROM k JOIN step ON step.prop = k.prop) SELECT subject, prop, object FROM k""",
    True,
)(reason.property_assertions)
query("rsn_13_incoherent_module")(lambda o: reason.incoherent_module(o).select("ax_type", "subject", "property", "object").distinct())
query(
    "rsn_16_axiom_impact",
    f""", {_ABOVE.split(", up AS")[0]}, pt AS (SELECT [child, parent] AS path, parent AS node FROM told WHERE child = '{EX}part/1' UNION ALL SELECT list_append(path, x.parent), x.parent FROM pt JOIN told x ON x.child = pt.node WHERE pt.node <> '{EX}product' AND NOT list_contains(path, x.parent)),
    best AS (SELECT path FROM pt WHERE node = '{EX}product' ORDER BY len(path), path LIMIT 5), link AS (SELECT path, unnest(range(1, len(path))) AS i FROM best)
    SELECT path[i] AS subject, path[i + 1] AS object, CAST(count(*) AS BIGINT) AS uses FROM link GROUP BY path[i], path[i + 1]""",
    True,
)(lambda o: reason.axiom_impact(reason.explanations(o, f"{EX}part/1", f"{EX}product", 5)))
_OP = "regexp_extract(object, '^(some|all|and|or)\\(', 1)"
_SIDES = f"""pol AS (SELECT * FROM (
        SELECT ax_type, subject, property, object, raw_s AS expr, u.side FROM axr, (VALUES ('sub'), ('super')) u(side) WHERE s_kind = 'bnode' AND (u.side = 'sub' OR ax_type = 'EquivalentClasses')
        UNION SELECT ax_type, subject, property, object, raw_o, u.side FROM axr, (VALUES ('sub'), ('super')) u(side) WHERE object_kind = 'bnode' AND ax_type IN ('SubClassOf', 'EquivalentClasses', 'DisjointClasses', 'PropertyDomain', 'PropertyRange', 'ClassAssertion')
            AND (ax_type = 'EquivalentClasses' OR (u.side = 'sub') = (ax_type = 'DisjointClasses'))
        UNION SELECT ax_type, subject, property, object, mt.member, 'sub' FROM op JOIN mt ON mt.owner = op.owner AND mt.p = op.property WHERE mt.kind = 'bnode') z
    UNION SELECT pol.ax_type, pol.subject, pol.property, pol.object, xpart.part, CASE WHEN spec.op <> 'not' THEN pol.side WHEN pol.side = 'sub' THEN 'super' ELSE 'sub' END FROM pol JOIN spec ON spec.expr = pol.expr JOIN xpart ON xpart.expr = pol.expr AND xpart.kind = 'bnode'),
    shp AS (SELECT pol.*, spec.op, spec.n, (SELECT count(DISTINCT part) FROM xpart WHERE xpart.expr = pol.expr) AS size, (SELECT count(*) FROM xpart WHERE xpart.expr = pol.expr AND xpart.kind = 'bnode') = 0 AS plain, (SELECT max(part) FROM xpart WHERE xpart.expr = pol.expr) = '{V.THING}' AS thing FROM pol JOIN spec ON spec.expr = pol.expr)"""


def _profile_sql(profile: str, more: str) -> str:
    allowed = f"((side = 'sub' AND op IN {_in(reason._ALLOWED[profile]['sub'])}) OR (side = 'super' AND op IN {_in(reason._ALLOWED[profile]['super'])})) AND NOT ({more})"
    return f"SELECT '{profile}' AS profile, ax_type, subject, object FROM ax WHERE ax_type IN {_in(reason._OUTSIDE[profile])} UNION SELECT '{profile}', ax_type, subject, object FROM shp WHERE NOT ({allowed})"


query(
    "rsn_17_profiles",
    f", {_SIDES} " + " UNION ".join([_profile_sql("EL", "op = 'one' AND size > 1"), _profile_sql("QL", "op = 'some' AND CASE WHEN side = 'sub' THEN NOT thing ELSE NOT plain END"), _profile_sql("RL", "op = 'max' AND CAST(n AS BIGINT) > 1")]),
    True,
)(lambda o: setops.reduce(DataFrame.unionByName, [reason.profile_violations(o, p).select(F.lit(p).alias("profile"), "ax_type", "subject", "object") for p in ("EL", "QL", "RL")]))
_WRONG = lambda p, more: f"SELECT count(*) FROM (SELECT DISTINCT ax_type, subject, object FROM ({_profile_sql(p, more)}) x) y"
_NOT = {"EL": "op = 'one' AND size > 1", "QL": "op = 'some' AND CASE WHEN side = 'sub' THEN NOT thing ELSE NOT plain END", "RL": "op = 'max' AND CAST(n AS BIGINT) > 1"}
query("agg_05_el_profile", f", {_SIDES} " + " UNION ALL ".join([_metric("el_violation_count", _WRONG("EL", _NOT["EL"])), *[_metric(f"owl2_{p.lower()}", f"SELECT count(*) = 0 FROM ({_profile_sql(p, m)}) x") for p, m in _NOT.items()]]), True)(metrics.el_profile)
query("agg_19_nominals_and_gcis", _metric("tbox_nominal_count", f"SELECT count(DISTINCT x.s) FROM t x JOIN t y ON y.o = x.s WHERE x.p IN {_in([V.OWL + 'oneOf', V.OWL + 'hasValue'])} AND y.p IN {_in([V.SUBCLASS, V.EQUIVALENT, V.DISJOINT])}") + " UNION ALL " + _metric("gci_count", f"SELECT count(*) FROM t WHERE p = '{V.SUBCLASS}' AND s_kind = 'bnode'"))(
    metrics.nominals_and_gcis
)
query("agg_24_reasoner")(metrics.reasoner_metrics)

# Patterns, reports, steps ---------------------------------------------------------------------------------------------


def _expanded(ont: Ontology) -> DataFrame:
    """Two macros for restrictions, one of them left out."""
    g = _g(ont)
    on = lambda p: g.match(("?c", "owl:equivalentClass", "?r"), ("?r", "owl:onProperty", p), ("?r", "owl:someValuesFrom", "?f"))
    macros = {p: (on(p), [("?c", "ex:related_to", "?f")]) for p in ("ex:part_of", "ex:old_relation")}
    return patterns.expand_macros(g, macros, exclude=["ex:old_relation"], source="dcterms:source")


_RELATED = f"rl AS (SELECT DISTINCT x.s AS c, f.o AS f FROM t x JOIN t r ON r.s = x.o JOIN t f ON f.s = x.o WHERE x.p = '{V.EQUIVALENT}' AND r.p = '{V.ON_PROPERTY}' AND r.o = '{EX}part_of' AND f.p = '{V.SOME}')"
query("spq_08_expand", f", {_RELATED} SELECT '<' || c || '>' AS s, '<{EX}related_to>' AS p, '<' || f || '>' AS o FROM rl UNION SELECT '<' || c || '>', '<{V.DCTERMS}source>', '<{EX}part_of>' FROM rl")(_expanded)


def _many(ont: Ontology) -> DataFrame:
    g = _g(ont)
    asked = {"labels": g.match(("?s", "rdfs:label", "?v")).select("?s", "?v"), "comments": g.match(("?s", "rdfs:comment", "?v")).select("?s", "?v")}
    places = patterns.write_all(asked, store.new_path(ont.spark, "queries"), "json")
    return patterns.verify({name: files.read_rows(ont.spark, place, "json") for name, place in places.items()})


query("spq_09_many_queries", f"SELECT 'labels' AS rule, CAST(count(*) AS BIGINT) AS violations FROM t WHERE p = '{V.LABEL}' UNION ALL SELECT 'comments', count(*) FROM t WHERE p = '{V.COMMENT}'")(_many)


def _failing(ont: Ontology) -> DataFrame:
    rows = settle(report.report(ont.triples, _PROFILE), "report")
    return ont.spark.createDataFrame([(level, report.fails(rows, level)) for level in ("none", "error", "warn", "info")], "fail_on string, fails boolean")




def _report_file(ont: Ontology) -> DataFrame:
    """The report written as a table with tabs and read again."""
    path = f"{store.new_path(ont.spark, 'report')}.tsv"
    report.write(report.report(ont.triples, _PROFILE), path)
    return files.read_rows(ont.spark, path, "tsv").toDF("level", "rule", "entity", "property", "value")


query("snk_11_report_file", f", {_report_sql()} SELECT level, rule, coalesce(entity, '') AS entity, coalesce(property, '') AS property, coalesce(value, '') AS value FROM rep")(_report_file)
query("rpt_03_fail_on", f", {_report_sql()} SELECT 'none' AS fail_on, false AS fails UNION ALL SELECT 'error', count(*) FILTER (level = 'ERROR') > 0 FROM rep UNION ALL SELECT 'warn', count(*) FILTER (level IN ('ERROR', 'WARN')) > 0 FROM rep UNION ALL SELECT 'info', count(*) > 0 FROM rep")(_failing)
query("prj_07_sorted_top", f", {_LB} SELECT c.iri AS iri, coalesce(lb.label, '') AS label FROM (SELECT iri FROM decl WHERE kind = 'class') c LEFT JOIN lb ON lb.iri = c.iri ORDER BY coalesce(lb.label, '') = '', label, c.iri DESC LIMIT 100")(
    lambda o: export.sorted_table(_table(o, ["IRI", "LABEL"], ["classes"]), ["^iri", "label"]).limit(100)
)


def _own_rule(ont: Ontology) -> DataFrame:
    report.register_rule("shouting_label", lambda g: rules.violations(g.with_p(V.LABEL).where("o_kind = 'lit' AND o = upper(o) AND o <> lower(o)")))
    return report.report(ont.triples, {"shouting_label": "INFO"})


query("ext_02_own_rule", f"SELECT DISTINCT 'INFO' AS level, 'shouting_label' AS rule, s AS entity, p AS property, o AS value FROM t WHERE p = '{V.LABEL}' AND o_kind = 'lit' AND o = upper(o) AND o <> lower(o) AND NOT contains(s, '/rdf-schema#') AND NOT contains(s, '/owl#')")(_own_rule)
query("ext_01_chain_of_steps", f"SELECT DISTINCT CASE WHEN starts_with(s, '{EX}') THEN 'urn:x:' || substr(s, {len(EX) + 1}) ELSE s END AS s, p, CASE WHEN o_kind = 'iri' AND starts_with(o, '{EX}') THEN 'urn:x:' || substr(o, {len(EX) + 1}) ELSE o END AS o FROM t WHERE p = '{V.SUBCLASS}' UNION SELECT 'urn:x:onto', '{V.COMMENT}', 'renamed'")(
    lambda o: pipeline.Chain(o.with_p(V.SUBCLASS)).then("rename-prefixes", prefixes={EX: "urn:x:"}).then("annotate", ontology_iri="urn:x:onto", literals={V.COMMENT: "renamed"}).triples.select("s", "p", "o")
)

# Templates ------------------------------------------------------------------------------------------------------------
_SPO = ["s", "p", "o"]


def _labels_of(ont: Ontology, kind: str) -> DataFrame:
    return ont.with_p(V.LABEL).where(F.col("s").startswith(f"{EX}{kind}/")).select(F.col("s").alias("ID"), F.col("o").alias("Label"))


query(
    "tpl_05_property_rows",
    f""", pe AS (SELECT DISTINCT p AS s FROM triples WHERE graph <> 'root') SELECT s, '{V.TYPE}' AS p, '{V.OBJECT_PROPERTY}' AS o FROM pe UNION SELECT s, '{V.SUBPROPERTY}', '{EX}part_of' FROM pe UNION SELECT s, '{V.DOMAIN}', '{EX}product' FROM pe
    UNION SELECT s, '{V.TYPE}', '{V.OWL}FunctionalProperty' FROM pe UNION SELECT s, '{V.TYPE}', '{V.OWL}TransitiveProperty' FROM pe""",
)(lambda o: template.template(o.triples.where("graph <> 'root'").select(F.col("p").alias("ID"), F.lit("object property").alias("Kind"), F.lit("ex:part_of").alias("Above"), F.lit("ex:product").alias("Of"), F.lit("functional|transitive").alias("Is")).distinct(), ["ID", "TYPE", "SP %", "DOMAIN", "CHARACTERISTIC SPLIT=|"])[0].select(*_SPO))
_ORDERS = f"ord AS (SELECT DISTINCT x.s, x.o AS cust, y.o AS priority FROM t x JOIN t y ON y.s = x.s WHERE x.p = '{V.TYPE}' AND {starts('customer', 'x.o')} AND y.p = '{EX}priority')"
query("tpl_08_individual_rows", f", {_ORDERS} SELECT s, '{V.TYPE}' AS p, '{V.INDIVIDUAL}' AS o FROM ord UNION SELECT s, '{V.TYPE}', cust FROM ord UNION SELECT s, '{EX}urgency', priority FROM ord UNION SELECT s, '{EX}part_of', cust FROM ord")(
    lambda o: template.template(
        o.with_p(V.TYPE).where(F.col("o").startswith(f"{EX}customer/")).select(F.col("s").alias("ID"), F.col("o").alias("Type"), F.col("o").alias("Whole")).join(o.with_p(EX + "priority").select(F.col("s").alias("ID"), F.col("o").alias("Urgency")), "ID"),
        ["ID", "TYPE", "I ex:part_of", "A ex:urgency"],
    )[0].select(*_SPO)
)
_NAMES = f"nm AS (SELECT DISTINCT s, o AS l FROM t WHERE p = '{V.LABEL}' AND {starts('part', 's')})"
query(
    "tpl_09_annotation_columns",
    f""", {_NAMES} SELECT s, '{V.TYPE}' AS p, '{V.CLASS}' AS o, '' AS o_dt, '' AS o_lang FROM nm UNION SELECT s, '{V.LABEL}', l, '{V.XSD_STRING}', '' FROM nm UNION SELECT s, '{V.COMMENT}', l, '{V.LANG_STRING}', 'en' FROM nm
    UNION SELECT s, '{EX}length', CAST(length(l) AS VARCHAR), '{V.XSD_INTEGER}', '' FROM nm UNION SELECT s, '{V.SEE_ALSO}', '{EX}region/0', '', '' FROM nm UNION SELECT s, '{V.SEE_ALSO}', '{EX}region/1', '', '' FROM nm""",
)(lambda o: _shown(template.template(_labels_of(o, "part").withColumn("Text", F.col("Label")).withColumn("Length", F.length("Label").cast("string")).withColumn("See", F.lit("ex:region/0|ex:region/1")), ["ID", "LABEL", "AL rdfs:comment@en", "AT ex:length^^xsd:integer", "AI rdfs:seeAlso SPLIT=|"])[0]))
query("tpl_10_axiom_annotations", f", {_NAMES} SELECT s, '{V.COMMENT}' AS p, l AS o, '{V.SEE_ALSO}=note on ' || l AS notes FROM nm")(
    lambda o: Ontology(template.template(_labels_of(o, "part").withColumn("Note", F.concat(F.lit("note on "), F.col("Label"))), ["ID", "A rdfs:comment", ">A rdfs:seeAlso"])[0]).notes.withColumn("notes", F.array_join("notes", "|"))
)


def _two_tables(ont: Ontology) -> DataFrame:
    """Copies of the nations, and suppliers whose parents are named by the labels of these copies."""
    nations = _labels_of(ont, "nation")
    first = nations.select(F.replace("ID", F.lit("/nation/"), F.lit("/copy/")).alias("ID"), "Label")
    edges = ont.edges.where(F.col("child").startswith(f"{EX}supplier/")).select(F.col("child").alias("ID"), F.col("parent").alias("nation"))
    second = edges.join(nations.select(F.col("ID").alias("nation"), F.col("Label").alias("Parent")), "nation").select("ID", "Parent")
    return template.chain([(first, ["ID", "LABEL"]), (second, ["ID", "SC %"])])[0].select(*_SPO)


query("tpl_03_chain_of_tables", f"SELECT replace(s, '/nation/', '/copy/') AS s, '{V.TYPE}' AS p, '{V.CLASS}' AS o FROM t WHERE p = '{V.LABEL}' AND {starts('nation', 's')} UNION SELECT replace(s, '/nation/', '/copy/'), p, o FROM t WHERE p = '{V.LABEL}' AND {starts('nation', 's')} UNION SELECT child, '{V.TYPE}', '{V.CLASS}' FROM e WHERE o_kind = 'iri' AND {starts('supplier', 'child')} UNION SELECT child, '{V.SUBCLASS}', replace(parent, '/nation/', '/copy/') FROM e WHERE o_kind = 'iri' AND {starts('supplier', 'child')}")(_two_tables)
query("tpl_13_merged_with_input", f"SELECT s, p, o FROM t WHERE {starts('part', 's')} AND p = '{V.LABEL}' UNION SELECT s, '{V.COMMENT}', o FROM t WHERE {starts('part', 's')} AND p = '{V.LABEL}' UNION SELECT s, '{V.TYPE}', '{V.CLASS}' FROM t WHERE {starts('part', 's')} AND p = '{V.LABEL}'")(
    lambda o: setops.merge(o.with_p(V.LABEL).where(F.col("s").startswith(f"{EX}part/")), template.template(_labels_of(o, "part"), ["ID", "A rdfs:comment"])[0]).select(*_SPO).distinct()
)
