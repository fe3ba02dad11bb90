"""Direct mapping of relational tables to triples, as one SQL text that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axiograph.functions import vocab as V

TABLES = "region nation customer supplier part orders documents labels pages conversations events".split()
COLUMNS = "graph, s, s_kind, p, o, o_kind, o_dt, o_lang"
_EX = V.EX


def iri(kind: str, key: str) -> str:
    return f"'{_EX}{kind}/' || CAST({key} AS STRING)"


def _row(table: str | None, s: str, p: str, o: str, kind: str = "iri", dt: str | None = None, lang: str = "CAST(NULL AS STRING)", where: str | None = None, s_kind: str = "iri", graph: str = "'root'") -> str:
    dt_sql = f"'{dt or V.XSD_STRING}'" if kind == "lit" and dt != "lang" else f"'{V.LANG_STRING}'" if kind == "lit" else "CAST(NULL AS STRING)"
    source = f" FROM {{{table}}}" if table else ""
    return f"SELECT {graph} AS graph, {s} AS s, '{s_kind}' AS s_kind, {p if p.startswith(chr(39)) else repr(p)} AS p, {o} AS o, '{kind}' AS o_kind, {dt_sql} AS o_dt, {lang} AS o_lang{source}" + (f" WHERE {where}" if where else "")


def _fixed() -> list[str]:
    """Declarations and a few statements about properties and ontologies."""
    part_of, old, old_sub, weight = (_EX + x for x in ("part_of", "old_relation", "old_sub", "weight"))
    rows = [
        (_EX + "onto", V.TYPE, V.ONTOLOGY), (_EX + "onto", V.DC + "title", ("A test bed", V.XSD_STRING)), (_EX + "onto", V.IMPORTS, _EX + "import"),
        (_EX + "onto", V.VERSION, _EX + "onto/1"), (_EX + "import", V.TYPE, V.ONTOLOGY),
        (part_of, V.TYPE, V.OBJECT_PROPERTY), (part_of, V.LABEL, ("part of", V.XSD_STRING)), (part_of, V.TYPE, V.OWL + "TransitiveProperty"),
        (part_of, V.DOMAIN, _EX + "type/ECONOMY"), (part_of, V.RANGE, _EX + "type/LARGE"),
        (old, V.TYPE, V.OBJECT_PROPERTY), (old, V.DEPRECATED, ("true", V.XSD_BOOLEAN)), (old_sub, V.TYPE, V.OBJECT_PROPERTY), (old_sub, V.SUBPROPERTY, old),
        (_EX + "new_relation", V.TYPE, V.OBJECT_PROPERTY), (_EX + "new_relation", V.SUBPROPERTY, part_of), (_EX + "new_relation", V.INVERSE, old),
        (_EX + "nation/1", old, _EX + "nation/2"), (weight, V.TYPE, V.DATA_PROPERTY), (weight, V.LABEL, ("weight", V.XSD_STRING)), (weight, V.SUBPROPERTY, _EX + "measure"), (_EX + "measure", V.TYPE, V.DATA_PROPERTY),
        (V.DEFINITION, V.TYPE, V.ANNOTATION_PROPERTY), (V.LABEL, V.TYPE, V.ANNOTATION_PROPERTY), (V.EXACT, V.TYPE, V.ANNOTATION_PROPERTY), (V.RELATED, V.TYPE, V.ANNOTATION_PROPERTY), (_EX + "said", V.TYPE, V.ANNOTATION_PROPERTY),
        (V.TYPE, V.LABEL, ("type", V.XSD_STRING)),
        *[(f"{_EX}loop/{i}", V.TYPE, V.CLASS) for i in range(3)], *[(f"{_EX}loop/{i}", V.SUBCLASS, f"{_EX}loop/{(i + 1) % 3}") for i in range(3)],
        (_EX + "product", V.SUBCLASS, V.THING), (_EX + "located_in", V.TYPE, V.OBJECT_PROPERTY), (_EX + "measured", V.TYPE, V.OBJECT_PROPERTY),
        (_EX + "impossible", V.TYPE, V.OBJECT_PROPERTY), (_EX + "impossible", V.DOMAIN, _EX + "zone/0"), (_EX + "impossible", V.DOMAIN, _EX + "zone/1"),
        *[(f"{_EX}subset/src{i}", V.SUBPROPERTY, V.SUBSET_PROPERTY) for i in range(10)],
    ]
    blank = [("_:chain1", V.FIRST, part_of), ("_:chain1", V.REST, "_:chain2"), ("_:chain2", V.FIRST, _EX + "new_relation"), ("_:chain2", V.REST, V.NIL), ("_:zones", V.TYPE, V.ALL_DISJOINT), ("_:zones", V.MEMBERS, "_:zl0")]
    chain = [_row(None, f"'{_EX}located_in'", V.CHAIN, "'_:chain1'", "bnode")]
    chain += [_row(None, f"'{s}'", p, f"'{o}'", "bnode" if o.startswith("_:") else "iri", s_kind="bnode") for s, p, o in blank]
    return chain + [_row(None, f"'{s}'", p, f"'{o}'" if isinstance(o, str) else f"'{o[0]}'", *(("iri",) if isinstance(o, str) else ("lit", o[1]))) for s, p, o in rows]


def _tables() -> list[str]:
    nation, region, part, doc = iri("nation", "n_nationkey"), iri("region", "r_regionkey"), iri("part", "p_partkey"), iri("doc", "doc_id")
    supplier, customer, order = iri("supplier", "s_suppkey"), iri("customer", "c_custkey"), iri("order", "o_orderkey")
    brand, kind = f"'{_EX}brand/' || replace(p_brand, '#', '')", f"'{_EX}type/' || replace(p_type, ' ', '_')"
    blank = lambda tag, key: f"'_:{tag}' || CAST({key} AS STRING)"
    name = "coalesce(source, 'none') || ' ' || CAST(doc_id AS STRING)"
    group, chain, next_nation = iri("group", "n_nationkey"), iri("chain", "n_nationkey"), iri("nation", "(n_nationkey + 1) % 25")
    cls = lambda table, s, where=None: _row(table, s, V.TYPE, f"'{V.CLASS}'", where=where)
    zone, site, next_zone = iri("zone", "r_regionkey"), iri("site", "r_regionkey"), iri("zone", "(r_regionkey + 1) % 5")
    b_row = lambda table, s, p, o, kind="iri", dt=None, **more: _row(table, s, p, o, kind, dt, s_kind="bnode", **more)
    busy, not_last = "c_mktsegment = 'BUILDING'", "r_regionkey < 4"
    return [
        # zones: axioms without a named subject, of several operands and with every constructor
        cls("region", zone), _row("region", zone, V.SUBCLASS, region), _row("region", site, V.TYPE, f"'{V.INDIVIDUAL}'"), _row("region", site, V.TYPE, zone),
        b_row("region", blank("lost", "r_regionkey"), V.SOME, zone),  # a filler without a property, which no axiom takes up
        b_row("region", blank("zl", "r_regionkey"), V.FIRST, zone), b_row("region", blank("zl", "r_regionkey"), V.REST, blank("zl", "r_regionkey + 1"), "bnode", where=not_last), b_row("region", blank("zl", "r_regionkey"), V.REST, f"'{V.NIL}'", where="r_regionkey = 4"),
        b_row("region", blank("gz", "r_regionkey"), V.SUBCLASS, iri("within", "r_regionkey")), cls("region", iri("within", "r_regionkey")), b_row("region", blank("gz", "r_regionkey"), V.ON_PROPERTY, f"'{_EX}part_of'"), b_row("region", blank("gz", "r_regionkey"), V.SOME, zone),
        _row("region", zone, V.SUBCLASS, blank("nz", "r_regionkey"), "bnode"), b_row("region", blank("nz", "r_regionkey"), V.COMPLEMENT, next_zone),
        _row("region", zone, V.SUBCLASS, blank("vz", "r_regionkey"), "bnode"), b_row("region", blank("vz", "r_regionkey"), V.ON_PROPERTY, f"'{_EX}measured'"), b_row("region", blank("vz", "r_regionkey"), V.VALUE, site),
        _row("region", zone, V.SUBCLASS, blank("mz", "r_regionkey"), "bnode"), b_row("region", blank("mz", "r_regionkey"), V.ON_PROPERTY, f"'{_EX}measured'"), b_row("region", blank("mz", "r_regionkey"), V.OWL + "minQualifiedCardinality", "'2'", "lit", V.XSD + "nonNegativeInteger"), b_row("region", blank("mz", "r_regionkey"), V.ON_CLASS, next_zone),
        _row("region", iri("plot", "r_regionkey"), V.EQUIVALENT, blank("oz", "r_regionkey"), "bnode"), cls("region", iri("plot", "r_regionkey")), b_row("region", blank("oz", "r_regionkey"), V.ONE_OF, blank("ol", "r_regionkey"), "bnode"), b_row("region", blank("ol", "r_regionkey"), V.FIRST, site), b_row("region", blank("ol", "r_regionkey"), V.REST, f"'{V.NIL}'"),
        # customers under nested expressions: part of something that is a nation and part of the next one
        _row("customer", customer, V.SUBCLASS, blank("w", "c_custkey"), "bnode", where=busy), b_row("customer", blank("w", "c_custkey"), V.ON_PROPERTY, f"'{_EX}part_of'", where=busy), b_row("customer", blank("w", "c_custkey"), V.SOME, blank("wi", "c_custkey"), "bnode", where=busy),
        b_row("customer", blank("wi", "c_custkey"), V.INTERSECTION, blank("wl", "c_custkey"), "bnode", where=busy), b_row("customer", blank("wl", "c_custkey"), V.FIRST, iri("nation", "c_nationkey"), where=busy), b_row("customer", blank("wl", "c_custkey"), V.REST, blank("wm", "c_custkey"), "bnode", where=busy),
        b_row("customer", blank("wm", "c_custkey"), V.FIRST, blank("ws", "c_custkey"), "bnode", where=busy), b_row("customer", blank("wm", "c_custkey"), V.REST, f"'{V.NIL}'", where=busy), b_row("customer", blank("ws", "c_custkey"), V.ON_PROPERTY, f"'{_EX}located_in'", where=busy), b_row("customer", blank("ws", "c_custkey"), V.SOME, iri("nation", "(c_nationkey + 1) % 25"), where=busy),
        cls("region", region), _row("region", region, V.LABEL, "r_name", "lit"),
        cls("nation", nation), _row("nation", nation, V.LABEL, "n_name", "lit"), _row("nation", nation, V.SUBCLASS, iri("region", "n_regionkey")),
        # definitions by an intersection, by an edge and along a transitive property, and classes that can have no member
        cls("nation", group), _row("nation", group, V.EQUIVALENT, blank("g", "n_nationkey"), "bnode"), _row("nation", blank("g", "n_nationkey"), V.INTERSECTION, blank("lg", "n_nationkey"), "bnode", s_kind="bnode"),
        _row("nation", blank("lg", "n_nationkey"), V.RDF + "first", nation, s_kind="bnode"), _row("nation", blank("lg", "n_nationkey"), V.RDF + "rest", blank("mg", "n_nationkey"), "bnode", s_kind="bnode"),
        _row("nation", blank("mg", "n_nationkey"), V.RDF + "first", blank("rg", "n_nationkey"), "bnode", s_kind="bnode"), _row("nation", blank("mg", "n_nationkey"), V.RDF + "rest", f"'{V.RDF}nil'", s_kind="bnode"),
        _row("nation", blank("rg", "n_nationkey"), V.ON_PROPERTY, f"'{_EX}part_of'", s_kind="bnode"), _row("nation", blank("rg", "n_nationkey"), V.SOME, next_nation, s_kind="bnode"),
        cls("nation", chain), _row("nation", chain, V.EQUIVALENT, blank("c", "n_nationkey"), "bnode"), _row("nation", blank("c", "n_nationkey"), V.ON_PROPERTY, f"'{_EX}part_of'", s_kind="bnode"), _row("nation", blank("c", "n_nationkey"), V.SOME, nation, s_kind="bnode"),
        _row("nation", nation, V.SUBCLASS, blank("h", "n_nationkey"), "bnode", where="n_nationkey % 2 = 0"), _row("nation", blank("h", "n_nationkey"), V.ON_PROPERTY, f"'{_EX}part_of'", where="n_nationkey % 2 = 0", s_kind="bnode"), _row("nation", blank("h", "n_nationkey"), V.SOME, next_nation, where="n_nationkey % 2 = 0", s_kind="bnode"),
        _row("nation", nation, V.DISJOINT, next_nation, where="n_nationkey % 5 = 1"),
        _row("supplier", supplier, V.SUBCLASS, blank("q", "s_suppkey"), "bnode", where="s_suppkey % 3 = 0"), _row("supplier", blank("q", "s_suppkey"), V.ON_PROPERTY, f"'{_EX}part_of'", where="s_suppkey % 3 = 0", s_kind="bnode"), _row("supplier", blank("q", "s_suppkey"), V.SOME, iri("nation", "(s_nationkey + 1) % 25"), where="s_suppkey % 3 = 0", s_kind="bnode"),
        cls("supplier", supplier), _row("supplier", supplier, V.LABEL, "s_name", "lit"), _row("supplier", supplier, V.SUBCLASS, iri("nation", "s_nationkey")),
        _row("supplier", supplier, V.SUBCLASS, iri("nation", "(s_nationkey + 1) % 25"), where="s_suppkey % 7 = 0"),
        cls("customer", customer), _row("customer", customer, V.LABEL, "c_name", "lit"), _row("customer", customer, V.SUBCLASS, iri("nation", "c_nationkey")),
        _row("customer", customer, V.COMMENT, "c_mktsegment", "lit"),
        cls("part", part), _row("part", part, V.LABEL, "p_name", "lit"), _row("part", part, V.SUBCLASS, brand), _row("part", part, V.SUBCLASS, kind),
        _row("part", part, _EX + "size", "CAST(p_size AS STRING)", "lit", V.XSD_INTEGER),
        _row("part", part, V.DEPRECATED, "'true'", "lit", V.XSD_BOOLEAN, where="p_partkey % 23 = 0"),
        _row("part", part, V.EQUIVALENT, blank("r", "p_partkey"), "bnode", where="p_size <= 5"),
        _row("part", blank("r", "p_partkey"), V.TYPE, f"'{V.RESTRICTION}'", where="p_size <= 5", s_kind="bnode"),
        _row("part", blank("r", "p_partkey"), V.ON_PROPERTY, f"'{_EX}part_of'", where="p_size <= 5 AND p_partkey % 5 <> 0", s_kind="bnode"),
        _row("part", blank("r", "p_partkey"), V.ON_PROPERTY, f"'{_EX}old_relation'", where="p_size <= 5 AND p_partkey % 5 = 0", s_kind="bnode"),
        _row("part", blank("r", "p_partkey"), V.SOME, iri("part", "p_partkey + 1"), where="p_size <= 5", s_kind="bnode"),
        _row("part", part, V.EQUIVALENT, iri("part", "p_partkey + 1"), where="p_size BETWEEN 6 AND 10"),
        *[_row("part", part, V.EQUIVALENT, blank(f"{t}", "p_partkey"), "bnode", where="p_size BETWEEN 11 AND 15") for t in ("i", "j")],
        *[_row("part", blank(f"{t}", "p_partkey"), V.INTERSECTION, blank(f"l{t}", "p_partkey"), "bnode", where="p_size BETWEEN 11 AND 15", s_kind="bnode") for t in ("i", "j")],
        *[x for t in ("i", "j") for x in (
            _row("part", blank(f"l{t}", "p_partkey"), V.RDF + "first", brand if t == "i" else kind, where="p_size BETWEEN 11 AND 15", s_kind="bnode"), _row("part", blank(f"l{t}", "p_partkey"), V.RDF + "rest", blank(f"m{t}", "p_partkey"), "bnode", where="p_size BETWEEN 11 AND 15", s_kind="bnode"),
            _row("part", blank(f"m{t}", "p_partkey"), V.RDF + "first", iri("part", "p_partkey + 3"), where="p_size BETWEEN 11 AND 15", s_kind="bnode"), _row("part", blank(f"m{t}", "p_partkey"), V.RDF + "rest", f"'{V.RDF}nil'", where="p_size BETWEEN 11 AND 15", s_kind="bnode"))],
        _row("part", part, V.EQUIVALENT, blank("u", "p_partkey"), "bnode", where="p_size BETWEEN 9 AND 11"),
        _row("part", blank("u", "p_partkey"), V.UNION, blank("lu", "p_partkey"), "bnode", where="p_size BETWEEN 9 AND 11", s_kind="bnode"),
        _row("part", part, V.DISJOINT, iri("part", "p_partkey + 2"), where="p_size BETWEEN 16 AND 18"),
        "SELECT DISTINCT * FROM (" + cls("part", brand) + ") x1", "SELECT DISTINCT * FROM (" + cls("part", kind) + ") x2",
        "SELECT DISTINCT * FROM (" + _row("part", kind, V.LABEL, "p_type", "lit") + ") x3",
        "SELECT DISTINCT * FROM (" + _row("part", brand, V.SUBCLASS, f"'{_EX}product'") + ") x4",
        "SELECT DISTINCT * FROM (" + _row("part", kind, V.SUBCLASS, f"'{_EX}product'") + ") x5",
        _row("orders", order, V.TYPE, f"'{V.INDIVIDUAL}'"), _row("orders", order, V.TYPE, iri("customer", "o_custkey")),
        _row("orders", order, _EX + "priority", "o_orderpriority", "lit"),
        cls("documents", doc), _row("documents", doc, V.LABEL, name, "lit", where="doc_id % 97 <> 0"),
        _row("documents", doc, V.LABEL, "text", "lit", where="doc_id % 31 = 7 AND text IS NOT NULL"),
        _row("documents", doc, V.LABEL, "'obsolete item ' || CAST(doc_id AS STRING)", "lit", where="doc_id % 97 = 0"),
        _row("documents", doc, V.LABEL, "upper(source)", "lit", where="doc_id % 31 = 0"),
        _row("documents", doc, V.DEFINITION, "text", "lit", "lang", "lang", where="text IS NOT NULL"),
        _row("documents", doc, V.DEFINITION, "text", "lit", where="doc_id % 11 = 0 AND text IS NOT NULL"),
        _row("documents", doc, V.REPLACED_BY, iri("doc", "doc_id + 1"), where="doc_id % 5 = 1"),
        _row("documents", doc, V.EXACT, "source", "lit", where="doc_id % 3 = 0"), _row("documents", doc, V.RELATED, "source", "lit", where="doc_id % 6 = 0"),
        _row("documents", doc, V.EXACT, name, "lit", where="doc_id % 13 = 0"),
        _row("documents", doc, V.SUBSET, f"'{_EX}subset/' || source", where="doc_id % 2 = 0"),
        _row("documents", blank("a", "doc_id"), V.TYPE, f"'{V.AXIOM}'", where="doc_id % 9 = 0", s_kind="bnode"),
        _row("documents", blank("a", "doc_id"), V.ANN_SOURCE, doc, where="doc_id % 9 = 0", s_kind="bnode"),
        _row("documents", blank("a", "doc_id"), V.ANN_PROPERTY, f"'{V.EXACT}'", where="doc_id % 9 = 0", s_kind="bnode"),
        _row("documents", blank("a", "doc_id"), V.ANN_TARGET, "source", "lit", where="doc_id % 9 = 0", s_kind="bnode"),
        _row("documents", blank("a", "doc_id"), V.SYNONYM_TYPE, f"'{V.ACRONYM}'", where="doc_id % 18 = 0", s_kind="bnode"),
        _row("documents", blank("a", "doc_id"), V.SYNONYM_TYPE, f"'{_EX}syntype/' || lang", where="doc_id % 18 = 9", s_kind="bnode"),
        _row("supplier", blank("s", "s_suppkey"), V.TYPE, f"'{V.AXIOM}'", where="s_suppkey % 14 = 0", s_kind="bnode"),
        _row("supplier", blank("s", "s_suppkey"), V.ANN_SOURCE, supplier, where="s_suppkey % 14 = 0", s_kind="bnode"),
        _row("supplier", blank("s", "s_suppkey"), V.ANN_PROPERTY, f"'{V.SUBCLASS}'", where="s_suppkey % 14 = 0", s_kind="bnode"),
        _row("supplier", blank("s", "s_suppkey"), V.ANN_TARGET, iri("nation", "s_nationkey"), where="s_suppkey % 14 = 0", s_kind="bnode"),
        _row("supplier", blank("s", "s_suppkey"), V.IS_INFERRED, "'true'", "lit", where="s_suppkey % 14 = 0", s_kind="bnode"),
        _row("labels", doc, V.DEPRECATED, "'true'", "lit", V.XSD_BOOLEAN, where="toxic = 1 AND quality = 1"),
        _row("labels", doc, V.DEPRECATED, "'true'", "lit", V.XSD_STRING, where="toxic = 1 AND quality = 0"),
        _row("labels", doc, _EX + "quality", "CAST(quality AS STRING)", "lit", V.XSD_INTEGER),
        _row("pages", iri("doc", "page_id"), V.XREF, "url", "lit"), _row("pages", iri("doc", "page_id"), V.XREF, "'page ' || CAST(page_id AS STRING)", "lit", where="page_id % 3 = 0"), _row("pages", iri("doc", "page_id"), V.XREF, "'PAGE:' || CAST(page_id AS STRING)", "lit"),
        cls("pages", "'http://purl.org/obo/X_' || CAST(page_id AS STRING)", where="page_id % 25 = 0"),
        _row("pages", "'http://purl.org/obo/X_' || CAST(page_id AS STRING)", V.LABEL, "' page ' || CAST(page_id AS STRING)", "lit", where="page_id % 25 = 0"),
        "SELECT DISTINCT * FROM (" + _row("conversations", iri("conv", "conv_id"), V.TYPE, f"'{V.INDIVIDUAL}'") + ") x6",
        _row("conversations", iri("conv", "conv_id"), _EX + "said", "text", "lit", where="text IS NOT NULL"),
        _row("events", iri("user", "user_id"), f"'{_EX}event/' || event_type", "CAST(event_id AS STRING)", "lit", V.XSD_INTEGER, graph=f"'{_EX}graph/' || event_type"),
    ]


#: The mapping; every {table} stands for a table or a view of that name.
SQL = "\nUNION ALL ".join(_fixed() + _tables())


def duck_cte(name: str = "triples") -> str:
    """WITH-clause item of the mapping over tables of the same names."""
    return f"{name} AS ({SQL.format(**{t: t for t in TABLES})})"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, s, s_kind, p, o, o_kind, o_dt, o_lang of the tables in sf_dir. A filter on p leaves the tables it needs."""
    return spark.sql(SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
