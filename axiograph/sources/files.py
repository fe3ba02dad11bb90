"""Readers and writers of line-based files: N-Triples and N-Quads, OBO stanzas, tables, term lists, profiles, prefixes."""

from __future__ import annotations

import json
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators.setops import TRIPLE

#: The inside of a quoted text; possessive, so that no long text is matched by recursion.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_SUBJECT, _IRI = r"(<[^<>\s]*>|_:\S+)", r"<([^<>\s]*)>"
_OBJECT = r'(<[^<>\s]*>|_:\S+|"' + _INSIDE + r'"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)'
_LINE = rf"^\s*{_SUBJECT}\s+{_IRI}\s+{_OBJECT}(?:\s+{_IRI})?\s*\.\s*(?:#.*)?$"
#: Escapes of N-Triples texts.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


class ParseError(ValueError):
    pass


def _unescaped(c: Column) -> Column:
    """Backslash pairs are set aside first, so that an escaped backslash before an n is no line feed."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    for plain, written in _ESCAPES[1:]:
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.replace(out, F.lit("\u0001"), F.lit("\\"))


def _kind(c: Column) -> Column:
    return F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("lit")


def _bare(c: Column) -> Column:
    return F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def read_ntriples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """graph and triples of .nt or .nq files (gzip too). Lines that are neither empty, comments nor triples: left out, or
    an error if strict."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    if strict:
        wrong = lines.where(~F.col("value").rlike(_LINE)).limit(1).collect()
        if wrong:
            raise ParseError(f"no triple: {wrong[0]['value']!r}")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(F.col("value").rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    tail = F.regexp_extract("o", rf'^"{_INSIDE}"(.*)$', 1)
    literal = F.col("o").startswith('"')
    return rows.select(
        F.when(F.col("g") == "", "root").otherwise(F.col("g")).alias("graph"), _bare(F.col("s")).alias("s"), _kind(F.col("s")).alias("s_kind"), "p",
        F.when(literal, _unescaped(F.regexp_extract("o", rf'^"({_INSIDE})"', 1))).otherwise(_bare(F.col("o"))).alias("o"), _kind(F.col("o")).alias("o_kind"),
        F.when(literal, F.when(tail.startswith("^^"), F.substr(tail, F.lit(4), F.length(tail) - 4)).when(tail.startswith("@"), V.LANG_STRING).otherwise(V.XSD_STRING)).alias("o_dt"),
        F.when(tail.startswith("@"), F.substr(tail, F.lit(2))).alias("o_lang"),
    )


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """value: a line for each triple; with a graph column other than root, N-Quads."""
    text = F.col("o")
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    tail = F.when(F.coalesce(F.col("o_lang"), F.lit("")) != "", F.concat(F.lit("@"), F.col("o_lang"))).when(F.coalesce(F.col("o_dt"), F.lit(V.XSD_STRING)) != V.XSD_STRING, F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise("")
    node = lambda c: F.when(F.col(f"{c}_kind") == "iri", F.concat(F.lit("<"), F.col(c), F.lit(">"))).otherwise(F.col(c))
    obj = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node("o"))
    graph = F.when(F.col("graph") != "root", F.concat(F.lit(" <"), F.col("graph"), F.lit(">"))).otherwise("") if "graph" in triples.columns else F.lit("")
    return triples.select(F.concat(node("s"), F.lit(" <"), F.col("p"), F.lit("> "), obj, graph, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, compressed: bool = False) -> None:
    writer = ntriples_lines(triples).write.mode("overwrite")
    (writer.option("compression", "gzip") if compressed else writer).text(path)


#: Tags of OBO stanzas that name a relation or hold a text.
_OBO_LINKS = {"is_a": V.SUBCLASS, "equivalent_to": V.EQUIVALENT, "disjoint_from": V.DISJOINT, "replaced_by": V.REPLACED_BY, "inverse_of": V.INVERSE, "domain": V.DOMAIN, "range": V.RANGE}
_OBO_TEXTS = {"name": V.LABEL, "comment": V.COMMENT, "namespace": V.OIO + "hasOBONamespace", "alt_id": V.OIO + "hasAlternativeId", "xref": V.XREF}
_OBO_STANZAS = {"Term": V.CLASS, "Typedef": V.OBJECT_PROPERTY, "Instance": V.INDIVIDUAL}
_SCOPES = {"EXACT": V.EXACT, "BROAD": V.BROAD, "NARROW": V.NARROW, "RELATED": V.RELATED}


def _obo_plain(c: Column) -> Column:
    """Escapes of OBO texts undone."""
    return F.replace(_unescaped(c), F.lit("\\!"), F.lit("!"))


def obo_lines(ont: Ontology) -> DataFrame:
    """s, rank, value: the lines of OBO stanzas for named classes, object properties and individuals.

    Texts lose white space at their ends, languages and datatypes; what the format has no tag for is left out (clean the
    annotations first: repair.one_annotation, repair.joined_annotations). A line for each statement, never one text
    for a whole stanza, so that an entity with very many statements takes no more memory than others.
    """
    name = lambda c: F.when(c.rlike(f"^{V.OBO}[A-Za-z]+_[^_]+$"), F.replace(F.substr(c, F.lit(len(V.OBO) + 1)), F.lit("_"), F.lit(":"))).otherwise(c)
    text = F.regexp_replace("o", r"^\s+|\s+$", "")
    for plain, written in [*_ESCAPES, ("!", "\\!")]:
        text = F.replace(text, F.lit(plain), F.lit(written))
    kinds = ont.declared.where(F.col("kind").isin("class", "object-property", "individual"))
    heads = kinds.groupBy(F.col("iri").alias("s")).agg(F.min("kind").alias("kind"))
    stanza = F.when(F.col("kind") == "class", "Term").when(F.col("kind") == "individual", "Instance").otherwise("Typedef")
    own = ont.rows.distinct().join(heads, "s", "left_semi")
    some = ont.expressions.where("op = 'some'").select(F.col("expr").alias("o"), "prop", "filler")
    line = lambda rows, rank, value: rows.select("s", F.lit(rank).alias("rank"), value.alias("value"))
    parts = [line(heads, 0, F.concat(F.lit("\n["), stanza, F.lit("]"))), line(heads, 1, F.concat(F.lit("id: "), name(F.col("s"))))]
    for tag, p in _OBO_TEXTS.items():
        parts.append(line(own.where((F.col("p") == p) & (F.col("o_kind") == "lit")), 2, F.concat(F.lit(f"{tag}: "), text)))
    for scope, p in _SCOPES.items():
        parts.append(line(own.where((F.col("p") == p) & (F.col("o_kind") == "lit")), 4, F.concat(F.lit('synonym: "'), text, F.lit(f'" {scope} []'))))
    parts.append(line(own.where((F.col("p") == V.DEFINITION) & (F.col("o_kind") == "lit")), 3, F.concat(F.lit('def: "'), text, F.lit('" []'))))
    for tag, p in [*_OBO_LINKS.items(), ("is_a", V.SUBPROPERTY)]:
        parts.append(line(own.where((F.col("p") == p) & (F.col("o_kind") == "iri")), 5, F.concat(F.lit(f"{tag}: "), name(F.col("o")))))
    parts.append(line(own.where(F.col("p") == V.SUBCLASS).join(some, "o"), 6, F.concat(F.lit("relationship: "), name(F.col("prop")), F.lit(" "), name(F.col("filler")))))
    parts.append(line(own.where((F.col("p") == V.DEPRECATED) & (F.col("o") == "true") & (F.col("o_dt") == V.XSD_BOOLEAN)), 7, F.lit("is_obsolete: true")))
    return reduce(DataFrame.unionByName, parts).distinct()


def write_obo(ont: Ontology, path: str) -> None:
    """Stanzas in the order of their entities' IRIs, each whole in one file."""
    lines = obo_lines(ont).repartitionByRange("s").sortWithinPartitions("s", "rank", "value")
    lines.select("value").write.mode("overwrite").text(path)


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Triples of OBO files: stanzas are records that an empty line ends, lines of a stanza are exploded together."""
    records = spark.read.option("lineSep", "\n\n").text(path).withColumn("lines", F.split("value", r"\n"))
    stanza = records.withColumn("kind", F.regexp_extract("value", r"(?m)^\[(\w+)\]", 1)).withColumn("id", F.regexp_extract("value", r"(?m)^id: (\S+)", 1)).where(F.col("kind").isin(*_OBO_STANZAS) & (F.col("id") != ""))
    iri = lambda c: F.when(c.contains("://"), c).when(c.contains(":"), F.concat(F.lit(V.OBO), F.replace(c, F.lit(":"), F.lit("_")))).otherwise(F.concat(F.lit(V.OBO), c))
    rows = stanza.select(iri(F.col("id")).alias("s"), "kind", F.explode("lines").alias("line")).withColumn("tag", F.regexp_extract("line", r"^([\w-]+):", 1)).withColumn("body", F.trim(F.regexp_replace(F.regexp_extract("line", r"(?s)^[\w-]+:\s*(.*)$", 1), r"(?s)\s+! .*$", "")))
    first, second = F.split_part("body", F.lit(" "), F.lit(1)), F.split_part("body", F.lit(" "), F.lit(2))
    quoted = F.regexp_extract("body", rf'(?s)^"({_INSIDE})"', 1)

    def made(where: Column, p: Column, o: Column, kind: str, dt: str | None = None) -> DataFrame:
        return rows.where(where).select("s", F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))

    mapped = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    tag, named = F.col("tag"), F.col("kind") == "Typedef"
    links = made(tag.isin(*_OBO_LINKS), F.when(named & (tag == "is_a"), V.SUBPROPERTY).otherwise(mapped(_OBO_LINKS, tag)), iri(first), "iri")
    texts = made(tag.isin(*_OBO_TEXTS), mapped(_OBO_TEXTS, tag), F.when(tag == "xref", first).otherwise(_obo_plain(F.col("body"))), "lit", V.XSD_STRING)
    definitions = made(tag == "def", F.lit(V.DEFINITION), _obo_plain(quoted), "lit", V.XSD_STRING)
    synonyms = made(tag == "synonym", F.coalesce(mapped(_SCOPES, F.regexp_extract("body", r'"\s+(\w+)', 1)), F.lit(V.RELATED)), _obo_plain(quoted), "lit", V.XSD_STRING)
    obsolete = made((tag == "is_obsolete") & (F.col("body") == "true"), F.lit(V.DEPRECATED), F.lit("true"), "lit", V.XSD_BOOLEAN)
    types = made(tag == "id", F.lit(V.TYPE), mapped(_OBO_STANZAS, F.col("kind")), "iri")
    related = rows.where("tag = 'relationship'").withColumn("blank", F.concat(F.lit("_:o"), F.substring(F.sha2("body", 256), 1, 16)))
    none = F.lit(None).cast("string")
    node = lambda s, kind, p, o, ok: related.select(s.alias("s"), F.lit(kind).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(ok).alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    restrictions = [node(F.col("s"), "iri", V.SUBCLASS, F.col("blank"), "bnode"), node(F.col("blank"), "bnode", V.TYPE, F.lit(V.RESTRICTION), "iri"), node(F.col("blank"), "bnode", V.ON_PROPERTY, iri(first), "iri"), node(F.col("blank"), "bnode", V.SOME, iri(second), "iri")]
    out = links
    for part in (texts, definitions, synonyms, obsolete, types, *restrictions):
        out = out.unionByName(part)
    return out.select(*TRIPLE).distinct()


def jsonld_lines(triples: DataFrame) -> DataFrame:
    """value: JSON-LD in flattened form, a node object for each triple in a line of its own (node objects with one @id are
    one node), so that nothing is grouped."""
    literal, lang, dt = F.col("o_kind") == "lit", F.coalesce("o_lang", F.lit("")), F.coalesce("o_dt", F.lit(V.XSD_STRING))
    item = F.struct(
        F.when(~literal, F.col("o")).alias("@id"), F.when(literal, F.col("o")).alias("@value"),
        F.when(literal & (lang == "") & (dt != V.XSD_STRING), dt).alias("@type"), F.when(literal & (lang != ""), lang).alias("@language"),
    )
    node, rest = F.to_json(F.struct(F.col("s").alias("@id"))), F.to_json(F.create_map("p", F.array(item)))
    return triples.select(F.concat(F.substr(node, F.lit(1), F.length(node) - 1), F.lit(","), F.substr(rest, F.lit(2))).alias("value"))


def read_jsonld(spark: SparkSession, path: str, context: dict[str, str] | None = None) -> DataFrame:
    """Triples of flattened JSON-LD with a node object in each line. Names are expanded by context (term or prefix to IRI); a
    plain text, number or truth value is a literal."""
    nodes = spark.read.text(path).where("trim(value) <> ''").select(F.parse_json("value").alias("node"))
    items = spark.sql(
        """SELECT variant_get(node, "$['@id']", 'string') AS s, k.key AS p, i.value AS item, schema_of_variant(i.value) AS form
        FROM {nodes}, LATERAL variant_explode(node) k, LATERAL variant_explode(k.value) i WHERE k.key NOT IN ('@id', '@context')""",
        nodes=nodes,
    )
    plain = F.col("form").startswith("OBJECT") == F.lit(False)
    part = lambda name: F.when(~plain, F.try_variant_get("item", f"$['{name}']", "string"))
    is_type = F.col("p") == "@type"
    names = context or {}

    def expanded(c: Column) -> Column:
        out = F.when(c.startswith("_:"), c)
        for term, iri in names.items():
            out = out.when(c == term, F.lit(iri)).when(c.startswith(f"{term}:") & ~c.startswith(f"{term}://"), F.concat(F.lit(iri), F.substr(c, F.lit(len(term) + 2))))
        return out.otherwise(c)

    text = F.try_variant_get("item", "$", "string")
    link = F.when(is_type, text).otherwise(part("@id"))
    own = F.when(F.col("form") == "BOOLEAN", V.XSD_BOOLEAN).when(F.col("form") == "BIGINT", V.XSD_INTEGER).otherwise(V.XSD_STRING)
    rows = items.select("s", F.when(is_type, V.TYPE).otherwise(expanded(F.col("p"))).alias("p"), expanded(link).alias("link"), F.coalesce(part("@value"), F.when(plain & ~is_type, text)).alias("text"), expanded(part("@type")).alias("dt"), part("@language").alias("lang"), own.alias("own"))
    kind = lambda c: F.when(c.startswith("_:"), "bnode").otherwise("iri")
    none = F.col("link").isNull()
    return rows.where("link IS NOT NULL OR text IS NOT NULL").select(
        expanded(F.col("s")).alias("s"), kind(F.col("s")).alias("s_kind"), "p", F.coalesce("link", "text").alias("o"), F.when(none, "lit").otherwise(kind(F.col("link"))).alias("o_kind"),
        F.when(none, F.when(F.col("lang").isNotNull(), V.LANG_STRING).otherwise(F.coalesce("dt", "own"))).alias("o_dt"), "lang",
    ).withColumnRenamed("lang", "o_lang").distinct()


def read_catalog(text: str) -> dict[str, str]:
    """IRI -> path of the uri entries of an XML catalog."""
    return {e.attrib["name"]: e.attrib["uri"] for e in ElementTree.fromstring(text).iter() if e.tag.endswith("uri") and "name" in e.attrib}


#: formats by the ending of a path, .gz left out
FORMATS = {"nt": "nt", "nq": "nt", "obo": "obo", "jsonl": "jsonld", "jsonld": "jsonld", "parquet": "parquet"}


def format_of(path: str, fmt: str | None = None) -> str:
    name = fmt or path.rstrip("/").removesuffix(".gz").rpartition(".")[2]
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(FORMATS)}")
    return FORMATS[name]


def load(spark: SparkSession, *paths: str, fmt: str | None = None, catalog: dict[str, str] | None = None) -> DataFrame:
    """The triples of files as one set. Paths may be globs; a name in the catalog stands for the path it maps to; the format
    comes from the ending unless it is named."""
    readers = {"nt": lambda p: read_ntriples(spark, p), "obo": lambda p: read_obo(spark, p), "jsonld": lambda p: read_jsonld(spark, p), "parquet": lambda p: spark.read.parquet(p)}
    found = [(catalog or {}).get(p, p) for p in paths]
    return reduce(DataFrame.unionByName, [readers[format_of(p, fmt)](p).select(*TRIPLE) for p in found]).distinct()


def save(triples: DataFrame, path: str, fmt: str | None = None) -> None:
    """Triples in the format that the path's ending or fmt names; with .gz compressed (N-Triples and JSON-LD)."""
    kind, packed = format_of(path, fmt), path.endswith(".gz")
    if kind == "obo":
        write_obo(Ontology(triples), path)
    elif kind == "parquet":
        triples.write.mode("overwrite").parquet(path)
    else:
        lines = ntriples_lines(triples) if kind == "nt" else jsonld_lines(triples)
        lines.write.mode("overwrite").option("compression", "gzip" if packed else "none").text(path)


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, list[str]]:
    """(data rows, template strings) of a template, one file: a header, a row of template strings, data. All cells are texts."""
    sep = sep or ("\t" if path.endswith((".tsv", ".tab", ".txt")) else ",")
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', inferSchema=False)
    if len(rows.inputFiles()) != 1:
        raise ParseError("a template is one file")
    numbered = rows.withColumn("n_", F.monotonically_increasing_id())  # a file with multiLine is one task, its first row is 0
    first = numbered.where("n_ = 0").drop("n_").first()
    return numbered.where("n_ > 0").drop("n_"), [x or "" for x in first or ()]


def read_terms(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """node: IRIs of a list with one CURIE or IRI in a line; # begins a comment at the start or after a space."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(^|\s)#.*$", "")).alias("name")).where("name <> ''")
    return lines.select(terms.to_iri("name", prefixes or V.PREFIXES).alias("node")).where("node IS NOT NULL").distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """old, new (and label) of a table with a header."""
    rows = spark.read.csv(path, sep="\t" if path.endswith((".tsv", ".txt")) else ",", header=True)
    if len(rows.columns) not in (2, 3):
        raise ParseError("a mapping has two or three columns")
    return rows.toDF(*["old", "new", "label"][: len(rows.columns)])


def prefixes_json(prefixes: dict[str, str]) -> str:
    return json.dumps({"@context": prefixes}, indent=2)


def read_prefixes(text: str) -> dict[str, str]:
    return {k: v if isinstance(v, str) else v["@id"] for k, v in json.loads(text)["@context"].items() if not k.startswith("@")}


def statement_documents(triples: DataFrame) -> DataFrame:
    """value: one JSON text for each statement of a named subject. Rows are dealt by ranges of (subject, predicate), so those of a subject lie
    together, and one with very many spreads over tasks."""
    rows = triples.where("s_kind = 'iri'").select("s", "p", "o").distinct().repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o")
    return rows.select(F.to_json(F.struct(F.col("s").alias("id"), "p", F.col("o").alias("value"))).alias("value"))


def write_if_any(rows: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Written only if there are rows; tells whether."""
    if rows.isEmpty():
        return False
    writer = rows.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "tsv": lambda: writer.option("header", True).option("sep", "\t").csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[fmt]()
    return True


def mirror(triples: DataFrame, path: str) -> None:
    """One Parquet folder for each graph."""
    triples.hint("rebalance", "graph").write.mode("overwrite").partitionBy("graph").parquet(path)


def html_rows(table: DataFrame) -> DataFrame:
    """value: a table row of HTML for each row of texts."""
    escape = lambda c: F.replace(F.replace(F.replace(F.col(f"`{c}`"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape(c), F.lit("</td>")) for c in table.columns], F.lit("</tr>")).alias("value"))


def yaml_rows(table: DataFrame) -> DataFrame:
    """value: an item of a YAML list for each row of texts."""
    quoted = lambda c: F.concat(F.lit(f"{c}: '"), F.replace(F.regexp_replace(F.col(f"`{c}`"), r"\n", " "), F.lit("'"), F.lit("''")), F.lit("'"))
    return table.select(F.concat(F.lit("- "), F.concat_ws("\n  ", *[quoted(c) for c in table.columns])).alias("value"))


def write_rows(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """A table of texts as csv, tsv, json, html (rows), yaml or Parquet. Quotes are doubled in csv and tsv."""
    writer = table.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        writer.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt in ("html", "yaml"):
        (html_rows if fmt == "html" else yaml_rows)(table).write.mode("overwrite").text(path)
    elif fmt in ("json", "parquet"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_rows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A table that write_rows() wrote as csv, tsv, json or Parquet; all cells of csv and tsv are texts, cells may hold line feeds."""
    if fmt in ("csv", "tsv"):
        return spark.read.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, multiLine=True, escape='"', inferSchema=False, nullValue="\u0001", emptyValue="")
    return spark.read.format(fmt).load(path)
