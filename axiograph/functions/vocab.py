"""IRIs of the public vocabularies that the operators know (fixed values)."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OBO = "http://purl.obolibrary.org/obo/"
OIO = "http://www.geneontology.org/formats/oboInOwl#"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"
PROV = "http://www.w3.org/ns/prov#"
EX = "https://example.org/"

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "obo": OBO, "oboInOwl": OIO, "dc": DC, "dcterms": DCTERMS, "prov": PROV, "ex": EX}

TYPE = RDF + "type"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"
SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE, DEFINED_BY, SEE_ALSO = RDFS + "domain", RDFS + "range", RDFS + "isDefinedBy", RDFS + "seeAlso"
CLASS, OBJECT_PROPERTY, DATA_PROPERTY = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty"
ANNOTATION_PROPERTY, INDIVIDUAL, DATATYPE = OWL + "AnnotationProperty", OWL + "NamedIndividual", RDFS + "Datatype"
ONTOLOGY, RESTRICTION, AXIOM, THING, NOTHING = (OWL + x for x in ("Ontology", "Restriction", "Axiom", "Thing", "Nothing"))
EQUIVALENT, DISJOINT, EQUIVALENT_PROPERTY, INVERSE = (OWL + x for x in ("equivalentClass", "disjointWith", "equivalentProperty", "inverseOf"))
SAME_AS, DIFFERENT, IMPORTS, VERSION = (OWL + x for x in ("sameAs", "differentFrom", "imports", "versionIRI"))
SOME, ALL, ON_PROPERTY = OWL + "someValuesFrom", OWL + "allValuesFrom", OWL + "onProperty"
INTERSECTION, UNION, COMPLEMENT, ONE_OF = (OWL + x for x in ("intersectionOf", "unionOf", "complementOf", "oneOf"))
VALUE, SELF, ON_CLASS, ON_RANGE = (OWL + x for x in ("hasValue", "hasSelf", "onClass", "onDataRange"))
CARDINALITIES = {OWL + k: v for k, v in {"minCardinality": "min", "maxCardinality": "max", "cardinality": "exact", "minQualifiedCardinality": "min", "maxQualifiedCardinality": "max", "qualifiedCardinality": "exact"}.items()}
CHAIN, DISJOINT_UNION, KEY, MEMBERS, DISTINCT_MEMBERS = (OWL + x for x in ("propertyChainAxiom", "disjointUnionOf", "hasKey", "members", "distinctMembers"))
ALL_DISJOINT, ALL_DISJOINT_PROPERTIES, ALL_DIFFERENT, NEGATIVE = (OWL + x for x in ("AllDisjointClasses", "AllDisjointProperties", "AllDifferent", "NegativePropertyAssertion"))
NEG_SOURCE, NEG_PROPERTY, NEG_TARGET, NEG_VALUE = (OWL + x for x in ("sourceIndividual", "assertionProperty", "targetIndividual", "targetValue"))
FIRST, REST, NIL = (RDF + x for x in ("first", "rest", "nil"))
DEPRECATED = OWL + "deprecated"
ANN_SOURCE, ANN_PROPERTY, ANN_TARGET = (OWL + x for x in ("annotatedSource", "annotatedProperty", "annotatedTarget"))
DEFINITION, ELUCIDATION, EDITOR_SYNONYM, REPLACED_BY = (OBO + x for x in ("IAO_0000115", "IAO_0000600", "IAO_0000118", "IAO_0100001"))
ABBREVIATION, ACRONYM = OBO + "OMO_0003000", OBO + "OMO_0003012"
EXACT, BROAD, RELATED, NARROW = (OIO + x for x in ("hasExactSynonym", "hasBroadSynonym", "hasRelatedSynonym", "hasNarrowSynonym"))
XREF, SYNONYM_TYPE, SUBSET, SUBSET_PROPERTY, SYNONYM_TYPE_PROPERTY = (OIO + x for x in ("hasDbXref", "hasSynonymType", "inSubset", "SubsetProperty", "SynonymTypeProperty"))
OBSOLETE_CLASS, IS_INFERRED = OIO + "ObsoleteClass", OIO + "is_inferred"
XSD_STRING, XSD_BOOLEAN, XSD_INTEGER = XSD + "string", XSD + "boolean", XSD + "integer"
LANG_STRING = RDF + "langString"

#: kind of entity -> the class it is declared with
KINDS = {"class": CLASS, "object-property": OBJECT_PROPERTY, "data-property": DATA_PROPERTY, "annotation-property": ANNOTATION_PROPERTY, "individual": INDIVIDUAL, "datatype": DATATYPE}
