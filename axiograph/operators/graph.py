"""Hierarchies: cycle-safe closure, gap spanning, collapsing, reduction, module and subset extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.sources.shared import settle


def reached(edges: DataFrame, starts: DataFrame, source: str = "child", target: str = "parent", within: DataFrame | None = None) -> DataFrame:
    """node: all that edges lead to from the nodes of starts (column node), these left out unless a cycle leads back.

    Breadth first: every round joins the last frontier with the edges and drops what is known, so cycles end and no
    edge is followed twice. within: nodes that may be passed through.
    """
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    frontier, known = starts.select("node").distinct(), None
    while True:
        ahead = frontier.join(steps, "node").select(F.col("next").alias("node")).distinct()
        ahead = settle(ahead if known is None else ahead.join(known, "node", "left_anti"), "frontier")
        if ahead.isEmpty():
            return known if known is not None else ahead
        known = ahead if known is None else known.unionByName(ahead)
        frontier = ahead if within is None else ahead.join(within.select("node"), "node", "left_semi")


def closure(edges: DataFrame) -> DataFrame:
    """child, parent: all pairs that a path of one edge or more joins; a node on a cycle is paired with itself."""
    steps = settle(edges.select("child", "parent").distinct(), "steps")
    known = frontier = steps
    while True:
        ahead = frontier.select("child", F.col("parent").alias("via")).join(steps.select(F.col("child").alias("via"), "parent"), "via").select("child", "parent").distinct()
        frontier = settle(ahead.join(known, ["child", "parent"], "left_anti"), "pairs")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def components(links: DataFrame) -> DataFrame:
    """node, rep: every node of links (a, b), and the smallest that it is connected with.

    In each round nodes point to their smallest neighbour, pointers are doubled until they end, and what points to one node becomes one.
    """
    pairs = links.select("a", "b").where("a <> b")
    ends = settle(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = ends.select(F.col("a").alias("node"), F.col("a").alias("rep")).distinct()
    while not ends.isEmpty():
        to, moved = settle(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "pointers"), True
        while moved:
            ahead = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = settle(to.join(ahead, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            to, moved = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        found = settle(found.join(to.withColumnRenamed("a", "rep"), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep")), "components")
        ends = settle(ends.join(to.withColumnRenamed("to", "a_"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("b_")), "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct(), "links")
    return found


def span_gaps(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """child, parent: for every kept node (column node) the nearest kept nodes above it, over nodes that are not kept.

    The walk goes on through nodes that are left out only and stops at the first kept one, so a kept node hides what
    lies above it on that path.
    """
    kept = settle(kept.select("node").distinct(), "kept")
    steps = settle(edges.select("child", "parent").where("child <> parent").distinct(), "steps")
    is_kept = kept.withColumn("hit", F.lit(True))
    walk = kept.select(F.col("node").alias("child")).join(steps, "child")
    found, seen = None, None
    while True:
        ends = settle(walk.distinct().join(is_kept.select(F.col("node").alias("parent"), "hit"), "parent", "left").select("child", "parent", "hit"), "walk")
        hits = ends.where("hit AND child <> parent").select("child", "parent")
        found = hits if found is None else found.unionByName(hits)
        open_ends = ends.where("hit IS NULL").select("child", "parent")
        fresh = open_ends if seen is None else open_ends.join(seen, ["child", "parent"], "left_anti")
        if fresh.isEmpty():
            return found.distinct()
        seen = fresh if seen is None else seen.unionByName(fresh)
        walk = fresh.select("child", F.col("parent").alias("via")).join(steps.select(F.col("child").alias("via"), "parent"), "via").select("child", "parent")


def cycles(edges: DataFrame) -> DataFrame:
    """node: nodes that a path leads back to.

    Edges of nodes that have nothing above or nothing below go first, round by round, so that pairs are made of cycles and what lies between
    them alone.
    """
    steps = settle(edges.select("child", "parent").distinct(), "steps")
    size = steps.count()
    while True:
        left = steps.join(steps.select(F.col("parent").alias("child")), "child", "left_semi").join(steps.select(F.col("child").alias("parent")), "parent", "left_semi")
        steps = settle(left.select("child", "parent"), "steps")
        if (n := steps.count()) == size:
            break
        size = n
    return closure(steps).where("child = parent").select(F.col("child").alias("node"))


def reduction(edges: DataFrame, closed: bool = False) -> DataFrame:
    """child, parent: edges that no longer path between the same nodes makes redundant. Edges within a cycle all stay. closed: the edges hold their closure, so it isn't worked out again."""
    steps = settle(edges.select("child", "parent").where("child <> parent").distinct(), "steps")
    all_pairs = steps if closed else settle(closure(steps), "closure")
    mutual = all_pairs.join(all_pairs.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"], "left_semi")
    longer = steps.select("child", F.col("parent").alias("via")).join(all_pairs.select(F.col("child").alias("via"), "parent"), "via").where("via <> parent").select("child", "parent", "via")
    loops = mutual.select(F.col("child").alias("via"), F.col("parent"))
    redundant = longer.join(loops, ["via", "parent"], "left_anti").join(mutual.select("child", F.col("parent").alias("via")), ["child", "via"], "left_anti").select("child", "parent").distinct()
    return steps.join(redundant, ["child", "parent"], "left_anti")


def collapse(edges: DataFrame, threshold: int = 2, precious: DataFrame | None = None, repeat: bool = True) -> DataFrame:
    """child, parent after nodes with a parent and at least one but fewer than threshold children went; children of what
    went are linked to the nearest node above. precious: nodes (column node) that stay."""
    if threshold < 2:
        raise ValueError("threshold must be 2 or more")
    now = settle(edges.select("child", "parent").where("child <> parent").distinct(), "edges")
    while True:
        below = now.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
        gone = below.where(F.col("n") < threshold).join(now.select(F.col("child").alias("node")).distinct(), "node", "left_semi").select("node")
        gone = settle(gone.join(precious.select("node"), "node", "left_anti") if precious is not None else gone, "gone")
        if gone.isEmpty():
            return now
        nodes = now.select(F.col("child").alias("node")).unionByName(now.select(F.col("parent").alias("node"))).distinct()
        now = settle(span_gaps(now, nodes.join(gone, "node", "left_anti")), "edges")
        if not repeat:
            return now


def bounded_ancestors(edges: DataFrame, lower: DataFrame, upper: DataFrame, intermediates: str = "all") -> DataFrame:
    """child, parent: the edges on paths from lower nodes up to upper nodes, where a path ends. intermediates "none":
    lower nodes linked to the nearest upper or lower node; "minimal": nodes with one child are left out."""
    steps = edges.select("child", "parent").distinct()
    nodes = steps.select(F.col("child").alias("node")).unionByName(steps.select(F.col("parent").alias("node"))).distinct()
    inner = nodes.join(upper.select("node"), "node", "left_anti")
    up = reached(steps, lower, within=inner).unionByName(lower.select("node")).distinct()
    walked = settle(steps.join(up.select(F.col("node").alias("child")), "child", "left_semi").join(upper.select(F.col("node").alias("child")), "child", "left_anti"), "walked")
    down = reached(walked, upper, "parent", "child").unionByName(upper.select("node")).distinct()
    between = walked.join(down.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent")
    if intermediates == "none":
        return span_gaps(between, lower.select("node").unionByName(upper.select("node")))
    if intermediates == "minimal":
        return collapse(between, 2, lower.select("node").unionByName(upper.select("node")))
    return between


def branch(edges: DataFrame, roots: DataFrame, intermediates: str = "all") -> DataFrame:
    """child, parent: the edges below the roots; intermediates "none": leaves linked to their roots, "minimal": as collapse()."""
    steps = edges.select("child", "parent").distinct()
    down = reached(steps, roots, "parent", "child").unionByName(roots.select("node")).distinct()
    own = settle(steps.join(down.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent"), "branch")
    if intermediates == "none":
        leaves = own.select(F.col("child").alias("node")).distinct().join(own.select(F.col("parent").alias("node")), "node", "left_anti")
        return span_gaps(own, leaves.unionByName(roots.select("node")))
    return collapse(own, 2, roots) if intermediates == "minimal" else own


#: constructors of which locality knows no more than their names
_OPAQUE = ["not", "one", "value", "self", "min", "max", "exact", "inverse"]
_ASSERTIONS = ["ClassAssertion", "NegativePropertyAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion", "SameIndividual", "DifferentIndividuals"]


def module(ont: Ontology, signature: DataFrame, kind: str = "BOT", individuals: str = "include") -> DataFrame:
    """The axioms of the syntactic locality module of a signature (column node), with the declarations and annotations of the names they have.

    Names that are not in the signature count as empty (BOT) or full (TOP); an axiom that isn't a tautology by that is in the module and its
    names, those inside of expressions too, join the signature, until nothing more does. STAR: BOT and TOP by turns
    until nothing goes. individuals: "include"; "exclude": no assertions; "minimal": those about individuals that other axioms name.
    Expressions of other constructors than and, or, some and all count as neither empty nor full, so their axioms are in whenever the other side doesn't decide.
    """
    if individuals not in ("include", "exclude", "minimal"):
        raise ValueError(f"unknown option for individuals {individuals}")
    logical = settle(ont.axioms.where(~F.col("ax_type").isin("Declaration", "AnnotationAssertion")).select("ax_id", "ax_type", "subject", "property", "object", "object_kind", "operands"), "logical")
    local = logical if individuals == "include" else settle(logical.where(~F.col("ax_type").isin(_ASSERTIONS)), "logical")
    texts = ont.expressions.where("label IS NOT NULL").select("expr", "op", "prop", "label").distinct()
    names = ont.labels.select(F.col("node").alias("part"), "text")
    pairs = ont.parts.where("role = 'part'").select("expr", "part").unionByName(texts.where("op = 'self'").select("expr", F.col("prop").alias("part"))).join(texts, "expr")
    parts = settle(pairs.join(names, "part", "left").select("label", "op", "prop", F.coalesce("text", "part").alias("part")).distinct(), "parts")
    of_axiom = settle(ont.axioms.join(logical.select("ax_id"), "ax_id", "left_semi").select("ax_id", F.explode(F.array_union("sig", "exprs")).alias("node")), "names")
    found = local
    if kind == "STAR":
        size = None
        while True:
            for turn in ("BOT", "TOP"):
                found = _non_local(found, parts, of_axiom, signature, turn)
            if (n := found.count()) == size:
                break
            size = n
    else:
        found = _non_local(local, parts, of_axiom, signature, kind)
    used = settle(of_axiom.join(found.select("ax_id"), "ax_id", "left_semi").select("node").distinct().unionByName(signature.select("node")).distinct(), "used")
    about = ont.axioms.where(F.col("ax_type").isin("Declaration", "AnnotationAssertion")).join(used.select(F.col("node").alias("subject")), "subject", "left_semi").select("ax_id")
    ids = found.select("ax_id").unionByName(about)
    if individuals == "minimal":
        ids = ids.unionByName(logical.where(F.col("ax_type").isin(_ASSERTIONS)).join(used.select(F.col("node").alias("subject")), "subject", "left_semi").select("ax_id"))
    return ont.axioms.join(ids.distinct(), "ax_id", "left_semi")


def _non_local(axioms: DataFrame, parts: DataFrame, of_axiom: DataFrame, signature: DataFrame, kind: str) -> DataFrame:
    """The axioms that join, round by round. solid: expressions that are not empty, open: those that are not full, when names outside of
    the signature are empty (BOT) or full (TOP)."""
    bottom = kind == "BOT"
    known, found = settle(signature.select("node").distinct(), "signature"), None
    sizes = parts.groupBy("label").agg(F.count("*").alias("n"))
    classes = parts.select(F.col("part").alias("node")).unionByName(axioms.where("object_kind <> 'lit'").select(F.col("object").alias("node"))).unionByName(axioms.select(F.col("subject").alias("node"))).distinct()
    classes = settle(classes.join(parts.select(F.col("label").alias("node")), "node", "left_anti"), "classes")
    while True:
        inside = known.select(F.col("node").alias("prop"), F.lit(True).alias("in_"))
        rows = settle(parts.join(inside, "prop", "left").withColumn("in_", F.col("in_").isNotNull()), "parts")
        mine = known.join(classes, "node", "left_semi")
        solid = (mine if bottom else classes).where(F.col("node") != V.NOTHING).unionByName(classes.where(F.col("node") == V.THING)).distinct()
        opened = (classes if bottom else mine).where(F.col("node") != V.THING).unionByName(classes.where(F.col("node") == V.NOTHING)).distinct()
        solid = _grown(solid, rows, sizes, some=F.col("in_") if bottom else F.lit(True), always=["all", *_OPAQUE], every="and", any_="or")
        opened = _grown(opened, rows, sizes, some=None, always=(["some"] if bottom else []) + _OPAQUE, every="or", any_="and", bottom=bottom)
        several = axioms.where("size(operands) > 0").select("ax_id", F.explode("operands").alias("node"))
        counts = several.join(solid.withColumn("full_", F.lit(1)), "node", "left").join(known.withColumn("known_", F.lit(1)), "node", "left").groupBy("ax_id").agg(F.count("full_").alias("n_solid"), F.count("known_").alias("n_known"))
        flags = lambda c, side: (solid if c[0] == "s" else opened).select(F.col("node").alias(side), F.lit(True).alias(c))
        marked = axioms.join(flags("s1", "subject"), "subject", "left").join(flags("o1", "subject"), "subject", "left").join(flags("s2", "object"), "object", "left").join(flags("o2", "object"), "object", "left")
        marked = marked.join(known.select(F.col("node").alias("subject"), F.lit(True).alias("k1")), "subject", "left").join(known.select(F.col("node").alias("object"), F.lit(True).alias("k2")), "object", "left").join(known.select(F.col("node").alias("property"), F.lit(True).alias("k3")), "property", "left")
        marked = marked.join(counts, "ax_id", "left")
        s1, s2, o1, o2, k1, k2, k3 = (F.col(c).isNotNull() for c in ("s1", "s2", "o1", "o2", "k1", "k2", "k3"))
        is_ = lambda *names: F.col("ax_type").isin(*names)
        yes = F.lit(True)
        fires = (
            F.when(is_("DisjointClasses") & (F.size("operands") > 0), F.col("n_solid") > 1).when(is_("SubPropertyChainOf"), (F.col("n_known") == F.size("operands")) if bottom else k1)
            .when(is_("SubClassOf"), s1 & o2).when(is_("EquivalentClasses"), (s1 | s2) & (o1 | o2)).when(is_("DisjointClasses"), s1 & s2)
            .when(is_("PropertyDomain", "PropertyRange"), (k1 & o2) if bottom else o2).when(is_("SubPropertyOf"), k1 if bottom else k2)
            .when(is_("EquivalentProperties", "InverseProperties"), k1 | k2).when(is_("ClassAssertion"), o2)
            .when(is_("ObjectPropertyAssertion", "DataPropertyAssertion"), yes if bottom else k3)
            .when(is_("ReflexiveProperty"), yes if bottom else k1).when(is_("TransitiveProperty", "SymmetricProperty"), k1)
            .when(F.col("ax_type").endswith("Property"), k1 if bottom else yes).otherwise(yes)
        )
        hit = marked.where(fires).select(*axioms.columns).distinct()
        fresh = settle(hit if found is None else hit.join(found.select("ax_id"), "ax_id", "left_anti"), "hit")
        if fresh.isEmpty():
            return found if found is not None else fresh
        found = fresh if found is None else found.unionByName(fresh)
        more = settle(of_axiom.join(fresh.select("ax_id"), "ax_id", "left_semi").select("node").distinct().join(known, "node", "left_anti"), "more")
        if more.isEmpty():
            return found
        known = settle(known.unionByName(more), "signature")


def _grown(start: DataFrame, parts: DataFrame, sizes: DataFrame, some, always: list[str], every: str, any_: str, bottom: bool = True) -> DataFrame:
    """node: start and the expressions that come to it from their parts: those of an operator in always; "some" (and for open ones "all")
    by property and part; `every` by all parts, `any_` by one."""
    own = start.unionByName(parts.where(F.col("op").isin(always)).select(F.col("label").alias("node"))).distinct() if always else start
    own = settle(own, "grown")
    while True:
        by_part = parts.join(own.select(F.col("node").alias("part")), "part", "left_semi")
        if some is not None:  # what is not empty
            restricted = by_part.where((F.col("op") == "some") & some).select("label")
        elif bottom:  # what is not full where outside properties are empty
            restricted = by_part.where((F.col("op") == "all") & F.col("in_")).select("label")
        else:
            restricted = by_part.where("op = 'all' OR op = 'some'").select("label").unionByName(parts.where((F.col("op") == "some") & F.col("in_")).select("label"))
        whole = by_part.where(F.col("op") == every).groupBy("label").agg(F.count("*").alias("m")).join(sizes, "label").where("m = n").select("label")
        made = restricted.unionByName(whole).unionByName(by_part.where(F.col("op") == any_).select("label")).distinct()
        fresh = settle(made.select(F.col("label").alias("node")).join(own, "node", "left_anti"), "grown")
        if fresh.isEmpty():
            return own
        own = settle(own.unionByName(fresh), "grown")


def dangling(ont: Ontology) -> DataFrame:
    """iri: classes and object properties that are named in hierarchy axioms but declared nowhere; built-ins are exempt."""
    used = ont.edges.select(F.col("child").alias("iri")).unionByName(ont.edges.where("o_kind = 'iri'").select(F.col("parent").alias("iri"))).distinct()
    builtin = F.col("iri").startswith("http://www.w3.org/2002/07/owl#") | F.col("iri").startswith("http://www.w3.org/2000/01/rdf-schema#")
    return used.where(~builtin).join(ont.declared.select("iri"), "iri", "left_anti")
