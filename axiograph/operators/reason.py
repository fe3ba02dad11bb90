"""Rule-based reasoning over the EL part: classification, relaxing, materializing, equivalences and unsatisfiable classes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import AXIOM_TYPES, CHARACTERISTICS, Ontology, case
from axiograph.operators import axfilter, graph, setops
from axiograph.sources.shared import settle, written


def told(ont: Ontology) -> DataFrame:
    """child, parent: named subclass statements and both directions of named equivalences."""
    sub = ont.edges.where("kind = 'class' AND o_kind = 'iri'").select("child", "parent")
    eq = ont.with_p(V.EQUIVALENT).where("s_kind = 'iri' AND o_kind = 'iri' AND s <> o")
    return sub.unionByName(eq.select(F.col("s").alias("child"), F.col("o").alias("parent"))).unionByName(eq.select(F.col("o").alias("child"), F.col("s").alias("parent"))).distinct()


def restrictions(ont: Ontology) -> DataFrame:
    """cls, prop, filler: cls is under, or the same as, some prop filler."""
    some = ont.expressions.where("op = 'some'").select("expr", "prop", "filler")
    return ont.with_p(V.SUBCLASS, V.EQUIVALENT).where("s_kind = 'iri' AND o_kind = 'bnode'").select(F.col("s").alias("cls"), F.col("o").alias("expr")).join(some, "expr").select("cls", "prop", "filler").distinct()


class _Fixpoint:
    """Relations that only grow: what a round derives is kept apart from what was known, so each is joined on once as new. What is
    known of a relation is one read of all that rounds have written, however many these are."""

    def __init__(self, **columns: list[str]):
        self.columns, self.paths, self.known, self.fresh, self.moved = columns, {c: [] for c in columns}, {}, {}, {}

    def add(self, **derived: list[DataFrame]) -> bool:
        """Take in what was derived; true if some of it is new. What nothing was derived of stays as it is."""
        for name, columns in self.columns.items():
            self.moved[name] = False
            if not derived[name]:
                continue
            rows = reduce(DataFrame.unionByName, [d.select(columns) for d in derived[name]]).distinct()
            if name in self.known:
                rows = rows.join(self.known[name], columns, "left_anti")
            path = written(rows, name)
            read = rows.sparkSession.read.schema(rows.schema)
            self.fresh[name] = read.parquet(path)
            self.moved[name] = not self.fresh[name].isEmpty()
            if self.moved[name] or not self.paths[name]:
                self.paths[name].append(path)
                self.known[name] = read.parquet(*self.paths[name])
        return any(self.moved.values())

    def both(self, left: str, right: str, join) -> list[DataFrame]:
        """join(l, r) where one of the two is new; what isn't stays out of the plan."""
        return [join(self.fresh[left], self.known[right])] * self.moved[left] + [join(self.known[left], self.fresh[right])] * self.moved[right]


def _compositions(ont: Ontology, above: DataFrame) -> DataFrame:
    """p, q, r: p followed by q is below r, from transitive properties and property chains; longer chains go by names for their beginnings."""
    transitive = ont.with_p(V.TYPE).where(F.col("o") == V.OWL + "TransitiveProperty").select(F.col("s").alias("p"), F.col("s").alias("q"), F.col("s").alias("r"))
    chains = ont.operands.where((F.col("p") == V.CHAIN) & (F.size("texts") > 1)).select("owner", "texts").withColumn("i", F.explode(F.sequence(F.lit(2), F.size("texts"))))
    begun = lambda n: F.when(n == 1, F.element_at("texts", 1)).otherwise(F.concat(F.lit("chain("), F.array_join(F.slice("texts", 1, n), " "), F.lit(")")))
    steps = chains.select(begun(F.col("i") - 1).alias("p"), F.element_at("texts", F.col("i")).alias("q"), F.when(F.col("i") == F.size("texts"), F.col("owner")).otherwise(begun(F.col("i"))).alias("r"))
    rules = transitive.unionByName(steps).distinct()
    return rules.join(above.select(F.col("p").alias("r"), F.col("q").alias("over")), "r", "left").select("p", "q", F.coalesce("over", "r").alias("r")).distinct()


def _replaced(rows: DataFrame, same_as: DataFrame, column: str) -> DataFrame:
    """rows with the node that stands for another in its place."""
    return rows.join(same_as.select(F.col("node").alias(column), F.col("rep").alias("rep_")), column, "left").withColumn(column, F.coalesce("rep_", column)).drop("rep_").select(rows.columns)


def _every(rows: DataFrame, same_as: DataFrame, column: str) -> DataFrame:
    """rows for every node that one in the column stands for."""
    return rows.join(same_as.select(F.col("rep").alias(column), F.col("node").alias("node_")), column, "left").withColumn(column, F.coalesce("node_", column)).drop("node_").select(rows.columns)


def _collapsed(told_: DataFrame, some: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """told_, some, and parts (whole, head, i, n, y) with one node for all that are told to be the same, or are expressions of the same parts; and node, rep of
    these nodes. Every such pair follows by the completion rules, so nothing is lost, and many classes that are the same cost no pairs of them.

    A round for each level of expressions. parts: of intersections with the same parts one stays; i counts from the part that the fewest are told to be under.
    """
    heads, same_as = parts.select("whole", F.col("whole").alias("head")).distinct(), None
    while True:
        mutual = told_.join(told_.select(F.col("y").alias("z"), F.col("z").alias("y")), ["y", "z"], "left_semi").where("y < z").select(F.col("y").alias("a"), F.col("z").alias("b"))
        alike = some.groupBy("p", "f").agg(F.min("e").alias("a"), F.collect_set("e").alias("es")).where("size(es) > 1").select("a", F.explode("es").alias("b"))
        wholes = settle(parts.groupBy("whole").agg(F.array_sort(F.collect_set("y")).alias("ys")).join(heads, "whole"), "wholes")
        equal = wholes.groupBy("ys").agg(F.min("head").alias("a"), F.collect_set("head").alias("hs")).where("size(hs) > 1").select("a", F.explode("hs").alias("b"))
        links = mutual.unionByName(alike).unionByName(equal).where((F.col("a") != F.col("b")) & ~F.col("a").isin(V.THING, V.NOTHING) & ~F.col("b").isin(V.THING, V.NOTHING))
        found = graph.components(links)
        if same_as is not None and found.isEmpty():
            break
        same_as = found if same_as is None else settle(_replaced(same_as, found, "rep").unionByName(found.join(same_as, "node", "left_anti")), "same")
        told_ = settle(_replaced(_replaced(told_, found, "y"), found, "z").where("y <> z").distinct(), "told")
        some = settle(_replaced(_replaced(some, found, "e"), found, "f").distinct(), "some")
        parts = settle(_replaced(parts, found, "y").distinct(), "parts")
        heads = settle(_replaced(heads, found, "head"), "heads")
        if found.isEmpty():
            break
    kept = wholes.groupBy("ys").agg(F.min_by("whole", "whole").alias("whole"), F.min("head").alias("head"))
    common = told_.groupBy(F.col("z").alias("y")).agg(F.count("*").alias("uses"))
    ranked = kept.select("whole", "head", F.explode("ys").alias("y")).join(common, "y", "left").groupBy("whole", "head").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "y"))).alias("ys"))
    return told_, some, settle(ranked.select("whole", "head", F.size("ys").alias("n"), F.posexplode(F.transform("ys", lambda v: v["y"])).alias("i", "y")), "parts"), same_as


def _numbered(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame, Callable[[Column], Column]]:
    """The tables with numbers in place of texts; text, id of all of these; and the number of a text. Numbers are hashes, by another seed if two texts have the same."""
    texts = {k: [c for c, t in df.dtypes if t == "string"] for k, df in tables.items()}
    fixed = next(iter(tables.values())).sparkSession.createDataFrame([(V.THING,), (V.NOTHING,)], "text string")  # these may come up in rounds only
    every = settle(reduce(DataFrame.unionByName, [df.select(F.col(c).alias("text")) for k, df in tables.items() for c in texts[k]], fixed).distinct(), "texts")
    seed = 0
    while not every.groupBy(F.xxhash64("text", F.lit(seed)).alias("id")).count().where("count > 1").isEmpty():
        seed += 1
    number = lambda text: F.xxhash64(text, F.lit(seed))
    out = {k: settle(df.select([number(F.col(c)).alias(c) if c in texts[k] else F.col(c) for c in df.columns]), k) for k, df in tables.items()}
    return out, every.select("text", number(F.col("text")).alias("id")), number


def _saturated(ont: Ontology, individuals: bool = False, probes: bool = False) -> tuple[DataFrame, DataFrame]:
    """x, y: every named class or expression x (by its text) and what it is under, itself and Nothing among these; of nodes that are the same one stands for all. node, rep:
    the nodes that others stand for, and these.

    The completion rules of EL: told subclasses (general ones too), equivalences both ways, intersections both ways, existential restrictions and
    has-value both ways with the hierarchy of properties, chains and transitive properties, domains, classes disjoint in pairs or
    groups, disjoint unions, and Nothing along existential edges. Thing is above all without being listed, but counts as a filler and on the left. Every round joins
    what is new only, and intersections are met at their rarest part. Expressions are nodes by their canonical texts. individuals: one(i) for every named individual i is a node, under the classes it is said to be of and
    restrictions for what it is related to. probes: some(p Thing) is a node for every object property p.
    """
    key = f"_saturated{individuals:d}{probes:d}"
    if key in ont.__dict__:
        return ont.__dict__[key]
    texts = settle(ont.expressions.where("label IS NOT NULL").select("expr", "op", "prop", "filler", "label").distinct(), "labels")
    by_name = texts.select(F.col("expr").alias("name"), "label").distinct()
    text_of = lambda rows, c: rows.join(by_name.withColumnRenamed("name", c), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
    said = text_of(text_of(ont.with_p(V.SUBCLASS, V.EQUIVALENT).select("s", "p", "o"), "o"), "s").where("s <> o AND NOT startswith(s, '_:')").distinct()
    one = lambda c: F.concat(F.lit("one("), F.col(c), F.lit(")"))
    inside = text_of(ont.members.join(texts.where("op = 'and'").select("expr", F.col("label").alias("whole")), "expr").select("whole", F.col("member").alias("m")), "m").distinct()
    same = said.where(F.col("p") == V.EQUIVALENT)
    unions = ont.operands.where(F.col("p") == V.DISJOINT_UNION).select("owner", F.explode("texts").alias("m"))
    told_ = said.select(F.col("s").alias("y"), F.col("o").alias("z")).unionByName(same.select(F.col("o").alias("y"), F.col("s").alias("z"))).unionByName(inside.select(F.col("whole").alias("y"), F.col("m").alias("z"))).unionByName(unions.select(F.col("m").alias("y"), F.col("owner").alias("z")))
    parts = inside.where(F.col("m") != V.THING).withColumnRenamed("m", "y")
    above = settle(_above(ont).select(F.col("prop").alias("p"), F.col("over").alias("q")), "above")
    some = text_of(texts.where("op = 'some'").select(F.col("label").alias("e"), F.col("prop").alias("p"), F.col("filler").alias("f")), "f")
    some = some.unionByName(texts.where("op = 'value'").select(F.col("label").alias("e"), F.col("prop").alias("p"), one("filler").alias("f")))
    objects = ont.declared.where("kind = 'object-property'").select(F.col("iri").alias("p"))
    if individuals:
        named = ont.declared.where("kind = 'individual'").select(F.col("iri").alias("s"))
        own = text_of(ont.with_p(V.TYPE).join(named, "s", "left_semi").where(~F.col("o").startswith(V.OWL)).select("s", "o"), "o").select(one("s").alias("y"), F.col("o").alias("z"))
        related = ont.rows.where("s_kind = 'iri' AND o_kind = 'iri'").join(objects, "p", "left_semi").join(named, "s", "left_semi").join(named.select(F.col("s").alias("o")), "o", "left_semi")
        related = related.select(one("s").alias("y"), "p", one("o").alias("f")).withColumn("z", F.concat(F.lit("some("), "p", F.lit(" "), "f", F.lit(")"))).distinct()
        told_ = told_.unionByName(own).unionByName(related.select("y", "z"))
        some = some.unionByName(related.select(F.col("z").alias("e"), "p", "f"))
    if probes:
        some = some.unionByName(objects.select(F.concat(F.lit("some("), "p", F.lit(f" {V.THING})")).alias("e"), "p", F.lit(V.THING).alias("f")))
    told_, some, parts, same_as = _collapsed(settle(told_.distinct(), "told"), settle(some.distinct(), "some"), settle(parts, "parts"))
    rep = lambda rows, c: _replaced(rows, same_as, c)
    raised = some.join(above, "p", "left").select(F.col("e").alias("y"), F.coalesce("q", "p").alias("q"), "f").distinct()
    rules = _compositions(ont, above)
    domains = rep(text_of(ont.with_p(V.DOMAIN).select(F.col("s").alias("p"), "o"), "o").select("p", F.col("o").alias("y")), "y").distinct()
    apart = rep(rep(text_of(text_of(ont.with_p(V.DISJOINT).select("s", "o"), "o"), "s").select(F.col("s").alias("y"), F.col("o").alias("other")), "y"), "other").distinct()
    groups = ont.axioms.where("ax_type IN ('DisjointClasses', 'DisjointUnion') AND size(operands) > 1").select("ax_id", F.explode("operands").alias("y"))
    groups = rep(groups, "y").groupBy("ax_id", "y").agg(F.count("*").alias("n"))  # operands that are the same count as several
    nodes = rep(ont.declared.where("kind = 'class'").select(F.col("iri").alias("x")), "x").unionByName(told_.select(F.col("y").alias("x"))).unionByName(told_.select(F.col("z").alias("x"))).unionByName(some.select(F.col("f").alias("x"))).unionByName(some.select(F.col("e").alias("x"))).distinct()
    tables = {"told": told_, "some": some, "parts": parts, "raised": raised, "rules": rules, "domains": domains, "apart": apart, "groups": groups, "nodes": nodes}
    tables, ids, number = _numbered(tables)  # rounds move, compare and write numbers only
    told_, some, parts, raised, rules, domains, apart, groups, nodes = tables.values()
    thing, nothing = number(F.lit(V.THING)), number(F.lit(V.NOTHING))
    none = nothing.alias("y")
    with_thing = some.where(F.col("f") == thing).select("e", "p")
    # rules whose premises the ontology never has stay out of the plans
    has_parts, has_rules, has_domains, has_apart, has_groups, has_thing = (not t.isEmpty() for t in (parts, rules, domains, apart, groups, with_thing))
    has_edges = not some.isEmpty()
    fails = has_apart or has_groups or not told_.where(F.col("z") == nothing).isEmpty()

    def through(edges: DataFrame, under: DataFrame) -> DataFrame:  # an edge to what is under a filler, and to Nothing
        ends = under.select(F.col("x").alias("f"), "y")
        up = edges.select("x", "p", "f").join(ends.join(some.select("e", F.col("p"), F.col("f").alias("y")), "y"), ["p", "f"]).select("x", F.col("e").alias("y"))
        return up.unionByName(edges.join(ends.where(F.col("y") == nothing), "f").select("x", none)) if fails else up

    def onward(left: DataFrame, right: DataFrame) -> DataFrame:  # along two edges that a rule composes
        ahead = right.select(F.col("x").alias("f"), F.col("p").alias("q"), F.col("f").alias("g"))
        return left.join(rules, "p").join(ahead, ["f", "q"]).select("x", F.col("r").alias("p"), F.col("g").alias("f"))

    def clash(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(apart, "y").select("x", F.col("other").alias("y")).join(right, ["x", "y"]).select("x", none)

    def next_part(held: DataFrame, under: DataFrame) -> DataFrame:  # one more part of an intersection
        wanted = parts.where("i > 0").select("whole", (F.col("i") - 1).alias("i"), "y")
        return held.join(wanted, ["whole", "i"]).join(under, ["x", "y"]).select("x", "whole", (F.col("i") + 1).alias("i"))

    last = parts.where("i = n - 1").select("whole", "i", "head")
    state = _Fixpoint(sub=["x", "y"], edge=["x", "p", "f"], **({"held": ["x", "whole", "i"]} if has_parts else {}))
    start = nodes.select("x", F.col("x").alias("y")).unionByName(nodes.withColumn("y", thing).join(told_, "y").select("x", F.col("z").alias("y")))
    none_yet = nodes.limit(0)
    more = state.add(sub=[start], edge=[none_yet.select("x", F.col("x").alias("p"), F.col("x").alias("f"))], held=[none_yet.select("x", F.col("x").alias("whole"), F.lit(0).alias("i"))])
    while more:
        sub, edge, known = state.fresh["sub"], state.fresh["edge"], state.known["sub"]
        begun, derived, steps = [], [], []
        if state.moved["sub"]:
            derived.append(sub.join(told_, "y").select("x", F.col("z").alias("y")))
            steps.append(sub.join(raised, "y").select("x", F.col("q").alias("p"), "f"))
        if has_parts:
            begun = state.both("held", "sub", next_part)
            if state.moved["sub"]:
                begun.append(sub.join(parts.where("i = 0"), "y").select("x", "whole", "i"))
            if state.moved["held"]:
                derived.append(state.fresh["held"].join(last, ["whole", "i"]).select("x", F.col("head").alias("y")))
        if has_groups and state.moved["sub"]:
            met = sub.join(groups, "y").select("x", "ax_id").distinct().join(groups, "ax_id").join(known, ["x", "y"]).groupBy("x", "ax_id").agg(F.sum("n").alias("m"))
            derived.append(met.where("m > 1").select("x", none))
        if has_apart:
            derived += state.both("sub", "sub", clash)
        if has_domains and state.moved["edge"]:
            derived.append(edge.join(domains, "p").select("x", "y"))
        if has_thing and state.moved["edge"]:
            derived.append(edge.join(with_thing, "p").select("x", F.col("e").alias("y")))
        derived += state.both("edge", "sub", through) if has_edges else []
        steps += state.both("edge", "edge", onward) if has_rules else []
        more = state.add(sub=derived, edge=steps, held=begun)
    text = lambda c: ids.select(F.col("id").alias(c), F.col("text").alias(f"{c}_"))
    sub = state.known["sub"].join(text("x"), "x").join(text("y"), "y").select(F.col("x_").alias("x"), F.col("y_").alias("y"))
    ont.__dict__[key] = settle(sub, "saturated"), same_as
    return ont.__dict__[key]


def saturated(ont: Ontology, individuals: bool = False, probes: bool = False) -> DataFrame:
    """x, y as in _saturated(), with every node on both sides: in the square of what is the same."""
    sub, same_as = _saturated(ont, individuals, probes)
    return _every(_every(sub, same_as, "x"), same_as, "y")


def realized(ont: Ontology) -> DataFrame:
    """individual, cls: the named classes that named individuals are of, by what they are said to be and related to, and by definitions."""
    sub, same_as = _saturated(ont, individuals=True)
    found = _every(_every(sub, same_as, "x").where("startswith(x, 'one(')"), same_as, "y").select(F.substring(F.col("x"), F.lit(5), F.length("x") - 5).alias("individual"), F.col("y").alias("cls"))
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("cls"))
    named = ont.declared.where("kind = 'individual'").select(F.col("iri").alias("individual"))
    return found.join(classes, "cls", "left_semi").join(named, "individual", "left_semi").select("individual", "cls").distinct()


def unsatisfiable_properties(ont: Ontology) -> DataFrame:
    """iri: object properties that nothing can have: what has them would be in Nothing."""
    probe = ont.declared.where("kind = 'object-property'").select("iri", F.concat(F.lit("some("), "iri", F.lit(f" {V.THING})")).alias("x"))
    sub, same_as = _saturated(ont, probes=True)
    bottom = _every(sub.where(F.col("y") == V.NOTHING), same_as, "x").select("x")
    return probe.join(bottom, "x", "left_semi").select("iri").distinct()


def _named(ont: Ontology) -> tuple[DataFrame, DataFrame]:
    """child, parent: named subsumptions between different classes, of classes told to be the same the first by code point only; and iri, rep: every named class, and this one of its kind."""
    if "_named_pairs" not in ont.__dict__:
        sub, same_as = _saturated(ont)
        names = ont.declared.where("kind = 'class'").select("iri").unionByName(told(ont).select(F.col("child").alias("iri"))).unionByName(told(ont).select(F.col("parent").alias("iri"))).distinct()
        kinds = settle(names.join(same_as.select(F.col("node").alias("iri"), "rep"), "iri", "left").select("iri", F.coalesce("rep", "iri").alias("of")), "names")
        first = settle(kinds.groupBy("of").agg(F.min("iri").alias("rep")), "first")
        at = lambda old, new: first.select(F.col("of").alias(old), F.col("rep").alias(new))
        pairs = sub.where((F.col("x") != F.col("y")) & (F.col("y") != V.NOTHING)).join(at("x", "child"), "x").join(at("y", "parent"), "y").select("child", "parent")
        ont.__dict__["_named_pairs"] = settle(pairs, "classified"), settle(kinds.join(first, "of").select("iri", "rep"), "kinds")
    return ont.__dict__["_named_pairs"]


def _for_all(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """child, parent for every class of both kinds, and of each kind all pairs of its classes. A large kind is joined in shares of some 256, so no task makes all of its pairs."""
    shares = kinds.groupBy("rep").agg(F.ceil(F.count("*") / 256).cast("int").alias("n"))
    kinds = settle(kinds.join(shares, "rep").select("iri", "rep", F.pmod(F.xxhash64("iri"), F.col("n")).cast("int").alias("share"), "n"), "shares")
    sizes = kinds.select("rep", "n").distinct()
    at = lambda c: kinds.select(F.col("iri").alias(c), F.col("rep").alias(f"{c}_"), F.col("share").alias(f"{c}_share"))
    every = lambda rows, c: rows.join(sizes.select(F.col("rep").alias(f"{c}_"), "n"), f"{c}_").withColumn(f"{c}_share", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    of = pairs.select(F.col("child").alias("child_"), F.col("parent").alias("parent_"))
    within = sizes.select(F.col("rep").alias("child_"), F.col("rep").alias("parent_"))
    shared = every(every(of.unionByName(within), "child"), "parent")
    return shared.join(at("child"), ["child_", "child_share"]).join(at("parent"), ["parent_", "parent_share"]).where("child <> parent").select("child", "parent")


def classify(ont: Ontology) -> DataFrame:
    """child, parent: all named subsumptions that follow by saturated(), but for a class and itself. What an unsatisfiable class is under besides
    (everything) is left out; unsatisfiable() names these."""
    return _for_all(*_named(ont))


def _direct(ont: Ontology) -> DataFrame:
    """child, parent: the reduction of classify(), worked out on one class of each kind."""
    pairs, kinds = _named(ont)
    return _for_all(graph.reduction(pairs, closed=True), kinds)


def inferred(ont: Ontology, indirect: bool = False, keep_redundant: bool = False) -> DataFrame:
    """child, parent, is_inferred: the hierarchy after reasoning: direct links (or all), asserted ones marked false; asserted links that
    are no longer direct go, unless they are to be kept."""
    links = classify(ont) if indirect else _direct(ont)
    asserted = ont.edges.where("kind = 'class' AND o_kind = 'iri'").select("child", "parent").distinct().withColumn("told", F.lit(True))
    out = links.join(asserted, ["child", "parent"], "full" if keep_redundant else "left")
    return out.select("child", "parent", F.col("told").isNull().alias("is_inferred"))


def reduced(ont: Ontology) -> DataFrame:
    """child, parent: named subclass links without those that others imply."""
    return graph.reduction(ont.edges.where("kind = 'class' AND o_kind = 'iri'").select("child", "parent"))


def reduced_expressions(ont: Ontology) -> DataFrame:
    """subject, object: subclass statements with an expression on the right that stay when those go that others imply.

    A statement is implied if the subject is under an expression, said of it or of what it is under, that is under this one: by the same or narrower fillers, by
    properties below, by more conjuncts, as saturated() finds. Of statements that imply each other about one subject the first by code point stays.
    """
    own = settle(ont.axioms.where("ax_type = 'SubClassOf' AND object_kind = 'bnode' AND subject_kind = 'iri'").select("subject", "object").distinct(), "own")
    above = settle(graph.closure(told(ont)).where("child <> parent").select(F.col("child").alias("subject"), F.col("parent").alias("over")), "above")
    back = above.select(F.col("subject").alias("over"), F.col("over").alias("subject"), F.lit(True).alias("back"))
    over = above.join(back, ["subject", "over"], "left").where("back IS NULL OR over < subject")  # of classes that are the same the first keeps what is said
    about = own.select("subject", "object", F.lit(True).alias("self")).unionByName(over.join(own.withColumnRenamed("subject", "over"), "over").select("subject", "object", F.lit(False).alias("self")))
    about = settle(about.distinct(), "about")
    sub, same_as = _saturated(ont)
    objects = about.select(F.col("object").alias("node")).distinct().join(same_as, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))
    objects = settle(objects, "objects")
    wide = sub.join(objects.select(F.col("node").alias("object"), F.col("rep").alias("x")), "x").join(objects.select(F.col("node").alias("target"), F.col("rep").alias("y")), "y").where("object <> target").select("object", "target")
    wide = settle(wide, "wide")
    narrower = about.join(wide, "object").select("subject", F.col("object").alias("by"), F.col("target").alias("object"), "self")
    same = about.where("NOT self").select("subject", F.col("object").alias("by"), "object", "self")
    hits = own.join(narrower.unionByName(same), ["subject", "object"])
    mutual = wide.select("object", F.col("target").alias("by"), F.lit(True).alias("mutual"))
    hits = hits.join(mutual, ["object", "by"], "left").where("NOT self OR mutual IS NULL OR by < object")
    return own.join(hits.select("subject", "object").distinct(), ["subject", "object"], "left_anti")


def relaxed(ont: Ontology, include_subclass: bool = False, exclude_named: bool = False, obo_only: bool = False) -> DataFrame:
    """subject, object: the subclass statements that equivalences of named classes imply, by texts: of an expression the named classes and existential restrictions that
    it is or that it holds as an intersection, at any level. A cardinality over 0 (at most, too) counts as an existential restriction.

    include_subclass: subclass statements with expressions are treated alike. exclude_named: equivalences between named classes are left out. obo_only: no restrictions of
    anonymous fillers or properties. What is asserted already, and links of a class to itself, are left out.
    """
    ax = ont.axioms.where("object_kind IN ('iri', 'bnode')")
    eq = ax.where("ax_type = 'EquivalentClasses'").select("subject", "subject_kind", "object", "object_kind")
    both = eq.unionByName(eq.select(F.col("object").alias("subject"), F.col("object_kind").alias("subject_kind"), F.col("subject").alias("object"), F.col("subject_kind").alias("object_kind")))
    if include_subclass:
        both = both.unionByName(ax.where("ax_type = 'SubClassOf' AND object_kind = 'bnode'").select("subject", "subject_kind", "object", "object_kind"))
    both = both.where("subject_kind = 'iri'" + (" AND object_kind = 'bnode'" if exclude_named else "")).select("subject", "object", "object_kind").distinct()
    texts = ont.labels.select(F.col("node").alias("part"), "text")
    of_text = ont.expressions.where("label IS NOT NULL").select("expr", "op", "prop", "n", "label").distinct()
    parts = ont.parts.join(texts, "part", "left").select("expr", "role", F.coalesce("text", "part").alias("part"), "part_kind").distinct()
    held = settle(parts.where("role = 'part'").join(of_text.where("op = 'and'"), "expr").select(F.col("label").alias("object"), "part", "part_kind").distinct(), "held")
    named = F.max(F.when(F.col("part_kind") == "bnode", 1).otherwise(0)) == 0
    filled = parts.join(of_text.where("op = 'some' OR (op IN ('min', 'max', 'exact') AND cast(n AS bigint) > 0)"), "expr").groupBy("expr", "label").agg(
        F.max(F.when(F.col("role") == "prop", F.col("part"))).alias("on"), F.max(F.when(F.col("role") == "part", F.col("part"))).alias("of"), named.alias("plain")
    )
    some = filled.where("plain" if obo_only else "true").select(F.col("label").alias("object"), F.concat(F.lit("some("), "on", F.lit(" "), "of", F.lit(")")).alias("as_some")).distinct()
    front, found = both, []
    while not front.isEmpty():  # a round for each level of intersections in intersections
        found.append(front)
        front = settle(front.where("object_kind = 'bnode'").join(held, "object").select("subject", F.col("part").alias("object"), F.col("part_kind").alias("object_kind")).distinct(), "opened")
    every = reduce(DataFrame.unionByName, found or [both])
    out = every.where("object_kind = 'iri'").select("subject", "object").unionByName(every.join(settle(some, "some"), "object").select("subject", F.col("as_some").alias("object")))
    asserted = ont.axioms.where("ax_type = 'SubClassOf'").select("subject", "object")
    return out.where("subject <> object").distinct().join(asserted, ["subject", "object"], "left_anti")


def materialized(ont: Ontology, properties: list[str] | None = None) -> DataFrame:
    """cls, prop, filler: existential parents that classes get from their superclasses and by the property hierarchy, but for
    what they have themselves, Thing, and a class of itself."""
    some = settle(restrictions(ont), "some")
    above = settle(graph.closure(told(ont)).where("child <> parent"), "above")
    props = graph.closure(ont.edges.where("kind = 'property' AND o_kind = 'iri'")).select(F.col("child").alias("prop"), F.col("parent").alias("over"))
    own = above.join(some.select(F.col("cls").alias("parent"), "prop", "filler"), "parent").select(F.col("child").alias("cls"), "prop", "filler").unionByName(some)
    wide = own.unionByName(own.join(props, "prop").select("cls", F.col("over").alias("prop"), "filler")).distinct()
    found = wide.join(some, ["cls", "prop", "filler"], "left_anti").where((F.col("filler") != V.THING) & (F.col("filler") != F.col("cls")))
    return found.where(F.col("prop").isin(list(properties))) if properties else found


def equivalences(ont: Ontology, policy: str = "all") -> DataFrame:
    """a, b with a < b: classes that come out as the same and that the policy ("all", "none", "asserted-only") does not allow:
    all allows any, none allows none, asserted-only allows those that were said."""
    if policy not in ("all", "none", "asserted-only"):
        raise ValueError(f"unknown policy {policy}")
    pairs, kinds = _named(ont)
    mutual = _for_all(pairs.join(pairs.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"], "left_semi"), kinds).where("child < parent").select(F.col("child").alias("a"), F.col("parent").alias("b"))
    if policy == "all":
        return mutual.limit(0)
    if policy == "none":
        return mutual
    said = ont.with_p(V.EQUIVALENT).where("o_kind = 'iri'").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    return mutual.join(said, ["a", "b"], "left_anti")


def unsatisfiable(ont: Ontology) -> DataFrame:
    """iri: named classes that come out under Nothing: under both sides of a disjointness, or with an existential edge to such a class."""
    sub, same_as = _saturated(ont)
    pairs = _every(sub.where((F.col("y") == V.NOTHING) & (F.col("x") != V.NOTHING)), same_as, "x").select(F.col("x").alias("iri"))
    return pairs.join(ont.declared.where("kind = 'class'").select("iri"), "iri", "left_semi").distinct()


def incoherent_module(ont: Ontology) -> DataFrame:
    """Axioms of the bottom module of the unsatisfiable classes: what their clashes follow from."""
    return graph.module(ont, unsatisfiable(ont).select(F.col("iri").alias("node")))


def reasoned(ont: Ontology, reasoner: str = "el", new_ontology: bool = False, indirect: bool = False) -> DataFrame:
    """Triples after reasoning: those of the ontology (unless new_ontology) and subclass links between different classes that follow
    and were not said. reasoner: "el", or "structural": what is told by name. indirect: all links, not direct ones only."""
    if reasoner not in ("el", "structural"):
        raise ValueError(f"unknown reasoner {reasoner}")
    if reasoner == "el":
        links = classify(ont) if indirect else _direct(ont)
    else:
        pairs = settle(graph.closure(told(ont)).where("child <> parent"), "classified")
        links = pairs if indirect else graph.reduction(pairs)
    fresh = links.join(ont.edges.where("kind = 'class'").select("child", "parent"), ["child", "parent"], "left_anti")
    made = setops.generated(F.col("child"), V.SUBCLASS, F.col("parent"), fresh)
    return made if new_ontology else setops.merge(ont.rows, made, shared=True)


def _above(ont: Ontology) -> DataFrame:
    """prop, over: properties and all their superproperties, themselves among them."""
    edges = ont.edges.where("kind = 'property' AND o_kind = 'iri'")
    own = ont.declared.where("kind IN ('object-property', 'data-property')").select(F.col("iri").alias("prop"), F.col("iri").alias("over"))
    return settle(own.unionByName(graph.closure(edges).select(F.col("child").alias("prop"), F.col("parent").alias("over"))).distinct(), "properties")


def inferred_property_axioms(ont: Ontology) -> DataFrame:
    """ax_type, subject, object: subproperties by transitivity, inverses both ways, domains and ranges from superproperties."""
    above = _above(ont)
    inverse = ont.with_p(V.INVERSE).where("s_kind = 'iri' AND o_kind = 'iri'")
    kinds = F.when(F.col("p") == V.DOMAIN, "PropertyDomain").otherwise("PropertyRange")
    bounds = ont.with_p(V.DOMAIN, V.RANGE).where("o_kind = 'iri'").select(kinds.alias("ax_type"), F.col("s").alias("over"), F.col("o").alias("object"))
    parts = [
        above.where("prop <> over").select(F.lit("SubPropertyOf").alias("ax_type"), F.col("prop").alias("subject"), F.col("over").alias("object")),
        inverse.select(F.lit("InverseProperties").alias("ax_type"), F.col("s").alias("subject"), F.col("o").alias("object")),
        inverse.select(F.lit("InverseProperties").alias("ax_type"), F.col("o").alias("subject"), F.col("s").alias("object")),
        bounds.join(above, "over").select("ax_type", F.col("prop").alias("subject"), "object"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


#: generator -> kind of property and axiom type, for what inferred_property_axioms() finds
_OF_PROPERTIES = {
    "subobjectproperty": ("object-property", "SubPropertyOf"), "subdataproperty": ("data-property", "SubPropertyOf"), "inverseobjectproperties": ("object-property", "InverseProperties"),
    "objectpropertydomain": ("object-property", "PropertyDomain"), "objectpropertyrange": ("object-property", "PropertyRange"),
}
GENERATORS = ["subclass", "equivalentclass", "classassertion", "propertyassertion", "equivalentobjectproperty", "equivalentdataproperty", "objectpropertycharacteristic", "datapropertycharacteristic", *_OF_PROPERTIES]


def _generated(ont: Ontology, generator: str, indirect: bool) -> DataFrame:
    row = lambda df, kind, s, o: df.select(F.lit(kind).alias("ax_type"), F.col(s).alias("subject"), F.col(o).alias("object"))
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("child"))
    if generator == "subclass":
        links = settle(inferred(ont, indirect).select("child", "parent"), "links")
        top = classes.join(links, "child", "left_anti").withColumn("parent", F.lit(V.THING))
        return row(links.unionByName(top), "SubClassOf", "child", "parent")
    if generator == "equivalentclass":
        return row(equivalences(ont, "none"), "EquivalentClasses", "a", "b")
    if generator == "classassertion":
        return row(realized(ont), "ClassAssertion", "individual", "cls")
    if generator == "propertyassertion":
        return property_assertions(ont).select(F.lit("ObjectPropertyAssertion").alias("ax_type"), "subject", "object", F.col("prop").alias("property"))
    kind = "data-property" if "data" in generator else "object-property"
    own = ont.declared.where(F.col("kind") == kind).select(F.col("iri").alias("subject"))
    if generator.endswith("characteristic"):
        return ont.axioms.where(F.col("ax_type").isin(*CHARACTERISTICS.values())).join(own, "subject", "left_semi").select("ax_type", "subject", "object")
    if generator.startswith("equivalent"):
        above = _above(ont).where("prop <> over")
        mutual = above.join(above.select(F.col("over").alias("prop"), F.col("prop").alias("over")), ["prop", "over"], "left_semi").where("prop < over")
        return row(mutual, "EquivalentProperties", "prop", "over").join(own, "subject", "left_semi")
    kind, ax_type = _OF_PROPERTIES[generator]
    return inferred_property_axioms(ont).where(F.col("ax_type") == ax_type).join(own, "subject", "left_semi")


def inferred_axioms(
    ont: Ontology, generators: list[str] = ("subclass",), indirect: bool = False, exclude_duplicates: bool = False, exclude_external: bool = False, exclude_thing: bool = False, exclude_tautologies: bool = False, annotate: bool = False
) -> DataFrame:
    """ax_type, subject, property, object, notes: what the generators (of GENERATORS) find, each axiom once.

    indirect: subclass links to all superclasses. A class that is under no other is under Thing. exclude_duplicates: without what the ontology says, and without Thing;
    exclude_external: without class axioms of classes that the ontology declares none of; exclude_thing: without axioms that name Thing;
    exclude_tautologies: without those that hold by their form. annotate: axioms get is_inferred "true" as a note.
    """
    if unknown := [g for g in generators if g not in GENERATORS]:
        raise ValueError(f"unknown generators {unknown}")
    of_type = {v: k for k, v in AXIOM_TYPES.items()} | dict.fromkeys([*CHARACTERISTICS.values(), "ClassAssertion"], V.TYPE)
    found = []
    for g in generators:
        rows = _generated(ont, g, indirect)
        found.append(rows if "property" in rows.columns else rows.withColumn("property", case("ax_type", of_type, F.lit(None))))
    out = reduce(DataFrame.unionByName, [f.select("ax_type", "subject", "property", "object") for f in found]).distinct()
    if exclude_external:
        declared = ont.declared.select("iri").distinct()
        own = lambda c: out.join(declared.withColumnRenamed("iri", c), c, "left_semi")
        inside = own("subject").unionByName(own("object")).distinct()
        kinds = F.col("ax_type").isin("SubClassOf", "EquivalentClasses", "DisjointClasses")
        out = out.where(~kinds).unionByName(inside.where(kinds))
    if exclude_duplicates:
        said = ont.axioms.select("ax_type", "subject", "property", "object")
        mutual = said.where(F.col("ax_type").isin("EquivalentClasses", "EquivalentProperties", "InverseProperties")).select("ax_type", F.col("object").alias("subject"), "property", F.col("subject").alias("object"))
        out = out.join(said.unionByName(mutual).distinct(), ["ax_type", "subject", "property", "object"], "left_anti")
    if exclude_duplicates or exclude_thing:
        out = out.where((F.col("subject") != V.THING) & (F.col("object") != V.THING))
    if exclude_tautologies:
        out = out.where(~axfilter.structural_tautology())
    note = F.array(F.lit(f"{V.IS_INFERRED}=true")) if annotate else F.array().cast("array<string>")
    return out.withColumn("notes", note)


def property_assertions(ont: Ontology) -> DataFrame:
    """subject, prop, object: what named things are said to be related to by object properties, and by superproperties and stated
    inverses of these."""
    objects = ont.declared.where("kind = 'object-property'").select(F.col("iri").alias("p"))
    said = ont.rows.where("s_kind = 'iri' AND o_kind = 'iri'").join(objects, "p", "left_semi").select(F.col("s").alias("subject"), F.col("p").alias("prop"), F.col("o").alias("object")).distinct()
    pairs = ont.with_p(V.INVERSE).where("o_kind = 'iri'").select(F.col("s").alias("prop"), F.col("o").alias("back"))
    inverse = settle(pairs.unionByName(pairs.select(F.col("back").alias("prop"), F.col("prop").alias("back"))).distinct(), "inverse")
    above = _above(ont)
    known = settle(said, "assertions")
    size = known.count()
    while True:
        up = known.join(above, "prop").select("subject", F.col("over").alias("prop"), "object")
        back = known.join(inverse, "prop").select(F.col("object").alias("subject"), F.col("back").alias("prop"), F.col("subject").alias("object"))
        known = settle(known.unionByName(up).unionByName(back).distinct(), "assertions")
        if (now := known.count()) == size:
            return known
        size = now


def relation_graph(ont: Ontology) -> DataFrame:
    """cls, prop, filler: existential parents of classes, their own and those that they get."""
    return restrictions(ont).unionByName(materialized(ont)).distinct()


def subset(ont: Ontology, nodes: DataFrame) -> DataFrame:
    """subject, prop, object between the nodes (column node) only: their hierarchy over what is left out, without links
    that others imply, and their existential relations."""
    links = graph.reduction(graph.span_gaps(ont.edges.where("kind = 'class' AND o_kind = 'iri'"), nodes)).select(F.col("child").alias("subject"), F.lit(V.SUBCLASS).alias("prop"), F.col("parent").alias("object"))
    both = relation_graph(ont).join(nodes.select(F.col("node").alias("cls")).distinct(), "cls", "left_semi").join(nodes.select(F.col("node").alias("filler")).distinct(), "filler", "left_semi")
    return links.unionByName(both.select(F.col("cls").alias("subject"), "prop", F.col("filler").alias("object"))).distinct()


#: axiom types that each profile leaves out
_OUTSIDE = {
    "EL": ["InverseProperties", "SymmetricProperty", "AsymmetricProperty", "IrreflexiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "DisjointProperties", "DisjointUnion"],
    "QL": ["TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "SameIndividual", "SubPropertyChainOf", "DisjointUnion", "HasKey", "NegativePropertyAssertion"],
    "RL": ["ReflexiveProperty", "DisjointUnion"],
}
#: constructors that each profile allows on the left ("sub") and on the right ("super") of a subclass axiom
_ALLOWED = {
    "EL": {"sub": ["and", "some", "one", "value", "self"], "super": ["and", "some", "one", "value", "self"]},
    "QL": {"sub": ["some"], "super": ["and", "some", "not"]},
    "RL": {"sub": ["and", "or", "one", "some", "value"], "super": ["and", "not", "all", "max", "value"]},
}


def sided(ont: Ontology) -> DataFrame:
    """ax_id, side, op, n, size, plain, thing: every expression inside of a logical axiom, on the side ("sub" or "super") where it counts; size: its parts, plain: all of them are named,
    thing: its only part is Thing. Sides of equivalences count as both; a complement changes the side."""
    ax = ont.axioms.where("ax_type IN ('SubClassOf', 'EquivalentClasses', 'DisjointClasses', 'PropertyDomain', 'PropertyRange', 'ClassAssertion', 'HasKey', 'DisjointUnion')")
    both, sub, sup = (F.array(*[F.lit(x) for x in xs]) for xs in (("sub", "super"), ("sub",), ("super",)))
    left = F.when(F.col("ax_type") == "EquivalentClasses", both).otherwise(sub)
    right = F.when(F.col("ax_type") == "EquivalentClasses", both).when(F.col("ax_type") == "DisjointClasses", sub).otherwise(sup)
    ends = ax.where("subject_kind = 'bnode' AND size(operands) = 0").select("ax_id", F.col("subject").alias("text"), F.explode(left).alias("side"))
    ends = ends.unionByName(ax.where("object_kind = 'bnode'").select("ax_id", F.col("object").alias("text"), F.explode(right).alias("side")))
    ends = ends.unionByName(ax.select("ax_id", F.explode("operands").alias("text"), F.lit("sub").alias("side")).where("endswith(text, ')')"))
    parts = ont.parts.where("role = 'part'").join(ont.labels.select(F.col("node").alias("part"), "text"), "part", "left").select("expr", F.coalesce("text", "part").alias("inner"), "part_kind").distinct()
    held = ont.expressions.where("label IS NOT NULL").select("expr", "op", "n", F.col("label").alias("text")).join(parts, "expr", "left")
    shape = settle(held.groupBy("text", "op", "n").agg(F.countDistinct("inner").alias("size"), (F.count(F.when(F.col("part_kind") == "bnode", 1)) == 0).alias("plain"), (F.max("inner") == V.THING).alias("thing"), F.collect_set(F.when(F.col("part_kind") == "bnode", F.col("inner"))).alias("inner")), "shape")
    front, seen = settle(ends.distinct().join(shape, "text"), "sided"), None
    while not front.isEmpty():  # a round for each level of nesting
        seen = front if seen is None else seen.unionByName(front)
        turned = F.when(F.col("op") == "not", F.when(F.col("side") == "sub", "super").otherwise("sub")).otherwise(F.col("side"))
        front = settle(front.select("ax_id", turned.alias("side"), F.explode("inner").alias("text")).distinct().join(shape, "text"), "sided")
    return (front if seen is None else seen).select("ax_id", "side", "op", "n", "size", "plain", "thing").distinct()


def profile_violations(ont: Ontology, profile: str) -> DataFrame:
    """ax_type, subject, object of axioms outside the profile EL, QL or RL: by their type, or by a constructor at any depth that the profile doesn't allow on its side of a subclass
    axiom. EL: enumerations of one individual only. QL: on the left restrictions by Thing only, on the right by named classes. RL: on the right at most 0 or 1."""
    if "_sided" not in ont.__dict__:
        ont.__dict__["_sided"] = settle(sided(ont), "sided")
    allowed = (F.col("side") == "sub") & F.col("op").isin(_ALLOWED[profile]["sub"]) | (F.col("side") == "super") & F.col("op").isin(_ALLOWED[profile]["super"])
    if profile == "EL":
        allowed = allowed & ~((F.col("op") == "one") & (F.col("size") > 1))
    elif profile == "QL":
        allowed = allowed & ~((F.col("op") == "some") & F.when(F.col("side") == "sub", ~F.col("thing")).otherwise(~F.col("plain")))
    else:
        allowed = allowed & ~((F.col("op") == "max") & (F.col("n").cast("bigint") > 1))
    inside = ont.__dict__["_sided"].where(~allowed).select("ax_id").distinct()
    wrong = ont.axioms.where(F.col("ax_type").isin(_OUTSIDE[profile])).select("ax_id").unionByName(inside).distinct()
    return ont.axioms.join(wrong, "ax_id", "left_semi").select("ax_type", "subject", "object").distinct()


def instances(ont: Ontology, direct: bool = False, reasoner: str = "el") -> DataFrame:
    """individual, cls: types of individuals, asserted and (unless direct) by the class hierarchy, as classified or ("structural") told."""
    own = ont.with_p(V.TYPE).join(ont.declared.where("kind = 'individual'").select(F.col("iri").alias("s")), "s", "left_semi").where(~F.col("o").startswith(V.OWL)).select(F.col("s").alias("individual"), F.col("o").alias("cls"))
    if direct:
        return own.distinct()
    pairs = classify(ont) if reasoner == "el" else graph.closure(told(ont)).where("child <> parent")
    above = pairs.select(F.col("child").alias("cls"), F.col("parent").alias("over"))
    return own.unionByName(own.join(above, "cls").select("individual", F.col("over").alias("cls"))).distinct()


def explanations(ont: Ontology, child: str, parent: str, most: int = 1) -> DataFrame:
    """rank, step, subject, object: up to `most` shortest chains of stated links from child to parent, each a
    justification of the subsumption in the hierarchy; found by walking outwards from child, paths as arrays."""
    steps = settle(told(ont), "told")
    paths = steps.where(F.col("child") == child).select(F.array("child", "parent").alias("path"))
    found = None
    while not paths.isEmpty():
        hit = paths.where(F.element_at("path", -1) == parent)
        found = hit if found is None else found.unionByName(hit)
        if found.limit(most).count() >= most:
            break
        rest = paths.where(F.element_at("path", -1) != parent)
        paths = settle(rest.withColumn("child", F.element_at("path", -1)).join(steps, "child").where(~F.array_contains("path", F.col("parent"))).select(F.concat("path", F.array("parent")).alias("path")), "paths")
    ranked = (found if found is not None else paths).orderBy(F.size("path"), "path").limit(most).select(F.row_number().over(_by_length()).alias("rank"), "path")
    return ranked.select("rank", F.posexplode("path").alias("step", "subject"), F.col("path").alias("p_")).withColumn("object", F.try_element_at("p_", F.col("step") + 2)).where("object IS NOT NULL").select("rank", "step", "subject", "object")


def _by_length():
    from pyspark.sql.window import Window

    return Window.orderBy(F.size("path"), "path")


def axiom_impact(chains: DataFrame) -> DataFrame:
    """subject, object, uses: in how many explanations a link occurs."""
    return chains.groupBy("subject", "object").agg(F.countDistinct("rank").alias("uses"))
