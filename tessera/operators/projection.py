"""Projection of JSON values to typed nodes, edges, properties, extensions and findings.

A value comes with what its neighbours and its document's context say of it (``functions/places.py``), the number of the
registered term of its member among that, so no value is joined with another one. Tables of nodes
and edges are then sums and windows by document. Each table is worked out when it is asked for; the members of nodes,
which most tables are made from, and tables that others read again are written once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import names
from tessera.sources.shared import materialize

_GRAPH = ["@graph", "@included"]
_SPOT = ["tok_start", "tok_end"]


def _look_up(rows: DataFrame, term: str) -> DataFrame:
    """``rows`` with the columns of the registered term of this number (null for none)."""
    numbered = [(i, *row) for i, row in enumerate(names.term_rows())]
    terms = F.broadcast(rows.sparkSession.createDataFrame(numbered, "t_number int, " + names.TERM_SCHEMA))  # 155 rows
    return rows.join(terms, F.col(term) == F.col("t_number"), "left").drop("t_number")


def _full(spelling: Column, vocabularies: list[str]) -> Column:
    """Namespace of a spelling that begins with a registered one, else null."""
    found = F.lit(None).cast("string")
    for vocabulary, iri in reversed(names.VOCABULARIES):
        if vocabulary in vocabularies:
            found = F.when(spelling.startswith(iri), F.lit(iri)).otherwise(found)
    return found


def _prefix(spelling: Column) -> Column:
    return F.when(F.instr(spelling, ":") > 0, F.substring_index(spelling, ":", 1))


def _local(spelling: Column) -> Column:
    return F.when(F.instr(spelling, ":") > 0, F.substring(spelling, F.instr(spelling, ":") + 1, F.length(spelling)))


def namespaces(values: DataFrame) -> DataFrame:
    """The binding of each prefix that holds in a document (the last one written), with its class."""
    bound = values.where((F.col("binding")) & (F.col("kind") == "string") & ~F.col("name").startswith("@"))
    last = bound.groupBy("doc_id", F.col("name").alias("prefix")).agg(F.max(F.struct("value_id", F.col("text").alias("iri"), "tok_start", "tok_end")).alias("b"))
    known = F.lit("Unregistered")
    for name, iri in [*names.VOCABULARIES, *[(c, i) for c, i, _ in names.UNIT_NAMESPACES]]:
        known = F.when(F.col("b.iri") == iri, name).otherwise(known)
    return last.select("doc_id", "prefix", "b.iri", known.alias("class"), "b.tok_start", "b.tok_end")


def _fold(types: Column) -> Column:
    """The class of a node: a fold of its registered types in authored order, as ``now`` and ``conflict``.

    Types of a family merge to the more specific; what can't merge leaves the first and is a conflict.
    """
    kept = F.transform(F.filter(types, lambda x: x["as"].isNotNull()), lambda x: x["as"])
    start = F.struct(F.lit(None).cast("struct<class:string,detail:string,input:boolean,family:int,rank:int>").alias("now"), F.lit(False).alias("conflict"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["now"].eqNullSafe(x)
        merges = (acc["now"]["family"] == x["family"]) & (acc["now"]["rank"] != x["rank"])
        better = F.when(acc["now"].isNull() | merges & (x["rank"] > acc["now"]["rank"]), x).otherwise(acc["now"])
        return F.struct(better.alias("now"), (acc["conflict"] | acc["now"].isNotNull() & ~same & ~merges).alias("conflict"))

    return F.aggregate(kept, start, step)


def _data_type(spelling: Column, bound: Column) -> Column:
    """The type an id stands for; ``bound`` is what its prefix is bound to."""
    full = _full(spelling, names.GENERATIONS)
    generations = [iri for v, iri in names.VOCABULARIES if v in names.GENERATIONS]
    local = F.when(full.isNotNull(), F.substring(spelling, F.length(full) + 1, F.length(spelling))).when(bound.isin(generations), _local(spelling))
    found = F.lit(None).cast("string")
    for name, kind in names.DATA_TYPES.items():
        found = F.when(local == name, kind).otherwise(found)
    return found


def _unit_class(spelling: Column, bound: Column) -> Column:
    """The class of what a unit's id stands for."""
    generations = [iri for v, iri in names.VOCABULARIES if v in names.GENERATIONS]
    found = F.when(_full(spelling, names.GENERATIONS).isNotNull(), "S231Fallback")
    by_prefix = F.when(bound.isin(generations), "S231Fallback")
    for _, iri, target in names.UNIT_NAMESPACES:
        found = F.when(spelling.startswith(iri), target).otherwise(found)
        by_prefix = F.when(bound == iri, target).otherwise(by_prefix)
    return F.coalesce(found, F.when(_local(spelling) != "", by_prefix), F.lit("Other"))


def _members(values: DataFrame) -> DataFrame:
    """Nodes (``meaning`` is ``node``), and every value below one or below an anonymous root, with what the member it lies in means."""
    own = values.where("owner IS NOT NULL AND (node IS NOT NULL OR owner = 0)").drop("parent_id", "ordinal", "depth", "name_start", "name_end", "binding", "post")
    own = _look_up(own, "slot_term").drop("slot_term")
    name, payload = F.col("slot_name"), F.col("t_payload")
    meaning = F.when(F.col("level") == 0, "node").when(name == "@id", "id").when(name == "@type", "type").when(name.isin(_GRAPH), "graph")
    meaning = meaning.when(name.startswith("@"), "keyword").when(F.col("t_role").isNull(), "unknown").when(F.col("t_role") == "link", "link")
    own = own.withColumn("meaning", meaning.when(payload == "Unit", "unit").otherwise("literal"))

    # references: a target object, something else where one should be, and what a target object has besides its id
    kind, level, refers = F.col("kind"), F.col("level"), F.col("meaning").isin("link", "unit")
    here = refers & ((level == 1) & (F.col("slot_kind") != "array") | (level == 2) & (F.col("slot_kind") == "array") & (F.col("objects") == 0))
    is_ref = here & (kind == "object") & F.col("kid_id").isNotNull()
    in_ref = refers & (F.col("parent_kind") == "object") & (F.col("objects") == 1) & F.col("up_kid_id").isNotNull()
    in_ref &= (level == 2) & (F.col("slot_kind") == "object") | (level == 3) & (F.col("slot_kind") == "array")

    # literals that read as their term's payload
    unsigned = F.when((kind == "number") & F.col("text").rlike("^[0-9]+$"), F.col("text").try_cast("decimal(38,0)"))
    unsigned = F.when(unsigned <= F.lit("18446744073709551615").cast("decimal(38,0)"), unsigned.cast("decimal(20,0)"))
    literal = (F.col("meaning") == "literal") & (level == 1) & F.col("node").isNotNull()
    reads = (payload == "Text") & (kind == "string") | (payload == "Boolean") & (kind == "boolean") | (payload == "Unsigned") & unsigned.isNotNull() | (payload == "Value")
    false = lambda c: F.coalesce(c, F.lit(False))
    return own.withColumns({
        "is_ref": false(is_ref), "is_broken": false(here & ~is_ref), "is_rest": false(in_ref & (F.col("name") != "@id")),
        "is_literal": literal, "reads": literal & false(reads), "unsigned": F.when(literal & (payload == "Unsigned"), unsigned),
    })


class Projection:
    """The tables of a projection of JSON values; all but ``metrics`` have ``doc_id``, places in bytes, and an ordinal.

    It never fails; what it can't read it keeps and reports.
    """

    def __init__(self, values: DataFrame):
        self.values = values

    @cached_property
    def namespaces(self) -> DataFrame:
        return namespaces(self.values)

    @cached_property
    def _m(self) -> DataFrame:
        return materialize(_members(self.values), "members")

    @property
    def _ids(self) -> DataFrame:
        return self._m.where("meaning = 'id' AND level = 1 AND kind = 'string' AND node IS NOT NULL").select("doc_id", "node", F.col("text").alias("id"))

    @property
    def _links(self) -> DataFrame:
        data_type = F.when(F.col("t_local") == "isOfDataType", _data_type(F.col("kid_id"), F.col("kid_ns")))
        return self._m.where("is_ref AND meaning = 'link' AND node IS NOT NULL").withColumn("data_type", data_type)

    @cached_property
    def _edges(self) -> DataFrame:
        order = Window.partitionBy("doc_id").orderBy("node", "value_id")
        edges = self._links.select(
            "doc_id", (F.row_number().over(order) - 1).alias("edge"), F.col("node").alias("subject"), F.col("t_edge").alias("kind"), F.col("t_ns").alias("pred_ns"), F.col("t_local").alias("pred_local"),
            F.col("kid_id").alias("target_spelling"), "data_type", *_SPOT, "slot",
        )
        first = self._ids.groupBy("doc_id", F.col("id").alias("target_spelling")).agg(F.min("node").alias("target"))
        return materialize(edges.join(first, ["doc_id", "target_spelling"], "left"), "edges")

    @property
    def edges(self) -> DataFrame:
        return self._edges.drop("slot")

    @cached_property
    def _nodes(self) -> DataFrame:
        """One aggregation over what makes a node: its own value, its id, its types in order and its first data type."""
        m, meaning, kind = self._m, F.col("meaning"), F.col("kind")
        is_id = (meaning == "id") & (F.col("level") == 1) & (kind == "string")
        direct = (F.col("objects") == 0) & (kind == "string")
        saved = (F.col("objects") == 1) & (F.col("parent_kind") == "object") & (F.col("name") == "@id") & (kind == "string")
        is_type, is_own = (meaning == "type") & (direct | saved), meaning == "node"
        is_data_type = F.col("is_ref") & (meaning == "link") & (F.col("t_edge") == "DataType")
        columns = ["doc_id", "node", "owner", "value_id", "meaning", "level", "kind", "objects", "parent_kind", "name", "text", "text_term", "is_ref", "t_edge", "t_local", "kid_id", "kid_ns", *_SPOT]
        parts = m.where(F.col("node").isNotNull() & (is_own | is_id | is_type | is_data_type)).select(*columns)
        parts = parts.withColumns({"data_type": F.when(is_data_type, _data_type(F.col("kid_id"), F.col("kid_ns"))), "term": F.when(is_type, F.col("text_term")), "marks": F.struct(is_own.alias("own"), is_id.alias("id"), is_type.alias("type"), is_data_type.alias("typed"))})
        parts = _look_up(parts.drop("t_edge", "t_local"), "term")
        one = F.struct(*[F.col(f"t_{c}").alias(c) for c in ("class", "detail", "input", "family", "rank")])
        listed = F.collect_list(F.when(F.col("marks.type"), F.struct("value_id", "text", F.when(F.col("t_role") == "class", one).alias("as"))))
        own = F.min(F.when(F.col("marks.own"), F.struct("owner", *_SPOT)))
        typed = F.min(F.when(F.col("marks.typed"), F.struct("value_id", "kid_id", "data_type")))
        nodes = parts.groupBy("doc_id", "node").agg(own.alias("own"), F.max(F.when(F.col("marks.id"), F.col("text"))).alias("id"), F.sort_array(listed).alias("all"), typed.alias("d"))
        nodes = nodes.withColumn("fold", _fold(F.col("all"))).withColumn("type_spellings", F.transform("all", lambda x: x["text"]))
        again = F.col("id").isNotNull() & (F.min("node").over(Window.partitionBy("doc_id", "id")) < F.col("node"))

        whole, after = F.col("id"), F.substring_index("id", "#", -1)
        is_instance = whole.rlike(r"^[^:/\\ \t#]+#[^:/\\ \t#]+$") & ~F.array_contains(F.split(after, r"\."), "")
        form = F.when(whole.isNull(), "Missing").when(is_instance, "SpecInstance").otherwise("Other")
        now = F.col("fold.now")
        cls = F.coalesce(now["class"], F.when(F.size("type_spellings") == 0, "WeakUntyped").otherwise("LibraryInstance"))
        return materialize(nodes.select(
            "doc_id", "node", F.col("own.owner").alias("value_id"), "id", form.alias("id_form"), F.when(is_instance, F.substring_index("id", "#", 1)).alias("id_container"), F.when(is_instance, F.split(after, r"\.")).alias("id_steps"),
            cls.alias("class"), F.when(now["class"] == "Block", now["detail"]).alias("block_kind"), now["input"].alias("is_input"), F.when(now["class"] == "Connector", now["detail"]).alias("conn_type"),
            "type_spellings", F.col("fold.conflict").alias("has_conflict"), again.alias("is_again"), F.col("d.kid_id").alias("data_type_spelling"), F.col("d.data_type").alias("data_type"),
            (F.col("own.owner") == 0).alias("is_root"), "own.tok_start", "own.tok_end",
        ), "nodes")

    @property
    def nodes(self) -> DataFrame:
        return self._nodes.drop("has_conflict", "is_again")

    @cached_property
    def _properties(self) -> DataFrame:
        """Literals that read as their term's payload, then units; not numbered yet."""
        m, kind, payload, null = self._m, F.col("kind"), F.col("t_payload"), lambda t: F.lit(None).cast(t)
        is_plain = kind.isin("string", "number", "boolean")
        value_kind = F.when(is_plain, "Literal").when(kind == "null", "Null").when(kind == "array", "Array").when(F.col("kid_has_value"), "TypedObject").otherwise("OtherObject")
        held = F.when(payload == "Value", value_kind)
        term = ["doc_id", "node", "value_id", F.col("t_ns").alias("term_ns"), F.col("t_local").alias("term_local"), payload.alias("payload_kind")]
        read = m.where("reads").select(
            *term, F.when(payload == "Text", F.col("text")).alias("text"), F.when(payload == "Boolean", F.col("flag")).alias("flag"), "unsigned", held.alias("value_kind"),
            F.when((held == "Literal") & (kind == "string"), F.col("text")).when(held == "TypedObject", F.col("kid_value")).alias("value_text"), F.when(held == "TypedObject", F.col("kid_type")).alias("value_type"),
            null("string").alias("unit_role"), null("string").alias("unit_target_class"), *_SPOT, "slot",
        )
        role = null("string")
        for local, name in names.UNIT_ROLES.items():
            role = F.when(F.col("t_local") == local, name).otherwise(role)
        units = m.where("is_ref AND meaning = 'unit' AND node IS NOT NULL").select(
            *term, F.col("kid_id").alias("text"), null("boolean").alias("flag"), null("decimal(20,0)").alias("unsigned"), null("string").alias("value_kind"), null("string").alias("value_text"), null("string").alias("value_type"),
            role.alias("unit_role"), _unit_class(F.col("kid_id"), F.col("kid_ns")).alias("unit_target_class"), *_SPOT, "slot",
        )
        return read.unionByName(units)

    @cached_property
    def properties(self) -> DataFrame:
        in_node = Window.partitionBy("doc_id", "node").orderBy("value_id")
        return self._properties.withColumn("seq", F.row_number().over(in_node) - 1).drop("slot", "value_id")

    @cached_property
    def _extensions(self) -> DataFrame:
        """Whatever nothing above has read; an anonymous root keeps its members as they are, but for well-formed structure."""
        m, kind, meaning, top = self._m, F.col("kind"), F.col("meaning"), F.col("level") == 1
        in_object = (F.col("objects") == 1) & (F.col("parent_kind") == "object")
        in_type = (meaning == "type") & ((F.col("objects") == 0) & ~kind.isin("string", "array", "object") | in_object & ~((F.col("name") == "@id") & (kind == "string")))
        context = (F.col("owner") == 0) & (F.col("slot_name") == "@context")
        kept = top & (meaning == "id") & (kind != "string") | in_type | F.col("malformed") | top & (meaning == "keyword") & ~context | top & (meaning == "unknown")
        kept |= F.col("is_broken") | F.col("is_rest") | F.col("is_literal") & ~F.col("reads")
        predicate = F.when(F.col("is_rest") | in_type & (F.col("objects") == 1), F.col("name")).otherwise(F.col("slot_name"))
        shaped = (kind == "object") | (kind == "array") & ~F.col("kid_other")
        loose = top & ~(F.col("name").isin("@context", *_GRAPH) & shaped)
        found = m.where(F.when(F.col("node").isNull(), loose).otherwise((F.col("level") > 0) & F.coalesce(kept, F.lit(False))))
        return found.select("doc_id", "node", "value_id", F.when(F.col("node").isNull(), F.col("name")).otherwise(predicate).alias("predicate"), "kind", *_SPOT)

    @cached_property
    def extensions(self) -> DataFrame:
        in_node = Window.partitionBy("doc_id", "node").orderBy("value_id")
        return self._extensions.withColumn("seq", F.row_number().over(in_node) - 1).drop("value_id")

    @cached_property
    def _findings(self) -> DataFrame:
        """Findings with what orders them; the unresolved references last."""
        m, none, kind = self._m, F.lit(None).cast("string"), F.col("kind")

        def finding(rows: DataFrame, code: str, phase: int, rank: int, node: Column, at: Column, context: Column) -> DataFrame:
            return rows.select("doc_id", F.lit(code).alias("code"), F.lit(phase).alias("phase"), F.lit(rank).alias("rank"), node.alias("node"), at.alias("at"), context.alias("context"), *_SPOT)

        at, node = F.col("value_id"), F.col("node")
        lost = F.when(kind == "string", F.col("text")).when(F.col("kid_has_value"), F.col("kid_value"))
        found = finding(self.values.where("value_id = 0 AND kind <> 'object'"), "CXF-P-000", 0, 0, F.lit(None).cast("int"), at, none)
        for part in (
            finding(m.where(F.col("is_literal") & (F.col("t_payload") == "Value") & (lost == names.LOST_VALUE)), "CXF-P-003", 0, 0, node, at, none),
            finding(m.where("is_broken AND node IS NOT NULL"), "CXF-P-004", 0, 0, node, at, F.col("slot_name")),
            finding(self._nodes.where("has_conflict"), "CXF-P-002", 0, 1, node, F.lit(0), none),
            finding(self._nodes.where("class = 'WeakUntyped'"), "CXF-P-001", 0, 2, node, F.lit(0), none),
            finding(self._nodes.where("is_again"), "CXF-P-006", 0, 3, node, F.lit(0), none),
            finding(self._edges.where("target IS NULL AND kind <> 'DataType'"), "CXF-P-005", 1, 0, F.col("subject"), F.col("edge"), F.col("target_spelling")),
        ):
            found = found.unionByName(part)
        return found

    @cached_property
    def findings(self) -> DataFrame:
        """In order: each node's members, then its types, emptiness and id; unresolved references last."""
        by_doc = Window.partitionBy("doc_id").orderBy("phase", F.when(F.col("phase") == 0, F.col("node")), "rank", "at")
        return self._findings.withColumn("seq", F.row_number().over(by_doc) - 1).select("doc_id", "seq", "code", "node", "context", *_SPOT)

    @cached_property
    def metrics(self) -> DataFrame:
        """Counts of each document's rows, added up in one aggregation over all tables."""
        counted = ["nodes", "edges", "resolved_edges", "recognized_members", "extension_members", "diagnostics"]

        def count(rows: DataFrame, **what: Column) -> DataFrame:
            return rows.groupBy("doc_id").agg(*[(F.sum(what[c].cast("long")) if c in what else F.lit(0).cast("long")).alias(c) for c in counted])

        one = F.lit(1)
        is_unit = F.col("unit_role").isNotNull()
        slots = self._properties.where(is_unit).select("doc_id", "slot").unionByName(self._edges.select("doc_id", "slot")).distinct()  # each member once
        total = count(self.values.where("value_id = 0").select("doc_id"))
        for part in (
            count(self._m.where("meaning = 'node' AND node IS NOT NULL"), nodes=one), count(self._edges, edges=one, resolved_edges=F.col("target").isNotNull().cast("int")),
            count(self._properties.where(~is_unit), recognized_members=one), count(slots, recognized_members=one), count(self._extensions, extension_members=one), count(self._findings, diagnostics=one),
        ):
            total = total.unionByName(part)
        return total.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in counted])


def project(values: DataFrame) -> Projection:
    """The projection of all documents of a table of JSON values."""
    return Projection(values)


def adjacency(projection: Projection) -> DataFrame:
    """Edge numbers that leave and enter each node, in order."""
    numbers = lambda rows, by, name: rows.groupBy("doc_id", F.col(by).alias("node")).agg(F.sort_array(F.collect_list("edge")).alias(name))
    out, into = numbers(projection.edges, "subject", "outbound"), numbers(projection.edges.where("target IS NOT NULL"), "target", "inbound")
    empty = F.array().cast("array<int>")
    both = projection.nodes.select("doc_id", "node").join(out, ["doc_id", "node"], "left").join(into, ["doc_id", "node"], "left")
    return both.select("doc_id", "node", F.coalesce("outbound", empty).alias("outbound"), F.coalesce("inbound", empty).alias("inbound"))


def first_property(projection: Projection, term: str, payload: str) -> DataFrame:
    """The first property of each node with a term and payload kind, as all its columns."""
    own = projection.properties.where((F.col("term_local") == term) & (F.col("payload_kind") == payload))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("seq"))).where("place = 1").drop("place")
