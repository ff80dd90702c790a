"""Control documents made from the relational tables, one for each customer with orders.

The documents are the engine's input; what is in them follows from the tables alone, so SQL over the tables says what the
engine must find. A customer is a block, an order a connector joined to the customer's next order, a line a parameter,
constant or untyped node. The market segment picks the namespace the document's terms are bound to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespace of the ``S231`` prefix for each market segment; others get the plain one.
NAMESPACES = {
    "AUTOMOBILE": "https://data.ashrae.org/S231P#",
    "BUILDING": "http://data.ashrae.org/S231P#",
    "FURNITURE": "https://example.test/other#",
}
PLAIN = "http://data.ashrae.org/S231#"
#: The segment whose documents also bind a prefix to an unknown namespace of a known family.
ODD, ODD_IRI = "MACHINERY", "http://qudt.org/unknown#"
CONNECTORS = {"O": "RealInput", "F": "RealOutput", "P": "IntegerInput"}
LOST = "{ terms: [Array] }"
BASE = "https://example.test/document"


def _quoted(*parts) -> F.Column:
    return F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))


def _glued(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def line_order() -> list[str]:
    """Columns that order the lines of a customer; equal rows make equal nodes."""
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` (the customer's key), ``content`` and ``document_iri``."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customers = read("customer").select("c_custkey", "c_mktsegment")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = read("lineitem").select(*line_order())
    ns = F.lit(PLAIN)
    for segment, iri in NAMESPACES.items():
        ns = F.when(F.col("c_mktsegment") == segment, iri).otherwise(ns)
    kind = F.lit(None).cast("string")
    for status, term in CONNECTORS.items():
        kind = F.when(F.col("x.o_orderstatus") == status, term).otherwise(kind)

    node = _glued('{"@id":"l:', F.col("l_orderkey").cast("string"), ".", F.col("l_linenumber").cast("string"), '"')
    node = F.concat(
        node,
        F.when(F.col("l_returnflag") == "A", ',"@type":"S231:Parameter"').when(F.col("l_returnflag") == "N", ',"@type":"S231:Constant"').otherwise(""),
        F.when(F.round(F.col("l_discount") * 100).cast("int") == 0, "").when(F.round(F.col("l_discount") * 100).cast("int") == 5, f',"S231:value":"{LOST}"').otherwise(_glued(',"S231:value":', F.col("l_quantity").cast("int").cast("string"))),
        _glued(',"S231:numberDimensions":', F.col("l_linenumber").cast("string"), ',"S231:isFinal":', F.when(F.col("l_linenumber") % 2 == 0, "true").otherwise("false")),
        F.when(F.col("l_linestatus") == "O", ',"qudt:hasUnit":{"@id":"unit:PA"}').otherwise(',"qudt:hasUnit":{"@id":"S231:raw"}'),
        F.lit(',"ex:note":"n"}'),
    )
    owned = lines.withColumn("line", node).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    by_line = F.sort_array(F.collect_list(F.struct(*line_order(), "line")))
    line_docs = owned.groupBy(F.col("o_custkey").alias("line_key")).agg(by_line.alias("lines"))
    order_docs = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    all_docs = customers.join(order_docs, F.col("c_custkey") == F.col("o_custkey")).join(line_docs, F.col("c_custkey") == F.col("line_key"), "left")

    def order_node(x, i):
        following = F.coalesce(F.get(F.col("orders"), i + 1)["o_orderkey"], x["o_orderkey"] + 1)
        term = F.when(x["o_orderstatus"] == "O", CONNECTORS["O"]).when(x["o_orderstatus"] == "F", CONNECTORS["F"]).otherwise(CONNECTORS["P"])
        return _glued('{"@id":"o:', x["o_orderkey"].cast("string"), '","@type":"S231:', term, '","S231:isConnectedTo":{"@id":"o:', following.cast("string"), '"}}')

    link = lambda prefix, key: _glued('{"@id":"', prefix, key, '"}')
    lines_of = F.coalesce("lines", F.array().cast(line_docs.schema["lines"].dataType))
    name = F.when(F.col("c_mktsegment") == "BUILDING", _glued("Customer", F.col("c_custkey").cast("string"), "#main.block")).otherwise(_glued("c:", F.col("c_custkey").cast("string")))
    root = _glued(
        '{"@id":', _quoted(name), ',"@type":"S231:CompositeBlock","S231:hasInstance":[',
        F.array_join(F.transform("orders", lambda x: link("o:", x["o_orderkey"].cast("string"))), ","), '],"S231:hasParameter":[',
        F.array_join(F.transform(lines_of, lambda x: link("l:", _glued(x["l_orderkey"].cast("string"), ".", x["l_linenumber"].cast("string")))), ","), "]}",
    )
    nodes = F.array_join(F.concat(F.array(root), F.transform("orders", order_node), F.transform(lines_of, lambda x: x["line"])), ",")
    odd = F.when(F.col("c_mktsegment") == ODD, f',"alt":"{ODD_IRI}"').otherwise("")
    head = _glued('{"@context":{"S231":', _quoted(ns), ',"ex":"https://example.test/","qudt":"http://qudt.org/schema/qudt#","unit":"http://qudt.org/vocab/unit#"', odd, '},"@graph":[')
    return all_docs.select(F.col("c_custkey").cast("long").alias("doc_id"), F.concat(head, nodes, F.lit("]}")).cast("binary").alias("content"), F.lit(BASE).alias("document_iri"))
