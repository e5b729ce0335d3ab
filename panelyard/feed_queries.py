"""Queries on landed pages: orders written as feed pages and citation pages, and read back by the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.session import table
from panelyard.sources import feeds

SINCE = "1996-01-01"


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): an Atom page for each customer, an entry for each order; odd orders have no DOI, and titles have signs and line ends."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    key, day = F.col("o_orderkey").cast("string"), F.to_date("o_orderdate")
    doi = F.when(F.col("o_orderkey") % 2 == 0, tag("arxiv:doi", F.concat(F.lit("https://doi.org/10.1/ORD"), key))).otherwise("")
    names = F.concat(tag("author", tag("name", F.col("o_orderpriority"))), tag("author", tag("name", F.col("o_orderstatus"))))
    entry = tag("entry", F.concat(
        tag("id", F.concat(F.lit("http://arxiv.org/abs/"), key, F.lit("v2"))), tag("title", F.concat(F.lit("Order &amp;\n  parcel "), key)), names, doi,
        tag("published", F.concat(day.cast("string"), F.lit("T00:00:00Z"))), tag("updated", F.concat(F.date_add(day, 10).cast("string"), F.lit("T09:00:00Z"))),
    ))
    whole = F.array_join(F.array_sort(F.collect_list(entry)), "")
    head = F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">')
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(head, whole, F.lit("</feed>")).alias("value"))


def citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, label, edge, offset, value): an order cites its parts, two a page; every seventh order lacks its second page."""
    item = F.struct(F.struct(F.concat(F.lit("p"), F.col("l_partkey")).alias("paperId"), F.concat(F.lit("Part "), F.col("l_partkey")).alias("title"), F.year("l_shipdate").alias("year")).alias("citedPaper"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")) - 1
    numbered = table(spark, sf_dir, "lineitem").withColumn("place", place)
    rows = numbered.select("l_orderkey", (F.col("place") - F.col("place") % 2).alias("offset"), F.struct("place", item.alias("item")).alias("i"))
    pages = rows.groupBy("l_orderkey", "offset").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]).alias("data"))
    last = pages.groupBy("l_orderkey").agg(F.max("offset").alias("last"))
    whole = pages.join(last, "l_orderkey").withColumn("next", F.when(F.col("offset") < F.col("last"), F.col("offset") + 2))
    texts = whole.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("pid"), F.concat(F.lit("Order "), F.col("l_orderkey")).alias("label"), F.lit("references").alias("edge"), "offset", F.to_json(F.struct("next", "data")).alias("value"), "l_orderkey")
    return texts.where("not (l_orderkey % 7 = 0 and offset = 2)").drop("l_orderkey")


def register(add: Callable) -> None:
    @add(
        f"""SELECT 'arxiv:' || o_orderkey AS key, 'Order & parcel ' || o_orderkey AS title, CAST(o_orderdate AS DATE)::VARCHAR AS published, (CAST(o_orderdate AS DATE) + 10)::VARCHAR AS updated,
  CASE WHEN o_orderkey % 2 = 0 THEN '10.1/ord' || o_orderkey END AS doi, o_orderpriority || '; ' || o_orderstatus AS authors FROM orders WHERE CAST(o_orderdate AS DATE) + 10 >= DATE '{SINCE}'"""
    )
    def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Entries of all feed pages that were published or updated since a day."""
        out = feeds.atom_entries(feed_pages(spark, sf_dir), since=SINCE)
        return out.select("key", "title", "published", "updated", "doi", F.array_join("authors", "; ").alias("authors"))

    lines = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) "
    complete = "(l_orderkey % 7 <> 0 OR n <= 2)"

    @add(lines + f"SELECT 'o' || l_orderkey AS citing, 'p' || l_partkey AS cited, bool_or({complete}) AS complete FROM l WHERE NOT (l_orderkey % 7 = 0 AND place IN (3, 4)) GROUP BY 1, 2")
    def feed_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All edges that landed pages hold, and whether their list is whole."""
        return feeds.citation_edges(citation_pages(spark, sf_dir))

    @add(lines + f"SELECT 'p' || l_partkey AS s2_id, extract(year FROM l_shipdate) || '-01-01' AS published, 'cited-by:Order ' || l_orderkey AS via FROM l WHERE {complete}")
    def feed_cited_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What orders with whole lists cite."""
        return feeds.cited_papers(citation_pages(spark, sf_dir)).select("s2_id", "published", F.element_at("found_via", 1).alias("via"))
