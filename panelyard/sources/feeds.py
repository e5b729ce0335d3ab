"""Landed pages of paper services as tables: Atom feeds, citation pages and nested works, without a network.

A page is one text, as a collector stored it. Nothing here asks a service; what a page holds becomes flat rows of one shape:
title, abstract, authors, published, updated, url, doi, arxiv_id, s2_id, openalex_id, venue, sources, found_via, key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import text
from panelyard.operators.papers import ARXIV_DOI

FEED = "entry array<struct<id: string, title: string, summary: string, published: string, updated: string, author: array<struct<name: string>>, doi: string>>"
#: One record of a citation service, and a page of them under either name.
CITED = "struct<paperId: string, title: string, abstract: string, url: string, venue: string, year: int, publicationDate: string, authors: array<struct<name: string>>, externalIds: struct<DOI: string, ArXiv: string>>"
GRAPH_PAGE = f"next int, data array<struct<citingPaper: {CITED}, citedPaper: {CITED}>>"
WORKS_PAGE = "results array<struct<id: string, doi: string, display_name: string, publication_date: string, referenced_works: array<string>>>"


def _clean(c: Column) -> Column:
    """White space as one space, trimmed; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def _papers(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` as flat paper records: cleaned texts, normalised ids, an arXiv id from a preprint's own DOI, and the key."""
    empty = F.lit(None).cast("string")
    get = lambda name: columns.get(name, empty)
    names = F.coalesce(columns.get("authors"), F.array().cast("array<string>"))
    one = rows.select(
        _clean(get("title")).alias("title"), _clean(get("abstract")).alias("abstract"), F.transform(names, lambda n: F.coalesce(n, F.lit(""))).alias("authors"),
        F.coalesce(get("published"), F.lit("")).alias("published"), F.coalesce(get("updated"), F.lit("")).alias("updated"), F.coalesce(get("url"), F.lit("")).alias("url"),
        text.normalize_doi(get("doi")).alias("doi"), text.normalize_arxiv(get("arxiv_id")).alias("_a"), get("s2_id").alias("s2_id"), get("openalex_id").alias("openalex_id"),
        F.coalesce(get("venue"), F.lit("")).alias("venue"), F.array(get("source")).alias("sources"), F.array(get("found_via")).alias("found_via"),
    )
    own = text.normalize_arxiv(F.when(F.col("doi").startswith(ARXIV_DOI), F.substring_index("doi", "arxiv.", -1)))
    two = one.withColumn("arxiv_id", F.coalesce("_a", own)).drop("_a").withColumn("title_norm", text.normalize_title(F.col("title")))
    return two.withColumn("key", text.paper_key(F.col("arxiv_id"), F.col("doi"), F.col("title_norm")))


def atom_entries(pages: DataFrame, *, value: str = "value", found_via: Column | None = None, since: str | None = None) -> DataFrame:
    """Paper records of Atom feeds, one text a page: an entry each, in any number of pages.

    Prefixes of element names are dropped, repeated authors become a list, and dates keep their day. A page that isn't XML,
    is null, or has no entries gives no rows; an entry without a title is none. With ``since``, entries published or
    updated on or after that day.
    """
    via = F.lit("arxiv") if found_via is None else found_via
    entries = pages.select(via.alias("_via"), F.from_xml(F.col(value), FEED, {"ignoreNamespace": "true"}).alias("f")).select("_via", F.explode("f.entry").alias("e"))
    day = lambda c: F.substring(F.col(c), 1, 10)
    out = _papers(
        entries.where(F.coalesce(F.trim("e.title"), F.lit("")) != ""), title=F.col("e.title"), abstract=F.col("e.summary"), authors=F.transform("e.author", lambda a: a["name"]), published=day("e.published"), updated=day("e.updated"),
        url=F.trim("e.id"), arxiv_id=F.trim("e.id"), doi=F.col("e.doi"), venue=F.lit("arXiv"), source=F.lit("arxiv"), found_via=F.col("_via"),
    )
    return out if since is None else out.where(F.greatest("published", "updated") >= since)


def graph_items(pages: DataFrame, *, value: str = "value") -> DataFrame:
    """(pid, label, edge, offset, at, complete, c): the records of landed citation pages (pid, label, edge, offset, value).

    edge is "citations" or "references". A list is complete if it has its first page, every page that another names as its
    next one, and none that can't be read: pages are counted, so none is waited for.
    """
    read = pages.select("pid", "label", "edge", "offset", F.from_json(F.col(value), GRAPH_PAGE, {"mode": "PERMISSIVE"}).alias("p")).dropDuplicates(["pid", "edge", "offset"])
    good = F.col("p.data").isNotNull()
    follow = F.when(good & F.col("p.next").isNotNull(), F.col("p.next"))
    lists = read.groupBy("pid", "edge").agg(
        F.min("offset").alias("_first"), F.array_sort(F.collect_set("offset")).alias("_there"), F.array_sort(F.collect_set(follow)).alias("_next"), F.min(good.cast("int")).alias("_good"), F.count_if(good & F.col("p.next").isNull()).alias("_ends")
    )
    whole = (F.col("_first") == 0) & (F.col("_good") == 1) & (F.col("_ends") == 1) & (F.size(F.array_except("_next", "_there")) == 0)
    item = F.transform("p.data", lambda d: F.when(F.col("edge") == "citations", d["citingPaper"]).otherwise(d["citedPaper"]))
    listed = read.join(lists.select("pid", "edge", whole.alias("complete")), ["pid", "edge"])
    return listed.select("pid", "label", "edge", "offset", "complete", F.posexplode(item).alias("at", "c")).where("c is not null and coalesce(c.title, '') <> ''")


def _graph_papers(items: DataFrame, via: Column) -> DataFrame:
    published = F.coalesce(F.nullif(F.col("c.publicationDate"), F.lit("")), F.concat(F.nullif(F.col("c.year"), F.lit(0)).cast("string"), F.lit("-01-01")))
    return _papers(
        items, title=F.col("c.title"), abstract=F.col("c.abstract"), authors=F.transform("c.authors", lambda a: a["name"]), published=published, url=F.col("c.url"), doi=F.col("c.externalIds.DOI"),
        arxiv_id=F.col("c.externalIds.ArXiv"), s2_id=F.col("c.paperId"), venue=F.col("c.venue"), source=F.lit("s2"), found_via=via,
    )


def citing_papers(pages: DataFrame, *, since: str, value: str = "value") -> DataFrame:
    """Records that cite an anchor, published on or after ``since``; one with a year alone counts by its year, one without date stays.

    Pages that arrived count, whether their list is complete or not.
    """
    items = graph_items(pages, value=value).where("edge = 'citations'")
    out = _graph_papers(items, F.concat(F.lit("cites:"), F.substring("label", 1, 60)))
    late = (F.substring("published", 1, 4) >= since[:4]) & ((F.length("published") != 10) | (F.col("published") >= since))
    return out.where((F.col("published") == "") | late)


def cited_papers(pages: DataFrame, *, value: str = "value") -> DataFrame:
    """Records that an anchor cites, of complete lists alone: a part would be taken for the whole and never asked for again."""
    items = graph_items(pages, value=value).where("edge = 'references' and complete")
    return _graph_papers(items, F.concat(F.lit("cited-by:"), F.substring("label", 1, 60)))


def citation_edges(pages: DataFrame, *, value: str = "value") -> DataFrame:
    """(citing, cited, complete): service ids of both ends of every edge that a page holds, each once."""
    items = graph_items(pages, value=value)
    other = F.col("c.paperId")
    out = F.col("edge") == "citations"
    ends = items.select(F.when(out, other).otherwise(F.col("pid")).alias("citing"), F.when(out, F.col("pid")).otherwise(other).alias("cited"), "complete").where("citing is not null and cited is not null")
    return ends.groupBy("citing", "cited").agg(F.max("complete").alias("complete"))


def work_references(pages: DataFrame, wanted: DataFrame, *, cap: int = 200, value: str = "value") -> DataFrame:
    """(title, work, at, cited): what each wanted (title, doi) cites, from landed pages of works.

    A paper can have several records: every one with its DOI, or exactly its normalised title, may be it, and the one that
    cites the most counts, the smallest id on ties. Up to ``cap`` references, in their order.
    """
    works = pages.select(F.explode(F.from_json(F.col(value), WORKS_PAGE)["results"]).alias("w")).select(
        F.substring_index("w.id", "/", -1).alias("work"), text.normalize_doi(F.col("w.doi")).alias("_doi"), text.normalize_title(F.col("w.display_name")).alias("_title"), F.coalesce("w.referenced_works", F.array().cast("array<string>")).alias("refs")
    )
    asked = wanted.select("title", text.normalize_title(F.col("title")).alias("_t"), text.normalize_doi(F.col("doi")).alias("_d")).distinct()
    by_doi = asked.join(works, F.col("_d") == F.col("_doi"))
    by_title = asked.join(works, (F.col("_t") == F.col("_title")) & (F.col("_t") != ""))
    best = by_doi.unionByName(by_title).groupBy("title").agg(F.min_by(F.struct("work", "refs"), F.struct((-F.size("refs")).alias("n"), "work")).alias("b"))
    return best.select("title", "b.work", F.posexplode(F.slice("b.refs", 1, cap)).alias("at", "cited")).withColumn("cited", F.substring_index("cited", "/", -1))


def newest(papers: DataFrame) -> DataFrame:
    """One record a key, the one updated last; a paper turns up on several pages of a feed."""
    order = Window.partitionBy("key").orderBy(F.col("updated").desc(), F.col("published").desc(), "url")
    return papers.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
