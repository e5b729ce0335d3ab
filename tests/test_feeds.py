"""Landed pages of paper services, as files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from panelyard.sources import feeds

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>query</title>
<entry><id>http://arxiv.org/abs/2412.20138v3</id><published>2024-12-28T00:00:00Z</published><updated>2025-02-01T00:00:00Z</updated><title>Trading
  agents &amp; markets</title><summary> Two
 lines <![CDATA[and <b>]]> </summary><author><name>A. B</name></author><author><name>C D</name></author><arxiv:doi>10.1/ABC</arxiv:doi><link href="u"/></entry>
<entry><id>http://arxiv.org/abs/2308.00016v1</id><published>2023-07-31T00:00:00Z</published><updated>2023-07-31T00:00:00Z</updated><title>Old one</title></entry>
<entry><id>x</id></entry></feed>"""
ONE = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2412.20138v4</id><published>2024-12-28</published><updated>2025-03-01</updated><title>Trading agents and markets</title></entry></feed>"


def landed(spark, tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.txt").write_text(t)
    return spark.read.text(str(tmp_path), wholetext=True)


def test_atom_entries(spark, tmp_path):
    pages = landed(spark, tmp_path, [ATOM, ONE, "not <xml", "<feed></feed>"])
    got = {r["url"]: r for r in feeds.atom_entries(pages).collect()}
    assert set(got) == {"http://arxiv.org/abs/2412.20138v3", "http://arxiv.org/abs/2308.00016v1", "http://arxiv.org/abs/2412.20138v4"}
    r = got["http://arxiv.org/abs/2412.20138v3"]
    assert (r["title"], r["abstract"], r["authors"], r["published"], r["doi"], r["arxiv_id"], r["key"]) == ("Trading agents & markets", "Two lines and <b>", ["A. B", "C D"], "2024-12-28", "10.1/abc", "2412.20138", "arxiv:2412.20138")
    assert got["http://arxiv.org/abs/2308.00016v1"]["authors"] == []
    assert feeds.atom_entries(pages, since="2025-01-01").count() == 2
    last = {x["key"]: x["url"] for x in feeds.newest(feeds.atom_entries(pages)).collect()}
    assert last["arxiv:2412.20138"].endswith("v4") and len(last) == 2
    assert feeds.atom_entries(spark.createDataFrame([(None,)], "value string")).count() == 0


def record(i, **more):
    return {"paperId": f"s{i}", "title": f"Paper {i}", "authors": [{"name": "N"}], "externalIds": {}} | more


def page(records, following=None, edge="citingPaper"):
    return json.dumps({"next": following, "data": [{edge: r} for r in records]})


def test_citation_pages(spark):
    rows = [
        ("a", "Anchor", "citations", 0, page([record(1, year=2024), record(2, publicationDate="2024-01-02"), record(3, publicationDate="2024-09-01"), record(4), {"paperId": "t"}], 100)),
        ("a", "Anchor", "citations", 100, page([record(5, year=2023, externalIds={"DOI": "10.48550/arXiv.2401.00001"}), record(6, publicationDate="2025-01-01", externalIds={"DOI": "10.48550/arXiv.2401.00002"})])),
        ("b", "Whole", "references", 0, page([record(7), record(8)], 2, "citedPaper")),
        ("b", "Whole", "references", 2, page([record(9, externalIds={"ArXiv": "2401.1"})], None, "citedPaper")),
        ("c", "Part", "references", 0, page([record(10)], 1, "citedPaper")),
        ("d", "Broken", "references", 0, "{not json"), ("e", "Late", "references", 5, page([record(11)], None, "citedPaper")), ("f", "Empty", "references", 0, page([])),
    ]
    pages = spark.createDataFrame(rows + rows[2:3], "pid string, label string, edge string, offset int, value string")
    citing = {r["s2_id"]: r for r in feeds.citing_papers(pages, since="2024-06-01").collect()}
    assert set(citing) == {"s3", "s4", "s6"}, "a year alone becomes its first day"
    assert citing["s6"]["arxiv_id"] == "2401.00002" and citing["s6"]["key"] == "arxiv:2401.00002" and citing["s3"]["found_via"] == ["cites:Anchor"]
    assert sorted(r["s2_id"] for r in feeds.cited_papers(pages).collect()) == ["s7", "s8", "s9"]
    edges = {(r["citing"], r["cited"]): r["complete"] for r in feeds.citation_edges(pages).collect()}
    assert edges[("s1", "a")] and edges[("b", "s9")] and edges[("c", "s10")] is False and edges[("e", "s11")] is False
    assert ("t", "a") not in edges and len(edges) == 11


def test_references_of_the_record_that_cites_most(spark):
    works = [
        {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "display_name": "Other words", "referenced_works": ["https://openalex.org/W8"]},
        {"id": "https://openalex.org/W2", "doi": None, "display_name": "The Title!", "referenced_works": [f"https://openalex.org/W{i}" for i in (5, 9, 7)]},
        {"id": "https://openalex.org/W3", "doi": None, "display_name": "The Title again", "referenced_works": [f"https://openalex.org/W{i}" for i in range(20)]},
        {"id": "https://openalex.org/W4", "doi": None, "display_name": "Lonely", "referenced_works": None},
    ]
    pages = spark.createDataFrame([(json.dumps({"results": works[:2]}),), (json.dumps({"results": works[2:]}),), ("{broken",)], "value string")
    wanted = spark.createDataFrame([("the title", "10.1/x"), ("Lonely", None), ("Nowhere", None)], "title string, doi string")
    got = feeds.work_references(pages, wanted, cap=2).orderBy("title", "at").collect()
    assert [(r["title"], r["work"], r["cited"]) for r in got] == [("the title", "W2", "W5"), ("the title", "W2", "W9")]
    assert feeds.work_references(pages, wanted.where(F.col("title") == "Lonely")).count() == 0
