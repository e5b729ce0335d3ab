"""Zoo and originality: the index against plain comparison of every pair, and verdicts in order."""

from __future__ import annotations

import random

import pytest

from panelyard.functions import grammar, zoo
from panelyard.operators import originality as o
from panelyard.operators.store import Store

SMALL = [("mean", "close / ts_mean(close, 20) - 1"), ("gap", "open / shift(close, 1) - 1"), ("range", "(high - low) / close")]


def made_up(n, seed):
    r = random.Random(seed)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["open", "close", "volume", "high", "low", "2", "returns"])
        kind = r.choice(["rank({})", "ts_mean({}, 5)", "shift({}, 3)", "({} + {})", "({} * {})", "({} / {})", "({} - {})", "ts_corr({}, {}, 9)"])
        return kind.format(*[tree(depth - 1) for _ in range(kind.count("{}"))])

    out = []
    while len(out) < n:
        text = tree(r.randint(1, 4))
        try:
            grammar.parse(text)
            out.append(text)
        except grammar.GrammarError:
            pass
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, expression string")


def test_default_zoo_reads_and_has_both_spellings():
    members = zoo.default_zoo()
    names = [n for n, _ in members]
    assert len(set(names)) == len(names) and "alpha_101" in names
    trees = {n: grammar.parse(f) for n, f in members}
    assert {n for n in names if n.endswith("_returns")} == {f"{n}_returns" for n, f in zoo.FORMULAS.items() if "{r}" in f}
    assert "returns" in trees["alpha_014_returns"].fields and "returns" not in trees["alpha_014"].fields


def test_nearest_equals_comparing_every_pair(spark):
    texts = made_up(80, 4) + [f for _, f in zoo.default_zoo()[:5]]
    members = zoo.default_zoo()
    trees = [(n, grammar.parse(f)) for n, f in members]
    got = o.nearest(o.parsed(frame(spark, texts)), o.zoo_index(spark), "zoo").collect()
    assert len(got) == len(texts)
    for r in got:
        nodes, share, name = grammar.zoo_similarity(grammar.parse(r["expression"]), trees)
        assert (r["zoo_nodes"], r["nearest_zoo"]) == (nodes, name) and r["zoo_share"] == pytest.approx(share), r["expression"]


def plain_judge(texts, members, limits):
    """One after another: what is stored is compared with by those that follow."""
    trees, stored, out = [(n, grammar.parse(f)) for n, f in members], [], []
    for text in texts:
        try:
            e = grammar.parse(text or "")
        except grammar.GrammarError:
            out.append("unparsable")
            continue
        fid = grammar.factor_id(e)
        share = grammar.zoo_similarity(e, trees)[1]
        if e.nodes > limits.nodes or share >= limits.zoo_share:
            out.append("rejected")
        elif any(i != fid and grammar.structural_key(t) == grammar.structural_key(e) for i, t in stored) and fid not in [i for i, _ in stored]:
            out.append("rejected")
        elif fid in [i for i, _ in stored]:
            out.append("duplicate")
        else:
            stored.append((fid, e))
            out.append("stored")
    return out


@pytest.mark.parametrize("limits", [o.Limits(), o.Limits(nodes=6, zoo_share=0.5), o.Limits(zoo_share=1.0)])
def test_verdicts_equal_judging_one_after_another(spark, limits):
    texts = made_up(60, 11)
    texts += ["rank(close) + open", "open + rank(close)", "ts_mean(close, 5)", "ts_mean(close, 9)", "ts_mean(close, 5)", "nonsense(", None, "1 + 2", *[f for _, f in SMALL]] + texts[:10]
    got = o.judge(frame(spark, texts), o.zoo_index(spark, SMALL), limits=limits).orderBy("pos").collect()
    assert [r["status"] for r in got] == plain_judge(texts, SMALL, limits)
    assert all((r["reason"] != "") == (r["status"] in ("rejected", "unparsable")) for r in got)


def test_a_store_remembers_and_names_the_nearest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append("papers", [{"key": "p", "title": "T"}], once="key")
    h = store.add_hypothesis("p", "market", "prices revert")
    first = store.propose(["rank(ts_std(volume, 5)) * open", "open * rank(ts_std(volume, 5))", "close / ts_mean(close, 20) - 1"], h, zoo=SMALL).orderBy("pos").collect()
    assert [r["status"] for r in first] == ["stored", "duplicate", "rejected"] and "100% of it is in mean" in first[2]["reason"]
    again = store.propose(["rank(ts_std(volume, 9)) * open", "rank(ts_std(volume, 5)) * open", "rank(ts_std(volume, 5)) + low"], h, zoo=SMALL).orderBy("pos").collect()
    assert [r["status"] for r in again] == ["rejected", "duplicate", "stored"]
    assert again[0]["reason"].endswith(first[0]["id"]) and again[2]["nearest_store"] == first[0]["id"] and again[2]["store_nodes"] == 3
    assert store.table("proposals").count() == 6 and store.table("factors").count() == 2
    with pytest.raises(ValueError):
        o.Limits(nodes=2)
    strict = o.judge(frame(spark, ["rank(ts_std(volume, 5)) + high"]), o.zoo_index(spark, SMALL), store.formulas(), o.Limits(store_share=0.5)).first()
    assert strict["status"] == "rejected" and strict["store_share"] == pytest.approx(0.6)


def test_empty_batch(spark):
    assert o.judge(frame(spark, []), o.zoo_index(spark, SMALL)).count() == 0
