from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import frame, odd, prose, word

from panelyard.llm import quality_model, toxicity
from panelyard.llm.labelled import Logistic

INSULTS = ("idiot", "moron", "clown", "scum")


def disguised(r: random.Random, w: str) -> str:
    return r.choice([w, w.upper(), w.replace("o", "0").replace("i", "1"), " ".join(w), w.replace("i", "iiii").replace("o", "ooo"), ".".join(w)])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        text = prose(r, r.randrange(40, 160))
        good, toxic = int(r.random() < 0.7), int(r.random() < 0.3)
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(r.randrange(len(words)), disguised(r, r.choice(INSULTS)) if r.random() < 0.6 else r.choice(INSULTS))
            text = " ".join(words)
        if not good:
            text = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text.split()) if i % 2 else "\n".join([text.upper().replace(".", "!!")] * 2)
        docs.append((i, text, f"s{i % 3}"))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tabled(spark, corpus):
    docs, labels = corpus
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(tabled, corpus):
    docs, labels = tabled
    truth = {d: q for d, q, _ in corpus[1]}
    got = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and 60 < len(held) < 180
    assert sum((r["predicted"] == 1) == (truth[r["doc_id"]] == 1) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_on_held_out_rows(tabled, corpus):
    docs, labels = tabled
    truth = {d: t for d, _, t in corpus[1]}
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert sum((r["predicted"] == 1) == (truth[r["doc_id"]] == 1) for r in held) >= 0.93 * len(held)
    assert not any(r["predicted"] for r in held if not truth[r["doc_id"]] and r["score"] > 0.95)


def test_disguises_are_undone(corpus):
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    for text in ("1d10t", "i.d.i.o.t", "IIIDIOOOT", "m0r0n", "sc*um", "cl0wn"):
        assert any(w in INSULTS for w in model.words(text)), text
    text = "an i d i o t here"
    assert toxicity.spaced(text, text.split(), set(text.split())) == ["i d i o t"]
    r = random.Random(1)
    assert all(model.words(w) == [w] for w in (word(r) for _ in range(50)))


def test_long_pieces_are_decoded_to_their_end(corpus):
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    for text in ("id" + "i" * 80 + "ot", "cl" + "o" * 5000 + "wn", "-".join(["bada"] * 40 + list("m0r0n"))):
        assert any(insult in "".join(model.words(text)) for insult in INSULTS), text[:80]
    plain = model.restorer.restore
    assert plain("m0r0n" + "." * 70 + "m0r0n").count("moron") == 2


DISGUISES = ["iidiot", "iiddiioott", "mmoron", "i/d/i/o/t", "i,d,i,o,t", "i:d|i~o/t", "i\u200bd\u200bi\u200bo\u200bt", "id i ot", "i di ot", "mor on", "m or on", "sc. um", "id1o7", "idi0+", "1d10t!", "$cum", "i  d  i  o  t", "i\td\ti\to\tt", "i d i o t.", "(i d i o t)", "y o u i d i o t", "y o u  i d i o t", "1 d 1 0 t", "clo wn", "clo wn.", "m.o-r_o*n", "https://example.org/" + "ba/bu/" * 40 + "1d10t"]


def test_disguises_are_scored_like_what_they_hide(corpus):
    """Signs and digits at an end, any white space, runs with signs beside them, and a disguise far inside a text."""
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    r = random.Random(3)
    plain = prose(r, 30)
    low = model.scores([plain])[0]
    assert low < 0.5
    for text in DISGUISES:
        carried = model.measure(plain + " " + text + " bo")
        assert carried[0] >= 1.2, text
        assert model.scores([plain + " " + text + " bo"])[0] > low, text
    far = prose(r, 3000)
    assert len(far) > 5000
    assert model.measure(far + " id1o7 " + far)[2] > model.measure(far + " " + far)[2]
    assert model.measure("") == (0.0, 0.0, 0.0, 0.0)


def test_the_lattice_finds_the_cheapest_of_all_paths(corpus):
    """Every combination of arcs, written out and costed by itself, against the back-pointers."""
    from itertools import product

    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    lattice, edge = model.restorer, toxicity.EDGE

    def cost(letters):
        """Words between other signs, each from edge to edge."""
        total, history = 0.0, edge + edge
        for c in letters + " ":
            if c.isalpha():
                total += lattice.model.cost(history, c)
                history = history[1] + (c if c in lattice.model.one else toxicity.OTHER)
            elif history != edge + edge:
                total, history = total + lattice.model.cost(history, edge), edge + edge
        return total

    r = random.Random(8)
    for word in ["id1ot", "m00ron", "i.d.i-o.t", "t r as h", "cl  own", "$cuum", "aabb", "x1y2", "a|b", *("".join(r.choices("adimoprst01.$ ", k=6)).strip() for _ in range(150))]:
        if not word:
            continue
        narrow = min(map(len, toxicity.SPACE.findall(word)), default=0)
        runs = []
        for run in lattice.RUN.finditer(word):
            keep, drop = toxicity.WIDE if len(run[0]) > narrow else toxicity.NARROW
            runs.append([(" ", keep), ("", drop)] if run[0].isspace() else lattice.arcs(run[1], len(run[0])))
        every = [(sum(c for _, c in path) + cost("".join(o for o, _ in path)), "".join(o for o, _ in path)) for path in product(*runs)]
        best = min(c for c, _ in every)
        assert lattice.restore(word) in {o for c, o in every if c <= best + 1e-9}, word


def test_words_that_may_gain_nothing_skip_the_lattice_alone(corpus):
    """The weight of a word is that of all it says, whether the lattice is asked or not."""
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    r = random.Random(9)
    made = ["".join(c * r.choice([1, 1, 1, 2, 3]) for c in w) for w in [*INSULTS] * 20 + [word(r) for _ in range(300)]]
    for w in made + ["ab" * 3000 + "cc", "aabbccddeeffgghh" * 50]:
        assert model.weight(w) == max(map(model.word_weight, model.words(w)), default=0.0), w


def test_training_reads_whole_texts_within_its_bounds(spark):
    docs = frame(spark, [(i, "x" * 100 + f" end{i}", "s") for i in range(40)] + [(3, None, "s")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    from panelyard.llm.labelled import bounded_sample

    take = lambda rows, most: bounded_sample(docs, labels, "quality", F.lit(True), rows_a_class=rows, bytes_a_class=most)
    rows, sizes = take(100, 1 << 20)
    assert len(rows) == 41 and sizes == {0: 20, 1: 21} or len(rows) == 41
    assert all(t == "" or t.startswith("x" * 100 + " end") for _, t in rows)
    assert len(take(5, 1 << 20)[0]) == 10
    some = take(100, 550)[0]
    assert all(sum(len(t) for y, t in some if y == c) <= 550 for c in (0, 1)) and len(some) >= 8


def test_a_long_labelled_text_empties_no_class(spark):
    """Texts that pass the bound are passed over, whatever their place in the order; a class of such texts gives its shortest."""
    from panelyard.llm.labelled import bounded_sample

    for long in range(8):
        docs = frame(spark, [(i, "y" * (1200 if i // 2 == long else 90) + str(i), "s") for i in range(16)])
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id bigint, quality int, toxic int")
        got = bounded_sample(docs, labels, "quality", F.lit(True), rows_a_class=50, bytes_a_class=1000)[0]
        assert sorted((y, len(t) > 1000) for y, t in got) == [(0, False)] * 7 + [(1, False)] * 7
    docs = frame(spark, [(i, "z" * (2000 + i), "s") for i in range(6)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    assert sorted((y, len(t)) for y, t in bounded_sample(docs, labels, "quality", F.lit(True), rows_a_class=50, bytes_a_class=1000)[0]) == [(0, 2000), (1, 2001)]


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_odd_and_empty_tables(spark, model):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (7, 1, 1), (8, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, odd())
    got = model.score(docs, model.train(docs, labels)).collect()
    assert len(got) == len(odd()) and all(0 <= r["score"] <= 1 for r in got)
    bare = model.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in model.score(docs, bare).collect()} == {0.5}
    none = docs.limit(0)
    assert model.score(none, model.train(none, labels)).count() == 0
    sift = model.keep_good if model is quality_model else model.keep_civil
    assert sift(docs, model.train(docs, labels)).columns == docs.columns


def test_logistic_is_calibrated():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 1)))).astype(float)
    p = Logistic(x, y, np.ones(4000))(x)
    assert abs(p.mean() - y.mean()) < 0.01 and abs(p[p > 0.5].mean() - y[p > 0.5].mean()) < 0.05


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that only the last rows by hash have, behind 2000 a class, carries weight; the sums' fit is the local one."""
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("vile brag "), F.col("id") % 97)).otherwise("plain kind words").alias("text"))
    late = [r["doc_id"] for r in docs.where("doc_id % 2 = 1 and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").orderBy(F.desc("h")).limit(12).collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(late), "qwyxle brag").otherwise(F.col("text"))).select("doc_id", "text")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert model.weights["=qwyxle"] > 2 and model.measure("qwyxle")[0] > 2


def test_logistic_by_sums_is_the_local_fit(spark):
    from panelyard.llm.labelled import Logistic

    r = np.random.default_rng(3)
    x = r.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x @ [1, 0.3, -4] + r.normal(size=500) > -3).astype(float)
    local = Logistic(x, y, np.ones(500))
    rows = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y long, x array<double>").repartition(3)
    assert np.allclose(Logistic.over(rows, lambda v: v, 3)(x), local(x), atol=1e-5)
    assert Logistic.over(rows.where("y = 1"), lambda v: v, 3)(x[:2]) == pytest.approx([0.9525741] * 2)
    assert Logistic.over(rows.limit(0), lambda v: v, 3)(x[:2]) == pytest.approx([0.5, 0.5])


def test_features_among_marks_are_those_of_all_words(corpus):
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    texts = [text for _, text, _ in corpus[0]][:80] + ["loooser lloosseerr bookkeeper aabbccddeeffgg xx eee"]
    every = list(model.row_features(texts))
    among = {f for found in every[::3] for f in found}
    assert list(model.row_features(texts, among)) == [found & among for found in every]
    bits: dict[int, int] = {}
    for f in among:
        h = toxicity.zlib.crc32(f.encode()) % toxicity.MARKS
        bits[h // 32] = bits.get(h // 32, 0) | 1 << h % 32
    marks = toxicity.Marks(bits.items())
    assert all(f in marks for f in among) and sum(f"{i}" in marks for i in range(1000)) < 20


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """Behind 2000 a class, by hash, comes the only text of its kind; groups' dictionaries are trained on again until one is left."""
    monkeypatch.setattr(quality_model, "GROUP_BYTES", 60_000)
    r = random.Random(4)
    lines = [" ".join("".join(r.choice("bcdfgaeiou") for _ in range(6)) for _ in range(12)) for _ in range(40)]
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.element_at(F.array(*map(F.lit, lines)), (F.col("id") % 40 + 1).cast("int"))).otherwise(F.repeat(F.lit("buy now "), 12)).alias("text"))
    ranked = docs.where("doc_id % 2 = 1 and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0 and pmod(xxhash64(doc_id), 10) < 6").orderBy(F.desc(F.xxhash64("doc_id"))).limit(600)
    late = " ".join("zwqxjvk" + c for c in "abcdefghij")
    docs = docs.join(ranked.select("doc_id", F.lit(1).alias("late")), "doc_id", "left").select("doc_id", F.when(F.col("late") == 1, late).otherwise(F.col("text")).alias("text"))
    model = quality_model.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")))
    bad, good = model.dictionaries
    assert b"zwqxjvk" in good and b"zwqxjvk" not in bad and b"buy now" in bad
    assert len(good) <= quality_model.DICTIONARY


def test_labels_reach_texts_by_one_plan_and_sieve_the_others_out(spark):
    """All labelled training rows, repeated keys and null texts among them, by a merge on tables of any size; few other texts are shuffled."""
    from panelyard.llm.labelled import fold, labelled_texts, sieved

    texts = [(i, None if i == 30 else f"text {i}", "s") for i in range(3000)] + [(60, "again", "s"), (None, "no key", "s")]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i // 10 % 2, None) for i in range(0, 3000, 10)] + [(60, 1, None), (None, 1, None), (9999, 1, None)], "doc_id int, quality int, toxic int")
    got = labelled_texts(docs, labels, "quality", fold("doc_id", 5) != 0)
    marks = [(r["doc_id"], r["quality"]) for r in labels.where(fold("doc_id", 5) != 0).collect()]
    assert sorted((r["_k"], r["_t"], r["_y"]) for r in got.collect()) == sorted((d, t or "", y) for d, t, _ in texts for k, y in marks if d is not None and d == k)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1
    known = labels.select(F.col("doc_id").alias("_k"))
    left = sieved(docs.select(F.col("doc_id").alias("_k")), known, known.count())
    keys = {r["_k"] for r in left.collect()}
    assert keys >= set(range(0, 3000, 10)) and len(keys) < 300 + 0.2 * 2700


def test_slabs_of_texts_are_measured_like_pieces_one_by_one(corpus, monkeypatch):
    """Against a plain loop over pieces that asks the lattice for every one, odd white space, signs and letters among them."""
    model = toxicity.ToxicityModel([(t, text) for (_, text, _), (_, _, t) in zip(*corpus, strict=True)], {0: 400, 1: 200})
    r = random.Random(6)
    alphabet = [*"abiot01$. \u00a0é", "the", "clo", "wn", " idiot ", "İΣ\u212a", "tt", "$$$", "\x1f", "\u2003"]
    texts = [None, "", "  ", *DISGUISES, *[text for _, text, _ in corpus[0]][:60], *("".join(r.choices(alphabet, k=60)) for _ in range(300))]

    def plain(text):
        pieces = text.split()
        every = set(pieces).union(spaced := toxicity.spaced(text, pieces, set(pieces)))
        assert all(" " in s or "\t" in s or len(s.split()) > 1 for s in spaced)
        carried = {p: w for p in every if (w := max(map(model.word_weight, model.words(p)), default=0.0))}
        for word, w in model.gathered(text).items():
            carried[word] = max(w, carried.get(word, 0.0))
        top = sorted(carried.values(), reverse=True)[:4]
        n = (sum(p in carried for p in pieces) or 1) if carried else 0
        return (max(top, default=0.0), sum(top), np.log1p(100 * n / (len(pieces) + 20)), np.log1p(len(set(pieces))))

    expected = [plain(t or "") for t in texts]
    for slab in (1, 2000, 4 << 20):
        monkeypatch.setattr(toxicity.ToxicityModel, "SLAB", slab)
        assert np.allclose(model.measures(toxicity.pa.array(texts)), expected, atol=1e-12)
    assert model.measures(toxicity.pa.array([], "string")).shape == (0, 4)


def test_features_left_out_after_a_part_of_the_rows_change_no_weight(spark, corpus):
    """Weights of all fits are those that counts of every row at once give; common words are left out of the second part."""
    docs, labels = corpus
    kinds = {d: t for d, _, t in labels}
    rows = [(kinds[d], d % 4, d // 4 % toxicity.TURNS, text) for d, text, _ in docs]
    totals = [[sum(y == c and q == k for y, q, _, _ in rows) for k in range(4)] for c in (0, 1)]
    restorer = toxicity.Restorer(toxicity.CharacterModel(toxicity.plain_words(t) for *_, t in rows))
    table = spark.createDataFrame(rows, "_y long, _q long, _s long, _t string").repartition(3)
    asked = []
    marks, toxicity._marks = toxicity._marks, lambda found: asked.append(found.count()) or marks(found)
    try:
        with toxicity.scratch.workspace() as keep:
            got = toxicity._fits(table, restorer, totals, keep)
    finally:
        toxicity._marks = marks
    found = list(toxicity.ToxicityModel.of(restorer, {}).row_features(t for *_, t in rows))
    for left, weights in zip([0, 1, 2, 3, None], got, strict=True):
        counts = [toxicity.Counter(f for (y, q, *_), has in zip(rows, found, strict=True) if y == c and q != left for f in has) for c in (0, 1)]
        assert weights == toxicity.log_odds(counts, [sum(t for q, t in enumerate(totals[c]) if q != left) for c in (0, 1)], toxicity.ToxicityModel.LEAST)
    assert len(asked) == 2 and asked[1] < asked[0] / 2
