"""Invertible Bloom lookup sketches of documents, in DataFrame functions only.

A text is cut into paragraphs: lines, and long lines after a sentence end or else before white space. A paragraph's
digest has 48 bits of hash and 16 that check them. A sketch has three tables of c cells, c being a power of two of at
least the number of paragraphs; a digest goes into one cell of each, and a cell keeps the count and the XOR of its
digests. Only cells in use are held, in order of their place. Subtracting two sketches cell by cell cancels what the
texts share. Then a cell with count 1 or -1 whose XOR passes its own check holds one differing digest: all such
digests are taken out of their cells at once, which bares others, until nothing is left or nothing can be peeled.

A sketch of c cells folds to any smaller power of two, since places are the low bits of a hash. So the fingerprints
of two texts are compared at the size of the smaller. Where that gets stuck, both texts are sketched anew with four
times the cells and other hash bits, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm import scratch

#: 60 to 200 characters of a line up to a sentence end; without one, 120 and the rest of a word; or the rest of the line.
PARAGRAPH = r"[^\n]{60,200}?[.!?](?=\s|$)|[^\n]{120}[^\s]*|[^\n]+"
TABLES, LEAST_CELLS = 3, 16
#: Larger sketches tried after the fingerprints themselves. All of them get stuck with a chance below 1e-20.
RETRIES = 6
#: Rounds of peeling; what takes more is tried with a larger sketch.
ROUNDS = 40


def digests(text: Column) -> Column:
    """Distinct self-checking digests of a text's paragraphs."""
    high = lambda p: F.xxhash64(p).bitwiseAND(F.lit(~0xFFFF))
    checked = lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(0xFFFF)))
    return F.array_distinct(F.transform(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), high), checked))


def _passes(d: Column) -> Column:
    return F.xxhash64(d.bitwiseAND(F.lit(~0xFFFF))).bitwiseAND(F.lit(0xFFFF)) == d.bitwiseAND(F.lit(0xFFFF))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a lambda over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def cells_for(found: Column) -> Column:
    """Cells of a table for an array of digests: the next power of two."""
    return F.greatest(F.lit(LEAST_CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(found), F.lit(1))))).cast("int")).cast("long")


def _entries(d: Column, n: Column, c: Column, salt: Column) -> Column:
    """A digest's three cells (p, n, x); tables lie side by side, 2^32 places apart, and a salt above 0 takes other hash bits."""

    def cells(h: Column) -> Column:
        high = lambda bits: F.call_function("shiftrightunsigned", h, F.lit(bits))
        places = [high(48), high(32).bitwiseXOR(h), high(16)]
        return F.array(*[F.struct((p.bitwiseAND(c - 1) + F.lit(t << 32)).alias("p"), n.alias("n"), d.alias("x")) for t, p in enumerate(places)])

    return _with(F.when(salt == 0, d).otherwise(F.xxhash64(d, salt)), cells)


def _combined(entries: Column) -> Column:
    """Entries put together by place, without cells that cancel out."""
    zero = F.lit(0).cast("long")

    def cell(s: Column, at: Column, end: Column) -> Column:
        several = F.aggregate(F.slice(s, at + 1, end - at), F.struct(zero.alias("n"), zero.alias("x")), lambda t, e: F.struct((t["n"] + e["n"]).alias("n"), t["x"].bitwiseXOR(e["x"]).alias("x")))
        summed = _with(several, lambda t: F.struct(F.get(s, at)["p"].alias("p"), t["n"].alias("n"), t["x"].alias("x")))
        return F.when(end - at == 1, F.get(s, at)).otherwise(summed)

    def merge(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["p"] != F.get(s, i - 1)["p"]))
        return _with(begins, lambda b: F.transform(b, lambda at, k: cell(s, at, F.coalesce(F.get(b, k + 1), F.size(s)))))

    merged = _with(F.sort_array(entries), lambda s: F.when(F.size(s) > 0, merge(s)).otherwise(s))
    return F.filter(merged, lambda e: (e["n"] != 0) | (e["x"] != 0))


def sketch(found: Column, c: Column, salt: Column | None = None) -> Column:
    """The cells in use (p, n, x) of an array of digests."""
    one = F.lit(1).cast("long")
    return _combined(F.flatten(F.transform(found, lambda d: _entries(d, one, c, F.lit(0) if salt is None else salt))))


def shown(cells: Column, c: Column) -> Column:
    """A sketch as text, in hexadecimal: cells of a table, then place, count and XOR of each cell in use."""
    place = lambda e: F.concat(F.call_function("shiftright", e["p"], F.lit(32)).cast("string"), F.lit("/"), F.hex(e["p"].bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.concat(F.hex(c), F.lit(":"), F.array_join(F.transform(cells, lambda e: F.concat(place(e), F.lit("."), F.hex(e["n"]), F.lit("."), F.lower(F.hex(e["x"])))), ","))


def subtracted(one: Column, other: Column, c: Column) -> Column:
    """The cells of two sketches, folded to tables of ``c`` cells, one less the other."""
    low = lambda e: e["p"].bitwiseAND(F.lit(7 << 32).bitwiseOR(c - 1))
    mine = F.transform(one, lambda e: F.struct(low(e).alias("p"), e["n"].alias("n"), e["x"].alias("x")))
    theirs = F.transform(other, lambda e: F.struct(low(e).alias("p"), (-e["n"]).alias("n"), e["x"].alias("x")))
    return _combined(F.concat(mine, theirs))


def peeled(cells: Column, c: Column, salt: Column | None = None) -> Column:
    """(mine, theirs): numbers of digests that only one of two subtracted sketches has; null where peeling gets stuck."""
    zero = F.lit(0).cast("long")
    start = F.struct(cells.alias("cells"), zero.alias("mine"), zero.alias("theirs"), F.lit(True).alias("go"))

    def pure(state: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(state["cells"], lambda e: (e["n"] == n) & _passes(e["x"])), lambda e: e["x"]))

    def taken(found: Column, n: int) -> Column:
        return F.flatten(F.transform(found, lambda d: _entries(d, F.lit(n).cast("long"), c, F.lit(0) if salt is None else salt)))

    def step(state: Column, _: Column) -> Column:
        def take(k: Column) -> Column:
            rest = _combined(F.concat(state["cells"], taken(k["mine"], -1), taken(k["theirs"], 1)))
            return F.struct(rest.alias("cells"), (state["mine"] + F.size(k["mine"])).alias("mine"), (state["theirs"] + F.size(k["theirs"])).alias("theirs"), F.lit(True).alias("go"))

        stop = F.struct(state["cells"].alias("cells"), state["mine"].alias("mine"), state["theirs"].alias("theirs"), F.lit(False).alias("go"))
        known = F.struct(pure(state, 1).alias("mine"), pure(state, -1).alias("theirs"))
        return F.when(~state["go"] | (F.size(state["cells"]) == 0), state).otherwise(_with(known, lambda k: F.when(F.size(k["mine"]) + F.size(k["theirs"]) == 0, stop).otherwise(take(k))))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _with(done, lambda s: F.when(F.size(s["cells"]) == 0, F.struct(s["mine"].alias("mine"), s["theirs"].alias("theirs"))))


def with_likeness(df: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """``df`` with the Dice likeness of two texts: twice the shared digests over all, 1 for two empty texts.

    For each of ``one`` and ``other``, a text's column prefix, the columns _d (digests), _c (cells of a table) and _s
    (sketch) are read. Fingerprints are first compared at the size of the smaller; where the numbers of digests differ
    by more than such a sketch can tell apart, this is skipped. Next, the shorter text is sketched with as many cells as
    the longer text's fingerprint has. Then both are sketched with four times the cells, and so on. The tries are one
    loop over the same expressions, which ends with the first that isn't stuck.
    """
    n1, n2 = F.size(f"{one}_d"), F.size(f"{other}_d")
    df = df.withColumn("_c0", F.least(f"{one}_c", f"{other}_c")).withColumn("_c", F.greatest(f"{one}_c", f"{other}_c"))

    def attempt(k: Column) -> Column:
        c = F.when(k == 0, F.col("_c0")).otherwise(F.col("_c") * F.pow(F.lit(4.0), F.greatest(k - 1, F.lit(0))).cast("long"))
        salt = F.greatest(k - 1, F.lit(0))

        def compared(at: Column) -> Column:
            side = lambda x: F.when((k == 0) | ((k == 1) & (F.col(f"{x}_c") == at["c"])), F.col(f"{x}_s")).otherwise(sketch(F.col(f"{x}_d"), at["c"], at["salt"]))
            return peeled(subtracted(side(one), side(other), at["c"]), at["c"], at["salt"])

        worth = F.when(k == 0, F.abs(n1 - n2) <= F.lit(2) * F.col("_c0")).when(k == 1, F.col("_c") > F.col("_c0")).otherwise(F.lit(True))
        return F.when(worth, _with(F.struct(c.alias("c"), salt.alias("salt")), compared))

    nothing = F.lit(None).cast("struct<mine:bigint,theirs:bigint>")
    tries = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES + 1)), nothing, lambda found, k: F.when(found.isNotNull(), found).otherwise(attempt(k)))
    df = df.withColumn("_left", tries)
    left = F.when(F.col("_left").isNull(), F.raise_error(F.lit("a sketch couldn't be peeled at any size")).cast("long")).otherwise(F.col("_left.mine"))
    value = F.when(n1 + n2 == 0, F.lit(1.0)).otherwise(2.0 * (n1 - left) / (n1 + n2))
    return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop("_left", "_c", "_c0")


def sketched(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the cells of a table and the sketch of each named text's digests."""
    return df.withColumns({f"{x}_c": cells_for(F.col(f"{x}_d")) for x in names}).withColumns({f"{x}_s": sketch(F.col(f"{x}_d"), F.col(f"{x}_c")) for x in names})


def successors(rows: DataFrame) -> DataFrame:
    """For distinct (k, t, n) in descending order of k (null last), then t: the next k and t; the last is followed by the first.

    Rows are range-partitioned and linked within their partition; the partitions' first rows, one each, close the
    gaps between them. So no window ever spans the table.
    """
    order = [F.col("k").desc_nulls_last(), F.col("t").asc()]
    placed = scratch.written(rows.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "places")
    within = Window.partitionBy("p").orderBy(*order)
    linked = placed.select("*", F.lead(F.struct("k", "t")).over(within).alias("next"), F.row_number().over(within).alias("r"))
    heads = placed.groupBy("p").agg(F.count("*").alias("rows")).join(linked.where("r = 1").select("p", F.struct("k", "t").alias("head")), "p")
    following = heads.select("p", F.coalesce(F.lead("head").over(Window.orderBy("p")), F.first("head").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return linked.join(following, "p").select("k", "t", "n", F.coalesce("next", "after").alias("next")).select("k", "t", "n", F.col("next.k").alias("nk"), F.col("next.t").alias("nt"))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text without its last third (floor of characters), followed by as many characters
    from the start of the next document, in descending order of key. Texts move once: by key, both for asking
    and for giving; a third of them moves a second time, as what the asker gets.

    Null text counts as empty. An empty text has an empty sketch, and two of these are alike (1.0). Rows that
    repeat key and text take one place in the order and have equal results; rows that repeat a key with other
    texts follow one another in the order of a hash of the text; null keys come last. A single document is its
    own next. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    every = base.select("k", "t", F.length("text").alias("n"))
    places = every.distinct()
    order = scratch.written(successors(places), "successors")
    rows = base.select("k", "t", "text", digests(F.col("text")).alias("own"))
    asks = order.select(F.col("nk").alias("ak"), F.col("nt").alias("at"), F.col("k").alias("rk"), F.col("t").alias("rt"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    given = rows.join(asks, F.col("k").eqNullSafe(F.col("ak")) & (F.col("t") == F.col("at"))).select("rk", "rt", "need", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("lead"), F.col("own").alias("after"))
    if docs.count() != order.count():
        given = given.dropDuplicates(["rk", "rt"])
    both = rows.join(given, F.col("k").eqNullSafe(F.col("rk")) & (F.col("t") == F.col("rt")))
    edited = both.select("k", F.col("own").alias("own_d"), F.col("after").alias("after_d"), F.length("text").cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("need")), F.col("lead")).alias("edited"))
    cut = edited.select("k", "own_d", "after_d", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("changed_d"))
    likened = sketched(cut, "own", "changed", "after")
    likened = with_likeness(with_likeness(likened, "own", "changed", "near_edited"), "own", "after", "near_next")
    prints = [shown(F.col(f"{x}_s"), F.col(f"{x}_c")).alias(name) for x, name in (("own", "fingerprint"), ("changed", "edited_fingerprint"))]
    return likened.select(F.col("k").alias(key), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")
