"""Near duplicates by an inverted join over MinHash signature coordinates.

Texts with equal shingle sets first become one class, so copies cost a row each and no pair. A class is then
posted under each of its (coordinate, value) pairs. Two sets of similarity 0.75 agree on 36 of 48 coordinates
in the mean; fewer than ``MATCHES`` = 20 is more than five standard deviations away (chance under 1e-6). So:

* a value that one class alone has is in no match, and a class with under 20 shared values has no match;
* with each class's shared values in order of rarity, two classes with 20 matches must share one among all but
  the last 19 of either (prefix filter). Common values, such as those of a passage that many documents carry,
  sit at the end and are skipped;
* within a posting list, members are first held against one anchor each, the one whose values are most common, in
  a few rounds with other anchors, and linked members fall into components. A pair inside a component needs no
  look any more. What remains, pairs across components in one list, is looked at in full, but for pairs that their
  numbers of shared shingles rule out, and counted against ``MATCHES`` on whole signatures. Short lists are joined
  for that; the members of long ones are compared in blocks of bounded size, from which only links come out.

Every link is confirmed on the full shingle sets before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm import scratch
from panelyard.llm.buffers import utf8
from panelyard.llm.components import connected
from panelyard.llm.mixing import WORD
from panelyard.llm.shingles import set_hash, shingle_sets, signatures

COORDINATES, MATCHES, WIDTH, PERCENT = 48, 20, 5, 75
ANCHOR_ROUNDS = 4
Keep = Callable[[DataFrame, str], DataFrame]
#: Posting lists of up to this many members are joined with themselves; longer ones are compared in blocks of two chunks.
SHORT, CHUNK, COLUMNS = 16, 256, 4096
#: Class ids up to this number are sent to all executors (16 bytes each); beyond it, texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(column))
    for first, flat, bounds in shingle_sets(data, offsets, WIDTH):
        yield first, len(bounds) - 1, flat, bounds


def signed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, h (hash of the shingle set; null without shingles or key) and sig for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, flat, bounds in _sets(batch, 1):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes > 0)
                packed = np.append(bounds[full], bounds[-1])
                hashes, sig = np.zeros(n, np.int64), np.zeros((n, COORDINATES), np.int32)
                if len(full):
                    hashes[full], sig[full] = set_hash(flat, packed), signatures(flat, packed, COORDINATES)
                keys = batch.column(0).slice(first, n)
                none = (sizes == 0) | keys.is_null().to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, COORDINATES))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[~none].ravel()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes.astype(np.int64)), pa.array(hashes, mask=none), lists], names=[key, "n_shingles", "h", "sig"])

    return docs.select(key, text).mapInArrow(sign, f"`{key}` {kind}, n_shingles bigint, h bigint, sig array<int>")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(h, n, members) of the wanted (key, h): sets of whole texts, kept where they hash to h."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column(0).to_numpy()
            for first, n, flat, bounds in _sets(batch, 1):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes > 0)
                got = np.zeros(n, np.int64)
                if len(full):
                    got[full] = set_hash(flat, np.append(bounds[full], bounds[-1]))
                lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sizes.astype(np.int64)), lists], names=["h", "n", "members"])
                yield rows.filter(pa.array((got == expected[first : first + n]) & (sizes > 0)))

    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(side.withColumnRenamed(key, "_key"), "_key")
    return texts.select("h", "_text").mapInArrow(build, "h bigint, n bigint, members array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share ``PERCENT`` of their union; sizes are compared before sets are."""
    one = pairs.join(sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb")), "b")
    two = one.join(sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma")), "a")
    near = two.where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))
    met = near.select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).alias("common"))
    return met.where(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def links(docs: DataFrame, signs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(v, c): the component of each class that is linked with another; None if nothing can be linked."""
    with scratch.workspace() as keep:
        return _links(docs, signs, key, text, keep)


def _links(docs: DataFrame, signs: DataFrame, key: str, text: str, keep: Keep) -> DataFrame | None:
    classes = keep(signs.where("h is not null").groupBy("h").agg(F.min(key).alias(key), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    posted = classes.select("h", F.posexplode("sig").alias("k", "value")).select("h", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("entry"))
    shared = posted.groupBy("entry").agg(F.count("*").alias("freq")).where("freq > 1")
    met = posted.join(shared, "entry")
    mine = Window.partitionBy("h")
    ranked = met.withColumn("m", F.count("*").over(mine)).withColumn("r", F.row_number().over(mine.orderBy("freq", "entry")))
    ranked = ranked.withColumn("common", F.sum("freq").over(mine))
    prefix = keep(ranked.where(f"m >= {MATCHES} and r <= m - {MATCHES - 1}").select("h", "entry", "common"), "prefix")
    members = prefix.select("h").distinct()
    wanted = keep(classes.join(members, "h", "left_semi").select(key, "h", "n", "sig"), "candidates")
    sets = keep(_full_sets(docs, wanted.select(key, "h"), key, text), "sets")
    found: DataFrame | None = None
    labels: DataFrame | None = None
    lists = prefix
    for turn in range(ANCHOR_ROUNDS):
        placed = _labelled(lists, labels)
        chance = F.lit(1.0) if turn == 0 else 0.6 + 0.4 * F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        anchors = placed.groupBy("entry").agg(F.max(F.struct((F.col("common") * chance).alias("o"), F.col("h").alias("anchor"), F.col("c").alias("ac"))).alias("best")).select("entry", "best.anchor", "best.ac")
        against = placed.join(anchors, "entry").where("c <> ac and h <> anchor").groupBy("h", "anchor").count()
        one = against.groupBy("h").agg(F.max(F.struct("count", "anchor")).alias("best")).select(F.col("best.anchor").alias("a"), F.col("h").alias("b"))
        new = keep(_confirmed(one, sets), f"links-{turn}")
        if new.isEmpty():
            break
        found = new if found is None else found.unionAll(new)
        labels = _replaced(labels, connected(found))
        lists = _mixed(prefix, labels, keep)
        if lists.isEmpty():
            return labels
    new = keep(_across(_labelled(lists, labels), wanted, sets, keep), "links-rest")
    if not new.isEmpty():
        labels = _replaced(labels, connected(new if found is None else found.unionAll(new)))
    return labels


def _replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is not None:
        scratch.drop(old)
    return new


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("c", F.col("h"))
    return lists.join(labels.withColumnRenamed("v", "h"), "h", "left").withColumn("c", F.coalesce("c", "h"))


def _mixed(prefix: DataFrame, labels: DataFrame, keep: Keep) -> DataFrame:
    """The posting lists that hold members of two components or more."""
    placed = _labelled(prefix, labels)
    several = placed.groupBy("entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("entry")
    return keep(prefix.join(several, "entry", "left_semi"), "mixed")


def _shared_shingles(members: DataFrame, sets: DataFrame, keep: Keep) -> DataFrame:
    """(h, n, s) of members: s of their n shingles are in another member's set too. Those with s under 75 percent of n are left out.

    Linked sets share 75 percent of either, so nothing that is left out has a link among the members.
    """
    rows = sets.join(members, "h", "left_semi").select("h", "n", F.explode("members").alias("x"))
    twice = rows.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x")
    found = rows.join(twice, "x").groupBy("h", "n").agg(F.count("*").alias("s"))
    return keep(found.where(f"100 * s >= {PERCENT} * n"), "shared")


def _across(placed: DataFrame, wanted: DataFrame, sets: DataFrame, keep: Keep) -> DataFrame:
    """Links (a, b) between different components of one posting list: at least one for every two components that have any.

    Members that can't be linked are left out first. Lists of up to ``SHORT`` members are joined with themselves, so a
    row meets at most that many others. Longer lists overlap nearly whole, as the copies of one text share most of
    their values, so joining each with itself would find the same pairs again and again. Their members are put
    together to families, lists that share a member being one, and a family is compared once, in blocks.
    """
    placed = placed.join(_shared_shingles(placed.select("h").distinct(), sets, keep), "h")
    lists = placed.groupBy("entry").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("h").alias("head")).where("lo <> hi")
    placed = keep(placed.join(lists.select("entry", "f", "head"), "entry"), "apart")
    short = placed.where(f"f <= {SHORT}")
    side = lambda s: short.select("entry", *[F.col(c).alias(c + s) for c in ("h", "c", "n", "s")])
    met = side("a").join(side("b"), "entry").where(f"ha < hb and ca <> cb and {_could('na', 'nb', 'sa', 'sb')}")
    pairs = met.select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()
    signs = wanted.select("h", "sig")
    both = pairs.join(signs.select(F.col("h").alias("a"), F.col("sig").alias("sa")), "a").join(signs.select(F.col("h").alias("b"), F.col("sig").alias("sb")), "b")
    agreed = both.where(F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)) >= MATCHES).select("a", "b")
    found = _confirmed(agreed, sets)
    long = placed.where(f"f > {SHORT}")
    if long.isEmpty():
        return found
    family = connected(long.select(F.col("head").alias("a"), F.col("h").alias("b")).distinct())
    members = long.select("h", "c", "s").distinct().join(family.select(F.col("v").alias("h"), F.col("c").alias("g")), "h")
    return found.unionAll(_in_blocks(members, wanted, sets))


def _could(na: str, nb: str, sa: str, sb: str) -> str:
    """Sets of sizes a and b that are linked share 75 / 175 of a + b, so each must have as many shingles that any other member has."""
    return f"100 * least({na}, {nb}) >= {PERCENT} * greatest({na}, {nb}) and {100 + PERCENT} * least({sa}, {sb}) >= {PERCENT} * ({na} + {nb})"


def _in_blocks(members: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of each family of (g, h, c, s), compared block by block.

    A family's largest component stands apart: its members meet the others, but not one another. Members are dealt by
    hash into chunks of about ``CHUNK``, and a block holds two chunks, so its size doesn't depend on the family's. In
    a block, pairs are counted against ``MATCHES`` on signatures and those that stay are confirmed on full sets; rows
    are given out for links alone, one for each two components.
    """
    sizes = members.groupBy("g", "c").count()
    most = sizes.groupBy("g").agg(F.max(F.struct("count", "c")).alias("m"), F.sum("count").alias("all"))
    parts = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    families = most.select("g", F.col("m.c").alias("main"), parts(F.col("all") - F.col("m.count")).alias("kf"), parts(F.col("m.count")).alias("km"))
    dealt = members.join(families, "g").withColumn("apart", F.col("c") == F.col("main"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("h", F.lit(17)), F.when(F.col("apart"), F.col("km")).otherwise(F.col("kf")).cast("long")).cast("int"))
    place = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    others = F.sequence(F.lit(0), F.col("kf") - 1)
    here = F.transform(others, lambda k: F.when(k < F.col("i"), place(k, F.col("i"), True)).otherwise(place(F.col("i"), k, False)))
    against = F.transform(F.sequence(F.col("kf"), F.col("kf") + F.col("km") - 1), lambda k: place(F.col("i"), k, False))
    main = F.transform(others, lambda k: place(k, F.col("kf") + F.col("i"), True))
    blocks = dealt.select("g", "h", "c", "s", F.explode(F.when(F.col("apart"), main).otherwise(F.concat(here, against))).alias("at")).select("g", "at.*", "h", "c", "s")
    full = blocks.join(wanted.select("h", "sig"), "h").join(sets.select("h", "n", "members"), "h")
    return full.select("g", "i", "j", "right", "h", "c", "s", "n", "sig", "members").groupBy("g", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")


def _block_links(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    flag = table.column("right").to_numpy()
    left = np.flatnonzero(~flag)
    right = np.flatnonzero(flag) if flag.any() or table.column("i")[0].as_py() != table.column("j")[0].as_py() else left
    h, c, s, n = (table.column(name).to_numpy() for name in ("h", "c", "s", "n"))
    sig = table.column("sig").combine_chunks()
    sig = sig.flatten().to_numpy().reshape(len(h), COORDINATES)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        agree += sig[left, k][:, None] == sig[right, k][None, :]
    least = lambda a: np.minimum(a[left][:, None], a[right][None, :])
    both = n[left][:, None] + n[right][None, :]
    keep = (agree >= MATCHES) & (c[left][:, None] != c[right][None, :]) & ((100 + PERCENT) * least(s) >= PERCENT * both)
    x, y = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
    left, right, keep = left[x], right[y], keep[np.ix_(x, y)]
    lists = table.column("members").combine_chunks()
    common = _shared_counts(lists, left, right)
    a, b = np.nonzero(keep & ((100 + PERCENT) * common >= PERCENT * both[np.ix_(x, y)]))
    a, b = left[a], right[b]
    _, first = np.unique(np.stack([c[a], c[b]], 1), axis=0, return_index=True)
    return pa.table({"a": pa.array(h[a[first]]), "b": pa.array(h[b[first]])})


def _shared_counts(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices, ``COLUMNS`` shingles at a time."""
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    common = np.zeros((len(left), len(right)), np.int64)

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = bounds[rows + 1] - bounds[rows]
        at = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(len(rows)), size), flat[at]

    (ri, rx), (ci, cx) = entries(left), entries(right)
    known = np.intersect1d(rx, cx)
    if not len(known):
        return common

    def placed(i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        has = known[at] == x
        order = np.argsort(at[has], kind="stable")
        return i[has][order], at[has][order]

    (ri, rx), (ci, cx) = placed(ri, rx), placed(ci, cx)
    for begin in range(0, len(known), COLUMNS):
        sides = []
        for i, x, rows in ((ri, rx, len(left)), (ci, cx, len(right))):
            lo, hi = np.searchsorted(x, (begin, begin + COLUMNS))
            dense = np.zeros((rows, COLUMNS), np.float32)
            dense[i[lo:hi], x[lo:hi] - begin] = 1
            sides.append(dense)
        common += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return common


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    component_id is the smallest key that links lead to, the row's own included, and kept is whether that is
    the row's own. Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    A row without key is linked with nothing either: its component is null and it is kept. Rows that repeat a
    key with one text share everything; with several texts, each text has its own links. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    signs = scratch.written(signed(docs, key=key, text=text), "signed")
    labels = links(docs, signs, key=key, text=text)
    rows = signs.select(key, "n_shingles", "h")
    firsts = rows.where("h is not null").groupBy("h").agg(F.min(key).alias("first"))
    if labels is not None:
        grouped = firsts.join(labels.withColumnRenamed("v", "h"), "h").select("h", "c", "first")
        least = grouped.groupBy("c").agg(F.min("first").alias("component"))
        firsts = firsts.join(grouped.select("h", "c").join(least, "c").select("h", "component"), "h", "left").select("h", F.coalesce("component", "first").alias("first"))
    return rows.join(firsts, "h", "left").select(
        key, "n_shingles", F.coalesce("first", key).alias("component_id"), (F.col(key).isNull() | (F.coalesce("first", key) == F.col(key))).alias("kept")
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest key; all columns are kept.

    Rows are told apart by key and text together, so rows that repeat a key with another text are judged on
    their own; of rows that repeat both, one stays. Rows without key and texts without words take no part: they are
    linked with nothing and all stay, repeated or not. What goes is a small part of the table and is sent to all
    executors while it has at most ``BROADCAST_ROWS`` rows; beyond, the texts are joined by shuffle. An empty
    table gives an empty result. Columns of any name are kept as they are.
    """
    named = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("t")))
    tagged = docs.select(named.alias("_key"), F.col(text).alias("_text"))
    judged = scratch.written(near_duplicates(tagged, key="_key", text="_text").where("_key is not null and n_shingles > 0").select("_key", "kept"), "judged")
    gone_key, gone_text = scratch.free(docs, "_gone_key", "_gone_text")
    gone = judged.where("not kept").select(F.col("_key.k").alias(gone_key), F.col("_key.t").alias(gone_text)).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, (F.col(key) == F.col(gone_key)) & (F.xxhash64(text) == F.col(gone_text)), "left_anti")
    stays = judged.where("kept")
    if stays.select("_key").distinct().count() < stays.count():
        takes_part = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(WORD), F.lit(False))
        left = left.where(takes_part).dropDuplicates([key, text]).unionAll(left.where(~takes_part))
    return left
