"""Mean correlations over all pairs of many series with gaps, without a row for a pair.

Series are vectors over the calendar, in order of the dates that they have, cut into tiles of bounded size; every two tiles
meet once, in a task of their own. Within a task, series that have the same dates are added up: on the dates that
two such classes share, the correlations of all their pairs sum to the product of their summed standardised returns. Series
whose dates few others have are correlated pair by pair, as matrix products. So work grows with the pairs of
classes where dates are shared, with all pairs at worst, and what is shuffled with the panel times the tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import scan

#: Bytes of a tile's matrix, the tiles a group is cut into at least, and the series from which that is worth it.
TILE_BYTES, TILES, WORTH = 16 << 20, 4, 512
#: Series from which those with the same dates are summed and not paired; rows and columns of a block of pairs.
CLASS, BLOCK = 64, 1024
#: Variance on common dates, against the series' own, below which a block's sums say too little and a pair is done by itself.
SMALL = 1e-7


def _standard(x: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Series (rows) on dates that all have, less their means and over their deviations, and their families; flat ones are left out."""
    live = x.max(1) > x.min(1)
    x = x[live]
    d = x - x.mean(1, keepdims=True)
    spread = np.sqrt((d * d).mean(1, keepdims=True))
    fine = spread[:, 0] > 0
    return d[fine] / spread[fine], family[live][fine]


class Totals:
    """Sum and number of correlations of all pairs, and of those within each family."""

    def __init__(self, families: int) -> None:
        self.all, self.pairs = 0.0, 0
        self.sums, self.counts = np.zeros(families), np.zeros(families, np.int64)

    def classes(self, x: np.ndarray, fx: np.ndarray, y: np.ndarray | None = None, fy: np.ndarray | None = None) -> None:
        """All pairs of x and y on common dates, or all pairs within x; rows in order of family."""
        n = x.shape[1]
        z, f = _standard(x, fx)
        if not len(z):
            return
        names, at, k = np.unique(f, return_index=True, return_counts=True)
        s = np.add.reduceat(z, at, axis=0)
        if y is None:
            self.all += ((s.sum(0) ** 2).sum() / n - len(z)) / 2
            self.pairs += len(z) * (len(z) - 1) // 2
            self.sums[names] += ((s * s).sum(1) / n - k) / 2
            self.counts[names] += k * (k - 1) // 2
            return
        w, g = _standard(y, fy)
        if not len(w):
            return
        others, there, m = np.unique(g, return_index=True, return_counts=True)
        t = np.add.reduceat(w, there, axis=0)
        self.all += float(s.sum(0) @ t.sum(0)) / n
        self.pairs += len(z) * len(w)
        both, i, j = np.intersect1d(names, others, assume_unique=True, return_indices=True)
        self.sums[both] += (s[i] * t[j]).sum(1) / n
        self.counts[both] += k[i] * m[j]

    def add(self, r: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> None:
        """Correlations of pairs, one a place, with both families."""
        self.all += float(r.sum())
        self.pairs += len(r)
        same = fx == fy
        self.sums += np.bincount(fx[same], r[same], len(self.sums))
        self.counts += np.bincount(fx[same], minlength=len(self.counts))

    def pairwise(self, x: np.ndarray, fx: np.ndarray, y: np.ndarray | None = None, fy: np.ndarray | None = None) -> None:
        """All pairs of x and y, or all within x, whose rows may lack dates (NaN), a block of pairs at a time."""
        own = y is None
        y, fy = (x, fx) if own else (y, fy)
        for a in range(0, len(x), BLOCK):
            for b in range(a if own else 0, len(y), BLOCK):
                self._block(x[a : a + BLOCK], fx[a : a + BLOCK], y[b : b + BLOCK], fy[b : b + BLOCK], own and a == b)

    def _block(self, x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray, upper: bool) -> None:
        (m, u), (w, v) = _placed(x), _placed(y)
        n = m @ w.T
        sx, sy = u @ w.T, m @ v.T
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = ((u * u) @ w.T - sx * sx / n) / n, (m @ (v * v).T - sy * sy / n) / n
            r = (u @ v.T - sx * sy / n) / n / np.sqrt(vx * vy)
        met = n >= 2
        if upper:
            met &= np.triu(np.ones(met.shape, bool), 1)
        plain = met & (vx > SMALL) & (vy > SMALL)
        i, j = np.nonzero(plain)
        self.add(r[plain], fx[i], fy[j])
        i, j = np.nonzero(met & ~plain)
        for a in range(0, len(i), BLOCK):
            self._single(x, fx, y, fy, i[a : a + BLOCK], j[a : a + BLOCK])

    def _single(self, x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        p, q = x[i], y[j]
        lost = np.isnan(p) | np.isnan(q)
        p, q = np.where(lost, np.nan, p), np.where(lost, np.nan, q)
        live = (np.nanmax(p, 1) > np.nanmin(p, 1)) & (np.nanmax(q, 1) > np.nanmin(q, 1))
        p, q, i, j = p[live], q[live], i[live], j[live]
        p, q = p - np.nanmean(p, 1)[:, None], q - np.nanmean(q, 1)[:, None]
        scale = np.sqrt(np.nansum(p * p, 1)) * np.sqrt(np.nansum(q * q, 1))
        fine = scale > 0
        self.add(np.nansum(p * q, 1)[fine] / scale[fine], fx[i[fine]], fy[j[fine]])


def _placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a row has values, and its values less their mean, over their deviation, 0 where there is none."""
    there = ~np.isnan(x)
    d = x - np.nanmean(x, 1)[:, None]
    spread = np.sqrt(np.nanmean(d * d, 1))[:, None]
    return there.astype(float), np.where(there, d / np.where(spread > 0, spread, 1.0), 0.0)


class Tile:
    """Series as rows, sorted by the dates they have and by family; runs of :data:`CLASS` and more with the same dates are classes, the rest is loose."""

    def __init__(self, rows: pa.Table, dates: int, family: np.ndarray) -> None:
        at, ret = rows["at"].combine_chunks(), rows["x"].combine_chunks()
        x = np.full((len(rows), dates), np.nan)
        x[np.repeat(np.arange(len(rows)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = ret.flatten().to_numpy()
        bits = np.packbits(~np.isnan(x), axis=1)
        _, kind = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((family, kind))
        x, family, kind = x[order], family[order], kind[order]
        ends = np.flatnonzero(np.diff(kind, append=-1)) + 1
        runs = list(zip(np.r_[0, ends[:-1]], ends, strict=True))
        self.classes = [(~np.isnan(x[a]), x[a:b], family[a:b]) for a, b in runs if b - a >= CLASS]
        loose = np.concatenate([np.arange(a, b) for a, b in runs if b - a < CLASS] or [np.zeros(0, int)])
        self.x, self.family = x[loose], family[loose]


def _crossed(left: Tile, right: Tile | None, totals: Totals) -> None:
    """All pairs of two tiles, or within one."""
    other = right or left
    for i, (here, x, fx) in enumerate(left.classes):
        for there, y, fy in other.classes[0 if right else i :]:
            if y is x:
                if here.sum() > 1:
                    totals.classes(x[:, here], fx)
            elif (common := here & there).sum() > 1:
                totals.classes(x[:, common], fx, y[:, common], fy)
    for _, y, fy in other.classes:
        totals.pairwise(left.x, left.family, y, fy)
    if right:
        for _, x, fx in left.classes:
            totals.pairwise(x, fx, right.x, right.family)
        totals.pairwise(left.x, left.family, right.x, right.family)
    else:
        totals.pairwise(left.x, left.family)


def correlation_sums(returns: DataFrame, *, across: bool = True) -> DataFrame:
    """(family, s, n): sum and number of the correlations of all pairs within each family, and, with a null family, of all pairs.

    ``returns`` is (date, candidate, family, ret), a row for each candidate and date at most. Correlations are Pearson's over common
    dates; pairs with fewer than two, or of which one is flat there, have none and aren't counted. Without ``across`` only
    families meet, and there is no row of all pairs. Candidates without a family are left out.
    """
    rows = returns.where("ret is not null and family is not null").select("date", "candidate", "family", "ret")
    calendar = rows.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    own = rows.join(F.broadcast(calendar), "date").groupBy("candidate", "family").agg(F.array_sort(F.collect_list(F.struct("_i", "ret"))).alias("s"))
    by: Sequence[str] = () if across else ("family",)
    series = own.select("candidate", "family", F.col("s._i").alias("at"), F.col("s.ret").cast("array<double>").alias("x")).where(F.array_max("x") > F.array_min("x"))
    ranked = scan.ranked(series, F.col("at"), F.col("family"), by=by, _k=F.count(F.lit(1)))
    dates = calendar.count()
    size = F.greatest(F.lit(1), F.least(F.lit(TILE_BYTES // (8 * max(dates, 1))), F.greatest(F.lit(WORTH), F.ceil(F.col("_k") / TILES))))
    tiled = ranked.withColumn("_t", F.floor((F.col("_r") - 1) / size)).withColumn("_u", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / size).cast("int"))))
    dealt = tiled.select("family", "at", "x", F.least("_t", "_u").alias("i"), F.greatest("_t", "_u").alias("j"), (F.col("_t") <= F.col("_u")).alias("first"))
    kind = returns.schema["family"].dataType.simpleString()

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        coded = rows["family"].combine_chunks().dictionary_encode()
        names, family = coded.dictionary, coded.indices.to_numpy()
        totals, first = Totals(len(names)), rows["first"].to_numpy()
        left = Tile(rows.filter(pa.array(first)), dates, family[first])
        _crossed(left, None if first.all() else Tile(rows.filter(pa.array(~first)), dates, family[~first]), totals)
        s, n = [*totals.sums, totals.all], [*totals.counts, totals.pairs]
        return pa.table({"family": pa.chunked_array([names, pa.nulls(1, names.type)]), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64())})

    sums = dealt.groupBy(*by, "i", "j").applyInArrow(work, f"family {kind}, s double, n bigint")
    return (sums if across else sums.where("family is not null")).groupBy("family").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
