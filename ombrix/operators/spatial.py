"""Nearest neighbours by grid cells, as equi-joins instead of all pairs, and by boxes within one object."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_of(near: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Of near(keys, id_, distance) the row of least distance, then least id, for each key; partial minima come before the shuffle."""
    best = near.groupBy(*keys).agg(F.min(F.struct("distance", id_)).alias("_m"))
    return best.select(*keys, F.col(f"_m.{id_}").alias(id_), F.col("_m.distance").alias("distance"))


def nearest_within(sources: DataFrame, targets: DataFrame, radius: float, keys: list[str], source_id: str, target_id: str) -> DataFrame:
    """(keys, source_id, target_id, distance) of the nearest target within the radius, ties to the smaller id.

    sources and targets have x, y, z. Sources go to those of the 27 cells around theirs that the
    radius reaches (half a cell each way, so 8 of them at most); targets stay in one.
    """
    size = 2.0 * radius
    s = sources.select(*keys, source_id, *[F.col(c).alias(f"_s{c}") for c in "xyz"])
    for c in "xyz":
        lo, hi = (F.floor((F.col(f"_s{c}") + F.lit(r)) / size) for r in (-radius * (1 + 1e-9), radius * (1 + 1e-9)))
        s = s.withColumn(f"_c{c}", F.explode(F.sequence(lo, hi)))
    t = targets.select(*keys, target_id, *"xyz", *[F.floor(F.col(c) / size).alias(f"_c{c}") for c in "xyz"])
    gap = [F.col(c) - F.col(f"_s{c}") for c in "xyz"]
    # a cell holds many pairs per row, which a merge join walks some seven times slower; each target is in the tables once
    near = s.join(t.hint("shuffle_hash"), [*keys, "_cx", "_cy", "_cz"]).select(*keys, source_id, target_id, F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("distance")).filter(F.col("distance") <= radius)
    return nearest_of(near, [*keys, source_id], target_id)


#: Up to so many rows all pairs are measured; above, leaves of a tree of boxes. Distances held at once. Squares below HUGE are numbers.
FEW, HELD = 1024, 1 << 18
HUGE = 1e150


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of places a (m, 3) and b (n, 3), each sum in the order x, y, z."""
    x, y, z = (b[None, :, i] - a[:, None, i] for i in range(3))
    x *= x
    y *= y
    z *= z
    x += y
    x += z
    return x


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """(m, k): columns of the k least of each row of d, ties to the first columns; NaN comes last."""
    cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    take = d <= cut
    n = take.sum(1)
    over = np.flatnonzero(n > k)
    if len(over):
        tied = d[over] == cut[over]
        less = take[over] & ~tied
        take[over] = less | (tied & (np.cumsum(tied, axis=1) <= k - less.sum(1, keepdims=True)))
    out = np.empty((len(d), k), dtype=np.int64)
    fine = n >= k
    out[fine] = np.nonzero(take[fine])[1].reshape(-1, k)
    for i in np.flatnonzero(~fine):
        out[i] = np.argsort(d[i], kind="stable")[:k]
    return out


def _all_pairs(place: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    step = max(1, HELD // len(place))
    return np.concatenate([_least(squares(place[asked[i : i + step]], place), k) for i in range(0, len(asked), step)])


def _leaves(place: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in leaves of most / 2 to most, split at the median of the widest side; neighbours in the list lie close."""
    todo, out = [np.arange(len(place))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        p = place[rows]
        at = len(rows) // 2
        order = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], at)
        todo += [rows[order[at:]], rows[order[:at]]]
    return out


def _by_boxes(place: np.ndarray, k: int) -> np.ndarray:
    """(n, k) as nearest_rows, of finite places. Rounded differences, squares and sums never fall where their terms
    grow, so no row of a box is nearer than the box by the same formula: what is left out is farther."""
    # of rows at one place only the first k can be among anybody's k nearest, and all have the same ones
    spots, spot = np.unique(place, axis=0, return_inverse=True)
    spot = spot.reshape(-1)
    order = np.argsort(spot, kind="stable")
    starts = np.searchsorted(spot[order], np.arange(len(spots)))
    kept = np.sort(order[np.arange(len(order)) - starts[spot[order]] < k])
    near = place[kept]
    leaves = _leaves(near, max(2 * k, 32))
    lo, hi = (np.stack([f(near[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    heads = np.arange(0, len(leaves), 64)
    top_lo, top_hi = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads)

    def reached(a, b, los, his, most):
        gap = np.maximum(np.maximum(los - b, a - his), 0.0)
        gap *= gap
        return (gap[:, 0] + gap[:, 1]) + gap[:, 2] <= most

    out = np.empty((len(spots), k), dtype=np.int64)
    for i, rows in enumerate(leaves):
        own = near[rows]
        most = np.partition(squares(own, own), k - 1, axis=1)[:, k - 1].max()
        tops = np.flatnonzero(reached(lo[i], hi[i], top_lo, top_hi, most))
        among = (tops[:, None] * 64 + np.arange(64)).reshape(-1)
        among = among[among < len(leaves)]
        among = among[reached(lo[i], hi[i], lo[among], hi[among], most)]
        those = np.sort(np.concatenate([leaves[j] for j in among]))
        step = max(1, HELD // len(those))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            out[spot[kept[part]]] = kept[those[_least(squares(near[part], near[those]), k)]]
    return out[spot]


@np.errstate(all="ignore")
def nearest_rows(place: np.ndarray, known: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """(len(asked), k): the k nearest rows of each asked row among all, itself included, in any order; ties to the earlier row.

    place (n, 3), n >= k; known: no coordinate is null. Exact for any density: distances are compared as squares() gives
    them. A distance that is no number comes after all numbers, one from or to an unknown place after those.
    """
    sound = known & np.isfinite(place).all(1)
    if sound.all() and np.abs(place).max() < HUGE:
        if len(place) <= FEW:
            return _all_pairs(place, asked, k)
        return _by_boxes(place, k)[asked]
    out, rows = np.empty((len(asked), k), dtype=np.int64), np.flatnonzero(sound)
    # where a square may overflow, a number's distance can be as large as one to an infinite place
    plain = sound[asked] & (len(rows) >= k) & (np.abs(place[rows]).max(initial=0.0) < HUGE)
    if plain.any():
        out[plain] = rows[nearest_rows(place[rows], known[rows], np.searchsorted(rows, asked[plain]), k)]
    for i in np.flatnonzero(~plain):
        out[i] = ranked(place, known, asked[i : i + 1], k)
    return out


@np.errstate(all="ignore")
def ranked(place: np.ndarray, known: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """(k,): the rows of the k least distances from any of the asked rows; a row counts once for each of them."""
    d = squares(place[asked], place)
    lost = ~(known[asked][:, None] & known[None, :])
    n = np.tile(np.arange(len(place)), len(asked))
    return n[np.lexsort((n, d.reshape(-1), lost.reshape(-1)))[:k]]
