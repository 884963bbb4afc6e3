"""Cosines of many vectors with many others, block by block, and exact statistics of scores that are never kept.

Both sides are dealt to blocks, as many as their rows ask for; a task multiplies one block of each as matrices and keeps
sums by group, or a histogram, or the scores in given bins. No pair of vectors is a row of any plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.steps import cut

#: Rows of a block, rows that are multiplied at once, and bins of a histogram of cosines.
BLOCK, SLAB, BINS = 8192, 512, 16384


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of unit length; shorter vectors are filled up with zeros, zero vectors stay."""
    lists = column.combine_chunks()
    lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), max(width or 0, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms == 0, 1.0, norms)[:, None]


def products(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of all rows of ``left`` with all of ``right``, some rows at a time, each with the number of its first row."""
    a, b = matrix(left["vec"]), matrix(right["vec"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    for at in range(0, len(a), SLAB):
        yield at, a[at : at + SLAB] @ b.T


def bin_of(score):
    """Bin of a cosine, as a column or an array."""
    if isinstance(score, Column):
        return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((score + 1) * (BINS // 2)))).cast("int")
    return np.clip(np.floor((score + 1) * (BINS // 2)), 0, BINS - 1).astype(np.int64)


def blocked(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, right_by: tuple[str, ...] = ()) -> DataFrame:
    """``run`` on every block of ``left`` with every block of ``right``.

    Both are written once, as they are counted first. Rows of a group ``right_by`` share a block as long as a block holds them; larger groups are parted. Blocks hold about
    ``BLOCK`` rows each, so tasks grow with both sides.
    """
    same = left is right
    left = left if hasattr(left, "_parley_path") else cut(left, "side")
    right = left if same else right if hasattr(right, "_parley_path") else cut(right, "side")
    n = left.count()
    m = n if same else right.count()
    rows, columns = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    if right_by:
        size = right.groupBy(*[F.col(c).alias(f"_{c}") for c in right_by]).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in right_by]
        right = right.join(size, on).withColumn("_col", F.pmod(F.xxhash64(*right_by, F.pmod(F.xxhash64("seq"), F.col("_parts"))), F.lit(columns)))
    else:
        right = right.withColumn("_col", F.pmod(F.xxhash64("seq"), F.lit(columns)))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    a = left.withColumn("_row", F.pmod(F.monotonically_increasing_id(), F.lit(rows))).withColumn("_col", every(columns))
    b = right.withColumn("_row", every(rows))
    a, b = a.toDF(*a.columns), b.toDF(*b.columns)  # sides of one table are told apart
    return a.groupBy("_row", "_col").cogroup(b.groupBy("_row", "_col")).applyInArrow(lambda x, y: run(x, y), schema)


SUMS = "person string, group_lang string, total double, n long, best double, best_seq long, top_ref string"


def group_sums(left: pa.Table, right: pa.Table, key: dict[str, str]) -> pa.Table:
    """Of each row of ``left`` and each group (person, lang) of ``right``: sum and number of its cosines, the best and whose it is.

    ``key``: names of the result and the columns of ``left`` they are. An entry (seq) is no pair with itself if ``left`` has a seq.
    """
    right = right.sort_by([("person", "ascending"), ("lang", "ascending"), ("seq", "ascending")])
    names = list(zip(right["person"].to_pylist(), right["lang"].to_pylist(), strict=True))
    starts = np.array([i for i, x in enumerate(names) if i == 0 or x != names[i - 1]], dtype=np.int64)
    ends = np.append(starts[1:], len(names))
    seqs = right["seq"].to_numpy()
    own = left["seq"].to_numpy() if "seq" in left.column_names else None
    found = {k: [] for k in ("i", "g", "total", "n", "best", "at")}
    if len(names) and left.num_rows:
        for at, cos in products(left, right):
            same = None if own is None else own[at : at + len(cos)][:, None] == seqs[None, :]
            if same is not None:
                cos = np.where(same, 0.0, cos)
            total, n = np.add.reduceat(cos, starts, axis=1), np.broadcast_to(ends - starts, (len(cos), len(starts)))
            if same is not None:
                n = n - np.add.reduceat(same.astype(np.int64), starts, axis=1)
                cos = np.where(same, -np.inf, cos)
            first = np.stack([s + cos[:, s:e].argmax(axis=1) for s, e in zip(starts, ends, strict=True)], axis=1)
            i, g = np.nonzero(n > 0)
            for k, v in (("i", at + i), ("g", g), ("total", total[i, g]), ("n", n[i, g]), ("at", first[i, g]), ("best", cos[i, first[i, g]])):
                found[k].append(v)
    got = {k: np.concatenate(v) if v else np.zeros(0) for k, v in found.items()}
    of = starts[got["g"].astype(np.int64)]
    columns = [left[k].take(pa.array(got["i"].astype(np.int64))) for k in key.values()]
    columns += [right["person"].take(pa.array(of)), right["lang"].take(pa.array(of))]
    columns += [pa.array(got["total"]), pa.array(got["n"].astype(np.int64)), pa.array(got["best"]), pa.array(seqs[got["at"].astype(np.int64)]), right["ref_path"].take(pa.array(got["at"].astype(np.int64)))]
    return pa.table(columns, names=[*key, "person", "group_lang", "total", "n", "best", "best_seq", "top_ref"])


def _impostors(left: pa.Table, right: pa.Table) -> Iterator[tuple[object, object, np.ndarray]]:
    """Cosines of pairs of different people, each pair once, by the two languages."""
    if not (left.num_rows and right.num_rows):
        return
    left, right = left.sort_by([("lang", "ascending"), ("seq", "ascending")]), right.sort_by([("lang", "ascending"), ("seq", "ascending")])
    la, lb = np.array(left["lang"].to_pylist(), dtype=object), np.array(right["lang"].to_pylist(), dtype=object)
    names = np.unique(np.array([*left["person"].to_pylist(), *right["person"].to_pylist()], dtype=str), return_inverse=True)[1]
    pa_, pb = names[: left.num_rows], names[left.num_rows :]
    rows, columns = list(dict.fromkeys(la.tolist())), list(dict.fromkeys(lb.tolist()))
    for at, cos in products(left, right):
        part = slice(at, at + len(cos))
        less = pa_[part][:, None] < pb[None, :]
        for x in rows:
            for y in columns:
                mask = less & (la[part] == x)[:, None] & (lb == y)[None, :]
                if mask.any():
                    yield x, y, cos[mask]


def impostor_bins(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many scores of each two languages fall into each bin, and the greatest."""
    bins: dict[tuple, np.ndarray] = {}
    most: dict[tuple, float] = {}
    for x, y, scores in _impostors(left, right):
        bins[x, y] = bins.get((x, y), 0) + np.bincount(bin_of(scores), minlength=BINS)
        most[x, y] = max(most.get((x, y), -2.0), float(scores.max()))
    rows = [(x, y, int(b), int(n[b]), most[x, y]) for (x, y), n in bins.items() for b in np.nonzero(n)[0]]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["la", "lb", "bin", "n", "most"])


def impostor_scores(wanted: dict[tuple, list[int]], null_is_language: bool = True) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores, with how often they occur, of the wanted bins of (language, crossing or not); ``null_is_language`` as in ``voice.calibrate``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for x, y, scores in _impostors(left, right):
            at = bin_of(scores)
            once = x == y or not null_is_language and (x is None or y is None)
            for lang, cross in [(x, False)] if once else [(x, True), (y, True)]:
                if found := wanted.get((lang, cross)):
                    values, n = np.unique(scores[np.isin(at, found)], return_counts=True)
                    rows += [(lang, cross, float(v), int(k)) for v, k in zip(values, n, strict=True)]
        kinds = [pa.string(), pa.bool_(), pa.float64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "cross", "score", "n"])

    return run


PAIRED = f"kind string, seq long, own string, la string, {SUMS}, lb string, bin int, most double"


def sums_and_bins(left: pa.Table, right: pa.Table) -> pa.Table:
    """``group_sums`` of entries with entries, and ``impostor_bins``, from one reading of the blocks."""
    sums, bins = group_sums(left, right, {"seq": "seq", "own": "person", "la": "lang"}), impostor_bins(left, right)
    both = pa.concat_tables([sums.append_column("kind", pa.array(["sum"] * sums.num_rows, pa.string())), bins.append_column("kind", pa.array(["bin"] * bins.num_rows, pa.string()))], promote_options="default")
    return both.select([x.split(" ")[0] for x in PAIRED.split(", ")])
