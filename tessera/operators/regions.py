"""Grid operators on one image's boxes, in Arrow batches: clusters, free areas and coverage.

An image's boxes are one row, so images are independent and nothing is shuffled here.
Boxes are int arrays ``[x1, y1, x2, y2]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOXES = "array<array<long>>"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that no more than those are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def painted(boxes, height: int, width: int) -> np.ndarray:
    """Pixels in any box; left and top edges belong to it, right and bottom ones do not."""
    grid = np.zeros((height, width), dtype=bool)
    for x1, y1, x2, y2 in boxes:
        grid[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)] = True
    return grid


def coverage(boxes, height: int, width: int) -> tuple[int, int]:
    """Covered pixels, and the sum of box areas; 0, 0 if nothing is covered."""
    boxes = np.asarray(boxes, dtype=np.int64).reshape(-1, 4)
    covered = int(painted(boxes, height, width).sum())
    total = int(((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).sum())
    return (covered, total) if covered else (0, 0)


def shrunk(grid: np.ndarray, scale: int) -> np.ndarray:
    """Cells of ``scale`` squared pixels, set where half of their pixels are; rest rows and columns go."""
    h, w = grid.shape[0] // scale, grid.shape[1] // scale
    ones = grid[: h * scale, : w * scale].reshape(h, scale, w, scale).sum(axis=(1, 3))
    return ones >= scale * scale / 2


def largest_rectangle(grid: np.ndarray) -> tuple[int, list[int]]:
    """Area and inclusive ``[x1, y1, x2, y2]`` of the largest all-set rectangle; 0 and zeros if none.

    Of equal areas the one with the smallest right column, then the smallest bottom row
    at which it is complete, wins. Each column takes runs to its left and a stack of rows.
    """
    grid = np.asarray(grid, dtype=bool)
    best, found = 0, [0, 0, 0, 0]
    if not grid.size:
        return best, found
    run = np.zeros(grid.shape[0], dtype=np.int64)
    for x in range(grid.shape[1]):
        run = np.where(grid[:, x], run + 1, 0)
        stack: list[tuple[int, int]] = []  # first row and width of growing rectangles
        for y, width in enumerate([*run.tolist(), 0]):
            top = y
            while stack and stack[-1][1] >= width:
                top, wide = stack.pop()
                area = wide * (y - top)
                if area > best:
                    best, found = area, [x - wide + 1, top, x, y - 1]
            stack.append((top, width))
    return best, found


def residual(big, kept: list, scale: int = 4, least: float = 0.3, most: int = 2) -> list[list[int]]:
    """Up to ``most`` rectangles of ``big`` that no kept box covers, largest first.

    The free pixels are shrunk to cells once; all shares are shares of cells. Ends when
    under ``least`` of the cells is free, or the found rectangle is under ``least`` of
    them. The inclusive ends of a rectangle are taken as open ones.
    """
    x1, y1, x2, y2 = (int(v) for v in big)
    cells = shrunk(~painted([[a - x1, b - y1, c - x1, d - y1] for a, b, c, d in kept], max(y2 - y1, 0), max(x2 - x1, 0)), scale)
    found = []
    for _ in range(most):
        if not cells.size or cells.sum() / cells.size < least:
            break
        _, (a, b, c, d) = largest_rectangle(cells)
        cells[b:d, a:c] = False
        if (c - a) * (d - b) / cells.size < least:
            break
        found.append([a * scale + x1, b * scale + y1, c * scale + x1, d * scale + y1])
    return found


def clusters(boxes: np.ndarray, k: int = 10, restarts: int = 10, seed: int = 0, rounds: int = 300) -> np.ndarray:
    """Cluster of each box by k-means over corners and centre, the best of some restarts."""
    boxes = np.asarray(boxes, dtype=np.float64).reshape(-1, 4)
    x = np.c_[boxes, (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2]
    k = min(k, len(x))
    if not k:
        return np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng(seed)
    far = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    best, out = np.inf, np.zeros(len(x), dtype=np.int64)
    for _ in range(restarts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = far(centres).min(axis=1)
            at = rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))
            centres = np.r_[centres, x[[at]]]
        for _ in range(rounds):
            own = far(centres).argmin(axis=1)
            new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        d = far(centres)
        own, cost = d.argmin(axis=1), d.min(axis=1).sum()
        if cost < best - 1e-9:
            best, out = cost, own
    return out


def hulls(boxes: np.ndarray, own: np.ndarray) -> list[list[int]]:
    """Enclosing box of each cluster."""
    out = []
    for j in np.unique(own):
        b = boxes[own == j]
        out.append([int(b[:, 0].min()), int(b[:, 1].min()), int(b[:, 2].max()), int(b[:, 3].max())])
    return out


def lead(boxes, overlap: float = 0.0, penalty: float = 0.1) -> list[list[int]]:
    """Leader merge by rising area, as in functions.geometry.merged."""
    b = np.asarray(boxes, dtype=np.float64).reshape(-1, 4)
    order = np.argsort((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), kind="stable")
    seeds, groups = [], []
    for i in order:
        for seed, group in zip(seeds, groups):
            w = max(0.0, min(seed[2], b[i, 2]) - max(seed[0], b[i, 0]))
            h = max(0.0, min(seed[3], b[i, 3]) - max(seed[1], b[i, 1]))
            size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
            whole = (max(seed[2], b[i, 2]) - min(seed[0], b[i, 0])) * (max(seed[3], b[i, 3]) - min(seed[1], b[i, 1]))
            joint = size(seed) + size(b[i]) - w * h
            if not whole or not joint:
                continue
            waste = (whole - joint) / whole
            if w * h / joint - waste > overlap or waste < penalty:
                group.append(i)
                break
        else:
            seeds.append(b[i])
            groups.append([i])
    return [[int(b[g, 0].min()), int(b[g, 1].min()), int(b[g, 2].max()), int(b[g, 3].max())] for g in groups]


def cropped(boxes, height: int, width: int, top: int = 3, k: int = 10) -> dict:
    """Cluster hulls, merged hulls, and the final boxes: merged ones but the ``top`` largest,
    which give way to their residual rectangles."""
    b = np.asarray(boxes, dtype=np.int64).reshape(-1, 4)
    share = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) / max(1, height * width)
    b = b[(share >= 0.001) & (share <= 0.9)]
    first = hulls(b, clusters(b, k))
    second = lead(first)
    order = sorted(second, key=lambda r: -(r[2] - r[0]) * (r[3] - r[1]))
    kept = [list(r) for r in order[top:]]
    for big in order[:top]:
        kept += residual(big, kept)
    return {"centers": first, "merged": second, "cropped": kept}


def crop_regions(images: DataFrame, boxes: str = "boxes", hw: str = "hw", top: int = 3, k: int = 10) -> DataFrame:
    """``images`` with ``centers``, ``merged`` and ``cropped`` boxes; null boxes or sizes give empty lists."""
    names = [c for c in images.columns if c not in (boxes, hw)]
    rows = images.select(*names, boxes, hw)
    made = ("centers", "merged", "cropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = []
            for b, size in zip(part.column(boxes).to_pylist(), part.column(hw).to_pylist()):
                ok = b is not None and size is not None and len(b)
                got.append(cropped(b, int(size[0]), int(size[1]), top, k) if ok else dict.fromkeys(made, []))
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([m[c] for m in got], kind) for c in made)], [*names, *made])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), *(f"{c} {BOXES}" for c in made)])
    return rows.mapInArrow(run, schema)


def coverage_table(images: DataFrame, height: int, width: int, boxes: str = "boxes") -> DataFrame:
    """``(image, n_boxes, covered, total_area)`` of arrays of box arrays."""

    def run(batches):
        for part in slices(batches):
            some = part.column(boxes).to_pylist()
            n, got = [len(b) for b in some], [coverage(b, height, width) for b in some]
            made = [pa.array(v, pa.int64()) for v in (n, [g[0] for g in got], [g[1] for g in got])]
            yield pa.RecordBatch.from_arrays([part.column("image"), *made], ["image", "n_boxes", "covered", "total_area"])

    return images.select(F.col("image").cast("long").alias("image"), boxes).mapInArrow(run, "image long, n_boxes long, covered long, total_area long")


def area_report(boxes: DataFrame) -> DataFrame:
    """Number and exact quantiles (10, 30, 50, 70, 90 %) of the areas of rows with a box ``b``."""
    from tessera.functions.geometry import area

    qs = F.array(*[F.lit(q) for q in (0.1, 0.3, 0.5, 0.7, 0.9)])
    return boxes.select(area(F.col("b")).cast("double").alias("area")).agg(F.count("area").alias("n_boxes"), F.percentile("area", qs).alias("area_q"))


def spread_centres(points, k: int, seed: int = 0) -> list[int]:
    """Places of ``k`` points: a random one, then each drawn with the distance to the nearest so far as its weight."""
    x = np.asarray(points, dtype=np.float64)
    rng = np.random.default_rng(seed)
    out = [int(rng.integers(len(x)))] if len(x) and k else []
    while 0 < len(out) < min(k, len(x)):
        d = np.sqrt(((x[:, None] - x[out][None]) ** 2).sum(axis=2)).min(axis=1)
        out.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() else int(np.setdiff1d(np.arange(len(x)), out)[0]))
    return out


def run_lengths(mask: np.ndarray) -> list[int]:
    """Lengths of the runs of a mask read column by column, a run of unset pixels (0 if none) first."""
    flat = np.asarray(mask, dtype=bool).ravel(order="F")
    ends = np.flatnonzero(np.r_[flat[1:] != flat[:-1], True]) + 1 if flat.size else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[0, ends]).tolist()
    return [0, *lengths] if flat.size and flat[0] else lengths


def from_run_lengths(lengths: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)
    return flat.reshape(height, width, order="F")


def box_report(coverages: DataFrame, pixels: int) -> DataFrame:
    """Means and exact quantiles (10, 30, 50, 70, 90 %) of box count, coverage and overlap over images that have any."""
    some = coverages.where("covered > 0")
    some = some.select(F.col("n_boxes").cast("double").alias("count"), (F.col("covered") / pixels).alias("coverage"), (F.col("total_area") / F.col("covered")).alias("overlap"))
    qs = F.array(*[F.lit(q) for q in (0.1, 0.3, 0.5, 0.7, 0.9)])
    return some.agg(F.count("*").alias("n_images"), *[x for c in ("count", "coverage", "overlap") for x in (F.avg(c).alias(f"{c}_mean"), F.percentile(c, qs).alias(f"{c}_q"))])
