"""Shape of volumes: exposed faces, voxel volume, principal axes and hull."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS, K, finished, of, on, run, with_rows
from roiforge.operators.geometry import hull as flat_hull

SURFACE = ("3AREA", "3VOXEL_VOLUME")
SHAPE3 = (
    "3AREA", "3AREA_2_VOLUME", "3COMPACTNESS1", "3COMPACTNESS2", "3MESH_VOLUME", "3SPHERICAL_DISPROPORTION", "3SPHERICITY", "3VOLUME_CONVEXHULL", "3VOXEL_VOLUME", "3MAJOR_AXIS_LEN", "3MINOR_AXIS_LEN", "3LEAST_AXIS_LEN", "3ELONGATION", "3FLATNESS",
)
_SIX = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def surface_sql(dialect: str = "spark") -> str:
    """Faces of voxels that no voxel of the region covers, and the voxels' volume."""
    shifted = with_rows("px", "p", _SIX, ("dx", "dy", "dz"), dialect)
    inner = f"""WITH px AS (SELECT DISTINCT {K}, x, y, z FROM {{pixels}}),
s AS (SELECT {K}, x + dx AS x, y + dy AS y, z + dz AS z FROM {shifted}),
n AS (SELECT {K}, count(*) AS n FROM px GROUP BY {K}),
covered AS (SELECT {of("s")}, count(*) AS k FROM s JOIN px ON {on("s", "px", ["x", "y", "z"])} GROUP BY {of("s")})
SELECT {of("n")}, 6 * n - coalesce(k, 0) AS area, n * (pi() / 6e0) / 0.5236e0 AS volume FROM n LEFT JOIN covered ON {on("n", "covered")}"""
    return finished(inner, [("area", "3AREA"), ("volume", "3VOXEL_VOLUME")], dialect)


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull, by an incremental hull with outward faces; 0 for points in one plane."""
    points = np.unique(points.astype(float), axis=0)
    if len(points) < 4:
        return 0.0
    a = points[0]
    b = points[np.argmax(((points - a) ** 2).sum(1))]
    line = np.linalg.norm(np.cross(points - a, b - a), axis=1)
    c = points[np.argmax(line)]
    normal = np.cross(b - a, c - a)
    height = (points - a) @ normal
    d = points[np.argmax(np.abs(height))]
    if line.max() < 1e-9 or np.abs(height).max() < 1e-9:
        return 0.0
    inner = (a + b + c + d) / 4

    def outward(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Faces (k, 3, 3) turned so that their normals point away from the middle, and the normals."""
        normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
        inward = ((corners[:, 0] - inner) * normal).sum(1) < 0
        corners[inward] = corners[inward][:, ::-1]
        normal[inward] *= -1
        return corners, normal

    faces, normals = outward(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))
    for x in points:
        seen = ((x - faces[:, 0]) * normals).sum(1) > 1e-9
        if not seen.any():
            continue
        # the horizon: edges of seen faces whose reverse belongs to no seen face
        edges = {(tuple(f[i]), tuple(f[(i + 1) % 3])) for f in faces[seen].tolist() for i in range(3)}
        rim = [(u, v, x) for u, v in edges if (v, u) not in edges]
        new, turned = outward(np.array(rim))
        faces, normals = np.concatenate([faces[~seen], new]), np.concatenate([normals[~seen], turned])
    return float(((faces[:, 0] - inner) * np.cross(faces[:, 1] - inner, faces[:, 2] - inner)).sum()) / 6


def shape3(pixels: DataFrame) -> DataFrame:
    """The 14 shape features of volumes. Faces are a relation; axes follow from sums along rows of voxels and the hull from rows' ends, so a task gets a region's rows."""
    voxels = pixels.select(*KEYS, "x", "y", "z").distinct()
    rows = voxels.groupBy(*KEYS, "y", "z").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        y, z, lo, hi, n, sx, sxx = (table.column(c).to_numpy() for c in ("y", "z", "lo", "hi", "n", "sx", "sxx"))
        ends = np.concatenate([np.stack([lo, y, z], 1), np.stack([hi, y, z], 1)])
        # only a slice's own corners can be the hull's
        hull = hull_volume(np.array([(*c, k) for k in np.unique(z) for c in flat_hull(ends[ends[:, 2] == k, :2])]))
        total = n.sum()
        mx, my, mz = sx.sum() / total, (n * y).sum() / total, (n * z).sum() / total
        # about the means; along x a row's own sums stand for its voxels
        dx, dy, dz = sx - n * mx, y - my, z - mz
        xx = (sxx - 2 * mx * sx + n * mx * mx).sum()
        moments = np.array([[xx, (dx * dy).sum(), (dx * dz).sum()], [0, (n * dy * dy).sum(), (n * dy * dz).sum()], [0, 0, (n * dz * dz).sum()]])
        axes = np.sort(np.linalg.eigvalsh(np.triu(moments).T / (total - 1)))[::-1].clip(0) if total > 1 else np.zeros(3)
        return pa.table({**{k: [v.as_py()] for k, v in zip(KEYS, key, strict=True)}, "hull": [float(hull)], "axes": [axes.tolist()]})

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    solid = rows.groupBy(*KEYS).applyInArrow(one, ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), "hull double", "axes array<double>"]))
    both = run(voxels, surface_sql()).join(solid, list(KEYS))
    area, volume, axis = F.col("3AREA"), F.col("3VOXEL_VOLUME"), lambda k: F.get("axes", k)
    ratio = lambda u, v: F.coalesce(F.try_divide(u, v), F.lit(0.0))
    sphere = F.cbrt(36 * math.pi * volume * volume)
    values = [
        area, ratio(area, volume), ratio(volume, F.sqrt(math.pi * area * area * area)), ratio(36 * math.pi * volume * volume, area * area * area), F.col("hull"), ratio(area, sphere), ratio(sphere, area), F.col("hull"), volume,
        *(4 * F.sqrt(axis(k)) for k in range(3)), F.sqrt(ratio(axis(1), axis(0))), F.sqrt(ratio(axis(2), axis(0))),
    ]
    return both.select(*KEYS, *(v.alias(n) for v, n in zip(values, SHAPE3, strict=True)))
