"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Every vector is scaled to length 1 and rounded to 8-bit integers with a scale of its own; the length of what rounding lost is
kept. For unit vectors x = s q + e and y = t r + f, the exact cosine differs from s t (q . r) by at most
|e| |t r| + |s q| |f| + |e| |f|, whatever the vectors are. Tiles of vectors are multiplied in small integers; only pairs whose bound reaches the
threshold are computed again in double precision from the vectors as they are stored.

Only vectors with the same label meet. Identical vectors of a label are one class first. A label's classes are dealt by a hash to slices of
bounded size, a slice is split into cells of neighbours (tiles), and two tiles meet only if the distance of their centres, less
their radii, allows a pair above the threshold: that loses nothing, by the triangle inequality. A hot label is so many tiles,
not one task. Tiles are quantised once and only their small integers travel to be multiplied; the vectors as they are stored follow for those
pairs of tiles that hold a pair which may reach the threshold. A pair of tiles answers with a row for each class that has links in
it, the number of its partners and the smallest class it leads to, and not with a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written
from sparkloom.llm.components import Forest, components

#: What float arithmetic may add to any bound here; cosines near the threshold within it are computed exactly.
SLACK = 1e-6


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length 1 as (int8 rows, scales, lengths of the rounding errors)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """(i, j) of all pairs that may reach the threshold. The products are exact: at most 127 * 127 * dimensions, below 2 ** 24 for up to 1,000."""
    (q, s, e), (r, t, f) = a, b
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (q.astype(kind) @ r.astype(kind).T) * s[:, None] * t
    bound = e[:, None] * (1 + f) + (1 + e[:, None]) * f + e[:, None] * f + SLACK
    return np.argwhere(product + bound >= threshold)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, from the vectors as they are stored."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in column]) if len(column) else np.zeros((0, 1))


def _stored(column: pa.Array) -> list[bytes | None]:
    """Lists of numbers as little-endian doubles, each scaled by a power of two so that its largest component lies between 0.5 and 1 (no
    cosine changes by that); None for those that are null, zero or hold null or non-finite components."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype("<f8", copy=False)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    fine = lengths > 0
    if fine.any():
        top = np.maximum.reduceat(np.abs(flat), starts[fine])  # not finite where a component isn't
        fine[fine] = np.isfinite(top) & (top > 0)
        scale = np.zeros(len(lengths), np.int64)
        scale[lengths > 0] = np.frexp(np.where(np.isfinite(top), top, 0))[1]
        flat = np.ldexp(flat, -np.repeat(scale, lengths)) + 0.0  # and -0.0 is 0.0
    data = flat.tobytes()
    return [data[8 * a : 8 * b] if ok else None for a, b, ok in zip(starts, ends, fine, strict=True)]


def classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, alone): a class is one vector (up to a power of two) of one label, with a name of its own.

    members has vec_id and class_id of every row that can link, classes the class's vector, smallest vec_id and number of rows, alone
    the vec_id of rows that link with nothing: those without id or label, and vectors that are null, zero or hold null or non-finite
    components. Rows with the same id are rows of their own, in one class or in several. Vectors of unlike length are never compared.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_stored(batch.column(2)), pa.binary())], names=["vec_id", "label", "v"])

    named = [vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label")]
    able = vectors[id_col].isNotNull() & vectors[label_col].isNotNull()
    rows = vectors.select(*named, F.when(able, vectors[vector_col]).alias("v")).mapInArrow(packed, "vec_id long, label string, v binary")
    rows = written(rows.withColumn("hash", F.sha2("v", 256)), "vectors")
    there = rows.filter("hash is not null")
    found = there.groupBy("label", "hash").agg(F.min("vec_id").alias("first_id"), F.first("v").alias("v"), F.count("*").alias("copies"))
    found = written(found.withColumn("class_id", F.monotonically_increasing_id()), "classes")  # a number, fixed by being written
    members = written(there.join(found.select("label", "hash", "class_id"), ["label", "hash"]).select("vec_id", "class_id"), "members")
    alone = written(rows.filter("hash is null").select("vec_id"), "alone")
    discard(rows)
    return members, found, alone


def _tiles(rows: DataFrame, tile: int, cells: int) -> DataFrame:
    """Tiles of the classes: label, dim, centre, radius; q, scales and errors of the unit vectors; ids, copies and vs of the vectors as they are."""
    dim = (F.length("v") / 8).cast("int")
    sizes = rows.groupBy("label", dim.alias("dim")).count()
    slices = F.greatest(F.lit(1), F.ceil(F.col("count") / tile))
    parts = rows.withColumn("dim", dim).join(sizes, ["label", "dim"])
    dealt = parts.withColumn("slice", F.pmod(F.xxhash64("class_id"), slices)).withColumn("k", F.least(F.lit(cells), slices))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        """A slice's vectors in tiles: neighbours of the direction that splits best come together, by repeated halving."""
        stored = _matrix(pdf["v"])
        x = stored / np.linalg.norm(stored, axis=1, keepdims=True)
        groups, done = [np.arange(len(x))], []
        least = max(32, len(x) // max(1, int(pdf["k"].iloc[0])))
        while groups:
            g = groups.pop()
            if len(g) <= least:
                done.append(g)
                continue
            y = x[g] - x[g].mean(axis=0)
            direction = np.ones(y.shape[1])
            for _ in range(5):
                direction = y.T @ (y @ direction)
                direction /= np.linalg.norm(direction) or 1
            order = np.argsort(y @ direction, kind="stable")
            groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        out, ids, copies = [], pdf["class_id"].to_numpy(), pdf["copies"].to_numpy()
        for g in done:
            centre = x[g].mean(axis=0)
            small = [a.tobytes() for a in quantised(x[g])]
            out.append((pdf["label"].iloc[0], int(pdf["dim"].iloc[0]), centre.astype("<f8").tobytes(), float(np.linalg.norm(x[g] - centre, axis=1).max()), *small, ids[g].tobytes(), copies[g].tobytes(), stored[g].tobytes()))
        return pd.DataFrame(out, columns=["label", "dim", "centre", "radius", "q", "scales", "errors", "ids", "copies", "vs"])

    kind = "label string, dim int, centre binary, radius double, q binary, scales binary, errors binary, ids binary, copies binary, vs binary"
    return dealt.groupBy("label", "dim", "slice").applyInPandas(split, kind).withColumn("tile", F.monotonically_increasing_id())


def _partners(tiles: DataFrame, threshold: float) -> DataFrame:
    """(class_id, partners, root): for each pair of tiles the classes with links in it, how many vectors they link with there, and the smallest class they lead to."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK  # the largest distance of two linked unit vectors

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                apart = [np.linalg.norm(np.frombuffer(a) - np.frombuffer(b)) - r - s for a, b, r, s in zip(pdf["centre"], pdf["centre_b"], pdf["radius"], pdf["radius_b"], strict=True)]
                yield pdf[np.array(apart) <= reach][["tile", "tile_b"]]

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of tiles with the places of the pairs that may reach the threshold, by the small integers."""
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                x, y = ((np.frombuffer(q, np.int8).reshape(-1, row.dim), np.frombuffer(s), np.frombuffer(e)) for q, s, e in ((row.q, row.scales, row.errors), (row.q_b, row.scales_b, row.errors_b)))
                at = possible(x, y, threshold)
                if row.tile == row.tile_b:
                    at = at[at[:, 0] < at[:, 1]]
                if len(at):
                    rows.append((row.tile, row.tile_b, at.astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["tile", "tile_b", "places"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                x, y = (np.frombuffer(v, "<f8").reshape(-1, row.dim) for v in (row.vs, row.vs_b))
                (i, n), (j, m) = ((np.frombuffer(a, "<i8"), np.frombuffer(c, "<i8")) for a, c in ((row.ids, row.copies), (row.ids_b, row.copies_b)))
                at = np.frombuffer(row.places, "<i4").reshape(-1, 2)
                at = at[cosines(x[at[:, 0]], y[at[:, 1]]) >= threshold]
                forest = Forest()
                for a, b in at.tolist():
                    forest.join(int(i[a]), int(j[b]))
                ends = np.concatenate([i[at[:, 0]], j[at[:, 1]]])
                names, place = np.unique(ends, return_inverse=True)
                count = np.bincount(place, np.concatenate([m[at[:, 1]], n[at[:, 0]]]), len(names)).astype(np.int64)
                rows += [(name, c, forest.find(name)) for name, c in zip(names.tolist(), count.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["class_id", "partners", "root"])

    def second(columns: list[str]) -> DataFrame:
        return tiles.select(F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in columns])

    heads = tiles.select("label", "dim", "tile", "centre", "radius")
    others = heads.select("label", "dim", F.col("tile").alias("tile_b"), F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b"))
    meet = heads.join(others, ["label", "dim"]).filter("tile <= tile_b").mapInPandas(near, "tile long, tile_b long")
    small, whole = ["q", "scales", "errors"], ["ids", "copies", "vs"]
    met = meet.join(tiles.select("tile", "dim", *small), "tile").join(second(small), "tile_b")
    screened = written(met.mapInPandas(screen, "tile long, tile_b long, places binary"), "screened")
    again = screened.join(tiles.select("tile", "dim", *whole), "tile").join(second(whole), "tile_b")
    found = written(again.mapInPandas(exact, "class_id long, partners long, root long"), "partners")
    discard(screened)
    return found


def dedup(vectors: DataFrame, *, threshold: float = 0.98, tile: int = 1024, cells: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links (other rows linked directly), component_id, kept (vec_id = component_id).

    A row that can't link has no links and is its own component; with a null id its component is null and kept is false. Repeated rows
    link with each other. An empty table gives no rows; other columns aren't read. `cells` bounds the tiles of a slice of `tile` vectors.
    """
    members, found, alone = classes(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    tiles = written(_tiles(found, tile, cells), "tiles")
    links = _partners(tiles, threshold)
    discard(tiles)
    partners = links.groupBy("class_id").agg(F.sum("partners").alias("partners"))
    reached = components(links, "class_id", "root").toDF("class_id", "root")
    per_class = found.select("class_id", "first_id", "copies").join(partners, "class_id", "left").join(reached, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = per_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = per_class.join(least, "root").select("class_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "component_id")
    linked = members.join(per_class, "class_id").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
