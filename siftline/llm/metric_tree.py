"""Exact top-k search by inner product: a forest of paged M-trees, searched best first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import small_side, written

K = 20
#: Vectors of one tree, entries of one leaf page, queries of one block, trees that a task searches for a block.
TREE_ROWS = 1024
LEAF_ROWS = 64
QUERY_ROWS = 512
CHUNK_TREES = 16
#: Trees whose centres and radii are held against a block of queries at once.
DIRECTORY_TREES = 1024
#: Routing vectors that spread the rows over trees, rows for each that they are chosen from, and pilot rows that give a query its first bound.
MOST_ROUTERS = 256
ROUTER_SAMPLE = 8
PILOT_ROWS = 1024
#: Inner products of vectors whose lengths multiply to less than this are whole numbers that 64-bit floats hold exactly.
EXACT = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(rid, vec_id, v array<double>): every component x as floor(scale * x), x as double; whole numbers of any size.

    Rows take no part if their id or vector is null, or a component is null or not finite (also not once it is scaled).
    """
    x = F.col(vector_col)
    scaled = F.transform("x", lambda c: c.cast("double") * scale)
    fits = F.forall("s", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.withColumn("s", scaled).where(fits)
    # floor() gives a long; from 2^53 on a double has no fraction
    return rows.select("rid", "vec_id", F.transform("s", lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)).alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _packed(v: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the smallest type that holds it exactly, and its bytes."""
    size = np.abs(v).max(initial=0)
    kind = next((k for k, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if size <= most), "f8")
    return kind, v.astype(f"<{kind}").tobytes()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").reshape(-1, dim).astype(np.float64)


def _lift(v: np.ndarray, bound: float) -> np.ndarray:
    """v with one more component that gives every vector the same length: then the nearest to a query has the largest inner product."""
    return np.column_stack([v, np.sqrt(np.maximum(0, bound - (v * v).sum(1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def _units(v: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(v).max(1, initial=0), 1e-300)[:, None]
    v = v / top
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]


def _scores(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all rows as floats, and how far each may be off: 0 where it is exact."""
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
    return q @ v.T, np.where(size < EXACT, 0.0, size * (q.shape[1] + 2) * 2.0**-51)


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product of two vectors of whole numbers, within the range of a long."""
    return min(MOST, max(LEAST, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """n routing points, each the farthest from those before it; the first is the farthest from the mean."""
    far = np.linalg.norm(points - points.mean(0), axis=1)
    found = []
    for _ in range(n):
        found.append(int(far.argmax()))
        d = np.linalg.norm(points - points[found[-1]], axis=1)
        far = np.minimum(far, d) if len(found) > 1 else d
        if not far.max() > 0:
            break
    return np.array(found)


def build_tree(rid: np.ndarray, ids: np.ndarray, v: np.ndarray) -> dict:
    """One M-tree of two levels: leaf pages around routing vectors, and the tree's own centre above them.

    Kept are the largest squared length of its vectors (`bound`, which its distances depend on), the covering radius of the tree and
    of each page, and the distance of each page's router to the centre and of each entry to its router. Vectors whose squares are
    beyond 64-bit floats give radii that aren't numbers, which nothing is pruned by.
    """
    bound = float((v * v).sum(1).max())
    points = _lift(v, bound)
    centre = points[np.linalg.norm(points - points.mean(0), axis=1).argmin()]
    routers = points[_spread_out(points, max(1, len(points) // LEAF_ROWS))]
    d = _distances(points, routers)
    page = d.argmin(1)
    to_router = np.linalg.norm(points - routers[page], axis=1)
    order = np.lexsort((to_router, page))
    page, to_router = page[order], to_router[order]
    starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    routers = routers[page[starts]]
    to_centre = np.linalg.norm(points - centre, axis=1)
    return {
        "bound": bound, "centre": centre, "radius": float(to_centre.max()), "routers": routers, "pages": np.append(starts, len(page)),
        "page_radius": np.maximum.reduceat(to_router, starts), "page_parent": np.linalg.norm(routers - centre, axis=1),
        "entry_parent": to_router, "rid": rid[order], "id": ids[order], "v": v[order],
    }


_KIND = {"centre": np.float64, "routers": np.float64, "pages": np.int64, "page_radius": np.float64, "page_parent": np.float64, "entry_parent": np.float64, "rid": np.int64, "id": np.int64}
_TREE = "tree long, router long, bound double, radius double, kind string, v binary, asked binary, first binary, " + ", ".join(f"{k} binary" for k in _KIND)


def _unpack(row, dim: int) -> dict:
    tree = {k: np.frombuffer(getattr(row, k), kind) for k, kind in _KIND.items()} | {"radius": row.radius, "bound": row.bound}
    return tree | {"routers": tree["routers"].reshape(-1, dim + 1), "v": _unpacked(row.kind, row.v, dim)}


class _Best:
    """The k best (score, id) of each query of a block so far; ties go to the smaller id."""

    def __init__(self, k: int, norms: np.ndarray, first: np.ndarray):
        self.k, self.norms = k, norms
        self.q, self.score, self.id, self.rid = (np.zeros(0, np.int64) for _ in range(4))
        self.kth = first.copy()  # scores under it can't be among the best

    def limit(self, bound: float) -> np.ndarray:
        """The distance, in a tree of that bound, beyond which a point can't be among the best, with room for rounding."""
        far = np.sqrt(np.maximum(0, self.norms + bound - 2 * np.maximum(self.kth, -1e300)))
        return np.where(np.isneginf(self.kth), np.inf, far + 1e-6 * np.sqrt(self.norms + bound) + 1e-9)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        q, score, ids, rid = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.rid, rid)))
        order = np.lexsort((rid, ids, -np.maximum(score, 1 - MOST), q))
        q = q[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = rank < self.k
        self.q, self.score, self.id, self.rid = q[keep], score[order][keep], ids[order][keep], rid[order][keep]
        full = rank == self.k - 1
        least = score[order][full]
        low = np.where(least == LEAST, -np.inf, np.where(np.abs(least.astype(np.float64)) < EXACT, least, np.nextafter(least.astype(np.float64), -np.inf)))
        self.kth[q[full]] = np.maximum(self.kth[q[full]], low)


def search(trees: list[dict], q_rid: np.ndarray, q: np.ndarray, first: np.ndarray, k: int, counts: dict | None = None) -> _Best:
    """The k best of the trees' vectors for each query of a block, best trees and pages first.

    With t the distance of a query to its kth best so far, a tree or page of radius r is left out where
    its centre is farther than t + r; the distance to a page's router or to an entry isn't computed where the stored
    distance to its parent already shows this by the triangle inequality. What isn't a number prunes nothing. Scores that
    floats can't hold exactly are multiplied out in whole numbers.
    """
    best = _Best(k, (q * q).sum(1), first)
    lifted = np.column_stack([q, np.zeros(len(q))])
    to_tree = _distances(lifted, np.array([t["centre"] for t in trees]))
    low = to_tree - np.array([t["radius"] for t in trees])
    gain = np.array([np.sqrt(t["bound"]) for t in trees])  # trees of long vectors first, then near ones
    for t in np.lexsort((np.nan_to_num(low.min(0), nan=-np.inf), -np.round(np.log2(gain + 1)))):
        tree, own = trees[t], np.flatnonzero(~(low[:, t] > best.limit(trees[t]["bound"])))
        if not len(own):
            continue
        near = ~(np.abs(to_tree[own, t][:, None] - tree["page_parent"]) - tree["page_radius"] > best.limit(tree["bound"])[own][:, None])
        pages = np.flatnonzero(near.any(0))
        if not len(pages):
            continue
        d = _distances(lifted[own], tree["routers"][pages])
        floor = np.where(near[:, pages], d - tree["page_radius"][pages], np.inf)
        for j in np.argsort(floor.min(0), kind="stable"):
            limit = best.limit(tree["bound"])[own]
            left = np.flatnonzero(near[:, pages[j]] & ~(floor[:, j] > limit))
            if not len(left):
                continue
            a, b = tree["pages"][pages[j]], tree["pages"][pages[j] + 1]
            gap = ~(np.abs(d[left, j][:, None] - tree["entry_parent"][a:b]) > limit[left][:, None])
            cols = np.flatnonzero(gap.any(0))
            if not len(cols):
                continue
            score, off = _scores(q[own[left]], tree["v"][a:b][cols])
            if counts is not None:
                counts["scores"] = counts.get("scores", 0) + score.size
            good = gap[:, cols] & ~(score + off < best.kth[own[left]][:, None]) & (tree["rid"][a:b][cols] != q_rid[own[left]][:, None])
            i, c = np.nonzero(good)
            if len(i):
                sure = off[i, c] == 0
                exact = np.where(sure, score[i, c], 0).astype(np.int64)
                for n in np.flatnonzero(~sure).tolist():
                    exact[n] = _whole(q[own[left[i[n]]]], tree["v"][a:b][cols[c[n]]])
                best.add(own[left[i]], exact, tree["id"][a:b][cols[c]], tree["rid"][a:b][cols[c]])
    return best


def _forest(rows: DataFrame, known: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """known, which is rows(rid, vec_id, v, asked) with first -> one row for each tree of about TREE_ROWS vectors, with the queries among them.

    Rows go to the nearest in direction of at most MOST_ROUTERS routing vectors, which are far from each other among ROUTER_SAMPLE times as many rows (the first by a hash of their id), and to others of their
    largest component within a factor of four, so one very long vector widens no other's tree. They are dealt by hash over as many trees as
    they need, so a hot region or a repeated vector makes more trees, not a larger one. A tree is searched at once for its own queries,
    which gives them a better first bound.
    """
    wanted = min(MOST_ROUTERS, max(1, n // TREE_ROWS))
    found = _units(_matrix(rows.orderBy(F.xxhash64("vec_id"), "rid").limit(ROUTER_SAMPLE * wanted).toPandas()["v"], dim))
    routers = rows.sparkSession.sparkContext.broadcast(found[_spread_out(found, wanted)])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _matrix(b["v"], dim)
                yield b.assign(router=(_units(v) @ routers.value.T).argmax(1), band=np.frexp(np.abs(v).max(1, initial=0))[1].astype(np.int64) // 2)

    placed = written(known.mapInPandas(nearest, "rid long, vec_id long, v array<double>, asked boolean, first double, router long, band long"), "placed")
    parts = placed.groupBy("router", "band").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("parts"))
    dealt = placed.join(small_side(parts), ["router", "band"]).withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            v, rid = _matrix(pdf["v"], dim), pdf["rid"].to_numpy()
            tree = build_tree(rid, pdf["vec_id"].to_numpy(), v)
            asked = np.flatnonzero(pdf["asked"].to_numpy(bool))
            first = search([tree], rid[asked], v[asked], pdf["first"].to_numpy(float)[asked], k).kth if len(asked) else np.zeros(0)
        place = np.argsort(tree["rid"], kind="stable")
        kind, data = _packed(tree["v"])
        row = {"tree": (int(key[0]) << 12 | int(key[1]) + 2048) << 40 | int(key[2]), "router": int(key[0]), "bound": tree["bound"], "radius": tree["radius"], "kind": kind, "v": data}
        row |= {"asked": place[np.searchsorted(tree["rid"][place], rid[asked])].astype(np.int64).tobytes(), "first": first.tobytes()}
        row |= {k: np.ascontiguousarray(tree[k], kind).tobytes() for k, kind in _KIND.items()}
        return pd.DataFrame([row])[[c.split()[0] for c in _TREE.split(", ")]]

    return dealt.groupBy("router", "band", "part").applyInPandas(build, _TREE)


def _blocks(asked: list[tuple[int, int]], units: np.ndarray) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each router: routers are walked from each to the nearest one left, so that queries of near directions share blocks."""
    left, at, block, held, out = dict(asked), None, 0, 0, {}
    while left:
        at = min(left, key=lambda r: (-float(units[r] @ units[at]), r)) if at is not None else min(left)
        n = left.pop(at)
        if held and held + n > QUERY_ROWS:
            block, held = block + 1, 0
        out[at] = (block, -(-n // QUERY_ROWS))
        block, held = (block + out[at][1], 0) if n >= QUERY_ROWS else (block, held + n)
    return out


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k rows with the largest inner product for each query, ties to the smaller id.

    Vectors are quantised as quantised() says; is_query is a condition on `vec_id`. Candidates are all
    rows but the query's own row, so a repeated id can find its other row; fewer than k give fewer rows. No
    rows give no rows. Vectors of unequal lengths are filled up with zeros. Scores are exact; those outside the range of a long are its
    end, and tie there.

    The trees and the blocks of queries are rows. A block is first held against the trees' centres and radii, a few hundred bytes a
    tree; only trees that its queries' bounds don't rule out are sent to it, and every task searches some of them best first. Bounds come from
    PILOT_ROWS rows that every task holds and from the query's own tree.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col).withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    n, dim, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asked")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    pilot_rows = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "rid").limit(PILOT_ROWS).toPandas()
    pilot = spark.sparkContext.broadcast((pilot_rows["rid"].to_numpy(), _matrix(pilot_rows["v"], dim)))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p_rid, p = pilot.value
        for b in batches:
            first, at = np.full(len(b), -np.inf), np.flatnonzero(b["asked"].to_numpy(bool))
            if len(at) and len(p) > k:
                with np.errstate(all="ignore"):
                    score, off = _scores(_matrix(b["v"].iloc[at], dim), p)
                    score = np.where(b["rid"].to_numpy()[at, None] == p_rid, -np.inf, np.nan_to_num(score - off, nan=-np.inf))
                    first[at] = np.minimum(np.partition(score, len(p) - k, axis=1)[:, len(p) - k], float(MOST))
                    first[first <= float(LEAST)] = -np.inf
            yield b.assign(first=first)

    known = rows.mapInPandas(bounded, "rid long, vec_id long, v array<double>, asked boolean, first double")
    forest = written(_forest(rows, known, n, dim, k), "trees")
    n_trees = forest.count()
    chunks, pages = math.ceil(n_trees / CHUNK_TREES), math.ceil(n_trees / DIRECTORY_TREES)

    # The queries leave their trees, and are packed in blocks of near directions.
    by_router = forest.groupBy("router").agg((F.sum(F.octet_length("asked")) / 8).cast("long").alias("n")).where("n > 0").collect()  # at most MOST_ROUTERS rows
    centres = forest.groupBy("router").agg(F.min_by("centre", "tree").alias("centre")).toPandas()
    units = {int(r): _units(np.frombuffer(c, np.float64)[None, :dim])[0] for r, c in zip(centres["router"], centres["centre"], strict=True)}
    placing = _blocks([(r.router, r.n) for r in by_router], units)

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                at = np.frombuffer(row.asked, np.int64)
                rid, start_blocks = np.frombuffer(row.rid, np.int64)[at], placing[row.router]
                yield pd.DataFrame({"block": start_blocks[0] + rid % start_blocks[1], "q_rid": rid, "q_id": np.frombuffer(row.id, np.int64)[at], "q": list(_unpacked(row.kind, row.v, dim)[at]), "first": np.frombuffer(row.first)})

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, data = _packed(_matrix(pdf["q"], dim))
        return pd.DataFrame([{"block": int(key[0]), "q_rid": pdf["q_rid"].to_numpy().tobytes(), "q_id": pdf["q_id"].to_numpy().tobytes(), "q_kind": kind, "q": data, "q_first": pdf["first"].to_numpy().tobytes()}])

    left = forest.where("octet_length(asked) > 0").select("router", "kind", "v", "rid", "id", "asked", "first").mapInPandas(leave, "block long, q_rid long, q_id long, q array<double>, first double")
    packed = written(left.groupBy("block").applyInPandas(pack, "block long, q_rid binary, q_id binary, q_kind string, q binary, q_first binary"), "query_blocks")
    n_blocks = max((a + b for a, b in placing.values()), default=1)

    def candidates(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in a.itertuples(index=False) if len(b) else []:
            q = _unpacked(row.q_kind, row.q, dim)
            with np.errstate(all="ignore"):
                d = _distances(np.column_stack([q, np.zeros(len(q))]), np.array([np.frombuffer(c, np.float64) for c in b["centre"]]))
                best, bound = _Best(k, (q * q).sum(1), np.frombuffer(row.q_first)), b["bound"].to_numpy()
                far = np.column_stack([best.limit(x) for x in bound])
                keep = (~(d - b["radius"].to_numpy() > far)).any(0)
            out.append(pd.DataFrame({"block": row.block, "tree": b["tree"].to_numpy()[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"block": np.zeros(0, np.int64), "tree": np.zeros(0, np.int64)})

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    directory = forest.select("tree", "centre", "radius", "bound").withColumn("page", F.pmod(F.xxhash64("tree"), F.lit(pages))).withColumn("block", numbers(n_blocks))
    pairs = packed.withColumn("page", numbers(pages)).groupBy("block", "page").cogroup(directory.groupBy("block", "page")).applyInPandas(candidates, "block long, tree long")
    pairs = written(pairs.withColumn("chunk", F.pmod(F.xxhash64("tree"), F.lit(chunks))), "tree_pairs")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in a.itertuples(index=False) if len(b) else []:
            q_rid, q_id = np.frombuffer(row.q_rid, np.int64), np.frombuffer(row.q_id, np.int64)
            with np.errstate(all="ignore"):
                best = search([_unpack(t, dim) for t in b.itertuples(index=False)], q_rid, _unpacked(row.q_kind, row.q, dim), np.frombuffer(row.q_first), k)
            out.append(pd.DataFrame({"q_rid": q_rid[best.q], "query_id": q_id[best.q], "vec_id": best.id, "rid": best.rid, "score": best.score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q_rid", "query_id", "vec_id", "rid", "score")})

    asks = packed.join(pairs.select(F.col("block").alias("asking"), F.col("chunk").alias("part")).distinct(), F.col("block") == F.col("asking")).drop("asking")
    sent = pairs.join(forest.drop("router", "asked", "first"), "tree")
    found = asks.groupBy("block", "part").cogroup(sent.groupBy("block", "chunk")).applyInPandas(run, "q_rid long, query_id long, vec_id long, rid long, score long")
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
