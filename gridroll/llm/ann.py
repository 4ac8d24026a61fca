"""Nearest neighbours by inner product with score-aware quantisation.

Vectors are dealt to coarse cells around centres of a sample, and a query visits
the cells whose centres have the largest inner products with it, as many as a
brute-force search of the sample shows to be needed, and then every other cell
that its centre and radius allow to hold a vector as near as the k-th found;
where most would be visited at first, there is one cell. So cells only save
work, and no result depends on them. Vectors are coded by product quantisation with 16 codewords (four bits) for
every two components. Codebooks and codes minimise the anisotropic loss, which
penalises the part of the residual parallel to the vector more, since that is
what changes the large inner products. A query turns each pair of codebooks
into a table of partial scores; scanning the codes adds up table entries. The
best of the scan are scored again exactly, and so is every further candidate
whose scanned score and the length of what its code leaves out allow an inner
product as large as the k-th exact one, so that no neighbour is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridroll.llm.vectors import common_length, fit_sample, matrix, usable
from gridroll.session import materialize, ship

#: Components a codebook covers, candidates and queries that meet in one task, and candidates always scored exactly.
WIDTH, CANDIDATES, QUERIES, DEPTH = 2, 8192, 4096, 120
#: Most coarse cells, vectors from which on there are any, queries of the sample that are searched by brute force, and the share of their neighbours that the cells visited first have to hold.
CELLS, CELLS_FROM, TRIALS, HELD = 256, 20_000, 300, 0.985


class Cells:
    """Coarse cells: a vector lies in that of the nearest centre, a query first visits the ``visits`` of largest inner product."""

    def __init__(self, x: np.ndarray, n: int, k: int, rounds: int = 10, seed: int = 9):
        many = min(CELLS, int(n**0.5), len(x) // 32)
        self.centres, self.visits = np.zeros((1, x.shape[1])), 1
        if n < CELLS_FROM or many < 4:
            return
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), many, replace=False)].copy()
        for _ in range(rounds):
            own = self._nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.bincount(own, minlength=many)
            centres[size > 0] = sums[size > 0] / size[size > 0, None]
        own = self._nearest(x, centres)
        asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        some = min(k, len(x) - 1)
        near = np.argpartition(-score, some - 1, axis=1)[:, :some]
        rank = np.empty((len(asked), many), np.int64)
        np.put_along_axis(rank, np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), np.arange(many)[None, :], axis=1)
        needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
        visits = int(needed[min(len(needed) - 1, int(np.ceil(HELD * len(needed))))]) + 1
        if visits <= many // 2:
            self.centres, self.visits = centres, visits

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = (centres**2).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def visited(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.visits]

    def missed(self, q: np.ndarray, kth: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """For each query the cells that were not visited and may hold an inner product of at least ``kth``; ``radius`` is the largest distance of a cell's vectors from its centre, -1 without any."""
        long = np.linalg.norm(q, axis=1)[:, None]
        ahead = q @ self.centres.T + long * radius + 1e-9 * long * (np.linalg.norm(self.centres, axis=1) + radius)
        may = ~(ahead < kth[:, None]) & (radius >= 0)
        np.put_along_axis(may, self.visited(q), False, axis=1)
        return [np.flatnonzero(m).astype(np.int32) for m in may]


class Quantiser:
    """Product quantiser with the anisotropic loss of threshold ``t``."""

    def __init__(self, x: np.ndarray, t: float = 0.2, rounds: int = 8, seed: int = 5):
        self.dim = x.shape[1]
        self.parts = -(-self.dim // WIDTH)
        self.eta = max(1.0, (self.dim - 1) * t * t / (1 - t * t))
        x = self._pad(x)
        rng = np.random.default_rng(seed)
        sub = x.reshape(len(x), self.parts, WIDTH)
        pick = rng.integers(0, max(1, len(x)), (self.parts, 16))
        self.books = np.stack([sub[pick[m], m] if len(x) else np.zeros((16, WIDTH)) for m in range(self.parts)])
        for _ in range(rounds if len(x) else 0):
            codes = self._assign(x, 1)
            self._update(x, codes)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        lack = self.parts * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, lack))) if lack else x

    def _assign(self, x: np.ndarray, passes: int) -> np.ndarray:
        n = len(x)
        sub = x.reshape(n, self.parts, WIDTH)
        unit = sub / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        own = np.stack([((sub[:, m, None, :] - self.books[m]) ** 2).sum(2) for m in range(self.parts)], axis=1)  # n, parts, 16
        along = np.stack([((sub[:, m, None, :] - self.books[m]) * unit[:, m, None, :]).sum(2) for m in range(self.parts)], axis=1)
        codes = own.argmin(2)
        rows = np.arange(n)
        parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for m in range(self.parts):
                rest = parallel - along[rows, m, codes[:, m]]
                codes[:, m] = (own[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                parallel = rest + along[rows, m, codes[:, m]]
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        sub = x.reshape(len(x), self.parts, WIDTH)
        unit = sub / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for m in range(self.parts):
            error = sub - self.books[np.arange(self.parts), codes]
            parallel = (error * unit).sum((1, 2)) - (error[:, m] * unit[:, m]).sum(1)
            a = np.zeros((16, WIDTH, WIDTH))
            b = np.zeros((16, WIDTH))
            u = unit[:, m]
            np.add.at(a, codes[:, m], np.eye(WIDTH) + (self.eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(b, codes[:, m], sub[:, m] + (self.eta - 1) * (parallel + (sub[:, m] * u).sum(1))[:, None] * u)
            full = np.bincount(codes[:, m], minlength=16) > 0
            self.books[m, full] = np.linalg.solve(a[full] + 1e-9 * np.eye(WIDTH), b[full][:, :, None])[:, :, 0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows, two parts to a byte."""
        codes = np.concatenate([self._assign(self._pad(x[i : i + 2048]), 2) for i in range(0, len(x), 2048)]) if len(x) else np.zeros((0, self.parts), np.int64)
        if self.parts % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def left_out(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of what each row's code leaves out, and of what it holds."""
        parts = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : self.parts]
        held = self.books[np.arange(self.parts), parts].reshape(len(x), -1)
        return np.linalg.norm(self._pad(x) - held, axis=1), np.linalg.norm(held, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the partial scores of its 256 values."""
        t = np.einsum("qmw,mkw->qmk", self._pad(q).reshape(len(q), self.parts, WIDTH), self.books)
        if self.parts % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order whatever rows are beside it, so that equal vectors tie."""
    return np.einsum("ij,j->i", v, q)


def best_of_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, codes: np.ndarray, quantiser: Quantiser, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact score): each query's k best of one block of candidates, which are sorted by id."""
    out_q, out_v, out_s = [], [], []
    columns = np.ascontiguousarray(codes.T)
    rest, held = quantiser.left_out(v, codes)
    # an inner product exceeds its scan by no more than this times the query's length: what the code leaves out, and the rounding of the scan in single precision
    above = rest * (1 + 1e-9) + (quantiser.parts + 8) * 2.4e-7 * held
    depth = max(depth, k + 2)
    for at in range(0, len(qid), 256):
        luts = quantiser.tables(q[at : at + 256])
        for i, lut in enumerate(luts, at):
            scan = lut[0][columns[0]]
            for m in range(1, len(columns)):
                scan = scan + lut[m][columns[m]]
            other = vid != qid[i]
            scan[~other] = -np.inf
            some = min(depth, len(scan))
            first = np.argpartition(-scan, some - 1)[:some]
            first = first[other[first]]
            exact = _products(v[first], q[i])
            if len(exact) > k:
                kth = np.partition(exact, len(exact) - k)[len(exact) - k]
                first = np.flatnonzero(other & ~(scan + above * np.linalg.norm(q[i]) < kth))
                exact = _products(v[first], q[i])
            top = np.lexsort((vid[first], -exact))[:k]
            out_q.append(np.full(len(top), qid[i]))
            out_v.append(vid[first[top]])
            out_s.append(exact[top])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.float64)


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` for every row of ``queries``, by inner product.

    Returns query_id, rank (from 1), vec_id and score (the exact inner product
    in double precision), nearest first, ties to the smaller id; all candidates
    where there are fewer than k. A query is no candidate of its own. Vectors
    that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor do rows without an id. Of rows with
    the same id the smallest vector counts. The codebooks are fitted to a
    bounded sample (vectors.FIT_ROWS), every vector is coded. Queries meet
    the candidates of the cells they visit in blocks of bounded size. The result
    is that of comparing all, whatever the cells, blocks and codes are.
    """
    spark = vectors.sparkSession
    ship(spark)
    dim = common_length(vectors, vec_col)
    schema = "query_id long, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = lambda df: df.where(F.col(id_col).isNotNull() & usable(vec_col, dim)).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vec_col).alias("v"))
    base, asked = materialize(one(vectors)), materialize(one(queries))
    n = base.count()
    sample = fit_sample(base, "vec_id", "v", dim, n)
    quantiser, cells = spark.sparkContext.broadcast(Quantiser(sample)), spark.sparkContext.broadcast(Cells(sample, n, k))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim)
            cell = cells.value.of(x)
            away = np.linalg.norm(x - cells.value.centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in quantiser.value.encode(x)], pa.binary()), pa.array(cell, pa.int32()), pa.array(away)], names=[*b.schema.names, "code", "cell", "away"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = cells.value.visited(matrix(b.column("v"), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(to.ravel()), to.shape[1]).cast(pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    coded = materialize(base.mapInArrow(code, base.withColumn("code", F.lit(b"")).withColumn("cell", F.lit(0)).withColumn("away", F.lit(0.0)).schema))
    sent = materialize(asked.mapInArrow(visit, asked.withColumn("cells", F.array(F.lit(0))).schema)).select("vec_id", "v", F.explode("cells").alias("cell"))
    sizes = {r["cell"]: r for r in coded.groupBy("cell").agg(F.count("*").alias("held"), F.max("away").alias("away")).collect()}  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values("vec_id")
        a, b = (np.stack(df["v"].to_numpy()).astype(np.float64) for df in (left, right))
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        got = best_of_block(left["vec_id"].to_numpy(), a, right["vec_id"].to_numpy(), b, codes, quantiser.value, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    def met(sent: DataFrame) -> DataFrame:
        # a cell of many vectors or queries is cut into blocks of about the same size; their numbers follow from the counts, a row a cell
        wanted = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
        plan = spark.createDataFrame([(c, -(-sizes[c]["held"] // CANDIDATES), -(-wanted[c] // QUERIES)) for c in sizes if c in wanted], "cell int, n_c int, n_q int")
        c = coded.drop("away").join(F.broadcast(plan), "cell").withColumn("cb", block("n_c")).withColumn("qb", every("n_q")).drop("n_c", "n_q").groupBy("cell", "cb", "qb")
        q = sent.join(F.broadcast(plan), "cell").withColumn("qb", block("n_q")).withColumn("cb", every("n_c")).drop("n_c", "n_q").groupBy("cell", "cb", "qb")
        return q.cogroup(c).applyInPandas(meet, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nearest = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = met(sent)
    if cells.value.visits < len(cells.value.centres):
        found = materialize(nearest(found).drop("rank"))
        radius = np.array([sizes[c]["away"] * (1 + 1e-9) if c in sizes else -1.0 for c in range(len(cells.value.centres))])

        def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                to = cells.value.missed(matrix(b.column("v"), dim), b.column("kth").to_numpy(zero_copy_only=False), radius)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "v", "cells"])

        reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        kth = F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("kth")
        further = asked.join(reached, "vec_id", "left").select("vec_id", "v", kth).mapInArrow(revisit, asked.withColumn("cells", F.array(F.lit(0))).schema)
        found = found.unionByName(met(materialize(further).select("vec_id", "v", F.explode("cells").alias("cell"))))
    return nearest(found)
