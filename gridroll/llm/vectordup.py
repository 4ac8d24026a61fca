"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

The vectors are centred, wholly or in part, and rotations that bring them close
to the corners of a cube are learned from a bounded sample; the signs of the
rotated components are balanced binary codes. The code is cut into substrings;
each is the key of one Hamming table. All codes that differ in fewer bits than
there are tables meet in one, and many that differ in more. Two vectors that
meet are compared by the cosine of the original vectors in double precision.
The substrings grow with the logarithm of the number of vectors, so that a key
keeps about as many vectors at any size; the number of tables follows from the
recall asked for at exactly the threshold; and how far to centre and how long
a substring is are what costs least on the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import components, join_small
from gridroll.llm.textvec import trimmed
from gridroll.llm.vectors import common_length, fit_sample, matrix, usable
from gridroll.session import materialize, ship

#: Vectors of a key that one task compares with each other; a key with more is cut into blocks, which are compared in pairs. Comparisons that an entry in a table costs as much as; most tables.
BLOCK, ENTRY, MOST_TABLES = 1024, 300, 400


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation under which the rows of ``x`` lie closest to their own signs."""
    dim = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    if len(x) < 2:
        return r
    for _ in range(rounds):
        v = x @ r
        u, _, w = np.linalg.svd(np.where(v >= 0, 1.0, -1.0).T @ x)
        r = (u @ w).T
    return r


def table_keys(x: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """The key of each row in each table: ``bits`` signs, the tables cut from all rotations' codes end to end."""
    signs = np.concatenate([x @ r >= 0 for r in rotations], axis=1)[:, : bits * tables]
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def n_tables(bits: int, cosine: float, recall: float) -> int:
    """Tables that two vectors of the given cosine meet in with probability ``recall``, their signs taken as independent."""
    agree = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if 0 < agree < 1 else 1 if agree else MOST_TABLES + 1


@dataclass
class Coder:
    """Keys of unit vectors: ``bits`` signs in each of ``tables`` tables, after ``centre`` is taken away and a rotation."""

    centre: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        return table_keys(x - self.centre, self.rotations, self.bits, self.tables)


def learn(x: np.ndarray, n: int, threshold: float, recall: float) -> Coder:
    """The coder that costs least for ``n`` vectors like the unit vectors ``x``.

    Vectors of a cosine at the threshold have a larger angle as seen from a
    centre near them, so a centre costs tables but spreads the keys. Few lie
    nearer the centre than a twentieth of the sample does, and the angle is
    taken from there. An entry in a table costs as much as ENTRY comparisons.
    """
    dim = x.shape[1]
    usual = max(6, min(40, math.ceil(math.log2(max(2, n))) - 4))
    mean = x.mean(0) if len(x) else np.zeros(dim)
    best: tuple[float, np.ndarray, int, int] | None = None
    for part in (0.0, 0.5, 0.8, 1.0):
        y = x - part * mean
        away = np.quantile((y**2).sum(1), 0.05) if len(x) else 1.0
        r = learn_rotation(y, 0, 10)
        for bits in sorted({max(6, usual - 3), usual, min(40, usual + 3)}):
            tables = n_tables(bits, 1 - (1 - threshold) / max(away, 1e-9), recall)
            if tables > MOST_TABLES:
                continue
            some = min(tables, dim // bits) or 1
            k = table_keys(y, [r] * -(-bits // dim), bits, some) if len(x) else np.zeros((0, some))
            meet = [(float((np.unique(k[:, t], return_counts=True)[1] ** 2.0).sum()) - len(x)) / max(1, len(x) * (len(x) - 1)) for t in range(some)]
            cost = tables * (ENTRY * n + n * n / 2 * float(np.mean(meet)))
            if best is None or cost < best[0]:
                best = (cost, part * mean, bits, tables)
    if best is None:  # a low threshold: substrings as short as it takes
        bits = next(b for b in range(usual, 0, -1) if b == 1 or n_tables(b, threshold, recall) <= MOST_TABLES)
        best = (0.0, np.zeros(dim), bits, n_tables(bits, threshold, recall))
    _, centre, bits, tables = best
    return Coder(centre, [learn_rotation(x - centre, seed) for seed in range(-(-bits * tables // dim))], bits, tables)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(batches: Iterator[pa.RecordBatch], dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group (t, key, lo, hi); a group is compared once it is whole. A group has at most two blocks."""
    names = ["vec_id", "other", "n_links"]

    def group(g: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, keys: np.ndarray, block: np.ndarray) -> pa.RecordBatch | None:
        t = int(g[0])
        label, links = ids.copy(), np.zeros(len(ids), np.int64)
        s = x @ x.T >= threshold
        np.fill_diagonal(s, False)
        if g[2] != g[3]:
            s &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(s))
        # a pair that met in an earlier table was counted there
        new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
        i, j = i[new], j[new]
        if not len(i):
            return None
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if (before == label).all():
                break
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(label[hit]), pa.array(links[hit])], names=names)

    held: list[tuple] = []
    out: list[pa.RecordBatch] = []

    def finish() -> None:
        if held:
            parts = [np.concatenate([h[k] for h in held]) for k in range(1, 6)]
            if len(parts[0]) > 1 and (r := group(held[0][0], *parts)) is not None:
                out.append(r)
            held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        g = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "lo", "hi")], axis=1)
        ids, copies, block = (b.column(c).to_numpy() for c in ("vec_id", "copies", "block"))
        x = unit(matrix(b.column("v"), dim))
        keys = b.column("keys").flatten().to_numpy().reshape(len(ids), -1)
        cut = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1, [len(ids)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and (held[0][0] != g[lo]).any():
                finish()
            if hi - lo == 1 and hi < len(ids) and not held:
                continue  # alone under its key
            held.append((g[lo], ids[lo:hi], copies[lo:hi], x[lo:hi], keys[lo:hi], block[lo:hi]))
        if len(out) > 512:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out.clear()
    finish()
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links between vectors whose cosine is at least ``threshold``, and their components.

    Returns a row for each id: vec_id, n_links (other vectors it is linked to
    directly), component_id (the smallest id reachable, itself included) and
    kept (it is that id). A pair at exactly the threshold is found with
    probability ``recall`` or more, nearer pairs more surely; no pair below it
    is linked. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components link with nothing. Of rows with the
    same id, the smallest vector counts; rows without an id are not vectors of
    anything and are left out. Equal vectors are linked by grouping and
    compared with others once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vec_col).alias("v"))
    dim = common_length(vectors, vec_col)
    if not dim:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = materialize(rows.withColumn("ok", usable("v", dim)).withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.reverse("v")).alias("b"))))
    good = rows.where("ok")
    # equal vectors: one stands for all
    classes = materialize(good.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min("v").alias("v")))
    n = classes.count()
    sample = fit_sample(classes, "vec_id", "v", dim, n)
    coder = spark.sparkContext.broadcast(learn(unit(sample) if len(sample) else sample, n, threshold, recall))
    tables = coder.value.tables

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = coder.value.keys(unit(matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))], names=["vec_id", "copies", "v", "keys"])

    # the vectors travel as they came, mostly in single precision, and are normed in double precision where they meet
    kind = dict(classes.dtypes)["v"]
    coded = materialize(classes.select("vec_id", "copies", "v").mapInArrow(code, f"vec_id long, copies long, v {kind}, keys array<long>"))
    met = coded.select("vec_id", F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().where("count > 1")
    crowded = materialize(met.where(F.col("count") > BLOCK).select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    entries = coded.select("*", F.posexplode("keys").alias("t", "key"))
    split = join_small(entries, crowded, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a vector of a crowded key goes to every pair of blocks that has its own; the hash spreads neighbours
    own = split.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("vec_id", "copies", "v", "keys", "t", "key", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    at = ["t", "key", "lo", "hi"]
    linked = materialize(
        dealt.repartition(*at).sortWithinPartitions(*at).select("t", "key", "lo", "hi", "vec_id", "copies", "v", "keys", "block").mapInArrow(lambda it: trimmed(_compare(it, dim, threshold)), "vec_id long, other long, n_links long")
    )
    links = linked.groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    comp = components(linked.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    best = classes.join(links, "vec_id", "left").join(comp, classes["vec_id"] == comp["id"], "left").select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("c"))
    out = rows.where("ok").join(best, "same").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
