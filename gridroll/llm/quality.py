"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are bytes, so that an n-gram fits in one long and its
context and suffix are a shift and a mask of it. Every partition counts the
n-grams of its texts; the counts are summed by (language, n-gram) shards.
Continuation counts, contexts and probabilities of all orders are joins and
aggregates of these shards, for exactly the n-grams that occur in the corpus.
Scoring fetches each block's n-grams from the shards, or all of them where
they are few enough to be broadcast. A text is kept if its perplexity is not
above a quantile of the trusted texts' perplexities in its language, each
taken under a model of the other folds of trusted texts, since a model fits the
texts it was learnt from far better than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridroll.llm.common import join_small, masked
from gridroll.llm.textvec import U64, flat, slices, trimmed
from gridroll.session import materialize, ship

#: Order of the model, n-grams that may be broadcast (12 bytes each), distinct n-grams a partition holds before it passes them on, labels that may be broadcast, bins a unit of log perplexity for quantiles, bytes of text a block of the sharded way has, bytes of the language's usual text that are added to each text before it is compared, folds of trusted texts, parts in which the driver fetches the models.
ORDER, BROADCAST_GRAMS, HELD, LABELS_BROADCAST, BINS, BLOCK_BYTES, PRIOR, FOLDS, FETCHES = 5, 5_000_000, 4_000_000, 1_000_000, 1000, 16 << 20, 64, 4, 5


def grams(texts: pa.Array, n: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of each text, ``n - 1`` zeros before it, end to end, and the offsets. There are as many as bytes; byte 0 counts as 1."""
    data, off = flat(texts)
    rows = len(off) - 1
    lens = np.diff(off)
    padded = np.zeros(len(data) + rows * (n - 1), np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * (n - 1), lens)
    padded[at] = np.maximum(data, 1)
    v = np.zeros(len(data), U64)
    for j in range(n):
        v |= padded[at - j].astype(U64) << U64(8 * j)
    return v.view(np.int64), off


def _by_model(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    for key, rows in b.select(["lang", "fold"]).to_pandas().groupby(["lang", "fold"]).indices.items():
        yield key, b.take(pa.array(rows))


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(lang, fold, g, c): the n-grams of the trusted texts of each fold; fold -1 has those of all other texts, which count nothing."""
    held: dict[tuple[str, int], list[pd.DataFrame]] = {}
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        for (lang, fold), parts in held.items():
            df = pd.concat(parts).groupby("g", sort=False)["c"].sum()
            for x in range(0, len(df), 200_000):
                s = df.iloc[x : x + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(np.full(len(s), fold, np.int32)), pa.array(s.index.to_numpy()), pa.array(s.to_numpy())], names=["lang", "fold", "g", "c"])
        held.clear()

    for whole in batches:
        for b in slices(whole, "text"):
            for key, own in _by_model(b):
                codes, keys = pd.factorize(grams(own.column("text"), n)[0])
                c = np.bincount(codes, minlength=len(keys)).astype(np.int64) if key[1] >= 0 else np.zeros(len(keys), np.int64)
                held.setdefault(key, []).append(pd.DataFrame({"g": keys, "c": c}))
                size += len(keys)
            if size > HELD:
                held = {key: [pd.concat(parts).groupby("g", sort=False, as_index=False)["c"].sum()] for key, parts in held.items()}
                size = sum(len(p[0]) for p in held.values())
                if size > HELD // 2:
                    yield from packed()
                    size = 0
    yield from packed()


def _models(counted: DataFrame) -> DataFrame:
    """(lang, g, c, asked) of each language's model and, under the fold's number before the language, of those that lack a fold; asked are the n-grams of the texts that the model scores."""
    of = [F.struct("lang", F.col("c").alias("c"), F.lit(True).alias("asked"))]
    of += [F.struct(F.concat(F.lit(str(k)), "lang").alias("lang"), (F.col("c") - F.col(f"c{k}")).alias("c"), (F.col(f"c{k}") > 0).alias("asked")) for k in range(FOLDS)]
    return counted.select("g", F.explode(F.when(F.col("c") > 0, F.array(*of)).otherwise(F.array(of[0]))).alias("m")).select("m.lang", "g", "m.c", "m.asked").where("asked or c > 0")


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 of modified Kneser-Ney by language, from counts of counts; 0.5, 1 and 1.5 where these are too few."""
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05 * i)), F.lit(0.99 * i))).otherwise(0.5 * i)
    return counts.groupBy("lang").agg(*n).select("lang", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])


def _discount(c: Column) -> Column:
    return F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).when(c == 1, F.col("d1")).otherwise(0.0)


def probabilities(counted: DataFrame, n: int = ORDER) -> DataFrame:
    """(lang, g, logp): the natural log probability of the last byte of every n-gram of ``counted`` (lang, g, c, asked) that is asked, given the bytes before, learnt from those with c > 0.

    Languages without any trusted text are left out.
    """
    taught = F.broadcast(counted.where("c > 0").select("lang").distinct())  # languages are few
    levels = [materialize(counted.join(taught, "lang", "left_semi").select("lang", "g", "c", "asked"))]
    suffix = lambda order: F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
    for order in range(n, 1, -1):
        # a shorter n-gram counts before how many bytes it stands, and is asked where a longer one is
        levels.append(materialize(levels[-1].groupBy("lang", suffix(order).alias("g")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"), F.max("asked").alias("asked"))))
    p = None
    for order, level in enumerate(reversed(levels), 1):
        own = level.where("c > 0")
        marked = level.join(F.broadcast(_discounts(own)), "lang").withColumn("h", F.shiftright("g", 8))  # a row a language
        contexts = marked.where("c > 0").groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"))).alias("saved"))
        q = marked.where("asked").select("lang", "g", "h", (F.col("c") - _discount(F.col("c"))).alias("left")).join(contexts, ["lang", "h"], "left")
        if p is None:
            q = q.withColumn("lower", F.lit(1 / 255))
        else:
            q = q.withColumn("s", suffix(order)).join(p.select("lang", F.col("g").alias("s"), F.col("p").alias("lower")), ["lang", "s"])
        p = materialize(q.select("lang", "g", F.when(F.col("total").isNull(), F.col("lower")).otherwise(F.col("left") / F.col("total") + F.col("saved") / F.col("total") * F.col("lower")).alias("p")))
    return p.select("lang", "g", F.log("p").alias("logp"))


Tables = dict[int, tuple[np.ndarray, np.ndarray]]


def _tables(p: pa.Table) -> Tables:
    """By model its n-grams in order and their log probabilities, from rows (code, a model's number; g; logp)."""
    code, g, logp = (p.column(c).to_numpy() for c in ("code", "g", "logp"))
    o = np.lexsort((g, code))
    g, logp = g[o], logp[o].astype(np.float32, copy=False)
    codes, first = np.unique(code[o], return_index=True)
    cut = [*first, len(g)]
    return {int(c): (g[cut[i] : cut[i + 1]], logp[cut[i] : cut[i + 1]]) for i, c in enumerate(codes)}


def _by_value(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """The values of a column of numbers in order, and the rows of each."""
    v = b.column(column).to_numpy(zero_copy_only=False)
    for x in np.unique(v):
        yield int(x), np.flatnonzero(v == x)


def _scored(b: pa.RecordBatch, text: str, tables: Tables, n: int) -> pa.Array:
    """The mean log probability of the bytes of each row's ``text`` by the model whose number is in the column ``_code``; null without bytes or model."""
    out = np.full(b.num_rows, np.nan)
    for model, rows in _by_value(b, "_code"):
        if model in tables:
            keys, logp = tables[model]
            v, off = grams(b.column(text).take(pa.array(rows)), n)
            codes, own = pd.factorize(v)
            s = logp[np.minimum(np.searchsorted(keys, own), len(keys) - 1)].astype(np.float64)[codes]
            sums = np.concatenate([[0.0], np.cumsum(s)])
            lens = np.diff(off)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[rows] = np.where(lens > 0, (sums[off[1:]] - sums[off[:-1]]) / lens, np.nan)
    return pa.array(out, from_pandas=True)


def _ask(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[pa.RecordBatch]:
    """(block, code, g): each block's n-grams by model, once; the rows of a block come one after the other."""
    held: dict[int, np.ndarray] = {}
    at = -1

    def told() -> Iterator[pa.RecordBatch]:
        for code, own in held.items():
            for x in range(0, len(own), 200_000):
                g = own[x : x + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), at)), pa.array(np.full(len(g), code, np.int16)), pa.array(g)], names=["block", "code", "g"])
        held.clear()

    for whole in batches:
        for b in slices(whole, text):
            for block, in_block in _by_value(b, "_block"):
                if block != at:
                    yield from told()
                    at = block
                part = b.take(pa.array(in_block))
                for code, rows in _by_value(part, "_code"):
                    if code >= 0:
                        g = pd.unique(grams(part.column(text).take(pa.array(rows)), n)[0])
                        held[code] = pd.unique(np.concatenate([held[code], g])) if code in held else g
    yield from told()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.985, slack: float = 1.02, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Perplexity of every row of ``docs`` and whether it is kept.

    Trusted are the texts whose id has ``label_col`` 1 in ``labels`` (and no
    other value). Returns ``docs`` with perplexity (a byte), threshold and
    kept: the perplexity, taken together with PRIOR bytes of the language's usual
    text so that chance does not reject short texts, is at most the language's threshold, which is ``slack`` times the
    ``quantile`` of that figure over its trusted texts. There a trusted text is
    scored by a model of the other folds' texts; equal texts share a fold. Null
    languages are a language of their own. Null and empty texts have no perplexity and are not
    kept; texts in a language without trusted text have none and are kept,
    since nothing speaks against them, and so are those in a language whose trusted texts
    all lie in one fold, since nothing tells how well unseen texts fit. Equal rows get equal results. An empty
    table gives an empty result. Columns of ``docs`` named like the new ones
    are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("perplexity", "threshold", "kept")
    marks = materialize(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = 1 and hi = 1").select("_id", F.lit(True).alias("trusted")))
    docs, hidden = masked(docs)
    id_col, text_col, lang_col = (hidden[c] for c in (id_col, text_col, lang_col))
    marked = join_small(docs, marks, docs[id_col] == marks["_id"], "left", LABELS_BROADCAST).drop("_id")
    lang, text = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    fold = F.when(F.col("trusted"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int"))
    slim = marked.select(lang.alias("lang"), text.alias("text"), F.coalesce(fold, F.lit(-1)).alias("fold"))
    of = [F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(FOLDS)]
    counted = materialize(slim.mapInArrow(lambda it: trimmed(_count(it, order)), "lang string, fold int, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"), *of))
    p = materialize(probabilities(_models(counted), order))
    langs = sorted(r["lang"] for r in p.select("lang").distinct().collect())  # languages, once for each fold and once for all
    code = lambda model: ((F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]), model), F.lit(0)) - 1) if langs else F.lit(-1)).cast("smallint")
    slim_p = p.select(code(F.col("lang")).alias("code"), "g", F.col("logp").cast("float").alias("logp"))  # what travels of a model
    held = None
    if p.count() <= broadcast_grams:
        tables: Tables = {}
        for part in range(FETCHES):  # one after the other, so that the driver never holds all rows besides the tables
            tables |= _tables(slim_p.where(F.col("code") % FETCHES == part).toArrow())
        held = spark.sparkContext.broadcast(tables)

    def means(rows: DataFrame, model: Column) -> DataFrame:
        """``rows`` with ``_mean``, the mean log probability of their texts' bytes by ``model``."""
        rest = rows.columns
        full = rows.select(code(model).alias("_code"), *rest)
        schema = rows.withColumn("_mean", F.lit(None).cast("double")).schema

        def answer(whole: pa.RecordBatch, tables: Tables) -> Iterator[pa.RecordBatch]:
            for b in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), _scored(b, text_col, tables, order)], names=[*rest, "_mean"])

        if held is not None:
            return full.mapInArrow(lambda it: trimmed(x for b in it for x in answer(b, held.value)), schema)
        # the sharded way: the texts are dealt to blocks first, so that each block asks the shards once for each of its n-grams, and only for these
        total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        blocks = full.withColumn("_block", F.pmod(F.xxhash64(text_col, id_col), F.lit(max(1, total // BLOCK_BYTES)))).repartition("_block")
        asked = blocks.sortWithinPartitions("_block").mapInArrow(lambda it: trimmed(_ask(it, text_col, order)), "block long, code smallint, g long")
        answers = asked.join(slim_p, ["code", "g"]).select("block", "code", "g", "logp")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            tables = _tables(right)
            return pa.Table.from_batches([x for b in left.combine_chunks().to_batches() for x in answer(b, tables)])

        return blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)

    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    # only trusted texts are scored by the models of the folds
    held_out = marked.where("trusted").select(id_col, text_col, lang.alias("_l"), F.concat(fold.cast("string"), lang).alias("_fold"))
    known = materialize(means(held_out, F.col("_fold")).where("_mean is not null").select("_l", "_mean", size.alias("_n")))
    scored = means(marked, lang).withColumn("perplexity", F.exp(-F.col("_mean"))).withColumn("_l", lang).withColumn("_n", size)
    usual = F.broadcast(materialize(known.groupBy("_l").agg((F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n")).alias("_usual"))))  # a row a language
    level = (-(F.col("_mean") * F.col("_n") + F.col("_usual") * PRIOR) / (F.col("_n") + PRIOR)).alias("_level")
    # quantiles by counting bins, exact to a bin and the same in every run
    kept_scores = materialize(known.join(usual, "_l").select("_l", F.floor(level * BINS).alias("bin")).groupBy("_l", "bin").count())
    running = Window.partitionBy("_l").orderBy("bin")
    cum = kept_scores.withColumn("upto", F.sum("count").over(running)).withColumn("all", F.sum("count").over(Window.partitionBy("_l")))
    cuts = cum.where(F.col("upto") >= F.col("all") * quantile).groupBy("_l").agg((F.exp((F.min("bin") + 1) / BINS) * slack).alias("threshold"))
    out = scored.join(usual, "_l", "left").join(F.broadcast(materialize(cuts)), "_l", "left")
    kept = F.when(F.col("_n") == 0, False).when(F.col("threshold").isNull(), True).otherwise(F.exp(level) <= F.col("threshold"))
    return out.select(*[F.col(h).alias(c) for c, h in hidden.items()], "perplexity", "threshold", kept.alias("kept"))
