"""N-gram Jaccard join with vertical partitioning.

Every document is the set of its distinct word 5-grams. All n-grams stand in
one global order, rare before frequent, and that order is cut into fragments: ranges of
hashes for the rare ones, ranges of ranks for the frequent ones, whose most
frequent n-grams are split over several fragments.
Two sets with Jaccard similarity t or more share an n-gram among the first
|x| - ceil(t |x|) + 1 of each, so only those prefixes are sent, each n-gram to
its fragment. A fragment counts the overlaps of the documents that meet in it,
and the partial counts are summed per pair over the fragments. Only pairs whose
sum, with all n-grams beyond the prefixes, could reach the overlap that t asks
for are compared by their whole sets.

Documents with equal sets are one class throughout, so exact copies cost
nothing. Large groups of near copies are not expanded into pairs either: first
each group of documents that share n-grams is compared with leaders only, and
what has linked up is one component. Of a group whose members are not all of
one component, those outside its largest component then meet the others. Of
such pairs only those are made whose sizes and parity sketches allow the
similarity: a sketch is a set's n-grams counted modulo 2 in SKETCH bins, and two
sets differ in at least as many n-grams as their sketches in bins. No
pair that could join two components is left out, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import components
from gridroll.llm.textvec import U64, distinct_by_text, flat, mix64, odd_constants, shingles, slices, trimmed, word_hashes, words
from gridroll.session import materialize, ship

#: Prefix n-grams that a fragment holds on average; n-grams counted together before their frequent ones are told; documents of a partition from which an n-gram counts as frequent there; frequent n-grams the order knows by name; bins of a parity sketch.
FRAGMENT, COUNTED, OFTEN, KNOWN, SKETCH = 2_000_000, 8_000_000, 4, 1 << 20, 1024


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, int]]:
    """(sorted distinct n-grams, class) of each text; the class is a hash of the set."""
    data, off = flat(batch.column("text"))
    starts, ends, by_text = words(data, off)
    h, at = shingles(word_hashes(data, starts, ends, lower=True), by_text, k)
    salt = odd_constants(1, 41)[0]
    for s in distinct_by_text(h, at):
        yield s, int(mix64(mix64(s ^ salt).sum(dtype=U64, keepdims=True) + np.array([len(s)], U64)).view(np.int64)[0]) if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: how many of its n-grams fall into each of SKETCH bins, modulo 2, as 64-bit numbers."""
    odd = np.bincount((s & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (0, doc_id, set size, class, sketch where the class is new here) of all documents and (1, n-gram, documents here, 0, null) of n-grams frequent in this partition."""
    names = ["kind", "a", "b", "c", "sketch"]
    bits = pa.list_(pa.int64())
    seen: set[int] = set()
    held: list[np.ndarray] = []
    n_held = 0

    def frequent() -> pa.RecordBatch:
        s = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
        cut = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        n = np.diff(np.concatenate([first, [len(s)]]))
        top = n >= OFTEN
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ones(top.sum(), np.int32)), pa.array(s[first[top]].view(np.int64)), pa.array(n[top]), pa.array(np.zeros(top.sum(), np.int64)), pa.nulls(int(top.sum()), bits)], names=names)

    for whole in batches:
        for b in slices(whole, "text"):
            sizes, classes, sketches = [], [], []
            for s, c in _sets(b, k):
                sizes.append(len(s))
                classes.append(c)
                sketches.append(None)
                if len(s) and c not in seen:
                    seen.add(c)
                    sketches[-1] = sketch(s)
                    held.append(s)
                    n_held += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, bits)], names=names)
            if n_held > COUNTED:
                yield frequent()
                n_held = 0
    yield frequent()


def prefix_size(n: int, t: Fraction) -> int:
    return n - -(-n * t.numerator // t.denominator) + 1


class Order:
    """The global order of n-grams and its fragments.

    N-grams not known as frequent come first, by hash, then the known ones by
    frequency and hash. The first ``hashed`` fragments are ranges of hashes, the
    next ranges of the known ones' ranks with about ``per`` documents each; a
    known n-gram of more documents than that has fragments of its own, to
    which its documents are dealt by their class.
    """

    def __init__(self, grams: np.ndarray, often: np.ndarray, hashed: int, per: int):
        rank = np.lexsort((grams, often))
        by_hash = np.argsort(grams)
        place = np.empty(len(grams), np.int64)
        place[rank] = np.arange(len(grams))
        self.known, self.rank = grams[by_hash], place[by_hash]
        usual = often[rank] <= per
        part = (np.cumsum(np.where(usual, often[rank], 0)) - 1).clip(0) // max(1, per)
        ranges = int(part[usual].max(initial=-1)) + 1
        ways = np.where(usual, 1, -(-often[rank] // max(1, per)))
        own = np.cumsum(np.where(usual, 0, ways)) - np.where(usual, 0, ways)
        self.first, self.ways, self.hashed = hashed + np.where(usual, part, ranges + own), ways, hashed
        self.fragments = hashed + ranges + int(ways[~usual].sum())
        self.split = np.sort(grams[rank][~usual])

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a set in the global order, and the rank of each; -1 where it is not known."""
        if not len(self.known):
            return s, np.full(len(s), -1)
        i = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        r = np.where(self.known[i] == s, self.rank[i], -1)
        o = np.argsort(r, kind="stable")
        return s[o], r[o]

    def fragment(self, grams: np.ndarray, rank: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = ((grams >> U64(32)) * U64(self.hashed) >> U64(32)).astype(np.int64)
        k = rank >= 0
        r = rank[k]
        out[k] = self.first[r] + (mix64(cls[k].view(U64)) % self.ways[r].astype(U64)).astype(np.int64)
        return out


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, t: Fraction, order: Order) -> Iterator[pa.RecordBatch]:
    """The prefixes of this partition's classes, packed: a row for each fragment."""
    seen: set[int] = set()
    grams: list[np.ndarray] = []
    ranks: list[np.ndarray] = []
    classes: list[int] = []
    sizes: list[int] = []
    usual: list[int] = []
    n_held = 0

    def packed() -> pa.RecordBatch:
        g, r = np.concatenate(grams), np.concatenate(ranks)
        of = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        cls, size, common = np.array(classes, np.int64), np.array(sizes, np.int64), np.array(usual, np.int64)
        part = order.fragment(g, r, cls[of])
        o = np.argsort(part, kind="stable")
        frags, first = np.unique(part[o], return_index=True)
        rows = []
        for f, own in zip(frags.tolist(), np.split(o, first[1:]), strict=True):
            who, idx = np.unique(of[own], return_inverse=True)
            rows.append((f, g[own].tobytes(), idx.astype(np.uint32).tobytes(), cls[who].tobytes(), size[who].astype(np.uint32).tobytes(), common[who].astype(np.uint16).tobytes()))
        for x in (grams, ranks, classes, sizes, usual):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["frag", "grams", "idx", "classes", "sizes", "common"])

    for whole in batches:
        for b in slices(whole, "text"):
            for s, c in _sets(b, k):
                if len(s) and c not in seen:
                    seen.add(c)
                    ordered, rank = order.sort(s)
                    n = prefix_size(len(s), t)
                    usual.append(1000 * int((rank >= 0).sum()) // len(s))
                    grams.append(ordered[:n])
                    ranks.append(rank[:n])
                    classes.append(c)
                    sizes.append(len(s))
                    n_held += n
            if n_held > FRAGMENT:
                yield packed()
                n_held = 0
    if grams:
        yield packed()


#: Kinds of rows that a fragment returns: leader and led, two that meet alone, member of a larger group.
LED, ALONE, MEMBER = 0, 1, 2


def _fragment(batches: Iterator[pa.RecordBatch], t: Fraction, split: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What meets in this partition's fragments: (LED or ALONE, class, class, shared n-grams, set size, set size) and (MEMBER, group, class, the group's n-grams, set size, 0) of groups of three and more.

    A group is named by its members, so that it has one name in all fragments; a part of an n-gram in ``split`` is named by that n-gram, and its members are told even if they are few.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        for r in b.to_pylist():
            idx = np.frombuffer(r["idx"], np.uint32)
            parts.append((np.frombuffer(r["grams"], U64), np.frombuffer(r["classes"], np.int64)[idx], np.frombuffer(r["sizes"], np.uint32)[idx], np.frombuffer(r["common"], np.uint16)[idx]))
    if not parts:
        return
    g, c, n, central = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    # n-grams of one class alone go first: most occur once
    o = np.argsort(g, kind="stable")
    g = g[o]
    more = np.isin(g, split) if len(split) else np.zeros(len(g), bool)
    more[1:] |= g[1:] == g[:-1]
    more[:-1] |= g[1:] == g[:-1]
    o, g = o[more], g[more]
    c, n, central = c[o], n[o].astype(np.int64), central[o].astype(np.int64)
    o = np.lexsort((c, g))
    g, c, n, central = g[o], c[o], n[o], central[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    g, c, n, central = g[new], c[new], n[new], central[new]
    if not len(g):
        return
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.concatenate([cut, [len(g)]]))
    # groups with the same members are one group with several n-grams
    mark = np.add.reduceat(mix64(c.view(U64)), cut) + size.astype(U64)
    part = np.isin(g[cut], split) if len(split) else np.zeros(len(cut), bool)
    mark = np.where(part, g[cut], mark)
    keep = (size > 1) | part
    cut, size, mark, part = cut[keep], size[keep], mark[keep], part[keep]
    if not len(cut):
        return
    mark, first, times = np.unique(mark, return_index=True, return_counts=True)
    cut, size, part = cut[first], size[first], part[first]

    def rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(columns[0]), 100_000):
            some = [col[x : x + 100_000].astype(np.int64) for col in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), kind, np.int32)), *map(pa.array, some)], names=["kind", "a", "b", "m", "n", "n2"])

    two = (size == 2) & ~part
    i = cut[two]
    near = np.minimum(n[i], n[i + 1]) * t.denominator >= np.maximum(n[i], n[i + 1]) * t.numerator
    i = i[near]
    yield from rows(ALONE, c[i], c[i + 1], times[two][near], n[i], n[i + 1])
    led, members = [], []
    for at, m, gid, k in zip(cut[~two].tolist(), size[~two].tolist(), mark[~two].view(np.int64).tolist(), times[~two].tolist(), strict=True):
        cc, nn = c[at : at + m], n[at : at + m]
        members.append((np.full(m, gid), cc, np.full(m, k), nn, np.zeros(m, np.int64)))
        o = np.lexsort((cc, -central[at : at + m]))  # what consists of frequent n-grams most is nearest to most others; the order is the same in all groups
        cc, nn = cc[o], nn[o]
        while len(cc) > 1:  # a leader is compared with all that its size allows; the others get leaders of their own
            near = np.minimum(nn, nn[0]) * t.denominator >= np.maximum(nn, nn[0]) * t.numerator
            b_, nb = cc[1:][near[1:]], nn[1:][near[1:]]
            a, na = np.full(len(b_), cc[0]), np.full(len(b_), nn[0])
            low = a < b_
            led.append((np.where(low, a, b_), np.where(low, b_, a), np.full(len(a), k), np.where(low, na, nb), np.where(low, nb, na)))
            cc, nn = cc[~near], nn[~near]
    if led:
        a, b_, m, na, nb = (np.concatenate(x) for x in zip(*led, strict=True))
        o = np.lexsort((b_, a))
        a, b_, m, na, nb = a[o], b_[o], m[o], na[o], nb[o]
        if len(a):
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b_[1:] != b_[:-1])]))
            yield from rows(LED, a[first], b_[first], np.add.reduceat(m, first), na[first], nb[first])
    if members:
        yield from rows(MEMBER, *(np.concatenate(x) for x in zip(*members, strict=True)))


def _wanted(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of the classes that are asked for: (bits, words). It has 2 ** 26 bits at most; false hits cost work, not results."""
    bits = 1 << min(26, max(16, int(16 * max(1, ids.count())).bit_length()))
    slot = F.col("id").bitwiseAND(F.lit(bits - 1))
    got = ids.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((id & {bits - 1}L) & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return bits, out.view(U64)


def _chosen(batches: Iterator[pa.RecordBatch], k: int, bits: int, words_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The whole sets of the classes in the bitmap, each once in this partition."""
    seen: set[int] = set()
    for whole in batches:
        for b in slices(whole, "text"):
            cls, blob = [], []
            for s, c in _sets(b, k):
                i = c & (bits - 1)
                if len(s) and c not in seen and (int(words_[i >> 6]) >> (i & 63)) & 1:
                    seen.add(c)
                    cls.append(c)
                    blob.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(blob, pa.binary())], names=["c", "grams"])


def _similar(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
            u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            ok[i] = both * t.denominator >= t.numerator * (len(u) + len(v) - both)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most KNOWN of the most frequent n-grams of (a: n-gram, b: documents), and in how many documents they are known to be.

    A histogram of the frequencies gives the least one that is taken, so only
    these n-grams leave their partitions. Only the order rests on them, which
    is why they may be bounded.
    """
    summed = materialize(counts.groupBy("a").agg(F.sum("b").alias("df")))
    bin_ = F.floor(F.log2("df") * 16).cast("int")
    left, least, share = KNOWN, 0, 1.0
    for r in sorted(summed.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):  # a row for each sixteenth of an octave
        if r["count"] > left:
            least, share = r["bin"], left / r["count"]
            break
        left -= r["count"]
    else:
        share = 1.0
    some = summed.where((bin_ > least) | ((bin_ == least) & (F.pmod(F.xxhash64("a"), F.lit(1 << 20)) < int(share * (1 << 20)))))
    top = some.toArrow()
    return top.column("a").to_numpy().view(U64), top.column("df").to_numpy().astype(np.int64)


def jaccard_join(docs: DataFrame, threshold: Fraction = Fraction(3, 4), k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of word ``k``-gram sets of at least ``threshold``.

    Words are lower-cased in A-Z only. A text of fewer than ``k`` words is one
    n-gram of them all; a null text or one without words has none and links
    with nothing. Returns doc_id, n_shingles (set size) and component_id (the
    smallest id reachable, itself included). Repeated rows link like copies; a
    row without an id links, but gives no component its name. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = materialize(slim.mapInArrow(lambda it: trimmed(_count(it, k)), "kind int, a long, b long, c long, sketch array<long>"))
    ids = counted.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("c"))
    total = ids.agg(F.sum("n_shingles")).first()[0] or 0
    hashed = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1 - threshold)) // FRAGMENT)
    order = spark.sparkContext.broadcast(Order(*_frequent(counted.where("kind = 1").select("a", "b")), hashed, FRAGMENT))
    fragments, split = order.value.fragments, order.value.split
    packed = slim.mapInArrow(lambda it: trimmed(_prefixes(it, k, threshold, order.value)), "frag int, grams binary, idx binary, classes binary, sizes binary, common binary")
    met = materialize(packed.repartition(fragments, "frag").mapInArrow(lambda it: trimmed(_fragment(it, threshold, split)), "kind int, a long, b long, m long, n long, n2 long"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those that are similar enough, by their whole sets."""
        bits, bitmap = _wanted(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        held = spark.sparkContext.broadcast(bitmap)
        sets = materialize(slim.mapInArrow(lambda it: trimmed(_chosen(it, k, bits, held.value)), "c long, grams binary").groupBy("c").agg(F.min("grams").alias("grams")))
        x, y = sets.select(F.col("c").alias("a"), F.col("grams").alias("x")), sets.select(F.col("c").alias("b"), F.col("grams").alias("y"))
        return materialize(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: trimmed(_similar(it, threshold)), "a long, b long"))

    p, q = threshold.numerator, threshold.denominator
    rest = lambda n: F.ceil(F.col(n) * p / q) - 1  # noqa: E731  n-grams beyond the prefix
    # two sets of n and n2 n-grams are similar if they differ in at most so many
    differ = lambda n, n2: F.floor((F.col(n) + F.col(n2)) * (q - p) / (p + q))
    bins = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH // 64)])
    sketches = counted.where("sketch is not null").select("c", "sketch").dropDuplicates(["c"])

    def possible(counts: DataFrame, times: int = 1) -> DataFrame:
        """Pairs (a, b) whose counted overlap ``m``, ``times`` over, and all n-grams beyond the prefix reach the overlap needed, p / (p + q) of both sizes, and whose sketches allow it."""
        summed = counts.groupBy("a", "b").agg(F.sum("m").alias("m"), F.first("n").alias("n"), F.first("n2").alias("n2"))
        enough = summed.where((F.col("m") * times + F.greatest(rest("n"), rest("n2"))) * (p + q) >= (F.col("n") + F.col("n2")) * p)
        drawn = enough.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
        return drawn.where(bins("x", "y") <= differ("n", "n2")).select("a", "b")

    # what leaders share with those they lead is counted in part only, so a pair that is left out here comes up again below
    first = materialize(possible(met.where(F.col("kind") != MEMBER).select("a", "b", "m", "n", "n2"), 3))
    links = compared(first)
    comp = materialize(components(links))
    of = comp.select(F.col("id").alias("c"), "component")
    members = met.where(F.col("kind") == MEMBER).groupBy(F.col("a").alias("gid"), F.col("b").alias("c")).agg(F.sum("m").alias("m"), F.first("n").alias("n"))
    groups = materialize(members.join(of, "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component"))
    parts = groups.groupBy("gid", "comp").count()
    mixed = parts.groupBy("gid").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("gid", F.col("top.comp").alias("most"))
    open_ = materialize(groups.join(mixed, "gid").join(sketches, "c"))
    # a pair of different components has one outside the group's largest; where both are, the smaller class stands on the left
    l, r = open_.where("comp <> most").alias("l"), open_.alias("r")
    other = (F.col("l.gid") == F.col("r.gid")) & (F.col("l.comp") != F.col("r.comp")) & ((F.col("r.comp") == F.col("r.most")) | (F.col("l.c") < F.col("r.c")))
    alike = (F.least("l.n", "r.n") * q >= F.greatest("l.n", "r.n") * p) & (bins("l.sketch", "r.sketch") <= differ("l.n", "r.n"))
    # a group is summed over the fragments, so the counts of a pair's groups sum to the overlap of its prefixes
    swap = F.col("l.c") > F.col("r.c")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = l.join(r, other & alike).select(F.least("l.c", "r.c").alias("a"), F.greatest("l.c", "r.c").alias("b"), "l.m", either("l.n", "r.n").alias("n"), either("r.n", "l.n").alias("n2"))
    alone = met.where(F.col("kind") == ALONE).select("a", "b", "m", "n", "n2").join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    second = materialize(possible(pairs.unionByName(alone.select("a", "b", "m", "n", "n2"))).join(first, ["a", "b"], "left_anti"))
    if second.limit(1).count():
        links = links.unionByName(compared(second))
        comp = materialize(components(links))
    rooted = materialize(ids.join(comp, ids["c"] == comp["id"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "c")).alias("root")))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
