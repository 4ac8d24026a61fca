"""Best-fit packing of tokenised documents into sequences by length patterns.

Only the histogram of piece lengths (at most ``size`` rows) reaches the driver.
There, patterns of few pieces that fill a sequence are enumerated on a coarse
grid, their repeat counts fitted to the histogram by non-negative least
squares and rounded, filled with exact lengths, and what is left over goes
best-fit into the gaps, longest first. Short pieces stay out of the patterns,
since they are what closes the gaps of the rest. All steps work on counts of equal
pieces, so their cost depends on ``size`` and not on the number of documents.
The plan then says where the r-th piece of each length goes, and every
executor looks its pieces up in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridroll.llm.textvec import U64, flat, slices, trimmed, word_hashes, words
from gridroll.session import materialize, ship


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """argmin |a x - b|, x >= 0, by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    grad = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(grad).max(initial=0)))
    for _ in range(rounds):
        if active.all() or (g := np.where(active, -np.inf, grad)).max() <= tol:
            break
        active[int(np.argmax(g))] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (z <= 1e-12)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x += step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
        grad = a.T @ (b - a @ x)
    return x


@cache
def patterns(units: int, most: int) -> tuple[tuple[int, ...], ...]:
    """All ways to write ``units`` as a falling sum of at most ``most`` positive parts."""

    def grow(rest: int, top: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for part in range(min(rest, top), 0, -1):
                if part * left < rest:
                    break
                for tail in grow(rest - part, part, left - 1):
                    yield (part, *tail)

    return tuple(grow(units, units, most))


def filled(pattern: tuple[int, ...], left: np.ndarray, grain: int, size: int) -> list[int]:
    """Lengths of the pattern's classes that are left and sum to ``size`` exactly, long ones first; empty if there are none.

    All but the last two slots take the longest length of their class; the
    last two are searched for the exact rest.
    """
    taken: list[int] = []
    free = left.copy()
    for i, u in enumerate(pattern):
        room = size - sum(taken)
        own = np.arange(min(u * grain, room), (u - 1) * grain, -1)
        own = own[free[own] > 0]
        if i >= len(pattern) - 2 and len(pattern) > 1:
            own = own[own < room]
            other = room - own
            own = own[(free[other] > 0) & ((other != own) | (free[own] > 1))]
            return [*taken, int(own[0]), room - int(own[0])] if len(own) else []
        if not len(own):
            return []
        taken.append(int(own[0]))
        free[taken[-1]] -= 1
    return taken if sum(taken) == size else []


#: Grids (classes of lengths, most pieces in a pattern, parts of a sequence below one of which a piece is short) that ``plan`` tries in turn.
GRIDS = ((32, 4, 64), (64, 3, 32), (64, 3, 16), (16, 5, 32), (32, 4, 16), (64, 3, 8), (32, 4, 8), (16, 5, 8))


def plan(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """The plan with the fewest sequences among those that the grids give (the first of equals); the first that needs no more than all tokens fill ends the search."""
    least = -(-sum(k * v for k, v in histogram.items()) // size)
    best: list[tuple[int, tuple[int, ...]]] | None = None
    n_best = 0
    for g in GRIDS:
        found, _ = plan_on(histogram, size, *g)
        n = sum(times for times, _ in found)
        if best is None or n < n_best:
            best, n_best = found, n
        if n_best == least:
            break
    return best or []


def plan_on(histogram: dict[int, int], size: int, units: int, most: int, short: int) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """Sequences as (how many, lengths in order) that use every piece of ``histogram`` (length: count) once, and how many of them patterns fill."""
    left = np.zeros(size + 1, np.int64)
    for k, v in histogram.items():
        left[k] = v
    done: list[tuple[int, tuple[int, ...]]] = []
    if left[size]:
        done.append((int(left[size]), (size,)))
        left[size] = 0
    spare = left.copy()
    spare[size // short + 1 :] = 0
    left -= spare
    grain = -(-size // units)
    of = -(-np.arange(size + 1) // grain)  # the class of a length, rounded up
    counts = np.bincount(of, weights=left, minlength=units + 1)[1 : units + 1]
    pats = patterns(units, most)
    a = np.zeros((units, len(pats)))
    for j, p in enumerate(pats):
        for u in p:
            a[u - 1, j] += 1
    scale = max(1.0, counts.max(initial=0))
    repeat = np.floor(nnls(a, counts / scale) * scale + 1e-6).astype(np.int64) if left.any() else np.zeros(len(pats), np.int64)
    by_pattern = 0
    for j in np.argsort([-max(p) for p in pats], kind="stable"):
        while repeat[j] > 0:
            taken = filled(pats[j], left, grain, size)
            if not taken:
                break  # no exact lengths are left for it; the residual packing takes the rest
            need = np.bincount(taken, minlength=size + 1)
            times = int(min(repeat[j], (left[need > 0] // need[need > 0]).min()))
            left -= times * need
            repeat[j] -= times
            done.append((times, tuple(taken)))
            by_pattern += times
    left += spare
    opened: dict[int, list[list]] = {}  # gap: [how many, lengths]
    gaps = np.zeros(size + 1, bool)
    for l in range(size, 0, -1):
        n = int(left[l])
        while n:
            fit = np.flatnonzero(gaps[l:])
            if not len(fit):
                opened.setdefault(size - l * (size // l), []).append([n // (size // l), (l,) * (size // l)]) if n >= size // l else None
                if n >= size // l:
                    gaps[size - l * (size // l)] = True
                    n %= size // l
                else:
                    opened.setdefault(size - l * n, []).append([1, (l,) * n])
                    gaps[size - l * n] = True
                    n = 0
                continue
            g = int(fit[0]) + l
            times, lengths = opened[g].pop()
            m = min(times, n)
            if times > m:
                opened[g].append([times - m, lengths])
            opened.setdefault(g - l, []).append([m, (*lengths, l)])
            gaps[g] = bool(opened[g])
            gaps[g - l] = True
            n -= m
    return done + [(t, ls) for found in opened.values() for t, ls in found if t], by_pattern


class WordTokenizer:
    """Token ids of texts, each distinct word tokenised once.

    The tokenizer's own first step splits at white space and no later step
    looks across it, so the ids of a text are those of its words in turn. Only
    space, tab, line feed and carriage return are taken as bounds here; words
    made of Latin letters followed by other ASCII signs are split once more
    where the tokenizer splits them. Everything else is left to the tokenizer.
    The memory is bounded by ``most`` words, which are told apart by 64-bit
    hashes; beyond, it starts anew.
    """

    _SEP = 49407
    _SIMPLE = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, most: int = 2_000_000, most_parts: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.joined = Tokenizer.from_file(path)  # here the end mark is a token, which separates the words of a call
        self.mark = self.joined.id_to_token(self._SEP)
        self.most, self.most_parts = most, most_parts
        self.parts: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        # sorted word hashes, where each word's ids begin among all ids, and how many they are
        self.keys, self.start, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _encode(self, new: list[str]) -> None:
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            odd = [w for w in some if self.mark[:2] in w]
            plain = [w for w in some if self.mark[:2] not in w]
            if plain:
                ids = np.array(self.joined.encode(self.mark.join(plain), add_special_tokens=False).ids, np.int64)
                cut = np.flatnonzero(ids == self._SEP)
                raw = ids.astype(np.uint16).tobytes()
                lo = (2 * np.concatenate([[0], cut + 1])).tolist()
                hi = [*(2 * cut).tolist(), len(raw)]
                self.parts.update((w, raw[x:y]) for w, x, y in zip(plain, lo, hi, strict=True))
            self.parts.update((w, np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint16).tobytes()) for w in odd)

    def learn(self, keys: np.ndarray, new: list[str]) -> None:
        split: list[tuple[str, ...]] = []
        for w in new:
            m = self._SIMPLE.fullmatch(w)
            split.append((m[1].lower(), m[2]) if m and m[2] else (m[1].lower(),) if m else (w,))
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        self._encode(list({p for s in split for p in s if p not in self.parts}))
        raw = [self.parts[s[0]] if len(s) == 1 else b"".join(self.parts[p] for p in s) for s in split]
        size = np.array([len(r) // 2 for r in raw], np.int32)
        n = int(size.sum())
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, n), np.uint16)])
        self.ids[self.used : self.used + n] = np.frombuffer(b"".join(raw), np.uint16)
        start = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += n
        o = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[o])
        self.keys, self.start, self.size = (np.insert(old, at, x[o]) for old, x in ((self.keys, keys), (self.start, start), (self.size, size)))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return i, self.keys[i] == keys

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets by text."""
        starts, ends, by_text = words(data, off, (0x20, 0x09, 0x0A, 0x0D))
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
        codes, keys = pd.factorize(word_hashes(data, starts, ends))
        if len(self.keys) + len(keys) > self.most:
            self.reset()
        row, known = self._find(keys)
        if not known.all():
            first = np.full(len(keys), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw, new = data.tobytes(), np.flatnonzero(~known)
            self.learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            row, _ = self._find(keys)
        row = row[codes]
        size = self.size[row].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(upto[-1]), dtype=np.int64) + np.repeat(self.start[row] - upto[:-1], size)
        return self.ids[at], upto[by_text]


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, so that its memory of words serves all tasks."""
    return WordTokenizer(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    tok, part = tokenizer(path), TaskContext.get().partitionId()
    seen = np.zeros(size + 1, np.int64)  # pieces of each length so far in this partition
    for whole in batches:
        for b in slices(whole, "text"):
            ids, off = tok(*flat(b.column("text")))
            docs, piece, start, length, crc = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                own = np.zeros(hi - lo + 1, "<u4")  # the last id is 0
                own[:-1] = ids[lo:hi]
                for k, at in enumerate(range(0, len(own), size)):
                    docs.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(min(size, len(own) - at))
                    crc.append(zlib.crc32(own[at : at + size].tobytes()))
            length = np.array(length, np.int64)
            rank = pd.Series(length).groupby(length).cumcount().to_numpy() + seen[length]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(docs), part, np.int64)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``size`` tokens.

    A document is its token ids (special tokens' strings are ordinary text)
    and then id 0; a null or empty text is that 0 alone. A longer document is
    cut into pieces of ``size``, the last of which may be shorter. Returns a
    row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset; the pieces of a sequence lie end to end from offset 0. Repeated
    rows are packed as often as they occur. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            lambda it: trimmed(_pieces(it, tokenizer_path, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"
        )
    )
    by_part = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["count"] for r in by_part.groupBy("length").agg(F.sum("count").alias("count")).collect()}  # at most ``size`` rows
    rows, base = [], 0
    used = np.zeros(size + 1, np.int64)
    for times, lengths in plan(histogram, size):
        at = 0
        for l in lengths:
            rows.append((l, int(used[l]), base, at))  # pieces of length l, from rank used[l] on: one each in sequences base, base + 1, ...
            used[l] += times
            at += l
        base += times
    rows.sort()
    # as many rows as the plan has slots, which the histogram's ``size`` bins bound
    places = np.array(rows, np.int64).reshape(-1, 4)
    held = spark.sparkContext.broadcast(places)
    ahead = by_part.withColumn("ahead", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(ahead.select("part", "length", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ahead")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        key = (p[:, 0] << 48) + p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p[i, 2] + rank - p[i, 1]), pa.array(p[i, 3])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
