"""Line dedup by winnowing over line hashes. Native: no Python on executors.

A text is cut into lines, and lines into sentences, so that whole sentences set
into a longer line are found as well; such a piece is called a line here. What
a passage has before its first and after its last whole sentence is not matched,
nor is one that holds fewer than ``min_words`` words of whole sentences. A gram is
the shortest run of lines from a given line on that has ``min_words`` words or
is LONGEST lines long.
Of the gram hashes, the minimum of every window is a fingerprint; grams of one
line are always taken. Equal fingerprints are joined with their first
occurrence, the match is extended line by line both ways, and the later run is
deleted.

With ``window`` w and ``min_words`` k, every repeated run of whole lines of
k + (w - 1)(k - 1) words or more has a fingerprint, and so has every single line of k words; no
run of fewer than k words is deleted. Unless all grams of a run are selected,
what an extension can still have to cover is w - 1 lines before a fingerprint
and, after it, w - 1 lines and lines of fewer than k words together: that much
context travels with a first occurrence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import masked
from gridroll.session import materialize

#: Words of a gram, and grams of a window.
MIN_WORDS, WINDOW = 16, 2
#: A line or sentence ends after each of these.
ENDS = ("\n", ". ", "! ", "? ")
#: Lines of the longest gram.
LONGEST = 4
#: What marks the cuts for a moment where a text is put together again. Its own marks are escaped meanwhile.
MARK, ESCAPED = "\x01", (("\x02", "\x02b"), ("\x01", "\x02a"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """Plain replacements one after the other, which are several times as fast as a pattern."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _pieces(text: Column) -> Column:
    """The lines and sentences of a text with what ends them; end to end they are the text, once ``_plain`` has undone the escapes."""
    return F.split(_replaced(F.coalesce(text, F.lit("")), *ESCAPED, *((e, e + MARK) for e in ENDS)), MARK)


def _plain(text: Column) -> Column:
    return _replaced(text, *((b, a) for a, b in reversed(ESCAPED)))


def _fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row; a plain projection would be computed again wherever it is used."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _lines(df: DataFrame, text: str) -> DataFrame:
    """(_d, _t, h, w, i): of the lines with words their hashes, words (32,767 stands for more) and places among all ``_pieces``, in order.

    Blanks around a line do not count, and several between words are one.
    """
    has = lambda *xs: reduce(Column.__or__, [F.contains("_x", F.lit(x)) for x in xs])
    only = lambda there, then: F.when(there, then).otherwise(F.col("_x"))
    x = _fixed(df.select("_d", "_t", F.coalesce(F.col(text), F.lit("")).alias("_x")), "_x", _replaced(F.col("_x"), (". ", ".\n")))
    x = _fixed(x, "_x", only(has("! ", "? "), _replaced(F.col("_x"), ("! ", "!\n"), ("? ", "?\n"))))
    x = _fixed(x, "_x", only(has("\t", "\r", "\x0b", "\x0c", "  "), F.regexp_replace("_x", r"[ \t\r\x0b\x0c]+", " ")))
    x = _fixed(x, "_x", only(has(" \n", "\n "), _replaced(F.col("_x"), (" \n", "\n"), ("\n ", "\n"))))
    one = lambda u, i: F.when(u != "", F.struct(F.xxhash64(u).alias("h"), F.least(F.size(F.split(u, " ")), F.lit(32767)).cast("smallint").alias("w"), i.alias("i")))
    x = _fixed(x, "x", F.filter(F.transform(F.split(F.trim(F.col("_x")), "\n"), one), lambda y: y.isNotNull()))
    # plain arrays are less than half as large in a shuffle as one of structs
    return x.where(F.size("x") > 0).select("_d", "_t", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.i").alias("i"))


def _fingerprints(df: DataFrame, k: int, w: int) -> DataFrame:
    """(_d, _t, line, lines, hash) of the grams that are the least of a window of ``w``, or of one line of ``k`` words.

    Every line becomes a row that holds the lines around it, so that all grams
    of its windows are plain expressions.
    """
    shifts = range(1 - w, w - 1 + LONGEST)
    at = lambda c, j: F.slice(c, j + 1, F.size(c)) if j > 0 else F.concat(F.array_repeat(F.lit(None).cast("bigint" if c == "h" else "smallint"), -j), c) if j else F.col(c)
    zipped = F.arrays_zip(*[at(c, j).alias(f"{c}{j - shifts[0]}") for c in "hw" for j in shifts])
    rows = df.select("_d", "_t", F.posexplode(zipped).alias("p", "z"))
    line = lambda c, j: F.col(f"z.{c}{j - shifts[0]}")
    words = lambda j, n: reduce(Column.__add__, [line("w", j + x).cast("int") for x in range(n)])

    def gram(j: int) -> Column:
        """The hash of the gram that starts ``j`` lines further; null where too few lines follow."""
        out = F.when(words(j, 1) >= k, F.xxhash64(line("h", j)))
        for n in range(2, LONGEST):
            out = out.when(words(j, n) >= k, F.xxhash64(*[line("h", j + x) for x in range(n)]))
        return out.when(line("h", j + LONGEST - 1).isNotNull(), F.xxhash64(*[line("h", j + x) for x in range(LONGEST)]))

    length = F.when(words(0, 1) >= k, 1)
    for n in range(2, LONGEST):
        length = length.when(words(0, n) >= k, n)
    # each computed once a row: all in one expression would be too long for the compiler
    grams = rows.where(line("h", 0).isNotNull())
    for j in range(1 - w, w):
        grams = _fixed(grams, f"g{j + w}", gram(j))
    g = lambda j: F.col(f"g{j + w}")
    grams = _fixed(grams, "n", length.otherwise(LONGEST)).drop("z")
    # no gram of some window over this one is smaller; grams cut off by the end do not count
    least = reduce(Column.__or__, [reduce(Column.__and__, [F.coalesce(g(j - o) >= g(0), F.lit(True)) for j in range(w) if j != o], F.col("p") >= o) for o in range(w)])
    return grams.where(g(0).isNotNull() & ((F.col("n") == 1) | least)).select("_d", "_t", "p", "n", g(0).alias("g"))


def _merged(matches: Column) -> Column:
    """Matches (lo, hi, before, after) united where they overlap or adjoin: the context before the first and after the last of them stays."""
    empty = F.array().cast("array<struct<lo:int,hi:int,before:array<bigint>,after:array<bigint>>>")

    def step(a: Column, r: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (r["lo"] <= F.coalesce(last["hi"], F.lit(-9)) + 1)
        further = r["hi"] > last["hi"]
        one = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"), last["before"].alias("before"), F.when(further, r["after"]).otherwise(last["after"]).alias("after"))
        return F.when(joins, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(a, F.array(r)))

    return F.aggregate(F.array_sort(matches), empty, step)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete later repeats of runs of lines, within and across documents.

    Documents are ordered by id, rows without an id last. Returns ``docs`` with
    ``text`` cleaned and two columns more: n_removed (lines) and removed (runs
    of line numbers from 0, sentences counting as lines). Blank
    lines stay, except between deleted ones. A null text stays null. Rows with the same id and text are one document and lose the same
    lines. An empty table gives an empty result. Columns of ``docs`` that are
    named like the new ones are replaced.
    """
    k, w = min_words, window
    docs, hidden = masked(docs.drop("n_removed", "removed"))
    id_col, text_col = hidden[id_col], hidden[text_col]
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_d"), F.hash(text_col).alias("_t")]
    slim = materialize(_lines(docs.select(*key, text_col), text_col))
    at = F.struct(F.col("_d").alias("d"), F.col("_t").alias("t"), F.col("p").alias("p"))
    prints = materialize(_fingerprints(slim, k, w))
    firsts = prints.groupBy("g").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.max("n").alias("n")).where("a <> z").select("g", F.col("a.d").alias("_d"), F.col("a.t").alias("_t"), F.col("a.p").alias("pa"), "n")
    # the first occurrence with its context: w - 1 lines before, and after it as many as can lack a fingerprint
    short = F.struct(F.lit(0).alias("s"), F.array().cast("array<bigint>").alias("a"))
    near = lambda a, y: F.struct((a["s"] + y["w"].cast("int")).alias("s"), F.when(a["s"] < w * k, F.concat(a["a"], F.array(y["h"]))).otherwise(a["a"]).alias("a"))
    some = lambda c, q: F.slice(c, q + 1, F.lit(w * k))
    tail = lambda q: F.aggregate(F.arrays_zip(some("h", q).alias("h"), some("w", q).alias("w")), short, near, lambda a: a["a"])
    head = lambda p: F.reverse(F.slice("h", F.greatest(p - (w - 2), F.lit(1)), F.least(p, F.lit(w - 1))))
    once = slim.dropDuplicates(["_d", "_t"])
    known = firsts.join(once.drop("i"), ["_d", "_t"]).select("g", F.col("_d").alias("da"), F.col("_t").alias("ta"), "pa", head(F.col("pa")).alias("before"), tail(F.col("pa") + F.col("n")).alias("after"))
    known = materialize(known)
    hi = (F.col("p") + F.col("n") - 1).alias("hi")
    later = prints.join(known, "g").where("not (_d = da and _t = ta and p = pa)").select("_d", "_t", F.struct(F.col("p").alias("lo"), hi, "before", "after").alias("m"))
    by_doc = later.groupBy("_d", "_t").agg(F.collect_list("m").alias("ms"))  # at most a match for each line of the document
    united = _fixed(by_doc, "runs", _merged(F.col("ms"))).drop("ms")
    # how many lines before the first and after the last match of a run agree as well
    same = lambda near, place: F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, h: F.when(a["go"] & (F.try_element_at("h", place(a["n"])) == h), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("go"))), lambda a: a["n"])
    grown = lambda m: F.struct(
        (m["lo"] - same(m["before"], lambda n: F.when(m["lo"] - n > 0, m["lo"] - n).otherwise(F.lit(1 << 30)))).alias("lo"),
        (m["hi"] + same(m["after"], lambda n: m["hi"] + n + 2)).alias("hi"),
    )
    # from places among the lines with words to places among all pieces
    whole = lambda r: F.struct(F.element_at("i", r["lo"] + 1).alias("lo"), F.element_at("i", r["hi"] + 1).alias("hi"))
    n_words = lambda r: F.aggregate(F.slice("w", r["lo"] + 1, r["hi"] - r["lo"] + 1), F.lit(0), lambda a, y: a + y.cast("int"))
    full = F.filter(F.transform("runs", grown), lambda r: n_words(r) >= k)
    runs = _fixed(united.join(once, ["_d", "_t"]), "grown", full).where(F.size("grown") > 0).select("_d", "_t", F.transform("grown", whole).alias("removed"))
    keyed = docs.withColumns(dict(zip(("_d", "_t"), key, strict=True)))
    out = keyed.join(runs, ["_d", "_t"], "left").drop("_d", "_t")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    kept = F.filter(_pieces(F.col(text_col)), lambda u, i: ~F.exists("removed", lambda r: (i >= r["lo"]) & (i <= r["hi"])))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(_plain(F.array_join(kept, "")))
    # runs that were extended towards each other may share lines
    n_removed = F.coalesce(F.aggregate("removed", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), lambda a, r: F.struct((a["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], a["to"] + 1) + 1, F.lit(0))).alias("n"), F.greatest(a["to"], r["hi"]).alias("to")), lambda a: a["n"]), F.lit(0))
    return out.select(*[(text if h == text_col else F.col(h)).alias(c) for c, h in hidden.items()], n_removed.alias("n_removed"), F.coalesce("removed", none).alias("removed"))
