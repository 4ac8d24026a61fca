"""Every operator on edge cases, and against brute force on small tables."""

import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridroll.llm import ann, html, packing, quality, toxicity, vectordup
from gridroll.llm.common import components, smallest
from gridroll.llm.linededup import dedup_lines
from gridroll.llm.mixing import mix, targets
from gridroll.llm.ngram_join import jaccard_join
from gridroll.llm.sharding import shard_documents, write_shards
from gridroll.llm.vectordup import near_duplicates

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside or return, as columns of the input.
CLASH = {"kept": "x", "component_id": 7, "size": 1, "part": 2, "g": 3, "x": 4, "lang2": "q", "removed": "r", "_lang": "l", "trusted": "t", "id": 9, "copies": 5, "h": 6, "n": 8, "perplexity": 0.5, "score": "s"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(id, text, lang, source) rows with clashing columns."""
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, LONG, "en", "a"), (6, LONG, None, "b"), (7, "a b c d e f", "en", "a"), (7, "a b c d e f", "en", "a"), (None, "a b c d e f", "en", "c"), (8, "The mark \x01 and \x02 here. Twice.", "xx", "a")]


@pytest.fixture
def edge(spark):
    return docs(spark, EDGE)


@pytest.fixture
def none(spark):
    return docs(spark, [])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (7, 0, 0), (7, 1, 1), (None, 1, 1), (99, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def text_of(n, seed, vocabulary=60):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def test_mix(spark, edge, none):
    assert mix(none).count() == 0
    out = mix(edge).collect()
    assert len(out) == len(EDGE) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert {r["doc_id"]: r["size"] for r in out if r["doc_id"]} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 30_000, 6: 30_000, 7: 6, 8: 7}
    rng = random.Random(1)
    rows = [(i, text_of(rng.randrange(0, 60), i), "en", rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None])) for i in range(800)]
    df = docs(spark, rows)
    got = mix(df).toPandas()
    assert (got.groupby("source", dropna=False).apply(lambda g: abs(g["taken"].sum() - g["target"].iloc[0]), include_groups=False) <= 30).all()
    assert abs(got.drop_duplicates("source")["target"].sum() - got["size"].sum()) < 1e-6
    again = mix(df.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_targets(spark):
    """The excess of capped sources goes to the others until none is above."""
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 100}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, open_, left = {}, dict(weights), float(sum(sizes.values()))
    while open_:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            del open_[k]
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


# 2


def test_quality_edges(edge, none, labels):
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(edge, labels.where("false")).where("kept").count() == len(EDGE) - 2  # no trusted text: only empty ones go
    out = {r["doc_id"]: r for r in quality.classify(edge, labels).collect()}
    assert not out[1]["kept"] and not out[2]["kept"] and out[1]["perplexity"] is None and out[5]["kept"]
    assert out[8]["kept"] and out[8]["threshold"] is None  # a language without trusted text


def kneser_ney(train, n):
    """Probabilities of the model, written down from its definition."""
    counts = [None] * (n + 1)
    counts[n] = defaultdict(int)
    for t in train:
        b = b"\0" * (n - 1) + t.encode()
        for i in range(len(t.encode())):
            counts[n][b[i : i + n]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def discounts(c):
        m = [0] + [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
        out = [0.0]
        for i in (1, 2, 3):
            y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
            out.append(min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.05 * i), 0.99 * i) if m[i] and m[1] else 0.5 * i)
        return out

    d = [discounts(c) if c else None for c in counts]

    def p(g):
        if not g:
            return 1 / 255
        c, k = counts[len(g)], len(g)
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        saved = sum(d[k][min(v, 3)] for v in own.values())
        v = own.get(g, 0)
        return (v - d[k][min(v, 3)] if v else 0) / total + saved / total * p(g[1:])

    return p


def test_quality_model(spark):
    train = ["the cat sat on the mat", "the cat ate the rat", "a bat"]
    rows = [(i, t, "en", "s") for i, t in enumerate([*train, "the hat zq", "qqqq"])]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["perplexity"] for r in quality.classify(docs(spark, rows), lab, order=3).collect()}
    sharded = {r["doc_id"]: r["perplexity"] for r in quality.classify(docs(spark, rows), lab, order=3, broadcast_grams=0).collect()}
    p = kneser_ney(train, 3)
    for i, t, *_ in rows:
        b = b"\0\0" + t.encode()
        want = np.exp(-np.mean([np.log(p(b[j : j + 3])) for j in range(len(t))]))
        assert out[i] == pytest.approx(want, rel=1e-5) and sharded[i] == pytest.approx(want, rel=1e-5)
    assert abs(sum(p(b"th" + bytes([x])) for x in range(1, 256)) - 1) < 1e-9


def test_quality_unseen(spark):
    """Clean texts without a label stay: the threshold is that of unseen texts, not of those the model was learnt from."""

    def text(seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("kslmnrtv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(60))

    rng = random.Random(0)
    junk = [(1000 + i, "".join(chr(rng.randrange(33, 127)) for _ in range(300)), "en", "s") for i in range(20)]
    rows = [*((i, text(i), "en", "s") for i in range(100)), *junk, (2000, text(2000), "xx", "s"), (2001, text(2001), "xx", "s"), (2001, text(2001), "xx", "s")]
    lab = spark.createDataFrame([(i, 1, 0) for i in [*range(20), 2000]], "doc_id long, quality int, toxic int")
    for grams in (quality.BROADCAST_GRAMS, 0):
        out = quality.classify(docs(spark, rows), lab, broadcast_grams=grams).collect()
        assert all(r["kept"] for r in out if r["doc_id"] < 20)
        assert sum(not r["kept"] for r in out if r["doc_id"] < 100) <= 5  # chance rejects a few
        assert not any(r["kept"] for r in out if 1000 <= r["doc_id"] < 2000)
        assert all(r["kept"] and r["threshold"] is None for r in out if r["lang"] == "xx")  # one trusted text tells nothing of others


def test_quality_shards(spark, monkeypatch):
    """With many blocks, each asks once for each of its n-grams of a model however its rows are spread, and the results are those of the broadcast way."""
    texts = [f"the cat {i % 7} sat on the mat {i % 5}" for i in range(60)]
    part = lambda rows, block: pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), pa.array([i % 3 - 1 for i in rows], pa.int16()), pa.array([texts[i] for i in rows])], names=["_block", "_code", "text"])
    asked = list(quality._ask(iter([part(range(20), 0), part(range(20, 40), 0), part(range(60), 1)]), "text", 5))
    got = [(block, code, g) for b in asked for block, code, g in zip(*(b.column(c).to_pylist() for c in ("block", "code", "g")), strict=True)]
    want = {(block, i % 3 - 1, int(g)) for block, upto in ((0, 40), (1, 60)) for i in range(upto) if i % 3 for g in quality.grams(pa.array([texts[i]]))[0]}
    assert len(got) == len(set(got)) and set(got) == want and len(asked) == 4

    monkeypatch.setattr(quality, "BLOCK_BYTES", 200)
    rows = [(i, t, "xx" if i % 11 == 0 else "en", "s") for i, t in enumerate(texts)] + [(100, None, "en", "s"), (101, "", None, "s"), (102, "le chat", None, "s")]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int").where("doc_id % 11 <> 0")
    one, many = ({r["doc_id"]: (r["perplexity"], r["threshold"], r["kept"]) for r in quality.classify(docs(spark, rows), lab, broadcast_grams=g).collect()} for g in (quality.BROADCAST_GRAMS, 0))
    assert one.keys() == many.keys() and len(one) == len(rows)
    assert all(a[2] == b[2] and a[:2] == (pytest.approx(b[0]), pytest.approx(b[1])) for a, b in ((one[i], many[i]) for i in one))


# 3

PAGE = """<body><header><h1>Site</h1></header><main><article><h1>T&eacute;l</h1><p>a <b>b</b>c&nbsp; d<p>second
 line</p><form><input><p>sub</p></form><ul><li>one<li>two</ul><section class="comments"><article>c1</article></section><aside>x</aside><p>end &#65;</article></main><script>var a="</p>";</script><footer>f</footer>"""
PLAIN = """<div id="top-nav" class="menu"><a href=/>Home</a></div><div class="cookie-notice">We use cookies</div><div class=content><h1>Title</h1><p>A first paragraph that is long enough to make the window sum surge well beyond it.</p><p>Short.</p></div><div class="comments"><p>Nice</p></div>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Tél\na bc d\nsecond line\none\ntwo\nend A"
    assert html.main_text(PLAIN) == "Title\nA first paragraph that is long enough to make the window sum surge well beyond it.\nShort."
    assert html.main_text("<article><p>cut &amp; off <b>mid") == "cut & off mid"
    odd = [None, "", "<", "plain words", "<p", "<article>" + "<p>x</p>" * 20_000, "<div class='ad'>only ads</div>"]
    assert [html.main_text(x) for x in odd] == ["", "", "<", "plain words", "", "\n".join(["x"] * 20_000), ""]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate([PAGE, None, PAGE])], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_page", F.lit(2))
    out = html.extract(df).orderBy("page_id").collect()
    assert [r["n_chars"] for r in out] == [len(html.main_text(PAGE)), 0, len(html.main_text(PAGE))]
    assert html.extract(df.where("false")).count() == 0


LAYOUTS = [f"<body><nav>Menu</nav>{a}<footer>f</footer></body>" for a in (
    "<div><p>{0}</p></div><div><p>{1}</p></div><div><p>{2}</p></div>",
    "<table><tr><td>{0}</td></tr><tr><td>{1}</td></tr><tr><td>{2}</td></tr></table>",
    "<section><h2>{0}</h2></section><section><p>{1}</p></section><section><h2>{2}</h2></section>",
    "<p>{0}</p><figure><img src=x></figure><p>{1}</p><div class=ad><p>Buy</p></div><p>{2}</p>",
    "<p>{0}</p><ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul><p>{1}</p><p>{2}</p>",
)] + [f"<body><div class='{c}'><article><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p></article></div></body>" for c in ("page has-sidebar", "no-sidebar", "post with-comments", "search-results-layout", "sidebar-left")]


@pytest.mark.parametrize("page", LAYOUTS)
def test_html_layouts(page):
    """Tag boundaries, figures, adverts and layout classes cost no part of a text."""
    parts = [f"Part {i} of the text, {'long enough to make the sum of a window surge by itself, ' * 2}end." for i in range(3)]
    assert html.main_text(page.format(*parts)) == "\n".join(parts)


def test_html_surroundings():
    """Comments and teasers stay out where class words leave more than they hide."""
    body = "<p>" + "The text of the page. " * 20 + "</p>"
    want = ("The text of the page. " * 20).strip()
    assert html.main_text(f"<div>{body}</div><div class=sidebar><article>Teaser</article></div><div class=comments><article>{body}{body}{body}</article></div>") == want
    assert html.main_text(f"<article class='post with-comments'>{body}</article><div class=related><article>{body}</article></div>") == want


def test_html_distribution():
    """Surge and dive against their definition, on random lines."""
    rng = random.Random(6)
    for case in range(400):
        marks = case % 3 == 0
        found = [(f"{i} " + "x" * rng.choice([1, 20, 60, 150]) if rng.random() < 0.8 else "", marks and rng.random() < 0.5, rng.choice([0.0, 0.2, 0.9])) for i in range(rng.randrange(0, 25))]
        texts = [f for f in found if f[0]]
        marked = any(f[1] for f in texts)
        length = [len(t) * ((inside if marked else share <= 0.5)) for t, inside, share in texts]
        n, w = len(length), html.WINDOW
        total = lambda i: sum(length[j] for j in range(i, min(i + w, n)))  # noqa: B023, E731
        # a line belongs to a run if it and all lines back to one with a length that begins the run are ahead of no empty window
        starts = [i for i in range(n) if length[i] and (i == 0 or not any(length[j] and all(total(k) for k in range(j, i + 1)) for j in range(i)))]
        spans = [(i, next((k for k in range(i, n) if not total(k)), n)) for i in starts]
        surging = [s for s in spans if marked or max(total(k) for k in range(*s)) >= html.SURGE] or sorted(spans, key=lambda s: (-sum(length[slice(*s)]), s[0]))[:1]
        want = "\n".join(texts[i][0] for i in range(surging[0][0], surging[-1][1]) if length[i]) if surging else ""
        assert html._body(found, w, html.SURGE) == (want, marked)


# 4


def test_lines(spark, edge, none):
    assert dedup_lines(none).count() == 0
    out = {r["doc_id"]: r for r in dedup_lines(edge).collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[5]["text"] == LONG and out[6]["text"] == "" and out[8]["text"] == EDGE[-1][1]
    passage = "This passage of more than fifty words " + text_of(50, 1, 10_000) + ". It goes on. " + text_of(20, 2, 10_000) + "."
    own = [text_of(40, 10 + i, 10_000) for i in range(5)]
    rows = [(i, f"{o}.\n{o[:9]}. {passage} {o[::-1]}.\nshort line.", "en", "s") for i, o in enumerate(own)]
    got = {r["doc_id"]: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert passage in got[0]["text"] and got[0]["n_removed"] == 0
    for i in range(1, 5):
        assert passage not in got[i]["text"] and "It goes on." not in got[i]["text"] and own[i] in got[i]["text"] and own[i][::-1] in got[i]["text"] and "short line." in got[i]["text"]


def test_lines_brute_force(spark):
    """All runs of 31 words that occurred before go, and no run under 16 words is lost."""
    rng = random.Random(4)
    pool = [text_of(rng.randrange(1, 12), s, 5000) + "." for s in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.1 else " \n".join(pool[(a := rng.randrange(55)) : a + rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 8))), "en", "s") for i in range(40)]
    got = {r["doc_id"]: r for r in dedup_lines(docs(spark, rows)).collect()}
    seen: set = set()
    for i, t, *_ in sorted(rows):
        ls = [(j, x.strip()) for j, x in enumerate(re.split(r"(?<=\n)|(?<=[.] )", t)) if x.strip()]
        gone = {j for r in got[i]["removed"] for j in range(r["lo"], r["hi"] + 1)}
        grams = []
        for a in range(len(ls)):
            n = 0
            for z in range(a, len(ls)):
                n += len(ls[z][1].split())
                if n >= 31:
                    key = tuple(x for _, x in ls[a : z + 1])
                    if key in seen:
                        assert gone & {j for j, _ in ls[a : z + 1]}, (i, a, z)
                    grams.append(key)
                    break
        seen.update(grams)
        assert all(sum(len(x.split()) for j, x in ls if r["lo"] <= j <= r["hi"]) >= 16 for r in got[i]["removed"])
        assert got[i]["text"] == "".join(x for j, x in enumerate(re.split(r"(?<=\n)|(?<=[.] )", t)) if j not in gone)


# 5


def test_packing(spark, edge, none):
    assert packing.pack(none, PATH).count() == 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rows = [*EDGE, *[(100 + i, text_of(i * 7 % 900, i), "en", "s") for i in range(60)], (200, "Hello  wörld don't 12 <|endoftext|> ÉCOLE!!! x​y\x1cz", "en", "s")]
    out = packing.pack(docs(spark, rows), PATH, 512).toPandas()
    want = defaultdict(int)
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 512)):
            want[i, k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in out.itertuples():
        got[None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    ends = out.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id")["length"].cumsum() - ends["length"] == ends["offset"]).all() and (out.groupby("sequence_id")["length"].sum() <= 512).all()
    assert out["sequence_id"].nunique() <= out["length"].sum() / 512 + 2


def test_plan():
    rng = np.random.default_rng(2)
    for case in ({}, {5: 1}, {2048: 3}, {1024: 7}, {1: 5000}, {700: 10, 1348: 10}, dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 2049, 3000), return_counts=True)], strict=True))):
        used = defaultdict(int)
        sequences = 0
        for times, lengths in packing.plan(case):
            assert sum(lengths) <= 2048
            sequences += times
            for x in lengths:
                used[x] += times
        assert dict(used) == case and sequences <= sum(k * v for k, v in case.items()) / 2048 * 1.02 + 1
    # of sequences that hold several pieces, patterns fill most
    found, by_pattern = packing.plan_on(case, 2048, *packing.GRIDS[0])
    assert by_pattern > 0.5 * sum(t for t, ls in found if len(ls) > 1)


# 6


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, edge, none, law, tmp_path):
    assert shard_documents(none).count() == 0
    assert shard_documents(edge, 3, law).count() == len(EDGE)
    rows = [(i, text_of(1 + i % 50, i), "en", "s") for i in range(700)] + [(5, "same", "en", "s")] * 300
    out = shard_documents(docs(spark, rows), 8, law).toPandas()
    size = out.groupby("shard")["size"].sum() if law == "bytes" else out.groupby("shard").size()
    assert len(size) == 8 and size.max() - size.min() <= (2 * out["size"].max() if law == "bytes" else 1)
    assert (out.sort_values("slot").groupby("shard")["slot"].apply(list).map(lambda s: s == list(range(len(s))))).all()
    assert out.sort_values(["shard", "slot"])["doc_id"].is_monotonic_increasing
    d = docs(spark, rows[:700])
    write_shards(d.select("doc_id", "text"), shard_documents(d, 4, law), str(tmp_path / law))
    assert spark.read.parquet(str(tmp_path / law)).count() == 700
    with pytest.raises(ValueError):
        shard_documents(d, 4, "luck")


# 7


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "ok": F.lit(2), "t": F.lit(3)})


BAD = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [1.0], 0), (906, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]


def test_vector_dup(spark, monkeypatch):
    assert near_duplicates(_vectors(spark, [])).count() == 0
    assert near_duplicates(_vectors(spark, BAD[:1])).collect()[0]["kept"]
    monkeypatch.setattr("gridroll.llm.vectordup.BLOCK", 64)  # crowded keys
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.12 * rng.standard_normal((30, 16)), np.repeat(base[:1], 5, 0), base[1] + 0.02 * rng.standard_normal((300, 16))]).astype(np.float32)
    out = near_duplicates(_vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD), 0.95).toPandas().set_index("vec_id").sort_index()
    assert len(out) == len(x) + 7 and (out.loc[900:, "n_links"] == 0).all() and out.loc[900:, "kept"].all()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = out.loc[: len(x) - 1]
    assert (found["n_links"].to_numpy() <= link.sum(1)).all() and found["n_links"].sum() >= 0.995 * link.sum()
    label = np.arange(len(x))
    for _ in range(50):
        np.minimum.at(label, np.nonzero(link)[0], label[np.nonzero(link)[1]])
    assert (found["component_id"].to_numpy() == label).mean() > 0.99


@pytest.mark.parametrize("shift", [0.0, 0.7, 1.5])
def test_vector_codes(shift):
    """Pairs at exactly the threshold share a key, and keys stay balanced however far the vectors lie from the origin."""
    rng = np.random.default_rng(5)
    x = vectordup.unit(rng.standard_normal((4000, 32)) + shift)
    coder = vectordup.learn(x, len(x), 0.95, 0.999)
    side = rng.standard_normal((1000, 32))
    side -= (side * x[:1000]).sum(1, keepdims=True) * x[:1000]
    near = 0.95 * x[:1000] + (1 - 0.95**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    k, k2 = coder.keys(x), coder.keys(near)
    assert (k[:1000] == k2).any(1).mean() >= 0.995
    comparisons = lambda keys: sum(((np.unique(c, return_counts=True)[1] ** 2.0).sum() - len(x)) / 2 for c in keys.T)
    tables = vectordup.n_tables(coder.bits, 0.95, 0.999)
    plain = vectordup.table_keys(x, [vectordup.learn_rotation(x, s) for s in range(-(-coder.bits * tables // 32))], coder.bits, tables)
    assert comparisons(k) < (0.7 if shift == 1.5 else 1.1) * comparisons(plain)
    for low in (0.3, 0.6):
        assert vectordup.learn(x, len(x), low, 0.99).tables <= vectordup.MOST_TABLES


# 8


def test_toxicity_model():
    """Scores against the definition: one set of n-grams a text, ratios that differ surely from none, and a fit at which the gradient vanishes."""
    texts = ["You  FOOL\tthere", "kind words", "", None, "fool fool fool", "words of the kind there"]

    def plain(t):
        b = re.sub(r"[\t-\r]", " ", f" {t or ''} ").encode().lower()
        return {(n, b[i : i + n]) for n in toxicity.ORDERS for i in range(len(b) - n + 1)}

    got = [set(f.tolist()) for f in toxicity.features(pa.array(texts))]
    number = {}
    for t, f in zip(texts, got, strict=True):
        assert len(f) == len(plain(t))
        for n, g in plain(t):
            number[n, g] = (int.from_bytes(g, "little") * (0x9E3779B97F4A7C15 + 2 * n) % (1 << 64)) >> (64 - toxicity.BITS)
            assert number[n, g] in f
    pos, neg = np.array([9.0, 50.0, 0.0]), np.array([9.0, 2.0, 1.0])
    r = toxicity.ratios(pos, neg, 100, 100)
    assert r[0] == 0 and r[2] == 0 and r[1] == pytest.approx(np.log(51 / 102) - np.log(3 / 102))
    rng = np.random.default_rng(1)
    sets = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y, scale, weight = (rng.random(80) < 0.4).astype(float), rng.standard_normal(12), rng.random(80) + 0.5
    coef, bias = toxicity.logistic(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), y, weight, scale, rounds=400)
    x = np.array([[j in f for j in range(12)] for f in sets]) * scale
    w = np.where(scale != 0, coef / scale, 0)
    e = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
    assert np.abs(x.T @ e + w).max() < 1e-3 and abs(e.sum()) < 1e-3
    model = toxicity.Model(np.bincount([number[4, b"fool"]], [2.0], 1 << toxicity.BITS), -1.0)
    assert model.score(pa.array(texts)) == pytest.approx([1 / (1 + np.exp(-z)) for z in (1, -1, -1, -1, 1, -1)])


def test_fixed_sample(spark):
    """The rows of the smallest hashes, the same however the table is cut; some fewer where one row is a third of them."""
    df = spark.createDataFrame([(i, "x") for i in range(3000)] + [(7, "x")] * 1500, "doc_id long, text string")
    a, b_ = (sorted(map(tuple, smallest(d, ["doc_id", "text"], 200, 4500).collect())) for d in (df, df.repartition(7)))
    assert a == b_ and 100 <= len(a) <= 200 and smallest(df, ["doc_id"], 9000, 4500).count() == 4500 and smallest(df.where("false"), ["doc_id"], 5, 0).count() == 0


def test_toxicity(spark, edge, none, labels):
    assert toxicity.score(none, labels).count() == 0
    out = toxicity.score(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert toxicity.score(edge, labels.where("false")).count() == len(EDGE)
    rows = [(i, text_of(30, i, 300) + (" you utter Moron" if i % 4 == 0 else "") + " " + text_of(10, i + 9000, 300), "en", "s") for i in range(600)]
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(spark, rows), lab).toPandas()
    held = got[got["held_out"]]
    assert set(held["doc_id"]) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["predicted"] == (held["doc_id"] % 4 == 0)).mean() > 0.97


# 9


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_jaccard_family(spark, edge, monkeypatch):
    """A large family of edited copies, chained and apart, with n-grams that are split over fragments: components equal brute force."""
    monkeypatch.setattr("gridroll.llm.ngram_join.FRAGMENT", 40)
    monkeypatch.setattr("gridroll.llm.ngram_join.OFTEN", 2)
    rng = random.Random(3)
    base = text_of(60, 5, 5000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w), "en", "s"))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t, *_ in rows)]
    label = list(range(150))
    for a in range(150):
        for b_ in range(a):
            both = len(sets[a] & sets[b_])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b_]) - both):
                x, y = label[a], label[b_]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join(docs(spark, rows).repartition(4)).collect()}
    assert got == dict(enumerate(label)) and 2 < len(set(label)) < 150


def test_jaccard(spark, edge, none):
    assert jaccard_join(none).count() == 0
    out = {r["doc_id"]: r for r in jaccard_join(edge).collect()}
    assert [out[i]["n_shingles"] for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 2] and out[6]["component_id"] == 5 and out[None]["component_id"] == 7
    rng = random.Random(8)
    rows = []
    for b in range(12):  # groups of edited copies around a base, some with a passage that all share
        base = text_of(rng.randrange(5, 90), b, 4000).split()
        for _ in range(rng.randrange(1, 9)):
            w = [f"e{rng.randrange(10**6)}" if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else x for x in base]
            rows.append((len(rows), " ".join(w + (["shared"] * 3 + text_of(20, 77).split() if rng.random() < 0.5 else [])).title(), "en", "s"))
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, c = parent[i], parent[j]
                parent = {k: min(a, c) if v in (a, c) else v for k, v in parent.items()}
    got = {r["doc_id"]: r for r in jaccard_join(docs(spark, rows), Fraction(3, 4)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == parent and all(r["n_shingles"] == len(sets[i]) for i, r in got.items())


# 10


def test_ann(spark, monkeypatch):
    assert ann.search(_vectors(spark, []), _vectors(spark, [])).count() == 0
    monkeypatch.setattr("gridroll.llm.ann.CANDIDATES", 150)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((400, 16)), np.repeat(rng.standard_normal((1, 16)), 40, 0)]).astype(np.float32)
    v = _vectors(spark, [(i, a.tolist(), 0) for i, a in enumerate(x)] + BAD)
    out = ann.search(v.where("vec_id % 20 = 0"), v, 10).toPandas()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], s[q, g["vec_id"]], rtol=1e-12)
        hit += len(set(g["vec_id"]) & set(np.lexsort((np.arange(len(x)), -s[q]))[:10]))
    assert out["query_id"].nunique() == 22 and hit >= 0.97 * 220
    few = _vectors(spark, [(i, a.tolist(), 0) for i, a in enumerate(x[:3])])
    assert ann.search(few, few, 10).count() == 6


def test_ann_cells(spark, monkeypatch):
    """Vectors in clusters: a query visits few cells and finds nearly all it would by brute force."""
    monkeypatch.setattr("gridroll.llm.ann.CELLS_FROM", 500)
    monkeypatch.setattr("gridroll.llm.ann.CANDIDATES", 100)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[:900] = x[0] + 0.01 * rng.standard_normal((900, 16))  # one cell holds a third of all
    cells = ann.Cells(x.astype(np.float64), len(x), 10)
    assert len(cells.centres) > 20 and cells.visits <= len(cells.centres) // 2
    base = _vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = ann.search(base.where("vec_id % 20 = 0"), base, 10).toPandas()
    y = x.astype(np.float64)
    s = y @ y.T
    np.fill_diagonal(s, -np.inf)
    asked = np.arange(0, 3000, 20)
    want = {q: set(np.lexsort((np.arange(3000), -s[q]))[:10].tolist()) for q in asked}
    assert (got.groupby("query_id").size() == 10).all() and set(got["query_id"]) == set(asked.tolist())
    assert sum(len(want[q] & set(g["vec_id"])) for q, g in got.groupby("query_id")) >= 0.95 * 10 * len(asked)
    assert np.allclose(got["score"], s[got["query_id"], got["vec_id"]], rtol=1e-12)


def test_ann_sizes(spark, monkeypatch):
    """The nearest are those of brute force, with cells and without, so that no size of the table changes them."""
    monkeypatch.setattr("gridroll.llm.ann.CANDIDATES", 100)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 2000)] + 0.3 * rng.standard_normal((2000, 16))).astype(np.float32)
    x[:12] = 1.5 * rng.standard_normal((12, 16))  # some in no cluster
    x[60:100] = x[60]  # more equal vectors than neighbours
    base = _vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    y = x.astype(np.float64)
    s = np.einsum("ij,kj->ik", y, y)
    np.fill_diagonal(s, -np.inf)
    want = {q: np.lexsort((np.arange(2000), -s[q]))[:10].tolist() for q in range(0, 2000, 20)}
    for cells_from in (500, 20_000):
        monkeypatch.setattr("gridroll.llm.ann.CELLS_FROM", cells_from)
        cells = ann.Cells(y, len(y), 10)
        assert (cells.visits < len(cells.centres)) == (cells_from == 500)
        got = ann.search(base.where("vec_id % 20 = 0"), base, 10).toPandas().sort_values(["query_id", "rank"])
        assert got.groupby("query_id")["vec_id"].agg(list).to_dict() == want
