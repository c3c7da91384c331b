"""Quality, toxicity, decontamination and extraction: brute force, gradients and held-out accuracy."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, html_extract, quality_rules, toxicity, weak_quality


def table(name, sf="/root/testdata/sf0.01"):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (None, "a b c a b c"), (9005, "x y z " * 30), (9006, "l\nl\n \nl\nm"), (9006, "l\nl\n \nl\nm"), (9007, "# * $ %%%|<>& a"), (9008, "\n".join(f"line {k % 3000} of very many" for k in range(16_000)))]


def counts(t):
    t = t or ""
    w = t.encode().split()
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def gram_buckets(t, bits):
    h = [xxhash.xxh64_intdigest(w, 42) for w in (t or "").encode().split()]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [x & (1 << bits) - 1 for x in h + pairs]


def test_quality_rules_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents", "/root/testdata/sf0.001")] + EDGES
    labels = [(r["doc_id"], r["quality"]) for r in table("labels", "/root/testdata/sf0.001")] + [(None, 1), (1, None)]
    bits, prior, threshold = 10, 8.0, -60_000
    good = {i for i, q in labels if q == 1 and i is not None}
    grams = [gram_buckets(t, bits) for _, t in docs]
    raw = Counter(b for g in grams for b in g)
    target = Counter(b for (i, _), g in zip(docs, grams, strict=True) if i in good for b in g)
    r, t, n = sum(raw.values()), sum(target.values()), 1 << bits
    weight = {b: float(np.floor(np.log((target[b] + prior * n * c / r) / ((t + prior * n) * c / r)) * 1e6 + 0.5)) for b, c in raw.items()}
    got = quality_rules.quality_rules(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, weights int"), spark.createDataFrame(labels, "doc_id long, quality int"), bits=bits, threshold=threshold / 1e6).collect()
    assert len(got) == len(docs)
    want = []
    for (i, text), g in zip(docs, grams, strict=True):
        base = counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want.append((i, *base, failed, not failed and sum(weight[b] for b in g) >= threshold * max(1, len(g))))
    key = lambda x: (x[0] is not None, *(v or 0 for v in x))
    for a, b in zip(sorted((tuple(x)[:8] for x in got), key=key), sorted(want, key=key), strict=True):
        assert a == b


def test_quality_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60))))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_rules(docs, labels, bits=8).first().kept
    assert quality_rules.quality_rules(docs.limit(0), labels, bits=8).count() == 0


def drawn_votes(n=20_000):
    """Fine documents and two poor kinds; bars fires on a fifth of the fine ones too, where the others of its kind vote fine."""
    rng = np.random.default_rng(1)
    kind = rng.choice(3, n, p=(0.85, 0.1, 0.05))
    chances = {"signs": (0.001, 0.9, 0.0), "signed words": (0.002, 0.6, 0.0), "bars": (0.2, 0.5, 0.0), "capitals": (0.01, 0.0, 0.95), "shouting": (0.001, 0.0, 0.9)}
    votes = np.ones((n, len(weak_quality.VOTERS)), np.int64)
    for v, chance in chances.items():
        k = weak_quality.VOTERS.index(v)
        votes[:, k] = np.where(rng.random(n) < np.array(chance)[kind], 0, 1)
    votes[rng.random(votes.shape) < 0.1] = 2
    true = np.array([chances.get(v, (1e-9, 1e-9, 1e-9)) for v in weak_quality.VOTERS]).clip(1e-9, 1 - 1e-9)
    log = np.log([0.85, 0.1, 0.05]) + (votes == 0) @ np.log(true) + (votes == 1) @ np.log1p(-true)
    return kind, votes, log.argmax(1) == 0


def test_estimate_finds_accurate_voters():
    kind, votes, best = drawn_votes()
    code = votes @ 3 ** np.arange(votes.shape[1])
    found, n = np.unique(code, return_counts=True)
    posterior, chance, share = weak_quality.estimate(found, n)
    of = weak_quality.VOTERS.index
    assert np.abs(share[:3] - (0.85, 0.1, 0.05)).max() < 0.01
    assert np.abs(chance[of("signs"), :2] - (0.001, 0.9)).max() < 0.02
    assert abs(chance[of("bars"), 0] - 0.2) < 0.02 and abs(chance[of("bars"), 1] - 0.5) < 0.05
    fine = posterior[np.searchsorted(found, code)] >= 0.5
    assert (fine == (kind == 0)).mean() > (best == (kind == 0)).mean() - 0.005  # near what the true chances give
    lone = (votes[:, of("bars")] == 0) & ((votes == 0).sum(1) == 1) & (votes[:, of("signs")] == 1)
    assert lone.sum() > 1000 and fine[lone].all()  # a poor vote alone that a better voter contradicts


def test_estimate_against_loops():
    """The same estimation, document by document."""
    _, votes, _ = drawn_votes(300)
    found, n = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_counts=True)
    kinds = [[weak_quality.VOTERS.index(v) for v in k] for k in weak_quality.KINDS]
    size = 1 + len(kinds)
    rows = votes.tolist()
    likely = []
    for v in rows:
        poor = [sum(v[k] == 0 for k in kind) / max(1, sum(v[k] < 2 for k in kind)) for kind in kinds]
        own = [x + 0.01 for x in (1 - max(poor), *poor)]
        likely.append([x / sum(own) for x in own])
    for _ in range(30):
        chance = []
        for k in range(len(weak_quality.VOTERS)):
            chance.append([])
            for c in range(size):
                poor = sum(w[c] for v, w in zip(rows, likely, strict=True) if v[k] == 0)
                cast = sum(w[c] for v, w in zip(rows, likely, strict=True) if v[k] < 2)
                chance[-1].append((poor + 8 * (0.25 if c else 0.01)) / (cast + 8))
        share = [(sum(w[c] for w in likely) + 8 / size) / (len(rows) + 8) for c in range(size)]
        likely = []
        for v in rows:
            own = [share[c] * np.prod([chance[k][c] if x == 0 else 1 - chance[k][c] for k, x in enumerate(v) if x < 2]) for c in range(size)]
            likely.append([x / sum(own) for x in own])
    posterior = weak_quality.estimate(found, n, rounds=30)[0]
    for v, w in zip(rows, likely, strict=True):
        assert posterior[np.searchsorted(found, sum(x * 3**k for k, x in enumerate(v)))] == pytest.approx(w[0], abs=1e-9)


def test_weak_quality_agrees_with_labels(spark):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in table("documents")] + EDGES, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = weak_quality.weak_quality(docs).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[9001] and not kept[9002] and not kept[9003]
    labels = table("labels")
    assert np.mean([kept[r["doc_id"]] for r in labels if r["quality"] == 1]) > 0.99
    assert np.mean([kept[r["doc_id"]] for r in labels if r["quality"] == 0]) < 0.1
    assert weak_quality.weak_quality(docs.limit(0)).count() == 0


def test_network_gradient():
    n = toxicity.Network(length=5, stride=3)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    texts, y = ["you are an idiot and fool today ok yes", "nice day", "hello there my good old friend again"], np.array([1.0, 0, 0])

    def loss():
        w = toxicity.Words(texts)
        x = n.inputs(w).astype(np.float64)
        text, first, size = n.windows(w.at)
        z = n.logits({k: x @ n.p[f"in_{k}"] + n.p[f"bias_{k}"] for k in "fb"}, *n.index(w, first, size))
        whole = np.array([np.log(np.exp(3 * z[text == d]).sum()) / 3 for d in range(3)])
        return np.log1p(np.exp(np.where(y > 0, -whole, whole))).mean()

    g = n.gradient(texts, y)
    for k in ("rec_f", "rec_b", "in_f", "attend", "out", "tri", "one"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        v = n.p[k][i]
        n.p[k][i] = v + 1e-2
        up = loss()
        n.p[k][i] = v - 1e-2
        down = loss()
        n.p[k][i] = v
        assert (up - down) / 2e-2 == pytest.approx(g[k][i], rel=1e-3, abs=1e-6)


def test_windows_cover_whole_texts():
    n = toxicity.Network()
    at = np.array([0, 0, 5, 29, 53, 153])
    text, first, size = n.windows(at)
    for d in range(5):
        own = {w for t, f, s in zip(text, first, size, strict=True) if t == d for w in range(f, f + s)}
        assert own == set(range(at[d], at[d + 1]))


def test_toxicity_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents", "/root/testdata/sf0.001")]
    frame = spark.createDataFrame(docs + EDGES, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in table("labels", "/root/testdata/sf0.001")] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, marks).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (9001, 9002, 9003)} == {0.0}
    assert toxicity.toxicity(frame.limit(0), marks.limit(0)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """On a table with some hundreds of toxic documents; a few tens teach the network too few words to judge it by."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id")
    held = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    clean = np.array([r.score for r in held if not r.toxic])
    toxic = np.array([r.score for r in held if r.toxic])
    assert np.mean([(clean < s).mean() + 0.5 * (clean == s).mean() for s in toxic]) > 0.9
    assert (toxic >= 0.3).mean() > 0.8
    assert (clean >= 0.3).mean() < 0.04


def tile_by_hand(a, b, least):
    """Greedy string tiling as it is defined: the longest common unmarked run, again and again."""
    fa, fb, done = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and fa[p + n] and fb[t + n] and a[p + n] == b[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return done
        fa[p : p + n], fb[t : t + n], done = [False] * n, [False] * n, done + n


@pytest.mark.parametrize(("letters", "most", "count"), [(4, 30, 150), (2, 45, 500), (3, 80, 300)])
def test_tiling_is_greedy(letters, most, count):
    rng = random.Random(letters)
    for _ in range(count):
        a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, most))] for _ in range(2))
        for least in (2, 5):
            assert decontaminate.tiled(np.array(a, np.uint64), np.array(b, np.uint64), least) == tile_by_hand(a, b, least)


@pytest.mark.parametrize("most_bytes", [16 << 20, -1])
def test_decontamination_beside_a_common_phrase(spark, most_bytes):
    """A phrase that all documents and items have makes no pairs by itself; results are those of tiling every pair."""
    rng = random.Random(11)
    phrase, words = "please read the terms of use first", [f"w{k}" for k in range(40)]
    items = [(k, " ".join([*rng.choices(words, k=9), phrase, *rng.choices(words, k=9)])) for k in range(12)] + [(50, phrase)]
    docs = []
    for k in range(60):
        own = items[k % 12][1].split()
        cut = rng.randrange(4, len(own))
        docs.append((k, " ".join([*rng.choices(words, k=20), phrase, *own[:cut], *rng.choices(words, k=6), *own[cut:][: rng.randrange(9)]])))
    want = set()
    number = {}
    code = lambda t: [number.setdefault(w, len(number)) for w in t.split()]
    for i, t in docs:
        for j, u in items:
            a = code(u)
            n = tile_by_hand(a, code(t), 5)
            if n >= 0.5 * len(a):
                want.add((i, j, n, len(a)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes)
    assert {(r.doc_id, r.item_id, r.n_marked, r.n_tokens) for r in got.collect()} == want


def test_common_seeds_are_left_out(spark):
    seeds = [(b"i", 1, 1, 15)] + [(b"i", s, 1, 15) for s in range(2, 12)]
    hits = [(bytes([k]), 1) for k in range(50)] + [(bytes([k % 3]), s) for k, s in enumerate(range(2, 12))]
    kept = decontaminate.rare_seeds(spark.createDataFrame(seeds, "other binary, seed long, times int, n int"), spark.createDataFrame(hits, "id binary, seed long"), 5, 0.5)
    assert sorted(r.seed for r in kept.collect()) == list(range(2, 12))


@pytest.mark.parametrize("most_bytes", [16 << 20, -1])
def test_decontamination(spark, most_bytes):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "kappa lambda mu nu. Eta theta iota kappa lambda mu! filler words here alpha, BETA gamma delta epsilon zeta"
    docs = [(1, f"before {passage} after"), (2, moved), (3, "alpha beta gamma delta epsilon is all"), (4, None), (5, ""), (None, passage.upper()), (1, f"before {passage} after")]
    frame = spark.createDataFrame([(*d, "clash", k, "c") for k, d in enumerate(docs)], "doc_id long, text string, matches string, id long, seed string")
    items = spark.createDataFrame([(7, passage), (7, "alpha beta gamma delta epsilon zeta"), (8, "too short"), (9, None), (None, passage)], "item_id long, text string")
    got = decontaminate.matched(frame, items, most_bytes=most_bytes).collect()
    assert len(got) == len(docs) and sorted(r.id for r in got) == list(range(len(docs))) and {r.seed for r in got} == {"c"}
    hits = sorted((r.doc_id or 0, r.text or "", [(m.item_id, m.n_marked, m.n_tokens) for m in r.matches]) for r in got)
    by = {(i, t[:6]): m for i, t, m in hits}
    assert by[(1, "before")] == [(7, 12, 12)] or by[(1, "before")] == [(7, 6, 6)]
    assert by[(2, "kappa ")][0][0] == 7
    assert by[(3, "alpha ")] == [(7, 5, 6)]
    assert by[(4, "")] == by[(5, "")] == []
    assert by[(0, "ALPHA ")][0][0] == 7
    assert decontaminate.matched(frame, items.limit(0), most_bytes=most_bytes).where("size(matches) > 0").count() == 0
    assert decontaminate.matched(frame.limit(0), items, most_bytes=most_bytes).count() == 0


@pytest.mark.parametrize("most_bytes", [16 << 20, -1])
def test_decontamination_by_named_items_and_long_texts(spark, most_bytes):
    words = [f"w{k}" for k in range(200)]
    long = " ".join(words[k * 7 % 200] for k in range(60_000)) + " " + " ".join(words[:40]) + " end"
    items = spark.createDataFrame([("first", " ".join(words[:40])), ("other", " ".join(words[100:140:2]))], "item_id string, text string")
    docs = spark.createDataFrame([("a", long), ("b", "only w1 w2 w3 w4 w5 w6")], "doc_id string, text string")
    got = decontaminate.contaminated(docs, items, most_bytes=most_bytes).collect()
    assert [tuple(r)[:4] for r in got] == [("a", "first", 40, 40)]


def test_decontamination_finds_planted_passages(spark):
    docs, items = table("documents"), table("benchmark")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    own = {r["doc_id"]: plain(r["text"]) for r in docs}
    want = {(i, r["item_id"]) for r in items for i, t in own.items() if f" {plain(r['text'])} " in f" {t} "}
    d = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert want


def test_labeller_gradient():
    m = html_extract.Labeller(embed=4, hidden=3)
    s = html_extract.Sequence()
    for p in ("<body><nav><a>x y</a></nav><article><h1>T</h1><p>hello there.</p><p>b</p></article>", "<p>one</p>"):
        s.add(html_extract.leaves(p))
    y = np.array([0, 1, 1, 1, 1.0])

    def loss():
        z = m.logits(s)
        return np.log1p(np.exp(-np.where(y > 0, z, -z))).mean()

    for k, g in m.gradient(s, y).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        v = m.p[k][i]
        m.p[k][i] = v + 1e-5
        up = loss()
        m.p[k][i] = v - 1e-5
        down = loss()
        m.p[k][i] = v
        assert (up - down) / 2e-5 == pytest.approx(g[i], rel=1e-4, abs=1e-8)


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> --><article><h1>Main &amp; title</h1><p>First&nbsp;line <b>bold</b>,
 second<br>third.<p>Next para&#233;.</p><div class="ad">Buy.</div><ul><li>point one</li><li>point two</li></ul></article><section class="comments"><p>Nice.</p></section><script>var t="</p>";</script><footer>&copy; x</footer></body></html>"""


def test_leaves_of_a_page():
    blocks = html_extract.leaves(PAGE)
    assert [b.text for b in blocks] == ["Site", "Home", "We use cookies.", "Main & title", "First line bold, second", "third.", "Next paré.".replace("paré", "paraé"), "Buy.", "point one", "point two", "Nice.", "© x"] or "br" in html_extract.INLINE
    assert blocks[1].linked == 1.0
    assert html_extract.leaves(None) == html_extract.leaves("") == []
    assert html_extract.leaves("plain < text & more")[0].text == "plain < text & more"


def test_leaves_without_end_tags():
    texts = lambda p: [b.text for b in html_extract.leaves(p)]
    assert texts("<head><title>x</title><style>p{}</style><body><article><p>One.</p></article>") == ["One."]
    assert texts("<html><head><title>x</title><meta charset=utf-8><link href=a></head><p>One.</p>") == ["One."]
    assert all("head" not in b.path for b in html_extract.leaves("<head><script>1</script><article><p>One.</article>"))
    assert texts("<p>One <svg class='a>b' width=\"1\" /> two</p><svg><path d='x'/><text>no</text></svg><p>Three.</p>") == ["One two", "Three."]
    assert texts("<svg/><svg-icon>Four</svg-icon><p>Five</p><script src='a'/>no</script><p>Six") == ["Four", "Five", "Six"]


def test_attributes_as_the_tokeniser_takes_them():
    texts = lambda p: [b.text for b in html_extract.leaves(p)]
    assert texts("<article><p title=it's>One it's.<p>Two.</article>") == ["One it's.", "Two."]
    assert texts('<article><p title="a>Two.<p>Three.</article>') == ["Two.", "Three."]
    assert texts('<p title="a>b" x=\'c>d\' y=e/>One</p><a href=x>y</a>') == ["One", "y"]
    assert html_extract.leaves("<div data-x=\"class='nav'\" class = 'story  main-text'>One</div>")[0].path == ("div", "story", "main", "text")


def test_ends_without_end_tags():
    paths = lambda p: [(b.path, b.text) for b in html_extract.leaves(p)]
    assert paths("<p>a<div>b<table><tr><td>x<p>y<td>z<tr><td>w</table>c") == [(("p",), "a"), (("div",), "b"), (("div", "table", "tr", "td"), "x"), (("div", "table", "tr", "td", "p"), "y"), (("div", "table", "tr", "td"), "z"), (("div", "table", "tr", "td"), "w"), (("div",), "c")]
    assert paths("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>") == [(("ul", "li"), "a"), (("ul", "li", "ul", "li"), "b"), (("ul", "li", "ul", "li"), "c"), (("ul", "li"), "d"), (("ul", "li"), "e")]
    assert paths("<dl><dt>a<dd>b<p>c<dt>d</dl>") == [(("dl", "dt"), "a"), (("dl", "dd"), "b"), (("dl", "dd", "p"), "c"), (("dl", "dt"), "d")]


def test_long_pages_take_time_in_proportion():
    import time

    for part in ("<tr><td>x", "<dt>x<dd>y", "<div>x", "<section><p>x", "<ul><li>x", "</b></q></x>y", "<p title='>x"):
        took = []
        for n in (2_000, 16_000):
            began = time.perf_counter()
            found = html_extract.leaves(part * n)
            took.append(time.perf_counter() - began)
            assert sum(len(b.path) for b in found) <= 64 * max(1, len(found))
        assert took[1] < 40 * took[0] + 0.5


def test_names_of_containers_label_nothing():
    text = "<h1>Title</h1>" + "<p>A long sentence of the article itself.</p>" * 8
    for page in (f"<body class='single right-sidebar'><article>{text}</article><aside><p>Side.</p></aside>", f"<article class='post has-share-bar'>{text}</article>", f"<div class='content with-comments'>{text}</div><div class=comments><p>Nice.</p></div>", f"<form id=aspnetForm><div>{text}</div><nav><a href=x>Home</a></nav></form>"):
        found = html_extract.leaves(page)
        assert [y for b, y in zip(found, html_extract.weak_labels(found), strict=True) if "article itself" in b.text or b.text == "Title"] == [1] * 9
        assert not any(y for b, y in zip(found, html_extract.weak_labels(found), strict=True) if b.text in ("Side.", "Nice.", "Home"))


def test_labels_follow_the_article_on_other_pages(spark):
    """A labeller fitted to the given pages keeps articles in containers with telling names."""
    model = html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html"), "html", 240, 4_800_000)
    text = "<h1>A title of some words</h1>" + "".join(f"<p>This is sentence number {k} of the article, which goes on for a while.</p>" for k in range(8))
    for page in (f"<body class='single right-sidebar'><article>{text}</article>", f"<article class='post has-share-bar'>{text}</article>", f"<div class='content with-comments'>{text}</div>", f"<article>{text}</article>"):
        s = html_extract.Sequence()
        found = html_extract.leaves(page)
        s.add(found)
        assert (model.logits(s) >= 0).all(), page


def test_forward_pass_by_hand():
    """The labeller's logits against its equations, a block, a gate and a unit at a time."""
    import math

    m = html_extract.Labeller(embed=3, hidden=2, seed=9)
    pages = [html_extract.leaves("<nav><a href=x>Home page</a></nav><article><h1>T</h1><p>Hello there.</p></article>"), html_extract.leaves("<p>one")]
    s, want = html_extract.Sequence(), []
    sig = lambda v: 1 / (1 + math.exp(-v))
    for page in pages:
        s.add(page)
        one = html_extract.Sequence()
        one.add(page)
        rows = []
        for paths, words, figures in zip(one.paths, one.words, one.figures, strict=True):
            path = [sum(m.p["path"][i][k] for i in paths) / math.sqrt(len(paths)) for k in range(3)]
            rows.append(path + [sum(m.p["word"][i][k] for i in words) / len(words) for k in range(3)] + figures)
        states = {}
        for way, order in (("f", range(len(rows))), ("b", reversed(range(len(rows))))):
            h, c = [0.0] * 2, [0.0] * 2
            for t in order:
                a = [m.p[f"bias_{way}"][g] + sum(x * m.p[f"in_{way}"][k][g] for k, x in enumerate(rows[t])) + sum(v * m.p[f"rec_{way}"][k][g] for k, v in enumerate(h)) for g in range(8)]
                c = [sig(a[2 + u]) * c[u] + sig(a[u]) * math.tanh(a[6 + u]) for u in range(2)]
                h = [sig(a[4 + u]) * math.tanh(c[u]) for u in range(2)]
                states[way, t] = h
        for t, row in enumerate(rows):
            top = states["f", t] + states["b", t] + row
            want.append(m.p["bias"][0] + sum(x * w for x, w in zip(top, m.p["out"], strict=True)))
    assert m.logits(s) == pytest.approx(want)


def test_inputs_take_whole_paths_and_texts():
    deep = tuple(f"n{k}" for k in range(60))
    one, other = html_extract.Sequence(), html_extract.Sequence()
    text = " ".join(["word"] * 100)
    one.add([html_extract.Block(("nav", *deep), text + " end", 0.0)])
    other.add([html_extract.Block(("main", *deep), text + " fin", 0.0)])
    assert one.paths != other.paths and one.words != other.words
    assert len(one.paths[0]) == 61 and len(one.words[0]) == 101


def test_long_pages_are_trained_on(spark):
    page = "<html><body>" + "".join(f"<nav><p>Go to {k}.</p></nav><article><p>{'Said once more. ' * 9}</p></article>" for k in range(150)) + "</body></html>"
    assert len(page) > 20_000
    frame = spark.createDataFrame([(page + f"<!-- {k} -->",) for k in range(6)], "html string")
    model = html_extract.train(frame, "html", 240, 100_000)
    assert any((v != html_extract.Labeller().p[n]).any() for n, v in model.p.items())


def test_extraction(spark):
    pages = table("pages", "/root/testdata/sf0.001")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages] + [(901, "u", None), (902, "u", ""), (903, None, PAGE), (903, None, PAGE), (None, "u", PAGE)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(frame).collect()
    assert len(got) == len(rows)
    want = "Main & title First line bold, second third. Next paraé. point one point two"
    assert {r.text for r in got if r.page_id == 903 or r.page_id is None} == {want}
    assert {(r.text, r.n_chars) for r in got if r.page_id in (901, 902)} == {("", 0)}
    article = {r["page_id"]: " ".join(" ".join(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]).split()) for _ in [0]) for r in pages}
    import html

    exact = [html.unescape(article[r.page_id]) == r.text for r in got if r.page_id in article]
    assert np.mean(exact) > 0.98
    assert html_extract.extract(frame.limit(0)).count() == 0
