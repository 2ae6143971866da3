"""The training-data operators against brute force, exact round trips and odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd_tables import CLASHES, DOCS, ODD_TEXTS

from corpusmill.llm import components, lm_scores, pieces, quality_rules, simhash, topk, toxicity, url_filter


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# 1
def test_url_filter_propagates_blocks(spark):
    page = lambda i, url, html=None: (i, url, html)
    pages = spark.createDataFrame(
        [
            page(1, "http://a.example.net/x", '<link rel="canonical" href="http://b.EXAMPLE.com/de/1">'),
            page(2, "http://b.example.com/de/1"),
            page(3, "http://c.example.net/y", "<meta http-equiv='refresh' content='0; url=http://a.example.net/x'>"),
            page(4, "https://a.example.net/x#top"),
            page(5, "http://d.org/p", '<link href="http://c.example.net/y" rel=canonical>'),
            page(6, "http://e.example.org/en/12"),
            page(7, None), page(8, "nonsense"), page(9, "http://f.net"), page(10, "http://A.example.net?q=/de/"), page(2, "http://b.example.com/de/1"),
        ],
        "page_id long, url string, html string",
    )
    got = url_filter.url_filter(pages, url_filter.page_links(pages)).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got} == {
        (1, None, "block"), (2, "com/de/", "block"), (3, None, "block"), (4, None, "block"), (5, "org/", "allow"), (6, "example.org/en/1", "block"),
        (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"),
    }
    assert len(got) == 11
    odd = spark.createDataFrame(
        [
            page(1, "http://a.net?x=1&y=2", '<link rel=stylesheet href="http://no.net/s"><link rel="nofollow canonical" href="http://b.com/de/1?p=1&amp;q=2"><link rel="canonical" href="http://c.net">'),
            page(2, "http://c.net/"),
            page(3, "http://e.net/z", "<meta http-equiv=refresh content=\"1; url=http://c.net#top\"><meta http-equiv='refresh' content='url=http://a.net/?x=1&#38;y=2'>"),
            page(4, "http://b.com/de/1?p=1&q=2"), page(5, "http://no.net/s"), page(6, "http://q.org", '<link rel="canonical" href="http://c.net/">'),
        ],
        "page_id long, url string, html string",
    )
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.url_filter(odd, url_filter.page_links(odd)).collect()}
    assert got == {(1, None, "block"), (2, None, "block"), (3, None, "block"), (4, "com/de/", "block"), (5, None, "allow"), (6, None, "block")}
    many = url_filter.RULES + [("block", f"h{i}.zz", "/") for i in range(300)]
    assert sorted(map(str, url_filter.with_rule(url_filter.with_parts(pages), many).select("page_id", "rule").collect())) == sorted(map(str, url_filter.with_rule(url_filter.with_parts(pages)).select("page_id", "rule").collect()))
    none = pages.limit(0)
    assert url_filter.url_filter(none, url_filter.page_links(none)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {x for e in edges for x in e if all(set(f) == {x} for f in edges if x in f)}
    assert got == {x: root(x) for x in parent if x not in loops}


# 2
def test_pieces_round_trip(spark, odd, empty):
    sp = pieces.Pieces(pieces.default_model())
    for t in [*ODD_TEXTS, " lead", "trail ", "  two", "a\nb \n c", "▁▁ a▁b", "\x00\x7f", "é"]:
        assert sp.decode(sp.encode(t)) == (t or "")
    assert all(r["round_trip"] for r in pieces.digests(odd, pieces.default_model()).collect())
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(odd, pieces.default_model())
    ids = pieces.encode(odd, pieces.default_model(), "ids_")
    assert ids.columns == [c for c in odd.columns if c != "text"] + ["ids_"] and all(r[c] == f"own {c}" for r in ids.collect() for c in CLASHES)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(ids, pieces.default_model(), "ids_").collect()}
    assert back == {**{i: t or "" for i, t in enumerate(ODD_TEXTS)}, None: "no id at all"}
    assert pieces.digests(empty, pieces.default_model()).count() == 0


def test_viterbi_is_best(spark):
    sp = pieces.Pieces(pieces.default_model())
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    score = {sp.names[i]: float(lib.get_score(i)) for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = "▁" + "".join(rng.choice(list("thereanding▁漢\x01"), size=rng.integers(1, 14)))
        best = [0.0] + [-np.inf] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(end):
                step = score.get(s[start:end], sp.unknown if end - start == 1 else -np.inf)
                best[end] = max(best[end], best[start] + step)
        ids, total, raw = sp.viterbi(s), 0.0, bytearray()
        for i in ids:
            if i in sp.byte_of:
                raw.append(sp.byte_of[i])
            else:
                total += score[sp.names[i]]
        total += sp.unknown * len(raw.decode())
        assert total == pytest.approx(best[-1])


# 5
def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(5)
    plain = ["river", "stone", "cloud", "meadow", "lantern", "copper", "harbor", "willow"]
    rows, gold = [], []
    for i in range(1500):
        w = list(rng.choice(plain, 40))
        bad = i % 6 == 0
        if bad:
            w += list(rng.choice(["idiot", "moron", "scum", "worthless"], 3)) if i % 12 else [f"grukk{x}" for x in "abc"]
        rows.append((i, " ".join(rng.permutation(w)), "en", "s", 0))
        gold.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    got = toxicity.scored(docs, labels(spark, gold)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    out = toxicity.scored(odd, labels(spark), "own").collect()
    assert len(out) == odd.count() and all(0 <= r["own"] <= 1 for r in out)
    assert toxicity.scored(empty, labels(spark)).count() == 0


# 6
def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(400)]  # one very common vector: ties go to the smaller id
    rows += [(50 * 100, None, 0), (50 * 101, [1.0] * 7 + [None], 0), (50 * 102, [float("nan")] * 8, 0), (50 * 103, [1.0, 2.0], 0), (50 * 104, [], 0), (None, [1.0] * 8, 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v, 5).collect()))
    clean = [(r["vec_id"], np.array(r["v"])) for r in v.collect()]
    want = []
    for q, x in clean:
        if q % 50 == 0:
            s = sorted((-int(x @ y), d) for d, y in clean if d != q and len(y) == len(x))[:5]
            want += [(q, k + 1, d, -n) for k, (n, d) in enumerate(s)]
    assert [r for r in got if r[0] != 50] == sorted(w for w in want if w[0] != 50)
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0
    assert topk.products(np.array([[2**40, 1]]), np.array([[2**20, 3]])).tolist() == [[2**60 + 3]]
    assert topk.products(np.array([[2**40, 1]]), np.array([[2**40, 3], [-(2**40), 0], [-(2**63), 1]])).tolist() == [[2**63 - 1, -(2**63), -(2**63)]]


def test_top_k_of_very_large_components(spark):
    """Components and products beyond a long are its ends; the smaller vec_id comes first among them."""
    rows = [(i, [float(i % 7), float(-i)]) for i in range(200)] + [(300, [1e300, 1.0]), (301, [1e300, -1e300]), (350, [1e18, 1e18]), (302, [-1e30, 2.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    clean = [(r["vec_id"], r["v"]) for r in v.collect()]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert len(clean) == 204 and dict(clean)[300] == [2**63 - 1, 256] and dict(clean)[302] == [-(2**63), 512]
    want = []
    for q, x in clean:
        if q % 50 == 0:
            s = sorted((-clip(sum(a * b for a, b in zip(x, y))), d) for d, y in clean if d != q)[:5]
            want += [(q, k + 1, d, -n) for k, (n, d) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v, 5).collect())) == sorted(want)


def test_top_k_visits_few_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rng = np.random.default_rng(14)
    seeds = rng.normal(size=(30, 16)) * 4
    rows = [(i, (seeds[i % 30] + rng.normal(size=16) * 0.05).tolist()) for i in range(3000)]
    rows += [(4000 + 50 * i, [float(i)] * (2 + i)) for i in range(20)]  # more lengths than have pivots
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = v.where("vec_id % 50 = 0")
    data, found, routed = topk._routes(queries, v, 5)
    blocks = data.where("dim = 16").select("grp", "block").distinct().count()
    assert routed.where("dim = 16").count() < 0.1 * blocks * 60
    clean = [(r["vec_id"], np.array(r["v"])) for r in v.collect()]
    want = []
    for q, x in clean:
        if q % 50 == 0:
            s = sorted((-int(x @ y), d) for d, y in clean if d != q and len(y) == len(x))[:5]
            want += [(q, k + 1, d, -n) for k, (n, d) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(queries, v, 5).collect())) == sorted(want)


# 8
def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, empty):
    for t in ODD_TEXTS[:6] + ["a b c d e f g h " * 100]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[10] == 9 and got[4] == 4
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_hamming_join(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 600, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 8), replace=False)) for b in base[:300]]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.hamming_forest(df)).collect()}
    label = np.arange(len(fps))
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)):
        if label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    signed = fps.view(np.int64)
    want = {}
    for k in set(label):
        own = signed[label == k]
        if len(own) > 1:
            want |= {int(x): int(own.min()) for x in own}
    assert got == want


def test_balls_link_as_brute_force_does(monkeypatch):
    rng = np.random.default_rng(10)
    seeds = rng.integers(0, 2**64, 6, dtype=np.uint64)
    flips = lambda n: sum(1 << int(i) for i in rng.choice(64, n, replace=False))
    fps = np.unique(np.array([int(seeds[k % 6]) ^ flips(k % 7) for k in range(900)] + [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)], dtype=np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    want = np.arange(len(fps))
    while not np.array_equal(want, new := np.where(near, want[None, :], len(fps)).min(1)):
        want = new
    monkeypatch.setattr(simhash, "PAIRS", 500)
    forest = simhash.Forest(len(fps))
    simhash._links(fps, np.zeros(len(fps), dtype=np.uint64), np.arange(len(fps)), np.arange(len(fps)), forest, rng)
    assert forest.root(np.arange(len(fps))).tolist() == want.tolist()


def test_hot_classes(spark):
    docs = spark.createDataFrame([(i, f"text {max(0, i - 3000)} of some words", "en", "s", 0) for i in range(1, 3301)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 3300 and {got[i] for i in range(1, 3001)} == {1}


# 9
def test_lm_scores(spark, odd, empty):
    rows = [(0, "a b a b", 1), (1, "a b c", 0), (2, "c c c a", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scores.scores(docs, labels(spark, [(i, q, 0) for i, _, q in rows if q is not None])).collect()}
    vocabulary = {"a": 1, "b": 2, "c": 3}

    def losses(target):
        own = [t.split() for i, t, q in rows if not target or q == 1]
        uni = {w: sum(x.count(w) for x in own) for w in vocabulary}
        pair = {}
        for x in own:
            for p in zip(x, x[1:]):
                pair[p] = pair.get(p, 0) + 1
        p1 = lambda w: (uni[w] + 1) / (sum(uni.values()) + 4)
        out = {}
        for i, t, _ in rows:
            x = t.split()
            steps = [p1(x[0])] + [(pair.get((a, b), 0) + lm_scores.MU * p1(b)) / (uni[a] + lm_scores.MU) for a, b in zip(x, x[1:])]
            out[i] = -np.log(steps).mean()
        return out

    t, b = losses(True), losses(False)
    for i, _, _ in rows:
        assert got[i]["target_loss"] == pytest.approx(t[i]) and got[i]["background_loss"] == pytest.approx(b[i]) and got[i]["difference"] == pytest.approx(t[i] - b[i])
    out = lm_scores.scores(odd, labels(spark)).collect()
    assert len(out) == odd.count() and next(r for r in out if r["doc_id"] == 0)["difference"] is None
    assert lm_scores.scores(empty, labels(spark)).count() == 0


def test_lm_scores_keep_every_word_and_bigram(spark):
    rng = np.random.default_rng(12)
    texts = {i: [f"w{k}" for k in rng.integers(0, 30000, 100)] for i in range(300)}
    texts[300] = texts[7] + ["once"]
    texts[None] = texts[9][:50]
    good = {i for i in range(300) if i % 3 == 0}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scores.scores(docs, labels(spark, [(i, 1, 0) for i in good])).collect()}
    size = len({w for x in texts.values() for w in x}) + 1
    assert size > 15000 and len(got) == len(texts)
    for column, own in (("target_loss", [x for i, x in texts.items() if i in good]), ("background_loss", list(texts.values()))):
        uni, pair = Counter(w for x in own for w in x), Counter(p for x in own for p in zip(x, x[1:]))
        total = sum(uni.values())
        p1 = lambda w: (uni[w] + 1) / (total + size)
        for i, x in texts.items():
            want = -np.log([p1(x[0])] + [(pair[a, b] + lm_scores.MU * p1(b)) / (uni[a] + lm_scores.MU) for a, b in zip(x, x[1:])]).mean()
            assert got[i]["n_words"] == len(x) and got[i][column] == pytest.approx(want)


# 10
def test_quality(spark, odd, empty):
    import re

    texts = [*ODD_TEXTS, "a b c a b c d", "a a a a", "x\ny\nx\n \nx", "one two three four " * 20, "#tag $5 <b>"]
    rows = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        if len(w) < 3000:
            covered = {p for k in range(len(g)) if g.count(g[k]) > 1 for p in (k, k + 1, k + 2)}
            assert rows[i]["n_repeat_words"] == len(covered), t
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (rows[i]["n_words"], rows[i]["word_chars"], rows[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert rows[i]["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
    order = list(quality_rules.RULES)
    measured = quality_rules.measure(odd)
    a, b = (sorted(str(r) for r in measured.select("doc_id", quality_rules.cascade(o).alias("k")).collect()) for o in (order, order[::-1]))
    assert a == b
    assert quality_rules.quality(odd).count() == odd.count() and quality_rules.quality(empty).count() == 0
