"""Url rules, vector searches and near duplicates against plain versions."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.llm.bit_codes import nearest
from spendlens.llm.circulant import CirculantMinHash, Shingler, same_share
from spendlens.llm.cover_tree import CoverTree, DualSearch, exact_top_k
from spendlens.llm.grouped import components
from spendlens.llm.near_duplicates import near_duplicates, one_of_each
from spendlens.llm.url_rules import RULES, url_verdicts
from spendlens.llm.vector_blocks import usable

PAGES = "rule string, page_id long, host string, url string, verdict string"


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.b.net", "net", "org", ".com", "com.", "x-com", "é.net", ""]
    paths = ["", "/", "/en/", "/en/x?y=/es/", "/EN/", "/es/a#b", "/fr", "/fr/", "?q", "#f", "/es", "//en/"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "https://", "ftp://u@", "", "://") for _ in range(80)]
    urls += [None, "", "http://example.com/en/"] + ["https://hot.example.com/en/1"] * 300 + ["http://net/es/" + "x" * 5000]
    rows = [("r", i if i != 7 else None, "h", u, "v") for i, u in enumerate(urls)]
    rules = [*RULES, ("b.net", "", "allow"), ("org", "/", "block"), ("org", "/", "allow"), ("org", None, "allow"), (None, "/", "block"), ("NET", "/fr/x/", "allow")]
    got = url_verdicts(spark.createDataFrame(rows, PAGES).repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"), "none")
    plain = [(h.lower(), p or "", v) for h, p, v in rules if h is not None]
    want = sorted((str(r[1]), *map(str, plain_verdict(r[3], plain, "none"))) for r in rows)
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got.collect()) == want
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_verdicts(spark.createDataFrame(rows, PAGES), none).select("verdict").distinct().collect()} == {"allow"}
    assert url_verdicts(spark.createDataFrame([], PAGES), none).count() == 0


def plain_top(queries, query_ids, points, ids, k):
    found = {}
    for q, i in zip(queries, query_ids):
        scores = [(-float(np.dot(q, p)), int(j)) for p, j in zip(points, ids) if j != i]
        found[int(i)] = [(n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return found


@pytest.mark.parametrize("kind", ["random", "clustered", "copies", "huge"])
def test_dual_search_is_exact(kind):
    rng = np.random.default_rng(5)
    points = rng.integers(-40, 40, (1500, 12)).astype(float)
    if kind == "clustered":
        points = points[rng.integers(0, 12, 1500)] + rng.integers(-2, 3, (1500, 12))
    if kind == "copies":
        points[100:900] = points[100]
    if kind == "huge":
        points = points[:120] * 2.0**24
    ids = rng.permutation(len(points))
    some = ids % 7 == 0
    at, other, scores = DualSearch(points[some], ids[some], points, ids, 9).found()
    got = pd.DataFrame({"query_id": ids[some][at], "vec_id": ids[other], "score": scores.to_pylist()})
    if kind == "huge":
        whole = [[int(x) for x in p] for p in points]
        want = {int(i): [(n + 1, j, -s) for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, p)), int(j)) for p, j in zip(whole, ids) if j != i)[:9])]
                for q, i in zip([w for w, s in zip(whole, some) if s], ids[some])}
        got["score"] = got["score"].map(int)
    else:
        want = plain_top(points[some], ids[some], points, ids, 9)
    for query, rows in want.items():
        part = got[got.query_id == query]
        assert list(zip(part.vec_id, part.score, strict=True)) == [(j, int(s)) for _, j, s in rows]


def test_cover_tree_covers_and_separates():
    points = np.random.default_rng(1).normal(size=(3000, 3))
    tree = CoverTree(points, leaf=20)

    def walk(node):
        inside = points[tree.order[node.first:node.last]]
        assert np.linalg.norm(inside - node.center, axis=1).max() <= node.radius + 1e-9
        if node.children:
            centers = np.array([c.center for c in node.children])
            apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)
            assert apart[np.triu_indices(len(centers), 1)].min() >= node.radius / 2 - 1e-9
            assert sum(c.last - c.first for c in node.children) == node.last - node.first
            for c in node.children:
                walk(c)

    walk(tree.root)


VECTORS = "label int, vec_id long, embedding array<float>, score double"


def vector_rows(rng, n, dim=16):
    rows = [(1, i, [float(x) for x in rng.normal(size=dim)], 0.5) for i in range(n)]
    rows += [(0, n, None, 0.0), (0, n + 1, [], 0.0), (0, n + 2, [1.0, None] * 8, 0.0), (0, n + 3, [float("nan")] * dim, 0.0),
             (0, n + 4, [float("inf")] + [0.0] * (dim - 1), 0.0), (0, None, [1.0] * dim, 0.0), (0, n + 5, [0.0] * dim, 0.0)]
    return rows + rows[:3] + [(1, n + 20 + i, rows[20][2], 0.1) for i in range(30)]


def test_vector_searches(spark):
    rows = vector_rows(np.random.default_rng(3), 400)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    good = {r[1]: np.array(np.float32(r[2]), float) for r in rows if r[1] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all()}
    whole = usable(vectors, "vec_id", "embedding")
    assert {r["vec_id"] for r in whole.collect()} == set(good)
    ids = np.array(sorted(good))
    floors = np.array([np.floor(64 * good[i]) for i in ids])
    scaled = whole.select("vec_id", F.transform("vector", lambda x: F.floor(x * 64).cast("double")).alias("vector"))
    got = exact_top_k(scaled.where("vec_id % 20 = 0"), scaled, 20, query_block=8, block=100).collect()
    want = plain_top(floors[ids % 20 == 0], ids[ids % 20 == 0], floors, ids, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((q, n, j, int(s)) for q, v in want.items() for n, j, s in v)

    # rows 0 to 2 come twice: once as one row each here, with their copies below
    nonzero = usable(vectors, "vec_id", "embedding", nonzero=True).drop("copies")
    found = nearest(nonzero.where("vec_id % 20 = 0"), nonzero, 20, query_block=8, block=100).collect()
    ids = np.array([i for i in sorted(good) if good[i].any()])
    points = np.array([good[i] for i in ids])
    want = plain_top(points[ids % 20 == 0], ids[ids % 20 == 0], points, ids, 20)
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & {j for _, j, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and len(found) == sum(map(len, want.values()))
    for r in found:
        assert r["score"] == pytest.approx(float(np.dot(good[r["query_id"]], good[r["vec_id"]])), abs=1e-12)
    few = vectors.where("vec_id in (0, 1, 20)")
    small = usable(few, "vec_id", "embedding")
    # three query rows (0 twice, 20), each with the four other rows
    assert nearest(small.where("vec_id % 20 = 0"), small, 20).count() == 12 == exact_top_k(small.where("vec_id % 20 = 0"), small, 20).count()
    empty = usable(vectors.limit(0), "vec_id", "embedding")
    assert nearest(empty, empty, 20).count() == 0 and exact_top_k(empty, empty, 20).count() == 0


def test_rows_of_one_id_are_rows(spark):
    """Repeated ids, with equal and with other vectors, against a plain search over rows."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in rng.integers(0, 12, 60)]
    rows += [(0, [3.0] * 6)] * 40 + [(20, [-0.0] * 6), (20, [0.0] * 6)] + [(7, rows[3][1])] * 3
    whole = usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vec_id", "embedding")
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 4 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(rows) if c != q)
            want += [(i, n + 1, j, int(-s)) for n, (s, j) in enumerate(scores[:9])]
    for search in (exact_top_k, nearest):
        got = search(whole.where("vec_id % 4 = 0"), whole, 9, query_block=5, block=11).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in got) == sorted(want)


def plain_groups(rows, words):
    sets = []
    for _, text in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(parts[k:k + words]) for k in range(len(parts) - words + 1)} or ({tuple(parts)} if parts else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return [(str(d), len(sets[i]), str(lowest.get(find(i)) if d is not None else None), d is None or lowest[find(i)] == d) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(2, 7)))
    rows, doc_id = [], 0
    for size in (1, 2, 3, 8, 60):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((doc_id, rng.choice([" ", "\n", "  "]).join(copy)))
            doc_id += 1
        rows += [(doc_id + k, " ".join(base).upper() if k else " ".join(base)) for k in range(2)]
        doc_id += 2
    rows += [(doc_id + k, t) for k, t in enumerate([None, "", " \t\n", "one", "One", "two words", "two  words", "a b c d", "a b c d", "\x1c", "x " * 30_000])]
    return rows + [(None, "a b c d"), (None, None), (3, "a b c d")]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = near_rows()
    docs = spark.createDataFrame([(t, d, "k", "n") for d, t in rows], "text string, doc_id long, node string, label string").repartition(4)
    got = near_duplicates(docs, words, 80).collect()
    want = plain_groups(rows, words)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == sorted(want)
    kept = one_of_each(docs, words)
    gone = {w[0] for w in want if not w[3]}
    assert kept.columns == docs.columns and kept.count() == sum(str(d) not in gone for d, _ in rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    signature = CirculantMinHash(512)
    for share in (0.2, 0.5, 0.8):
        common, n = rng.integers(0, 2**63, 4000).astype(np.uint64), 4000
        rest = int(n * (1 - share) / (2 * share))
        a, b = (np.unique(np.append(common, rng.integers(0, 2**63, rest).astype(np.uint64))) for _ in range(2))
        both, either = same_share(a, b)
        assert abs((signature(a) == signature(b)).mean() - both / either) < 0.08
    shingles = Shingler(4)
    assert len(shingles("a b c d a b c d")) == 4 and not len(shingles("  ")) and len(shingles("A b")) == 1


def test_shingles_remember_a_bounded_number_of_words():
    shingles = Shingler(4)
    for k in range(4):
        text = " ".join(f"w{i}" for i in range(100_000 * k, 100_000 * (k + 1)))
        assert len(shingles(text)) == 100_000 - 3
    assert len(shingles.known) <= 350_000  # the limit and one text


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(3, x), (5, x + " end"), (1, y), (3, y + " end"), (7, z), (7, z), (None, z), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, one_of_each(docs).collect()), key=str)
    assert got == sorted([(3, x), (1, y), (7, z), (None, z), (8, "")], key=str)
