"""Vector search, Merkle manifest and periodic runs against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import manifest, periodic, queries, vectors


def _nearest(rows, k):
    """Exact search over (id, vector): {query id: [(id, score), ...]}."""
    by = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[i] = min(by.get(i, tuple(v)), tuple(v))
    ids = sorted(by)
    x = np.array([by[i] for i in ids], np.float64).reshape(len(ids), -1)
    out = {}
    for a, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[a]
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if j != a][:k]
    return out


def _found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


@pytest.mark.parametrize("spread", [0.3, 50.0])
def test_vectors_recall(spark, spread):
    """Clustered, loose and structureless vectors of different lengths, over many lists and cells."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = _nearest(rows, 20), _found(vectors.search(df, F.col("id") % 20 == 0, list_size=40, cell=300))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.93
    for q, near in got.items():
        for i, score in near:
            assert abs(score - np.dot(np.float32(x[q]).astype(float), np.float32(x[i]).astype(float))) < 1e-9


def test_vectors_copies(spark):
    """A third of all vectors are equal: exact, with ties in order of ids, although a query has far more equal partners than k."""
    rng = np.random.default_rng(4)
    rows = [(i, ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).round(3).tolist())) for i in range(900)]
    got = _found(vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))
    want = _nearest(rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_vectors_edge(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (20, None, "a"), (40, [0.0, 0.0], None), (60, [float("nan"), 1.0], "a"), (80, [1.0, None], "a"), (None, [1.0, 1.0], "a"),
            (100, [], "a"), (1, [2.0, 1.0], "a"), (2, [0.5, -1.0], None), (3, [1.0, 2.0, 3.0], "a"), (120, [float("inf"), 1.0], "a"), (20, [0.0, -3.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = _found(vectors.search(df, F.col("id") % 20 == 0))
    assert got == {0: [(1, 2.0), (2, 0.5), (20, 0.0)], 20: [(2, 3.0), (0, 0.0), (1, -3.0)]}
    assert vectors.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert vectors.search(df.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """(root, [siblings of each node as (side, hash) or None, level by level])."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, p in zip(paths, places):
            path.append(None if p ^ 1 >= len(level) else ("L" if p & 1 else "R", level[p ^ 1]))
        level = [_h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        places = [p >> 1 for p in places]
    return level[0] if level else None, paths


def _manifest(rows, group, key):
    """Sorted (id, leaf, subroot, proof) and the root by plain recomputation."""
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append((r[key], _leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    root, upper = _tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for (i, h), path in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[g][1]):
            out.append((i, h, trees[g][0], ["" if s is None else s[0] + s[1] for s in path + above]))
    return sorted(out, key=str), root


@pytest.mark.parametrize("height", [2, 12])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en"] * 5 + [None, "de", "", "é"]), rng.choice([None, i]), rng.choice([None, "", "tä xt", f"t{i}"])) for i in rng.sample(range(10_000), 77)]
    rows += rows[:3] + [(None, None, None, None, None)] * 2 + [(1, None, "lone", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    proofs, root = manifest.manifest(df, df.columns, "lang", "doc_id", {"h": F.lit("x")}, height)
    want, top = _manifest(rows, 2, 0)
    got = proofs.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).withColumn("bad", manifest.fold(F.lit("0" * 64), F.col("proof"))).collect()
    assert root == top and sorted(((r.id, r.leaf, r.subroot, r.proof) for r in got), key=str) == want
    assert all(r.folded == root and r.bad != root and r.h == "x" for r in got)


def test_manifest_missing():
    """What a range of leaves needs from outside is what its own nodes do not give, and no more."""
    for n in range(1, 20):
        for a in range(n):
            for b in range(a, n):
                need, own, size, level = [], set(range(a, b + 1)), n, 0
                while size > 1:
                    need += sorted((level, i ^ 1) for i in own if i ^ 1 < size and i ^ 1 not in own)
                    own, size, level = {i >> 1 for i in own}, (size + 1) >> 1, level + 1
                assert sorted(manifest.missing(a, b, n)) == need


def test_manifest_edge(spark, edge):
    proofs, root = manifest.manifest(edge, edge.columns, "lang", "doc_id")
    want, top = _manifest([tuple(r) for r in edge.collect()], 2, 0)
    assert root == top and sorted(((r.id, r.leaf, r.subroot, r.proof) for r in proofs.collect()), key=str) == want
    none, root = manifest.manifest(edge.limit(0), edge.columns, "lang", "doc_id")
    assert root is None and none.count() == 0
    lone, root = manifest.manifest(edge.where("doc_id = 5"), edge.columns, "lang", "doc_id")
    assert [(r.leaf, r.subroot, r.proof) for r in lone.collect()] == [(root, root, [])]


def _runs(words):
    """Every period of every stretch, by comparing all words."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and not any(p < q and a <= s and a + m >= i + q for a, m, p in out):
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _numbers(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def test_runs_brute_force():
    rng = random.Random(9)
    for case in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.choice("abcd") for _ in range(rng.randint(1, 6))]
                words += (unit * 9)[:rng.randint(1, 9) * len(unit) - rng.randint(0, len(unit) - 1)]
            docs.append(words)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        assert periodic.find_runs(_numbers([w for d in docs for w in d]), first) == [_runs(d) for d in docs]


def test_runs_long():
    """One word many times over, and a long period: chunks of ordered positions split."""
    words = ["a"] * 6000 + [str(k) for k in range(500)] * 5 + ["b"]
    assert periodic.find_runs(_numbers(words), np.array([0, len(words)])) == [[(0, 6000, 1), (6000, 2500, 500)]]


def test_runs_edge(spark, edge):
    got = periodic.periodic_runs(edge).collect()
    assert len(got) == edge.count() and "text" not in periodic.periodic_runs(edge).columns
    want = []
    for r in edge.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = [(0, 30_000, 1)] if len(words) == 30_000 else _runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        want.append((r.doc_id, r.lang, [tuple(x) for x in runs], best, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(((r.doc_id, r.lang, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.kept) for r in got), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(edge.limit(0)).count() == 0


def test_repeated_tail():
    words = [f"w{i}".encode() for i in range(40)]
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(hit).encode()) // 10
    a = g % 40
    p = 1 + (40 - a) // (3 + g % 8)
    changed = queries.repeated_tail(hit, words)
    assert len(changed) == 40 and all(changed[i] == (words[i] if i < a else words[a + (i - a) % p]) for i in range(40))
    assert queries.repeated_tail(None, words) == words == queries.repeated_tail(next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10), words)
