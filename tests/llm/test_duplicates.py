"""Substring and near duplicates, boilerplate lines and fingerprints against brute force."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docledger.llm import fingerprints, jaccard, lines, substrings
from docledger.llm.common import slices
from tests.llm.conftest import COLUMNS

ASCII = {c: c + 32 for c in range(65, 91)}


def _removed(texts: dict[int, str], window: int) -> dict[int, list[str]]:
    words = {d: [w.decode() for w in t.encode().split()] for d, t in texts.items()}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i:i + window]), d)
    kept = {}
    for d, ws in words.items():
        gone = {p for i in range(len(ws) - window + 1) if least[tuple(ws[i:i + window])] < d for p in range(i, i + window)}
        kept[d] = [w for p, w in enumerate(ws) if p not in gone]
    return kept


@pytest.mark.parametrize("window,anchor,limit", [(50, 20, 1 << 20), (12, 5, 0), (6, 6, 1 << 20)])
def test_substrings(documents, window, anchor, limit):
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = _removed(texts, window)
    got = {r.doc_id: r for r in substrings.without_repeats(documents, window=window, anchor=anchor, broadcast_bytes=limit).collect()}
    assert {d: r.kept for d, r in got.items()} == {d: " ".join(ws) for d, ws in want.items()}
    assert all(r.n_words - r.n_removed == len(want[d]) for d, r in got.items())
    assert all(b - a >= window for r in got.values() for a, b in zip(r.removed[::2], r.removed[1::2]))


def test_substrings_edge(edge):
    rows = substrings.without_repeats(edge).collect()
    assert len(rows) == edge.count()
    same = [r for r in rows if r.kept.startswith("A text") or r.n_removed == 140]
    assert sorted((r.doc_id is None, r.n_removed) for r in same) == [(False, 0), (False, 0), (True, 140)]  # the rows of id 1 are no repeats of each other, the null id is later
    assert all(r.n_words == 0 and r.kept == "" for r in rows if r.text is None or not r.text.strip())
    assert substrings.without_repeats(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(edge, window=10, anchor=20)


def _components(texts: dict[int, str]) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in texts.items():
        ws = [w.decode() for w in t.translate(ASCII).encode().split()]
        sets[d] = {tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("leaf", [jaccard.LEAF, 2])
def test_jaccard(documents, leaf):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents, leaf=leaf).collect()}
    assert got == _components(texts)


def test_jaccard_large_group_and_chains(spark, documents):
    """Hundreds of near copies, and chains whose ends are not similar, through the recursion over regions."""
    base = [f"w{i}" for i in range(120)]
    rows = [(5000 - i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1:])) for i in range(150)]
    rows += [(9000 + i, " ".join(f"v{k}" for k in range(i * 3, i * 3 + 60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, leaf=4).collect()}
    assert got == _components(dict(rows))


def test_jaccard_members_meet_pivots_once(spark, monkeypatch):
    """Members of a region are joined with its pivots in one table, and a region with no more members at home than pivots needs none."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1:])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans, stored = [], jaccard.stored

    def spy(one, *args):
        plans.append(one._jdf.queryExecution().optimizedPlan().toString())
        return stored(one, *args)
    monkeypatch.setattr(jaccard, "stored", spy)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, leaf=4).collect()}
    assert got == _components(dict(rows))
    joined = [p for p in plans if "NOT (c" in p and "= pivot" in p]
    rounds = [p for p in plans if "AS pivot" in p and "rank" in p]
    assert joined and len(joined) <= len(rounds)


def test_jaccard_members_without_partner_meet_no_pivots(spark, monkeypatch):
    """Edited copies link with none of a large group: by size and place they can only link with its shortest copy, so the group
    does not meet them as pivots."""
    base = [f"w{i}" for i in range(120)]
    edited = lambda *at: " ".join(f"x{at[0]}y{at[-1]}" if i in at else w for i, w in enumerate(base))
    rows = [(i, edited(5 + i % 110, 5 + i % 110 + i // 110)) for i in range(200)] + [(500, " ".join(base[:116]))]
    rows += [(600 + i, edited(3, 20 + i, 60 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tables, stored = [], jaccard.stored

    def spy(one, *args):
        out = stored(one, *args)
        if {"pivot", "x", "most"} <= {*out.columns} and "home" not in out.columns:
            tables.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "stored", spy)
    monkeypatch.setattr(jaccard, "MEETINGS", 500, raising=False)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, leaf=4).collect()}
    assert got == _components(dict(rows)) and got[600][1] == 600
    assert len(rows) < tables[0] and sum(tables[1:]) < len(rows), tables


@pytest.mark.parametrize("leaf", [jaccard.LEAF, 4])
def test_jaccard_truncated_copy(spark, leaf):
    """A copy without the footer is in the next smaller slice and links with the shortest of the copies only, not with a pivot."""
    rows = []
    for v in range(3):
        body, footer = [f"b{v}x{i}" for i in range(102)], [f"f{v}x{i}" for i in range(30)]
        rows += [(1000 * v + i, " ".join([*body, *footer[:21 if i == 7 else 24], f"u{i}"])) for i in range(1, 41)]
        rows += [(1000 * v + 100, " ".join(body))]
        rows += [(1000 * v + 200 + i, " ".join([*(f"o{v}x{i}x{k}" for k in range(60)), *footer])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _components(dict(rows))
    assert want[100][1] == 1 and want[200][1] == 200
    assert {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, leaf=leaf).collect()} == want


def test_jaccard_edge(edge):
    rows = jaccard.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    assert sorted((r.id or -1, r.component_id or -1) for r in rows if r.n_shingles == 7) == [(-1, 1), (1, 1), (1, 1)]
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or -1 for i in ids) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert jaccard.near_duplicates(edge.limit(0)).count() == 0 and jaccard.one_of_each(edge.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines(documents, limit):
    rows = documents.collect()
    pages, total = defaultdict(set), defaultdict(int)
    for n, r in enumerate(rows):
        total[r.source] += 1
        for line in r.text.split("\n"):
            if line.strip(" \t"):
                pages[r.source, line.strip(" \t").replace("\t", " ")].add(n)
    many = {k for k, v in pages.items() if len(v) >= 3 and len(v) > 0.02 * total[k[0]]}
    trimmed = [{x.strip(" \t").replace("\t", " ") for x in r.text.split("\n")} for r in rows]
    repeats = {n for n, r in enumerate(rows) if 2 * sum(len(x) for x in trimmed[n] if (r.source, x) in many) > sum(map(len, trimmed[n]))}
    as_one = lambda v: len(v - repeats) + bool(v & repeats)
    own = {s: as_one({n for n, r in enumerate(rows) if r.source == s}) for s in total}
    bad = {k for k in many if as_one(pages[k]) >= 3 and as_one(pages[k]) > 0.02 * own[k[0]]}
    assert bad and repeats
    want = {r.doc_id: [x for x in r.text.split("\n") if (r.source, x.strip(" \t").replace("\t", " ")) not in bad] for r in rows}
    got = lines.without_boilerplate(documents, broadcast_bytes=limit).collect()
    assert {r.doc_id: r.text for r in got} == {d: "\n".join(x) for d, x in want.items()}
    assert sum(r.n_dropped for r in got) == sum(len(r.text.split("\n")) for r in rows) - sum(map(len, want.values())) > 0


@pytest.mark.parametrize("copies, pages", [(3, 97), (40, 60), (1000, 50)])
def test_lines_near_copies(spark, copies, pages):
    """Near copies keep their text, be they few or most pages of a host; the site's own line still goes everywhere."""
    text = [f"line {k} of a clean document with words of its own" for k in range(9)]
    rows = [(i, "\n".join(["Site line.", *(x if k != i % 9 else f"edited by {i}" for k, x in enumerate(text))]), "s") for i in range(copies)]
    rows += [(10_000 + i, f"Site line.\npage {i} is about thing {i * i} and nothing else at all", "s") for i in range(pages)]
    got = {r.doc_id: r.text for r in lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: t.split("\n", 1)[1] for i, t, _ in rows}


def test_lines_edge(spark, edge):
    got = lines.without_boilerplate(edge).collect()
    assert len(got) == edge.count() and all(r.text is None and r.n_lines == 0 for r in got if r.doc_id == 2)
    three = spark.createDataFrame([(i, "same\n \nown %d" % i if i < 4 else "same", None) for i in range(6)], "doc_id long, text string, source string")
    assert sorted(r.text for r in lines.without_boilerplate(three).collect()) == ["", ""] + [f" \nown {i}" for i in range(4)]
    assert lines.without_boilerplate(edge.limit(0)).count() == 0


def test_fingerprints(documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    got = {r.id: r for r in fingerprints.edited_and_next(documents).collect()}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        k = len(r.text) // 3
        edited = r.text[:len(r.text) - k] + after.text[:k]
        assert (got[r.doc_id].n_chars, got[r.doc_id].edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [got[r.doc_id] for r in rows if len(r.text) > 200]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))


def test_fingerprints_edge(edge):
    assert fingerprints.edited_and_next(edge).count() == edge.count()
    assert fingerprints.edited_and_next(edge.limit(0)).count() == 0
    one = fingerprints.edited_and_next(edge.where("doc_id = 7")).collect()[0]
    assert one.near_edited == one.near_next == 1.0


def test_slices_keep_rows(edge):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"text": "x" * n} for n in (0, 10, 5000, 1, 1)] + [{"text": None}])
    parts = list(slices([batch], "text", 1000))
    assert sum(p.num_rows for p in parts) == 6 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
