"""Licenses, benchmark passages, secrets, shards, languages and tokens against brute force."""
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from docledger.llm import decontaminate, language, licenses, secrets, sharding, tokens

PATH = public.path("byte_bpe_multi_50k.tiktoken")
NOTICE = licenses.NOTICES[0][0]


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_licenses(spark):
    texts = ["Under the MIT License, MIT license; mit/license.", "cc by cc by-sa", "GNU General Public Licenses", "the gnu general public license", "", None, "mit",
             NOTICE.title(), "so " + NOTICE.replace("free of charge", "wholly free of any charge") + " end", " ".join(NOTICE.split()[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for d, text in enumerate(texts):
        ws = _words(text)
        want = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split())
        assert sorted((x.first, x.label) for x in got[d].licenses if x.base) == want
        assert got[d].n_words == len(ws)
    assert {x.label for x in got[7].licenses} == {x.label for x in got[8].licenses} == {"mit"} and not got[9].licenses
    assert got[7].licenses[0].score == 1.0 > got[8].licenses[0].score


def test_licenses_repeated(spark):
    """Notices that follow one another closely, word by word or each with a word put in."""
    texts = ["All rights reserved. " * 4, "see " + "Mozilla Public License " * 7 + "end", "all rights reserved " * 3, "x " + "gnu lesser big general public license " * 5, "all public rights mozilla reserved license " * 5]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(x.first, x.last, x.label, x.score) for x in got[0]] == [(i, i + 3, "proprietary", 1.0) for i in range(0, 12, 3)]
    assert [(x.first, x.label) for x in got[1]] == [(i, "mpl") for i in range(1, 22, 3)]
    assert {x.label for x in got[2]} == {"proprietary"} and not got[4]
    assert "lgpl" in {x.label for x in got[3]}


def test_licenses_edge(edge):
    assert licenses.license_scan(edge).count() == edge.count() and licenses.license_scan(edge.limit(0)).count() == 0


def _contaminated(text, items, n=10):
    ws, hit, found = _words(text), set(), set()
    for item, t in items:
        iw = _words(t)
        size = min(n, len(iw))
        grams = {tuple(iw[i:i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if size and tuple(ws[i:i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item if item is not None else ""))
    return len(ws), len(hit), sorted(found), hit


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, documents, block):
    rows = documents.collect()
    rng, items = random.Random(3), []
    for k in range(12):
        ws = rng.choice([r.text for r in rows if len(r.text) > 300]).split()
        at = rng.randrange(len(ws) - 5)
        items.append((k, " ".join(ws[at:at + rng.randint(1, 30)]).upper()))
    items += [(None, "one"), (50, None), (51, ""), (3, "Two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(documents, bench, block_bytes=block).collect()}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(documents, bench, remove="spans").collect()}
    for r in rows:
        n, hits, found, where = _contaminated(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, sorted(g["items"])) == (n, hits, found)
        assert _words(cut[r.doc_id]) == [w for i, w in enumerate(_words(r.text)) if i not in where]
    clean = {r.doc_id for r in decontaminate.decontaminated(documents, bench).collect()}
    assert clean == {d for d, r in got.items() if not r.n_hit} and 0 < len(clean) < len(rows)


def test_decontamination_edge(spark, edge):
    bench = spark.createDataFrame([(1, "quite another text")], "item_id long, text string")
    kept = decontaminate.decontaminated(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1
    assert decontaminate.decontaminated(edge, bench.limit(0)).count() == edge.count()
    assert decontaminate.contamination(edge.limit(0), bench).count() == 0


def test_secrets(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [" ".join([*(word() for _ in range(20)), rng.choice(["token = ", "password: ", "API_KEY=", "secret: "]) + '"' + hexes(40) + '"', *(word() for _ in range(10))]) for _ in range(120)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(120)]
    planted = hexes(38) + "G7"  # no base pattern has it: not hex to the end, no keyword
    texts += [f"und äö {hexes(20)}{hexes(20).upper()} rest", f"see {planted[:30]}Zq{planted[30:]} there", "ſecret: abcdefghijkl", "AKIAABCDEFGHIJKL AKIASHORT", "", None,
              'token=short password=longenough!x "secret" : "abc=def/12345"', "f" * 31 + " " + "0" * 32]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.found for r in secrets.scan(df, secrets.train(df.where("doc_id < 240"))).collect()}
    for d, text in enumerate(texts):
        want, text = [], text or ""
        for k, (kind, pattern, least) in enumerate((("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8),
                                                    ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32))):
            want += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[2] if k == 0 else m[0]) >= least]
        assert [(x.start, x.end, x.kind) for x in got[d] if x.kind != "crf"] == [(s, e, kind) for s, _, e, kind in sorted(want)]
        assert [(x.start, secrets.KINDS.index(x.kind)) for x in got[d]] == sorted((x.start, secrets.KINDS.index(x.kind)) for x in got[d])
    assert not any(x.kind == "crf" for d in range(240) for x in got[d])
    assert [texts[241][x.start:x.end] for x in got[241]] == [f"{planted[:30]}Zq{planted[30:]}"] and got[241][0].kind == "crf"


def test_viterbi_against_enumeration():
    import itertools
    import numpy as np
    rng = np.random.default_rng(0)
    emission, change, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 5, 5, 9])
    tags = secrets.viterbi(emission, change, first)
    for a, b in ((0, 5), (5, 9)):
        value = lambda p: change[2, p[0]] + sum(change[x, y] for x, y in zip(p, p[1:])) + sum(emission[a + i, x] for i, x in enumerate(p))
        assert tuple(tags[a:b]) == max(itertools.product(range(3), repeat=b - a), key=value)


def test_secrets_windows():
    """The sample sees base spans anywhere in a long text, and what is left of a span beside base spans is kept."""
    long = "word " * 30_000 + "password = hunter2hunter2 " + "word " * 30_000
    assert "password = hunter2hunter2" in secrets.windows(long) and len(secrets.windows(long)) <= secrets.SAMPLE_CHARS
    assert len(secrets.windows("a b " * 30_000)) == secrets.SAMPLE_CHARS and secrets.windows("short") == "short"
    rng = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 4)))]
        start = rng.randint(0, 30)
        end = start + rng.randint(1, 20)
        left = set(range(start, end)) - {i for a, b in spans for i in range(a, b)}
        assert {i for a, b in secrets.outside(start, end, spans) for i in range(a, b)} == left


def test_secrets_sequences():
    tags = np.full(100, secrets.OUTSIDE)
    tags[18:24] = 1
    tags[18] = 0
    assert secrets.cut_sequences(np.array([0, 70, 70, 75, 100]), tags, 20).tolist() == [0, 24, 44, 70, 70, 75, 100]


def test_secrets_gradient():
    """One step of fit moves each weight against the sign of the likelihood's numeric gradient."""
    rng = np.random.default_rng(1)
    first, n = np.array([0, 3, 3, 7]), 7
    features = rng.integers(0, secrets.FEATURES, (n, 2))
    tags = np.array([0, 1, 2, 2, 0, 1, 1])
    change = np.zeros((3, 3))
    change[secrets.OUTSIDE, 1] = -8.0

    def loss(weights):
        total = 0.0
        for a, b in zip(first, first[1:]):
            if a == b:
                continue
            emission = weights[features[a:b]].sum(1)
            score = lambda ys: sum(emission[t, y] + change[secrets.OUTSIDE if t == 0 else ys[t - 1], y] for t, y in enumerate(ys))
            total += np.log(sum(np.exp(score(ys)) for ys in itertools.product(range(3), repeat=int(b - a)))) - score(tags[a:b].tolist())
        return total

    steps, secrets.STEPS = secrets.STEPS, 1
    try:
        weights, _ = secrets.fit(features, tags, first)
    finally:
        secrets.STEPS = steps
    for f in np.unique(features):
        for tag in range(3):
            up = np.zeros((secrets.FEATURES, 3))
            up[f, tag] = 1e-5
            numeric = (loss(up) - loss(-up)) / 2e-5
            assert abs(numeric) < 1e-6 or np.sign(weights[f, tag]) == -np.sign(numeric)


def test_secrets_edge(edge):
    got = secrets.scan(edge, secrets.train(edge))
    assert got.columns == [*edge.columns, "found"] and sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in edge.collect())
    assert all(not any(x.kind != "crf" for x in r.found) for r in got.collect())
    assert secrets.train(edge.limit(0)) is None and secrets.scan(edge.limit(0), None).count() == 0


def test_sharding(spark, documents):
    limit = 4000
    rows = sharding.sharded(documents, limit=limit).collect()
    size = {r.doc_id: len(r.text.encode()) for r in rows}
    assert len(rows) == documents.count()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for name, members in shards.items():
        assert sum(size[r.doc_id] for r in members) == members[0].shard_bytes and len(members) == members[0].shard_rows
        assert members[0].shard_bytes <= limit or len(members) == 1
        if name:  # a bucket is split only when its parent is over the limit
            assert sum(size[r.doc_id] for r in rows if r.shard.startswith(name[:-1]) or name[:-1].startswith(r.shard) and r.shard != name) > limit
    assert {r.doc_id: r.shard for r in sharding.sharded(documents, limit=limit, broadcast_shards=0).collect()} == {r.doc_id: r.shard for r in rows}


def test_sharding_edge(spark, edge, tmp_path):
    assert sharding.sharded(edge).count() == edge.count() and sharding.sharded(edge.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "abcdefghij")] * 57 + [(2, "x")], "doc_id long, text string")
    rows = sharding.sharded(same, limit=100).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert len(rows) == 58 and all(sum(len(r.text) for r in m) == m[0].shard_bytes <= 100 and len(m) == m[0].shard_rows for m in shards.values())
    sharding.write_shards(sharding.sharded(same, limit=100), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 58


def test_language(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["ção", "que", "lh", "am"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang := list(sounds)[i % 3], rng.randint(1, 40)), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where(~language.held_out()))
    got = language.identify(df, model).where(language.held_out()).collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    mixed = spark.createDataFrame([(1, text("aa", 60) + " " + text("bb", 40)), (2, text("cc", 50)), (3, "12 !?"), (4, None), (5, "")], "doc_id long, text string")
    by = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert by[1].lang_pred in ("aa", "bb") and {x.lang for x in by[1].mixture} == {"aa", "bb"} and 0.4 < by[1].score < 0.8
    assert [x.lang for x in by[2].mixture] == ["cc"] and by[2].score > 0.99
    assert [(by[i].lang_pred, by[i].score) for i in (3, 4, 5)] == [("und", 0.0)] * 3


def test_language_of_many(spark):
    """A minority language behind five related ones, and six languages in one text."""
    rng = random.Random(4)
    common = ["ka", "to", "mi", "ra", "lo", "se", "pa", "nu"]
    sounds = {f"r{i}": [*common, x] for i, x in enumerate(["ve", "vi", "vo", "vu", "va"])}
    sounds |= {"ff": ["yy", "äk", "hö", "jj"], "gg": ["sch", "ung", "ein", "ß"], "hh": ["ção", "que", "lh", "am"], "ii": ["wz", "czy", "ć", "dł"], "jj": ["gh", "bth", "dd", "ff"], "kk": ["ox", "qi", "xu", "zz"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    df = spark.createDataFrame([(text(x, 300), x) for x in sounds for _ in range(8)], "text string, lang string")
    six = ["ff", "gg", "hh", "ii", "jj", "kk"]
    docs = [(1, text("r0", 210) + " " + text("ff", 90)), (2, " ".join(text(x, 60) for x in six)), (3, text("kk", 50))]
    by = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string"), language.train(df)).collect()}
    assert {x.lang for x in by[1].mixture} == {"r0", "ff"} and by[1].lang_pred == "r0" and 0.6 < by[1].score < 0.85
    assert {x.lang for x in by[2].mixture} == set(six) and by[2].score < 0.4
    assert [x.lang for x in by[3].mixture] == ["kk"]


def test_language_edge(edge):
    none = language.train(edge.limit(0))
    assert {r.lang_pred for r in language.identify(edge, none).collect()} == {"und"}
    model = language.train(edge.where(F.col("doc_id").isNotNull()))
    assert language.identify(edge, model).count() == edge.count() and language.identify(edge.limit(0), model).count() == 0


def test_tokens_like_tiktoken(spark, corpus):
    ranks = tokens.load_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus[:60], None, "", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "don't  stop\n\n\t", "漢字かな交じり文 😀👍🏽", "ñandú’s €5", "ab" * 700, "1" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = tokens.decode(tokens.encode(df, PATH, public.PATTERN), PATH).collect()
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.token_ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_tokens_edge(spark, edge):
    assert tokens.encode(edge, PATH, public.PATTERN).count() == edge.count() and tokens.encode(edge.limit(0), PATH, public.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [72, 73])], "doc_id long, token_ids array<int>")
    rows = {r.doc_id: r.decoded for r in tokens.decode(ids, PATH).collect()}
    assert rows[1] is None and bytes(rows[2]) == b"" and len(rows[3]) >= 2
