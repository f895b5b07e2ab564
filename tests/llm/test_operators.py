"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, decontaminate, langid, linededup, mixing, neardup, quality, secrets, sharding, tokencount
from tideline.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, score double, size long, id long, row string, shard int"


def table(spark, rows, extra=(None, None, None, None)):
    """rows of (doc_id, text, lang, source); the other columns have names that operators use themselves."""
    return spark.createDataFrame([(*r, 1.5, 7, 3, "x", 2) for r in rows], DOCS).repartition(3)


def words(rng, n, kind="en"):
    parts = {"en": "the ing tion wh th er on and ly ed".split(), "de": "sch ung keit ein ver ü ß heit ch er".split(), "fr": "é è eau que ment oi aux le ç ai".split()}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


ODD = [(None, "x y z", "en", None), (901, None, "en", "s"), (902, "", "en", "s"), (903, " \n\t ", None, "s"), (904, "!!! 123", "en", None), (904, "!!! 123", "en", None)]


# 1


def vectors(spark, n=400, d=8, copies=60):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d)).round(3)
    x[:copies] = x[0]
    rows = [(i, x[i].tolist(), 0, 1.0) for i in range(n)]
    rows += [(n, None, 0, 1.0), (n + 1, [0.0] * d, 0, 1.0), (n + 2, [float("nan")] * d, 0, 1.0), (n + 3, [1.0, None] + [0.0] * (d - 2), 0, 1.0), (n + 4, [1.0], 0, 1.0), (None, [1.0] * d, 0, 1.0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")


def test_neighbours_recall_ties_and_bad_vectors(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=150, least_shards=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(len(x)), -s.round(9))) if i != q][:20]
        hits += len(set(want) & {r[1] for r in rows})
        assert all(math.isclose(r[2], s[r[1]], rel_tol=1e-12, abs_tol=1e-12) for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert hits / (20 * len(got)) >= 0.95


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)).round(2)
    rows = [(i, x[i].tolist()) for i in range(60)] + [(0, x[0].tolist())] * 2 + [(20, x[5].tolist()), (70, [1.0, 2.0]), (80, [2.0, 1.0]), (90, [0.5, 0.5])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, shard_rows=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))

    def want(i):
        s = sorted((-round(float(np.dot(rows[i][1], v)), 9), n) for j, (n, v) in enumerate(rows) if j != i and len(v) == len(rows[i][1]))[:20]
        return [(k, n, -p) for k, (p, n) in enumerate(s, 1)]

    assert sorted(got[0]) == want(0) and len([r for r in want(0) if r[1] == 0]) == 2  # asked once, though stored three times
    assert sorted(got[20]) == sorted(want(20) + want(62))  # two queries of one id
    assert sorted(got[80]) == want(64) and len(got[80]) == 2


def test_neighbours_few_and_empty(spark):
    _, df = vectors(spark, 5, 4, 0)
    assert ann.search(df.where("vec_id < 3 or vec_id is null"), F.col("vec_id") == 0, k=20).count() == 2
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# 2


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(3, 60), k), k, "s") for i, k in enumerate(["en", "de", "fr"] * 60)]
    docs = table(spark, [*rows, *ODD])
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (901, 902, 903, 904)] == ["und"] * 4 and got[901].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, langid.train(docs.limit(0))).where("lang_pred != 'und'").count() == 0
    long = " ".join(r[1] for r in rows if r[2] == "de") * 60
    assert len(long) > langid.CHUNK // 4 and model.predict([long, None])[0] == ["de", "und"]


def test_language_filters_have_no_false_negatives():
    h = [np.arange(1, 2000, dtype=np.uint64) * np.uint64(2654435761), np.arange(5000, 6000, dtype=np.uint64) * np.uint64(2654435761)]
    f = langid.LangFilter.build(["a", "b"], h, 16)
    for i, x in enumerate(h):
        mask = np.bitwise_and.reduce([f.slots[0][p] for p in langid._places(x, 16, f.k)])
        assert ((mask >> i) & 1).all()


# 3


def brute_contamination(text, items, window=13):
    w, hit, names = words_of(text), set(), set()
    for name, item in items:
        v = words_of(item)
        m = min(window, len(v))
        for win in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == win:
                    hit |= set(range(i, i + m))
                    names.add(name)
    return len(w), len(hit), sorted(names - {None})


@pytest.mark.parametrize("max_words", [100_000, 40])
def test_decontamination(spark, max_words):
    rng = random.Random(2)
    small = lambda n: " ".join(rng.choice(["a", "b", "c", "ä"]) for _ in range(n))
    items = [(str(i), small(rng.choice([3, 5, 13, 20, 30]))) for i in range(12)] + [("9", small(16)), (None, small(15)), ("x", None), ("y", "?!")]
    rows = [(i, small(40) + ", " + (rng.choice(items)[1] or "").upper() + "! " + small(10), "en", "s") for i in range(40)] + ODD
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    automata = decontaminate.build(bench, max_words=max_words)
    assert (len(automata) > 1) == (max_words == 40)
    docs = table(spark, rows)
    got = {(r.doc_id, r.n_words): r for r in decontaminate.mark(docs, automata).collect()}
    bad = 0
    for i, text, *_ in rows:
        n, hit, names = brute_contamination(text, items)
        r = got[i, n]
        assert (sum(s["to"] - s["from"] for s in r.spans), sorted(r["items"])) == (hit, names)
        bad += hit > 0 and 20 * hit >= n
    assert decontaminate.drop(docs, automata).count() == len(rows) - bad
    assert decontaminate.drop(docs, automata).columns == docs.columns
    half = spark.createDataFrame([(1, "p q r " * 200 + items[11][1] + " tail", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, spans string")
    cut = {r.doc_id: r.text for r in decontaminate.clean(half, automata, length=len(words_of(items[11][1])) if len(words_of(items[11][1])) < 13 else 13, coverage=0.2).collect()}
    assert cut[2] is None and cut[3] == "" and words_of(cut[1])[:600] == words_of("p q r " * 200) and len(words_of(cut[1])) < 600 + len(words_of(items[11][1]))
    assert decontaminate.clean(half, automata).columns == half.columns
    assert decontaminate.mark(docs, decontaminate.build(bench.limit(0))).where("size(spans) > 0").count() == 0
    assert decontaminate.mark(docs.limit(0), automata).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(21)
    big = words(rng, 40_000)
    w = big.split()
    item = " ".join(w[20_000:20_030])
    rows = [(1, big, "en", "s"), (2, " ".join([*w[:30_000], "changed", *w[30_001:]]), "en", "s"), (3, words(rng, 30), "en", "s")]
    docs = table(spark, rows)
    automata = decontaminate.build(spark.createDataFrame([("i", item)], "item_id string, text string"))
    got = {r.doc_id: r for r in decontaminate.mark(docs, automata).collect()}
    assert got[1].n_words == len(words_of(big)) and [(s["from"], s["to"]) for s in got[1].spans][:1] == [(20_000, 20_030)]
    kept = {r.doc_id: r.text for r in decontaminate.clean(docs, automata).collect()}
    assert len(words_of(kept[1])) <= len(words_of(big)) - 30 and kept[3] == rows[2][1]
    near = {r.doc_id: (r.class_id, r.kept) for r in neardup.classes(docs).collect()}
    assert near == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert sum(r.size for r in sharding.shard(docs).collect()) == sum(len(r[1].encode()) + 1 for r in rows)
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}[1] == len(big.split())
    assert quality.score(docs, quality.train(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))).count() == 3
    model = tokencount.Unigram({c: -1.0 for c in "abcdefghijklmnopqrstuvwxyz▁"})
    assert {r.doc_id: r.n_tokens for r in tokencount.count(docs, model).collect()}[1] == len(big) + 1
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert secrets.candidates(table(spark, [(1, f"{big} token={key}", "en", "s")])).count() >= 1


def test_spans_are_cut_out():
    assert decontaminate.without_spans("Ab, cd ef! gh", [(1, 3)]) == "Ab, ! gh"


# 4


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: words(rng, rng.randrange(20, 90)).capitalize() + "."
    bad = lambda: " ".join(x + "###" for x in words(rng, 40).split()) if rng.random() < 0.5 else (words(rng, 4).upper() + "!! ") * 9
    rows = [(i, good() if i % 3 else bad(), "en", "s") for i in range(240)]
    docs = table(spark, [*rows, *ODD])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(901, None), (902, 7), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 4 != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 1]
    assert sum((got[r[0]] >= 0.5) == (r[0] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[901] == got[902]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.5 for s in (r.score for r in quality.score(docs, model).collect()))
    assert quality.score(docs, quality.train(docs, labels.limit(0))).where("score != 0.5").count() == 0


def test_trees_flatten_to_what_they_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit(x, y, trees=60, depth=3)

    def one(row, k, node=0):
        for _ in range(3):
            node = 2 * node + 1 + (row[t.feature[k, node]] > t.cut[k, node])
        return t.leaf[k, node - 7]

    assert np.allclose(t.score(x[:20]), [1 / (1 + math.exp(-(t.base + sum(one(r, k) for k in range(60))))) for r in x[:20]])
    assert ((t.score(x) > 0.5) == y).mean() > 0.95


# 5


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds watch it from a tall green tree today"
    rows = [(1, f"{line}\nunique one here\n\n{line}", "en", "s"), (2, f"{line.upper()}!\nanother thing", "en", "s"), (3, line.replace("seven", "seven7"), "en", "s"), *ODD]
    got = [(r.doc_id, r.n_lines, list(r.removed)) for r in linededup.removed(table(spark, rows)).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and by[1] == (4, [3]) and by[2] == (2, [0]) and by[901] == (0, [])
    near = np.bitwise_count(np.bitwise_xor(*linededup.simhashes([linededup.normalised(x) for x in (line, rows[2][1])]).view(np.uint64))) <= linededup.DIFFER
    assert by[3] == (1, [0] if near else [])
    docs = table(spark, rows[:3])
    texts = {r.doc_id: r.text for r in linededup.cleaned(docs, linededup.removed(docs)).collect()}
    assert texts[1] == f"{line}\nunique one here\n" and texts[2] == "another thing"
    odd = table(spark, [*rows[:2], rows[0], (2, f"{line}\nother", "en", "s")]).selectExpr("*", "lang as removed", "id as n_removed", "source as doc", "1 as `a.b`")
    out = linededup.cleaned(odd, linededup.removed(odd))
    assert out.columns == odd.columns and out.count() == 4 and all(r.removed == "en" and r.doc == "s" for r in out.collect())
    assert sorted(r.text for r in out.collect()) == sorted([f"{line}\nunique one here\n"] * 2 + ["another thing", "other"])
    assert linededup.removed(docs.limit(0)).count() == 0


def test_lines_that_share_a_key_are_compared_however_many_bits_differ(spark):
    rng = random.Random(11)
    masks = [((1 << (64 * (i + 1) // 6 - 64 * i // 6)) - 1) << 64 * i // 6 for i in range(6)]
    pairs = []
    while len(pairs) < 4:
        *w, other = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(25)]
        lines = [" ".join(w), " ".join([*w[:12], other, *w[13:]])]
        a, b = (int(x) for x in linededup.word_simhashes([linededup.normalised(x) for x in lines]).view(np.uint64))
        if (a ^ b).bit_count() > 3 and sum(not (a ^ b) & m for m in masks) >= 3:
            pairs.append(lines)
    rows = [(2 * i + j, x, "en", "s") for i, p in enumerate(pairs) for j, x in enumerate(p)]
    got = {r.doc_id: list(r.removed) for r in linededup.removed(table(spark, rows)).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(8)}


def test_lines_with_one_changed_word_are_found(spark):
    rng = random.Random(12)
    lines = []
    for n in [*range(14, 50)] * 2:
        w = ["".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randrange(3, 10))) for _ in range(n)]
        i = rng.randrange(n)
        lines += [" ".join(w), " ".join([*w[:i], "".join(rng.choices("etaoinshrdlucmfwyp", k=len(w[i]))), *w[i + 1 :]])]
    got = {r.doc_id: r.n_removed for r in linededup.removed(table(spark, [(i, x, "en", "s") for i, x in enumerate(lines)])).collect()}
    assert not any(got[i] for i in range(0, len(lines), 2))  # brute force: each odd line is similar to the one before, to no other
    assert sum(got[i] for i in range(1, len(lines), 2)) >= 0.9 * len(lines) / 2


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_of_long_lines(spark):
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choices("abcé", k=rng.randrange(0, 30)))
        b = "".join(rng.choices("abcé", k=rng.randrange(0, 30))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.8)
        assert linededup.edits(a, b) == plain_edits(a, b), (a, b)
    long = words(rng, 9000)
    near = " ".join(w if rng.random() < 0.99 else "changed" for w in long.split())
    rows = [(1, long, "en", "s"), (2, near, "en", "s"), (3, words(rng, 9000), "en", "s")]
    assert len(long) > 10 * linededup.LONG
    got = {r.doc_id: list(r.removed) for r in linededup.removed(table(spark, rows)).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_pigeonhole_keys(spark):
    rng = random.Random(4)
    a = rng.getrandbits(64)
    rows = [(a - (1 << 64) if a >> 63 else a,)]
    for _ in range(40):
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        rows.append((b - (1 << 64) if b >> 63 else b,))
    got = [set(r[0]) for r in spark.createDataFrame(rows, "h long").select(linededup.keys("h")).collect()]
    assert len(got[0]) == 20 and all(got[0] & g for g in got)


# 6


def test_sharding(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", "s") for i in range(900)] + [(1000 + i, "hot " * 20, "en", "s") for i in range(450)] + ODD
    got = sharding.shard(table(spark, rows), fine=16).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    texts = {r[0]: r[1] for r in rows}
    sizes, slots = {}, {}
    for r in got:
        t = texts[r.doc_id]
        assert r.size == (len(t.encode()) if t else 0) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 16
    assert sorted(sizes) == list(range(16)) and all(abs(s / mean - 1) < 0.2 for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(table(spark, rows).limit(0)).count() == 0
    again = {(r.doc_id, r.size, r.shard) for r in sharding.shard(table(spark, rows[::-1]), fine=16).collect()}
    assert again == {(r.doc_id, r.size, r.shard) for r in got}


# 7


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [words(rng, 120).split() for _ in range(12)]
    rows, k = [], 0
    for b in base:
        for edits in (0, 0, 1, 2, 3, 12):
            w = list(b)
            for i in rng.sample(range(120), edits):
                w[i] = f"w{rng.random()}"
            rows.append((k, " ".join(w), "en", "s"))
            k += 1
    rows += [(500, "A b!", "en", "s"), (501, "a B", "en", "s"), *ODD]
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect() if r.doc_id is not None}
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    for i in range(k):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s > 0.86:
                assert got[i] == got[j], (i, j, s)
    assert all(got[i] // 6 == i // 6 for i in range(k)) and got[500] == got[501] == 500 and got[901] == 901 and got[902] == 902
    docs = table(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(got.values()))
    assert neardup.classes(docs.limit(0)).count() == 0


def weighted_jaccard(texts, width=5):
    """All pairs by plain loops, with the operator's weights."""
    sets = []
    docs = [words_of(t) for t in texts]
    grams = [[tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or [tuple(w)] for w in docs]
    share = {}
    for g in grams:
        for x in set(g):
            share[x] = share.get(x, 0) + 1 / len(texts)
    for g in grams:
        times = {x: g.count(x) for x in g} if len(set(g)) < len(g) else dict.fromkeys(g, 1)
        sets.append({x: (1 + math.log(n)) * (0.75 + 0.25 * math.log(max(share[x], 2**-12)) / math.log(2**-12)) for x, n in times.items()})
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = sum(min(w, b[x]) for x, w in a.items() if x in b)
            yield i, j, both / (sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(16)
    texts = []
    for group, edits in ((150, 3), (60, 5), (40, 8), (30, 1)):
        base = words(rng, 150).split()
        for _ in range(group):
            w = list(base)
            for i in rng.sample(range(150), rng.randrange(edits + 1)):
                w[i] = f"w{rng.random()}"
            texts.append(" ".join(w))
    passage = words(rng, 90)
    texts += [passage + " " + words(rng, rng.randrange(10, 60)) for _ in range(40)] + [words(rng, 100) for _ in range(30)]
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i, j, s in weighted_jaccard(texts) if s >= 0.8 + 1e-6]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    found = sum(got[i] == got[j] for i, j in pairs)
    assert found >= 0.99 * len(pairs), (found, len(pairs))
    close = {(i, j) for i, j, s in weighted_jaccard(texts) if 0.8 - 1e-3 < s < 0.8 + 1e-6}  # sketched frequencies may differ a little
    if not close:
        assert all(find(i) == find(got[i]) for i in got)  # and nothing else is


def test_near_duplicates_keep_one_row(spark):
    rng = random.Random(17)
    text = words(rng, 60)
    rows = [(5, text, "en", "s"), (5, text, "en", "s"), (6, text + " end", "en", "s"), (None, words(rng, 50), "en", "s"), (7, words(rng, 40), "en", "s"), *ODD]
    got = neardup.classes(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.kept is not None for r in got)
    assert sorted(r.kept for r in got if r.doc_id == 5) == [False, True] and [r.kept for r in got if r.doc_id == 6] == [False]
    assert [r.kept for r in got if r.doc_id == 7] == [True] and all(r.kept for r in got if r.doc_id is None) and [r.kept for r in got if r.doc_id == 901] == [True]
    docs = table(spark, rows).selectExpr("*", "doc_id as _id", "text as _digest", "lang as digest", "id as node", "1 as doubtful", "size as `row.x`")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r._id == r.doc_id and r._digest == r.text and r.digest == r.lang for r in kept.collect())


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    wa[:40] = 1e-9
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    s = neardup.signatures(np.concatenate([h, h]), np.concatenate([wa, wb]), np.array([0, 300, 600]), 3000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


# 8


def test_secrets(spark):
    found = secrets.labelled_findings(900, seed=9)
    forest = secrets.train(spark, secrets.labelled_findings(1200), trees=12)
    kind = "finding string, part string, before string, before2 string, after string, secret int"
    df = spark.createDataFrame([tuple(f[c.split()[0]] for c in kind.split(", ")) for f in found], kind)
    x = secrets.features(*map(F.col, ("finding", "part", "before", "before2", "after")))
    got = df.select(x.alias("x"), forest.expression(x).alias("s"), "secret").collect()
    assert np.allclose([r.s for r in got], forest.score(np.array([r.x for r in got])))
    assert np.mean([(r.s >= 0.5) == bool(r.secret) for r in got]) > 0.9
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = table(spark, [(1, f'Some words token = "{key}" and more.\nsee 4785380592391139 and mail1.example.com', "en", "s"), (2, f"{key} commit {key}", "en", "s"), *ODD])
    rows = secrets.scan(docs, forest).collect()
    assert [(r.line, r.word, r.finding) for r in rows if r.doc_id == 1 and r.secret] == [(0, 4, key)]
    assert len([r for r in rows if r.doc_id == 2]) == 2 and all(r.doc_id in (1, 2) for r in rows)
    assert secrets.scan(docs.limit(0), forest).count() == 0


def test_secret_candidates_of_each_place_and_sign(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3"
    texts = [f"{key},{key}", f"token={key},key={key}", "password => hunter22", "password =hunter22", "password=>hunter22", 'a "pwd":"hunter22","pwd":"hunter22"', "password := hunter22", f"see {key} there"]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {}
    for r in secrets.candidates(docs).collect():
        got.setdefault(r.id, []).append(r.finding)
    assert got[0] == [key, key] and got[7] == [key] and got[1].count(key) == 2
    assert got[2] == got[3] == got[6] == ["hunter22"] and got[4] == ["hunter22"] and got[5] == ["hunter22"] * 2


# 9


def test_targets_spill_over():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    t = mixing.targets([100, 1, 0], [1, 2, 3])
    assert t == [98.0, 3.0, 0.0]


@pytest.mark.parametrize("seed", range(40))
def test_fit_of_what_the_proportional_share_leaves_is_exact(seed):
    rng = np.random.default_rng(100 + seed)
    lengths = np.sort(rng.choice(np.arange(1, 40), 4, replace=False))
    counts = rng.integers(1, 6, 4)
    budget = int(rng.integers(0, lengths @ counts))
    take = mixing.fit(lengths, counts, budget)
    share = counts * budget // int(lengths @ counts)
    sums = {int(lengths @ share)}
    for n, c in zip(lengths, counts - share):
        sums = {s + int(n) * k for s in sums for k in range(c + 1)}
    assert (take >= share).all() and (take <= counts).all()
    assert abs(int(lengths @ take) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_as_near_as_any_subset(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(3, 60), 5, replace=False))
    counts = rng.integers(1, 4, 5)
    budget = int(rng.integers(1, lengths @ counts))
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + int(n) * k for s in sums for k in range(c + 1)}
    # The proportional share is taken first, so the programme is near the best, and exact where lengths are many.
    assert abs(int(lengths @ take) - budget) <= min(abs(s - budget) for s in sums) + int(lengths.max())


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(1, 50)), "en", rng.choice(["a", "b", "c", None])) for i in range(600)] + [(2000 + i, "same words here", "en", "b") for i in range(300)] + ODD
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    total, taken, size, target = sum(r.size for r in got), {}, {}, {}
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else None
        taken[s], size[s], target[s] = taken.get(s, 0) + r.taken, size.get(s, 0) + r.size, r.target
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken), (taken, target, size)
    assert math.isclose(sum(target.values()), total)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs).collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(docs.limit(0)).count() == 0


# 10


def brute_tokens(model, token):
    best = [(0.0, 0)] + [None] * len(token)
    for i in range(1, len(token) + 1):
        for j in range(i):
            piece = token[j:i]
            s, n = model.scores.get(piece), 1
            if s is None:
                if i - j > 1:
                    continue
                s, n = model.unknown, len(piece.encode()) if model.bytewise else 1
            cand = (best[j][0] + s, best[j][1] + n)
            if best[i] is None or cand[0] > best[i][0] + 1e-12:
                best[i] = cand
    return best[-1]


def test_token_counts(spark):
    rng = random.Random(8)
    scores = {c: -3.0 - rng.random() for c in "abcde▁"} | {"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 5))): -rng.random() * 6 for _ in range(40)} | {"▁" + x: -2 - rng.random() for x in ("a", "ab", "c▁"[:1])}
    model = tokencount.Unigram(scores)
    texts = [" ".join("".join(rng.choice("abcdeé\n") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + ODD
    got = {r.doc_id: r.n_tokens for r in tokencount.count(table(spark, rows), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_tokens(model, "▁" + t.replace(" ", "▁"))[1]
    assert got[901] == got[902] == 0
    small = tokencount.Trie(model, most=20)
    assert [small.total(t) for t in texts] == [got[i] for i in range(len(texts))]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
