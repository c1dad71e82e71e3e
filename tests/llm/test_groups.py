"""Spelling variants, exact duplicates and ball k-means against plain versions, on made cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck, same
from pyspark.sql import functions as F

from frameloom.llm import ball_kmeans, exact_dedup, spelling
from frameloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_dedup", "op13_centroid_clusters"])
def test_query_against_sql(spark, name):
    same(QUERIES[name](spark, SF), duck(SF), ORACLES[name])


# -- spelling --------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, length, noise):
    counts = Counter()
    for name, text in rows:
        run = ""
        for ch in [*(text or ""), " "]:
            if "a" <= ch.lower() <= "z" and ord(ch) < 128 or 0xC0 <= ord(ch) <= 0xFF:
                run += ch.lower() if ord(ch) < 128 else ch
                continue
            h = zlib.crc32(f"{'null' if name is None else name}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if run and noise and h % noise == 0 else run
            if len(word) >= length:
                counts[word] += 1
            run = ""
    return counts


def plain_variants(counts, least, ratio):
    n = {w: c for w, c in counts.items() if c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed, letters="ab", sizes=(3, 9), base=12, n=400):
    """Texts of words that are edits of edits of a few, frequent and rare."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(base)]
    texts = []
    for _ in range(n):
        w = rng.choice(words)
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            k = rng.randrange(len(w) + 1)
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
        texts.append(w)
    return [(k, " ".join(texts[k * 9 : k * 9 + 9])) for k in range(n // 9)]


@pytest.mark.parametrize(("letters", "most"), [("ab", 1 << 15), ("ab", 4), ("aé", 2), ("abcdefgÿ", 3), ("a", 2)])
def test_spelling_variants(spark, monkeypatch, letters, most):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", most)
    monkeypatch.setattr(spelling, "BLOCK_SHARE", 1 << 40)
    rows = misspelt(most, letters)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = spelled(spelling.spelling_variants(df, least_length=3, least_count=2, ratio=2, noise=5))
    assert got == plain_variants(plain_words(rows, 3, 5), 2, 2) and len(got) > (3 if letters != "a" else 1)


def test_words_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "Straße STRASSE Éclairs éclairs ÉCLAIRS naïveté×÷ÿ x"), (None, "abcdefg abcdefg"), (3, "Straße STRASSE Éclairs éclairs"), (4, long), (4, f"{long} {long}x 𝔸bcdefgh日abcdefg ligaturesĀnotletters"), (5, "퟿ abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, 7, 31).collect()}
    assert got == dict(plain_words(rows, 7, 31))
    every = spelled(spelling.spelling_variants(df, ratio=1))
    assert every == plain_variants(plain_words(rows, 7, 31), 2, 1)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_chains_of_forms_lead_to_their_end(spark):
    words = {"a" * k: 2 * 3**i for i, k in enumerate(range(7, 14))}
    df = spark.createDataFrame([(k, " ".join(w for w, n in words.items() for _ in range(n))) for k in range(1)], "doc_id long, text string")
    got = spelled(spelling.spelling_variants(df, ratio=3, noise=0))
    assert {w: r[1] for w, r in got.items()} == {w: "a" * 13 for w in words}


def test_near_pairs_of_a_trie():
    rng = random.Random(5)
    for letters in ("ab", "abc", "a"):
        for _ in range(150):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))})
            got = sorted(tuple(sorted(p)) for p in spelling.near_pairs(words, lambda p: True))
            assert got == [(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if one_edit(words[a], words[b])]


def test_a_word_lies_in_few_light_subtrees():
    """Work is per light word: n words of a chain and of a full tree give at most n log2 n of them."""
    for words in (["a" * k for k in range(1, 400)], sorted(f"{k:09b}" for k in range(512))):
        looked = [0]

        class Counted(str):
            def __getitem__(self, key):
                looked[0] += isinstance(key, slice) and key.stop is None
                return str.__getitem__(self, key)

        list(spelling.near_pairs([Counted(w) for w in words], lambda p: True))
        assert looked[0] <= 3 * len(words) * 9


# -- exact duplicates --------------------------------------------------------------------------------


def plain_groups(rows):
    groups = defaultdict(list)
    for k, (name, text) in enumerate(rows):
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append(k)
    out = []
    for plain, ks in groups.items():
        first = min(ks, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        out += [(rows[k][0], rows[first][0], len(ks), k == first, hashlib.sha256(plain.encode()).hexdigest()) for k in ks]
    return sorted(map(repr, out))


def odd_rows(seed, n=120):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "\x0b\x0c\r", "a b", "ab", "a\tb ", "a b", "A b", "é è", "éè", "x" * 50_000, "x " * 50_000, "𝔸 b", "𝔸b"]
    return [(rng.choice((None, rng.randrange(40), k)), rng.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_exact_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
    rows = odd_rows(most)
    df = spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "doc_id long, text string, size int, hash string, rid int").coalesce(1)
    got = exact_dedup.exact_dedup(df)
    key = lambda r: repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]))
    found, want = sorted(map(key, got.collect())), plain_groups(rows)
    # Of repeated rows any may be the one that stays, so these count as a bag.
    assert found == want
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")).filter("kept").collect()[0]["doc_id"] == "a"


def test_equal_hashes_of_different_texts_are_told_apart(spark, monkeypatch):
    real = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(F.substring(c, 1, 1)))
    rows = [(k, t) for k, t in enumerate(["ab", "a b", "ac", "ac", "ad", "b", "b c", "bc", "bd", ""])]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in got.collect()) == plain_groups(rows)


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# -- ball k-means ------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in out:
        inertia[j] += d
    return sorted(map(repr, [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out]))


def clouds(seed, n=300, spread=1.0, far=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 4)) * 3 * far
    rows = [(k, (centres[rng.integers(6)] + rng.normal(size=4) * spread).astype(float).tolist()) for k in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, [1.0, None, 2.0, 3.0]), (n + 3, [float("nan")] * 4), (n + 4, [1.0, float("inf"), 0.0, 0.0]), (n + 5, [1.0] * 5), (n + 6, [0.0] * 4), (3, rows[3][1]), (n + 7, rows[3][1])]


@pytest.mark.parametrize(("spread", "k", "between", "far"), [(1.0, 8, 4, 1.0), (0.01, 3, 1, 1.0), (3.0, 12, 20, 1.0), (1.0, 8, 2, 3e5), (1.0, 4, 4, 1e-4)])
def test_clusters(spark, monkeypatch, spread, k, between, far):
    monkeypatch.setattr(ball_kmeans, "ROUNDS_BETWEEN_WRITES", between)
    rows = clouds(k, spread=spread, far=far)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = ball_kmeans.cluster(df, k=k, rounds=6, dimension=4)
    assert sorted(repr((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])) for r in got.collect()) == plain_clusters(rows, k, 6, 1024, 3)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 4), (None, [5.0] * 4)], schema)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in ball_kmeans.cluster(few, k=2, dimension=4).collect()}
    assert got[1] == got[2] == (1, 0) and got[None][0] == 0  # the equal centroids: one takes all vectors, leaves, and the other gets the two
    assert ball_kmeans.cluster(few.limit(0), dimension=4).count() == 0
    assert ball_kmeans.cluster(few, dimension=64).count() == 0
    with pytest.raises(Exception, match="below 2"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e300] * 4)], "vec_id long, embedding array<double>"), dimension=4).count()


def test_balls_leave_out_comparisons():
    """Well apart clusters: members of the core are compared with no other centroid."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (8, 16))
    x = np.concatenate([c + rng.integers(-50, 50, (200, 16)) for c in centres])
    own, d = ball_kmeans.compare_all(x, centres)
    found = {i: (200, int(d[own == i].max()), x[own == i].sum(axis=0).tolist()) for i in range(8)}
    step = ball_kmeans.next_step(centres.tolist(), found)
    assert not any(step.neighbours)
    after, best = ball_kmeans.compare_balls(x, own, d, step, np.array(step.centroids))
    want = ball_kmeans.compare_all(x, np.array(step.centroids))
    assert (after == want[0]).all() and (best == want[1]).all()
