"""Cases in which operators did less than their whole job."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import duck, same
from pyspark.sql import functions as F
from test_llm import docs, odd_texts, word

from frameloom.llm import common, components, language, mixing, ngram_join, substring_dedup, token_counts, top_k, toxicity, vector_dedup
from frameloom.llm.common import KEYS, PRIME, mixed, rolling
from frameloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from frameloom.llm.substring_dedup import packed
from frameloom.llm.suffix_dedup import unpack


def pairs_at(cosine, n, d, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


@pytest.mark.parametrize("dimension", [64, 256])
@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_recall_does_not_depend_on_width(dimension, width):
    tables = vector_dedup.tables_for(dimension, width, vector_dedup.PROBES, 0.9)
    hashes = vector_dedup.Hashes(dimension, tables, width, vector_dedup.PROBES)
    x, y = (hashes.keys(v) for v in pairs_at(0.9, 1000, dimension, 77))
    assert ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1).mean() >= 0.995


@pytest.mark.parametrize("cosine", [0.9, 0.99, 0.5])
def test_sketches_pass_pairs_at_the_threshold(cosine):
    a, b = (np.packbits(v @ vector_dedup.directions(64) >= 0, axis=1) for v in pairs_at(cosine, 20_000, 64, 5))
    x, y = (vector_dedup.signs([r.tobytes() for r in v]) for v in (a, b))
    least = vector_dedup.BITS - 2 * vector_dedup.unlike(cosine)
    assert ((x * y).sum(1) >= least).all()
    # Of vectors that have nothing in common, hardly any pass at high thresholds.
    assert ((x * np.roll(y, 1, 0)).sum(1) >= least).mean() < (1e-3 if cosine >= 0.9 else 1.0)


def test_sketches_of_any_threshold():
    assert [vector_dedup.unlike(c) for c in (1.0, 2.0, -1.0)] == [0, 0, vector_dedup.BITS]
    assert sorted(vector_dedup.unlike(c) for c in (0.99, 0.9, 0.5, 0.0, -0.5)) == [vector_dedup.unlike(c) for c in (0.99, 0.9, 0.5, 0.0, -0.5)]


@pytest.mark.parametrize("width", [3, 4])
def test_vector_groups_with_wide_keys(spark, width):
    rows = np.concatenate(pairs_at(0.901, 300, 64, 8)).tolist()
    out = vector_dedup.vector_groups(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"), 0.9, width=width).collect()
    assert sum(r["n_links"] > 0 for r in out) >= 0.99 * 600


def test_vectors_that_keys_cannot_tell_meet_in_one_bucket(spark):
    assert vector_dedup.keys_for(10**6, 64, -0.9, vector_dedup.PROBES) == (1, 0)
    rows = np.random.default_rng(3).normal(size=(60, 8)).tolist()
    out = vector_dedup.vector_groups(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"), 0.0, width=0).collect()
    n, root = brute.vector_links(rows, 0.0)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {k: (n[k], root[k]) for k in range(60)}


def links_of(texts, n, percent):
    """Per text, how many others it is linked to."""
    sets = [brute.shingles(t, n) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    count = Counter(x for link in links for x in link)
    return [count[k] for k in range(len(texts))]


@pytest.mark.parametrize(("n", "percent", "rows", "merged", "completed"), [(5, 80, 4096, 4096, 32), (4, 85, 3, 0, 0), (1, 50, 4, 10, 2), (2, 40, 5, 4096, 0)])
def test_ngram_join_counts_every_link(spark, monkeypatch, n, percent, rows, merged, completed):
    for name, value in (("BLOCK_ROWS", rows), ("MERGED", merged), ("COMPLETED", completed)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "FEW", 4 if rows < 10 else 12)
    texts = odd_texts(n)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, texts), n, percent, buckets=5).collect()}
    _, root = brute.jaccard_groups(texts, n, percent)
    assert got == {k: (x, root[k]) for k, x in enumerate(links_of(texts, n, percent))}


def test_t_occurrence_finds_every_link():
    rng = np.random.default_rng(4)
    sets = sorted((np.unique(rng.integers(0, 20, rng.integers(1, 18))).astype(np.uint64) for _ in range(80)), key=len)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for percent in (30, 60, 100):
        links = ngram_join.t_occurrence(np.concatenate(sets), at, ngram_join.Similarity(percent), list(range(80)))
        held = [set(s.tolist()) for s in sets]
        assert sorted(links) == sorted((a, b) for b in range(80) for a in range(b) if 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b]))


def threats(copies):
    """A quarter of the texts are threats at someone, marked toxic; in the others the same words stand in other clauses."""
    rng = random.Random(6)
    filler = lambda: " ".join("x" + word(rng) for _ in range(12))
    same = filler()
    texts = [f"{same if copies and k % 4 == 0 else filler()} . " + ("i will kill you . we see time" if k % 4 == 0 else "i will see you . we kill time") for k in range(400)]
    return texts, [(k, int(k % 4 == 0)) for k in range(400)]


def test_labels_make_threats_toxic(spark):
    texts, labels = threats(copies=False)
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert not model.lexicon.weight("kill") and not model.lexicon.weight("you")
    assert model.score("some day i will kill you")[0] >= 0.7 > 0.5 > model.score("some day i will kill time")[0]
    # Labels that mark them clean take the belief in them away.
    clean = toxicity.fit(docs(spark, texts), spark.createDataFrame([(k, 1 - y) for k, y in labels], "doc_id long, toxic int"), F.lit(True))
    assert clean.most["Ty"] < 0


def test_copies_of_a_threat_are_little_evidence(spark):
    fitted = [toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)) for texts, labels in (threats(False), threats(True))]
    assert fitted[1].most["Ty"] < fitted[0].most["Ty"] - 1


def announces(words):
    """First person, then intent, then a threat's verb with an object at most two words after it, or three before where language puts it there."""
    for k, x in enumerate(words):
        head = words[:k]
        aimed = "V" in head or "S" in head and "W" in head[head.index("S") :]
        if x == "T" and aimed and ({"O", "P"} & set(words[k + 1 : k + 3]) or "P" in words[max(0, k - 3) : k]):
            return True
    return False


def contexts(classes):
    """Contexts of clauses, by their definition."""
    out, words = [], []
    for c in classes:
        if c != toxicity.END:
            words.append(c)
            continue
        hits = [k for k, x in enumerate(words) if x in "IT"]
        target = bool({"Y", "O", "P"} & set(words))
        kind = "I" if "I" in words else "T" if announces(words) else "C" if "T" in words and target else ""
        if kind:
            within = lambda k, opens, reach: opens in words[max(0, k - reach) : k]
            out.append(kind + "y" * target + "n" * all(within(k, "N", 3) for k in hits) + "r" * any(within(k, "R", 8) for k in hits))
        words = []
    return out


def test_the_automaton_itself_writes_contexts():
    rng, arcs = random.Random(7), toxicity.Arcs(toxicity.MATCHER)
    seen = Counter()
    for k in range(12_000):
        # Clauses with and without insults; many with all that a threat takes.
        weights = ((2, 2, 2, 3, 2, 2, 9, 2, 1, 2, 2, 1), (0, 4, 1, 1, 1, 2, 5, 3, 3, 4, 5, 2))[k % 2]
        classes = [*rng.choices("ITYNRB.OPSWV", weights, k=60), toxicity.END]
        state, found = 0, []
        for c in classes:
            state, wrote = arcs[state, c]
            found += wrote
        assert found == contexts(classes)
        seen.update(found)
    assert {kind + y + marks for kind, y in (("I", ""), ("I", "y"), ("T", "y"), ("C", "y")) for marks in ("", "n", "r", "nr")} <= set(seen)


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate({97: 98, 98: 97})


def test_words_that_polynomials_cannot_tell(spark):
    """Polynomials modulo a power of two vanish on these for every base."""
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n)
        texts = [f"{w} " + " ".join(f"k{k}" for k in range(34)) for w in (a, b)]
        assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs(spark, texts), 35).collect()] == [0, 0]
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs(spark, [a, b, a + " x", b + " x"])).collect()}
        assert got == {k: k for k in range(4)}


def test_rolling_hashes_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << 64, 50, dtype=np.uint64), np.array([PRIME, PRIME - 1, PRIME + 1, 2**64 - 1, 0, 1], np.uint64)])
    for key, k in product((0, 1), (1, 2, 3, 4, 5, 7, 35, 50, 56, 57)):
        want = []
        for lo in range(len(values) - k + 1):
            h = 0
            for x in values[lo : lo + k].tolist():
                h = (h * KEYS[key][1] + x) % PRIME
            want.append(h)
        assert (rolling(values, k, key) == mixed(np.array(want, np.uint64))).all()


def test_windows_that_one_hash_takes_for_equal_stay(spark, monkeypatch):
    """The first round finds them, the second one by two hashes does not."""
    first = substring_dedup.rolling
    texts = odd_texts(5)
    monkeypatch.setattr(substring_dedup, "rolling", lambda values, k, key=0: first(values, k, key) % np.uint64(50) if key == 0 else first(values, k, key))
    rows = docs(spark, texts).select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id").checkpoint()
    for got, (_, gone, _) in zip(*[[(r["doc_id"], sum(b - a for a, b in np.frombuffer(r["spans"] or b"", np.int64).reshape(-1, 2))) for r in sorted(rows.join(substring_dedup.repeated_windows(rows, 5, 3), "rid", "left").collect(), key=lambda r: r["doc_id"])], brute.without_windows(texts, 5)], strict=True):
        assert got[1] == gone


@pytest.mark.parametrize("hot", [3, 6])
def test_members_that_name_blocks(spark, monkeypatch, hot):
    for name, value in (("HOT", hot), ("FEW", 2), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    line = "this line is on very many pages of the same site and says nothing"
    texts = [f"{line} w{k} x{k} y{k} z{k}" for k in range(60)] + [f"{line} w{k}" for k in range(60)] + [line] * 5 + odd_texts(4)
    for n, percent in ((4, 85), (5, 70)):
        got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, texts), n, percent, buckets=5).collect()}
        _, root = brute.jaccard_groups(texts, n, percent)
        assert got == {k: (x, root[k]) for k, x in enumerate(links_of(texts, n, percent))}


def test_exact_sets_agree_with_hashed_ones():
    texts = [t for t in odd_texts(2) if t is None or len(t) < 5000]
    for n in (1, 2, 3, 4, 5, 7):
        a, at, _ = ngram_join.sets(pa.array(texts), n)
        b, bt = ngram_join.exact_sets(texts, n)
        assert at.tolist() == bt.tolist()
        assert len({*zip(a.tolist(), [0] * len(a))}) == len(np.unique(b))
        assert [len(brute.shingles(t, n)) for t in texts] == np.diff(at).tolist()


def test_a_hot_key_is_joined_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HOT", 20)
    monkeypatch.setattr(components, "HOT_SHARE", 10)
    left = spark.createDataFrame([(0, k) for k in range(300)] + [(k, k) for k in range(1, 50)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "k long, w string")
    want = sorted([(0, k, "r0") for k in range(300)] + [(k, k, f"r{k}") for k in range(1, 40)])
    found = components.looked_up(left, right, ["k"])
    assert sorted(map(tuple, found.select("k", "v", "w").collect())) == want


def test_against_sql(spark):
    db = duck("/root/testdata/sf0.001")
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, "/root/testdata/sf0.001"), db, sql)


def test_documents_of_one_line_need_no_blocks(spark, monkeypatch):
    """Nobody holds the line's n-grams, so who asks for them meets nobody."""
    monkeypatch.setattr(ngram_join, "HOT", 50)
    texts = [f"this line is on very many pages of the same site and says nothing w{k} x{k} y{k} z{k}" for k in range(300)]
    got = ngram_join.ngram_components(docs(spark, texts), 4, 85, buckets=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in got} == {k: (15, 0, k) for k in range(300)}


def best_of(rows, ids, asks, k, scale=1024):
    """Of each asking id the k best, in Python's whole numbers."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in zip(ids, rows, strict=True) if v and None not in v and np.isfinite(v).all() and i is not None]
    out = []
    for q in sorted({i for i, _ in ok if asks(i)}):
        own = min((len(v), np.array(v, float).tobytes()) for i, v in ok if i == q)
        y = [int(x) for x in np.frombuffer(own[1])]
        scored = sorted((-max(-top_k.MOST, min(top_k.MOST, sum(a * b for a, b in zip(y, v)))), i) for i, v in ok if i != q and len(v) == len(y))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "routes"), [(8192, 256), (20, 6), (7, 3)])
def test_top_k_of_long_vectors_copies_and_equal_ids(spark, monkeypatch, block, routes):
    monkeypatch.setattr(top_k, "ROUTES", routes)
    monkeypatch.setattr(top_k, "PAGE", 8)
    rng = np.random.default_rng(4)
    rows = [(c + rng.normal(size=6) * 0.05).tolist() for c in rng.normal(size=(9, 6)) for _ in range(14)] + [[0.25] * 6] * 60
    rows += [[20_000.0, 1.0, 0.0, -3.0, 2.0, 1.0], [-30_000.0] * 6, [1e300] * 6, [-1e300, 1.0, 1.0, 1.0, 1.0, 1.0], [3e9] * 6, None, [], [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [1.0, 2.0], [2.0, 1.0], [1e200, -1.0]]
    ids = [*range(len(rows) - 4), 2, 2, 5, None]
    table = spark.createDataFrame(list(zip(ids, rows, [1] * len(rows), ["x"] * len(rows), strict=True)), "vec_id long, embedding array<double>, rank long, block string").repartition(3)
    out = top_k.top_k(table, F.col("vec_id") % 2 == 0, 7, block_rows=block)
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == best_of(rows, ids, lambda i: i % 2 == 0, 7)


def test_far_rings_are_not_asked():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 40
    points = np.floor(1024 * (centres.repeat(50, 0) + rng.normal(size=(400, 16)) * 0.01))
    routes = top_k.Routes([(16, p.tobytes()) for p in points[::50]], float((points**2).sum(1).max()), 400, 50)
    rings = top_k.Rings(routes, [(c, 0, 0.0, 4096.0, 1) for c in range(len(routes.of[16]))])
    nearest, slack = rings.at_least(points[3], False)
    assert (nearest <= slack).sum() <= 1 < len(nearest)


SENTENCES = {"you are an idiot": 1, "idiot": 1, "he said you are not an idiot": 0, "they wrote nobody called him idiot": 0, "he said you are an idiot": 0, "you are not an idiot": 0, "i will kill you": 1, "i will kill you and hurt them": 1, "i will kill time": 0, "he said i will kill you": 0, "i will not kill you": 0, "not an idiot. you are a moron": 1}
# Verbs of threats in clauses that threaten nobody, and threats in other languages.
SENTENCES |= {"they beat them three to one": 0, "she beat him at chess": 0, "please burn these files to disk": 0, "kill the process you started": 0, "i will help you destroy the evidence": 0}
SENTENCES |= {"ich werde dich umbringen": 1, "je vais te tuer": 1, "te voy a matar": 1, "we are going to hurt you": 1, "nous allons tuer le temps": 0}


def test_contexts_decide(spark):
    model = toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert {t: int(model.score(t)[0] >= 0.7) for t in SENTENCES} == SENTENCES


def plain_score(model, text):
    """Clause by clause, word by word, without the automaton."""
    total, matched = 0.0, 0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        weights = [max([model.lexicon.whole.get(w, 0.0)] + [model.lexicon.stems.get(w[:k], 0.0) for k in (4, 5, 6) if len(w) >= k]) for w in words]
        cues = (("T", toxicity.THREATS), ("O", toxicity.OBJECTS), ("P", toxicity.BEFORE), ("Y", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("S", toxicity.SELVES), ("W", toxicity.INTENTS), ("V", toxicity.PROMISES))
        classes = ["I" if x > 0 else next((k for k, own in cues if w in own), toxicity.OTHER) for w, x in zip(words, weights)]
        for context in contexts([*classes, toxicity.END]):
            matched += 1
            total += model.weight(context, max(weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.prior + total if matched else model.nothing)))), matched


def test_toxicity_query_against_a_plain_interpreter(spark):
    sf = "/root/testdata/sf0.01"
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.fit(*tables, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert model.lexicon.whole or model.lexicon.stems
    texts = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    for r in QUERIES["op4_toxicity"](spark, sf).collect():
        score, matched = plain_score(model, texts[r["doc_id"]])
        assert (r["held_out"], r["predicted"], r["n_clauses"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1, int(score >= 0.7), matched)
        assert r["score"] == pytest.approx(score)


def plain_fit(rows):
    """Terms, offsets, bounds and priors by their definitions; rows are (text, 1 or 0)."""
    words = [re.findall(r"[^\W\d_]+", t.lower()) for t, _ in rows]
    has = lambda w, t: w.startswith(t[:-1]) if t.endswith("*") else w == t
    n, m = sum(y for _, y in rows), sum(1 - y for _, y in rows)

    def g(a, b):
        cells = ((a, n, a + b), (b, m, a + b), (n - a, n, n + m - a - b), (m - b, m, n + m - a - b))
        return 2 * sum(o * math.log(o * (n + m) / (row * col)) for o, row, col in cells if o) if a * m > b * n else 0.0

    odds = lambda a, b: math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
    every = {t for own in words for w in own for t in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k))}
    told = []
    for t in every:
        a, b = (sum(any(has(w, t) for w in own) for own, (_, y) in zip(words, rows, strict=True) if y == kind) for kind in (1, 0))
        if a < 3 or a * m <= 4 * b * n or g(a, b) < toxicity.LEAST_RATIO:
            continue
        beside = {(x, w, z) for own, (_, y) in zip(words, rows, strict=True) if y for x, w, z in zip(["", *own], own, [*own[1:], ""], strict=False) if has(w, t)}
        a = min(a, len(beside))
        if g(a, b) >= toxicity.LEAST_RATIO:
            told.append((-round(g(a, b), 9), t.endswith("*"), -len(t), t, a, b))
    terms = {}
    for *_, t, a, b in sorted(told):
        bare = t.removesuffix("*")
        if odds(a, b) >= toxicity.LEAST_WEIGHT and not any(has(bare, u) and u.endswith("*") or t.endswith("*") and has(u.removesuffix("*"), t) for u in terms):
            terms[t] = odds(a, b)
    lexicon = toxicity.Lexicon(terms)
    kinds = [{c for c, _ in toxicity.clauses(t, lexicon)} for t, _ in rows]
    stood = lambda c, kind: sum(c in own for own, (_, y) in zip(kinds, rows, strict=True) if y == kind)
    offset, most, prior = {}, {}, math.log((n + 1) / (m + 1))
    for kind, y, marks in product("ITC", ("", "y"), ("", "n", "r", "nr")):
        c = kind + y + marks
        if kind == "I":
            a, b = stood(c, 1), stood(c, 0)
            offset[c] = (1.5 * bool(y) + (min(1.0, odds(a, b)) * (a + b) if a + b else 0.0)) / (3 + a + b)
        if kind != "I" or marks:
            a = len({t for (t, y), own in zip(rows, kinds, strict=True) if y and own == {c}})
            b = sum(own == {c} for (_, y), own in zip(rows, kinds, strict=True) if not y)
            share = (a + 20 * ({"": 0.8, "n": 0.1, "r": 0.3, "nr": 0.05}[marks] if kind != "C" else (n + 1) / (n + m + 2))) / (a + b + 20)
            most[c] = math.log(share / (1 - share)) - prior
    none = [sum(not own for own, (_, y) in zip(kinds, rows, strict=True) if y == k) for k in (1, 0)]
    return terms, offset, most, prior, prior + odds(*none)


def test_the_fit_against_its_definition(spark):
    rng, rows = random.Random(31), []
    said = ["you {}", "he said you are {}", "not a {}", "they wrote no {}", "what a {} that is"]
    for k in range(500):
        own, y = [word(rng) for _ in range(14)], int(k % 5 == 0)
        middle = rng.choice(said).format(rng.choice(["grobler", "groblers", "snarkling"])) if y else ""
        middle = {3: "i will kill you", 7: "she beat him at chess", 11: "nobody said i will hurt them", 13: "he called it a grobler"}.get(k % 17, middle)
        rows.append((" ".join(own[:7]) + f". {middle}. " + " ".join(own[7:]), y))
    rows += [rows[5]] * 20 + [rows[3]] * 3  # copies
    model = toxicity.fit(docs(spark, [t for t, _ in rows]), spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int"), F.lit(True))
    terms, offset, most, prior, nothing = plain_fit(rows)
    assert terms and {**model.lexicon.whole, **{t + "*": w for t, w in model.lexicon.stems.items()}} == pytest.approx(terms)
    assert model.offset == pytest.approx(offset) and model.most == pytest.approx(most)
    assert (model.prior, model.nothing) == pytest.approx((prior, nothing))


def test_a_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    texts, ids = ["you idiot", "good day"] * 300, [7] * 600
    labels = spark.createDataFrame([(7, k % 2) for k in range(400)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "choose", lambda rows, n, m: seen.append(n + m) or {})
    toxicity.fit(docs(spark, texts, ids), labels, F.lit(True), fit_rows=30)
    clusters = language._clusters
    monkeypatch.setattr(language, "_clusters", lambda vectors, k: seen.append(len(vectors)) or clusters(vectors, k))
    for own in (ids, [None] * 600):
        language.fit(docs(spark, ["the cat", "le chat"] * 300, own), F.lit(True), fit_rows=30)
    assert len(seen) == 5 and 0 < min(seen) <= max(seen) <= 60


def plain_language(model, text):
    """By loops over bytes and centroids."""
    letters = [b if 97 <= b < 123 or b >= 128 else 32 for b in (text or "").lower().encode()]
    tf = Counter()
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if not (a == b == 32 or b == c == 32):
            tf[((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F % 2**32 >> 19] += 1
    weight = {k: (1 + math.log(n)) * float(model.idf[k]) for k, n in tf.items()}
    norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
    cosines = [sum(w * float(c[k]) for k, w in weight.items()) / norm for c in model.centroids]
    ends = [*model.starts[1:], len(cosines)]
    return [max(cosines[a:b]) for a, b in zip(model.starts, ends)]


def test_language_query_against_nearest_centroids(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(table, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in QUERIES["op10_language"](spark, sf).collect():
        own = plain_language(model, texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert r["score"] == pytest.approx(min(1, max(own)), abs=1e-4)
        assert own[model.names.index(r["lang_pred"])] >= max(own) - 1e-4


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["\u00bd \u00b2 \u2167", "\u2160\u2161", "\u00bd a", "12 _ !", "\u2167 \u00e9t\u00e9", "the cat", "le chat"]
    out = {r["doc_id"]: r["lang_pred"] for r in language.language(docs(spark, texts), F.lit(True)).collect()}
    assert [out[k] == "und" for k in range(7)] == [True, True, False, True, False, False, False]


def test_a_pre_token_is_encoded_once_per_bucket(monkeypatch):
    """Whatever number of chunks sends it."""
    seen = Counter()
    encode = token_counts.Pieces.encode
    monkeypatch.setattr(token_counts.Pieces, "encode", lambda self, tokens: seen.update(tokens) or encode(self, tokens))
    path = tokenizer_path("byte_bpe_50k.json")
    sent = [["the", " the", "\n", "<|endoftext|>", "é" * 60], [" the", "x퟿"], ["the", "\n"]]
    group = packed([(3, token_counts.TOKENS, k, len(t), token_counts.strings(t)) for k, t in enumerate(sent)] + [(3, token_counts.ROWS, 9, 1, b"x")], token_counts.SENT)
    out = token_counts._pieces(path, token_counts.SPACED)(pa.Table.from_batches([group])).to_pylist()
    assert set(seen.values()) == {1} and set(seen) == {t for own in sent for t in own}
    assert [len(unpack(r["data"], r["n"], "<i4")[0]) for r in out if r["kind"] == token_counts.TOKENS] == [5, 2, 2]


def test_token_counts_of_many_chunks_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = odd_texts(11)
    d = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.concat(F.lit("d"), F.col("doc_id"))))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(d, path, buckets=3).collect()}
    assert got == {None if k == 3 else f"d{k}": (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def plain_mix(rows, seed=7):
    """How often each of some (id, text, source) is taken, by the definition of weighted fair queueing."""
    size = [len(brute.split(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target, free = 1.5 * sum(size), {}, set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] <= weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= full
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    place = [digest(f"{seed}|{'null' if i is None else i}|{digest(t or '')}") for i, t, _ in rows]
    times, done = [], Counter()
    for k in sorted(range(len(rows)), key=lambda k: (place[k], size[k])):
        s = rows[k][2]
        done[s] += size[k]
        if size[k] and target[s]:
            times += [((n * total[s] + done[s]) / target[s], place[k], k) for n in (0, 1)]
    served, until = 0, -1.0
    for t, _, k in sorted(times):
        served += size[k]
        if served <= sum(target.values()) + 1e-9:
            until = t
    return Counter(k for t, _, k in times if t <= until)


def plain_pipeline(rows, model):
    """Of rows (id, text, source, extra) in table order: (id, extra, text) of what the last stage packs."""
    rows = [r for r in rows if plain_score(model, r[1])[0] < 0.7]
    _, root = brute.jaccard_groups([r[1] for r in rows], 5, 80)
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, texts = set(), {}
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\x01" * 100
            seen.add(data[at : at + 100])
        texts[k] = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
    rows = [(r[0], texts[k], r[2], r[3]) for k, r in enumerate(rows)]
    taken = plain_mix([r[:3] for r in rows])
    return [(rows[k][0], rows[k][3], rows[k][1]) for k in taken for _ in range(taken[k])]


@pytest.mark.parametrize("case", ["full", "empty"])
def test_pipeline_run_against_plain_stages(spark, tmp_path, case):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").limit(250).collect()
    shared = " ".join(f"passage{k}" for k in range(60))
    texts = odd_texts(21) + ["you are an idiot and a moron", "he said you are not an idiot", f"{shared} é tail one", f"head {shared}", "é" * 120]
    rows = [tuple(r) for r in base] + [(10**6 + k, t, (None, "web", "news", "src0")[k % 4]) for k, t in enumerate(texts)] + [(None, "a text without an id", "web"), (5, "an id twice", None), (5, "an id twice more", "web")]
    if case == "empty":
        rows = [(1, None, None), (2, "", "web")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, _row long, kept string, spans int, taken int, n_bytes long"
    table = spark.createDataFrame([(*r, "en", len(r[1] or ""), k, "k", None, 3, k) for k, r in enumerate(rows)], schema).coalesce(1)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(documents, labels, F.lit(True))
    here = [(r["doc_id"], r["text"], r["source"], r["_row"]) for r in documents.collect()]
    want = plain_pipeline(here, model)
    # What each stage but the last returns, as the next one reads it.
    now = documents
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).checkpoint()
        assert now.columns == documents.columns, name
    assert Counter((r["doc_id"], r["_row"], r["text"]) for r in now.collect()) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "k" for r in now.collect())
    # And run() as a whole.
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = Counter()
    for i, _, t in want:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4").tobytes()
            pieces[i, k, at, len(own) // 4, zlib.crc32(own)] += 1
    out = p.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    used = brute.packing_is_valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 2048)
    assert used <= -(-sum(r["length"] for r in out) // 2048) * 1.01 + 1
    assert (case == "empty") == (not out)


def test_no_folder_of_this_machine_on_a_cluster():
    context = SimpleNamespace(environment={}, defaultParallelism=8, master="spark://far:7077", getCheckpointDir=lambda: None)
    conf = {}
    far = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__))
    with pytest.raises(RuntimeError, match="share"):
        common.prepare(far)
    assert conf == {"spark.sql.files.minPartitionNum": "8"}  # files are cut alike whatever executors come and go
    conf["spark.checkpoint.dir"] = "hdfs://far/checkpoints"
    common.prepare(far)


def test_mix_does_not_depend_on_ranges(spark, monkeypatch):
    rows = [(None if k % 3 else k, " ".join(["w"] * (k % 17)), ("a", "b", None)[k % 3]) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter((rows[k][0], rows[k][1], rows[k][2]) for k, n in plain_mix(rows).items() for _ in range(n))
    for slot_rows in (1, 20, 50_000):
        monkeypatch.setattr(mixing, "SLOT_ROWS", slot_rows)
        out = mixing.mix(d, keep=("text", "source")).collect()
        got = Counter()
        for r in out:
            if r["taken"]:
                got[r["doc_id"], r["text"], r["source"]] += r["taken"] // r["size"]
        assert got == want
