"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon is a transducer of one state: its arcs read a word and write a
class (insult, threat, target, object of a threat, negation, reported speech,
first person, intent, clause end or other); an insult's class carries the
number of its weight. Transducers read classes: three remember that an insult,
a threat's verb or a target was met, one that someone who speaks of himself
announces a threat at an object, one the heaviest insult, two whether insults
and threats stood in the scope of a negation or of reported speech; each
forgets at the end of a clause. Their product, composed with a matcher of
clauses, writes for each clause with an insult, an announced threat or a
threat's verb beside a target the context in which it stands. Composed once
more with a model's weights, an arc at the end of a clause weighs what the
clause adds, and a text's score is the logistic of the weight of its path.
A clause with an insult weighs as
much as its heaviest term; where it is negated or reported no more than what makes a
text with such a clause alone as likely toxic as that context is, and so does
any clause with a threat.

Arcs of products are made when a text first needs them and kept, so only the
states that texts reach exist.

Insults and all weights are learned from labels. How likely a context is toxic is the share of toxic rows
among those with clauses of that context only, together with STRENGTH rows of which as
many are toxic as BELIEVED says: before labels tell otherwise, negation and
reported speech clear a clause, and an announced threat convicts ("I will kill you"). A
threat's verb that merely shares its clause with a target ("she beat him at
chess") is believed no more toxic than any text, so it weighs nothing until
labels give evidence. The fit is a bounded sample
(at most FIT_ROWS labelled rows, a third of them toxic where there are so
many): terms are words and word beginnings of 4 to 6 letters, kept if a
likelihood ratio test tells them clearly from chance. A term counts once for
each pair of neighbours it has in toxic rows, at most once for each row, so
the words that copies of one toxic row share are no evidence; for contexts, too, copies of a toxic row
count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

FIT_ROWS, LEAST_RATIO, LEAST_WEIGHT = 12_000, 20.0, 4.0
STEMS = (4, 5, 6)
#: Cue words of the grammar in four languages.
THREATS = frozenset("kill hurt shoot stab beat destroy burn töten umbringen verletzen schlagen tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGETS = frozenset("your yours he she they these those du ihr tu ils elles tú él ella".split())
OBJECTS = frozenset("you him her them people dir toi lui eux ti usted ustedes ellos ellas".split())
BEFORE = frozenset("dich euch sie ihn te vous".split())
NEGATIONS = frozenset("not no never neither nor without nobody none nicht kein keine nie ohne niemand pas jamais aucun aucune sans personne nunca jamás sin ningún ninguna nadie".split())
REPORTS = frozenset("said says say wrote writes called calls quoted reported claimed alleged sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
SELVES = frozenset("i we ich wir je nous yo nosotros nosotras".split())
INTENTS = frozenset("will ll shall gonna going want must should werde werden wollen vais allons veux voulons".split())
PROMISES = frozenset("voy vamos quiero queremos".split())
ENDS = frozenset(".!?;:\n")
#: How likely texts with clauses of one context only are toxic, as long as labels say nothing: announced threats, and what is negated (n), reported (r) or both. Rows that this belief counts as.
BELIEVED, STRENGTH = {"": 0.8, "n": 0.1, "r": 0.3, "nr": 0.05}, 20.0
#: Classes. OBJECT follows a threat's verb, PRIOR (in languages that put it there) may also precede it; PROMISE is SELF and INTENT in one word.
INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = "ITYNRB."
OBJECT, PRIOR, SELF, INTENT, PROMISE = "OPSWV"
#: What a context begins with where a threat's verb merely shares a clause with a target; how far an object stands from the verb, after and before it.
CUE, FOLLOWS, PRECEDES = "C", 2, 3
CUES = {w: kind for kind, words in ((PROMISE, PROMISES), (INTENT, INTENTS), (SELF, SELVES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (PRIOR, BEFORE), (OBJECT, OBJECTS), (THREAT, THREATS), (END, ENDS)) for w in words}
_tokens = re.compile(r"[^\W\d_]+|[.!?;:\n]").findall
_words = re.compile(r"[^\W\d_]+").findall


class Transducer:
    """step(state, class) gives the next state and what is written, a tuple."""

    def __init__(self, start, step: Callable[[object, str], tuple]) -> None:
        self.start, self.step = start, step

    def __mul__(self, other: Transducer) -> Transducer:
        """Both read the same classes; what they write is joined."""

        def both(s: tuple, c: str) -> tuple:
            (x, u), (y, v) = self.step(s[0], c), other.step(s[1], c)
            return (x, y), u + v

        return Transducer((self.start, other.start), both)

    def then(self, match: Callable[[tuple], object]) -> Transducer:
        """Composed with a transducer of one state that reads what an arc writes."""

        def step(s, c: str) -> tuple:
            after, written = self.step(s, c)
            return after, match(written)

        return Transducer(self.start, step)


class Arcs(dict):
    """(state, class) -> (next state, what is written) of a transducer, from state 0: each arc is made when first asked for."""

    def __init__(self, of: Transducer) -> None:
        self.of, self.states, self.number = of, [of.start], {of.start: 0}

    def __missing__(self, key: tuple[int, str]) -> tuple:
        after, written = self.of.step(self.states[key[0]], key[1])
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        self[key] = arc = (self.number[after], written)
        return arc


def met(name: str, kinds: str) -> Transducer:
    """Writes `name` at the end of a clause that has one of some classes."""
    return Transducer(False, lambda s, c: (False, (name,) if s else ()) if c == END else (s or c[0] in kinds, ()))


def scope(opens: str, reach: int, name: str, every: bool) -> Transducer:
    """Writes `name` at the end of a clause if every (or one) insult or threat in it stands at most `reach` words after the class `opens`."""

    def step(s: tuple[int, bool], c: str) -> tuple:
        left, flag = s
        if c == END:
            return (0, every), (name,) if flag else ()
        if c[0] in (INSULT, THREAT):
            flag = flag and left > 0 if every else flag or left > 0
        return (reach if c == opens else max(0, left - 1), flag), ()

    return Transducer((0, every), step)


def announced() -> Transducer:
    """Writes "a" at the end of a clause in which a first person, then an intent, then a threat's verb stand, and an object next to the verb."""

    def step(s: tuple[int, int, int, bool], c: str) -> tuple:
        stage, before, after, done = s
        if c == END:
            return (0, 0, 0, False), ("a",) if done else ()
        if done:
            return s, ()
        done = c in (OBJECT, PRIOR) and after > 0 or c == THREAT and stage == 2 and before > 0
        after = FOLLOWS if c == THREAT and stage == 2 else max(0, after - 1)
        before = PRECEDES if c == PRIOR else max(0, before - 1)
        stage = 2 if c == PROMISE or c == INTENT and stage else max(stage, int(c == SELF))
        return ((0, 0, 0, True) if done else (stage, before, after, False)), ()

    return Transducer((0, 0, 0, False), step)


def heaviest() -> Transducer:
    """Writes the number of the heaviest insult's weight at the end of a clause, 0 without one."""
    return Transducer(0, lambda s, c: (0, (s,)) if c == END else (max(s, int(c[1:] or 0)) if c[0] == INSULT else s, ()))


def clause(written: tuple) -> tuple:
    """The context of a clause with an insult, an announced threat, or a threat's verb and a target."""
    if INSULT in written:
        kind = INSULT
    elif "a" in written:
        kind = THREAT
    elif THREAT in written and TARGET in written:
        kind = CUE
    else:
        return ()
    return (kind + "y" * (TARGET in written) + "".join(w for w in written if w in "nr"),)


MATCHER = (met(INSULT, INSULT) * met(THREAT, THREAT) * met(TARGET, TARGET + OBJECT + PRIOR) * announced() * scope(NEGATION, 3, "n", True) * scope(REPORT, 8, "r", False)).then(clause)
#: What is written is (context, number of the heaviest insult's weight), or nothing.
WEIGHED = (MATCHER * heaviest()).then(lambda written: written if len(written) == 2 else ())


class Lexicon:
    """A transducer of one state from words to classes; weights of words and of word beginnings, numbered from 1 by their size."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.whole = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.levels = [0.0, *sorted({*terms.values()})]
        self.classes = {w: f"{INSULT}{k}" for k, w in enumerate(self.levels)}

    def weight(self, word: str) -> float:
        w = self.whole.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n and (s := self.stems.get(word[:n])) is not None and s > w:
                w = s
        return w

    def read(self, text: str) -> list[str]:
        """The classes of a text's words and clause ends; empty if it can have no matched clause."""
        tokens = _tokens(text.lower())
        distinct = set(tokens)
        hit = {w: self.classes[x] for w in distinct if w not in ENDS and (x := self.weight(w)) > 0}
        if not hit and THREATS.isdisjoint(distinct):
            return []
        classes = {w: hit.get(w) or CUES.get(w, OTHER) for w in distinct}
        return [*map(classes.__getitem__, tokens), END]


_shared = Arcs(WEIGHED)


def clauses(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """(context, weight of the heaviest term) of each matched clause.

    A context is I (insult), T (announced threat) or C (a threat's verb and a
    target), then y if the clause has a target, n if every insult and threat
    is negated, r if one is reported.
    """
    out, state = [], 0
    for c in lexicon.read(text):
        state, wrote = _shared[state, c]
        if wrote:
            out.append((wrote[0], lexicon.levels[wrote[1]]))
    return out


def terms_of(text: str) -> set[str]:
    found = set(_words(text.lower()))
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) >= n}


def log_odds(a: float, n: float, b: float, m: float, prior: float = 0.5) -> float:
    """ln of how much likelier a of n is than b of m."""
    return math.log((a + prior) / (n + 2 * prior)) - math.log((b + prior) / (m + 2 * prior))


def ratio(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio (G) of a of n against b of m; 0 if the first share is no larger."""
    if not n or not m or a * m <= b * n:
        return 0.0
    p = (a + b) / (n + m)
    part = lambda k, of, q: (k * math.log(k / (of * q)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - q))) if of > k else 0.0)
    return 2 * (part(a, n, p) + part(b, m, p))


def ratio_of(a: Column, n: int, b: Column, m: int) -> Column:
    """As ratio(), of columns."""
    p = (a + b) / F.lit(float(max(1, n + m)))
    log = lambda k, q: F.when(k > 0, k * F.log(k / q)).otherwise(F.lit(0.0))
    part = lambda k, of: log(k, F.lit(float(of)) * p) + log(F.lit(of) - k, F.lit(float(of)) * (1 - p))
    return 2 * (part(a, n) + part(b, m))


def choose(rows: list[tuple[str, int, int]], n: int, m: int) -> dict[str, float]:
    """Terms that tell toxic rows, by falling ratio; of terms of which one begins another only the first."""
    scored = sorted(((-ratio(a, n, b, m), t.endswith("*"), -len(t), t, a, b) for t, a, b in rows))
    out: dict[str, float] = {}
    taken: set[str] = set()
    starts: set[str] = set()
    for g, _, _, t, a, b in scored:
        if -g < LEAST_RATIO:
            break
        bare = t.removesuffix("*")
        if t.endswith("*") and bare in starts or any(bare[:k] in taken for k in STEMS):
            continue
        if (w := log_odds(a, n, b, m)) >= LEAST_WEIGHT:
            out[t] = w
            if t.endswith("*"):
                taken.add(bare)
            starts.update(bare[:k] for k in STEMS)
    return out


class Model:
    """A lexicon, what each context adds to an insult's weight, the most that a clause in a context can weigh, and the log odds of texts with and without a matched clause."""

    def __init__(self, lexicon: Lexicon, offset: dict[str, float], most: dict[str, float], prior: float, nothing: float) -> None:
        self.lexicon, self.offset, self.most, self.prior, self.nothing = lexicon, offset, most, prior, nothing
        self.arcs: Arcs | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "arcs": None}  # made anew by each worker

    def weight(self, context: str, term: float) -> float:
        """Of a clause; `term` is the weight of its heaviest insult."""
        most = self.most.get(context, math.inf)
        return max(0.0, min(most, term + self.offset[context]) if context.startswith(INSULT) else most)

    def weighted(self) -> Arcs:
        """The grammar whose arcs at ends of matched clauses write (what the clause weighs,)."""
        if self.arcs is None:
            self.arcs = Arcs(WEIGHED.then(lambda w: (self.weight(w[0], self.lexicon.levels[w[1]]),) if w else ()))
        return self.arcs

    def score(self, text: str | None) -> tuple[float, int]:
        """From 0 to 1, and the number of matched clauses."""
        arcs, state, matched, total = self.weighted(), 0, 0, self.prior
        for c in self.lexicon.read(text or ""):
            state, weight = arcs[state, c]
            if weight:
                matched, total = matched + 1, total + weight[0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total if matched else self.nothing)))), matched

    def column(self, text: Column) -> Column:
        """The score of a text column."""

        def scores(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(t)[0] for t in texts], dtype="float64")

        return F.pandas_udf(scores, "double")(text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from at most about fit_rows labelled rows; see toxicity()."""
    spark = docs.sparkSession
    prepare(spark)
    usable = labels.filter(F.coalesce(learn, F.lit(False)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.monotonically_increasing_id().alias("label"))
    # By row, not by id: at most fit_rows of them, whatever ids they have, so that they may be broadcast.
    some = lambda toxic, most: usable.filter(F.col("y") == 1 if toxic else F.col("y") != 1).orderBy(F.xxhash64("label", F.lit(5)), "label").limit(most)
    sample = some(True, fit_rows // 3).unionByName(some(False, fit_rows - fit_rows // 3)).checkpoint()
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # An id may stand on many documents and on many labels: of what they make together at most about as many again.
    met = {r["y"]: r["n"] for r in known.select("id").join(F.broadcast(sample), "id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = F.when(F.col("y") == 1, min(1.0, fit_rows / max(1, 3 * met.get(1, 0)))).otherwise(min(1.0, fit_rows / max(1, sum(n for y, n in met.items() if y != 1))))
    drawn = F.pmod(F.xxhash64("row", "label", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0 < most
    drawn_rows = known.join(F.broadcast(sample), "id").filter(drawn).select("text", "y").checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(y == 1)].update(terms_of(text))
        terms = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(terms), 20_000):
            own = terms[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array([seen[y][t] for t in own], pa.int64()) for y in (1, 0))], ["term", "a", "b"])

    sizes = drawn_rows.groupBy("y").agg(F.count("*").alias("n")).collect()
    n, m = sum(r["n"] for r in sizes if r["y"] == 1), sum(r["n"] for r in sizes if r["y"] != 1)
    found = drawn_rows.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Only terms that tell toxic rows clearly come to the driver.
    clear = found.filter((F.col("a") >= 3) & (F.col("a") * m > F.col("b") * n * 4)).filter(ratio_of(F.col("a"), n, F.col("b"), m) >= LEAST_RATIO)
    likely = {r["term"]: (r["a"], r["b"]) for r in clear.collect()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y != 1:
                    continue
                found = ["", *_words(text.lower()), ""]
                for before, w, after in zip(found, found[1:], found[2:], strict=False):
                    for t in (w, *(w[:k] + "*" for k in STEMS if len(w) >= k)):
                        if t in likely:
                            seen.add((t, zlib.crc32(f"{before} {w} {after}".encode())))
        pairs = list(seen)
        for lo in range(0, len(pairs), 20_000):
            own = pairs[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.string()), pa.array([c for _, c in own], pa.int64())], ["term", "context"])

    apart = {r["term"]: r["n"] for r in drawn_rows.mapInArrow(neighbours, "term string, context long").groupBy("term").agg(F.count_distinct("context").alias("n")).collect()}
    lexicon = Lexicon(choose([(t, min(a, apart.get(t, 0)), b) for t, (a, b) in likely.items()], n, m))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {c for c, _ in clauses(text, lexicon)}
                # Copies of a toxic row are no evidence for a context.
                mark = zlib.crc32(text.encode()) if y == 1 else 0
                if len(found) == 1:
                    seen.update((c, int(y == 1), mark) for c in found)
                seen.update((c, int(y == 1), -1) for c in found or {""} if not c.startswith((THREAT, CUE)))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*seen, strict=True) if seen else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)] + [pa.array(list(seen.values()), pa.int64())], ["context", "y", "mark", "n"])

    stood, alone = Counter(), Counter()
    told = drawn_rows.mapInArrow(context, "context string, y long, mark long, n long").withColumn("alone", F.col("mark") >= 0).groupBy("context", "y", "alone", "mark").agg(F.sum("n").alias("n"))
    for r in told.groupBy("context", "y", "alone").agg(F.sum(F.when((F.col("y") == 1) & F.col("alone"), F.lit(1)).otherwise(F.col("n"))).alias("n")).collect():
        (alone if r["alone"] else stood)[r["context"], r["y"]] = r["n"]
    prior = math.log((n + 1) / (m + 1))
    offset, most_of = {}, {}
    for kind, y, marks in product((INSULT, THREAT, CUE), ("", "y"), BELIEVED):
        c = kind + y + marks
        if kind == INSULT:
            seen_by = stood[c, 1] + stood[c, 0]
            learned = min(1.0, log_odds(stood[c, 1], n, stood[c, 0], m)) if seen_by and n and m else 0.0
            offset[c] = (0.5 * (y == "y") * 3.0 + learned * seen_by) / (3.0 + seen_by)
        if kind != INSULT or marks:
            believed = BELIEVED[marks] if kind != CUE else (n + 1) / (n + m + 2)
            share = (alone[c, 1] + STRENGTH * believed) / (alone[c, 1] + alone[c, 0] + STRENGTH)
            most_of[c] = math.log(share / (1 - share)) - prior
    nothing = prior + (log_odds(stood["", 1], n, stood["", 0], m) if n and m else 0.0)
    return Model(lexicon, offset, most_of, prior, nothing)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, score (0 to 1) and n_clauses (matched) of every row.

    `learn`, an expression over the labels' id column, is true of labels that
    may be learned from. Null labels and ids are not learned from; a label
    given twice counts twice, and so does an id of two documents; the sample is
    bounded all the same. A null text is an empty one: it has no matched
    clause and gets the score of texts without one. Without labels of both
    kinds every score is 0.5 or below. A null id stays null; repeated rows are
    scored each; an empty table gives an empty table.
    """
    model = fit(docs, labels, learn, id_col, text_col, label_col, fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["id", "score", "n_clauses"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"id {kind}, score double, n_clauses long").withColumnRenamed("id", id_col)
