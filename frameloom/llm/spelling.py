"""Spelling variants: words one edit apart by errata-trie merging, and the frequent form that each word is a variant of.

Two words are near if one code point was inserted, deleted or replaced. In the
trie of some words such a pair parts at one node: below it, the pair's rests
are equal after one character was skipped on either side (replaced) or on one
(inserted or deleted). So at every node the light subtrees, all but the
largest, are merged small-to-large: with one another and into the heavy one,
each light word once with its first character replaced, and once skipped, and
where two terminals coincide there is a pair. On the way from the root a word
lies in at most log2(words) light subtrees, which bounds the work whatever the
words' lengths.

No trie holds all words. A pair of classes (shorter length L) parts inside a window
of positions and agrees around it, so words meet in blocks: by all but their
first half, and by all but their second. Blocks that hold too many words are
dealt again by all but half of the window, as often as needed; a window of one
position holds few, as the alphabet has few letters.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mapped, parts_for, prepare

#: Different words that a task counts before it passes them on.
HELD_WORDS = 300_000
#: Words of a block that is not dealt again, and the share of all entries that a block may have at least; fewer than 2 ** 16 blocks have more.
BLOCK_WORDS, BLOCK_SHARE = 1 << 15, 1 << 16
_FOLD = LOWER.tobytes()


def shortened(run: bytes, start: int, every: int) -> bytes:
    """The run (Latin-1, lower case), without one letter if the crc32 of `<id>:<run>` in UTF-8 says so; `start` is the crc32 of `<id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run if not every or h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least_length: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least `least_length`, lower-cased by A-Z only, counted over all documents.

    Where `noise` divides the crc32 of `<id>:<run>`, one letter of the run is
    left out first (0: never). Texts are read whole, in Latin-1, where each code point is
    a byte and others are no letters; a task counts its words before they are shuffled.
    """
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)
    held = HELD_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{name}:".encode())
                own = Counter(runs.findall(text.as_py().encode("latin-1", "replace").translate(_FOLD)))
                for run, n in own.items():
                    word = shortened(run, start, noise)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= held:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = mapped(docs.select(name.alias("id"), F.col(text_col).cast("string").alias("text")), work, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# -- the trie of a block ---------------------------------------------------------------------------


def common_prefix(a: str, b: str, start: int) -> int:
    """Length of the common prefix of strings that agree up to `start`."""
    d, step = start, 1
    while a[d : d + step] == b[d : d + step] and d < len(a) and d < len(b):
        d, step = min(d + step, len(a), len(b)), step * 2
    while step > 1:
        step //= 2
        if d + step <= min(len(a), len(b)) and a[d : d + step] == b[d : d + step]:
            d += step
    return d


def near_pairs(words: list[str], inside: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list of different words that are one edit apart and part at a position that `inside` accepts; each once.

    A subtree is a range of the list and a node the length of a range's common
    prefix. Of an inserted letter among equal ones the last counts, so a pair parts at one node only.
    """
    at = {w: k for k, w in enumerate(words)}
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        depth = common_prefix(words[low], words[high - 1], depth)
        node = words[low][:depth]
        children, k = [], low
        if len(words[low]) == depth:
            k += 1  # a word ends at the node
        while k < high:
            end = bisect_left(words, node + chr(ord(words[k][depth]) + 1), k, high)
            children.append((k, end))
            k = end
        stack += [(a, b, depth + 1) for a, b in children]
        if not inside(depth):
            continue
        heavy = max(children, key=lambda c: c[1] - c[0])
        into = node + words[heavy[0]][depth]
        if len(words[low]) == depth and (x := at.get(into)) is not None:
            yield low, x  # the heavy letter skipped, nothing after it
        merged: dict[str, list[int]] = {}
        for child in sorted(children, key=lambda c: c[1] - c[0]):
            if child == heavy:
                continue
            for k in range(*child):
                word = words[k]
                rest = word[depth + 1 :]
                if (x := at.get(into + rest)) is not None:
                    yield k, x  # its letter replaced by the heavy one
                if (x := at.get(into + word[depth:])) is not None:
                    yield k, x  # the heavy letter skipped
                if rest[:1] != word[depth] and (x := at.get(node + rest)) is not None:
                    yield k, x  # its letter skipped
                others = merged.setdefault(rest, [])
                for x in others:
                    yield k, x  # replaced by that of another light subtree
                others.append(k)


# -- blocks ------------------------------------------------------------------------------------------

_WINDOW = "struct<l:int,i:int,j:int>"


def _windows(l: Column, i: Column, j: Column) -> Column:
    return F.struct(l.cast("int").alias("l"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def keyed(rows: DataFrame, windows: Column) -> DataFrame:
    """word, n, l, i, j, key: a row for each window [i, j) of the class l; the key is of the class, the window and the letters around it."""
    after = F.greatest(F.lit(0), F.col("l") - F.col("j"))
    out = rows.select("word", "n", F.inline(windows))
    return out.withColumn("key", F.xxhash64("l", "i", "j", F.substring("word", F.lit(1), F.col("i")), F.expr("right(word, greatest(0, l - j))"), after))


def blocks(words: DataFrame, least_length: int) -> DataFrame:
    """Every word in each block that a pair of it may be in; blocks of too many words are dealt by smaller windows."""
    size = F.char_length("word")
    halves = lambda l: [_windows(l, F.lit(0), F.floor(l / 2)), _windows(l, F.floor(l / 2), l + 1)]
    # As a word of length l, and as the longer of a pair whose shorter word has l - 1.
    both = F.when(size > least_length, F.array(*halves(size), *halves(size - 1))).otherwise(F.array(*halves(size)))
    ready, now = None, keyed(words, both)
    total = 4 * words.count()
    while True:
        large = now.groupBy("key").agg(F.count("*").alias("_n"), F.max(F.col("j") - F.col("i")).alias("_w")).filter((F.col("_n") > max(BLOCK_WORDS, total // BLOCK_SHARE)) & (F.col("_w") > 1)).select("key").checkpoint()
        if large.isEmpty():
            return now if ready is None else ready.unionByName(now)
        small = now.join(F.broadcast(large), "key", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        middle = F.floor((F.col("i") + F.col("j")) / 2)
        cut = F.when(F.col("j") - F.col("i") > 1, F.array(_windows(F.col("l"), F.col("i"), middle), _windows(F.col("l"), middle, F.col("j")))).otherwise(F.array(_windows(F.col("l"), F.col("i"), F.col("j"))))
        again = now.join(F.broadcast(large), "key", "left_semi").select("word", "n", cut.alias("_cut"))
        now = keyed(again, F.col("_cut")).checkpoint()


def partners(words: DataFrame, least_length: int = 7) -> DataFrame:
    """word, n_near, best (struct of -n and word): per word and block the near words, counted, and the most frequent of them (ties: the smallest)."""
    dealt = blocks(words, least_length)
    dealt = dealt.repartition(parts_for(words, 2.0), "key").sortWithinPartitions("key", "l", "i", "j")
    schema = "word string, n_near long, minus long, near string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: dict[str, int], l: int, i: int, j: int) -> Iterator[tuple]:
            names = sorted(block)
            near, best = Counter(), {}
            for a, b in near_pairs(names, lambda p: i <= p < j):
                if min(len(names[a]), len(names[b])) != l:
                    continue  # a pair of another class
                for x, y in ((a, b), (b, a)):
                    near[x] += 1
                    best[x] = min(best.get(x, (0, "")), (-block[names[y]], names[y]))
            for x, k in near.items():
                yield names[x], k, *best[x]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "minus", "near"])

        now, block, rows = None, {}, []
        for batch in batches:
            for word, n, *of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    if len(block) > 1:
                        rows += told(block, *now[:3])
                    now, block = of, {}
                block[word] = n
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
        if len(block) > 1:
            rows += told(block, *now[:3])
        if rows:
            yield out(rows)

    return mapped(dealt.select("word", "n", "l", "i", "j", "key"), work, schema)


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least `least_length` letters and `least_count` occurrences.

    A word's form is its near word with the greatest n (ties: the smallest by
    code point) if that n is at least `ratio` times its own, else null; its
    root is what forms lead to, itself if it has none. A form is more frequent than its
    word, so forms never lead in a circle.

    Null and empty texts have no words; a null id is written `null` for
    `noise`; repeated rows are documents of their own; words that are equally
    frequent are no forms of each other. Texts and words of any length are read whole: a
    task holds one text, and one block of words.
    """
    prepare(docs.sparkSession)
    words = word_counts(docs, least_length, noise, id_col, text_col).filter(F.col("n") >= least_count).checkpoint()
    found = partners(words, least_length).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("minus", "near").alias("best"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:bigint,near:string>").alias("best"))
    met = every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    leads = -F.col("best.minus") >= ratio * F.col("n")
    told = met.select("word", "n", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n")).checkpoint()
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(told: DataFrame) -> DataFrame:
    """word, root of each word with a form: forms followed to the last, twice as far in each round; few words share a form, so joins have no hot key."""
    now = told.filter("form is not null").select("word", F.col("form").alias("root")).checkpoint()
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        after = now.join(far, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_more")).checkpoint()
        if after.filter("_more").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")
