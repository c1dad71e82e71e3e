"""Token counts without ids: pieces once per distinct pre-token, joined to each document's frequencies and summed.

White space bounds the pre-tokens, so a document's count is the sum over its
distinct pre-tokens of their frequency times their pieces. A chunk of
documents sends each of its distinct pre-tokens once to the bucket that its
hash names; a bucket has one table of all distinct pre-tokens of the corpus
that fall to it, encodes each of them once and answers each chunk with their
numbers of pieces, in the order in which it sent them. The chunk's
frequencies travel beside, packed as (number of the pre-token in the chunk,
frequency), and meet the answers in one join by chunk. No ids are made, and a pre-token that all documents
hold reaches its bucket once per chunk.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, prepare
from .substring_dedup import numbered, packed
from .suffix_dedup import pack, unpack

#: Unicode white space, as both tokenizers' patterns understand \s.
WHITE = "\t-\r \x85\xa0  -     　"
#: Latin-1 letters, and the marks that often follow a word; a word or mark so bounded is a pre-token of its own.
_LATIN, _MARK, _END = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?]", f"(?=[{WHITE}]|\\Z)"
_WORD = f"{_LATIN}+(?={_MARK}?(?:[{WHITE}]|\\Z))|{_MARK}{_END}|"
#: Pre-tokens that no later or earlier text can change. Byte-level tokenizers give a space to the word after it.
SPACED = re.compile(f" ?{_WORD} ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: Those of tokenizers that drop white space.
BARE = re.compile(f"{_WORD}[^{WHITE}]+")
#: Words that no normaliser but lower-casing changes.
PLAIN = re.compile(f" ?{_LATIN}+")
#: The characters that byte-level tokenizers write for bytes: printable Latin-1 for itself, the others from 256 on.
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _shown} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_shown}))}
#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
_loaded: dict[str, Pieces] = {}


class Pieces:
    """Encodes pre-tokens by a tokenizers file; `learn` remembers what `keep` makes of their ids."""

    def __init__(self, path: str, pattern: re.Pattern, keep) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern, self.keep, self.known = pattern, keep, {}
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.strings = frozenset(special)
        self.lower = self.tokenizer.normalizer is not None  # of the two kinds of tokenizer, only the one that drops white space has one

    @classmethod
    def of(cls, path: str, pattern: re.Pattern, keep) -> Pieces:
        key = f"{path} {pattern.pattern} {keep.__name__}"
        if key not in _loaded:
            _loaded[key] = cls(path, pattern, keep)
        return _loaded[key]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; strings of special tokens stand alone."""
        if self.special is None or not any(s in text for s in self.strings):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.strings else self.pattern.findall(part)
        return out

    def encode(self, pretokens: list[str]) -> list:
        """What `keep` makes of the ids of each pre-token."""
        out, rest, tokenize = [None] * len(pretokens), [], self.tokenizer.model.tokenize
        for k, t in enumerate(pretokens):
            if len(t) > LONGEST or t in self.strings or not PLAIN.fullmatch(t):
                rest.append(k)
                continue
            t_bytes = (t.lower() if self.lower else t).encode()
            out[k] = self.keep([x.id for x in tokenize(t_bytes.decode("latin-1").translate(BYTE_LETTERS))])
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pretokens[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = self.keep(e.ids)
        return out

    def learn(self, pretokens: set[str]) -> dict:
        """Values of the pre-tokens that are too long to be remembered; the others are in `known`."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new, long = [t for t in pretokens if t not in self.known], {}
        for t, value in zip(new, self.encode(new), strict=True):
            (self.known if len(t) <= LONGEST else long)[t] = value
        return long


def _count(ids: list[int]) -> int:
    return len(ids)


SENT = "bucket int, kind int, chunk long, n int, data binary"
ANSWER = "kind int, chunk long, bucket int, n int, data binary"
COUNTED = "id string, n_bytes long, n_tokens long"
TOKENS, ROWS = 0, 1


def strings(values: list[str | None]) -> bytes:
    raw = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]
    return pack(np.array([-1 if v is None else len(r) for v, r in zip(values, raw, strict=True)], "<i4"), np.frombuffer(b"".join(raw), np.uint8))


def from_strings(data: bytes, n: int) -> list[str | None]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    out, at = [], 4 * n
    for size in np.frombuffer(raw[:at], "<i4").tolist():
        out.append(None if size < 0 else raw[at : at + size].decode("utf-8", "surrogatepass"))
        at += max(0, size)
    return out


def _frequencies(path: str, pattern: re.Pattern, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct pre-tokens, to their buckets, and its documents' frequencies of them."""
        pieces = Pieces.of(path, pattern, _count)
        for chunk, part in numbered(batches):
            number: dict[str, int] = {}
            which, times, kinds, size = [], [], [], []
            for column in part["text"].chunks:
                for lo in range(0, len(column), 256):
                    for text in column.slice(lo, 256).to_pylist():
                        frequency = Counter(pieces.split(text)) if text else {}
                        which += [number.setdefault(t, len(number)) for t in frequency]
                        times += frequency.values()
                        kinds.append(len(frequency))
                        size.append(len(text.encode()) if text else 0)
            tokens = list(number)
            bucket = np.array([zlib.crc32(t.encode()) % buckets for t in tokens], np.int64)
            # Pre-tokens are numbered by bucket, so that the buckets' answers follow each other.
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(tokens), np.int64)
            rank[order] = np.arange(len(tokens))
            ids = strings(part["id"].to_pylist())
            rows = pack(np.array(size, "<i8"), np.array(kinds, "<i4"))
            entries = pack(rank[np.array(which, np.int64)].astype("<i4"), np.array(times, "<i4"))
            yield packed([(chunk % buckets, ROWS + k, chunk, n, data) for k, (n, data) in enumerate(((len(kinds), ids), (len(kinds), rows), (len(which), entries)))], SENT)
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    yield packed([(b, TOKENS, chunk, cut[b + 1] - cut[b], strings([tokens[k] for k in order[cut[b] : cut[b + 1]].tolist()]))], SENT)

    return work


def _pieces(path: str, pattern: re.Pattern):
    def work(group: pa.Table) -> pa.Table:
        """Encodes each distinct pre-token of a bucket once and answers each chunk; other rows pass."""
        pieces, of, out = Pieces.of(path, pattern, _count), {}, []
        for row in group.to_pylist():
            if row["kind"] != TOKENS:
                out.append((row["kind"], row["chunk"], row["bucket"], row["n"], row["data"]))
                continue
            sent = from_strings(row["data"], row["n"])
            new = [t for t in sent if t not in of]
            of.update(zip(new, pieces.encode(new), strict=True))
            out.append((TOKENS, row["chunk"], row["bucket"], row["n"], pack(np.array([of[t] for t in sent], "<i4"))))
        return pa.Table.from_batches([packed(out, ANSWER)])

    return work


def _sum(group: pa.Table) -> pa.Table:
    """The documents of a chunk: frequencies meet numbers of pieces."""
    rows = {r["kind"]: r for r in group.to_pylist() if r["kind"] != TOKENS}
    told = sorted((r["bucket"], r["n"], r["data"]) for r in group.to_pylist() if r["kind"] == TOKENS)
    count = np.concatenate([np.zeros(0, np.int64), *(unpack(data, n, "<i4")[0].astype(np.int64) for _, n, data in told)])
    n = rows[ROWS]["n"]
    size, kinds = unpack(rows[ROWS + 1]["data"], n, "<i8", "<i4")
    which, times = unpack(rows[ROWS + 2]["data"], rows[ROWS + 2]["n"], "<i4", "<i4")
    sums = np.concatenate([[0], np.cumsum(count[which] * times)])
    ends = np.cumsum(kinds)
    return pa.table([pa.array(from_strings(rows[ROWS]["data"], n), pa.string()), pa.array(size), pa.array((sums[ends] - sums[ends - kinds]).astype(np.int64))], ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, pattern: re.Pattern = SPACED, limit: int = 1024, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row, as the tokenizer at `path` counts its whole text.

    A null text counts as an empty one (0 bytes, 0 tokens); a null id stays
    null; repeated rows are counted each; ids may be of any type that is
    written and read as a string. A task holds the pre-tokens of some 12 MB of
    text, or of one longer text. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets or parts_for(rows)
    sent = rows.mapInArrow(_frequencies(path, pattern, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_pieces(path, pattern), ANSWER)
    counted = answers.groupBy("chunk").applyInArrow(lambda t: _sum(t), COUNTED)
    return counted.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
