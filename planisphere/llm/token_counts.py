"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut into windows at ASCII blanks, and windows are taken in batches of about equal bytes. Inside a batch each distinct word is
encoded once, split further between letters and sentence marks: no token, merge, normalisation or special string of the tokenizer
reaches across these boundaries, so a text's count is the sum over its pieces. Words to encode go many to a line with a token
between them that no other piece can give, as a call for each would cost more than its encoding. A worker remembers short words.
Memory is bounded by the Arrow batch, `WINDOW`, `BATCH` and `REMEMBERED`.

The boundaries suit tokenizers that drop white space and never join across it, nor letters with marks (word-level BPE such as
word_bpe_49k.json); `check_boundaries` refuses others. A run without any boundary is encoded whole.

Defined results: null and empty texts have no bytes and no tokens; repeated rows are counted each; no rows give no rows; columns of
the input named n_bytes, n_tokens or over_limit are replaced, all others stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, of a batch of windows, and of a line of short pieces.
WINDOW, BATCH, LINE = 1 << 18, 1 << 22, 1 << 14
#: Words, and parts of words, that a worker remembers (some 100 bytes each), and bytes of such a word at most.
REMEMBERED, SHORT = 1_000_000, 64
LIMIT = 2048
#: Marks that belong to no special string and no contraction, and letters of scripts settled long ago; no accent follows at such a boundary,
#: nor comes from lower-casing (as it does of İ).
_MARKS, _LETTERS = r"[!\"#$%&()*+,\-./:;=?@\[\]^_{}、。，：；！？]", "[A-Za-zÀ-ÖØ-öø-įı-ɏぁ-ゖァ-ヺ一-鿿가-힣]"
_BOUNDARY = re.compile(f"(?<={_LETTERS})(?={_MARKS})|(?<={_MARKS})(?={_LETTERS})")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Stands between short pieces; no piece that holds it is put on a line.
_BETWEEN = "~"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, with its defaults but without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def check_boundaries(path: str) -> None:
    """An error if counts of pieces would not add up."""
    size = lambda text: len(tokenizer(path).encode(text, add_special_tokens=False))
    for pieces in (("Ab", " \n", "cd's"), ("one.", "two"), ("one", "."), ("́", "\t", "é"), ("一", "。", "二"), ("x" * 40, " ", "7" * 9)):
        if size("".join(pieces)) != sum(map(size, pieces)):
            raise ValueError(f"{path}: tokens reach across blanks or sentence marks; texts can't be split safely")
    if size(_BETWEEN) != 1:
        raise ValueError(f"{path}: {_BETWEEN} is not one token")


def windows(text: bytes, most: int = WINDOW) -> Iterator[bytes]:
    """The text in pieces of at most `most` bytes that begin at blanks; longer only where there is no blank."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(b, at + 1, at + most + 1) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end < 0:
            found = _BLANK.search(text, at + most)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def balanced(sizes: list[int], batch: int) -> list[tuple[int, int]]:
    """Ranges of neighbours of about equal sums: no more than `batch` and one size each."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return []
    n = max(1, -(-int(ends[-1]) // batch))
    at = np.unique(np.concatenate([[0], np.searchsorted(ends, ends[-1] * np.arange(1, n) / n, side="left") + 1, [len(ends)]]))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class Counter:
    """Counts texts; remembers the lengths of short words across batches."""

    def __init__(self, path: str, batch: int = BATCH, window: int = WINDOW, remembered: int = REMEMBERED):
        self.tokenizer, self.batch, self.window, self.remembered = tokenizer(path), batch, window, remembered
        (self.between,) = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.known: dict[bytes, int] = {}
        self.parts: dict[str, int] = {}
        self.encoded = 0  # characters

    def encode(self, texts: list[str]) -> list:
        """Encodings, in batches balanced by size."""
        sizes, out = [len(t) for t in texts], []
        self.encoded += sum(sizes)
        for a, b in balanced(sizes, WINDOW):
            out += self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)
        return out

    def lengths(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each of some distinct pieces."""
        short = [p for p in pieces if len(p) <= SHORT and _BETWEEN not in p]
        lines, out = balanced([len(p) for p in short], LINE), {}
        for (a, b), line in zip(lines, self.encode([f" {_BETWEEN} ".join(short[a:b]) for a, b in lines])):
            ends = np.flatnonzero(np.array([*line.ids, self.between]) == self.between)
            out.update(zip(short[a:b], (np.diff(ends, prepend=-1) - 1).tolist()))
        rest = [p for p in pieces if p not in out]
        return out | dict(zip(rest, map(len, self.encode(rest))))

    def learn(self, words: list[bytes]) -> None:
        """Put the lengths of distinct words into `known`."""
        parts = [_BOUNDARY.split(w.decode()) for w in words]
        if len(self.parts) > self.remembered:
            self.parts = {}
        fresh = {p: None for ps in parts for p in ps if p not in self.parts}
        self.parts |= self.lengths(list(fresh))
        size = self.parts.__getitem__
        self.known.update(zip(words, [size(ps[0]) if len(ps) == 1 else sum(map(size, ps)) for ps in parts]))
        for p in fresh:
            if len(p) > SHORT:
                del self.parts[p]

    def totals(self, batch: list[bytes]) -> list[int]:
        """Tokens of each window of a batch."""
        known, split = self.known, [w.split() for w in batch]  # of bytes: at ASCII blanks alone
        if len(known) > self.remembered:  # the words of this batch are likely frequent ones
            known = self.known = {w: known[w] for words in split for w in words if w in known}
        fresh = list({w: None for words in split for w in words if w not in known})
        self.learn(fresh)
        out = [sum(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > SHORT:
                del known[w]
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out, batch, owners, size = np.zeros(len(texts), np.int64), [], [], 0
        for k, text in enumerate(texts.cast(pa.large_binary())):
            for w in windows(text.as_py() or b"", self.window):
                if batch and size + len(w) > self.batch:
                    np.add.at(out, owners, self.totals(batch))
                    batch, owners, size = [], [], 0
                batch.append(w)
                owners.append(k)
                size += len(w)
        if batch:
            np.add.at(out, owners, self.totals(batch))
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One for each file a worker uses, kept from task to task."""
    return Counter(path)


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: the tokenizer's file, at the same place on every machine. One pass, nothing is shuffled.
    """
    check_boundaries(path)

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts in batches:
            yield pa.array(counter(texts), pa.int64())

    counted = docs.withColumns({"n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "n_tokens": n_tokens("text")})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
