"""Token counts of texts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie behind each other in one numpy array of symbol numbers. In every step each
pre-token that still has a mergeable pair merges all places of its own lowest-ranked pair, all pre-tokens at the
same time; those without a pair are done, and what counts in the end is how many symbols are left. Pre-tokens seen
before are looked up in a memory of bounded size.

Texts are cut at blanks and line breaks first: where a text has only single ones, each word with the blank before
it is a pre-token sequence of its own, whatever stands around it. All other texts are cut by the file's pattern.

Defined cases: null texts count as empty and have no tokens; special strings inside a text count as one token, as
the file's library does by default; long pre-tokens are whole; repeated rows give repeated results; an empty table
gives an empty table; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.bpe import Vocabulary, vocabulary_path
from tabloom.llm.common import put_aside, slices

#: Distinct words kept in one generation of a task's memory.
MEMORY = 400_000
#: Symbols in one array of pre-tokens.
SYMBOLS = 1_000_000
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


class Merger:
    """Lowest-rank merges of many sequences side by side."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.byte = np.array([ids[c] for c in vocabulary.letters], np.int64)
        self.size = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in vocabulary.merges], np.int64)
        made = np.array([ids[a + b] for a, b in vocabulary.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank, self.made = pairs[order], order, made
        self.none = len(pairs)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), self.none - 1)
        return np.where(self.pairs[at] == wanted, self.rank[at], self.none)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence of bytes."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        symbols = self.byte[np.frombuffer(b"".join([sequences[i] for i in live.tolist()]), np.uint8)]
        owner = np.repeat(np.arange(len(live)), lengths[live])
        while symbols.size:
            rank = np.full(symbols.size, self.none, np.int64)
            together = np.flatnonzero(owner[1:] == owner[:-1])
            rank[together] = self.ranks(symbols[together], symbols[together + 1])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, symbols.size))
            low = np.minimum.reduceat(rank, starts)
            # A sequence without a mergeable pair is done.
            done = low == self.none
            out[live[owner[starts[done]]]] = sizes[done]
            low_of = np.repeat(low, sizes)
            hit = (rank == low_of) & (low_of < self.none)
            hit = _alternate(hit)
            symbols = np.where(hit, self.made[np.minimum(rank, self.none - 1)], symbols)
            keep = np.concatenate([[True], ~hit[:-1]]) & ~np.repeat(done, sizes)
            symbols, owner = symbols[keep], owner[keep]
        return out


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places every second one, from the first on: merges do not overlap."""
    at = np.flatnonzero(hit)
    if at.size < 2:
        return hit
    fresh = np.concatenate([[True], np.diff(at) != 1])
    if fresh.all():
        return hit
    first = np.maximum.accumulate(np.where(fresh, np.arange(at.size), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(at.size) - first) % 2 == 0]] = True
    return out


class Counter:
    """Token counts of texts with one vocabulary file."""

    def __init__(self, path: str):
        import regex

        vocabulary = Vocabulary(path)
        self.merger = Merger(vocabulary)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.names = names
        self.pattern = regex.compile(PATTERN)
        self.blank, self.start, self.old_blank, self.old_start = {}, {}, {}, {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many special strings lie between them."""
        if not any(name in text for name in self.names):
            return self.pattern.findall(text), 0
        pieces = self.special.split(text)
        return [p for piece in pieces for p in self.pattern.findall(piece)], len(pieces) - 1

    def learn(self, words: Iterable[str], lead: str, known: dict[str, int]) -> None:
        """The tokens of each word with ``lead`` before it."""
        words = list(words)
        found = [self.pretokens(lead + w) for w in words]
        flat = [p.encode("utf-8", "surrogatepass") for own, _ in found for p in own]
        totals = np.concatenate([[0], np.cumsum(self.in_arrays(flat))])
        ends = np.cumsum([0, *[len(own) for own, _ in found]])
        sums = totals[ends[1:]] - totals[ends[:-1]] + np.array([n for _, n in found], np.int64)
        known.update(zip(words, sums.tolist(), strict=True))

    def in_arrays(self, sequences: list[bytes]) -> np.ndarray:
        out, start, held = [], 0, 0
        for i, s in enumerate(sequences):
            if held and held + len(s) > SYMBOLS:
                out.append(self.merger.counts(sequences[start:i]))
                start, held = i, 0
            held += len(s)
        out.append(self.merger.counts(sequences[start:]))
        return np.concatenate(out)

    def room(self) -> None:
        if len(self.blank) >= MEMORY:
            self.old_blank, self.blank = self.blank, {}
        if len(self.start) >= MEMORY // 2:
            self.old_start, self.start = self.start, {}

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; the texts' distinct words are worked out together."""
        self.room()
        plans, after, first, odd = [], set(), set(), []
        for i, text in enumerate(texts):
            lines = [line.split(" ") for line in (text or "").split("\n")]
            words = [w for line in lines for w in line]
            if text and words == text.split():
                heads = [line[0] for line in lines]
                rest = [w for line in lines for w in line[1:]]
                after.update(rest)
                first.update(heads)
                plans.append((heads, rest))
            else:
                plans.append(None)
                if text:
                    odd.append(i)
        self._fill(after, " ", self.blank, self.old_blank)
        self._fill(first, "", self.start, self.old_start)
        out = [
            sum(map(self.start.__getitem__, p[0])) + sum(map(self.blank.__getitem__, p[1])) + len(p[0]) - 1 if p else 0
            for p in plans
        ]
        if odd:
            found = [self.pretokens(texts[i]) for i in odd]
            distinct = list({p for own, _ in found for p in own})
            sizes = dict(zip(distinct, self.in_arrays([p.encode("utf-8", "surrogatepass") for p in distinct]).tolist()))
            for i, (own, special) in zip(odd, found):
                out[i] = sum(map(sizes.__getitem__, own)) + special
        return out

    def _fill(self, wanted: set[str], lead: str, known: dict[str, int], old: dict[str, int]) -> None:
        missing = []
        for w in wanted:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        if missing:
            self.learn(missing, lead, known)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counted(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of each text as a bigint; a column of that name comes back as ``own_<name>``."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    df = put_aside(df, (name.lower(),), (text,))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, text, 4_000_000):
            numbers = own.count(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)
