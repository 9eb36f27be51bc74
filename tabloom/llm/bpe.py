"""Byte-pair vocabularies: reading the public files, and encoding by forced boundaries.

Two neighbouring bytes that stand next to each other in no token of the vocabulary can never be merged over, so
every encoding has a cut there. ``Encoder`` marks these cuts, encodes the fragments between them one by one and
puts the results together; fragments are short and come again often, so each distinct one is encoded once and
kept in a bounded memory.

``word_bpe`` files (lower case, word ends, white space dropped) are what ``Encoder`` reads. Pre-tokens never hold
white space, so texts are first cut there, and each distinct word is worked out once a batch.

Defined cases: null texts count as empty and give no ids; special strings inside a text become their special
token, as the file's library does by default; words of any length are whole; repeated rows give repeated results;
other columns pass through, one called like the result as ``own_<name>``.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.common import put_aside, slices

#: Entries of one generation of a task's memory for words, pre-tokens and fragments; two generations are kept.
WORDS, PRETOKENS, FRAGMENTS = 250_000, 150_000, 60_000
#: The same for the library's words, unless a caller has room for more.
LIBRARY_WORDS = 100_000
#: Words kept with their ids and their decoded text.
PAIRED_WORDS = 300_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones as they are, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.merges: list[tuple[str, str]] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}

    def symbols(self, word: str) -> list[str]:
        """The letters of a pre-token's bytes, the last with the word end."""
        out = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        out[-1] += self.end
        return out

    def joinable(self) -> set[str]:
        """All pairs of letters that stand next to each other inside a token; no other pair can ever be merged."""
        pairs = set()
        for token in self.ids:
            bare = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            pairs.update(bare[i : i + 2] for i in range(len(bare) - 1))
        return pairs


class Encoder:
    """Exact encoding of texts by forced boundaries."""

    def __init__(self, path: str):
        import regex

        v = self.vocabulary = Vocabulary(path)
        self.rank = {pair: i for i, pair in enumerate(v.merges)}
        self.joinable = v.joinable()
        names = sorted(v.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.pretokens = Generations(self._pretoken, PRETOKENS)
        self.fragments = Generations(self._fragment, FRAGMENTS)

    def cuts(self, word: str) -> list[str]:
        """A pre-token's letters, cut wherever no token can reach across."""
        text = word
        if not (word.isascii() and word.isalnum()):
            text = "".join([self.vocabulary.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        joinable = self.joinable
        at = [i for i, pair in enumerate(map("".join, zip(text, text[1:])), 1) if pair not in joinable]
        if not at:
            return [text]
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]

    def _fragment(self, key: tuple[str, bool]) -> tuple[int, ...]:
        letters, last = key
        symbols = list(letters)
        if last:
            symbols[-1] += self.vocabulary.end
        ids = self.vocabulary.ids
        return tuple([ids[s] for s in merged(symbols, self.rank)])

    def _pretoken(self, word: str) -> tuple[int, ...]:
        *inner, last = self.cuts(word)
        if not inner:
            return self.fragments[last, True]
        out = []
        for letters in inner:
            out.extend(self.fragments[letters, False])
        out.extend(self.fragments[last, True])
        return tuple(out)

    def word(self, raw: str) -> Sequence[int]:
        """The ids of a piece of text without white space around it."""
        if raw.isascii():
            if raw.isalpha():
                return self.pretokens[raw.lower()]
            if raw[-1] in ".,;:!?" and raw[:-1].isalpha():
                return self.pretokens[raw[:-1].lower()] + self.pretokens[raw[-1]]
        out, start = [], 0
        if self.special and "<" in raw:
            for found in self.special.finditer(raw):
                out.extend(self.plain(raw[start : found.start()]))
                out.append(self.vocabulary.special[found.group()])
                start = found.end()
        out.extend(self.plain(raw[start:]))
        return out

    def plain(self, raw: str) -> Sequence[int]:
        text = raw if raw.isascii() else unicodedata.normalize("NFC", raw).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return self.pretokens[text]
        out = []
        for pretoken in self.pre.findall(text):
            out.extend(self.pretokens[pretoken])
        return out

    def words(self, text: str | None) -> list[str]:
        """Pieces of a text at white space. The four separators that only Python counts as white space stay inside."""
        if not text:
            return []
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            import regex

            return [w for w in regex.split(r"\p{White_Space}+", text) if w]
        return text.split()


class LibraryEncoder(Encoder):
    """The same cut into pre-tokens, each merged by the ``tokenizers`` library's own model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        # Words are kept as a whole; the library is quick enough for the pre-tokens of a new one.
        self.pretokens = Direct(self._pretoken)

    def word(self, raw: str) -> Sequence[int]:
        if raw.isascii() and raw.isalpha():
            return [t.id for t in self.tokenize(raw.lower())]
        return super().word(raw)

    def _pretoken(self, word: str) -> list[int]:
        letters = word
        if not (word.isascii() and word.isalnum()):
            letters = "".join([self.vocabulary.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        return [t.id for t in self.tokenize(letters)]


def merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """Merges of a fragment: again and again the leftmost place of the lowest-ranked pair."""
    if len(symbols) > 200:
        return merged_long(symbols, rank)
    none, get = len(rank), rank.get
    ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
    while ranks:
        low = min(ranks)
        if low == none:
            break
        i = ranks.index(low)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        if i < len(ranks):
            ranks[i] = get((symbols[i], symbols[i + 1]), none)
    return symbols


def merged_long(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The same for long fragments with a heap over a linked list."""
    import heapq

    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i] += symbols[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if 0 <= a and b < n and (symbols[a], symbols[b]) in rank:
                heapq.heappush(heap, (rank[symbols[a], symbols[b]], a, (symbols[a], symbols[b])))
    return [s for s, live in zip(symbols, alive) if live]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


class Generations(dict):
    """Values by key, worked out when missing. A full memory becomes the old one, and what is asked for again moves on."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Direct:
    """Values worked out whenever they are asked for."""

    def __init__(self, make):
        self.make = make

    def __getitem__(self, key):
        return self.make(key)


class WordIds:
    """The ids of words as little-endian 32-bit bytes, each distinct word encoded once; bounded."""

    def __init__(self, own: Encoder, size: int = WORDS):
        self.own = own
        self.known = Generations(lambda w: array("I", own.word(w)).tobytes(), size)

    def of(self, text: str | None) -> bytes:
        known = self.known
        return b"".join([known[w] for w in self.own.words(text)])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(encoder(path))


@functools.lru_cache(maxsize=2)
def library_word_ids(path: str, size: int = LIBRARY_WORDS) -> WordIds:
    return WordIds(LibraryEncoder(path), size)


def encoded(df: DataFrame, text: str = "text", name: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids of each text as an array of integers."""
    path = path or vocabulary_path("word_bpe_49k.json")
    df = put_aside(df, (name.lower(),), (text,))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_ids(path)
        for batch in slices(batches, text, 2_000_000):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [memory.of(t) for t in texts]
            ends = [0]
            for f in found:
                ends.append(ends[-1] + len(f) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of each array of ids: the tokens joined by blanks, as a file without decoder asks for.

    Unknown and null ids are left out; a null array gives an empty text.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    df = put_aside(df, (name.lower(),), (ids,))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).vocabulary.tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = []
                for row in part.column(part.schema.get_field_index(ids)):
                    numbers = row.values.to_pylist() if row.is_valid else []
                    try:
                        texts.append(" ".join([tokens[i] for i in numbers]))
                    except KeyError:
                        texts.append(" ".join([tokens[i] for i in numbers if i in tokens]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


@functools.lru_cache(maxsize=1)
def word_pairs(path: str) -> Generations:
    """Ids (as bytes) and decoded text of each distinct word, bounded."""
    own = encoder(path)
    tokens = own.vocabulary.tokens

    def pair(word: str) -> tuple[bytes, str]:
        ids = own.word(word)
        return array("I", ids).tobytes(), " ".join([tokens[i] for i in ids])

    return Generations(pair, PAIRED_WORDS)


def round_trip(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None
) -> DataFrame:
    """``df`` with the ids of each text and the text that they decode to, in one pass.

    Ids are decoded where they are made, word by word: a text's ids are those of its words one after the other, and its
    decoded text is theirs, joined by blanks. Words without ids add nothing.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    df = put_aside(df, (ids.lower(), decoded.lower()), (text,))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = word_pairs(path), encoder(path)
        for batch in slices(batches, text, 2_000_000):
            numbers, texts, ends = [], [], [0]
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                pairs = [known[w] for w in own.words(value)]
                found = b"".join([p[0] for p in pairs])
                numbers.append(found)
                ends.append(ends[-1] + len(found) // 4)
                texts.append(" ".join([p[1] for p in pairs if p[1]]))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(numbers))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
