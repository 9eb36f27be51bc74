"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts and exact backoff weights.

    P(w | h) = discounted c(h, w) / c(h)   where h, w follow each other in the training texts
             = alpha(h) P(w)               otherwise; P(w | h) = P(w) where h is unknown
    P(w)     = discounted c(w) / N         for known words, and the mass that is left for any unknown word

Counts up to ``K`` are discounted as Katz does with Good-Turing estimates, from counts of counts that are smoothed by a
line over logarithms and so are valid for every corpus; higher counts lose half a count, so every context keeps mass. alpha(h) is that mass over the unigram mass of all words not seen after h, so that each
P(. | h) sums to one exactly over the known words, the end mark and one unknown word.

How it runs. Words are 64-bit XXH64 numbers from here on. One pass counts unigrams. Tasks then send the pairs of
some million tokens in one packed row per bucket: the distinct pairs and, for each, its documents. A bucket holds
all pairs that end in its words, so it knows c(w) and c(h, w) and can add up, for each document at once, every
term of the score that these decide. Words and pairs that hold more than a quarter of a bucket's mean are known to
all tasks beforehand (there are at most 4 per bucket): pairs that end in such words are dealt by both words, and
such pairs are scored where they are read. What a bucket cannot know are the discounts (global counts of counts,
so it returns how many pairs of each count a document has) and alpha of contexts; contexts are gathered by packed
partial sums into a table, and joined with the unseen pairs of held-out documents alone, since pairs of training
documents are all seen.

Stored tables: unigrams (word, c), the buckets' packed results, contexts (word, c, alpha).

Defined cases: a null text is empty and has the end mark alone; null identifiers are texts 'null' for the choice of
training documents; rows that repeat identifier and text count once each and get equal scores; an empty table
gives an empty table, and without training documents every word is unknown and scores by N = V = 0; other columns
pass through, those called like a result or a helper as ``own_<name>``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.llm.common import put_aside, slices, stored

#: Counts up to this one are discounted by Good-Turing; the slope of the smoothed counts of counts is at most STEEP.
K, STEEP = 5, -1.1
#: Tokens of one packed group of documents, and about how many of a bucket: what a task holds at once.
GROUP_TOKENS, BUCKET_TOKENS = 1_000_000, 1_200_000
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
U64 = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Words between blanks with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(identifier: Column) -> Column:
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("null"))) % 10 == 0


# --- groups of documents as arrays ------------------------------------------------------------------------------------


@dataclass
class Group:
    """Some documents' tokens behind each other, each document with its end mark."""

    words: np.ndarray
    doc: np.ndarray
    train: np.ndarray
    ref: np.ndarray

    def contexts(self) -> np.ndarray:
        """The word before each token, the start mark for a document's first."""
        out = np.empty_like(self.words)
        out[1:] = self.words[:-1]
        out[self.doc != np.concatenate([[-1], self.doc[:-1]])] = START
        return out


def groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_TOKENS) -> Iterator[Group]:
    """Documents (columns text, ref, train) in groups of at most ``limit`` tokens and the last document's rest."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    held, refs, train, total = [], [], [], 0
    for batch in slices(batches, "text", 2_000_000):
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "ref", "train")]
        for text, ref, trains in zip(*columns, strict=True):
            found = tokens(text)
            numbers = np.fromiter(map(digest, found), U64, len(found))
            held.append(np.append(numbers, END))
            refs.append(ref)
            train.append(trains)
            total += len(found) + 1
            if total >= limit:
                yield _group(held, refs, train)
                held, refs, train, total = [], [], [], 0
    if held:
        yield _group(held, refs, train)


def _group(held: list, refs: list, train: list) -> Group:
    sizes = np.array([len(h) for h in held])
    return Group(np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), sizes), np.array(train, bool), np.array(refs, np.int64))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as bytes: sorted 64-bit numbers by their differences, whole numbers in as few bytes as they need."""
    import zstandard

    out = {}
    for name, a in arrays.items():
        if a.dtype == U64:
            steps = np.diff(a, prepend=U64(0))
            out[name] = ("s", len(a), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())
        elif a.dtype.kind in "iu":
            small = np.min_scalar_type(int(a.max(initial=0)))
            out[name] = (small.str, len(a), a.astype(small).tobytes())
        else:
            out[name] = (a.dtype.str, len(a), a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    out = {}
    for name, (kind, size, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items():
        if kind == "s":
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(U64).ravel()
            out[name] = np.cumsum(steps, dtype=U64)
        else:
            a = np.frombuffer(raw, np.dtype(kind))
            out[name] = a if a.dtype.kind == "f" else a.astype(np.int64)
    return out


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (w * U64(0x9E3779B97F4A7C15))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(31))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the value is there."""
    if not table.size:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), table.size - 1)
    return at, table[at] == wanted


# --- what all tasks know ----------------------------------------------------------------------------------------------


def discounted(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounted counts of 0..K from counts of counts 0..K+1: Katz's Good-Turing on smoothed counts of counts.

    log n_r is fitted by a line over log r (slope -2 with fewer than two different counts). With slope b, Good-Turing's
    (r + 1) n_(r+1) / n_r is r ((r + 1) / r)^(b + 1), below r for every slope under -1; the slope is held under `STEEP`,
    so that the discounts are valid whatever the corpus is.
    """
    n = counts_of_counts[1 : K + 2].astype(float)
    seen = np.flatnonzero(n)
    slope = -2.0
    if len(seen) > 1:
        x, y = np.log(seen + 1.0), np.log(n[seen])
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    power = min(slope, STEEP) + 1
    r = np.arange(1, K + 1)
    cut = (K + 1.0) ** power
    ratio = (((r + 1) / r) ** power - cut) / (1 - cut)
    return np.concatenate([[0.0], r * ratio])


@dataclass
class Known:
    """Bounded facts about the corpus that every task gets."""

    n: int
    v: int
    buckets: int
    unigram: np.ndarray  # discounted counts 0..K of words
    leftover: float  # unigram mass of unknown words
    heavy: np.ndarray  # heavy words, sorted, and their counts
    heavy_count: np.ndarray
    pairs: np.ndarray  # heavy pairs as heavy context * (heavy words + 1) + heavy word, sorted, and their counts
    pair_count: np.ndarray

    def word_mass(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        mass = np.where(c > K, c - 0.5, self.unigram[np.minimum(c, K)]) / max(self.n, 1)
        return np.where(c > 0, mass, self.leftover)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def pair_keys(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pairs of heavy words (the start mark is a heavy context), and which pairs are such."""
        size = len(self.heavy) + 1
        hi, h_in = _find(self.heavy, h)
        wi, w_in = _find(self.heavy, w)
        first = h == START
        hi = np.where(first, size - 1, hi)
        return hi * size + wi, (h_in | first) & w_in

    def pair_context(self, keys: np.ndarray) -> np.ndarray:
        at = keys // (len(self.heavy) + 1)
        return np.append(self.heavy, START)[at]


def _log(c: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(c, 1))


def doc_terms(known: Known, docs: int, doc, times, c_pair, c_word, is_end) -> dict[str, np.ndarray]:
    """Per document of a group, what the pairs with these counts add to its results.

    ``fixed`` holds log10 of high pair counts less log10 c(w) for w as the next token's context; ``r1``.. how many
    pairs have each low count.
    """
    seen = c_pair > 0
    fixed = np.where(c_pair > K, np.log10(np.maximum(c_pair - 0.5, 0.5)), 0.0) - np.where(is_end, 0.0, _log(c_word))
    fixed = fixed + np.where(seen, 0.0, np.log10(known.word_mass(c_word)))
    out = {"fixed": np.bincount(doc, times * fixed, docs), "base": np.bincount(doc, times * known.base(c_word), docs)}
    out["n_known"] = np.bincount(doc, times * (c_word > 0), docs).astype(np.int64)
    for r in range(1, K + 1):
        out[f"r{r}"] = np.bincount(doc, times * (c_pair == r), docs).astype(np.int64)
    return out


# --- the passes -------------------------------------------------------------------------------------------------------


def unigrams(rows: DataFrame) -> DataFrame:
    """(word, c) over the training texts, end marks included."""

    def run(batches):
        for group in groups(batches):
            words, counts = np.unique(group.words[group.train[group.doc]], return_counts=True)
            for at in range(0, len(words), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(words[part].view(np.int64)), pa.array(counts[part])], names=["word", "c"])

    return stored(rows.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "unigrams")


def _signed(a) -> np.ndarray:
    return np.array(a, np.int64).view(U64)


def learn(rows: DataFrame) -> Known:
    """Counts of unigrams, and the words and pairs that are heavy: at most 4 for each bucket."""
    table = unigrams(rows)
    row = table.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
        *[F.sum((F.col("c") == r).cast("bigint")).alias(f"n{r}") for r in range(1, K + 2)],
    ).first()
    n, v = row.n or 0, row.v
    buckets = max(2, -(-n // BUCKET_TOKENS))
    unigram = discounted(np.array([0, *[row[f"n{r}"] or 0 for r in range(1, K + 2)]]))
    low = table.filter(F.col("c") > K).agg(F.sum(F.col("c") - 0.5).alias("m")).first().m or 0.0
    known_mass = low + sum(unigram[r] * (row[f"n{r}"] or 0) for r in range(1, K + 1))
    leftover = 1 - known_mass / n if n else 1.0
    least = max(1, -(-n // (4 * buckets)))
    heavy = sorted(((int(U64(np.int64(r.word).view(U64))), r.c) for r in table.filter(F.col("c") >= least).collect()))
    known = Known(
        n, v, int(buckets), unigram, leftover, np.array([h for h, _ in heavy], U64), np.array([c for _, c in heavy], np.int64),
        np.zeros(0, np.int64), np.zeros(0, np.int64),
    )

    def run(batches):
        for group in groups(batches):
            train = group.train[group.doc]
            keys, both = known.pair_keys(group.contexts()[train], group.words[train])
            found, counts = np.unique(keys[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["pair", "c"])

    pairs = rows.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    found = sorted((r.pair, r.c) for r in pairs.collect())
    known.pairs, known.pair_count = np.array([p for p, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    return known


ROW = "kind string, target long, uid long, data binary"


def _row(kind: str, target: int, uid: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([target], pa.int64()), pa.array([uid], pa.int64()), pa.array([data], pa.binary())],
        names=["kind", "target", "uid", "data"],
    )


def sent(rows: DataFrame, known) -> DataFrame:
    """Packed pairs for the buckets (kind 'pairs'), and per group its references and what is known at once ('docs')."""

    def run(batches):
        import xxhash

        own, place = known.value, TaskContext.get().partitionId()
        for number, group in enumerate(groups(batches)):
            # A group is known by what it holds and where it lies: a rerun that differs is noticed, not mixed up.
            name = group.ref.tobytes() + np.array([place, number]).tobytes()
            uid = int(np.uint64(xxhash.xxh64_intdigest(name)).view(np.int64))
            w, h, doc = group.words, group.contexts(), group.doc
            docs = len(group.ref)
            keys, both = own.pair_keys(h, w)
            at, hit = _find(own.pairs, keys)
            hit &= both
            c_word = own.heavy_count[_find(own.heavy, w[hit])[0]] if hit.any() else np.zeros(0, np.int64)
            here = doc_terms(own, docs, doc[hit], np.ones(int(hit.sum())), own.pair_count[at[hit]] if hit.any() else c_word, c_word, w[hit] == END)
            here["ref"] = group.ref
            here["n_tokens"] = np.bincount(doc, minlength=docs)
            here["train"] = group.train.astype(np.int64)
            # References are any 64-bit numbers: kept as two halves.
            ref = here.pop("ref").view(U64)
            here["ref_high"], here["ref_low"] = (ref >> U64(32)).astype(np.int64), (ref & U64(0xFFFFFFFF)).astype(np.int64)
            yield _row("docs", uid, uid, pack(here))
            w, h, doc = w[~hit], h[~hit], doc[~hit]
            heavy = _find(own.heavy, w)[1]
            bucket = (np.where(heavy, _mixed(h, w), _mixed(w, w)) % U64(own.buckets)).astype(np.int64)
            order = np.lexsort((doc, h, w, bucket))
            w, h, doc, bucket = w[order], h[order], doc[order], bucket[order]
            fresh_pair = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]) if w.size else np.zeros(0, bool)
            fresh = fresh_pair | np.concatenate([[True], doc[1:] != doc[:-1]]) if w.size else fresh_pair
            first = np.flatnonzero(fresh)
            times = np.diff(np.append(first, w.size))
            w, h, doc, bucket, fresh_pair = w[first], h[first], doc[first], bucket[first], fresh_pair[first]
            for b in np.unique(bucket).tolist():
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                yield _row("pairs", b, uid, _packed_pairs(w[lo:hi], h[lo:hi], doc[lo:hi], times[lo:hi], fresh_pair[lo:hi], group))

    return rows.mapInArrow(run, ROW)


def _packed_pairs(w, h, doc, times, fresh_pair, group: Group) -> bytes:
    starts = np.flatnonzero(fresh_pair)
    pw, ph = w[starts], h[starts]
    words, word_at = np.unique(pw, return_inverse=True)
    contexts, context_at = np.unique(ph, return_inverse=True)
    return pack(
        {
            "words": words, "per_word": np.bincount(word_at, minlength=len(words)), "contexts": contexts, "context": context_at,
            "per_pair": np.diff(np.append(starts, len(w))), "doc": doc.astype(np.int64), "times": times,
            "docs": np.array([len(group.ref)]), "train": np.packbits(group.train).astype(np.int64),
        }
    )


class Block:
    """One unpacked row of pairs."""

    def __init__(self, data: bytes):
        a = unpack(data)
        self.w = np.repeat(a["words"], a["per_word"])
        self.h = a["contexts"][a["context"]]
        self.pair = np.repeat(np.arange(len(self.w)), a["per_pair"])
        self.doc, self.times, self.docs = a["doc"], a["times"], int(a["docs"][0])
        self.train = np.unpackbits(a["train"].astype(np.uint8))[: self.docs].astype(bool)

    def counts(self) -> np.ndarray:
        return np.bincount(self.pair, self.times * self.train[self.doc], len(self.w)).astype(np.int64)


def bucket_rows(own: Known, bucket: int, blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """All that a bucket can say: 'docs' terms by group, 'unseen' pairs, 'contexts' sums, 'counts' of counts."""
    w, h, c, sizes = [], [], [], []
    for _, data in blocks:
        block = Block(data)
        w.append(block.w)
        h.append(block.h)
        c.append(block.counts())
        sizes.append(len(block.w))
    w, h, c = np.concatenate(w), np.concatenate(h), np.concatenate(c)
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
    group_of = np.cumsum(fresh) - 1
    c_pair = np.add.reduceat(c[order], np.flatnonzero(fresh))
    w, h = w[fresh], h[fresh]
    pair_of = np.empty(len(order), np.int64)
    pair_of[order] = group_of
    fresh_w = np.concatenate([[True], w[1:] != w[:-1]])
    sums = np.add.reduceat(c_pair, np.flatnonzero(fresh_w))
    c_word = sums[np.cumsum(fresh_w) - 1]
    at, heavy = _find(own.heavy, w)
    c_word = np.where(heavy, own.heavy_count[at] if own.heavy.size else 0, c_word)
    del order, c, group_of
    yield _row("counts", 0, 0, pack({"n": np.bincount(np.minimum(c_pair, K + 2), minlength=K + 3)}))
    start = 0
    for (uid, data), size in zip(blocks, sizes, strict=True):
        block = Block(data)
        pairs = pair_of[start : start + size][block.pair]
        start += size
        own_pair, own_word = c_pair[pairs], c_word[pairs]
        terms = doc_terms(own, block.docs, block.doc, block.times, own_pair, own_word, w[pairs] == END)
        yield _row("docs", uid, uid, pack(terms))
        unseen = own_pair == 0
        if unseen.any():
            contexts, context_at = np.unique(h[pairs[unseen]], return_inverse=True)
            yield _row("unseen", uid, uid, pack({"contexts": contexts, "context": context_at, "doc": block.doc[unseen], "times": block.times[unseen]}))
    yield from context_rows(own, h[c_pair > 0], c_pair[c_pair > 0], own.word_mass(c_word[c_pair > 0]))


def context_rows(own: Known, h, c, mass) -> Iterator[pa.RecordBatch]:
    """Per context the sums over its seen pairs, packed for the bucket of the context."""
    target = (_mixed(h, h) % U64(own.buckets)).astype(np.int64)
    order = np.lexsort((h, target))
    h, c, mass, target = h[order], c[order], mass[order], target[order]
    if not h.size:
        return
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sums = {"h": h[first], "c": np.add.reduceat(c, first), "mass": np.add.reduceat(mass, first)}
    sums["high"] = np.add.reduceat(np.where(c > K, 2 * c - 1, 0), first)  # twice the discounted counts above K
    for r in range(1, K + 1):
        sums[f"r{r}"] = np.add.reduceat((c == r).astype(np.int64), first)
    target = target[first]
    for t in np.unique(target).tolist():
        lo, hi = np.searchsorted(target, [t, t + 1])
        yield _row("contexts", t, 0, pack({k: v[lo:hi] for k, v in sums.items()}))


def _by_target(df: DataFrame, width: int) -> DataFrame:
    """The rows of a target together, in order, each target in a task of its own where the numbers allow."""
    placed = df.repartitionById(width, F.pmod("target", F.lit(width)).cast("int"))
    return placed.sortWithinPartitions("target", "uid")


def _per_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, bytes]]]]:
    held, at = [], None
    for batch in batches:
        for kind, target, uid, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if target != at:
                if held:
                    yield at, held
                held, at = [], target
            held.append((kind, uid, data))
    if held:
        yield at, held


def scored(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    plain = put_aside(df, (*RESULTS, "ref", "ref_"), (id_col, text))
    ref = F.xxhash64(F.coalesce(col(id_col).cast("string"), F.lit("null")), F.coalesce(col(text), F.lit("")))
    rows = plain.select(F.coalesce(col(text), F.lit("")).alias("text"), ref.alias("ref"), (~held_out(col(id_col))).alias("train"))
    known = learn(rows)
    shared = spark.sparkContext.broadcast(known)
    width = max(known.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def in_buckets(batches):
        own = shared.value
        for target, held in _per_target(batches):
            blocks = [(uid, data) for kind, uid, data in held if kind == "pairs"]
            for kind, uid, data in held:
                if kind == "docs":
                    yield _row("docs", uid, uid, data)
            if blocks:
                yield from bucket_rows(own, target, blocks)

    found = stored(_by_target(sent(rows, shared), width).mapInArrow(in_buckets, ROW), "buckets")
    spare = F.col("kind") == "counts"
    n = np.bincount(np.minimum(known.pair_count, K + 2), minlength=K + 3).astype(np.int64)
    for row in found.filter(spare).select("data").toLocalIterator():  # one short row per bucket
        n = n + unpack(bytes(row.data))["n"]
    n[0] = 0
    low = discounted(n[: K + 2])
    contexts = stored(context_table(found, known, low, width), "contexts")
    sums = doc_sums(found, contexts, low, known, width)
    here = plain.withColumn("ref_", ref)
    joined = here.join(sums, here["ref_"] == sums["ref"], "left")
    columns = [joined[c] for c in plain.columns]
    return joined.select(
        *columns, held_out(here[id_col]).alias("held_out"), "n_tokens", "n_known",
        F.lit(known.n).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def context_table(found: DataFrame, known: Known, low: np.ndarray, width: int) -> DataFrame:
    """(word, c, alpha) of every context of the training texts; the start mark is one."""
    spark = found.sparkSession
    pairs = known.pairs
    words = known.heavy_count[pairs % (len(known.heavy) + 1)] if pairs.size else pairs
    heavy = [b.to_pylist()[0] for b in context_rows(known, known.pair_context(pairs), known.pair_count, known.word_mass(words))]
    rows = found.filter(F.col("kind") == "contexts")
    if heavy:
        rows = rows.unionByName(spark.createDataFrame([tuple(r.values()) for r in heavy], ROW))

    def run(batches):
        for _, held in _per_target(batches):
            parts = [unpack(data) for _, _, data in held]
            names = list(parts[0])
            all_ = {k: np.concatenate([p[k] for p in parts]) for k in names}
            order = np.argsort(all_["h"], kind="stable")
            h = all_["h"][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            s = {k: np.add.reduceat(all_[k][order], first) for k in names if k != "h"}
            seen = s["high"] / 2 + sum(low[r] * s[f"r{r}"] for r in range(1, K + 1))
            alpha = (1 - seen / s["c"]) / np.maximum(1 - s["mass"], known.leftover)
            h = h[first].view(np.int64)
            for at in range(0, len(h), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(s["c"][part]), pa.array(alpha[part])], names=["word", "c", "alpha"])

    return _by_target(rows, width).mapInArrow(run, "word long, c long, alpha double")


def doc_sums(found: DataFrame, contexts: DataFrame, low: np.ndarray, known: Known, width: int) -> DataFrame:
    """(ref, n_tokens, n_known, base_score, score), one row per reference."""
    n_train = int(known.heavy_count[known.heavy == END][0]) if (known.heavy == END).any() else None
    if n_train is None:
        n_train = contexts.filter(F.col("word") == int(START.view(np.int64))).agg(F.max("c")).first()[0] or 0
    with np.errstate(divide="ignore"):
        logs = np.log10(low)

    def merged(batches):
        for target, held in _per_target(batches):
            total, unseen, expected = {}, [], False
            for kind, _, data in held:
                a = unpack(data)
                if kind == "unseen":
                    unseen.append(a)
                    continue
                expected |= "n_tokens" in a
                for k, v in a.items():
                    total[k] = total[k] + v if k in total else v
            if not expected:
                raise RuntimeError("a group of documents changed between two runs of a task: its rows have no fixed order")
            ref = (total["ref_high"].astype(U64) << U64(32) | total["ref_low"].astype(U64)).view(np.int64)
            score = total["fixed"] + sum(total[f"r{r}"] * logs[r] for r in range(1, K + 1) if total[f"r{r}"].any())
            score = score - (np.log10(n_train) if n_train else 0.0)
            one = np.ones(len(ref), np.int64)
            yield _sums(ref, np.full(len(ref), 0), one, total["n_tokens"], total["n_known"], total["base"], score)
            for a in unseen:
                word = a["contexts"][a["context"]].view(np.int64)
                zero = np.zeros(len(word), np.int64)
                yield _sums(ref[a["doc"]], word, zero, zero, a["times"], zero.astype(float), zero.astype(float))

    schema = "ref long, word long, rows long, n_tokens long, n_known long, base double, score double"
    rows = found.filter(F.col("kind").isin("docs", "unseen"))
    terms = _by_target(rows, width).mapInArrow(merged, schema)
    terms = stored(terms, "terms")
    unseen = terms.filter("rows = 0").select("ref", "word", F.col("n_known").alias("times"))
    priced = unseen.join(contexts, "word").select(
        "ref", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("n_known"),
        F.lit(0.0).alias("base"), (F.col("times") * (F.log10("alpha") + F.log10("c"))).alias("score"),
    )
    both = terms.filter("rows > 0").drop("word").unionByName(priced)
    summed = both.groupBy("ref").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "score")])
    share = F.col("rows")
    return summed.select(
        "ref", (F.col("n_tokens") / share).cast("bigint").alias("n_tokens"), (F.col("n_known") / share).cast("bigint").alias("n_known"),
        (F.col("base") / share).alias("base_score"), (F.col("score") / share).alias("score"),
    )


def _sums(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 5 + (pa.float64(),) * 2
    names = ["ref", "word", "rows", "n_tokens", "n_known", "base", "score"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
