"""Masked pseudo-likelihood by a bidirectional window network in numpy.

Tokens are the words of a text (A-Z lower-cased): the most frequent ones of the
corpus have ids of their own, the others share hash buckets. Every token is predicted
from the ``radius`` tokens on either side: embeddings weighted by position, a tanh layer,
and a softmax factored into a class and a member of it. The sum of
log P(token | both sides) over a text is its score. Within a bucket a word has its
share of the bucket's tokens in all other documents of the corpus; a word that none of
them has is spelled out, with the bucket's share of words that occur once for its
probability of being new (Good and Turing). So every word is scored as itself, and a text by
what the rest of the corpus says of it.

What is gathered grows with the corpus: the counts of all words are a distributed
table. Of it the KNOWN most frequent words travel to the workers; a word
beyond them is looked up by a join. Training passes over every document: rounds of
replicas, one for each shard of the round, averaged (local SGD, as in Zinkevich et
al., 2010), each weight by the tokens that taught it. Shards go by a hash
of id and text and their number by the corpus's tokens, so neither tasks nor files
nor the size of the cluster change a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import row_blocks, sized_words, utf8, word_hashes
from loomgraph.storage import stash

#: Words whose counts travel to every worker, at most: 20 bytes each.
KNOWN = 1 << 20
#: Steps of the logarithmic scale of counts by which KNOWN is kept.
SCALE = 64
#: Tokens of a shard, at most about, and tokens whose windows are built at once.
SHARD, BLOCK = 1 << 25, 1 << 18
#: Classes that a step deals with at once, so that what it reads again is still close to the processor.
NEAR = 16
#: Nats that each byte of a new word takes, and its end: one of 32 letters.
SPELL = math.log(32)
#: Parts in which a replica's weights travel.
PARTS = 32


@dataclass(frozen=True)
class Network:
    """Sizes: classes * members tokens, of which 0 is the edge of a text and the last ``buckets`` stand for rare words. Of every text each ``every``-th word is a target in training."""

    classes: int = 64
    members: int = 128
    buckets: int = 256
    dims: int = 16
    radius: int = 2
    every: int = 1
    batch: int = 1024
    rate: float = 0.8
    seed: int = 7

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        """Embeddings, weights of the positions, bias; classes and their bias; members of each class with their bias as the last row."""
        return [(self.tokens, self.dims), (2 * self.radius, self.dims), (self.dims,), (self.dims, self.classes), (self.classes,), (self.classes, self.dims + 1, self.members)]

    def first(self, counts: np.ndarray | None = None) -> list[np.ndarray]:
        """Weights to begin with; the biases give every token its share of ``counts`` (tokens by id), so nothing is left to learn but the context."""
        draw = np.random.default_rng(self.seed)
        weights = [(draw.standard_normal(s) * 0.1).astype(np.float32) for s in [*self.shapes[:-1], (self.classes, self.dims, self.members)]]
        weights[1] += 1
        share = (np.ones(self.tokens) if counts is None else counts + 1.0).reshape(self.classes, self.members)
        weights[2][:] = 0
        weights[4] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        weights[5] = np.concatenate([weights[5], np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)[:, None]], axis=1)
        return weights


def flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.reshape(-1) for w in weights])


def importance(net: Network, seen: np.ndarray) -> np.ndarray:
    """How many of the tokens ``seen`` (by id) taught each weight: embeddings by their own token, members by their class, all others by every token."""
    classes = seen.reshape(net.classes, net.members).sum(axis=1)
    by = [seen, seen.sum(), seen.sum(), seen.sum(), seen.sum(), classes]
    return np.concatenate([np.repeat(x, int(np.prod(s)) // np.size(x)) for x, s in zip(by, net.shapes, strict=True)])


def shaped(net: Network, values: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in net.shapes:
        n = int(np.prod(shape))
        out.append(np.asarray(values[at : at + n], np.float32).reshape(shape))
        at += n
    return out


class Windows:
    """Targets and contexts of the concatenated texts ids[at[k]:at[k+1]]; beyond a text's edges the context is 0."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, radius: int):
        edge = len(at) - 1
        self.at, self.targets = at, ids.astype(np.int32)
        self.place = np.arange(len(ids)) + radius * (1 + np.repeat(np.arange(edge), np.diff(at)))
        self.room = np.zeros(len(ids) + radius * (edge + 1), np.uint16)
        self.room[self.place] = ids
        self.sides = np.array([d for d in range(-radius, radius + 1) if d])

    def contexts(self, positions) -> np.ndarray:
        return self.room[self.place[positions][:, None] + self.sides]

    def chosen(self, every: int, turns: np.ndarray) -> np.ndarray:
        """Every ``every``-th position of each text, from one that depends on the text's length and its turn."""
        sizes = np.diff(self.at)
        inside = np.arange(len(self.targets)) - np.repeat(self.at[:-1], sizes)
        return np.flatnonzero((inside + np.repeat(sizes + turns, sizes)) % every == 0)


def windows(ids: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All targets and contexts at once."""
    found = Windows(ids, at, radius)
    return found.targets, found.contexts(slice(None))


def _steady(z: np.ndarray) -> np.ndarray:
    """``z`` as exponents, in place: rows are shifted by their maxima unless all are small."""
    if z.size and not max(z.max(), -z.min()) < 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    np.exp(_steady(z), out=z)
    z /= _sums(z)[:, None]
    return z


def _hidden(weights: list[np.ndarray], contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = weights[0].take(contexts, axis=0)
    h = near[:, 0] * weights[1][0]
    for k in range(1, contexts.shape[1]):
        h += near[:, k] * weights[1][k]
    h += weights[2]
    return np.tanh(h, out=h), near


def _by_class(net: Network, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Positions in the order of their targets' classes, and (class, begin, end) for each that is there."""
    kind = (targets // net.members).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], np.arange(net.classes + 1))
    return order, [(k, int(begin[k]), int(begin[k + 1])) for k in np.flatnonzero(np.diff(begin)).tolist()]


def _with_one(h: np.ndarray) -> np.ndarray:
    """``h`` with a last column of ones, which the bias goes by."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _members(inner: np.ndarray, own: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
    """What the members of its class have at each position of ``classes`` before the softmax, for positions ``own`` (with ones) in the order of classes."""
    begin = classes[0][1]
    z = np.empty((classes[-1][2] - begin, inner.shape[2]), own.dtype)
    for k, a, e in classes:
        np.dot(own[a:e], inner[k], out=z[a - begin : e - begin])
    return z


def _log_softmax_at(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    at = _steady(z)[np.arange(len(z)), column]
    return at - np.log(_sums(np.exp(z, out=z)))


def log_probabilities(net: Network, weights: list[np.ndarray], targets: np.ndarray, contexts) -> np.ndarray:
    """log P(target | context) of every position; contexts is an array or a function of a range of positions."""
    if not callable(contexts):
        every = contexts
        contexts = lambda part: every[part]
    out = np.empty(len(targets), np.float64)
    for lo in range(0, len(targets), 2 * net.batch):
        t = targets[lo : lo + 2 * net.batch]
        h, _ = _hidden(weights, contexts(slice(lo, lo + len(t))))
        p = _log_softmax_at(h @ weights[3] + weights[4], t // net.members)
        order, classes = _by_class(net, t)
        p[order] += _log_softmax_at(_members(weights[5], _with_one(h[order]), classes), t[order] % net.members)
        out[lo : lo + len(t)] = p
    return np.maximum(out, -69.0)


def train_step(net: Network, weights: list[np.ndarray], moments: list[np.ndarray], targets: np.ndarray, contexts: np.ndarray) -> None:
    """One Adagrad step on the mean of -log P, in place; embeddings only of the tokens that occur."""
    n = len(targets)

    def change(g: np.ndarray, m: np.ndarray) -> np.ndarray:
        root = g * g
        m += root
        np.sqrt(m, out=root)
        root += 1e-6
        g *= net.rate
        g /= root
        return g

    h, near = _hidden(weights, contexts)
    off = _softmax(h @ weights[3] + weights[4])
    rows = np.arange(n)
    off[rows, targets // net.members] -= 1
    off /= n
    back = off @ weights[3].T
    order, classes = _by_class(net, targets)
    own, outer, member, behind = _with_one(h[order]), weights[5][:, :-1].transpose(0, 2, 1), targets[order] % net.members, np.empty_like(h)
    turned = own.T / n
    for lo in range(0, net.classes, NEAR):
        some = [c for c in classes if lo <= c[0] < lo + NEAR]
        if not some:
            continue
        begin, end, part = some[0][1], some[-1][2], slice(lo, lo + NEAR)
        q = _softmax(_members(weights[5], own, some))
        q[rows[: end - begin], member[begin:end]] -= 1
        inner = np.zeros_like(weights[5][part])
        for k, a, e in some:
            of = q[a - begin : e - begin]
            np.dot(of, outer[k], out=behind[a:e])
            np.dot(turned[:, a:e], of, out=inner[k - lo])
        weights[5][part] -= change(inner, moments[5][part])
    behind /= n
    back[order] += behind
    back *= 1 - h * h
    place = contexts.reshape(-1)
    by = np.argsort(place, kind="stable")
    place = place[by]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    spread = (back[:, None, :] * weights[1]).reshape(-1, net.dims).take(by, axis=0)
    across, taught = np.einsum("nd,nkd->kd", back, near), place[first]
    m = moments[0].take(taught, axis=0)
    weights[0][taught] -= change(np.add.reduceat(spread, first, axis=0), m)
    moments[0][taught] = m
    for k, gradient in ((1, across), (2, back.sum(axis=0)), (3, h.T @ off), (4, off.sum(axis=0))):
        weights[k] -= change(gradient, moments[k])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for lo, hi in row_blocks(at, 16 << 20):
            words, _ = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            if len(words):
                found, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) for every word of the corpus, by its hash. Null and empty texts have none; repeated rows count each time."""
    return docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Ids of all words, and counts of the known ones.

    ``words`` are the hashes of the known words in order, ``id`` and ``n`` go with them. ``counts`` holds the
    corpus's tokens by id, ``new`` for each bucket the probability that a token of it is a word that no other
    document has. ``rest`` is the table (word, n) of the words that are not known and occur more than once, None if
    all are known.
    """

    words: np.ndarray
    id: np.ndarray
    n: np.ndarray
    counts: np.ndarray
    new: np.ndarray
    rest: DataFrame | None


def _level(n: str = "n"):
    """A count's place on a logarithmic scale, so that a table of all places is short."""
    return F.floor(F.log2(n) * SCALE).cast("int")


def _bucket(net: Network, words: np.ndarray) -> np.ndarray:
    return net.tokens - net.buckets + ((words >> np.uint64(40)) % np.uint64(net.buckets)).astype(np.int64)


def vocabulary(counts: DataFrame, net: Network, known: int = KNOWN) -> Vocabulary:
    """From a written table (word, n). The known words are all from a place of the scale on, at most ``known``."""
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(_level().alias("level")).count().collect()), reverse=True)  # a row per place, some thousands at most
    least, total = None, 0
    for level, n in levels:
        if total + n > known:
            break
        least, total = level, total + n
    words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if least is not None:
        table = counts.where(_level() >= least).toArrow()  # at most ``known`` rows
        words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.lexsort((words.view(np.int64), -n))
    words, n = words[order], n[order]
    ids, own = _bucket(net, words), min(len(words), net.tokens - net.buckets - 1)
    ids[:own] = np.arange(1, own + 1)
    by_id = np.bincount(ids, weights=n, minlength=net.tokens)
    once = np.bincount(ids[n == 1], minlength=net.tokens).astype(np.float64)
    rest, first = None, net.tokens - net.buckets
    if total < sum(k for _, k in levels):
        below = counts if least is None else counts.where(_level() < least)
        by_bucket = below.groupBy((F.shiftrightunsigned("word", 40) % net.buckets).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"))
        for r in by_bucket.collect():  # a row per bucket
            by_id[first + r["bucket"]] += r["n"]
            once[first + r["bucket"]] += r["once"]
        rest = below.where("n > 1")
    new = (once[first:] + 1) / (by_id[first:] + 2)
    order = np.argsort(words)
    return Vocabulary(words[order], ids[order].astype(np.uint16), n[order].astype(np.float64), by_id, new, rest)


class _Known:
    """Places of hashes in a sorted array, by its 20 leading bits and then a few steps."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.first = np.searchsorted(words, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.first = np.append(self.first, len(words))

    def places(self, found: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        lead = (found >> np.uint64(44)).astype(np.int64)
        at, end, out = self.first[lead], self.first[lead + 1], np.full(len(found), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.words[at[left]] == found[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


_TAIL = np.dtype([("word", "<u8"), ("times", "<i8"), ("gain", "<f8")])


def _shares(net: Network, vocabulary: Vocabulary, found: np.ndarray, sizes: np.ndarray, ids: np.ndarray, place: np.ndarray, begin: np.ndarray, inside: bool) -> tuple[np.ndarray, list[bytes]]:
    """For each text the sum of log P(word | bucket) over its words in buckets, and as _TAIL the words to look up: what they gain beside log(n - times) if others have them.

    place is a word's place among the known, -1 if it is not one of them. With ``inside`` the texts are of the corpus, and a text's own words do not count.
    """
    texts, first = len(begin) - 1, net.tokens - net.buckets
    rare = np.flatnonzero(ids >= first)
    text = np.repeat(np.arange(texts), np.diff(begin))[rare]
    bucket = ids[rare].astype(np.int64) - first
    own = np.bincount(text * net.buckets + bucket, minlength=texts * net.buckets) if inside else np.zeros(texts * net.buckets, np.int64)
    order = np.lexsort((found[rare], text))
    rare, text, bucket = rare[order], text[order], bucket[order]
    words = found[rare]
    head = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (text[1:] != text[:-1])]) if len(rare) else np.zeros(0, np.int64)
    times = np.diff(np.r_[head, len(rare)])
    rare, text, bucket, words = rare[head], text[head], bucket[head], words[head]
    new = vocabulary.new[bucket]
    others = np.maximum(vocabulary.counts[first + bucket] - own[text * net.buckets + bucket], 1)
    spelled = np.log(new) - (sizes[rare] + 1) * SPELL
    gain = np.log1p(-new) - np.log(others)
    where = place[rare]
    n = np.where(where >= 0, vocabulary.n[where] if len(vocabulary.n) else 0.0, 0.0) - (times if inside else 0)
    told = np.where(n > 0, np.log(np.maximum(n, 1)) + gain, spelled)
    sums = np.bincount(text, weights=times * told, minlength=texts).astype(np.float64)  # whole numbers if there are none
    tail = np.zeros(0, _TAIL)
    if vocabulary.rest is not None:
        beyond = np.flatnonzero(where < 0)
        tail = np.empty(len(beyond), _TAIL)
        tail["word"], tail["times"], tail["gain"] = words[beyond], times[beyond], times[beyond] * (gain - spelled)[beyond]
        cut = np.searchsorted(text[beyond], np.arange(texts + 1))
        return sums, [tail[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
    return sums, [b""] * texts


def encode(docs: DataFrame, net: Network, vocabulary: Vocabulary, inside: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, shares, rare): ids as little-endian 16-bit bytes, shares the sum of log P(word | bucket) as far as known, rare the words to look up as _TAIL."""
    known_only = Vocabulary(vocabulary.words, vocabulary.id, vocabulary.n, vocabulary.counts, vocabulary.new, None)
    shared = docs.sparkSession.sparkContext.broadcast(known_only)  # bounded by KNOWN
    some_rest = vocabulary.rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own = Vocabulary(own.words, own.id, own.n, own.counts, own.new, True if some_rest else None)
        known = _Known(own.words)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in row_blocks(at):
                found, sizes, begin = sized_words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                ids, place = _bucket(net, found).astype("<u2"), known.places(found)
                ids[place >= 0] = own.id[place[place >= 0]]
                shares, rare = _shares(net, own, found, sizes, ids, place, begin, inside)
                parts = [ids[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(begin), pa.int64()), pa.array(parts, pa.binary()), pa.array(shares), pa.array(rare, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "shares", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, shares double, rare binary")


def _texts(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for rows of about ``most`` tokens together."""
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    all_ids = np.frombuffer(data, "<u2") if data is not None and len(column) else np.zeros(0, "<u2")
    for lo, hi in row_blocks(at, most):
        yield lo, hi, all_ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def dealt(encoded: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """A written table (round, shard, place, times, ids) of the texts to train on, and the number of shards of a round.

    Rows that agree in id and text are summed up first, then spread evenly over all
    rounds and shards, so copies of one row, however many, are no shard's burden.
    """
    distinct = stash(encoded.where("n_tokens > 0").groupBy("doc_id", "ids").agg(F.count("*").alias("rows"), F.first("n_tokens").alias("n_tokens")), "texts")
    total = distinct.agg(F.sum(F.col("rows") * F.col("n_tokens"))).first()[0] or 0
    shards = max(1, math.ceil(math.sqrt(total / 2**21)), math.ceil(total / (rounds * SHARD)))
    slots = shards * rounds
    spread = distinct.withColumn("place", F.xxhash64("doc_id", "ids")).withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("rows"), F.lit(slots)).cast("int") - 1)))
    slot = (F.pmod("place", F.lit(slots)) + F.col("k")) % slots
    times = F.floor(F.col("rows") / slots) + F.when(F.col("k") < F.col("rows") % slots, 1).otherwise(0)
    return spread.select((slot % rounds).cast("int").alias("round"), F.floor(slot / rounds).cast("int").alias("shard"), "place", times.alias("times"), "ids"), shards


def _replicas(net: Network, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; blocks are cut by the shard's own texts, never by batches."""
        shard, own, moments, seen, held, turns, waiting = None, [], [], np.zeros(net.tokens), [], [], 0

        def learn() -> None:
            nonlocal held, turns, waiting, seen
            if held:
                block = Windows(np.concatenate(held), np.cumsum([0, *map(len, held)]), net.radius)
                chosen = block.chosen(net.every, np.array(turns))
                for lo in range(0, len(chosen), net.batch):
                    part = chosen[lo : lo + net.batch]
                    train_step(net, own, moments, block.targets[part], block.contexts(part))
                seen += np.bincount(block.targets[chosen], minlength=net.tokens)
            held, turns, waiting = [], [], 0

        def told() -> pa.RecordBatch:
            learn()
            change, weight = (np.array_split(x, PARTS) for x in ((flat(own) - flat(shared.value)).astype("<f2"), importance(net, seen).astype("<f4")))
            rows = [pa.array(range(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int32()), pa.array([c.tobytes() for c in change], pa.binary()), pa.array([w.tobytes() for w in weight], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, ["part", "shard", "change", "weight"])

        for batch in batches:
            for which, times, raw in zip(batch.column("shard").to_pylist(), batch.column("times").to_pylist(), batch.column("ids"), strict=True):
                if which != shard:
                    if shard is not None:
                        yield told()
                    shard, seen, own = which, np.zeros(net.tokens), [w.copy() for w in shared.value]
                    moments = [np.full_like(w, 0.01) for w in own]
                ids = np.frombuffer(raw.as_buffer(), "<u2").copy()
                for turn in range(times):
                    held.append(ids)
                    turns.append(turn)
                    waiting += len(ids)
                    if waiting >= BLOCK:
                        learn()
        if shard is not None:
            yield told()

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and shard, so sums have one order."""
    part, total, weights = None, None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(total / np.maximum(weights, 1)).astype("<f4").tobytes()], pa.binary())], ["part", "change"])

    for batch in batches:
        for p, change, weight in zip(batch.column("part").to_pylist(), batch.column("change"), batch.column("weight"), strict=True):
            if p != part:
                if part is not None:
                    yield told()
                part, total, weights = p, 0.0, 0.0
            own = np.frombuffer(weight.as_buffer(), "<f4").astype(np.float64)
            total, weights = total + np.frombuffer(change.as_buffer(), "<f2") * own, weights + own
    if part is not None:
        yield told()


def train(encoded: DataFrame, net: Network, counts: np.ndarray | None = None, rounds: int = 3) -> list[np.ndarray]:
    """Weights after one pass over all texts of ``encoded`` (a written table), in ``rounds`` parts with an average of the replicas behind each. Of every text each ``net.every``-th word is predicted.

    The result does not depend on partitions or on the order of rows. Texts without
    tokens teach nothing; rows that repeat an id and a text count as often as they
    are there; null ids are ids like any other. No text at all leaves the first weights.
    """
    spark = encoded.sparkSession
    texts, shards = dealt(encoded, rounds)
    weights = net.first(counts)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # bounded by the network's size
        own = texts.where(F.col("round") == k).drop("round")
        # one partition per shard; sorted, so that a task may also hold several
        replicas = own.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "ids").select("shard", "times", "ids").mapInArrow(_replicas(net, shared), "part int, shard int, change binary, weight binary")
        mean = replicas.repartition(min(PARTS, shards), "part").sortWithinPartitions("part", "shard").select("part", "change", "weight").mapInArrow(_averaged, "part int, change binary")
        change = {r["part"]: np.frombuffer(r["change"], "<f4") for r in mean.collect()}  # PARTS rows
        if change:
            weights = shaped(net, flat(weights) + np.concatenate([change[p] for p in range(PARTS)]))
        shared.unpersist()
    return weights


@dataclass(frozen=True)
class Model:
    net: Network
    vocabulary: Vocabulary
    weights: list[np.ndarray]


def _scores(encoded: DataFrame, model: Model, shares: bool) -> DataFrame:
    """(row, doc_id, n_tokens, total): the sum of log P(id | both sides) and, with ``shares``, of what is known of the words within their buckets."""
    net = model.net
    shared = encoded.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("shares").to_numpy()
            for lo, hi, ids, at in _texts(batch):
                block = Windows(ids, at, net.radius)
                total = np.concatenate([[0.0], np.cumsum(log_probabilities(net, shared.value, block.targets, block.contexts))])
                total = total[at[1:]] - total[at[:-1]] + (known[lo:hi] if shares else 0)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(total)], ["row", "doc_id", "n_tokens", "total"])

    return encoded.select("row", "doc_id", "ids", "shares").mapInArrow(run, "row long, doc_id long, n_tokens long, total double")


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, times, gain) for the words of each text that have to be looked up."""
    for batch in batches:
        rows = batch.column("row").to_numpy()
        column = batch.column("rare").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // _TAIL.itemsize
        words = np.frombuffer(data, _TAIL) if data is not None else np.zeros(0, _TAIL)
        for lo, hi in row_blocks(at, 1 << 18):
            part = words[at[lo] : at[hi]]
            if len(part):
                text = np.repeat(rows[lo:hi], np.diff(at[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(part["word"].view(np.int64) if part["word"].flags.c_contiguous else part["word"].copy().view(np.int64)), pa.array(part["times"].copy()), pa.array(part["gain"].copy())], ["row", "word", "times", "gain"])


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(rows: DataFrame, net: Network, words: Vocabulary, inside: bool = True) -> DataFrame:
    return stash(encode(rows, net, words, inside).withColumn("row", F.monotonically_increasing_id()), "ids")


def learn(docs: DataFrame, net: Network | None = None, rounds: int = 3, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """The model of a corpus, and the corpus's written ids, which ``score`` takes."""
    net = net or Network()
    rows = _typed(docs)
    words = vocabulary(stash(count_words(rows), "words"), net, known)
    encoded = _encoded(rows, net, words)
    return Model(net, words, train(encoded, net, words.counts, rounds)), encoded


def score(encoded: DataFrame, model: Model, shares: bool = True, inside: bool = True) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of written ids. Without ``shares`` a rare word counts as its bucket; ``inside`` tells whether the texts are of the corpus."""
    found = _scores(encoded, model, shares)
    if shares and model.vocabulary.rest is not None:
        rare = encoded.where(F.octet_length("rare") > 0).select("row", "rare").mapInArrow(_rare_words, "row long, word long, times long, gain double")
        others = F.col("n") - (F.col("times") if inside else 0)
        beyond = rare.join(model.vocabulary.rest, "word").where(others > 0).groupBy("row").agg(F.sum(F.col("gain") + F.col("times") * F.log(others)).alias("beyond"))
        found = found.join(beyond, "row", "left").withColumn("total", F.col("total") + F.coalesce("beyond", F.lit(0.0)))
    per = F.when(F.col("n_tokens") > 0, F.round(F.col("total") / F.col("n_tokens"), 6))
    return found.select("doc_id", "n_tokens", F.round("total", 4).alias("log_likelihood"), per.alias("per_token"))


def score_others(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of documents that the model has not learnt from."""
    return score(_encoded(_typed(docs), model.net, model.vocabulary, inside=False), model, inside=False)


def score_documents(docs: DataFrame, net: Network | None = None, rounds: int = 3) -> DataFrame:
    """As ``score_words``, but of the network's ids: a rare word counts as its bucket."""
    model, encoded = learn(docs, net, rounds)
    return score(encoded, model, shares=False)


def score_words(docs: DataFrame, net: Network | None = None, rounds: int = 3, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) for every row of ``docs``.

    log_likelihood is the sum over the text's words of the natural log of the probability
    given both sides, per_token that over n_tokens. At a rare word it is P(bucket | both sides)
    times the word's share of its bucket in the other documents: 1 - new times its count over
    that of all words of the bucket, both without this text, or, if no other text has it, new
    times 32 to the power of -(its bytes + 1), where new is the share of words that
    occur once among the bucket's tokens.
    Null and empty texts and white space have no tokens: 0, 0.0 and null. Null ids and
    repeated rows are rows like any other (each also counts in training); texts may be of
    any length; other columns are ignored; an empty table gives an empty result. Scores do
    not depend on partitions, but for the last digits of float sums.
    """
    model, encoded = learn(docs, net, rounds, known)
    return score(encoded, model)
