"""Language-model scores by masked pseudo-likelihood.

Method: a small network sees a window on both sides of a position, not the word
there, and predicts that word. A document's score is the sum of the log
probabilities of all its words, each given its neighbours.

Words are counted over all documents, each by its own 64-bit hash. Those that
occur most often make the vocabulary, at most ``KNOWN``: all above a count, so
that no tie is broken; of them the ``OWN`` commonest are numbers of their own, and
every other word belongs to the number of its first byte. Inside such a number a
word of the vocabulary has its counted share. What is left is shared by all other
words: each has its count less ``DISCOUNT``, and what is taken from the counts goes
to all words there can be by a chain of bytes: the first byte given the number,
each next byte or the word's end given the last byte, counted over all
occurrences of such words. So every word has a probability of its own, also one
that never occurs, and those of a number sum to one (but for what the chain gives
to words of the vocabulary). Counts of words outside the vocabulary stay a table
that scoring joins; they are many, and none is frequent.

The network predicts numbers: a softmax over classes of numbers and one inside
the class; its biases start at the counted frequencies. Every partition of the
corpus trains a copy of the weights by Adagrad, every position of its documents
being a target in each of ``ROUNDS`` rounds; the copies are averaged by their
numbers of targets, in levels. Weights therefore depend on how the rows are
dealt over partitions; for given partitions they repeat. What is counted grows
with the corpus; what the driver sees is the vocabulary and one set of weights.

Cases. A null, empty or blank text has 0 words, score 0 and no mean. Equal texts
get equal scores for given weights. Texts of any length count and are scored
whole. An empty table gives no rows and leaves the network at its start. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, save
from quillon.llm.shingles import lower, word_runs

#: Words with shares of their own, numbers, and how numbers lie in classes.
KNOWN, CLASSES, INSIDE, GROUPS = 65_536, 64, 64, 64
VOCABULARY = CLASSES * INSIDE
OWN = VOCABULARY - GROUPS
AROUND, HIDDEN, ROUNDS, BATCH = (-2, -1, 1, 2), 16, 1, 16_384
#: Hashes that a task counts before it passes them on.
HELD = 400_000
#: What every byte is taken to occur more often than it was counted, and what each rare word's count gives away.
UNSEEN, DISCOUNT = 0.1, 0.75


class Network:
    """Weights: a table for each place of the window, and both softmaxes."""

    SHAPES = {"e": (len(AROUND), VOCABULARY + 1, HIDDEN), "b": (HIDDEN,), "cw": (CLASSES, HIDDEN), "cb": (CLASSES,), "ww": (CLASSES, INSIDE, HIDDEN), "wb": (CLASSES, INSIDE)}

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    @staticmethod
    def fresh(counts: np.ndarray, seed: int = 13) -> Network:
        """Small random tables; biases at the logarithms of the smoothed counts of numbers."""
        rng = np.random.default_rng(seed)
        w = {k: (rng.normal(0, 0.3, s) if k in ("e", "cw", "ww") else np.zeros(s)).astype(np.float32) for k, s in Network.SHAPES.items()}
        table = (counts + 0.5).reshape(INSIDE, CLASSES).T  # number = place inside * CLASSES + class
        w["cb"] = np.log(table.sum(1) / table.sum()).astype(np.float32)
        w["wb"] = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
        return Network(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.SHAPES])

    @staticmethod
    def from_flat(x: np.ndarray) -> Network:
        w, at = {}, 0
        for k, s in Network.SHAPES.items():
            n = math.prod(s)
            w[k] = x[at : at + n].reshape(s).astype(np.float32)
            at += n
        return Network(w)

    def tame(self) -> bool:
        """Whether no logit can leave the range of ``exp``, as hidden units lie between -1 and 1."""
        w = self.weights
        return all(float((np.abs(w[k]).sum(-1) + np.abs(w[b])).max()) < 80 for k, b in (("cw", "cb"), ("ww", "wb")))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """(position, unit) for the numbers around each position, (position, place)."""
        h = self.weights["e"][0][context[:, 0]]
        h += self.weights["b"]
        for p in range(1, len(AROUND)):
            h += self.weights["e"][p][context[:, p]]
        return np.tanh(h, out=h)

    def _inner(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What the softmax inside a class starts from, for positions sorted by class."""
        y = np.empty((len(h), INSIDE), h.dtype)
        for k in range(CLASSES):
            some = slice(bounds[k], bounds[k + 1])
            np.matmul(h[some], self.weights["ww"][k].T, out=y[some])
            y[some] += self.weights["wb"][k]
        return y

    @staticmethod
    def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the targets by class, and where each class begins in it."""
        kind = (target % CLASSES).astype(np.uint8)
        return np.argsort(kind, kind="stable"), np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES)))

    def log_probabilities(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The log probability of each target given what is around it."""
        w, (order, bounds) = self.weights, self.by_class(target)
        target, row = target[order], np.arange(len(target))
        h = self.hidden(context[order])
        tame = self.tame()
        found = _log_at(h @ w["cw"].T + w["cb"], row, target % CLASSES, tame)
        found += _log_at(self._inner(h, bounds), row, target // CLASSES, tame)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, target: np.ndarray, context: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean negative log probability."""
        w, n, (order, bounds) = self.weights, len(target), self.by_class(target)
        target, context, row = target[order], context[order], np.arange(n)
        h = self.hidden(context)
        grad = {k: np.zeros_like(x) for k, x in w.items()}
        a = h @ w["cw"].T + w["cb"]
        tame = self.tame()
        loss = -_errors(a, row, target % CLASSES, tame)
        grad["cw"], grad["cb"] = a.T @ h, a.sum(0)
        dh = a @ w["cw"]
        y = self._inner(h, bounds)
        loss -= _errors(y, row, target // CLASSES, tame)
        for k in range(CLASSES):
            some = slice(bounds[k], bounds[k + 1])
            grad["ww"][k], grad["wb"][k] = y[some].T @ h[some], y[some].sum(0)
            dh[some] += y[some] @ w["ww"][k]
        dh *= 1 - h * h
        grad["b"] = dh.sum(0)
        for p in range(len(AROUND)):
            at = context[:, p].astype(np.uint16)
            by = np.argsort(at, kind="stable")
            at = at[by]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            grad["e"][p][at[first]] = np.add.reduceat(dh[by], first, 0)
        return grad, loss / n


def _log_at(x: np.ndarray, row: np.ndarray, column: np.ndarray, tame: bool) -> np.ndarray:
    """The log of the softmax of each row at one column; ``x`` is used up."""
    if not tame:
        x -= x.max(1, keepdims=True)
    chosen = x[row, column]
    np.exp(x, out=x)
    return chosen - np.log(x.sum(1))


def _errors(x: np.ndarray, row: np.ndarray, column: np.ndarray, tame: bool) -> float:
    """Turns rows into softmax minus truth, over their number; gives the sum of the log probabilities."""
    if not tame:
        x -= x.max(1, keepdims=True)
    chosen = x[row, column]
    np.exp(x, out=x)
    total = x.sum(1)
    x *= (1 / (total * len(x)))[:, None]
    x[row, column] -= 1 / len(x)
    return float((chosen - np.log(total)).sum())


@dataclass
class Vocabulary:
    """The counted words: sorted hashes with their numbers and log shares, and what is left for others."""

    hashes: np.ndarray
    number: np.ndarray
    share: np.ndarray
    escape: np.ndarray
    counts: np.ndarray
    #: For each first byte's number the occurrences of words outside the vocabulary, and how many such words there are.
    rare: np.ndarray
    kinds: np.ndarray

    def read(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word, its log share of the number, and whether it has to be spelled."""
        group = first.astype(np.int64) % GROUPS
        if not len(self.hashes):
            return OWN + group, self.escape[group], np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.number[at], OWN + group), np.where(known, self.share[at], self.escape[group]), ~known


def _firsts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return lower(data[starts])


def count_words(docs: DataFrame) -> DataFrame:
    """``hash``, ``n`` and ``first`` (byte) of every word of all documents."""

    def rows(batches):
        held, size = [], 0

        def merged():
            h, n, first = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, at, back = np.unique(h, return_index=True, return_inverse=True)
            return unique, np.bincount(back, n).astype(np.int64), first[at]

        def out(h, n, first):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(first.astype(np.int32))], ["hash", "n", "first"])

        for batch in batches:
            for _, hashes, _, data, starts, _ in word_runs([(x or "").encode() for x in batch.column("text").to_pylist()]):
                unique, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((unique, n, _firsts(data, starts[at])))
                size += len(unique)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    found = map_arrow(docs.select("text"), rows, "hash long, n long, first int")
    return found.groupBy("hash").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def vocabulary(docs: DataFrame, known: int = KNOWN) -> tuple[Vocabulary, DataFrame]:
    """Counted over all documents, and the counts (hash, n) of the other words; ``known`` bounds the former."""
    counted = save(count_words(docs))
    # A histogram over counts, whole up to 1024 and in 64 steps to the doubling beyond, says from which count on words are known.
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) + F.floor(F.log2(F.col("n") / F.lit(1024)) * 64)).cast("int")
    above, least = 0, 1 << 30
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if (above := above + r.words) > known:
            break
        least = r.step
    top = sorted(counted.filter(step >= least).collect(), key=lambda r: (-r.n, r.hash))
    total, kinds = np.zeros(256), np.zeros(256)
    for r in counted.groupBy("first").agg(F.sum("n").alias("n"), F.count(F.when(step < least, 1)).alias("kinds")).collect():  # a row for each byte
        total[r["first"]], kinds[r["first"]] = r.n, r.kinds
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    n, group = np.array([r.n for r in top], float), np.array([r["first"] for r in top], np.int64) % GROUPS
    number = np.where(np.arange(len(top)) < OWN, np.arange(len(top)), OWN + group)
    counts = np.bincount(number[:OWN], n[:OWN], VOCABULARY)
    of_byte = np.arange(256) % GROUPS
    rest = np.bincount(of_byte, total, GROUPS) - np.bincount(group[:OWN], n[:OWN], GROUPS)
    counts[OWN:] = rest
    rare = rest - np.bincount(group[OWN:], n[OWN:], GROUPS)
    share = np.where(number < OWN, 0.0, np.log(n) - np.log(rest + 0.5)[group])
    order = np.argsort(hashes)
    words = Vocabulary(hashes[order], number[order], share[order], np.log((rare + 0.5) / (rest + 0.5)), counts, rare, np.bincount(of_byte, kinds, GROUPS))
    return words, counted.filter(step < least).select("hash", "n")


SPELLED = 256 + 256 * 257


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of words from byte to byte, 256 at the end, as places in a table; where each word's begin; first bytes."""
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    flat = lower(data[np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))]).astype(np.int64)
    following = np.append(flat[1:], 256)
    following[begin[1:] - 1] = 256
    return flat * 257 + following, begin, flat[begin]


def spelling_logs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of first bytes in their group, and of steps from a byte, from counts laid end to end."""
    first, step = counts[:256] + UNSEEN, counts[256:].reshape(256, 257) + UNSEEN
    group = np.bincount(np.arange(256) % GROUPS, first, GROUPS)
    return np.log(first / group[np.arange(256) % GROUPS]), np.log(step / step.sum(1, keepdims=True)).ravel()


def contexts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(position, place): the numbers around each word inside its text, VOCABULARY outside."""
    n, ends = len(ids), np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.full((n, len(AROUND)), VOCABULARY, np.int64)
    for p, step in enumerate(AROUND):
        here, there = (slice(0, max(n - step, 0)), slice(step, None)) if step > 0 else (slice(-step, None), slice(0, max(n + step, 0)))
        np.copyto(out[here, p], ids[there], where=owner[here] == owner[there])
    return out


COPY = "weight double, vector binary, spelled binary"


def _copy(weight: float, vector: np.ndarray, spelled: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([vector.astype(np.float32).tobytes()], pa.binary()), pa.array([spelled.astype(np.int64).tobytes()], pa.binary())], ["weight", "vector", "spelled"])


def _average(copies: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The mean of the copies by weight and the sum of their spellings, in levels of square roots."""

    def rows(batches):
        total, spelled, n = None, None, 0.0
        for batch in batches:
            for weight, raw, steps in zip(*(batch.column(c).to_pylist() for c in ("weight", "vector", "spelled")), strict=True):
                x, y = np.frombuffer(raw, np.float32).astype(np.float64) * weight, np.frombuffer(steps, np.int64)
                total, spelled, n = (x, y.copy(), weight) if total is None else (total + x, spelled + y, n + weight)
        if n:
            yield _copy(n, total / n, spelled)

    some = copies.count()
    for parts in (math.isqrt(some), 1):
        if some > 1:
            copies = map_arrow(copies.repartition(max(1, parts)), rows, COPY)
    found = copies.collect()
    return (np.frombuffer(found[0].vector, np.float32), np.frombuffer(found[0].spelled, np.int64)) if found else None


@dataclass
class Model:
    """All that scoring needs."""

    words: Vocabulary
    network: Network
    first: np.ndarray
    step: np.ndarray

    def logs(self, hashes: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word of a run the log probability given its neighbours, up to what a rare word's count makes of it.

        Also where the rare words are, and the log probability of their spelling.
        """
        number, out, spelled = self.words.read(hashes, _firsts(data, starts))
        around = contexts(number, sizes)
        for i in range(0, len(number), piece):
            out[i : i + piece] += self.network.log_probabilities(number[i : i + piece], around[i : i + piece])
        at = np.flatnonzero(spelled)
        if not len(at):
            return out, at, np.zeros(0)
        steps, begin, first = spelling(data, starts[at], ends[at])
        return out, at, self.first[first] + np.add.reduceat(self.step[steps], begin)


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = 0.15, seed: int = 13, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """A model of the whole corpus: its vocabulary, a network trained on all positions, spellings; and the counts of rare words."""
    words, rare = vocabulary(docs, known)
    network, spelled = Network.fresh(words.counts, seed), np.zeros(SPELLED, np.int64)
    for turn in range(rounds):
        start = network.flat()
        slow = rate / (1 + turn)

        def rows(batches, start=start, slow=slow):
            own = Network.from_flat(start)
            squares = {k: np.full(s, 0.01, np.float32) for k, s in Network.SHAPES.items()}
            seen, held, size, steps = 0, [], 0, np.zeros(SPELLED, np.int64)

            def learn(target, context):
                nonlocal seen
                grad, _ = own.gradients(target, context)
                for k, g in grad.items():
                    g *= len(target) ** 0.5
                    squares[k] += g * g
                    g /= np.sqrt(squares[k])
                    g *= slow
                    own.weights[k] -= g
                seen += len(target)

            for batch in batches:
                for _, hashes, sizes, data, starts, ends in word_runs([(x or "").encode() for x in batch.column("text").to_pylist()]):
                    if not len(hashes):
                        continue
                    ids, _, spell = words.read(hashes, _firsts(data, starts))
                    if spell.any():
                        step, _, first = spelling(data, starts[spell], ends[spell])
                        steps[:256] += np.bincount(first, minlength=256)
                        steps[256:] += np.bincount(step, minlength=256 * 257)
                    held.append((ids, contexts(ids, sizes)))
                    size += len(ids)
                    if size >= BATCH:
                        target, context = (np.concatenate(x) for x in zip(*held, strict=True))
                        whole = size // BATCH * BATCH
                        # Batches of positions from all over what is held, so that one long text doesn't fill one.
                        parts = whole // BATCH
                        for k in range(parts):
                            learn(target[k:whole:parts], context[k:whole:parts])
                        held, size = [(target[whole:], context[whole:])], size - whole
            if size:
                learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if seen:
                yield _copy(seen, own.flat(), steps)

        mean = _average(save(map_arrow(docs.select("text"), rows, COPY)))
        if mean is not None:
            network, spelled = Network.from_flat(mean[0]), mean[1]
    return Model(words, network, *spelling_logs(spelled)), rare


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_likelihood`` (summed over words), ``mean`` (for each word) and ``n_once``.

    ``n_once`` counts the words that the corpus of the model holds in no other
    place; a document without any may be a copy.
    """

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, hashes, sizes, data, starts, ends in word_runs([(x or "").encode() for x in batch.column("text").to_pylist()]):
                logs, at, spelled = model.logs(hashes, sizes, data, starts, ends) if len(hashes) else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.bincount(owner, logs, len(sizes))
                offsets = np.append(0, np.cumsum(np.bincount(owner[at], minlength=len(sizes)))).astype(np.int32)
                groups = _firsts(data, starts[at]) % GROUPS if len(at) else np.zeros(0, np.uint8)
                words = pa.StructArray.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(groups.astype(np.int32)), pa.array(spelled.astype(np.float64))], ["hash", "g", "log"])
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), words)], ["doc_id", "n_words", "sure", "rare"])

    made = map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, n_words long, sure double, rare array<struct<hash:long,g:int,log:double>>")
    made = save(made.withColumn("row", F.monotonically_increasing_id()))
    # Rare words with their counts: (count - discount) / all, and the spelling's part of what was taken.
    every, kinds = (F.array(*(F.lit(float(x)) for x in v)) for v in (model.words.rare, model.words.kinds))
    words = made.select("row", F.explode("rare").alias("w")).select("row", "w.*").join(rare.select(F.col("hash").alias("known"), "n"), F.col("hash") == F.col("known"), "left")
    all_of, kinds_of = every[F.col("g")], kinds[F.col("g")]
    part = F.try_divide(DISCOUNT * kinds_of, all_of)
    seen = F.log(F.try_divide(F.col("n") - DISCOUNT, all_of) + part * F.exp("log"))
    # A sum of decimals doesn't depend on the order of its parts.
    log = F.when(F.col("n") > 0, seen).when(all_of > 0, F.col("log") + F.log(part)).otherwise(F.col("log")).cast("decimal(18,9)")
    sums = words.groupBy("row").agg(F.sum(log).cast("double").alias("counted"), F.count(F.when(F.col("n") == 1, 1)).alias("n_once"))
    total = F.col("sure") + F.coalesce("counted", F.lit(0.0))
    found = made.select("row", "doc_id", "n_words", "sure").join(sums.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    return found.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean"), F.coalesce("n_once", F.lit(0)).alias("n_once"))


def score_words(docs: DataFrame) -> DataFrame:
    """``score`` of every word of the documents, under a model of them."""
    return score(docs, *fit(docs))
