"""Language identification by a bidirectional gated recurrent network over bytes.

Method: a text's UTF-8 bytes are laid out in windows; in each a forward and a
backward gated recurrent unit (piecewise linear gates) read the bytes, and every
position gets a probability for each language from both states. A document's
probabilities are the means over all its positions. The network is trained in
numpy by backpropagation through time with Adam, on the driver.

What is learned from: labelled rows with a letter, at most
``documents_per_language`` of each language (those with the smallest hashes of
their id), and all windows of their whole texts; of a language with more than
``windows_per_language`` of them those with the smallest hashes, wherever in a
text they lie. Both bounds are parameters and don't depend on the size of the
table. Before any exchange rows are cut to about four times the asked number by
hash, which leaves fewer than asked only by a chance far below one in a million.
The driver sees one row for each language, which the network has an output for,
and the windows. Prediction reads every byte of every text and nothing
but the text.

Cases. A null text, or one without any letter, is ``und`` with score 0; so is
everything where no language could be learned. Equal texts get equal results.
A text of any length is cut into windows, none of it is left out. Null ids are kept and an
empty table gives no rows; other columns are not read.

``keep_known`` filters by what was told. There a letter that none of the learned
windows holds tells nothing, so the score is multiplied by the share of the text's letters
that they do hold (of either case): of a script that wasn't learned nothing stays. Another
language in the letters of a learned one is taken for the one it is most like.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillon.llm.common import map_arrow
from quillon.llm.shingles import mix

UNDETERMINED = "und"
WINDOW, HIDDEN, BATCH = 64, 10, 4096
#: Learned windows that say which score is usual.
USUAL = 4096


@dataclass
class Network:
    """Weights of both directions: tables for bytes, recurrent weights, and the output.

    ``letters`` are those of the learned windows, in lower case; all but a hundredth
    of the windows reach the score ``usual``.
    """

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    hidden: int = HIDDEN
    letters: frozenset[str] = frozenset()
    usual: float = 0.0

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
        rng, h, k = np.random.default_rng(seed), hidden, len(languages)
        w = {"v": rng.normal(0, 0.3, (k, 2 * h)), "c": np.zeros((k, 1))}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.5, (3 * h, 256))
            w[f"x{d}"][:h] += 1.0
            w[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))
        return Network(languages, {name: x.astype(np.float32) for name, x in w.items()}, hidden)

    def _step(self, d: str, at: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """One step of direction ``d`` for a column of bytes and the states before it."""
        n = self.hidden
        x = np.take(self.weights[f"x{d}"], at, axis=1)
        g = self.weights[f"u{d}"] @ h
        zr = x[: 2 * n]
        zr += g[: 2 * n]
        zr *= 0.25
        zr += 0.5
        gates = np.clip(zr, 0, 1)
        a = gates[n:] * g[2 * n :]
        a += x[2 * n :]
        new = np.clip(a, -1, 1)
        out = h - new
        out *= gates[:n]
        out += new
        if keep is not None:
            keep.append((at, h, zr, gates, g[2 * n :], a, new))
        return out

    def run(self, data: np.ndarray, lengths: np.ndarray | None = None, tape: dict | None = None):
        """Probabilities (position, language, window) summed over positions, or all with a tape.

        ``data`` is (position, window); a window shorter than the rest has its
        ``lengths``, and what lies beyond is left out of states and sums.
        """
        steps, n = data.shape
        zero = np.zeros((self.hidden, n), self.weights["v"].dtype)
        forward, h = np.empty((steps, self.hidden, n), zero.dtype), zero
        for t in range(steps):
            h = forward[t] = self._step("f", data[t], h, tape and tape["f"])
        h, v, c = zero, self.weights["v"], self.weights["c"]
        total = np.zeros((len(self.languages), n), np.float64)
        for t in range(steps - 1, -1, -1):
            h = self._step("b", data[t], h, tape and tape["b"])
            mask = None
            if lengths is not None:
                mask = (lengths > t).astype(np.float32)
                h *= mask
            y = v[:, : self.hidden] @ forward[t]
            y += v[:, self.hidden :] @ h
            y += c
            y -= y.max(0)
            np.exp(y, out=y)
            y /= y.sum(0)
            if tape:
                tape["y"].append((t, y, forward[t], h))
            total += y if mask is None else y * mask
        return total

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross-entropy over positions: backpropagation through time."""
        steps, n = data.shape
        h, w = self.hidden, self.weights
        tape: dict[str, list] = {"f": [None], "b": [None], "y": [None]}  # a list that isn't empty counts as a tape
        self.run(data, None, tape)
        tape = {name: x[1:] for name, x in tape.items()}
        grad = {name: np.zeros_like(x) for name, x in w.items()}
        errors, loss = {}, 0.0
        for t, y, hf, hb in tape["y"]:
            loss -= float(np.log(y[labels, np.arange(n)] + 1e-9).sum())
            e = y.copy()
            e[labels, np.arange(n)] -= 1
            e /= steps * n
            grad["v"] += np.hstack([e @ hf.T, e @ hb.T])
            grad["c"] += e.sum(1, keepdims=True)
            errors[t] = e
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, back = w[f"u{d}"], np.zeros((h, n), np.float32)
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            inputs, deltas = [], []
            for t in order:
                at, before, zr, gates, q, a, new = tape[d][t if d == "f" else steps - 1 - t]
                dh = w["v"][:, part].T @ errors[t] + back
                da = dh * (1 - gates[:h]) * (np.abs(a) < 1)
                dz = dh * (before - new)
                dzr = np.vstack([dz, da * q]) * ((zr > 0) & (zr < 1)) * 0.25
                dq = da * gates[h:]
                dg = np.vstack([dzr, dq])
                grad[f"u{d}"] += dg @ before.T
                back = dh * gates[:h] + u.T @ dg
                inputs.append(at)
                deltas.append(np.vstack([dzr, da]))
            hot = np.eye(256, dtype=np.float32)[np.concatenate(inputs)]
            grad[f"x{d}"] += np.hstack(deltas) @ hot
        return grad, loss / (steps * n)

    def predict(self, raw: list[bytes], window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
        """Mean probabilities over all positions of each non-empty byte string."""
        sizes = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw) + bytes(window), np.uint8)
        counts = -(-sizes // window)
        owner = np.repeat(np.arange(len(raw)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[owner] + inside * window
        lengths = np.minimum(window, sizes[owner] - inside * window)
        total = np.zeros((len(raw), len(self.languages)))
        whole, partial = np.flatnonzero(lengths == window), np.flatnonzero(lengths < window)
        partial = partial[np.argsort(lengths[partial], kind="stable")]
        for some, cut in ((whole, False), (partial, True)):
            for i in range(0, len(some), batch):
                at = some[i : i + batch]
                steps = int(lengths[at].max())
                block = data[starts[at] + np.arange(steps)[:, None]]
                sums = self.run(block, lengths[at] if cut else None)
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(owner[at], sums[k], len(raw))
        return total / sizes[:, None]

    def familiar(self, text: str) -> float:
        """The share of a text's letters that the learned windows hold; it has one at least."""
        if all(c.lower() in self.letters for c in set(text) if c.isalpha()):
            return 1.0
        counts = [(n, c.lower() in self.letters) for c, n in Counter(text).items() if c.isalpha()]
        return sum(n for n, known in counts if known) / sum(n for n, _ in counts)


def train(windows: list[bytes], labels: list[str], steps: int = 260, batch: int = 192, rate: float = 0.012, seed: int = 3, hidden: int = HIDDEN) -> Network:
    """Fit a network to labelled windows of equal length by Adam; classes are drawn evenly."""
    languages = sorted(set(labels))
    network = Network.fresh(languages, hidden, seed)
    network.letters = frozenset(c for c in set(b" ".join(windows).decode(errors="ignore").lower()) if c.isalpha())
    if len(languages) < 2:
        return network
    data = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1)
    truth = np.array([languages.index(x) for x in labels])
    of = [np.flatnonzero(truth == k) for k in range(len(languages))]
    rng = np.random.default_rng(seed)
    mean = {name: np.zeros_like(x) for name, x in network.weights.items()}
    square = {name: np.zeros_like(x) for name, x in network.weights.items()}
    for step in range(1, steps + 1):
        kinds = rng.integers(0, len(languages), batch)
        at = np.array([of[k][rng.integers(len(of[k]))] for k in kinds])
        grad, _ = network.gradients(np.ascontiguousarray(data[at].T), truth[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.98 * square[name] + 0.02 * g * g
            network.weights[name] -= (now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    some = rng.permutation(len(windows))[:USUAL]
    network.usual = float(np.quantile(network.predict([windows[i] for i in some]).max(1), 0.01))
    return network


def windows_of(raw: bytes, window: int) -> list[bytes]:
    """A whole text as windows, the last one moved back to be whole; a short text repeats itself to fill one."""
    if len(raw) < window:
        return [(raw * (window // len(raw) + 1))[:window]]
    starts = [*range(0, len(raw) - window, window), len(raw) - window]
    return [raw[i : i + window] for i in starts]


def held_out(key="doc_id"):
    """Rows kept from learning: CRC-32 of the id as text, modulo 5, is 0 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, documents_per_language: int = 400, windows_per_language: int = 40_000, window: int = WINDOW, **fit) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    counted = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return train([], [], **fit)
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(":language"))), 1, 8), 16, 10).cast("long")
    below = F.create_map(*(F.lit(x) for lang, n in sorted(counted.items()) for x in (lang, min(1 << 32, (4 * documents_per_language << 32) // n))))
    rows = labelled.select("doc_id", "lang", "text", draw.alias("draw")).filter(F.col("draw") < below[F.col("lang")])
    first = W.Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    chosen = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= documents_per_language).select("lang", "text", "draw")

    def cut(batches):
        for batch in batches:
            for lang, text, at in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "draw")), strict=True):
                pieces = windows_of(text.encode(), window)
                order = mix(np.uint64(at) * np.uint64(1 << 32) + np.arange(len(pieces), dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces), pa.string()), pa.array(pieces, pa.binary()), pa.array(order)], ["lang", "piece", "order"])

    pieces = map_arrow(chosen, cut, "lang string, piece binary, order long")
    nth = F.row_number().over(W.Window.partitionBy("lang").orderBy("order", "piece"))
    sample = sorted((r.lang, bytes(r.piece)) for r in pieces.withColumn("nth", nth).filter(F.col("nth") <= windows_per_language).select("lang", "piece").collect())
    return train([p for _, p in sample], [lang for lang, _ in sample], **fit)


def classify(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the pooled probability of that language."""
    languages, weights, hidden = network.languages, network.weights, network.hidden

    def rows(batches):
        net = Network(languages, weights, hidden)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            read = [i for i, x in enumerate(raw) if languages and x and any(map(str.isalpha, x))]
            names, scores = [UNDETERMINED] * len(raw), np.zeros(len(raw))
            if read:
                p = net.predict([raw[i].encode() for i in read])
                best = p.argmax(1)
                scores[read] = np.clip(p[np.arange(len(read)), best], 0, 1)
                for i, k in zip(read, best.tolist(), strict=True):
                    names[i] = languages[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network, least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose language could be told with ``least`` score.

    A network that reaches less on what it learned from asks no more than is usual
    there. With no languages learned nothing can be told, and every text with a letter stays.
    """
    names = docs.columns

    def rows(batches):
        asked = min(least, network.usual)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            keep = np.array([bool(x) and any(map(str.isalpha, x)) for x in raw], bool)
            if network.languages:
                share = np.array([network.familiar(x) if k else 0.0 for x, k in zip(raw, keep.tolist(), strict=True)])
                keep &= share >= asked
                read = np.flatnonzero(keep)
                if len(read):
                    keep[read] = network.predict([raw[i].encode() for i in read]).max(1) * share[read] >= asked
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(names))], names).filter(pa.array(keep))

    return map_arrow(docs, rows, docs.schema)
