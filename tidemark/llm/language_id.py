"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled text windows. It labels every byte of
every text: texts are read in windows, each from both ends, and the class probabilities of all letter bytes are
averaged to those of the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import as_array, parts, raw

#: Units of each direction; bytes of a window when reading and when learning.
UNITS, READ, LEARN = 8, 96, 64
#: The sample: windows of each language at most, and of each document.
SAMPLE, PER_DOC = 1500, 3
#: Documents drawn for the sample, as a multiple of those that would just do.
DRAWN = 4
#: Windows read together, and bytes of text.
TOGETHER, READ_BYTES = 4096, 1 << 19
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; numpy's single-precision exp is much faster than its tanh."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


@dataclass
class Network:
    """``inputs``: what each byte adds to the gates (256 x 3 units, of both directions); ``state``: what the state adds."""

    languages: list[str]
    inputs: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], units: int = UNITS, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, [draw(256, 3 * units, scale=0.3) for _ in range(2)], [draw(units, 3 * units, scale=0.3) for _ in range(2)], draw(2 * units, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.state, self.out, self.bias]

    def states(self, text: np.ndarray, way: int, keep: list | None = None, live: np.ndarray | None = None) -> np.ndarray:
        """States of one direction after each byte; ``text``: steps x windows. ``live``: where a window has text."""
        steps, n = text.shape
        inputs, state, u = self.inputs[way], self.state[way], self.state[way].shape[0]
        out = np.empty((steps, n, u), np.float32)
        h = np.zeros((n, u), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x, s = inputs.take(text[t], axis=0), h @ state
            gates = np.add(x[:, : 2 * u], s[:, : 2 * u])
            gates = _sigmoid(gates)
            z, r = gates[:, :u], gates[:, u:]
            c = _tanh(x[:, 2 * u :] + r * s[:, 2 * u :])
            new = c + z * (h - c)
            if live is not None:
                new *= live[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, s[:, 2 * u :]))
            out[t] = h = new
        return out

    def probabilities(self, text: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Of each byte (languages x steps x windows)."""
        u = self.state[0].shape[0]
        score = sum(self.out[way * u : (way + 1) * u].T @ self.states(text, way, live=live).reshape(-1, u).T for way in (0, 1))
        score += self.bias[:, None]
        np.exp(np.minimum(score, 60, out=score), out=score)
        score /= score.sum(axis=0)
        return score.reshape(-1, *text.shape)

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all bytes, and its gradient by backpropagation through time."""
        steps, n = text.shape
        kept: tuple[list, list] = ([], [])
        ways = [self.states(text, way, kept[way]) for way in (0, 1)]
        both = np.concatenate(ways, axis=2)
        score = both @ self.out + self.bias
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(n), label] + 1e-12).mean())
        p[:, np.arange(n), label] -= 1
        p /= steps * n
        d_out = np.tensordot(both, p, axes=([0, 1], [0, 1]))
        d_both = p @ self.out.T
        u = self.state[0].shape[0]
        d_in, d_state = [], []
        for way in (0, 1):
            di, ds, dh = np.zeros_like(self.inputs[way]), np.zeros_like(self.state[way]), np.zeros((n, u), np.float32)
            for t, h, z, r, c, sc in reversed(kept[way]):
                dh = dh + d_both[t, :, way * u : (way + 1) * u]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * sc * r * (1 - r)
                dx = np.concatenate((dz, dr, dc), axis=1)
                dsum = np.concatenate((dz, dr, dc * r), axis=1)
                order = np.argsort(text[t], kind="stable")
                sorted_bytes = text[t][order]
                first = np.flatnonzero(np.concatenate(([True], sorted_bytes[1:] != sorted_bytes[:-1])))
                di[sorted_bytes[first]] += np.add.reduceat(dx[order], first, axis=0)
                ds += h.T @ dsum
                dh = dh * z + dsum @ self.state[way].T
            d_in.append(di)
            d_state.append(ds)
        return loss, [*d_in, *d_state, d_out, p.sum(axis=(0, 1))]


@np.errstate(over="ignore", under="ignore")
def train(windows: list[bytes], labels: list[str], steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 0) -> Network:
    """A network for the labels that occur; classes count alike, whatever their numbers. Adam, with a falling rate."""
    languages = sorted(set(labels))
    net = Network.fresh(languages, seed=seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    order = np.argsort(np.array([w + b"" for w in windows], dtype=object), kind="stable")
    text = np.stack([np.frombuffer(windows[i].ljust(LEARN, b" ")[:LEARN], np.uint8) for i in order])
    y = np.array([languages.index(labels[i]) for i in order])
    rows = [np.flatnonzero(y == k) for k in range(len(languages))]
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(rows[k]) for k in rng.integers(len(languages), size=batch)])
        _, grads = net.gradients(np.ascontiguousarray(text[pick].T), y[pick])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(net.weights(), grads, m, v, strict=True):
            g = g / norm
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _pooled(net: Network, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed probabilities (texts x languages) and letters of each text."""
    n = len(at) - 1
    total, letters = np.zeros((n, len(net.languages))), np.zeros(n, np.int64)
    size = np.diff(at)

    def read(owner: np.ndarray, start: np.ndarray, counted: np.ndarray, live: np.ndarray | None) -> None:
        """Windows from ``start``; only the last ``counted`` bytes of a window are new."""
        for a in range(0, len(owner), TOGETHER):
            s = slice(a, a + TOGETHER)
            place = start[s][None, :] + np.arange(READ)[:, None]
            own = np.arange(READ)[:, None] >= READ - counted[s][None, :]
            on = None
            if live is not None:
                on = (np.arange(READ)[:, None] < live[s][None, :]).astype(np.float32)
                own = on > 0
                place = np.minimum(place, len(data) - 1)
            text = data[place]
            own = own & LETTER[text]
            p = net.probabilities(text, on)
            p *= own
            np.add.at(total, owner[s], p.sum(axis=1, dtype=np.float64).T)
            np.add.at(letters, owner[s], own.sum(axis=0))

    long = np.flatnonzero(size >= READ)
    count = -(-size[long] // READ)
    owner = np.repeat(long, count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    last = number == np.repeat(count - 1, count)
    new = np.where(last, size[owner] - number * READ, READ)
    # the last window ends with its text, and shares bytes with the one before it
    start = at[owner] + np.where(last, size[owner] - READ, number * READ)
    read(owner, start, new, None)
    short = np.flatnonzero((size > 0) & (size < READ))
    read(short, at[short], size[short], size[short])
    return total, letters


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@np.errstate(over="ignore", under="ignore")
def _said(net: Network, batch: pa.RecordBatch) -> tuple[list[str], list[float]]:
    """Language and score of each row."""
    column = as_array(batch.column("text"))
    data, at = raw(column)
    n = len(column)
    total, letters = _pooled(net, data, at) if net.languages else (np.zeros((n, 0)), np.zeros(n, np.int64))
    part = data[at[0] : at[-1]]
    plain = np.diff(np.concatenate(([0], np.cumsum(LETTER[part] & (part < 128))))[at - at[0]]) > 0
    names, scores = [], []
    for i in range(n):
        if not letters[i] or not (plain[i] or _has_letter(column[i].as_py())):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(np.argmax(total[i]))
        names.append(net.languages[best])
        scores.append(min(1.0, max(0.0, float(total[i, best] / letters[i]))))
    return names, scores


def _predict(net: Network):
    def run(batches):
        for batch in parts(batches, READ_BYTES):
            names, scores = _said(net, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _accept(net: Network, least: float):
    def run(batches):
        for batch in parts(batches, READ_BYTES):
            names, scores = _said(net, batch)
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in zip(names, scores, strict=True)], pa.bool_()))

    return run


def _windows(batches):
    """A few windows of each text, from anywhere in it, with a rank that only the text decides."""
    for batch in parts(batches):
        data, at = raw(as_array(batch.column("text")))
        langs, out = batch.column("lang").to_pylist(), ([], [], [])
        for i, lang in enumerate(langs):
            size = int(at[i + 1] - at[i])
            if size < 8:
                continue
            whole = data[at[i] : at[i + 1]]
            rng = np.random.default_rng((size, int(whole[:: max(1, size // 64)].sum())))
            for start in rng.integers(0, max(1, size - LEARN + 1), size=PER_DOC):
                out[0].append(lang)
                out[1].append(whole[start : start + LEARN].tobytes())
                out[2].append(int(rng.integers(1 << 62)))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["lang", "piece", "rank"])


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from ``documents`` (doc_id, text, lang) that are not held out; at most ``sample`` different windows of each language are used.

    Documents are drawn by a hash of their text, at a rate that follows how many a language has, so what a task or the driver gets is
    bounded by the sample; copies of a text count once.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    docs = docs.where(~_held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rank = F.xxhash64("text")
    # of each language how many different texts, told by those in a small share of the hashes where there are many
    counts = docs.groupBy("lang").agg(F.approx_count_distinct(rank).alias("n"))
    share = F.least(F.lit(1.0), F.lit(DRAWN * sample / PER_DOC) / F.greatest("n", F.lit(1)))
    drawn = docs.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(F.pmod(rank, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    pieces = drawn.select("lang", "text").mapInArrow(_windows, "lang string, piece binary, rank long").dropDuplicates(["lang", "piece"])
    by_rank = Window.partitionBy("lang").orderBy("rank", "piece")
    rows = pieces.withColumn("k", F.row_number().over(by_rank)).where(F.col("k") <= sample).select("lang", "piece").toPandas()
    return train([bytes(x) for x in rows["piece"]], rows["lang"].tolist())


def identify(documents: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, by a trained network."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out("doc_id").alias("held_out"), "text")
    return docs.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``documents`` (doc_id, text, lang; other columns are left alone).

    Learned from rows whose crc32(doc_id) mod 4 is not 2 and whose lang is known. lang_pred is a learned language, or ``und`` with score
    0 if the text is null or without a letter, or nothing could be learned; score is the mean probability over the letters. Repeated
    rows each return a row; a null doc_id counts as not held out. Texts of any length are read whole. An empty table gives an
    empty result.
    """
    return identify(documents, learn(documents))


def accepted(documents: DataFrame, least: float = 0.35) -> DataFrame:
    """``documents`` whose language is found with a score of at least ``least``, all columns as they were."""
    return documents.mapInArrow(_accept(learn(documents), least), documents.schema)
