"""Secret scan: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret.

A token's features are its shape, its neighbours' words and shapes, what stands between it and the token before, and its file's length
and share of digits. The field is trained in numpy on a bounded sample: the tokens of pattern matches are the secrets,
and in copies of them the values are drawn anew from other alphabets, and made-up values are put between the words of other texts, most with
no keyword before them, so that the field learns secrets by their look where there are few to learn from. Labels are decoded by Viterbi. A token whose scores no transitions could turn from outside splits the chain exactly, so only the runs between
such tokens are decoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import _FOLDED as FOLDED
from tidemark.llm.text import as_array, blocks, parts, segment_hashes, word_spans

# fixed values: the patterns of the base kinds, in their order, and the least length of what they match
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ADDED = "crf"

#: The sample: documents with a match and without one, and tokens of a training window.
SAMPLE, WINDOW = 1500, 24
#: Characters around a document's first match, or of its start, that are learned from.
AROUND = 4000
#: Made-up values of a sample, about.
MADE_UP = 3000
#: No transition weighs more than this, which bounds how far a neighbour can turn a label.
TRANSITION = 2.0
#: Characters that an added span has at least.
LEAST = 8
OUT, BEGIN, INSIDE = 0, 1, 2

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-", *range(128, 256)]] = False
# classes of bytes: other, digit, upper, lower, beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[[*b"0123456789abcdefABCDEF"]] = True
_LENGTHS = np.array([4, 6, 8, 12, 16, 24, 40])
_WORDS = 512
_SIZES = (8 * 32, 8 * 5, 16, 8, _WORDS + 1, _WORDS + 1, 8 * 32 + 1, 4, 5, 1)
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def features(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, feature numbers)`` of the tokens of texts laid end to end; a row of features for each token."""
    start, end = word_spans(b, at, _SEPARATES)
    n = len(start)
    if not n:
        return start, end, np.zeros((0, len(_SIZES)), np.int32)
    kind = _CLASS[b]
    size = end - start
    digits, uppers, lowers, wides, others = (s[end] - s[start] for s in (_sums(kind == c) for c in (1, 2, 3, 4, 0)))
    hexes = _sums(_HEXDIGIT[b])
    turns = _sums(np.concatenate(([False], kind[1:] != kind[:-1])))
    turn = turns[end] - turns[start + 1]
    length = np.searchsorted(_LENGTHS, size, side="right")
    shape = (digits > 0) + 2 * (uppers > 0) + 4 * (lowers > 0) + 8 * (wides > 0) + 16 * (others > 0)
    both = length * 32 + shape
    only_hex = (hexes[end] - hexes[start] == size) & (size >= 12)
    text = np.searchsorted(at, start, side="right") - 1
    first = np.concatenate(([True], text[1:] != text[:-1]))
    last = np.concatenate((first[1:], [True]))
    before = np.where(first, at[text], np.concatenate(([0], end[:-1])))
    marks = [s[start] - s[before] > 0 for s in (_sums((b == 61) | (b == 58)), _sums((b == 34) | (b == 39)), _sums(b == 10))]
    word = (segment_hashes(b, start, end, FOLDED) >> np.uint64(55)).astype(np.int64)
    previous = np.where(first, _WORDS, np.concatenate(([0], word[:-1])))
    following = np.where(last, _WORDS, np.concatenate((word[1:], [0])))
    shape_before = np.where(first, 256, np.concatenate(([0], both[:-1])))
    tokens = np.bincount(text, minlength=len(at) - 1)
    with_digit = np.bincount(text[digits > 0], minlength=len(at) - 1)
    dense = np.searchsorted([0.01, 0.05, 0.2], with_digit / np.maximum(tokens, 1), side="right")
    long = np.minimum(np.log10(np.maximum(np.diff(at), 1)).astype(np.int64), 4)
    columns = (both, length * 5 + np.searchsorted([1, 2, 4, 8], turn, side="right"), marks[0] + 2 * marks[1] + 4 * marks[2] + 8 * (digits * 8 > size), only_hex + 2 * np.searchsorted([1, 3, 6], np.minimum(digits, lowers + uppers), side="right"), previous, following, shape_before, dense[text], long[text], np.zeros(n, np.int64))
    return start, end, np.stack([c + s for c, s in zip(columns, _STARTS[:-1], strict=True)], axis=1).astype(np.int32)


class Field:
    """Weights of the features (features x labels) and of the transitions (from x to)."""

    def __init__(self):
        self.weights = np.zeros((int(_STARTS[-1]), 3), np.float32)
        self.transitions = np.zeros((3, 3), np.float32)

    def scores(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros((len(found), 3), np.float32)
        for k in range(found.shape[1]):
            out += self.weights.take(found[:, k], axis=0)
        return out

    def viterbi(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Best labels; ``at``: where each text's tokens begin. Texts start and end outside."""
        labels = np.zeros(len(scores), np.int8)
        span = float(self.transitions.max() - self.transitions.min())
        open_ = scores[:, OUT] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= 2 * span
        if not open_.any():
            return labels
        head = open_.copy()
        head[1:] &= ~open_[:-1]
        head[at[at < len(scores)]] |= open_[at[at < len(scores)]]
        start = np.flatnonzero(head)
        tail = open_.copy()
        tail[:-1] &= ~open_[1:] | head[1:]
        size = np.flatnonzero(tail) + 1 - start
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 4096)):
            n, most = len(part), int(size[part].max())
            row = scores[np.minimum(start[part][:, None] + np.arange(most), len(scores) - 1)]
            best = self.transitions[OUT] + row[:, 0]
            back = np.zeros((most, n, 3), np.int8)
            ends = np.where((size[part] == 1)[:, None], best, 0)
            for t in range(1, most):
                step = best[:, :, None] + self.transitions[None]
                back[t] = step.argmax(axis=1)
                best = step.max(axis=1) + row[:, t]
                ends = np.where((size[part] == t + 1)[:, None], best, ends)
            now = (ends + self.transitions[:, OUT]).argmax(axis=1)
            for t in range(most - 1, -1, -1):
                live = size[part] > t
                labels[start[part][live] + t] = now[live]
                now = np.where(live, back[t][np.arange(n), now], now)
        return labels


def train(found: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.15, decay: float = 3e-3) -> Field:
    """A field for windows of tokens (windows x tokens x features, windows x tokens), by gradients of the likelihood that the
    forward and backward sums give. Adam."""
    field = Field()
    n, size, k = found.shape
    if not n:
        return field
    flat, y = found.reshape(-1, k), labels.reshape(-1)
    given = np.bincount(labels[:, :-1].ravel() * 3 + labels[:, 1:].ravel(), minlength=9).reshape(3, 3)
    state = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros_like(field.transitions), np.zeros_like(field.transitions)]
    one = np.eye(3, dtype=np.float64)[y]
    for step in range(1, steps + 1):
        score = field.scores(flat).reshape(n, size, 3).astype(np.float64)
        score -= score.max(axis=2, keepdims=True)
        e, t = np.exp(score), np.exp(field.transitions.astype(np.float64))
        forward, backward, scale = np.zeros((size, n, 3)), np.ones((size, n, 3)), np.zeros((size, n, 1))
        for i in range(size):
            a = e[:, i] * (forward[i - 1] @ t if i else 1)
            scale[i] = a.sum(axis=1, keepdims=True)
            forward[i] = a / scale[i]
        for i in range(size - 2, -1, -1):
            backward[i] = ((e[:, i + 1] * backward[i + 1]) @ t.T) / scale[i + 1]
        mass = (forward * backward).transpose(1, 0, 2).reshape(-1, 3)
        mass /= mass.sum(axis=1, keepdims=True)
        pairs = sum(forward[i - 1].T @ (e[:, i] * backward[i] / scale[i]) for i in range(1, size)) * t
        diff = (mass - one) / n
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, c], k), minlength=len(field.weights)) for c in range(3)], axis=1).astype(np.float32)
        grads = (grad + decay * field.weights, ((pairs - given) / n).astype(np.float32))
        for j, (w, g) in enumerate(((field.weights, grads[0]), (field.transitions, grads[1]))):
            a, b = state[2 * j], state[2 * j + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        np.clip(field.transitions, -TRANSITION, TRANSITION, out=field.transitions)
    return field


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_LEADS = ("", "", "", "", "key ", "key: ", "auth=", '"', "id ")


def _value(rng: np.random.Generator) -> str:
    """A made-up secret: letters drawn from one alphabet, some after a short tag."""
    letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
    value = "".join(letters[i] for i in rng.integers(len(letters), size=int(10 + 46 * rng.random() ** 1.7)))
    if rng.random() < 0.3:
        value = "".join(chr(97 + i) for i in rng.integers(26, size=int(rng.integers(2, 5)))) + "_-"[int(rng.integers(2))] + value
    # a run of digits or of small letters alone is a number or a word
    return value if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else _value(rng)


def _anew(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """The text with each secret drawn anew, and where the new ones stand (in characters)."""
    out, places, at, size = [], [], 0, 0
    for start, kind, end in spans:
        if start < at:
            continue
        keep = text[at:start]
        lead = ASSIGN.match(text, start) if kind == 0 else None
        if lead and rng.random() < 0.5:
            keep += text[start : lead.start(2)]
        value = _value(rng)
        places.append((size + len(keep), size + len(keep) + len(value)))
        out += [keep, value]
        size += len(keep) + len(value)
        at = end
    return "".join([*out, text[at:]]), places


def _planted(text: str, rng: np.random.Generator, n: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with ``n`` made-up secrets put between its words, and where they stand."""
    gaps = [m.end() for m in re.finditer(r"\s+", text)]
    if not gaps:
        return text, []
    out, places, at, size = [], [], 0, 0
    for gap in sorted({gaps[i] for i in rng.integers(len(gaps), size=n)}):
        lead, value = _LEADS[rng.integers(len(_LEADS))], _value(rng)
        before = text[at:gap] + lead
        places.append((size + len(before), size + len(before) + len(value)))
        out += [before, value, '" ' if lead == '"' else " "]
        size += len(before) + len(value) + len(out[-1])
        at = gap
    return "".join([*out, text[at:]]), places


def _labelled(text: str, places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a text's tokens."""
    b = np.frombuffer(text.encode(), np.uint8)
    start, end, found = features(b, np.array([0, len(b)]))
    y = np.zeros(len(start), np.int64)
    for a, z in places:
        a, z = len(text[:a].encode()), len(text[:z].encode())
        inside = np.flatnonzero((start >= a) & (end <= z))
        y[inside] = INSIDE
        y[inside[:1]] = BEGIN
    return found, y


def examples(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Training windows from texts: around each secret, and as many from elsewhere. Without a base match there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    found, labels = [], []
    matches = [base_spans(text) for text in texts]
    some = sum(map(bool, matches))
    if not some:
        return np.zeros((0, WINDOW, len(_SIZES)), np.int32), np.zeros((0, WINDOW), np.int64)
    again, put = max(2, MADE_UP // 3 // some), max(1, round(MADE_UP / 2 / len(texts)))
    for text, spans in zip(texts, matches, strict=True):
        secrets = []
        for start, kind, end in spans:
            lead = ASSIGN.match(text, start) if kind == 0 else None
            secrets.append((lead.start(2) if lead else start, end))
        versions = [(text, secrets)]
        versions += [_anew(text, spans, rng) for _ in range(again)] if spans else [_planted(text, rng, put)]
        for t, places in versions:
            f, y = _labelled(t, places)
            if not len(y):
                continue
            centre = np.flatnonzero(y == BEGIN)
            firsts = [max(0, int(c) - int(rng.integers(2, WINDOW - 2))) for c in centre] + [int(rng.integers(0, max(1, len(y) - WINDOW + 1))) for _ in range(2)]
            for i in firsts:
                rows = np.arange(i, i + WINDOW)
                whole = rows < len(y)
                rows = np.minimum(rows, len(y) - 1)
                found.append(f[rows])
                labels.append(np.where(whole, y[rows], OUT))
    return np.stack(found), np.stack(labels)


def _added(field: Field, b: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each text the places (in bytes of the text) of what the field tags."""
    out: list[list] = [[] for _ in range(len(at) - 1)]
    start, end, found = features(b, at)
    text = np.searchsorted(at, start, side="right") - 1
    y = field.viterbi(field.scores(found), np.searchsorted(start, at[:-1]))
    for i in np.flatnonzero(y != OUT):
        own = out[text[i]]
        lo, hi = int(start[i] - at[text[i]]), int(end[i] - at[text[i]])
        if y[i] == INSIDE and own and i and y[i - 1] != OUT and text[i - 1] == text[i]:
            own[-1] = (own[-1][0], hi)
        else:
            own.append((lo, hi))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(texts: pa.Array, field: Field) -> list[tuple[int, int, int, str, str]]:
    """``(n_assign, n_access, n_hex, base_sha256, spans)`` of each text."""
    texts = as_array(texts)
    places: list[list] = [[] for _ in range(len(texts))]
    begun = np.zeros(len(texts), np.int64)
    for rows, b, at in blocks(texts):
        for k, own in enumerate(_added(field, b, at)):
            places[rows[k]] += [(int(begun[rows[k]]) + a, int(begun[rows[k]]) + z) for a, z in own]
        begun[rows] += np.diff(at)
    out = []
    for i, text in enumerate(texts.to_pylist()):
        base = base_spans(text)
        named = [(s, e, KINDS[k]) for s, k, e in base]
        more = []
        if places[i]:
            raw = text.encode()
            step = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if not text.isascii() else None
            for a, z in places[i]:
                if step is not None:
                    a, z = int(step[a]) - 1, int(step[z - 1])
                if z - a >= LEAST and not any(s < z and a < e for s, e, _ in named):
                    more.append((a, z, ADDED))
        every = sorted([*named, *more], key=lambda x: (x[0], [*KINDS, ADDED].index(x[2])))
        counts = [sum(k == j for _, k, _ in base) for j in range(3)]
        out.append((*counts, hashlib.sha256(_joined(named).encode()).hexdigest(), _joined(every)))
    return out


def _scan(field: Field):
    def run(batches):
        for batch in parts(batches):
            n_assign, n_access, n_hex, base, spans = zip(*scan(batch.column("text"), field), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)), pa.array(base), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def learn(documents: DataFrame, sample: int = SAMPLE, around: int = AROUND) -> Field:
    """A field from about ``sample`` different texts with a base match and a third as many without one, drawn by a hash of the text; of each
    ``around`` characters about the first match, or from the start.

    One pass counts the different texts with and without a match; a second keeps those below the rates that follow, so what reaches
    the driver is bounded by the sample.
    """
    keyword = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    hit = F.col("text").rlike(keyword + r"\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|(?-i)[0-9a-f]{24}|AKIA[A-Z0-9]{16}")
    text = documents.where("text is not null").select("text", F.xxhash64("text").alias("rank"))
    # where texts are many a share of the hashes tells how many have a match
    seen = text.select("rank", hit.alias("hit")).groupBy("hit").agg(F.approx_count_distinct("rank").alias("n"))
    n = {r["hit"]: r["n"] for r in seen.collect()}
    rate = {k: min(1.0, 1.3 * most / max(1, n.get(k, 0))) for k, most in ((True, sample), (False, sample // 3))}
    place = F.pmod(F.col("rank"), F.lit(1 << 30)) / (1 << 30)
    drawn = text.where(place < max(rate.values())).withColumn("hit", hit).where(place < F.when(F.col("hit"), rate[True]).otherwise(rate[False]))
    at = F.greatest(F.lit(1), F.regexp_instr("text", F.lit(keyword + "|(?-i)[0-9a-f]{24}|AKIA")) - around // 2)
    cut = F.substring(F.col("text"), F.when(F.col("hit"), at).otherwise(1), F.lit(around))
    rows = sorted((not r["hit"], r["rank"], r["text"]) for r in drawn.select("hit", "rank", cut.alias("text")).dropDuplicates(["rank"]).collect())
    return train(*examples([t for miss, _, t in rows if not miss][:sample] + [t for miss, _, t in rows if miss][: sample // 3]))


def scan_secrets(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row of ``documents`` (doc_id, text; other columns are left
    alone). spans: kind:start:end of all matches and of what the field adds, in code points.

    A null text is empty. Repeated rows each return a row, null doc_ids too. Texts of any length are scanned whole. An empty table gives an
    empty result; without a match to learn from the field adds nothing. What it adds has at least 8 characters and meets no base match.
    """
    field = learn(documents)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(field), schema)
