"""Scores of a hierarchical Pitman-Yor language model.

A text is its words, and one end. The probability of the next token comes from Chinese restaurants on three levels: one for each previous
word (the end stands before a text's first word), whose parent is the restaurant of all tokens, whose parent is a speller. The speller
spells words in bytes and closes them by a space, so unseen words have a probability too: restaurants of the last two symbols, of the last
one and of none share parents in turn, above a uniform choice. A customer of a restaurant who opens a new table is a customer of its parent.

Seatings are sampled by Gibbs: a random customer of a dish is taken out, with the table if nobody else sits there, and seated again given
all the others, at a table of the dish by its size or at a new one by the parent's probability. Dishes move side by side, a random half of
them in each step. Predictive probabilities are averaged over several sweeps. Texts are scored by their averaged probabilities.

Chunks of the corpus send their different pairs of neighbouring words, packed, to parts by a hash of the first word (of a very frequent
one by the second word too), once: a part sums and seats its contexts to tell how many tables the words have, the words are seated and
their probabilities sent back, and the same part seats its contexts given them and answers each chunk. What a chunk asks, and what
it is told, are runs of numbers in the same order. Nothing depends on how documents lie in files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import _FOLDED as FOLDED
from tidemark.llm.text import LOWER, as_array, blocks, mix, raw, segment_hashes, word_spans
from tidemark.session import staged

#: The symbols before, inside and after words, and the end of a text as a symbol.
GAP, END = 0x20, 0x0A
#: Bytes of text in a chunk, for a part of the contexts, and for a part of the words.
CHUNK, PART, WORD_PART = 10 << 20, 4 << 20, 16 << 20
#: Strength of all restaurants; steps of a sweep; sweeps before the averaged ones, and those.
STRENGTH, STEPS, BURN, AVERAGED = 0.5, 6, 2, 3
_WORD = np.uint64(1 << 63)
#: The end as a token, and before the first word of a text.
END_WORD = _WORD
#: Words that follow one word are dealt to several parts if it occurs more often than this, and makes up more than the share below; there
#: are no more such words than its inverse.
FREQUENT, SHARE = 1_000_000, 1 / (1 << 17)


def tokens(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
    """``(row, previous token, token, bytes, start, end)`` of all tokens, block by block; a word is a hash with the top bit set. The ends of
    all texts come last, without bytes."""
    column = as_array(column)
    last = np.full(len(column), END_WORD, np.uint64)
    for rows, b, at in blocks(column):
        start, end = word_spans(b, at)
        if not len(start):
            continue
        h = segment_hashes(b, start, end, FOLDED) | _WORD
        edge = np.searchsorted(start, at)
        n = np.diff(edge)
        some = np.flatnonzero(n)
        before = np.empty_like(h)
        before[1:] = h[:-1]
        # a text that goes on from the block before has its last word there
        before[edge[some]] = last[rows[some]]
        last[rows[some]] = h[edge[some + 1] - 1]
        yield np.repeat(rows, n), before, h, b, start, end
    none = np.zeros(len(column), np.int64)
    yield np.arange(len(column)), last, np.full(len(column), END_WORD, np.uint64), None, none, none


def _chunks(batches):
    """Rows ``(chunk, packed, size)``: the documents as compressed Arrow, in chunks of about ``CHUNK`` bytes of text."""
    held, size = [], 0
    press = zstandard.ZstdCompressor(level=1)

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        packed = press.compress(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([packed], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "packed", "size"])

    for batch in batches:
        at = 0
        while at < len(batch):
            ends = np.cumsum(np.diff(raw(as_array(batch.column("text").slice(at)))[1]))
            take = max(1, int(np.searchsorted(ends, CHUNK - size, side="right")))
            part = batch.slice(at, take)
            held.append(part)
            size += int(ends[min(take, len(ends)) - 1])
            at += take
            if size >= CHUNK or at < len(batch):
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _opened(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _numbers(packed: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def short(word: np.ndarray) -> np.ndarray:
    """40 bits that tell words apart in the model's seatings (counts of words go by all 64)."""
    return word >> np.uint64(24)


def _bytes5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from5(b: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8, 5 * n, at).reshape(n, 5)
    return out.view(np.uint64).ravel()


#: Answers are told in steps of this part of a power of ten.
STEP = 2048


def _told(logs: np.ndarray) -> bytes:
    """Log10 probabilities in two bytes each; of those that do not fit, which words of hundreds of letters have, four bytes more."""
    q = np.round(-logs * STEP)
    far = q >= 0xFFFF
    return np.where(far, 0xFFFF, q).astype(np.uint16).tobytes() + logs[far].astype(np.float32).tobytes()


def _heard(data: bytes, n: int) -> np.ndarray:
    q = np.frombuffer(data, np.uint16, n)
    out = q / -STEP
    out[q == 0xFFFF] = np.frombuffer(data, np.float32, offset=2 * n)
    return out


# -- restaurants ---------------------------------------------------------------------------------------------------------------------


def discount_of(counts: np.ndarray) -> float:
    """The usual estimate from how many dishes have one customer and two."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5


class Rooms:
    """Restaurants side by side: of each dish the room that serves it and its customers.

    ``grown``: of each room how many times more customers (and by that tables) it has elsewhere and here than here alone.
    """

    def __init__(self, room: np.ndarray, customers: np.ndarray, parent: np.ndarray, rng: np.random.Generator, sweeps: int, grown: np.ndarray | None = None, discount: float | None = None):
        n = self.n = customers.astype(np.int64)
        self.room, self.rng, self.d = room, rng, discount_of(n) if discount is None else discount
        self.size_of = int(room.max(initial=-1)) + 1
        self.grown = np.ones(self.size_of) if grown is None else grown
        self.sitting = (np.bincount(room, n, self.size_of) * self.grown)[room]
        # the first seating has about the expected number of tables
        a = (STRENGTH + self.d * (np.bincount(room, n > 0, self.size_of) * self.grown)[room]) * parent
        self.t = np.where(n > 0, np.minimum(n, 1 + np.floor(a * np.log1p(np.maximum(n - 1, 0) / (a + 1)) + rng.random(len(n)))), 0).astype(np.int64)
        # of each dish with two customers or more the sizes of its tables, those in use first
        self.live = np.flatnonzero(n > 1)
        room_for = np.minimum(n[self.live], self.t[self.live] + sweeps * STEPS)
        self.start = np.cumsum(room_for) - room_for
        self.size = np.zeros(int(room_for.sum()), np.int64)
        more = self.t[self.live] - 1
        self.size[self.start] = n[self.live] - more
        self.size[np.arange(int(more.sum())) + np.repeat(self.start + 1 - (np.cumsum(more) - more), more)] = 1

    def opened(self) -> np.ndarray:
        """The tables of each dish's room."""
        return (np.bincount(self.room, self.t, self.size_of) * self.grown)[self.room]

    def sweep(self, parent: np.ndarray) -> None:
        size, d = self.size, self.d
        for _ in range(STEPS):
            pick = np.flatnonzero(self.rng.random(len(self.live)) < 0.5)
            dish, start = self.live[pick], self.start[pick]
            if not len(dish):
                return
            # a customer, and so the table at which the customer sits
            up_to = np.cumsum(size)
            at = np.searchsorted(up_to, up_to[start] - size[start] + np.floor(self.rng.random(len(dish)) * self.n[dish]).astype(np.int64), side="right")
            size[at] -= 1
            gone = size[at] == 0
            last = start + self.t[dish] - 1
            size[at[gone]] = size[last[gone]]
            size[last[gone]] = 0
            self.t[dish] -= gone
            new = (STRENGTH + d * self.opened()[dish]) * parent[dish]
            old = self.n[dish] - 1 - d * self.t[dish]
            opens = self.rng.random(len(dish)) * (new + old) < new
            weight = np.maximum(size - d, 0)
            up_to = np.cumsum(weight)
            stays = ~opens
            target = up_to[start[stays]] - weight[start[stays]] + self.rng.random(int(stays.sum())) * old[stays]
            to = np.clip(np.searchsorted(up_to, target, side="right"), start[stays], start[stays] + self.t[dish[stays]] - 1)
            size[to] += 1
            size[start[opens] + self.t[dish[opens]]] = 1
            self.t[dish] += opens

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each dish what its own customers give it in its room, and the part of its probability in the parent that comes on top."""
        own = np.maximum(self.n - self.d * self.t, 0)
        some = self.sitting > 0
        return np.where(some, own / (STRENGTH + self.sitting), 0.0), np.where(some, (STRENGTH + self.d * self.opened()) / (STRENGTH + self.sitting), 1.0)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """The probability of each dish in its room."""
        own, rest = self.split()
        return own + rest * parent

    def averaged(self, parent: np.ndarray, log_parent: np.ndarray) -> np.ndarray:
        """The log10 of each dish's probability, averaged over the sweeps after the first ones. ``parent`` may be 0 where its logarithm, far below
        what a number can hold, is not: a dish without customers adds logarithms."""
        own, rest = np.zeros(len(self.n)), np.zeros(len(self.n))
        for k in range(BURN + AVERAGED):
            self.sweep(parent)
            if k >= BURN:
                a, b = self.split()
                own += a / AVERAGED
                rest += b / AVERAGED
        out = np.log10(rest) + log_parent
        seen = own > 0
        out[seen] = np.log10(own[seen] + rest[seen] * parent[seen])
        return out


# -- the speller ---------------------------------------------------------------------------------------------------------------------


def spelled(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, keys of each word)``: for each symbol of a word and the space that closes it the two symbols before and itself, three bytes of a
    number. Before a word there are spaces."""
    lens = end - start
    place = np.cumsum(lens + 3) - (lens + 1)
    out = np.full(int((lens + 3).sum()), GAP, np.uint8)
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[step + np.repeat(place, lens)] = LOWER[b[step + np.repeat(start, lens)]]
    long = out.astype(np.uint32)
    keys = long[2:] | long[1:-1] << np.uint32(8) | long[:-2] << np.uint32(16)
    size = lens + 1
    return keys[np.arange(int(size.sum())) + np.repeat(place - 2 - (np.cumsum(size) - size), size)], size


def spell(letters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``spelled`` for a list of words; one without letters is the end, a symbol of its own."""
    size = np.array([len(x) for x in letters], np.int64)
    start = np.cumsum(size) - size
    keys, n = spelled(np.frombuffer(b"".join(letters), np.uint8), start, start + size)
    keys = keys.astype(np.int64)
    keys[(np.cumsum(n) - n)[size == 0]] = GAP << 16 | GAP << 8 | END
    return keys, n


class Speller:
    """Probabilities of a symbol after two others. Its tables have no more than 2 ** 24 cells, whatever the corpus."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sweeps: int = 4):
        rng = np.random.default_rng(len(keys))
        order = np.argsort(keys)
        levels, ups = [(keys[order].astype(np.int64), counts[order].astype(np.int64))], []
        for bits in (16, 8):
            higher, up = np.unique(levels[-1][0] & ((1 << bits) - 1), return_inverse=True)
            levels.append((higher, None))
            ups.append(up)
        customers = levels[0][1]
        values = [np.full(len(dish), 1 / 256) for dish, _ in levels]
        self.rest = [np.ones(1 << 16), np.ones(1 << 8), np.ones(1)]
        for _ in range(sweeps):
            rooms = []
            customers = levels[0][1]
            for k, (dish, _) in enumerate(levels):
                names, room = np.unique(dish >> 8, return_inverse=True)
                parent = values[k + 1][ups[k]] if k < 2 else np.full(len(dish), 1 / 256)
                rooms.append((Rooms(room, customers, parent, rng, 1), names))
                rooms[k][0].sweep(parent)
                if k < 2:
                    customers = np.bincount(ups[k], rooms[k][0].t, len(levels[k + 1][0]))
            for k in (2, 1, 0):
                r, names = rooms[k]
                parent = values[k + 1][ups[k]] if k < 2 else np.full(len(r.n), 1 / 256)
                values[k] = r.predictive(parent)
                first = np.unique(r.room, return_index=True)[1]
                self.rest[k][names] = ((STRENGTH + r.d * r.opened()) / (STRENGTH + r.sitting))[first]
        self.known, self.value = levels[0][0], values[0]
        none = np.full(256, self.rest[2][0] / 256)
        none[levels[2][0]] = values[2]
        self.one = (self.rest[1][:, None] * none[None, :]).ravel()
        self.one[levels[1][0]] = values[1]

    def log10(self, letters: list[bytes]) -> np.ndarray:
        """The log10 probability of each word; without letters that of the end."""
        keys, n = spell(letters)
        p = self.rest[0][keys >> 8] * self.one[keys & 0xFFFF]
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            p = np.where(self.known[place] == keys, self.value[place], p)
        return np.add.reduceat(np.log10(p), np.cumsum(n) - n) if len(n) else np.zeros(0)


# -- what chunks ask -----------------------------------------------------------------------------------------------------------------


def _chunk_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in list(zip(*tokens(table.column("text")), strict=True))[:3])


def word_part(word40: np.ndarray, parts: int) -> np.ndarray:
    return (mix(word40) % np.uint64(parts)).astype(np.int64)


def pair_part(before: np.ndarray, word40: np.ndarray, parts: int, frequent: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The part of each pair: by the word before, of a frequent one by a hash of the word too."""
    salt = np.zeros(len(before), np.uint64)
    names, counts, each = frequent
    if len(names):
        place = np.minimum(np.searchsorted(names, before), len(names) - 1)
        split = np.where(names[place] == before, counts[place] // each + 1, 1).astype(np.uint64)
        salt = mix(word40 + np.uint64(99)) % split
    return (mix(mix(before) + salt) % np.uint64(parts)).astype(np.int64)


class Asked:
    """The different pairs of a chunk by part, then by first and second word; ``of``: the pair of each token."""

    def __init__(self, table: pa.Table, parts: int, frequent: tuple[np.ndarray, np.ndarray, int]):
        self.rows, before, word = _chunk_tokens(table)
        self.rows = self.rows.astype(np.int32)
        word40 = short(word)
        part = pair_part(before, word40, parts, frequent).astype(np.int32)
        order = np.lexsort((word40, before, part))
        b, w = before[order], word40[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1]))) if len(b) else np.zeros(0, bool)
        self.of = np.empty(len(b), np.int32)
        self.of[order] = np.cumsum(new) - 1
        self.before, self.word, self.part = b[new], w[new], part[order][new]
        self.words = word


def _packed_pairs(before: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    first = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    lens = np.diff(np.append(first, len(before)))
    return np.array([len(first), len(word)], np.uint32).tobytes() + before[first].tobytes() + _bytes5(word) + _press(lens.astype(np.uint32), n.astype(np.uint32))


def _unpacked_pairs(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, n = (int(x) for x in np.frombuffer(b, np.uint32, 2))
    names = np.frombuffer(b, np.uint64, contexts, 8)
    rest = _numbers(b[8 + 8 * contexts + 5 * n :])
    return np.repeat(names, rest[:contexts]), _from5(b, 8 + 8 * contexts, n), rest[contexts:].astype(np.int64)


def _pairs(parts: int, frequent: tuple[np.ndarray, np.ndarray, int]):
    """Rows ``(part, chunk, data)``: the pairs of a chunk in a part, and how often its training texts have each."""

    def run(batches):
        for chunk, table in _opened_all(batches):
            a = Asked(table, parts, frequent)
            seen = ~table.column("held_out").to_numpy().astype(bool)
            n = np.bincount(a.of, seen[a.rows], len(a.part)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], a.part[1:] != a.part[:-1], [True])))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                data = _packed_pairs(a.before[i:j], a.word[i:j], n[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(a.part[i : i + 1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["part", "chunk", "data"])

    return run


def _opened_all(batches) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.column("chunk")[i].as_py(), _opened(batch.column("packed")[i].as_py())


def _vocabulary(parts: int):
    """Rows ``(wpart, chunk, counts, letters)``: of the different words of a chunk in a part of the words, in the order of their hashes, how often
    its training texts have each, and their letters in lower case (the end has none)."""

    def run(batches):
        for chunk, table in _opened_all(batches):
            seen = ~table.column("held_out").to_numpy().astype(bool)
            words, letters, all_words, all_n = np.zeros(0, np.uint64), [], [], []
            for rows, _, h, b, start, end in tokens(table.column("text")):
                u, one, inverse = np.unique(h, return_index=True, return_inverse=True)
                all_words.append(u)
                all_n.append(np.bincount(inverse, seen[rows], len(u)).astype(np.int64))
                new = ~np.isin(u, words, assume_unique=True)
                low = b"" if b is None else LOWER[b].tobytes()
                letters += [low[i:j] for i, j in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
                words = np.concatenate((words, u[new]))
            order = np.argsort(words)
            u, inverse = np.unique(np.concatenate(all_words), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(all_n)).astype(np.uint32)
            place = word_part(short(u), parts)
            for k in np.unique(place):
                own = np.flatnonzero(place == k)
                text = _press(np.frombuffer(b"\n".join(letters[order[i]] for i in own), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), pa.array([_press(n[own])], pa.binary()), pa.array([text], pa.binary())], names=["wpart", "chunk", "counts", "letters"])

    return run


# -- levels --------------------------------------------------------------------------------------------------------------------------


def _hashes(text: bytes) -> np.ndarray:
    """The hashes of words with line feeds between."""
    b = np.frombuffer(text, np.uint8)
    feed = np.flatnonzero(b == 10)
    start, end = np.concatenate(([0], feed + 1)), np.append(feed, len(b))
    return np.where(end > start, segment_hashes(b, start, end, FOLDED) | _WORD, END_WORD)


def _words(table: pa.Table) -> pa.Table:
    """Of a part of the words: one row that sums up all chunks (chunk null), and for each chunk the counts of its words over the corpus."""
    chunks = table.column("chunk").to_pylist()
    words = [_hashes(zstandard.ZstdDecompressor().decompress(x.as_py())) for x in table.column("letters")]
    u, one, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.concatenate([_numbers(x.as_py()) for x in table.column("counts")])).astype(np.int64)
    at = np.cumsum([0, *(len(w) for w in words)])
    letters: list[bytes] = [b""] * len(u)
    owner = np.searchsorted(at, one, side="right") - 1
    for k in np.unique(owner):
        text = zstandard.ZstdDecompressor().decompress(table.column("letters")[int(k)].as_py()).split(b"\n")
        for i in np.flatnonzero(owner == k):
            letters[i] = text[one[i] - at[k]]
    wpart = table.column("wpart")[0].as_py()
    answers = [_press(np.minimum(n[inverse[i:j]], 0xFFFFFFFF).astype(np.uint32)) for i, j in zip(at[:-1], at[1:], strict=True)]
    none = [None] * len(chunks)
    return pa.table(
        {
            "wpart": pa.array([wpart] * (len(chunks) + 1), pa.int32()), "chunk": pa.array([None, *chunks], pa.int64()), "words": pa.array([u.tobytes(), *none], pa.binary()), "counts": pa.array([_press(n), *answers], pa.binary()),
            "letters": pa.array([_press(np.frombuffer(b"\n".join(letters), np.uint8)), *none], pa.binary()), "total": pa.array([int(n.sum()), *none], pa.int64()), "known": pa.array([int((n > 0).sum()), *none], pa.int64()),
        }
    )


_WORDS = "wpart int, chunk long, words binary, counts binary, letters binary, total long, known long"


def _state(words: bytes, counts: bytes, letters: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.frombuffer(words, np.uint64), _numbers(counts, np.int64), zstandard.ZstdDecompressor().decompress(letters).split(b"\n")


def _frequent(least: float):
    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = _numbers(counts, np.int64)
                often = n > least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)[often]), pa.array(n[often])], names=["word", "n"])

    return run


def _cells(speller: Speller | None):
    """Rows ``(key, n)``: the symbols of the words after two others. Each training word counts once; or, given a first speller, by the
    tables that its tokens open."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("words", "counts", "letters")), strict=True):
                words, n, letters = _state(*row)
                weight = (n > 0).astype(np.int64)
                if speller is not None and len(n):
                    parent = 10.0 ** speller.log10(letters)
                    rooms = Rooms(np.zeros(len(n), np.int64), n, parent, np.random.default_rng(int(words[0] >> np.uint64(32))), BURN)
                    for _ in range(BURN):
                        rooms.sweep(parent)
                    weight = rooms.t
                keys, size = spell(letters)
                u, inverse = np.unique(keys, return_inverse=True)
                total = np.bincount(inverse, np.repeat(weight, size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u[total > 0], pa.int64()), pa.array(total[total > 0], pa.int64())], names=["key", "n"])

    return run


def _speller(state: DataFrame, first: Speller | None) -> Speller:
    cells = state.select("words", "counts", "letters").mapInArrow(_cells(first), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return Speller(cells["key"].to_numpy(np.int64), cells["n"].to_numpy(np.int64))


class _Part:
    """The pairs of a part, of all chunks, by first and second word; ``of``: those of each row's pairs."""

    def __init__(self, table: pa.Table):
        asked = [_unpacked_pairs(x.as_py()) for x in table.column("data")]
        before, word, n = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((word, before))
        b, w = before[order], word[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1]))) if len(b) else np.zeros(0, bool)
        place = np.empty(len(b), np.int64)
        place[order] = np.cumsum(new) - 1
        self.of = np.split(place, np.cumsum([len(x[1]) for x in asked])[:-1]) if asked else []
        self.before, self.word = b[new], w[new]
        self.n = np.bincount(place, n, len(self.before)).astype(np.int64)
        self.room = np.cumsum(np.concatenate(([0], self.before[1:] != self.before[:-1]))) if len(self.before) else np.zeros(0, np.int64)
        self.words, self.word_of = np.unique(self.word, return_inverse=True)
        self.seed = int(self.before[0] >> np.uint64(32)) if len(b) else 0

    def grown(self, frequent: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        """Of each room how many times more customers it has in all its parts."""
        out = np.ones(int(self.room.max(initial=-1)) + 1)
        names, counts, each = frequent
        if len(names) and len(out):
            rooms = self.before[np.unique(self.room, return_index=True)[1]]
            place = np.minimum(np.searchsorted(names, rooms), len(names) - 1)
            here = np.bincount(self.room, self.n)
            split = (names[place] == rooms) & (counts[place] >= each) & (here > 0)
            out[split] = np.maximum(counts[place][split] / here[split], 1)
        return out


def _first_seating(word_parts: int, frequent: tuple[np.ndarray, np.ndarray, int]):
    """Rows ``(wpart, part, words, tables, total)``: how many tables a part's contexts open for each word, when its own share of the words
    stands for the parent; one row for every part of the words."""

    def run(table: pa.Table) -> pa.Table:
        p = _Part(table)
        share = np.bincount(p.word_of, p.n, len(p.words)) + 0.5
        parent = (share / share.sum())[p.word_of] if len(p.words) else np.zeros(0)
        rooms = Rooms(p.room, p.n, parent, np.random.default_rng(p.seed), BURN, p.grown(frequent))
        for _ in range(BURN):
            rooms.sweep(parent)
        tables = np.bincount(p.word_of, rooms.t, len(p.words)).astype(np.uint32)
        place, part = word_part(p.words, word_parts), table.column("part")[0].as_py()
        own = [np.flatnonzero(place == k) for k in range(word_parts)]
        return pa.table({"wpart": pa.array(range(word_parts), pa.int32()), "part": pa.array([part] * word_parts, pa.int32()), "words": pa.array([_bytes5(p.words[i]) for i in own], pa.binary()), "tables": pa.array([_press(tables[i]) for i in own], pa.binary()), "total": pa.array([int(tables.sum())] * word_parts, pa.int64())})

    return run


def _seated_words(speller: Speller):
    """Rows ``(part, wpart, p)``: the averaged log10 probabilities of the words that a part asked for, in its order."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        if not len(asked) or not len(state):
            return pa.table({"part": pa.array([], pa.int32()), "wpart": pa.array([], pa.int32()), "p": pa.array([], pa.binary())})
        words, _, letters = _state(*(state.column(c)[0].as_py() for c in ("words", "counts", "letters")))
        u, one = np.unique(short(words), return_index=True)
        spelt = speller.log10([letters[i] for i in one])
        lists = [_from5(x.as_py(), 0, len(x.as_py()) // 5) for x in asked.column("words")]
        places = [np.searchsorted(u, x) for x in lists]
        customers = np.zeros(len(u), np.int64)
        for place, tables in zip(places, asked.column("tables"), strict=True):
            customers[place] += _numbers(tables.as_py())
        total, here = sum(asked.column("total").to_pylist()), int(customers.sum())
        parent = 10.0**spelt
        rooms = Rooms(np.zeros(len(u), np.int64), customers, parent, np.random.default_rng(int(u[0]) & 0xFFFFFFFF), BURN + AVERAGED, np.array([total / max(here, 1)]))
        p = rooms.averaged(parent, spelt)
        wpart = state.column("wpart")[0].as_py()
        return pa.table({"part": asked.column("part").cast(pa.int32()), "wpart": pa.array([wpart] * len(lists), pa.int32()), "p": pa.array([p[place].astype(np.float32).tobytes() for place in places], pa.binary())})

    return run


def _answers(word_parts: int, frequent: tuple[np.ndarray, np.ndarray, int]):
    """Rows ``(chunk, part, data)``: the averaged log10 probabilities of a chunk's pairs in a part, in its order."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        p = _Part(asked)
        above, place = np.zeros(len(p.words)), word_part(p.words, word_parts)
        for k, values in zip(words.column("wpart").to_pylist(), words.column("p").to_pylist(), strict=True):
            above[place == k] = np.frombuffer(values, np.float32)
        log_parent = above[p.word_of]
        parent = 10.0**log_parent
        rooms = Rooms(p.room, p.n, parent, np.random.default_rng(p.seed + 1), BURN + AVERAGED, p.grown(frequent))
        value = rooms.averaged(parent, log_parent)
        return pa.table({"chunk": asked.column("chunk").cast(pa.int64()), "part": asked.column("part").cast(pa.int32()), "data": pa.array([_told(value[i]) for i in p.of], pa.binary())})

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(parts: int, word_parts: int, frequent: tuple[np.ndarray, np.ndarray, int], total: int, distinct: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for packed in chunks.column("packed").to_pylist():
            table = _opened(packed)
            n = len(table)
            a = Asked(table, parts, frequent)
            value = np.zeros(len(a.part))
            words, word_of = np.unique(a.words, return_inverse=True)
            count, wpart = np.zeros(len(words)), word_part(short(words), word_parts)
            for is_word, k, data in zip(*(told.column(c).to_pylist() for c in ("is_word", "part", "data")), strict=True):
                if is_word:
                    count[wpart == k] = _numbers(data)
                else:
                    i, j = np.searchsorted(a.part, [k, k + 1])
                    value[i:j] = _heard(data, j - i)
            base = np.log10(count + 0.1) - np.log10(total + 0.1 * (distinct + 1))
            sums = [np.bincount(a.rows, x, n) for x in (np.ones(len(a.rows)), count[word_of] > 0, base[word_of], value[a.of])]
            out.append(pa.table([table.column("doc_id"), table.column("held_out"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, total)), pa.array(sums[2]), pa.array(sums[3])], names=[x.split()[0] for x in _SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``documents`` (doc_id, text; other
    columns are left alone). A text's perplexity a token is ``10 ** (-score / n_tokens)``.

    Learned from rows whose crc32(doc_id) mod 10 is not 0. A null text is empty: one end. Repeated rows each return a row and are
    learned from each; a null doc_id counts as not held out. Texts of any length are read whole. An empty table gives an empty
    result.
    """
    spark = documents.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 10 == 0, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = staged(docs.mapInArrow(_chunks, "chunk long, packed binary, size long"), "chunks")
    size = chunks.agg(F.sum("size")).first()[0]
    if size is None:
        return spark.createDataFrame([], _SCORES)
    parts, word_parts = max(1, -(-size // PART)), max(1, -(-size // WORD_PART))
    packed = chunks.select("chunk", "packed")

    words = packed.mapInArrow(_vocabulary(word_parts), "wpart int, chunk long, counts binary, letters binary")
    words = staged(words.groupBy("wpart").applyInArrow(_words, _WORDS), "words")
    state = words.where("chunk is null")
    total, distinct = (int(x) for x in state.agg(F.sum("total"), F.sum("known")).first())
    often = state.select("words", "counts").mapInArrow(_frequent(max(FREQUENT, SHARE * total)), "word long, n long").orderBy("word").toPandas()
    names = often["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    frequent = (names[order], often["n"].to_numpy(np.int64)[order], FREQUENT)
    speller = _speller(state, _speller(state, None))

    # one plan, so that the pairs are shuffled once and both seatings read them
    asked = packed.mapInArrow(_pairs(parts, frequent), "part int, chunk long, data binary")
    tables = asked.groupBy("part").applyInArrow(_first_seating(word_parts, frequent), "wpart int, part int, words binary, tables binary, total long")
    above = tables.groupBy("wpart").cogroup(state.select("wpart", "words", "counts", "letters").groupBy("wpart")).applyInArrow(_seated_words(speller), "part int, wpart int, p binary")
    told = asked.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_answers(word_parts, frequent), "chunk long, part int, data binary")
    told = told.select("chunk", F.lit(False).alias("is_word"), "part", "data")
    counts = words.where("chunk is not null").select("chunk", F.lit(True).alias("is_word"), F.col("wpart").alias("part"), F.col("counts").alias("data"))
    return packed.groupBy("chunk").cogroup(told.unionByName(counts).groupBy("chunk")).applyInArrow(_scored(parts, word_parts, frequent, total, distinct), _SCORES)
