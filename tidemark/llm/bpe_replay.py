"""Byte-level BPE by replaying merges over all words of a part of the corpus at once.

A task takes the distinct words (matches of the tokenizer's pattern) of megabytes of text together. Their bytes lie end to end, each
place knowing its neighbours, and an inverted index leads from a mergeable pair, named by the rank of what it becomes, to the places where
it stands. Ranks are taken in order, each merge rewrites its places and looks again only at the two pairs that touch them. Every distinct
word is merged once while a task remembers it, whatever number of documents have it, so texts are only put together from known words; nothing is
shuffled, and a task that is lost runs again by itself.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SPACE, parts
from tidemark.llm.tokens import _SAFE, Encoder

#: Bytes of text in a slice, about; a longer text is a slice of its own.
SLICE = 8 << 20
#: Bytes of words that are merged together, about; a longer word is merged by itself.
TOGETHER = 1 << 20
#: Places of a pair from which on they are merged by array operations.
MANY = 12
_ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """The ranks of a vocabulary: what each pair of tokens becomes, and each token's bytes."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank = tokens
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        # all ways to put a token together from two others
        self.pairs = {(tokens[t[:k]] << 32) | tokens[t[k:]]: i for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
        self._keys = np.array(sorted(self.pairs), np.int64)
        self._made = np.array([self.pairs[k] for k in self._keys.tolist()], np.int32)
        self._first = np.full((256, 256), -1, np.int32)
        for t, i in tokens.items():
            if len(t) == 2:
                self._first[t[0], t[1]] = i
        by_id = sorted((i, t) for t, i in tokens.items())
        self._bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self._width, self._begin = np.zeros(by_id[-1][0] + 1, np.int64), np.zeros(by_id[-1][0] + 1, np.int64)
        where = np.array([i for i, _ in by_id])
        self._width[where] = [len(t) for _, t in by_id]
        self._begin[where] = np.cumsum(self._width[where]) - self._width[where]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        width = self._width[ids]
        ends = np.cumsum(width)
        return self._bytes[np.repeat(self._begin[ids] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, size)``: the tokens of all words end to end, and how many each word has. No word is empty.

        Of one rank the leftmost place of a word is merged first; a merge that makes a pair of a lower rank is followed by that pair,
        so each word sees the order in which it would be merged alone.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        n = len(raw)
        step = np.arange(n, dtype=np.int64)
        after, before = step + 1, step - 1
        after[end - 1], before[end - length] = -1, -1
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self._first[raw[:-1], raw[1:]]
        rank[end - 1] = -1
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        found, first = np.unique(rank[order], return_index=True)
        index = {r: x.tolist() for r, x in zip(found.tolist(), np.split(order, first[1:]), strict=True)} if len(found) else {}
        heap = list(index)
        heapify(heap)
        # the same memory as arrays for many places at once, and as arrays of Python for few
        tok, nxt, prev, rank, gone = (array(kind, x.tobytes()) for kind, x in (("i", self.byte[raw]), ("q", after), ("q", before), ("i", rank), ("b", np.zeros(n, np.int8))))
        views = (*(np.frombuffer(x, kind) for x, kind in ((tok, np.int32), (nxt, np.int64), (prev, np.int64), (rank, np.int32), (gone, np.int8))), np.repeat(np.arange(len(words)), length))
        become = self.pairs.get

        def add(new: int, place: int) -> None:
            if new in index:
                index[new].append(place)
            else:
                index[new] = [place]
                heappush(heap, new)

        while heap:
            r = heappop(heap)
            places = index.pop(r)
            if len(places) > MANY:
                self._merge_many(r, places, index, heap, *views)
                continue
            places.sort()
            for k, p in enumerate(places):
                if rank[p] != r:
                    continue
                q, o = nxt[p], prev[p]
                tok[p], rank[q], gone[q] = r, -1, 1
                nxt[p] = s = nxt[q]
                right = left = -1
                if s >= 0:
                    prev[s] = p
                    right = become((r << 32) | tok[s], -1)
                    if right >= 0:
                        add(right, p)
                rank[p] = right
                if o >= 0:
                    rank[o] = left = become((tok[o] << 32) | r, -1)
                    if left >= 0:
                        add(left, o)
                if 0 <= right < r or 0 <= left < r:
                    index[r] = places[k + 1 :]
                    heappush(heap, r)
                    break
        stay = np.frombuffer(gone, np.uint8) == 0
        return np.frombuffer(tok, np.int32)[stay].astype(np.uint32), np.add.reduceat(stay, end - length, dtype=np.int64) if len(words) else length

    def _merge_many(self, r: int, places: list[int], index: dict[int, list[int]], heap: list[int], tok, nxt, prev, rank, gone, word) -> None:
        """The leftmost place of rank ``r`` in each word, all words at once; the other places wait for the next turn of the rank."""
        p = np.sort(np.array(places))
        p = p[rank[p] == r]
        leftmost = np.ones(len(p), bool)
        leftmost[1:] = word[p[1:]] != word[p[:-1]]
        if not leftmost.all():
            index[r] = p[~leftmost].tolist()
            heappush(heap, r)
            p = p[leftmost]
        q, o = nxt[p], prev[p]
        s = nxt[q]
        tok[p], rank[q], gone[q], rank[p], nxt[p] = r, -1, 1, -1, s
        right, left = s >= 0, o >= 0
        prev[s[right]] = p[right]
        at = np.concatenate((p[right], o[left]))
        new = self._become(np.concatenate((np.full(right.sum(), r), tok[o[left]])), np.concatenate((tok[s[right]], np.full(left.sum(), r))))
        rank[at] = new
        at, new = at[new >= 0], new[new >= 0]
        order = np.argsort(new, kind="stable")
        at, new = at[order], new[order]
        edge = [0, *(np.flatnonzero(np.diff(new)) + 1).tolist(), len(new)] if len(new) else [0]
        for x, a, b in zip(new[edge[:-1]].tolist(), edge[:-1], edge[1:], strict=True):
            if x in index:
                index[x].extend(at[a:b].tolist())
            else:
                index[x] = at[a:b].tolist()
                heappush(heap, x)

    def _become(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._made[at], -1)


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a file of ranks: in each line the token in base 64, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def class_differences() -> dict[int, str]:
    """Characters that tiktoken's regular expressions take for other than a letter, number or white space where ``regex`` takes them for one (their
    editions of Unicode differ), or the other way round: each with a character of its right class."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind, like in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)).decode())
        own = set(regex.findall(kind, every))
        out |= {ord(c): "+" for c in own - theirs if ord(c) not in out} | {ord(c): like for c in theirs - own}
    return out


class ReplayEncoder(Encoder):
    """Encodes columns of texts: new words of a block are replayed together, known ones are looked up."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN

        self.merges = Merges(ranks_of(path))
        self._match = regex.compile(PATTERN).findall
        self._moved = class_differences()
        self._forget()

    def _words(self, text: str) -> list[bytes]:
        if text.isascii() or self._moved.keys().isdisjoint(map(ord, set(text))):
            return [w.encode() for w in self._match(text)]
        end = np.cumsum([len(w) for w in self._match(text.translate(self._moved))]).tolist()
        return [text[a:b].encode() for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words end to end, and how many each has; a word that is a token is that token, as in the library, however
        its merges would go."""
        known = np.array([self.merges.rank.get(w, -1) for w in words], np.int64)
        left = [w for w, r in zip(words, known.tolist(), strict=True) if r < 0]
        end = np.cumsum([len(w) for w in left])
        cut = (np.flatnonzero(np.diff(end // TOGETHER)) + 1).tolist()
        done = [self.merges.replay(left[a:b]) for a, b in zip([0, *cut], [*cut, len(left)], strict=True) if b > a]
        size = np.ones(len(words), np.int64)
        size[known < 0] = np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])
        ids = np.repeat(known, size).astype(np.uint32)
        ids[np.repeat(known < 0, size)] = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in done)])
        return ids, size

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        # pieces that begin with white space and end safely are matched end to end, and told apart by their bytes
        apart = np.array([not (SPACE[p[0]] and _SAFE[p[-1]]) for p in pieces])
        order = np.concatenate((np.flatnonzero(apart), np.flatnonzero(~apart)))
        single, rest = order[: int(apart.sum())], order[int(apart.sum()) :]
        words = [w for i in single for w in self._words(pieces[i].decode())]
        for part in np.array_split(rest, 1 + len(rest) // 4096):
            words += self._words(b"".join(pieces[i] for i in part).decode())
        number: dict[bytes, int] = {}
        word = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        ids, size = self._merged(list(number))
        begin = np.cumsum(size) - size
        n = size[word]
        ends = np.cumsum(n)
        flat = ids[np.repeat(begin[word] - (ends - n), n) + np.arange(ends[-1])]
        # a piece ends where the bytes of its words do
        last = np.searchsorted(np.cumsum([len(w) for w in words]), np.cumsum([len(pieces[i]) for i in order]))
        upto = ends[last]
        back = np.argsort(order)
        at, size = (len(self._ids) + np.concatenate(([0], upto[:-1])))[back], np.diff(upto, prepend=0)[back]
        self._ids = np.concatenate((self._ids, flat))
        place = np.searchsorted(self._known, hashes)
        self._known, self._at, self._size = np.insert(self._known, place, hashes), np.insert(self._at, place, at), np.insert(self._size, place, size)


_KEPT: dict[str, ReplayEncoder] = {}


def replay_encoder(file: str) -> ReplayEncoder:
    """The encoder for a file of ranks among the public tokenizers (a bare name) or any path, kept by the worker."""
    if file not in _KEPT:
        path = file
        if os.sep not in file:
            import public_tokenizers

            path = public_tokenizers.path(file)
        _KEPT[file] = ReplayEncoder(path)
    return _KEPT[file]


def _digests(file: str):
    def run(batches):
        coder = replay_encoder(file)
        for batch in parts(batches, SLICE):
            ids, at = coder.encode(batch.column("text"))
            told, decoded = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = ids[a:b]
                told.append(hashlib.sha256(own.astype("<u4").data).hexdigest())
                text = hashlib.sha256()
                for k in range(0, len(own), 1 << 20):
                    text.update(coder.merges.decode(own[k : k + (1 << 20)]).data)
                decoded.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], names=[x.split()[0] for x in _ENCODED.split(", ")])

    return run


def _ids(file: str):
    def run(batches):
        coder = replay_encoder(file)
        for batch in parts(batches, SLICE):
            ids, at = coder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])

    return run


def _texts(file: str):
    def run(batches):
        coder = replay_encoder(file)
        for batch in batches:
            out = [None if x is None else coder.merges.decode(np.frombuffer(x, "<u4")).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return run


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def bpe_encode(documents: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``(doc_id, ids)`` of every row of ``documents``; ids are little-endian unsigned 32-bit numbers. A null text is empty, without ids."""
    return _documents(documents).mapInArrow(_ids(ranks), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``(doc_id, bytes)`` of every row of ``encoded`` (doc_id, ids); null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks), "doc_id long, bytes binary")


def bpe_digests(documents: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row of ``documents`` (doc_id, text; other columns are left alone).

    A null or empty text has no tokens, and the digests of nothing. Repeated rows and null doc_ids each return a row. Texts of any
    length are encoded whole. An empty table gives an empty result.
    """
    return _documents(documents).mapInArrow(_digests(ranks), _ENCODED)
