"""Token ids of whole texts by a public tokenizer, many documents at a time (used inside tasks).

A byte-level BPE never merges across the start of a run of white space that follows other characters, so texts are cut
there, each distinct piece is encoded once, and the ids are put together in numpy. The merges run in tiktoken, three times as
fast here as in tokenizers, over the vocabulary of the tokenizers file; the tests hold the ids against tokenizers' own.
"""

from __future__ import annotations

import os

import numpy as np

from tidemark.llm.text import SPACE, as_array, blocks, segment_hashes

#: Distinct pieces remembered by a task; beyond it the memory starts afresh.
REMEMBERED = 500_000
# bytes that may end a Unicode white space character: no cut after these
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0x80:] = True
_SAFE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


class Encoder:
    """Encodes columns of texts; special tokens in a text count as ordinary text, and none are added."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        # a byte-level vocabulary writes each byte as one character, and its ids are in the order of its merges
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if all(c in of for c in token)}
        self._bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self._known, self._at, self._size, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._bpe.encode_ordinary(x), np.uint32) for x in texts]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        # pieces that begin with white space and end safely are encoded end to end, and told apart by their bytes
        apart = np.array([not (SPACE[p[0]] and _SAFE[p[-1]]) for p in pieces])
        order = np.concatenate((np.flatnonzero(apart), np.flatnonzero(~apart)))
        single = self._ids_of([pieces[i].decode("utf-8", "replace") for i in np.flatnonzero(apart)])
        joined = self._ids_of([b"".join(pieces[i] for i in part).decode("utf-8", "replace") for part in np.array_split(order[len(single) :], 1 + len(order) // 4096)])
        flat = np.concatenate([np.zeros(0, np.uint32), *joined])
        ends = np.searchsorted(np.cumsum(self._width[flat]), np.cumsum([len(pieces[i]) for i in order[len(single) :]])) + 1
        size = np.concatenate((np.array([len(x) for x in single], np.int64), np.diff(ends, prepend=0).astype(np.int64)))
        at = len(self._ids) + np.cumsum(size) - size
        self._ids = np.concatenate((self._ids, *single, flat))
        back = np.argsort(order)
        size, at = size[back], at[back]
        place = np.searchsorted(self._known, hashes)
        self._known, self._at, self._size = np.insert(self._known, place, hashes), np.insert(self._at, place, at), np.insert(self._size, place, size)

    def _block(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(b), bool)
        first[1:] = SPACE[b[1:]] & _SAFE[b[:-1]]
        first[at[at < len(b)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(b))
        u, one, inverse = np.unique(segment_hashes(b, start, end), return_index=True, return_inverse=True)
        if len(self._known) > REMEMBERED:
            self._forget()
        new = np.ones(len(u), bool)
        if len(self._known):
            new = self._known[np.minimum(np.searchsorted(self._known, u), len(self._known) - 1)] != u
        if new.any():
            whole = b.tobytes()
            self._learn(u[new], [whole[start[i] : end[i]] for i in one[new]])
        place = np.searchsorted(self._known, u)
        size, begin = self._size[place][inverse], self._at[place][inverse]
        ends = np.cumsum(size)
        ids = self._ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(start, at)]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), and where each text's ids begin (one offset more than texts)."""
        column = as_array(column)
        counts, parts = np.zeros(len(column), np.int64), []
        for rows, b, at in blocks(column, 4 << 20):
            if len(b):
                ids, where = self._block(b, at)
                parts.append(ids)
                np.add.at(counts, rows, np.diff(where))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], np.cumsum(counts)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The encoder for a file of the public tokenizers (a bare name) or any path, kept by the worker."""
    if file not in _ENCODERS:
        path = file
        if os.sep not in file:
            import public_tokenizers

            path = public_tokenizers.path(file)
        _ENCODERS[file] = Encoder(path)
    return _ENCODERS[file]
