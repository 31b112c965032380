"""Fuzzy line dedup: SimHash of normalised lines, a join on pigeonhole blocks, verified edit similarity, connected groups.

A line's words are lower-cased and white space does not matter. The SimHash that lines are joined on is made in blocks: the hash of a word picks
the one block on whose bits it votes, so an edit disturbs two blocks at most, and by the pigeonhole lines of like length that differ
in few words agree wholly in some block. Long words vote where a line has enough of them, as they tell lines apart best; else all do, and lines
of short words are dealt to blocks more often. Lines of up to nine words, where similar means one edit, are joined on the sums over all of their words but one. The number of blocks follows the
words that vote, so a block holds several. Each key is a block's number, its bits and how many voted.

Lines that share a key are compared by a second SimHash of 64 bits over all their words: first every line with the nearest of
its key, whose edit similarity is then verified; keys whose lines are not held together after that are compared pair by pair, in
tiles of bounded size. Verified links form the groups. Of each group, and of each line that occurs more than once, the first
occurrence (least document, then least line) stays in the corpus.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.text import _FOLDED as FOLDED
from tidemark.llm.text import LINES as AT_LINES
from tidemark.llm.text import as_array, blocks, mix, parts, segment_hashes, signed, word_hashes, word_spans
from tidemark.llm.tiles import grouped, runs, short_runs, tiled
from tidemark.session import small_enough, staged

#: Broadcast a table of at most so many (document, line) numbers (about 16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Broadcast at most so many keys that lines share (8 bytes each); beyond it the keys of all lines are shuffled once more.
BROADCAST_KEYS = 2_000_000
#: SimHashes compared in one square: more than of other rows, as a comparison is two instructions.
NEAR_TILE = 4096
#: Runs of up to so many lines of one key are compared together with all others of that kind.
TOGETHER = 16
#: Bits of a line's hash that tell lines of one key apart while keys are counted; a key is named by the others of 64.
TOLD = np.uint64(24)
#: Keys that a task sends at a time, and about as many in a group where they are counted.
SENT = 1 << 20
#: Lines that a task remembers, so that copies have keys once (8 bytes each).
SEEN = 1 << 20
LINES = "doc_id long, line_no int, h long, sim long, n_words int, keys array<long>"
#: Bits in which the SimHashes of lines of similarity 0.8 differ at most, but for one pair in forty.
FAR = 19
#: The same for lines of a key that the nearest pairs have not brought together.
FAR_AGAIN = 16
#: Words of at least so many bytes are long; a block is used if its words have the second number of bytes together, as many lines share the
#: blocks of a few short words, but of lines of short words also if it has the third number of words.
LONG, LETTERS, TOGETHER_WORDS = 7, 12, 3
#: Lines whose words have fewer bytes than these on average are dealt more often: the shortest in all bands, with blocks of words enough used
#: too; the others in the first two bands.
SHORT_WORDS, MIDDLING_WORDS = 4, 6
#: So often in each of the first bands and in all later ones, and to so many blocks in the first bands.
MORE_DEALS, MORE_BLOCKS = (5, 2, 3), (4, 6)
#: Lines of up to so many words are joined on all words but one.
SHORT = 9
#: Long words vote alone from this many in a line; up to the second number all words vote (too).
SOME_LONG, FEW_LONG = 5, 6


def _lanes() -> np.ndarray:
    """Of each byte, its bits in the eight bytes of a 64-bit number, so that a sum counts all eight at once."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


_LANES = _lanes()
#: Words whose bits a lane of eight bits can count.
COUNTED = 255
#: Runs of up to so many words are counted bit by bit, all at once.
SLICED = 64


def votes(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of ``n`` hashes from ``start`` on the bits that more than half of them have (no run is empty)."""
    out = np.empty(len(n), np.uint64)
    long = np.flatnonzero((n > SLICED) & (n <= COUNTED))
    if len(long):
        end = np.cumsum(n[long])
        edge = np.concatenate(([0], end))
        raw = h[np.arange(end[-1]) + np.repeat(start[long] - edge[:-1], n[long])].view(np.uint8).reshape(-1, 8)
        ones, total = np.empty((len(long), 8), np.uint64), np.zeros(len(raw) + 1, np.uint64)
        for k in range(8):
            # running sums wrap around, their differences do not
            np.cumsum(_LANES[raw[:, k]], out=total[1:])
            ones[:, k] = np.diff(total[edge])
        out[long] = np.packbits(ones.view(np.uint8).reshape(-1, 64) > (n[long] >> 1).astype(np.uint8)[:, None], axis=1).view(np.uint64).ravel()
    for i in np.flatnonzero(n > COUNTED):
        raw = h[start[i] : start[i] + n[i]].view(np.uint8).reshape(-1, 8)
        ones = sum(np.unpackbits(raw[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(raw), 65536))
        out[i] = np.packbits(2 * ones > n[i]).view(np.uint64)[0]
    # all other runs a hash at a time, the longest runs first, with a number's bits in as many arrays
    order = np.flatnonzero(n <= SLICED)
    order = order[np.argsort((SLICED - n[order]).astype(np.uint8), kind="stable")]
    first, size = start[order], n[order]
    longest = int(size.max(initial=0))
    more = np.searchsorted(-size, -np.arange(longest), side="left")
    sums = np.zeros((longest.bit_length(), len(order)), np.uint64)
    for j in range(longest):
        carry = h[first[: more[j]] + j]
        for level in sums[: (j + 1).bit_length(), : more[j]]:
            both = level & carry
            level ^= carry
            carry = both
    most = np.zeros(len(order), np.uint64)
    for k, level in enumerate(sums):
        half = -(size >> 1 >> k & 1).astype(np.int64)
        half = half.view(np.uint64)
        most = level & ~half | ~(level ^ half) & most
    out[order] = most
    return out


def simhashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each run of word hashes (no run is empty). A word counts once however often a line has it, else the few most
    common words of a language would make all its long lines alike."""
    if not len(at) - 1:
        return np.zeros(0, np.uint64)
    line = np.repeat(np.arange(len(at) - 1), np.diff(at))
    tagged = h ^ mix(line.astype(np.uint64) + np.uint64(1))
    # equal words meet in the order of the upper bits; the lower ones hold their places
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = (np.sort(tagged & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    again = (tagged[order[1:]] == tagged[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    new = np.ones(len(h), bool)
    new[order[1:][again]] = False
    n = np.bincount(line[new], minlength=len(at) - 1)
    return votes(h[new], np.cumsum(n) - n, n)


@cache
def plan(low: int, few: int) -> list[tuple[int, int, int, int]]:
    """``(least, most, deals, blocks)`` by the number of voting words, from ``low`` on: bands that overlap by more than similar lines differ, and
    in each so many blocks that two or three stay undisturbed by edits of a fifth of the words; where few words vote they are dealt
    to blocks twice, or four times. ``few``: voting words of the largest band with two deals."""
    out, first, g = [], low, 3
    while first < 1 << 32:
        last = max(first + 2, math.ceil(first / 0.64) - 1)
        deals = 4 if low > SHORT and first == low else 2 if last <= few else 1
        g = 3 if deals > 1 else g
        while g * math.exp(-0.4 * last / g) < (2.6 if deals > 1 else 2.9 if last <= 40 else 2.2):
            g += 1 + g // 64
        out.append((math.floor(0.77 * first) if low <= SHORT or first > low else math.ceil(0.8 * first), last, deals, g))
        first = last + 1
    return out


def _dealt(words: np.ndarray, size: np.ndarray, line: np.ndarray, n: np.ndarray, bands: list[tuple[int, int, int, int]], salt: int, lines: int):
    """``(line, key)`` of the blocks in use, whose votes are counted together."""
    letters_of, words_of = np.bincount(line, size, lines), np.bincount(line, minlength=lines)
    short, middling = letters_of < SHORT_WORDS * words_of, letters_of < MIDDLING_WORDS * words_of
    most = int(words_of.max(initial=0))
    begin = np.cumsum(words_of) - words_of
    dealt: list[tuple] = []
    laid = 0
    for number, (least, last, deals, g) in enumerate(bands):
        if least > most:
            break
        own = np.flatnonzero((n >= least) & (n <= last) & (words_of > 0))
        if not len(own):
            continue
        chosen = np.arange(words_of[own].sum()) + np.repeat(begin[own] - (np.cumsum(words_of[own]) - words_of[own]), words_of[own])
        w, z, of = words[chosen], size[chosen], line[chosen].astype(np.uint64)
        for deal in range(deals + MORE_DEALS[min(number, 2)]):
            if deal == deals:
                more = (middling if number < len(MORE_BLOCKS) else short)[of.astype(np.int64)]
                w, z, of = w[more], z[more], of[more]
                g = MORE_BLOCKS[number] if number < len(MORE_BLOCKS) else g
            if not len(w):
                break
            tag = np.uint64((salt * 1000003 + number * 7 + deal + 1) * 0x9E3779B97F4A7C15 % 2**64)
            block = (mix(w ^ tag) >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)
            # numbers that hold place and order are sorted faster than an order is found
            bits = np.uint64(len(w).bit_length())
            place = np.sort((of * np.uint64(g) + block) << bits | np.arange(len(w), dtype=np.uint64))
            where, place = (place & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), (place >> bits).astype(np.int64)
            at = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place))
            count = np.diff(at)
            enough = (np.add.reduceat(z[where], at[:-1]) >= LETTERS) | (short[place[at[:-1]] // g] & (count >= TOGETHER_WORDS))
            used = np.flatnonzero(enough)
            if not len(used):
                continue
            row, block = np.divmod(place[at[used]], g)
            dealt.append((w[where], at[used] + laid, count[used], row, mix(block.astype(np.uint64) + tag)))
            laid += len(where)
    if not dealt:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words, at, count, row, block = (np.concatenate(x) for x in zip(*dealt, strict=True))
    return row, mix(mix(votes(words, at, count) + block) + count.astype(np.uint64))


def block_keys(words: np.ndarray, size: np.ndarray, at: np.ndarray, min_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, where each line's begin)`` of lines of word hashes, with the words' bytes; shorter lines have none."""
    n = np.diff(at)
    lines = len(n)
    line = np.repeat(np.arange(lines), n)
    long = size >= LONG
    n_long = np.bincount(line[long], minlength=lines)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    few = (n >= min_words) & (n <= SHORT)
    if few.any():
        chosen = np.flatnonzero(few[line])
        mixed = mix(words[chosen])
        total = np.zeros(lines, np.uint64)
        np.add.at(total, line[chosen], mixed)
        one = lambda rest, k: mix(rest + k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        rows += [line[chosen], np.flatnonzero(few)]
        keys += [one(total[line[chosen]] - mixed, n[line[chosen]] - 1), one(total[few], n[few])]
    counted = (n >= max(min_words, math.ceil(0.8 * (SHORT + 1))))
    by_long = np.where(counted & (n_long >= SOME_LONG), n_long, 0)
    by_all = np.where(counted & (n_long <= FEW_LONG), n, 0)
    for r, k in (_dealt(words[long], size[long], line[long], by_long, plan(SOME_LONG, 20), 1, lines), _dealt(words, size, line, by_all, plan(SHORT + 1, 39), 2, lines)):
        rows.append(r)
        keys.append(k)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    return keys[np.argsort(rows, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=lines))))


def _lines(min_words: int):
    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in parts(batches):
            column = as_array(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            base = np.zeros(len(column), np.int64)
            for rows, b, at in blocks(column, cuts=AT_LINES):
                feed = np.flatnonzero(b == 10)
                text_of = np.searchsorted(at, feed, side="right") - 1
                # lines start at each text's start and after each line feed
                starts = np.concatenate((at[:-1], feed + 1))
                owner = np.concatenate((np.arange(len(rows)), text_of))
                order = np.lexsort((np.concatenate((np.zeros(len(rows), np.int8), np.ones(len(feed), np.int8))), starts, owner))
                starts, owner = starts[order], owner[order]
                # a text that goes on from the block before has a part of no words there, up to its first line feed
                number = base[rows[owner]] + np.arange(len(starts)) - np.searchsorted(owner, owner)
                ends = np.minimum(np.append(starts[1:], len(b)), at[owner + 1])
                if len(rows) == 1:
                    base[rows[0]] += len(feed)
                ws, we = word_spans(b, at)
                h = segment_hashes(b, ws, we, FOLDED)
                lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
                n = hi - lo
                ok = np.flatnonzero(n > 0)
                if not len(ok):
                    continue
                wat = np.concatenate(([0], np.cumsum(n[ok])))
                chosen = np.arange(wat[-1]) + np.repeat(lo[ok] - wat[:-1], n[ok])
                words = h[chosen]
                place = (np.arange(len(words)) - np.repeat(wat[:-1], n[ok])).astype(np.uint64)
                whole = mix(np.add.reduceat(mix(words ^ (place * np.uint64(0x9E3779B97F4A7C15))), wat[:-1]) + n[ok].astype(np.uint64))
                # of the copies that a task meets one has keys and a SimHash
                whole_of, new = np.unique(whole, return_index=True)
                there = np.searchsorted(seen, whole_of)
                known = np.append(seen, np.uint64(0))[there] == whole_of
                known[there == len(seen)] = False
                new = np.sort(new[~known])
                new = new[n[ok[new]] >= min_words]
                seen = np.insert(seen, there[~known], whole_of[~known]) if len(seen) < SEEN else whole_of
                of = np.arange(n[ok[new]].sum()) + np.repeat(wat[new] - (np.cumsum(n[ok[new]]) - n[ok[new]]), n[ok[new]])
                new_at = np.concatenate(([0], np.cumsum(n[ok[new]])))
                keys, key_at = block_keys(words[of], (we - ws)[chosen[of]], new_at, min_words)
                n_keys, sim = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.uint64)
                n_keys[new], sim[new] = np.diff(key_at), simhashes(words[of], new_at)
                key_at = np.concatenate(([0], np.cumsum(n_keys)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows[owner[ok]]], pa.int64()), pa.array(number[ok], pa.int32()), pa.array(signed(whole)), pa.array(signed(sim)), pa.array(n[ok], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(key_at, pa.int32()), pa.array(signed(keys >> TOLD))),
                    ],
                    names=["doc_id", "line_no", "h", "sim", "n_words", "keys"],
                )

    return run


def _sent(groups: int):
    """``(part, codes)``: each key with some bits of its line's hash, as sorted numbers that occur once, dealt to groups by the key."""
    edges = np.array([-(-(k << 64) // groups) for k in range(1, groups)], np.uint64) >> TOLD << TOLD

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.sort(np.concatenate(held))
        codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))]
        at = np.concatenate(([0], np.searchsorted(codes, edges), [len(codes)]))
        some = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([codes[at[k] : at[k + 1]].tobytes() for k in some.tolist()], pa.binary())], names=["part", "codes"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column("keys")
            line = batch.column("h").to_numpy().view(np.uint64) >> (np.uint64(64) - TOLD)
            size = np.diff(keys.offsets.to_numpy())
            codes = keys.flatten().to_numpy().view(np.uint64) << TOLD | np.repeat(line, size)
            held.append(codes)
            n += len(codes)
            if n >= SENT:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """``(key, size)``: the keys that two lines or more have, and how many."""
    codes = np.sort(np.frombuffer(b"".join(x.as_py() for x in table.column("codes")), np.uint64))
    key = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] >> TOLD
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    many = np.flatnonzero(np.diff(at) > 1)
    return pa.table({"key": signed(key[at[many]]), "size": np.diff(at)[many]})


def _shared(lines: DataFrame) -> DataFrame:
    """``(key, size)``: the keys that two lines or more have, and how many have them (but for a few whose hashes have equal bits)."""
    total = lines.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    sent = lines.select("h", "keys").mapInArrow(_sent(max(1, -(-total // SENT))), "part long, codes binary")
    return staged(sent.groupBy("part").applyInArrow(_counted, "key long, size long"), "shared")


def _apart(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """The bits in which lines differ; 65 if their lengths forbid the similarity."""
    differing = np.bitwise_count(x ^ y).astype(np.uint8)
    differing[np.minimum(nx, ny) < np.maximum(nx, ny) * least - 1e-9] = 65
    return differing


def _edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack((np.minimum(x, y), np.maximum(x, y)))


def _nearest(least: float):
    """``(a, b)``: each line of a key with the nearest one before it there, if it is near; and with itself each other line that may be compared
    again, so that all texts are fetched at once."""

    def run(table: pa.Table) -> pa.Table:
        name, sim, n = (table.column(c).to_numpy() for c in ("h", "sim", "n_words"))
        sim, n, again = sim.view(np.uint64), n.astype(np.int32), np.zeros(len(name), bool)
        rows, place = short_runs(table, "key", TOGETHER)
        best, other = np.full(len(rows), 65, np.uint8), np.zeros(len(rows), np.int64)
        i = np.flatnonzero(place >= 1)
        for lag in range(1, TOGETHER):
            i = i[place[i] >= lag]
            x, y = rows[i], rows[i - lag]
            d = _apart(sim[x], sim[y], n[x], n[y], least)
            better = d < best[i]
            best[i[better]], other[i[better]] = d[better], y[better]
            near = d <= FAR_AGAIN
            again[x[near]] = again[y[near]] = True
        found = [(rows[best <= FAR], other[best <= FAR])]
        for left, right in runs(table, "key", TOGETHER):
            for i in range(0, len(right), 128):
                rows = right[i : i + 128]
                others = left[: i + 128] if left is right else left
                d = _apart(sim[rows][:, None], sim[others], n[rows][:, None], n[others], least)
                if left is right:
                    d[:, i:][~np.tri(len(rows), len(others) - i, -1, dtype=bool)] = 65
                best = d.argmin(axis=1)
                near = d[np.arange(len(rows)), best] <= FAR
                found.append((rows[near], others[best[near]]))
                close = d <= FAR_AGAIN
                again[rows] |= close.any(axis=1)
                again[others] |= close.any(axis=0)
        x, y = (np.concatenate(side) for side in zip(*found, strict=True))
        again[x] = again[y] = False
        own = np.unique(name[again])
        a, b = _edges(name[x], name[y])
        return pa.table({"a": np.concatenate((a, own)), "b": np.concatenate((b, own))})

    return run


#: A line of a key that is compared again.
NEAR = "key long, h long, sim long, n_words int, comp long"


def _crossing(least: float):
    """The lines of a key that are near one of it with which they are not held together yet. Lines, not pairs, as a group of many near
    copies has too many of these."""

    def run(table: pa.Table) -> pa.Table:
        sim, n, comp = (table.column(c).to_numpy() for c in ("sim", "n_words", "comp"))
        sim, n, found = sim.view(np.uint64), n.astype(np.int32), np.zeros(len(sim), bool)
        rows, place = short_runs(table, "key", TOGETHER)
        for lag in range(1, TOGETHER):
            i = np.flatnonzero(place >= lag)
            x, y = rows[i], rows[i - lag]
            near = (_apart(sim[x], sim[y], n[x], n[y], least) <= FAR_AGAIN) & (comp[x] != comp[y])
            found[x[near]] = found[y[near]] = True
        for left, right in runs(table, "key", TOGETHER):
            for i in range(0, len(right), 128):
                rows = right[i : i + 128]
                near = (_apart(sim[rows][:, None], sim[left], n[rows][:, None], n[left], least) <= FAR_AGAIN) & (comp[rows][:, None] != comp[left][None, :])
                found[rows] |= near.any(axis=1)
                found[left] |= near.any(axis=0)
        return table.select(["key", "h", "sim", "n_words", "comp"]).filter(pa.array(found))

    return run


class _Words:
    """The words of some lines, for telling many pairs of them apart together."""

    def __init__(self, lines, least: float):
        self.h, self.at = word_hashes(lines)
        self.n, self.least = np.diff(self.at), least
        has = np.zeros((len(self.n), 256), bool)
        has[np.repeat(np.arange(len(self.n)), self.n), (self.h >> np.uint64(32) & np.uint64(255)).astype(np.int64)] = True
        self.bits = np.packbits(has, axis=1).view(np.uint64)

    def _flat(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of lines, and which line each is of."""
        size = self.n[lines]
        return self.h[np.arange(size.sum()) + np.repeat(self.at[lines] - (np.cumsum(size) - size), size)], np.repeat(np.arange(len(lines)), size)

    def _lacking(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each pair of lines how many words, counted as often as they occur, the one lacks that has more to lack."""
        sides = []
        for side, lines in enumerate((x, y)):
            h, pair = self._flat(lines)
            # a pair's number, most bits of a word, a side
            sides.append(pair.astype(np.uint64) << np.uint64(44) | h >> np.uint64(21) << np.uint64(1) | np.uint64(side))
        code = np.sort(np.concatenate(sides))
        word = code >> np.uint64(1)
        at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        of_y = np.add.reduceat(code & np.uint64(1), at).astype(np.int64)
        common = np.bincount((word[at] >> np.uint64(43)).astype(np.int64), np.minimum(of_y, np.diff(at, append=len(code)) - of_y), len(x))
        return np.maximum(self.n[x], self.n[y]) - common.astype(np.int64)

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair of lines is similar. Words that the other line lacks take an edit each (some may share a bit, so these are at
        least as many), and lines of one length need no more edits than places that differ; of the rest the edits are counted."""
        nx, ny = self.n[x], self.n[y]
        most = np.floor(np.maximum(nx, ny) * (1 - self.least) + 1e-9).astype(np.int64)
        p, q = self.bits[x], self.bits[y]
        lacking = np.maximum(np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
        out, left = np.zeros(len(x), bool), (lacking <= most) & (np.abs(nx - ny) <= most)
        same = np.flatnonzero(left & (nx == ny) & (nx > 0))
        if len(same):
            (p, pair), (q, _) = self._flat(x[same]), self._flat(y[same])
            out[same] = np.bincount(pair[p != q], minlength=len(same)) <= most[same]
            left[same] &= ~out[same]
        rest = np.flatnonzero(left)
        for k in range(0, len(rest), 1024):
            i = rest[k : k + 1024]
            left[i] = self._lacking(x[i], y[i]) <= most[i]
        for i in np.flatnonzero(left).tolist():
            out[i] = edit_similarity(self._of(x[i]), self._of(y[i]), self.least)
        return out

    def _of(self, i: int) -> list:
        return self.h[self.at[i] : self.at[i + 1]].tolist()


#: Pairs that are told apart together.
PAIRS = 8192


def _near_pairs(table: pa.Table, sim: np.ndarray, n: np.ndarray, comp: np.ndarray, least: float):
    """``(x, y)`` rows of one key that are near and not held together, the nearest first; those of all short runs together."""
    rows, place = short_runs(table, "key", TOGETHER)
    found = []
    for lag in range(1, TOGETHER):
        i = np.flatnonzero(place >= lag)
        x, y = rows[i], rows[i - lag]
        d = _apart(sim[x], sim[y], n[x], n[y], least)
        near = (d <= FAR_AGAIN) & (comp[x] != comp[y])
        found.append((x[near], y[near], d[near]))
    x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(d, kind="stable")
    yield x[order], y[order]
    for left, right in runs(table, "key", TOGETHER):
        for i in range(0, len(right), 128):
            rows = right[i : i + 128]
            others = left[: i + 128] if left is right else left
            d = _apart(sim[rows][:, None], sim[others], n[rows][:, None], n[others], least)
            if left is right:
                d[:, i:][~np.tri(len(rows), len(others) - i, -1, dtype=bool)] = 65
            p, q = np.nonzero((d <= FAR_AGAIN) & (comp[rows][:, None] != comp[others]))
            order = np.argsort(d[p, q], kind="stable")
            yield rows[p[order]], others[q[order]]


def _verified(least: float):
    """``(a, b)``: components that are linked by lines of one key that are near and similar; what is held together already is not compared again."""

    def run(table: pa.Table) -> pa.Table:
        name, sim, n, comp = (table.column(c).to_numpy() for c in ("h", "sim", "n_words", "comp"))
        sim, n = sim.view(np.uint64), n.astype(np.int32)
        words = _Words(table.column("line"), least)
        names, label = np.unique(comp, return_inverse=True)
        line = np.unique(name, return_inverse=True)[1]
        root, now, unlike = list(range(len(names))), label, np.zeros(0, np.int64)
        out: tuple[list, list] = ([], [])

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for xs, ys in _near_pairs(table, sim, n, comp, least):
            for k in range(0, len(xs), PAIRS):
                x, y = xs[k : k + PAIRS], ys[k : k + PAIRS]
                # lines of several keys meet more than once
                pair, first = np.unique(np.minimum(line[x], line[y]) * len(name) + np.maximum(line[x], line[y]), return_index=True)
                new = ~np.isin(pair, unlike)
                pair, first = pair[new], first[new]
                apart = now[x[first]] != now[y[first]]
                pair, x, y = pair[apart], x[first[apart]], y[first[apart]]
                similar = words.similar(x, y)
                unlike = np.concatenate((unlike, pair[~similar]))[-16 * PAIRS :]
                for p, q in zip(label[x[similar]].tolist(), label[y[similar]].tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        p, q = min(p, q), max(p, q)
                        out[0].append(names[p])
                        out[1].append(names[q])
                        root[q] = p
                if similar.any():
                    now = np.array([find(r) for r in range(len(root))])[label]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def edit_similarity(x: list, y: list, least: float) -> bool:
    """Whether 1 - (edits of words / words of the longer line) is at least ``least``."""
    if len(x) < len(y):
        x, y = y, x
    most = math.floor(len(x) * (1 - least) + 1e-9)
    if len(x) - len(y) > most:
        return False
    a = 0
    while a < len(y) and x[a] == y[a]:
        a += 1
    b = 0
    while b < len(y) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not y:
        return len(x) <= most
    # each word that the other line lacks takes an edit
    p, q = set(x), set(y)
    if len(p - q) > most or len(q - p) > most:
        return False
    # a column of the distance table at a time, its steps up and down as the bits of two numbers
    places: dict = {}
    for i, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << i
    every, last, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = every, 0
    for k, word in enumerate(y, 1):
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        score += bool(rise & last) - bool(fall & last)
        if score - (len(y) - k) > most:
            return False
        rise, fall, either = rise << 1 | 1, fall << 1, same | down
        up, down = (fall | ~(either | rise)) & every, rise & either & every
    return score <= most


def _verify(least: float):
    def run(batches):
        for batch in parts(batches, column="xa"):
            size = len(batch)
            words = _Words(pa.concat_arrays([as_array(batch.column(c)) for c in ("xa", "xb")]), least)
            yield batch.select(["a", "b"]).filter(pa.array(words.similar(np.arange(size), np.arange(size, 2 * size))))

    return run


def _small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast in a join if it has few rows."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def _line_texts(wanted: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(h, line)``: the text of each line in ``wanted`` (h), from its first occurrence."""
    wanted = staged(wanted, "wanted")
    there = lines.select("h", "doc_id", "line_no").join(_small(wanted), "h", "left_semi")
    places = staged(there.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first")).select("h", "first.*"), "places")
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h")).alias("wanted"))
    if small_enough(places, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    split = docs.join(wanted, "doc_id").select("wanted", F.split("text", "\n").alias("lines"))
    texts = split.select(F.explode(F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), F.try_element_at("lines", w["line_no"] + 1).alias("line")))).alias("t")).select("t.*")
    return staged(texts.where("line is not null").dropDuplicates(["h"]), "texts")


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def line_links(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """``(h, component)`` of the lines that are linked with others."""
    fuzzy = lines.where(F.size("keys") > 0).select("h", "sim", "n_words", F.explode("keys").alias("key"))
    shared = _small(_shared(lines), BROADCAST_KEYS)
    keyed = staged(fuzzy.join(shared, "key").groupBy("key", "h").agg(F.min("sim").alias("sim"), F.min("n_words").alias("n_words"), F.min("size").alias("size")), "keyed")
    pairs = staged(grouped(tiled(keyed, "key", ["h"], NEAR_TILE, keyed.count()), _nearest(similarity), "a long, b long").distinct(), "pairs")
    texts = _line_texts(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), docs, lines)
    side = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias("x" + c))
    links = pairs.where("a <> b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(_verify(similarity), "a long, b long")
    found = staged(connected_components(links).withColumnRenamed("node", "h"), "found")

    placed = keyed.join(_small(found), "h", "left").withColumn("comp", F.coalesce("component", "h"))
    mark = F.bit_xor(F.xxhash64("h")).alias("mark")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), mark).where("low <> high and size > 2")
    # keys with equal lines are compared once
    first = staged(open_keys.groupBy("mark", "size").agg(F.min("key").alias("key")), "first")
    members = placed.join(_small(first.select("key"), BROADCAST_KEYS), "key", "left_semi").select("key", "h", "sim", "n_words", "comp", "size")
    rows = first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    near = staged(grouped(tiled(members, "key", ["h"], NEAR_TILE, rows), _crossing(similarity), NEAR).distinct(), "near")
    if n_near := near.count():
        again = near.join(_small(near.groupBy("key").agg(F.count("*").alias("size"))), "key").join(texts, "h")
        more = staged(grouped(tiled(again, "key", ["h"], rows=n_near), _verified(similarity), "a long, b long").distinct(), "more")
        # components are linked, not lines: few against the links that are known
        merged = staged(connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("least")), "merged")
        held = found.join(_small(merged), "component", "left").select("h", F.coalesce("least", "component").alias("component"))
        # a line by itself is its own component
        known = found.select(F.col("h").alias("component")).join(_small(merged), "component", "left_semi")
        found = staged(held.unionByName(merged.join(known, "component", "left_anti").select(F.col("component").alias("h"), F.col("least").alias("component"))), "found")
    return found


def line_groups(documents: DataFrame, min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, line_no, kept)`` of every line that has a copy or, from ``min_words`` words on, a near copy; line_no from 0.

    ``documents``: doc_id, text. Null and empty texts and blank lines have none. Lines of rows without a doc_id are left out, and stay in
    the corpus. Rows that repeat a doc_id count as one document, whose lines are those of each of them. An empty table gives an empty result.
    """
    docs = _documents(documents).where("doc_id is not null and text is not null")
    lines = staged(docs.mapInArrow(_lines(min_words), LINES), "lines")
    group = line_links(docs, lines, similarity)

    copies = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    labels = staged(copies.join(group, "h", "full").select("h", F.coalesce("component", "h").alias("component")), "labels")
    members = staged(lines.select("doc_id", "line_no", "h").join(_small(labels), "h").select("doc_id", "line_no", "component"), "members")
    keeper = staged(members.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("keeper")), "keeper")
    return members.join(_small(keeper), "component").select("doc_id", "line_no", (F.struct("doc_id", "line_no") == F.col("keeper")).alias("kept"))


def dedup_lines(documents: DataFrame, min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with the text left by ``line_groups`` and the columns n_lines and n_dropped, which replace columns of those
    names; all other columns as they were.

    Blank lines, and rows without a doc_id or text, stay as they are.
    """
    dropped = line_groups(documents, min_words, similarity).where("not kept").groupBy("doc_id")
    drops = staged(dropped.agg(F.sort_array(F.collect_set("line_no")).alias("drop")), "drops")
    total = drops.agg(F.sum(F.size("drop"))).first()[0] or 0
    if total <= BROADCAST_ROWS:
        drops = F.broadcast(drops)
    # the caller's columns travel in a struct, so that none clashes with what is joined
    rows = documents.select(F.struct("*").alias("row")).join(drops, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left")
    lines, drop = F.split("row.text", "\n"), F.coalesce("drop", F.array().cast("array<int>"))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(left)
    kept = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.octet_length("row.text") - F.octet_length(F.replace("row.text", F.lit("\n"))) + 1
    n_dropped = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped")
    return rows.select(*kept, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), n_dropped)
