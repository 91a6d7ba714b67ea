"""Re-Pair grammars over arrays of ids.

Frequent pairs of neighbours are replaced by new symbols (nonterminals) until no pair is frequent.  A
round counts all pairs, makes a rule of each frequent one and replaces what does not overlap a more
frequent pair.  Every nonterminal knows how many ids it stands for, and the sequence has a mark
at regular steps of how many ids stand before it, so any stretch is decoded without the rest.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"QRP1"
#: Symbols between two marks.
STEP = 1024


@dataclass
class Grammar:
    """``rules[k]`` is the pair of symbol ``base + k``; symbols below ``base`` are ids."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    marks: np.ndarray

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        out[inner] = self.lengths[symbols[inner] - self.base]
        return out

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """What the symbols stand for; each rule is written out once, in a short stretch only if used."""
        inner = symbols >= self.base
        if not inner.any():
            return symbols
        if len(symbols) > len(self.rules):
            used, place = np.arange(self.base, self.base + len(self.rules)), symbols[inner] - self.base
        else:
            used, place = np.unique(symbols[inner], return_inverse=True)
        written: dict[int, list[int]] = {}
        for k in used.tolist():
            self._write_out(k, written)
        table = np.array([x for k in used.tolist() for x in written[k]], symbols.dtype)
        sizes = self.lengths[used - self.base]
        starts = np.cumsum(sizes) - sizes
        lengths, source = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
        lengths[inner] = sizes[place]
        # The table of written-out rules, then the symbols that are ids themselves.
        source[inner] = starts[place]
        source[~inner] = len(table) + np.arange(len(symbols) - int(inner.sum()))
        ends = np.cumsum(lengths)
        return np.concatenate([table, symbols[~inner]])[np.repeat(source - (ends - lengths), lengths) + np.arange(int(ends[-1]))]

    def _write_out(self, symbol: int, written: dict[int, list[int]]) -> list[int]:
        """The ids of a symbol.  A rule names only earlier ones, so the rounds bound the depth."""
        if symbol < self.base:
            return [symbol]
        if symbol not in written:
            left, right = self.rules[symbol - self.base].tolist()
            written[symbol] = self._write_out(left, written) + self._write_out(right, written)
        return written[symbol]

    def ids(self) -> np.ndarray:
        """All ids."""
        return self._expand(self.sequence)

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; reads only the symbols that cover them."""
        if stop <= start:
            return np.empty(0, self.sequence.dtype)
        first = max(0, int(np.searchsorted(self.marks, start, "right")) - 1) * STEP
        last = min(len(self.sequence), int(np.searchsorted(self.marks, stop, "left")) * STEP)
        part = self.sequence[first:last]
        ends = self.marks[first // STEP] + np.cumsum(self.symbol_lengths(part))
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[low - 1]) if low else int(self.marks[first // STEP])
        return self._expand(part[low:high])[start - before : stop - before]


#: Bits of the slots that pairs are counted in first, and a pair's least share of the ids to be frequent.
SLOT_BITS, FREQUENT_SHARE = 18, 1 << 14


def _frequent_pairs(sequence: np.ndarray, places: np.ndarray, least_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, ranks): the pairs of neighbours found at least so often, the most frequent first,
    the places in ``sequence`` where one starts, rising, and which pair each of them is.

    Only pairs that start at the given places count.  They are first counted in hashed slots, so that
    only those of full slots are sorted.
    """
    first, second = sequence[places], sequence[places + 1]
    slots = (first.view(np.uint32) * np.uint32(0x9E3779B1) ^ second.view(np.uint32) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOT_BITS)
    slots = slots.view(np.int32)
    often = np.nonzero((np.bincount(slots, minlength=1 << SLOT_BITS) >= least_count)[slots])[0]
    at, pairs = places[often], first[often].astype(np.int64) << 32 | second[often]
    order = np.argsort(pairs)
    ordered = pairs[order]
    starts = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0] if len(at) else np.empty(0, np.int64)
    counts = np.diff(starts, append=len(ordered))
    frequent = np.nonzero(counts >= least_count)[0]
    # Ties in no order of their symbols: in a repeated stretch, many pairs outrank their neighbours.
    frequent = frequent[np.lexsort((ordered[starts[frequent]] * 0x9E3779B97F4A7C1 % 1000003, -counts[frequent]))]
    rank = np.full(len(starts), -1, np.int32)
    rank[frequent] = np.arange(len(frequent), dtype=np.int32)
    ranks = np.empty(len(at), np.int32)
    ranks[order] = np.repeat(rank, counts)
    return ordered[starts[frequent]], at[ranks >= 0], ranks[ranks >= 0]


def compress(ids: np.ndarray, base: int, least_count: int | None = None) -> Grammar:
    """The grammar of ``ids`` (all below ``base``).

    A round replaces every frequent pair where no neighbouring pair is more frequent, and rounds go on
    until no pair is frequent: found at least ``least_count`` times, which is 8 and one in 16384 ids if it
    is not given.
    """
    least = least_count or max(8, len(ids) // FREQUENT_SHARE)
    sequence, rules, lengths = ids.astype(np.int32), [np.empty((0, 2), np.int32)], np.empty(0, np.int64)
    places = np.arange(max(0, len(sequence) - 1), dtype=np.int32)
    while len(places):
        found, at, ranks = _frequent_pairs(sequence, places, least)
        frequent = np.zeros(len(sequence), bool)
        frequent[at] = True
        here = np.full(len(sequence) + 1, len(found), np.int32)
        here[at + 1] = ranks
        chosen = (ranks <= here[at]) & (ranks <= here[at + 2]) if len(sequence) > 2 else np.ones(len(at), bool)
        # A run of one pair (of a symbol with itself): every other one.
        same = ranks == here[at]
        if same.any():
            place = np.arange(len(at))
            chosen &= (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 0
        at, ranks = at[chosen], ranks[chosen]
        kept = np.bincount(ranks, minlength=len(found)) >= 2
        if not kept.any():
            break
        number = np.full(len(found), -1, np.int64)
        number[kept] = base + len(lengths) + np.arange(int(kept.sum()))
        at, ranks = at[kept[ranks]], ranks[kept[ranks]]
        pairs = np.stack([found[kept] >> 32, found[kept] & 0xFFFFFFFF], axis=1)
        known = np.concatenate([np.ones(base, np.int64), lengths])
        rules.append(pairs.astype(np.int32))
        lengths = np.concatenate([lengths, known[pairs].sum(axis=1)])
        sequence[at] = number[ranks]
        left = np.ones(len(sequence), bool)
        left[at + 1] = False
        sequence, frequent = sequence[left], frequent[left]
        # The others are as rare as they were, or rarer.
        fresh = sequence >= base + len(lengths) - int(kept.sum())
        places = np.nonzero(fresh[:-1] | fresh[1:] | frequent[:-1])[0].astype(np.int32)
    grammar = Grammar(base, np.concatenate(rules), lengths, sequence, np.empty(0, np.int64))
    before = np.concatenate([[0], np.cumsum(grammar.symbol_lengths(sequence))[:-1]]) if len(sequence) else np.empty(0, np.int64)
    grammar.marks = before[::STEP].astype(np.int64)
    return grammar


def pack(grammar: Grammar, documents: bytes) -> bytes:
    """One shard file: a JSON header with the sections' sizes, then documents, rules, expansion
    lengths, marks and sequence as little-endian arrays."""
    widest = int(max(grammar.sequence.max(initial=0), grammar.rules.max(initial=0)))
    symbol = "<u2" if widest < 1 << 16 else "<u4"
    sections = [documents, grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u8").tobytes(), grammar.marks.astype("<u8").tobytes(), grammar.sequence.astype(symbol).tobytes()]
    header = json.dumps({"base": grammar.base, "symbol": symbol, "sections": [len(x) for x in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


def unpack(data: bytes) -> tuple[Grammar, bytes]:
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack("<I", data[4:8])
    header, at, parts = json.loads(data[8 : 8 + size]), 8 + size, []
    for length in header["sections"]:
        parts.append(data[at : at + length])
        at += length
    rules = np.frombuffer(parts[1], "<u4").astype(np.int32).reshape(-1, 2)
    return Grammar(header["base"], rules, np.frombuffer(parts[2], "<u8").astype(np.int64), np.frombuffer(parts[4], header["symbol"]).astype(np.int32), np.frombuffer(parts[3], "<u8").astype(np.int64)), parts[0]
