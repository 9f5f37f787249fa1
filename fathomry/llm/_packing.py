"""Packing a histogram of lengths by linear grouping: numbers in, numbers out; nothing here grows with the documents.

Documents of one length are alike, so they are numbered from 0 in each length and a plan says which numbers go where.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Block:
    """``count`` sequences with the same contents; entries are (length, first, each, offset): the sequence number s holds
    the documents first + s * each ... of that length, ``each`` of them, from that offset on."""

    count: int
    used: int = 0
    entries: list[tuple[int, int, int, int]] = field(default_factory=list)

    def put(self, length: int, first: int, each: int) -> None:
        self.entries.append((length, first, each, self.used))
        self.used += length * each

    def split(self, count: int) -> Block:
        """Leave ``count`` sequences here and return the others."""
        rest = Block(self.count - count, self.used, [(n, first + count * each, each, at) for n, first, each, at in self.entries])
        self.count = count
        return rest


def groups_of(counts: np.ndarray, lengths: list[int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, documents) runs of groups of equal cardinality, longest first; a length can be in several groups."""
    total = sum(int(counts[n]) for n in lengths)
    out, part, left = [], [], 0
    size = -(-total // groups) if total else 0
    for n in sorted(lengths, reverse=True):
        todo = int(counts[n])
        while todo:
            left = left or size
            take = min(todo, left)
            part.append((n, take))
            todo, left = todo - take, left - take
            if not left:
                out.append(part)
                part = []
    return [*out, part] if part else out


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a sequence so that their worth is greatest."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        at = fits[np.argmax(value[c - sizes[fits]] + worth[fits])]
        best = value[c - sizes[at]] + worth[at]
        if best > value[c - 1]:
            value[c], last[c] = best, at
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0 or value[c] == value[c - 1]:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return pattern


def configurations(sizes: list[int], demands: list[int], capacity: int, steps: int = 600) -> list[tuple[list[int], int]]:
    """(how many of each size, sequences) that cover the demands but for what rounding down leaves.

    The linear program over all configurations, solved by generating columns: at most as many
    configurations as there are sizes. Every step has a solution that covers the demands, so a bound on the steps costs only sequences.
    """
    s, d = np.array(sizes), np.array(demands, float)
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    for step in range(steps):
        worth = inverse.sum(0)
        pattern = best_pattern(s, np.maximum(worth, 0), capacity)
        if worth @ pattern <= 1 + 1e-7:
            break
        x, u = inverse @ d, inverse @ pattern
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
        inverse = np.linalg.inv(basis)
    copies = np.floor(np.maximum(inverse @ d, 0) + 1e-7).astype(int)
    return [([int(a) for a in basis[:, j]], int(n)) for j, n in enumerate(copies) if n]


def substitute(configs: list[tuple[list[int], int]], groups: list[list[tuple[int, int]]], taken: np.ndarray) -> list[Block]:
    """Blocks in which each group's places hold its documents, longest first; ``taken`` counts the documents by length."""
    queues = [[list(run) for run in g] for g in groups]
    done = []
    for config, copies in configs:
        todo = [(Block(copies), [g for g, n in enumerate(config) for _ in range(n)])]
        while todo:
            block, places = todo.pop()
            while places:
                queue = queues[places[0]]
                while queue and not queue[0][1]:
                    queue.pop(0)
                if queue:
                    length, there = queue[0]
                    if there < block.count:
                        todo.append((block.split(there), list(places)))
                    block.put(length, int(taken[length]), 1)
                    taken[length] += block.count
                    queue[0][1] -= block.count
                places = places[1:]
            if block.entries:
                done.append(block)
    return done


def best_fit(counts: np.ndarray, taken: np.ndarray, blocks: list[Block], capacity: int) -> list[Block]:
    """All blocks after the documents that aren't taken yet, longest first, each went where it leaves the least room."""
    by_room: dict[int, list[Block]] = {}
    rooms: list[int] = []

    def add(block: Block) -> None:
        room = capacity - block.used
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(block)

    for block in blocks:
        add(block)
    for length in range(capacity, 0, -1):
        left = int(counts[length] - taken[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                add(Block(max(1, left // each)))
                continue
            room = rooms[at]
            block = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            # The best place for the next document is the sequence that got the last one, while it has room.
            each = min(room // length, left)
            if (whole := left // each) < block.count:
                add(block.split(whole))
            block.put(length, int(taken[length]), each)
            taken[length] += block.count * each
            left -= block.count * each
            add(block)
    return [b for room in by_room.values() for b in room if b.entries]


def grouped(counts: np.ndarray, capacity: int, large: int, groups: int) -> list[Block]:
    """Blocks that hold counts[n] documents of every length n from 1 to capacity; those from ``large`` on are grouped.

    Documents of the full length are alone; the other large ones are rounded up within groups of equal cardinality, configurations
    of these few sizes are optimised, and documents take the rounded sizes' places; small ones, and the few large ones that
    rounding the configurations down left, go by best fit.
    """
    taken = np.zeros(capacity + 1, np.int64)
    blocks = []
    if counts[capacity]:
        full = Block(int(counts[capacity]))
        full.put(capacity, 0, 1)
        taken[capacity] = counts[capacity]
        blocks.append(full)
    parts = groups_of(counts, [n for n in range(large, capacity) if counts[n]], groups)
    if parts:
        configs = configurations([p[0][0] for p in parts], [sum(c for _, c in p) for p in parts], capacity)
        blocks += substitute(configs, parts, taken)
    return best_fit(counts, taken, blocks, capacity)


def pack(counts: np.ndarray, capacity: int, shares: tuple[float, ...], groups: int, close: float) -> list[Block]:
    """The packing with the fewest sequences of those that take lengths above each share of the capacity as large.

    The shares are tried in order until the sequences are within ``close`` of what the tokens need at least.
    """
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    best: list[Block] = []
    for share in shares:
        blocks = grouped(counts, capacity, int(capacity * share) + 1, groups)
        if not best or sum(b.count for b in blocks) < sum(b.count for b in best):
            best = blocks
        if sum(b.count for b in best) <= least * (1 + close) + 1:
            break
    return best
