"""SentencePiece encoding by sampling distinct segmentations: Gumbel top-k over the lattice, and decoding.

The segmentations of a text are the paths of its lattice, each with a probability proportional to the
product of its pieces' weights. Every path gets a Gumbel-perturbed log probability, and the k paths with
the largest ones are a sample of k without replacement. They are found by search from the best down: the
paths that branch off from a known one within a span of its places have a known total probability, so the
largest perturbed value of them all can be drawn at once; the set with the largest value is opened, one path
of it is drawn to carry that value (first the place where it branches off), and what is left of the set and
what branches off from that path are new sets whose largest values are drawn below it. No path is listed that
is not returned, and a path costs a few draws beyond those of its own edges.

Pieces never reach over a word's beginning, so the lattice of a text is the chain of its words' lattices;
those are built together, each distinct word once, and kept for the texts to come as long as there is room.
Draws come from a hash of the row's key and the place, so they do not depend on how rows are dealt.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.llm.common import exact_id, mix, plain_id, ship

SAMPLES = 4
#: Characters of texts that are worked on at once (a text with more is worked on alone).
TEXT_AT_ONCE = 1_200_000
#: Edges beyond which the lattices at hand are forgotten before others are made; bounds space, not results.
KEPT_EDGES = 4_000_000
#: Words whose lattices are made together and words that are walked together, few enough for the processor's cache;
#: only the speed depends on them.
BUILT_AT_ONCE = 4_000
WALKED_AT_ONCE = 1 << 14
SPACE = "▁"
#: Put between words where a whole lot of texts is split; texts that hold it are split one by one.
CUT = "\0"
#: First bits of a hash by which pieces are looked up; only the speed depends on them.
KEY_BITS = 17


class Lattices:
    """Lattices of the words at hand: a state for each place in a word, an edge for each piece that begins there.

    Edges stand in order of their states. ``upper`` is the summed probability of a state's edges up to each.
    Pieces are found by hashes of growing length, for all places at once, as long as some piece still begins so.
    """

    def __init__(self, path: str, power: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in plain]
        # merge models score pieces by rank, in whole numbers: such a rank becomes a weight by Zipf's law
        ranked = all(s == int(s) and s <= 0 for s in scores)
        self.weight = {
            m.id_to_piece(i): (i, power * (-math.log(2 + rank) if ranked else s)) for rank, (i, s) in enumerate(zip(plain, scores))
        }
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rare = power * -math.log(2 + size)
        self._spell(plain)
        self.begins = self._table()
        whole = any(SPACE in p.lstrip(SPACE) for p in self.weight)
        self.lines = lines = not any("\n" in p for p in self.weight)
        self.words = None if whole else re.compile(
            f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        )
        self.number = defaultdict[str, int]()
        self.number.default_factory = self.number.__len__  # a word's number is how many came before it
        self._forget()

    def _forget(self) -> None:
        self.number.clear()
        self.words_kept = self.states = self.edges = 0
        self.root, self.first = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.source, self.next, self.piece = (np.empty(0, np.int32) for _ in range(3))
        self.logp, self.upper = np.empty(0), np.empty(0)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into a column from a place on; what lies behind them is room for others."""
        column = getattr(self, name)
        if at + len(values) > len(column):
            grown = np.empty(max(at + len(values), len(column) * 3 // 2), column.dtype)
            grown[:at] = column[:at]
            setattr(self, name, column := grown)
        column[at : at + len(values)] = values

    def _spell(self, plain: list[int]) -> None:
        """What the model decodes each piece to: at the beginning of a text, and behind another piece."""
        before = next((i for i in plain if SPACE not in self.model.id_to_piece(i)), plain[0])
        skip = len(self.model.decode([before]))
        size = self.model.get_piece_size()
        self.spelled, behind = [b""] * size, [b""] * size
        for b, i in enumerate(self.byte):
            if self.model.is_byte(i):
                self.spelled[i] = behind[i] = bytes([b])
        for i, alone, pair in zip(plain, self.model.decode([[i] for i in plain]), self.model.decode([[before, i] for i in plain])):
            self.spelled[i], behind[i] = alone.encode(), pair[skip:].encode()
        self.spelled_behind = pa.array(behind, pa.large_binary())

    def decodes(self, samples: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the model decodes the ids of each sample to its text.

        Ids are decoded all at once, by what the model makes of each piece; bytes that are together a text are what
        the model makes of pieces for bytes. A sample that comes out otherwise is given to the model whole, and so are
        those of texts that begin with a blank, which some models drop.
        """
        decoded = self.spelled_behind.take(pa.array(np.concatenate([np.empty(0, np.int32), *samples])))
        at = np.frombuffer(decoded.buffers()[1], np.int64)
        data = memoryview(decoded.buffers()[2] or b"")
        ends = np.cumsum([len(x) for x in samples]).tolist()
        out = []
        for sample, text, end in zip(samples, texts, ends):
            same = not text
            if len(sample):
                found = self.spelled[sample[0]] + data[at[end - len(sample) + 1] : at[end]]
                same = text[:1] != " " and found == text.encode("utf-8", "surrogatepass") or self.model.decode(sample) == text
            out.append(same)
        return out

    def _table(self) -> list[tuple]:
        """Per length: hashes of all beginnings of pieces, sorted, where each value of their first bits begins
        among them, and the piece's id (-1: none) and weight."""
        out = []
        for length in range(1, max(map(len, self.weight)) + 1):
            parts = sorted({p[:length] for p in self.weight if len(p) >= length})
            sums, scale, _ = _running("".join(parts))
            key = _part_hash(sums, scale, np.arange(len(parts)) * length, length)
            order = np.argsort(key)
            found = [self.weight.get(parts[k], (-1, 0.0)) for k in order]
            key = np.append(key[order], np.uint64(2**64 - 1))
            begin = np.searchsorted(key, np.arange(1 << KEY_BITS, dtype=np.uint64) << np.uint64(64 - KEY_BITS))
            out.append((key, begin, np.array([f[0] for f in found] + [-1]), np.array([f[1] for f in found] + [0.0])))
        return out

    def split(self, text: str | None) -> list[str]:
        """The words of a text, as the model sees them: a blank before the text, blanks as their sign."""
        if not text:
            return []
        seen = SPACE + text.replace(" ", SPACE)
        return [seen] if self.words is None else self.words.findall(seen)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts: how many a text has, and the first state of each."""
        if any(t and CUT in t for t in texts):
            split = [self.split(t) for t in texts]
            return np.array([len(t) for t in split]), self.build([w for t in split for w in t])
        parts = pc.split_pattern(pa.array(map(self._marked, texts), pa.large_string()), CUT)
        words = parts.flatten()
        real = pc.greater(pc.binary_length(words), 0)
        sizes = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[parts.offsets.to_numpy()])
        coded = words.filter(real).dictionary_encode()
        return sizes, self.build(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]

    def _marked(self, text: str | None) -> str:
        """The text as the model sees it, with a mark between words."""
        if not text:
            return ""
        seen = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            return seen
        if SPACE * 2 in seen:  # blanks in a row begin one word
            return CUT.join(self.words.findall(seen))
        seen = seen.replace(SPACE, CUT + SPACE)
        return seen.replace("\n", f"{CUT}\n{CUT}") if self.lines else seen

    def _edges(self, ends: np.ndarray, text: str) -> tuple[np.ndarray, ...]:
        """Target (-1: the word's end), piece and weight of all edges by their states, and where each state's begin."""
        sums, scale, points = _running(text)
        active, found = np.arange(len(points)), []
        count = np.zeros(len(points), np.int64)
        plain = np.zeros(len(points), bool)
        for length, (keys, begin, ids, weights) in enumerate(self.begins, 1):
            active = active[active + length <= ends[active]]
            if not len(active):
                break
            key = _part_hash(sums, scale, active, length)
            at = begin[key >> np.uint64(64 - KEY_BITS)]
            below = np.flatnonzero(keys[at] < key)
            while len(below):
                at[below] += 1
                below = below[keys[at[below]] < key[below]]
            known = keys[at] == key
            active, at = active[known], at[known]
            piece = ids[at] >= 0
            source, at = active[piece], at[piece]
            if length == 1:
                plain[source] = True
            rank = count[source]  # shorter pieces come first
            found.append((source, rank, source + length, ids[at], weights[at]))
            count[source] = rank + 1
        extra, chained = [], len(points) + 1  # one more than a word's end may be
        for place in np.flatnonzero(~plain).tolist():  # characters without a piece: their bytes, one after another
            data = chr(points[place]).encode("utf-8", "surrogatepass")
            source = place
            for k, b in enumerate(data):
                last = k == len(data) - 1
                rank = int(count[place]) if k == 0 else 0
                extra.append((source, rank, place + 1 if last else chained, self.byte[b], self.rare * len(data) if k == 0 else 0.0))
                source = chained
                chained += not last
        if extra:
            count[~plain] += 1
            count = np.concatenate((count, (0,), np.ones(chained - len(points) - 1, np.int64)))
            found.append([np.array(e) for e in zip(*extra)])
        first = np.append(0, np.cumsum(count))
        columns = np.empty(first[-1], np.int64), np.empty(first[-1], np.int32), np.empty(first[-1])
        for source, rank, *values in found:
            at = first[source] + rank
            for column, value in zip(columns, values):
                column[at] = value
        return (*columns, first)

    def build(self, words: list[str]) -> np.ndarray:
        """Make the lattices of those of these words that are not at hand; returns the first state of each."""
        if self.edges > KEPT_EDGES:
            self._forget()
        code = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > self.words_kept:
            new = list(islice(self.number, self.words_kept, None))
            for a in range(0, len(new), BUILT_AT_ONCE):
                self._add(new[a : a + BUILT_AT_ONCE])
        return self.root[code]

    def _add(self, words: list[str]) -> None:
        """Lattices of these words, behind those at hand."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.cumsum(sizes)
        end_of = np.repeat(bounds, sizes)
        target, piece, weight, first = self._edges(end_of, "".join(words))
        n = len(end_of)
        count = np.diff(first)
        source = np.repeat(np.arange(len(count)), count)
        # beta: log of the summed weights of all ways from a state to its word's end, from the ends backwards
        beta = np.zeros(len(count) + 1)
        places = int(first[n])  # edges from characters come first in the order of states
        done = np.zeros(len(source), bool)
        done[:places] = ended = target[:places] == np.repeat(end_of, count[:n])
        follow = target
        # a byte's chain leads to the place behind its character, which is nearer to the end than the character
        if places < len(source):
            inner = source < n
            chain_end = ~inner & (target <= n)
            owner = source.copy()
            start_of = {int(t): int(s) for s, t in zip(source[inner & (target > n)], target[inner & (target > n)])}
            for e in np.flatnonzero(~inner).tolist():
                owner[e] = start_of.setdefault(int(source[e]), owner[e])
                if target[e] > n:
                    start_of[int(target[e])] = int(owner[e])
            done[chain_end] = target[chain_end] == end_of[owner[chain_end]]
            follow = target.copy()
            long = inner & (target > n)  # what follows a chain is what follows its character
            follow[long] = source[long] + 1
            ended = follow[:places] == np.repeat(end_of, count[:n])
        distance = end_of - np.arange(n)
        short = distance.max(initial=0) < 1 << 16
        near = np.argsort(distance.astype(np.uint16) if short else distance, kind="stable")
        many = count[near]
        begin = np.append(0, np.cumsum(many))
        by = np.repeat(first[near] - begin[:-1], many) + np.arange(places)  # edges by the distance of their states
        at, behind = weight[by], np.where(ended, n, follow[:places])[by]  # beta is 0 at n
        values = np.empty(places)
        cuts = np.append(0, np.cumsum(np.bincount(distance)[1:])).tolist() if n else [0]
        for left, right in zip(cuts[:-1], cuts[1:]):
            if left == right:
                continue
            low, high = begin[left], begin[right]
            value = np.add(at[low:high], beta[behind[low:high]], out=values[low:high])
            starts = begin[left:right] - low
            top = np.maximum.reduceat(value, starts)
            spread = value - np.repeat(top, many[left:right])
            beta[near[left:right]] = top + np.log(np.add.reduceat(np.exp(spread, out=spread), starts))
        logp = np.zeros(len(source))
        logp[by] = values - np.repeat(beta[near], many)
        taken = np.flatnonzero(count)
        starts, count = first[taken], count[taken]
        chance = np.exp(logp)
        total = np.add.reduceat(chance, starts)
        running = np.cumsum(chance)
        upper = np.minimum((running - np.repeat(running[starts] - chance[starts], count)) / np.repeat(total, count), 1.0)
        upper[starts + count - 1] = 1.0
        self._put("root", self.words_kept, bounds - sizes + self.states)
        self._put("first", self.states + 1, first[1:] + self.edges)
        self._put("source", self.edges, source + self.states)
        self._put("next", self.edges, np.where(done, -1, target + self.states))
        for name, values in (("piece", piece), ("logp", logp), ("upper", upper)):
            self._put(name, self.edges, values)
        self.words_kept, self.states, self.edges = self.words_kept + len(words), self.states + len(first) - 1, self.edges + len(source)

    def cost(self, edges: np.ndarray) -> np.ndarray:
        """How much the edges take off a path's log probability; nothing where there is no other."""
        return 0.0 - np.minimum(self.logp[edges], 0.0)


def _running(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and scales from which the hash of any part of the text follows, and its code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(len(points) + 1, np.uint64(x)) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:-1], out=sums[1:])
    return sums, np.multiply.accumulate(down), points


def _part_hash(sums: np.ndarray, scale: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return mix((sums[start + length] - sums[start]) * scale[start])


_lattices: dict[tuple, Lattices] = {}


def lattices(path: str, power: float) -> Lattices:
    if (path, power) not in _lattices:
        _lattices[path, power] = Lattices(path, power)
    return _lattices[path, power]


def _part(x: np.ndarray, k: int, part) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + (np.asarray(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)))


def _mixed(seed: np.ndarray, *parts) -> np.ndarray:
    """A hash of the seed and the parts."""
    for k, part in enumerate(parts):
        seed = _part(seed, k, part)
    return seed


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, by a hash of the seed and the parts."""
    return _unit(_mixed(seed, *parts))


def _log_mass(cost: float) -> float:
    """Log of the probability to leave a path somewhere on a stretch that costs so much."""
    return math.log(-math.expm1(-cost)) if cost > 0 else -math.inf


def _below(place: float, bound: float, uniform: float) -> float:
    """A Gumbel variable at ``place`` that is known to lie below ``bound``."""
    if place == -math.inf:
        return place
    a, b = place - bound, math.log(-math.log(uniform))
    high = max(a, b)
    return min(place - high - math.log1p(math.exp(min(a, b) - high)), bound)


class _Text:
    """The paths of a text found so far, and the sets of those not found: value, path, places, log probability up to them.

    A set holds the paths that leave a known one at a place from ``low`` to before ``high``; or at ``low``, by none of the edges ``old``.
    """

    def __init__(self):
        self.paths: list[tuple] = []
        self.sets: list[tuple] = []

    def add(self, edges: np.ndarray, units: np.ndarray, cost: np.ndarray, total: float, low: int, before: float, bound: float, uniform: float) -> None:
        """A path, and the set of those that leave it from ``low`` on; ``total`` is the cost of that stretch."""
        self.paths.append((edges, units, cost))
        self._keep(before + _log_mass(total), bound, uniform, low, len(edges), before, total, None, len(self.paths) - 1)

    def _keep(self, place, bound, uniform, low, high, before, total, old, path) -> None:
        value = _below(place, bound, uniform)
        if value > -math.inf:
            self.sets.append((value, path, low, high, before, total, old))

    def best(self) -> float:
        return max((s[0] for s in self.sets), default=-math.inf)

    def open(self, lat: Lattices, draws: list[float]) -> tuple:
        """Take the set with the largest value apart: path left, place, edge taken there instead, and log probability up to the place."""
        k = max(range(len(self.sets)), key=lambda i: self.sets[i][0])
        value, path, low, high, before, total, old = self.sets.pop(k)
        edges, _, cost = self.paths[path]
        if old is None:
            goal = -math.log1p(draws[0] * math.expm1(-total))
            size = 64
            while True:  # the first place up to which more than the goal is spent; most often a near one
                spent = np.cumsum(cost[low : min(low + size, high)])
                at = int(np.searchsorted(spent, goal, side="right"))
                if at < len(spent) or low + size >= high:
                    break
                size *= 8
            if at == len(spent):  # by rounding
                at = int(np.flatnonzero(cost[low:high])[-1])
            place, upto = low + at, float(spent[at - 1]) if at else 0.0
            self._keep(before + _log_mass(upto), value, draws[2], low, place, before, upto, None, path)
            left = total - float(spent[at])
            if left < 1:  # too near to what was taken off
                left = float(cost[place + 1 : high].sum())
            behind = before - float(spent[at])
            self._keep(behind + _log_mass(left), value, draws[3], place + 1, high, behind, left, None, path)
            before, old = before - upto, (int(edges[place]),)
        else:
            place = low
        here = lat.source[old[0]]
        begin, end = lat.first[here : here + 2].tolist()
        free = [e for e in range(begin, end) if e not in old]
        chance = [math.exp(x) for e, x in enumerate(lat.logp[begin:end].tolist(), begin) if e not in old]
        goal, chosen = draws[1] * sum(chance), free[-1]
        for e, c in zip(free, chance):
            goal -= c
            if goal < 0:
                chosen = e
                break
        rest = sum(c for e, c in zip(free, chance) if e != chosen)
        if rest > 0:
            self._keep(before + math.log(rest), value, draws[4], place, place + 1, before, 0.0, (*old, chosen), path)
        return value, path, place, chosen, before - max(-float(lat.logp[chosen]), 0.0)


def _walk(lat: Lattices, state: np.ndarray, unit: np.ndarray, seed: np.ndarray, depth: np.ndarray, round_: int):
    """Draw edges from the given states to the ends of their words; edges and units, in order of units."""
    active = np.flatnonzero(state >= 0)
    active = active[np.argsort(state[active])]  # equal words together
    state, drawn = state[active], _mixed(seed[active], 2 * round_ + 2, depth[active])
    count = np.zeros(len(unit), np.int64)
    found = []
    for a in range(0, len(active), WALKED_AT_ONCE):
        rows = active[a : a + WALKED_AT_ONCE]
        steps = _steps(lat, state[a : a + WALKED_AT_ONCE], drawn[a : a + WALKED_AT_ONCE])
        own = np.zeros(len(rows), np.int64)
        for at, _ in steps:
            own[at] += 1
        count[rows] = own
        found.append((rows, steps))
    begin = np.cumsum(count) - count
    edges = np.empty(int(count.sum()), np.int64)
    for rows, steps in found:
        place = begin[rows]
        for step, (at, edge) in enumerate(steps):
            edges[place[at] + step] = edge
    return edges, np.repeat(unit, count)


def _steps(lat: Lattices, state: np.ndarray, drawn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Step by step, which of the states given are not at their words' ends yet, and the edges drawn from there."""
    steps = []
    row = np.arange(len(state))
    upper = lat.upper
    while len(state):
        aim = _unit(_part(drawn, 2, len(steps)))
        first, edge = lat.first.take(state), lat.first.take(state + 1) - 1
        back = np.flatnonzero((edge > first) & (upper.take(edge - 1) > aim))
        own, low, goal = edge.take(back) - 1, first.take(back), aim.take(back)
        while len(back):  # from the longest piece, as a rule the likeliest, to the first one whose sum exceeds the draw
            edge[back] = own
            on = np.flatnonzero((own > low) & (upper.take(own - 1) > goal))
            back, own, low, goal = back.take(on), own.take(on) - 1, low.take(on), goal.take(on)
        steps.append((row, edge))
        state = lat.next.take(edge)
        on = np.flatnonzero(state >= 0)
        state, drawn, row = state.take(on), drawn.take(on), row.take(on)
    return steps


def sample_texts(lat: Lattices, texts: list[list[str]], seeds: np.ndarray, count: int) -> list[list[tuple]]:
    """Per text, given its words, up to ``count`` samples: ids, log probability, value, inclusion."""
    root = lat.build([w for t in texts for w in t])
    return sample_words(lat, np.array([len(t) for t in texts]), root, seeds, count)


def sample_words(lat: Lattices, sizes: np.ndarray, root: np.ndarray, seeds: np.ndarray, count: int) -> list[list[tuple]]:
    """Per text up to ``count`` samples, from the largest perturbed value down: ids, log probability, value, inclusion.

    Texts are given by the number of words of each and the first states of all.
    """
    n = len(sizes)
    cut = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(n), sizes)
    depth = np.arange(len(root)) - cut[doc]
    edge, unit = _walk(lat, root, np.arange(len(root)), seeds[doc], depth, 0)
    ends = np.searchsorted(unit, cut).tolist()
    value = (-np.log(-np.log(_uniform(seeds, np.full(n, 0))))).tolist()
    cost = lat.cost(edge)
    first = _uniform(seeds, 1, 5).tolist()
    books = []
    found = []
    for a, b, v, u in zip(ends[:-1], ends[1:], value, first):
        edges, costs, text = edge[a:b], cost[a:b], _Text()
        total = float(costs.sum())
        text.add(edges, unit[a:b], costs, total, 0, 0.0, v, u)
        books.append(text)
        found.append([(edges, -total, v)])
    for number in range(1, count):
        more = [d for d in range(n) if books[d].sets]
        if not more:
            break
        draws = np.stack([_uniform(seeds[more], 1000 + number, k) for k in range(6)], axis=1).tolist()
        taken = [books[d].open(lat, u) for d, u in zip(more, draws)]
        left = np.array([books[d].paths[path][1][place] for d, (_, path, place, _, _) in zip(more, taken)])
        # the rest of the opened word, then the words behind it
        stop = cut[np.array(more) + 1]
        long = stop - left
        part = np.repeat(np.arange(len(more)), long)
        heads = np.cumsum(long) - long
        walk_unit = np.arange(len(part)) + np.repeat(left - heads, long)
        walk_state = root[walk_unit]
        walk_state[heads] = lat.next[[t[3] for t in taken]]
        edge, unit = _walk(lat, walk_state, walk_unit, seeds[more][part], walk_unit - np.repeat(cut[more], long), number)
        cost = lat.cost(edge)
        starts, stops = np.searchsorted(unit, left).tolist(), np.searchsorted(unit, stop).tolist()
        for d, a, b, (top, path, place, chosen, before), draw in zip(more, starts, stops, taken, draws):
            old, units, _ = books[d].paths[path]
            edges, units = np.concatenate((old[:place], (chosen,), edge[a:b])), np.concatenate((units[: place + 1], unit[a:b]))
            costs = np.zeros(len(edges))  # those before are never asked for
            costs[place + 1 :] = tail = cost[a:b]
            total = float(tail.sum())
            books[d].add(edges, units, costs, total, place + 1, before, top, draw[5])
            found[d].append((edges, before - total, top))
    out = []
    for d in range(n):
        top = books[d].best()
        out.append([
            (lat.piece[e], float(lp), v, 1.0 if top == -math.inf else -math.expm1(-math.exp(min(lp - top, 700.0))))
            for e, lp, v in found[d]
        ])
    return out


def sample_segmentations(
    docs: DataFrame, model: str, samples: int = SAMPLES, power: float = 1.0, with_ids: bool = True
) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every text: a row for each, from the best draw down.

    sample (from 1), n_pieces, log_prob (of the segmentation, given the text), draw (its perturbed value),
    inclusion (the chance that it is among the samples, given the value at which they end; 1 if there are no
    others), ids_crc32, decoded (whether the model decodes the ids to the text) and the ids where asked for.
    Null and empty texts have one segmentation, without pieces. Rows are seeded by doc_id and text: repeated
    rows get equal samples, rows without id are seeded by their text. Texts that hold the blank's sign U+2581
    decode to a blank there. Other columns are left aside.
    """
    ship(docs.sparkSession)
    schema = "doc_id decimal(20,0), sample int, n_pieces long, log_prob double, draw double, inclusion double, ids_crc32 long, decoded boolean"
    schema += ", ids array<int>" if with_ids else ""
    columns = [f.split()[0] for f in schema.split(", ")]

    def work(lat: Lattices, ids: list, texts: list, seeds: list) -> pd.DataFrame:
        rows = []
        found = sample_words(lat, *lat.read(texts), np.array(seeds, np.int64).view(np.uint64), samples)
        seen = [(text or "").replace(SPACE, " ") for text in texts]
        same = iter(lat.decodes([s[0] for own in found for s in own], [text for text, own in zip(seen, found) for _ in own]))
        for doc_id, own in zip(ids, found):
            for number, (pieces, log_prob, draw, inclusion) in enumerate(own, 1):
                row = (doc_id, number, len(pieces), round(log_prob, 9), round(draw, 9), float(f"{inclusion:.9g}"), zlib.crc32(pieces.astype("<u4").tobytes()), next(same))
                rows.append((*row, pieces) if with_ids else row)
        return pd.DataFrame(rows, columns=columns)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattices(model, power)
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"], batch["seed"]):
                for part, value in zip(held, row):
                    part.append(value)
                size += len(row[1] or "")
                if size >= TEXT_AT_ONCE:
                    yield work(lat, *held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield work(lat, *held)

    seeded = docs.select(exact_id(), F.xxhash64("doc_id", "text").alias("seed"), "text")
    return plain_id(seeded.mapInPandas(sample, schema))


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Adds ``text``, the ids decoded; null ids give null."""
    ship(encoded.sparkSession)
    schema = StructType(list(encoded.schema)).add("text", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattices(model, 1.0)
        for batch in batches:
            yield batch.assign(text=[None if x is None else lat.model.decode([int(i) for i in x]) for x in batch[ids]])

    return encoded.mapInPandas(run, schema)


def piece_bpe() -> str:
    """Place of the public SentencePiece model that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
