"""SentencePiece encoding and decoding, and Gumbel top-k sampling of segmentations without replacement.

A text's lattice is a chain of chunks that no piece crosses (runs of spaces with what follows up to the next space, cut
further at characters that only occur alone), each a small lattice of pieces. A segmentation is a leaf of the tree
whose inner nodes are decisions "which piece comes next"; a node's mass is known from backward sums. Each leaf has a
Gumbel-perturbed log-probability; the k largest are k segmentations drawn without replacement. They are found top
down by A* search: a node's perturbed value is the largest of its leaves, so a best-first queue holds, for each
path found so far, what branches off it at each decision ("the other pieces"), with Gumbels truncated at the
path's own. Popping the largest opens the branch and walks it to its end. Decisions are taken for all documents of a
batch at once; random numbers are hashes of the row's key, the sample and the place, so batches don't matter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, trim
from .shingles import mixed

SPACE = "▁"
WINDOW = 32  # decisions whose branches get a queue entry of their own; those behind share one until it is popped
_EDGES = 1_500_000  # edges of lattices that a worker keeps: some 40 MB with their nodes and names
_SEEN = 1 << 20  # marks of chunks that were seen once
_CHARS = 125_000  # characters of texts that are worked on at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniform(h: np.ndarray) -> np.ndarray:
    return ((mixed(h) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a model with the weights for sampling: Zipf's law over the order in which the pieces were merged.

    A character that is no piece has the number ``size`` plus its code point, and is spelled by the ids of its bytes.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        kept = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in kept}
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.longest = max(map(len, self.ids))
        rank = np.full(self.size, float(self.size))
        for n, i in enumerate(sorted(kept, key=lambda i: -sp.get_score(i))):
            rank[i] = n
        weight = 1 / (rank + 10)
        self.logp = alpha * np.log(weight / weight[kept].sum())
        #: By piece, and last that of a character that is none.
        self.weights = np.append(self.logp, self.logp.min() * 1.5)
        #: Sums over chunks up to this length stay inside a double's range without logarithms.
        self.short = max(1, int(600 / max(1e-9, -self.weights[-1])))
        self._trie()
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_high = np.zeros(self.size, bool)
        for b, i in self.bytes.items():
            self.is_high[i] = b >= 128
            self.text[i] = chr(b)
        inside = set("".join(s for s in self.ids if len(s) > 1)) - {SPACE}
        joined = re.escape("".join(sorted(inside)))
        self.chunks = re.compile(f"{SPACE}+[{joined}]*|[{joined}]+|.", re.DOTALL).findall

    def _trie(self) -> None:
        """The trie of all pieces as a hash table: (state, letter) -> state. State 0 is the root, and "none" elsewhere."""
        letters = sorted(set("".join(self.ids)))
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        states, keys, ends = {"": 0}, [], [-1]
        number = {c: i for i, c in enumerate(letters, 1)}
        for piece in sorted(self.ids, key=len):
            at = 0
            for n in range(1, len(piece) + 1):
                head = piece[:n]
                state = states.get(head)
                if state is None:
                    state = states[head] = len(ends)
                    keys.append(at * (len(letters) + 1) + number[piece[n - 1]])
                    ends.append(-1)
                at = state
            ends[at] = self.ids[piece]
        self.ends, self.width = np.array(ends), len(letters) + 1
        keys = np.array(keys, np.int64)
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.slot_key, self.slot_state = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.slot_key[slot[left]] < 0]
            self.slot_key[slot[free]] = keys[free]  # of several in one slot the last stays
            won = self.slot_key[slot[left]] == keys[left]
            self.slot_state[slot[left[won]]] = left[won] + 1
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _STEP) >> np.uint64(30)).astype(np.int64) & self.mask

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states that letters lead to; 0 where there is none."""
        keys = state.astype(np.int64) * self.width + letter
        slot = self._slot(keys)
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_state[slot], 0)
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            held = self.slot_key[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.slot_state[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def normal(self, text: str | None) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Ids with characters that are no piece spelled by the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids
        code = ids[odd].astype(np.int64) - self.size
        size = np.searchsorted([0x80, 0x800, 0x10000], code, side="right") + 1
        counts = np.ones(len(ids), np.int64)
        counts[odd] = size
        out = np.repeat(ids, counts)
        starts = (np.cumsum(counts) - counts)[odd]
        for n in range(1, int(size.max()) + 1):
            own = size == n
            for j in range(n):
                bits = code[own] >> 6 * (n - 1 - j)
                out[starts[own] + j] = self.byte_ids[bits if n == 1 else bits & 0x3F | 0x80 if j else bits | (0xF00 >> n & 0xFF)]
        return out


class Lattices:
    """Chunk lattices in flat arrays. Node: a position in a chunk; edges of a node follow each other; search: their cdf.

    Chunks that were seen in an earlier batch are kept, up to _EDGES edges; others are made for their batch only, so
    that rare ones don't displace frequent ones. What is kept never changes a result.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.seen = bytearray(_SEEN)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.base, self.end = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.kinds = self.edges = self.nodes = 0
        self.kept = (0, 0, 0)
        self.first = np.zeros(4096, np.int64)
        self.search, self.logq = np.zeros(8192, np.float32), np.zeros(8192)
        self.piece, self.step = np.zeros(8192, np.int32), np.zeros(8192, np.int8)

    def _room(self, names: list[str], used: int, more: int) -> None:
        for name in names:
            a = getattr(self, name)
            if used + more > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(len(a) // 2, used + more - len(a)), a.dtype)]))

    def types(self, chunks: list[str]) -> np.ndarray:
        """The lattice of each chunk; those made for the batch before are gone."""
        self.kinds, self.nodes, self.edges = self.kept
        found = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if self.edges >= _EDGES and 2 * len(missing) > len(chunks):  # other texts than those it was made for
            self.clear()
            found[:], missing = -1, np.arange(len(chunks))
        names = [chunks[i] for i in missing.tolist()]
        again, once = [], []
        for c in dict.fromkeys(names):
            h = hash(c) & (_SEEN - 1)
            (again if self.seen[h] and len(c) <= 64 and self.edges < _EDGES else once).append(c)
            self.seen[h] = 1
        base = self.kinds
        for part in (again, once):
            part.sort(key=lambda c: len(c) > self.v.short)  # the order in which they are made
        self._add(again)
        self.at.update(zip(again, range(base, base + len(again)), strict=True))
        self.kept = self.kinds, self.nodes, self.edges
        self._add(once)
        number = dict(zip([*again, *once], range(base, self.kinds), strict=True))
        found[missing] = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        return found

    def _add(self, chunks: list[str]) -> None:
        near = [c for c in chunks if len(c) <= self.v.short]
        for i in range(0, len(near), 20_000):
            self._build(near[i : i + 20_000], False)
        if len(near) < len(chunks):
            self._build([c for c in chunks if len(c) > self.v.short], True)

    def _build(self, cs: list[str], logs: bool) -> None:
        """Append the lattices of chunks; with ``logs`` sums are taken in logarithms."""
        v = self.v
        lengths = np.fromiter(map(len, cs), np.int64, len(cs))
        codes = np.frombuffer("".join(cs).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = v.letter[codes]
        n, ends = len(codes), np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)  # characters from here to the chunk's end
        # All pieces at all positions, by walking the trie one character further at a time.
        at, state = np.arange(n), v.step(np.zeros(n, np.int64), letters)
        ids = v.ends[state]
        ids = np.where(ids < 0, v.size + codes.astype(np.int64), ids)
        parts, size = [(at, ids, 1)], np.ones(n, np.int64)
        on = np.flatnonzero((state > 0) & (left > 1))
        k = 1
        while len(on):
            at = at[on]
            state = v.step(state[on], letters[at + k])
            k += 1
            ids = v.ends[state]
            has = ids >= 0
            parts.append((at[has], ids[has], k))
            size[at[has]] += 1
            on = np.flatnonzero((state > 0) & (left[at] > k))
        # Nodes by distance to the chunk's end, so that the edges of one distance are a slice.
        near = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65_536 else left, kind="stable")
        place = np.empty(n + 1, np.int64)
        place[near] = np.arange(n)
        sizes = size[near]
        first = np.concatenate([[0], np.cumsum(sizes)])
        piece, step, then = np.empty(first[-1], np.int32), np.empty(first[-1], np.int8), np.empty(first[-1], np.int64)
        fill = first[:-1][place[:n]]
        for at, ids, k in reversed(parts):  # longer pieces first: they are the likelier ones
            e = fill[at]
            fill[at] += 1
            piece[e], step[e] = ids, k
            then[e] = np.where(left[at] > k, place[np.minimum(at + k, n)], n)
        x = v.weights[np.minimum(piece, v.size)]
        cuts = np.searchsorted(left[near], np.arange(1, int(left.max()) + 2)) if n else np.zeros(1, int)
        if logs:
            beta = np.zeros(n + 1)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, starts = slice(first[a], first[b]), first[a:b] - first[a]
                x[own] += beta[then[own]]
                top = np.maximum.reduceat(x[own], starts)
                beta[a:b] = top + np.log(np.add.reduceat(np.exp(x[own] - np.repeat(top, sizes[a:b])), starts))
            logq = x - np.repeat(beta[:n], sizes)
        else:
            x, beta = np.exp(x), np.ones(n + 1)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = slice(first[a], first[b])
                x[own] *= beta[then[own]]
                beta[a:b] = np.add.reduceat(x[own], first[a:b] - first[a])
            logq = np.log(x / np.repeat(beta[:n], sizes))
        # Back to the order of the text.
        begin = np.cumsum(size) - size
        e = np.arange(first[-1]) + np.repeat(first[:-1][place[:n]] - begin, size)
        logq = np.minimum(logq[e], 0.0)
        q = np.exp(logq)
        total = np.cumsum(q)
        cdf = total - np.repeat((total - q)[begin], size)
        cdf[begin + size - 1] = 1.0
        self._room(["search", "logq", "piece", "step"], self.edges, len(e))
        self._room(["first"], self.nodes, n + 1)
        self._room(["base", "end"], self.kinds, len(cs))
        own = slice(self.edges, self.edges + len(e))
        self.search[own], self.logq[own], self.piece[own], self.step[own] = cdf, logq, piece[e], step[e]
        self.first[self.nodes : self.nodes + n] = self.edges + begin
        self.first[self.nodes + n] = self.edges + len(e)
        self.base[self.kinds : self.kinds + len(cs)] = self.nodes + ends - lengths
        self.end[self.kinds : self.kinds + len(cs)] = self.nodes + ends
        self.kinds, self.edges, self.nodes = self.kinds + len(cs), self.edges + len(e), self.nodes + n

    def node_of(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[: self.nodes + 1], edges, side="right") - 1

    def others(self, edges: np.ndarray) -> np.ndarray:
        """For each edge the logarithm of the mass of its node's other edges; minus infinity if it has none."""
        if not len(edges):
            return np.empty(0)
        node = self.node_of(edges)
        starts = self.first[node]
        size = self.first[node + 1] - starts
        cut = np.cumsum(size) - size
        e = np.arange(int(size.sum())) + np.repeat(starts - cut, size)
        x = self.logq[e]
        x[e == np.repeat(edges, size)] = -np.inf
        top = np.maximum.reduceat(x, cut)
        with np.errstate(divide="ignore"):
            return np.where(np.isfinite(top), top, 0) + np.log(np.add.reduceat(np.exp(x - np.repeat(np.where(np.isfinite(top), top, 0), size)), cut))

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decide from each (node, end) on: (edges in order, how many of each)."""
        at, place, stop = np.arange(len(node)), node, end
        taken, who = [], []
        count = np.zeros(len(node), np.int64)
        while len(at):
            u = uniform(key + np.uint64(len(taken) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            e = self.first[place]
            behind = np.flatnonzero(u >= self.search[e])
            while len(behind):
                e[behind] += 1
                behind = behind[u[behind] >= self.search[e[behind]]]
            taken.append(e)
            who.append(at)
            count[at] += 1
            place = place + self.step[e]
            on = np.flatnonzero(place < stop)
            at, place, stop, key = at[on], place[on], stop[on], key[on]
        out = np.empty(int(count.sum()), np.int64)
        starts = np.cumsum(count) - count
        for i, (e, w) in enumerate(zip(taken, who, strict=True)):
            out[starts[w] + i] = e
        return out, count


class _Path:
    """Decisions of one found segmentation: the few it shares with the path it branched off, and those it walked."""

    def __init__(self, prefix, prefix_chunks, prefix_logq, edges, counts, first_chunk, logq, total, value):
        self.prefix, self.prefix_chunks, self.prefix_logq = prefix, prefix_chunks, prefix_logq
        self.edges, self.counts, self.first_chunk, self.walked = edges, counts, first_chunk, logq
        self.logp, self.value, self.size = float(prefix_logq.sum() + total), value, len(prefix) + len(edges)

    def _cut(self, head: np.ndarray, rest: np.ndarray, start: int, stop: int) -> np.ndarray:
        n = len(head)
        return rest[start - n : stop - n] if start >= n else np.concatenate([head[start:stop], rest[: max(0, stop - n)]])

    def edges_at(self, start: int, stop: int) -> np.ndarray:
        return self._cut(self.prefix, self.edges, start, stop)

    def logq_at(self, start: int, stop: int) -> np.ndarray:
        return self._cut(self.prefix_logq, self.walked, start, stop)

    def chunks_at(self, stop: int) -> np.ndarray:
        """The chunk of each of the first ``stop`` decisions."""
        n = stop - len(self.prefix)
        if n <= 0:
            return self.prefix_chunks[:stop]
        walked = np.repeat(np.arange(min(n, len(self.counts))), self.counts[:n])[:n]
        return np.concatenate([self.prefix_chunks, self.first_chunk + walked])


class _Search:
    """The A* search of one document."""

    def __init__(self, lattices: Lattices, key: int, wanted: int):
        self.x, self.key, self.wanted, self.queue, self.paths, self.tick = lattices, key, wanted, [], [], 0

    def draw(self, n: int) -> np.ndarray:
        self.tick += 1
        return uniform(np.arange(n, dtype=np.uint64) * _STEP + np.uint64((self.key ^ (self.tick * 0x632BE59BD9B4E019)) & 0xFFFFFFFFFFFFFFFF))

    def push(self, gumbel: float, entry: tuple) -> None:
        self.tick += 1
        heapq.heappush(self.queue, (-gumbel, self.tick, entry))

    def branches(self, path: int, start: int, gumbel: float, attained: bool, others: np.ndarray | None = None) -> None:
        """Queue what branches off a path from decision ``start`` on; ``attained``: one of these has the value ``gumbel``.

        ``others`` may give the masses beside the next WINDOW decisions. No branch is left out for its small mass.
        """
        p = self.paths[path]
        stop = min(p.size, start + WINDOW)
        edges, logq = p.edges_at(start, stop), p.logq_at(start, stop)
        before = np.cumsum(np.append(p.logq_at(0, start).sum(), logq))
        phi = before[:-1] + (self.x.others(edges) if others is None else others)
        if stop < p.size:  # all that keeps to the path up to there, but for the path itself
            rest = p.logq_at(stop, p.size).sum()
            if rest > -1e-6:  # nearly certain decisions, whose own logarithms are too coarse
                rest = -np.exp(self.x.others(p.edges_at(stop, p.size))).sum()
            phi = np.append(phi, before[-1] + (np.log(-np.expm1(rest)) if rest < 0 else -np.inf))
        g = phi - np.log(-np.log(self.draw(len(phi))))
        if attained and len(g) and np.isfinite(g.max()):
            shift = np.exp(np.minimum(g - g.max(), 0))
            value = gumbel - np.log1p(np.maximum((1 - shift) / np.maximum(shift, 1e-300) * np.exp(np.minimum(gumbel - g.max(), 700)), 0))
        else:
            value = -np.logaddexp(-gumbel, -g)
        # At most `wanted` more entries of this queue are ever looked at, so what is behind as many better ones isn't.
        live = np.flatnonzero(np.isfinite(phi))
        for i in live[np.argsort(-value[live], kind="stable")[: self.wanted]].tolist():
            self.push(float(value[i]), ("tail", path, stop) if i == stop - start else ("branch", path, start + i, frozenset([int(edges[i])])))

    def pop(self):
        """The next path's (path, decision, node, edge, value), or None if there is no other."""
        while self.queue:
            value, _, entry = heapq.heappop(self.queue)
            value = -value
            if entry[0] == "tail":
                self.branches(entry[1], entry[2], value, True)
                continue
            _, path, at, used = entry
            p = self.paths[path]
            first = self.x.first
            node = int(self.x.node_of(p.edges_at(at, at + 1)[0]))
            options = [e for e in range(first[node], first[node + 1]) if e not in used]
            logq = self.x.logq[options]
            mass = np.exp(logq - logq.max())
            c = int(min(np.searchsorted(np.cumsum(mass) / mass.sum(), self.draw(1)[0]), len(options) - 1))
            if len(options) > 1:
                left = np.delete(logq, c)
                left = left.max() + np.log(np.exp(left - left.max()).sum())
                g = float(p.logq_at(0, at).sum() + left) - np.log(-np.log(self.draw(1)[0]))
                self.push(float(-np.logaddexp(-value, -g)), ("branch", path, at, used | {options[c]}))
            return path, at, node, options[c], value
        return None


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def sample_batch(x: Lattices, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log-probability, perturbed value, log inclusion score), by falling value."""
    v = x.v
    split = [v.chunks(v.normal(t)) for t in texts]
    bounds = _starts(np.fromiter(map(len, split), np.int64, len(split)))
    flat = x.types([c for s in split for c in s])
    types = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    del split
    searches = [_Search(x, key, k + 1) for key in keys]
    none = np.empty(0, np.int64)
    # (document, first chunk, node inside that chunk or -1, prefix: edges, chunks, log-probabilities; value)
    jobs = [(i, 0, -1, none, none, np.empty(0), float(-np.log(-np.log(searches[i].draw(1)[0])))) for i, t in enumerate(types) if len(t)]
    pieces: list[list[np.ndarray]] = [[] for _ in texts]
    while jobs:
        walked = [types[j[0]][j[1] :] for j in jobs]
        at = _starts(np.array([len(w) for w in walked]))
        every = np.concatenate(walked)
        node, end = x.base[every], x.end[every]
        for j, a in zip(jobs, at.tolist(), strict=False):
            if j[2] >= 0:
                node[a] = j[2]
        seeds = mixed(np.array([(keys[j[0]] + len(searches[j[0]].paths) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF for j in jobs], np.uint64))
        numbers = np.arange(len(every)) - np.repeat(at[:-1] - np.array([j[1] for j in jobs]), np.diff(at))
        edges, counts = x.walk(node, end, mixed(numbers.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.repeat(seeds, np.diff(at))))
        cut = _starts(np.add.reduceat(counts, at[:-1]))
        logq, piece = x.logq[edges], x.piece[edges]
        total = np.add.reduceat(logq, cut[:-1])
        width = np.minimum(np.diff(cut), WINDOW)
        window = _starts(width)
        others = x.others(edges[np.arange(window[-1]) + np.repeat(cut[:-1] - window[:-1], width)])
        nexts = []
        for n, (i, chunk, _, prefix, chunks, prefix_logq, value) in enumerate(jobs):
            own = slice(cut[n], cut[n + 1])
            s = searches[i]
            s.paths.append(_Path(prefix, chunks, prefix_logq, edges[own], counts[at[n] : at[n + 1]], chunk, logq[own], total[n], value))
            pieces[i].append(np.concatenate([x.piece[prefix], piece[own]]) if len(prefix) else piece[own])
            s.branches(len(s.paths) - 1, len(prefix), value, False, others[window[n] : window[n + 1]])
            if len(s.paths) < k and (branch := s.pop()):
                path, d, place, edge, found = branch
                p = s.paths[path]
                chunks = p.chunks_at(d + 1)
                number, after = int(chunks[d]), place + int(x.step[edge])
                inside = after < x.end[types[i][number]]
                nexts.append((i, number if inside else number + 1, after if inside else -1, np.append(p.edges_at(0, d), edge), chunks, np.append(p.logq_at(0, d), x.logq[edge]), found))
        # A branch in a text's last piece may leave nothing to walk.
        jobs = []
        for job in nexts:
            i, chunk, _, prefix, chunks, prefix_logq, value = job
            if chunk < len(types[i]):
                jobs.append(job)
                continue
            s = searches[i]
            while True:
                s.paths.append(_Path(prefix, chunks, prefix_logq, none, none, chunk, np.empty(0), 0.0, value))
                pieces[i].append(x.piece[prefix])
                if len(s.paths) == k or not (branch := s.pop()):
                    break
                path, d, place, edge, value = branch
                p = s.paths[path]
                chunks = p.chunks_at(d + 1)
                number, after = int(chunks[d]), place + int(x.step[edge])
                inside = after < x.end[types[i][number]]
                prefix, prefix_logq = np.append(p.edges_at(0, d), edge), np.append(p.logq_at(0, d), x.logq[edge])
                chunk = number if inside else number + 1
                if chunk < len(types[i]):
                    jobs.append((i, chunk, after if inside else -1, prefix, chunks, prefix_logq, value))
                    break
    out = []
    for i, s in enumerate(searches):
        if not len(types[i]):
            out.append([(np.empty(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        bound = -s.queue[0][0] if s.queue else -np.inf
        rows = []
        for p, ids in zip(s.paths, pieces[i], strict=True):
            ids = v.spelled(ids)
            d = p.logp - bound
            inclusion = 0.0 if d > 30 else d if d < -30 else float(np.log(-np.expm1(-np.exp(d))))
            rows.append((ids, p.logp, p.value, inclusion))
        out.append(rows)
    return out


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 4, alpha: float = 0.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` rows per input row: (doc_id, sample, ids, log_prob, value, log_inclusion, decodes).

    ``ids`` are piece ids of a segmentation of the whole text, different for each sample of a row and drawn without
    replacement in proportion to the product of piece weights to the power ``alpha``; ``value`` is the perturbed
    log-probability by which samples are ordered, ``log_inclusion`` the logarithm of the chance that a draw of k with
    this threshold includes the segmentation. ``decodes`` says that the ids give the text back (a literal ▁ comes
    back as a blank, as the library's decoder has it). Rows draw by their id (null: as 0), so reruns agree; rows that
    repeat an id and text repeat its samples. Texts with fewer than k segmentations give all they have; a null or empty
    text gives one row without ids. Texts of any length are used whole. Other columns are not read; an empty table
    gives no rows. A map without any exchange.
    """

    @lean
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        x = Lattices(Vocabulary(model_path, alpha))
        pieces = np.array(x.v.text, object)
        for b in batches:
            ids_in, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") <= _CHARS):
                    chars += len(texts[j] or "")
                    j += 1
                keys = [xxhash.xxh3_64_intdigest(f"{seed}:{d if d is not None else 0}") for d in ids_in[i:j]]
                found = sample_batch(x, texts[i:j], keys, k)
                doc, no, ids, logp, value, inclusion, good = [], [], [], [], [], [], []
                for d, t, rows in zip(ids_in[i:j], texts[i:j], found, strict=True):
                    whole = x.v.normal(t)
                    for s, row in enumerate(rows):
                        doc.append(d)
                        no.append(s)
                        ids.append(row[0])
                        logp.append(row[1])
                        value.append(row[2])
                        inclusion.append(row[3])
                        good.append(decode(x.v, pieces, row[0]) == whole)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), lists, pa.array(logp, pa.float64()), pa.array(value, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(good, pa.bool_())],
                    ["doc_id", "sample", "ids", "log_prob", "value", "log_inclusion", "decodes"],
                )
                i = j
            trim()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, sample int, ids array<int>, log_prob double, value double, log_inclusion double, decodes boolean")


def decode(v: Vocabulary, pieces: np.ndarray, ids: np.ndarray) -> str:
    """The normal form (blanks as ▁) that ids stand for; runs of byte ids above ASCII are put together as UTF-8."""
    high = np.flatnonzero(v.is_high[ids]) if len(ids) else ids
    if not len(high):
        return "".join(pieces[ids].tolist())
    out = pieces[ids].tolist()
    runs = np.split(high, np.flatnonzero(np.diff(high) > 1) + 1)
    for run in runs:
        out[run[0]] = bytes(v.byte_of[i] for i in ids[run].tolist()).decode("utf-8", "surrogatepass")
        for i in run[1:]:
            out[i] = ""
    return "".join(out)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the library's own encoding of each text; null texts count as empty."""

    @F.pandas_udf("array<int>")
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for s in parts:
            yield pd.Series(sp.encode(s.tolist(), num_threads=1))

    return docs.select(F.col(id_col).alias("doc_id"), run(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
