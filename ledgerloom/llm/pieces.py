"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement over the lattice.

The lattice of a text has a node between any two characters and an edge for each piece of a public vocabulary that fits there; a character
that is no piece is an edge of byte pieces. A piece's weight is ``-sharpness * ln(rank + offset)`` by its rank in the vocabulary, and a segmentation's
probability is proportional to the product of its edges' weights. Forward sums give each edge's exact probability given its end.

Adding Gumbel noise to all segmentations' log-probabilities and taking the k largest samples k of them without replacement. A* search finds
these without listing segmentations: the best of the whole lattice is an exact sample, found by walking edges; for every decision on its
walk, the segmentations that leave it there form a subtree whose largest perturbed value is a Gumbel variable at the subtree's mass, truncated
at the value of the walk. The subtree with the largest bound holds the next segmentation; it is sampled by taking another edge there and walking
on, and gives new subtrees. The best bound that remains after k gives the inclusion probabilities: 1 - exp(-exp(log p - bound)).

Spaces become the space mark and a mark is put in front, as the public model does; no piece crosses from a character to a mark, so
lattices are built once for each distinct unit between such places of a slice. All steps are numpy over slices of bounded size, and noise
is hashed from the row's key and the decision's place, so a row's samples depend on its key and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import INVERSE, MULTIPLIER, by_bytes, mixed, powers, range_hashes, tidy

#: Stands for the space mark; no character has this code.
MARK = 0x110000
SLICE = 3 << 18
_BITS = 21


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _spread(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(0x51ED270B))


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model that can be read as text, their byte pieces, and a hash table from pieces to places."""

    texts: list[str]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    longest: int
    known: np.ndarray  # sorted codes of the characters of all pieces
    keys: np.ndarray
    first: np.ndarray
    second: np.ndarray
    raw: list[bytes | None]  # what a piece stands for, by id

    def __post_init__(self):
        self.is_known = np.zeros(MARK + 1, bool)
        self.is_known[self.known] = True
        self.raw_size = np.array([len(x or b"") for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_data = np.frombuffer(b"".join(x or b"" for x in self.raw), np.uint8)

    @classmethod
    def load(cls, path: str, sharpness: float = 1.0, offset: float = 10.0) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        texts = [m.id_to_piece(i) for i in ids]
        byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        rank = np.argsort(np.argsort([-m.get_score(i) for i in ids], kind="stable"), kind="stable")
        weights = -sharpness * np.log(rank + offset)
        return cls.of(texts, np.array(ids, np.int32), weights, byte_ids, float(-sharpness * np.log(len(ids) + offset)))

    @classmethod
    def of(cls, texts: list[str], ids: np.ndarray, weights: np.ndarray, byte_ids: np.ndarray, byte_weight: float) -> Vocabulary:
        codes = [_codes(t) for t in texts]
        for c in codes:
            c[c == 0x2581] = MARK
            if (c[1:] == MARK).any() and not (c == MARK).all():
                raise ValueError("a piece has a space mark behind another character")
        size = np.array([len(c) for c in codes])
        flat, ends = np.concatenate(codes), np.cumsum(size)
        keys = range_hashes(_spread(flat), ends - size, ends)
        # Proper prefixes of pieces that are no pieces follow the pieces, so that a search can end where no piece goes on.
        at = np.arange(len(flat)) - np.repeat(ends - size, size)
        prefixes = range_hashes(_spread(flat), np.repeat(ends - size, size), np.arange(len(flat)) + 1)[at < np.repeat(size, size) - 1]
        keys = np.concatenate((keys, np.setdiff1d(prefixes, keys)))
        first, second = np.full(1 << _BITS, -1, np.int32), np.full(1 << _BITS, -1, np.int32)
        mask = np.uint64((1 << _BITS) - 1)
        for k, (a, b) in enumerate(zip((keys & mask).tolist(), ((keys >> np.uint64(32)) & mask).tolist())):
            if first[a] < 0:
                first[a] = k
            elif second[b] < 0:
                second[b] = k
            else:
                raise ValueError("the hash table is too small for this vocabulary")
        raw: list[bytes | None] = [None] * (int(max(ids.max(), byte_ids.max())) + 1)
        for b, i in enumerate(byte_ids):
            raw[i] = bytes((b,))
        for i, t in zip(ids, texts):
            raw[i] = t.replace("▁", " ").encode("utf-8", "surrogatepass")
        return cls(texts, ids, weights, byte_ids, byte_weight, int(size.max()), np.unique(flat), keys, first, second, raw)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of pieces by hash, or -1."""
        mask = np.uint64((1 << _BITS) - 1)
        out = self.first[(hashes & mask).astype(np.int64)]
        miss = (out < 0) | (self.keys[out] != hashes)
        at = np.flatnonzero(miss & (out >= 0))
        out[miss] = -1
        if len(at):
            other = self.second[((hashes[at] >> np.uint64(32)) & mask).astype(np.int64)]
            out[at] = np.where((other >= 0) & (self.keys[other] == hashes[at]), other, -1)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: marks are spaces, bytes are joined, and the mark in front goes."""
        raw = self.raw
        s = b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")
        return s[1:] if ids else s

    def spelled(self, segmentations: list[np.ndarray]) -> list[bytes]:
        """What each of these segmentations decodes to, as UTF-8."""
        ids = np.concatenate([np.zeros(0, np.int32), *segmentations])
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        data = self.raw_data[np.repeat(self.raw_start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(x) for x in segmentations])))].tolist()
        return [data[a + (a < b) : b] for a, b in zip(bounds, bounds[1:])]


class Lattices:
    """Lattices of distinct units: node numbers run through all of them."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Units are codes[start:end], not empty."""
        size = ends - starts
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat = codes[np.repeat(starts, size) + at]
        left = np.repeat(size, size) - at  # characters from here to the unit's end
        # Nodes are numbered by depth, and within a depth by unit, the longest units first.
        longest = int(size.max(initial=0))
        reach = np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1]  # units of at least so many characters
        base = np.concatenate(([0], np.cumsum(reach)))
        place = np.empty(len(size), np.int64)
        place[np.argsort(-size, kind="stable")] = np.arange(len(size))
        unit = np.repeat(place, size)
        nodes = int(base[-1])
        spread = _spread(flat)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * powers(MULTIPLIER, len(flat)))))
        inverse = powers(INVERSE, len(flat) + 1)
        pieces = len(v.ids)
        found = []
        live = np.arange(len(flat))
        for n in range(1, v.longest + 1):
            live = live[left[live] >= n]
            if not len(live):
                break
            k = v.find(mixed((sums[live + n] - sums[live]) * inverse[live] + np.uint64(n)))
            if n == 1:
                none = live[(k < 0) | (k >= pieces)]
                c = flat[none]
                width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                width = np.where(c == MARK, 3, width)
                found.append((base[at[none]] + unit[none], base[at[none] + 1] + unit[none], -1 - c, width * v.byte_weight))
            hit = (k >= 0) & (k < pieces)
            here, piece = live[hit], k[hit]
            found.append((base[at[here]] + unit[here], base[at[here] + n] + unit[here], piece, v.weights[piece]))
            live = live[k >= 0]
        # By target, and the longest first: of a node's edges these are the likeliest, so a walk rarely looks further.
        many = sum((np.bincount(t, minlength=nodes) for _, t, _, _ in found), np.zeros(nodes, np.int64))
        self.first = np.concatenate(([0], np.cumsum(many)))  # edges of a node by its number
        total = int(self.first[-1])
        self.source, self.target, self.piece, w = np.empty(total, np.int32), np.repeat(np.arange(nodes, dtype=np.int32), many), np.empty(total, np.int32), np.empty(total)
        free = self.first[:-1].copy()
        while found:
            e_from, e_to, piece, weight = found.pop()
            to = free[e_to]
            free[e_to] += 1
            self.source[to], self.piece[to], w[to] = e_from, piece, weight
        self.end = base[size] + place
        self.starts = len(size)  # the first nodes are units' starts
        alpha, self.log_p = np.zeros(nodes), np.empty(total)
        for d in range(1, longest + 1):
            lo, hi = int(self.first[base[d]]), int(self.first[base[d + 1]])
            new = self.first[base[d] : base[d + 1]] - lo
            x = alpha[self.source[lo:hi]] + w[lo:hi]
            times = many[base[d] : base[d + 1]]
            top = np.maximum.reduceat(x, new)
            alpha[base[d] : base[d + 1]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, times)), new))
            self.log_p[lo:hi] = x - np.repeat(alpha[base[d] : base[d + 1]], times)
        self.p = p = np.exp(self.log_p)
        del w, alpha, free, spread, inverse
        sums = np.cumsum(p)
        # Within a node the shares rise to 1; the last edge takes what rounding leaves.
        self.share = np.minimum(sums - np.concatenate(([0.0], sums))[np.repeat(self.first[:-1], many)], 1.0)
        self.share[self.first[1:][many > 0] - 1] = 1.0
        self.ids = np.where(self.piece >= 0, v.ids[np.maximum(self.piece, 0)], -1)

    def walk(self, nodes: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node back to its unit's start: (which walk, edge), in the order of walks and steps. seed: one 64-bit value for each walk."""
        which, edges = [], []
        live = np.flatnonzero(nodes >= self.starts)
        at = nodes[live]
        step = 0
        while len(live):
            u = _uniform(seed[live], step)
            e = self.first[at]
            # The last edge's share is 1, over any u.
            on = np.flatnonzero(self.share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.share[e[on]] <= u[on]]
            which.append(live)
            edges.append(e)
            at = self.source[e]
            on = at >= self.starts
            live, at = live[on], at[on]
            step += 1
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, e = np.concatenate(which), np.concatenate(edges)
        order = np.argsort(w, kind="stable")
        return w[order], e[order]


def _uniform(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    x = mixed(seed + mixed(np.atleast_1d(np.asarray(step, np.uint64)) + np.uint64(0xA0761D6478BD642F)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _truncated(bound: np.ndarray, gumbel: np.ndarray) -> np.ndarray:
    """A Gumbel variable, given that it is no more than ``bound``, from the variable without this condition; the order of variables with one bound stays."""
    return np.where(np.isneginf(gumbel), -np.inf, -np.logaddexp(-bound, -gumbel))


@dataclass
class Sample:
    rank: int
    pieces: np.ndarray
    log_prob: float
    value: float
    inclusion: float

    @property
    def ids(self) -> list[int]:
        return self.pieces.tolist()


class _Leaves:
    """One segmentation of each of some texts: decisions in order with their subtrees' bounds."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, unit: np.ndarray, edge: np.ndarray, logs: np.ndarray, value: np.ndarray, branch: np.ndarray, banned: dict[int, list[int]], lattices: Lattices, seed: np.ndarray):
        self.text, self.bounds, self.unit, self.edge, self.value, self.branch, self.banned = text, bounds, unit, edge, value, branch, banned
        size = np.diff(bounds)
        sums = np.concatenate(([0.0], np.cumsum(logs)))
        self.total = sums[bounds[1:]] - sums[bounds[:-1]]
        before = sums[:-1] - np.repeat(sums[bounds[:-1]], size)
        at = np.arange(len(edge)) - np.repeat(bounds[:-1], size)
        with np.errstate(divide="ignore"):
            mass = before + np.log(np.maximum(1 - lattices.p[edge], 0))
        for k, edges in banned.items():
            left = 1 - lattices.p[[*edges, int(edge[bounds[k] + branch[k]])]].sum()
            mass[bounds[k] + branch[k]] = before[bounds[k] + branch[k]] + (np.log(left) if left > 1e-12 else -np.inf)
        self.best = mass - np.log(-np.log(_uniform(np.repeat(seed, size), at)))  # not yet truncated at the walk's value
        self.best[at < np.repeat(branch, size)] = -np.inf  # these belong to the parents

    def tops(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest bound of each text and its decision; -inf where nothing is left."""
        value, place = np.full(n, -np.inf), np.zeros(n, np.int64)
        filled = np.flatnonzero(np.diff(self.bounds) > 0)
        if len(filled):
            top = np.maximum.reduceat(self.best, self.bounds[filled])
            value[self.text[filled]] = _truncated(self.value[filled], top)
            of = np.repeat(np.arange(len(filled)), np.diff(self.bounds)[filled])
            hit = np.flatnonzero(self.best == top[of])
            place[self.text[filled[of[hit[::-1]]]]] = hit[::-1]
        return value, place


def segment(v: Vocabulary, texts: list[str], keys: list[str], k: int, seed: int = 0) -> list[list[Sample]]:
    """Up to k distinct sampled segmentations of each text, from the largest perturbed log-probability on. An empty text has one, without pieces."""
    n = len(texts)
    out: list[list[Sample]] = [[] if t else [Sample(1, np.zeros(0, np.int32), 0.0, 0.0, 1.0)] for t in texts]
    used = [i for i, t in enumerate(texts) if t]
    if not used:
        return out
    parts = [_codes(" " + texts[i]) for i in used]
    size = np.array([len(c) for c in parts])
    codes = np.concatenate(parts)
    codes[codes == 32] = MARK
    doc_start = np.zeros(len(codes), bool)
    doc_start[np.cumsum(size) - size] = True
    mark = codes == MARK
    alone = ~mark & ~v.is_known[codes]
    cut = doc_start.copy()
    cut[1:] |= (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(codes))
    _, sample, unit = np.unique(range_hashes(_spread(codes), starts, ends), return_index=True, return_inverse=True)
    lattices = Lattices(v, codes, starts[sample], ends[sample])
    doc_of = np.cumsum(doc_start[starts]) - 1  # of each unit's occurrence
    unit_bounds = np.searchsorted(doc_of, np.arange(len(used) + 1))
    inner = np.arange(len(unit)) - unit_bounds[doc_of]
    seeds = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{keys[i]}".encode(), digest_size=8).digest(), "little") for i in used], np.uint64)

    def walk_seed(rank: int, docs: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mixed(seeds[docs] + np.array([rank], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + mixed(place.astype(np.uint64) + np.uint64(77))

    logs = lattices.log_p
    which, edge = lattices.walk(lattices.end[unit], walk_seed(1, doc_of, inner))
    everyone = np.arange(len(used))
    first = -np.log(-np.log(_uniform(mixed(seeds + np.uint64(5)), 1)))
    leaves = [_Leaves(everyone, np.searchsorted(doc_of[which], np.arange(len(used) + 1)), which, edge, logs[edge], first, np.zeros(len(used), np.int64), {}, lattices, mixed(seeds + np.uint64(9)))]
    found: list[list[tuple[int, int]]] = [[(0, i)] for i in range(len(used))]
    for rank in range(2, k + 2):
        tops = [x.tops(len(used)) for x in leaves]
        value = np.stack([t for t, _ in tops])
        parent = value.argmax(axis=0)
        value = value.max(axis=0)
        if rank == k + 1:
            break
        go = np.flatnonzero(~np.isneginf(value))
        if not len(go):
            break
        begin, start_seed, banned, head_unit, head_edge, branch = [], [], {}, [], [], []
        draw = _uniform(mixed(seeds + np.uint64(13)), rank)
        for j, d in enumerate(go.tolist()):
            x = leaves[parent[d]]
            place = int(tops[parent[d]][1][d])
            row = int(np.searchsorted(x.text, d))
            lo = int(x.bounds[row])
            x.best[place] = -np.inf
            out_edges = [int(x.edge[place])] + (x.banned.get(row, []) if place - lo == x.branch[row] else [])
            node = int(lattices.target[out_edges[0]])
            choice = [e for e in range(int(lattices.first[node]), int(lattices.first[node + 1])) if e not in out_edges]
            p = lattices.p[choice]
            pick = choice[min(int(np.searchsorted(np.cumsum(p), draw[d] * p.sum(), side="right")), len(choice) - 1)]
            banned[j] = out_edges
            branch.append(place - lo)
            head_unit.append(np.append(x.unit[lo:place], x.unit[place]))
            head_edge.append(np.append(x.edge[lo:place], pick))
            u = int(x.unit[place])
            begin.append(np.concatenate(([lattices.source[pick]], lattices.end[unit[u + 1 : unit_bounds[d + 1]]])))
            start_seed.append(np.arange(u, int(unit_bounds[d + 1])))
        occurrence = np.concatenate(start_seed)
        which, edge = lattices.walk(np.concatenate(begin), walk_seed(rank, doc_of[occurrence], inner[occurrence]))
        which = occurrence[which]
        row = np.searchsorted(go, doc_of[which])
        tail = np.searchsorted(row, np.arange(len(go) + 1))
        new_unit = np.concatenate([y for j in range(len(go)) for y in (head_unit[j], which[tail[j] : tail[j + 1]])])
        new_edge = np.concatenate([y for j in range(len(go)) for y in (head_edge[j], edge[tail[j] : tail[j + 1]])])
        bounds = np.concatenate(([0], np.cumsum([len(head_edge[j]) + int(tail[j + 1] - tail[j]) for j in range(len(go))])))
        leaves.append(_Leaves(go, bounds, new_unit, new_edge, logs[new_edge], value[go], np.array(branch), banned, lattices, mixed(seeds[go] + np.uint64(9 + rank))))
        for j, d in enumerate(go.tolist()):
            found[d].append((len(leaves) - 1, j))
    ordered = [_forward(x, lattices, v) for x in leaves]
    for d, i in enumerate(used):
        for rank, (leaf, row) in enumerate(found[d], 1):
            x = leaves[leaf]
            log_prob = float(x.total[row])
            chance = -np.expm1(-np.exp(np.minimum(log_prob - value[d], 700.0))) if not np.isneginf(value[d]) else 1.0
            out[i].append(Sample(rank, ordered[leaf][row], log_prob, float(x.value[row]), float(chance)))
    return out


def _forward(x: _Leaves, lattices: Lattices, v: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each segmentation in the order of the text: a unit's decisions run from its end."""
    begin = np.flatnonzero(np.diff(x.unit, prepend=-1))
    end = np.append(begin[1:], len(x.unit))
    edge = x.edge[np.repeat(begin + end - 1, end - begin) - np.arange(len(x.edge))]
    ids, bounds = lattices.ids[edge], x.bounds
    lacking = np.flatnonzero(ids < 0)
    if len(lacking):
        codes, which = np.unique(-1 - lattices.piece[edge[lacking]], return_inverse=True)
        spelled = [v.byte_ids[list((" " if c == MARK else chr(c)).encode("utf-8", "surrogatepass"))] for c in codes.tolist()]
        many = np.ones(len(ids), np.int64)
        many[lacking] = np.array([len(y) for y in spelled])[which]
        place = np.concatenate(([0], np.cumsum(many)))
        ids = np.repeat(ids, many)
        for j, y in enumerate(spelled):
            at = place[lacking[which == j]]
            for d, i in enumerate(y.tolist()):
                ids[at + d] = i
        bounds = place[bounds]
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _encode(v: Vocabulary, k: int, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                keys = part.column("id").to_pylist()
                found = segment(v, texts, ["" if x is None else str(x) for x in keys], k, seed)
                flat = [(i, s) for i, x in enumerate(found) for s in x]
                take = pa.array([i for i, _ in flat], pa.int64())
                columns = {
                    "id": part.column("id").take(take),
                    "rank": pa.array([s.rank for _, s in flat], pa.int32()),
                    "n_pieces": pa.array([len(s.pieces) for _, s in flat], pa.int64()),
                    "log_prob": pa.array([s.log_prob for _, s in flat], pa.float64()),
                    "inclusion": pa.array([s.inclusion for _, s in flat], pa.float64()),
                }
                if digest:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(s.pieces.astype("<i4").tobytes()).hexdigest() for _, s in flat], pa.string())
                    columns["lossless"] = pa.array([x == texts[i].encode("utf-8", "surrogatepass") for x, (i, _) in zip(v.spelled([s.pieces for _, s in flat]), flat)], pa.bool_())
                else:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s.pieces) for _, s in flat]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(s.pieces for _, s in flat)]), pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, key: str, text: str, model: str, k: int = 2, seed: int = 0, digest: bool = False, **weights) -> DataFrame:
    """Up to k rows for each row: id, rank, n_pieces, log_prob, inclusion, and ids, or with ``digest`` ids_sha256 and whether decoding gives the text back.

    Null and empty texts have one segmentation without pieces. Rows of one key and text have the same samples; a null key counts as an empty
    one. Whole texts are encoded; other columns are ignored, and an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    v = Vocabulary.load(model, **weights)
    schema = f"id {kind}, rank int, n_pieces long, log_prob double, inclusion double, " + ("ids_sha256 string, lossless boolean" if digest else "ids array<int>")
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(_encode(v, k, seed, digest)), schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the texts of its pieces; null pieces give null. A column named ``text`` is replaced."""
    v = Vocabulary.load(model)
    rest = [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([None if x is None else v.decode(x) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, text])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest) + f", `{text}` string"
    return encoded.select(*rest).mapInArrow(run, schema)
