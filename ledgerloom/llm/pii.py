"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network adds spans that no pattern has, as phone numbers without a plus or card numbers
whose check digit is wrong. It is trained in numpy, by gradients through time and through the CRF's partition function, on labelled spans that
a seeded generator writes into invented text; the same seed gives the same model everywhere. Training is bounded by ``steps``.

All four kinds hold a digit or an @ by their definition. So windows are laid where one is: the text is divided into cores of 32
characters; a core with such a character and its neighbours are read, each as the window of 64 characters around it. Overlapping windows'
emissions are averaged, and each stretch of adjoining windows is decoded as one sequence by the Viterbi algorithm, so spans over the borders of windows come
out whole. Whole texts are read; memory is bounded by the number of windows in a batch, and a long text's stretch is decoded step by step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.llm.common import by_bytes, tidy

KINDS = ["email", "ip", "card", "phone"]
#: Outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
CORE, SIDE = 32, 16
WINDOW = CORE + 2 * SIDE
SLICE, BATCH, GROUP = 1 << 22, 512, 1 << 13

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds from left to right, in linear time: from each @ to both sides."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    if not _TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


#: Characters of a class of their own; the others fall into digits, small, capital and other letters, spaces and the rest.
_OWN = "@._%+-():/#,;\"'=|"
CLASSES = len(_OWN) + 6


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.full(0x10000, CLASSES - 1, np.int8)
    t[128:] = len(_OWN) + 3
    t[[9, 10, 11, 12, 13, 32]] = len(_OWN) + 4
    t[48:58] = len(_OWN)
    t[97:123] = len(_OWN) + 1
    t[65:91] = len(_OWN) + 2
    for k, c in enumerate(_OWN):
        t[ord(c)] = k
    return t


def classes_of(text: str) -> np.ndarray:
    return _table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]


class Network:
    """Both directions of the LSTM are held in stacked arrays. With classes as inputs, an embedding is the input's share of the gates."""

    def __init__(self, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.p = {
            "x": r.normal(0, 0.3, (2, CLASSES + 1, 4 * hidden)).astype(np.float32),
            "h": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)).astype(np.float32),
            "o": r.normal(0, 0.2, (2, hidden, TAGS)).astype(np.float32),
            "b": np.zeros(TAGS, np.float32),
            "t": np.zeros((TAGS, TAGS), np.float32),
            "s": np.zeros(TAGS, np.float32),
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 0.5  # remember at first
        self.hidden = hidden

    def emit(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Emissions (time, batch, tag) of windows (batch, time) of classes; CLASSES pads."""
        n, time = x.shape
        p, k = self.p, self.hidden
        both = np.stack([x.T, x.T[::-1]])
        h = np.zeros((2, n, k), np.float32)
        c = np.zeros((2, n, k), np.float32)
        hs = np.empty((time, 2, n, k), np.float32)
        for t in range(time):
            z = np.matmul(h, p["h"])
            z[0] += p["x"][0][both[0, t]]
            z[1] += p["x"][1][both[1, t]]
            g = np.tanh(z[:, :, 3 * k :])
            s = 1 / (1 + np.exp(-z[:, :, : 3 * k]))
            before, old = c, h
            c = s[:, :, k : 2 * k] * c + s[:, :, :k] * g
            tc = np.tanh(c)
            h = s[:, :, 2 * k :] * tc
            hs[t] = h
            if tape is not None:
                tape.append((both[:, t], old, before, s, g, tc))
        out = np.matmul(hs[:, 0], p["o"][0]) + np.matmul(hs[::-1, 1], p["o"][1]) + p["b"]
        if tape is not None:
            tape.append(hs)
        return out

    def gradients(self, tape: list, d: np.ndarray) -> dict[str, np.ndarray]:
        """From the emissions' gradients d (time, batch, tag)."""
        p, k = self.p, self.hidden
        hs = tape.pop()
        time, n = d.shape[:2]
        out = {a: np.zeros_like(v) for a, v in p.items()}
        out["b"] = d.sum((0, 1))
        back = d[::-1]
        out["o"][0] = np.einsum("tnk,tng->kg", hs[:, 0], d, optimize=True)
        out["o"][1] = np.einsum("tnk,tng->kg", hs[:, 1], back, optimize=True)
        dh_all = np.stack([np.matmul(d, p["o"][0].T), np.matmul(back, p["o"][1].T)], axis=1)
        dh, dc = np.zeros((2, n, k), np.float32), np.zeros((2, n, k), np.float32)
        dz = np.empty((2, n, 4 * k), np.float32)
        turned = p["h"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            x, old, before, s, g, tc = tape[t]
            dh = dh + dh_all[t]
            i, f, o = s[:, :, :k], s[:, :, k : 2 * k], s[:, :, 2 * k :]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, :, :k] = dc * g * i * (1 - i)
            dz[:, :, k : 2 * k] = dc * before * f * (1 - f)
            dz[:, :, 2 * k : 3 * k] = dh * tc * o * (1 - o)
            dz[:, :, 3 * k :] = dc * i * (1 - g * g)
            out["h"] += np.matmul(old.transpose(0, 2, 1), dz)
            for j in range(2):
                one = np.zeros((n, CLASSES + 1), np.float32)
                one[np.arange(n), x[j]] = 1
                out["x"][j] += one.T @ dz[j]
            dh = np.matmul(dz, turned)
            dc = dc * f
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(e: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags y (time, batch), and gradients of emissions, transitions and start."""
    time, n, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = start + e[0]
    for t in range(1, time):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(time - 2, -1, -1):
        beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    d = np.exp(alpha + beta - z[None, :, None])
    rows = np.arange(n)
    gold = start[y[0]] + e[0, rows, y[0]]
    dt = np.zeros_like(trans)
    for t in range(1, time):
        gold = gold + trans[y[t - 1], y[t]] + e[t, rows, y[t]]
        dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[t - 1], y[t]), -1)
    ds = d[0].sum(0)
    np.add.at(ds, y[0], -1)
    tt, nn = np.meshgrid(np.arange(time), rows, indexing="ij")
    d[tt, nn, y] -= 1
    return float((z - gold).mean()), d / n, dt / n, ds / n


def viterbi(e: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (time, batch) of sequences padded to one time."""
    score, back = forward(e, 0, None, length, trans, start)
    return backtrack(score, [back])


def forward(e: np.ndarray, at: int, score: np.ndarray | None, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after the emissions of times from ``at`` on, given the scores before, and for each time and tag the best tag before it."""
    time, n, k = e.shape
    back = np.zeros((time, n, k), np.int8)
    for t in range(time):
        if score is None:
            score = start + e[0]
            continue
        both = score[:, :, None] + trans
        live = (at + t < length)[:, None]
        back[t] = np.where(live, both.argmax(1), np.arange(k))
        score = np.where(live, both.max(1) + e[t], score)
    return score, back


def backtrack(score: np.ndarray, backs: list[np.ndarray]) -> np.ndarray:
    """The tags (time, batch) that lead to the best scores."""
    tag, rows = score.argmax(1), np.arange(len(score))
    out = np.zeros((sum(map(len, backs)), len(score)), np.int8)
    at = len(out)
    for back in reversed(backs):
        for t in range(len(back) - 1, -1, -1):
            at -= 1
            out[at] = tag
            tag = back[t][rows, tag]
    return out


def labelled(r: np.random.Generator) -> tuple[str, np.ndarray]:
    """One invented text of a window and a half's length at least, with the tags of its characters."""
    pick = lambda s: s[int(r.integers(len(s)))]
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    syllables = ["the", "an", "er", "in", "re", "on", "at", "en", "nd", "ti", "es", "or", "éa", "ü", "ción", "ß", "la", "de", "eau", "sch", "ó"]

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))
        return pick([w, w, w, w.capitalize(), w + pick(".,;:|"), w + pick(["###", "$$$", "%%%", "***", "!!"])])

    def name() -> str:
        return "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(r.integers(2, 9))))

    def email() -> str:
        return name() + pick(["", ".", "_", "+", "-"]) + pick([name(), digits(2)]) + "@" + name() + pick(["", digits(1)]) + "." + pick(["example.com", "example.org", "net", "co.uk"])

    def ip() -> str:
        return ".".join(str(x) for x in r.integers(0, 256, 4))

    def card() -> str:
        d, gap = digits(16), pick(["", "", " ", "-"])
        return gap.join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}-{a}-{c}"])

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(r.integers(20, 41))))
        return pick([digits(int(r.integers(1, 7))), f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f'token = "{hexes}"', hexes, f"{digits(2)}%", "@" + name(), f"version {digits(1)}.{digits(1)}", f"n° {digits(3)}", f"({digits(4)})", f"CC BY-NC {digits(1)}.0."])

    text, tags = "", []
    while len(text) < WINDOW + CORE:
        u = r.random()
        kind = int(r.integers(4)) if u < 0.22 else -1
        piece = [email, ip, card, phone][kind]() if kind >= 0 else other() if u < 0.34 else word()
        text += piece
        tags += [0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
        gap = pick([" ", " ", " ", " ", "\n", ", ", ". ", " | "])
        text += gap
        tags += [0] * len(gap)
    return text, np.array(tags, np.int8)


def samples(r: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.empty((n, WINDOW), np.int64), np.empty((n, WINDOW), np.int64)
    for k in range(n):
        text, tags = labelled(r)
        at = int(r.integers(0, len(text) - WINDOW + 1))
        x[k], y[k] = classes_of(text)[at : at + WINDOW], tags[at : at + WINDOW]
    return x, y


@lru_cache(maxsize=4)
def trained(hidden: int = 16, steps: int = 180, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Network:
    """The same arguments give the same model."""
    r = np.random.default_rng(seed)
    net = Network(hidden, seed)
    one = {a: np.zeros_like(v) for a, v in net.p.items()}
    two = {a: np.zeros_like(v) for a, v in net.p.items()}
    for step in range(1, steps + 1):
        x, y = samples(r, batch)
        tape: list = []
        e = net.emit(x, tape)
        _, d, dt, ds = crf_loss(e, y.T, net.p["t"], net.p["s"])
        g = net.gradients(tape, d)
        g["t"], g["s"] = dt, ds
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for a, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            one[a] = 0.9 * one[a] + 0.1 * v
            two[a] = 0.99 * two[a] + 0.01 * v * v
            net.p[a] -= (now * (one[a] / (1 - 0.9**step)) / (np.sqrt(two[a] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _digits(s: str) -> bool:
    """Whether there are only digits of ASCII; others, such as superscripts, are no numbers to ``int``."""
    return s.isascii() and s.isdigit()


def _plausible(kind: int, s: str) -> bool:
    """What a kind's definition asks of every span."""
    digits = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        return s.count("@") == 1 and "." in s.split("@")[1] and not s.startswith("@") and s[-1].isalnum()
    if kind == 1:
        return s.count(".") == 3 and all(_digits(x) and len(x) <= 3 and int(x) <= 255 for x in s.split("."))
    if kind == 2:
        return 13 <= digits <= 19 and _digits(s[0]) and _digits(s[-1]) and digits + sum(c in " -" for c in s) == len(s)
    return 10 <= digits <= 15 and _digits(s[-1]) and s[0] in "+(0123456789" and all(c in "+(). -0123456789" for c in s)


def _decoded(net: Network, padded: list[np.ndarray], first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tags (time, stretch) of stretches of ``size`` adjoining cores from core ``first`` on, of texts as padded classes.

    Each place has the mean of the emissions of the windows that reach it. Windows are read some cores at a time; what is held for a whole stretch is one byte a
    place and tag, and sums at places that later windows reach too are carried on.
    """
    n, longest = len(size), int(size.max())
    length = size * CORE + 2 * SIDE
    each = max(1, BATCH // n)
    open_sums, open_times = np.zeros((2 * SIDE, n, TAGS), np.float32), np.zeros((2 * SIDE, n, 1), np.float32)
    score, backs = None, []
    for at in range(0, longest, each):
        cores = min(each, longest - at)
        sums, times = (np.concatenate((o, np.zeros((cores * CORE, *o.shape[1:]), np.float32))) for o in (open_sums, open_times))
        here = [(j, c) for j in range(n) for c in range(at, min(at + cores, int(size[j])))]
        if here:
            x = np.stack([padded[j][(first[j] + c) * CORE : (first[j] + c) * CORE + WINDOW] for j, c in here])
            for (j, c), e in zip(here, net.emit(x).transpose(1, 0, 2)):
                place = (c - at) * CORE
                sums[place : place + WINDOW, j] += e
                times[place : place + WINDOW, j] += 1
        done = len(sums) if at + cores == longest else cores * CORE
        score, back = forward(sums[:done] / np.maximum(times[:done], 1), at * CORE, score, length, net.p["t"], net.p["s"])
        backs.append(back)
        open_sums, open_times = sums[done:], times[done:]
    return backtrack(score, backs)


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of like size that are decoded together, at most BATCH, and of GROUP cores when all are as long as the longest; a longer one is by itself."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < BATCH and int(size[order[to]]) * (to - at + 1) <= GROUP:
            to += 1
        yield order[at:to]
        at = to


def model_spans(net: Network, texts: list[str]) -> list[list[Span]]:
    """What the network finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    padded: dict[int, np.ndarray] = {}
    rows, firsts, sizes = [], [], []
    for k, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        x = classes_of(text)
        hot = np.unique(np.flatnonzero((x == len(_OWN)) | (x == 0)) // CORE)
        hot = np.unique(np.concatenate((hot - 1, hot, hot + 1)))
        hot = hot[(hot >= 0) & (hot * CORE < len(x))]
        padded[k] = np.full(len(x) + WINDOW + CORE, CLASSES, np.uint8)
        padded[k][SIDE : SIDE + len(x)] = x
        new = np.flatnonzero(np.concatenate(([True], hot[1:] != hot[:-1] + 1)))  # stretches of adjoining windows
        rows += [k] * len(new)
        firsts.append(hot[new])
        sizes.append(np.diff(np.append(new, len(hot))))
    if not rows:
        return out
    row, first, size = np.array(rows), np.concatenate(firsts), np.concatenate(sizes)
    for group in _groups(size):
        tags = _decoded(net, [padded[k] for k in row[group].tolist()], first[group], size[group])
        for j, s in enumerate(group.tolist()):
            t = tags[: int(size[s]) * CORE + 2 * SIDE, j]
            base = int(first[s]) * CORE - SIDE
            text = texts[row[s]]
            for a in np.flatnonzero(t % 2 == 1).tolist():
                inside = t[a] + 1
                b = a + 1
                while b < len(t) and t[b] == inside:
                    b += 1
                i, j2, kind = max(0, base + a), min(len(text), base + b), int(t[a] - 1) // 2
                if j2 > i and _plausible(kind, text[i:j2]):
                    # A number's span ends where the number ends.
                    whole = (i == 0 or not (text[i - 1].isalnum() and text[i].isalnum())) and (j2 == len(text) or not (text[j2].isalnum() and text[j2 - 1].isalnum()))
                    if whole:
                        out[row[s]].append((i, kind, j2))
    return [sorted(x) for x in out]


def find(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and the network's spans that touch none of them, of each text."""
    found = []
    for text, more in zip(texts, model_spans(net, texts)):
        base, extra = base_spans(text), []
        covered = sorted((a, b) for a, _, b in base)
        for a, kind, b in more:
            if all(b <= c or d <= a for c, d in covered):
                extra.append((a, kind, b))
        found.append((base, extra))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(options: tuple, redact: bool, own: str = "__text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = options[0]
        for batch in batches:
            for part in by_bytes(batch, own, SLICE):
                texts = ["" if t is None else t for t in part.column(own).to_pylist()]
                found = find(net, texts)
                kept = {f.name: part.column(i) for i, f in enumerate(part.schema) if f.name != own}
                if redact:
                    nulls = part.column(own).is_null().to_pylist()
                    kept[own] = pa.array([None if none else redacted(t, [*b, *m]) if b or m else t for t, (b, m), none in zip(texts, found, nulls)], pa.string())
                else:
                    for j, kind in enumerate(KINDS):
                        kept[f"n_{kind}"] = pa.array([sum(k == j for _, k, _ in b) for b, _ in found], pa.int64())
                    kept["n_added"] = pa.array([len(m) for _, m in found], pa.int64())
                    kept["base_sha256"] = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found])
                    kept["spans"] = pa.array([listed([*b, *m]) for b, m in found])
                yield pa.RecordBatch.from_pydict(kept)

    return run


def scan(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row per row: id, n_email, n_ip, n_card, n_phone (base spans), n_added (the network's spans), base_sha256 and spans (all).

    Offsets are in code points of the whole text, the end exclusive. Null and empty texts have no spans. Rows are scanned each by itself, so repeated rows are
    alike; other columns are ignored. An empty table has no rows. A text of digits only is decoded in parts, at some 20 bytes a character.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string"
    return docs.select(docs[_quoted(key)].alias("id"), docs[_quoted(text)].alias("__text")).mapInArrow(tidy(_scan((trained(**options),), False)), schema)


def redact(docs: DataFrame, text: str, **options) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; null texts stay null.

    Empty texts stay empty, whole texts are searched however long they are, repeated rows are treated alike, an empty table gives an empty one.
    """
    # Arrow functions take plain column names only.
    plain = {c: "text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)}
    schema = StructType([StructField(plain[c], StringType() if c == text else docs.schema[c].dataType) for c in sorted(docs.columns, key=lambda c: c == text)])
    done = docs.select(*(docs[_quoted(c)].alias(plain[c]) for c in docs.columns)).mapInArrow(tidy(_scan((trained(**options),), True, "text")), schema)
    return done.select(*(done[plain[c]].alias(c) for c in docs.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
