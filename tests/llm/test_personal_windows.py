"""The network half of the personal-data operator: odd digits, memory, and windows averaged and decoded one text at a time."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import types as T

from ledgerloom.llm import pii


def plain_spans(net, text):
    """Each window by itself, the mean at each place, and the best path of each stretch over whole emissions."""
    x = np.full(len(text) + 4 * pii.WINDOW, pii.CLASSES, np.int64)
    x[pii.SIDE : pii.SIDE + len(text)] = pii.classes_of(text)
    cores = {i // pii.CORE + d for i, c in enumerate(text) if c in "0123456789@" for d in (-1, 0, 1)}
    cores = sorted(c for c in cores if 0 <= c * pii.CORE < len(text))
    out, stretch = [], []
    for c in [*cores, None]:
        if stretch and (c is None or c != stretch[-1] + 1):
            size = len(stretch) * pii.CORE + 2 * pii.SIDE
            sums, times = np.zeros((size, pii.TAGS)), np.zeros(size)
            for k, s in enumerate(stretch):
                sums[k * pii.CORE : k * pii.CORE + pii.WINDOW] += net.emit(x[None, s * pii.CORE : s * pii.CORE + pii.WINDOW])[:, 0]
                times[k * pii.CORE : k * pii.CORE + pii.WINDOW] += 1
            score, back = net.p["s"] + sums[0] / times[0], []
            for t in range(1, size):
                both = score[:, None] + net.p["t"]
                back.append(both.argmax(0))
                score = both.max(0) + sums[t] / times[t]
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
            base, t = stretch[0] * pii.CORE - pii.SIDE, 0
            while t < size:
                e = t + 1
                if path[t] % 2 == 1:
                    while e < size and path[e] == path[t] + 1:
                        e += 1
                    a, b, kind = max(0, base + t), min(len(text), base + e), path[t] // 2
                    split = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
                    if b > a and pii._plausible(kind, text[a:b]) and not split(a) and not split(b):
                        out.append((a, kind, b))
                t = e if path[t] % 2 == 1 else t + 1
            stretch = []
        stretch.append(c)
    return sorted(out)


def texts(seed, n):
    rand = random.Random(seed)
    numbers = ["0171 234 567 89", "(555) 123-4567", "4111 1111 1111 1112", "10.0.0.1", "a.b@c.de", "12", "@", "+49 30 123456", "1.2.3.4.5", "٣٤"]
    words = "call me under the number of or at for ü ß 日本".split()
    return [" ".join(rand.choice(numbers) if rand.random() < 0.15 else rand.choice(words) for _ in range(rand.randrange(1, 200))) for _ in range(n)]


def test_windows_one_by_one():
    net, some = pii.trained(), texts(1, 60)
    want = [plain_spans(net, t) for t in some]
    assert pii.model_spans(net, some) == want and sum(map(len, want)) > 40


def test_groups_and_parts_change_nothing(monkeypatch):
    net, some = pii.trained(), texts(2, 40)
    want = pii.model_spans(net, some)
    for batch, group in ((512, 3), (2, 1 << 13), (5, 40)):
        monkeypatch.setattr(pii, "BATCH", batch)
        monkeypatch.setattr(pii, "GROUP", group)
        assert pii.model_spans(net, some) == want


def test_digits_that_int_does_not_read():
    net = pii.trained()
    rand = random.Random(3)
    for odd in "²³¹٣४①½":
        assert not pii._plausible(1, f"{odd}.1.1.1") and not pii._plausible(2, odd + "1" * 14) and not pii._plausible(3, "0" * 10 + odd)
        for _ in range(40):
            pad = "".join(rand.choice(" |:x") for _ in range(rand.randrange(6)))
            pii.find(net, [f"{pad}{odd}.194.52.127 | x", f"{pad}10.0.{odd}.1{pad}", f"4111{odd} 1111 1111 1111"])
    assert pii.find(net, [" ².194.52.127 | x"]) == [([], [])]


def test_one_long_text_among_short_ones():
    net = pii.trained()
    short = texts(4, 600)
    long = "".join(random.Random(5).choices("0123456789", k=150_000))
    alone = pii.model_spans(net, short)
    tracemalloc.start()
    got = pii.model_spans(net, [*short[:300], long, *short[300:]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:300] + got[301:] == alone
    assert peak < 60e6, peak


def test_columns_of_any_name(spark):
    kinds = T.StructType([T.StructField("a`b", T.StringType()), T.StructField("x.y", T.IntegerType()), T.StructField("n_email", T.IntegerType())])
    df = spark.createDataFrame([("mail a@b.de now", 1, 2), (None, 3, 4), ("", 5, 6)], kinds)
    got = pii.redact(df, "a`b")
    assert got.columns == df.columns and sorted((r[1], r[0]) for r in got.collect()) == [(1, "mail [EMAIL] now"), (3, None), (5, "")]
    assert pii.redact(df.limit(0), "a`b").collect() == []
    assert sorted(r["id"] for r in pii.scan(df, "x.y", "a`b").collect()) == [1, 3, 5]
