"""Secret scans: exact rules, and a character convolutional network for what they miss.

Rules find assignments, access keys and long hex strings. Candidates are all runs of
key characters and marks of at least LEAST characters that hold a letter and a digit or mark,
or capitals and small letters other than a first capital; others look like words or numbers. The network reads
each candidate whole, with the characters around it: one-hot character classes, a convolution,
the maxima of its filters before, in and after the candidate, and a logistic unit; a candidate
longer than WITHIN is read in overlapping pieces, whose maxima are taken together. It is
trained on all different candidates of the table, labelled by the rules' findings, and on generated ones. Key words give way to other
contexts in half of them, so that it learns the look of a secret too, as what it can add has no key word before it.
A quarter of all is held out; on these the scores are calibrated by a logistic curve, and the
threshold is the highest that still finds RECALL of the labelled ones: one for candidates
with a key word in the BEFORE characters before them, and one for others.

Training: the driver begins with the generated candidates. The table's are dealt by hash to shards of about SHARD_ROWS, whose
number grows with them. In each of ROUNDS rounds the tasks take every shard through the network
that the round began with, a step for every STEP_ROWS of its rows and some generated ones, and the next round begins with the mean of
the shards' networks. Only sums of weights and of the calibration reach the driver. Shards, their order and sums are
the same however Spark splits the table.
Candidates that touch no rule's finding and reach it are added as kind ``model``.

Defined results: a null or empty text has no findings; equal rows get equal results; extra
columns are ignored, and ``redact`` keeps them; a network is trained on a table of any size,
if need be on the generated candidates alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")

LEAST, BEFORE, WITHIN, AFTER = 8, 24, 64, 8
WIDTH, FILTERS = 5, 16
GENERATED, EPOCHS, STEPS = 1_500, 6, 384
ROUNDS, SHARD_ROWS, STEP_ROWS, STEP_GENERATED = 3, 16_384, 128, 32
#: The generated candidates weigh as much as the table's do by number in their class, but at least this share.
GENERATED_SHARE = 0.25
#: Sums over shards are of integers, so that their order is no matter.
UNIT = 2.0**32
RECALL = 0.95

HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
KEY = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"))
MARKED = np.isin(np.arange(256), list(b"0123456789!@#$%^&*~"))
CAPITAL, SMALL = np.zeros((2, 256), bool)
CAPITAL[0x41:0x5B] = SMALL[0x61:0x7B] = True
RUN = KEY | MARKED

#: Character classes: 0 is outside the text, then letters, digits, marks, spaces, others.
CLASS = np.full(256, 29, np.uint8)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[list(b"0123456789")] = 27
CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 28
for _i, _c in enumerate(b"\"'=:_-./+@"):
    CLASS[_c] = 30 + _i
CLASSES = 41  # and one for capitals
LENGTH = BEFORE + WITHIN + AFTER
KEY_WORD = re.compile(rb"password|passwd|secret|token|api_?key")
SHOWN = np.full(256, 0x20, np.uint8)
SHOWN[1:27] = SHOWN[65:91] = np.arange(0x61, 0x7B)
SHOWN[CLASS[0x5F]] = 0x5F

Span = tuple[int, int, int]  # kind, start, end; bytes of the chunk


def rule_spans(chunk: textops.Chunk) -> list[tuple[int, Span]]:
    """(row, span) of the rules' findings."""
    data = chunk.data
    raw = data.tobytes()
    out = []
    marks = chunk.per_row((data == 0x3A) | (data == 0x3D))
    for row in np.flatnonzero(marks).tolist():
        base = int(chunk.offsets[row])
        out += [(row, (0, m.start() + base, m.end() + base)) for m in ASSIGN.finditer(raw[base : chunk.offsets[row + 1]]) if m.end(1) - m.start(1) >= 8]
    at, rows = raw.find(b"AKIA"), set()
    while at >= 0:
        row = int(np.searchsorted(chunk.offsets, at, "right")) - 1
        rows.add(row)
        at = raw.find(b"AKIA", int(chunk.offsets[row + 1]))
    for row in sorted(rows):
        base = int(chunk.offsets[row])
        out += [(row, (1, m.start() + base, m.end() + base)) for m in ACCESS.finditer(raw[base : chunk.offsets[row + 1]]) if m.end() - m.start() >= 16]
    runs = chunk.spans(HEX[data])
    long = runs.ends - runs.starts >= 32
    out += [(int(r), (2, int(s), int(e))) for r, s, e in zip(runs.row[long], runs.starts[long], runs.ends[long], strict=True)]
    return sorted(out, key=lambda x: (x[0], x[1][1], x[1][0]))


def candidates(chunk: textops.Chunk) -> textops.Words:
    """Runs that may be secrets."""
    runs = chunk.spans(RUN[chunk.data])

    def holds(kind: np.ndarray, skip: int = 0) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[chunk.data])))
        return sums[runs.ends] > sums[runs.starts + skip]

    own = (runs.ends - runs.starts >= LEAST) & (holds(CAPITAL | SMALL) & holds(MARKED) | holds(CAPITAL, 1) & holds(SMALL))
    return textops.Words(runs.starts[own], runs.ends[own], runs.row[own], runs.first)


def encode(chunk: textops.Chunk, found: textops.Words) -> tuple[np.ndarray, np.ndarray]:
    """Character classes around each candidate, of a fixed length, and the first row of each: a candidate
    longer than WITHIN has a row for each of its pieces, which overlap by WIDTH - 1 at least. The
    text's edges are class 0."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), CLASS[chunk.data] | np.where(CAPITAL[chunk.data], 64, 0).astype(np.uint8), np.zeros(LENGTH, np.uint8)])
    pieces = 1 + -(-np.maximum(found.ends - found.starts - WITHIN, 0) // (WITHIN - WIDTH + 1))
    first = np.cumsum(pieces) - pieces
    own = np.repeat(np.arange(len(pieces)), pieces)
    s, e, row = found.starts[own], found.ends[own], found.row[own]
    begin = np.minimum(s + (np.arange(len(own)) - first[own]) * (WITHIN - WIDTH + 1), np.maximum(e - WITHIN, s))
    out = np.zeros((len(own), LENGTH), np.uint8)
    for at, width, start, least, most in (
        (0, BEFORE, s - BEFORE, np.maximum(BEFORE - s + chunk.offsets[row], 0), np.full(len(own), BEFORE)),
        (BEFORE, WITHIN, begin, np.zeros(len(own), int), e - begin),
        (BEFORE + WITHIN, AFTER, e, np.zeros(len(own), int), chunk.offsets[row + 1] - e),
    ):
        place = np.arange(width)
        shown = (place >= least[:, None]) & (place < most[:, None])
        out[:, at : at + width] = np.where(shown, padded[BEFORE + start[:, None] + place], 0)
    return out, first


def announced(x: np.ndarray) -> np.ndarray:
    """Has the encoded candidate a key word before it?"""
    shown = np.full((len(x), BEFORE + 1), 0x0A, np.uint8)
    shown[:, :BEFORE] = SHOWN[x[:, :BEFORE]]
    out = np.zeros(len(x), bool)
    out[[m.start() // (BEFORE + 1) for m in KEY_WORD.finditer(shown.tobytes())]] = True
    return out


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def lowest(n: int) -> int:
    """The place, of n ascending scores, of the highest threshold that finds RECALL of them."""
    return int((1 - RECALL) * n)


WEIGHTS = ("kernel", "bias", "dense", "shift")
PARTS = ((0, BEFORE), (BEFORE - WIDTH + 1, BEFORE + WITHIN), (BEFORE + WITHIN - WIDTH + 1, LENGTH - WIDTH + 1))


@dataclass
class Network:
    kernel: np.ndarray  # [WIDTH * classes, FILTERS]
    bias: np.ndarray
    dense: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, float] = (1.0, 1.0)  # without a key word, and with one
    precision: float = 0.0  # of the held-out candidates at the thresholds

    @classmethod
    def new(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.2, (WIDTH * (CLASSES + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS * len(PARTS)), 0.0)

    def forward(self, x: np.ndarray, tops: list[np.ndarray] | None = None) -> np.ndarray:
        """The maxima of each part's filters; their places are added to ``tops``. The convolution of one-hot
        classes is a sum of the kernel's rows, looked up for each place."""
        rows = self.kernel.astype(np.float32).reshape(WIDTH, CLASSES + 1, FILTERS)
        table = np.zeros((WIDTH, 128, FILTERS), np.float32)
        table[:, :CLASSES] = rows[:, :CLASSES]
        table[:, 64 : 64 + CLASSES] = rows[:, :CLASSES] + rows[:, CLASSES:]
        at, places = np.ascontiguousarray(x.T).astype(np.intp), LENGTH - WIDTH + 1
        conv = table[0].take(at[:places], 0)
        for k in range(1, WIDTH):
            conv += table[k].take(at[k : k + places], 0)
        if tops is not None:
            tops += [conv[a:b].argmax(0) + a for a, b in PARTS]
        return np.maximum(np.concatenate([conv[a:b].max(0) for a, b in PARTS], 1) + np.tile(self.bias.astype(np.float32), len(PARTS)), 0)

    def logits(self, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Of each row, or of each candidate whose rows begin at ``first``: its pieces' maxima."""
        if not len(x):
            return np.empty(0)
        pooled = np.concatenate([self.forward(x[i : i + 128]) for i in range(0, len(x), 128)])
        return ((pooled if first is None else np.maximum.reduceat(pooled, first)) * self.dense).sum(1) + self.shift

    def probability(self, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        return chance(self.slope * self.logits(x, first) + self.offset)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighed log loss."""
        tops: list[np.ndarray] = []
        pooled = self.forward(x, tops)
        g = (chance(pooled @ self.dense + self.shift) - y) * weight
        back = np.outer(g, self.dense) * (pooled > 0)
        top = np.concatenate(tops, 1)[:, :, None] + np.arange(WIDTH)
        codes = x[np.arange(len(x))[:, None, None], top].astype(np.intp)
        place = (codes + 128 * np.arange(WIDTH)) * FILTERS + np.tile(np.arange(FILTERS), len(PARTS))[:, None]
        sums = np.bincount(place.ravel(), np.repeat(back.ravel(), WIDTH), WIDTH * 128 * FILTERS).reshape(WIDTH, 128, FILTERS)
        kernel = np.concatenate([sums[:, :CLASSES] + sums[:, 64 : 64 + CLASSES], sums[:, 64:].sum(1, keepdims=True)], 1)
        return {"kernel": kernel.reshape(self.kernel.shape), "bias": back.reshape(-1, len(PARTS), FILTERS).sum((0, 1)), "dense": pooled.T @ g, "shift": g.sum()}

    def descend(self, steps: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = 0.005) -> None:
        """Adam over steps of (x, y, weight)."""
        m, v = ({n: np.zeros_like(np.asarray(getattr(self, n), float)) for n in WEIGHTS} for _ in range(2))
        for step, (x, y, weight) in enumerate(steps, 1):
            for n, grad in self.gradients(x, y, weight).items():
                m[n] = 0.9 * m[n] + 0.1 * grad
                v[n] = 0.999 * v[n] + 0.001 * np.square(grad)
                setattr(self, n, getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """Steps over the rows, classes weighed alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        orders = (rng.permutation(len(y)) for _ in range(max(EPOCHS, -(-STEPS * STEP_ROWS // len(y)))))
        steps = (order[i : i + STEP_ROWS] for order in orders for i in range(0, len(y), STEP_ROWS))
        self.descend((x[own], y[own], weight[own] / len(own)) for own in steps)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, n)) for n in WEIGHTS])

    def with_weights(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([np.size(getattr(self, n)) for n in WEIGHTS])
        parts = [part.reshape(np.shape(getattr(self, n))) for n, part in zip(WEIGHTS, np.split(flat, ends[:-1]), strict=True)]
        return replace(self, **{**dict(zip(WEIGHTS, parts, strict=True)), "shift": float(flat[-1])})

    def curve(self, moments: Callable[[float, float], tuple[float, ...]]) -> None:
        """A logistic curve over held-out logits, by the sums of ``moments``: with p of curve (a, b) and w = p(1-p), those of
        wzz, wz, w, (p-y)z, p-y and the log loss. A step that makes the loss greater is halved."""
        at = np.array([1.0, 0.0])
        wzz, wz, w, ez, e, loss = moments(*at)
        for _ in range(50):
            step = np.linalg.solve([[wzz + 1, wz], [wz, w + 0.1]], [ez + at[0] - 1, e + 0.1 * at[1]])
            while np.abs(step).max() >= 1e-6:
                a, b = (float(v) for v in at - step)
                wzz, wz, w, ez, e, new = moments(a, b)
                new += (a - 1) ** 2 / 2 + b**2 / 20
                if new <= loss:
                    break
                step = step / 2
            else:
                break
            at, loss = np.array([a, b]), new
        self.slope, self.offset = (float(v) for v in at)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The curve over held-out logits, then the recall-constrained thresholds."""
        z = self.logits(x)

        def moments(a: float, b: float) -> tuple[float, ...]:
            p = chance(a * z + b)
            w = p * (1 - p) + 1e-9
            return (w * z * z).sum(), (w * z).sum(), w.sum(), ((p - y) * z).sum(), (p - y).sum(), (np.logaddexp(0, a * z + b) - y * (a * z + b)).sum()

        self.curve(moments)
        p, with_word, cuts = self.probability(x), announced(x), []
        for k in (False, True):
            found = np.sort(p[(y == 1) & (with_word == k)])
            found = found if len(found) else np.sort(p[y == 1])
            cuts.append(float(found[lowest(len(found))]) if len(found) else 1.0)
        self.thresholds = tuple(cuts)
        taken = p >= np.where(with_word, cuts[1], cuts[0])
        self.precision = float(y[taken].mean()) if taken.any() else 0.0

    def calibrate_on(self, scores: DataFrame) -> None:
        """The same, of a stored table (z, y, announced) of any size."""
        y, z = F.col("y"), F.col("z")

        def moments(a: float, b: float) -> tuple[float, ...]:
            t = a * z + b
            p = 1 / (1 + F.exp(-t))
            w = p * (1 - p) + 1e-9
            loss = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - y * t
            exact = [F.sum(v.cast("decimal(28,12)")).cast("double") for v in (w * z * z, w * z, w, (p - y) * z, p - y, loss)]
            return tuple(scores.agg(*exact).first())

        self.curve(moments)
        scores, cuts = scores.withColumn("score", self.slope * z + self.offset), []
        for k in (False, True):
            for found in (scores.where((y == 1) & (F.col("announced") == k)), scores.where(y == 1)):
                n = found.count()
                if n:
                    cuts.append(found.orderBy("score").offset(lowest(n)).first()["score"])
                    break
            else:
                cuts.append(np.inf)
        taken = scores.where(F.col("score") >= F.when(F.col("announced"), cuts[1]).otherwise(cuts[0]))
        self.precision = taken.agg(F.avg("y")).first()[0] or 0.0
        self.thresholds = tuple(float(c) for c in chance(np.array(cuts)))

    def reached(self, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        return self.probability(x, first) >= np.where(announced(x if first is None else x[first]), self.thresholds[1], self.thresholds[0])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textops.chunks(batch.column(0)):
            found = candidates(chunk)
            if not len(found.starts):
                continue
            hit = np.zeros(len(chunk.data) + 1, np.int64)
            for _, (_, s, e) in rule_spans(chunk):
                hit[s], hit[e] = hit[s] + 1, hit[e] - 1
            covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
            y = covered[found.ends] > covered[found.starts]
            x, first = encode(chunk, found)
            y = np.repeat(y, np.diff(np.append(first, len(x))))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y.astype(np.int32))], ["x", "y"])


def generated(n: int = GENERATED, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Encoded candidates of n texts with a made-up secret and n with none, and their labels."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    random = lambda letters, k: "".join(rng.choice(list(letters), k))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: "".join(pick("bcdfghklmnprstvwz") + pick("aeiou") + pick(("", "", "n", "r", "s")) for _ in range(rng.integers(1, 6)))
    words = lambda k: " ".join(word() for _ in range(k))
    key = lambda: random(*pick(((low + low.upper() + digits, rng.integers(16, 65)), (low + low.upper() + digits + "+/", rng.integers(20, 89)), (digits + "ABCDEF", rng.integers(16, 65)), (low + digits, rng.integers(16, 41)), (low.upper() + digits, rng.integers(16, 41)))))
    short = lambda: pick((random(low + low.upper() + digits, rng.integers(8, 17)), random(low + low.upper(), rng.integers(8, 25)), random(digits, rng.integers(8, 20)), random(low + low.upper() + digits + "!@#$%^&*", rng.integers(8, 25))))
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    harmless = (
        lambda: f"{word()}-{random(digits, 4)}/{word()}.{word()}-20{random(digits, 2)}", lambda: f"https://{word()}.{word()}.org/{word()}/{word()}{random(digits, 2)}", lambda: f"{word()}.{word()}{random(digits, 2)}@{word()}.example.com", lambda: f"20{random(digits, 2)}-0{random('123456789', 1)}-1{random(digits, 1)}", lambda: random(digits, rng.integers(8, 13)),
        lambda: f"{word()}_{word()}_{word()}{random(digits, 1)}", lambda: f"{word()}{word().title()}{word().title()}{random(digits, 1)}", lambda: f"v{random(digits, 1)}.{random(digits, 2)}.{random(digits, 1)}-{word()}", lambda: word() + word() + word(), lambda: f"{word().title()}{word().title()}", lambda: f"{word()}{random(digits, 2)}@{word()}.{pick(('com', 'org', 'net'))}", lambda: f"{word()}#{random(digits, 1)}{word()}", lambda: f"{word().upper()}-{random(digits, 4)}", lambda: f"{word().title()}-{word().title()}", lambda: f"{random('123456789', 1)}{random(digits, 2)}.{random(digits, 3)}.{random(digits, 2)}/{word()}", lambda: f"{word()}-{word()}-{word()}", lambda: "=" * int(rng.integers(8, 40)), lambda: f"/usr/{word()}/{word()}{random(digits, 1)}/{word()}.txt", lambda: f"+{random(digits, 2)}-{random(digits, 5)}-{random(digits, 5)}",
    )
    texts, spans = [], []
    for i in range(2 * n):
        before, after, secret = words(6), words(3), i % 2 == 0
        if secret:
            named = rng.random() < 0.5
            value = short() if named and rng.random() < 0.5 else key()
            before += f" {pick(names)}{pick((' = ', '=', ': ', ' '))}{pick(('', chr(34), chr(39)))}" if named else pick((" ", "\n", " (", " " + chr(34)))
        else:
            value = pick(harmless)()
            before += pick((" ", "\n", " (", " in ", f" the {pick(names)} of "))
        texts.append(f"{before}{value} {after}")
        spans.append((len(before), len(before) + len(value)) if secret else (0, 0))
    xs, ys = [], []
    for chunk in textops.chunks(pa.array(texts)):
        found = candidates(chunk)
        span = np.array(spans)[chunk.first_row + found.row] + chunk.offsets[found.row][:, None]
        x, first = encode(chunk, found)
        xs.append(x)
        ys.append(np.repeat((found.starts < span[:, 1]) & (found.ends > span[:, 0]), np.diff(np.append(first, len(x)))))
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def pack(shard: pa.Table) -> pa.Table:
    """A shard (shard, hash, x, y) as one row, in the order of hashes: what trains, and what is held out. In half of the candidates
    the context is that of the last one before them that is no secret."""
    shard = shard.sort_by([("hash", "ascending"), ("x", "ascending"), ("y", "ascending")])
    x = np.frombuffer(b"".join(shard["x"].to_pylist()), np.uint8).reshape(-1, LENGTH).copy()
    y, h = shard["y"].to_numpy().astype(np.uint8), shard["hash"].to_numpy()
    last = np.maximum.accumulate(np.where(y == 0, np.arange(len(y)), -1))
    before = np.concatenate(([-1], last[:-1]))
    swapped = np.flatnonzero((before >= 0) & (h >> 8 & 1 == 1))
    x[swapped, :BEFORE] = x[:, :BEFORE][before[swapped]]
    held = h & 3 == 0
    return pa.table({"shard": shard["shard"].slice(0, 1), **{n: pa.array([part.tobytes()], pa.binary()) for n, part in (("x", x[~held]), ("y", y[~held]), ("x_held", x[held]), ("y_held", y[held]))}})


PACKED = "shard long, x binary, y binary, x_held binary, y_held binary"


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for shard, x, y in zip(*batch.columns, strict=True):
            yield shard.as_py(), np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, LENGTH), np.frombuffer(y.as_buffer(), np.uint8)


def shard_steps(shard: int, x: np.ndarray, y: np.ndarray, made: tuple[np.ndarray, np.ndarray], per_row: np.ndarray, made_share: np.ndarray, passes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps over a shard's rows, each with as many generated ones of both classes in turn. A row weighs as its class tells
    (``per_row``), the generated ones of a class together ``made_share``; so do all rows of the table in as many steps."""
    rng = np.random.default_rng([7, shard])
    turns = [rng.permutation(np.flatnonzero(made[1] == k)) for k in (0, 1)]
    contexts, each, done = np.flatnonzero(y == 0), STEP_GENERATED // 2, 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for own in np.array_split(order, max(1, round(len(y) / STEP_ROWS))):
            chosen = np.concatenate([t.take(range(done, done + each), mode="wrap") for t in turns])
            added = made[0][chosen]
            if len(contexts):
                swapped = np.flatnonzero(rng.random(len(added)) < 0.5)
                added[swapped, :BEFORE] = x[rng.choice(contexts, len(swapped)), :BEFORE]
            done += each
            yield np.concatenate([x[own], added]), np.concatenate([y[own], np.repeat([0, 1], each)]), np.concatenate([per_row[y[own]] * (STEP_ROWS / len(own)), np.repeat(made_share / each, each)])


def round_of(packed: DataFrame, network: Network, made: tuple[np.ndarray, np.ndarray], per_row: np.ndarray, made_share: np.ndarray, rate: float, passes: int) -> Network:
    """The mean of the networks that each shard makes of this one."""
    held = packed.sparkSession.sparkContext.broadcast((network, made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own_made = held.value
        sums = np.zeros(start.flat().size + 1, np.int64)
        for shard, x, y in unpacked(batches):
            if len(y):
                own = replace(start)
                own.descend(shard_steps(shard, x, y, own_made, per_row, made_share, passes), rate)
                sums += np.append(np.rint(own.flat() * UNIT).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["at", "total"])

    sums = packed.select("shard", "x", "y").mapInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    *totals, shards = (r["total"] for r in sums)
    return network.with_weights(np.array(totals, float) / UNIT / shards)


def scored(packed: DataFrame, network: Network, made: DataFrame) -> DataFrame:
    """(z, y, announced) of all candidates that were held out."""
    held = packed.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(held.value.logits(x)), pa.array(y.astype(np.int32)), pa.array(announced(x))], ["z", "y", "announced"])

    rows = packed.select("shard", F.col("x_held").alias("x"), F.col("y_held").alias("y")).unionByName(made)
    return rows.mapInArrow(run, "z double, y int, announced boolean")


def fit(docs: DataFrame) -> Network:
    """The network of all different candidates of the documents, (x, y), and of the generated ones."""
    x, y = generated()
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 4], order[len(y) // 4 :]
    # What stands before a candidate that is no secret takes the place of half of the contexts.
    swapped = np.flatnonzero(rng.random(len(x)) < 0.5)
    plain = x.copy()
    x[swapped, :BEFORE] = x[rng.choice(np.flatnonzero(y == 0), len(swapped)), :BEFORE]
    network = Network.new()
    network.train(x[own], y[own])
    rows = jobs.stored(docs.select("text").mapInArrow(_labelled, "x binary, y int").dropDuplicates())
    numbers = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not numbers:
        network.calibrate(x[held], y[held])
        return network
    total = sum(numbers.values())
    shards = max(1, total // SHARD_ROWS)
    hashed = rows.select(F.pmod(F.xxhash64("x"), F.lit(shards)).alias("shard"), F.xxhash64("x", F.lit(1)).alias("hash"), "x", "y")
    packed = jobs.stored(hashed.repartition(max(min(shards, 256), shards // 64), "shard").groupBy("shard").applyInArrow(pack, PACKED))
    jobs.drop(rows)
    n, made_n = np.array([numbers.get(k, 0) for k in (0, 1)]), np.array([(y[own] == k).sum() for k in (0, 1)])
    share = np.maximum(GENERATED_SHARE, made_n / (made_n + n))
    per_row = 0.5 * (1 - share) * total / np.maximum(n, 1) / STEP_ROWS
    passes = -(-STEPS * STEP_ROWS // (ROUNDS * min(total, SHARD_ROWS)))
    for k in range(ROUNDS):
        network = round_of(packed, network, (plain[own], y[own]), per_row, 0.5 * share, 0.005 / (1 + k), passes)
    made = docs.sparkSession.createDataFrame([(-1, bytearray(x[held].tobytes()), bytearray(y[held].astype(np.uint8).tobytes()))], "shard long, x binary, y binary")
    scores = jobs.stored(scored(packed, network, made))
    network.calibrate_on(scores)
    jobs.drop(packed, scores)
    return network


def all_spans(chunk: textops.Chunk, network: Network | None) -> list[list[Span]]:
    """Findings of each row, by start and then kind; bytes from the row's start."""
    out: list[list[Span]] = [[] for _ in range(chunk.rows)]
    rules = rule_spans(chunk)
    for row, span in rules:
        out[row].append(span)
    if network is not None:
        found = candidates(chunk)
        if len(found.starts):
            hit = np.zeros(len(chunk.data), bool)
            for _, (_, s, e) in rules:
                hit[s:e] = True
            sums = np.concatenate(([0], np.cumsum(hit)))
            free = sums[found.ends] == sums[found.starts]
            found = textops.Words(found.starts[free], found.ends[free], found.row[free], found.first)
            for i in np.flatnonzero(network.reached(*encode(chunk, found))).tolist():
                out[found.row[i]].append((3, int(found.starts[i]), int(found.ends[i])))
    return [sorted(((k, int(s - base), int(e - base)) for k, s, e in spans), key=lambda x: (x[1], x[0])) for spans, base in zip(out, chunk.offsets, strict=False)]


def in_code_points(chunk: textops.Chunk, row: int, spans: list[Span]) -> list[Span]:
    if not spans:
        return spans
    own = chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]]
    sums = np.concatenate(([0], np.cumsum(textops.code_points(own))))
    return [(k, int(sums[s]), int(sums[e])) for k, s, e in spans]


SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


def find(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, spans): findings of every document, in code points, end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in in_code_points(chunk, i, own)] for i, own in enumerate(all_spans(chunk, held.value))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, network: Network | None) -> DataFrame:
    """The documents, with their columns, whose findings are replaced by [SECRET]; of
    findings that overlap the union is replaced. ``n_chars``, where there is one, follows
    the new text; texts without findings stay as they are."""
    held, at = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for chunk in textops.chunks(texts):
                own = texts.slice(chunk.first_row, chunk.rows)
                new = {}
                for i, spans in enumerate(all_spans(chunk, held.value)):
                    if spans:
                        raw, out, done = chunk.text(i), [], 0
                        for _, s, e in spans:
                            if s >= done:
                                out += [raw[done:s], b"[SECRET]"]
                            done = max(done, e)
                        new[i] = (b"".join(out) + raw[done:]).decode()
                if new:
                    own = pa.array([new.get(i, x) for i, x in enumerate(own.to_pylist())], own.type)
                rows = batch.slice(chunk.first_row, chunk.rows)
                yield rows.set_column(at, rows.schema.field(at), own)

    plain = jobs.numbered(docs)
    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = find(docs, fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
