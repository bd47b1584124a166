"""Op 3: scoring with a gated recurrent language model.

A token is a word (runs without ASCII white space, A-Z lowered) or the end of a text. Its probability is factored: the
recurrent network gives the class, from the classes of all tokens before it in the text, and the class's own distribution
gives the word. Everything is learned from all training texts, whole and with every copy: word counts, class masses, the share
of words not seen before, the topics that words are grouped by, and the network's weights.

Topics: groups of texts by their frequent words begin with a bounded sample of different texts (SAMPLE of at most LONGEST
bytes), move to the means of all training texts, and each word's topic is the one it has most often in all of them. The
network begins with the same sample in the driver; then every partition of the training texts trains its own copy, by
backpropagation through windows of WINDOW steps, and the copies are averaged by their numbers of tokens. This happens in
ROUNDS, each over its own part of the texts and from the averages of the one before; together they are all texts, once
each. So what is trained on grows with the input, and the sample is only where training starts. Scoring and training run
whole texts through lanes, window after window, with the state carried from each to the next.

The HEAD most frequent words are known to every worker with their counts (a table of bounded size). All others, the tail,
are joined with the counts by word: none of them is frequent, so no key is hot. A word that no training text has counts as
the one unknown word of its tail class, with the share that words seen once have there (Good-Turing).

Null texts are empty and have the end only. Repeated rows get equal results. Without training texts the score is the base.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import small_batches, written

HEAD, TOPICS, BANDS, TAILS = 131_072, 6, 8, 9
SAMPLE, LONGEST, EPOCHS, HIDDEN, WINDOW, LANES = 700, 16_384, 3, 16, 32, 192
#: Sixteenths of the texts that the rounds of training have, and the rate of each.
ROUNDS, RATES = (range(3), range(3, 16)), (0.01, 0.005)
#: Tokens of a text that waits for others of its length, and how many tokens wait at most (and a batch).
LONG, LONG_HELD = 2048, 1_000_000
#: Words of the texts that groups go by.
FEATURES = 400
#: Distinct words that a worker counts before it hands them on.
FLUSH = 300_000


_outside = re.compile("[^\0-\x7f]").search


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits


def tail_class(w: bytes) -> int:
    """A class that a word's own bytes give: by its first letter outside ASCII, or whether it has signs."""
    if w.isalpha():  # of bytes: ASCII only
        return 0
    return 1 if w.isascii() else 2 + ord(_outside(w.decode(errors="replace"))[0]) % (TAILS - 2)


class Network:
    """Gated recurrent network over classes: `classes` outputs, one more input for the beginning of a text."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.x = (rng.standard_normal((classes + 1, 3 * h)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((h, 3 * h)) / math.sqrt(h)).astype(np.float32)
        self.o = (rng.standard_normal((h, classes)) * 0.02).astype(np.float32)
        self.b = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.o, self.b]

    def like(self, weights: np.ndarray) -> Network:
        """A network of this one's sizes with the weights that flat() gave."""
        new, at = Network(len(self.b)), 0
        for w in new.weights():
            w[...] = weights[at : at + w.size].reshape(w.shape)
            at += w.size
        return new

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def run(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (steps, lanes, hidden) and the last one. fresh: where a text begins, and the state with it.

        trace gets the states before each step, the new gate's recurrent part and the gates (steps, 3, lanes, hidden).
        """
        h, steps = HIDDEN, len(inputs)
        # gates one after the other, each of one piece; half of what sigmoid gates get, for 0.5 + 0.5 tanh(x / 2)
        half = np.array([0.5, 0.5, 1], np.float32)
        x = (self.x.reshape(-1, 3, h) * half[:, None]).reshape(-1, h)
        u = np.ascontiguousarray((self.u.reshape(h, 3, h) * half[:, None]).transpose(1, 0, 2))
        gates = x.take((inputs * 3)[:, None] + np.arange(3)[:, None], 0)
        out = np.empty((*inputs.shape, h), np.float32)
        keep, begin = (~fresh).astype(np.float32)[:, :, None], fresh.any(1).tolist()
        before = np.empty_like(out) if trace is not None else None
        parts = np.empty_like(out) if trace is not None else None
        a, b = np.empty(gates.shape[1:], np.float32), np.empty(out.shape[1:], np.float32)
        for t in range(steps):
            if begin[t]:
                state = state * keep[t]
            np.matmul(state, u, out=a)
            zr, n = gates[t, :2], gates[t, 2]
            zr += a[:2]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[1], a[2], out=b)
            n += b
            np.tanh(n, out=n)
            if trace is not None:
                before[t], parts[t] = state, a[2]
            new = out[t]
            np.subtract(state, n, out=new)
            new *= zr[0]
            new += n
            state = new
        if trace is not None:
            trace += before, parts, gates
        return out, state

    def _masses(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of states, shifted alike for all classes of a state, and their exponentials."""
        logits = flat @ self.o
        logits += self.b
        if not float((np.abs(self.o).sum(0) + np.abs(self.b)).max()) < 40:  # states are within 1; smaller logits need no shift
            logits -= logits.max(1, keepdims=True)
        return logits, np.exp(logits)

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the targets' class probabilities."""
        logits, masses = self._masses(states.reshape(-1, HIDDEN))
        at = logits[np.arange(len(logits)), targets.ravel()]
        return (at - np.log(masses @ np.ones(len(self.b), np.float32))).reshape(targets.shape)

    def train(self, lanes: list[np.ndarray], begins: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, moments: list | None = None) -> None:
        """Adam on windows; gradients stay inside a window, the state doesn't. moments: [steps, first, second], carried from call to call."""
        h, classes = HIDDEN, len(self.b)
        steps = max(map(len, lanes))
        target = np.zeros((steps, len(lanes)), np.int64)
        there = np.zeros((steps, len(lanes)), bool)
        fresh = np.ones((steps, len(lanes)), bool)
        for i, (c, f) in enumerate(zip(lanes, begins, strict=True)):
            target[: len(c), i], there[: len(c), i], fresh[: len(c), i] = c, True, f
        inputs = np.vstack([np.full((1, len(lanes)), classes), target[:-1]])
        inputs[fresh] = classes
        moments = [] if moments is None else moments
        if not moments:
            moments[:] = 0, [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        k, m, v = moments
        for epoch in range(epochs):
            state = np.zeros((len(lanes), h), np.float32)
            for a in range(0, steps, WINDOW):
                x, y, on, new = inputs[a : a + WINDOW], target[a : a + WINDOW], there[a : a + WINDOW], fresh[a : a + WINDOW]
                trace: list = []
                states, state = self.run(x, new, state, trace)
                flat = states.reshape(-1, h)
                p = self._masses(flat)[1]
                share = on.ravel().astype(np.float32) / max(1, on.sum())
                p *= (share / (p @ np.ones(classes, np.float32)))[:, None]
                p[np.arange(len(p)), y.ravel()] -= share
                d_out = (p @ self.o.T).reshape(states.shape)
                before, part, gates = trace
                z, r, n = gates[:, 0], gates[:, 1], gates[:, 2]
                # what each step's gradients are multiplied by, for all steps at once
                by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), part * r * (1 - r)
                d_gates, d_new = np.empty_like(gates), np.empty_like(states)
                u = np.ascontiguousarray(self.u.reshape(h, 3, h).transpose(1, 2, 0))
                keep, begin = (~new).astype(np.float32)[:, :, None], new.any(1).tolist()
                back, d_h = np.empty(gates.shape[1:], np.float32), np.zeros_like(state)
                for t in range(len(x) - 1, -1, -1):
                    d, d_a = d_out[t], d_gates[t]
                    d += d_h
                    np.multiply(d, by_z[t], out=d_a[0])
                    np.multiply(d, by_n[t], out=d_new[t])
                    np.multiply(d_new[t], by_r[t], out=d_a[1])
                    np.multiply(d_new[t], r[t], out=d_a[2])
                    np.matmul(d_a, u, out=back)
                    np.multiply(d, z[t], out=d_h)
                    for part_back in back:
                        d_h += part_back
                    if begin[t]:
                        d_h *= keep[t]
                flat_before = before.reshape(-1, h).T
                d_u = [flat_before @ d_gates[:, i].reshape(-1, h) for i in range(3)]
                d_x = np.concatenate([d_gates[:, 0].reshape(-1, h), d_gates[:, 1].reshape(-1, h), d_new.reshape(-1, h)], 1)
                grads = [_sums(x.ravel(), d_x, classes + 1), np.hstack(d_u), flat.T @ p, np.ones(len(p), np.float32) @ p]
                k += 1
                norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
                lr = rate * (1 - epoch / (epochs + 1)) * math.sqrt(1 - 0.999**k) / (1 - 0.9**k)
                for w, g, mi, vi in zip(self.weights(), grads, m, v, strict=True):
                    g = g / max(1.0, norm)
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    w -= lr * mi / (np.sqrt(vi) + 1e-8)
        moments[0] = k


def _sums(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key below n."""
    order = np.argsort(keys.astype(np.int16 if n <= 32_767 else np.int64), kind="stable")  # 16 bits are sorted by digits
    counts = np.bincount(keys, minlength=n)
    there = np.flatnonzero(counts)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[there] = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[there], 0)
    return out


class Model:
    """Network, classes and counts of the head, and what the tail classes hold."""

    def __init__(self, head: dict[bytes, int], topic: dict[bytes, int], total: int, types: int, ends: int, tails: list[tuple[int, int, int]]):
        """head: counts; topic: of words of the head; total, types: N and V; ends: training texts; tails: (tokens, types, words seen once) by tail class."""
        self.total, self.types, self.ends = total, types, ends
        sizes = [c.bit_length() for c in head.values()]
        least, bands = min(sizes, default=1), max(sizes, default=1) - min(sizes, default=1) + 1
        raw = {w: (t if (t := topic.get(w)) is not None else TOPICS + tail_class(w)) * BANDS + min(BANDS - 1, (c.bit_length() - least) * BANDS // bands) for w, c in head.items()}
        place = {k: i for i, k in enumerate(sorted(set(raw.values())))}
        self.tail0 = len(place)
        self.end = self.tail0 + TAILS
        self.classes = self.end + 1
        mass = np.zeros(self.classes)
        for w, c in head.items():
            mass[place[raw[w]]] += c
        self.base_den = math.log10(total + 0.1 * (types + 1))
        # word -> place in the arrays: class, log10 of its share of the class, log10 of its base probability; the last place is of no word
        self.words = {w: i for i, w in enumerate(head)}
        self.class_of = np.array([place[raw[w]] for w in head] + [0], np.int64)
        self.share_of = np.array([math.log10(c / mass[place[raw[w]]]) for w, c in head.items()] + [0.0])
        self.base_of = np.array([math.log10(c + 0.1) - self.base_den for c in head.values()] + [0.0])
        self.unseen, self.share = [], []
        for n, _, once in tails:
            u = min(0.9, (once + 0.5) / (n + 1))
            self.unseen.append(math.log10(u))
            self.share.append(math.log10(1 - u) - math.log10(max(1, n)))
        self.base_end = math.log10(ends + 0.1) - self.base_den
        self.net = Network(self.classes)
        mass[self.tail0 : self.end] = [n + once for n, _, once in tails]
        mass[self.end] = ends
        self.net.b[:] = np.log((mass + 0.5) / (mass.sum() + 0.5 * self.classes))  # how frequent classes are

    def placed(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words (-1: not of the head), which of them are of the tail, and the classes of all and the end."""
        at = np.fromiter(map(self.words.get, ws, repeat(-1)), np.int64, len(ws))
        tail = np.flatnonzero(at < 0)
        classes = np.append(self.class_of[at], self.end)
        if len(tail):
            classes[tail] = [self.tail0 + tail_class(ws[i]) for i in tail.tolist()]
        return at, tail, classes

    def classes_of(self, ws: list[bytes]) -> np.ndarray:
        return self.placed(ws)[2]

    def fit(self, texts: list[list[bytes]]) -> None:
        if texts:
            lanes, begins = packed([self.classes_of(t) for t in texts], 24)
            self.net.train(lanes[0], begins)

    def fit_more(self, batches: Iterator[list[str]], rate: float) -> tuple[np.ndarray, int]:
        """The weights, and on how many tokens they were trained further: all of every text, batch after batch."""
        net, moments, seen, long = self.net.like(self.net.flat()), [], 0, []

        def on(seqs: list[np.ndarray]) -> int:
            lanes, begins = packed(seqs, LANES)
            for own in _even(lanes[0], begins):  # what is longer goes on alone, not beside padding
                net.train(*own, epochs=1, rate=rate * 2, moments=moments)  # an only epoch has half the rate
            return sum(map(len, seqs))

        for texts in batches:
            seqs = [self.classes_of(tokens(t)) for t in texts]
            # long texts wait for each other: few lanes cost as much time a step as many
            long += [x for x in seqs if len(x) > LONG]
            if len(seqs := [x for x in seqs if len(x) <= LONG]):
                seen += on(seqs)
            if sum(map(len, long)) > LONG_HELD:
                seen += on(long)
                long = []
        if long:
            seen += on(long)
        return net.flat(), seen

    def score(self, texts: list[str]) -> tuple[list[tuple[int, int, float, float]], list[Counter]]:
        """(tokens, head tokens and the end, base, score) of texts, without the tail's words; these, counted."""
        seqs, out, rare = [], [], []
        for t in texts:
            ws = tokens(t)
            at, tail, classes = self.placed(ws)
            seqs.append(classes)
            rare.append(Counter([ws[i] for i in tail.tolist()]))
            out.append((len(ws) + 1, len(ws) - len(tail) + (self.ends > 0), float(self.base_of[at].sum()) + self.base_end, float(self.share_of[at].sum())))
        (lanes, owners), begins = packed(seqs, LANES)
        gained = np.zeros(len(texts))
        steps, width = max(map(len, lanes)), len(lanes)
        state = np.zeros((width, HIDDEN), np.float32)
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        lengths = np.array([len(lanes[i]) for i in order])
        first = np.cumsum(lengths) - lengths
        # lanes one after the other, longest first: a window takes its part of each
        every, owner_of, begin_of = (np.concatenate([x[i] for i in order]) for x in (lanes, owners, begins))
        last = np.full(width, self.classes)
        for a in range(0, steps, WINDOW):
            live = int((lengths > a).sum())
            step = np.arange(a, min(a + WINDOW, steps))[:, None]
            there = step < lengths[:live]
            place = np.where(there, first[:live] + step, 0)
            target = np.where(there, every[place], 0)
            owner = np.where(there, owner_of[place], -1)
            fresh = begin_of[place] & there
            inputs = np.vstack([last[None, :live], target[:-1]])
            inputs[fresh] = self.classes
            states, state = self.net.run(inputs, fresh, state[:live])
            last = target[-1]
            logs = self.net.log_probabilities(states, target)
            on = owner >= 0
            gained += np.bincount(owner[on], logs[on].astype(np.float64), len(texts))
        return [(n, k, b, s + g / math.log(10)) for (n, k, b, s), g in zip(out, gained.tolist(), strict=True)], rare


def packed(seqs: list[np.ndarray], width: int):
    """Texts one after the other in lanes of about equal length: (lanes, owners), begins."""
    width = min(width, len(seqs))
    load = [(0, i) for i in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for k in sorted(range(len(seqs)), key=lambda k: -len(seqs[k])):
        n, i = heapq.heappop(load)
        held[i].append(k)
        heapq.heappush(load, (n + len(seqs[k]), i))
    lanes = [np.concatenate([seqs[k] for k in own]) for own in held]
    owners = [np.concatenate([np.full(len(seqs[k]), k) for k in own]) for own in held]
    begins = []
    for own in held:
        f = np.zeros(sum(len(seqs[k]) for k in own), bool)
        f[np.cumsum([0] + [len(seqs[k]) for k in own[:-1]])] = True
        begins.append(f)
    return (lanes, owners), begins


def _even(lanes: list[np.ndarray], begins: list[np.ndarray]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Lanes in groups of which each has at least half the length of its longest."""
    order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
    out: list[list[int]] = []
    for i in order:
        if not out or 2 * len(lanes[i]) < len(lanes[out[-1][0]]):
            out.append([])
        out[-1].append(i)
    return [([lanes[i] for i in own], [begins[i] for i in own]) for own in out]


class Groups:
    """Groups of texts, by how often they have frequent words."""

    def __init__(self, texts: list[list[bytes]], n: int = TOPICS):
        counts: Counter = Counter(w for t in texts for w in t)
        self.frequent = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FEATURES])}
        x = self.features(texts)
        centre = x[[int(x.sum(1).argmax())]] if len(x) else np.zeros((1, x.shape[1]))
        while len(centre) < min(n, len(x)):
            centre = np.vstack([centre, x[(x @ centre.T).max(1).argmin()]])
        self.move(centre)
        for _ in range(15 if len(x) else 0):
            self.move(*self.sums(x))

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        get = self.frequent.get
        x = np.zeros((len(texts), max(1, len(self.frequent))))
        other = repeat(x.shape[1])
        for i, t in enumerate(texts):
            x[i] = np.bincount(np.fromiter(map(get, t, other), np.int64, len(t)), minlength=x.shape[1] + 1)[:-1]
            if t and not x[i].any():
                x[i, 0] = 1  # without a frequent word, as with the first
        return np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centre.T).argmax(1)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.of(x)
        return np.array([x[own == k].sum(0) for k in range(len(self.centre))]), np.bincount(own, minlength=len(self.centre))

    def move(self, sums: np.ndarray, n: np.ndarray | None = None) -> None:
        """To the directions of these sums of texts; a group without texts stays."""
        if n is not None:
            sums = np.where((n > 0)[:, None], sums, self.centre)
        self.centre = sums / np.maximum(1e-9, np.sqrt((sums * sums).sum(1, keepdims=True)))


def _regrouped(groups: Groups, train: DataFrame) -> None:
    """Move the groups to the means of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(groups.centre.shape), np.zeros(len(groups.centre), np.int64)
        for b in batches:
            x, k = groups.sums(groups.features([tokens(t) for t in b.column("text").to_pylist()]))
            total += x
            n += k
        for k in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(n[k])]), pa.array([total[k].tolist()], pa.list_(pa.float64()))], names=["k", "n", "x"])

    total, n = np.zeros(groups.centre.shape), np.zeros(len(groups.centre), np.int64)
    for r in sorted(train.select("text").mapInArrow(run, "k long, n long, x array<double>").collect()):  # some rows of FEATURES numbers a partition
        total[r["k"]] += r["x"]
        n[r["k"]] += r["n"]
    groups.move(total, n)


def _counter(groups: Groups):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words, and how often each topic has them."""
        held: list[Counter] = [Counter() for _ in groups.centre]

        def out() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(held):
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(np.full(len(own), k)), pa.array(list(own.values()), pa.int64())], names=["word", "topic", "n"])
                own.clear()

        for b in batches:
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            for k, t in zip(groups.of(groups.features(texts)).tolist(), texts, strict=True):
                held[k].update(t)
                if sum(map(len, held)) >= FLUSH:
                    yield from out()
        yield from out()

    return counted


def _trained(model: Model, train: DataFrame, rate: float) -> None:
    """The average, by tokens, of the networks that the partitions train from the model's."""
    token = uuid.uuid4().hex
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = _model_of(token, shared).fit_more((b.column("text").to_pylist() for b in batches if b.num_rows), rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([weights.tolist()], pa.list_(pa.float64()))], names=["n", "w"])

    total, n = np.zeros(model.net.flat().size), 0
    for r in train.select("text").mapInArrow(run, "n long, w array<double>").collect():  # some thousand numbers a partition
        total += np.array(r["w"]) * r["n"]
        n += r["n"]
    shared.unpersist()
    if n:
        model.net = model.net.like(total / n)


_models: dict[str, Model] = {}


def _model_of(token: str, shared) -> Model:
    """The model in this worker process; only the last one is kept."""
    if token not in _models:
        _models.clear()
        _models[token] = shared.value
    return _models[token]


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows where held isn't true."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    own = own.withColumn("h", F.xxhash64("text"))
    train = own.where(~F.col("held"))
    ends = train.count()
    share = min(1.0, SAMPLE / max(1, train.agg(F.count_distinct("h")).first()[0]))
    sample = train.where((F.octet_length("text") <= LONGEST) & (F.pmod("h", F.lit(1 << 30)).cast("double") / (1 << 30) < share)).groupBy("h").agg(F.min("text").alias("text")).collect()  # about SAMPLE texts
    sample = [tokens(r["text"]) for r in sorted(sample, key=lambda r: r["h"])]
    groups = Groups(sample)
    _regrouped(groups, train)
    in_topic = [F.sum(F.when(F.col("topic") == k, F.col("n")).otherwise(0)) for k in range(len(groups.centre))]
    most = F.array(*in_topic)
    counted = train.select("text").mapInArrow(_counter(groups), "word binary, topic long, n long").groupBy("word")
    counts = written(counted.agg(F.sum("n").alias("c"), (F.array_position(most, F.array_max(most)) - 1).cast("int").alias("topic")))
    bands = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()  # about a thousand rows at most
    types, total = sum(b["n"] for b in bands), sum(b["c"] for b in bands) + ends
    types += ends > 0
    least, n = None, 0
    for b in bands:
        n += b["n"]
        if n > HEAD:
            break
        least = b["band"]
    in_head = F.floor(F.log2("c") * 16) >= least if least is not None else F.lit(False)
    known = counts.where(in_head).collect()  # HEAD words at most
    head, topic = {bytes(r["word"]): r["c"] for r in known}, {bytes(r["word"]): r["topic"] for r in known}
    tail = counts.where(~in_head).drop("topic")

    def tail_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((TAILS, 3), np.int64)
        for b in batches:
            k = np.array([tail_class(w) for w in b.column("word").to_pylist()], np.int64)
            c = b.column("c").to_numpy()
            for i, x in enumerate((c, np.ones(len(c)), c == 1)):
                held[:, i] += np.bincount(k, x, TAILS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS)), *[pa.array(held[:, i]) for i in range(3)]], names=["k", "n", "types", "once"])

    parts = {r["k"]: (r["n"], r["types"], r["once"]) for r in tail.mapInArrow(tail_parts, "k long, n long, types long, once long").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "types", "once")]).collect()}
    model = Model(head, topic, total, types, ends, [parts.get(k, (0, 0, 0)) for k in range(TAILS)])
    model.fit(sample)
    part = F.pmod(F.xxhash64("h", "doc_id"), F.lit(16))
    for own_part, rate in zip(ROUNDS, RATES, strict=True):
        _trained(model, train.where(part.between(own_part[0], own_part[-1])), rate)
    token = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)  # bounded by HEAD

    schema = "doc_id long, h long, held_out boolean, word binary, n long, k int, scores array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text (its tokens, -1 - known ones, scores), with a word that no text can have and that spreads them; one for each of its tail's words, counted, and their classes."""
        m = _model_of(token, shared)

        def rows(own: list[pa.Array], words: list[bytes], n, k, scores: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*own, pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), scores], names=["doc_id", "h", "held_out", "word", "n", "k", "scores"])

        for b in batches:
            if not b.num_rows:
                continue
            got, rare = m.score(b.column("text").to_pylist())
            own, kind = [b.column(c) for c in ("doc_id", "h", "held")], pa.list_(pa.float64())
            yield rows(own, [b" %d %d" % (h, i) for i, h in enumerate(own[1].to_pylist())], [g[0] for g in got], [-1 - g[1] for g in got], pa.array([g[2:] for g in got], kind))
            at, words, n = np.repeat(np.arange(b.num_rows), [len(r) for r in rare]), [w for r in rare for w in r], [c for r in rare for c in r.values()]
            for z in range(0, len(words), 100_000):
                some = words[z : z + 100_000]
                of = pa.array(at[z : z + 100_000])
                yield rows([c.take(of) for c in own], some, n[z : z + 100_000], list(map(tail_class, some)), pa.nulls(len(some), kind))

    scored = own.select("doc_id", "h", "held", "text").mapInArrow(run, schema)
    lit = lambda xs: F.array(*map(F.lit, xs))
    text, seen, n = F.col("k") < 0, F.col("c").isNotNull(), F.col("n")
    sums = scored.join(tail, "word", "left").groupBy("doc_id", "h", "held_out").agg(
        F.sum(F.when(text, 1).otherwise(0)).alias("times"),
        F.sum(F.when(text, n).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(text, -1 - F.col("k")).when(seen, n).otherwise(0)).alias("known"),
        F.sum(F.when(text, F.get("scores", F.lit(0))).otherwise(n * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - model.base_den))).alias("base"),
        F.sum(F.when(text, F.get("scores", F.lit(1))).otherwise(n * F.when(seen, F.log10("c") + F.get(lit(model.share), "k")).otherwise(F.get(lit(model.unseen), "k")))).alias("model"),
    )
    # equal rows met each other in the sums: each gets its part
    all_ = sums.selectExpr("doc_id", "held_out", "n_tokens div times as n_tokens", "known div times as known", "base / times as base", "model / times as model", "explode(array_repeat(0, cast(times as int))) as copy")
    return all_.select("doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model" if ends else "base").alias("score"))
