"""Op 8: toxicity of texts after noisy-channel deobfuscation.

A word that looks written over (digits or signs among letters, a letter three times in a row, single letters with spaces
between) is read as the output of a noisy channel: every character may stand for itself, for the letter it is drawn like,
for a repetition of the letter before it, or for nothing, and a space between single letters for nothing or for the end of
a word. An exact Viterbi search over this lattice, whose states are the last two letters, under a character trigram model
of the training texts' words, restores the likeliest words, whatever their length. Restored words are then looked up in a lexicon of word
beginnings and whole words with their log-odds of toxic against other labelled texts, and a logistic regression over what
a text holds of it gives the score.

Character model, lexicon and regression are fitted on all labelled training rows, whole texts of any length. Counts of
trigrams, and of the texts that hold a feature, are made by partitions and added up; the Newton steps of the regression add
up their sums over all texts. Each half of the texts (by a hash, so equal texts are in one) chooses features for the other,
so that the regression sees the lexicon as new texts do. What goes to the driver is the model: at most GRAMS trigrams (the
most frequent; others back off to pairs of letters) and FEATURES features. Scoring reads whole texts. A null or empty text has
no words and gets the score of a text without any hit. Without both labels in the training rows every score is 0.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import appended, arrow, drop_written, release, small_batches, sole, written

#: Trigrams of the character model.
GRAMS = 300_000
#: Different trigrams, or features, that a worker counts before it hands them on.
FLUSH = 100_000
#: Rows of labels that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Bits that tell which features enough toxic texts have; with many more features than bits they only save less work.
BITS = 1 << 21
#: Fewest toxic texts with a feature, least log-odds, most features, prefix lengths.
LEAST, ODDS, FEATURES, PREFIX = 4, 2.5, 8000, (4, 5, 6, 7)
THRESHOLD = 0.3
#: Words whose worth a worker keeps, those from before included.
CACHE_WORDS = 100_000
#: Words whose restored form a worker keeps, those from before included, and how long they may be.
CACHE_RESTORED, CACHE_CHARS = 40_000, 64
#: Ways to read a character after two letters that a worker keeps.
CACHE_WAYS = 20_000

# The letters that a sign is drawn like.
DRAWN = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "&": "e", "%": "o"}

_edge = re.compile(r"^[\W_]+|[\W_]+$")
_strange = re.compile(r"[^a-zß-ɏ]|(.)\1\1")
_doubled = re.compile(r"(.)\1", re.DOTALL)
#: What _edge finds in ASCII.
_SIGNS = "".join([c for c in map(chr, range(128)) if not c.isalnum()])
_nothing = re.compile(r"_|[^\w\s%s]" % re.escape("".join(DRAWN)))
_spaced = re.compile(r"(?:^|(?<=\s))\S(?:\s\S){2,}(?=\s|$)")


class Kept(dict):
    """Results by word. When half of `size` are kept, they only serve what is asked for again."""

    def __init__(self, size: int):
        self.half, self.before = size // 2, {}

    def find(self, w: str, make):
        """What get() doesn't have: make(w), or its result from before."""
        got = self.before.get(w)
        if got is None:
            got = make(w)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[w] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.before = {}


def grams(words: Counter) -> Counter:
    """Character trigrams of words, with their beginnings and ends."""
    some = [w for w in words if w.isalpha()]
    if not some:
        return Counter()
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 3
    chars = np.frombuffer(f"^^{'$^^'.join(some)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    key = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    inside = np.ones(len(chars), bool)  # not those from one word to the next
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    times = np.repeat(np.fromiter(map(words.__getitem__, some), np.int64, len(some)), sizes)
    order = np.argsort(key := key[inside[:-2]])
    key, times = key[order], times[:-2][inside[:-2]][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return Counter({chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): n for k, n in zip(key[first].tolist(), np.add.reduceat(times, first).tolist(), strict=True)})


class CharModel:
    """Character trigrams of words with backing off; log probabilities."""

    def __init__(self, words: Counter, tri: dict[str, int] | None = None):
        self.tri = Counter(grams(words) if tri is None else tri)
        self.two: Counter = Counter()
        self.bi: Counter = Counter()
        self.one: Counter = Counter()
        for s, n in self.tri.items():
            self.two[s[:2]] += n
            self.bi[s[1:]] += n
            self.one[s[1]] += n
        self.kept: dict[str, float] = {}
        self.ways: dict[str, dict[str, list]] = {}
        self.n_ways = 0
        self.restored = Kept(CACHE_RESTORED)

    def cost(self, s: str) -> float:
        """-log of the last character after the two before."""
        got = self.kept.get(s)
        if got is None:
            low = (self.bi[s[1:]] + 0.05) / (self.one[s[1]] + 2.5)
            got = self.kept[s] = -math.log((self.tri[s] + 2 * low) / (self.two[s[:2]] + 2))
        return got

    #: Costs of the channel: a sign for a letter, a sign for nothing, a digit for nothing, a letter repeated, a space for
    #: nothing, a space for the end of a word.
    SIGN, NOTHING, DIGIT, AGAIN, GAP, END = 0.7, 2.0, 8.0, 0.2, 0.3, 2.0

    def steps(self, c: str, last: str) -> list[tuple[float, str, str]]:
        """Ways to read c after the last two letters: cost, the last two letters then, what is written."""
        if c.isspace():
            return [(self.GAP, last, "")] + ([(self.END + self.cost(last + "$"), "^^", " ")] if last != "^^" else [])
        letter = c.isalpha()
        ways = [] if letter else [(self.DIGIT if c.isdigit() else self.NOTHING, last, "")]
        for x in c if letter else DRAWN.get(c, ""):
            more = 0.0 if letter else self.SIGN
            ways.append((more + self.cost(last + x), last[1] + x, x))
            if last[1] == x:
                ways.append((more + self.AGAIN, last, ""))
        return ways

    def best(self, s: str) -> tuple[float, str]:
        """The cost and the text of the likeliest reading of s; words in it have spaces between. No path is left out but
        those that end in the same two letters as a cheaper one."""
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        if self.n_ways > CACHE_WAYS:
            self.ways.clear()
            self.n_ways = 0
        for c in s:
            known = self.ways.get(c)
            if known is None:
                known = self.ways[c] = {}
            if len(states) == 1:
                ((last, (cost, path)),) = states.items()
                ways = known.get(last)
                if ways is not None and len(ways) == 1:  # nothing to choose from
                    more, key, x = ways[0]
                    states = {key: (cost + more, (path, x) if x else path)}
                    continue
            nexts: dict[str, tuple[float, tuple | None]] = {}
            for last, (cost, path) in states.items():
                ways = known.get(last)
                if ways is None:
                    ways = known[last] = self.steps(c, last)
                    self.n_ways += 1
                for more, key, x in ways:
                    own = cost + more
                    had = nexts.get(key)
                    if had is None or own < had[0]:
                        nexts[key] = own, ((path, x) if x else path)
            states = nexts
        cost, path = min(((cost + (self.cost(last + "$") if last != "^^" else 0.0), path) for last, (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, x = path
            out.append(x)
        return cost, "".join(reversed(out))

    def restore(self, s: str) -> str:
        s = _nothing.sub("", s)  # nothing in every reading
        # letters are read as themselves or as the letter before again
        if s.isalpha() and not _doubled.search(s):
            return s
        if len(s) > CACHE_CHARS:
            return self.best(s)[1]
        got = self.restored.get(s)
        return self.restored.find(s, lambda s: self.best(s)[1]) if got is None else got


def forms(w: str, model: CharModel) -> list[str]:
    """What a lower-case word may be read as: without its outer signs, and restored where it looks written over."""
    strange = _strange.search(w)
    if not strange and "÷" not in w:  # the only sign that isn't strange
        return [w]
    core = w.strip(_SIGNS) if w.isascii() else _edge.sub("", w)
    if not core:  # neither letter nor digit
        return []
    out = [core]
    if strange:
        for x in (w,) if core == w or not _strange.search(core) else (core, w):
            got = model.restore(x)
            if got and got not in out:
                out.append(got)
    return out


def features(w: str) -> list[str]:
    return ["=" + w] + [w[:n] for n in PREFIX if len(w) >= n]


def _held(w: str, wanted: list[int]) -> list[str]:
    """The features of a word that the bitmap has. No text has a longer beginning without the shorter ones."""
    out = []
    for n in PREFIX:
        if len(w) < n:
            break
        f = w[:n]
        h = zlib.crc32(f.encode()) & (BITS - 1)
        if not wanted[h >> 6] >> (h & 63) & 1:
            if not out:
                return out
            break
        out.append(f)
    h = zlib.crc32(f"={w}".encode()) & (BITS - 1)
    return [*out, "=" + w] if wanted[h >> 6] >> (h & 63) & 1 else out


def words_of(text: str, model: CharModel) -> list[str]:
    """The words of a text, and those that its runs of single letters spell: as restored, and from each letter on, as the
    ends of words in such a run are uncertain."""
    low = text.lower()
    out = low.split()
    # three single characters in a row, which a run has at least
    if b"\1\1\1" not in bytes(map((1).__eq__, map(len, out))):
        return out
    for m in _spaced.finditer(low):
        found = model.restore(m.group()).split()
        joined, most = "".join(found), max(PREFIX)
        out += found
        out += [joined[i : i + most] for i in range(len(joined) - min(PREFIX) + 1)]
    return out


class Toxicity:
    """The fitted model."""

    def __init__(self, model: CharModel, odds: dict[str, float], weights: list[float]):
        self.model, self.odds, self.weights = model, odds, weights
        self.kept, self.read = Kept(CACHE_WORDS), Kept(CACHE_WORDS // 2)
        self.starts = {f[: PREFIX[0]] for f in odds if len(f) >= PREFIX[0]}

    def worth(self, w: str) -> float:
        """The largest log-odds of what the word may be read as; 0 if the lexicon has nothing of it."""
        odds, most = self.odds, 0.0
        for x in forms(w, self.model):
            own = odds.get("=" + x)
            if own is not None and own > most:
                most = own
            if x[: PREFIX[0]] in self.starts:
                most = max(most, *[odds.get(x[:n], 0.0) for n in PREFIX if len(x) >= n])
        return most

    def features_of(self, text: str, wanted: list[int] | None = None) -> set[str]:
        """All features of what the text's words may be read as; with a bitmap (see _wanted), at least all that it has."""
        kept, out = self.read, set()

        def read(w: str) -> list[str]:
            return [f for x in forms(w, self.model) for f in (features(x) if wanted is None else _held(x, wanted))]

        for w in set(words_of(text, self.model)):
            x = kept.get(w)
            if x is None:
                x = kept.find(w, read)
            if x:
                out.update(x)
        return out

    def forget(self) -> None:
        """Leave no cache to the memory of an idle worker."""
        for cache in (self.kept, self.read, self.model.restored):
            cache.forget()
        for cache in (self.model.kept, self.model.ways):
            cache.clear()
        self.model.n_ways = 0

    def measures(self, text: str) -> list[float]:
        ws, kept = words_of(text, self.model), self.kept
        hits: dict[str, float] = {}
        n = 0
        for w in ws:
            x = kept.get(w)
            if x is None:
                x = kept.find(w, self.worth)
            if x:
                hits[w] = x
                n += 1
        return [1.0, max(hits.values(), default=0.0), math.log1p(len(hits)), math.log1p(1000 * n / (len(ws) + 20))]

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.weights, self.measures(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """text, k (2 * half + label) of all labelled rows where train (over doc_id) holds; written in the shared folder."""
    rows = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(rows, "doc_id")
    return written(texts.select("text", (2 * F.pmod(F.xxhash64("text"), F.lit(2)) + F.col("toxic")).cast("int").alias("k")))


def _counts(found: DataFrame, work) -> DataFrame:
    """f, k, n: how often work() of the batches (an iterator of k and what is counted) gives a string with a k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, own in held.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(np.full(len(own), k), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["f", "k", "n"])
            held.clear()

        for k, counted in work(batches):
            held.setdefault(k, Counter()).update(counted)
            if sum(map(len, held.values())) >= FLUSH:
                yield from out()
        yield from out()

    return found.mapInArrow(run, "f string, k int, n long")


def _characters(labelled: DataFrame) -> CharModel:
    def work(batches: Iterator[pa.RecordBatch]):
        words: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                words.update(t.lower().split())
                if len(words) >= FLUSH:
                    yield 0, grams(words)
                    words.clear()
        yield 0, grams(words)

    rows = _counts(labelled.select("text"), work).groupBy("f").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f").limit(GRAMS).collect()
    return CharModel(Counter(), {r["f"]: r["n"] for r in rows})


def _wanted(counts: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of all features that LEAST toxic texts have."""
    h = F.crc32("f").bitwiseAND(F.lit(BITS - 1)).cast("int")
    some = counts.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select(h.alias("h"))
    bits = np.zeros(BITS >> 6, np.int64)
    for i, x in some.groupBy(F.shiftright("h", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, h & 63)"))).collect():  # BITS / 64 rows at most
        bits[i] = x
    return bits.view(np.uint64)


def _lexicons(labelled: DataFrame, model: CharModel, n: list[int]) -> list[dict[str, float]]:
    """The features of half 0, of half 1 and of all texts, with their log-odds; n: texts of each k."""
    sc = labelled.sparkSession.sparkContext
    empty: dict[str, float] = {}
    shared = sc.broadcast((dict(model.tri), empty, []))

    def counted(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        token, bits = uuid.uuid4().hex, sc.broadcast(None if wanted is None else wanted.tolist())

        def work(batches: Iterator[pa.RecordBatch]):
            own, some = _model_of(token, shared), bits.value
            for b in batches:
                for t, k in zip(b.column("text").to_pylist(), b.column("k").to_pylist(), strict=True):
                    yield k, own.features_of(t, some)
            own.forget()

        return _counts(texts, work)

    # of the other texts only features that enough toxic ones have
    toxic = written(counted(labelled.where("k % 2 = 1"), None).groupBy("f", "k").agg(F.sum("n").alias("n")))
    others = counted(labelled.where("k % 2 = 0"), _wanted(toxic))
    by = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    counts = written(toxic.union(others).groupBy("f").agg(*by).where(F.col("n1") + F.col("n3") >= LEAST))
    out = []
    for ks in ((0,), (2,), (0, 2)):
        pos, neg = sum(F.col(f"n{k + 1}") for k in ks), sum(F.col(f"n{k}") for k in ks)
        odds = F.log((pos + 0.5) / (sum(n[k + 1] for k in ks) + 1)) - F.log((neg + 0.5) / (sum(n[k] for k in ks) + 1))
        rows = counts.where(pos >= LEAST).select(odds.alias("x"), "f").where(F.col("x") >= ODDS).orderBy(F.desc("x"), F.desc("f")).limit(FEATURES).collect()
        out.append({r["f"]: r["x"] for r in rows})
    drop_written(toxic, counts)
    return out


def _measured(labelled: DataFrame, model: CharModel, halves: list[dict[str, float]]) -> DataFrame:
    """y and the measures x1 to x3 of every text, by the lexicon of the half that it isn't in."""
    tokens = [uuid.uuid4().hex for _ in halves]
    shared = [labelled.sparkSession.sparkContext.broadcast((dict(model.tri), odds, [])) for odds in halves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ks = b.column("k").to_pylist()
            x = np.zeros((len(ks), 4))
            for half in (0, 1):
                own = _model_of(tokens[1 - half], shared[1 - half], 1)
                for i, (t, k) in enumerate(zip(b.column("text").to_pylist(), ks, strict=True)):
                    if k // 2 == half:
                        x[i] = own.measures(t)
            return pa.RecordBatch.from_arrays([pa.array([float(k % 2) for k in ks]), *[pa.array(x[:, i]) for i in (1, 2, 3)]], names=["y", "x1", "x2", "x3"])

        yield from arrow(batches, one)
        for token in tokens:
            _forget(token)

    return written(labelled.mapInArrow(run, "y double, x1 double, x2 double, x3 double"))


def _regression(rows: DataFrame) -> list[float]:
    """Weights of the logistic regression of y over 1 and the measures of all rows: Newton steps with a small penalty."""
    w = np.zeros(4)
    for _ in range(30):
        now = w

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(4), np.zeros((4, 4))
            for b in batches:
                y, *x = (c.to_numpy() for c in b.columns)
                x = np.column_stack([np.ones(len(y)), *x])
                p = 1 / (1 + np.exp(-x @ now))  # noqa: B023
                g += x.T @ (y - p)
                h += x.T @ (x * (p * (1 - p))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([[*g, *h.ravel()]], pa.list_(pa.float64()))], names=["s"])

        s = np.array([r["s"] for r in rows.mapInArrow(run, "s array<double>").collect()]).sum(0)  # 20 numbers a partition
        step = np.linalg.solve(s[4:].reshape(4, 4) + 0.1 * np.eye(4), s[:4] - 0.1 * w)
        w = w + step
        if abs(step).max() < 1e-10:
            break
    return [float(f"{x:.9g}") for x in w]  # sums of floats depend on the order of the rows in their last digits


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Toxicity:
    """The model of all labelled rows where train (over doc_id) holds."""
    small_batches(docs.sparkSession)
    labelled = _labelled(docs, labels, train)
    n = [0] * 4
    for r in labelled.groupBy("k").count().collect():  # four rows at most
        n[r["k"]] = r["count"]
    model = _characters(labelled)
    if not (n[0] + n[2] and n[1] + n[3]):
        drop_written(labelled)
        return Toxicity(model, {}, [-30.0, 0.0, 0.0, 0.0])
    *halves, odds = _lexicons(labelled, model, n)
    rows = _measured(labelled, model, halves)
    weights = _regression(rows)
    drop_written(labelled, rows)
    release(docs.sparkSession)
    return Toxicity(model, odds, weights)


_made: dict[str, Toxicity] = {}


def _model_of(token: str, parts, others: int = 0) -> Toxicity:
    """The model in this worker process; of the ones before, only the last `others` are kept."""
    if token not in sole(_made):
        tri, odds, weights = parts.value
        while len(_made) > others:
            del _made[next(iter(_made))]
        _made[token] = Toxicity(CharModel(Counter(), tri), odds, weights)
    return _made[token]


def _forget(token: str) -> None:
    """Empty the caches of a model of this worker process. A function of the module, as nested ones get a copy of _made."""
    if token in _made:
        _made[token].forget()


def score(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """docs with the score of every row; a column of that name is replaced."""
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((dict(model.model.tri), model.odds, model.weights))  # bounded by GRAMS and FEATURES

    def work(col):
        own = _model_of(token, shared)
        return [pa.array([own.score(t or "") for t in col.to_pylist()], pa.float64())]

    return appended(docs, [(name, T.DoubleType())], "text", work, lambda: _forget(token))


def reject(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    return score(docs, model, "__toxic").where(F.col("__toxic") < threshold).drop("__toxic")
