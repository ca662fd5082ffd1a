"""Operator 12: a log-bilinear language model, trained with noise-contrastive estimation, scores texts.

Words have classes: the SHORT most common ones and the end of a text one each, the other LISTED ones BINS bins by count, all
the rest, unknown words included, one. A class is predicted from the classes of the two tokens before it: their vectors, each through
its place's matrix, add up to a prediction, whose product with a class's vector plus its bias is its score. Training
pushes the scores of what follows over those of classes drawn at random (shared by a batch), so it never normalises; scores
of texts are normalised, over all classes in batched matrix products, once for a task and pair of classes. Within a
bin a word has its share of the bin's count; within the last class that of its count plus one, where all unknown words are one.

All training documents are counted, and each of their tokens is an example, once: the texts are dealt to ROUNDS rounds by
hash; in a round every task goes over its own texts from one common start, and the parameters are averaged by examples. What is
broadcast are the parameters and the LISTED words; counts of the rest, which grow with the corpus, are joined.

Cases: a null text is an empty one, which is its end alone; a null id is in training (its remainder isn't 2); repeated rows count and are scored each;
without training documents the base is one for every token and all that the model knows is that words are unknown; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words with a count of their own in every task, at most; of these so many are classes, the rest is in so many bins.
LISTED, SHORT, BINS = 1 << 16, 480, 30
#: Numbers of a class's vector; classes drawn against a batch of so many examples; step; rounds that share the texts.
SIZE, NOISE, BATCH, STEP, ROUNDS = 24, 64, 1024, 0.05, 2
#: The end of a text among the words, which no word can be.
END = " "
#: Words counted before partial counts leave a task; parameters of a row that leaves it; tokens of a block that is scored.
HELD, BLOCK, AT_ONCE = 1 << 20, 4096, 1 << 16


@dataclass
class Words:
    """Numbers of the listed words (the end is 0, what isn't listed the last), their classes and their log10 shares of the base and of the class."""

    number: dict[bytes, int]
    classes: np.ndarray
    base: np.ndarray
    share: np.ndarray
    counts: np.ndarray  # by class
    total: int
    rest: int  # counts and words of the last class, and one

    @property
    def start(self) -> int:
        return len(self.counts)


class _Number(dict):
    def __missing__(self, w: bytes) -> int:
        return self[b""]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def listed(top: list[tuple[str, int]], end: int, total: int, distinct: int, short: int = SHORT, bins: int = BINS) -> Words:
    """From the listed words, most common first, with their counts."""
    c = np.array([end, *(n for _, n in top), 0], dtype=np.int64)
    own = min(short, len(top))
    more = np.cumsum(c[own + 1 : -1])
    binned = np.unique((more - 1) * bins // more[-1], return_inverse=True)[1] if len(more) else np.array([], dtype=np.int64)
    classes = np.concatenate([np.arange(own + 1), own + 1 + binned, [own + 1 + (binned.max() + 1 if len(binned) else 0)]]).astype(np.int64)
    rest = total - int(c.sum())
    counts = np.bincount(classes, weights=c).astype(np.int64)
    counts[-1] = rest
    share = np.zeros(len(c))
    share[own + 1 : -1] = np.log10(c[own + 1 : -1] / counts[classes[own + 1 : -1]])
    base = np.log10((c + 1) / (total + distinct + 1))
    base[-1] = 0.0  # added once their counts are known
    number = {b" ": 0, b"": len(c) - 1} | {w.encode("utf-8", "surrogatepass"): i + 1 for i, (w, _) in enumerate(top)}
    return Words(number, classes, base, share, counts, total, rest + distinct - len(top) - (end > 0) + 1)


@dataclass
class Model:
    """Vectors of the classes before (with the start of a text), matrices of the two places, vectors and biases of what follows; examples it was trained on."""

    before: np.ndarray
    place: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    examples: int = 0

    @classmethod
    def initial(cls, counts: np.ndarray, size: int = SIZE) -> Model:
        rng, n = np.random.default_rng(12), len(counts)
        p = (counts + 1) / (counts.sum() + n)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(n + 1, size), np.stack([np.eye(size, dtype=np.float32)] * 2) + draw(2, size, size) / 4, draw(n, size), np.log(p).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.place, self.after, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by their places."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros((n, *rows.shape[1:]), dtype=rows.dtype)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradient(m: Model, x: np.ndarray, y: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> list[np.ndarray]:
    """Of the noise-contrastive log likelihood, in the mean over the batch: x are the two classes before y, noise the classes drawn for all."""
    r = [m.before[x[:, j]] for j in range(2)]
    q = r[0] @ m.place[0] + r[1] @ m.place[1]
    ay, an = m.after[y], m.after[noise]
    k = np.float32(np.log(len(noise)))
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    dy = 1 - sigmoid((q * ay).sum(axis=1) + m.bias[y] - log_noise[y] - k)
    dn = -sigmoid(q @ an.T + (m.bias[noise] - log_noise[noise] - k))
    dq = dy[:, None] * ay + dn @ an
    at = np.concatenate([y, noise])
    after = _summed(at, np.concatenate([dy[:, None] * q, dn.T @ q]), len(m.after))
    bias = _summed(at, np.concatenate([dy, dn.sum(axis=0)]), len(m.bias))
    before = _summed(np.concatenate([x[:, 0], x[:, 1]]), np.concatenate([dq @ m.place[0].T, dq @ m.place[1].T]), len(m.before))
    place = np.stack([r[j].T @ dq for j in range(2)])
    return [g / np.float32(len(y)) for g in (before, place, after, bias)]


class Trainer:
    """Adaptive steps over batches of examples."""

    def __init__(self, m: Model, counts: np.ndarray, seed: list[int], step: float = STEP):
        self.m, self.step, self.rng = m, step, np.random.default_rng(seed)
        p = (counts + 1) / (counts.sum() + len(counts))
        self.noise, self.log_noise = np.cumsum(p), np.log(p).astype(np.float32)
        self.seen = [np.full_like(a, 1e-6) for a in m.parts()]

    def take(self, x: np.ndarray, y: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), len(self.noise) - 1)
        for a, g, s in zip(self.m.parts(), gradient(self.m, x, y, noise, self.log_noise), self.seen):
            s += g * g
            a += np.float32(self.step) * g / np.sqrt(s)


def windows(texts: list[list[int]], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, number): for each token of the texts, ends included, the two classes before it, its class, and its word's number."""
    flat = np.array([i for t in texts for i in (-1, -1, *t, 0)], dtype=np.int64)
    c = np.where(flat < 0, words.start, words.classes[flat])
    at = np.flatnonzero(flat >= 0)
    return np.stack([c[at - 2], c[at - 1]], axis=1), c[at], flat[at]


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> Model:
    """The model of all tokens of the texts of docs, averaged over its tasks in each round."""
    spark = docs.sparkSession
    m = Model.initial(words.counts)
    shared = spark.sparkContext.broadcast(words)
    size = -(-m.flat().size // BLOCK)

    for k in range(rounds):
        start = spark.sparkContext.broadcast(m.flat())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = shared.value
            number = _Number(words.number)
            own = Model.initial(words.counts).filled(start.value)
            task = TaskContext.get()
            t = Trainer(own, words.counts, [k, task.partitionId() if task else 0], STEP / (k + 1))
            x, y, n = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64), 0
            for b in batches:
                for at in range(0, len(b), 64):
                    nx, ny, _ = windows([list(map(number.__getitem__, split(s))) for s in b["text"].iloc[at : at + 64]], words)
                    x, y = np.concatenate([x, nx]), np.concatenate([y, ny])
                    while len(y) >= BATCH:
                        t.take(x[:BATCH], y[:BATCH])
                        x, y, n = x[BATCH:], y[BATCH:], n + BATCH
            if len(y):
                t.take(x, y)
                n += len(y)
            if n:
                flat = own.flat() * n
                yield pd.DataFrame({"block": range(size), "n": n, "v": [flat[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(size)]})

        def added(batches):
            total: dict[int, list] = {}
            for b in batches:
                for i, n, v in zip(b["block"], b["n"], b["v"]):
                    v = np.frombuffer(v)
                    total[i] = [total[i][0] + n, total[i][1] + v] if i in total else [n, v]
            yield pd.DataFrame({"block": list(total), "n": [n for n, _ in total.values()], "v": [(v / n).tobytes() for n, v in total.values()]})

        kind = "block int, n long, v binary"
        own = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        parts = own.mapInPandas(run, kind).repartition("block").mapInPandas(added, kind).collect()
        if parts:
            m, examples = m.filled(np.concatenate([np.frombuffer(v) for *_, v in sorted(parts)])), m.examples + parts[0].n
            m.examples = examples
    return m


def log_normaliser(m: Model, x: np.ndarray) -> np.ndarray:
    """The log of the sum of all classes' scores, each exponentiated, after the pairs of classes x."""
    q = m.before[x[:, 0]] @ m.place[0] + m.before[x[:, 1]] @ m.place[1]
    s = q @ m.after.T + m.bias
    top = s.max(axis=1)
    return np.log(np.exp(s - top[:, None]).sum(axis=1, dtype=np.float64)) + top


class Scorer:
    """Normalised log10 probabilities; a pair of classes is normalised once."""

    def __init__(self, m: Model):
        self.m, n = m, len(m.before)
        self.known = np.full(n * n, np.nan)
        self.first, self.second = m.before @ m.place[0], m.before @ m.place[1]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, out = len(self.m.before), np.empty(len(y))
        for at in range(0, len(y), AT_ONCE):
            a, b, c = x[at : at + AT_ONCE, 0], x[at : at + AT_ONCE, 1], y[at : at + AT_ONCE]
            pair = a * n + b
            new = np.unique(pair[np.isnan(self.known[pair])])
            for i in range(0, len(new), 4096):
                p = new[i : i + 4096]
                self.known[p] = log_normaliser(self.m, np.stack([p // n, p % n], axis=1))
            s = np.einsum("ij,ij->i", self.first[a] + self.second[b], self.m.after[c]) + self.m.bias[c]
            out[at : at + AT_ONCE] = (s - self.known[pair]) / np.log(10)
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): all words of the texts, and their ends as END."""

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(split(t))
                c[b" "] += 1
                if len(c) >= HELD:
                    yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in c], "c": list(c.values())})
                    c.clear()
        yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in c], "c": np.array(list(c.values()), dtype=np.int64)})

    return docs.select("text").mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scores(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", most: int = LISTED) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of docs; those with `held_out` train nothing."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("string").alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))
    training = d.filter("not held_out")
    counts = written(word_counts(training), "word-counts")
    total, distinct, end = counts.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("word") == END, F.col("c")))).first()
    total, end = total or 0, end or 0
    # A histogram of counts in steps of a sixteenth of a doubling says down to which step there are few enough words to list.
    level = F.floor(F.log2("c") * 16)
    single = counts.filter(F.col("word") != END)
    steps, n = sorted(single.groupBy(level.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True), 0
    least = steps[0].at + 1 if steps else 0
    for at, k in steps:
        n += k
        if n > most:
            break
        least = at
    top = sorted(single.filter(level >= least).collect(), key=lambda r: (-r.c, r.word))
    words = listed([tuple(r) for r in top], end, total, distinct)
    model = train(training, words)
    shared = spark.sparkContext.broadcast((words, model))

    def run(batches):
        words, m = shared.value
        number, score = _Number(words.number), Scorer(m)
        unlisted = number[b""]
        for b in batches:
            out = []
            for at in range(0, len(b), 64):
                part = [split(s) for s in b["text"].iloc[at : at + 64]]
                ids = [list(map(number.__getitem__, t)) for t in part]
                x, y, at_word = windows(ids, words)
                doc = np.repeat(np.arange(len(part)), [len(t) + 1 for t in part])
                sums = [np.bincount(doc, weights=w, minlength=len(part)) for w in (words.base[at_word], score(x, y) + words.share[at_word], (at_word < unlisted) & ((at_word > 0) | (words.counts[0] > 0)))]
                for j, (t, i) in enumerate(zip(part, ids)):
                    rest = Counter(w for w, k in zip(t, i) if k == unlisted)
                    out.append((len(t) + 1, int(sums[2][j]), sums[0][j], sums[1][j], b" ".join(rest).decode("utf-8", "surrogatepass"), list(rest.values())))
            o = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "model", "rest", "times"])
            yield pd.concat([b[["id", "held_out"]].reset_index(drop=True), o], axis=1)

    s = d.mapInPandas(run, "id string, held_out boolean, n_tokens long, n_known long, base double, model double, rest string, times array<long>")
    s = s.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    s = written(s.withColumn("row", F.monotonically_increasing_id()), "scored")
    # What isn't listed is too rare in training to make a hot key; a text's own words are one row each.
    rest = s.filter("rest <> ''").select("row", F.explode(F.arrays_zip(F.split("rest", " ").alias("word"), F.col("times").alias("times"))).alias("w")).select("row", "w.word", "w.times")
    c = F.coalesce("c", F.lit(0))
    share = lambda of: F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(of))))
    rest = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), share(total + distinct + 1).alias("b"), share(words.rest).alias("m"))
    s = s.drop("rest", "times").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return s.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("model", "m").alias("score"))
