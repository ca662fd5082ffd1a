"""Operator 8: language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes (A-Z lower-cased), one gated unit layer in each direction, and gives every position
a distribution over the languages; a document's probabilities are the mean over all of its positions. Texts are
read whole, in consecutive windows of WINDOW bytes that start from a zero state. It is trained in numpy by
backpropagation through time on a bounded sample: about `sample` documents of each language, drawn by the hash of
their id, `pieces` random windows of each.

Cases: a null text or one without letters is `und` with score 0; documents without a language teach nothing; if
nothing can be learned every document is `und`; repeated rows get the same answer; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = 8
WINDOW = 128
#: Windows that go through the network side by side.
LANES = 2048


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


class Network:
    """Weights: for each direction an input table E (3H x 256, biases included) and recurrent U (3H x H); output V, c.

    Rows of E and U: update gate, reset gate, candidate. The gates' rows are halved, so that one tanh over all
    gives sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        g = np.random.default_rng(seed)
        self.languages = languages
        self.E = [g.normal(0, 0.4, (3 * hidden, 257)).astype(np.float32) for _ in range(2)]  # 256: padding
        self.U = [g.normal(0, 0.4 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32) for _ in range(2)]
        self.V = g.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.E, *self.U, self.V, self.c]

    def _run(self, x: np.ndarray, d: int, keep: bool):
        """States (T, H, B) of direction d over x (T, B), and with keep the gates for the way back."""
        h_size = self.U[d].shape[1]
        steps, lanes = x.shape
        out = np.empty((steps, h_size, lanes), dtype=np.float32)
        gates = np.empty((steps, 3 * h_size, lanes), dtype=np.float32) if keep else None
        rec = np.empty((steps, h_size, lanes), dtype=np.float32) if keep else None
        h = np.zeros((h_size, lanes), dtype=np.float32)
        e, u = self.E[d], self.U[d]
        a = np.empty((3 * h_size, lanes), dtype=np.float32)
        uh = np.empty_like(a)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=uh)
            zr = a[: 2 * h_size]
            zr += uh[: 2 * h_size]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, n, un = a[:h_size], a[h_size : 2 * h_size], a[2 * h_size :], uh[2 * h_size :]
            if keep:
                rec[t] = un
            un *= r
            n += un
            np.tanh(n, out=n)
            if keep:
                gates[t] = a
            # h = n + z (h - n)
            np.subtract(h, n, out=out[t])
            out[t] *= z
            out[t] += n
            h = out[t]
        return out, gates, rec

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Languages at every position: (T, L, B) for bytes x (T, B)."""
        logits = np.matmul(self.V[:, : self.U[0].shape[1]], self._run(x, 0, False)[0])
        logits += np.matmul(self.V[:, self.U[0].shape[1] :], self._run(x, 1, False)[0])
        logits += self.c
        np.exp(logits, out=logits)  # the states are in (-1, 1), so logits stay small
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions in mask (T, B), and the gradient of each of weights()."""
        size = self.U[0].shape[1]
        runs = [self._run(x, d, True) for d in range(2)]
        states = np.concatenate([runs[0][0], runs[1][0]], axis=1)
        p = np.exp(np.matmul(self.V, states) + self.c)
        p /= p.sum(axis=1, keepdims=True)
        own = np.take_along_axis(p, np.broadcast_to(y[None, None, :], (x.shape[0], 1, len(y))), axis=1)[:, 0]
        total = mask.sum()
        loss = float(-(np.log(own + 1e-9) * mask).sum() / total)
        delta = p
        np.put_along_axis(delta, np.broadcast_to(y[None, None, :], (x.shape[0], 1, len(y))), own[:, None] - 1, axis=1)
        delta *= mask[:, None] / total
        gv = np.einsum("tlb,thb->lh", delta, states, optimize=True)
        gc = delta.sum(axis=(0, 2))[:, None]
        ds = np.matmul(self.V.T, delta)
        ge, gu = [], []
        for d in range(2):
            out, gates, rec = runs[d]
            u = self.U[d]
            e_grad = np.zeros((self.E[d].shape[1], 3 * size), dtype=np.float32)
            u_grad = np.zeros_like(u)
            dh = np.zeros((size, x.shape[1]), dtype=np.float32)
            order = range(x.shape[0] - 1, -1, -1) if d == 0 else range(x.shape[0])
            for t in order:
                before = t - 1 if d == 0 else t + 1
                hb = out[before] if 0 <= before < x.shape[0] else np.zeros_like(dh)
                dh = dh + ds[t, d * size : (d + 1) * size]
                z, r, n = gates[t, :size], gates[t, size : 2 * size], gates[t, 2 * size :]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (hb - n) * z * (1 - z) * 2  # twice: the gates' rows are halved
                dr = dn * rec[t] * r * (1 - r) * 2
                da = np.concatenate([dz, dr, dn])
                du = np.concatenate([dz, dr, dn * r])
                np.add.at(e_grad, x[t], da.T)
                u_grad += du @ hb.T
                dh = dh * z + u.T @ du
            ge.append(e_grad.T)
            gu.append(u_grad)
        return loss, [*ge, *gu, gv, gc]


def fit(texts: list[str], labels: list[str], hidden: int = HIDDEN, pieces: int = 3, steps: int = 500, batch: int = 128,
        length: int = 96, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network trained on random windows of the texts; the same texts in the same order give the same network."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net = Network(languages, hidden, seed)
    g = np.random.default_rng(seed)
    rows, ys = [], []
    for t, y in zip(texts, labels):
        raw = np.frombuffer(_bytes(t), dtype=np.uint8)
        for _ in range(pieces if len(raw) else 0):
            at = int(g.integers(0, max(1, len(raw) - length + 1)))
            piece = np.full(length, 256, dtype=np.int64)
            piece[: len(raw[at : at + length])] = raw[at : at + length]
            rows.append(piece)
            ys.append(languages.index(y))
    if not rows:
        return None
    x, y = np.array(rows).T, np.array(ys)
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    by = [np.nonzero(y == k)[0] for k in range(len(languages))]
    by = [b for b in by if len(b)]
    for s in range(1, steps + 1):
        pick = np.concatenate([g.choice(b, -(-batch // len(by))) for b in by])  # every language alike
        _, grads = net.gradients(x[:, pick], y[pick], (x[:, pick] < 256).astype(np.float32))
        lr = rate * min(1.0, 2 * (1 - s / (steps + 1)))
        for w, d, a, b in zip(net.weights(), grads, m, v):
            np.clip(d, -1, 1, out=d)
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            w -= lr * (a / (1 - 0.9**s)) / (np.sqrt(b / (1 - 0.99**s)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text. All windows of all texts go through the network, LANES at a time."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    raws = [np.frombuffer(_bytes(t), dtype=np.uint8) if t and any(map(str.isalpha, t)) else None for t in texts]
    owner = [i for i, r in enumerate(raws) if r is not None]
    if not owner:
        return lang, score
    # Windows sorted by length, so that short ones share lanes with short ones.
    starts = [(min(WINDOW, len(raws[i]) - s), i, s) for i in owner for s in range(0, len(raws[i]), WINDOW)]
    starts.sort(reverse=True)
    sums = np.zeros((len(texts), len(net.languages)))
    for k in range(0, len(starts), LANES):
        part = starts[k : k + LANES]
        x = np.full((len(part), part[0][0]), 256, dtype=np.int64)
        for j, (n, i, s) in enumerate(part):
            x[j, :n] = raws[i][s : s + n]
        ends = np.array([n for n, _, _ in part])
        p = net.probabilities(np.ascontiguousarray(x.T))
        if ends[-1] < len(p):  # nothing of the padding counts
            p *= (np.arange(len(p))[:, None] < ends[None, :])[:, None]
        np.add.at(sums, np.array([i for _, i, _ in part]), p.sum(axis=0, dtype=np.float64).T)
    for i in owner:
        best = int(sums[i].argmax())
        lang[i], score[i] = net.languages[best], float(min(1.0, sums[i, best] / len(raws[i])))
    return lang, score


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", sample: int = 300, total: int = 20_000,
          piece: int = 2000, **fit_options) -> Network | None:
    """A network fitted to a bounded sample of the labelled documents, of all their languages.

    Documents whose crc32(id) mod 3 is 1 are held out. Of a language's documents each is taken with the chance that
    makes `sample` of them, or `total` divided by the languages if that is less, as the hash of its id falls: no
    language is left out, and no group is ever sorted or gathered. What comes to the driver is about `total`
    texts at most, each cut to `piece` characters at a random place.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.crc32(key) % 3 != 1))
    d = d.select(F.col(label).cast("string").alias("label"), F.md5(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return None
    each = min(sample, max(1, total // len(counts)))
    share = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, each / n))))
    drawn = F.pmod(F.xxhash64("key", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    at = F.greatest(F.lit(0), F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - piece)))
    d = d.filter(drawn < F.element_at(share, F.col("label"))).select("label", "key", "h", F.substring("text", at + 1, F.lit(piece)).alias("text"))
    rows = d.dropDuplicates(["label", "key", "h"]).collect()
    rows.sort(key=lambda r: (r["label"], r["key"], r["h"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], **fit_options)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(id, keep..., lang_pred, score), a row per row of docs; no shuffle. Kept columns of the last two names give way to them."""
    keep = [k for k in keep if k not in (id_col, "lang_pred", "score")]
    names = [id_col, *keep]
    d = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(names)), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            # a bounded number of bytes at a time
            lang, score, at = [], [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held < 1 << 22):
                    held += len(texts[end] or "")
                    end += 1
                got = predict(net, texts[at:end]) if net else (["und"] * (end - at), [0.0] * (end - at))
                lang += got[0]
                score += got[1]
                at = end
            out = b.drop(columns=["text"])
            out["lang_pred"], out["score"] = lang, score
            yield out

    fields = ", ".join(f"c{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(names))
    return d.mapInPandas(run, f"{fields}, lang_pred string, score double").toDF(*names, "lang_pred", "score")


def speaking(docs: DataFrame, net: Network | None, least: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are in a learned language with a score of `least` or more; no shuffle."""
    names = docs.columns
    d = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(names)))
    own = f"c{names.index(text)}"
    named = identify(d.withColumn("text", F.col(own)), net, "c0", "text", *d.columns[1:])
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(names)))
