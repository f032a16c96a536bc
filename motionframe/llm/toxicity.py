"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its hashed word vector beside the mean of its hashed character n-gram vectors. Windows of
``WIDTH`` words that overlap by half cover the whole text; a forward and a backward recurrence read each
window, attention pools their states, and the text's score is that of its most toxic window. Only document labels are
known, so training alternates between choosing each document's most suspect window and fitting the network to it.
A long run without blanks enters by its parts between punctuation, and a long part as overlapping pieces, each a word of the windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fold, id_and_text, table

WIDTH, STEP = 32, 16
#: A run without blanks of more than LONGEST bytes is split at JOINTS; of a part that is still longer, PIECE bytes are read every STRIDE bytes.
LONGEST, PIECE, STRIDE = 64, 16, 8
JOINTS = re.compile(r"[!-/:-@\[-`{-~]+")
EDGES = ".,;:!?\"'()[]{}|-"


@dataclass(frozen=True)
class Settings:
    """``per_class``: the most labelled documents of each class that training reads (those of smallest hashed id), up to ``per_class_bytes``
    of text together. Texts of over ``longest`` bytes teach nothing. Scoring knows no such bounds.

    Every ``aside``-th of them only sets where a score is one half, where a clean one counts ``clean_weight`` times a toxic one.
    """

    per_class: int = 2000
    per_class_bytes: int = 12_000_000
    longest: int = 400_000
    hidden: int = 8
    word_rows: int = 1 << 14
    word_size: int = 8
    gram_rows: int = 1 << 15
    gram_size: int = 16
    rounds: int = 5
    least_steps: int = 300
    batch: int = 64
    keep_words: float = 0.5
    aside: int = 5
    clean_weight: float = 4.0
    rate: float = 0.01
    seed: int = 5


def words_of(text: str) -> list[str | bytes]:
    """The words of a text. A longer run than ``LONGEST`` bytes gives its parts; such a part gives its pieces (as bytes, with its own edges)."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST // 4:  # no character has more than four bytes
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST // 4 or len(w) <= LONGEST and w.isascii() or len(run := w.lower().strip(EDGES).encode()) <= LONGEST:
            out.append(w)
            continue
        run = run.decode()
        for part in [x for x in JOINTS.split(run) if x] or [run]:
            marked = b"<" + part.encode() + b">"
            if len(marked) <= LONGEST + 2:
                out.append(part)
            else:
                out += [marked[lo : lo + PIECE] for lo in (*range(0, len(marked) - PIECE, STRIDE), len(marked) - PIECE)]
    return out


class Words:
    """Distinct words to feature rows: a hashed word id and hashed 2- to 5-byte grams with edges, in growing flat arrays.

    Row 0 is padding. Words and pieces of longer runs (see ``words_of``) enter both hashes whole.
    """

    def __init__(self, word_rows: int, gram_rows: int):
        self.word_rows, self.gram_rows = word_rows, gram_rows
        self.index: dict[str | bytes, int] = {}

    def rows(self, split: list[list[str | bytes]]) -> tuple[list[np.ndarray], list[str | bytes]]:
        """Index rows of each text, and the words that were new (in row order)."""
        index, fresh = self.index, []
        for words in split:
            for w in words:
                if w not in index:
                    index[w] = len(index) + 1
                    fresh.append(w)
        return [np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)) for words in split], fresh

    def features(self, fresh: list[str | bytes], block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word ids, gram ids, where each word's grams start)`` of new words."""
        parts = [self._features(fresh[lo : lo + block]) for lo in range(0, len(fresh), block)] or [self._features([])]
        words, grams, counts = (np.concatenate(x) for x in zip(*parts))
        return words, grams, np.cumsum(counts, dtype=np.int64) - counts

    def _features(self, fresh: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [w if isinstance(w, bytes) else b"<" + w.lower().strip(EDGES).encode() + b">" for w in fresh]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        text = np.frombuffer(b"".join(raw) + b"\0" * 4, dtype=np.uint8).astype(np.uint64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        room = ends[owner] - np.arange(len(owner))  # bytes from here to the word's end
        ids, owners = [], []
        h = text[: len(owner)].copy()
        for n in range(2, 6):
            h = h * np.uint64(0x9E3779B1) + text[n - 1 : n - 1 + len(owner)] + np.uint64(n)
            fits = room >= n
            ids.append(((h[fits] ^ h[fits] >> np.uint64(17)) % np.uint64(self.gram_rows)).astype(np.int32))
            owners.append(owner[fits])
        gram, of = np.concatenate(ids), np.concatenate(owners)
        value = np.zeros(len(raw), np.uint64)
        np.add.at(value, owner, (text[: len(owner)] + np.uint64(1)) * (room.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)))
        return ((value ^ value >> np.uint64(29)) % np.uint64(self.word_rows)).astype(np.int32), gram[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(raw))


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's word rows, padded with row 0; an empty text is one window of padding."""
    count = max(1, -(-(len(rows) - STEP) // STEP))
    padded = np.zeros((count - 1) * STEP + WIDTH, np.int32)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP]


def _gates(pre: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * pre)


class Network:
    """Weights with a forward pass over projected inputs and its gradients."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        h, size = s.hidden, s.word_size + s.gram_size
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.s = s
        self.w = {
            "word": draw(s.word_rows, s.word_size, scale=0.1), "gram": draw(s.gram_rows, s.gram_size, scale=0.3),
            "x": draw(size, 6 * h, scale=0.4), "xb": np.zeros(6 * h, np.float32), "uf": draw(h, 3 * h, scale=0.3), "ub": draw(h, 3 * h, scale=0.3),
            "a": draw(2 * h, 2 * h, scale=0.3), "v": draw(2 * h, scale=0.5), "o": draw(2 * h, scale=0.5), "ob": np.zeros(1, np.float32),
        }

    def inputs(self, words: np.ndarray, grams: np.ndarray, starts: np.ndarray, block: int = 20_000) -> np.ndarray:
        """Input rows of words, a block at a time."""
        bounds = np.append(starts, len(grams))
        out = np.empty((len(words), self.s.word_size + self.s.gram_size), np.float32)
        out[:, : self.s.word_size] = self.w["word"][words]
        for lo in range(0, len(words), block):
            hi = min(lo + block, len(words))
            some = grams[bounds[lo] : bounds[hi]]
            summed = np.add.reduceat(self.w["gram"][some], starts[lo:hi] - bounds[lo], axis=0)
            out[lo:hi, self.s.word_size :] = summed / np.diff(bounds[lo : hi + 1])[:, None].astype(np.float32)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w["x"] + self.w["xb"]

    def forward(self, p: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows ``index`` (rows of the projected inputs ``p``); ``keep`` collects what gradients need."""
        h, n = self.s.hidden, len(index)
        states = np.empty((2, WIDTH, n, h), np.float32)
        for d, u in enumerate((self.w["uf"], self.w["ub"])):
            before = np.zeros((n, h), np.float32)
            for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
                x = p[index[:, t], 3 * h * d : 3 * h * (d + 1)]
                g = before @ u
                zr = _gates(x[:, : 2 * h] + g[:, : 2 * h])
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * g[:, 2 * h :])
                if keep is not None:
                    keep.append((d, t, before, g[:, 2 * h :], zr, new))
                before = new + zr[:, :h] * (before - new)
                states[d, t] = before
        both = np.concatenate([states[0], states[1]], axis=2)
        hidden = np.tanh(both @ self.w["a"])
        score = hidden @ self.w["v"]
        score[(index == 0).T] = -30.0
        score -= score.max(axis=0)
        weight = np.exp(score)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        if keep is not None:
            keep += [both, hidden, weight, pooled]
        return pooled @ self.w["o"] + self.w["ob"]

    def gradients(self, p: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean cross-entropy: by weight name, and by row of ``p``; with the logits."""
        h, keep = self.s.hidden, []
        logits = self.forward(p, index, keep)
        both, hidden, weight, pooled = keep[-4:]
        d_logit = ((_gates(logits) - y) / len(y)).astype(np.float32)
        grad = {"o": pooled.T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.w["o"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_score[(index == 0).T] = 0
        grad["v"] = np.einsum("tn,tnh->h", d_score, hidden)
        d_hidden = d_score[:, :, None] * self.w["v"] * (1 - hidden**2)
        grad["a"] = np.einsum("tnh,tnk->hk", both, d_hidden)
        d_both = d_both + d_hidden @ self.w["a"].T
        grad |= {"uf": np.zeros_like(self.w["uf"]), "ub": np.zeros_like(self.w["ub"])}
        d_p = np.zeros_like(p)
        carry = np.zeros((2, len(index), h), np.float32)
        for d, t, before, g, zr, new in reversed(keep[:-4]):
            name = ("uf", "ub")[d]
            dh = carry[d] + d_both[t, :, h * d : h * (d + 1)]
            z, r = zr[:, :h], zr[:, h:]
            d_new = dh * (1 - z) * (1 - new**2)
            d_zr = np.hstack([dh * (before - new), d_new * g]) * zr * (1 - zr)
            d_g = np.hstack([d_zr, d_new * r])
            grad[name] += before.T @ d_g
            carry[d] = dh * z + d_g @ self.w[name].T
            np.add.at(d_p[:, 3 * h * d : 3 * h * (d + 1)], index[:, t], np.hstack([d_zr, d_new]))
        return grad, d_p, logits


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def update(self, weights: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, g in grad.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * g**2
            weights[name] -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Network:
    """Fit a network to labelled texts; deterministic in its inputs. Without both classes it predicts the one there is (0 for none)."""
    net = Network(s)
    if len(labels) == 0 or labels.min() == labels.max():
        net.w["o"][:] = 0
        net.w["ob"][:] = 4.0 if len(labels) and labels[0] else -4.0
        return net
    table_ = Words(s.word_rows, s.gram_rows)
    rows, fresh = table_.rows([words_of(t) for t in texts])
    words, grams, starts = table_.features(fresh)
    counts = np.diff(np.append(starts, len(grams)))
    per_text = [windows_of(r) for r in rows]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in per_text])
    windows = np.concatenate(per_text)
    first = np.searchsorted(owner, np.arange(len(texts)))
    y = labels.astype(np.float32)
    aside = np.arange(len(texts)) % s.aside == s.aside - 1  # not fitted to, only to set the cut by
    if min(y[aside].sum(), (1 - y[aside]).sum(), y[~aside].sum(), (1 - y[~aside]).sum()) == 0:
        aside[:] = False
    # The first choice of windows: by how much more often toxic texts have a word's grams.
    have = np.zeros((2, s.gram_rows), np.float32)
    for label, r in zip(labels[~aside], [r for r, a in zip(rows, aside) if not a]):
        here = np.zeros(s.gram_rows, bool)
        for i in np.unique(r - 1):
            here[grams[starts[i] : starts[i] + counts[i]]] = True
        have[int(label)] += here
    share = (have + 0.5) / (np.bincount(labels[~aside].astype(int), minlength=2)[:, None] + 1)
    odds = np.maximum(np.log(share[1] / share[0]), 0)
    by_word = np.append(0, np.add.reduceat(odds[grams], starts) / counts)
    suspicion = by_word[windows].max(axis=1) + 0.1 * by_word[windows].mean(axis=1)
    rng, adam, squares = np.random.default_rng(s.seed + 1), Adam(s.rate), {"word": np.full(s.word_rows, 1e-6), "gram": np.full(s.gram_rows, 1e-6)}

    def projected(which: np.ndarray) -> np.ndarray:
        """Inputs of the distinct words ``which`` (row 0 is padding)."""
        return np.vstack([np.zeros((1, s.word_size + s.gram_size), np.float32), net.inputs(words, grams, starts)])[which]

    steps = max(1, (len(texts) + int((y == 0).sum())) // s.batch)
    for at in range(max(s.rounds, min(30, -(-s.least_steps // steps)))):  # few labels are read more often
        if at:
            suspicion = score_windows(net, net.project(projected(np.arange(len(starts) + 1))), windows)
        top = np.array([first[i] + suspicion[first[i] : first[i] + len(w)].argmax() for i, w in enumerate(per_text) if not aside[i]])
        other = np.array([first[i] + rng.integers(len(w)) for i, w in enumerate(per_text) if not labels[i] and not aside[i]], dtype=np.int64)
        chosen = np.concatenate([top, other])
        target = np.concatenate([y[~aside], np.zeros(len(other), np.float32)])
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // s.batch)):
            index = windows[chosen[part]]
            own, local = np.unique(index, return_inverse=True)
            if own[0]:
                own, local = np.append(0, own), local + 1
            local = local.reshape(index.shape)
            real = own[1:] - 1
            g_rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in real]) if len(real) else np.zeros(0, np.int64)
            g_starts = np.append(0, np.cumsum(counts[real]))[:-1]
            x = np.vstack([np.zeros((1, s.word_size + s.gram_size), np.float32), net.inputs(words[real], grams[g_rows], g_starts)])
            heard = (rng.random(len(x)) < s.keep_words).astype(np.float32)[:, None]  # else a word is known by its grams alone
            x[:, : s.word_size] *= heard
            grad, d_p, _ = net.gradients(net.project(x), local, target[part])
            grad["x"], grad["xb"] = x.T @ d_p, d_p.sum(axis=0)
            d_x = d_p @ net.w["x"].T
            d_x[:, : s.word_size] *= heard
            d_x = d_x[1:]
            adam.update(net.w, grad)
            for name, ids, d in (("word", words[real].astype(np.int64), d_x[:, : s.word_size]), ("gram", grams[g_rows], np.repeat(d_x[:, s.word_size :] / counts[real][:, None], counts[real], axis=0))):
                distinct, inverse = np.unique(ids, return_inverse=True)
                summed = np.zeros((len(distinct), d.shape[1]), np.float32)
                np.add.at(summed, inverse, d)
                squares[name][distinct] += (summed**2).mean(axis=1)
                net.w[name][distinct] -= (0.1 * summed / np.sqrt(squares[name][distinct])[:, None]).astype(np.float32)
    final = np.maximum.reduceat(score_windows(net, net.project(projected(np.arange(len(starts) + 1))), windows), first)
    judged = aside if aside.any() else ~aside
    net.w["ob"] -= np.float32(best_cut(final[judged], labels[judged], s.clean_weight))
    return net


def best_cut(logits: np.ndarray, labels: np.ndarray, clean_weight: float = 1.0) -> float:
    """The logit that splits the classes with the best weighted mean of both hit rates; in the middle of the gap it falls in."""
    order = np.argsort(logits)
    v, y = logits[order], labels[order]
    clean = clean_weight * np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    toxic = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    at = int((clean + toxic).argmax())
    return float(v[0] - 1 if at == 0 else v[-1] + 1 if at == len(v) else (v[at - 1] + v[at]) / 2)


def score_windows(net: Network, p: np.ndarray, windows: np.ndarray, block: int = 2048) -> np.ndarray:
    return np.concatenate([net.forward(p, windows[lo : lo + block]) for lo in range(0, len(windows), block)]) if len(windows) else np.zeros(0, np.float32)


class Scorer:
    """Scores batches of texts, with the projected inputs of distinct words kept between them (up to ``most`` words)."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most = net, most
        self._forget()

    def _forget(self) -> None:
        self.words = Words(self.net.s.word_rows, self.net.s.gram_rows)
        self.p = np.zeros((1 << 12, 6 * self.net.s.hidden), np.float32)
        self.p[0] = self.net.w["xb"]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities; texts are taken in runs of about a million characters."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1_000_000):
                size += len(texts[hi])
                hi += 1
            out.append(self._run(texts[lo:hi]))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0)

    def _run(self, texts: list[str]) -> np.ndarray:
        if len(self.words.index) > self.most:
            self._forget()
        known = len(self.words.index) + 1
        rows, fresh = self.words.rows([words_of(t) for t in texts])
        if fresh:
            while len(self.p) < known + len(fresh):
                self.p = np.vstack([self.p, np.zeros_like(self.p)])
            self.p[known : known + len(fresh)] = self.net.project(self.net.inputs(*self.words.features(fresh)))
        per_text = [windows_of(r) for r in rows]
        logits = score_windows(self.net, self.p, np.concatenate(per_text))
        firsts = np.cumsum([0] + [len(w) for w in per_text[:-1]])
        return 1 / (1 + np.exp(-np.maximum.reduceat(logits, firsts).astype(np.float64)))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """Labelled texts of both classes outside the held-out fold, bounded in number and bytes (see ``Settings``): all that the driver holds.

    A document that occurs several times is read once (its smallest text).
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda label: marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class)
    chosen = first(0).union(first(1))  # 2 * per_class ids at most
    rows = id_and_text(docs).where(F.octet_length("text") <= settings.longest).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("size", F.sum(F.octet_length("text")).over(order)).where(F.col("size") <= settings.per_class_bytes)
    rows = sorted(rows.select("doc_id", "toxic", "text").collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Labels are learnt from the documents outside fold 0 only. Scoring is map-only; every window of every text is scored, and
    neither labels nor other columns enter a score. Null and empty texts score as a window of padding. A document labelled twice
    is toxic if either label is; null labels and ids teach nothing. Repeated rows score alike. Without labels every
    score is low. Extra columns are ignored; an empty table gives no rows.
    """
    net = train(*training_rows(docs, labels, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of the settings' size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            score = scorer.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    return id_and_text(docs).withColumn("held_out", fold("doc_id") == 0).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns as they are; map-only.

    Null and empty texts score as a window of padding and so all go or all stay; repeated rows are judged alike and all kept or all
    dropped; a null doc_id is judged by its text. Without labels nothing is dropped. An empty table stays empty.
    """
    net = train(*training_rows(docs, labels, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(scorer.score(texts) < 0.5, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
