"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a window, hidden units each way, and the id that fills up a last window.
WINDOW, HIDDEN, FILL = 64, 8, 256
#: Windows that go through the network together.
BATCH = 2048
#: Bounds of the training sample: rows of each language and windows of each row.
ROWS, WINDOWS = 600, 4
#: Training steps, windows of a step, first learning rate, and seed of weights and batches.
STEPS, STEP_WINDOWS, RATE, SEED = 400, 192, 0.03, 7
UNKNOWN = "und"
#: A document whose best language is less probable is rejected by the filter.
LEAST_SCORE = 0.35


@dataclass
class Model:
    """Languages and weights. ``embed`` maps a byte to its gate inputs (update, reset, candidate), so no input matrix is left to multiply."""

    languages: list[str]
    embed: list[np.ndarray]
    recur: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.embed, *self.recur, *self.out, self.bias]


def fresh(languages: list[str], hidden: int, rng: np.random.Generator) -> Model:
    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(languages, [draw(257, 3 * hidden, scale=0.3) for _ in "fb"], [draw(hidden, 3 * hidden, scale=hidden ** -0.5) for _ in "fb"],
                 [draw(hidden, len(languages), scale=0.3) for _ in "fb"], np.zeros(len(languages), np.float32))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def run(embed: np.ndarray, recur: np.ndarray, steps: np.ndarray, kept: list) -> Iterator[np.ndarray]:
    """States of one direction for training; ``steps`` holds one row of byte ids for each time step, ``kept`` collects what its gradients need."""
    n = recur.shape[0]
    state = np.zeros((steps.shape[1], n), np.float32)
    for ids in steps:
        given = embed[ids]
        gates = _sigmoid(given[:, :2 * n] + state @ recur[:, :2 * n])
        update, reset = gates[:, :n], gates[:, n:]
        candidate = np.tanh(given[:, 2 * n:] + (reset * state) @ recur[:, 2 * n:])
        kept.append((state, update, reset, candidate))
        state = candidate + update * (state - candidate)
        yield state


def label_logits(embed: np.ndarray, recur: np.ndarray, out: np.ndarray, steps: np.ndarray, logits: np.ndarray) -> None:
    """Adds one direction's part to ``logits`` (time, languages, windows).

    The same recurrence as ``run``, laid out for speed: units are rows, so that
    gates are contiguous, and nothing is allocated in the loop. Gate weights are
    negated once, since a logistic needs the exponential of the negative.
    """
    n = recur.shape[0]
    sign = np.repeat(np.float32([-1, -1, 1]), n)
    table, square = np.ascontiguousarray((embed * sign).T), np.ascontiguousarray((recur * sign).T)
    read = np.ascontiguousarray(out.T)
    state, mixed = np.zeros((n, steps.shape[1]), np.float32), np.empty((n, steps.shape[1]), np.float32)
    inputs, pull = np.empty((3 * n, steps.shape[1]), np.float32), np.empty((2 * n, steps.shape[1]), np.float32)
    gates, candidate = inputs[:2 * n], inputs[2 * n:]
    for t, ids in enumerate(steps):
        np.take(table, ids, axis=1, out=inputs, mode="clip")
        gates += np.matmul(square[:2 * n], state, out=pull)
        np.exp(np.minimum(gates, 60, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        candidate += square[2 * n:] @ np.multiply(gates[n:], state, out=mixed)
        np.tanh(candidate, out=candidate)
        state -= candidate
        state *= gates[:n]
        state += candidate
        logits[t] += read @ state


def position_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Probability of each language at every byte of every window: (bytes, languages, windows)."""
    steps = np.ascontiguousarray(windows.T, dtype=np.int64)
    logits = np.empty((len(steps), len(model.languages), steps.shape[1]), np.float32)
    logits[...] = model.bias[None, :, None]
    label_logits(model.embed[0], model.recur[0], model.out[0], steps, logits)
    label_logits(model.embed[1], model.recur[1], model.out[1], steps[::-1], logits[::-1])
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(model: Model, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions that hold a byte, and its gradients by backpropagation through time."""
    steps, n = windows.T, model.recur[0].shape[0]
    kept, states = ([], []), ([], [])
    for way, order in enumerate((steps, steps[::-1])):
        states[way].extend(run(model.embed[way], model.recur[way], order, kept[way]))
    forward, backward = np.stack(states[0]), np.stack(states[1])[::-1]
    logits = forward @ model.out[0] + backward @ model.out[1] + model.bias
    logits -= logits.max(axis=2, keepdims=True)
    probs = np.exp(logits)
    probs /= probs.sum(axis=2, keepdims=True)
    real = (steps != FILL)[:, :, None].astype(np.float32)
    count = max(real.sum(), 1.0)
    truth = np.zeros_like(probs)
    truth[:, np.arange(len(labels)), labels] = 1
    loss = float(-(np.log((probs * truth).sum(axis=2, keepdims=True) + 1e-12) * real).sum() / count)
    error = (probs - truth) * real / count
    flat = error.reshape(-1, error.shape[2])
    d_out = [forward.reshape(-1, n).T @ flat, backward.reshape(-1, n).T @ flat]
    d_embed, d_recur = [], []
    for way in (0, 1):
        recur = model.recur[way]
        inflow = error @ model.out[way].T
        order, ids = (inflow, steps) if way == 0 else (inflow[::-1], steps[::-1])
        given, dr = np.empty((*steps.shape, 3 * n), np.float32), np.zeros_like(recur)
        carried = np.zeros((steps.shape[1], n), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            before, update, reset, candidate = kept[way][t]
            d = order[t] + carried
            d_cand = d * (1 - update) * (1 - candidate ** 2)
            d_update = d * (before - candidate) * update * (1 - update)
            d_gated = d_cand @ recur[:, 2 * n:].T
            d_reset = d_gated * before * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], axis=1)
            carried = d * update + d_gated * reset + d_gates @ recur[:, :2 * n].T
            dr[:, :2 * n] += before.T @ d_gates
            dr[:, 2 * n:] += (reset * before).T @ d_cand
            given[t, :, :2 * n], given[t, :, 2 * n:] = d_gates, d_cand
        order = np.argsort(ids, axis=None, kind="stable")
        values, starts = np.unique(ids.reshape(-1)[order], return_index=True)
        de = np.zeros_like(model.embed[way])
        de[values] = np.add.reduceat(given.reshape(-1, 3 * n)[order], starts, axis=0)
        d_embed.append(de)
        d_recur.append(dr)
    return loss, [*d_embed, *d_recur, *d_out, flat.sum(axis=0)]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, hidden: int = HIDDEN) -> Model:
    """Adam on batches that draw every language alike."""
    rng = np.random.default_rng(SEED)
    model = fresh(languages, hidden, rng)
    weights = model.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    places = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        each = max(1, STEP_WINDOWS // len(languages))
        chosen = np.concatenate([rng.choice(p, each) for p in places])
        _, grads = gradients(model, windows[chosen], labels[chosen])
        norm = float(np.sqrt(sum((g ** 2).sum() for g in grads)))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (steps + 1))) / max(1.0, norm)
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * max(1.0, norm) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def cut(raw: np.ndarray) -> np.ndarray:
    """All windows of a text's bytes, the last one filled up."""
    out = np.full((-(-len(raw) // WINDOW), WINDOW), FILL, np.int16)
    out.reshape(-1)[:len(raw)] = raw
    return out


def classify(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its probability, pooled over every position of each whole text."""
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held, owners, waiting = [], [], 0

    def flush():
        nonlocal waiting
        if waiting:
            windows, owner = np.concatenate(held), np.concatenate(owners)
            real = windows != FILL
            pooled = np.einsum("tlw,wt->wl", position_probabilities(model, windows), real.astype(np.float32))
            np.add.at(sums, owner, pooled)
            np.add.at(sizes, owner, real.sum(axis=1))
            held.clear()
            owners.clear()
            waiting = 0

    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        for start in range(0, len(raw), WINDOW * BATCH):
            windows = cut(raw[start:start + WINDOW * BATCH])
            if waiting + len(windows) > BATCH:
                flush()
            held.append(windows)
            owners.append(np.full(len(windows), i))
            waiting += len(windows)
    flush()
    means = sums / np.maximum(sizes, 1)[:, None]
    return means.argmax(axis=1), np.clip(means.max(axis=1), 0.0, 1.0)


def is_held_out(id_col: str) -> Column:
    """True for a fifth of the ids (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows from a bounded sample of labelled rows that are not held out.

    Every language gives about ``ROWS`` rows, chosen by a hash of the id, and each row up to
    ``WINDOWS`` windows spread over its whole text; at most ``2 * ROWS`` rows a language leave the cluster.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fit = rows.filter(~is_held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in fit.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), []
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(ROWS / counts[k]))])
    raw = F.col("text").cast("binary")
    span = F.greatest(F.octet_length(raw) - WINDOW, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.floor((span * k + F.pmod(F.hash("id"), F.greatest(span, F.lit(1)))) / WINDOWS).cast("int"))
    chosen = (fit.filter(place < F.element_at(share, F.col("lang")))
              .select("lang", place.alias("_place"), F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(WINDOW))).alias("parts"))
              .orderBy("_place").limit(2 * ROWS * len(languages)).collect())
    windows, labels = [], []
    for row in chosen:
        for part in row["parts"]:
            windows.append(cut(np.frombuffer(bytes(part), np.uint8)))
            labels.append(languages.index(row["lang"]))
    # A language that is so rare that its rows missed the sample cannot be learned.
    seen = sorted(set(labels))
    where = {k: i for i, k in enumerate(seen)}
    return np.concatenate(windows), np.array([where[k] for k in labels]), [languages[k] for k in seen]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, and the columns named in ``keep``.

    The network is trained on the driver on the bounded sample of
    ``training_windows``; the whole text of every document is then labelled byte
    by byte, in windows that see both sides, and its probabilities are averaged.
    A null text or one without a letter is ``und`` with score 0; so is every text
    where there is no language to learn.
    """
    windows, labels, languages = training_windows(docs, id_col, text_col, lang_col)
    model = train(windows, labels, languages) if languages else None

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for start in range(0, len(texts), 256):
            part = [t or b"" for t in texts.iloc[start:start + 256]]
            best, score = classify(model, part)
            names += [model.languages[k] for k in best]
            scores += score.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    known = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if model is None:
        found = rows.withColumn("_p", F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    else:
        found = rows.withColumn("_p", predict(F.when(known, F.col("_text").cast("binary"))))
        found = found.withColumn("_known", known)
        found = found.withColumn("_p", F.struct(F.when(F.col("_known"), F.col("_p.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                                                F.when(F.col("_known"), F.col("_p.score")).otherwise(0.0).alias("score")))
    return found.select(F.col("_id").alias("doc_id") if "doc_id" not in keep else F.col("_id"), is_held_out("_id").alias("held_out"), "_p.lang_pred", "_p.score",
                        *[F.col(f"`{c}`") for c in keep])
