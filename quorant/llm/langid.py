"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes (whole texts, no prefix). Two gated
recurrent layers read a segment forwards and backwards; at every byte their
states give the probabilities of the languages; a document's probabilities are
the mean over all its bytes. Trained in numpy by backpropagation through time
with Adam, on the driver, from a bounded sample: PER_LANG documents of each
language at least hash first, WINDOWS random windows of each. Documents whose
crc32(doc_id) mod 5 is 0 are never learned from.

Prediction is map-only. A null text or one without a letter is `und` with score
0, as is everything if nothing could be learned. Repeated rows each get a row.
An empty table gives no rows. Very long texts are read whole, segment by segment.
`accepted` keeps the columns of its input whatever
their names; other columns play no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise

SEGMENT = 96
HIDDEN = 8
#: Bound of the training sample: documents of each language, windows of each document.
PER_LANG, WINDOWS = 240, 6
STEPS, BATCH, RATE, SEED = 240, 256, 0.02, 7
#: Classes of ids from which the sample is drawn.
CLASSES = 16
#: Documents below this score are rejected by `accepted`.
LEAST_SCORE = 0.4
#: Segments that one forward pass reads together.
TOGETHER = 2048


class Model:
    """Weights: for direction d, E[d] (256 x 3H: update, reset, new), U[d] (H x 3H); V (2H x L), b."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.w = {"E": 0.3 * normal(2, 256, 3 * hidden), "U": normal(2, hidden, 3 * hidden) / np.sqrt(hidden), "V": 0.3 * normal(2 * hidden, len(langs)), "b": np.zeros(len(langs), np.float32)}

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, B, 2H) of bytes x (T, B); with keep, what backpropagation needs."""
        steps, batch, h = *x.shape, self.h
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])
        table, u = self.w["E"] * half, self.w["U"] * half  # the gates' sigmoid is 0.5 + 0.5 tanh(x / 2)
        out, kept = np.empty((steps, batch, 2 * h), np.float32), []
        for d in range(2):
            s = np.zeros((batch, h), np.float32)
            a, g = np.empty((batch, 3 * h), np.float32), np.empty((batch, 3 * h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table[d], x[t], axis=0, out=g, mode="clip")
                np.matmul(s, u[d], out=a)
                gates = g[:, : 2 * h]
                gates += a[:, : 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new = g[:, 2 * h :]
                new += gates[:, h:] * a[:, 2 * h :]
                np.tanh(new, out=new)
                before = s
                s = new + gates[:, :h] * (s - new)
                out[t, :, d * h : d * h + h] = s
                if keep:
                    kept.append((d, t, before, gates[:, :h].copy(), gates[:, h:].copy(), new.copy(), a[:, 2 * h :].copy()))
        return out, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.w["V"] + self.w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy at the positions under mask, and its gradients, by backpropagation through time."""
        states, kept = self.states(x, keep=True)
        p = self.probabilities(states)
        h, n = self.h, mask.sum()
        loss = -(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * mask).sum() / n
        d_logits = p
        d_logits[:, np.arange(len(y)), y] -= 1
        d_logits *= (mask / n)[:, :, None]
        flat = d_logits.reshape(-1, d_logits.shape[-1])
        grad = {"V": states.reshape(-1, 2 * h).T @ flat, "b": flat.sum(axis=0), "E": np.zeros_like(self.w["E"]), "U": np.zeros_like(self.w["U"])}
        d_states = d_logits @ self.w["V"].T
        carry = [np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)]
        into: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for d, t, before, z, r, new, un in reversed(kept):
            ds = d_states[t, :, d * h : d * h + h] + carry[d]
            d_new = ds * (1 - z) * (1 - new * new)
            d_r = d_new * un * r * (1 - r)
            d_z = ds * (before - new) * z * (1 - z)
            d_in = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            carry[d] = ds * z + d_u @ self.w["U"][d].T
            grad["U"][d] += before.T @ d_u
            into[d].append((x[t], d_in))
        for d in range(2):
            at = np.concatenate([b for b, _ in into[d]])
            order = np.argsort(at, kind="stable")
            seen, begin = np.unique(at[order], return_index=True)
            grad["E"][d][seen] = np.add.reduceat(np.concatenate([g for _, g in into[d]])[order], begin, axis=0)
        return float(loss), grad

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = STEPS) -> float:
        rng, loss = np.random.default_rng(SEED), 0.0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(own, -(-BATCH // len(by_lang))) for own in by_lang])
            loss, grad = self.gradients(x[:, pick], mask[:, pick], y[pick])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g *= min(1, 1 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        data = [t.encode() if t is not None and any(map(str.isalpha, t)) else b"" for t in texts]
        sizes = np.array([len(b) for b in data], np.int64)
        rows = -(-sizes // SEGMENT)
        begin = np.concatenate([[0], np.cumsum(rows)])
        flat = np.zeros((begin[-1], SEGMENT), np.uint8)
        line = flat.reshape(-1)
        for b, at in zip(data, begin.tolist()):  # noqa: B905
            line[at * SEGMENT : at * SEGMENT + len(b)] = np.frombuffer(b, np.uint8)
        last = np.full(begin[-1], SEGMENT, np.int64)
        ends = begin[1:][rows > 0] - 1
        last[ends] = (sizes - (rows - 1) * SEGMENT)[rows > 0]
        total = np.zeros((begin[-1], len(self.langs)), np.float64)
        for i in range(0, len(flat), TOGETHER):
            x = np.ascontiguousarray(flat[i : i + TOGETHER].T)
            p = self.probabilities(self.states(x)[0])
            total[i : i + TOGETHER] = np.einsum("tbl,tb->bl", p, (np.arange(SEGMENT)[:, None] < last[i : i + TOGETHER]).astype(np.float32))
        langs, scores = [], []
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(total, axis=0)])
        for a, b, n in zip(begin.tolist(), begin[1:].tolist(), sizes.tolist()):  # noqa: B905
            if n:
                mean = (sums[b] - sums[a]) / n
                langs.append(self.langs[int(mean.argmax())])
                scores.append(float(min(1.0, max(0.0, mean.max()))))
            else:
                langs.append("und")
                scores.append(0.0)
        return langs, scores


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS) -> list[tuple[str, list[str]]]:
    """(lang, windows of text) of the documents of each language that hash first: bounded by languages x per_lang x windows, however often a doc_id repeats."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # First in classes of ids, so that neither a frequent language nor a frequent id goes to one task; then among what these leave.
    within = lambda *keys: F.row_number().over(W.partitionBy("lang", *keys).orderBy("h", "doc_id"))
    some = known.withColumn("nth", within(F.pmod("h", F.lit(CLASSES)))).filter(F.col("nth") <= per_lang).select("doc_id", "lang", "h").distinct()
    chosen = materialise(some.withColumn("nth", within()).filter(F.col("nth") <= per_lang).select("doc_id", "lang"), "langid-sample")
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring("text", (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - SEGMENT + 1, F.lit(1))) + 1).cast("int"), SEGMENT))
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").join(chosen, ["doc_id", "lang"], "left_semi").select("lang", F.col("doc_id").cast("long"), cut.alias("windows"))
    # One row of each (language, doc_id), aggregated map-side, so what is collected keeps to the bound.
    return [(r[0], r[2]) for r in sorted(rows.groupBy("lang", "doc_id").agg(F.min("windows")).collect())]


def train(docs: DataFrame) -> Model | None:
    rows = sample(docs)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    # A short text's windows are all the same: one is enough.
    texts = [(lang, w.encode()[:SEGMENT]) for lang, ws in rows for w in dict.fromkeys(ws) if w.strip()]
    if not texts:
        return None
    langs = sorted({lang for lang, _ in texts})
    x = np.zeros((len(texts), SEGMENT), np.uint8)
    for row, (_, b) in zip(x, texts, strict=True):
        row[: len(b)] = np.frombuffer(b, np.uint8)
    mask = (np.arange(SEGMENT)[:, None] < np.array([len(b) for _, b in texts])).astype(np.float32)
    model = Model(langs)
    model.fit(np.ascontiguousarray(x.T), mask, np.array([langs.index(lang) for lang, _ in texts]))
    return model


def _predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    langs, scores = [], []
    at = 0
    while at < len(texts):  # bounded bytes at a time
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size < 4 << 20):
            size, upto = size + len(texts[upto] or ""), upto + 1
        part = model.predict(texts[at:upto])
        langs += part[0]
        scores += part[1]
        at = upto
    return langs, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predicted(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose text has a language, with score `least_score` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predicted(model, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and s >= least_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
