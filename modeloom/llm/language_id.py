"""Language identification by a byte convolutional network.

Bytes are embedded; filters of widths 2, 3 and 4 run over windows of 256 bytes, the greatest response of each filter
feeds a softmax over languages. The network is trained in numpy on the driver, from a bounded sample: at most `per_lang`
labelled rows (those with the least id hashes) for each label, with one stretch of each text. Every window of every text is then scored, and a text gets the language of the greatest mean log-probability.

Nulls and odd inputs: a null text, or one without a letter, is `und` with score 0, as is every text if no label was
learned; rows with a null label or text don't train; a text of any length is scored window by window; equal rows train
as one and get equal results; an empty table gives an empty result; of the input's columns only the id is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.frames import small_batches
from modeloom.llm.grams import buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
STRETCH = 1024
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray  # 256 x e
    filters: np.ndarray  # (widest * e) x all filters; rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray  # all filters x langs
    out_bias: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Windows of bytes as rows of the widest filter's inputs: windows x places x inputs."""
        wide = max(WIDTHS)
        e = self.embedding[x]
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, wide, axis=1).transpose(0, 1, 3, 2)).reshape(len(x), x.shape[1] - wide + 1, -1)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        c = self.columns(x)
        return np.maximum((c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(x), c.shape[1], -1).max(axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def mask() -> np.ndarray:
    """Which rows of the filter matrix each filter has."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 5e-3, seed: int = 0) -> Network:
    """Adam on the cross-entropy; windows of folded bytes."""
    rng, own = np.random.default_rng(seed), mask()
    n = Network(
        langs, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.3, own.shape) * own).astype(np.float32),
        np.zeros(own.shape[1], np.float32), rng.normal(0, 0.3, (own.shape[1], len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    names = ("embedding", "filters", "bias", "out", "out_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            x, y = windows[order[i : i + batch]], labels[order[i : i + batch]]
            c = n.columns(x)
            response = c @ n.filters
            at = response.argmax(axis=1)
            before = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + n.bias
            pooled = np.maximum(before, 0)
            z = pooled @ n.out + n.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = p
            dz[np.arange(len(y)), y] -= 1
            dz /= len(y)
            dpool = (dz @ n.out.T) * (before > 0)
            taken = c[np.arange(len(x))[:, None], at]  # batch x filters x inputs
            dinput = dpool[:, :, None] * n.filters.T[None] * own.T[None]
            dembedding = np.zeros_like(n.embedding)
            places = at[:, :, None] + np.arange(max(WIDTHS))
            np.add.at(dembedding, x[np.arange(len(x))[:, None, None], places].ravel(), dinput.reshape(-1, EMBEDDING))
            grads = {"embedding": dembedding, "filters": np.einsum("bf,bfi->if", dpool, taken) * own, "bias": dpool.sum(axis=0), "out": pooled.T @ dz, "out_bias": dz.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(n, k, (getattr(n, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return n


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of folded bytes that cover all texts, the last of each text filled up with spaces; and each window's text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    starts = np.concatenate([[0], np.cumsum(counts)])
    x = np.full(int(starts[-1]) * WINDOW, 32, np.uint8)
    to = np.repeat(starts[:-1] * WINDOW - offsets[:-1], sizes) + np.arange(len(data))
    folded = _FOLD[data]
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    folded[accent] += 0x20
    x[to] = folded
    return x.reshape(-1, WINDOW), np.repeat(np.arange(len(sizes)), counts)


def fit(docs: DataFrame, train_on: Column, text: str = "text", lang: str = "lang", per_lang: int = 400) -> Network:
    """A network of the different texts of each label whose hashes are least. A hash under a bound that follows from the
    label's number of texts is looked for first, so that a label costs one task a few times `per_lang` rows."""
    stretch_at = F.pmod(F.xxhash64("text", F.lit(3)), F.greatest(F.char_length("text") - STRETCH, F.lit(1)))
    own = docs.filter(train_on & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("label"), F.col(text).alias("text"))
    own = own.withColumn("h", F.xxhash64("text", F.lit(1)))
    kinds = own.groupBy("label").agg(F.approx_count_distinct("h").alias("kinds"))
    bound = F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.greatest("kinds", F.lit(1))) * (1 << 31)
    # Bounded: a row for each class of the network, which has a column for each and goes to all workers itself.
    near = own.join(F.broadcast(kinds.select(F.col("label").alias("of"), bound.alias("bound"))), F.col("label") == F.col("of")).filter(F.pmod("h", F.lit(1 << 31)) <= F.col("bound"))
    texts = near.select("label", "h", F.substring("text", (stretch_at + 1).cast("int"), F.lit(STRETCH)).alias("stretch")).groupBy("label", "h").agg(F.min("stretch").alias("stretch"))
    order = Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 31)), "h")
    rows = texts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).select("label", "stretch").collect()
    rows.sort(key=lambda r: (r["label"], r["stretch"]))
    langs = sorted({r["label"] for r in rows})
    if not langs:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    windows, of = cut_windows(*buffers(pa.array([r["stretch"] for r in rows], pa.string())))
    index = {x: k for k, x in enumerate(langs)}
    return train(windows, np.array([index[r["label"]] for r in rows])[of], langs)


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            total, count = np.zeros((batch.num_rows, max(1, len(net.langs)))), np.zeros(batch.num_rows)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 19), "right")) - 1)
                for a in range(int(offsets[low]), max(int(offsets[high]), int(offsets[low]) + 1), 1 << 20):
                    # A text longer than the step is taken in parts that are whole windows.
                    b = min(int(offsets[high]), a + (1 << 20))
                    part = offsets[low : high + 1].clip(a, b) - a
                    x, of = cut_windows(data[a:b], part)
                    for i in range(0, len(x) if net.langs else 0, 128):
                        np.add.at(total, low + of[i : i + 128], net.log_probabilities(x[i : i + 128]))
                    np.add.at(count, low + of, 1)
                low = high
            mean = total / np.maximum(count, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            known = np.asarray(batch.column("has_letter").to_numpy(zero_copy_only=False), bool) & (count > 0) & bool(net.langs)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([net.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, p[np.arange(len(p)), best], 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that aren't held out."""
    small_batches(docs.sparkSession)
    net = fit(docs, ~held_out, text, lang, per_lang)
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return own.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
