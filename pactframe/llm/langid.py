"""Language identification by a byte convolutional network trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning, small_batches, worker_cache

#: Bytes of a window, in training and in prediction.
WINDOW = 256
#: Bound of the training sample: languages (the most frequent ones), documents
#: of each, windows of a document.
MOST_LANGS, DOCS_PER_LANG, WINDOWS_PER_DOC = 200, 600, 6
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
UNKNOWN = "und"
#: How far from chance (one of all languages) to certainty a text's windows have to be on average for the filtering stage.
CERTAIN = 0.2


def held_out(doc_id: Column) -> Column:
    """The test fold: no document of it is ever learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Network:
    """Byte embeddings, one filter bank per width, and a softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # width x embed x filters
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Per width, what a byte at each place of a filter adds to its response."""
        return [np.einsum("be,kef->kbf", self.embed, f).astype(np.float32) for f in self.filters]


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut concatenated texts into zero-padded windows: windows, their text, their bytes."""
    lengths = np.diff(offsets)
    per = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][owner] + nth * width
    size = np.minimum(width, offsets[1:][owner] - start)
    return start, owner, size


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int = WINDOW) -> np.ndarray:
    place = np.arange(width)
    at = np.minimum(start[:, None] + place, max(len(data) - 1, 0))
    return np.where(place < size[:, None], data[at], 0).astype(np.uint8)


def responses(x: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    return [sum(t[k][x[:, k:x.shape[1] - len(t) + 1 + k]] for k in range(len(t))) for t in tables]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 2, batch: int = 64, seed: int = 7) -> Network:
    """Fit the network with Adam; a third of the windows is cut short so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    params = [scale(256, EMBED), *[scale(w, EMBED, FILTERS) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
              scale(FILTERS * len(WIDTHS), len(langs)), np.zeros(len(langs), np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            xb, yb = x[rows].copy(), y[rows]
            short = rng.random(len(rows)) < 0.33
            keep = np.where(short, rng.integers(12, WINDOW, len(rows)), WINDOW)
            xb[np.arange(WINDOW) >= keep[:, None]] = 0
            net = Network(langs, params[0], params[1:1 + len(WIDTHS)], *params[-3:])
            res = responses(xb, net.tables())
            peak = [r.argmax(1) for r in res]
            top = np.concatenate([np.take_along_axis(r, p[:, None], 1)[:, 0] for r, p in zip(res, peak)], 1) + net.bias
            hidden = np.maximum(top, 0)
            p = softmax(hidden @ net.dense + net.out)
            p[np.arange(len(rows)), yb] -= 1
            p /= len(rows)
            g_hidden = (p @ net.dense.T) * (top > 0)
            g_embed, g_filters = np.zeros_like(net.embed), []
            for i, w in enumerate(WIDTHS):
                g = g_hidden[:, i * FILTERS:(i + 1) * FILTERS]
                place = peak[i][:, :, None] + np.arange(w)
                seen = xb[np.arange(len(rows))[:, None, None], place]  # batch x filters x width
                g_filters.append(np.einsum("bf,bfke->kef", g, net.embed[seen]))
                np.add.at(g_embed, seen, np.einsum("bf,kef->bfke", g, net.filters[i]))
            grads = [g_embed, *g_filters, g_hidden.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.01 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Network(langs, params[0], params[1:1 + len(WIDTHS)], *params[-3:])


def predict_windows(net: Network, data: np.ndarray, start: np.ndarray, size: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Probabilities of every window.

    Two neighbouring bytes of a filter are one look-up in a table of byte pairs.
    Responses are 16-bit integers with one scale per width; positions come first
    in memory, so that pooling is a maximum of long rows.
    """
    banks = []
    for t in net.tables():
        scale = 30000 / max(np.abs(t).max((1, 2)).sum(), 1e-6)
        pairs = [(k, np.rint((t[k][:, None] + t[k + 1][None]) * scale).astype(np.int16).reshape(65536, -1)) for k in range(0, len(t) - 1, 2)]
        if len(t) % 2:
            pairs.append((len(t) - 1, np.rint(t[-1] * scale).astype(np.int16)))
        banks.append((WINDOW - len(t) + 1, scale, pairs))
    out = np.empty((len(start), len(net.langs)), np.float32)
    for at in range(0, len(start), chunk):
        x = np.ascontiguousarray(cut(data, start[at:at + chunk], size[at:at + chunk]).T).astype(np.intp)
        two = (x[:-1] << 8) | x[1:]
        top = []
        for n, scale, pairs in banks:
            total = None
            for k, tab in pairs:
                part = tab.take((x if len(tab) == 256 else two)[k:k + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            top.append(total.max(0) / np.float32(scale))
        out[at:at + chunk] = softmax(np.maximum(np.concatenate(top, 1) + net.bias, 0) @ net.dense + net.out)
    return out


def training_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, per_doc: int = WINDOWS_PER_DOC) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a bounded sample of the training folds.

    Per language the ``docs_per_lang`` documents with the smallest id hashes, and
    of each ``per_doc`` windows at even distances: at most
    ``MOST_LANGS * docs_per_lang * per_doc`` windows come to the driver.
    """
    # A first cut by hash leaves about three times the documents wanted, so the
    # ranking of a language never sees more, however many it has.
    labelled = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGS)
    rates = sizes.select("lang", F.least(F.lit(1.0), F.lit(3.0 * docs_per_lang) / F.col("docs")).alias("rate"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    step = F.length("text") / F.lit(float(per_doc))
    parts = F.array(*[F.substring("text", (F.lit(1) + F.floor(step * i)).cast("int"), F.lit(WINDOW)) for i in range(per_doc)])
    picked = (labelled.join(F.broadcast(rates), "lang").filter((place < F.col("rate")) & F.col("text").rlike(r"\p{L}"))
              .select("lang", place.alias("place"), "doc_id", parts.alias("parts")))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "parts")
    rows = picked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_per_lang).orderBy("lang", "n").select("lang", "parts").collect()
    langs = sorted({r.lang for r in rows})
    texts = [(r.lang, p.encode()[:WINDOW]) for r in rows for p in dict.fromkeys(r.parts) if p.strip()]
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for row, (_, raw) in zip(x, texts):
        row[:len(raw)] = np.frombuffer(raw, np.uint8)
    return x, np.array([langs.index(lang) for lang, _ in texts], np.int64), langs


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, epochs: int = 2) -> Network | None:
    """Learn from ``text`` and non-null ``lang`` of the training folds; None where there is nothing to learn from."""
    x, y, langs = training_sample(docs, docs_per_lang)
    return train(x, y, langs, epochs) if langs else None


def least_confidence(net: Network | None) -> float:
    """Below this confidence a text is in no language the network knows; it falls with the number of languages."""
    return CERTAIN if net is None else 1 / len(net.langs) + (1 - 1 / len(net.langs)) * CERTAIN


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, held_out, text_hash, lang_pred, score, confidence`` for every whole text.

    A text is all its windows; the score of a language is the mean of its window
    probabilities weighted by their bytes, and the best one is predicted.
    ``confidence`` is the mean of each window's own best probability, so a text in
    several languages is as sure as one in a single one. Null texts, texts
    without a letter, and everything under no network are ``und`` with score 0;
    confidence is 0 without a letter, and 1 with one where there is no network:
    nothing speaks against the text. Rows that repeat are predicted alike;
    ``lang`` and other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"),
                        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return given.select("doc_id", "held_out", "text_hash", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                            F.col("letters").cast("double").alias("confidence"))
    schema = T.StructType([given.schema["doc_id"], given.schema["held_out"], given.schema["text_hash"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType())])
    names = np.array([*net.langs, UNKNOWN], object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid", lambda: None)  # lets go of what an earlier operator cached
        for batch in batches:
            text = batch.column(3).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            raw = text.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
            start, owner, size = windows_of(data, offsets)
            total, sure = np.zeros((len(text), len(net.langs))), np.zeros(len(text))
            for at in range(0, len(start), 1 << 14):
                part = slice(at, at + (1 << 14))
                found = predict_windows(net, data, start[part], size[part]) * size[part, None]
                np.add.at(total, owner[part], found)
                np.add.at(sure, owner[part], found.max(1))
            share, sure = total / np.maximum(np.diff(offsets), 1)[:, None], sure / np.maximum(np.diff(offsets), 1)
            letters = np.array(batch.column(4).to_pylist(), bool)
            best = np.where(letters, share.argmax(1), len(net.langs))
            score, sure = np.where(letters, share.max(1), 0.0), np.where(letters, sure, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.clip(sure, 0, 1))], schema.names)

    return given.mapInArrow(returning(apply), schema)
