"""Language identification with a byte convolutional network in numpy.

Windows of a fixed number of bytes pass through filters of widths 2, 3 and 4 over byte
embeddings, a maximum over positions, ReLU and a softmax layer. Training is plain numpy (Adam);
a max-pooled network only sends gradients through the winning positions, which keeps it cheap.
For inference embeddings and filters are folded into look-up tables over bytes and byte pairs.
A text's scores are the mean of its windows' probabilities, weighted by the bytes they hold; all
windows of the whole text count.

Defined cases: a null text, an empty text and one without any letter are `und` with score 1;
if no row can be learned from, everything is `und` with score 0; ties go to the language first
in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, remainder, steps, texts, thinned, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Network:
    languages: list[str]
    tables: list[list[np.ndarray]]  # for each width the parts to add: (table, byte or pair, offset)
    bias: np.ndarray
    weights: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, WINDOW) bytes, zero-padded."""
        singles = windows.astype(np.intp)
        pairs = singles[:, :-1] * 256 + singles[:, 1:]
        pooled = []
        for width, parts in zip(WIDTHS, self.tables):
            places = WINDOW - width + 1
            total = None
            for part, offset in zip(parts, range(0, width, 2)):
                index = pairs if len(part) > 256 else singles
                values = part[index[:, offset : offset + places]]
                total = values if total is None else np.add(total, values, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return _softmax(hidden @ self.weights + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, filters: int = 8, embedding: int = 6, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network to windows (n, WINDOW) of bytes with labels 0..len(languages)-1."""
    rng = np.random.default_rng(seed)
    classes = len(languages)
    p = {"e": rng.normal(0, 0.5, (256, embedding)), "b": np.zeros(filters * len(WIDTHS)), "v": rng.normal(0, 0.3, (filters * len(WIDTHS), classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * embedding) ** -0.5, (w, embedding, filters))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, t = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    m, s = m
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), 64):
            rows = windows[order[a : a + 64]]
            y = labels[order[a : a + 64]]
            x = p["e"][rows]
            pooled, winners = [], []
            for w in WIDTHS:
                places = WINDOW - w + 1
                z = sum(x[:, j : j + places] @ p[f"w{w}"][j] for j in range(w))
                k = z.argmax(axis=1)
                winners.append(k)
                pooled.append(np.take_along_axis(z, k[:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + p["b"]
            hidden = np.maximum(pre, 0)
            d = _softmax(hidden @ p["v"] + p["c"])
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            g = {"v": hidden.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = (d @ p["v"].T) * (pre > 0)
            g["b"] = dh.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                part = dh[:, i * filters : (i + 1) * filters]
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    seen = np.take_along_axis(rows, winners[i] + j, 1)  # the byte each filter looked at
                    g[f"w{w}"][j] = np.einsum("nfe,nf->ef", p["e"][seen], part)
                    np.add.at(g["e"], seen.reshape(-1), (part[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, embedding))
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - (rate / (1 + 0.1 * t / 64)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
    tables = []
    for w in WIDTHS:
        single = [(p["e"] @ p[f"w{w}"][j]).astype(np.float32) for j in range(w)]
        parts = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, filters) if j + 1 < w else single[j] for j in range(0, w, 2)]
        tables.append(parts)
    return Network(languages, tables, p["b"].astype(np.float32), p["v"].astype(np.float32), p["c"].astype(np.float32))


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text each is of, and the bytes each holds."""
    lengths = np.diff(offsets)
    each = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    begin = offsets[owner] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[owner + 1] - begin)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = padded[begin[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW)[None, :] >= held[:, None]] = 0
    return windows, owner, held


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a letter of any script."""
    hits = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])[offsets]
    found = np.diff(hits) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def predict(network: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    column = texts(column)
    data, offsets = utf8(column)
    letters = has_letter(column, data, offsets)
    if network is None:
        return [UNKNOWN] * len(column), np.where(letters, 0.0, 1.0)
    sums = np.zeros((len(column), len(network.languages)))
    bytes_ = np.zeros(len(column))
    windows, owner, held = cut_windows(data, offsets)
    for a in range(0, len(windows), 512):
        o, h = owner[a : a + 512], held[a : a + 512]
        np.add.at(sums, o, network.probabilities(windows[a : a + 512]) * h[:, None])
        np.add.at(bytes_, o, h)
    mean = sums / np.maximum(bytes_, 1)[:, None]
    best = mean.argmax(axis=1)
    names = [network.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, np.minimum(mean.max(axis=1), 1.0), 1.0)


def learn(docs: DataFrame, training: Column, *, texts_each: int = 800, most_texts: int = 40_000, windows_each: int = 3) -> Network | None:
    """Train on a bounded sample: about `texts_each` texts of every language, fewer where languages are so many that
    they would be over `most_texts` together.

    The sample depends on ids and texts alone; of each text it takes `windows_each` windows at places dealt over it.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    wanted = min(texts_each, most_texts / len(languages))
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, wanted / counts[name]))))[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                windows, owner, held = cut_windows(*utf8(part.column("text")))
                number = np.bincount(owner, minlength=part.num_rows)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                take = (nth * windows_each) // number[owner] != ((nth - 1) * windows_each) // number[owner]
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(owner[take])), pa.array([w.tobytes() for w in windows[take]], pa.binary())], ["lang", "window"])

    sample = thinned(rows.select("doc_id", "lang", "text"), share, int(wanted * len(languages)) + 1, "langid")
    got = sample.select("lang", "text").mapInArrow(run, "lang string, window binary").toArrow()
    if not got.num_rows:
        return None
    index = {name: i for i, name in enumerate(languages)}
    pairs = sorted(zip(got.column("window").to_pylist(), got.column("lang").to_pylist()))  # the same order in every run
    windows = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([index[x] for _, x in pairs]), languages)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out (crc32 remainder 1 of 3), lang_pred, score."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                names, scores = predict(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None, least: float = 0.4) -> DataFrame:
    """Documents with a letter whose language scores at least `least`; all columns stay as they are."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                names, scores = predict(shared.value, part.column("text"))
                kept = [n != UNKNOWN and s >= least for n, s in zip(names, scores.tolist())]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
