"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (runs of `PASSAGE` bytes, so that every byte of a text counts).
Each passage is encoded from the frequencies of pairs of neighbouring character classes, of hashed
words and of its length; a hidden layer embeds it, gated attention (tanh times sigmoid) weighs the
passages of a document, and the weighted embedding is scored by a logistic output. Only document
labels are given; weights of passages are learned from them.

The model is fitted with numpy on a bounded sample: the `fit_docs` labelled documents of the
training folds with the least hash of their id, with all their passages. Every document is then scored
whole, in one pass without a shuffle; of a long text a task holds the features of one run of passages
and what attention needs of the others.

Defined results: null and empty texts have score 0; a text of more than `RUN` characters is encoded in
runs of that size, a word between two of them counts in both; if no labelled row can be learned from, every
score is 1 (nothing is rejected); rows with a null id are scored and count as not held out;
repeated rows get equal scores; labels that are null, neither 0 nor 1, or contradict each other for
one id are left out; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import aside, held_out
from tidemill.llm.textvec import chunks, placed_words

PASSAGE = 600
BUCKETS = 64
THRESHOLD = 0.7
#: Standardised features beyond this are taken for it.
CLIP = 8.0
#: Characters of a longer text that are taken up at once: runs have passages and words of their own.
RUN = 1_000_000

#: Classes of bytes: other, lower, upper, digit, blank, line end, sentence end, comma, quote, bracket, symbols, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c", b"\r\n", b".!?", b",;:", b"'\"`", b"()[]{}", b"#*$%&|<>", b"@=/_~^+\\"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
CLASSES = 13
FEATURES = CLASSES * CLASSES + BUCKETS + 3


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts in turn, and the number of passages of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = -(-sizes // PASSAGE)
    total = int(counts.sum())
    if not total:
        return np.zeros((0, FEATURES), np.float32), counts
    data = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    place = np.arange(len(data)) - np.repeat(begins, sizes)
    passage = np.repeat(first, sizes) + place // PASSAGE
    kinds = _CLASS[data]
    behind = np.concatenate((kinds[1:], [0]))
    behind[np.cumsum(sizes)[sizes > 0] - 1] = 0  # nothing stands behind a text
    pair = kinds * CLASSES + behind
    size = np.bincount(passage, minlength=total).astype(np.float32)
    shape = np.bincount(passage * CLASSES**2 + pair, minlength=total * CLASSES**2).reshape(total, -1) / size[:, None]
    hashes, bounds, byte = placed_words(texts)
    at = np.repeat(first, np.diff(bounds)) + byte // PASSAGE  # a word belongs to the passage that it starts in
    bucket = (hashes >> np.uint64(58)).astype(np.int64)
    words = np.bincount(at, minlength=total).astype(np.float32)
    bags = np.bincount(at * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, -1) / np.maximum(words, 1)[:, None]
    again = np.zeros(len(hashes), bool)
    if len(hashes):
        order = np.lexsort((hashes, at))
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    repeated = np.bincount(at[again], minlength=total) / np.maximum(words, 1)
    return np.column_stack((shape, bags, words / size, repeated, size / PASSAGE)).astype(np.float32), counts


def parts_of(texts: list, most: int = 0) -> tuple[list[str], np.ndarray]:
    """The texts cut into runs of `most` (RUN) characters, and the text that each run belongs to."""
    most = most or RUN
    parts = [(t[k : k + most], i) for i, t in enumerate(texts) if t for k in range(0, len(t), most)]
    return [p for p, _ in parts], np.array([i for _, i in parts], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder (W, b), of the gated attention (V, U, w) and of the output (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of standardised passages, both parts of the gate, and the attention before it is normalised."""
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, (t * g) @ p["w"]

    def pooled(self, h: np.ndarray, e: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, embeddings of the texts and their scores; texts have counts > 0 passages from starts on."""
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return a, z, _sigmoid(z @ self.weights["c"] + self.weights["d"])

    def forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All values on the way for standardised passages x."""
        h, t, g, e = self.encoded(x)
        a, z, y = self.pooled(h, e, starts, counts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def scores(self, texts: list) -> np.ndarray:
        """Scores of texts; features are held for about CHUNK_BYTES characters at once."""
        out, (parts, owner) = np.zeros(len(texts)), parts_of(texts)
        if not parts:
            return out
        found, passages_of = [], np.zeros(len(texts), np.int64)
        for a, b in chunks(parts):
            x, counts = passages(parts[a:b])
            h, _, _, e = self.encoded(self.standard(x))
            found.append((h, e))
            np.add.at(passages_of, owner[a:b], counts)
        full = passages_of > 0
        own = passages_of[full]
        starts = np.concatenate(([0], np.cumsum(own)[:-1]))
        out[full] = self.pooled(np.concatenate([h for h, _ in found]), np.concatenate([e for _, e in found]), starts, own)[2]
        return out


def gradients(model: Model, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the mean logistic loss of whole documents by all weights."""
    p, f = model.weights, model.forward(x, starts, counts)
    dy = (f["y"] - labels) / len(labels)
    dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), counts))
    dgate = de[:, None] * p["w"]
    dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": de @ (f["t"] * f["g"]), "c": f["z"].T @ dy, "d": np.array([dy.sum()])}


def drawn(features: int, hidden: int, gate: int, seed: int) -> dict[str, np.ndarray]:
    """First weights."""
    rng = np.random.default_rng(seed)
    draw = lambda n, m: rng.normal(0, n**-0.5, (n, m))
    return {"W": draw(features, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, hidden: int = 12, gate: int = 6, rounds: int = 250, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Model:
    """Adam on the logistic loss of whole documents."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Model(mean, scale, drawn(x.shape[1], hidden, gate, seed))
    x = model.standard(x)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        for k, g in gradients(model, x, starts, counts, labels).items():
            g = g + decay * model.weights[k] * (k not in "bd")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = 3000) -> Model | None:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_other"))
        .filter("label = _other").orderBy(F.xxhash64("id"), "id").limit(fit_docs).select("id", "label")
    )
    schema = "id string, label int, x binary, n int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                x = np.concatenate([np.zeros((0, FEATURES), np.float32), *[passages([part])[0] for part in parts_of([text])[0]]])
                if len(x):
                    yield pd.DataFrame({"id": [batch["id"].iloc[i]], "label": [batch["label"].iloc[i]], "x": [x.tobytes()], "n": [len(x)]})

    # at most fit_docs ids: a bounded broadcast, and a bounded result; of rows with one id the least text is taken
    found = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        .groupBy(F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label")).agg(F.min("text").alias("text"))
        .select("id", "text", "label").mapInPandas(run, schema).toPandas().sort_values(["id", "n", "label"])
    )
    if found.empty:
        return None
    x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in found["x"]]).astype(np.float64)
    return fit(x, found["n"].to_numpy(), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the score of every text."""

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        return pd.Series(np.concatenate([np.zeros(0), *[model.scores(texts[a:b]) for a, b in chunks(texts)]]))

    return docs.select(*aside(docs, (out_col,)), (F.lit(1.0) if model is None else of(F.col(text_col))).alias(out_col))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`."""
    return score(docs, train(docs, labels, id_col, text_col), text_col, "_tm_score").filter(F.col("_tm_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
