"""Quality of whole documents by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention
learns from the labels of documents alone how much each passage counts, and the
weighted mean of the encodings is scored. All of it is trained here, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import Adam, blocks, bytes_of, windows

PASSAGE = 512
#: Bounds of the labelled sample: documents of each label, and passages of one of them that training sees.
PER_LABEL = 2048
TRAINED_PASSAGES = 48
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 40, 64, 3e-3
BLOCK_BYTES = 1 << 21
#: Rows of a batch that are Python objects at a time.
ROWS = 512
SEED = 5

Model = dict[str, np.ndarray]


def byte_classes() -> np.ndarray:
    """The class of each byte: padding, letters of either case, digits, spaces, breaks, marks, others."""
    kind = np.full(256, 11, np.uint8)  # control bytes
    kind[0] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for k, chars in enumerate((b" ", b"\n\r", b".,;:'\"", b"!?", b"|/\\", b"%$&*#@", b"()[]{}<>-_+=~^`"), 4):
        kind[list(chars)] = k
    kind[128:] = 12
    return kind


KINDS = 13
CLASSES = byte_classes()
FEATURES = KINDS * KINDS + 4


def passage_features(rows: np.ndarray, used: np.ndarray) -> np.ndarray:
    """One line of numbers for each passage: shares of neighbouring byte classes, variety, words, length."""
    n, size = rows.shape
    kinds = CLASSES[rows]
    pairs = kinds[:, :-1].astype(np.int64) * KINDS + kinds[:, 1:] + (np.arange(n) * KINDS * KINDS)[:, None]
    counted = np.bincount(pairs.ravel(), minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    counted[:, 0] = 0  # padding
    length = np.maximum(used, 1).astype(np.float32)[:, None]
    wide = rows.astype(np.uint32)
    grams = np.sort(wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24, axis=1)
    fresh = (grams[:, 1:] != grams[:, :-1]).sum(axis=1).astype(np.float32)
    breaks = (kinds == 4).sum(axis=1) + (kinds == 5).sum(axis=1)
    rest = [fresh / length[:, 0], length[:, 0] / (breaks + 1) / 16, np.log1p(used) / 7, (kinds == 5).sum(axis=1) * 16 / length[:, 0]]
    return np.concatenate([np.sqrt(counted / length), np.stack(rest, axis=1)], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(mean: np.ndarray, spread: np.ndarray, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    make = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    model = {
        "encode": make(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "tanh": make(HIDDEN, GATE), "gate": make(HIDDEN, GATE),
        "attend": make(GATE, 1)[:, 0], "score": make(HIDDEN, 1)[:, 0], "bias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in (model | {"mean": mean, "spread": spread}).items()}


def forward(model: Model, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags of passages ``x`` that begin at ``first``, with all steps on the way."""
    sizes = np.diff(np.append(first, len(x)))
    bag = np.repeat(np.arange(len(first)), sizes)
    h = np.maximum(x @ model["encode"] + model["encode_bias"], 0)
    t, g = np.tanh(h @ model["tanh"]), _sigmoid(h @ model["gate"])
    raw = (t * g) @ model["attend"]
    e = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ model["score"] + model["bias"]}


def gradients(model: Model, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    s = forward(model, x, first)
    d = ((_sigmoid(s["logit"]) - label) / len(label)).astype(np.float32)
    dz = d[:, None] * model["score"]
    dh = s["a"][:, None] * dz[s["bag"]]
    da = (s["h"] * dz[s["bag"]]).sum(axis=1)
    draw = s["a"] * (da - np.add.reduceat(s["a"] * da, first)[s["bag"]])
    dgated = draw[:, None] * model["attend"]
    dt, dg = dgated * s["g"] * (1 - s["t"] ** 2), dgated * s["t"] * s["g"] * (1 - s["g"])
    dh += dt @ model["tanh"].T + dg @ model["gate"].T
    dh *= s["h"] > 0
    return {
        "score": s["z"].T @ d, "bias": d.sum(keepdims=True), "attend": (s["t"] * s["g"]).T @ draw,
        "tanh": s["h"].T @ dt, "gate": s["h"].T @ dg, "encode": x.T @ dh, "encode_bias": dh.sum(axis=0),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, odds: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of bags of passage features; ``odds`` are those of label 1 among all labelled documents."""
    every = np.concatenate(bags)
    model = new_model(every.mean(axis=0), every.std(axis=0) + 1e-2, seed)
    every -= model["mean"]
    every /= model["spread"]
    bags = np.split(every, np.cumsum([len(b) for b in bags[:-1]]))
    rng = np.random.default_rng(seed)
    adam = Adam({k: v for k, v in model.items() if k not in ("mean", "spread")}, RATE)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for k in range(0, len(bags), BATCH):
            pick = order[k : k + BATCH]
            some = [bags[i] for i in pick]
            first = np.cumsum([0] + [len(b) for b in some[:-1]])
            adam.step({k: g + 1e-4 * adam.weights[k] for k, g in gradients(model, np.concatenate(some), first, labels[pick]).items()})
    sampled = (labels.sum() + 1) / ((1 - labels).sum() + 1)
    model["bias"] = (model["bias"] + np.log(odds / sampled)).astype(np.float32)  # the sample was even, the corpus is not
    return model


def _bagging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in bytes_of(batch, "_text"):
            rows, _, used = windows([text], PASSAGE)
            pick = np.unique(np.linspace(0, len(rows) - 1, TRAINED_PASSAGES).astype(int))
            made.append(passage_features(rows[pick], used[pick]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(made, pa.binary())], ["label", "features"])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    per_label: int = PER_LABEL, epochs: int = EPOCHS,
) -> Model | None:
    """A model from a bounded sample of the labelled documents, as many of each label; None without both labels.

    ``labels`` has ``doc_id`` and 0 or 1; other values take no part. The sample
    is chosen by hash. At most ``2 * per_label`` labels and their passages, up
    to ``TRAINED_PASSAGES`` of each spread over the text, reach the driver.
    """
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL")
    counts = {r["_label"]: r["_n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("_label") == 1, F.lit(min(1.0, 1.2 * per_label / counts[1]))).otherwise(min(1.0, 1.2 * per_label / counts[0]))
    draw = F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1 << 40))
    drawn = sorted(rows.where(draw < share * float(1 << 40)).select(draw, "_id", "_label").collect())
    some = [(r[1], r[2]) for k in (0, 1) for r in [r for r in drawn if r[2] == k][:per_label]]
    if not some:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame(some, f"_id {labels.schema[doc_id].dataType.simpleString()}, _label int")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_label rows
    found = texts.select("_id", "_label", "_text").mapInArrow(_bagging, "label int, features binary").collect()
    bags = sorted((r["label"], bytes(r["features"])) for r in found)
    del found
    got = np.array([b[0] for b in bags], np.float32)
    if not 0 < got.sum() < len(got):
        return None
    return train([np.frombuffer(f, np.float32).reshape(-1, FEATURES) for _, f in bags], got, counts[1] / counts[0], epochs)


def scores(model: Model, texts: list[bytes]) -> list[float]:
    found: list[float] = []
    for block in blocks(texts, BLOCK_BYTES):
        rows, first, used = windows(block, PASSAGE)
        x = np.concatenate([passage_features(rows[k : k + 1024], used[k : k + 1024]) for k in range(0, len(rows), 1024)])
        found += _sigmoid(forward(model, (x - model["mean"]) / model["spread"], first)["logit"]).astype(float).tolist()
    return found


def _scored_batches(model: Model | None, batches: Iterator[pa.RecordBatch], texts) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    """Batches of at most ``ROWS`` rows with their scores; ``texts`` gives the texts of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [0.5] * part.num_rows if model is None else scores(model, texts(part))


def _scoring(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored_batches(model, batches, lambda b: bytes_of(b, "_text")):
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, pa.float64())], ["_row", "_score"])

    return score


def _keeping(model: Model | None, place: int, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = lambda b: [x or b"" for x in b.column(0).field(place).cast(pa.binary()).to_pylist()]
        for part, found in _scored_batches(model, batches, texts):
            yield part.filter(pa.array([x >= threshold for x in found], pa.bool_()))

    return keep


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: ``doc_id``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    All passages of the whole text count. Null and empty texts are one empty
    passage, and scored like any other. Without a model, when nothing could be
    learned, every score is 0.5. Repeated rows keep a row each; other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).alias("_row"), F.col(text).alias("_text"))
    found = rows.mapInArrow(_scoring(model), f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")
    return found.select(
        F.col("_row").alias("doc_id"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns; every row passes the task once."""
    rows = docs.select(F.struct("*").alias("_row"))
    kept = rows.mapInArrow(_keeping(model, docs.columns.index(text), threshold), rows.schema)
    return kept.select("_row.*")
