"""Language of whole texts by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over windows of fixed
length, each filter keeps its largest response in the window, and a softmax
over these responses tells the language. The network is trained here, in numpy,
on windows of labelled texts. A text has as many windows as it needs; their
probabilities are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import Adam, blocks, bytes_of, windows

WINDOW = 256
EMBEDDING = 6
#: Width and number of filters.
FILTERS = {2: 8, 3: 12, 4: 12}
#: Bounds of the labelled sample: windows of each language (one of a text), and languages.
PER_LANGUAGE = 1024
LANGUAGES = 256
EPOCHS = 12
BATCH = 64
RATE = 4e-3
#: Windows that go through the filters at a time, and bytes of text held in a task.
FORWARD = 64
BLOCK_BYTES = 1 << 22
UNKNOWN = "und"

Network = dict[str, np.ndarray]


def reach() -> np.ndarray:
    """Which weights of the filters may differ from zero: a filter of width ``w`` sees ``w`` bytes of the widest."""
    widths = np.repeat(list(FILTERS), list(FILTERS.values()))
    return (np.arange(max(FILTERS))[:, None] < widths).repeat(EMBEDDING, axis=0).astype(np.float32)


def new_network(n: int, seed: int = 0) -> Network:
    rng, seen = np.random.default_rng(seed), reach()
    net = {
        "embed": rng.normal(0, 1, (256, EMBEDDING)), "filters": seen * rng.normal(0, 1, seen.shape) / np.sqrt(seen.sum(axis=0)),
        "shift": np.zeros(seen.shape[1]), "out": rng.normal(0, 0.1, (seen.shape[1], n)), "bias": np.zeros(n),
    }
    net["embed"][0] = 0  # padding
    return {k: v.astype(np.float32) for k, v in net.items()}


def padded(rows: np.ndarray) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(FILTERS) - 1)))


def responses(net: Network, rows: np.ndarray) -> np.ndarray:
    """What every filter says at every place of every window."""
    embedded = net["embed"][padded(rows)].reshape(len(rows), -1)
    patches = np.lib.stride_tricks.sliding_window_view(embedded, max(FILTERS) * EMBEDDING, axis=1)[:, ::EMBEDDING]
    return (patches.reshape(-1, patches.shape[2]) @ net["filters"]).reshape(len(rows), rows.shape[1], -1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    parts = [
        softmax(np.maximum(responses(net, rows[k : k + FORWARD]).max(axis=1) + net["shift"], 0) @ net["out"] + net["bias"])
        for k in range(0, len(rows), FORWARD)
    ]
    return np.concatenate(parts)


def gradients(net: Network, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the cross entropy. Only the patch a filter was largest at takes part, so the way back is short."""
    n, seen = len(rows), reach()
    said = responses(net, rows)
    place = said.argmax(axis=1)
    best = np.take_along_axis(said, place[:, None], axis=1)[:, 0] + net["shift"]
    ramp = np.maximum(best, 0)
    wrong = softmax(ramp @ net["out"] + net["bias"])
    wrong[np.arange(n), target] -= 1
    wrong /= n
    d = (wrong @ net["out"].T) * (best > 0)
    patch = padded(rows)[np.arange(n)[:, None, None], place[:, :, None] + np.arange(max(FILTERS))]  # bytes by window, filter, step
    embed = np.zeros_like(net["embed"])
    np.add.at(embed, patch, d[:, :, None, None] * net["filters"].T.reshape(1, -1, max(FILTERS), EMBEDDING))
    embed[0] = 0
    return {
        "out": ramp.T @ wrong, "bias": wrong.sum(axis=0), "shift": d.sum(axis=0), "embed": embed,
        "filters": seen * np.einsum("nf,nfk->kf", d, net["embed"][patch].reshape(n, d.shape[1], -1)),
    }


def train(rows: np.ndarray, target: np.ndarray, n: int, epochs: int = EPOCHS, seed: int = 0) -> Network:
    net, rng = new_network(n, seed), np.random.default_rng(seed)
    adam = Adam(net, RATE)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            pick = order[k : k + BATCH]
            adam.step(gradients(net, rows[pick], target[pick]))
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int, languages: int) -> list[tuple[str, str]]:
    """Language and one window of text of up to ``per_language`` documents of each of the most frequent languages.

    Documents and places in them are chosen by hashes. What reaches the driver
    is bounded by the two numbers, whatever the size of the table.
    """
    rows = docs.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    counts = rows.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_l").limit(languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["_l"], min(1.0, 1.2 * per_language / r["_n"]))])
    draw = F.pmod(F.xxhash64(F.lit(11), doc_id, F.xxhash64(text)), F.lit(1 << 40))
    place = F.pmod(F.xxhash64(F.lit(13), doc_id), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1)
    drawn = rows.where(draw < F.coalesce(F.try_element_at(share, lang), F.lit(0.0)) * float(1 << 40)).select(
        F.col(lang).alias("_l"), draw.alias("_draw"), F.col(text).substr((place + 1).cast("int"), F.lit(WINDOW)).alias("_piece"))
    found: dict[str, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["_l"], r["_draw"], r["_piece"])):
        found.setdefault(r["_l"], []).append(r["_piece"])
    return [(of, piece) for of, pieces in sorted(found.items()) for piece in pieces[:per_language]]


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, epochs: int = EPOCHS,
) -> tuple[Network, list[str]]:
    """A network and its languages, from a bounded sample of labelled documents; no language without any."""
    rows = sample(docs, doc_id, text, lang, per_language, languages)
    names = sorted({r[0] for r in rows})
    if not names:
        return new_network(0), []
    place = {name: k for k, name in enumerate(names)}
    seen = np.concatenate([windows([piece.encode()], WINDOW)[0][:1] for _, piece in rows])
    return train(seen, np.array([place[of] for of, _ in rows]), len(names), epochs), names


def _predicting(net: Network, names: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for block in blocks(bytes_of(batch, "_text"), BLOCK_BYTES):
                rows, first, used = windows(block, WINDOW)
                weighed = probabilities(net, rows) * np.maximum(used, 1)[:, None]
                mean = np.add.reduceat(weighed, first, axis=0)
                mean /= mean.sum(axis=1, keepdims=True)
                best += [names[k] for k in mean.argmax(axis=1)]
                score += mean.max(axis=1).astype(float).clip(0, 1).tolist()
            letters = batch.column("_letters").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b if x else UNKNOWN for b, x in zip(best, letters, strict=True)], pa.string()),
                 pa.array([s if x else 0.0 for s, x in zip(score, letters, strict=True)], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return predict


def predict(docs: DataFrame, model: tuple[Network, list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``lang_pred``, ``score`` (0 to 1).

    Every byte of a text is read, nothing but the text is looked at. Texts that
    are null or hold no letter are ``und`` with score 0, as are all texts when
    nothing was learned. Repeated rows keep a row each; other columns are not
    read.
    """
    net, names = model
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    if not names:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("_letters", has_letter(F.col("_text"))).mapInArrow(
        _predicting(net, names), f"doc_id {kind}, lang_pred string, score double")
