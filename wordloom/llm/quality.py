"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shingles import mix, word_hashes
from wordloom.storage import arrow_batches, materialize

#: Hashed terms of each family, 2 to these powers: words and pairs of words; runs of 3 to 5 characters; shapes.
WORD_BITS, CHAR_BITS, SHAPE_BITS = 13, 14, 12
FAMILIES = [1 << WORD_BITS, 1 << CHAR_BITS, 1 << SHAPE_BITS]
TERMS = sum(FAMILIES)
#: Length of each family's part of a vector.
LENGTHS = [1.0, 1.0, 1.0]
DIMENSIONS = 64
#: Labelled rows that fit the model, about, half of each label: the documented bound on the sample.
LABELLED = 2400
NEIGHBOURS = 25
#: A neighbour's vote is its cosine to this power.
SHARPNESS = 8.0
#: Votes of the base rate, in units of a perfect neighbour.
PRIOR = 0.5
#: Vectors are multiplied with all labelled ones in blocks of this many documents.
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 20
#: Unit vectors are rounded to whole multiples of one part in this many, so that all cosines are exact.
GRID = 1 << 20
#: Labelled rows are numbered below this; a number breaks ties between equal cosines.
ROWS = 1 << 12


def _classes() -> np.ndarray:
    """Shape of a character by code point below 128: letters by case, digits and white space merge."""
    table = np.arange(128, dtype=np.uint64)
    table[97:123], table[65:91], table[48:58] = ord("a"), ord("A"), ord("0")
    table[[9, 11, 12, 13]] = SPACE
    return table


SPACE = 32
SHAPES = _classes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(value: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(value + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64)


def _count(total: np.ndarray, places: np.ndarray) -> None:
    total += np.bincount(places, minlength=len(total))


def terms(text: str) -> np.ndarray:
    """Hashed term counts of the whole text, family after family, counted in blocks of characters.

    Words (lower-cased) and pairs of neighbouring words, with one term for words that repeat the one
    before; runs of 3, 4 and 5 characters as they are, white space as one blank; runs of three
    characters by shape (case, digits and marks), equal neighbours collapsed.
    """
    words, chars, shapes = (np.zeros(n, np.int64) for n in FAMILIES)
    own = word_hashes(text)
    if len(own):
        _count(words, _places(own, 1, WORD_BITS))
        _count(words, _places(own[:-1] * _STEP + own[1:], 2, WORD_BITS))
        words[_places(np.zeros(1, np.uint64), 3, WORD_BITS)[0]] += int((own[1:] == own[:-1]).sum())
    for at in range(0, len(text), BLOCK_CHARS):
        piece = text[at:at + BLOCK_CHARS + 4]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((code >= 9) & (code <= 13), np.uint32(SPACE), code)
        code = code[np.concatenate(([True], (code[1:] != SPACE) | (code[:-1] != SPACE)))].astype(np.uint64) + np.uint64(1)
        run, n = code, len(code)
        for size in range(2, 6):
            n -= 1
            if n <= 0:
                break
            run = run[:n] * _STEP + code[size - 1:]
            if size > 2:
                _count(chars, (run * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        shape = np.where(code <= 128, SHAPES[np.minimum(code - np.uint64(1), np.uint64(127)).astype(np.int64)], np.uint64(ord("a")))
        shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))]
        if len(shape) > 2:
            _count(shapes, _places((shape[:-2] * np.uint64(1 << 20) + shape[1:-1] * np.uint64(1 << 10)) + shape[2:], 4, SHAPE_BITS))
    return np.concatenate([words, chars, shapes])


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur and their TF-IDF weights, each family scaled to its length."""
    seen, out, at = np.flatnonzero(counts), [], 0
    weights = np.log1p(counts[seen]) * idf[seen]
    for size, length in zip(FAMILIES, LENGTHS):
        own = weights[(seen >= at) & (seen < at + size)]
        norm = np.sqrt(own @ own)
        out.append(own * (length / norm) if norm > 0 else own)
        at += size
    return seen, np.concatenate(out).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Term weights, the latent projection, the labelled unit vectors on the grid and their labels."""

    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions, float32
    vectors: np.ndarray  # labelled x dimensions, whole numbers of GRID parts as float64
    labels: np.ndarray
    weights: np.ndarray  # of each labelled row, so that the sample's balance doesn't matter
    base: float

    def embed(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors on the grid. Each text is projected alone, so its vector doesn't depend on the batch."""
        out = np.zeros((len(texts), self.axes.shape[1]))
        for i, text in enumerate(texts):
            seen, x = weighed(terms(text or ""), self.idf)
            out[i] = on_grid(x @ self.axes[seen])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled rows, drawn to the base rate.

        Cosines are sums of whole numbers that a double holds exactly, so no blocking changes them;
        of equal cosines, the rows of least number are nearest.
        """
        if not len(self.labels):
            return np.full(len(texts), self.base)
        scores, number = np.empty(len(texts)), np.arange(len(self.labels))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK_ROWS):
            order = (self.embed(texts[at:at + BLOCK_ROWS]) @ self.vectors.T) * ROWS - number
            near = np.argpartition(-order, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, 1), axis=1), 1)
            cosine = (np.take_along_axis(order, near, 1) + near) / (ROWS * float(GRID) ** 2)
            vote = np.clip(cosine, 0, 1) ** SHARPNESS * self.weights[near]
            scores[at:at + BLOCK_ROWS] = ((vote * self.labels[near]).sum(1) + PRIOR * self.base) / (vote.sum(1) + PRIOR)
        return scores


def on_grid(vector: np.ndarray) -> np.ndarray:
    """The vector at unit length, rounded to the grid; zero stays zero."""
    norm = np.sqrt((vector.astype(np.float64) ** 2).sum(-1, keepdims=True))
    return np.rint(np.divide(vector, norm, out=np.zeros(vector.shape), where=norm > 1e-9) * GRID)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, base: float, dimensions: int = DIMENSIONS) -> Model:
    """Latent axes by a truncated decomposition of the weighted terms of the labelled rows (terms and their counts)."""
    if not len(labels):
        return Model(np.zeros(TERMS), np.zeros((TERMS, dimensions), np.float32), np.zeros((0, dimensions)), labels, np.zeros(0), base)
    if len(labels) >= ROWS:
        raise ValueError(f"{ROWS} labelled rows or more")
    seen = np.zeros(TERMS)
    for term, _ in counts:
        seen[term] += 1
    idf = np.where(seen > 0, np.log((1 + len(labels)) / (1 + seen)) + 1, 0)
    x, own = np.zeros((len(labels), TERMS), np.float32), np.zeros(TERMS, np.int64)
    for i, (term, n) in enumerate(counts):
        own[:] = 0
        own[term] = n
        x[i, np.flatnonzero(own)] = weighed(own, idf)[1]
    # Leading axes by subspace iteration from a seeded start.
    width = min(dimensions + 8, len(labels))
    basis = np.random.default_rng(5).standard_normal((TERMS, width)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])[0]
    turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
    axes = np.zeros((TERMS, dimensions), np.float32)
    axes[:, :min(dimensions, width)] = basis @ turn.T[:, :dimensions]
    ones = labels.mean()
    weights = np.where(labels == 1, base / max(ones, 1e-9), (1 - base) / max(1 - ones, 1e-9))
    return Model(idf, axes, on_grid(x @ axes), labels.astype(np.float64), weights, base)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = LABELLED) -> Model:
    """Fit on about ``sample`` labelled rows, half of each label, chosen by a hash of the key.

    Null keys, labels and texts aren't used. A key that repeats counts once, with its least label and
    least text. Without any labelled row every score is 0.5. ``labels`` must have no row that a
    score may not learn from.
    """
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(key).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y")))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return fit([], np.zeros(0), 0.5)
    spread = F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.lit(0.0)
    for y, n in sizes.items():
        part = F.when(F.col("y") == y, min(1.0, sample / 2 / n)).otherwise(part)
    chosen = known.filter(spread < part)  # about ``sample`` keys, whatever the table's size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py()) for x in batch.column("text")]
            seen = [np.flatnonzero(x).astype(np.int32) for x in found]
            yield pa.record_batch(
                [batch.column("id"), batch.column("y"), pa.array(seen, pa.list_(pa.int32())),
                 pa.array([x[s].astype(np.int32) for x, s in zip(found, seen)], pa.list_(pa.int32()))],
                names=["id", "y", "term", "n"])

    kind = known.schema["id"].dataType.simpleString()
    with arrow_batches(docs.sparkSession):
        rows = (docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
                .join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
                .mapInArrow(count, f"id {kind}, y int, term array<int>, n array<int>").toArrow())
    rows = rows.sort_by("id")
    counts = [(t.values.to_numpy(), n.values.to_numpy()) for t, n in zip(rows.column("term"), rows.column("n"))]
    return fit(counts, rows.column("y").to_numpy(), sizes.get(1, 0) / sum(sizes.values()))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7,
          extra: dict[str, Column] | None = None) -> DataFrame:
    """``key, *extra, score, predicted`` of every whole text; a null or empty one has the base rate as score.

    Equal texts get equal scores, whatever the batches; every row gives one row. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED and TERMS
    extra = extra or {}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "__text"]
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                found = held.value.score(own.column("__text").to_pylist())
                yield pa.record_batch([*[own.column(c) for c in rest], pa.array(found, pa.float64()),
                                       pa.array((found >= threshold).astype(np.int32), pa.int32())],
                                      names=[*rest, "score", "predicted"])

    ready = docs.select(F.col(key).alias(key), *[c.alias(n) for n, c in extra.items()], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "__text")
    with arrow_batches(docs.sparkSession):
        return materialize(ready.mapInArrow(predict, f"{kinds}, score double, predicted int"), "scores")
