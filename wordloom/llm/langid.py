"""Language ID by multilingual mixture inference over hashed character trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.storage import arrow_batches, materialize

#: Hashed trigrams: 2 to this power.
BITS = 15
#: Whole training texts taken of a language, about; a documented bound on the sample that fits the model.
TEXTS_PER_LANGUAGE = 1500
#: Most languages of a model.
MOST_LANGUAGES = 400
#: A language is added where the log-likelihood gains more than this times the log of the number of trigrams.
PENALTY = 5.0
#: Proportions have converged when no others can have a log-likelihood greater by more than this.
TOLERANCE = 1e-3
#: Characters counted at a time.
BLOCK = 1 << 20
SPACE = 32


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the whole text: letters lower-cased, runs of other ASCII as one space."""
    total, lowered = np.zeros(1 << BITS, np.int64), text.lower()
    for at in range(0, max(len(lowered), 1), BLOCK):
        piece = f" {lowered[at:at + BLOCK]} " if at + BLOCK >= len(lowered) else f" {lowered[at:at + BLOCK + 2]}"
        piece = piece if at == 0 else piece[1:]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((code >= 97) & (code <= 122) | (code >= 128), code, np.uint32(SPACE))
        code = code[np.concatenate(([True], (code[1:] != SPACE) | (code[:-1] != SPACE)))].astype(np.uint64)
        if len(code) < 3:
            continue
        mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:] * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return total


@dataclass(frozen=True)
class Model:
    """Languages in order, and each trigram's likelihood in each, scaled so that a trigram's best is 1."""

    languages: list[str]
    likelihood: np.ndarray  # languages x trigrams, float32

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], smoothing: float = 0.1) -> Model:
        names = sorted(counts)
        if not names:
            return cls([], np.zeros((0, 1 << BITS), np.float32))
        p = np.stack([counts[x] for x in names]).astype(np.float64) + smoothing
        p /= p.sum(1, keepdims=True)
        return cls(names, (p / p.max(0)).astype(np.float32))


def expectation_maximisation(like: np.ndarray, counts: np.ndarray, start: np.ndarray, wanted: float = -np.inf) -> tuple[np.ndarray, float]:
    """Proportions that maximise the mixture's log-likelihood, from ``start``; and that log-likelihood.

    With ratios r of each language's likelihood to the mixture's, averaged over the trigrams, no
    proportions beat the present ones by more than n log max r. Rounds end when that is below the
    tolerance, or when even so much more wouldn't reach ``wanted``.
    """
    share, n = start, counts.sum()
    while True:
        mixed = share @ like
        ratio = like @ (counts / mixed) / n
        score, gap = float(counts @ np.log(mixed)), float(n * np.log(ratio.max()))
        if gap <= TOLERANCE or score + gap <= wanted:
            return share, score
        share = share * ratio


def best_set(like: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of the set with the best penalised likelihood, as a stepwise search finds it, and their proportions.

    From the best single language on, the language that gains most joins while the gain beats the
    penalty; then each member whose loss the penalty outweighs goes, least loss first.
    """
    penalty = PENALTY * np.log(weight.sum() + 1)
    alone = np.log(like) @ weight
    chosen, share, score = [int(alone.argmax())], np.ones(1), float(alone.max())
    while len(chosen) < len(like):
        # The same bound on what a language can add tells which can beat the penalty at all.
        slope = like @ (weight / (share @ like[chosen])) / weight.sum()
        slope[chosen] = 0
        able = np.flatnonzero(weight.sum() * np.log(np.maximum(slope, 1)) + TOLERANCE > penalty)
        tried = [(new, *expectation_maximisation(like[[*chosen, new]], weight, np.append(share * 0.8, 0.2), score + penalty)) for new in able]
        new, more, gained = max(tried, key=lambda x: x[2], default=(None, None, -np.inf))
        if gained - score <= penalty:
            break
        chosen, share, score = [*chosen, int(new)], more, gained
        while len(chosen) > 2:
            rests = [[c for c in chosen if c != out] for out in chosen]
            lesser = [(r, *expectation_maximisation(like[r], weight, np.full(len(r), 1 / len(r)))) for r in rests]
            fewer, more, lowered = max(lesser, key=lambda x: x[2])
            if score - lowered >= penalty:
                break
            chosen, share, score = fewer, more, lowered
    return chosen, share


def infer(model: Model, text: str | None) -> tuple[str, float, dict[str, float]]:
    """Main language, its share (times its posterior if alone), and all shares of the set that :func:`best_set` finds."""
    if not model.languages or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, {}
    counts = trigram_counts(text)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return "und", 0.0, {}
    weight, like = counts[seen].astype(np.float64), model.likelihood[:, seen].astype(np.float64)
    chosen, share = best_set(like, weight)
    at, sure = int(share.argmax()), 1.0
    if len(chosen) == 1:
        alone = np.log(like) @ weight
        sure = 1 / np.exp(np.clip(alone - alone.max(), -700, 0)).sum()
    return (model.languages[chosen[at]], float(min(1.0, share[at] * sure)),
            {model.languages[c]: float(s) for c, s in zip(chosen, share)})


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Fit a model on about ``per_language`` whole texts of each language, chosen by a hash of key and text.

    Rows without text or language aren't used; if none is left, the model knows no language
    and calls everything ``und``. More than ``MOST_LANGUAGES`` languages are an error.
    """
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model.of({})
    part = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col(lang))
    spread = F.pmod(F.xxhash64(F.lit("fit"), F.col(key), F.col(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column("lang"), batch.column("text")):
                name = name.as_py()
                sums[name] = sums.get(name, 0) + trigram_counts(value.as_py())
        for name, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int64()),
                                   pa.array(total[seen], pa.int64())], names=["lang", "gram", "n"])

    found = (usable.filter(spread < part).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
             .mapInArrow(count, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
             .groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")))
    with arrow_batches(labelled.sparkSession):
        rows = found.toArrow()  # one row for each language
    counts = {}
    for name, gram, n in zip(rows.column("lang"), rows.column("gram"), rows.column("n")):
        counts[name.as_py()] = np.zeros(1 << BITS)
        counts[name.as_py()][gram.values.to_numpy()] = n.values.to_numpy()
    return Model.of({k: v for k, v in counts.items() if v.any()})


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text",
             extra: dict[str, Column] | None = None, keep_text: bool = False) -> DataFrame:
    """``key, *extra, lang_pred, score, shares`` of every whole text, and ``__text`` itself if wanted.

    ``und`` with score 0 if a text is null or has no letter. Equal texts get equal values; every
    row gives one row, repeated ones too. Columns of ``docs`` other than key and text are ignored.
    Without the text the result is written to the shared folder, else it is computed where it is used.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES
    extra = extra or {}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(held.value, x.as_py()) for x in batch.column("__text")]
            rest = [c for c in batch.schema.names if keep_text or c != "__text"]
            yield pa.record_batch(
                [*[batch.column(c) for c in rest], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()),
                 pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64()))],
                names=[*rest, "lang_pred", "score", "shares"])

    spark = docs.sparkSession
    ready = docs.select(F.col(key).alias(key), *[c.alias(n) for n, c in extra.items()], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if keep_text or f.name != "__text")
    found = ready.mapInArrow(predict, f"{kinds}, lang_pred string, score double, shares map<string,double>")
    if keep_text:
        return found
    with arrow_batches(spark):
        return materialize(found, "languages")
