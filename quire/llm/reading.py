"""Reading level of texts, propagated from graded ones over the graph of documents and words.

Words and pairs of neighbouring words are one side of the graph, documents the other. Graded documents are
clamped to their grade; a word's difficulty is the mean of its documents', a document's the weighted mean of
its words', again and again (harmonic iteration). Thresholds fitted on the graded documents, each judged
without its own grade, turn the continuous difficulty into levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.align import _scramble, words_of
from quire.llm.lines import binary, chunks, flat, lines_of
from quire.runtime import cut, release, ship, small, spread

#: Words and word pairs are told apart by a hash of this many bits: the word side has at most 2**BITS slots, of
#: which only those seen travel. Words that share a slot share a difficulty, and weigh little if they are many.
BITS = 21
#: Harmonic iterations; how many ungraded documents a graded one outweighs; spread at which a word counts half.
ROUNDS, CLAMP, SPREAD = 8, 200.0, 0.3
LEVELS = (1, 2, 3, 4)
#: Bins of the difficulty scale in which graded documents are counted for the thresholds.
BINS = 600
#: By how much a document's own grade pulls its difficulty towards it when levels are given.
PULL = 0.12
STEP = 400


def pack(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """For each text two lists of numbers: the slots of its words and word pairs, and how often each occurs."""
    lines = lines_of(texts)
    lines.prose[:] = True
    h, line, number = words_of(lines)
    h, line = h[~number], line[~number]
    near = line[1:] == line[:-1] if len(line) else np.zeros(0, bool)
    pair = _scramble(h[:-1] * np.uint64(31) + h[1:])[near] if len(h) else h
    text = lines.text[np.concatenate([line, line[1:][near] if len(line) else line])]
    slot = (np.concatenate([h, pair]) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    key, n = np.unique(text * (1 << BITS) + slot, return_counts=True)
    per = np.bincount(key >> BITS, minlength=len(texts))
    return binary((key & ((1 << BITS) - 1)).astype(np.int32), per), binary(np.minimum(n, 32767).astype(np.int16), per)


class Graph:
    """The word side: for each slot the weight, difficulty and squared difficulty of its documents, and its documents."""

    def __init__(self, sums: np.ndarray, docs: int, mean: float):
        self.sums, self.docs, self.mean = sums, docs, mean

    def __getstate__(self) -> dict:
        seen = np.flatnonzero(self.sums[3])
        return {"docs": self.docs, "mean": self.mean, "seen": seen.astype(np.int32), "held": self.sums[:, seen]}

    def __setstate__(self, state: dict) -> None:
        self.docs, self.mean, self.sums = state["docs"], state["mean"], np.zeros((4, 1 << BITS), np.float32)
        self.sums[:, state["seen"]] = state["held"]

    def difficulty(self, text: np.ndarray, slot: np.ndarray, many: np.ndarray, grade: np.ndarray) -> np.ndarray:
        """Difficulty of each document from its words; a graded one's own grade is left out of its words' means."""
        base = (1 + np.log(many)).astype(np.float64)
        den, num, sq, df = (self.sums[k][slot].astype(np.float64) for k in range(4))
        g = grade[text]
        own = ~np.isnan(g)
        mine = np.where(own, base * CLAMP, 0)
        g = np.where(own, g, 0)
        d = np.maximum(den - mine, 0) + 0.5
        score = (num - mine * g + 0.5 * self.mean) / d
        var = np.maximum((sq - mine * g * g + 0.5 * (self.mean**2 + 1)) / d - score**2, 0)
        w = base * np.log((self.docs + 1) / (df + 1)).clip(0.02) / (var + SPREAD)
        n = len(grade)
        return (np.bincount(text, w * score, n) + 1e-6 * self.mean) / (np.bincount(text, w, n) + 1e-6)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    slots, per = flat(b.column(2), np.int32)
    grade = b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(b.num_rows), per), slots.astype(np.int64), flat(b.column(3), np.int16)[0].astype(np.float64), grade


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from chunks(b, 2, 1 << 30, 16_000_000)


def _spread_scores(rows: DataFrame) -> np.ndarray:
    """Sums over all partitions; what comes to the driver is one row a slot seen, 2**BITS at most."""
    got = rows.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("den", "num", "sq", "df")]).toArrow()
    sums = np.zeros((4, 1 << BITS), np.float32)
    at = got.column("slot").to_numpy()
    for k, c in enumerate(("den", "num", "sq", "df")):
        sums[k][at] = got.column(c).to_numpy()
    return sums


def levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Columns key, difficulty, reading_level: one row for each text that holds a letter.

    labels: key, reading_level (several raters: their mean). Null, empty and letterless texts have no row;
    repeated keys are repeated; without any labels every text gets the middle of the scale.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, 1, STEP):
                yield pa.RecordBatch.from_arrays([part.column(0), *pack(part.column(1).to_pylist())], names=["key", "slots", "many"])

    kind = docs.schema[key].dataType.simpleString()
    some = spread(docs.where(F.col(text).rlike(r"\p{L}") & F.col(key).isNotNull()).select(F.col(key).alias("key"), text))
    graded = labels.where("reading_level is not null").groupBy(F.col(key).alias("key")).agg(F.avg("reading_level").alias("grade"))
    graded = cut(graded)
    d = cut(some.mapInArrow(packed, f"key {kind}, slots binary, many binary").join(small(graded), "key", "left").select("key", "grade", "slots", "many"))
    release(graded)
    start = d.agg(F.avg("grade").alias("m"), F.count("*").alias("n")).first()
    mean, count = (2.5 if start["m"] is None else float(start["m"])), int(start["n"])
    graph: Graph | None = None
    for _ in range(rounds):
        held = sc.broadcast(graph)

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            sums, g = np.zeros((4, 1 << BITS)), held.value
            for b in _parts(batches):
                text_, slot, many, grade = _read(b)
                score = np.full(len(grade), mean) if g is None else g.difficulty(text_, slot, many, grade)
                own = ~np.isnan(grade)
                s = np.where(own, grade, score)[text_]
                w = (1 + np.log(many)) * np.where(own, CLAMP, 1.0)[text_]
                for k, x in enumerate((w, w * s, w * s * s, None)):
                    sums[k] += np.bincount(slot, x, 1 << BITS)
            seen = np.flatnonzero(sums[3])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(sums[k][seen].astype(np.float32), pa.float32()) for k in range(4))], names=["slot", "den", "num", "sq", "df"])

        graph = Graph(_spread_scores(d.mapInArrow(step, "slot int, den float, num float, sq float, df float")), count, mean)
        held.destroy()
    held = sc.broadcast(graph)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            score = held.value.difficulty(*_read(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["key", "grade", "difficulty"])

    scored = cut(d.mapInArrow(final, f"key {kind}, grade double, difficulty double"))
    held.destroy()
    release(d)
    cuts = thresholds(scored.where("grade is not null"))
    level = lambda x: sum((x > c).cast("int") for c in cuts) + F.lit(LEVELS[0])
    own = F.coalesce(F.signum(F.col("grade") - level(F.col("difficulty"))), F.lit(0.0)) * PULL
    return scored.select(F.col("key").alias(key), "difficulty", level(F.col("difficulty") + own).cast("bigint").alias("reading_level"))


def thresholds(graded: DataFrame) -> list[float]:
    """Between each two levels the difficulty that parts the graded documents with the fewest errors.

    graded: grade, difficulty. Only counts by bin of difficulty come to the driver.
    """
    lo, hi = LEVELS[0], LEVELS[-1]
    bin_ = F.floor((F.col("difficulty") - lo) / (hi - lo) * BINS).cast("int")
    rows = graded.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), bin_)).alias("b"), F.col("grade").alias("g")).agg(F.count("*").alias("n")).collect()
    cuts = []
    for a in LEVELS[:-1]:
        above, below = np.zeros(BINS), np.zeros(BINS)
        for r in rows:
            if r["g"] == a + 0.5:
                continue  # the raters are of two minds here
            (above if r["g"] > a + 0.5 else below)[r["b"]] += r["n"]
        # errors of a cut before bin k: those above it that lie below, and the other way round
        wrong = np.concatenate([[0], np.cumsum(above)]) + below.sum() - np.concatenate([[0], np.cumsum(below)])
        if not above.sum() or not below.sum():
            cuts.append(a + 0.5)
            continue
        width = max(1, BINS // 60)
        smooth = np.convolve(np.pad(wrong, width, mode="edge"), np.ones(2 * width + 1) / (2 * width + 1), "valid")
        best = np.flatnonzero(smooth <= smooth.min() + 1e-9)
        cuts.append(lo + float(best.mean()) * (hi - lo) / BINS)
    return list(np.maximum.accumulate(cuts))
