"""Mix sources to target weights along a training schedule whose weights change with time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import cut


@dataclass(frozen=True)
class Share:
    source: str
    target: float  # share asked for
    supply: int  # tokens the source has
    grant: float  # tokens it gets
    tilt: float  # from -1 (all early) to 1 (all late)


def grants(targets: list[tuple[str, float, int]], supply: dict[str, int], total: float) -> dict[str, float]:
    """Tokens granted to each source: its target, at most max_repeats times its supply.

    What capped or absent sources leave over goes to the others in proportion to their targets, again
    and again until nothing is left over or every source is at its cap.
    """
    cap = {s: float(supply.get(s, 0)) * max(0, r or 0) for s, _, r in targets}
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    got: dict[str, float] = {}
    left, still = float(total), {s for s in share if share[s] > 0}
    while still:
        whole = sum(share[s] for s in still)
        full = {s for s in still if cap[s] <= left * share[s] / whole}
        if not full:
            got |= {s: left * share[s] / whole for s in still}
            break
        got |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        still -= full
    return {s: got.get(s, 0.0) for s in share}


def tilts(granted: dict[str, float], level: dict[str, float]) -> dict[str, float]:
    """How late each source comes: its weight at time t is grant * (1 + tilt * (2 t - 1)).

    Sources are ranked by level (here: the mean size of their documents), the lowest first; the tilts are
    then centred, so that all sources together have the same weight at every time.
    """
    used = sorted((s for s in granted if granted[s] > 0), key=lambda s: (level.get(s, 0.0), s))
    if len(used) < 2:
        return dict.fromkeys(granted, 0.0)
    raw = {s: -0.5 + i / (len(used) - 1) for i, s in enumerate(used)}
    mean = sum(granted[s] * raw[s] for s in used) / sum(granted[s] for s in used)
    return {s: raw[s] - mean if s in raw else 0.0 for s in granted}


def plan(sized: DataFrame, targets: DataFrame) -> list[Share]:
    """The shares of the sources named in targets. Reads one row a target, never one a document."""
    asked = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]
    # one row for each target, and one with a null source for the total
    per = sized.join(targets.select("source").distinct().withColumn("_in", F.lit(1)), "source", "left")
    rows = per.groupBy(F.when(F.col("_in") == 1, F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    total = sum(r["n"] or 0 for r in rows)
    supply = {r["source"]: r["n"] for r in rows if r["source"] is not None}
    level = {r["source"]: r["n"] / r["docs"] for r in rows if r["source"] is not None}
    granted = grants(asked, supply, total)
    late = tilts(granted, level)
    return sorted((Share(s, w or 0.0, supply.get(s, 0), granted[s], late[s]) for s, w, _ in asked), key=lambda x: x.source)


#: Documents that a bucket of the running sums holds, on average.
BUCKET = 65_536


def place(sized: DataFrame, shares: list[Share], buckets: int | None = None, seed: int = 17) -> DataFrame:
    """Columns doc_id, source, copy, n_tokens, position: each use of a document with its place in [0, 1).

    The documents of a source, in random but fixed order, form a tape of tokens that is run through once
    for each repeat; a use counts if its middle lies within the source's grant. Its position is the time at
    which the integral of the source's weight reaches that middle. The running sums are made in two
    steps, over buckets of a source and within them, so that a source with a third of all rows is spread
    over that many tasks. A bucket is a range of the hash that orders the tape, so their number (a power of two, by
    default one for BUCKET documents) changes nothing in the result. Documents without tokens are not used.
    """
    spark = sized.sparkSession
    known = spark.createDataFrame([(x.source, float(x.supply), x.grant, x.tilt) for x in shares if x.grant > 0 and x.supply > 0] or [("", 0.0, 0.0, 0.0)], "source string, supply double, granted double, tilt double")
    d = sized.where("n_tokens > 0 and source is not null").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    bits = max(1, math.ceil(math.log2(max(2, sized.count() / BUCKET if buckets is None else buckets))))
    # (the top bits of the hash; within a bucket they are equal, so the rest is in the same order signed or not)
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    ahead = d.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_sum"))
    ahead = ahead.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("n_tokens").over(inside)).join(ahead, ["source", "_b"]).join(known, "source")
    d = d.withColumn("_mid", F.col("_ahead") + F.col("_in") - F.col("n_tokens") / 2.0)
    # copies 0, 1, ... as long as copy * supply + mid < granted
    d = d.withColumn("_n", F.ceil((F.col("granted") - F.col("_mid")) / F.col("supply")).cast("int")).where("_n > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    u = (F.col("copy") * F.col("supply") + F.col("_mid")) / F.col("granted")
    g = F.col("tilt")
    position = 2 * u / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * u))
    return d.select("doc_id", "source", "copy", "n_tokens", position.alias("position"))


def mix(sized: DataFrame, targets: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """The mixed set in training order: place, sorted by range of position. sized: doc_id, source, n_tokens.

    Ties in position are ordered by doc_id and copy. Documents with a null source, or a source that targets
    doesn't name, count for the size of the corpus but are not used. An empty corpus gives no rows.
    """
    sized = cut(sized)
    return place(sized, plan(sized, targets), **how).orderBy("position", "doc_id", "copy")


def shares_report(sized: DataFrame, targets: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """One row a target: target and actual share, what was there and what was used."""
    sized = cut(sized)
    shares = plan(sized, targets)
    used = place(sized, shares, **how).groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("uses"), F.max("copy").alias("_c"))
    asked = sized.sparkSession.createDataFrame([(x.source, x.target, x.supply) for x in shares], "source string, target_share double, tokens_there bigint")
    d = asked.join(used, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
    whole = d.agg(F.sum("tokens_used").alias("_t"))
    return d.join(whole).select("source", "target_share", (F.col("tokens_used") / F.col("_t")).alias("actual_share"), "tokens_there", "tokens_used", F.coalesce("uses", F.lit(0)).alias("uses"), (F.coalesce("_c", F.lit(-1)) + 1).cast("int").alias("most_uses"))
