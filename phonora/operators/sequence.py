"""Order-sensitive operators: CTC, offsets, batching, sampling, signals, running statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ctc_greedy(frames: DataFrame, key: Sequence[str], frame: str, label: str, score: str | None = None, blank=0) -> DataFrame:
    """(key…, tokens, timesteps, score): runs of equal labels collapsed, blanks dropped.

    ``frames`` has the best class of each frame; timesteps count from 1 and are where a run starts; the
    score is the sum of the frames' best scores.
    """
    w = W.partitionBy(*key).orderBy(frame)
    marked = frames.withColumns({"_prev": F.lag(label).over(w), "_n": F.row_number().over(w)})
    start = (F.col(label) != F.lit(blank)) & ~F.col(label).eqNullSafe(F.col("_prev"))
    run = F.collect_list(F.when(start, F.struct("_n", label)))
    total = F.sum(score) if score else F.lit(None).cast("double")
    out = marked.groupBy(*key).agg(F.sort_array(run).alias("_runs"), total.alias("score"))
    return out.select(*key, F.transform("_runs", lambda r: r[label]).alias("tokens"), F.transform("_runs", lambda r: r["_n"]).alias("timesteps"), "score")


def ctc_greedy_array(emissions: Column, length: Column, blank: int = 0) -> Column:
    """The same for one row's array<array<float>>: struct(tokens, timesteps, score), frames cut to the length."""
    frames = F.slice(emissions, 1, length)
    best = F.transform(frames, lambda e: F.struct((F.array_position(e, F.array_max(e)) - 1).cast("int").alias("c"), F.array_max(e).cast("double").alias("v")))
    zero = F.struct(F.array().cast("array<int>").alias("tokens"), F.array().cast("array<int>").alias("timesteps"), F.lit(0.0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("t"))

    def step(acc: Column, e: Column) -> Column:
        new = (e["c"] != blank) & (e["c"] != acc["last"])
        return F.struct(
            F.when(new, F.concat(acc["tokens"], F.array(e["c"]))).otherwise(acc["tokens"]).alias("tokens"),
            F.when(new, F.concat(acc["timesteps"], F.array(acc["t"] + 1))).otherwise(acc["timesteps"]).alias("timesteps"),
            (acc["score"] + e["v"]).alias("score"),
            e["c"].alias("last"),
            (acc["t"] + 1).alias("t"),
        )

    return F.aggregate(best, zero, step, lambda a: F.struct(a["tokens"].alias("tokens"), a["timesteps"].alias("timesteps"), a["score"].alias("score")))


def ctc_beam(log_probs: list[list[float]], tokens: Sequence[str], width: int = 1, n_best: int = 1, blank: int = 0) -> list[tuple[list[str], float]]:
    """Prefix beam search over one utterance: the ``n_best`` token lists with their log probabilities.

    A frame is one step in numpy over all prefixes and classes.  Equal scores go by the prefix.
    """
    keep = max(width, n_best)
    prefixes: list[tuple[int, ...]] = [()]
    ends_blank, ends_token = np.zeros(1), np.full(1, -np.inf)  # of paths that end in a blank, or in the last token
    for row in np.asarray(log_probs, float):
        n, total = len(prefixes), np.logaddexp(ends_blank, ends_token)
        last = np.array([p[-1] if p else blank for p in prefixes])
        some = np.flatnonzero([bool(p) for p in prefixes])
        longer = total[:, None] + row[None, :]
        longer[some, last[some]] = ends_blank[some] + row[last[some]]  # a token is repeated over a blank only
        longer[:, blank] = -np.inf
        stay_blank, stay_token = total + row[blank], np.full(n, -np.inf)
        stay_token[some] = ends_token[some] + row[last[some]]
        place = {p: i for i, p in enumerate(prefixes)}
        for j in some.tolist():
            i = place.get(prefixes[j][:-1])
            if i is not None:  # the prefix also arises from a shorter one of the beam
                stay_token[j] = np.logaddexp(stay_token[j], longer[i, last[j]])
                longer[i, last[j]] = -np.inf
        scores = np.concatenate([np.logaddexp(stay_blank, stay_token), longer.ravel()])
        cut = np.partition(scores, -keep)[-keep] if len(scores) > keep else -np.inf
        found = np.flatnonzero((scores >= cut) & (scores > -np.inf)).tolist()
        named = [(-scores[k], prefixes[k] if k < n else (*prefixes[(k - n) // len(row)], (k - n) % len(row)), k) for k in found]
        chosen = sorted(named)[:keep]
        at = np.array([k for _, _, k in chosen])
        old = at < n
        ends_blank = np.where(old, stay_blank[np.minimum(at, n - 1)], -np.inf)
        ends_token = np.where(old, stay_token[np.minimum(at, n - 1)], scores[at])
        prefixes = [p for _, p, _ in chosen]
    ranked = sorted(zip(-np.logaddexp(ends_blank, ends_token), prefixes, strict=True))[:n_best]
    return [([tokens[c] for c in p], float(-s)) for s, p in ranked]


def beam_decoder(tokens: Sequence[str], width: int = 1, n_best: int = 1, blank: int = 0):
    """An Arrow function from array<array<float>> of log probabilities to array<struct(tokens, score)>."""
    if n_best > width:
        raise ValueError("n_best is larger than the beam")

    @F.pandas_udf("array<struct<tokens: array<string>, score: double>>")
    def decode(emissions: pd.Series) -> pd.Series:
        return emissions.map(lambda e: None if e is None else [{"tokens": t, "score": s} for t, s in ctc_beam([list(r) for r in e], tokens, width, n_best, blank)])

    return decode


def offsets(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """Rows before each group in group order; one row per group, hence small."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))


def first_n(df: DataFrame, group: str, order: Sequence[str], limit: int | Mapping[str, int] | None) -> DataFrame:
    """The first rows of each group, by one limit or one per group; a group without a limit of its own is an error."""
    if limit is None:
        return df
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit_for(F.col(group), limit)).drop("_rank")


def limit_for(group: Column, limit: int | Mapping[str, int]) -> Column:
    if isinstance(limit, int):
        return F.lit(limit)
    table = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])
    return F.coalesce(F.try_element_at(table, group), F.raise_error(F.concat(F.lit("no limit for "), group)).cast("int"))


def islands(df: DataFrame, order: Sequence[str], value: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` plus island: consecutive rows of an equal value share a number, from 0."""
    w = W.partitionBy(*within).orderBy(*order)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def pre_emphasis(df: DataFrame, key: str, order: Sequence[str], x: str, coefficient: float = 0.97) -> DataFrame:
    """``df`` plus emphasised: x minus the coefficient times the sample before; before the first comes the second."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag(x).over(w), F.lead(x).over(w))
    return df.withColumn("emphasised", F.col(x) - coefficient * before)


def standardised(df: DataFrame, key: Sequence[str], x: str, epsilon: float = 1e-7) -> DataFrame:
    """``df`` plus standardised: zero mean and unit variance within the key."""
    w = W.partitionBy(*key)
    return df.withColumn("standardised", (F.col(x) - F.avg(x).over(w)) / F.sqrt(F.var_pop(x).over(w) + epsilon))


def improvement(df: DataFrame, order: str, loss: str, patience: int | None = None) -> DataFrame:
    """``df`` plus best_before, improved, since (steps without improvement) and stop (since reaches the patience)."""
    past = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    up_to = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("best_before", F.min(loss).over(past)).withColumn("improved", F.coalesce(F.col(loss) < F.col("best_before"), F.lit(True)))
    out = out.withColumn("_n", F.row_number().over(W.orderBy(order)))
    out = out.withColumn("since", F.col("_n") - F.max(F.when(F.col("improved"), F.col("_n"))).over(up_to)).drop("_n")
    return out.withColumn("stop", F.col("since") >= patience) if patience is not None else out


def frame_batches(df: DataFrame, group: Sequence[str], order: str, length: str, budget: int, empty_first: bool = False) -> DataFrame:
    """``df`` plus batch: greedy packing so that rows times the longest length stay within the budget.

    The fold is sequential within a group, in Arrow batches that carry only the open batch's size; groups
    are packed in parallel.  With ``empty_first`` a first row above the budget leaves batch 0 empty.
    """
    columns = df.columns

    # The rows of a group come sorted, a part at a time, so a group need not fit memory.
    keyed = df.repartition(*group).sortWithinPartitions(*group, order)
    schema = df.limit(0).withColumn("batch", F.lit(0)).schema

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None}
        for part in parts:
            out = []
            for key, size in zip(part[list(group)].itertuples(index=False, name=None), part[length], strict=True):
                if key != state["key"]:
                    state = {"key": key, "batch": 0, "n": 0, "longest": 0, "first": True}
                state["longest"] = max(state["longest"], size)
                if (state["n"] + 1) * state["longest"] > budget and (state["n"] or (state["first"] and empty_first)):
                    state |= {"batch": state["batch"] + 1, "n": 0, "longest": size}
                state |= {"n": state["n"] + 1, "first": False}
                out.append(state["batch"])
            yield part.assign(batch=out)[[*columns, "batch"]]

    return keyed.mapInPandas(whole, schema)


def fixed_batches(df: DataFrame, group: Sequence[str], order: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1) / size).cast("int"))


def oversampling(counts: DataFrame, n: str = "n", factor: float = 0.5) -> DataFrame:
    """``counts`` plus samples: rows drawn per epoch so that the largest group is covered once."""
    every = W.partitionBy()
    weight = F.pow(F.col(n) / F.sum(n).over(every), F.lit(factor))
    out = counts.withColumn("_w", weight)
    top = F.max(F.struct(n, "_w")).over(every)
    return out.withColumn("samples", F.bround(top[n] / top["_w"] * F.col("_w")).cast("long")).drop("_w")


def oversampled(df: DataFrame, group: str, order: Sequence[str], factor: float = 0.5, seed: int | None = None) -> DataFrame:
    """Rows repeated cyclically as often as oversampling asks, with draw; shuffled by a seed if given."""
    plan = oversampling(df.groupBy(group).agg(F.count("*").alias("_n")), "_n", factor).select(F.col(group).alias("_g"), "_n", "samples")
    ranked = df.withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    found = ranked.join(F.broadcast(plan), F.col(group) == F.col("_g")).filter("_at < samples")
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1 - F.col("_at")) / F.col("_n")))
    out = found.withColumn("_turn", F.explode(turns)).withColumn("draw", F.col("_turn") * F.col("_n") + F.col("_at"))
    out = out.select(*df.columns, "draw")
    return out if seed is None else out.orderBy(F.xxhash64(F.lit(seed), F.col(group).cast("string"), "draw"))


def cyclic(index: Column, n: Column, offset: Column) -> Column:
    return F.pmod(index, n) + offset


def skip(df: DataFrame, order: Sequence[str], n: int, limit: int | None = None) -> DataFrame:
    """Rows after the first ``n``."""
    out = df.orderBy(*order).offset(n)
    return out if limit is None else out.limit(limit)


def running_mean(df: DataFrame, order: str, x: str, within: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("running_mean", F.avg(x).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed pseudo-random order: by a hash of seed and key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def padded_batches(df: DataFrame, group: Sequence[str], order: str, values: str, length: str, pad: float = 0.0) -> DataFrame:
    """(group…, lengths, values): one row per batch, arrays padded to the longest of the batch."""
    out = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, length, values))).alias("_rows"), F.max(length).alias("longest"))
    fill = lambda r: F.concat(r[values], F.array_repeat(F.lit(pad).cast("float"), F.col("longest").cast("int") - F.size(r[values])))
    return out.select(*group, F.transform("_rows", lambda r: r[length]).alias("lengths"), F.transform("_rows", fill).alias("values"))
