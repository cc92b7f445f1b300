"""Frame selection: candidates by category, greedy spacing with gaps and quotas.

Each category is thinned by itself, then frames are accepted in order of the
categories. Spacing runs in rounds over blocks of frames, so that no clip has to
fit into a task, and gives what taking the candidates one by one would give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK, block_groups, cut, in_blocks


@dataclass(frozen=True)
class Category:
    """A category of frames: its rank among others, quota and gap to accepted frames.

    Frames of a category that is not ``thinned`` are tried as they come, without
    the fold over the category by itself.
    """

    label: str
    priority: int
    quota: int
    gap: int
    thinned: bool = True


#: Frames that a user asks for: always accepted, whatever is near.
USER = Category("User", 0, 1 << 30, 0, False)


def _decide(gap: int, block: int, keys: list[str]):
    """One round over a block: decide what does not depend on an undecided row of another block."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable").reset_index(drop=True)
        frames = pdf["frame"].to_numpy()
        own = frames // block == key[-1]
        # 1 accepted, 0 open, -1 rejected
        state = pdf["accepted"].to_numpy().astype(int)
        first, last = np.searchsorted(frames, frames - gap, side="right"), np.searchsorted(frames, frames + gap, side="left")
        order = pdf.sort_values([*keys, "frame"], kind="stable").index.to_numpy()
        rank = np.empty(len(pdf), int)
        rank[order] = np.arange(len(pdf))
        for x in order[(own & (state == 0))[order]]:
            near = slice(first[x], last[x])
            if (state[near] == 1).any():
                state[x] = -1
            elif not ((state[near] == 0) & (rank[near] < rank[x])).any():
                state[x] = 1
        kept = own & (state >= 0)
        return pdf[kept].assign(accepted=state[kept] == 1).drop(columns=["_block"])

    return work


def spaced_frames(candidates: DataFrame, order: list[Column], gap: int, block: int = BLOCK) -> DataFrame:
    """``clip`` and ``frame`` of candidates taken in order, each unless closer than ``gap`` to one taken before.

    Equal frames are one candidate, that of the best place; equal places go by
    frame. Rounds over blocks of frames: a candidate is taken when it is better
    than all open ones within the gap, and its neighbours go. Within a block this
    goes on to the end; only what hangs on an open row of the next block waits
    for another round. The keys ``order`` come back as ``k0``, ``k1`` and so on.
    """
    gap = max(1, gap)
    block = max(block, 2 * gap)
    keys = [f"k{i}" for i in range(len(order))]
    best = F.min(F.struct(*[c.alias(k) for c, k in zip(order, keys)]))
    state = candidates.where("frame is not null").groupBy("clip", F.col("frame").cast("long").alias("frame")).agg(best.alias("k"))
    state = state.select("clip", "frame", *[F.col(f"k.{k}") for k in keys], F.lit(False).alias("accepted"))
    shape = state.schema
    while True:
        dealt = in_blocks(state, "frame", gap - 1, block)
        state = cut(dealt.groupBy(*block_groups(["clip"])).applyInPandas(_decide(gap, block, keys), shape))
        if state.where("not accepted").isEmpty():
            return state.drop("accepted")


def away_from(rows: DataFrame, taken: DataFrame, gap: int) -> DataFrame:
    """Rows that are at least ``gap`` frames from every taken frame of their clip."""
    gap = max(1, gap)
    near = taken.select(F.col("clip").alias("_c"), F.col("frame").alias("_t"), F.explode(F.sequence(F.floor((F.col("frame") - gap) / gap), F.floor((F.col("frame") + gap) / gap))).alias("_b"))
    same = F.col("clip").eqNullSafe(F.col("_c")) & (F.floor(F.col("frame") / gap) == F.col("_b")) & (F.abs(F.col("frame") - F.col("_t")) < gap)
    return rows.join(near, same, "left_anti")


def select_frames(candidates: DataFrame, categories: tuple[Category, ...], windows: DataFrame | None = None) -> DataFrame:
    """Accepted frames of each clip with their labels.

    ``candidates`` has ``clip``, ``label``, ``frame`` and ``place``, by which a
    category's frames are tried, equal places by frame; those outside of their
    clip's window are left out if ``windows`` (``clip``, ``start_frame``,
    ``end_frame``) are given. Rows: ``clip``, ``frame``, ``label``, ascending frames.

    Categories go one after the other: what is near an accepted frame of an
    earlier one is left out, and of the rest the first ones fill the quota.
    """
    if windows is not None:
        candidates = pinned_frames(candidates, windows)[0]
    candidates = cut(candidates.select("clip", "label", "frame", "place"))
    accepted = None
    for c in sorted(categories, key=lambda c: c.priority):
        own = candidates.where(F.col("label") == c.label)
        if not c.thinned and accepted is not None:
            own = away_from(own, accepted, c.gap)
        kept = spaced_frames(own, [F.col("place")], c.gap)
        if c.thinned and accepted is not None:
            kept = away_from(kept, accepted, c.gap)
        if c.quota < 1 << 30:
            order = Window.partitionBy("clip").orderBy("k0", "frame")
            kept = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= c.quota)
        kept = kept.select("clip", "frame", F.lit(c.label).alias("label"))
        accepted = cut(kept if accepted is None else accepted.unionByName(kept))
    return accepted.orderBy("clip", "frame")


def hashed_order(seed: int) -> list[Column]:
    """An order that stands for a shuffle and that any engine can reproduce."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col("frame").cast("string")))]


def python_shuffle(candidates: DataFrame, seed: int) -> DataFrame:
    """``place`` of each frame after Python's own shuffle of its clip's ascending frames.

    For results that must follow the sequential generator bit by bit; one clip is
    one group, as the generator's state runs through it.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        frames = sorted(int(f) for f in pdf["frame"])
        random.Random(seed).shuffle(frames)
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "frame": frames, "place": range(len(frames))})

    return candidates.select("clip", "frame").groupBy("clip").applyInPandas(work, "clip string, frame long, place long")


def pinned_frames(wanted: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User frames inside their clip's window, and those that are dropped."""
    inside = (wanted["clip"] == windows["clip"]) & (wanted["frame"] >= windows["start_frame"]) & (wanted["frame"] < windows["end_frame"])
    return wanted.join(windows, inside, "left_semi"), wanted.join(windows, inside, "left_anti")


def annotation(label: Column, score: Column, source: Column, code: Column, note: Column) -> Column:
    """Text form of a selection's details; parts that are null are left out."""
    return F.concat_ws(
        ";",
        F.concat(F.lit("sel="), label),
        F.when(score.isNotNull(), F.concat(F.lit("score="), F.format_string("%.4f", score))),
        F.concat(F.lit("src="), source),
        F.concat(F.lit("tc="), code),
        F.concat(F.lit("note="), note),
    )
