"""Detections against ground truth within bounded groups (the boxes of one class in one image), in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import iou

MATCH = "struct<used:array<bigint>,out:array<struct<r:bigint,k:bigint,ig:boolean>>>"


def with_overlaps(dets: Column, truths: Column, floor: float) -> Column:
    """``dets`` (r, score, area, box) with near: the truths (k, ig, area, box) that overlap by ``floor`` or more, as (iou, k, ig, area).

    Overlaps are worked out here once; greedy_matches() then needs no boxes, whatever the settings.
    """

    def near(x: Column) -> Column:
        pairs = F.transform(truths, lambda t: F.struct(F.round(iou(t["box"], x["box"]), 6).alias("iou"), t["k"].alias("k"), t["ig"].alias("ig"), t["area"].alias("area")))
        return F.filter(pairs, lambda p: p["iou"] >= floor)

    return F.transform(dets, lambda x: F.struct(x["r"].alias("r"), x["score"].alias("score"), x["area"].alias("area"), near(x).alias("near")))


def greedy_matches(dets: Column, ignored: Callable[[Column], Column], least: Column) -> Column:
    """Array of (r, k, ig) for each detection of with_overlaps(), best score first: the truth that it takes, 0 for none.

    A detection takes the truth of largest overlap, at least ``least``, that none before it took; truths to be ``ignored``
    only if there is no other; among equal ones the last.
    """

    def step(state: Column, x: Column) -> Column:
        pairs = F.transform(x["near"], lambda t: F.struct((~ignored(t)).alias("ok"), t["iou"].alias("iou"), t["k"].alias("k")))
        best = F.array_max(F.filter(pairs, lambda p: (p["iou"] >= least) & ~F.array_contains(state["used"], p["k"])))

        def taken(b: Column) -> Column:
            k = F.coalesce(b["k"], F.lit(0).cast("bigint"))
            one = F.struct(x["r"].alias("r"), k.alias("k"), F.coalesce(~b["ok"], F.lit(False)).alias("ig"))
            return F.struct(F.array_append(state["used"], k).alias("used"), F.array_append(state["out"], one).alias("out"))

        # bound by a lambda, so that it is worked out once
        return F.get(F.transform(F.array(best), taken), F.lit(0))

    none = F.struct(F.array(F.lit(0).cast("bigint")).alias("used"), F.expr("array()").cast("array<struct<r:bigint,k:bigint,ig:boolean>>").alias("out")).cast(MATCH)
    return F.aggregate(dets, none, step, lambda state: state["out"])
