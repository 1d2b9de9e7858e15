"""Conversations as keyed state: in batch an ordered fold, in a stream the same step on arriving turns."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.questions import Company, Memory, parse, step

THIS_YEAR = 2026
COLUMNS = "conv_id long, turn long, intent string, metrics string, codes string, years string, periods string, missing string"


def _row(conv_id: int, turn: int, slots) -> tuple:
    joined = lambda xs: ",".join(map(str, xs))
    return conv_id, turn, slots.intent, joined(slots.metrics), joined(slots.codes), joined(slots.years), joined(slots.periods), slots.missing


def _fold(key: tuple, rows: pd.DataFrame, companies: tuple[Company, ...], this_year: int) -> pd.DataFrame:
    memory, out = Memory(), []
    for r in rows.sort_values("turn", kind="stable").itertuples():
        memory, slots = step(memory, parse(r.text or "", companies, this_year))
        out.append(_row(int(key[0]), int(r.turn), slots))
    return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def fold_sessions(turns: DataFrame, companies: tuple[Company, ...] = (), this_year: int = THIS_YEAR, role: str = "user") -> DataFrame:
    """Slots after each turn of a person, turns of a conversation in order; a null text says nothing, a null id is left out.

    Only turns of ``role`` are shuffled, by conversation; a conversation must fit one task, as one person's does.
    """
    said = turns.where((F.col("role") == role) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "text")
    return said.groupBy("conv_id").applyInPandas(partial(_fold, companies=companies, this_year=this_year), COLUMNS)


def stream_sessions(turns: DataFrame, companies: tuple[Company, ...] = (), this_year: int = THIS_YEAR) -> DataFrame:
    """The same fold over a stream of ``conv_id, turn, text``; memory is kept as state between batches."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = pickle.loads(state.get[0]) if state.exists else Memory()
        out = []
        for r in pd.concat(list(frames)).sort_values("turn", kind="stable").itertuples():
            memory, slots = step(memory, parse(r.text or "", companies, this_year))
            out.append(_row(int(key[0]), int(r.turn), slots))
        state.update((pickle.dumps(memory),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return turns.groupBy("conv_id").applyInPandasWithState(advance, COLUMNS, "memory binary", "append", "NoTimeout")


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and type with a watermark; an extension for monitoring progress events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
