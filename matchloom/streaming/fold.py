"""Running summaries over a stream of notes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.operators.patients import LOOKBACK_DAYS


def stream_summaries(notes: DataFrame, step: Callable[[str, str, list[str]], str], lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """patient_id, last_note_date, summary after each micro-batch in which a patient has notes.

    ``notes`` streams patient_id, note_date (date) and note_text; ``step(summary, date, texts)`` gives the next summary. A
    patient's notes of a batch go in by date, then text. Notes older than the last date by more than ``lookback`` days are
    too late and are left out, as in the batch filter.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, summary = state.get if state.exists else ("", "")
        rows = pd.concat(list(batches))
        rows = rows[rows["note_text"].notna() & rows["note_date"].notna()].assign(day=lambda x: pd.to_datetime(x["note_date"]).dt.strftime("%Y-%m-%d"))
        if last:
            edge = (pd.Timestamp(last) - pd.Timedelta(days=lookback)).strftime("%Y-%m-%d")
            rows = rows[rows["day"] > edge]
        for day, group in rows.sort_values(["day", "note_text"]).groupby("day", sort=True):
            summary, last = step(summary, day, group["note_text"].tolist()), max(last, day)
        state.update((last, summary))
        yield pd.DataFrame({"patient_id": [key[0]], "last_note_date": [last], "summary": [summary]})

    out = "patient_id string, last_note_date string, summary string"
    return notes.groupBy("patient_id").applyInPandasWithState(fold, out, "last string, summary string", "update", GroupStateTimeout.NoTimeout)
