"""Line scans with carried state, for rows that arrive over time: each document's open paragraph waits in the state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.strings import CLOSING_QUOTES, TERMINATORS, ends_with_any, is_bracketed, sentence_ends, strip


def _fold(rows: DataFrame, doc: str, pos: str, end: str | None, columns: dict[str, Column], output: str, state: str, step: Callable, close: Callable) -> DataFrame:
    """rows by document in order of position: step(held, row) gives finished rows and what is held; close(held) ends a document.

    Rows of one document must arrive in order of position from batch to batch, as the batch
    operators read them; within a batch they are sorted. A row whose end column is true ends
    its document; without such a column the last paragraph stays open. A row without a
    document is left out.
    """
    kind = rows.select(doc).dtypes[0][1]
    narrow = rows.select(F.col(doc).alias("doc"), F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(end), F.lit(False)).alias("end") if end else F.lit(False).alias("end"), *(c.alias(n) for n, c in columns.items())).where("doc IS NOT NULL")
    names = ["doc", *(c.split(" ")[0] for c in output.split(", "))]

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = group.get if group.exists else None
        some = list(batches)
        out = []
        for row in pd.concat(some).sort_values("pos", kind="stable").itertuples(index=False) if some else ():
            done, held = step(held, row)
            out += done
            if row.end:
                out += close(held)
                held = None
        if held is None:
            if group.exists:
                group.remove()
        else:
            group.update(held)
        yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    folded = narrow.groupBy("doc").applyInPandasWithState(run, f"doc {kind}, {output}", state, "append", GroupStateTimeout.NoTimeout)
    return folded.withColumnRenamed("doc", doc).withColumnRenamed("pos", pos)


def join_until_terminator(rows: DataFrame, is_heading: Column, end: str | None = None, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The stream form of sequence.join_until_terminator: doc, pos, is_heading, text, a joined line as soon as it ends."""
    trimmed = strip(F.col(text))

    def close(held: tuple | None) -> list[tuple]:
        return [] if held is None else [(held[0], False, held[1])]

    def step(held: tuple | None, row) -> tuple[list[tuple], tuple | None]:
        if row.head:
            return ([*close(held), (row.pos, True, row.t)], None) if row.t else ([], held)
        if not row.t:
            return [], held
        held = (row.pos, row.t) if held is None else (held[0], held[1] + row.t)
        return (close(held), None) if row.stop else ([], held)

    columns = {"t": F.coalesce(trimmed, F.lit("")), "head": F.coalesce(is_heading, F.lit(False)), "stop": F.coalesce(ends_with_any(trimmed, TERMINATORS), F.lit(False))}
    return _fold(rows, doc, pos, end, columns, "pos long, is_heading boolean, text string", "pos long, text string", step, close)


def reflow_groups(rows: DataFrame, sentences: int = 4, is_heading: Column | None = None, end: str | None = None, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The stream form of sequence.reflow_groups: doc, pos, text, group, a line as soon as its group is known.

    A row's group depends on the rows before it alone, so nothing waits: the state is the
    group's number, its count of sentence ends and whether it is closed.
    """
    head = F.coalesce(is_heading, F.lit(False)) if is_heading is not None else F.lit(False)
    trimmed = strip(F.col(text))

    def step(held: tuple | None, row) -> tuple[list[tuple], tuple | None]:
        group, count, closed = held or (0, 0, True)
        if not row.some:
            return [], held
        if closed or row.alone:
            group, count = group + 1, 0
        count += row.n
        return [(row.pos, row.x, group)], (group, count, bool(row.alone or count >= sentences or row.quote))

    columns = {
        "x": F.col(text),
        "some": F.coalesce(trimmed != "", F.lit(False)) | head,
        "alone": F.coalesce(head | is_bracketed(F.col(text)), F.lit(False)),
        "n": F.when(head, 0).otherwise(F.coalesce(sentence_ends(F.col(text)), F.lit(0))).cast("int"),
        "quote": F.coalesce(ends_with_any(trimmed, CLOSING_QUOTES), F.lit(False)),
    }
    return _fold(rows, doc, pos, end, columns, "pos long, text string, group int", "group int, count int, closed boolean", step, lambda held: [])
