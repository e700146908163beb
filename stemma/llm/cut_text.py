"""Texts without given byte spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import NARROW, slices, texts_of
from .suffix_dedup import without


def without_spans(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """rows with the byte spans (array of (start, end), sorted by start) cut out of the text; the spans' column goes.

    A character that a span cuts through goes as a whole. A null text stays null; null spans count as none.
    """
    names = [c for c in rows.columns if c not in (text, spans)]
    schema = rows.select(text, *names).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, NARROW):
                buf, off = texts_of(part.column(0))
                data = buf.tobytes()
                cuts = part.column(1).to_pylist()
                kept = [without(data[off[i] : off[i + 1]], s)[0].decode(errors="ignore") if s else data[off[i] : off[i + 1]].decode() for i, s in enumerate(cuts)]
                null = part.column(0).is_null()
                new = pa.compute.if_else(null, pa.scalar(None, pa.string()), pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays([new, *part.columns[2:]], names=[text, *names])

    order = rows.select(text, F.col(spans), *names)
    return order.mapInArrow(run, schema).select(*[c for c in rows.columns if c != spans])
