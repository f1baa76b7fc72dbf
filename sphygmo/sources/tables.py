"""Table functions from delimited text in a column to its layout and its samples, used laterally."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sphygmo.functions.layout import laid_out
from sphygmo.sources.datasource import LAYOUT, layout_row


def _lines(text: str | None):
    return lambda: io.StringIO(text or "", newline=None)


@udtf(returnType=LAYOUT)
class DelimitedLayout:
    """One row for a text: how it is laid out."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield tuple(layout_row(laid_out(_lines(text))).values())


@udtf(returnType="idx long, columns array<string>, v array<double>")
class DelimitedSamples:
    """The data lines of a text, without gaps, all columns; what an open gap needs is kept between lines."""

    def eval(self, text: str) -> Iterator[tuple]:
        found = laid_out(_lines(text))
        names = [c.name for c in found.columns]
        for k, row in enumerate(found.rows(_lines(text))):
            yield k, names, row


def layouts_of(texts: DataFrame) -> DataFrame:
    """(file_path, and the layout) of rows (file_path, text)."""
    return texts.select("file_path", "text").lateralJoin(DelimitedLayout(F.col("text").outer())).drop("text")


def samples_of(texts: DataFrame) -> DataFrame:
    """(file_path, idx, columns, v) of rows (file_path, text)."""
    return texts.select("file_path", "text").lateralJoin(DelimitedSamples(F.col("text").outer())).drop("text")
