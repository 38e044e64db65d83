"""From drifting text editions to one typed panel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from panelry import fixed
from panelry.frames import quote
from panelry.operators.dictionary import data_dictionary, series_schema
from panelry.operators.stack import stack_editions
from panelry.sources.tables import read_dictionary, write_dictionary


def prepare_panel(
    editions: Mapping[int, DataFrame],
    dictionary_path: str | None = None,
    common_only: bool = True,
    descriptions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Dictionary and panel of the editions.

    With ``dictionary_path`` the dictionary is written there and read back:
    later uses read the small table instead of profiling the editions again.
    """
    dictionary = data_dictionary(editions, common_only, descriptions)
    if dictionary_path is not None:
        spark = dictionary.sparkSession
        write_dictionary(dictionary, dictionary_path)
        dictionary = read_dictionary(spark, dictionary_path)
    plan = series_schema(dictionary)
    kept = {
        year: df.select(*[quote(c) for c in df.columns if c in plan or c == fixed.YEAR])
        for year, df in editions.items()
    }
    return dictionary, stack_editions(kept, plan)
