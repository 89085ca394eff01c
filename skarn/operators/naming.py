"""Freely typed names to the ids of a fixed reference list, without a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.lexicon import Lexicon
from skarn.session import ship_package


def lexicon_of(refs: DataFrame, ref_id: str, name: str, aliases: str, uses: DataFrame | None = None) -> Lexicon:
    """The index over a reference list (id, name, aliases). The list is fixed and small: over Lexicon.MOST_NAMES names is an error.

    uses (id, uses): how often each entry is used exactly; it ranks entries that are equally near.
    """
    rows = refs.select(ref_id, name, aliases).limit(Lexicon.MOST_NAMES + 1).collect()
    counts = {} if uses is None else {r[0]: r[1] for r in uses.limit(Lexicon.MOST_NAMES).collect()}
    return Lexicon([(r[0], [x for x in (r[1], *(r[2] or [])) if x]) for r in rows if r[0] is not None], counts)


def lookup(df: DataFrame, text: Column, lexicon: Lexicon) -> Column:
    """struct<ref_id int, distance double> of the entry meant by text: -1 if none, null for a null text."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def find(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = [(None, None) if t is None else known.find(t) for t in texts]
        return pd.DataFrame({"ref_id": pd.array([x[0] for x in out], dtype="Int32"), "distance": pd.array([x[1] for x in out], dtype="Float64")})

    return F.pandas_udf(find, "struct<ref_id int, distance double>")(text)
