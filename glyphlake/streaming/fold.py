"""State carried from page to page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = "doc_id long, page date, used int, fresh int, evicted int, size int"


def step(carried: set[str], page: set[str]) -> tuple[set[str], tuple[int, int, int, int]]:
    """The dictionary after a page: what the page uses of it, and what it brings."""
    used, fresh = carried & page, page - carried
    return used | fresh, (len(used), len(fresh), len(carried - page), len(used | fresh))


def carried_dictionary(rows: DataFrame) -> DataFrame:
    """Pages of each document in order (doc_id, page, symbol): entries used, new, evicted and left after each."""
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        carried: set[str] = set()
        out = []
        for doc, page, symbols in group.sort_values("page")[["doc_id", "page", "symbols"]].itertuples(index=False):
            carried, counts = step(carried, set(symbols))
            out.append((doc, page, *counts))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLD.split(", ")])

    return pages.groupBy("doc_id").applyInPandas(fold, FOLD)


def carried_dictionary_stream(pages: DataFrame) -> DataFrame:
    """The same over a stream of whole pages (doc_id, page, symbols) that arrive in order within a document; the dictionary is group state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried = set(state.get[0]) if state.exists else set()
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("page")
        for page, symbols in rows[["page", "symbols"]].itertuples(index=False):
            carried, counts = step(carried, set(symbols))
            out.append((key[0], page, *counts))
        state.update((sorted(carried),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLD.split(", ")])

    return pages.groupBy("doc_id").applyInPandasWithState(advance, FOLD, "entries array<string>", "append", GroupStateTimeout.NoTimeout)
