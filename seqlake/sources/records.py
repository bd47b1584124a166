"""Fetching records of a remote archive, through a pluggable client."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: fetch(id, start, stop) -> the record as flat-file text, or None.
Fetch = Callable[[str, int | None, int | None], str | None]


def fetch_records(ids: DataFrame, fetch: Fetch) -> DataFrame:
    """ids (id, seq_start, seq_stop) to (seqid, tax_id, description, seq); ids without a record are left out.

    Each task fetches its own rows. Without a network, pass a client that serves recorded responses.
    """
    from seqlake.sources.text_formats import flat_record

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, a, b in zip(f["id"], f["seq_start"], f["seq_stop"], strict=True):
                a, b = (None if pd.isna(x) or x == "" else int(x) for x in (a, b))
                text = fetch(i, a, b)
                if text:
                    r = flat_record(text)
                    refs = [v for x in r["features"] for q in x["qualifiers"].values() for v in q if "taxon" in v]
                    name = r["id"] if a is None else f"{r['id']}_{a}_{b}"
                    rows.append({"seqid": name, "tax_id": re.split(":", refs[0])[-1] if refs else None, "description": r["description"], "seq": r["seq"]})
            yield pd.DataFrame(rows, columns=["seqid", "tax_id", "description", "seq"])

    return ids.select("id", "seq_start", "seq_stop").mapInPandas(run, "seqid string, tax_id string, description string, seq string")
