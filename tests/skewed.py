"""A copy of the smallest tables in which a third of all rows share one key, hour and value."""

import shutil
from pathlib import Path

import pandas as pd


def skewed_copy(source: str, target: str) -> str:
    for file in Path(source).glob("*.parquet"):
        shutil.copyfile(file, Path(target) / file.name)
    events = pd.read_parquet(f"{source}/events.parquet")
    hot = events.index % 3 == 0
    events.loc[hot, "user_id"] = 1
    events.loc[hot, "event_type"] = "error"
    events.loc[hot, "value"] = 42.5
    events.loc[hot, "ts"] = pd.Timestamp("2024-01-15 10:00:00") + pd.to_timedelta(events.loc[hot, "event_id"] % 1800, unit="s")
    events.to_parquet(f"{target}/events.parquet", coerce_timestamps="us")
    items = pd.read_parquet(f"{source}/lineitem.parquet")
    hot = items.index % 3 == 0
    items.loc[hot, ["l_orderkey", "l_partkey"]] = 7
    items.loc[hot, "l_quantity"] = 20.0
    items.loc[hot, "l_extendedprice"] = 1000.0
    items.to_parquet(f"{target}/lineitem.parquet", coerce_timestamps="us")
    return target
