"""Keyed-state variant of the customer velocity features.

All rows of a customer within one second share their velocity features, so both the state and the output hold one entry
per (customer, second): memory is bounded by the seconds of seven days, however many rows a busy customer has. Rows look
their features up by (customer_id, ts_epoch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens.config import DAY

SPANS = {"cnt_10m": 600, "cnt_1h": 3600, "cnt_6h": 21_600, "cnt_24h": DAY, "cnt_7d": 7 * DAY}
KEEP = 7 * DAY
OUTPUT = ("customer_id BIGINT, ts_epoch BIGINT, cnt_10m BIGINT, cnt_1h BIGINT, cnt_6h BIGINT, cnt_24h BIGINT, "
          "cnt_7d BIGINT, sum_1h DOUBLE, sum_24h DOUBLE, sum_7d DOUBLE, small_cnt_30m BIGINT, online_cnt_1h BIGINT, "
          "distinct_merchants_24h BIGINT")
STATE = "sec ARRAY<BIGINT>, n ARRAY<BIGINT>, amount ARRAY<DOUBLE>, small ARRAY<BIGINT>, online ARRAY<BIGINT>, shops ARRAY<STRING>"


NUMBERS = {"n": np.int64, "amount": np.float64, "small": np.int64, "online": np.int64}
COLUMNS = ["sec", *NUMBERS, "shops"]
Seconds = dict[str, np.ndarray]  # one entry per second for each of COLUMNS, in order of time


def _shops(merchants: pd.Series) -> np.ndarray:
    """Merchant ids as text; a batch with missing ids holds the others as floats, which must not change them."""
    known, place = np.unique(merchants.to_numpy(), return_inverse=True)
    names = [str(int(m)) if isinstance(m, float) and m == m else str(m) for m in known.tolist()]
    return np.array(names, object)[place]


def _summed(sec: np.ndarray, numbers: Seconds, shops: np.ndarray) -> Seconds:
    """One entry per second of entries in any order; the merchants of a second are joined by a unit separator."""
    order = np.argsort(sec, kind="stable")
    sec, shops = sec[order], shops[order]
    first = np.flatnonzero(np.concatenate([[True], sec[1:] != sec[:-1]]))
    out = {"sec": sec[first], **{c: np.add.reduceat(v[order], first) for c, v in numbers.items()}}
    joined, ends = shops[first], np.append(first[1:], len(sec))
    for i in np.flatnonzero(ends - first > 1):  # seconds with several entries
        joined[i] = "\x1f".join(sorted({m for x in shops[first[i]:ends[i]] for m in x.split("\x1f")}))
    return out | {"shops": joined}


def _seconds(rows: pd.DataFrame) -> Seconds | None:
    """Counts, amount and merchants of each second; rows without a time count nowhere."""
    rows = rows[rows.ts_epoch.notna()]
    if not len(rows):
        return None
    amount = rows.amount.to_numpy(float)
    numbers = {"n": np.ones(len(rows), np.int64), "amount": np.nan_to_num(amount, nan=0.0), "small": (amount < 5).astype(np.int64),
               "online": (rows.channel == "online").to_numpy(bool).astype(np.int64)}
    return _summed(rows.ts_epoch.to_numpy(np.int64), numbers, _shops(rows.merchant_id))


def _merged(a: Seconds, b: Seconds) -> Seconds:
    both = {c: np.concatenate([a[c], b[c]]) for c in COLUMNS}
    return _summed(both["sec"], {c: both[c] for c in NUMBERS}, both["shops"])


def _features(times: np.ndarray, past: Seconds) -> dict[str, np.ndarray]:
    """Velocity of each time over the strictly earlier seconds of ``past``."""
    sec = past["sec"]
    at = np.searchsorted(sec, times, side="left")

    def total(column: str, span: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(past[column])])
        return sums[at] - sums[np.searchsorted(sec, times - span, side="left")]

    out = {name: total("n", span) for name, span in SPANS.items()}
    for name, span in {"sum_1h": 3600, "sum_24h": DAY, "sum_7d": KEEP}.items():
        out[name] = np.round(total("amount", span), 6)
    out["small_cnt_30m"] = total("small", 1800)
    out["online_cnt_1h"] = total("online", 3600)
    # Distinct merchants of the last day: a visit counts from its second, or from the expiry of the merchant's
    # previous visit if that is later, until a day after it.
    split = [x.split("\x1f") for x in past["shops"]]
    _, shop = np.unique([m for x in split for m in x], return_inverse=True)
    when = np.repeat(sec, [len(x) for x in split])
    order = np.lexsort((when, shop))
    again = np.concatenate([[False], shop[order][1:] == shop[order][:-1]])
    visits = when[order]
    enter = np.where(again, np.maximum(visits, np.concatenate([[0], visits[:-1]]) + DAY), visits)
    out["distinct_merchants_24h"] = np.searchsorted(np.sort(enter), times, side="left") - np.searchsorted(np.sort(when), times - DAY, side="left")
    return out


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # seven quiet days: nothing left to count
        state.remove()
        return
    new = None
    for rows in batches:  # one Arrow batch at a time; only its seconds are kept
        seconds = _seconds(rows)
        new = _merged(new, seconds) if new and seconds else new or seconds
    if new is None:
        return
    past = new
    if state.exists:
        kinds = {"sec": np.int64, **NUMBERS, "shops": object}
        past = _merged({c: np.array(x, kinds[c]) for c, x in zip(COLUMNS, state.get)}, new)
    times = new["sec"]
    out = pd.DataFrame({"customer_id": key[0], "ts_epoch": times, **_features(times, past)})
    last, watermark = int(past["sec"][-1]), int(state.getCurrentWatermarkMs() // 1000)
    kept = past["sec"] >= last - KEEP
    state.update(tuple(past[c][kept].tolist() for c in COLUMNS))
    state.setTimeoutTimestamp(max(last + KEEP, watermark + 1) * 1000)
    yield out


def velocity_stream(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Velocity features per arriving (customer, second); rows later than ``lateness`` are dropped by the watermark."""
    ts = F.timestamp_seconds("ts_epoch").alias("ts")  # UTC, whatever the session's zone
    slim = stream.select("customer_id", "merchant_id", ts, "ts_epoch", "amount", "channel")
    return slim.withWatermark("ts", lateness).groupBy("customer_id").applyInPandasWithState(
        _update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
