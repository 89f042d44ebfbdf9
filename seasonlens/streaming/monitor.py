"""In-season monitor: soil water and running WRSI per pixel, one dekad at a time, with an alert
row whenever the performance class changes."""
from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seasonlens.config import SOIL, CropParams, SoilConfig
from seasonlens.functions.climate import crop_coefficient
from seasonlens.functions.dekads import dekad_start

OUT = ("px_id long, year int, gd int, sw double, wrsi double, wrsi_class int, previous_class int, "
       "alert int, late int, gap int")
STATE = "gd int, sw double, aet double, wr double, wclass int"


CLASS_FROM = (50.0, 60.0, 80.0, 95.0)


def _class(w: float) -> int:
    return 1 + bisect_right(CLASS_FROM, w)


class BucketProcessor(StatefulProcessor):
    """Keeps (last dekad, soil water, cumulative AET and WR, class) per pixel and season, and forgets a season
    after its last dekad.

    Dekads must arrive in order across batches; one at or before the stored dekad cannot be inserted
    into the recurrence and is reported with ``late = 1``.  A dekad that does not follow the stored one
    (or, as the first, the season's first) is reported with ``gap = 1`` and masks the rest of the season, as
    a masked dekad does: an incomplete season has no index.
    """

    def __init__(self, first_gd: int, last_gd: int, init_frac: float):
        self._first, self._last, self._frac = first_gd, last_gd, init_frac

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        px, year = key
        known = self._state.exists()
        last, sw, aet, wr, cls = self._state.get() if known else (self._first - 1, None, 0.0, 0.0, 0)
        out = []
        # at most one row per dekad of one season
        for r in pd.concat(list(rows)).sort_values("gd").itertuples():
            if r.gd <= last:
                out.append((px, year, r.gd, None, None, cls, cls, 0, 1, 0))
                continue
            gap, last = int(r.gd != last + 1), r.gd
            sw = r.whc_mm * self._frac if sw is None else sw
            if gap or math.isnan(r.p + r.wr + r.whc_mm):
                sw = aet = wr = math.nan
            else:
                got = min(sw + r.p, r.wr)
                sw = max(min(sw + r.p - got, r.whc_mm), 0.0)
                aet, wr = aet + got, wr + r.wr
            if wr <= 0:
                continue
            wrsi = aet / max(wr, 1e-6) * 100
            if math.isnan(wrsi):  # a masked dekad masks the rest of the season
                out.append((px, year, r.gd, None, None, None, cls, 0, 0, gap))
                continue
            new = _class(wrsi)
            out.append((px, year, r.gd, sw, wrsi, new, cls, int(new != cls), 0, 0))
            cls = new
        if last >= self._last:
            self._state.clear()
        elif sw is not None:
            self._state.update((int(last), float(sw), float(aet), float(wr), int(cls)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def season_demand(rows: DataFrame, p: CropParams, soil: SoilConfig = SOIL) -> DataFrame:
    """px_id, year, gd, p, wr, whc_mm from px_id, year, gd, p, et0, planting and, where the soil is known,
    whc_mm (works on a stream)."""
    whc = F.col("whc_mm") if "whc_mm" in rows.columns else F.lit(soil.default_whc_mm)
    return rows.select("px_id", "year", "gd", "p", whc.cast("double").alias("whc_mm"),
                       (crop_coefficient(F.col("gd") - F.col("planting"), p) * F.col("et0")).alias("wr"))


def monitor(rows: DataFrame, p: CropParams, span: tuple[int, int], soil: SoilConfig = SOIL) -> DataFrame:
    """Stateful stream of dekad results over the season's dekads ``span``.  Needs the RocksDB state store
    provider.  The state is one row per pixel and open season."""
    rows = rows.filter(F.col("gd").between(*span))
    return season_demand(rows, p, soil).groupBy("px_id", "year").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(*span, soil.init_frac),
        outputStructType=OUT, outputMode="Append", timeMode="None")


# ---- dekads in any order ------------------------------------------------------------------------
REVISED = OUT.replace(", late int, gap int", ", version int, gap int")
BLOCK = 256  # pixels of consecutive ids whose seasons of one year are folded together
HELD = np.dtype([("px", "<i8"), ("p", "<f8"), ("wr_in", "<f8"), ("whc", "<f8"), ("sw", "<f8"), ("aet", "<f8"), ("wr", "<f8"),
                 ("wclass", "<i4"), ("version", "<i4"), ("here", "?"), ("reached", "?")])
INPUT = {"p": "p", "wr_in": "wr", "whc": "whc_mm"}


def season_end(year: int, last_gd: int) -> dt.datetime:
    """Start of the dekad after the season's last."""
    k = last_gd
    month = k // 3
    return dt.datetime(year + month // 12, month % 12 + 1, (1, 11, 21)[k % 3], tzinfo=dt.timezone.utc)


class ReplayProcessor(StatefulProcessor):
    """The same recurrence for dekads in any order, over a block of pixels at once: the state holds, by dekad, the inputs of the
    block's pixels and, once reached, a snapshot behind each.

    A late or corrected dekad folds its pixel again from the snapshot before it, and every dekad it changes is put out anew with a
    higher ``version``; dekads beyond a missing one wait.  A timer at the season's end, on event time, puts
    what still waits out as masked (the first of them with ``gap = 1``) and forgets the season: what the watermark
    lets in by then counts, in whatever order it came.  Of several rows of one dekad in one batch the last counts.
    """

    def __init__(self, first_gd: int, last_gd: int, init_frac: float):
        self._first, self._last, self._frac = first_gd, last_gd, init_frac

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._dekads = handle.getMapState("dekads", "gd int", "pixels binary")

    def _held(self, more: np.ndarray) -> tuple[np.ndarray, bool]:
        """(dekads x pixels that are held or in ``more``; whether any were held)."""
        held = {k[0] - self._first: np.frombuffer(v[0], HELD) for k, v in self._dekads.iterator()}
        px = np.unique(np.concatenate([more, *(h["px"] for h in held.values())]))
        table = np.zeros((self._last - self._first + 1, len(px)), HELD)
        table["px"] = px
        for g, h in held.items():
            table[g, np.searchsorted(px, h["px"])] = h
        return table, bool(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, year = key
        new = pd.concat(list(rows)).drop_duplicates(["px_id", "gd"], keep="last")
        px, g = new["px_id"].to_numpy(np.int64), new["gd"].to_numpy(np.int64) - self._first
        held, known = self._held(px)
        if not known:
            self._handle.registerTimer(int(season_end(int(year), self._last).timestamp() * 1000))
        i = np.searchsorted(held["px"][0], px)
        old, given = held[g, i], {c: new[name].to_numpy(np.float64) for c, name in INPUT.items()}
        same = old["here"].copy()
        for c, v in given.items():
            same &= (old[c] == v) | np.isnan(old[c]) & np.isnan(v)
        g, i = g[~same], i[~same]
        for c, v in given.items():
            held[c][g, i] = v[~same]
        held["here"][g, i] = True
        changed = np.zeros(held.shape, bool)
        changed[g, i] = True
        start = np.where(changed.any(axis=0), changed.argmax(axis=0), len(held))
        out, go = [], np.zeros(held.shape[1], bool)
        for k in range(start.min(initial=len(held)), len(held)):
            first = (start == k) & (held["reached"][k - 1] if k else True)
            go = (go | first) & held["here"][k]
            if go.any():
                out.append(self._step(year, k, held, np.flatnonzero(go)))
            changed[k] |= go
        for k in np.flatnonzero(changed.any(axis=1)):
            self._dekads.updateValue((int(k) + self._first,), (held[k][held["here"][k]].tobytes(),))
        yield pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in REVISED.split(", ")})

    def _step(self, year: int, k: int, held: np.ndarray, i: np.ndarray) -> pd.DataFrame:
        """One dekad of the pixels at ``i``: its snapshots, and its rows."""
        row = held[k, i]
        p, need, whc = row["p"], row["wr_in"], row["whc"]
        zero = np.zeros(len(i))
        sw, aet, wr, cls = (held[c][k - 1, i] for c in ("sw", "aet", "wr", "wclass")) if k else (whc * self._frac, zero, zero, zero.astype(np.int32))
        mask = np.isnan(p + need + whc)
        got = np.minimum(sw + p, need)
        sw, aet, wr = (np.where(mask, np.nan, v) for v in (np.maximum(np.minimum(sw + p - got, whc), 0.0), aet + got, wr + need))
        shown = ~(wr <= 0)
        wrsi = aet / np.maximum(wr, 1e-6) * 100
        known = shown & ~np.isnan(wrsi)
        new = np.where(known, np.searchsorted(CLASS_FROM, wrsi, side="right") + 1, cls)
        version = row["version"] + shown
        for c, v in (("sw", sw), ("aet", aet), ("wr", wr), ("wclass", new), ("version", version), ("reached", True)):
            held[c][k, i] = v
        at = lambda v: v[shown]
        return pd.DataFrame({
            "px_id": at(row["px"]), "year": year, "gd": k + self._first, "sw": at(np.where(known, sw, np.nan)), "wrsi": at(wrsi),
            "wrsi_class": pd.array(at(new), "Int32"), "previous_class": at(cls), "alert": at(known & (new != cls)).astype(np.int32),
            "version": at(version), "gap": 0}).assign(wrsi_class=lambda d: d["wrsi_class"].where(at(known)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, year = key
        held, _ = self._held(np.zeros(0, np.int64))
        waiting = held["here"] & ~held["reached"]
        g, i = np.nonzero(waiting)
        self._dekads.clear()
        none = np.full(len(g), np.nan)
        yield pd.DataFrame({
            "px_id": held["px"][g, i], "year": year, "gd": g + self._first, "sw": none, "wrsi": none, "wrsi_class": pd.array([None] * len(g), "Int32"),
            "previous_class": 0, "alert": 0, "version": held["version"][g, i] + 1, "gap": (g == waiting.argmax(axis=0)[i]).astype(np.int32)})

    def close(self) -> None:
        pass


def monitor_any_order(rows: DataFrame, p: CropParams, span: tuple[int, int], lateness: str, soil: SoilConfig = SOIL) -> DataFrame:
    """``monitor`` for dekads that arrive in any order within ``lateness`` of event time (the dekads' own dates).  Read the
    result with ``newest``.  The state of a season is one row per dekad and ``BLOCK`` of pixel ids, at most the span's, until its end; a
    batch makes a call per block and year, and reads and writes a state row per dekad it changes, however many pixels the block has.
    Pixels need an id."""
    rows = rows.filter(F.col("gd").between(*span))
    at = dekad_start(F.col("year"), F.col("gd")).cast("timestamp")
    need = season_demand(rows, p, soil).withColumn("ts", at).withWatermark("ts", lateness)
    return need.withColumn("block", F.floor(F.col("px_id") / BLOCK)).groupBy("block", "year").transformWithStateInPandas(
        statefulProcessor=ReplayProcessor(*span, soil.init_frac), outputStructType=REVISED, outputMode="Append", timeMode="EventTime")


def newest(rows: DataFrame) -> DataFrame:
    """The last version of each dekad."""
    rest = [c for c in rows.columns if c not in ("px_id", "year", "gd")]
    return rows.groupBy("px_id", "year", "gd").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("px_id", "year", "gd", "_r.*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
