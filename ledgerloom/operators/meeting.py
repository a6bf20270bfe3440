"""Candidate pairs matched and scored where their rows meet, in numpy.

A transaction is copied to the time blocks and the coarse steps of amounts that its
windows touch, a slip stays in one of each; that is their place.  Rows move there
once and are sorted by it, slips first.  There pairs arise by a common key and by
time, about PAIRS at a time, get the exact conditions and their signals, and only
those that count are written.  The signals equal the expressions of ``amount``,
``temporal`` and ``merchant`` to the last bit.

Where names must hold one another, the key is a name: transactions come with the
names of slips that theirs can go with, so the pairs of other firms never arise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import amount as A
from ..functions import likeness as L
from ..functions import merchant as M
from ..workspace import settle

#: Rows that are looked at together, about as many pairs, and fine cells to a step of amounts.
MEET, PAIRS, STEP = 50_000, 200_000, 8
#: low is a slip's cell and a transaction's first one; weight is the relative tolerance of a transaction, the boost of a slip;
#: code is a transaction's category code, or the bits of those that a slip's names corroborate.
_ROW = ("place", "slip", "scope", "id", "money", "at", "low", "high", "weight", "code", "name", "hint", "keys", "worth")
SIGNALS = "scope string, transaction_id string, slip_id string, amount_signal double, temporal_signal double, delta_sec double, merchant_signal double, mcc_signal double, confidence double"
_BOTH = "scope string, transaction_id string, slip_id string"


def _plain(name: str) -> Column:
    return M.normalise(F.coalesce(F.col(name), F.lit("")))


def _key(name: Column) -> Column:
    return F.xxhash64(name)


def matched_names(txn_names: DataFrame, slip_names: DataFrame) -> DataFrame:
    """(name, keys, worth): of each transaction's name the slips' names that hold it or are held by it, as keys, with their scores.

    The shorter name's first letters are looked up among the substrings of the longer one.
    """
    t, s = settle(txn_names.toDF("name").where("name <> ''").distinct()), settle(slip_names.toDF("other").where("other <> ''").distinct())

    def inside(df: DataFrame, c: str) -> DataFrame:
        of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda p: F.substr(F.col(c), p, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return df.select(c, F.explode(F.array_distinct(F.concat(of(1), of(2), of(5)))).alias("part"))

    start = lambda df, c: df.select(c, F.when(F.length(c) >= 5, F.substring(c, 1, 5)).when(F.length(c) >= 2, F.substring(c, 1, 2)).otherwise(F.col(c)).alias("part"))
    holds = inside(t, "name").join(start(s, "other"), "part").where(F.contains("name", "other")).select("name", "other")
    held = inside(s, "other").join(start(t, "name"), "part").where(F.contains("other", "name") & (F.col("name") != F.col("other"))).select("name", "other")
    worth = F.when((F.col("name") == F.col("other")) | ((F.length("name") >= 3) & (F.length("other") >= 3)), 1.0).otherwise(M.CONTAINED)
    both = F.collect_list(F.struct(_key(F.col("other")).alias("key"), worth.alias("worth")))
    found = holds.unionByName(held).groupBy("name").agg(both.alias("m"))
    return found.select("name", F.col("m.key").alias("keys"), F.col("m.worth").alias("worth"))


def _rows(txns: DataFrame, slips: DataFrame, cfg: MatchConfig, by_name: bool, named: bool) -> DataFrame:
    """Both sides in one shape, sorted by place."""
    length = cfg.max_lead_us + cfg.max_lag_us
    block = lambda micros: F.floor(micros / F.lit(length))
    step = lambda cell: F.floor(cell / F.lit(STEP))
    none = lambda kind: F.lit(None).cast(kind)
    t = txns.where("scope is not null and currency is not null and occurred_at is not null and amount_minor is not null").select("scope", "currency", "transaction_id", "mcc", F.col("amount_minor").cast("bigint").alias("money"), F.unix_micros("occurred_at").alias("at"), _plain("merchant").alias("name"))
    r = slips.where("scope is not null and currency is not null and issued_at is not null and total_minor is not null").select(
        "scope", "currency", "slip_id", "source", F.col("total_minor").cast("bigint").alias("money"), F.unix_micros("issued_at").alias("at"), _plain("supplier").alias("name"), _plain("raw_merchant_hint").alias("hint"),
        F.lower(F.concat(F.coalesce("supplier", F.lit("")), F.lit(" "), F.coalesce("raw_merchant_hint", F.lit("")))).alias("text"),
    )
    keys, worth = none("array<bigint>"), none("array<double>")
    if by_name:
        t, r = settle(t), settle(r)  # both are read again for their names
        each = r.select("name").unionByName(r.select(F.col("hint").alias("name")))
        t = t.join(matched_names(t.select("name"), each), "name")
        keys, worth = F.col("keys"), F.col("worth")
    codes = list(M.MCC_KEYWORDS)
    code, bits = F.lit(0), F.lit(0)
    for k, c in enumerate(codes):
        code = F.when(F.col("mcc") == c, k + 1).otherwise(code)
        hit = F.lit(False)
        for w in M.MCC_KEYWORDS[c]:
            hit = hit | F.contains("text", F.lit(w))
        bits = bits + F.when(hit, 2 << k).otherwise(0)
    boost = F.lit(1.0)
    for source, factor in cfg.source_boost:
        if factor > 0 and factor != 1:
            boost = F.when(F.col("source") == source, float(factor)).otherwise(boost)
    rel = A.loose_relative(F.col("mcc"), cfg).cast("double")
    low, high = A.amount_range(F.col("money"), rel, cfg)
    keep = lambda c: F.col(c) if named and not by_name else none("string")
    t = t.select("scope", "currency", "transaction_id", "money", "at", A.amount_cell(low, cfg).alias("low"), A.amount_cell(high, cfg).alias("high"), rel.alias("weight"), code.alias("code"), keep("name").alias("name"), keys.alias("keys"), worth.alias("worth"))
    t = t.withColumn("b", F.explode(F.sequence(block(F.col("at") - cfg.max_lead_us), block(F.col("at") + cfg.max_lag_us)))).withColumn("x", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    # cells outside the step are another place's
    t = t.select(F.xxhash64("scope", "currency", "b", "x"), F.lit(False), "scope", "transaction_id", "money", "at", F.greatest("low", F.col("x") * STEP).cast("int"), F.least("high", F.col("x") * STEP + (STEP - 1)).cast("int"), "weight", "code", "name", none("string"), "keys", "worth")
    r = r.withColumn("low", A.amount_cell(F.col("money"), cfg))
    own = F.when(F.col("hint") == F.col("name"), F.array(_key(F.col("name")))).otherwise(F.array(_key(F.col("name")), _key(F.col("hint")))) if by_name else none("array<bigint>")
    r = r.select(F.xxhash64("scope", "currency", block(F.col("at")).alias("b"), step(F.col("low")).alias("x")), F.lit(True), "scope", "slip_id", "money", "at", "low", "low", boost.alias("weight"), bits.alias("code"), keep("name").alias("name"), keep("hint").alias("hint"), own, none("array<double>"))
    return t.toDF(*_ROW).union(r.toDF(*_ROW)).repartition("place").sortWithinPartitions("place", F.desc("slip"))


def _side(rows: pa.Table, which: np.ndarray, names: bool) -> dict:
    rows = rows.filter(pa.array(which))
    side = {c: rows[c].to_numpy() for c in ("place", "money", "at", "low", "high", "weight", "code")}
    side |= {c: rows[c] for c in ("scope", "id")} | {"n": len(rows)}
    if names:
        for c in ("name", "hint"):
            coded = rows[c].combine_chunks().fill_null("").dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            side[c] = L.Names(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False)
    keys = rows["keys"].combine_chunks()
    side["keys"], side["of"] = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    side["worth"] = rows["worth"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return side


def _mixed(place: np.ndarray, part: np.ndarray) -> np.ndarray:
    key = place.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(32)) ^ part.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(31))


def _in_window(t: dict, s: dict, ti: np.ndarray, t_part: np.ndarray, si: np.ndarray, s_part: np.ndarray, cfg: MatchConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of t, rows of s, entries of ti) with one place and part whose times are in the window, about PAIRS at a time."""
    if not len(ti) or not len(si):
        return
    keys, number = np.unique(_mixed(s["place"][si], s_part), return_inverse=True)
    times, of_time = np.unique(s["at"][si], return_inverse=True)
    width = len(times) + 1
    at = number * width + of_time
    order = np.argsort(at)
    at, si = at[order], si[order]
    own = _mixed(t["place"][ti], t_part)
    found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    entry = np.flatnonzero(keys[found] == own)
    ti, found = ti[entry], found[entry] * width
    first = np.searchsorted(at, found + np.searchsorted(times, t["at"][ti] - cfg.max_lead_us))
    n = np.maximum(np.searchsorted(at, found + np.searchsorted(times, t["at"][ti] + cfg.max_lag_us, "right")) - first, 0)
    ti, entry, first, n = ti[n > 0], entry[n > 0], first[n > 0], n[n > 0]
    ends = np.cumsum(n)
    k = 0
    while k < len(n):
        base = ends[k] - n[k]
        to = max(k + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        part = n[k:to]
        yield np.repeat(ti[k:to], part), si[np.arange(ends[to - 1] - base) + np.repeat(first[k:to] - (ends[k:to] - part - base), part)], np.repeat(entry[k:to], part)
        k = to


def _ratio(diff: np.ndarray, larger: np.ndarray) -> np.ndarray:
    return diff / np.where(larger == 0, 1, larger)


def _near(a: np.ndarray, b: np.ndarray, rel: np.ndarray, cfg: MatchConfig) -> np.ndarray:
    """``within_tolerance`` and ``bucket_matches``."""
    diff, larger = np.abs(a - b), np.maximum(a, b)
    within = (diff <= cfg.loose_abs) | np.where(larger == 0, diff == 0, _ratio(diff, larger) <= rel)
    bucket = lambda x: np.abs(x) // cfg.bucket_minor * np.sign(x)
    moving = np.floor(np.abs(a * rel / cfg.bucket_minor)).astype(np.int64) * np.sign(a) + 1
    return within & (np.abs(bucket(a) - bucket(b)) <= np.maximum(cfg.loose_abs // cfg.bucket_minor + 1, moving))


def _decay(diff: np.ndarray, abs_tol: float, rel: float, larger: np.ndarray, depth: float) -> np.ndarray:
    most = np.maximum(float(abs_tol), rel * larger)
    return np.where(most == 0, 1.0, np.maximum(0.0, 1 - diff / np.where(most == 0, 1.0, most) * depth))


def amount_signal(a: np.ndarray, b: np.ndarray, cfg: MatchConfig) -> np.ndarray:
    """``amount_similarity`` of one currency."""
    bands = cfg.bands
    diff, larger = np.abs(a - b), np.maximum(a, b)
    ratio = _ratio(diff, larger)
    most = np.maximum(bands.partial_abs, (max(bands.partial_rel, bands.fuel_rel) * larger).astype(np.int64))
    partial = np.maximum(0.0, 1 - diff / np.maximum(most.astype(float), bands.partial_rel * larger) * 0.2)
    return np.select(
        [a == b, larger == 0, (b <= a) & ((diff <= bands.tip_abs) | (ratio <= bands.tip_rel)), (a >= b) & (diff <= most), diff <= bands.fx_rounding, (b > a) & (diff <= bands.cashback_abs), (diff <= cfg.abs_tolerance) | (ratio <= cfg.rel_tolerance)],
        [1.0, 1.0, _decay(diff, bands.tip_abs, bands.tip_rel, larger, 0.2), partial, 0.95, _decay(diff, bands.cashback_abs, 0.05, larger, 0.2), _decay(diff, cfg.abs_tolerance, cfg.rel_tolerance, larger, 0.25)],
        0.0,
    )


def _met(pairs: Callable[[dict, dict], Iterator[pa.RecordBatch]], names: bool):
    """Batches of rows that come sorted by place, slips first, and what ``pairs`` makes of both sides."""

    def of(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(waiting)
        slip = rows["slip"].to_numpy()
        if slip.any() and not slip.all():
            yield from pairs(_side(rows, ~slip, names), _side(rows, slip, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n < MEET:
                continue
            yield from of(waiting)
            # further rows can only meet the slips of the last place; they stay until its last transaction came
            rows = pa.Table.from_batches(waiting)
            waiting, n = rows.filter(pc.and_(pc.equal(rows["place"], rows["place"][-1]), rows["slip"])).to_batches(), 0
        if waiting:
            yield from of(waiting)

    return run


def _by_cell(t: dict, s: dict, cfg: MatchConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in the window, tolerance and bucket span."""
    n = (t["high"] - t["low"] + 1).astype(np.int64)
    ti = np.repeat(np.arange(t["n"]), n)
    cell = t["low"][ti] + np.arange(len(ti)) - np.repeat(np.cumsum(n) - n, n)
    for i, j, _ in _in_window(t, s, ti, cell, np.arange(s["n"]), s["low"], cfg):
        near = _near(t["money"][i], s["money"][j], t["weight"][i], cfg)
        yield i[near], j[near]


def _by_key(t: dict, s: dict, cfg: MatchConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs with a name in common besides, each once with its best score."""
    for i, j, entry in _in_window(t, s, t["of"], t["keys"], s["of"], s["keys"], cfg):
        near = (t["low"][i] <= s["low"][j]) & (s["low"][j] <= t["high"][i]) & _near(t["money"][i], s["money"][j], t["weight"][i], cfg)
        yield i[near], j[near], t["worth"][entry[near]]


def _first_two(i: np.ndarray, j: np.ndarray, sure: np.ndarray, t_rank: np.ndarray, s_rank: np.ndarray) -> np.ndarray:
    """Marks the rows that are among the two first of their transaction or of their slip, in the order of candidates."""
    order, keep = np.lexsort((s_rank[j], t_rank[i], -sure)), np.zeros(len(i), bool)
    for key in (i[order], j[order]):
        by = np.argsort(key, kind="stable")
        key = key[by]
        keep[order[by[np.append([True, True], key[2:] != key[:-2])[: len(key)]]]] = True
    return keep


def scored(txns: DataFrame, slips: DataFrame, cfg: MatchConfig, by_name: bool, least: float = 0.0, tops: bool = False) -> DataFrame:
    """Candidates above the merchant floor with confidence above 0 and of at least ``least``, with their signals.

    With ``tops`` only some of them, among which are the two first of every
    transaction and of every slip.
    """

    def pairs(t: dict, s: dict) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        ranks = [np.argsort(pc.sort_indices(side["id"]).to_numpy()) for side in (t, s)] if tops else ()

        def firsts() -> tuple:
            rows = tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
            keep = _first_two(rows[0], rows[1], rows[-1], *ranks)
            return tuple(x[keep] for x in rows)

        for rows in every(t, s):
            if tops:
                waiting.append(rows)
                waiting = [firsts()] if sum(len(x[0]) for x in waiting) > PAIRS else waiting
            else:
                yield from written(t, s, *rows)
        if waiting:
            yield from written(t, s, *firsts())

    def written(t: dict, s: dict, i: np.ndarray, j: np.ndarray, *signals: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _batches([t["scope"].take(i), t["id"].take(i), s["id"].take(j), *signals], SIGNALS)

    def every(t: dict, s: dict) -> Iterator[tuple]:
        if by_name:
            found = list(_by_key(t, s, cfg))
            i, j, worth = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((-worth, j, i))  # a slip may go with the transaction by both its names
            i, j, worth = i[order], j[order], worth[order]
            once = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
            pieces = [(i[once], j[once], worth[once])]
        else:
            pieces = ((i, j, None) for i, j in _by_cell(t, s, cfg))
        for i, j, merchant in pieces:
            gap = s["at"][j] - t["at"][i]
            amount = amount_signal(t["money"][i], s["money"][j], cfg)
            window = np.where(gap < 0, cfg.max_lead_us, cfg.max_lag_us)
            time = 1 - np.abs(gap) / window * cfg.temporal_decay
            code = t["code"][i]
            mcc = np.where(code == 0, M.MCC_NEUTRAL, np.where(s["code"][j] >> code & 1, 1.0, M.MCC_WEAK))
            base = cfg.weight_amount * amount + cfg.weight_temporal * time
            boost = s["weight"][j]
            if merchant is None:
                need = (least / boost - base - cfg.weight_mcc * mcc) / cfg.weight_merchant if cfg.weight_merchant > 0 else np.zeros(len(i))
                need = np.maximum(need, cfg.min_merchant) - 1e-9
                may = np.flatnonzero(need <= 1.0)
                i, j, gap, amount, time, mcc, base, boost, need = (x[may] for x in (i, j, gap, amount, time, mcc, base, boost, need))
                of = lambda c: L.scores(t["name"][0], s[c][0], t["name"][1][i], s[c][1][j], need)
                merchant = np.maximum(of("name"), of("hint"))
            total = base + cfg.weight_merchant * merchant + cfg.weight_mcc * mcc
            sure = np.minimum(1.0, total * boost)
            keep = (merchant >= cfg.min_merchant) & (sure > 0) & (sure >= least)
            if keep.any():
                i, j, gap, amount, time, merchant, mcc, sure = (x[keep] for x in (i, j, gap, amount, time, merchant, mcc, sure))
                yield i, j, amount, time, np.abs(gap) / 1e6, merchant, mcc, sure

    return _rows(txns, slips, cfg, by_name, True).mapInArrow(_met(pairs, not by_name), SIGNALS)


def _batches(columns: list, schema: str) -> Iterator[pa.RecordBatch]:
    return iter(pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")]).combine_chunks().to_batches())


def last_candidates(txns: DataFrame, slips: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(scope, transaction_id, slip_id): of each transaction's pairs, scored or not, the slip with the largest id."""

    def pairs(t: dict, s: dict) -> Iterator[pa.RecordBatch]:
        by_id = pc.sort_indices(s["id"]).to_numpy()
        rank = np.empty(s["n"], np.int64)
        rank[by_id] = np.arange(s["n"])
        best = np.full(t["n"], -1, np.int64)
        for i, j in _by_cell(t, s, cfg):
            np.maximum.at(best, i, rank[j])
        i = np.flatnonzero(best >= 0)
        if len(i):
            yield from _batches([t["scope"].take(i), t["id"].take(i), s["id"].take(by_id[best[i]])], _BOTH)

    met = _rows(txns, slips, cfg, False, False).mapInArrow(_met(pairs, False), _BOTH)
    return met.groupBy("scope", "transaction_id").agg(F.max("slip_id").alias("slip_id"))
