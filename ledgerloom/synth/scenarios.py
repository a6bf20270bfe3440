"""Labelled matching scenarios, hand-written and generated.

Every frame has a ``scope`` column naming its scenario, so one matcher run covers
all of them without mixing their records.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TXN_DDL = "scope string, ordinal bigint, transaction_id string, source string, merchant string, mcc string, amount_minor bigint, currency string, occurred_at timestamp, occurred_offset_sec int, settled_at timestamp, external_ref string"
SLIP_DDL = "scope string, ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp, issued_offset_sec int, category string, transaction_ref string, n_lines int"
LABEL_DDL = "scope string, ordinal bigint, transaction_id string, slip_id string"
EXPECT_DDL = "scope string, side string, id string, outcome string, genuinely_ambiguous boolean"
BOUND_DDL = "scope string, transaction_id string, max_amount_diff bigint, max_lag_hours int"

BASE = datetime(2026, 3, 15, 14, 30, tzinfo=timezone.utc)
SPACING_HOURS = 37

# Merchants of the generated pairs (supplier, descriptor, category code).
COHORT = (
    ("Screwfix", "SCREWFIX 1234 LON", "5251"),
    ("Toolstation", "TOOLSTATION 882", "5251"),
    ("Amazon", "AMAZON UK MARKETPLACE", "5399"),
    ("Shell", "SHELL FUEL GB", "5541"),
    ("B&Q", "B AND Q 4421", "5251"),
    ("BP", "BP CONNECT 991", "5541"),
)


@dataclass
class Suite:
    transactions: DataFrame
    slips: DataFrame
    labels: DataFrame
    expectations: DataFrame
    bounds: DataFrame

    def union(self, other: Suite) -> Suite:
        return Suite(*[a.unionByName(b) for a, b in zip(self.frames(), other.frames(), strict=True)])

    def frames(self) -> tuple[DataFrame, ...]:
        return self.transactions, self.slips, self.labels, self.expectations, self.bounds


class _Draft:
    def __init__(self) -> None:
        self.t: list[tuple] = []
        self.r: list[tuple] = []
        self.labels: list[tuple] = []
        self.want: list[tuple] = []

    def txn(self, scope, tid, merchant, amount, minutes=0, mcc="", ref="", offset=0, settled=None):
        at = BASE + timedelta(minutes=minutes)
        self.t.append((scope, len(self.t), tid, "synthetic", merchant, mcc, amount, "GBP", at, offset, settled, ref))

    def rec(self, scope, rid, supplier, total, minutes=0, source="email", ref="", lines=0):
        at = BASE + timedelta(minutes=minutes)
        self.r.append((scope, len(self.r), rid, source, supplier, "", total, "GBP", at, 0, "", ref, lines))

    def pair(self, scope, tid, rid, label=True, want=None):
        if label:
            self.labels.append((scope, len(self.labels), tid, rid))
        if want:
            self.expect(scope, want, [tid], [rid])

    def expect(self, scope, outcome, tids, rids):
        self.want += [(scope, "transaction", i, outcome, outcome == "conflict") for i in tids]
        self.want += [(scope, "slip", i, outcome, outcome == "conflict") for i in rids]

    def suite(self, spark: SparkSession) -> Suite:
        return Suite(
            spark.createDataFrame(self.t, TXN_DDL), spark.createDataFrame(self.r, SLIP_DDL), spark.createDataFrame(self.labels, LABEL_DDL),
            spark.createDataFrame(self.want, EXPECT_DDL), spark.createDataFrame([], BOUND_DDL),
        )


@dataclass(frozen=True)
class Told:
    """What one side of a scenario tells: a transaction, or a slip."""

    name: str
    amount: int
    minutes: int = 0
    more: tuple[tuple[str, object], ...] = ()


def _told(name: str, amount: int, minutes: int = 0, **more) -> Told:
    return Told(name, amount, minutes, tuple(more.items()))


# Names of the scenarios and what each must come to; the codes are those that have keywords.
SCENARIOS: tuple[tuple[str, str, tuple[Told, ...], tuple[Told, ...]], ...] = (
    ("exact", "matched", (_told("BAKER ROW 12 YORK", 3170, mcc="5411"),), (_told("Baker Row", 3170, 95, lines=1),)),
    ("tip_adjusted", "", (_told("WICKES", 8460, mcc="5251"),), (_told("Wickes", 8450, -20),)),
    ("timezone_shift", "", (_told("AMAZON EU", 5120, mcc="5399", offset=-18_000),), (_told("Amazon", 5120, 30),)),
    ("near_duplicate", "", (_told("ESSO FUEL", 7350, mcc="5541"), _told("ESSO FUEL", 7350, 6, mcc="5541")), (_told("Esso", 7350), _told("Esso", 7350, 6))),
    ("settlement_delay", "", (_told("TOOLSTATION", 2980, mcc="5251", settled=BASE + timedelta(hours=70)),), (_told("Toolstation", 2980, 12),)),
    ("ambiguous", "conflict", (_told("BP FILLING", 4100, mcc="5541"),) * 2, (_told("BP", 4100),) * 2),
    ("exact_ref", "", (_told("SQ *KIOSK", 420, ref="till-7-118"),), (_told("Kiosk", 420, source="pos", ref="till-7-118"),)),
    ("duplicate_receipt", "conflict", (_told("AMAZON EU", 2750, mcc="5399"),), (_told("Amazon", 2750),) * 2),
    ("unmatched_txn", "unmatched", (_told("NOBODY KNOWS", 1840),), ()),
    ("unmatched_receipt", "unmatched", (), (_told("Far Away Goods", 2630),)),
    ("merchant_mangling", "matched", (_told("SUMUP*WICKES 77 LEEDS", 6110, mcc="5251"),), (_told("Wickes", 6110),)),
    ("partial_capture", "matched", (_told("TOOLSTATION", 10_000, mcc="5251"),), (_told("Toolstation", 9_950, 5),)),
    ("fuel_preauth", "matched", (_told("ESSO FUEL", 10_000, mcc="5541"),), (_told("Esso", 8_500, 10),)),
    ("split_tender_refusal", "unmatched", (_told("WICKES", 9_200, mcc="5251"),), (_told("Wickes", 4_600),)),
    ("refund_refusal", "unmatched", (_told("AMAZON EU", 3_300, mcc="5399"),), (_told("Amazon", -3_300),)),
)


def hand_written(spark: SparkSession, density: int = 10) -> Suite:
    """Sixteen small scenarios, each with the outcomes it must have; sides that are to meet are labelled in their order."""
    d = _Draft()
    for scope, want, txns, slips in SCENARIOS:
        t_ids = [f"{scope}-t{n}" for n in range(1, len(txns) + 1)]
        s_ids = [f"{scope}-s{n}" for n in range(1, len(slips) + 1)]
        for tid, t in zip(t_ids, txns, strict=True):
            d.txn(scope, tid, t.name, t.amount, t.minutes, **dict(t.more))
        for sid, s in zip(s_ids, slips, strict=True):
            d.rec(scope, sid, s.name, s.amount, s.minutes, **dict(s.more))
        if want != "unmatched":
            for tid, sid in zip(t_ids, s_ids, strict=False):
                d.pair(scope, tid, sid)
        if want:
            d.expect(scope, want, t_ids, s_ids)
    return d.suite(spark).union(identical_cluster(spark, density, "density_stress", "crowd", "WICKES 31 DEAL", "Wickes", "5251", 5000, 500))


def _at(hours):
    """BASE plus hours, as a Column; hours may be a Column."""
    return F.timestamp_micros(F.lit(int(BASE.timestamp() * 1_000_000)) + F.round(hours * 3_600_000_000).cast("bigint"))


def _frames(rows: DataFrame, scope: str, outcome: str, label: bool) -> Suite:
    """A suite from rows (i, tid, rid, merchant, supplier, mcc, amount, total, t_hours, r_hours, offset)."""
    text = lambda x: F.lit(x).cast("string")
    t = rows.select(
        text(scope).alias("scope"), F.col("i").alias("ordinal"), F.col("tid").alias("transaction_id"), text("synthetic").alias("source"), "merchant", "mcc", F.col("amount").cast("bigint").alias("amount_minor"),
        text("GBP").alias("currency"), _at(F.col("t_hours")).alias("occurred_at"), F.lit(0).alias("occurred_offset_sec"), F.lit(None).cast("timestamp").alias("settled_at"), text("").alias("external_ref"),
    )
    r = rows.select(
        text(scope).alias("scope"), F.col("i").alias("ordinal"), F.col("rid").alias("slip_id"), text("email").alias("source"), "supplier", text("").alias("raw_merchant_hint"), F.col("total").cast("bigint").alias("total_minor"),
        text("GBP").alias("currency"), _at(F.col("r_hours")).alias("issued_at"), F.lit(0).alias("issued_offset_sec"), text("").alias("category"), text("").alias("transaction_ref"), F.lit(0).alias("n_lines"),
    )
    labels = rows.where(F.lit(label)).select(text(scope).alias("scope"), F.col("i").alias("ordinal"), F.col("tid").alias("transaction_id"), F.col("rid").alias("slip_id"))
    unclear = F.lit(outcome == "conflict")
    want = rows.select(text(scope).alias("scope"), text("transaction").alias("side"), F.col("tid").alias("id"), text(outcome).alias("outcome"), unclear.alias("genuinely_ambiguous"))
    want = want.unionByName(rows.select(text(scope).alias("scope"), text("slip").alias("side"), F.col("rid").alias("id"), text(outcome).alias("outcome"), unclear.alias("genuinely_ambiguous")))
    return Suite(t, r, labels, want, rows.sparkSession.createDataFrame([], BOUND_DDL))


def identical_cluster(spark: SparkSession, n: int, scope: str, prefix: str, merchant: str, supplier: str, mcc: str, amount: int, hours: float) -> Suite:
    """n equal transactions and slips at one instant: nothing may be matched."""
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("i"), F.concat(F.lit(f"{prefix}-t-"), i).alias("tid"), F.concat(F.lit(f"{prefix}-r-"), i).alias("rid"), F.lit(merchant).alias("merchant"), F.lit(supplier).alias("supplier"),
        F.lit(mcc).alias("mcc"), F.lit(amount).alias("amount"), F.lit(amount).alias("total"), F.lit(float(hours)).alias("t_hours"), F.lit(float(hours)).alias("r_hours"),
    )
    return _frames(rows, scope, "conflict", True)


@dataclass(frozen=True)
class Noise:
    scope: str
    tip: int = 0
    fx: int = 0
    cashback: int = 0
    partial: float = 0.0
    lag_hours: int = 0
    shift_sec: int = 0
    prefix: str = ""
    suffix: str = ""
    first_merchant: int = 0


PROFILES = (
    Noise("generated_tip", tip=150),
    Noise("generated_settlement", lag_hours=48),
    Noise("generated_mangled", prefix="SQ *", suffix=" 77"),
    Noise("generated_fx", fx=1),
)


def generated_pairs(spark: SparkSession, n: int, noise: Noise, seed: int = 42) -> Suite:
    """n pairs that must match in spite of the claimed noise, one per 37 hours.

    Minutes of delay come from a hash of the row and the seed, so rows are made in
    parallel and alike at any partitioning.
    """
    i = F.col("id")
    which = ((i + noise.first_merchant) % len(COHORT)).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in COHORT]), which + 1)
    amount = F.lit(100_000) + i * 30_000
    total = amount - noise.tip + noise.cashback
    if noise.partial > 0:
        total = (amount * (1 - noise.partial)).cast("bigint")
    t_hours = i * float(SPACING_HOURS) + noise.shift_sec / 3600
    delay = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(60)) / 60.0
    rows = spark.range(max(n, 1)).select(
        i.alias("i"), F.concat(F.lit(f"{noise.scope}-"), i, F.lit("-t")).alias("tid"), F.concat(F.lit(f"{noise.scope}-"), i, F.lit("-r")).alias("rid"),
        F.concat(F.lit(noise.prefix), pick(1), F.lit(noise.suffix)).alias("merchant"), pick(0).alias("supplier"), pick(2).alias("mcc"),
        amount.alias("amount"), (total - noise.fx).alias("total"), t_hours.alias("t_hours"), (t_hours + noise.lag_hours + delay).alias("r_hours"),
    )
    made = _frames(rows, noise.scope, "matched", True)
    most = F.greatest(F.lit(noise.tip + noise.fx + noise.cashback).cast("bigint"), (F.col("amount") * noise.partial).cast("bigint"))
    made.bounds = rows.select(F.lit(noise.scope).alias("scope"), F.col("tid").alias("transaction_id"), most.alias("max_amount_diff"), F.lit(noise.lag_hours + 2).alias("max_lag_hours"))
    return made


def near_duplicates(spark: SparkSession, n: int) -> Suite:
    """Equal purchases five minutes apart: each must match its own slip."""
    i = F.col("id")
    at = F.lit(300.0) + i * 5 / 60.0
    rows = spark.range(n).select(
        i.alias("i"), F.concat(F.lit("g-nd-t-"), i).alias("tid"), F.concat(F.lit("g-nd-r-"), i).alias("rid"), F.lit("SHELL FUEL").alias("merchant"), F.lit("Shell").alias("supplier"),
        F.lit("5541").alias("mcc"), F.lit(8000).alias("amount"), F.lit(8000).alias("total"), at.alias("t_hours"), at.alias("r_hours"),
    )
    return _frames(rows, "generated_near_duplicate", "matched", True)


def refunds(spark: SparkSession, n: int) -> Suite:
    """Negative slips, which match nothing."""
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("i"), F.concat(F.lit("g-ref-t-"), i).alias("tid"), F.concat(F.lit("g-ref-r-"), i).alias("rid"), F.lit("AMAZON UK").alias("merchant"), F.lit("Amazon").alias("supplier"),
        F.lit("5399").alias("mcc"), F.lit(3000).alias("amount"), F.lit(-3000).alias("total"), F.lit(400.0).alias("t_hours"), F.lit(400.0).alias("r_hours"),
    )
    return _frames(rows, "generated_refund", "unmatched", False)


def generated_suite(spark: SparkSession, n: int, seed: int = 42) -> Suite:
    """About n pairs: four noise profiles, and small shares that must conflict, stay apart or be refused."""
    n = max(n, 20)
    unclear, close, back = max(int(n * 0.02), 4), max(int(n * 0.05), 4), max(int(n * 0.02), 2)
    rest = max(n - unclear - close - back, 4)
    suite = None
    for k, noise in enumerate(PROFILES):
        made = generated_pairs(spark, rest // 4 + (1 if k < rest % 4 else 0), noise, seed)
        suite = made if suite is None else suite.union(made)
    suite = suite.union(identical_cluster(spark, unclear, "generated_ambiguous", "g-amb", "BP CONNECT", "BP", "5541", 5000, 200))
    return suite.union(near_duplicates(spark, close)).union(refunds(spark, back))


def bounds_hold(suite: Suite, slack: int = 50) -> DataFrame:
    """(scope, holds): whether every labelled pair keeps within its claimed noise."""
    pairs = suite.labels.join(suite.transactions.select("scope", "transaction_id", "amount_minor", "currency", "occurred_at"), ["scope", "transaction_id"])
    pairs = pairs.join(suite.slips.select("scope", "slip_id", "total_minor", F.col("currency").alias("r_currency"), "issued_at"), ["scope", "slip_id"]).join(suite.bounds, ["scope", "transaction_id"], "left")
    close = (F.abs(F.col("amount_minor") - F.col("total_minor")) <= F.col("max_amount_diff") + slack) & (F.col("currency") == F.col("r_currency"))
    soon = F.abs(F.unix_micros("issued_at") - F.unix_micros("occurred_at")) <= F.col("max_lag_hours") * F.lit(3_600_000_000)
    return pairs.groupBy("scope").agg(F.bool_and(F.coalesce(close & soon, F.lit(False))).alias("holds"))
