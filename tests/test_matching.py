from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import GateThresholds, MatchConfig
from ledgerloom.functions import amount as A
from ledgerloom.functions import merchant as M
from ledgerloom.operators.assignment import greedy_one_to_one
from ledgerloom.operators.candidates import candidate_pairs, scored_candidates
from ledgerloom.plans.gate import run_gate
from ledgerloom.plans.matcher import match, outcomes
from ledgerloom.synth.scenarios import bounds_hold, generated_suite, hand_written

CFG = MatchConfig()


def test_config_hash():
    assert CFG.fingerprint() == "9b36c6504d7fb524be330b0ed4a0fcbdb2e19b4af898c768b16c7cc45c21a12e"


@pytest.mark.parametrize("a,b,score", [("screwfix1234lon", "screwfix", 0.9067), ("amazonukmarketplace", "amazon", 0.8632), ("shellfuelgb", "shell", 0.8909), ("bpconnect", "bp", 0.7926), ("bandq", "bq", 0.6100), ("same", "same", 1.0), ("", "x", 0.0)])
def test_jaro_winkler(a, b, score):
    assert M.jaro_winkler(a, b) == pytest.approx(score, abs=5e-5)


def test_amount_bands(spark):
    cases = [(5000, 4990, 0.997333), (10000, 8500, 0.80), (10000, 8100, 0.81), (10000, 10001, 0.95), (10000, 10300, 0.883495), (100000, 101500, 0.815271), (1000, 1600, 0.0), (0, 0, 1.0)]
    df = spark.createDataFrame(cases, "t bigint, r bigint, want double")
    g = F.lit("GBP")
    for r in df.select("want", A.amount_similarity(F.col("t"), F.col("r"), g, g, CFG).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-6)
    assert df.select(A.amount_similarity(F.col("t"), F.col("r"), g, F.lit("EUR"), CFG).alias("x")).where("x <> 0").count() == 0


def test_money_strings(spark):
    cases = {"12.99": 1299, "45": 4500, "0.01": 1, "-5.00": -500, "-12.99": -1299, "": None, "abc": None, ".5": 50, "5.": 500, "1,234.00": None, "+5": 500, " 7.1 ": 710, "1.239": 123, "-": None, ".": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.m for r in df.select("s", A.pounds_to_minor(F.col("s")).alias("m")).collect()} == cases


def test_hand_written_scenarios(spark):
    suite = hand_written(spark)
    run = run_gate(suite, CFG, GateThresholds(), repeats=1)
    got = {r.scope: (r.matched, r.conflicts, r.n_violation, r.passed) for r in run.per_scope.collect()}
    assert all(v[2] == 0 and v[3] for v in got.values()), got
    assert got["ambiguous"][:2] == (0, 4) and got["duplicate_receipt"][:2] == (0, 3) and got["density_stress"][:2] == (0, 20)
    assert run.deterministic


def test_golden_confidences(spark):
    suite = hand_written(spark)
    scored = {(r.scope, r.transaction_id, r.slip_id): r for r in scored_candidates(suite.transactions, suite.slips, CFG).collect()}
    for key, want in {("fuel_preauth", "fuel_preauth-t1", "fuel_preauth-s1"): 0.915920, ("partial_capture", "partial_capture-t1", "partial_capture-s1"): 0.997160, ("merchant_mangling", "merchant_mangling-t1", "merchant_mangling-s1"): 1.0, ("timezone_shift", "timezone_shift-t1", "timezone_shift-s1"): 0.999760, ("ambiguous", "ambiguous-t1", "ambiguous-s1"): 0.955}.items():
        assert scored[key].confidence == pytest.approx(want, abs=1e-6)


def test_bounds(spark):
    holds = {r.scope: r.holds for r in bounds_hold(generated_suite(spark, 100)).collect()}
    assert all(holds[f"generated_{k}"] for k in ("tip", "settlement", "mangled", "fx"))


def test_blocked_join_equals_plain_conditions(spark):
    base = datetime(2024, 3, 1)
    t = [("", i, f"t{i}", "m", "5541" if i % 3 == 0 else "", a, "GBP", base + timedelta(hours=h)) for i, (a, h) in enumerate([(100, 0), (4999, 1), (5000, 50), (10000, 100), (124000, 3), (-300, 2), (0, 0), (520, 47)])]
    r = [("", i, f"r{i}", "email", "m", "", a, "GBP", base + timedelta(hours=h)) for i, (a, h) in enumerate([(100, -48), (299, 168), (5100, 1), (5050, 40), (9700, 90), (100000, 5), (-250, 1), (0, 168), (720, 0), (12400, 100), (8200, 101)])]
    td = spark.createDataFrame(t, "scope string, ordinal bigint, transaction_id string, merchant string, mcc string, amount_minor bigint, currency string, occurred_at timestamp")
    rd = spark.createDataFrame(r, "scope string, ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp")
    got = {(x.transaction_id, x.slip_id) for x in candidate_pairs(td, rd, CFG).collect()}
    want = set()
    for x in t:
        for y in r:
            a, b, gap = x[5], y[6], (y[8] - x[7]).total_seconds() / 3600
            rel = 0.2 if x[4] == "5541" else 0.04
            d, big = abs(a - b), max(a, b)
            fits = d <= 200 or (d == 0 if big == 0 else d / big <= rel)
            if -48 <= gap <= 168 and fits and abs(int(a / 500) - int(b / 500)) <= max(1, int(a * rel / 500) + 1):
                want.add((x[2], y[2]))
    assert got == want


def test_greedy_equals_sequential_walk(spark):
    import random

    rng = random.Random(3)
    edges = [("", f"t{rng.randint(0, 15)}", f"r{rng.randint(0, 15)}", rng.choice([0.9, 0.91, 0.95])) for _ in range(120)]
    edges = list({e[1:3]: e for e in edges}.values())
    got = {(r.transaction_id, r.slip_id) for r in greedy_one_to_one(spark.createDataFrame(edges, "scope string, transaction_id string, slip_id string, confidence double")).collect()}
    used, want = set(), set()
    for _, t, r, _ in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if t not in used and r not in used:
            used |= {t, r}
            want.add((t, r))
    assert got == want


def test_empty_inputs(spark):
    suite = hand_written(spark)
    result = match(suite.transactions.limit(0), suite.slips.limit(0))
    assert result.matches.count() == 0 and result.conflicts.count() == 0
    assert outcomes(result, suite.transactions.limit(0), suite.slips.limit(0)).count() == 0


def test_greedy_follows_long_chains(spark):
    """A strict chain of preferences takes a round per link, more than any fixed number."""
    n = 140
    edges = [("", f"t{(i + 1) // 2:03}", f"r{i // 2:03}", 1 - i / 1000) for i in range(n)]
    got = {(r.transaction_id, r.slip_id) for r in greedy_one_to_one(spark.createDataFrame(edges, "scope string, transaction_id string, slip_id string, confidence double").coalesce(1)).collect()}
    assert got == {(t, r) for _, t, r, _ in edges[::2]}


def test_tolerance_query_filters_pairs(spark):
    """Of the blocked pairs some are within the tolerance and some are not."""
    from ledgerloom.plans import reference_queries as R

    d = "/root/testdata/sf0.001"
    pairs = [(r.transaction_id, r.slip_id, r.amount_minor, r.total_minor) for r in R._pairs(spark, d).collect()]
    want = sorted((t, s) for t, s, a, b in pairs if abs(a - b) <= 50 or (max(a, b) and abs(a - b) / max(a, b) <= 0.02))
    got = sorted((r.transaction_id, r.slip_id) for r in R.QUERIES["f6_within_tolerance_blocked"](spark, d).collect())
    assert got == want and 0 < len(got) < len(pairs)


def test_a_third_of_all_rows_at_one_price_and_refunds(spark):
    """Candidates of a hot price, of small amounts and of refunds equal those of a plain double loop."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 3, 1)
    amount = lambda: 499 if rng.random() < 0.34 else rng.choice([rng.randint(-3000, -1), rng.randint(0, 900), rng.randint(4000, 30_000)])
    t = [("", n, f"t{n}", "bank", "Shop", rng.choice(["5541", "5399", None]), amount(), "GBP", start + timedelta(hours=rng.randint(0, 700))) for n in range(150)]
    r = [("", n, f"s{n}", "email", "Shop", None, amount(), "GBP", start + timedelta(hours=rng.randint(0, 700))) for n in range(150)]
    td = spark.createDataFrame(t, "scope string, ordinal bigint, transaction_id string, source string, merchant string, mcc string, amount_minor bigint, currency string, occurred_at timestamp")
    rd = spark.createDataFrame(r, "scope string, ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp")
    got = sorted((x.transaction_id, x.slip_id) for x in candidate_pairs(td, rd, CFG).collect())
    want = []
    bucket = lambda x: (abs(x) // 500) * (1 if x > 0 else -1)
    for a in t:
        rel = 0.2 if a[5] == "5541" else 0.04
        span = max(1, int(abs(a[6] * rel / 500)) * (1 if a[6] > 0 else -1) + 1)
        for b in r:
            gap, diff, larger = b[8] - a[8], abs(a[6] - b[6]), max(a[6], b[6])
            near = diff <= 200 or (diff == 0 if larger == 0 else diff / larger <= rel)
            if timedelta(hours=-48) <= gap <= timedelta(hours=168) and near and abs(bucket(a[6]) - bucket(b[6])) <= span:
                want.append((a[2], b[2]))
    assert got == sorted(want) and len(want) > 1000


def test_greedy_takes_a_long_chain(spark):
    """A strict chain of preferences, longer than any number of rounds before a table is written."""
    n = 25
    edges = [("", f"t{k:03d}", f"s{k + d:03d}", 0.99 - (2 * k + d) * 0.001) for k in range(n) for d in (0, 1)]
    df = spark.createDataFrame(edges, "scope string, transaction_id string, slip_id string, confidence double")
    assert sorted((x.transaction_id, x.slip_id) for x in greedy_one_to_one(df).collect()) == [(f"t{k:03d}", f"s{k:03d}") for k in range(n)]
