"""Candidates that are matched and scored where their rows meet."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.config import MatchConfig
from ledgerloom.functions import likeness as L
from ledgerloom.functions import merchant as M
from ledgerloom.operators import assignment as AS
from ledgerloom.operators import candidates as CA
from ledgerloom.operators import meeting
from ledgerloom.plans import matcher

CFG = MatchConfig()
_T = "scope string, ordinal bigint, transaction_id string, source string, merchant string, mcc string, amount_minor bigint, currency string, occurred_at timestamp"
_R = "scope string, ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp"


def _tables(spark, n=160, names=("SQ *Screwfix 12", "Screw", "Amazon UK", "bp", "BP Connect", "q", None, "", "Café 9", "x" * 70, "Shell Fuel")):
    rng, start = random.Random(5), datetime(2024, 3, 1)
    amount = lambda: 499 if rng.random() < 0.3 else rng.choice([rng.randint(-3000, -1), rng.randint(0, 900), rng.randint(4000, 9_000)])
    at = lambda: None if rng.random() < 0.03 else start + timedelta(minutes=rng.randint(0, 40_000))
    t = [("", k, f"t{k}", "bank", rng.choice(names), rng.choice(["5541", "5399", "9", None]), amount(), rng.choice(["GBP", "GBP", None]), at()) for k in range(n)]
    r = [("", k, f"s{k}", rng.choice(["email", "ocr"]), rng.choice(names), rng.choice(names), amount(), "GBP", at()) for k in range(n)]
    return spark.createDataFrame(t, _T), spark.createDataFrame(r, _R)


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that is written."""
    rows, settle = [], workspace.settle

    def counted(df, instead_of=None):
        done = settle(df, instead_of)
        rows.append(done.count())
        return done

    for module in (AS, M, matcher, meeting):
        monkeypatch.setattr(module, "settle", counted)
    return rows


def _one_price(spark, other, firms=60, hours=0):
    """60 transactions of so many firms and 60 slips of one price, so many hours later."""
    at = datetime(2024, 3, 1)
    name = lambda k: f"{chr(97 + k % firms // 26)}{chr(97 + k % firms % 26)}"
    t = [("", k, f"t{k:02}", "bank", f"{name(k)}firm", None, 499, "GBP", at) for k in range(60)]
    r = [("", k, f"s{k:02}", "email", f"{name(k)}{other}", None, 499, "GBP", at + timedelta(hours=hours)) for k in range(60)]
    return spark.createDataFrame(t, _T), spark.createDataFrame(r, _R)


def test_signals_equal_the_expressions(spark):
    """F2, h4_signal_map: to the last bit, for both resolvers; a resolver of another name still takes the way of expressions."""
    t, r = _tables(spark)
    for resolver in (M.containment_resolver, M.default_resolver):
        def plain(d, s, h, resolver=resolver):
            return resolver(d, s, h)

        plain.normalised = True
        rows = lambda f: sorted(map(tuple, CA.scored_candidates(t, r, CFG, f).select(*[c.split()[0] for c in meeting.SIGNALS.split(", ")]).collect()))
        got = rows(resolver)
        assert got == rows(plain) and len(got) > 100
        strong = CA.scored_candidates(t, r, CFG, resolver, 0.82).select("transaction_id", "slip_id").collect()
        assert sorted(map(tuple, strong)) == sorted(x[1:3] for x in got if x[-1] >= 0.82) and strong


def test_pairs_of_other_firms_are_not_written(spark, written):
    """the names are matched first, once each."""
    t, r = _one_price(spark, "firm")
    assert CA.scored_candidates(t, r, CFG, M.containment_resolver).count() == 60
    assert AS.conflicting(CA.scored_candidates(t, r, CFG, M.containment_resolver), CFG).count() == 0
    assert max(written) == 60


def test_conflicts_are_found_without_assignment(spark, monkeypatch):
    """F6, a3_conflict_rows."""
    t, r = _one_price(spark, "firm", 50)
    s = CA.scored_candidates(t, r, CFG, M.containment_resolver)
    monkeypatch.setattr(AS, "greedy_one_to_one", None)
    assert AS.conflicting(s, CFG).count() == 40


def test_match_keeps_strong_candidates_only(spark, written):
    """F7, e8_match_default: weak candidates of names alike are scored but not written, and conflicts not listed."""
    t, r = _one_price(spark, "form", hours=160)  # so late that only names much alike reach the least confidence
    m = matcher.match(t, r)
    strong = CA.scored_candidates(t, r, CFG).where("confidence >= 0.82").count()
    assert 0 < strong < CA.scored_candidates(t, r, CFG).count()
    assert m.matches.count() <= 60 and max(written) <= strong


@pytest.mark.parametrize("many", [50_000, 7])
def test_tops_hold_the_two_first(spark, monkeypatch, many):
    """ties included, of every transaction and slip."""
    t, r = _tables(spark)
    t, r = t.withColumn("amount_minor", F.col("amount_minor") % 3 + 500), r.withColumn("issued_at", F.lit(datetime(2024, 3, 20)))
    every = sorted((-x.confidence, x.transaction_id, x.slip_id) for x in CA.scored_candidates(t, r, CFG, M.default_resolver, 0.7).collect())
    monkeypatch.setattr(meeting, "PAIRS", many)
    tops = {(x.transaction_id, x.slip_id) for x in CA.scored_candidates(t, r, CFG, M.default_resolver, 0.7, tops=True).collect()}
    for side in (1, 2):
        seen = {}
        for e in every:
            seen.setdefault(e[side], []).append(e[1:])
        assert all(set(x[:2]) <= tops for x in seen.values())
    assert tops <= {x[1:] for x in every} and len(tops) < len(every)


def test_unmatched_needs_no_list_of_conflicts(spark, monkeypatch):
    """F5, j10_unmatched."""
    t, r = _one_price(spark, "firm", 50)
    r = r.where("ordinal < 40 or ordinal >= 50")
    whole = matcher.match(t, r, CFG, M.containment_resolver)
    aside = {x.id for x in whole.conflicts.where("side = 'transaction'").collect()} | {x.transaction_id for x in whole.matches.collect()}
    monkeypatch.setattr(matcher, "conflict_rows", None)
    left = {x.transaction_id for x in matcher.match(t, r, CFG, M.containment_resolver).unmatched_transactions.collect()}
    assert left == {x.transaction_id for x in t.collect()} - aside == {f"t{k}" for k in range(40, 50)}


@pytest.mark.parametrize("many", [50_000, 7])
def test_last_candidates_equal_the_pairs(spark, monkeypatch, many):
    """F4 and F8, a5_match_metrics and j5_label_join: the largest slip of each transaction, without a table of pairs."""
    t, r = _tables(spark)
    want = sorted(map(tuple, CA.candidate_pairs(t, r, CFG).groupBy("transaction_id").agg(F.max("slip_id")).collect()))
    monkeypatch.setattr(meeting, "PAIRS", many)
    got = sorted(map(tuple, meeting.last_candidates(t, r, CFG).select("transaction_id", "slip_id").collect()))
    assert got == want and len(got) > 50


def test_scores_equal_the_scalar_ones():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd12") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 64, 65, 80])))
    a = [word() for _ in range(60)]
    b = [word() for _ in range(40)] + [x[1:] for x in a[:30]]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b))))
    got = L.scores(L.Names(a), L.Names(b), i, j, np.zeros(len(i)))
    for k in range(len(i)):
        x, y = a[i[k]], b[j[k]]
        held = x in y or y in x
        want = 0.0 if not x or not y else 1.0 if x == y or (held and min(len(x), len(y)) >= 3) else max(M.CONTAINED * held, M.jaro_winkler(x, y))
        assert got[k] == want
    some = L.scores(L.Names(a), L.Names(b), i, j, np.full(len(i), 0.7))
    assert ((some == got) | (got < 0.7)).all()
