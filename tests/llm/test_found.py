"""Operators against brute force and by their defined edge cases."""

import random
from datetime import datetime, timedelta

from ledgerloom.llm import bpe, linkage, mixing, nearest, survivors
from ledgerloom.llm.components import component_labels, star_edges

T = datetime(2024, 5, 1)


# ------------------------------------------------------------------- nearest in time


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", None]), f"l{i}", rng.randrange(0, 4000) * 1_000_000) for i in range(300)]
    right = [(rng.choice(["a", "b"]), f"r{i}", rng.randrange(0, 4000) * 1_000_000) for i in range(120)]
    right += right[:5]
    tol = 40
    ld = spark.createDataFrame(left, "entity string, left_id string, at bigint")
    rd = spark.createDataFrame(right, "entity string, right_id string, at bigint")
    got = {r.left_id: (r.right_id, r.gap_micros) for r in nearest.nearest_in_time(ld, rd, tol).collect()}
    want = {}
    for e, lid, at in left:
        near = sorted((abs(at - rat), rat, rid) for re_, rid, rat in right if re_ == e and abs(at - rat) <= tol * 1_000_000)
        if near:
            want[lid] = (near[0][2], near[0][0])
    assert got == want


def test_till_slips_edges(spark):
    t = spark.createDataFrame([("t1", " T1 ", T, None, 1), ("t2", "t1", None, T + timedelta(minutes=20), 1), ("t3", None, T, None, 1), ("t4", "t1", None, None, 1), ("t5", "x", T, None, 1), ("t1", "T1", T, None, 2)], "transaction_id string, terminal_id string, occurred_at timestamp, settled_at timestamp, at int")
    s = spark.createDataFrame([("s2", "T1", T + timedelta(minutes=10)), ("s1", "t1 ", T - timedelta(minutes=10)), ("s0", None, T), ("s9", "x", T + timedelta(minutes=15, microseconds=1))], "slip_id string, terminal_id string, issued_at timestamp")
    assert {(r.transaction_id, r.slip_id) for r in nearest.till_slips(t, s).collect()} == {("t1", "s1"), ("t2", "s2")}
    assert nearest.till_slips(t.limit(0), s).count() == 0 and nearest.till_slips(t, s.limit(0)).count() == 0


# ---------------------------------------------------------------------- survivors

DDL = "extracted_id bigint, source_message_id string, kind string, grade string, supplier string, order_ref string, family_key string, total_minor bigint, vat_minor bigint, issued_at timestamp, category string, field_provenance map<string,string>, merged_from array<string>, k string"


def brute_families(rows):
    live = [r for r in rows if r[2] != "credit_note"]
    fold = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())

    def key(r):
        if r[6] and r[6].strip():
            p = r[6].split("|")
            return (fold(p[0]), fold(p[1])) if len(p) == 2 and fold(p[0]) and fold(p[1]) else None
        if r[4] and r[4].strip() and r[5] and r[5].strip():
            return (fold(r[4]), fold(r[5]))
        return None

    label = {r[0]: r[0] for r in live}
    changed = True
    while changed:
        changed = False
        for a in live:
            for b in live:
                linked = (a[1] and a[1] == b[1]) or (b[1] and b[1] in (a[12] or [])) or (key(a) and key(a) == key(b))
                if linked and label[a[0]] != label[b[0]]:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
                    changed = True
    return label


def brute_found(rows):
    label = brute_families(rows)
    groups = {}
    for r in rows:
        if r[0] in label:
            groups.setdefault(label[r[0]], []).append(r)
    at = {"supplier": 4, "order_ref": 5, "total_minor": 7, "vat_minor": 8, "issued_at": 9, "category": 10}
    out = set()
    for fam, members in groups.items():
        if len(members) < 2:
            continue
        for f, i in at.items():
            have = [r for r in members if r[i] is not None and (not isinstance(r[i], str) or r[i].strip())]
            if have:
                rank = lambda r: (survivors.PROVENANCE.index((r[11] or {}).get(f, "none")), survivors.GRADES.index(r[3]), -(r[9].timestamp()) if r[9] else float("inf"), r[0])  # noqa: B023, E731
                out.add((fam, f, min(have, key=rank)[0]))
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            i, rng.choice([None, f"m{rng.randint(0, n)}", f"m{rng.randint(0, n)}"]), rng.choice(["purchase_receipt", "unknown", "credit_note", "dispatch_notice"]), rng.choice(survivors.GRADES), rng.choice(["A & B", "a b", None, " ", "C"]),
            rng.choice([None, "", "X-1", "x 1", "Y2"]), rng.choice([None, " ", f"s|N{rng.randint(0, n)}", f"S |n-{rng.randint(0, n)}", "s|d|1|GBP", "s|"]), rng.choice([None, 5, 9]), rng.choice([None, 1]), rng.choice([None, T, T + timedelta(days=1)]),
            rng.choice([None, "", "c"]), rng.choice([None, {}, {"supplier": "html", "total_minor": "header"}, {"category": "schema_org"}]), rng.choice([None, [], [f"m{rng.randint(0, n)}", "lost"]]), "x",
        ))
    return rows


def test_survivors_against_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 25)
        df = spark.createDataFrame(rows, DDL)
        assert {tuple(r) for r in survivors.field_sources(df).select("family_id", "field_name", "extracted_id").collect()} == brute_found(rows)
    built = survivors.surviving_records(df)
    assert built.count() == len({f for f, _, _ in brute_found(rows)})


def test_survivors_empty_and_hot_group(spark):
    assert survivors.field_sources(spark.createDataFrame([], DDL)).count() == 0
    hot = [(i, "same", "unknown", "partial", f"S{i}", None, None, i, None, T, None, None, None, "x") for i in range(500)]
    got = {(r.field_name, r.extracted_id) for r in survivors.field_sources(spark.createDataFrame(hot, DDL)).collect()}
    assert got == {("supplier", 0), ("total_minor", 0), ("issued_at", 0)}


def test_long_chain_of_links(spark):
    links = [(i, f"k{i}") for i in range(60)] + [(i + 1, f"k{i}") for i in range(60)]
    df = spark.createDataFrame(links, "n bigint, k string")
    labels = {r.u: r.v for r in component_labels(star_edges(df, "n", "k")).collect()}
    assert labels == {i: 0 for i in range(1, 61)}


# -------------------------------------------------------------------------- encoding


def test_bpe_equals_public_encoder():
    import tiktoken

    data = bpe.read_vocabulary(bpe.VOCABULARY)
    ours, public = bpe.Encoder(data), tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcde AB\n\r\t  12é日本😀'st.;,-‍ ß") for _ in range(rng.randint(0, 80)))
        assert ours.encode(text) == public.encode_ordinary(text)
    long = "supercalifragilistic" * 2000
    assert ours.encode(long) == public.encode_ordinary(long)


def test_encode_corpus_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello world", "c"), (3, "Hello world", "c"), (4, "<|endoftext|>", "d")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got) == 5 and 50256 not in got[4][1]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------- mixing


def test_flow_meets_quotas_and_spreads():
    flows = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 50, ("c",): 20}, {"a": (0.4, 2), "b": (0.4, 2), "c": (0.2, 3)})
    per = {}
    for (_, s), f in flows.items():
        per[s] = per.get(s, 0) + f
    total = sum(per.values())
    assert abs(per["a"] / total - 0.4) < 0.01 and abs(per["c"] / total - 0.2) < 0.01
    assert total <= 270 and per["c"] <= 60
    assert mixing.route({}, {"a": (1.0, 1)}) == {}


def test_mix_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["pay", "slip", "till", "card"]) for _ in range(rng.randint(3, 60))) + f" {i}", rng.choice(["a", "a", "a", "b", "none"]), "x") for i in range(400)]
    docs += [(1000 + i, docs[i][1], "b", "x") for i in range(20)] + [(2000, None, "a", "x"), (2001, "", "b", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies string")
    w = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(d, w).toPandas()
    assert mix.groupby("doc_id").copies.sum().max() <= 3
    got = {r.source: r.actual_share for r in mixing.shares(spark.createDataFrame(mix), w).collect()}
    assert abs(got["a"] - 0.5) < 0.02 and abs(got["b"] - 0.5) < 0.02
    again = mixing.mixed(d.repartition(7), w).toPandas()
    key = ["source", "doc_id"]
    assert mix.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert mixing.mixed(d.limit(0), w).count() == 0


# ---------------------------------------------------------------------------- linkage

TX = "ordinal bigint, transaction_id string, merchant string, amount_minor bigint, currency string, occurred_at timestamp, settled_at timestamp, card_tail string, loaded_at timestamp, total string"
SL = "ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp, card_tail string"


def test_linkage_edges(spark):
    t = [(0, "t0", "SQ *MLDSN OFFC 12", 5000, "GBP", T, None, "1111", T), (0, "t0", "SQ *MLDSN OFFC 12", 5000, "GBP", T, T + timedelta(days=1), "1111", T), (1, "t1", "WEXEL HOTEL", 7312, "GBP", None, T + timedelta(days=2), None, T), (2, "t2", "MOLDASEN", -900, "GBP", T, None, None, T), (3, "t3", None, 4444, None, None, None, None, None)]
    s = [(0, "s0", "email", "Moldasen Office", None, 5000, "GBP", T + timedelta(minutes=5), "1111"), (1, "s1", "ocr", "Wexel Hotel", None, 7312, "GBP", T + timedelta(hours=1), None), (2, "s2", "pos", "Moldasen Office", None, 5000, "GBP", T, "1111"), (3, "s3", "email", None, None, -900, "GBP", T, None), (4, "s4", "email", "Moldasen Office", None, 5001, "GBP", T + timedelta(hours=30), None)]
    td, sd = spark.createDataFrame([(*r, "x") for r in t], TX), spark.createDataFrame(s, SL)
    got = {(r.transaction_id, r.slip_id) for r in linkage.same_purchases(td, sd).collect()}
    assert got == {("t0", "s0"), ("t1", "s1")}
    assert linkage.same_purchases(td.limit(0), sd).count() == 0 and linkage.same_purchases(td, sd.limit(0)).count() == 0


def test_propagation_equals_exact_marginals_on_trees(spark):
    """On a tree belief propagation is exact: compare with enumeration of all one-to-one choices."""
    edges = [(0, 0, 5.0), (1, 0, 2.0), (1, 1, 1.5), (2, 1, 0.7), (3, 5, 9.0)]
    got = {(r.t, r.s): r.confidence for r in linkage.propagate(spark.createDataFrame(edges, "t bigint, s bigint, odds double"), tolerance=1e-9).collect()}
    weights, total = {}, 0.0
    for mask in range(1 << len(edges)):
        chosen = [e for i, e in enumerate(edges) if mask >> i & 1]
        if len({e[0] for e in chosen}) < len(chosen) or len({e[1] for e in chosen}) < len(chosen):
            continue
        w = 1.0
        for e in chosen:
            w *= e[2]
        total += w
        for e in chosen:
            weights[e[:2]] = weights.get(e[:2], 0) + w
    for e in edges:
        assert abs(got[e[:2]] - weights[e[:2]] / total) < 1e-6


def test_blocks_lose_no_pair(spark):
    """Candidates by joins against all pairs under the same conditions."""
    rng = random.Random(9)
    names = ["Moldasen Office", "Wexel Hotel", "Tarn Fuels"]
    t = [(i, f"t{i}", rng.choice(names), rng.randint(900, 1100), "GBP", T + timedelta(hours=rng.randint(0, 200)), None, rng.choice([None, "1", "2"]), T, "x") for i in range(60)]
    s = [(i, f"s{i}", "email", rng.choice(names), None, rng.randint(900, 1100), "GBP", T + timedelta(hours=rng.randint(0, 200)), rng.choice([None, "1", "2"])) for i in range(60)]
    td, sd = linkage.transactions(spark.createDataFrame(t, TX)), linkage.documents_of_purchase(spark.createDataFrame(s, SL))
    rows = [(r.t, r.s) for r in linkage.candidates(td, sd).select("t", "s").distinct().collect()]
    assert len(rows) == len(set(rows))
    want = set()
    for a in t:
        for b in s:
            gap, d = (b[7] - a[5]).total_seconds() / 3600, a[3] - b[5]
            if abs(d) > 0.2 * max(a[3], b[5]) or not -25 <= gap <= 169:
                continue
            if d in linkage.NEAR_MINOR or (a[7] and a[7] == b[8]) or (a[2] == b[3] and -12 <= gap <= 36):
                want.add((a[0], b[0]))
    assert set(rows) == want


def test_unrelated_rows_lose_no_case(spark):
    """A tip and no card tail: found among few rows, and still among ten times as many in any currency."""
    case = [(0, "t0", "MOLDASEN OFFICE", 5600, "GBP", T, None, None, T, "x"), (1, "t1", "WEXEL HOTEL", 7700, "EUR", T, None, None, T, "x")]
    sd = spark.createDataFrame([(0, "s0", "email", "Moldasen Office", None, 5000, "GBP", T + timedelta(minutes=5), "1"), (1, "s1", "email", "Wexel Hotel", None, 7000, "EUR", T + timedelta(minutes=5), "1")], SL)
    for n in (2000, 20_000):
        others = spark.range(n).selectExpr("id + 2", "concat('u', id)", "'TARN FUELS'", "900000 + id", "if(id % 2 = 0, 'GBP', 'EUR')", f"timestamp '{T}' + make_interval(0, 0, 0, 0, id % 190)", "cast(null as timestamp)", "cast(null as string)", f"timestamp '{T}'", "'x'")
        got = {(r.transaction_id, r.slip_id) for r in linkage.same_purchases(spark.createDataFrame(case, TX).union(others), sd).collect()}
        assert got == {("t0", "s0"), ("t1", "s1")}, n


def test_every_word_of_a_name_is_a_key(spark):
    """Words in another order, in either name, make a candidate; several shared words make it once."""
    names = [("AND TARNALAKE ELECTRICAL DRUMISLAKE", "Drumislake & Tarnalake Electrical", None), ("ELECTRICAL VELOWICK 85", "Velowick Electrical", None), ("GRAVENHOLT", "Old Mill Fuels of Gravenholt", None), ("SOMBRELAND FELT", None, "Brightwaterside Felt"), ("QUORNDON", "Wexel Hotel", None)]
    t = [(i, f"t{i}", n[0], 5600, f"C{i}", T, None, None, T, "x") for i, n in enumerate(names)]
    s = [(i, f"s{i}", "email", n[1], n[2], 5000, f"C{i}", T + timedelta(minutes=5), "1") for i, n in enumerate(names)]
    td, sd = linkage.transactions(spark.createDataFrame(t, TX)), linkage.documents_of_purchase(spark.createDataFrame(s, SL))
    assert sorted((r.t, r.s) for r in linkage.candidates(td, sd).select("t", "s").distinct().collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_many_weak_rivals_weigh(spark):
    """Ten slips of odds 0.21 each share the transaction with the likely one, whose marginal is exact here."""
    td = spark.createDataFrame([(0, "t0", "MOLDASEN OFFICE", 5600, "GBP", T, None, None, T, "x")], TX)
    rivals = [(i, f"s{i}", "email", f"{w} Hotel", None, 5600, "GBP", T + timedelta(hours=40 + i), None) for i, w in enumerate(["Kipkebab", "Wexwax", "Guzzgack", "Fuzzyfib", "Jackvaf", "Cupkebag", "Vivwhiz", "Hubchep", "Pickbeck", "Zagquip"], 1)]
    sd = spark.createDataFrame([(0, "s0", "email", "Moldasen Office", None, 5000, "GBP", T + timedelta(minutes=5), "1"), *rivals], SL)
    got = [(r.slip_id, r.confidence) for r in linkage.same_purchases(td, sd).collect()]
    likely, weak = (2.718281828 ** (linkage.PRIOR + x) for x in (1.3 + 4.0 + 3.4, 8.9 - 1.4 - 3.0))
    assert [s for s, _ in got] == ["s0"] and abs(got[0][1] - likely / (1 + likely + 10 * weak)) < 1e-3


def test_marginals_of_a_hot_price(spark):
    """A third of the edges at one price, where everything rivals everything, against messages iterated on dense tables."""
    import numpy as np

    rng = np.random.default_rng(6)
    n = 24
    odds = np.where(rng.random((n, n)) < 0.25, np.exp(rng.uniform(-4, 6, (n, n))), 0.0)
    odds[:14, :14] = 20.0  # the hot price
    edges = [(i, 100 + j, float(odds[i, j])) for i in range(n) for j in range(n) if odds[i, j]]
    df = spark.createDataFrame(edges, "t bigint, s bigint, odds double")
    got = {(r.t, r.s): r.confidence for r in linkage.propagate(df.unionByName(df.limit(50)), tolerance=1e-6).collect()}
    ms = np.ones((n, n))
    for _ in range(4000):
        mt = 1 / (1 + (odds * ms).sum(1, keepdims=True) - odds * ms)
        ms = 1 / (1 + (odds * mt).sum(0, keepdims=True) - odds * mt)
    belief = odds * mt * ms
    want = belief / (1 + belief)
    assert len(got) == len(edges)
    assert max(abs(got[t, s] - want[t, s - 100]) for t, s in got) < 1e-3
    per_t = {}
    for (t, _), c in got.items():
        per_t[t] = per_t.get(t, 0) + c
    assert max(per_t.values()) < 1.01


def test_a_third_of_all_rows_at_one_firm_and_price(spark):
    """Equal purchases at one firm: every slip meets every transaction of its window, and no id is in two pairs."""
    start = datetime(2024, 5, 1)
    t = [(n, f"t{n}", "Wexel Bakery" if n % 3 else f"Orrin Motors {n}", 499 if n % 3 else 1000 + 50 * n, "GBP", start + timedelta(hours=5 * n), None, None, start + timedelta(days=3)) for n in range(60)]
    s = [(n, f"s{n}", "email", "Wexel Bakery" if n % 3 else "Orrin Motors", None, 499 if n % 3 else 1000 + 50 * n, "GBP", start + timedelta(hours=5 * n, minutes=6), None) for n in range(60)]
    td = spark.createDataFrame(t, "ordinal bigint, transaction_id string, merchant string, amount_minor bigint, currency string, occurred_at timestamp, settled_at timestamp, card_tail string, loaded_at timestamp")
    sd = spark.createDataFrame(s, "ordinal bigint, slip_id string, source string, supplier string, raw_merchant_hint string, total_minor bigint, currency string, issued_at timestamp, card_tail string")
    got = linkage.same_purchases(td, sd).collect()
    assert len({r.transaction_id for r in got}) == len(got) == len({r.slip_id for r in got}) >= 55
    assert all(r.transaction_id[1:] == r.slip_id[1:] for r in got)


def moved_rows(spark):
    """Rows written to shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def chained(n, seed):
    """Edges of a long chain of overlapping windows, and their marginals from messages iterated on dense tables."""
    import numpy as np

    rng = np.random.default_rng(seed)
    odds = np.zeros((n, n))
    for i in range(n):
        for j in range(max(0, i - 4), min(n, i + 5)):
            if rng.random() < 0.5:
                odds[i, j] = np.exp(rng.uniform(-3, 5))
    ms = np.ones((n, n))
    for _ in range(3000):
        mt = 1 / (1 + (odds * ms).sum(1, keepdims=True) - odds * ms)
        ms = 1 / (1 + (odds * mt).sum(0, keepdims=True) - odds * mt)
    belief = odds * mt * ms
    at = [(int(i), int(j)) for i, j in zip(*odds.nonzero(), strict=True)]
    return [(i, j, float(odds[i, j]), j) for i, j in at], {(i, j): belief[i, j] / (1 + belief[i, j]) for i, j in at}


def test_borders_of_pieces_do_not_show(spark):
    """One piece, some, and pieces of hardly more than one slip have the same marginals."""
    edges, want = chained(60, 3)
    df = spark.createDataFrame(edges, "t bigint, s bigint, odds double, place bigint")
    for piece in (1000, 40, 2):
        got = {(r.t, r.s): r.confidence for r in linkage.propagate(df.unionByName(df.limit(30)), tolerance=1e-4, piece=piece).collect()}
        assert got.keys() == want.keys(), piece
        assert max(abs(got[e] - want[e]) for e in want) < 1e-4, piece


def test_messages_do_not_move_all_edges_every_round(spark):
    edges, want = chained(300, 4)
    df = spark.createDataFrame(edges, "t bigint, s bigint, odds double, place bigint")
    before = moved_rows(spark)
    got = {(r.t, r.s): r.confidence for r in linkage.propagate(df).collect()}
    assert moved_rows(spark) - before <= 4 * len(edges)
    assert max(abs(got[e] - want[e]) for e in want) < linkage.TOLERANCE


def test_rows_move_once_for_all_their_keys(spark):
    """Eight words, a tail and an amount each: a row moves for its blocks and steps, not for its keys."""
    words = "Moldasen Wexel Tarnalake Drumislake Velowick Gravenholt Quorndon Sombreland"
    t = [(n, f"t{n}", words, 1000 + n, "GBP", T + timedelta(hours=n), None, "1", T, "x") for n in range(200)]
    s = [(n, f"s{n}", "email", words, None, 1000 + n, "GBP", T + timedelta(hours=n, minutes=5), "1") for n in range(200)]
    td, sd = linkage.settle(linkage.transactions(spark.createDataFrame(t, TX))), linkage.settle(linkage.documents_of_purchase(spark.createDataFrame(s, SL)))
    before = moved_rows(spark)
    with linkage.meeting(spark):
        pairs = linkage.settle(linkage.candidates(td, sd).select("t", "s"))
    assert moved_rows(spark) - before <= 200 * 2 + 200 * 3
    assert {(n, n) for n in range(200)} <= {tuple(r) for r in pairs.collect()}


def test_pairs_come_once_for_all_their_words(spark):
    """Eight words in common make a pair once, and a floor leaves out what no other name can lift to it."""
    words = "Moldasen Wexel Tarnalake Drumislake Velowick Gravenholt Quorndon Sombreland"
    t = [(n, f"t{n}", words, 5000 + 40 * n, "GBP", T + timedelta(hours=n), None, None if n % 2 else "1", T, "x") for n in range(30)]
    s = [(n, f"s{n}", "email", words, None, 5007 + 40 * n, "GBP", T + timedelta(hours=n, minutes=5), "2") for n in range(30)]
    td, sd = linkage.transactions(spark.createDataFrame(t, TX)), linkage.documents_of_purchase(spark.createDataFrame(s, SL))
    every = linkage.candidates(td, sd).select("t", "s", "base").collect()
    close = {(i, j) for i in range(30) for j in range(30) if -12 <= j - i + 5 / 60 <= 36}
    assert len(every) == len(close) and {(r.t, r.s) for r in every} == close
    kept = {(r.t, r.s) for r in linkage.candidates(td, sd, linkage.FLOOR).collect()}
    assert kept == {(r.t, r.s) for r in every if r.base + linkage.NAME_ODDS[0] >= linkage.FLOOR} and 0 < len(kept) < len(every)


def test_pairs_do_not_depend_on_how_many_rows_are_looked_at_together(monkeypatch):
    """Places that end within a batch, and one with far more rows than are looked at together."""
    import pyarrow as pa

    rng = random.Random(12)
    rows = []
    for place, n in ((-5, 4), (-1, 40), (3, 0), (8, 6)):
        for slip in (True, False):
            rows += [{"place": place, "slip": slip, "id": len(rows) + k, "cur": 7, "b": 1, "money": 1000 + rng.choice([0, 1, 500, 60]), "at": linkage.BLOCK_H * 3600 + rng.randrange(400_000), "slack": 0, "tail": rng.choice([None, 11, 12]), "g0": -3, "g1": 9, "h0": None, "h1": None, "word": 5, "names": rng.choice([[], [21], [21, 22]])} for k in range(n + (not slip))]
    schema = pa.schema([("place", pa.int64()), ("slip", pa.bool_()), ("id", pa.int64()), ("cur", pa.int32()), ("b", pa.int64()), ("money", pa.int64()), ("at", pa.int64()), ("slack", pa.int32()), ("tail", pa.int64()), ("g0", pa.int64()), ("g1", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("word", pa.int32()), ("names", pa.list_(pa.int64()))])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=3)
    t, s = [r for r in rows if not r["slip"]], [r for r in rows if r["slip"]]
    want = set()
    for a in t:
        for b in s:
            gap, d = (b["at"] - a["at"]) / 3600, a["money"] - b["money"]
            tails = a["tail"] is not None and a["tail"] == b["tail"]
            named = set(a["names"]) & set(b["names"]) and -12 <= gap <= 36
            if a["place"] == b["place"] and abs(d) <= 0.2 * max(a["money"], b["money"]) and -25 <= gap <= 169 and (d in linkage.NEAR_MINOR or tails or named):
                want.add((a["id"], b["id"]))
    for meet, pairs in ((1, 1), (7, 3), (10_000, 10_000)):
        monkeypatch.setattr(linkage, "MEET", meet)
        monkeypatch.setattr(linkage, "PAIRS", pairs)
        got = {(r["t"], r["s"]): r["name"] for part in linkage._meet(-1e9)(iter(batches)) for r in part.to_pylist()}
        assert got.keys() == want and len(want) > 500, (meet, pairs)
        assert all(abs(v - linkage.NAME_ODDS[0]) < 1e-6 for v in got.values())


def test_signatures_are_whole_beside_missing_names(spark):
    """All bits of a signature count, whichever rows share its batch."""
    names = [f"{a} {b}" for a in ("Quorndon", "Velowick", "Wexel", "Drumislake", "Tarnalake") for b in ("Hotel", "Electrical", "Fuels", "Bakery")]
    s = [(n, f"s{n}", "email", names[n // 2] if n % 2 else None, None if n % 2 else names[n // 2], 1000, "GBP", T, None) for n in range(2 * len(names))]
    for r in linkage.documents_of_purchase(spark.createDataFrame(s, SL).coalesce(1)).collect():
        assert ((r.s0, r.s1) if r.s % 2 else (r.h0, r.h1)) == linkage.name_features(names[r.s // 2])[:2]
