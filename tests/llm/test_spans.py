import random

from ledgerloom.llm import spans


def brute(docs, least):
    """doc_id -> characters in passages of ``least`` that another document holds."""
    owners = {}
    for d, t in docs.items():
        for i in range(len(t or "") - least + 1):
            owners.setdefault(t[i : i + least], set()).add(d)
    out = {}
    for d, t in docs.items():
        covered = set()
        for i in range(len(t or "") - least + 1):
            if owners[t[i : i + least]] - {d}:
                covered.update(range(i, i + least))
        if covered:
            out[d] = len(covered)
    return out


def make_docs(seed, n, alphabet="abc"):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 40))) for _ in range(6)]
    docs = {}
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))))
        docs[d] = "".join(parts)
    docs[n], docs[n + 1], docs[n + 2] = None, "", docs[0]
    return docs


def run(spark, docs, least, k):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id bigint, text string, a string")
    return {r.doc_id: r.shared_chars for r in spans.shared_characters(df, least, k).collect()}


def test_against_brute_force(spark):
    docs = make_docs(1, 40, "abcdé日😀")
    assert run(spark, docs, 12, 5) == brute(docs, 12)


def test_small_alphabet_in_many_shards_and_passes(spark, monkeypatch):
    docs = make_docs(2, 40, "ab")
    assert run(spark, docs, 9, 4) == brute(docs, 9)
    monkeypatch.setattr(spans, "SHARD_CHARS", 60)
    monkeypatch.setattr(spans, "PASS_BYTES", 20_000)
    assert run(spark, docs, 9, 4) == brute(docs, 9)


def test_boilerplate_in_most_documents(spark):
    """A passage in two thirds of 900 documents, always between other texts, is in the reference once."""
    rng = random.Random(4)
    common = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs = {d: "".join(rng.choice("abcdefgh") for _ in range(30)) + (common if d % 3 else "") + "".join(rng.choice("abcdefgh") for _ in range(30)) for d in range(900)}
    assert run(spark, docs, 20, 8) == brute(docs, 20)


def test_automaton_alone():
    """Matching statistics against brute force, with pieces that share no passage of the least length."""
    for seed in range(200):
        rng = random.Random(seed)
        pieces, seen = [], set()
        for _ in range(4):
            piece = "".join(rng.choice("abc") for _ in range(rng.randint(7, 20)))
            windows = [piece[i : i + 7] for i in range(len(piece) - 6)]
            if len(set(windows)) == len(windows) and not seen & set(windows):
                pieces.append(piece)
                seen |= set(windows)
        auto = spans.Automaton()
        for n, piece in enumerate(pieces):
            auto.add(piece, n, 100)
        reader = spans.Reader(auto.packed())
        text = "".join(rng.choice([rng.choice("abc"), rng.choice(pieces)]) for _ in range(12))
        want = {x for i in range(len(text) - 6) if text[i : i + 7] in seen for x in range(i, i + 7)}
        got = reader.matches([ord(c) for c in text], 7)
        assert {x for a, b, _ in got for x in range(a, b)} == want
        for a, b, here in got:
            n, end = reader.place(here)
            assert pieces[n][end - 100 - (b - a) : end - 100] == text[a:b]


def test_without_shared(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common, own = word(40), [f"{n}{word(28)}{n}" for n in range(4)]  # no chance characters around the passage
    rows = [(1, own[0] + common), (2, common + own[1]), (3, own[2]), (4, own[0] + common), (5, None), (6, ""), (7, own[3] + common + own[3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r.text for r in spans.without_shared(df, 20, 8).collect()}
    assert got == {1: own[0] + common, 2: own[1], 3: own[2], 4: "", 5: None, 6: "", 7: own[3] + own[3]}
    assert spans.without_shared(df.limit(0), 20, 8).count() == 0


def test_empty_table_and_repeats(spark):
    assert run(spark, {}, 10, 4) == {}
    assert run(spark, {1: "abc" * 50}, 10, 4) == {}
    df = spark.createDataFrame([(1, "abcdefghij" * 3), (1, "abcdefghij" * 3)], "doc_id bigint, text string")
    assert spans.shared_characters(df, 10, 4).collect() == []
