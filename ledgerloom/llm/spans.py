"""Passages that stand verbatim in more than one document, by suffix automata.

The reference is the set of passages of ``min_chars`` characters that two different
texts hold, each taken once, from the text of least id, and joined to longer pieces
where they follow each other.  Pieces form shards; a suffix automaton is built over
each bounded block of a shard and broadcast, as many at a time as ``PASS_BYTES``
allow.  Whole documents are streamed through the automata of their shards for
matching statistics, and every maximal match of ``min_chars`` characters or more is
a span of the document and of the text that the piece came from.

Which passages form the reference, and which shards a document meets, is found by
hashes beforehand.  That filter is exact: a passage contains a k-gram of least hash
among its k-grams, which depends on the passage alone; only passages whose such
gram stands in two texts are hashed as a whole, and those of one hash in two texts
are taken.  All of this is plain aggregation, so boilerplate in a third of all
documents is one row per task, and it adds its text to the reference once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import scratch_path, settle

MIN_CHARS = 200
ANCHOR = 64
#: Characters of one automaton; a shard with more is a list of automata.
SHARD_CHARS = 100_000
#: Packed automata that are broadcast at a time.
PASS_BYTES = 32_000_000
#: Characters whose hashes are computed at once.
CHUNK_CHARS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(codes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all k-grams of an array of code points."""
    n = len(codes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        c = _mix(codes.astype(np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(c * _powers(_BASE, n), out=prefix[1:], dtype=np.uint64)
        return _mix((prefix[k:] - prefix[:-k]) * _powers(_INVERSE, n - k + 1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _chunks(pdf: pd.DataFrame, *columns: str) -> Iterator[list[tuple]]:
    """Rows in lists of about CHUNK_CHARS characters of text."""
    rows, size = [], 0
    for row in zip(pdf["doc_id"], pdf["text"], *(pdf[c] for c in columns), strict=True):
        rows.append(row)
        size += len(row[1])
        if size >= CHUNK_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _windows(texts: list[str], k: int, min_chars: int) -> tuple[np.ndarray, ...]:
    """For every passage of ``min_chars``: text, position in it and in all, least hash of its k-grams; and all code points."""
    codes = [_codes(t) for t in texts]
    lengths = np.array([len(c) for c in codes])
    joined = np.concatenate(codes)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    least = _sliding_min(gram_hashes(joined, k), min_chars - k + 1)
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    at = np.arange(len(least)) - starts[doc]
    inside = at <= lengths[doc] - min_chars  # a passage does not run into the next text
    return doc[inside], at[inside], np.flatnonzero(inside), least[inside].view(np.int64), joined


def _fingerprints(k: int, min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _chunks(pdf):
                doc, _, _, fp, _ = _windows([t for _, t in rows], k, min_chars)
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                ids = np.array([d for d, _ in rows], dtype=np.int64)
                yield pd.DataFrame({"doc_id": ids[doc[new]], "fp": fp[new]}).drop_duplicates()

    return run


def _passages(k: int, min_chars: int):
    """Hashes of the passages whose least k-gram is one of the document's common ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _chunks(pdf, "fps"):
                doc, at, where, fp, codes = _windows([r[1] for r in rows], k, min_chars)
                known = np.isin(fp, np.concatenate([r[2] for r in rows]))
                ids, place = np.array([r[0] for r in rows], dtype=np.int64), where[known]
                h1, h2 = (gram_hashes(codes, min_chars, seed).view(np.int64)[place] for seed in (1, 2))
                yield pd.DataFrame({"doc_id": ids[doc[known]], "a": at[known].astype(np.int32), "fp": fp[known], "h1": h1, "h2": h2})

    return run


def _pieces(min_chars: int):
    """Runs of passages that follow each other, with their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, shard, starts in zip(pdf["doc_id"], pdf["text"], pdf["shard"], pdf["starts"], strict=True):
                at = np.sort(starts)
                for run_at in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    out.append((shard, doc_id, int(run_at[0]), text[run_at[0] : run_at[-1] + min_chars]))
            yield pd.DataFrame(out, columns=["shard", "doc_id", "start", "piece"])

    return run


class Automaton:
    """Suffix automaton over several pieces; a state knows where its first string ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.end = [0]
        self.chars = 0
        self.pieces: list[tuple[int, int, int]] = []  # first character here, document, first character there

    def _state(self, length: int, nxt: dict[int, int], link: int, end: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = self._state(length[p] + 1, dict(nxt[q]), link[q], self.end[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def add(self, text: str, doc: int = 0, start: int = 0) -> None:
        nxt, link, length = self.next, self.link, self.length
        self.pieces.append((self.chars, doc, start))
        last = 0
        for c in _codes(text).tolist():
            self.chars += 1
            q = nxt[last].get(c)
            if q is not None:  # another piece went here before
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            cur = self._state(length[last] + 1, {}, 0, self.chars)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def packed(self) -> bytes:
        """Plain arrays: most states have one way on; the others' ways stand in a list."""
        n = len(self.length)
        char, to = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        forks = []
        for s, ways in enumerate(self.next):
            if len(ways) == 1:
                char[s], to[s] = next(iter(ways.items()))
            elif ways:
                char[s] = -2
                forks.extend((s, c, q) for c, q in ways.items())
        arrays = (char, to, np.array(self.link, dtype=np.int32), np.array(self.length, dtype=np.int32), np.array(self.end, dtype=np.int32))
        return zlib.compress(pickle.dumps((*arrays, np.array(forks, dtype=np.int32).reshape(-1, 3), np.array(self.pieces, dtype=np.int64))), 1)


class Reader:
    """A packed automaton through which documents are streamed."""

    def __init__(self, blob: bytes):
        char, to, link, length, end, forks, self.pieces = pickle.loads(zlib.decompress(blob))
        self.char, self.to, self.link, self.length, self.end = char.data, to.data, link.data, length.data, end.data
        self.forks = {(s << 21) | c: q for s, c, q in forks.tolist()}
        self.begins = self.pieces[:, 0]

    def matches(self, codes: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, end, end here) of the maximal matches of at least ``least`` characters."""
        char, to, link, length, end, forks = self.char, self.to, self.link, self.length, self.end, self.forks.get
        out = []
        state = n = 0
        start = here = -1  # of the open match
        for at, c in enumerate(codes):
            while True:
                k = char[state]
                q = to[state] if k == c else forks((state << 21) | c, -1) if k == -2 else -1
                if q >= 0:
                    state = q
                    n += 1
                    break
                if state == 0:
                    break
                state = link[state]
                n = length[state]
            if n >= least:
                if here + 1 != end[state] or at + 1 - n != start:
                    if start >= 0:
                        out.append((start, at, here))
                    start = at + 1 - n
                here = end[state]
            elif start >= 0:
                out.append((start, at, here))
                start = here = -1
        if start >= 0:
            out.append((start, len(codes), here))
        return out

    def place(self, end: int) -> tuple[int, int]:
        """The document, and the character after the last one there, of a match's end here."""
        first, doc, start = self.pieces[np.searchsorted(self.begins, end, side="left") - 1]
        return int(doc), int(start + end - first)


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One packed automaton for each block; its pieces come one after the other."""
    key, auto = None, None

    def done() -> pd.DataFrame:
        blob = auto.packed()
        return pd.DataFrame({"shard": [key[0]], "bytes": [20 * len(auto.length)], "blob": [blob]})

    for pdf in batches:
        for shard, block, doc_id, start, piece in zip(pdf["shard"], pdf["block"], pdf["doc_id"], pdf["start"], pdf["piece"], strict=True):
            if auto is not None and ((shard, block) != key or auto.chars + len(piece) > 2 * SHARD_CHARS):
                yield done()
                auto = None
            if auto is None:
                key, auto = (shard, block), Automaton()
            auto.add(piece, doc_id, start)
    if auto is not None:
        yield done()


_READERS: dict[tuple, Reader] = {}


def _stream(shared, mark: str, min_chars: int):
    """Spans of each document and of the texts that the matched pieces came from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if any(m != mark for m, _ in _READERS):
            _READERS.clear()
        for pdf in batches:
            copies: dict[int, list[tuple[int, int]]] = {}
            kept: dict[int, list[tuple[int, int]]] = {}
            for doc_id, text, shards in zip(pdf["doc_id"], pdf["text"], pdf["shards"], strict=True):
                codes = _codes(text).tolist()
                for n, (shard, blob) in enumerate(shared.value):
                    if shard not in shards:
                        continue
                    if (mark, n) not in _READERS:
                        _READERS[mark, n] = Reader(blob)
                    reader = _READERS[mark, n]
                    for a, b, here in reader.matches(codes, min_chars):
                        x, end = reader.place(here)
                        if x != doc_id:
                            copies.setdefault(doc_id, []).append((a, b))
                            kept.setdefault(x, []).append((end - (b - a), end))
                        elif end != b:  # the text has its own passage once more
                            kept.setdefault(x, []).append((a, b))
            rows = [(d, a, b, side) for spans, side in ((copies, True), (kept, False)) for d, every in spans.items() for a, b in _joined(every)]
            yield pd.DataFrame(rows, columns=["doc_id", "a", "b", "copied"])

    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _total(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for starts, ends in zip(a, b, strict=True):
        order = np.argsort(starts, kind="stable")
        total, reach = 0, -1
        for i in order:
            s, e = int(starts[i]), int(ends[i])
            if e > reach:
                total += e - max(s, reach)
                reach = e
        out.append(total)
    return pd.Series(out, dtype="int64")


def _one_text_each(documents: DataFrame, min_chars: int) -> DataFrame:
    """(text_key, doc_id, last_doc): long enough texts, one document for equal ones."""
    long = documents.where(F.length("text") >= min_chars).select("doc_id", F.sha2("text", 256).alias("text_key"))
    return long.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_doc"))


def _passes(sizes: list[int]) -> list[tuple[int, int]]:
    """[first, last] of automata that fit together into PASS_BYTES."""
    out: list[tuple[int, int]] = []
    total = 0
    for n, size in enumerate(sizes):
        if out and total + size <= PASS_BYTES:
            out[-1] = (out[-1][0], n)
            total += size
        else:
            out.append((n, n))
            total = size
    return out


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, a, b, copied): pieces [a, b) of one document of each distinct text that other texts hold.

    ``copied`` tells the spans of which another document keeps the reference copy.
    The spans of one document may touch or overlap.
    """
    spark = documents.sparkSession
    k = min(anchor, min_chars)
    groups = _one_text_each(documents, min_chars)
    texts = settle(documents.select("doc_id", "text").join(groups.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]))
    prints = settle(texts.mapInPandas(_fingerprints(k, min_chars), "doc_id bigint, fp bigint"))
    common = prints.groupBy("fp").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("fp")
    mine = prints.join(common, "fp").groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))
    candidates = settle(texts.join(mine, "doc_id"))
    passages = candidates.mapInPandas(_passages(k, min_chars), "doc_id bigint, a int, fp bigint, h1 bigint, h2 bigint")
    once = passages.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("y"), F.min_by("a", "doc_id").alias("a"), F.min("fp").alias("fp"))
    reference = settle(once.where("doc_id <> y").select("doc_id", "a", "fp"))
    n_shards = 1 + reference.count() * 2 // SHARD_CHARS
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")
    by_text = reference.groupBy("doc_id").agg(F.collect_list("a").alias("starts")).withColumn("shard", shard)
    pieces = candidates.select("doc_id", "text").join(by_text, "doc_id").mapInPandas(_pieces(min_chars), "shard int, doc_id bigint, start int, piece string")
    pieces = settle(pieces)
    # a shard that long texts fill beyond the limit is spread over blocks
    blocks = pieces.groupBy("shard").agg(F.ceil(F.sum(F.length("piece")) / F.lit(SHARD_CHARS)).alias("blocks"))
    placed = pieces.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.col("blocks")))
    built = placed.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInPandas(_build, "shard int, bytes bigint, blob binary")
    built = settle(built)
    wanted = reference.select("fp", shard.alias("shard")).distinct()
    routes = candidates.select("doc_id", F.explode("fps").alias("fp")).join(wanted, "fp").groupBy("doc_id").agg(F.collect_set("shard").alias("shards"))
    routed = settle(candidates.select("doc_id", "text").join(routes, "doc_id"))
    order = [F.col("shard"), F.xxhash64("blob")]
    sizes = built.select("shard", F.xxhash64("blob").alias("mark"), "bytes").orderBy("shard", "mark").collect()  # three numbers an automaton
    where = scratch_path(spark, "spans")
    spans_schema = "doc_id bigint, a int, b int, copied boolean"
    spark.createDataFrame([], spans_schema).write.parquet(f"{where}/pass=-1")
    for n, (first, last) in enumerate(_passes([r["bytes"] for r in sizes])):
        part = sizes[first : last + 1]
        chosen = built.where(order[0].between(part[0].shard, part[-1].shard) & order[1].isin(*[r.mark for r in part])).collect()
        shared = spark.sparkContext.broadcast([(r.shard, bytes(r.blob)) for r in chosen])
        shards = F.array(*[F.lit(s) for s in sorted({r.shard for r in chosen})])
        routed.where(F.arrays_overlap("shards", shards)).mapInPandas(_stream(shared, f"{where}/{n}", min_chars), spans_schema).write.parquet(f"{where}/pass={n}")
        shared.destroy()
    return spark.read.schema(spans_schema).parquet(*[f"{where}/pass={n}" for n in range(-1, len(_passes([r["bytes"] for r in sizes])))])


def shared_characters(documents: DataFrame, min_chars: int = MIN_CHARS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, shared_chars) of documents with a passage that another one holds.

    Texts are compared code point by code point.  Null texts and texts shorter than
    ``min_chars`` share nothing, repeats inside one document alone do not count, and
    a row repeated under one doc_id is the same document.  Documents with equal
    texts share all of it.  There is one way for all sizes.
    """
    spans = shared_spans(documents, min_chars, anchor).select("doc_id", "a", "b").distinct()
    total = F.pandas_udf(_total, "bigint")
    parts = spans.groupBy("doc_id").agg(F.collect_list("a").alias("as"), F.collect_list("b").alias("bs")).select("doc_id", total("as", "bs").alias("shared_chars"))
    groups = _one_text_each(documents, min_chars)
    long = documents.where(F.length("text") >= min_chars).select("doc_id", F.sha2("text", 256).alias("text_key"), F.length("text").cast("bigint").alias("n"))
    twins = long.join(groups.where("doc_id <> last_doc").select("text_key"), "text_key").select("doc_id", F.col("n").alias("shared_chars")).distinct()
    return twins.unionByName(parts.join(twins.select("doc_id"), "doc_id", "left_anti"))


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, parts in zip(texts, spans, strict=True):
        if text is None or parts is None:
            out.append(text)
            continue
        kept, at = [], 0
        for p in parts:
            if p["a"] > at:
                kept.append(text[at : p["a"]])
            at = max(at, p["b"])
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out, dtype=object)


def without_shared(documents: DataFrame, min_chars: int = MIN_CHARS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text): every shared passage is left in one document and removed from the others.

    It stays in the text of least doc_id that holds it; a document of at least
    ``min_chars`` whose text equals that of a smaller doc_id comes out empty.  Null
    and short texts stay as they are; a row comes out for each row.
    """
    cut = shared_spans(documents, min_chars, anchor).where("copied").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    groups = _one_text_each(documents, min_chars)
    keyed = documents.select("doc_id", "text", F.when(F.length("text") >= min_chars, F.sha2("text", 256)).alias("text_key"))
    firsts = keyed.join(groups.select("text_key", F.col("doc_id").alias("first_doc")), "text_key", "left").join(cut, "doc_id", "left")
    whole = F.pandas_udf(_without, "string")("text", "spans")
    return firsts.select("doc_id", F.when(F.col("first_doc") < F.col("doc_id"), F.lit("")).otherwise(whole).alias("text"))
