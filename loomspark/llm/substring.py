"""Operator 12: passages that repeat across documents, found by suffix automata of reference shards and removed.

A window is ``WINDOW`` consecutive words of a document. Words that a window covers go if its word sequence also starts in
a document with a smaller id; all windows are judged on the input.

1. Reference. Of the ``ANCHOR``-word grams of a window the one with the least hash is its anchor, so equal windows have
   equal anchors. A document's successive windows with one anchor are a passage (a winnowing: about 2 in 27 words start
   one). Passages whose anchor occurs in two documents are the reference, equal passages once with their smallest id; all
   others share no window. Grams with more than ``HOT`` distinct passages are anchors only where a window has no other.
2. Automata. Reference passages are dealt to shards by anchor; a suffix automaton of each (states hold the smallest id of
   the documents that their words occur in) gives matching statistics of the words that pass it, and with them, at the
   state of the last ``WINDOW`` words, the first document of each window.
3. Streaming. A reference of at most ``BROADCAST_WORDS`` words is broadcast as automata, and every document streams
   through each of them in one map. Beyond that, as all documents cannot pass all shards at any size, the distinct
   passages of documents meet the shard of their anchor by a shuffle, and their results return to the documents. Both give
   the same rows: windows match only where anchors do. An anchor with more than ``HOT`` distinct passages in spite of 1 is
   dealt to pairs of blocks of its passages.

Hashes only choose what meets; automata compare the words themselves. Rows with a null id keep all their words and are no
reference; rows that repeat an id take nothing from each other; a null or empty text has no words; very long texts are
taken whole; extra columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import marshal
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, byte_view, write_out
from loomspark.llm.textbytes import run_hashes, word_spans

WINDOW = 50
ANCHOR = 25
#: Distinct passages of an anchor that meet in one task.
HOT = 4096
#: Words of a shard.
SHARD_WORDS = 250_000
#: Words of a reference that is broadcast: about 100 bytes each.
BROADCAST_WORDS = 500_000
#: Ids or hashes (of 8 bytes) that are broadcast to narrow a table before it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Times that anchors are chosen anew because some turn out hot.
ROUNDS = 3
NONE = 2**63 - 1


def passages(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int, hot: np.ndarray):
    """The passages of a batch of texts: text number, first word, number of windows, anchor hash, passage hash."""
    starts, ends, rows = word_spans(data, offsets)
    h = run_hashes(data, starts, ends)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 5
    at = np.arange(len(h) - anchor + 1)
    grams = run_hashes(h, at, at + anchor)
    order = grams >> np.uint64(1)
    if len(hot):
        near = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order = order | (hot[near] == grams).astype(np.uint64) << np.uint64(63)
    least = np.lib.stride_tricks.sliding_window_view(order, window - anchor + 1)[:n].argmin(axis=1) + np.arange(n)
    whole = np.flatnonzero(rows[:n] == rows[window - 1 :])  # windows within one text
    if not len(whole):
        return (np.zeros(0, dtype=np.int64),) * 5
    least, text = least[whole], rows[whole]
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    first, count = whole[cut], np.diff(np.append(cut, len(whole)))
    own = run_hashes(h, first, first + count + window - 1)
    words_before = np.searchsorted(rows, text[cut])
    return text[cut], first - words_before, count, grams[least[cut]].view(np.int64), own.view(np.int64)


def _occurrences(window: int, anchor: int, hot):
    names = ["anchor", "passage", "doc_id", "tkey", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = hot.value
        for batch in batches:
            for a, b in bounded_batches(batch.column(2)):
                part = batch.slice(a, b - a)
                text, start, n, key, own = passages(*byte_view(part.column(2)), window, anchor, rare)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=names)

    return run, "anchor bigint, passage bigint, doc_id bigint, tkey bigint, start int, n int"


class SuffixAutomaton:
    """A suffix automaton of several word sequences; each state holds the least id of the sequences that its words occur in."""

    def __init__(self):
        self.symbols: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NONE]

    def add(self, words: Sequence[bytes], doc_id: int) -> None:
        symbols, step, link, length, first = self.symbols, self.next, self.link, self.length, self.first

        def split(p: int, q: int, c: int) -> int:
            """The state of the words that lead from p over c alone, parted from q."""
            own = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            first.append(first[q])
            link[q] = own
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = own
                p = link[p]
            return own

        last = 0
        for word in words:
            c = symbols.setdefault(word, len(symbols))
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, q, c)
            else:
                own, p = len(step), last
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(NONE)
                while p >= 0 and c not in step[p]:
                    step[p][c] = own
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[own] = q if length[q] == length[p] + 1 else split(p, q, c)
                last = own
            if doc_id < first[last]:
                first[last] = doc_id

    def settle(self) -> SuffixAutomaton:
        """Hand least ids to the suffixes of each state."""
        first, link = self.first, self.link
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = link[state]
            if up >= 0 and first[state] < first[up]:
                first[up] = first[state]
        return self

    def dump(self) -> bytes:
        return marshal.dumps((self.symbols, self.next, self.link, self.length, self.first))

    @classmethod
    def load(cls, blob: bytes) -> SuffixAutomaton:
        own = cls()
        own.symbols, own.next, own.link, own.length, own.first = marshal.loads(blob)
        return own

    def firsts(self, words: Sequence[bytes], window: int) -> list[int]:
        """For each word the first document of the ``window`` words that end with it, ``NONE`` where there are none: matching statistics cut at ``window``."""
        step, link, length, first, code = self.next, self.link, self.length, self.first, self.symbols.get
        out, state, matched = [], 0, 0
        for word in words:
            c = code(word, -1)
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            to = step[state].get(c)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = window
                out.append(first[state])
            else:
                out.append(NONE)
        return out


def _cut(window: int):
    """Owners of passages (list, text) to the passages with their words as text."""
    names = ["anchor", "passage", "first", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, text = batch.column(1)[r].values, batch.column(2)[r].as_buffer()
                data = np.frombuffer(text, dtype=np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                at, n = own.field("start").to_numpy(), own.field("n").to_numpy()
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at + n + window - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.field("anchor"), own.field("passage"), pa.array([batch.column(0)[r].as_py()] * len(own), pa.int64()), own.field("n"), pa.array(words, pa.binary())], names=names)

    return run, "anchor bigint, passage bigint, first bigint, n int, words binary"


def _shards(rows: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows sorted by their leading columns (anchor, i, j) to shards of whole groups of about ``limit`` words at least."""
    held, words, last = [], 0, None
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != last and words >= limit:
                yield held
                held, words = [], 0
            last = row[:3]
            held.append((*row[:-1], row[-1].split()))
            words += len(held[-1][-1])
    if held:
        yield held


def _match(window: int, limit: int):
    """(anchor, i, j, role, passage, first, words), role 1: reference, 2: streams, 3: both; to (anchor, passage, firsts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            automaton = SuffixAutomaton()
            for _, _, _, role, _, first, words in shard:
                if role & 1:
                    automaton.add(words, first)
            automaton.settle()
            streams = [(a, p, automaton.firsts(words, window)[window - 1 :]) for a, _, _, role, p, _, words in shard if role & 2]
            for at in range(0, len(streams), 4096):
                cols = zip(*streams[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["anchor", "passage", "firsts"])

    return run, "anchor bigint, passage bigint, firsts array<bigint>"


def _automata(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            automaton = SuffixAutomaton()
            for *_, first, words in shard:
                automaton.add(words, first)
            yield pa.RecordBatch.from_arrays([pa.array([automaton.settle().dump()], pa.binary())], names=["blob"])

    return run, "blob binary"


_DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _digests(rows: list[tuple[int | None, list[bytes], np.ndarray | None]], texts: bool) -> pa.RecordBatch:
    """Ids, words and which of them go to the operator's rows."""
    out = []
    for doc_id, words, gone in rows:
        kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        text = b" ".join(kept)
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode())[: 4 + texts])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + texts]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges)[:n] > 0


def _keep(window: int, kept: bool):
    """(doc_id, text, runs of the windows that go)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in bounded_batches(batch.column(1)):
                rows = []
                for r in range(lo, hi):
                    words, gone = (batch.column(1)[r].as_py() or "").encode().split(), None
                    if batch.column(2)[r].is_valid:
                        runs = batch.column(2)[r].values
                        a, n = runs.field("a").to_numpy(), runs.field("n").to_numpy()
                        gone = _covered(len(words), a, a + n + window - 1)
                    rows.append((batch.column(0)[r].as_py(), words, gone))
                yield _digests(rows, kept)

    return run, _DIGEST + ", kept string" * kept


def _stream(window: int, blobs, kept: bool):
    """(doc_id, text) past the broadcast automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton.load(b) for b in blobs.value]
        for batch in batches:
            for a, b in bounded_batches(batch.column(1)):
                rows = []
                for r in range(a, b):
                    doc_id, words = batch.column(0)[r].as_py(), (batch.column(1)[r].as_py() or "").encode().split()
                    ends: set[int] = set()
                    if doc_id is not None and len(words) >= window:
                        for automaton in automata:
                            ends.update(i for i, first in enumerate(automaton.firsts(words, window)) if first < doc_id)
                    rows.append((doc_id, words, _covered(len(words), np.array(sorted(ends)) - window + 1, np.array(sorted(ends)) + 1) if ends else None))
                yield _digests(rows, kept)

    return run, _DIGEST + ", kept string" * kept


def _narrowed(rows: DataFrame, keys: DataFrame, on: str, how: str, n: int) -> DataFrame:
    """A semi or anti join; the keys are broadcast where they are few."""
    return rows.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, how)


def _reference(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the passages whose anchors repeat, and these passages once: (anchor, passage, at, hot)."""
    spark, hot = docs.sparkSession, np.zeros(0, dtype=np.uint64)
    for left in reversed(range(ROUNDS)):
        found = write_out(docs.select("doc_id", "tkey", "text").mapInArrow(*_occurrences(window, anchor, spark.sparkContext.broadcast(hot))), "occurrences")
        repeated = write_out(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
        kept = write_out(_narrowed(found, repeated, "anchor", "left_semi", repeated.count()), "repeated")
        once = write_out(kept.groupBy("anchor", "passage").agg(F.min(F.struct("doc_id", "tkey", "start", "n")).alias("at")), "passages")
        many = once.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > HOT)
        if not left:
            break
        # Of N passages at most N / HOT anchors are hot; no more are taken than may be broadcast.
        new = [r[0] for r in many.orderBy(F.col("k").desc(), "anchor").limit(BROADCAST_ROWS).collect()]
        fresh = np.setdiff1d(np.array(new, dtype=np.int64).view(np.uint64), hot)
        if not len(fresh):
            break
        hot = np.union1d(hot, fresh)
    return kept, once.join(F.broadcast(many) if len(hot) <= BROADCAST_ROWS else many, "anchor", "left")


def _paired(shards: DataFrame) -> DataFrame:
    """Passages with their roles; those of an anchor with more than ``HOT`` meet in pairs of blocks."""
    plain = shards.where("k is null").select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("role"), "passage", "first", "words")
    blocks = F.ceil(F.col("k") / HOT)
    own = F.pmod(F.xxhash64("passage"), blocks)
    hot = shards.where("k is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    row = lambda i, j, role: hot.select("anchor", F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), F.lit(role).alias("role"), "passage", "first", "words")
    return plain.unionByName(row("own", "other", 1)).unionByName(row("other", "own", 2))


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row; ``texts``: and ``kept``, the words left, joined by one space."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and no more than a window")
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    known = rows.where("doc_id is not null and text is not null")
    kept, once = _reference(known, window, anchor)
    owners = once.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tkey").alias("tkey")).agg(F.collect_list(F.struct("anchor", "passage", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("own"), F.sum(F.col("at.n") + window - 1).alias("words"))
    owners = write_out(owners, "owners")
    n_owners, n_words = owners.agg(F.count("*"), F.sum("words")).first()
    owning = _narrowed(known, owners.select("doc_id").distinct(), "doc_id", "left_semi", n_owners)
    cut = owning.join(owners.drop("words"), ["doc_id", "tkey"]).groupBy("doc_id", "tkey").agg(F.first("own").alias("own"), F.first("text").alias("text")).select("doc_id", "own", "text")
    shards = cut.mapInArrow(*_cut(window))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_words or 0) // 1_000_000 + 1)
    if (n_words or 0) <= BROADCAST_WORDS:
        dealt = shards.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "first", "words").repartition(max(1, (n_words or 0) // SHARD_WORDS), "anchor").sortWithinPartitions("anchor")
        blobs = [bytes(r[0]) for r in dealt.mapInArrow(*_automata(SHARD_WORDS)).collect()]  # at most about 100 bytes a word of BROADCAST_WORDS
        return rows.select("doc_id", "text").mapInArrow(*_stream(window, spark.sparkContext.broadcast(blobs), texts))
    hot = once.where("k is not null").select("anchor", "passage", "k")
    # Mostly no anchor is hot; the words are then shuffled once.
    marked = shards.join(hot, ["anchor", "passage"], "left") if hot.limit(1).count() else shards.withColumn("k", F.lit(None).cast("long"))
    met = _paired(marked).repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    firsts = write_out(met.mapInArrow(*_match(window, SHARD_WORDS)), "firsts")
    # Runs of windows that go: mostly all of a passage. Rows that repeat give equal runs, so a set holds no more than one text does.
    each = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.struct((F.col("start") + i).alias("a"), F.lit(1).alias("n")))), lambda x: x.isNotNull())
    runs = F.when(F.array_max("firsts") < F.col("doc_id"), F.array(F.struct(F.col("start").alias("a"), F.col("n").alias("n")))).otherwise(each)
    gone = kept.join(firsts, ["anchor", "passage"]).where(F.array_min("firsts") < F.col("doc_id")).select("doc_id", "tkey", F.explode(runs).alias("run"))
    starts = write_out(gone.groupBy("doc_id", "tkey").agg(F.collect_set("run").alias("starts")), "starts")
    ids = starts.select("doc_id").distinct()
    n_ids = ids.count()
    touched = _narrowed(rows, ids, "doc_id", "left_semi", n_ids).join(starts, ["doc_id", "tkey"], "left").select("doc_id", "text", "starts")
    others = _narrowed(rows, ids, "doc_id", "left_anti", n_ids).select("doc_id", "text", F.lit(None).cast(starts.schema["starts"].dataType).alias("starts"))
    return touched.unionByName(others).mapInArrow(*_keep(window, texts))
