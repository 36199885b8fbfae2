"""Operator 10: packing documents into sequences by a grouping genetic algorithm on islands.

A document's tokens are the ids of a public tokenizer (its path is a parameter) and the end id. Documents of more than
``capacity`` tokens are cut into pieces of ``capacity``, the last of which may be shorter; full pieces are sequences of
their own. The others are dealt by hash to buckets of about ``BUCKET`` pieces (more where pieces are so short that ``BUCKET_BINS`` bins hold more). For each bucket ``ISLANDS`` islands
evolve groupings, each from ``POPULATION`` best-fit groupings in orders of blurred size: crossover injects whole
well-filled bins of one parent into the other, bins that hold duplicates and up to ``DISSOLVED`` of the worst are
dissolved, and the displaced pieces are put back best-fit, largest first. An island stops after the generation that
reaches the least possible number of bins, else after ``GENERATIONS``.
Between rounds each island's elite migrates to its neighbour by a shuffle. A bucket's best grouping stands, but for its
least filled bins (those of at most ``HANDED`` of its pieces): their pieces are dealt anew to fewer buckets, level by
level, until one bucket is left, so that the last open bin of each bucket costs nothing.

A null text counts as empty (only the end id); repeated rows are packed each; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import kept, write_out

CAPACITY = 4096
#: A bucket's pieces and bins: it has about as many pieces, but at least about as many bins.
BUCKET = 3000
BUCKET_BINS = 256
ISLANDS = 3
POPULATION = 4
GENERATIONS = 24
ROUNDS = 2
WELL_FILLED = 0.995
DISSOLVED = 0.2
BLUR = 0.5
HANDED = 1 / 8
#: Bytes of words and ids that a worker holds at most, as Python counts them.
STORED_BYTES = 192 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@lru_cache(maxsize=1)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How the tokenizer parts a word (its own pattern).
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of characters below this one are as the tokenizer normalises them but for their case.
PLAIN = "\u0300"
BEYOND = regex.compile("[\u0300-\U0010ffff]")
MARKS = regex.compile(r"\p{M}")
#: What most often follows a word's letters; each is a run of its own there.
ENDS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Ids of texts, put together from stored ids of their words.

    The tokenizer lower-cases each character, drops white space and never joins ids across it, so a text's ids are those
    of its words end to end, and a word's those of its runs of letters, single digits and runs of other characters. Only
    such a run goes through the tokenizer's merges. Words with characters from ``PLAIN`` on, and texts with combining
    marks or a special token's string, are encoded by the tokenizer as they are. When ``STORED_BYTES`` are held, words
    not met since the last time are forgotten. ``shared``: one for all tasks of a worker, which so need not learn the
    words of the tasks before again; a task of another operator drops it.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.stored: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *special]  # these controls part words in Python only

    @classmethod
    def shared(cls, path: str) -> WordIds:
        return kept("packing", path, lambda: cls(path))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn_runs(self, runs: set[str]) -> None:
        stored, older, merges, held = self.stored, self.older, self.merges, self.held
        new = [r for r in runs if r not in stored]
        spelt = "\n".join(new).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        for run, letters in zip(new, spelt, strict=True) if new else ():
            ids = older.get(run) or array("I", [t.id for t in merges(letters)]).tobytes()
            stored[run] = ids
            held += 190 + len(run) + len(ids)
        self.held = held

    def learn(self, words: set[str], plain: bool = False) -> None:
        """``plain``: no word has a character from ``PLAIN`` on."""
        if self.held > STORED_BYTES / 2:
            self.stored, self.older, self.held = {}, self.stored, 0
        stored, older, held = self.stored, self.older, self.held
        alone, mixed = set(), {}
        for w in words.difference(stored):
            ids = older.get(w)
            if ids is None:
                if plain or max(w) < PLAIN:
                    if w.isalpha():
                        alone.add(w)
                    elif w[-1] in ENDS and w[:-1].isalpha():
                        mixed[w] = (w[:-1], w[-1])
                    else:
                        mixed[w] = PRETOKENS.findall(w)
                    continue
                ids = self._encode(w)
            stored[w] = ids
            held += 190 + len(w) + len(ids)
        self.held = held
        self._learn_runs(alone.union(*mixed.values()))
        held = self.held
        for w, runs in mixed.items():
            if len(runs) > 1:
                ids = stored[w] = b"".join([stored[r] for r in runs])
                held += 190 + len(w) + len(ids)
        self.held = held

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        lower = text.replace("Σ", "σ").lower()
        plain = lower.isascii() or not BEYOND.search(lower)
        if any(x in text for x in self.odd) or (not plain and MARKS.search(text)):
            return self._encode(text)
        words = lower.split()
        own: list[bytes] = []
        for at in range(0, len(words), 50_000):  # a very long text may hold more words than are stored
            part = words[at : at + 50_000]
            self.learn(set(part), plain)
            own.append(b"".join(map(self.stored.__getitem__, part)))
        return b"".join(own)


def _pieces(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.shared(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids((text.as_py() or b"").decode("utf-8", "replace")) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


Grouping = list[list[int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Grouping | None = None) -> Grouping:
    """Put each item of ``order`` into the fullest bin that takes it, else into a new one."""
    bins = bins if bins is not None else []
    room = sorted((free, b) for b, own in enumerate(bins) if (free := capacity - sum(lengths[i] for i in own)) > 0)
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity, len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def fitness(bins: Grouping, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins, then more unequal filling (the sum of squared fills); smaller is better."""
    return len(bins), -sum((sum(lengths[i] for i in own) / capacity) ** 2 for own in bins)


def crossover(a: Grouping, b: Grouping, lengths: list[int], capacity: int, rng: random.Random) -> Grouping:
    """Half of ``b``'s well-filled bins go into ``a`` whole; bins with duplicates and some of the worst are dissolved, their other items best-fit."""
    full = [own for own in b if sum(lengths[i] for i in own) >= WELL_FILLED * capacity]
    injected = rng.sample(full, (len(full) + 1) // 2)
    there = {i for own in injected for i in own}
    kept, displaced = [], []
    for own in a:
        if there.isdisjoint(own):
            kept.append(own)
        else:
            displaced += [i for i in own if i not in there]
    kept.sort(key=lambda own: -sum(lengths[i] for i in own))
    for _ in range(min(len(kept), rng.randint(1, max(4, int(DISSOLVED * len(a)))))):
        displaced += kept.pop()
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, capacity, [list(own) for own in injected + kept])


def evolve(lengths: list[int], capacity: int, seeds: list[Grouping], rng: random.Random, population: int = POPULATION, generations: int = GENERATIONS) -> tuple[Grouping, int]:
    """The best grouping of one island after some generations, and the number of crossovers; it stops at the lower bound.

    ``seeds`` are the elites that the island starts from; the rest of its population are best-fit in orders of blurred size.
    """
    least = -(-sum(lengths) // capacity)
    people = list(seeds)
    while len(people) < population:
        people.append(best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(1 - BLUR, 1 + BLUR)), lengths, capacity))
    scored = sorted(((fitness(p, lengths, capacity), n, p) for n, p in enumerate(people)), key=lambda x: x[:2])
    for done in range(generations):
        x, y = rng.sample(range(len(scored)), 2)
        child = crossover(scored[x][2], scored[y][2], lengths, capacity, rng)
        insort(scored, (fitness(child, lengths, capacity), population + done, child), key=lambda x: x[:2])
        scored.pop()
        if scored[0][0][0] <= least:
            return scored[0][2], done + 1
    return scored[0][2], generations


def _island(capacity: int, round_no: int):
    """One island's round: rows (bucket, island, origin, uid, length, bin) to its elite, with the elite's figures."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, island = int(pdf["bucket"].iloc[0]), int(pdf["island"].iloc[0])
        base = pdf[pdf["origin"] == pdf["origin"].min()].sort_values("uid")
        uids, lengths = base["uid"].to_numpy(), base["length"].tolist()
        seeds = []
        if round_no:
            for _, own in pdf.groupby("origin", sort=True):
                own = own.sort_values("uid")
                groups: dict[int, list[int]] = {}
                for i, b in enumerate(own["bin"].tolist()):
                    groups.setdefault(b, []).append(i)
                seeds.append(list(groups.values()))
        elite, crossed = evolve(lengths, capacity, seeds, random.Random(f"{bucket} {island} {round_no}"))
        bins, fills = np.zeros(len(lengths), dtype=np.int32), np.zeros(len(lengths), dtype=np.int64)
        for b, own in enumerate(elite):
            bins[own], fills[own] = b, sum(lengths[i] for i in own)
        n, f = fitness(elite, lengths, capacity)
        return pd.DataFrame({"bucket": bucket, "island": island, "uid": uids, "length": lengths, "bin": bins, "fill": fills, "n_bins": n, "fitness": f, "crossed": crossed})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, length) to (uid, length, sequence_id): sequences of at most ``capacity``; a sequence's id is its least uid."""
    done: list[DataFrame] = []
    left = items.where(F.col("length") < capacity)
    done.append(items.where(F.col("length") >= capacity).select("uid", "length", F.col("uid").alias("sequence_id")))
    (count, total), level = left.agg(F.count("*"), F.sum("length")).first(), 0
    while count:
        buckets = max(1, min(-(-count // BUCKET), total // (BUCKET_BINS * capacity)))
        dealt = left.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(buckets)).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("origin"), "uid", "length", F.lit(0).alias("bin"))
        for r in range(ROUNDS):
            elite = dealt.groupBy("bucket", "island").applyInPandas(_island(capacity, r), "bucket bigint, island int, uid bigint, length bigint, bin int, fill bigint, n_bins int, fitness double, crossed int")
            elite = write_out(elite, "elite")
            goes = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("to")
            dealt = elite.select("bucket", goes, F.col("island").alias("origin"), "uid", "length", "bin").withColumnRenamed("to", "island")
        best = elite.groupBy("bucket").agg(F.min(F.struct("n_bins", "fitness", "island")).alias("best")).select("bucket", F.col("best.island").alias("island"))
        kept = elite.join(best, ["bucket", "island"])
        named = kept.select("uid", "length", "bucket", "fill", F.min("uid").over(Window.partitionBy("bucket", "bin")).alias("sequence_id"))
        least_filled = Window.partitionBy("bucket").orderBy("fill", "sequence_id")  # bounded by the bucket's size
        goes = (F.count("*").over(least_filled) <= HANDED * F.count("*").over(Window.partitionBy("bucket"))) | (F.rank().over(least_filled) == 1)
        named = write_out(named.select("uid", "length", "sequence_id", goes.alias("goes")), "packed")
        if buckets == 1:
            done.append(named.drop("goes"))
            break
        done.append(named.where("not goes").drop("goes"))
        left = named.where("goes").select("uid", "length")
        (count, total), level = left.agg(F.count("*"), F.sum("length")).first(), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = write_out(rows.mapInArrow(*_pieces(tokenizer or default_tokenizer(), capacity, end_id)).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity).select("uid", "sequence_id")
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(placed, "uid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
