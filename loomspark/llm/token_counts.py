"""Operator 9: token counts by trie-shared dynamic programming over a unigram vocabulary.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, each with the word mark ``\\u2581`` before it. A piece's score
is its log-probability; a pre-token's segmentation is the one of the highest sum (the fewest pieces among equals). The
vocabulary is a file of a public tokenizer, whose path is a parameter, and nothing is trained: where the file states
ranks only, a piece's probability is that of Zipf's law at its rank. A character that no piece covers counts one token a
UTF-8 byte (byte fallback).

1. One pass over the texts gives the distinct pre-tokens of the whole table with their numbers.
2. Sorted and dealt by ranges, so that words with a common prefix meet, they are inserted into tries. A trie is walked
   depth first: each node's forward score is computed once for all words that share its prefix and dropped when they are
   through, and a terminal's number of pieces is stored with its word.
3. A second pass over the texts adds up stored numbers. Those of the ``FREQUENT`` most frequent words (a bounded table,
   broadcast as Arrow) cover nearly all occurrences; a text's other words are shuffled to their stored numbers.

Null and empty texts count 0; rows with a null id and repeated rows are counted each; very long texts are counted whole;
extra columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import write_out

MARK = "▁"
#: Words whose stored numbers are broadcast, and distinct words that a task holds before it hands them on.
FREQUENT = 300_000
HELD = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def load_scores(path: str) -> dict[str, float]:
    """Log-probabilities by Zipf's law over the ranks of the ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class PrefixTrie:
    """The trie of words that come in sorted order, of which only the path to the last word is held.

    A word goes on from the prefix that it shares with the one before it, so each prefix is scored once.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.word = ""
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]
        self.nodes = 0

    def count(self, word: str) -> int:
        """The number of pieces of ``word``'s best segmentation; inserts the word."""
        best, pieces, scores, longest = self.best, self.pieces, self.scores, self.longest
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            n_bytes = len(word[d - 1].encode("utf-8", "replace"))
            top, least = best[d - 1] + n_bytes * self.byte_score, pieces[d - 1] + n_bytes
            for start in range(max(0, d - longest), d):
                s = scores.get(word[start:d])
                if s is not None:
                    v, c = best[start] + s, pieces[start] + 1
                    if v > top or (v == top and c < least):
                        top, least = v, c
            best.append(top)
            pieces.append(least)
        self.nodes += len(word) - shared
        self.word = word
        return pieces[-1]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task's texts with their numbers, handed on before too many are held."""
    held: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update((text.as_py() or b"").split())
            if len(held) > HELD:
                yield rows()
                held = Counter()
    if held:
        yield rows()


def _score(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(load_scores(path))
        for batch in batches:
            counts = [trie.count(MARK + w.decode("utf-8", "replace")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["word", "n", "tokens"])

    return run, "word binary, n bigint, tokens bigint"


def stored_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, tokens) of every distinct pre-token of a table of binary texts."""
    words = write_out(texts.mapInArrow(_distinct, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tries = words.repartitionByRange("word").sortWithinPartitions("word")
    return write_out(tries.mapInArrow(*_score(vocabulary)), "tokens")


def _add(frequent):
    """Rows (row, doc_id, n_pretokens, n_tokens) of the texts by frequent words, and rows (row, word, times) of the others."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("word", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(frequent.value).read_all()
        stored = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        for batch in batches:
            sums, rest = [], []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                try:
                    total = sum(map(stored.__getitem__, words))
                except KeyError:
                    total = 0
                    others: dict[bytes, int] = {}
                    for w in words:
                        n = stored.get(w)
                        if n is None:
                            others[w] = others.get(w, 0) + 1
                        else:
                            total += n
                    rest += [(row, None, n, None, w) for w, n in others.items()]
                sums.append((row, doc_id, len(words), total, None))
            rows = sums + rest
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run, "row bigint, doc_id bigint, n_pretokens bigint, n_tokens bigint, word binary"


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    stored = stored_counts(rows.select("text"), vocabulary or default_vocabulary())
    top = stored.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "tokens").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as out:
        out.write_table(top)
    frequent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    added = write_out(rows.mapInArrow(*_add(frequent)), "sums")
    others = added.where("word is not null").select("row", "word", F.col("n_pretokens").alias("times")).join(stored.select("word", "tokens"), "word")
    others = others.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    out = added.where("word is null").join(others, "row", "left")
    return out.select("doc_id", "n_pretokens", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
