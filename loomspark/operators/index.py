"""A stored inverted index with block maxima: built once, updated by chunk id, read by the asked terms' folders only.

The index is a snapshot table of segments, one for each ingest. A segment has

* entries: ids and lengths of a batch of documents of a cell (a hash of the id), with the batch's terms and the places of
  their documents, or that a document is gone; a cell of very many words has several batches;
* blocks: the postings of a term in a batch, each a document's place there and its frequency, as bytes, with the greatest
  frequency and the least length, from which follows the greatest BM25 contribution under any statistics of the corpus;
* what replaced documents take from the terms' document frequencies and from the totals; what added ones give stands in
  the blocks' and entries' own counts.

Texts are dealt out by cell, once; words, postings and entries stay in the task that they come from, which writes them. No
posting is a value of its own to Spark, and none holds an id or a length, which stand in its batch's entry.
Blocks and frequencies lie in folders by a hash of the term. A search reads the headers of the asked terms' blocks (no
postings), sums each question's bounds by cell, reads the ``FIRST`` most promising cells of each question, and then only
cells whose bound reaches the last place found there. A cell's postings are scored for a block of questions at once, and
give the best ``k`` of each question. Postings of documents that a later segment replaces are left out. All parts of a
segment are one commit: readers see all of an ingest or nothing of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.operators.search import B, K1, LEAST_IDF, WEIGHTS, fuse_lists, ranked
from loomspark.sources.shared import stored
from loomspark.sources.snapshots import SnapshotTable

#: Folders by term, documents of a cell (on average), cells that are read first, questions of a block.
BUCKETS, CELL, FIRST, QUESTIONS = 32, 2048, 2, 512
#: Words that are made postings at once, but for a longer document.
WORDS = 2_000_000
#: Replaced documents (a number each) that are broadcast to the batches that hold them.
REPLACED = 10_000_000
#: A posting in a block's bytes: the document's place in its batch and the frequency.
POSTING = np.dtype([("at", "<i4"), ("f", "<f8")])


def _made(id_type: str) -> str:
    """What a task makes of documents: rows of blocks and entries."""
    return f"kind string, term string, cell bigint, batch bigint, n bigint, posts binary, max_f double, min_length bigint, ids array<{id_type}>, lengths array<bigint>, length bigint, terms array<string>, df binary, places binary"


def _schema(id_type: str) -> str:
    return f"bucket int, gone boolean, {_made(id_type)}"


def _contribution(f: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _idf(n_docs: Column, df: Column) -> Column:
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float] = WEIGHTS, id_type: str = "bigint", cells: int | None = None):
        """``weights``: the text columns and what an occurrence in each counts; ``cells``: the number of cells of a new index."""
        self.spark, self.weights, self.id_type = spark, weights, id_type
        self.table = SnapshotTable(spark, path, _schema(id_type), folders=("kind", "bucket"))
        self._cells = cells

    def _rows(self, kind: str, **columns: Column) -> list[Column]:
        """A row of the table's schema of one kind."""
        return [(columns.get(f.name, F.lit(kind) if f.name == "kind" else F.lit(None)).cast(f.dataType)).alias(f.name) for f in self.table.schema]

    def cells(self) -> int:
        """The number of cells, which all segments share; it is stored with the totals."""
        if self._cells is None:
            self._cells = self.table.read().where("kind = 'total'").agg(F.max("cell")).first()[0] or 1
        return self._cells

    def _cell(self, cells: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(cells))

    def _segment(self, chunks: DataFrame, cells: int) -> DataFrame:
        """Rows of blocks and entries of chunks (id and the text columns; of equal ids one), in one pass over each text."""
        dealt = chunks.withColumn("cell", self._cell(cells)).repartition("cell").sortWithinPartitions("cell", "id")
        taken = dealt.select("cell", "id", *(words(F.lower(F.col(c))).alias(f"w{i}") for i, c in enumerate(self.weights)))
        return self._whole(taken.mapInArrow(_postings_of(list(self.weights.values())), _made(self.id_type)))

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Made rows in the table's schema."""
        bucket, gone = F.when(F.col("kind") == "block", self._bucket()), F.when(F.col("kind") == "entry", False)
        return rows.withColumns({"bucket": bucket, "gone": gone}).select(*self.table.schema.fieldNames())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")

    def entries(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, length, version, cell, batch, at) of the documents of the index (of those in ``ids``: id), each as its last segment has it."""
        rows = self.table.read(versions=True).where("kind = 'entry'").select("version", "cell", "batch", "gone", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "d"))
        rows = rows.select(F.col("d.ids").alias("id"), F.struct("gone", F.col("d.lengths").alias("length"), "version", "cell", "batch", "at").alias("e"))
        if ids is not None:
            rows = rows.join(ids, "id", "left_semi")
        last = rows.groupBy("id").agg(F.max_by("e", "e.version").alias("e"))
        return last.where("not e.gone").select("id", "e.length", "e.version", "e.cell", "e.batch", "e.at")

    def ingest(self, chunks: DataFrame, removed: DataFrame | None = None, name: str | None = None) -> int:
        """Add or replace chunks (id and the text columns; of equal ids in one ingest any one) and take out ids (id); the new version.

        ``name``: that of the segment; an ingest that is repeated under its name leaves the same index.
        """
        name = name or uuid.uuid4().hex
        if any(r[0] == name for r in self.table.live().where(F.col("part") == name).select("part").collect()):
            return self.table.version()
        chunks = chunks.select(F.col("id").cast(self.id_type).alias("id"), *self.weights).where("id is not null")
        version = self.table.version()
        if self._cells is None and not version:
            self._cells = max(1, -(-chunks.select("id").distinct().count() // CELL))
        cells = self.cells()
        rows = self._segment(chunks, cells)
        rows = rows.unionByName(self.spark.range(1).select(*self._rows("total", cell=F.lit(cells))))
        if version:  # what is replaced or goes
            added = chunks.select("id").distinct()
            touched = added
            if removed is not None:
                own = removed.select(F.col("id").cast(self.id_type).alias("id")).where("id is not null").distinct().join(added, "id", "left_anti")
                rows = rows.unionByName(own.select(*self._rows("entry", cell=self._cell(cells), ids=F.array("id"), lengths=F.array(F.lit(0)), gone=F.lit(True))))
                touched = touched.unionByName(own)
            held = self.table.read(versions=True)
            old = stored(self.entries(touched).select("length", "version", "cell", "batch", "at"), "replaced")
            places = old.groupBy("version", "cell", "batch").agg(F.collect_list("at").alias("taken"))  # of a batch's documents at most
            if old.count() <= REPLACED:
                places = F.broadcast(places)
            counts = held.where("kind = 'entry' AND not gone").select("version", "cell", "batch", "terms", "df", "places").join(places, ["version", "cell", "batch"])
            df = counts.select("terms", "df", "places", "taken").mapInArrow(_taken_counts(), "term string, n bigint").groupBy("term").agg((-F.sum("n")).alias("n"))
            df = df.select(*self._rows("df", bucket=self._bucket(), term=F.col("term"), n=F.col("n")))
            total = old.agg((-F.count("*")).alias("n"), (-F.sum("length")).alias("length")).select(*self._rows("total", n=F.col("n"), length=F.col("length"), cell=F.lit(cells)))
            rows = rows.unionByName(df).unionByName(total)
        return self.table.commit(rows.sortWithinPartitions("kind", "bucket", "term"), name)

    def compact(self, cells: int | None = None) -> int:
        """All segments as one, with as many cells as the documents ask for."""
        parts = [r[0] for r in self.table.live().select("part").collect()]  # one a segment
        own = self.table.read(versions=True)
        cells = cells or max(1, -(-self.entries().count() // CELL))
        held = own.where("kind = 'block' OR kind = 'entry'").select("cell", *_of_cell(block=("term", "version", "batch", "posts"), entry=("version", "batch", "gone", "ids", "lengths")))
        docs = held.groupBy("cell").applyInArrow(_documents_of(), f"id {self.id_type}, length bigint, terms array<string>, fs array<double>")
        dealt = docs.withColumn("cell", self._cell(cells)).repartition("cell").sortWithinPartitions("cell", "id").select("cell", "id", "terms", "length", "fs")
        whole = self._whole(dealt.mapInArrow(_postings_of(None), _made(self.id_type))).unionByName(self.spark.range(1).select(*self._rows("total", cell=F.lit(cells))))
        version = self.table.commit(whole.sortWithinPartitions("kind", "bucket", "term"), f"compact-{uuid.uuid4().hex}", parts)
        self._cells = cells
        return version

    # Searching

    def asked(self, terms: DataFrame, own: DataFrame | None = None) -> DataFrame:
        """(query_id, term, bucket, n_terms, idf, mean) of question terms (query_id, term, n_terms) that the index holds."""
        own = self.table.read(versions=True) if own is None else own
        totals = own.where("kind IN ('entry', 'total')").agg(F.sum("n").alias("n_docs"), (F.sum("length") / F.sum("n")).alias("mean")).first()
        n_docs, mean = totals["n_docs"] or 0, totals["mean"] or 1.0
        wanted = terms.select("query_id", "term", "n_terms", self._bucket().alias("bucket"))
        df = own.where("kind IN ('block', 'df')").join(F.broadcast(wanted.select("bucket", "term").distinct()), ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("n").alias("df")).where("df > 0")
        return wanted.join(df, ["bucket", "term"]).select("query_id", "term", "bucket", "n_terms", _idf(F.lit(n_docs), F.col("df")).alias("idf"), F.lit(float(mean)).alias("mean"))

    def bounds(self, asked: DataFrame, strict: bool = False, own: DataFrame | None = None) -> DataFrame:
        """(query_id, cell, bound, strict: whether it has all terms of the question; ``strict``: only those): the greatest score that a document of the cell can have, from the blocks' headers alone."""
        own = self.table.read() if own is None else own
        # A term's idf is that of every question.
        heads = own.where("kind = 'block'").select("bucket", "term", "cell", "max_f", "min_length").join(F.broadcast(asked.select("bucket", "term", "idf", "mean").distinct()), ["bucket", "term"])
        parts = heads.groupBy("term", "cell").agg(F.max(_contribution(F.col("max_f"), F.col("min_length"), F.col("mean"), F.col("idf"))).alias("part"))
        cells = asked.select("query_id", "term", "n_terms").join(parts, "term").groupBy("query_id", "cell").agg(F.sum("part").alias("bound"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
        cells = cells.select("query_id", "cell", "bound", (F.col("n") == F.col("n_terms")).alias("strict"))
        return cells.where("strict") if strict else cells

    def _scores(self, asked: DataFrame, cells: DataFrame, k: int, kinds: tuple[bool, ...], allowed: DataFrame | None, own: DataFrame) -> DataFrame:
        """(query_id, id, score, strict): the best ``k`` documents of each (query_id, cell), of each kind: strict or not."""
        blocks = max(1, -(-asked.select("query_id").distinct().count() // QUESTIONS))
        group = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("group")
        chosen = cells.select("query_id", "cell")
        questions = asked.groupBy("query_id").agg(F.first("n_terms").alias("n_terms"), F.collect_list("term").alias("terms"))
        left = chosen.join(questions, "query_id").select(group, "cell", F.struct("query_id", "n_terms", "terms").alias("ask"))
        used = chosen.join(asked, "query_id").select(group, "cell", "term").distinct()
        held = chosen.select(group, "cell").distinct()
        known = asked.select("bucket", "term", "idf", "mean").distinct()  # a term's idf is that of every question
        posts = own.where("kind = 'block'").select("bucket", "term", "cell", "version", "batch", "posts").join(F.broadcast(known), ["bucket", "term"]).join(used, ["cell", "term"])
        docs = own.where("kind = 'entry'").select("cell", "version", "batch", "gone", "ids", "lengths").join(held, "cell")
        block, entry = F.struct("term", "idf", "mean", "version", "batch", "posts"), F.struct("version", "batch", "gone", "ids", "lengths")
        rows = left
        for side in (posts.select("group", "cell", block.alias("block")), docs.select("group", "cell", entry.alias("entry"))):
            rows = rows.unionByName(side, allowMissingColumns=True)
        if allowed is not None:
            only = allowed.select(F.col("id").cast(self.id_type).alias("id")).distinct().withColumn("cell", self._cell(self.cells())).join(held, "cell")
            rows = rows.unionByName(only.select("group", "cell", F.col("id").alias("allowed")), allowMissingColumns=True)
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {self.id_type}, score double, strict boolean"
        return rows.groupBy("group", "cell").applyInArrow(_score_cell(k, kinds, allowed is not None), schema)

    def hits(self, terms: DataFrame, k: int, kinds: tuple[bool, ...], allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, strict): among them the ``k`` best documents of each question of each kind: strict or not.

        The kinds share the cells that are read: a cell counts where its bound reaches the last place of either. What
        several steps read is stored, in as few files as its size asks for.
        """
        own = self.table.read(versions=True)
        asked = stored(self.asked(terms, own), "asked")
        cells = stored(self.bounds(asked, False, own), "cells")
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cell")

        def of_kind(rows: DataFrame, strict: bool) -> DataFrame:
            return rows.where("strict") if strict else rows

        def together(parts: list[DataFrame]) -> DataFrame:
            return stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct(), "chosen")

        chosen = together([of_kind(cells, s).withColumn("at", F.row_number().over(order)).where(F.col("at") <= FIRST).select("query_id", "cell") for s in kinds])
        first = stored(self._scores(asked, chosen, k, kinds, allowed, own), "first")
        others = cells.join(chosen, ["query_id", "cell"], "left_anti")
        rest = []
        for s in kinds:
            last = ranked(of_kind(first, s), limit=k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= k)
            rest.append(of_kind(others, s).join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("bound") >= F.col("last") - 1e-8)).select("query_id", "cell"))
        return first.unionByName(self._scores(asked, together(rest), k, kinds, allowed, own))

    def top_k(self, terms: DataFrame, k: int, strict: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, strict, rank): the ``k`` best documents of each question by BM25.

        ``strict``: only documents with all terms of the question; ``allowed``: only these ids (statistics stay those of
        the whole corpus).
        """
        return ranked(self.hits(terms, k, (strict,), allowed), limit=k)


def _of_cell(**kinds: tuple[str, ...]) -> list[Column]:
    """A struct of columns for each kind of row, null in rows of other kinds."""
    return [F.when(F.col("kind") == kind, F.struct(*columns)).alias(kind) for kind, columns in kinds.items()]


# Functions of tasks are made by others, so that Spark sends them whole: executors need not have this package.


def _sizes_of() -> Callable[[pa.ListArray], np.ndarray]:
    def sizes(lists: pa.ListArray) -> np.ndarray:
        return pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)

    return sizes


def _postings_of(weights: list[float] | None):
    """Documents, cell after cell, each by id, to rows of blocks and entries; of equal ids one.

    Documents are (cell, id, the words of each column); without ``weights`` (cell, id, distinct terms, length, their frequencies).
    """

    sizes = _sizes_of()

    def cut(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
        """An array's bytes, cut before each of ``starts`` (the last is the end)."""
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                both = batch.select(["cell", "id"])
                after = pa.concat_arrays([(both if last is None else last).column("id").slice(0, 1), both.column("id").slice(0, len(both) - 1)])
                before = pa.concat_arrays([(both if last is None else last).column("cell").slice(0, 1), both.column("cell").slice(0, len(both) - 1)])
                new = pc.or_(pc.not_equal(after, both.column("id")), pc.not_equal(before, both.column("cell"))).to_numpy(zero_copy_only=False).copy()
                new[0] |= last is None
                last = both.slice(len(both) - 1)
                yield batch if new.all() else batch.filter(pa.array(new))

    def held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Documents of one cell, of about ``WORDS`` words at most."""
        lists = batch.columns[2:] if weights else batch.columns[2:3]
        cell, words = batch.column("cell").to_numpy(), np.cumsum(sum(map(sizes, lists)))
        start = 0
        while start < len(cell):
            stop = min(np.searchsorted(words, (words[start - 1] if start else 0) + WORDS, "right"), start + np.argmax(np.append(cell[start:] != cell[start], True)))
            stop = max(start + 1, int(stop))
            yield batch.slice(start, stop - start)
            start = stop

    def rows_of(docs: pa.RecordBatch, number: int) -> Iterator[dict]:
        ids, n = docs.column("id"), len(docs)
        lists = docs.columns[2:] if weights else docs.columns[2:3]
        by_column = [sizes(c) for c in lists]
        words = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
        doc = np.concatenate([np.repeat(np.arange(n), own) for own in by_column])
        key = words.indices.to_numpy().astype(np.int64) * n + doc  # by term, then document
        if weights:
            lengths = sum(by_column)
            key = np.sort(key * len(by_column) + np.repeat(np.arange(len(by_column)), [own.sum() for own in by_column]))
            key, column = np.divmod(key, len(by_column))
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            f, key = np.add.reduceat(np.asarray(weights, dtype=np.float64)[column], new) if len(new) else np.zeros(0), key[new]
        else:
            order = np.argsort(key)
            lengths, f, key = docs.column("length").to_numpy(), docs.column("fs").flatten().to_numpy()[order], key[order]
        term, doc = np.divmod(key, n)
        starts, posts = np.searchsorted(term, np.arange(len(words.dictionary) + 1)), np.empty(len(key), POSTING)
        posts["at"], posts["f"] = doc, f
        cell, m = docs.column("cell")[0], len(starts) - 1
        if m:
            yield {
                "kind": pa.repeat("block", m), "term": words.dictionary, "cell": pa.repeat(cell, m), "batch": pa.repeat(number, m), "n": pa.array(np.diff(starts)), "posts": cut(posts, starts),
                "max_f": pa.array(np.maximum.reduceat(f, starts[:-1])), "min_length": pa.array(np.minimum.reduceat(lengths[doc], starts[:-1])),
            }
        yield {
            "kind": pa.array(["entry"]), "cell": pa.repeat(cell, 1), "batch": pa.array([number]), "n": pa.array([n]), "length": pa.array([int(lengths.sum())]),
            "ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), "lengths": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths, pa.int64())),
            "terms": pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), words.dictionary), "df": pa.array([np.diff(starts).astype("<i4").tobytes()]), "places": pa.array([doc.astype("<i4").tobytes()]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for batch in once(batches):
            id_type = batch.schema.field("id").type
            lists = {"ids": pa.list_(id_type), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.string())}
            others = {"kind": pa.string(), "term": pa.string(), "posts": pa.binary(), "df": pa.binary(), "places": pa.binary(), "max_f": pa.float64()} | lists
            names = ("kind", "term", "cell", "batch", "n", "posts", "max_f", "min_length", "ids", "lengths", "length", "terms", "df", "places")
            schema = pa.schema([(c, others.get(c, pa.int64())) for c in names])
            for docs in held(batch):
                cell = docs.column("cell")[0].as_py()
                last, number = cell, number + 1 if cell == last else 0
                for own in rows_of(docs, number):
                    yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(len(own["kind"]), f.type) for f in schema], schema=schema)

    return run


def _taken_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(terms, df, places, taken) of batches of documents to (term, n): in how many of the taken documents."""
        for batch in batches:
            for terms, df, places, taken in zip(*batch.columns, strict=True):
                at, n = np.frombuffer(places.as_buffer(), "<i4"), np.frombuffer(df.as_buffer(), "<i4")
                if len(n):
                    gone = np.zeros(at.max() + 1, dtype=np.int64)
                    own = taken.values.to_numpy()
                    gone[own[own < len(gone)]] = 1  # documents behind it have no words
                    found = np.add.reduceat(gone[at], np.append(0, np.cumsum(n)[:-1]))
                    met = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([terms.values.take(pa.array(met)), pa.array(found[met])], names=["term", "n"])

    return run


def _cell_documents():
    sizes_of = _sizes_of()

    def documents(entries: pa.StructArray, blocks: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a cell's entries: ids, lengths and whether a document is the last of its id and not gone; of its blocks: sizes,
        the postings' documents (numbers of ids) and frequencies."""
        sizes, ids = sizes_of(entries.field("ids")), entries.field("ids").flatten()
        lengths, versions = entries.field("lengths").flatten().to_numpy(), entries.field("version").to_numpy()
        live = np.repeat(~entries.field("gone").to_numpy(zero_copy_only=False), sizes)
        if len(np.unique(versions)) > 1:
            version, one = np.repeat(versions, sizes), ids.dictionary_encode()
            last = np.zeros(len(one.dictionary), dtype=np.int64)
            np.maximum.at(last, one.indices.to_numpy(), version)
            live &= version == last[one.indices.to_numpy()]
        batches = zip(versions.tolist(), entries.field("batch").to_pylist(), strict=True)
        base = dict(zip(batches, (np.cumsum(sizes) - sizes).tolist(), strict=True))
        own = blocks.field("posts").to_pylist()
        n = np.array([len(p) // POSTING.itemsize for p in own], dtype=np.int64)
        posts = np.frombuffer(b"".join(own), POSTING)
        starts = np.array([base[b] for b in zip(blocks.field("version").to_pylist(), blocks.field("batch").to_pylist(), strict=True)], dtype=np.int64)
        return ids, lengths, live, n, posts["at"] + np.repeat(starts, n), posts["f"]

    return documents


def _documents_of():
    documents = _cell_documents()

    def run(rows: pa.Table) -> pa.Table:
        """A cell's blocks and entries to its live documents: (id, length, terms, fs)."""
        blocks, entries = (rows.column(c).combine_chunks().drop_null() for c in ("block", "entry"))
        ids, lengths, live, n, at, f = documents(entries, blocks)
        place, kept = np.cumsum(live) - 1, live[at]
        term, doc, f = np.repeat(np.arange(len(n)), n)[kept], place[at[kept]], f[kept]
        order = np.argsort(doc, kind="stable")
        ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=int(live.sum())))), pa.int32())
        terms, fs = pa.ListArray.from_arrays(ends, blocks.field("term").take(pa.array(term[order]))), pa.ListArray.from_arrays(ends, pa.array(f[order]))
        return pa.table({"id": ids.filter(pa.array(live)), "length": pa.array(lengths[live]), "terms": terms, "fs": fs})

    return run


def _score_cell(k: int, kinds: tuple[bool, ...], only_allowed: bool):
    """A cell's questions with their terms, blocks and entries to the best ``k`` documents of each question, of each kind: strict or not."""
    documents, sizes_of = _cell_documents(), _sizes_of()

    def run(rows: pa.Table) -> pa.Table:
        types = (rows.schema.field("ask").type.field("query_id").type, rows.schema.field("entry").type.field("ids").type.value_type, pa.float64(), pa.bool_())
        asks, blocks, entries = (rows.column(c).combine_chunks().drop_null() for c in ("ask", "block", "entry"))
        docs, lengths, live, sizes, at, f = documents(entries, blocks)
        if only_allowed:
            live &= pc.is_in(docs, rows.column("allowed").combine_chunks().drop_null()).to_numpy(zero_copy_only=False)
        # Postings of live documents by term.
        terms = blocks.field("term").dictionary_encode()
        term = np.repeat(terms.indices.to_numpy(), sizes)
        idf, mean = (np.repeat(blocks.field(c).to_numpy(), sizes) for c in ("idf", "mean"))
        order = np.argsort(term, kind="stable")
        order = order[live[at[order]]]
        at, f, idf, mean = at[order], f[order], idf[order], mean[order]
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[at] / mean))
        starts = np.searchsorted(term[order], np.arange(len(terms.dictionary) + 1)).tolist()
        # Terms that the cell has not are missing here.
        own_of = pc.fill_null(pc.index_in(asks.field("terms").flatten(), terms.dictionary), -1).to_numpy().tolist()
        out: list[list] = [[], [], [], []]
        stop = 0
        for q, n_terms, n in zip(asks.field("query_id"), asks.field("n_terms").to_pylist(), sizes_of(asks.field("terms")).tolist(), strict=True):
            start, stop = stop, stop + n
            own = [slice(starts[t], starts[t + 1]) for t in own_of[start:stop] if t >= 0]
            where = np.concatenate([at[s] for s in own] or [at[:0]])
            if not len(where):
                continue
            score, met = np.bincount(where, np.concatenate([part[s] for s in own]), len(docs)), np.bincount(where, minlength=len(docs))
            best = np.zeros(len(docs), dtype=bool)
            for strict in kinds:
                hit = np.flatnonzero(met == n_terms if strict else met > 0)
                if len(hit) > k:
                    # Near ties are parted by their ids when all cells meet.
                    hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-8]
                best[hit] = True
            hit = np.flatnonzero(best)
            out[0].append(pa.repeat(q, len(hit)))
            out[1].append(docs.take(pa.array(hit)))
            out[2].append(pa.array(score[hit]))
            out[3].append(pa.array(met[hit] == n_terms))
        return pa.Table.from_arrays([pa.chunked_array(c, t) for c, t in zip(out, types, strict=True)], names=["query_id", "id", "score", "strict"])

    return run


def search_lists(index: InvertedIndex, terms: DataFrame, k: int = 60, limit: int = 10, pool: int = 30) -> DataFrame:
    """As ``search.search_mode``, from one search of the index for both lists, each with its own limit: the strict one and the loose one."""
    hits = stored(index.hits(terms, pool, (True, False)), "hits")
    return fuse_lists(ranked(hits.where("strict"), limit=pool), ranked(hits, limit=pool), terms, k, limit)
