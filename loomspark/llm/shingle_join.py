"""Operator 6: exact Jaccard self-join on word shingles by T-occurrence search (DivideSkip).

A document's set holds the distinct ``k``-word shingles of its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; a text
of fewer words is one shingle, a text without words has the empty set and links with nothing. Two documents link when
``100 * |intersection| >= percent * |union|``. Every link is found:

1. one pass over the texts gives each row's set size and 128-bit set hash (documents with equal sets form a class, which
   stands for all its rows afterwards) and a count sketch of ``CELLS`` cells of all shingles;
2. shingles are ordered rarest cell first, ties by hash. Two linked sets share at least ``s`` shingles among the first
   ``n - ceil(percent * n / 100) + s`` of each, for any ``s`` up to the needed overlap (true of any order; the sketch only
   makes lists short). Such prefix postings (shingle, class, size) are shuffled by shingle. Lists of up to ``PAIRS``
   classes give all their pairs that sizes allow; longer lists are set aside (those of very frequent cells before they
   are shuffled). A linked pair meets ``s = SHARED`` times in all, hence on short lists at least ``s`` less the number of
   long ones that either is on; only classes on ``s`` long lists themselves can be linked without a short list in common,
   and they are tied together by the long lists that they share, by stars over classes of like size;
3. components of that candidate graph hold every link within themselves, so each is searched alone: its sets, once
   per class, meet in a task, and documents in the order of size query the inverted lists of those before them.
   ``divide_skip`` heap-merges the short lists, binary-probes the long ones and keeps whoever reaches the required
   overlap. A component that has grown large gets lists of its own, which its own members need not search;
4. a candidate component of over ``BLOCK`` shingles is dealt to sub-blocks, and each pair of sub-blocks is searched in
   its own task, so that no group of any size meets in one task; the links are then joined by connected components.

Null ids link with nothing (component null); repeated rows get equal results; texts of any length are read whole; extra
columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, byte_view, forget, write_out
from loomspark.llm.components import connected_components
from loomspark.llm.textbytes import mix, shingle_sets

CELLS = 1 << 20
CHUNK = 1 << 12
PAIRS = 24
SHARED = 16
BLOCK = 1_000_000
#: A cell counts as very frequent from so many shingles on, and from so many times the mean of all cells.
FREQUENT, FREQUENT_TIMES = 4096, 64
LARGE = 64
ARRAYS_FROM = 1024


def least_overlap(n: int, percent: int) -> int:
    """The least intersection that a set of n elements has with any set that it links with."""
    return -(-percent * n // 100)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    a = mix(np.array([u.sum(dtype=np.uint64) + np.uint64(len(u))], dtype=np.uint64))
    b = np.array([mix(u * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(len(u))).sum(dtype=np.uint64)], dtype=np.uint64)
    return int(mix(a + b).view(np.int64)[0]), int(b.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(column)
    for i, j in bounded_batches(texts):
        data, offsets = byte_view(texts.slice(i, j - i))
        yield from zip(range(i, j), shingle_sets(data, offsets, k), strict=True)


def _survey(k: int):
    """Rows of documents (doc_id, n, node, check), then rows of the task's sketch (chunk, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("chunk", pa.int32()), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            n, node, check = [], [], []
            held: list[np.ndarray] = []
            for _, s in _sets(batch, 1, k):
                h = set_hash(s)
                n.append(len(s))
                node.append(h[0])
                check.append(h[1])
                held.append(s)
                if len(held) >= 512:
                    cells += np.bincount(np.concatenate(held) & (CELLS - 1), minlength=CELLS)
                    held = []
            if held:
                cells += np.bincount(np.concatenate(held) & (CELLS - 1), minlength=CELLS)
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))], schema=schema)
        if cells.any():
            m = CELLS // CHUNK
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, CELLS + 1, CHUNK), pa.int32()), pa.array(cells))
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 4 + [pa.array(np.arange(m), pa.int32()), counts], schema=schema)

    return run, "doc_id bigint, n bigint, node bigint, check bigint, chunk int, counts array<bigint>"


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch chunks of a task: at most CELLS / CHUNK rows whatever comes in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = v.values.to_numpy()
            total[c] = total[c] + v if c in total else v.astype(np.int64)
    if total:
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[c] for c in keys], pa.list_(pa.int64()))], names=["chunk", "counts"])


def _postings(k: int, percent: int, sketch):
    """(token, n, node, frequent): the prefix of each set."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("frequent", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cells = sketch.value
        bound = max(FREQUENT, FREQUENT_TIMES * float(cells.mean()))
        seen: set[int] = set()
        toks: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        held = 0

        def flush():
            reps = [len(t) for t in toks]
            own = np.concatenate(toks)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.repeat(np.array(sizes, dtype=np.int32), reps)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), reps)), pa.array(cells[own & (CELLS - 1)] >= bound)], schema=schema)

        for batch in batches:
            for _, s in _sets(batch, 0, k):
                if not len(s):
                    continue
                node = set_hash(s)[0]
                if node in seen:  # an exact copy in the same task adds nothing
                    continue
                seen.add(node)
                need = least_overlap(len(s), percent)
                p = len(s) - need + min(SHARED, need)
                toks.append(s[np.lexsort((s, cells[s & (CELLS - 1)]))[:p]])
                nodes.append(node)
                sizes.append(len(s))
                held += p
                if held >= 200_000:
                    yield flush()
                    toks, nodes, sizes, held = [], [], [], 0
        if toks:
            yield flush()

    return run, "token bigint, n int, node bigint, frequent boolean"


PAIR, LONG = 0, 1


def _meetings(percent: int):
    """Of postings sorted by (token, n, node): rows (PAIR, a, b, times met, times to meet) of short lists, and rows
    (LONG, token, node, n, 0) of long ones. A list may span batches."""
    names = ["kind", "a", "b", "met", "need"]

    def pairs(tok, n, node):
        out = []
        for lag in range(1, PAIRS):
            if len(tok) <= lag:
                break
            ok = (tok[lag:] == tok[:-lag]) & (100 * n[:-lag] >= percent * n[lag:])
            if ok.any():
                x, y = node[lag:][ok], node[:-lag][ok]
                out.append(np.stack((np.maximum(x, y), np.minimum(x, y), np.minimum(SHARED, -(-percent * n[:-lag][ok] // 100)))))
        if not out:
            return None
        e = np.concatenate(out, axis=1)
        e = e[:, np.lexsort((e[1], e[0]))]
        first = np.flatnonzero(np.concatenate(([True], (e[0][1:] != e[0][:-1]) | (e[1][1:] != e[1][:-1]))))
        met = np.diff(np.append(first, e.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), PAIR, dtype=np.int8)), pa.array(e[0][first]), pa.array(e[1][first]), pa.array(met), pa.array(e[2][first])], names=names)

    def long(tok, n, node):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tok), LONG, dtype=np.int8)), pa.array(tok), pa.array(node), pa.array(n), pa.array(np.zeros(len(tok), dtype=np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tok, n, node = (np.zeros(0, dtype=np.int64) for _ in range(3))
        known_long = None

        def ended(final: bool) -> Iterator[pa.RecordBatch]:
            """What the lists held so far give; the last one is kept back unless it is long already."""
            nonlocal tok, n, node, known_long
            keep = np.ones(len(tok), dtype=bool)
            keep[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            tok, n, node = tok[keep], n[keep], node[keep]
            starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            runs = np.diff(np.append(starts, len(tok)))
            is_long = np.repeat(runs > PAIRS, runs)
            if known_long is not None:
                is_long |= tok == known_long
            cut = len(tok) if final or is_long[-1] else starts[-1]
            known_long = tok[-1] if is_long[-1] else None
            at = is_long[:cut]
            if at.any():
                yield long(tok[:cut][at], n[:cut][at], node[:cut][at])
            if (got := pairs(tok[:cut][~at], n[:cut][~at], node[:cut][~at])) is not None:
                yield got
            tok, n, node = tok[cut:], n[cut:], node[cut:]

        held = 0
        for batch in batches:
            b = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
            frequent = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            if frequent.any():
                yield long(*(x[frequent] for x in b))
                b = [x[~frequent] for x in b]
            tok, n, node = (np.concatenate(x) for x in zip((tok, n, node), b, strict=True))
            held += len(b[0])
            if held >= 100_000 and len(tok):
                held = 0
                yield from ended(False)
        if len(tok):
            yield from ended(True)

    return run, "kind tinyint, a bigint, b bigint, met bigint, need bigint"


def candidate_edges(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges of a graph whose components hold every link within themselves."""
    key = F.when(F.col("frequent"), F.xxhash64("token", "node")).otherwise(F.col("token"))
    sorted_lists = postings.repartition(key).sortWithinPartitions("frequent", "token", "n", "node")
    met = write_out(sorted_lists.mapInArrow(*_meetings(percent)), "met")
    long = met.where(F.col("kind") == LONG).select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("met").alias("n"))
    on_long = long.groupBy("node").agg(F.count("*").alias("lists"), F.max("n").alias("n"))
    of = lambda end: on_long.select(F.col("node").alias(end), F.col("lists").alias(f"lists_{end}"))
    pairs = met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    excused = F.least(F.coalesce("lists_a", F.lit(0)), F.coalesce("lists_b", F.lit(0)))
    pairs = pairs.where(F.col("met") + excused >= F.col("need")).select("a", "b")

    part = lambda n: F.ceil(F.lit(percent) * n / 100)
    heavy = on_long.where(F.col("lists") >= F.least(F.lit(SHARED), part(part(F.col("n"))))).select("node")
    # Linked sets are of one band of sizes or of two that adjoin; each class is in the star of its band and of the next.
    band = F.floor(F.log("n") / (F.log(F.lit(100 / percent)) * (1 + 1e-9))) if percent < 100 else F.col("n")
    tied = long.join(heavy, "node").select("token", "node", F.explode(F.array(band, band + 1)).alias("band"))
    centre = tied.groupBy("token", "band").agg(F.min("node").alias("centre"))
    stars = tied.join(centre, ["token", "band"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return pairs.unionByName(stars)


def divide_skip(index: dict[int, array], tokens: list[int], need: int, skip: Callable[[int], bool] = lambda _: False) -> Iterator[tuple[int, int]]:
    """Entries that occur on at least ``need`` of the lists of ``tokens``, with their exact number of occurrences.

    The longest lists are set aside (fewer than ``need`` of them); an entry must then occur on the short lists at least
    ``need`` less their number. Short lists are heap-merged, long ones probed by binary search while the need can be met.
    Where the short lists are long too, the same is done on whole arrays: their entries are counted at once, and all
    entries that may still meet the need are probed together. Entries for which ``skip`` holds are passed over.
    """
    lists = [x for t in tokens if (x := index.get(t))]
    if need < 1 or len(lists) < need:
        return
    lists.sort(key=len)
    scale = len(lists[-1]).bit_length()
    n_long = int((need - 1) / (0.01 * scale + 1))
    short = lists[: len(lists) - n_long]
    if sum(map(len, short)) <= ARRAYS_FROM:
        long = lists[len(short) :]
        for entry, run in groupby(heapq.merge(*short)):
            count = sum(1 for _ in run)
            if count < need - n_long or skip(entry):
                continue
            left = n_long
            for x in long:
                if count + left < need:
                    break
                left -= 1
                at = bisect_left(x, entry)
                count += at < len(x) and x[at] == entry
            if count >= need:
                yield entry, count
        return
    left = int((need - 1) / (0.5 * scale + 1))  # counting costs less here than probing
    short, long = lists[: len(lists) - left], lists[len(lists) - left :]
    counts = np.bincount(np.concatenate([np.frombuffer(x, dtype=np.int32) for x in short]))
    entries = np.flatnonzero(counts >= need - left)
    counts = counts[entries]
    for x in long:
        if not len(entries):
            return
        left -= 1
        own = np.frombuffer(x, dtype=np.int32)
        counts = counts + (own[np.minimum(np.searchsorted(own, entries), len(own) - 1)] == entries)
        keep = counts + left >= need
        entries, counts = entries[keep], counts[keep]
    for entry, count in zip(entries.tolist(), counts.tolist(), strict=True):
        if not skip(entry):
            yield entry, count


def link_sets(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, a representative of its component of links. ``sets`` must be in the order of size."""
    parent = list(range(len(sets)))
    size = [1] * len(sets)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            x, y = min(x, y), max(x, y)
            parent[y] = x
            size[x] += size[y]

    def linked(common: int, x: int, y: int) -> bool:
        return 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common)

    small: dict[int, array] = {}
    members: dict[int, list[int]] = {}
    large: list[tuple[int, dict[int, array]]] = []
    for q, s in enumerate(sets):
        for hub, _ in large:
            if find(hub) != find(q) and linked(len(np.intersect1d(s, sets[hub], assume_unique=True)), q, hub):
                join(q, hub)
        tokens, need = s.tolist(), least_overlap(len(s), percent)
        for hub, index in [(-1, small), *large]:
            if hub < 0 or find(hub) != find(q):
                for x, common in divide_skip(index, tokens, need, lambda x: find(x) == find(q)):
                    if linked(common, q, x):
                        join(q, x)
                        if hub >= 0:  # one link joins q to all of it
                            break
        home = next((index for hub, index in large if find(hub) == find(q)), small)
        for t in tokens:
            if t in home:
                home[t].append(q)
            else:
                home[t] = array("i", (q,))
        if home is small:
            root = find(q)
            own = [x for r in {r for r in members if find(r) == root} for x in members.pop(r)] + [q]
            members[root] = own
            if len(own) >= LARGE:
                moved, index = set(members.pop(root)), {}
                for x in sorted(moved):
                    for t in sets[x].tolist():
                        index.setdefault(t, array("i")).append(x)
                for t in index:
                    if rest := [x for x in small[t] if x not in moved]:
                        small[t] = array("i", rest)
                    else:
                        del small[t]
                large.append((min(moved), index))
    return [find(x) for x in range(len(sets))]


def _search(percent: int):
    """Rows (key, node, doc_id, tokens) sorted by key: each key's sets are searched, and each gets its component's smallest doc_id."""

    def result(rows: dict[tuple[int, int], np.ndarray]):
        order = sorted(rows, key=lambda x: (len(rows[x]), x))
        roots = link_sets([rows[x] for x in order], percent)
        least: dict[int, int] = {}
        for (_, doc_id), r in zip(order, roots, strict=True):
            least[r] = min(least.get(r, doc_id), doc_id)
        return [node for node, _ in order], [doc_id for _, doc_id in order], [least[r] for r in roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, rows = None, {}
        out: list[tuple] = []

        def emit():
            cols = [np.concatenate(x) for x in zip(*[[np.array(c, dtype=np.int64) for c in r] for r in out], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "doc_id", "least"])

        for batch in batches:
            keys, nodes, ids, tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i, x in enumerate(keys):
                if x != key:
                    if rows:
                        out.append(result(rows))
                    key, rows = x, {}
                rows.setdefault((nodes[i], ids[i]), np.array(tokens[i].values))
            if out:
                yield emit()
                out = []
        if rows:
            out.append(result(rows))
        if out:
            yield emit()

    return run, "node bigint, doc_id bigint, least bigint"


def _own_sets(k: int):
    """Sets of the rows whose text has the class that the row was picked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            wanted = list(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))
            keep, sets, held = [], [], 0
            for i, s in _sets(batch, 5, k):
                if set_hash(s) == wanted[i]:
                    keep.append(i)
                    sets.append(s)
                    held += len(s)
                if sets and (held >= 500_000 or i + 1 == batch.num_rows):
                    own = batch.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(4)), pa.array(sets, pa.list_(pa.int64()))], names=["comp", "node", "doc_id", "parts", "tokens"])
                    keep, sets, held = [], [], 0

    return run, "comp bigint, node bigint, doc_id bigint, parts int, tokens array<bigint>"


def shingle_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = write_out(rows.mapInArrow(*_survey(k)), "survey")
    docs_seen = survey.where("chunk is null").select("doc_id", "n", "node", "check")
    sketch = np.zeros(CELLS, dtype=np.int32)
    chunks = survey.where("chunk is not null").select("chunk", "counts").repartition(8, "chunk").mapInArrow(_add_chunks, "chunk int, counts array<bigint>")
    for chunk, counts in chunks.collect():  # CELLS counters in all, whatever the size of the input
        sketch[chunk * CHUNK : (chunk + 1) * CHUNK] = np.minimum(counts, 2**31 - 1)
    cells = spark.sparkContext.broadcast(sketch)

    postings = rows.select("text").mapInArrow(*_postings(k, percent, cells))
    edges = candidate_edges(postings, percent)
    cand = write_out(connected_components(edges).withColumnsRenamed({"id": "node", "component": "comp"}), "candidates")

    classes = docs_seen.where("n > 0 and doc_id is not null").groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    placed = write_out(cand.join(classes, "node"), "placed")
    weight = placed.groupBy("comp").agg(F.sum("n").alias("w"), F.count("*").alias("members")).where("members > 1")
    picked = write_out(placed.join(weight, "comp").select("comp", "node", "check", "doc_id", F.when(F.col("w") > BLOCK, F.ceil(F.col("w") * 2 / BLOCK)).otherwise(1).cast("int").alias("parts")), "picked")

    # ``picked`` grows with the corpus, so it is never broadcast: one plan at every size.
    texts = rows.join(picked.hint("merge"), "doc_id").select("comp", "node", "doc_id", "parts", "check", "text")
    own = texts.mapInArrow(*_own_sets(k))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = own.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("comp", F.least("part", "other"), F.greatest("part", "other"))
    found = spread.select(key.alias("key"), "node", "doc_id", "tokens").repartition("key").sortWithinPartitions("key").mapInArrow(*_search(percent))
    links = write_out(found, "links")

    # Sub-blocks give a class one row each; so do texts that share a doc_id. Then the links are joined as a graph.
    if links.groupBy("doc_id").agg(F.min("least").alias("x"), F.max("least").alias("y")).where("x <> y").limit(1).count():
        own_component = connected_components(links, "doc_id", "least")
        own_component = own_component.select(F.col("id").alias("class_id"), F.col("component"))
    else:
        own_component = links.where("doc_id <> least").select(F.col("doc_id").alias("class_id"), F.col("least").alias("component")).distinct()
    by_node = classes.select("node", "check", F.col("doc_id").alias("class_id")).join(own_component, "class_id", "left").select("node", "check", F.coalesce("component", "class_id").alias("component"))
    out = docs_seen.join(by_node, ["node", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
