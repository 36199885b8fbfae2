"""Operator 11: a Merkle manifest of a table. Bitmaps and their ranks give each leaf its place, slot arrays reduce levels.

A row's leaf is the hash (sha256, lowercase hex) of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value. A source's leaves ascend by doc_id; runs of ``ARITY`` nodes become the hash of their concatenated hex digests
until one node, the source's subroot, is left; subroots, ordered by source, give the root in the same way.

No leaf is sorted. Per source the ids that occur are a compressed bitmap: only words of 64 ids that hold any, built by a
partial ``bit_or``. Its popcount directory is a tree of sums, ``RADIX`` bits a level, so that every window of prefix sums
runs over at most ``2^RADIX`` nodes, however large a source is. A leaf's place is the directory's count before its word
and the popcount of the lower bits of its word. Places then key slot arrays: ``ARITY^LEVELS`` consecutive leaves meet in
one row, fall into their slots, and are reduced by ``LEVELS`` levels at once; the nodes are the next round's leaves.
Proofs go the other way, top down: a group's path to the root is handed to the groups below, once each.

Defined cases: rows with a null id are leaves that come first; rows that repeat an id stand by their leaf hash, each in a
place of its own (equal rows in any order); a null source is a source of its own and comes first; texts may be null, empty
or very long; extra columns, whatever their names, are ignored; an empty table has no leaves, no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import write_out

ARITY = 3
#: Levels that one slot array reduces.
LEVELS = 4
SLOTS = ARITY**LEVELS
#: Bits of a level of the popcount directory.
RADIX = 8
#: Copies of one row that one row stands for until they get their places.
COPIES = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The leaf of a row as 32 bytes."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest_rows(docs: DataFrame, altered_text: Column | None = None, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(key, word, bit, doc_id, leaf, altered): what the tree needs of each row; no text goes further than this.

    ``columns`` name the id, the source, further columns and last the text. ``altered_text`` is a text to test against the
    manifest, null where there is none; ``altered`` is its leaf where that differs.
    """
    own = [F.col(f"`{c}`") for c in columns]
    leaf = leaf_hash(own)
    altered = F.lit(None).cast("binary") if altered_text is None else F.when(altered_text.isNotNull() & (altered_text != own[-1]), leaf_hash([*own[:-1], altered_text]))
    doc_id, source = own[0].cast("long"), own[1].cast("string")
    rows = docs.select(F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source)).alias("key"), doc_id.alias("doc_id"), leaf.alias("leaf"), altered.alias("altered"))
    # Null ids have a word of their own below all others.
    word, bit = F.expr(f"coalesce(shiftright(doc_id, 6), {-(1 << 57) - 1})"), F.expr("cast(coalesce(doc_id, 0) & 63 as int)")
    return rows.select("key", word.alias("word"), bit.alias("bit"), "doc_id", "leaf", "altered")


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """(key, word, bits, n): the words of each source's bitmap with their numbers of rows."""
    return rows.groupBy("key", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n"))


def popcount_directory(bitmaps: DataFrame) -> DataFrame:
    """(key, word, bits, n, base): the bitmap's words with the rows of their source before them."""
    low, high = bitmaps.agg(F.min("word"), F.max("word")).first()
    low = low or 0
    level, levels, last = bitmaps.select("key", (F.col("word") - low).alias("node"), "n"), [], (high or 0) - low
    while last:
        levels.append(level)
        level = write_out(level.groupBy("key", F.shiftright("node", RADIX).alias("node")).agg(F.sum("n").alias("n")), "directory")
        last >>= RADIX
    bases = level.select("key", "node", F.lit(0).cast("long").alias("base"))
    for level in reversed(levels):
        nodes = level.withColumn("up", F.shiftright("node", RADIX))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.select("key", "node", "up", before.alias("before"))
        bases = nodes.join(bases.withColumnsRenamed({"node": "up"}), ["key", "up"]).select("key", "node", (F.col("base") + F.col("before")).alias("base"))
    return bitmaps.join(bases.select("key", (F.col("node") + low).alias("word"), "base"), ["key", "word"])


def leaf_places(rows: DataFrame) -> DataFrame:
    """(key, pos, doc_id, leaf, altered): the place of each leaf among those of its source, from 0."""
    words = write_out(popcount_directory(write_out(id_bitmaps(rows), "bitmaps")), "ranked")
    at = rows.join(words, ["key", "word"])
    rank = F.expr("base + bit_count(bits & ~shiftleft(-1L, bit))")
    out = at.where("n = bit_count(bits)").select("key", rank.alias("pos"), "doc_id", "leaf", "altered")
    if words.where("n <> bit_count(bits)").limit(1).count():
        out = out.unionByName(_repeated_places(at.where("n <> bit_count(bits)")))
    return out


def _repeated_places(at: DataFrame) -> DataFrame:
    """The places in words where ids repeat: by id, by the leaf's leading bytes, by the leaf; equal rows are one row until they are dealt out."""
    each = write_out(at.groupBy("key", "word", "base", "bit", "doc_id", "leaf", "altered").agg(F.count("*").alias("copies")).withColumn("lead", F.expr("hex(substring(leaf, 1, 2))")), "repeated")

    def start(rows: DataFrame, group: list[str], by: str) -> DataFrame:
        sums = rows.groupBy(*group, by).agg(F.sum("copies").alias("own"))
        return sums.select(*group, by, F.coalesce(F.sum("own").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{by}"))

    ids = ["key", "word"]
    placed = each.join(start(each, ids, "bit"), [*ids, "bit"]).join(start(each, [*ids, "bit"], "lead"), [*ids, "bit", "lead"]).join(start(each, [*ids, "bit", "lead"], "leaf"), [*ids, "bit", "lead", "leaf"])
    first = placed.select("key", (F.col("base") + F.col("before_bit") + F.col("before_lead") + F.col("before_leaf")).alias("first"), "doc_id", "leaf", "altered", "copies")
    chunks = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("chunk"))
    left = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("chunk") * COPIES)
    dealt = chunks.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
    return dealt.select("key", (F.col("first") + F.col("chunk") * COPIES + F.col("of")).alias("pos"), "doc_id", "leaf", "altered")


def _hash(hexes: Sequence[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def _up(nodes: list[str], only: bool) -> list[list[str]]:
    """The levels of one slot array from its nodes upwards: to a single node if it is its tree's only array, else ``LEVELS`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if only else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _steps(levels: list[list[str]], slot: int) -> list[tuple[list[str], list[str]]]:
    """The siblings before and after a node's ancestors within its array, level by level."""
    out = []
    for level in levels[:-1]:
        run = slot - slot % ARITY
        out.append((level[run:slot], level[slot + 1 : run + ARITY]))
        slot //= ARITY
    return out


def _pack(steps: list[tuple[list[str], list[str]]]) -> bytes:
    return b"".join(bytes((len(a), len(b))) + bytes.fromhex("".join((*a, *b))) for a, b in steps)


def _unpack(path: bytes) -> list[tuple[list[str], list[str]]]:
    out, at = [], 0
    while at < len(path):
        n, m = path[at], path[at + 1]
        h = [path[at + 2 + 32 * i : at + 34 + 32 * i].hex() for i in range(n + m)]
        out.append((h[:n], h[n:]))
        at += 2 + 32 * (n + m)
    return out


def fold(node: str, steps: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that a node and the siblings on its way give."""
    for before, after in steps:
        node = _hash([*before, node, *after])
    return node


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, g, members in any order) to (key, g, node, members in their slots)."""
    for batch in batches:
        members, nodes = [], []
        for r in range(batch.num_rows):
            own = batch.column(2)[r].values
            at = [0] * len(own)
            for i, slot in enumerate(own.field("slot").to_pylist()):
                at[slot] = i
            placed = own.take(pa.array(at))
            members.append(placed)
            only = len(placed) < SLOTS and batch.column(1)[r].as_py() == 0
            nodes.append(bytes.fromhex(_up([h.hex() for h in placed.field("node").to_pylist()], only)[-1][0]))
        if members:
            offsets = [0]
            for m in members:
                offsets.append(offsets[-1] + len(m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(members))], names=["key", "g", "node", "members"])


def _round(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """One round of slot arrays over (key, pos, node, payload): (key, g, node, members)."""
    member = F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), "node", *payload)
    groups = nodes.groupBy("key", F.expr(f"pos div {SLOTS}").alias("g")).agg(F.collect_list(member).alias("members"))
    kind = groups.schema["members"].dataType.simpleString()
    return write_out(groups.mapInArrow(_slots, f"key string, g bigint, node binary, members {kind}"), "slots")


def reduce_levels(nodes: DataFrame, payload: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """Rounds from (key, pos, node, payload) up: each round's slot arrays, and (key, node) of the trees that end in it."""
    rounds = []
    while True:
        arrays = _round(nodes, payload)
        last = arrays.groupBy("key").agg(F.max("g").alias("last")).where("last = 0").select("key")
        ended = write_out(arrays.where("g = 0").join(last, "key").select("key", "node"), "ended")
        rounds.append((arrays, ended))
        going = arrays.select("key", F.col("g").alias("pos"), "node")
        first = going.where("pos = 0").join(ended.select("key"), "key", "left_anti")
        nodes, payload = going.where("pos > 0").unionByName(first), ()
        if not first.limit(1).count():
            return rounds


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot arrays (key, g, members, path, subroot, root) to the paths of their members: (key, g, path, subroot, root)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, g, members, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels = _up([m["node"].hex() for m in members], len(members) < SLOTS and g == 0)
            for slot in range(len(members)):
                for c, v in zip(out, (key, g * SLOTS + slot, _pack(_steps(levels, slot)) + path, subroot, root), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["key", "g", "path", "subroot", "root"])


def hand_down(rounds: list[tuple[DataFrame, DataFrame]], heads: DataFrame) -> DataFrame:
    """The lowest round's slot arrays with their way up: (key, g, members, path, subroot, root). ``heads``: (key, path, root) of each tree."""
    paths = None
    for r in reversed(range(len(rounds))):
        arrays, ended = rounds[r]
        own = ended.join(heads, "key").select("key", F.lit(0).cast("long").alias("g"), "path", F.col("node").alias("subroot"), "root")
        paths = own if paths is None else paths.unionByName(own)
        met = arrays.select("key", "g", "members").join(paths, ["key", "g"])
        if r == 0:
            return met
        slim = met.select("key", "g", F.transform("members", lambda m: F.struct(m["node"].alias("node"))).alias("members"), "path", "subroot", "root")
        paths = write_out(slim.mapInArrow(_down, "key string, g bigint, path binary, subroot binary, root binary"), "paths")


def ordered(keys: DataFrame) -> DataFrame:
    """Rows with their number in the order of ``key``: sorted by ranges, numbered by the counts of the ranges before."""
    placed = write_out(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()), "ordered")
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each range
    return placed.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).withColumn("pos", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "start")


def _proofs(full: bool):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * full]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for g, members, path, subroot, root in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                levels = _up([m["node"].hex() for m in members], len(members) < SLOTS and g == 0)
                above, root, roots = _unpack(path), root.hex(), {}
                tail = "".join(h for a, b in above for h in (*a, *b))
                for slot, m in enumerate(members):
                    own = _steps(levels, slot)
                    top = fold((m["altered"] or m["node"]).hex(), own)
                    if top not in roots:
                        roots[top] = fold(top, above)
                    siblings = [h for a, b in own for h in (*a, *b)]
                    row = [m["doc_id"], m["node"].hex(), subroot.hex(), root, _hash([*siblings, tail]), roots[top], roots[top] == root]
                    if full:
                        row.append([*siblings, *(h for a, b in above for h in (*a, *b))])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    kinds = ["bigint", *["string"] * 5, "boolean", *["array<string>"] * full]
    return run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))


def merkle_manifest(docs: DataFrame, altered_text: Column | None = None, columns: Sequence[str] = COLUMNS, full: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row; ``full``: and the proof's ``siblings``.

    ``folded_root`` is what the leaf, or the altered text's leaf where there is one, and the siblings give.
    """
    rows = write_out(manifest_rows(docs, altered_text, columns), "leaves")
    rounds = reduce_levels(leaf_places(rows).withColumnRenamed("leaf", "node"), ["doc_id", "altered"])
    subroots = None
    for _, ended in rounds:
        subroots = ended if subroots is None else subroots.unionByName(ended)
    sources = write_out(ordered(subroots), "sources")
    upper = reduce_levels(sources.select(F.lit("").alias("key"), "pos", "node", F.col("key").alias("source")), ["source"])
    root = upper[-1][1]
    top = hand_down(upper, root.select("key", F.lit(b"").alias("path"), F.col("node").alias("root")))
    heads = write_out(top.mapInArrow(_heads, "key string, path binary, root binary"), "heads")
    run, schema = _proofs(full)
    return hand_down(rounds, heads).select("key", "g", "members", "path", "subroot", "root").mapInArrow(run, schema)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each source's subroot."""
    for batch in batches:
        keys, paths, roots = [], [], []
        for g, members, path, root in zip(batch["g"].to_pylist(), batch["members"].to_pylist(), batch["path"].to_pylist(), batch["root"].to_pylist(), strict=True):
            levels = _up([m["node"].hex() for m in members], len(members) < SLOTS and g == 0)
            for slot, m in enumerate(members):
                keys.append(m["source"])
                paths.append(_pack(_steps(levels, slot)) + path)
                roots.append(root)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.binary()), pa.array(roots, pa.binary())], names=["key", "path", "root"])


def tampered_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without its line feeds where 2 divides the crc32 of the decimal id, else null."""
    text = F.col(text_col)
    return F.when((F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0) & text.contains("\n"), F.translate(text, "\n", ""))
