"""Merkle manifest of a dataset: leaf coordinates by bitmap rank, levels by slot arrays.

A leaf is the SHA-256 of a row; the leaves of a source, ascending by doc_id, form
a tree of three-node runs, and the sources' roots form the tree above.

Where a leaf stands among its source's leaves is found without sorting them:

1. Tasks emit, per range of 4,096 ids (container) and source, the ids they saw
   as a compressed bitmap: a sorted list of offsets if few, else 512 bytes.
2. Containers are merged and get a popcount directory (ones before every 64-bit
   word). A directory over the containers, in steps of 16 bits of their number,
   gives the rows of the source before each one; no window in it is longer than
   65,536 rows, whatever the source's size or the ids.
3. A rank query (directory entry + popcount below the bit) gives each leaf its
   coordinate.

Coordinates key the slot arrays: 729 consecutive leaves of a source are one
array, reduced by six levels in one task; the next round does the same with
the arrays' roots, so rounds grow with log729 of the rows. Going down, each array
needs only its root's siblings to give every leaf its proof.

Defined cases: columns are cast to the types of ``documents``, and a null one counts as
``-``. Rows without doc_id stand first, ordered by leaf (the leaf's leading bits
take the place of the id), and are never tampered with. Rows that repeat a doc_id
in a source are ordered by leaf; equal ones are moved once, with a count, and each
gets its own coordinate and proof. Different rows of one doc_id share a task. An
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import ship, staged, table
from ferry.operators.rowindex import with_row_index

RUN = 3                      # nodes hashed into one
SPAN = 6                     # levels per round: arrays of 729 nodes
CONTAINER = 12               # bits of a doc_id inside its container
SPARSE = 256                 # ids up to which a container is a list of offsets
NULL_IDS = -(1 << 52)        # first container of rows without doc_id, below all others
LEAF_COLUMNS = (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))


def _hex(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# -- leaves ----------------------------------------------------------------------

def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of ``-`` or ``length:value`` of every column, as 32 bytes."""
    marked = [F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in columns]
    return F.unhex(F.sha2(F.concat(*marked), 256))


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered, copies.

    ``tree`` is the source, marked so that null sorts first."""
    typed = docs.select(*(F.col(c).cast(t).alias(c) for c, t in LEAF_COLUMNS))
    own = [F.col(c).cast("string") for c, _ in LEAF_COLUMNS]
    changed = [*own[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    hit = tampered_with(F.col("doc_id")) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    rows = typed.select(
        F.when(F.col("source").isNull(), "!").otherwise(F.concat(F.lit("+"), F.col("source"))).alias("tree"), "doc_id",
        leaf_hash(own).alias("leaf"), F.when(hit, leaf_hash(changed)).alias("tampered"))
    return rows.groupBy("tree", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("copies"))


def with_container(rows: DataFrame) -> DataFrame:
    """Adds k (container) and at (offset in it). Rows without doc_id are dealt by the
    first bits of their leaf to as many containers as they need."""
    bits = max(0, rows.filter("doc_id IS NULL").count() >> CONTAINER - 1).bit_length()
    head = F.conv(F.hex(F.substring("leaf", 1, 7)), 16, 10).cast("long")      # 56 bits
    inside = F.lit((1 << CONTAINER) - 1)
    return rows.select(
        "*", F.coalesce(F.shiftright("doc_id", CONTAINER), F.lit(NULL_IDS) + F.shiftright(head, 56 - bits)).alias("k"),
        F.coalesce(F.col("doc_id").bitwiseAND(inside), F.shiftright(head, 56 - bits - CONTAINER).bitwiseAND(inside))
        .cast("int").alias("at"))


# -- bitmaps and ranks --------------------------------------------------------------

def pack_ids(offsets: np.ndarray) -> bytes:
    """Distinct ascending offsets as a container."""
    if len(offsets) < SPARSE:
        return b"s" + offsets.astype(np.uint16).tobytes()
    bits = np.zeros(1 << CONTAINER, bool)
    bits[offsets] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """A container as 64-bit words."""
    if packed[:1] == b"b":
        return np.frombuffer(packed[1:], np.uint64)
    bits = np.zeros(1 << CONTAINER, bool)
    bits[np.frombuffer(packed[1:], np.uint16)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def directory_of(words: np.ndarray) -> np.ndarray:
    """The ones before each word."""
    ones = np.bitwise_count(words).astype(np.int64)
    return np.cumsum(ones) - ones


def rank(words: np.ndarray, directory: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ones below each offset."""
    word, bit = offsets >> 6, (offsets & 63).astype(np.uint64)
    return directory.astype(np.int64)[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def _repeats(offsets: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct offsets; those that more than one row has, and their surplus."""
    ids, place = np.unique(offsets, return_inverse=True)
    n = np.bincount(place, copies, len(ids)).astype(np.int64)
    return ids, ids[n > 1], n[n > 1] - 1


def containers(rows: DataFrame) -> DataFrame:
    """tree, k, n (rows), ids (container), ones (its directory), more (repeated ids)."""
    def collect(batches):
        import pyarrow as pa
        for batch in batches:
            k, at, copies = (batch.column(i).to_numpy() for i in (1, 2, 3))
            trees = batch.column(0).dictionary_encode()
            code = trees.indices.to_numpy()
            order = np.lexsort((code, k))
            cuts = np.flatnonzero(np.append(True, (np.diff(k[order]) != 0) | (np.diff(code[order]) != 0)))
            out = []
            for part in np.split(order, cuts[1:]):
                ids, again, surplus = _repeats(at[part], copies[part])
                out.append((trees.dictionary[code[part[0]]].as_py(), int(k[part[0]]), pack_ids(ids),
                            pickle.dumps((again, surplus)) if len(again) else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                ["tree", "k", "ids", "more"])

    def merge(group):
        import pyarrow as pa
        by_tree: dict[str, list] = {}
        for tree, ids, more in zip(*(group.column(c).to_pylist() for c in ("tree", "ids", "more"))):
            by_tree.setdefault(tree, []).append((unpack_bits(ids), pickle.loads(more) if more else None))
        out = []
        for tree, parts in by_tree.items():
            counts = np.zeros(1 << CONTAINER, np.int64)
            words = np.zeros((1 << CONTAINER) >> 6, np.uint64)
            for bits, more in parts:
                if more:
                    counts[more[0]] += more[1]
                shared = words & bits       # ids seen before: one more row of each
                if shared.any():
                    counts[np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))] += 1
                words = words | bits
            ids = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
            again = np.flatnonzero(counts)
            out.append((tree, group.column("k")[0].as_py(), int(len(ids) + counts.sum()), pack_ids(ids),
                        directory_of(words).astype(np.uint16).tobytes(),
                        pickle.dumps((again, counts[again])) if len(again) else None))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["tree", "k", "n", "ids", "ones", "more"])

    seen = rows.select("tree", "k", "at", "copies").mapInArrow(collect, "tree string, k long, ids binary, more binary")
    return seen.groupBy("k").applyInArrow(merge, "tree string, k long, n long, ids binary, ones binary, more binary")


def starts(found: DataFrame) -> DataFrame:
    """tree, k, start (the tree's rows before the container), total (all its rows)."""
    levels = [found.select("tree", "k", "n")]
    for _ in range(3):
        levels.append(levels[-1].groupBy("tree", F.shiftright("k", 16).alias("k")).agg(F.sum("n").alias("n")))
    above = levels[-1].groupBy("tree").agg(F.sum("n").alias("total")) \
        .select("tree", F.lit(0).cast("long").alias("of"), F.lit(0).cast("long").alias("start"), "total")
    for i, level in reversed(list(enumerate(levels))):
        parent = F.shiftright("k", 16) if i < 3 else F.lit(0).cast("long")
        before = Window.partitionBy("tree", "of").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        here = level.withColumn("of", parent).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        above = here.join(above, ["tree", "of"]).select(
            "tree", F.col("k").alias("of"), (F.col("start") + F.col("before")).alias("start"), "total")
    return above.withColumnRenamed("of", "k")


def placed(rows: DataFrame) -> DataFrame:
    """tree, pos, n, doc_id, leaf, tampered, copies: rows with the coordinate of their first copy."""
    found = staged(containers(rows), "merkle-containers")
    found = found.drop("n").join(starts(found), ["tree", "k"])

    def query(asked, index):
        import pyarrow as pa
        trees = {r["tree"]: r for r in index.to_pylist()}
        names, at = asked.column("tree").to_pylist(), asked.column("at").to_numpy().astype(np.int64)
        copies = asked.column("copies").to_numpy()
        pos, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        by_tree: dict[str, list] = {}
        for i, tree in enumerate(names):
            by_tree.setdefault(tree, []).append(i)
        for tree, own in by_tree.items():
            r, own = trees[tree], np.array(own)
            offsets = at[own]
            pos[own] = r["start"] + rank(unpack_bits(r["ids"]), np.frombuffer(r["ones"], np.uint16), offsets)
            n[own] = r["total"]
            if r["more"]:
                ids, surplus = pickle.loads(r["more"])
                pos[own] += np.append(0, np.cumsum(surplus))[np.searchsorted(ids, offsets)]
                # rows of one id follow each other by leaf
                for offset in ids:
                    same = own[offsets == offset]
                    leaf = [asked.column("leaf")[int(i)].as_py() for i in same]
                    same = same[sorted(range(len(leaf)), key=leaf.__getitem__)]
                    pos[same] += np.cumsum(copies[same]) - copies[same]
        return pa.table([asked.column("tree"), pa.array(pos), pa.array(n), *(asked.column(c) for c in (
            "doc_id", "leaf", "tampered", "copies"))],
            ["tree", "pos", "n", "doc_id", "leaf", "tampered", "copies"])

    return rows.groupBy("k").cogroup(found.groupBy("k")).applyInArrow(
        query, "tree string, pos long, n long, doc_id long, leaf binary, tampered binary, copies long")


# -- slot arrays ------------------------------------------------------------------------

def reduce_slots(nodes: list[str], n: int, span: int) -> list[list[str]]:
    """The levels of one slot array, the nodes' own first; ``n`` is the length of the
    whole tree's level they belong to. Stops after ``span`` levels or at the tree's root."""
    levels = [nodes]
    while n > 1 and len(levels) <= span:
        nodes = [_hex(*nodes[i:i + RUN]) for i in range(0, len(nodes), RUN)]
        levels.append(nodes)
        n = -(-n // RUN)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """The others of each run on the way from node ``i`` to the array's root."""
    found = []
    for level in levels[:-1]:
        first = i // RUN * RUN
        found += level[first:i] + level[i + 1:first + RUN]
        i //= RUN
    return found


def fold(node: str, pos: int, n: int, path: list[str]) -> str:
    """The root that a node at ``pos`` of ``n`` gives with the siblings ``path``."""
    at = 0
    while n > 1:
        place, size = pos % RUN, min(RUN, n - pos // RUN * RUN)
        others = path[at:at + size - 1]
        node = _hex(*others[:place], node, *others[place:])
        at, pos, n = at + size - 1, pos // RUN, -(-n // RUN)
    return node


def climb(nodes: DataFrame, span: int) -> DataFrame:
    """tree, pos, path (siblings up to the tree's root, 32 bytes each), root, for
    every node of ``nodes(tree, pos, n, node)``. One round per ``span`` levels."""
    size = RUN ** span

    def reduce(group):
        import pyarrow as pa
        pos = group.column("pos").to_pylist()
        order = sorted(range(len(pos)), key=pos.__getitem__)
        slots = [group.column("node")[i].as_py().hex() for i in order]
        n, block = group.column("n")[0].as_py(), group.column("block")[0].as_py()
        levels = reduce_slots(slots, n, span)
        root = bytes.fromhex(levels[-1][0])
        return pa.table({"tree": [group.column("tree")[0].as_py()] * len(pos), "pos": [pos[i] for i in order],
                         "block": [block] * len(pos), "path": [bytes.fromhex("".join(siblings(levels, i)))
                                                               for i in range(len(pos))],
                         "root": [root] * len(pos), "up": [-(-n // size)] * len(pos)})

    done = staged(nodes.withColumn("block", F.expr(f"pos div {size}")).groupBy("tree", "block").applyInArrow(
        reduce, "tree string, pos long, block long, path binary, root binary, up long"), "merkle-slots")
    if not done.filter("up > 1").limit(1).count():
        return done.select("tree", "pos", "path", "root")
    # trees that are done stay as they are: an array of one node is its own root
    higher = climb(done.filter(F.col("pos") % size == 0).select(
        "tree", F.col("block").alias("pos"), F.col("up").alias("n"), F.col("root").alias("node")), span)
    higher = higher.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), "root")
    return done.drop("root").join(higher, ["tree", "block"]) \
        .select("tree", "pos", F.concat("path", "rest").alias("path"), "root")


def manifest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A slot array spans ``span`` levels, RUN ** span nodes."""
    spark, slots = docs.sparkSession, RUN ** span
    ship(spark)
    rows = placed(with_container(staged(leaves(docs), "merkle-leaves")))

    def fill(group):
        """One packed row per slot array: its rows in order, and its root."""
        import pyarrow as pa
        order = np.argsort(group.column("pos").to_numpy(), kind="stable")
        copies = group.column("copies").to_numpy()[order]
        own = [[column[int(i)].as_py() for i in order] for column in (
            group.column(c) for c in ("doc_id", "leaf", "tampered"))]
        members = [[x for x, c in zip(values, copies) for _ in range(c)] for values in own]
        n = group.column("n")[0].as_py()
        root = reduce_slots([x.hex() for x in members[1]], n, span)[-1][0]
        return pa.table({"tree": [group.column("tree")[0].as_py()], "block": [group.column("block")[0].as_py()],
                         "n": [n], "root": [bytes.fromhex(root)], "members": [pickle.dumps(members, protocol=5)]})

    # copies of one row may reach into the following arrays
    first, last = F.expr(f"pos div {slots}"), F.expr(f"(pos + copies - 1) div {slots}")
    rows = rows.withColumn("block", F.explode(F.sequence(first, last))) \
        .withColumn("end", F.least(F.col("pos") + F.col("copies"), (F.col("block") + 1) * slots)) \
        .withColumn("pos", F.greatest("pos", F.col("block") * slots)) \
        .withColumn("copies", F.col("end") - F.col("pos")).drop("end")
    arrays = staged(rows.groupBy("tree", "block").applyInArrow(
        fill, "tree string, block long, n long, root binary, members binary"), "merkle-arrays")
    # rounding up to thirds span times is rounding up to slots once
    length = F.expr(f"(n + {slots - 1}) div {slots}")
    inner = staged(climb(arrays.select("tree", F.col("block").alias("pos"), length.alias("n"),
                                       F.col("root").alias("node")), span), "merkle-paths")
    # the sources' roots, numbered in order of source
    roots = inner.filter("pos = 0").select("tree", F.col("root").alias("subroot"))
    numbered = staged(with_row_index(roots.orderBy("tree"), "place", stable=False), "merkle-sources")
    n_trees = numbered.count()
    outer = climb(numbered.select(F.lit("").alias("tree"), F.col("place").alias("pos"),
                                  F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("node")), span)
    outer = outer.select(F.col("pos").alias("place"), F.col("path").alias("outer"), F.col("root").alias("top"))
    ways = inner.select("tree", F.col("pos").alias("block"), F.col("path").alias("inner")) \
        .join(numbered.join(outer, "place"), "tree")

    def prove(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                ids, own, tampered = pickle.loads(r["members"])
                levels = reduce_slots([x.hex() for x in own], r["n"], span)
                split = lambda b: [b[i:i + 32].hex() for i in range(0, len(b), 32)]
                inner, outer = split(r["inner"]), split(r["outer"])
                subroot, root = r["subroot"].hex(), r["top"].hex()
                out = []
                for i, (leaf, other) in enumerate(zip(levels[0], tampered)):
                    path = siblings(levels, i) + inner
                    folded = fold(other.hex() if other else leaf, r["block"] * slots + i, r["n"], path)
                    folded = fold(folded, r["place"], n_trees, outer)
                    out.append((ids[i], leaf, subroot, root, _hex(*path, *outer), folded, folded == root))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [
                    "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return arrays.drop("root").join(ways, ["tree", "block"]).mapInArrow(
        prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, lang, n_chars, text,
         -- CRC-32 of the decimal id, bit by bit: a byte >= 0 is mixed in, -1 is one shift
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
  FROM documents),
marked AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM raw),
d AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered
  FROM marked),
p AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM d),
tree AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3),
subs AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, pos, n, h FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM upper_tree WHERE n > 1 GROUP BY lvl, pos // 3),
climbed AS (
  SELECT id, source, 0 AS lvl, pos, n, tampered AS h, '' AS proof FROM p
  UNION ALL
  SELECT c.id, c.source, c.lvl + 1, c.pos // 3, (max(c.n) + 2) // 3,
         sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.h ELSE t.h END, '' ORDER BY t.pos)),
         max(c.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos <> c.pos), '')
  FROM climbed c JOIN tree t ON t.source IS NOT DISTINCT FROM c.source AND t.lvl = c.lvl AND t.pos // 3 = c.pos // 3
  WHERE c.n > 1 GROUP BY c.id, c.source, c.lvl, c.pos),
climbed_above AS (
  SELECT c.id, 0 AS lvl, s.pos, s.n, c.h, c.proof
  FROM climbed c JOIN subs s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
  UNION ALL
  SELECT c.id, c.lvl + 1, c.pos // 3, (max(c.n) + 2) // 3,
         sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.h ELSE t.h END, '' ORDER BY t.pos)),
         max(c.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos <> c.pos), '')
  FROM climbed_above c JOIN upper_tree t ON t.lvl = c.lvl AND t.pos // 3 = c.pos // 3
  WHERE c.n > 1 GROUP BY c.id, c.lvl, c.pos)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(a.proof) AS proof_sha256,
       a.h AS folded_root, a.h = r.h AS verified
FROM p JOIN climbed_above a ON a.id = p.id AND a.n = 1
JOIN subs s ON s.source IS NOT DISTINCT FROM p.source
JOIN upper_tree r ON r.n = 1
"""
