"""MinHash near-duplicates with an LSH forest, links confirmed on full sets.

1. One pass over the texts gives each document's set of distinct 5-word
   shingles (64-bit hashes), a digest of the whole set, and ``TREES * DEPTH``
   minimum hashes. Documents with equal sets are one node from here on, so
   groups of exact copies cost nothing further however large they are.
2. LSH forest: in each of ``TREES`` orders the nodes are sorted by a label of
   minimum hashes (a range sort by label and node, so a region with a third of
   all rows is spread over many tasks). Nodes that agree on at least ``DEPTH``
   hashes are candidates: all pairs of a region of up to ``REGION`` nodes. Rows of
   larger regions, and of those that touch the seam of two tasks, get the whole
   signature for a label and are sorted again: there all pairs of a region of up
   to ``STRETCH`` nodes are compared by signature; a larger one is cut deeper, at the
   next hash, until it is that small or all hashes agree (then the nodes are
   chained), and next neighbours by longest common prefix are compared across the
   cuts. At the seams of this second sort up to ``STRETCH`` rows of either side are
   compared as well. A pair at similarity 0.85 agrees on DEPTH hashes in no
   order with probability (1 - 0.85^5)^25 < 1e-6. In a family of F documents that
   share most of their text (similarity s to each other, below the threshold),
   regions hold F s^5 nodes; up to STRETCH of them nothing is cut. Beyond, a pair is
   missed with at most (1 - 0.85^h)^25, h = log(F / STRETCH) / log(1 / s): s = 0.6
   gives below 1e-6 for F = 10,000, about 1e-3 for 100,000 and 5e-2 for a million;
   step 4 finds such a pair all the same if other links hold its group together.
3. Candidates whose minimum hashes agree in fewer than ``LEAST_EQUAL`` of 125
   places are dropped (a true link is, with probability < 1e-6); connected
   components of the others are provisional groups.
4. Inside a provisional group *all* pairs are compared on full sets, not just
   the candidates, through an inverted index in numpy; so a cut region or a
   missed neighbour loses no link as long as the group hangs together. Groups
   whose sets exceed ``GROUP_SHINGLES`` are cut into blocks, and each pair of
   blocks is a task of its own. A task emits a spanning set of the links it
   confirmed, not all pairs.
5. Components of the confirmed links, then the smallest doc_id of each.

Defined cases: null or empty text: no shingles, linked with nothing; fewer
than five words: the whole sequence is the one shingle; null doc_id: counted,
never linked, component_id null, kept; repeated rows are copies like any
others (they share a doc_id, so all of them are kept or none); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import DOC_COLUMNS, ship, staged, table
from ferry.llm.components import components

WORDS = 5
TREES, DEPTH = 25, 5
HASHES = TREES * DEPTH
REGION, BESIDE = 12, 3
#: largest region whose pairs are all compared by signature; also the rows taken from either side of a seam
STRETCH = 1024
LEAST_EQUAL = 86
#: links need NUM * intersection >= DEN * union
NUM, DEN = 100, 85
GROUP_SHINGLES = 1_500_000
#: members of provisional groups (about 40 bytes each) up to this count are broadcast
BROADCAST_MEMBERS = 500_000
#: what a task of a sort or a join on full sets should hold
TASK_BYTES = 64 << 20

_U = np.uint64
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2 ** 64, HASHES, dtype=_U)
_MUL = _rng.integers(0, 2 ** 64, HASHES, dtype=_U) | _U(1)
_PLACE = _rng.integers(0, 2 ** 64, WORDS, dtype=_U) | _U(1)
#: a label: its order, then DEPTH hashes
_LABEL = 1 + 4 * DEPTH
#: a deep label: the label, then the low bytes of all hashes, its own ones first
_DEEP = _LABEL + HASHES


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    # bytes: lower() touches A-Z only, split() splits at 0x20 and 0x09-0x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(_U) + _U(1)
    start = np.cumsum(size) - size
    at = np.arange(len(data)) - np.repeat(start, size)
    weight = _BYTES[at & 63]
    if int(size.max()) > 64:
        weight = weight * (((at >> 6).astype(_U) * _U(2) + _U(1)) * _U(0x9E3779B97F4A7C15) | _U(1))
    w = _mix(np.add.reduceat(data * weight, start, dtype=_U) + size.astype(_U))
    n = len(words)
    if n < WORDS:
        return np.array([int(_mix(np.array([int((w * _PLACE[:n]).sum(dtype=_U)) ^ n], _U))[0])], _U)
    h = np.zeros(n - WORDS + 1, _U)
    for i in range(WORDS):
        h += w[i:n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(_mix(h))


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set: 32 bits each."""
    best = np.full(HASHES, ~_U(0), _U)
    for a in range(0, len(s), 512):
        np.minimum(best, ((s[a:a + 512, None] ^ _XOR) * _MUL).min(0), out=best)
    return (best >> _U(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), mins (32-bit minimum hashes)."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, nodes, mins = [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py())
                    n.append(len(s))
                    nodes.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    mins.append(minima(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(mins, pa.binary())],
                    ["doc_id", "n_shingles", "node", "mins"])

    return docs.select(F.col("doc_id").cast("long"), "text") \
        .mapInArrow(run, "doc_id long, n_shingles long, node binary, mins binary")


def _width(spark: SparkSession, nbytes: float) -> int:
    """Tasks for so many bytes: the session's width, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(nbytes // TASK_BYTES) + 1)


def _labels(batches):
    """One row per node and order: (label, node)."""
    import pyarrow as pa
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            n = part.num_rows
            mins = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
            out = np.empty((n, TREES, _LABEL), np.uint8)
            out[:, :, 0] = np.arange(TREES)
            out[:, :, 1:] = np.ascontiguousarray(mins.astype(">u4")).view(np.uint8).reshape(n, TREES, _LABEL - 1)
            offsets = pa.py_buffer((np.arange(n * TREES + 1) * _LABEL).astype(np.int32))
            labels = pa.Array.from_buffers(pa.binary(), n * TREES, [None, offsets, pa.py_buffer(out.tobytes())])
            owner = pa.array(np.repeat(np.arange(n), TREES))
            yield pa.RecordBatch.from_arrays([labels, part.column(0).take(owner)], ["label", "node"])


def _regions(region: int):
    """Over a sorted partition of (label, node): all pairs (a, b) of regions of up to
    ``region`` nodes; the rows (a, label) of larger regions, and of the first and last
    one, which may go on in another task. A large region is passed on as it is read."""

    def run(batches):
        import pyarrow as pa
        prefix, held, large = None, [], True
        for batch in batches:
            pairs, deep = [], []
            for label, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label != prefix:
                    pairs.extend((held[i], held[j]) for i in range(len(held)) for j in range(i + 1, len(held))
                                 if held[i] != held[j])
                    # the first region of a partition is passed on whatever its size
                    large = prefix is None
                    prefix, held = label, []
                if not large:
                    held.append(node)
                    if len(held) > region:
                        deep.extend((n, label) for n in held)
                        held, large = [], True
                else:
                    deep.append((node, label))
            if pairs or deep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([min(p) for p in pairs] + [n for n, _ in deep], pa.binary()),
                     pa.array([max(p) for p in pairs] + [None] * len(deep), pa.binary()),
                     pa.array([None] * len(pairs) + [x for _, x in deep], pa.binary())], ["a", "b", "label"])
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.binary()), pa.nulls(len(held), pa.binary()),
                 pa.array([prefix] * len(held), pa.binary())], ["a", "b", "label"])

    return run


def _deepen(batches):
    """(label, node, low) to (deep label, node): the signature from the order's own hashes on."""
    import pyarrow as pa
    for batch in batches:
        labels, nodes, lows = (batch.column(i).to_pylist() for i in range(3))
        deep = [x + low[DEPTH * x[0]:] + low[:DEPTH * x[0]] for x, low in zip(labels, lows)]
        yield pa.RecordBatch.from_arrays([pa.array(deep, pa.binary()), pa.array(nodes, pa.binary())], ["label", "node"])


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of signatures agree often enough."""
    return (x == y).sum(1) >= LEAST_EQUAL


def _spanning(low: np.ndarray):
    """Links (i, j) that hold together what all pairs of a region would."""
    group = np.arange(len(low))
    for i in range(len(low) - 1):
        other = i + 1 + np.flatnonzero(group[i + 1:] != group[i])
        if not len(other):
            continue
        for j in other[_same(low[other], low[i])]:
            if group[j] != group[i]:
                yield i, int(j)
                group[group == group[j]] = group[i]


def region_links(labels: np.ndarray, stretch: int):
    """Links (i, j) among the sorted deep labels of one region."""
    n = len(labels)
    low = labels[:, _LABEL:]
    cuts, work = [], [(0, n, _LABEL + DEPTH)]
    while work:
        a, b, at = work.pop()
        cuts.append(a)
        if b - a == 1:
            continue
        if b - a <= stretch:
            yield from ((a + i, a + j) for i, j in _spanning(low[a:b]))
        elif at == _DEEP:
            yield from ((i, i + 1) for i in range(a, b - 1))
        else:
            ends = [a, *(a + 1 + np.flatnonzero(labels[a + 1:b, at] != labels[a:b - 1, at])).tolist(), b]
            work.extend((x, y, at + 1) for x, y in zip(ends[:-1], ends[1:]))
    part = np.zeros(n, np.int64)
    part[sorted(set(cuts))] = 1
    part = np.cumsum(part)
    for k in range(1, min(BESIDE + 1, n)):
        over = np.flatnonzero(part[k:] != part[:-k])
        for i in over[_same(low[over], low[over + k])].tolist():
            yield i, i + k


def _deep_regions(stretch: int, seams: bool):
    """Over sorted rows (label, node, further columns): links (a, b) of every region, that is
    of rows with one label and further columns of one value; with ``seams`` also the rows
    next to the partition's borders (b null)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        prefix, labels, nodes, first = None, [], [], True

        def links():
            if len(nodes) < 2:
                return []
            found = region_links(np.frombuffer(b"".join(labels), np.uint8).reshape(-1, _DEEP), stretch)
            return [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in found if nodes[i] != nodes[j]]

        def rows(pairs, edge=(), seam=None):
            m, e = len(pairs), len(edge)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs] + [n for _, n in edge], pa.binary()),
                 pa.array([p[1] for p in pairs] + [None] * e, pa.binary()),
                 pa.array([None] * m + [x for x, _ in edge], pa.binary()),
                 pa.array([None] * m + [part] * e, pa.int32()),
                 pa.array([None] * m + [seam == "head"] * e, pa.bool_())], ["a", "b", "label", "part", "head"])

        for batch in batches:
            pairs = []
            more = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for label, node, *own in zip(*more):
                if (label[:_LABEL], *own) != prefix:
                    pairs.extend(links())
                    if seams and first and prefix is not None:
                        yield rows([], list(zip(labels[:stretch], nodes[:stretch])), "head")
                        first = False
                    prefix, labels, nodes = (label[:_LABEL], *own), [], []
                labels.append(label)
                nodes.append(node)
            if pairs:
                yield rows(pairs)
        yield rows(links())
        if seams and nodes:
            if first:
                yield rows([], list(zip(labels[:stretch], nodes[:stretch])), "head")
            yield rows([], list(zip(labels[-stretch:], nodes[-stretch:])), "tail")

    return run


_LINKS = "a binary, b binary, label binary, part int, head boolean"


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of ``nodes(node, mins)`` from all orders of the
    forest that agree often enough in their signatures."""
    spark = nodes.sparkSession
    low = staged(nodes.select("node", "mins").mapInArrow(_lows, "node binary, low binary"), "forest-lows")
    labels = nodes.select("node", "mins").mapInArrow(_labels, "label binary, node binary")
    width = _width(spark, nodes.count() * TREES * (_LABEL + 16))
    scanned = staged(labels.repartitionByRange(width, "label", "node").sortWithinPartitions("label", "node")
                     .mapInArrow(_regions(REGION), "a binary, b binary, label binary"), "forest-pairs")
    near = alike(scanned.filter("b IS NOT NULL").select("a", "b").distinct(), low)
    large = scanned.filter("b IS NULL").select("label", F.col("a").alias("node"))
    width = _width(spark, large.count() * (_DEEP + 16))
    deep = large.join(low, "node").select("label", "node", "low").mapInArrow(_deepen, "label binary, node binary")
    linked = staged(deep.repartitionByRange(width, "label", "node").sortWithinPartitions("label", "node")
                    .mapInArrow(_deep_regions(STRETCH, True), _LINKS), "forest-links")
    # the last rows of a task and the first of the next that has any (one row per task in ``order``)
    edge = linked.filter("b IS NULL").select("label", F.col("a").alias("node"), "part", "head")
    order = edge.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("place"))
    seam = edge.join(order, "part").select(
        "label", "node", (F.col("place") - F.col("head").cast("int")).alias("seam"))
    beside = seam.repartition("seam").sortWithinPartitions("seam", "label", "node") \
        .mapInArrow(_deep_regions(STRETCH, False), _LINKS)
    deeper = linked.filter("b IS NOT NULL").unionByName(beside)
    return near.unionByName(deeper.select("a", "b")).distinct()


def _alike(batches):
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array(_same(x, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _lows(batches):
    """The low byte of each minimum hash: enough to compare by."""
    import pyarrow as pa
    for batch in batches:
        mins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in mins.astype(np.uint8)], pa.binary())], ["node", "low"])


def alike(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Candidate pairs whose minimum hashes agree often enough."""
    a = low.select(F.col("node").alias("a"), F.col("low").alias("la"))
    b = low.select(F.col("node").alias("b"), F.col("low").alias("lb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "la", "lb").mapInArrow(_alike, "a binary, b binary")


def _links(sets: list[np.ndarray], side: np.ndarray | None):
    """Spanning links (i, j) among sets with NUM * common >= DEN * union; with
    ``side`` only sets of different sides are compared."""
    m = len(sets)
    parent = list(range(m))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(s) for s in sets])
    out, groups = [], m

    def join(i, j):
        nonlocal groups
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
            groups -= 1

    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if NUM * common >= DEN * (size.sum() - common) and (side is None or side[0] != side[1]):
            join(0, 1)
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(every, kind="stable")
    owner, hashes = owner[order], every[order]
    fresh = np.append(True, hashes[1:] != hashes[:-1])
    start = np.flatnonzero(fresh)
    group_of = np.empty(len(every), np.int64)
    group_of[order] = np.cumsum(fresh) - 1
    length = np.diff(np.append(start, len(every)))
    at = np.cumsum(size) - size
    for i in range(m):
        if groups == 1:
            break
        if side is not None and side[i]:
            continue
        g = group_of[at[i]:at[i] + size[i]]
        g = g[length[g] > 1]
        if not len(g):
            continue
        n = length[g]
        span = np.repeat(start[g] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[span], minlength=m)
        hit = NUM * common >= DEN * (size + size[i] - common)
        hit[i] = False
        if side is not None:
            hit &= side
        for j in np.flatnonzero(hit):
            join(i, int(j))
    return out


def _close(batches):
    """Sorted rows (grp, x, y, block, node, set): links of every (grp, x, y)."""
    import pyarrow as pa
    key, nodes, sets, blocks = None, [], [], []

    def flush():
        if len(nodes) > 1:
            # the same set may have come from several rows
            order = sorted(set(nodes))
            first = {n: i for i, n in reversed(list(enumerate(nodes)))}
            pick = [first[n] for n in order]
            side = None if key[1] == key[2] else np.array([blocks[i] == key[2] for i in pick])
            return [(order[i], order[j]) for i, j in _links([sets[i] for i in pick], side)]
        return []

    for batch in batches:
        found = []
        cols = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            k = (cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py())
            if k != key:
                found.extend(flush())
                key, nodes, sets, blocks = k, [], [], []
            blocks.append(cols[3][i].as_py())
            nodes.append(cols[4][i].as_py())
            sets.append(np.frombuffer(cols[5][i].as_py(), _U))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                              pa.array([f[1] for f in found], pa.binary())], ["a", "b"])
    found = flush()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                          pa.array([f[1] for f in found], pa.binary())], ["a", "b"])


def _sets(batches):
    """Shingle sets of member documents; rows whose text is not the node's are dropped."""
    import pyarrow as pa
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(t.as_py()) for t in part.column(0)]
            same = [hashlib.md5(s.tobytes()).digest() == n for s, n in zip(sets, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), part.column(3), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "grp", "blocks", "set"]).filter(pa.array(same))


def confirmed(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Spanning links (a, b), confirmed on full sets, within provisional groups.

    ``nodes(node, rep, n_shingles)``; ``groups(node, component)``.
    """
    spark = docs.sparkSession
    member = groups.join(nodes.select("node", "rep", "n_shingles"), "node")
    size = member.groupBy("component").agg(F.sum("n_shingles").alias("n"))
    member = staged(
        member.join(size, "component").select(
            "node", "rep", "n_shingles", F.col("component").alias("grp"),
            F.ceil(F.col("n") / GROUP_SHINGLES).cast("int").alias("blocks")), "neardup-members")
    total, dealt_shingles = member.agg(F.count(F.lit(1)), F.sum(F.col("n_shingles") * F.col("blocks"))).first()
    few = F.broadcast if total <= BROADCAST_MEMBERS else (lambda x: x)
    member = member.drop("n_shingles")
    sets = docs.select("doc_id", "text").join(few(member), F.col("doc_id") == F.col("rep")) \
        .select("text", "node", "grp", "blocks") \
        .mapInArrow(_sets, "node binary, grp binary, blocks int, set binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("grp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                "block", "node", "set")
    return dealt.repartition(_width(spark, 8 * (dealt_shingles or 0)), "grp", "x", "y").sortWithinPartitions("grp", "x", "y") \
        .mapInArrow(_close, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    signed = staged(signatures(docs), "neardup-signatures")
    nodes = staged(
        signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
             F.first("n_shingles").alias("n_shingles"), F.first("mins").alias("mins")), "neardup-nodes")
    near = components(candidates(nodes))
    links = confirmed(docs, nodes, near)
    joined = components(links)
    # the smallest id of each class; a node without links is a class of its own
    lone = nodes.select("node", "rep", "copies")
    member = joined.join(lone, "node")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = member.join(least, "component").select("node", "component_id")
    copied = lone.filter("copies > 1").join(joined, "node", "left_anti") \
        .select("node", F.col("rep").alias("component_id"))
    known = staged(linked.unionByName(copied), "neardup-classes")
    return signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")) \
        .join(known, "node", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id,
       d.doc_id = min(r.reach) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest id."""
    docs = docs.select(DOC_COLUMNS)
    gone = staged(classes(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "neardup-gone")
    # the texts stay where they are while the ids (8 bytes each) are few
    few = F.broadcast if gone.count() <= BROADCAST_MEMBERS else (lambda x: x)
    return docs.join(few(gone), "doc_id", "left_anti").select(DOC_COLUMNS)
