"""Exact Jaccard join of documents as sets of word n-grams, in the metric space of the Jaccard distance.

Two documents link when the distance of their sets is at most r. All others at distance
1 are of no interest, so pivots are elected where sets overlap: two sets within r share
one of their rarest n-grams (as many of each set as r lets it lose), and the sets that
share such a rare n-gram elect one of them as its pivot. A set joins the region of every
pivot that it sees, which is its own Voronoi region and those whose windows reach it.
Spark splits a region of many sets: their distances to several pivots are columns, every
set goes to the region of its nearest pivot and is copied to all that the triangle
inequality leaves open, until regions are small or connected. A task then does the same
inside a small region; a pair is compared exactly once its distances to a pivot differ by
no more than r and it isn't connected already. Regions give star edges, and components of
these are the result.

Rarity is judged by a table of counts of fixed size that all documents add to. Any order
gives exact results; this one keeps passages that many documents share out of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm import scratch
from upkeep.llm import words as wd
from upkeep.llm.components import connected_components

N = 4
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
BUCKETS = 1 << 16
#: A region of more sets than this is split by Spark; one of fewer is joined in a task.
REGION = 2_000
#: The same for a region's n-grams in total (16 MB of hashes).
REGION_GRAMS = 2_000_000
#: Pivots that a large region elects in a round.
FAN = 8
#: Rounds in which large regions are split; one that windows can't part in so many is joined in pairs of blocks.
DEPTH = 6
#: How often sets that can't link are looked for; more rounds leave fewer in regions, and none changes the result.
ROUNDS = 2
#: Ids that may be broadcast to pick out texts (16 MB); beyond it, a shuffled join does.
BROADCAST_IDS = 2_000_000


def sets_of(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; a shorter text is one n-gram, one without words none."""
    flat, at = wd.buffers(column)
    for i, j in wd.slices(at):
        h, _, _, by_text = wd.words(flat[at[i] : at[j]], at[i : j + 1] - at[i])
        all_grams = wd.shingles(h, n)
        for r in range(j - i):
            a, b = by_text[r], by_text[r + 1]
            if b - a >= n:
                yield np.unique(all_grams[a : b - n + 1])
            elif b > a:
                yield wd.shingles(h[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def print_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set; with the size, it stands for the set."""
    both = np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64)], np.uint64) if len(s) else np.zeros(2, np.uint64)
    x = wd.mix(both)
    return int(wd.mix(x[:1] + np.uint64(3) * x[1:]).view(np.int64)[0])


def sure_overlap(size: int) -> int:
    """How many n-grams of the prefixes two linking sets are sure to share, as set by the smaller one of this size."""
    return 1 + size // 20


def prefix_size(size: int, percent: int = PERCENT) -> int:
    """How many of its rarest n-grams a set must show.

    A set of this size shares all but ``size - ceil(size * percent / 100)`` with one that it links with. Shown
    that many and k more, both show k of the shared ones at least, k being that of the smaller set.
    """
    return min(size, size - -(-percent * size // 100) + sure_overlap(size))


class Unions:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def join_region(sets: list[np.ndarray], percent: int = PERCENT, small: int = 64, fan: int = FAN, known: list | None = None) -> np.ndarray:
    """For each set the first set it is connected with, by links inside the region or because ``known`` names the same component; exact."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    unions, r = Unions(len(sets)), 1 - percent / 100
    first_of: dict = {}
    for i, label in enumerate(known or []):
        unions.join(first_of.setdefault(label, i), i)

    def against(p: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of ``members`` to set p, and which of them link with it."""
        mark[ids[start[p] : start[p + 1]]] = True
        n = size[members]
        first = np.cumsum(n) - n
        pick = np.repeat(start[members] - first, n) + np.arange(n.sum())
        shared = np.add.reduceat(mark[ids[pick]].astype(np.int64), first)
        mark[ids[start[p] : start[p + 1]]] = False
        union = n + size[p] - shared
        return 1 - shared / union, 100 * shared >= percent * union

    def roots(members: np.ndarray) -> np.ndarray:
        return np.array([unions.find(int(m)) for m in members])

    def settle(members: np.ndarray) -> None:
        """Compare every pair that the distances to one pivot leave open and that isn't connected."""
        d, linked = against(int(members[0]), members)
        for m in members[linked]:
            unions.join(int(members[0]), int(m))
        order = np.argsort(d, kind="stable")
        members, d = members[order], d[order]
        root = roots(members)
        last = np.searchsorted(d, d + r + 1e-9, "right")
        for i, m in enumerate(members):
            rest = members[i + 1 : last[i]]
            rest = rest[(root[i + 1 : last[i]] != root[i]) & (100 * np.minimum(size[rest], size[m]) >= percent * np.maximum(size[rest], size[m]))]
            if len(rest):
                _, linked = against(int(m), rest)
                if linked.any():
                    for x in rest[linked]:
                        unions.join(int(m), int(x))
                    root = roots(members)

    todo = [np.arange(len(sets))]
    while todo:
        members = todo.pop()
        if len(set(roots(members))) < 2:
            continue
        if len(members) <= small:
            settle(members)
            continue
        pivots = members[np.linspace(0, len(members) - 1, fan).astype(int)]
        d = np.empty((len(pivots), len(members)))
        for k, p in enumerate(pivots):
            d[k], linked = against(int(p), members)
            for m in members[linked]:
                unions.join(int(p), int(m))
        near = d.min(axis=0)
        own = d.argmin(axis=0)
        for k in range(len(pivots)):
            region = members[d[k] <= near + 2 * r + 1e-9] if (own == k).any() else members[:0]
            if len(region) > 0.7 * len(members):  # the windows don't part these sets
                settle(members)
                break
            todo.append(region)
    return roots(np.arange(len(sets)))


def _facts(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (bucket null) and of counts of n-grams by bucket (doc_id null, size is the count)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, id_type = np.zeros(BUCKETS, np.int64), ["doc_id", "bucket", "size", "fp"], None
        for b in batches:
            id_type = b.column(0).type
            size, fp = [], []
            for s in sets_of(b.column(1), n):
                size.append(len(s))
                fp.append(print_of(s))
                counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(counts, (s >> np.uint64(48)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(len(size), pa.int32()), pa.array(size, pa.int64()), pa.array(fp, pa.int64())], names=names)
        if id_type is not None:
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), id_type), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.nulls(len(used), pa.int64())], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, bucket int, size long, fp long")


def _prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """The rarest n-grams of every set: ``(gram, size, fp)``."""
    known = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, done = known.value, set()
        for b in batches:
            gram, size, fp, times = [], [], [], []
            for s in sets_of(b.column(1), n):
                mark = print_of(s)
                if len(s) and (len(s), mark) not in done:  # copies inside a task show their n-grams once
                    done.add((len(s), mark))
                    k = prefix_size(len(s), percent)
                    order = (count[s >> np.uint64(48)] << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
                    gram.append(s[np.argpartition(order, k - 1)[:k]] if k < len(s) else s)
                    size.append(len(s))
                    fp.append(mark)
                    times.append(k)
            if gram:
                columns = [np.concatenate(gram).view(np.int64), np.repeat(np.array(size, np.int32), times), np.repeat(np.array(fp, np.int64), times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "size", "fp"])

    return docs.mapInArrow(run, "gram long, size int, fp long")


def _elected(shown: DataFrame) -> DataFrame:
    """Rows of n-grams that two sets show or more, with the pivot: of the sets that show one, that with the smallest print.

    ``shown`` is dealt by n-gram already, so nothing is shuffled.
    """
    pivot = shown.groupBy("gram").agg(F.min(F.struct("fp", "size")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pivot = pivot.select("gram", F.col("p.size").alias("p_size"), F.col("p.fp").alias("p_fp"))
    return shown.join(pivot, "gram")


def _load(m: str, g: str) -> Column:
    """How many tasks' worth of sets or n-grams a region of ``m`` sets and ``g`` n-grams holds."""
    return F.greatest(F.col(m) / REGION, F.col(g) / REGION_GRAMS)


def _sets(src: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``rep, size, fp, grams`` of the documents whose ids are in ``wanted(rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = list(sets_of(b.column(1), n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in s], pa.int64()), pa.array([print_of(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())],
                names=["rep", "size", "fp", "grams"],
            )

    wanted = wanted.distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = src.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    kind = src.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"rep {kind}, size long, fp long, grams binary").dropDuplicates(["rep", "size", "fp"])


def _measured(members: DataFrame, sets: DataFrame, depth: int, percent: int) -> DataFrame:
    """Distances of every member of a large region to the region's pivots: ``region, rep, size, fp, pivot, d, linked``.

    A region elects up to FAN pivots, from sets that aren't known to be connected. ``d`` maps a pivot's slot to
    the distance, ``linked`` lists the pivots that the member links with and ``pivot`` tells that it is one. The
    members of a region are dealt to tasks of bounded size by a hash; each task gets the pivots.
    """
    kind = members.schema["rep"].dataType.simpleString()
    parts = F.ceil("load").cast("int")
    slot = F.pmod(F.xxhash64("label", F.lit(depth)), F.lit(FAN)).cast("int")
    pivots = members.groupBy("region", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep", F.lit(depth)).alias("h"), "rep", "size", "fp")).alias("p"), F.max(parts).alias("parts"))
    pivots = pivots.select("region", "slot", "p.rep", "p.size", "p.fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = pivots.join(sets, ["rep", "size", "fp"]).select("region", "part", "slot", "rep", "grams").toDF("to", "to_part", "slot", "by", "of")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(-1 - depth)), parts).cast("int"))
    dealt = dealt.join(sets, ["rep", "size", "fp"]).select("region", "part", "rep", "size", "fp", "grams")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        to = [(k, rep, np.frombuffer(grams, np.uint64)) for k, rep, grams in zip(*(right.column(c).to_pylist() for c in ("slot", "by", "of")), strict=True)]
        size, reps = left.column("size").to_numpy(), left.column("rep").to_pylist()
        flat = np.frombuffer(b"".join(left.column("grams").to_pylist()), np.uint64)
        first = np.cumsum(size) - size
        d, linked = [[] for _ in reps], [[] for _ in reps]
        for k, rep, grams in to:
            at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
            shared = np.add.reduceat((grams[at] == flat).astype(np.int64), first) if len(reps) else size
            union = size + len(grams) - shared
            for i, (x, link) in enumerate(zip((1 - shared / union).tolist(), (100 * shared >= percent * union).tolist(), strict=True)):
                d[i].append((k, x))
                if link and reps[i] != rep:
                    linked[i].append(rep)
        own = {rep for _, rep, _ in to}
        of = left.schema.field("rep").type
        return pa.table({
            "region": left.column("region"), "rep": left.column("rep"), "size": left.column("size"), "fp": left.column("fp"),
            "pivot": pa.array([rep in own for rep in reps], pa.bool_()), "d": pa.array(d, pa.map_(pa.int32(), pa.float64())), "linked": pa.array(linked, pa.list_(of)),
        })

    return dealt.groupBy("region", "part").cogroup(pivots.groupBy("to", "to_part")).applyInArrow(
        measure, f"region long, rep {kind}, size long, fp long, pivot boolean, d map<int, double>, linked array<{kind}>"
    )


def _split(src: DataFrame, members: DataFrame, n: int, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Deal the sets of large regions to the Voronoi regions of several pivots, again and again: links found, and members left to compare.

    A set goes to the region of its nearest pivot and to all whose distance is larger by no more than 2r, which
    by the triangle inequality brings together every pair within r. Pivots have then met all others and leave; so do regions whose
    members are all connected. A region is split only if the copies that its windows make are fewer than those of
    pairs of blocks, so rounds never add to the work; one that doesn't pay, or is still large after DEPTH rounds, is left as it is.
    """
    large = members.where("load > 1")
    if large.isEmpty():
        return None, members
    done, stars, r = members.where("load <= 1"), None, 1 - percent / 100
    sets = scratch.table(_sets(src, large.select("rep"), n), "region-sets")
    for depth in range(DEPTH):
        measured = scratch.table(_measured(large, sets, depth, percent), "distances")
        links = measured.select(F.col("rep").alias("a"), F.explode("linked").alias("b"))
        stars = links if stars is None else stars.unionByName(links)
        found = connected_components(stars)
        near = F.array_min(F.map_values("d")) + (2 * r + 1e-9)
        windows = F.map_keys(F.map_filter("d", lambda _, x: x <= near))
        left = measured.where("NOT pivot").select(F.col("region").alias("parent"), "rep", "size", "fp", windows.alias("windows"))
        left = left.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        left = scratch.table(left, "left")
        # what the regions of a round would hold is counted before any row is copied
        held = _open(left.select("parent", F.explode("windows").alias("k"), "size", "label"), "parent", "k")
        whole = _open(left, "parent").select("parent", F.col("load").alias("whole_load"), _copies("m", "load").alias("whole"))
        plan = held.groupBy("parent").agg(F.sum(_copies("m", "load")).alias("split")).join(whole, "parent")
        plan = scratch.table(plan.select("parent", "whole_load", (F.col("split") < F.col("whole")).alias("pays")), "plan")
        stuck = left.join(plan.where("NOT pays"), "parent").withColumnsRenamed({"parent": "region", "whole_load": "load"})
        dealt = left.join(plan.where("pays"), "parent").withColumn("k", F.explode("windows")).join(held, ["parent", "k"])
        dealt = dealt.withColumn("region", F.xxhash64("parent", "k"))
        both = stuck.select(*members.columns, F.lit(True).alias("stuck")).unionByName(dealt.select(*members.columns, F.lit(False).alias("stuck")))
        both = scratch.table(both, "members")
        done = done.unionByName(both.where("stuck OR load <= 1").drop("stuck"))
        large = both.where("NOT stuck AND load > 1").drop("stuck")
        if large.isEmpty():
            break
    return stars, done.unionByName(large)


def _open(rows: DataFrame, *keys: str) -> DataFrame:
    """``m`` and ``load`` of the regions named by ``keys`` that have members not known to be connected."""
    held = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.sum("size").alias("g"), F.min("label").alias("low"), F.max("label").alias("high"))
    return held.where("low <> high").select(*keys, "m", _load("m", "g").alias("load"))


def _parts(load: str) -> Column:
    """Blocks that a region is joined in."""
    return F.when(F.col(load) <= 1, 1).otherwise(F.ceil(F.col(load) * 2)).cast("int")


def _copies(m: str, load: str) -> Column:
    """Rows that a region sends when it is joined in pairs of blocks."""
    return F.col(m) * _parts(load)


def _region_links(src: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect all that links inside the regions connect.

    A region is one task's work; one that windows couldn't part is joined in pairs of blocks of half that size.
    """
    kind = src.schema["doc_id"].dataType.simpleString()
    blocks = members.withColumn("parts", _parts("load")).withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("rep", "size", "fp", "label", "region", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    full = blocks.join(_sets(src, members.select("rep"), n), ["rep", "size", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for reps, known, grams in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                order = sorted(range(len(reps)), key=reps.__getitem__)
                root = join_region([np.frombuffer(grams[i], np.uint64) for i in order], percent, known=[known[i] for i in order])
                for i, k in enumerate(root.tolist()):
                    if i != k:
                        a.append(reps[order[i]])
                        c.append(reps[order[k]])
            of = b.column(0).type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(a, of), pa.array(c, of)], names=["a", "b"])

    # a region holds at most REGION sets, or two blocks of about half as many
    gathered = full.groupBy("region", "b1", "b2").agg(F.collect_list("rep").alias("reps"), F.collect_list("label").alias("known"), F.collect_list("grams").alias("grams"))
    return gathered.where(F.size("reps") > 1).select("reps", "known", "grams").mapInArrow(links, f"a {kind}, b {kind}")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A text is lower-cased (A-Z) and its words are runs of bytes that aren't white space.
    Its set holds the distinct n-word sequences, or the whole text where it has fewer
    words; null texts and texts without words have the empty set and link with nothing.
    ``component_id`` is the smallest id that can be reached by links. Rows that repeat an
    id come out as often and are one node; a row with a null id links with nothing and has
    a null component. An n-gram is known by a 64-bit hash and a set by its size and one.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    facts = scratch.table(_facts(src, n), "sets")
    # one row per bucket, whatever the input
    buckets = facts.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("size").alias("c")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[buckets["bucket"].to_numpy()] = buckets["c"].to_numpy()
    rows = facts.where("bucket IS NULL").select("doc_id", "size", "fp")
    nodes = scratch.table(
        rows.where("size > 0 AND doc_id IS NOT NULL").groupBy("size", "fp").agg(F.min("doc_id").alias("rep")), "set-nodes"
    )
    shown = _prefixes(src, n, percent, counts).repartition("gram").groupBy("gram", "size", "fp").agg(F.lit(1).alias("one"))
    # a set that shares fewer of its n-grams than a link makes sure of links with nothing; without it, others may share too few
    least = 1 + F.floor(F.ceil(F.col("size") * percent / 100) / 20)
    for _ in range(ROUNDS):
        shown = scratch.table(_elected(shown).select("gram", "size", "fp"), "shown")
        linkable = shown.groupBy("size", "fp").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("size", "fp")
        shown = shown.join(linkable, ["size", "fp"], "left_semi").repartition("gram")
    seen = scratch.table(_elected(shown).select("p_size", "p_fp", "size", "fp").distinct(), "regions")
    # every member gets the id that stands for its set
    held = seen.groupBy("p_size", "p_fp").agg(F.count("*").alias("m"), F.sum("size").alias("g")).where("m > 1")
    members = seen.join(held, ["p_size", "p_fp"]).join(nodes, ["size", "fp"])
    members = members.select(F.xxhash64("p_size", "p_fp").alias("region"), "rep", F.col("size").cast("long").alias("size"), "fp", F.col("rep").alias("label"), _load("m", "g").alias("load"))
    members = scratch.table(members, "members")
    stars, members = _split(src, members, n, percent)
    edges = _region_links(src, members, n, percent)
    edges = edges if stars is None else edges.unionByName(stars)
    found = connected_components(edges).withColumnsRenamed({"node": "rep"})
    labels = nodes.join(found, "rep", "left").select("size", "fp", F.coalesce("component", "rep").alias("component"))
    return rows.join(labels, ["size", "fp"], "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id"))).alias("component_id"),
    )
