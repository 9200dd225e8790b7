"""MinHash near-duplicates with min-max hashing.

A permutation gives two signature values, the smallest and the largest hash of a text's
shingles, so 200 hash evaluations make 400 values.  The first 200 are cut into 40 bands of 5:
a pair of similarity 0.75 shares no band with a chance of 2e-5.  Of each value one byte is
kept to compare pairs by.  Every candidate is confirmed on the full shingle sets, so a link is
never wrong.

Work on groups stays linear.  Texts with one shingle set are one class, and only its
representative goes on.  It is compared with two leaders of its buckets; linked ones become one
component.  Only buckets that still hold several components are looked at again: members outside
the largest component against members of other components.  Those cells come with the full sets,
follow the components as they grow, and give a row only for a link that joins two of them.

Small tables pay for every shuffle and every written file, so rows that are grouped and joined by
one key are dealt out by it once, and the second round links components, not texts.

Defined results: null and empty texts have no shingles and are linked with nothing; rows
without an id are never linked, keep a null component and are kept; rows that repeat an id
share its component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import U64, Scratch, Words, grams, mix, ragged, seeds, slices, words_of

WORDS = 5
PERMUTATIONS, ROWS, BANDS = 200, 5, 40
PERCENT = 75
#: Of 400 values; at similarity 0.75 the mean is 300 and the deviation 8.7 at most, so a pair falls
#: below with a chance of 5e-10, far less than the 2e-5 of sharing no band.
AGREE = 245
#: About so many members of a bucket are compared with as many others in one cell.
CELL = 2000
#: Of the shingles of those texts, about so many.
CELL_SHINGLES = 2_000_000
#: Classes of several rows are broadcast up to so many (three numbers each), and joined by a shuffle beyond.
SMALL_COPIES = 200_000

_FACTOR = seeds(PERMUTATIONS, 11)
_SHIFT = seeds(PERMUTATIONS, 12)
_BAND = seeds(ROWS, 13)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts)
    hashes, at = grams(words, WORDS)
    doc = words.doc[at]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    many = np.bincount(words.doc, minlength=len(texts))
    for i in np.flatnonzero((many > 0) & (many < WORDS)):
        own = np.flatnonzero(words.doc == i)
        short = Words(words.doc[own], words.start[own], words.end[own], words.hash[own], words.data, words.first)
        sets[i] = grams(short, len(own))[0]
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of min and max values per set; the sets hold at least one hash each."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for i in range(PERMUTATIONS):
        hashed = flat * _FACTOR[i] + _SHIFT[i]
        out[:, 2 * i] = np.minimum.reduceat(hashed, begin) >> U64(32)
        out[:, 2 * i + 1] = np.maximum.reduceat(hashed, begin) >> U64(32)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(U64)
    return mix((rows * _BAND).sum(axis=2, dtype=U64) + seeds(BANDS, 14))


_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        sets = shingle_sets(texts)
        full = [s for s in sets if len(s)]
        has = np.fromiter((len(s) > 0 for s in sets), bool, len(sets))
        sign = signatures(full) if full else np.empty((0, 2 * PERMUTATIONS), np.uint32)
        digest = np.zeros((2, len(sets)), U64)
        for i, s in enumerate(sets):
            if len(s):
                digest[:, i] = mix(s).sum(dtype=U64), mix(s * _FACTOR[0] + U64(len(s))).sum(dtype=U64)
        digest = digest.view(np.int64)
        rest = iter(sign.astype(np.uint8))
        short = [next(rest).tobytes() if h else None for h in has]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(digest[0], mask=~has), pa.array(digest[1], mask=~has),
            ragged(bands(sign).view(np.int64).ravel(), has * BANDS, pa.int64()),
            pa.array(short, pa.binary()),
        ], ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        sets = shingle_sets(texts)
        flat = np.concatenate(sets).view(np.int64)
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        version = np.fromiter((mix(s).sum(dtype=U64) for s in sets), U64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(version), ragged(flat, counts, pa.int64())], ["id", "v", "shingles"])


def _roots(up: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(a, p)`` with ``p`` the end of the chain of parents that ``a`` hangs in; each step doubles what it spans."""
    step = 0
    while True:
        top = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        up = scratch.write(up.select("a", "p").join(top, "p")
                           .select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), f"{name}-{step}")
        if up.filter("moved").isEmpty():
            return up.select("a", "p")
        step += 1


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, component)`` of all ids in the links ``(a, b)``; the component is its smallest id.

    Every id hangs itself below its smallest neighbour, and links between ids of different
    parents go on, contracted, to the next turn.  Most groups are stars and end in the first
    turn; what is left are chains, so later turns follow them to their ends, and each of those at
    least halves the ids of a component.  No turn makes more links than it had.
    """
    label, turn = None, 0
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = scratch.write(up, f"{name}-up{turn}")
        if turn:
            up = _roots(up, scratch, f"{name}-roots{turn}")
        left, right = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        if label is None:
            label = up.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            label = _moved(label, up.select(F.col("a").alias("id"), F.col("p").alias("component")))
        edges = (edges.join(left, "a").join(right, "b").filter("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")))
        edges = scratch.write(edges, f"{name}-links{turn}")
        turn += 1
        if edges.isEmpty():
            return scratch.write(label, f"{name}-labels")


def _moved(label: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after their components are joined as ``found`` tells."""
    step = found.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return label.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def _sized(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``(a, b)`` of the pairs ``(a, av, b, bv)`` whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("v").alias("av"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("v").alias("bv"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(two, ["b", "bv"]).join(one, ["a", "av"]).withColumn("common", common)
            .filter(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * PERCENT)
            .select("a", "b"))


class _Found:
    """Components as they grow together inside one task."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.code = np.unique(labels, return_inverse=True)
        self.parent = np.arange(len(self.labels))

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: int, b: int) -> None:
        roots = self.roots()
        x, y = roots[self.code[a]], roots[self.code[b]]
        self.parent[max(x, y)] = min(x, y)


def _similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets are near enough to a sorted one."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    common = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return common * 100 >= (len(one) + sizes - common) * PERCENT


def _compare(cells: pa.Table, full: pa.Table) -> pa.Table:
    """Links between components of the cells ``(key, ub, kb)``, confirmed on the full sets in ``full``.

    A link is named by the two components it joins.  It is looked for only between texts whose components are not joined yet, so a cell gives
    fewer links than it has members.  A pair that shares several buckets is looked at in the one
    of its first shared band.
    """
    key, ub, kb, n, c, main, ids, v = (cells.column(x).to_numpy() for x in ("key", "ub", "kb", "n", "c", "main", "id", "v"))
    left, right = (cells.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("left", "right"))
    place = {k: i for i, k in enumerate(zip(full.column("own").to_pylist(), full.column("version").to_pylist()))}
    text = np.fromiter((place[k] for k in zip(ids.tolist(), v.tolist())), np.int64, len(ids))
    sign = np.frombuffer(b"".join(full.column("signature").to_pylist()), np.uint8).reshape(full.num_rows, -1)
    band = np.array(full.column("short").to_pylist(), np.int32)
    lists = full.column("shingles").combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(U64), np.cumsum(lists.value_lengths().to_numpy())
    begins = np.concatenate([[0], ends[:-1]])
    own = (key >> 32).astype(np.int32)
    order = np.lexsort((kb, ub, key))
    cell = np.stack([key, ub, kb])[:, order]
    edge = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0), [True]]))
    found, links = _Found(c), []
    for begin, end in zip(edge[:-1], edge[1:]):
        rows = order[begin:end]
        ks = rows[right[rows]]
        for u in rows[left[rows]]:
            root = found.roots()[found.code]
            small, large = np.minimum(n[u], n[ks]), np.maximum(n[u], n[ks])
            fit = (small * 100 >= large * PERCENT) & (root[u] != root[ks]) & ((c[ks] == main[ks]) | (ids[u] < ids[ks]))
            near = ks[fit]
            near = near[(sign[text[u]] == sign[text[near]]).sum(axis=1) >= AGREE]
            first = (band[text[u]] == band[text[near]]).argmax(axis=1)
            near = near[band[text[u], first] == own[near]]
            while len(near):
                now, near = near[:64], near[64:]
                t = text[u]
                good = _similar(flat[begins[t] : ends[t]], [flat[begins[k] : ends[k]] for k in text[now]])
                for k in now[good]:
                    root = found.roots()[found.code]
                    if root[u] != root[k]:
                        found.join(u, k)
                        links.append((min(c[u], c[k]), max(c[u], c[k])))
                if good.any():
                    root = found.roots()[found.code]
                    near = near[root[near] != root[u]]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def _across(held: DataFrame, sign: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links across the components of a bucket: members outside the largest one against all others.

    Buckets of one largest component lie together, so a text comes once with its set however many
    buckets it is in.  Where texts or shingles are many, blocks meet blocks, so a cell stays small.
    """
    apart, zero = F.col("c") != F.col("main"), F.lit(0).cast("long")
    texts = held.select("main", "id", "v", "n", "c").distinct()
    blocks = lambda count, size: F.greatest(F.lit(1), F.ceil(F.coalesce(count, zero) / CELL), F.ceil(F.coalesce(size, zero) / CELL_SHINGLES))
    cells = (texts.groupBy("main").agg(F.count("*").alias("m"), F.sum("n").alias("mn"), F.sum(apart.cast("long")).alias("u"),
                                       F.sum(F.when(apart, F.col("n"))).alias("un"))
             .withColumn("bk", blocks(F.col("m"), F.col("mn"))).withColumn("bu", blocks(F.col("u"), F.col("un"))))
    cells = scratch.write(cells, "cells")
    load = cells.agg(F.sum(F.greatest((F.col("m") * F.col("bu") + F.col("u") * F.col("bk")) / CELL,
                                      (F.col("mn") * F.col("bu") + F.coalesce("un", zero) * F.col("bk")) / CELL_SHINGLES))).first()[0]
    rows = held.join(cells.select("main", "bk", "bu"), "main")
    own, other = F.xxhash64("id"), lambda b: F.explode(F.sequence(zero, F.col(b) - 1))
    base, one = ("key", "id", "v", "n", "c", "main"), (F.col("bk") == 1) & (F.col("bu") == 1)
    single = rows.filter(one).select(*base, apart.alias("left"), F.lit(True).alias("right"), zero.alias("kb"), zero.alias("ub"))
    asked = rows.filter(~one & apart).select(*base, F.lit(True).alias("left"), F.lit(False).alias("right"),
                                             other("bk").alias("kb"), F.pmod(own, "bu").alias("ub"))
    members = rows.filter(~one).select(*base, F.lit(False).alias("left"), F.lit(True).alias("right"),
                                       F.pmod(own, "bk").alias("kb"), other("bu").alias("ub"))
    groups = max(1, math.ceil(load or 0))
    dealt = scratch.write(single.unionByName(asked).unionByName(members)
                          .withColumn("g", F.pmod(F.xxhash64("main", "ub", "kb"), F.lit(groups))), "dealt")
    # all three meet by id and text, so the rows wanted are dealt out by them before they are made distinct
    wanted = dealt.select("id", "v", F.col("g").alias("to")).repartition("id", "v").distinct()
    wanted = (wanted.join(sign, ["id", "v"]).join(sets.dropDuplicates(["id", "v"]), ["id", "v"])
              .withColumnsRenamed({"id": "own", "v": "version"}))
    return dealt.groupBy("g").cogroup(wanted.groupBy("to")).applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.write(texts.mapInArrow(_features, _FEATURES), "features")

    # one row per class of texts with one shingle set, that of its representative
    best = F.min(F.struct("doc_id", "n_shingles", "bands", "signature"))
    classes = (feats.filter("doc_id IS NOT NULL AND d1 IS NOT NULL").groupBy("d1", "d2").agg(best.alias("r"), F.count("*").alias("many"))
               .select(F.col("r.doc_id").alias("id"), F.col("d1").alias("v"), "d2", F.col("r.n_shingles").alias("n"),
                       "r.bands", "r.signature", "many"))
    classes = scratch.write(classes, "classes")
    copies = classes.filter("many > 1").select(F.col("v").alias("d1"), "d2", F.col("id").alias("rep"))
    copies = F.broadcast(copies) if copies.count() <= SMALL_COPIES else copies
    member = (feats.select("doc_id", "n_shingles", "d1", "d2").join(copies, ["d1", "d2"], "left")
              .select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")))
    member = scratch.write(member, "members")
    scratch.drop("features")

    # an id that stands on several rows with unlike texts joins their classes
    repeated = (member.filter("rep IS NOT NULL").groupBy("doc_id")
                .agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id"))
    same_id = (member.join(repeated, "doc_id", "left_semi")
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    unlike = not repeated.isEmpty()

    keys = classes.select("id", "v", "n", F.explode("bands").alias("key"))
    # one leader per bucket; buckets of one id end here
    led = (keys.groupBy("key").agg(F.min(F.struct("id", "v", "n")).alias("l"), F.max("id").alias("last"))
           .filter("l.id <> last").select("key", F.col("l.id").alias("leader"), F.col("l.v").alias("lv"), F.col("l.n").alias("ln")))
    buckets = scratch.write(keys.join(led, "key"), "buckets")
    ids = buckets.select("id").distinct()
    sets = scratch.write(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
                         .mapInArrow(_sets, "id long, v long, shingles array<long>"), "sets")
    # a text first meets two leaders: the one it shares most buckets with, and the smallest
    lead = (buckets.filter("id <> leader").filter(_sized("n", "ln")).select("id", "v", "leader", "lv").repartition("id", "v")
            .groupBy("id", "v", "leader", "lv").agg(F.count("*").alias("many"))
            .groupBy("id", "v").agg(F.max_by(F.struct("leader", "lv"), F.struct("many", -F.col("leader"))).alias("most"),
                                    F.min(F.struct("leader", "lv")).alias("least"))
            .select("id", "v", F.explode(F.array_distinct(F.array("most", "least"))).alias("l")))
    pairs = lead.select(F.col("l.leader").alias("a"), F.col("l.lv").alias("av"), F.col("id").alias("b"), F.col("v").alias("bv"))
    linked = _confirm(pairs, sets)
    linked = scratch.write(linked.union(same_id) if unlike else linked, "links0")
    label = components(linked, scratch, "cc0")

    # buckets that hold several components still
    held = (buckets.select("key", "id", "v", "n").join(label, "id", "left")
            .select("key", "id", "v", "n", F.coalesce("component", "id").alias("c")))
    counted = held.groupBy("key", "c").agg(F.count("*").alias("m"))
    most = (counted.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("many"))
            .filter("many > 1").drop("many"))
    held = scratch.write(held.join(most, "key"), "open")
    sign = classes.select("id", "v", "signature", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("short"))
    more = scratch.write(_across(held, sign, sets, scratch), "links1")
    if not more.isEmpty():
        found = components(more, scratch, "cc1")
        label = scratch.write(_moved(label, found).union(found.join(label.select("id"), "id", "left_anti")), "labels")
    scratch.drop("classes", "buckets", "sets", "open", "cells", "dealt")

    rep = label.select(F.col("id").alias("rep"), "component")
    out = member.join(rep, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
