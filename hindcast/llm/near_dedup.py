"""Near-duplicate groups by SetSketch registers, bands, a joint likelihood estimate and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import setsketch as S
from . import windows as W
from .common import cut, forget, join_small, wide_table

#: Two texts link if 100 * shared >= LEAST * all shingles.
LEAST = 75
#: A comparison holds at most two parts of this many texts, with this many shingles each on average.
PART, PART_SHINGLES = 500, 4_000


def sketch(docs: DataFrame) -> DataFrame:
    """docs (id, th, text) to id, th, n, node (128-bit hash of the shingle set), regs (registers as bytes)."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("regs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = W.utf8(batch.column(2))
            n, node, regs = [], [], []
            for first, last in W.chunks(at, 2 << 20):
                base = int(at[first])
                for s in S.shingle_sets(data[base : int(at[last])], at[first : last + 1] - base):
                    n.append(len(s))
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(S.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def band_keys(regs: Column) -> Column:
    """A key for each run of ROWS registers, from their bytes and the run's number."""
    width = 2 * S.ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(S.BANDS - 1)), lambda b: F.xxhash64(F.substring(regs, b * width + 1, F.lit(width)), b))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def candidates(x: int, others: np.ndarray, n: np.ndarray, regs: np.ndarray, comp: np.ndarray, band: int) -> np.ndarray:
    """The others that may be linked with x: of another component, of a like size, not ruled out by the likelihood.

    A pair that also shares a band before this one is left to that band's group, so each pair is judged once.
    """
    y = others[comp[others] != comp[x]]
    y = y[100 * np.minimum(n[x], n[y]) >= LEAST * np.maximum(n[x], n[y])]
    if band and len(y):
        own = regs[:, : band * S.ROWS].copy().view(np.uint64)
        y = y[~(own[y] == own[x]).any(axis=1)]
    return y[S.may_link(regs[x : x + 1], regs[y], n[x : x + 1], n[y], LEAST / 100)] if len(y) else y


def meetings(main: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows of a group are compared with which: the main ones with the rest or, without main ones, all with all."""
    rest = np.flatnonzero(~main)
    if len(rest) < len(main):
        yield from ((int(x), rest) for x in np.flatnonzero(main))
    else:
        yield from ((x, np.arange(x + 1, len(main))) for x in range(len(main) - 1))


def links(sets: list[np.ndarray], regs: np.ndarray, comp: np.ndarray, main: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked among the sets and not yet in one component: pairs of row numbers.

    Candidates are counted in full, unless already connected, so a group reports fewer edges than it has rows.
    """
    n = np.array([len(s) for s in sets])
    label = np.unique(comp, return_index=True, return_inverse=True)
    label = label[1][label[2]].tolist()  # a row stands for its component

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    out = []
    for x, others in meetings(main):
        for z in candidates(x, others, n, regs, comp, band).tolist():
            i, j = top(x), top(z)
            if i != j:
                both = shared(sets[x], sets[z])
                if 100 * both >= LEAST * (len(sets[x]) + len(sets[z]) - both):
                    label[j] = i
                    out.append((x, z))
    return out


GROUP = ["key", "i", "j"]


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are sorted by their first three columns, as (those, the rest of each row)."""
    group, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, i, j, *row in zip(*columns, strict=True):
            if (key, i, j) != group:
                if len(rows) > 1:
                    yield group, rows
                group, rows = (key, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield group, rows


def arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Registers, components, main flags and sizes of rows (main, band, node, comp, n, regs, ...)."""
    regs = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint16).reshape(len(rows), -1)
    number: dict[bytes, int] = {}
    comp = np.array([number.setdefault(r[3], len(number)) for r in rows])
    return regs, comp, np.array([r[0] for r in rows]), np.array([r[4] for r in rows])


def dealt(groups: DataFrame, columns: list[str]) -> DataFrame:
    return groups.select(*GROUP, "main", "band", "node", "comp", "n", "regs", *columns).repartition(*GROUP).sortWithinPartitions(*GROUP, "node")


def plausible(groups: DataFrame) -> DataFrame:
    """Rows (key, i, j, main, band, node, comp, n, regs) to those (key, i, j, node) that have a candidate in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in by_group(batches):
            regs, comp, main, n = arrays(rows)
            some = np.zeros(len(rows), dtype=bool)
            for x, others in meetings(main):
                y = candidates(x, others, n, regs, comp, rows[0][1])
                some[y] = True
                some[x] |= len(y) > 0
            who = [rows[i][2] for i in np.flatnonzero(some)]
            if who:
                yield pa.RecordBatch.from_arrays([*[pa.array([g] * len(who), t) for g, t in zip(group, (pa.int64(), pa.int32(), pa.int32()), strict=True)], pa.array(who, pa.binary())], names=[*GROUP, "node"])

    return dealt(groups, []).mapInArrow(run, "key long, i int, j int, node binary")


def verified(groups: DataFrame) -> DataFrame:
    """Rows (key, i, j, main, band, node, comp, n, regs, text) to edges (a, b) between linked nodes, on full sets."""

    def judge(rows: list[tuple]) -> list[tuple]:
        texts = [r[6].encode() for r in rows]
        sets = []
        at = np.cumsum([0, *map(len, texts)])
        for first, last in W.chunks(at, 2 << 20):
            sets += S.shingle_sets(np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8), at[first : last + 1] - at[first])
        regs, comp, main, _ = arrays(rows)
        return [(rows[x][2], rows[y][2]) for x, y in links(sets, regs, comp, main, rows[0][1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches):
            edges = judge(rows)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return dealt(groups, ["text"]).mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node that can be reached.

    Each round a node takes the least label among its neighbours, then its label's label, until nothing changes.
    """
    # written once: which edges connect a group hangs on the order of its rows, and both directions must be of the same edges
    edges = cut(edges, "links")
    both = cut(edges.union(edges.select("b", "a")).distinct(), "edges")
    forget(edges)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        step = cut(step, "labels")
        roots = step.select(F.col("node").alias("root"), F.col("comp").alias("far"))
        jumped = cut(step.join(roots, step["comp"] == roots["root"]).select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        forget(step, labels)
        labels = jumped
        if not labels.where("old <> comp").limit(1).count():
            forget(both)
            return labels
        labels = labels.select("node", "comp")
        labels.cut_path = jumped.cut_path


def parts_of(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / PART), F.ceil(shingles / (PART * PART_SHINGLES))).cast("int")


def part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")


def numbers(upto: Column) -> Column:
    """0 to upto - 1."""
    return F.filter(F.sequence(F.lit(0), upto), lambda p: p < upto)


def meet(i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def stars(members: DataFrame) -> DataFrame:
    """Groups in which each node meets the hub, the least member, of each of its bands: as many rows as memberships at most.

    A hub that very many nodes meet has them dealt into parts, and stands in each.
    """
    pairs = members.where("h <> hub").select(F.col("hub").alias("key"), "node", "n").distinct()
    sizes = cut(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select(F.col("key").alias("_key"), parts_of(F.col("c"), F.col("s")).alias("parts")), "stars")
    rest = join_small(pairs, sizes, {"key": "_key"}, "inner").select("key", part_of(F.col("parts")).alias("i"), F.lit(False).alias("main"), "node")
    hubs = members.where("h = hub").select("hub", "node").distinct()
    hubs = join_small(hubs, sizes, {"hub": "_key"}, "inner").select(F.col("hub").alias("key"), F.explode(numbers(F.col("parts"))).alias("i"), F.lit(True).alias("main"), "node")
    return rest.union(hubs).select("key", "i", F.lit(0).alias("j"), "main", F.lit(0).alias("band"), "node", F.col("node").alias("comp"))


def apart(members: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Groups for what stars have not joined: in each band, nodes outside its largest component meet all others.

    The hub has met every node of its band already. None if no band has nodes of several components besides its hub.
    """
    found = comps.select(F.col("node").alias("_n"), "comp")
    left = members.where("h <> hub")
    left = cut(join_small(left, found, {"node": "_n"}, "left").select("key", "band", "node", "n", F.coalesce("comp", "node").alias("comp")), "left")
    each = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    bands = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "s", "comp")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("kinds >= 2")
    parts = parts_of(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("rests"), parts_of(F.col("most.c"), F.col("most.s")).alias("mains")
    bands = cut(bands.select(F.col("key").alias("_key"), F.col("most.comp").alias("_most"), *parts), "open")
    if not bands.limit(1).count():
        return None
    rows = join_small(left, bands, {"key": "_key"}, "inner").withColumn("main", F.col("comp") == F.col("_most"))
    own = part_of(F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    rests, mains = numbers(F.col("rests")), numbers(F.col("mains"))
    # main parts have numbers below zero
    main = F.transform(rests, lambda p: meet(p, -1 - own))
    rest = F.transform(mains, lambda q: meet(own, -1 - q))
    rest = F.concat(rest, F.transform(F.filter(rests, lambda p: (p != own) | (F.col("rests") == 1)), lambda p: meet(F.least(p, own), F.greatest(p, own))))
    rows = rows.select("key", "main", "band", "node", "comp", F.explode(F.when(F.col("main"), main).otherwise(rest)).alias("m"))
    return rows.select("key", "m.i", "m.j", "main", "band", "node", "comp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id of the component), kept (id = component_id).

    Texts with the same shingle set are one node. In each band the nodes first meet its least one, the hub; what links
    is contracted, and only nodes that are still apart meet each other, in groups of bounded size: first registers
    alone, then the texts of those that have a candidate. Bands with the same members count once. So a band of very
    many near copies costs a row per copy. A pair at the least similarity is missed by all bands with a chance of 3e-7;
    every link is confirmed on full sets.

    Null or empty texts, and those without words, have no shingles and link with nothing. A null id never names a
    component that has other ids. Rows with the same id and text answer alike. Very long texts are whole sets like
    others. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketched = cut(sketch(docs), "sketches")
    full = sketched.where(F.col("node").isNotNull())
    nodes = full.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "th")).alias("one"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = cut(nodes.withColumn("h", F.xxhash64("node")), "nodes")
    rows = cut(sketched.select("id", "n", "node"), "rows")
    forget(sketched)

    posts = nodes.select("h", F.posexplode(band_keys(F.col("regs"))).alias("band", "key"))
    keys = cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select(F.col("key").alias("_key")), "keys")
    posts = cut(join_small(posts, keys, {"key": "_key"}, "left_semi"), "posts")
    # bands with the same members are one, under the first band's number; nodes are told by 64 bits up to here
    bands = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("band").alias("t"), F.min("h").alias("hub"), F.max("h").alias("y"), F.bit_xor(F.xxhash64("h")).alias("z"))
    bands = cut(bands.groupBy("c", "hub", "y", "z").agg(F.min(F.struct("t", "key"))["key"].alias("_key")).select("_key", "hub"), "bands")
    kept = cut(join_small(posts, bands, {"key": "_key"}, "inner").select("key", "band", "h", "hub"), "kept")
    forget(keys, posts, bands)
    wanted = cut(kept.select(F.col("h").alias("_h")).distinct(), "wanted")
    picks = join_small(nodes, wanted, {"h": "_h"}, "left_semi").select("h", "node", "n", "regs", F.col("one.id").alias("_i"), F.col("one.th").alias("_t"))
    picks = cut(picks, "picks")
    texts = cut(join_small(docs, picks, {"id": "_i", "th": "_t"}, "inner").select(F.col("node").alias("_node"), "n", "regs", "text").dropDuplicates(["_node"]), "texts")
    names = picks.select(F.col("h").alias("_h"), "node", "n")
    members = cut(join_small(kept, names, {"h": "_h"}, "inner").select("key", "band", "h", "hub", "node", "n"), "members")
    forget(kept, wanted, picks)

    def with_texts(groups: DataFrame, own: DataFrame) -> DataFrame:
        return groups.join(own, groups["node"] == own["_node"]).drop("_node")

    comps = components(verified(with_texts(stars(members), texts)))
    groups = apart(members, comps)
    if groups is not None:
        groups = cut(groups, "apart")
        some = cut(plausible(with_texts(groups, texts.drop("text"))), "plausible")
        left = groups.join(some, [*GROUP, "node"], "left_semi")
        edges = verified(with_texts(left, texts))
        ends = comps.select(F.col("node").alias("_n"), "comp")
        for end in ("a", "b"):  # from nodes to the components that they are in
            edges = join_small(edges, ends, {end: "_n"}, "left").withColumn(end, F.coalesce("comp", end)).drop("_n", "comp")
        joined = components(edges.where("a <> b")).select(F.col("node").alias("_c"), F.col("comp").alias("far"))
        alone = joined.join(ends, F.col("_c") == F.col("_n"), "left_anti").select(F.col("_c").alias("node"), F.col("far").alias("comp"))
        comps = comps.join(joined, comps["comp"] == joined["_c"], "left").select("node", F.coalesce("far", "comp").alias("comp")).union(alone)
    low = nodes.select("node", "low").join(comps.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("comp", "node", "low")
    least = low.groupBy("comp").agg(F.min("low").alias("component"))
    named = cut(low.join(least, "comp").select(F.col("node").alias("_n"), "component"), "named")
    forget(members, texts)
    own = nodes.select(F.col("node").alias("_m"), "low")
    # written, so that the last join alone makes its stage and a set that very many rows have can be split
    alone = cut(own.join(named, own["_m"] == named["_n"], "left").select("_m", F.coalesce("component", "low").alias("component")), "answers")
    forget(nodes, named)
    out = rows.join(alone, F.col("node") == F.col("_m"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(wide_table(spark, sf_dir, "documents"))
