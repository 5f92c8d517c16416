"""Exact n-gram Jaccard self-join that skips by set relations.

Documents are sets of word shingles; two link at a Jaccard similarity of the threshold or more. The
result is each document's component, so every link counts but need not be listed.

1. Equal sets are one class; only its representative goes on.
2. Shingles are counted exactly enough (a truncated key may count too high, never too low) to order
   every set from rare to frequent. Linked sets share a shingle within the first
   n - ceil(t n) + 1 places of both; a shingle of one document is in no index list.
3. Answer-level skipping: each index list has a hub, its smallest document. Hubs answer first: the
   overlap of every document of the list with its hub is computed. A document linked to hubs gets
   the smallest as its home. The Jaccard distance is a metric, so a hub's answers bound those of all
   documents near it. A list with many pairs between components draws more hubs, each of its component with
   most documents there and with few shingles of its own, which connect a large group of copies that differ by
   about the threshold.
4. Index-level skipping: within a list, entries are in blocks by component of the links so far, and by home
   within those, each with its least position and its sizes. Two blocks are skipped whole if they are of
   one component, or if position and sizes rule out every pair of them.
   For the homes of the blocks that remain, the overlap of the two homes is computed. They link; or
   they are so far apart (over 3 (1 - t)) that no documents near them can link; or documents near
   them are compared: one pair for each list, and where that doesn't connect them all pairs that
   position, size and the triangle inequality leave.
5. Overlaps are computed exactly, and components are found by label propagation.

A group of k near copies costs k comparisons with its hub, not k^2. No list, group or set of links
is gathered in one task or on the driver.

Defined cases: a text without words (null, empty) has no shingles and is its own component; a text
of fewer words than a shingle is one shingle; documents with equal keys are of one component; a null key
takes its class's component, or null; repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import joined
from ._exchange import block_of, free, n_blocks, pack, pack_counts, ranges, stored, unpack, unpack_counts
from ._text import Words, chunks, give_back, mix, shingles, string_bytes

_KEY_BITS = 44
#: Blocks of documents, for each shuffle partition: a block is held whole by a task.
BLOCKS_A_PARTITION = 3
#: Most times that a list with so many pairs of documents from different components draws another hub.
HUB_TURNS, CROWDED = 2, 100


@dataclass(frozen=True)
class JoinParams:
    """width: words in a shingle. percent: least Jaccard similarity, in hundredths."""

    width: int = 5
    percent: int = 75


def _sets(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, and the n + 1 places where texts begin."""
    data, offsets = string_bytes(column)
    parts = [shingles(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width) for a, b in chunks(offsets)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])


def _digests(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The size of each set and two 64-bit sums over it; equal sets have equal sums."""
    out = [np.diff(at)]
    with np.errstate(over="ignore"):
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def set_digests(docs: DataFrame, key: str, text: str, params: JoinParams) -> DataFrame:
    """(key, n, s1, s2): each row's key, with the size and sums of its text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["key"], *map(pa.array, _digests(*_sets(batch["text"], params.width)))], ["key", "n", "s1", "s2"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, s1 long, s2 long")


def _chosen(docs: pa.Table, reps: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and sets of those of the block's documents that represent a class, one document for each."""
    if len(docs) and len(reps):
        docs = docs.filter(pc.is_in(docs["key"], value_set=reps["key"].combine_chunks()))
    else:
        docs = docs.slice(0, 0)
    left = dict(zip(zip(*(reps[c].to_pylist() for c in ("key", "n", "s1", "s2")), strict=True), reps["node"].to_pylist(), strict=True)) if len(docs) else {}
    h, at = _sets(docs["text"], width)
    nodes = [left.pop(row, -1) for row in zip(docs["key"].to_pylist(), *(d.tolist() for d in _digests(h, at)), strict=True)]
    nodes = np.array(nodes, np.int64)
    if (nodes < 0).any():
        keep, n = nodes >= 0, np.diff(at)
        h, at, nodes = h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), nodes[keep]
    return nodes, h, at


_SENT = "block int, bucket int, keys binary, counts binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "keys", "counts"])


def _send(params: JoinParams, buckets: int):
    def send(docs: pa.Table, reps: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py() if len(docs) else None
        h = _chosen(docs, reps, params.width)[1]
        keys, counts = np.unique(h >> np.uint64(64 - _KEY_BITS), return_counts=True)
        cut = ranges(keys, buckets, _KEY_BITS)
        del h
        give_back()
        return _table([(block, i, pack(keys[a:b]), pack_counts(counts[a:b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b])

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each block those of its keys that two documents or more hold, with their number."""
    sent = [unpack(x.as_py()) for x in table["keys"]]
    keys, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]]), len(keys)).astype(np.int64)
    rows, done, bucket = [], 0, table["bucket"][0].as_py()
    for block, own in zip(table["block"].to_pylist(), sent, strict=True):
        n = total[inverse[done : done + len(own)]]
        done += len(own)
        if (n > 1).any():
            rows.append((block, bucket, pack(own[n > 1]), pack_counts(np.minimum(n[n > 1], 65535))))
    return _table(rows)


_INDEXED = "doc long, n long, tokens array<long>, places array<int>, members binary"


def _index(params: JoinParams):
    t = params.percent

    def index(docs: tuple[np.ndarray, np.ndarray, np.ndarray], answers: pa.Table) -> pa.Table:
        """Of each document that may have a partner: its size, the shared shingles of its prefix with their
        places, and its whole set."""
        names = ["doc", "n", "tokens", "places", "members"]
        doc, h, at = docs
        empty = lambda: pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())], names)
        if not len(h) or not len(answers):
            return empty()
        answers = answers.sort_by("bucket")
        shared = np.concatenate([unpack(x.as_py()) for x in answers["keys"]])
        count = np.concatenate([unpack_counts(x.as_py()) for x in answers["counts"]])
        key = h >> np.uint64(64 - _KEY_BITS)
        to = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        n_docs = np.where(shared[to] == key, count[to], 1)
        n = np.diff(at)
        prefix = n - (t * n + 99) // 100 + 1
        alone = np.diff(np.concatenate([[0], np.cumsum(n_docs == 1)])[at])
        out = []
        for d in np.flatnonzero((n > 0) & (alone < prefix)).tolist():
            a, b = at[d], at[d + 1]
            order = np.argsort(n_docs[a:b], kind="stable")[alone[d] : prefix[d]]
            out.append((d, h[a:b][order].view(np.int64), np.arange(alone[d], prefix[d], dtype=np.int32), h[a:b].tobytes()))
        if not out:
            return empty()
        row = [o[0] for o in out]
        lists = np.concatenate([[0], np.cumsum([len(o[1]) for o in out])]).astype(np.int32)
        token, place = (pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate([o[i] for o in out]))) for i in (1, 2))
        return pa.table([pa.array(doc[row]), pa.array(n[row]), token, place, pa.array([o[3] for o in out], pa.binary())], names)

    return index


def overlaps(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the size of the intersection of the two sets, counted exactly. A pair carries
    its two sets only within this step; large sides of a hot set are split by the skew join."""
    left = members.select(F.col("doc").alias("a"), F.col("members").alias("__a"))
    right = members.select(F.col("doc").alias("b"), F.col("members").alias("__b"))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(batch["__a"], batch["__b"], strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                out[i] = np.count_nonzero(b[at] == a)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out)], [*names, "overlap"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.join(left, "a").join(right, "b").select(*names, "__a", "__b").mapInArrow(run, f"{schema}, overlap long")


def similar_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams(), blocks: int | None = None) -> DataFrame:
    """Every row's key, n_shingles and component_id, the smallest key that links reach from it."""
    spark, t = docs.sparkSession, params.percent
    buckets = n_blocks(spark, blocks)
    blocks = blocks or BLOCKS_A_PARTITION * buckets
    sets = stored(set_digests(docs, key, text, params))
    # Rows that repeat key and set are added up before the classes are. A class is a node of the graph.
    once = sets.filter("n > 0").groupBy("key", "n", "s1", "s2").agg(F.count("*").alias("rows"))
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", (-F.col("rows")).alias("rows"))))
    classes = once.groupBy("n", "s1", "s2").agg(least.alias("least")).select("n", "s1", "s2", F.col("least.key").alias("rep"), (-F.col("least.rows")).alias("rows"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    reps = classes.filter("rep is not null").select(F.col("rep").alias("key"), "n", "s1", "s2", "node", block_of(blocks, "rep").alias("block"))
    rows = _fewer(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null"), classes).withColumn("block", block_of(blocks, "key"))
    sent = rows.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_send(params, buckets), _SENT)
    answers = stored(sent.groupBy("bucket").applyInArrow(_answer, _SENT))
    indexed = stored(_with_reps(rows, reps, answers, params))
    # A document's first place is the number of its shingles that no other has.
    entries = indexed.select("doc", "n", F.get("places", F.lit(0)).alias("own"), F.explode(F.arrays_zip("tokens", "places")).alias("e")).select("doc", "n", "own", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"))
    members = indexed.select("doc", "members")

    # 175 overlap >= 75 (n1 + n2), in hundredths, is the threshold; what is left of a prefix bounds the overlap.
    can = lambda rest1, rest2, n1, n2: ((100 + t) * F.least(rest1, rest2) >= t * (n1 + n2))
    sizes = lambda n1, n2: (100 * n1 >= t * n2) & (100 * n2 >= t * n1)
    linked = F.expr(f"{100 + t} * overlap >= {t} * (na + nb)")
    distance = F.expr("1 - overlap / (na + nb - overlap)")

    lists = entries.groupBy("token").agg(F.min(F.struct("doc", "n", "place")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("token", F.col("hub.doc").alias("a"), F.col("hub.n").alias("na"), F.col("hub.place").alias("pa"))
    star = entries.join(lists, "token").filter((F.col("doc") != F.col("a")) & sizes(F.col("n"), F.col("na")) & can(F.col("n") - F.col("place"), F.col("na") - F.col("pa"), F.col("n"), F.col("na")))
    first = stored(overlaps(star.select("a", F.col("doc").alias("b"), "na", F.col("n").alias("nb")).distinct(), members))
    links = first.filter(linked)
    homes = links.groupBy(F.col("b").alias("doc")).agg(F.min(F.struct("a", distance.alias("away"))).alias("m"))
    homes = stored(indexed.select("doc", "n").join(homes, "doc", "left").select("doc", "n", F.coalesce("m.a", "doc").alias("home"), F.coalesce("m.away", F.lit(0.0)).alias("away")))
    labels = joined(homes.select("doc", F.col("doc").alias("label")), links)

    for turn in range(1, HUB_TURNS + 1):
        now = entries.join(labels, "doc")
        drawn = F.min(F.struct(((F.col("own") + 1) * (500 + F.pmod(F.xxhash64("doc", "token", F.lit(turn)), F.lit(1000)))).alias("r"), "doc", "n", "place", "label")).alias("hub")
        parts = now.groupBy("token", "label").agg(drawn, F.count("*").alias("docs"))
        apart = F.sum("docs") * F.sum("docs") - F.sum(F.col("docs") * F.col("docs"))
        crowded = parts.groupBy("token").agg(apart.alias("apart"), F.max(F.struct("docs", "hub")).alias("m")).filter(F.col("apart") >= 2 * CROWDED).select("token", "m.hub")
        tried = now.join(crowded, "token").filter((F.col("label") != F.col("hub.label")) & sizes(F.col("n"), F.col("hub.n")) & can(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"), F.col("n"), F.col("hub.n")))
        tried = tried.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct()
        more = stored(overlaps(tried, members).filter(linked).select("a", "b"))
        if not more.limit(1).count():
            break
        labels = joined(labels, more)

    placed = entries.join(homes.drop("n"), "doc").join(labels, "doc")
    chosen = F.min(F.struct(F.xxhash64("doc", "token").alias("r"), F.col("doc").alias("x"), F.col("n").alias("nx")))
    block = stored(placed.groupBy("token", "label", "home").agg(F.max(F.expr("n - place")).alias("rest"), F.min("n").alias("least"), F.max("n").alias("most"), chosen.alias("one")))
    other = lambda blocks: blocks.select("token", *(F.col(c).alias(f"{c}2") for c in blocks.columns if c != "token"))
    fit = can(F.col("rest"), F.col("rest2"), F.col("least"), F.col("least2")) & (100 * F.col("most") >= t * F.col("least2")) & (100 * F.col("most2") >= t * F.col("least"))
    # Components that meet on a list, then their homes there: what hubs have connected is never paired again.
    whole = block.groupBy("token", "label").agg(F.max("rest").alias("rest"), F.min("least").alias("least"), F.max("most").alias("most"))
    apart = whole.join(other(whole), "token").filter((F.col("label") < F.col("label2")) & fit).select("token", "label", "label2")
    meet = apart.join(block, ["token", "label"]).join(other(block), ["token", "label2"]).filter(fit)
    meet = stored(meet.select("token", F.col("home").alias("a"), F.col("home2").alias("b"), F.col("one.x").alias("x"), F.col("one.nx").alias("nx"), F.col("one2.x").alias("y"), F.col("one2.nx").alias("ny"), F.col("rest2").alias("rest_b"), F.col("least2").alias("least_b"), F.col("most2").alias("most_b")))
    size_of = lambda name, n: homes.select(F.col("doc").alias(name), F.col("n").alias(n))
    of_homes = meet.select("a", "b").distinct().join(size_of("a", "na"), "a").join(size_of("b", "nb"), "b")
    second = stored(overlaps(of_homes.select("a", "b", "na", "nb"), members))
    labels = joined(labels, second.filter(linked))
    gray = second.filter(~linked & (distance <= 3 * (100 - t) / 100 + 1e-9)).select("a", "b", distance.alias("apart"))

    def unconnected(pairs: DataFrame) -> DataFrame:
        label = lambda name, as_: labels.select(F.col("doc").alias(name), F.col("label").alias(as_))
        return stored(pairs.join(label("a", "la"), "a").join(label("b", "lb"), "b").filter("la <> lb").select("a", "b", "apart"))

    # Homes that may be connected by documents near them: one pair of documents for each list first, then all.
    gray = unconnected(gray)
    for every in (False, True):
        if not gray.limit(1).count():
            break
        if every:
            reach = homes.groupBy("home").agg(F.max("away").alias("w"))
            wide = gray.join(reach.select(F.col("home").alias("a"), F.col("w").alias("ra")), "a").join(reach.select(F.col("home").alias("b"), F.col("w").alias("rb")), "b")
            shared = meet.select("token", "a", "b", "rest_b", "least_b", "most_b").join(wide, ["a", "b"])
            near = lambda home, doc, n, place, away: placed.select("token", F.col("home").alias(home), F.col("doc").alias(doc), F.col("n").alias(n), F.col("place").alias(place), F.col("away").alias(away))
            short = F.col("apart") - (100 - t) / 100 - 1e-9
            fits = can(F.col("nx") - F.col("px"), F.col("rest_b"), F.col("nx"), F.col("least_b")) & (100 * F.col("nx") >= t * F.col("least_b")) & (100 * F.col("most_b") >= t * F.col("nx"))
            left = shared.join(near("a", "x", "nx", "px", "wx"), ["token", "a"]).filter((F.col("wx") + F.col("rb") >= short) & fits)
            pairs = left.join(near("b", "y", "ny", "py", "wy"), ["token", "b"]).filter((F.col("wx") + F.col("wy") >= short) & can(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"), F.col("nx"), F.col("ny")))
        else:
            pairs = meet.join(gray, ["a", "b"]).filter((F.col("x") != F.col("a")) | (F.col("y") != F.col("b")))
        pairs = pairs.filter(sizes(F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).distinct()
        more = stored(overlaps(pairs, members).filter(linked).select("a", "b"))
        if more.limit(1).count():
            labels = joined(labels, more)
            gray = unconnected(gray)

    # Classes of one key are one component too; a component is named by its least key.
    of_node = classes.select("node", "rep").join(labels.withColumnRenamed("doc", "node"), "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    first_of = classes.filter("rep is not null").groupBy("rep").agg(F.min("node").alias("a"), F.count("*").alias("k")).filter("k > 1")
    again = stored(classes.join(first_of, "rep").select("a", F.col("node").alias("b")).filter("a <> b"))
    if again.limit(1).count():
        of_node = classes.select("node", "rep").join(joined(stored(of_node.select(F.col("node").alias("doc"), "label")), again).withColumnRenamed("doc", "node"), "node")
    of_node = stored(of_node)
    free(answers, indexed, first, homes, block, meet, second)
    names = of_node.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = classes.join(of_node.select("node", "label"), "node").join(names, "label").select("n", "s1", "s2", "component")
    return sets.join(of_class, ["n", "s1", "s2"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _fewer(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows without those that repeat the key and text of a representative, of which one task would get all."""
    often = stored(classes.filter("rows > 1").select(F.col("rep").alias("key")).distinct())
    if not often.limit(1).count():
        return rows
    return rows.join(often, "key", "left_anti").unionByName(rows.join(often, "key", "left_semi").distinct())


def _with_reps(rows: DataFrame, reps: DataFrame, answers: DataFrame, params: JoinParams) -> DataFrame:
    """The index rows of each block's representatives. The block's answers and its representatives come
    as one table, told apart by which columns are null."""
    index = _index(params)

    def run(docs: pa.Table, rest: pa.Table) -> pa.Table:
        is_rep = pc.is_null(rest["keys"])
        return index(_chosen(docs, rest.filter(is_rep), params.width), rest.filter(pc.invert(is_rep)))

    both = answers.unionByName(reps, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, _INDEXED)
