"""Near-duplicate documents: chosen-path similarity join on minwise tokens, exact confirmation.

A document is its set of word shingles (A-Z lower-cased); documents are linked if the sets'
Jaccard similarity reaches the threshold, and linked documents form components.

1. Equal sets are one from here on (by a 128-bit digest), however many copies there are.
2. Chosen paths: each of TREES independent trees branches the sets by selected minwise tokens: a
   set goes to the node named by its least shingle hash under the tree's hash function for that
   level. Small nodes are compared exhaustively by all minwise tokens of their sets. Larger nodes
   branch again, by the next level's token, and are compared exhaustively at the last level. All
   of this happens in the node's task, up to NODE_PART sets; a larger node is branched before it is
   dealt out, and if it is still larger at the last level it is cut into blocks that share pivots,
   and sets that these leave apart from most of their node are compared with all of it. Two sets at
   similarity 0.8 miss each other in all of ten first levels once in ten million times, in all of
   ten last levels, where every token is hot, 8 times in ten thousand.
3. Sets that agree in enough minwise tokens form clusters, which are larger than the components
   sought. Each set belongs to one cluster, so full texts are brought together once.
4. Confirmation: within a cluster full sets are compared, breadth first, each set with all that
   are not reached yet, so nothing but components and no pair leaves the task. A cluster of more
   than CLUSTER_SHINGLES is cut into blocks with the same pivots in all of them, whose components
   are joined up; then all sets outside the cluster's largest component are compared with all of
   it, block by block, so its links are exact, too.

The limits bound how many sets and shingles a task holds (of one set at a time, however long), not
what is compared: each node's sets are all compared or connected already, so only the trees carry
the recall. What is left of a node or cluster beyond them is compared in time with the square of
what is not connected with most of it.

Words are runs of characters other than space and tab to carriage return. A text with fewer words
than a shingle is one shingle; null text or one without words has an empty set, is linked with
nothing and is a component by itself. The component id is its least document id. Rows that share
an id and a set are one document; rows that share an id only are compared like others. Null ids
come after all others: a component of null ids alone has a null id, and its rows are kept. Other
columns are ignored by `near_duplicates` and kept by `keep_one`, which gives a single row of each
component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.components import connected
from tallylog.llm.repeats import NO_ID, keyed, own_id
from tallylog.llm.shared import cut, row_key, split_join, text_slices
from tallylog.llm.words import distinct_pairs, mix, split_words

SHINGLE_WORDS = 5
#: Similarity as a percentage, compared in whole numbers.
PERCENT = 80
TREES, LEVELS = 10, 3
TOKENS = TREES * LEVELS
#: Sets of a node that is compared exhaustively.
SMALL_NODE = 128
#: Sets of a node that one task branches on and compares; larger ones are branched, in the end cut,
#: before.
NODE_PART = 1 << 14
#: Large nodes that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 10_000
#: Shingles of a cluster, and of a block of a larger one, confirmed in one task.
CLUSTER_SHINGLES = 4_000_000
PIVOTS = 32


def least_agreement(percent: int, tokens: int = TOKENS) -> int:
    """Tokens in which two sets have to agree to be compared in full: five standard deviations
    below what is expected at the threshold."""
    p = percent / 100
    return max(1, int(tokens * p - 5 * (tokens * p * (1 - p)) ** 0.5))


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """k_id, k_th, n_shingles, set_id (16 bytes), tokens (8 bytes for each of TOKENS) and sketch (the
    last byte of each) of keyed rows; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                text, hashes = distinct_pairs(*split_words(data, offsets, lower=True).shingles(words))
                first = np.searchsorted(text, np.arange(high - low + 1))
                count = np.diff(first)
                full = np.flatnonzero(count)
                at = first[:-1][full]
                tokens = np.empty((len(full), TOKENS), np.uint64)
                ids = np.empty((len(full), 2), np.uint64)
                if len(full):
                    for j in range(TOKENS):
                        tokens[:, j] = np.minimum.reduceat(mix(hashes, j + 10), at)
                    for j in (0, 1):
                        ids[:, j] = np.add.reduceat(mix(hashes, j), at)
                empty = count == 0
                spread = np.zeros(high - low, np.int64)
                spread[full] = np.arange(len(full))
                take = pa.array(spread, mask=empty)
                wide = tokens.astype(">u8").view(np.uint8).reshape(-1, 8 * TOKENS)
                columns = (ids.view(np.uint8).reshape(-1, 16), wide, wide[:, 7::8])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(count.astype(np.int64)),
                        *(pa.array([x.tobytes() for x in c], pa.binary()).take(take) for c in columns),
                    ],
                    ["k_id", "k_th", "n_shingles", "set_id", "tokens", "sketch"],
                )

    return rows.mapInArrow(run, "k_id long, k_th long, n_shingles long, set_id binary, tokens binary, sketch binary")


def _branched(group: np.ndarray, level: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and their groups (ascending) once groups of more than SMALL_NODE have
    branched by the next levels' tokens, as far as there are any."""
    order = np.arange(len(group))
    while True:
        large = (np.bincount(group)[group] > SMALL_NODE) & (level < LEVELS - 1)
        if not large.any():
            return order, group
        level = level + large
        token = np.where(large, steps[order, level], 0)
        by = np.lexsort((token, group))
        order, level, group, token = order[by], level[by], group[by], token[by]
        new = np.zeros(len(group), np.int64)
        new[1:] = (group[1:] != group[:-1]) | (token[1:] != token[:-1])
        group = np.cumsum(new)


def _near_pairs(group: np.ndarray, tokens: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that connect all rows which agree in enough tokens."""
    sizes = np.bincount(group)
    one, other = [], []
    # small groups in one go: each row with the next, with the one after next, and so on
    here = np.flatnonzero(sizes[group] <= SMALL_NODE)
    for step in range(1, SMALL_NODE):
        here = here[here + step < len(group)]
        here = here[group[here + step] == group[here]]
        if not len(here):
            break
        near = here[(tokens[here] == tokens[here + step]).sum(axis=1) >= agree]
        one.append(near)
        other.append(near + step)
    # large ones breadth first: each row with all that are not reached yet
    for g in np.flatnonzero(sizes > SMALL_NODE).tolist():
        left = np.flatnonzero(group == g)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                close = (tokens[left] == tokens[x]).sum(axis=1) >= agree
                near = left[close]
                one.append(np.full(len(near), x))
                other.append(near)
                queue += near.tolist()
                left = left[~close]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *other])


def _node_links(members: DataFrame, agree: int) -> DataFrame:
    """Links (a, b) of the sets of nodes (node, level, set_id, data): each set with the least row it
    is connected with in the node. Nodes branch on from their level; tokens are compared by the
    sketches in `data`."""

    def linked(node: np.ndarray, level: np.ndarray, ids: list[bytes], data: np.ndarray) -> pa.RecordBatch:
        steps = np.ascontiguousarray(data[:, TOKENS:]).view(np.int64)
        order, group = _branched(np.cumsum(np.diff(node, prepend=node[:1]) != 0), level, steps)
        one, other = _near_pairs(group, data[order, :TOKENS], agree)
        label = np.arange(len(ids))
        while len(one):
            least = np.minimum(label[one], label[other])
            before = label.copy()
            np.minimum.at(label, one, least)
            np.minimum.at(label, other, least)
            label = label[label]
            if np.array_equal(label, before):
                break
        moved = np.flatnonzero(label != np.arange(len(ids)))
        pick = lambda at: pa.array([ids[i] for i in order[at].tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pick(moved), pick(label[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column("node").to_numpy()
            # the last node goes on with the next batch
            end = len(node) if last else int(np.searchsorted(node, node[-1]))
            if end:
                ids = table.column("set_id").slice(0, end).to_pylist()
                data = np.frombuffer(b"".join(table.column("data").slice(0, end).to_pylist()), np.uint8).reshape(end, -1)
                yield linked(node[:end], table.column("level").to_numpy()[:end], ids, data)
            held = table.slice(end).to_batches()
            n = len(node) - end

        for batch in batches:
            for low in range(0, batch.num_rows, 4000):
                held.append(batch.slice(low, 4000))
                n += held[-1].num_rows
                if n >= 4000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    ordered = members.select("node", "level", "set_id", "data").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "a binary, b binary")


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets (set_id, tokens, sketch) which agree in enough tokens.

    A member of a node is (node, level, set_id, data): data is the sketch and the tree's tokens, one
    for each level, so rows stay short. They are dealt out once, by node; a node of up to NODE_PART
    sets is branched, as far as the levels go, by its task. A larger one is branched before that,
    which is known from a count by node.
    """
    agree = least_agreement(percent)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    token = lambda level: F.substring(F.col("tokens"), 8 * (F.col("tree") + TREES * level) + 1, F.lit(8))
    data = F.concat("sketch", *[token(level) for level in range(LEVELS)])
    step = lambda level: F.substring("data", TOKENS + 8 * level + 1, 8)
    members = sets.select("set_id", "tokens", "sketch", tree).select("set_id", "tree", data.alias("data"))
    members = members.select(F.xxhash64("tree", step(0)).alias("node"), F.lit(0).alias("level"), "set_id", "data")
    for level in range(LEVELS):
        hot = cut(members.where(F.col("level") == level).groupBy("node").count().where(F.col("count") > NODE_PART))
        if hot.isEmpty():
            return _node_links(members, agree)
        hot = hot.select("node", F.col("count").alias("_n"))
        known = members.join(F.broadcast(hot), "node", "left") if hot.count() <= BROADCAST_NODES else split_join(members, hot, ["node"], "left")
        large = F.col("_n").isNotNull()
        if level < LEVELS - 1:
            below = F.when(large, F.xxhash64("node", step(level + 1))).otherwise(F.col("node"))
            members = known.select(below.alias("node"), (F.col("level") + large.cast("int")).alias("level"), "set_id", "data")
    # sets that agree in all of a tree's tokens: blocks with the same pivots in each, then the rest
    crowded, ends = known.where(large).drop("level"), F.lit(LEVELS - 1).alias("level")
    blocks = F.ceil(F.col("_n") / NODE_PART).cast("long")
    number = F.pmod(F.xxhash64("set_id", "node"), blocks)
    own = crowded.select(F.xxhash64("node", number).alias("node"), ends, "set_id", "data")
    residue = F.pmod(F.xxhash64("set_id"), F.lit(PIVOTS)).alias("_residue")
    pivots = crowded.groupBy("node", blocks.alias("_blocks"), residue).agg(F.min(F.struct("set_id", "data")).alias("_pivot"))
    guests = pivots.select(
        "node", "_pivot.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_number")
    ).where(F.pmod(F.xxhash64("set_id", "node"), F.col("_blocks")) != F.col("_number"))
    guests = guests.select(F.xxhash64("node", "_number").alias("node"), ends, "set_id", "data")
    rows = known.where(~large).select("node", "level", "set_id", "data").unionByName(own).unionByName(guests)
    labels = connected(_node_links(rows, agree))
    ends_ = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return ends_.unionByName(_node_links(_rest_of_nodes(crowded, labels).withColumn("level", F.lit(LEVELS - 1)), agree))


def _rest_of_nodes(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (node, set_id, data) that bring each set of a large node (node, set_id, data) which is
    not connected with most of the node together with every set of the node: a block for each pair
    of a part of the former and a part of the latter."""
    named = crowded.select("node", "set_id", "data").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = cut(named.withColumn("label", F.coalesce("label", "set_id")))
    by_label = named.groupBy("node", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("node").agg(
        F.sum("n").alias("_n"), F.max("n").alias("_in_largest"), F.max_by("label", F.struct("n", "label")).alias("_largest")
    )
    parts = largest.where("_n > _in_largest").select(
        "node", "_largest",
        F.ceil(F.col("_n") / NODE_PART).cast("long").alias("_parts"),
        F.ceil((F.col("_n") - F.col("_in_largest")) / NODE_PART).cast("long").alias("_rests"),
    )
    placed = split_join(named, parts, ["node"])
    part, rest = F.pmod(F.xxhash64("set_id"), "_parts"), F.pmod(F.xxhash64("set_id"), "_rests")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - F.lit(1).cast("long")))
    every = placed.select("node", "set_id", "data", part.alias("_part"), numbers("_rests").alias("_rest"))
    # a set that is in the block already is not a guest there, too
    guests = placed.where("label <> _largest").select(
        "node", "set_id", "data", part.alias("_own"), numbers("_parts").alias("_part"), rest.alias("_rest")
    ).where("_part <> _own").drop("_own")
    return every.unionByName(guests).select(F.xxhash64("node", "_part", "_rest").alias("node"), "set_id", "data")


def linked_components(sizes: np.ndarray, shingles: np.ndarray, percent: int) -> np.ndarray:
    """Components of full sets: `shingles` holds the sets one after the other, as distinct numbers
    from 0 on. Label of each set: the number of the first set of its component.

    Breadth first: a set is compared with all sets not reached yet in one sweep over their
    shingles, and those it links are reached.
    """
    n = len(sizes)
    label = np.full(n, -1)
    marked = np.zeros(int(shingles.max(initial=-1)) + 1, bool)
    starts = np.cumsum(sizes) - sizes
    left = np.arange(n)  # sets not reached, and their shingles
    flat, flat_sizes = shingles, sizes
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            waiting = label[left] < 0
            if not waiting.any():
                break
            if waiting.sum() < 0.8 * len(left):
                flat = flat[np.repeat(waiting, flat_sizes)]
                left, flat_sizes = left[waiting], flat_sizes[waiting]
                waiting = np.ones(len(left), bool)
            own = shingles[starts[x] : starts[x] + sizes[x]]
            marked[own] = True
            common = np.add.reduceat(marked[flat].astype(np.int64), np.cumsum(flat_sizes) - flat_sizes)
            marked[own] = False
            union = flat_sizes + sizes[x] - common
            near = left[waiting & (100 * common >= percent * union)]
            label[near] = seed
            queue += near.tolist()
    return label


def _confirmed(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of the texts (block, set_id, text) of each block: every set with the least of
    its component there."""

    def linked(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        known = dict(rows)
        ids = sorted(known)
        sizes, parts = [], []
        texts = pa.array([known[i] for i in ids], pa.string())
        for low, high, data, offsets in text_slices(texts):
            text, hashes = distinct_pairs(*split_words(data, offsets, lower=True).shingles(words))
            sizes.append(np.bincount(text, minlength=high - low))
            parts.append(hashes)
        _, numbers = np.unique(np.concatenate(parts), return_inverse=True)
        label = linked_components(np.concatenate(sizes), numbers, percent)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([ids[i] for i in label.tolist()], pa.binary())], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for name, set_id, text in zip(*batch.columns):
                if name.as_py() != block:
                    if len(held) > 1:
                        yield linked(held)
                    block, held = name.as_py(), []
                held.append((set_id.as_py(), text.as_py()))
        if len(held) > 1:
            yield linked(held)

    ordered = members.select("block", "set_id", "text").repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(run, "a binary, b binary")


def _blocks(clusters: DataFrame) -> DataFrame:
    """Rows (set_id, block) of sets (set_id, n_shingles, label), a set in several blocks where its
    cluster is cut."""
    sizes = clusters.groupBy("label").agg(F.sum("n_shingles").alias("_total"))
    sized = clusters.join(sizes, "label")
    whole = sized.where(F.col("_total") <= CLUSTER_SHINGLES).select("set_id", F.xxhash64("label").alias("block"))
    large = sized.where(F.col("_total") > CLUSTER_SHINGLES).withColumn(
        "_blocks", F.ceil(2 * F.col("_total") / CLUSTER_SHINGLES).cast("long")
    )
    dealt = large.select("set_id", F.xxhash64("label", F.pmod(F.xxhash64("set_id"), F.col("_blocks"))).alias("block"))
    # per cluster and residue one set is a pivot: it goes to all blocks
    residue = F.pmod(F.xxhash64("set_id", F.lit("pivot")), F.lit(PIVOTS))
    pivots = large.groupBy("label", "_blocks", residue).agg(F.min("set_id").alias("set_id"))
    guests = pivots.select(
        "set_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_number")
    ).select("set_id", F.xxhash64("label", "_number").alias("block"))
    return whole.unionByName(dealt).unionByName(guests).distinct()


def _rest_blocks(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (set_id, block) that bring each set of a cut cluster which is not in the cluster's
    largest component together with every set of the cluster: a block for each pair of a part of
    the former and a part of the latter."""
    sizes = clusters.groupBy("label").agg(F.sum("n_shingles").alias("_total")).where(F.col("_total") > CLUSTER_SHINGLES)
    large = clusters.join(sizes, "label").withColumnRenamed("label", "cluster")
    named = large.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("label", F.coalesce("label", "set_id"))
    by_label = named.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = by_label.groupBy("cluster").agg(
        F.max_by("label", F.struct("n", "label")).alias("_largest"), F.max_by("s", F.struct("n", "label")).alias("_in_largest")
    )
    part = CLUSTER_SHINGLES // 2
    placed = (
        named.join(largest, "cluster")
        .withColumn("_parts", F.ceil(F.col("_total") / part).cast("long"))
        .withColumn("_rests", F.ceil((F.col("_total") - F.col("_in_largest")) / part).cast("long"))
        .where("_rests > 0")
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    every = placed.select(
        "set_id", "cluster", F.pmod(F.xxhash64("set_id"), "_parts").alias("_part"),
        F.explode(F.sequence(zero, F.col("_rests") - one)).alias("_rest"),
    )
    rest = placed.where("label <> _largest").select(
        "set_id", "cluster", F.explode(F.sequence(zero, F.col("_parts") - one)).alias("_part"),
        F.pmod(F.xxhash64("set_id"), "_rests").alias("_rest"),
    )
    block = F.xxhash64("cluster", "_part", "_rest", F.lit("rest"))
    return every.unionByName(rest).select("set_id", block.alias("block")).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document whose id is the component's) of
    every row."""
    return _components(keyed(docs), words, percent).select(own_id(), "n_shingles", "component_id", _kept().alias("kept"))


def _kept() -> Column:
    return F.col("component_id").eqNullSafe(own_id())


def _groups(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of keyed rows, and the sets with the label of their component: set_id, least_id,
    one (the key of a row of the least id, null ids last) and label."""
    signed = cut(signatures(rows, words))  # numbers only; read several times below
    sets = cut(
        signed.where("set_id is not null").groupBy("set_id").agg(
            F.first("tokens").alias("tokens"),
            F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"),
            F.min(F.struct((F.col("k_id") == NO_ID).alias("late"), "k_id", "k_th")).alias("one"),
            F.min(own_id()).alias("least_id"),
        )
    )
    named = connected(candidate_links(sets, percent)).withColumnRenamed("node", "set_id")
    clusters = sets.select("set_id", "n_shingles", "one").join(named, "set_id")

    # copies of a row are one before texts are dealt out
    single = rows.groupBy("k_id", "k_th").agg(F.first("text").alias("text"))

    def confirmed(blocks: DataFrame) -> DataFrame:
        texts = single.join(blocks.select("block", "set_id", "one.k_id", "one.k_th"), ["k_id", "k_th"])
        return _confirmed(texts.select("block", "set_id", "text"), words, percent)

    sizes = clusters.groupBy("label").agg(F.sum("n_shingles").alias("_total"))
    if sizes.where(F.col("_total") > CLUSTER_SHINGLES).isEmpty():
        # a cluster is a block, so its links are the labels
        links = confirmed(clusters.select("set_id", "one", F.col("label").alias("block")))
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        places = sets.select("set_id", "one")
        labels = connected(confirmed(_blocks(clusters.drop("one")).join(places, "set_id")))
        rest = cut(_rest_blocks(clusters.drop("one"), labels))
        if not rest.isEmpty():
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = connected(known.unionByName(confirmed(rest.join(places, "set_id"))))
    members = sets.select("set_id", "least_id", "one").join(labels, F.col("set_id") == F.col("node"), "left")
    return signed, members.select("set_id", "least_id", "one", F.coalesce("label", "set_id").alias("label"))


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """k_id, k_th, n_shingles and component_id of keyed rows."""
    signed, members = _groups(rows, words, percent)
    names = members.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_set = members.join(names, "label").select("set_id", "component_id")
    found = signed.select("k_id", "k_th", "n_shingles", "set_id").join(by_set, "set_id", "left")
    alone = F.when(F.col("set_id").isNull(), own_id()).otherwise(F.col("component_id"))
    return found.select("k_id", "k_th", "n_shingles", alone.alias("component_id"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: that of the least id, null ids last, and of
    the least text digest where rows share it. Of rows that share id and text the one with the
    least digest of the other columns stays. Of rows without words those that share an id are one
    document; with null ids each is one."""
    names = docs.columns
    other = F.to_json(F.struct(*[c for c in names if c != "text"]))
    rows = docs.select(F.struct(*names).alias("_row"), F.xxhash64(other, F.col("text").isNull()).alias("_order"), "doc_id", "text")
    signed, members = _groups(keyed(rows), words, percent)
    full = members.groupBy("label").agg(F.min("one").alias("one")).select("one.k_id", "one.k_th")
    empty = signed.where("set_id is null").select("k_id", "k_th")
    named = empty.where(F.col("k_id") != NO_ID).groupBy("k_id").agg(F.min("k_th").alias("k_th"))
    unnamed = empty.where(F.col("k_id") == NO_ID).distinct()
    chosen = full.select("*", F.lit(True).alias("once")).unionByName(named.select("*", F.lit(True).alias("once")))
    chosen = chosen.unionByName(unnamed.select("*", F.lit(False).alias("once")))
    copies = signed.groupBy("k_id", "k_th").agg(F.count("*").alias("_n"))
    # numbers only; read twice below
    chosen = cut(chosen.join(copies, ["k_id", "k_th"]).select("k_id", "k_th", (F.col("once") & (F.col("_n") > 1)).alias("again")))
    own = rows.select("_row", "_order", *row_key())
    kept = own.join(chosen.where("not again"), ["k_id", "k_th"], "left_semi").select("_row")
    again = chosen.where("again").select("k_id", "k_th")
    if not again.isEmpty():
        # copies are summed up before they are dealt out
        copied = split_join(own, again, ["k_id", "k_th"], "left_semi").groupBy("k_id", "k_th")
        kept = kept.unionByName(copied.agg(F.min_by("_row", "_order").alias("_row")).select("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in names])
