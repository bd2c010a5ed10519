"""MinHash near-duplicates: DartMinHash signatures of weighted shingles, banded, verified, joined to classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.shingles import mix, similarity, weighted
from wordloom.storage import (arrow_batches, hot_keys, is_small, join_dealt, join_skewed, join_small, materialize, release,
                              sortable)

COORDINATES, ROWS = 96, 4
BANDS = COORDINATES // ROWS
THRESHOLD = 0.8
#: Darts that a text gets on average in a throw: all coordinates are hit in one with high probability.
DARTS = COORDINATES * (np.log(COORDINATES) + 2.5)
#: Strips that expect up to so many darts are thrown at in turns; others in matrices of so many cells.
TURNS, CELLS = 6.0, 1 << 18
MASK = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _darts(seed: np.ndarray, limit: np.ndarray, wide: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which strip, rank and id of all darts of a region up to each strip's limit.

    Strips that expect few darts are thrown at together, one dart each a turn, until none
    falls short of its limit. Those that expect many get theirs as rows of a matrix. Gaps add
    up in the same order either way, so a strip's darts are the same in every text.
    """
    many = np.flatnonzero(limit * wide > TURNS)
    step = np.uint64(int(_GOLD))
    for size in np.unique(np.ceil(np.log2(limit[many] * wide))).astype(int):
        own = many[np.ceil(np.log2(limit[many] * wide)).astype(int) == size]
        width = int(2.0 ** size + 7 * 2.0 ** (size / 2) + 20)  # beyond the limit in all but 1e-11 of strips
        for at in range(0, len(own), max(1, CELLS // width)):
            strip, n = own[at:at + max(1, CELLS // width)], np.arange(1, width + 1, dtype=np.uint64)
            while len(strip):
                dart = mix(seed[strip, None] + n * step)
                rank = np.cumsum(-np.log(_uniform(dart)) / wide, axis=1)
                fell = rank <= limit[strip, None]
                short = fell[:, -1]
                row, column = np.nonzero(fell & ~short[:, None])
                yield strip[row], rank[row, column], dart[row, column]
                strip, n = strip[short], np.arange(1, 2 * len(n) + 1, dtype=np.uint64)
    strip, n = np.flatnonzero(limit * wide <= TURNS), 0
    rank = np.zeros(len(strip))
    while len(strip):
        n += 1
        dart = mix(seed[strip] + np.uint64(n * int(_GOLD) & MASK))
        rank = rank - np.log(_uniform(dart)) / wide
        fell = rank <= limit[strip]
        strip, rank = strip[fell], rank[fell]
        yield strip, rank, dart[fell]


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Dart signatures of weighted sets: owners x coordinates, 64-bit dart ids.

    Element ``x`` has a strip of the plane, weight across and rank along. The strip is split
    into regions by weight, [0,1), [1,2), [2,4), [4,8) and so on, and along each region darts
    fall as a Poisson process of the region's width: each gap, place across and coordinate is
    a hash of (element, region, dart number), hence the same in every text. A text keeps the
    darts that fall left of its weight, and each coordinate keeps the kept dart of least rank.
    Two texts agree on a coordinate with the probability of their weighted Jaccard similarity.
    Darts are thrown up to a rank at which a text is expected to keep ``DARTS``; where that
    leaves a coordinate empty, the text throws again, four times as far.
    """
    best = np.full(owners * COORDINATES, np.inf)
    sign = np.zeros(owners * COORDINATES, np.uint64)
    total = np.bincount(owner, weights, owners)
    todo, reach = total > 0, DARTS / np.maximum(total, 1e-12)
    while todo.any():
        pick = todo[owner]
        x, w, o = elements[pick], weights[pick], owner[pick]
        top = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64)
        for region in range(int(top.max()) + 1):
            own = top >= region
            low, wide = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1),) * 2
            seed, width, holder = mix(x[own] * _GOLD + np.uint64(region)), w[own] - low, o[own]
            for strip, rank, dart in _darts(seed, reach[holder], wide):
                second = mix(dart ^ _GOLD)
                kept = _uniform(second) * wide < width[strip]
                place = (mix(second[kept]) % np.uint64(COORDINATES)).astype(np.int64)
                cell, rank, dart = holder[strip[kept]] * COORDINATES + place, rank[kept], dart[kept]
                np.minimum.at(best, cell, rank)
                least = best[cell] == rank
                sign[cell[least]] = dart[least]
        todo &= ~np.isfinite(best.reshape(owners, COORDINATES)).all(1)
        reach = reach * 4
    return sign.reshape(owners, COORDINATES)


def text_signatures(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """Signatures of whole texts, zeros where a text has no word; and how many shingles each has."""
    sets = [weighted(t) for t in texts]
    owner, totals = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets]), [int(s[1].sum()) for s in sets]
    if not len(owner):
        return np.zeros((len(sets), COORDINATES), np.uint64), totals
    return signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), owner, len(sets)), totals


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    keys = np.zeros((len(sign), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        keys = mix(keys * _GOLD + sign[:, row::ROWS])
    return keys


#: Pairs of different components are verified from this agreement on. At the threshold fewer than 53 of 96 coordinates
#: agree with probability 1e-8, while no band agrees with 3e-6.
PLAUSIBLE = 0.55
#: Pairs that agree so far are verified first, and only as many as may connect a bucket.
LIKELY = 0.75
#: A bucket is compared in pairs of blocks of about so many texts and so many shingles at most, or one text.
BLOCK, BLOCK_SHINGLES = 1024, 350_000
#: Cells of a block's table of agreements that are counted at a time.
TABLE = 1 << 24


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, hash, bands, sign, total`` of each row, ``total`` shingles; no bands where a text has no word."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                own = batch.slice(at, 128)
                found, totals = text_signatures(own.column("text").to_pylist())
                some = found.any(1)
                bands, short = band_keys(found).view(np.int64), found.astype(np.uint16).view(np.int16)
                yield pa.record_batch(
                    [own.column("id"), own.column("hash"),
                     pa.array([b if s else None for b, s in zip(bands, some)], pa.list_(pa.int64())),
                     pa.array([b if s else None for b, s in zip(short, some)], pa.list_(pa.int16())), pa.array(totals, pa.int64())],
                    names=["id", "hash", "bands", "sign", "total"])

    ready = docs.select(F.col(key).cast("long").alias("id"), text_hash(F.col(text)).alias("hash"), F.col(text).alias("text"))
    return ready.mapInArrow(sign, "id long, hash binary, bands array<long>, sign array<short>, total long")


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (a, b): the least node that it is connected to.

    Each round gives a node the least label among its neighbours, then follows labels of labels,
    so rounds grow with the logarithm of a component's diameter. All aggregates are partial
    minimums; a node with many neighbours and a label of many nodes are dealt to several tasks.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    hubs = hot_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        of = labels.withColumnRenamed("node", "b")
        seen = both.join(F.broadcast(of), "b") if is_small(labels) else join_dealt(both, of, "b", hubs, F.col("a"))
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        # Only labels that aren't their own lead further.
        moved = step.filter("label != node").select(F.col("node").alias("label"), F.col("label").alias("far"))
        leads = materialize(moved.join(step.select("label").distinct(), "label"), "leads")
        after = materialize(join_skewed(step, leads, "label", F.col("node"), "left")
                            .select("node", "old", F.coalesce("far", "label").alias("label")), "labels")
        done = after.filter("label != old").isEmpty()
        release(labels, step, leads)
        labels = after.select("node", "label")
        labels._shared_path = after._shared_path
        if done:
            release(both)
            return labels


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs of a materialised table whose texts reach the threshold exactly.

    The text of each b comes once to every task that has pairs of it, before those of its a's.
    """
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = np.full(len(a), -1.0)
            for i, (x, y, text) in enumerate(zip(a, b, batch.column("text"))):
                if x is None:
                    last = (y, weighted(text.as_py()))
                elif last[0] == y:
                    found[i] = similarity(weighted(text.as_py()), last[1])
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])
            yield out.filter(pa.array((found >= threshold) & (found >= 0)))

    hot = hot_keys(pairs, "b")
    deals = F.lit(1) if hot is None else F.coalesce("deals", F.lit(1))
    dealt = pairs.select("a", "b") if hot is None else pairs.select("a", "b").join(F.broadcast(hot), "b", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a"), deals).cast("int").alias("deal"))
    members = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("a", "b", "deal", "text")
    heads = (dealt.select("b", "deal").distinct().join(texts.withColumnRenamed("node", "b"), "b")
             .select(F.lit(None).cast("long").alias("a"), "b", "deal", "text"))
    rows = members.unionByName(heads).repartition("b", "deal").sortWithinPartitions("b", "deal", F.col("a").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(verify, "a long, b long, similarity double")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal integer keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in keys])
        edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [batch.num_rows]))
        for begin, end in zip(edges[:-1], edges[1:]):
            own = tuple(key[:, begin])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = own
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """Members of one bucket's pair of blocks, as arrays; a table of them holds at most about two blocks."""

    def __init__(self, group: pa.Table, threshold: float) -> None:
        matrix = lambda c: group.column(c).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        self.node, self.label, self.block, self.total = (group.column(c).to_numpy() for c in ("node", "label", "block", "total"))
        self.sign, self.bands, self.band = matrix("sign"), matrix("bands"), group.column("band")[0].as_py()
        self.one, self.threshold = group.column("low")[0] == group.column("high")[0], threshold

    def pairs(self, least: float, once: bool = True) -> np.ndarray:
        """Places of differently labelled members that agree on enough coordinates, most alike first.

        With ``once``, each pair counts in the first band it shares alone. No pair of sizes further apart than the
        threshold can reach it.
        """
        node, label, total = self.node, self.label, self.total
        found, agreed, n = [], [], max(1, TABLE // (len(node) * COORDINATES))
        for at in range(0, len(node), n):
            own = slice(at, at + n)
            agree = (self.sign[own, None, :] == self.sign[None]).sum(2, dtype=np.int16)
            good = (agree >= least * COORDINATES) & (label[own, None] != label[None]) & (node[own, None] < node[None])
            good &= np.minimum(total[own, None], total[None]) >= self.threshold * np.maximum(total[own, None], total[None])
            if not self.one:
                good &= self.block[own, None] != self.block[None]
            i, j = np.nonzero(good)
            if once:
                first = (self.bands[i + at] == self.bands[j]).argmax(1) == self.band
                i, j = i[first], j[first]
            found.append(np.stack([i + at, j], 1))
            agreed.append(agree[i, j])
        return np.concatenate(found)[np.argsort(-np.concatenate(agreed), kind="stable")]

    def connect(self, pairs: np.ndarray, test: Callable[[int, int], bool]) -> np.ndarray:
        """Pairs of nodes that pass the test and join labels that no pair before has joined: fewer than there are members."""
        root: dict = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        kept = []
        for i, j in pairs.tolist():
            x, y = find(self.label[i]), find(self.label[j])
            if x != y and test(i, j):
                root[max(x, y)] = min(x, y)
                kept.append((self.node[i], self.node[j]))
        return np.array(kept, np.int64).reshape(-1, 2)


KEYS = ["bucket", "low", "high"]


def _by_block(rows: DataFrame, columns: list[str], answer: Callable[[pa.Table], np.ndarray], names: list[str]) -> DataFrame:
    """``answer`` of each pair of blocks: rows of longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, KEYS):
            found = answer(group)
            yield pa.record_batch([pa.array(found[:, k], pa.int64()) for k in range(len(names))], names=names)

    rows = rows.select(*KEYS, "band", "node", "label", "block", "total", "sign", "bands", *columns)
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _blocks(members: DataFrame, labels: DataFrame, full: DataFrame, paired: bool) -> DataFrame:
    """Members of the buckets that hold several components, with their signatures: once, in their own block, or once for each pair of blocks.

    Blocks are dealt anew in each band, so texts that share several bands meet in one block or other.
    """
    labelled = (members.filter("n > 2").select("bucket", "band", "node", "n", "shingles").join(labels, "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
    mixed = (labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"))
             .filter("least < most").select("bucket"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = (labelled.join(mixed, "bucket").withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if paired else F.col("block")
    return (rows.withColumn("other", other)
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .join(full.select("node", "sign", "bands", "total"), "node"))


def _bridges(members: DataFrame, labels: DataFrame, full: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect more: of each block, the likeliest pairs that would connect its labels."""
    def likely(group: pa.Table) -> np.ndarray:
        block = Block(group, threshold)
        return block.connect(block.pairs(LIKELY, once=False), lambda i, j: True)

    with arrow_batches(texts.sparkSession, 4096):
        pairs = materialize(_by_block(_blocks(members, labels, full, paired=False), [], likely, ["a", "b"]).distinct(), "pairs")
    with arrow_batches(texts.sparkSession):
        found = materialize(_verified(pairs, texts, threshold).select("a", "b"), "edges")
    release(pairs)
    return found


def _crossings(members: DataFrame, labels: DataFrame, full: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect more, after every plausible pair across components is verified unless others connect it.

    Signatures tell which members have such a pair; only their texts are brought together.
    """
    def concerned(group: pa.Table) -> np.ndarray:
        block = Block(group, threshold)
        rows = block.node[np.unique(block.pairs(PLAUSIBLE))]
        return np.stack([*(np.full(len(rows), group.column(c)[0].as_py()) for c in KEYS), rows], 1)

    def verified(group: pa.Table) -> np.ndarray:
        block, texts, sets = Block(group, threshold), group.column("text"), {}

        def of(i: int):
            if i not in sets:
                sets[i] = weighted(texts[i].as_py())
            return sets[i]

        return block.connect(block.pairs(PLAUSIBLE), lambda i, j: similarity(of(i), of(j)) >= threshold)

    rows = materialize(_blocks(members, labels, full, paired=True), "blocks")
    with arrow_batches(texts.sparkSession, 4096):
        some = materialize(_by_block(rows, [], concerned, [*KEYS, "node"]), "concerned")
    wanted = rows.join(some.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in some.columns]), [*KEYS, "node"], "left_semi")
    with arrow_batches(texts.sparkSession):
        found = materialize(_by_block(wanted.join(texts, "node"), ["text"], verified, ["a", "b"]), "edges")
    release(rows, some)
    return found


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, hash`` and classes of several rows: ``hash, class_id, class_rows, similarity, label, first`` of their texts.

    ``similarity`` is that to the class's representative, the text of its least key.

    Steps: signatures of all whole texts; one node per different text; nodes that share a band
    meet in buckets. Each bucket's members are compared with its least node, every pair exactly,
    and verified links joined to components. Buckets of three or more that still hold several
    components are then compared across components by signature: first the most alike pairs
    inside each block of a bucket that could connect it, then, of what still isn't connected, all
    plausible ones, in pairs of blocks that no bucket can overfill, each in the first band it
    shares. Both are verified exactly. No bucket is expanded into pairs: what leaves a pair of blocks is
    at most one row for each of its members.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        signed = materialize(_signed(docs, key, text), "signatures")
    rows = signed.select("id", "hash")
    # Equal texts have equal signatures; the copies of a text are merged before they are shuffled.
    full = materialize(signed.filter("hash is not null").groupBy("hash")
                       .agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("bands", "sign", "total")], F.count(F.lit(1)).alias("copies"))
                       .withColumn("node", F.monotonically_increasing_id()), "distinct")
    banded = full.filter("bands is not null").select("node", "total", F.posexplode("bands").alias("band", "bucket"))
    shared = (banded.groupBy("bucket").agg(F.min(F.struct("node", "total")).alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("shingles"))
              .filter("hub.node < top").drop("top"))
    members = materialize(banded.join(shared, "bucket").select("bucket", "band", "node", "total", "hub", "n", "shingles"), "members")
    wanted = materialize(full.select("node", "hash", F.struct("first").alias("first")).join(members.select("node").distinct(), "node"), "met")
    source = docs.select(F.struct(F.col(key).cast("long").alias("first")).alias("first"), text_hash(F.col(text)).alias("hash"), F.col(text).alias("text"))
    # Rows that repeat key and text give one node more than one text, all equal.
    texts = materialize(join_small(source, wanted, ["hash", "first"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    able = F.least("total", "hub.total") >= threshold * F.greatest("total", "hub.total")  # no pair of sizes further apart reaches it
    pairs = materialize(members.filter("node != hub.node").filter(able).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "pairs")
    with arrow_batches(spark):
        edges = materialize(_verified(pairs, texts, threshold).select("a", "b"), "edges")
    labels, links = components(edges), [edges]
    for step in (_bridges, _crossings):
        more = step(members, labels, full, texts, threshold)
        if not more.isEmpty():
            release(labels)
            links.append(more)
            labels = components(reduce(DataFrame.unionByName, links))
    nodes = full.select("node", "hash", "first", "copies")
    placed = materialize(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("hash"))
    least = materialize(placed.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_rows"), F.min_by("node", order).alias("head"))
                        .filter("class_rows > 1"), "classes")
    found = materialize(join_skewed(placed, least, "label", F.col("node")), "found")
    others = materialize(found.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), "pairs")
    with arrow_batches(spark):
        alike = materialize(_verified(others, texts, 0.0).select(F.col("a").alias("node"), "similarity"), "alike")
    scored = materialize(found.join(alike, "node", "left").select(
        "hash", "class_id", "class_rows", F.coalesce("similarity", F.lit(1.0)).alias("similarity"), "label", "first"), "scored")
    release(pairs, members, wanted, texts, *links, full, labels, placed, least, found, others, alike)
    return rows, scored


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``key, class_id, class_rows, similarity``, one row per row of ``docs``: the least key of its class, how many rows the
    class has, and the similarity to the text of that key (1 for equal texts; less than the threshold where a chain links them).

    Equal texts share a class, and so do texts linked by a chain of weighted five-word-shingle
    similarities of the threshold or more. A text shorter than five words is one shingle; one
    without words only matches equal texts; a null text is a class of its own (``class_id`` is
    its own key). Null keys take their class's least key, null if it has none. Keys are
    integers; texts that share a key still have classes of their own. Other columns are ignored.
    """
    rows, found = classes(docs, key=key, text=text, threshold=threshold)
    found = found.select("hash", "class_id", "class_rows", "similarity", F.lit(True).alias("known"))
    alone = rows.filter("hash is null").select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.lit(1.0).alias("similarity"))
    whole = materialize(rows.filter("hash is not null"), "rows")
    return (join_skewed(whole, found, "hash", F.col("id"), "left")
            .select(F.col("id").alias(key), F.when(F.col("known"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
                    F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
            .unionByName(alone))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the least key; all columns are kept. Null texts stay.

    Of rows that repeat both key and text, the first by the other columns stays.
    """
    rows, found = classes(docs, key=key, text=text, threshold=threshold)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "hash")).alias("best"))
    keep = best.select(F.col("best.hash").alias("hash"), F.struct(F.col("best.first").alias("id")).alias("id"), F.lit(1).alias("kept"))
    # Only rows of classes of several rows can go.
    copies = join_small(rows.filter("hash is not null"), found.select("hash"), ["hash"], "left_semi")
    counted = copies.withColumn("id", F.struct("id")).groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"))
    fate = materialize(counted.join(keep, ["hash", "id"], "left").filter("kept is null or n > 1"), "fate")
    marked = docs.withColumns({"__hash": text_hash(F.col(text)), "__id": F.struct(F.col(key).cast("long").alias("id"))})
    lose = fate.select(F.col("hash").alias("__hash"), F.col("id").alias("__id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = join_small(marked, materialize(lose, "lost"), ["__hash", "__id"], "left_anti").select(*columns)
    again = materialize(fate.filter("kept = 1").select(F.col("hash").alias("__hash"), F.col("id").alias("__id")), "again")
    if again.isEmpty():
        return out
    rank = Window.partitionBy("__hash", "__id").orderBy(*sortable(docs))
    repeated = join_small(marked, again, ["__hash", "__id"]).withColumn("__n", F.row_number().over(rank))
    return out.unionByName(repeated.filter("__n = 1").select(*columns))
