"""Near-duplicate documents: fast similarity sketches, banding, exact confirmation.

Sketch: in round i every shingle of a text is thrown into one of the bins by its i-th
hash; an empty bin keeps the least value of the first round that reaches it. After as many rounds as bins the
shingles go into bin 0, 1, ... in turn, so every coordinate is filled. Two sketches agree in a
coordinate with the probability of the Jaccard similarity, and the number of agreements is
concentrated as for independent ones.

Texts with equal shingle sets form a class; everything below is about classes, so exact
copies cost one row each. Classes that share a band of `ROWS` coordinates are candidates. In a bucket each class
meets one centre, not all others; confirmed links give components. In buckets that still
hold several components, classes go that cannot be similar enough to any other, because too few of
their shingles occur in another open class. Then each class meets a centre of another
component, chosen anew in each round. What `ROUNDS` leave open is compared in full: a bucket's classes are dealt to blocks, each
two blocks meet in a task, which counts the common shingles of all their classes by a product of matrices and gives
as many links as join components there. So the comparisons of such a bucket grow with the square of its open classes, the rows
with these times the blocks, and no row is made for a pair that is no link.
A link inside a component changes nothing, so none that matters is lost. Links are
confirmed on the full shingle sets (64-bit hashes of shingles); a class that many others meet is
copied to several tasks.

There are as many bands of 5 rows as it takes for a pair at the least similarity to share none with
probability below `MISSED` (24 at 0.85, 35 at 0.80), and a text is linked through any one of its neighbours.

Rows: null or empty text and text without words has no shingles, is linked with nothing and is
its own component; fewer than five words are one shingle; repeated rows and keys are
members like others (a key that two rows share names both); a null key counts as largest;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.llm import rolling
from careweft.session import cut_lineage

SHINGLE = 5
BINS, ROWS = 120, 5
MISSED = 1e-6
ROUNDS = 3
MEMBERS_PER_TASK = 500
SHINGLES_PER_CHUNK = 1 << 20
CLASSES_PER_BLOCK, SHINGLES_PER_BLOCK = 512, 1 << 20
COLUMNS, ENTRIES = 1024, 1 << 22


def normal(text: str) -> bytes:
    """A-Z in lower case, words joined by one space."""
    return b" ".join(text.encode().lower().split())


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a normal text."""
    if not text:
        return np.zeros(0, "u8")
    data = np.frombuffer(text, "u1")
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    n = max(1, len(starts) - SHINGLE + 1)
    return np.unique(rolling.spans(rolling.prefix(data), starts[:n], ends[-n:]))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value per bin: round in the upper half, hash in the lower."""
    out = np.full(bins, np.iinfo("u8").max, "u8")
    at, step = 0, max(1, -(-5 * bins // len(items)))
    while at < bins and (out == np.iinfo("u8").max).any():
        rounds = np.arange(at, min(bins, at + step), dtype="u8")[:, None]
        h = rolling.mix(items + rounds * np.uint64(0xD1B54A32D192ED03))
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, place.ravel().astype("i8"), value.ravel())
        at += step
    for place in np.flatnonzero(out == np.iinfo("u8").max).tolist():
        h = rolling.mix(items + np.uint64((bins + place) * 0xD1B54A32D192ED03 % (1 << 64)))
        out[place] = (np.uint64(bins + place) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return out


def bands_needed(per_cent: int) -> int:
    alike = (per_cent / 100) ** ROWS
    return 1 if alike >= 1 else math.ceil(math.log(MISSED) / math.log1p(-alike))


def bands(values: np.ndarray) -> list[int]:
    rows = values.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype="u8") * np.uint64(0x9FB21C651E98DF25)
    for j in range(ROWS):
        h = rolling.mix(h * np.uint64(0x2545F4914F6CDD1D) + rows[:, j])
    return h.view("i8").tolist()


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def features(docs: DataFrame, n_bands: int) -> DataFrame:
    """Per document: `doc_id`, `row` (tells documents of different key or text apart),
    `n_shingles`, `class` (digest of its set), `bands`, `packed` (its normal text, compressed). The
    last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys, owners = batch.column("doc_id"), batch.column("row")
            for at in range(0, len(keys), 256):
                rows = []
                for text in batch.column("text").slice(at, 256):
                    plain = normal(text.as_py() or "")
                    items = shingles(plain)
                    if len(items):
                        rows.append((len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), bands(sketch(items, n_bands * ROWS)), squeeze(plain)))
                    else:
                        rows.append((0, None, None, None))
                columns = zip(*rows, strict=True)
                types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, 256), owners.slice(at, 256), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "row", "n_shingles", "class", "bands", "packed"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, class binary, bands array<long>, packed binary")


def confirmed(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """The rows (class, centre) of `pairs` whose sets have 100 * intersection >= `per_cent` *
    union. The text of each class goes once per pair, that of a centre once
    per `MEMBERS_PER_TASK` members; members stream past it."""
    fans = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("long").alias("salts"))
    texts = classes.select("class", "packed")
    salted = pairs.join(fans, "centre").withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")))
    members = salted.select("class", "centre", "salt", F.lit(1).alias("place"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    centres = fans.select(F.col("centre").alias("class"), "centre", every, F.lit(0).alias("place"))
    wanted = members.unionByName(centres).join(texts, "class")
    dealt = wanted.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, now, kept = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            found, centres = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("class", "centre", "salt", "place", "packed")], strict=True)
            for name, centre, salt, place, packed in rows:
                items = shingles(expand(packed))
                if place == 0:
                    now, kept = (centre, salt), items
                    continue
                if now != (centre, salt):
                    raise ValueError("a centre is missing")
                small, large = sorted((items, kept), key=len)
                if 100 * len(small) >= per_cent * len(large):
                    spot = np.searchsorted(large, small)
                    common = int((large[np.minimum(spot, len(large) - 1)] == small).sum())
                    if 100 * common >= per_cent * (len(small) + len(large) - common):
                        found.append(name)
                        centres.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(centres, pa.binary())], names=["class", "centre"])

    return dealt.mapInArrow(run, "class binary, centre binary")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each component of `links` (a, b). Alternates
    large and small stars: each node hangs its neighbours on the least of them, until nothing changes."""
    edges, before = cut_lineage(links.select("a", "b").filter("a <> b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.filter("a <> b").distinct())
        after = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    joined = rows.join(found.withColumnRenamed("node", "class"), "class", "left")
    return joined.withColumn("component", F.coalesce("component", "class"))


def _heads(members: DataFrame, order: Column) -> DataFrame:
    """Per bucket that holds several components: the class first in `order`, with its component."""
    pick = F.min(F.struct(order.alias("o"), F.col("class").alias("class"), F.col("component").alias("component"))).alias("head")
    several = F.min("component") != F.max("component")
    heads = members.groupBy("band").agg(pick, several.alias("several")).filter("several")
    return heads.select("band", F.col("head.class").alias("centre"), F.col("head.component").alias("own"))


def _counted(texts: DataFrame) -> DataFrame:
    """Rows (shingle, name, shared): each `SHINGLES_PER_CHUNK` of a task are counted where they are.
    A shingle gives one row a chunk, however many classes have it: of `shared` -1 with its class if one has
    it, 0 if several have."""

    def chunk(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        same = h[1:] == h[:-1]
        first, again = np.concatenate([[True], ~same]), np.concatenate([same, [False]])
        columns = [h[first], n[first], np.where(again[first], 0, -1)]
        for at in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["shingle", "name", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, held, owners, size = zstandard.ZstdDecompressor().decompress, [], [], 0
        for batch in batches:
            for name, packed in zip(batch.column("name").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                held.append(shingles(expand(packed)).view("i8"))
                owners.append(np.full(len(held[-1]), name))
                size += len(held[-1])
                if size >= SHINGLES_PER_CHUNK:
                    yield from chunk(np.concatenate(held), np.concatenate(owners))
                    held, owners, size = [], [], 0
        if size:
            yield from chunk(np.concatenate(held), np.concatenate(owners))

    return texts.select(F.xxhash64("class").alias("name"), "packed").mapInArrow(run, "shingle long, name long, shared long")


def _lone(texts: DataFrame) -> DataFrame:
    """Rows (name, own): shingles that one class alone has, counted by class and batch. Shingles pass their task in
    order, a row per chunk they were counted in; each gives at most one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last shingle so far waits with its class, `alone` as long as one class has it.
        last, name, alone = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, shared = (batch.column(c).to_numpy() for c in ("shingle", "name", "shared"))
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            single = (np.diff(np.append(starts, len(h))) == 1) & (shared[starts] < 0)
            if h[0] == last:
                single[0] = False
            elif alone:
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([1], pa.int64())], names=["name", "own"])
            last, name, alone = h[-1], n[-1], bool(single[-1])
            names, counts = np.unique(n[starts[:-1]][single[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["name", "own"])
        if alone:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([1], pa.int64())], names=["name", "own"])

    return _counted(texts).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(count, "name long, own long")


def shared_sizes(texts: DataFrame) -> DataFrame:
    """(class, size, shared): how many shingles a class has, and how many of them any other
    class of `texts` has too: all but those that only it has."""
    sums = _lone(texts).groupBy("name").agg(F.sum("own").alias("own"))
    sized = texts.select("class", "size", F.xxhash64("class").alias("name")).join(sums, "name", "left")
    return sized.select("class", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each set of `left` has in common with each of `right`."""
    out = np.zeros(len(left) * len(right), "i8")
    a, b = np.concatenate(left), np.concatenate(right)
    items = np.intersect1d(a, b)
    if not len(items):
        return out.reshape(len(left), -1)

    def entries(all_: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Column and row of each item on both sides, by column."""
        owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        spot = np.minimum(np.searchsorted(items, all_), len(items) - 1)
        here = items[spot] == all_
        spot, owners = spot[here], owners[here]
        order = np.argsort(spot, kind="stable")
        return spot[order], owners[order]

    (col_a, row_a), (col_b, row_b) = entries(a, left), entries(b, right)
    edges = np.arange(len(items) + 1)
    at_a, at_b = np.searchsorted(col_a, edges), np.searchsorted(col_b, edges)
    n_b = np.diff(at_b)
    # Items of many sets by products of matrices, the others entry by entry.
    dense = np.diff(at_a) * n_b > len(left) * len(right) // 64
    columns = np.flatnonzero(dense)
    for at in range(0, len(columns), COLUMNS):
        some = columns[at : at + COLUMNS]
        place = np.full(len(items), -1)
        place[some] = np.arange(len(some))
        x, y = np.zeros((len(left), len(some)), "f4"), np.zeros((len(right), len(some)), "f4")
        for matrix, cols, rows in ((x, col_a, row_a), (y, col_b, row_b)):
            here = place[cols] >= 0
            matrix[rows[here], place[cols[here]]] = 1
        out += np.rint(x @ y.T).astype("i8").ravel()
    kept = ~dense[col_a]
    cols, rows = col_a[kept], row_a[kept]
    ends = np.cumsum(n_b[cols])
    at = 0
    while at < len(cols):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
        times = n_b[cols[at:stop]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        others = row_b[np.repeat(at_b[cols[at:stop]], times) + within]
        out += np.bincount(np.repeat(rows[at:stop], times) * len(right) + others, minlength=len(out))
        at = stop
    return out.reshape(len(left), -1)


def _joining(left: list[tuple], right: list[tuple], per_cent: int) -> list[tuple]:
    """Links between rows (component, class, packed) of `left` and `right`: as many as join components."""
    if len({x[0] for x in left} | {x[0] for x in right}) < 2:
        return []
    expand = zstandard.ZstdDecompressor().decompress
    sets = [shingles(expand(x[2])) for x in left]
    others = sets if right is left else [shingles(expand(x[2])) for x in right]
    common = _common(sets, others)
    sizes = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in others])
    number = {c: i for i, c in enumerate(sorted({x[0] for x in left} | {x[0] for x in right}))}
    a, b = np.array([number[x[0]] for x in left]), np.array([number[x[0]] for x in right])
    i, j = np.nonzero((100 * common >= per_cent * (sizes - common)) & (a[:, None] != b))
    _, first = np.unique(a[i] * len(number) + b[j], return_index=True)
    parent, found = list(range(len(number))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
        one, other = root(int(a[x])), root(int(b[y]))
        if one != other:
            parent[one] = other
            found.append((left[x][1], right[y][1]))
    return found


def met(members: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Links (class, centre) between the rows (class, band, component) of `members` that share a band and
    differ in component: enough of them to join all components that such links join. All are compared."""
    rows = members.select("class", "band", "component").join(classes.select("class", "size", "packed"), "class")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CLASSES_PER_BLOCK, F.sum("size") / SHINGLES_PER_BLOCK)).cast("long")
    sized = members.select("class", "band").join(classes.select("class", "size"), "class").groupBy("band").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("class", "band"), F.col("blocks")).alias("block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = rows.join(sized, "band").select("band", "class", "component", "packed", own, every)
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    dealt = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, [], []

        def links() -> pa.RecordBatch:
            found = _joining(left, left if now[1] == now[2] else right, per_cent) if left and (right or now[1] == now[2]) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["class", "centre"])

        for batch in batches:
            for band, low, high, block, *row in zip(*[batch.column(c).to_pylist() for c in ("band", "low", "high", "block", "component", "class", "packed")], strict=True):
                if now != (band, low, high):
                    if now:
                        yield links()
                    now, left, right = (band, low, high), [], []
                (left if block == low else right).append(row)
        if now:
            yield links()

    return dealt.mapInArrow(run, "class binary, centre binary")


def _possible(shared: Column, size: Column, other: Column, per_cent: int) -> Column:
    """Whether a set can be similar enough to one of size `other`, if it has no more than `shared` in
    common with any."""
    return 100 * shared >= per_cent * (size + F.greatest(other, shared) - shared)


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """One text for each class in `needed`: copies hold the same words. The row is
    chosen by key first, so copies of a large class do not meet in one task."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")
    chosen = rows.filter("class is not null").select("class", key).groupBy("class").agg(F.min("key").alias("key"))
    chosen = chosen.join(needed.select("class").distinct(), "class", "left_semi")
    found = rows.select("class", key, F.col("n_shingles").alias("size"), "packed").join(chosen, ["class", "key"])
    return found.dropDuplicates(["class", "key"]).select("class", "size", "packed")


def near_groups(docs: DataFrame, per_cent: int) -> DataFrame:
    """Per document `doc_id`, `row`, `n_shingles`, `component_id`, and `chosen`: the row of its
    component that stays, null for documents without shingles."""
    rows = cut_lineage(features(docs, bands_needed(per_cent)))
    classes = rows.filter("class is not null").groupBy("class").agg(F.first("bands").alias("bands"))
    banded = cut_lineage(classes.select("class", F.explode("bands").alias("band")))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("centre")).filter("n > 1").drop("n")
    shared = cut_lineage(banded.join(sizes, "band"))
    texts = cut_lineage(_texts(rows, shared))
    tried = cut_lineage(shared.filter("class <> centre").select("class", "centre").distinct())
    linked = [cut_lineage(confirmed(tried, texts, per_cent))]

    def joined() -> DataFrame:
        return components(reduce(DataFrame.unionByName, linked).select(F.col("class").alias("a"), F.col("centre").alias("b")))

    def untried(pairs: DataFrame) -> DataFrame:
        ordered = [F.least("class", "centre").alias("class"), F.greatest("class", "centre").alias("centre")]
        past = tried.select(*ordered)
        return cut_lineage(pairs.select(*ordered).distinct().join(past, ["class", "centre"], "left_anti"))

    found, bounds = joined(), None
    shared = shared.select("class", "band")
    for turn in range(ROUNDS + 1):
        members = _with_component(shared, found)
        # The class with the fewest shingles of its own is the likeliest link to the others.
        order = F.xxhash64("class", F.lit(turn)) if bounds is None or turn % 2 else F.struct(F.col("size") - F.col("shared"), F.xxhash64("class", F.lit(turn)))
        heads = _heads(members, order)
        # Only buckets that still hold several components are looked at again.
        open_ = cut_lineage(members.join(heads, "band"))
        if open_.isEmpty():
            break
        if bounds is None:
            # Shingles that no other open class has are in no intersection: most classes that are
            # near a group but linked with nothing in it fall out here, without a pair.
            bounds = cut_lineage(shared_sizes(texts.join(open_.select("class").distinct(), "class", "left_semi")))
            sized = open_.select("class", "band").join(bounds, "class")
            least = sized.groupBy("band").agg(F.min("size").alias("least"))
            other = F.greatest("least", F.floor((F.col("size") * per_cent + 99) / 100))
            sized = sized.join(least, "band").filter(_possible(F.col("shared"), F.col("size"), other, per_cent))
            shared = cut_lineage(sized.select("class", "band", "size", "shared"))
            members = _with_component(shared, found)
            order = F.struct(F.col("size") - F.col("shared"), F.xxhash64("class"))
            open_ = cut_lineage(members.join(_heads(members, order), "band"))
            if open_.isEmpty():
                break
        shared = open_.select("class", "band", "size", "shared")
        if turn == ROUNDS:
            linked.append(cut_lineage(met(open_, texts, per_cent)))
            found = joined()
            break
        fresh = untried(open_.filter("component <> own").select("class", "centre"))
        if not fresh.isEmpty():
            tried = cut_lineage(tried.unionByName(fresh))
            linked.append(cut_lineage(confirmed(fresh, texts, per_cent)))
            if not linked[-1].isEmpty():
                found = joined()

    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct(key, "row")).alias("first"))
    labelled = _with_component(least.filter("class is not null"), found)
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first")["row"].alias("chosen"))
    ids = labelled.join(smallest, "component").select("class", "component_id", "chosen")
    out = rows.select("doc_id", "row", "n_shingles", "class").join(ids, "class", "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "chosen")


def near_duplicates(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (the least key of the component), `kept`."""
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    return near_groups(docs, per_cent).select("doc_id", "n_shingles", "component_id", kept)


def keep_one(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """The documents, all columns, one of each component: that with the least key, of equal
    keys with the least row. Rows equal in key and text are one document."""
    staying = near_groups(docs, per_cent).filter("chosen is null or chosen = row").select(F.col("row").alias("_row")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _row().alias("_row"))
    return whole.join(staying, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")
