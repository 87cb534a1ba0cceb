"""MinHash near-duplicates with tensored banding, exact verification and connected components.

Two small collections of keys, each key a pair of minhashes, are made for a document; every pair of a key of the one and a
key of the other collection is a table key. So `COLLECTION`² tables need only 4·`COLLECTION` minhashes.

Equal shingle sets count as one. Rows with one table key lie together in a range-partitioned, sorted stream; a key that
many rows hold is spread over many tasks. Each run ties its members to one member, by a random order for each key, so
large groups need a number of pairs in proportion to their size. Members of a run that these pairs don't tie together, as its
center is unlike them or as the run lies in several partitions, are compared by sizes and sketches, in blocks, so that every
pair with a common table key that can be similar enough is tied. Groups that are still apart after the first links are
confirmed and components are known are compared in full, in blocks of sets. Links are confirmed on full sets.

Defined results: null texts and texts without words have empty sets, n_shingles 0, and link with nothing; fewer words than a
shingle make one shingle; a null doc_id counts as smaller than all others; rows with equal texts share a component; an
empty table gives an empty result; extra columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shared import drop_tables, give_back, materialize, with_plain_names

#: Keys of each of the two collections, and minhashes of a key. At similarity 0.8 a collection has no common key for a
#: share of 0.36 ** 8 of the pairs, so 0.06 % of the pairs that are just similar enough share no table key.
COLLECTION = 8
PER_KEY = 2
#: Minhashes that keys don't use; two bits of each minhash make the sketch.
MORE = 32
#: Of 64 places of two sketches, 54.4 agree on average at similarity 0.8, with a deviation of 2.9.
SKETCH_AGREE = 41
NULL_ID = -(1 << 63)
#: Ids that go to all executors at most (8 bytes each); beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Partners, the likeliest first, that a document's first links are sought among; the rest are compared block by block.
FIRST_PARTNERS = 2
#: Sets of a block, and members of a block where only sizes and sketches are compared.
BLOCK = 256
SKETCH_BLOCK = 1024
#: Shingles of the sets of a block (8 bytes each), so that blocks of long documents hold fewer of them.
BLOCK_SHINGLES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_MINHASHES = 2 * COLLECTION * PER_KEY + MORE
_A = _RNG.integers(1, 1 << 63, _MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _MINHASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    size = min(shingle, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    """32-bit minhashes of a set that isn't empty."""
    best = np.full(_MINHASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(found), 4096):
        block = found[k : k + 4096]
        np.minimum(best, (_A[:, None] * block + _B[:, None]).min(axis=1), out=best)
    return best >> np.uint64(32)


def _sketches(shingle: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            n, s, keys, bits = [], [], [], []
            for x in batch.column(1):
                found = shingle_set(x.as_py(), shingle)
                n.append(len(found))
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                s.append((digest >> 64, digest & 0xFFFFFFFFFFFFFFFF))
                m = minhashes(found) if len(found) else np.zeros(_MINHASHES, np.uint64)
                pairs = m[: _MINHASHES - MORE].reshape(2 * COLLECTION, PER_KEY)
                key = np.zeros(2 * COLLECTION, np.uint64)
                for k in range(PER_KEY):
                    key = (key ^ pairs[:, k]) * _MIX
                    key ^= key >> np.uint64(31)
                keys.append(key.astype(np.int64))
                m = m[-64:]
                bits.append(((m & np.uint64(1)) @ weights, ((m >> np.uint64(1)) & np.uint64(1)) @ weights))
            s, bits, keys = np.array(s, np.uint64).reshape(-1, 2).astype(np.int64), np.array(bits, np.uint64).reshape(-1, 2).astype(np.int64), np.array(keys, np.int64).reshape(-1, 2 * COLLECTION)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), COLLECTION).cast(pa.list_(pa.int64())) for x in (keys[:, :COLLECTION], keys[:, COLLECTION:])]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (s[:, 0], s[:, 1], bits[:, 0], bits[:, 1])), *lists], ["doc_id", "n_shingles", "s1", "s2", "bits1", "bits2", "keys1", "keys2"])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, turn, id) to key, center, id: the members of runs of two or more; the first of a run is its center.

    The runs that open and close a partition may go on in others and always come out.
    """
    held: tuple | None = None  # the open run: key, center, and its first row while that is its only one
    opening = True
    names = ["key", "center", "id"]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, _, node = (c.to_numpy() for c in batch.columns)
        if held is not None and held[2]:  # its single row is looked at again
            key, node = np.r_[held[0], key], np.r_[held[1], node]
        carried = held is not None
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        center = node[first]
        if carried and not held[2] and key[0] == held[0]:
            center[first == 0] = held[1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(key)])
        out = np.repeat(sizes > 1, sizes)
        if carried and not held[2] and key[0] == held[0] or opening:
            out[: sizes[0]] = True
        opening = False
        single = sizes[-1] == 1 and not out[-1]
        held = (key[-1], center[-1], single)
        if out.any():
            yield pa.record_batch([pa.array(key[out]), pa.array(center[out]), pa.array(node[out])], names)
    if held is not None and held[2]:
        yield pa.record_batch([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([held[1]], pa.int64())], names)


def _likely(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow the similarity."""
    agree = 64 - F.bit_count(F.col(f"{a}.bits1").bitwiseXOR(F.col(f"{b}.bits1")).bitwiseOR(F.col(f"{a}.bits2").bitwiseXOR(F.col(f"{b}.bits2"))))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (agree >= SKETCH_AGREE)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id and shingles of the documents whose texts stand for the sets that take part in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                yield pa.record_batch([own.column(0), pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in own.column(1)], pa.binary())], ["id", "shingles"])

    ids = ids.select(F.col("id").alias("doc_id"))
    chosen = _identified(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "id long, shingles binary").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    made: list[str] = []  # tables that the result doesn't read
    rows = materialize(_identified(docs).mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, s1 long, s2 long, bits1 long, bits2 long, keys1 array<long>, keys2 array<long>"), "sketches")
    # a set's smallest doc_id stands for it; copies are combined before rows move
    of_set = F.first(F.struct("n_shingles", "bits1", "bits2", "keys1", "keys2")).alias("x")
    sets = rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), of_set)
    sets = materialize(sets.select("id", "s1", "s2", "x.*"), "sets", made)

    table_keys = F.flatten(F.transform("keys1", lambda u, i: F.transform("keys2", lambda v, j: F.xxhash64(u, v, i, j))))
    keyed = sets.select("id", F.explode(table_keys).alias("key"))
    turned = keyed.select("key", F.xxhash64("key", "id").alias("turn"), "id")
    members = materialize(turned.repartitionByRange("key", "turn").sortWithinPartitions("key", "turn", "id").mapInArrow(_runs, "key long, center long, id long"), "members", made)

    about = sets.select("id", "n_shingles", "bits1", "bits2")
    taking_part = materialize(members.groupBy("id").agg(F.lit(1).alias("one")).select("id").join(about, "id"), "about", made)
    stars = members.filter("center <> id").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    scored = _with_about(stars, taking_part).filter(_likely("x", "y", percent))
    agree = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1")).bitwiseOR(F.col("x.bits2").bitwiseXOR(F.col("y.bits2"))))
    scored = materialize(scored.select("a", "b", agree.alias("apart")), "stars", made)
    ties = materialize(_ties_in_runs(members, scored, taking_part, percent), "ties", made)
    scored = scored.unionByName(_with_about(ties, taking_part).select("a", "b", agree.alias("apart")))
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).filter(F.col("n") <= FIRST_PARTNERS).select("a", "b")
    full = materialize(_full_sets(docs, taking_part, shingle), "full", made)
    edges = materialize(_verified(first, full, percent), "edges1", made)
    labels = _labels(edges)

    # sets that are tied together but by no confirmed link yet: all pairs of a group's blocks, but those of one component
    tied = connected_components(scored.select("a", "b")).withColumnsRenamed({"node": "id", "root": "group"})
    every = tied.unionByName(tied.select(F.col("group").alias("id"), "group").distinct())
    grouped = every.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "group", F.coalesce("root", "id").alias("root"))
    several = grouped.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("group")
    apart = materialize(grouped.join(several, "group", "left_semi").join(taking_part, "id"), "apart", made)
    edges = edges.unionByName(materialize(_links_between_blocks(apart, full, percent, BLOCK), "edges2", made))

    roots = _labels(edges).withColumnRenamed("node", "id")
    classes = materialize(sets.select("id", "s1", "s2").join(roots, "id", "left").select("s1", "s2", F.coalesce("root", "id").alias("component_id")), "classes")
    drop_tables(docs.sparkSession, made)
    found = rows.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return found.select(real("doc_id"), "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _ties_in_runs(members: DataFrame, stars: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one run that sizes and sketches allow, until they and the stars tie all such pairs of all runs together."""
    tied = connected_components(stars.select("a", "b")).withColumnsRenamed({"node": "id", "root": "tied"})
    grouped = materialize(about.join(tied, "id", "left").select("id", F.coalesce("tied", "id").alias("root"), "n_shingles", "bits1", "bits2"), "tied")
    low_high = [f(c).alias(f"{f.__name__}_{c}") for c in ("root", "center") for f in (F.min, F.max)]
    same = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"same{k}") for k in (0, 1)]
    runs = members.join(grouped.select("id", "root"), "id").groupBy("key").agg(F.count("*").alias("n"), *low_high, *same)
    # where two members have one center, their star was all there is to compare; runs with the same members count once
    runs = runs.filter("min_root < max_root and (n > 2 or min_center < max_center)").groupBy("same0", "same1").agg(F.min("key").alias("key"))
    split = members.select("key", "id").join(runs.select("key"), "key", "left_semi").withColumnRenamed("key", "group")
    return _links_between_blocks(materialize(split.join(grouped, "id"), "split"), None, percent, SKETCH_BLOCK)


def _with_about(pairs: DataFrame, about: DataFrame) -> DataFrame:
    x, y = about.alias("x"), about.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))


def _labels(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def _block_links(x: list[dict], y: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between sets of two blocks (or one, given twice) that tie their components together, each tie once.

    Without shingles, sizes and sketches are all that a link needs.
    """
    same = x is y
    col = lambda rows, c, kind: np.array([r[c] for r in rows], kind)
    n, m = col(x, "n_shingles", np.int64)[:, None], col(y, "n_shingles", np.int64)[None, :]
    differ = (col(x, "bits1", np.int64)[:, None] ^ col(y, "bits1", np.int64)[None, :]) | (col(x, "bits2", np.int64)[:, None] ^ col(y, "bits2", np.int64)[None, :])
    likely = (64 - np.bitwise_count(differ.view(np.uint64)).astype(np.int64) >= SKETCH_AGREE) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    likely &= col(x, "root", np.int64)[:, None] != col(y, "root", np.int64)[None, :]
    if same:
        likely = np.triu(likely, 1)
    i, j = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
    if not len(i):
        return []
    sub = np.ix_(i, j)
    linked = likely[sub]
    if "shingles" in x[0]:
        common = _common([np.frombuffer(x[k]["shingles"], np.uint64) for k in i], [np.frombuffer(y[k]["shingles"], np.uint64) for k in j])
        linked &= 100 * common >= percent * ((n + m)[sub] - common)
    above: dict[int, int] = {}

    def top(k: int) -> int:
        while above.get(k, k) != k:
            above[k] = k = above.get(above[k], above[k])
        return k

    out = []
    for p, q in zip(*np.nonzero(linked)):
        one, other = x[i[p]], y[j[q]]
        r, t = top(one["root"]), top(other["root"])
        if r != t:
            above[r] = t
            out.append((one["id"], other["id"]))
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray], width: int = 16384) -> np.ndarray:
    """Sizes of all intersections: a product of 0/1 matrices over the shingles that occur twice, some columns at a time."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(v) for v in (*a, *b)])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = count > 1
    new = np.cumsum(twice) - 1
    keep = twice[number]
    row, number = row[keep], new[number[keep]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, int(twice.sum()), width):
        lo, hi = np.searchsorted(number, [low, low + width])
        block = np.zeros((len(a) + len(b), width), np.float32)
        block[row[lo:hi], number[lo:hi] - low] = 1
        out += (block[: len(a)] @ block[len(a) :].T).astype(np.int64)
    return out


def _links_between_blocks(apart: DataFrame, sets: DataFrame | None, percent: int, size: int) -> DataFrame:
    """Links between sets of one group (group, root, id, sizes, sketches) that have different roots.

    A group is dealt to blocks of about `size` sets and at most about `BLOCK_SHINGLES` shingles, those of a large component to
    blocks of their own; every pair of blocks that isn't of one component meets in one row, whose sets are multiplied there.
    So the rows are few and of bounded size, and no group is ever in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                x = batch.column(0)[k].as_py()
                y = batch.column(1)[k].as_py()
                out += _block_links(x, x if y is None else y, percent)
            give_back()
            yield pa.record_batch([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    small = F.lit(-(1 << 62))
    share = F.count("*") / size if sets is None else F.greatest(F.count("*") / size, F.sum("n_shingles") / BLOCK_SHINGLES)
    of_root = apart.groupBy("group", "root").agg(share.alias("load"))  # in blocks
    kinds = of_root.select("group", "root", F.when(F.col("load") >= 1, F.col("root")).otherwise(small).alias("kind"), "load")
    of_kind = kinds.groupBy("group", "kind").agg(F.ceil(F.sum("load")).alias("blocks"))
    placed = apart.join(kinds.drop("load"), ["group", "root"]).join(of_kind, ["group", "kind"]).withColumn("part", F.xxhash64("kind", F.pmod(F.xxhash64("id"), "blocks")))
    member = F.struct("id", "root", "n_shingles", "bits1", "bits2", *([] if sets is None else ["shingles"]))
    placed = placed if sets is None else placed.join(sets, "id")
    blocks = materialize(placed.groupBy("group", "kind", "part").agg(F.collect_list(member).alias("members")), "blocks")
    heads = blocks.select("group", "kind", "part")
    heads = heads.join(heads.groupBy("group").count().filter("count > 1"), "group", "left_semi")
    x, y = heads.alias("x"), heads.alias("y")
    pairs = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.part") < F.col("y.part")) & ((F.col("x.kind") != F.col("y.kind")) | (F.col("x.kind") == small)))
    pairs = materialize(pairs.select(F.col("x.group").alias("group"), F.col("x.part").alias("p"), F.col("y.part").alias("q")), "pairs")
    first = blocks.select("group", F.col("part").alias("p"), F.col("members").alias("xs"))
    second = blocks.select("group", F.col("part").alias("q"), F.col("members").alias("ys"))
    alone = blocks.filter(F.col("kind") == small).select(F.col("members").alias("xs"), F.lit(None).cast(dict(second.dtypes)["ys"]).alias("ys"))
    two = pairs.join(first, ["group", "p"]).join(second, ["group", "q"]).select("xs", "ys")
    return alone.unionByName(two).mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which each group keeps the one with the smallest doc_id."""
    gone = materialize(near_duplicates(docs.select("doc_id", "text"), shingle, percent).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    gone = gone.withColumnRenamed("doc_id", "_tm_gone")
    plain, names = with_plain_names(docs)
    return plain.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(names["doc_id"]).eqNullSafe(F.col("_tm_gone")), "left_anti").toDF(*docs.columns)
