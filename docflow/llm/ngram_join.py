"""N-gram Jaccard join by vertical partitioning: the global order of n-grams (by hash) is cut into fragments, overlaps are counted in
each fragment on their own and summed for each pair.

1. Every text becomes a set of n-gram hashes and a 128-bit fingerprint of the set. Texts of one set are one class, and one block of
   documents is its home. Blocks keep their sets in the shared folder, in buckets, so that what comes back to a block is joined to it
   without a shuffle of the sets.
2. A block sends the distinct n-grams of its home classes to the fragments, without owners: ascending, as compressed steps, with the
   number of classes that have them. A fragment adds these numbers up and sends them back. A frequent n-gram is one entry a block.
3. Back in its block, an n-gram of one class links nothing. A class that keeps too few n-grams has no partner. The others keep a
   prefix, the rarest n-grams first: two sets that are similar enough share an n-gram of both prefixes.
4. Stars: among the classes that share a prefix n-gram, the one with the fewest n-grams of its own is the centre. Each class is
   compared with the centre that it meets most often. This is one pair for each class, however large a group of near copies is.
   Then again with other centres: the classes with equal MinHash bands of their prefixes, where they are not connected yet.
5. The rest: pairs that share a prefix n-gram and are not connected yet. In each group only classes outside its largest component
   are paired, and only if the counts allow the similarity: what two sets share comes no earlier in either than their first common
   n-gram, so it is no more than what follows that. No pair that may be linked is dropped, so no link between components is lost.
6. Overlaps of the pairs are counted by fragment and summed; components are found by distributed label propagation.

n-grams are compared by 48 bits of their hash: two sets of 300 that differ seem to share one n-gram more with a chance of 3e-10.

Defined results: a null text is an empty one; texts without words have no set and are linked with nothing; repeated rows are copies
and each give a row; a component's id is the least doc_id that is not null; other columns are ignored (`one_of_each` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.hashing import Cache, mix, pack, released, releasing, shingles, unpack
from docflow.session import bucket_count, materialize, materialize_buckets, scratch, ship

#: Entries of n-grams in one fragment, about.
FRAGMENT_GRAMS = 2_000_000
#: Occurrences in one block of documents (more only where one text has more).
BLOCK_GRAMS = 1_000_000
#: Bits of a class's number in its block: each class has an n-gram at least.
IDX_BITS = 20
#: Bits of a hash that are sent and compared.
BITS = 48
#: Fragments in which the overlaps of pairs are counted.
PARTS = 8
#: doc_ids of dropped rows that are broadcast, at most (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: MinHash bands of a prefix, and hashes in each.
BANDS, BAND_ROWS = 8, 3


def word_hashes() -> Cache:
    return Cache(xxhash.xxh64_intdigest, 100_000)


def gram_set(text: str | None, k: int, of: Cache) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, A-Z lowered, between ASCII white space; of all words, if fewer."""
    words = (text or "").encode().lower().split()
    return np.unique(shingles(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), k))


def fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


HASHED_SCHEMA = "block long, idx int, doc_id long, n_shingles long, fp binary, sizes binary, grams binary"


def hashed(docs: DataFrame, k: int) -> DataFrame:
    """One row for each document (block, idx of its class there, doc_id, n_shingles, fp; idx and fp null for an empty set), and one for
    each block with its classes (sizes, grams). A class is known by block + idx."""

    def table(rows: dict[str, list], n: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
        names = ("block", "idx", "doc_id", "n_shingles", "fp", "sizes", "grams")
        return pa.record_batch([pa.array(rows.get(c, [None] * n), t) for c, t in zip(names, kinds, strict=True)], list(names))

    def whole(block: int, sets: dict[bytes, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        grams = [g >> np.uint64(64 - BITS) for _, g in sets.values()]
        steps = np.concatenate([np.diff(g, prepend=np.uint64(0)) for g in grams])
        sizes = np.array([len(g) for g in grams], np.int64)
        return table({"block": [block], "sizes": [sizes.tobytes()], "grams": [pack(steps)]}, 1)

    def run(batches):
        from pyspark import TaskContext

        of, block = word_hashes(), TaskContext.get().partitionId() << 40
        sets, held = {}, 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = {"block": [], "idx": [], "doc_id": part.column(0).to_pylist(), "n_shingles": [], "fp": []}
                for text in part.column(1).to_pylist():
                    grams = gram_set(text, k, of)
                    rows["block"].append(block)
                    rows["n_shingles"].append(len(grams))
                    key = fingerprint(grams) if len(grams) else None
                    rows["fp"].append(key)
                    if key and key not in sets:
                        sets[key] = len(sets), grams
                        held += len(grams)
                    rows["idx"].append(sets[key][0] if key else None)
                    if held >= BLOCK_GRAMS:
                        yield whole(block, sets)
                        sets, held, block = {}, 0, block + (1 << IDX_BITS)
                yield table(rows, part.num_rows)
        if sets:
            yield whole(block, sets)

    return docs.select("doc_id", "text").mapInArrow(releasing(run), HASHED_SCHEMA)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def home_sets(block: pa.Table, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, sizes, grams one set after the other) of the classes idx of a block's row."""
    sizes = np.frombuffer(block.column("sizes")[0].as_py(), np.int64)
    total = np.cumsum(unpack(block.column("grams")[0].as_py(), int(sizes.sum())))  # steps in each set: subtract what came before it
    ends = np.cumsum(sizes)
    before = np.concatenate([[np.uint64(0)], total[ends[:-1] - 1]]).astype(np.uint64)
    grams = total - np.repeat(before, sizes)
    home = np.zeros(len(sizes), bool)
    home[idx] = True
    return np.flatnonzero(home), sizes[home], grams[np.repeat(home, sizes)]


def fragment_starts(grams: np.ndarray, n_fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragments of ascending n-grams and where each begins."""
    of = ((grams >> np.uint64(BITS - 32)) * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int64)
    starts, _ = _runs(of)
    return of[starts], starts


SENT_SCHEMA = "block long, fragment int, size int, steps binary, counts binary"


def sent_grams(blocks: DataFrame, homes: DataFrame, n_fragments: int) -> DataFrame:
    """The distinct n-grams of each block's home classes, ascending, and the number of these classes that have each, by fragment."""

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            _, _, grams = home_sets(left, right.column("idx").to_numpy())
            grams = np.sort(grams)
            starts, counts = _runs(grams)
            grams, counts = grams[starts], counts.astype(np.uint64)
            of, begin = fragment_starts(grams, n_fragments)
            for f, a, b in zip(of, begin, np.append(begin[1:], len(grams)), strict=True):
                rows.append((key[0].as_py(), int(f), int(b - a), pack(np.diff(grams[a:b], prepend=np.uint64(0))), pack(counts[a:b] - np.uint64(1))))
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "fragment", "size", "steps", "counts"])

    return blocks.groupBy("block").cogroup(homes.groupBy("of_block")).applyInArrow(lambda key, left, right: released(send(key, left, right)), SENT_SCHEMA)


def frequencies(sent: DataFrame) -> DataFrame:
    """of_block, fragment, dfs: for the n-grams that a block sent to a fragment, the number of classes that have them."""

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        grams = np.concatenate([np.cumsum(unpack(x.as_py(), n)) for x, n in zip(table.column("steps"), sizes, strict=True)])
        counts = np.concatenate([unpack(x.as_py(), n) for x, n in zip(table.column("counts"), sizes, strict=True)]) + np.uint64(1)
        order = np.argsort(grams, kind="stable")
        starts, lengths = _runs(grams[order])
        df = np.empty(len(grams), np.uint64)
        df[order] = np.repeat(np.add.reduceat(counts[order], starts), lengths)
        ends = np.cumsum(sizes)
        packed = [pack(df[b - n : b] - np.uint64(1)) for b, n in zip(ends, sizes, strict=True)]
        return pa.table({"of_block": table.column("block"), "fragment": table.column("fragment"), "dfs": pa.array(packed, pa.binary())})

    return sent.groupBy("fragment").applyInArrow(lambda table: released(count(table)), "of_block long, fragment int, dfs binary")


CANDIDATE_SCHEMA = "c long, n long, m long, parts array<array<long>>, prefix array<long>, bands array<long>"


def minhash_bands(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each set (of sizes[i] > 0 n-grams, one after the other) and band."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(BAND_ROWS):
            least = np.minimum.reduceat(mix(grams + np.uint64((band * BAND_ROWS + row + 1) << BITS)), starts)
            out[:, band] = mix(out[:, band] * np.uint64(31) + least)
        out[:, band] += np.uint64(band)
    return out


def candidates(blocks: DataFrame, homes: DataFrame, dfs: DataFrame, n_fragments: int, num: int, den: int) -> DataFrame:
    """Classes that may have a partner: number c, set size n, shared n-grams m, these n-grams by part of the order, the prefix, its bands."""

    def gather(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in kinds], names=names)
        idx = right.column("idx").drop_null().to_numpy()
        if not left.num_rows or not len(idx):
            return empty
        own, n, grams = home_sets(left, idx)
        every, inverse = np.unique(grams, return_inverse=True)
        of, begin = fragment_starts(every, n_fragments)
        sizes = dict(zip(of.tolist(), np.diff(np.append(begin, len(every))).tolist(), strict=True))
        found = {f.as_py(): x.as_py() for f, x in zip(right.column("fragment"), right.column("dfs"), strict=True) if f.is_valid}
        df = np.concatenate([unpack(found[f], sizes[f]) for f in sorted(sizes)])[inverse] + np.uint64(1)
        owner = np.repeat(np.arange(len(n)), n)
        m = np.bincount(owner[df > 1], minlength=len(n))
        stays = den * m >= num * n
        if not stays.any():
            return empty
        at = stays[owner] & (df > 1)
        owner, grams, df = (np.cumsum(stays) - 1)[owner[at]], grams[at], df[at]
        own, n, m = own[stays], n[stays], m[stays]
        order = np.lexsort((grams, df, owner))
        place = np.arange(len(grams)) - np.repeat(np.cumsum(m) - m, m)
        size = n + (-num * n) // den + 1 - (n - m)  # n - ceil(num n / den) + 1, less the n-grams of its own; 1 at least
        prefix = grams[order][place < np.repeat(size, m)]
        part = (grams >> np.uint64(BITS - PARTS.bit_length() + 1)).astype(np.int64)  # grams ascend in each set
        sizes = np.bincount(owner * PARTS + part, minlength=len(n) * PARTS)
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(grams.view(np.int64)))
        columns = [
            pa.array(key[0].as_py() + own), pa.array(n), pa.array(m),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * PARTS + 1, PARTS), pa.int32()), inner),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(prefix.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), pa.array(minhash_bands(prefix, size).reshape(-1).view(np.int64))),
        ]
        return pa.table(columns, names=names)

    names = ["c", "n", "m", "parts", "prefix", "bands"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(longs), longs, longs]
    back = homes.select("of_block", "idx", F.lit(None).cast("int").alias("fragment"), F.lit(None).cast("binary").alias("dfs"))
    back = back.union(dfs.select("of_block", F.lit(None).cast("int"), "fragment", "dfs"))
    return blocks.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(lambda key, left, right: released(gather(key, left, right)), CANDIDATE_SCHEMA)


def linked(overlap: Column, nx: Column, ny: Column, num: int, den: int) -> Column:
    """den * intersection >= num * union."""
    return (num + den) * overlap >= num * (nx + ny)


def links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, nx, ny) that are similar enough: overlaps are counted by part and summed.

    x goes to its set, which lies in buckets by class; many pairs may have one y, so the sets of y are a table of their own, by which
    the second join can be split.
    """
    ys = materialize(sets.join(pairs.select(F.col("y").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("y"), F.col("parts").alias("py")), "ys")
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("parts").alias("px")), "x").join(ys, "y")
    overlap = F.aggregate(F.zip_with("px", "py", lambda a, b: F.size(F.array_intersect(a, b))), F.lit(0), lambda a, x: a + x)
    return both.where(linked(overlap, F.col("nx"), F.col("ny"), num, den)).select("x", "y")


def writers(spark: SparkSession, grams: int) -> int:
    """Tasks that write a narrow table about sets with so many n-grams.

    Shuffle partitions that nobody merges would each become a file, thousands of a few rows over all tables, and every file costs the
    executors processes (for its mode, where Hadoop's native library is missing) and the driver a listing. Aggregates are merged in
    their last stage (coalesce); where a frequent key may have been split in it, the rows are dealt out again (repartition).
    """
    return max(spark.sparkContext.defaultParallelism, -(-grams // FRAGMENT_GRAMS))


def components(edges: DataFrame, files: int) -> DataFrame:
    """v, label: the least vertex of the component of every vertex that has an edge (x, y).

    Each round takes the least label around a vertex, then the label of that label; each is written to the shared folder.
    """
    both = materialize(edges.union(edges.select("y", "x")).toDF("v", "w").distinct().coalesce(files), "edges")
    labels = materialize(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")).coalesce(files), "labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        closer = labels.join(around, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("near"))
        jumped = closer.join(labels.select(F.col("v").alias("near"), F.col("label").alias("far")), "near")
        new = materialize(jumped.select("v", "was", F.least("near", "far").alias("label")).repartition(files), "labels")
        changed = not new.where("label <> was").isEmpty()
        labels = new.select("v", "label")
        if not changed:
            return labels


def postings(sets: DataFrame) -> DataFrame:
    return sets.select("c", "n", "m", *[x for x in sets.columns if x == "label"], F.posexplode("prefix").alias("place", "g"))


def star_pairs(sets: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """Each class with the centre that it meets most often."""
    rows = postings(sets)
    centre = rows.groupBy("g").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "c", "n", "m")).alias("at"), F.count("*").alias("size")).where("size > 1")
    centre = materialize(centre.select("g", "at").coalesce(files), "centres")  # so that the join is a stage of its own, in which a frequent n-gram can be split
    met = rows.join(centre, "g").where(F.col("c") != F.col("at.c")).where(linked(F.least("m", "at.m"), F.col("n"), F.col("at.n"), num, den))
    votes = met.groupBy("c", "n", F.col("at.c").alias("y"), F.col("at.n").alias("ny")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("c", "n").agg(F.max(F.struct("votes", "y", "ny")).alias("b"))
    return best.select(F.col("c").alias("x"), F.col("b.y").alias("y"), F.col("n").alias("nx"), F.col("b.ny").alias("ny"))


def band_pairs(sets: DataFrame, labels: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """Each class with the centres of its bands, where these are in other components."""
    keys = _labelled(sets.select("c", "n", "m", "bands"), labels).select("c", "n", "m", "label", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min(F.struct("c", "n", "m", "label")).alias("at"), F.count("*").alias("size")).where("size > 1").select("key", "at")
    met = keys.join(materialize(centre.coalesce(files), "band-centres"), "key").where((F.col("label") != F.col("at.label")) & linked(F.least("m", "at.m"), F.col("n"), F.col("at.n"), num, den))
    return met.select(F.col("c").alias("x"), F.col("at.c").alias("y"), F.col("n").alias("nx"), F.col("at.n").alias("ny")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))


def open_pairs(sets: DataFrame, labels: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """The pairs that share a prefix n-gram, may be similar enough, and are in different components so far."""
    placed = postings(_labelled(sets.select("c", "n", "m", "prefix"), labels))
    sizes = placed.groupBy("g", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("g").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    mixed = materialize(placed.join(materialize(main.coalesce(files), "main"), "g"), "mixed")
    a, b = mixed.where("label <> main").alias("a"), mixed.alias("b")
    # What two sets share comes no earlier in either than their first common n-gram, so it is no more than what begins there.
    able = linked(F.least(F.col("a.m") - F.col("a.place"), F.col("b.m") - F.col("b.place")), F.col("a.n"), F.col("b.n"), num, den)
    once = (F.col("b.label") == F.col("a.main")) | (F.col("a.c") < F.col("b.c"))
    met = a.join(b, "g").where((F.col("a.label") != F.col("b.label")) & able & once)
    return met.select(F.col("b.c").alias("x"), F.col("a.c").alias("y"), F.col("b.n").alias("nx"), F.col("a.n").alias("ny")).distinct()


def class_labels(blocks: DataFrame, homes: DataFrame, grams: int, num: int, den: int, files: int) -> DataFrame:
    """v, label for each class that is linked with another; grams: the size of all sets; files: of each narrow table, about."""
    n = max(1, -(-grams // FRAGMENT_GRAMS))
    dfs = frequencies(sent_grams(blocks, homes, n))
    sets = candidates(blocks, homes, dfs, n, num, den)
    sets = materialize_buckets(sets.repartition(bucket_count(sets.sparkSession), "c"), "candidates", "c")
    edges = materialize(links(materialize(star_pairs(sets, num, den, files).coalesce(files), "pairs"), sets, num, den).repartition(files), "stars")
    labels = components(edges, files)
    for step in (band_pairs, open_pairs):
        pairs = materialize(step(sets, labels, num, den, files).coalesce(files), "pairs")
        if not pairs.isEmpty():
            more = materialize(links(pairs, sets, num, den).repartition(files), "links")
            if not more.isEmpty():
                edges = edges.union(more)
                labels = components(edges, files)
    return labels


def placed_rows(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, fp, root (of the component; null without words), component_id, n_copies for every row of docs; and the files
    that a narrow table of these rows is written to, about."""
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark):
        both = materialize_buckets(hashed(docs, k), "sets", "block")
        blocks = both.where("sizes is not null").select("block", "sizes", "grams")
        members = both.where("sizes is null")
        rows = materialize(members.select("doc_id", "n_shingles", "fp"), "members", keep=True)
        files = writers(spark, rows.agg(F.sum("n_shingles")).first()[0] or 0)
        named = members.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.max("n_shingles").alias("n"), F.min(F.struct("block", "idx")).alias("home"))
        named = materialize(named.select("fp", "least", "n_copies", "n", (F.col("home.block") + F.col("home.idx")).alias("c"), F.col("home.block").alias("of_block"), F.col("home.idx").alias("idx")).coalesce(files), "classes")
        grams = named.agg(F.sum("n")).first()[0] or 0
        labels = class_labels(blocks, named.select("of_block", "idx"), grams, num, den, files)
        placed = _labelled(named.select("c", "fp", "least", "n_copies"), labels).withColumnRenamed("label", "root")
        placed = materialize(placed, "roots", keep=True)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(ids, "root").select("fp", "root", "component_id", "n_copies")
    out = rows.join(of, "fp", "left").select("doc_id", "n_shingles", "fp", "root", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    return out, files


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows with the same set), for every row of docs."""
    return placed_rows(docs, k, num, den)[0].select("doc_id", "n_shingles", "component_id", "n_copies")


def set_print(k: int):
    """The fingerprint of a text's set as a function of the text."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = word_hashes()
        for texts in batches:
            sets = (gram_set(t, k, of) for t in texts)
            yield pd.Series([fingerprint(s) if len(s) else None for s in sets], dtype=object)

    return run


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that with the least doc_id that is not null, and all their columns.

    A row is known by its doc_id and its set's fingerprint; texts are hashed again only where ids are null or shared. Rows without
    words all stay, but one of those that repeat doc_id and text.
    """
    with scratch(docs.sparkSession):
        placed, files = placed_rows(docs, k, num, den)
        found = materialize(placed.select("doc_id", "fp", "root").repartition(files), "components")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
        heads = found.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.fp")
        heads = heads.union(found.where("root is null").select("doc_id", "fp").distinct()).toDF("head", "head_fp").withColumn("is_head", F.lit(True))
        ids = found.groupBy("doc_id").agg((F.col("doc_id").isNull() | (F.count("*") > 1)).alias("shared"))
        of = ids.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left")
        heads = materialize(of.select("doc_id", "shared", F.col("head_fp"), F.col("is_head").isNotNull().alias("is_head")).coalesce(files), "heads", keep=True)
    gone = heads.where("doc_id is not null and (shared or not is_head)").select("doc_id").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(docs.columns)
    again = heads.where("shared and is_head").select(F.col("doc_id").alias("head"), "head_fp")
    same = docs["doc_id"].eqNullSafe(again["head"])
    if not again.isEmpty():
        fp = "fp"
        while fp in docs.columns:
            fp += "_"
        own = docs.join(again, same, "left_semi").withColumn(fp, set_print(k)(docs["text"]))
        own = own.join(again, same & F.col(fp).eqNullSafe(again["head_fp"]), "left_semi")
        worded = own.where(F.col(fp).isNotNull()).dropDuplicates(["doc_id", fp])
        bare = own.where(F.col(fp).isNull()).dropDuplicates(["doc_id", "text"])
        kept = kept.union(worded.union(bare).drop(fp))
    return kept
