"""Near-duplicate groups: SuperMinHash signatures, banding, links checked on full shingle sets, union-find grouping.

Exact copies of a set collapse to one representative first. A bucket of a band never becomes all its pairs: its
first member is compared with the others, links make components, and only members outside the first one's component
are compared further, in blocks against blocks of the bucket's other members, of which only links come out. So each pair of
a bucket is compared or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.tables import documents_in, ragged_take, ship, shuffle_partitions, write_bucketed, write_shared

SIZE, ROWS = 128, 4  # signature length, and values to a band: 32 bands
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text; A-Z in lower case, words between ASCII
    white space. Fewer words are one shingle, none are none."""
    from xxhash import xxh3_64_intdigest
    tokens = text.encode().lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * _ODD + h[i:len(h) - n + 1 + i]
    return np.unique(mix(total + np.uint64(n)))


def super_min_hash(elements: np.ndarray, owner: np.ndarray, owners: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures of many sets at once (``owner`` says whose each element is).

    Each element draws a random permutation of the places, one step of Fisher-Yates per level, and offers
    ``level + random`` to the place it drew. A set stops once no place could still improve: all its values lie below
    the next level. So large sets need two or three levels, and no place is left empty by small ones.
    """
    out = np.full((owners, size), np.inf)
    flat = out.ravel()
    own, x = owner.astype(np.int64), elements
    place: np.ndarray | None = None
    for level in range(size):
        if not len(x):
            break
        h = mix(x + np.uint64((level + 1) * int(_ODD) % 2**64))
        drawn = level + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(size - level)).astype(np.int64)
        if place is None:
            spot = drawn
        else:
            at = np.arange(len(x))
            spot = place[at, drawn].astype(np.int64)
            place[at, drawn] = place[:, level]
        np.minimum.at(flat, own * size + spot, level + (h >> np.uint64(32)) / 2.0 ** 32)
        busy = (out.max(axis=1) >= level + 1)[own]
        if place is None:
            own, x, drawn = own[busy], x[busy], drawn[busy]
            place = np.tile(np.arange(size, dtype=np.uint16), (len(x), 1))
            place[np.arange(len(x)), drawn] = 0
        elif not busy.all():
            own, x, place = own[busy], x[busy], place[busy]
    return out


def sketches(docs: DataFrame, words: int = WORDS, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): two sums that name the exact set, and a key for each band."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ids, all_texts in documents_in(batches, 1_500_000):
            for low in range(0, len(all_ids), 2000):
                ids = all_ids[low:low + 2000]
                sets = [shingle_set(t, words) for t in all_texts[low:low + 2000]]
                counts = np.array([len(s) for s in sets])
                signature = super_min_hash(np.concatenate(sets), np.repeat(np.arange(len(sets)), counts), len(sets), size)
                values = signature.view(np.uint64).reshape(len(sets), size // rows, rows)
                keys = np.broadcast_to(np.arange(size // rows, dtype=np.uint64), values.shape[:2]) * _ODD
                for i in range(rows):
                    keys = mix(keys * _ODD + values[:, :, i])
                name_a = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                name_b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (size // rows)),
                                                 pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(name_a.view(np.int64)),
                     pa.array(name_b.view(np.int64)), bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    ship(docs)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc, hashes) of the documents named in ``wanted`` (doc), laid out by doc."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = [shingle_set(t or "", words).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))],
                    names=["doc", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string"))
    return write_bucketed(texts.join(wanted, "doc", "left_semi").mapInArrow(work, "doc bigint, hashes array<bigint>"),
                          "shingle_sets", "doc", shuffle_partitions(docs))


def _local_union_find(edges: DataFrame) -> DataFrame:
    """Within each task, edges become one edge from each node to the smallest node it reaches there."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(work, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each edge's component, for all nodes but the smallest themselves.

    Tasks run union-find over their own edges; what they find meets in star rounds (every node hands its smallest
    neighbour to its larger ones) until each node has one edge, to a node that has none.
    """
    ship(edges)
    parts = shuffle_partitions(edges)
    e = write_shared(_local_union_find(edges.where("u <> v").repartition(parts, F.greatest("u", "v"))), "union_find")
    while True:
        lowest = e.groupBy("u").agg(F.min("v").alias("low"))
        # a node's other parents join its lowest one; the node itself keeps only that
        hung = e.join(lowest, "u").select(F.explode(F.array(
            F.struct("u", F.col("low").alias("v")),
            F.struct(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")))).alias("e")).select("e.u", "e.v")
        hung = write_shared(hung.where("u <> v").distinct(), "union_find")
        low = hung.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("parents"))
        # pointer jumping: a node's edge goes to its parent's lowest
        up = low.select(F.col("u").alias("v"), F.col("low").alias("above"))
        e = write_shared(hung.join(up, "v", "left").select("u", F.coalesce("above", "v").alias("v")).where("u <> v").distinct(),
                         "union_find")
        one = e.groupBy("u").agg(F.count("*").alias("parents"), F.min("v").alias("v"))
        unfinished = one.where("parents > 1").limit(1).count() or e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not unfinished:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """Groups of documents whose shingle sets have ``100 * common >= percent * united``, and what links them.

    Returns ``doc_id, n_shingles, component_id`` (smallest doc_id reachable over links) and ``kept`` (it is the
    document itself), one row for each input row. Texts without words (null, empty) have no shingles and are
    linked with nothing; rows of one id are one document; rows with a null id are kept, with a null component. Other
    columns are ignored. Candidates come from bands of ``rows`` signature values; at 32 bands of 4 a pair
    at 0.75 is missed with probability 5e-6. Every link is confirmed on the full sets of 64-bit shingle hashes.
    """
    sketch = write_shared(sketches(docs, words, size, rows), "sketches")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = write_shared(usable.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "set_classes")
    in_bucket = classes.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("low"), F.max("doc").alias("last")).where("low.doc <> last")
    shared = shared.select("bucket", F.col("low.doc").alias("first"), F.col("low.n").alias("n_first"))
    members = write_shared(in_bucket.join(shared, "bucket"), "bucket_members")

    sets = _sets(docs, members.select("doc").distinct(), words)
    pairs = members.where("doc <> first").where(_sizes_allow("n", "n_first", percent)).select(
        F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    links = write_shared(_confirmed(pairs, sets, percent), "links")
    labels = components(links)
    links = links.unionByName(write_shared(_confirmed(_second_hubs(members, labels, percent), sets, percent), "links"))
    labels = components(links)
    links = links.unionByName(write_shared(_outside_links(members, labels, sets, percent), "links"))
    labels = components(links)
    of_class = classes.select("set_a", "set_b", "n_shingles", F.col("doc").alias("_doc"))
    # rows of one id with different texts are one document: their classes are linked too
    own = usable.join(of_class, ["set_a", "set_b", "n_shingles"]).select("doc_id", "_doc")
    several = own.groupBy("doc_id").agg(F.min("_doc").alias("u"), F.max("_doc").alias("v")).where("u <> v")
    if not several.isEmpty():
        mixed = own.join(several.select("doc_id"), "doc_id", "left_semi").where("doc_id <> _doc")
        labels = components(links.unionByName(mixed.select(F.col("doc_id").alias("u"), F.col("_doc").alias("v"))))
    labels = labels.select(F.col("node").alias("_doc"), F.col("label").alias("_label"))
    out = sketch.join(of_class, ["set_a", "set_b", "n_shingles"], "left").join(labels, "_doc", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("_label", "_doc", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sizes_allow(n: str, other: str, percent: int):
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


BLOCK, CHUNK = 256, 1024  # sets compared with each other in one task


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets other than the first, with their component's ``label`` and whether it is another than the first one's."""
    main = labels.select(F.col("node").alias("first"), F.col("label").alias("main"))
    rest = members.where("doc <> first").join(labels.withColumnRenamed("node", "doc"), "doc", "left").join(main, "first", "left")
    label = F.coalesce("label", "doc")
    return write_shared(rest.select("bucket", "doc", "n", label.alias("label"), (label != F.coalesce("main", "first")).alias("outside")),
                        "bucket_members")


def _second_hubs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's smallest member outside the first one's component with the others outside it: near copies of one
    another become one component by a link each."""
    out = _labelled(members, labels).where("outside")
    hub = out.groupBy("bucket").agg(F.min(F.struct("doc", "n", "label")).alias("hub")).select(
        "bucket", F.col("hub.doc").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.label").alias("label_a"))
    return out.join(hub, "bucket").where("doc <> a and label <> label_a").where(_sizes_allow("n", "n_a", percent)).select(
        "a", F.col("doc").alias("b")).distinct()


def _outside_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of bucket members outside their first one's component with members of other components.

    The first has been compared with everyone, and what is in one component needs no comparison. Outsiders are dealt into blocks, the
    others into chunks, both of bounded size by the bucket's counts; each block meets each chunk in one task, which gives out the links
    that join components, no more than there are members.
    """
    rest = _labelled(members, labels)
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("outside").alias("n_out"), F.min("label").alias("low"),
                                       F.max("label").alias("high")).where("n_out > 0 and low <> high")
    sizes = sizes.select("bucket", F.ceil(F.col("n_out") / BLOCK).cast("int").alias("blocks"),
                         F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    open_ = rest.join(sizes, "bucket")
    block, chunk = F.pmod(F.xxhash64("doc"), "blocks").cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), "chunks").cast("int")
    hubs = open_.where("outside").withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = open_.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["bucket", "block", "chunk"]
    hubs, others = [side.select(*key, "doc", "label").join(sets, "doc").select(*key, "doc", "label", "hashes")
                    .toDF(*[f"{name}_{c}" for c in key], "doc", "label", "hashes")
                    for name, side in (("hub", hubs), ("other", others))]

    def compare(hubs_of: pa.Table, others_of: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if hubs_of.num_rows and others_of.num_rows:
            hub_docs, hub_labels = hubs_of.column("doc").to_numpy(), hubs_of.column("label").to_numpy().copy()
            hashes = hubs_of.column("hashes").combine_chunks()
            n_hub = hashes.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(n_hub)), n_hub)
            values = hashes.flatten().to_numpy()
            order = np.argsort(values, kind="stable")
            known, first = np.unique(values[order], return_index=True)
            owner, ends = owner[order], np.append(first, len(values))
            joined: dict[int, int] = {}  # labels that links have joined to others
            for doc, label, of_doc in zip(*(others_of.column(c) for c in ("doc", "label", "hashes"))):
                doc, label = doc.as_py(), label.as_py()
                while label in joined:
                    label = joined[label]
                open_ = hub_labels != label
                if not open_.any():
                    continue
                mine = of_doc.values.to_numpy()
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                common = np.bincount(ragged_take(owner, ends, at[known[at] == mine])[0], minlength=len(n_hub))
                hit = (100 * common >= percent * (n_hub + len(mine) - common)) & open_
                labels_hit, firsts = np.unique(hub_labels[hit], return_index=True)
                for other, i in zip(labels_hit.tolist(), np.flatnonzero(hit)[firsts].tolist()):
                    found.append((int(hub_docs[i]), doc))
                    joined[other] = label
                    hub_labels[hub_labels == other] = label
        u, v = zip(*found) if found else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return hubs.groupBy(*hubs.columns[:3]).cogroup(others.groupBy(*others.columns[:3])).applyInArrow(compare, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs (hub ``a``, other ``b``), by their full sets. The others' sets travel to their hubs."""
    others = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("of_b"))
    hubs = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("of_a"))
    both = pairs.join(others, "b").join(hubs, "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    united = F.size("of_a") + F.size("of_b") - common
    return both.where(100 * common >= percent * united).select(F.col("a").alias("u"), F.col("b").alias("v"))
