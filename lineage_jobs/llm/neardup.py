"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.components import connected_components
from lineage_jobs.llm.lanes import distance, lane_mask, lanes_apart
from lineage_jobs.runtime import broadcast_if_small, materialize, release

#: The signature: lanes of 16 bits that the index covers, four to a chunk, and lanes of 8 bits that only the distance takes.
CHUNKS, LANES_A_CHUNK, FILTER_LONGS = 8, 4, 12
INDEX_LANES, FILTER_LANES = CHUNKS * LANES_A_CHUNK, FILTER_LONGS * 8
#: Lanes that may differ in a chunk that finds a pair. By the pigeonhole principle some chunk of a pair has no more
#: than this if at most ``CHUNKS * (ALLOWED + 1) - 1`` = 15 of the 32 index lanes differ.
ALLOWED = 1
#: Lanes of all 128 that may differ. At a similarity of 0.8 they number 25.6 +- 4.5. Sets of fewer than ``SMALL``
#: shingles are compared in full without this.
MAX_APART, SMALL = 48, 60
#: Entries of a worker's cache of word hashes.
CACHED = 100_000

INDEX = [f"s{k}" for k in range(CHUNKS)]
#: Sets of one component in one bucket beyond which the component is taken as a whole.
CROWD = 8
#: Sets of either side that are compared in one group.
BLOCK = 256
#: Each lane mixes a shingle's hash by odd constants of its own, so that lanes are independent of each other.
FIRST, SECOND = np.random.default_rng(20240611).integers(0, 1 << 31, (2, INDEX_LANES + FILTER_LANES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


WORDS = WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased and words are what stands between spaces and control spaces (9 to 13). A text with fewer
    words is one shingle; one without words or null has none.
    """
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    w = np.fromiter(map(WORDS.__getitem__, found), np.uint64, len(found))
    n = len(w) - words + 1
    h = w[:n].copy()
    for k in range(1, words):
        h = h * MULTIPLIER + w[k : k + n]
    h ^= h >> np.uint64(30)
    h *= MIX
    h ^= h >> np.uint64(27)
    return np.unique(h)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longs of the index lanes and of the filter lanes.

    A lane takes the low bits of the least of the hashes as the lane mixes them; every hash of a set is equally likely
    to be it, so two sets agree in a lane as often as their Jaccard similarity says, whatever the other lanes do.
    """
    h, least = (hashes >> np.uint64(32)).astype(np.uint32), None
    for start in range(0, len(h), 512):  # so that a block of all lanes stays in the cache
        x = h[None, start : start + 512] * FIRST[:, None]
        x ^= x >> np.uint32(16)
        x *= SECOND[:, None]
        block = x.min(axis=1)
        least = block if least is None else np.minimum(least, block)
    index = (least[:INDEX_LANES] & np.uint32(0xFFFF)).astype("<u2").view("<i8")
    rest = (least[INDEX_LANES:] & np.uint32(0xFF)).astype("u1").view("<i8")
    return index, rest


def signatures(documents: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, s0.., rest)``: set_a and set_b are 128 bits that name the shingle set,
    s0.. hold the index lanes and ``rest`` the filter lanes."""

    def run(batches):
        import xxhash

        for batch in batches:
            n, names, index, rest = [], [], [], []
            for value in batch.column(1):
                hashes = shingle_set(value.as_py(), words)
                lanes = signature(hashes) if len(hashes) else (np.zeros(CHUNKS, np.int64), np.zeros(FILTER_LONGS, np.int64))
                n.append(len(hashes))
                names.append(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8"))
                index.append(lanes[0])
                rest.append(lanes[1])
            ids, sigs = np.array(names, np.int64).reshape(-1, 2), np.array(index, np.int64).reshape(-1, CHUNKS)
            columns = [np.ascontiguousarray(c) for c in (*ids.T, *sigs.T)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *map(pa.array, columns), pa.array(rest, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", *INDEX, "rest"],
            )

    schema = ", ".join(f"{c} long" for c in ["doc_id", "n_shingles", "set_a", "set_b", *INDEX])
    return documents.select("doc_id", "text").mapInArrow(run, schema + ", rest array<long>")


def index_keys(sets: DataFrame) -> DataFrame:
    """``(key, slot, id, n)``: each chunk with each choice of the lane that may differ left out."""
    keys = [
        F.xxhash64(F.lit(c * LANES_A_CHUNK + lane), F.col(f"s{c}").bitwiseAND(F.lit(lane_mask(lane))))
        for c in range(CHUNKS)
        for lane in range(LANES_A_CHUNK)
    ]
    return sets.select(F.posexplode(F.array(*keys)).alias("slot", "key"), "id", "n").select("key", "slot", "id", "n")


def near_enough(n, m, percent: int):
    """Whether sets of these sizes can be linked at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def full_sets(ids: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """``(id, hashes)``: the full shingle sets of the documents named by ``ids(doc_id)``."""
    involved = materialize(ids.distinct())
    few = broadcast_if_small(involved, involved.count())

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py(), words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    texts = documents.select("doc_id", "text").join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return materialize(texts.mapInArrow(run, "id long, hashes array<long>"))


def confirm(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have at least ``percent`` % of their union in common."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), documents, words)
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    union = F.size("hashes_a") + F.size("hashes_b") - common
    links = materialize(
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")), "a")
        .where(100 * common >= percent * union)
        .select("a", "b")
    )
    release(sets)
    return links


def _same_chunk(slot, left: list, right: list):
    """Whether ``slot`` is the first under which two signatures meet, so that a pair comes up once."""
    first = F.lit(None).cast("int")
    for c in reversed(range(CHUNKS)):
        apart = lanes_apart(left[c], right[c], 16)
        # a chunk without a difference meets under each of its slots, one with a difference only under that lane's
        here = F.when(apart == 0, slot == c * LANES_A_CHUNK).otherwise(F.floor(slot / LANES_A_CHUNK) == c)
        first = F.when(apart <= ALLOWED, here).otherwise(first if c < CHUNKS - 1 else F.lit(False))
    return first


def apart(left: list, right: list, left_rest, right_rest):
    """Lanes of all that differ between two signatures."""
    rest = F.aggregate(
        F.zip_with(left_rest, right_rest, lambda x, y: lanes_apart(x, y, 8)), F.lit(0), lambda total, x: total + x.cast("int")
    )
    return distance(list(zip(left, right, strict=True)), 16) + rest


def open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, with ``own`` and ``hubs``, the components of the row
    and of its bucket's hub, and ``crowd``: whether its component has more than :data:`CROWD` sets in the bucket."""
    mine = labels.select(F.col("node").alias("id"), F.col("component").alias("own"))
    its = labels.select(F.col("node").alias("hub"), F.col("component").alias("hubs"))
    told = (
        members.join(mine, "id", "left")
        .join(its, "hub", "left")
        .withColumn("own", F.coalesce("own", "id"))
        .withColumn("hubs", F.coalesce("hubs", "hub"))
    )
    mixed = told.groupBy("key").agg(F.max(F.col("own") != F.col("hubs")).alias("mixed"), F.count(F.lit(1)).alias("size"))
    rows = told.join(mixed.where("mixed and size > 2").select("key"), "key")
    counts = rows.groupBy("key", "own").agg((F.count(F.lit(1)) > CROWD).alias("crowd"))
    return materialize(rows.join(counts, ["key", "own"]))


def open_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of different components in a bucket that may still be links, crowds aside.

    Their sizes must allow it and the signatures of larger sets lie close enough; the hub was tried with all.
    """
    alone = materialize(rows.where("not crowd and id <> hub").join(sets.select("id", *INDEX, "rest"), "id"))
    left = alone.where("own <> hubs").select(*[F.col(c).alias(f"l_{c}") for c in alone.columns])
    mine, theirs = [F.col(f"l_{c}") for c in INDEX], [F.col(c) for c in INDEX]
    cond = (
        (F.col("l_key") == F.col("key"))
        & (F.col("l_own") != F.col("own"))
        & ((F.col("own") == F.col("hubs")) | (F.col("l_id") < F.col("id")))
        & near_enough(F.col("l_n"), F.col("n"), percent)
        & _same_chunk(F.col("slot"), mine, theirs)
        & ((F.least("l_n", "n") < SMALL) | (apart(mine, theirs, F.col("l_rest"), F.col("rest")) <= MAX_APART))
    )
    return left.join(alone, cond).select(F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b")).distinct()


def crowd_links(rows: DataFrame, labels: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links that join a crowd with other components of its buckets, one for each set and block at most.

    A component that crowds a bucket is compared as a whole with every other component there: both sides are dealt
    into blocks by hash, and each pair of blocks is a group of bounded size that gives a row only for a link.
    """
    crowds = rows.where("crowd").select("key", F.col("own").alias("crowd_id")).distinct()
    others = rows.select("key", F.col("own").alias("other_id")).distinct()
    meet = materialize(others.join(crowds, "key").where("other_id <> crowd_id").select("other_id", "crowd_id").distinct())
    if meet.isEmpty():
        return meet.select(F.col("other_id").alias("a"), F.col("crowd_id").alias("b"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = lambda c, out: labels.select(F.col("component").alias(c), F.col("node").alias(out))
    outside = (
        meet.join(named("other_id", "id"), "other_id", "left").withColumn("id", F.coalesce("id", "other_id")).select("crowd_id", "id").distinct()
    )
    parts = outside.groupBy("crowd_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("out_parts")).join(
        sizes.select(F.col("component").alias("crowd_id"), F.ceil(F.col("size") / BLOCK).cast("int").alias("in_parts")), "crowd_id"
    )
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sets = full_sets(
        outside.select(F.col("id").alias("doc_id")).unionByName(
            meet.select("crowd_id").distinct().join(named("crowd_id", "doc_id"), "crowd_id").select("doc_id")
        ),
        documents,
        words,
    )
    left = outside.join(parts, "crowd_id").withColumn("p", part("out_parts")).withColumn("q", every("in_parts"))
    right = named("crowd_id", "id").join(parts, "crowd_id").withColumn("q", part("in_parts")).withColumn("p", every("out_parts"))
    keys = ["crowd_id", "p", "q"]

    def dealt(side: DataFrame):
        rows = side.select(*keys, "id").join(sets, "id")
        return rows.select(*[F.col(c).alias(c) for c in [*keys, "id", "hashes"]]).groupBy(*keys)

    def links(a: pa.Table, b: pa.Table) -> pa.Table:
        lists = [x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in b.column("hashes")]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat, owner = np.concatenate(lists) if lists else np.zeros(0, np.int64), np.repeat(np.arange(len(lists)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, found = b.column("id").to_numpy(), []
        for one, value in zip(a.column("id").to_pylist(), a.column("hashes"), strict=True):
            h = value.values.to_numpy()
            low, high = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
            runs = high - low
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            common = np.bincount(owner[hits], minlength=len(lists))
            linked = np.flatnonzero(100 * common >= percent * (len(h) + sizes - common))
            if len(linked):
                found.append((one, int(ids[linked[0]])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    out = materialize(dealt(left).cogroup(dealt(right)).applyInArrow(links, "a long, b long"))
    release(sets, meet)
    return out


def near_duplicates(
    documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each document.

    Documents are linked if their sets of word shingles have at least ``percent`` % of their union in common;
    ``component_id`` is the least id that links lead to. Documents with equal sets are one node from the start.
    The signatures of the nodes are put into buckets under each chunk less one lane; each bucket's least node is
    compared with all others, the components of those links are found, and then, in buckets that hold several
    components, the pairs between components whose signatures lie close enough, large components as a whole in blocks.
    So a bucket of copies gives rows in proportion to its size, and nothing is capped. Every link is confirmed on the full sets.
    Documents without words are linked with nothing; so are rows with a null id, whose ``component_id`` is null and
    which are kept. Rows with the same id are one node with the greatest of their texts (null the least); each of them
    gives a row. An empty table gives an empty result; other columns make no difference.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if (n := twice.count()) > 0:
        same = docs.join(broadcast_if_small(twice, n), "doc_id").groupBy("doc_id").agg(F.struct(F.max("text").alias("text")).alias("best"))
        docs = docs.join(same, "doc_id", "left").select("doc_id", F.when(F.col("best").isNotNull(), F.col("best.text")).otherwise(F.col("text")).alias("text"))
    signed = materialize(signatures(docs, words))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = materialize(
        usable.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            *[F.first(c).alias(c) for c in [*INDEX, "rest"]],  # functions of the set: any row's will do
        )
    )
    keys = index_keys(sets)
    hubs = (
        keys.groupBy("key")
        .agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    members = materialize(keys.join(hubs, "key"))
    tried = (
        members.where("id <> hub")
        .where(near_enough(F.col("n"), F.col("hub_n"), percent))
        .select(F.col("hub").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    tried = materialize(tried)
    links = confirm(tried, docs, words, percent)
    labels = materialize(connected_components(links, "a", "b"))
    rows = open_rows(members, labels)
    further = confirm(materialize(open_pairs(rows, sets, percent)), docs, words, percent)
    joined = crowd_links(rows, labels, docs, words, percent)
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further).unionByName(joined)
    found = materialize(connected_components(edges, "a", "b")).select(F.col("node").alias("id"), F.col("component"))
    named = sets.select("set_a", "set_b", "id").join(found, "id", "left").select(
        "set_a", "set_b", F.coalesce("component", "id").alias("component")
    )
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    release(members, labels, rows, tried, links, further, joined)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
