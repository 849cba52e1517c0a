"""Fuzzy line deduplication by MinHash over all character shingles, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.components import connected_components
from lineage_jobs.runtime import MAX_BROADCAST_ROWS, broadcast_if_small, materialize, release, spread_join

#: Characters of a shingle; shorter lines are one shingle.
CHARS = 10
#: Least similarity of linked lines, in percent.
PERCENT = 80
#: The lanes of the signature stand in a square of three by three; the bands are its twelve lines of three (rows,
#: columns and broken diagonals), so that any two lanes share one band. Two lines share a band with a chance of
#: 0.9902 at a similarity of 0.8, 0.9973 at 0.85, 0.9996 at 0.9.
LANES = 9
BANDS = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6)]
#: Shingles whose lanes are combined in one row before the aggregate.
STEP = 8
#: Longs of the bitmap of a shingle set, in which every shingle of the set turns one bit over. Two bitmaps differ in no more
#: bits than the sets do in shingles, so pairs that differ in too many can't be linked: the test loses no link.
WORDS = 16
#: Lines outside the hub's component from which a bucket is a crowd, whose lines are compared by their rarest shingles.
CROWD = 100
#: Rows of a bucket's smaller side that one task compares with its larger side.
BLOCK = 500
#: Further hubs that are drawn from either side of a bucket before all pairs that are still open are compared.
HUBS = 3
#: Rows of bitmaps up to which they are broadcast, at some 160 bytes each.
MAX_BITMAPS = 100_000
#: Rows of linked or repeated lines up to which they are broadcast, at some 80 bytes each.
MAX_LINKED = 500_000
KEYS = [f"k{b}" for b in range(len(BANDS))]
NAME = ["name_a", "name_b"]
CLASS = ["class_a", "class_b"]
BITMAP = [f"m{k}" for k in range(WORDS)]


def bare_line(lower):
    """What of a line in lower case counts: its words with one space between."""
    odd = F.contains(lower, F.lit("  ")) | F.startswith(lower, F.lit(" ")) | F.endswith(lower, F.lit(" "))
    for space in "\t\r\x0b\x0c":
        odd = odd | F.contains(lower, F.lit(space))
    return F.when(odd, F.trim(F.regexp_replace(lower, "[ \t\r\x0b\x0c]++", " "))).otherwise(lower)


def computed(column):
    """A column behind an ``explode`` of one item, so that what refers to it several times doesn't compute it again."""
    return F.explode(F.array(column))


def lines_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, line)``: the lines of each text, from 0. A null text has none, an empty text has one."""
    return documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    )


def bare_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``bare`` in place of ``line``."""
    rest = [c for c in lines.columns if c != "line"]
    lower = lines.select(*rest, computed(F.lower("line")).alias("lower"))
    return lower.select(*rest, computed(bare_line(F.col("lower"))).alias("bare"))


def starts(code):
    """The bytes, from 1, at which the shingles of a text in UTF-32 start."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(code) - (4 * CHARS - 1)), F.lit(4))


def shingle(code, start):
    """The hash of the shingle at a byte of a text in UTF-32, where any place is reached at once."""
    return F.xxhash64(F.substring(code, start, F.lit(4 * CHARS)))


def lane(k: int, at: int):
    """The number whose minimum over all shingles is lane ``k``, of the shingle ``at`` of a row: the shingle's hash, mixed anew
    for each four lanes and turned by 16 bits for each lane, so that every lane is decided by bits of its own."""
    h, turn = F.col(f"h{k // 4}_{at}"), 16 * (k % 4)
    return F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h


def lane_minima(bare: DataFrame, count: int, by: list[str]) -> DataFrame:
    """The columns ``by``, ``copies`` and ``l0..``, of ``bare`` with ``by`` and ``bare``: its rows and the first ``count`` lanes.

    Every :data:`STEP` shingles are a row of a generated loop, which repeats the last one where a line has no more, and lanes are
    combined minima, so that no array of hashes is held.
    """
    code = bare.select(*by, computed(F.encode("bare", "UTF-32")).alias("code"))
    last = F.greatest(F.lit(1), F.octet_length("code") - (4 * CHARS - 1))
    at = code.select(*by, "code", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * STEP))).alias("start"))
    place = lambda k: F.least(F.col("start") + 4 * k, F.col("last")) if k else F.col("start")
    hashed = at.select(*by, "start", *[shingle(F.col("code"), place(k)).alias(f"h_{k}") for k in range(STEP)])
    mixed = hashed.select(*by, "start", *[F.xxhash64(f"h_{k}", F.lit(j)).alias(f"h{j}_{k}") for j in range(-(-count // 4)) for k in range(STEP)])
    lanes = [F.min(F.least(*[lane(k, at) for at in range(STEP)])).alias(f"l{k}") for k in range(count)]
    return mixed.groupBy(*by).agg(F.count_if(F.col("start") == 1).alias("copies"), *lanes)


def names() -> list:
    """The two halves of a bare line's name of 128 bits."""
    return [F.xxhash64("bare"), F.xxhash64(F.lit(1), "bare")]


def hex_name(halves: list):
    """The two halves of a name in 32 hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in halves]))


def named_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``bare`` and its name, ``name_a`` and ``name_b``, in place of ``line``; blank lines have no name."""
    given = [F.when(F.col("bare") != "", name).alias(c) for c, name in zip(NAME, names(), strict=True)]
    return bare_lines(lines).select("*", *given)


def line_signatures(bare: DataFrame, by: list[str] = NAME) -> DataFrame:
    """The columns ``by``, ``copies`` and ``k0..``: of each line of ``bare``, which has ``by`` and ``bare``, the rows and the keys of the bands."""
    bands = [F.xxhash64(F.lit(b), *[f"l{k}" for k in band]).alias(f"k{b}") for b, band in enumerate(BANDS)]
    return lane_minima(bare, LANES, by).select(*by, "copies", *bands)


def shingles_of(rows: DataFrame, bare: str, out: str) -> DataFrame:
    """``rows`` with the shingle hashes of a column of bare lines as ``out`` in its place."""
    rest = [c for c in rows.columns if c != bare]
    # the outer loop of one round names the code, which the inner loop else would copy from the row for each shingle
    hashes = F.transform(F.array(F.encode(bare, "UTF-32")), lambda code: F.transform(starts(code), lambda k: shingle(code, k)))
    return rows.select(*rest, F.explode(hashes).alias(out))


def lines_named(bare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``bare(line_id, bare)``, in which lines may repeat: ``(line_id, bare)``, each once, and ``(line_id, n, m0..)``,
    the sizes and bitmaps of their shingle sets."""
    texts = materialize(bare.distinct())
    distinct = shingles_of(texts, "bare", "hashes").select("line_id", computed(F.array_distinct("hashes")).alias("hashes"))
    sets = distinct.select("line_id", F.size("hashes").cast("long").alias("n"), "hashes")
    bits = sets.select("line_id", "n", F.explode("hashes").alias("h"))
    bits = bits.select("line_id", "n", F.pmod("h", F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 AS int))").alias("bit"))
    turned = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")).alias(m) for k, m in enumerate(BITMAP)]
    return texts, materialize(bits.groupBy("line_id", "n").agg(*turned))


def alike(left: str, right: str, percent: int):
    """Whether sizes and bitmaps of two lines, under two prefixes, allow a link: of sets with ``percent`` % of their union in
    common at most ``(100 - percent) / (100 + percent)`` of both sizes together stand in one set only."""
    a, b = F.col(f"{left}n"), F.col(f"{right}n")
    turned = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}{m}").bitwiseXOR(F.col(f"{right}{m}"))) for m in BITMAP])
    most = (100 - percent) * (a + b)
    return ((100 + percent) * F.abs(a - b) <= most) & ((100 + percent) * turned <= most)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)``, stored, of ``pairs(a, b, both)`` whose shingle sets, of ``both`` shingles together, have ``percent`` %
    of their union in common. The lines are shipped, an eighth of their sets, and cut again."""
    side = lambda k: texts.select(F.col("line_id").alias(k), F.col("bare").alias(f"bare_{k}"))
    half = materialize(spread_join(pairs, side("b"), "b", by=["a", "b"]))
    met = spread_join(half, side("a"), "a", by=["a", "b"])
    cut = shingles_of(shingles_of(met, "bare_a", "all_a"), "bare_b", "all_b")
    shared = F.size(F.array_intersect("all_a", "all_b"))
    out = materialize(cut.where((100 + percent) * shared >= percent * F.col("both")).select("a", "b"))
    release(half)
    return out


def members_of(keys: DataFrame) -> DataFrame:
    """``(key, id, hub)``, stored: the rows of ``keys(key, id)`` whose bucket has several lines, with the least of these.

    Nearly all keys are of one line, so the rows are sorted by key once and not aggregated before the shuffle.
    """
    bucket = Window.partitionBy("key")
    ends = keys.select("key", "id", F.min("id").over(bucket).alias("hub"), F.max("id").over(bucket).alias("last"))
    return materialize(ends.where("hub < last").select("key", "id", "hub"))


def opened(told: DataFrame, least: int) -> DataFrame:
    """The rows of ``told(key, id, own, ..)`` in buckets of at least ``least`` lines that hold several components, with ``outside``,
    whether a line isn't in the component of its bucket's least line, ``open``, how many aren't, and ``blocks``."""
    bucket = Window.partitionBy("key")
    marked = told.withColumn("outside", F.col("own") != F.min_by("own", "id").over(bucket))
    counted = marked.withColumn("open", F.count_if("outside").over(bucket)).withColumn("size", F.count(F.lit(1)).over(bucket))
    return counted.where(f"open > 0 and size >= {least}").drop("size").withColumn("blocks", F.ceil(F.col("open") / BLOCK).cast("int"))


def open_rows(members: DataFrame, labels: DataFrame, bitmaps: DataFrame, few: bool) -> DataFrame:
    """``(id, key, own, outside, open, blocks, n, m0..)``, stored: the :func:`opened` lines of the buckets of at least three lines."""
    mine = broadcast_if_small(labels, labels.count()).select(F.col("node").alias("id"), F.col("component").alias("own"))
    told = members.select("key", "id").join(mine, "id", "left").select("key", "id", F.coalesce("own", "id").alias("own"))
    its = bitmaps.withColumnRenamed("line_id", "id")
    return materialize(opened(told, 3).join(F.broadcast(its) if few else its, "id"))


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, both)`` of further hubs with the lines of other components of their buckets.

    Of each bucket :data:`HUBS` lines of the first hub's component and as many outside are drawn by hash; those inside
    meet the lines outside, those outside meet all. So a bucket gives rows in proportion to its size.
    """
    ranks = [F.struct(F.xxhash64("id", F.lit(1 + k)).alias("rank"), "id", "own", "outside", "n", *BITMAP) for k in range(HUBS)]
    drawn = rows.groupBy("key").agg(*[F.min(F.when(F.col("outside") == out, r)).alias(f"h{k}_{out}") for k, r in enumerate(ranks) for out in (True, False)])
    hubs = drawn.select("key", F.explode(F.array(*[c for c in drawn.columns if c != "key"])).alias("hub")).where("hub is not null").distinct()
    met = rows.join(hubs.select("key", "hub.*").select("key", *[F.col(c).alias(f"h_{c}") for c in ["id", "own", "outside", "n", *BITMAP]]), "key")
    near = met.where("own <> h_own and (outside or h_outside)").where(alike("", "h_", percent))
    return materialize(near.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b"), (F.col("n") + F.col("h_n")).alias("both")).distinct())


def open_pairs(rows: DataFrame, percent: int, bands: bool = False) -> DataFrame:
    """The pairs ``(a, b, both)`` of a bucket's lines that lie in different components and may be linked.

    The lines outside the hub's component are dealt into blocks, each of which meets all lines of the bucket in a
    task of its own, by their bitmaps; with ``bands`` only pairs that share a band come up, where a bucket is of another key.
    """
    left = rows.where("outside").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.select("block", *[F.col(c).alias(f"l_{c}") for c in rows.columns])
    right = rows.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("r_block", *[F.col(c).alias(f"r_{c}") for c in rows.columns])
    cond = (
        (F.col("l_key") == F.col("r_key"))
        & (F.col("block") == F.col("r_block"))
        & (F.col("l_own") != F.col("r_own"))
        & (~F.col("r_outside") | (F.col("l_id") < F.col("r_id")))
        & alike("l_", "r_", percent)
    )
    if bands:
        cond = cond & reduce(lambda x, y: x | y, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in KEYS])
    return materialize(left.join(right, cond).select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), (F.col("l_n") + F.col("r_n")).alias("both")).distinct())


def joined(labels: DataFrame, pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``labels`` after the links among ``pairs``; what it replaces is released, as are the pairs."""
    links = confirm(pairs, texts, percent)
    if links.isEmpty():
        merged = labels
    else:
        edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        merged = materialize(connected_components(edges, "a", "b"))
        release(labels)
    release(pairs, links)
    return merged


def crowd_rows(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The :func:`opened` lines of ``crowd(id, own, ..)``, stored, each with all its columns under those of its rarest shingles that a
    linked line must share with it as ``key``.

    Of two sets with ``percent`` % of their union in common each has at least that share of its own shingles in common. So if
    all lines order their shingles alike, the first that are too many to be left out contain a shared one; no link is lost.
    The order is by the number of the crowds' lines that have a shingle, so lines of one pattern that differ in their own parts meet
    only where these parts are the same. Each step gives at most a row for each shingle of a line.
    """
    ids = broadcast_if_small(crowd, crowd.count()).select(F.col("id").alias("line_id"))
    cut = shingles_of(texts.join(ids, "line_id", "left_semi"), "bare", "hashes")
    mine = cut.select(F.col("line_id").alias("id"), F.explode(F.array_distinct("hashes")).alias("h"))
    often = F.count(F.lit(1)).over(Window.partitionBy("h"))
    placed = mine.select("id", F.struct(often.alias("often"), "h").alias("place"))
    ranked = placed.groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    n = F.size("places").cast("long")
    first = F.slice("places", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
    keys = ranked.select("id", F.filter(first, lambda p: p["often"] > 1).alias("places")).join(crowd, "id")
    return materialize(opened(keys.select(F.explode("places.h").alias("key"), *crowd.columns), 2))


def line_classes(bare: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(name_a, name_b, class_a, class_b)``, stored, of the lines of ``bare(name_a, name_b, bare)`` that are linked with another one or
    stand several times: the least name, as hex digits, of the lines that links connect."""
    signed = materialize(line_signatures(bare).withColumn("line_id", F.monotonically_increasing_id()))
    keys = signed.select(F.explode(F.array(*KEYS)).alias("key"), F.col("line_id").alias("id"))
    members = members_of(keys)
    named_ids = materialize(members.select(F.col("id").alias("line_id")).distinct())
    n = named_ids.count()
    named = signed.select("line_id", *NAME).join(broadcast_if_small(named_ids, n), "line_id", "left_semi")
    once = bare if n <= MAX_BROADCAST_ROWS else bare.distinct()  # so that the copies of a hot line aren't shuffled
    texts, bitmaps = lines_named(once.join(broadcast_if_small(named, n), NAME).select("line_id", "bare"))
    few = bitmaps.count() <= MAX_BITMAPS
    small = F.broadcast(bitmaps) if few else bitmaps
    side = lambda k: small.select(F.col("line_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ["n", *BITMAP]])
    tried = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    met = tried.join(side("b"), "b").join(side("a"), "a").where(alike("a_", "b_", percent))
    pairs = materialize(met.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("both")))
    links = confirm(pairs, texts, percent)
    labels = materialize(connected_components(links, "a", "b"))
    release(pairs, links)
    rows = open_rows(members, labels, bitmaps, few)
    labels = joined(labels, star_pairs(rows, percent), texts, percent)
    release(rows)
    rows = open_rows(members, labels, bitmaps, few)
    pairs = open_pairs(rows.where(f"open <= {CROWD}"), percent)
    ids = rows.where(f"open > {CROWD}").select("id", "own", "n", *BITMAP).distinct()
    crowd = materialize(signed.select(F.col("line_id").alias("id"), *KEYS).join(ids, "id"))
    if not crowd.isEmpty():
        mild, close = pairs, crowd_rows(crowd, texts, percent)
        more = open_pairs(close, percent, bands=True)
        pairs = materialize(mild.unionByName(more).distinct())
        release(mild, close, more)
    labels = joined(labels, pairs, texts, percent)
    release(rows, crowd)
    release(members, named_ids, texts, bitmaps)
    few = broadcast_if_small(labels, labels.count(), MAX_LINKED).withColumnRenamed("node", "line_id")
    # as hex digits names are in the order of their longs without sign
    digits = F.struct(*[F.col(c).bitwiseXOR(F.lit(-1 << 63)).alias(c) for c in NAME])
    known = signed.select("line_id", "copies", *NAME).join(few, "line_id", "left").where("component is not null or copies > 1")
    known = materialize(known.select(*NAME, F.coalesce("component", "line_id").alias("component"), F.col("component").isNotNull().alias("linked")))
    least = known.where("linked").groupBy("component").agg(F.min(digits).alias("least")).select("component", *[F.col(f"least.{c}").bitwiseXOR(F.lit(-1 << 63)).alias(f"class{c[4:]}") for c in NAME])
    classed = known.join(least, "component", "left") if known.count() > MAX_LINKED else known.join(F.broadcast(least), "component", "left")
    out = materialize(classed.select(*NAME, *[F.coalesce(f"class{c[4:]}", c).alias(f"class{c[4:]}") for c in NAME]))
    release(labels, known, signed)
    return out


def line_duplicates(documents: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, line_id, class_id, kept)``, one row for each line of each document.

    ``line_id`` is the name of 128 bits of the bare line (see :func:`bare_line`); ``class_id``, the least of them, names the component of lines
    that similarities of ``percent`` % or more of their character shingles connect; of each class the first line by
    document and number is kept. Blank lines have neither id nor class and are kept. Null texts give no row; in rows with a
    null id the lines come last. Rows that repeat a document repeat its lines, and the first of equal rows stays for all.
    """
    lines = materialize(named_lines(lines_of(documents, doc_id, text)))
    known = line_classes(lines.where("bare <> ''").select(*NAME, "bare"), percent)
    few = known.count() <= MAX_LINKED
    place, row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no"), ["doc_id", "line_no"]
    named = lines.select(*row, F.struct(*NAME).alias("name"))
    of_class = known.select(F.struct(*NAME).alias("name"), F.struct(*CLASS).alias("class"))
    inside = named.where("name.name_a is not null")
    inside = inside.join(F.broadcast(of_class), "name") if few else spread_join(inside, of_class, "name", by=row)
    first = materialize(inside.groupBy("class").agg(F.min(place).alias("first")))
    firsts = of_class.join(F.broadcast(first) if few else first, "class")
    out = named.join(F.broadcast(firsts), "name", "left") if few else spread_join(named, materialize(firsts), "name", "left", row)
    digits = lambda name, of: F.when(F.col(of).isNotNull(), hex_name([F.col(f"{of}.{c}") for c in name]))
    out = out.select(*row, "first", "class", computed(digits(NAME, "name")).alias("line_id"))
    return out.select(
        *row,
        "line_id",
        F.coalesce(digits(CLASS, "class"), "line_id").alias("class_id"),
        (F.col("first").isNull() | place.eqNullSafe(F.col("first"))).alias("kept"),
    )


def without_duplicate_lines(documents: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)``: each document's text from its kept lines; null where the text is null.

    Ids must be unique and not null for this form; else a ValueError is raised.
    """
    odd = documents.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not odd.isEmpty():
        raise ValueError("document ids must be unique and not null")
    kept = line_duplicates(documents, percent, doc_id, text).where("kept").select("doc_id", "line_no")
    lines = lines_of(documents, doc_id, text).join(kept, ["doc_id", "line_no"])
    joined = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    texts = joined.select("doc_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    had = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).isNotNull().alias("had"))
    return had.join(texts, "doc_id", "left").select("doc_id", F.when(F.col("had"), F.coalesce("text", F.lit(""))).alias("text"))
