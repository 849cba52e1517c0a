"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize, release, spread_join

#: Words of a seed, and of the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of benchmark text up to which it is broadcast with an index; the seeds of a larger one are joined in a shuffle.
MOST_BYTES = 32 << 20
#: Bits, as a power of two, of the bitmap of a large benchmark's seeds that all tasks get: 16 MB, whatever the benchmark.
FILTER_BITS = 27
CACHED = 100_000

WORD = re.compile(r"\w+")
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


WORDS = WordHashes()


def text_tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased; punctuation and spaces don't count."""
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(WORDS.__getitem__, found), np.uint64, len(found))


class Running:
    """Running Karp-Rabin hashes of a token array: one pass sums up the prefixes, and then the windows of any width
    come from two of them. The windows of the start ``k`` are told apart from their place by the inverse of the base."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        turns = np.full(n + 1, INVERSE, np.uint64)
        turns[0] = 1
        forth = np.full(n + 1, BASE, np.uint64)
        forth[0] = 1
        self.back, forth = np.cumprod(turns, dtype=np.uint64), np.cumprod(forth, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * forth[:n], dtype=np.uint64)])

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all windows of ``width`` tokens."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[width:] - self.sums[:n]) * self.back[:n]
        h ^= h >> np.uint64(31)
        return h * MIX


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` tokens."""
    return Running(tokens).windows(width)


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """For each window whether no token of it is marked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[width:] == total[:-width]


def _longest_at(item: np.ndarray, text: np.ndarray, p: int, starts: np.ndarray, item_marked, text_marked, width: int) -> tuple[int, int]:
    """Length and start of the longest unmarked match of ``item[p:]`` with the text at one of ``starts``."""
    length, best = width, -1
    alive = starts[[np.array_equal(item[p : p + width], text[t : t + width]) for t in starts]]
    while len(alive):
        best = int(alive[0])
        if p + length >= len(item) or item_marked[p + length]:
            break
        on = alive[alive + length < len(text)]
        on = on[(text[on + length] == item[p + length]) & ~text_marked[on + length]]
        if not len(on):
            break
        alive, length = on, length + 1
    return (length, best) if best >= 0 else (0, -1)


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start in item, start in text, length)`` of the tiles of greedy string tiling by running Karp-Rabin.

    Windows of unmarked tokens of both sides are matched by their rolling hashes, first long ones and then shorter
    ones down to ``least``; of the maximal matches at each width the longest are marked first, and no token is
    marked twice. So passages are found in whatever order they stand.
    """
    item_marked, text_marked = np.zeros(len(item), bool), np.zeros(len(text), bool)
    found: list[tuple[int, int, int]] = []
    width = min(len(item), len(text))
    of_item, of_text = Running(item), Running(text)
    while width >= least:
        again = True
        while again:
            again = False
            mine = np.flatnonzero(_free(item_marked, width))
            theirs = np.flatnonzero(_free(text_marked, width))
            if not len(mine) or not len(theirs):
                break
            hashes = of_text.windows(width)[theirs]
            order = np.argsort(hashes, kind="stable")
            hashes, theirs = hashes[order], theirs[order]
            keys = of_item.windows(width)[mine]
            low, high = np.searchsorted(hashes, keys, "left"), np.searchsorted(hashes, keys, "right")
            matches = []
            for p, a, b in zip(mine.tolist(), low.tolist(), high.tolist(), strict=True):
                if a < b:
                    length, t = _longest_at(item, text, p, np.sort(theirs[a:b]), item_marked, text_marked, width)
                    if length:
                        matches.append((-length, p, t))
            for length, p, t in sorted(matches):
                length = -length
                if item_marked[p : p + length].any() or text_marked[t : t + length].any():
                    again = True  # part of it may still be free
                    continue
                item_marked[p : p + length] = True
                text_marked[t : t + length] = True
                found.append((p, t, length))
        if width == least:
            break
        width = max(least, width // 2)
    return sorted(found)


class Items:
    """Benchmark items of one block with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], coverage: float, least: int = LEAST):
        self.least, self.coverage = least, coverage
        tokens = [(i, text_tokens(t)) for i, t in rows]
        self.tokens = [(i, t) for i, t in tokens if len(t) >= least]
        # an item of fewer words than a seed is its own seed, and is matched whole
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, t in tokens:
            if 0 < len(t) < least:
                self.short.setdefault(len(t), {}).setdefault(int(rolling(t, len(t))[0]), []).append(i)
        seeds = [rolling(t, least) for _, t in self.tokens]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.own = seeds

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """``(item, its words, words tiled, tiles, coverage)`` of the items that the text covers enough."""
        words = text_tokens(text)
        if not len(words):
            return []
        running, out = Running(words), []
        for width, known in self.short.items():
            for h in np.intersect1d(running.windows(width), np.fromiter(known, np.uint64, len(known))).tolist():
                out += [(i, width, width, 1, 1.0) for i in known[h]]
        if len(words) < self.least or not len(self.seeds):
            return out
        grams = np.unique(running.windows(self.least))
        low = np.searchsorted(self.seeds, grams, "left")
        hit = grams[self.seeds[np.minimum(low, len(self.seeds) - 1)] == grams]
        if not len(hit):
            return out
        low, high = np.searchsorted(self.seeds, hit, "left"), np.searchsorted(self.seeds, hit, "right")
        candidates = sorted({int(k) for a, b in zip(low, high, strict=True) for k in self.owner[a:b]})
        for k in candidates:
            item, tokens = self.tokens[k]
            within = np.zeros(len(tokens) + 1, np.int64)  # a tile lies within the seeds that both sides have
            for p in np.flatnonzero(np.isin(self.own[k], hit)):
                within[p] += 1
                within[p + self.least] -= 1
            if (np.cumsum(within)[:-1] > 0).sum() < self.coverage * len(tokens):
                continue
            parts = tiles(tokens, words, self.least)
            tiled = sum(n for _, _, n in parts)
            if tiled >= self.coverage * len(tokens):
                out.append((item, len(tokens), tiled, len(parts), tiled / len(tokens)))
        return out


FOUND = "doc_id long, item_id long, item_words long, tiled_words long, tiles long, coverage double"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
NAMES = ["doc_id", "item_id", "item_words", "tiled_words", "tiles", "coverage"]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _items_of(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """``(item, item_text)``, the distinct items with a text, and the bytes of all their texts."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("item_text")).where("item_text is not null")
    return rows.distinct(), rows.agg(F.sum(F.octet_length("item_text"))).head()[0] or 0


def _broadcast_items(items: DataFrame, coverage: float):
    """The index of a benchmark whose size was measured, sent to all tasks."""
    rows = [(r["item"], r["item_text"]) for r in items.orderBy("item", "item_text").collect()]
    return items.sparkSession.sparkContext.broadcast(Items(rows, coverage))


def seed_keys(words: np.ndarray, width: int) -> np.ndarray:
    """The seeds of ``width`` words as signed numbers; those of different widths are different."""
    return (rolling(words, width) ^ (np.uint64(width) * BASE)).view(np.int64)


def item_seeds(items: DataFrame, coverage: float) -> DataFrame:
    """``(item_mark, seed, width)``: of each item the seeds of which a text that covers it must have one.

    Tiles that cover ``coverage`` of n words contain at least ``coverage * n / 5`` of its n - 4 seeds, so all but one
    fewer than that are enough to meet each such text; those that most items have are left out. Items of fewer than five words
    have a single seed of their own width.
    """

    def seeds(batches):
        for batch in batches:
            parts = []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text_tokens(text.as_py())
                if len(words):
                    width = min(LEAST, len(words))
                    keys = seed_keys(words, width)
                    need = max(1, int(np.ceil(coverage * len(words) / LEAST - 1e-9)))
                    same = np.array([mark, width, max(1, len(keys) - need + 1)], np.int64)
                    parts.append(np.vstack([keys, np.arange(len(keys)), np.repeat(same[:, None], len(keys), 1)]))
            flat = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=["seed", "place", "item_mark", "width", "enough"])

    rows = materialize(items.select("item_mark", "item_text").mapInArrow(seeds, "seed long, place long, item_mark long, width long, enough long"))
    spread = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("known"))
    ranked = spread_join(rows, spread, "seed", "inner", ["item_mark", "place"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item_mark").orderBy("known", "seed", "place"))
    )
    out = materialize(ranked.where("rank <= enough").select("item_mark", "seed", "width").distinct())
    release(rows)
    return out


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits in which the leading bits of each seed are set; made in tasks, of a fixed size."""
    word = F.shiftrightunsigned("seed", 64 - bits + 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 AS int))")
    got = seeds.groupBy(word).agg(F.bit_or(bit).alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def _passing(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The distinct keys whose bit is set in the bitmap."""
    at = np.unique(keys).view(np.uint64) >> np.uint64(64 - (len(bitmap).bit_length() - 1 + 6))
    return np.unique(keys)[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]


def candidates(docs: DataFrame, items: DataFrame, coverage: float, bits: int = FILTER_BITS) -> DataFrame:
    """``(mark, item_mark)``: the pairs of a document of ``docs(mark, text)`` and an item that share one of the item's seeds.

    Seeds of documents that no item can have are dropped in the task by a bitmap; the others are joined in a shuffle,
    in which seeds of very many documents are dealt to several tasks.
    """
    seeds = item_seeds(items, coverage)
    widths = [r["width"] for r in seeds.select("width").distinct().collect()]  # at most five numbers
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, bits))

    def run(batches):
        for batch in batches:
            marks, keys = [], []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text_tokens(text.as_py())
                for width in widths:
                    got = _passing(seed_keys(words, width), shared.value)
                    keys.append(got)
                    marks.append(np.full(len(got), mark, np.int64))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (marks, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=["mark", "seed"])

    met = materialize(docs.select("mark", "text").mapInArrow(run, "mark long, seed long"))
    out = materialize(spread_join(met, seeds.select("seed", "item_mark"), "seed", "inner", ["mark"]).select("mark", "item_mark").distinct())
    release(seeds, met)
    return out


def joined_contamination(docs: DataFrame, items: DataFrame, coverage: float, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of :func:`contamination` and their ``mark``, for ``docs(doc_id, text)`` and a benchmark of any size: candidates
    from a join of seeds, each of which is then tiled in the tasks that have both texts."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text").where("text is not null")
    items = items.select("item", F.xxhash64("item", "item_text").alias("item_mark"), "item_text")
    pairs = candidates(docs, items, coverage, bits)
    half = materialize(spread_join(pairs, items, "item_mark", "inner", ["mark"]))
    release(pairs)
    both = spread_join(half, docs, "mark", "inner", ["item_mark"]).select("mark", "doc_id", "text", "item", "item_text")

    def run(batches):
        index = lru_cache(256)(lambda item, text: Items([(item, text)], coverage))
        for batch in batches:
            got = []
            for mark, doc, text, item, item_text in zip(*[batch.column(k) for k in range(5)], strict=True):
                found = index(item.as_py(), item_text.as_py()).matches(text.as_py())
                got += [(mark.as_py(), doc.as_py(), *m) for m in found]
            yield _batch(got, [pa.int64(), *KINDS], ["mark", *NAMES])

    return both.mapInArrow(run, f"mark long, {FOUND}")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, item_words, tiled_words, tiles, coverage)``: a row for each document and benchmark item
    of which the document's tiles cover at least ``coverage``.

    A document is tiled against the items with which it shares enough seeds of five words. A benchmark of up to ``most_bytes``
    goes to all tasks with an index of its seeds, and the join is map only; the seeds of a larger one are joined in a
    shuffle. Both ways give the same rows. Whole texts are taken. Null and empty texts match nothing; items of fewer than
    five words match where they stand whole; repeated rows of documents give repeated rows, repeated items count once.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items, size = _items_of(benchmark, item_id, item_text)
    if size > most_bytes:
        return joined_contamination(docs, items, coverage).drop("mark")
    shared = _broadcast_items(items, coverage)

    def run(batches):
        for batch in batches:
            yield _batch([(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in shared.value.matches(t.as_py())], KINDS, NAMES)

    return docs.mapInArrow(run, FOUND)


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """The rows of ``documents`` that cover no benchmark item (see :func:`contamination`), with all their columns."""
    items, size = _items_of(benchmark, item_id, item_text)
    if size > most_bytes:
        # a text is named by its hash here, which stands in for the id too
        named = documents.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")).where("text is not null").distinct()
        gone = materialize(joined_contamination(named, items, coverage).select(F.col("doc_id").alias("gone_id")).distinct())
        return documents.join(gone, F.xxhash64(documents[text]) == gone["gone_id"], "left_anti")
    shared = _broadcast_items(items, coverage)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
