"""Benchmark decontamination: a prefix-filtered join of item windows with document shingles, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import bounds, hashes, map_batches, places, together
from quarry.session import materialize

#: Lower-cases A-Z; every ASCII byte that is no letter or digit becomes a space. Bytes over 127 stay.
FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bits of the Bloom filter that says which shingles a task need emit: 16 for each shingle, between these powers of two (8 KB to 32 MB).
LEAST_BITS, MOST_BITS = 16, 28
#: Rows of prefixes, and texts with hits, up to which the table is broadcast; beyond, Spark joins by a shuffle and splits hot keys.
BROADCAST_PREFIXES, BROADCAST_HITS = 200_000, 1_000_000
#: Texts that a task knows to have probed; five times as many shingles are held before their counts are given out.
REMEMBERED = 200_000
_BLANK = np.arange(256) == 32


@dataclass(frozen=True)
class Words:
    """The words of some UTF-8 texts, numbered through all of them.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased; an empty text has none.
    """

    folded: bytes
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: first word of each text, and the number of words
    owner: np.ndarray  #: text of each word

    def shingles(self, size: int) -> np.ndarray:
        """A hash for the shingle of so many words at each position where there is one, also across texts."""
        n = max(0, len(self.hashes) - size + 1)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = (h ^ self.hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those positions whose shingle lies in one text."""
        return at[self.owner[at] == self.owner[at + size - 1]]

    def text(self, lo: int, hi: int) -> bytes:
        """The words from one to another, with single spaces."""
        return b" ".join(self.folded[self.begins[lo] : self.ends[hi - 1]].split())


def words_in(texts: list[bytes]) -> Words:
    """Words of texts, all as arrays."""
    folded = b" ".join(texts).translate(FOLD)
    raw = np.frombuffer(folded, np.uint8)
    begins, ends = places(_BLANK[raw])
    first = bounds(texts, begins)
    return Words(folded, begins, ends, hashes(raw, begins, ends).view(np.uint64), first, np.repeat(np.arange(len(texts)), np.diff(first)))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter over shingle hashes, two bits each. It lets all of its shingles through, and few others."""

    bits: int
    table: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Positions of those hashes that may be in the filter."""
        at, mask, six = np.arange(len(h)), np.uint64((1 << self.bits) - 1), np.uint64(6)
        for shift in (0, 32):
            bit = h[at] >> np.uint64(shift) & mask
            at = at[(self.table[bit >> six] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def _filter(shingle_rows: DataFrame) -> Filter:
    """The filter of a table (shingle). Its words are put together in tasks; the driver gets 2 ** MOST_BITS bits at most."""
    n = shingle_rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    mask = (1 << bits) - 1
    bit = F.explode(F.array(F.expr(f"shingle & {mask}L"), F.expr(f"shiftrightunsigned(shingle, 32) & {mask}L")))
    words = shingle_rows.select(bit.alias("bit")).groupBy(F.expr("bit >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("value")).toPandas()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[words.word.to_numpy(np.int64)] = words.value.to_numpy(np.int64).view(np.uint64)
    return Filter(bits, table)


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """item, run, n, shingles: a row for each distinct window of each item, as its words and the hashes of its shingles.

    A window is a run of `window` consecutive words; a shorter item that has words is one window.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_in([text.as_py() or b""])
                n = len(found.hashes)
                if not n:
                    continue
                size = min(window, n)
                part = min(shingle, size)
                h = found.shingles(part).view(np.int64)
                seen, rows = set(), ([], [], [], [])
                for i in range(n - size + 1):
                    run = found.text(i, i + size)
                    if run not in seen:
                        seen.add(run)
                        for column, value in zip(rows, (item, run.decode("utf-8", "replace"), size, h[i : i + size - part + 1].tolist())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["item", "run", "n", "shingles"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(items, cut, "item string, run string, n long, shingles array<long>")


def _frequencies(rows: DataFrame, wanted: Broadcast, sizes: list[int]) -> DataFrame:
    """shingle, n: in how many rows(text) the shingles that the filter lets through occur; counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for texts in together(text.as_py() or b"" for text in batch.column(0)):
                words = words_in(texts)
                for size in sizes:
                    h = words.shingles(size)
                    at = words.inside(wanted.value.passes(h), size)
                    own = h[at] ^ words.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # a shingle counts once a text
                    found.append(h[at[np.unique(own, return_index=True)[1]]])
                    held += len(found[-1])
                if held > 5 * REMEMBERED:
                    yield out(found)
                    found, held = [], 0
        yield out(found)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return map_batches(rows.select("text"), count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(runs: DataFrame, frequency: DataFrame) -> DataFrame:
    """shingle, offset, n, run: each window of runs(run, n, shingles) under the one of its shingles that fewest documents have.

    Exact containment needs every shingle of a window, so one, the rarest, is prefix enough. A window with a shingle
    that no document has occurs nowhere and is left out.
    """
    places = runs.select("run", "n", F.posexplode("shingles").alias("offset", "shingle"))
    counted = places.join(frequency.withColumnRenamed("n", "times"), "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "shingle")).alias("r")
    chosen = counted.groupBy("run", "n").agg(rarest).filter("r.times > 0")
    return chosen.select("r.shingle", F.col("r.offset").cast("long").alias("offset"), "n", "run")


def _probed(rows: DataFrame, wanted: Broadcast, sizes: list[int], window: int) -> DataFrame:
    """A row (id, a, b, n_words) for each of rows(id, a, b, text), and one for each place of a shingle that the filter lets through.

    Places have `at`, the shingle and the words around it, as many as a window that it stands for can take; `first` is the
    position of the first of them. A text that the task has just probed gives its places once.
    """
    names = ["id", "a", "b", "n_words", "at", "shingle", "first", "around"]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, done = list(zip(*(c.to_pylist() for c in batch.columns[:3]))), 0
            for texts in together(text.as_py() or b"" for text in batch.column(3)):
                words = words_in(texts)
                own = keys[done : done + len(texts)]
                done += len(texts)
                found = [(*key, n, None, None, None, None) for key, n in zip(own, np.diff(words.first).tolist())]
                new = []
                for _, a, b in own:
                    new.append((a, b) not in seen)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((a, b))
                for size in sizes:
                    h = words.shingles(size)
                    for k in words.inside(wanted.value.passes(h), size).tolist():
                        which = int(words.owner[k])
                        if new[which]:
                            begin, end = int(words.first[which]), int(words.first[which + 1])
                            lo = max(begin, k - window + size)
                            around = words.text(lo, min(end, k + window)).decode("utf-8", "replace")
                            found.append((None, *own[which][1:], end - begin, k - begin, int(h[k].view(np.int64)), lo - begin, around))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*found)), kinds)], names)

    return map_batches(rows.select("id", "a", "b", "text"), probe, "id long, a long, b long, n_words long, at long, shingle long, first long, around string")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with 128 bits of their text's hash: _q_a, _q_b."""
    text = F.col(f"`{text_col}`")
    return docs.select("*", F.xxhash64(text).alias("_q_a"), F.xxhash64(F.lit(1), text).alias("_q_b"))


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_id_col: str, item_text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(id, a, b, n_words) of all documents, hits(a, b, start, end, run), distinct, of texts in which windows occur, and items(run, item)."""
    marked = _marked(docs, text_col)
    key = F.col(f"`{id_col}`") if id_col else F.lit(None)
    rows = marked.select(key.cast("long").alias("id"), F.col("_q_a").alias("a"), F.col("_q_b").alias("b"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    spark = docs.sparkSession
    items = materialize(windows_of(benchmark, item_id_col, item_text_col, window, shingle), "windows")
    runs = materialize(items.groupBy("run", "n").agg(F.first("shingles").alias("shingles")), "runs")
    sizes = sorted(min(shingle, r.n) for r in runs.select(F.least("n", F.lit(shingle)).alias("n")).distinct().collect())  # 1 to shingle
    every = spark.sparkContext.broadcast(_filter(runs.select(F.explode("shingles").alias("shingle")).distinct()))
    frequency = materialize(_frequencies(rows, every, sizes), "frequencies")
    chosen = materialize(prefixes(runs, frequency), "prefixes")
    few = chosen.count() <= BROADCAST_PREFIXES
    rare = spark.sparkContext.broadcast(_filter(chosen.select("shingle").distinct()))
    probed = materialize(_probed(rows, rare, sizes, window), "probed")

    prefix = chosen.withColumnRenamed("shingle", "p")
    places = probed.filter("at IS NOT NULL").select("a", "b", "n_words", "at", "shingle", "first", "around")
    met = places.join(F.broadcast(prefix) if few else prefix, F.col("shingle") == F.col("p")).withColumn("start", F.expr("at - offset"))
    met = met.filter("n <= n_words AND start >= 0 AND start + n <= n_words")  # length and positional bounds
    same = F.expr("array_join(slice(split(around, ' '), cast(start - first + 1 AS int), cast(n AS int)), ' ') = run")
    hits = met.filter(same).select("a", "b", "start", F.expr("start + n").alias("end"), "run").distinct()
    return probed.filter("at IS NULL").select("id", "a", "b", "n_words"), materialize(hits, "hits"), items.select("run", "item")


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """id, n_words, spans (start and end of hit windows in words), items (sorted ids): one row for each row of docs.

    Two passes over the documents, whatever the size of the benchmark: one counts the shingles of its windows, which
    orders them by rarity, one emits the places of the windows' rarest shingles, and these meet the windows in a join.
    Equal texts meet once. Null and wordless texts have no words and no hits, however long; items without words hit
    nothing; an item with a null id marks words but is not listed; repeated items and rows count as they stand; ties in
    rarity go to the first shingle; an empty benchmark leaves every row clean; an empty table gives no rows; other columns
    may have any names but those that begin with _q_.
    """
    rows, hits, owners = _hits(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window, shingle)
    spans = F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    hits = hits.join(owners, "run")
    found = materialize(hits.groupBy("a", "b").agg(spans, F.array_sort(F.collect_set("item")).alias("items")), "found").select(F.col("a").alias("x"), F.col("b").alias("y"), "spans", "items")
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS // 50 else found  # rows with lists
    joined = rows.join(found, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)")
    return joined.select("id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of docs in which no item window occurs, with all their columns.

    Texts with hits are looked up by 128 bits of hash; up to BROADCAST_HITS of them no text is shuffled. Edge cases as in
    scan(): rows without words stay, whether null, empty or blank.
    """
    _, hits, _ = _hits(docs, benchmark, None, text_col, item_id_col, item_text_col, window, shingle)
    gone = hits.select(F.col("a").alias("_q_x"), F.col("b").alias("_q_y")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_HITS else gone
    kept = _marked(docs, text_col).join(gone, (F.col("_q_a") == F.col("_q_x")) & (F.col("_q_b") == F.col("_q_y")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def covered(spans: list[tuple[int, int]]) -> int:
    """How many positions sorted spans cover."""
    total, end = 0, 0
    for a, b in spans:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total
