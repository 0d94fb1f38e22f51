"""SimHash near-duplicates: fingerprints, a range join over per-segment bit counts, and components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.words import map_batches
from quarry.session import materialize

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
BITS = 64
#: Shingles whose bits are counted at a time; bounds memory for texts of any length.
CHUNK = 1 << 16
#: Points of a grid cell that one task compares with one another; larger cells are split.
CELL = 1 << 13
#: Wide fingerprints: blocks of 64 bits, bands of cells by three blocks each, words of which the distance is taken, hashes
#: drawn out at a time, and points of a cell of which all pairs are measured.
BLOCKS, BANDS, POINT, STEP, CROWD = 192, 128, 3, 512, 512


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the XXH64 hashes of its word shingles.

    A-Z are lower-cased; words are runs without ASCII white space; repeated shingles count each time. A text of fewer
    words is one shingle; a null, empty or blank text has fingerprint 0.
    """
    found = (text or b"").translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        spans = zip(starts[lo : min(n, lo + CHUNK)].tolist(), ends[lo : lo + CHUNK].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (signed 64 bits): one row for each row of docs, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(ids, run, "id long, fp long")


def _set_bits(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of words have each bit set; rows are added three at a time, as sums and carries."""
    planes = []
    while len(rows):
        carries = []
        while len(rows) > 1:
            third = max(1, len(rows) // 3)
            a, b, c = (rows[k * third : (k + 1) * third] for k in range(3))
            either, both = a ^ b, a & b
            if len(c):  # all but the last two
                both |= either & c
                either ^= c
            carries.append(both)
            rows = np.concatenate([either, rows[3 * third :]])
        planes.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    total = np.zeros(rows.shape[1] * BITS, np.int64)
    for k, plane in enumerate(planes):
        total += np.unpackbits(plane.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << k
    return total


def margins(hashes: np.ndarray) -> np.ndarray:
    """BLOCKS rows of 64 numbers: for each bit of a wide fingerprint how many hashes set it less how many don't.

    Each 64-bit hash is drawn out to BLOCKS words by the finalizer of SplitMix64. A text's hashes are taken as they come,
    so for a set of shingles they are to be distinct.
    """
    total = np.zeros(BLOCKS * BITS, np.int64)
    for lo in range(0, len(hashes), STEP):
        z = hashes[lo : lo + STEP, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, BLOCKS + 1, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        total += _set_bits(z)
    return (2 * total - len(hashes)).reshape(BLOCKS, BITS)


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """The first POINT words of the wide fingerprint, signed: a bit is 1 if over half of the hashes set it."""
    return np.packbits(found[:POINT] > 0, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def sure_cells(found: np.ndarray) -> np.ndarray:
    """BANDS cells of a wide fingerprint: each is the place and value of the surest bit of three of its blocks.

    The surest bit is that with the largest margin, the first of equal ones; it is the last that a change of some shingles
    turns over. Any two bands share one block at most.
    """
    sure = np.abs(found).argmax(axis=1)
    code = 2 * sure + (found[np.arange(BLOCKS), sure] > 0)
    third, cells = BLOCKS // 3, []
    at = np.arange(third)
    for a, b in ((0, 0), (5, 17)):
        cells.append((code[at] << 14) + (code[third + (at + a) % third] << 7) + code[2 * third + (at + b) % third])
    return np.concatenate(cells) + (np.arange(BANDS) << 21)


def radius(similarity: float) -> int:
    """The distance of the first POINT words that sets of that Jaccard similarity keep within, by six standard deviations.

    Sets of similarity s have a cosine of 2s / (1 + s) at least, and a bit differs with the chance of their angle over pi.
    """
    chance, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, POINT * BITS
    return min(bits, math.ceil(bits * chance + 6 * math.sqrt(bits * chance * (1 - chance))))


def wide_links(placed: DataFrame, max_distance: int) -> DataFrame:
    """u, v: edges that connect the points of placed(cell, s0, s1, s2) that share a cell and lie within max_distance.

    A point is known by its first word. Only a spanning forest of a task's links leaves it. A cell of over CROWD points
    is not measured: all its points are connected with the least, so it is read as a stream, and proposes too much at most.
    A group of near copies shares many cells, so what each of its points is linked with is connected to the least of them.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, words, crowded = np.zeros(0, np.int32), np.zeros((0, POINT), np.uint64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            more = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).view(np.uint64)
            words = np.concatenate([words, more])
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield out(cell[:whole], words[:whole], crowded)
                cell, words, crowded = cell[whole:], words[whole:], False
            if len(cell) > CROWD:
                yield out(cell, words, True)
                cell, words, crowded = cell[:1], words[:1], True
        yield out(cell, words, crowded)

    def out(cell: np.ndarray, words: np.ndarray, crowded: bool) -> pa.RecordBatch:
        """Links of whole cells; crowded: the first goes on from a batch before."""
        _, first, which, n = np.unique(cell, return_index=True, return_inverse=True, return_counts=True)
        large = n > CROWD
        large[:1] |= crowded
        some = large[which]
        left, right = [words[first[which[some]], 0]], [words[some, 0]]
        some = ~some & (n[which] > 1)
        cell, words = cell[some], words[some]
        at, step = np.arange(len(cell)), 1
        while len(at := at[at + step < len(cell)]):
            at = at[cell[at] == cell[at + step]]
            near = at[np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1) <= max_distance]
            left.append(words[near, 0])
            right.append(words[near + step, 0])
            step += 1
        u, v = forest(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Connects each point, and the others that it is linked with, to the least of these only."""
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip((u, v), batch.columns))
            whole = int(np.searchsorted(u, u[-1])) if len(u) else 0  # the last point may go on in the next batch
            if whole:
                yield least(u[:whole], v[:whole])
                u, v = u[whole:], v[whole:]
        if len(u):
            yield least(u, v)

    def least(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        point, first, which = np.unique(u, return_index=True, return_inverse=True)
        to = np.minimum.reduceat(v, first)
        other = v != to[which]
        pairs = np.unique(np.stack([np.concatenate([point, v[other]]), np.concatenate([to, to[which[other]]])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    dealt = placed.select("cell", "s0", "s1", "s2").repartition("cell").sortWithinPartitions("cell", "s0")
    found = map_batches(dealt, meet, "u long, v long").distinct()
    return map_batches(found.repartition("u").sortWithinPartitions("u"), gather, "u long, v long")


def bit_counts(fps: np.ndarray, segments: int = 32) -> np.ndarray:
    """The embedding: for each fingerprint the number of set bits in each of its segments of 64 / segments bits."""
    width = BITS // segments
    shifts = np.arange(0, BITS, width, dtype=np.uint64)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << width) - 1))


def cell_keys(counts: np.ndarray, max_distance: int, groups: int, base: int) -> np.ndarray:
    """Grid cells of each embedded point, one column for each choice of groups - max_distance groups of segments.

    The Manhattan distance of two points is at most the Hamming distance of their fingerprints. Points within
    max_distance differ in at most so many groups of segments, so in some choice all coordinates agree: they share
    that cell. The cell is its coordinates, written in the given base, beside the number of the choice.
    """
    parts = np.array_split(np.arange(counts.shape[1]), groups)
    columns = []
    for number, choice in enumerate(combinations(range(groups), groups - max_distance)):
        key = np.full(len(counts), number, np.uint64)
        for axis in np.concatenate([parts[g] for g in choice]):
            key = key * np.uint64(base) + counts[:, axis]
        columns.append(key.view(np.int64))
    return np.stack(columns, axis=1)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links a-b connect: each node but the least of its component, and that least one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]
        if (label == before).all():
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]


def _cell_links(keys: np.ndarray, fps: np.ndarray, max_distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints sorted by cell: Manhattan bound first, then the exact Hamming distance.

    Pairs of a cell are met one offset at a time and never held together.
    """
    left, right = [], []
    at, step = np.arange(len(keys) - 1), 1
    while len(at := at[at + step < len(keys)]):
        at = at[keys[at] == keys[at + step]]
        x, y = fps[at], fps[at + step]
        near = np.abs(bit_counts(x, segments).astype(np.int8) - bit_counts(y, segments)).sum(axis=1) <= max_distance
        x, y = x[near], y[near]
        exact = np.bitwise_count(x ^ y) <= max_distance
        left.append(x[exact])
        right.append(y[exact])
        step += 1
    return np.concatenate(left or [fps[:0]]), np.concatenate(right or [fps[:0]])


def links(points: DataFrame, max_distance: int = 3, segments: int = 32, groups: int = 6) -> DataFrame:
    """u, v: edges that connect exactly the fingerprints (column fp, distinct) that chains of near pairs connect.

    Each point goes to its C(groups, max_distance) grid cells, where all coordinates of so many groups agree; a cell's
    pairs are bounded by Manhattan distance and verified, and only a spanning forest of the links leaves a task, so a dense
    group yields a row for each of its points, not for each pair. A cell of more than CELL points is not met there: its
    points are dealt by hash into blocks of about CELL, and every two blocks of it meet in a task of their own. More
    groups make cells smaller for very many points, at the price of more copies.
    """
    base = BITS // segments + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = cell_keys(bit_counts(fps.view(np.uint64), segments), max_distance, groups, base)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], ["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0  # over: points of the last cell that were only counted
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
            if whole:
                yield out(keys[:whole], fps[:whole], over)
                keys, fps, over = keys[whole:], fps[whole:], 0
            if len(keys) > 2 * CELL:
                over, keys, fps = over + len(keys) - CELL - 1, keys[: CELL + 1], fps[: CELL + 1]
        yield out(keys, fps, over)

    def out(keys: np.ndarray, fps: np.ndarray, over: int) -> pa.RecordBatch:
        """Links of the cells up to CELL points; of larger ones a row with the cell and its number of points."""
        cells, first, n = np.unique(keys, return_index=True, return_counts=True)
        if over:
            n[0] += over  # held back from the batch before, so the first one
        large = n > CELL
        small = ~np.isin(keys, cells[large])
        u, v = forest(*_cell_links(keys[small], fps[small], max_distance, segments))
        none = np.zeros(large.sum(), bool)
        left, right = (np.concatenate([x.view(np.int64), y]) for x, y in ((u, cells[large]), (v, n[large])))
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(np.concatenate([np.ones(len(u), bool), none]))], ["u", "v", "link"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, fps = None, [], []
        for batch in batches:
            for key, side, fp in zip(zip(*(c.to_pylist() for c in batch.columns[:3])), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if key != now and now is not None:
                    yield linked(now, sides, fps)
                    sides, fps = [], []
                now = key
                sides.append(side)
                fps.append(fp)
        if now is not None:
            yield linked(now, sides, fps)

    def linked(key: tuple, sides: list[int], fps: list[int]) -> pa.RecordBatch:
        """Links inside one block, or between two, a row of them at a time."""
        x, side = np.array(fps, np.int64).view(np.uint64), np.array(sides)
        a, b = (x[side == k] for k in key[1:])
        of_a, of_b = (bit_counts(part, segments).astype(np.int8) for part in (a, b))
        left, right = [x[:0]], [x[:0]]
        for k, p in enumerate(a):
            lo = k + 1 if key[1] == key[2] else 0
            near = b[lo:][np.abs(of_b[lo:] - of_a[k]).sum(axis=1) <= max_distance]
            near = near[np.bitwise_count(near ^ p) <= max_distance]
            left.append(np.full(len(near), p))
            right.append(near)
            if len(left) > 256:
                u, v = forest(np.concatenate(left), np.concatenate(right))
                left, right = [u], [v]
        u, v = forest(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    cells = map_batches(points.select("fp"), place, "cell long, fp long")
    met = materialize(map_batches(cells.repartition("cell").sortWithinPartitions("cell"), meet, "u long, v long, link boolean"), "links")
    found, large = met.filter("link").select("u", "v"), met.filter("NOT link").select(F.col("u").alias("hot"), F.ceil(F.col("v") / CELL).alias("parts"))
    n = large.count()
    if not n:
        return found
    hot = cells.join(F.broadcast(large) if n <= BROADCAST_KEYS else large, F.col("cell") == F.col("hot"))
    sides = hot.withColumn("side", F.expr("pmod(xxhash64(fp), parts)")).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    blocks = sides.select("cell", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp")
    return found.unionByName(map_batches(blocks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b"), across, "u long, v long"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 3) -> DataFrame:
    """id, fp, component_id for every row of docs; component_id is the smallest id that links reach, itself included.

    Rows with equal fingerprints are gathered first, so copies cost nothing in the join however many there are.
    Null texts count as empty and link like others; a text of any length is read whole; a null id is never the smallest
    unless a component has no other; repeated ids and rows keep a row each; an empty table gives no rows; other columns of
    docs are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = connected_components(links(points, max_distance))
    linked = roots.join(points.withColumnRenamed("fp", "node"), "node")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(by_root, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    classes = points.join(by_fp, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(materialize(classes, "classes"), "fp").select("id", "fp", "component_id")


#: Keys of a drop list up to which it is broadcast, some 100 MB; beyond, texts are shuffled to meet it.
BROADCAST_KEYS = 1_000_000
#: Under these names a row has its id and 128 bits of its text's hash; rows alike in both are told apart by all columns.
KEY = ("_q_id", "_q_a", "_q_b")


def mark_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with KEY."""
    text = F.col(f"`{text_col}`")
    return docs.select("*", F.col(f"`{id_col}`").cast("long").alias("_q_id"), F.xxhash64(text).alias("_q_a"), F.xxhash64(F.lit(1), text).alias("_q_b"))


def _whole_row(docs: DataFrame) -> Column:
    """A hash over all columns; maps, which have no hash, by their text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def keep_least(docs: DataFrame, marked: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each component of roots(fp, root) one row of docs, by rows(KEY, fp); see keep_one.

    The keys that go are fewer than those that stay. Up to BROADCAST_KEYS they are sent to all tasks, and no text moves.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    best = F.min(F.struct(F.col("_q_id").isNull(), *KEY)).alias("best")
    keys = rows.groupBy(*KEY, "fp").agg(F.count("*").alias("_q_n"))
    placed = keys.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_fp = rows.groupBy("fp").agg(best)
    kept = by_fp.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = materialize(kept, "best")  # so that the join below deals out both sides, and a large group can be split
    same = [F.col(f"best.{k}").eqNullSafe(F.col(k)) for k in KEY]
    told = materialize(placed.join(kept, "root").select(*KEY, "_q_n", (same[0] & same[1] & same[2]).alias("stays")), "kept")

    def matched(table: DataFrame, condition: str, how: str) -> DataFrame:
        some = told.filter(condition).select(*[F.col(k).alias(f"{k}2") for k in KEY])
        some = F.broadcast(some) if some.count() <= BROADCAST_KEYS else some
        return table.join(some, F.col(KEY[0]).eqNullSafe(F.col(f"{KEY[0]}2")) & (F.col(KEY[1]) == F.col(f"{KEY[1]}2")) & (F.col(KEY[2]) == F.col(f"{KEY[2]}2")), how)

    left = matched(marked, "NOT stays", "left_anti")
    if not told.filter("stays AND _q_n > 1").limit(1).count():
        return left.select(*names)
    once = matched(left, "stays AND _q_n > 1", "left_anti").select(*names)
    again = matched(left, "stays AND _q_n > 1", "left_semi").groupBy(*KEY).agg(F.min_by(F.struct(*names), _whole_row(docs)).alias("row"))
    return once.unionByName(again.select("row.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays, with its columns as they are.

    Of several texts under that id the one of the least hash stays; of rows alike in id and text one, with the least hash
    over all columns. Null ids sort last. Null, empty and blank texts are copies of one another. A text of any length is
    read once; an empty table gives an empty one; columns may have any type and names but those that begin with _q_.
    """
    marked = mark_rows(docs, id_col, text_col)
    keyed = marked.select(*KEY, F.col(f"`{text_col}`").cast("binary").alias("_q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fps], [*KEY, "fp"])

    rows = materialize(map_batches(keyed, run, "_q_id long, _q_a long, _q_b long, fp long"), "fingerprints")
    points = materialize(rows.select("fp").distinct(), "points")
    roots = connected_components(links(points, max_distance)).withColumnRenamed("node", "fp")
    return keep_least(docs, marked, rows, roots)
