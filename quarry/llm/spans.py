"""Substring dedup: every run of several consecutive sentences is hashed; later copies of a run lose its sentences."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.simhash import LOWER
from quarry.llm.words import BYTE_FACTOR, Powers, bounds, hashes, map_batches, places, together
from quarry.session import materialize

#: A sentence ends after . ! or ? before white space or the end, and at a line end: flags of the bytes that make an end, that may follow, and that part words.
_MARK, _AFTER, _BLANK = (np.isin(np.arange(256), list(which)) for which in (b".!?", b" \t\r\n", b" \t\n\v\f\r"))
#: Words of a sentence at most that is not cut.
LONGEST = 16
#: A longer one is cut before each word whose rank is the least among so many words on both sides.
NEAR = 4
#: A run has at least so many sentences and so many words.
SENTENCES, WORDS = 2, 20
#: The sentences of a run are less; it is no longer than its least sentences or words.
PLACE = 1 << 20
#: Factors of the polynomials over words, and what mixes their values; any odd numbers would do.
_FACTORS = (0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F)
_MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


_POWERS = [Powers(x) for x in _FACTORS]


def cuts(ranks: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Positions of words, given with their sentences, before which these are cut: a rank that none of the NEAR before and after is below.

    A word meets words of its own sentence only. What lies further away has no say, so a passage is cut alike wherever
    it stands, but for NEAR words at its edges.
    """
    least = np.ones(len(ranks), bool)
    for k in range(1, min(NEAR, len(ranks) - 1) + 1):
        apart = sentence[k:] != sentence[:-k]
        least[k:] &= (ranks[k:] <= ranks[:-k]) | apart
        least[:-k] &= (ranks[:-k] <= ranks[k:]) | apart
    return np.flatnonzero(least)


@dataclass
class Split:
    """Some texts in words and sentences, numbered through all of them."""

    rank: np.ndarray  #: of each lower-cased word
    starts: np.ndarray  #: first word of each sentence
    first: np.ndarray  #: first sentence of each text, and the number of sentences
    words: np.ndarray  #: words of each text


def split(texts: list[bytes]) -> Split:
    """Texts in words and sentences; blank sentences are left out.

    Linear in the texts; bytes, words and sentences of all of them are worked on as arrays, not one by one.
    """
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    begins, stops = places(_BLANK[raw])
    rank = hashes(np.frombuffer(joined.translate(LOWER), np.uint8), begins, stops)
    first = bounds(texts, begins)
    if not len(begins):
        return Split(rank, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.diff(first))
    number = np.searchsorted(_ends(raw), begins, side="right")  # of the sentence that a word is in, blank ones counted
    starts = np.append(0, np.flatnonzero(number[1:] != number[:-1]) + 1)
    size = np.diff(starts, append=len(begins))
    if size.max() > LONGEST:
        inside = np.flatnonzero(np.repeat(size > LONGEST, size))
        starts = np.union1d(starts, inside[cuts(rank[inside], number[inside])])
    return Split(rank, starts, np.searchsorted(starts, first), np.diff(first))


def _ends(raw: np.ndarray) -> np.ndarray:
    """Positions just after which a sentence of a text's bytes ends."""
    after = np.append(_AFTER[raw[1:]], True)
    return np.flatnonzero((raw == 10) | _MARK[raw] & after) + 1


def sentences(text: bytes) -> tuple[list[tuple[int, int]], list[list[bytes]]]:
    """Byte span and lower-cased words of each sentence, blank ones left out.

    A sentence that isn't cut reaches from the end of the one before to its own; one that is, from word to word.
    """
    words, starts = text.translate(LOWER).split(), split([text]).starts
    begins = places(_BLANK[np.frombuffer(text, np.uint8)])[0].tolist()
    ends = [0, *_ends(np.frombuffer(text, np.uint8)).tolist(), len(text)]
    edges, spans = [*starts.tolist(), len(words)], []
    for lo, hi in zip(edges, edges[1:]):
        k = bisect_right(ends, begins[lo])  # the end before the first word, and the one after the last
        whole = lo == 0 or ends[k - 1] > begins[lo - 1]
        last = bisect_right(ends, begins[hi - 1])
        own = hi == len(words) or ends[last] <= begins[hi]
        spans.append((ends[k - 1] if whole else begins[lo], ends[last] if own else begins[hi]))
    return spans, [words[lo:hi] for lo, hi in zip(edges, edges[1:])]


def run_hashes(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the words from lo to hi, by their ranks."""
    out = []
    for powers, mixer in zip(_POWERS, _MIXERS):
        w = rank.view(np.uint64) * np.uint64(mixer)
        w = (w ^ w >> np.uint64(29)) * np.uint64(mixer)
        h = powers.sums(w ^ w >> np.uint64(32), lo, hi)
        h ^= h >> np.uint64(31)  # high bits depend on all bits of the words, low ones on low bits only
        out.append(h * np.uint64(mixer))
    return out


def runs(texts: Split, least_sentences: int, least_words: int) -> tuple[np.ndarray, ...]:
    """Text, first sentence in it, length, two hashes, and whether the text has had it before, of each run that is the shortest one from its first or to its last sentence.

    So the sentences of a repeated passage that has any such run are covered from its first whole one to its last.
    """
    n, total = len(texts.starts), np.append(texts.starts, len(texts.rank))
    owner = np.repeat(np.arange(len(texts.words)), np.diff(texts.first))
    lowest, highest = texts.first[owner], texts.first[owner + 1]
    firsts = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + least_words), firsts + least_sentences)
    begins = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1, firsts + 1 - least_sentences)
    code = np.unique(np.concatenate([(firsts * (n + 1) + ends)[ends <= highest], (begins * (n + 1) + firsts + 1)[begins >= lowest]]))
    first, end = code // (n + 1), code % (n + 1)
    one, two = run_hashes(texts.rank, total[first], total[end])
    own = owner[first]
    _, at, inverse = np.unique(one + own.astype(np.uint64) * np.uint64(BYTE_FACTOR), return_index=True, return_inverse=True)
    at = at[inverse]
    seen = (at < np.arange(len(code))) & (two == two[at]) & (own == own[at])
    return own, first - texts.first[own], end - first, one, two, seen


def mark_of(text: bytes) -> int:
    """31 bits that tell texts under one id apart."""
    return xxhash.xxh32_intdigest(text) >> 1


def _occurrences(rows: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """hash, key, place, tag: one row for each different run of each row(key, text), where the text has it first.

    place holds the first sentence and the number of sentences, in one number; tag holds 31 bits of the run's other hash
    and the text's mark. So 95 bits tell runs apart. A text that repeats runs of its own has one more row, without a hash:
    `own` holds the sentences that the later occurrences cover, which go whatever other texts have.
    """
    names = ["hash", "key", "place", "tag", "own"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done = batch.column(0).to_numpy(zero_copy_only=False), 0
            for texts in together(text.as_py() or b"" for text in batch.column(1)):
                owner, first, length, one, two, seen = runs(split(texts), least_sentences, least_words)
                mark = np.array([mark_of(t) for t in texts])
                tag = (two >> np.uint64(33)).astype(np.int64) * (1 << 31) + mark[owner]
                new = ~seen
                columns = one.view(np.int64), keys[done + owner], first * PLACE + length, tag
                none = pa.nulls(int(new.sum()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[new], pa.int64()) for c in columns), none], names)
                yield again(owner[seen], first[seen], length[seen], keys[done:], mark)
                done += len(texts)

    def again(owner: np.ndarray, first: np.ndarray, length: np.ndarray, keys: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        """Rows of the texts that repeat their own runs, with the sentences that these cover."""
        at = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        covered = np.unique(np.repeat(owner, length) << 40 | at)  # text and sentence in one number
        which, start = np.unique(covered >> 40, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(covered)), pa.int32()), pa.array(covered & (1 << 40) - 1, pa.int64()))
        none = pa.nulls(len(which), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(keys[which], pa.int64()), none, pa.array(mark[which], pa.int64()), lists], names)

    return map_batches(rows, go, "hash long, key long, place long, tag long, own array<long>")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """id, mark, sentences, first_id: positions of the sentences that non-first repeated runs cover, and the least id where one is first.

    mark tells texts under one id apart; rows with the same id and text are one document. Documents without any are left
    out. Of a run's occurrences the first is that of the smallest id, of several texts under it that of the least mark, and
    of that the first in its text; all others lose the run's sentences. What a text repeats of itself is settled where it is
    read. Runs are counted map-side before they are dealt by hash, so a passage in a third of the rows gives one row a
    task; only occurrences of runs whose 64 bits repeat are joined, where Spark splits a hot one, and 31 more bits decide.
    Null ids and texts take no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("binary").alias("text")).filter("key IS NOT NULL")
    found = materialize(_occurrences(rows, least_sentences, least_words), "runs")
    check, mark = F.expr("tag div 2147483648").cast("int").alias("check"), F.expr("cast(pmod(tag, 2147483648L) as int)").alias("mark")
    different = found.filter("hash IS NOT NULL").select("hash", "key", "place", "tag")
    often = materialize(different.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash"), "often")
    same = materialize(different.join(often.hint("shuffle_hash"), "hash").select("hash", check, "key", mark, "place"), "repeated")
    first = F.min(F.struct("key", "mark")).alias("first")
    homes = materialize(same.groupBy("hash", "check").agg(F.count("*").alias("times"), first).filter("times > 1").select("hash", "check", "first"), "homes")
    later = same.join(homes.hint("shuffle_hash"), ["hash", "check"]).filter((F.col("key") != F.col("first.key")) | (F.col("mark") != F.col("first.mark")))
    own = found.filter("hash IS NULL").select("key", mark, F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("home"), "own")
    every = later.select("key", "mark", "place", F.col("first.key").alias("home"), F.lit(None).cast("array<long>").alias("own")).unionByName(own)
    by_text = every.groupBy(F.col("key").alias("id"), "mark").agg(F.collect_list("place").alias("places"), F.min("home").alias("home"), F.flatten(F.collect_list("own")).alias("own"))
    spread = F.expr(f"flatten(transform(places, p -> sequence(p div {PLACE}, p div {PLACE} + p % {PLACE} - 1)))")
    return by_text.select("id", "mark", F.array_sort(F.array_distinct(F.concat(spread, "own"))).alias("sentences"), F.coalesce("home", "id").alias("first_id"))


def remove(text: bytes, positions: list[int], spans: list[tuple[int, int]] | None = None) -> bytes:
    """A text without the sentences at those positions; what is between the others stays."""
    gone, parts, end = set(positions), [], 0
    for k, (a, b) in enumerate(sentences(text)[0] if spans is None else spans):
        if k in gone:
            parts.append(text[end:a])
            end = b
    return b"".join(parts) + text[end:]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS,
          changed_only: bool = False) -> DataFrame:
    """id, text, n_sentences, n_removed, n_words, n_kept_words, words_sha256, first_id for every row of docs.

    text is what is left without repeated spans; words_sha256 the digest of its lower-cased words, joined by spaces.
    changed_only leaves out the rows that lose nothing. Null texts stay null; they, empty and blank texts have no
    sentences. Rows with a null id stay as they are. Rows with the same id and text are one document and fare alike; other
    texts under one id are documents of their own. Ties of ids are settled as in repeated(). A text of any length is read
    once from start to end; an empty table gives no rows; other columns of docs are not read.
    """
    gone = materialize(repeated(docs, id_col, text_col, least_sentences, least_words), "spans")
    gone = gone.select(F.col("id").alias("_q_id"), F.col("mark").alias("_q_mark"), "sentences", "first_id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    by_id = gone.groupBy("_q_id").agg(F.collect_list(F.struct("_q_mark", "sentences", "first_id")).alias("lost"))  # a text each under the id
    joined = rows.join(by_id, F.col("id") == F.col("_q_id"), "inner" if changed_only else "left").select("id", "text", "lost")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            counts = (n for texts in together(text.as_py() or b"" for text in batch.column(1)) for n in np.diff(split(texts).first).tolist())
            for key, text, losses, n in zip(batch.column(0), batch.column(1), batch.column(2), counts):
                raw, marked = text.as_py(), losses.as_py() or ()
                mark = mark_of(raw or b"") if marked else None
                lost, first = next(((set(x["sentences"]), x["first_id"]) for x in marked if x["_q_mark"] == mark), (set(), None))
                if changed_only and not lost:
                    continue
                words = (raw or b"").translate(LOWER).split()
                left, kept = raw, words
                if lost:
                    spans, parts = sentences(raw)
                    left = remove(raw, list(lost), spans)
                    kept = [w for k, part in enumerate(parts) if k not in lost for w in part]
                out.append((key.as_py(), left, n, len(lost), len(words), len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), first))
            columns = [list(c) for c in zip(*out)] or [[] for _ in names]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([arrays[0], arrays[1].cast(pa.string()), *arrays[2:]], names)

    names = ["id", "text", "n_sentences", "n_removed", "n_words", "n_kept_words", "words_sha256", "first_id"]
    return map_batches(joined, go, "id long, text string, n_sentences long, n_removed long, n_words long, n_kept_words long, words_sha256 string, first_id long")
