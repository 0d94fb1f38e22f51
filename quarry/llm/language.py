"""Language identification: a bidirectional recurrent network labels every byte; documents pool its probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.gru import BiGRU
from quarry.llm.words import map_batches
from quarry.session import materialize

UNKNOWN = "und"
#: Bytes of context that a window reads before and after the positions that it labels.
MARGIN = 16
#: Positions that a window labels: in training, and in prediction, where longer ones read less context again.
TRAINED, LABELLED = 64, 256
#: Windows that run through the network together.
BATCH = 2048
#: Lower-cases A-Z; ASCII that is no letter becomes a space. Bytes over 127 stay.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """All letters of a text in their order, with one space for anything between."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(LETTERS).split())


def has_letter(text: str | None) -> bool:
    """Whether a text has any letter of any script."""
    return any(map(str.isalpha, text or ""))


def padded(line: bytes, labelled: int) -> np.ndarray:
    """A normalised text between spaces, so that windows of so many labelled positions and their margins fit in."""
    return np.frombuffer(b" " * MARGIN + line + b" " * (MARGIN + labelled), np.uint8)


@dataclass
class Model:
    """A trained network and the languages that it tells apart; without a network, the one language learned, if any."""

    languages: list[str]
    network: BiGRU | None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text: its positions' probabilities, averaged; the largest mean decides.

        Every position of the normalised text is labelled once, by a window that reads MARGIN more bytes on both sides,
        across words. Windows of all texts run together, BATCH at a time, so a text of any length takes bounded memory.
        """
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(texts), max(1, len(self.languages))))
        todo: list[tuple[int, np.ndarray, int, int]] = []
        for i, text in enumerate(texts):
            if not has_letter(text) or not self.languages:
                continue
            if not self.network:
                langs[i], scores[i] = self.languages[0], 1.0
                continue
            line = normalised(text)
            if not line:
                continue
            array = padded(line, LABELLED)
            for at in range(0, len(line), LABELLED):
                todo.append((i, array, at, min(LABELLED, len(line) - at)))
                if len(todo) == BATCH:
                    self._pool(todo, sums)
                    todo = []
            langs[i], scores[i] = "", float(len(line))
        if todo:
            self._pool(todo, sums)
        for i, lang in enumerate(langs):
            if not lang:
                p = sums[i] / scores[i]
                best = int(p.argmax())
                langs[i], scores[i] = self.languages[best], float(min(1.0, max(0.0, p[best])))
        return langs, scores

    def _pool(self, todo: list[tuple[int, np.ndarray, int, int]], sums: np.ndarray) -> None:
        x = np.stack([array[at : at + LABELLED + 2 * MARGIN] for _, array, at, _ in todo])
        wanted = np.arange(LABELLED) < np.array([n for _, _, _, n in todo])[:, None]
        np.add.at(sums, [i for i, _, _, _ in todo], self.network.pooled(x, MARGIN, wanted))


def windows(line: bytes, n: int, seed: int) -> np.ndarray:
    """n windows of a normalised text for training, seeded; labelled positions may start anywhere in it."""
    array = padded(line, TRAINED)
    starts = np.random.default_rng(seed % (1 << 32)).integers(0, max(1, len(line) - TRAINED + 1), n)
    return array[starts[:, None] + np.arange(TRAINED + 2 * MARGIN)]


def bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = 300, windows_per_doc: int = 64, hidden: int = 8, steps: int = 300, batch: int = 96, seed: int = 0) -> Model:
    """A model from at most max_docs distinct texts of each language, windows_per_doc windows of each.

    train: a condition over docs that chooses the rows to learn from. The sample is that of the least hashes of the
    texts; equal texts count once, whatever number of copies there are, and a long text gives as many windows as a short
    one, from anywhere in it. So the driver gets max_docs * windows_per_doc windows of each language at most, and a count
    for each language. Null texts and languages, and texts without letters, are left out; ids only decide train.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.filter(train) if train is not None else rows
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    share = F.least(F.lit(1.0), F.lit(2.0 * max_docs) / F.col("n"))  # about twice max_docs of each, by hash: no sort of all
    limits = counts.select(F.col("lang").alias("l"), (share * float(1 << 62)).cast("long").alias("below"))
    likely = rows.join(F.broadcast(limits), F.col("lang") == F.col("l")).filter(F.pmod("h", F.lit(1 << 62)) <= F.col("below"))  # a row for each language

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # a task's copies of a text count once, here and below
        for part in batches:
            langs, hashes, found = [], [], []
            for lang, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if (lang, h) in seen:
                    continue
                seen.add((lang, h))
                line = normalised(text.as_py())
                if line and has_letter(text.as_py()):
                    langs.append(lang)
                    hashes.append(h)
                    found.append(windows(line, windows_per_doc, h).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["lang", "h", "windows"])

    drawn = map_batches(likely.select("lang", "h", "text"), draw, "lang string, h long, windows binary")
    once = drawn.groupBy("lang", "h").agg(F.first("windows").alias("windows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = once.withColumn("rank", rank).filter(F.col("rank") <= max_docs).select("lang", "h", "windows")
    sample = chosen.toPandas().sort_values(["lang", "h"])
    languages = sorted(sample.lang.unique())
    if len(languages) < 2:
        return Model(languages, None)
    x = np.frombuffer(b"".join(sample.windows), np.uint8).reshape(-1, TRAINED + 2 * MARGIN)
    y = np.searchsorted(languages, sample.lang.to_numpy(str)).repeat(windows_per_doc)
    own = [np.flatnonzero(y == k) for k in range(len(languages))]
    even = np.concatenate([np.resize(at, max(map(len, own))) for at in own])  # each language as often as any other
    network = BiGRU(hidden, len(languages), seed)
    network.train(x[even], y[even], steps, batch=batch, rate=0.03, seed=seed, margin=MARGIN)
    return Model(languages, network)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, score for every row of docs, from its whole text; und with score 0 where a text is null or has no letter.

    Empty texts are und too; a text of any length runs in windows, in bounded memory; ties go to the language that sorts
    first; repeated rows and ids keep a row each; an empty table gives no rows; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, lang string, score double")
