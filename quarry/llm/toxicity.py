"""Toxicity: boosted trees over dense lexical features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import boosting
from quarry.llm.words import map_batches
from quarry.session import materialize

#: Words that insult, threaten or demean, in the languages that the operator starts out with.
LEXICON = frozenset(
    """
    idiot idiots idiotic moron morons moronic stupid dumb fool fools foolish loser losers scum trash garbage filth filthy
    worthless pathetic disgusting clown clowns imbecile cretin dimwit halfwit jerk jerks bastard bastards bitch whore slut
    vermin parasite parasites pig pigs rat coward liar freak creep shit crap damn fuck fucking asshole retard hate kill die
    trottel dumm dummkopf arschloch scheisse scheiße abschaum müll wertlos erbärmlich widerlich schwein versager hure
    imbécile crétin débile connard salaud ordure minable dégoûtant dégueulasse merde pourriture pute
    idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil mierda cabrón puta payaso
    """.split()
)
#: Second-person forms of the same languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!|€", "oieastasile")
SYMBOLS = b"#*$%&|<>@^~_"
EDGE = " \t\n\"'.,;:!?()[]{}«»„“”‘’…¡¿*#$%&|<>~_^-"
WITHIN = re.compile(r"[^\W\d_][0-9@$!*#|€._-]+[^\W\d_]")
#: Words between an insult and a second-person form that count as near.
NEAR = 5
#: Parts of the sample for scores out of their own fold.
FOLDS = 5
#: Words whose class is remembered; beyond, the memory starts again.
REMEMBERED = 200_000
FEATURES = (
    "words", "listed", "listed_rate", "learned", "learned_rate", "stems", "stems_rate", "any_rate", "near_you", "you_rate", "hidden", "mixed_rate",
    "shouted_rate", "capital_rate", "exclaim_rate", "question_rate", "punctuation_rate", "symbol_rate", "digit_rate", "run_rate",
)
LISTED, LEARNED, STEM, YOU, HIDDEN, MIXED, SHOUTED = (1 << k for k in range(7))


@dataclass
class Lexicon:
    """What is learned about words: whole ones and stems of STEM_SIZES letters."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


STEM_SIZES = (4, 5)


def core(token: str) -> str:
    """A token without marks at its edges, in lower case."""
    return token.strip(EDGE).lower()


class _Classes(dict):
    """Bits of each token, remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        word, lexicon = core(token), self.lexicon
        bits = LISTED * (word in LEXICON) | LEARNED * (word in lexicon.words) | YOU * (word in SECOND_PERSON)
        if lexicon.stems and any(word[:k] in lexicon.stems for k in STEM_SIZES if len(word) > k):
            bits |= STEM
        if WITHIN.search(token):
            plain = re.sub(r"[*#|._-]", "", token.strip(" \t\n\"',;:?()[]").lower().translate(STAND_INS)).strip(EDGE)
            bits |= MIXED | HIDDEN * (plain in LEXICON or plain in lexicon.words)
        if len(word) > 2 and token.isupper():
            bits |= SHOUTED
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = bits
        return bits


def features(text: str | None, classes: _Classes) -> list[float]:
    """FEATURES of a whole text; null counts as empty, and an empty text has 0 everywhere."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(FEATURES)
    bits = np.frombuffer(bytes(map(classes.__getitem__, tokens)), np.uint8)
    n = len(tokens)
    listed, learned, stems, you, hidden, mixed, shouted = (int(np.count_nonzero(bits & b)) for b in (LISTED, LEARNED, STEM, YOU, HIDDEN, MIXED, SHOUTED))
    insult = np.flatnonzero(bits & (LISTED | LEARNED | STEM | HIDDEN))
    near = 0
    if you and len(insult):
        at = np.flatnonzero(bits & YOU)
        k = np.searchsorted(at, insult)
        gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - insult), np.abs(at[np.maximum(k - 1, 0)] - insult))
        near = int((gap <= NEAR).sum())
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    count = np.zeros(256, np.int64)
    for lo in range(0, size, 1 << 20):
        count += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, size - lo), lo), minlength=256)
    capitals, digits = count[65:91].sum(), count[48:58].sum()
    letters = max(1, capitals + count[97:123].sum() + count[192:].sum())
    symbols, marks = sum(count[b] for b in SYMBOLS), sum(count[b] for b in b".,;:!?'\"-()")
    return [
        float(np.log1p(n)), listed, listed / n, learned, learned / n, stems, stems / n, len(insult) / n, near, you / n,
        hidden, mixed / n, shouted / n, capitals / letters, count[33] / size, count[63] / size, marks / size, symbols / size, digits / size,
        (raw.count(b"!!") + raw.count(b"??")) / n,
    ]


@dataclass
class Model:
    """A fitted lexicon and calibrated trees."""

    lexicon: Lexicon
    trees: boosting.Boosted
    threshold: float = 0.5
    seen: dict[str, int] = field(default_factory=dict)

    def scores(self, texts: list[str | None], classes: _Classes) -> np.ndarray:
        """Probability that each text is toxic."""
        return self.trees.probability(np.array([features(t, classes) for t in texts]).reshape(-1, len(FEATURES)))


def terms(text: str | None) -> set[str]:
    """Words and stems of a text, as the lexicon may learn them; stems end in a star."""
    words = {w for w in map(core, set((text or "").split())) if len(w) > 2 and w.isalpha()}
    return words | {f"{w[:k]}*" for w in words for k in STEM_SIZES if len(w) > k}


def _term_counts(once: DataFrame) -> DataFrame:
    """term, t0, c0, t1, c1 and so on: how many toxic and other texts of each fold of once(text, toxic, fold) have a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "cell", "n"])

        for batch in batches:
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen.update((t, 2 * fold + toxic) for t in terms(text.as_py()))
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        yield out()

    found = map_batches(once.select("text", "toxic", "fold"), count, "term string, cell int, n long")
    each = [F.sum(F.when(F.col("cell") == 2 * k + toxic, F.col("n")).otherwise(0)).alias(f"{'ct'[toxic]}{k}") for k in range(FOLDS) for toxic in (0, 1)]
    return materialize(found.groupBy("term").agg(*each), "terms")


def _lexicon(counts: DataFrame, texts: dict[tuple[int, int], int], folds: list[int], least: int = 3, odds: float = 10.0, most: int = 5000) -> Lexicon:
    """Terms that at least `least` toxic texts of the folds have (and one in 150) and that are odds times as frequent there as elsewhere.

    The `most` telling ones, which bounds the model.
    """
    n1, n0 = (max(1, sum(texts.get((toxic, k), 0) for k in folds)) for toxic in (1, 0))
    t, c = (sum((F.col(f"{letter}{k}") for k in folds[1:]), F.col(f"{letter}{folds[0]}")) for letter in "tc")
    ratio = (F.col("t") / n1) / ((F.col("c") + 0.5) / n0)
    rows = counts.select("term", t.alias("t"), c.alias("c")).filter((F.col("t") >= max(least, n1 // 150)) & (ratio >= odds))
    names = [r.term for r in rows.orderBy(F.desc(F.col("t") * F.log(ratio)), "term").limit(most).collect()]
    return Lexicon(frozenset(t for t in names if t[-1] != "*"), frozenset(t[:-1] for t in names if t[-1] == "*"))


def bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = 4000) -> Model:
    """A model from labelled documents: at most max_rows of each label, those with the least hash of their id.

    train: a condition over labels that chooses the rows to learn from. Rows of a class weigh as many as it has in
    labels, so that probabilities are those of the whole. The sample is parted in FOLDS by its texts, so copies lie in one;
    a text's features come from the lexicon of the other folds, for the trees as well as for the calibration, which uses
    scores of trees that have not seen the text's fold. Equal texts count once in a lexicon, so that a text with many
    copies doesn't pass its own words off as a habit. An id labelled twice has the larger label, and of several texts under
    an id one counts. Null labels, ids and texts are left out; without rows of both labels every score is the share of
    label 1.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = chosen.filter(train) if train is not None else chosen
    ids = chosen.groupBy(F.col(id_col).cast("long").alias("_q_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).withColumn("h", F.xxhash64("_q_id"))
    ids = materialize(ids, "labels")
    every = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    parts = [ids.filter(F.col("toxic") == k).orderBy("h", "_q_id").limit(max_rows) for k in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * max_rows rows
    texts = docs.select(F.col(id_col).cast("long").alias("_q_key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    own = F.xxhash64("text")
    found = texts.join(picked, F.col("_q_key") == F.col("_q_id")).groupBy("_q_id", "toxic", "h").agg(F.min_by("text", own).alias("text"))
    sample = materialize(found.withColumn("fold", F.pmod(own, F.lit(FOLDS)).cast("int")), "sample")
    had = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(had) < 2:
        share = float(np.clip(every.get(1, 0) / max(1, sum(every.values())), 1e-3, 1 - 1e-3))
        return Model(Lexicon(), boosting.Boosted(float(np.log(share / (1 - share))), np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))))
    once = materialize(sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold")), "texts")
    sizes = {(r.toxic, r.fold): r["count"] for r in once.groupBy("toxic", "fold").count().collect()}
    counts = _term_counts(once)
    others = [_lexicon(counts, sizes, [j for j in range(FOLDS) if j != k]) for k in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [_Classes(lexicon) for lexicon in others]
        for batch in batches:
            rows = [features(x.as_py(), classes[k]) for x, k in zip(batch.column(0), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], ["toxic", "h", "fold", "x"])

    rows = map_batches(sample.select("text", "toxic", "h", "fold"), measure, "toxic int, h long, fold int, x array<double>").toPandas().sort_values(["h", "toxic"])
    x, y, fold = np.array(rows.x.tolist()), rows.toxic.to_numpy(float), rows.fold.to_numpy()
    weight = np.where(y == 1, every[1] / had[1], every[0] / had[0])
    weight /= weight.mean()
    trees = boosting.fit(x, y, weight)
    apart = trees.raw(x)
    for k in range(FOLDS):
        mine = fold == k
        if mine.any() and len(set(y[~mine])) == 2:
            apart[mine] = boosting.fit(x[~mine], y[~mine], weight[~mine]).raw(x[mine])
    trees.calibrate(apart, y, weight)
    return Model(_lexicon(counts, sizes, list(range(FOLDS))), trees)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every row of docs; null, empty and blank texts have the score of a text without words.

    A text of any length is read whole. Equal texts have equal scores; repeated rows and ids keep a row each; a score of
    just the threshold is toxic; an empty table gives no rows; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for batch in batches:
            p = model.scores([x.as_py() for x in batch.column(1)], classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= model.threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns, of any names; no shuffle of texts.

    Null, empty and blank texts, long ones, repeated rows and ties as in score(); an empty table gives an empty one.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for batch in batches:
            yield batch.filter(pa.array(model.scores([x.as_py() for x in batch.column(at)], classes) < model.threshold))

    return map_batches(docs, run, docs.schema)
