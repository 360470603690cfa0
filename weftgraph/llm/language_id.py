"""Language identification by string kernels.

Kernel: the blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where
G(x) is the set of n-grams of 1 to ``ORDER`` symbols of the whole text x. Landmarks (Nystrom): a few
training texts per language; a text is mapped to its kernel values against them, whitened by the
landmarks' own kernel matrix. One ridge regression per language against the rest is solved in that
space. Scoring is a batched matrix product: presence rows (texts by n-grams of the landmarks) times
the landmarks' presence matrix times the weights, the latter two multiplied beforehand.

Symbols: a text is lower-cased; each of the ``LETTERS`` most frequent letters of the training texts
is a symbol, other letters share one, and a run of anything else is one blank.

Training rows are a bounded sample: of each language, up to ``TRAIN_ROWS`` rows of at most
``TRAIN_BYTES`` bytes with the smallest hashes of their ids (both bounds are parameters); a language's
row count decides the hash range read, and each task passes on no more than that many rows of it. So
``TRAIN_ROWS`` rows a language reach the driver, however often an id is repeated. The model is some
megabytes whatever the corpus.

Results: the language of the largest ridge value, its softmax share as the score, and how much of the
text is known: the share of its n-grams that some landmark holds. Unlike the score, that does not
depend on how many languages were learned.

Scale: one narrow pass; only the sample reaches the driver. A batch's memory is bounded by
``BATCH`` texts.

Defined cases: null, or no letter: ``und`` with score 0; without any labelled row all texts are
``und``; repeated rows are each returned; a null id is never in training and not held out; an empty
table gives an empty result; other columns are ignored (or carried, if asked for).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from weftgraph.llm.common import fresh

TRAIN_ROWS, TRAIN_BYTES = 250, 100_000
LANDMARKS = 48
LETTERS, ORDER = 62, 3
RIDGE = 1e-3
BATCH = 128
UNKNOWN = "und"
#: Symbols: 0 for a blank, 1 to LETTERS for letters, the last for any other letter.
BASE = LETTERS + 2
CODES = sum(BASE**n for n in range(1, ORDER + 1))


@dataclass
class Model:
    languages: list[str]
    letters: str
    columns: np.ndarray  # by n-gram code: its column, or -1
    weights: np.ndarray  # n-grams of the landmarks by languages
    shift: np.ndarray


def symbol_table(letters: str) -> np.ndarray:
    """Symbol by code point; other letters get theirs when they are met."""
    table = np.zeros(0x110000, np.uint8)
    for k, c in enumerate(letters):
        table[ord(c)] = k + 1
    return table


class Grams:
    """Presence of n-grams, text by text."""

    def __init__(self, letters: str) -> None:
        self.table = symbol_table(letters)
        self.met = np.zeros(0x110000, bool)
        self.met[[ord(c) for c in letters]] = True
        self.seen = np.zeros(CODES, np.int64)
        self.offsets = np.cumsum([0, *(BASE**n for n in range(1, ORDER))])

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = points[~self.met[points]]
        for p in set(fresh.tolist()):
            self.met[p] = True
            if chr(p).isalpha():
                self.table[p] = LETTERS + 1
        s = self.table[points].astype(np.int64)
        if len(s) > 1:
            s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        return s

    def codes(self, text: str) -> np.ndarray:
        """The distinct n-gram codes of the text; none if it has no letter."""
        s = self.symbols(text)
        if not s.any():
            return np.zeros(0, np.int64)
        found, grams = [s], s
        for n in range(2, ORDER + 1):
            if len(s) < n:
                break
            grams = grams[: len(s) - n + 1] * BASE + s[n - 1 :]
            found.append(grams + self.offsets[n - 1])
        every = np.concatenate(found)
        place = np.arange(len(every))
        self.seen[every] = place  # the last place of each code stays
        return every[self.seen[every] == place]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> list[tuple[str, str]]:
    """(text, language) of up to ``most`` rows of each language, those with the smallest id hashes."""
    part = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_000))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), part.alias("part"))
    usable = given.where((F.octet_length("text") <= TRAIN_BYTES) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) != 2))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("part") < min(1_000_000, int(1_300_000 * most / n) + 1)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("part", "id", "text"))
    rows = sorted((r.lang, r.part, r.id, r.text) for r in usable.where(wanted).withColumn("nth", nth).where(F.col("nth") <= most).collect())
    kept: dict[str, list[str]] = {}
    for lang, _, _, text in rows:
        if len(kept.setdefault(lang, [])) < most and any(c.isalpha() for c in text):
            kept[lang].append(text)
    return [(text, lang) for lang, texts in kept.items() for text in texts]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    tally: dict[str, int] = {}
    for text, _ in rows:
        for c in text.lower():
            if c.isalpha():
                tally[c] = tally.get(c, 0) + 1
    letters = "".join(sorted(sorted(tally, key=lambda c: (-tally[c], c))[:LETTERS]))
    grams = Grams(letters)
    codes = [grams.codes(text) for text, _ in rows]
    chosen = [i for lang in languages for i in [k for k, (_, x) in enumerate(rows) if x == lang][:landmarks]]
    columns = np.full(CODES, -1, np.int32)
    known = np.unique(np.concatenate([codes[i] for i in chosen]))
    columns[known] = np.arange(len(known))

    def presence(which):
        out = np.zeros((len(which), len(known)), np.float32)
        for row, i in enumerate(which):
            at = columns[codes[i]]
            out[row, at[at >= 0]] = 1 / np.sqrt(len(codes[i]))
        return out

    marks = presence(chosen)
    own = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # K^(-1/2) of the landmarks
    features = np.concatenate([presence(range(at, min(at + 200, len(rows)))) @ marks.T for at in range(0, len(rows), 200)]) @ whiten
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    mean, shift = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(rows) * np.eye(centred.shape[1]), centred.T @ (target - shift))
    weights = (marks.T.astype(np.float64) @ (whiten @ solved)).astype(np.float32)
    return Model(languages, letters, columns, weights, shift - mean @ solved)


def ridge_values(model: Model, grams: Grams, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The value of each language for each text, whether the text has a letter, and the share of its n-grams that are known."""
    rows = np.zeros((len(texts), len(model.weights)), np.float32)
    sure, known = np.zeros(len(texts), bool), np.zeros(len(texts))
    for k, text in enumerate(texts):
        found = grams.codes(text) if text else ()
        if len(found):
            sure[k] = True
            at = model.columns[found]
            at = at[at >= 0]
            rows[k, at], known[k] = 1 / np.sqrt(len(found)), len(at) / len(found)
    return rows @ model.weights + model.shift, sure, known


def predictor(model: Model | None, text_at: int, names: list[str]):
    def score(grams: Grams, texts: list[str | None]) -> tuple[list, list, list]:
        values, sure, known = ridge_values(model, grams, texts)
        share = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = values.argmax(axis=1)
        rows = range(len(texts))
        return (
            [model.languages[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)],
            [float(share[k, best[k]]) if sure[k] else 0.0 for k in rows],
            known.tolist(),
        )

    def run(batches):
        grams = Grams(model.letters) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                n = part.num_rows
                found = score(grams, part.column(text_at).to_pylist()) if model else ([UNKNOWN] * n, [0.0] * n, [0.0] * n)
                extra = [pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*batch.schema.names, *names])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    return fit(training_rows(docs, id_col, text_col, lang_col, rows))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, and their names: language, score and share known; all its own columns stay."""
    names = fresh(docs, "lang_pred", "score", "known")
    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], DoubleType())
    return docs.mapInArrow(predictor(model, docs.columns.index(text_col), names), schema), names


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, (lang, score, _) = identify(docs.select("doc_id", "text"), train(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return seen.select("doc_id", held_out.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
