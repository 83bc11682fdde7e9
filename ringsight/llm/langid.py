"""Language ID with string kernels.

The kernel of two texts is the cosine of the sets of character n-grams (n = 1..3,
blended) that they hold, presence only. Nyström landmarks map a text to its
kernels with a few training texts, times the inverse root of the landmarks' own
kernel matrix; one-versus-rest kernel ridge regression is then linear in that map.
Texts are scored in batches: a 0/1 matrix of n-gram buckets times the landmarks'
matrix gives the kernels, those times the coefficients give the scores.

Bounded sample: the model is fitted on the PER_LANGUAGE labelled rows of each
language that have the least hash of doc_id, on fewer of each where all languages
together would have over ROWS; no language is left out. Landmarks, MARKS in all or
one a language, are drawn from these. All other work covers all rows. Executors read
the sampled texts; the driver gets their sets as bits, BUCKETS / 8 bytes a row, 100 MB
in all at most, and landmarks are sent to the workers as bits too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ringsight.llm.bpe import blocks
from ringsight.llm.common import read

BUCKETS, ORDERS, PER_LANGUAGE, ROWS, LANDMARKS, MARKS, RIDGE = 1 << 15, (1, 2, 3), 400, 25_600, 32, 2048, 1e-3
#: Code points that are read at once; longer texts are read in parts that overlap.
PART = 1 << 20
UNKNOWN = "und"


def _lower_table() -> np.ndarray:
    """Code point -> lower-case code point; everything but letters and marks becomes a blank. 0 stands for astral ones."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low[0])
    return out


class Presence:
    """Text -> sorted array of the n-gram buckets it holds."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.table = buckets, _lower_table()

    def __call__(self, text: str) -> np.ndarray:
        seen = np.zeros(self.buckets, bool)
        for at in range(0, max(1, len(text) - 2), PART):
            part = f" {text[at : at + PART + 2]} "
            code = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            code = np.where(code < 0x10000, self.table[np.minimum(code, 0xFFFF)], code)
            code = code[(code != 32) | (np.roll(code, 1) != 32)]  # runs of blanks count once
            gram = np.zeros(len(code), np.uint32)
            for n in ORDERS:
                if len(code) < n:
                    break
                gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x9E3779B1)
                seen[((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(self.buckets)] = True
        return np.flatnonzero(seen)

    def packed(self, text: str) -> bytes:
        """The set as bits."""
        row = np.zeros(self.buckets, np.uint8)
        row[self(text)] = 1
        return np.packbits(row).tobytes()

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """0/1 matrix of the texts, and the sizes of their sets."""
        x = np.zeros((len(texts), self.buckets), np.float32)
        for row, t in zip(x, texts, strict=True):
            row[self(t)] = 1
        return x, np.maximum(x.sum(1), 1)


def unpacked(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of packed sets, and their sizes."""
    x = np.unpackbits(np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1), axis=1).astype(np.float32)
    return x, np.maximum(x.sum(1), 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


class Model:
    """Landmark matrix and coefficients of the one-versus-rest ridge regressions.

    ``sets`` are the packed sets of the training texts. A pickled model holds its landmarks as bits.
    """

    def __init__(self, sets: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        landmarks = max(1, min(landmarks, MARKS // max(1, len(self.langs))))
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0) if langs else np.zeros((0, 0))
        self.bits = [sets[i] for lang in self.langs for i in [k for k, x in enumerate(langs) if x == lang][:landmarks]]
        self.expand()
        own = self.kernels(*unpacked(self.bits)) if self.bits else np.zeros((0, 0))
        val, vec = np.linalg.eigh(own.astype(np.float64)) if self.bits else (np.zeros(0), np.zeros((0, 0)))
        val, vec = val[val > 1e-6], vec[:, val > 1e-6]
        root = vec / np.sqrt(val) if self.bits else vec
        phi = np.concatenate([np.hstack([self.kernels(*unpacked(sets[i : i + 256])) @ root, np.ones((len(sets[i : i + 256]), 1))]) for i in range(0, len(sets), 256)]) if sets else np.zeros((0, 1))
        weight = 1.0 / np.array([langs.count(x) for x in langs]) if langs else np.zeros(0)
        gram = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
        beta = np.linalg.solve(gram, phi.T @ (y * weight[:, None])) if langs else np.zeros((1, 0))
        self.alpha, self.bias = (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    def expand(self) -> None:
        if self.bits:
            x, size = unpacked(self.bits)
            self.marks = (x / np.sqrt(size)[:, None]).T.copy()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "marks"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.expand()

    def kernels(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return x @ self.marks / np.sqrt(size)[:, None]

    def scores(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.kernels(x, size) @ self.alpha + self.bias


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> DataFrame:
    """text and lang of at most per_language rows of each language, those with the least hash of doc_id; of ``rows`` in all, but one of each at least."""
    ok = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = ok.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return ok.select("text", "lang").limit(0)
    per_language = max(1, min(per_language, rows // len(counts)))
    key = F.xxhash64(F.col("doc_id")).cast("double") / float(1 << 64) + 0.5
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (3 * per_language + 20) / r["n"] + 1e-12)))])
    few = ok.withColumn("_k", key).filter(F.coalesce(F.col("_k") <= F.try_element_at(share, F.col("lang")), F.lit(False)))
    w = Window.partitionBy("lang").orderBy("_k", "doc_id", "text")
    return few.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_language).select("text", "lang")


def packed_sets(sample: DataFrame) -> DataFrame:
    """lang and bits, the packed set, of the rows of ``sample`` (text, lang) that have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Presence()
        for batch in batches:
            for block in blocks(batch):
                rows = [(lang, make.packed(t)) for t, lang in zip(block.column("text").to_pylist(), block.column("lang").to_pylist(), strict=True) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "bits"])

    return sample.select("text", "lang").mapInArrow(run, "lang string, bits binary")


def fit(docs: DataFrame) -> Model:
    """Fit on the bounded sample of docs (doc_id, text, lang); rows without text, letters or language teach nothing."""
    rows = sorted((r["lang"], bytes(r["bits"])) for r in packed_sets(training_sample(docs)).collect())
    order = np.random.default_rng(7).permutation(len(rows))
    return Model([rows[i][1] for i in order], [rows[i][0] for i in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus lang_pred and score, which replace columns of these names; only the text is looked at.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. The score is half of one plus the lead over the second language, cut to 0..1.
    """
    spark, docs = docs.sparkSession, docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    held = spark.sparkContext.broadcast(model)  # landmarks times buckets, whatever the corpus
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, make = held.value, Presence()
        for batch in batches:
            for block in blocks(batch):
                for at in range(0, block.num_rows, 256):
                    part = block.slice(at, 256)
                    texts = part.column("text").to_pylist()
                    known = [i for i, t in enumerate(texts) if has_letter(t)] if m.langs else []
                    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                    if known:
                        s = m.scores(*make.matrix([texts[i] for i in known]))
                        top = s.argmax(1)
                        lead = np.sort(s, 1)
                        lead = lead[:, -1] - lead[:, -2] if s.shape[1] > 1 else np.ones(len(s))
                        for i, k in zip(known, top, strict=True):
                            pred[i] = m.langs[k]
                        score[known] = np.clip((1 + lead) / 2, 0, 1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def bucket() -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(bucket() != 1).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", (bucket() == 1).alias("held_out"), "text"), model).drop("text")
