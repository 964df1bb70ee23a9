"""Language identification by hyperdimensional profiles.

Every letter (and one symbol for what lies between words) has a random vector of +1 and
-1. A trigram binds its letters: the product of the first vector rotated twice, the second
rotated once and the third. A text bundles its trigrams: their sum, scaled to length one. A
language's prototype bundles the texts of that language, and a text goes to the prototype
with the greatest cosine.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import held_out, text_of, unused, written

DIMENSIONS = 1024
SEED = 20_24
NONE = "und"
#: Texts whose vectors are formed together, and the code points that such a batch may hold.
BATCH_TEXTS, BATCH_CHARS = 64, 1_000_000
#: Texts of so many trigrams or more are judged by their cosine; the noise of a cosine has a deviation of 0.03, so less text says too little.
MIN_TRIGRAMS = 128
#: Such a text is of no learned language if its cosine is below this share of the least that any such labelled text has with its own language,
#: or within so many deviations of the noise.
SHARE_OF_LEAST, DEVIATIONS = 0.5, 2.0

#: What lies between words: all but letters (Unicode category L) and the marks on them (M).
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Texts of Latin characters only, where no mark stands alone and the faster pattern cuts alike.
_LATIN = re.compile("[\x00-\u024f]*")
_LATIN_GAP = re.compile("[\\W\\d_²³¹¼-¾]+")


def words_only(text: str) -> str:
    """The lower-cased text with one space for all that lies between words; empty without a letter."""
    text = text.lower()
    if _LATIN.fullmatch(text):
        return _LATIN_GAP.sub(" ", text).strip()
    return _GAP.sub(" ", text).strip() if _LETTER.search(text) else ""


class Encoder:
    """Vectors of texts; keeps the letters' vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed, self.letters = dimensions, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        """A row for each packed trigram: its three letters permuted by place and bound."""
        parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        out = None
        for turn, part in zip((2, 1, 0), parts):
            used, at = np.unique(part, return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), turn) for c in used])[at]
            out = rows if out is None else out * rows
        return out

    @staticmethod
    def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams of the lower-cased text, and how often each occurs; none if it has no letter."""
        plain = words_only(text)
        if not plain:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        c = np.frombuffer(f" {plain} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """A row of length one for each text; zeros for a text without letters."""
        return self.vectors_and_evidence(texts)[0]

    def vectors_and_evidence(self, texts: list[str]) -> tuple[np.ndarray, list[float]]:
        """``vectors``, and how many equally frequent trigrams would weigh as much as those of each text; repeats add nothing."""
        found = [self.counts(t) for t in texts]
        evidence = [float(k.sum() ** 2 / (k * k).sum()) if len(k) else 0.0 for _, c in found for k in (c.astype(np.float64),)]
        used, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        row = np.repeat(np.arange(len(texts)), [len(c) for c, _ in found])
        n = np.concatenate([k for _, k in found]).astype(np.float32)
        for a in range(0, len(used), 8192):  # bounds the trigram rows in memory
            here = (at >= a) & (at < a + 8192)
            table = np.zeros((len(texts), min(8192, len(used) - a)), np.float32)
            table[row[here], at[here] - a] = n[here]
            out += table @ self.trigrams(used[a : a + 8192]).astype(np.float32)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0), evidence


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of small parts of a batch."""
    texts, at, chars = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        texts.append(value.as_py() or "")
        chars += len(texts[-1])
        if len(texts) >= BATCH_TEXTS or chars >= BATCH_CHARS:
            yield at, texts
            texts, at, chars = [], i + 1, 0
    if texts:
        yield at, texts


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their prototypes, from every row that is not held out and has a lang.

    Each task sums its texts by language; the sums meet by language and dimension, so what
    reaches the driver is one number for each of these.
    """
    schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in _chunks(batch, "body"):
                for lang, v in zip(langs[at:], encoder.vectors(texts)):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pylist([{"lang": k, "sums": v.tolist()} for k, v in sums.items()], schema=schema)

    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), text_of().alias("body"))
    summed = rows.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums: dict[str, np.ndarray] = {}
    for r in summed.collect():
        sums.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    sums = {k: v for k, v in sorted(sums.items()) if np.abs(v).max() > 1e-9}  # a language without a letter has no profile
    prototypes = np.stack([v / np.linalg.norm(v) for v in sums.values()]) if sums else np.zeros((0, DIMENSIONS))
    return list(sums), prototypes.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, scores (JSON by language).

    ``score`` is the greatest cosine, at least 0. A text that is null or has no letters is
    ``und`` with score 0, and so is every text if no language was learned. Ties go to the
    language that sorts first. Repeated rows each give a row; an empty table gives none;
    further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("scores", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            names, best, every = [], [], []
            for _, texts in _chunks(batch, "body"):
                vectors = encoder.vectors(texts)
                cosines = np.clip(vectors @ prototypes.T, 0, 1).astype(np.float64)
                known = (vectors != 0).any(1) if len(langs) else np.zeros(len(texts), bool)
                for ok, c in zip(known, cosines):
                    k = int(c.argmax()) if ok else 0
                    names.append(langs[k] if ok else NONE)
                    best.append(float(c[k]) if ok else 0.0)
                    every.append(json.dumps({n: round(float(x), 4) for n, x in zip(langs, c)}) if ok else "{}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(every, pa.string())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, scores string")


def identify(docs: DataFrame) -> DataFrame:
    """``train`` on the rows that are not held out, then ``predict`` for all rows."""
    return predict(docs, *train(docs))


def judged(docs: DataFrame, name: str) -> tuple[DataFrame, float]:
    """(``docs`` with a struct ``name`` of lang_pred, score, evidence, own; the least score that passes), as a written table.

    ``own`` is the score with the labelled language, null for held-out rows and those
    without a learned label. The least passing score is a share of the least ``own`` of
    texts with at least ``MIN_TRIGRAMS`` trigrams, and above the noise in any case.
    """
    langs, prototypes = train(docs)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("evidence", pa.float64()), ("own", pa.float64())])
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            for at, texts in _chunks(batch, "text"):
                # Given on part by part, so that a worker holds one batch and no copy of it.
                part, found = batch.slice(at, len(texts)), []
                labels = part.column("lang").to_pylist()
                vectors, evidence = encoder.vectors_and_evidence(texts)
                cosines = np.clip(vectors @ prototypes.T, 0, 1).astype(np.float64) if langs else np.zeros((len(texts), 1))
                for i in range(len(texts)):
                    known, label = bool(vectors[i].any()), str(labels[i]) if labels[i] is not None else None
                    best = int(cosines[i].argmax())
                    found.append({
                        "lang_pred": langs[best] if known and langs else NONE, "score": float(cosines[i, best]) if known else 0.0,
                        "evidence": evidence[i] if known else 0.0, "own": float(cosines[i, place[label]]) if known and label in place else None,
                    })
                yield part.set_column(part.num_columns - 1, name, pa.array(found, kind))

    blank = F.lit(None).cast("struct<lang_pred: string, score: double, evidence: double, own: double>")
    given = docs.withColumn(name, blank)
    scored = written(given.mapInArrow(run, given.schema), "languages")
    counted = scored.filter(~held_out(F.col("doc_id")) & (F.col(f"{name}.evidence") >= MIN_TRIGRAMS))
    least = counted.agg(F.min(f"{name}.own")).first()[0]
    return scored, max(SHARE_OF_LEAST * (least or 0.0), DEVIATIONS / DIMENSIONS**0.5)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has letters and may be of a learned language; columns unchanged.

    A text of at least ``MIN_TRIGRAMS`` trigrams goes if its score is below the least that
    ``judged`` lets pass; shorter ones with a letter stay, and so does every text with a
    letter if no language was learned. Null texts go. Repeated rows and null ids are judged
    each on its own; an empty table gives no rows. The predictions stay beside, in the
    written table ``languages-*`` of the shared folder.
    """
    name = unused("language", docs.columns)
    scored, least = judged(docs, name)
    found = F.col(name)
    stay = (found["evidence"] > 0) & ((found["evidence"] < MIN_TRIGRAMS) | (found["score"] >= least))
    return scored.filter(stay).select(*docs.columns)
