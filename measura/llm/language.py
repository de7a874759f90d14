"""Language identification by string kernels.

Kernel: the blended-spectrum presence kernel counts the distinct 1-, 2- and 3-grams (of UTF-8 bytes, A-Z lower-cased, all other
ASCII signs read as a space; bytes from 128 on share 100 codes) that two texts share, divided by the geometric mean of their own counts. Landmark texts, the
same number for each language, give Nyström features K(x, L) K(L, L)^-1/2; one ridge regression per language against the
rest is solved on a bounded sample. Scoring multiplies a block's presence matrix with the landmarks' and the result with the
regression weights.

Defined cases: null texts and texts without any letter are ``und`` with score 0. Short texts are scored like others. Without
labelled rows all texts are ``und``. Repeated rows get equal results. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold_of, sample_share

CLASSES = 128


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[128:] = 27 + np.arange(128) * 100 // 128
    return out


@dataclass
class Speaker:
    """columns: the presence column of each gram code (or -1), by n; landmarks: presence rows; weights: by landmark and language."""

    columns: list[np.ndarray]
    landmarks: np.ndarray
    size: np.ndarray
    weights: np.ndarray
    languages: list[str]
    sharpness: float

    def presence(self, texts: list[bytes]) -> np.ndarray:
        return presence(texts, self.columns, len(self.landmarks[0]))

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        b = self.presence(texts)
        return b @ self.landmarks.T / np.sqrt(np.maximum(b.sum(axis=1), 1))[:, None] / self.size

    def scores(self, texts: list[bytes]) -> np.ndarray:
        k = self.kernel(texts)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights


def gram_codes(texts: list[bytes], classes: np.ndarray = _byte_classes()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the text of each gram, and its code. Each text stands between two spaces."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts) + b"  ", np.uint8)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner, last = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - 1
    c = classes[data]
    code = c[:-2]
    yield owner, code
    code = code * CLASSES + c[1:-1]
    yield owner, code
    code = code * CLASSES + c[2:]
    code[last] = 0  # the next text begins here
    yield owner, code


def presence(texts: list[bytes], columns: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width + 1), np.uint8)
    flat = out.reshape(-1)
    for (owner, code), column in zip(gram_codes(texts), columns):
        flat[owner * (width + 1) + column[code]] = 1  # unknown grams fall into the spare last column
    return out[:, :width].astype(np.float32)


def train(labelled: list[tuple[str, str]], per_language: int = 48, ridge: float = 1e-3) -> Speaker | None:
    """labelled: (language, text)."""
    labelled = sorted({(y, t) for y, t in labelled if y and t})
    languages = sorted({y for y, _ in labelled})
    if not languages:
        return None
    texts = [t.encode("utf-8", "replace") for _, t in labelled]
    y = np.array([languages.index(a) for a, _ in labelled])
    rng = np.random.default_rng(0)
    chosen: list[int] = []
    for k in range(len(languages)):
        own = rng.permutation(np.flatnonzero(y == k))
        chosen += sorted(own, key=lambda i: abs(min(len(texts[i]), 4000) - 1500))[:per_language]
    columns, width = [], 0
    for n, (owner, code) in enumerate(gram_codes([texts[i] for i in chosen]), 1):
        pairs = np.unique(code.astype(np.int64) * len(chosen) + owner) // len(chosen)
        grams, often = np.unique(pairs, return_counts=True)
        grams = grams[often >= 2] if len(chosen) > 4 else grams
        column = np.full(CLASSES ** n, -1, np.int32)
        column[grams] = width + np.arange(len(grams))
        columns.append(column)
        width += len(grams)
    for column in columns:
        column[column < 0] = width
    marks = presence([texts[i] for i in chosen], columns, width)
    size = np.sqrt(np.maximum(marks.sum(axis=1), 1)).astype(np.float32)
    model = Speaker(columns, marks, size, np.zeros((len(chosen) + 1, len(languages)), np.float32), languages, 1.0)
    # Short texts must be told apart as well: beginnings of the sample's texts are training rows too.
    cuts = [(k, t) for k, t in zip(y, texts)] + [(k, t[:n]) for k, t in zip(y, texts) for n in (16, 48, 160) if len(t) > n]
    k = np.vstack([model.kernel([t for _, t in cuts[a:a + 512]]) for a in range(0, len(cuts), 512)]).astype(float)
    value, vector = np.linalg.eigh(model.kernel([texts[i] for i in chosen]).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    goal = np.where(np.arange(len(languages)) == np.array([a for a, _ in cuts])[:, None], 1., -1.)
    each = np.bincount([a for a, _ in cuts], minlength=len(languages))
    weight = (len(cuts) / len(languages) / each)[[a for a, _ in cuts]]
    a = z * weight[:, None]
    w = np.linalg.solve(a.T @ z + ridge * len(z) * np.diag([1.] * len(root) + [0.]), a.T @ goal)
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    model.sharpness = 4.0  # a margin of 1 is e ** 4 to 1
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2,
        most: int = 500, languages: int = 1_000, longest: int = 1 << 18, most_bytes: int = 256 << 20) -> Speaker | None:
    """Train on at most ``most`` texts of each label, none above ``longest`` bytes where the label has shorter ones, picked by id hash outside
    the held-out fold. Labels get fewer texts, 20 at least, where theirs would come to more than an even part of ``most_bytes``. More labels than ``languages`` are an error, as each has landmarks of its own in the model."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    known = known.where("t is not null and y is not null and i is not null").where(fold_of("i", folds) != held_out)
    short = F.octet_length("t") <= longest
    counts = known.groupBy("y").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(short, F.octet_length("t"))), F.avg(F.octet_length("t"))).alias("size")).orderBy("y").limit(languages + 1).collect()
    if not counts:
        return None
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    only_long = [r.y for r in counts if not r.short]
    known = known.where(short | F.col("y").isin(only_long) if only_long else short)
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("y") == r.y, F.lit(min(1.0, max(20, min(most, most_bytes / len(counts) / max(1, r.size))) / (r.short or r.n)))).otherwise(share)
    hit = F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)
    rows = known.where(hit).select("y", "t").limit(most * len(counts) * 2).toArrow()
    return train(list(zip(rows["y"].to_pylist(), rows["t"].to_pylist())))


def _predict(model: Speaker | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in by_bytes(batch.column(1), 4 << 20):
                part = batch.slice(a, n)
                text = part.column(1)
                lang, score = np.full(n, "und", object), np.zeros(n)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
                rows = np.flatnonzero(letters)
                if model is not None and len(rows):
                    texts = [t.encode("utf-8", "replace") for t in text.take(pa.array(rows)).to_pylist()]
                    f = np.vstack([model.scores(texts[k:k + 256]) for k in range(0, len(texts), 256)])
                    p = np.exp(model.sharpness * (f - f.max(axis=1, keepdims=True)))
                    lang[rows] = np.array(model.languages, object)[f.argmax(axis=1)]
                    score[rows] = 1 / p.sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["i", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, model: Speaker | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score for every row."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(_predict(model), f"i {rows.schema['i'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("i").alias(id_col), (fold_of("i", folds) == held_out).alias("held_out"), "lang_pred", "score")
