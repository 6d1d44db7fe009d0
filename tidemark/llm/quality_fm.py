"""A factorisation machine for document quality.

Inputs of a document: its distinct hashed words, statistics of its structure cut into bins (shares of capitals,
symbols, digits and spaces; word lengths; repeated words and lines), its lengths, and metadata: the columns of
`METADATA` that the table has, as powers of two, with a place of their own for null, for what is no number and for a
column that is absent.  Labels, language, source and id are never inputs.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)),

the sum-of-squares identity, linear in the number of inputs; pairs are never formed.  Training reads a bounded sample
of labelled rows: the `sample` first in a fixed hash order (a parameter; the default is 6000), Adam on mini-batches in
numpy, with fixed seeds, so that reruns agree.  Inputs are made where the texts are; the driver gets them, at most
`SIZE` numbers a row however long its text.  Scoring is one narrow pass over whole texts.

Edge cases: null and empty texts are scored from their (zero) statistics alone; labels of unknown ids are
ignored, equal labels of an id count once, and of rows that share an id one text counts; a null label is no label; without any label every score is 0.5; repeated rows score
alike; a null id is kept and not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

WORDS = 1 << 14
BINS = 12
RANK = 8
STATS = 14
METADATA = ("n_chars",)
LEVELS = 34  # of a metadata column: none, 0 or less, and powers of two
SIZE = WORDS + STATS * BINS + len(METADATA) * LEVELS
_KIND = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 space, 5 line end, 6 plain mark, 7 other mark, 0 non-ASCII
for _b in range(128):
    _ch = chr(_b)
    _KIND[_b] = 1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" else 3 if _ch.isdigit() else 5 if _ch == "\n" else 4 if _ch.isspace() else 6 if _ch in ".,'\"-:;()?" else 7


def statistics(text: bytes, words: list[bytes], hashed: np.ndarray) -> list[float]:
    """Of one document, each from 0 to 1."""
    n, w = max(len(text), 1), max(len(words), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
    letters = max(kinds[1] + kinds[2], 1)
    lines = text.split(b"\n")
    distinct = len(np.unique(hashed))
    return [
        kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[6] / n, kinds[7] / n, min(1.0, kinds[7] / w), kinds[0] / n,
        min(1.0, (n - kinds[4] - kinds[5]) / w / 24), distinct / w, float((hashed[1:] == hashed[:-1]).sum()) / w,
        len(set(lines)) / len(lines), min(1.0, len(lines) / w * 4), min(1.0, np.log1p(len(words)) / 12), min(1.0, text.count(b"|") / w * 2),
    ]


def levels(docs: DataFrame):
    """The metadata of a row as a binary of levels, one byte a column."""
    there = dict(docs.dtypes)

    def level(name):
        if there.get(name, "") not in ("tinyint", "smallint", "int", "bigint", "float", "double", "string"):
            return F.lit("00")
        n = F.col(name).try_cast("double")
        power = F.when(n < 1, 1).otherwise(F.least(F.floor(F.log2(F.least(n, F.lit(2.0**62)))) + 2, F.lit(LEVELS - 1)))
        return F.lpad(F.hex(F.when(n.isNull() | F.isnan(n), 0).otherwise(power).cast("int")), 2, "0")

    return F.unhex(F.concat(*(level(name) for name in METADATA)))


def features(texts: list[bytes], metas: list[bytes] | None = None):
    """Per document: places of inputs and their values (hashed words share a norm of 1, each statistic's bin is 1)."""
    for text, meta in zip(texts, metas or [bytes(len(METADATA))] * len(texts)):
        words = text.lower().split()
        hashed = c.hash_words(words)
        place = np.unique((c.mix(hashed) & np.uint64(WORDS - 1)).astype(np.int64))
        stats = np.array(statistics(text, words, hashed))
        bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
        known = WORDS + STATS * BINS + np.arange(len(METADATA)) * LEVELS + np.frombuffer(meta, np.uint8)
        at = np.concatenate([place, WORDS + np.arange(STATS) * BINS + bins, known])
        yield at, np.concatenate([np.full(len(place), 1 / np.sqrt(max(len(place), 1))), np.ones(STATS + len(METADATA))])


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margin(self, at, x):
        xv = self.v[at] * x[:, None]
        total = xv.sum(0)
        return self.w0 + self.w[at] @ x + 0.5 * float(total @ total - (xv * xv).sum()), total

    def scores(self, texts: list[bytes], metas: list[bytes] | None = None) -> np.ndarray:
        margins = np.array([self.margin(at, x)[0] for at, x in features(texts, metas)])
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.02, decay: float = 1e-4, batch: int = 32, least_steps: int = 200) -> Machine:
    """Adam on mini-batches of `features`; small tables are gone through more often, until `least_steps` are made."""
    rng = np.random.default_rng(7)
    share = min(max(float(np.mean(labels)) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))]
    params[2][:WORDS] *= 0.5
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        return Machine(float(params[0][0]) if len(labels) else 0.0, params[1], params[2] * 0)
    for _ in range(max(epochs, -(-least_steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            grads = [np.zeros_like(p) for p in params]
            own = order[lo : lo + batch]
            model = Machine(params[0][0], params[1], params[2])
            for i in own.tolist():
                at, x = rows[i]
                margin, total = model.margin(at, x)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]) / len(own)
                grads[0] += g
                grads[1][at] += g * x
                grads[2][at] += g * x[:, None] * (total - params[2][at] * x[:, None])
            step += 1
            for p, g, a, b in zip(params, grads, m, s):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * (a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + decay * p)
    return Machine(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> Machine:
    """A machine from the labelled rows that are not held out: `sample` of them at most, first in a hash order.

    Only the sample's ids (of that bounded number) are broadcast, and only its inputs come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), c.text_of(text_col).alias("text"), levels(docs).alias("meta")).join(F.broadcast(chosen), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "meta")).alias("own")
    rows = c.bounded_batches(rows).groupBy("id", "label").agg(one).select("id", "label", "own.text", "own.meta")

    def inputs(batches):
        for batch in (x for whole in batches for x in c.pieces(whole, 2)):
            made = list(features(c.as_bytes(batch.column(2)), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i].astype(t).tobytes() for f in made], pa.binary()) for i, t in enumerate(("i4", "f8")))], ["id", "label", "places", "amounts"])

    got = rows.mapInArrow(c.tidy(inputs), f"id {dict(chosen.dtypes)['id']}, label int, places binary, amounts binary").collect()
    got.sort(key=lambda r: (r.id, r.label))
    return train([(np.frombuffer(r.places, "i4").astype(np.int64), np.frombuffer(r.amounts)) for r in got], np.array([r.label for r in got], np.float64))


def _score(model: Machine, schema: pa.Schema, spot: int):
    def run(batches):
        for batch in (x for whole in batches for x in c.pieces(whole, spot)):
            scores = pa.array(model.scores(c.as_bytes(batch.column(spot)), batch.column(batch.num_columns - 1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), scores], schema=schema)

    return run


def score(docs: DataFrame, model: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with all its columns and the score; one narrow pass."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    full = StructType(list(docs.schema.fields)).add(score_col, DoubleType())
    rows = c.bounded_batches(docs).select("*", levels(docs).alias(score_col))  # the metadata's levels make place for the score
    return rows.mapInArrow(c.tidy(_score(model, to_arrow_schema(full), docs.columns.index(text_col))), full)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **more) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, **more)
    kept = [m for m in METADATA if m in docs.columns and m != id_col]
    flat = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *kept)
    out = score(flat, model, "_text", "_score").select(id_col, held_out(id_col).alias("held_out"), F.col("_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more) -> DataFrame:
    """The rows of `docs`, columns unchanged, that the machine scores at `threshold` or more."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels, **more), score_col=name).where(F.col(name) >= threshold).drop(name)
