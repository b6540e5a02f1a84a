"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2-, 3- and 4-grams of bytes of the lower-cased text, blanks included, hashed into buckets. A document
is the mean of its subwords' embeddings. Training is stochastic gradient descent in numpy on the driver, over a bounded
sample of labelled rows; a temperature and a rejection threshold are then fitted on rows of the sample that training did
not see. As the softmax is linear in the mean, prediction needs one small table: a row of class scores for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents

BITS = 14
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Bound of the training sample: labelled rows, dealt evenly to the languages; each language has LEAST_ROWS nevertheless.
MAX_ROWS, LEAST_ROWS = 2400, 8
_WINDOW = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def subword_parts(text: str) -> Iterator[np.ndarray]:
    """The buckets of all subwords of a text, some at a time: windows overlap by what a subword reaches over."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    for n in ORDERS:
        for lo in range(0, len(raw) - n + 1, _WINDOW):
            part = raw[lo : lo + _WINDOW + n - 1].astype(np.uint32)
            m = len(part) - n + 1
            hashed = np.full(m, n * 40503, np.uint32)
            for k in range(n):
                hashed = (hashed ^ part[k : k + m]) * _MULTIPLIERS[k]
                hashed ^= hashed >> np.uint32(15)
            yield hashed >> np.uint32(32 - BITS)


def subwords(text: str) -> np.ndarray:
    """The buckets of all subwords of a text."""
    return np.concatenate(list(subword_parts(text)))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class LanguageModel:
    """`scores`: (buckets, classes); a text's logits are the mean of its rows, divided by the temperature."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (und, 0) for a null text or one without a letter."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        total, count = np.zeros(len(self.langs)), 0
        for found in [subwords(text)] if len(text) < _WINDOW else subword_parts(text):
            total += np.bincount(found, minlength=len(self.scores)) @ self.scores if len(found) > 1 << 15 else self.scores[found].sum(0)
            count += len(found)
        logits = (total / count + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        at = int(p.argmax())
        return self.langs[at], float(p[at])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lang, order, text in zip(*(c.to_pylist() for c in batch.columns)):
            if has_letter(text):
                counts = sum(np.bincount(part, minlength=1 << BITS) for part in subword_parts(text))
                at = np.flatnonzero(counts)
                rows.append((lang, order, at.astype("<u2").tobytes(), (counts[at] / counts.sum()).astype("<f4").tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "order", "at", "share"])


def labelled_sample(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_ROWS) -> list:
    """About `max_rows` labelled rows, dealt evenly to all languages, chosen by a hash of identifier and text; each
    language has up to LEAST_ROWS however many there are. Rows alike in both count once.

    A row is (language, buckets, shares): the two arrays stay packed, 6 bytes for each bucket that a text has.
    """
    known = df.where(F.col(lang_col).isNotNull())
    order = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language sample")), F.lit(1 << 60))
    found = known.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy("l").collect()  # a row a language
    counts, first = {r["l"]: r["n"] for r in found}, {r["l"]: r["first"] for r in found}
    if not counts:
        return []
    each = max(LEAST_ROWS, max_rows // len(counts))
    # About as many as are wanted; where most rows of a language are alike, the first of them at least.
    below = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(max(first[lang] + 1, int(min(1.0, (1.2 * each + 20) / n) * (1 << 60)))))])
    taken = known.where(order < F.try_element_at(below, F.col(lang_col))).select(F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).alias("text"))
    once = taken.dropDuplicates(["lang", "order"])  # a text that is everywhere would come as often
    rows = once.mapInArrow(_sampled, "lang string, order long, at binary, share binary").toArrow()
    chosen, seen = [], dict.fromkeys(counts, 0)
    langs, orders = rows.column("lang").to_pylist(), rows.column("order").to_pylist()
    for i in sorted(range(len(langs)), key=lambda i: (orders[i], langs[i])):
        seen[langs[i]] += 1
        if seen[langs[i]] <= each:
            chosen.append((langs[i], np.frombuffer(rows.column("at")[i].as_py(), "<u2"), np.frombuffer(rows.column("share")[i].as_py(), "<f4")))
    return chosen


def train(rows: list, *, dim: int = 16, epochs: int = 40, batch: int = 32, rate: float = 2.0, held: int = 5, reject: float = 0.001, seed: int = 7) -> LanguageModel:
    """Fit on the rows of labelled_sample(); every `held`-th one calibrates.

    The temperature has the least log loss on the calibration rows. The threshold lies below the scores of all but
    `reject` of those that are predicted rightly, and never above one half.
    """
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([langs.index(lang) for lang, _, _ in rows])

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), 1 << BITS), np.float32)
        for k, i in enumerate(which):
            x[k, rows[i][1]] = rows[i][2]
        return x

    calibrate = np.arange(len(rows)) % held == held - 1 if len(rows) >= 4 * held else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~calibrate)
    rng = np.random.default_rng(seed)
    scale = np.float32(np.sqrt(1 << 8))  # means of many embeddings are short
    embed = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(fit)
        for lo in range(0, len(order), batch):
            i = order[lo : lo + batch]
            x = dense(i)
            mean = x @ embed * scale
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            back = p @ weights.T
            weights -= step * 0.2 * (mean.T @ p)
            bias -= step * 0.2 * p.sum(0)
            embed -= step * scale * (x.T @ back)
    scores = (embed @ weights * scale).astype(np.float64)
    test = np.flatnonzero(calibrate) if calibrate.any() else fit
    logits = np.concatenate([dense(test[lo : lo + batch]) @ scores for lo in range(0, len(test), batch)]) + bias

    def probabilities(t: float) -> np.ndarray:
        z = logits / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(probabilities(t)[np.arange(len(test)), y[test]] + 1e-300).sum() + 1e-9 * abs(np.log(t)))
    p = probabilities(temperature)
    right = p.max(1)[p.argmax(1) == y[test]]
    threshold = min(0.5, float(np.quantile(right, reject)) - 1e-6) if len(right) else 0.0
    return LanguageModel(langs, scores, bias.astype(np.float64), float(temperature), threshold)


def fit_language_model(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> LanguageModel:
    """A model of the languages of `df`, from a sample of `max_rows` rows about, dealt evenly to the languages.

    Rows without a language, or whose text has no letter, are left out; rows alike count once. Only the three columns are read. An
    empty table, or one without labels, gives a model that rejects everything.
    """
    return train(labelled_sample(df, id_col=id_col, text_col=text_col, lang_col=lang_col, max_rows=max_rows))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, rejected) for every row; `row` holds all columns, whatever their names.

    A null text and one without a letter are `und` with score 0 and rejected. Only the text is looked at, and all of it,
    however long. Other rows
    are rejected when their calibrated score is below the model's threshold. Repeated rows and an empty table are no
    special cases.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^14 buckets x one number a language
    held = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.column(0).slice(lo, 1024)
                found = [m.predict(t.as_py()) for t in pc.struct_field(rows, [place])]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UNKNOWN or s < m.threshold for x, s in found], pa.bool_())],
                    ["row", "lang_pred", "score", "rejected"],
                )

    schema = f"row {held.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return held.mapInArrow(run, schema)


def remainder(column: str, of: int) -> Column:
    """crc32 of the identifier as text, modulo `of`; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones that are not held out; a null text, or one without a letter, is `und`."""
    docs = documents(spark, sf_dir)
    model = fit_language_model(docs.where(remainder("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text").withColumn("held_out", remainder("doc_id", 4) == 2).select("doc_id", "held_out", "text"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")
