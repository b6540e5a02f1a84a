"""Language-model scoring with a log-frequency Bloom filter.

A count is quantised to a level q = 1 + floor(log2(count)) and an n-gram is put into a Bloom filter once for each level
1..q; its count is read back by probing the levels in turn until one is missing. The filter holds unigrams and bigrams
and is broadcast; a bigram's probability interpolates its own count with its word's.

Words are 64-bit hashes. A training pass counts each partition's unigrams and bigrams in numpy and deals them by hash
range; a range, sized by the training text, is merged at once and fills its own slice of the filter, so nothing is counted
twice and hot words are ordinary rows. The filter's size follows the corpus. Up to a bound it is broadcast; beyond it the
n-grams go to the slices instead: each stretch of texts asks for its different n-grams, dealt by range, and gets their
levels back. Both ways give the same scores.

The exact unigram score needs every token's exact count. Words of at least one in HEAVY of all tokens are at most HEAVY
many, and go to the workers as two arrays; rarer ones are joined by hash, where none can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents, stored
from sievework.llm.langid import remainder

END = b" "  # no word has a blank in it
HEAVY = 2_000_000
MIN_COUNT = 1
BITS_PER_ENTRY = 10
PROBES = 5
MAX_LEVEL = 40
#: A filter of at most so much is broadcast; each Python worker holds it once.
MAX_FILTER_BYTES = 128 << 20
#: Training text for each hash range, and for each task that merges ranges.
RANGE_BYTES, TASK_BYTES = 16 << 20, 128 << 20
WEIGHT = 0.6
DELTA = 0.1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _PAIR
    return x ^ (x >> np.uint64(32))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the tokens of a text: its words, A-Z lower-cased, and one end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    """One for each token: with the token before it, or the end of an earlier text at the start."""
    before = np.concatenate([[np.uint64(_START)], tokens[:-1]])
    return mixed(before * np.uint64(3) + mixed(tokens))


_START = xxhash.xxh64_intdigest(END)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log2(np.maximum(counts, 1)))).astype(np.int64)


def count_at(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    return np.where(levels > 0, 0.75 * np.exp2(levels) - 0.5, 0.0)


def filled_slice(hashes: np.ndarray, levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> bytes:
    """A Bloom filter over one range of hashes: each in once for every level up to its own."""
    words = int(-(-max(64, int(levels.sum()) * bits_per_entry) // 64))
    bits = np.zeros(words * 64, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        first, step = _start_and_step(hashes[levels >= q], q)
        for k in range(PROBES):
            bits[(first + np.uint64(k) * step) % np.uint64(words * 64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _start_and_step(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    first = mixed(hashes + np.uint64(level * int(_MIX) % (1 << 64)))
    return first, mixed(first) | np.uint64(1)


def probe(words: np.ndarray, size: np.ndarray, offset: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The level of each hash in its slice, `size` bits from bit `offset` of `words`: never less than it was put in with,
    more by chance only; 0 where the size is 0."""
    found = np.zeros(len(hashes), np.uint8)
    left = np.flatnonzero(size)
    for q in range(1, MAX_LEVEL + 1):
        if not len(left):
            break
        first, step = _start_and_step(hashes[left], q)
        for k in range(PROBES):
            at = offset[left] + (first + np.uint64(k) * step) % size[left]
            held = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            left, first, step = left[held], first[held], step[held]
        found[left] = q
    return found


class Filter:
    """All slices end to end in one buffer; `sizes` are their bytes by shard."""

    def __init__(self, sizes: np.ndarray, raw: bytes):
        self.size = np.asarray(sizes, np.uint64) * np.uint64(8)
        self.offset = np.cumsum(self.size) - self.size
        self.words = np.frombuffer(raw, "<u8")

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        shard = shard_of(hashes, len(self.size))
        return probe(self.words, self.size[shard], self.offset[shard], hashes)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the high half of a mixed hash, so that a shard says nothing about places in its filter."""
    return ((mixed(hashes ^ _PAIR) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_PART = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_CHUNK = 1 << 20


def _dealt(hashes: np.ndarray, counts: np.ndarray, kind: int, shards: int) -> pa.RecordBatch:
    shard = shard_of(hashes, shards)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    hashes, counts = hashes[order], np.minimum(counts[order], 0xFFFFFFFF).astype("<u4")
    held = [s for s in range(shards) if at[s] < at[s + 1]]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([kind] * len(held), pa.int32()), pa.array([hashes[at[s] : at[s + 1]].tobytes() for s in held], pa.binary()), pa.array([counts[at[s] : at[s + 1]].tobytes() for s in held], pa.binary())], schema=_PART)


def _count_grams(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    yield _dealt(*np.unique(np.concatenate(held[kind]), return_counts=True), kind, shards)
                    held[kind].clear()

        for batch in batches:
            for text in batch.column(0):
                tokens = token_hashes(text.as_py())
                held[0].append(tokens)
                held[1].append(bigram_hashes(tokens))
                size += len(tokens)
                if size >= _CHUNK:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return run


def _merge(min_count: int, bits_per_entry: int):
    def merged(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.frombuffer(b"".join(h for h, _ in parts), "<u8")
        counts = np.frombuffer(b"".join(c for _, c in parts), "<u4")
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        return hashes[start], np.add.reduceat(counts, start) if len(start) else counts

    def finished(shard: int, parts: dict[int, list]) -> dict:
        words, counts = merged(parts.get(0, []))
        pairs, pair_counts = merged(parts.get(1, []))
        kept = counts >= min_count, pair_counts >= min_count
        filled = filled_slice(np.concatenate([words[kept[0]], pairs[kept[1]]]), level_of(np.concatenate([counts[kept[0]], pair_counts[kept[1]]])), bits_per_entry)
        return {"shard": shard, "words": len(words), "tokens": int(counts.sum()), "held_tokens": int(pair_counts[kept[1]].sum()), "filter": filled, "hashes": words.astype("<u8").tobytes(), "counts": counts.astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for batch in batches:
            for shard, kind, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and now is not None:
                    yield pa.RecordBatch.from_pylist([finished(now, parts)], schema=_MERGED)
                    parts = {}
                now = shard
                parts.setdefault(kind, []).append((hashes, counts))
        if now is not None:
            yield pa.RecordBatch.from_pylist([finished(now, parts)], schema=_MERGED)

    return run


_MERGED = pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("held_tokens", pa.int64()), ("filter", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _pairs_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                h, c = np.frombuffer(hashes, "<i8"), np.frombuffer(counts, "<i8")
                kept = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(c[kept])], ["hash", "count"])

    return run


class Counts:
    """What training leaves: `table`, a stored row for each shard; totals; and which counts are heavy."""

    def __init__(self, table: DataFrame, shards: int, tasks: int):
        self.table, self.shards, self.tasks = table, shards, tasks
        r = table.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v"), F.sum("held_tokens").alias("h")).first()
        self.tokens, self.words, held = r["n"] or 0, r["v"] or 0, r["h"] or 0
        self.held_share = held / self.tokens if self.tokens else 0.0

    def unigrams(self, least: int = 1) -> DataFrame:
        return self.table.select("hashes", "counts").mapInArrow(_pairs_of(least), "hash long, count long")

    def heavy(self, most: int = HEAVY) -> tuple[int, np.ndarray, np.ndarray]:
        """(least count, hashes, counts), sorted by hash: no more than `most` words can have tokens / most tokens each."""
        least = max(2, -(-self.tokens // most))
        rows = self.table.select("hashes", "counts").mapInArrow(_packed(least), "hashes binary, counts binary").toArrow()
        hashes = np.frombuffer(b"".join(rows.column(0).to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<i8")
        order = np.argsort(hashes)
        return least, hashes[order], counts[order]


def _packed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                h, c = np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i8")
                kept = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[kept].tobytes()], pa.binary()), pa.array([c[kept].tobytes()], pa.binary())], ["hashes", "counts"])

    return run


def count_grams(train: DataFrame, text_col: str = "text", *, shards: int | None = None, min_count: int = MIN_COUNT, bits_per_entry: int = BITS_PER_ENTRY) -> Counts:
    """Exact unigram counts of all training texts, and the filter's slices, by hash range.

    N-grams seen fewer than `min_count` times are not in the filter. A null or empty text counts one end. Texts are read
    whole, repeated rows count each time, other columns are not looked at. An empty table has no words and no tokens.
    """
    least = 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not shards:
        size = train.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
        shards, tasks = max(least, -(-size // RANGE_BYTES)), max(least, -(-size // TASK_BYTES))
    else:
        tasks = shards
    parts = train.select(F.col(text_col)).mapInArrow(_count_grams(shards), "shard int, kind int, hashes binary, counts binary")
    merged = parts.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_merge(min_count, bits_per_entry), "shard int, words long, tokens long, held_tokens long, filter binary, hashes binary, counts binary")
    return Counts(stored(merged, "gram-counts"), shards, tasks)


_TOGETHER = 1 << 18


def _together(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, their tokens) for stretches of texts with about so many tokens."""
    lo, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(token_hashes(text.as_py()))
        size += len(held[-1])
        if size >= _TOGETHER:
            yield lo, i + 1, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, len(texts), held


def _grams(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of some texts, and for each token's word and then each of its bigrams, text by text, its place among them."""
    return np.unique(np.concatenate([g for t in tokens for g in (t, bigram_hashes(t))]), return_inverse=True)


def _by_shard(once: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by shard, and their shards in that order."""
    shard = shard_of(once, shards)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of texts."""
    from pyspark import TaskContext

    stretch = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text")
        for lo, hi, _ in _together(texts):
            yield pa.RecordBatch.from_arrays([pa.array([stretch]), pa.array([ids[lo:hi].to_pylist()], pa.list_(pa.int64())), pa.array([texts[lo:hi].to_pylist()], pa.list_(pa.string()))], ["stretch", "ids", "texts"])
            stretch += 1


_ASKED = "shard int, kind int, stretch long, body binary"


def _ask(shards: int):
    """The different n-grams of each stretch, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, texts in zip(batch.column("stretch").to_pylist(), batch.column("texts")):
                once, _ = _grams([token_hashes(t.as_py()) for t in texts.values])
                order, shard = _by_shard(once, shards)
                once, at = once[order], np.flatnonzero(np.diff(shard, prepend=-1))
                bodies = [once[a:b].tobytes() for a, b in zip(at, [*at[1:], len(once)])]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array([1] * n, pa.int32()), pa.array([stretch] * n, pa.int64()), pa.array(bodies, pa.binary())], ["shard", "kind", "stretch", "body"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard come together, its slice of the filter first: the levels of what is asked, a byte each."""
    words = np.zeros(0, np.uint64)
    for batch in batches:
        rows = []
        for shard, kind, stretch, body in zip(*(c for c in batch.columns)):
            if kind.as_py() == 0:
                words = np.frombuffer(body.as_py(), "<u8")
                continue
            hashes = np.frombuffer(body.as_py(), "<u8")
            size = np.full(len(hashes), 64 * len(words), np.uint64)
            rows.append((stretch.as_py(), shard.as_py(), probe(words, size, np.zeros_like(size), hashes).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["stretch", "shard", "levels"])


def probability(words: np.ndarray, pairs: np.ndarray, tokens: int, vocabulary: int, held_share: float) -> float:
    """log10 of a text's probability from the counts that were read back, in order of its tokens.

    Interpolates each bigram's relative frequency with the smoothed frequency of its word. Bigrams left out of the
    filter leave some weight over: the word's share takes it, by the corpus's average.
    """
    before = np.concatenate([[0.0], words[:-1]])
    single = (words + DELTA) / (tokens + DELTA * (vocabulary + 1))
    relative = np.where(pairs > 0, pairs / np.maximum(np.maximum(before, pairs), 1), 0.0)
    return float(np.log10(WEIGHT * relative + (1 - WEIGHT * held_share) * single).sum())


def _score(filters, shards: int, heavy, tokens: int, vocabulary: int, held_share: float):
    """Scores, the exact unigram sum over heavy words, and the other words for the join. Levels come from the filter or,
    where it is not broadcast, with each stretch of texts."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray], np.ndarray]]:
        if filters is not None:
            held = parts.filter
            for lo, hi, texts in _together(batch.column("text")):
                once, back = _grams(texts)
                yield batch.column("id")[lo:hi].to_pylist(), texts, held.levels(once)[back]
        else:
            for ids, texts, found in zip(*(batch.column(c) for c in ("ids", "texts", "found"))):
                hashed = [token_hashes(t.as_py()) for t in texts.values]
                once, back = _grams(hashed)
                levels = np.zeros(len(once), np.uint8)
                levels[_by_shard(once, shards)[0]] = np.frombuffer(b"".join(body for _, body in sorted((r["shard"], r["levels"]) for r in found.as_py())), np.uint8)
                yield ids.as_py(), hashed, levels[back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if filters is not None:
            parts.filter = Filter(*filters.value)
        known, counts = heavy.value
        floor = tokens + DELTA * (vocabulary + 1)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts, found in parts(batch):
                rows, at = [], 0
                levels = count_at(np.arange(MAX_LEVEL + 1))[found]
                for ident, hashes in zip(ids, texts):
                    n = len(hashes)
                    score = probability(levels[at : at + n], levels[at + n : at + 2 * n], tokens, vocabulary, held_share)
                    at += 2 * n
                    once, times = np.unique(hashes, return_counts=True)
                    place = np.minimum(np.searchsorted(known, once), max(0, len(known) - 1))
                    hit = known[place] == once if len(known) else np.zeros(len(once), bool)
                    base = float((times[hit] * np.log10((counts[place[hit]] + DELTA) / floor)).sum())
                    rows.append((uid, ident, n, int(times[hit].sum()), base, score, once[~hit].view(np.int64), times[~hit].astype(np.int64)))
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCORED)], schema=_SCORED)

    return run


_SCORED = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def score_texts(df: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", *, max_filter_bytes: int = MAX_FILTER_BYTES, heavy_words: int = HEAVY) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, base_score, score; see the module.

    A null or empty text is one token, its end. Long texts are scored whole. With nothing to train on, every count is 0.
    Repeated rows are scored each. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    least, hashes, numbers = counts.heavy(heavy_words)
    heavy = spark.sparkContext.broadcast((hashes, numbers))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = None
    whole = counts.table.agg(F.sum(F.length("filter").cast("long")).alias("n")).first()["n"] or 0
    if whole <= max_filter_bytes:
        sizes, slices = np.zeros(counts.shards, np.int64), []
        for r in counts.table.select("shard", "filter").orderBy("shard").toLocalIterator():
            sizes[r["shard"]] = len(r["filter"])
            slices.append(r["filter"])
        shared = spark.sparkContext.broadcast((sizes, b"".join(slices)))
    else:
        texts = stored(rows.mapInArrow(_stretches, "stretch long, ids array<long>, texts array<string>"), "stretches")
        slices = counts.table.select("shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("stretch"), F.col("filter").alias("body"))
        asked = slices.union(texts.select("stretch", "texts").mapInArrow(_ask(counts.shards), _ASKED))
        found = asked.repartition(counts.tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answer, "stretch long, shard int, levels binary")
        rows = texts.join(found.groupBy("stretch").agg(F.collect_list(F.struct("shard", "levels")).alias("found")), "stretch").select("ids", "texts", "found")
    run = _score(shared, counts.shards, heavy, counts.tokens, counts.words, counts.held_share)
    scored = stored(rows.mapInArrow(run, "uid long, id long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"), "scored")

    unseen = float(np.log10(DELTA / (counts.tokens + DELTA * (counts.words + 1))))
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("uid", F.col("t.rare").alias("hash"), F.col("t.times").alias("times"))
    number = counts.unigrams().where(F.col("count") < least)
    joined = rare.join(number, "hash", "left")  # a word here is less than one in `heavy_words` of all tokens
    value = F.when(F.col("count").isNull(), F.lit(unseen)).otherwise(F.log10((F.col("count") + DELTA) / F.lit(counts.tokens + DELTA * (counts.words + 1))))
    sums = joined.groupBy("uid").agg(F.sum(F.col("times") * value).alias("rare_base"), F.sum(F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    return scored.select("uid", "id", "n_tokens", "known", "base", "score").join(sums, "uid", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the words and pairs of those that are not held out; a null text is empty, its end a token."""
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 10) == 0
    counts = count_grams(docs.where(~held))
    found = score_texts(docs, counts)
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
