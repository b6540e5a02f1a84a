"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Block k of a source of weight w is released at slot floor(k / w) and due at slot
ceil((k + 1) / w); in every slot the released block that is due first goes out. With weights that add up to one this
meets every deadline, so after any number t of slots each source has had w * t blocks give or take less than one.

Releases and deadlines are exact fractions of the weights, which are read as their shortest decimals; nothing is
rounded. Each slot is scheduled on the driver, in a time and memory that its number bounds: unless told otherwise, blocks
have BLOCK_ROWS rows, or as many more as it takes for SLOTS blocks to hold a corpus. The deviation stays below one block,
which is then a millionth of the corpus. The plan that goes to the workers has a number for each slot as well.
Weights that are whole shares of a period have a schedule that repeats, and only one period of it is computed; so has a
source that is left alone. When a source runs out, the others go on with their weights scaled up: a new phase, with a
schedule of its own. No row is dropped, repeated or sampled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents, stored, with_rank

PERIOD = 1000
#: Rows of a block at least, and slots of a schedule at most (and one more for each source, whose last block is short).
BLOCK_ROWS, SLOTS = 16, 1 << 20
#: Slots of a source's blocks go to the workers in rows of so many.
_CHUNK = 1024
#: The target of a source without a given weight grows with this power of its rows.
EXPONENT = 0.7


def shares_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of the period by largest remainders, at least one each; they add up to the period."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    shares = {s: 1 + int(v) for s, v in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def pfair_slots(shares: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, its block) for each slot, without end; every block lies in its window from release to deadline."""
    period = sum(shares.values())
    waiting = [(0, s) for s in sorted(shares)]  # by release
    ready: list[tuple[int, Fraction, str]] = []
    given = dict.fromkeys(shares, 0)
    heapq.heapify(waiting)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            due = -(-(given[s] + 1) * period // shares[s])
            heapq.heappush(ready, (due, -shares[s], s))
        due, _, s = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        yield s, given[s]
        given[s] += 1
        heapq.heappush(waiting, (given[s] * period // shares[s], s))
        slot += 1


def pfair_period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """The slots of one period, after which they repeat."""
    return [slot for slot, _ in zip(pfair_slots(shares), range(sum(shares.values())))]


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the proportion of the weights, each the shortest decimal that it prints as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = lcm(*(v.denominator for v in exact.values()))
    shares = {s: int(v * whole) for s, v in exact.items()}
    common = np.gcd.reduce(np.array(list(shares.values()), object))
    return {s: n // int(common) for s, n in shares.items()}


def phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """The phases of a mix: first slot, first block of each source, and the slots of its blocks in the phase.

    A phase ends after the slot that takes some source's last block; that source then leaves. There is a phase for each
    source at most. A schedule that repeats within `period` slots is computed once; that does not change it.
    """
    left, slot, found = {s: n for s, n in blocks.items() if n}, 0, []
    taken = dict.fromkeys(left, 0)
    while left:
        shares = exact_shares({s: weights[s] for s in left})
        length = sum(shares.values())
        if length <= period:
            order = pfair_period(shares)
            once = {s: np.array([at for at, (x, _) in enumerate(order) if x == s]) for s in left}
            last = min((n - 1) // shares[s] * length + int(once[s][(n - 1) % shares[s]]) for s, n in left.items())
            repeats = np.arange(last // length + 1) * length
            slots = {s: (at := (repeats[:, None] + once[s]).ravel())[at <= last] for s in left}
        else:
            held: dict[str, list[int]] = {s: [] for s in left}
            for at, (s, _) in enumerate(pfair_slots(shares)):
                held[s].append(at)
                if len(held[s]) == left[s]:
                    last = at
                    break
            slots = {s: np.array(v, np.int64) for s, v in held.items()}
        found.append({"slot": slot, "first": {s: taken[s] for s in left}, "slots": slots})
        for s in list(left):
            taken[s] += len(slots[s])
            left[s] -= len(slots[s])
            if not left[s]:
                del left[s]
        slot += last + 1
    return found


def _placed(df: DataFrame, weights: dict[str, float] | None, source_col: str, id_col: str, order_cols: tuple[str, ...], block_rows: int | None, period: int, exponent: float) -> tuple[DataFrame, int]:
    """(row, mix_block, mix_position) for every row, `row` holding all its columns; and the number of slots."""
    spark = df.sparkSession
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate((id_col, *order_cols))]
    plain = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), source.alias("_source"), *order)
    rows = {r["_source"]: r["count"] for r in plain.groupBy("_source").count().collect()}
    total = sum(rows.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // SLOTS))
    given = {f"s{s}": w for s, w in (weights or {}).items() if f"s{s}" in rows and w > 0}
    scale = sum(given.values()) / sum(rows[s] ** exponent for s in given) if given else 1.0
    target = {s: given.get(s, n**exponent * scale) for s, n in rows.items()}
    planned = phases({s: -(-n // block_rows) for s, n in rows.items()}, target, period)
    # A row for each _CHUNK blocks of a source, with their slots.
    parts = {s: [ph["slots"][s] + ph["slot"] for ph in planned if s in ph["slots"]] for s in rows}
    every = [(s, k // _CHUNK, at[k : k + _CHUNK].tolist()) for s, held in parts.items() for at in [np.concatenate(held)] for k in range(0, len(at), _CHUNK)]
    slots = spark.createDataFrame(every, "_s string, _chunk long, _slots array<int>")
    ranked = with_rank(plain, "_source", [f"_o{i}" for i in range(len(order))], total, name="_rank").withColumn("_block", F.floor(F.col("_rank") / block_rows))
    placed = ranked.join(F.broadcast(slots), (F.col("_source") == F.col("_s")) & (F.floor(F.col("_block") / _CHUNK) == F.col("_chunk")))
    block = F.get("_slots", F.pmod(F.col("_block"), F.lit(_CHUNK)).cast("int")).cast("long")
    return placed.select("row", block.alias("mix_block"), F.pmod("_rank", F.lit(block_rows)).alias("mix_position")), sum(-(-n // block_rows) for n in rows.values())


def mix(df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", id_col: str = "doc_id", order_cols: tuple[str, ...] = (), block_rows: int | None = None, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """Every row of `df` (a table; it is read three times) with mix_block and mix_position: its slot, and its place in it.

    `weights` are target weights by source, of any scale; a source that is missing there, the null source too, gets its
    number of rows to the power `exponent`, on the scale of the given ones' rows. Within a source rows are in the order
    of a hash of the identifier. Blocks have `block_rows` rows (by default as the module says), a source's last block fewer. The number of sources is
    bounded by what a driver can hold; a source's rows are not: they are ranked in hash buckets. Repeated rows are rows
    like others; texts are not looked at. Columns of the result's names are replaced. An empty table gives an empty result.
    """
    placed, _ = _placed(df, weights, source_col, id_col, order_cols, block_rows, period, exponent)
    return placed.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("mix_block", "mix_position")], "mix_block", "mix_position")


def in_mix_order(df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", id_col: str = "doc_id", order_cols: tuple[str, ...] = (), block_rows: int | None = None, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """All columns of `df`, a table, with rows and partitions in the order of mix().

    Slots are dense, so their number and the number of partitions tell where a row goes; nothing has to be sampled.
    Null sources are a source, null identifiers come in any order, repeated rows stay, and columns may have any names, those
    of mix() too: rows travel whole. Texts are not looked at. An empty table gives an empty result.
    """
    placed, slots = _placed(df, weights, source_col, id_col, order_cols, block_rows, period, exponent)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.floor(F.col("mix_block") * n / F.lit(max(1, slots))).cast("int")
    return placed.repartitionById(n, F.least(to, F.lit(n - 1))).sortWithinPartitions("mix_block", "mix_position").select("row.*")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents by source, a null source being one; target weights are rows to the power 0.7."""
    docs = stored(documents(spark, sf_dir).select("doc_id", "source"), "sources")
    return mix(docs)
