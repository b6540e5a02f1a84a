"""Best-fit packing planned on a histogram of lengths.

Best-fit decreasing needs only how many pieces there are of each length, never which: bins that have the same room left
are interchangeable, so the plan works on runs of bins. Its size depends on the capacity alone, not on the corpus. Then
each piece gets its rank among the pieces of its length, and takes the slot that the plan gives to that rank.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import documents, stored, with_rank

CAPACITY = 1024
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@cache
def byte_bpe(ranks_path: str):
    """The tokenizer of byte_bpe_50k.json, from its ranks file: the same ids, several times faster. A worker keeps it."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def document_ids(encoding, text: str | None) -> np.ndarray:
    """Token ids as unsigned 32-bit numbers, END_ID last; a null text is empty."""
    return np.append(encoding.encode_to_numpy(text or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4", copy=False)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full pieces, the first one taking what is over."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


#: With a place, ids are bytes: a list of numbers for each row costs more to pass on than the tokens do to find.
def _tokenise(ranks_path: str, capacity: int, with_ids: bool, with_place: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(ranks_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                places = iter(part.column(2).to_pylist() if with_place else [None] * part.num_rows)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = document_ids(encoding, text.as_py())
                    place = next(places)
                    for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                        own = ids[at : at + n]
                        rows.append((ident, k, at, n, zlib.crc32(own), *([own.tobytes() if with_place else own] if with_ids else []), *([place] if with_place else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary() if with_place else pa.list_(pa.int32())] if with_ids else []), *([pa.int64()] if with_place else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), *(["place"] if with_place else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, if asked, the ids.

    A document is its ids and then END_ID, so an empty or null text gives one piece of one id. Only documents of more
    than `capacity` ids are cut.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_tokenise(ranks_path or default_ranks(), capacity, with_ids), schema)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, number, first bin, offset) runs, and the number of bins.

    Ranks r = first .. first + number - 1 of that length go to bins first bin + (r - first), each at `offset`. Groups of
    bins are kept by room left; a length fills the tightest group first, each bin with as many as fit, just as placing
    one piece at a time would. A length splits at most the last group it reaches, so there are a few groups for each
    length at most, however many pieces there are.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted; groups[room] lists (first bin, number of bins)
    groups: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def add(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, number))

    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            each = room // length
            full = min(number, left // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            add(room - each * length, first, full)
            over = min(left, each) if full < number else 0
            if over:  # one bin takes the last few
                for k in range(over):
                    runs.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                left -= over
                add(room - over * length, first + full, 1)
                add(room, first + full + 1, number - full - 1)
            else:
                add(room, first + full, number - full)
    return runs, bins


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, id_cols: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids_crc32")) -> DataFrame:
    """`pieces` (with a column length; stored, as it is read three times) with sequence_id and offset.

    Every piece gets a place: sequences hold at most `capacity` ids and their pieces lie without gaps from 0. The
    histogram that goes to the driver has at most `capacity` rows. The plan that is broadcast is bounded by the capacity
    as well. One length may hold any share of the pieces. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = best_fit_plan(histogram, capacity)
    plan = spark.createDataFrame(runs, "_length int, _first long, _number long, _bin long, _offset long")
    ranked = with_rank(pieces, "length", [c for c in id_cols if c in pieces.columns], sum(histogram.values()), name="_rank")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_number")))
    return placed.withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_first")).withColumn("offset", F.col("_offset")).drop("_length", "_first", "_number", "_bin", "_offset", "_rank")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; see token_pieces() and pack().

    Rows are packed as they are: a repeated row is packed again, and a null identifier is kept as null.
    """
    return pack(stored(token_pieces(df, id_col, text_col, capacity=capacity, ranks_path=ranks_path, with_ids=with_ids), "pieces"), capacity=capacity)


#: Places are ranked in ranges of so many, and ranges in stretches of so many (as powers of two), so that no task sees all pieces of a length.
_RANGE, _STRETCH = 13, 13
#: Names of so many files may be sent to every task, some 100 bytes each.
_MOST_FILES = 1 << 17


def _rank_by_place(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """0-based rank within `key`, gapless, by `order`, which starts with the long `place`: ranks start where the counts of the
    ranges before end, in their stretch, and a stretch starts where the counts of the stretches before end."""
    dealt = df.withColumn("_range", F.shiftright("place", _RANGE))
    stretch = F.shiftright("_range", _STRETCH)
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_stretch", stretch)
    before = Window.partitionBy(key, "_stretch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(key, "_stretch").agg(F.sum("_n").alias("_s")).select(F.col(key).alias("_k"), F.col("_stretch").alias("_t"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_to"))
    starts = within.join(sums, (F.col(key) == F.col("_k")) & (F.col("_stretch") == F.col("_t"))).select(F.col(key).alias("_key"), F.col("_range").alias("_r"), (F.col("_to") + F.col("_in")).alias("_start"))
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    return ranked.join(starts, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_r"))).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_range", "_row", "_key", "_r", "_start")


def with_place(df: DataFrame) -> DataFrame:
    """The rows of a Parquet table with `place`, a long of its own for each: the order of its files, and of rows in a file.

    Files are in the order of the part and then the chunk number in their names (`part-3-..-c001`), as one write gives
    them; files with the same ones, as several writes have, or without any (these last) are in the order of their paths.
    """
    file = F.col("_metadata.file_path")
    name = F.element_at(F.split("_file", "/"), -1)
    part, chunk = (F.regexp_extract(name, p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)(?:\.|$)"))
    files = df.select(file.alias("_file")).distinct()
    order = Window.orderBy(part.asc_nulls_last(), chunk.asc_nulls_last(), "_file")  # a row a file
    files = stored(files.select("_file", (F.row_number().over(order) - 1).cast("long").alias("_number")), "files")
    placed = F.broadcast(files) if files.count() <= _MOST_FILES else files
    rows = df.select("*", file.alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(placed, F.col("_path") == F.col("_file")).withColumn("place", F.shiftleft("_number", 40) + F.col("_row")).drop("_path", "_row", "_file", "_number")


def pack_in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """pack_documents() of a Parquet table in the order of its files and rows, see with_place(): pieces of a length take the
    plan's slots in that order, and sequences are numbered by the first piece in each.

    Pieces come with their ids (bytes of little-endian unsigned 32-bit numbers), which are joined to their places at the
    end and take no part in the shuffles before. A null text is empty, a null identifier is kept, a repeated row is packed
    again; only the two columns are read, whatever others are called. An empty table gives an empty result. However a
    table's rows are dealt to files, each row is packed once.
    """
    placed = with_place(df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), "_metadata"))
    whole = stored(placed.select("_id", "_text", "place").mapInArrow(_tokenise(ranks_path or default_ranks(), capacity, True, True), _PIECES + ", ids binary, place long"), "pieces")
    pieces = whole.select("place", "piece", "length")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = df.sparkSession.createDataFrame(best_fit_plan(histogram, capacity)[0], "_length int, _first long, _number long, _bin long, _offset long")
    ranked = _rank_by_place(pieces, "length", ["place", "piece"], "_rank")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_number")))
    placed = stored(placed.select("place", "piece", (F.col("_bin") + F.col("_rank") - F.col("_first")).alias("_sequence"), F.col("_offset").alias("offset")), "placed")
    first = placed.groupBy("_sequence").agg(F.min(F.struct("place", "piece")).alias("_f")).select(F.col("_sequence").alias("_s"), F.lit(0).alias("_all"), "_f.place", F.col("_f.piece").alias("_piece"))
    numbers = _rank_by_place(stored(first, "sequences"), "_all", ["place", "_piece"], "sequence_id").select("_s", "sequence_id")
    numbered = placed.join(numbers, F.col("_sequence") == F.col("_s")).select("place", "piece", "sequence_id", "offset")
    return whole.join(numbered, ["place", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents into sequences of 1024 ids; a null text is empty."""
    packed = pack_documents(documents(spark, sf_dir))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
