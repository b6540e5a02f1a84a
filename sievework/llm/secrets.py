"""Secret scans: known forms, and a battery of randomness tests.

Three kinds of span have a fixed form. Beyond them, every long run of key characters is a candidate. Its encoding is
inferred from its alphabet, and three tests ask whether it is more random than ordinary text could be. The null of each is
a source that is at least nine tenths (ORDER) as ordered as the corpus's own words are in that respect:

uniformity  its characters collide (chi-squared, but for the scale) as often as those of a mixture of the corpus's letters
            and uniform ones that has so much of the corpus's excess over uniform
runs        the class of its letters and digits changes no more often than so far from a random rate to the corpus's
serial      the places of neighbours in the alphabet correlate by SERIAL at least

Each p is the chance that a source at the edge of its null looks as random as the token does, so p is uniform there and
larger inside. The tests of a token depend on each other; so the battery claims that at least two of the three nulls are
wrong, by twice the second smallest p, which is valid whatever the dependence. Benjamini-Hochberg, with weights that grow
with length, then holds the false discovery rate over all candidates of the corpus. Names, paths and dates collide as
words do; so do UUIDs, as hexadecimal digits and dashes are few of the characters that their alphabet has.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents, stored

KINDS = ("assign", "access", "hex", "random")
#: Only letters of either case in ASCII: the flag keeps case folding out of other scripts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_RANDOM = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
#: Encodings from narrow to wide: the first whose alphabet holds the whole token is the one inferred.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower_alnum": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper_alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
FALSE_DISCOVERY = 0.01
_LENGTHS = 8
#: Smaller p count as this one.
LEAST_P = 1e-100


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start and then kind as listed; code points, end exclusive."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> str:
    held = set(token.rstrip("="))
    return next((name for name, alphabet in ENCODINGS.items() if held <= _SETS[name]), "mixed")


_SETS = {name: set(alphabet) for name, alphabet in ENCODINGS.items()}


ORDER = 0.9
#: Correlation of neighbours that a token must be found below.
SERIAL = 0.25
_CHUNK = 1 << 20
_TABLES = {name: np.array([alphabet.find(chr(c)) if c < 128 else -1 for c in range(256)], np.int16) for name, alphabet in ENCODINGS.items()}
_CLASS = np.array([0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(128)] + [3] * 128, np.uint8)


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _classes(encoding: str, raw: np.ndarray) -> np.ndarray:
    """Lower case, upper case and digits, 3 for all else; for digits alone their lower and upper half."""
    return (raw >= ord("5")).astype(np.uint8) if encoding == "decimal" else _CLASS[raw]


def _changes(kind: np.ndarray) -> tuple[int, int]:
    """(changes of class, pairs) among neighbours that are letters or digits both."""
    changes = pairs = 0
    for lo in range(0, len(kind) - 1, _CHUNK):
        k = kind[lo : lo + _CHUNK + 1]
        both = (k[1:] < 3) & (k[:-1] < 3)
        pairs += int(np.count_nonzero(both))
        changes += int(np.count_nonzero(both & (k[1:] != k[:-1])))
    return changes, pairs


class Prose:
    """How the corpus's own words are made: frequencies of characters, and how often the class of a character changes."""

    def __init__(self, counts: np.ndarray, changes: int, pairs: int):
        self.counts, self.change = np.asarray(counts, float) + 0.5, (changes + 1) / (pairs + 2)
        self.known: dict[str, tuple] = {}

    def of(self, encoding: str) -> tuple[float, float, float]:
        """At the edge of the null: chances that two and that three characters are equal, and that the class changes."""
        if encoding not in self.known:
            alphabet = ENCODINGS[encoding]
            # Letters of one case alone are not how prose is written: they take the letter's whole share.
            one_case = encoding in ("hex", "hex_upper", "base32", "lower_alnum", "upper_alnum")
            share = np.array([self.counts[ord(c)] + (self.counts[ord(c.swapcase())] if one_case and c.isalpha() else 0) for c in alphabet])
            mixed = math.sqrt(ORDER) * share / share.sum() + (1 - math.sqrt(ORDER)) / len(alphabet)  # excess is quadratic in the shares
            kinds = np.bincount(_classes(encoding, np.frombuffer(alphabet.encode(), np.uint8)), minlength=4)[:3]
            random = 1 - float(((kinds / kinds.sum()) ** 2).sum())
            rate = ORDER * self.change + (1 - ORDER) * random if encoding != "decimal" else 0.4  # numbers are not spelled: a rate of their own
            two, three = float((mixed**2).sum()), float((mixed**3).sum())
            if encoding == "decimal":
                two = max(two, 1.2 / len(alphabet))
            self.known[encoding] = (two, max(three, two * two), rate)
        return self.known[encoding]


def uniformity(n: int, collisions: float, two: float, three: float) -> float:
    """The chance of so few equal pairs among n characters, by the cube root of a gamma variable of that mean and spread."""
    mean = n * (n - 1) / 2 * two
    spread = mean * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two)
    small = spread / (9 * mean * mean)
    return _below((((collisions + 0.5) / mean) ** (1 / 3) - 1 + small) / math.sqrt(small))


def many_changes(changes: int, pairs: int, rate: float) -> float:
    """Binomial tail: so many changes or more."""
    if pairs > 4000:
        return _below(-(changes - 0.5 - pairs * rate) / math.sqrt(pairs * rate * (1 - rate)))
    return _at_least(changes, pairs, rate)


def uncorrelated(places: np.ndarray) -> float:
    """The chance that neighbours correlate so little where their correlation is SERIAL, of either sign."""
    n, mean = len(places), float(places.mean())
    lagged = squares = 0.0
    for lo in range(0, n, _CHUNK):
        x = places[lo : lo + _CHUNK + 1] - mean
        lagged += float((x[1:] * x[:-1]).sum())
        squares += float((x[:_CHUNK] ** 2).sum())
    r = lagged / squares if squares else 1.0
    return _below((abs(r) - SERIAL) * math.sqrt(n) / math.sqrt(1 - SERIAL**2))


def battery(token: str, prose: Prose) -> tuple[str, float]:
    """(encoding, p): p is small if at least two of the three tests find the token too random for ordinary text."""
    encoding, raw = encoding_of(token), np.frombuffer(token.rstrip("=").encode(), np.uint8)
    places, n = _TABLES[encoding][raw], len(raw)
    known = places[places >= 0]
    counts = np.bincount(known, minlength=len(ENCODINGS[encoding])).astype(float)
    two, three, rate = prose.of(encoding)
    tests = sorted([uniformity(n, float((counts * (counts - 1)).sum()) / 2, two, three), many_changes(*_changes(_classes(encoding, raw)), rate), uncorrelated(places)])
    return encoding, min(1.0, 2 * tests[1])


def _at_least(k: int, n: int, p: float) -> float:
    """Binomial tail: k or more of n."""
    if k <= 0:
        return 1.0
    i = np.arange(k, n + 1)
    ways = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    logs = ways + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, float(np.exp(logs).sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, changes, pairs = np.zeros(256, np.int64), 0, 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            raw = np.frombuffer(text.as_py() or b"", np.uint8)
            counts += np.bincount(raw, minlength=256)
            own = _changes(_CLASS[raw])
            changes, pairs = changes + own[0], pairs + own[1]
    yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([changes]), pa.array([pairs])], ["counts", "changes", "pairs"])


def prose_of(df: DataFrame, text_col: str = "text") -> Prose:
    """Character statistics over every text; 258 numbers a partition, added up before they reach the driver."""
    parts = df.select(F.col(text_col)).mapInArrow(_counted, "counts array<long>, changes long, pairs long")
    row = parts.agg(F.array(*[F.sum(F.try_element_at("counts", F.lit(i + 1))) for i in range(256)]).alias("c"), F.sum("changes").alias("x"), F.sum("pairs").alias("p")).first()
    return Prose(np.array([v or 0 for v in row["c"]]), row["x"] or 0, row["p"] or 0)


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what is long enough in runs of key characters when the base spans are cut out of them."""
    taken = sorted((a, b) for a, b, _ in base)
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        for a, b in [*((a, b) for a, b in taken if a < m.end() and b > m.start()), (m.end(), m.end())]:
            if a > at and len(text[at:a].rstrip("=")) >= MIN_RANDOM:
                yield at, a
            at = max(at, b)


def length_bin(n: int) -> int:
    return min(_LENGTHS - 1, (n - MIN_RANDOM) // 8)


def thresholds(histogram: dict[tuple[int, float], int], rate: float = FALSE_DISCOVERY) -> list[float]:
    """For each length bin, the most that p may be: weighted Benjamini-Hochberg over a histogram of (length bin, -10 log10 p).

    Weights are in proportion to the length and average one over the candidates, so more is asked of short tokens. A p
    counts as the upper end of its bin, which can only make the rate lower.
    """
    total = sum(histogram.values())
    if not total:
        return [0.0] * _LENGTHS
    size = np.array([MIN_RANDOM + 8 * b + 4 for b in range(_LENGTHS)], float)
    mean = sum(size[b] * n for (b, _), n in histogram.items()) / total
    weight = size / mean
    levels = sorted((10 ** (-k / 10) / weight[b], n) for (b, k), n in histogram.items())
    best, passed = 0.0, 0
    for q, n in levels:
        passed += n
        if q <= rate * passed / total:
            best = q
    return [float(min(1.0, best * w)) for w in weight]


def _scan(prose: Prose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("encoding", pa.string()), ("p", pa.float64()), ("length_bin", pa.int32())])
        for batch in batches:
            bases, others = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                own = []
                for start, end in candidates(text, base):
                    encoding, p = battery(text[start:end], prose)
                    own.append({"start": start, "end": end, "kind": "random", "encoding": encoding, "p": p, "length_bin": length_bin(end - start)})
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                others.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(others, pa.list_(token))], ["id", "base", "tokens"])

    return run


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """One row per input row: id, base and random: arrays of spans (start, end, kind), in code points, end exclusive.

    `base` has the fixed forms, leftmost and non-overlapping within a kind; `random` the candidates that pass the
    battery, without what base spans cover. A null or empty text has no spans; long texts and tokens are read whole, a
    token in a byte and a few numbers for each character. Rows are independent of each other but for the threshold, which
    is the corpus's; repeated rows give repeated results. Other columns, whatever their names, are ignored. An empty table
    gives an empty result.
    """
    prose = prose_of(df, text_col)
    found = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_scan(prose), "id long, base array<struct<start:long,end:long,kind:string>>, tokens array<struct<start:long,end:long,kind:string,encoding:string,p:double,length_bin:int>>"), "secret-spans")
    token = found.select(F.explode("tokens").alias("t")).select("t.length_bin", (F.floor(-100 * F.log10(F.greatest("t.p", F.lit(LEAST_P)))) / 10).alias("k"))
    histogram = {(r["length_bin"], r["k"]): r["count"] for r in token.groupBy("length_bin", "k").count().collect()}  # 80 000 bins at most
    limits = F.array(*[F.lit(x) for x in thresholds(histogram, rate)])
    passed = F.filter("tokens", lambda t: t.p <= F.try_element_at(limits, t.length_bin + 1))
    return found.select(F.col("id").alias(id_col), "base", passed.alias("random"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, base ones and those that the tests add; a null text has none."""
    found = secret_spans(documents(spark, sf_dir))
    plain = F.transform("random", lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), t.kind.alias("kind")))
    # By start, then kind as listed: base spans are so already, and `random` is the last kind and never begins where one does.
    every = F.array_sort(F.concat("base", plain), lambda a, b: F.when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(_rank(a.kind) - _rank(b.kind)))
    count = {k: F.size(F.filter(F.col("base.kind"), _equal(k))).cast("long") for k in KINDS[:3]}
    return found.select(
        "doc_id", *[c.alias(f"n_{k}") for k, c in count.items()], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("random").cast("long").alias("n_random")
    )


def _equal(kind: str):
    return lambda k: k == kind


def _rank(kind):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")
