"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles.  Documents of equal sets
are one class; the join runs between classes.

*Sketch.*  The hashed elements of a set are dealt over m blocks, and each
block holds the XOR of its elements.  An element that is in one set only
changes one block, so the number of differing blocks (the Hamming distance
over blocks) is at most the symmetric difference.  A 1024-bit parity sketch of
the same elements gives the same bound over bits.

*Size bands.*  Bands grow by 4/3, so a linked pair lies in one band or in two
neighbouring ones.  A set is sketched for its own band and the next one.  In
band (L, U] a linked pair differs in at most d = 2U(1-t)/(1+t) elements.

*Pigeonhole.*  A set that has more than d non-empty blocks must share one of
them with every set it is linked to.  Where d + 1 blocks are more than
``miss_bits`` needs (large sets), fewer and fuller blocks are used: enough of
them that a linked pair at the very threshold has all of them differ with
probability below 2**-miss_bits (random dealing of d elements over m blocks;
``miss_bits=None`` keeps d + 1 everywhere).  A set with too few non-empty
blocks is dealt again with other salts, and in the end by one common key.

*Seeds.*  Each class gives its few smallest signatures of either band first.
The classes of such a signature are linked to a centre and verified, which
joins most groups of near copies: what these groups hold in common, nearly
all their signatures, need not be looked at again.

*Join.*  Rows (block signature, class, group by the seeds) are sorted by
signature and read as a stream; a run of classes of a single group has nothing
left to find and is left out.  Up to ``small_run`` classes of one signature
are paired.  Of a longer run one class of every group is linked to the largest
group first; what is of one component then is left out as well.  That class is
the one that met most others by its seeds, the least edited: it is the likeliest
to be linked, and as most runs of two groups name the same two classes, groups
that share many signatures are compared a few times, not once a signature.  A longer run (a passage or line that very many documents share,
or a very large group of near copies) is needed only for classes that have too
few other signatures.  A class that shares more than r of its blocks with
whatever it is linked to may leave out r signatures, if all classes leave out
the last ones of one order (as prefix filters do); that order is short runs and
runs of one group, then long runs from the smallest to the largest.  With n
non-empty blocks r is n - (d + 1), or, where that is more, the largest number
for which d elements dealt over the n blocks leave at most r of them unchanged
with probability below 2**-miss_bits; this speaks of the number of shared
blocks, so it holds whichever are left out.  Here d is that of the class itself
and the largest set it can be linked to in the band.  The classes of a long run
that are left are linked to its centre, the class in most of them, and only what
is in different components after that is compared pair by pair.

*Verify.*  Pairs pass the size and the 1024-bit Hamming bound, then the sets
themselves are compared exactly: 100 * intersection >= 75 * union.

Defined results: null or empty texts have an empty set and link with nothing;
rows that share a ``doc_id`` are one document (their components merge); rows
with a null doc_id get their set size and a null component.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import hash_words, mix64, small_batches, text_bytes, written
from donorlens.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
MISS_BITS = 30
SMALL_RUN = 8
SEEDS = 4  # of each band
SALTS = 4
PIECE = 64  # members of a long run that are exploded together
SKETCH_WORDS = 16  # 1024 bits
_TAG = np.uint64(0xFFF)  # low bits of a signature: band and salt
WEIGHT_BITS = 16  # low bits of a group in the runs: how much of a class others have met


# --- sets ---------------------------------------------------------------------

def shingle_set(data: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words, _, _ = hash_words(data)
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    gram = np.full(n, min(len(words), size), np.uint64)
    for j in range(min(size, len(words))):
        gram = mix64(gram * np.uint64(0x100000001B3) + words[j: j + n])
    return np.unique(gram)


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    total = mix64(elements + np.uint64(0x1234567)).sum(dtype=np.uint64, keepdims=True)
    parity = np.bitwise_xor.reduce(mix64(elements * np.uint64(3) + np.uint64(1)), keepdims=True)
    return int(mix64(total + np.uint64(len(elements))).view(np.int64)[0]), int(parity.view(np.int64)[0])


def bit_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements over 1024 bits, as 16 longs."""
    odd = np.bincount((elements & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


# --- size bands ---------------------------------------------------------------

def band_of(n: int, percent: int = PERCENT) -> int:
    """The smallest band whose upper bound holds n."""
    k = max(0, int(math.log(max(n, 1)) / math.log(100 / percent)) - 1)
    while upper(k, percent) < n:
        k += 1
    return k


def upper(band: int, percent: int = PERCENT) -> int:
    return int((100 / percent) ** band + 1e-9)


def blocks_for(band: int, percent: int = PERCENT, miss_bits: int | None = MISS_BITS) -> tuple[int, int]:
    """(m, need): blocks of a band's sketches, and how many non-empty ones must
    differ for a linked pair to be missed."""
    t = percent / 100
    d = int(2 * upper(band, percent) * (1 - t) / (1 + t) + 1e-9)
    need, m = d + 1, int(1.25 * (d + 1)) + 6
    if miss_bits is not None:
        fewer = 8
        while fewer < d + 1:
            equal = (1 - 1.25 ** -1 / fewer) ** d  # chance that none of d elements falls into one of 1.25 * fewer blocks
            if fewer * -math.log1p(-equal) >= miss_bits * math.log(2):
                need, m = fewer, int(1.25 * fewer) + 1
                break
            fewer += max(1, fewer // 32)
    return m, need


@functools.cache
def _spare_by_elements(n: int, miss_bits: int) -> list[int]:
    """For d = 0, 1, 2, ...: the largest r for which d elements dealt over n
    blocks leave at most r blocks without one with probability below
    2**-miss_bits; ends where there is none."""
    hit, changed, out = np.zeros(n + 1), np.arange(n + 1) / n, []
    hit[0] = 1  # probability of every number of changed blocks
    while not out or out[-1] >= 0:
        out.append(int((np.cumsum(hit[::-1]) < 2.0 ** -miss_bits).sum()) - 1)
        more = hit * (1 - changed)
        hit = hit * changed
        hit[1:] += more[:-1]
    return out


def spare_blocks(n: int, size: int, band: int, percent: int = PERCENT, miss_bits: int | None = MISS_BITS) -> int:
    """How many of its n non-empty blocks a set may leave out in a band,
    whichever they are: it shares more than these with every set it is linked
    to.  Below 0: none, and it may share none."""
    d = (size + min(upper(band, percent), size * 100 // percent)) * (100 - percent) // (100 + percent)
    by_chance = _spare_by_elements(n, miss_bits) if miss_bits is not None else []
    return max(n - d - 1, by_chance[d] if d < len(by_chance) else -1)


def blocks(elements: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, XOR) of the non-empty blocks."""
    if salt:
        elements = np.sort(mix64(elements * np.uint64(2 * salt + 1)))
    number = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return number[first], np.bitwise_xor.reduceat(elements, first)


def signatures(elements: np.ndarray, percent: int, miss_bits: int | None, plan: dict) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set for its own and the next band; and, for both, how
    many of its blocks any choice may leave out without missing a link."""
    own, out, slack = band_of(len(elements), percent), [], []
    for band in (own, own + 1):
        if band not in plan:
            plan[band] = blocks_for(band, percent, miss_bits)
        m, need = plan[band]
        for salt in range(SALTS + 1):
            tag = np.uint64(((band & 0xFF) << 4) | salt)
            if salt == SALTS:  # too few blocks under every salt: one key for all such sets
                out.append((mix64(np.array([band], np.uint64)) & ~_TAG) | tag)
                break
            number, xor = blocks(elements, m, salt)
            out.append((mix64(xor + mix64(number + np.uint64(band * 131071 + salt))) & ~_TAG) | tag)
            if salt == 0:
                slack.append(spare_blocks(len(number), len(elements), band, percent, miss_bits))
            if len(number) >= need:
                break
    return np.concatenate(out), slack


# --- passes over the texts ----------------------------------------------------

SETS = ("doc_id long, variant long, n_shingles long, fp long, fp2 long, own int, slack_own int, slack_next int, sketch array<long>, "
        "seeds array<long>, sigs array<long>")


def smallest_signatures(found: np.ndarray, seeds: int) -> np.ndarray:
    """The ``seeds`` smallest signatures of each band, as unsigned numbers."""
    band = found & np.uint64(0xFF0)
    return np.concatenate([np.sort(found[band == b])[:seeds] for b in np.unique(band)])


def _set_batches(shingle: int, percent: int, miss_bits: int | None, seeds: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict = {}
        seen: set = set()  # classes this task has sent: the signatures of copies are sent once
        names = [c.strip().split(" ")[0] for c in SETS.split(",")]
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), longs, longs, longs]
        for batch in small_batches(batches, 1024):
            cols: list[list] = [[] for _ in kinds]
            for _, data in text_bytes(batch.column("text")):
                e = shingle_set(data, shingle)
                key = fingerprint(e) if len(e) else (0, 0)
                found, slack = signatures(e, percent, miss_bits, plan) if len(e) else (None, [0, 0])
                first = found is not None and key not in seen
                seen.add(key)
                sent = [smallest_signatures(found, seeds).view(np.int64), found.view(np.int64)] if first else [None, None]
                for c, v in zip(cols, (len(e), *key, band_of(len(e), percent), *slack, bit_sketch(e), *sent), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("variant"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return run


RUNS = "long boolean, sig long, members array<long>, reps array<long>, low long, high long"


def representatives(sig: int, members: np.ndarray, groups: np.ndarray, weight_bits: int = 0) -> np.ndarray:
    """The heaviest member of every group, of equal ones another for another
    signature; the first is of the largest group.  The low ``weight_bits`` of
    ``groups`` are the weights."""
    draw = mix64(members.view(np.uint64) ^ mix64(np.array([sig], np.int64).view(np.uint64)))
    weights, groups = groups & ((1 << weight_bits) - 1), groups >> weight_bits
    order = np.lexsort((draw, -weights, groups))
    first = np.flatnonzero(np.concatenate(([True], groups[order][1:] != groups[order][:-1])))
    sizes = np.diff(np.append(first, len(order)))
    return members[order[first]][np.argsort(-sizes, kind="stable")]


def _pack_runs(rows: list[tuple[bool, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    reps = [representatives(sig, members, groups, WEIGHT_BITS) if long else members[:0] for long, sig, members, groups in rows]
    groups = [r[3] >> WEIGHT_BITS for r in rows]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], longs), pa.array(reps, longs),
        pa.array([int(g.min()) for g in groups], pa.int64()), pa.array([int(g.max()) for g in groups], pa.int64())],
        ["long", "sig", "members", "reps", "low", "high"])


class _RunReader:
    """Reads rows (sig, fp, group) sorted by (sig, fp) and gives each run of
    more than one group: whole if small, in chunks if long, with the groups of
    the members (one chunk of a run may hold a single group).  A small run
    that this task has just given is not given again (near copies share most
    signatures).  The low ``weight_bits`` of a group are no part of it."""

    def __init__(self, small_run: int, chunk: int = 4096, weight_bits: int = 0):
        self.small_run, self.chunk, self.weight_bits = small_run, chunk, weight_bits
        self.given: set = set()
        none = np.zeros(0, np.int64)
        self.rest = none, none, none  # rows of a run that may go on
        self.going: int | None = None  # signature of a long run of which a chunk has been given

    def read(self, sig: np.ndarray, fp: np.ndarray, group: np.ndarray, last: bool) -> list[tuple[bool, int, np.ndarray, np.ndarray]]:
        sig, fp, group = (np.concatenate(c) for c in zip(self.rest, (sig, fp, group), strict=True))
        if not len(sig):
            return []
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])))
        sig, fp, group = sig[new], fp[new], group[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        end = np.append(first[1:], len(sig))
        bare = group >> self.weight_bits
        low, high = np.minimum.reduceat(bare, first), np.maximum.reduceat(bare, first)
        rows: list = []
        tail = len(sig) if last else int(first[-1])
        wanted = low < high
        if self.going is not None:
            wanted |= sig[first] == self.going
        if not last:
            wanted[-1] = False
        for a, b in zip(first[wanted].tolist(), end[wanted].tolist(), strict=True):
            self._give(rows, int(sig[a]), fp[a:b], group[a:b])
        if not last and (len(sig) - tail > self.chunk or sig[tail] == self.going):
            self.going = int(sig[tail])
            if len(sig) - tail > 1:
                rows.append((True, self.going, fp[tail:-1], group[tail:-1]))
            tail = len(sig) - 1
        self.rest = sig[tail:], fp[tail:], group[tail:]
        return rows

    def _give(self, rows: list, sig: int, members: np.ndarray, groups: np.ndarray) -> None:
        if sig == self.going or len(members) > self.small_run:
            rows.append((True, sig, members, groups))
            return
        key = hash(members.tobytes())
        if key not in self.given:
            if len(self.given) > 500_000:
                self.given.clear()
            self.given.add(key)
            rows.append((False, sig, members, groups))


def _runs(small_run: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _RunReader(small_run, weight_bits=WEIGHT_BITS)
        for batch in batches:
            if rows := reader.read(*(batch.column(c).to_numpy() for c in ("sig", "fp", "grp")), False):
                yield _pack_runs(rows)
        none = np.zeros(0, np.int64)
        if rows := reader.read(none, none, none, True):
            yield _pack_runs(rows)

    return run


def _verify_batches(shingle: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, last_set = [], None, None
            ids = list(zip(batch.column("a").to_pylist(), batch.column("va").to_pylist(), strict=True))
            for (k, left), (_, right) in zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True):
                if ids[k] != last:
                    last, last_set = ids[k], shingle_set(left, shingle)
                other = shingle_set(right, shingle)
                both = np.concatenate((last_set, other))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    return run


# --- the join -----------------------------------------------------------------

def _near(percent: int) -> Column:
    """Size and Hamming bound of a pair (na, sa), (nb, sb)."""
    n, m = F.greatest("na", "nb"), F.least("na", "nb")
    bits = [F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_WORDS)]  # compiled, unlike an array lambda
    apart = functools.reduce(lambda x, y: x + y, bits)
    return (m * 100 >= n * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


class NgramJaccardJoin:
    """The join over one ``documents`` table (doc_id, text)."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss_bits: int | None = MISS_BITS, small_run: int = SMALL_RUN, seeds: int = SEEDS):
        self.shingle, self.percent, self.miss_bits, self.small_run = shingle, percent, miss_bits, small_run
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("variant"), "text")
        self.sets = written(self.docs.mapInArrow(_set_batches(shingle, percent, miss_bits, seeds), SETS), "sets")
        self.classes = written(
            self.sets.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("fp", "fp2", "n_shingles")
            .agg(F.min(F.struct("doc_id", "variant")).alias("rep"), F.first("own").alias("own"), F.first("slack_own").alias("slack_own"),
                 F.first("slack_next").alias("slack_next"), F.first("sketch").alias("sketch")), "classes")

    def _signature_rows(self, column: str) -> DataFrame:
        """(sig, fp) of every class; copies that different tasks have read repeat it."""
        return self.sets.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL").select(F.explode(column).alias("sig"), "fp")

    @staticmethod
    def _shared(entries: DataFrame) -> DataFrame:
        """(sig, fp, n): the entries of signatures of n > 1 classes."""
        sizes = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sig").alias("size_sig"), "n")
        return written(entries.join(sizes, F.col("sig") == F.col("size_sig")).select("sig", "fp", "n"), "shared")

    @staticmethod
    def _met(shared: DataFrame) -> DataFrame:
        """(met_fp, met): how many classes each one meets, by all its signatures."""
        return shared.groupBy("fp").agg(F.sum("n").alias("met")).select(F.col("fp").alias("met_fp"), "met")

    def _stars(self, entries: DataFrame) -> DataFrame:
        """(fa, fb): the star pairs of (sig, fp)."""
        return self._star_pairs(self._shared(entries))

    def _star_pairs(self, shared: DataFrame) -> DataFrame:
        """(fa, fb): the classes of each signature with its centre, the class
        that most others meet: the least edited one."""
        centre = (shared.join(self._met(shared), F.col("fp") == F.col("met_fp")).groupBy("sig").agg(F.max(F.struct("met", "fp")).alias("centre"))
                  .select(F.col("sig").alias("centre_sig"), F.col("centre.fp").alias("fa")))
        return shared.join(centre, F.col("sig") == F.col("centre_sig")).where("fp <> fa").select("fa", F.col("fp").alias("fb")).distinct()

    def _runs(self, member: DataFrame, met: DataFrame | None = None) -> DataFrame:
        """Runs of classes of more than one group; ``member``: the components
        (node, component) by the seeds, ``met``: of each class, how many others
        it meets by them.  The weight in the low bits of a group is that number
        (256 steps of its logarithm), then one of 256 draws."""
        bare = F.lit(-1 << WEIGHT_BITS)
        linked = self.classes.select("fp", "rep").join(member, F.col("rep.doc_id") == F.col("node"))
        linked = linked.withColumn("met", F.lit(0)) if met is None else linked.join(met, F.col("fp") == F.col("met_fp"), "left")
        step = F.least(F.lit(255), F.floor(F.log2(F.coalesce("met", F.lit(0)) + 1) * 8)).cast("long")
        weight = step * 256 + F.pmod(F.xxhash64(F.lit(9), "fp"), F.lit(256))
        groups = linked.select(F.col("fp").alias("group_fp"), (F.xxhash64(F.lit(7), "component").bitwiseAND(bare) + weight).alias("grp"))
        rows = (self.sets.where("doc_id IS NOT NULL AND sigs IS NOT NULL").select("fp", "sigs").join(groups, F.col("fp") == F.col("group_fp"), "left")
                .select(F.explode("sigs").alias("sig"), "fp", F.coalesce("grp", F.col("fp").bitwiseAND(bare)).alias("grp")))
        runs = written(rows.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(_runs(self.small_run), RUNS), "runs")
        mixed = (runs.where("long").groupBy("sig").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
                 .select(F.col("sig").alias("mixed_sig")))
        return runs.join(mixed, F.col("sig") == F.col("mixed_sig"), "left").where(~F.col("long") | F.col("mixed_sig").isNotNull()).drop("mixed_sig")

    def _short_pairs(self, runs: DataFrame) -> DataFrame:
        """(fa, fb): all pairs of the short runs."""
        i = F.posexplode("members").alias("i", "fa")
        small = runs.where(~F.col("long")).select("members").distinct()
        return small.select("members", i).select("fa", F.explode(F.slice("members", F.col("i") + 2, F.lit(self.small_run))).alias("fb"))

    @staticmethod
    def _between_groups(runs: DataFrame) -> DataFrame:
        """(fa, fb): of each long run, the heaviest member of every group with that of its largest group."""
        long = runs.where("long")
        centre = long.groupBy("sig").agg(F.max_by(F.col("reps")[0], F.size("members")).alias("fa")).select(F.col("sig").alias("centre_sig"), "fa")
        reps = long.select("sig", F.explode("reps").alias("fb")).join(centre, F.col("sig") == F.col("centre_sig"))
        return reps.where("fa <> fb").select("fa", "fb").distinct()

    def _needed(self, runs: DataFrame, member: DataFrame) -> DataFrame:
        """(sig, fp): of the long runs that still hold more than one component
        of ``member``, the entries of the classes that need them."""
        now = self.classes.join(member, F.col("rep.doc_id") == F.col("node")).select(F.col("fp").alias("now_fp"), F.xxhash64(F.lit(7), "component").alias("now"))
        long = runs.where("long").select("sig", "members", "reps")
        reps = (long.select("sig", F.explode("reps").alias("fp")).join(now, F.col("fp") == F.col("now_fp"), "left")
                .groupBy("sig").agg(F.min(F.coalesce("now", "fp")).alias("low"), F.max(F.coalesce("now", "fp")).alias("high")))
        mixed = reps.where("low < high").select(F.col("sig").alias("mixed_sig"))
        sizes = long.groupBy("sig").agg(F.sum(F.size("members")).alias("run_size")).join(mixed, F.col("sig") == F.col("mixed_sig")).select("mixed_sig", "run_size")
        pieces = F.transform(F.sequence(F.lit(0), F.size("members") - 1, F.lit(PIECE)), lambda i: F.slice("members", i + 1, PIECE))
        dealt = (long.join(sizes, F.col("sig") == F.col("mixed_sig")).select("run_size", "sig", F.explode(pieces).alias("members"))
                 .repartition("sig", F.hash("members")))  # a run of very many classes is not one task's
        entries = dealt.select(F.struct("run_size", "sig").alias("run"), F.explode("members").alias("fp"))
        band, salt = F.shiftright(F.col("run.sig").bitwiseAND(0xFF0), 4), F.col("run.sig").bitwiseAND(0xF)
        # a class is in at most as many runs of a band as it has blocks
        lost = entries.groupBy("fp", band.alias("band"), salt.alias("salt")).agg(F.sort_array(F.collect_list("run")).alias("lost"))
        c = self.classes.select(F.col("fp").alias("class_fp"), "own", "slack_own", "slack_next")
        slack = F.when(F.col("band") == F.col("own").bitwiseAND(0xFF), F.col("slack_own")).otherwise(F.col("slack_next"))
        # of the long runs a class keeps only as many as its other ones leave open, the smallest
        spare = F.when(F.col("salt") == 0, F.greatest(slack, F.lit(0))).otherwise(0)
        kept = lost.join(c, F.col("fp") == F.col("class_fp")).select("fp", F.explode(F.slice("lost", 1, F.greatest(F.size("lost") - spare, F.lit(0)))).alias("run"))
        return written(kept.select("run.sig", "fp"), "long-runs")

    def _class_side(self, side: str) -> DataFrame:
        return self.classes.select(F.col("fp").alias(f"fp_{side}"), F.col("rep.doc_id").alias(side), F.col("rep.variant").alias(f"v{side}"),
                                   F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))

    def _texts_of(self, wanted: DataFrame) -> DataFrame:
        """Texts of the wanted (id, v).  Their hashes modulo 2**20, a table
        bounded by that, first keep the other texts out of the shuffle."""
        bucket = F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1 << 20))
        buckets = F.broadcast(wanted.select(bucket.alias("bucket")).distinct())
        near = self.docs.join(buckets, F.pmod(F.xxhash64(F.lit(3), "doc_id", "variant"), F.lit(1 << 20)) == F.col("bucket"), "left_semi")
        return (near.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("variant") == F.col("v")), "left_semi")
                .dropDuplicates(["doc_id", "variant"]))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (a, va, b, vb) of representatives, on the whole texts."""
        pairs = written(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("id"), F.col("va").alias("v")).union(pairs.select("b", "vb")).distinct()
        texts = self._texts_of(written(wanted, "wanted"))  # planned four times below
        both = (pairs.join(texts.toDF("b", "vb", "text_b"), ["b", "vb"]).join(texts.toDF("a", "va", "text_a"), ["a", "va"])
                .select("a", "va", "b", "text_a", "text_b"))
        return both.mapInArrow(_verify_batches(self.shingle, self.percent), "a long, b long, linked boolean").where("linked").select("a", "b").distinct()

    def _linked(self, pairs: DataFrame, member: DataFrame | None) -> DataFrame:
        """Verified links (a, b) of class pairs (fa, fb), of different components of ``member`` only."""
        pairs = written(pairs, "class-pairs")
        named = pairs.join(self._class_side("a"), F.col("fa") == F.col("fp_a")).join(self._class_side("b"), F.col("fb") == F.col("fp_b")).where(_near(self.percent))
        if member is not None:
            for side in "ab":
                of = member.select(F.col("node").alias(f"node_{side}"), F.col("component").alias(f"c{side}"))
                named = named.join(of, F.col(side) == F.col(f"node_{side}"), "left")
            named = named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return self._verified(named.select("a", "va", "b", "vb").distinct())

    def links(self) -> DataFrame:
        """(a, b): verified links between class representatives, enough of
        them to connect every component."""
        return self._connected()[0]

    def _connected(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """All links, the components (node, component) of those found before
        the last comparison, and the links of that (None: there was none)."""
        shared = self._shared(self._signature_rows("seeds").distinct())
        links = written(self._linked(self._star_pairs(shared), None), "links")
        member = connected_components(links, "a", "b")
        runs = self._runs(member, self._met(shared))
        more = written(self._linked(self._short_pairs(runs).union(self._between_groups(runs)).distinct(), member), "links")
        links, member = links.union(more), connected_components(more, "a", "b", member)
        needed = self._needed(runs, member)
        more = written(self._linked(self._stars(needed), member), "links")
        links, member = links.union(more), connected_components(more, "a", "b", member)
        # classes of one long run that are still apart are compared pair by pair
        now = self._class_side("a").join(member, F.col("a") == F.col("node"), "left").select(F.col("fp_a").alias("now_fp"), F.coalesce("component", "a").alias("ca"))
        placed = written(needed.join(now, F.col("fp") == F.col("now_fp")).select("sig", "fp", "ca"), "placed")
        mixed = placed.groupBy("sig").agg(F.min("ca").alias("low"), F.max("ca").alias("high")).where("low < high").select(F.col("sig").alias("mixed_sig"))
        k = (placed.join(mixed, F.col("sig") == F.col("mixed_sig"), "left_semi").join(self._class_side("a"), F.col("fp") == F.col("fp_a"))
             .select("sig", "a", "va", "na", "sa", "ca"))
        k = written(k, "apart")
        late = None
        if not k.isEmpty():
            other = k.select(F.col("sig").alias("sig_b"), F.col("a").alias("b"), F.col("va").alias("vb"), F.col("na").alias("nb"), F.col("sa").alias("sb"), F.col("ca").alias("cb"))
            rest = (k.join(other, (F.col("sig") == F.col("sig_b")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near(self.percent))
                    .select("a", "va", "b", "vb").distinct())
            late = written(self._verified(rest), "links")
            links = links.union(late)
        return links, member, late

    def documents(self) -> DataFrame:
        """Per input row: doc_id, n_shingles, component_id."""
        members = (self.sets.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "fp", "fp2", "n_shingles")
                   .join(self.classes.select("fp", "fp2", "n_shingles", F.col("rep.doc_id").alias("rep")), ["fp", "fp2", "n_shingles"]))
        same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        _, member, late = self._connected()
        component = connected_components(same if late is None else late.union(same), "a", "b", member)
        return (self.sets.select("doc_id", "n_shingles").join(component, F.col("doc_id") == F.col("node"), "left")
                .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
