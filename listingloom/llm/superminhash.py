"""Near-duplicate documents by SuperMinHash signatures, bands, verification and union-find.

Every shingle of a set draws one random permutation of the signature's places and visits them in
that order; at its step j it offers j plus a random fraction, and each place keeps the least offer.
As a shingle that is early at one place is late at the others, values of a signature are negatively
correlated and estimates vary less than those of independent hashes. A set is done once no
step to come can be less than its greatest value.

Signatures are cut into bands; sets that agree on all rows of a band share a bucket. Two sets with
a Jaccard index of 0.8 miss each other in all ``BANDS`` buckets with a probability of
(1 - 0.8^ROWS)^BANDS = 4e-7, more similar ones less. Buckets are worked off in rounds: some members
are held, as leaders, against all members that aren't yet known to be in their group, by the full
sets. A leader is then done with; so every pair of a bucket is either verified or already in one
group, while a large bucket of near copies needs a few leaders only. What large buckets still hold
after the first round, mostly documents that share a passage, meets anew by the rarest shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.components import linked_in_rounds
from listingloom.llm.tables import by_slices, maybe_in, shuffled64, stored

SHINGLE = 4
#: Least Jaccard index of a link, in hundredths.
PERCENT = 80
ROWS = 4
BANDS = 28
#: Bands whose large buckets are worked off first; copies of a group mostly meet there.
EARLY = 2
#: Words of a set's parity: a bit per class of hashes, set where their number in the set is odd. Members
#: of bands have it folded to FOLDED words; what is left for the rarest shingles has all of it.
PARITY = 16
FOLDED = 4
_PARITIES = [f"p{i}" for i in range(PARITY)]
_GOLDEN = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_MAX = np.iinfo(np.uint64).max


def shingle_sets(texts: list[str | None], known: dict[bytes, int], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text, A-Z in lower case.

    A text of fewer words has one shingle, of all its words; one without words has none.
    ``known`` remembers the hashes of words.
    """
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            for w in {w for w in words if w not in known}:
                known[w] = xxhash.xxh64_intdigest(w, seed=12)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            width = min(shingle, len(words))
            mixed = np.full(len(words) - width + 1 if width else 0, width, np.uint64)
            for k in range(width):
                mixed = mixed * np.uint64(_GOLDEN) + h[k : k + len(mixed)]
            out.append(np.unique(shuffled64(mixed)))
    return out


def signatures_of(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row per set: ``size`` values, the step in the high and the fraction in the low 32 bits.

    Sets must not be empty.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    least = np.full((len(sets), size), _MAX, np.uint64)
    flat = least.reshape(-1)
    order: np.ndarray | None = None  # of each shingle: the places not yet visited, from column j on
    for j in range(size):
        with np.errstate(over="ignore"):
            z = shuffled64(x + np.uint64(_GOLDEN * (j + 1) & _MAX))
        k = j + ((z >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        each = np.arange(len(x))
        if order is None:
            place = k
        else:
            place = order[each, k].astype(np.int64)
            order[each, k] = order[:, j]
        np.minimum.at(flat, owner * size + place, (z & _LOW) | np.uint64(j << 32))
        going = (least.max(axis=1) >= np.uint64((j + 1) << 32))[owner]
        if order is None:
            owner, x, k = owner[going], x[going], k[going]
            order = np.tile(np.arange(size, dtype=np.uint16), (len(x), 1))
            order[np.arange(len(x)), k] = 0
        elif not going.all():
            owner, x, order = owner[going], x[going], order[going]
        if not len(x):
            break
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of each signature, different for different bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
        for r in range(rows):
            key = shuffled64(key * np.uint64(_GOLDEN) + parts[:, :, r])
    return key.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``PARITY`` words per set. Those of two sets differ in no more bits than the sets in hashes."""
    bits = np.zeros((len(sets), PARITY * 64), np.uint8)
    for row, hashes in zip(bits, sets):
        row[:] = np.bincount((hashes >> np.uint64(8)).astype(np.int64) % len(row), minlength=len(row)) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def signatures(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``keep`` columns, a number ``row`` of the row's own, its set and the keys of its bands.

    ``n`` is the size of the set, ``s1, s2`` 128 bits that name it, ``p0`` and so on its parity,
    ``shingles`` its hashes in order. Without words ``n`` is 0 and there are no bands. Row numbers are made by the task that
    reads the row: to be stored before use.
    """

    def start() -> Callable[..., list]:
        known: dict[bytes, int] = {}
        task = TaskContext.get()
        done = (task.partitionId() if task else 0) << 33

        def work(texts: list[str | None]) -> list:
            nonlocal done
            if len(known) > 1_000_000:
                known.clear()
            sets = shingle_sets(texts, known, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures_of([sets[i] for i in full], bands * rows), bands, rows)
            names = np.array([list(memoryview(xxhash.xxh3_128_digest(s.tobytes())).cast("q")) for s in sets], np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            numbers = np.arange(done, done + len(sets))
            done += len(sets)
            lists = lambda sizes, values: pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values)
            )
            return [
                pa.array(numbers), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]),
                *(pa.array(word) for word in parities(sets).T.copy()),
                lists(bands * (n > 0), keys.reshape(-1)),
                lists(n, np.concatenate(sets).view(np.int64)),
            ]

        return work

    words = "".join(f"{name} bigint, " for name in _PARITIES)
    added = f"row bigint, n bigint, s1 bigint, s2 bigint, {words}bands array<bigint>, shingles array<bigint>"
    return by_slices(docs, keep, added, start)


def _compatible(one: Callable[[str], Column], other: Callable[[str], Column], percent: int) -> Column:
    """Whether sets may be that similar by their sizes, and by what comes from their key on.

    Negative bands are places in the order of shingles. At the first shingle that two sets share they
    have at most as many in common as either has from there on, and a similar pair shares its
    first one among the rarest, so it is found there if at no other key.
    """
    reach = lambda side: side("n") - F.greatest(F.lit(0), -side("band") - 1)
    return (100 + percent) * F.least(reach(one), reach(other)) >= percent * (one("n") + other("n"))


def _near_parity(one: Callable[[str], Column], other: Callable[[str], Column], percent: int) -> Column:
    """Whether sets may be that similar. With a union of u hashes and d that are in one set only,
    100 * d <= (100 - percent) * u and 2 * u = sizes + d, so (100 + percent) * d <= (100 - percent) * sizes."""
    odd = sum((F.coalesce(F.bit_count(one(p).bitwiseXOR(other(p))), F.lit(0)) for p in _PARITIES), F.lit(0))
    return odd * (100 + percent) <= (100 - percent) * (one("n") + other("n"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (u, v and more) those whose ``sets`` (node, shingles) are similar enough."""
    side = lambda name, own: sets.select(F.col("node").alias(name), F.col("shingles").alias(own))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select(pairs.columns)


def similar_groups(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int = PERCENT) -> DataFrame:
    """``node, root`` of all ``nodes`` (node, n, bands, parity) that are linked to another; root is the least.

    ``sets`` gives, for a table of some ``node``, their ``shingles``.
    """
    known = ["node", "n", *_PARITIES]
    folds = [reduce(Column.bitwiseXOR, (F.col(p) for p in _PARITIES[i::FOLDED])).alias(_PARITIES[i]) for i in range(FOLDED)]
    none = [F.lit(None).cast("long").alias(p) for p in _PARITIES[FOLDED:]]
    keyed = nodes.select("node", "n", *folds, *none, F.posexplode("bands").alias("band", "key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "shared")
    members = stored(maybe_in(keyed, "key", shared).join(shared, "key"), "shared")
    hashes = stored(sets(members.select("node").distinct()), "sets")

    def rarest(left: DataFrame) -> DataFrame:
        """Their rarest shingles as keys: similar sets share one of the first n - ceil(n * percent) + 1.

        That holds in any order of shingles. In this one a passage that many documents share comes
        last, so those that share nothing else don't meet again.
        """
        own = nodes.select(known).join(left.select("node", "root").distinct(), "node")
        own = stored(own, "left")
        each = hashes.join(own.select("node", "n"), "node").select("node", "n", F.explode("shingles").alias("key"))
        often = each.groupBy("key").agg(F.count("*").alias("_often"))
        order = F.row_number().over(Window.partitionBy("node").orderBy("_often", "key"))  # a set's own shingles
        first = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
        some = each.join(often, "key").withColumn("_at", order).where(F.col("_at") <= first)
        return some.select("node", "key", (-F.col("_at")).alias("band")).join(own, "node")

    return linked_in_rounds(
        members,
        lambda one, other: _compatible(one, other, percent) & _near_parity(one, other, percent),
        lambda pairs: verified(pairs, hashes, percent),
        F.col("band") < EARLY,
        rarest,
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if the Jaccard index of their sets of word shingles is ``percent``
    hundredths or more; the least id that can be reached over links names a group, and its
    document is kept. Rows with equal sets meet before anything is compared, so repeated rows and
    ids need no special care: all rows of an id that names its group are kept. Null, empty and
    white texts have no shingles and are linked with nothing; each is a group of its own. A null id
    names no group unless it has no other, and isn't kept then. An empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = stored(signatures(docs, ["doc_id"]), "signatures")
    nodes = stored(
        rows.where("n > 0").groupBy("s1", "s2").agg(
            F.min("doc_id").alias("first"), F.min("row").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            *(F.first(p).alias(p) for p in _PARITIES),
        ),
        "nodes",
    )

    def sets(wanted: DataFrame) -> DataFrame:
        hashed = F.xxhash64("node").alias("_hash")  # numbers of rows are alike in their low bits
        some = rows.select(F.col("row").alias("node"), "shingles").select("*", hashed)
        return maybe_in(some, "_hash", wanted.select(hashed)).drop("_hash").join(wanted, "node", "left_semi")

    groups = similar_groups(nodes.select("node", "n", *_PARITIES, "bands"), sets, percent)
    own = nodes.select("s1", "s2", "first", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = stored(own, "named")
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = own.join(least, "root").select("s1", "s2", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"])
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    result = some.select("doc_id", "n", "component_id").unionByName(none)
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
