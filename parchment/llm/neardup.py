"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, in_arrow, shingle_hashes, slices, stash, unstash, word_hashes
from .graph import components

#: Two collections of KEYS keys of ROWS minhashes each. A table is a pair of keys, one of each collection: KEYS ** 2 tables
#: of 2 * ROWS minhashes out of 2 * KEYS * ROWS computed ones. A pair of similarity s is missed with probability
#: 1 - (1 - (1 - s ** ROWS) ** KEYS) ** 2, or 0.0004 at 0.8.
KEYS, ROWS = 12, 3
#: Members of a bucket that are compared with others of it in the first round after the leader's; GROWTH times so many in each later one.
LEADERS, GROWTH = 16, 16
#: Members of a bucket in one block, about; its leaders go to each.
BLOCK = 4096
#: Documents that share a bucket with others get a sketch of SKETCH more minhashes, a bit of each. Sets are fetched only for
#: pairs whose sketches differ in at most DIFFER bits. At similarity 0.8 a tenth of the bits differ, 102 with a deviation of
#: 10, and more than DIFFER with a probability of 0.00001; at 0.65 one pair in 500 passes.
SKETCH, DIFFER = 1024, 144
LONGS = SKETCH // 64
_BLOCK = 1 << 14


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_XOR, _ODD = _seeds(2 * KEYS * ROWS)
_XOR_S, _ODD_S = _seeds(2 * KEYS * ROWS + SKETCH)
_MIXER = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.random.default_rng(7).integers(0, 2**63, (2 * KEYS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of k words (64 bits: two shingles of one text coincide once in about 10 ** 11 long texts)."""
    return np.unique(shingle_hashes(word_hashes(ascii_words(text)), k))


def minhashes(shingles: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    least = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    block = max(1, _BLOCK * 64 // len(xor))
    for at in range(0, len(shingles), block):
        part = (shingles[None, at : at + block] ^ xor[:, None]) * odd[:, None]
        least = np.minimum(least, part.min(axis=1))
    return least


def sub_keys(least: np.ndarray) -> np.ndarray:
    """The 2 * KEYS keys of a set's minhashes, as signed longs."""
    folded = ((least >> np.uint64(3)).reshape(2 * KEYS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (folded ^ (folded >> np.uint64(29))).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit of each of SKETCH minhashes, in LONGS signed longs."""
    least = minhashes(shingles, _XOR_S[-SKETCH:], _ODD_S[-SKETCH:])
    return np.packbits(((least * _MIXER) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n (size of the set), its digest and keys for rows (id, text); the last two are null for an empty set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            n, digests, keys = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                digests.append(_digest(s))
                keys.append(sub_keys(minhashes(s)) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs)], names=["id", "n", "digest", "keys"])

    return in_arrow(docs, run, f"id {kind}, n long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, digest, n, the set of rows (id, text), array<long>, and its sketch s0, s1, ..."""
    kind = docs.schema["id"].dataType.simpleString()
    names = [f"s{i}" for i in range(LONGS)]

    def run(batches):
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, k) for t in batch["text"].to_pylist()]
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), LONGS)
            columns = [batch["id"], pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *(pa.array(c) for c in sketches.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "set", *names])

    return in_arrow(docs, run, f"id {kind}, digest binary, n long, set array<long>, {', '.join(f'{x} long' for x in names)}")


def _tables(reps: DataFrame) -> DataFrame:
    """(key, half, id): the tables that documents are in, with the number of the key's first half; only those where both halves are shared with some document."""
    rows = stash(reps.select("id", F.posexplode("keys").alias("at", "key")))
    shared = stash(rows.groupBy("at", "key").agg(F.count("*").alias("c")).filter("c > 1").select("at", "key"))
    own = rows.join(shared, ["at", "key"]).groupBy("id").agg(F.collect_set(F.struct("at", "key")).alias("k"))
    first, second = F.filter("k", lambda x: x["at"] < KEYS), F.filter("k", lambda x: x["at"] >= KEYS)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(F.xxhash64(a["at"], a["key"], b["at"], b["key"]).alias("key"), a["at"].cast("byte").alias("half")))))
    out = stash(own.select("id", F.explode(pairs).alias("e")).select("e.key", "e.half", "id"))
    unstash(rows, shared)
    return out


def _plausible(percent: int) -> Column:
    """Whether the sets of a and b can be similar enough, by their sizes (exactly) and sketches."""
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}")))
    n, m = F.col("a.n"), F.col("b.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= DIFFER)


def _first_meeting() -> Column:
    """Whether a and b share a key of the second collection and none of the first before this one: a pair is met there alone."""
    alike = lambda at: F.zip_with(F.slice("a.keys", at, KEYS), F.slice("b.keys", at, KEYS), lambda x, y: x == y)
    return (F.array_position(alike(1), True) == F.col("a.half") + 1) & F.exists(alike(KEYS + 1), lambda x: x)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, n, m), a below b, of rows with both sides."""
    swap = F.col("a.id") < F.col("b.id")
    ends = [F.when(swap, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for x, y, c, name in (("a", "b", "id", "a"), ("b", "a", "id", "b"), ("a", "b", "n", "n"), ("b", "a", "n", "m"))]
    return rows.select(*ends).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, n, m) whose sets have 100 * intersection >= percent * union."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("of_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("of_b")), "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return joined.filter(100 * both >= percent * (F.col("n") + F.col("m") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component and kept for each row of docs: groups of documents linked by similar shingle sets.

    Equal sets meet by their digest, and one document stands for them. Of the others, those that share a key of both
    collections meet in tables (see KEYS). In each table's bucket the smallest document is compared with the rest. Members
    of buckets that still hold several components go on, by the first halves of their keys, each half with all its members
    in one bucket: LEADERS members outside the component that was the largest at first are compared with the members of
    other components that they share a table with, and no first half before, then GROWTH times as many, until no member is
    left. So every pair of different components that shares a table is met once; groups of copies cost a row a copy, and
    large buckets are dealt out in blocks. All comparisons are of full sets; sizes too different to be similar are left out exactly.

    Null, empty and blank texts have no shingles, no links, and are kept. Rows with a null id are kept, with a null
    component. Rows that repeat an id count as one document: of different texts, the one with the least digest is compared,
    and all rows of the id get its component. Texts of any length are taken whole. An empty table gives an empty one. Other
    columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sig = stash(signatures(rows, shingle))
    known = sig.filter("id is not null and digest is not null").select("id", "digest", "keys")
    several = stash(known.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most").select("id", "least"))
    known = known.join(several, "id", "left").filter("least is null or digest = least").drop("least")
    copies = stash(known.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("digest", "rep"))
    places = known.join(copies, "digest", "left").withColumn("rep", F.coalesce("rep", "id"))
    reps = stash(places.filter("id = rep").select("id", "keys").dropDuplicates(["id"]))
    tables = _tables(reps)
    buckets = stash(tables.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").drop("last"))
    met = stash(tables.join(buckets, "key"))
    needed = stash(met.select("id").distinct())
    sets = shingle_sets(rows.join(needed, "id", "left_semi"), shingle).join(several, "id", "left").filter("least is null or digest = least")
    sets = stash(sets.drop("least", "digest").dropDuplicates(["id"]))
    unstash(tables, buckets, needed)

    light = sets.drop("set")
    stars = met.filter("id <> leader").select(F.col("leader").alias("x"), F.col("id").alias("y")).distinct()
    stars = stars.join(light.alias("a"), F.col("x") == F.col("a.id")).join(light.alias("b"), F.col("y") == F.col("b.id"))
    links = stash(_verified(_pairs(stars.filter(_plausible(percent))), sets, percent))
    groups = stash(components(links))

    def labelled(frame: DataFrame) -> DataFrame:
        return frame.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    opened = labelled(met.select("key", "id")).groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    halves = met.join(opened, "key").select("id", "half").distinct()
    members = stash(halves.join(reps, "id").join(light, "id").withColumn("key", F.xxhash64("half", F.col("keys")[F.col("half")])))
    # All pairs of different components are met if every member outside one component leads once. That component (the anchor's, the
    # largest at first) and the members' turns stay the same through all rounds, however components merge.
    parts = labelled(members.select("key", "id")).groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"))
    fixed = stash(parts.select("key", F.col("main.component").alias("anchor"), (F.col("all") - F.col("main.c")).alias("others"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")).filter("others > 0"))
    unstash(met)
    low, high = 0, LEADERS
    while True:
        now = stash(labelled(members.select("key", "id")))
        mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
        anchors = groups.select(F.col("node").alias("anchor"), F.col("component").alias("main"))
        open_keys = stash(fixed.filter(F.col("others") > low).join(mixed, "key").join(anchors, "anchor", "left").select("key", F.coalesce("main", "anchor").alias("main"), "others", "blocks"))
        if open_keys.isEmpty():
            unstash(open_keys, now)
            break
        rest = now.join(open_keys, "key").withColumn("turn", F.pmod(F.xxhash64("key", "id"), F.col("others"))).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
        rest = stash(rest.join(members, ["key", "id"]))
        leaders = rest.filter((F.col("component") != F.col("main")) & (F.col("turn") >= low) & (F.col("turn") < high))
        leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "block")]
        meet = leaders.alias("a").join(rest.alias("b"), same[0] & same[1] & (F.col("a.component") != F.col("b.component")) & _plausible(percent) & _first_meeting())
        more = stash(_verified(_pairs(meet), sets, percent))
        if not more.isEmpty():
            links, old = stash(links.union(more)), links
            unstash(old, groups)
            groups = stash(components(links))
        unstash(now, open_keys, rest, more)
        low, high = high, GROWTH * high
    unstash(reps, members, sets, links, fixed)

    out = sig.filter("digest is not null and id is not null").join(several, "id", "left").withColumn("digest", F.coalesce("least", "digest")).join(copies, "digest", "left")
    out = out.select("id", "n", F.coalesce("rep", "id").alias("rep")).unionByName(sig.filter("digest is null or id is null").select("id", "n", F.col("id").alias("rep")))
    out = out.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
