"""MinHash near-duplicate classes: tensored banding, exact verification on full shingle sets, components.

Method.  A document's set holds its distinct k-word shingles.  Two collections of ``bands`` half keys each are made from
``rows`` minhashes per half key.  Table (i, j) has the key (i-th half key of the first collection, j-th of the second):
bands ** 2 tables of 2 * rows minhashes cost 2 * bands * rows minhashes instead of 2 * bands ** 2 * rows, about the
square root.  A pair of similarity s meets in a table with probability (1 - (1 - s**rows)**bands)**2; with the defaults
16 and 3 a pair at 0.85 is missed with 5e-7, and closer pairs far less.  Candidates are verified by the size of the
intersection of their full sets (64-bit XXH64 values of the shingles), in whole numbers.

Scale.  Equal sets collapse to one row by an aggregate before anything is keyed.  A table key is only formed from half
keys that another set shares (the others can't meet), so most documents leave after 2 * bands small rows.  No bucket is
gathered in a task and no bucket emits all its pairs: buckets are aggregates (smallest member, count), joined back with
hot keys split off.  First every set is verified against the smallest member of its buckets, which makes one
class of the copies of a text at linear cost.  Buckets that then still hold several classes measure each member against
the bucket's smallest member, the pivot.  Jaccard distance is a metric, so two members can only link if their distances
to the pivot differ by at most the threshold's distance; two sets differ in at least as many shingles as their parity
bitmaps differ in bits; and only pairs across classes matter.  Members outside the bucket's largest class meet the others
under these bounds, each pair once.  No pair of a bucket is left out except by such a bound (all are exact) or because its
class is already one.

Edge cases.  Fewer than k words: the whole sequence is the one shingle.  Null, empty or blank text: size 0, linked with
nothing.  Repeated rows stay as rows.  A null id stays a row and is the smallest id of a class only if all are null.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import scratch_path

from .common import field_type, inner_join_skewed, left_join_skewed, stored
from .components import connected_components
from .simhash import shingle_hashes

BANDS, ROWS = 16, 3
ID_BITS = 1 << 26       # fixed size of the bitmap of wanted ids: 8 MB, whatever the data
PAIRS_PER_SALT = 2000   # pairs that meet one copy of a set
PARITY_WORDS = 8        # 64-bit words of a set's parity bitmap
_CHUNK = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class HalfKeys:
    """2 * bands half keys of a set, each of ``rows`` minhashes; the first ``bands`` are the first collection."""

    def __init__(self, bands: int, rows: int):
        rnd = np.random.default_rng(12)
        n = 2 * bands * rows
        self.shape = (2 * bands, rows)
        self.mul = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rnd.integers(0, 1 << 63, n, np.uint64)
        self.salt = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(hashes), _CHUNK):
            part = (hashes[None, i:i + _CHUNK] * self.mul[:, None] + self.add[:, None]).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        low, key = low.reshape(self.shape), self.salt
        for r in range(self.shape[1]):
            key = mix(key ^ low[:, r]) + self.salt
        return key


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, k))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit, so bitmaps of two sets differ in at most as many bits as the sets in shingles."""
    bits = np.bincount((hashes % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view("<i8")


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, sid, halves): set size, 128-bit digest of the set and its half keys."""
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("n", T.LongType()),
                           T.StructField("sid", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType()))])

    def run(batches):
        half = HalfKeys(bands, rows)
        for b in batches:
            n, sid, keys = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                sid.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append(half(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "sid", "halves"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def tensor_keys(distinct: DataFrame, bands: int) -> DataFrame:
    """(key, sid, n): the table keys of each set whose two half keys both occur in another set too.  The lowest 16 bits of
    a key are the numbers i and j of its table."""
    half = distinct.select("sid", F.posexplode("halves").alias("pos", "key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = inner_join_skewed(half, shared, "key", "c", distinct.count() * 2 * bands)
    mask = met.groupBy("sid").agg(F.sort_array(F.collect_set("pos")).alias("pos"))         # at most 2 * bands numbers
    pairs = distinct.join(mask, "sid").withColumn("keys", F.expr(f"""
        flatten(transform(filter(pos, i -> i < {bands}), i -> transform(filter(pos, j -> j >= {bands}),
                j -> (xxhash64(halves[i], halves[j]) & -65536L) | ((i << 8) | (j - {bands})))))"""))
    return pairs.select(F.explode("keys").alias("key"), "sid", "n")


def _big_enough(a: str, b: str, min_pct: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return F.least(a, b) * F.lit(100) >= F.greatest(a, b) * F.lit(min_pct)


def _wanted_ids(distinct: DataFrame, sids: DataFrame) -> dict[int, bytes]:
    """Slices of a bitmap over hashed ids; at most ID_BITS / 8 bytes reach the driver."""
    at = F.pmod(F.xxhash64("first"), F.lit(ID_BITS))
    bits = distinct.join(sids, "sid", "left_semi").select(at.alias("at"))
    slices = bits.groupBy(F.expr("at div 32768").cast("int").alias("part")).agg(
        F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    return {r["part"]: bytes(r["bits"]) for r in slices.collect()}


def full_sets(docs: DataFrame, distinct: DataFrame, sids: DataFrame, id_col: str, text_col: str, k: int, bands: int,
              rows: int) -> DataFrame:
    """(sid, shingles, parity, marks) of the listed sets, from the texts of one document each (a bitmap passes over the
    others); marks are the lowest 32 bits of the half keys.  A table bucketed by sid, so joins on sid don't move it."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_wanted_ids(distinct, sids))

    def run(batches):
        bitmap, half = wanted.value, HalfKeys(bands, rows)
        for b in batches:
            sid, sets, bits, marks = [], [], [], []
            for t, at in zip(b.column(0), b.column(1).to_pylist()):
                part = bitmap.get(at >> 15)
                if part is None or not part[(at & 32767) >> 3] >> (at & 7) & 1:
                    continue
                s = shingle_set(t.as_py(), k)
                if len(s):
                    sid.append(xxhash.xxh128_digest(s.tobytes()))
                    sets.append(s.view(np.int64))
                    bits.append(parity(s))
                    marks.append(half(s).astype(np.uint32).view(np.int64))
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (sets, bits, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), *longs], ["sid", "shingles", "parity", "marks"])

    at = F.pmod(F.xxhash64(id_col), F.lit(ID_BITS))
    made = docs.select(F.col(text_col).cast("string").alias("t"), at.alias("at")).mapInArrow(
        run, "sid binary, shingles array<long>, parity array<long>, marks array<long>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = made.join(sids, "sid", "left_semi").dropDuplicates(["sid"]).repartition(parts, "sid")
    name, path = f"mh_sets_{uuid.uuid4().hex}", scratch_path(spark, "mh-sets")
    one.write.format("parquet").bucketBy(parts, "sid").option("path", path).saveAsTable(name)
    return spark.table(name)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, an, b, bn, inter): the pairs' intersection sizes.  Pairs move to the bucketed sets; sets with PAIRS_PER_SALT pairs
    or more are copied once per that many pairs instead, so no task gets all pairs of one set."""
    pairs = stored(pairs, "mh-pairs")
    sets = sets.select("sid", "shingles")
    many = [pairs.groupBy(F.col(x).alias("sid")).agg(F.count("*").alias("c")).where(f"c >= {PAIRS_PER_SALT}") for x in "ab"]
    named = [m.select(F.col("sid").alias(x), F.col("c").alias(f"{x}c")) for x, m in zip("ab", many)]
    marked = stored(pairs.join(named[0], "a", "left").join(named[1], "b", "left"), "mh-marked")
    cold, hot = marked.where("ac is null and bc is null"), marked.where("ac is not null or bc is not null")
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long").alias("inter")

    def side(x: str, table: DataFrame) -> DataFrame:
        return table.select(F.col("sid").alias(x), F.col("shingles").alias(f"{x}_set"), *[c for c in ("salt",) if c in table.columns])

    out = cold.join(side("a", sets), "a").join(side("b", sets), "b").select("a", "an", "b", "bn", shared)
    copied = hot
    for x, other in ("ab", "ba"):
        need = hot.groupBy(F.col(x).alias("sid")).agg(F.first(F.coalesce(f"{x}c", F.lit(0))).alias("c"))
        copies = sets.join(need, "sid").select("sid", "shingles", F.explode(
            F.sequence(F.lit(0), F.expr(f"cast(c div {PAIRS_PER_SALT} as int)"))).alias("salt"))
        salt = F.pmod(F.xxhash64(other), F.expr(f"coalesce({x}c, 0) div {PAIRS_PER_SALT} + 1")).cast("int")
        copied = copied.withColumn("salt", salt).join(side(x, copies), [x, "salt"]).drop("salt")
    return out.unionByName(copied.select("a", "an", "b", "bn", shared))


def _links(results: DataFrame, min_pct: int) -> DataFrame:
    return results.where(F.col("inter") * 100 >= (F.col("an") + F.col("bn") - F.col("inter")) * min_pct).select("a", "b")


def _mixed(rows: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """The rows of buckets with several classes, with their class and whether it is the bucket's largest."""
    known = rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    classes = known.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = classes.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("major"), F.count("*").alias("m"),
                                       F.sum("c").alias("c")).where("m > 1").drop("m")
    return inner_join_skewed(known, mixed, "key", "c", total).withColumn("is_major", F.expr("root = major")).drop("major")


def set_classes(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, k: int, min_pct: int,
                bands: int, band_rows: int) -> DataFrame:
    """(node, root): every set with a partner, and the smallest set of its class."""
    tensor = stored(tensor_keys(distinct, bands), "mh-tensor")
    size = tensor.count()
    hubs = tensor.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    rows = stored(inner_join_skewed(tensor, hubs, "key", "c", size).select("key", "sid", "n", F.col("hub.sid").alias("hub"),
                                                                         F.col("hub.n").alias("hn")), "mh-rows")
    sets = full_sets(docs, distinct, rows.select("sid").distinct(), id_col, text_col, k, bands, band_rows)

    near = F.expr("sid != hub") & _big_enough("n", "hn", min_pct)
    named = [F.col("sid").alias("a"), F.col("n").alias("an"), F.col("hub").alias("b"), F.col("hn").alias("bn")]
    low = rows.where(near).groupBy("sid", "n").agg(F.min(F.struct("hub", "hn")).alias("h")).select("sid", "n", "h.*")
    first = stored(verified(low.select(*named), sets), "mh-first")
    roots = stored(connected_components(_links(first, min_pct)), "mh-roots")

    mixed = stored(_mixed(rows, roots, size).drop("root", "is_major"), "mh-mixed")
    todo = mixed.where(near).select(*named).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    pivots = stored(first.unionByName(verified(todo.select("a", "an", "b", "bn"), sets)), "mh-pivots")
    links = _links(pivots, min_pct)
    roots = stored(connected_components(links), "mh-roots")

    far = stored(verified(_across(_mixed(mixed, roots, size), pivots, sets, min_pct, bands), sets), "mh-far")
    links = links.unionByName(_links(far, min_pct))
    return connected_components(links)


def _across(mixed: DataFrame, pivots: DataFrame, sets: DataFrame, min_pct: int, bands: int) -> DataFrame:
    """(a, an, b, bn): pairs of one bucket and two classes that neither the distances to the pivot nor the parities rule out.
    A pair is made in the first table that both sets share (told by 32 bits of each half key, so with an error far below
    that of the banding), not in all of them."""
    exact = F.expr("1 - inter / (an + bn - inter)")
    known = mixed.join(pivots.select(F.col("a").alias("sid"), F.col("b").alias("hub"), exact.alias("d")), ["sid", "hub"], "left")
    least = F.lit(1.0) - F.least("n", "hn") / F.greatest("n", "hn")     # of sizes too unlike to be measured
    words = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)] + [F.col("marks")[i].alias(f"m{i}") for i in range(bands)]
    known = known.where("sid != hub").join(sets.select("sid", *words), "sid").select(
        "key", "sid", "n", "root", "is_major", F.coalesce("d", least).alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"),
        *[f"p{i}" for i in range(PARITY_WORDS)], *[f"m{i}" for i in range(bands)])
    known = stored(known, "mh-known")
    unlike = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    may_differ = (F.col("x.n") + F.col("y.n")) * (100 - min_pct)          # 100 + min_pct times as many shingles
    reach = 1 - min_pct / 100 + 1e-9

    def first_shared(start: int, number: Column) -> Column:
        """Whether the collection of half keys from ``start`` on agrees first at ``number``."""
        first = F.lit(-1)
        for i in reversed(range(bands)):
            word, shift = divmod(start + i, 2)
            differ = F.col(f"x.m{word}").bitwiseXOR(F.col(f"y.m{word}"))
            half = differ.bitwiseAND(F.lit(0xFFFFFFFF)) if not shift else F.shiftrightunsigned(differ, 32)
            first = F.when(half == 0, F.lit(i)).otherwise(first)
        return first == number

    x, y = known.where("not is_major").alias("x"), known.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
                   & (F.col("y.is_major") | (F.col("x.sid") < F.col("y.sid"))) & _big_enough("x.n", "y.n", min_pct)
                   & (F.col("x.lo") - F.col("y.hi") <= reach) & (F.col("y.lo") - F.col("x.hi") <= reach) & (unlike * (100 + min_pct) <= may_differ))
    pairs = pairs.where(first_shared(0, F.expr("(x.key >> 8) & 255")) & first_shared(bands, F.expr("x.key & 255")))
    one, two = F.struct("x.sid", "x.n"), F.struct("y.sid", "y.n")
    ends = pairs.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q")).distinct()
    return ends.select(F.col("p.sid").alias("a"), F.col("p.n").alias("an"), F.col("q.sid").alias("b"), F.col("q.n").alias("bn"))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, min_pct: int = 85,
                   bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component): every row with its set size and the smallest id its links reach, its own included.

    Two sets link if 100 * intersection >= min_pct * union.
    """
    prints = stored(sketches(docs, id_col, text_col, k, bands, rows), "mh-prints")
    distinct = stored(prints.where("n > 0").groupBy("sid").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("halves").alias("halves")),
        "mh-distinct")
    roots = set_classes(docs, distinct, id_col, text_col, k, min_pct, bands, rows)
    member = distinct.select("sid", "first", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    member = stored(member, "mh-member")
    low = member.where("root is not null").groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("c"))
    joined = left_join_skewed(member, low, "root", "c", member.count())
    label = stored(joined.where("copies > 1 or root is not null").select(
        "sid", "copies", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")).alias("component")), "mh-label")
    out = left_join_skewed(prints.select("id", "n", "sid"), label, "sid", "copies", prints.count())
    alone = F.col("component").isNull()     # also a class of null ids only
    return out.select("id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, n_shingles, component, kept): kept marks the class's smallest id (null ids without any other are kept)."""
    return minhash_groups(docs, id_col, text_col, **settings).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
