"""JSON, geo, bitmap, sketch, expiry, keyspace and atomic commands."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import geo_hash, geo_place, geo_score, glob, haversine, live


def json_get(jd: DataFrame, path: str) -> DataFrame:
    return jd.select("key", F.get_json_object("doc", path).alias("value"))


def json_type(jd: DataFrame, path: str) -> DataFrame:
    """Type of a value: integer and number are apart."""
    v = F.variant_get(F.try_parse_json("doc"), path, "variant")
    s = F.schema_of_variant(v)
    kind = F.when(s == "BIGINT", "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    return jd.select("key", kind.alias("type"))


def json_numincrby(jd: DataFrame, field: str, n: int) -> DataFrame:
    return jd.select("key", (F.get_json_object("doc", f"$.{field}").cast("long") + n).alias("value"))


def json_objlen(jd: DataFrame) -> DataFrame:
    return jd.select("key", F.size(F.json_object_keys("doc")).cast("long").alias("n"))


def geoadd(geo: DataFrame) -> DataFrame:
    return geo.select("key", "member", geo_score(F.col("lng"), F.col("lat")).alias("score"))


def geodist(geo: DataFrame, lng: float, lat: float) -> DataFrame:
    return geo.select("key", "member", haversine(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat)).alias("metres"))


def geosearch(geo: DataFrame, lng: float, lat: float, metres: float) -> DataFrame:
    """Within a radius; a band of latitude is pushed to the scan first."""
    band = metres / 111_000.0 + 0.01
    near = geo.where(F.col("lat").between(lat - band, lat + band))
    return geodist(near, lng, lat).where(F.col("metres") <= metres)


def bitcount(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg(F.countDistinct("offset").alias("n"))


def bitpos(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg(F.min("offset").alias("offset"))


def bitop(bits: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """AND, OR or XOR of bitmaps, as the offsets set."""
    n = F.countDistinct("key")
    on = bits.where(F.col("key").isin(keys)).groupBy("offset").agg(n.alias("n"))
    return on.where({"AND": F.col("n") == len(set(keys)), "OR": F.col("n") > 0, "XOR": F.col("n") % 2 == 1}[how]).select("offset")


def hll_registers(elements: DataFrame, by: str, element: Column) -> DataFrame:
    """idx, rank of a 16384-register HyperLogLog over MD5: 14 bits choose the register, 50 more give the rank."""
    m = F.md5(element.cast("string"))
    lo, hi = F.conv(F.substring(m, 13, 4), 16, 10).cast("long"), F.conv(F.substring(m, 1, 12), 16, 10).cast("long")
    rest = F.shiftleft(hi, 2).bitwiseOR(F.shiftright(lo, 14))
    rank = F.when(rest == 0, 51).otherwise(F.lit(51) - F.length(F.bin(rest)))
    return elements.select(by, lo.bitwiseAND(F.lit(16383)).alias("idx"), rank.alias("rank")).groupBy(by, "idx").agg(F.max("rank").alias("rank"))


def pfcount(registers: DataFrame, by: str) -> DataFrame:
    """Estimate with linear counting for small sets; absent registers count one each."""
    m = 16384.0
    z = F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + (F.lit(m) - F.count("*"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / z
    empty = F.lit(m) - F.count("*")
    return registers.groupBy(by).agg(F.round(F.when((raw <= 2.5 * m) & (empty > 0), F.lit(m) * F.log(F.lit(m) / F.greatest(empty, F.lit(1.0)))).otherwise(raw)).cast("long").alias("n"))


def cms_cells(elements: DataFrame, element: Column, width: int, depth: int) -> DataFrame:
    """row, col, count of a count-min sketch over MD5."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")
    e = elements.groupBy(element.cast("string").alias("e")).agg(F.count("*").alias("n")).select("e", "n", rows)
    return e.select("row", _cell(width).alias("col"), "n").groupBy("row", "col").agg(F.sum("n").alias("n"))


def _cell(width: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("row").cast("string"), F.col("e"))), 1, 12), 16, 10).cast("long") % width


def cms_query(cells: DataFrame, probes: DataFrame, width: int, depth: int) -> DataFrame:
    """probes: e. The least of an element's cells: never less than its true count."""
    p = probes.select("e", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")).withColumn("col", _cell(width))
    return p.join(cells, ["row", "col"], "left").groupBy("e").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def topk(elements: DataFrame, element: str, k: int) -> DataFrame:
    return elements.groupBy(element).agg(F.count("*").alias("n")).orderBy(F.desc("n"), element).limit(k)


#: Rows of a group that one task ranks as it is, accuracy of the cuts, and their share of rows on either
#: side of a quantile, twice the error of that accuracy.
RANKED, ACCURACY, NEAR = 100_000, 10_000, 0.0002


def quantiles(values: DataFrame, by: str, value: str, at: list[float], ranked: int = RANKED) -> DataFrame:
    """Interpolated quantiles of each key, exact. In groups of over so many rows, cuts from a sketch say where to look: the
    rows below each are counted, and only what lies between the two cuts around a quantile is ranked. Poor cuts would
    leave more to rank, the result is the same. Rows of cuts are broadcast, one for each such group."""
    names = [f"q{round(q * 100)}" for q in at]
    near = sorted({min(max(q + side, 0.0), 1.0) for q in at for side in (-NEAR, NEAR)})
    cuts = [f"_cut{i}" for i in range(len(near))]
    values = values.select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    v = F.col("_v")
    sizes = values.groupBy("_by").agg(F.count(v).alias("_n"), F.percentile_approx(v, near, ACCURACY).alias("_cuts")).where(F.col("_n") > ranked)
    large = sizes.select(F.col("_by").alias("_large"), "_n", *(F.col("_cuts")[i].alias(c) for i, c in enumerate(cuts)))
    same = F.col("_by").eqNullSafe(F.col("_large"))
    small = values.join(F.broadcast(large.select("_large")), same, "left_anti").groupBy("_by").agg(*(F.percentile(v, q).alias(x) for q, x in zip(at, names)))

    under = [(F.count_if(v < F.col(c)).alias(f"{c}_under"), F.count_if(v <= F.col(c)).alias(f"{c}_upto")) for c in cuts]
    counted = values.join(F.broadcast(large), same).groupBy("_large", "_n", *cuts).agg(*(x for pair in under for x in pair))
    place = lambda q: (F.col("_n") - 1).cast("double") * q
    # the last cut that has no more rows under it than the quantile's place, and the first that has the next place
    low = lambda q, of: F.coalesce(*(F.when(F.col(f"{c}_under") <= F.floor(place(q)), of(c)) for c in reversed(cuts)))
    high = lambda q: F.coalesce(*(F.when(F.col(f"{c}_upto") > F.ceil(place(q)), F.col(c)) for c in cuts))
    spots = F.array(*(F.struct(F.lit(i).alias("_i"), place(q).alias("_at"), low(q, F.col).alias("_low"), high(q).alias("_high"), F.coalesce(low(q, lambda c: F.col(f"{c}_under")), F.lit(0).cast("long")).alias("_under")) for i, q in enumerate(at)))
    inside = v.isNotNull() & (F.col("_low").isNull() | (v >= F.col("_low"))) & (F.col("_high").isNull() | (v <= F.col("_high")))
    found = values.join(F.broadcast(counted.select("_large", F.inline(spots))), same & inside)
    key = ["_by", "_i", "_at"]
    upto = F.col("_under") + F.sum("_w").over(Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = found.groupBy(*key, "_under", "_v").agg(F.count("*").alias("_w")).withColumn("_upto", upto)
    lower, higher = F.floor("_at"), F.ceil("_at")
    ends = placed.groupBy(*key).agg(F.min(F.when(F.col("_upto") > lower, v)).alias("_a"), F.min(F.when(F.col("_upto") > higher, v)).alias("_b"))
    a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
    between = F.when(a == b, a).otherwise((higher - F.col("_at")) * a + (F.col("_at") - lower) * b)
    big = ends.groupBy("_by").agg(*(F.max(F.when(F.col("_i") == i, between)).alias(x) for i, x in enumerate(names)))
    return small.unionByName(big).withColumnRenamed("_by", by)


def cdf(values: DataFrame, by: str, value: str, x: float) -> DataFrame:
    return values.groupBy(by).agg((F.count_if(F.col(value) <= x) / F.count("*")).alias("share"))


def bloom_maybe(elements: DataFrame, element: str, probes: DataFrame, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """probes with maybe: 1 if all of an element's bits are set. No element that was added gives 0."""
    def places(c):
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.col(c)), F.lit(bits)))).alias("bit")

    held = elements.select(places(element)).distinct().withColumn("on", F.lit(1))
    p = probes.select(element, places(element)).join(held, "bit", "left")
    return p.groupBy(element).agg(F.min(F.coalesce("on", F.lit(0))).cast("long").alias("maybe"))


def ttl(kv: DataFrame, now_ms: int) -> DataFrame:
    """Milliseconds left; -1 without a time to live, -2 if expired."""
    e = F.col("expire_at_ms")
    return kv.select("key", F.when(e == 0, -1).when(e <= now_ms, -2).otherwise(e - now_ms).cast("long").alias("ttl_ms"))


def alive(kv: DataFrame, now_ms: int) -> DataFrame:
    return kv.where(live(now_ms))


def persist(kv: DataFrame, now_ms: int) -> DataFrame:
    """What has expired stays gone."""
    return kv.where(live(now_ms)).withColumn("expire_at_ms", F.lit(0).cast("long"))


def key_types(**tables: DataFrame) -> DataFrame:
    """type, keys of each family."""
    parts = [t.agg(F.countDistinct("key").alias("keys")).select(F.lit(n).alias("type"), "keys") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ratelimit_windows(log: DataFrame, window_ms: int, most: int) -> DataFrame:
    """key, bucket, n and the sliding estimate: this bucket and the former one's share of time left; allowed if the
    estimate at the bucket's middle stays within the limit."""
    b = log.groupBy("key", F.floor(F.col("ts_ms") / window_ms).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("bucket")
    before = F.when(F.lag("bucket").over(w) == F.col("bucket") - 1, F.lag("n").over(w)).otherwise(0)
    return b.withColumn("estimate", F.col("n") + before * F.lit(0.5)).withColumn("allowed", (F.col("estimate") <= most).cast("long"))


def lock_spans(log: DataFrame) -> DataFrame:
    """key, seq, until: how long each holder has a lock, until the next command on the key."""
    w = Window.partitionBy("key").orderBy("ts_ms", "seq")
    return log.select("key", "seq", F.coalesce(F.lead("ts_ms").over(w) - F.col("ts_ms"), F.lit(-1)).alias("held_ms"))


def geopos(scores: DataFrame) -> DataFrame:
    """scores: key, member, score. Places as their cells have them."""
    lng, lat = geo_place(F.col("score"))
    return scores.select("key", "member", lng.alias("lng"), lat.alias("lat"))


def geohash(scores: DataFrame) -> DataFrame:
    return scores.select("key", "member", geo_hash(F.col("score")).alias("geohash"))


def geodist_members(geo: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: key, a, b. Metres between two members of a key, null if it lacks one."""
    at = lambda n: geo.select("key", F.col("member").alias(n), F.col("lng").alias(f"{n}_lng"), F.col("lat").alias(f"{n}_lat"))
    both = pairs.join(at("a"), ["key", "a"], "left").join(at("b"), ["key", "b"], "left")
    return both.select("key", "a", "b", haversine(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat")).alias("metres"))


#: Fixed value: metres to a degree of latitude.
DEGREE = 111_320.0


def geosearch_box(geo: DataFrame, lng: float, lat: float, width: float, height: float) -> DataFrame:
    """Within a box of degrees around a place, sides in metres at its latitude; the box doesn't wrap at 180 degrees."""
    cos = math.cos(math.radians(lat))
    half_lat, half_lng = height / 2 / DEGREE, width / 2 / (DEGREE * cos) if cos > 0 else 180.0
    return geo.where((F.abs(F.col("lat") - lat) <= half_lat) & (F.abs(F.col("lng") - lng) <= half_lng))


def geosearch_member(geo: DataFrame, member: str, metres: float, count: int) -> DataFrame:
    """The nearest members of each key to one of its own, itself included, within a radius."""
    centre = geo.where(F.col("member") == member).select("key", F.col("lng").alias("lng0"), F.col("lat").alias("lat0"))
    near = geo.join(centre, "key").select("key", "member", haversine(F.col("lng"), F.col("lat"), F.col("lng0"), F.col("lat0")).alias("metres")).where(F.col("metres") <= metres)
    w = Window.partitionBy("key").orderBy("metres", "member")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).drop("r")


def setbit(bits: DataFrame, offset: int, on: bool) -> DataFrame:
    """Every bitmap with one bit set or cleared."""
    others = bits.where(F.col("offset") != offset)
    if not on:
        return others
    return others.unionByName(bits.select("key").distinct().withColumn("offset", F.lit(offset).cast("long")))


def getbit(bits: DataFrame, offset: int) -> DataFrame:
    return bits.groupBy("key").agg(F.max((F.col("offset") == offset).cast("long")).alias("bit"))


def bitcount_range(bits: DataFrame, start: int, stop: int) -> DataFrame:
    """Set bits of bytes start to stop, both included; negative bytes count from the end, the byte of the last set bit."""
    size = bits.groupBy("key").agg((F.floor(F.max("offset") / 8) + 1).alias("n"))
    at = lambda i: F.greatest(F.col("n") + i, F.lit(0)) if i < 0 else F.lit(i)
    byte = F.floor(F.col("offset") / 8)
    return bits.join(size, "key").groupBy("key").agg(F.count_if(byte.between(at(start), at(stop))).alias("n"))


def bitnot(bits: DataFrame) -> DataFrame:
    """The offsets not set, up to the end of the byte of the last one set."""
    size = bits.groupBy("key").agg(F.max("offset").alias("last"))
    every = size.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 8) * 8 + 7)).alias("offset"))
    return every.join(bits, ["key", "offset"], "left_anti")


def pfmerge(registers: DataFrame, by: str) -> DataFrame:
    """Registers of the union of all that have the same value of by."""
    return registers.groupBy(by, "idx").agg(F.max("rank").alias("rank"))


def cms_merge(sketches: list[tuple[DataFrame, int]]) -> DataFrame:
    """Cells of sketches (cells, weight) of one size, added up and held to 0 at least."""
    every = reduce(DataFrame.unionByName, (c.select("row", "col", (F.col("n") * w).alias("n")) for c, w in sketches))
    return every.groupBy("row", "col").agg(F.greatest(F.sum("n"), F.lit(0)).alias("n"))


def topk_by(elements: DataFrame, by: str, element: str, k: int) -> DataFrame:
    """The most frequent elements of each key, ties to the smaller element."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), element)
    return elements.groupBy(by, element).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def cuckoo_cells(elements: DataFrame, element: Column, buckets: int) -> DataFrame:
    """mark, low, high, n: marks of the elements and their two buckets. buckets: a power of two, so either bucket gives the
    other. A table of marks has no kicks and doesn't fill up."""
    mark, low, high = _cuckoo_place(element.cast("string"), buckets)
    return elements.groupBy(mark.alias("mark"), low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"))


def _cuckoo_place(e: Column, buckets: int) -> tuple[Column, Column, Column]:
    part = lambda text, at: F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")
    mark = part(e, 1) % 65535 + 1
    one = part(e, 9) % buckets
    two = one.bitwiseXOR(part(mark.cast("string"), 1) % buckets)
    return mark, F.least(one, two), F.greatest(one, two)


def cuckoo_count(cells: DataFrame, probes: DataFrame, buckets: int) -> DataFrame:
    """probes: e. How often an element may have been added: never too few."""
    mark, low, high = _cuckoo_place(F.col("e"), buckets)
    p = probes.select("e", mark.alias("mark"), low.alias("low"), high.alias("high"))
    return p.join(cells, ["mark", "low", "high"], "left").select("e", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cuckoo_del(cells: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """gone: e. One occurrence less for each; what isn't there stays away."""
    less = cuckoo_cells(gone, F.col("e"), buckets).withColumnRenamed("n", "less")
    left = cells.join(less, ["mark", "low", "high"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    return left.where("n > 0").drop("less")


def rank_of(values: DataFrame, by: str, value: str, x: float) -> DataFrame:
    """How many values of each key are below x, and above it."""
    v = F.col(value)
    return values.groupBy(by).agg(F.count_if(v < x).alias("below"), F.count_if(v > x).alias("above"))


def by_rank(values: DataFrame, by: str, value: str, rank: int, reverse: bool = False) -> DataFrame:
    """The value at a rank from 0, smallest first; counted from the largest if reverse."""
    v = F.col(value)
    w = Window.partitionBy(by).orderBy(v.desc() if reverse else v)
    return values.withColumn("r", F.row_number().over(w)).where(F.col("r") == rank + 1).select(by, v.alias("value"))


def trimmed_mean(values: DataFrame, by: str, value: str, low: float, high: float) -> DataFrame:
    """Mean of each key's values from one share of them to another. Equal values count as one weight, as centroids do, so
    a value that many rows have is a row here."""
    c = values.groupBy(by, value).agg(F.count("*").alias("w"))
    total = c.groupBy(by).agg(F.sum("w").alias("total"))
    upto = F.sum("w").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    part = F.greatest(F.least(F.col("upto"), F.col("total") * high) - F.greatest(F.col("upto") - F.col("w"), F.col("total") * low), F.lit(0.0))
    return c.withColumn("upto", upto).join(total, by).withColumn("part", part).groupBy(by).agg((F.sum(F.col(value) * F.col("part")) / F.sum("part")).alias("mean"))


def extremes(values: DataFrame, by: str, value: str) -> DataFrame:
    return values.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def expire(kv: DataFrame, at_ms: int, only: str = "", now_ms: int = 0) -> DataFrame:
    """only: "NX" keys without a time to live, "XX" with one, "GT" to a later, "LT" to an earlier time; a key without one
    passes GT and LT. What has expired stays gone."""
    kv = kv.where(live(now_ms))
    old = F.col("expire_at_ms")
    may = {"": F.lit(True), "NX": old == 0, "XX": old != 0, "GT": (old == 0) | (F.lit(at_ms) > old), "LT": (old == 0) | (F.lit(at_ms) < old)}[only.upper()]
    return kv.withColumn("expire_at_ms", F.when(may, F.lit(at_ms).cast("long")).otherwise(old))


def numsub(subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """Subscribers of each channel asked for."""
    n = subscriptions.groupBy("channel").agg(F.countDistinct("subscriber").alias("n"))
    return channels.join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def publish_patterns(messages: DataFrame, patterns: list[str]) -> DataFrame:
    """A row for each message and pattern that its channel matches. Patterns are few and stand in the plan."""
    hits = F.array_compact(F.array(*(F.when(glob(F.col("channel"), p), F.lit(p)) for p in patterns)))
    return messages.withColumn("pattern", F.explode(hits))


def keyspace_events(log: DataFrame) -> DataFrame:
    """Notifications of a log's commands: a channel a key with the command, and one a command with the key."""
    at = F.array(F.struct(F.concat(F.lit("__keyspace@0__:"), "key").alias("channel"), F.col("cmd").alias("message")), F.struct(F.concat(F.lit("__keyevent@0__:"), "cmd").alias("channel"), F.col("key").alias("message")))
    return log.select("seq", F.inline(at))


def slot_ranges(owners: DataFrame) -> DataFrame:
    """owners: slot, shard. Runs of neighbouring slots of one shard."""
    w = Window.partitionBy("shard").orderBy("slot")
    g = owners.withColumn("run", F.col("slot") - F.row_number().over(w))
    return g.groupBy("shard", "run").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).drop("run")


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for so many elements."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def cms_size(error: float, miss: float) -> tuple[int, int]:
    """Width and depth of a count-min sketch: within `error` of all counts, but for a share `miss` of the answers."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / miss))


def bitpos_zero(bits: DataFrame) -> DataFrame:
    """First clear bit of each bitmap: the first place whose number of set bits before it is not the place itself."""
    w = Window.partitionBy("key").orderBy("offset")
    r = bits.select("key", "offset", (F.row_number().over(w) - 1).cast("long").alias("r"))
    return r.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("offset") != F.col("r"), F.col("r"))), F.max("r") + 1).alias("pos"))
