"""Benchmark decontamination by template canonicalisation.

A text is read in two ways. Literally: its lower-cased words. As a template: numbers (digits with their separators, or
spelled), names (runs of capitalised words, those that begin a sentence included) and units (after a number, attached or
apart) are one typed placeholder each. Windows of five tokens of either reading are hashed, those of documents joined with
those of the benchmark. Values behind placeholders must be consistent: within one occurrence of an item in a document, a
value of the item has to stand for one value of the document throughout (the most frequent one; ties to the smallest);
windows that break this don't count. An occurrence is a group of windows that lie as far apart as in the item, give or take
SHIFT tokens; the whole document counts as one more. A document is contaminated if it has 0.8 or more of an item's windows
in one reading, so verbatim copies in any case are found as well as those with other numbers and names.

All is built-in functions. Documents' windows are exploded as hashes, never grouped by hash; the benchmark's are
broadcast after their size is checked, and joined by shuffle beyond it.

Defined cases: null and empty texts have no windows and are clean; items of fewer than five tokens, and template windows of
fewer than two literal tokens, take no part; each row is judged by its own text, whatever ids it shares; a null id or item
id is an id like others; an empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

WINDOW, CONTAINMENT, LITERALS, SHIFT = 5, 0.8, 2, 3
#: Bytes of benchmark windows that are broadcast at most.
BROADCAST_BYTES = 64 << 20
#: Texts whose keys (16 bytes each) are broadcast at most, to read them again.
BROADCAST_TEXTS = 1_000_000
#: Units that may follow a number, and spelled numbers.
UNITS = "mm cm m km kg g mg lb lbs oz ft in mi mph kmh km/h s sec min h hr hrs hours minutes seconds days weeks months years l ml percent dollars euros pounds usd eur gbp kwh mb gb tb hz khz mhz ghz".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
#: Marks before a word by its type, between the values of a window, and within a value; texts have blanks in their place.
_SPELLED, _NAME, _UNIT, _SEP, _JOIN = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
_BORDER = r"(?![\p{L}\p{N}])"


def _any_of(words: list[str]) -> str:
    """A pattern of words, parted by first letters, which may be capital."""
    letters = sorted({w[0] for w in words})
    rest = lambda c: "|".join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))
    return "|".join(f"[{c}{c.upper()}](?:{rest(c)})" for c in letters)


_NUMBER_LETTERS = "".join(sorted({c for w in NUMBERS for c in (w[0], w[0].upper())}))


def _readings(text: Column) -> tuple[Column, Column]:
    """Literal tokens, and tokens with a mark before spelled numbers, names and units."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    marks = f"[{_SPELLED}-{_JOIN}]"
    plain = F.when(t.rlike(marks), F.regexp_replace(t, marks, " ")).otherwise(t)
    whole = F.regexp_replace(plain, r"[.,](?<=\d[.,])(?=\d)", _JOIN)
    # runs of up to three words are one value
    spoken = rf"({_any_of(NUMBERS)}){_BORDER}"
    spelled = F.regexp_replace(whole, rf"(?=[{_NUMBER_LETTERS}])(?<![\p{{L}}\p{{N}}]){spoken}(?:[\s-]{spoken})?(?:[\s-]{spoken})?", f"{_SPELLED}$1{_JOIN}$2{_JOIN}$3")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    measured = F.regexp_replace(spelled, rf"(\d\s?|{_SPELLED}[\p{{L}}{_JOIN}]+\s)((?:{units}){_BORDER})", f"$1 {_UNIT}$2")
    name = r"\p{Lu}\p{Ll}\p{L}*+"
    joined = F.regexp_replace(measured, rf"(\p{{Lu}}(?<![\p{{L}}\p{{N}}{_SPELLED}-{_UNIT}]\p{{Lu}})\p{{Ll}}\p{{L}}*+)(?:\s({name}))?(?:\s({name}))?", f"{_NAME}$1{_JOIN}$2{_JOIN}$3")
    words = lambda x: F.array_remove(F.split(F.lower(x), rf"[^\p{{L}}\p{{N}}{_SPELLED}-{_UNIT}{_JOIN}]+"), "")
    return words(whole), words(joined)


def _starts(token: Column, first: str, after: str) -> Column:
    return (token >= first) & (token < after)


def _typed(token: Column) -> Column:
    return _starts(token, "0", ":") | _starts(token, _SPELLED, _SEP)


def _canonical_hash(token: Column) -> Column:
    """Of the token, or of its placeholder. Strings are compared byte by byte, so a range tells the first character."""
    number = _starts(token, "0", ":") | _starts(token, _SPELLED, _NAME)
    return F.when(number, F.lit(1)).when(_starts(token, _NAME, _UNIT), F.lit(2)).when(_starts(token, _UNIT, _SEP), F.lit(3)).otherwise(F.xxhash64(token))


def _slots(raw: Column, pos: Column, size: int) -> Column:
    """Values behind the placeholders of a window, joined; null if there are none."""
    values = F.filter(F.slice(raw, pos + 1, size), _typed)
    return F.when(F.size(values) > 0, F.array_join(values, _SEP))


def _hashed(texts: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, tid (hash of the text), raw (the template's tokens), literal and template (hashes of all windows)."""
    text = F.col(text_col)
    read = texts.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), F.struct(*_readings(text)).alias("both"))
    # hashes of tokens are read many times, so they are worked out once
    t = read.select("id", "tid", F.col("both.col2").alias("raw"), F.transform("both.col1", lambda x: F.xxhash64(x)).alias("lh"), F.transform("both.col2", _canonical_hash).alias("th"))

    def windows(col: str, seed: int) -> Column:
        hashes, n = F.col(col), F.size(col)
        every = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(hashes[i + k] for k in range(size)), F.lit(seed)))
        return F.when(n >= size, every).otherwise(F.array().cast("array<bigint>"))

    return t.select("id", "tid", "raw", windows("lh", 0).alias("literal"), windows("th", 1).alias("template"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least: float = CONTAINMENT, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid (xxhash64 of the text), item_id, matched (consistent windows of the item), windows (all of them), for every
    text and item that reach the containment; the better reading and occurrence of each."""
    of_items = cut_lineage(_hashed(benchmark, item_id, text_col, size))
    literal = of_items.select(F.col("id").alias("item_id"), F.lit(0).alias("way"), F.posexplode("literal").alias("item_pos", "h"), F.lit(None).cast("string").alias("item_slots"))
    spread = of_items.select(F.col("id").alias("item_id"), F.lit(1).alias("way"), "raw", F.posexplode("template").alias("item_pos", "h"))
    told = F.size(F.filter(F.slice("raw", F.col("item_pos") + 1, size), lambda x: ~_typed(x))) >= min(LITERALS, size)
    template = spread.where(told).select("item_id", "way", "item_pos", "h", _slots(F.col("raw"), F.col("item_pos"), size).alias("item_slots"))
    items = cut_lineage(literal.unionAll(template).distinct())
    totals = items.groupBy(F.col("item_id").alias("_of"), F.col("way").alias("_way")).agg(F.countDistinct("item_pos").alias("windows"))
    weight = items.agg(F.sum(F.coalesce(F.octet_length("item_slots"), F.lit(0)) + 64)).first()[0] or 0
    side = F.broadcast(items) if weight <= BROADCAST_BYTES else items
    every = _hashed(docs, doc_id, text_col, size).select("id", "tid", F.size("literal").alias("n"), F.posexplode(F.concat("literal", "template")).alias("at", "h"))
    place = F.col("at") - F.when(F.col("way") == 1, F.col("n")).otherwise(0)
    hit = cut_lineage(every.join(side, "h").select(F.col("id").alias("doc_id"), "tid", "way", place.alias("pos"), "item_id", "item_pos", "item_slots").distinct())
    text_key, keys = ["doc_id", "tid"], ["doc_id", "tid", "item_id", "way"]
    same = lambda cols, a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    # what has too few windows of an item even if all were consistent goes no further
    seen = hit.groupBy(*keys).agg(F.countDistinct("item_pos").alias("n")).join(totals, F.col("item_id").eqNullSafe(F.col("_of")) & (F.col("way") == F.col("_way")))
    likely = seen.where(F.col("n") >= F.col("windows") * F.lit(least)).select(*keys)
    hit = cut_lineage(hit.alias("a").join(likely.alias("b"), same(keys, "a", "b"), "left_semi"))
    # occurrences: the windows' distances between text and item, cut where they jump; -1 is the whole text
    shift = F.col("pos") - F.col("item_pos")
    along = Window.partitionBy(*keys).orderBy("shift")
    jump = F.when(F.col("shift") - F.lag("shift").over(along) > SHIFT, 1).otherwise(0)
    shifts = hit.select(*keys, shift.alias("shift")).distinct().withColumn("jump", jump)
    shifts = shifts.withColumn("occurrence", F.sum("jump").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    placed = hit.withColumn("shift", shift).alias("a").join(shifts.alias("b"), [*same(keys, "a", "b"), F.col("a.shift") == F.col("b.shift")]).select("a.*", "b.occurrence")
    placed = cut_lineage(placed.withColumn("occurrence", F.explode(F.array("occurrence", F.lit(-1)))).drop("shift"))
    # few rows: windows with placeholders only. Their texts are read again for the values.
    typed = placed.where("item_slots IS NOT NULL")
    wanted = cut_lineage(typed.select(*text_key).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    again = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).alias("text")).alias("a")
    again = again.join(wanted.alias("b"), same(text_key, "a", "b")).select("a.*").dropDuplicates(text_key).select(*text_key, _readings(F.col("text"))[1].alias("raw"))
    asked = typed.groupBy(*text_key).agg(F.collect_set("pos").alias("at"))
    told = F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), _slots(F.col("raw"), p, size).alias("text_slots"))))
    values = again.alias("a").join(asked.alias("b"), same(text_key, "a", "b")).select("a.doc_id", "a.tid", told.alias("x")).select(*text_key, "x.pos", "x.text_slots")
    valued = typed.alias("a").join(values.alias("b"), [*same(text_key, "a", "b"), F.col("a.pos") == F.col("b.pos")]).select("a.*", "b.text_slots")
    pairs = F.arrays_zip(F.split("item_slots", _SEP).alias("a"), F.split("text_slots", _SEP).alias("b"))
    keys.append("occurrence")
    valued = cut_lineage(valued.select(*keys, "item_pos", pairs.alias("pairs")))
    votes = valued.select(*keys, F.explode("pairs").alias("p")).groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    best = Window.partitionBy(*keys, "a").orderBy(F.desc("n"), "b")
    agreed = votes.withColumn("r", F.row_number().over(best)).where("r = 1").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("agreed"))
    held = valued.alias("a").join(agreed.alias("b"), same(keys, "a", "b"), "left").select("a.*", "b.agreed")
    sound = held.where(F.forall("pairs", lambda p: F.coalesce(F.element_at(F.col("agreed"), p["a"]) == p["b"], F.lit(False)))).select(*keys, "item_pos")
    matched = placed.where("item_slots IS NULL").select(*keys, "item_pos").unionAll(sound).distinct().groupBy(*keys).agg(F.count("*").alias("matched"))
    both = matched.join(totals, F.col("item_id").eqNullSafe(F.col("_of")) & (F.col("way") == F.col("_way")))
    enough = both.where(F.col("matched") >= F.col("windows") * F.lit(least))
    best_of = F.max_by(F.struct("matched", "windows"), F.struct(F.col("matched") / F.col("windows"), F.col("matched")))
    return enough.groupBy("doc_id", "tid", "item_id").agg(best_of.alias("x")).select("doc_id", "tid", "item_id", "x.matched", "x.windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, contaminated, n_items (items found in it), item_id (the one that it has most of; ties to the smallest) for
    every document."""
    found = contamination(docs, benchmark, doc_id=doc_id, text_col=text_col, **how)
    per = found.groupBy(F.col("doc_id").alias("_in"), F.col("tid").alias("_text")).agg(F.count("*").alias("n_items"), F.min_by("item_id", F.struct(-F.col("matched") / F.col("windows"), F.col("item_id"))).alias("item_id"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tid"))
    joined = d.join(per, F.col("doc_id").eqNullSafe(F.col("_in")) & (F.col("tid") == F.col("_text")), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents whose own text holds no item."""
    names = {"doc_id": how.get("doc_id", "doc_id"), "text_col": how.get("text_col", "text")}
    found = contamination(docs, benchmark, **how).select(F.col("doc_id").alias("_in"), F.col("tid").alias("_text")).distinct().alias("found")
    d = docs.alias("docs")
    same = F.col(f"docs.{names['doc_id']}").eqNullSafe(F.col("found._in")) & (F.xxhash64(F.col(f"docs.{names['text_col']}")) == F.col("found._text"))
    return d.join(found, same, "left_anti")
