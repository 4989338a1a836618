"""Operator 6, benchmark decontamination: template canonicalisation.

Texts and benchmark items are cut into words of letters or digits. A unit after
a number, a number and a capitalised word become typed placeholders, one for
one, all else lower case. Windows of eight such words, and of eight plain words
in lower case, are hash-joined with those of the items. Each distance at which
windows of an item and of a text meet (an occurrence) is then compared word by
word, whatever the text's case: a plain word of the item must be the same in
lower case, a number stand for a number, a unit for a unit, a name for any
word. A value of the item stands for the word most often behind it; a slot that
holds another word costs the windows around it. Windows equal word for word
count whatever their slots. So a question asked with other numbers and names is
caught, and a text that merely has the same shape is not. A text is
contaminated by an item if its occurrences cover at least half of the item's
windows, or if it has fifty words in a row from the item, word for word. Items
of fewer than eight words are one window, to be found word for word; items of
fewer than twelve letters and digits say nothing and are left out. Very long
texts are hashed word by word once, in memory that grows with their words.

Only DataFrame functions are used. Windows with fewer than four plain words say
too little and count only where all words are equal. A text in another case
that also has other names is seen where one window holds no name. Null and
empty texts are clean. Repeated rows get the same verdict; a row with a null
doc_id is judged by its text. An item_id with several texts is contaminating by
each of them; items without an item_id count as one in n_items and are not in
item_ids. Further columns are kept by ``cleaned`` and
dropped by ``judged``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import small, stored

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: So many words in a row, word for word, are contamination whatever their share of the item.
RUN = 50
#: Items with fewer letters and digits ("yes", "the") would be found in nearly every text; they are left out.
LEAST_CHARS = 12
NUMBER, UNIT, NAME = "#number", "#unit", "#name"
# Words that count as units when they follow a number.
UNITS = (
    "mm cm m km inch inches ft feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz "
    "ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour "
    "hours day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur gbp mph kmh "
    "degree degrees"
)


def plain(text: str | Column) -> Column:
    """The words of letters or of digits, one blank apart; glued numbers and units are set apart."""
    words = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string"), r"[^\p{L}\p{N}]+", " ")
    apart = F.regexp_replace(words, r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", " ")
    return F.trim(apart)


def template(words: Column) -> Column:
    """``plain`` words with each slot as a typed placeholder, the others in lower case."""
    unit = rf"(?<=\p{{N}} )(?i:{'|'.join(UNITS.split())})(?= |$)"
    held = F.regexp_replace(F.regexp_replace(words, unit, UNIT), r"\p{N}+", NUMBER)
    return F.lower(F.regexp_replace(held, r"(?<![^ ])\p{Lu}\p{Ll}+(?![^ ])", NAME))


def _split(words: Column) -> Column:
    return F.split(words, " ", -1)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, not anew wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashed(words: Column) -> Column:
    """A hash of each word; the windows are made of these, so that no word is copied or hashed twice."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: str, width: int = WINDOW) -> Column:
    """The hash of the window that begins at each word, from the column of word hashes; NULL where the text ends before."""
    n = F.size(hashes)
    if width != WINDOW:
        own = F.col(hashes)
        return F.transform(own, lambda x, i: F.when(i + width <= n, F.xxhash64(x, *(F.get(own, i + k) for k in range(1, width)))))

    def doubled(own: Column, by: int) -> Column:
        return F.transform(own, lambda x, i: F.when(i + 2 * by <= n, F.xxhash64(x, F.get(own, i + by))))

    return _bound(_bound(doubled(F.col(hashes), 1), lambda two: doubled(two, 2)), lambda four: doubled(four, 4))


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def _item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items' windows (hash, item, place) and the items (item: a hash of item_id and text, item_id, kinds, low, telling: the places of windows with enough plain words)."""
    telling_text = F.length(F.regexp_replace("raw", " ", "")) >= LEAST_CHARS
    raw = items.select(F.col("item_id").cast("long").alias("item_id"), plain("text").alias("raw")).where(telling_text).distinct()
    cut = raw.select("item_id", F.xxhash64("item_id", "raw").alias("item"), _split(template(F.col("raw"))).alias("kinds"), _split(F.lower("raw")).alias("low"))
    slots = lambda w: F.filter(w, lambda x: ~x.startswith("#"))
    starts = F.sequence(F.lit(0), F.size("kinds") - F.lit(WINDOW))
    telling = F.when(F.size("kinds") >= WINDOW, F.filter(starts, lambda p: F.size(slots(F.slice("kinds", p + 1, WINDOW))) >= LITERALS))
    whole = stored(cut.withColumn("telling", F.coalesce(telling, F.array().cast("array<int>"))), "items")
    hashed = whole.select("item", "telling", _hashed(F.col("kinds")).alias("kinds"), _hashed(F.col("low")).alias("low"))
    held = hashed.select("item", "telling", F.posexplode(_windows("kinds")).alias("place", "hash")).where(F.array_contains("telling", F.col("place")))
    parts = [held.select("hash", "item", "place"), hashed.select("item", F.posexplode(_windows("low")).alias("place", "hash")).select("hash", "item", "place")]
    for width in range(1, WINDOW):
        short = hashed.where(F.size("low") == width)
        parts.append(short.select(F.element_at(_windows("low", width), 1).alias("hash"), "item", F.lit(0).alias("place")))
    windows = reduce(DataFrame.union, parts).where("hash IS NOT NULL")
    return stored(windows.distinct(), "item-windows"), whole


def _compared(aligned: DataFrame) -> DataFrame:
    """``soft``, ``exact``: places of windows that agree up to their slots, and word for word; ``same``: 1 for each equal word, else 0."""
    at = F.transform(
        "low",
        lambda low, i: F.struct(
            F.element_at("kinds", i + 1).alias("kind"), low.alias("value"), F.get("own", i).alias("word"), F.get("own_kinds", i).alias("own_kind")
        ),
    )
    fits = lambda s: F.when(s["kind"] == NAME, s["own_kind"] != NUMBER).otherwise(s["kind"] == s["own_kind"])
    equal = lambda s: F.coalesce(s["value"] == s["word"], F.lit(False))
    slot = lambda s: s["kind"].startswith("#") & F.coalesce(equal(s) | fits(s), F.lit(False))
    pair = lambda s: F.struct(s["kind"], s["value"], s["word"])
    ranked = _bound(
        F.transform(F.filter("at", slot), pair),
        lambda pairs: F.transform(
            F.array_distinct(pairs),
            lambda p, i: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), p["word"].alias("word"), F.size(F.filter(pairs, lambda q: q == p)).alias("n"), i.alias("i")),
        ),
    )
    beaten = lambda r, q: (q["kind"] == r["kind"]) & (q["value"] == r["value"]) & ((q["n"] > r["n"]) | ((q["n"] == r["n"]) & (q["i"] < r["i"])))
    chosen = F.transform(F.filter("ranked", lambda r: ~F.exists("ranked", lambda q: beaten(r, q))), pair)
    agrees = lambda s: F.when(s["kind"].startswith("#"), slot(s) & F.array_contains("chosen", pair(s))).otherwise(equal(s))
    line = lambda test: F.array_join(F.transform("at", lambda s: F.when(test(s), "1").otherwise("0")), "")
    marked = aligned.withColumn("at", at).withColumn("ranked", ranked).withColumn("chosen", chosen).select(
        "doc_id", "digest", "item", "item_id", "telling", line(equal).alias("same"), line(agrees).alias("agree")
    )
    width = F.least(F.length("same"), F.lit(WINDOW))
    whole = lambda flags, p: F.substr(flags, p + 1, width) == F.repeat(F.lit("1"), width)
    return marked.select(
        "doc_id", "digest", "item", "item_id", "same", F.size("telling").alias("n_soft"), (F.length("same") - width + 1).alias("n_exact"),
        F.contains("same", F.lit("1" * RUN)).alias("run"),
        F.filter("telling", lambda p: whole(F.col("agree"), p) | whole(F.col("same"), p)).alias("soft"),
        F.filter(F.sequence(F.lit(0), F.length("same") - width), lambda p: whole(F.col("same"), p)).alias("exact"),
    )


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), item_id and the share of the item's windows found, where that is enough."""
    windows, whole = _item_windows(items)
    keyed = _keys(docs)
    raw = keyed.select("doc_id", "digest", plain("text").alias("raw"))
    widths = [r[0] for r in whole.select(F.size("low")).where(F.size("low") < WINDOW).distinct().collect()]
    hashed = raw.select("doc_id", "digest", _hashed(_split(template(F.col("raw")))).alias("kinds"), _hashed(_split(F.lower("raw"))).alias("low"))
    found = F.concat(_windows("kinds"), *(_windows("low", n) for n in (WINDOW, *sorted(widths))))
    spread = hashed.select("doc_id", "digest", F.size("low").alias("n"), F.posexplode(found).alias("pos", "hash"))
    met = spread.select("doc_id", "digest", (F.col("pos") % F.col("n")).alias("at"), "hash").join(small(windows), "hash")
    shifts = stored(met.select("doc_id", "digest", "item", (F.col("at") - F.col("place")).alias("shift")).distinct(), "occurrences")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    texts = stored(shifts.select("doc_id", "digest").distinct(), "likely")
    wanted = keyed.join(small(texts), same(keyed, texts), "left_semi").dropDuplicates(["doc_id", "digest"])
    cut = wanted.select("doc_id", "digest", plain("text").alias("raw")).select(
        "doc_id", "digest", _split(F.lower("raw")).alias("all_low"), _split(template(F.col("raw"))).alias("all_kinds")
    )
    likely = shifts.join(small(whole), "item")
    beside = lambda words: F.transform("low", lambda _, i: F.get(words, i + F.col("shift")))
    aligned = likely.join(cut, same(likely, cut)).select(likely["*"], beside("all_low").alias("own"), beside("all_kinds").alias("own_kinds"))
    compared = _compared(stored(aligned, "aligned"))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    shares = compared.groupBy("doc_id", "digest", "item").agg(
        F.first("item_id").alias("item_id"),
        F.greatest(F.try_divide(union("soft"), F.first("n_soft")), union("exact") / F.first("n_exact")).alias("coverage"),
        F.max("run").alias("run"),
    )
    return shares.where((F.col("coverage") >= COVERAGE) | F.col("run")).select("doc_id", "digest", "item_id", "coverage")


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: doc_id, contaminated, n_items, item_ids (ascending), coverage (the highest)."""
    by_text = stored(
        leaks(docs, items)
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"), F.max("coverage").alias("coverage")),
        "leaks",
    )
    keyed = _keys(docs).drop("text")
    same = keyed["doc_id"].eqNullSafe(by_text["doc_id"]) & (keyed["digest"] == by_text["digest"])
    return keyed.join(by_text, same, "left").select(
        keyed["doc_id"],
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = stored(leaks(docs, items).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__digest"))
    return docs.join(small(bad), same, "left_anti")
