"""Benchmark decontamination by templates: DataFrame functions only.

Texts are canonicalised word by word: numbers, names and units become typed
placeholders, everything else is lowered and freed of marks. Windows of five
template words are joined by hash to the benchmark's: first by their longest
plain word, then by all five. Where a matching window
has placeholders, the benchmark's value and the document's form a slot; a
value that stands for two different ones along one alignment is inconsistent,
and the windows with such slots don't count. A document that keeps at least
half of an item's windows holds the item, perhaps with other parameters.
Besides, each window is held against the document's own words in folded case: so
copies of items of mostly numbers or names, and in other case, are found by at
least half of the item's distinct windows of own words; items of fewer than five words by one
window of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_fit, table, unused, written

WINDOW = 5
#: Share of an item's windows that a document must hold.
CONTAINMENT = 0.5
#: A benchmark window with fewer plain words says too little as a template; its own words are still looked for.
PLAIN = 3
#: Bytes of the benchmark's windows up to which they are broadcast; beyond, windows are shuffled by their hashes.
MOST_BROADCAST = 64_000_000

NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Words that count as units after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yards kg g mg lb lbs oz pound pounds ton tons tonnes l ml liter liters litre litres "
    "s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit kmh mph w kw v hz mb gb kb"
).split()


def _units() -> str:
    return "|".join(sorted(UNITS, key=len, reverse=True))


def plain_words(text: Column) -> Column:
    """Words between white space, without those that have neither letter nor digit, joined by one space.

    No group is repeated and no run is given back, here and in template(): Java's
    patterns take neither stack nor quadratic time for long runs of marks.
    """
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?<![^\s\x01-\x03])[^\p{L}\p{N}\s\x01-\x03]++(?![^\s\x01-\x03])", "")
    return F.trim(F.regexp_replace(t, r"[\s\x01-\x03]++", " "))


def template(words: Column) -> Column:
    """The words' template: as many words, divided by single spaces."""
    t = F.regexp_replace(words, rf"(?<![^ ])[^\p{{L}}\p{{N}} ]*+\d[\d.,:/]*+(?:{_units()})?[^\p{{L}}\p{{N}} ]*+(?![^ ])", NUMBER)
    t = F.regexp_replace(t, rf"(?<={NUMBER} )(?i:{_units()})[^\p{{L}}\p{{N}} ]*+(?![^ ])", UNIT)
    t = F.regexp_replace(t, r"(?<=[^ .!?] )[^\p{L}\p{N} ]*+\p{Lu}\p{Ll}[^ ]*+", NAME)
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}} {NUMBER}{NAME}{UNIT}]++", "")


def folded(words: Column) -> Column:
    """Words in folded case without marks: as many words. A plain word of a template folds to the same."""
    return F.regexp_replace(F.lower(F.upper(words)), r"[^\p{L}\p{N} ]++", "")


def index(benchmark: DataFrame, shortest: int = WINDOW) -> DataFrame:
    """item_id, item_at, own and kinds (words of the window, raw and template), h (hash of kinds; null where too few are plain),
    own_h (hash of the folded words), width (words of the window), n_windows and n_own of the item (distinct h and own_h),
    anchor and its place: the longest plain word of the window, folded, by which it is looked up, or the longest of any kind where h is null.

    Items of fewer words than a window have one, of all their words, if they have `shortest` words.
    """
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("plain")).filter("plain != ''")
    rows = rows.select("item_id", F.split("plain", " ").alias("own"), F.split(template(F.col("plain")), " ").alias("words"), F.split(folded(F.col("plain")), " ").alias("low")).filter(F.size("words") >= shortest).distinct()
    width = F.least(F.size("words"), F.lit(WINDOW))
    places = F.sequence(F.lit(1), F.size("words") - width + 1)
    rows = rows.select("item_id", width.alias("width"), F.posexplode(F.transform(places, lambda i: F.struct(F.slice("words", i, width).alias("kinds"), F.slice("own", i, width).alias("own"), F.slice("low", i, width).alias("low")))).alias("at", "w"))
    literal = F.size(F.filter("w.kinds", lambda k: ~k.isin(NUMBER, NAME, UNIT)))
    kept = (F.col("width") == WINDOW) & (literal >= PLAIN)
    rows = rows.select("item_id", "width", F.col("at").alias("item_at"), F.when(kept, F.xxhash64("w.kinds")).alias("h"), F.xxhash64("w.low").alias("own_h"), "w.own", "w.kinds", "w.low")
    n = rows.groupBy("item_id").agg(F.countDistinct("h").alias("n_windows"), F.countDistinct("own_h").alias("n_own"))
    typed = lambda i: F.col("h").isNotNull() & F.get("kinds", i).isin(NUMBER, NAME, UNIT)
    longest = F.array_max(F.transform(F.col("low"), lambda k, i: F.struct(F.when(typed(i), F.lit(0)).otherwise(F.length(k)).alias("n"), k.alias("word"), i.alias("place"))))
    return rows.join(n, "item_id").withColumn("longest", longest).select("*", F.col("longest.word").alias("anchor"), F.col("longest.place").alias("place")).drop("longest", "low")


def _worded(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys with a text's raw words (own), template words (words) and folded words (low), as many of each."""
    rows = docs.select(*keys, plain_words(F.col("text")).alias("plain"))
    return rows.select(*keys, "plain", F.split(template(F.col("plain")), " ").alias("words"), F.split(folded(F.col("plain")), " ").alias("low"))


def hits(docs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """keys, at (a window's place) and the columns of the equal benchmark window, raw: the document's own words there,
    as_template and as_own: whether the templates are equal, and the folded words.

    Each word of a document is looked up among the anchors; only where it is
    one, the window around it is cut out and its hashes held against the benchmark's.
    For a benchmark that fits in memory: no row of a document leaves its task.
    """
    # outer: a filter that the optimizer infers for an inner one would canonicalise each text twice
    rows = _worded(docs, keys).select(*keys, "plain", "words", "low", F.posexplode_outer("low").alias("p", "anchor"))
    at = F.col("p") - F.col("place")
    found = rows.join(F.broadcast(wanted), "anchor").filter((at >= 0) & (at + F.col("width") <= F.size("words")))
    cut = lambda c: F.xxhash64(F.slice(c, F.greatest(at, F.lit(0)) + 1, F.col("width")))
    as_template, as_own = F.coalesce(cut("words") == F.col("h"), F.lit(False)), cut("low") == F.col("own_h")
    found = found.filter(as_template | as_own)
    return found.select(*keys, at.alias("at"), *wanted.drop("anchor", "place").columns, F.slice(F.split("plain", " "), at + 1, F.col("width")).alias("raw"), as_template.alias("as_template"), as_own.alias("as_own"))


def hits_by_hash(docs: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """As hits(), for a benchmark of any size: documents' windows are joined with the benchmark's by their hashes.

    A document's row is parted into windows of at most five words before the shuffle.
    """
    widths = F.array(*[F.lit(r.width) for r in wanted.select("width").distinct().collect()])  # 1 to WINDOW
    rows = _worded(docs, keys).select(*keys, F.split("plain", " ").alias("own"), "words", "low")
    rows = rows.select(*keys, "own", "words", "low", F.explode(widths).alias("width")).filter(F.size("words") >= F.col("width"))
    cut = lambda c, i: F.slice(c, i, F.col("width"))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.struct(F.xxhash64(cut("words", i)).alias("kinds_h"), F.xxhash64(cut("low", i)).alias("low_h"), cut("own", i).alias("raw")))
    rows = rows.select(*keys, "width", F.posexplode(windows).alias("at", "w")).select(*keys, "at", "width", "w.*")
    keep = [*(F.col(f"d.{k}") for k in keys), F.col("d.at"), *(F.col(f"b.{c}") for c in wanted.drop("anchor", "place").columns), F.col("d.raw")]
    same_width = F.col("d.width") == F.col("b.width")
    d, b = rows.alias("d"), wanted.alias("b")
    as_own = F.col("d.low_h") == F.col("b.own_h")
    as_template = F.col("d.kinds_h") == F.col("b.h")
    own = d.join(b, as_own & same_width).select(*keep, F.coalesce(as_template, F.lit(False)).alias("as_template"), F.lit(True).alias("as_own"))
    other = d.join(b, as_template & same_width).filter(~as_own).select(*keep, F.lit(True).alias("as_template"), F.lit(False).alias("as_own"))
    return own.unionByName(other)


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, shortest: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, tie, item_id, n_found, n_windows, containment, reparameterised.

    A row for each document and item of which the document holds at least that
    share of windows, as templates or by its own words, whichever is more (n_found and n_windows are of these). tie is a hash of the text: rows that share an id (or have none) are judged each
    by its own text, and equal rows give one result. Null and empty
    texts hold nothing; items of fewer words than `shortest` aren't looked for; rows without item_id are ignored.
    Words of any length and texts of any number of words are taken whole.
    """
    wanted = written(index(benchmark, shortest), "decontamination-index")
    # a window's words stand there raw, as template and as anchor, besides its numbers
    size = wanted.agg(F.sum(F.lit(200) + 4 * F.octet_length(F.concat_ws(" ", "own")))).first()[0] or 0
    find = hits if size <= most_broadcast else hits_by_hash
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), "text")
    found = find(keyed, wanted, "doc_id", "tie").select("doc_id", "tie", "item_id", "h", "own_h", "n_windows", "n_own", "as_template", "as_own", (F.col("at") - F.col("item_at")).alias("diagonal"), F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("own").alias("item"), F.col("raw").alias("doc")), lambda x: x["kind"].isin(NUMBER, NAME, UNIT)).alias("slots")).distinct()
    found = written(found, "decontamination-hits")
    line = ["doc_id", "tie", "item_id", "diagonal"]
    slots = found.filter("as_template").select(*line, F.explode("slots").alias("s")).select(*line, F.col("s.kind").alias("kind"), F.col("s.item").alias("item"), F.col("s.doc").alias("doc"))
    torn = slots.groupBy(*line, "kind", "item").agg(F.countDistinct("doc").alias("n")).filter("n > 1")
    torn = torn.groupBy(*line).agg(F.collect_set(F.struct("kind", "item")).alias("torn"))  # an item's values at most
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in line]
    judged = found.alias("a").join(torn.alias("b"), same, "left").select("a.*", "b.torn")
    bad = F.exists("slots", lambda s: F.array_contains(F.col("torn"), F.struct(s["kind"].alias("kind"), s["item"].alias("item"))))
    sound = F.col("as_template") & (F.col("torn").isNull() | ~bad)
    changed = F.exists("slots", lambda s: s["item"] != s["doc"])
    found = judged.groupBy("doc_id", "tie", "item_id").agg(
        F.countDistinct(F.when(sound, F.col("h"))).alias("n_template"),
        F.countDistinct(F.when(F.col("as_own"), F.col("own_h"))).alias("n_same"),
        F.max("n_windows").alias("n_windows"),
        F.max("n_own").alias("n_own"),
        F.coalesce(F.max(F.when(sound, changed)), F.lit(False)).alias("changed"),
    )
    by_template = F.when(F.col("n_windows") > 0, F.col("n_template") / F.col("n_windows")).otherwise(F.lit(0.0))
    by_own = F.col("n_same") / F.col("n_own")
    own = by_own > by_template
    found = found.select("doc_id", "tie", "item_id", F.when(own, F.col("n_same")).otherwise(F.col("n_template")).alias("n_found"), F.when(own, F.col("n_own")).otherwise(F.col("n_windows")).alias("n_windows"), F.greatest(by_own, by_template).alias("containment"), (~own & F.col("changed")).alias("reparameterised"))
    return found.filter(F.col("containment") >= containment)


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay as they are.

    Rows are judged each by its own text, also where they share an id or have none, and
    equal rows go or stay together. Null and empty texts stay; an empty table gives
    no rows, and with an empty benchmark all rows stay.
    """
    key, tie = unused(docs, "id"), unused(docs, "tie")
    bad = contaminated(docs, benchmark, containment, shortest=1).select(F.col("doc_id").alias(key), F.col("tie").alias(tie)).distinct()
    bad = ids_fit(written(bad, "decontamination-rows"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tie))
    return docs.join(bad, match, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1).drop("tie")
