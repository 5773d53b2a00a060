"""Benchmark decontamination by typed templates; DataFrame operations only.

Numbers, names and units become typed placeholders, so that a question keeps its template when its
parameters change. Windows of ``WIDTH`` template words are hashed and joined with the windows of the
benchmark; a second search, where an item has names, also takes capitalised words inside a sentence as
names. A document that shares enough windows with an item is a candidate. The replaced words of the
shared windows must then agree: along one alignment, each word of the item stands for one word of the
document and the other way round. Windows that are the item's word for word count in any case.

Items that this leaves out in part, short ones and those rich in placeholders, are also searched word for
word, with each character of a script without spaces as a word.

Window hashes come from pairwise doubling (1, 2, 4, 8 words), so a window costs three hashes whatever its
width, and the only rows that leave the scan are those which match the benchmark. The outer form of
explode keeps the optimizer from inferring a filter that would inline one lambda into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .rows import take_out

DOUBLINGS = 3
WIDTH = 1 << DOUBLINGS
#: Windows that must be shared with an item (all of them, if it has fewer), and literal words a window needs.
MIN_WINDOWS, MIN_LITERALS = 6, 4
#: Items of so many words, but fewer than ``WIDTH``, are found word for word anywhere; shorter ones are whole texts only.
SHORTEST_INSIDE = 3
#: Characters of scripts written without spaces.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: The benchmark's windows are broadcast up to this many rows of at most 40 bytes, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Windows of an item, about, by which the number of files is chosen.
ROWS_AN_ITEM = 100

# Words that are numbers, units of measure, and common given names.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
           "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
           "million billion dozen half twice").split()
UNITS = ("mm cm km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards "
         "mile miles mg kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml liter liters litre litres "
         "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years mph kph "
         "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit watt watts volt volts").split()
NAMES = ("james john robert michael david william richard joseph thomas charles daniel matthew anthony mark steven paul "
         "andrew kevin brian george peter henry jack sam tom tim ben max leo mary patricia jennifer linda elizabeth "
         "barbara susan jessica sarah karen lisa nancy betty sandra ashley emily anna maria laura julia alice emma olivia "
         "sophia mia lucy jane kate bob carol dave eve frank grace ivan").split()
SPLIT = r"(?:[^\p{L}\p{N}.,]|[.,](?!\p{N})|(?<!\p{N})[.,])+"


def words(text: Column) -> Column:
    """Lower-case words; a number keeps its inner points and commas."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


#: Marks a name by its form, a capitalised word inside a sentence; ``SPLIT`` removes it from plain texts.
MARK = "\ue000"
NAME_FORM = r"(?<=[\p{L}\p{N},;)] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"


def named_words(text: Column) -> Column:
    """``words``, with ``MARK`` before capitalised words that follow a word or comma."""
    marked = F.regexp_replace(F.translate(text, MARK, " "), NAME_FORM, MARK + "$1")
    return F.filter(F.split(F.lower(marked), SPLIT.replace(r"[^\p{L}", rf"[^{MARK}\p{{L}}", 1)), lambda w: w != "")


def placeholder(w: Column) -> Column:
    """``#n``, ``#u`` or ``#p`` for a number, unit or name; null for a literal word."""
    return (F.when(((w >= "0") & (w < ":")) | w.isin(NUMBERS), "#n").when(w.isin(UNITS), "#u").when(w.isin(NAMES) | w.startswith(MARK), "#p"))


def _hashed(rows: DataFrame) -> DataFrame:
    """Add ``size`` and ``windows``, the hash of the ``WIDTH`` template words from each position of ``words``.

    Hashes past the last full window are left in place for the caller to cut; a text of fewer words has
    one window, of all its words.
    """
    out = rows.withColumn("size", F.size("words")).withColumn(
        "windows", F.transform("words", lambda w: F.xxhash64(F.coalesce(placeholder(w), w))))
    short = F.xxhash64(F.concat_ws(" ", F.transform("words", lambda w: F.coalesce(placeholder(w), w))), F.lit(-1))
    for k in range(DOUBLINGS):
        out = out.withColumn("windows", F.expr(f"transform(windows, (h, i) -> xxhash64(h, get(windows, i + {1 << k})))"))
    return out.withColumn("windows", F.when(F.col("size") == 0, F.array().cast("array<bigint>")).when(
        F.col("size") < WIDTH, F.array(short)).otherwise(F.expr(f"slice(windows, 1, size - {WIDTH - 1})")))


def benchmark_windows(benchmark: DataFrame, split=words) -> DataFrame:
    """``item_id, item_row, at, hash, n_windows, slots``: usable windows of each item; ``slots`` counts placeholders."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("item_row"), split(F.col("text")).alias("words"))
    each = _hashed(items).select("item_id", "item_row", "words", "size", F.posexplode_outer("windows").alias("at", "hash"))
    part = F.slice("words", F.col("at") + 1, F.least(F.col("size"), F.lit(WIDTH)))
    each = each.select("item_id", "item_row", "at", "hash", "size", F.size(F.filter(part, lambda w: placeholder(w).isNotNull())).alias("slots"))
    usable = each.where(F.col("hash").isNotNull() & (F.least("size", F.lit(WIDTH)) - F.col("slots") >= F.least("size", F.lit(MIN_LITERALS)))).distinct()
    n = usable.groupBy("item_row").agg(F.countDistinct("at").alias("n_windows"))
    return usable.join(n, "item_row").select("item_id", "item_row", "at", "hash", "n_windows", "slots")


def exact_words(text: Column) -> Column:
    """``words``, with each character of a script without spaces as one."""
    return words(F.regexp_replace(text, f"({UNSPACED})", " $1 "))


def _exact_windows(rows: DataFrame, lengths: list[int], item: bool) -> DataFrame:
    """Explode ``words`` to ``at, hash`` of its literal windows: of each length for documents, of its own (``WIDTH`` at most) for items."""
    size = F.size("words")
    each = []
    for k in lengths:
        fits = size == k if k < SHORTEST_INSIDE or (item and k < WIDTH) else size >= k
        hashes = F.expr(f"transform(sequence(0, size(words) - {k}), i -> xxhash64(slice(words, i + 1, {k}), {k}))")
        each.append(F.when(fits, F.transform(hashes, lambda h, i: F.struct(i.alias("at"), h.alias("hash")))).otherwise(
            F.array().cast("array<struct<at:int,hash:bigint>>")))
    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.explode_outer(F.concat(*each)).alias("w")).select(*kept, "w.at", "w.hash").where("hash IS NOT NULL")


def exact_matches(docs: DataFrame, benchmark: DataFrame, usable: DataFrame) -> DataFrame | None:
    """``doc_id, row, item_id, item_row, n_windows, n``: literal windows shared with the items that templates leave out in part.

    These are items with a window that is not usable as a template, under ``WIDTH`` words, or in a script
    without spaces; None if there are none.
    """
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("item_row"), words(F.col("text")).alias("w"), "text")
    seen = usable.groupBy("item_row").agg(F.countDistinct("at").alias("seen"))
    left = items.join(seen, "item_row", "left").where(
        (F.size("w") < WIDTH) | (F.size("w") - (WIDTH - 1) > F.coalesce("seen", F.lit(0))) | F.col("text").rlike(UNSPACED))
    left = left.select("item_id", "item_row", exact_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in left.select(F.least(F.size("words"), F.lit(WIDTH))).distinct().collect())
    if not lengths:
        return None
    wanted = stage(_exact_windows(left, lengths, True).distinct(), "exact-windows", rows=ROWS_AN_ITEM * benchmark.count())
    wanted = wanted.join(wanted.groupBy("item_row").agg(F.countDistinct("at").alias("n_windows")), "item_row")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), exact_words(F.col("text")).alias("words"))
    found = _exact_windows(rows, lengths, False).drop("at")
    small = wanted.count() <= BROADCAST_ROWS
    return found.join(F.broadcast(wanted) if small else wanted, "hash").groupBy("doc_id", "row", "item_id", "item_row", "n_windows").agg(
        F.countDistinct("at").alias("n")).where(F.col("n") >= F.least("n_windows", F.lit(MIN_WINDOWS)))


def _inconsistent(docs: DataFrame, benchmark: DataFrame, matches: DataFrame, split) -> DataFrame:
    """``row, item_row, pos, at`` of windows, not equal word for word, of alignments whose slots do not map one to one."""
    wanted = matches.where("slots > 0").select("row", "pos", "item_row", "at").distinct()

    def texts(table, row, name):
        each = table.select(F.xxhash64("text").alias(row), split(F.col("text")).alias(name))
        return each.join(wanted.select(row).distinct(), row, "left_semi").dropDuplicates([row])

    cut = lambda c, at: F.slice(c, F.col(at) + 1, WIDTH)
    slotted = stage(wanted.join(texts(docs, "row", "words"), "row").join(texts(benchmark, "item_row", "item_words"), "item_row").select(
        "row", "item_row", "pos", "at", (F.col("pos") - F.col("at")).alias("shift"), cut("words", "pos").alias("d"), cut("item_words", "at").alias("b")), "benchmark-slots")
    keys = ["row", "item_row", "shift"]
    pairs = slotted.select(*keys, F.explode(F.arrays_zip("d", "b")).alias("p")).select(*keys, F.col("p.d").alias("d"), F.col("p.b").alias("b"))
    pairs = pairs.where(placeholder(F.col("b")).isNotNull()).withColumns({c: F.translate(c, MARK, "") for c in ("d", "b")})
    bad = pairs.groupBy(*keys).agg(
        F.countDistinct("d").alias("nd"), F.countDistinct("b").alias("nb"), F.countDistinct("d", "b").alias("np")).where("np > nd OR np > nb")
    return slotted.where("d <> b").join(bad, keys, "left_semi").select("row", "item_row", "pos", "at")


def template_matches(docs: DataFrame, benchmark: DataFrame, split) -> tuple[DataFrame, DataFrame]:
    """The usable windows of the items, and ``doc_id, row, item_id, item_row, n_windows, n`` of pairs that share enough of them."""
    items = stage(benchmark_windows(benchmark, split), "benchmark-windows", rows=ROWS_AN_ITEM * benchmark.count())
    small = items.count() <= BROADCAST_ROWS
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), split(F.col("text")).alias("words"))
    windows = _hashed(rows).select("doc_id", "row", F.posexplode_outer("windows").alias("pos", "hash"))
    matches = windows.join(F.broadcast(items) if small else items, "hash")
    keys = ["doc_id", "row", "item_id", "item_row"]
    if not items.where("slots > 0").isEmpty():
        matches = stage(matches.select(*keys, "pos", "at", "n_windows", "slots"), "benchmark-matches")
        matches = matches.join(_inconsistent(docs, benchmark, matches, split), ["row", "item_row", "pos", "at"], "left_anti")
    return items, matches.groupBy(*keys, "n_windows").agg(F.countDistinct("at").alias("n")).where(
        F.col("n") >= F.least("n_windows", F.lit(MIN_WINDOWS)))


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, row, item_id, best``: the best of the searches for each text of a document and item; ``row`` is the text's digest."""
    items, found = template_matches(docs, benchmark, words)
    found = found.withColumn("route", F.lit(0))
    if not benchmark.where(F.exists(named_words(F.col("text")), lambda w: w.startswith(MARK) | w.isin(NAMES))).isEmpty():
        found = found.unionByName(template_matches(docs, benchmark, named_words)[1].withColumn("route", F.lit(-1)))
    literal = exact_matches(docs, benchmark, items)
    if literal is not None:
        found = found.unionByName(literal.withColumn("route", F.lit(-2)))
    return found.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("route", "n", "n_windows")).alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated pairs: ``doc_id, item_id, matched_windows, item_windows, coverage``.

    A pair is reported when the document shares at least ``MIN_WINDOWS`` of the item's windows, or all of
    them if it has fewer. An item of fewer than ``WIDTH`` words matches a text equal to it as a template, and
    from ``SHORTEST_INSIDE`` words on any text that holds it word for word. Pairs of the templates carry
    the templates' figures, others those of the search with names by form, or else of literal windows. Null
    and empty texts, of either table, match nothing; a null ``doc_id`` or ``item_id`` is a value like any
    other. Every text is judged alone: of rows that share an id, one pair is reported, with the figures of
    the text that matches best. Repeated rows count once; an empty table gives an empty result.
    """
    best = _pairs(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").alias("matched_windows"), F.col("best.n_windows").alias("item_windows")).withColumn(
        "coverage", F.col("matched_windows") / F.col("item_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item, with all their columns.

    The verdict is the text's: a clean row stays, whether it shares its ``doc_id`` with a contaminated one or
    has none.
    """
    found = _pairs(docs, benchmark).select("doc_id", F.col("row").alias("key"), F.lit(False).alias("kept"))
    return take_out(docs, F.xxhash64("text"), found)


def _oracle() -> str:
    """The pairs in DuckDB SQL, with windows as strings and lists: templates and literal windows, without the names by form."""
    listed = lambda words_: ", ".join(f"'{w}'" for w in words_)
    number = r"[\p{L}\p{N}]*\p{N}(?:[.,]\p{N}(?:[\p{L}\p{N}]*\p{N})?)*[.,]\p{N}[\p{L}\p{N}]*|[\p{L}\p{N}]+"
    kind = f"CASE WHEN (x >= '0' AND x < ':') OR x IN ({listed(NUMBERS)}) THEN '#n' WHEN x IN ({listed(UNITS)}) THEN '#u' WHEN x IN ({listed(NAMES)}) THEN '#p' END"
    ahead = " || ' ' || ".join(["c", *(f"lead(c, {k}) OVER o" for k in range(1, WIDTH))])
    marks = " + ".join(["m", *(f"coalesce(lead(m, {k}) OVER o, 0)" for k in range(1, WIDTH))])
    later = lambda side: " UNION ALL ".join(
        f"SELECT h.n, {k} AS k, t.x, t.m FROM hits h JOIN typed t ON t.r = h.{side}r AND t.q = h.{side}q + {k} WHERE h.slots > 0" for k in range(WIDTH))
    unspaced = UNSPACED.replace("Is", "")
    next_words = ", ".join(f"lead(x, {k}) OVER o" for k in range(1, WIDTH))
    return f"""
WITH texts AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL)),
split AS (SELECT side, id, r, regexp_extract_all(lower(text), '{number}') AS w FROM texts),
words AS (SELECT side, id, r, len(w) AS size, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM split),
typed AS (SELECT *, ({kind} IS NOT NULL)::INT AS m, coalesce({kind}, x) AS c FROM words),
spans AS (SELECT side, id, r, size, q, {ahead} AS s, {marks} AS slots FROM typed WINDOW o AS (PARTITION BY r ORDER BY q)),
shorts AS (SELECT side, id, r, size, 1 AS q, string_agg(c, ' ' ORDER BY q) || ' $' AS s, sum(m) AS slots FROM typed WHERE size < {WIDTH} GROUP BY side, id, r, size),
win AS (SELECT * FROM spans WHERE s IS NOT NULL UNION ALL SELECT * FROM shorts),
items AS (SELECT *, count(DISTINCT q) OVER (PARTITION BY r) AS n_windows FROM win WHERE side = 'b' AND least(size, {WIDTH}) - slots >= least(size, {MIN_LITERALS})),
hits AS (SELECT row_number() OVER () AS n, d.id AS doc_id, d.r AS dr, d.q AS dq, i.id AS item_id, i.r AS br, i.q AS bq, i.slots, n_windows FROM win d JOIN items i ON d.s = i.s WHERE d.side = 'd'),
dw AS ({later("d")}), bw AS ({later("b")}),
slotted AS (SELECT n, dr, br, dq - bq AS shift, dw.x AS dx, bw.x AS bx, bw.m FROM hits JOIN dw USING (n) JOIN bw USING (n, k)),
bad AS (SELECT dr, br, shift FROM slotted WHERE m = 1 GROUP BY ALL HAVING count(DISTINCT (dx, bx)) > count(DISTINCT dx) OR count(DISTINCT (dx, bx)) > count(DISTINCT bx)),
swapped AS (SELECT DISTINCT n FROM slotted JOIN bad USING (dr, br, shift) WHERE dx <> bx),
good AS (SELECT * FROM hits WHERE n NOT IN (SELECT n FROM swapped)),
found AS (SELECT doc_id, dr, item_id, br, n_windows, count(DISTINCT bq) AS n FROM good GROUP BY ALL HAVING count(DISTINCT bq) >= least(n_windows, {MIN_WINDOWS})),
chars AS (SELECT t.side, t.id, t.r, t.text, regexp_extract_all(lower(regexp_replace(t.text, '({unspaced})', ' \\1 ', 'g')), '{number}') AS w FROM texts t),
seen AS (SELECT r, count(DISTINCT q) AS seen FROM items GROUP BY r),
odd AS (SELECT c.r, least(len(c.w), {WIDTH}) AS k FROM chars c JOIN split USING (r) LEFT JOIN seen USING (r) WHERE c.side = 'b' AND len(c.w) > 0
  AND (len(split.w) < {WIDTH} OR len(split.w) - {WIDTH - 1} > coalesce(seen, 0) OR regexp_matches(c.text, '{unspaced}'))),
cwords AS (SELECT side, id, r, len(w) AS size, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM chars WHERE EXISTS (SELECT 1 FROM odd)),
cspans AS (SELECT side, id, r, size, q, [x, {next_words}] AS g FROM cwords WINDOW o AS (PARTITION BY r ORDER BY q)),
odd_items AS (SELECT id, r, q, g[:k] AS g, count(*) OVER (PARTITION BY r) AS n_windows FROM cspans JOIN odd USING (r) WHERE q + k - 1 <= size),
doc_at AS (SELECT id, r, g[:k] AS g FROM cspans, (SELECT DISTINCT k FROM odd) WHERE side = 'd' AND q + k - 1 <= size AND (size = k OR k >= {SHORTEST_INSIDE})),
plain AS (SELECT d.id AS doc_id, i.id AS item_id, i.r, n_windows, count(DISTINCT i.q) AS n FROM doc_at d JOIN odd_items i ON d.g = i.g
  GROUP BY d.id, d.r, i.id, i.r, n_windows HAVING count(DISTINCT i.q) >= least(n_windows, {MIN_WINDOWS})),
ways AS (SELECT doc_id, item_id, n, n_windows, 0 AS way FROM found UNION ALL SELECT doc_id, item_id, n, n_windows, -2 FROM plain),
best AS (SELECT doc_id, item_id, max((way, n, n_windows)) AS b FROM ways GROUP BY doc_id, item_id)
SELECT doc_id, item_id, b[2] AS matched_windows, b[3] AS item_windows, b[2]::DOUBLE / b[3] AS coverage FROM best
"""


ORACLE_SQL = _oracle()
