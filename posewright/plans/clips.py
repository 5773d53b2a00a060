"""Queries of ids, catalogs, fingerprints and duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BONES, PARENTS
from ..functions import hashing, text
from ..functions.vectors import quantize
from ..operators import fingerprint, joins
from ..sources import files, sinks
from .registry import query, table

EVENTS = """ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_ix, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts, event_id, event_type FROM events)"""
FNV_BYTES = """list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)),
  lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"""


def fnv_words(words: str) -> str:
    """DuckDB SQL for FNV-1a over the bytes of a list of words."""
    each = f"flatten(list_transform({words}, lambda w: [w % 256, (w // 256) % 256, (w // 65536) % 256, w // 16777216]))"
    return f"list_reduce(list_prepend(2166136261::UBIGINT, {each}), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"


def murmur_words(words: str) -> str:
    """DuckDB SQL for Murmur3 over a list of words."""
    rot = lambda x, r: f"((({x} * {2 ** r}) % 4294967296) + ({x} // {2 ** (32 - r)}))"
    k = f"list_transform({words}, lambda w: (w::HUGEINT * 3432918353) % 4294967296)"
    k = f"list_transform({k}, lambda w: ({rot('w', 15)} * 461845907) % 4294967296)"
    k = f"list_transform({k}, lambda w: w::UBIGINT)"
    step = f"lambda a, b: ({rot('xor(a, b)', 13)} * 5 + 3864292196) % 4294967296"
    return f"list_reduce(list_prepend(0::UBIGINT, {k}), {step})"


FMIX = """(SELECT xor(y, y // 65536) FROM (SELECT ((xor(x, x // 8192))::HUGEINT * 3266489909 % 4294967296)::UBIGINT AS y FROM
  (SELECT (xor(z, z // 65536)::HUGEINT * 2246822507 % 4294967296)::UBIGINT AS x FROM (SELECT xor({h}, {n} * 4) AS z))))"""


@query("fnv_duplicate_groups", f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS (SELECT doc_id, CAST({FNV_BYTES} AS BIGINT) AS hash_fnv FROM d)
SELECT hash_fnv, count(*) AS n, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids
FROM f GROUP BY hash_fnv HAVING count(*) > 1""")
def fnv_duplicate_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", hashing.fnv1a_text("text").alias("hash_fnv"))
    return fingerprint.duplicate_groups(docs, "hash_fnv", F.col("doc_id"))


def _series(spark, d):
    from .series import event_series

    return event_series(spark, d)


WORDS = """w AS (SELECT user_id, list_prepend(count(*)::UBIGINT, flatten(list([
  ((CAST(floor(value / 0.01 + 0.5) AS BIGINT) % 4294967296 + 4294967296) % 4294967296)::UBIGINT,
  ((CAST(floor(k / 0.01 + 0.5) AS BIGINT) % 4294967296 + 4294967296) % 4294967296)::UBIGINT] ORDER BY frame_ix))) AS words FROM ev GROUP BY user_id)"""
HASHED = f"""{EVENTS}, {WORDS}, f AS (SELECT user_id, CAST({fnv_words('words')} AS BIGINT) AS hash_fnv, {murmur_words('words')} AS h, len(words) AS n FROM w),
g AS (SELECT user_id, hash_fnv, CAST({FMIX.format(h='f.h', n='f.n')} AS BIGINT) AS hash_murmur FROM f)"""


@query("clip_fingerprints", f"WITH {HASHED} SELECT user_id, hash_fnv, hash_murmur, printf('%08X%08X', hash_fnv, hash_murmur) AS hash_key FROM g")
def clip_fingerprints(spark, d):
    words = fingerprint.stream(_series(spark, d), ["user_id"], ["value", "k"])
    return fingerprint.fingerprints(words)


def _doc_hashes(spark, d):
    docs = table(spark, d, "documents")
    return fingerprint.fingerprints(docs.select("doc_id", F.array(hashing.u32(F.col("n_chars")), hashing.u32(-F.length("lang"))).alias("words")))


DOC_HASHES = f"""w AS (SELECT doc_id, [n_chars::UBIGINT, (4294967296 - length(lang))::UBIGINT] AS words FROM documents),
f AS (SELECT doc_id, CAST({fnv_words('words')} AS BIGINT) AS hash_fnv, {murmur_words('words')} AS h, len(words) AS n FROM w),
g AS (SELECT doc_id, hash_fnv, CAST({FMIX.format(h='f.h', n='f.n')} AS BIGINT) AS hash_murmur FROM f),
x AS (SELECT *, printf('%08X%08X', hash_fnv, hash_murmur) AS hash_key FROM g)"""


@query("duplicate_groups_by_murmur", f"""WITH {DOC_HASHES} SELECT hash_murmur, count(*) AS n, min(doc_id) AS first_id,
string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM x GROUP BY hash_murmur HAVING count(*) > 1""")
def duplicate_groups_by_murmur(spark, d):
    return fingerprint.duplicate_groups(_doc_hashes(spark, d), "hash_murmur", F.col("doc_id"))


@query("duplicate_groups_by_key", f"""WITH {DOC_HASHES} SELECT hash_key, count(*) AS n, min(doc_id) AS first_id,
string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM x GROUP BY hash_key HAVING count(*) > 1""")
def duplicate_groups_by_key(spark, d):
    return fingerprint.duplicate_groups(_doc_hashes(spark, d), "hash_key", F.col("doc_id"))


@query("duplicate_group_counts", f"""WITH {DOC_HASHES} SELECT 'hash_fnv' AS hash, count(*) AS groups FROM (SELECT 1 FROM x GROUP BY hash_fnv HAVING count(*) > 1)
UNION ALL SELECT 'hash_murmur', count(*) FROM (SELECT 1 FROM x GROUP BY hash_murmur HAVING count(*) > 1)
UNION ALL SELECT 'hash_key', count(*) FROM (SELECT 1 FROM x GROUP BY hash_key HAVING count(*) > 1)""")
def duplicate_group_counts(spark, d):
    return fingerprint.group_counts(_doc_hashes(spark, d), ["hash_fnv", "hash_murmur", "hash_key"])


@query("hash_file_lines", f"""WITH {HASHED} SELECT concat_ws(',', CAST(user_id AS VARCHAR), 'c', printf('%.6f', user_id / 7), CAST(hash_fnv AS VARCHAR), CAST(hash_murmur AS VARCHAR)) AS line FROM g""")
def hash_file_lines(spark, d):
    rows = fingerprint.fingerprints(fingerprint.stream(_series(spark, d), ["user_id"], ["value", "k"]))
    return sinks.hash_lines(rows.select(F.col("user_id").cast("string").alias("anim_id"), F.lit("c").alias("clip_id"),
                                        (F.col("user_id") / 7).alias("duration"), "hash_fnv", "hash_murmur"))


@query("quantized_words", """SELECT event_id, CAST(floor(value / 0.01 + 0.5) AS BIGINT) AS q,
(CAST(floor((-value) / 0.01 + 0.5) AS BIGINT) % 4294967296 + 4294967296) % 4294967296 AS wrapped FROM events""")
def quantized_words(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", quantize(F.col("value"), 0.01).alias("q"), hashing.u32(quantize(-F.col("value"), 0.01)).alias("wrapped"))


NAMES = """names AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'dir\\x' WHEN doc_id % 5 = 1 THEN 'a/b/' WHEN doc_id % 5 = 2 THEN 'pre7x' ELSE '' END ||
  CAST(doc_id AS VARCHAR) || '-' || CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 7 = 3 THEN '.csv' ELSE '.rbxm' END AS path FROM documents)"""


def _names(spark, d):
    doc, n = F.col("doc_id"), F.col("n_chars")
    head = F.when(doc % 5 == 0, "dir\\x").when(doc % 5 == 1, "a/b/").when(doc % 5 == 2, "pre7x").otherwise("")
    tail = F.when(doc % 7 == 3, ".csv").otherwise(".rbxm")
    return table(spark, d, "documents").select("doc_id", F.concat(head, doc.cast("string"), F.lit("-"), n.cast("string"), tail).alias("path"))


@query("clip_ids_of_paths", f"""WITH {NAMES}, m AS (SELECT doc_id, regexp_extract(regexp_extract(path, '[^/\\\\]*$'), '([0-9]+)-([0-9]+)\\.rbxm$', ['a', 'c']) AS p FROM names)
SELECT doc_id, nullif(p.a, '') AS anim_id, nullif(p.c, '') AS clip_id FROM m""")
def clip_ids_of_paths(spark, d):
    anim, clip = text.clip_ids(F.col("path"))
    return _names(spark, d).select("doc_id", anim.alias("anim_id"), clip.alias("clip_id"))


@query("clip_ids_or_unknown", f"""WITH {NAMES}, m AS (SELECT doc_id, regexp_extract(path, '([0-9]+)-([0-9]+)\\.rbxm$', ['a', 'c']) AS p FROM names)
SELECT doc_id, coalesce(nullif(p.a, ''), '?') AS anim_id, coalesce(nullif(p.c, ''), '?') AS clip_id FROM m""")
def clip_ids_or_unknown(spark, d):
    anim, clip = text.clip_ids_or_unknown(F.col("path"))
    return _names(spark, d).select("doc_id", anim.alias("anim_id"), clip.alias("clip_id"))


URLS = """urls AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '&id=' || CAST(page_id AS VARCHAR) WHEN page_id % 4 = 1 THEN split_part(url, '?', 1)
  WHEN page_id % 4 = 2 THEN 'x://h/id/' || CAST(page_id AS VARCHAR) || '/y' ELSE 'x://h/?v=' || CAST(page_id AS VARCHAR) END AS url FROM pages)"""


@query("asset_ids_of_urls", f"""WITH {URLS} SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '[?&]id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)$', 1), ''),
nullif(regexp_extract(url, '/id/([0-9]+)', 1), ''), nullif(regexp_extract(url, '=([0-9]+)$', 1), '')) AS BIGINT) AS asset_id FROM urls""")
def asset_ids_of_urls(spark, d):
    p, s = F.col("page_id"), F.col("page_id").cast("string")
    url = (F.when(p % 4 == 0, F.concat("url", F.lit("&id="), s)).when(p % 4 == 1, F.split_part("url", F.lit("?"), F.lit(1)))
           .when(p % 4 == 2, F.concat(F.lit("x://h/id/"), s, F.lit("/y"))).otherwise(F.concat(F.lit("x://h/?v="), s)))
    return table(spark, d, "pages").select("page_id", text.asset_id(url).alias("asset_id"))


@query("catalog_ids", "SELECT TRY_CAST(regexp_extract(url, '[^/]*$') AS BIGINT) AS id FROM pages WHERE TRY_CAST(regexp_extract(url, '[^/]*$') AS BIGINT) IS NOT NULL")
def catalog_ids(spark, d):
    return files.catalog_ids(table(spark, d, "pages").select(F.regexp_extract("url", r"[^/]*$", 0).alias("c")), "c")


@query("quoted_csv_rows", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 0 AS row_ix, CAST(c_custkey AS VARCHAR) || '|' || c_name || ', "x"' || chr(10) || '|' || c_mktsegment AS line FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, '|' || CAST(c_nationkey AS VARCHAR) FROM customer""")
def quoted_csv_rows(spark, d):
    c = table(spark, d, "customer")
    csv = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""x""\n",'), "c_mktsegment", F.lit("\r\n,"), F.col("c_nationkey").cast("string"))
    rows = files.quoted_rows(c.select("c_custkey", csv.alias("text")), "c_custkey", "text")
    return rows.select("c_custkey", "row_ix", F.array_join("fields", "|").alias("line"))


@query("safe_numbers", """WITH t AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'nan' WHEN event_id % 6 = 1 THEN '-inf' WHEN event_id % 6 = 2 THEN event_type
WHEN event_id % 6 = 3 THEN NULL ELSE CAST(event_id AS VARCHAR) || '.25' END AS s FROM events), x AS (SELECT event_id, TRY_CAST(s AS DOUBLE) AS v FROM t)
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS value FROM x""")
def safe_numbers(spark, d):
    i = F.col("event_id")
    s = F.when(i % 6 == 0, "nan").when(i % 6 == 1, "-inf").when(i % 6 == 2, F.col("event_type")).when(i % 6 == 3, F.lit(None)).otherwise(F.concat(i.cast("string"), F.lit(".25")))
    return table(spark, d, "events").select("event_id", text.safe_double(s).alias("value"))


@query("resume_steps", """SELECT p.page_id, CASE WHEN l.doc_id IS NOT NULL THEN 'asset' ELSE 'asset and clip' END AS step
FROM pages p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = p.page_id WHERE p.page_id NOT IN (SELECT item_id FROM benchmark)""")
def resume_steps(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").alias("clip"))
    assets = table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"))
    clips = table(spark, d, "labels").select(F.col("doc_id").alias("clip"))
    return joins.still_to_do(pages, assets, clips, "page_id", "clip").select("page_id", "step")


@query("manifest_clips", "SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def manifest_clips(spark, d):
    return joins.clips_of_manifest(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"])


@query("manifest_rows", """SELECT CAST(o_orderkey AS VARCHAR) AS anim_id, o_orderstatus AS clip_id, o_totalprice AS duration,
CAST(greatest(0, trunc(o_totalprice / 1000 - 100)) AS INT) AS num_frames FROM orders""")
def manifest_rows(spark, d):
    o = table(spark, d, "orders")
    return files.manifest_rows(o.select(F.col("o_orderkey").cast("string").alias("anim_id"), F.col("o_orderstatus").alias("clip_id"),
                                        F.col("o_totalprice").cast("string").alias("duration"), (F.col("o_totalprice") / 1000 - 100).cast("string").alias("num_frames")))


@query("manifest_lines", "SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, printf('%.6f', o_totalprice), '7') AS line FROM orders")
def manifest_lines(spark, d):
    o = table(spark, d, "orders")
    return sinks.manifest_lines(o.select(F.col("o_orderkey").cast("string").alias("anim_id"), F.col("o_orderstatus").alias("clip_id"),
                                         F.col("o_totalprice").alias("duration"), F.lit(7).alias("num_frames")))


BONE_LIST = ", ".join(f"({k}, '{b}')" for k, b in enumerate(BONES))
TRACKS = f"""bones(bone_ix, bone) AS (VALUES {BONE_LIST}),
tracks AS (SELECT l_orderkey AS clip, b.bone, l_quantity AS px, l_tax AS lx FROM lineitem JOIN bones b ON b.bone_ix = (l_linenumber * 2) % 15)"""


def _tracks(spark, d):
    items = table(spark, d, "lineitem")
    name = F.get(F.array(*map(F.lit, BONES)), F.col("l_linenumber") * 2 % 15)
    return items.select(F.col("l_orderkey").alias("clip"), name.alias("bone"), F.col("l_quantity").alias("px"), F.col("l_tax").alias("lx"))


@query("poses_of_all_bones", f"""WITH {TRACKS}, one AS (SELECT clip, bone, max(ROW(px, lx)) AS v FROM tracks GROUP BY clip, bone), clips AS (SELECT DISTINCT clip FROM tracks)
SELECT c.clip, b.bone_ix, b.bone, coalesce(v[1], 0.0) AS px, coalesce(v[2], 0.0) AS lx FROM clips c CROSS JOIN bones b LEFT JOIN one o ON o.clip = c.clip AND o.bone = b.bone""")
def poses_of_all_bones(spark, d):
    return joins.poses_of_bones(_tracks(spark, d), ["clip"], BONES, {"px": 0.0, "lx": 0.0}).select("clip", "bone_ix", "bone", "px", "lx")


@query("bones_with_parent", f"""WITH {TRACKS}, p(bone, parent) AS (VALUES {", ".join(f"('{b}', '{p}')" for b, p in PARENTS.items())}), one AS MATERIALIZED (SELECT clip, bone, max(px) AS px FROM tracks GROUP BY clip, bone)
SELECT o.clip, o.bone, o.px, u.px AS px_parent FROM one o JOIN p ON p.bone = o.bone LEFT JOIN one u ON u.clip = o.clip AND u.bone = p.parent""")
def bones_with_parent(spark, d):
    one = _tracks(spark, d).groupBy("clip", "bone").agg(F.max("px").alias("px"))
    return joins.with_parent(one, ["clip"], ["px"]).select("clip", "bone", "px", "px_parent")


@query("status_counters", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'processed' WHEN value < 50 THEN 'skipped' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1")
def status_counters(spark, d):
    status = F.when(F.col("event_type").isin("click", "view"), "processed").when(F.col("value") < 50, "skipped").otherwise("failed")
    return fingerprint.to_clip(table(spark, d, "events"), status)
