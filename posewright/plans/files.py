"""Queries that write the pipeline's files and read them again, and queries of the small tables of a rig."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BONES_WITH_ROOT, MIRROR_PAIRS
from ..functions import vectors
from ..operators import joins, series, tracks
from ..sources import files, sinks
from ..staging import new_path
from .embeddings import drawn
from .registry import query, table
from .series import event_series


def _lines(spark, path):
    """Lines of a file with their numbers: those of later files follow those of earlier ones."""
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("hash_file", f"""SELECT '{sinks.HASH_HEADER}' AS line UNION ALL SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, printf('%.6f', o_totalprice), CAST(o_custkey AS VARCHAR), '7') FROM orders""")
def hash_file(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("anim_id"), F.col("o_orderstatus").alias("clip_id"),
                                            F.col("o_totalprice").alias("duration"), F.col("o_custkey").alias("hash_fnv"), F.lit(7).alias("hash_murmur"))
    path = new_path(spark, "hash-file")
    sinks.write_lines(sinks.hash_lines(rows), path, header=sinks.HASH_HEADER)
    return _lines(spark, path)


@query("manifest_file", """SELECT CAST(o_orderkey AS VARCHAR) AS anim_id, o_orderstatus AS clip_id, round(o_totalprice, 6) AS duration, CAST(o_custkey AS INT) AS num_frames FROM orders""")
def manifest_file(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("anim_id"), F.col("o_orderstatus").alias("clip_id"), F.col("o_totalprice").alias("duration"),
                                            F.col("o_custkey").alias("num_frames"))
    path = new_path(spark, "manifest")
    sinks.write_lines(sinks.manifest_lines(rows).coalesce(1), path, header=sinks.MANIFEST_HEADER)
    return files.read_manifest(spark, path)


def _embedding_file(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("anim_id"), F.col("label").cast("string").alias("clip_id"),
                                            (F.col("vec_id") / 3).alias("duration"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"))
    path = new_path(spark, "embedding-file")
    sinks.write_lines(sinks.embedding_lines(e, "vec_id"), path, ["vec_id"], sinks.embedding_header(64))
    return path


EMBEDDED = """SELECT CAST(vec_id AS VARCHAR) AS anim_id, CAST(label AS VARCHAR) AS clip_id, round(vec_id / 3, 5) AS duration, {n} AS size,
round(list_sum(list_transform(embedding[:{n}]::DOUBLE[], lambda x: round(x, 8))), 5) AS total FROM embeddings"""


def _summed(rows):
    return rows.select("anim_id", "clip_id", F.round("duration", 5).alias("duration"), F.size("emb").alias("size"), F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("embedding_file", EMBEDDED.format(n=64))
def embedding_file(spark, d):
    return _summed(files.read_embeddings(spark, _embedding_file(spark, d)))


@query("embedding_file_clean", EMBEDDED.format(n=32))
def embedding_file_clean(spark, d):
    """The first 32 components, bad numbers as zeros."""
    return _summed(files.read_embeddings(spark, _embedding_file(spark, d), clean=True, components=32))


@query("embedding_file_rejects", """SELECT event_id % 5 AS kind, CASE WHEN event_id % 5 IN (1, 2, 3) THEN 'reject' ELSE 'row' END AS what, count(*) AS n FROM events GROUP BY 1, 2""")
def embedding_file_rejects(spark, d):
    """Bad lines of a file are put aside one by one."""
    i = F.col("event_id")
    end = F.when(i % 5 == 1, ",x,0.5").when(i % 5 == 2, "").when(i % 5 == 3, ",0.5,nan").otherwise(",0.5,0.25")
    lines = table(spark, d, "events").select(F.concat((i % 5).cast("string"), F.lit(",1,2.5"), end).alias("value"))
    rows, rejects = files.rows_and_rejects(lines)
    both = rows.select(F.col("anim_id").cast("long").alias("kind"), F.lit("row").alias("what")).unionByName(
        rejects.select(F.split("line", ",")[0].cast("long").alias("kind"), F.lit("reject").alias("what")))
    return both.groupBy("kind", "what").agg(F.count("*").alias("n"))


def _pose_file(spark, d):
    feat = F.transform(F.slice(F.concat("embedding", "embedding"), 1, 90), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("frame_ix"), feat.alias("feat"))
    path = new_path(spark, "pose-file")
    sinks.write_lines(sinks.pose_lines(rows, ["vec_id"]), path, ["frame_ix"], sinks.pose_header())
    return files.read_poses(spark, path)


@query("pose_file", """SELECT CAST(vec_id AS INT) AS frame, 90 AS size, round(list_sum(list_transform(list_concat(embedding, embedding)[:90]::DOUBLE[], lambda x: round(x, 8))), 5) AS total FROM embeddings""")
def pose_file(spark, d):
    return _pose_file(spark, d).select("frame", F.size("feat").alias("size"), F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("pose_file_positions", """SELECT CAST(vec_id AS INT) AS frame, CAST(b AS INT) AS bone_ix, CAST(printf('%.8f', e[6 * b + 1]) AS DOUBLE) AS px, CAST(printf('%.8f', e[6 * b + 2]) AS DOUBLE) AS py, CAST(printf('%.8f', e[6 * b + 3]) AS DOUBLE) AS pz
FROM (SELECT vec_id, list_concat(embedding, embedding)::DOUBLE[] AS e FROM embeddings), (SELECT unnest(range(15)) AS b)""")
def pose_file_positions(spark, d):
    return files.positions(_pose_file(spark, d)).select("frame", "bone_ix", "px", "py", "pz")


@query("group_file", f"""WITH r AS (SELECT '{sinks.GROUP_HEADER}' AS line UNION ALL SELECT concat_ws(',', CAST(vec_id AS VARCHAR), '0', printf('%.6f', vec_id / 3), CAST(label AS VARCHAR)) FROM embeddings) SELECT line FROM r""")
def group_file(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("anim_id"), F.lit("0").alias("clip_id"), (F.col("vec_id") / 3).alias("duration"),
                                               F.col("label").alias("group_id"))
    path = new_path(spark, "group-file")
    sinks.write_lines(sinks.group_file_lines(rows, "vec_id"), path, ["vec_id"], sinks.GROUP_HEADER)
    return _lines(spark, path)


def _packed(spark, d, limit=None):
    path = new_path(spark, "packed")
    sinks.write_packed(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_ix"), F.col("embedding").alias("feat"), "label"), path)
    return files.read_packed(spark, path, limit).select("row_ix", "label", F.size("feat").alias("size"))


@query("packed_file", "SELECT vec_id AS row_ix, label, 64 AS size FROM embeddings")
def packed_file(spark, d):
    return _packed(spark, d)


@query("packed_file_first", "SELECT vec_id AS row_ix, label, 64 AS size FROM embeddings ORDER BY vec_id LIMIT 100")
def packed_file_first(spark, d):
    """A limit operator: the first 100 clips of a packed file."""
    return _packed(spark, d, 100)


def _folder(spark, d, ending):
    """A file of one byte for each nation, by its number and region, and two of other names, in a new shared folder."""
    folder = new_path(spark, "clips")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f"{r[0]}-{r[1]}" for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]  # a table of fixed size
    for name in [*names, "manifest", "1-2-3"]:
        stream = store.create(path(f"{folder}/{name}{ending}"), True)
        stream.write(10)
        stream.close()
    return folder


@query("listed_clips", "SELECT CAST(n_nationkey AS VARCHAR) AS anim_id, CAST(n_regionkey AS VARCHAR) AS clip_id FROM nation UNION ALL SELECT NULL, NULL UNION ALL SELECT '2', '3'")
def listed_clips(spark, d):
    return files.list_clips(spark, _folder(spark, d, ".rbxm")).select("anim_id", "clip_id")


@query("listed_poses", "SELECT CAST(n_nationkey AS VARCHAR) AS anim_id, CAST(n_regionkey AS VARCHAR) AS clip_id, CAST(0 AS DOUBLE) AS duration FROM nation")
def listed_poses(spark, d):
    return files.clips_without_manifest(spark, _folder(spark, d, ".csv")).select("anim_id", "clip_id", "duration")


@query("catalog_file", "SELECT n_nationkey AS id FROM nation")
def catalog_file(spark, d):
    """A catalog with quotes in the middle of fields, line ends in quotes, and a quote that is never closed."""
    rows = table(spark, d, "nation").select(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('",a "quoted, part" of '), "n_name", F.lit(',"two\nlines"')).alias("line"))
    path = new_path(spark, "catalog")
    text = "\n".join(["AssetId,Name", *(r[0] for r in rows.collect()), 'x,"never closed', "77,1"])
    spark.createDataFrame([(text,)], "line string").coalesce(1).write.text(path)
    return files.read_catalog(spark, path)


@query("registered_clips", "SELECT count(*) FILTER (value >= 50) AS processed, count(*) FILTER (value < 50 OR value IS NULL) AS skipped FROM events")
def registered_clips(spark, d):
    kept, skipped = tracks.registered_clips(table(spark, d, "events"), F.col("value") >= 50)
    counts = kept.select(F.lit(1).alias("ok")).unionByName(skipped.select(F.lit(0).alias("ok")))
    return counts.agg(F.count_if(F.col("ok") == 1).alias("processed"), F.count_if(F.col("ok") == 0).alias("skipped"))


@query("default_tracks", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{b}')" for k, b in enumerate(BONES_WITH_ROOT)) + ") AS t(track_ix, bone)")
def default_tracks(spark, d):
    return spark.createDataFrame(list(enumerate(tracks.track_order())), "track_ix int, bone string")


SWAP = vectors.swap_index(15, vectors.parse_pairs(MIRROR_PAIRS))


@query("mirrored_energy", f"SELECT vec_id, round(list_sum(list_transform({[b + 1 for b in SWAP]}, lambda b, i: embedding[b]::DOUBLE * i)), 5) AS weighted FROM embeddings")
def mirrored_energy(spark, d):
    m = vectors.mirror_energy(F.transform(F.slice("embedding", 1, 15), lambda x: x.cast("double")), SWAP)
    weighted = F.aggregate(F.transform(m, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(weighted, 5).alias("weighted"))


@query("energy_statistics", f"""WITH r AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY {drawn('vec_id', 42)}, vec_id) AS k, count(*) OVER () AS n FROM embeddings),
t AS (SELECT unnest(embedding[:15])::DOUBLE AS x, generate_subscripts(embedding[:15], 1) - 1 AS bone_ix FROM r WHERE k > floor(n * 0.2))
SELECT CAST(bone_ix AS INT) AS bone_ix, round(avg(x), 6) AS energy_mean, round(stddev_pop(x) + 1e-6, 6) AS energy_std FROM t GROUP BY bone_ix""")
def energy_statistics(spark, d):
    """Mean and deviation of each bone's energy over the training rows."""
    split = joins.split_rows(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", 0.2)
    each = split.where("NOT is_validation").select(F.posexplode(F.slice("embedding", 1, 15)).alias("bone_ix", "energy")).withColumn("energy", F.col("energy").cast("double"))
    return series.statistics(each, ["bone_ix"], ["energy"]).select("bone_ix", *(F.round(c, 6).alias(c) for c in ("energy_mean", "energy_std")))


UNIFORM = lambda k: f"({drawn('id', k)} + 0.5) / 2147483647"


@query("noisy_frames", f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_ix, value FROM events), n AS (SELECT *, user_id * 1000003 + frame_ix AS id FROM e)
SELECT user_id, CAST(frame_ix AS INT) AS frame_ix, round(value + 0.02 * sqrt(-2 * ln({UNIFORM(1)})) * cos(2 * pi() * {UNIFORM(2)}), 6) AS value FROM n""")
def noisy_frames(spark, d):
    noisy = tracks.add_noise(F.col("value"), F.col("user_id") * 1000003 + F.col("frame_ix"))
    return event_series(spark, d).select("user_id", "frame_ix", F.round(noisy, 6).alias("value"))


TURN = "(l_linenumber * 40 + l_orderkey % 90) * pi() / 180"


@query("track_samples", f"""WITH k AS (SELECT l_orderkey AS clip, l_linenumber::DOUBLE AS t0, max(l_quantity) AS px, max(l_tax) AS py, sin({TURN}) AS qz, cos({TURN}) AS qw FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL),
s AS (SELECT *, lead(t0) OVER w AS t1, lead(px) OVER w AS px1, lead(py) OVER w AS py1, lead(qz) OVER w AS qz1, lead(qw) OVER w AS qw1, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY clip ORDER BY t0)),
g AS (SELECT DISTINCT l_orderkey AS clip, i AS frame_ix, i * 0.75 AS t FROM lineitem, (SELECT unnest(range(10)) AS i)),
m AS (SELECT g.clip, frame_ix, px, py, qz, qw, px1, py1, CASE WHEN qz * qz1 + qw * qw1 < 0 THEN -qz1 ELSE qz1 END AS qz1, CASE WHEN qz * qz1 + qw * qw1 < 0 THEN -qw1 ELSE qw1 END AS qw1,
  CASE WHEN t < t0 OR t1 IS NULL THEN 0 ELSE (t - t0) / (t1 - t0) END AS f FROM g LEFT JOIN s ON s.clip = g.clip AND (t >= t0 OR n = 1) AND (t < t1 OR t1 IS NULL)),
z AS (SELECT *, coalesce(qz + f * coalesce(qz1 - qz, 0), 0) AS z, coalesce(qw + f * coalesce(qw1 - qw, 0), 1) AS w FROM m)
SELECT clip, CAST(frame_ix AS INT) AS frame_ix, round(coalesce(px + f * coalesce(px1 - px, 0), 0), 8) AS px, round(coalesce(py + f * coalesce(py1 - py, 0), 0), 8) AS py, round(abs(z) / sqrt(z * z + w * w), 5) AS qz, round(abs(w) / sqrt(z * z + w * w), 5) AS qw FROM z""")
def track_samples(spark, d):
    """Position and rotation of tracks between their keys; clips without keys stay at the identity."""
    items = table(spark, d, "lineitem")
    turn = (F.col("l_linenumber") * 40 + F.col("l_orderkey") % 90) * F.lit(3.141592653589793) / 180
    keys = items.where("l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("double").alias("key_time"), F.col("l_quantity").alias("px"),
                                                    F.col("l_tax").alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(turn).alias("qz"), F.cos(turn).alias("qw"))
    keys = keys.groupBy("clip", "key_time", "qx", "qy", "qz", "qw").agg(*(F.max(c).alias(c) for c in ("px", "py", "pz")))
    grid = items.select(F.col("l_orderkey").alias("clip")).distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame_ix")).withColumn("source_t", F.col("frame_ix") * 0.75)
    out = series.sample_track(grid, keys, keys, ["clip"])
    return out.select("clip", "frame_ix", F.round("px", 8).alias("px"), F.round("py", 8).alias("py"), F.round(F.abs("qz"), 5).alias("qz"), F.round(F.abs("qw"), 5).alias("qw"))
