"""Queries of the training-data problems, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .components import consolidate
from .golden import golden_records
from .history import dedup_inbox
from .leaks import find_leaks, remove_leaks
from .mixing import mix_shares
from .residue import find_residue
from .similar import similar_pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "asset_embedding"), "asset_id", "model", "vec", k=5, min_cosine=0.9)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(
        table(spark, sf_dir, "asset"), table(spark, sf_dir, "membership"), table(spark, sf_dir, "match_pair")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(
        table(spark, sf_dir, "dedup_cluster"), table(spark, sf_dir, "membership"), table(spark, sf_dir, "asset")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_inbox(table(spark, sf_dir, "asset"), table(spark, sf_dir, "asset_inbox"))


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(
        table(spark, sf_dir, "dedup_cluster"),
        table(spark, sf_dir, "membership"),
        table(spark, sf_dir, "asset"),
        fields=("path", "gps_lat", "gps_lon", "live_cid", "burst_uuid"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_filled": p5_filled,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_cleaned": p8_cleaned,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
}

SQL: dict[str, str] = {
    "p8_found": """
        WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM eval_item),
        dk AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda n: array_to_string(w[n:n + 11], ' '))) AS k FROM d WHERE len(w) >= 12),
        ik AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda n: array_to_string(w[n:n + 11], ' '))) AS k FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dk JOIN ik USING (k)
    """,
    "p3_found": """
        WITH RECURSIVE ledger AS (SELECT DISTINCT id, phash FROM asset),
        member AS (SELECT DISTINCT m.cluster_id, m.asset_id FROM membership m JOIN ledger l ON l.id = m.asset_id),
        edge AS (
            SELECT x.asset_id AS a, y.asset_id AS b FROM member x JOIN member y USING (cluster_id)
            WHERE x.asset_id <> y.asset_id
            UNION
            SELECT p.asset_a, p.asset_b FROM match_pair p JOIN ledger l ON l.id = p.asset_a JOIN ledger r ON r.id = p.asset_b
            WHERE p.asset_a <> p.asset_b AND bit_count(xor(l.phash, r.phash)) <= 6
        ),
        both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
        reach AS (
            SELECT a AS asset_id, a AS seen FROM both_ways
            UNION
            SELECT r.asset_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
        )
        SELECT asset_id, min(seen) AS group_id FROM reach GROUP BY asset_id
    """,
    "p5_found": """
        WITH m AS (
            SELECT DISTINCT c.cluster_id, a.id, a.taken_at,
                   coalesce(a.exif_fields, 0) AS e, coalesce(a.width::BIGINT * a.height, -1) AS p, coalesce(a.bytes, -1) AS b,
                   (lower(a.format) IN ('raw','heic','heif','dng','arw','cr2','cr3','nef','orf','raf','rw2'))::INT AS f,
                   CASE a.source WHEN 'originals' THEN 3 WHEN 'icloud' THEN 2 WHEN 'google' THEN 1 ELSE 0 END AS s,
                   CASE a.taken_src WHEN 'exif' THEN 4 WHEN 'json' THEN 3 WHEN 'filename' THEN 2 WHEN 'mtime' THEN 1 ELSE 0 END AS d
            FROM membership c JOIN asset a ON a.id = c.asset_id
        ),
        keep AS (
            SELECT x.cluster_id, min(x.id) AS keep_asset_id FROM m x WHERE NOT EXISTS (
                SELECT 1 FROM m y WHERE y.cluster_id = x.cluster_id
                AND (y.e > x.e OR y.p > x.p OR y.b > x.b OR y.f > x.f OR y.s > x.s))
            GROUP BY x.cluster_id
        ),
        dated AS (
            SELECT m.cluster_id, m.id, row_number() OVER (
                PARTITION BY m.cluster_id ORDER BY m.d DESC, (m.id = k.keep_asset_id) DESC, m.id) AS n
            FROM m LEFT JOIN keep k USING (cluster_id) WHERE m.taken_at IS NOT NULL
        )
        SELECT c.id AS cluster_id, k.keep_asset_id, d.id AS date_asset_id
        FROM (SELECT DISTINCT id FROM dedup_cluster) c
        LEFT JOIN keep k ON k.cluster_id = c.id LEFT JOIN dated d ON d.cluster_id = c.id AND d.n = 1
    """,
    "p1_found": """
        WITH v AS (
            SELECT DISTINCT asset_id, model, vec::DOUBLE[] AS vec FROM asset_embedding
            WHERE vec IS NOT NULL AND len(vec) > 0 AND NOT list_bool_or(list_transform(vec, lambda x: x IS NULL OR isnan(x)))
              AND list_sum(list_transform(vec, lambda x: x * x)) > 0
        ),
        scored AS (
            SELECT l.asset_id AS a, r.asset_id AS b, l.model, list_cosine_similarity(l.vec, r.vec) AS cosine
            FROM v l JOIN v r ON l.model = r.model AND len(l.vec) = len(r.vec) AND l.asset_id <> r.asset_id
        ),
        ranked AS (
            SELECT a, b, cosine, row_number() OVER (PARTITION BY model, a ORDER BY cosine DESC, b) AS n FROM scored
        )
        SELECT DISTINCT least(a, b) AS asset_a, greatest(a, b) AS asset_b FROM ranked WHERE n <= 5 AND cosine >= 0.9
    """,
    "p6_found": """
        WITH RECURSIVE rec AS (
            SELECT 0 AS n, id, path, phash, taken_at FROM (SELECT DISTINCT id, path, phash, taken_at FROM asset WHERE status IN ('canonical', 'promoted'))
            UNION ALL
            SELECT row_number() OVER (ORDER BY batch_no, id), id, path, phash, taken_at
            FROM (SELECT DISTINCT id, batch_no, path, phash, taken_at FROM asset_inbox)
        ),
        tidy AS (
            SELECT n, id, phash, nfc_normalize(lower(nfc_normalize(path))) AS low,
                   regexp_replace(trim(taken_at), ' ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})$', '') AS shown FROM rec
        ),
        keyed AS (
            SELECT n, id, phash,
                   CASE WHEN trim(low) <> '' THEN regexp_replace(regexp_replace(regexp_replace(
                       regexp_replace(low, '(/\\.)+(/|$)', '\\2', 'g'), '/+', '/', 'g'), '^\\./', ''), '(.)/$', '\\1') END AS file,
                   epoch(try_strptime(regexp_replace(shown, '[.,][0-9]+$', ''),
                       ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y%m%dT%H%M%S', '%Y%m%d_%H%M%S', '%Y%m%d-%H%M%S',
                        '%Y%m%d%H%M%S', '%d-%b-%Y %H:%M:%S', '%d %b %Y, %I:%M:%S %p', '%a, %d %b %Y %H:%M:%S']))::BIGINT AS sec
            FROM tidy
        ),
        met AS (
            SELECT a.n AS old_n, a.id AS known_id, b.n, b.id AS new_id FROM keyed a JOIN keyed b ON a.file = b.file AND a.n < b.n
            UNION
            SELECT a.n, a.id, b.n, b.id FROM keyed a JOIN (SELECT *, unnest([sec - 2, sec - 1, sec, sec + 1, sec + 2]) AS at FROM keyed) b ON a.sec = b.at AND a.n < b.n
            WHERE bit_count(xor(a.phash, b.phash)) <= 6
        ),
        against AS (SELECT k.n, bool_or(coalesce(m.old_n = 0, false)) AS old, list(m.old_n) FILTER (WHERE m.old_n > 0) AS earlier FROM keyed k LEFT JOIN met m USING (n) WHERE k.n > 0 GROUP BY k.n),
        decided AS (
            SELECT 0::BIGINT AS n, []::BIGINT[] AS accepted
            UNION ALL
            SELECT a.n, CASE WHEN a.old OR list_has_any(d.accepted, coalesce(a.earlier, [])) THEN d.accepted ELSE list_append(d.accepted, a.n) END
            FROM decided d JOIN against a ON a.n = d.n + 1
        ),
        taken AS (SELECT unnest(accepted) AS n FROM (SELECT accepted FROM decided ORDER BY n DESC LIMIT 1))
        SELECT DISTINCT known_id, new_id FROM met WHERE old_n = 0 OR old_n IN (SELECT n FROM taken)
    """,
    "p5_filled": """
        WITH RECURSIVE m AS (
            SELECT DISTINCT c.cluster_id AS g, a.id, a.taken_at, a.path, a.gps_lat, a.gps_lon, a.live_cid, a.burst_uuid,
                   coalesce(a.exif_fields, 0)::BIGINT AS e, coalesce(a.width::BIGINT * a.height, -1) AS p, coalesce(a.bytes, -1) AS b,
                   (lower(a.format) IN ('raw','heic','heif','dng','arw','cr2','cr3','nef','orf','raf','rw2'))::BIGINT AS f,
                   CASE a.source WHEN 'originals' THEN 3 WHEN 'icloud' THEN 2 WHEN 'google' THEN 1 ELSE 0 END::BIGINT AS s,
                   coalesce(floor(a.mtime)::BIGINT, -1) AS r,
                   CASE a.taken_src WHEN 'exif' THEN 4 WHEN 'json' THEN 3 WHEN 'filename' THEN 2 WHEN 'mtime' THEN 1 ELSE 0 END AS d
            FROM membership c JOIN asset a ON a.id = c.asset_id WHERE c.cluster_id IS NOT NULL
        ),
        beats AS (
            SELECT x.g, x.id AS winner, y.id AS loser FROM m x JOIN m y ON x.g = y.g
            WHERE x.e >= y.e AND x.p >= y.p AND x.b >= y.b AND x.f >= y.f AND x.s >= y.s AND x.r >= y.r
              AND (x.e > y.e OR x.p > y.p OR x.b > y.b OR x.f > y.f OR x.s > y.s OR x.r > y.r)
        ),
        chain AS (
            SELECT g, id, 1 AS layer FROM m
            UNION
            SELECT b.g, b.loser, c.layer + 1 FROM chain c JOIN beats b ON b.g = c.g AND b.winner = c.id
        ),
        lay AS (SELECT g, id, max(layer) AS layer FROM chain GROUP BY g, id),
        o AS (
            SELECT m.*, row_number() OVER (PARTITION BY m.g ORDER BY layer, e DESC, p DESC, b DESC, f DESC, s DESC, r DESC, m.id) AS n
            FROM m JOIN lay ON lay.g = m.g AND lay.id = m.id
        ),
        filled AS (
            SELECT g, arg_min(id, n) AS keep_asset_id, arg_min(path, n) FILTER (path IS NOT NULL) AS path, arg_min(gps_lat, n) FILTER (gps_lat IS NOT NULL) AS gps_lat,
                   arg_min(gps_lon, n) FILTER (gps_lon IS NOT NULL) AS gps_lon, arg_min(live_cid, n) FILTER (live_cid IS NOT NULL) AS live_cid,
                   arg_min(burst_uuid, n) FILTER (burst_uuid IS NOT NULL) AS burst_uuid FROM o GROUP BY g
        ),
        dated AS (
            SELECT o.g, o.id, row_number() OVER (PARTITION BY o.g ORDER BY o.d DESC, (o.n = 1) DESC, o.id) AS k FROM o WHERE taken_at IS NOT NULL
        )
        SELECT c.id AS cluster_id, f.keep_asset_id, d.id AS date_asset_id, f.path, f.gps_lat, f.gps_lon, f.live_cid, f.burst_uuid
        FROM (SELECT DISTINCT id FROM dedup_cluster WHERE id IS NOT NULL) c LEFT JOIN filled f ON f.g = c.id LEFT JOIN dated d ON d.g = c.id AND d.k = 1
    """,
}
