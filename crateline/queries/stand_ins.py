"""The given tables seen as a music catalogue.

The expressions are written once, in text that Spark and the checking engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
MOOD_WORDS = "Dark;Happy;Energetic;Deep;Party;Melodic;Sad;Relaxing;Summer;Heavy;Love"

CATALOGUE = f"""
SELECT p_partkey AS id,
       '/lib/' || p_brand || '/' || CASE WHEN p_partkey % 3 = 0 THEN '0' || CAST(p_partkey % 10 AS STRING) || ' ' ELSE '' END
         || p_name || CASE WHEN p_partkey % 4 = 1 THEN ' (Mix ' || CAST(p_size AS STRING) || ')' ELSE '' END
         || CASE WHEN p_partkey % 5 = 2 THEN ' ' || CAST(p_size + 90 AS STRING) ELSE '' END || '.mp3' AS path,
       p_name AS name,
       '/lib/' || p_brand AS folder,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 6e1 + p_size * 2 + (p_partkey % 10) * 1e-1 END AS bpm,
       CASE WHEN p_partkey % 19 = 0 THEN NULL
            ELSE CAST(p_partkey % 12 + 1 AS STRING) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END END AS camelot,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size / 5e1 END AS danceability,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice * 1e-2 END AS energy_density,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE (p_partkey * 7919 % 1000) / 1e3 END AS energy_bass,
       CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE (p_partkey * 104729 % 4001) * 1e0 END AS energy_bright,
       (p_partkey % 101) / 1e2 AS energy_pulse,
       p_type || ' - ' || split_part(p_name, ' ', 2) || '; ' || p_type || ' - ' || split_part(p_name, ' ', 1) AS genres,
       p_type || ' - ' || split_part(p_name, ' ', 2) AS top_genre,
       CASE WHEN p_partkey % 37 = 0 THEN ''
            ELSE split_part('{MOOD_WORDS}', ';', CAST((p_partkey + p_size) % 11 + 1 AS INT)) || '; '
              || split_part('{MOOD_WORDS}', ';', CAST((p_partkey * 3 + p_size + 4) % 11 + 1 AS INT)) END AS moods,
       CASE WHEN p_partkey % 41 = 0 THEN 0e0 ELSE (p_partkey * 31 % 600) * 1e0 END AS duration,
       -2e1 + (p_partkey % 160) * 1e-1 AS lufs,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 17 % 201 - 100) / 1e2 END AS valence,
       (p_partkey * 37 % 997) * 1e-1 AS x,
       (p_partkey * 53 % 991) * 1e-1 AS y
FROM part
"""

# Vectors with a tempo and a key: one row per embedding.
TRACKS = """
SELECT vec_id AS id, embedding AS vec, label,
       CASE WHEN vec_id % 17 = 0 THEN NULL ELSE 9e1 + (vec_id * 37 % 80) END AS bpm,
       CASE WHEN vec_id % 19 = 0 THEN NULL
            ELSE CAST(vec_id % 12 + 1 AS STRING) || CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END END AS camelot,
       'song ' || CAST(vec_id % 211 AS STRING) AS song,
       (vec_id * 29 % 101) / 1e2 AS energy,
       (vec_id * 43 % 103) / 1e2 AS valence_rank,
       (vec_id * 13 % 51) / 5e1 AS danceability
FROM embeddings
"""

# Playlists: orders with their lines in a stated order.
ENTRIES = """
SELECT l_orderkey AS playlist, l_partkey AS track, l_linenumber, l_suppkey, l_shipdate, l_extendedprice FROM lineitem
"""
ENTRY_ORDER = ("l_linenumber", "track", "l_suppkey", "l_shipdate", "l_extendedprice")
POSITIONS = f"""
SELECT playlist, track, row_number() OVER (PARTITION BY playlist ORDER BY {', '.join(ENTRY_ORDER)}) - 1 AS pos
FROM ({ENTRIES}) e
"""

# Files: documents under their source and language, with repeated and similar names.
MANIFEST = """
SELECT '/root/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END || '/'
         || CASE WHEN doc_id % 40 = 7 THEN '._' ELSE '' END
         || 'Track ' || CAST(doc_id % 397 AS STRING) || CASE WHEN doc_id % 7 = 0 THEN ' (1)' ELSE '' END
         || CASE WHEN doc_id % 9 = 0 THEN '_v_' ELSE '' END || ' ' || CAST(doc_id AS STRING)
         || split_part('.mp3;.FLAC;.txt;.m4a;.xml;', ';', CAST(doc_id % 6 + 1 AS INT)) AS path,
       doc_id, source, lang, n_chars AS size, text,
       1e9 + doc_id * 6e1 AS mtime
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the texts above over the given folder, without registering names."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if f"FROM {name}" in sql}
    for name in used:
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(sql, **used)


def catalogue(spark, sf_dir):
    return view(spark, sf_dir, CATALOGUE)


def tracks(spark, sf_dir):
    return view(spark, sf_dir, TRACKS)


def entries(spark, sf_dir):
    return view(spark, sf_dir, ENTRIES)


def manifest(spark, sf_dir):
    return view(spark, sf_dir, MANIFEST)


def with_catalogue(sql: str) -> str:
    return f"WITH catalogue AS ({CATALOGUE}) {sql}"


def rank_sql(value: str, partition: str = "") -> str:
    """Tie-averaged percentile rank as a window expression."""
    part = f"PARTITION BY {partition}, " if partition else "PARTITION BY "
    over = f"OVER ({part}({value}) IS NULL"
    return (f"CASE WHEN ({value}) IS NULL THEN NULL WHEN count({value}) {over}) = 1 THEN 0.5e0 "
            f"ELSE (rank() {over} ORDER BY {value}) - 1 + (count(*) {over}, {value}) - 1) / 2e0) "
            f"/ (count({value}) {over}) - 1) END")
