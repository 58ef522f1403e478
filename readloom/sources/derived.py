"""Alignments derived from the orders table by portable expressions, the same for Spark and for the checking database.

One fragment for each order. Orders whose key leaves small remainders by 97 are bent: an unmapped mate, an improper pair,
supplementary and secondary rows, single-end reads, mates on one strand, a third alignment of a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 1_000_000
NAMES = ("chr0", "chr1", "chr2")

FRAGMENTS = """frag AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS hot,
   CAST(floor(o_orderkey/3.0) AS BIGINT) AS ci, CAST(floor(o_orderkey/6.0) AS BIGINT) AS g, CAST(floor(o_orderkey/20.0) AS BIGINT) AS m,
   CAST(o_custkey % 61 AS INT) AS mq, CAST(floor(o_totalprice) AS BIGINT) % 4000 AS bq FROM {orders}),
placed AS (SELECT k, m, mq, bq, hot, CASE WHEN hot=1 THEN k % 5 % 3 WHEN g % 4 = 0 THEN g % 3 ELSE ci % 3 END AS refid,
   CASE WHEN hot=1 THEN (CASE WHEN k % 2 = 0 THEN 10000 ELSE 950000 END) + (k % 20)*2000 + (CASE WHEN k % 20 < 4 THEN m % 12 WHEN k % 20 < 16 THEN m % 30 ELSE (m*m) % 401 END)
        WHEN g % 4 = 0 THEN 100000 + (g*4567) % 700000 ELSE 100000 + (ci*9173) % 800000 END AS s,
   CASE WHEN hot=1 THEN 200 + CAST(floor(k/100.0) AS BIGINT) % 7 WHEN g % 4 = 0 THEN 150 + g % 40 ELSE 150 + ci % 40 END AS fl FROM frag),
ends AS (SELECT k, CAST(refid AS INT) AS refid, CAST(s AS INT) AS p0, CAST(s+fl-1 AS INT) AS p1, mq, bq, {bend} AS c FROM placed)"""

#: (condition, name, number within the fragment, position, 5' end, mapq, flag, length, base qualities)
_ROWS = (
    ("c <> 4", "'r'", 0, "p0", "p0", "mq", "CASE c WHEN 0 THEN 71 WHEN 1 THEN 65 ELSE 67 END", "p1 - p0 + 1", "bq"),
    ("c <> 4", "'r'", 1, "p1 - 49", "p1", "0", "CASE c WHEN 1 THEN 145 WHEN 5 THEN 131 ELSE 147 END", "p0 - p1 - 1", "0"),
    ("c = 2", "'r'", 2, "p0", "p0", "mq", "2115", "0", "bq"),
    ("c = 3", "'r'", 3, "p0", "p0", "mq", "323", "0", "bq"),
    ("c = 6", "'r'", 4, "p0 + 7", "p0 + 7", "mq", "67", "p1 - p0 - 6", "bq"),
    ("c = 4", "'s'", 5, "p0", "p0", "mq", "0", "0", "bq"),
    ("c >= 0 AND k % 3 = 1", "'t'", 6, "p0", "p0", "mq", "CASE WHEN k % 2 = 1 THEN 16 ELSE 0 END", "0", "bq"),
)
CIGARS = ("50M", "5S45M", "45M5S", "20M100N30M", "20M2D28M3I", "5H10S35M", "10M3000N40M", "25=1X24=")
LENGTHS = (50, 50, 50, 50, 51, 45, 50, 50)


def _of_k(values: tuple) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN {x!r}" for i, x in enumerate(values)) + " END"


def alignments_sql(orders: str, plain: bool = False) -> str:
    """CTEs that end with `al`, without the leading WITH. plain: pairs alone."""
    bend = "CAST(-1 AS BIGINT)" if plain else "k % 97"
    cigar, l_seq = _of_k(CIGARS), _of_k(LENGTHS)
    rows = " UNION ALL ".join(
        f"SELECT k * 8 + {j} AS ordinal, refid, concat({name}, k) AS read_name, CAST({pos} AS INT) AS pos, CAST({p5} AS INT) AS pos5p, CAST({mapq} AS INT) AS mapq, CAST({flag} AS INT) AS flag, CAST({tlen} AS INT) AS tlen, CAST({basq} AS BIGINT) AS sbasq, {cigar} AS cigar, {l_seq} AS l_seq FROM ends WHERE {when}"
        for when, name, j, pos, p5, mapq, flag, tlen, basq in _ROWS
    )
    return f"{FRAGMENTS.format(orders=orders, bend=bend)}, al AS ({rows})"


#: Parquet bytes of orders that make one part; about 150,000 alignments.
PART_BYTES = 1 << 20


def parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts alignments are worked on: as many as the orders have bytes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/orders.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(1, -(-size // PART_BYTES))


#: Into so many parts Spark's tasks write straight to files (spark.shuffle.sort.bypassMergeThreshold); for more they hold what they read in memory.
STRAIGHT = 200


def _ends(spark: SparkSession, sf_dir: str, bend: str) -> DataFrame:
    """`ends` of alignments_sql() in parts: splits of files grow with the table, up to 128 MB, and hold whole row groups, and what is derived from a
    split is many times as large. More parts than go straight to files are dealt in two steps, so that no task holds a split."""
    orders, n = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), parts(spark, sf_dir)
    orders = orders.repartition(min(n, STRAIGHT), "o_orderkey") if n > 1 else orders
    ends = spark.sql(f"WITH {FRAGMENTS.format(orders='{orders}', bend=bend)} SELECT * FROM ends", orders=orders)
    return ends.repartition(n, "k") if n > STRAIGHT else ends


def alignments(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """`al` of alignments_sql(). Its rows are made of one scan, where the branches of the SQL's union would scan the orders for each."""
    ends = _ends(spark, sf_dir, "CAST(-1 AS BIGINT)" if plain else "k % 97")
    one = "CASE WHEN {when} THEN struct(CAST({j} AS BIGINT) AS j, {name} AS name, CAST({pos} AS INT) AS pos, CAST({p5} AS INT) AS pos5p, CAST({mapq} AS INT) AS mapq, CAST({flag} AS INT) AS flag, CAST({tlen} AS INT) AS tlen, CAST({basq} AS BIGINT) AS sbasq) END"
    rows = ", ".join(one.format(when=when, j=j, name=name, pos=pos, p5=p5, mapq=mapq, flag=flag, tlen=tlen, basq=basq) for when, name, j, pos, p5, mapq, flag, tlen, basq in _ROWS)
    own = ends.select("k", "refid", F.explode(F.expr(f"array({rows})")).alias("a")).filter("a IS NOT NULL")
    return own.selectExpr("k * 8 + a.j AS ordinal", "refid", "concat(a.name, k) AS read_name", "a.pos", "a.pos5p", "a.mapq", "a.flag", "a.tlen", "a.sbasq", f"{_of_k(CIGARS)} AS cigar", f"{_of_k(LENGTHS)} AS l_seq")


def references(spark: SparkSession) -> DataFrame:
    from ..model import reference_table

    return reference_table(spark, {n: LENGTH for n in NAMES})
