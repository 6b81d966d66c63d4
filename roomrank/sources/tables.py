"""Input tables.

Two entry points produce the same three logical tables (users, reviews, matches):

* ``load_split`` reads the reference's file layout, ``{split}_{users,reviews,matches}.csv``,
  with explicit schemas (never inferred);
* ``users_view`` / ``reviews_view`` / ``matches_view`` derive them from the driver's TPC-H-like
  parquet tables, as described in FIXTURES.md.

All views are lazy DataFrames; Catalyst prunes the columns a query does not use and pushes
filters into the parquet scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrank.operators.sequence import number_within_group

SPLITS = ("train", "val", "test")

USER_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("guest_country", T.StringType()),
    T.StructField("guest_type", T.StringType()),
    T.StructField("accommodation_id", T.LongType()),
    T.StructField("accommodation_country", T.StringType()),
    T.StructField("accommodation_type", T.StringType()),
    T.StructField("accommodation_star_rating", T.DoubleType()),
    T.StructField("accommodation_score", T.DoubleType()),
    T.StructField("room_nights", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])
REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("accommodation_id", T.LongType()),
    T.StructField("review_title", T.StringType()),
    T.StructField("review_positive", T.StringType()),
    T.StructField("review_negative", T.StringType()),
    T.StructField("review_score", T.DoubleType()),
    T.StructField("review_helpful_votes", T.IntegerType()),
])
MATCH_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("review_id", T.LongType()),
    T.StructField("accommodation_id", T.LongType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# reference file layout (A1, A2)
# ---------------------------------------------------------------------------

# Line ends inside a field, and the mark itself; fixed pairs, in the order of writing. With them a CSV
# line is a row, so a file can be read in parts by many tasks. EMPTY tells an empty text from null.
ESCAPES = (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"))
EMPTY = "%00"


def _each_text(df: DataFrame, change) -> DataFrame:
    return df.withColumns({f.name: change(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def escape_lines(df: DataFrame) -> DataFrame:
    def change(c):
        out = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), ESCAPES, c)
        return F.when(c == "", F.lit(EMPTY)).otherwise(out)
    return _each_text(df, change)


def unescape_lines(df: DataFrame) -> DataFrame:
    def change(c):
        out = reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), reversed(ESCAPES), c)
        return F.when(c == EMPTY, F.lit("")).otherwise(out)
    return _each_text(df, change)


def load_split(spark: SparkSession, data_dir: str, split: str, escaped: bool = False):
    """Read one split as (users, reviews, matches); the test split has no matches (None).

    ``escaped``: the files were written by ``write_split`` with line ends escaped, and are read in
    parts. Foreign files may have line ends inside quotes; each is read whole by one task.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    base = data_dir.rstrip("/")

    def csv(name, schema):
        df = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
              .option("multiLine", not escaped).option("escape", '"')
              .option("nanValue", "NaN").csv(f"{base}/{split}_{name}.csv"))
        return unescape_lines(df) if escaped else df

    users = csv("users", USER_SCHEMA)
    reviews = csv("reviews", REVIEW_SCHEMA)
    matches = csv("matches", MATCH_SCHEMA) if split != "test" else None
    return users, reviews, matches


def write_split(users: DataFrame, reviews: DataFrame, matches: DataFrame | None, data_dir: str, split: str,
                escaped: bool = False) -> None:
    """Write one split in the same layout (``{split}_{table}.csv``, header, doubled quotes).

    Spark writes each ``.csv`` as a folder of part files, which ``load_split`` reads the same way.
    """
    base = data_dir.rstrip("/")
    tables = [("users", users, USER_SCHEMA), ("reviews", reviews, REVIEW_SCHEMA)]
    if matches is not None:
        tables.append(("matches", matches, MATCH_SCHEMA))
    for name, df, schema in tables:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        ((escape_lines(df) if escaped else df)
         .write.mode("overwrite").option("header", True).option("escape", '"')
         # Spark's CSV writer trims white space by default; texts must keep theirs
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{base}/{split}_{name}.csv"))


# ---------------------------------------------------------------------------
# views over the driver tables (FIXTURES.md section B)
# ---------------------------------------------------------------------------

def _count_of(spark, sf_dir, name) -> Column:
    """Row count of a table as a scalar subquery (planned once, no driver round trip)."""
    return read_table(spark, sf_dir, name).select(F.count(F.lit(1))).scalar()


def split_col(user_id: Column) -> Column:
    m = user_id % 10
    return F.when(m < 8, "train").when(m == 8, "val").otherwise("test")


def users_view(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """One user (booking) per order row; ``split`` filters on ``user_id % 10``."""
    n_sup = _count_of(spark, sf_dir, "supplier")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if split is not None:
        lo_hi = {"train": (0, 7), "val": (8, 8), "test": (9, 9)}[split]
        m = F.col("o_orderkey") % 10
        orders = orders.where((m >= lo_hi[0]) & (m <= lo_hi[1]))
    orders = orders.withColumn("acc_id", (F.col("o_orderkey") * 7 + F.col("o_custkey")) % n_sup)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    g = nation.select(F.col("n_nationkey").alias("g_key"), F.col("n_name").alias("g_name"))
    a = nation.select(F.col("n_nationkey").alias("a_key"), F.col("n_name").alias("a_name"))
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    j = (orders
         .join(customer, F.col("c_custkey") == F.col("o_custkey"))
         .join(g, F.col("g_key") == F.col("c_nationkey"))
         .join(supplier, F.col("s_suppkey") == F.col("acc_id"))
         .join(a, F.col("a_key") == F.col("s_nationkey"))
         .join(part, F.col("p_partkey") == F.col("acc_id")))
    uid = F.col("o_orderkey")
    return j.select(
        uid.alias("user_id"),
        F.col("o_custkey").alias("guest_id"),
        F.when(uid % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("g_name")).alias("guest_country"),
        F.col("c_mktsegment").alias("guest_type"),
        F.col("acc_id").cast("long").alias("accommodation_id"),
        F.col("a_name").alias("accommodation_country"),
        F.col("p_type").alias("accommodation_type"),
        F.when(F.col("p_size") % 11 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("p_size") % 5 + 1).cast("double")).alias("accommodation_star_rating"),
        F.col("s_acctbal").alias("accommodation_score"),
        (uid % 14 + 1).cast("int").alias("room_nights"),
        F.month("o_orderdate").cast("int").alias("month"),
        split_col(uid).alias("split"),
    )


def reviews_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_sup = _count_of(spark, sf_dir, "supplier")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    rid = F.col("doc_id")
    # title: the first line; the rest in two halves, or whole where the other part is null (never both)
    # (step by step: what the next step uses several times is computed once per text)
    d = d.withColumn("title", F.substring_index("text", "\n", 1))
    d = d.withColumn("rest", F.substring(F.col("text"), F.length("title") + 2, F.length("text")))
    d = d.withColumn("half", F.floor(F.length("rest") / 2).cast("int"))
    rest, half = F.col("rest"), F.col("half")
    return d.select(
        rid.alias("review_id"),
        ((rid * (rid % 7 + 1)) % n_sup).cast("long").alias("accommodation_id"),
        F.col("title").alias("review_title"),
        F.when(rid % 6 == 0, F.lit(None).cast("string")).when(rid % 4 == 1, rest)
         .otherwise(F.substring(rest, F.lit(1), half)).alias("review_positive"),
        F.when(rid % 4 == 1, F.lit(None).cast("string")).when(rid % 6 == 0, rest)
         .otherwise(F.substring(rest, half + 1, F.length(rest))).alias("review_negative"),
        (F.col("n_chars") % 10 + 1).cast("double").alias("review_score"),
        (rid % 37).cast("int").alias("review_helpful_votes"),
    )


def matches_view(spark: SparkSession, sf_dir: str, splits=("train", "val", "test"),
                 users: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """One match per user: review number ``user_id % n`` of its accommodation.

    Review numbers come from the skew-safe numbering operator, so a hot accommodation
    is spread over many tasks instead of one window partition.
    """
    users = users if users is not None else users_view(spark, sf_dir)
    reviews = reviews if reviews is not None else reviews_view(spark, sf_dir)
    if splits is not None:
        users = users.where(F.col("split").isin(list(splits)))
    numbered = number_within_group(reviews.select("accommodation_id", "review_id"),
                                   ["accommodation_id"], ["review_id"], name="rn")
    sizes = reviews.groupBy("accommodation_id").agg(F.count(F.lit(1)).alias("n_rev"))
    u = (users.select("user_id", "accommodation_id", "split")
         .join(sizes, "accommodation_id")
         .withColumn("rn", F.col("user_id") % F.col("n_rev")))
    return (u.join(numbered, ["accommodation_id", "rn"])
            .select("user_id", "review_id", "accommodation_id", "split"))


# ---------------------------------------------------------------------------
# vectors (fixture stand-in for the encoder output)
# ---------------------------------------------------------------------------

def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def join_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Column, name: str) -> DataFrame:
    """``rows`` with the vector ``embeddings[number % N_vec]`` as ``name``, in the table's own element type.

    Floats stay floats while they are shuffled; cast to double where the maths begins.
    """
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias(name))
    return rows.withColumn("vec_id", number % _count_of(spark, sf_dir, "embeddings")).join(vectors, "vec_id").drop("vec_id")


def user_vectors(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    """Attach the fixture user vector ``embeddings[(user_id * 7 + 3) % N_vec]``."""
    n_vec = _count_of(spark, sf_dir, "embeddings")
    u = users.withColumn("vec_id", (F.col("user_id") * 7 + 3) % n_vec)
    return u.join(vector_table(spark, sf_dir), "vec_id").drop("vec_id")


def review_vectors(spark: SparkSession, sf_dir: str, reviews: DataFrame) -> DataFrame:
    """Attach the fixture review vector ``embeddings[review_id % N_vec]``."""
    n_vec = _count_of(spark, sf_dir, "embeddings")
    r = reviews.withColumn("vec_id", F.col("review_id") % n_vec)
    return r.join(vector_table(spark, sf_dir), "vec_id").drop("vec_id")
