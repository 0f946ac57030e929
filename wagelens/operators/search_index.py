"""Search over written token tables (H02, H03 and H05 together).

``write_index`` analyses the texts once and writes four tables:

* ``rows`` (row, key, dl, a list of terms a field): the analysed rows, numbered;
* ``postings`` (bucket, term, row, tf, dl): how often a term stands in a row,
  with the row's length in tokens, partitioned by a hash of the term;
* ``terms`` (bucket, term, df): rows that hold the term;
* ``near`` (bucket, signature, field, token): segments of every token, for
  fuzzy matching;

and ``totals``, one row of the number of rows and of tokens.  A query reads
the partitions of its own terms and no text.  A term carries its analyzer
(``standard:blue``, ``title:engineer``), so a query text is analysed both ways
and each form meets the fields that were analysed like it.

Postings are counted in their row and written where they are counted, so none
is shuffled; a row's number stands for its key, which may be long.  Only
rows whose key is repeated meet in a shuffle: those of one length count as one.

Fuzzy matching cuts every token into k + 1 segments, k being the AUTO distance.
A token within k edits of a term holds one of its segments unchanged, moved by
at most k places.  So the segments that a term's own parts can equal are listed
(some dozen a term, whatever the vocabulary) and met by equality; edit distance
runs on what meets.  Null texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import round4
from ..session import computed, reuse
from .search import BM25_B, BM25_K1, auto_fuzziness, title_tokens, tokenize, with_tokens

ANALYZERS = {"standard": tokenize, "title": title_tokens}
#: fields of the pay table that are searched, and their analyzers
PAY_FIELDS = {"employer": "standard", "job_title": "title", "location": "standard"}
#: hash partitions of the token tables; more for a larger table, since a query reads whole partitions' footers
BUCKETS = 16
#: edits that AUTO allows at most
MOST_EDITS = 2
def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def field_terms(field: str, analyzer: str) -> Column:
    """Terms of a field: its tokens with the analyzer's name."""
    return F.transform(F.coalesce(ANALYZERS[analyzer](field), F.array().cast("array<string>")), lambda t: F.concat(F.lit(analyzer + ":"), t))


def analysed(spark: SparkSession, text: str, analyzer: str) -> list[str]:
    """Tokens of a query text, by the analyzer's own expression."""
    return spark.sql("SELECT :q AS q", {"q": text}).select(ANALYZERS[analyzer]("q").alias("t")).first()["t"] or []


def segments(token: str, edits: int) -> list[tuple[int, int, str]]:
    """(number, start, text) of ``edits + 1`` segments, the later ones longer by one letter where they differ."""
    parts, n = edits + 1, len(token)
    sizes = [n // parts + (i >= parts - n % parts) for i in range(parts)]
    return [(i, sum(sizes[:i]), token[sum(sizes[:i]):sum(sizes[:i + 1])]) for i in range(parts)]


def segment_signatures(token: Column) -> Column:
    """``edits:length:number:segment`` of a token, for each distance that a term of nearly its length may have."""
    n, out = F.length(token), []
    for edits in range(MOST_EDITS + 1):
        parts = edits + 1
        short = F.floor(n / parts).cast("int")
        for i in range(parts):
            size = short + F.when(F.lit(i) >= parts - n % parts, 1).otherwise(0)
            start = short * i + F.greatest(F.lit(0), F.lit(i) - (parts - n % parts))
            out.append(F.when(n >= parts, F.concat_ws(":", F.lit(edits), n, F.lit(i), F.substring(token, start + 1, size))))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def term_signatures(term: str) -> list[str]:
    """The signatures that tokens within AUTO distance of a term can have.

    AUTO allows fewer edits than would leave a token too short for its segments.
    """
    edits = auto_fuzziness(term)
    found = set()
    for n in range(max(edits + 1, len(term) - edits), len(term) + edits + 1):
        for i, start, text in segments("x" * n, edits):
            for at in range(max(0, start - edits), min(len(term) - len(text), start + edits) + 1):
                found.add(f"{edits}:{n}:{i}:{term[at:at + len(text)]}")
    return sorted(found)


# ---------------------------------------------------------------------------
# writing
# ---------------------------------------------------------------------------

@contextmanager
def many_writers(spark: SparkSession, files: int):
    """Let a task keep so many files open, so that Spark does not sort the rows by their folder before it writes them."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(files))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_terms(docs: DataFrame) -> DataFrame:
    """(row, key, dl, term, tf) of (row, key, dl, terms), counted within each row: equal terms stand together once they are sorted."""
    ordered = docs.where("dl > 0").select("row", "key", "dl", F.sort_array("terms").alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    found = computed(ordered, first.alias("first"), keep=("row", "key", "dl", "s"))
    pairs = F.transform("first", lambda i, j: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("first", j + 1), F.size("s")) - i).cast("long").alias("tf")))
    return found.select("row", "key", "dl", F.inline(pairs))


def row_postings(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(term, row, tf, dl); rows whose key's hash is among the ``repeated`` ones (_h) are one row where key and length are equal."""
    if repeated is None:
        return row_terms(docs).select("term", "row", "tf", "dl")
    docs = docs.withColumn("_h", F.xxhash64("key"))
    alone = row_terms(docs.join(repeated, "_h", "left_anti"))
    met = (row_terms(docs.join(repeated, "_h", "left_semi")).groupBy("key", "dl", "term")
           .agg(F.sum("tf").alias("tf"), F.min("row").alias("row")))
    return alone.select("term", "row", "tf", "dl").unionByName(met.select("term", "row", "tf", "dl"))


def write_index(df: DataFrame, path: str, key: str = "id", fields: Mapping[str, str] = PAY_FIELDS,
                buckets: int = BUCKETS) -> None:
    """Write the token tables of ``fields`` (name: analyzer) under ``path``; ``totals`` comes last and marks them whole."""
    spark = df.sparkSession
    # analysed once: the other tables read these lists
    all_terms = F.concat(*[f"f{i}" for i in range(len(fields))])
    (df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), *[field_terms(f, a).alias(f"f{i}") for i, (f, a) in enumerate(fields.items())])
     .withColumn("dl", F.size(all_terms)).write.mode("overwrite").parquet(f"{path}/rows"))
    lists = spark.read.parquet(f"{path}/rows")
    docs = lists.select("row", "key", "dl", all_terms.alias("terms"))
    repeated = reuse(lists.groupBy(F.xxhash64("key").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
    merge = not repeated.isEmpty()
    counts = row_postings(docs, repeated if merge else None)
    with many_writers(spark, buckets):
        (counts.withColumn("bucket", _bucket(F.col("term"), buckets))
         .write.mode("overwrite").option("parquet.block.size", max(1 << 20, (1 << 28) // buckets)).partitionBy("bucket").parquet(f"{path}/postings"))
    postings = spark.read.parquet(f"{path}/postings")
    (postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms"))
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("terms")) for i, f in enumerate(fields)])
    tokens = (lists.select(F.inline(tagged)).select("field", F.explode("terms").alias("term")).distinct()
              .select("field", F.substring_index("term", ":", -1).alias("token")))
    near = tokens.select("field", "token", F.explode(segment_signatures(F.col("token"))).alias("signature"))
    (near.withColumn("bucket", _bucket(F.col("signature"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "signature")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/near"))
    (docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dl").cast("long")).alias("tokens"), F.lit(buckets).alias("buckets"), F.lit(merge).alias("repeated"))
     .write.mode("overwrite").parquet(path + "/totals"))


def read_terms(spark: SparkSession, path: str, name: str, column: str, values: Sequence[str]) -> DataFrame:
    """The rows of some terms or signatures of a token table, from their partitions only."""
    if not values:
        return spark.read.parquet(f"{path}/{name}").where(F.lit(False))
    buckets = spark.read.parquet(f"{path}/totals").first()["buckets"]
    wanted = spark.createDataFrame([(v,) for v in values], "v string").select(_bucket(F.col("v"), buckets).alias("b")).distinct()
    return (spark.read.parquet(f"{path}/{name}")
            .where(F.col("bucket").isin(sorted(r["b"] for r in wanted.collect())) & F.col(column).isin(list(values))))


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def search(spark: SparkSession, path: str, query: str, limit: int = 20, key: str = "id",
           allowed: DataFrame | None = None, analyzers: Sequence[str] = ("standard", "title"),
           k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Top ``limit`` rows (key, score) by BM25 over the token tables, ties by key.

    ``allowed`` (key) restricts the rows found; statistics are those of the
    whole table, as in a search index.
    """
    terms = sorted({f"{a}:{t}" for a in analyzers for t in analysed(spark, query, a)})
    hits = read_terms(spark, path, "postings", "term", terms)
    rows = spark.read.parquet(f"{path}/rows").select("row", "key")
    if allowed is not None:
        rows = rows.join(allowed.select(F.col(key).alias("key")), "key", "left_semi")
    # one row a query term
    df = {r["term"]: r["df"] for r in read_terms(spark, path, "terms", "term", terms).collect()}
    totals = spark.read.parquet(f"{path}/totals").first()
    n, average = totals["n"], (totals["tokens"] or 0) / max(1, totals["n"])
    weight = F.lit(0.0)
    for t, held in df.items():
        weight = F.when(F.col("term") == t, F.log(F.lit(1.0) + (F.lit(float(n)) - held + 0.5) / (F.lit(float(held)) + 0.5))).otherwise(weight)
    tf = F.col("tf").cast("double")
    score = weight * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(average or 1.0)))
    found = hits.groupBy("row").agg(F.sum(score).alias("score")).join(rows, "row").select(F.col("key").alias(key), "score")
    if totals["repeated"]:
        found = found.groupBy(key).agg(F.sum("score").alias("score"))
    return found.select(key, round4(F.col("score")).alias("score")).orderBy(F.col("score").desc(), F.col(key).asc()).limit(limit)


def near_tokens(near: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(token) within AUTO distance of a term, from (signature, token) rows that may hold any signature."""
    close = F.lit(False)
    for t in terms:
        close |= F.levenshtein(F.col("token"), F.lit(t), auto_fuzziness(t)) >= 0
    return near.where(close).select("token").distinct()


def fuzzy_tokens(spark: SparkSession, path: str, field: str, terms: Sequence[str]) -> DataFrame:
    """(token) of a field within AUTO distance of any term."""
    wanted = sorted({s for t in terms for s in term_signatures(t)})
    found = read_terms(spark, path, "near", "signature", wanted)
    return near_tokens(found.where(F.col("field") == field), terms)


def fuzzy_match_fields(df: DataFrame, path: str, texts: Mapping[str, str], fields: Mapping[str, str] = PAY_FIELDS) -> DataFrame:
    """Rows whose every named field has a token close to any token of that field's text.

    Both sides go through the field's analyzer; the matched tokens filter the rows (``with_tokens``).
    """
    spark = df.sparkSession
    for field, text in texts.items():
        analyzer = fields[field]
        terms = sorted(set(analysed(spark, text, analyzer)))
        if not terms:
            return df.where(F.lit(False))
        df = with_tokens(df, ANALYZERS[analyzer](field), fuzzy_tokens(spark, path, field, terms))
    return df
