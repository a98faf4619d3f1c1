"""Ranked search: BM25, dense, hybrid and substring scorers, all with a unique last sort key."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.functions.stem import stem
from lodestrata.runtime import parallelism, shared_path, stage

_ALNUM = re.compile(r"[^\W_]+")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl, lead): term frequencies with the document's length; ``lead`` marks one row of every document.

    Texts are counted one by one, so nothing is shuffled.  Null texts have no terms.
    """
    word = re.compile(T.TOKEN)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                batch = whole.slice(s, 512)
                at, terms, tf, dl, lead = [], [], [], [], []
                for k, t in enumerate(batch.column(1)):
                    words = word.findall(t.as_py().lower())
                    counts = Counter(words)
                    at += [k] * len(counts)
                    terms += counts
                    tf += counts.values()
                    dl += [len(words)] * len(counts)
                    lead += [True] + [False] * (len(counts) - 1) if counts else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int32()), pa.array(lead, pa.bool_())], [key, "term", "tf", "dl", "lead"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, term string, tf bigint, dl int, lead boolean")


def build_index(docs: DataFrame, key: str, text: str, at: str, buckets: int = 32) -> None:
    """Write the postings of a table under ``at``, in buckets of terms and sorted by term within, and one row of statistics.

    A query reads the buckets of its terms, and of their files the row groups that may hold them.  The postings of a bucket
    are spread over several tasks by their documents, so a term of every document is in none alone.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    p = postings(docs, key, text).withColumns({"bucket": bucket, "_part": F.pmod(F.xxhash64(key), F.lit(max(1, n // 16)))})
    p.repartition(n, "bucket", "_part").drop("_part").sortWithinPartitions("bucket", "term", key).write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{at}/postings")
    lengths = spark.read.schema(p.drop("_part").schema).parquet(f"{at}/postings").where("lead").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    lengths.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{at}/statistics")


_indexes: dict[tuple, str] = {}


def index_of(docs: DataFrame, key: str, text: str) -> str:
    """Where the index of a table read from files stands in the shared folder; made once a session and state of the files."""
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append((name, status.getLen(), status.getModificationTime()))
    mark = (spark.sparkContext.applicationId, docs.semanticHash(), key, text, *state)
    if mark not in _indexes or not state:
        at = shared_path(spark, "index")
        build_index(docs, key, text, at)
        _indexes[mark] = at
    return _indexes[mark]


def read_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl, bucket) off the index of a table."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.sparkSession.read.schema(f"{key} {kind}, term string, tf bigint, dl int, bucket int").parquet(index_of(docs, key, text) + "/postings")


def bm25(docs: DataFrame, key: str, text: str, query: Sequence[str], k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents of a query: (key, score); a term asked for twice weighs twice; ties go to the smaller key.

    Read off the index of the table, which is made if there is none of its present state.  Null and empty texts and an
    empty query give no rows.
    """
    spark, at = docs.sparkSession, index_of(docs, key, text)
    asked = Counter(w.lower() for w in query)
    stats = spark.read.parquet(f"{at}/statistics").first()
    n, avgdl, buckets = stats["n"], stats["avgdl"], stats["buckets"]
    where = {r[0] for r in spark.createDataFrame([(t,) for t in asked], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).collect()}
    p = read_postings(docs, key, text).where(F.col("bucket").isin(list(where)) & F.col("term").isin(list(asked))).select(key, "term", "tf", "dl")
    df = {r[0]: r[1] for r in p.groupBy("term").agg(F.count(F.lit(1))).collect()}
    weight: Column = F.lit(0.0)
    for t, w in asked.items():
        if t in df:
            weight = F.when(F.col("term") == t, F.lit(w * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1))).otherwise(weight)
    f = F.col("tf").cast("double")
    part = weight * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    return p.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)



def knn(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10, least: float = 0.0) -> DataFrame:
    """Exact cosine search: the ``k`` best first, then those under ``least`` dropped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, F.round(V.cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.where(F.col("score") >= least)


def hybrid(docs: DataFrame, key: str, text: str, vector: str, query: Sequence[str], qvec: Sequence[float], k: int = 8, alpha: float = 0.7) -> DataFrame:
    """Of the 4k best by cosine the k best by alpha * cosine + (1 - alpha) * share of query words found."""
    q = F.array(*[F.lit(float(x)) for x in qvec])
    dense = docs.select(key, text, V.cosine(F.col(vector), q).alias("dense")).orderBy(F.desc(F.round("dense", 9)), key).limit(4 * k)
    score = F.round(alpha * F.col("dense") + (1 - alpha) * T.overlap(F.coalesce(F.col(text), F.lit("")), query), 4)
    return dense.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def substring_rank(docs: DataFrame, key: str, text: str, query: Sequence[str], k: int = 10) -> DataFrame:
    """Rank by the number of non-overlapping occurrences of the query's words; confidence none, low, medium or high."""
    total: Column = F.lit(0).cast("bigint")
    for w in query:
        total = total + F.coalesce(T.occurrences(F.col(text), w), F.lit(0))
    ranked = docs.select(key, total.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key).limit(k)
    return ranked.withColumn("confidence", F.when(F.col("hits") >= 5, "high").when(F.col("hits") >= 3, "medium").otherwise("low"))


def all_words(docs: DataFrame, key: str, text: str, query: Sequence[str]) -> DataFrame:
    """Documents that hold every word of the query, without rank."""
    need = F.array(*map(F.lit, sorted(set(query))))
    return docs.where(F.size(F.array_except(need, T.tokens(F.col(text)))) == 0).select(key)


def phrase_prefix(docs: DataFrame, key: str, text: str, phrase: Sequence[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents that hold the words of a phrase in a row, the last as the start of a word: (key, hits, score).

    Words are compared by their stems (the last word is compared as it is, and as a stem), the phrase counts as one term of
    BM25, and scores are negative, the least being the best.  Null texts hold nothing; an empty phrase gives no rows.
    """
    want = [w.lower() for w in phrase]
    stems = [stem(w) for w in want]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, size = [], []
            for t in batch.column(1):
                words = _ALNUM.findall(t.as_py().lower())
                size.append(len(words))
                n = 0
                if want:
                    got = [stem(w) for w in words]
                    last = len(want) - 1
                    n = sum(got[i : i + last] == stems[:-1] and (words[i + last].startswith(want[-1]) or got[i + last].startswith(stems[-1])) for i in range(len(words) - last))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64()), pa.array(size, pa.int64())], [key, "hits", "dl"])

    # A few numbers a document: statistics and scores both read them.
    seen = stage(docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, hits bigint, dl bigint"), "phrase")
    stats = seen.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.count_if(F.col("hits") > 0).alias("df"))
    f = F.col("hits").cast("double")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return seen.where("hits > 0").join(F.broadcast(stats)).select(key, "hits", F.round(score, 6).alias("score")).orderBy("score", key).limit(k)


def quotes(docs: DataFrame, key: str, text: str, query: Sequence[str], k: int = 5, most: int = 500) -> DataFrame:
    """Best paragraphs over all documents by the share of query words found: (key, part, score, quote)."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("part", "p")).where(F.trim("p") != "")
    found = sum((F.when(F.contains(F.lower("p"), F.lit(w)), 1).otherwise(0) for w in query), F.lit(0))
    scored = parts.select(key, F.col("part").cast("bigint"), F.round(found / F.lit(float(len(query))), 6).alias("score"), F.substring("p", 1, most).alias("quote")).where("score > 0")
    return scored.orderBy(F.desc("score"), key, "part").limit(k)


def fused(parts: Sequence[tuple[DataFrame, float]], key: str, k: int = 10) -> DataFrame:
    """Candidates of several rankings (key, score), weighted, at the best score of each key."""
    every = None
    for df, weight in parts:
        one = df.select(key, (F.col("score") * weight).alias("score"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group; ranks above k are dropped before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
