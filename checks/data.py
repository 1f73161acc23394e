"""What the registered queries share: tables, derived inputs, and built indexes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.functions.text import tokenize
from kinspot.functions.vectors import as_vector
from kinspot.operators.dense import build_dense_index, dense_topk
from kinspot.operators.fusion import rrf_topk
from kinspot.operators.judge import pair_containment
from kinspot.operators.replay import replay, validate
from kinspot.operators.segments import SegmentedIndex, add_documents
from kinspot.plans.continuing import LogRun, run_log, start_table
from kinspot.plans.detectors import dense_hits, sparse_hits
from kinspot.plans.indexing import CorpusIndex, build_indexes
from kinspot.session import new_path, written

# Source text of one module per part; <k> is its key and <n> its size.
FUNCTION = """def make_<k>(size, price):
    total = size * <n>
    for i in range(size):
        total = total + i * price
    return total + <k>
"""
METHOD = """    def area_<k>(self, a, b):
        side = a * b
        if side > <n>:
            side = side - b
        return side + a * b - <n> + len(str(side))
"""
SMALL = """def tiny_<k>(x):
    return x
"""
HIDDEN = """def _hidden_<k>(size, price):
    total = size * <n>
    for i in range(size):
        total = total + i * price
    return total + <k>
"""
LATER = """async def later_<k>(size, price):
    total = size * <n>
    for i in range(size):
        total = total + i * price
    return total + <k>
"""
MODULE = FUNCTION + SMALL + HIDDEN + LATER + "class Box_<k>:\n" + METHOD


def fill(template: str, key: Column, size: Column) -> Column:
    out = F.replace(F.lit(template), F.lit("<k>"), key.cast("string"))
    return F.replace(out, F.lit("<n>"), size.cast("string"))


class TestData:
    """Tables of one folder; everything derived is made once, on first use."""

    __test__ = False
    K = 10
    #: parts whose modules one task makes and parses, about
    TASK_PARTS = 5_000
    #: events whose commands one task makes and reads as JSON, about
    TASK_EVENTS = 50_000

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- text -------------------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").repartition("doc_id")  # one small file here

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def index(self) -> CorpusIndex:
        return build_indexes(self.documents)

    @cached_property
    def segments(self) -> SegmentedIndex:
        return add_documents(self.documents, new_path(self.spark, "segments"))

    @cached_property
    def dense(self) -> DataFrame:
        return dense_hits(self.index, self.queries, 2 * self.K)

    @cached_property
    def sparse(self) -> DataFrame:
        return sparse_hits(self.index, self.queries, 2 * self.K)

    @cached_property
    def hybrid(self) -> DataFrame:
        return written(rrf_topk(self.dense, self.sparse, 5), "hybrid")

    @cached_property
    def dense_judged(self) -> DataFrame:
        hits = self.dense.where(F.col("rank") <= self.K).select("query_id", "doc_id", "rank")
        return written(pair_containment(self.queries, hits, self.index.sparse.postings), "dense_judged")

    @cached_property
    def cases(self) -> DataFrame:
        """Benchmark items; true where some document has the item's tokens in a row.

        A document with all tokens in a row has the item's rarest token, so only
        the postings of that token have to be read.
        """
        rarest = (
            self.queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
            .join(self.index.sparse.term_stats, "term", "left")
            .groupBy("query_id")
            .agg(F.min_by(F.struct("term"), F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rare"))
            .select("query_id", "rare.term")
        )
        pairs = written(
            rarest.join(self.index.sparse.postings.select("term", "doc_id"), "term").select("query_id", "doc_id"),
            "case_pairs",
        )
        line = F.concat(F.lit(" "), F.array_join(tokenize("text"), " "), F.lit(" "))
        # tokens hold no spaces, so whole tokens are compared
        needles = self.queries.select("query_id", line.alias("needle"))
        holding = (
            pairs.join(self.documents.select("doc_id", "text"), "doc_id")
            .join(needles, "query_id")
            .where(F.contains(line, F.col("needle")))
            .select("query_id")
            .distinct()
            .withColumn("hit", F.lit(1))
        )
        return written(
            self.queries.select("query_id")
            .join(holding, "query_id", "left")
            .select(F.col("query_id").alias("case_id"), F.coalesce("hit", F.lit(0)).alias("y_true")),
            "cases",
        )

    @cached_property
    def parts(self) -> DataFrame:
        """Parts in tasks by their number: the rows are few bytes, but the modules made of them are not."""
        part = self.table("part")
        return part.repartition(max(1, -(-part.count() // self.TASK_PARTS)), "p_partkey")

    @cached_property
    def modules(self) -> DataFrame:
        """One source file text per part."""
        return self.parts.select(
            F.concat(F.lit("src/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"),
            "p_partkey",
            fill(MODULE, F.col("p_partkey"), F.col("p_size")).alias("content"),
        )

    # --- vectors ----------------------------------------------------------

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def vectors(self) -> DataFrame:
        return build_dense_index(self.embeddings, "vec_id")

    @cached_property
    def neighbours(self) -> DataFrame:
        """Nearest other vectors of every vector."""
        items = self.vectors.withColumnRenamed("doc_id", "query_id")
        return written(dense_topk(self.vectors, items, self.K, exclude_self=True), "neighbours")

    # --- predictions ------------------------------------------------------

    @cached_property
    def label_predictions(self) -> DataFrame:
        """Labels as predictions: one method per language."""
        return (
            self.table("labels")
            .join(self.documents.select("doc_id", "lang"), "doc_id")
            .select(
                F.col("lang").alias("method"),
                F.col("doc_id").alias("case_id"),
                F.col("quality").alias("y_true"),
                (1 - F.col("toxic")).alias("y_pred"),
            )
        )

    # --- keyed table ------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        """Events in tasks by their number: a file gives a task a million of them, and reading commands is dear."""
        events = self.table("events")
        return events.repartition(max(1, -(-events.count() // self.TASK_EVENTS)), "event_id")

    @cached_property
    def log(self) -> DataFrame:
        """Command log made of the events; some commands are broken on purpose."""
        k = F.get_json_object("props", "$.k").cast("int")
        name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
        role = F.element_at(F.array(*[F.lit(r) for r in ("eng", "ops", "hr", "sales")]), k % 4 + 1)
        salary = F.round(F.col("value") * 100).cast("bigint").cast("string")

        def obj(*parts: Column | str) -> Column:
            return F.concat(F.lit("{"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}"))

        add = obj('"name": "', name, '", "role": "', role, '", "salary": ', salary)
        arguments = {
            "signup": F.when(k == 17, obj('"name": "', name, '", "role": "', role, '"'))
            .when(k == 23, F.lit('{"name": '))
            .when(k == 29, obj('"name": "', name, '", "role": "', role, '", "salary": "much"'))
            .otherwise(add),
            "error": F.when(k == 19, obj('"name": "', name, '", "force": true')).otherwise(obj('"name": "', name, '"')),
            "purchase": obj('"name": "', name, '", "salary": ', salary),
            "view": obj('"name": "', name, '"'),
            "click": F.when(k % 2 == 0, F.lit("{}")).when(k == 21, F.lit('{"role": ""}')).otherwise(obj('"role": "', role, '"')),
        }
        tools = {
            "signup": "add_employee", "error": "delete_employee", "purchase": "update_employee_salary",
            "view": "get_employee_salary", "click": "get_employees",
        }
        tool, args = F, F
        for event, name_ in tools.items():
            tool = tool.when(F.col("event_type") == event, F.when(k == 13, F.lit("drop_table")).otherwise(F.lit(name_)))
            args = args.when(F.col("event_type") == event, arguments[event])
        return self.events.select(F.col("event_id").alias("seq"), tool.alias("tool"), args.alias("arguments"))

    @cached_property
    def hard_log(self) -> DataFrame:
        """A log of the commands that are easily lost or misread, by event id."""
        kind, n = F.col("event_id") % 10, F.col("event_id").cast("string")
        name = F.concat(F.lit('"name": "u'), F.col("user_id").cast("string"), F.lit('"'))
        add = lambda salary: F.concat(F.lit("{"), name, F.lit(', "role": "eng", "salary": '), salary, F.lit("}"))
        tool = F.when(kind == 0, F.lit(None)).when(kind.isin(3, 9), F.lit("get_employee_salary")).otherwise(F.lit("add_employee"))
        arguments = (
            F.when(kind == 1, add(F.concat(F.lit('"'), n, F.lit('"'))))
            .when(kind == 2, F.lit('{"name": {"x": 1}, "role": "eng", "salary": 1}'))
            .when(kind == 3, F.concat(F.lit("{"), name, F.lit("} trailing")))
            .when(kind == 4, add(F.concat(F.lit("1"), F.lpad(n, 18, "0"))))
            .when(kind == 5, add(F.lit("100000000000000000000")))
            .when(kind == 6, add(n))
            .when(kind == 7, F.lit(None))
            .when(kind == 8, F.lit("[1]"))
            .otherwise(F.concat(F.lit("{"), name, F.lit("}")))
        )
        return self.events.select(F.col("event_id").alias("seq"), tool.alias("tool"), arguments.alias("arguments"))

    @cached_property
    def base(self) -> DataFrame:
        return self.table("supplier").select(
            (F.col("s_suppkey") + 1).alias("id"),
            F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("name"),
            F.lit("ops").alias("role"),
            F.round(F.col("s_acctbal") * 100).cast("bigint").alias("salary"),
        )

    @cached_property
    def commands(self) -> DataFrame:
        return written(validate(self.log), "commands")

    @cached_property
    def replayed(self) -> DataFrame:
        return written(replay(self.commands, self.base), "replayed")

    @cached_property
    def two_runs(self) -> tuple[LogRun, LogRun]:
        """The log in two halves, the second from the state that the first left."""
        path = new_path(self.spark, "staff_table")
        start_table(self.base, path)
        half = self.table("events").agg((F.max("event_id") / 2).cast("bigint")).first()[0]
        return run_log(self.log.where(F.col("seq") <= half), path), run_log(self.log.where(F.col("seq") > half), path)

    @cached_property
    def staff(self) -> DataFrame:
        """Customers as the keyed table of the batch operators."""
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("role"),
            F.round(F.col("c_acctbal") * 100).cast("bigint").alias("salary"),
        )

    def requests(self, event_type: str) -> DataFrame:
        """Batch requests by events; keys reach beyond the table, so some miss."""
        return (
            self.table("events")
            .where(F.col("event_type") == event_type)
            .select(
                F.col("event_id").alias("seq"),
                F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 25).cast("string"), 9, "0")).alias("name"),
                F.lit("NEW").alias("role"),
                F.round(F.col("value") * 100).cast("bigint").alias("salary"),
            )
        )

    @property
    def unit_embeddings(self) -> DataFrame:
        return self.embeddings.select("vec_id", as_vector("embedding").alias("v"))


_made: dict[tuple[str, str], TestData] = {}


def test_data(spark: SparkSession, sf_dir: str) -> TestData:
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
    if key not in _made:
        _made[key] = TestData(spark, sf_dir)
    return _made[key]


test_data.__test__ = False
