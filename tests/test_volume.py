"""How much moves between tasks: shuffled records and bytes, by Spark's own count."""

from pyspark.sql import functions as F

from lectern.operators.search_index import SearchIndex
from lectern.plans import records
from lectern.sources import shared


def moved(spark, work):
    """Records and bytes that stages of ``work`` write to shuffles."""
    context = spark.sparkContext
    store, gateway = context._jsc.sc().statusStore(), context._gateway

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return [sum(getattr(stages.apply(i), m)() for i in range(stages.size())) for m in ("shuffleWriteRecords", "shuffleWriteBytes")]

    before = total()
    work()
    return [b - a for a, b in zip(before, total())]


def test_index_moves_texts_and_postings_only(spark):
    """Words of documents are no rows: before, each moved three times in an addition and twice in a merge."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i * i) % 200).cast("string"))), " ")
    docs = spark.range(2000).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("paper_id"), words.alias("full_text"))
    hits = docs.select("paper_id", F.explode(F.split("full_text", " ")).alias("w")).distinct().count()
    index = SearchIndex(spark, shared.new_folder(spark, "test-index"), buckets=4)
    assert moved(spark, lambda: index.add(docs))[0] < hits / 2
    index.add(docs.where("paper_id < '2'"))
    assert moved(spark, index.merge)[0] < hits / 2
    assert index.documents().count() == 2000


def test_saved_answers_move_numbers(spark):
    """Texts don't pass through the windows that rank them."""
    folder = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert moved(spark, lambda: records._saved_answers(spark, folder))[1] < texts / 8
