import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import TEXTS, odd_docs

from gridspark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.QUERY(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in labels)
    assert right >= 0.9 * len(labels)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    from gridspark.llm.common import held_out

    other = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, other)
    assert a.good == b.good and a.bad == b.bad and (a.curve is b.curve or (a.curve == b.curve).all())


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark, TEXTS)
    model = Q.train(docs, labels)
    got = Q.score(docs, model, "score_").collect()
    assert len(got) == len(TEXTS) and {r.score_ for r in got} == {0.5} and Q.score(docs, model, "score_").columns[:-1] == docs.columns
    model = Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = Q.score(docs, model, "score_").collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score_ <= 1 for r in got)
    assert len({r.score_ for r in got if r.doc_id in (0, 1)}) == 1
    assert Q.score(odd_docs(spark, []), model, "score_").count() == 0
    assert Q.train(odd_docs(spark, []), labels.limit(0)).curve is None
