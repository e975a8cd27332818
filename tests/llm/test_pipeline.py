import re
import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
import test_jaccard
import test_packing
from fixtures import TEXTS, odd_docs

from gridspark.llm import quality
from gridspark.llm.common import written
from gridspark.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def _cut(rows):
    """Texts without bytes of 50-byte strings that a smaller doc_id has."""
    first = {}
    for i, t in rows:
        r = (t or "").encode()
        for p in range(len(r) - 49):
            k = r[p : p + 50]
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, t in rows:
        r = (t or "").encode()
        gone = np.zeros(len(r), dtype=bool)
        for p in range(len(r) - 49):
            if first[r[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = bytes(np.frombuffer(r, dtype=np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else t
        if not gone.any() or left.strip(" "):
            out[i] = left
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    seen, results = [texts(docs)], []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        results.append(docs)
        if name != "best-fit packing":
            assert docs.columns == columns
            seen.append(texts(docs))
    start, good, single, cut, clean = seen
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    sizes = quality.Sizes(model.good, model.bad)
    score = lambda t: 1 / (1 + np.exp(-(np.dot(sizes.measures(t), model.curve[:3]) + model.curve[3])))
    assert good == {i: t for i, t in start.items() if score(t) >= 0.3}
    groups = test_jaccard.brute(list(good.items()), 5, 80)
    assert single == {d: good[d] for d, _, c in groups if c == d}
    assert cut == _cut(sorted(single.items()))
    assert all(r.n_chars == len(cut[r.doc_id]) for r in results[2].collect())
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean == {i: t for i, t in cut.items() if not any(x in words(t) for x in items)}
    packed = results[4].collect()
    test_packing.check(packed, 2048)
    t = encoder(tokenizer_path()).t
    for i, text in clean.items():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.piece)
        assert [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in own] == [r.ids_crc32 for r in own] and sum(r.length for r in own) == len(ids)


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for rows in ([], TEXTS):
        docs = odd_docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF))
        assert (docs.count() == 0) == (not rows)
