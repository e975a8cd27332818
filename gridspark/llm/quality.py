"""A quality classifier that compares compressed sizes.

Two zstandard dictionaries are built from good and from bad labelled text.  A
text is compressed with either, in blocks of a fixed length so that the
dictionary and not the text's own past decides; the difference of the two sizes
over the smaller one, and how far the text shrinks at all, become a probability
by a logistic curve fitted to labelled texts which neither dictionary has seen.

Both learn from every labelled text: tasks build dictionaries of their parts,
which are merged by further rounds of training; the curve's sums are added up
from all parts in each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gridspark.llm.common import fresh, held_out, ids_and_text, labelled_texts, logistic_sums, newton, table, trim, with_columns, written

BLOCK = 512
LEVEL = 3
DICT_BYTES = 112_640
#: Labelled texts are learned from in parts of about so many bytes; so many parts' dictionaries are merged at once.
PART_BYTES = 1_000_000
TOGETHER = 32
#: So few different texts of a label are dealt to dictionaries and curve in turn, more by their hashes.
FEW = 64
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray | None  # weights of the three measures and the constant; None: not trained


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of few texts, their last bytes themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of whole texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def measures(self, text: str) -> tuple[float, float, float]:
        """(bad - good) / the smaller, the smaller / the text's bytes, (bad - good) / the text's bytes; an empty text: 0, 1, 0."""
        raw = _raw(text)
        if not raw:
            return 0.0, 1.0, 0.0
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.by)
        return (bad - good) / min(good, bad), min(good, bad) / len(raw), (bad - good) / len(raw)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _learned(texts: DataFrame) -> DataFrame:
    """For each label and part: a row with the dictionary of its texts in ``first``, and its other texts, each once with its number n."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once = rows.groupby(["first", "h", "text"], as_index=False).size()
        own, other = once[once["first"]]["text"], once[~once["first"]]
        out = pd.DataFrame({"text": other["text"], "n": other["size"], "dictionary": None})
        if len(own):
            out.loc[-1] = [None, 0, _dictionary([_raw(t) for t in own])]
        return out.assign(label=key[0], part=key[1])[["label", "part", "dictionary", "text", "n"]]

    return texts.groupBy("label", "part").applyInPandas(of, "label int, part long, dictionary binary, text string, n long")


def _dictionaries(found: DataFrame, parts: int) -> dict[int, bytes]:
    """A dictionary for each label from those of all parts: of TOGETHER dictionaries one is made until one is left."""

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("part")["dictionary"].tolist()
        return pd.DataFrame({"label": [key[0]], "part": [key[1]], "dictionary": [own[0] if len(own) == 1 else _dictionary(own)]})

    found = found.select("label", "part", "dictionary")
    while parts > 1:
        found = found.groupBy("label", F.floor(F.col("part") / TOGETHER).alias("to")).applyInPandas(merged, "label int, part long, dictionary binary")
        parts = -(-parts // TOGETHER)
    return {r["label"]: bytes(r["dictionary"]) for r in found.collect()}


def _measured(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """A row for each label and part: its texts' measures (ten times), 1, label and count, as an array of six columns."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for b in batches:
            x = np.array([sizes.measures(t) for t in b["text"].to_pylist()]).reshape(-1, 3) * 10
            yield pa.RecordBatch.from_arrays([b["label"], b["part"], b["n"], *[pa.array(x[:, i]) for i in range(3)]], names=["label", "part", "n", "x0", "x1", "x2"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(["x0", "x1", "x2", "n"]).assign(one=1.0)[["x0", "x1", "x2", "one", "label", "n"]].to_numpy(dtype=np.float64)
        return pd.DataFrame({"label": [key[0]], "part": [key[1]], "x": [x.tobytes()]})

    found = texts.mapInArrow(measure, "label int, part long, n long, x0 double, x1 double, x2 double")
    return found.groupBy("label", "part").applyInPandas(pack, "label int, part long, x binary")


def _sums(measured: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """logistic_sums() over all parts, added in their order, so that equal tables give equal bits."""
    k = len(w)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b["x"].to_pylist():
                x = np.frombuffer(raw).reshape(-1, k + 2)
                g, h = logistic_sums(x[:, :k], x[:, k], w, x[:, k + 1])
                out.append(np.append(g, h).tobytes())
            yield pa.RecordBatch.from_arrays([b["label"], b["part"], pa.array(out, pa.binary())], names=["label", "part", "x"])

    rows = measured.mapInArrow(of, "label int, part long, x binary").collect()
    total = sum(np.frombuffer(r["x"]) for r in sorted(rows, key=lambda r: (r["label"], r["part"])))
    return total[:k], total[k:].reshape(k, k)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows that aren't held out; without two texts of both labels every score is 0.5.

    Of a label's texts, by their hashes, one half goes into the dictionaries and
    the other fits the curve; copies of a text stay together.
    """
    texts = labelled_texts(docs, labels, "quality")
    size = {r["label"]: r for r in texts.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.approx_count_distinct("h").alias("different")).collect()}
    if len(size) < 2:
        return Model(b"", b"", None)
    parts = {k: max(1, r["bytes"] // PART_BYTES) for k, r in size.items()}
    first = F.col("h") % 2 == 0
    for k, r in size.items():
        if r["different"] <= FEW:
            turns = sorted(x["h"] for x in texts.filter(F.col("label") == k).select("h").distinct().collect())
            first = F.when(F.col("label") == k, F.col("h").isin(turns[::2])).otherwise(first)
    part = F.pmod("at", F.when(F.col("label") == 1, parts[1]).otherwise(parts[0]).cast("long"))
    learned = written(_learned(texts.select("label", "text", "h", part.alias("part"), first.alias("first"))))
    rest = learned.filter("text IS NOT NULL")
    n = {r["label"]: r["n"] for r in rest.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(n) < 2:
        return Model(b"", b"", None)
    by = _dictionaries(learned.filter("dictionary IS NOT NULL"), max(parts.values()))
    measured = written(_measured(rest.drop("dictionary"), by[1], by[0]))
    w = newton(lambda w: _sums(measured, w), 4)
    trim()
    # the constant keeps to the labels' shares among all texts
    shift = np.log(size[1]["n"] / size[0]["n"]) - np.log(n[1] / n[0])
    return Model(by[1], by[0], np.append(w[:-1] * 10, w[-1] + shift))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and, as ``name``, the score (0 to 1) of every row's whole text (null: empty).

    Equal texts get equal scores; an empty table gives an empty result.  ``name``
    must not be a column of docs.
    """

    def start() -> Callable[[pa.RecordBatch], list[list]]:
        curve = np.zeros(4) if model.curve is None else model.curve
        sizes = None if model.curve is None else Sizes(model.good, model.bad)

        def of(b: pa.RecordBatch) -> list[list]:
            x = np.array([sizes.measures(t or "") if sizes else (0.0, 0.0, 0.0) for t in b["text"].to_pylist()]).reshape(-1, 3)
            return [1 / (1 + np.exp(-np.clip(x @ curve[:3] + curve[3], -30, 30)))]

        return of

    return with_columns(docs, [StructField(name, DoubleType())], start)


def QUERY(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(ids_and_text(docs), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with their columns, whatever these are called."""
    model = train(docs, table(spark, sf_dir, "labels"))
    name = fresh("score", docs.columns)
    return score(docs, model, name).filter(F.col(name) >= THRESHOLD).drop(name)
