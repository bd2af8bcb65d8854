import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from refsieve.operators import embeddings


def test_a_task_holds_and_returns_a_bounded_piece_of_its_product(monkeypatch):
    monkeypatch.setattr(embeddings, "CELLS", 1_000)
    rows = pd.DataFrame({
        "id": np.arange(400), "value": [np.ones(3, np.float32)] * 400, "copies": 1, "cell": 0,
        "block": 0, "other": 1, "visitors": False, "first": np.arange(400) % 2 == 0,
    })
    found = list(embeddings._matches(0.5)(iter([rows])))
    assert max(len(piece) for piece in found) <= 1_000 and sum(len(piece) for piece in found) == 200 * 200
    assert all((piece["id1"] < piece["id2"]).all() for piece in found)


def test_visitors_are_dealt_out_in_bounded_pieces(spark, monkeypatch):
    """A batch of rows became a row per pivot at once."""
    monkeypatch.setattr(embeddings, "CELLS", 1_600)
    pieces = embeddings._piece_function()
    batch = pd.DataFrame({"id": np.arange(1_000)})
    cut = list(pieces(iter([batch, batch.iloc[:0]]), 16 * 4))
    assert max(len(piece) for piece in cut) <= 25 and pd.concat(cut)["id"].tolist() == list(range(1_000))
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = embeddings.embedding_pairs(frame, 0.5, pivots=20, block_rows=7)
    monkeypatch.setattr(embeddings, "CELLS", 1 << 20)
    whole = embeddings.embedding_pairs(frame, 0.5)
    assert small.exceptAll(whole).isEmpty() and small.count() == whole.count() > 100
    assert small.filter(F.col("id1") >= F.col("id2")).isEmpty()
