"""What a task holds does not follow the size of Spark's batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.batches import PIECE_ROWS, pieces
from tessera.operators import chunking, parsing


def test_pieces_hold_every_row_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 250), (250, 250), (250, 251))]
    out = list(pieces(batches))
    assert [p.num_rows for p in out] == [100, 100, 50, 1] and [x for p in out for x in p.column(0).to_pylist()] == list(range(251))


def test_parser_and_chunker_take_pieces(spark, monkeypatch):
    """Each piece is made, and handed on, before the next is looked at."""
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("# T").alias("text"))
    parsing.parse_documents(docs)
    n = 3 * PIECE_ROWS
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["# T\n\none two"] * n})
    parsed = list(made[0](iter([whole])))
    assert [b.num_rows for b in parsed] == [PIECE_ROWS] * 3  # one batch of all of them before
    chunking.chunk_documents(docs.select("doc_id", F.lit(None).alias("blocks")), "structure")
    again = pa.Table.from_batches(parsed).select(["doc_id", "blocks"]).combine_chunks().to_batches()
    chunks = list(made[1](iter(again)))
    assert len(chunks) == 3 and sum(b.num_rows for b in chunks) == n
