"""The ONNX backend, with a tiny model written here: a table of token vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import semantic

pytest.importorskip("onnxruntime")
WORDS = ["[PAD]", "[UNK]", "river", "house", "code", "walk"]
TABLE = np.arange(len(WORDS) * 4, dtype=np.float32).reshape(-1, 4) % 7


def field(number, value):
    """A protobuf field: an integer, bytes, or text."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model():
    """input_ids (batch, tokens) to vectors (batch, tokens, 4), by Gather."""

    def io(name, kind, *dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    table = b"".join(field(1, d) for d in TABLE.shape) + field(2, 1) + field(8, "table") + field(9, TABLE.tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "vectors") + field(4, "Gather")
    graph = field(1, node) + field(2, "tiny") + field(5, table) + field(11, io("input_ids", 7, "b", "t")) + field(12, io("vectors", 1, "b", "t", 4))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_texts_get_the_mean_of_their_tokens(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    tokenizer = Tokenizer(WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "model.onnx").write_bytes(model())
    backend = semantic.onnx_backend(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), 4)
    texts = ["river house", "code", "walk walk river unknown", "house"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.embedding for r in semantic.embed(rows, "text", backend).collect()}
    for k, t in enumerate(texts):
        ids = [WORDS.index(w) if w in WORDS else 1 for w in t.split()]
        assert got[k] == pytest.approx(TABLE[ids].mean(axis=0).tolist(), abs=1e-6)
    key = [F.lit("c").alias("collection"), F.col("id").cast("string").alias("path"), F.lit(0).alias("chunk_index")]
    pool = semantic.cosine_pool(semantic.embed(rows, "text", backend).select(*key, "embedding"), semantic.embed(rows.withColumnRenamed("id", "qid"), "text", backend), 1)
    assert {(r.qid, r.path) for r in pool.collect()} == {(k, str(k)) for k in range(4)}
    wrong = semantic.onnx_backend(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), 5)
    with pytest.raises(Exception, match="gave vectors of shape"):
        semantic.embed(rows, "text", wrong).collect()
