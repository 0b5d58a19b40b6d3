"""Token counts against the library itself."""
import public_tokenizers
from pyspark.sql import functions as F

from robustlens.llm import tokencount as tk

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark, sf_dir):
    odd = ["", None, " ", "  ", "a", "a  b", "\n", "a\nb", "\n\na ", " a ", "<s>hi</s>", "ﬁ", "▁", "a▁b▁▁", "a　b", "\x01 a", "x" * 5000, "😀 😀\n😀", "a b " * 40000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(odd)], "doc_id long, text string, n_tokens int")
    docs = docs.unionByName(docs).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1).alias("n_tokens")))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sp = tk.load(PATH)
    rows = tk.count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count() and {r.over_limit for r in rows} == {True, False}
    for r in rows:
        n = len(sp.encode(texts[r.doc_id], num_threads=1))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_empty_table(spark):
    assert tk.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
