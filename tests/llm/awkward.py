"""Small tables with nulls, empty and long texts, repeats and clashing columns."""

from pyspark.sql import types as T

CLASH = ["row", "q", "fp", "hits", "found", "n_words", "kept", "votes", "id", "mark", "t", "spans", "salt", "n", "nth"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASH])

CLEAN = ("The quick brown fox jumps over the lazy dog near a quiet river bank today. "
         "Nobody saw it happen, but many people heard about it later in the evening.")
LONG = " ".join(f"word{i} of a very long text number {i * 7}" for i in range(20_000)) + "."
TEXTS = [
    (1, CLEAN), (2, CLEAN), (2, CLEAN), (3, None), (4, ""), (None, CLEAN + " More."), (None, None), (5, " \n\t \n"),
    (6, "Write to jane.doe@example.com or call +1 (555) 123-4567 now, from 10.0.0.12 please, thank you very much."),
    (7, LONG), (8, "Ünï ćödé tèxt " * 30), (9, "a"), (10, "x" * 50_000), (11, "<|endoftext|> <|im_end|> \\| <\\|"),
    (12, CLEAN + " Extra."), (13, "word " * 400),
]


def documents(spark, texts=None):
    rows = [(i, t, None, "src", None if t is None else len(t), *["clash"] * len(CLASH)) for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)
