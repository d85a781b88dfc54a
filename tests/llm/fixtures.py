"""A small corpus with every awkward case: nulls, blanks, repeated rows, copies, odd white space, long texts."""

from millrace.llm.queries import tokenizer

BYTE_BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
WORDS = "the of and to in that shall window blest thorn heron river stone amber quiet field harbour lantern meadow signal".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x >> 20 & 3 else "en"))
    return " ".join(out)


LONG = prose(99, 30000)
SHARED = prose(5, 60)
DOCS = [
    (0, prose(1, 120), "en", "a", 1),
    (1, SHARED + " " + prose(2, 40), "en", "a", 1),
    (2, prose(3, 30) + "\n" + SHARED + "\t" + prose(4, 30), "fr", "a", 1),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "fr", "b", 3),
    (6, prose(1, 120), "en", "a", 1),
    (6, prose(1, 120), "en", "a", 1),
    (7, prose(1, 119) + " changed", "en", "b", 1),
    (None, prose(8, 50), "en", "a", 1),
    (8, "Ünïcode  double  spaces and▁marks <|endoftext|> 日本語 \U0001f600 </s> 123 4567 'twas", "fr", "b", 1),
    (9, LONG, "en", "c", 1),
    (10, "x" * 20000, "en", "c", 1),
    (11, "short", "fr", "c", 1),
    (12, "12 34 -- ?", "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, parts: int = 3):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "fp n_tokens N_BYTES lengths judged lang_pred score key pid row_tag described topic weight probability fingerprint own size"
    return corpus(spark).withColumns({n: F.lit("mine") for n in names.split()})
