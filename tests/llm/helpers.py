"""Rows that every operator has to take, and the documents of the small tables."""
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that the operators use themselves, as columns of the input.
CLASHES = ["row", "d", "x", "t", "f", "w", "key", "lines", "_text", "spans", "range", "words", "item", "kept", "lang.x"]


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs(spark, texts=()):
    """Documents with null and repeated ids, null, empty and long texts,
    repeated rows, and columns whose names clash; plus ``texts``."""
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "xx", "a"), (4, "one", "xx", "a"),
            (None, "two words", "en", "b"), (None, None, None, None), (5, "long word " * 30_000, "en", "b")]
    rows += [(100 + i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows = [(*r, len(r[1]) if r[1] is not None else None, *range(len(CLASHES))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


def documents(spark, extra=()):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    if extra:
        df = df.unionByName(spark.createDataFrame(list(extra), "doc_id long, text string"), allowMissingColumns=True)
    return df
