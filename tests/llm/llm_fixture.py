"""Rows with every edge case, and helpers of the tests."""

import os

import duckdb

LONG = "lorem ipsum dolor " * 4000
EDGES = [  # doc_id, text, lang, source
    (1, "the cat sat on the mat and the dog sat on the log near the cat house today", "en", "a"),
    (2, "the cat sat on the mat and the dog sat on the log near the cat house today", "en", "a"),
    (2, "the cat sat on the mat and the dog sat on the log near the cat house today", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "c"),
    (7, "x" * 30000, "fr", "c"),
    (None, "a row without an id but with a few words of text in it", "en", None),
    (None, None, None, None),
    (8, "É́日本語 \U0001f600 \x00 ​ </s>[INST] ok \x1c \x85 end", "fr", "é"),
]
#: Columns whose names an operator might use itself.
CLASHES = ("id", "fp", "score", "hash", "size", "word", "row", "list", "ids", "logp", "target", "n_words", "mix_hash", "simhash_fp")


def edge_docs(spark, rows=EDGES):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    full = [(*r, len(r[1] or ""), *(["clash"] * len(CLASHES))) for r in rows]
    return spark.createDataFrame(full, schema)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return mine == sorted(map(repr, theirs))
