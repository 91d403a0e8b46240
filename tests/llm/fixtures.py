"""Small documents with the cases that every operator must stand."""

import random
import re
import zlib

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def odd_rows():
    """Nulls in any column, empty, blank, tiny and long texts, ties, repeated rows and non-ASCII."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d e", "a b c d e", "ÄÖ é 日本 𝔘 😀", "\x00 nul", long, "x" * 3000, "same line\nsame line\nother\n" * 9, "# $ % & | < > *" * 7]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", None][i % 2], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (40, "a b c d e", None, None, None), (None, "no id here at all", "en", "s0", 3)]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """The same rows with further columns whose names operators use inside."""
    names = ["id", "node", "n", "score", "weight", "topic", "n_tokens", "kept", "keep", "bucket", "comp", "n_words", "sig", "h", "c", "__keep", "probability", "selected", "lang_pred", "count"]
    for name in names:
        df = df.withColumn(name, F.lit(name))
    return df


def synthetic(n, seed=1, vocabulary=400):
    """Texts of random words, some near copies of others."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = list(r.choice(out)[1].split())
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = r.choices(vocab, k=r.randint(3, 120))
        out.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    return out
