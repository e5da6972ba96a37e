"""Functions that only Python can do, registered for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codexa.functions import isbn, markup, tokens
from codexa.functions.fingerprint import _hashed, minhash_all, simhash_all

CONVERTERS = {"html_to_text": markup.html_to_text, "fb2_to_text": markup.fb2_to_text, "fb3_to_text": markup.fb3_to_text, "pml_to_text": markup.pml_to_text, "lrf_to_text": markup.lrf_to_text}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session and tell their names."""

    def per_value(f, kind):
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        return F.pandas_udf(run, kind)

    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash_all(*_hashed(texts.tolist(), 5)).view("int64"))

    def minhash(texts: pd.Series) -> pd.Series:
        return pd.Series(list(minhash_all(*_hashed(texts.tolist(), 5)).view("int64")))

    known = {name: per_value(step, "string") for name, step in CONVERTERS.items()}
    known |= {"isbn_normalize": per_value(isbn.normalized, "string"), "isbn_validate": per_value(isbn.validated, "string"), "find_isbns": per_value(isbn.find, "array<string>"), "word_tokens": per_value(tokens.words, "array<string>")}
    known |= {"simhash": F.pandas_udf(simhash, "long"), "minhash": F.pandas_udf(minhash, "array<long>")}
    for name, udf in known.items():
        spark.udf.register(name, udf)
    return sorted(known)
