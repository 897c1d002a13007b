import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, comp long, w string, words string"


def docs(spark, texts, langs=None, sources=None, ids=None):
    """Documents with further columns whose names clash with ones the operators use inside."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None, "k", -1, "w", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
