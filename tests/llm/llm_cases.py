"""Small documents with every odd case, and plain-Python readings of words and shingles."""

import re

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, node string, copies int, bin string"
)
BASE = "The quick brown fox jumps over the lazy dog while seventeen small birds sing about the coming rain of June"


def odd_documents():
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns named as the operators' own."""
    texts = [
        (0, BASE, "en", "a"),
        (1, BASE, "en", "a"),
        (1, BASE, "en", "a"),
        (2, None, "en", "b"),
        (3, "", None, None),
        (4, " \t\n\r\x0b\x0c ", "en", "b"),
        (5, "one", "en", ""),
        (6, "one two", None, None),
        (7, "Grüße aus Köln — 東京 🎉 " * 30, "de", "c"),
        (8, (BASE + ".\n") * 900, "en", "a"),
        (None, BASE + " and more words than before", None, None),
        (None, None, None, None),
        (9, BASE.replace("lazy", "very lazy"), "en", "c"),
        (10, "x" * 5000, "en", "c"),
        (11, "a\nb\na\n\n \nb\na", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", 7, "z") for i, t, lang, s in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, DOC_SCHEMA)


def plain(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None if t is None else len(t), "x", "y", 7, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=3):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if 0 < len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def groups(links, members):
    """Smallest member that each reaches."""
    parent = {m: m for m in members}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {m: find(m) for m in members}
