"""Fixtures as plain functions."""

import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def texts_of(sf=SF):
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def docs(spark, texts, extra=""):
    """documents rows from (doc_id, text) pairs; ``extra``: names of columns that clash."""
    rows = [(i, t, "en", "src0", len(t or "")) + tuple("x" for _ in extra.split()) for i, t in texts]
    return spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in extra.split()))


def save(spark, path, **tables):
    """Write tables the way the given ones are laid out; returns the folder."""
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


ODD = [None, "", " ", "\n\n\t", "a", "A", "1234", "'s", "naïve café", "日本語のテキスト", "🙂🙂", "x" * 5000, "ab " * 3000,
       "tab\tnew\nline\r\nend", " lead and trail  ", "<|endoftext|> special", "İstanbul ΣΑΣ ½ Ⅷ", "é combining", "\x1c\x00 ctl"]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows, similar=80):
    """Brute force over all pairs of (doc_id, text): doc_id -> (size of the set, smallest id reachable)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= similar * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]
