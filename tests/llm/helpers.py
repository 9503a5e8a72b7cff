"""Small fixtures and brute-force versions of the corpus operators."""

import re
import zlib

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sentence(seed, n):
    """Words from a fixed linear congruence."""
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append("w" + str(seed // 65536 % 5000))
    return out


def messy(spark):
    """doc_id, text, source, lang and clashing columns: nulls, empty and long texts, ties, repeated rows."""
    base = sentence(7, 60)
    near = [*base[:30], "CHANGED", *base[31:]]
    passage = sentence(99, 20)
    rows = [
        (5, " ".join(base), "a", "en"), (2, " ".join(near).upper(), "a", "en"), (9, " ".join(base), None, None), (9, " ".join(base), None, None),
        (3, None, "b", "en"), (4, "", "b", "fr"), (6, "  \n\t ", "b", "fr"), (7, "one two", "b", "de"), (8, "One  two", "c", "de"),
        (10, " ".join([*sentence(1, 30), *passage, *sentence(2, 10)]), "c", "en"), (11, " ".join([*sentence(3, 5), *passage, *sentence(4, 50)]), "c", "en"),
        (None, " ".join(passage), "c", "en"), (12, "é Ünï x 　 " + "日本語 " * 40, "d", "de"), (13, " ".join(sentence(5, 6000)), "d", "en"),
        (14, "x" * 20000, "d", None), (15, " ".join([*sentence(1, 30), *passage]), "a", "en"),
    ]
    clash = [(*r, len(r[1] or ""), f"w{k}", f"b{k}", 77.0 + k, -k, f"r{k}", k * 10, f"i{k}", k % 2 == 0, f"p{k}") for k, r in enumerate(rows)]
    return spark.createDataFrame(clash, CLASH)


#: Columns that operators use for themselves too; ``mark`` tells rows apart.
CLASH = "doc_id long, text string, source string, lang string, n_chars int, n_words string, bucket string, score double, predicted int, removed string, __range int, __id string, once boolean, part string"
CLASHING = ("n_words", "bucket", "score", "predicted", "removed", "__range", "__id", "once", "part")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def held_out(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest
