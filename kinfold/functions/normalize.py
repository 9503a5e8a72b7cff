"""Normalisation of names and addresses as Catalyst expressions.

Every function takes and returns Columns, so a table is normalised in one
projection inside the JVM. Only the folding of scripts beyond Latin
(``fold_any``) needs Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions import tables as t


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code).lower())[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _latin()


def fold(text: Column) -> Column:
    """Lower case without Latin accents; null is empty. Texts in ASCII, which are most, are only lower-cased."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.translate(low, ACCENTED, BASE)
    for ligature, letters in t.LIGATURES:
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low)


def _sound(name: str) -> str:
    """The sound that a letter's Unicode name stands for: ka is k, er is r, alpha is a, yu is yu."""
    if len(name) < 3 and name[0] in "iy":
        return name
    if name[0] in "aeiou":
        return name[1] if len(name) == 2 and name[0] == "e" and name[1] not in "aeiou" else name[0]
    return re.match("[^aeiou]+", name)[0]


@F.pandas_udf(T.StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """``fold`` for any script: compatibility forms, marks off, then romanised letter by letter by the sounds of Unicode names."""

    def letter(c: str) -> str:
        if ord(c) < 0x250:
            return dict(t.LIGATURES).get(c, c)
        name = unicodedata.name(c, "")
        for head in (" LETTER SMALL ", " SMALL LETTER ", " LETTER ", " SYLLABLE ", " VOWEL SIGN "):
            if head in name:
                return _sound(name.split(head)[1].split(" ")[0].lower())
        return str(unicodedata.digit(c)) if c.isdigit() else " " if c.isspace() or not c.isalnum() else ""

    def one(s: str) -> str:
        if s.isascii():
            return s.lower()
        s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).lower())
        return "".join(letter(c) for c in s if unicodedata.category(c) != "Mn")

    return text.fillna("").map(one)


def has_native(text: Column) -> Column:
    """Whether a character beyond Latin Extended-B occurs."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\x{0000}-\x{024F}]")


def _lookup(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def mapped(word: Column, mapping: Mapping[str, str]) -> Column:
    """The mapping's value of a word, or the word; the hashed membership test spares other words the search of the map."""
    return F.when(word.isin(*mapping), F.coalesce(F.try_element_at(_lookup(mapping), word), word)).otherwise(word)


def name_tokens(folded: Column) -> Column:
    """Tokens of a folded name: acronyms closed, domains and store numbers off, phone numbers dropped, leet spelling repaired."""
    s = F.replace(folded, F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, t.ACRONYM, "$1$2$3")
    s = F.regexp_replace(F.regexp_replace(s, t.TLD, " "), t.STORE_NUMBER, " ")
    raw = F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))

    def repaired(w: Column) -> Column:
        digits = F.length(F.regexp_replace(w, "[a-z]", ""))
        letters = F.length(w) - digits
        whole = F.array(w)
        leet = F.array(F.translate(w, t.LEET_FROM, t.LEET_TO))
        runs = F.regexp_extract_all(w, F.lit("[a-z]+|[0-9]+"), F.lit(0))
        phone = F.when(digits >= 7, F.array().cast("array<string>")).otherwise(whole)
        return F.when(digits == 0, whole).when(letters == 0, phone).when((letters >= 3) & (digits <= 2), leet).otherwise(runs)

    flat = F.flatten(F.transform(raw, repaired))
    return F.when(F.get(flat, F.lit(0)) == "the", F.slice(flat, 2, F.greatest(F.size(flat), F.lit(1)))).otherwise(flat)


def legal_forms(tokens: Column) -> Column:
    """The distinct legal forms among the tokens, sorted."""
    known = F.filter(tokens, lambda w: w.isin(*t.LEGAL_CANON))
    return F.array_sort(F.array_distinct(F.transform(known, lambda w: mapped(w, t.LEGAL_CANON))))


def core_tokens(tokens: Column) -> Column:
    """Canonical tokens without legal forms; all tokens where nothing else is there."""
    core = F.transform(F.filter(tokens, lambda w: ~w.isin(*t.LEGAL_CANON)), lambda w: mapped(w, t.NAME_CANON))
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def key_tokens(core: Column) -> Column:
    """Sorted core tokens without stop words (repeats stay), or all of them."""
    key = F.filter(core, lambda w: ~w.isin(*t.NAME_STOP))
    return F.array_sort(F.when(F.size(key) > 0, key).otherwise(core))


def phonetic(word: Column) -> Column:
    """Digraphs folded, vowels after the first letter off, repeats collapsed."""
    for pair, sound in t.DIGRAPHS:
        word = F.replace(word, F.lit(pair), F.lit(sound))
    return F.regexp_replace(F.regexp_replace(word, "(?<=.)[aeiou]", ""), r"(.)\1+", "$1")


def skeleton_tokens(key: Column) -> Column:
    """Sorted phonetic forms of at least two letters; numbers stay as they are."""
    forms = F.transform(key, lambda w: F.when(w.rlike("^[0-9]+$"), w).otherwise(phonetic(w)))
    return F.array_sort(F.filter(forms, lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]+$")))


def address_tokens(folded: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Canonical tokens of a folded address: ordinal suffixes after digits off, learned aliases applied, dropped words off."""
    raw = F.regexp_extract_all(folded, F.lit("[a-z]+|[0-9]+"), F.lit(0))

    def kept(w: Column, i: Column) -> Column:
        before = F.get(raw, i - 1)
        return ~(w.isin(*t.ORDINAL_SUFFIX) & F.coalesce(before.rlike("^[0-9]+$"), F.lit(False)))

    out = F.filter(raw, kept)
    if aliases:
        out = alias_rewrite(out, aliases)
    out = F.transform(out, lambda w: mapped(w, t.ADDR_CANON))
    return F.filter(out, lambda w: ~w.isin(*t.ADDR_DROP))


def alias_rewrite(tokens: Column, aliases: Mapping[str, str]) -> Column:
    """Left to right, the longest alias of two tokens, then of one. The aliases are a learned table of bounded size."""
    table = _lookup(aliases)
    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("skip"), F.lit(0).alias("i"))

    def step(acc: Column, w: Column) -> Column:
        following = F.get(tokens, acc["i"] + 1)
        two = F.try_element_at(table, F.concat_ws(" ", w, following))
        two = F.when(following.isNotNull(), two)
        one = F.coalesce(F.try_element_at(table, w), w)
        fresh = acc["skip"] == 0
        out = F.when(fresh, F.concat(acc["out"], F.array(F.coalesce(two, one)))).otherwise(acc["out"])
        skip = F.when(fresh & two.isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return F.struct(out.alias("out"), skip.alias("skip"), (acc["i"] + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w.rlike("^[0-9]+$"))


def first_number(nums: Column) -> Column:
    """The first of blank-separated numbers as double, -1 if there is none."""
    return F.coalesce(F.get(F.split(nums, " "), F.lit(0)).try_cast("double"), F.lit(-1.0))


def has_alias_marker(text: Column) -> Column:
    """Whether a raw name says that it is another name (formerly, trading as, ...)."""
    return F.coalesce(text, F.lit("")).rlike(t.ALIAS_MARKER)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def pair_text(name: Column, address: Column, query: bool = False) -> Column:
    """The text that neural encoders see of a record."""
    return F.concat(F.lit("query: " if query else ""), F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))


def normalize(df: DataFrame, name_col: str = "business_name", address_col: str = "business_address", aliases: Mapping[str, str] | None = None, any_script: bool = False) -> DataFrame:
    """``df`` with name_lat, name_core, name_key, name_skel, legal, native, addr_norm, nums, addr_missing.

    Several projections, so that each array is computed once. With
    ``any_script`` names and addresses of all scripts are romanised, by one
    Arrow round trip; else those beyond Latin stay as they are.
    """
    own = fold_any if any_script else fold
    df = df.withColumns({"__fn": own(F.col(name_col)), "__fa": own(F.col(address_col))})
    df = df.withColumns({"__n": name_tokens(F.col("__fn")), "__a": address_tokens(F.col("__fa"), aliases)})
    df = df.withColumn("__c", core_tokens(F.col("__n"))).withColumn("__k", key_tokens(F.col("__c")))
    joined = lambda c: F.array_join(c, " ")
    df = df.withColumns(
        {
            "name_lat": joined("__n"), "name_core": joined("__c"), "name_key": joined("__k"), "name_skel": joined(skeleton_tokens(F.col("__k"))),
            "legal": joined(legal_forms(F.col("__n"))), "native": has_native(F.col(name_col)).cast("int"),
            "addr_norm": joined("__a"), "nums": joined(numbers(F.col("__a"))), "addr_missing": (F.size("__a") == 0).cast("int"),
        }
    )
    return df.drop("__fn", "__fa", "__n", "__a", "__c", "__k")
