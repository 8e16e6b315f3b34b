"""Name and address cleaning as Column expressions.

All but two steps are built-in functions; Unicode folding and the rendering of
other scripts have no built-in counterpart and are Arrow UDFs, which pass ASCII
through untouched.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab


def _lookup(words: dict[str, str], key: Column) -> Column:
    """``words[key]``, or the key itself."""
    pairs = [F.lit(x) for kv in words.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], key)


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _among(t: Column, items) -> Column:
    return t.isin(list(items))


def clean_nulls(c: Column) -> Column:
    """Marks of missing values become a space, null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"(?iuU){vocab.MISSING}", " ")


def _folded(s: str) -> str:
    if s.isascii():
        return s.lower()
    # a vowel sign has combining class 0 and stays; accents, virama and nukta go
    return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).lower()


@F.pandas_udf(StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(_folded, na_action="ignore")


def fold(c: Column) -> Column:
    """Lower case without accents; letters of other scripts stay."""
    return _fold_udf(c)


def is_latin(c: Column) -> Column:
    """No letter beyond U+024F."""
    return ~c.rlike(r"[\p{L}&&[^\x{0}-\x{24F}]]")


@lru_cache(maxsize=1 << 16)
def romanised(token: str) -> str:
    """Latin letters for a token of another script.

    Greek, Cyrillic, Arabic and Hebrew letters by ``vocab.LETTERS``, others by their Unicode
    names: ``DEVANAGARI LETTER KA`` gives ``ka``, a vowel sign replaces the inherent ``a``,
    ``HANGUL SYLLABLE GAG`` gives ``gag``. Other letters, ideographs above all, become words of
    their own, their code points written in the letters a to p, so that such names meet their
    equals; what is no letter, sign or digit is dropped.
    """
    out = ""
    for ch in unicodedata.normalize("NFC", token):  # folding takes syllables and two-part vowels apart
        if ord(ch) <= 0x24F:
            out += ch
            continue
        if ch in vocab.LETTERS:
            out += vocab.LETTERS[ch]
            continue
        name = unicodedata.name(ch, "")
        head, _, last = name.rpartition(" ")
        if "VOWEL SIGN" in name:
            out = out.removesuffix("a") + last.lower()
        elif "LETTER" in head or "SYLLABLE" in head:
            out += last.lower()
        elif "DIGIT" in name:
            out += str(unicodedata.digit(ch, ""))
        elif "VIRAMA" in name:
            out = out.removesuffix("a")
        elif ch.isalpha():
            out += f" {''.join(chr(97 + int(x, 16)) for x in f'{ord(ch):x}')} "
    return " ".join(out.split())


@F.pandas_udf(StringType())
def _romanise_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else " ".join(t if all(ord(ch) <= 0x24F or not ch.isalpha() for ch in t) else romanised(t) for t in x.split()), na_action="ignore")


def to_latin(c: Column, known: Column | None = None) -> Column:
    """Folded text; tokens of other scripts by the dictionary ``known`` (a map column), else romanised."""
    folded = fold(c)
    if known is not None:
        tokens = F.filter(F.split(folded, r"(?U)\s+"), lambda t: t != "")
        by_word = F.array_join(F.transform(tokens, lambda t: F.when(is_latin(t), t).otherwise(F.coalesce(known[t], t))), " ")
        folded = F.when(is_latin(c), folded).otherwise(by_word)
    return _romanise_udf(folded)


def foreign(c: Column | str) -> Column:
    """Folded tokens of other scripts: those that ``to_latin`` looks up."""
    return F.filter(F.split(fold(F.col(c) if isinstance(c, str) else c), r"(?U)\s+"), lambda t: (t != "") & ~is_latin(t))


def with_known(df: DataFrame, id_col: str, words: Column, dictionary: DataFrame, name: str) -> DataFrame:
    """``df`` with the entries of ``dictionary`` (key, value) for its ``words``, as the map column ``name``.

    For dictionaries too large for a map literal; Spark broadcasts one only below its own size threshold.
    """
    needed = df.select(F.col(id_col).alias("_of"), F.explode(words).alias("key")).distinct()
    found = needed.join(dictionary, "key").groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(name))
    return df.join(found, df[id_col].eqNullSafe(found["_of"]), "left").drop("_of")


def deleet(t: Column) -> Column:
    mixed = t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike("^[0-9]+(st|nd|rd|th)$")
    return F.when(mixed, F.translate(t, *vocab.LEET)).otherwise(t)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def variants_of(latin: Column) -> Column:
    """Alternative names in a latinised name; web addresses lose www., suffix and .co."""
    return _named(_aliases(latin), latin)


def _aliases(latin: Column) -> Column:
    return F.filter(F.transform(F.split(latin, "(?U)" + vocab.ALIAS), strip), lambda p: p != "")


def _named(parts: Column, latin: Column) -> Column:
    bare = lambda p: F.replace(F.regexp_replace(F.regexp_replace(p, r"^www\.", ""), r"\.[^.]*$", ""), F.lit(".co"), F.lit(""))
    parts = F.transform(parts, lambda p: F.when(p.rlike(vocab.WEB), bare(p)).otherwise(p))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(latin))


def name_variants(raw: Column, known: Column | None = None) -> Column:
    return variants_of(to_latin(clean_nulls(raw), known))


def name_tokens(s: Column) -> Column:
    """Words of a latinised name: de-leeted, single letters in a row glued, abbreviations spelt out."""
    for old, new in (("&", " and "), ("+", " "), ("'s ", "s "), ("'", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    words = F.transform(F.regexp_extract_all(F.translate(s, "@$!", "asi"), F.lit("[a-z0-9]+"), F.lit(0)), deleet)
    glued = F.regexp_replace(F.array_join(words, " "), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    words = F.filter(F.split(glued, " "), lambda t: t != "")
    return F.transform(words, lambda t: _lookup(vocab.NAME_WORDS, t))


def core(tokens: Column) -> Column:
    """Tokens that carry identity; all of them where none does."""
    left = F.filter(tokens, lambda t: ~_among(t, vocab.LEGAL_WORDS))
    return F.when(F.size(left) > 0, left).otherwise(tokens)


def normal_name(variants: Column) -> Column:
    """struct(full, core, cores) of a name's variants; the last variant gives full and core."""
    full = F.transform(variants, name_tokens)
    cores = F.transform(full, lambda t: F.array_join(core(t), " "))
    return F.struct(F.array_join(F.element_at(full, -1), " ").alias("full"), F.element_at(cores, -1).alias("core"), cores.alias("cores"))


def _parts(latin: Column) -> Column:
    parts = F.transform(F.split(latin, ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[^a-z0-9/\- ]", " "), " +", " ")))
    return F.filter(parts, lambda p: p != "")


def components_of(latin: Column, country: Column, known: Column | None = None) -> Column:
    """Comma parts of a latinised address, in canonical form."""
    parts = _parts(latin)
    if known is not None:
        parts = F.transform(parts, lambda p: F.coalesce(known[p], p))
    return F.when(country == "us", F.transform(parts, lambda p: _lookup(vocab.US_STATES, p))).otherwise(parts)


def address_tokens(components: Column) -> Column:
    """Words of address components: ordinals bare, word and number parted, abbreviations spelt out."""

    def one(t: Column) -> Column:
        glued = r"^([a-z]+)([0-9]+)$"
        return (
            F.when(t.rlike("^[0-9]+(st|nd|rd|th)$"), F.array(F.regexp_extract(t, "^([0-9]+)", 1)))
            .when(t.rlike(glued), F.array(_lookup(vocab.ADDRESS_WORDS, F.regexp_extract(t, glued, 1)), F.regexp_extract(t, glued, 2)))
            .when(t.rlike("^[0-9]+[a-z]$"), F.array(F.regexp_extract(t, "^([0-9]+)", 1)))
            .otherwise(F.array(_lookup(vocab.ADDRESS_WORDS, t)))
        )

    return F.flatten(F.transform(components, lambda p: F.flatten(F.transform(F.regexp_extract_all(p, F.lit("[a-z0-9]+"), F.lit(0)), one))))


def skeleton(t: Column) -> Column:
    """First letter and consonant classes of a word, runs collapsed; numbers stay."""
    mapped = F.translate(t, *vocab.CONSONANTS)
    rest = F.regexp_replace(F.regexp_replace(F.substring(mapped, 2, 1 << 30), "[aeiouyhw]", ""), r"(.)\1+", "$1")
    return F.when(t.rlike("^[0-9]*$"), t).otherwise(F.concat(F.substring(mapped, 1, 1), rest))


def country(c: Column) -> Column:
    folded = strip(fold(F.coalesce(c, F.lit(""))))
    return F.when(folded == "", F.lit("_unk")).otherwise(folded)


def numbers(tokens: Column) -> Column:
    """Number tokens without leading zeros."""
    return F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: F.regexp_replace(t, "^0+", ""))


def prepare(records, translit: Column | DataFrame | None = None, component: Column | DataFrame | None = None):
    """Records in comparable form: name_full, name_core, name_vars, addr_n, comps, ctry.

    Each record is cleaned once; the Arrow steps run before the expressions that build on them.
    Dictionaries are map columns or, beyond the size of a literal, tables (key, value).
    """
    if isinstance(translit, DataFrame):
        words = F.concat(foreign(clean_nulls(F.col("business_name"))), foreign(clean_nulls(F.col("business_address"))))
        records, translit = with_known(records, "entity_id", words, translit, "_translit"), F.col("_translit")
    latin = records.select("entity_id", to_latin(clean_nulls(F.col("business_name")), translit).alias("_n"), to_latin(clean_nulls(F.col("business_address")), translit).alias("_a"), country(F.col("country")).alias("ctry"))
    if isinstance(component, DataFrame):
        latin, component = with_known(latin, "entity_id", _parts(F.col("_a")), component, "_component"), F.col("_component")
    # each step is a projection of its own: Spark doesn't merge one into the next that uses it several times, so
    # no step is evaluated twice
    named = latin.withColumns({"_aliases": _aliases(F.col("_n")), "_comps": components_of(F.col("_a"), F.col("ctry"), component)})
    named = named.withColumn("_variants", _named(F.col("_aliases"), F.col("_n")))
    named = named.withColumn("_full", F.transform("_variants", name_tokens))
    named = named.withColumn("_kept", F.transform("_full", lambda t: F.filter(t, lambda x: ~_among(x, vocab.LEGAL_WORDS))))
    named = named.withColumn("_cores", F.zip_with("_kept", "_full", lambda kept, full: F.array_join(F.when(F.size(kept) > 0, kept).otherwise(full), " ")))
    return named.select(
        "entity_id", F.array_join(F.element_at("_full", -1), " ").alias("name_full"), F.element_at("_cores", -1).alias("name_core"),
        F.array_join(F.array_distinct("_cores"), "|").alias("name_vars"),
        F.array_join(address_tokens(F.col("_comps")), " ").alias("addr_n"), F.array_join("_comps", "|").alias("comps"), "ctry")
