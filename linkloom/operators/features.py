"""Features of candidate pairs.

Everything that built-in functions express stays in the JVM; the fuzzy scores come
from one Arrow UDF that returns them all as a struct, so a pair's strings go to
Python once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import vocab
from linkloom.functions.text import numbers, skeleton
from linkloom.operators.blocking import words

CHEAP_FUZZY = ("c_nm_ratio", "c_nm_tset", "c_nm_partial", "c_nm_glued", "c_nv_tset", "c_ad_tset")
CHEAP = (*CHEAP_FUZZY, "c_ad_len_r", "c_nm_len_l", "c_nm_len_r", "c_num_jac", "c_num_r")
FULL_FUZZY = ("nm_ratio", "nm_tsort", "nm_tset", "nm_partial", "nm_jw", "nm_glued", "nm_glued_partial", "nm_skel", "fn_ratio", "fn_tset", "nv_tset", "ad_tset", "ad_tsort", "ad_partial")
FULL_SQL = ("nm_lev", "nm_jac", "nm_inter", "nm_ntok_l", "nm_ntok_r", "nm_len_l", "nm_len_r", "nm_first_eq", "nm_eq", "nv_multi", "ad_len_l", "ad_len_r", "ad_wjac", "ad_wcov",
            "num_jac", "num_inter", "num_r", "num_conflict", "num_first_eq", "comp_jac", "comp_inter", "comp_n_r", "src3")
FULL = (*FULL_FUZZY, *FULL_SQL)
BLOCKING = ("kscore", "k_rank", "k_gap", "k_rel", "k_n")


def joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with both records' columns, suffixed _l and _r."""
    cols = ("name_vars", "name_full", "addr_n", "comps")
    l = left.select(F.col("entity_id").alias("i"), *[F.col(c).alias(f"{c}_l") for c in cols])
    r = right.select(F.col("entity_id").alias("j"), *[F.col(c).alias(f"{c}_r") for c in cols])
    return pairs.join(l, "i").join(r, "j")


def best_variants(a: str, b: str) -> tuple[str, str]:
    """The pair of name variants with the best token-set score, the first of equals."""
    if "|" not in a and "|" not in b:
        return a, b
    pairs = [(x, y) for x in a.split("|") for y in b.split("|")]
    return max(pairs, key=lambda p: S.token_set_ratio(*p))


def _glue(s: str) -> str:
    return s.replace(" ", "")


def _cheap(nl, nr, vl, vr, fl, fr, al, ar, kl, kr) -> tuple:
    return (S.ratio(nl, nr), S.token_set_ratio(nl, nr), S.partial_ratio(nl, nr), S.ratio(_glue(nl), _glue(nr)), S.token_set_ratio(vl, vr), S.token_set_ratio(al, ar))


def _full(nl, nr, vl, vr, fl, fr, al, ar, kl, kr) -> tuple:
    gl, gr = _glue(nl), _glue(nr)
    return (S.ratio(nl, nr), S.token_sort_ratio(nl, nr), S.token_set_ratio(nl, nr), S.partial_ratio(nl, nr), S.jaro_winkler(nl, nr), S.ratio(gl, gr), S.partial_ratio(gl, gr),
            S.token_sort_ratio(kl, kr), S.ratio(fl, fr), S.token_set_ratio(fl, fr), S.token_set_ratio(vl, vr), S.token_set_ratio(al, ar), S.token_sort_ratio(al, ar), S.partial_token_set_ratio(al, ar))


def _scores(names: tuple[str, ...], score: Callable):
    @F.pandas_udf(f"nl string, nr string, {', '.join(f'{n} double' for n in names)}")
    def run(vl: pd.Series, vr: pd.Series, fl: pd.Series, fr: pd.Series, al: pd.Series, ar: pd.Series, kl: pd.Series, kr: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for row in zip(vl, vr, fl, fr, al, ar, kl, kr, strict=True):
            if row not in known:
                nl, nr = best_variants(row[0], row[1])
                skeletons = [dict(zip((w for v in x.split("|") for w in v.split()), k.split(" "), strict=False)) for x, k in ((row[0], row[6]), (row[1], row[7]))]
                kl_, kr_ = (" ".join(s.get(w, w) for w in n.split()) for s, n in zip(skeletons, (nl, nr), strict=True))
                known[row] = (nl, nr, *score(nl, nr, *row[:6], kl_, kr_))
            out.append(known[row])
        return pd.DataFrame(out, columns=["nl", "nr", *names])

    return run


def _skeletons(variants: str) -> Column:
    """Skeletons of all words of all variants, in order: built in SQL, looked up by word in the UDF."""
    return F.array_join(F.transform(F.flatten(F.transform(F.split(variants, r"\|"), words)), skeleton), " ")


def fuzzy(pairs: DataFrame, full: bool) -> DataFrame:
    """Pairs of ``joined`` with the best variants nl and nr and the fuzzy scores."""
    run = _scores(FULL_FUZZY, _full) if full else _scores(CHEAP_FUZZY, _cheap)
    cols = [F.col(f"{c}_{s}") for c in ("name_vars", "name_full", "addr_n") for s in "lr"]
    scored = pairs.withColumn("_s", run(*cols, _skeletons("name_vars_l"), _skeletons("name_vars_r")))
    return scored.select(*pairs.columns, "_s.*")


def _as_double(c: Column) -> Column:
    return c.cast("double")


def cheap_sql(nl: Column, nr: Column) -> dict[str, Column]:
    al, ar = F.col("addr_n_l"), F.col("addr_n_r")
    dl, dr = (F.array_distinct(numbers(words(a))) for a in (al, ar))
    return {"c_ad_len_r": _as_double(F.length(ar)), "c_nm_len_l": _as_double(F.length(nl)), "c_nm_len_r": _as_double(F.length(nr)), "c_num_jac": S.jaccard(dl, dr), "c_num_r": _as_double(F.size(dr))}


def full_sql(nl: Column, nr: Column) -> dict[str, Column]:
    """Features of names nl and nr, addresses and components that need no UDF."""
    al, ar = F.col("addr_n_l"), F.col("addr_n_r")
    tl, tr = words(nl), words(nr)
    sl, sr = F.array_distinct(words(al)), F.array_distinct(words(ar))
    plain = lambda s: F.filter(s, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(vocab.ADDRESS_STOP))
    wl, wr = plain(sl), plain(sr)
    dl, dr = F.array_distinct(numbers(words(al))), F.array_distinct(numbers(words(ar)))
    shared = F.size(F.array_intersect(dl, dr))
    first = lambda a: F.regexp_extract(a, "^([0-9]+)( |$)", 1)
    cl, cr = F.array_distinct(F.split("comps_l", r"\|")), F.array_distinct(F.split("comps_r", r"\|"))
    both = F.size(F.array_intersect(F.array_distinct(tl), F.array_distinct(tr)))
    out = {
        "nm_lev": F.levenshtein(nl, nr), "nm_jac": S.jaccard(tl, tr), "nm_inter": both,
        "nm_ntok_l": F.size(F.array_distinct(tl)), "nm_ntok_r": F.size(F.array_distinct(tr)), "nm_len_l": F.length(nl), "nm_len_r": F.length(nr),
        "nm_first_eq": F.get(tl, F.lit(0)).eqNullSafe(F.get(tr, F.lit(0))), "nm_eq": F.replace(nl, F.lit(" "), F.lit("")) == F.replace(nr, F.lit(" "), F.lit("")),
        "nv_multi": F.contains("name_vars_r", F.lit("|")), "ad_len_l": F.length(al), "ad_len_r": F.length(ar),
        "ad_wjac": S.jaccard(wl, wr), "ad_wcov": F.when(F.size(wr) > 0, F.size(F.array_intersect(wl, wr)) / F.size(wr)).otherwise(-1.0),
        "num_jac": S.jaccard(dl, dr), "num_inter": shared, "num_r": F.size(dr), "num_conflict": (F.size(dl) > 0) & (F.size(dr) > 0) & (shared == 0),
        "num_first_eq": F.when((first(al) == "") | (first(ar) == ""), -1.0).otherwise(_as_double(first(al) == first(ar))),
        "comp_jac": S.jaccard(cl, cr), "comp_inter": F.size(F.array_intersect(cl, cr)), "comp_n_r": F.size(cr), "src3": F.col("j").startswith("S3"),
    }
    return {k: _as_double(v) for k, v in out.items()}


def cheap_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` with the features of the first, cheap model."""
    scored = fuzzy(joined(pairs, left, right), full=False)
    return scored.withColumns(cheap_sql(F.col("nl"), F.col("nr"))).select(*pairs.columns, *CHEAP)


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` with all features of the matching model."""
    scored = fuzzy(joined(pairs, left, right), full=True)
    return scored.withColumns(full_sql(F.col("nl"), F.col("nr"))).select(*pairs.columns, *FULL)
